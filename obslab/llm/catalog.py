"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obslab.llm import (
    collocations, decontamination, fingerprints, html_text, language_id, lm_scoring, mixing, near_join, packing, prefix_trie, quality_rules, secret_scan,
    token_counts,
)
from obslab.llm.common import documents, remainder, ship, stored
from obslab.llm.statements import SQL  # noqa: F401  (registered beside the queries)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(documents(spark, folder).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(f"quality.{n}" for n in names))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    table, held_out = documents(spark, folder), remainder("doc_id", 4) == 2
    model = language_id.learn(table.where(~held_out))
    found = language_id.predict(table, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_chosen_path_join(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return near_join.near_join(documents(spark, folder))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return packing.pack(documents(spark, folder))


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edit_likeness(documents(spark, folder))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = stored(mixing.sized_documents(documents(spark, folder)), "mixing")
    return mixing.taken_words(mixing.mix(sized)).select("doc_id", "size", "source_size", "target", "taken")


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return secret_scan.report(documents(spark, folder))


def op8_main_text(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return html_text.main_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op9_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    table, held_out = documents(spark, folder), remainder("doc_id", 7) == 2
    scored = lm_scoring.train_and_score(table, held_out, order=3)
    return scored.select("doc_id", held_out.alias("held_out"), *(c for c in scored.columns if c != "doc_id"))


def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return token_counts.token_counts(documents(spark, folder))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return prefix_trie.trie(prefix_trie.rebuilt(spark.read.parquet(f"{folder}/conversations.parquet")))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return collocations.collocations(documents(spark, folder))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_chosen_path_join, op4_packing, op5_fingerprints, op6_mixing, op7_secret_scan, op8_main_text,
        op9_kneser_ney, op10_token_counts, op11_prefix_trie, op12_collocations, op13_decontamination,
    )
}
