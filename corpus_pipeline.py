"""From raw documents to packed training sequences, in five stages of the operators in ``obslab.llm``.

Every stage takes all that the one before kept, and its decisions take effect: rejected documents and failing lines go, one
document of each class of near copies stays, secrets are blanked, sources meet their weights, and what is left is packed.
All stages but the last return the columns of their input. Extra columns stay as they are, whatever their names; rows are
told apart by a hash of all their columns, so that nothing depends on how the input is cut into partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obslab.llm import mixing, near_join, packing, quality_rules, secret_scan
from obslab.llm.common import documents, ship, stored

#: Names for columns that live inside a stage only.
OWN, KEY, OTHER, COPIES = "_pipeline_own", "_pipeline_key", "_pipeline_other", "_pipeline_copies"
#: SQL cannot express these operators; tests compare the pipeline with a plain Python version.
ORACLE_SQL = None


def changed_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with another text, n_chars to match where the text differs."""
    counted = F.when(text.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(text))
    new = {"text": text.alias("text"), "n_chars": counted.cast("bigint").alias("n_chars")}
    return docs.select(*(new.get(c, F.col(f"`{c}`")) for c in docs.columns if c not in (OWN, KEY)))


def row_key(docs: DataFrame) -> Column:
    """doc_id and a hash of the whole row. Rows with the same key are the same row, once or more."""
    return F.struct(F.col("doc_id"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Empty and null texts are rejected."""
    judged = quality_rules.quality_rules(docs, into=KEY)
    # Exploding the verdict keeps Spark from working it out twice, once to filter and once to select.
    kept = F.filter(F.array(KEY), lambda verdict: verdict.kept)
    judged = judged.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(kept).alias(OWN))
    text = F.when(F.size(F.col(OWN).faults) == 0, F.col("text")).otherwise(F.col(OWN).clean_text)
    return changed_text(judged, text)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class; of repeated rows one. Null texts are classes of their own."""
    ship(spark)
    keyed = docs.withColumn(KEY, row_key(docs))
    classes = near_join.near_join(keyed, key=KEY)
    first = classes.where(F.col(KEY) == F.col("class_id")).select(KEY).distinct()
    kept = keyed.join(first.hint("shuffle_hash"), KEY, "left_semi")
    one = F.row_number().over(Window.partitionBy(KEY).orderBy(KEY))
    return kept.withColumn(OWN, one).where(F.col(OWN) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found replaced by a mark."""
    ship(spark)
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    found = secret_scan.scan(docs.select(rest.alias(KEY), "text"), key=KEY)
    clean = F.when(F.size("spans") > 0, secret_scan.redacted(F.col("_text"), F.col("spans"))).otherwise(F.col("_text"))
    told = found.select(*(F.col("_text").alias("text") if c == "text" else F.col(KEY).getField(c).alias(c) for c in docs.columns), clean.alias(OWN))
    return changed_text(told, F.col(OWN))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole copy: 0 to 3 times."""
    same = Window.partitionBy(KEY).orderBy(KEY)
    sized = stored(mixing.sized_documents(docs, row_key(docs).alias(KEY)), "mixing")
    taken = mixing.taken_words(mixing.mix(sized.drop(KEY)))
    copies = taken.select("row_no", F.round(F.try_divide("taken", "size")).cast("int").alias(COPIES))
    wanted = sized.select("row_no", KEY).join(copies, "row_no").withColumn(OTHER, F.struct(KEY, F.row_number().over(same).alias("n")))
    wanted = wanted.where(F.col(COPIES) > 0).select(OTHER, COPIES)
    numbered = docs.withColumn(KEY, row_key(docs)).withColumn(OWN, F.struct(KEY, F.row_number().over(same).alias("n")))
    again = numbered.join(wanted, F.col(OWN) == F.col(OTHER)).withColumn(OWN, F.explode(F.sequence(F.lit(1), F.col(COPIES))))
    return again.select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("secrets", secrets), ("mix", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
