"""Every numbered query over the smallest tables: columns, and one row for each document, page or piece."""

import pathlib

import pytest
from pyspark.sql import functions as F

from obslab.llm.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 2: "doc_id held_out lang_pred score", 3: "doc_id class_id n_links",
    4: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 5: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    6: "doc_id size source_size target taken", 7: "doc_id n_assign n_access n_hex base_sha256 spans", 8: "page_id url text n_chars",
    9: "doc_id held_out n_tokens n_known train_tokens base_score score", 10: "doc_id n_bytes n_tokens over_limit",
    11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", 12: "lang rank phrase a l r n score",
    13: "doc_id n_words n_hit n_items items_sha256 contaminated",
}
TABLES = {8: "pages", 11: "conversations"}

pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(shipped, name):
    number = int(name[2:].split("_")[0])
    out = QUERIES[name](shipped, DATA)
    assert out.columns == COLUMNS[number].split()
    table = shipped.read.parquet(f"{DATA}/{TABLES.get(number, 'documents')}.parquet")
    if number in (11, 12):
        assert out.count() > 0
        return
    key = table.columns[0]
    assert out.select(key).distinct().count() == table.count()
    if number != 4:
        assert out.count() == table.count()


def test_held_out_languages(shipped):
    found = QUERIES["op2_language_id"](shipped, DATA).where("held_out").join(shipped.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


def test_statements_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
