import json
import math
import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from obslab.functions import display, identity, text, versions
from obslab.spec import DatasetSpec


def column(spark, values, kind, expression):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x"))).collect()]


def test_strip_removes_every_kind_of_blank(spark):
    values = ["  a b ", "\t\nx\r", " y ", "\x1cz\x1f", "", "   ", "　\u0085q"]
    assert column(spark, values, "string", text.strip) == [v.strip() for v in values]


NUMBERS = [
    "1", " 2.5 ", "-3", "+4.", ".5", "1e3", "1E-3", "1_000", "1_0.2_5", "18d", "18f", "0x1A", "", " ", "text", "NaN",
    "-nan", "inf", "-Infinity", "+INF", "1__0", "_1", "1_", "1e400", "\t7\n", "1,5", "--1", "1 2", ".", "e5", "٣",
]


def python_float(value):
    try:
        return float(value)
    except ValueError:
        return None


def test_numbers_parse_like_a_row_by_row_float(spark):
    got = column(spark, NUMBERS[:-1], "string", text.parse_number)
    for value, number in zip(NUMBERS, got):
        expected = python_float(value)
        both_nan = expected is not None and number is not None and math.isnan(expected) and math.isnan(number)
        assert both_nan or number == expected, (value, number, expected)


def test_canonical_number_is_the_shortest_decimal(spark):
    values = [1.0, 39.1, 3750.0, 0.0005, 0.00123, 1e7, 12345678.25, 9.5e15, 1234567.0, 0.001, 49.12345678901235, 22.0]
    assert column(spark, values, "double", identity.canonical_number) == [repr(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(1, 10**9).map(lambda n: n / 1000), min_size=20, max_size=20))
def test_canonical_number_on_three_decimals(spark, values):
    assert column(spark, values, "double", identity.canonical_number) == [repr(v) for v in values]


def test_ids_equal_hashes_of_compact_json(spark):
    spec = DatasetSpec(label="y", numeric=("a", "b"), categorical=("c",))
    rows = [(39.1, 3750.0, "male", "Adelie"), (18.0, 0.5, 'o"dd\\', "Gentoo")]
    frame = spark.createDataFrame(rows, "a double, b double, c string, y string")
    got = frame.select(identity.feature_id(spec), identity.record_id(spec)).collect()
    digest = lambda v: hashlib.sha256(json.dumps(v, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert [tuple(r) for r in got] == [(digest(list(r[:3])), digest(list(r))) for r in rows]


def test_fingerprint_ignores_order_and_partitions_but_not_copies(spark):
    ids = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("record_id"))
    value = lambda df: identity.fingerprint(df).first()["fingerprint"]
    assert value(ids) == value(ids.orderBy(F.desc("record_id")).repartition(7))
    assert value(ids) != value(ids.union(ids.limit(1)))
    assert value(ids.limit(0)) != value(ids)


def test_display_formats(spark):
    values = [0.5, 12.0, 1234.5, 0.0001234, 999999.4, 100.0, 0.1 + 0.2, 1e-5, 2.5e7, 0.0, 104958.5, 104957.5]
    expected = [format(v, "g").replace(".", ",") for v in values]
    assert column(spark, values, "double", display.general) == expected
    assert column(spark, [0.98765, 1.0], "double", lambda c: display.percent(c, 2)) == ["98,77 %", "100,00 %"]
    assert column(spark, [0.125, 0.375], "double", lambda c: display.half_even(c, 2)) == [0.12, 0.38]
    assert column(spark, [44.45, 17.25], "double", lambda c: display.half_up(c, 1)) == [44.5, 17.3]


def test_version_ids(spark):
    values = [versions.new_version_id(), "v1", "a_b-c", "", None, "-x", "../up", "com1", "CON", "x" * 96, "x" * 97, "v1\n"]
    expected = [True, True, True, False, False, False, False, False, False, True, False, False]
    assert column(spark, values, "string", versions.version_is_valid) == expected
    for value, good in zip(values, expected):
        try:
            versions.check_version_id(value)
            assert good
        except ValueError:
            assert not good


def test_ids_tell_where_a_value_is_missing(spark):
    spec = DatasetSpec(label="y", numeric=("a", "b"), labels=("p",))
    rows = spark.createDataFrame([(1.0, None, "p"), (None, 1.0, "p")], "a double, b double, y string")
    assert rows.select(identity.record_id(spec).alias("i")).distinct().count() == 2


def test_order_hash_tells_different_keys_apart(spark):
    rows = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a", None), (None, "a"), ("a\\", "b"), ("\\0", "a")], "x string, y string")
    assert rows.select(identity.order_hash(1, F.col("x"), F.col("y")).alias("h")).distinct().count() == 6
