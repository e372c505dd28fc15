"""Record identities, duplicates, conflicts, merging and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.catalog.tables import (
    LINES, LINES_SMALL, ORDERS, STEP_GROUPS_SQL, STEP_ROWS_SQL, STEP_SNAPSHOT_SQL, STEPS, fingerprint_sql,
    step_log, step_reference, table,
)
from obslab.functions.identity import feature_id, fingerprint, record_id
from obslab.operators import duplicates, gates, leakage
from obslab.operators.cleaning import normalise, only_confirmed
from obslab.operators.prepare import CONFIRMED, REFERENCE, prepare_dataset, source_rows, union_sources

_KEY = list(LINES.key)
_SMALL = list(LINES_SMALL.features)


def _small(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEY, *_SMALL, "l_returnflag", "l_extendedprice")


def record_ids(spark, sf_dir):
    rows = _small(spark, sf_dir)
    return rows.select(*_KEY, feature_id(LINES_SMALL).alias("feature_id"), record_id(LINES_SMALL).alias("record_id"))


def tampered_rows(spark, sf_dir):
    """Stored ids of lower-case rows; afterwards the quantity of the most taxed rows is changed."""
    stored = normalise(_positive(spark, sf_dir), _POSITIVE, "train").drop("errors").withColumns(
        {"feature_id": feature_id(_POSITIVE), "record_id": record_id(_POSITIVE)}
    )
    changed = stored.withColumn(
        "l_quantity", F.when(F.col("l_tax") == 0.08, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    )
    return gates.tampered_rows(changed, _POSITIVE).select(*_KEY, "feature_id", "record_id")


_POSITIVE = LINES_SMALL.with_features(numeric=("l_quantity", "l_extendedprice"))


def _positive(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEY, *_POSITIVE.features, "l_returnflag", "l_tax")


def dataset_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("record_id", record_id(ORDERS))
    return fingerprint(rows, "o_orderstatus")


def dedupe_first_wins(spark, sf_dir):
    return duplicates.dedupe_first_wins(_small(spark, sf_dir), LINES_SMALL, _KEY, ["l_extendedprice"])


def label_conflicts(spark, sf_dir):
    return duplicates.label_conflicts(_small(spark, sf_dir), LINES_SMALL, _KEY)


def duplicate_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    scopes = {"full_rows": rows.columns, "model_features": _SMALL, "numeric_features": list(LINES_SMALL.numeric)}
    parts = [duplicates.duplicate_summary(rows, c).withColumn("scope", F.lit(n)) for n, c in scopes.items()]
    return reduce(DataFrame.unionByName, parts)


def union_counts(spark, sf_dir):
    merged = union_sources(step_reference(spark, sf_dir), only_confirmed(step_log(spark, sf_dir), STEPS), STEPS)
    return merged.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


def _prepared(spark, sf_dir):
    return prepare_dataset(step_reference(spark, sf_dir), step_log(spark, sf_dir), STEPS, strict=False)


def training_snapshot(spark, sf_dir):
    return _prepared(spark, sf_dir).snapshot


def snapshot_conflicts(spark, sf_dir):
    return _prepared(spark, sf_dir).conflicts.select("price_step", "priority", "status", "source", "copies")


def dataset_report(spark, sf_dir):
    report = _prepared(spark, sf_dir).report
    text = lambda c: F.array_join(
        F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    ).alias(c)
    return report.select(
        "rows", "confirmed_count", "ignored_unconfirmed", "duplicates_removed", text("class_counts"),
        text("confirmed_class_counts"), "reference_fingerprint", F.array_join("warnings", ";").alias("warnings"),
    )


def holdout_exclusion(spark, sf_dir):
    """Line items whose feature combination does not occur among those shipped in the last year."""
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *_SMALL, "l_shipdate")
    held = rows.where(F.col("l_shipdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
    return leakage.exclude_holdout(rows, held, _SMALL, _KEY).select(*_KEY)


def split_overlap(spark, sf_dir):
    late = F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *_SMALL, "l_shipdate")
    return leakage.split_overlap(rows, ~late, late, _SMALL, _KEY)


def snapshot_diff(spark, sf_dir):
    """The snapshot against one prepared from the reference alone."""
    both = _prepared(spark, sf_dir).snapshot
    log = step_log(spark, sf_dir)
    alone = prepare_dataset(step_reference(spark, sf_dir), log.limit(0), STEPS, strict=False).snapshot
    return leakage.snapshot_diff(source_rows(both, REFERENCE), source_rows(alone, REFERENCE))


def manifest_diff(spark, sf_dir):
    """Confirmations of the current log against those of a log without the first priority."""
    reference, log = step_reference(spark, sf_dir), step_log(spark, sf_dir)
    earlier = log.where(F.col("priority") != "1-URGENT")
    ids = lambda part: source_rows(
        prepare_dataset(reference, part, STEPS, strict=False).snapshot, CONFIRMED
    ).select("record_id")
    current, previous = ids(log), ids(earlier)
    return leakage.manifest_diff(current, previous, candidate=previous)


QUERIES = {
    "record_ids": record_ids,
    "tampered_rows": tampered_rows,
    "dataset_fingerprint": dataset_fingerprint,
    "dedupe_first_wins": dedupe_first_wins,
    "label_conflicts": label_conflicts,
    "duplicate_summary": duplicate_summary,
    "union_sources": union_counts,
    "training_snapshot": training_snapshot,
    "snapshot_conflicts": snapshot_conflicts,
    "dataset_report": dataset_report,
    "holdout_exclusion": holdout_exclusion,
    "split_overlap": split_overlap,
    "snapshot_diff": snapshot_diff,
    "manifest_diff": manifest_diff,
}

_KEYS = ", ".join(_KEY)
_COLS = ", ".join(_SMALL)
_TEXT = "l_quantity::VARCHAR || ',' || l_discount::VARCHAR || ',' || l_tax::VARCHAR || ',\"' || l_linestatus || '\"'"
_CLEAN = "l_quantity::VARCHAR || ',' || l_extendedprice::VARCHAR || ',\"' || lower(l_linestatus) || '\"'"
_LINE_ROWS = f"SELECT *, row_number() OVER (PARTITION BY {_COLS} ORDER BY {_KEYS}) AS rn FROM lineitem"
_LINE_ENTRIES = f"""
  SELECT {_COLS}, l_returnflag, count(*) AS n, min(ROW({_KEYS})) AS place
  FROM lineitem GROUP BY {_COLS}, l_returnflag
"""


def _conflict_sql() -> str:
    def placed(entry, prefix):
        return ", ".join(f"struct_extract({entry}, {i}) AS {prefix}_{k}" for i, k in enumerate(_KEY, start=1))

    return f"""
      WITH e AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {_COLS}) AS k,
                        first_value(l_returnflag) OVER w AS first_label, first_value(place) OVER w AS first_place
                 FROM ({_LINE_ENTRIES}) WINDOW w AS (PARTITION BY {_COLS} ORDER BY place))
      SELECT {_COLS}, first_label, {placed('first_place', 'first')}, l_returnflag AS conflicting_label,
             {placed('place', 'conflicting')}, n AS conflicting_rows
      FROM e WHERE k > 1 AND rn > 1
    """


def _summary_sql(scope: str, columns: str) -> str:
    return f"""
      SELECT '{scope}' AS scope, CAST(sum(k) AS BIGINT) AS row_count, count(*) FILTER (k > 1) AS duplicate_groups,
             CAST(coalesce(sum(k) FILTER (k > 1), 0) AS BIGINT) AS rows_in_duplicate_groups,
             CAST(sum(k - 1) AS BIGINT) AS redundant_rows
      FROM (SELECT count(*) AS k FROM lineitem GROUP BY {columns})
    """


def _class_text(where: str = "TRUE") -> str:
    return " || ',' || ".join(f"'{c}=' || count(*) FILTER (status = '{c}' AND {where})" for c in STEPS.class_order)


_EARLIER_GROUPS = STEP_GROUPS_SQL.replace(
    f"({STEP_ROWS_SQL})", f"(SELECT * FROM ({STEP_ROWS_SQL}) WHERE source_rank = 0 OR priority <> '1-urgent')"
)
_REFERENCE_GROUPS = STEP_GROUPS_SQL.replace(
    f"({STEP_ROWS_SQL})", f"(SELECT * FROM ({STEP_ROWS_SQL}) WHERE source_rank = 0)"
)


def _ids(groups: str, source: str) -> str:
    return f"""SELECT price_step || '|' || priority || '|' || status AS id
               FROM ({groups}) WHERE NOT conflict AND source = '{source}'"""


SQL = {
    "record_ids": f"""
        SELECT {_KEYS}, sha256('[' || {_TEXT} || ']') AS feature_id,
               sha256('[' || {_TEXT} || ',"' || l_returnflag || '"]') AS record_id
        FROM lineitem
    """,
    "tampered_rows": f"""
        SELECT {_KEYS}, sha256('[' || {_CLEAN} || ']') AS feature_id,
               sha256('[' || {_CLEAN} || ',"' || l_returnflag || '"]') AS record_id
        FROM lineitem WHERE l_tax = 0.08
    """,
    "dataset_fingerprint": f"""
        WITH r AS (SELECT o_orderstatus, sha256('[' || o_totalprice::VARCHAR || ',"' || o_orderpriority || '","'
                                                || o_orderstatus || '"]') AS id FROM orders)
        SELECT o_orderstatus, count(*) AS n_ids, {fingerprint_sql('id')} AS fingerprint FROM r GROUP BY 1
    """,
    "dedupe_first_wins": f"""
        WITH g AS (SELECT {_COLS}, count(*) AS copies, min(l_returnflag) <> max(l_returnflag) AS conflict
                   FROM lineitem GROUP BY {_COLS})
        SELECT {_COLS}, f.l_returnflag, {", ".join("f." + k for k in _KEY)}, f.l_extendedprice, g.copies, g.conflict
        FROM g JOIN (SELECT * FROM ({_LINE_ROWS}) WHERE rn = 1) f USING ({_COLS})
    """,
    "label_conflicts": _conflict_sql(),
    "duplicate_summary": " UNION ALL ".join([
        _summary_sql("full_rows", "ALL"), _summary_sql("model_features", _COLS),
        _summary_sql("numeric_features", ", ".join(LINES_SMALL.numeric)),
    ]).replace("GROUP BY ALL", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,"
               " l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"),
    "union_sources": f"""
        SELECT CASE source_rank WHEN 0 THEN 'reference' ELSE 'confirmed' END AS source, status, count(*) AS n
        FROM ({STEP_ROWS_SQL}) GROUP BY 1, 2
    """,
    "training_snapshot": f"""
        SELECT o_orderkey, price_step, priority, status, source, feature_id, record_id FROM ({STEP_SNAPSHOT_SQL})
    """,
    "snapshot_conflicts": f"SELECT price_step, priority, status, source, copies FROM ({STEP_GROUPS_SQL}) WHERE conflict",
    "dataset_report": f"""
        WITH s AS ({STEP_SNAPSHOT_SQL}),
             u AS (SELECT count(*) AS n FROM orders
                   WHERE CAST(o_orderdate AS DATE) >= DATE '1999-01-01' AND o_orderpriority = '5-LOW')
        SELECT count(*) AS "rows", count(*) FILTER (source = 'confirmed') AS confirmed_count,
               (SELECT n FROM u) AS ignored_unconfirmed, CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
               {_class_text()} AS class_counts, {_class_text("source = 'confirmed'")} AS confirmed_class_counts,
               (SELECT {fingerprint_sql('record_id')} FROM s WHERE source = 'reference') AS reference_fingerprint,
               concat_ws(';', CASE WHEN sum(copies - 1) > 0
                              THEN CAST(sum(copies - 1) AS BIGINT) || ' duplicate observation(s) were used only once' END,
                         CASE WHEN count(*) FILTER (source = 'confirmed') > 0
                               AND count(DISTINCT status) FILTER (source = 'confirmed') < 3
                              THEN 'the confirmed observations do not cover every label' END) AS warnings
        FROM s
    """,
    "holdout_exclusion": f"""
        SELECT {_KEYS} FROM lineitem l WHERE NOT EXISTS (
            SELECT 1 FROM lineitem h WHERE h.l_shipdate >= TIMESTAMP '2001-06-01'
               AND {" AND ".join(f"h.{c} = l.{c}" for c in _SMALL)})
    """,
    "split_overlap": f"""
        WITH p AS (SELECT *, l_shipdate >= TIMESTAMP '2001-01-01' AS late FROM lineitem),
             t AS (SELECT count(*) FILTER (NOT late) AS l, count(*) FILTER (late) AS r FROM p GROUP BY {_COLS}),
             k AS (SELECT count(*) FILTER (NOT late) AS l, count(*) FILTER (late) AS r FROM p GROUP BY {_KEYS})
        SELECT 'shared_feature_combinations' AS measure, count(*) FILTER (l > 0 AND r > 0) AS n FROM t
        UNION ALL SELECT 'left_rows_with_match', CAST(coalesce(sum(l) FILTER (r > 0), 0) AS BIGINT) FROM t
        UNION ALL SELECT 'right_rows_with_match', CAST(coalesce(sum(r) FILTER (l > 0), 0) AS BIGINT) FROM t
        UNION ALL SELECT 'shared_rows', count(*) FILTER (l > 0 AND r > 0) FROM k
    """,
    "snapshot_diff": f"""
        WITH a AS ({_ids(STEP_GROUPS_SQL, 'reference')}), b AS ({_ids(_REFERENCE_GROUPS, 'reference')})
        SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS ids_in_both,
               count(*) FILTER (b.id IS NULL) AS ids_only_in_a, count(*) FILTER (a.id IS NULL) AS ids_only_in_b,
               count(*) FILTER (a.id IS NULL OR b.id IS NULL) = 0 AS same_ids
        FROM a FULL JOIN b ON a.id = b.id
    """,
    "manifest_diff": f"""
        WITH c AS ({_ids(STEP_GROUPS_SQL, 'confirmed')}), p AS ({_ids(_EARLIER_GROUPS, 'confirmed')})
        SELECT count(*) FILTER (p.id IS NULL) AS new_confirmed, count(*) FILTER (c.id IS NULL) AS removed_confirmed,
               count(*) FILTER (p.id IS NULL OR c.id IS NULL) > 0 AS can_train,
               count(*) FILTER (c.id IS NULL) = 0 AS candidate_holds
        FROM c FULL JOIN p ON c.id = p.id
    """,
}
