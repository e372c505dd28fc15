"""Normalisation, domain rules, gates, ranges and scatter frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from obslab.catalog.tables import (
    DOCS, EVENT_TYPES, EVENTS, LINES, ORDERS, PARTS, PARTS_SQL, RAW_EVENTS_SQL, STEP_SNAPSHOT_SQL, STEPS,
    document_labels, document_log, parts_with_gaps, raw_events, step_log, step_reference, table,
)
from obslab.functions.text import is_finite
from obslab.operators import gates, profile
from obslab.operators.cleaning import (
    attach_labels, domain_violations, is_unconfirmed, normalise, only_confirmed, scatter_frame,
)
from obslab.operators.prepare import prepare_dataset
from obslab.operators.ranges import collect_ranges, flag_ranges


def _normalised(mode):
    def run(spark, sf_dir):
        checked = normalise(raw_events(spark, sf_dir), EVENTS, mode)
        usable = F.when(is_finite(F.col("value")), F.col("value")).alias("value")
        return checked.select("event_id", usable, "event_type", F.array_join("errors", ",").alias("errors"))

    return run


def invalid_measures(spark, sf_dir):
    checked = normalise(raw_events(spark, sf_dir), EVENTS, "serve")
    return checked.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def domain_report(spark, sf_dir):
    domains = {"event_type": EVENT_TYPES, "grade": EVENTS.labels}
    broken = domain_violations(raw_events(spark, sf_dir), domains)
    return broken.groupBy("violated_column", "found").agg(F.count(F.lit(1)).alias("n"))


def snapshot_gate(spark, sf_dir):
    prepared = prepare_dataset(step_reference(spark, sf_dir), step_log(spark, sf_dir), STEPS, strict=False)
    return gates.snapshot_gate(prepared.snapshot, STEPS)


def range_gate(spark, sf_dir):
    ranges = profile.order_statistics(
        table(spark, sf_dir, "lineitem"), LINES.numeric, (0.5,), groups=("l_returnflag",)
    ).withColumnRenamed("q0", "median")
    return gates.range_violations(ranges).select("l_returnflag", "feature", "minimum", "median", "maximum")


def confirmed_only(spark, sf_dir):
    log = attach_labels(document_log(spark, sf_dir), document_labels(spark, sf_dir), ["doc_id"], DOCS)
    return only_confirmed(log, DOCS)


def confirmed_status(spark, sf_dir):
    log = attach_labels(document_log(spark, sf_dir), document_labels(spark, sf_dir), ["doc_id"], DOCS)
    blank = is_unconfirmed(DOCS)
    return log.groupBy("lang").agg(F.count_if(blank).alias("n_unconfirmed"), F.count_if(~blank).alias("n_confirmed"))


def range_flags(spark, sf_dir):
    """Orders scored against the price range of the urgent ones that are still open."""
    orders = table(spark, sf_dir, "orders")
    known = orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
    ranges = collect_ranges(profile.feature_ranges(known, ORDERS))
    flagged = flag_ranges(orders, ORDERS, ranges)
    return flagged.select(
        "o_orderkey", F.array_join("out_of_range", ",").alias("out_of_range"), F.array_join("warnings", ";").alias("warnings")
    )


def scatter(spark, sf_dir):
    rows = parts_with_gaps(spark, sf_dir)
    newest = rows.where(F.col("p_type").isNull()).select(
        F.col("p_size") * 2, F.col("p_retailprice") + 1, "p_brand"
    ).toDF("p_size", "p_retailprice", "p_brand")
    return scatter_frame(rows, PARTS, "p_size", "p_retailprice", newest)


QUERIES = {
    "normalise_train": _normalised("train"),
    "normalise_serve": _normalised("serve"),
    "normalise_audit": _normalised("audit"),
    "invalid_measures": invalid_measures,
    "domain_violations": domain_report,
    "snapshot_gate": snapshot_gate,
    "range_gate": range_gate,
    "confirmed_only": confirmed_only,
    "confirmed_status": confirmed_status,
    "range_flags": range_flags,
    "scatter_frame": scatter,
}

_TRIMMED = "trim({c}, chr(9) || chr(10) || chr(13) || ' ')"
_VALUE_TEXT = _TRIMMED.format(c="value")
# The usable numbers among the texts; DuckDB's own cast is looser about suffixes.
_NUMBER = f"""CASE WHEN regexp_matches({_VALUE_TEXT}, '^[+-]?[0-9_]+([.][0-9]*)?$')
              THEN TRY_CAST(replace({_VALUE_TEXT}, '_', '') AS DOUBLE) END"""
_LOWERED = f"lower({_TRIMMED.format(c='event_type')})"
_ALLOWED = "('click', 'error', 'purchase', 'signup', 'view', 'unknown')"
_EVENTS = f"SELECT event_id, value, {_NUMBER} AS number, event_type, {_LOWERED} AS word, grade FROM ({RAW_EVENTS_SQL})"
_SERVE_CODE = f"""
  CASE WHEN value IS NULL OR value = '' THEN 'value:missing'
       WHEN {_VALUE_TEXT} IN ('NaN', '-inf') THEN 'value:not_finite'
       WHEN number IS NULL THEN 'value:not_a_number'
       WHEN number <= 0 THEN 'value:not_positive' END
"""
_SERVE_EVENTS = f"""
  SELECT event_id, number AS value, coalesce(nullif(event_type, ''), 'unknown') AS event_type,
         {_SERVE_CODE} AS value_code,
         CASE WHEN coalesce(nullif(event_type, ''), 'unknown') NOT IN {_ALLOWED}
              THEN 'event_type:unknown_category' END AS type_code
  FROM ({_EVENTS})
"""

SQL = {
    "normalise_train": f"""
        SELECT event_id, number AS value, event_type,
               concat_ws(',', CASE WHEN grade NOT IN ('high', 'low', 'mid') THEN 'grade:unknown_label' END,
                              CASE WHEN number IS NULL OR number <= 0 THEN 'value:invalid_number' END,
                              CASE WHEN event_type NOT IN {_ALLOWED} THEN 'event_type:unknown_category' END) AS errors
        FROM (SELECT event_id, number, grade,
                     CASE WHEN event_type IS NULL OR word IN ('', 'na', 'nan', 'none', 'null')
                          THEN 'unknown' ELSE word END AS event_type
              FROM ({_EVENTS}))
    """,
    "normalise_serve": f"""
        SELECT event_id, value, event_type, concat_ws(',', value_code, type_code) AS errors FROM ({_SERVE_EVENTS})
    """,
    "normalise_audit": f"""
        SELECT event_id, number AS value,
               CASE WHEN event_type IS NULL OR word = '' THEN 'unknown' ELSE word END AS event_type, '' AS errors
        FROM ({_EVENTS})
    """,
    "invalid_measures": f"""
        SELECT code, count(*) AS n
        FROM (SELECT value_code AS code FROM ({_SERVE_EVENTS}) UNION ALL SELECT type_code FROM ({_SERVE_EVENTS}))
        WHERE code IS NOT NULL GROUP BY code
    """,
    "domain_violations": f"""
        SELECT violated_column, found, count(*) AS n
        FROM (SELECT 'event_type' AS violated_column, event_type AS found FROM ({RAW_EVENTS_SQL})
              WHERE coalesce(event_type NOT IN ('click', 'error', 'purchase', 'signup', 'view'), TRUE)
              UNION ALL
              SELECT 'grade', grade FROM ({RAW_EVENTS_SQL}) WHERE grade NOT IN ('high', 'low', 'mid'))
        GROUP BY 1, 2
    """,
    "snapshot_gate": f"""
        WITH s AS ({STEP_SNAPSHOT_SQL})
        SELECT rule, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed
        FROM (SELECT 'not_empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS violations FROM s
              UNION ALL SELECT 'price_step_is_measure', count(*) FILTER (NOT price_step > 0) FROM s
              UNION ALL SELECT 'priority_is_allowed', count(*) FILTER (priority NOT IN
                ('1-urgent', '2-high', '3-medium', '4-not specified', '5-low', 'unknown')) FROM s
              UNION ALL SELECT 'status_is_allowed', count(*) FILTER (status NOT IN ('F', 'O', 'P')) FROM s
              UNION ALL SELECT 'source_is_known', count(*) FILTER (source NOT IN ('reference', 'confirmed')) FROM s
              UNION ALL SELECT 'has_F', CASE WHEN count(*) FILTER (status = 'F') = 0 THEN 1 ELSE 0 END FROM s
              UNION ALL SELECT 'has_O', CASE WHEN count(*) FILTER (status = 'O') = 0 THEN 1 ELSE 0 END FROM s
              UNION ALL SELECT 'has_P', CASE WHEN count(*) FILTER (status = 'P') = 0 THEN 1 ELSE 0 END FROM s)
    """,
    "range_gate": " UNION ALL ".join(
        f"SELECT * FROM (SELECT l_returnflag, '{c}' AS feature, min({c}) AS minimum, median({c}) AS median,"
        f" max({c}) AS maximum FROM lineitem GROUP BY 1) WHERE NOT (minimum > 0 AND minimum <= median AND median <= maximum)"
        for c in LINES.numeric
    ),
    "confirmed_only": """
        SELECT doc_id, n_chars, lang, source, CAST(quality AS VARCHAR) AS quality
        FROM documents JOIN labels USING (doc_id)
    """,
    "confirmed_status": """
        SELECT lang, count(*) FILTER (quality IS NULL) AS n_unconfirmed, count(quality) AS n_confirmed
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
    """,
    "range_flags": """
        WITH r AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders
                   WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
        SELECT o_orderkey,
               CASE WHEN o_totalprice < low OR o_totalprice > high THEN 'o_totalprice' ELSE '' END AS out_of_range,
               CASE WHEN o_totalprice < low OR o_totalprice > high
                    THEN 'o_totalprice: value ' || replace(format('{:g}', o_totalprice), '.', ',')
                         || ' is outside the training range ' || replace(format('{:g}', low), '.', ',')
                         || ' to ' || replace(format('{:g}', high), '.', ',') ELSE '' END AS warnings
        FROM orders, r
    """,
    "scatter_frame": f"""
        SELECT 'reference' AS role, p_size AS x, p_retailprice AS y, p_brand, coalesce(p_type, 'unknown') AS p_type
        FROM ({PARTS_SQL})
        UNION ALL
        SELECT 'new', p_size * 2, p_retailprice + 1, p_brand, NULL FROM ({PARTS_SQL}) WHERE p_type IS NULL
    """,
}
