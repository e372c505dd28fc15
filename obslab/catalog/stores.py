"""Logs, files, snapshots and versions on storage."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from obslab.catalog.tables import EVENTS, ORDERS, STEP_SNAPSHOT_SQL, STEPS, step_log, step_reference, table
from obslab.functions.versions import RESERVED_NAMES, new_version_id, version_is_valid
from obslab.operators.metrics import classification_metrics, confusion_cube
from obslab.operators.models import Variant, fit
from obslab.operators.prepare import prepare_dataset
from obslab.operators.profile import feature_ranges
from obslab.operators.ranges import collect_ranges
from obslab.operators.versions import stale_candidates, version_state
from obslab.session import shared_dir
from obslab.sources.files import file_fingerprints
from obslab.sources.observation_log import CORRUPT, append_log, read_log
from obslab.sources.snapshots import SnapshotStore


#: Ids of one file of the text log.
LOG_FILE_ROWS = 1_000_000


def log_quarantine(spark, sf_dir):
    """Events written as a text log with broken records and quoted line breaks, then read strictly."""
    folder = shared_dir(spark, "text-log")
    case = F.col("event_id") % 12
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string"), "event_type", F.lit("mid"))
    raw = (
        F.when(case == 0, F.concat_ws(",", F.col("event_id").cast("string"), F.lit("1.5")))
        .when(case == 1, F.concat(line, F.lit(",extra")))
        .when(case == 2, F.concat(F.col("event_id").cast("string"), F.lit(',1.5,view,"open')))
        .when(case == 3, F.concat(F.col("event_id").cast("string"), F.lit(',1.5,"view\n""more""",mid')))
        .otherwise(line)
    )
    header = "event_id,value,event_type,validated_label"
    # A file for every so many ids, in their order, so that a record's line follows from the table.
    events = table(spark, sf_dir, "events").withColumn("file_no", F.expr(f"event_id div {LOG_FILE_ROWS}"))
    lines = events.select("file_no", "event_id", raw.alias("line"))
    heads = events.select("file_no").distinct().select("file_no", F.lit(None).cast("bigint").alias("event_id"), F.lit(header).alias("line"))
    ordered = heads.unionByName(lines).repartition("file_no").sortWithinPartitions("file_no", "event_id")
    ordered.select("file_no", "line").write.partitionBy("file_no").text(folder)
    rows, broken = read_log(spark, folder, EVENTS)
    good = rows.select(F.lit("good").alias("status"), F.concat_ws(",", *header.split(",")).alias("record"), F.lit(None).cast("bigint").alias("line"))
    return good.unionByName(broken.select(F.lit("quarantine").alias("status"), F.col(CORRUPT).alias("record"), "line"))


def fingerprints(spark, sf_dir):
    return file_fingerprints(spark, sf_dir, "*.parquet").select("file", "n_bytes", "sha256")


def observation_log(spark, sf_dir):
    """Orders scored by a price rule, appended to the log in two runs and read back."""
    folder = shared_dir(spark, "observation-log")
    price = F.col("o_totalprice")
    chance = F.least(price / 500000, F.lit(1.0))
    scored = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_totalprice", "o_orderpriority",
        F.when(price < 250000, "F").otherwise("O").alias("predicted_o_orderstatus"),
        F.create_map(
            F.lit("F"), 1 - chance, F.lit("O"), chance, F.lit("P"), F.lit(0.0)
        ).alias("probabilities"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).otherwise("").alias("validated_label"),
    )
    urgent = F.col("o_orderpriority") <= "2-HIGH"
    append_log(scored.where(urgent), ORDERS, folder)
    append_log(scored.where(~urgent), ORDERS, folder)
    return spark.read.parquet(folder).drop("timestamp_utc")


def snapshot_roundtrip(spark, sf_dir):
    """A snapshot staged, checked, published and loaded again, whatever contradictions have left of it.

    In a large table few rows or none may be left. Labels that have no row are a failure that the version's manifest and a warning
    name, and that keeps it from being adopted.
    """
    prepared = prepare_dataset(step_reference(spark, sf_dir), step_log(spark, sf_dir), STEPS, strict=False)
    store = SnapshotStore(spark, shared_dir(spark, "snapshots"))
    version = new_version_id()
    store.stage(prepared.snapshot, version)
    return store.load(store.publish(version, STEPS, partial=True))


def _held_spec(data, spec):
    """The spec with the labels of which contradictions have left a row: in a large table few or none may be left."""
    held = {r[0] for r in data.where(F.col(spec.label).isin(*spec.labels)).select(spec.label).distinct().collect()}
    return replace(spec, labels=tuple(c for c in spec.labels if c in held))


def served_version(spark, sf_dir):
    """A version trained on its whole snapshot, published, adopted, loaded again and used for scoring it.

    It knows the labels that the snapshot has; of a snapshot without a row no version is made, and nothing is scored.
    """
    prepared = prepare_dataset(step_reference(spark, sf_dir), step_log(spark, sf_dir), STEPS, strict=False)
    store = SnapshotStore(spark, shared_dir(spark, "served"))
    version = new_version_id()
    data = store.stage(prepared.snapshot, version)
    known = _held_spec(data, STEPS)
    if not known.labels:
        return data.select("o_orderkey", F.lit(True).alias("label_is_known"), F.lit(0).alias("n_warnings"), F.lit(True).alias("active"))
    spec = replace(known, key=("record_id",))
    ranges = collect_ranges(feature_ranges(data.withColumns({c: F.col(c).cast("double") for c in STEPS.numeric}), STEPS))
    model = replace(fit(data, spec, Variant("served")), ranges=ranges)
    cube = confusion_cube(model.predict(data), spec.label, f"predicted_{spec.label}")
    store.publish(version, known, metrics=classification_metrics(cube), model=model)
    store.activate(version)
    scored, refused = store.score(store.load(version).select("o_orderkey", *STEPS.features))
    allowed = F.col(f"predicted_{spec.label}").isin(*spec.labels)
    rows = scored.select("o_orderkey", allowed.alias("label_is_known"), F.size("warnings").alias("n_warnings"), (
        F.col("model_version") == version).alias("active"))
    return rows.unionByName(refused.select("o_orderkey", F.lit(False).alias("label_is_known"), F.size("errors").alias("n_warnings"), F.lit(False).alias("active")))


def _events(spark, sf_dir):
    """Every customer as a registry, every order as an event that adopts or returns."""
    newer = F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))
    older = F.concat(F.lit("v"), F.col("o_custkey").cast("string"))
    returned = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("registry"), F.col("o_orderkey").alias("seq"),
        F.when(returned, "roll_back").otherwise("adopt").alias("action"),
        F.when(returned, older).otherwise(newer).alias("active_version"),
        F.when(returned, newer).otherwise(older).alias("previous_version"),
    )


def state(spark, sf_dir):
    return version_state(_events(spark, sf_dir))


def stale(spark, sf_dir):
    """One candidate per customer, made from the version that carries the customer's number."""
    candidates = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("registry"), F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("base_version")
    )
    return stale_candidates(candidates, version_state(_events(spark, sf_dir)))


def version_id_check(spark, sf_dir):
    size = F.col("p_size").cast("string")
    ids = F.array(
        F.col("p_name"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")), F.concat(F.lit("lpt"), size),
        F.concat(F.lit("_"), size), F.repeat(F.lit("x"), F.col("p_size") + 60), F.concat(F.col("p_type"), F.lit("\n")),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(ids).alias("version_id"))
    return rows.withColumn("valid", version_is_valid(F.col("version_id")))


QUERIES = {
    "log_quarantine": log_quarantine,
    "file_fingerprints": fingerprints,
    "observation_log": observation_log,
    "snapshot_roundtrip": snapshot_roundtrip,
    "served_version": served_version,
    "version_state": state,
    "stale_candidates": stale,
    "version_id_check": version_id_check,
}

_EVENTS_SQL = """
  SELECT o_custkey AS registry, o_orderkey AS seq,
         CASE o_orderstatus WHEN 'P' THEN 'v' || o_custkey ELSE 'v' || o_orderkey END AS active_version,
         CASE o_orderstatus WHEN 'P' THEN 'v' || o_orderkey ELSE 'v' || o_custkey END AS previous_version
  FROM orders
"""
_STATE_SQL = f"""
  SELECT registry, arg_max(active_version, seq) AS active_version, arg_max(previous_version, seq) AS previous_version,
         max(seq) AS seq, count(*) AS n_events
  FROM ({_EVENTS_SQL}) GROUP BY registry
"""
_RESERVED = ", ".join(f"'{n}'" for n in RESERVED_NAMES)

SQL = {
    "log_quarantine": f"""
        SELECT CASE WHEN event_id % 12 <= 2 THEN 'quarantine' ELSE 'good' END AS status,
               CASE event_id % 12
                    WHEN 0 THEN event_id || ',1.5'
                    WHEN 1 THEN event_id || ',' || value || ',' || event_type || ',mid,extra'
                    WHEN 2 THEN event_id || ',1.5,view,"open'
                    WHEN 3 THEN event_id || ',1.5,view' || chr(10) || '"more",mid'
                    ELSE event_id || ',' || value || ',' || event_type || ',mid' END AS record,
               CASE WHEN event_id % 12 <= 2 THEN place END AS line
        FROM (SELECT *, 2 + coalesce(sum(CASE event_id % 12 WHEN 3 THEN 2 ELSE 1 END) OVER (
                  PARTITION BY event_id // {LOG_FILE_ROWS} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
              FROM events)
    """,
    "observation_log": """
        SELECT o_custkey, o_totalprice, o_orderpriority,
               CASE WHEN o_totalprice < 250000 THEN 'F' ELSE 'O' END AS predicted_o_orderstatus,
               1 - least(o_totalprice / 500000, 1.0::DOUBLE) AS probability_f,
               least(o_totalprice / 500000, 1.0::DOUBLE) AS probability_o,
               0.0::DOUBLE AS probability_p,
               CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS validated_label
        FROM orders
    """,
    "snapshot_roundtrip": f"""
        SELECT o_orderkey, price_step, priority, status, source, feature_id, record_id FROM ({STEP_SNAPSHOT_SQL})
    """,
    "served_version": f"""
        SELECT o_orderkey, true AS label_is_known, 0::INTEGER AS n_warnings, true AS active FROM ({STEP_SNAPSHOT_SQL})
    """,
    "version_state": _STATE_SQL,
    "stale_candidates": f"""
        SELECT registry, base_version, active_version, base_version <> active_version AS stale
        FROM (SELECT c_custkey AS registry, 'v' || c_custkey AS base_version,
                     coalesce(active_version, 'initial') AS active_version
              FROM customer LEFT JOIN ({_STATE_SQL}) s ON s.registry = c_custkey)
    """,
    "version_id_check": f"""
        SELECT p_partkey, version_id, regexp_full_match(version_id, '[A-Za-z0-9][A-Za-z0-9_-]{{0,95}}')
                                      AND upper(version_id) NOT IN ({_RESERVED}) AS valid
        FROM (SELECT p_partkey, unnest([p_name, replace(p_brand, '#', '_'), 'lpt' || p_size, '_' || p_size,
                                        repeat('x', p_size + 60), p_type || chr(10)]) AS version_id FROM part)
    """,
}
