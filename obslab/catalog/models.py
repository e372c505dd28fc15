"""Features, classifiers, studies and releases.

Forests have the operator's own number of trees. ``batch_score`` and
``cv_metrics`` learn from all of their training rows. Any other fit of this module learns from
``FIT_ROWS`` labelled rows (studies, which fit dozens of times, from
``STUDY_ROWS``), chosen by a hash of their key; every query scores and evaluates
whole tables. The learning curve cuts its fractions out of ``CURVE_ROWS`` rows of
each fold and reports the rows fitted; candidate and baseline fit all of theirs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from obslab.catalog.tables import (
    EMBEDDINGS, LINES, ORDERS, STEPS, embeddings_wide, step_log, step_reference, table,
)
from obslab.functions.display import half_even
from obslab.operators import features, forest_bins, gates, models, profile
from obslab.operators.models import Variant, fit, ranked_probabilities, score
from obslab.operators.prepare import REFERENCE, prepare_dataset, source_rows
from obslab.operators.ranges import collect_ranges
from obslab.operators.splits import stratified_split
from obslab.plans import retraining, study
from obslab.session import shared_dir
from obslab.sources.snapshots import SnapshotStore

FIT_ROWS, STUDY_ROWS, CURVE_ROWS = 2000, 400, 1000
FOREST = Variant("forest", fit_rows=FIT_ROWS)
WHOLE = Variant("forest")
_KEY = list(LINES.key)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_KEY, "l_returnflag", *LINES.features)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", *ORDERS.features)


def _line_split(spark, sf_dir):
    # Fits, ranges and scoring read the split many times: written once, it does not hash every row again each time.
    path = shared_dir(spark, "line-split")
    stratified_split(_lines(spark, sf_dir), LINES).write.parquet(path)
    rows = spark.read.parquet(path)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


def _fitted(spark, sf_dir, variant=FOREST):
    train, test = _line_split(spark, sf_dir)
    return replace(fit(train, LINES, variant), version="v1"), test


def standardised_features(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    scaled = features.standardise(rows, LINES.numeric, features.fit_scaling(rows, LINES.numeric))
    return scaled.select(*_KEY, *[half_even(F.col(f"{c}_std"), 6).alias(f"{c}_std") for c in LINES.numeric])


def onehot_features(spark, sf_dir):
    """Priorities learnt without one of them, which then meets an encoder that never saw it."""
    rows = _orders(spark, sf_dir)
    seen = rows.where(F.col("o_orderpriority") != "4-NOT SPECIFIED")
    model = features.fit_features(seen, ORDERS)
    return features.onehot_table(model, rows, ORDERS, ["o_orderkey"])


def _components(spark, sf_dir):
    train = stratified_split(embeddings_wide(spark, sf_dir), EMBEDDINGS).where("split = 'train'").drop("split")
    return train, features.fit_pca(train, EMBEDDINGS.numeric, 4)


def pca_variance(spark, sf_dir):
    return features.pca_report(*_components(spark, sf_dir))


def pca_scores(spark, sf_dir):
    train, components = _components(spark, sf_dir)
    return features.pca_scores(train, components, ["vec_id", "label"])


def rf_predictions(spark, sf_dir):
    model, test = _fitted(spark, sf_dir)
    return forest_bins.predict(model, test).select(*_KEY, "l_returnflag", "predicted_l_returnflag")


def lr_predictions(spark, sf_dir):
    model, test = _fitted(spark, sf_dir, Variant("logistic", kind="logistic"))
    return model.predict(test).select(*_KEY, "l_returnflag", "predicted_l_returnflag")


_SERVED = replace(LINES, categories={"l_linestatus": ("F", "O", "unknown")})


def _scored(spark, sf_dir, variant=FOREST):
    train, test = _line_split(spark, sf_dir)
    ranges = collect_ranges(profile.feature_ranges(train, LINES))
    model = replace(fit(train, LINES, variant), version="v1", ranges=ranges, spec=_SERVED)
    return score(test, model)


def batch_score(spark, sf_dir):
    scored, refused = _scored(spark, sf_dir, WHOLE)
    kept = [*_KEY, "model_version"]
    done = scored.select(*kept, F.col("predicted_l_returnflag"), F.size("warnings").alias("n_warnings"))
    broken = refused.select(
        *_KEY, F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("string").alias("predicted_l_returnflag"), F.size("errors").alias("n_warnings"),
    )
    return done.unionByName(broken)


def ranked(spark, sf_dir):
    scored, _ = _scored(spark, sf_dir)
    return ranked_probabilities(scored, _KEY)


def probability_gate(spark, sf_dir):
    """The hold-out's own probabilities, and the same with those of some flags spoilt in four ways."""
    model, test = _fitted(spark, sf_dir)
    scored = forest_bins.predict(model, test).select(*_KEY, "probabilities")
    first, nan = LINES.class_order[0], F.lit(float("nan"))
    spoilt = lambda change: F.map_from_entries(F.transform(F.map_entries("probabilities"), lambda e: F.struct(
        e["key"].alias("key"), F.when(e["key"] == first, change(e["value"])).otherwise(e["value"]).alias("value"))))
    # One way for each of the first four line numbers: not a number, below zero, a sum beside one, a class that is missing.
    broken = table(spark, sf_dir, "lineitem").select(*_KEY).withColumn("probabilities", F.map_from_arrays(
        F.array(*map(F.lit, LINES.class_order)), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25))))
    broken = broken.withColumn("probabilities", F.when(F.col("l_linenumber") == 1, spoilt(lambda v: nan)).when(
        F.col("l_linenumber") == 2, spoilt(lambda v: -v)).when(F.col("l_linenumber") == 3, spoilt(lambda v: v + 0.01)).when(
        F.col("l_linenumber") == 4, F.map_filter("probabilities", lambda k, v: k != first)).otherwise(F.col("probabilities")))
    counted = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("measure"), "n")
    parts = {"scored": scored, "violations": gates.probability_violations(scored, LINES.labels)}
    found = gates.probability_violations(broken, LINES.labels)
    whole = counted(parts["scored"], "scored").unionByName(counted(parts["violations"], "violations"))
    by_line = found.groupBy(F.concat(F.lit("spoilt in line "), F.col("l_linenumber").cast("string")).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return whole.unionByName(by_line)


def forest_size(spark, sf_dir):
    model, _ = _fitted(spark, sf_dir)
    sizes = models.forest_size(model)
    return spark.createDataFrame(list(sizes.items()), "measure string, mean double")


def release_check(spark, sf_dir):
    model, test = _fitted(spark, sf_dir)
    medians = {r["feature"]: r["median"] for r in profile.feature_ranges(test, LINES).collect()}
    return retraining.release_check(model, test, medians)


def cv_metrics(spark, sf_dir):
    folded = study.with_folds(_lines(spark, sf_dir), LINES)
    return study.cross_validate(folded, LINES, [WHOLE]).drop("fit_seconds")


def grid_study(spark, sf_dir):
    grid = [replace(v, fit_rows=STUDY_ROWS) for v in study.GRID]
    return study.grid_study(study.with_folds(_orders(spark, sf_dir), ORDERS), ORDERS, grid)


def learning_curve(spark, sf_dir):
    folded = study.with_folds(_orders(spark, sf_dir), ORDERS)
    return study.learning_curve(folded, ORDERS, replace(study.GRID[0], fit_rows=CURVE_ROWS))


def permutation_importance(spark, sf_dir):
    train, test = _line_split(spark, sf_dir)
    return study.permutation_importance(fit(train, LINES, FOREST), test)


def ablation(spark, sf_dir):
    """The order value with and without the priority."""
    rows = study.protocol(_orders(spark, sf_dir), ORDERS)
    without = Variant("without_priority", fit_rows=STUDY_ROWS, categorical=())
    return study.ablation(rows, ORDERS, [Variant("with_priority", fit_rows=STUDY_ROWS), without])


def family_comparison(spark, sf_dir):
    families = [replace(v, fit_rows=STUDY_ROWS) for v in study.FAMILIES]
    folded = study.with_folds(_orders(spark, sf_dir), ORDERS)
    return study.family_comparison(folded, ORDERS, families).drop("fit_seconds_mean", "fit_seconds_std")


def candidate_vs_baseline(spark, sf_dir):
    """The merged training set against the reference alone, on the same hold-out."""
    sources = step_reference(spark, sf_dir, finer=True), step_log(spark, sf_dir, finer=True)
    prepared = prepare_dataset(*sources, STEPS, strict=False)
    store = SnapshotStore(spark, shared_dir(spark, "comparison"))
    snapshot = store.load(store.save(prepared.snapshot, STEPS))
    result = retraining.candidate_vs_baseline(
        snapshot, source_rows(snapshot, REFERENCE), STEPS, Variant("forest"), Variant("baseline", depth=None),
    )
    return result.metrics


QUERIES = {
    "standardised_features": standardised_features,
    "onehot_features": onehot_features,
    "pca_variance": pca_variance,
    "pca_scores": pca_scores,
    "rf_predictions": rf_predictions,
    "lr_predictions": lr_predictions,
    "batch_score": batch_score,
    "ranked_probabilities": ranked,
    "probability_gate": probability_gate,
    "forest_size": forest_size,
    "release_check": release_check,
    "cv_metrics": cv_metrics,
    "grid_study": grid_study,
    "learning_curve": learning_curve,
    "permutation_importance": permutation_importance,
    "ablation": ablation,
    "family_comparison": family_comparison,
    "candidate_vs_baseline": candidate_vs_baseline,
}

_STD = ", ".join(f"round_even(({c} - m_{c}) / s_{c}, 6) AS {c}_std" for c in LINES.numeric)
_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINES.numeric)

SQL = {
    "release_check": """
        SELECT unnest(['predicted_label_is_allowed', 'probabilities_are_proper']) AS rule, 0::BIGINT AS violations, true AS passed
    """,
    # The hold-out takes a quarter of the rows, rounded up, and every row must be a distribution.
    "probability_gate": """
        SELECT 'scored' AS measure, CAST(ceil(count(*) * 0.25) AS BIGINT) AS n FROM lineitem
        UNION ALL SELECT 'violations', 0
        UNION ALL SELECT 'spoilt in line ' || l_linenumber, count(*) FROM lineitem WHERE l_linenumber <= 4 GROUP BY l_linenumber
    """,
    "standardised_features": f"""
        SELECT {", ".join(_KEY)}, {_STD} FROM lineitem, (SELECT {_STATS} FROM lineitem)
    """,
    "onehot_features": """
        SELECT o_orderkey, o_totalprice,
               CAST(o_orderpriority = '1-URGENT' AS INTEGER)::DOUBLE AS "o_orderpriority_1-URGENT",
               CAST(o_orderpriority = '2-HIGH' AS INTEGER)::DOUBLE AS "o_orderpriority_2-HIGH",
               CAST(o_orderpriority = '3-MEDIUM' AS INTEGER)::DOUBLE AS "o_orderpriority_3-MEDIUM",
               CAST(o_orderpriority = '5-LOW' AS INTEGER)::DOUBLE AS "o_orderpriority_5-LOW"
        FROM orders
    """,
}
