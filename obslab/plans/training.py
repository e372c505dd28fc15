"""The base training job: protocol, cross-validation, hold-out report, deployment model."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.operators.metrics import (
    classification_metrics, classification_report, confusion_cube, confusion_matrix, fold_summary,
)
from obslab.operators.models import FittedModel, Variant, fit
from obslab.operators.profile import feature_ranges
from obslab.operators.ranges import collect_ranges
from obslab.operators.splits import FOLDS, SEED
from obslab.plans.study import cross_validate, kept, permutation_importance, place, protocol
from obslab.spec import DatasetSpec


@dataclass(frozen=True)
class TrainingResult:
    """Small result tables and the model fitted on all rows."""

    sizes: DataFrame
    metrics: DataFrame
    matrix: DataFrame
    report: DataFrame
    cross_validation: DataFrame
    importance: DataFrame
    deployment: FittedModel


def train(
    data: DataFrame, spec: DatasetSpec, variant: Variant = Variant("forest"), seed: int = SEED, folds: int = FOLDS,
    repeats: int = 30,
) -> TrainingResult:
    """Evaluate on a stratified hold-out, then fit the model to be delivered on every row."""
    spark = data.sparkSession
    with kept(place(protocol(data, spec, seed, folds), spec)) as rows:
        training, held = rows.where("split = 'train'"), rows.where("split = 'test'")
        scores = cross_validate(training, spec, [variant], folds)
        model = fit(training, spec, variant, placed=True)
        counted = confusion_cube(model.predict(held), spec.label, f"predicted_{spec.label}").collect()
        importance = permutation_importance(model, held, repeats, seed)
        sizes = spark.createDataFrame(rows.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect())
        ranges = collect_ranges(feature_ranges(rows, spec))
        deployment = replace(fit(rows, spec, variant, placed=True), ranges=ranges)
    cube = spark.createDataFrame(counted, "actual string, predicted string, n bigint")
    measures = ("validation_accuracy", "validation_macro_f1", "validation_cohen_kappa")
    return TrainingResult(
        sizes, classification_metrics(cube), confusion_matrix(cube, spec.class_order),
        classification_report(cube, spec.class_order), fold_summary(scores, ["variant"], measures), importance, deployment,
    )


def model_metadata(model: FittedModel, ranges: DataFrame) -> DataFrame:
    """One-row document describing a model: roles, classes, allowed values, ranges, parameters."""
    spec, variant = model.spec, model.variant
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    entry = F.struct("feature", F.struct("minimum", "maximum", "median"))
    allowed = [F.struct(F.lit(c).alias("key"), texts(v).alias("value")) for c, v in spec.categories.items()]
    # One range per numeric feature of the spec.
    return ranges.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("feature_ranges")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at_utc"),
        F.lit(spec.label).alias("target"),
        texts(spec.features).alias("features"),
        texts(spec.numeric).alias("numeric_features"),
        texts(spec.categorical).alias("categorical_features"),
        texts(spec.class_order).alias("classes"),
        "feature_ranges",
        (F.map_from_entries(F.array(*allowed)) if allowed else F.lit(None).cast("map<string,array<string>>"))
        .alias("allowed_values"),
        F.struct(
            F.lit(variant.trees).alias("trees"), F.lit(variant.depth).cast("int").alias("depth"),
            F.lit(variant.min_leaf).alias("min_leaf"),
        ).alias("model_parameters"),
    )
