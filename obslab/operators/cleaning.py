"""Cleaning, per-path normalisation and row-level rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.functions.text import MISSING_WORDS, is_finite, is_measure, parse_stripped, strip
from obslab.spec import DatasetSpec

MODES = ("train", "serve", "audit")
ERRORS = "errors"
_RAW, _TEXT = "_raw_", "_text_"


def clean(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Role columns of the rows that have every measure; missing categories stay."""
    return df.select(*spec.role_columns, *(k for k in spec.key if k not in spec.role_columns)).dropna(
        how="any", subset=list(spec.numeric)
    )


def rows_with_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.filter(reduce(or_, [F.col(c).isNull() for c in columns or df.columns]))


def fill_categories(df: DataFrame, spec: DatasetSpec, value: str | None = None) -> DataFrame:
    return df.fillna(value or spec.fill, subset=list(spec.categorical))


def only_confirmed(log: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Log rows with an independently confirmed label, which becomes the label.

    Rows without one are left out before any rule looks at them, so a broken
    measure in an unconfirmed row is no error. Predictions are never labels.
    """
    named = strip(F.col(spec.confirmed))
    rest = [c for c in log.columns if c not in (spec.label, spec.confirmed)]
    return log.filter(F.coalesce(named, F.lit("")) != "").select(*rest, named.alias(spec.label))


def is_unconfirmed(spec: DatasetSpec) -> Column:
    return F.coalesce(strip(F.col(spec.confirmed)), F.lit("")) == ""


def attach_labels(log: DataFrame, labels: DataFrame, on: list[str], spec: DatasetSpec) -> DataFrame:
    """Log with separately delivered confirmations; rows without one keep null.

    Confirmations of a key that agree count as one. Where they contradict each
    other the rows stay unconfirmed: ``contradicting_labels`` lists those keys.
    """
    return log.join(_label_range(labels, on, spec).select(*on, F.when(
        F.col("_low") == F.col("_high"), F.col("_low")).alias(spec.confirmed)), on, "left")


def contradicting_labels(labels: DataFrame, on: list[str], spec: DatasetSpec) -> DataFrame:
    """Keys confirmed with more than one label, with the least and the greatest."""
    return _label_range(labels, on, spec).where("_low != _high").select(
        *on, F.col("_low").alias("first_label"), F.col("_high").alias("last_label"))


def _label_range(labels: DataFrame, on: list[str], spec: DatasetSpec) -> DataFrame:
    label = F.col(spec.label).cast("string")
    return labels.groupBy(*on).agg(F.min(label).alias("_low"), F.max(label).alias("_high"))


def normalise(df: DataFrame, spec: DatasetSpec, mode: str) -> DataFrame:
    """Cleaned feature columns plus an ``errors`` array of ``column:rule`` codes.

    ``train``  categories are trimmed and lower-cased, missing spellings become
               the fill value; label and category must be allowed.
    ``serve``  only null or empty categories are filled, nothing is re-spelled;
               each way a measure can be wrong has its own code.
    ``audit``  categories as in ``train`` but without the missing words and
               without an allowed list; measures are cast only.

    The first code is the one a row-by-row check would stop at.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    # Step by step, so that every text is trimmed and every number parsed only once per row.
    texts = [c for c in spec.numeric if df.schema[c].dataType.typeName() == "string"]
    raw = df.withColumns({
        **{_RAW + c: F.col(c).cast("string") for c in spec.features},
        **{_TEXT + c: strip(F.col(c).cast("string")) for c in (*texts, *spec.categorical)},
    })
    cleaned = raw.withColumns({
        **{c: parse_stripped(F.col(_TEXT + c)) if c in texts else F.col(c).cast("double") for c in spec.numeric},
        **{c: _category(F.col(_RAW + c), F.col(_TEXT + c), spec.fill, mode) for c in spec.categorical},
    })
    codes: list[Column] = []
    if mode == "train" and spec.label in df.columns:
        codes.append(_unless(_allowed(F.col(spec.label), spec.labels), f"{spec.label}:unknown_label"))
    if mode != "audit":
        codes += [_number_code(c, mode) for c in spec.numeric]
        codes += [
            _unless(_allowed(F.col(c), spec.categories[c]), f"{c}:unknown_category")
            for c in spec.categorical
            if c in spec.categories
        ]
    errors = F.array_compact(F.array(*codes)) if codes else F.array().cast("array<string>")
    return cleaned.select(*df.columns, errors.alias(ERRORS))


def _category(raw: Column, text: Column, fill: str, mode: str) -> Column:
    if mode == "serve":
        return F.coalesce(F.nullif(raw, F.lit("")), F.lit(fill))
    missing = MISSING_WORDS if mode == "train" else ("",)
    return F.when(raw.isNull() | F.lower(text).isin(*missing), F.lit(fill)).otherwise(F.lower(text))


def _number_code(name: str, mode: str) -> Column:
    value, raw = F.col(name), F.col(_RAW + name)
    if mode == "train":
        return _unless(is_measure(value), f"{name}:invalid_number")
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(f"{name}:missing"))
        .when(value.isNull(), F.lit(f"{name}:not_a_number"))
        .when(~is_finite(value), F.lit(f"{name}:not_finite"))
        .when(value <= 0, F.lit(f"{name}:not_positive"))
    )


def _allowed(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False))


def _unless(rule: Column, code: str) -> Column:
    return F.when(~rule, F.lit(code))


def split_valid(normalised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)``: the quarantine keeps the codes, the good rows need none."""
    clean_row = F.size(ERRORS) == 0
    return normalised.filter(clean_row).drop(ERRORS), normalised.filter(~clean_row)


def validate(df: DataFrame, spec: DatasetSpec, mode: str = "train") -> tuple[DataFrame, DataFrame]:
    return split_valid(normalise(df, spec, mode))


def domain_violations(df: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows outside the allowed values, one output row per offending column."""
    named = [
        F.when(
            ~_allowed(F.col(c), values),
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("found")),
        )
        for c, values in domains.items()
    ]
    return df.withColumn("violation", F.explode(F.array_compact(F.array(*named)))).select(
        *df.columns, F.col("violation.column").alias("violated_column"), F.col("violation.found").alias("found")
    )


def scatter_frame(
    df: DataFrame, spec: DatasetSpec, x: str, y: str, new: DataFrame | None = None, fractions: dict | None = None
) -> DataFrame:
    """Two measures with label, context and filled categories; new rows carry their own role.

    ``fractions`` thins large tables by label for drawing (a sampling option,
    off by default).
    """
    for axis in (x, y):
        if axis not in spec.numeric:
            raise ValueError(f"not a numeric feature: {axis}")
    shown = fill_categories(df, spec)
    if fractions:
        shown = shown.sampleBy(spec.label, fractions, seed=42)
    columns = [
        F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        F.col(spec.label), *spec.context, *spec.categorical,
    ]
    points = shown.select(F.lit("reference").alias("role"), *columns)
    if new is None:
        return points
    absent = [axis for axis in (x, y) if axis not in new.columns]
    if absent:
        raise ValueError(f"new observations lack: {absent}")
    added = new.select(
        F.lit("new").alias("role"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
        *(F.col(c) for c in (spec.label, *spec.context, *spec.categorical) if c in new.columns),
    )
    return points.unionByName(added, allowMissingColumns=True)
