"""Merging a reference table with confirmed observations into one training set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.functions.identity import feature_id, fingerprint_parts, fingerprint_text, record_id
from obslab.operators.cleaning import clean, is_unconfirmed, normalise, only_confirmed, split_valid
from obslab.operators.duplicates import group_identities
from obslab.session import ensure_checkpoint_dir
from obslab.spec import DatasetSpec

REFERENCE, CONFIRMED = "reference", "confirmed"


@dataclass(frozen=True)
class Prepared:
    """Lazy results of one preparation; every member is a DataFrame."""

    snapshot: DataFrame
    report: DataFrame
    conflicts: DataFrame
    quarantine: DataFrame


def union_sources(reference: DataFrame, confirmed: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Both tables under one schema, tagged with their source; reference rows rank first.

    Measures become text so that a log read as text and a typed reference meet
    in the same tolerant parser.
    """
    def tagged(df: DataFrame, source: str, rank: int) -> DataFrame:
        return df.select(
            *spec.key,
            spec.label,
            *(F.col(c).cast("string").alias(c) for c in spec.features),
            F.lit(source).alias("source"),
            F.lit(rank).alias("source_rank"),
        )

    return tagged(reference, REFERENCE, 0).unionByName(tagged(confirmed, CONFIRMED, 1))


def prepare_dataset(
    reference: DataFrame, log: DataFrame, spec: DatasetSpec, strict: bool = True, materialise: bool = False
) -> Prepared:
    """Clean, validate, merge and de-duplicate by feature identity.

    The first row of a feature combination wins: reference before log, then row
    key. In strict mode invalid rows or contradicting labels stop the job before
    anything is returned; otherwise they are left out of the snapshot and kept
    in the quarantine and the conflict table. ``materialise`` checkpoints the
    grouped rows, so that snapshot, conflicts and report read one stored result.
    """
    if not spec.key:
        raise ValueError("the spec needs a row key, which orders the copies of a row")
    rows = union_sources(clean(reference, spec), only_confirmed(log, spec), spec)
    good, quarantine = split_valid(normalise(rows, spec, "train"))
    order = ["source_rank", *spec.key]
    groups = group_identities(good, spec, order, ["source"])
    if materialise:
        ensure_checkpoint_dir(groups.sparkSession)
        groups = groups.checkpoint()
    conflicts = groups.where("conflict").drop("conflict")
    if strict:
        _refuse(quarantine, conflicts, spec)
    kept = groups.where(~F.col("conflict"))
    identified = kept.withColumns({"feature_id": feature_id(spec), "record_id": record_id(spec)})
    snapshot = identified.select(*spec.key, *spec.features, spec.label, "source", "feature_id", "record_id")
    unconfirmed = log.agg(F.count_if(is_unconfirmed(spec)).alias("ignored_unconfirmed"))
    return Prepared(snapshot, dataset_report(identified, unconfirmed, spec), conflicts, quarantine)


def _refuse(quarantine: DataFrame, conflicts: DataFrame, spec: DatasetSpec) -> None:
    place = lambda row: f"{row['source']} row {[row[k] for k in spec.key]}"
    broken = quarantine.take(1)
    if broken:
        raise ValueError(f"{place(broken[0])}: {broken[0]['errors'][0]}")
    clash = conflicts.take(1)
    if clash:
        raise ValueError(f"{place(clash[0])}: contradicting labels for the same features")


def dataset_report(identified: DataFrame, unconfirmed: DataFrame, spec: DatasetSpec) -> DataFrame:
    """One row: counts, class counts, fingerprint of the reference ids, warnings.

    ``identified`` has one row per feature combination with its ``copies``; the
    whole report is a single combining aggregate over it.
    """
    is_confirmed = F.col("source") == CONFIRMED
    per_class = lambda rule: [F.count_if((F.col(spec.label) == F.lit(v)) & rule) for v in spec.class_order]
    totals = identified.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_confirmed).alias("confirmed_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        F.array(*per_class(F.lit(True))).alias("class_n"),
        F.array(*per_class(is_confirmed)).alias("confirmed_n"),
        *fingerprint_parts(F.col("record_id"), ~is_confirmed),
    )
    names = F.array(*[F.lit(v) for v in spec.class_order])
    covered = F.size(F.filter("confirmed_n", lambda n: n > 0))
    warnings = F.array_compact(F.array(
        F.when(F.col("duplicates_removed") > 0, F.concat(
            F.col("duplicates_removed").cast("string"), F.lit(" duplicate observation(s) were used only once"))),
        F.when((F.col("confirmed_count") > 0) & (covered < len(spec.class_order)), F.lit(
            "the confirmed observations do not cover every label")),
    ))
    return totals.select(
        "rows",
        "confirmed_count",
        unconfirmed.scalar().alias("ignored_unconfirmed"),
        "duplicates_removed",
        F.map_from_arrays(names, F.col("class_n")).alias("class_counts"),
        F.map_from_arrays(names, F.col("confirmed_n")).alias("confirmed_class_counts"),
        fingerprint_text().alias("reference_fingerprint"),
        warnings.alias("warnings"),
    )


def source_rows(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("source") == source)


