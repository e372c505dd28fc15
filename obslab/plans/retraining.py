"""Comparing a candidate training set with the active one, and releasing it."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.operators import gates
from obslab.functions.versions import new_version_id
from obslab.operators.leakage import exclude_holdout, manifest_diff, snapshot_diff
from obslab.operators.metrics import classification_metrics, confusion_cube, confusion_matrix, fold_summary
from obslab.operators.models import FittedModel, Variant, fit
from obslab.operators.prepare import CONFIRMED, REFERENCE, Prepared, prepare_dataset, source_rows
from obslab.operators.profile import feature_ranges, min_class_gate
from obslab.operators.ranges import collect_ranges
from obslab.operators.release import release_check  # noqa: F401  (part of this job's interface)
from obslab.operators.splits import FOLDS, SEED, stratified_folds, stratified_split
from obslab.operators.versions import INITIAL
from obslab.plans.study import cross_validate, kept
from obslab.sources.snapshots import SnapshotStore
from obslab.spec import DatasetSpec

DEFAULT = Variant("candidate")


@dataclass(frozen=True)
class Comparison:
    """Metrics of both data states on one hold-out, and the model to be released."""

    metrics: DataFrame
    matrices: DataFrame
    cross_validation: DataFrame
    deployment: FittedModel


def reference_holdout(candidate: DataFrame, spec: DatasetSpec, seed: int = SEED) -> DataFrame:
    """Stratified hold-out of the reference rows, chosen by record id alone.

    Neither row order nor later confirmations change it.
    """
    reference = source_rows(candidate, REFERENCE)
    return stratified_split(reference, spec, key=["record_id"], seed=seed).where("split = 'test'").drop("split")


def candidate_vs_baseline(
    candidate: DataFrame, baseline: DataFrame, spec: DatasetSpec, variant: Variant = DEFAULT,
    baseline_variant: Variant | None = None, seed: int = SEED, folds: int = FOLDS,
    progress: Callable[[str], None] | None = None,
) -> Comparison:
    """Fit both data states fresh, without the hold-out, and compare them on it.

    The baseline keeps its own hyper-parameters but nothing it has learnt. Rows
    that repeat the features of a held-out row are kept out of both fits. The
    deployment model is fitted on all candidate rows afterwards. Both snapshots
    are read many times: pass stored ones (``SnapshotStore.load``).
    """
    # Snapshot rows are unique by feature and so by record id, which is their key from here on.
    spec = replace(spec, key=("record_id",))
    for data in (candidate, baseline):
        gates.require(gates.training_gate(data, spec))
    if not snapshot_diff(source_rows(candidate, REFERENCE), source_rows(baseline, REFERENCE)).first()["same_ids"]:
        raise ValueError("the reference rows differ from those of the active version")
    with ExitStack() as stack:
        held = stack.enter_context(kept(reference_holdout(candidate, spec, seed)))
        training = {
            name: stack.enter_context(kept(exclude_holdout(data, held, ["feature_id"], ["record_id"], hot=[])))
            for name, data in (("candidate", candidate), ("baseline", baseline))
        }
        return _compare(candidate, training, held, spec, {"candidate": variant, "baseline": baseline_variant or variant},
                        seed, folds, progress or (lambda message: None))


def _compare(
    candidate: DataFrame, training: dict[str, DataFrame], held: DataFrame, spec: DatasetSpec,
    variants: dict[str, Variant], seed: int, folds: int, say: Callable[[str], None],
) -> Comparison:
    spark, variant = candidate.sparkSession, variants["candidate"]
    if min_class_gate(training["candidate"], spec, folds).where("not passed").take(1):
        raise ValueError(f"every label needs at least {folds} training rows")
    rows = []
    for name in ("baseline", "candidate"):
        say(f"evaluating the {name} on the fixed hold-out")
        model = fit(training[name], spec, variants[name])
        cube = confusion_cube(model.predict(held), spec.label, f"predicted_{spec.label}")
        rows += [(name, model.fitted_rows, r["actual"], r["predicted"], r["n"]) for r in cube.collect()]
    cubes = spark.createDataFrame(rows, "model string, n_train bigint, actual string, predicted string, n bigint")
    say("cross-validating the candidate")
    folded = stratified_folds(training["candidate"], spec, folds=folds, seed=seed)
    scores = cross_validate(folded, spec, [variant], folds)
    say("fitting the deployment model on all rows")
    ranges = collect_ranges(feature_ranges(candidate, spec))
    deployment = replace(fit(candidate, spec, variant), ranges=ranges)
    return Comparison(
        classification_metrics(cubes, ["model", "n_train"]).withColumnRenamed("n", "n_validation"),
        confusion_matrix(cubes, spec.class_order, ["model"]),
        fold_summary(scores, ["variant"], ("validation_accuracy", "validation_macro_f1", "validation_cohen_kappa")),
        deployment,
    )


def status(store: SnapshotStore, prepared: Prepared, candidate: str | None = None) -> dict:
    """Whether a new training makes sense and whether a waiting candidate still holds.

    Ids are compared as tables; only the verdicts come back.
    """
    state = store.state()
    active = state["active_version"]
    waiting = store.confirmed_ids(candidate) if candidate else None
    current = source_rows(prepared.snapshot, CONFIRMED).select("record_id")
    changes = manifest_diff(current, store.confirmed_ids(active), waiting).first().asDict()
    fingerprint = prepared.report.first()["reference_fingerprint"]
    known = None if active == INITIAL else store.manifest(active)["reference_fingerprint"]
    same_reference = known is None or known == fingerprint
    holds = False
    if candidate:
        manifest = store.manifest(candidate)
        holds = (
            changes["candidate_holds"] and manifest["base_version"] == active
            and manifest["reference_fingerprint"] == fingerprint
        )
    return {
        "active_version": active,
        "previous_version": state["previous_version"],
        "new_confirmed": changes["new_confirmed"],
        "removed_confirmed": changes["removed_confirmed"],
        "same_reference": same_reference,
        "can_train": changes["can_train"] and same_reference,
        "can_adopt": holds and same_reference,
        "can_roll_back": state["previous_version"] is not None,
    }


def retrain(
    store: SnapshotStore, reference: DataFrame, log: DataFrame, spec: DatasetSpec, variant: Variant = DEFAULT,
    baseline_variant: Variant | None = None, progress: Callable[[str], None] | None = None,
) -> tuple[str, Comparison]:
    """Prepare, compare with the active version and store a candidate; adoption stays a separate step.

    The first version is compared with the reference rows alone, later ones with
    the snapshot of the active version.
    """
    prepared = prepare_dataset(reference, log, spec, materialise=True)
    verdict = status(store, prepared)
    if not verdict["same_reference"]:
        raise ValueError("the reference rows differ from those of the active version")
    if not verdict["can_train"]:
        raise ValueError("there are no new or changed confirmed observations")
    active, version = verdict["active_version"], new_version_id()
    data = store.stage(prepared.snapshot, version)
    baseline = source_rows(data, REFERENCE) if active == INITIAL else store.load(active)
    comparison = candidate_vs_baseline(data, baseline, spec, variant, baseline_variant, progress=progress)
    store.publish(version, spec, active, comparison.metrics, comparison.deployment)
    return version, comparison
