"""Spark-native analytics for labelled observation tables."""

from obslab.operators.cleaning import clean, normalise, validate
from obslab.operators.duplicates import duplicate_summary
from obslab.operators.features import fit_pca, pca_report, pca_scores
from obslab.operators.leakage import manifest_diff, split_overlap
from obslab.operators.metrics import classification_metrics, confusion_cube
from obslab.operators.models import FittedModel, Variant, fit, score
from obslab.operators.prepare import prepare_dataset
from obslab.operators.profile import class_ranges, crosstab, describe_numeric
from obslab.operators.splits import nested_subsets, stratified_folds, stratified_split
from obslab.operators.versions import version_state
from obslab.plans.retraining import candidate_vs_baseline, retrain
from obslab.plans.study import cross_validate, grid_study, learning_curve, permutation_importance
from obslab.plans.training import train
from obslab.sources.snapshots import SnapshotStore
from obslab.sources.tables import load_table
from obslab.spec import BODY_MEASURES, DatasetSpec
from obslab.streaming.jobs import score_stream

__all__ = [
    "BODY_MEASURES", "DatasetSpec", "FittedModel", "SnapshotStore", "Variant", "candidate_vs_baseline", "class_ranges",
    "classification_metrics", "clean", "confusion_cube", "cross_validate", "crosstab", "describe_numeric",
    "duplicate_summary", "fit", "fit_pca", "grid_study", "learning_curve", "load_table", "manifest_diff",
    "nested_subsets", "normalise", "pca_report", "pca_scores", "permutation_importance", "prepare_dataset", "retrain",
    "score", "score_stream", "split_overlap", "stratified_folds", "stratified_split", "train", "validate", "version_state",
]
