"""Classifiers on Spark ML: fit, score, size, persistence."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.operators import forest_bins
from obslab.operators.cleaning import ERRORS, normalise
from obslab.operators.features import FEATURES, fit_features
from obslab.operators.ranges import flag_ranges
from obslab.operators.splits import nested_subsets
from obslab.sources.tables import require_columns
from obslab.spec import DatasetSpec

# The deepest tree Spark ML can build; stands for "no depth limit".
UNLIMITED_DEPTH = 30
# Partitions of the rows of a fit: one for so few rows, whose scheduling costs more than their work, up to eight, and then
# one for so many rows.
SMALL_ROWS, SPREAD, PARTITION_ROWS = 512, 8, 250_000
# Rows times trees that are grown together, and trees at least: Spark keeps eight bytes for each row and tree until a forest is
# done, beside the row itself. A forest beyond that is grown in groups of trees.
GROWN, GROUP_TREES = 1 << 27, 16
# Between the seeds of two groups, far from those of a group's partitions.
_SEEDS = 1_000_003
_LABEL = "label_index"
_DRAWN = "_drawn"
_MODEL_COLUMNS = ("rawPrediction", "probability", "prediction", FEATURES)


@dataclass(frozen=True)
class Variant:
    """A named configuration; ``features`` of the spec may be replaced for ablations.

    ``fit_rows`` bounds the labelled rows of a fit: so many (by the rounding of
    each label's share) are taken by a hash of their key, the same ones whatever
    the layout. Without it every row is used. Scoring and evaluation always cover
    all rows.
    """

    name: str
    kind: str = "forest"
    trees: int = 500
    depth: int | None = 5
    min_leaf: int = 1
    c: float = 1.0
    seed: int = 42
    bins: int = 128
    fit_rows: int | None = None
    categorical: tuple[str, ...] | None = None
    numeric: tuple[str, ...] | None = None

    def spec(self, spec: DatasetSpec) -> DatasetSpec:
        if self.categorical is None and self.numeric is None:
            return spec
        return spec.with_features(self.numeric, self.categorical)

    def with_trees(self, trees: int) -> "Variant":
        return replace(self, trees=trees)


@dataclass(frozen=True)
class FittedModel:
    pipeline: PipelineModel
    spec: DatasetSpec
    variant: Variant
    version: str = "unsaved"
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    #: Rows that the classifier learnt from; null for a loaded model.
    fitted_rows: int | None = None

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the predicted label and the class-to-probability map."""
        scored = self.pipeline.transform(df)
        names = F.array(*[F.lit(v) for v in self.spec.class_order])
        helpers = [c for c in scored.columns if c not in df.columns]
        return scored.withColumns({
            f"predicted_{self.spec.label}": F.element_at(names, F.col("prediction").cast("int") + 1),
            "probabilities": F.map_from_arrays(names, vector_to_array("probability")),
        }).drop(*helpers)

    def save(self, path: str) -> None:
        self.pipeline.write().save(path)

    @classmethod
    def load(cls, path: str, spec: DatasetSpec, variant: Variant, **known) -> "FittedModel":
        return cls(PipelineModel.load(path), spec, variant, **known)


def place(rows: DataFrame, spec: DatasetSpec, partitions: int | None = None) -> DataFrame:
    """Rows spread and sorted by their key.

    Spark's forest depends on how rows lie in partitions. Placing them by key
    makes a seed give the same forest whatever the input layout and the session's
    settings: the number of partitions follows from the number of rows alone.
    """
    if not spec.key:
        raise ValueError("placing rows needs a row key")
    n = partitions or partitions_for(rows.count())
    return rows.repartition(n, *spec.key).sortWithinPartitions(*spec.key)


def partitions_for(rows: int) -> int:
    """Partitions of the rows of a fit: it follows from their number alone."""
    return max(1, min(-(-rows // SMALL_ROWS), max(SPREAD, -(-rows // PARTITION_ROWS))))


def bounded(rows: DataFrame, spec: DatasetSpec, variant: Variant) -> DataFrame:
    """The rows that a fit of the variant uses: each label gives the same share of its rows, one at least."""
    if variant.fit_rows is None:
        return rows
    if not spec.key:
        raise ValueError("bounding the rows of a fit needs a row key")
    return draw(rows, spec, variant, _DRAWN).where(_DRAWN).drop(_DRAWN)


def draw(rows: DataFrame, spec: DatasetSpec, variant: Variant, name: str, where: Column | None = None) -> DataFrame:
    """Adds whether a fit of the variant on the rows that are ``where`` uses the row."""
    taken = F.col(spec.label).isin(*spec.class_order)
    if where is not None:
        taken = taken & where
    total = rows.where(taken).count()
    if total <= variant.fit_rows:
        return rows.withColumn(name, F.coalesce(taken, F.lit(False)))
    drawn = nested_subsets(rows, spec, [variant.fit_rows / total], seed=f"fit:{variant.seed}", name=name, where=taken)
    return drawn.withColumn(name, F.coalesce(F.col(name) == 0, F.lit(False)))


def fit(train: DataFrame, spec: DatasetSpec, variant: Variant = Variant("forest"), placed: bool = False) -> FittedModel:
    """Fit preprocessing and classifier on the given rows.

    ``placed`` says that ``train`` went through ``place`` (and at most filters)
    already, as in studies that fit the same rows many times.
    """
    spec = variant.spec(spec)
    rows = train.select(*spec.key, spec.label, *spec.features).where(F.col(spec.label).isin(*spec.class_order))
    if variant.fit_rows is None:
        return _fit(rows, spec, variant, placed)
    # The bounded rows are few, and finding them reads the whole table: that is done once.
    drawn = bounded(rows, spec, variant).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(drawn, spec, variant, placed)
    finally:
        drawn.unpersist()


def _fit(rows: DataFrame, spec: DatasetSpec, variant: Variant, placed: bool) -> FittedModel:
    names = F.array(*[F.lit(v) for v in spec.class_order])
    # The class names travel as column metadata, which saves a pass that would count them.
    meta = {"ml_attr": {"type": "nominal", "vals": list(spec.class_order), "name": _LABEL}}
    index = (F.array_position(names, F.col(spec.label)) - 1).cast("double").alias(_LABEL, metadata=meta)
    n = rows.count()
    prepared = fit_features(rows, spec, scaled=variant.kind == "logistic")
    ordered = rows if placed else place(rows, spec)
    if n == 1 and variant.kind == "forest":
        # Spark allows as many bins as there are rows, and a category needs two: a lone row is learnt twice.
        ordered = ordered.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    matrix = prepared.transform(ordered.select("*", index)).select(_LABEL, FEATURES)
    if variant.kind == "forest":
        classifier = _forest(variant, _vector_size(matrix))
    elif variant.kind == "logistic":
        classifier = LogisticRegression(
            family="multinomial", regParam=1.0 / (variant.c * n), elasticNetParam=0.0,
            standardization=False, maxIter=2000,
        )
    else:
        raise ValueError(f"unknown kind of model: {variant.kind}")
    classifier = classifier.setLabelCol(_LABEL).setFeaturesCol(FEATURES)
    grow = lambda data: _grown(classifier, data, n) if variant.kind == "forest" else classifier.fit(data)
    if placed:
        fitted = grow(matrix)
    else:
        # The classifier reads its input several times; keep the shuffled rows until it is done.
        stored = matrix.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fitted = grow(stored)
        finally:
            stored.unpersist()
    if variant.kind == "forest" and variant.depth is None and max(t.depth() for t in _trees(fitted)) >= UNLIMITED_DEPTH:
        warnings.warn(f"{variant.name}: a tree reached depth {UNLIMITED_DEPTH}, the most Spark ML can build", stacklevel=2)
    return FittedModel(PipelineModel([*prepared.stages, fitted]), spec, variant, fitted_rows=n)


def _vector_size(matrix: DataFrame) -> int:
    return int(matrix.schema[FEATURES].metadata["ml_attr"]["num_attrs"])


class _ForestModel(RandomForestClassificationModel):
    """A forest that wraps its trees in Python only when somebody asks for them.

    The parent's cached ``trees`` is read when its parameters are listed, which takes longer than a small fit, and
    one fit after the other, because the wrapping is Python's.
    """

    @property
    def trees(self) -> list:
        return RandomForestClassificationModel.trees.func(self)


class _Forest(RandomForestClassifier):
    def _create_model(self, java_model) -> _ForestModel:
        return _ForestModel(java_model)


def _forest(variant: Variant, inputs: int) -> RandomForestClassifier:
    # Candidate features per split: the rounded-down square root, given as a number
    # because Spark's own "sqrt" rounds up.
    return _Forest(
        numTrees=variant.trees,
        maxDepth=UNLIMITED_DEPTH if variant.depth is None else variant.depth,
        minInstancesPerNode=variant.min_leaf,
        featureSubsetStrategy=str(max(1, int(inputs**0.5))),
        maxBins=variant.bins,
        seed=variant.seed,
        maxMemoryInMB=512,
        # Every row's node in every tree stays with the row: else each level sends the whole forest to all tasks.
        cacheNodeIds=True,
    )


def _grown(forest: _Forest, matrix: DataFrame, rows: int) -> _ForestModel:
    """The forest, in as many groups of trees as its number of rows asks for; each group has a seed of its own."""
    trees, seed = forest.getNumTrees(), forest.getSeed()
    size = max(GROUP_TREES, GROWN // max(1, rows))
    if trees <= size:
        return forest.fit(matrix)
    groups = [
        forest.copy({forest.numTrees: min(size, trees - first), forest.seed: seed + first // size * _SEEDS}).fit(matrix)
        for first in range(0, trees, size)
    ]
    gateway, jvm = matrix.sparkSession.sparkContext._gateway, matrix.sparkSession.sparkContext._jvm
    all_trees = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, trees)
    for i, tree in enumerate(tree for group in groups for tree in _trees(group)):
        all_trees[i] = tree
    first = groups[0]
    joined = _ForestModel(jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        first.uid, all_trees, first.numFeatures, first.numClasses))
    joined = forest._copyValues(joined._resetUid(first.uid))
    joined._transfer_params_to_java()
    return joined


def score(df: DataFrame, model: FittedModel, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Batch scoring: ``(scored, refused)``.

    Observations are validated by the serving rules; refused rows keep their
    codes. Scored rows carry prediction, probabilities, range warnings and the
    model version; a value outside the training range is a warning only.
    """
    require_columns(df, model.spec.features)
    checked = normalise(df, model.spec, "serve")
    accepted = F.size(ERRORS) == 0
    refused = checked.where(~accepted)
    first = refused.take(1) if strict else []
    if first:
        raise ValueError(f"observations were refused: {first[0][ERRORS]}")
    good = checked.where(accepted).drop(ERRORS)
    if model.ranges:
        good = flag_ranges(good, model.spec, model.ranges)
    return forest_bins.predict(model, good).withColumn("model_version", F.lit(model.version)), refused


def ranked_probabilities(scored: DataFrame, kept: Sequence[str]) -> DataFrame:
    """One row per class, most probable first; equal probabilities in class order."""
    entries = F.transform(
        F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("class"))
    )
    return scored.select(*kept, F.posexplode(F.array_sort(entries)).alias("place", "entry")).select(
        *kept, (F.col("place") + 1).alias("place"), F.col("entry.class").alias("class"),
        (-F.col("entry.minus")).alias("probability"),
    )


def _trees(forest) -> list:
    """The trees as the JVM holds them: copying each into Python only to read two numbers is slow."""
    return list(forest._call_java("trees"))


def forest_size(model: FittedModel) -> dict[str, float]:
    """Mean nodes, depth and leaves per tree; every split has two children."""
    trees = _trees(model.classifier)
    nodes = [t.numNodes() for t in trees]
    return {
        "tree_nodes": sum(nodes) / len(nodes),
        "tree_depth": sum(t.depth() for t in trees) / len(nodes),
        "tree_leaves": sum((n + 1) / 2 for n in nodes) / len(nodes),
    }


def coefficient_count(model: FittedModel) -> int:
    matrix = model.classifier.coefficientMatrix
    return matrix.numRows * matrix.numCols + len(model.classifier.interceptVector)
