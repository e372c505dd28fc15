"""A forest seen through its split thresholds.

A tree only asks whether a measure is at most one of its thresholds and which category a value is. So all values between two
neighbouring thresholds of the whole forest are one bin, and rows with equal bins get the same answer. Rows are counted by
their bins and every *different* combination is scored once, through a row of representative values. This is exact, and the
scoring is bounded by the model: by its bins, not by the rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_
from typing import TYPE_CHECKING

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obslab.session import shared_dir

if TYPE_CHECKING:
    from obslab.operators.models import FittedModel

#: Bytes of scored combinations that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Combinations that one task scores.
SCORED_CODES = 8192
#: Combinations that one long can number.
_CODES = 1 << 62
#: A value that no indexer has seen.
_UNSEEN = "\0unseen"


@dataclass(frozen=True)
class Slot:
    """Where a feature's bin is kept: in which of the code columns, as which of its digits."""

    word: int
    factor: int
    size: int


@dataclass(frozen=True)
class ForestBins:
    model: FittedModel
    #: Ascending thresholds of each measure, and the categories of each other feature.
    thresholds: dict[str, list[float]]
    categories: dict[str, list[str]]

    @cached_property
    def slots(self) -> dict[str, Slot]:
        """Digits of mixed radix, in as many longs as they need."""
        slots, word, factor = {}, 0, 1
        for c in self.model.spec.features:
            size = len(self.thresholds.get(c, self.categories.get(c))) + 1
            if factor * size >= _CODES:
                word, factor = word + 1, 1
            slots[c] = Slot(word, factor, size)
            factor *= size
        return slots

    @property
    def words(self) -> list[str]:
        return [f"_code_{i}" for i in range(1 + max((s.word for s in self.slots.values()), default=0))]

    def with_bins(self, rows: DataFrame) -> DataFrame:
        """Adds ``_bin_<n>`` for the n-th feature."""
        spec = self.model.spec
        numeric = [c for c in spec.numeric if self.thresholds[c]]
        number = {c: f"_bin_{i}" for i, c in enumerate(spec.features)}
        if numeric:
            # A bucket starts right above a threshold, because a value equal to it still goes to the lower side.
            splits = [[-math.inf, *(math.nextafter(t, math.inf) for t in self.thresholds[c]), math.inf] for c in numeric]
            names = [f"{number[c]}_" for c in numeric]
            # A value that is no number is above every threshold: the bucket kept for it is the last one.
            rows = Bucketizer(splitsArray=splits, inputCols=numeric, outputCols=names, handleInvalid="keep").transform(rows)
        out = {}
        for c in spec.features:
            if c in self.categories:
                text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(spec.fill))
                value = F.coalesce(F.array_position(F.array(*map(F.lit, self.categories[c])), text), F.lit(0)) if self.categories[c] else F.lit(0)
            elif self.thresholds[c]:
                value = F.least(F.col(f"{number[c]}_"), F.lit(len(self.thresholds[c])))
            else:
                value = F.lit(0)
            out[number[c]] = value.cast("bigint")
        return rows.withColumns(out).drop(*(f"{number[c]}_" for c in numeric))

    def codes(self, bin_of) -> list[Column]:
        """The code columns of the bins that ``bin_of(n)`` gives for the n-th feature."""
        parts: dict[int, list[Column]] = {}
        for i, slot in enumerate(self.slots.values()):
            parts.setdefault(slot.word, []).append(bin_of(i) * F.lit(slot.factor))
        return [sum(parts.get(w, []), F.lit(0).cast("bigint")).alias(name) for w, name in enumerate(self.words)]

    def representatives(self, coded: DataFrame) -> DataFrame:
        """Adds one value of each feature that lies in the row's bins."""
        values = {}
        for c, slot in self.slots.items():
            place = (F.expr(f"({self.words[slot.word]} div {slot.factor}) % {slot.size}") + 1).cast("int")
            if c in self.categories:
                known = [_UNSEEN, *self.categories[c]]
            else:
                limits = self.thresholds[c]
                known = [*limits, math.nextafter(limits[-1], math.inf) if limits else 0.0]
            values[c] = F.element_at(F.array(*map(F.lit, known)), place)
        return coded.withColumns(values)

    def answers(self, coded: DataFrame) -> DataFrame:
        """(codes, predicted) of every different combination of codes, written to the shared folder.

        Codes take few bytes and long to score, so they are dealt to tasks by their number.
        """
        spark = coded.sparkSession
        path = shared_dir(spark, "answers")
        coded.select(*self.words).distinct().write.parquet(f"{path}/codes")
        different = spark.read.parquet(f"{path}/codes")
        spread = different.repartition(1 + different.count() // SCORED_CODES)
        schema = ", ".join(f"{w} bigint" for w in self.words) + ", predicted string"
        spread.mapInArrow(self._voter(), schema).write.parquet(f"{path}/answers")
        return spark.read.parquet(f"{path}/answers")

    def predict(self, rows: DataFrame) -> DataFrame:
        """What the model's own ``predict`` adds: each different combination is scored once and written, then joined to its rows."""
        spec, spark = self.model.spec, rows.sparkSession
        predicted = f"predicted_{spec.label}"
        coded = self.with_bins(rows).select(*rows.columns, *self.codes(lambda i: F.col(f"_bin_{i}")))
        # The model refuses rows without a measure, and so must their codes.
        lacking = reduce(or_, [F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")) for c in spec.numeric], F.lit(False))
        path = shared_dir(spark, "answers")
        refused = F.raise_error(F.lit("a measure is missing")).cast("bigint")
        first = F.when(lacking, refused).otherwise(F.col(self.words[0])).alias(self.words[0])
        coded.select(first, *self.words[1:]).distinct().write.parquet(f"{path}/codes")
        different = spark.read.parquet(f"{path}/codes")
        n = different.count()
        spread = different.repartition(max(spark.sparkContext.defaultParallelism, 1 + n // SCORED_CODES))
        # One number for each class, because maps of all combinations would be too large to broadcast.
        shares = [f"_share_{i}" for i in range(len(spec.class_order))]
        scored = self.model.predict(self.representatives(spread))
        scored.select(*self.words, F.col(predicted).alias("_predicted"), *(
            F.col("probabilities")[name].alias(s) for name, s in zip(spec.class_order, shares))).write.parquet(f"{path}/answers")
        answers = spark.read.parquet(f"{path}/answers")
        small = n * (8 * (len(self.words) + len(shares)) + 32) <= BROADCAST_BYTES
        names = F.array(*map(F.lit, spec.class_order))
        answered = coded.join(F.broadcast(answers) if small else answers, self.words, "left")
        known = F.when(F.col("_predicted").isNotNull(), F.col("_predicted")).otherwise(F.raise_error(F.lit("rows differ between two readings")))
        return answered.select(*(F.col(f"`{c}`") for c in rows.columns if c not in (predicted, "probabilities")),
                               known.alias(predicted), F.map_from_arrays(names, F.array(*shares)).alias("probabilities"))

    def _nodes(self) -> dict[str, list]:
        """All nodes of all trees in rows: which digit a split looks at, what goes left, where to, and a leaf's class shares."""
        path = shared_dir(self._spark, "forest")
        self.model.classifier.write().save(path)
        rows = self._spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
        spec = self.model.spec
        slots = list(self.slots.values())
        # The vector's inputs: measures, then one input for each category, in the order of the indexer.
        inputs = [(i, None) for i in range(len(spec.numeric))]
        inputs += [(len(spec.numeric) + i, at + 1) for i, c in enumerate(spec.categorical) for at in range(len(self.categories[c]))]
        limits = [{t: k for k, t in enumerate(self.thresholds[c])} for c in spec.numeric]
        first = {}
        for at, r in enumerate(rows):
            first.setdefault(r["treeID"], at)
        table = {name: [] for name in ("slot", "bound", "equal", "flag", "left", "right", "shares")}
        for at, r in enumerate(rows):
            leaf, split = r["leftChild"] < 0, r["split"]
            slot, bound, equal, flag = 0, 0, False, True
            if not leaf:
                slot, category = inputs[split["featureIndex"]]
                values = split["leftCategoriesOrThreshold"]
                if category is None:
                    bound = limits[slot][values[0]]
                else:
                    goes = (lambda v: v in values) if split["numCategories"] >= 0 else (lambda v: v <= values[0])
                    if goes(1.0) == goes(0.0):
                        raise ValueError("a split that parts nothing")
                    bound, equal, flag = category, True, goes(1.0)
            whole = sum(r["impurityStats"])
            start = first[r["treeID"]]
            row = (slot, bound, equal, flag, at if leaf else start + r["leftChild"], at if leaf else start + r["rightChild"],
                   [v / whole if whole else 0.0 for v in r["impurityStats"]])
            for values, value in zip(table.values(), row):
                values.append(value)
        table["roots"] = list(first.values())
        table["digits"] = [(s.word, s.factor, s.size) for s in slots]
        return table

    @property
    def _spark(self) -> SparkSession:
        return SparkSession.getActiveSession()

    def _voter(self):
        """Scores batches of codes: the trees' class shares are added in the order of the trees, as the model itself does."""
        nodes = {k: np.array(v) for k, v in self._nodes().items()}
        names, words = list(self.model.spec.class_order), self.words

        def vote(batches):
            import numpy as np
            import pyarrow as pa

            slot, bound, equal, flag, left, right, shares = (nodes[k] for k in ("slot", "bound", "equal", "flag", "left", "right", "shares"))
            leaf = left == np.arange(len(left))
            for batch in batches:
                codes = [batch.column(i).to_numpy() for i in range(len(words))]
                bins = np.stack([codes[w] // factor % size for w, factor, size in nodes["digits"]], axis=1)
                rows, votes = np.arange(batch.num_rows), np.zeros((batch.num_rows, len(names)))
                for root in nodes["roots"]:
                    at = np.full(batch.num_rows, root)
                    while not leaf[at].all():
                        value, limit = bins[rows, slot[at]], bound[at]
                        goes = np.where(equal[at], (value == limit) == flag[at], value <= limit)
                        at = np.where(goes, left[at], right[at])
                    votes += shares[at]
                best = pa.array(np.array(names, object)[votes.argmax(axis=1)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(words))), best], [*words, "predicted"])

        return vote


def forest_bins(model: FittedModel) -> ForestBins:
    """The bins of a fitted forest. Its printed trees name every threshold so that it reads back exactly."""
    spec = model.spec
    found: dict[int, set[float]] = {}
    for feature, value in set(re.findall(r"If \(feature (\d+) <= ([^)]+)\)", model.classifier.toDebugString)):
        found.setdefault(int(feature), set()).add(float(value))
    thresholds = {c: sorted(found.get(i, ())) for i, c in enumerate(spec.numeric)}
    labels = model.pipeline.stages[1].labelsArray if spec.categorical else []
    return ForestBins(model, thresholds, {c: list(v) for c, v in zip(spec.categorical, labels)})


def binned_cube(model: FittedModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The confusion cube (keys, actual, predicted, n) of a forest's answers for the rows."""
    bins = forest_bins(model)
    label = model.spec.label
    # Keys may be features, whose representative values must not replace them.
    names = [f"_key_{i}" for i in range(len(keys))]
    held = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    coded = bins.with_bins(rows).select(*held, F.col(label).alias("actual"), *bins.codes(lambda i: F.col(f"_bin_{i}")))
    counted = coded.groupBy(*names, "actual", *bins.words).agg(F.count(F.lit(1)).alias("n"))
    # The forest is asked once per combination: a combination has a count for each label and key at most.
    together = counted.groupBy(*bins.words).agg(F.collect_list(F.struct(*names, "actual", "n")).alias("_counts"))
    spread = together.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    predicted = model.predict(bins.representatives(spread)).select(
        F.col(f"predicted_{label}").alias("predicted"), F.explode("_counts").alias("_count"))
    cube = predicted.groupBy(*(F.col(f"_count.{c}").alias(c) for c in (*names, "actual")), "predicted").agg(F.sum("_count.n").alias("n"))
    return cube.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), "actual", "predicted", "n")


def predict(model: FittedModel, rows: DataFrame) -> DataFrame:
    """``model.predict`` for whole tables: what a forest has to answer is bounded by its bins, not by the rows."""
    return forest_bins(model).predict(rows) if model.variant.kind == "forest" else model.predict(rows)
