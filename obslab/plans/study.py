"""Model studies on one protocol: cross-validation, grid, curve, importance, ablation.

Every study reduces each fit to the rows of a confusion cube (labels squared per
run) on the cluster; only those counts and tree sizes meet on the driver.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from dataclasses import replace
from functools import reduce
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obslab.functions.identity import order_hash
from obslab.operators.forest_bins import BROADCAST_BYTES, ForestBins, binned_cube, forest_bins
from obslab.operators.metrics import classification_metrics, confusion_cube, fold_summary, select_variant
from obslab.operators.models import GROWN, FittedModel, Variant, coefficient_count, draw, fit, forest_size, partitions_for, place
from obslab.operators.splits import LEARNING_FRACTIONS, SEED, stratified_folds, stratified_split, subset_rule, subset_seed
from obslab.session import shared_dir
from obslab.sources.tables import write_semicolon_csv
from obslab.spec import DatasetSpec

# Fits submitted to the cluster at the same time.
PARALLEL_FITS = 8
# Fits of at most so many rows are drawn for all folds in one pass: the hashes that decide meet on the driver.
DRAWN_ROWS = 20_000
# Rows of one block in which a permutation trial moves values.
BLOCK = 1024
# Files of blocks at most, and blocks of one file where there are enough for all cores.
MOST_FILES, FILE_BLOCKS = 10_000, 16
# Combinations of bins whose answers are looked up in one array, a byte each.
TABLE_CODES = 1 << 22
# The grid of the regularisation study.
GRID = tuple(
    Variant(f"d{depth or 'max'}-l{leaves}", depth=depth, min_leaf=leaves) for depth in (None, 5, 10) for leaves in (1, 2, 4)
)
# The three model families compared on the same folds.
FAMILIES = (
    Variant("original", depth=None),
    Variant("compact", depth=5),
    Variant("logistic", kind="logistic"),
)
_RUN = "run string, subset string, actual string, predicted string, n bigint"


@contextmanager
def kept(df: DataFrame):
    """Keep a frame that many fits read; lost blocks are recomputed from the input."""
    stored = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield stored
    finally:
        stored.unpersist()


def protocol(df: DataFrame, spec: DatasetSpec, seed: int = SEED, folds: int = 5) -> DataFrame:
    """Hold-out split plus folds of the training part; ``fold`` is 0 on held-out rows."""
    split = stratified_split(df, spec, seed=seed)
    folded = stratified_folds(split, spec, folds=folds, seed=seed, where=F.col("split") == "train")
    return folded.withColumn("fold", F.when(F.col("split") == "test", 0).otherwise(F.col("fold")))


def with_folds(df: DataFrame, spec: DatasetSpec, seed: int = SEED, folds: int = 5) -> DataFrame:
    """Only the training part of the protocol, with its folds."""
    training = stratified_split(df, spec, seed=seed).where("split = 'train'")
    return stratified_folds(training, spec, folds=folds, seed=seed)


def _model_rows(df: DataFrame, spec: DatasetSpec, *extra: str) -> DataFrame:
    context = [c for c in spec.context if c in df.columns]
    return place(df.select(*spec.key, spec.label, *spec.features, *context, *extra), spec)


def _cube_rows(model: FittedModel, run: str, **subsets: DataFrame) -> list[tuple]:
    """Confusion counts of the named subsets; at most labels squared rows each."""
    tagged = reduce(
        DataFrame.unionByName, [rows.withColumn("subset", F.lit(name)) for name, rows in subsets.items()]
    )
    cube = _cube(model, tagged, ["subset"])
    return [(run, r["subset"], r["actual"], r["predicted"], r["n"]) for r in cube.collect()]


def _cube(model: FittedModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    if model.variant.kind == "forest":
        return binned_cube(model, rows, keys)
    return confusion_cube(model.predict(rows), model.spec.label, f"predicted_{model.spec.label}", keys)


def _at_once(rows: DataFrame, variants: Sequence[Variant]) -> int:
    """Fits submitted at the same time: fewer where whole forests are so large that what Spark keeps for each would add up."""
    trees = max((v.trees for v in variants if v.kind == "forest" and v.fit_rows is None), default=0)
    return max(1, min(PARALLEL_FITS, 2 * GROWN // max(1, trees * rows.count()))) if trees else PARALLEL_FITS


def run_fits(tasks: Sequence[Callable[[], tuple]], at_once: int = PARALLEL_FITS) -> list[tuple]:
    """Submit independent fits from a few driver threads so that the cluster stays busy."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return list(pool.map(lambda task: task(), tasks))


def fold_draws(rows: DataFrame, spec: DatasetSpec, variant: Variant, folds: int) -> tuple[DataFrame, int]:
    """Adds ``drawn_<fold>``, whether a fit of the variant on that fold's training rows uses the row, and the largest draw.

    The same rows as ``models.draw`` takes fold by fold, found in two passes for all folds together: a count by label and
    fold, and the least hashes of each, among which are those of every other fold's draw.
    """
    label, names = spec.label, spec.class_order
    hashed = order_hash(subset_seed(f"fit:{variant.seed}"), *(F.col(k) for k in spec.key))
    known = rows.where(F.col(label).isin(*names) & F.col("fold").isNotNull())
    counts = {(r[0], r[1]): r[2] for r in known.groupBy(label, "fold").count().collect()}
    quotas: dict[int, dict[str, int] | None] = {}
    for fold in range(1, folds + 1):
        sizes = {c: sum(n for (name, f), n in counts.items() if name == c and f != fold) for c in names}
        total = sum(sizes.values())
        share = variant.fit_rows / total if total else 1.0
        quotas[fold] = None if total <= variant.fit_rows else {c: max(1, round(share * n)) for c, n in sizes.items() if n}
    most = max((n for q in quotas.values() if q for n in q.values()), default=0)
    least: dict[tuple[str, int], list[str]] = {}
    if most:
        place = F.row_number().over(Window.partitionBy(label, "fold").orderBy("hash"))
        ranked = known.select(label, "fold", hashed.alias("hash")).withColumn("place", place).where(F.col("place") <= most + 1)
        for name, fold, text in ranked.select(label, "fold", "hash").collect():
            least.setdefault((name, fold), []).append(text)
    drawn, largest = {}, 0
    for fold, quota in quotas.items():
        outside = F.col("fold") != fold
        if quota is None:
            chosen = F.col(label).isin(*names) & outside
            largest = max(largest, sum(n for (_, f), n in counts.items() if f != fold))
        else:
            chosen, largest = F.lit(False), max(largest, sum(quota.values()))
            for name, n in quota.items():
                merged = nsmallest(n + 1, (h for (c, f), own in least.items() if c == name and f != fold for h in own))
                if merged[n - 1] == merged[-1] and len(merged) > n:
                    raise ValueError("row keys repeat: rows that share a key cannot be split to the quota")
                chosen = chosen | ((F.col(label) == name) & (hashed <= merged[n - 1]) & outside)
        drawn[f"drawn_{fold}"] = F.coalesce(chosen, F.lit(False))
    return rows.withColumns(drawn), largest


def _samples(stack: ExitStack, rows: DataFrame, spec: DatasetSpec, variants: Sequence[Variant], folds: int) -> dict:
    """The rows that bounded variants fit, by (fit_rows, seed): one small table for all folds and variants that share it."""
    samples = {}
    for v in variants:
        bound = (v.fit_rows, v.seed)
        if v.fit_rows is None or v.fit_rows > DRAWN_ROWS or bound in samples:
            continue
        drawn, largest = fold_draws(rows, spec, v, folds)
        used = drawn.where(reduce(lambda a, b: a | b, (F.col(f"drawn_{f}") for f in range(1, folds + 1))))
        samples[bound] = stack.enter_context(kept(place(used, spec, partitions_for(largest))))
    return samples


def _fold_task(
    rows: DataFrame, spec: DatasetSpec, variant: Variant, fold: int, fraction: float = 1.0, subset: int | None = None,
    samples: dict | None = None,
):
    def task():
        training, validation = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if subset is not None:
            training = training.where(F.col(f"smallest_{fold}") <= subset)
        sample = (samples or {}).get((variant.fit_rows, variant.seed))
        learnt = training if sample is None else sample.where(f"drawn_{fold}")
        if sample is not None and subset is not None:
            learnt = learnt.where(F.col(f"smallest_{fold}") <= subset)
        began = time.perf_counter()
        model = fit(learnt, spec, variant if sample is None else replace(variant, fit_rows=None), placed=True)
        seconds = time.perf_counter() - began
        run = f"{variant.name}|{fold}|{fraction}"
        cube = _cube_rows(model, run, train=training, validation=validation)
        facts = {"fit_seconds": seconds, "n_train": model.fitted_rows}
        if variant.kind == "forest":
            facts.update(forest_size(model), coefficients=None)
        else:
            facts.update(tree_nodes=None, tree_depth=None, tree_leaves=None, coefficients=coefficient_count(model))
        return (run, variant.name, fold, fraction, facts), cube
    return task


def _fold_table(spark: SparkSession, results: list[tuple]) -> DataFrame:
    """One row per run with train and validation metrics, sizes and fit time; ``n_train`` counts the rows of the fit."""
    cube = spark.createDataFrame([row for _, rows in results for row in rows], _RUN)
    scores = classification_metrics(cube, ["run", "subset"])
    wide = scores.groupBy("run").agg(*[
        F.max(F.when(F.col("subset") == s, F.col(m))).alias(f"{s}_{m}")
        for s in ("train", "validation") for m in ("accuracy", "macro_f1", "cohen_kappa")
    ], F.max(F.when(F.col("subset") == "validation", F.col("n"))).alias("n_validation"))
    facts = spark.createDataFrame(
        [(run, name, fold, fraction, f["fit_seconds"], f["tree_nodes"], f["tree_depth"], f["tree_leaves"], f["coefficients"], f["n_train"])
         for (run, name, fold, fraction, f), _ in results],
        "run string, variant string, fold int, fraction double, fit_seconds double, "
        "tree_nodes double, tree_depth double, tree_leaves double, coefficients int, n_train bigint",
    )
    return facts.join(F.broadcast(wide), "run").drop("run")


def cross_validate(df: DataFrame, spec: DatasetSpec, variants: Sequence[Variant], folds: int = 5) -> DataFrame:
    """One row per (variant, fold); ``df`` carries a ``fold`` column from 1 to ``folds``.

    Preprocessing is learnt anew from each fold's training rows. Variants with the same ``fit_rows`` and seed share one draw.
    """
    with ExitStack() as stack:
        rows = stack.enter_context(kept(_model_rows(df, spec, "fold")))
        samples = _samples(stack, rows, spec, variants, folds)
        tasks = [_fold_task(rows, spec, v, fold, samples=samples) for v in variants for fold in range(1, folds + 1)]
        return _fold_table(df.sparkSession, run_fits(tasks, _at_once(rows, variants)))


def grid_study(df: DataFrame, spec: DatasetSpec, grid: Sequence[Variant] = GRID, folds: int = 5) -> DataFrame:
    """Grid of forests on identical folds, summarised, with the recommended variant marked."""
    return summarise_grid(cross_validate(df, spec, grid, folds))


def summarise_grid(table: DataFrame) -> DataFrame:
    scores = ("train_accuracy", "validation_accuracy", "train_macro_f1", "validation_macro_f1")
    summary = fold_summary(table, ["variant"], scores, listed=False)
    sizes = table.groupBy("variant").agg(*[
        F.avg(c).alias(f"{c}_mean") for c in ("tree_nodes", "tree_depth", "tree_leaves")
    ])
    return select_variant(summary.join(F.broadcast(sizes), "variant"))


def write_study(summary: DataFrame, curve: DataFrame, folder: str) -> None:
    """The two result tables of a study as ``;``-separated text."""
    write_semicolon_csv(summary, f"{folder}/variants", summary.columns)
    write_semicolon_csv(curve, f"{folder}/learning_curve", [
        "fraction", "fold", "n_train", "n_validation",
        "train_accuracy", "validation_accuracy", "train_macro_f1", "validation_macro_f1",
    ])


def learning_curve(
    df: DataFrame, spec: DatasetSpec, variant: Variant, fractions: Sequence[float] = LEARNING_FRACTIONS,
    folds: int = 5, seed: int = SEED, full: DataFrame | None = None,
) -> DataFrame:
    """Scores per (fraction, fold) on nested subsets of each fold's training rows.

    The largest fraction is the plain cross-validation; pass its table as
    ``full`` to reuse it instead of fitting again. A variant with ``fit_rows``
    bounds each fold's training rows once, as its plain cross-validation does;
    the fractions are cut out of that sample, and every fit uses its whole subset.
    """
    whole = replace(variant, fit_rows=None)
    with ExitStack() as stack:
        base = stack.enter_context(kept(_model_rows(df, spec, "fold")))
        taken, largest, samples = {fold: F.col("fold") != fold for fold in range(1, folds + 1)}, None, None
        if variant.fit_rows is not None:
            if variant.fit_rows <= DRAWN_ROWS:
                base, largest = fold_draws(base, spec, variant, folds)
            else:
                for fold, where in taken.items():
                    base = draw(base, spec, variant, f"drawn_{fold}", where)
            taken = {fold: F.col(f"drawn_{fold}") for fold in taken}
        # The thresholds of all folds are found at the same time.
        rules = run_fits([
            lambda fold=fold, where=where: (f"smallest_{fold}", subset_rule(base, spec, fractions, seed=seed + fold, where=where))
            for fold, where in taken.items()
        ])
        # Every fit and every scoring reads the rows: their hashes are taken once.
        rows = stack.enter_context(kept(base.withColumns({name: rule for name, rule in rules if rule is not None})))
        if largest is not None:
            # All fractions of all folds learn from one small table, placed as a cross-validation's sample is.
            used = rows.where(reduce(lambda a, b: a | b, taken.values()))
            samples = {(None, variant.seed): stack.enter_context(kept(place(used, spec, partitions_for(largest))))}
        tasks = [
            _fold_task(rows, spec, whole, fold, f, i, samples)
            for i, f in enumerate(fractions) if f < 1.0 or full is None for fold in range(1, folds + 1)
        ]
        table = _fold_table(df.sparkSession, run_fits(tasks))
    if full is not None:
        table = table.unionByName(full.where(F.col("variant") == variant.name))
    return table.select(
        "fraction", "fold", "n_train", "n_validation",
        "train_accuracy", "validation_accuracy", "train_macro_f1", "validation_macro_f1",
    )


def family_comparison(df: DataFrame, spec: DatasetSpec, families: Sequence[Variant] = FAMILIES, folds: int = 5) -> DataFrame:
    """Model families on identical folds: quality, fit time and size, mean and population std."""
    table = cross_validate(df, spec, families, folds)
    measures = (
        "fit_seconds", "validation_accuracy", "validation_macro_f1", "validation_cohen_kappa", "train_macro_f1",
        "tree_leaves", "tree_nodes", "coefficients",
    )
    return fold_summary(table, ["variant"], measures, listed=False)


def ablation(df: DataFrame, spec: DatasetSpec, variants: Sequence[Variant], folds: int = 5) -> DataFrame:
    """The same split, folds and classifier with different feature lists.

    ``df`` carries the protocol columns ``split`` and ``fold``. One row per
    variant: hold-out metrics next to cross-validated ones.
    """
    spark = df.sparkSession
    with ExitStack() as stack:
        rows = stack.enter_context(kept(_model_rows(df, spec, "split", "fold")))
        training, held = rows.where("split = 'train'"), rows.where("split = 'test'")
        samples = _samples(stack, training, spec, variants, folds)

        def holdout(variant: Variant):
            return lambda: (variant.name, _cube_rows(
                fit(training, spec, variant, placed=True), variant.name, holdout=held))

        tests = run_fits([holdout(v) for v in variants])
        tasks = [_fold_task(training, spec, v, fold, samples=samples) for v in variants for fold in range(1, folds + 1)]
        table = _fold_table(spark, run_fits(tasks))
    cube = spark.createDataFrame([row for _, rows in tests for row in rows], _RUN)
    test = classification_metrics(cube.withColumnRenamed("run", "variant"), ["variant"])
    names = {v.name: ",".join(v.spec(spec).features) for v in variants}
    listed = spark.createDataFrame(list(names.items()), "variant string, used_features string")
    summary = fold_summary(table, ["variant"], ("validation_accuracy", "validation_macro_f1"), listed=False)
    return listed.join(test, "variant").join(summary, "variant")


def permutation_importance(
    model: FittedModel, held: DataFrame, repeats: int = 30, seed: int = SEED, detail: bool = False, binned: bool | None = None,
) -> DataFrame:
    """Loss of macro-F1 when one feature's values are shuffled over the held-out rows.

    A seeded hash deals the rows into blocks of about ``BLOCK`` rows, whatever
    their number. For every (feature, repeat) the feature's values change places
    inside each block by an order of their own, a hash of seed, feature, repeat
    and row: a random permutation among rows that were put together at random.
    The held-out rows are shuffled once, whatever the number of trials, and no
    group is larger than a block.

    A forest's rows travel as their bins (``forest_bins``): a trial replaces one
    digit of a row's code, and every different code is scored once for all
    trials. Other models, or ``binned=False``, score every row of every trial.
    """
    spec = model.spec
    spark = held.sparkSession
    binned = model.variant.kind == "forest" if binned is None else binned
    keys = ["feature", "repeat"]
    trials = _coded_cube(model, held, repeats, seed) if binned else _scored_cube(model, held, repeats, seed)
    counted = spark.createDataFrame(trials.collect(), trials.schema)
    scores = classification_metrics(counted.fillna({"feature": "", "repeat": -1}), keys)
    base = scores.where("repeat = -1").first()["macro_f1"]
    loss = scores.where("repeat >= 0").select(*keys, (F.lit(base) - F.col("macro_f1")).alias("loss"))
    if detail:
        return loss
    return loss.groupBy("feature").agg(
        F.avg("loss").alias("mean_decrease_macro_f1"), F.stddev_pop("loss").alias("standard_deviation")
    ).orderBy(F.col("mean_decrease_macro_f1").desc(), "feature")


def _blocks(held: DataFrame, spec: DatasetSpec, carried: Sequence[str], seed: int) -> DataFrame:
    """(block, members): the rows dealt into blocks, each with its members in order, written once."""
    blocks = max(1, -(-held.count() // BLOCK))
    hashed = order_hash(f"{seed}:importance", *[F.col(k) for k in spec.key])
    number = F.conv(F.substring(hashed, 1, 15), 16, 10).cast("bigint")
    member = F.struct(hashed.alias("order"), *carried)
    dealt = held.select(F.pmod(number, F.lit(blocks)).alias("block"), member.alias("member"))
    path = shared_dir(held.sparkSession, "blocks")
    files = max(-(-blocks // FILE_BLOCKS), min(blocks, held.sparkSession.sparkContext.defaultParallelism))
    dealt = dealt.repartition(min(files, MOST_FILES), "block")
    dealt.groupBy("block").agg(F.array_sort(F.collect_list("member")).alias("members")).write.parquet(path)
    return held.sparkSession.read.parquet(path)


def _place(seed: int, feature, repeat, order):
    """What a trial sorts a block's rows by."""
    return F.xxhash64(F.lit(str(seed)), feature, repeat, order)


def _pairs(packed: DataFrame, spec: DatasetSpec, repeats: int, seed: int) -> DataFrame:
    """(feature, repeat, own, donor) for each row and trial, and once with nulls and the row itself as donor."""
    trials = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat")) for f in spec.features for r in range(repeats)
    ])
    places = F.transform("members", lambda m: F.struct(
        _place(seed, F.col("trial.feature"), F.col("trial.repeat"), m.order).alias("place"), m.alias("member")))
    turned = F.transform(F.array_sort(places), lambda d: d.member)
    drawn = packed.select("members", F.explode(trials).alias("trial")).select(
        F.col("trial.feature").alias("feature"), F.col("trial.repeat").alias("repeat"),
        F.explode(F.arrays_zip(F.col("members").alias("own"), turned.alias("donor"))).alias("pair"),
    )
    plain = packed.select(F.explode("members").alias("m")).select(
        F.lit(None).cast("string").alias("feature"), F.lit(None).cast("int").alias("repeat"),
        F.struct(F.col("m").alias("own"), F.col("m").alias("donor")).alias("pair"),
    )
    both = drawn.unionByName(plain)
    return both.select("feature", "repeat", F.col("pair.own").alias("own"), F.col("pair.donor").alias("donor"))


def _scored_cube(model: FittedModel, held: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Confusion counts by trial, every row scored in every trial."""
    spec = model.spec
    pairs = _pairs(_blocks(held, spec, [spec.label, *spec.features], seed), spec, repeats, seed)
    shuffled = pairs.select(
        "feature", "repeat", F.col("own")[spec.label].alias(spec.label),
        *[F.when(F.col("feature") == c, F.col("donor")[c]).otherwise(F.col("own")[c]).alias(c) for c in spec.features],
    )
    return confusion_cube(model.predict(shuffled), spec.label, f"predicted_{spec.label}", ["feature", "repeat"])


def _coded_cube(model: FittedModel, held: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Confusion counts by trial: codes are permuted, and each different one is scored once."""
    spec, bins = model.spec, forest_bins(model)
    names = [f"_bin_{i}" for i in range(len(spec.features))]
    packed = _blocks(bins.with_bins(held), spec, [spec.label, *names], seed)
    if len(bins.words) == 1 and math.prod(s.size for s in bins.slots.values()) <= TABLE_CODES:
        return _table_cube(bins, packed, names, repeats, seed)
    pairs = _pairs(packed, spec, repeats, seed)
    chosen = lambda i: F.when(F.col("feature") == spec.features[i], F.col("donor")[names[i]]).otherwise(F.col("own")[names[i]])
    coded = pairs.select("feature", "repeat", F.col("own")[spec.label].alias("actual"), *bins.codes(chosen))
    answers = bins.answers(coded)
    small = answers.count() * (8 * len(bins.words) + 32) <= BROADCAST_BYTES
    answered = coded.join(F.broadcast(answers) if small else answers, bins.words)
    return answered.groupBy("feature", "repeat", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _table_cube(bins: ForestBins, packed: DataFrame, names: Sequence[str], repeats: int, seed: int) -> DataFrame:
    """The same counts where all answers fit one small array: tasks permute and count whole blocks at a time.

    The array is sized by the forest's bins and holds an answer for every code that a trial can make: a row's code with any one
    digit replaced by another row's.
    """
    spec, spark, (word,) = bins.model.spec, packed.sparkSession, bins.words
    classes, slots = list(spec.class_order), list(bins.slots.values())
    members = packed.select("block", F.explode("members").alias("m"))
    codes = members.select(*(F.col(f"m.{n}").alias(n) for n in names)).distinct().select(*names, *bins.codes(lambda i: F.col(names[i])))
    known = codes.agg(*(F.collect_set(n).alias(n) for n in names)).first()
    made = codes.select(word)
    for n, slot in zip(names, slots):
        rest = codes.select((F.col(word) - F.col(n) * slot.factor).alias("_rest")).distinct()
        digits = F.array(*(F.lit(d * slot.factor).cast("bigint") for d in sorted(known[n])))
        made = made.unionByName(rest.select("_rest", F.explode(digits).alias("_digit")).select((F.col("_rest") + F.col("_digit")).alias(word)))
    answers = bins.answers(made).select(word, (F.array_position(F.array(*map(F.lit, classes)), F.col("predicted")) - 1).alias("at")).toArrow()
    table = np.full(math.prod(s.size for s in slots), -1, np.int8 if len(classes) < 128 else np.int32)
    table[answers.column(word).to_numpy()] = answers.column("at").to_numpy()
    shared = spark.sparkContext.broadcast(table)
    trials = [(f, r) for f in spec.features for r in range(repeats)]
    places = F.array(*(_place(seed, F.lit(f), F.lit(r), F.col("m.order")) for f, r in trials)).alias("places")
    rows = members.select("block", F.col(f"m.{spec.label}").cast("string").alias("actual"), *(F.col(f"m.{n}").alias(n) for n in names), places)
    counted = _trial_counter(shared, trials, repeats, classes, [s.factor for s in slots])
    cube = rows.mapInArrow(counted, "feature string, repeat int, actual string, predicted string, n bigint")
    return cube.groupBy("feature", "repeat", "actual", "predicted").agg(F.sum("n").alias("n"))


def _trial_counter(shared, trials: list[tuple[str, int]], repeats: int, classes: list[str], factors: list[int]):
    """Counts (feature, repeat, actual, predicted, n) of rows (block, actual, digits, places) that come block after block."""
    import pyarrow.compute as pc

    def blocks(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            number = table.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield table.slice(a, b - a).combine_chunks()
            held = table.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield held.combine_chunks()

    def counted(batches):
        totals = {}
        for rows in blocks(batches):
            names = rows.column("actual").to_pylist()
            labels = list(dict.fromkeys(names))
            label = np.array([labels.index(v) for v in names])
            digits = [rows.column(2 + i).to_numpy() for i in range(len(factors))]
            own = sum(d * f for d, f in zip(digits, factors))
            # Members are in order, so that a stable sort settles equal places as the members' order does.
            places = np.ascontiguousarray(pc.list_flatten(rows.column("places")).to_numpy().reshape(-1, len(trials)).T)
            donors = np.argsort(places, axis=1, kind="stable")
            found = [
                shared.value[(own - d * f)[None, :] + (d * f)[donors[i * repeats : (i + 1) * repeats]]]
                for i, (d, f) in enumerate(zip(digits, factors))
            ]
            # Last come the rows as they are.
            found = np.concatenate([*found, shared.value[own][None, :]])
            cells = (np.arange(len(found))[:, None] * len(labels) + label[None, :]) * len(classes) + found
            counts = np.bincount(cells.ravel(), minlength=len(found) * len(labels) * len(classes))
            for name, part in zip(labels, counts.reshape(len(found), len(labels), len(classes)).transpose(1, 0, 2)):
                totals[name] = totals.get(name, 0) + part
        named = [*trials, (None, None)]
        out = [(*named[t], name, classes[c], int(part[t, c])) for name, part in totals.items() for t, c in zip(*np.nonzero(part))]
        if out:
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["feature", "repeat", "actual", "predicted", "n"])

    return counted
