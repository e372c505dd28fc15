"""Seeded, stratified and reproducible splits, folds, subsets and permutations.

Membership depends only on (seed, row key): the per-label hash thresholds are
found first, then every row decides on its own. The table itself is never
shuffled or sorted, and re-ordering or re-partitioning it changes nothing.
Row keys must be unique; ``sources.tables.with_row_locator`` makes one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.functions.identity import order_hash
from obslab.operators.ranking import HASH, bucket_counts, positions, select_ranks
from obslab.spec import DatasetSpec

SEED = 42
TEST_FRACTION = 0.25
FOLDS = 5
LEARNING_FRACTIONS = (0.2, 0.4, 0.6, 0.8, 1.0)
_OTHER = "\0other"


def stratified_split(
    df: DataFrame, spec: DatasetSpec, key: Sequence[str] | None = None,
    test_fraction: float = TEST_FRACTION, seed: int = SEED, name: str = "split",
) -> DataFrame:
    """Adds ``split`` in {train, test}: ceil(f*N) test rows, largest-remainder quotas per label."""
    quotas = lambda totals: {label: [n] for label, n in test_quotas(totals, test_fraction).items()}
    return _assign(df, spec, key or spec.key, str(seed), name, quotas, lambda hashed, limits: F.when(
        hashed <= limits[0], "test").otherwise("train"))


def test_quotas(totals: Mapping[str, int], fraction: float) -> dict[str, int]:
    """Proportional test sizes by largest remainder; ties go to the smaller label."""
    size = sum(totals.values())
    wanted = math.ceil(round(size * fraction, 9))
    exact = {label: Fraction(wanted * n, size) for label, n in totals.items()}
    quotas = {label: math.floor(share) for label, share in exact.items()}
    spare = wanted - sum(quotas.values())
    for label in sorted(totals, key=lambda c: (quotas[c] - exact[c], c))[:spare]:
        quotas[label] += 1
    return quotas


def stratified_folds(
    df: DataFrame, spec: DatasetSpec, key: Sequence[str] | None = None,
    folds: int = FOLDS, seed: int = SEED, name: str = "fold", where: Column | None = None,
) -> DataFrame:
    """Adds ``fold`` in 1..k; sizes differ by at most one, overall and within each label.

    Rows outside ``where`` take no part and get null.

    Dealing the label-sorted rows round-robin fixes how many rows of a label a
    fold gets; which ones is decided by hash order.
    """
    ranks = lambda totals: {label: upto[:-1] for label, upto in fold_quotas(totals, folds).items()}
    return _assign(df, spec, key or spec.key, f"{seed}:fold", name, ranks, lambda hashed, limits: (
        F.lit(1) + _passed(hashed, limits)), where)


def fold_quotas(totals: Mapping[str, int], folds: int) -> dict[str, list[int]]:
    """Per label the last rank of each fold."""
    quotas, start = {}, 0
    for label in sorted(totals):
        end = start + totals[label]
        sizes = [len(range(start + (fold - start) % folds, end, folds)) for fold in range(folds)]
        quotas[label] = list(accumulate(sizes))
        start = end
    return quotas


def nested_subsets(
    df: DataFrame, spec: DatasetSpec, fractions: Sequence[float] = LEARNING_FRACTIONS,
    key: Sequence[str] | None = None, seed: int | str = SEED, name: str = "smallest", where: Column | None = None,
) -> DataFrame:
    """Adds the index of the smallest fraction whose subset holds the row.

    Subset i is every row with ``smallest <= i``, so subsets are nested by
    construction; each label gives max(1, round-half-even(f*n)) rows. Rows
    outside ``where`` take no part and get null.
    """
    found = subset_rule(df, spec, fractions, key, seed, where)
    return df.withColumn(name, F.lit(None).cast("string") if found is None else found)


def subset_rule(
    df: DataFrame, spec: DatasetSpec, fractions: Sequence[float], key: Sequence[str] | None = None, seed: int | str = SEED,
    where: Column | None = None,
) -> Column | None:
    """The expression of ``nested_subsets`` for one row, so that several can be found at the same time."""
    if any(not 0 < f <= 1 for f in fractions) or list(fractions) != sorted(fractions):
        raise ValueError("fractions must ascend within (0, 1]")
    ranks = lambda totals: {label: [max(1, round(f * n)) for f in fractions] for label, n in totals.items()}
    return _rule(df, spec, key or spec.key, subset_seed(seed), ranks, _passed, where)


def subset_seed(seed: int | str) -> str:
    return f"{seed}:subset"


def explode_subsets(subsets: DataFrame, fractions: Sequence[float] = LEARNING_FRACTIONS, name: str = "smallest") -> DataFrame:
    """Long form: one row per (row, fraction) membership."""
    members = F.slice(F.array(*[F.lit(float(f)) for f in fractions]), F.col(name) + 1, len(fractions))
    return subsets.withColumn("fraction", F.explode(members)).drop(name)


def permuted_column(df: DataFrame, column: str, key: Sequence[str], seed: int | str = SEED, name: str | None = None) -> DataFrame:
    """Adds ``column`` shuffled over all rows: row at hash rank i gets the value of rank i in another order."""
    ranked = positions(_hashed(df, key, f"{seed}:to"))
    donors = positions(_hashed(df.select(*key, column), key, f"{seed}:from")).select(
        "position", F.col(column).alias(name or f"{column}_permuted")
    )
    return ranked.join(donors, "position").drop("position", HASH)


def _hashed(df: DataFrame, key: Sequence[str], seed: str) -> DataFrame:
    if not key:
        raise ValueError("a unique row key is needed")
    return df.withColumn(HASH, order_hash(seed, *(F.col(k) for k in key)))


def _passed(hashed: Column, limits: Sequence[Column]) -> Column:
    """Number of thresholds below the row's hash."""
    return sum((F.when(hashed > limit, 1).otherwise(0) for limit in limits), F.lit(0))


def _assign(
    df: DataFrame, spec: DatasetSpec, key: Sequence[str], seed: str, name: str,
    ranks: Callable[[dict[str, int]], dict[str, list[int]]],
    rule: Callable[[Column, list[Column]], Column], where: Column | None = None,
) -> DataFrame:
    """Find the thresholds (a few strings per label of the spec), then decide row by row."""
    rule_of_row = _rule(df, spec, key, seed, ranks, rule, where)
    return df.withColumn(name, F.lit(None).cast("string") if rule_of_row is None else rule_of_row)


def _rule(
    df: DataFrame, spec: DatasetSpec, key: Sequence[str], seed: str, ranks: Callable[[dict[str, int]], dict[str, list[int]]],
    rule: Callable[[Column, list[Column]], Column], where: Column | None = None,
) -> Column | None:
    """The expression that decides for each row; null if there is nothing to decide."""
    label, hashed = spec.label, _hashed(df, key, seed)
    taken = F.col(label).isNotNull() if where is None else F.col(label).isNotNull() & where
    # Labels outside the spec make one group, so that what the driver holds is sized by the spec.
    named = F.when(F.col(label).isin(*spec.labels), F.col(label)).otherwise(_OTHER).alias(label) if spec.labels else F.col(label)
    rows = hashed.where(taken).select(named, HASH)
    counts = bucket_counts(rows, label)
    if _OTHER in counts:
        raise ValueError(f"{label}: {sum(counts[_OTHER].values())} rows have labels outside {list(spec.labels)}")
    wanted = ranks({name: sum(buckets.values()) for name, buckets in counts.items()})
    found = select_ranks(rows, label, counts, wanted)
    cuts = len(next(iter(found.values()), []))
    limits = [_by_label(label, {name: values[i] for name, values in found.items()}) for i in range(cuts)]
    return F.when(taken, rule(order_hash(seed, *(F.col(k) for k in key)), limits)) if limits else None


def _by_label(label: str, values: Mapping[str, str]) -> Column:
    chain = F
    for name, value in sorted(values.items()):
        chain = chain.when(F.col(label) == F.lit(name), F.lit(value))
    return chain
