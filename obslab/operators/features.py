"""Feature preparation on Spark ML: one-hot categories, scaling, PCA."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obslab.spec import DatasetSpec

FEATURES = "features"


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation per column (1 where a column is constant)."""

    mean: dict[str, float]
    scale: dict[str, float]


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """One aggregate pass; two numbers per column reach the driver."""
    row = df.agg(*[
        f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))
    ]).first()
    return Scaling(
        {c: row[f"m{i}"] for i, c in enumerate(columns)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)},
    )


def standardise(df: DataFrame, columns: Sequence[str], scaling: Scaling, suffix: str = "_std") -> DataFrame:
    return df.withColumns({
        f"{c}{suffix}": (F.col(c) - F.lit(scaling.mean[c])) / F.lit(scaling.scale[c]) for c in columns
    })


def fit_features(train: DataFrame, spec: DatasetSpec, scaled: bool = False) -> PipelineModel:
    """Feature pipeline learnt from the training rows only.

    Missing categories become the fill value. A category unseen in training
    gives all zeros. Everything that is not a feature is passed by.
    """
    selected = ["*"]
    filled = {c: f"{c}__filled" for c in spec.categorical}
    selected += [f"COALESCE(CAST(`{c}` AS STRING), '{spec.fill}') AS `{f}`" for c, f in filled.items()]
    inputs = list(spec.numeric)
    if scaled:
        scaling = fit_scaling(train, spec.numeric)
        inputs = [f"{c}__std" for c in spec.numeric]
        selected += [
            f"(`{c}` - ({scaling.mean[c]!r}D)) / ({scaling.scale[c]!r}D) AS `{c}__std`" for c in spec.numeric
        ]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(selected)} FROM __THIS__")]
    if filled:
        index = [f"{c}__index" for c in filled]
        onehot = [f"{c}__onehot" for c in filled]
        stages += [
            StringIndexer(inputCols=list(filled.values()), outputCols=index,
                          stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=index, outputCols=onehot, dropLast=True),
        ]
        inputs += onehot
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Pipeline(stages=stages).fit(train)


def onehot_columns(model: PipelineModel, spec: DatasetSpec) -> list[str]:
    """Names of the assembled inputs in vector order."""
    names = list(spec.numeric)
    if spec.categorical:
        indexer = model.stages[1]
        for column, values in zip(spec.categorical, indexer.labelsArray):
            names += [f"{column}_{v}" for v in values]
    return names


def onehot_table(model: PipelineModel, df: DataFrame, spec: DatasetSpec, kept: Sequence[str]) -> DataFrame:
    """The assembled features as one double column per input."""
    values = vector_to_array(FEATURES)
    names = onehot_columns(model, spec)
    return model.transform(df).select(*kept, *[values[i].alias(n) for i, n in enumerate(names)])


@dataclass(frozen=True)
class Components:
    """PCA of standardised training rows; its size is columns squared."""

    columns: tuple[str, ...]
    pipeline: PipelineModel
    n_rows: int
    loadings: list[list[float]]
    ratios: list[float]
    singular_values: list[float]

    @property
    def signs(self) -> list[float]:
        return [1.0 if max(l, key=abs) >= 0 else -1.0 for l in self.pipeline.stages[-1].pc.toArray().T.tolist()]


def fit_pca(train: DataFrame, columns: Sequence[str], k: int) -> Components:
    """Components, explained variance and singular values of standardised rows.

    Each component's largest loading is made positive, because the sign of an
    eigenvector is arbitrary. The covariance is summed on the executors; only
    the columns-squared matrix is decomposed on the driver.
    """
    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol=FEATURES, withMean=True, withStd=True),
        PCA(k=k, inputCol=FEATURES, outputCol="scores"),
    ]
    model = Pipeline(stages=stages).fit(train.select(*columns))
    n = train.count()
    ratios = [float(v) for v in model.stages[2].explainedVariance.toArray()]
    # The variances of standardised columns add up to the number of columns that vary.
    varied = sum(1 for s in model.stages[1].std.toArray() if s > 0)
    singular = [(r * varied * n) ** 0.5 for r in ratios]
    found = Components(tuple(columns), model, n, [], ratios, singular)
    matrix = model.stages[2].pc.toArray().T.tolist()
    loadings = [[sign * v for v in loading] for sign, loading in zip(found.signs, matrix)]
    return replace(found, loadings=loadings)


def pca_report(train: DataFrame, components: Components) -> DataFrame:
    """One row per component: variance shares, singular value and its strongest loading."""
    total, rows = 0.0, []
    for i, (ratio, value, loading) in enumerate(
        zip(components.ratios, components.singular_values, components.loadings), start=1
    ):
        total += ratio
        strongest = max(range(len(loading)), key=lambda j: abs(loading[j]))
        rows.append((i, ratio, total, value, components.columns[strongest], loading))
    schema = (
        "component int, explained_variance_ratio double, cumulative_ratio double, "
        "singular_value double, strongest_column string, loadings array<double>"
    )
    return train.sparkSession.createDataFrame(rows, schema)


def pca_scores(df: DataFrame, components: Components, kept: Sequence[str]) -> DataFrame:
    """Coordinates of every row, in population standard deviations as fitted."""
    # Spark scales by the sample deviation; this factor turns it into the population one.
    factor = (components.n_rows / max(1, components.n_rows - 1)) ** 0.5
    values = vector_to_array("scores")
    return components.pipeline.transform(df).select(*kept, *[
        (values[i] * F.lit(sign * factor)).alias(f"pc{i + 1}") for i, sign in enumerate(components.signs)
    ])
