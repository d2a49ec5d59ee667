"""Delay models: feature sets, preparation of columns, a split in time, baselines and Spark's own regressors, ablation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrose.functions.rules import HIGH_TARGET, LOW_TARGET
from windrose.operators import trees
from windrose.operators.metrics import regression
from windrose.operators.profile import quantiles, quantiles_of

SEED = 42
#: Categories of a column are kept by name; the null and those that training has not seen have a place of their own.
UNKNOWN = "missing"
#: How many rows a row stands for.
WEIGHT = "_rows"
METRICS = ["n", "mae", "medae", "rmse", "r2"]
#: Counted rows that are worth a task.
TASK_ROWS = 8192


def available(df: DataFrame, wanted: Sequence[str], leaks: Sequence[str] = ()) -> list[str]:
    """The wanted columns that are there and tell nothing of the outcome."""
    return [c for c in wanted if c in df.columns and c not in leaks]


def split_in_time(df: DataFrame, ts: str, at: str) -> tuple[DataFrame, DataFrame]:
    moment = F.lit(at).cast("timestamp_ntz")
    return df.filter(F.col(ts) < moment), df.filter(F.col(ts) >= moment)


def prepared(numbers: Sequence[str], words: Sequence[str], scale: bool = True) -> Pipeline:
    """Medians for missing numbers, one place for each word, all in one vector ``features``."""
    stages = [Imputer(strategy="median", inputCols=[*numbers], outputCols=[f"{c}_filled" for c in numbers], relativeError=0.0001)] if numbers else []
    if words:
        stages += [StringIndexer(inputCols=[*words], outputCols=[f"{c}_index" for c in words], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=[f"{c}_index" for c in words], outputCols=[f"{c}_places" for c in words], dropLast=False)]
    parts = [*(f"{c}_filled" for c in numbers), *(f"{c}_places" for c in words)]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features_raw" if scale else "features"))
    return Pipeline(stages=[*stages, StandardScaler(inputCol="features_raw", outputCol="features", withStd=True)] if scale else stages)


def as_inputs(df: DataFrame, numbers: Sequence[str], words: Sequence[str], target: str) -> DataFrame:
    """``df`` with numbers as doubles, null words named, and the clipped target as ``label``."""
    label = F.col(target).cast("double")
    clipped = F.when(label < LOW_TARGET, float(LOW_TARGET)).when(label > HIGH_TARGET, float(HIGH_TARGET)).otherwise(label)
    return df.withColumns({**{c: F.col(c).cast("double") for c in numbers}, **{c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in words}, "label": clipped}).filter("label IS NOT NULL")


def regressors(**more: str) -> dict[str, object]:
    common = {"featuresCol": "features", "labelCol": "label", **more}
    return {"ridge": LinearRegression(regParam=10.0, elasticNetParam=0.0, **common), "forest": RandomForestRegressor(numTrees=20, maxDepth=6, seed=SEED, **common), "boosted_absolute": GBTRegressor(lossType="absolute", maxIter=10, maxDepth=4, seed=SEED, **common), "boosted_squared": GBTRegressor(lossType="squared", maxIter=10, maxDepth=4, seed=SEED, **common)}


#: Those of ``regressors`` that draw rows.
BOOTSTRAPS = {"forest"}
#: Learners of ``operators.trees``, by name.
TREE_LEARNERS = {"extra_trees": trees.extra_trees, "boosted_quantile": trees.boosted_quantile}


@dataclass
class PreparedTrees:
    """Trees behind the preparation of their columns."""

    preparation: PipelineModel
    trees: trees.TreesModel

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(self.preparation.transform(rows).withColumn("x", vector_to_array("features"))).drop("x")


def _grown(name: str, rows: DataFrame, **arguments: object) -> trees.TreesModel:
    """Trees on prepared rows, which may have weights."""
    weights = [F.col(WEIGHT).alias("weight")] if WEIGHT in rows.columns else []
    rows = rows.select(vector_to_array("features").alias("x"), "label", *weights).persist()
    try:
        width = rows.select(F.size("x")).first()
        return TREE_LEARNERS[name](rows, width[0] if width else 1, **arguments)
    finally:
        rows.unpersist()


def fitted(train: DataFrame, name: str, numbers: Sequence[str], words: Sequence[str], **arguments: object) -> PipelineModel | PreparedTrees:
    """A model of one of ``regressors`` or ``TREE_LEARNERS``; the latter take arguments."""
    if name in TREE_LEARNERS:
        preparation = prepared(numbers, words, scale=False).fit(train)
        return PreparedTrees(preparation, _grown(name, preparation.transform(train).select("features", "label"), **arguments))
    steps = prepared(numbers, words, scale=name == "ridge").getStages()
    return Pipeline(stages=[*steps, regressors()[name]]).fit(train)


def predicted(model: Transformer | PreparedTrees, rows: DataFrame) -> DataFrame:
    """Predictions kept within the range of the target."""
    p = F.col("prediction")
    return model.transform(rows).withColumn("prediction", F.when(p < LOW_TARGET, float(LOW_TARGET)).when(p > HIGH_TARGET, float(HIGH_TARGET)).otherwise(p))


def median_baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row with the median label of the training rows."""
    middle = quantiles_of(train, [], "label", [0.5]).withColumnRenamed("p50", "prediction")
    return rows.join(F.broadcast(middle), F.lit(True))


def counted(rows: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """The distinct rows of the columns and the label, and how many rows (or how much of ``weight``) each stands for."""
    return rows.groupBy(*columns, "label").agg((F.count("*") if weight is None else F.sum(weight)).alias(WEIGHT))


def _learned(name: str, rows: DataFrame, groups: DataFrame, **arguments: object) -> Transformer | trees.TreesModel:
    """A model on prepared ``rows``, or on ``groups`` that stand for them, where its learner takes weights for copies."""
    if name in TREE_LEARNERS:
        return _grown(name, groups, **arguments)
    # A bootstrap draws rows: copies of one row are drawn each by itself.
    return regressors()[name].fit(rows) if name in BOOTSTRAPS else regressors(weightCol=WEIGHT)[name].fit(groups)


def _answered(name: str, model: Transformer | trees.TreesModel, groups: DataFrame) -> DataFrame:
    rows = groups.withColumn("x", vector_to_array("features")) if name in TREE_LEARNERS else groups
    return predicted(model, rows)


def ablation(train: DataFrame, test: DataFrame, sets: dict[str, tuple[Sequence[str], Sequence[str]]], names: Sequence[str], **learner: dict) -> DataFrame:
    """One row of metrics for each feature set and model; ``learner`` has arguments of tree learners by their names.

    Rows that are alike in the features and the label are counted, once for all sets, and go on as one row with a weight,
    which gives the same sums; only the preparation and bootstraps go through the training rows themselves. A set is prepared
    once for all models. It is not scaled, as ridge regression scales by itself and its penalty is on what is scaled. All
    predictions are measured in one job.
    """
    used = list(dict.fromkeys(c for numbers, words in sets.values() for c in (*numbers, *words)))
    train = train.select(*used, "label").persist()
    held, parts = [train], []
    try:
        past, later = (counted(df, used).persist() for df in (train, test))
        held += [past, later]
        tasks = [df.count() // TASK_ROWS + 1 for df in (past, later)]
        past, later = (df.coalesce(n) for df, n in zip((past, later), tasks, strict=True))
        middle = quantiles(counted(past, [], WEIGHT), [], "label", WEIGHT, [0.5]).first() if "median" in names else None
        for which, (numbers, words) in sets.items():
            preparation = prepared(numbers, words, scale=False).fit(train)
            known, asked = (preparation.transform(counted(df, [*numbers, *words], WEIGHT).coalesce(n)).select("features", "label", WEIGHT).persist() for df, n in zip((past, later), tasks, strict=True))
            held += [known, asked]
            rows = preparation.transform(train).select("features", "label")
            for name in names:
                if name == "median":
                    part = asked.withColumn("prediction", F.lit(middle[0] if middle else None).cast("double"))
                else:
                    part = _answered(name, _learned(name, rows, known, **learner.get(name, {})), asked)
                parts.append(part.select(F.lit(which).alias("features"), F.lit(name).alias("model"), "label", "prediction", WEIGHT))
        if not parts:
            raise ValueError("no feature set or no model is named")
        scored = reduce(DataFrame.unionByName, parts).coalesce(2 * tasks[1]).persist()
        held.append(scored)
        found = regression(scored, "label", "prediction", [["features", "model"]], WEIGHT).select("features", "model", *METRICS)
        measured = {(r.features, r.model): tuple(r) for r in found.collect()}
    finally:
        for df in reversed(held):
            df.unpersist()
    nothing = (0, *[None] * (len(METRICS) - 1))
    return train.sparkSession.createDataFrame([measured.get((which, name), (which, name, *nothing)) for which in sets for name in names], found.schema)
