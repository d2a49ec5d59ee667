"""Agreement, classification, ranking and regression measures as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrose.operators.profile import joined_by, quantiles, with_below


def majority(votes: Sequence[Column], conflict: str = "CONFLICT") -> Column:
    """What at least two of three raters say."""
    a, b, c = votes
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(conflict)


def fleiss_kappa(ratings: DataFrame, item: str, label: str) -> DataFrame:
    """One row: kappa over (item, label) rows, every item with the same number of ratings of at least two."""
    cells = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).agg(F.avg(F.try_divide(F.col("same"), F.col("r") * (F.col("r") - 1))).alias("observed"))
    shares = cells.groupBy(label).agg(F.sum("n").alias("n")).agg(F.try_divide(F.sum(F.col("n") * F.col("n")).cast("double"), F.sum("n").cast("double") * F.sum("n")).alias("expected"))
    return items.join(F.broadcast(shares), F.lit(True)).select("observed", "expected", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per class: support, precision, recall and F1, 0 where a ratio has no denominator."""
    both = F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))
    hit = (F.col(truth) == F.col(predicted)).cast("int")
    rows = df.select(hit.alias("hit"), F.explode(both).alias("x")).select("hit", "x.*")
    sums = rows.groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("called"), F.sum(F.col("hit") * F.col("t")).alias("right"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("right").cast("double"), F.col("called")), ratio(F.col("right").cast("double"), F.col("support"))
    return sums.select("label", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def auc(df: DataFrame, truth: str, score: str, on: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by ranks, ties averaged; null with one class only. Ranks come from counts by score."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*on, score).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    ranked = with_below(counts, on, score, "n").withColumn("rank", F.col("below") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*on).agg(F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    return sums.select(*on, F.try_divide(F.col("ranks") - pos * (pos + 1) / 2, pos * neg).alias("auc"))


def _sums(truth: str, predicted: str, weight: str | None = None) -> list[Column]:
    error, square = F.abs(F.col(truth) - F.col(predicted)), F.pow(F.col(truth) - F.col(predicted), F.lit(2))
    if weight is None:
        n, mean, squares, spread = F.count("*"), F.avg(error), F.sum(square), F.var_pop(truth) * F.count(truth)
    else:
        y, w = F.col(truth), F.col(weight)
        known = F.when(error.isNotNull(), w)
        n, mean, squares = F.sum(w), F.try_divide(F.sum(w * error), F.sum(known)), F.sum(w * square)
        # A constant has no spread, whatever the sums round to.
        spread = F.when(F.min(y) == F.max(y), 0.0).otherwise(F.sum(w * y * y) - F.pow(F.sum(w * y), F.lit(2)) / F.sum(F.when(y.isNotNull(), w)))
    return [n.alias("n"), mean.alias("mae"), F.sqrt(squares / n).alias("rmse"), (1 - F.try_divide(squares, spread)).alias("r2")]


def regression(rows: DataFrame, truth: str, predicted: str, sets: Sequence[Sequence[str]] = ((),), weight: str | None = None) -> DataFrame:
    """MAE, median error, RMSE and R2 by each of the sets of keys; a key that a set has not got is null there. A row stands for
    as many as its ``weight`` says.

    The median comes from counts of errors in ordered parts, so no task holds the errors of a key.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    number = lambda s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
    if keys:
        sums = rows.groupingSets([list(s) for s in sets], *keys).agg(F.grouping_id().cast("bigint").alias("_set"), *_sums(truth, predicted, weight))
    else:
        sums = rows.agg(*_sums(truth, predicted, weight)).withColumn("_set", F.lit(0).cast("bigint"))
    counts = rows.groupBy(*keys, F.abs(F.col(truth) - F.col(predicted)).alias("_error")).agg((F.count("*") if weight is None else F.sum(weight)).alias("_m"))
    kinds = dict(rows.dtypes)
    copies = F.array(*(F.struct(F.lit(number(s)).cast("bigint").alias("_set"), *((F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys)) for s in sets))
    counts = counts.select("_error", "_m", F.explode(copies).alias("_x")).groupBy("_x._set", *(f"_x.{k}" for k in keys), "_error").agg(F.sum("_m").alias("_m"))
    middle = quantiles(counts, ["_set", *keys], "_error", "_m", [0.5]).withColumnRenamed("p50", "medae")
    return joined_by(sums, middle, ["_set", *keys]).select(*keys, "n", "mae", "medae", "rmse", "r2")
