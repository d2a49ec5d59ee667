"""Delay models on the flights of the event table."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions.rules import standard_turnaround
from windrose.functions.times import daypart, is_peak, minutes_between
from windrose.operators import learning, metrics, serving
from windrose.plans.flight_queries import FLIGHTS, flights
from windrose.plans.source_queries import folder
from windrose.registry import register

SPLIT = "2024-01-02 06:00:00"
NUMBERS, WORDS = ["hour", "weekday", "standard_turnaround", "is_peak", "sparse"], ["airport", "iata", "aircraft", "category", "daypart"]
#: What tells the outcome, or stands for single flights.
LEAKS = ("actual", "flight_no", "airline", "tail", "status", "runway", "target")
FEATURE_SETS = {"base": (NUMBERS[:2], WORDS[:2]), "all": (NUMBERS, WORDS)}


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flights(spark, sf_dir).filter("mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL")
    at = F.col("scheduled")
    rows = rows.withColumn("target", minutes_between(F.col("actual"), at))
    return rows.withColumns({"hour": F.hour(at), "weekday": F.weekday(at), "standard_turnaround": standard_turnaround(F.col("aircraft")), "is_peak": is_peak(at).cast("int"), "sparse": F.when(F.col("row_id") % 3 == 0, F.col("row_id") % 50), "daypart": daypart(F.hour(at))})


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf_dir)
    numbers, words = (learning.available(rows, x, LEAKS) for x in (NUMBERS, WORDS))
    return learning.split_in_time(learning.as_inputs(rows, numbers, words, "target"), "scheduled", SPLIT)


@register("median_baseline", FLIGHTS + f""",
d AS (SELECT scheduled, least(720, greatest(-60, (epoch_us(actual) - epoch_us(scheduled)) / 60000000.0)) AS y FROM flights WHERE mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL),
m AS (SELECT median(y) AS p FROM d WHERE scheduled < TIMESTAMP '{SPLIT}')
SELECT count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(median(abs(y - p)), 6) AS medae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) AS r2 FROM d, m WHERE scheduled >= TIMESTAMP '{SPLIT}'""")
def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _halves(spark, sf_dir)
    found = metrics.regression(learning.median_baseline(train, test), "label", "prediction")
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("mae", "medae", "rmse", "r2")))


@register("time_split_profile", FLIGHTS + f"""
SELECT scheduled < TIMESTAMP '{SPLIT}' AS is_train, count(*) AS n, min(scheduled) AS low, max(scheduled) AS high FROM flights WHERE mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL GROUP BY 1""")
def time_split_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _halves(spark, sf_dir)
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))
    return both.groupBy("is_train").agg(F.count("*").alias("n"), F.min("scheduled").alias("low"), F.max("scheduled").alias("high"))


@register("prepared_vectors", FLIGHTS + f""",
d AS (SELECT airport, hour(scheduled) AS h, scheduled < TIMESTAMP '{SPLIT}' AS is_train FROM flights WHERE mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL),
s AS (SELECT stddev_samp(h) AS sd FROM d WHERE is_train)
SELECT airport, h::INTEGER AS hour, count(*) AS n, round(h / sd, 6) AS scaled, list_position(['DAD', 'HAN', 'SGN'], airport)::INTEGER AS place FROM d, s WHERE NOT is_train GROUP BY airport, h, sd""")
def prepared_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preparation makes of the hour (scaled) and the airport (the place of its 1) of the test rows."""
    from pyspark.ml.functions import vector_to_array

    train, test = _halves(spark, sf_dir)
    rows = learning.prepared(["hour"], ["airport"]).fit(train).transform(test).select("airport", F.col("hour").cast("int").alias("hour"), vector_to_array("features").alias("x"))
    tail = F.slice("x", 2, 3)
    place = F.array_position(F.transform(tail, lambda v: (v > 0).cast("int")), 1).cast("int")
    return rows.groupBy("airport", "hour", F.round(F.element_at("x", 1), 6).alias("scaled"), place.alias("place")).agg(F.count("*").alias("n"))


@register("model_ablation")
def model_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each feature set and model on the later flights; trees and descent have no form in SQL."""
    train, test = _halves(spark, sf_dir)
    few = {"extra_trees": {"n_trees": 20, "max_depth": 4}, "boosted_quantile": {"n_trees": 4, "max_depth": 3, "rate": 0.3}}
    return learning.ablation(train, test, FEATURE_SETS, ["median", "ridge", "forest", "boosted_absolute", "boosted_squared", "extra_trees", "boosted_quantile"], **few)


@register("serving_vectors", FLIGHTS + f"""
SELECT count(*) AS n, 0::BIGINT AS n_other_vectors, 0::BIGINT AS n_other_predictions FROM flights WHERE mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL AND scheduled >= TIMESTAMP '{SPLIT}'""")
def serving_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle that was written and read again makes the vectors and predictions of the preparation that it was taken from."""
    from pyspark.ml.functions import vector_to_array

    train, test = _halves(spark, sf_dir)
    path, model = folder(spark), learning.fitted(train, "extra_trees", NUMBERS, WORDS, n_trees=5, max_depth=3)
    serving.bundled(model).save(spark, path)
    bundle = serving.load(spark, path)
    rows = learning.predicted(model, test).withColumnRenamed("prediction", "p")
    rows = rows.withColumn("v", vector_to_array("features"))
    served = learning.predicted(bundle.model, bundle.vectors(rows))
    return served.agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("v")).alias("n_other_vectors"), F.count_if(F.abs(F.col("p") - F.col("prediction")) > 1e-9).alias("n_other_predictions"))


@register("model_round_trip", FLIGHTS + f"""
SELECT count(*) AS n, 0::BIGINT AS n_differing FROM flights WHERE mode = 'departure' AND actual IS NOT NULL AND scheduled IS NOT NULL AND scheduled >= TIMESTAMP '{SPLIT}'""")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline written to the shared folder and read again predicts the same."""
    train, test = _halves(spark, sf_dir)
    path = folder(spark)
    model = learning.fitted(train, "ridge", NUMBERS, WORDS)
    model.write().save(path)
    first = learning.predicted(model, test).select("row_id", F.col("prediction").alias("a"))
    again = learning.predicted(PipelineModel.load(path), test).select("row_id", F.col("prediction").alias("b"))
    return first.join(again, "row_id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-9).alias("n_differing"))
