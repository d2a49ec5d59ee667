"""Rows that are alike go to learners and measures as one row with a weight, and the results are those of all rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.operators import learning, metrics, trees


@pytest.fixture(scope="module")
def both(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with weights, and the same rows repeated."""
    rng = np.random.default_rng(11)
    rows = [([float(i % 13), float(i // 13)], float(rng.integers(-40, 110)), int(rng.integers(1, 9))) for i in range(156)] + [([3.0, 20.0], 7.0, 9001)]
    few = spark.createDataFrame(rows, "x array<double>, label double, weight bigint").repartition(3).persist()
    return few, spark.createDataFrame([r[:2] for r in rows for _ in range(r[2])], "x array<double>, label double").repartition(4).persist()


def same(a: trees.TreesModel, b: trees.TreesModel) -> bool:
    return a.start == b.start and all(p.feature == q.feature and p.left == q.left and np.allclose(p.cut, q.cut) and np.allclose(p.value, q.value) for p, q in zip(a.trees, b.trees, strict=True))


def test_weights_stand_for_copies(both: tuple[DataFrame, DataFrame]) -> None:
    few, all_ = both
    assert same(*(trees.extra_trees(df, 2, n_trees=3, max_depth=4, min_leaf=5) for df in (few, all_)))
    edges = [np.arange(12.0), np.arange(12.0)]
    assert same(*(trees.boosted_quantile(df, 2, 0.5, n_trees=3, max_depth=3, rate=0.3, min_leaf=5, edges=edges) for df in (few, all_)))
    for a, b in zip(*(trees.bin_edges(df, 2, 9) for df in (few, all_)), strict=True):
        assert a.tolist() == b.tolist()


def test_measures_of_counted_rows(both: tuple[DataFrame, DataFrame]) -> None:
    few, all_ = (df.withColumn("key", F.get("x", F.lit(0)) % 3).withColumn("p", F.get("x", F.lit(1)) * 4) for df in both)
    a = metrics.regression(few, "label", "p", [["key"], []], "weight").orderBy("key").collect()
    b = metrics.regression(all_, "label", "p", [["key"], []]).orderBy("key").collect()
    assert len(a) == len(b) == 4 and all(np.allclose(p[1:], q[1:]) for p, q in zip(a, b, strict=True))
    constant = few.select(F.lit(0.1).alias("label"), "p", "weight")
    assert metrics.regression(constant, "label", "p", weight="weight").first().r2 is None


def test_learners_see_copies_once(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """However often rows are repeated, learners get the distinct ones, and the metrics are those of all rows."""
    seen = []

    def grown(rows: DataFrame, width: int) -> trees.TreesModel:
        seen.append(rows.count())
        return trees.TreesModel([], 1.0)

    monkeypatch.setitem(learning.TREE_LEARNERS, "extra_trees", grown)
    rows = spark.range(12).select((F.col("id") % 4).alias("a"), (F.col("id") % 3).cast("string").alias("w"), (F.col("id") * 5).alias("y")).crossJoin(spark.range(40).select())
    data = learning.as_inputs(rows, ["a"], ["w"], "y")
    out = learning.ablation(data, data, {"a": (["a"], []), "both": (["a"], ["w"])}, ["median", "ridge", "extra_trees"]).collect()
    assert seen == [12, 12]
    assert [(r.features, r.model, r.n) for r in out] == [(f, m, 480) for f in ("a", "both") for m in ("median", "ridge", "extra_trees")]
    plain = metrics.regression(learning.predicted(learning.fitted(data, "ridge", ["a"], ["w"]), data), "label", "prediction").first()
    assert np.allclose(tuple(out[4])[2:], tuple(plain))
    none = learning.ablation(data, data.limit(0), {"a": (["a"], [])}, ["median"]).collect()
    assert [tuple(r) for r in none] == [("a", "median", 0, None, None, None, None)]
