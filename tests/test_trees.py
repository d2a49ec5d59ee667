"""Trees grown over a table equal trees grown by plain loops over a matrix."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession

from windrose.operators import trees

N, WIDTH = 700, 5


@pytest.fixture(scope="module")
def matrix() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(N, WIDTH)), 2)
    x[:, 4] = rng.integers(0, 3, N)
    return x, np.round(3 * x[:, 0] + np.where(x[:, 1] > 0.3, 5, 0) + x[:, 4] + rng.normal(size=N), 3)


@pytest.fixture(scope="module")
def table(spark: SparkSession, matrix: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(*matrix, strict=True)], "x array<double>, label double").repartition(5).persist()


def plain_extra_tree(x: np.ndarray, y: np.ndarray, t: int, max_depth: int, min_leaf: int, seed: int) -> trees.Tree:
    tree, level = trees.Tree(), [(0, np.arange(len(x)))]
    tried = int(np.sqrt(x.shape[1]))
    for depth in range(max_depth + 1):
        after = []
        for node, rows in level:
            tree.value[node] = y[rows].mean()
            rng = np.random.default_rng([seed, t, node])
            chosen = np.sort(rng.permutation(x.shape[1])[:tried])
            if depth == max_depth or len(rows) < 2 * min_leaf or np.ptp(y[rows]) == 0:
                continue
            low, high = x[rows][:, chosen].min(axis=0), x[rows][:, chosen].max(axis=0)
            cuts = low + rng.random(tried) * (high - low)
            options = []
            for f, c in zip(chosen, cuts, strict=True):
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if min(len(left), len(right)) >= min_leaf:
                    options.append((-(y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right)), f, c, left, right))
            if options:
                _, f, c, left, right = min(options, key=lambda o: o[0])
                a, b = tree.split(node, int(f), float(c))
                after += [(a, left), (b, right)]
        level = after
    return tree


def test_extra_trees_equal_plain_ones(table: DataFrame, matrix: tuple[np.ndarray, np.ndarray]) -> None:
    x, y = matrix
    model = trees.extra_trees(table, WIDTH, n_trees=4, max_depth=5, min_leaf=10, seed=3)
    for t, tree in enumerate(model.trees):
        want = plain_extra_tree(x, y, t, 5, 10, 3)
        assert tree.feature == want.feature and tree.left == want.left
        assert np.allclose(tree.cut, want.cut) and np.allclose(tree.value, want.value)
    assert np.abs(model.predict(x) - y).mean() < np.abs(np.median(y) - y).mean()
    out = model.transform(table).collect()
    assert np.allclose([r.prediction for r in out], model.predict(np.array([r.x for r in out])))


def lower_quantile(values: np.ndarray, q: float) -> float:
    return float(np.sort(values)[max(0, int(np.ceil(q * len(values))) - 1)])


def plain_boosting(x: np.ndarray, y: np.ndarray, q: float, n_trees: int, depth: int, rate: float, min_leaf: int, edges: list[np.ndarray]) -> np.ndarray:
    p = np.full(len(y), lower_quantile(y, q))
    for _ in range(n_trees):
        g = np.where(y > p, -q, 1 - q)
        level = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in level:
                best, parts = 1e-9, None
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                        if min(len(left), len(right)) >= min_leaf:
                            gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[rows].sum() ** 2 / len(rows)
                            if gain > best + 1e-12:
                                best, parts = gain, (left, right)
                after += parts or [rows]
            level = after
        step = np.zeros(len(y))
        for rows in level:
            step[rows] = rate * lower_quantile(y[rows] - p[rows], q)
        p = p + step
    return p


@pytest.mark.parametrize("q", [0.5, 0.9])
def test_boosting_equals_a_plain_version(table: DataFrame, matrix: tuple[np.ndarray, np.ndarray], q: float) -> None:
    x, y = matrix
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 9) / 9)) for f in range(WIDTH)]
    model = trees.boosted_quantile(table, WIDTH, q, n_trees=4, max_depth=3, rate=0.3, min_leaf=20, edges=edges)
    assert np.allclose(model.predict(x), plain_boosting(x, y, q, 4, 3, 0.3, 20, edges))


def test_boosting_lowers_the_loss(table: DataFrame, matrix: tuple[np.ndarray, np.ndarray]) -> None:
    x, y = matrix
    model = trees.boosted_quantile(table, WIDTH, 0.8, n_trees=8, rate=0.3)
    loss = lambda p: np.maximum(0.8 * (y - p), -0.2 * (y - p)).mean()
    assert loss(model.predict(x)) < 0.5 * loss(np.full(N, np.quantile(y, 0.8)))
    assert abs((y <= model.predict(x)).mean() - 0.8) < 0.1


def test_no_rows_and_missing_numbers(spark: SparkSession) -> None:
    none = spark.createDataFrame([], "x array<double>, label double")
    for model in (trees.extra_trees(none, 2, n_trees=2), trees.boosted_quantile(none, 2, n_trees=1)):
        assert model.predict(np.zeros((3, 2))).tolist() == [0.0, 0.0, 0.0]
    odd = spark.createDataFrame([([float("nan"), 1.0], 1.0), ([2.0, 1.0], 5.0)] * 30, "x array<double>, label double")
    assert trees.boosted_quantile(odd, 2, n_trees=1).transform(odd).count() == 60
