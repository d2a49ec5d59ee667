"""Regression trees that Spark's own library lacks: extremely random ones, and boosted ones for a quantile.

Trees grow level by level over the whole table. Every level is a pass in which each task sends its rows down the trees as far
as they have grown and adds up, for each open node, what the next cuts are chosen by; Spark adds the tasks' sums together,
and what reaches the driver is a row for each open node and candidate, a number that the parameters bound. Rows are never
moved; they need ``x``, an array of numbers of one length, and ``label``. A missing number goes to the right. A row may stand
for several alike, as many as its ``weight`` says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """Nodes by number, 0 being the root: where to cut (feature -1 for none), the left child (the right one is next), the value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: float) -> tuple[int, int]:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, left
        for to, start in ((self.feature, -1), (self.cut, 0.0), (self.left, 0), (self.value, 0.0)):
            to.extend([start, start])
        return left, left + 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of ``x`` ends in."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows := rows[feature[node[rows]] >= 0]):
            at = node[rows]
            node[rows] = left[at] + ~(x[rows, feature[at]] <= cut[at])
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(x)]


@dataclass
class TreesModel:
    """``start`` and the sum or the mean of the trees' values."""

    trees: list[Tree]
    start: float = 0.0
    mean: bool = False

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.predict(x)
        return self.start + (total / max(1, len(self.trees)) if self.mean else total)

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prediction``."""
        model = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predicted(x):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(model.value.predict(np.stack(x.to_numpy()).astype(float)) if len(x) else np.zeros(0))

        predicted.__annotations__.clear()
        return rows.withColumn("prediction", predicted("x"))


#: Copies of a row that are held at once.
COPIES = 4096


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    width = len(x[0]) if len(x) else 0
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float), batch.column("label").to_numpy(zero_copy_only=False)


def _inputs(rows: DataFrame) -> DataFrame:
    return rows.select("x", "label", (F.col("weight") if "weight" in rows.columns else F.lit(1)).cast("bigint").alias("weight"))


def _each(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns in as many rows as the weights say, for aggregates that take no weights."""
    if "weight" not in rows.columns:
        return rows.select(*columns)
    parts = rows.filter("weight > 0").select(*columns, "weight", F.explode(F.expr(f"sequence(0L, (weight - 1) div {COPIES})")).alias("_part"))
    return parts.select(*columns, F.explode(F.expr(f"array_repeat(true, cast(least({COPIES}, weight - _part * {COPIES}) as int))")).alias("_copy")).drop("_copy")


def _summed(rows: DataFrame, add: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], sums: int, extremes: int = 0) -> dict[int, np.ndarray]:
    """By key: the sums, then the maxima, of what ``add`` gives for the rows of a batch as (keys, keys x numbers).

    A task adds its batches up before it passes anything on.
    """
    width = sums + extremes
    schema = ", ".join(["key bigint", *(f"v{i} double" for i in range(width))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for keys, values in add(*_matrix(batch), batch.column("weight").to_numpy().astype(float)) if batch.num_rows else ():
                for k, v in zip(keys.tolist(), values, strict=True):
                    if k in total:
                        total[k][:sums] += v[:sums]
                        total[k][sums:] = np.maximum(total[k][sums:], v[sums:])
                    else:
                        total[k] = np.array(v, float)
        if total:
            table = np.stack(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *(pa.array(c) for c in table.T)], names=[c.split()[0] for c in schema.split(", ")])

    found = _inputs(rows).mapInArrow(run, schema).groupBy("key").agg(*((F.sum if i < sums else F.max)(f"v{i}").alias(f"v{i}") for i in range(width)))
    return {r[0]: np.array(r[1:], float) for r in found.collect()}


def _by_key(keys: np.ndarray, numbers: list[np.ndarray], extremes: list[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their sums and maxima."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.stack([*(np.add.reduceat(n[order], first) for n in numbers), *(np.maximum.reduceat(n[order], first) for n in extremes)], axis=1)


def extra_trees(rows: DataFrame, width: int, n_trees: int = 120, max_depth: int = 15, min_leaf: int = 10, seed: int = 42) -> TreesModel:
    """The mean of extremely random trees over all rows (no bootstrap).

    Of each open node the square root of the number of features is tried, each with one cut drawn evenly between the least
    and the greatest value that the node's rows have; the one that lowers the squared error most is taken, if it leaves
    ``min_leaf`` rows on both sides. Draws depend on seed, tree and node alone. Two passes a level: extremes, then sums.
    """
    tried = max(1, int(np.sqrt(width)))
    trees = [Tree() for _ in range(n_trees)]
    open_ = [(t, 0) for t in range(n_trees)]
    for depth in range(max_depth + 1):
        if not open_:
            break
        draws = {(t, n): np.random.default_rng([seed, t, n]) for t, n in open_}
        chosen = {k: np.sort(r.permutation(width)[:tried]) for k, r in draws.items()}
        number = {k: i for i, k in enumerate(open_)}
        features = np.array([chosen[k] for k in open_])
        places = [np.full(len(t.feature), -1) for t in trees]
        for (t, n), i in number.items():
            places[t][n] = i
        sent = rows.sparkSession.sparkContext.broadcast((trees, places, features))

        def nodes(x: np.ndarray, sent=sent) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
            """By tree: which rows are in open nodes, and in which."""
            grown, places, _ = sent.value
            for tree, place in zip(grown, places, strict=True):
                at = place[tree.leaf(x)]
                inside = np.flatnonzero(at >= 0)
                if len(inside):
                    yield inside, at[inside]

        def extremes(x: np.ndarray, y: np.ndarray, w: np.ndarray, sent=sent, nodes=nodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
            for inside, at in nodes(x):
                values = x[inside[:, None], sent.value[2][at]]
                yield _by_key(at, [w[inside], w[inside] * y[inside], w[inside] * y[inside] ** 2], [*(-values.T), *values.T])

        ranges = _summed(rows, extremes, 3, 2 * tried)
        cuts, going = np.full((len(open_), tried), np.nan), []
        for (t, n), i in number.items():
            count, total, squares = ranges[i][:3] if i in ranges else (0.0, 0.0, 0.0)
            trees[t].value[n] = total / count if count else 0.0
            if depth < max_depth and count >= 2 * min_leaf and squares - total * total / count > 1e-12 * max(1.0, squares):
                low, high = -ranges[i][3 : 3 + tried], ranges[i][3 + tried :]
                cuts[i] = low + draws[t, n].random(tried) * (high - low)
                going.append(i)
        if not going:
            break
        asked = rows.sparkSession.sparkContext.broadcast(cuts)

        def sides(x: np.ndarray, y: np.ndarray, w: np.ndarray, asked=asked, sent=sent, nodes=nodes) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
            for inside, at in nodes(x):
                left = x[inside[:, None], sent.value[2][at]] <= asked.value[at]
                if left.any():
                    row, which = np.nonzero(left)
                    yield _by_key(at[row] * tried + which, [w[inside[row]], w[inside[row]] * y[inside[row]]])

        found = _summed(rows, sides, 2)
        after = []
        for i in going:
            (t, n), (count, total) = open_[i], ranges[i][:2]
            best, choice = 0.0, None
            for j in range(tried):
                n_left, s_left = found.get(i * tried + j, np.zeros(2))
                n_right, s_right = count - n_left, total - s_left
                if min(n_left, n_right) >= min_leaf and (gain := s_left**2 / n_left + s_right**2 / n_right - total**2 / count) > best:
                    best, choice = gain, j
            if choice is not None:
                after += [(t, c) for c in trees[t].split(n, int(features[i][choice]), float(cuts[i][choice]))]
        sent.destroy()
        asked.destroy()
        open_ = after
    return TreesModel(trees, mean=True)


def bin_edges(rows: DataFrame, width: int, bins: int = 255) -> list[np.ndarray]:
    """By feature the distinct upper ends of at most ``bins`` bins of about equally many rows."""
    levels = [k / bins for k in range(1, bins)]
    found = _each(rows, ["x"]).agg(*(F.percentile_approx(F.get("x", F.lit(i)), levels, 10_000).alias(f"e{i}") for i in range(width))).first()
    return [np.unique(np.array(found[i] or [], float)) for i in range(width)]


def boosted_quantile(rows: DataFrame, width: int, quantile: float = 0.5, n_trees: int = 150, max_depth: int = 5, rate: float = 0.1, min_leaf: int = 20, l2: float = 0.0, bins: int = 255, edges: list[np.ndarray] | None = None) -> TreesModel:
    """Trees boosted by the pinball loss of ``quantile``, on features in bins.

    A tree is grown on the loss's slopes (minus the quantile where the label is above the prediction so far, 1 minus it
    elsewhere): one pass a level counts rows and adds up slopes by node, feature and bin. A leaf's value is that quantile of
    its rows' residuals (the least value that so large a share of them does not exceed; by a sketch of 10,000 places, so
    exact up to as many distinct residuals), times ``rate``.
    """
    edges = edges if edges is not None else bin_edges(rows, width, bins)
    places = max((len(e) for e in edges), default=0) + 1
    first = _each(rows, ["label"]).agg(F.percentile_approx("label", quantile, 10_000)).first()[0]
    model = TreesModel([], float(first or 0.0))
    for _ in range(n_trees):
        tree, open_ = Tree(), [0]
        for _ in range(max_depth):
            if not open_:
                break
            number = np.full(len(tree.feature), -1)
            number[open_] = np.arange(len(open_))
            sent = rows.sparkSession.sparkContext.broadcast((model, tree, number, edges))

            def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, sent=sent) -> Iterator[tuple[np.ndarray, np.ndarray]]:  # noqa: ANN001
                so_far, grown, number, edges = sent.value
                at = number[grown.leaf(x)]
                inside = np.flatnonzero(at >= 0)
                if not len(inside):
                    return
                at, x, y, w = at[inside], x[inside], y[inside], w[inside]
                g = w * np.where(y > so_far.predict(x), -quantile, 1 - quantile)
                for f, e in enumerate(edges):
                    yield _by_key((at * width + f) * places + np.searchsorted(e, x[:, f], "left"), [w, g])

            sums = _summed(rows, slopes, 2)
            sent.destroy()
            table = np.zeros((len(open_), width, places, 2))
            for k, v in sums.items():
                table.reshape(-1, 2)[k] = v
            after = []
            for i, node in enumerate(open_):
                left = np.cumsum(table[i], axis=1)[:, :-1]
                count, total = table[i, 0].sum(axis=0)
                n_left, g_left = left[..., 0], left[..., 1]
                n_right, g_right = count - n_left, total - g_left
                usable = (n_left >= min_leaf) & (n_right >= min_leaf)
                if not usable.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(usable, g_left**2 / (n_left + l2) + g_right**2 / (n_right + l2) - total**2 / (count + l2), -np.inf)
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-9 and b < len(edges[f]):
                    after += tree.split(node, int(f), float(edges[f][b]))
            open_ = after
        sent = rows.sparkSession.sparkContext.broadcast((model, tree))

        def residuals(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                if batch.num_rows:
                    x, y = _matrix(batch)
                    so_far, grown = sent.value
                    yield pa.RecordBatch.from_arrays([pa.array(grown.leaf(x)), pa.array(y - so_far.predict(x)), batch.column("weight")], names=["leaf", "residual", "weight"])

        by_leaf = _each(_inputs(rows).mapInArrow(residuals, "leaf bigint, residual double, weight bigint"), ["leaf", "residual"]).groupBy("leaf")
        for leaf, value in by_leaf.agg(F.percentile_approx("residual", quantile, 10_000)).collect():
            tree.value[leaf] = rate * value
        sent.destroy()
        model.trees.append(tree)
    return model
