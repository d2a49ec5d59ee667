"""What a service needs beside a model: the features in their order, the words they know, and what stands for missing numbers.

A bundle is taken from the stages of a fitted preparation, so nothing is computed again, and one form becomes one vector
without a job: numbers as given, else the median that training used; of words a 1 at their place, unknown ones at the last.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import ImputerModel, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.functions.rules import HIGH_TARGET, LOW_TARGET
from windrose.operators.learning import UNKNOWN, PreparedTrees
from windrose.operators.trees import Tree, TreesModel

NODES = "tree int, node int, feature int, cut double, left int, value double"


@dataclass
class Bundle:
    numbers: list[str]
    medians: dict[str, float]
    words: list[str]
    categories: dict[str, list[str]]
    model: TreesModel

    def features(self) -> list[str]:
        """The names of the vector's places."""
        return [*self.numbers, *(f"{w}={x}" for w in self.words for x in (*self.categories[w], "*"))]

    def vector(self, form: Mapping[str, object]) -> list[float]:
        """The vector of one form, by the names of the columns."""
        out = []
        for name in self.numbers:
            try:
                given = float(form.get(name))
            except (TypeError, ValueError):
                given = float("nan")
            out.append(self.medians.get(name, 0.0) if np.isnan(given) else given)
        for name in self.words:
            known, word = self.categories[name], UNKNOWN if form.get(name) is None else str(form[name])
            place = known.index(word) if word in known else len(known)
            out += [float(k == place) for k in range(len(known) + 1)]
        return out

    def predict(self, form: Mapping[str, object]) -> float:
        """The prediction for one form, within the range of the target."""
        return float(np.clip(self.model.predict(np.array([self.vector(form)]))[0], LOW_TARGET, HIGH_TARGET))

    def vectors(self, rows: DataFrame, name: str = "x") -> DataFrame:
        """``rows`` with the same vectors as an array column."""
        parts: list[Column] = []
        for c in self.numbers:
            given = F.col(c).cast("double")
            parts.append(F.array(F.when(given.isNull() | F.isnan(given), F.lit(self.medians.get(c, 0.0))).otherwise(given)))
        for c in self.words:
            known = self.categories[c]
            place = F.array_position(F.array(*map(F.lit, known)), F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN))).cast("int") if known else F.lit(0)
            place = F.when(place == 0, len(known) + 1).otherwise(place)
            parts.append(F.array(*((place == k).cast("double") for k in range(1, len(known) + 2))))
        return rows.withColumn(name, F.concat(*parts) if parts else F.array().cast("array<double>"))

    def save(self, spark: SparkSession, path: str) -> None:
        manifest = {"numbers": self.numbers, "medians": self.medians, "words": self.words, "categories": self.categories, "start": self.model.start, "mean": self.model.mean, "trees": len(self.model.trees), "features": self.features()}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        nodes = [(t, n, int(tree.feature[n]), float(tree.cut[n]), int(tree.left[n]), float(tree.value[n])) for t, tree in enumerate(self.model.trees) for n in range(len(tree.feature))]
        spark.createDataFrame(nodes, NODES).write.parquet(f"{path}/trees")


def bundled(model: PreparedTrees) -> Bundle:
    """The bundle of fitted trees and their preparation."""
    numbers, medians, words, categories = [], {}, [], {}
    preparation: PipelineModel = model.preparation
    for stage in preparation.stages:
        if isinstance(stage, ImputerModel):
            numbers = list(stage.getInputCols())
            medians = {k: float(v) for k, v in stage.surrogateDF.first().asDict().items() if v is not None}
        elif isinstance(stage, StringIndexerModel):
            words = list(stage.getInputCols())
            categories = {c: list(labels) for c, labels in zip(words, stage.labelsArray, strict=True)}
    return Bundle(numbers, medians, words, categories, model.trees)


def load(spark: SparkSession, path: str) -> Bundle:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    trees = [Tree([], [], [], []) for _ in range(manifest["trees"])]
    for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
        for to, value in ((trees[r.tree].feature, r.feature), (trees[r.tree].cut, r.cut), (trees[r.tree].left, r.left), (trees[r.tree].value, r.value)):
            to.append(value)
    return Bundle(manifest["numbers"], manifest["medians"], manifest["words"], manifest["categories"], TreesModel(trees, manifest["start"], manifest["mean"]))
