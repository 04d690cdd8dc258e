"""Gradient-boosted trees, applied as plain column expressions.

Spark's own learner fits the trees. They are then read out once, on the driver, as nested CASE
expressions over an array of features, so scoring needs no model object, join or function of its own and can
stand inside a higher-order function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written


@dataclass
class Trees:
    """Nested (feature, threshold, left, right) or a leaf's value, with weights."""

    trees: list
    weights: list[float]

    def margin(self, features: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            at, threshold, left, right = node
            return F.when(F.get(features, F.lit(at)) <= F.lit(threshold), value(left)).otherwise(value(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + F.lit(weight) * value(tree)
        return total

    def probability(self, features: Column) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * self.margin(features)))


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def _trees(description: str) -> list:
    """The trees of a model's full description, whose lines are If, Else and Predict in order of the nodes."""
    trees: list[list[str]] = []
    for line in map(str.strip, description.splitlines()):
        if line.startswith("Tree "):
            trees.append([])
        elif trees and line and not line.startswith("Else"):
            trees[-1].append(line)

    def read(lines: Iterator[str]):
        line = next(lines)
        if line.startswith("Predict: "):
            return float(line.removeprefix("Predict: "))
        at, threshold = _SPLIT.fullmatch(line).groups()
        return (int(at), float(threshold), read(lines), read(lines))

    return [read(iter(lines)) for lines in trees]


def fit(sample: DataFrame, trees: int = 15, depth: int = 4, partitions: int = 4, weight: str | None = None) -> Trees | None:
    """From (f array<double>, label double) of bounded size, or of any size with the column `weight`: how many examples a row stands for.

    None where not both labels are there. With a weight the rows stay in as many partitions as they have.
    """
    one = sample.select("f", F.col("label").cast("double").alias("label"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("w"))
    rows = written(one if weight else one.coalesce(partitions), "examples")
    if rows.select("label").distinct().count() < 2:
        return None
    learner = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.2, seed=11, minInstancesPerNode=1 if weight else 3)
    learner = learner.setWeightCol("w") if weight else learner
    model = learner.fit(rows.select(array_to_vector("f").alias("x"), "label", "w"))
    return Trees(_trees(model.toDebugString), [float(w) for w in model.treeWeights])
