"""Scores after one feature's value has changed, without scoring the whole row again.

A rescorer keeps for each sample a short state, as wide as the model and not as the
row: a linear model its margin, a perceptron the sums that enter its first layer,
boosted trees the values of the features that some tree asks for and their margin.
A changed value moves the margin by one weight, the first sums by one row of
weights, and re-evaluates only the trees that ask for that feature.  A linear
reducer in front is folded into the first weights, or moves the reduced vector by
one row of its loadings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, LogisticRegressionModel, MultilayerPerceptronClassificationModel,
)
from pyspark.sql import DataFrame


def logistic(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-margin))


class Rescorer:
    """What importance, sensitivity and prediction change ask of a model.

    ``x`` are the rows that the model was fitted on: the features, or the reduced
    vectors if the model stands behind a reducer.
    """

    def state(self, x: np.ndarray) -> np.ndarray:
        """A row of numbers for each sample."""
        raise NotImplementedError

    def probability(self, state: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def moved(self, state: np.ndarray, feature: int, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Probabilities after the feature's values have changed from old to new."""
        raise NotImplementedError


@dataclass
class Linear(Rescorer):
    """A margin of one weight for each feature."""

    weights: np.ndarray
    bias: float
    loadings: np.ndarray | None = None

    def __post_init__(self):
        self.slopes = self.weights if self.loadings is None else self.loadings @ self.weights

    @classmethod
    def of_scorer(cls, scorer: DataFrame) -> Linear:
        """From a one-row table ``(w, bias)``, as wide as one sample."""
        row = scorer.select("w", "bias").first()
        return cls(np.array(row["w"], float), float(row["bias"]))

    def state(self, x):
        return (x @ self.weights + self.bias)[:, None]

    def probability(self, state):
        return logistic(state[:, 0])

    def moved(self, state, feature, old, new):
        return logistic(state[:, 0] + self.slopes[feature] * (new - old))


@dataclass
class Perceptron(Rescorer):
    """Sigmoid layers under a softmax of two classes."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    loadings: np.ndarray | None = None

    def __post_init__(self):
        first = self.layers[0][0]
        self.rows = first if self.loadings is None else self.loadings @ first

    def state(self, x):
        return x @ self.layers[0][0] + self.layers[0][1]

    def probability(self, state):
        sums = state
        for weights, bias in self.layers[1:]:
            sums = logistic(sums) @ weights + bias
        return logistic(sums[:, 1] - sums[:, 0])

    def moved(self, state, feature, old, new):
        return self.probability(state + (new - old)[:, None] * self.rows[feature][None, :])


@dataclass
class Tree:
    """Nodes as arrays; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        row = np.arange(len(x))
        for _ in range(self.depth):
            low = x[row, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.value[at]


@dataclass
class Boosted(Rescorer):
    """Weighted regression trees under a logistic link of twice their sum."""

    trees: list[Tree]
    weights: np.ndarray
    loadings: np.ndarray | None = None
    asked: dict[int, list[int]] = field(init=False)

    def __post_init__(self):
        inner = [sorted(set(t.feature[t.left != np.arange(len(t.left))].tolist())) for t in self.trees]
        #: Features that some tree asks for, and which trees ask for each.
        self.used = np.array(sorted(set().union(*inner)) if inner else [], np.int64)
        place = {f: i for i, f in enumerate(self.used.tolist())}
        self.asked = {f: [k for k, own in enumerate(inner) if f in own] for f in place}
        self.compact = [
            Tree(np.array([place.get(f, 0) for f in t.feature.tolist()], np.int64), t.threshold,
                 t.left, t.right, t.value, t.depth) for t in self.trees]

    def state(self, x):
        own = x[:, self.used]
        return np.column_stack([own, self._sum(own, range(len(self.trees)))])

    def _sum(self, own: np.ndarray, which) -> np.ndarray:
        total = np.zeros(len(own))
        for k in which:
            total += self.weights[k] * (self.compact[k](own) if self.compact[k].depth else self.compact[k].value[0])
        return total

    def probability(self, state):
        return logistic(2.0 * state[:, -1])

    def moved(self, state, feature, old, new):
        own = state[:, :-1]
        if self.loadings is not None:
            changed = own + (new - old)[:, None] * self.loadings[feature][self.used][None, :]
            which = range(len(self.trees))
        elif feature in self.asked:
            changed = own.copy()
            changed[:, np.searchsorted(self.used, feature)] = new
            which = self.asked[feature]
        else:
            return self.probability(state)
        return logistic(2.0 * (state[:, -1] + (self._sum(changed, which) - self._sum(own, which))))


def _tree_of(java_root) -> Tree:
    """Nodes of a fitted tree, the root first."""
    feature, threshold, left, right, value = [], [], [], [], []

    def visit(node) -> tuple[int, int]:
        at = len(feature)
        for column in (feature, threshold, left, right, value):
            column.append(0)
        value[at] = node.prediction()
        left[at] = right[at] = at
        if node.subtreeDepth() == 0:
            return at, 0
        split = node.split()
        feature[at], threshold[at] = split.featureIndex(), split.threshold()
        left[at], a = visit(node.leftChild())
        right[at], b = visit(node.rightChild())
        return at, 1 + max(a, b)

    _, depth = visit(java_root)
    return Tree(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64),
                np.array(right, np.int64), np.array(value, float), depth)


def rescorer(model, loadings: np.ndarray | None = None) -> Rescorer | None:
    """The rescorer of a fitted classifier; None for a kind it does not know.

    ``loadings`` (features x components) are those of the reducer whose output the
    model was fitted on.
    """
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    if isinstance(stage, Rescorer):
        return stage
    if isinstance(stage, LogisticRegressionModel) and stage.numClasses == 2:
        return Linear(stage.coefficients.toArray(), float(stage.intercept), loadings)
    if isinstance(stage, MultilayerPerceptronClassificationModel) and stage.numClasses == 2:
        flat, sizes, at, layers = stage.weights.toArray(), list(stage.getLayers()), 0, []
        for a, b in zip(sizes[:-1], sizes[1:]):
            weights = flat[at : at + a * b].reshape(a, b)
            layers.append((weights, flat[at + a * b : at + a * b + b]))
            at += a * b + b
        return Perceptron(layers, loadings)
    if isinstance(stage, GBTClassificationModel):
        trees = [_tree_of(t._call_java("rootNode")) for t in stage.trees]
        return Boosted(trees, np.array(stage.treeWeights, float), loadings)
    return None
