"""Fitted trees as arrays: predictions of single trees, exact path-dependent Shapley values, and isolation forests."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Nodes by number, the root first: feature (-1 at a leaf), edge (lower or equal goes left), children, value, and how much training weight reached the node."""

    feature: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while len(rows := np.flatnonzero(self.feature[at] >= 0)):
            node = at[rows]
            at[rows] = np.where(x[rows, self.feature[node]] <= self.edge[node], self.left[node], self.right[node])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves_of(x)]

    def paths(self) -> list[tuple[int, dict[int, list[float]]]]:
        """For each leaf, by feature on its path: the share of training weight that the feature's splits let through, and the open-closed interval that they ask for."""
        out, stack = [], [(0, {})]
        while stack:
            node, asked = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                out.append((node, asked))
                continue
            share, low, high = asked.get(f, (1.0, -math.inf, math.inf))
            whole = self.cover[node]
            for child, interval in ((int(self.left[node]), (low, min(high, self.edge[node]))), (int(self.right[node]), (max(low, self.edge[node]), high))):
                stack.append((child, asked | {f: [share * self.cover[child] / whole, *interval]}))
        return out


@dataclass
class Trees:
    """A weighted sum of trees: a forest's weights are one over their number, a boosted model's are its own."""

    trees: list[Tree]
    weights: list[float]

    def each(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the single trees, trees x rows, not weighted."""
        return np.array([t.predict(x) for t in self.trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.weights) @ self.each(x)

    @property
    def mean(self) -> float:
        """The expected prediction over the training weight."""
        return float(sum(w * (t.value * t.cover)[t.feature < 0].sum() / t.cover[0] for w, t in zip(self.weights, self.trees)))

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Contributions of all features, rows x features; each row's sum to its prediction less the mean.

        Path-dependent: a feature outside a coalition follows both branches by their training weight. A leaf's part in a feature's value is an integral over [0, 1] of a product with one
        factor a feature of its path, ``inside * t + share * (1 - t)``, a polynomial of low degree: Gauss-Legendre points give it exactly, for all rows at once.
        """
        out = np.zeros(x.shape)
        for weight, tree in zip(self.weights, self.trees):
            for leaf, asked in tree.paths():
                if not asked:
                    continue
                features = list(asked)
                share = np.array([asked[f][0] for f in features])
                inside = np.column_stack([(x[:, f] > asked[f][1]) & (x[:, f] <= asked[f][2]) for f in features]).astype(float)
                points, step = np.polynomial.legendre.leggauss(len(features) // 2 + 1)
                total = np.zeros(inside.shape)
                for t, w in zip((points + 1) / 2, step / 2):
                    factor = inside * t + share * (1 - t)
                    total += w * factor.prod(1, keepdims=True) / factor
                out[:, features] += weight * tree.value[leaf] * (inside - share) * total
        return out


def of_model(model) -> Trees:
    """The trees of a fitted regression forest or boosted model of Spark, with continuous features. Small: they are read node by node."""
    made = []
    for tree in model.trees:
        rows: list[list] = []

        def walk(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction(), float(node.impurityStats().count())])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = int(split.featureIndex()), float(split.threshold())
                rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
            return at

        walk(tree._java_obj.rootNode())
        made.append(Tree(*(np.array(c) for c in zip(*rows))))
    weights = list(model.treeWeights)
    return Trees(made, [w / len(made) for w in weights] if type(model).__name__.startswith("RandomForest") else weights)


# isolation ---------------------------------------------------------------------------------------------------


def usual_depth(n: float | np.ndarray) -> float | np.ndarray:
    """The mean depth of an unsuccessful search among ``n`` values."""
    n = np.asarray(n, float)
    many = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, 2 * (np.log(many - 1) + 0.5772156649) - 2 * (many - 1) / many))


def isolation_tree(x: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree of random cuts on a bounded subsample, as deep as the logarithm of its size; a leaf's value is the depth that a row ends at."""
    rows: list[list] = []
    most = math.ceil(math.log2(max(len(x), 2)))

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, depth + float(usual_depth(len(part))), float(len(part))])
        wide = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and depth < most else ()
        if len(wide):
            f = int(rng.choice(wide))
            edge = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] <= edge
            if low.all():  # the draw was the largest value itself
                low = part[:, f] < edge
                edge = float(part[low, f].max())
            rows[at][:2] = f, edge
            rows[at][2], rows[at][3] = grow(part[low], depth + 1), grow(part[~low], depth + 1)
        return at

    grow(x, 0)
    return Tree(*(np.array(c) for c in zip(*rows)))


def isolation_scores(trees: Trees, x: np.ndarray, size: int) -> np.ndarray:
    """From 0 to 1; rows that few cuts set apart come near 1."""
    return 2 ** (-trees.predict(x) / max(float(usual_depth(size)), 1e-12))
