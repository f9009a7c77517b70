"""Mean absolute Shapley values of the boosted forecast, computed on executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepchange.config import StudyConfig
from stepchange.operators.boosting import PackedTree
from stepchange.operators.compare import seeded_sample
from stepchange.operators.forecast import Boosted

@dataclass(frozen=True)
class Condition:
    """One split on the way to a leaf, and the side it takes."""

    feature: int
    threshold: float | None
    categories: frozenset[float]
    left: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, self.feature]
        if self.threshold is not None:
            goes_left = values <= self.threshold
        else:
            goes_left = np.isin(values, list(self.categories))
        return goes_left if self.left else ~goes_left


@dataclass(frozen=True)
class Leaf:
    value: float
    path: tuple[Condition, ...]


def tree_leaves(tree: PackedTree) -> tuple[list[Leaf], list[int]]:
    """Leaves of a fitted tree with the splits on their paths, over bins, and their training rows."""
    leaves, covers = [], []

    def walk(number: int, path: tuple[Condition, ...]) -> None:
        node = tree.nodes[number]
        if node["feature"] < 0:
            leaves.append(Leaf(float(node["value"]), path))
            covers.append(int(node["cover"]))
            return
        members = tree.members[number]
        inside = frozenset(np.flatnonzero(np.frombuffer(members, bool)).tolist()) if members else frozenset()
        threshold = None if members else float(node["bin"])
        for side, left in (("left", True), ("right", False)):
            walk(int(node[side]), (*path, Condition(int(node["feature"]), threshold, inside, left)))

    walk(0, ())
    return leaves, covers


def _by_feature(leaf: Leaf) -> dict[int, list[int]]:
    """Positions on the path of each feature's splits."""
    grouped: dict[int, list[int]] = {}
    for position, condition in enumerate(leaf.path):
        grouped.setdefault(condition.feature, []).append(position)
    return grouped


def _pass_rates(leaves: list[Leaf], covers: list[int]) -> list[list[float]]:
    """For every leaf, the share of training rows each split sends its way."""

    def below(prefix: tuple[Condition, ...]) -> int:
        return sum(
            n for leaf, n in zip(leaves, covers) if leaf.path[: len(prefix)] == prefix
        )

    rates, known = [], {}
    for leaf in leaves:
        own = []
        for depth in range(1, len(leaf.path) + 1):
            for prefix in (leaf.path[: depth - 1], leaf.path[:depth]):
                if prefix not in known:
                    known[prefix] = below(prefix)
            parent = known[leaf.path[: depth - 1]]
            own.append(known[leaf.path[:depth]] / parent if parent else 0.5)
        rates.append(own)
    return rates


def shapley_values(x: np.ndarray, leaves: list[Leaf], rates: list[list[float]]) -> np.ndarray:
    """Path-dependent Shapley values of one tree for a batch of rows.

    A leaf's contribution is a product over the features on its path: 0 or 1 if
    the feature is known, its pass rate if not. The Shapley weights of such a
    product follow from its elementary symmetric sums.
    """
    values, sides = np.zeros(x.shape), {}

    def holds(condition: Condition) -> np.ndarray:
        # Leaves share their splits
        split = condition.feature, condition.threshold, condition.categories
        if split not in sides:
            sides[split] = replace(condition, left=True).holds(x)
        return sides[split] if condition.left else ~sides[split]

    for leaf, rate in zip(leaves, rates):
        grouped = _by_feature(leaf)
        if not grouped or leaf.value == 0:
            continue
        held = [np.logical_and.reduce([holds(leaf.path[p]) for p in positions]) for positions in grouped.values()]
        zeros = np.array([np.prod([rate[p] for p in positions]) for positions in grouped.values()])
        if 2 ** len(zeros) < len(x):
            # Rows that pass the same features have the same values
            kinds = np.arange(2 ** len(zeros))
            kind = np.zeros(len(x), np.intp)
            for bit, own in enumerate(held):
                kind += own.astype(np.intp) << bit
            found = np.zeros((len(kinds), x.shape[1]))
            found[:, list(grouped)] = leaf.value * _leaf_values(kinds >> np.arange(len(zeros))[:, None] & 1, zeros).T
            values += found.take(kind, axis=0)
        else:
            values[:, list(grouped)] += leaf.value * _leaf_values(np.stack(held), zeros).T
    return values


def _leaf_values(held: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 by feature and row; ``held`` tells which features a row passes."""
    ones, m = held.astype(float), len(zeros)
    # By size and feature: total over subsets of that size of the other features
    sums = np.zeros((m, m, ones.shape[1]))
    sums[0] = 1.0
    for other in range(m):
        zero, one = np.full((m, 1), zeros[other]), np.tile(ones[other], (m, 1))
        zero[other], one[other] = 1.0, 0.0
        sums[1:] = sums[1:] * zero + sums[:-1] * one
        sums[0] *= zero
    weights = [factorial(size) * factorial(m - size - 1) / factorial(m) for size in range(m)]
    return (ones - zeros[:, None]) * np.tensordot(weights, sums, 1)


@dataclass(frozen=True)
class Explained:
    """A tree as leaves, pass rates of their paths, and its mean over the training rows."""

    leaves: list[Leaf]
    rates: list[list[float]]
    mean: float

    @classmethod
    def of(cls, tree: PackedTree) -> Explained:
        leaves, covers = tree_leaves(tree)
        mean = sum(leaf.value * n for leaf, n in zip(leaves, covers)) / max(sum(covers), 1)
        return cls(leaves, _pass_rates(leaves, covers), mean)

    def values(self, bins: np.ndarray) -> np.ndarray:
        """Shapley values of each row. Rows that all splits send the same way have the same ones."""
        splits = {(c.feature, c.threshold, c.categories): c for leaf in self.leaves for c in leaf.path}
        ways = np.stack([c.holds(bins) == c.left for c in splits.values()], axis=1) if splits else np.zeros((len(bins), 1), bool)
        packed = np.packbits(ways, axis=1)
        kinds = np.ascontiguousarray(packed).view(np.dtype((np.void, packed.shape[1]))).ravel()
        _, first, back = np.unique(kinds, return_index=True, return_inverse=True)
        return shapley_values(bins[first], self.leaves, self.rates)[back]


def explain(model: Boosted, rows: DataFrame) -> tuple[DataFrame, float]:
    """Shapley values of scored rows on the log scale, one array a row, and the mean score."""
    ensemble = model.model
    trees = [Explained.of(tree) for tree in ensemble.trees]
    base = ensemble.base + ensemble.learning_rate * sum(tree.mean for tree in trees)
    shared = rows.sparkSession.sparkContext.broadcast((ensemble.binning, trees))
    rate, names = ensemble.learning_rate, model.inputs

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        binning, own = shared.value
        for batch in batches:
            if not len(batch):
                continue
            bins = binning.bins(batch)
            total = np.zeros((len(bins), len(names)))
            for tree in own:
                total += rate * tree.values(bins)
            yield pd.DataFrame({"score": batch["score"], "values": list(total)})

    inputs = rows.select(
        *[F.col(n).cast("string").alias(n) for n in ensemble.binning.categories],
        *[F.col(n).cast("double").alias(n) for n in ensemble.binning.edges],
        "score",
    )
    return inputs.mapInPandas(attribute, "score double, values array<double>"), base


def shap_importance(
    model: Boosted, cfg: StudyConfig, n: int | None = None, seed: int = 0
) -> DataFrame:
    """Mean absolute Shapley value of each input over the forecast rows, or ``n`` of them."""
    test = model.rows.where(~F.col("is_train"))
    chosen = test if n is None else seeded_sample(test, [*cfg.cell, "date"], n, seed)
    sample = chosen.repartition(
        int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    explained, _ = explain(model, sample)
    means = explained.agg(
        *[
            F.avg(F.abs(F.col("values")[index])).alias(name)
            for index, name in enumerate(model.inputs)
        ]
    )
    return means.unpivot([], model.inputs, "input", "mean_abs_shap").orderBy(
        F.col("mean_abs_shap").desc(), "input"
    )
