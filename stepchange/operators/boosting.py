"""Gradient boosting on histograms: trees grown best leaf first, on rows spread over tasks.

Training rows are dealt to tasks once and kept there as small whole numbers
(bins) with their scores. A step of a tree's growth is one job: tasks sum
gradients and curvatures by node, input and bin, a few kilobytes a node, and the
driver searches splits on the totals. No row moves after the first deal. Rows
that one task can hold are grown on by that task in the same way, without a job
a step. Scoring is an ordinary pass over all rows with the trees as a table of
nodes.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

KEPT = StorageLevel.MEMORY_AND_DISK
NODE = np.dtype(
    [("feature", "i4"), ("bin", "i4"), ("left", "i4"), ("right", "i4"), ("value", "f8"), ("cover", "i8")]
)
NODE_SCHEMA = "tree int, node int, feature int, bin int, members binary, left int, right int, value double, cover long"


@dataclass(frozen=True)
class BoostParams:
    """Boosting settings; the defaults are the study's 300 trees of 63 leaves."""

    rounds: int = 300
    learning_rate: float = 0.1
    leaves: int = 63
    # Splits on the way to a leaf at most: as many as 63 leaves can have
    depth: int = 62
    min_rows: int = 20
    # A leaf moves the score, a logarithm, by at most so much before the learning rate
    max_step: float = 0.7
    # Bins of a numeric input
    bins: int = 255
    # Rounds after which scores are made from the trees anew: a lost executor repeats so many at most
    checkpoint_every: int = 25
    # Rows that a task should have, at least and at most
    task_rows: int = 50_000
    most_rows: int = 1_000_000
    # Rows up to which one task fits alone: a job takes 0.1 s and a tree about 13 of them, however few the rows
    alone_rows: int = 1_000_000


@dataclass(frozen=True)
class Binning:
    """How inputs become bins: categories in order, or upper edges. Bin 0 is for null and unknown values."""

    names: tuple[str, ...]
    categories: dict[str, tuple[str, ...]]
    edges: dict[str, np.ndarray]

    @property
    def is_category(self) -> np.ndarray:
        return np.array([name in self.categories for name in self.names])

    @property
    def sizes(self) -> np.ndarray:
        """Bins of each input."""
        return np.array(
            [1 + (len(self.categories[n]) if n in self.categories else len(self.edges[n]) + 1) for n in self.names]
        )

    def bins(self, batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(batch), len(self.names)), np.int16)
        for at, name in enumerate(self.names):
            values = batch[name]
            if name in self.categories:
                out[:, at] = pd.Categorical(values, categories=list(self.categories[name])).codes + 1
            else:
                numbers = values.to_numpy(float)
                out[:, at] = np.where(np.isnan(numbers), 0, np.searchsorted(self.edges[name], numbers) + 1)
        return out


def find_bins(train: DataFrame, categorical: Sequence[str], numeric: Sequence[str], bins: int) -> Binning:
    """Categories and edges of the training rows; edges are quantiles, or middles if a numeric input has few values."""
    probs = [i / (bins - 1) for i in range(1, bins - 1)]
    levels = F.array(*map(F.lit, probs))
    row = train.agg(
        # The inputs' vocabularies: zones, groups, bands, days and months
        *[F.sort_array(F.collect_set(F.col(name).cast("string"))).alias(name) for name in categorical],
        *[F.percentile_approx(F.col(name).cast("double"), levels, 20 * bins).alias(name) for name in numeric],
    ).first()
    edges = {}
    for name in numeric:
        found = np.unique(np.array(row[name] or [], float))
        edges[name] = (found[:-1] + found[1:]) / 2 if len(found) < bins // 2 else found[:-1]
    return Binning((*categorical, *numeric), {n: tuple(row[n]) for n in categorical}, edges)


class Tree:
    """Nodes of one tree in order of their making; node 0 is the root."""

    def __init__(self) -> None:
        self.nodes: list[tuple] = []
        self.members: list[bytes] = []

    def add(self, value: float, cover: int) -> int:
        self.nodes.append((-1, 0, -1, -1, value, cover))
        self.members.append(b"")
        return len(self.nodes) - 1

    def split(self, node: int, feature: int, bin_: int, members: bytes, left: int, right: int) -> None:
        self.nodes[node] = (feature, bin_, left, right, *self.nodes[node][4:])
        self.members[node] = members

    def packed(self) -> PackedTree:
        return PackedTree(np.array(self.nodes, NODE), tuple(self.members))


@dataclass(frozen=True)
class PackedTree:
    """A tree as arrays. A split sends bins up to ``bin``, or those among ``members``, to the left."""

    nodes: np.ndarray
    members: tuple[bytes, ...]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(bins), np.int32)
        waiting = [(0, None)]
        nodes = self.nodes.tolist()
        while waiting:
            node, rows = waiting.pop()
            feature, bin_, left, right, _, _ = nodes[node]
            if feature < 0:
                if rows is None:
                    out[:] = node
                else:
                    out[rows] = node
                continue
            column = bins[:, feature] if rows is None else bins[:, feature][rows]
            members = self.members[node]
            goes = np.frombuffer(members, bool)[column] if members else column <= bin_
            for child, chosen in ((left, goes), (right, ~goes)):
                own = np.flatnonzero(chosen) if rows is None else rows[chosen]
                if len(own):
                    waiting.append((child, own))
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.nodes["value"][self.leaves(bins)]


Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Block:
    """One task's training rows: bins, the target and the score so far."""

    bins: np.ndarray
    actual: np.ndarray
    score: np.ndarray


def _block(batches: Iterable[pa.RecordBatch], binning: Binning, base: float) -> Block | None:
    """A task's rows, if it has any."""
    bins, actual = [], []
    for batch in batches:
        data = batch.to_pandas()
        bins.append(binning.bins(data))
        actual.append(data["actual"].to_numpy(float))
    if not bins:
        return None
    target = np.concatenate(actual)
    # By column, as trees read them
    return Block(np.asfortranarray(np.concatenate(bins)), target, np.full(len(target), base))


def _with_trees(trees: Sequence[PackedTree], rate: float, block: Block) -> Block:
    score = block.score.copy()
    for tree in trees:
        score += rate * tree.values(block.bins)
    return Block(block.bins, block.actual, score)


def _root_sums(loss: Loss, offsets: np.ndarray, width: int, block: Block) -> np.ndarray:
    """The root's sums, then the deviance and the number of rows."""
    g, h, unit = loss(block.actual, block.score)
    own = _sums(block.bins, g, h, np.zeros(len(g), np.int64), 1, offsets, width)
    return np.append(own.ravel(), [unit.sum(), len(unit)])


def _node_sums(
    loss: Loss, offsets: np.ndarray, width: int, tree: PackedTree, wanted: np.ndarray, block: Block
) -> np.ndarray:
    """The sums of some leaves of a tree."""
    place = np.full(len(tree.nodes), -1)
    place[wanted] = np.arange(len(wanted))
    at = place[tree.leaves(block.bins)]
    rows = np.flatnonzero(at >= 0)
    g, h, _ = loss(block.actual[rows], block.score[rows])
    return _sums(block.bins[rows], g, h, at[rows], len(wanted), offsets, width)


def _sums(bins, g, h, node, nodes: int, offsets: np.ndarray, width: int) -> np.ndarray:
    """Gradients, curvatures and rows by node, input and bin; inputs stand one after the other."""
    out = np.zeros((3, nodes * width))
    first = node * width
    for feature, offset in enumerate(offsets):
        at = first + (bins[:, feature] + offset)
        out[0] += np.bincount(at, g, nodes * width)
        out[1] += np.bincount(at, h, nodes * width)
        out[2] += np.bincount(at, minlength=nodes * width)
    return out.reshape(3, nodes, width).swapaxes(0, 1)


class Grower:
    """Grows trees on sums by node, input and bin; ``ask`` gets those of some leaves of a tree from all rows."""

    def __init__(self, binning: Binning, params: BoostParams):
        self.params = params
        self.category = binning.is_category
        self.sizes = binning.sizes
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.width = int(self.sizes.sum())
        # Categories and numbers apart, each side by side and filled up with empty bins
        self.groups = []
        for ordered in (False, True):
            features = np.flatnonzero(self.category != ordered)
            most = int(self.sizes[features].max(initial=0))
            padded = np.full((len(features), most), self.width)
            for i, feature in enumerate(features):
                padded[i, : self.sizes[feature]] = self.offsets[feature] + np.arange(self.sizes[feature])
            if len(features):
                self.groups.append((ordered, features, padded))

    def best(self, sums: np.ndarray) -> list[tuple]:
        """For each node's sums the split of the greatest gain: (gain, feature, bin, members, rows of the left side)."""
        filled = np.pad(sums, ((0, 0), (0, 0), (0, 1)))
        least = self.params.min_rows
        found = [(0.0, 0, 0, b"", 0.0)] * len(sums)
        for ordered, features, padded in self.groups:
            square = filled[:, :, padded]
            if not ordered:
                # Categories by their step, empty bins last
                step = np.where(square[:, 2] > 0, -square[:, 0] / np.maximum(square[:, 1], 1e-300), np.inf)
                order = np.argsort(step, axis=2, kind="stable")
                square = np.take_along_axis(square, order[:, None], 3)
            g, h, n = np.cumsum(square, axis=3).swapaxes(0, 1)
            whole = [x[:, :, -1:] for x in (g, h, n)]
            right = [w - x for w, x in zip(whole, (g, h, n))]
            fits = (n >= least) & (right[2] >= least) & (h > 0) & (right[1] > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = g * g / h + right[0] * right[0] / right[1] - whole[0] * whole[0] / whole[1]
            gain = np.where(fits, gain, 0.0).reshape(len(sums), -1)
            for node, at in enumerate(gain.argmax(axis=1).tolist()):
                if gain[node, at] <= found[node][0]:
                    continue
                i, place = divmod(at, padded.shape[1])
                members = b""
                if not ordered:
                    inside = np.zeros(int(self.sizes.max()), bool)
                    inside[order[node, i, : place + 1]] = True
                    members = inside.tobytes()
                found[node] = (float(gain[node, at]), int(features[i]), place, members, n[node, i, place])
        return found

    def value(self, sums: np.ndarray) -> tuple[float, int]:
        """A node's Newton step, bounded, and its rows. Every input has each row in one bin."""
        g, h, n = sums[:, : self.sizes[0]].sum(axis=1)
        move = -g / h if h > 0 else 0.0
        return float(np.clip(move, -self.params.max_step, self.params.max_step)), int(round(n))

    def tree(self, root: np.ndarray, ask) -> PackedTree:
        """A tree grown best leaf first.

        Nodes that best-first growth would split, as far as gains are known, are
        split together; growth is then followed anew with their children's gains.
        """
        params, tried = self.params, Tree()
        tried.add(*self.value(root))
        sums, depth, children = {0: root}, {0: 0}, {}
        known = {0: self.best(root[None])[0]}
        while True:
            order, fresh, leaves = [], [], 1
            heap = [(-known[0][0], 0)]
            while heap and leaves < params.leaves:
                gain, node = heapq.heappop(heap)
                if -gain <= 1e-12 or depth[node] >= params.depth:
                    continue
                order.append(node)
                leaves += 1
                if node in children:
                    for child in children[node]:
                        heapq.heappush(heap, (-known[child][0], child))
                else:
                    fresh.append(node)
            if not fresh:
                break
            smaller = []
            for node in fresh:
                _, feature, bin_, members, n_left = known[node]
                children[node] = tuple(tried.add(0.0, 0) for _ in range(2))
                tried.split(node, feature, bin_, members, *children[node])
                smaller.append(children[node][0 if 2 * n_left <= tried.nodes[node][5] else 1])
            added = ask(tried.packed(), np.array(smaller))
            ids = []
            for node, small, own in zip(fresh, smaller, added):
                rest = sums[node] - own
                # Differences of equal sums may leave a trace
                rest[:, rest[2] < 0.5] = 0.0
                for child in children[node]:
                    sums[child] = own if child == small else rest
                    depth[child] = depth[node] + 1
                    tried.nodes[child] = (-1, 0, -1, -1, *self.value(sums[child]))
                    ids.append(child)
            for child, split in zip(ids, self.best(np.stack([sums[i] for i in ids]))):
                known[child] = split
        # Nodes that were tried but not taken stay out
        final = Tree()
        number = {0: final.add(*tried.nodes[0][4:])}
        for node in order:
            made = [final.add(*tried.nodes[child][4:]) for child in children[node]]
            number.update(zip(children[node], made))
            final.split(number[node], *known[node][1:4], *made)
        return final.packed()


def trees_batch(trees: Sequence[PackedTree]) -> pa.RecordBatch:
    """Trees as rows, one a node."""
    counts = [len(tree.nodes) for tree in trees]
    nodes = np.concatenate([tree.nodes for tree in trees]) if trees else np.zeros(0, NODE)
    columns = {
        "tree": pa.array(np.repeat(np.arange(len(trees)), counts).astype(np.int32)),
        "node": pa.array(np.concatenate([np.arange(n) for n in counts] or [[]]).astype(np.int32)),
        "feature": pa.array(nodes["feature"]),
        "bin": pa.array(nodes["bin"]),
        "members": pa.array([m for tree in trees for m in tree.members], pa.binary()),
        "left": pa.array(nodes["left"]),
        "right": pa.array(nodes["right"]),
        "value": pa.array(nodes["value"]),
        "cover": pa.array(nodes["cover"]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def trees_of(table: pa.Table) -> list[PackedTree]:
    """Trees from their rows."""
    table = table.sort_by([("tree", "ascending"), ("node", "ascending")])
    if not table.num_rows:
        return []
    nodes = np.zeros(table.num_rows, NODE)
    for name in NODE.names:
        nodes[name] = table[name].to_numpy()
    members = table["members"].to_pylist()
    starts = np.flatnonzero(np.diff(table["tree"].to_numpy(), prepend=-1))
    ends = np.append(starts[1:], table.num_rows)
    return [PackedTree(nodes[a:b], tuple(members[a:b])) for a, b in zip(starts, ends)]


@dataclass
class Ensemble:
    """Fitted trees with the binning they read."""

    binning: Binning
    base: float
    learning_rate: float
    trees: list[PackedTree] = field(default_factory=list)

    def nodes(self, spark) -> DataFrame:
        """The trees as a table, a row a node: splits, children, values and training rows."""
        return spark.createDataFrame(pa.Table.from_batches([trees_batch(self.trees)]), NODE_SCHEMA)

    def score(self, rows: DataFrame, column: str = "score") -> DataFrame:
        """The rows with their score, on the log scale: one pass without a shuffle."""
        held = rows.sparkSession.sparkContext.broadcast(self)
        names = list(self.binning.names)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in batches:
                bins = model.binning.bins(batch.select(names).to_pandas())
                score = np.full(len(bins), model.base)
                for tree in model.trees:
                    score += model.learning_rate * tree.values(bins)
                yield batch.append_column(column, pa.array(score))

        kept = rows.drop(column)
        inputs = kept.withColumns({n: F.col(n).cast("string") for n in self.binning.categories})
        inputs = inputs.withColumns({n: F.col(n).cast("double") for n in self.binning.edges})
        # The columns' own types come back with the result
        scored = inputs.mapInArrow(apply, StructType([*inputs.schema.fields, StructField(column, DoubleType())]))
        return scored.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in kept.schema], column
        )


class Dealt:
    """Training rows spread over tasks: a step is a job, and tasks find their rows' leaves from the tree."""

    def __init__(self, blocks, loss: Loss, grower: Grower):
        self.first = self.blocks = blocks.persist(KEPT)
        self.stale = []
        self.loss, self.grower, self.params = loss, grower, grower.params

    def _total(self, task) -> np.ndarray:
        # Sums of a few nodes, as many as tasks: small, and added in the tasks' order
        return sum(self.blocks.map(task).collect())

    def root(self) -> np.ndarray:
        return self._total(partial(_root_sums, self.loss, self.grower.offsets, self.grower.width))

    def nodes(self, tree: PackedTree, wanted: np.ndarray) -> np.ndarray:
        return self._total(partial(_node_sums, self.loss, self.grower.offsets, self.grower.width, tree, wanted))

    def add(self, trees: Sequence[PackedTree]) -> None:
        """The scores with the last tree."""
        # The chain of scores is cut at times: scores follow from the trees
        again = len(trees) % self.params.checkpoint_every == 0
        source, new = (self.first, list(trees)) if again else (self.blocks, [trees[-1]])
        last, self.blocks = self.blocks, source.map(partial(_with_trees, new, self.params.learning_rate)).persist(KEPT)
        if last is not self.first:
            self.stale.append(last)
        while len(self.stale) > 1:
            self.stale.pop(0).unpersist()

    def release(self) -> None:
        for held in (*self.stale, self.blocks, self.first):
            held.unpersist()


class Held:
    """Training rows of one task, by node of the tree that grows: a step reads the rows of the nodes it splits."""

    def __init__(self, block: Block, loss: Loss, grower: Grower):
        self.block, self.loss, self.grower = block, loss, grower

    def _sums(self, rows: np.ndarray | slice) -> np.ndarray:
        out = np.zeros((3, self.grower.width))
        g, h = self.g[rows], self.h[rows]
        for feature, (offset, size) in enumerate(zip(self.grower.offsets, self.grower.sizes)):
            at = self.block.bins[:, feature][rows].astype(np.intp)
            out[0, offset : offset + size] = np.bincount(at, g, size)
            out[1, offset : offset + size] = np.bincount(at, h, size)
            out[2, offset : offset + size] = np.bincount(at, minlength=size)
        return out

    def root(self) -> np.ndarray:
        self.g, self.h, unit = self.loss(self.block.actual, self.block.score)
        self.rows = {0: np.arange(len(unit))}
        return np.append(self._sums(slice(None)).ravel(), [unit.sum(), len(unit)])

    def nodes(self, tree: PackedTree, wanted: np.ndarray) -> np.ndarray:
        for node in list(self.rows):
            feature, bin_, left, right, _, _ = tree.nodes[node].tolist()
            if feature >= 0:
                rows = self.rows.pop(node)
                column, members = self.block.bins[:, feature][rows], tree.members[node]
                goes = np.frombuffer(members, bool)[column] if members else column <= bin_
                self.rows[left], self.rows[right] = rows[goes], rows[~goes]
        return np.stack([self._sums(self.rows[node]) for node in wanted.tolist()])

    def add(self, trees: Sequence[PackedTree]) -> None:
        """The scores with the last tree."""
        self.block = _with_trees(trees[-1:], self.grower.params.learning_rate, self.block)


def _grow(rows: Dealt | Held, grower: Grower) -> list[PackedTree]:
    """The trees of a fit, one a round."""
    trees, before = [], np.inf
    while True:
        added = rows.root()
        now = added[-2] / max(added[-1], 1.0)
        if trees and not now <= before:
            # A fit that has converged: the tree that no longer helps is left out
            trees.pop()
            break
        if len(trees) == grower.params.rounds:
            break
        before = now
        tree = grower.tree(added[:-2].reshape(3, grower.width), rows.nodes)
        if len(tree.nodes) == 1:
            break
        trees.append(tree)
        rows.add(trees)
    return trees


def boost_trees(
    train: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    loss: Loss,
    base: float,
    params: BoostParams,
    keys: Sequence[str],
) -> Ensemble:
    """Fit trees to the training rows, which have the inputs and ``actual``; ``keys`` tell rows apart.

    Of up to ``alone_rows`` rows one task makes the trees. Of more, the driver has
    trees and sums: rounds x leaves and nodes x bins, whatever the rows. Scores are
    never collected.
    """
    spark = train.sparkSession
    binning = find_bins(train, categorical, numeric, params.bins)
    inputs = train.select(
        *[F.col(n).cast("string").alias(n) for n in categorical],
        *[F.col(n).cast("double").alias(n) for n in numeric],
        F.col("actual").cast("double").alias("actual"),
        F.xxhash64(*keys).alias("deal"),
    )
    rows, grower = inputs.count(), Grower(binning, params)
    alone = rows <= params.alone_rows
    slots = spark.sparkContext.defaultParallelism
    tasks = max(1, min(max(slots, -(-rows // params.most_rows)), -(-rows // params.task_rows)))
    # Dealt by key and in one order, so that a repeated task adds the same numbers up in the same order
    dealt = inputs.repartition(1) if alone else inputs.repartition(tasks, "deal")
    dealt = dealt.sortWithinPartitions("deal", *binning.names, "actual").drop("deal")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(batches, binning, base)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _block(batches, binning, base)
        if block is not None:
            yield trees_batch(_grow(Held(block, loss, grower), grower))

    if alone:
        trees = trees_of(dealt.mapInArrow(grown, NODE_SCHEMA).toArrow())
    else:
        blocks = dealt.mapInArrow(packed, "block binary").rdd.map(lambda row: pickle.loads(row.block))
        spread = Dealt(blocks, loss, grower)
        trees = _grow(spread, grower)
        spread.release()
    return Ensemble(binning, base, params.learning_rate, trees)
