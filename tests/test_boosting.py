"""The histogram booster against plain growth, one leaf at a time, over the rows themselves."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepchange.operators import boosting, forecast

PARAMS = boosting.BoostParams(leaves=9, min_rows=15)


def inputs(n, seed):
    rng = np.random.default_rng(seed)
    data = pd.DataFrame(
        {
            "zone": rng.integers(0, 9, n).astype(str),
            "wind": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 30, n).astype(float)),
            "usual": rng.gamma(2, 3, n),
        }
    )
    level = 0.2 * data["usual"] + data["zone"].isin(["2", "5", "7"]) - (data["wind"] > 20)
    data["actual"] = rng.poisson(np.exp(level - 1)).astype(float)
    return data


def binning():
    edges = {"wind": np.arange(0.5, 29.5), "usual": np.linspace(0.5, 20, 40)}
    return boosting.Binning(("zone", "wind", "usual"), {"zone": tuple("012345678")}, edges)


def plain_tree(bins, is_category, g, h, params):
    """Leaves as sets of rows: the split of the greatest gain over all leaves, inputs and cuts, again and again."""

    def splits(rows):
        whole = g[rows].sum() ** 2 / h[rows].sum()
        for feature in range(bins.shape[1]):
            column = bins[rows, feature]
            kinds = np.unique(column)
            if is_category[feature]:
                kinds = sorted(kinds, key=lambda k: (-g[rows][column == k].sum() / h[rows][column == k].sum(), k))
            left = np.zeros(len(rows), bool)
            for kind in kinds[:-1]:
                left = left | (column == kind)
                sides = rows[left], rows[~left]
                if min(map(len, sides)) >= params.min_rows:
                    yield sum(g[s].sum() ** 2 / h[s].sum() for s in sides) - whole, sides

    leaves = [np.arange(len(g))]
    while len(leaves) < params.leaves:
        best = max(((gain, i, sides) for i, rows in enumerate(leaves) for gain, sides in splits(rows)), key=lambda x: x[0], default=None)
        if best is None or best[0] <= 1e-12:
            break
        leaves[best[1] : best[1] + 1] = best[2]
    return leaves


@pytest.mark.parametrize("loss", forecast.LOSSES.values())
@pytest.mark.parametrize("seed", [0, 1, 2])
def test_a_tree_is_the_one_that_plain_best_first_growth_gives(seed, loss):
    data, own = inputs(900, seed), binning()
    bins, actual = own.bins(data), data["actual"].to_numpy()
    score = np.full(len(data), np.log(actual.mean()))
    blocks = [boosting.Block(bins[i::3], actual[i::3], score[i::3]) for i in range(3)]
    grower, asked = boosting.Grower(own, PARAMS), []

    def ask(tree, wanted):
        asked.append(len(wanted))
        return sum(boosting._node_sums(loss, grower.offsets, grower.width, tree, wanted, b) for b in blocks)

    root = sum(boosting._root_sums(loss, grower.offsets, grower.width, b) for b in blocks)
    tree = grower.tree(root[:-2].reshape(3, -1), ask)
    g, h, unit = loss(actual, score)
    assert root[-2:] == pytest.approx([unit.sum(), len(unit)])
    found = tree.leaves(bins)
    expected = plain_tree(bins, own.is_category, g, h, PARAMS)
    assert {tuple(np.flatnonzero(found == leaf)) for leaf in np.unique(found)} == {tuple(sorted(rows)) for rows in expected}
    for rows in expected:
        node = tree.nodes[found[rows[0]]]
        assert node["value"] == pytest.approx(np.clip(-g[rows].sum() / h[rows].sum(), -PARAMS.max_step, PARAMS.max_step))
        assert node["cover"] == len(rows)
    assert len(asked) < PARAMS.leaves - 1


def test_rows_of_a_fit_in_spark_are_those_of_one_in_one_place(spark):
    data = inputs(3000, 7)
    frame = spark.createDataFrame(data.assign(key=np.arange(len(data)))).repartition(5)
    params = replace(PARAMS, rounds=12, task_rows=500, checkpoint_every=5)
    fits = []
    for tasks in (params, replace(params, task_rows=10**9)):
        fits.append(boosting.boost_trees(frame, ["zone"], ["wind", "usual"], forecast.LOSSES["trips"], 0.5, tasks, ["key"]))
    assert [len(fit.trees) for fit in fits] == [12, 12]
    for one, other in zip(*(fit.trees for fit in fits)):
        for name in ("feature", "bin", "left", "right", "cover"):
            assert (one.nodes[name] == other.nodes[name]).all()
        assert one.nodes["value"] == pytest.approx(other.nodes["value"], rel=1e-9)
    scored = fits[0].score(frame).toPandas().sort_values("key")
    bins = fits[0].binning.bins(data)
    expected = 0.5 + 0.1 * sum(tree.values(bins) for tree in fits[0].trees)
    assert scored["score"].to_numpy() == pytest.approx(expected)
    table = boosting.trees_of(fits[0].nodes(spark).toArrow())
    assert all((a.nodes == b.nodes).all() and a.members == b.members for a, b in zip(table, fits[0].trees))


@pytest.mark.parametrize("target", forecast.LOSSES)
def test_one_task_grows_the_trees_that_many_tasks_grow(spark, target):
    frame = spark.createDataFrame(inputs(3000, 8).assign(key=range(3000))).repartition(5)
    alone = replace(PARAMS, rounds=12, task_rows=500, checkpoint_every=5, alone_rows=3000)
    fits = []
    for params in (alone, replace(alone, alone_rows=2999)):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        fits.append(boosting.boost_trees(frame, ["zone"], ["wind", "usual"], forecast.LOSSES[target], 0.5, params, ["key"]))
        jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before
        # A step is a job only if rows are spread
        assert (jobs > 12 * 3) == (params is not alone)
    assert [len(fit.trees) for fit in fits] == [12, 12]
    for one, other in zip(*(fit.trees for fit in fits)):
        for name in ("feature", "bin", "left", "right", "cover"):
            assert (one.nodes[name] == other.nodes[name]).all()
        assert one.members == other.members
        assert one.nodes["value"] == pytest.approx(other.nodes["value"], rel=1e-9)


def test_unknown_and_missing_values_have_bins_of_their_own():
    own = binning()
    bins = own.bins(pd.DataFrame({"zone": ["3", "x", None], "wind": [0.0, np.nan, 99.0], "usual": [0.0, 0.5, np.nan]}))
    assert bins.tolist() == [[4, 1, 1], [0, 0, 1], [0, 30, 0]]


def test_a_converged_fit_stops(spark):
    frame = spark.range(200).select("id", F.lit("a").alias("zone"), F.lit(1.0).alias("wind"), F.lit(3.0).alias("actual"))
    fit = boosting.boost_trees(frame, ["zone"], ["wind"], forecast.LOSSES["trips"], float(np.log(3.0)), PARAMS, ["id"])
    assert fit.trees == []
