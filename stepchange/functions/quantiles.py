"""Quantiles by group: bounded sketches, or exact values without large groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig

# Groups of up to this many rows are put in order in one task; ranks of larger ones are located
SMALL = 1 << 16
# Parts that a step of the location tells apart within a power of two, then within a part
FINER = 4096


def group_quantiles(
    data: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    probs: Sequence[float],
    cfg: StudyConfig,
    counts: Sequence[Column] = (),
) -> DataFrame:
    """Lower-rank quantiles of several measures, one array column a measure.

    ``counts`` are further aggregates by the same keys, from the same pass. Exact
    quantiles look first, over the keys alone, whether some group is large.
    """
    levels = F.array(*map(F.lit, probs))
    if not cfg.exact_medians:
        return data.groupBy(*keys).agg(
            *counts,
            *[
                F.percentile_approx(value, levels, cfg.accuracy).alias(name)
                for name, value in measures.items()
            ],
        )
    return exact_quantiles(data, keys, measures, probs, counts)


def exact_quantiles(
    data: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    probs: Sequence[float],
    counts: Sequence[Column] = (),
    small: int = SMALL,
) -> DataFrame:
    """Exact discrete quantiles of groups of any size.

    The values of a group of up to ``small`` rows are put in order in one task,
    in the pass that also makes the counts. Larger groups are never collected:
    ranks in them are located, see ``located_quantiles``. A job over the keys
    tells which groups are large. Without ``counts``, groups with a null key or
    without a value are left out.
    """
    if not counts:
        data = data.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    large = data.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > small).select(*keys)
    n_large = large.count()
    some, few = n_large > 0, n_large <= small
    if some:
        # Null keys are equal here, so they are marked apart from no match
        flags = F.broadcast(large) if few else large
        flags = flags.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.lit(True).alias("is_large"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
        data = data.join(flags, same, "left").drop(*[f"of_{k}" for k in keys])
    ordered = {}
    for name, value in measures.items():
        own = F.when(F.col("is_large").isNull(), value.cast("double")) if some else value.cast("double")
        ordered[name] = F.sort_array(F.collect_list(own))

    def at(values: Column, prob: float) -> Column:
        rank = F.greatest(F.ceil(F.round(F.lit(prob) * F.size(values), 6)), F.lit(1)).cast("int")
        return F.when(F.size(values) > 0, F.element_at(values, rank))

    found = data.groupBy(*keys).agg(*counts, *[values.alias(name) for name, values in ordered.items()])
    found = found.withColumns(
        {name: F.array(*[at(F.col(name), prob) for prob in probs]) for name in measures}
    )
    # A measure without values has no quantiles
    found = found.withColumns({name: F.when(F.col(name)[0].isNotNull(), F.col(name)) for name in measures})
    any_value = F.coalesce(*measures).isNotNull() if not counts else F.lit(True)
    if not some:
        return found.where(any_value)
    located = located_quantiles(data.where("is_large"), keys, measures, probs, few)
    located = located.select(
        *[F.col(k).alias(f"of_{k}") for k in keys], *[F.col(name).alias(f"of_{name}") for name in measures]
    )
    joined = found.join(located, same, "left")
    return joined.withColumns(
        {name: F.coalesce(name, f"of_{name}") for name in measures}
    ).where(any_value).select(*found.columns)


def _located(counted: DataFrame, group: Sequence[str], item: str, rank: Column) -> DataFrame:
    """Of each group the item in which a rank falls, with the rank inside it as ``within``.

    ``counted`` has one row an item, with its rows as ``n``.
    """
    so_far = F.sum("n").over(W.partitionBy(*group).orderBy(item))
    return (
        counted.withColumn("upto", so_far)
        .where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
        .withColumn("within", rank - F.col("upto") + F.col("n"))
    )


def _parts(value: Column) -> list[Column]:
    """Whole numbers that put doubles in order, the first one first.

    The first has sign, power of two and twelve bits of what remains, two more
    have twelve further bits each. Values that agree in all are equal but for
    their last sixteen bits.
    """
    size = F.abs(value)
    power = F.when(size > 0, F.floor(F.log2(size)))
    inside = size / F.pow(F.lit(2.0), power.cast("double")) - 1
    sign = F.when(value < 0, -1).otherwise(1)
    parts, rest = [], inside * FINER
    for _ in range(3):
        part = F.floor(rest)
        parts.append(part)
        rest = (rest - part) * FINER
    # Infinite and undefined values stand beyond all powers, as they do in an ordering
    first = (power + 2000) * FINER + parts[0]
    beyond = F.isnan(value) | (size == float("inf"))
    first = F.when(F.isnan(value), F.lit(1 << 40)).when(beyond, F.lit(1 << 39)).when(value == 0, F.lit(0)).otherwise(first)
    plain = ~beyond & (value != 0)
    return [sign * first, *[F.when(plain, sign * part).otherwise(F.lit(0)) for part in parts[1:]]]


def located_quantiles(
    data: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    probs: Sequence[float],
    few: bool = False,
) -> DataFrame:
    """Exact discrete quantiles of groups of any size, by counts of ever smaller parts.

    Counts of parts place a rank in one part; tasks make them before a shuffle, so
    no value moves. A second pass counts the values of the ranks' parts alone, by
    (group, measure, value). Counts of a part's parts place a rank in one of them,
    and only the values of the last one are put in order: they agree in all but
    sixteen bits. ``few`` says that the parts of the ranks, one a group, measure
    and level at most, can be held by every task.
    """
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"))
            for name, value in measures.items()
        ]
    )
    names = ["part0", "part1", "part2"]
    group = [*[f"key_{k}" for k in keys], "measure"]
    values = data.select(*[F.col(k).alias(f"key_{k}") for k in keys], F.explode(entries).alias("entry"))
    values = values.select(*group[:-1], "entry.measure", "entry.value").where(F.col("value").isNotNull())
    numbers = dict(zip(names, _parts(F.col("value"))))
    values = values.withColumn("part0", numbers["part0"])
    ranks = F.explode(
        F.array(
            *[
                F.struct(F.lit(index).alias("level"), F.lit(prob).alias("prob"))
                for index, prob in enumerate(probs)
            ]
        )
    ).alias("rank")

    def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
        renamed = right.withColumnsRenamed({name: f"of_{name}" for name in on})
        same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in on])
        return left.join(renamed, same).drop(*[f"of_{name}" for name in on])

    parts = values.groupBy(*group, "part0").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*group))
    wanted = F.greatest(F.ceil(F.round(F.col("rank.prob") * F.col("total"), 6)), F.lit(1))
    parts = parts.withColumn("total", total).select("*", ranks)
    parts = parts.withColumn("wanted", wanted).withColumn("level", F.col("rank.level"))
    on = [*group, "part0"]
    found = _located(parts, [*group, "level"], "part0", F.col("wanted"))
    # Ranks of several levels may be in one part
    hit = found.select(*on).distinct()
    counted = (
        matched(values, F.broadcast(hit) if few else hit, on)
        .withColumns({name: numbers[name] for name in names[1:]})
        .groupBy(*group, *names, "value")
        .agg(F.count("*").alias("n"))
    )
    for name in [*names[1:], "value"]:
        found = found.select(*on, "level", F.col("within").alias("wanted"))
        narrowed = matched(counted, found, on).groupBy(*on, "level", "wanted", name).agg(F.sum("n").alias("n"))
        found = _located(narrowed, [*on, "level"], name, F.col("wanted"))
        on = [*on, name]

    def level_value(name: str, index: int) -> Column:
        wanted = (F.col("measure") == name) & (F.col("level") == index)
        return F.max(F.when(wanted, F.col("value")))

    picked = found.groupBy(*group[:-1]).agg(
        *[
            F.array(*[level_value(name, index) for index in range(len(probs))]).alias(name)
            for name in measures
        ]
    )
    # A measure without values has no quantiles
    own = [F.when(F.col(name)[0].isNotNull(), F.col(name)).alias(name) for name in measures]
    return picked.select(*[F.col(f"key_{k}").alias(k) for k in keys], *own)
