"""Difference-in-differences with two-way fixed effects and clustered errors.

Both estimators reduce the panel on Spark and solve small systems whose size
depends on the calendar and the trip groups, never on the number of trips or
zones:

* Trips (Poisson). On a balanced panel every regressor depends only on the trip
  group, date and band, so the fit needs only trips summed to those three keys.
* Engaged-hour pay (weighted least squares). Each cell's rows become one row of
  short arrays. Cell effects are eliminated inside tasks, which leaves one
  date-by-date system per time band.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stepchange.config import StudyConfig
from stepchange.functions import columns as C

RING_HALVES = ("ring_adjacent", "ring_across")
# Date effects are solved until residuals are so small a part of the right side
GRADIENT_TOLERANCE = 1e-11
MAX_GRADIENTS = 300


# Panel ----------------------------------------------------------------------


def did_panel(model_table: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One service's rows with effect keys, trend, log pay and group dummies."""
    rows = model_table.where(F.col("service") == cfg.service)
    group = F.col("trip_group")
    panel = rows.select(
        *cfg.cell,
        "date",
        "trip_group",
        "trips",
        "trips_with_earnings",
        *cfg.weather,
        F.concat_ws("|", *cfg.cell).alias("cell"),
        F.concat_ws("|", "date", "time_band").alias("date_band"),
        (F.datediff("date", F.lit(cfg.first_date)) / 365.25).alias("trend"),
        F.when(
            F.col("median_earnings_per_engaged_hour") > 0,
            F.log("median_earnings_per_engaged_hour"),
        ).alias("log_eph"),
        *[(group == name).cast("double").alias(name) for name in ("treated", *RING_HALVES)],
        group.isin(*RING_HALVES).cast("double").alias("ring"),
    )
    return set_intervention(panel, cfg.intervention)


def set_intervention(panel: DataFrame, day: date) -> DataFrame:
    """After-terms of every group for a real or placebo date."""
    after = (F.col("date") >= F.lit(day)).cast("double")
    names = ("treated", "ring", *RING_HALVES)
    return panel.withColumns({f"{name}_after": F.col(name) * after for name in names})


# Terms and fits -------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """A regressor: a function of the date, for some groups and time bands.

    ``kind`` is ``after``, ``trend``, ``month:<first day>`` or a weather column.
    """

    group: str
    kind: str
    band: str | None = None

    @property
    def members(self) -> tuple[str, ...]:
        return RING_HALVES if self.group == "ring" else (self.group,)

    @property
    def label(self) -> str:
        if self.kind == "after":
            return self.band or "all"
        return self.kind.removeprefix("month:")


@dataclass(frozen=True)
class Fit:
    """One regression: its toll terms, the rows it uses and its start date."""

    check: str
    terms: tuple[Term, ...]
    start: date
    first_year: int | None = None
    last_year: int | None = None
    without_group: str | None = None

    def rows(self) -> Column:
        keep = F.lit(True)
        if self.first_year is not None:
            keep = keep & (F.year("date") >= self.first_year)
        if self.last_year is not None:
            keep = keep & (F.year("date") <= self.last_year)
        if self.without_group is not None:
            keep = keep & (F.col("trip_group") != self.without_group)
        return keep

    def row_set(self) -> tuple:
        return (self.start, self.first_year, self.last_year, self.without_group)

    def keeps(self, frame: pd.DataFrame) -> np.ndarray:
        """The same row choice on a collapsed table."""
        year = pd.to_datetime(frame["date"]).dt.year.to_numpy()
        keep = np.ones(len(frame), bool)
        if self.first_year is not None:
            keep &= year >= self.first_year
        if self.last_year is not None:
            keep &= year <= self.last_year
        if self.without_group is not None:
            keep &= frame["trip_group"].to_numpy() != self.without_group
        return keep


def check_fits(cfg: StudyConfig) -> list[Fit]:
    """The headline fit, its variants and the checks on it."""
    weather = tuple(Term("treated", column) for column in cfg.weather)
    headline = tuple(Term(group, "after") for group in ("treated", *RING_HALVES)) + weather
    pooled = (Term("treated", "after"), Term("ring", "after"), *weather)
    by_band = tuple(
        Term(group, "after", band) for group in ("treated", "ring") for band in cfg.band_names
    )
    trends = tuple(Term(group, "trend") for group in ("treated", *RING_HALVES))
    base = Fit("headline", headline, cfg.intervention)
    return [
        base,
        replace(base, check="pooled ring", terms=pooled),
        replace(base, check="by time band", terms=by_band + weather),
        replace(
            base, check="placebo", start=cfg.placebo, last_year=cfg.intervention.year - 1
        ),
        replace(
            base,
            check=f"{cfg.placebo.year}-{cfg.intervention.year} only",
            first_year=cfg.placebo.year,
        ),
        replace(base, check="linear trends", terms=headline + trends),
        replace(base, check="buffer band dropped", without_group="control_near"),
    ]


def _time_values(kind: str, dates: pd.Series, start: date, weather: pd.DataFrame, cfg) -> np.ndarray:
    """A term's value on each date."""
    if kind == "after":
        return (dates >= pd.Timestamp(start)).to_numpy(float)
    if kind == "trend":
        return ((dates - pd.Timestamp(cfg.first_date)).dt.days / 365.25).to_numpy(float)
    if kind.startswith("month:"):
        return (dates == pd.Timestamp(kind.removeprefix("month:"))).to_numpy(float)
    return weather[kind].to_numpy(float)


def _design(frame: pd.DataFrame, fit: Fit, cfg: StudyConfig) -> np.ndarray:
    """Regressors of a fit on a table of trip group, band and date."""
    dates = pd.to_datetime(frame["date"])
    groups, bands = frame["trip_group"].to_numpy(), frame["time_band"].to_numpy()
    columns = []
    for term in fit.terms:
        on = np.isin(groups, term.members)
        if term.band is not None:
            on = on & (bands == term.band)
        columns.append(np.where(on, _time_values(term.kind, dates, fit.start, frame, cfg), 0.0))
    return np.column_stack(columns)


# Inference ------------------------------------------------------------------


def t_quantile(prob: float, dof: float) -> float:
    """Quantile of Student's t by bisection on its integrated density."""
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def cdf(value: float) -> float:
        x = np.linspace(0.0, value, 2001)
        density = scale * (1 + x**2 / dof) ** (-(dof + 1) / 2)
        step = value / 2000
        return 0.5 + step / 3 * (density[0] + 4 * density[1::2].sum() + 2 * density[2:-1:2].sum() + density[-1])

    low, high = 0.0, 200.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < prob else (low, middle)
    return (low + high) / 2


@dataclass
class Solved:
    """Estimates of one fit, with what its standard errors need."""

    fit: Fit
    beta: np.ndarray
    bread: np.ndarray
    rows: int
    date_bands: int

    def effects(self, outcome: str, meat: np.ndarray, clusters: int, hidden: set) -> list[tuple]:
        """Percent effects with 95% intervals, without the weather terms.

        Small-sample factor G/(G-1) * (N-1)/(N-K); cell effects are nested in
        the clusters and not counted in K. Intervals use t with G-1 degrees.
        """
        counted = len(self.beta) + self.date_bands
        factor = clusters / (clusters - 1) * (self.rows - 1) / max(self.rows - counted, 1)
        variance = self.bread @ meat @ self.bread * factor
        error = np.sqrt(np.maximum(np.diag(variance), 0.0))
        reach = t_quantile(0.975, clusters - 1)
        pct = [100 * np.expm1(self.beta + side * reach * error) for side in (0, -1, 1)]
        return [
            (
                outcome,
                self.fit.check,
                term.group,
                term.label,
                *(float(values[i]) for values in pct),
                int(self.rows),
            )
            for i, term in enumerate(self.fit.terms)
            if term.kind not in hidden
        ]


EFFECTS_SCHEMA = (
    "outcome string, check string, group string, term string, effect_pct double, "
    "ci_low_pct double, ci_high_pct double, rows long"
)


def _meats(scores: DataFrame, sizes: Sequence[int]) -> tuple[list[np.ndarray], list[int]]:
    """Sum of the outer products of cluster scores, and clusters, of each fit.

    ``scores`` has ``fit, cluster, s array<double>``. Every task adds its own
    clusters up, so k x k numbers a fit come back, not the scores.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            for fit, part in batch.groupby("fit"):
                stack = np.vstack(part["s"].to_list())
                sums[fit] = sums.get(fit, 0) + stack.T @ stack
                counts[fit] = counts.get(fit, 0) + len(part)
        for fit, total in sums.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame(
                {
                    "fit": fit,
                    "i": i.ravel(),
                    "j": j.ravel(),
                    "value": total.ravel(),
                    "clusters": counts[fit],
                }
            )

    rows = (
        scores.select("fit", "s")
        .mapInPandas(partial, "fit int, i int, j int, value double, clusters long")
        .groupBy("fit", "i", "j")
        .agg(F.sum("value").alias("value"), F.sum("clusters").alias("clusters"))
        .collect()
    )
    meats = [np.zeros((size, size)) for size in sizes]
    clusters = [0] * len(sizes)
    for row in rows:
        meats[row.fit][row.i, row.j] = row.value
        clusters[row.fit] = row.clusters
    return meats, clusters


# Poisson on the collapsed panel ---------------------------------------------


def _demean(values: np.ndarray, weights: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Take weighted group means out of every column."""
    size = groups.max() + 1
    total = np.bincount(groups, weights, size)
    columns = values if values.ndim == 2 else values[:, None]
    means = np.column_stack(
        [np.bincount(groups, weights * column, size) / total for column in columns.T]
    )
    result = columns - means[groups]
    return result if values.ndim == 2 else result[:, 0]


def _poisson(y: np.ndarray, x: np.ndarray, group_band: np.ndarray, date_band: np.ndarray):
    """Poisson fit with group x band and date x band effects.

    Returns the estimates, the fitted means, the regressors with both effects
    taken out and the inverse information. Date effects are demeaned exactly;
    the few group effects are columns.
    """
    dummies = (group_band[:, None] == np.arange(group_band.max() + 1)).astype(float)
    every = np.column_stack([x, dummies])
    mu = (y + y.mean()) / 2
    eta, deviance = np.log(mu), np.inf
    for _ in range(100):
        working = eta + (y - mu) / mu
        flat, target = _demean(every, mu, date_band), _demean(working, mu, date_band)
        root = np.sqrt(mu)
        beta = np.linalg.lstsq(flat * root[:, None], target * root, rcond=1e-10)[0]
        eta = working - (target - flat @ beta)
        mu = np.exp(eta)
        if not (np.isfinite(mu).all() and (mu > 0).all()):
            raise ValueError("the Poisson fit diverges")
        logs = np.log(np.where(y > 0, y, 1.0) / mu)
        latest = 2 * np.sum(np.where(y > 0, y * logs, 0.0) - (y - mu))
        if abs(latest - deviance) < 1e-10 * (abs(latest) + 1):
            break
        deviance = latest
    else:
        raise ValueError("the Poisson fit did not converge in 100 iterations")
    flat, root = _demean(every, mu, date_band), np.sqrt(mu)[:, None]
    k = x.shape[1]
    own, fixed = flat[:, :k], flat[:, k:]
    left = own - fixed @ np.linalg.lstsq(fixed * root, own * root, rcond=1e-10)[0]
    bread = np.linalg.pinv(left.T @ (left * root**2))
    return beta[:k], mu, left, bread


def _collapsed(by_zone: DataFrame, cfg: StudyConfig) -> pd.DataFrame:
    """Trips by trip group, band and date: calendar-sized, so it can be collected.

    Also proves the panel is balanced, which the collapse rests on.
    """
    weather = [F.min(column).alias(column) for column in cfg.weather if column in by_zone.columns]
    table = (
        by_zone.groupBy("trip_group", "time_band", "date")
        .agg(F.sum("trips").alias("trips"), F.sum("cells").alias("cells"), *weather)
        .toPandas()
    )
    table["date"] = pd.to_datetime(table["date"])
    table["trips"] = table["trips"].astype(float)
    table = table.sort_values(["trip_group", "time_band", "date"]).reset_index(drop=True)
    dates = table["date"].nunique()
    group = table.groupby(["trip_group", "time_band"])["cells"]
    if (group.nunique() > 1).any() or (group.size() != dates).any():
        raise ValueError("the panel isn't balanced: some cell lacks a date")
    return table


def _ids(*columns: pd.Series) -> np.ndarray:
    return pd.MultiIndex.from_arrays(columns).factorize()[0]


def fit_trips(panel: DataFrame, fits: Sequence[Fit], cfg: StudyConfig) -> list[tuple]:
    """Poisson fits of trips: one collapse and one score job for all of them."""
    spark = panel.sparkSession
    weather = [column for column in cfg.weather if column in panel.columns]
    by_zone = (
        panel.groupBy(cfg.origin, "trip_group", "time_band", "date")
        .agg(
            F.sum("trips").alias("trips"),
            F.count("*").alias("cells"),
            *[F.min(column).alias(column) for column in weather],
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        table = _collapsed(by_zone, cfg)
        live = _live_cells(panel, fits, cfg)
        solved, regressors, constants = [], [], []
        for number, fit in enumerate(fits):
            part = table[fit.keeps(table)]
            # Levels with no trips can't inform the estimates
            by_date = part.groupby(["time_band", "date"])["trips"].transform("sum") > 0
            by_group = part.groupby(["trip_group", "time_band"])["trips"].transform("sum") > 0
            part = part[by_date & by_group].reset_index(drop=True)
            beta, mu, left, bread = _poisson(
                part["trips"].to_numpy(),
                _design(part, fit, cfg),
                _ids(part["trip_group"], part["time_band"]),
                _ids(part["time_band"], part["date"]),
            )
            levels = part.groupby("time_band")["date"].nunique()
            rows = sum(int(live[number].get(band, 0)) * n for band, n in levels.items())
            solved.append(Solved(fit, beta, bread, rows, int(levels.sum())))
            keys = part[["trip_group", "time_band", "date"]].assign(
                fit=number, date=part["date"].dt.date
            )
            regressors.append(keys.assign(x=list(left)))
            expected = pd.DataFrame(left * mu[:, None])
            constants.append(
                pd.concat([keys[["fit", "trip_group", "time_band"]], part["trips"], expected], axis=1)
                .groupby(["fit", "trip_group", "time_band"], as_index=False)
                .sum()
            )
        scores = _trip_scores(spark, by_zone, regressors, constants, cfg)
        meats, clusters = _meats(scores, [len(s.beta) for s in solved])
    finally:
        by_zone.unpersist()
    hidden = set(cfg.weather)
    return [
        row
        for result, meat, count in zip(solved, meats, clusters)
        for row in result.effects("trips", meat, count, hidden)
    ]


def _live_cells(panel: DataFrame, fits: Sequence[Fit], cfg: StudyConfig) -> list[dict[str, int]]:
    """Cells with any trips, by fit and band (cells without any are dropped)."""
    totals = panel.groupBy(*cfg.cell).agg(
        *[F.sum(F.when(fit.rows(), F.col("trips"))).alias(f"f{i}") for i, fit in enumerate(fits)]
    )
    counts = totals.groupBy("time_band").agg(
        *[F.count_if(F.col(f"f{i}") > 0).alias(f"f{i}") for i in range(len(fits))]
    )
    rows = counts.collect()
    return [{row.time_band: row[f"f{i}"] for row in rows} for i in range(len(fits))]


def _trip_scores(
    spark: SparkSession,
    by_zone: DataFrame,
    regressors: list[pd.DataFrame],
    constants: list[pd.DataFrame],
    cfg: StudyConfig,
) -> DataFrame:
    """Cluster scores: sum of x (y - mu) by zone.

    A cell's mean is its share of its group's mean, so the mu part needs only the
    zone's total in each group and band.
    """
    size = max(len(frame["x"].iloc[0]) for frame in regressors)

    def padded(values) -> list[float]:
        return [float(v) for v in values] + [0.0] * (size - len(values))

    x = pd.concat(regressors, ignore_index=True)
    wide = pd.DataFrame(np.vstack([padded(v) for v in x["x"]]), columns=[f"x{i}" for i in range(size)])
    on = ["trip_group", "time_band", "date"]
    x_table = spark.createDataFrame(pd.concat([x[["fit", *on]], wide], axis=1))
    x_table = x_table.withColumn("fit", F.col("fit").cast("int"))
    means = []
    for frame in constants:
        width = frame.shape[1] - 4
        ratio = frame[list(range(width))].div(frame["trips"], axis=0)
        means.append(
            frame[["fit", "trip_group", "time_band"]].assign(m=[padded(v) for v in ratio.to_numpy()])
        )
    m_table = spark.createDataFrame(
        pd.concat(means, ignore_index=True),
        "fit int, trip_group string, time_band string, m array<double>",
    )
    own = (
        by_zone.join(x_table, on)
        .groupBy("fit", F.col(cfg.origin).alias("cluster"), "trip_group", "time_band")
        .agg(
            F.sum("trips").alias("trips"),
            *[F.sum(F.col(f"x{i}") * F.col("trips")).alias(f"x{i}") for i in range(size)],
        )
        .where(F.col("trips") > 0)
    )
    return (
        own.join(m_table, ["fit", "trip_group", "time_band"])
        .groupBy("fit", "cluster")
        .agg(
            *[
                F.sum(F.col(f"x{i}") - F.col("trips") * F.col("m")[i]).alias(f"x{i}")
                for i in range(size)
            ]
        )
        .join(
            spark.createDataFrame(
                [(n, len(f["x"].iloc[0])) for n, f in enumerate(regressors)], "fit int, size int"
            ),
            "fit",
        )
        .select(
            "fit",
            "cluster",
            F.slice(F.array(*[f"x{i}" for i in range(size)]), F.lit(1), F.col("size")).alias("s"),
        )
    )


# Weighted least squares -----------------------------------------------------


def _base_terms(fits: Sequence[Fit]) -> list[Term]:
    """Distinct regressors of the fits, bands aside: bands are solved apart."""
    return list(dict.fromkeys(replace(term, band=None) for fit in fits for term in fit.terms))


def drop_singletons(rows: DataFrame, effects: Sequence[Sequence[str]]) -> DataFrame:
    """Drop rows alone in one of their effects until none is left.

    Levels are counted once. Each round looks at the levels that rows dropped so
    far have left alone, and adds their rows to the dropped ones: keys of a few
    rows, which are checkpointed. The effects' columns together tell rows apart.
    """
    keys = list(dict.fromkeys(column for columns in effects for column in columns))
    counts = [rows.groupBy(*columns).agg(F.count("*").alias("n")).checkpoint() for columns in effects]
    gone = None
    while True:
        alone = []
        for columns, count in zip(effects, counts):
            left = count
            if gone is not None:
                lost = gone.groupBy(*columns).agg(F.count("*").alias("lost"))
                left = count.join(lost, list(columns)).withColumn("n", F.col("n") - F.col("lost"))
            alone.append(left.where(F.col("n") == 1).select(*columns))
        hit = reduce(
            DataFrame.unionByName,
            [
                rows.join(single, list(columns), "left_semi").select(*keys)
                for columns, single in zip(effects, alone)
            ],
        ).distinct()
        if gone is not None:
            hit = hit.join(gone, keys, "left_anti")
        elif all(single.isEmpty() for single in alone):
            return rows
        hit = hit.checkpoint()
        if hit.isEmpty():
            return rows.join(gone, keys, "left_anti")
        gone = hit if gone is None else gone.unionByName(hit).checkpoint()


def fit_pay(panel: DataFrame, fits: Sequence[Fit], cfg: StudyConfig) -> list[tuple]:
    """Weighted least squares fits of log engaged-hour pay.

    Fits on the same rows share one elimination of the effects.
    """
    spark = panel.sparkSession
    sets = list(dict.fromkeys(fit.row_set() for fit in fits))
    members = [[fit for fit in fits if fit.row_set() == row_set] for row_set in sets]
    base = [_base_terms(group) for group in members]
    bands = cfg.band_names
    days = (cfg.last_date - cfg.first_date).days + 1

    in_sets = F.filter(
        F.array(*[F.when(group[0].rows(), F.lit(i)) for i, group in enumerate(members)]),
        lambda number: number.isNotNull(),
    )
    rows = panel.where(F.col("log_eph").isNotNull() & (F.col("trips_with_earnings") > 0)).select(
        *cfg.cell,
        "trip_group",
        F.datediff("date", F.lit(cfg.first_date)).alias("t"),
        F.col("trips_with_earnings").cast("double").alias("w"),
        F.col("log_eph").alias("y"),
        F.explode(in_sets).alias("rows_of"),
    )
    cell = ["rows_of", *cfg.cell]
    rows = drop_singletons(rows, [cell, ["rows_of", "time_band", "t"]])
    sizes = {
        (row.rows_of, row.time_band): row
        for row in rows.groupBy("rows_of", "time_band")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("t").alias("dates"),
            F.count_distinct(cfg.origin, "dropoff_group").alias("cells"),
        )
        .collect()
    }
    if not sizes:
        raise ValueError("no cell has engaged-hour pay on more than one date")
    # One row a cell: at most one entry a date of the calendar
    cells = (
        rows.groupBy(*cell, "trip_group")
        .agg(
            F.collect_list("t").alias("t"),
            F.collect_list("w").alias("w"),
            F.collect_list("y").alias("y"),
        )
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        designs = spark.sparkContext.broadcast(_pay_designs(panel, members, base, days, cfg))
        effects_of_dates = _date_effects(cells, designs, sizes, days, cfg)
        shared = spark.sparkContext.broadcast(effects_of_dates)
        grams = _zone_grams(cells, designs, shared, days, cfg).persist(
            StorageLevel.MEMORY_AND_DISK
        )
        width = 1 + max(map(len, base))
        totals = np.zeros((len(sets), len(bands), width, width))
        for row in grams.groupBy("rows_of", "time_band", "i", "j").agg(F.sum("value").alias("v")).collect():
            totals[row.rows_of, bands.index(row.time_band), row.i, row.j] = row.v
        solved, selections = [], []
        for number, (group, terms) in enumerate(zip(members, base)):
            for fit in group:
                picks = [
                    (1 + terms.index(replace(term, band=None)), term.band) for term in fit.terms
                ]
                normal, moment = _normal_equations(totals[number], picks, bands)
                bread = np.linalg.pinv(normal)
                n = sum(row.n for (key, _), row in sizes.items() if key == number)
                levels = sum(row.dates for (key, _), row in sizes.items() if key == number)
                solved.append(Solved(fit, bread @ moment, bread, n, levels))
                selections.append((number, picks, bread @ moment))
        scores = _pay_scores(grams, selections, bands, width)
        meats, clusters = _meats(scores, [len(s.beta) for s in solved])
        grams.unpersist()
    finally:
        cells.unpersist()
    hidden = set(cfg.weather)
    found = {
        result.fit.check: result.effects("log_eph", meat, count, hidden)
        for result, meat, count in zip(solved, meats, clusters)
    }
    return [row for fit in fits for row in found[fit.check]]


def _pay_designs(panel, members, base, days, cfg) -> list[dict[str, np.ndarray]]:
    """Regressors by row set and trip group: a days x terms table each."""
    weather = (
        panel.groupBy("date").agg(*[F.min(column).alias(column) for column in cfg.weather]).toPandas()
    )
    calendar = pd.DataFrame({"date": pd.date_range(cfg.first_date, periods=days)})
    weather["date"] = pd.to_datetime(weather["date"])
    calendar = calendar.merge(weather, on="date", how="left").fillna(0.0)
    designs = []
    for group, terms in zip(members, base):
        values = np.column_stack(
            [
                _time_values(term.kind, calendar["date"], group[0].start, calendar, cfg)
                for term in terms
            ]
        )
        designs.append(
            {
                name: values * [float(name in term.members) for term in terms]
                for name in cfg.trip_group_names
            }
        )
    return designs


def _cell_values(row, designs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dates, weights and columns (pay, then regressors) of one cell."""
    t = np.asarray(row.t)
    x = designs[row.rows_of][row.trip_group][t]
    return t, np.asarray(row.w), np.column_stack([np.asarray(row.y), x])


def _date_effects(cells, designs, sizes, days, cfg) -> dict[tuple[int, str], np.ndarray]:
    """Date effects of every column, by row set and band, with cell effects out.

    The normal equations are never formed: conjugate gradients need only their
    products with a table of days x columns, which tasks add up over their cells.
    So what comes to the driver grows with days x columns. Effects are known up to
    a constant, which residuals from a cell's mean don't show.
    """
    keys = sorted(sizes)
    width = 1 + max(max(x.shape[1] for x in design.values()) for design in designs.value)
    schema = "rows_of int, time_band string, t int, v array<double>"

    def summed(cell_rows, columns: int) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, np.ndarray] = {}
            for batch in batches:
                for row in batch.itertuples(index=False):
                    t, values = cell_rows(row)
                    key = (row.rows_of, row.time_band)
                    if key not in sums:
                        sums[key] = np.zeros((days, columns))
                    sums[key][t, : values.shape[1]] += values
            for (number, band), total in sums.items():
                active = np.flatnonzero(np.abs(total).sum(axis=1) > 0)
                yield pd.DataFrame(
                    {"rows_of": number, "time_band": band, "t": active, "v": list(total[active])}
                )

        parts = cells.select("rows_of", "time_band", "trip_group", "t", "w", "y").mapInPandas(
            partial, schema
        )
        totals = parts.groupBy("rows_of", "time_band", "t").agg(
            F.array(*[F.sum(F.col("v")[i]) for i in range(columns)]).alias("v")
        )
        out = np.zeros((len(keys), days, columns))
        place = {key: i for i, key in enumerate(keys)}
        for row in totals.toArrow().to_pylist():
            out[place[row["rows_of"], row["time_band"]], row["t"]] = row["v"]
        return out

    def right_side(row):
        t, w, values = _cell_values(row, designs.value)
        # The last column is the diagonal, by which the system is scaled
        own = np.column_stack([w[:, None] * (values - w @ values / w.sum()), w - w * w / w.sum()])
        out = np.zeros((len(t), width + 1))
        out[:, : own.shape[1] - 1], out[:, -1] = own[:, :-1], own[:, -1]
        return t, out

    first = summed(right_side, width + 1)
    right, diagonal = first[:, :, :-1], first[:, :, -1:]
    scaled = np.divide(1.0, diagonal, out=np.zeros_like(diagonal), where=diagonal > 0)
    spark = cells.sparkSession
    effects, left = np.zeros_like(right), right.copy()
    direction = scaled * left
    size = (left * direction).sum(axis=1, keepdims=True)
    goal = GRADIENT_TOLERANCE * np.abs(right).max(axis=1, keepdims=True)
    for _ in range(MAX_GRADIENTS):
        if (np.abs(left).max(axis=1, keepdims=True) <= goal).all():
            break
        held = spark.sparkContext.broadcast({key: direction[i] for i, key in enumerate(keys)})

        def product(row, held=held):
            t, w = np.asarray(row.t), np.asarray(row.w)
            own = held.value[row.rows_of, row.time_band][t]
            return t, w[:, None] * (own - w @ own / w.sum())

        moved = summed(product, width)
        held.unpersist()
        along = (direction * moved).sum(axis=1, keepdims=True)
        step = np.divide(size, along, out=np.zeros_like(size), where=along > 0)
        effects += step * direction
        left -= step * moved
        after = (left * scaled * left).sum(axis=1, keepdims=True)
        direction = scaled * left + direction * np.divide(
            after, size, out=np.zeros_like(size), where=size > 0
        )
        size = after
    else:
        raise ValueError(f"date effects don't settle in {MAX_GRADIENTS} steps")
    own = {number: 1 + next(iter(design.values())).shape[1] for number, design in enumerate(designs.value)}
    return {key: effects[i, :, : own[key[0]]] for i, key in enumerate(keys)}


def _zone_grams(cells, designs, effects, days, cfg) -> DataFrame:
    """Weighted cross products of the residualised columns, by row set, band and zone."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                t, w, values = _cell_values(row, designs.value)
                left = values - effects.value[(row.rows_of, row.time_band)][t]
                left = left - w @ left / w.sum()
                key = (row.rows_of, row.time_band, row.cluster)
                sums[key] = sums.get(key, 0) + left.T @ (w[:, None] * left)
        for (number, band, cluster), total in sums.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame(
                {
                    "rows_of": number,
                    "time_band": band,
                    "cluster": cluster,
                    "i": i.ravel(),
                    "j": j.ravel(),
                    "value": total.ravel(),
                }
            )

    schema = "rows_of int, time_band string, cluster long, i int, j int, value double"
    return (
        cells.select(
            "rows_of", "time_band", F.col(cfg.origin).alias("cluster"), "trip_group", "t", "w", "y"
        )
        .mapInPandas(partial, schema)
        .groupBy("rows_of", "time_band", "cluster", "i", "j")
        .agg(F.sum("value").alias("value"))
    )


def _normal_equations(totals: np.ndarray, picks: Sequence[tuple], bands: Sequence[str]):
    """A fit's normal equations from the band-wise cross products (column 0 is pay)."""
    k = len(picks)
    normal, moment = np.zeros((k, k)), np.zeros(k)
    for b, band in enumerate(bands):
        on = np.array([only is None or only == band for _, only in picks], float)
        index = [i for i, _ in picks]
        normal += totals[b][np.ix_(index, index)] * np.outer(on, on)
        moment += totals[b][index, 0] * on
    return normal, moment


def _pay_scores(
    grams: DataFrame, selections: Sequence[tuple], bands: Sequence[str], width: int
) -> DataFrame:
    """Cluster scores of every fit from the zones' cross products."""
    by_zone = grams.groupBy("rows_of", "cluster").agg(
        F.collect_list(F.struct("time_band", "i", "j", "value")).alias("entries")
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                totals = np.zeros((len(bands), width, width))
                for entry in row.entries:
                    totals[bands.index(entry["time_band"]), entry["i"], entry["j"]] = entry["value"]
                for fit, (number, picks, beta) in enumerate(selections):
                    if number == row.rows_of:
                        normal, moment = _normal_equations(totals, picks, bands)
                        out.append((fit, row.cluster, moment - normal @ beta))
            yield pd.DataFrame(out, columns=["fit", "cluster", "s"])

    return by_zone.mapInPandas(score, "fit int, cluster long, s array<double>")


# Tables ---------------------------------------------------------------------


def effects_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), EFFECTS_SCHEMA)


def did_checks(
    panel: DataFrame, cfg: StudyConfig, outcomes: Sequence[str] = ("trips", "log_eph"),
    checks: Sequence[str] | None = None,
) -> DataFrame:
    """Effects of every fit on both outcomes, with the rows each fit used."""
    fits = [fit for fit in check_fits(cfg) if checks is None or fit.check in checks]
    estimators = {"trips": fit_trips, "log_eph": fit_pay}
    # Only what the estimators read is kept
    needed = [*cfg.cell, "date", "trip_group", "trips", "trips_with_earnings", "log_eph"]
    panel = panel.select(*needed, *cfg.weather).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = [row for outcome in outcomes for row in estimators[outcome](panel, fits, cfg)]
    finally:
        panel.unpersist()
    return effects_table(panel.sparkSession, rows)


def event_study(model_table: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Monthly effects on trips by group, against the last month before the start."""
    rows = model_table.where(F.col("service") == cfg.service)
    monthly = rows.groupBy(*cfg.cell, "trip_group", F.trunc("date", "month").alias("date")).agg(
        F.sum("trips").alias("trips")
    )
    months = [row.date for row in monthly.select("date").distinct().orderBy("date").collect()]
    start = cfg.intervention.replace(day=1)
    reference = max(month for month in months if month < start)
    groups = ("treated", *RING_HALVES)
    terms = tuple(
        Term(group, f"month:{month}") for group in groups for month in months if month != reference
    )
    found = fit_trips(monthly, [Fit("event study", terms, cfg.intervention)], cfg)
    flat = [("trips", "event study", g, str(reference), 0.0, 0.0, 0.0, 0) for g in groups]
    return (
        effects_table(model_table.sparkSession, found + flat)
        .select(
            "group",
            F.to_date("term").alias("month"),
            "effect_pct",
            "ci_low_pct",
            "ci_high_pct",
        )
        .orderBy("group", "month")
    )


def effect_dollars(effects: DataFrame, median: DataFrame) -> DataFrame:
    """The headline pay effect in dollars an hour: percent times the base median."""
    headline = effects.where(
        (F.col("outcome") == "log_eph") & (F.col("check") == "headline") & (F.col("term") == "all")
    )
    return headline.join(median, F.col("group") == F.col("trip_group")).select(
        "group",
        "median_eph",
        *[
            (F.col("median_eph") * F.col(f"{name}_pct") / 100).alias(f"{name}_dollars")
            for name in ("effect", "ci_low", "ci_high")
        ],
    )
