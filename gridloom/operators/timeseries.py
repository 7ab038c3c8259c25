"""Time series by key: regular grids, gaps, calendar, lags, rolling means, shifted lookups, recursive forecasts.

Windows are partitioned by the series; a series is as long as its hours.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly(events: DataFrame, series: str, ts: str, value: str) -> DataFrame:
    """series, ts (hour), value (mean), n."""
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz")
    return events.groupBy(F.col(series).alias("series"), hour.alias("ts")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))


def hourly_grid(rows: DataFrame) -> DataFrame:
    """series, ts, value on every hour between a series' first and last; NULL in gaps. Repeated hours are averaged."""
    one = rows.groupBy("series", "ts").agg(F.avg("value").alias("value"))
    span = one.groupBy("series").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select("series", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    return grid.join(one, ["series", "ts"], "left")


def _run(until: int = 0) -> Window:
    return Window.partitionBy("series").orderBy("ts").rowsBetween(Window.unboundedPreceding, until)


def seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def interpolated(rows: DataFrame, value: str = "value", into: str = "filled") -> DataFrame:
    """Linear in time between known values; a leading gap stays NULL, a trailing gap takes the last value."""
    ahead = Window.partitionBy("series").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), seconds(F.col("ts")))
    known = rows.withColumns({
        "_v0": F.last(value, ignorenulls=True).over(_run()), "_t0": F.last(at, ignorenulls=True).over(_run()),
        "_v1": F.first(value, ignorenulls=True).over(ahead), "_t1": F.first(at, ignorenulls=True).over(ahead),
    })
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (seconds(F.col("ts")) - F.col("_t0")) / (F.col("_t1") - F.col("_t0"))
    return known.withColumn(into, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(between)).drop("_v0", "_t0", "_v1", "_t1")


def with_calendar(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """hour, dayofweek (Monday 0), month, is_weekend."""
    day = F.weekday(ts)
    return rows.withColumns({"hour": F.hour(ts), "dayofweek": day, "month": F.month(ts), "is_weekend": (day >= 5).cast("int")})


def with_lags(rows: DataFrame, lags: Sequence[int] = (1, 24, 168), value: str = "value") -> DataFrame:
    w = Window.partitionBy("series").orderBy("ts")
    return rows.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})


def with_rolling_means(rows: DataFrame, spans: Sequence[int] = (24, 168), value: str = "value", inclusive: bool = True) -> DataFrame:
    """Mean of the last n rows, NULL until n values are there. inclusive: the row itself counts."""
    out = {}
    for n in spans:
        w = Window.partitionBy("series").orderBy("ts").rowsBetween(1 - n - (not inclusive), -(not inclusive))
        out[f"rolling_{n}h_mean"] = F.when(F.count(value).over(w) >= n, F.avg(value).over(w))
    return rows.withColumns(out)


def value_before(rows: DataFrame, hours: int, value: str = "value", into: str | None = None) -> DataFrame:
    """The value exactly `hours` earlier, else the last value before the row."""
    past = rows.select("series", (F.col("ts") + F.expr(f"interval {hours} hours")).alias("ts"), F.col(value).alias("_p"))
    last = F.lag(value).over(Window.partitionBy("series").orderBy("ts"))
    return rows.withColumn("_l", last).join(past, ["series", "ts"], "left").withColumn(into or f"before_{hours}h", F.coalesce("_p", "_l")).drop("_p", "_l")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series."""
    w = Window.partitionBy("series").orderBy(F.desc("ts"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def head(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows of each series."""
    w = Window.partitionBy("series").orderBy("ts")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


FEATURES = ("hour", "dayofweek", "month", "is_weekend", "lag_1", "lag_24", "lag_168", "rolling_24h_mean", "rolling_168h_mean")


def features(rows: DataFrame, inclusive: bool = False) -> DataFrame:
    """All features of the filled series; rows of the warm-up have NULLs. Rolling means are of the past only unless inclusive."""
    filled = interpolated(hourly_grid(rows)).select("series", "ts", F.col("filled").alias("value"))
    return with_rolling_means(with_lags(with_calendar(filled)), inclusive=inclusive)


@dataclass(frozen=True)
class FlatTrees:
    """Fitted regression trees as arrays, trees x nodes; a leaf points to itself. As large as the model's parameters say, whatever the data."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    depth: int

    @staticmethod
    def of(model) -> FlatTrees:
        """From a boosted regression model over numbers, through its trees' own text."""
        every = [_parsed(t.toDebugString) for t in model.trees]
        width = max(len(t) for t in every)
        table = np.zeros((len(every), width, 5))
        for i, t in enumerate(every):
            table[i, : len(t)] = t
        ints = lambda j: table[:, :, j].astype(np.int32)
        return FlatTrees(ints(0), table[:, :, 1], ints(2), ints(3), table[:, :, 4], np.array(model.treeWeights), max(t.depth for t in model.trees))

    def predicted(self, x: np.ndarray) -> np.ndarray:
        """rows x columns to one number a row."""
        tree, at, rows = np.arange(len(self.column))[None, :], np.zeros((len(x), len(self.column)), np.int32), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.column[tree, at]] <= self.cut[tree, at]
            at = np.where(low, self.left[tree, at], self.right[tree, at])
        return self.value[tree, at] @ self.weights


def _parsed(text: str) -> np.ndarray:
    """column, cut, left, right, value of each node of a tree's text; lines go down the left side first."""
    nodes: list[list[float]] = []
    open_nodes: list[int] = []
    pending: tuple[int, int] | None = None
    for line in map(str.strip, text.splitlines()[1:]):
        if line.startswith("Else"):
            pending = (open_nodes.pop(), 3)
            continue
        i = len(nodes)
        if line.startswith("Predict:"):
            nodes.append([0, 0.0, i, i, float(line.split(":")[1])])
        elif found := re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line):
            nodes.append([int(found[1]), float(found[2]), i, i, 0.0])
            open_nodes.append(i)
        elif line:
            raise ValueError(f"not a split of a number: {line}")
        else:
            continue
        if pending:
            nodes[pending[0]][pending[1]] = i
        pending = (i, 2) if line.startswith("If") else None
    return np.array(nodes)


SERIES_IN_GROUP = 500


def forecast(model, rows: DataFrame, steps: int) -> DataFrame:
    """series, ts, prediction for the next `steps` hours of each series; lags and means of a step see the steps before it.

    The trees go to the tasks as arrays. Some hundred series are one group: their last 168 hours are a matrix, and every
    step is one prediction for all of them and one more column. Nothing is planned step by step. `model`: a fitted
    pipeline that ends in boosted trees, or anything with predicted(rows x FEATURES).
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    trees = model if hasattr(model, "predicted") else FlatTrees.of(model.stages[-1])
    n = rows.select("series").distinct().count()
    groups = max(1, -(-n // SERIES_IN_GROUP))
    schema = f"series {rows.schema['series'].dataType.simpleString()}, ts timestamp_ntz, prediction double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["series", "ts"], kind="stable")
        names, first, size = np.unique(pdf["series"].to_numpy(), return_index=True, return_counts=True)
        h = np.full((len(names), 168 + steps), np.nan)
        row = np.repeat(np.arange(len(names)), size)
        h[row, 168 - size[row] + np.arange(len(pdf)) - first[row]] = pdf["value"].to_numpy(float)
        last = pdf["ts"].to_numpy()[first + size - 1]
        every = np.arange(len(names))
        for s in range(steps):
            now, have = 168 + s, np.minimum(size + s, 168)
            ts = pd.DatetimeIndex(last + np.timedelta64(s + 1, "h"))
            newest = h[:, now - 1]
            x = np.empty((len(names), len(FEATURES)))
            x[:, 0], x[:, 1], x[:, 2], x[:, 3] = ts.hour, ts.dayofweek, ts.month, ts.dayofweek >= 5
            for j, k in enumerate((1, 24, 168)):
                v = h[:, now - k]
                x[:, 4 + j] = np.where((have >= k) & ~np.isnan(v), v, newest)
            for j, k in enumerate((24, 168)):
                m = np.minimum(have, k)
                used = np.arange(168)[None, :] >= 168 - m[:, None]
                x[:, 7 + j] = np.where(used, h[:, now - 168 : now], 0.0).sum(1) / m
            h[every, now] = trees.predicted(x)
        hours = (last[:, None] + np.arange(1, steps + 1).astype("timedelta64[h]")[None, :]).ravel()
        return pd.DataFrame({"series": np.repeat(names, steps), "ts": hours, "prediction": h[:, 168:].ravel()})

    group = F.pmod(F.xxhash64("series"), F.lit(groups)).alias("group")
    return tail(rows, 168).select("series", "ts", "value", group).groupBy("group").applyInPandas(lambda pdf: run(pdf), schema)
