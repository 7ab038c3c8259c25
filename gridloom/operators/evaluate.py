"""Encodings, splits, folds and evaluation measures as aggregations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def label_of(*flags: str) -> Column:
    """Flags side by side as text."""
    return F.concat(*[F.col(c).cast("string") for c in flags])


def encoded(df: DataFrame, label: str, into: str = "code") -> DataFrame:
    """`df` with the place of its label among the sorted distinct labels."""
    classes = df.select(F.col(label).alias("_l")).where("_l is not null").distinct().agg(F.array_sort(F.collect_list("_l")).alias("_all"))
    codes = classes.select(F.posexplode("_all").alias(into, label))
    return df.join(F.broadcast(codes), label, "left")


def standardised(df: DataFrame, columns: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """`df` with z_ columns by the mean and population deviation of `train` (or its own rows); 0 where a column is constant."""
    stats = (train if train is not None else df).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return df.withColumns({f"z_{c}": ratio(F.col(c) - F.lit(stats[f"_m_{c}"]), F.lit(stats[f"_s_{c}"])) for c in columns})


def _shuffled(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key)]


ROWS_IN_BUCKET = 100_000


def _digits(df: DataFrame) -> int:
    """Leading digits (base 16) of the order that cut `df` into buckets of ROWS_IN_BUCKET rows or fewer."""
    return max(1, math.ceil(math.log(max(1, df.count() / ROWS_IN_BUCKET), 16)))


def _placed(df: DataFrame, key: str, label: str, seed: int, digits: int | None = None) -> DataFrame:
    """`df` with _place (from 0, in shuffled order) within its label, and _n rows of the label. The order's first digits split a label over as many tasks as its rows ask for."""
    order = _shuffled(key, seed)
    rows = df.withColumn("_h", order[0]).withColumn("_b", F.substring("_h", 1, digits or _digits(df)))
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    by = Window.partitionBy(label).orderBy("_b")
    before = sizes.select(label, "_b", F.coalesce(F.sum("_c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(label)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key)) - 1
    return rows.withColumn("_i", inside).join(before, [label, "_b"]).withColumn("_place", F.col("_before") + F.col("_i")).drop("_h", "_b", "_i", "_before")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """`df` once for each repeat, with repeat and fold; labels are spread evenly over the folds."""
    out, digits = None, _digits(df)
    for r in range(repeats):
        one = _placed(df, key, label, seed + r, digits).withColumns({"repeat": F.lit(r), "fold": (F.col("_place") % folds).cast("int")}).drop("_place", "_n")
        out = one if out is None else out.unionByName(one)
    return out


def split_count(positives: Column, wanted: int = 5) -> Column:
    """As many folds as wanted, but no more than there are positive rows, and two at least."""
    return F.greatest(F.lit(2), F.least(F.lit(wanted), positives)).cast("int")


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.7, seed: int = 42) -> DataFrame:
    """`df` with in_train: exactly the floor of the share of each label.

    Buckets of the shuffled order lie on one side as a whole, but for the one of each label in which the share ends: only its rows are ranked.
    """
    order = _shuffled(key, seed)
    rows = df.withColumn("_h", order[0]).withColumn("_b", F.substring("_h", 1, _digits(df)))
    sizes = rows.groupBy(label, "_b").agg(F.count("*").alias("_c"))
    by, every = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(label)
    ends = sizes.select(F.col(label).alias("_l"), "_b", "_c", F.sum("_c").over(by).alias("_to"), F.floor(F.sum("_c").over(every) * share).alias("_k"))
    ends = ends.where("_to - _c < _k and _to >= _k").select("_l", F.col("_b").alias("_end"), (F.col("_k") - F.col("_to") + F.col("_c")).alias("_left"))  # at most a row for each label
    placed = rows.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("_l")), "left")
    whole = placed.where("_end is null or _b <> _end").withColumn("in_train", F.coalesce(F.col("_b") < F.col("_end"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("_l").orderBy("_h", key))
    cut = placed.where("_b = _end").withColumn("in_train", rank <= F.col("_left"))
    return whole.unionByName(cut).select(*df.columns, "in_train")


def random_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """`df` with in_train: exactly the floor of the share of all rows, in a seeded order."""
    return stratified_split(df.withColumn("_all", F.lit(0)), key, "_all", share, seed).drop("_all")


def between_dates(df: DataFrame, ts: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from the first to the last moment, both included; pushed into the scan."""
    for given, fits in ((first, F.col(ts).__ge__), (last, F.col(ts).__le__)):
        df = df if given is None else df.where(fits(F.lit(given).cast("timestamp_ntz")))
    return df


def group_split(df: DataFrame, group: str, percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows of about the percentage of groups, and the rest; a group is never parted."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 6), 16, 10).cast("long") % 100
    chosen = df.select(group).distinct().where(bucket < percent)
    return df.join(chosen, group, "left_semi"), df.join(chosen, group, "left_anti")


def confusion(df: DataFrame, truth: str, pred: str, labels: Sequence) -> DataFrame:
    """truth and a column of counts for each predicted label."""
    return df.groupBy(truth).agg(*[F.count(F.when(F.col(pred) == x, 1)).alias(f"pred_{x}") for x in labels])


def binary_measures(truth: str, pred: str, count: str | None = None) -> list[Column]:
    """Aggregates: n, accuracy, precision, recall, f1 of class 1, macro_f1. `count`: a row stands for so many equal ones."""
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col(count))), F.lit(0)) if count else F.count(F.when(c, 1))
    c = lambda t, p: many((F.col(truth) == t) & (F.col(pred) == p))
    tp, fp, fn, tn = c(1, 1), c(0, 1), c(1, 0), c(0, 0)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    n = many(F.lit(True))
    return [n.alias("n"), ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1"), ((f1 + f0) / 2).alias("macro_f1")]


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """label, precision, recall, f1, support of each class, from counts by label."""
    t = df.select(F.col(truth).alias("label"), F.lit(1).alias("support"), F.lit(0).alias("said"), (F.col(truth) == F.col(pred)).cast("int").alias("hit"))
    p = df.select(F.col(pred).alias("label"), F.lit(0).alias("support"), F.lit(1).alias("said"), F.lit(0).alias("hit"))
    g = t.unionByName(p).groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    hit, said, n = F.col("hit"), F.col("said"), F.col("support")
    return g.select("label", ratio(hit, said).alias("precision"), ratio(hit, n).alias("recall"), ratio(2 * hit, said + n).alias("f1"), "support")


def report_averages(report: DataFrame) -> DataFrame:
    """average (macro, weighted), precision, recall, f1, support of a class report; weighted by support."""
    n, names = F.sum("support"), ("precision", "recall", "f1")
    macro = report.agg(F.lit("macro").alias("average"), *[F.avg(c).alias(c) for c in names], n.alias("support"))
    weighted = report.agg(F.lit("weighted").alias("average"), *[ratio(F.sum(F.col(c) * F.col("support")), n).alias(c) for c in names], n.alias("support"))
    return macro.unionByName(weighted)


def clipped(p: Column, least: float = 1e-6) -> Column:
    """A probability kept away from 0 and 1."""
    return F.least(F.greatest(p, F.lit(least)), F.lit(1 - least))


def pr_curve(df: DataFrame, truth: str, score: str, group: str) -> DataFrame:
    """group, score, precision, recall, f1 at each distinct score as the threshold."""
    at = df.groupBy(F.col(group), F.col(score).alias("score")).agg(F.count("*").alias("n"), F.count(F.when(F.col(truth) == 1, 1)).alias("pos"))
    at = at.withColumn("b", F.floor(F.col("score") * 4096))  # running sums within buckets of scores, on top of those of the buckets above
    sums = at.groupBy(group, "b").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bp"))
    above = Window.partitionBy(group).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "b", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("bn", "bp")], F.sum("bp").over(Window.partitionBy(group)).alias("total"))
    down = Window.partitionBy(group, "b").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = at.select(group, "b", "score", F.sum("n").over(down).alias("n"), F.sum("pos").over(down).alias("pos"))
    c = own.join(sums, [group, "b"]).select(group, "score", (F.col("n") + F.col("bn")).alias("said"), (F.col("pos") + F.col("bp")).alias("hit"), F.col("total").alias("pos"))
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("pos"))
    return c.select(group, "score", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-12)).alias("f1"))


def best_threshold(curve: DataFrame, group: str, default: float = 0.5) -> DataFrame:
    """group, threshold (the smallest score with the highest f1; the default where none has any), f1."""
    best = F.when(F.max("f1") > 0, F.max_by("score", F.struct("f1", -F.col("score")))).otherwise(default)
    return curve.groupBy(group).agg(best.alias("threshold"), F.max("f1").alias("f1"))


def class_weights(df: DataFrame, label: str, smoothing: float = 1e-6) -> DataFrame:
    """label, n, weight: inverse frequencies that sum to 1."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    inverse = 1 / (F.col("n") + smoothing)
    return g.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(F.lit(1))))  # as many rows as labels


def rmse(truth: str, pred: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(truth) - F.col(pred), F.lit(2.0))))


def focal_loss(p_true: Column, alpha: Column, gamma: float = 2.0) -> Column:
    """Aggregate: the mean focal loss of the probabilities given to the true class; the weight is part of the confidence."""
    ce = -alpha * F.log(p_true)
    return F.avg(F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce)
