"""Menus, keyed lookups, tiered matching, unit arithmetic, checked casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def menu(df: DataFrame, column: str, numeric: bool = False) -> DataFrame:
    """value (text) and place: the distinct values in order; numbers in the order of numbers.

    Values are ranked within buckets that follow the order (by magnitude, or by the first two characters), and a bucket starts
    where those before it end: no task holds all values."""
    values = df.select(F.col(column).cast("double" if numeric else "string").alias("x")).where("x is not null").distinct()
    bucket = F.floor(F.signum("x") * F.log2(F.abs("x") + 1) * 8) if numeric else F.substring("x", 1, 2)
    values = values.withColumn("b", bucket)
    sizes = values.groupBy("b").agg(F.count("*").alias("n"))
    before = sizes.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("x")) - 1
    text = F.when(F.col("x") == F.floor("x"), F.floor("x").cast("string")).otherwise(F.col("x").cast("string")) if numeric else F.col("x")
    return values.join(before, "b").select(place.cast("int").alias("place"), text.alias("value"))


def first_match(requests: DataFrame, table: DataFrame, on: Sequence[str], row_id: str) -> DataFrame:
    """Each request with the first of the rows of its key; a request without any has NULLs."""
    rest = [c for c in table.columns if c not in on]
    first = table.groupBy(*on).agg(F.min_by(F.struct(*rest), row_id).alias("_m"))
    return requests.join(first, list(on), "left").select(*requests.columns, "_m.*")


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct runs of these numbers of characters in a text; a shorter text is a run itself."""
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*map(runs, sizes)))


def tiered_match(requests: DataFrame, table: DataFrame, key: str, size: str, kind: str, name: str, label: str, row_id: str, suffix: str = "Bundled") -> DataFrame:
    """key, tier, row_id of the best row for each request, NULLs without any.

    Tier 1: the label is `size kind name` but for case; tier 2: without the suffix; tier 3: size, kind and name occur in
    the label in this order, anywhere. Tiers 1 and 2 are hash joins; only requests that they leave go to tier 3, each
    distinct one once, and its candidates are the labels with its rarest run of three characters. Ties go to the first row.
    """
    full = F.concat_ws(" ", size, kind, name)
    plain = F.trim(F.regexp_replace(full, rf"(?i)\s*\b{suffix}\b", ""))
    asked = requests.select(key, F.lower(full).alias("_l1"), F.lower(plain).alias("_l2"), F.lower(F.col(size)).alias("_s"), F.lower(F.col(kind)).alias("_k"), F.lower(F.regexp_replace(F.col(name), rf"(?i)\s*\b{suffix}\b", "")).alias("_n"))
    rows = table.select(F.col(row_id).alias("_row"), F.lower(label).alias("_label"))
    exact = rows.groupBy("_label").agg(F.min("_row").alias("_row"))
    one = asked.join(exact.select(F.col("_label").alias("_l1"), F.col("_row").alias("_r1")), "_l1", "left")
    two = one.join(exact.select(F.col("_label").alias("_l2"), F.col("_row").alias("_r2")), "_l2", "left")
    two = two.withColumns({"tier": F.when(F.col("_r1").isNotNull(), 1).when(F.col("_r2").isNotNull(), 2), "_best": F.coalesce("_r1", "_r2")})
    left = two.where("tier is null").select("_s", "_k", "_n").where("_s is not null and _k is not null and _n is not null").distinct()
    index = exact.withColumn("_gram", F.explode(_grams(F.col("_label"), (1, 2, 3))))
    known = index.groupBy("_gram").agg(F.count("*").alias("_n_gram"))
    own = left.select("_s", "_k", "_n", F.explode(F.array_distinct(F.concat(*[_grams(F.col(c), (3,)) for c in ("_s", "_k", "_n")]))).alias("_gram")).where("_gram <> ''")
    rarest = own.join(known, "_gram", "left").groupBy("_s", "_k", "_n").agg(F.min_by("_gram", F.struct(F.coalesce("_n_gram", F.lit(0)), "_gram")).alias("_gram"))
    after = "substring({0}, locate({1}, {0}) + length({1}))"
    one_on = after.format("_label", "_s")
    found = F.expr(f"contains(_label, _s) and contains({one_on}, _k) and contains({after.format(one_on, '_k')}, _n)")
    three = rarest.join(index, "_gram").where(found).groupBy("_s", "_k", "_n").agg(F.min("_row").alias("_r3"))
    return two.join(three, ["_s", "_k", "_n"], "left").select(key, F.coalesce("tier", F.when(F.col("_r3").isNotNull(), 3)).alias("tier"), F.when(F.col("tier").isNull(), F.col("_r3")).otherwise(F.col("_best")).alias(row_id))


def mva(kv: Column, amps: Column) -> Column:
    """Three-phase power in MVA."""
    return F.round(1.732 * kv * amps / 1000, 2)


def checked(df: DataFrame, casts: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose named text columns are filled and cast, with the cast values; and all other rows as they are."""
    tried = {f"_{c}": F.col(c).try_cast(kind) for c, kind in casts.items()}
    rows = df.withColumns(tried)
    good = F.lit(True)
    for c in casts:
        good = good & F.coalesce(F.trim(c) != "", F.lit(False)) & F.col(f"_{c}").isNotNull()
    keep = [F.col(f"_{c}").alias(c) if c in casts else F.col(c) for c in df.columns]
    return rows.where(good).select(*keep), rows.where(~good).select(*df.columns)
