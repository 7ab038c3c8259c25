"""Mixing of sources to target weights by Pfair scheduling.

The documents of a source, in a seeded random order, form blocks of `block` rows, which are scheduled as two halves. Half i
of a source of weight w (its share of the slots) is released at slot floor(i / w) and due at ceil((i + 1) / w);
earliest deadline first gives every slot a half. Weights are exact fractions.

The slots are dealt into segments, each of which is one task's work: SEGMENT slots, or as many as give the lightest
source a whole half. At a segment's edge every source stands at its exact share, rounded down or up (the largest
remainders up); inside, the segment's own counts are the weights. So after any number of slots each source is less than one half from the line between two edges, and
an edge is less than one half from the share: together less than one block. When a source has given its last half, a
new phase begins with the weights of the sources that are left; tasks work out phases and segments from the sources' counts.

Defined results: a null source is a source of its own; texts do not matter; every row gets one position, repeated
rows too; a source without a weight in `weights` gets the smallest weight; a source of weight 0 comes after all
others; an empty table gives no rows. Columns of the input stay; a column of the same name as a new one is replaced.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import count, islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.work import Shelter, numbered, scratch, staged

ADDED = ("position", "slot", "block")
SEGMENT = 1 << 14


def pfair(weights: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """The source and number of each slot, without end: earliest deadline first among those that are released."""
    period = sum(weights.values())
    later = [(0, s, 0) for s in sorted(weights) if weights[s]]  # by release
    ready: list[tuple[int, int, str, int]] = []  # by deadline; of equal ones, the heavier source
    heapq.heapify(later)
    for t in count():
        while later and later[0][0] <= t:
            _, s, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * period // weights[s]), -weights[s], s, i))
        _, _, s, i = heapq.heappop(ready)
        yield s, i
        heapq.heappush(later, ((i + 1) * period // weights[s], s, i + 1))


def shares_at(weights: Mapping[str, Fraction], slots: int) -> dict[str, int]:
    """How many of the first `slots` slots each source has: its share rounded down, or up for the largest remainders."""
    exact = {s: w * slots for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: slots - sum(out.values())]:
        out[s] += 1
    return out


def phases(halves: Mapping[str, int], weights: Mapping[str, Fraction]) -> Iterator[tuple[int, int, dict[str, Fraction], dict[str, int]]]:
    """first slot, number of slots, weights (they sum to 1) and halves given before, of each phase."""
    left, slot = {s: n for s, n in halves.items() if n}, 0
    while left:
        own = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, Fraction(1))
        total = sum(own.values())
        own = {s: w / total for s, w in own.items()}
        n = int(min(left[s] / w for s, w in own.items()))  # no share is beyond what its source has
        yield slot, n, own, {s: halves[s] - left.get(s, 0) for s in own}
        for s, k in shares_at(own, n).items():
            left[s] -= k
        left, slot = {s: k for s, k in left.items() if k}, slot + n


def _step(own: Mapping[str, Fraction], size: int) -> int:
    """Slots of a segment: enough that a share grows by one or more, so that no share, up or down, is less at its end."""
    return max(size, math.ceil(1 / min(own.values())))


def segment_count(halves: Mapping[str, int], weights: Mapping[str, Fraction], size: int) -> int:
    return sum(max(1, n // _step(own, size)) for _, n, own, _ in phases(halves, weights))


def segments(halves: Mapping[str, int], weights: Mapping[str, Fraction], size: int, numbers: Sequence[int] | None = None) -> Iterator[tuple[int, int, int, dict[str, Fraction], dict[str, int]]]:
    """first slot, place in its phase, number of slots, weights and halves given before the phase, of each segment, or of
    those with these numbers (in ascending order), which are found in their phase without a walk over the others."""
    base = 0
    for first, n, own, before in phases(halves, weights):
        step = _step(own, size)
        total = max(1, n // step)
        for k in range(total) if numbers is None else (g - base for g in numbers if base <= g < base + total):
            at = k * step
            yield first + at, at, (n if k + 1 == total else at + step) - at, own, before
        base += total


def slots_of(at: int, size: int, own: Mapping[str, Fraction], before: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """source and half of the slots of a segment."""
    a, b = shares_at(own, at), shares_at(own, at + size)
    for s, i in islice(pfair({s: b[s] - a[s] for s in own}), size):
        yield s, before[s] + a[s] + i


def schedule(halves: Mapping[str, int], weights: Mapping[str, Fraction], size: int = SEGMENT) -> Iterator[tuple[str, int]]:
    """source and half of every slot."""
    for _, *part in segments(halves, weights, size):
        yield from slots_of(*part)


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, block: int = 16, seed: int = 7, key: str = "doc_id", source: str = "source") -> DataFrame:
    """`docs` with position (from 0), slot and block. Without weights: shares in the ratio of count to the power alpha."""
    if block < 2 or block % 2:
        raise ValueError("a block is two halves: its rows must be an even number")
    spark, own, half = docs.sparkSession, Shelter(docs), block // 2
    rows = numbered(own.df, "mixed-rows")
    name = F.coalesce(F.concat(F.lit("="), F.col(own.name(source)).cast("string")), F.lit(""))
    narrow = rows.select(name.alias("s"), F.xxhash64(F.lit(seed), F.col(own.name(key)).cast("string")).alias("u"), "row")
    with scratch(spark, "mixing") as tmp:
        order = ["s", "u", "row"]
        ranked = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("s", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i"))
        ranked = tmp.staged(ranked, "ranked")
        # As many rows as parts and sources in them: the place of a source's first row of a part within the source.
        sizes = tmp.staged(ranked.groupBy("part", "s").agg(F.count("*").alias("n"), F.min("i").alias("lo")), "sizes")
        before = F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = sizes.select("part", "s", (F.col("lo") - F.coalesce(before, F.lit(0))).alias("off"))
        counts = {r["s"]: r["n"] for r in sizes.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        halves = {s: -(-n // half) for s, n in counts.items()}
        shares = {s: Fraction(float(n) ** alpha) for s, n in counts.items()}
        if weights is not None:
            shares = {s: Fraction(weights.get(s[1:] if s else None, min(weights.values()))) for s in counts}
        number = segment_count(halves, shares, SEGMENT)

        def planned(batches):
            for pdf in batches:
                mine = sorted(pdf["id"].tolist())
                for g, (first, *part) in zip(mine, segments(halves, shares, SEGMENT, mine), strict=True):
                    slots = enumerate(slots_of(*part), first)
                    while out := [(g, s, k, t, min(half, counts[s] - k * half)) for t, (s, k) in islice(slots, 10_000)]:
                        yield pd.DataFrame(out, columns=["g", "s", "k", "slot", "size"])

        plan = spark.range(0, number, 1, max(1, number)).mapInPandas(planned, "g long, s string, k long, slot long, size long")
        plan = tmp.staged(plan, "slots")
        ends = plan.groupBy("g").agg(F.sum("size").alias("size"))
        ends = ends.select("g", F.coalesce(F.sum("size").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # as many rows as segments
        inside = Window.partitionBy("g").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        first = plan.withColumn("first", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(ends, "g").select("s", "k", "slot", (F.col("first") + F.col("base")).alias("first"))
        placed = ranked.join(starts, ["part", "s"]).withColumn("j", F.col("i") - F.col("off")).withColumn("k", F.floor(F.col("j") / half))
        at = placed.join(first, ["s", "k"]).select("row", F.floor(F.col("j") / block).alias("block"), "slot", (F.col("first") + F.col("j") % half).alias("position"))
        at = staged(at, "positions")
    return own.restored(rows.join(at.hint("merge"), "row"), ADDED, ADDED)  # dealt by row at any size: disk grows with the input, not by a step
