"""Best-fit packing of token pieces into sequences, with certified bin counts.

Documents longer than the capacity are cut into full pieces, the first of which may be shorter; nothing else is
cut. Full pieces are sequences of their own. The rest is dealt into groups; each group is packed best-fit
decreasing and its bin count is held against a lower bound from dual feasible functions. Groups that meet the
bound are certified and stay; the others give up the documents of their bins that are not full, exchange them under
another dealing and pack them again, until all groups are certified or that saves no bin any more.

Groups are dealt at random. With `order` they are runs of documents in that order (an exchange is one between
neighbours), and a sequence's number is the place of its first piece: sequences by number follow the order.

Defined results: a null text is empty and gives one piece, the end id alone; repeated rows are packed each for
itself; an empty table gives no pieces. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import bpe
from gridloom.llm.work import Scratch, fresh_dir, scratch, staged

PIECES_IN_GROUP = 20_000


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    open_rooms, used = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        room -= n
        if room:
            free[room].append(b)
            open_rooms |= 1 << room
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int, most: int = 30) -> int:
    """Bins that any packing needs; counts[n] pieces have length n. The best of three families of dual feasible functions."""
    size = np.arange(len(counts), dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    eps = np.arange(1, capacity // 2 + 1)[:, None]
    rounded = np.where(size > capacity - eps, capacity, np.where(size < eps, 0, size))  # large ones fill a bin, small ones vanish
    best = max(best, int((-(-(rounded * counts).sum(1) // capacity)).max(initial=0)))
    for k in range(1, most + 1):
        for x in (size[None, :], rounded):
            whole = (k + 1) * x % capacity == 0
            value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # k times the function's value
            best = max(best, int((-(-(value * counts).sum(1) // (k * capacity))).max(initial=0)))
    for e in range(1, capacity // 2 + 1):  # pairs of large pieces never share a bin; small ones count by how many fit beside
        per = capacity // e
        value = np.where(size > capacity / 2, per - (capacity - size) // e, np.where(size >= e, 1, 0))
        best = max(best, -(-int((value * counts).sum()) // per))
    return best


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """key, piece, start, length, ids_crc32, piece_id, the columns of `order` as o0, o1, ... and, if asked for, ids."""
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    places = [f"o{i}" for i in range(len(order))]

    def cut(batches):
        base, at = TaskContext.get().partitionId() << 36, 0
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            out, source = [], []
            for row, (k, ids) in enumerate(zip(pdf["key"], bpe.encoder(tokenizer).encode(pdf["text"].tolist()), strict=True)):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    x = ids[4 * a : 4 * b]
                    out.append((k, p, a, b - a, zlib.crc32(x), base + at, np.frombuffer(x, "<i4") if with_ids else None))
                    source.append(row)
                    at += 1
            frame = pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32", "piece_id", "ids"])
            frame = frame if with_ids else frame.drop(columns="ids")
            yield frame.assign(**{c: pdf[c].take(source).to_numpy() for c in places})

    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"key {kinds['key']}, piece int, start long, length long, ids_crc32 long, piece_id long" + ", ids array<int>" * with_ids
    return own.mapInPandas(cut, ", ".join([schema, *[f"{c} {kinds[c]}" for c in places]]))


def _pack_groups(items: DataFrame, groups: int, capacity: int) -> DataFrame:
    """piece_id, length, rank, sequence_id (the smallest rank in it), offset, bins and bound (of the group), fill (of the bin). Groups: ranges of `deal`."""

    def pack(batches):
        pdf = pd.concat([x for x in batches if len(x)] or [pd.DataFrame({c: [] for c in ("piece_id", "length", "rank", "deal")}, dtype="int64")])
        if not len(pdf):
            return
        pdf = pdf.drop(columns="deal").sort_values(["length", "rank"], ascending=[False, True], ignore_index=True)
        n = pdf["length"].to_numpy(np.int64)
        bins, offsets, used = best_fit_decreasing(n, capacity)
        fill = np.bincount(bins, weights=n, minlength=used).astype(np.int64)
        first = pdf["rank"].groupby(bins).min().to_numpy()
        bound = lower_bound(np.bincount(n, minlength=capacity + 1), capacity)
        yield pdf.assign(sequence_id=first[bins], offset=offsets, bins=used, bound=bound, fill=fill[bins])

    dealt = items.select("piece_id", "length", "rank", "deal").repartitionByRange(groups, "deal")
    return dealt.mapInPandas(pack, "piece_id long, length long, rank long, sequence_id long, offset long, bins long, bound long, fill long")


def pack_lengths(items: DataFrame, tmp: Scratch, capacity: int = 1024, ordered: bool = False) -> DataFrame:
    """sequence_id and offset for each piece_id; `items` has piece_id, length below the capacity and rank."""
    deal = lambda df, turn: df.withColumn("deal", F.col("rank") if ordered else F.xxhash64("piece_id", F.lit(turn)))
    groups_of = lambda n: max(1, math.ceil(n / PIECES_IN_GROUP))
    done, turn, now = [], 0, tmp.staged(_pack_groups(deal(items, 0), groups_of(items.count()), capacity), "packed")
    while True:
        turn += 1
        left = now.where((F.col("bins") > F.col("bound")) & (F.col("fill") < capacity))
        n, used = left.agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if used < 2:
            break
        again = tmp.staged(_pack_groups(deal(left, turn), groups_of(n), capacity), "packed")
        if again.agg(F.countDistinct("sequence_id")).first()[0] >= used:
            break
        done.append(now.where((F.col("bins") <= F.col("bound")) | (F.col("fill") == capacity)))
        now = again
    for part in done:
        now = now.unionByName(part)
    return now.select("piece_id", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    pieces = staged(pieces_of(docs, tokenizer, capacity, end_id, key, text, with_ids, order), "pieces", fresh_dir(docs.sparkSession, "pieces"))
    with scratch(docs.sparkSession, "packing") as tmp:
        ranks = pieces.select("piece_id", "length", F.col("piece_id").alias("rank"))
        if order:
            by = [*[f"o{i}" for i in range(len(order))], "piece_id"]
            sorted_ = pieces.select("piece_id", "length", *by[:-1]).repartitionByRange(*by).sortWithinPartitions(*by)
            ranks = tmp.staged(sorted_.select("piece_id", "length", F.monotonically_increasing_id().alias("rank")), "ranks")
        full = ranks.where(F.col("length") == capacity).select("piece_id", F.col("rank").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        placed = staged(pack_lengths(ranks.where(F.col("length") < capacity), tmp, capacity, bool(order)).unionByName(full), "placed")
    return pieces.drop(*[f"o{i}" for i in range(len(order))]).join(placed, "piece_id").drop("piece_id")


def certified_bound(pieces: DataFrame, capacity: int = 1024) -> int:
    """The lower bound over all pieces, from the counts of each length (as many rows as the capacity)."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").count().collect():
        counts[n] = c
    return lower_bound(counts, capacity)
