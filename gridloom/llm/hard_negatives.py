"""Hard negatives of anchors by exact integer scores from subset-sum tables (the method of the Four Russians).

Vectors become integers. A candidate's integers are cut into bit planes, and each plane of eight dimensions is a byte. An
anchor has, for every eight dimensions, a table of the sums of all 256 subsets of its components; a candidate's byte is
the place in it. The inner product is the sum of the looked-up numbers, plane by plane, each plane counting twice the one
below it and the sign's plane against. No product of two components is ever taken and no score is an estimate.

Anchors and candidates are packed into blocks. Candidates' blocks are dealt over lanes, anchors' blocks, the smaller
side, are shuffled to every lane, and each pair of blocks leaves only the best few of each anchor. A first pass over the pairs
finds each anchor's positives, a second one, which knows their scores, the negatives.

Rows with a null key, label or vector, or with a null or non-finite component, take no part. Rows of another dimension
than the anchor's do not match it. Repeated keys are rows of their own: equal scores by key, then by row. Integers
saturate at 64 bits, and sums beyond 64 bits wrap. Labels are integers. Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import work

ANCHORS, CANDIDATES = 128, 1024
PAIRS_AT_ONCE = 64
NONE = np.iinfo(np.int64).min


def subset_sums(vectors: np.ndarray, groups: int, width: type = np.int64) -> np.ndarray:
    """groups x 256 x anchors: the sum of each subset of each eight dimensions; bit j of the place stands for dimension j."""
    padded = np.zeros((len(vectors), groups * 8), np.int64)
    padded[:, : vectors.shape[1]] = vectors
    by = padded.reshape(len(vectors), groups, 8).transpose(1, 2, 0).astype(width)
    table = np.zeros((groups, 256, len(vectors)), width)
    for j in range(8):
        table[:, 1 << j : 2 << j] = table[:, : 1 << j] + by[:, j, None]
    return table


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """planes x groups x rows bytes: two's complement with as many planes as the largest number asks for, the sign's last."""
    reach = int(np.max(np.where(vectors < 0, ~vectors, vectors), initial=0))
    planes, groups = reach.bit_length() + 1, -(-vectors.shape[1] // 8)
    out = np.zeros((planes, groups, len(vectors)), np.uint8)
    for k in range(planes):
        out[k] = np.packbits(((vectors >> min(k, 63)) & 1).astype(np.uint8), axis=1, bitorder="little").T.reshape(groups, len(vectors))
    return out


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows x anchors: inner products by lookups, from the sign's plane down."""
    n, anchors = planes.shape[2], table.shape[2]
    total, looked = np.zeros((n, anchors), table.dtype), np.empty((n, anchors), table.dtype)
    for k in range(len(planes) - 1, -1, -1):
        total += total
        for g in range(planes.shape[1]):
            np.take(table[g], planes[k, g], axis=0, out=looked, mode="clip")
            if k == len(planes) - 1:
                total -= looked
            else:
                total += looked
    return total


def first_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and columns of the k largest of each row of `score` (anchors x candidates; NONE: no candidate), equal ones by column."""
    n = score.shape[1]
    at = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(score), NONE)
    row, column = np.nonzero((score >= at[:, None]) & (score > NONE))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _packed(rows: DataFrame, size: int, planes: bool = False, windows: bool = False) -> DataFrame:
    """Blocks of rows of one dimension: numbers as bytes; candidates' values as bit planes, anchors' values plain, with the windows of their negatives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lengths = batch.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                some = np.flatnonzero(lengths == dim)
                key, number = (batch.column(i).to_numpy(zero_copy_only=False)[some] for i in (1, 0))
                some = some[np.lexsort((number, key))]  # so that equal scores are by key, then by row
                for a in range(0, len(some), size):
                    own = batch.take(pa.array(some[a : a + size]))
                    values = own.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), dim)
                    out = {n: own.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i, n in enumerate(names[:3])}
                    if windows:
                        out |= {n: own.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i, n in ((4, "low"), (5, "high"))}
                    out["values"] = (bit_planes(values) if planes else values).tobytes()
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in out.items()} | {"dim": pa.array([int(dim)], pa.int32())})

    more = ", low binary, high binary" if windows else ""
    return rows.mapInArrow(pack, f"row binary, key binary, label binary{more}, values binary, dim int")


def _pairs(anchors: DataFrame, candidates: DataFrame, lanes: int) -> DataFrame:
    """Every block of anchors beside every block of candidates of the same dimension. Both sides are shuffled: the anchors of all lanes together would not fit the driver of a broadcast."""
    each = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("to")
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], each)
    a, c = a.repartition(lanes, "to", "a_dim"), candidates.repartition(lanes, "lane", "dim")
    return a.hint("merge").join(c, (F.col("to") == F.col("lane")) & (F.col("a_dim") == F.col("dim")))


def _scored(pair: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scores, anchors x candidates, and whether the labels are equal."""
    dim = pair["dim"]
    groups = -(-dim // 8)
    vectors = np.frombuffer(pair["a_values"], np.int64).reshape(-1, dim) if dim else np.zeros((len(pair["a_row"]) // 8, 0), np.int64)
    n = len(pair["row"]) // 8
    planes = np.frombuffer(pair["values"], np.uint8)
    planes = planes.reshape(-1, groups, n) if dim else np.zeros((1, 0, n), np.uint8)
    reach = float(np.max(np.abs(vectors.astype(float)), initial=0)) * dim * 2.0 ** len(planes)
    s = scores(subset_sums(vectors, groups, np.int32 if reach < 2**31 else np.int64), planes).T
    same = np.frombuffer(pair["a_label"], np.int64)[:, None] == np.frombuffer(pair["label"], np.int64)[None, :]
    return np.ascontiguousarray(s, dtype=np.int64), same


def _positives(k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pair = batch.slice(i, 1).to_pylist()[0]
                s, same = _scored(pair)
                row, key, a_row, a_key = (np.frombuffer(pair[c], np.int64) for c in ("row", "key", "a_row", "a_key"))
                other = a_row[:, None] != row[None, :]
                a, c = first_of(np.where(same & other, s, NONE), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a_row[a], a_key[a], row[c], key[c], s[a, c])], ["anchor", "anchor_id", "row", "key", "score"])

    return find


def _negatives(k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pair = batch.slice(i, 1).to_pylist()[0]
                s, same = _scored(pair)
                row, key, a_row = (np.frombuffer(pair[c], np.int64) for c in ("row", "key", "a_row"))
                low, high = (np.frombuffer(pair[c], np.int64).reshape(len(a_row), -1) for c in ("a_low", "a_high"))
                s = np.where(same, NONE, s)
                for p in range(low.shape[1]):
                    a, c = first_of(np.where((s >= low[:, p, None]) & (s <= high[:, p, None]), s, NONE), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a_row[a], np.full(len(a), p + 1, np.int32), row[c], key[c], s[a, c])], ["anchor", "place", "row", "key", "score"])

    return find


def hard_negatives(
    rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row that meets the condition `anchors`) and each of
    its first `positives` other rows of the same label, the first `negatives` rows of other labels whose score is from `low` to `high` percent of the positive's."""
    spark = rows.sparkSession
    lanes = int(spark.conf.get("spark.sql.shuffle.partitions"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    valid = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    ints = F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")).cast("long"))
    base = valid.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), ints.alias("values"), anchors.alias("is_anchor"))
    with work.scratch(spark, "negatives") as tmp:
        base = work.numbered(base, "vectors", tmp.place("vectors")).select("row", "key", "label", "values", "is_anchor")
        packed = _packed(base.drop("is_anchor"), CANDIDATES, planes=True).withColumn("lane", F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int"))
        candidates = tmp.staged(packed, "planes")
        chosen = base.where("is_anchor").select("row", "key", "label", "values")
        found = _pairs(tmp.staged(_packed(chosen, ANCHORS), "anchors"), candidates, lanes).mapInArrow(_positives(positives), "anchor long, anchor_id long, row long, key long, score long")
        first = Window.partitionBy("anchor").orderBy(F.desc("score"), "key", "row")
        with work.writing(spark, PAIRS_AT_ONCE):
            found = tmp.staged(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives), "positives")
        # ceil(low * score / 100) and floor(high * score / 100) in whole numbers: score is 100 q + r
        q = F.expr("(score - pmod(score, 100)) div 100")
        window = F.struct("place", (q * low + F.expr(f"({low} * pmod(score, 100) + 99) div 100")).alias("low"), (q * high + F.expr(f"({high} * pmod(score, 100)) div 100")).alias("high"))
        per = found.groupBy("anchor").agg(F.sort_array(F.collect_list(window)).alias("w")).select(F.col("anchor").alias("row"), "w")
        filled = lambda name, rest: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda i: F.coalesce(F.try_element_at(F.col("w")[name], i), F.lit(rest).cast("long")))
        asked = chosen.join(per.hint("merge"), "row").select("row", "key", "label", "values", filled("low", 1).alias("low"), filled("high", 0).alias("high"))
        again = _pairs(tmp.staged(_packed(asked, ANCHORS, windows=True), "asked"), candidates, lanes).mapInArrow(_negatives(negatives), "anchor long, place int, row long, key long, score long")
        first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "key", "row")
        again = again.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives).select("anchor", "place", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
        pairs = found.select("anchor", "place", "anchor_id", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"))
        out = again.join(pairs.hint("merge"), ["anchor", "place"])
        with work.writing(spark, PAIRS_AT_ONCE):
            return work.staged(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
