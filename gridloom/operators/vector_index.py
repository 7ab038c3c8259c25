"""A persisted vector index with exact answers: blocks of near vectors that are skipped only when geometry proves it.

Vectors of length one are assigned to the nearest of some centroids, ordered by their distance to it, and cut into
blocks. A block knows its centroid and the least and largest distance of its members, so by the triangle inequality no
member is nearer to a query than the query's distance to the centroid allows. A search first reads, for each query, the
nearest blocks that hold k vectors, and then every other block that may still hold one of the k best; blocks that
no query asks for are not read. Scores are those of `retrieval.top_k`, and so are the answers.

Layout below a folder: `blocks` (Parquet by list: block, ids, vectors) and `lists` (Parquet: block, list, centroid, near,
far, n). Centroids come from a bounded sample of rows; every row is indexed. Rows without a vector are left out, vectors
of length zero lie in a list of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.retrieval import scores
from gridloom.plans.folders import staged

BLOCK = 256
SAMPLE = 20_000
QUERIES_AT_ONCE = 256
SLACK = 1e-9
MOST_BYTES = 256 << 20  # of the blocks' list in a task


def _units(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v**2).sum(1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def centroids_of(sample: np.ndarray, count: int, rounds: int = 5, seed: int = 42) -> np.ndarray:
    """Centres of the sample's units by a few rounds of nearest means from seeded starts."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _units(sums), centres)
    return centres


def build_index(corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, seed: int = 42) -> None:
    """Writes the index of all rows with a vector (of one dimension); `lists` is the root of their number, at most 4096, unless given."""
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed))).limit(SAMPLE).toPandas()  # bounded: the smallest hashes
    if len(sample):
        units = _units(np.stack(sample["v"].to_numpy()))
        centres = centroids_of(units, lists or max(1, min(4096, int(n**0.5))), seed=seed)
    else:
        centres = np.zeros((0, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            u = _units(v)
            near = (u @ centres.T).argmax(1)
            far = np.sqrt(np.maximum(((u - centres[near]) ** 2).sum(1), 0))
            zero = ~v.any(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.where(zero, -1, near).astype(np.int32)), pa.array(np.where(zero, 0.0, far))], ["id", "v", "list", "far"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held, blocks = _cut(t, last=False)
            for b in blocks:
                yield b.append_column("block", pa.array([number]))
                number += 1
        if held is not None and len(held):
            for b in _cut(held, last=True)[1]:
                yield b.append_column("block", pa.array([number]))
                number += 1

    def _cut(t: pa.Table, last: bool) -> tuple[pa.Table | None, list[pa.RecordBatch]]:
        """Blocks of one list each, and the rows that may go on with the next batch."""
        lists_ = t["list"].to_numpy()
        ends = [*np.flatnonzero(lists_[1:] != lists_[:-1]) + 1, len(t)]
        a, out = 0, []
        for e in ends:
            while e - a >= BLOCK or (a < e and (e < len(t) or last)):
                own = t.slice(a, min(BLOCK, e - a)).combine_chunks()
                v = own["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                d = own["far"].to_numpy()
                out.append(pa.RecordBatch.from_pydict({"list": pa.array([int(lists_[a])], pa.int32()), "ids": [own["id"].to_numpy().tobytes()], "v": [v.tobytes()], "dim": pa.array([len(v) // len(own)], pa.int32()), "near": [float(d.min())], "far": [float(d.max())], "n": pa.array([len(own)], pa.int32())}))
                a += len(own)
        return (t.slice(a) if a < len(t) else None), out

    parts = max(1, min(n // 50_000, int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = rows.mapInArrow(assign, "id long, v array<double>, list int, far double")
    blocks = placed.repartitionByRange(parts, "list", "far", "id").sortWithinPartitions("list", "far", "id").mapInArrow(pack, "list int, ids binary, v binary, dim int, near double, far double, n int, block long")
    blocks.write.mode("overwrite").partitionBy("list").parquet(f"{path}/blocks")
    spark = corpus.sparkSession
    centre = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centroid array<double>")
    known = spark.read.schema("block long, near double, far double, n int, list int").parquet(f"{path}/blocks")
    known.join(F.broadcast(centre), "list", "left").write.mode("overwrite").parquet(f"{path}/lists")  # 4096 centroids at most


def _bounds(q: np.ndarray, lists: dict) -> np.ndarray:
    """queries x blocks: the least distance of units that the triangle inequality leaves."""
    u = _units(q)
    d = np.sqrt(np.maximum(2 - 2 * u @ lists["centroid"].T, 0))[:, lists["place"]]
    low = np.maximum(np.maximum(d - lists["far"], lists["near"] - d), 0)
    return np.where(lists["zero"], np.sqrt(2.0), low)


def _asked(queries: DataFrame, lists: dict, k: int, again: bool) -> DataFrame:
    """query, v, block, part: the blocks that each query has to see. First the likeliest that hold k vectors; again: all others whose bound reaches the k-th score."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            low = _bounds(q, lists)
            order = np.argsort(low, axis=1, kind="stable")
            enough = np.cumsum(lists["n"][order], axis=1)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(low.shape[1])[None, :], axis=1)
            first = rank <= (enough < k).sum(1)[:, None]
            if again:
                least = batch.column(2).to_numpy(zero_copy_only=False)
                zero = ~q.any(1)  # its score is 0 with every vector
                most = np.where(zero[:, None], 0.0, 1 - low**2 / 2)
                first = ~first & ((most >= least[:, None] - SLACK) | np.isnan(least)[:, None])
            row, at = np.nonzero(first)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(lists["block"][at]), pa.array(lists["list"][at])], ["query", "v", "block", "list"])

    more = ["least"] if again else []
    return queries.select("query", "v", *more).mapInArrow(ask, "query long, v array<double>, block long, list int")


def _best(asked: DataFrame, blocks: DataFrame, k: int, digits: int) -> DataFrame:
    """query, id, score: of every block and query the k best; queries meet a block some hundred at a time."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                v = np.frombuffer(r["v"]).reshape(-1, r["dim"])
                q = np.array([x["v"] for x in r["qs"]])
                s = np.round(scores(q, v, "cosine"), digits)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                names = np.repeat([x["query"] for x in r["qs"]], order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], ["query", "id", "score"])

    packed = asked.groupBy("block", "list", F.pmod(F.xxhash64("query"), F.lit(64)).alias("some")).agg(F.collect_list(F.struct("query", "v")).alias("every"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size("every") - 1) / QUERIES_AT_ONCE).cast("int")), lambda i: F.slice("every", i * QUERIES_AT_ONCE + 1, QUERIES_AT_ONCE))
    pairs = packed.select("block", "list", F.explode(pieces).alias("qs")).join(blocks, ["list", "block"])
    return pairs.select("qs", "ids", "v", "dim").mapInArrow(score, "query long, id long, score double")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 12) -> tuple[DataFrame, float]:
    """query, id, score, rank as `retrieval.top_k` by cosine gives them, and the mean share of the blocks that a query had to see."""
    known = spark.read.schema("block long, near double, far double, n int, list int, centroid array<double>").parquet(f"{path}/lists")
    size = known.agg(F.count("*"), F.max(F.size("centroid"))).first()
    if size[0] * (36 + 8 * max(1, size[1] or 1)) > MOST_BYTES:
        raise ValueError(f"{size[0]} blocks are too many to hold in a task; build the index with larger blocks or search parts of it")
    rows = known.toPandas()  # checked above
    blocks = spark.read.schema("ids binary, v binary, dim int, block long, list int").parquet(f"{path}/blocks")
    given = staged(queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<double>").alias("v")), "queries")
    names = np.unique(rows["list"][rows["list"] >= 0])
    centre = {r: np.asarray(c, float) for r, c in zip(rows["list"], rows["centroid"], strict=True) if r >= 0}
    dim = len(next(iter(centre.values()))) if centre else given.agg(F.max(F.size("v"))).first()[0] or 1
    lists = {
        "block": rows["block"].to_numpy(np.int64), "list": rows["list"].to_numpy(np.int32), "near": rows["near"].to_numpy(float), "far": rows["far"].to_numpy(float), "n": rows["n"].to_numpy(np.int64),
        "centroid": np.stack([centre[i] for i in names]) if len(names) else np.zeros((1, dim)), "place": np.searchsorted(names, np.maximum(rows["list"].to_numpy(), 0)) if len(names) else np.zeros(len(rows), int), "zero": rows["list"].to_numpy() < 0,
    }
    lists["place"] = np.minimum(lists["place"], len(lists["centroid"]) - 1)
    given = given.where(F.size("v") == dim)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    one = staged(_asked(given, lists, k, False), "asked")
    first = staged(ranked(_best(one, blocks, k, digits)), "first")
    least = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    two = staged(_asked(given.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(float("nan")))), lists, k, True), "asked")
    best = staged(ranked(first.drop("rank").unionByName(_best(two, blocks, k, digits))), "best")
    seen, every = one.count() + two.count(), given.count() * len(rows)
    return best, seen / every if every else 0.0
