"""Ranked lexical search over hashed max-sketches.

Every document has a sketch: its terms are hashed to cells, and a cell holds the largest impact of its terms, rounded up
to a byte. The impact of a term is what it adds to a score but for the query's weight, so the weighted sum of the cells
of a query's terms is never below the document's score. One matrix product gives these bounds for a batch of documents
and a block of queries. Each query then takes its documents by descending bound, counts their terms exactly, and stops
at the first bound below the k-th score it has; the texts of all other documents are never cut into terms.

The index is a table of sketches (with key and text) and a table of document frequencies of all terms, both in the
shared folder. Queries come to the driver in blocks of bounded size, each a pass over the index. No bound is guessed and
nothing is dropped, so results are exact.

Null and empty texts have no terms: such documents and queries match nothing. Repeated rows are documents of their own.
Null keys come last among equal scores. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import work

CELLS = 2048
STEP = 4096  # a byte of a sketch stands for so much impact; the largest impact is 10**6
RUN = 8 << 20
_PLAIN = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _PLAIN else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and characters above ASCII, A-Z in lower case; the bytes of a character above ASCII are all above 127."""
    return text.translate(_FOLD).split() if text else []


def damping(n: int, docs: int, total: int) -> int:
    """m of a document with n terms among `docs` documents with `total` terms."""
    return 10 + (90 * n * docs) // total if total else 10


def impact(tf, m):
    """What a term with tf occurrences adds for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Stretches of the batch with about RUN bytes each; a longer text is one alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or b"") > RUN:
            yield a, i
            a, size = i, 0
        size += len(t or b"")
    if a < len(texts):
        yield a, len(texts)


def _counted(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, the vocabulary, and of every pair of text and term: text, term and count."""
    lists = [terms(t) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    coded = pa.array(chain.from_iterable(lists), pa.binary()).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    pairs = np.repeat(np.arange(len(lists)), n) * max(1, len(vocabulary)) + coded.indices.to_numpy()
    pairs, tf = np.unique(pairs, return_counts=True)
    doc, code = np.divmod(pairs, max(1, len(vocabulary)))
    return n, vocabulary, doc, code, tf


def cells(vocabulary: list[bytes], count: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) % count for t in vocabulary), np.int64, len(vocabulary))


@dataclass(frozen=True)
class Index:
    """Paths of the two tables; documents with a term, their terms with repeats, cells of a sketch."""

    sketches: str
    frequencies: str
    docs: int
    total: int
    cells: int

    def weights(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        """`found` (with term) with w, the integer weight of the term; terms of weight 0 and unknown ones are left out."""
        df = spark.read.schema("term binary, df long").parquet(self.frequencies)
        w = F.floor(1000 * F.log((2.0 * self.docs + 2) / (2 * F.col("df") + 1))).cast("long")
        return found.join(df, "term").withColumn("w", w).where("w > 0").drop("df")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", count: int = CELLS) -> Index:
    """Counts all documents, then sketches all of them."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _runs(texts):
                n, vocabulary, _, code, _ = _counted(texts[a:b])
                df = np.bincount(code, minlength=len(vocabulary))
                yield pa.RecordBatch.from_pydict({
                    "term": pa.array([None, *vocabulary], pa.binary()), "df": np.concatenate([[np.count_nonzero(n)], df]).astype(np.int64), "total": np.concatenate([[n.sum()], np.zeros(len(df))]).astype(np.int64),
                })

    partial = source.select("text").mapInArrow(counted, "term binary, df long, total long")
    frequencies = work.staged(partial.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")), "frequencies", path := work.fresh_dir(spark, "frequencies"))
    sums = frequencies.where("term is null").first()
    n_docs, total = (sums["df"], sums["total"]) if sums else (0, 0)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _runs(texts):
                n, vocabulary, doc, code, tf = _counted(texts[a:b])
                m = np.array([damping(int(x), n_docs, total) for x in n], np.int64)
                level = -(-impact(tf, m[doc]) // STEP)
                folded = np.zeros((b - a) * count, np.uint8)
                np.maximum.at(folded, doc * count + cells(vocabulary, count)[code], level.astype(np.uint8))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array([r.tobytes() for r in folded.reshape(-1, count)], pa.binary()), batch.column(1).slice(a, b - a)], ["key", "n", "sketch", "text"])

    sketches = work.fresh_dir(spark, "sketches")
    some = source.where(F.octet_length("text") > 0)
    work.staged(some.mapInArrow(sketched, "key long, n long, sketch binary, text binary").where("n > 0"), "sketches", sketches)
    return Index(sketches, path, n_docs, total, count)


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """row, key and term of every distinct term of every query; rows are numbered, as keys may repeat."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            rows = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(chain.from_iterable(lists), pa.binary())], ["row", "term"])

    return queries.select("row", F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(cut, "row long, term binary")


def _searched(index: Index, items: list[tuple[int, dict[bytes, int]]], k: int):
    """The task: bounds of a batch for all items of the block by one product, then exact scores by descending bound."""
    count, n_docs, total = index.cells, index.docs, index.total
    used = np.unique(np.concatenate([cells(list(w), count) for _, w in items]))
    table = np.zeros((len(used), len(items)))
    for j, (_, w) in enumerate(items):
        np.add.at(table[:, j], np.searchsorted(used, cells(list(w), count)), np.array(list(w.values()), float) * STEP)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]  # (-score, key is null, key), k at most
        least = np.ones(len(items))
        for batch in batches:
            sketches = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, count)
            bounds = sketches[:, used].astype(float) @ table
            held: dict[int, tuple[Counter, int, int | None]] = {}
            for j, (_, weights) in enumerate(items):
                some = np.flatnonzero(bounds[:, j] >= least[j])
                for d in some[np.argsort(-bounds[some, j], kind="stable")].tolist():
                    if bounds[d, j] < least[j]:
                        break
                    if d not in held:
                        held[d] = Counter(terms(batch.column(3)[d].as_py())), damping(batch.column(1)[d].as_py(), n_docs, total), batch.column(0)[d].as_py()
                    tf, m, key = held[d]
                    score = sum(w * impact(tf[t], m) for t, w in weights.items() if t in tf)
                    if score > 0:
                        insort(best[j], (-score, key is None, key or 0))
                        del best[j][k:]
                        least[j] = -best[j][-1][0] if len(best[j]) == k else 1
        out = [(row, -s, None if null else key) for (row, _), top in zip(items, best, strict=True) for s, null, key in top]
        row, score, key = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (row, key, score)], ["row", "key", "score"])

    return search


def search(index: Index, queries: DataFrame, key: str = "item_id", text: str = "text", k: int = 10, block_terms: int = 100_000) -> DataFrame:
    """The queries' key column, rank, doc key and score: the k best documents of every query, equal scores by key.

    A block has so many queries that their terms are `block_terms` at most (one query alone may have more: its own text).
    """
    spark = queries.sparkSession
    with work.scratch(spark, "queries") as tmp:
        numbered = work.numbered(queries.select(F.col(key).alias("item"), F.col(text).alias("text")), "items", work.fresh_dir(spark, "items"))
        weighted = index.weights(spark, query_terms(numbered, "item", "text"))
        lists = tmp.staged(weighted.groupBy("row").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "weights")
        sketches = spark.read.schema("key long, n long, sketch binary, text binary").parquet(index.sketches)
        parts = []

        def run(block: list) -> None:
            found = sketches.mapInArrow(_searched(index, block, k), "row long, key long, score long")
            first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("key"))
            parts.append(work.staged(found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "found"))

        block, size = [], 0
        for row in lists.toLocalIterator():  # a partition at a time
            own = {bytes(t["term"]): t["w"] for t in row["terms"]}
            if block and size + len(own) > block_terms:
                run(block)
                block, size = [], 0
            block.append((row["row"], own))
            size += len(own)
        if block:
            run(block)
    if not parts:
        return numbered.where("false").select(F.col("item").alias(key), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    return found.join(numbered.select("row", "item"), "row").select(F.col("item").alias(key), "rank", F.col("key").alias("doc"), "score")
