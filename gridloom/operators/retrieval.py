"""Exact vector retrieval in blocks, token budgets and contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import token_estimate


def _blocks(df: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """block, ids, values: the vectors of about `rows` rows side by side, as bytes."""

    width = "<f4" if "float" in df.schema[vector].dataType.simpleString() else "<f8"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), rows):
                own = pdf.iloc[a : a + rows]
                for _, same in own.groupby(own["v"].map(len)):
                    yield pd.DataFrame({"ids": [same["k"].to_numpy(np.int64).tobytes()], "v": [np.stack(same["v"].to_numpy()).astype(width).tobytes()], "dim": [len(same["v"].iloc[0])], "width": [width]})

    return df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInPandas(pack, "ids binary, v binary, dim int, width string")


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """queries x vectors, larger is nearer: cosine (0 for a vector of length zero), inner product, or the negative distance."""
    if metric == "l2":
        return -np.sqrt(np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None, :] - 2 * q @ v.T, 0))
    s = q @ v.T
    if metric == "cosine":
        of = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1))[None, :]
        s = np.where(of > 0, s / np.where(of > 0, of, 1), 0.0)
    return s


def top_k(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", vector: str = "embedding", block: int = 1024, least: float | None = None, digits: int = 12, query_key: str | None = None) -> DataFrame:
    """query, id, score, rank: the k best of all rows for each query; equal scores by id. metric: cosine, inner or l2 (smaller is better).

    Queries and rows are packed into blocks; each pair of blocks is one matrix product that leaves its k best, so what
    is shuffled is k rows a query and block. The corpus' blocks are dealt over as many lanes as the session has shuffle
    partitions, and the queries' blocks, the smaller side, go to every lane. Vectors of another dimension than the
    query's do not match.
    """
    lanes = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks(queries, query_key or key, vector, block).select(F.col("ids").alias("qids"), F.col("v").alias("q"), F.col("dim").alias("qdim"), F.col("width").alias("qwidth"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("qlane"))
    rows = _blocks(corpus, key, vector, block * 4).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    pairs = q.join(rows, (F.col("dim") == F.col("qdim")) & (F.col("lane") == F.col("qlane")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qids, q_, qwidth, ids, v_, width, dim in pdf[["qids", "q", "qwidth", "ids", "v", "width", "dim"]].itertuples(index=False, name=None):
                qids, ids = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64)
                q, v = (np.frombuffer(x, w).reshape(-1, dim).astype(float) for x, w in ((q_, qwidth), (v_, width)))
                s = np.round(scores(q, v, metric), digits)
                order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                rows = np.arange(len(qids))[:, None]
                yield pd.DataFrame({"query": np.repeat(qids, order.shape[1]), "id": ids[order].ravel(), "score": s[rows, order].ravel()})

    best = pairs.mapInPandas(score, "query long, id long, score double")
    if least is not None:
        best = best.where(F.col("score") >= least)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("score", -F.col("score")) if metric == "l2" else best


def within_budget(df: DataFrame, group: list[str], order: list[Column | str], budget: int, text: str = "text", most: int | None = None) -> DataFrame:
    """`df` with tokens and used (their running sum): the first rows of each group whose sum stays within the budget.

    `most`: rows with more tokens are passed over instead of ending the list.
    """
    rows = df.withColumn("tokens", token_estimate(F.col(text)).cast("long"))
    if most is not None:
        rows = rows.where(F.col("tokens") <= most)
    run = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("tokens").over(run)).where(F.col("used") <= budget)


def joined(order: Column | str, text: Column | str, separator: str) -> Column:
    """Aggregate: the texts of a group in order, joined."""
    order, text = (F.col(c) if isinstance(c, str) else c for c in (order, text))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def contexts(hits: DataFrame, texts: DataFrame, budget: int, key: str = "id", most: int | None = None, separator: str = "\n\n---\n\n") -> DataFrame:
    """query, n_chunks, tokens, context: the texts of each query's hits in rank order, within the token budget."""
    rows = within_budget(hits.join(texts, key), ["query"], ["rank"], budget, most=most)
    return rows.groupBy("query").agg(F.count("*").alias("n_chunks"), F.max("used").alias("tokens"), joined("rank", "text", separator).alias("context"))
