"""Learned vectors without a service: a randomised truncated singular value decomposition of TF-IDF rows.

Words are hashed to columns. A few passes over blocks of rows multiply the table and its transpose with a thin matrix,
which turns towards the leading right singular vectors; a last pass sums the small Gram matrix that rotates it onto
them. Every pass is one aggregation whose size is columns times vectors, whatever the number of rows, added up by slices
of columns side by side. The driver holds that thin matrix alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import words
from gridloom.operators.passes import kept_blocks, parts_for, summed

ROWS = 2_000


def _places(text: Column, columns: int) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(columns)).cast("int"))


@dataclass(frozen=True)
class Rows:
    """Sparse rows: where each one starts, and the columns and counts of its words."""

    starts: np.ndarray
    column: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, sizes: np.ndarray, columns: int) -> Rows:
        """Of the columns of all words, row after row, and the words of each row: sorted and counted in one go."""
        keys, count = np.unique(np.repeat(np.arange(len(sizes), dtype=np.int64) * columns, sizes) + flat, return_counts=True)
        row, column = np.divmod(keys, columns)
        return Rows(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int64), column.astype(np.int32), count.astype(np.int32))

    @staticmethod
    def read(block: dict) -> Rows:
        return Rows(np.frombuffer(block["starts"], np.int64), np.frombuffer(block["column"], np.int32), np.frombuffer(block["count"], np.int32))

    def values(self, idf: np.ndarray) -> np.ndarray:
        """Counts by inverse frequency, each row of length one."""
        v = self.count * idf[self.column]
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        size = np.sqrt(np.bincount(row, v * v, len(self.starts) - 1))
        return v / np.where(size > 0, size, 1)[row]

    def spans(self) -> Iterator[tuple[int, int, int]]:
        """Row, start and end of the rows that have entries."""
        at = self.starts.tolist()
        return ((i, s, e) for i, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s)

    def times(self, values: np.ndarray, thin: np.ndarray) -> np.ndarray:
        """rows x vectors: this block times columns x vectors, a product for each row."""
        out = np.zeros((len(self.starts) - 1, thin.shape[1]))
        for i, s, e in self.spans():
            out[i] = values[s:e] @ np.take(thin, self.column[s:e], axis=0)
        return out

    def back(self, values: np.ndarray, rows: np.ndarray, into: np.ndarray) -> None:
        """Adds the transpose of this block times rows x vectors; a row has a column once."""
        for i, s, e in self.spans():
            into[self.column[s:e]] += values[s:e, None] * rows[i]


@dataclass(frozen=True)
class Model:
    """Inverse frequencies and the right singular vectors, columns x size; singular values."""

    idf: np.ndarray
    vectors: np.ndarray
    singular: np.ndarray

    def embedded(self, df: DataFrame, text: str = "text", into: str = "embedding") -> DataFrame:
        """`df` with the vector of each text, of length one; zeros for a text without known words."""
        idf, vectors = self.idf, self.vectors

        @F.pandas_udf("array<float>")
        def embed(places: pd.Series) -> pd.Series:
            sizes = places.map(len).to_numpy(np.int64)
            rows = Rows.of(np.concatenate([np.zeros(0, np.int32), *places]), sizes, len(idf))
            v = rows.times(rows.values(idf), vectors)
            size = np.sqrt((v**2).sum(1, keepdims=True))
            return pd.Series(list((v / np.where(size > 0, size, 1)).astype(np.float32)))

        return df.withColumn(into, embed(_places(F.coalesce(text, F.lit("")), len(idf))))


def fit(df: DataFrame, text: str = "text", size: int = 64, columns: int = 8192, rounds: int = 2, more: int = 10, seed: int = 42) -> Model:
    """The leading `size` directions of all rows of `df`; `more` vectors and `rounds` of multiplication make them exact enough."""
    spark = df.sparkSession
    given = df.select(_places(F.coalesce(text, F.lit("")), columns).alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                own = batch.column(0).slice(a, ROWS)
                rows = Rows.of(own.flatten().to_numpy(zero_copy_only=False), own.value_lengths().to_numpy(zero_copy_only=False), columns)
                yield pa.RecordBatch.from_pydict({n: [getattr(rows, n).tobytes()] for n in ("starts", "column", "count")})

    n = df.count()
    parts = parts_for(spark, n, ROWS)
    blocks = kept_blocks(given.repartition(parts).mapInArrow(pack, "starts binary, column binary, count binary"), "tfidf")

    def seen(block, sums):
        sums[0] += np.bincount(Rows.read(block).column, minlength=columns)

    df_ = summed(blocks, parts, 1, columns, seen)[0]
    idf = np.log((n + 1) / (df_ + 1))
    wide = min(size + more, columns)
    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, wide)))[0]
    slices = 16
    for _ in range(rounds):

        def turned(block, sums, thin=thin):
            rows = Rows.read(block)
            v = rows.values(idf)
            into = sums.reshape(columns, wide)
            rows.back(v, rows.times(v, thin), into)

        thin = np.linalg.qr(np.concatenate(summed(blocks, parts, slices, columns * wide // slices, turned)).reshape(columns, wide))[0]

    def gram(block, sums):
        rows = Rows.read(block)
        y = rows.times(rows.values(idf), thin)
        sums[0] += (y.T @ y).ravel()

    values, turn = np.linalg.eigh(summed(blocks, parts, 1, wide * wide, gram)[0].reshape(wide, wide))
    order = np.argsort(-values)[:size]
    blocks.unpersist()
    return Model(idf, thin @ turn[:, order], np.sqrt(np.maximum(values[order], 0)))
