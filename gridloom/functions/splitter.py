"""Recursive text splitter: the coarsest separator first, pieces merged up to a size with an overlap."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _merge(pieces: Sequence[str], joiner: str, size: int, overlap: int) -> Iterator[str]:
    """Runs of pieces of at most `size` characters; each starts with the last pieces of the one before, up to `overlap`."""
    run: list[str] = []
    total = 0
    for p in pieces:
        extra = len(p) + (len(joiner) if run else 0)
        if run and total + extra > size:
            yield joiner.join(run).strip()
            while run and (total > overlap or total + len(p) + len(joiner) > size):
                total -= len(run.pop(0)) + (len(joiner) if run else 0)
        total += len(p) + (len(joiner) if run else 0)
        run.append(p)
    if run:
        yield joiner.join(run).strip()


def split_text(text: str, size: int = 800, overlap: int = 100, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of a text; only a stretch without any separator is cut inside words."""
    here = next(i for i, s in enumerate(separators) if not s or s in text)
    joiner, finer = separators[here], separators[here + 1 :]
    out: list[str] = []
    small: list[str] = []
    for p in text.split(joiner) if joiner else list(text):
        if len(p) <= size:
            if p:
                small.append(p)
            continue
        out += _merge(small, joiner, size, overlap)
        small = []
        out += split_text(p, size, overlap, finer) if finer else [p]
    return [c for c in [*out, *_merge(small, joiner, size, overlap)] if c]


def recursive_chunks(df: DataFrame, key: str, text: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """key, chunk_index, chunk of every text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, c) for k, t in zip(pdf[key], pdf[text], strict=True) for i, c in enumerate(split_text(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInPandas(cut, f"{key} {kind}, chunk_index int, chunk string")


@lru_cache(maxsize=4)
def _encoding(ranks_path: str, pattern: str):
    """The encoder of this Python worker, built once."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_counts(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """`df` with the exact token count of a byte-pair vocabulary (a file of base64 tokens and ranks)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks_path, pattern).encode_ordinary
        return texts.map(lambda t: len(encode(t or "")))

    return df.withColumn(into, count(F.col(text)))
