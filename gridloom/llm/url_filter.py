"""URL filter by a ratio of character language models.

Rejected examples are the addresses that a block rule decides or whose host has a rejected term; all others that no
rule blocks are accepted examples (those without any rule stand for the usual web). Each class trains a
variable-order Markov model: symbol counts in contexts of up to three symbols, each order interpolated with the next
shorter one by Witten-Bell weights. An address is judged by its mean log2 ratio a symbol; the limit is calibrated on
a fifth of the examples, which trains nothing: the highest that rejects no more than `false_rejects` of the accepted
ones. Both models are tables of a fixed size (symbols to the power of four).

Defined results: a null address, or one without ://, has an empty host and path, no rule, and is judged as an empty
string; rules decide where they fit, the longest first; without examples of both classes everything else is allowed;
every row gives one row. Columns of the input stay; a column of the same name as a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import Shelter, staged

ADDED = ("host", "path", "rule", "verdict", "ratio")
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.:-_?=&#%~"  # all digits count as 0
OTHER, END = len(SYMBOLS), len(SYMBOLS) + 1
SIZE, ORDER, BINS = len(SYMBOLS) + 2, 3, 2000
_CODES = np.full(128, OTHER, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODES[ord(_c)] = _i
_CODES[48:58] = SYMBOLS.index("0")
# Terms that mark an address as rejected for training.
REJECTED_TERMS = ("ads", "adult", "bet", "bets", "casino", "escort", "lotto", "pills", "porn", "spam", "viagra", "xxx")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("ascii", "replace").lower(), np.uint8)
    return np.concatenate([np.full(ORDER, END), _CODES[raw & 127], [END]])


def _cells(text: str, order: int) -> np.ndarray:
    """For each symbol its cell in the table of an order: the context's symbols and its own, base SIZE."""
    c = _codes(text)
    out = np.zeros(len(c) - ORDER, np.int64)
    for k in range(order, -1, -1):
        out = out * SIZE + c[ORDER - k : len(c) - k]
    return out


def _model(counts: pd.DataFrame, side: str) -> np.ndarray:
    """Probability of each symbol (columns) after each context of the highest order (rows)."""
    p = np.full((1, SIZE), 1 / SIZE)
    for k in range(ORDER + 1):
        own = counts[counts["k"] == k]
        c = np.zeros(SIZE ** (k + 1))
        c[own["cell"].to_numpy()] = own[side].to_numpy()
        c = c.reshape(-1, SIZE)
        n, t = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        below = np.tile(p, (SIZE, 1)) if k else p
        p = np.where(n > 0, (c + t * below) / np.maximum(n + t, 1), below)
    return p


def _tables(counts: pd.DataFrame) -> np.ndarray:
    """log2 ratio of each cell of the highest order."""
    good, bad = (np.log2(_model(counts, side)).astype(np.float32).ravel() for side in ("good", "bad"))
    return good - bad


def _ratios(rows: DataFrame, table, names: Sequence[str]) -> DataFrame:
    def judge(batches):
        own = table.value
        for pdf in batches:
            yield pdf.assign(ratio=[float(own[_cells(h + p, ORDER)].mean()) for h, p in zip(pdf["host"], pdf["path"], strict=True)])

    return rows.select(*names).mapInPandas(judge, rows.select(*names).schema.add("ratio", "double"))


def _ruled(rules: Sequence[tuple[str, str, str]]):
    """A function of host and path: the longest rule that fits, and its verdict. A host looks its suffixes up, so any number of rules will do."""
    by: dict[str, list] = {}
    for verdict, host, path in rules:
        by.setdefault(host, []).append((len(host + path), host + path, path, verdict))
    table = {h: sorted(own, reverse=True) for h, own in by.items()}

    def find(host: str, path: str) -> tuple:
        best, rest = (-1, None, None, None), host
        while True:
            for own in table.get(rest, ()):
                if path.startswith(own[2]):
                    best = max(best, own, key=lambda x: (x[0], x[1] or ""))
                    break
            _, dot, rest = rest.partition(".")
            if not dot:
                return best[1], best[3]

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find(h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"])

    return judge


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", terms: Sequence[str] = REJECTED_TERMS, false_rejects: float = 0.01) -> DataFrame:
    """`pages` with host, path, rule, verdict and ratio. rules: (allow or block, host, path)."""
    spark, own = pages.sparkSession, Shelter(pages)
    host, path = host_and_path(F.col(own.name(url)))
    rows = own.df.withColumns({"host": host, "path": path}).withColumn("ruled", _ruled(rules)("host", "path"))
    names = own.df.columns
    rows = rows.select(*names, "host", "path", "ruled.rule", F.col("ruled.verdict").alias("given"))
    bad = F.col("host").rlike(rf"(^|[.\-])({'|'.join(terms)})([.\-]|$)") if terms else F.lit(False)
    side = F.when(F.coalesce(F.col("given") == "block", F.lit(False)) | (F.col("given").isNull() & bad), "bad").otherwise("good")
    labelled = rows.select("host", "path", side.alias("side"), (F.pmod(F.xxhash64(own.name(key), "host", "path"), F.lit(5)) == 0).alias("held"))

    def count(batches):
        total: dict[tuple[int, str], list] = {}
        for pdf in batches:
            for side_, own_ in pdf.groupby("side"):
                for k in range(ORDER + 1):
                    cells = np.concatenate([_cells(h + p, k) for h, p in zip(own_["host"], own_["path"], strict=True)])
                    total.setdefault((k, side_), []).append(np.unique(cells, return_counts=True))
        for (k, side_), parts in total.items():
            cells, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            yield pd.DataFrame({"k": k, "cell": cells, "good": n * (side_ == "good"), "bad": n * (side_ == "bad")})

    counts = labelled.where("not held").mapInPandas(count, "k int, cell long, good long, bad long")
    counts = staged(counts.groupBy("k", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "urls").toPandas()
    if not (len(counts) and counts["good"].sum() and counts["bad"].sum()):
        return own.restored(rows.select("*", F.coalesce("given", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio")), ADDED, ADDED)
    table = spark.sparkContext.broadcast(_tables(counts))
    held = _ratios(labelled.where("held"), table, ["host", "path", "side"])
    spot = F.least(F.greatest(F.floor((F.col("ratio") + 10) * BINS / 20), F.lit(0)), F.lit(BINS - 1))
    bins = held.groupBy(spot.cast("int").alias("bin"), "side").count().toPandas()
    good = bins[bins["side"] == "good"].set_index("bin")["count"].reindex(range(BINS), fill_value=0).to_numpy()
    below = np.concatenate([[0], np.cumsum(good)])  # accepted examples below each bin's lower edge
    limit = min(0.0, float(np.flatnonzero(below <= false_rejects * good.sum())[-1]) * 20 / BINS - 10)
    out = _ratios(rows, table, [*names, "host", "path", "rule", "given"])
    verdict = F.coalesce("given", F.when(F.col("ratio") >= limit, "allow").otherwise("block"))
    return own.restored(out.withColumn("verdict", verdict), ADDED, ADDED)
