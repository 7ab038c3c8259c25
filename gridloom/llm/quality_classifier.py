"""Quality classifier by regularised quadratic discriminant analysis over document statistics.

Each class has the mean and the shrunk covariance of the transformed statistics of its labelled documents (counts,
sums and products gathered by Spark, a fixed number of cells). A document's score is the posterior of class 1: the
difference of the log densities, from Mahalanobis distances by Cholesky factors that are computed once, and of the
log priors.

Defined results: a null text counts as empty and is scored like any text; labels that are null or other than 0 and 1
teach nothing; with fewer than two labelled documents in a class every score is the share of class 1 (1 without any
label); every row gives one row. Columns of the input stay; a column of the same name as a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import Shelter, staged


FEATURES = ("chars", "upper", "digits", "points", "marks", "bars", "symbols", "lines", "odd", "word_length", "new_words", "new_lines", "new_triples", "long_words")
_GROUPS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": "0123456789", "points": ".,;:", "marks": "!?", "bars": "|", "symbols": "#*$%&<>@=_/\\{}[]^~+", "lines": "\n"}
_CLASS = np.zeros(129, np.int64)
for _k, _cs in enumerate(_GROUPS.values()):
    for _c in _cs:
        _CLASS[ord(_c)] = _k + 1
_CLASS[128] = len(_GROUPS) + 1


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text: logarithms of lengths and of shares."""
    text = text or ""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), 128)
    n = np.bincount(_CLASS[points], minlength=len(_GROUPS) + 2)[1:].astype(float)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    triples = max(1, len(words) - 2)
    share = lambda x, of: np.log(x / max(1, of) + 0.005)
    return np.array([
        np.log1p(len(text)), *(share(x, len(text)) for x in n), np.log1p(letters / max(1, len(words))),
        share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(len(set(zip(words, words[1:], words[2:]))), triples),
        share(sum(len(w) > 20 for w in words), len(words)),
    ])


class Discriminant:
    """Two Gaussian classes with covariances shrunk towards their diagonal and towards the pooled scale."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = 0.1, ridge: float = 0.02):
        self.share = float(n[1] / n.sum()) if n.sum() else 1.0
        self.ready = bool((n >= 2).all())
        if not self.ready:
            return
        mean = sums / n[:, None]
        total = n.sum()
        center = sums.sum(0) / total
        scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - center**2, 0)) + 1e-6
        self.center, self.scale, self.means, self.factors, self.logs = center, scale, [], [], []
        for c in range(2):
            cov = (products[c] / n[c] - np.outer(mean[c], mean[c])) / np.outer(scale, scale)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + ridge * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.means.append((mean[c] - center) / scale)
            self.factors.append(np.linalg.inv(factor))
            self.logs.append(np.log(n[c] / total) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for rows of statistics."""
        if not self.ready:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        logs = [self.logs[c] - 0.5 * (((z - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in range(2)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def train(rows: DataFrame, statistic: str = "x", label: str = "label") -> Discriminant:
    """The model of rows with an array of statistics and a label."""
    k = len(FEATURES)

    def gather(batches):
        total = np.zeros((2, 1 + k + k * k))
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
            for c in range(2):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"cell": np.arange(total.size), "v": total.ravel()})

    labelled = rows.where(F.col(label).isin(0, 1)).select(F.col(statistic).alias("x"), F.col(label).cast("int").alias("y"))
    cells = labelled.mapInPandas(gather, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * (1 + k + k * k))
    for cell, v in cells:
        total[cell] = v
    total = total.reshape(2, -1)
    return Discriminant(total[:, 0], total[:, 1 : 1 + k], total[:, 1 + k :].reshape(2, k, k))


def with_statistics(docs: DataFrame, text: str = "text", into: str = "x") -> DataFrame:
    """`docs` with the array of statistics."""

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(into, measured(F.col(text)))


def scored(rows: DataFrame, model: Discriminant, statistic: str = "x") -> DataFrame:
    """`rows`, which have the statistics, with score."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(FEATURES)))))

    return rows.withColumn("score", score(F.col(statistic)))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", columns: Sequence[str] | None = None) -> DataFrame:
    """`docs` (of these columns, or all) with score; `labels` (key and label) are what the model may learn from. Texts are measured once."""
    inside = Shelter(docs)
    k, wanted = inside.name(key), inside.wanted(columns)
    measured = with_statistics(inside.df, inside.name(text)).select(*dict.fromkeys([*wanted, k]), "x")
    rows = staged(measured, "statistics")
    taught = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("y").isin(0, 1))
    model = train(rows.select(F.col(k).alias("k"), "x").join(taught, "k"), "x", "y")
    return inside.restored(scored(rows, model).select(*wanted, "score"), ["score"], ["score"])
