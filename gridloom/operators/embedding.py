"""Embeddings: a pluggable function in batches, or hashed TF-IDF vectors without any model service."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import words
from gridloom.operators.grounding import with_retry


def embed_with(df: DataFrame, call: Callable[[list[str]], Sequence[Sequence[float] | None]], text: str = "text", into: str = "embedding", most_chars: int = 8192, tries: int = 5) -> DataFrame:
    """`df` with the vectors that `call` gives for batches of texts, cut to most_chars; rows without a vector are dropped."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(with_retry(call, tries)(texts.fillna("").tolist())), dtype=object)

    return df.withColumn(into, embed(F.substring(text, 1, most_chars))).where(F.col(into).isNotNull())


def fit_tfidf(df: DataFrame, text: str = "text", size: int = 256) -> PipelineModel:
    """Hashed word counts by inverse document frequency, of length 1."""
    steps = [HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_unit")]
    return Pipeline(stages=steps).fit(df.withColumn("_words", words(F.lower(text))))


def embed_tfidf(df: DataFrame, model: PipelineModel, text: str = "text", into: str = "embedding") -> DataFrame:
    out = model.transform(df.withColumn("_words", words(F.lower(text))))
    return out.withColumn(into, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")
