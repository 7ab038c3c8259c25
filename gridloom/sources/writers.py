"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str, name: str = "metric", value: str = "value") -> None:
    """A JSON object of numbers, from rows of names and values; as many rows as there are measures."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.col(value)))))
    df.agg(F.to_json(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Chunks and their vectors in the same rows; an older version is replaced."""
    df.write.mode("overwrite").parquet(path)


def write_joined_text(df: DataFrame, group: str, order: Column, text: str, path: str, separator: str = "\n\n") -> None:
    """One text for each group: its rows in order, joined."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator)
    df.groupBy(group).agg(joined.alias("value")).select("value").write.mode("overwrite").text(path)
