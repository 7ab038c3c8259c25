"""Grounding: names that an answer uses and no source has."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.text import sorted_names


def distinct_names(df: DataFrame, names: Column) -> DataFrame:
    """name: every name once."""
    return df.select(F.explode(names).alias("name")).distinct()


def unknown_names(answers: DataFrame, key: str, names: Column, valid: DataFrame) -> DataFrame:
    """key, name: the names of each answer that are not in `valid` (a column name)."""
    used = answers.select(key, F.explode(names).alias("name")).distinct()
    return used.join(valid.select("name"), "name", "left_anti")


def grounding_report(answers: DataFrame, key: str, names: Column, valid: DataFrame) -> DataFrame:
    """key, n_used, n_unknown, unknown (sorted, joined), grounded of each answer that uses a name."""
    used = answers.select(key, F.explode(names).alias("name")).distinct()
    known = valid.select("name").withColumn("known", F.lit(True))
    flagged = used.join(known, "name", "left").withColumn("bad", F.when(F.col("known").isNull(), F.col("name")))
    bad = F.collect_list("bad")
    return flagged.groupBy(key).agg(F.count("*").alias("n_used"), F.count("bad").alias("n_unknown"), sorted_names(bad).alias("unknown")).withColumn("grounded", F.col("n_unknown") == 0)


def with_retry(call: Callable, tries: int = 5, base: float = 2.0, retry_on: tuple[type[BaseException], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call` that is repeated after base**n seconds when it raises one of `retry_on`; the last error is raised."""

    def wrapped(*args, **kwargs):
        for n in range(tries):
            try:
                return call(*args, **kwargs)
            except retry_on:
                if n + 1 == tries:
                    raise
                sleep(base**n)

    return wrapped


def answer_until_grounded(question: str, generate: Callable[[str, list[str]], str], unknown_of: Callable[[str], list[str]], repairs: int = 1) -> tuple[str, list[str]]:
    """An answer and its unknown names; while there are any, the generator is asked again with them, a bounded number of times."""
    answer, bad = generate(question, []), []
    for _ in range(repairs):
        bad = unknown_of(answer)
        if not bad:
            return answer, []
        answer = generate(question, bad)
    return answer, unknown_of(answer)
