"""Plan, retrieve, execute, check and retry as rounds over a table of tasks.

A plan's lines become tasks. The frontier is a table with a row for each task: its state (open, done or failed), how
often it was tried, its last result and the names in it that no source has. A round retrieves and executes for all tasks
that are still open in one batch, checks all results in one join, and writes the next frontier, so a lost executor
repeats at most a round. Planner and generator are functions over DataFrames; nothing is called task by task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import retrieval
from gridloom.plans.folders import staged

OPEN, DONE, FAILED = "open", "done", "failed"
Step = Callable[[DataFrame], DataFrame]


def planned_tasks(plans: DataFrame, request: str, plan: str = "plan", most: int = 200) -> DataFrame:
    """request, task_no (from 0), task: the lines of each plan without dashes and blanks around them; blank lines are none. At most `most` a request, as the agent's limit says."""
    lines = F.filter(F.transform(F.split(F.coalesce(plan, F.lit("")), "\n"), lambda x: F.btrim(F.btrim(x), F.lit("- "))), lambda x: x != "")
    return plans.select(request, F.posexplode(F.slice(lines, 1, most)).alias("task_no", "task"))


def names_used(text: Column, pattern: str) -> Column:
    """Distinct names (group 1 of the pattern) in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)))


def frontier(tasks: DataFrame, key: str, retrieve: Step, execute: Step, names: Callable[[Column], Column], valid: DataFrame, retries: int = 3) -> DataFrame:
    """`tasks` with state, tries, result and invalid (sorted names that are not in the column `name` of `valid`).

    retrieve: open tasks to open tasks with context. execute: those to (key, result), a row for each task; it sees tries
    (0 at first) and the invalid names of the try before. A task with no invalid name is done; after 1 + retries tries it has failed.
    """
    own = tasks.columns
    none = F.array().cast("array<string>")
    now = staged(tasks.withColumns({"state": F.lit(OPEN), "tries": F.lit(0), "result": F.lit(None).cast("string"), "invalid": none}), "frontier")
    known = valid.select("name").distinct()
    for _ in range(1 + retries):
        todo = now.where(F.col("state") == OPEN)
        if todo.isEmpty():
            break
        said = staged(execute(retrieve(todo.select(*own, "tries", "invalid"))).select(key, F.col("result").alias("_result")), "results")
        bad = said.select(key, F.explode(names(F.col("_result"))).alias("name")).join(known, "name", "left_anti")
        bad = bad.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("_bad"))
        judged = todo.join(said, key, "left").join(bad, key, "left").withColumn("_bad", F.coalesce("_bad", none))
        fine = F.col("_result").isNotNull() & (F.size("_bad") == 0)
        state = F.when(fine, DONE).when(F.col("tries") >= retries, FAILED).otherwise(OPEN)
        judged = judged.select(*own, state.alias("state"), (F.col("tries") + 1).alias("tries"), F.coalesce("_result", "result").alias("result"), F.col("_bad").alias("invalid"))
        now = staged(now.where(F.col("state") != OPEN).unionByName(judged), "frontier")
    return now


def with_context(todo: DataFrame, chunks: DataFrame, key: str, k: int = 10, budget: int = 30_000, vector: str = "embedding", digits: int = 12) -> DataFrame:
    """`todo` (with a vector) and the context of its k nearest chunks (id, text, vector) within the token budget; an empty one without any."""
    hits = retrieval.top_k(chunks.select("id", vector), todo, k, key="id", vector=vector, query_key=key, digits=digits)
    texts = retrieval.contexts(hits, chunks.select("id", "text"), budget).select(F.col("query").alias(key), "context")
    return todo.join(texts, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


def summary(done: DataFrame, request: str, separator: str = "\n\n") -> DataFrame:
    """request, n_tasks, n_failed, output: the results of each request in the order of its tasks."""
    return done.groupBy(request).agg(F.count("*").alias("n_tasks"), F.count(F.when(F.col("state") == FAILED, 1)).alias("n_failed"), retrieval.joined("task_no", "result", separator).alias("output"))
