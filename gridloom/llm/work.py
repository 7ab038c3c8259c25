"""Where operators keep intermediate tables, and how they keep clear of their inputs' column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import files

_LOCAL: dict[str, str] = {}
_KEPT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode without that setting, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-gridloom-")
        _KEPT.append(_LOCAL[app])
    return _LOCAL[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is written yet. `release` removes it."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex[:12]}"
    _KEPT.append(path)
    return path


def release() -> None:
    """Removes the folders that operators of this process made; their results can no longer be read. Runs at exit, too."""
    while _KEPT:
        with suppress(OSError):  # gone already, or kept by the store
            files.remove(_KEPT.pop())


atexit.register(release)


@contextmanager
def writing(spark: SparkSession, rows: int = 2048) -> Iterator[None]:
    """Settings while a table is written: Arrow batches of few rows, so that long texts do not add up in a Python worker,
    and shuffle files that go when the table is there, so that disks do not fill up over the steps of an operator."""
    batch, cleanup = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = {k: spark.conf.get(k) for k in (batch, cleanup)}
    most = int(before[batch])
    spark.conf.set(batch, str(min(rows, most) if most > 0 else rows))
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: it cuts lineage and survives lost executors."""
    path = path or fresh_dir(df.sparkSession, name)
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """A folder for the tables that only one call needs."""

    def __init__(self, path: str):
        self.path, self.number = path, 0

    def place(self, name: str) -> str:
        self.number += 1
        return f"{self.path}/{self.number}-{name}"

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, name, self.place(name))


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """A Scratch whose tables are removed at the end: what is returned must not read them."""
    path = fresh_dir(spark, name)
    try:
        yield Scratch(path)
    finally:
        with suppress(OSError):
            files.remove(path)
            _KEPT.remove(path)


class Leftovers:
    """What the stages of a pipeline leave in the shared folder. A stage's folders go when a later stage starts, its own
    frame is gone (so nobody is going to read it), and the later stage's input does not read them."""

    def __init__(self) -> None:
        self.held: list[tuple[weakref.ref, list[str]]] = []

    def sweep(self, docs: DataFrame) -> None:
        """Removes the folders that nothing reads any more."""
        reads: list[str] | None = None
        for item in list(self.held):
            frame, folders = item
            if frame() is None:
                reads = docs.inputFiles() if reads is None else reads
                if not any(folder.rsplit("/", 1)[1] in file for folder in folders for file in reads):
                    self.held.remove(item)
                    for folder in folders:
                        with suppress(OSError):
                            files.remove(folder)

    def stage(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        """`f` (spark, docs, ...) with its folders held until they can go."""

        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, *more) -> DataFrame:
            self.sweep(docs)
            before = {*_KEPT}
            out = f(spark, docs, *more)
            if made := [k for k in _KEPT if k not in before and k not in _LOCAL.values()]:
                self.held.append((weakref.ref(out), made))
            return out

        return run


class Shelter:
    """The input under generated names (in0, in1, ...), so that no name of an operator can clash with its columns."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*[f"in{i}" for i in range(len(self.names))])

    def name(self, column: str) -> str:
        """The generated name of a column."""
        low = [n.lower() for n in self.names]
        if column.lower() not in low:
            raise ValueError(f"no column {column}; there are {', '.join(self.names)}")
        return f"in{low.index(column.lower())}"

    def wanted(self, columns: Sequence[str] | None) -> list[str]:
        """The generated names of these columns; of all without any."""
        low = {c.lower() for c in self.names if columns is None} | {c.lower() for c in columns or ()}
        return [f"in{i}" for i, n in enumerate(self.names) if n.lower() in low]

    def restored(self, df: DataFrame, added: Sequence[str | Column], names: Sequence[str]) -> DataFrame:
        """The input's columns that `df` has, under their own names but for those in `names`; then `added`, which have these names."""
        low, have = {n.lower() for n in names}, set(df.columns)
        own = [F.col(f"in{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in low and f"in{i}" in have]
        return df.select(*own, *added)


def numbered(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """`df` written once, with the column `row`: a number for each row that later reads repeat."""
    return staged(df.withColumn("row", F.monotonically_increasing_id()), name, path)


HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """`rows`, of which there are `total`, joined with `groups` (one row for each value of `on`; `size`: its number of rows). Both are staged tables.

    The rows of groups with more than a thousandth of all rows, at most HOT groups, stay where they are and get their
    group by a broadcast, so that no task gets a whole hot group; the others are joined by a shuffle.
    """
    names = [*rows.columns, *[c for c in groups.columns if c != on]]
    large = F.col(size) > max(1, total // HOT)
    hot = [r[0] for r in groups.where(large).select(on).collect()]  # total / (total / HOT) at most
    if not hot:
        return rows.join(groups, on, how).select(*names)
    spread = rows.where(F.col(on).isin(hot)).join(F.broadcast(groups.where(large)), on)
    return spread.select(*names).unionByName(rows.where(~F.col(on).isin(hot)).join(groups.where(~large), on, how).select(*names))
