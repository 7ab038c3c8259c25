"""Exact deduplication by a stateful stream.

Rows are added to a content store (Parquet in a shared folder). A streaming aggregation over the store, fed in
TRIGGERS triggers, keeps for each digest and without expiry the row that stays (stable identifier), where its content
lies (file and row: the locator) and the number of rows; its state lives on disk in RocksDB, is looked up by every
later trigger, and rows are combined before the shuffle, so one group may hold any share of them. Every hit is then
checked: the texts of all rows that share a digest are fetched by their locators and compared in full; a digest that
covers different texts is split by text.

With a fixed `path`, later calls add rows (of the same columns, in the same order) to the same store and state.

Defined results: a null text counts as empty and all empty texts are equal; of equal texts the row with the most
code points stays, then the smallest key (null keys last), then the first in the store; every row gives one row,
repeated rows included; an empty table gives no rows. Columns of the input stay; a column of the same name as a
new one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import files
from gridloom.llm.work import Scratch, Shelter, fresh_dir, join_groups, scratch, staged, writing

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
TRIGGERS = 4
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """The text without the characters x20 and x09 to x0D."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t-\r]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _best(key: str) -> Column:
    """Orders the rows of a group: the smallest stays."""
    return F.struct((-F.col("points")).alias("points"), F.col(key).isNull().alias("nokey"), F.col(key).alias("key"), F.col("file").alias("file"), F.col("at").alias("at"))


def _keyed_state(store: DataFrame, path: str, key: str) -> DataFrame:
    """digest, best, n: the stream's state after all rows of the store."""
    spark = store.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    place = {"file": F.col("_metadata.file_path"), "at": F.col("_metadata.row_index")}
    many = store.select(F.col("_metadata.file_path").alias("file")).distinct().count()
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(store.schema).option("maxFilesPerTrigger", max(1, math.ceil(many / TRIGGERS))).parquet(f"{path}/store")
        state = rows.select("digest", "points", key, *[c.alias(n) for n, c in place.items()]).groupBy("digest").agg(F.min(_best(key)).alias("best"), F.count("*").alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/updates/{number}")

        stream = state.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(keep).start()
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = spark.read.schema(state.schema.add("batch", "integer")).parquet(f"{path}/updates/*")
    return updates.groupBy("digest").agg(F.max_by(F.struct("best", "n"), "batch").alias("s")).select("digest", "s.best", "s.n")


def _fetch(rows: DataFrame, text: str, tasks: int) -> DataFrame:
    """digest, norm: the full normalised texts of rows, read by their locators."""

    def read(batches):
        import pyarrow.parquet as pq

        for pdf in batches:
            for file, own in pdf.groupby("file"):
                want = own.sort_values("at", ignore_index=True)
                at = 0
                with files.reading(file) as f:
                    for batch in pq.ParquetFile(f).iter_batches(batch_size=512, columns=[text]):
                        hits = want[(want["at"] >= at) & (want["at"] < at + len(batch))]
                        if len(hits):
                            texts = batch.column(0).take(hits["at"].to_numpy() - at).to_pylist()
                            yield hits.assign(text=texts)[["digest", "text"]]
                        at += len(batch)

    got = rows.select("digest", "file", "at").repartition(tasks, "file").sortWithinPartitions("file", "at").mapInPandas(read, "digest string, text string")
    return got.select("digest", normalised(F.col("text")).alias("norm"))


def _groups(located: DataFrame, state: DataFrame, key: str, text: str, tmp: Scratch) -> DataFrame:
    """file, at, best, n of each row, after all hits are checked in full."""
    total = located.count()
    state = tmp.staged(state, "state")
    narrow = located.select("digest", "file", "at")
    hits = join_groups(narrow, state.where("n > 1").select("digest", "n"), "digest", "n", total)
    norms = _fetch(hits, text, located.rdd.getNumPartitions()).groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    split = tmp.staged(norms.where("a <> b").select("digest"), "split")
    if split.isEmpty():
        return join_groups(narrow, state, "digest", "n", total).select("file", "at", "best", "n")
    own = tmp.staged(located.join(split, "digest", "left_semi").select("digest", normalised(F.col(text)).alias("norm"), "file", "at", "points", key), "texts")  # these by the whole text
    parts = own.groupBy("digest", "norm").agg(F.min(_best(key)).alias("best"), F.count("*").alias("n"))
    rest = join_groups(narrow.join(split, "digest", "left_anti"), state, "digest", "n", total)
    return rest.select("file", "at", "best", "n").unionByName(own.join(parts, ["digest", "norm"]).select("file", "at", "best", "n"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, digest=sha256, columns: Sequence[str] | None = None) -> DataFrame:
    """All rows of the store (of these columns, or all) with keep_id, group_size, kept and text_sha256 (of the digest function's text)."""
    spark, inside = docs.sparkSession, Shelter(docs)
    path = path or fresh_dir(spark, "exact")
    k, t, wanted = inside.name(key), inside.name(text), inside.wanted(columns)
    new = inside.df.select(*dict.fromkeys([*wanted, k, t])).withColumns({"digest": digest(F.col(t)), "points": F.length(F.coalesce(F.col(t), F.lit("")))})
    with writing(spark):
        new.write.mode("append").option("compression", "zstd").parquet(f"{path}/store")
    store = spark.read.schema(new.schema).parquet(f"{path}/store")
    located = store.withColumns({"file": F.col("_metadata.file_path"), "at": F.col("_metadata.row_index")})
    with scratch(spark, "exact") as tmp, writing(spark):
        groups = staged(_groups(located, _keyed_state(store, path, k), k, t, tmp), "exact-groups")
    out = located.join(groups, ["file", "at"])
    kept = (F.col("best.file") == F.col("file")) & (F.col("best.at") == F.col("at"))
    added = [F.col("best.key").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256")]
    return inside.restored(out.select(*wanted, *added), ADDED, ADDED)
