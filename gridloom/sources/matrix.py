"""Matrix files (.npy, one file or a folder of parts) as a Spark data source: rows by byte ranges, one part file for each task.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").load(path)                     # row long, embedding array<float> or array<double>
    df.write.format("matrix").mode("overwrite").save(path)      # one array column; order by repartitionByRange and sortWithinPartitions

Only headers are read to plan a scan; each partition then reads the bytes of its own rows. Rows count from 0 over the
parts by name. Files are opened through Arrow's file systems.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

ROWS_AT_ONCE = 4096
HEADER = 4096  # of a file, at most; a header of two dimensions has 128 bytes


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def _header(store: fs.FileSystem, path: str) -> tuple[int, int, np.dtype, int]:
    """Rows, columns, type and the place of the first number."""
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(HEADER))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(head)
    if len(shape) != 2 or by_column or kind.kind != "f":
        raise ValueError(f"{path}: a matrix of floats, row by row, is expected")
    return shape[0], shape[1], kind, head.tell()


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    store, at = _at(path)
    if store.get_file_info(at).type == fs.FileType.Directory:
        return store, sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.is_file and i.path.endswith(".npy"))
    return store, [at]


@dataclass
class Rows(InputPartition):
    """Some rows of a file."""

    path: str
    first: int
    start: int
    rows: int
    columns: int
    kind: str


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rows_in_partition", 100_000))

    def partitions(self) -> list[Rows]:
        store, paths = _files(self.path)
        out, first = [], 0
        for path in paths:
            n, columns, kind, start = _header(store, path)
            for a in range(0, n, self.most):
                out.append(Rows(path, first + a, start + a * columns * kind.itemsize, min(self.most, n - a), columns, kind.str))
            first += n
        return out or [Rows("", 0, 0, 0, 0, "<f4")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = _at(self.path)
        width = np.dtype(partition.kind).itemsize * partition.columns
        with store.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for a in range(0, partition.rows, ROWS_AT_ONCE):
                n = min(ROWS_AT_ONCE, partition.rows - a)
                values = np.frombuffer(f.read(n * width), partition.kind)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * partition.columns)
                flat = pa.array(values.astype(np.float64 if values.dtype.itemsize == 8 else np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.first + a), pa.ListArray.from_arrays(ends, flat)], ["row", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    path: str


class MatrixWriter(DataSourceArrowWriter):
    """Each task writes one part under a name of this run; commit removes the parts of older runs if asked to."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:8]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = _at(self.path)
        held = [b.column(0) for b in iterator if len(b)]
        if not held:
            return Written("")
        columns = len(held[0][0])
        if any(set(np.unique(c.value_lengths().to_numpy(zero_copy_only=False))) != {columns} for c in held):
            raise ValueError("all vectors of a matrix have the same length, and none is null")
        values = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in held]).reshape(-1, columns)
        out = io.BytesIO()
        np.save(out, values)
        store.create_dir(at, recursive=True)
        place = f"{at}/part-{TaskContext.get().partitionId():06d}-{self.run}.npy"
        draft = f"{place}.{uuid.uuid4().hex[:8]}.draft"
        with store.open_output_stream(draft) as f:
            f.write(out.getbuffer())
        store.move(draft, place)
        return Written(place)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _at(self.path)
        own = {m.path for m in messages if m}
        if self.overwrite and store.get_file_info(at).type == fs.FileType.Directory:
            for info in store.get_file_info(fs.FileSelector(at)):
                if info.is_file and info.path not in own:
                    store.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _at(self.path)
        for m in messages:
            if m and m.path:
                store.delete_file(m.path)


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        store, paths = _files(self.options["path"])
        wide = bool(paths) and _header(store, paths[0])[2].itemsize == 8
        return f"row long, embedding array<{'double' if wide else 'float'}>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(dict(self.options), overwrite)


def read_matrix(spark: SparkSession, path: str, rows_in_partition: int = 100_000) -> DataFrame:
    """row, embedding of a matrix file or a folder of parts."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("rows_in_partition", rows_in_partition).load(path)


def write_matrix(df: DataFrame, vector: str, order: str, path: str, parts: int) -> None:
    """The vectors in order as `parts` files; an older version is replaced."""
    df.sparkSession.dataSource.register(MatrixSource)
    rows = df.repartitionByRange(parts, order).sortWithinPartitions(order).select(vector)
    rows.write.format("matrix").mode("overwrite").save(path)


def read_indexed_chunks(spark: SparkSession, matrix: str, chunks: str) -> DataFrame:
    """row, embedding, text of a matrix and the JSON array of chunks whose i-th member belongs to its i-th row; an error where their lengths differ.

    A JSON array cannot be cut, so one task reads the file of texts; the matrix is read by row ranges.
    """
    member = "array<struct<text:string,content:string>>"
    texts = spark.read.text(chunks, wholetext=True).select(F.posexplode(F.from_json("value", member)).alias("row", "c"))
    texts = texts.select(F.col("row").cast("long").alias("row"), F.coalesce("c.text", "c.content").alias("text"))
    vectors = read_matrix(spark, matrix)
    n, m = texts.count(), vectors.select("row").agg(F.coalesce(F.max("row") + 1, F.lit(0))).first()[0]
    if n != m:
        raise ValueError(f"{m} vectors and {n} chunks")
    return vectors.join(texts, "row")
