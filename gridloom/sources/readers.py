"""Sources with explicit schemas. Missing numbers are NULL, never NaN."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = "text string, source string, chunk_index int"
STRUCTURED_CHUNKS = "id string, text string"
NESTED_CHUNKS = "content string, metadata struct<source: string, chunk_id: int>"
BUSES = "bus string, voltage double, load_MW double, breaker_status int, alarm_flag int"
BRANCHES = "from_bus string, to_bus string"
BUS_SCENARIOS = "bus long, voltage double, load_MW double, alarm_flag int, scenario int"
EDGE_SCENARIOS = "from_bus long, to_bus long, scenario int"
OHLCV = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"
FAULTS = "G int, C int, B int, A int, Ia double, Ib double, Ic double, Va double, Vb double, Vc double"
RATINGS = "conductor string, environmental_index int, ampacity int, mva_69 string, mva_138 string, mva_345 string"
IMPEDANCES = "kV int, conductors_per_phase int, conductor string, R double, X double, B double"


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` itself; an error that names every missing column."""
    have = {c.lower() for c in df.columns}
    missing = [n for n in names if n.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = ()) -> DataFrame:
    """A CSV file or folder with a header, NaN as NULL."""
    return require_columns(nan_to_null(spark.read.schema(schema).option("header", True).csv(path)), required)


def read_time_series(spark: SparkSession, path: str, layout: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A two-column CSV, whatever its names: ts and mw."""
    df = spark.read.schema("ts string, mw double").option("header", True).option("enforceSchema", True).csv(path)
    return nan_to_null(df.select(F.to_timestamp_ntz("ts", F.lit(layout)).alias("ts"), "mw"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of chunks of any of the three layouts, as doc_id, source, chunk_index, text."""
    kind = "id string, filename string, text string, source string, chunk_index int, content string, metadata struct<source: string, chunk_id: int>"
    df = spark.read.schema(kind).option("multiLine", True).json(path)
    source = F.coalesce("source", "metadata.source", "filename")
    return df.select(F.coalesce("id", source).alias("doc_id"), source.alias("source"), F.coalesce("chunk_index", "metadata.chunk_id").alias("chunk_index"), F.coalesce("text", "content").alias("text"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of numbers as rows of metric, value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt", most_chars: int | None = None) -> DataFrame:
    """One row for each file below a folder: path, text; optionally only the first characters."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    text = F.col("value") if most_chars is None else F.substring("value", 1, most_chars)
    return df.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def latest_text(spark: SparkSession, folder: str, prefix: str = "", suffix: str = ".txt") -> DataFrame:
    """path, text of the file whose name is the last one with this prefix and suffix; no row without any. The folder is listed by name, and one file is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*{suffix}").load(folder).select("path")  # no content column, so no content is read
    newest = listed.agg(F.max_by("path", F.regexp_extract("path", "[^/]+$", 0))).first()[0]
    if newest is None:
        return spark.createDataFrame([], "path string, text string")
    return spark.read.text(newest, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def since_days(days: int, now: str | None = None) -> str:
    """The first day of a look-back of so many trading days: twice as many calendar days before `now` (today in UTC)."""
    end = dt.datetime.fromisoformat(now) if now else dt.datetime.now(dt.timezone.utc)
    return (end - dt.timedelta(days=2 * days)).strftime("%Y-%m-%d")


def read_bars(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """OHLCV bars from Parquet; the date is pushed into the scan, rows with anything missing are dropped."""
    df = lower_columns(spark.read.parquet(path)).select("symbol", "ts", "open", "high", "low", "close", "volume")
    return (df if since is None else df.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))).dropna("any")


def ring_network(spark: SparkSession, buses: int = 14, ties: Sequence[tuple[int, int]] = ()) -> tuple[DataFrame, DataFrame]:
    """A ring of buses with periodic voltages, loads and alarms, and its branches."""
    i = F.col("id")
    nodes = spark.range(buses).select(
        F.concat(F.lit("Bus"), (i + 1).cast("string")).alias("bus"), (1.0 + 0.05 * (i % 3)).alias("voltage"),
        (50.0 + 10 * (i % 5)).alias("load_MW"), (i % 6 == 0).cast("int").alias("alarm_flag"), F.when(i % 2 == 0, 5.0).otherwise(-5.0).alias("p_inj_mw"),
    )
    name = lambda c: F.concat(F.lit("Bus"), (c + 1).cast("string"))
    edges = spark.range(buses).select(name(i).alias("from_bus"), name((i + 1) % buses).alias("to_bus"))
    if ties:
        edges = edges.unionByName(spark.createDataFrame([(f"Bus{a}", f"Bus{b}") for a, b in ties], BRANCHES))
    return nodes, edges
