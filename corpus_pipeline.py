"""A corpus pipeline: quality rules, exact and near duplicates, mixing by source, packing.

Each stage takes what its predecessor kept, with the columns of documents, and returns those columns; the last one
returns the packed pieces with their token ids. The mix decides the order of the documents, and packing keeps it: it
packs runs of neighbours, and sequences by number follow the mix. Null and empty texts fail the quality rules; an empty
table passes through all stages. What a stage leaves in the shared folder goes two stages later, when its rows have
been written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.mixing import mixed
from gridloom.llm.near_dedup import near_dedup
from gridloom.llm.packing import pack
from gridloom.llm.quality_rules import quality_rules
from gridloom.llm.work import Leftovers, staged

LEFTOVERS = Leftovers()


@LEFTOVERS.stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs).where("kept").select(*docs.columns)


@LEFTOVERS.stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


@LEFTOVERS.stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup(docs).where("kept").select(*docs.columns)


@LEFTOVERS.stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files and the rows in them follow the schedule."""
    return mixed(docs).orderBy("position").select(*docs.columns)


def _with_place(docs: DataFrame) -> DataFrame:
    """`docs` with part, file and at: the place of each row in the files, which the mix has written in its order."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    place = {"mix-part": F.coalesce(part.try_cast("long"), F.lit(0)), "mix-file": F.col("_metadata.file_name"), "mix-at": F.col("_metadata.row_index")}
    try:
        return docs.withColumns(place)
    except AnalysisException:  # not read from files: so they are written first
        return staged(docs, "mixed").withColumns(place)


@LEFTOVERS.stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids, sequences and offsets; sequence numbers follow the order of the documents."""
    order = ["mix-part", "mix-file", "mix-at"]
    packed = pack(_with_place(docs), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, order=order)
    return packed.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs


ORACLE_SQL = None  # near duplicates, the schedule and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version
