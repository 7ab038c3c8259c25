"""The numbered queries over the given tables: each applies its operator and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.hard_negatives import hard_negatives
from gridloom.llm.language_id import identify
from gridloom.llm.language_id import train as train_languages
from gridloom.llm.lm_trie import lm_scores
from gridloom.llm.max_sketch import build_index, search
from gridloom.llm.mixing import mixed
from gridloom.llm.near_dedup import near_dedup
from gridloom.llm.packing import pack
from gridloom.llm.quality_classifier import quality_scores
from gridloom.llm.quality_rules import quality_rules
from gridloom.llm.secret_ledger import joined_spans, of_kinds, secret_scan
from gridloom.llm.sql import ORACLES  # noqa: F401
from gridloom.llm.token_shards import locate, read_tokens, write_token_shards
from gridloom.llm.url_filter import url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to the language references and the verdict, for each document."""
    out = quality_rules(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_common", F.round("char_distance", 9).alias("char_distance"), F.round("word_distance", 9).alias("word_distance"), "reason",
    )


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its class of near duplicates and the document that stays."""
    return near_dedup(_table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "class_id", "class_size", "kept")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the one that stays of its group, the group's size and the digest."""
    return exact_dedup(_table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the trie model, and under the add-one unigram base."""
    held = F.coalesce(_fold("doc_id", 7) == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return lm_scores(docs, ~F.col("held_out"), columns=["doc_id", "held_out"])


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, found through the index and read back from the shards."""
    docs = _table(spark, sf_dir, "documents")
    shards = write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    read = read_tokens(spark, shards, locate(spark, shards, docs), with_ids=False)
    start = (F.col("base") + F.col("at")).alias("start")
    return read.join(shards.starts(), "shard").select(F.col("key").alias("doc_id"), start, F.col("n").alias("n_tokens"), "ids_crc32", "shard")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets."""
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every address."""
    out = url_filter(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("ratio", 6).alias("ratio"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix, with its source's block and that block's slot."""
    return mixed(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "position", "slot", "block")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of good quality for every document; rows of the held-out fold teach nothing."""
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    out = quality_scores(docs, _table(spark, sf_dir, "labels").where(_fold("doc_id", 5) != 0), columns=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; rows of the held-out fold teach nothing."""
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = train_languages(docs, ~F.col("held_out"))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = build_index(_table(spark, sf_dir, "documents"))
    return search(index, _table(spark, sf_dir, "benchmark")).withColumnRenamed("doc", "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector for each of its positives; every seventh vector has the next label."""
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: each content is read once, its findings go to all documents that have it."""
    out = secret_scan(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    count = lambda kind: F.size(of_kinds(F.col("spans"), [kind])).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined_spans(of_kinds(F.col("spans"), ["assign", "access", "hex"])), 256).alias("base_sha256")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), base, joined_spans(F.col("spans")).alias("spans"), "blob")


NUMBERED = (
    op1_quality_rules, op2_near_dedup, op3_exact_dedup, op4_lm_scores, op5_token_shards, op6_packing, op7_url_filter, op8_mixing, op9_quality_classifier,
    op10_language_id, op11_lexical_search, op12_hard_negatives, op13_secret_ledger,
)
QUERIES = {f.__name__: f for f in NUMBERED}
