"""Every operator on a table with the names that any of them uses inside, and with the session as it was."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exact_dedup, language_id, lm_trie, mixing, near_dedup, packing, quality_classifier, quality_rules, token_shards, url_filter

NAMES = (
    "n best _w _lines _t _t0 _word _found _row _file row file at digest points text_sha256 d f g k s u x y h key keys counts family label labels unit bands sketch bucket seen most outside "
    "part i lo off slot block position base chars ws ls bare lw found mine odd reason rule verdict ratio host path given side held judged score chunk teaches shard idx types codes in0 in1 "
    "_on _v _hot _hv _cold _cv _deal piece_id sequence_id offset length rank deal print runs lang_pred"
).split()


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"the text of number {i % 9} is not long " * (1 + i % 3), "en", f"s{i % 3}", f"http://h{i}.example.com/p/{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, url string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])


OPERATORS = {
    "quality_rules": lambda df, _: quality_rules.quality_rules(df),
    "near_dedup": lambda df, _: near_dedup.near_dedup(df),
    "exact_dedup": lambda df, _: exact_dedup.exact_dedup(df),
    "lm_scores": lambda df, _: lm_trie.lm_scores(df, F.col("doc_id") % 2 == 0),
    "url_filter": lambda df, _: url_filter.url_filter(df, (("block", "h3.example.com", "/"), ("allow", "com", "/p/2")), key="doc_id"),
    "mixed": lambda df, _: mixing.mixed(df),
    "quality_scores": lambda df, spark: quality_classifier.quality_scores(df, spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))),
    "identify": lambda df, _: language_id.identify(df, language_id.train(df, F.col("doc_id") % 2 == 0)),
}
ADDED = {
    "quality_rules": quality_rules.ADDED, "near_dedup": near_dedup.ADDED, "exact_dedup": exact_dedup.ADDED, "lm_scores": lm_trie.ADDED, "url_filter": url_filter.ADDED,
    "mixed": mixing.ADDED, "quality_scores": ("score",), "identify": language_id.ADDED,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_names_of_columns_do_not_matter(spark, named, name):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = OPERATORS[name](named, spark)
    assert out.columns == [c for c in named.columns if c not in ADDED[name]] + list(ADDED[name])
    rows = out.collect()
    assert len(rows) == 30
    for r in rows:
        assert all(r[c] == f"own {c}" for c in NAMES if c not in ADDED[name])
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == before


def test_names_of_columns_do_not_matter_to_tokens(spark, named):
    shards = token_shards.write_token_shards(named, public_tokenizers.path("word_bpe_49k.json"))
    assert token_shards.read_tokens(spark, shards, token_shards.locate(spark, shards, named)).count() == 30
    assert packing.pack(named, public_tokenizers.path("byte_bpe_50k.json"), order=["rank", "doc_id"]).count() == 30
