"""The numbered queries: their columns, and those with SQL against DuckDB."""

import duckdb
import pytest

from gridloom.llm.queries import ORACLES, QUERIES

from ..conftest import SF
from ..test_queries import TABLES, plain

CONTRACTS = {
    "op1": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op2": "doc_id bigint, class_id bigint",
    "op3": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op6": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op7": "page_id bigint, host string, path string, rule string, verdict string",
    "op8": "doc_id bigint, source string, position bigint",
    "op9": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op11": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op13": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    want = [tuple(c.split()) for c in CONTRACTS[name.split("_")[0]].split(", ")]
    assert df.dtypes[: len(want)] == want
    if name.startswith(("op11", "op12")):  # not a row for each document; their SQL is below
        return
    rows = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op7') else 'documents'}.parquet").count()
    assert df.count() >= rows if name.startswith("op6") else df.count() == rows


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, result = QUERIES[name](spark, SF), duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want
