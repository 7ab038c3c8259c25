import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import splitter
from gridloom.functions import text as tx
from gridloom.functions import vectors as vx
from gridloom.sources import readers, writers


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None.__class__) else 'array<double>'}" for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize("n", [0, 1, 5, 8, 9, 16, 17, 25])
def test_word_chunks_cover_every_word(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([("a", "  " + "\n".join(words) + " ")], "id string, text string")
    got = [r.chunk.split(" ") for r in tx.word_chunks(df, size=10, overlap=2).orderBy("chunk_index").collect()]
    assert got == [words[i : i + 10] for i in range(0, n, 8)]


PAGES = ["", "  \n \n ", "a", "aaaa bbbb\n\ncccc\n \ndddd", "x" * 50 + "\n\ny\n\nz", "a\n\nb\n\nc\n\nd\n\ne", "p1\n\n" + "q" * 30 + "\n\nr", "\n\n".join(c * n for c, n in zip("abcdefghij", [3, 9, 1, 12, 4, 4, 2, 7, 5, 1]))]


@pytest.mark.parametrize("text", PAGES)
def test_paragraph_chunks(spark, text):
    """Without overlap the chunks hold every paragraph once and in order, none is cut, each is as full as it can be; an overlap puts the end of a chunk before the next one."""
    size, overlap = 12, 4
    plain = one(spark, tx.paragraph_chunks(F.col("t"), size, 0), t=text)
    pieces = [[p for p in c.split("\n\n")] for c in plain]
    assert [p for c in pieces for p in c] == [p.strip() for p in text.replace("\n \n", "\n\n").split("\n\n") if p.strip()]
    width = lambda c: sum(len(p) + 2 for p in c)
    assert all(width(c) <= size or len(c) == 1 for c in pieces)
    assert all(width([*a, b[0]]) > size for a, b in zip(pieces, pieces[1:], strict=False))
    led = one(spark, tx.paragraph_chunks(F.col("t"), size, overlap), t=text)
    assert led[:1] == plain[:1] and len(led) == len(plain)
    for before, own, got in zip(plain, plain[1:], led[1:], strict=False):
        assert got == f"{before[-overlap:]}\n{own}".strip()


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_recursive_splitter_sizes(text, size, overlap):
    chunks = splitter.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert {w for w in text.split() if len(w) <= size} <= {w for c in chunks for w in c.split()} | {w for w in text.split() if len(w) > size}


def test_tokens_names_lines(spark):
    assert one(spark, tx.token_estimate(F.col("t")), t="  a b\n\tc ") == 3
    assert one(spark, tx.token_estimate(F.col("t")), t=" ") == 0
    assert one(spark, tx.names_after(F.col("t"), "api."), t="api.load(x) myapi.no api.läst_1 api. api.load") == ["load", "läst_1", "load"]
    assert one(spark, tx.sorted_names(F.array(*map(F.lit, "bab"))), t="") == "a, b"
    assert one(spark, tx.line_items(F.col("t"), 2), t="- one -\n\n  \n-- two\n three") == ["one", "two"]
    assert one(spark, tx.contains_any_case(F.col("t"), "AbC"), t="xxaBcx") and not one(spark, tx.contains_any_case(F.col("t"), "x"), t=None)


@pytest.mark.parametrize("raw, want", [('{"content": "c", "message": "m"}', "c"), ('{"message": "m"}', "m"), ('{"k": 1}', '{"k": 1}'), ('["a", "b"]', "a\nb"), ("3", "3"), ('"s"', "s"), ("plain words", "plain words")])
def test_payload_text(spark, raw, want):
    assert one(spark, tx.payload_text(F.col("t")), t=raw) == want


def test_conductor_name(spark):
    name = lambda t, n: one(spark, tx.conductor_name(F.col("t"), F.lit(n), {"795": "795k"}, {"ACSR": "ACSR"}, {"drake": "DRAKE"}), t=t)
    assert name("795.0 26 acsr/old drake", 1) == "795k ACSR DRAKE"
    assert name("477.0 26 alu wire hawk", 2) == "477 x2 alu wire Hawk Bundled"
    assert name("too few words", 1) is None


def test_record(spark):
    line = one(spark, tx.record("BR", F.lit(1), F.lit(2), F.lit("1"), F.lit(0.5), F.lit(1.5), F.lit(0.1), F.array(F.lit(10.0), F.lit(20.0))), t="")
    assert line == "BR,1,2,1,,,,,,,0.5,1.5,0.1" + "," * 17 + "10.0,20.0;"


def test_vectors(spark):
    a, b = F.col("a"), F.col("b")
    f = lambda c, **v: one(spark, c, **v)
    assert f(vx.cosine(a, b), a=[3.0, 4.0], b=[4.0, 3.0]) == pytest.approx(0.96)
    assert f(vx.cosine(a, b), a=[0.0, 0.0], b=[4.0, 3.0]) == 0 and f(vx.l2(a, b), a=[1.0, 2.0], b=[4.0, 6.0]) == 5
    assert f(vx.unit(a), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8]) and f(vx.unit(a), a=[0.0]) == [0.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "load.csv").write_text("Datetime,AEP_MW\n2017-12-31 23:00:00,1.5\n2018-01-01 00:00:00,NaN\n")
    assert [tuple(r) for r in readers.read_time_series(spark, str(tmp_path / "load.csv")).collect()] == [(dt.datetime(2017, 12, 31, 23), 1.5), (dt.datetime(2018, 1, 1), None)]
    (tmp_path / "chunks.json").write_text('[{"text": "a", "source": "s", "chunk_index": 1}, {"id": "7", "text": "b"}, {"content": "c", "metadata": {"source": "m", "chunk_id": 2}}]')
    assert {tuple(r) for r in readers.read_chunks(spark, str(tmp_path / "chunks.json")).collect()} == {("s", "s", 1, "a"), ("7", None, None, "b"), ("m", "m", 2, "c")}
    (tmp_path / "m.json").write_text('{"rf": 0.9, "lr": 0.3}')
    assert {tuple(r) for r in readers.read_metrics(spark, str(tmp_path / "m.json")).collect()} == {("rf", 0.9), ("lr", 0.3)}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("hello\nworld")
    (tmp_path / "t/b.md").write_text("no")
    assert [r.text for r in readers.read_texts(spark, str(tmp_path / "t"), most_chars=7).collect()] == ["hello\nw"]
    (tmp_path / "f.csv").write_text("G,C\n1,0\n")
    with pytest.raises(ValueError, match="Ia"):
        readers.read_csv(spark, str(tmp_path / "f.csv"), "G int, C int", ["G", "Ia"])
    df = spark.createDataFrame([("g", 2, "y"), ("g", 1, "x"), ("h", 1, "z")], "g string, o int, t string")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), "g string, o int, t string").count() == 3
    writers.write_json(df, str(tmp_path / "json"))
    writers.write_vectors(df, str(tmp_path / "pq"))
    writers.write_joined_text(df, "g", F.col("o"), "t", str(tmp_path / "txt"), " / ")
    assert {r.value for r in spark.read.text(str(tmp_path / "txt")).collect()} == {"x / y", "z"}
    nodes, edges = readers.ring_network(spark, ties=[(1, 5)])
    assert nodes.count() == 14 and edges.count() == 15 and nodes.where("alarm_flag = 1").count() == 3
