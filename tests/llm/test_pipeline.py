"""The pipeline's run() against a brute-force version, and its stages on odd rows."""

import collections
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import mixing

from ..conftest import SF
from .conftest import DOCS, prose
from .test_dedup import near_truth
from .test_filters import rules_truth
from .test_output import crc

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def kept_truth(rows):
    """ids that stay after the rules, exact and near duplicates; rows of id, text and lang."""
    rows = [r for r, (why, *_) in zip(rows, rules_truth([(t, lang) for _, t, lang in rows]), strict=True) if why is None]
    best = {}
    for k, t, lang in rows:
        n = re.sub("[ \t-\r]", "", t)
        if n not in best or (-len(t), k) < best[n][0]:
            best[n] = ((-len(t), k), (k, t, lang))
    rows = {r[0]: r for _, r in best.values()}
    for group in near_truth([(k, t) for k, t, _ in rows.values()]):
        own = sorted((-len(rows[int(k)][1]), int(k)) for k in group)
        for _, k in own[1:]:
            del rows[k]
    return rows


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = kept_truth([(r.doc_id, r.text, r.lang) for r in docs])
    out = corpus_pipeline.run(spark, SF).collect()
    whole = Tokenizer.from_file(BYTE)
    ids, by, first = collections.defaultdict(dict), collections.defaultdict(list), {}
    for r in out:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        ids[r.doc_id][r.piece] = r
        by[r.sequence_id].append(r)
    assert set(ids) == set(want)
    for k, pieces in ids.items():
        assert [x for p in sorted(pieces) for x in pieces[p].ids] == [*whole.encode(want[k][1], add_special_tokens=False).ids, 2]
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # the mix: its positions over the same documents give the order of the sequences
    table = spark.createDataFrame([(r.doc_id, r.source) for r in docs if r.doc_id in want], "doc_id long, source string")
    position = {r.doc_id: r.position for r in mixing.mixed(table).collect()}
    for s in sorted(by):
        first[s] = min(position[r.doc_id] for r in by[s])
    order = list(first.values())
    assert order == sorted(order)


def test_stages_on_odd_rows(spark, none):
    """Ties, repeated rows, nulls, very long texts and columns with the operators' names."""
    base = prose(120, 2, [f"w{i}" for i in range(300)] + "the of and to in a is that it was".split() * 20)
    rows = [(1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base + "  \n", "en", "b", 5), (3, None, None, None, None), (4, "", "de", "a", 0), (None, base, None, "a", None), (5, prose(6000, 1), "en", None, 7), (5, prose(90, 8), "en", None, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("kept", "n", "best", "row", "position", "mix", "part", "ids", "g", "d", "f"):
        docs = docs.withColumn(c, F.lit("own"))
    now, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns and {r.n for r in now.collect()} <= {"own"}
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[2] == sizes[3] >= 1
    packed = corpus_pipeline.STAGES[4][1](spark, now, SF)
    assert collections.Counter(r.doc_id for r in now.collect()) == collections.Counter(r.doc_id for r in packed.where("piece = 0").collect())
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_stages_are_named():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]
    assert np.unique([f.__name__ for _, f in corpus_pipeline.STAGES]).size == 5


def test_leftovers_go_when_nothing_reads_them(spark, tmp_path):
    from gridloom.llm import work

    held = work.Leftovers()

    @held.stage
    def copied(spark, docs):
        return work.staged(docs, "copy")

    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    one = copied(spark, docs)
    two = copied(spark, one)  # `one` is alive, and read
    assert one.count() == two.count() == 10 and len(held.held) == 2
    chained = copied(spark, one).where("doc_id < 5")
    del one
    held.sweep(chained)
    assert chained.count() == 5 and two.count() == 10  # frames that are alive keep what they read
    path = two.inputFiles()[0].rsplit("/", 1)[0]
    two.write.parquet(str(tmp_path / "out"))
    del two
    copied(spark, spark.read.parquet(str(tmp_path / "out")))
    store, at = work.files.at(path)
    assert store.get_file_info(at).type.name == "NotFound"
