import collections
import math
import zlib
from fractions import Fraction
from itertools import islice

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, lm_trie, mixing, packing, token_shards, work

from ..conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = st.text(alphabet="ab .,\n\t'sSéß1²☃ \x1c\x85́　|*-)<>İﬁ漢👍", max_size=60)


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(ODD, max_size=8))
def test_stretches_give_the_ids_of_whole_texts(path, texts):
    whole = Tokenizer.from_file(path)
    texts = [*texts, "a <|endoftext|> b", "it's 'll They'LL  x"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert bpe.Encoder(path, limit=5).encode(texts) == want


def ids_of(path, text):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_shards_round_trip(spark, odd, none):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        shards = token_shards.write_token_shards(df, WORD)
        got = token_shards.read_tokens(spark, shards, token_shards.locate(spark, shards, df)).join(shards.starts(), "shard").collect()
        rows = df.select("doc_id", "text").collect()
        assert len(got) == len(rows)
        want = collections.Counter((r.doc_id, crc(ids_of(WORD, r.text))) for r in rows)
        assert collections.Counter((r.key, r.ids_crc32) for r in got) == want
        assert all(crc(r.ids) == r.ids_crc32 and r.n == len(r.ids) for r in got)
        at = 0
        for r in sorted(got, key=lambda r: r.base + r["at"]):
            assert r.base + r["at"] == at
            at += r.n
        order = [r.key for r in sorted(got, key=lambda r: r.base + r["at"])]
        assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    absent = spark.createDataFrame([(10**9 + i,) for i in range(300)], "doc_id long")
    assert token_shards.locate(spark, shards, absent).count() == 0
    empty = token_shards.write_token_shards(none, WORD)
    assert empty.entries.count() == 0 and token_shards.locate(spark, empty, none).count() == 0


def test_token_shards_find_all_rows_of_a_key_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "ROWS_IN_RUN", 100)
    rows = [(i if i % 3 else 1500, f"text {i} " + "of a line " * (i % 7)) for i in range(3000)] + [(None, f"none {i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_shards.write_token_shards(docs, WORD)
        places = token_shards.locate(spark, shards, docs).collect()
        got = token_shards.read_tokens(spark, shards, token_shards.locate(spark, shards, docs)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.shard for p in places if p.key == 1500}) >= 2 and len({p.shard for p in places}) >= 3
    assert max(p.rows for p in places) <= 100
    whole = Tokenizer.from_file(WORD)
    want = collections.Counter((k, crc([*whole.encode(t, add_special_tokens=False).ids, 2])) for k, t in rows)
    assert collections.Counter((r.key, r.ids_crc32) for r in got) == want
    at = {}
    for r in sorted(got, key=lambda r: (r.shard, r["at"])):
        assert r["at"] == at.get(r.shard, 0)
        at[r.shard] = r["at"] + r.n
    short = spark.createDataFrame([(1, places[0].shard, 0, 0, 10**6)], "key long, shard long, row long, at long, rows long")
    with pytest.raises(Exception, match="ends early"):
        token_shards.read_tokens(spark, shards, short).collect()


def test_token_shards_tell_keys_apart_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "_hash", lambda key: F.pmod(F.xxhash64(key), F.lit(7)))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    shards = token_shards.write_token_shards(docs, WORD)
    got = token_shards.read_tokens(spark, shards, token_shards.locate(spark, shards, docs)).collect()
    assert {r.key: r.ids_crc32 for r in got} == {i: crc(ids_of(WORD, f"text {i}")) for i in range(200)} and len(got) == 200
    assert token_shards.locate(spark, shards, spark.range(1000, 1100).withColumnRenamed("id", "doc_id")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=500))
def test_perfect_hash_is_minimal(keys):
    h = np.array(sorted(keys), np.uint64)
    m = token_shards.PerfectHash.build(h)
    assert sorted(m.slots(h).tolist()) == list(range(len(h)))


def test_packing(spark, odd, none):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), odd):
        out = packing.pack(df, BYTE).collect()
        bins, docs = collections.defaultdict(list), collections.defaultdict(list)
        for r in out:
            bins[r.sequence_id].append((r.offset, r.length))
            docs[r.key].append(r)
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 1024
        want = collections.Counter()
        for d in df.select("doc_id", "text").collect():
            ids = ids_of(BYTE, d.text)
            edges = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
            want.update((d.doc_id, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(edges, edges[1:])))
        assert collections.Counter((r.key, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        bound = packing.certified_bound(packing.pack(df, BYTE))
        assert bound <= len(bins) <= 1.05 * bound + 1
    assert packing.pack(none, BYTE).count() == 0


@pytest.mark.parametrize("ordered", [False, True])
def test_packing_exchange_between_groups(spark, monkeypatch, ordered):
    monkeypatch.setattr(packing, "PIECES_IN_GROUP", 40)
    items = spark.range(1000).select(F.col("id").alias("piece_id"), (F.pmod(F.xxhash64("id"), F.lit(600)) + 50).alias("length"), F.col("id").alias("rank"))
    with work.scratch(spark, "t") as tmp:
        out = packing.pack_lengths(items, tmp, 1024, ordered).join(items, "piece_id").collect()
        first = packing._pack_groups(items.withColumn("deal", F.col("rank") if ordered else F.xxhash64("piece_id", F.lit(0))), 25, 1024).select("sequence_id").distinct().count()
    fill, least = collections.Counter(), {}
    for r in out:
        fill[r.sequence_id] += r.length
        least[r.sequence_id] = min(least.get(r.sequence_id, r["rank"]), r["rank"])
    counts = np.bincount([r.length for r in out], minlength=1025)
    assert len(out) == 1000 and max(fill.values()) <= 1024 and all(s == x for s, x in least.items())
    assert packing.lower_bound(counts, 1024) <= len(fill) < first


def test_packing_in_order(spark, monkeypatch):
    """Sequences by number follow the order: each holds documents of one run of neighbours, or few."""
    monkeypatch.setattr(packing, "PIECES_IN_GROUP", 30)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("turn", F.xxhash64("doc_id"))
    out = packing.pack(docs, BYTE, order=["turn"], with_ids=True).join(docs.select(F.col("doc_id").alias("key"), "turn"), "key").collect()
    place = {k: i for i, (_, k) in enumerate(sorted({(r.turn, r.key) for r in out}))}
    by = collections.defaultdict(list)
    for r in out:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        by[r.sequence_id].append(place[r.key])
    starts = [min(by[s]) for s in sorted(by)]
    assert starts == sorted(starts) and np.mean([max(x) - min(x) for x in by.values()]) < len(place) / 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9))
def test_lower_bound_never_exceeds_the_best_packing(lengths):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[k] >= lengths[i]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, 30 - lengths[i]])

    place(0, [])
    bound = packing.lower_bound(np.bincount(lengths, minlength=31), 30)
    bins, offsets, used = packing.best_fit_decreasing(np.array(lengths), 30)
    assert bound <= best <= used and np.bincount(bins, weights=lengths).max() <= 30


def deviation(halves, weights, size):
    """The most that a source is from its share, in halves of a block, over all slots of all phases; checks that all halves come, in order."""
    given_, now, worst, t = collections.Counter(), None, 0.0, 0
    for first, at, n, own, before in mixing.segments(halves, weights, size):
        assert first == sum(given_.values())
        if at == 0:
            now, t, shares = collections.Counter(), 0, {s: float(w) for s, w in own.items()}
        for s, k in mixing.slots_of(at, n, own, before):
            assert k == given_[s]
            given_[s] += 1
            now[s] += 1
            t += 1
            if len(own) < 6 or t % 31 == 0:
                worst = max(worst, max(abs(now[x] - w * t) for x, w in shares.items()))
    assert given_ == collections.Counter({s: n for s, n in halves.items() if n})
    return worst


def test_mixing_finds_segments_by_number():
    halves, weights = {"a": 900, "b": 400, "c": 37, "d": 0, "e": 5}, {"a": Fraction(3), "b": Fraction(3), "c": Fraction(1), "d": Fraction(2), "e": Fraction(0)}
    every = list(mixing.segments(halves, weights, 16))
    assert mixing.segment_count(halves, weights, 16) == len(every) > 40
    for numbers in ([0], [len(every) - 1], list(range(3, len(every), 7)), [], list(range(len(every)))):
        assert list(mixing.segments(halves, weights, 16, numbers)) == [every[g] for g in numbers]


def test_mixing_stays_within_a_block_over_a_million_slots():
    counts = {"a": 200_000, "b": 400_000, "c": 600_000}
    assert deviation(counts, {s: Fraction(n**0.5) for s, n in counts.items()}, mixing.SEGMENT) < 2


@pytest.mark.parametrize("counts", [[33_333, 20_000, 9_000, 4_000, 900, 200, 90, 30, 10], [50_000, *[1_000] * 30]])
def test_mixing_keeps_unrounded_weights(counts):
    counts = {f"s{k:02}": n for k, n in enumerate(counts)}
    assert deviation(counts, {s: Fraction(n**0.5) for s, n in counts.items()}, 512) < 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(0, 60), st.integers(0, 9)), min_size=1), st.integers(1, 20))
def test_mixing_of_any_counts_and_weights(sources, size):
    halves, weights = {s: n for s, (n, _) in sources.items()}, {s: Fraction(w) for s, (_, w) in sources.items()}
    assert deviation(halves, weights, size) < 2
    assert collections.Counter(s for s, _ in mixing.schedule(halves, weights, size)) == collections.Counter({s: n for s, n in halves.items() if n})


def test_mixing_positions_follow_the_schedule(spark, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 64)
    rows = [(i, "abbcccdddddddd"[i % 14]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")  # positions do not hang on files
    try:
        out = mixing.mixed(docs, weights, block=4).orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert [r.position for r in out] == list(range(1500))
    total = collections.Counter(r.source for r in out)
    want, at = [], collections.Counter()
    for s, _ in mixing.schedule({f"={s}": -(-n // 2) for s, n in total.items()}, {f"={s}": Fraction(w) for s, w in weights.items()}, 64):
        n = min(2, total[s[1:]] - at[s])
        want += [s[1:]] * n
        at[s] += n
    assert [r.source for r in out] == want
    given_ = collections.Counter()
    for t, r in enumerate(out, 1):
        assert r.block == given_[r.source] // 4
        given_[r.source] += 1
        assert all(abs(given_[s] - t * w) < 4 + 2 for s, w in weights.items())  # a block, and the half that is under way
        if any(given_[s] == total[s] for s in total):
            break
    assert t > 200
    out = mixing.mixed(odd).collect()
    assert sorted(r.position for r in out) == list(range(odd.count()))
    assert mixing.mixed(none).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 40), min_size=1))
def test_pfair_windows(weights):
    total = sum(weights.values())
    for t, (s, i) in enumerate(islice(mixing.pfair(weights), 2 * total)):
        assert i * total // weights[s] <= t < -(-(i + 1) * total // weights[s])


def lm_truth(rows, training):
    words = [((t or "").encode().lower().split() + [None]) for t in rows]
    taught = [w for w, k in zip(words, training, strict=True) if k]
    c = collections.Counter(x for w in taught for x in w)
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for w in taught for p in zip([0, *w[:-1]], w))
    types, total = collections.Counter(a for a, _ in pairs), collections.Counter(c)
    total[0] = len(taught)
    for w in words:
        base = score = 0.0
        for a, x in zip([0, *w[:-1]], w):
            u = (c[x] + 1) / (n + v + 1)
            left = lm_trie.DISCOUNT * types[a] / total[a] if total[a] else 1.0
            base += math.log10(u)
            score += math.log10(max(pairs[(a, x)] - lm_trie.DISCOUNT, 0) / max(1, total[a]) + left * u)
        yield len(w), sum(c[x] > 0 for x in w), n, base, score


def test_lm_scores_match_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd):
        training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
        rows = df.select("text", training.alias("k")).collect()
        out = lm_trie.lm_scores(df, training).collect()
        want = sorted(lm_truth([r.text for r in rows], [r.k for r in rows]))
        for got, (n, known, total, base, score) in zip(sorted(out, key=lambda r: (r.n_tokens, r.n_known, r.train_tokens, r.base_score)), want, strict=True):
            assert (got.n_tokens, got.n_known, got.train_tokens) == (n, known, total)
            assert abs(got.base_score - base) < 1e-6 * abs(base) + 1e-6 and abs(got.score - score) < 3e-4 * n
    assert lm_trie.lm_scores(none, F.lit(True)).count() == 0
    assert {r.score for r in lm_trie.lm_scores(docs, F.lit(False)).collect()} == {0.0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), min_size=1, max_size=300), st.lists(st.integers(0, 2**46), max_size=30))
def test_elias_fano(values, others):
    v = np.sort(np.array(values, np.int64))
    e = lm_trie.EliasFano.build(v)
    assert (e.get(np.arange(len(v))).astype(np.int64) == v).all()
    q = np.array([*values, *others], np.int64)
    at = np.searchsorted(v, q)
    hit = (at < len(v)) & (v[np.minimum(at, len(v) - 1)] == q)
    assert (e.find(q.astype(np.uint64)) == np.where(hit, at, -1)).all()
