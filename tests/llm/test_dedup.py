import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import near_dedup as nd
from gridloom.llm.exact_dedup import exact_dedup, sha256
from gridloom.llm.work import fresh_dir

from ..conftest import SF
from .conftest import prose


def exact_truth(rows):
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[re.sub("[ \t-\r]", "", text or "")].append((-len(text or ""), key is None, key))
    best = {k: min(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    return sorted(((k, best[n][2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for k, t in rows for n in [re.sub("[ \t-\r]", "", t or "")]), key=str)


def shown(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_exact_dedup_matches_brute_force(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        out = exact_dedup(df)
        truth = exact_truth([(r.doc_id, r.text) for r in df.collect()])
        assert shown(out) == truth
        assert out.where("kept").count() == len({x[3] for x in truth})
    assert exact_dedup(none).count() == 0


@pytest.mark.parametrize("digits", [1, 64])
def test_exact_dedup_checks_full_texts_on_hits(spark, odd, digits):
    """With a digest of one digit most hits are of different texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text"))
    out = exact_dedup(docs, digest=lambda c: F.substring(sha256(c), 1, digits))
    truth = exact_truth([(r.doc_id, r.text) for r in docs.collect()])
    assert [x[:3] for x in shown(out.withColumn("text_sha256", sha256(F.col("text"))))] == [x[:3] for x in truth]


def test_exact_dedup_keeps_its_state_between_calls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = fresh_dir(spark, "state")
    exact_dedup(docs.where("doc_id % 2 = 0"), path=path).count()
    out = exact_dedup(docs.where("doc_id % 2 = 1"), path=path)
    assert shown(out) == exact_truth([(r.doc_id, r.text) for r in docs.collect()])


def texts_of(rows):
    """Digest to shingles and counts, of the texts with a word."""
    words = [nd.words_of(t) for _, t in rows]
    return {b" ".join(w): nd.shingles(w, 5) for w in words if w}


def idf_truth(rows, s=nd.Settings()):
    """Frequencies by definition: over the heads of families."""
    texts = texts_of(rows)
    digest = {w: hashlib.blake2b(w, digest_size=16).digest() for w in texts}
    buckets = {w: nd._families(k).tolist() for w, (k, _) in texts.items()}
    least = {}
    for w in sorted(texts, key=digest.get, reverse=True):
        least.update(dict.fromkeys(buckets[w], digest[w]))
    heads = [w for w in texts if all(least[b] == digest[w] for b in buckets[w])]
    df = collections.Counter(k for w in heads for k in texts[w][0].tolist())
    n = len(heads)
    df = {k: x for k, x in df.items() if x >= max(2, 0.75 * s.rare * n)}
    return nd.idf_of(np.array(list(df), np.uint32), np.array(list(df.values()), np.int64), n, s.rare)


def weighted(text, idf):
    k, n = nd.shingles(nd.words_of(text), 5)
    return k, n * idf.of(k)


def similarity(a, b):
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    m = np.minimum(a[1][x], b[1][y]).sum()
    return m / (a[1].sum() + b[1].sum() - m) if m else 0.0


def near_truth(rows, s=nd.Settings()):
    """Components of all pairs whose weighted Jaccard similarity is high enough."""
    idf = idf_truth(rows)
    own = [weighted(t, idf) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(own[i], own[j]) >= s.similarity - 1e-12:
                up[root(i)] = root(j)
    return sorted(sorted((str(rows[k][0]) for k in range(len(rows)) if root(k) == r)) for r in {root(k) for k in range(len(rows))})


def found(df):
    by = collections.defaultdict(list)
    for i, r in enumerate(df.select("doc_id", "class_id", "kept", "class_size", "text").collect()):
        blank = not (r.text or "").split()
        by[("blank", i) if blank else r.class_id].append(str(r.doc_id))
    return sorted(map(sorted, by.values()))


def test_near_dedup_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = nd.near_dedup(docs)
    assert found(out) == near_truth([(r.doc_id, r.text) for r in docs.collect()])
    assert out.count() == docs.count() and out.where("kept").count() == out.select("class_id").distinct().count()


def test_near_dedup_of_large_groups(spark, monkeypatch):
    """One group of near copies of a text, some of which are alike only through others, in more than one block."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "WIDE", 16)
    base = prose(150, 5, [f"w{i}" for i in range(400)]).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 29) % len(w)] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(150, 100 + i, [f"v{j}" for j in range(900)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_dedup(docs)) == near_truth(rows)


@pytest.mark.parametrize("depth", [nd.DEPTH, 1, 0])
def test_near_dedup_splits_units_of_texts_that_share_a_passage(spark, monkeypatch, depth):
    """Texts that share half of their words collide in many bands, but only some are alike; without a split, or with one by single bands, no pair of candidates is lost."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "WIDE", 8)
    shared = prose(60, 1, [f"s{i}" for i in range(300)])
    rows = [(i, shared + " " + prose(40, 50 + i, [f"t{j}" for j in range(2000)])) for i in range(60)]
    rows += [(100 + i, t + f" extra{i}") for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nd.near_dedup(docs, nd.Settings(depth=depth))) == near_truth(rows)


def test_classes_do_not_depend_on_the_size_of_a_unit(spark, monkeypatch):
    """At a similarity where most pairs that reach it share few bands or none: the same classes whether units are split or not."""
    shared = prose(60, 1, [f"s{i}" for i in range(300)])
    rows = [(i, " ".join(shared.split()[: 20 + i % 40]) + " " + prose(30, 50 + i, [f"t{j}" for j in range(2000)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(nd, "BLOCK", 8)
    got = []
    for wide in (2, 10**9):
        monkeypatch.setattr(nd, "WIDE", wide)
        got.append(found(nd.near_dedup(docs, nd.Settings(similarity=0.35, rare=1.0))))
    assert got[0] == got[1] and 1 < len(got[0]) < 38


def test_near_dedup_keeps_the_longest_then_the_smallest_key(spark):
    base = prose(100, 4, [f"w{i}" for i in range(500)])
    rows = [(7, base), (5, base + "  "), (9, base + " "), (3, base + "  "), (3, base + "  "), (None, base + "  "), (20, "a b"), (21, "A  b"), (22, None), (23, "")]
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [r for r in out if r.kept]
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in kept) == [(3, 3, 6), (21, 21, 2), (22, 22, 1), (23, 23, 1)]
    assert {r.class_id for r in out if r.text and r.text.startswith(base)} == {3}


def test_copies_do_not_make_their_shingles_common(spark):
    """A thousand near copies are one family or a few: their shingles keep a rare one's weight."""
    base = prose(200, 4, [f"w{i}" for i in range(500)]).split()
    rows = [(i, " ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 :])) for i in range(1000)]
    rows += [(2000 + i, prose(80, i, [f"v{j}" for j in range(5000)])) for i in range(600)]
    idf = idf_truth(rows)
    keys = nd.shingles([w.encode() for w in base], 5)[0]
    assert idf.of(keys).min() > 0.5
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 1000")
    assert out.where("kept").count() == 1


def test_near_dedup_recall_by_similarity(spark):
    """All pairs of the documents that share a shingle, against the classes found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    idf = idf_truth(rows)
    own = {k: weighted(t, idf) for k, t in rows if (t or "").split()}
    by = collections.defaultdict(list)
    for k, (keys, _) in own.items():
        for h in keys.tolist():
            by[h].append(k)
    pairs = {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[:i]}
    cls = {r.doc_id: r.class_id for r in nd.near_dedup(docs).collect()}
    bands = collections.defaultdict(lambda: [0, 0])
    for a, b in pairs:
        x = similarity(own[a], own[b])
        if x >= 0.8:
            n = bands[min(int(x * 20), 19)]
            n[0] += cls[a] == cls[b]
            n[1] += 1
    print({b / 20: n for b, n in sorted(bands.items())})
    assert all(n[0] >= 0.9 * n[1] for n in bands.values()) and sum(n[1] for n in bands.values()) > 20


def test_near_dedup_defined_cases(spark, odd, none):
    out = nd.near_dedup(odd)
    assert out.count() == odd.count() and len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.select("class_size", "text", "kept").collect()
    for r in rows:
        assert r.class_size >= 1
        if not (r.text or "").split():
            assert r.kept and r.class_size == 1
    assert nd.near_dedup(none).count() == 0


def test_lossy_counts_miss_at_most_their_error(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHINGLES_AT_ONCE", 3000)
    s = nd.Settings(rare=0.05)
    rows = [(i, "common words in every text here " * (i % 2) + prose(30, i, [f"v{j}" for j in range(400)])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = nd.numbered(docs.withColumn("f", nd._reader(s)(F.col("text"))), "t")
    with nd.scratch(spark, "t") as tmp:
        keys, df, n = nd.frequencies(read, tmp, s)
        heads = {r.row for r in nd.family_heads(read).collect()}
    truth = collections.Counter(k for r in read.collect() if r.row in heads for k in np.frombuffer(r.f.keys, np.uint32).tolist())
    got = dict(zip(keys.tolist(), df.tolist()))
    assert n == len(heads) and all(truth[k] - s.rare / 4 * n <= x <= truth[k] for k, x in got.items())
    assert set(got) >= {k for k, x in truth.items() if x >= s.rare * n and x > 1}


def test_frequencies_are_exact_however_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(nd, "SHINGLES_AT_ONCE", 900)
    s = nd.Settings(rare=0.2)
    rows = [(i, prose(30, i, [f"v{j}" for j in range(400)]) + (" one line that many of them share" if i < 100 or i % 40 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    read = nd.numbered(docs.withColumn("f", nd._reader(s)(F.col("text"))), "t")
    with nd.scratch(spark, "t") as tmp:
        keys, df, n = nd.frequencies(read, tmp, s)
        heads = {r.row for r in nd.family_heads(read).collect()}
    truth = collections.Counter(k for r in read.collect() if r.row in heads for k in np.frombuffer(r.f.keys, np.uint32).tolist())
    want = {k: x for k, x in truth.items() if x >= max(2, s.rare * n)}
    assert dict(zip(keys.tolist(), df.tolist())) == want and len(want) >= 3


def test_weighted_samples_agree_as_often_as_texts_are_alike():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.uniform(0.5, 4, 200), rng.uniform(0.5, 4, 200)
    s = nd.Sampler(4096)
    same = (s.draw(keys[:200], a) == s.draw(keys[100:], b)).mean()
    low, high = np.minimum(a[100:], b[:100]).sum(), np.maximum(a[100:], b[:100]).sum() + a[:100].sum() + b[100:].sum()
    assert abs(same - low / high) < 0.03


def test_components(spark):
    pairs = [(9, 8), (8, 7), (7, 6), (1, 2), (3, 2), (5, 5), *[(20 + i, 21 + i) for i in range(40)], *[(100, 101 + i) for i in range(60)]]
    links = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in pairs], "a binary, b binary")
    with nd.scratch(spark, "t") as tmp:
        out = {r.d[0]: r.label[0] for r in nd.components(links, tmp).collect()}
    assert out[9] == out[8] == out[7] == out[6] == 6 and out[1] == out[2] == out[3] == 1
    assert {out[i] for i in range(20, 61)} == {20} and {out[i] for i in range(100, 161)} == {100}


def test_rows_that_a_plan_repeats_count_each_for_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    twice = spark.read.parquet(f"{SF}/documents.parquet").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    assert nd.near_dedup(twice).count() == twice.count() == nd.near_dedup(twice).where("class_size >= 2").count()
    both = docs.union(docs)
    assert nd.near_dedup(both).count() == 80 and exact_dedup(twice).count() == twice.count()
