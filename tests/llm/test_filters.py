import collections
import math
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import language_id, quality_classifier, url_filter
from gridloom.llm.quality_rules import COMMON, MIN_REFERENCE, Rules, quality_rules

from ..conftest import SF
from .conftest import prose


def base(text):
    w = [x for x in re.split("[ \t-\r]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    c, cover = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum((text or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)


def classes(text):
    """Counts by character class, by definition."""
    out = [0] * 7
    for c in re.sub("[ \t-\r]", "", text or ""):
        kind = unicodedata.category(c)
        tests = (c in "aeiou", "a" <= c <= "z", kind == "Lu", kind[0] == "L", kind[0] == "N", c in ".,;:!?'\"()-", True)
        out[tests.index(True)] += 1
    return out


def letter_words(text):
    runs, now = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            now += c
        elif now:
            runs.append(now)
            now = ""
    return runs


def distance(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, sum(x * math.log2(x / z) for x, z in zip(p, m, strict=True) if x) + sum(y * math.log2(y / z) for y, z in zip(q, m, strict=True) if y)) / 2)


def rules_truth(rows, r=Rules()):
    """reason and distances of rows of text and lang."""
    own = [(base(t), classes(t), collections.Counter(letter_words(t)), lang) for t, lang in rows]
    failed = ["few_words" if b[0] < r.min_words else "repeats" if 100 * b[4] > r.max_repeat_percent * b[0] else None for b, *_ in own]
    refs = {}
    for lang in {x[3] for x, f in zip(own, failed, strict=True) if not f and x[3] is not None}:
        clean = [x for x, f in zip(own, failed, strict=True) if not f and x[3] == lang]
        words, chars = sum((x[2] for x in clean), collections.Counter()), np.sum([x[1] for x in clean], axis=0)
        if sum(words.values()) >= MIN_REFERENCE:
            refs[lang] = chars / chars.sum(), {w: n / sum(words.values()) for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:COMMON]}

    def words_to(counts, ref):
        n = sum(counts.values())
        p = [counts[w] / n for w in ref]
        return distance([*p, max(0.0, 1 - sum(p))], [*ref.values(), 1 - sum(ref.values())])

    for (b, chars, words, lang), why in zip(own, failed, strict=True):
        d = [0.0, 0.0]
        if refs:
            for i, (limit, some, of) in enumerate(((r.char_distance, sum(chars), lambda ref: distance([x / sum(chars) for x in chars], ref[0])), (r.word_distance, sum(words.values()), lambda ref: words_to(words, ref[1])))):
                d[i] = 1.0 if not some else of(refs[lang]) if lang in refs and of(refs[lang]) <= limit else min(map(of, refs.values()))
            odd = "char_divergence" if sum(chars) >= r.min_chars and d[0] > r.char_distance else "word_divergence" if sum(words.values()) >= r.min_letter_words and d[1] > r.word_distance else None
            why = why or odd
        yield why, *d


def test_quality_rules_match_brute_force(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        out = quality_rules(df).collect()
        for r, (why, chars, words) in zip(out, rules_truth([(r.text, r.lang) for r in out]), strict=True):
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert (r.reason, r.kept) == (why, why is None)
            if df is docs:
                assert abs(r.char_distance - chars) < 1e-9 and abs(r.word_distance - words) < 1e-9


def test_quality_references_are_one_constant(spark):
    """However many languages there are, the plan holds their references as values, not as expressions."""
    rows = [(i, f"l{i % 60}", " ".join(f"{chr(97 + i % 60 % 26)}{chr(97 + i % 60 // 26)}{chr(97 + (i + k) % 9)}" for k in range(1200 if i < 60 else 150))) for i in range(180)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.word_distance < 0.2 for r in out.collect() if r.doc_id >= 60)


def test_quality_rules_each_arm_decides(spark):
    """Shouting and starred words by their characters, rare words in proper sentences by their words; each language by its own reference."""
    other = "kolo pes dum strom voda ryba hora les pole cesta most reka nebo".split()
    rows = [(i, prose(150, i), "en") for i in range(40)] + [(100 + i, prose(150, i, other), "cs") for i in range(40)]
    rows += [(200, " ".join(w.upper() + "!!" for w in prose(200, 9).split()), "en"), (201, " ".join(f"{w}***" for w in prose(150, 8).split()), "en")]
    rows += [(202, prose(150, 5, [f"ro{a}{b}en" for a in "bcdfgh" for b in "aeiou"]), "en"), (203, prose(150, 6, other), "en"), (204, prose(150, 6, other), None)]
    rows += [(205, prose(60, 5, [f"ro{a}{b}en" for a in "bcdfgh" for b in "aeiou"]), "en")]
    out = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].kept for i in [*range(40), *range(100, 140)] if not out[i].base_failed)
    assert [out[i].reason for i in (200, 201, 202, 203, 204, 205)] == ["char_divergence", "char_divergence", "word_divergence", None, None, None]


def test_quality_rules_reject_labelled_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_rules(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality", "reason").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.4 * len(bad)
    assert {r.reason for r in bad} >= {"char_divergence", "word_divergence"}


def test_quality_rules_defined_cases(spark, odd, none):
    assert quality_rules(none).count() == 0
    out = quality_rules(odd)
    assert out.count() == odd.count() and len(out.columns) == len({c.lower() for c in out.columns})
    assert all(not r.kept for r in out.collect() if not (r.text or "").strip())
    few = quality_rules(spark.createDataFrame([(1, "!" * 300 + " a" * 60, "en")], "doc_id long, text string, lang string")).first()
    assert few.char_distance == few.word_distance == 0.0


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def rule_of(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, v, r = max(fits, default=(0, None, None))
    return host, path, r, v


def test_url_filter(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-2, ""), (-3, "no scheme/x"), (-4, "http://"), (-5, "https://A.EXAMPLE.org/es/x?y#z"), (-6, "a://b://c/d"), (-7, "http://x.com#/de/"), (-7, "http://x.com#/de/"), (-8, "http://ünï.com/de/\nx"), (None, "http://example.org/en/12")]
    out = url_filter.url_filter(pages.union(spark.createDataFrame(odd, "page_id long, url string")).withColumn("verdict", F.lit("own")), RULES).collect()
    assert len(out) == pages.count() + len(odd)
    for r in out:
        host, path, rule, verdict = rule_of(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    free = [r for r in out if r.rule is None and r.page_id and r.page_id >= 0]
    bad = [r for r in free if re.search(r"(adult|casino|spam|bets|pills|ads)", r.host)]
    assert sum(r.verdict == "block" for r in bad) >= 0.9 * len(bad)
    assert sum(r.verdict == "block" for r in free) <= len(bad) + 0.05 * len(free)


def test_url_filter_without_examples(spark):
    out = url_filter.url_filter(spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string"), RULES).collect()
    assert {r.verdict for r in out} == {"allow"}
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_markov_models_are_distributions():
    import pandas as pd

    rows = []
    for k in range(url_filter.ORDER + 1):
        for side in ("good", "bad"):
            cells, n = np.unique(np.concatenate([url_filter._cells(t, k) for t in (["abc/de", "abd"] if side == "good" else ["zzz"])]), return_counts=True)
            rows.append(pd.DataFrame({"k": k, "cell": cells, "good": n * (side == "good"), "bad": n * (side == "bad")}))
    counts = pd.concat(rows).groupby(["k", "cell"], as_index=False).sum()
    for side in ("good", "bad"):
        assert np.allclose(url_filter._model(counts, side).sum(1), 1)
    table = url_filter._tables(counts)
    assert table[url_filter._cells("abc", 3)].mean() > 0 > table[url_filter._cells("zzz", 3)].mean()


def markov(texts):
    """Interpolated Witten-Bell by definition: a function of context and symbol."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        s = symbols_of(t)
        for i in range(3, len(s)):
            for k in range(4):
                seen[tuple(s[i - k : i])][s[i]] += 1

    def p(context, x):
        below = p(context[1:], x) if context else 1 / url_filter.SIZE
        own = seen.get(tuple(context))
        return (own[x] + len(own) * below) / (sum(own.values()) + len(own)) if own else below

    return p


def symbols_of(text):
    out = []
    for c in text:
        c = c.lower() if c.isascii() else "?"
        out.append(url_filter.SYMBOLS.index("0" if c.isdigit() else c) if ("0" if c.isdigit() else c) in url_filter.SYMBOLS else url_filter.OTHER)
    return [url_filter.END] * 3 + out + [url_filter.END]


def test_url_filter_matches_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    out = url_filter.url_filter(pages, RULES).withColumn("fold", F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(5))).collect()
    given = {r.page_id: rule_of(r.url)[3] for r in out}
    bad = {r.page_id for r in out if given[r.page_id] == "block" or given[r.page_id] is None and re.search(rf"(^|[.-])({'|'.join(url_filter.REJECTED_TERMS)})([.-]|$)", r.host)}
    models = [markov([r.host + r.path for r in out if r.fold and (r.page_id in bad) == side]) for side in (False, True)]
    ratio = {}
    for r in out:
        s = symbols_of(r.host + r.path)
        ratio[r.page_id] = np.mean([math.log2(models[0](s[i - 3 : i], s[i])) - math.log2(models[1](s[i - 3 : i], s[i])) for i in range(3, len(s))])
        assert abs(ratio[r.page_id] - r.ratio) < 1e-4
    good = sorted(ratio[r.page_id] for r in out if not r.fold and r.page_id not in bad)
    free = [r for r in out if given[r.page_id] is None]
    limit = max((r.ratio for r in free if r.verdict == "block"), default=-99)
    assert all((r.verdict == "allow") == (r.ratio > limit) for r in free) and limit <= 0
    assert sum(x <= limit for x in good) <= 0.01 * len(good) + 1


def test_quality_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = quality_classifier.quality_scores(docs, labels.where(~held)).join(labels, "doc_id").where(held).select("score", "quality").toPandas()
    a, b = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (a[:, None] > b).mean() > 0.95 and ((out.score >= 0.3) == (out.quality == 1)).mean() > 0.9


def statistics_truth(text):
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    share = lambda x, of: math.log(x / max(1, of) + 0.005)
    groups = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#*$%&<>@=_/\\{}[]^~+", "\n")
    out = [math.log1p(len(text)), *(share(sum(c in g for c in text), len(text)) for g in groups), share(sum(ord(c) > 127 for c in text), len(text))]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    out += [math.log1p(sum(map(len, words)) / max(1, len(words))), share(len(set(words)), len(words)), share(len(set(lines)), len(lines)), share(len(set(triples)), max(1, len(words) - 2))]
    return np.array([*out, share(sum(len(w) > 20 for w in words), len(words))])


def test_quality_classifier_matches_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    told = {r.doc_id: r.quality for r in labels.collect()}
    out = quality_classifier.quality_scores(docs, labels).collect()
    x = {r.doc_id: statistics_truth(r.text) for r in out}
    own = [np.array([x[k] for k in sorted(x) if told.get(k) == c]) for c in (0, 1)]
    whole = np.concatenate(own)
    center, scale = whole.mean(0), whole.std(0) + 1e-6
    logs = []
    for rows in own:
        z = (rows - center) / scale
        cov = np.cov(z.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 0.02 * np.eye(len(cov))
        logs.append((z.mean(0), np.linalg.inv(cov), math.log(len(rows) / len(whole)) - np.linalg.slogdet(cov)[1] / 2))
    for r in out:
        z = (x[r.doc_id] - center) / scale
        a, b = (c - (z - m) @ inv @ (z - m) / 2 for m, inv, c in logs)
        assert abs(r.score - 1 / (1 + math.exp(min(500, a - b)))) < 1e-6


def test_quality_classifier_defined_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 1), (10, 0), (8, 0), (4, 0), (None, 1)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality_classifier.quality_scores(odd, labels.limit(0)).collect()} == {1.0}
    assert quality_classifier.quality_scores(none, labels).count() == 0


def test_quadratic_discriminant_is_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(0)
    k = len(quality_classifier.FEATURES)
    x0, x1 = rng.normal(0, 1, (4000, k)), rng.normal(1, 2, (4000, k))
    stack = lambda f: np.array([f(x0), f(x1)])
    m = quality_classifier.Discriminant(np.array([4000.0, 4000.0]), stack(lambda x: x.sum(0)), stack(lambda x: x.T @ x), shrink=0.0, ridge=1e-9)
    t = rng.normal(0.5, 1.5, (50, k))
    logs = [-0.5 * ((t - mu) ** 2).sum(1) / s**2 - k * np.log(s) for mu, s in ((0, 1), (1, 2))]
    assert np.abs(m.score(t) - 1 / (1 + np.exp(logs[0] - logs[1]))).mean() < 0.05


def test_language_models_are_distributions_and_match_brute_force():
    texts = {"aa": ["der hund und die katze", "die katze und der hund und"], "bb": ["the cat and the dog", "a dog and a cat"]}
    counts = {k: language_id._add(np.concatenate([language_id.keys_of(language_id.symbols(t)) for t in ts]), np.ones(sum(len(language_id.keys_of(language_id.symbols(t))) for t in ts))) for k, ts in texts.items()}
    m = language_id.Models.build(counts)
    letters = sorted({c for ts in texts.values() for t in ts for c in t} | {"q"})
    for context in ("   ", "hun", "the", "xyz", "at "):
        keys = []
        for c in letters:
            k = 0
            for x in context + c:
                k = k << 16 | ord(x)
            keys.append(k)
        p = np.exp(m.log_probs(np.array(keys, np.uint64)))
        assert (p > 0).all() and (abs(p.sum(0) - 1) < 0.02).all()

    def kn(lang, gram):
        """Interpolated Kneser-Ney by definition."""
        level = {k: collections.Counter() for k in range(1, 5)}
        for t in texts[lang]:
            s = "  " + "".join(map(chr, language_id.symbols(t)))
            for i in range(len(s) - 3):
                level[4][s[i : i + 4]] += 1
        for k in (3, 2, 1):
            for g in level[k + 1]:
                level[k][g[1:]] += 1
        p = float(np.exp(m.floor[0]))
        for k in range(1, 5):
            g = gram[-k:]
            own = {x: n for x, n in level[k].items() if x[:-1] == g[:-1]}
            if own:
                p = (max(own.get(g, 0) - 0.75, 0) + 0.75 * len(own) * p) / sum(own.values())
        return p

    for gram in ("katz", "  th", " und", "qqqq", "e do"):
        k = 0
        for x in gram:
            k = k << 16 | ord(x)
        got = np.exp(m.log_probs(np.array([k], np.uint64)))[0]
        for j, lang in enumerate(m.langs):
            assert abs(got[j] - kn(lang, gram)) < 1e-5


def test_language_id_held_out_and_defined_cases(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(docs, ~held)
    out = language_id.identify(docs.where(held), model).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out) and all(0 <= r.score <= 1 for r in out)
    out = language_id.identify(odd, model).collect()
    assert len(out) == odd.count()
    for r in out:
        assert (r.lang_pred == "und") == (not language_id.has_letter(r.text))
    assert language_id.train(none, F.lit(True)) is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_language_entropies_go_in_runs_of_characters(monkeypatch):
    texts = ["die katze sitzt", None, "", "the cat sits " * 40, "x", "le chat " * 9]
    counts = {k: language_id._add(language_id.keys_of(language_id.symbols(t)), np.ones(len(language_id.keys_of(language_id.symbols(t))))) for k, t in (("de", texts[0]), ("en", texts[3]), ("fr", texts[5]))}
    m = language_id.Models.build(counts)
    whole, sizes = m.entropies(texts), []
    monkeypatch.setattr(language_id, "CHARS_AT_ONCE", 20)
    monkeypatch.setattr(m, "_entropies", lambda ts: (sizes.append(len(ts)), language_id.Models._entropies(m, ts))[1])
    assert np.allclose(m.entropies(texts), whole) and sum(sizes) == len(texts) and len(sizes) >= 3
    assert m.entropies([]).shape == (0, 3)
