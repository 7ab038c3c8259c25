"""Quality rules by distribution divergence, in DataFrame functions only.

Each language found in `lang` has two references, pooled over its documents that pass the base rules: the histogram
of character classes, and that of its COMMON most frequent words with one more cell for all other words. A document
is held against them by the Jensen-Shannon distance and rejected when it is long enough to judge and far from every
language: first against its own language (`lang`), and only if that is too far, against the nearest of all. So a
text without common words is as odd as one with the wrong ones. A language needs MIN_REFERENCE words for a reference.

Defined results: null and empty texts have no words, fail the base rules and are not kept; a text below the
length guards passes the divergence rules; without any reference (empty table, or no language with enough words)
nothing is rejected by divergence and the distances are 0; a document without a language of its own, or whose
language has no reference, is held against the nearest; a text without a letter is at distance 1 of all words.
Every input row gives one output row, repeated rows included. Columns of the input stay; a column of the same name as
a new one is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.work import Shelter, numbered, scratch

CLASSES = ("vowel", "consonant", "upper", "accented", "digit", "point", "symbol")
COMMON, MIN_REFERENCE = 40, 1000
SPACE = r"[ \t-\r]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*COUNTS, "n_common", "char_distance", "word_distance", "base_failed", "kept", "reason")


@dataclass(frozen=True)
class Rules:
    """Base limits, and the divergence limits with their length guards.

    The limits lie above the distances of all documents that are labelled good (at most 0.234 and 0.322 of 3243)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    char_distance: float = 0.25
    min_chars: int = 200
    word_distance: float = 0.34
    min_letter_words: int = 100


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(df: DataFrame, **new: Column) -> DataFrame:
    """Adds columns through a generator, so that the optimizer does not copy their expressions into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in new.items()]))))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words which the text holds twice or more."""

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p) - 1),
            F.lit(0).cast("long"),
            lambda s, k: s + F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(3))).cast("long"),
        )

    def starts(z: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(z, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(z, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))

    def count(h: Column) -> Column:
        numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            _let(F.sort_array(numbered), lambda z: _let(starts(z), covered))
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def _letter_words(text: Column) -> Column:
    """The lower-cased runs of letters, after one empty string or more."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")


def _char_counts(text: Column, bare: Column) -> Column:
    """Counts by CLASSES. Each class is what a text without white space loses when the class is taken out."""
    steps = ("[aeiou]+", "[b-df-hj-np-tv-z]+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", "[.,;:!?'\"()\\-]+")

    def taken(left: Column, rest: Sequence[str], counts: list[Column]) -> Column:
        if not rest:
            return F.array(*counts, F.length(left).cast("long"))
        return _let(F.regexp_replace(left, rest[0], ""), lambda x: taken(x, rest[1:], [*counts, (F.length(left) - F.length(x)).cast("long")]))

    return taken(bare, steps, [])


def measured(docs: DataFrame, text: str, rules: Rules) -> DataFrame:
    """Adds the base counts, base (why the base rules reject it, or null) and chars (counts by CLASSES)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    df = _once(docs, ws=words_of(F.col(text)), ls=lines, bare=F.regexp_replace(t, SPACE, ""))
    df = _once(
        df, n_words=F.size("ws").cast("long"), word_chars=F.length("bare").cast("long"),
        n_symbols=(F.length("bare") - F.length(F.regexp_replace("bare", r"[#*$%&|<>]+", ""))).cast("long"),
        n_dup_lines=(F.size("ls") - F.size(F.array_distinct("ls"))).cast("long"), n_repeat_words=repeated_words(F.col("ws")), chars=_char_counts(t, F.col("bare")),
    )
    repeats = F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    base = F.when(F.col("n_words") < rules.min_words, "few_words").when(repeats, "repeats")
    return df.select(*docs.columns, *COUNTS, "chars", base.alias("base"))


@dataclass(frozen=True)
class References:
    """Of each language: shares of the character classes, shares of its common words, and that of all other words."""

    langs: list[str]
    chars: list[list[float]]
    words: list[dict[str, float]]
    others: list[float]

    def every(self) -> Column:
        """All of them as one constant, which the optimizer reads once; it grows with the number of languages."""
        rows = [{"chars": c, "words": w, "other": x} for c, w, x in zip(self.chars, self.words, self.others, strict=True)]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<chars:array<double>,words:map<string,double>,other:double>>")


def references(rows: DataFrame, text: str, lang: str) -> References:
    """The references of measured rows; bounded by languages times classes and common words."""
    clean = rows.where(F.col("base").isNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), "chars")
    with scratch(rows.sparkSession, "references") as tmp:
        words = clean.select("lang", F.explode(_letter_words(F.col("text"))).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
        words = tmp.staged(words, "words")
        totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_REFERENCE).collect()}
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))  # limited in each task before it is sorted as a whole
        top = [r for r in words.withColumn("r", rank).where(F.col("r") <= COMMON).collect() if r["lang"] in totals]
        sums = clean.groupBy("lang").agg(F.array(*[F.sum(F.get("chars", F.lit(i))) for i in range(len(CLASSES))]).alias("chars")).collect()
    chars, langs = {r["lang"]: r["chars"] for r in sums}, sorted(totals)
    own: dict[str, dict[str, float]] = {x: {} for x in langs}
    for r in sorted(top, key=lambda r: r["w"]):
        own[r["lang"]][r["w"]] = r["n"] / totals[r["lang"]]
    shares = [own[x] for x in langs]
    return References(langs, [[n / sum(chars[x]) for n in chars[x]] for x in langs], shares, [1 - sum(q.values()) for q in shares])


def _step(p: Column, q: Column) -> Column:
    """What a cell with shares p and q adds to twice the divergence in bits, beside q."""
    return F.when((p > 0) & (q > 0), p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - q).when(p > 0, p).otherwise(0.0)


def _distance(counts: Column, total: Column, reference: Column, words: Column | None = None, other: Column | None = None) -> Column:
    """Jensen-Shannon distance of counts to a reference. With `words` the counts are those of these words, the reference is
    a map, and what is not in it is one more cell, whose share in the reference is `other`.

    A cell that only the reference has adds half its share to the divergence (in bits): so the sum starts at one half
    and each cell with counts adds what it differs from that.
    """
    rest = F.lit(0.0)
    share = (lambda q: q) if words is None else (lambda w: F.coalesce(F.try_element_at(reference, w), rest))
    cells = F.zip_with(counts, reference if words is None else words, lambda n, k: F.struct((n / total).alias("p"), share(k).alias("q")))

    def of(cells: Column) -> Column:
        if other is None:
            return F.aggregate(cells, F.lit(1.0), lambda s, x: s + _step(x["p"], x["q"]))
        start = F.struct(F.lit(1.0).alias("s"), F.lit(1.0).alias("rest"))
        known = lambda x: x["q"] > 0
        added = F.aggregate(cells, start, lambda s, x: F.struct(F.when(known(x), s["s"] + _step(x["p"], x["q"])).otherwise(s["s"]).alias("s"), F.when(known(x), s["rest"] - x["p"]).otherwise(s["rest"]).alias("rest")))
        return _let(added, lambda s: s["s"] + _step(F.greatest(rest, s["rest"]), other))

    return F.sqrt(F.greatest(F.lit(0.0), of(cells) / 2))


def quality_rules(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", columns: Sequence[str] | None = None) -> DataFrame:
    """`docs` (of these columns, or all) with the base counts, the distances, the verdict `kept` and its `reason`."""
    inside = Shelter(docs)
    t, own_lang, wanted = inside.name(text), inside.name(lang), inside.wanted(columns)
    needed = inside.df.select(*dict.fromkeys([*wanted, t, own_lang]))
    rows = numbered(measured(needed, t, rules), "measured")
    refs = references(rows, t, own_lang)
    out = rows.withColumns({"base_failed": F.col("base").isNotNull(), "n_common": F.lit(0).cast("long"), "char_distance": F.lit(0.0), "word_distance": F.lit(0.0), "odd": F.lit(None).cast("string")})
    if refs.langs:
        vocabulary = ", ".join(f"'{w}'" for w in sorted(set().union(*refs.words)))  # letters only
        common_words = F.sort_array(F.expr(f"filter(lw, w -> w IN ({vocabulary}))"))

        def starts(s: Column) -> Column:
            """Where a run of equal words begins in a sorted array."""
            return F.filter(F.transform(s, lambda x, k: F.when(F.coalesce(F.get(s, k - 1), F.lit("")) != x, k)), lambda k: k.isNotNull())

        def counted(s: Column) -> Column:
            return _let(starts(s), lambda at: F.struct(
                F.transform(at, lambda k: F.get(s, k)).alias("word"),
                F.transform(at, lambda k, j: F.coalesce(F.get(at, j + 1), F.size(s)) - k).alias("count"),
            ))

        every = refs.every()
        at =F.array_position(F.array(*map(F.lit, refs.langs)), F.col(own_lang).cast("string"))
        mine = F.when(at > 0, F.get(every, (at - 1).cast("int")))
        df = _once(rows, lw=F.array_remove(_letter_words(F.col(t)), ""))
        df = _once(df, n_letter_words=F.size("lw"), found=_let(common_words, counted), mine=mine)
        chars = lambda r: _distance(F.col("chars"), F.col("word_chars"), r["chars"])
        words = lambda r: _distance(F.col("found.count"), F.col("n_letter_words"), r["words"], F.col("found.word"), r["other"])

        def judged(own: Column, limit: float, of) -> Column:
            """The distance to the own language if that is within the limit, else to the nearest of all."""
            near = _let(F.when(own.isNotNull(), of(own)), lambda x: F.when(x <= limit, x).otherwise(F.array_min(F.transform(every, of))))
            return near

        df = _once(df, **{
            "char_distance": F.when(F.col("word_chars") > 0, judged(F.col("mine"), rules.char_distance, chars)).otherwise(1.0),
            "word_distance": F.when(F.col("n_letter_words") > 0, judged(F.col("mine"), rules.word_distance, words)).otherwise(1.0),
        })
        odd_chars = (F.col("word_chars") >= rules.min_chars) & (F.col("char_distance") > rules.char_distance)
        odd_words = (F.col("n_letter_words") >= rules.min_letter_words) & (F.col("word_distance") > rules.word_distance)
        common = F.aggregate("found.count", F.lit(0).cast("long"), lambda s, x: s + x)
        out = df.withColumns({"base_failed": F.col("base").isNotNull(), "n_common": common, "odd": F.when(odd_chars, "char_divergence").when(odd_words, "word_divergence")})
    out = out.withColumn("reason", F.coalesce("base", "odd")).withColumn("kept", F.col("reason").isNull())
    return inside.restored(out.select(*wanted, *ADDED), ADDED, ADDED)
