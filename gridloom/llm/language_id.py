"""Language identification by interpolated Kneser-Ney character models.

Each language, whatever their number, has a model of order four over its lower-cased letters (anything else is one
space), learned from a bounded sample: of each language about `sample` documents, those with the smallest hashes, and
of all together about `most` at most. The models share sorted hash arrays, one for each order; behind each n-gram lie
the languages that have it and its share in them, and behind each context the languages' weights of what is shorter. A
text takes the language with the lowest cross-entropy a character. The sharpness of the score and each language's
limit of rejection are calibrated on sampled documents that train nothing; each language trains at least one.

Defined results: a text that is null or has no letter is `und` with score 0 and counts as rejected; without any
language to learn from every text is `und`; ties go to the first language by name; every row gives one row.
Columns of the input stay; a column of the same name as a new one is replaced.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.work import Shelter


ADDED = ("lang_pred", "score", "cross_entropy", "rejected")
ORDER, DISCOUNT, SPACE = 4, 0.75, 32
CHARS_AT_ONCE, ENTRIES_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 1 << 20, 200
_LETTER: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def symbols(text: str | None) -> np.ndarray:
    """Letters as 16-bit codes (those beyond as one code), runs of anything else as one space; starts and ends with a space."""
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(65536)]))
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    far = points > 65534
    codes = np.where(far, 65535, points).astype(np.int64)
    keep = _LETTER[0][codes]
    if far.any():
        keep[far] = [chr(p).isalpha() for p in points[far].tolist()]
    codes = np.where(keep, codes, SPACE)
    codes = np.concatenate([[SPACE], codes, [SPACE]])
    return codes[np.concatenate([[True], (codes[1:] != SPACE) | (codes[:-1] != SPACE)])]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def keys_of(codes: np.ndarray) -> np.ndarray:
    """The packed n-gram of the highest order that ends at each symbol but the first."""
    c = np.concatenate([np.full(ORDER - 2, SPACE), codes]).astype(np.uint64)
    n = len(codes) - 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k : k + n]
    return out


_MASKS = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


def _add(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, back = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(back, weights=n, minlength=len(uniq))


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted array, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return i, table[i] == keys


@dataclass
class Level:
    """Sorted hashes; those of row i have the languages and values from ends[i] to ends[i + 1]."""

    hashes: np.ndarray
    ends: np.ndarray
    langs: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, values: np.ndarray) -> Level:
        h = _mix(keys)
        order = np.lexsort((langs, h))
        hashes, first = np.unique(h[order], return_index=True)
        return cls(hashes, np.append(first, len(h)), langs[order].astype(np.uint32), values[order].astype(np.float32))

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every language that has one of the keys: the key's place, the language and the value."""
        i, hit = _at(self.hashes, _mix(keys))
        rows = np.flatnonzero(hit)
        lo, n = self.ends[i[rows]], self.ends[i[rows] + 1] - self.ends[i[rows]]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(rows, n), self.langs[at], self.values[at]


@dataclass
class Models:
    """langs; for each order the n-grams with their discounted shares, and the contexts with the weights of what is shorter."""

    langs: list[str]
    grams: list[Level | None] = field(default_factory=list)
    contexts: list[Level | None] = field(default_factory=list)
    floor: np.ndarray | None = None
    sharpness: float = 20.0
    limits: np.ndarray | None = None

    @classmethod
    def build(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
        """counts: for each language its n-grams of the highest order (packed) and their counts."""
        m = cls(sorted(counts), [None] * (ORDER + 1), [None] * (ORDER + 1))
        level = [counts[lang] for lang in m.langs]
        for k in range(ORDER, 0, -1):
            grams, contexts = [], []
            for j, (keys, n) in enumerate(level):
                own, total = _add(keys >> np.uint64(16), n)
                _, types = _add(keys >> np.uint64(16), np.ones(len(keys)))
                grams.append((keys, np.full(len(keys), j), (n - DISCOUNT) / total[np.searchsorted(own, keys >> np.uint64(16))]))
                contexts.append((own, np.full(len(own), j), DISCOUNT * types / total))
            m.grams[k], m.contexts[k] = (Level.of(*map(np.concatenate, zip(*x, strict=True))) for x in (grams, contexts))
            if k > 1:  # below the highest order, an n-gram counts the distinct symbols before it
                level = [_add(keys & _MASKS[k - 1], np.ones(len(keys))) for keys, _ in level]
        symbols_ = max(2, len(m.grams[1].hashes) + 1)
        m.floor = np.full(len(m.langs), -np.log(symbols_), np.float32)
        return m

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        """Natural log probability of the last symbol of each packed n-gram under each language."""
        p = np.tile(np.exp(self.floor), (len(keys), 1)).astype(np.float32)
        for k in range(1, ORDER + 1):
            own = keys & _MASKS[k]
            for level, of, change in ((self.contexts[k], own >> np.uint64(16), np.multiply), (self.grams[k], own, np.add)):
                uniq, back = np.unique(of, return_inverse=True) if k < ORDER else (of, None)
                row, lang, value = level.entries(uniq)
                if back is None:
                    p[row, lang] = change(p[row, lang], value)
                    continue
                whole = np.full((len(uniq), len(self.langs)), 1.0 if change is np.multiply else 0.0, np.float32)
                whole[row, lang] = value
                change(p, whole[back], out=p)
        return np.log(p)

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Cross-entropy a symbol of each text under each language. Texts go in runs of about CHARS_AT_ONCE characters, so that memory does not follow a batch's size."""
        ends = np.cumsum([len(t or "") for t in texts])
        cuts = np.flatnonzero(np.diff(ends // CHARS_AT_ONCE, append=-1)) + 1
        out, a = np.zeros((len(texts), len(self.langs))), 0
        for b in cuts.tolist():
            out[a:b] = self._entropies(texts[a:b])
            a = b
        return out

    def _entropies(self, texts: list[str | None]) -> np.ndarray:
        grams = [keys_of(symbols(t)) for t in texts]
        sizes = np.array([len(g) for g in grams], np.int64)
        keys, text = np.concatenate([np.zeros(0, np.uint64), *grams]), np.repeat(np.arange(len(texts)), sizes)
        del grams
        out, width = np.zeros((len(texts), len(self.langs))), max(1024, ENTRIES_AT_ONCE // max(1, len(self.langs)))
        for a in range(0, len(keys), width):
            uniq, back = np.unique(keys[a : a + width], return_inverse=True)
            own = text[a : a + width]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[first]] -= np.add.reduceat(self.log_probs(uniq)[back], first, axis=0, dtype=float)
        return out / np.maximum(1, sizes)[:, None]


def train(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1000, most: int = 200_000) -> Models | None:
    """Models of the rows where `training` holds; a fifth of the sample calibrates them."""
    spark = docs.sparkSession
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / (1 << 30)
    own = docs.where(training & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), u.alias("u"), F.pmod(F.xxhash64(F.lit("held"), F.col(key)), F.lit(5)).alias("fold"))
    counts = {r["lang"]: (r["n"], r["least"]) for r in own.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()}
    if not counts:
        return None
    sample = max(1, min(sample, most // len(counts)))
    known = spark.sparkContext.broadcast({name: (max(least, min(1.0, 1.25 * sample / n)), least) for name, (n, least) in counts.items()})

    @F.pandas_udf("int")
    def role(names: pd.Series, us: pd.Series, folds: pd.Series) -> pd.Series:
        """0: not in the sample, 1: trains, 2: calibrates; the first of each language trains."""
        share, least = (np.array([known.value[x][i] for x in names], float) for i in range(2))
        return pd.Series(np.where(us > share, 0, np.where((folds == 0) & (us > least), 2, 1)).astype(np.int32))

    chosen = own.withColumn("role", role("lang", "u", "fold"))

    def count(batches):
        total: dict[str, list] = {}
        for pdf in batches:
            for name, rows in pdf.groupby("lang"):
                own = [t for t in rows["text"] if has_letter(t)]
                for a in range(0, len(own), TEXTS_AT_ONCE):
                    total.setdefault(name, []).append(np.unique(np.concatenate([keys_of(symbols(t)) for t in own[a : a + TEXTS_AT_ONCE]]), return_counts=True))
        for name, parts in total.items():
            keys, n = _add(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(float))
            yield pd.DataFrame({"lang": name, "gram": keys.view(np.int64), "n": n.astype(np.int64)})

    rows = chosen.where("role = 1").select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    tables = {name: _add(g["gram"].to_numpy(np.int64).view(np.uint64), g["n"].to_numpy(float)) for name, g in rows.groupby("lang")}
    m = Models.build(tables)
    held = spark.sparkContext.broadcast(m)
    grid = [2.0 * 1.6**i for i in range(12)]

    def calibrate(batches):
        model = held.value
        place = {name: i for i, name in enumerate(model.langs)}
        for pdf in batches:
            pdf = pdf[[has_letter(t) and n in place for t, n in zip(pdf["text"], pdf["lang"], strict=True)]]
            if not len(pdf):
                continue
            h = model.entropies(pdf["text"].tolist())
            true = np.array([place[n] for n in pdf["lang"]])
            own_ = h[np.arange(len(h)), true]
            z = {f"g{i}": own_ * g + np.log(np.exp(-(h - h.min(1, keepdims=True)) * g).sum(1)) - h.min(1) * g for i, g in enumerate(grid)}
            yield pd.DataFrame({"lang": pdf["lang"].to_numpy(), "h": own_} | z)

    scored = chosen.where("role = 2").select("lang", "text").mapInPandas(calibrate, "lang string, h double, " + ", ".join(f"g{i} double" for i in range(len(grid))))
    stats = scored.groupBy("lang").agg(F.count("*").alias("n"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(grid))]).collect()
    m.limits = np.full(len(m.langs), -float(m.floor.min()))
    for r in stats:
        m.limits[m.langs.index(r["lang"])] = r["mean"] + 6 * (r["sd"] or 0.0) + 0.1
    if stats:
        losses = [sum(r[f"g{i}"] for r in stats) for i in range(len(grid))]
        m.sharpness = grid[int(np.argmin(losses))]
    return m


def identify(docs: DataFrame, m: Models | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (posterior of the language), cross_entropy and rejected."""
    inside = Shelter(docs)
    held = docs.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        model = held.value
        known = np.array([has_letter(t) for t in texts], bool)
        out = pd.DataFrame({"lang_pred": np.full(len(texts), "und", object), "score": 0.0, "cross_entropy": 0.0, "rejected": True})
        if model is not None and known.any():
            h = model.entropies([t for t, k in zip(texts, known, strict=True) if k])
            best = h.argmin(1)
            low = h[np.arange(len(h)), best]
            out.loc[known, "lang_pred"] = np.array(model.langs, object)[best]
            out.loc[known, "score"] = 1 / np.exp(-(h - low[:, None]) * model.sharpness).sum(1)
            out.loc[known, "cross_entropy"] = low
            out.loc[known, "rejected"] = low > model.limits[best]
        return out

    return inside.restored(inside.df.withColumn("judged", judge(F.col(inside.name(text)))), ["judged.*"], ADDED)
