"""Language-model scoring with an n-gram trie in Elias-Fano levels.

The model is a bigram model by interpolated absolute discounting over an add-one unigram model. Its trie is dealt
into shards. In a shard, the contexts (first words) and the pointers to their runs of successors are monotone
Elias-Fano sequences; the successors of a context are stored relative to the end of the run before it, which makes
the whole level monotone, so that it is an Elias-Fano sequence too. A successor is found by computing its
context-relative value and searching the few elements that share its high part. Beside each successor stands its
discounted probability, quantised to 16 bits in log10. All levels are files in the shared folder; they grow with the
text, nothing is pruned.

Texts become chunks of about TOKENS_AT_ONCE tokens. A chunk sends its distinct words to their word shards and its
distinct bigrams to their trie shards; a shard adds up what the training texts have, writes its level, and answers
each chunk from it. So a task maps one shard's file, whatever the size of the model, and each is read by one task.
Shards are as many as the tokens ask for; a frequent context is dealt over several by its second words.

Words are known by 64-bit hashes (two words that share one count as one word; at a billion words that is to be
expected for a few hundredths of a pair). Word ids have 40 bits, which is checked.

Defined results: a null text is an empty text, whose only token is the end; with no training token every word is
unknown and all scores are 0; every row gives one row, repeated rows included. Columns of the input stay; a column
of the same name as a new one is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import files
from gridloom.llm.work import Shelter, fresh_dir, numbered, scratch, staged

ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
START, STEPS, ABSENT, FLOOR = 1, 65534, 65535, -14.0
END = xxhash.xxh3_64_intdigest(b"")
TOKENS_AT_ONCE, TOKENS_IN_SHARD = 1_000_000, 2_000_000
ID_BITS = 40
DISCOUNT = 0.75


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word."""
    place, k = np.zeros(len(word), np.int64), k.astype(np.int64).copy()
    for width in (32, 16, 8, 4, 2, 1):
        low = word & np.uint64((1 << width) - 1)
        n = np.bitwise_count(low).astype(np.int64)
        up = k >= n
        k -= np.where(up, n, 0)
        place += np.where(up, width, 0)
        word = np.where(up, word >> np.uint64(width), low)
    return place


class EliasFano:
    """A nondecreasing sequence of n integers in about 2 + log2(u / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks
        self.zeros = np.arange(len(ranks), dtype=np.int64) * 512 - ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        spots = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (n + (top >> bits) + 2 + 511) // 512 * 512
        flags = np.zeros(size, np.uint8)
        flags[spots] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(high).reshape(-1, 8).sum(1, dtype=np.int64))])
        return cls(n, bits, low, high, ranks)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        table = self.ranks if ones else self.zeros
        block = np.searchsorted(table, k, side="right") - 1
        words = self.high[(block * 8)[:, None] + np.arange(8)]
        if not ones:
            words = ~words
        counts = np.cumsum(np.bitwise_count(words).astype(np.int64), axis=1)
        left = k - table[block]
        j = (counts <= left[:, None]).sum(1)
        rows = np.arange(len(k))
        left = left - np.where(j > 0, counts[rows, np.maximum(j - 1, 0)], 0)
        return block * 512 + j * 64 + _select_in_word(words[rows, j], left)

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        up = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | up) & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place of each value, or -1."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(h < self.zeros[-1] - 1)
        h, want = h[inside], x[inside] & np.uint64((1 << self.low_bits) - 1)
        first = np.zeros(len(h), np.int64)
        up = h > 0
        first[up] = self._select(h[up] - 1, False) - h[up] + 1
        last = np.minimum(self._select(h, False) - h, self.n)
        lo, hi = first, last.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        hit = np.flatnonzero(lo < last)
        hit = hit[self._lows(lo[hit]) == want[hit]]
        out[inside[hit]] = lo[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.head": np.array([self.n, self.low_bits], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ranks": self.ranks}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, bits = map(int, arrays[f"{name}.head"])
        return cls(n, bits, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ranks"])


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of plain arrays: a header line by names, types, lengths and places, then the arrays, aligned."""
    head, at, body = [], 0, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append(f"{k} {a.dtype.str} {len(a)} {at}")
        raw += b"\0" * (-len(raw) % 64)
        body.append(raw)
        at += len(raw)
    text = "\n".join(head).encode()
    with files.writing(uri) as out:
        out.write(np.array([len(text), 0], np.int64).tobytes() + text + b"\0" * (-(len(text) + 16) % 64))
        for raw in body:
            out.write(raw)


def _load(uri: str) -> dict[str, np.ndarray]:
    """Views on the mapped file."""
    f = files.reading(uri)
    data = f.read_buffer()
    size = int(np.frombuffer(data, np.int64, 1)[0])
    base = -(-(size + 16) // 64) * 64
    lines = bytes(data[16 : 16 + size]).decode().split("\n")
    return {k: np.frombuffer(data, np.dtype(kind), int(n), base + int(at)) for k, kind, n, at in map(str.split, lines)}


@dataclass(frozen=True)
class Model:
    """Where the levels are: `words` files by the top bits of the hash, `shards` files of the trie; sizes: the types of each word file."""

    path: str
    bits: int
    shards: int
    spread: int
    tokens: int = 0
    docs: int = 0
    sizes: tuple[int, ...] = ()

    @property
    def types(self) -> int:
        return sum(self.sizes)

    def bases(self) -> np.ndarray:
        """The first word id of each word file; ids start at 2."""
        return np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)]) + 2


def hashes_of(text: str | None) -> np.ndarray:
    """Hashes of the tokens: A-Z lower-cased words between x20 and x09 to x0D, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order], first)


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers by byte planes, compressed; rising ones as differences."""
    import zstandard

    v = np.ascontiguousarray(values).astype(np.uint64)
    if rising:
        v = np.diff(v, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes, rising: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    v = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if rising else v


CHUNK = "chunk long, n long, rows binary, lengths binary, teaches binary, words binary, tokens binary"


def _chunks(docs: DataFrame) -> DataFrame:
    """Chunks of the texts of rows with row, text and teaches: their distinct words' hashes, and each token's place among them."""

    def cut(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        rows, teaches, tokens, size = [], [], [], 0

        def flush():
            words, at = np.unique(np.concatenate(tokens), return_inverse=True)
            lengths = np.array([len(t) for t in tokens], np.int64)
            one = (base + number, len(at), _packed(np.array(rows)), _packed(lengths), np.array(teaches, np.uint8).tobytes(), _packed(words, True), _packed(at))
            return pd.DataFrame([one], columns=[c.split()[0] for c in CHUNK.split(", ")])

        for pdf in batches:
            for row, text, teach in zip(pdf["row"], pdf["text"], pdf["teaches"], strict=True):
                rows.append(row)
                teaches.append(bool(teach))
                tokens.append(hashes_of(text))
                size += len(tokens[-1])
                if size >= TOKENS_AT_ONCE:
                    yield flush()
                    rows, teaches, tokens, size, number = [], [], [], 0, number + 1
        if rows:
            yield flush()

    return docs.mapInPandas(cut, CHUNK)


def _shard_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """value, start and end of each run of equal neighbours."""
    if not len(values):
        return []
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return list(zip(values[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(values)], strict=True))


class Chunk:
    """A chunk's tokens, its words with what their shards answered, and its distinct bigrams."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame, m: Model):
        self.rows, self.lengths = _unpacked(row["rows"]).astype(np.int64), _unpacked(row["lengths"]).astype(np.int64)
        self.teaches = np.frombuffer(row["teaches"], np.uint8).astype(bool)
        words, self.tokens = _unpacked(row["words"], True), _unpacked(row["tokens"]).astype(np.int64)
        n, base = len(words), m.bases()
        self.ids, self.counts, self.types = (np.zeros(n + 1, np.int64) for _ in range(3))  # the last place is the start's
        spots = {s: (a, b) for s, a, b in _runs(_shard_of(words, m.bits))}
        for r in answers[answers["idx"].notna()].itertuples(index=False):
            a, b = spots[r.shard]
            idx = _unpacked(r.idx).astype(np.int64)
            self.ids[a:b] = np.where(idx > 0, base[r.shard] + idx - 1, 0)
            self.counts[a:b] = _unpacked(r.counts)
            if r.types is not None:
                self.types[a:b] = _unpacked(r.types)
        self.ids[n], self.counts[n] = START, m.tokens  # the start is dealt as the most frequent context
        first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        before = np.concatenate([[n], self.tokens[:-1]])
        before[first] = n
        key, self.which = np.unique((before << 32) | self.tokens, return_inverse=True)
        self.context, self.word = key >> 32, key & 0xFFFFFFFF
        known = np.flatnonzero((self.ids[self.context] > 0) & (self.ids[self.word] > 0))
        shard = self._deal(m, known)
        order = np.argsort(shard, kind="stable")
        self.known, self.dealt = known[order], _runs(shard[order])

    def _deal(self, m: Model, pairs: np.ndarray) -> np.ndarray:
        """The shard of each bigram: by its context, and for frequent contexts also by its word."""
        mix, context = np.uint64(0x9E3779B97F4A7C15), self.context[pairs]
        with np.errstate(over="ignore"):
            c = (self.ids[context].astype(np.uint64) * mix) >> np.uint64(33)
            w = (self.ids[self.word[pairs]].astype(np.uint64) * mix) >> np.uint64(33)
        ways = np.minimum(1 + self.counts[context] // m.spread, m.shards).astype(np.uint64)
        return ((c + w % ways) % np.uint64(m.shards)).astype(np.int32)


def _deal_words(chunks: DataFrame, bits: int) -> DataFrame:
    """shard, chunk, words and their counts in the training texts."""

    def deal(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words, tokens = _unpacked(r.words, True), _unpacked(r.tokens).astype(np.int64)
                teaches = np.repeat(np.frombuffer(r.teaches, np.uint8).astype(bool), _unpacked(r.lengths).astype(np.int64))
                n = np.bincount(tokens[teaches], minlength=len(words))
                out = [(s, r.chunk, _packed(words[a:b], True), _packed(n[a:b])) for s, a, b in _runs(_shard_of(words, bits))]
                yield pd.DataFrame(out, columns=["shard", "chunk", "words", "n"])

    return chunks.select("chunk", "lengths", "teaches", "words", "tokens").mapInPandas(deal, "shard long, chunk long, words binary, n binary")


ANSWER = "shard long, chunk long, idx binary, counts binary, types binary, codes binary"
_ANSWER = [c.split()[0] for c in ANSWER.split(", ")]


def _word_level(path: str):
    """Writes a word shard's hashes and counts and answers its chunks: places (from 1; 0: unknown) and counts. Its own figures have no chunk."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, asked = int(pdf["shard"].iloc[0]), [_unpacked(w, True) for w in pdf["words"]]
        keys, n = _sums(np.concatenate(asked), np.concatenate([_unpacked(x).astype(np.int64) for x in pdf["n"]]))
        hashes, counts = keys[n > 0], n[n > 0]
        _save(f"{path}/words-{shard}", {"hashes": hashes, "counts": counts})
        level = _load(f"{path}/words-{shard}")
        out = [(shard, None, None, _packed(np.array([len(hashes), counts.sum(), counts[hashes == np.uint64(END)].sum()])), None, None)]
        for chunk, words in zip(pdf["chunk"], asked, strict=True):
            k = np.minimum(np.searchsorted(level["hashes"], words), max(0, len(hashes) - 1))
            hit = level["hashes"][k] == words if len(hashes) else np.zeros(len(words), bool)
            out.append((shard, chunk, _packed(np.where(hit, k + 1, 0)), _packed(np.where(hit, level["counts"][k] if len(hashes) else 0, 0)), None, None))
        return pd.DataFrame(out, columns=_ANSWER).astype({"chunk": "Int64"})

    return write


def _deal_bigrams(m: Model):
    """The distinct bigrams of a chunk by shard: contexts with run lengths and counts, words, and the bigrams' counts in the training texts."""

    def deal(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(chunk):
            row = chunk.iloc[0]
            c = Chunk(row, answers, m)
            n = np.bincount(c.which[np.repeat(c.teaches, c.lengths)], minlength=len(c.context))
            for s, a, b in c.dealt:
                own = c.known[a:b]
                runs = _runs(c.context[own])
                context, size = np.array([r[0] for r in runs]), np.array([r[2] - r[1] for r in runs])
                total = np.where(c.ids[context] == START, m.docs, c.counts[context])
                out.append((s, row["chunk"], _packed(c.ids[context]), _packed(size), _packed(total), _packed(c.ids[c.word[own]]), _packed(n[own])))
        return pd.DataFrame(out, columns=["shard", "chunk", "contexts", "runs", "totals", "words", "n"])

    return deal


def _level(context: np.ndarray, total: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The trie's levels over bigrams with counts, the contexts and their numbers of successors."""
    own, at = np.unique(context, return_inverse=True)
    if len(own) >= 1 << (64 - ID_BITS) or (len(word) and int(word.max()) >= 1 << ID_BITS):
        raise ValueError(f"a shard of over 2^{64 - ID_BITS} contexts, or a word id of over {ID_BITS} bits")
    totals = np.zeros(len(own), np.int64)
    totals[at] = total
    key, n = _sums((at.astype(np.uint64) << np.uint64(ID_BITS)) | word.astype(np.uint64), n)
    at, word = (key >> np.uint64(ID_BITS)).astype(np.int64), (key & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    run = np.diff(np.append(first, len(at)))
    last = word[first + run - 1] + 1
    base = np.concatenate([[0], np.cumsum(last)[:-1]]).astype(np.int64)
    p = np.maximum(n - DISCOUNT, 1e-300) / np.maximum(totals[at], 1)
    step = np.clip(np.rint(np.log10(p) / FLOOR * STEPS), 0, STEPS).astype(np.uint16)
    levels = EliasFano.build(own).arrays("contexts") | EliasFano.build(np.append(first, len(at))).arrays("pointers")
    return levels | EliasFano.build(np.repeat(base[: len(run)], run) + word + 1).arrays("successors") | {"log10": step}, own, run


def _find(levels: dict[str, np.ndarray], contexts: np.ndarray, runs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The stored step of each bigram, ABSENT if the trie does not have it."""
    ctx, pointers, successors = (EliasFano.of(levels, name) for name in ("contexts", "pointers", "successors"))
    at = ctx.find(contexts.astype(np.uint64))
    there = at >= 0
    lo, hi, base = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64)
    lo[there] = pointers.get(at[there]).astype(np.int64)
    hi[there] = pointers.get(at[there] + 1).astype(np.int64)
    led = there & (lo > 0)
    base[led] = successors.get(lo[led] - 1)
    i = successors.find(np.repeat(base, runs) + words.astype(np.uint64) + np.uint64(1))
    hit = np.repeat(there, runs) & (i >= np.repeat(lo, runs)) & (i < np.repeat(hi, runs))
    out = np.full(len(words), ABSENT, np.int64)
    out[hit] = levels["log10"][i[hit]]
    return out


def _trie_level(m: Model):
    """Writes a shard of the trie and answers its chunks from it; the contexts' numbers of successors go to their word shards, without a chunk."""
    edges = m.bases()

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        asked = [tuple(_unpacked(x).astype(np.int64) for x in r) for r in pdf[["contexts", "runs", "totals", "words", "n"]].itertuples(index=False)]
        taught = [(np.repeat(c, r)[k], np.repeat(t, r)[k], w[k], n[k]) for c, r, t, w, n in asked for k in [n > 0]]
        levels, own, run = _level(*[np.concatenate(x) for x in zip(*taught, strict=True)])
        _save(f"{m.path}/trie-{shard}", levels)
        levels = _load(f"{m.path}/trie-{shard}")
        out = []
        for s, a, b in _runs(np.searchsorted(edges, own, side="right") - 1):  # shard -1: the start
            out.append((s, None, _packed(own[a:b] - (edges[s] if s >= 0 else START)), None, _packed(run[a:b]), None))
        for chunk, (c, r, _, w, _) in zip(pdf["chunk"], asked, strict=True):
            out.append((shard, chunk, None, None, None, _packed(_find(levels, c, r, w))))
        return pd.DataFrame(out, columns=_ANSWER).astype({"chunk": "Int64"})

    return write


def _type_level(m: Model):
    """Writes the numbers of successors of a word shard's words and adds them to what its chunks were answered."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        level = np.zeros(m.sizes[shard] + 1, np.int64)  # the place before the first is the unknown word's
        for r in pdf[pdf["chunk"].isna()].itertuples(index=False):
            level[_unpacked(r.idx).astype(np.int64) + 1] += _unpacked(r.types).astype(np.int64)
        _save(f"{m.path}/weights-{shard}", {"types": level[1:]})
        out = pdf[pdf["chunk"].notna()].copy()
        out["types"] = [_packed(level[_unpacked(x).astype(np.int64)]) for x in out["idx"]]
        return out[_ANSWER].astype({"chunk": "Int64"})

    return write


def _score(m: Model, starts: int):
    """row, n_tokens, n_known, base_score and score of the texts of a chunk."""

    def score(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["row", "n_tokens", "n_known", "base_score", "score"]
        if not len(chunk):
            return pd.DataFrame([], columns=columns)
        c = Chunk(chunk.iloc[0], answers, m)
        uni = (c.counts[c.word] + 1) / (m.tokens + m.types + 1)
        start = c.ids[c.context] == START
        total, types = np.where(start, m.docs, c.counts[c.context]), np.where(start, starts, c.types[c.context])
        left = np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0)
        codes, found = np.full(len(c.context), ABSENT, np.int64), answers[answers["codes"].notna()].set_index("shard")["codes"]
        for s, a, b in c.dealt:
            codes[c.known[a:b]] = _unpacked(found[s])
        p = np.where(codes == ABSENT, 0.0, 10.0 ** (codes / STEPS * FLOOR)) + left * uni
        first = np.concatenate([[0], np.cumsum(c.lengths)[:-1]])
        add = lambda x: np.add.reduceat(x[c.which], first)
        known = add((c.counts[c.word] > 0).astype(np.int64))
        return pd.DataFrame(dict(zip(columns, (c.rows, c.lengths, known, add(np.log10(uni)), add(np.log10(p))), strict=True)))

    return score


def lm_scores(docs: DataFrame, training: Column, text: str = "text", path: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """`docs` (of these columns, or all) with n_tokens, n_known, train_tokens, base_score and score; the model learns where `training` holds and stays in `path`."""
    spark, own = docs.sparkSession, Shelter(docs)
    path, wanted, t = path or fresh_dir(spark, "lm"), own.wanted(columns), own.name(text)
    teaches = docs.select("*", F.coalesce(training, F.lit(False)).alias("teaches")).toDF(*own.df.columns, "teaches")
    with scratch(spark, "lm") as tmp:
        place = tmp.place("rows")
        rows = numbered(teaches.select(*dict.fromkeys([*wanted, t]), "teaches"), "lm-rows", None if t in wanted else place)
        chunks = tmp.staged(_chunks(rows.select("row", F.col(t).alias("text"), "teaches")), "chunks")
        if t not in wanted:  # the texts are not needed any more
            rows = staged(rows.select(*wanted, "row"), "lm-rows")
            files.remove(place)
        size = chunks.agg(F.sum("n")).first()[0] or 0
        shards = max(1, size // TOKENS_IN_SHARD)
        m = Model(path, math.ceil(math.log2(max(1, size // (4 * TOKENS_IN_SHARD)))), shards, max(1, size // shards // 8))
        many = max(1, size // TOKENS_IN_SHARD)  # tasks grow with the text, not what each of them reads
        words = tmp.staged(_deal_words(chunks, m.bits).repartition(1 << m.bits, "shard").groupBy("shard").applyInPandas(_word_level(path), ANSWER), "words")
        figures = {r["shard"]: _unpacked(r["counts"]).tolist() for r in words.where("chunk is null").select("shard", "counts").collect()}
        sizes = tuple(figures.get(s, (0, 0, 0))[0] for s in range(1 << m.bits))
        m = replace(m, sizes=sizes, tokens=sum(f[1] for f in figures.values()), docs=sum(f[2] for f in figures.values()))
        words = words.where("chunk is not null")
        by = chunks.repartition(many, "chunk").groupBy("chunk")
        dealt = by.cogroup(words.repartition(many, "chunk").groupBy("chunk")).applyInPandas(_deal_bigrams(m), "shard long, chunk long, contexts binary, runs binary, totals binary, words binary, n binary")
        pairs = tmp.staged(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(_trie_level(m), ANSWER), "bigrams")
        types = pairs.where("chunk is null")
        starts = sum(int(_unpacked(r["types"]).sum()) for r in types.where("shard < 0").select("types").collect())
        words = words.unionByName(types.where("shard >= 0")).repartition(1 << m.bits, "shard").groupBy("shard").applyInPandas(_type_level(m), ANSWER)
        answers = words.unionByName(pairs.where("chunk is not null"))
        scored = by.cogroup(answers.repartition(many, "chunk").groupBy("chunk")).applyInPandas(_score(m, starts), "row long, n_tokens long, n_known long, base_score double, score double")
        scored = staged(scored, "lm-scores")
    out = rows.select(*wanted, "row").join(scored.withColumn("train_tokens", F.lit(m.tokens).cast("long")), "row")
    return own.restored(out, ADDED, ADDED)
