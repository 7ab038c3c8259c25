"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to places in them.

A shard `shard-N.ids` is a 16-byte header (magic, bytes an id) and the ids of its documents in key order;
`shard-N.len` holds their lengths as unsigned 32-bit integers. The index is dealt into parts by key hash; each part
is a minimal perfect hash of its keys' 64-bit hashes, whose slots store the place of the runs in a list, so that a key is
found in constant time. A run is the shard, the row, the first id and the number of rows of a key in one shard and one
block of ROWS_IN_RUN rows, with the key's fingerprint, a second 64-bit hash: keys that share the first hash share a
slot and are told apart by it, and a key that the shards do not have is found with a probability of 2^-64 a slot. A key
whose rows lie in many shards has a run for each of them, and its runs are read by as many tasks.

Defined results: a null text is an empty text (its ids are the end id alone); a null key is a key like any other
and comes first; rows with one key stay side by side and are all found under it; an empty table gives no shards.
Other columns are ignored.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import bpe, files
from gridloom.llm.work import fresh_dir, staged

MAGIC = b"GLIDS001"
KEYS_IN_PART = 200_000
ROWS_IN_RUN = 4096
ROWS_AT_ONCE = 256
_SEEDS = np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of hashes, another one for each level."""
    with np.errstate(over="ignore"):
        x = h ^ _SEEDS[level]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key sits at the first level where no other key of that level shares its bit."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, n = [], 0
        for bits in levels:
            self.ranks.append(n + np.concatenate([[0], np.cumsum(bits)[:-1]]) if len(bits) else np.zeros(0, int))
            n += int(bits.sum())
        self.base = n

    @classmethod
    def build(cls, hashes: np.ndarray, gamma: float = 1.7, depth: int = 40) -> PerfectHash:
        """Of distinct hashes; what no level could place comes last, sorted."""
        left, levels = hashes.astype(np.uint64), []
        for level in range(depth):
            if not len(left):
                break
            at = (_mix(left, level) % np.uint64(max(2, math.ceil(gamma * len(left))))).astype(np.int64)
            hits = np.bincount(at, minlength=max(2, math.ceil(gamma * len(left))))
            levels.append(hits == 1)
            left = left[hits[at] != 1]
        return cls(levels, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1, or any slot, for a hash that was not built in."""
        out, todo, hashes = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), hashes.astype(np.uint64)
        for level, bits in enumerate(self.levels):
            at = (_mix(hashes[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            k = np.minimum(np.searchsorted(self.rest, hashes[todo]), len(self.rest) - 1)
            hit = self.rest[k] == hashes[todo]
            out[todo[hit]] = self.base + k[hit]
        return out


_RUN = {"shard": np.uint32, "row": np.uint64, "at": np.uint64, "rows": np.uint32, "print": np.int64}


@dataclass(frozen=True)
class TokenShards:
    """Where the shards are, and their tables."""

    path: str
    width: int
    parts: int
    entries: DataFrame
    """key, shard, row, at (the first id's place in the shard), n: a row for each document."""

    def starts(self) -> DataFrame:
        """shard, base: the ids of all shards before it. As many rows as shards."""
        totals = self.entries.groupBy("shard").agg(F.max(F.col("at") + F.col("n")).alias("n"))
        before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
        return totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))


def _hash(key: Column | str) -> Column:
    return F.xxhash64(key)


def _fingerprint(key: Column | str) -> Column:
    return F.xxhash64(F.lit("fingerprint"), key)


def write_token_shards(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, width: int = 2, path: str | None = None) -> TokenShards:
    """Encodes all documents, writes shards in ascending key order and the index. `width`: bytes an id."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "shards")
    kind, most = f"<u{width}", 256**width - 1
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"), F.monotonically_increasing_id().alias("i"))
    ordered = own.repartitionByRange(F.asc_nulls_first("key"), "h", "i").sortWithinPartitions(F.asc_nulls_first("key"), "h", "i")

    def write(batches):
        shard, row, at = TaskContext.get().partitionId(), 0, 0
        end, lengths = np.array([end_id], "<u4").tobytes(), []
        first = next(iter(batches), None)
        if first is None:
            return
        with files.writing(f"{path}/shard-{shard}.ids") as out:
            out.write(MAGIC + np.array([width, 0], "<u4").tobytes())
            batch = first
            while batch is not None:
                parts = [x + end for x in bpe.encoder(tokenizer).encode(batch["text"].tolist())]
                ids, n = np.frombuffer(b"".join(parts), "<u4"), np.array([len(x) // 4 for x in parts], np.int64)
                if len(ids) and int(ids.max()) > most:
                    raise ValueError(f"an id does not fit {width} bytes")
                out.write(ids.astype(kind).tobytes())
                ends = np.cumsum(n)
                yield pd.DataFrame({"key": batch["key"], "shard": shard, "row": row + np.arange(len(n)), "at": at + ends - n, "n": n})
                lengths.append(n.astype("<u4"))
                row, at = row + len(n), at + int(n.sum())
                batch = next(batches, None)
        with files.writing(f"{path}/shard-{shard}.len") as out:
            out.write(np.concatenate(lengths).tobytes())

    kind_of_key = docs.schema[key].dataType.simpleString()
    entries = staged(ordered.select("key", "text").mapInPandas(write, f"key {kind_of_key}, shard int, row long, at long, n long"), "entries")
    # All rows of a key lie side by side: so there are as many runs as keys, shards and blocks at most.
    runs = entries.groupBy("key", "shard", F.floor(F.col("row") / ROWS_IN_RUN)).agg(F.min("row").alias("row"), F.min("at").alias("at"), F.count("*").alias("rows"))
    places = runs.select(_hash("key").alias("h"), F.struct("shard", "row", "at", "rows", _fingerprint("key").alias("print")).alias("run"))
    places = places.groupBy("h").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    places = staged(places.select("h", *[F.col(f"runs.{c}").alias(c) for c in _RUN]), "places")
    parts = max(1, math.ceil(places.count() / KEYS_IN_PART))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        part, h = int(pdf["part"].iloc[0]), pdf["h"].to_numpy().view(np.uint64)
        uniq, first = np.unique(h, return_index=True)
        mph = PerfectHash.build(uniq)
        slots, pdf = mph.slots(uniq), pdf.iloc[first]
        many = pdf["shard"].map(len).to_numpy(np.int64)
        table = {"hash": uniq, "first": (np.cumsum(many) - many).astype(np.uint64), "runs": many.astype(np.uint32)}
        columns = {c: np.concatenate(pdf[c].to_list()).astype(kind) for c, kind in _RUN.items()}
        for name, values in table.items():
            columns[name] = np.zeros(len(uniq), values.dtype)
            columns[name][slots] = values
        sizes = np.array([len(b) for b in mph.levels], np.int64)
        bits = [np.packbits(b) for b in mph.levels]
        buffer = io.BytesIO()
        np.savez(buffer, sizes=sizes, bits=np.concatenate(bits) if bits else np.zeros(0, np.uint8), rest=mph.rest, **columns)
        with files.writing(f"{path}/index-{part}.npz") as out:
            out.write(buffer.getvalue())
        return pd.DataFrame({"part": [part], "keys": [len(uniq)]})

    dealt = places.withColumn("part", F.expr(f"cast(pmod(shiftrightunsigned(h, 20), {parts}) as int)"))
    dealt.groupBy("part").applyInPandas(build, "part int, keys long").agg(F.sum("keys")).collect()
    return TokenShards(path, width, parts, entries)


@lru_cache(maxsize=2)
def _index(path: str, part: int) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    with files.reading(f"{path}/index-{part}.npz") as f:
        z = np.load(io.BytesIO(f.read()))
        bits, levels, k = z["bits"], [], 0
        for n in z["sizes"]:
            levels.append(np.unpackbits(bits[k : k + (n + 7) // 8], count=n).astype(bool))
            k += (n + 7) // 8
        return PerfectHash(levels, z["rest"]), {c: z[c] for c in ("hash", "first", "runs", *_RUN)}


def locate(spark: SparkSession, shards: TokenShards, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, shard, row, at, rows of every distinct key that the index has: a row for each of its runs."""
    path, parts = shards.path, shards.parts
    asked = keys.select(F.col(key).alias("key")).distinct().withColumns({"h": _hash("key"), "print": _fingerprint("key")})
    asked = asked.withColumn("part", F.expr(f"cast(pmod(shiftrightunsigned(h, 20), {parts}) as int)"))

    def look(batches):
        for pdf in batches:
            for part, own in pdf.groupby("part"):
                mph, table = _index(path, int(part))
                h = own["h"].to_numpy().view(np.uint64)
                slot = mph.slots(h)
                ok = slot >= 0
                ok[ok] = table["hash"][slot[ok]] == h[ok]
                first, many = table["first"][slot[ok]].astype(np.int64), table["runs"][slot[ok]].astype(np.int64)
                run = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
                found = pd.DataFrame({"key": own["key"][ok].repeat(many).to_numpy()} | {c: table[c][run].astype(np.int64) for c in _RUN})
                yield found[found["print"].to_numpy() == np.repeat(own["print"].to_numpy()[ok], many)].drop(columns="print")

    kind = keys.schema[key].dataType.simpleString()
    return asked.repartition("part").mapInPandas(look, f"key {kind}, shard long, row long, at long, rows long")


def read_tokens(spark: SparkSession, shards: TokenShards, places: DataFrame, with_ids: bool = True) -> DataFrame:
    """key, shard, at, n, ids_crc32 and, if asked for, ids: read from the files, a row for each document."""
    import zlib

    path = shards.path
    kind = places.schema["key"].dataType.simpleString()

    def exactly(file, size: int, at: int) -> bytes:
        got = file.read_at(size, at)
        if len(got) != size:
            raise ValueError(f"a shard ends early: {len(got)} of {size} bytes at {at}")
        return got

    def documents(own, shard, ids, lens):
        head = exactly(ids, 16, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"not a shard: {shard}")
        width = int(np.frombuffer(head[8:12], "<u4")[0])
        for key, row, at, rows in own[["key", "row", "at", "rows"]].itertuples(index=False, name=None):
            for n in np.frombuffer(exactly(lens, 4 * int(rows), 4 * int(row)), "<u4").tolist():
                x = np.frombuffer(exactly(ids, width * n, 16 + width * int(at)), f"<u{width}").astype("<u4")
                yield key, shard, at, n, zlib.crc32(x.tobytes()), x.astype(np.int64) if with_ids else None
                at += n

    def read(batches):
        for pdf in batches:
            for shard, own in pdf.sort_values(["shard", "at"]).groupby("shard"):
                with files.reading(f"{path}/shard-{shard}.ids") as ids, files.reading(f"{path}/shard-{shard}.len") as lens:
                    rows = documents(own, shard, ids, lens)
                    while out := list(islice(rows, ROWS_AT_ONCE)):
                        frame = pd.DataFrame(out, columns=["key", "shard", "at", "n", "ids_crc32", "ids"])
                        yield frame if with_ids else frame.drop(columns="ids")

    schema = f"key {kind}, shard long, at long, n long, ids_crc32 long" + ", ids array<long>" * with_ids
    chunk = F.floor(F.col("row") / ROWS_IN_RUN)
    return places.repartition("shard", chunk).mapInPandas(read, schema)
