"""Secret scans with an incremental ledger of contents, by DataFrame functions only.

Every version of every path is known by the SHA-256 of its content, its blob. The ledger remembers which rules, in which
version, have read a blob and what they found. An update reads only the pairs of blob and rule version that the ledger
lacks: a text that a thousand paths share is read once, an unchanged path never again, and a new version of one rule
makes that rule alone read the old blobs. What was found is joined back to all paths.

Null texts count as empty. Rows with null keys and repeated rows stay and get their content's findings. An empty table
gives an empty table. Columns of the input stay, but for those with the names of the added ones (blob and spans).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm import files, work


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`, without those whose `group` has fewer than `least` code points."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    """`word` with a class of both cases for each letter A-Z and no other folding."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_NAME = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

BASE = (
    Rule("assign", rf"""({_NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=12),
    Rule("access", "AKIA[A-Z0-9]+", least=18),
    Rule("hex", "[0-9a-f]{16,}"),  # runs of 16 and more: shorter runs touch no other
)

RULES = (
    *BASE,
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@[A-Za-z0-9.-]+"),
    Rule("prefixed", r"(ghp_|gho_|ghs_|glpat-|sk_live_|rk_live_|xoxb-|xoxp-)[A-Za-z0-9_-]{16,}"),
)

SPANS = "array<struct<start:bigint,place:int,kind:string,end:bigint,rule:string>>"


def _matches(text: Column, rule: Rule, place: int) -> Column:
    """Of every match in order: the code points since the last match, its own and its group's. Texts without a match are read once."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    own = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else every
    found = F.filter(F.arrays_zip(every.alias("m"), own.alias("g"), F.split(text, rule.pattern, -1).alias("gap")), lambda x: x["m"].isNotNull())
    sizes = F.transform(found, lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["g"]).alias("own")))
    return F.when(F.array_contains("todo", rule.name) & F.rlike(text, F.lit(rule.pattern)), sizes)


def scanned(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob and spans (start, place, kind, end, rule) of `texts` (blob, text, todo: the names of the rules that read it); blobs without a span have no row.

    Positions are running sums over the matches of one blob and rule; no array grows by copies of itself.
    """
    none = F.array().cast("array<struct<place:int,i:int,gap:int,size:int,own:int>>")
    hits = texts.select("blob", F.explode(F.concat(*[F.coalesce(_matches(F.col("text"), r, i), none) for i, r in enumerate(rules)])).alias("x")).select("blob", "x.*")
    run = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = hits.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(run))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("place") + 1)
    good = ends.where(F.col("own") >= of([r.least for r in rules]))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "place", of([r.kind for r in rules]).alias("kind"), "end", of([r.name for r in rules]).alias("rule"))
    return good.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"))


class Ledger:
    """A folder that all machines share: `scans` has, for each blob and update, the rules that read it and their spans;
    `versions` every version of every path with its blob. An update appears with its last file, so a job that was lost
    leaves nothing behind and is simply run again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        store, at = files.at(f"{self.path}/{name}")
        if not store.get_file_info(at).is_file and store.get_file_info(at).type.name == "Directory":
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/update-*")
        return self.spark.createDataFrame([], schema)

    def _append(self, df: DataFrame, name: str) -> None:
        work.staged(df, name, f"{self.path}/{name}/update-{uuid.uuid4().hex[:12]}")

    def scans(self) -> DataFrame:
        return self._read("scans", f"blob binary, rules array<string>, spans {SPANS}")

    def versions(self) -> DataFrame:
        return self._read("versions", "path string, version string, blob binary")


def secret_scan(docs: DataFrame, ledger: Ledger | None = None, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", version: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """`docs` (or these columns of it) with blob (SHA-256 in hex) and spans: an array of start, place (of the kind in `rules`), kind, end and rule, by start and place.

    With a ledger, its `versions` get every row's path (the key), version and blob, and only pairs of blob and rule
    version that it has not are read; without one, each distinct content is read once.
    Rows are dealt by blob for counting only (digests, combined before the shuffle); texts move by row number, so that a
    content with a third of all rows loads no task, and its findings return to its rows without a shuffle.
    """
    spark, names = docs.sparkSession, [r.name for r in rules]
    shelter = work.Shelter(docs)
    content = F.coalesce(F.col(shelter.name(text)).cast("string"), F.lit(""))
    wanted = {*shelter.wanted(columns), *([shelter.name(key)] if ledger else []), *([shelter.name(version)] if ledger and version else [])}
    with work.scratch(spark, "secrets") as tmp:
        path = work.fresh_dir(spark, "secret-rows")
        rows = work.numbered(shelter.df.select(*sorted(wanted), F.unhex(F.sha2(content, 256)).alias("blob")), "rows", path)
        texts = work.numbered(shelter.df.select(content.alias("text"), F.unhex(F.sha2(content, 256)).alias("blob")), "texts", tmp.place("texts"))
        blobs = tmp.staged(texts.groupBy("blob").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "blobs")
        known = ledger.scans().select("blob", "rules", "spans") if ledger else None
        todo = blobs.withColumn("todo", F.array(*[F.lit(n) for n in names]))
        if known is not None:
            seen = known.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
            todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except("todo", F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        todo = tmp.staged(todo.select("blob", "row", "todo"), "todo")
        new = scanned(texts.select("row", "text").join(todo, "row").select("blob", "text", "todo"), rules)
        none = F.array().cast(SPANS)
        new = todo.join(new, "blob", "left").select("blob", F.col("todo").alias("rules"), F.coalesce("spans", none).alias("spans"))
        if ledger:
            ledger._append(new, "scans")
            own = [F.col(shelter.name(c)).cast("string") if c else F.lit(None).cast("string") for c in (key, version)]
            ledger._append(rows.select(own[0].alias("path"), own[1].alias("version"), "blob"), "versions")
            all_spans = F.flatten(F.collect_list(F.filter("spans", lambda x: F.array_contains(F.array(*[F.lit(n) for n in names]), x["rule"]))))
            new = ledger.scans().join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(all_spans.alias("spans"))
            order = F.array(*[F.lit(n) for n in names])  # places are those of the rules of this call, whatever the updates had
            placed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (F.array_position(order, x["rule"]) - 1).cast("int").alias("place"), x["kind"].alias("kind"), x["end"].alias("end"), x["rule"].alias("rule")))
            new = new.withColumn("spans", F.array_sort(placed))
        found = work.staged(blobs.select("blob", "copies").join(new.select("blob", "spans"), "blob", "left"), "secret-spans")
        total = blobs.agg(F.sum("copies")).first()[0] or 0
    out = work.join_groups(rows, found, "blob", "copies", total, "left").withColumn("spans", F.coalesce("spans", none))
    kept = out.select(*shelter.wanted(columns), "blob", "spans")
    return shelter.restored(kept, [F.lower(F.hex("blob")).alias("blob"), "spans"], ["blob", "spans"])


def joined_spans(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))
