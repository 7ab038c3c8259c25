"""Text expressions: words, chunks, names, lines, JSON payloads, records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r]+"


def strip(text: Column, chars: str = r"[ \t\n\r]") -> Column:
    """Without the characters at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{chars}+", ""), f"{chars}+$", "")


def words(text: Column) -> Column:
    """The words between white space; an empty array for a blank or null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def token_estimate(text: Column) -> Column:
    return F.size(words(text))


def word_chunks(df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200, into: str = "chunk") -> DataFrame:
    """Rows of chunk_index and chunk: windows of words that start every size - overlap words; no row for a blank text."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    ws = df.withColumn("_ws", words(F.col(text)))
    starts = F.when(F.size("_ws") > 0, F.sequence(F.lit(0), F.size("_ws") - 1, F.lit(step)))
    return ws.select(*df.columns, "_ws", F.posexplode(starts).alias("chunk_index", "_at")).select(
        *df.columns, "chunk_index", F.array_join(F.slice("_ws", F.col("_at") + 1, size), " ").alias(into)
    )


def paragraph_chunks(text: Column, size: int = 8000, overlap: int = 500) -> Column:
    """An array of chunks: paragraphs packed while they fit, each chunk led by the end of the one before.

    A paragraph is never cut, so one beyond the size is a chunk of its own; empty chunks are dropped.
    """
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: strip(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + F.length(p) + 2 <= size
        grown = F.concat(p, F.lit("\n\n"))
        done = F.when(fits | (s["now"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))
        return F.struct(done.alias("done"), F.when(fits, F.concat(s["now"], grown)).otherwise(grown).alias("now"))

    end = lambda s: F.transform(F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]), lambda c: strip(c))
    packed = F.aggregate(paragraphs, start, add, end)
    led = lambda cs: F.transform(cs, lambda c, i: F.when(i == 0, c).otherwise(strip(F.concat(F.right(F.get(cs, i - 1), F.lit(overlap)), F.lit("\n"), c))))
    return F.element_at(F.transform(F.array(packed), led), 1)


def names_after(text: Column, prefix: str) -> Column:
    """All names that follow a literal prefix at a word boundary, in order, repeats included."""
    edge = r"\b" if prefix[:1].isalnum() or prefix[:1] == "_" else ""
    quoted = "".join("\\" + c if not (c.isalnum() or c == "_") else c for c in prefix)
    return F.regexp_extract_all(text, F.lit(rf"(?U){edge}{quoted}(\w+)"), F.lit(1))


def sorted_names(names: Column, separator: str = ", ") -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), separator)


def line_items(text: Column, most: int = 200) -> Column:
    """Lines without blank ones, stripped of dashes and spaces at both ends; a cap on the list."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x) != "")
    return F.slice(F.transform(lines, lambda x: strip(x, r"[\- ]")), 1, most)


def contains_any_case(text: Column, keyword: str) -> Column:
    return F.coalesce(F.lower(text).contains(keyword.lower()), F.lit(False))


def payload_text(raw: Column) -> Column:
    """Of a JSON object its content, else its message, else its text; of an array its items as lines; of a scalar its text; else the raw string."""
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    items = F.array_join(F.from_json(raw, "array<string>"), "\n")
    return F.when(v.isNull(), raw).when(kind.startswith("OBJECT"), F.coalesce(field("content"), field("message"), raw)).when(kind.startswith("ARRAY"), items).otherwise(F.try_variant_get(v, "$", "string"))


def conductor_name(name: Column, per_phase: Column, sizes: Mapping[str, str], kinds: Mapping[str, str], names: Mapping[str, str]) -> Column:
    """Canonical size, type and name of a conductor written as size, count, type words, name; NULL with fewer than four words.

    sizes and names map words; kinds maps a part of the type to its canonical form. Two per phase are marked as bundled.
    """
    w = words(name)
    pick = lambda table, word, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), word), other) if table else other
    size = F.regexp_replace(F.element_at(w, 1), r"\.0$", "")
    kind = F.array_join(F.slice(w, 3, F.greatest(F.size(w) - 3, F.lit(0))), " ")
    for part, canonical in kinds.items():
        kind = F.when(F.upper(kind).contains(part.upper()), canonical).otherwise(kind)
    last = F.lower(F.element_at(w, -1))
    own = pick(names, last, F.initcap(last))
    single = F.concat_ws(" ", pick(sizes, size, size), kind, own)
    return F.when(F.size(w) >= 4, F.when(per_phase == 2, F.concat_ws(" ", pick(sizes, size, size), F.lit("x2"), kind, own, F.lit("Bundled"))).otherwise(single))


def record(command: str, from_bus: Column, to_bus: Column, circuit: Column, r: Column, x: Column, b: Column, ratings: Column) -> Column:
    """A positional branch record: command, ends, circuit, six blanks, R, X and B, seventeen commas, the ratings, a semicolon."""
    fields = F.concat_ws(",", F.lit(command), from_bus.cast("string"), to_bus.cast("string"), circuit.cast("string"), *[F.lit("")] * 6, r.cast("string"), x.cast("string"), b.cast("string"))
    return F.concat(fields, F.lit("," * 17), F.array_join(F.transform(ratings, lambda v: v.cast("string")), ","), F.lit(";"))


def with_system_row(rows: DataFrame, group: str, order: str, text: str, last: int) -> DataFrame:
    """group, order, role, text: a system row (order -1) for each group, then its last rows."""
    recent = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_r") <= last)
    system = rows.select(group).distinct().select(group, F.lit(-1).cast("long").alias(order), F.lit("system").alias("role"), F.lit(text).alias("text"))
    return system.unionByName(recent.select(group, order, "role", "text"))


def key_value_records(text: Column, rule: str = r"\n-{3,}[ \t]*(?:\n|$)") -> Column:
    """An array of maps, one for each record between lines of dashes: name to value of its `Name: value` lines, up to the first blank line. Records without such a line are none; of a repeated name the last value stays."""
    head = lambda r: F.get(F.split(F.ltrim(r), r"\n\s*\n"), F.lit(0))
    lines = lambda r: F.filter(F.split(head(r), "\n"), lambda x: F.rlike(x, F.lit(r"^[^:]+:\s")))
    pair = lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("value"))
    last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))
    records = F.transform(F.split(F.coalesce(text, F.lit("")), rule), lambda r: F.transform(lines(r), pair))
    return F.transform(F.filter(records, lambda r: F.size(r) > 0), lambda r: F.map_from_entries(last(r)))
