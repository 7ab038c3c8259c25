"""Queries over the driver's tables, one or more for each operator, with SQL that gives the same rows.

Measures are rounded to six digits on both sides; ties are broken by ids. Vector queries take every vector whose id
is divisible by 50 as a query against all vectors. Texts are compared by their MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import splitter
from gridloom.functions import text as tx
from gridloom.functions import vectors as vx
from gridloom.operators import evaluate as ev
from gridloom.operators import graph as gr
from gridloom.operators import grounding, lookup, retrieval, trading
from gridloom.operators import timeseries as ts
from gridloom.plans.catalog import query, table

D = "doc_id"
WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[ \t\n\r]+'), lambda w: w <> '')"


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Vectors


def _hits(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine", **more) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.top_k(e, e.where("vec_id % 50 = 0"), k, metric, digits=9, **more)


_PAIRS = """
WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 50 = 0),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT query, id, round({score}, 9) AS score FROM q, v WHERE len(a) = len(b)),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score {order}, id) AS rank FROM s {where})
"""
_COSINE = _PAIRS.format(score="coalesce(list_cosine_similarity(a, b), 0)", order="DESC", where="")


@query(_COSINE + "SELECT query, id, round(score, 5) AS score, rank::INTEGER AS rank FROM t WHERE rank <= 5")
def vec_topk_cosine(spark, sf_dir):
    return _hits(spark, sf_dir, 5).select("query", "id", _r("score", 5).alias("score"), "rank")


@query(_PAIRS.format(score="list_inner_product(a, b)", order="DESC", where="") + "SELECT query, id, round(score, 5) AS score, rank::INTEGER AS rank FROM t WHERE rank <= 10")
def vec_topk_inner(spark, sf_dir):
    return _hits(spark, sf_dir, 10, "inner").select("query", "id", _r("score", 5).alias("score"), "rank")


@query(_PAIRS.format(score="list_distance(a, b)", order="ASC", where="WHERE query <> id") + "SELECT query, id, round(score, 5) AS score FROM t WHERE rank <= 5")
def vec_topk_l2(spark, sf_dir):
    hits = _hits(spark, sf_dir, 6, "l2").where("query <> id")
    w = Window.partitionBy("query").orderBy("score", "id")
    return hits.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query", "id", _r("score", 5).alias("score"))


@query(_COSINE + "SELECT query, max_by(id, (score, -id)) AS id, round(max(score), 5) AS score FROM s WHERE query <> id GROUP BY query")
def vec_top1(spark, sf_dir):
    best = _hits(spark, sf_dir, 2).where("query <> id")
    return best.groupBy("query").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), _r(F.max("score"), 5).alias("score"))


@query(
    _PAIRS.format(score="coalesce(list_cosine_similarity(a, b), 0)", order="DESC", where="WHERE score >= 0.6")
    + "SELECT q.query, count(t.id) AS hits, coalesce(string_agg(t.id::VARCHAR, ',' ORDER BY rank), 'nothing found') AS ids FROM q LEFT JOIN t ON q.query = t.query AND rank <= 3 GROUP BY q.query"
)
def vec_threshold_topk(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"))
    hits = _hits(spark, sf_dir, 3, least=0.6)
    found = hits.groupBy("query").agg(F.count("*").alias("hits"), retrieval.joined("rank", F.col("id").cast("string"), ",").alias("ids"))
    return queries.join(found, "query", "left").select("query", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("ids", F.lit("nothing found")).alias("ids"))


@query(_COSINE + "SELECT query, id, round(score, 5) AS score, rank::INTEGER AS rank FROM t WHERE rank <= 10")
def indexed_topk_cosine(spark, sf_dir):
    """The ten nearest vectors through an index that is written first; what it skips cannot be among them."""
    from gridloom.operators import vector_index
    from gridloom.plans.folders import shared_folder

    e, path = table(spark, sf_dir, "embeddings"), shared_folder(spark, "index")
    vector_index.build_index(e, path)
    hits, _ = vector_index.search(spark, path, e.where("vec_id % 50 = 0"), 10, digits=9)
    return hits.select("query", "id", _r("score", 5).alias("score"), "rank")


@query(
    "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, "
    "round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first FROM embeddings"
)
def vec_unit_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", _r(vx.norm(F.col("embedding"))).alias("norm"), _r(F.element_at(vx.unit(F.col("embedding")), 1)).alias("first"))


@query("SELECT len(embedding)::INTEGER AS dim, label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY ALL")
def vec_dim_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.groupBy(F.size("embedding").alias("dim"), "label").agg(F.count("*").alias("n"))


# Text


@query(f"""
WITH w AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, len(ws), 800)) AS a0 FROM w)
SELECT doc_id, (a0 // 800)::INTEGER AS chunk_index, len(ws[a0 + 1 : a0 + 1000])::INTEGER AS n_words, md5(array_to_string(ws[a0 + 1 : a0 + 1000], ' ')) AS md5 FROM c
""")
def chunk_words(spark, sf_dir):
    c = tx.word_chunks(table(spark, sf_dir, "documents").select(D, "text"))
    return c.select(D, "chunk_index", tx.token_estimate(F.col("chunk")).alias("n_words"), F.md5("chunk").alias("md5"))


@query()
def chunk_paragraphs(spark, sf_dir):
    """Pages of 2000 characters with 200 of overlap; a line is a paragraph here, as the documents have no blank lines."""
    lines = F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n")
    d = table(spark, sf_dir, "documents").select(D, F.posexplode(tx.paragraph_chunks(lines, 2000, 200)).alias("chunk_index", "chunk"))
    return d.select(D, "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("md5"))


@query()
def chunk_recursive(spark, sf_dir):
    d = splitter.recursive_chunks(table(spark, sf_dir, "documents"), D)
    return d.select(D, "chunk_index", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("md5"))


@query(f"SELECT doc_id, len({WORDS.format('text')})::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(D, tx.token_estimate(F.col("text")).alias("tokens"))


_TURNS = f"SELECT conv_id, turn, role, text, len({WORDS.format('text')})::BIGINT AS tokens FROM conversations"


@query(f"""
WITH t AS ({_TURNS}), u AS (SELECT conv_id, turn, tokens, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text))::BIGINT AS used FROM t)
SELECT * FROM u WHERE used <= 200
""")
def token_budget_prefix(spark, sf_dir):
    return retrieval.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], 200).select("conv_id", "turn", "tokens", "used")


@query(f"""
WITH t AS ({_TURNS}), u AS (SELECT conv_id, turn, tokens, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn, role, text))::BIGINT AS used FROM t WHERE tokens <= 60)
SELECT * FROM u WHERE used <= 150
""")
def token_budget_skip(spark, sf_dir):
    return retrieval.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], 150, most=60).select("conv_id", "turn", "tokens", "used")


@query("SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, E'\\n' ORDER BY turn, role, text)) AS md5 FROM conversations GROUP BY conv_id")
def conversation_transcript(spark, sf_dir):
    line = F.concat("role", F.lit(": "), "text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(retrieval.joined(F.struct("turn", "role", "text"), line, "\n")).alias("md5"))


@query(_COSINE + f""", h AS (SELECT query, id, rank FROM t WHERE rank <= 10),
x AS (SELECT query, rank, text, len({WORDS.format('text')}) AS tokens FROM h JOIN documents ON doc_id = id),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS used FROM x)
SELECT query, count(*) AS n_chunks, max(used)::BIGINT AS tokens, md5(string_agg(text, E'\\n\\n---\\n\\n' ORDER BY rank)) AS md5 FROM u WHERE used <= 1500 GROUP BY query""")
def rag_context(spark, sf_dir):
    """The ten nearest documents (vectors and documents share ids), as a context of at most 1500 tokens."""
    docs = table(spark, sf_dir, "documents").select(F.col(D).alias("id"), "text")
    c = retrieval.contexts(_hits(spark, sf_dir, 10), docs, 1500)
    return c.select("query", "n_chunks", "tokens", F.md5("context").alias("md5"))


_TAGS = r"regexp_extract_all(html, '<(\w+)', 1)"


def _tags():
    return tx.names_after(F.col("html"), "<")


@query(f"SELECT page_id, len({_TAGS})::INTEGER AS n_names, md5(array_to_string({_TAGS}, ',')) AS names FROM pages")
def regex_extract_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(_tags()).alias("n_names"), F.md5(F.array_join(_tags(), ",")).alias("names"))


@query(f"SELECT name, count(*) AS pages FROM (SELECT page_id, unnest(list_distinct({_TAGS})) AS name FROM pages) GROUP BY name")
def regex_distinct_names(spark, sf_dir):
    each = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(_tags())).alias("name"))
    return each.groupBy("name").agg(F.count("*").alias("pages"))


def _spoken():
    """Runs of three or more plain lower-case letters that begin a word."""
    return F.regexp_extract_all("text", F.lit(r"(?:^|[ \t\n\r])([a-z]{3,})"), F.lit(1))


_SPOKEN = r"regexp_extract_all(text, '(?:^|[ \t\n\r])([a-z]{3,})', 1)"
_NAMES = f"WITH valid AS (SELECT DISTINCT unnest({_SPOKEN}) AS name FROM benchmark), used AS (SELECT DISTINCT conv_id, unnest({_SPOKEN}) AS name FROM conversations WHERE role = 'assistant')"


@query(_NAMES + " SELECT conv_id, name FROM used WHERE name NOT IN (SELECT name FROM valid)")
def unknown_names_anti(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return grounding.unknown_names(answers, "conv_id", _spoken(), grounding.distinct_names(table(spark, sf_dir, "benchmark"), _spoken()))


@query(_NAMES + """ SELECT conv_id, count(*) AS n_used, count(*) FILTER (valid.name IS NULL) AS n_unknown,
md5(coalesce(string_agg(used.name, ', ' ORDER BY used.name) FILTER (valid.name IS NULL), '')) AS unknown, count(*) FILTER (valid.name IS NULL) = 0 AS grounded
FROM used LEFT JOIN valid ON used.name = valid.name GROUP BY conv_id""")
def grounding_report(spark, sf_dir):
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    valid = grounding.distinct_names(table(spark, sf_dir, "benchmark"), _spoken())
    return grounding.grounding_report(answers, "conv_id", _spoken(), valid).withColumn("unknown", F.md5("unknown"))


@query("SELECT lang, count(*) FILTER (contains(lower(text), 'license')) AS licensed, count(*) FILTER (contains(lower(text), 'token')) AS tokened, count(*) AS n FROM documents GROUP BY lang")
def keyword_contains(spark, sf_dir):
    has = lambda w: F.count(F.when(tx.contains_any_case(F.col("text"), w), 1))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(has("license").alias("licensed"), has("token").alias("tokened"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, max(url) AS latest, max_by(page_id, (url, page_id)) AS page_id FROM pages WHERE starts_with(url, 'https') AND suffix(url, '.html')")
def prefix_suffix_latest(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(F.col("url").startswith("https") & F.col("url").endswith(".html"))
    return p.agg(F.count("*").alias("n"), F.max("url").alias("latest"), F.max_by("page_id", F.struct("url", "page_id")).alias("page_id"))


@query("""SELECT event_id, CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(j->>'$.content', j->>'$.message', props) WHEN j IS NULL THEN props ELSE j->>'$' END AS payload
FROM (SELECT event_id, props, CASE WHEN json_valid(props) THEN props::JSON END AS j FROM events)""")
def json_field_fallback(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.payload_text(F.col("props")).alias("payload"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), E'\n'), lambda x: regexp_matches(x, '[^ \t\n\r]')) AS ls FROM documents),
i AS (SELECT doc_id, list_transform(ls, lambda x: regexp_replace(regexp_replace(x, '^[\- ]+', ''), '[\- ]+$', ''))[1:200] AS items FROM l)
SELECT doc_id, len(items)::INTEGER AS n_items, md5(array_to_string(items, '|')) AS md5 FROM i""")
def line_items(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(D, tx.line_items(F.col("text")).alias("items"))
    return items.select(D, F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("md5"))


@query("SELECT doc_id, length(text[1:120000])::INTEGER AS capped, md5(text[1:8192]) AS embedded, text[1:120] AS snippet, printf('%.3f', length(text) / 7.0) AS shown FROM documents")
def text_caps(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(D, F.length(F.substring("text", 1, 120000)).alias("capped"), F.md5(F.substring("text", 1, 8192)).alias("embedded"), F.left("text", F.lit(120)).alias("snippet"), F.format_string("%.3f", F.length("text") / 7.0).alias("shown"))


# Time series


def _series(spark, sf_dir):
    return ts.hourly(table(spark, sf_dir, "events"), "event_type", "ts", "value")


_HOURS = "h AS (SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS value, count(*) AS n FROM events GROUP BY ALL)"
_GRID = _HOURS + ", g AS (SELECT series, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY series), r AS (SELECT g.series, g.ts, h.value FROM g LEFT JOIN h ON g.series = h.series AND g.ts = h.ts)"
_FILLED = _GRID + """, k AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER a AS t0,
first_value(value IGNORE NULLS) OVER b AS v1, first_value(CASE WHEN value IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER b AS t1 FROM r
WINDOW a AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT series, ts, CASE WHEN value IS NOT NULL THEN value WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (epoch(ts) - t0) / (t1 - t0) END AS value FROM k)"""


def _filled(spark, sf_dir):
    return ts.interpolated(ts.hourly_grid(_series(spark, sf_dir))).select("series", "ts", F.col("filled").alias("value"))


@query(f"WITH {_HOURS} SELECT series, ts, round(value, 6) AS value, n FROM h")
def hourly_series(spark, sf_dir):
    return _series(spark, sf_dir).select("series", "ts", _r("value").alias("value"), "n")


@query(f"WITH {_FILLED} SELECT series, ts, round(value, 6) AS value FROM f")
def interpolate_gaps(spark, sf_dir):
    return _filled(spark, sf_dir).withColumn("value", _r("value"))


@query(f"WITH {_HOURS} SELECT series, ts, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dayofweek, month(ts)::INTEGER AS month, (isodow(ts) >= 6)::INTEGER AS is_weekend FROM h")
def calendar_features(spark, sf_dir):
    return ts.with_calendar(_series(spark, sf_dir)).select("series", "ts", "hour", "dayofweek", "month", "is_weekend")


@query(f"WITH {_FILLED} SELECT series, ts, round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 24) OVER w, 6) AS lag_24, round(lag(value, 168) OVER w, 6) AS lag_168 FROM f WINDOW w AS (PARTITION BY series ORDER BY ts)")
def lag_features(spark, sf_dir):
    return ts.with_lags(_filled(spark, sf_dir)).select("series", "ts", *[_r(f"lag_{k}").alias(f"lag_{k}") for k in (1, 24, 168)])


def _mean_sql(n, name, past=0):
    """Means of cents often end in a five: a billionth more lets them round up on both sides."""
    w = f"(PARTITION BY series ORDER BY ts ROWS BETWEEN {n - 1 + past} PRECEDING AND {'1 PRECEDING' if past else 'CURRENT ROW'})"
    return f"round(CASE WHEN count(value) OVER {w} >= {n} THEN avg(value) OVER {w} END + 1e-9, 6) AS {name}"


@query(f"WITH {_FILLED} SELECT series, ts, {_mean_sql(24, 'rolling_24h_mean')}, {_mean_sql(168, 'rolling_168h_mean')} FROM f")
def rolling_means(spark, sf_dir):
    return ts.with_rolling_means(_filled(spark, sf_dir)).select("series", "ts", *[_r(F.col(f"rolling_{n}h_mean") + 1e-9).alias(f"rolling_{n}h_mean") for n in (24, 168)])


@query(f"WITH {_FILLED} SELECT series, ts, {_mean_sql(24, 'rolling_24h_mean', 1)}, {_mean_sql(168, 'rolling_168h_mean', 1)} FROM f")
def rolling_means_past(spark, sf_dir):
    rows = ts.with_rolling_means(_filled(spark, sf_dir), inclusive=False)
    return rows.select("series", "ts", *[_r(F.col(f"rolling_{n}h_mean") + 1e-9).alias(f"rolling_{n}h_mean") for n in (24, 168)])


_SHIFT = ", ".join(f"round(coalesce((SELECT value FROM h AS p WHERE p.series = h.series AND p.ts = h.ts - INTERVAL {n} HOUR), lag(value) OVER (PARTITION BY series ORDER BY ts)), 6) AS before_{n}h" for n in (24, 168))


@query(f"WITH {_HOURS} SELECT series, ts, {_SHIFT} FROM h")
def time_shift_lookup(spark, sf_dir):
    rows = ts.value_before(ts.value_before(_series(spark, sf_dir), 24), 168)
    return rows.select("series", "ts", _r("before_24h").alias("before_24h"), _r("before_168h").alias("before_168h"))


@query(f"WITH {_HOURS}, t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC) AS k FROM h) SELECT series, ts, round(value, 6) AS value FROM t WHERE k <= 168")
def tail_168(spark, sf_dir):
    return ts.tail(_series(spark, sf_dir), 168).select("series", "ts", _r("value").alias("value"))


@query(f"WITH {_HOURS} SELECT series, ts, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS r FROM h) WHERE r <= 48")
def head_48(spark, sf_dir):
    return ts.head(_series(spark, sf_dir), 48).select("series", "ts", _r("value").alias("value"))


@query(f"WITH {_FILLED}, l AS (SELECT series, ts, value, lag(value, 24) OVER (PARTITION BY series ORDER BY ts) AS pred FROM f) SELECT series, round(sqrt(avg((value - pred) ** 2)), 6) AS rmse, count(pred) AS n FROM l WHERE ts >= TIMESTAMP '2024-01-08' GROUP BY series")
def rmse_naive(spark, sf_dir):
    rows = ts.with_lags(_filled(spark, sf_dir), (24,)).where(F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz"))
    return rows.groupBy("series").agg(_r(ev.rmse("value", "lag_24")).alias("rmse"), F.count("lag_24").alias("n"))


# Trading: an order's total is a trade, its priority the symbol


def _bars(spark, sf_dir):
    return trading.bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


_BARS = "b AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, min_by(o_totalprice, (o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS close, count(*) AS volume FROM orders GROUP BY ALL)"
_SMA = "CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {0} PRECEDING AND CURRENT ROW) > {0} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {0} PRECEDING AND CURRENT ROW) END"
_SIGNAL = _BARS + f", m AS (SELECT *, {_SMA.format(19)} AS sma_fast, {_SMA.format(49)} AS sma_slow FROM b), s AS (SELECT *, CASE WHEN sma_fast > sma_slow THEN 1 ELSE 0 END AS signal FROM m)"


@query(f"WITH {_BARS} SELECT * FROM b")
def ohlcv_bars(spark, sf_dir):
    return _bars(spark, sf_dir)


@query(f"WITH {_SIGNAL} SELECT symbol, ts, round(sma_fast, 4) AS sma_fast, round(sma_slow, 4) AS sma_slow, signal::INTEGER AS signal FROM s")
def sma_signal(spark, sf_dir):
    return trading.sma_signal(_bars(spark, sf_dir)).select("symbol", "ts", _r("sma_fast", 4).alias("sma_fast"), _r("sma_slow", 4).alias("sma_slow"), "signal")


@query(f"""WITH {_SIGNAL}, r AS (SELECT symbol, ts, coalesce(close / lag(close) OVER w - 1, 0) AS ret, lag(signal) OVER w AS held, abs(signal - lag(signal) OVER w) AS turn FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
n AS (SELECT *, held * ret - turn / 10000.0 AS net FROM r)
SELECT symbol, ts, round(net, 8) AS net, round(ln(product(1 + net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)), 6) AS log_curve FROM n""")
def backtest_curve(spark, sf_dir):
    b = _bars(spark, sf_dir)
    out = trading.backtest(b, trading.sma_signal(b))
    return out.select("symbol", "ts", _r("net", 8).alias("net"), _r(F.log("curve")).alias("log_curve"))


@query(f"WITH {_SIGNAL}, e AS (SELECT *, lag(signal) OVER (PARTITION BY symbol ORDER BY ts) AS before, count(*) OVER (PARTITION BY symbol) AS bars FROM s) SELECT symbol, ts, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell' END AS side FROM e WHERE signal <> before AND bars >= 50")
def signal_edges(spark, sf_dir):
    return trading.signal_edges(trading.sma_signal(_bars(spark, sf_dir))).select("symbol", "ts", "side")


@query("SELECT c_custkey, greatest(floor(coalesce(c_acctbal * 0.1 / nullif(o_totalprice, 0), 0)), 0)::BIGINT AS qty, round((o_totalprice * (1 - 0.03))::DECIMAL(18, 6), 2)::DOUBLE AS stop, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")
def position_size(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", trading.position_size(F.col("c_acctbal"), F.col("o_totalprice")).alias("qty"), trading.stop_loss(F.col("o_totalprice")).alias("stop"), "o_orderkey")


# Lookup: parts are the catalogue


@query("SELECT (row_number() OVER (ORDER BY p_size) - 1)::INTEGER AS place, p_size::VARCHAR AS value FROM (SELECT DISTINCT p_size FROM part WHERE p_size IS NOT NULL)")
def distinct_menu(spark, sf_dir):
    return lookup.menu(table(spark, sf_dir, "part"), "p_size", numeric=True)


@query("""WITH f AS (SELECT p_brand, p_size, min_by(p_partkey, p_partkey) AS first_key, min_by(p_name, p_partkey) AS first_name FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, first_key, first_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f USING (p_brand, p_size)""")
def keyed_lookup_first(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "p_size")
    catalogue = part.select("p_brand", "p_size", F.col("p_partkey").alias("first_key"), F.col("p_name").alias("first_name"))
    return lookup.first_match(asked, catalogue, ["p_brand", "p_size"], "first_key").drop("p_brand", "p_size")


@query("""WITH c AS (SELECT p_partkey, lower(concat_ws(' ', p_name, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_type || ' ' || p_brand END)) AS label FROM part),
q AS (SELECT p_partkey AS request, lower(split_part(p_name, ' ', 1)) AS s, lower(split_part(p_name, ' ', 2)) AS k, lower(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END) AS n, p_partkey % 5 = 0 AS b FROM part),
t1 AS (SELECT request, min(p_partkey) AS r FROM q JOIN c ON label = s || ' ' || k || ' ' || n || CASE WHEN b THEN ' bundled' ELSE '' END GROUP BY ALL),
t2 AS (SELECT request, min(p_partkey) AS r FROM q JOIN c ON label = s || ' ' || k || ' ' || n GROUP BY ALL),
u AS (SELECT label, min(p_partkey) AS p_partkey FROM c GROUP BY label),
t3 AS (SELECT request, min(p_partkey) AS r FROM q JOIN u ON contains(label, s) AND contains(label[instr(label, s) + length(s) :], k)
  AND contains(label[instr(label, s) + length(s) :][instr(label[instr(label, s) + length(s) :], k) + length(k) :], n) GROUP BY ALL)
SELECT q.request, CASE WHEN t1.r IS NOT NULL THEN 1 WHEN t2.r IS NOT NULL THEN 2 WHEN t3.r IS NOT NULL THEN 3 END::INTEGER AS tier, coalesce(t1.r, t2.r, t3.r) AS p_partkey
FROM q LEFT JOIN t1 USING (request) LEFT JOIN t2 USING (request) LEFT JOIN t3 USING (request)""")
def tiered_fuzzy_match(spark, sf_dir):
    """Requests by colour, thing and type or brand, a fifth of them marked as bundled, against labels of three layouts."""
    part = table(spark, sf_dir, "part")
    rest = F.expr("case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then p_brand else concat(p_type, ' ', p_brand) end")
    labels = part.select("p_partkey", F.concat_ws(" ", "p_name", rest).alias("label"))
    labels = labels.groupBy("label").agg(F.min("p_partkey").alias("p_partkey"))  # as only the first row of a label can be the answer
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    name = F.expr("concat(case when p_partkey % 2 = 0 then p_type else p_brand end, case when p_partkey % 5 = 0 then ' Bundled' else '' end)")
    asked = part.select(F.col("p_partkey").alias("request"), word(1).alias("size"), word(2).alias("kind"), name.alias("name"))
    return lookup.tiered_match(asked, labels, "request", "size", "kind", "name", "label", "p_partkey")


@query("SELECT l_orderkey, l_linenumber, round(1.732 * l_quantity * (l_extendedprice / 100) / 1000, 2) AS mva, round(l_tax * l_quantity, 4) AS r, round(l_discount * l_quantity, 4) AS x FROM lineitem")
def unit_scaling(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", lookup.mva(q, F.col("l_extendedprice") / 100).alias("mva"), _r(F.col("l_tax") * q, 4).alias("r"), _r(F.col("l_discount") * q, 4).alias("x"))


@query("""SELECT p_partkey, concat('BRANCH', ',', p_partkey, ',', p_size, ',1', repeat(',', 7), p_size, ',', p_size + 1, ',', p_size + 2, repeat(',', 17),
array_to_string([p_size, p_size, p_size, p_size, p_size, p_size, p_size, p_size, p_size, p_size, p_size, p_size], ','), ';') AS line FROM part""")
def format_record(spark, sf_dir):
    size = F.col("p_size")
    line = tx.record("BRANCH", F.col("p_partkey"), size, F.lit(1), size, size + 1, size + 2, F.array_repeat(size, 12))
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN concat_ws(' ', p_size, CASE WHEN contains(p_type, 'EC') THEN 'ECO' ELSE p_type END, upper(b[1]) || b[2:])
ELSE concat_ws(' ', p_size, 'x2', CASE WHEN contains(p_type, 'EC') THEN 'ECO' ELSE p_type END, upper(b[1]) || b[2:], 'Bundled') END AS name FROM (SELECT *, lower(p_brand) AS b FROM part)""")
def normalise_name(spark, sf_dir):
    raw = F.concat_ws(" ", F.concat(F.col("p_size").cast("string"), F.lit(".0")), F.lit("3"), "p_type", "p_brand")
    name = tx.conductor_name(raw, F.when(F.col("p_size") % 2 == 1, 1).otherwise(2), {}, {"EC": "ECO"}, {})
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (TRY_CAST(k AS INTEGER) IS NULL) AS rejected, sum(TRY_CAST(k AS INTEGER))::BIGINT AS total
FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 11 = 0 THEN 'not used' ELSE regexp_extract(props, '(\\d+)', 1) END AS k FROM events) GROUP BY ALL""".replace("\\\\d", "\\d"))
def cast_validate(spark, sf_dir):
    k = F.expr("case when event_id % 7 = 0 then ' ' when event_id % 11 = 0 then 'not used' else regexp_extract(props, '([0-9]+)', 1) end")
    good, bad = lookup.checked(table(spark, sf_dir, "events").select("event_type", k.alias("k")), {"k": "int"})
    rows = good.select("event_type", "k", F.lit(0).alias("bad")).unionByName(bad.select("event_type", F.lit(None).cast("int").alias("k"), F.lit(1).alias("bad")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("bad").alias("rejected"), F.sum("k").alias("total"))


# Evaluation: quality is the truth, not toxic the prediction; prices are scores


@query("SELECT label, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS code, n FROM (SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL)")
def label_encode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(ev.label_of("l_returnflag", "l_linestatus").alias("label"))
    return ev.encoded(rows, "label").groupBy("label", "code").agg(F.count("*").alias("n")).select("label", "code", "n")


_Z = ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS z_{c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(f"SELECT l_orderkey, l_linenumber, {_Z} FROM lineitem")
def standardize_pop(spark, sf_dir):
    cs = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return ev.standardised(table(spark, sf_dir, "lineitem"), cs).select("l_orderkey", "l_linenumber", *[_r(f"z_{c}").alias(f"z_{c}") for c in cs])


_PLACED = "p AS (SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY quality ORDER BY md5({0} || ':' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY quality) AS n FROM labels)"
_FOLDS = _PLACED.format(42)


@query(" UNION ALL ".join(f"(WITH {_PLACED.format(42 + r)} SELECT doc_id, quality, {r}::INTEGER AS repeat, (place % 5)::INTEGER AS fold FROM p)" for r in range(3)))
def strat_folds(spark, sf_dir):
    return ev.stratified_folds(table(spark, sf_dir, "labels"), D, "quality", 5, 3).select(D, "quality", "repeat", "fold")


@query(f"WITH {_FOLDS} SELECT doc_id, place < floor(n * 0.7) AS in_train FROM p")
def stratified_split(spark, sf_dir):
    return ev.stratified_split(table(spark, sf_dir, "labels"), D, "quality").select(D, "in_train")


@query("SELECT CASE WHEN ('0x' || md5('42:' || o_custkey)[1:6])::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM orders GROUP BY ALL")
def group_split_semi(spark, sf_dir):
    a, b = ev.group_split(table(spark, sf_dir, "orders"), "o_custkey")
    rows = a.select(F.lit("train").alias("part"), "o_custkey").unionByName(b.select(F.lit("test").alias("part"), "o_custkey"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("groups"))


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(D, F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"))


_JUDGED = "j AS (SELECT doc_id, quality AS truth, 1 - toxic AS pred FROM labels)"


@query(f"WITH {_JUDGED} SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM j GROUP BY truth")
def confusion_matrix(spark, sf_dir):
    return ev.confusion(_judged(spark, sf_dir), "truth", "pred", [0, 1])


_COUNTS = "count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn, count(*) FILTER (truth = 0 AND pred = 0) AS tn, count(*) AS n"
_MEASURES = "n, round((tp + tn) / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0)) / 2, 6) AS macro_f1"
_NAMES_OF = ("accuracy", "precision", "recall", "f1", "macro_f1")


@query(f"WITH {_JUDGED}, c AS (SELECT {_COUNTS} FROM j) SELECT {_MEASURES} FROM c")
def binary_metrics(spark, sf_dir):
    return _judged(spark, sf_dir).agg(*ev.binary_measures("truth", "pred")).select("n", *[_r(c).alias(c) for c in _NAMES_OF])


@query(f"""WITH {_JUDGED}, l AS (SELECT truth AS label FROM j UNION SELECT pred FROM j),
c AS (SELECT label, (SELECT count(*) FROM j WHERE truth = label AND pred = label) AS hit, (SELECT count(*) FROM j WHERE pred = label) AS said, (SELECT count(*) FROM j WHERE truth = label) AS support FROM l)
SELECT label, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * hit / nullif(said + support, 0), 0), 6) AS f1, support FROM c""")
def class_report(spark, sf_dir):
    return ev.class_report(_judged(spark, sf_dir), "truth", "pred").select("label", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


_FOLD_MEASURES = f"WITH {_FOLDS}, j AS (SELECT (place % 5)::INTEGER AS fold, quality AS truth, 1 - toxic AS pred FROM p), c AS (SELECT fold, {_COUNTS} FROM j GROUP BY fold), m AS (SELECT fold, {_MEASURES} FROM c)"


def _fold_measures(spark, sf_dir):
    folds = ev.stratified_folds(table(spark, sf_dir, "labels"), D, "quality").select("fold", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"))
    return folds.groupBy("fold").agg(*ev.binary_measures("truth", "pred")).select("fold", "n", *[_r(c).alias(c) for c in _NAMES_OF])


@query(_FOLD_MEASURES + " SELECT round(avg(accuracy), 5) AS mean_accuracy, round(stddev_samp(accuracy), 5) AS sd_accuracy, round(avg(f1), 5) AS mean_f1, round(stddev_samp(f1), 5) AS sd_f1, count(*) AS folds FROM m")
def fold_mean_std(spark, sf_dir):
    m = _fold_measures(spark, sf_dir)
    return m.agg(*[_r(f(c), 5).alias(f"{n}_{c}") for c in ("accuracy", "f1") for n, f in (("mean", F.avg), ("sd", F.stddev_samp))], F.count("*").alias("folds"))


@query(_FOLD_MEASURES + " SELECT max_by(fold, (accuracy, -fold)) AS best_fold, max(accuracy) AS accuracy, min_by(fold, (f1, fold)) AS worst_fold FROM m")
def best_model(spark, sf_dir):
    return _fold_measures(spark, sf_dir).agg(F.max_by("fold", F.struct("accuracy", -F.col("fold"))).alias("best_fold"), F.max("accuracy").alias("accuracy"), F.min_by("fold", F.struct("f1", "fold")).alias("worst_fold"))


@query(_FOLD_MEASURES + " SELECT round(min(accuracy), 5) AS q0, round(quantile_cont(accuracy, 0.25), 5) AS q1, round(quantile_cont(accuracy, 0.5), 5) AS q2, round(quantile_cont(accuracy, 0.75), 5) AS q3, round(max(accuracy), 5) AS q4 FROM m")
def fold_quartiles(spark, sf_dir):
    q = _fold_measures(spark, sf_dir).agg(F.percentile("accuracy", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    return q.select(*[_r(F.element_at("q", i + 1), 5).alias(f"q{i}") for i in range(5)])


@query("SELECT source, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source HAVING count(DISTINCT quality) >= 2")
def single_class_guard(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select(D, "source"), D)
    return j.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("quality").alias("classes")).where("classes >= 2").drop("classes")


_SCORED = "d AS (SELECT l_returnflag AS g, round(l_discount + l_tax, 2) AS score, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS truth FROM lineitem)"


@query(f"""WITH {_SCORED}, a AS (SELECT g, score, count(*) AS n, sum(truth) AS pos FROM d GROUP BY ALL),
c AS (SELECT g, score, sum(n) OVER w AS said, sum(pos) OVER w AS hit, sum(pos) OVER (PARTITION BY g) AS pos FROM a WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT g, score, round(2 * (hit / said) * coalesce(hit / nullif(pos, 0), 0) / (hit / said + coalesce(hit / nullif(pos, 0), 0) + 1e-12), 9) AS f1 FROM c)
SELECT g, max_by(score, (f1, -score)) AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY g""")
def pr_best_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), _r(F.col("l_discount") + F.col("l_tax"), 2).alias("score"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("truth"))
    curve = ev.pr_curve(rows, "truth", "score", "g").withColumn("f1", _r("f1", 9))
    return ev.best_threshold(curve, "g").withColumn("f1", _r("f1"))


@query("WITH g AS (SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY ALL) SELECT label, n, round((1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (), 6) AS weight FROM g")
def class_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(ev.label_of("l_returnflag", "l_linestatus").alias("label"))
    return ev.class_weights(rows, "label").select("label", "n", _r("weight").alias("weight"))


@query("SELECT l_returnflag, round(avg(pow(1 - exp(-ce), 2) * ce), 6) AS loss FROM (SELECT l_returnflag, -(CASE WHEN l_linestatus = 'O' THEN 0.4 ELSE 0.6 END) * ln(0.01 + l_discount * 5) AS ce FROM lineitem) GROUP BY ALL")
def focal_loss(spark, sf_dir):
    loss = ev.focal_loss(0.01 + F.col("l_discount") * 5, F.when(F.col("l_linestatus") == "O", 0.4).otherwise(0.6))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(_r(loss).alias("loss"))


# Graphs: suppliers and parts are nodes, order lines edges, line numbers scenarios


def _edges(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linenumber").alias("scenario"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"), "l_quantity", "l_discount")


def _nodes(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ends = e.select("scenario", F.col("src").alias("node"), "l_quantity", "l_discount").unionByName(e.select("scenario", F.col("dst").alias("node"), "l_quantity", "l_discount"))
    return ends.groupBy("scenario", "node").agg(F.sum("l_quantity").alias("load"), F.avg("l_discount").alias("discount"))


_EDGES = "e AS (SELECT l_linenumber AS scenario, 'P' || l_partkey AS src, 'S' || l_suppkey AS dst, l_quantity, l_discount FROM lineitem)"
_NODES = _EDGES + ", v AS (SELECT scenario, node, sum(l_quantity) AS load, avg(l_discount) AS discount FROM (SELECT scenario, src AS node, l_quantity, l_discount FROM e UNION ALL SELECT scenario, dst, l_quantity, l_discount FROM e) GROUP BY ALL)"
_SYM = _NODES + ", y AS (SELECT scenario, src, dst FROM e UNION SELECT scenario, dst, src FROM e)"


@query(f"WITH {_NODES} SELECT scenario, node, flag::INTEGER AS flag, (flag & 1)::INTEGER AS voltage_class, ((flag >> 1) & 1)::INTEGER AS thermal_class, (flag > 0)::INTEGER AS combined FROM (SELECT *, CASE WHEN round(1 + discount - 0.05, 6) < 0.99 OR round(1 + discount - 0.05, 6) > 1.01 THEN 1 ELSE 0 END + CASE WHEN load > 100 THEN 2 ELSE 0 END AS flag FROM v)")
def alarm_flags(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("flag", gr.alarm_flags(_r(1 + F.col("discount") - 0.05), F.col("load"), 0.99, 1.01))
    return n.withColumns(gr.classes_of(F.col("flag"))).select("scenario", "node", "flag", "voltage_class", "thermal_class", "combined")


@query(f"WITH {_NODES} SELECT v.scenario, v.node, coalesce(t.added, 0)::DOUBLE AS added FROM v LEFT JOIN (SELECT scenario, src AS node, sum(l_quantity) AS added FROM e GROUP BY ALL) t USING (scenario, node)")
def scatter_add_join(spark, sf_dir):
    loads = _edges(spark, sf_dir).select("scenario", F.col("src").alias("node"), "l_quantity")
    return gr.scatter_add(_nodes(spark, sf_dir), loads, "l_quantity", "added").select("scenario", "node", "added")


@query(f"WITH {_NODES}, x AS (SELECT scenario, src AS node FROM e WHERE l_quantity >= 45 UNION SELECT scenario, dst FROM e WHERE l_quantity >= 45) SELECT v.scenario, v.node, (x.node IS NOT NULL)::INTEGER AS touched FROM v LEFT JOIN x USING (scenario, node)")
def endpoint_flag(spark, sf_dir):
    return gr.endpoint_flag(_nodes(spark, sf_dir), _edges(spark, sf_dir), F.col("l_quantity") >= 45).select("scenario", "node", "touched")


@query(f"WITH {_SYM} SELECT scenario, src AS node, count(*) AS degree FROM y WHERE src <> dst GROUP BY ALL")
def graph_degree(spark, sf_dir):
    return gr.degrees(_edges(spark, sf_dir))


@query(f"WITH {_NODES} SELECT e.scenario, e.src, e.dst, e.l_quantity, a.load AS src_load, b.load AS dst_load FROM e LEFT JOIN v a ON a.scenario = e.scenario AND a.node = e.src LEFT JOIN v b ON b.scenario = e.scenario AND b.node = e.dst")
def edge_index(spark, sf_dir):
    return gr.indexed_edges(_edges(spark, sf_dir).drop("l_discount"), _nodes(spark, sf_dir), "load").select("scenario", "src", "dst", "l_quantity", "src_load", "dst_load")


@query(f"""WITH {_SYM}, l AS (SELECT * FROM y WHERE src <> dst UNION ALL SELECT scenario, node, node FROM v), d AS (SELECT scenario, dst AS node, count(*) AS d FROM l GROUP BY ALL),
w AS (SELECT l.scenario, l.src, l.dst, 1 / sqrt(a.d * b.d) AS w FROM l JOIN d a ON a.scenario = l.scenario AND a.node = l.src JOIN d b ON b.scenario = l.scenario AND b.node = l.dst),
h1 AS (SELECT w.scenario, w.dst AS node, sum(w.w * v.load) AS x FROM w JOIN v ON v.scenario = w.scenario AND v.node = w.src GROUP BY ALL),
h2 AS (SELECT w.scenario, w.dst AS node, sum(w.w * h1.x) AS x FROM w JOIN h1 ON h1.scenario = w.scenario AND h1.node = w.src GROUP BY ALL)
SELECT scenario, node, round(x, 4) AS load FROM h2""")
def graph_propagate_2hop(spark, sf_dir):
    return gr.propagated(_nodes(spark, sf_dir), _edges(spark, sf_dir), ["load"]).withColumn("load", _r("load", 4))


@query(f"WITH {_NODES} SELECT scenario, count(*) FILTER (load > 100) AS positives, greatest(2, least(5, count(*) FILTER (load > 100)))::INTEGER AS splits FROM v GROUP BY scenario")
def split_counts(spark, sf_dir):
    """Folds that each scenario's overloaded nodes allow."""
    positives = F.count(F.when(F.col("load") > 100, 1))
    return _nodes(spark, sf_dir).groupBy("scenario").agg(positives.alias("positives"), ev.split_count(positives).alias("splits"))


@query(f"WITH {_NODES} SELECT scenario, count(*) AS n, round(sum(load), 2) AS load FROM v WHERE scenario = 3 GROUP BY scenario")
def scenario_partition(spark, sf_dir):
    """One scenario of a table that is partitioned by scenario: only its folder is read."""
    from gridloom.plans.folders import shared_folder

    path = shared_folder(spark, "scenarios")
    _nodes(spark, sf_dir).write.partitionBy("scenario").parquet(path)
    rows = spark.read.schema("node string, load double, scenario int").parquet(path).where("scenario = 3")
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), _r(F.sum("load"), 2).alias("load"))


@query("SELECT n_name AS entity, s_suppkey AS number, s_name AS acronym, round(s_acctbal, 2)::VARCHAR AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def key_value_records(spark, sf_dir):
    """Supplier records written as blocks of named lines, a text for each nation, and read again."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    block = F.concat(F.lit("Entity: "), "n_name", F.lit("\nNumber: "), F.col("s_suppkey").cast("string"), F.lit("\nAcronym: "), "s_name", F.lit("\nBalance: "), F.round("s_acctbal", 2).cast("string"), F.lit("\n\nWhat is it? Answer: this.\n-----\n"))
    texts = s.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("text"))
    r = texts.select(F.explode(tx.key_value_records(F.col("text"))).alias("r"))
    return r.select(F.col("r")["Entity"].alias("entity"), F.col("r")["Number"].cast("long").alias("number"), F.col("r")["Acronym"].alias("acronym"), F.col("r")["Balance"].alias("balance"))


@query(f"WITH {_NODES} SELECT scenario, node || '__' || k AS node, load FROM v, (SELECT unnest(range(3)) AS k)")
def graph_replicate(spark, sf_dir):
    nodes, _ = gr.replicated(_nodes(spark, sf_dir), _edges(spark, sf_dir), 3)
    return nodes.select("scenario", "node", "load")


# Models and streams: beyond SQL, their inputs and measures are checked above


@query()
def gbt_forecast(spark, sf_dir):
    """The next 24 hours of each series by boosted trees on the series' features."""
    from gridloom.operators import ml

    from gridloom.plans.folders import staged

    rows = staged(ts.features(_series(spark, sf_dir)), "features")
    model = ml.load_model(rows)
    return ts.forecast(model, rows, 24).select("series", "ts", _r("prediction").alias("prediction"))


@query()
def fault_models_cv(spark, sf_dir):
    """Mean accuracy of each classifier over five stratified folds; the class of an order line from its numbers."""
    from gridloom.operators import ml

    li = table(spark, sf_dir, "lineitem").withColumns({"key": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "fault": ev.label_of("l_returnflag", "l_linestatus")})
    coded = ev.encoded(li, "fault", "label").withColumn("label", F.col("label").cast("double"))
    folds = ev.stratified_folds(coded, "key", "label", 5).select("label", "fold", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    features, classes = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], li.select("fault").where("fault is not null").distinct().count()
    return ml.fold_accuracies(folds, features, ml.classifiers(len(features), classes)).groupBy("model").agg(_r(F.avg("accuracy")).alias("accuracy"), F.count("*").alias("folds"))


@query()
def sgc_alarm_model(spark, sf_dir):
    """Alarm probability of every node from features propagated over two hops; scenarios 1 to 5 train."""
    from pyspark.ml.functions import vector_to_array

    from gridloom.operators import ml
    from gridloom.plans.folders import staged

    nodes, edges = staged(_nodes(spark, sf_dir), "nodes"), _edges(spark, sf_dir)
    flag = gr.alarm_flags(_r(1 + F.col("discount") - 0.05), F.col("load"), 0.99, 1.01)
    x = gr.propagated(nodes, edges, ["load", "discount"])
    rows = x.join(nodes.select("scenario", "node", (flag > 0).cast("double").alias("label")), ["scenario", "node"])
    rows = staged(rows, "propagated")
    model = ml.alarm_model(rows.where("scenario <= 5"), ["load", "discount"])
    p = F.element_at(vector_to_array("probability"), 2)
    return model.transform(rows).select("scenario", "node", F.col("label").cast("int").alias("label"), _r(p).alias("probability"))


_NET = {"inputs": 2, "hidden": 3}


def _net():
    """A network of three hidden units with fixed weights."""
    import numpy as np

    from gridloom.operators import convolution as cv

    net = cv.Network(**_NET)
    return net, np.round(np.sin(1.0 + np.arange(net.size())), 3)


def _gcn_sql() -> str:
    """Two convolutions and the head over the normalised edges, column by column."""
    net, weights = _net()
    w1, b1, w2, b2, w3, b3 = net.parts(weights)
    lin = lambda w, b, x, j: f"{b[j]} + " + " + ".join(f"{x}{i} * ({w[i, j]})" for i in range(len(w)))
    hidden = lambda w, b, x: ", ".join(f"greatest({lin(w, b, x, j)}, 0) AS h{j}" for j in range(net.hidden))
    step = lambda of, cols: f"SELECT w.scenario, w.dst AS node, {', '.join(f'sum(w.w * {of}.{c}) AS {c}' for c in cols)} FROM w JOIN {of} ON {of}.scenario = w.scenario AND {of}.node = w.src GROUP BY ALL"
    return f"""WITH {_SYM}, l AS (SELECT * FROM y WHERE src <> dst UNION ALL SELECT scenario, node, node FROM v), d AS (SELECT scenario, dst AS node, count(*) AS d FROM l GROUP BY ALL),
w AS (SELECT l.scenario, l.src, l.dst, 1 / sqrt(a.d * b.d) AS w FROM l JOIN d a ON a.scenario = l.scenario AND a.node = l.src JOIN d b ON b.scenario = l.scenario AND b.node = l.dst),
x AS (SELECT scenario, node, load / 100 AS x0, discount * 10 AS x1 FROM v), p AS ({step('x', ['x0', 'x1'])}), f AS (SELECT scenario, node, {hidden(w1, b1, 'x')} FROM p),
q AS ({step('f', [f'h{j}' for j in range(net.hidden)])}), s AS (SELECT scenario, node, {hidden(w2, b2, 'h')} FROM q)
SELECT scenario, node, {', '.join(f'round({lin(w3, b3, "h", j)}, 5) AS logit_{j}' for j in range(2))} FROM s"""


def _gcn_inputs(spark, sf_dir):
    return _nodes(spark, sf_dir).select("scenario", "node", (F.col("load") / 100).alias("x0"), (F.col("discount") * 10).alias("x1"))


@query(_gcn_sql())
def gcn_forward(spark, sf_dir):
    """Two convolutions with ReLU and a linear head over every node, with fixed weights."""
    from gridloom.operators import convolution as cv
    from gridloom.plans.folders import staged

    net, weights = _net()
    nodes = _gcn_inputs(spark, sf_dir)
    out = cv.forward_over_pairs(net, weights, nodes, staged(gr.links(_edges(spark, sf_dir)), "links"), ["x0", "x1"])
    return out.select("scenario", "node", _r("logit_0", 5).alias("logit_0"), _r("logit_1", 5).alias("logit_1"))


def _alarm_graph(spark, sf_dir):
    """Nodes with standardised features and the combined alarm, and the normalised edges. Scenarios 1 to 5 give the statistics."""
    from gridloom.plans.folders import staged

    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    flag = gr.alarm_flags(_r(1 + F.col("discount") - 0.05), F.col("load"), 0.99, 1.01)
    rows = nodes.withColumns(gr.classes_of(flag)).withColumn("key", F.concat_ws("-", "scenario", "node"))
    rows = gr.target_of(rows, "combined")
    return staged(ev.standardised(rows, ["load", "discount"], rows.where("scenario <= 5")), "nodes"), gr.normalised(nodes, edges)


@query()
def gcn_alarm_model(spark, sf_dir):
    """Alarm probability and verdict of every node by a trained network (300 epochs, best one kept); scenarios 1 to 5 train and choose the threshold, split 70 to 30 by label."""
    from gridloom.operators import convolution as cv

    nodes, edges = _alarm_graph(spark, sf_dir)
    own = nodes.where("scenario <= 5")
    rows = ev.stratified_split(own, "key", "target").withColumn("fold", F.when(F.col("in_train"), 1).otherwise(0))
    features = ["z_load", "z_discount"]
    net = cv.Network(2)
    blocks, parts = cv.graph_blocks(rows, edges.where("scenario <= 5"), features, "target", ["fold"])
    fitted = cv.trained(net, blocks, parts, [(0, 0)], 1)
    p = cv.probabilities(net, fitted.best[0], nodes, edges, features).join(nodes.select("scenario", "node", F.col("target").alias("label")), ["scenario", "node"])
    judged = rows.where("fold = 0").select("scenario", "node", F.lit(1).alias("g")).join(p, ["scenario", "node"])
    limit = ev.best_threshold(ev.pr_curve(judged, "label", "probability", "g"), "g").first()
    threshold = limit["threshold"] if limit else 0.5
    return p.select("scenario", "node", "label", _r("probability", 4).alias("probability"), (F.col("probability") >= threshold).cast("int").alias("alarm"))


def _customer_graph(spark, sf_dir):
    """Customers and nations are nodes, a market segment is a scenario, and each customer has an edge to its nation. A node's load is the value of its orders; it is overloaded above its segment's mean for nodes of its kind."""
    from gridloom.plans.folders import staged

    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1e6).alias("spent"))
    own = table(spark, sf_dir, "customer").join(spent, "c_custkey", "left").select(F.col("c_mktsegment").alias("scenario"), F.concat(F.lit("C"), "c_custkey").alias("src"), F.concat(F.lit("N"), "c_nationkey").alias("dst"), F.coalesce("spent", F.lit(0.0)).alias("spent"), "c_acctbal")
    own = staged(own, "customers")
    ends = [own.select("scenario", F.col(end).alias("node"), "spent", "c_acctbal") for end in ("src", "dst")]
    nodes = ends[0].unionByName(ends[1]).groupBy("scenario", "node").agg(F.sum("spent").alias("load"), F.avg("c_acctbal").alias("balance"))
    kind = F.substring("node", 1, 1).alias("kind")
    means = nodes.groupBy("scenario", kind).agg(F.avg("load").alias("mean"))
    rows = nodes.select("*", kind).join(F.broadcast(means), ["scenario", "kind"])  # two rows a segment
    rows = rows.select("scenario", "node", F.concat_ws("-", "scenario", "node").alias("key"), "load", "balance", (F.col("load") > F.col("mean")).cast("int").alias("alarm_flag"))
    return staged(ev.standardised(gr.target_of(rows, "thermal_class"), ["load", "balance"]), "nodes"), gr.normalised(nodes, own.select("scenario", "src", "dst"))


@query()
def gcn_cross_validation(spark, sf_dir):
    """Measures of every fold of a five-fold cross-validation in three repeats at its best threshold: fifteen networks of 200 epochs, trained in the same passes."""
    from gridloom.operators import convolution as cv

    nodes, edges = _customer_graph(spark, sf_dir)
    return cv.cross_validated(cv.Network(2), nodes, edges, ["z_load", "z_balance"], "target", "key").select(
        "repeat", "fold", "n", *[_r(c, 4).alias(c) for c in ("threshold", "accuracy", "precision", "recall", "f1", "val_loss")])


_FRONTIER = """WITH q AS (SELECT item_id, unnest(range(1, len(ts) + 1)) - 1 AS task_no, unnest(ts) AS task FROM (
  SELECT item_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', chr(10)), chr(10)), lambda x: trim(x, '- ')), lambda x: x <> '')[:200] AS ts FROM benchmark)),
k AS (SELECT item_id * 1000 + task_no AS task_id, item_id, task_no, task, e.embedding::DOUBLE[] AS a FROM q JOIN embeddings e ON e.vec_id = (item_id * 13 + task_no) % 500),
h AS (SELECT task_id, c.label, row_number() OVER (PARTITION BY task_id ORDER BY round(coalesce(list_cosine_similarity(a, c.embedding::DOUBLE[]), 0), 9) DESC, c.vec_id) AS rank FROM k, embeddings c WHERE c.embedding IS NOT NULL),
t AS (SELECT task_id, coalesce(min(rank) FILTER (label < 5), 4) AS tries FROM h WHERE rank <= 4 GROUP BY task_id)
SELECT k.item_id, k.task_no::INTEGER AS task_no, CASE WHEN h.label < 5 THEN 'done' ELSE 'failed' END AS state, t.tries::INTEGER AS tries, 'call_' || h.label AS result, CASE WHEN h.label < 5 THEN '' ELSE h.label::VARCHAR END AS invalid
FROM k JOIN t USING (task_id) JOIN h ON h.task_id = t.task_id AND h.rank = t.tries"""


@query(_FRONTIER)
def agent_frontier(spark, sf_dir):
    """Tasks from the sentences of each benchmark item, tried up to four times: try n takes the n-th of the retrieved chunks, and labels below five are the valid names."""
    from gridloom.operators import agents

    plans = table(spark, sf_dir, "benchmark").select("item_id", F.replace(F.col("text"), F.lit(". "), F.lit("\n")).alias("plan"))
    tasks = agents.planned_tasks(plans, "item_id").withColumn("task_id", F.col("item_id") * 1000 + F.col("task_no"))
    e = table(spark, sf_dir, "embeddings")
    tasks = tasks.withColumn("vec_id", (F.col("item_id") * 13 + F.col("task_no")) % 500).join(e.select("vec_id", "embedding"), "vec_id").drop("vec_id")
    chunks = e.select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("call_"), F.col("label").cast("string")).alias("text"))

    def execute(todo: DataFrame) -> DataFrame:
        return todo.select("task_id", F.try_element_at(F.split("context", "\n\n---\n\n"), F.col("tries") + 1).alias("result"))

    valid = e.where("label < 5").select(F.col("label").cast("string").alias("name"))
    done = agents.frontier(tasks, "task_id", lambda t: agents.with_context(t, chunks, "task_id", 4, digits=9), execute, lambda c: agents.names_used(c, r"call_(\w+)"), valid)
    return done.select("item_id", "task_no", "state", "tries", "result", F.array_join("invalid", ",").alias("invalid"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total, len(embedding)::INTEGER AS dim FROM embeddings WHERE embedding IS NOT NULL")
def matrix_round_trip(spark, sf_dir):
    """The vectors as a matrix file in parts and their ids as the JSON array of chunks beside it, read back row by row."""
    from gridloom.plans.folders import shared_folder
    from gridloom.sources import matrix

    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    path = shared_folder(spark, "matrix")
    matrix.write_matrix(e, "embedding", "vec_id", f"{path}/vectors", 4)
    ids = e.agg(F.to_json(F.transform(F.array_sort(F.collect_list("vec_id")), lambda x: F.struct(x.cast("string").alias("text")))).alias("value"))  # a JSON array is one row
    ids.coalesce(1).write.text(f"{path}/chunks")
    rows = matrix.read_indexed_chunks(spark, f"{path}/vectors", f"{path}/chunks")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("row", F.col("text").cast("long").alias("vec_id"), _r(total, 5).alias("total"), F.size("embedding").alias("dim"))


@query("SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf_dir):
    """Hourly counts by a stream over the events file."""
    from gridloom.plans.folders import shared_folder
    from gridloom.streaming.events import hourly_counts, run_to_table

    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may match a file or a folder
    out = run_to_table(spark, hourly_counts(stream), shared_folder(spark, "stream"))
    last = out.groupBy("event_type", "ts").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("event_type", "ts", "s.n", _r("s.total", 4).alias("total"))


@query()
def embed_search(spark, sf_dir):
    """The five documents nearest to each benchmark item by hashed TF-IDF vectors."""
    from gridloom.operators import embedding

    docs = table(spark, sf_dir, "documents").select(F.col(D).alias("vec_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text")
    model = embedding.fit_tfidf(docs)
    hits = retrieval.top_k(embedding.embed_tfidf(docs, model), embedding.embed_tfidf(items, model), 5, digits=6)
    return hits.select(F.col("query").alias("item_id"), F.col("id").alias(D), _r("score", 4).alias("score"), "rank")


@query()
def semantic_search(spark, sf_dir):
    """The five documents nearest to each benchmark item by learned vectors: 64 leading directions of the TF-IDF table."""
    from gridloom.operators import semantic

    docs = table(spark, sf_dir, "documents").select(F.col(D).alias("vec_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id"), "text")
    model = semantic.fit(docs)
    hits = retrieval.top_k(model.embedded(docs), model.embedded(items), 5, digits=6)
    return hits.select(F.col("query").alias("item_id"), F.col("id").alias(D), _r("score", 4).alias("score"), "rank")


@query()
def token_count_bpe(spark, sf_dir):
    """Exact token counts of every document under a byte-pair vocabulary."""
    import public_tokenizers

    docs = splitter.bpe_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select(D, "tokens")


@query("SELECT l_returnflag AS label, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN (SELECT l_linestatus FROM lineitem WHERE l_linestatus IS NOT NULL) GROUP BY l_returnflag")
def unseen_labels(spark, sf_dir):
    """Truth labels that no prediction has; none would mean that the labels are a subset."""
    t = table(spark, sf_dir, "lineitem")
    seen = t.select(F.col("l_linestatus").alias("label")).where("label is not null").distinct()
    return t.select(F.col("l_returnflag").alias("label")).join(seen, "label", "left_anti").groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE upper(o_orderstatus) = upper('o')")
def open_orders(spark, sf_dir):
    """Orders of a status but for case."""
    return trading.with_status(table(spark, sf_dir, "orders"), "o_orderstatus", "o").select("o_orderkey", "o_orderstatus")


@query("""WITH m AS (SELECT l_returnflag AS model, avg(l_discount) AS cv FROM lineitem GROUP BY ALL), h AS (SELECT l_returnflag AS model, avg(l_tax) AS held FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT model, round(cv, 6) AS cv, round(coalesce(held, 0), 6) AS held FROM m LEFT JOIN h USING (model)""")
def paired_metrics(spark, sf_dir):
    """Two measures side by side by model, 0 where the second is missing."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "model")
    held = li.where("model <> 'N'").groupBy("model").agg(F.avg("l_tax").alias("held"))
    both = li.groupBy("model").agg(F.avg("l_discount").alias("cv")).join(held, "model", "left")
    return both.select("model", _r("cv").alias("cv"), _r(F.coalesce("held", F.lit(0.0))).alias("held"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def all_orders(spark, sf_dir):
    """Orders of any status: the filter that asks for all."""
    return trading.with_status(table(spark, sf_dir, "orders"), "o_orderstatus", "all").select("o_orderkey", "o_orderstatus")


@query(f"""WITH {_JUDGED}, l AS (SELECT truth AS label FROM j UNION SELECT pred FROM j),
c AS (SELECT label, (SELECT count(*) FROM j WHERE truth = label AND pred = label) AS hit, (SELECT count(*) FROM j WHERE pred = label) AS said, (SELECT count(*) FROM j WHERE truth = label) AS support FROM l),
r AS (SELECT coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r, coalesce(2 * hit / nullif(said + support, 0), 0) AS f, support FROM c)
SELECT 'macro' AS average, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, sum(support)::BIGINT AS support FROM r
UNION ALL SELECT 'weighted', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), sum(support)::BIGINT FROM r""")
def class_report_averages(spark, sf_dir):
    out = ev.report_averages(ev.class_report(_judged(spark, sf_dir), "truth", "pred"))
    return out.select("average", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("""WITH d AS (SELECT l_returnflag AS g, round(l_discount + l_tax, 2) AS score, CASE WHEN l_quantity > 25 AND l_returnflag <> 'N' THEN 1 ELSE 0 END AS truth FROM lineitem),
a AS (SELECT g, score, count(*) AS n, sum(truth) AS pos FROM d GROUP BY ALL), c AS (SELECT g, score, sum(n) OVER w AS said, sum(pos) OVER w AS hit, sum(pos) OVER (PARTITION BY g) AS pos FROM a WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
f AS (SELECT g, score, round(2 * (hit / said) * coalesce(hit / nullif(pos, 0), 0) / (hit / said + coalesce(hit / nullif(pos, 0), 0) + 1e-12), 9) AS f1 FROM c)
SELECT g, CASE WHEN max(f1) > 0 THEN max_by(score, (f1, -score)) ELSE 0.5 END AS threshold, round(max(f1), 6) AS f1 FROM f GROUP BY g""")
def pr_threshold_default(spark, sf_dir):
    """The best threshold of each group, 0.5 for the group without a positive row."""
    truth = F.when((F.col("l_quantity") > 25) & (F.col("l_returnflag") != "N"), 1).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), _r(F.col("l_discount") + F.col("l_tax"), 2).alias("score"), truth.alias("truth"))
    return ev.best_threshold(ev.pr_curve(rows, "truth", "score", "g").withColumn("f1", _r("f1", 9)), "g").withColumn("f1", _r("f1"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderdate <= TIMESTAMP '1995-12-31 23:00:00') AS train, count(*) FILTER (o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-06-30 00:00:00') AS test FROM orders GROUP BY ALL""")
def date_split(spark, sf_dir):
    """Rows to the last hour of a year, and those between two dates, both included."""
    orders = table(spark, sf_dir, "orders")
    train = ev.between_dates(orders, "o_orderdate", last="1995-12-31 23:00:00").select("o_orderpriority", F.lit(1).alias("a"), F.lit(0).alias("b"))
    test = ev.between_dates(orders, "o_orderdate", "1996-01-01 00:00:00", "1997-06-30 00:00:00").select("o_orderpriority", F.lit(0).alias("a"), F.lit(1).alias("b"))
    rest = orders.select("o_orderpriority", F.lit(0).alias("a"), F.lit(0).alias("b"))
    return train.unionByName(test).unionByName(rest).groupBy("o_orderpriority").agg(F.sum("a").alias("train"), F.sum("b").alias("test"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 < floor(count(*) OVER () * 0.8) AS in_train FROM labels")
def random_split(spark, sf_dir):
    return ev.random_split(table(spark, sf_dir, "labels"), D).select(D, "in_train")


@query("SELECT l_orderkey, l_linenumber, least(greatest(l_discount * 10, 0.05), 0.95) AS p FROM lineitem")
def clip_scores(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ev.clipped(F.col("l_discount") * 10, 0.05).alias("p"))


@query("""SELECT conv_id, -1::BIGINT AS turn, 'system' AS role, md5('You answer from the documents.') AS text FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, turn, role, md5(text) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6""")
def chat_history(spark, sf_dir):
    """The system row and the last six turns of every conversation."""
    rows = tx.with_system_row(table(spark, sf_dir, "conversations"), "conv_id", "turn", "You answer from the documents.", 6)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read with its schema."""
    from gridloom.plans.folders import shared_folder
    from gridloom.sources import readers, writers

    path = shared_folder(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int", ["n_name"])


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS mw FROM events GROUP BY ALL")
def series_round_trip(spark, sf_dir):
    """An hourly series written as a two-column CSV and read with its time layout."""
    from gridloom.plans.folders import shared_folder
    from gridloom.sources import readers, writers

    path = shared_folder(spark, "series")
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(_r(F.sum("value"), 4).alias("MW"))
    writers.write_csv(hours.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("Datetime"), "MW"), path)
    return readers.read_time_series(spark, path)


@query("SELECT l_returnflag AS metric, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY ALL")
def metrics_round_trip(spark, sf_dir):
    """Measures by name written as a JSON object and read back as rows."""
    from gridloom.plans.folders import shared_folder
    from gridloom.sources import readers, writers

    path = shared_folder(spark, "metrics")
    writers.write_metrics(table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(_r(F.avg("l_discount")).alias("value")), path)
    return readers.read_metrics(spark, path)


@query()
def fault_batch_scores(spark, sf_dir):
    """Code and name of the rows that the model has not seen: a forest of 100 trees with its scaler, saved and loaded."""
    from gridloom.operators import ml
    from gridloom.operators.forest import CellForest
    from gridloom.plans.folders import shared_folder, staged

    features, path = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], shared_folder(spark, "forest")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *features, key, ev.label_of("l_returnflag", "l_linestatus").alias("fault"))
    coded = ev.encoded(staged(ev.random_split(li, "key").drop("key"), "split"), "fault", "label").withColumn("label", F.col("label").cast("double"))
    forest = CellForest(numTrees=100, seed=42, labelCol="label", featuresCol="scaled")
    ml.save(ml.scaled_pipeline(features, forest).fit(coded.where("in_train")), path)
    names = coded.select(F.col("label").cast("int").alias("code"), F.col("fault").alias("name")).distinct()
    return ml.batch_scores(coded.where("not in_train").select("l_orderkey", "l_linenumber", "fault", *features), ml.load(path), names).drop(*features)


@query()
def balanced_baseline_cv(spark, sf_dir):
    """The measures of a balanced logistic regression on five stratified folds of nodes; an alarm from load and degree."""
    from gridloom.operators import ml
    from gridloom.plans.folders import staged

    nodes = _nodes(spark, sf_dir)
    flag = gr.alarm_flags(_r(1 + F.col("discount") - 0.05), F.col("load"), 0.99, 1.01)
    rows = nodes.withColumn("label", (flag > 0).cast("double")).join(gr.degrees(_edges(spark, sf_dir)), ["scenario", "node"])
    rows = staged(rows.select(F.concat_ws("-", "scenario", "node").alias("key"), "label", "load", "degree"), "nodes")
    return ml.balanced_cv(ev.stratified_folds(rows, "key", "label"), ["load", "degree"]).select("fold", "n", *[_r(c).alias(c) for c in _NAMES_OF])
