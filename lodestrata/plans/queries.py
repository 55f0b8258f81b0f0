"""Queries over the driver's tables, each with the same in DuckDB's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generic as G
from ..operators import ordered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n(name: str = "n"):  # noqa: ANN201
    return F.count(F.lit(1)).alias(name)


@query(r"""SELECT array_to_string(parts[1:i], '/') AS dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT parts, size, unnest(range(1, len(parts))) AS i FROM (SELECT string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS parts, length(html) AS size FROM pages)) GROUP BY 1""")
def a03_ancestor_rollup(spark, sf):
    pages = table(spark, sf, "pages").select(T.url_path(F.col("url")).alias("path"), F.char_length("html").alias("size"))
    return G.ancestor_rollup(pages, "path", "size")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS versions FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def a11_version_conflicts(spark, sf):
    items = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("version"))
    return G.conflicts(items, ["l_partkey"], "version").withColumn("versions", F.array_join("versions", ","))


def _nation_edges(spark, sf):
    """Supplier's nation to customer's, a row an order line. Small sides first; Spark broadcasts them by their sizes."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    return items.join(suppliers, "l_suppkey").join(orders.join(customers, "o_custkey"), "l_orderkey").select("src", "dst", F.lit(1).alias("weight"))


EDGES_SQL = "SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"SELECT src, dst, count(*) AS weight FROM ({EDGES_SQL}) WHERE src <> dst GROUP BY 1, 2")
def a22_module_edges(spark, sf):
    return G.contracted(_nation_edges(spark, sf))


@query("SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS nth FROM events QUALIFY nth <= 5")
def w01_cap_per_group(spark, sf):
    return G.cap_per_group(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"], 5, "nth").drop("ts")


@query("SELECT doc_id, source, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 300")
def w03_round_robin(spark, sf):
    return G.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], 300)


@query("""SELECT day, min(ts) AS first, max(ts) AS last, count(*) AS length FROM (
SELECT day, ts, hit, pos - row_number() OVER (PARTITION BY day, hit ORDER BY ts, event_id) AS run FROM (
SELECT CAST(ts AS DATE) AS day, ts, event_id, event_type = 'error' AS hit, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS pos FROM events))
WHERE hit GROUP BY day, run HAVING count(*) >= 2""")
def w06_islands(spark, sf):
    events = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", "event_type")
    return ordered.islands(events, F.col("event_type") == "error", ["ts", "event_id"], ["day"])


PREFIXES = ("/en", "/fr", "/de", "/es", "/en/1", "/en/2")


@query(f"""SELECT page_id, (SELECT max_by(p, length(p)) FROM (VALUES {", ".join(f"('{p}')" for p in PREFIXES)}) AS t(p) WHERE path = p OR starts_with(path, p || '/')) AS prefix
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def j13_longest_prefix(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1).alias("path"))
    prefixes = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return G.longest_prefix(pages, "path", prefixes, "prefix").select("page_id", "prefix")


@query("""SELECT event_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
SELECT event_id, c, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY event_id) AS p FROM (SELECT event_id, unnest(string_split(props, '')) AS c FROM events) WHERE c <> '' GROUP BY 1, 2) GROUP BY 1""")
def f12_entropy(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(T.entropy(F.col("props")), 6).alias("entropy"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9][\p{L}\p{N}_''-]*')) AS BIGINT) AS words, len(regexp_extract_all(text, '[A-Za-z0-9][\p{L}\p{N}_''-]*')) / 200.0::DOUBLE AS minutes FROM documents")
def f21_word_count(spark, sf):
    words = T.word_count(F.col("text")).cast("long")
    return table(spark, sf, "documents").select("doc_id", words.alias("words"), (words / F.lit(200.0)).alias("minutes"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_discount <= 0.05) AS d, count(DISTINCT l_partkey) AS p FROM lineitem GROUP BY 1),
s AS (SELECT l_suppkey, 100.0::DOUBLE * (30 * (1 - r * 1.0::DOUBLE / n) + 20 * (d * 1.0::DOUBLE / n)) / 50 AS quality, 100.0::DOUBLE * (40 * least(1.0::DOUBLE, p / 100.0::DOUBLE)) / 40 AS breadth FROM c)
SELECT l_suppkey, round(quality, 6) AS quality, round(breadth, 6) AS breadth, round((quality + breadth) / 2, 6) AS overall FROM s""")
def h_weighted_score(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(n(), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_discount") <= 0.05).alias("d"), F.count_distinct("l_partkey").alias("p"))
    check = lambda dimension, most, fraction: F.struct(F.lit(dimension).alias("dimension"), F.lit(most).alias("max_points"), fraction.alias("fraction"))
    checks = items.select("l_suppkey", F.explode(F.array(
        check("quality", 30.0, 1 - F.col("r") * F.lit(1.0) / F.col("n")),
        check("quality", 20.0, F.col("d") * F.lit(1.0) / F.col("n")),
        check("breadth", 40.0, F.col("p") / F.lit(100.0)))).alias("c")).select("l_suppkey", "c.*")
    wide = G.weighted_scores(checks, ["l_suppkey"]).groupBy("l_suppkey").pivot("dimension", ["quality", "breadth"]).agg(F.first("score"))
    return wide.select("l_suppkey", F.round("quality", 6).alias("quality"), F.round("breadth", 6).alias("breadth"), F.round((F.col("quality") + F.col("breadth")) / 2, 6).alias("overall"))


@query(f"""WITH e AS (SELECT src, dst, count(*) AS weight FROM ({EDGES_SQL}) WHERE src <> dst GROUP BY 1, 2),
t AS (SELECT node FROM (SELECT src AS node, sum(weight) AS w FROM e GROUP BY 1 ORDER BY w DESC, node LIMIT 10))
SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM t) AND dst IN (SELECT node FROM t)""")
def j18_induced_subgraph(spark, sf):
    edges = a22_module_edges(spark, sf)
    top = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("w")).orderBy(F.desc("w"), "node").limit(10)
    return G.induced_subgraph(edges, top)


BUDGET = 20_000


@query(f"""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT source, doc_id, i, CASE WHEN n_chars <= {BUDGET} THEN {BUDGET} - n_chars ELSE {BUDGET} END AS rest, n_chars <= {BUDGET} AS taken FROM d WHERE i = 1
UNION ALL SELECT d.source, d.doc_id, d.i, CASE WHEN d.n_chars <= f.rest THEN f.rest - d.n_chars ELSE f.rest END, d.n_chars <= f.rest FROM f JOIN d ON d.source = f.source AND d.i = f.i + 1)
SELECT source, doc_id FROM f WHERE taken""")
def s08_budget_fold(spark, sf):
    """A budget a source, spent on its documents in order of their ids."""
    from ..operators import selection

    docs = table(spark, sf, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("rank"), F.col("n_chars").alias("size"))
    return selection.within_budget(docs, BUDGET).select(F.col("repo_id").alias("source"), F.col("rank").alias("doc_id"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
SELECT user_id, event_id, i, [sec] AS hits, TRUE AS allowed, CAST(NULL AS BIGINT) AS retry_after FROM e WHERE i = 1
UNION ALL
SELECT user_id, event_id, i, CASE WHEN len(h) < 3 THEN list_append(h, sec) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN NULL ELSE CAST(greatest(1, ceil(43200 - (sec - h[1]))) AS BIGINT) END
FROM (SELECT e.user_id, e.event_id, e.i, e.sec, list_filter(r.hits, lambda x: e.sec - x < 43200) AS h FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT event_id, allowed, coalesce(retry_after, 0) AS retry_after FROM r""")
def w11_sliding_limit(spark, sf):
    """Three events a user in twelve hours; those denied don't count."""
    from ..streaming import limiter

    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), F.col("event_id").alias("seq"))
    return limiter.limited(events, 3, 43200.0).select(F.col("seq").alias("event_id"), "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


@query(ORACLE["w11_sliding_limit"])
def r04_stream(spark, sf):
    """The same limit on a stream: events in files by time, several batches, held in state until the watermark passes them."""
    from ..streaming import limiter
    from .shared import folder

    window, delay, source = 43200.0, 3600.0, folder(spark)
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), F.col("event_id").alias("seq"))
    limiter.dealt(events, source, 4, delay, window)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    limiter.run_to_end(limiter.limited_stream(stream, 3, window, delay), out := folder(spark), folder(spark))
    return spark.read.parquet(out).select(F.col("seq").alias("event_id"), "allowed", F.coalesce("retry_after", F.lit(0)).alias("retry_after"))


PATH = r"regexp_extract(url, '^https?://[^/?#]*/([^?#]*)', 1)"


@query(rf"SELECT page_id, CASE WHEN ends_with({PATH}, '.html') THEN 'HTML' END AS language, CASE WHEN ends_with({PATH}, '.html') THEN 'source' ELSE 'other' END AS category FROM pages")
def p07_classify(spark, sf):
    """Categories and languages of pages' paths."""
    from ..functions import paths as P

    path = F.regexp_extract("url", "^https?://[^/?#]*/([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", path.alias("path")).select("page_id", P.classified_language(F.col("path")).alias("language"), P.category(F.col("path")).alias("category"))


@query(rf"SELECT page_id, {PATH} <> '' AND len(list_filter(string_split({PATH}, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe FROM pages")
def p01_safe_path(spark, sf):
    from ..functions import paths as P

    return table(spark, sf, "pages").select("page_id", P.is_safe(F.regexp_extract("url", "^https?://[^/?#]*/([^?#]*)", 1)).alias("safe"))


@query("SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n = 1")
def w04_first_match(spark, sf):
    return G.cap_per_group(table(spark, sf, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"], 1)


@query("SELECT event_id, 'k' || CAST(json_extract(props, '$.n') AS VARCHAR) AS said, concat(CASE WHEN length(props) > 8 THEN left(props, 4) ELSE '' END, '********(', length(props), ' chars)') AS redacted FROM events")
def f11_redact(spark, sf):
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.n"))
    return table(spark, sf, "events").select("event_id", k.alias("said"), T.redact(F.col("props")).alias("redacted"))
