"""Decontamination: documents' words that lie in a window of a benchmark item, with DataFrame functions only.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. An item's windows are its runs of WINDOW
words, or all its words where there are fewer. The distinct windows are a hash set, broadcast where its counted rows are few
and shuffled to the documents' windows beyond that. A document's windows are hashed one by one and looked up; a hit is then
verified word by word, so hashes never decide. Each document also brings one mark that the set always holds, so those
without hits stay in the one pass over the texts, and only marks and hits are shuffled, dealt by document.

A passage that many documents share gives each of them its own few hits; a window that many items share is one row of the
set, and its items are joined to a document's distinct windows.

Defined results: a null or empty text, or one of separators only, has no words and no hits; so has a null or empty item;
null ids are kept (a null item_id is no item of the list, but its windows hit); repeated documents repeat, repeated items
count as one where their ids are equal; other columns are ignored by the report and kept by `removed`, whatever their names;
very long texts are scanned whole, held by one task (about 100 bytes a word); an empty table gives none, an empty benchmark
no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Windows that are broadcast, of some 150 bytes each; they are counted first.
MOST_BROADCAST = 500_000
SEPARATORS, LETTERS = (rf"[{no}\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+" for no in ("", "^"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The length of the mark that every document has.
MARK = 0


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def runs(of: str, length: int, whole: bool = False) -> Column:
    """(hash, at, length) of each window of the array of words named; whole: of any number of words, as one window."""
    n, size = F.size(of), F.lit(length)
    if whole:
        return F.array(F.struct(F.xxhash64(F.col(of)).alias("hash"), F.lit(1).alias("at"), n.alias("length")))
    one = lambda i: F.struct(F.xxhash64(F.slice(F.col(of), i, size)).alias("hash"), i.alias("at"), size.alias("length"))
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), n - (length - 1)), one)).otherwise(F.array().cast("array<struct<hash:bigint,at:int,length:int>>"))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """window_id, hash, length, key (the words) and item_ids' rows: one row a distinct window and item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    each = items.withColumn("w", F.explode(F.when(F.size("words") >= window, runs("words", window)).otherwise(runs("words", window, whole=True))))
    key = F.array_join(F.slice("words", F.col("w.at"), F.col("w.length")), " ")
    return each.select("w.hash", "w.length", key.alias("key"), "item_id").distinct()


def hits(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(row, text, ...) without text, with n_words, and a row for each verified hit: at (from 1), length, window_id;
    besides one row a document of length MARK."""
    lengths = [r["length"] for r in found.select("length").distinct().collect()]  # at most `window` numbers
    mark = found.sparkSession.range(1).select(F.lit(None).cast("long").alias("window_id"), F.lit(0).cast("long").alias("hash"), F.lit(MARK).alias("length"), F.lit("").alias("key"))
    table = found.select("window_id", "hash", "length", "key").unionByName(mark)
    few = found.count() <= MOST_BROADCAST
    rest = [c for c in docs.columns if c != "text"]
    own = F.array(F.struct(F.lit(0).cast("long").alias("hash"), F.lit(0).alias("at"), F.lit(MARK).alias("length")))
    texts = docs.select(*rest, words(F.col("text")).alias("_words"))
    # explode_outer, though no array is empty: explode would have the arrays made once more, to test for that
    each = texts.withColumn("_w", F.concat(own, *[runs("_words", k) for k in sorted(lengths)])).select(*rest, F.size("_words").alias("n_words"), "_words", F.explode_outer("_w").alias("_w"))
    said = F.array_join(F.slice("_words", F.greatest("_w.at", F.lit(1)), F.col("_w.length")), " ")
    if not few:  # the texts aren't shuffled, only each window's words
        each = each.select(*rest, "n_words", "_w", said.alias("_said"))
        said = F.col("_said")
    # equal, said so that it's no second key of the join: it's tried where hashes are equal
    same = F.startswith(said, F.col("key")) & F.startswith(F.col("key"), said)
    joined = each.join(F.broadcast(table) if few else table, (F.col("_w.hash") == F.col("hash")) & same)
    return joined.select(*rest, "n_words", F.col("_w.at").alias("at"), F.col("length"), "window_id")


def covered(found: DataFrame, by: list[str]) -> DataFrame:
    """hits with `fresh`, the words of each that no hit before it covers."""
    order = Window.partitionBy(*by).orderBy("at", "length").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("at") + F.col("length")).over(order), F.lit(0))
    end = F.col("at") + F.col("length")
    return found.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest(F.col("at"), reached)))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) of every row of docs(doc_id, text)."""
    members = common.stored(windows(benchmark, window))
    found = common.stored(members.select("hash", "length", "key").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    each = common.stored(hits(rows, found, window))
    by = covered(each.repartition("row"), ["row"]).groupBy("row", "doc_id", "n_words").agg(F.sum("fresh").alias("n_hit"))
    items = members.filter(F.col("item_id").isNotNull()).join(found, ["hash", "length", "key"]).select("window_id", "item_id")
    items = F.broadcast(items) if members.count() <= MOST_BROADCAST else items
    lists = each.filter(F.col("length") > MARK).select("row", "window_id").distinct().join(items, "window_id").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return by.join(lists, "row", "left").select("doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def removed(docs: DataFrame, benchmark: DataFrame, documents: bool = False, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) without what is hit. documents: rows with a hit go; otherwise the hit words go, with what
    stands between two of them, and the texts of other rows stay as they are."""
    found = common.stored(windows(benchmark, window).select("hash", "length", "key").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    rows = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), "text", F.struct("*").alias("doc")))
    spans = hits(rows.select("row", "text"), found, window).filter(F.col("length") > MARK).select("row", "at", "length")
    spans = common.stored(spans)
    if documents:
        return rows.join(spans.select("row").distinct(), "row", "left_anti").select("doc.*")
    # tokens in turn: separators before a word, then the word; so the k-th word is known by the words before it
    hit = spans.select("row", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("nth")).distinct()
    parts = F.regexp_extract_all(F.col("text"), F.lit(f"({SEPARATORS}|{LETTERS})"), F.lit(1))
    dirty = rows.join(spans.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(parts).alias("k", "part"))
    is_word = F.col("part").rlike(f"^{LETTERS}$")
    # a row's parts alternate, so a word's number follows from its place and from what stands first
    first = dirty.filter(F.col("k") == 0).select("row", is_word.alias("starts"))
    numbered = dirty.join(first, "row").select("row", "k", "part", "starts", is_word.alias("word"), F.floor((F.col("k") + F.when(F.col("starts"), 2).otherwise(1)) / 2).cast("int").alias("nth"))
    marked = numbered.join(hit.withColumn("hit", F.lit(True)), ["row", "nth"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    after = hit.select("row", (F.col("nth") - 1).alias("nth"), F.lit(True).alias("next"))
    marked = marked.join(after, ["row", "nth"], "left")
    # the separator of nth stands after the nth word: it goes if both neighbours do
    gone = F.col("hit") & (F.col("word") | F.coalesce("next", F.lit(False)))
    left = marked.filter(~gone).groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("_left"))
    touched = spans.select("row").distinct().withColumn("_touched", F.lit(True))
    out = rows.join(touched, "row", "left").join(left, "row", "left")
    text = F.when(F.col("_touched"), F.coalesce("_left", F.lit(""))).otherwise(F.col("doc.text"))
    return out.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in windows of benchmark items. Edge cases: see the module."""
    rows = report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    count = lambda c: F.col(c).cast("long").alias(c)
    return rows.select("doc_id", count("n_words"), count("n_hit"), F.size("item_ids").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _oracle() -> str:
    split = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {split} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {split} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS l, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 2}, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS x(i)),
k AS (SELECT DISTINCT l, k FROM p),
e AS (SELECT r, i, l, array_to_string(w[i : i + l - 1], ' ') AS k FROM d, (SELECT DISTINCT l FROM k) AS y, unnest(range(1, len(w) - l + 2)) AS x(i)),
h AS (SELECT r, i, l, k FROM e JOIN k USING (l, k)),
c AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, l)) AS x(j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM h JOIN p USING (l, k) WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


QUERIES = {"op12_leaks": op12_leaks}
ORACLE = {"op12_leaks": _oracle()}
