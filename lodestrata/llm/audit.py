"""How sources diverge from their language and from each other: counts of terms, smoothed shares and chi-square distances.

Terms are found in bytes: a table of 256 entries, looked up for the concatenated UTF-8 buffer of a batch at once, tells which
bytes belong to a term (letters and all bytes beyond ASCII) and lower-cases A-Z; where that changes, a term begins or ends.
Slices are grouped by their xxhash; each is then compared byte by byte with the first of its group, and a group that holds
two different terms is split. Counts per group of a batch leave Python; Spark sums them by language, source and term, which
splits the most frequent term by source.

The distances between the sources of a language are sums over all its kept terms. A block of terms, picked by a hash and of
bounded size, is a CSR matrix with a row a source; for each other source its shares are laid out over the block's columns,
and `reduceat` sums a row. Only occurring counts are stored: what both sources lack is counted and multiplied, what one lacks
has one share of its own. Spark sums the blocks.

All arithmetic is exact: shares are whole numbers from decimals of up to 38 digits, sums are 64-bit. A source's share may be a
third of all rows: its terms are dealt by term, its numbers joined as a table of one row a source.

Defined results: null text, lang and source are empty; a group without terms has the share of nothing for each kept term;
without kept terms the value of a pair is 0; ties go by UTF-8 bytes; repeated rows count again; other columns are ignored;
very long texts are read whole, by one task (about 40 times their size); an empty table gives no row. The number of pairs,
and of sums a block sends, is the square of the sources of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
#: Bytes of text read at once, and counts of a block.
HELD = 8 << 20
BLOCK = 1 << 16
#: Slices hashed at once.
PORTION = 1 << 16

IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer of all texts, and each term's start, end and row."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at, raw = at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
    inside, begins = IN_TERM[raw], np.zeros(len(raw) + 1, bool)  # a term ends where its text does
    begins[at] = True
    starts = np.flatnonzero(inside & (begins[:-1] | ~np.concatenate(([False], inside[:-1]))[: len(raw)]))
    ends = np.flatnonzero(inside & (begins[1:] | ~np.concatenate((inside[1:], [False]))[: len(raw)])) + 1
    row = np.searchsorted(at, starts, side="right") - 1
    return LOWER[raw], starts, ends, row


def grouped(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """The first slice of each distinct term, and each slice's term."""
    whole = buffer.tobytes()
    hashes = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), PORTION):
        own = slice(k, k + PORTION)
        hashes[own] = [hashed(whole[a:b]) for a, b in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    same = size == size[first[term]]
    checked = np.flatnonzero(same)
    steps = np.arange(size[checked].sum()) - np.repeat(np.cumsum(size[checked]) - size[checked], size[checked])
    equal = buffer[np.repeat(starts[checked], size[checked]) + steps] == buffer[np.repeat(starts[first[term[checked]]], size[checked]) + steps]
    if len(checked):
        same[checked] = np.logical_and.reduceat(equal, np.cumsum(size[checked]) - size[checked])
    own: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # different terms of one hash
        k = own.setdefault(whole[starts[i] : ends[i]], len(first) + len(own))
        term[i] = k
    if own:
        seen: dict[int, int] = {}
        for i in np.flatnonzero(~same).tolist():
            seen.setdefault(int(term[i]), i)
        first = np.concatenate((first, np.array([seen[k] for k in sorted(seen)])))
    return first, term


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, docs) of each piece: occurrences and documents."""
    for batch in common.pieces(common.gathered(batches, "text", HELD), "text", HELD):
        buffer, starts, ends, row = slices(batch.column("text"))
        if not len(starts):
            continue
        first, term = grouped(buffer, starts, ends)
        # rows are documents, columns terms; then rows of one language and source are added up
        cells, n = np.unique(row * len(first) + term, return_counts=True)
        lang, source = (batch.column(k).dictionary_encode() for k in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        key = group[cells // len(first)] * len(first) + cells % len(first)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        of, which = key[heads] // len(first), first[key[heads] % len(first)]
        whole = buffer.tobytes()
        terms = pa.array([whole[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), terms, pa.array(np.add.reduceat(n, heads)), pa.array(np.diff(heads, append=len(key)).astype(np.int64))],
            ["lang", "source", "term", "n", "docs"],
        )


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); without terms 1."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.when(terms > 0, F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms))).otherwise(F.lit(1)).cast("long")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def tallies(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Two tables: counts(lang, source, term, term_id, n, all_n) of kept terms that occur, all_n in the language; and
    sources(lang, source, nth, total, lang_total, terms, counts), a row each, nth from 0 within the language."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(known("lang"), known("source"), known("text"))
    each = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = common.stored(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = common.stored(kept.select("lang", "term", "all_n", F.monotonically_increasing_id().alias("term_id")))
    counts = common.stored(counts.drop("docs").join(kept, ["lang", "term"]))
    groups = rows.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("own"), zero("terms"), zero("lang_total"))
    in_lang = Window.partitionBy("lang")
    sources = sources.withColumn("nth", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("counts", F.sum("own").over(in_lang)).drop("own")
    return counts, common.stored(sources)


def distances(block: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of a block of terms for each pair (nth, other) of sources: rows with term_id are counts of kept terms
    with their share p; those without have each source's share of a term that it lacks."""
    lacking = block[block["term_id"].isna()].sort_values("nth")
    p0, some = lacking["p"].to_numpy(), block[block["term_id"].notna()].sort_values(["nth", "term_id"])
    nth, p = np.searchsorted(lacking["nth"].to_numpy(), some["nth"].to_numpy()), some["p"].to_numpy()
    ids, column = np.unique(some["term_id"].to_numpy().astype(np.int64), return_inverse=True)
    n, width = len(p0), len(ids)
    starts = np.searchsorted(nth, np.arange(n))
    full = np.flatnonzero(np.diff(starts, append=len(nth)))  # reduceat needs rows that aren't empty

    def by_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(full):
            out[full] = np.add.reduceat(x, starts[full])
        return out

    sums = np.zeros((n, n), np.int64)
    for t in range(n):
        mine = slice(starts[t], starts[t + 1] if t + 1 < n else len(nth))
        q, has = np.full(width, p0[t]), np.zeros(width, bool)
        q[column[mine]], has[column[mine]] = p[mine], True
        here, both = q[column], has[column]
        own = by_row((p - here) ** 2 // here)  # terms that the row has
        without = p0[nth]
        shared = by_row(np.where(both, (without - here) ** 2 // here, 0))
        theirs = np.array([((x - p[mine]) ** 2 // p[mine]).sum() for x in p0])  # terms that t has, if the row lacked them
        neither = width - by_row(np.ones(len(p), np.int64)) - (mine.stop - mine.start) + by_row(both.astype(np.int64))
        sums[:, t] = own + theirs - shared + neither * ((p0 - p0[t]) ** 2 // p0[t])
    a, b = (x.ravel() for x in np.meshgrid(lacking["nth"].to_numpy(), lacking["nth"].to_numpy(), indexing="ij"))
    out = pd.DataFrame({"lang": block["lang"].iloc[0], "nth": a, "other": b, "value": sums.ravel()})
    return out[out["nth"] != out["other"]]


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(text, lang, source)."""
    counts, sources = tallies(docs, least)
    near = lambda df: F.broadcast(df) if many <= common.MOST_BROADCAST else df
    many = sources.count()
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all_n"), F.col("lang_total"), F.col("terms"))
    rows = counts.join(near(sources), ["lang", "source"])
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    shares = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter(F.col("p") > F.col("q"))
    square = lambda a, b: div((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)), F.col(b))
    terms = shares.select("lang", "source", "item", square("p", "q").alias("value")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)

    blocks = F.greatest(F.lit(1), F.ceil(F.col("counts") / block)).cast("int")
    held = rows.select("lang", F.pmod(F.xxhash64("term"), blocks).cast("int").alias("block"), "term_id", "nth", p.alias("p"))
    lacking = sources.select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("long").alias("term_id"), "nth", share(F.lit(0), F.col("total"), F.col("terms")).alias("p"))
    sums = held.unionByName(lacking).groupBy("lang", "block").applyInPandas(distances, "lang string, nth int, other int, value long").groupBy("lang", "nth", "other").agg(F.sum("value").alias("value"))
    name = lambda key, as_: near(sources.select("lang", F.col("nth").alias(key), F.col("source").alias(as_)))
    pairs = sums.join(name("nth", "source"), ["lang", "nth"]).join(name("other", "item"), ["lang", "other"]).select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranked))

    part = lambda df, kind: df.select("lang", "source", F.lit(kind).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's distance to the others of its language, and the terms that set it apart. Edge cases: see the module."""
    return divergence(common.table(spark, sf_dir, "documents"))


def _oracle() -> str:
    term = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
    p = lambda c, n: f"1 + ({SCALE}::HUGEINT * ({c} + 1)) // ({n} + v)"
    f = "(p - q) * (p - q) // q"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {term} AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
e AS (SELECT r, lang, source, unnest(w) AS t FROM d),
k AS (SELECT lang, t, count(*) AS ln FROM e GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, CAST(sum(ln) AS BIGINT) AS lt FROM k GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS n FROM e JOIN k USING (lang, t) GROUP BY ALL),
s AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(lt, 0) AS lt, CAST(coalesce(st, 0) AS BIGINT) AS st FROM g LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS st FROM c GROUP BY ALL) USING (lang, source)),
a AS (SELECT s.lang, s.source, k.t, coalesce(n, 0) AS n, {p("coalesce(n, 0)", "st")} AS p, {p("ln", "lt")} AS q FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.t = k.t),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS f FROM a JOIN a b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
y AS (SELECT s.lang, s.source, o.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM s JOIN s o ON s.lang = o.lang AND s.source <> o.source LEFT JOIN x ON x.lang = s.lang AND x.source = s.source AND x.item = o.source),
z AS (SELECT lang, source, t AS item, CAST({f} AS BIGINT) AS value FROM a WHERE n > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM y UNION ALL SELECT lang, source, 'term', item, value FROM z)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) WHERE part = 'pair' OR rank <= {TOP}
"""


QUERIES = {"op11_audit": op11_audit}
ORACLE = {"op11_audit": _oracle()}
