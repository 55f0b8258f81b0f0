"""Mixing sources to target weights by systematic sampling.

Within a source the documents are laid end to end in order of size, each as long as its expected copies; one random
offset is added and a copy is emitted for every integer boundary crossed. Ordering by size makes the sample a stratified
one, so the words taken differ from the target by about one long document's at most.

Ranks come from counts: a window over the (source, size) histogram, one over at most SLICES slices of equal sizes, and a
row number within a slice, so neither a source with a third of all rows nor a size with thousands of copies meets in one
task. Which distinct sources there are is a small table of a row each.

Defined results: null text has size 0; a source whose words are 0 has target 0 and takes nothing; null source is the last
source; rows with equal ids are told apart by order only, each being sampled on its own; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: A source's target stops at so many times its size.
MOST = 3
SLICES = 256


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources(source, source_size) with target: shares of all sizes by weight, none above most times its size.

    Sources are weighed by code point order, null last. With sources ordered by size for weight, those that reach
    their most form a prefix: one is in it if the level of what is left for it and those after it exceeds its most.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")).withColumn("top", (most * F.col("source_size")).cast("double"))
    before = W.orderBy(F.col("top") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    total = F.sum(F.col("source_size").cast("double")).over(every)
    level = (total - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    stopped = weighed.withColumn("total", total).withColumn("stops", F.col("top") <= level * F.col("weight"))
    free = F.when(~F.col("stops"), F.col("weight"))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("top"))).over(every), F.lit(0.0))) / F.sum(free).over(every)
    return stopped.withColumn("target", F.when(F.col("stops"), F.col("top")).otherwise(rest * F.col("weight"))).select("source", "source_size", "target")


def offset(source: Column, seed: int) -> Column:
    """A source's random offset in [0, 1), the same in every run: the first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000"))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def ranked(sized: DataFrame) -> DataFrame:
    """sized(source, size, order_key, ...) with rank (from 0) within its source by size, then order_key."""
    slice_of = (F.conv(F.substring("order_key", 1, 2), 16, 10).cast("int") * SLICES / 256).cast("int")
    rows = sized.withColumn("_slice", slice_of)
    keys = ["source", "size"]
    by_slice = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    sliced = by_slice.withColumn("_in_size", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by_size = by_slice.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    sizes = by_size.withColumn("_in_source", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = sliced.alias("a").join(sizes.alias("b"), F.expr("a.source <=> b.source and a.size = b.size")).select("a.source", "a.size", "a._slice", (F.col("_in_source") + F.col("_in_size")).alias("_start"))
    within = rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys, "_slice").orderBy("order_key", "doc_id")) - 1)
    joined = within.alias("w").join(starts.alias("s"), F.expr("w.source <=> s.source and w.size = s.size and w._slice = s._slice"))
    return joined.select("w.*", (F.col("_nth") + F.col("_start")).alias("rank")).drop("_slice", "_nth")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and order_key of each document, in a table of its own."""
    small = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("order_key"),
    )
    return common.stored(small)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of each document."""
    rows = sized(docs)
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.broadcast(goal) if goal.count() <= 10_000 else goal  # a row a source
    placed = ranked(rows).alias("r").join(whole.alias("g"), F.expr("r.source <=> g.source")).select("r.*", "source_size", "target")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = offset(F.col("source"), seed)
    copies = F.floor((F.col("rank") + 1) * each + start) - F.floor(F.col("rank") * each + start)
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


@common.fenced
def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. The copies planned for rows of one id are dealt to them in the
    order of their texts. The plan (an id and a number) is broadcast if its counted rows are few."""
    plan = common.stored(mixed(docs, weights, most, seed).groupBy("doc_id").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")))
    few = F.broadcast(plan) if plan.count() <= common.MOST_BROADCAST else plan
    found = docs.join(few.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")))
    single = found.filter("_rows = 1").withColumn("_times", F.col("_copies"))
    shared = found.filter("_rows > 1").withColumn("_nth", F.row_number().over(W.partitionBy("_id").orderBy("text")) - 1)
    dealt = shared.withColumn("_times", F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_nth") < F.col("_copies") % F.col("_rows"), 1).otherwise(0))
    every = single.select(*docs.columns, "_times")
    if not plan.filter("_rows > 1").isEmpty():
        every = every.union(dealt.select(*docs.columns, "_times"))
    return every.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(docs.columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: how many words of each the mix takes. Edge cases: see the module."""
    out = mixed(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE = {
    "op9_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (
  SELECT source, source_size, CAST(3 * source_size AS DOUBLE) AS top,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM src),
l AS (
  SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM src) AS total,
         ((SELECT CAST(sum(source_size) AS DOUBLE) FROM src) - coalesce(sum(top) OVER o, 0.0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0.0)) AS level
  FROM w WINDOW o AS (ORDER BY top / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (
  SELECT (max(total) - coalesce(sum(CASE WHEN top <= level * weight THEN top END), 0.0)) / sum(CASE WHEN top > level * weight THEN weight END) AS rest FROM l),
t AS (
  SELECT source, source_size, CASE WHEN top <= level * weight THEN top ELSE rest * weight END AS target FROM l, r),
p AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
         CAST(('0x' || substr(md5('7:' || coalesce(s.source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS o,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.k, s.doc_id) - 1 AS rank
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor((rank + 1) * each + o) - floor(rank * each + o)) * size AS BIGINT) AS taken FROM p
"""
}
