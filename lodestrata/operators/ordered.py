"""What goes through the rows of a key in order, without the rows of a key meeting in one task.

Rows are sorted into ranges and stored; a place in the order, counted within a range, cuts them into chunks of bounded size,
which follow each other in the order of their numbers. A hot key is many chunks. What a chunk says to the next one is a
small row: for runs, whether one touches its borders; for a budget, what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import stored

CHUNK = 1 << 15


def chunked(df: DataFrame, order: Sequence[str], keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """df stored, with _at, the place in the order of keys and order, and _chunk: of each range so many rows at most."""
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    low = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return stored(placed.withColumn("_chunk", F.struct(F.shiftright("_at", 33).alias("range"), F.floor(low / chunk).alias("n"))))


def islands(df: DataFrame, hit: Column, order: Sequence[str], keys: Sequence[str], least: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Runs of at least `least` consecutive rows with hit, per keys: first and last value of order[0], and length. Runs within
    a chunk are whole; those at a border are one small row each, and these alone are put together."""
    rows = chunked(df.withColumn("_hit", hit).select(*keys, *order, "_hit"), order, keys, chunk)
    here = W.partitionBy(*keys, "_chunk").orderBy("_at")
    numbered = rows.withColumn("_all", F.row_number().over(here)).withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*keys, "_chunk")))
    hits = numbered.filter("_hit").withColumn("_run", F.col("_all") - F.row_number().over(here))
    runs = hits.groupBy(*keys, "_chunk", "_rows", "_run").agg(F.min_by(order[0], "_at").alias("first"), F.max_by(order[0], "_at").alias("last"), F.count(F.lit(1)).alias("length"), F.min("_all").alias("_from"), F.max("_all").alias("_to"))
    head, tail = F.col("_from") == 1, F.col("_to") == F.col("_rows")
    runs = stored(runs.select(*keys, "_chunk", "first", "last", "length", head.alias("_head"), tail.alias("_tail")))
    whole = runs.filter("not _head and not _tail").select(*keys, "first", "last", "length")

    # a chunk's number within its key: a row a chunk
    chunks = rows.select(*keys, "_chunk").distinct().withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy("_chunk")))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*keys, "_chunk")]
    edge = runs.filter("_head or _tail").alias("r").join(chunks.alias("c"), same("r", "c")).select("r.*", "c._nth")
    along = W.partitionBy(*keys).orderBy("_nth", F.desc("_head"))
    joins = F.col("_head") & F.lag("_tail").over(along) & (F.lag("_nth").over(along) == F.col("_nth") - 1)
    grouped = edge.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_group", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    merged = grouped.groupBy(*keys, "_group").agg(F.min_by("first", "_nth").alias("first"), F.max_by("last", "_nth").alias("last"), F.sum("length").alias("length")).drop("_group")
    return whole.unionByName(merged).filter(F.col("length") >= least)


def budgeted(df: DataFrame, size: str, budget: int, order: Sequence[str], keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Rows of df taken in order, per keys, while their sizes fit into what is left of the budget; one too big is passed over,
    later ones may still fit. order tells the rows of a key apart.

    Each key has what is left of its budget. A round looks up, in a table of the chunks' least sizes, each key's next chunk in
    which something fits, goes through that chunk alone, and hands on what it leaves. A key is done when nothing fits any
    more; so there are as many rounds as chunks that give a row, and chunks without are never read."""
    rows = chunked(df.select(*keys, *order, F.col(size).cast("long").alias("_size")), order, keys, chunk)
    least = stored(rows.groupBy(*keys, "_chunk").agg(F.min("_size").alias("_least")))
    left = stored(least.select(*keys).distinct().withColumn("_left", F.lit(budget).cast("long")).withColumn("_done", F.lit(None).cast(least.schema["_chunk"].dataType)))
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    shape = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at", kind="stable")
        sizes, rest, at, taken = pdf["_size"].to_numpy(), int(pdf["_left"].iloc[0]), 0, []
        while at < len(sizes):
            fits = sizes[at:] <= rest
            run = np.flatnonzero(fits)
            if not len(run):
                break
            sums = np.cumsum(sizes[at + run])
            n = max(1, int(np.searchsorted(sums, rest, side="right")))  # those that fit now fit together up to here
            taken += (at + run[:n]).tolist()
            rest -= int(sums[n - 1])
            at += int(run[n - 1]) + 1
        out = pdf.iloc[taken][[*keys, "_at"]].assign(_left=rest)
        end = pdf.iloc[:1][[*keys]].assign(_at=-1, _left=rest)
        return pd.concat([out, end])[[*keys, "_at", "_left"]]

    took = []
    while True:
        open_ = least.alias("c").join(left.alias("l"), same("c", "l", keys)).filter("c._least <= l._left and (l._done is null or c._chunk > l._done)")
        following = stored(open_.groupBy(*[F.col(f"c.{k}") for k in keys], "l._left").agg(F.min("c._chunk").alias("_chunk")))
        if following.isEmpty():
            break
        own = rows.alias("r").join(following.alias("f"), same("r", "f", [*keys, "_chunk"])).select("r.*", "f._left")
        out = stored(own.groupBy(*keys).applyInPandas(fold, f"{shape}, _at long, _left long"))
        took.append(out.filter("_at >= 0").select("_at"))
        # keys that had no such chunk are done: they have nothing that fits
        left = stored(following.alias("f").join(out.filter("_at = -1").alias("o"), same("f", "o", keys)).select(*[F.col(f"f.{k}") for k in keys], "o._left", F.col("f._chunk").alias("_done")))
    if not took:
        return df.limit(0)
    every = took[0]
    for more in took[1:]:
        every = every.union(more)
    chosen = rows.join(every, "_at", "left_semi").select(*keys, *order)
    names = [*keys, *order]
    return df.alias("d").join(chosen.alias("t"), same("d", "t", names), "left_semi")
