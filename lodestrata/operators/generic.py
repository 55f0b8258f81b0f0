"""Operators over any table that the repository analyses are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def share_of_total(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "percent") -> DataFrame:
    """Adds 100 * value / sum(value) within keys. Give it aggregated rows: a total over no keys meets in one task."""
    every = F.sum(value).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))
    return df.withColumn(out, F.col(value) * F.lit(100.0) / every)


def ancestors(path: Column, sep: str = "/") -> Column:
    """All proper ancestor directories of a path, outermost first."""
    parts = F.split(path, sep)
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep))


def ancestor_rollup(df: DataFrame, path: str, size: str, keys: Sequence[str] = ()) -> DataFrame:
    """Files and bytes below every directory: partial sums before the shuffle keep hot roots small."""
    return df.select(*keys, F.explode(ancestors(F.col(path))).alias("dir"), F.col(size).alias("_size")).groupBy(*keys, "dir").agg(F.count(F.lit(1)).alias("files"), F.sum("_size").alias("bytes"))


def cap_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], most: int, nth: str | None = None) -> DataFrame:
    """The first rows of each group; Spark limits each partition before the shuffle."""
    ranked = df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= most)
    return ranked.withColumnRenamed("_nth", nth) if nth else ranked.drop("_nth")


def round_robin(df: DataFrame, group: str, order: Sequence[str], most: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows dealt across groups in turn: all firsts, then all seconds, up to most rows per key. No group can give more than
    most rows, so each is cut to that first."""
    turns = cap_per_group(df, [*keys, group], order, most, "turn")
    if keys:
        return cap_per_group(turns, keys, ["turn", group, *order], most)
    return turns.orderBy("turn", group, *order).limit(most)


def conflicts(df: DataFrame, keys: Sequence[str], value: str, out: str = "versions") -> DataFrame:
    """Groups with more than one distinct value, and these sorted."""
    distinct = df.select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list(value)).alias(out)).filter("n_values > 1")


def islands(df: DataFrame, hit: Column, order: Sequence[str], keys: Sequence[str], least: int = 2) -> DataFrame:
    """Runs of at least `least` consecutive rows with hit, per keys: first and last order value, and length.

    Runs need the rows of a key in one order, so a key's rows meet; give keys that bound them, as a file's or a day's lines.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_hit", hit).withColumn("_all", F.row_number().over(w))
    runs = marked.filter("_hit").withColumn("_run", F.col("_all") - F.row_number().over(w))
    return runs.groupBy(*keys, "_run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("length")).filter(F.col("length") >= least).drop("_run")


def longest_prefix(df: DataFrame, path: str, prefixes: DataFrame, prefix: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each row's longest prefix that is the path or one of its ancestors, by equi-joins on exploded ancestors; null if none.
    Found once for each distinct path."""
    paths = df.select(*keys, path).distinct()
    up = paths.select(*keys, path, F.explode(F.array_append(ancestors(F.col(path)), F.col(path))).alias(prefix))
    best = up.join(prefixes.select(*keys, prefix).distinct(), [*keys, prefix]).groupBy(*keys, path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return df.join(best, [*keys, path], "left")


def induced_subgraph(edges: DataFrame, nodes: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose both ends are nodes."""
    return edges.join(nodes.select(F.col(node).alias(src)), src, "left_semi").join(nodes.select(F.col(node).alias(dst)), dst, "left_semi").select(edges.columns)


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """Edge weights summed, self-edges dropped."""
    return edges.filter(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.sum(weight).alias(weight))


def weighted_scores(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """checks(keys, dimension, max_points, fraction; null fraction: not applicable) as score per dimension."""
    earned = F.sum(F.col("max_points") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction"))))
    possible = F.sum(F.when(F.col("fraction").isNotNull(), F.col("max_points")))
    return checks.groupBy(*keys, "dimension").agg((F.lit(100.0) * earned / F.when(possible > 0, possible)).alias("score"))
