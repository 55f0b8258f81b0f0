"""Structure of repositories: sanitized trees, totals, categories, directories and a bounded tree.

Trees are tree_entry(repo_id, ord, path, type, size); type is file, dir, symlink or submodule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..plans.shared import stored
from . import generic as G


def sanitized(raw: DataFrame, most: int) -> DataFrame:
    """raw(repo_id, ord, path, type, mode, size) as tree entries: known kinds with safe paths, the first `most` of them.
    Rows passed over don't count towards the cap."""
    kind = F.when(F.col("type") == "tree", "dir").when(F.col("type") == "commit", "submodule").when(F.col("type") == "blob", F.when(F.col("mode") == "120000", "symlink").otherwise("file"))
    rows = raw.withColumn("_kind", kind).filter(F.col("_kind").isNotNull() & P.is_safe(F.col("path")))
    size = F.when((F.col("_kind") == "file") & (F.col("size") >= 0), F.col("size")).otherwise(0)
    return G.cap_per_group(rows.select("repo_id", "ord", "path", F.col("_kind").alias("type"), size.cast("long").alias("size")), ["repo_id"], ["ord"], most)


def sanitizing_notes(raw: DataFrame, most: int) -> DataFrame:
    """repo_id, accepted, unsafe_paths_skipped and truncated_by_limit; a path is unsafe only if seen before the cap is met."""
    known = F.col("type").isin("tree", "commit", "blob")
    safe = P.is_safe(F.col("path"))
    before = F.sum(F.when(known & safe, 1).otherwise(0)).over(W.partitionBy("repo_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1))
    rows = raw.withColumn("_before", F.coalesce(before, F.lit(0)))
    open_ = F.col("_before") < most
    return rows.groupBy("repo_id").agg(F.count_if(open_ & known & safe).alias("accepted"), F.count_if(open_ & known & ~safe).alias("unsafe_paths_skipped"), F.bool_or(~open_).alias("truncated_by_limit"))


def classified(tree: DataFrame) -> DataFrame:
    """tree with ignored_root, category, language, auxiliary and depth."""
    path, is_dir = F.col("path"), F.col("type") == "dir"
    return tree.withColumns({"ignored_root": P.ignored_root(path, is_dir), "category": P.category(path), "language": P.classified_language(path), "auxiliary": P.is_auxiliary(path), "depth": P.depth(path)})


def analyzed_files(rows: DataFrame) -> DataFrame:
    """Files of a classified tree outside ignored directories."""
    return rows.filter((F.col("type") == "file") & F.col("ignored_root").isNull())


@dataclass(frozen=True)
class Structure:
    totals: DataFrame
    categories: DataFrame
    ignored_directories: DataFrame
    directories: DataFrame
    largest_files: DataFrame
    largest_directories: DataFrame
    submodules: DataFrame


def totals(rows: DataFrame, max_file_bytes: int) -> DataFrame:
    is_file, kept = F.col("type") == "file", F.col("ignored_root").isNull()
    size, own = F.col("size"), (F.col("type") == "file") & F.col("ignored_root").isNull()
    part = lambda when, value: F.coalesce(F.sum(F.when(when, value)), F.lit(0))
    deepest = lambda when: F.coalesce(F.max(F.when(when, F.col("depth"))), F.lit(0))
    out = rows.groupBy("repo_id").agg(
        F.count_if(is_file).alias("total_files"), part(is_file, size).alias("total_size_bytes"),
        F.count_if(own).alias("analyzed_files"), part(own, size).alias("analyzed_size_bytes"),
        F.count_if((F.col("type") == "dir") & kept).alias("total_directories"), F.count_if(F.col("type") == "symlink").alias("symlinks"),
        F.count_if(own & (size > max_file_bytes)).alias("oversized_files"), deepest(kept & (F.col("type") != "dir")).alias("max_depth"),
        deepest(kept & (F.col("type") != "dir") & ~F.col("auxiliary")).alias("product_max_depth"),
    )
    return out.withColumns({"ignored_files": F.col("total_files") - F.col("analyzed_files"), "ignored_size_bytes": F.col("total_size_bytes") - F.col("analyzed_size_bytes")})


def analyze(tree: DataFrame, max_file_bytes: int = 400_000) -> Structure:
    rows = classified(tree)
    own = analyzed_files(rows)
    below = rows.filter(F.col("ignored_root").isNotNull() & F.col("type").isin("file", "dir"))
    ignored = below.groupBy("repo_id", F.col("ignored_root").alias("path")).agg(F.count_if(F.col("type") == "file").alias("files"), F.sum(F.when(F.col("type") == "file", F.col("size")).otherwise(0)).alias("bytes"))
    dirs = G.ancestor_rollup(own, "path", "size", ["repo_id"])
    per = ["repo_id"]
    return Structure(
        totals=totals(rows, max_file_bytes),
        categories=own.groupBy("repo_id", "category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")),
        ignored_directories=G.cap_per_group(ignored, per, [F.desc("files"), "path"], C.TOP_IGNORED),
        directories=dirs,
        largest_files=G.cap_per_group(own.select("repo_id", "path", "size", "category", "language"), per, [F.desc("size"), "path"], C.LARGEST),
        largest_directories=G.cap_per_group(dirs, per, [F.desc("bytes"), "dir"], C.LARGEST_DIRS),
        submodules=G.cap_per_group(rows.filter("type = 'submodule'").select("repo_id", "path"), per, ["path"], 50),
    )


def tree_nodes(tree: DataFrame) -> DataFrame:
    """repo_id, path, type, size, files, ignored of every node: listed entries, directories above them, and the root (an empty
    path). What lies in an ignored directory is counted in it and in all above, and isn't a node. A path is listed once."""
    root = P.ignored_root(F.col("path"), F.col("type") == "dir")
    is_file = F.col("type") == "file"
    entries = tree.filter("path is not null").select(
        "repo_id", F.coalesce(root, F.col("path")).alias("at"), F.when(root.isNull() & (F.col("type") != "dir"), F.col("type")).alias("leaf"),
        F.when(is_file, F.col("size")).otherwise(0).cast("long").alias("bytes"), is_file.cast("long").alias("file"), (root.isNotNull() & F.col("type").isin("dir", "file")).alias("hidden"),
    )
    own = F.struct(F.col("at").alias("path"), F.col("leaf"), F.col("hidden"))
    above = F.transform(F.concat(F.array(F.lit("")), G.ancestors(F.col("at"))), lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("leaf"), F.lit(False).alias("hidden")))
    each = entries.select("repo_id", "bytes", "file", F.explode(F.concat(above, F.array(own))).alias("n"))
    summed = each.groupBy("repo_id", "n.path").agg(F.max("n.leaf").alias("leaf"), F.sum("bytes").alias("size"), F.sum("file").alias("files"), F.bool_or("n.hidden").alias("ignored"))
    return summed.select("repo_id", "path", F.coalesce("leaf", F.lit("dir")).alias("type"), "size", F.when(F.col("leaf").isNull(), F.col("files")).otherwise(0).alias("files"), "ignored")


def bounded_tree(tree: DataFrame, budget: int = C.NODE_BUDGET) -> DataFrame:
    """A repository's nodes in breadth-first order, directories first, then by name in lower case (equal ones by name), up to
    budget: repo_id, rank (0: the root), path, parent, name, type, size, files, ignored, omitted_children. The last is the
    number of a node's children that were left out; what is below a node that was left out is neither shown nor counted.

    Nodes of one depth follow their parents' order, so their place is that of the names above them, compared one by one: the
    walk is a sort by depth and names, within a repository, whose entries are capped (see sanitized). Up to the threshold of
    spark.sql.optimizer.windowGroupLimitThreshold each task keeps its first `budget` rows of it before they are shuffled."""
    nodes = stored(tree_nodes(tree))
    parts = F.split("path", "/")
    n = F.size(parts)
    named = nodes.filter("path <> ''").select("*", F.element_at(parts, -1).alias("name"), F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), n.alias("_depth"), F.transform(F.slice(parts, F.lit(1), n - 1), lambda x: F.struct(F.lower(x), x)).alias("_above"))
    shown = G.cap_per_group(named, ["repo_id"], ["_depth", "_above", F.col("type") != "dir", F.lower("name"), "name"], budget, "rank")
    top = nodes.filter("path = ''").select("repo_id", F.lit(0).alias("rank"), "path", F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), "type", "size", "files", "ignored")
    kept = shown.select(*top.columns).unionByName(top)
    children = lambda df, name: df.filter("parent is not null").groupBy("repo_id", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias(name))
    counts = children(named, "_all").join(children(kept, "_shown"), ["repo_id", "path"], "left")
    left_out = (F.coalesce("_all", F.lit(0)) - F.coalesce("_shown", F.lit(0))).cast("int")
    return kept.join(counts, ["repo_id", "path"], "left").select("repo_id", "rank", "path", "parent", "name", "type", "size", "files", "ignored", left_out.alias("omitted_children"))
