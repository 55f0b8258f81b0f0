"""What a reader of a report filters, formats and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import generic as G


def contains(c: Column, part: str) -> Column:
    return F.contains(F.lower(c), F.lit(part.lower()))


def dependencies(deps: DataFrame, scope: str | None = None, ecosystem: str | None = None, part: str = "") -> DataFrame:
    """All that fit, for a reader to page through."""
    keep = F.lit(True)
    keep = keep & (F.col("scope") == scope) if scope else keep
    keep = keep & (F.col("ecosystem") == ecosystem) if ecosystem else keep
    return deps.filter(keep & (contains(F.col("name"), part) | contains(F.col("manifest"), part)))


def findings(found: DataFrame, severity: str | None = None, include_tests: bool = False, most: int = 150) -> DataFrame:
    keep = F.lit(include_tests) | ~F.col("in_test")
    keep = keep & (F.col("severity") == severity) if severity else keep
    return G.cap_per_group(found.filter(keep), ["repo_id"], ["severity", "category", "path", "line"], most)


def markers(found: DataFrame, tag: str | None = None, most: int = 100) -> DataFrame:
    return G.cap_per_group(found.filter(F.col("tag") == tag) if tag else found, ["repo_id"], ["path", "line"], most)


def paths(nodes: DataFrame, part: str, most: int = 200) -> DataFrame:
    return G.cap_per_group(nodes.filter(contains(F.col("path"), part)), ["repo_id"], ["path"], most)


def languages(stats: DataFrame, programming_only: bool = True) -> DataFrame:
    """Shares made anew over what is shown."""
    shown = stats.filter(F.col("kind") == "programming") if programming_only else stats
    return G.share_of_total(shown.drop("percent_of_bytes"), "bytes", ["repo_id"], "percent_of_bytes")


def with_rest(df: DataFrame, label: str, value: str, top: int) -> DataFrame:
    """The largest values of a repository and one row for the rest, with percentages."""
    first = G.cap_per_group(df.select("repo_id", label, value), ["repo_id"], [F.desc(value), label], top)
    rest = df.select("repo_id", label, value).join(first.select("repo_id", label), ["repo_id", label], "left_anti").groupBy("repo_id").agg(F.sum(value).alias(value)).filter(F.col(value) > 0).select("repo_id", F.lit("Other").alias(label), value)
    return G.share_of_total(first.unionByName(rest), value, ["repo_id"])


def connected(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules at an end of some edge."""
    ends = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("module")).distinct()
    return modules.join(ends, ["repo_id", "module"], "left_semi")


def known_services(services: DataFrame) -> DataFrame:
    """Dependencies of Compose services on services of the same file."""
    links = services.select("repo_id", "path", F.col("name").alias("src"), F.explode("depends_on").alias("dst"))
    return links.join(services.select("repo_id", "path", F.col("name").alias("dst")), ["repo_id", "path", "dst"], "left_semi").select("repo_id", "path", "src", "dst")


def compact_count(n: Column) -> Column:
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_number(n / F.lit(d), 1), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(1e6, "M")).when(n >= 1000, short(1e3, "k")).otherwise(n.cast("string"))


def compact_bytes(n: Column) -> Column:
    short = lambda d, unit: F.concat(F.format_number(n / F.lit(d), 1), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, short(1024.0, " KB")).when(n < 1024**3, short(1024.0**2, " MB")).otherwise(short(1024.0**3, " GB"))


def relative_time(then: Column, now: Column) -> Column:
    days = F.datediff(now, then)
    some = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))
    return F.when(days < 1, "today").when(days < 30, some(days, "day")).when(days < 365, some(F.floor(days / 30), "month")).otherwise(some(F.floor(days / 365), "year"))
