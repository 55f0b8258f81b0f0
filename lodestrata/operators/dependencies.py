"""Dependency inventories: constraints, ecosystems, lock files and version conflicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from ..functions.values import once
from ..sources import manifests as M
from . import generic as G
from .structure import analyzed_files, classified

SEMVER = r"^v?\d+(\.\d+){0,3}([-+][\w.]+)?$"


def constraint(source: Column, version: Column, ecosystem: Column) -> Column:
    """exact, range, none, managed or external, decided in this order."""
    return once(T.strip(F.coalesce(version, F.lit(""))), lambda v: constraint_of(source, v, ecosystem))


def constraint_of(source: Column, v: Column, ecosystem: Column) -> Column:
    """constraint() of a version that is stripped and not null."""
    kind = lambda exact: F.when(exact, "exact").otherwise("range")
    return (
        F.when(source != "registry", "external")
        .when(v == "", F.when(ecosystem == "Maven", "managed").otherwise("none"))
        .when(v.isin("*", "latest", "x", "X", "any"), "none")
        .when(v.contains("${") | v.startswith("$"), "managed")
        .when(ecosystem == "PyPI", kind(v.startswith("===") | (v.startswith("==") & ~v.rlike("[*,]"))))
        .when(ecosystem == "Go", "exact")
        .when(ecosystem == "crates.io", kind(v.startswith("=") & ~v.startswith("=>")))
        .when(ecosystem == "Maven", kind((v.startswith("[") & v.endswith("]") & ~v.contains(",")) | ~v.rlike(r"^[\[(]")))
        .when(ecosystem == "RubyGems", kind(T.strip(F.regexp_replace(v, "^[= ]+", "")).rlike(SEMVER) & ~v.rlike("^[~<>]")))
        .otherwise(kind(F.regexp_replace(v, "^=+", "").rlike(SEMVER)))
    )


@dataclass(frozen=True)
class Dependencies:
    """declared: every dependency; dependencies: those that a report lists, the first MAX_DEPENDENCIES of a repository."""

    manifests: DataFrame
    not_analyzed: DataFrame
    lockfiles: DataFrame
    declared: DataFrame
    dependencies: DataFrame
    totals: DataFrame
    ecosystems: DataFrame
    conflicts: DataFrame


def listed(parsed: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """A row a dependency, with its constraint; names and versions are cut to 200 and 100 characters."""
    rows = M.each(parsed.withColumnRenamed("path", "manifest"), "repo_id", "manifest", "ecosystem")
    source = F.when(F.col("version").startswith("workspace:"), "workspace").otherwise(F.col("source"))
    cut = rows.withColumns({"source": source, "name": F.substring("name", 1, 200), "version": F.when(F.col("version") != "", F.substring("version", 1, 100))})
    return cut.withColumn("constraint", constraint(F.col("source"), F.col("version"), F.col("ecosystem")))


def conflicts(deps: DataFrame) -> DataFrame:
    """Packages declared with several versions in a repository's manifests."""
    rows = deps.filter("version is not null and source = 'registry'").withColumn("key", F.lower("name"))
    by = rows.groupBy("repo_id", "ecosystem", "key").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("manifest")).alias("manifests")).filter(F.size("versions") > 1)
    names = deps.groupBy("repo_id", "ecosystem", F.lower("name").alias("key")).agg(F.min("name").alias("name"))
    out = by.join(names, ["repo_id", "ecosystem", "key"]).select("repo_id", "name", "ecosystem", "versions", "manifests")
    return G.cap_per_group(out, ["repo_id"], [F.desc(F.size("versions")), "name"], C.MAX_CONFLICTS)


def analyze(tree: DataFrame, contents: DataFrame) -> Dependencies:
    files = analyzed_files(classified(tree)).select("repo_id", "ord", "path")
    name = P.name(F.col("path"))
    locks = files.filter(name.isin(*C.LOCKFILES)).withColumn("ecosystem", P.lookup(C.LOCKFILE_ECOSYSTEM, name))
    wanted = files.filter(~name.isin(*C.LOCKFILES) & M.ecosystem(F.col("path")).isNotNull())
    parsed = M.parsed(contents.join(wanted.select("repo_id", "path"), ["repo_id", "path"], "left_semi"))
    deps = listed(parsed).join(wanted.select("repo_id", F.col("path").alias("manifest"), F.col("ord").alias("manifest_ord")), ["repo_id", "manifest"])
    scope = lambda s: F.count_if(F.col("scope") == s)
    pairs = deps.groupBy("repo_id", "ecosystem", F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n"), scope("production").alias("p"), scope("development").alias("d"), F.count_if(F.col("constraint") == "none").alias("u"), F.count_if(F.col("constraint") == "external").alias("e"))
    totals = pairs.groupBy("repo_id").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_packages"), F.sum("p").alias("production"), F.sum("d").alias("development"), F.sum("u").alias("unconstrained"), F.sum("e").alias("external_sources")).withColumn("other", F.col("total") - F.col("production") - F.col("development"))
    by = pairs.groupBy("repo_id", "ecosystem").agg(F.sum("n").alias("dependencies"), F.sum("p").alias("production"), F.sum("d").alias("development"))
    locked = locks.select("repo_id", "ecosystem", F.lit(True).alias("has_lockfile")).filter("ecosystem is not null").distinct()
    return Dependencies(
        manifests=parsed.select("repo_id", "path", "ecosystem", F.size("dependencies").alias("dependencies"), F.col("error").alias("parse_error")),
        not_analyzed=wanted.join(contents.select("repo_id", "path"), ["repo_id", "path"], "left_anti").select("repo_id", "path"),
        lockfiles=locks.select("repo_id", "path"),
        declared=deps,
        dependencies=G.cap_per_group(deps, ["repo_id"], ["manifest_ord", "ord"], C.MAX_DEPENDENCIES),
        totals=totals,
        ecosystems=by.join(locked, ["repo_id", "ecosystem"], "left").withColumn("has_lockfile", F.coalesce("has_lockfile", F.lit(False))),
        conflicts=conflicts(deps),
    )
