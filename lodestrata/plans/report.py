"""Reports of many repositories at once: every analysis of their snapshots, the facts these give, and health scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import architecture, dependencies, documentation, graph, health, languages, quality, security, structure, views, workspaces
from ..sources import documents as D
from ..sources.export import CAPS
from .shared import stored

ARTIFACTS = ("node_modules", "venv", ".venv", "__pycache__", "dist", "build", "target", "coverage")
BOTS = (".github/dependabot.yml", ".github/dependabot.yaml", "renovate.json", ".renovaterc", ".renovaterc.json", ".github/renovate.json", "renovate.json5")


@dataclass(frozen=True)
class Snapshot:
    """repos(repo_id, license_spdx, archived, pushed_at, head_commit_date), tree and contents of many repositories."""

    repos: DataFrame
    tree: DataFrame
    contents: DataFrame


@dataclass(frozen=True)
class Report:
    structure: structure.Structure
    languages: DataFrame
    dependencies: dependencies.Dependencies
    readmes: DataFrame
    findings: DataFrame
    frameworks: DataFrame
    modules: DataFrame
    imports: DataFrame
    edges: DataFrame
    entry_points: DataFrame
    facts: DataFrame
    checks: DataFrame
    dimensions: DataFrame
    overall: DataFrame


def _per_repo(df: DataFrame, *aggregates: Column) -> DataFrame:
    return df.groupBy("repo_id").agg(*aggregates)


def report(s: Snapshot, now: Column) -> Report:
    """All of it, lazily; now is a timestamp column, given so that results don't depend on when they are made."""
    one, path = F.lit(1), F.col("path")
    made = structure.analyze(s.tree)
    deps = dependencies.analyze(s.tree, s.contents)
    found = security.findings(s.tree, s.contents)
    readmes = documentation.readmes(s.tree, s.contents)
    community = documentation.community_files(s.tree)
    tools = architecture.tooling(s.tree, s.contents, deps.dependencies)
    packages = workspaces.monorepos(s.tree, s.contents).select("repo_id", "packages")
    modules = architecture.modules(s.tree, packages)
    entries = architecture.entry_points(s.tree, s.contents)
    outcomes = graph.resolved(s.tree, s.contents)
    edges = graph.edges(outcomes)
    files = structure.analyzed_files(structure.classified(s.tree))
    kind = lambda k: F.count_if(F.col("kind") == k).cast("int")
    outside = ~F.col("in_test")
    has = lambda key: F.bool_or(F.col("key") == key)
    env = security.env_uses(s.contents).select("repo_id", F.lit(True).alias("reads_env")).distinct()
    days = lambda c: F.datediff(F.to_date(now), F.to_date(F.col(c))).cast("long")
    parts = [
        readmes.select("repo_id", F.col("words").cast("long").alias("readme_words"), "has_install", "has_usage"),
        _per_repo(documentation.readme_paths(documentation.known_paths(s.tree)), F.lit(True).alias("has_readme")),
        _per_repo(community, has("license").alias("_license_file"), has("contributing").alias("has_contributing"), has("changelog").alias("has_changelog")),
        documentation.directory_info(s.tree).select("repo_id", "doc_files"),
        quality.totals(s.tree, s.contents).select("repo_id", "source_files", "test_files", "sampled_source_files", "long_file_count"),
        _per_repo(quality.hotspots(s.contents), F.count(one).alias("high_complexity_count")),
        _per_repo(quality.markers(s.contents), F.count(one).alias("markers")),
        _per_repo(tools, kind("linters").alias("linters"), (kind("formatters") + F.count_if(F.col("tool") == "EditorConfig").cast("int")).alias("formatters"), kind("test_frameworks").alias("test_frameworks"), kind("ci").alias("ci")),
        _per_repo(deps.manifests, F.count(one).alias("manifests"), F.count("parse_error").alias("manifest_errors")),
        deps.totals.select("repo_id", F.col("total").alias("dependencies"), "unconstrained"),
        _per_repo(deps.ecosystems.filter("ecosystem <> 'Maven'"), F.count(one).alias("lockable_ecosystems"), F.count_if("has_lockfile").alias("locked_ecosystems")),
        _per_repo(deps.conflicts, F.count(one).alias("version_conflicts")),
        _per_repo(files, F.bool_or(path.isin(*BOTS)).alias("update_bot"), F.bool_or(F.lower(P.name(path)).isin("security.md", "security.rst", "security.txt") & (P.depth(path) <= 2)).alias("security_policy"), F.bool_or(path == ".gitignore").alias("has_gitignore")),
        _per_repo(found, F.count_if((F.col("severity") == "high") & outside).alias("high_findings"), F.count_if((F.col("severity") == "medium") & outside).alias("medium_findings"), F.count_if((F.col("category") == "sensitive-file") & outside & F.col("severity").isin("high", "medium")).alias("sensitive_files")),
        security.gitignore(s.tree, s.contents).join(env, "repo_id", "left").select("repo_id", (F.col("present") & (F.coalesce("env_excluded", F.lit(True)) | ~F.coalesce("reads_env", F.lit(False)))).alias("gitignore_ok")),
        _per_repo(made.ignored_directories, F.count_if(F.element_at(F.split("path", "/"), -1).isin(*ARTIFACTS) & ~P.is_auxiliary(F.concat("path", F.lit("/")))).alias("artifact_dirs")),
        _per_repo(modules, F.coalesce(F.max(F.when(F.col("module") == ".", F.col("source_files"))), F.lit(0)).alias("root_source_files"), F.bool_or(F.col("role") == "Tests").alias("test_modules")),
        made.totals.select("repo_id", F.col("product_max_depth").cast("long").alias("product_max_depth")),
        _per_repo(entries, F.count(one).alias("entry_points")),
        s.repos.select("repo_id", F.col("license_spdx").isNotNull().alias("_license"), "archived", days("pushed_at").alias("pushed_days"), days("head_commit_date").alias("committed_days")),
    ]
    wide = reduce(lambda a, b: a.join(b, "repo_id", "left"), parts, s.repos.select("repo_id").distinct())
    wide = wide.withColumn("has_license", F.coalesce("_license", F.lit(False)) | F.coalesce("_license_file", F.lit(False)))
    fields = [f.split() for f in health.FACTS.split(", ")]
    empty = {"boolean": F.lit(False), "long": F.lit(0), "int": F.lit(0)}
    unknown = ("pushed_days", "committed_days")
    facts = wide.select("repo_id", *[F.col(n).cast(t).alias(n) if n in unknown else F.coalesce(F.col(n), empty[t]).cast(t).alias(n) for n, t in fields])
    checks = health.scored_checks(facts)
    dimensions = health.dimensions(checks)
    return Report(made, languages.stats(s.tree, s.contents), deps, readmes, found, architecture.frameworks(s.tree, deps.dependencies), modules, outcomes, edges, entries, facts, checks, dimensions, health.overall(dimensions))


def blocks(s: Snapshot, r: Report) -> DataFrame:
    """A report's document: what each analysis found, as blocks of documents.py. repos may hold description and html_url."""
    count = lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0)), 0)
    said = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    named = lambda df, name, title: df.groupBy("repo_id").agg(text(f"{title}: ", F.concat_ws(", ", F.array_sort(F.collect_set(name)))).alias("said"))
    repos, totals, deps = s.repos, r.structure.totals, r.dependencies
    # the facts of all analyses lie behind these two: made once, in jobs of their own
    checks, edges = stored(r.checks), stored(r.edges)
    dimensions = health.dimensions(checks)
    quality_totals = quality.totals(s.tree, s.contents)
    labels = [(c, label) for c, label in (("html_url", "Repository"), ("license_spdx", "License"), ("pushed_at", "Last push"), ("archived", "Archived")) if c in repos.columns]
    fields = repos.select("repo_id", F.posexplode(F.array(*[F.struct(F.lit(label).alias("field"), said(F.col(c), "—").alias("value")) for c, label in labels])).alias("n", "f"))
    place = F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    rank = F.array_position(F.array(*map(F.lit, security.SEVERITIES)), F.col("severity"))
    parts = [
        D.said(repos, 10, F.coalesce("description", F.lit("No description.")) if "description" in repos.columns else "No description."),
        D.listing(fields, 11, {"Field": F.col("f.field"), "Value": F.col("f.value")}, ["n"], len(labels)),
        D.heading(repos, 20, "Health indicators"),
        D.said(health.overall(dimensions), 21, text("Overall: ", said(F.col("overall"), "n/a"), " (unweighted mean of applicable dimensions).")),
        D.listing(dimensions, 22, {"Dimension": F.col("dimension"), "Score": said(F.col("score"), "n/a")}, ["dimension"], 20, ["Score"]),
        D.listing(checks, 23, {"Check": F.col("id"), "Result": F.when(F.col("passed"), "pass").otherwise("fail"), "Points": F.col("points")}, ["id"], 200, ["Points"]),
        D.heading(totals, 30, "Structure"),
        D.bullets(totals, 31, text(count("total_files"), " files (", count("analyzed_files"), " analyzed, ", count("ignored_files"), " in ignored directories)"), text(count("total_directories"), " directories, max depth ", F.col("max_depth").cast("string")), text("Size: ", views.compact_bytes(F.col("total_size_bytes")))),
        D.listing(r.structure.categories, 32, {"Category": F.col("category"), "Files": count("files")}, [F.desc("files"), "category"], 20, ["Files"]),
        D.listing(r.structure.ignored_directories, 33, {"Ignored directory": F.col("path"), "Files": count("files")}, [F.desc("files"), "path"], 50, ["Files"]),
        D.heading(r.languages.select("repo_id").distinct(), 40, "Languages"),
        D.listing(r.languages, 41, {"Language": F.col("language"), "Files": count("files"), "Lines": text(F.when(F.col("lines_estimated"), "≈").otherwise(""), count("lines")), "Share of bytes": text(F.round("percent_of_bytes", 1).cast("string"), "%")}, [F.desc("bytes"), "language"], CAPS["languages"], ["Files", "Lines", "Share of bytes"]),
        D.heading(deps.totals, 50, "Dependencies"),
        D.said(deps.totals, 51, text(count("total"), " declarations, ", count("unconstrained"), " without a version constraint.")),
        D.listing(deps.ecosystems, 52, {"Ecosystem": F.col("ecosystem"), "Lockfile": F.when(F.col("has_lockfile"), "yes").otherwise("no")}, ["ecosystem"], 50),
        D.listing(deps.dependencies, 53, {"Package": F.col("name"), "Version": said(F.col("version"), "—"), "Scope": F.col("scope"), "Ecosystem": F.col("ecosystem"), "Manifest": F.col("manifest")}, ["ecosystem", "manifest", "scope", "name"], CAPS["dependencies"]),
        D.heading(quality_totals, 60, "Code quality"),
        D.bullets(quality_totals, 61, text(count("source_files"), " source files, ", count("test_files"), " test files"), text(count("long_file_count"), " long files")),
        D.listing(quality.hotspots(s.contents), 62, {"Location": place, "Complexity": F.col("complexity")}, [F.desc("complexity"), "path", "line"], CAPS["hotspots"], ["Complexity"]),
        D.heading(repos, 70, "Security indicators"),
        D.listing(r.findings.filter("not in_test"), 71, {"Severity": F.col("severity"), "Indicator": F.col("rule"), "Location": place, "Evidence (redacted)": F.col("evidence")}, [rank, "category", "path", F.coalesce("line", F.lit(0)), "rule"], CAPS["findings"]),
        D.heading(repos, 80, "Architecture"),
        D.bullets(named(r.frameworks, "framework", "Frameworks"), 81, F.col("said")),
        D.bullets(named(r.entry_points, "path", "Entry points"), 82, F.col("said")),
        D.listing(graph.module_edges(edges, r.modules.select("repo_id", "module")), 83, {"From module": F.col("src"), "To module": F.col("dst"), "Resolved imports": F.col("weight")}, [F.desc("weight"), "src", "dst"], CAPS["modules"], ["Resolved imports"]),
    ]
    return reduce(DataFrame.unionByName, parts)
