"""Workspaces of a repository: the globs its root files declare, the packages they pick, and the modules of its tree.

Globs meet paths by an equi-join: a glob's directories before its first wildcard are a key that must be one of the path's
ancestors or the path, and only such candidates are matched. Modules are found level by level: a frontier of directories,
all repositories together, goes down where one child holds all the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.shared import stored
from ..sources import manifests
from . import generic as G
from .structure import analyzed_files, classified

# Files that tell a tool, names of directories that hold others, and limits of a report.
TOOLS = {"pnpm-workspace.yaml": "pnpm workspaces", "lerna.json": "Lerna", "nx.json": "Nx", "turbo.json": "Turborepo", "go.work": "Go workspaces", "rush.json": "Rush"}
CONTAINERS = ("src", "lib", "app", "pkg", "internal", "source", "packages", "apps", "services", "libs", "crates", "modules", "cmd", "components")
MOST_GLOBS, MOST_PACKAGES, DEEPEST = 100, 60, 3
LARGE_CONTAINER, LARGE_DIRECTORY, LARGE_PACKAGE = 0.3, 0.5, 0.25


def trimmed(glob: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(glob), r"^/+|/+$", ""), r"^\./", "")


def pattern(glob: Column) -> Column:
    """A glob as a pattern for a whole path: ** crosses directories, * and ? don't."""
    out = F.regexp_replace(trimmed(glob), r"[\\.+^$(){}|\[\]-]", r"\\$0")
    for sign, means in (("**", "\x01"), ("*", "[^/]*"), ("?", "[^/]"), ("/\x01", "(?:/.*)?"), ("\x01", ".*")):
        out = F.replace(out, F.lit(sign), F.lit(means))
    return F.concat(F.lit("^(?s:"), out, F.lit(r")\z"))


def fixed_part(glob: Column) -> Column:
    """The directories before a glob's first wildcard, as a path."""
    return F.regexp_replace(F.regexp_extract(trimmed(glob), r"^((?:[^*?/]+/)*)", 1), "/$", "")


def matched(paths: DataFrame, globs: DataFrame) -> DataFrame:
    """paths(repo_id, path) that one of globs(repo_id, glob) matches and none that begins with ! does."""
    own = globs.select("repo_id", F.col("glob").startswith("!").alias("no"), F.regexp_replace("glob", "^!", "").alias("glob")).distinct()
    rules = own.select("repo_id", "no", fixed_part(F.col("glob")).alias("below"), pattern(F.col("glob")).alias("pattern"))
    up = paths.select("repo_id", "path").distinct().select("repo_id", "path", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), G.ancestors(F.col("path")), F.array("path")))).alias("below"))
    found = up.join(rules, ["repo_id", "below"]).filter(F.rlike("path", F.col("pattern")))
    return found.groupBy("repo_id", "path").agg(F.bool_or("no").alias("no")).filter("not no").select("repo_id", "path")


def declared(contents: DataFrame) -> DataFrame:
    """repo_id, glob: the members that root files declare, in order of files and places, MOST_GLOBS at most."""
    text, path = F.col("text"), F.col("path")
    none = F.array().cast("array<string>")
    listed = lambda json: F.coalesce(F.from_json(json, "array<string>"), none)
    block = F.regexp_extract(text, r"(?m)^packages\s*:[^\n]*\n((?:[ \t]+[^\n]*+(?:\n|\z)|[ \t\r]*+\n)*+)", 1)
    items = F.regexp_extract_all(block, F.lit(r"""(?m)^\s+-\s*['"]?([^'"#\n]+?)['"]?\s*(?:#.*)?$"""), F.lit(1))
    npm = F.when(F.get_json_object(text, "$.workspaces").startswith("["), listed(F.get_json_object(text, "$.workspaces"))).otherwise(listed(F.get_json_object(text, "$.workspaces.packages")))
    used = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:use\s+)?(\./[\w./-]+)"), F.lit(1)), lambda g: F.substring(g, 3, 1 << 20))
    kinds = (
        ("pnpm-workspace.yaml", items), ("package.json", npm), ("lerna.json", listed(F.get_json_object(text, "$.packages"))),
        ("Cargo.toml", listed(F.get_json_object("toml", "$.workspace.members"))), ("go.work", used),
    )
    files = contents.filter(path.isin(*[name for name, _ in kinds])).select("repo_id", "path", "text")
    files = files.withColumn("toml", F.when(path == "Cargo.toml", manifests.toml_as_json(text)))
    nth = lambda value: F.coalesce(*[F.when(path == name, value(i, globs)) for i, (name, globs) in enumerate(kinds)])
    rows = files.select("repo_id", nth(lambda i, _: F.lit(i)).alias("file"), F.posexplode(nth(lambda _, globs: globs)).alias("place", "glob"))
    return G.cap_per_group(rows, ["repo_id"], ["file", "place"], MOST_GLOBS).select("repo_id", "glob")


def monorepos(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_id, tool, packages (sorted, MOST_PACKAGES at most): directories with manifests that the declared globs pick, or all
    but auxiliary ones where none are declared; two of these at least tell a monorepo by themselves."""
    path = F.col("path")
    files = analyzed_files(classified(tree))
    at_root = files.filter(path.isin(*TOOLS, "package.json", "Cargo.toml")).select("repo_id", "path")
    texts = contents.join(at_root, ["repo_id", "path"], "left_semi")
    named = at_root.select("repo_id", F.coalesce(*[F.when(path == f, F.struct(F.lit(i).alias("nth"), F.lit(tool).alias("tool"))) for i, (f, tool) in enumerate(TOOLS.items())]).alias("told"))
    said = texts.select("repo_id", F.when((path == "package.json") & F.contains("text", F.lit('"workspaces"')), F.struct(F.lit(len(TOOLS)).alias("nth"), F.lit("npm/yarn workspaces").alias("tool"))).when((path == "Cargo.toml") & F.contains("text", F.lit("[workspace]")), F.struct(F.lit(len(TOOLS) + 1).alias("nth"), F.lit("Cargo workspace").alias("tool"))).alias("told"))
    tools = named.unionByName(said).filter("told is not null").groupBy("repo_id").agg(F.min("told").alias("told")).select("repo_id", "told.tool")

    holds = path.contains("/") & P.is_manifest(path) & ~P.name(path).startswith("requirements")
    dirs = files.filter(holds).select("repo_id", P.parent(path).alias("path")).distinct().withColumn("auxiliary", P.is_auxiliary(F.concat("path", F.lit("/"))))
    globs = declared(texts)
    by_glob = matched(dirs, globs)
    by_itself = dirs.filter("not auxiliary").join(globs.select("repo_id").distinct(), "repo_id", "left_anti").select("repo_id", "path")
    chosen = by_glob.unionByName(by_itself)
    counts = chosen.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    first = G.cap_per_group(chosen, ["repo_id"], ["path"], MOST_PACKAGES).groupBy("repo_id").agg(F.array_sort(F.collect_list("path")).alias("packages"))
    every = tools.join(counts, "repo_id", "full").join(first, "repo_id", "left")
    return every.filter("tool is not null or n >= 2").select("repo_id", F.coalesce("tool", F.lit("multiple manifests")).alias("tool"), F.coalesce("packages", F.array().cast("array<string>")).alias("packages"))


def module_paths(tree: DataFrame, packages: DataFrame) -> DataFrame:
    """repo_id, module: top directories and packages(repo_id, packages), the large ones replaced by what is in them."""
    path = F.col("path")
    own = analyzed_files(classified(tree)).select("repo_id", "path", (F.col("category") == "source").cast("int").alias("source"))
    below = own.select("repo_id", F.explode(G.ancestors(path)).alias("dir"), "source").groupBy("repo_id", "dir").agg(F.sum("source").alias("below"))
    inside = own.groupBy("repo_id", P.parent(path).alias("dir")).agg(F.count(F.lit(1)).alias("files"), F.sum("source").alias("direct"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    # read by every level, so stored, as the levels' small tables are
    facts = stored(below.join(inside, ["repo_id", "dir"], "left").select("repo_id", "dir", P.parent(F.col("dir")).alias("above"), "below", none("files"), none("direct")))
    packages = stored(packages.select("repo_id", "packages"))

    top = facts.filter("above = ''")
    share = F.col("below") / F.greatest(F.lit(1), F.sum("below").over(W.partitionBy("repo_id")))
    large = share >= F.when(F.lower("dir").isin(*CONTAINERS), LARGE_CONTAINER).otherwise(LARGE_DIRECTORY)
    members = packages.filter(F.size("packages") >= 2).select("repo_id", F.explode("packages").alias("dir"))
    workspaces = members.select("repo_id").distinct()
    plain = top.select("repo_id", "dir", large.alias("large")).join(workspaces, "repo_id", "left_anti")
    total = top.groupBy("repo_id").agg(F.greatest(F.lit(1), F.sum("below")).alias("total"))
    held = members.join(facts, ["repo_id", "dir"]).join(total, "repo_id").filter(F.col("below") / F.col("total") >= LARGE_PACKAGE).select("repo_id", "dir")
    kept = plain.filter("not large").select("repo_id", "dir").union(members).union(top.join(workspaces, "repo_id", "left_semi").select("repo_id", "dir"))

    frontier = plain.filter("large").select("repo_id", "dir").union(held).distinct()
    for depth in range(DEEPEST + 1):
        here = frontier.join(facts, ["repo_id", "dir"])
        kids = here.select("repo_id", F.col("dir").alias("above"), "files", "direct").join(facts.select("repo_id", "above", "dir", "below"), ["repo_id", "above"], "left")
        full = F.count_if(F.col("below") > 0).over(W.partitionBy("repo_id", "above"))
        kids = kids.withColumn("full", full)
        stays = (F.lit(depth) >= DEEPEST) | (F.col("full") == 0) | ((F.col("full") == 1) & (F.col("direct") > 0))
        kids = stored(kids.withColumn("stays", stays))
        goes_down = ~F.col("stays") & (F.col("full") == 1) & (F.col("below") > 0)
        # a directory that stays, or holds files itself, is a module, as are the children of one that doesn't stay
        kept = kept.union(kids.filter("stays or files > 0").select("repo_id", "above")).union(kids.filter(~F.col("stays") & ~goes_down & F.col("dir").isNotNull()).select("repo_id", "dir"))
        frontier = kids.filter(goes_down).select("repo_id", "dir").distinct()
        if depth < DEEPEST and frontier.isEmpty():
            break
    return kept.toDF("repo_id", "module").distinct()
