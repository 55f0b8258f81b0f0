"""Import graphs: extraction, resolution by joins, contraction to modules, hubs and layouts.

Every import becomes a few candidate targets with priorities; one equi-join with the repository's files and directories
finds those that exist, and the first by priority wins. What would match several files is unresolved, never guessed.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..plans.shared import stored
from . import generic as G
from .quality import python_facts
from .structure import analyzed_files, classified

# Import syntax, and extensions that scripts may leave out.
JS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".json")
JS_IMPORTS = (
    r"""(?:import|export)\s[^'";]{0,500}?\sfrom\s*['"]([^'"\n]{1,300})['"]""",
    r"""\bimport\s*['"]([^'"\n]{1,300})['"]""",
    r"""\brequire\(\s*['"]([^'"\n]{1,300})['"]\s*\)""",
    r"""\bimport\(\s*['"]([^'"\n]{1,300})['"]\s*\)""",
)
SCRIPTS = ("JavaScript", "TypeScript", "Vue", "Svelte")
GO_SINGLE = r"""(?m)^import\s+(?:[\w.]+\s+)?"([^"]+)\""""
GO_BLOCK = r"(?ms)^import\s*\((.*?)^\)"
GO_LINE = r"""(?m)^\s*(?:[\w.]+\s+)?"([^"]+)\""""
GO_MODULE = r"(?m)^module\s+(\S+)"
RUST_USE = r"\buse\s+crate::(\w+(?:::\w+)*)"
JVM_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;?"
ROOTS = ("", "src", "lib", "source")
STDLIB = tuple(sorted(sys.stdlib_module_names))


def imports(contents: DataFrame) -> DataFrame:
    """repo_id, path, language, spec, level (of a relative Python import) of every import statement."""
    lang = P.classified_language(F.col("path"))
    python = python_facts(contents).filter("parsed").select("repo_id", "path", F.lit("Python").alias("language"), F.explode("imports").alias("i")).select("repo_id", "path", "language", F.col("i.module").alias("spec"), F.col("i.level").alias("level"))
    text = F.col("text")
    all_of = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    go = F.concat(all_of(GO_SINGLE), F.flatten(F.transform(all_of(GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit(GO_LINE), F.lit(1)))))
    specs = F.when(lang.isin(*SCRIPTS), F.flatten(F.array(*[all_of(p) for p in JS_IMPORTS]))).when(lang == "Go", go).when(lang == "Rust", all_of(RUST_USE)).when(lang.isin("Java", "Kotlin", "Scala"), all_of(JVM_IMPORT))
    others = contents.select("repo_id", "path", lang.alias("language"), F.explode(specs).alias("spec")).withColumn("level", F.lit(0))
    return python.unionByName(others)


def nodes(tree: DataFrame) -> DataFrame:
    """repo_id, target, is_file: files outside ignored directories, and all directories above them."""
    files = analyzed_files(classified(tree)).select("repo_id", "path")
    dirs = files.select("repo_id", F.explode(G.ancestors(F.col("path"))).alias("target")).distinct()
    return files.select("repo_id", F.col("path").alias("target"), F.lit(True).alias("is_file")).union(dirs.withColumn("is_file", F.lit(False)))


def joined(*parts: Column) -> Column:
    """A normalized path of parts, empty ones left out."""
    return T.normalized(F.concat_ws("/", *[F.when(p != "", p) for p in parts]))


def prefixes(parts: Column, least: int = 1) -> Column:
    """Prefixes of an array, the longest first."""
    n = F.size(parts)
    return F.transform(F.when(n >= least, F.sequence(n, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(parts, F.lit(1), i))


def up(path: Column, level: Column) -> Column:
    """The directory `level` levels above a file."""
    dirs = P.directories(path)
    return F.array_join(F.slice(dirs, F.lit(1), F.greatest(F.lit(0), F.size(dirs) - level + 1)), "/")


def script_places(path: Column) -> Column:
    """Files that a script's import of path may mean, in order."""
    short = F.regexp_replace(path, r"\.(js|jsx|mjs|cjs)$", "")
    return F.concat(F.array(path), F.array(*[F.concat(short, F.lit(e)) for e in JS_EXTENSIONS]), F.array(*[F.concat(path, F.lit("/index" + e)) for e in JS_EXTENSIONS]))


def candidates(found: DataFrame) -> DataFrame:
    """found with priority and target, for imports whose place is told by the importer's or the root's."""
    spec, path = F.col("spec"), F.col("path")
    base = up(path, F.col("level"))
    parts = F.when(spec == "", F.array().cast("array<string>")).otherwise(F.split(spec, r"\."))
    places = F.concat(F.transform(prefixes(parts), lambda p: joined(base, F.array_join(p, "/"))), F.array(base))
    relative = F.flatten(F.transform(places, lambda p: F.array(F.concat(p, F.lit(".py")), joined(p, F.lit("__init__.py")), p)))
    bare = F.element_at(F.split(spec, r"\?", 2), 1)
    script = script_places(joined(P.parent(path), bare))
    dirs = P.directories(path)
    source = F.array_join(F.slice(dirs, F.lit(1), F.size(dirs) - F.array_position(F.reverse(dirs), "src") + 1), "/")
    rust = F.flatten(F.transform(prefixes(F.split(spec, "::")), lambda p: F.array(F.concat(joined(source, F.array_join(p, "/")), F.lit(".rs")), joined(source, F.array_join(p, "/"), F.lit("mod.rs")))))
    every = F.when((F.col("language") == "Python") & (F.col("level") > 0), relative).when(F.col("language").isin(*SCRIPTS) & bare.startswith("."), script).when((F.col("language") == "Rust") & F.array_contains(dirs, "src"), rust)
    return found.select("*", F.posexplode(every).alias("priority", "target"))


def suffixes(parts: Column, sep: str = "/") -> Column:
    """All suffixes of an array of names, joined by sep, and the path of what stands before each, as structs: suffix, root."""
    every = F.sequence(F.lit(1), F.size(parts))
    return F.transform(every, lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), sep).alias("suffix"), F.array_join(F.slice(parts, F.lit(1), i - 1), "/").alias("root")))


def absolute_python(found: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of absolute Python imports. A dotted name matches a file from a root on the path: the repository's, a usual
    source root, or a directory above the importer. The longest prefix that matches decides, one match being needed.

    Names are joined together with the root they start from, and the index has a row for each such pair, so a name that many
    packages share (utils) meets the few roots of its importer and no others."""
    is_file = F.col("is_file")
    own_parts = F.when(is_file, F.split(F.regexp_replace(F.regexp_replace("target", r"\.py$", ""), r"/__init__$", ""), "/")).otherwise(F.split("target", "/"))
    placed = known.filter(~is_file | F.col("target").endswith(".py")).select("repo_id", "is_file", "target", F.explode(suffixes(own_parts, ".")).alias("k"))
    file, space = F.when(is_file, F.col("target")), F.when(~is_file, F.col("target"))
    index = placed.groupBy("repo_id", "k.suffix", "k.root").agg(F.min(file).alias("first"), F.max(file).alias("last"), F.min(space).alias("space"))
    own = found.filter((F.col("language") == "Python") & (F.col("level") == 0))
    names = F.split("spec", r"\.")
    open_ = own.filter(~F.element_at(names, 1).isin(*STDLIB) & (F.col("spec") != ""))
    roots = F.array_distinct(F.concat(F.array(*map(F.lit, ROOTS)), G.ancestors(F.col("path"))))
    starts = open_.select("id", "repo_id", names.alias("names"), F.explode(roots).alias("root"))
    tries = starts.select("id", "repo_id", "root", F.explode(F.transform(prefixes(F.col("names")), lambda p: F.struct(F.array_join(p, ".").alias("suffix"), F.size(p).alias("n")))).alias("k")).select("id", "repo_id", "root", "k.*")
    per = tries.join(index, ["repo_id", "suffix", "root"]).groupBy("id", "n").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("space", F.when(F.col("space").isNotNull(), F.struct(F.length("root"), "root"))).alias("space"))
    best = per.groupBy("id").agg(F.max_by(F.struct("first", "last", "space"), "n").alias("b"))
    kind = F.when(F.col("b").isNull(), "external").when(F.col("b.first") < F.col("b.last"), "unresolved").otherwise("internal")
    return own.join(best, "id", "left").select("id", kind.alias("kind"), F.when(kind == "internal", F.coalesce("b.first", "b.space")).alias("target"))


def jvm(found: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of JVM imports: a class's file, or a package's directory, by suffix; exactly one must match.

    The index has one row a suffix, with the first and the last of the paths that end in it: they differ if several do. So a
    class name of which there are many (Utils) is a row of the join, and the counting ends before the shuffle."""
    own = found.filter(F.col("language").isin("Java", "Kotlin", "Scala"))
    want = own.select("id", "repo_id", F.col("spec").endswith(".*").alias("package"), F.replace(F.regexp_replace("spec", r"\.\*$", ""), F.lit("."), F.lit("/")).alias("suffix"))
    is_file = F.col("is_file")
    parts = F.split(F.when(is_file, F.regexp_replace("target", r"\.[^./]+$", "")).otherwise(F.col("target")), "/")
    placed = known.filter(~is_file | F.col("target").rlike(r"\.(java|kt|scala)$")).select("repo_id", (~is_file).alias("package"), "target", F.explode(suffixes(parts)).alias("k"))
    index = placed.groupBy("repo_id", "package", "k.suffix").agg(F.min("target").alias("first"), F.max("target").alias("last"))
    hits = want.join(index, ["repo_id", "package", "suffix"]).select("id", "first", "last")
    kind = F.when(F.col("first").isNull(), "external").when(F.col("first") < F.col("last"), "unresolved").otherwise("internal")
    return own.join(hits, "id", "left").select("id", kind.alias("kind"), F.when(kind == "internal", F.col("first")).alias("target"))


def go(found: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of Go imports: below the longest of the repository's modules that begins the import path."""
    own = found.filter("language = 'Go'")
    modules = contents.filter(P.name(F.col("path")) == "go.mod").select("repo_id", F.regexp_extract("text", GO_MODULE, 1).alias("module"), P.parent(F.col("path")).alias("root")).filter("module <> ''")
    tries = own.select("id", "repo_id", "spec", F.explode(F.transform(prefixes(F.split("spec", "/")), lambda p: F.array_join(p, "/"))).alias("module"))
    best = tries.join(modules, ["repo_id", "module"]).groupBy("id", "repo_id", "spec").agg(F.max_by(F.struct("module", "root"), F.length("module")).alias("m"))
    rest = F.substring(F.col("spec"), F.length("m.module") + 2, F.length("spec"))
    placed = best.select("id", "repo_id", joined(F.col("m.root"), rest).alias("target"))
    dirs = known.filter(~F.col("is_file")).select("repo_id", "target", F.lit(True).alias("there"))
    out = placed.join(dirs, ["repo_id", "target"], "left").select("id", F.when(F.col("target") == "", ".").when(F.col("there"), F.col("target")).alias("target"), F.lit(True).alias("ours"))
    return own.join(out, "id", "left").select("id", F.when(F.col("ours").isNull(), "external").when(F.col("target").isNull(), "unresolved").otherwise("internal").alias("kind"), "target")


def plain_json(text: Column) -> Column:
    """JSON without comments (of whole lines or blocks) and trailing commas."""
    bare = F.regexp_replace(text, r"(?m)^[ \t]*//[^\n]*$|(?s:/\*.*?\*/)", "")
    return F.regexp_replace(bare, r",(\s*[}\]])", "$1")


def script_aliases(contents: DataFrame) -> DataFrame:
    """repo_id, prefix, ord, place: path aliases that end with a star, of tsconfig and jsconfig files; places are tried in
    order of ord, the first file's first."""
    options = F.from_json(plain_json(F.col("text")), "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    files = contents.filter(P.name(F.col("path")).isin("tsconfig.json", "jsconfig.json")).select("repo_id", "path", options["compilerOptions"].alias("o"))
    each = files.select("repo_id", "path", joined(P.parent(F.col("path")), F.coalesce("o.baseUrl", F.lit("."))).alias("base"), F.explode("o.paths").alias("alias", "targets")).filter(F.col("alias").endswith("*") & (F.length("alias") > 1))
    places = each.select("repo_id", "path", "alias", "base", F.posexplode("targets").alias("n", "target"))
    first = F.row_number().over(W.partitionBy("repo_id").orderBy("path", "alias", "n"))
    return places.select("repo_id", F.regexp_replace("alias", r"\*$", "").alias("prefix"), first.alias("ord"), joined(F.col("base"), F.regexp_replace("target", r"\*+$", "")).alias("place"))


def aliased(found: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of script imports by a path alias: a file at the first place that has one, else unresolved."""
    own = found.filter(F.col("language").isin(*SCRIPTS) & ~F.col("spec").startswith(".")).select("id", "repo_id", F.element_at(F.split("spec", r"\?", 2), 1).alias("bare"))
    aliases = script_aliases(contents)
    # a prefix is joined by equality: all beginnings of an import are tried
    starts = own.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("bare"))), lambda i: F.left(F.col("bare"), i))))
    by = starts.join(aliases, ["repo_id", "prefix"])
    least = by.groupBy("id").agg(F.min_by("prefix", "ord").alias("prefix"))
    path = joined(F.col("place"), F.substring(F.col("bare"), F.length("prefix") + 1, F.length("bare")))
    tried = by.join(least, ["id", "prefix"]).select("id", "repo_id", "ord", F.posexplode(script_places(path)).alias("nth", "target"))
    files = known.filter("is_file").select("repo_id", "target")
    hit = tried.join(files, ["repo_id", "target"]).groupBy("id").agg(F.min_by("target", F.struct("ord", "nth")).alias("target"))
    return least.select("id").join(hit, "id", "left").select("id", F.when(F.col("target").isNull(), "unresolved").otherwise("internal").alias("kind"), "target")


def js_packages(found: DataFrame, contents: DataFrame, known: DataFrame) -> DataFrame:
    """Outcomes of imports of nested workspace packages by name; others are external. What follows the name is a file below
    the package or its src; without such a file, the package's directory stands for the import."""
    bare = F.element_at(F.split("spec", r"\?", 2), 1)
    own = found.filter(F.col("language").isin(*SCRIPTS) & ~F.col("spec").startswith(".")).select("id", "repo_id", bare.alias("bare"), F.regexp_extract(bare, r"^(@[^/]+/[^/]+|[^/]+)", 1).alias("package"))
    named = contents.filter((P.name(F.col("path")) == "package.json") & F.col("path").contains("/")).select("repo_id", F.get_json_object("text", "$.name").alias("package"), P.parent(F.col("path")).alias("root")).filter("package is not null").groupBy("repo_id", "package").agg(F.max("root").alias("root"))
    placed = own.join(named, ["repo_id", "package"], "left").withColumn("sub", F.regexp_replace(F.substring(F.col("bare"), F.length("package") + 1, F.length("bare")), "^/+", ""))
    root, sub = F.col("root"), F.col("sub")
    places = F.concat(script_places(joined(root, sub)), script_places(joined(root, F.lit("src"), sub)))
    tried = placed.filter("root is not null and sub <> ''").select("id", "repo_id", F.posexplode(places).alias("nth", "target"))
    files = known.filter("is_file").select("repo_id", "target")
    hit = tried.join(files, ["repo_id", "target"]).groupBy("id").agg(F.min_by("target", "nth").alias("file"))
    return placed.join(hit, "id", "left").select("id", F.when(root.isNull(), "external").otherwise("internal").alias("kind"), F.coalesce("file", "root").alias("target"))


def resolved(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """repo_id, path, language, spec, kind (internal, external, unresolved), target of every import."""
    # texts are read and parsed once; what follows joins narrow rows. 128 bits name an import among any number of them
    key = F.unhex(F.md5(F.to_json(F.struct("repo_id", "path", "language", "spec", "level"))))
    found = stored(imports(contents).withColumn("id", key))
    once = found.dropDuplicates(["id"])
    known = stored(nodes(tree).distinct())
    by_place = candidates(once).join(known, ["repo_id", "target"])
    # a directory stands for a Python package without a file of its own; scripts and crates need files
    valid = by_place.filter(F.col("is_file") | (F.col("language") == "Python"))
    first = valid.groupBy("id").agg(F.min_by("target", "priority").alias("target"))
    placed = candidates(once).select("id").distinct().join(first, "id", "left").select("id", F.when(F.col("target").isNull(), "unresolved").otherwise("internal").alias("kind"), "target")
    by_alias = aliased(once, contents, known)
    outside = once.filter((F.col("language") == "Rust") & ~F.array_contains(P.directories(F.col("path")), "src")).select("id", F.lit("unresolved").alias("kind"), F.lit(None).cast("string").alias("target"))
    every = placed.unionByName(absolute_python(once, known)).unionByName(jvm(once, known)).unionByName(go(once, contents, known)).unionByName(by_alias).unionByName(js_packages(once, contents, known).join(by_alias.select("id"), "id", "left_anti")).unionByName(outside)
    return found.join(every, "id").select("repo_id", "path", "language", "spec", "kind", "target")


def edges(outcomes: DataFrame) -> DataFrame:
    """repo_id, src, dst, weight: internal imports of another file or directory."""
    return outcomes.filter("kind = 'internal' and target <> path").groupBy("repo_id", F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def import_statistics(outcomes: DataFrame) -> DataFrame:
    own = F.col("kind") == "internal"
    return outcomes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("imports_found"), F.count_if(own & (F.col("target") != F.col("path"))).alias("internal_resolved"), F.count_if(F.col("kind") == "external").alias("external"), F.count_if(F.col("kind") == "unresolved").alias("unresolved"))


def module_edges(file_edges: DataFrame, modules: DataFrame, most: int = 150) -> DataFrame:
    """modules(repo_id, module): edges between the modules that hold their ends, self-edges dropped, the heaviest ones."""
    named = lambda end: modules.withColumnRenamed("module", f"{end}_module")
    placed = G.longest_prefix(file_edges, "src", named("src"), "src_module", ["repo_id"])
    both = G.longest_prefix(placed, "dst", named("dst"), "dst_module", ["repo_id"]).filter("src_module <> dst_module")
    summed = both.groupBy("repo_id", F.col("src_module").alias("src"), F.col("dst_module").alias("dst")).agg(F.sum("weight").alias("weight"))
    return G.cap_per_group(summed, ["repo_id"], [F.desc("weight"), "src", "dst"], most)


def hubs(file_edges: DataFrame, known: DataFrame, most: int = 10) -> DataFrame:
    """Files that most other files import."""
    files = known.filter("is_file").select("repo_id", F.col("target").alias("dst"))
    into = file_edges.join(files, ["repo_id", "dst"], "left_semi").groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    return G.cap_per_group(into, ["repo_id"], [F.desc("fan_in"), "path"], most)


LAYOUT = "repo_id string, node string, layer int, row int, position int, x double, y double, cut array<string>"


def layered(file_edges: DataFrame, graph_nodes: DataFrame, per_row: int = 6) -> DataFrame:
    """graph_nodes(repo_id, node) in layers by longest path, cycles cut at back edges of a depth-first walk in order of names,
    rows ordered by the mean place of a node's predecessors and wrapped at per_row; cut lists the ends of a node's back edges. A
    drawn graph is small; one meets in a task."""

    def run(key: tuple, names: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        order = sorted(names["node"])
        after: dict[str, list[str]] = {n: [] for n in order}
        for s, d in sorted(zip(links["src"], links["dst"], strict=True)):
            if s in after and d in after and s != d:
                after[s].append(d)
        state: dict[str, int] = {}
        back: set[tuple[str, str]] = set()
        for root in order:
            if root in state:
                continue
            walk: list[tuple[str, Iterator[str]]] = [(root, iter(after[root]))]
            state[root] = 1
            while walk:
                node, rest = walk[-1]
                for d in rest:
                    if state.get(d) == 1:
                        back.add((node, d))
                    elif d not in state:
                        state[d] = 1
                        walk.append((d, iter(after[d])))
                        break
                else:
                    state[node] = 2
                    walk.pop()
        before: dict[str, list[str]] = {n: [] for n in order}
        cut: dict[str, list[str]] = {n: [] for n in order}
        for s in order:
            for d in dict.fromkeys(after[s]):
                if (s, d) in back:
                    cut[s].append(d)
                else:
                    before[d].append(s)
        waits = {n: len(before[n]) for n in order}
        layer = {n: 0 for n in order}
        ready = [n for n in order if not waits[n]]
        for n in ready:  # grows as nodes become ready
            for d in dict.fromkeys(after[n]):
                if (n, d) not in back:
                    layer[d] = max(layer[d], layer[n] + 1)
                    waits[d] -= 1
                    if not waits[d]:
                        ready.append(d)

        rows, y, place = [], 0.0, {}
        by_layer: dict[int, list[str]] = {}
        for n in order:
            by_layer.setdefault(layer[n], []).append(n)
        for i in sorted(by_layer):
            mean = lambda n: sum(place[p] for p in before[n]) / len(before[n]) if before[n] else 0.0
            row = sorted(by_layer[i], key=lambda n: (mean(n), n))
            for k, n in enumerate(row):
                place[n] = float(k % per_row)
                rows.append((key[0], n, i, k // per_row, k % per_row, float(k % per_row), y + k // per_row, cut[n]))
            y += -(-len(row) // per_row)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")])

    # new names: both may stem from one table
    names = graph_nodes.select(F.col("repo_id").alias("repo"), "node")
    links = file_edges.select(F.col("repo_id").alias("of"), "src", "dst")
    return names.groupBy("repo").cogroup(links.groupBy("of")).applyInPandas(run, LAYOUT)


def neighbours(file_edges: DataFrame, node: str) -> DataFrame:
    """A node's edges in and out, the heaviest first."""
    into = file_edges.filter(F.col("dst") == node).select("repo_id", F.lit("in").alias("direction"), F.col("src").alias("node"), "weight")
    return into.union(file_edges.filter(F.col("src") == node).select("repo_id", F.lit("out"), F.col("dst"), "weight")).orderBy("repo_id", "direction", F.desc("weight"), "node")
