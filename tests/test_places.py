"""Imports that several files could mean, and trees of a bounded number of nodes."""

from lodestrata.operators import graph, structure
from tests.test_analyses import contents_of, tree_of


def test_suffixes_that_several_files_share(spark):
    """Against comparing every import with every path."""
    dirs = ["a/com/x", "b/com/x", "b/com", "c/org/y/com/x"]
    files = [f"{d}/{n}.{e}" for d in dirs for n, e in (("Utils", "java"), ("B", "kt"))] + ["a/com/x/Utils.kt", "d/Only.scala", "x/Utils"]
    known = graph.nodes(tree_of(spark, files)).distinct()
    specs = ["Utils", "x.Utils", "com.x.B", "y.com.x.B", "b.com.B", "Only", "d.Only", "tils", "com.x.*", "org.y.*", "org.*", "none.*", "a.com.x.Utils"]
    found = spark.createDataFrame([(s, "r", "Java", s) for s in specs], "id string, repo_id string, language string, spec string")
    got = {r.id: (r.kind, r.target) for r in graph.jvm(found, known).collect()}
    every = {d for f in files for d in ["/".join(f.split("/")[:i]) for i in range(1, f.count("/") + 1)]}
    for s in specs:
        end = "/" + s.removesuffix(".*").replace(".", "/")
        hits = [p for p in every if ("/" + p).endswith(end)] if s.endswith(".*") else [f for f in files if f.endswith((".java", ".kt", ".scala")) and ("/" + f.rpartition(".")[0]).endswith(end)]
        assert got[s] == ("internal", hits[0]) if len(hits) == 1 else got[s] == ("unresolved" if hits else "external", None), s


def test_python_roots(spark):
    files = {"a/utils/x.py": "", "b/utils/x.py": "", "utils.py": "", "src/utils/y.py": "", "src/x/__init__.py": "", "x.py": "", "a/m.py": "import utils.x\nimport utils.y\nimport utils.none\nimport x.q\n", "b/n/m.py": "import utils.x.f\nimport n.o\nimport zz\n"}
    got = {(r.path, r.spec): (r.kind, r.target) for r in graph.resolved(tree_of(spark, files), contents_of(spark, files)).collect()}
    assert got == {
        ("a/m.py", "utils.x"): ("internal", "a/utils/x.py"), ("a/m.py", "utils.y"): ("internal", "src/utils/y.py"), ("a/m.py", "utils.none"): ("internal", "utils.py"),
        ("a/m.py", "x.q"): ("unresolved", None), ("b/n/m.py", "utils.x.f"): ("internal", "b/utils/x.py"), ("b/n/m.py", "n.o"): ("internal", "b/n"), ("b/n/m.py", "zz"): ("external", None),
    }


def test_files_below_workspace_packages(spark):
    files = {"packages/ui/package.json": '{"name": "@w/ui"}', "packages/ui/src/button.tsx": "", "packages/ui/theme/index.ts": "", "app/a.ts": "import b from '@w/ui/button'\nimport t from '@w/ui/theme?raw'\nimport u from '@w/ui'\nimport n from '@w/ui/none'\nimport o from '@w/other/x'\n"}
    got = {r.spec: (r.kind, r.target) for r in graph.resolved(tree_of(spark, files), contents_of(spark, files)).collect()}
    assert got == {"@w/ui/button": ("internal", "packages/ui/src/button.tsx"), "@w/ui/theme?raw": ("internal", "packages/ui/theme/index.ts"), "@w/ui": ("internal", "packages/ui"), "@w/ui/none": ("internal", "packages/ui"), "@w/other/x": ("external", None)}


def walked(entries, budget):
    """A walk of the tree, level by level, without ignored directories."""
    below, kinds, size = {"": set()}, {"": "dir"}, {}
    for path, kind in entries:
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            at, up = "/".join(parts[:i]), "/".join(parts[: i - 1])
            below[up].add(at)
            kinds.setdefault(at, "dir" if i < len(parts) else kind)
            below.setdefault(at, set())
        for i in range(len(parts) + (kind == "file")):
            at = "/".join(parts[:i])
            size[at] = size.get(at, 0) + (10 if kind == "file" else 0)
    out, level = [("", 0)], [""]
    omitted = {}
    while level:
        following = []
        for up in level:
            names = sorted(below[up], key=lambda p: (kinds[p] != "dir", p.rpartition("/")[2].lower(), p))
            left = budget + 1 - len(out)
            out += [(p, len(out) + i) for i, p in enumerate(names[: max(0, left)])]
            omitted[up] = max(0, len(names) - max(0, left))
            following += [p for p in names[: max(0, left)] if kinds[p] == "dir"]
        level = following
    return {p: (rank, kinds[p], size.get(p, 0), omitted.get(p, 0)) for p, rank in out}


def test_trees_against_a_walk(spark):
    import random

    rng = random.Random(5)
    names = ["a", "A", "b", "Zed", "m.x", "é", "b-1", "B"]
    paths = {}
    for _ in range(120):
        path = "/".join(rng.choice(names) for _ in range(rng.randint(1, 4)))
        if not any(p.startswith(path + "/") or path.startswith(p + "/") or p == path for p in paths):
            paths[path] = rng.choice(["file", "file", "symlink", "submodule"])
    paths["empty"] = "dir"
    rows = [("r", i, p, k, 10 if k == "file" else 0) for i, (p, k) in enumerate(paths.items())]
    rows += [("r", 999, None, "file", 1)]
    tree = spark.createDataFrame(rows, "repo_id string, ord int, path string, type string, size long")
    for budget in (0, 1, 7, 30, 1000):
        got = {r.path: (r["rank"], r.type, r.size, r.omitted_children) for r in structure.bounded_tree(tree, budget).collect()}
        assert got == walked(paths.items(), budget)
    assert structure.bounded_tree(tree.limit(0)).count() == 0


def test_ignored_directories_are_leaves(spark):
    tree = tree_of(spark, ["src/a.py", "web/node_modules/x/y.js", "web/node_modules/z.js", "dist/"])
    got = {r.path: (r.type, r.size, r.files, r.ignored, r.omitted_children) for r in structure.bounded_tree(tree).drop("rank").collect()}
    assert got == {"": ("dir", 30, 3, False, 0), "src": ("dir", 10, 1, False, 0), "src/a.py": ("file", 10, 0, False, 0), "web": ("dir", 20, 2, False, 0), "web/node_modules": ("dir", 20, 2, True, 0), "dist": ("dir", 0, 0, True, 0)}
    plan = structure.bounded_tree(tree, 500)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Python" not in plan
