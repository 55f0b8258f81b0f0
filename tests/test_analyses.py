import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import dependencies, documentation, graph, health, languages, quality, security, selection, structure
from lodestrata.streaming import limiter

TREE = "repo_id string, ord int, path string, type string, size long"
CONTENT = "repo_id string, path string, text string"


def tree_of(spark, paths, size=10):
    return spark.createDataFrame([("r", i, p, "dir" if p.endswith("/") else "file", 0 if p.endswith("/") else size) for i, p in enumerate(paths)], TREE).withColumn("path", F.regexp_replace("path", "/$", ""))


def contents_of(spark, files):
    return spark.createDataFrame([("r", p, t) for p, t in files.items()], CONTENT)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_sanitizing(spark):
    raw = spark.createDataFrame([("r", 0, "a", "blob", "100644", 5), ("r", 1, "../b", "blob", "100644", 1), ("r", 2, "c", "blob", "120000", 3), ("r", 3, "d", "commit", "160000", None), ("r", 4, "e", "odd", "1", 1), ("r", 5, "f", "blob", "100644", -4), ("r", 6, "g", "tree", "40000", None)], "repo_id string, ord int, path string, type string, mode string, size long")
    got = structure.sanitized(raw, 4)
    assert rows(got, "path", "type", "size") == [("a", "file", 5), ("c", "symlink", 0), ("d", "submodule", 0), ("f", "file", 0)]
    assert tuple(structure.sanitizing_notes(raw, 4).first()) == ("r", 4, 1, True)


def test_structure(spark):
    tree = tree_of(spark, ["src/", "src/a.py", "src/b/c.py", "node_modules/x/y.js", "README.md", "dist/"])
    found = structure.analyze(tree)
    totals = found.totals.first()
    assert (totals.total_files, totals.analyzed_files, totals.ignored_files, totals.total_directories, totals.max_depth) == (4, 3, 1, 1, 3)
    assert rows(found.ignored_directories, "path", "files", "bytes") == [("dist", 0, 0), ("node_modules", 1, 10)]
    assert rows(found.directories, "dir", "files", "bytes") == [("src", 2, 20), ("src/b", 1, 10)]


def test_bounded_tree_counts_what_it_leaves_out(spark):
    tree = tree_of(spark, [f"d{i}/f{j}" for i in range(10) for j in range(10)])
    got = {r.path: r for r in structure.bounded_tree(tree, 15).collect()}
    assert len(got) == 16 and sum(r.omitted_children for r in got.values()) == 95
    assert (got[""].size, got[""].files, got["d0"].files) == (1000, 100, 10)


def reference_counts(text, prefixes, start, end):
    n = [0, 0, 0, 0]
    inside = False
    for raw in text.splitlines():
        line = raw.strip()
        n[0] += 1
        if inside:
            n[2] += 1
            inside = end not in line
        elif not line:
            n[3] += 1
        elif start and line.startswith(start):
            n[2] += 1
            inside = end not in line[len(start) :]
        elif any(line.startswith(p) for p in prefixes):
            n[2] += 1
        else:
            n[1] += 1
    return tuple(n)


def test_line_counter_against_a_loop(spark):
    rng = random.Random(3)
    parts = ["/*", "*/", "//", " x", "\n", "\n\n", "\t", "*/ y", "/* z */"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", languages.count_lines(F.col("t"), F.lit("C")).alias("n")).collect()
    assert {r.i: tuple(r.n) for r in got} == {i: reference_counts(t, ("//",), "/*", "*/") for i, t in enumerate(texts)}


def test_language_statistics(spark):
    tree = tree_of(spark, ["a.py", "b.py", "package-lock.json", "node_modules/z.py"], 40)
    got = languages.stats(tree, contents_of(spark, {"a.py": "x\n# y\n\nz\n"})).first()
    assert (got.language, got.files, got.bytes, got.lines, got.lines_estimated, got.code_lines, got.comment_lines, got.blank_lines) == ("Python", 2, 80, 8, True, 2, 1, 1)


def test_quality(spark):
    text = "# TODO: fix (this)\nx = 1\n# a = 1\n# b = 2\n\n# c = 3\ndef f(a):\n    if a and a > 1:\n        return [i for i in a if i]\n    def g(): pass\n"
    contents = contents_of(spark, {"src/a.py": text, "src/bad.py": "def (", "src/b.js": 'if (a && b) { for (;;) { "{{" } } // {\n'})
    assert rows(quality.markers(contents), "line", "tag", "text") == [(1, "TODO", "TODO: fix (this)")]
    assert rows(quality.commented_code(contents), "path", "lines") == [("src/a.py", 2)]
    facts = {r.path: r for r in quality.python_facts(contents).collect()}
    assert [(f.name, f.complexity) for f in facts["src/a.py"].functions] == [("f", 5), ("f.g", 1)] and not facts["src/bad.py"].parsed
    assert rows(quality.brace_complexity(contents), "complexity", "max_nesting") == [(3, 2)]


MANIFESTS = {
    "package.json": ('{"dependencies": {"a": "^1", "b": "u/r"}, "devDependencies": {"c": "2.0.0"}}', {("a", "^1", "production", "registry"), ("b", "u/r", "production", "git"), ("c", "2.0.0", "development", "registry")}),
    "requirements.txt": ("a==1  # x\n-r other\nb[c]>=2 ; python_version > '3'\n-e git+https://h#egg=e\n", {("a", "==1", "production", "registry"), ("b", ">=2", "production", "registry"), ("e", None, "production", "git")}),
    "pyproject.toml": ('[project]\ndependencies = ["a>1"]\n[project.optional-dependencies]\ntest = ["b"]\n[tool.poetry.dependencies]\npython = "3"\nc = {version = "1", optional = true}\n', {("a", ">1", "production", "registry"), ("b", None, "development", "registry"), ("c", "1", "optional", "registry")}),
    "Pipfile": ('[packages]\na = "*"\n[dev-packages]\nb = {path = "x"}\n', {("a", "*", "production", "registry"), ("b", None, "development", "path")}),
    "setup.cfg": ("[options]\ninstall_requires =\n  a>1\n[options.extras_require]\ndocs = b\n", {("a", ">1", "production", "registry"), ("b", None, "development", "registry")}),
    "pom.xml": ("<project><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version><scope>test</scope></dependency></dependencies></project>", {("g:a", "3", "development", "registry")}),
    "build.gradle": ("implementation 'g:a:1'\ntestImplementation(group: 'h', name: 'b', version: '2')\n", {("g:a", "1", "production", "registry"), ("h:b", "2", "development", "registry")}),
    "Cargo.toml": ('[dependencies]\na = "1"\nb = {workspace = true}\n[dev-dependencies]\nc = {git = "u"}\n', {("a", "1", "production", "registry"), ("b", None, "production", "workspace"), ("c", None, "development", "git")}),
    "go.mod": ("module m\nrequire (\n a.b/c v1.0.0\n d v2 // indirect\n)\nrequire e v3\n", {("a.b/c", "v1.0.0", "production", "registry"), ("d", "v2", "production", "registry"), ("e", "v3", "production", "registry")}),
    "composer.json": ('{"require": {"php": ">8", "a/b": "1"}, "require-dev": {"ext-x": "*", "c/d": "2"}}', {("a/b", "1", "production", "registry"), ("c/d", "2", "development", "registry")}),
    "q/Gemfile": ("group :test do\n  platforms :ruby do\n    gem 'a' # x\n  end\n  group :production do\n    gem 'b', '1.0', '< 2'\n  end\n  gem 'c'\nend\nsource 's' do |x|\n  gem 'd', github: 'u/r'\nend\ngem 'e', groups: [:test, :default]\n", {("a", None, "development", "registry"), ("b", "1.0, < 2", "production", "registry"), ("c", None, "development", "registry"), ("d", None, "production", "git"), ("e", None, "production", "registry")}),
    "q/build.gradle.kts": ('api(platform("g:a:1"))\nkapt("h:b:$v")\nimplementation(project(":x"))\nruntime group: \'i\', name: \'c\'\n', {("g:a", "1", "production", "registry"), ("h:b", "$v", "build", "registry"), ("i:c", None, "production", "registry")}),
    "test/requirements-dev.txt": ("# a\n\nz @ git+https://h/z\nhttps://h/y.whl\n-e ./local\n", {("z", None, "development", "git"), ("https://h/y.whl", None, "development", "url"), ("./local", None, "development", "path")}),
    "Gemfile": ("gem 'a', '~> 1'\ngroup :test do\n  gem 'b', path: 'x'\nend\ngem 'c', group: :development\n", {("a", "~> 1", "production", "registry"), ("b", None, "development", "path"), ("c", None, "development", "registry")}),
}


def test_manifests(spark):
    from lodestrata.sources import manifests

    got = manifests.parsed(contents_of(spark, {p: t for p, (t, _) in MANIFESTS.items()} | {"x/package.json": "[", "y/pom.xml": "<!DOCTYPE a><project/>"})).collect()
    found = {r.path: {(d.name, d.version, d.scope, d.source) for d in r.dependencies} for r in got if not r.error}
    assert found == {p: want for p, (_, want) in MANIFESTS.items()}
    assert {r.path for r in got if r.error} == {"x/package.json", "y/pom.xml"}


def test_dependencies(spark):
    files = {"package.json": '{"dependencies": {"Left": "^1.0.0", "w": "workspace:*"}}', "p/package.json": '{"dependencies": {"left": "2.0.0"}}'}
    found = dependencies.analyze(tree_of(spark, [*files, "yarn.lock", "q/go.mod"]), contents_of(spark, files))
    assert rows(found.conflicts, "name", "versions", "manifests") == [("Left", ["2.0.0", "^1.0.0"], ["p/package.json", "package.json"])]
    assert rows(found.dependencies, "name", "constraint") == [("Left", "range"), ("left", "exact"), ("w", "external")]
    assert rows(found.not_analyzed, "path") == [("q/go.mod",)] and found.ecosystems.first().has_lockfile
    totals = found.totals.first()
    assert (totals.total, totals.unique_packages) == (3, 2)


def test_security(spark):
    key = "AK" + "IA" + "ABCDEFGHIJKLMNOP"
    files = {"src/a.py": f'k = "{key}"\neval(x)\n# eval(y)\nu = "http://foo.bar.com/x"\n' + "pickle.load(f)\n" * 9, "tests/a.py": "eval(x)\n", "Dockerfile": "FROM python\nFROM node:18 AS build\nFROM build\n"}
    got = security.with_evidence(security.scan(contents_of(spark, files)))
    assert key not in str(got.collect())
    counts = {(r["path"], r["rule"], r["severity"]): r["count"] for r in got.groupBy("path", "rule", "severity").count().collect()}
    assert counts == {("src/a.py", "secret.aws-access-key", "high"): 1, ("src/a.py", "code.python-eval", "medium"): 1, ("src/a.py", "transport.insecure-http", "low"): 1, ("src/a.py", "code.python-pickle", "medium"): 5, ("tests/a.py", "code.python-eval", "low"): 1, ("Dockerfile", "docker.unpinned-base-image", "low"): 1}


def test_sensitive_files_in_tests_are_summed_up(spark):
    got = security.sensitive_files(tree_of(spark, [*(f"tests/k{i}.pem" for i in range(11)), "id_rsa"]))
    assert got.count() == 5 and got.filter("title like '%+8 more%'").first().severity == "info"


def test_imports_and_modules(spark):
    files = {"pkg/__init__.py": "", "pkg/a.py": "from . import b\nimport os\nimport pkg.c.d\nimport numpy\n", "pkg/b.py": "", "pkg/c/d.py": "from ..a import x\n", "web/src/index.ts": "import {a} from './util'\nimport R from 'react'\nexport * from '../lib/x.js'\nimport z from './none'\n", "web/src/util.ts": "", "web/lib/x.ts": "", "go.mod": "module e.com/m\n", "cmd/main.go": 'import (\n "fmt"\n "e.com/m/inner"\n)\n', "inner/i.go": "", "r/src/main.rs": "use crate::foo::bar;\n", "r/src/foo.rs": "", "j/x/A.java": "import x.B;\nimport java.util.List;\n", "j/x/B.java": "", "k/x/C.java": "import q.D;\n", "k/q/D.java": "", "l/q/D.java": ""}
    outcomes = graph.resolved(tree_of(spark, files), contents_of(spark, files))
    got = {(r.path, r.spec): (r.kind, r.target) for r in outcomes.collect()}
    assert got[("pkg/a.py", "b")] == ("internal", "pkg/b.py") and got[("pkg/a.py", "numpy")] == ("external", None)
    assert got[("pkg/a.py", "pkg.c.d")] == ("internal", "pkg/c/d.py") and got[("pkg/c/d.py", "a.x")] == ("internal", "pkg/a.py")
    assert got[("web/src/index.ts", "../lib/x.js")] == ("internal", "web/lib/x.ts") and got[("web/src/index.ts", "./none")] == ("unresolved", None)
    assert got[("cmd/main.go", "e.com/m/inner")] == ("internal", "inner") and got[("r/src/main.rs", "foo::bar")] == ("internal", "r/src/foo.rs")
    assert got[("j/x/A.java", "x.B")] == ("internal", "j/x/B.java") and got[("k/x/C.java", "q.D")] == ("unresolved", None)
    modules = spark.createDataFrame([("r", m) for m in ("pkg", "pkg/c", "web")], "repo_id string, module string")
    assert rows(graph.module_edges(graph.edges(outcomes), modules), "src", "dst", "weight") == [("pkg", "pkg/c", 1), ("pkg/c", "pkg", 1)]


def test_readme(spark):
    text = "# Title\n## Install\n[x](docs/a.md) [y](missing.md) ![b](https://img.shields.io/x)\n```\n# no\n```\nUsage\n-----\nsome words\n"
    files = {"README.md": text, "docs/a.md": "x"}
    got = documentation.readmes(tree_of(spark, files), contents_of(spark, files)).first()
    assert (got.headings, got.broken_relative_links, got.links, got.images, got.badges, got.code_blocks, got.has_install, got.has_license) == (["Title", "Install", "Usage"], ["missing.md"], 2, 1, 1, 1, True, False)


def test_health(spark):
    names = [(x.split()[0], x.split()[1]) for x in health.FACTS.split(", ")]
    facts = {"source_files": 20, "test_files": 5, "sampled_source_files": 20, "pushed_days": 40, "has_readme": True, "readme_words": 150}
    df = spark.createDataFrame([("r", *[facts.get(n, t == "boolean" and False or 0) if t != "boolean" else bool(facts.get(n)) for n, t in names])], "repo_id string, " + health.FACTS)
    scored = health.scored_checks(df)
    assert scored.count() == 36
    assert {r.dimension: r.score for r in health.dimensions(scored).collect()} == {"documentation": 25, "organization": 60, "tests": 60, "dependencies": None, "activity": 90, "security": 70, "structure": 80}


def test_selection(spark):
    tree = tree_of(spark, ["package.json", "README.md", "src/a.py", "src/b.py", "lib/c.py", ".gitignore", "node_modules/x.js"])
    chosen = selection.selected(tree, 5)
    assert [r.path for r in chosen.orderBy("rank").collect()] == ["package.json", "README.md", ".gitignore", "lib/c.py", "src/a.py"]
    assert selection.within_budget(chosen, 25).count() == 2


@pytest.mark.parametrize(("raw", "want"), [("https://github.com/a/b.git", ("a", "b", None)), ("git@github.com:a/b", ("a", "b", None)), ("a/b", ("a", "b", None)), ("https://gitlab.com/a/b", (None, None, "host")), ("github.com/login/x", (None, None, "owner")), ("a", (None, None, "no repository"))])
def test_repository_key(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "u string").select(selection.repository_key(F.col("u")).alias("k")).first().k) == want


def test_limiter(spark):
    requests = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, 0.0, 0.0, 30.0, 61.0])], "key string, at double, seq long")
    assert [r.retry_after for r in limiter.limited(requests, 2, 60).orderBy("seq").collect()] == [None, None, 60, 30, None]
    assert limiter.limited(requests, 0, 60).filter("allowed").count() == 5


def test_cache_and_coalescing(spark):
    requests = spark.createDataFrame([("s", k, float(t), i) for i, (k, t) in enumerate([("a", 0), ("b", 1), ("a", 2), ("c", 3), ("b", 4), ("a", 5), ("a", 20)])], "shard string, key string, at double, seq long")
    assert [r.hit for r in limiter.cache_replay(requests, 2, 10).orderBy("seq").collect()] == [False, False, True, False, False, False, False]
    spans = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 6)], "key string, start int, end int")
    assert [(r.run, r.leader) for r in limiter.coalesced(spans).orderBy("start").collect()] == [(0, True), (0, False), (5, True)]


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request": "x", "stage": "validate", "ts": "2024-01-01T00:00:00"}\n{"request": "x", "stage": "tree", "ts": "2024-01-01T00:00:01"}')
    stream = limiter.latest_stage(limiter.progress_source(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    stream.awaitTermination(60)
    assert [tuple(r) for r in spark.table("latest").collect()] == [("x", "tree", 2)]


def test_layers(spark):
    edges = spark.createDataFrame([("r", *e) for e in ("ab", "bc", "ca", "ac")], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([("r", n) for n in "abc"], "repo_id string, node string")
    assert rows(graph.layered(edges, nodes), "node", "layer") == [("a", 0), ("b", 1), ("c", 2)]


def test_repository_keys_steps_are_found_once(spark):
    keys = spark.range(1).select(F.col("id").cast("string").alias("u")).select(selection.repository_key(F.col("u")).alias("k"))
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("git@github") == plan.count("[^?#]") == 1


def test_scores_are_found_in_their_row(spark):
    value = lambda n, kind: ((F.col("id") + 7 * n) % 2 == 0) if kind == "boolean" else F.when((F.col("id") + n) % 13 != 0, (F.col("id") * 5 + 3 * n) % 31)
    names = [x.split() for x in health.FACTS.split(", ")]
    facts = spark.range(300).select(F.col("id").cast("string").alias("repo_id"), *[value(n, kind).cast(kind).alias(name) for n, (name, kind) in enumerate(names)])
    grouped = health.dimensions(health.scored_checks(facts))
    by, mean = health.scored_dimensions(facts), health.scored_overall(facts, without=("tests",))
    assert sorted(map(str, by.collect())) == sorted(map(str, grouped.collect()))
    assert sorted(map(str, mean.collect())) == sorted(map(str, health.overall(grouped.filter("dimension <> 'tests'")).collect()))
    assert not any("Aggregate" in df._jdf.queryExecution().optimizedPlan().toString() for df in (by, mean))
