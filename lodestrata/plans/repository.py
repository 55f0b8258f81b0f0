"""Repositories made from the driver's tables: `part` gives a file tree and contents, of which every operator of repository
analyses can be run on whole tables and said again in SQL. Rules are stated as fixed tables in both.

Paths and texts are stored, as those of real repositories are: expressions then read them and don't make them again at each
place where they are named. Keys are dealt to many tasks before, since a file of parts is small and what is made of it isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread, stored

# Directories (ignored root, auxiliary, of tests) and kinds of files (text before and after the key, language
# and category of such a file).
DIRS = [
    ("", None, False, False), ("src", None, False, False), ("src/api", None, False, False), ("tests", None, True, True),
    ("docs", None, True, False), ("node_modules/x", "node_modules", False, False), ("lib/build", None, False, False),
    ("build/out", "build", False, False), ("packages/a/src", None, False, False), (".github/workflows", None, False, False),
    ("examples", None, True, False), ("app/models", None, False, False),
]
FILES = [
    ("m", ".py", "Python", "source"), ("u", ".ts", "TypeScript", "source"), ("test_m", ".py", "Python", "test"), ("g", ".go", "Go", "source"),
    ("page", ".html", "HTML", "source"), ("logo", ".svg", None, "asset"), ("blob", ".bin", None, "binary"), ("data", ".json", "JSON", "data"),
    ("notes", ".md", "Markdown", "documentation"), ("conf", ".yml", "YAML", "config"), ("app", ".min.js", "JavaScript", "generated"),
    ("n", "/yarn.lock", None, "lockfile"), ("n", "/Dockerfile", "Dockerfile", "config"), ("n", "/README.md", "Markdown", "documentation"),
    ("n", "/package.json", "JSON", "data"), ("file", "", None, "other"),
]
PY, TS, GO, HTML, README, PACKAGE, DOCKER = 0, 1, 3, 4, 13, 14, 12


def at(values: list, place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, repo_id, kind, path and size of each part's file."""
    k = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), (k % 16).cast("int").alias("kind"), F.floor(k / 3).cast("long").alias("d"), (F.col("p_size").cast("long") * 997).alias("size"))
    parts = spread(parts, "k")
    folder = at([d for d, *_ in DIRS], F.col("d") % len(DIRS))
    name = F.concat(at([a for a, *_ in FILES], F.col("kind")), F.col("k").cast("string"), at([b for _, b, *_ in FILES], F.col("kind")))
    return stored(parts.select("k", F.concat(F.lit("r"), (F.col("k") % 5).cast("string")).alias("repo_id"), "kind", F.concat(folder, F.when(folder != "", "/").otherwise(""), name).alias("path"), "size"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark, sf_dir)
    return rows.select("repo_id", F.col("k").cast("int").alias("ord"), "path", F.lit("file").alias("type"), "size")


def text_of(kind: Column, k: Column) -> Column:
    """Sources whose lines, markers, imports and dependencies vary with the key."""
    s = lambda n: (k % n).cast("string")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    key = k.cast("string")
    python = join("# TODO: fix ", key, "\nimport os\n\ndef f", key, "(a):\n    # x = a + 1\n    # return x\n    if a and ", s(3), ":\n        return os.environ[\"KEY_", s(4), "\"]\n    return None\n", F.repeat(F.lit("# HACK\n"), (k % 3).cast("int")))
    script = join("/* block\n comment */\nimport { x } from \"./u", (k + 720).cast("string"), "\"\nconst a = 1; // FIXME: ", key, "\nif (a && x) { for (;;) { } }\nconst u = \"http://host", s(3), ".com/x\"\n")
    package = join('{"dependencies": {"Left": "^1.', s(3), '.0", "', at(["react", "express", "other"], k % 3), '": "', s(4), '.0.0"}, "devDependencies": {"', at(["jest", "left"], k % 2), '": "29.0.0"}}')
    readme = join("# Title ", key, "\n\nSee [a](./m", key, ".py) and [b](https://x.org) ![c](/d.png)\n```\n# not a heading\n```\nSub ", s(7), "\n---\nThe end.\n")
    docker = join("FROM python\nFROM node:18 AS build\nFROM build\nFROM img", s(3), ":latest\n")
    return (
        F.when(kind == PY, python).when(kind == TS, script).when(kind == GO, "package main\n// XXX\nfunc main() {\n}\n").when(kind == HTML, "<!-- c\n d -->\n<p>x</p>\n")
        .when(kind == README, readme).when(kind == PACKAGE, package).when(kind == DOCKER, docker)
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the files that have one and lie outside ignored directories."""
    rows = numbered(spark, sf_dir).withColumn("text", text_of(F.col("kind"), F.col("k"))).filter("text is not null")
    return stored(rows.filter(~F.col("path").rlike("^(node_modules|build)/")).select("repo_id", "path", "text"))


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else "'" + v + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, (i, *r))) + ")" for i, r in enumerate(rows))


#: t: the tree with what is expected of each path; c: contents of known files outside ignored directories.
SQL = f"""WITH RECURSIVE dirs(d, dir, ignored, aux, tests) AS (VALUES {_values(DIRS)}),
kinds(f, pre, post, lang, cat) AS (VALUES {_values(FILES)}),
t AS (SELECT p_partkey AS k, 'r' || (p_partkey % 5) AS repo_id, CAST(p_partkey AS INTEGER) AS ord, f, dir, dir || CASE WHEN dir <> '' THEN '/' ELSE '' END || pre || p_partkey || post AS path,
 CAST(p_size AS BIGINT) * 997 AS size, ignored, aux, lang AS language,
 CASE WHEN tests AND cat IN ('source', 'config') AND lang NOT IN ('YAML') THEN 'test' WHEN dir = '.github/workflows' AND cat IN ('data', 'other') THEN 'config' ELSE cat END AS category
 FROM part JOIN kinds ON f = p_partkey % 16 JOIN dirs ON d = (p_partkey // 3) % {len(DIRS)}),
own AS (SELECT * FROM t WHERE ignored IS NULL),
c AS (SELECT * FROM own WHERE f IN ({PY}, {TS}, {GO}, {HTML}, {README}, {PACKAGE}, {DOCKER}))
"""
