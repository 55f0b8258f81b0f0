"""Queries on tables of which a report would list only the beginning, against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import architecture
from lodestrata.plans import analyses, queries  # noqa: F401  analyses registers its queries
from tests.test_analyses import rows


def same_as_sql(spark, folder, name, table):
    """The query's rows, which its SQL has too."""
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = sorted((tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return [dict(zip(columns, r)) for r in got]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """A rule on nine lines, rules beyond 2000 characters of a line, after long quoted texts too, and long secrets' lines."""
    folder = str(tmp_path_factory.mktemp("documents"))
    long = "word " * 6000
    texts = {
        0: "x = eval(y)\n" * 9, 2: long + "AKIA" + "A1" * 8 + " end", 9: f'"{long}" + eval(z)', 18: f"'{long}", 27: f'y = "{long} eval(z)"',
        3: f"`{long}` + eval(z)", 10: "\"" + "\\\"" * 9000 + "\" + exec(z)", 7: "get verify=False\n" * 7 + long + "passthru($x);", 36: "a " * 300 + "ghp_" + "b4" * 18 + " c" * 300,
    }
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def manifests(spark, tmp_path_factory):
    """One repository with 702 manifests of three dependencies each; the last two name its only frameworks."""
    folder = str(tmp_path_factory.mktemp("manifests"))
    keys = [14 + 240 * j for j in range(700)] + [14 + 80 * 2101, 14 + 80 * 2102]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").withColumn("p_size", F.lit(1)).write.parquet(f"{folder}/part.parquet")
    return folder


def test_project_types_of_late_manifests(spark, manifests):
    assert {r["label"] for r in same_as_sql(spark, manifests, "g07_project_types", "part")} == {"Web frontend", "Web / API service"}


def test_project_types_name_every_framework(spark):
    names = ["Angular", "Next.js", "React", "Svelte", "Vue"]
    found = spark.createDataFrame([("r", n, "frontend", "") for n in reversed(names)], "repo_id string, framework string, category string, evidence string")
    assert rows(architecture.project_types(found), "label", "evidence") == [("Web frontend", ", ".join(names))]


def test_frameworks_of_late_manifests(spark, manifests):
    assert [r["framework"] for r in same_as_sql(spark, manifests, "j05_frameworks", "part")] == ["Express", "React"]


def test_filtered_dependencies_are_all_there(spark, manifests):
    assert len(same_as_sql(spark, manifests, "p28_dependency_filter", "part")) == 2 * 702


def test_rules_of_whole_texts(spark, documents):
    """Every rule's line, not the first five of a file, and all of a line."""
    got = {r["rule"]: r["findings"] for r in same_as_sql(spark, documents, "u08_rule_findings", "documents")}
    assert got["code.python-eval"] >= 9 + 2 and got["code.tls-verify-disabled"] >= 7 and {"code.js-eval", "code.php-dangerous", "secret.aws-access-key"} <= set(got)


def test_findings_show_whole_lines(spark, documents):
    found = same_as_sql(spark, documents, "v16_document_findings", "documents")
    token = next(r for r in found if r["rule"] == "secret.github-token" and r["path"] == "src/d36.py")
    assert token["evidence"].startswith("a a ") and token["evidence"].endswith("c c") and "ghp_********(40 chars)" in token["evidence"]
    assert sum(r["rule"] == "code.python-eval" and r["path"] == "src/d0.py" for r in found) == 9
