"""JSON manifests as columns, against the standard library's parser."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import dependencies
from lodestrata.plans import repository
from lodestrata.sources import manifests

SPECS = ["1", "", "git+https://h/r", "github:a/b", "owner/name", "owner/name#v1", "a/b/c", "file:../x", "link:x", "portal:x", "http://h/x", "https://h/x.tgz", "workspace:*", 5, 1.5, None, True, {"version": "1"}, ["1"], "é\"\\n", "null"]
TEXTS = [
    *(json.dumps({"dependencies": {"a/x": s, f"b{i}/y": s}, "require": {"ext-a/b": s, "lib-a/b": s, "php": s, "c/d": s}}) for i, s in enumerate(SPECS)),
    '{"dependencies": {"z": "1", "a": "2", "z": "3", "": "4"}, "devDependencies": {"m": "1"}, "dependencies": {"q": "1", "b": "2", "q": "5"}}',
    '{"dependencies": [1], "devDependencies": {"z": "1"}, "peerDependencies": "x", "optionalDependencies": null}', '{"dependencies": "{\\"q\\": \\"1\\"}", "peerDependencies": {"p": "1"}}',
    ' \n{"require-dev": {"x/y": "1"}}\r\n\t', "{}", "", "  ", "null", "[]", "[{}]", '"{}"', "5", "{", '{"a": 1} x', '{} {}', "{}, {}", "{}] [{}", '{}, "end"', "{'a': 1}", '{"a": 1,}', '{"a": NaN}', '{"a": 01}', '{"a": "x\ty"}', "\ufeff{}", "// c\n{}", '{"dependencies": {"a": "1"}} ]',
]
SECTIONS = {"package.json": ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"], "composer.json": ["require", "require-dev"]}


def plain(name, text):
    """(error, [(section's place, name, version)])."""
    try:
        data = json.loads(text)
    except ValueError:
        return manifests.NOT_JSON, []
    if not isinstance(data, dict):
        return f"{name} must contain an object", []
    found = [(i, k, v if isinstance(v, str) else None) for i, s in enumerate(SECTIONS[name]) if isinstance(data.get(s), dict) for k, v in data[s].items()]
    return None, [d for d in found if name == "package.json" or "/" in d[1] and not d[1].startswith(("ext-", "lib-"))]


@pytest.mark.parametrize("name", SECTIONS)
def test_json_manifests_as_the_standard_parser_has_them(spark, name):
    rows = spark.createDataFrame([(str(i), f"p/{name}", t) for i, t in enumerate(TEXTS)] + [("none", name, None)], "repo_id string, path string, text string")
    got = {r.repo_id: r for r in manifests.parsed(rows).collect()}
    scopes = list(manifests.JSON_SECTIONS[name].values())
    assert set(got) == {str(i) for i in range(len(TEXTS))}
    for i, text in enumerate(TEXTS):
        error, found = plain(name, text)
        assert (got[str(i)].error, [(d.scope, d.name, d.version) for d in got[str(i)].dependencies]) == (error, [(scopes[k], n, v) for k, n, v in found]), text


def test_sources_of_packages(spark):
    rows = spark.createDataFrame([(s,) for s in SPECS if isinstance(s, str)], "s string").select("s", manifests.npm_source(F.col("s")).alias("source"))
    want = {"git": {"git+https://h/r", "github:a/b", "owner/name", "owner/name#v1"}, "path": {"file:../x", "link:x", "portal:x"}, "url": {"http://h/x", "https://h/x.tgz"}}
    assert all((r.source in want and r.s in want[r.source]) or (r.source == "registry" and all(r.s not in v for v in want.values())) for r in rows.collect())


def test_json_manifests_need_no_python(spark):
    rows = spark.createDataFrame([("r", "package.json", "npm", "{}")], "repo_id string, path string, ecosystem string, text string")
    plan = manifests.by_columns(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_json_is_parsed_once_a_text(spark):
    """What explodes or filters dependencies mustn't parse their texts again."""
    rows = spark.createDataFrame([("r", "package.json", '{"dependencies": {"a": "1"}}')], "repo_id string, path string, text string").localCheckpoint()
    listed = dependencies.listed(manifests.parsed(rows))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3  # the check, and the sections of two formats
    assert not any("from_json(" in line for line in plan.splitlines() if "Filter" in line)
    assert [(r.ord, r.name, r.constraint) for r in listed.collect()] == [(0, "a", "exact")]


def test_repositories_rows_are_dealt_to_tasks(spark, tmp_path):
    spark.range(100).selectExpr("cast(id as int) as p_partkey", "1 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert len(repository.numbered(spark, str(tmp_path)).inputFiles()) > 1
    assert len(repository.contents(spark, str(tmp_path)).inputFiles()) > 1
