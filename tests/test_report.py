from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.operators import health, views
from lodestrata.plans.report import Snapshot, blocks, report
from lodestrata.plans.shared import stored
from lodestrata.sources import documents
from tests.test_analyses import contents_of, rows, tree_of

FILES = {
    "README.md": "# Demo\n\n## Install\n\n## Usage\n\n" + "word " * 320,
    "LICENSE": "MIT", "CONTRIBUTING.md": "x", ".gitignore": ".env\n",
    "pyproject.toml": '[project]\nname = "d"\ndependencies = ["fastapi>=1", "httpx"]\n[project.optional-dependencies]\ndev = ["pytest"]\n[tool.ruff]\n',
    "app/__init__.py": "", "app/api/routes.py": "from app.services import core\n# TODO: more\n", "app/services/core.py": "def f():\n    return 1\n", "main.py": "from app.api import routes\n",
    "tests/test_core.py": "from app.services.core import f\n", "docs/guide.md": "x", ".github/workflows/ci.yml": "on: push\n", "Dockerfile": "FROM python:3.12\n", "node_modules/x/i.js": "",
}


def test_golden_repository(spark):
    tree, contents = tree_of(spark, FILES, 100), contents_of(spark, {p: t for p, t in FILES.items() if "node_modules" not in p})
    repos = spark.createDataFrame([("r", "MIT", False, datetime(2024, 1, 1), datetime(2024, 1, 1)), ("bare", None, True, datetime(2020, 1, 1), None)], "repo_id string, license_spdx string, archived boolean, pushed_at timestamp, head_commit_date timestamp")
    got = report(Snapshot(repos, tree, contents), F.lit("2024-01-15").cast("timestamp"))
    checks = spark.createDataFrame(got.checks.collect(), got.checks.schema)  # made once
    scores = {(r.repo_id, r.dimension): r.score for r in health.dimensions(checks).collect()}
    assert len(scores) == 14
    assert scores[("r", "documentation")] == 90 and scores[("r", "activity")] == 100 and scores[("r", "structure")] == 75 and scores[("r", "tests")] == 100
    assert scores[("bare", "tests")] is None and scores[("bare", "dependencies")] is None and scores[("bare", "activity")] == 0
    failed = {r.id for r in checks.filter("repo_id = 'r' and not passed").collect()}
    assert {"structure.no_artifacts", "documentation.changelog", "dependencies.constraints"} <= failed
    edges = {(r.src, r.dst) for r in got.edges.collect()}
    assert {("app/api/routes.py", "app/services/core.py"), ("tests/test_core.py", "app/services/core.py"), ("main.py", "app/api/routes.py")} <= edges


def test_document_of_a_repository(spark):
    tree, contents = stored(tree_of(spark, FILES, 100)), stored(contents_of(spark, {p: t for p, t in FILES.items() if "node_modules" not in p}))
    repos = stored(spark.createDataFrame([("r", "MIT", False, datetime(2024, 1, 1), datetime(2024, 1, 1), "A demo", "https://x.org/r")], "repo_id string, license_spdx string, archived boolean, pushed_at timestamp, head_commit_date timestamp, description string, html_url string"))
    snapshot = Snapshot(repos, tree, contents)
    every = blocks(snapshot, report(snapshot, F.lit("2024-01-15").cast("timestamp")))
    body = documents.documents(repos.select("repo_id", F.lit("Report: r").alias("title"), F.lit("0123456").alias("subtitle")), every).first().body
    assert body.startswith("# Report: r\n\n_0123456_\n\nA demo\n\n| Field | Value |\n| --- | --- |\n| Repository | https://x.org/r |\n| License | MIT |\n")
    assert [x[3:] for x in body.splitlines() if x.startswith("## ")] == ["Health indicators", "Structure", "Languages", "Dependencies", "Code quality", "Security indicators", "Architecture"]
    for line in ("| documentation | 90 |", "| documentation.changelog | fail |", "- 14 files (13 analyzed, 1 in ignored directories)", "| fastapi | >=1 |".replace(">", "\\>"), "| PyPI |", "- Frameworks: ", "- Entry points: "):
        assert line in body, (line, body)


def test_views(spark):
    stats = spark.createDataFrame([("r", "a", "programming", 60), ("r", "b", "prose", 30), ("r", "c", "programming", 10), ("r", "d", "programming", 5)], "repo_id string, language string, kind string, bytes long")
    assert rows(views.languages(stats), "language", "percent_of_bytes") == [("a", 80.0), ("c", 10 / 75 * 100), ("d", 5 / 75 * 100)]
    assert rows(views.with_rest(stats, "language", "bytes", 2), "language", "bytes") == [("Other", 15), ("a", 60), ("b", 30)]
    shown = spark.range(1).select(views.compact_count(F.lit(1500)), views.compact_count(F.lit(999)), views.compact_bytes(F.lit(2048)), views.relative_time(F.lit("2024-01-01").cast("date"), F.lit("2024-01-04").cast("date"))).first()
    assert tuple(shown) == ("1.5k", "999", "2.0 KB", "3 days ago")
