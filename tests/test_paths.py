import pytest
from pyspark.sql import functions as F

from lodestrata.functions import paths as P
from lodestrata.functions import text as T

CASES = [
    # path, safe, ignored, category, language, test
    ("src/build/a.py", True, False, "source", "Python", False),
    ("node_modules/x/y.js", True, True, "source", "JavaScript", False),
    ("dist/a.js", True, True, "source", "JavaScript", False),
    ("Dockerfile.dev", True, False, "config", "Dockerfile", False),
    ("tests/test_a.py", True, False, "test", "Python", True),
    ("x/FooTest.java", True, False, "test", "Java", True),
    ("a.min.js", True, False, "generated", "JavaScript", False),
    ("README.md", True, False, "documentation", "Markdown", False),
    (".github/workflows/ci.yml", True, False, "config", "YAML", False),
    ("package-lock.json", True, False, "lockfile", "JSON", False),
    ("logo.svg", True, False, "asset", None, False),
    ("m.onnx", True, False, "binary", None, False),
    ("data.json", True, False, "data", "JSON", False),
    ("build", True, False, "other", None, False),
    ("a/../b", False, False, "other", None, False),
    ("/x", False, False, "other", None, False),
    ("x.R", True, False, "source", "R", False),
]


def test_classification(spark):
    c = F.col("path")
    rows = spark.createDataFrame([(x[0],) for x in CASES], "path string")
    got = rows.select("path", P.is_safe(c), P.is_ignored(c), P.category(c), P.classified_language(c), P.is_test(c)).collect()
    assert {tuple(r) for r in got} == set(CASES)


@pytest.mark.parametrize(("name", "suffix"), [(".gitignore", ""), ("a.tar.gz", ".gz"), ("..x", ""), ("a.", ""), ("x.py", ".py")])
def test_suffix(spark, name, suffix):
    assert spark.createDataFrame([(name,)], "p string").select(P.suffix(F.col("p"))).first()[0] == suffix


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\x0bc\x1cd\x85e f", "\n\n", "a\n\n"])
def test_lines_are_those_of_splitlines(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(T.lines(F.col("t"))).first()[0] == text.splitlines()


def test_text_functions(spark):
    row = spark.createDataFrame([(" \t x ", "abcd", "a/./b/../../c/d")], "a string, b string, p string").select(T.strip(F.col("a")), T.entropy(F.col("b")), T.normalized(F.col("p")), T.redact(F.lit("0123456789"))).first()
    assert tuple(row) == ("x", 2.0, "c/d", "0123********(10 chars)")
