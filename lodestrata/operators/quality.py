"""Code quality: markers, commented-out code, complexity and sizes of source files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from . import generic as G
from .languages import syntax
from .structure import analyzed_files, classified

# Patterns of markers, of code in comments, and of decisions.
MARKER = r"(?:#|//|/\*|<!--|--|;|^\s*\*)[^\n]*?\b(TODO|FIXME|HACK|XXX)\b([^\n]*)"
CODE_LIKE = r"^(?:(?:if|for|while|return|import|from|def|class|function|const|let|var|public|private|protected|static|else|elif|try|catch|except|switch|case|print|console\.\w+)\b.*|.*[;{}]\s*$|[\w.\[\]]+\s*=\s*[^=].*|[\w.]+\(.*\)\s*;?\s*$)"
DECISION = r"\b(?:if|for|while|case|catch|elif|elsif|unless|until)\b|&&|\|\|"
STRING_OR_COMMENT = r"""(?s)//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
TAGS = ("TODO", "FIXME", "HACK", "XXX")


def source_lines(contents: DataFrame) -> DataFrame:
    """A row a line: repo_id, path, line (from 1), text."""
    return contents.select("repo_id", "path", F.posexplode(T.lines(F.col("text"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def markers(contents: DataFrame) -> DataFrame:
    """repo_id, path, line, tag and text of the first marker of a line."""
    found = source_lines(contents.filter(F.col("text").rlike("TODO|FIXME|HACK|XXX"))).filter(F.col("text").rlike(MARKER))
    tag, rest = F.regexp_extract("text", MARKER, 1), T.strip(F.regexp_extract("text", MARKER, 2))
    rest = F.regexp_replace(T.strip(F.regexp_replace(F.regexp_replace(rest, r"\*/$", ""), r"-->$", "")), r"^[\s:(\-]+", "")
    said = F.substring(F.concat(tag, F.when(rest != "", F.concat(F.lit(": "), rest)).otherwise("")), 1, 160)
    return found.select("repo_id", "path", "line", tag.alias("tag"), said.alias("text"))


def marker_counts(found: DataFrame) -> DataFrame:
    """A column a tag, zero where there is none."""
    wide = found.groupBy("repo_id").pivot("tag", list(TAGS)).agg(F.count(F.lit(1)))
    return wide.select("repo_id", *[F.coalesce(F.col(t), F.lit(0)).alias(t) for t in TAGS])


def commented_code(contents: DataFrame) -> DataFrame:
    """Lines of each file in runs of two or more comment lines that look like code."""
    rows = contents.withColumn("_prefixes", syntax(P.classified_language(F.col("path")))[0]).filter(F.size("_prefixes") > 0)
    lines = rows.select("repo_id", "path", "_prefixes", F.posexplode(T.lines(F.col("text"))).alias("line", "text"))
    line = T.strip(F.col("text"))
    prefix = F.element_at(F.concat(F.filter("_prefixes", lambda p: F.startswith(line, p)), F.array(F.lit(None).cast("string"))), 1)
    body = T.strip(F.substring(line, F.length(prefix) + 1, F.length(line)))
    hit = F.coalesce((body != "") & ~body.rlike("^[!#/@*]") & body.rlike(CODE_LIKE), F.lit(False))
    runs = G.islands(lines.withColumn("_hit_line", hit), F.col("_hit_line"), ["line"], ["repo_id", "path"])
    return runs.groupBy("repo_id", "path").agg(F.sum("length").alias("lines"))


def nesting(text: Column) -> Column:
    """Deepest nesting of braces; a closing one without an opening counts as none."""
    braces = F.filter(F.split(F.regexp_replace(text, r"[^{}]", ""), ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deeper = lambda acc, c: F.when(c == "{", acc["now"] + 1).otherwise(F.greatest(F.lit(0), acc["now"] - 1))
    return F.aggregate(braces, start, lambda acc, c: F.struct(deeper(acc, c).alias("now"), F.greatest(acc["most"], deeper(acc, c)).alias("most")), lambda acc: acc["most"])


def brace_complexity(contents: DataFrame) -> DataFrame:
    """Decisions, nesting and lines of files in brace languages, without strings and comments."""
    bare = F.regexp_replace("text", STRING_OR_COMMENT, '""')
    rows = contents.filter(P.classified_language(F.col("path")).isin(*C.BRACE_LANGUAGES) & (P.category(F.col("path")) == "source"))
    return rows.select("repo_id", "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), F.regexp_count(bare, F.lit(DECISION)).alias("complexity"), T.newline_count(F.col("text")).alias("length"), nesting(bare).alias("max_nesting"), F.lit("heuristic").alias("method"))


BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.match_case)
SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def cyclomatic(function: ast.AST) -> int:
    """1, one for each branch and further operand of and/or, and for each loop and condition of a comprehension; nested
    functions, classes and lambdas count for themselves."""
    total, waiting = 1, [n for n in ast.iter_child_nodes(function) if not isinstance(n, SCOPES)]
    while waiting:
        node = waiting.pop()
        total += isinstance(node, BRANCHES)
        if isinstance(node, ast.BoolOp):
            total += len(node.values) - 1
        if isinstance(node, ast.comprehension):
            total += 1 + len(node.ifs)
        waiting += [n for n in ast.iter_child_nodes(node) if not isinstance(n, SCOPES)]
    return total


def functions_of(tree: ast.AST, before: str = "") -> Iterator[tuple[str, ast.AST]]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield before + node.name, node
            yield from functions_of(node, f"{before}{node.name}.")
        else:
            yield from functions_of(node, f"{before}{node.name}." if isinstance(node, ast.ClassDef) else before)


def parsed(text: str) -> ast.AST | None:
    """The syntax tree, or None for what can't be parsed. Nothing is ever run."""
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


PYTHON = "repo_id string, path string, parsed boolean, functions array<struct<name: string, line: int, complexity: int, length: int>>, public int, documented int, imports array<struct<module: string, level: int>>"


def python_facts(contents: DataFrame) -> DataFrame:
    """Functions, public definitions with and without docstrings, and imports of every Python file, each parsed once."""

    def facts(text: str) -> tuple:
        tree = parsed(text)
        try:
            if tree is None:
                return False, [], 0, 0, []
            functions = [{"name": name, "line": f.lineno, "complexity": cyclomatic(f), "length": (f.end_lineno or f.lineno) - f.lineno + 1} for name, f in functions_of(tree)]
            public = [n for n in ast.walk(tree) if isinstance(n, SCOPES[:3]) and not n.name.startswith("_")]
            imports = []
            for n in ast.walk(tree):
                if isinstance(n, ast.Import):
                    imports += [{"module": a.name, "level": 0} for a in n.names]
                elif isinstance(n, ast.ImportFrom):
                    base = n.module or ""
                    imports += [{"module": f"{base}.{a.name}".strip("."), "level": n.level} for a in n.names if a.name != "*"] or [{"module": base, "level": n.level}]
            return True, functions, len(public), sum(ast.get_docstring(n) is not None and ast.get_docstring(n) != "" for n in public), imports
        except RecursionError:
            return False, [], 0, 0, []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(r.repo_id, r.path, *facts(r.text)) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("repo_id", "path", "parsed", "functions", "public", "documented", "imports")])

    rows = contents.filter(P.classified_language(F.col("path")) == "Python").filter("text is not null")
    return rows.select("repo_id", "path", "text").mapInPandas(run, PYTHON)


def hotspots(contents: DataFrame) -> DataFrame:
    """Functions above COMPLEX, and files above the limits of the brace heuristic; the first MAX_HOTSPOTS of a repository."""
    code = contents.filter(P.category(F.col("path")).isin("source", "test"))
    functions = python_facts(code).select("repo_id", "path", F.explode("functions").alias("f")).select("repo_id", "path", "f.name", "f.line", "f.complexity", "f.length", F.lit(None).cast("int").alias("max_nesting"), F.lit("python-ast").alias("method")).filter(F.col("complexity") > C.COMPLEX)
    braces = brace_complexity(contents).filter((F.col("complexity") >= C.DECISIONS) | (F.col("max_nesting") >= C.NESTING))
    both = functions.unionByName(braces)
    return G.cap_per_group(both, ["repo_id"], [F.col("method") != "python-ast", F.desc("complexity"), "path", "line"], C.MAX_HOTSPOTS)


def totals(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """Counts and sizes of source and test files."""
    files = analyzed_files(classified(tree)).filter(F.col("category").isin("source", "test"))
    rows = files.join(contents.select("repo_id", "path", T.newline_count(F.col("text")).alias("lines")), ["repo_id", "path"], "left")
    source = F.col("category") == "source"
    out = rows.groupBy("repo_id").agg(
        F.count_if(source).alias("source_files"), F.count_if(~source).alias("test_files"), F.coalesce(F.sum(F.when(source, F.col("size"))), F.lit(0)).alias("source_bytes"),
        F.count_if(source & F.col("lines").isNotNull()).alias("sampled_source_files"), F.avg(F.when(source, F.col("lines"))).alias("average_lines_per_sampled_file"),
        F.count_if(source & (F.coalesce("lines", F.expr(f"size div {C.BYTES_PER_LINE}")) > C.LONG_FILE)).alias("long_file_count"),
    )
    some = F.when(F.col("source_files") > 0, F.col("source_files"))
    return out.withColumns({"test_to_source_ratio": F.col("test_files") / some, "average_source_file_bytes": F.coalesce(F.floor(F.col("source_bytes") / some), F.lit(0))})


def long_files(tree: DataFrame, contents: DataFrame) -> DataFrame:
    files = analyzed_files(classified(tree)).filter("category = 'source'")
    rows = files.join(contents.select("repo_id", "path", T.newline_count(F.col("text")).alias("exact")), ["repo_id", "path"], "left")
    lines = F.coalesce("exact", F.expr(f"size div {C.BYTES_PER_LINE}"))
    long = rows.select("repo_id", "path", lines.alias("lines"), F.col("exact").isNull().alias("estimated")).filter(F.col("lines") > C.LONG_FILE)
    return G.cap_per_group(long, ["repo_id"], [F.desc("lines"), "path"], C.MAX_LONG)


def largest_source_files(tree: DataFrame, most: int = 15) -> DataFrame:
    """repo_id, path, size of each repository's largest source files."""
    files = analyzed_files(classified(tree)).filter("category = 'source'").select("repo_id", "path", "size")
    return G.cap_per_group(files, ["repo_id"], [F.desc("size"), "path"], most)
