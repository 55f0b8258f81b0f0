"""Reports as documents of blocks: headings, paragraphs, notes, lists and tables, rendered as Markdown or HTML by columns and
written by tasks, a file a repository.

A block is a row: repo_id, place (where it stands), kind, level, items (texts of a list; one of other kinds), headers, right
(columns aligned so), cells (rows of a table). Tables are capped before their rows meet, so what meets of a repository in one
task has a bound that doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generic as G

TEXTS, CELLS, FLAGS = "array<string>", "array<array<string>>", "array<boolean>"
#: How a kind of document ends its file name.
ENDINGS = {"markdown": "md", "html": "html", "json": "json"}


def _block(df: DataFrame, place: int, kind: str, items: Column, level: int = 0, headers: Sequence[str] = (), right: Sequence[str] = (), cells: Column | None = None) -> DataFrame:
    head = F.array(*map(F.lit, headers)).cast(TEXTS)
    sides = F.array(*[F.lit(h in right) for h in headers]).cast(FLAGS)
    return df.select("repo_id", F.lit(place).alias("place"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), items.cast(TEXTS).alias("items"), head.alias("headers"), sides.alias("right"), (F.array() if cells is None else cells).cast(CELLS).alias("cells"))


def heading(repos: DataFrame, place: int, text: str, level: int = 2) -> DataFrame:
    return _block(repos, place, "heading", F.array(F.lit(text)), level)


def said(df: DataFrame, place: int, text: Column | str, kind: str = "paragraph") -> DataFrame:
    """A paragraph or a note of each row of df; a null text is none."""
    text = F.lit(text) if isinstance(text, str) else text
    return _block(df.withColumn("_text", text).filter("_text is not null"), place, kind, F.array("_text"))


def bullets(df: DataFrame, place: int, *texts: Column) -> DataFrame:
    """A list of the texts that aren't null of each row of df."""
    return _block(df.withColumn("_items", F.array_compact(F.array(*texts))).filter(F.size("_items") > 0), place, "list", F.col("_items"))


def listing(df: DataFrame, place: int, cells: dict[str, Column], order: Sequence[Column | str], most: int, right: Sequence[str] = ()) -> DataFrame:
    """A table of the first `most` rows of each repository: headers and cells by the names given; null is empty."""
    first = G.cap_per_group(df, ["repo_id"], order, most, "_nth")
    row = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cells.values()])
    rows = first.select("repo_id", F.struct("_nth", row.alias("row")).alias("r")).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]).alias("_cells"))
    return _block(rows, place, "table", F.array(), headers=list(cells), right=right, cells=F.col("_cells"))


def escaped_markdown(text: Column) -> Column:
    """One line that makes no structure."""
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n", " "), r"([\\`*_{}\[\]<>|#])", r"\\$1")


def escaped_html(text: Column) -> Column:
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(shown))
    return text


def _joined(parts: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep)


def _each(parts: Column, form) -> Column:  # noqa: ANN001
    return F.transform(parts, form)


def markdown_block() -> Column:
    kind, items, text = F.col("kind"), F.col("items"), escaped_markdown(F.get("items", F.lit(0)))
    cell = lambda c: F.when(escaped_markdown(c) == "", " ").otherwise(escaped_markdown(c))
    row = lambda cells: F.concat(F.lit("| "), _joined(_each(cells, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), _joined(_each(F.col("right"), lambda r: F.when(r, "---:").otherwise("---")), " | "), F.lit(" |"))
    table = _joined(F.concat(F.array(row(F.col("headers")), rule), _each(F.col("cells"), row)), "\n")
    marked = F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text)
    return F.when(kind == "heading", marked).when(kind == "note", F.concat(F.lit("> "), text)).when(kind == "list", _joined(_each(items, lambda i: F.concat(F.lit("- "), escaped_markdown(i))), "\n")).when(kind == "table", table).otherwise(text)


def html_block() -> Column:
    kind, items, text = F.col("kind"), F.col("items"), escaped_html(F.get("items", F.lit(0)))
    side = lambda i: F.when(F.get("right", i), ' class="num"').otherwise("")
    row = lambda cells, tag: F.concat(F.lit("<tr>"), _joined(F.transform(cells, lambda c, i: F.concat(F.lit(f"<{tag}"), side(i), F.lit(">"), escaped_html(c), F.lit(f"</{tag}>")))), F.lit("</tr>"))
    table = F.concat(F.lit("<table><thead>"), row(F.col("headers"), "th"), F.lit("</thead><tbody>"), _joined(_each(F.col("cells"), lambda r: row(r, "td"))), F.lit("</tbody></table>"))
    tagged = F.concat(F.lit("<h"), F.col("level").cast("string"), F.lit(">"), text, F.lit("</h"), F.col("level").cast("string"), F.lit(">"))
    bullet = F.concat(F.lit("<ul>"), _joined(_each(items, lambda i: F.concat(F.lit("<li>"), escaped_html(i), F.lit("</li>")))), F.lit("</ul>"))
    return F.when(kind == "heading", tagged).when(kind == "note", F.concat(F.lit('<p class="note">'), text, F.lit("</p>"))).when(kind == "list", bullet).when(kind == "table", table).otherwise(F.concat(F.lit("<p>"), text, F.lit("</p>")))


#: A page loads nothing and runs nothing.
POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'none'; style-src 'unsafe-inline'\">"
STYLE = "<style>body{font-family:sans-serif;max-width:60em;margin:2em auto}td,th{text-align:left;padding:.2em .6em}.num{text-align:right}.note,.sub{color:#777}</style>"


def documents(titles: DataFrame, blocks: DataFrame, form: str = "markdown") -> DataFrame:
    """titles(repo_id, title, subtitle) and their blocks: repo_id, body. A repository without blocks is a title; blocks
    without a title are left out."""
    html = form == "html"
    ordered = blocks.select("repo_id", F.struct("place", (html_block() if html else markdown_block()).alias("body")).alias("b")).groupBy("repo_id").agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["body"]).alias("_bodies"))
    bodies = F.coalesce("_bodies", F.array().cast(TEXTS))
    title, subtitle = (escaped_html if html else escaped_markdown)(F.col("title")), (escaped_html if html else escaped_markdown)(F.coalesce("subtitle", F.lit("")))
    if html:
        head = F.concat(F.lit(f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8">\n{POLICY}\n<title>'), title, F.lit(f"</title>{STYLE}</head><body>\n<h1>"), title, F.lit('</h1><p class="sub">'), subtitle, F.lit("</p>"))
        body = F.concat(_joined(F.concat(F.array(head), bodies), "\n"), F.lit("\n</body></html>\n"))
    else:
        body = F.concat(_joined(F.concat(F.array(F.concat(F.lit("# "), title), F.concat(F.lit("_"), subtitle, F.lit("_"))), bodies), "\n\n"), F.lit("\n"))
    return titles.join(ordered, "repo_id", "left").select("repo_id", body.alias("body"))


def file_name(full_name: Column, commit: Column, form: str = "markdown") -> Column:
    """report-owner-name-commit.md, with what a file name can't hold as a hyphen."""
    return F.concat(F.lit("report-"), F.regexp_replace(full_name, "[^A-Za-z0-9._-]+", "-"), F.lit("-"), F.left(commit, F.lit(7)), F.lit(f".{ENDINGS[form]}"))


def write_documents(named: DataFrame, path: str) -> None:
    """named(name, body): a folder a name with the body as its one file. Names differ.

    Tasks write them and Spark's committer moves what a task wrote once it has ended, so a lost executor or a task run twice
    leaves no part of a document and no second copy. A rerun replaces all and writes the same bytes."""
    # the text writer ends each record with a line break, which a body has already
    named.select("name", F.regexp_replace("body", r"\n\z", "").alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """name, body of each file below path."""
    return spark.read.schema("value string, name string").text(path, wholetext=True).select("name", F.col("value").alias("body"))
