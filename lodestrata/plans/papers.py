"""Documents written by tasks and read back: each source of `documents` as a report of its languages and largest texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import documents as D
from ..sources import export
from .queries import query, table
from .shared import folder

MOST = 20


def blocks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Titles and blocks of all kinds."""
    docs = table(spark, sf, "documents").filter("source is not null").select(F.col("source").alias("repo_id"), "doc_id", "lang", F.coalesce("n_chars", F.lit(0)).alias("n"), F.left(F.coalesce("text", F.lit("")), F.lit(60)).alias("start"))
    totals = docs.groupBy("repo_id").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    langs = docs.groupBy("repo_id", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    said = lambda c: F.col(c).cast("string")
    parts = [
        D.said(totals, 1, F.concat(said("docs"), F.lit(" documents <of> "), said("n"), F.lit(" characters"))),
        D.heading(totals, 2, "Languages & sizes"),
        D.listing(langs, 3, {"Language": F.col("lang"), "Documents": F.col("docs"), "Characters": F.col("n")}, [F.desc("n"), "lang"], MOST, ["Documents", "Characters"]),
        D.heading(totals, 4, "Largest", 3),
        D.listing(docs, 5, {"Document": F.col("doc_id"), "Characters": F.col("n"), "Beginning": F.col("start")}, [F.desc("n"), "doc_id"], MOST, ["Characters"]),
        D.bullets(totals, 6, F.concat(F.lit("sum: "), said("n")), F.lit(None).cast("string"), F.lit("a|b")),
        D.said(totals, 7, "Counted as given.", "note"),
    ]
    titles = totals.select("repo_id", F.concat(F.lit("Report: "), "repo_id").alias("title"), F.lit("all documents").alias("subtitle"))
    return titles, reduce(DataFrame.unionByName, parts)


def kept(spark: SparkSession, named: DataFrame) -> DataFrame:
    path = folder(spark)
    D.write_documents(named, path)
    return D.read_documents(spark, path)


TABLES = """WITH d AS (SELECT source AS repo_id, doc_id, lang, coalesce(n_chars, 0) AS n, left(coalesce(text, ''), 60) AS start FROM documents WHERE source IS NOT NULL),
t AS (SELECT repo_id, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1),
l AS (SELECT repo_id, lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY sum(n) DESC, lang NULLS FIRST) <= 20),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, doc_id) <= 20),
"""


def _markdown(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\r?\n', ' ', 'g'), '([\\`*_{{}}\[\]<>|#])', '\\\1', 'g')"


def _html(c: str) -> str:
    return f"""replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


def _cell(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' THEN ' ' ELSE {_markdown(c)} END"


@query(TABLES + rf"""x AS (SELECT repo_id, string_agg('| ' || {_cell("lang")} || ' | ' || docs || ' | ' || n || ' |', chr(10) ORDER BY n DESC, lang NULLS FIRST) AS rows FROM l GROUP BY 1),
y AS (SELECT repo_id, string_agg('| ' || doc_id || ' | ' || n || ' | ' || {_cell("start")} || ' |', chr(10) ORDER BY n DESC, doc_id) AS rows FROM b GROUP BY 1)
SELECT 'report-' || regexp_replace(repo_id, '[^A-Za-z0-9._-]+', '-', 'g') || '-' || left(md5(repo_id), 7) || '.md' AS name,
array_to_string(['# ' || {_markdown("'Report: ' || repo_id")}, '_all documents_', docs || ' documents \<of\> ' || n || ' characters', '## Languages & sizes', '| Language | Documents | Characters |' || chr(10) || '| --- | ---: | ---: |' || chr(10) || x.rows,
'### Largest', '| Document | Characters | Beginning |' || chr(10) || '| --- | ---: | --- |' || chr(10) || y.rows, '- sum: ' || n || chr(10) || '- a\|b', '> Counted as given.'], chr(10) || chr(10)) || chr(10) AS body
FROM t JOIN x USING (repo_id) JOIN y USING (repo_id)""")
def s15_markdown_documents(spark, sf):
    made = D.documents(*blocks(spark, sf))
    return kept(spark, made.select(D.file_name(F.col("repo_id"), F.md5("repo_id")).alias("name"), "body"))


@query(TABLES + f"""x AS (SELECT repo_id, string_agg('<tr><td>' || {_html("coalesce(lang, '')")} || '</td><td class="num">' || docs || '</td><td class="num">' || n || '</td></tr>', '' ORDER BY n DESC, lang NULLS FIRST) AS rows FROM l GROUP BY 1),
y AS (SELECT repo_id, string_agg('<tr><td>' || doc_id || '</td><td class="num">' || n || '</td><td>' || {_html("start")} || '</td></tr>', '' ORDER BY n DESC, doc_id) AS rows FROM b GROUP BY 1),
h AS (SELECT *, {_html("'Report: ' || repo_id")} AS title FROM t)
SELECT repo_id, array_to_string(['<!doctype html>', '<html lang="en"><head><meta charset="utf-8">', '{D.POLICY.replace("'", "''")}', '<title>' || title || '</title>{D.STYLE}</head><body>', '<h1>' || title || '</h1><p class="sub">all documents</p>',
'<p>' || docs || ' documents &lt;of&gt; ' || n || ' characters</p>', '<h2>Languages &amp; sizes</h2>', '<table><thead><tr><th>Language</th><th class="num">Documents</th><th class="num">Characters</th></tr></thead><tbody>' || x.rows || '</tbody></table>',
'<h3>Largest</h3>', '<table><thead><tr><th>Document</th><th class="num">Characters</th><th>Beginning</th></tr></thead><tbody>' || y.rows || '</tbody></table>', '<ul><li>sum: ' || n || '</li><li>a|b</li></ul>', '<p class="note">Counted as given.</p>', '</body></html>'], chr(10)) || chr(10) AS body
FROM h JOIN x USING (repo_id) JOIN y USING (repo_id)""")
def s16_html_documents(spark, sf):
    return D.documents(*blocks(spark, sf), "html")


@query("""SELECT 'report-' || source || '-' || left(md5(source), 7) || '.json' AS name, '{"repo_id":"' || source || '","docs":' || count(*) || ',"characters":' || CAST(sum(n_chars) AS BIGINT) || '}' || chr(10) AS body FROM documents WHERE source IS NOT NULL GROUP BY source""")
def s13_json_documents(spark, sf):
    rows = table(spark, sf, "documents").filter("source is not null").groupBy(F.col("source").alias("repo_id")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("characters"))
    named = export.as_json(rows).select(D.file_name(F.col("repo_id"), F.md5("repo_id"), "json").alias("name"), F.concat("document", F.lit("\n")).alias("body"))
    return kept(spark, named)
