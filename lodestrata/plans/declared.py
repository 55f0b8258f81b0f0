"""JSON manifests made of pages' urls: written, damaged and read again; the SQL reads the same texts with its own JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import manifests
from .queries import query, table

#: A page's manifest: its host is declared twice, a version may be a number, a section an array; some have more text after
#: the object, some are an array.
TEXTS = r"""t AS (SELECT page_id AS k, CASE page_id % 2 WHEN 0 THEN 'package.json' ELSE 'composer.json' END AS file, 'v/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, replace(replace(url, '\', '\\'), '"', '\"') AS url FROM pages),
d AS (SELECT *, '{"' || host || '": "' || url || '", "x/y": ' || CASE k % 3 WHEN 0 THEN CAST(k AS VARCHAR) ELSE '"^' || k || '.1"' END || ', "ext-/z": "*", "' || host || '": "' || CASE k % 4 WHEN 0 THEN url WHEN 1 THEN 'v/' || k ELSE '1.' || k END || '"}' AS first, CASE k % 5 WHEN 1 THEN '["a/b"]' ELSE '{"a/b": "file:../' || k || '", "c": null}' END AS second FROM t),
w AS (SELECT *, '{"name": "' || host || '", "dependencies": ' || first || ', "devDependencies": ' || second || ', "require": ' || first || ', "require-dev": ' || second || '}' || CASE k % 7 WHEN 3 THEN ' x' ELSE '' END AS body FROM d),
m AS (SELECT k, file, CASE k % 11 WHEN 5 THEN '[' || body || ']' ELSE body END AS text FROM w)"""


def urls_manifests(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id").cast("long")
    host = F.concat(F.lit("v/"), F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    url = F.replace(F.replace("url", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    said = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    number = k.cast("string")
    again = F.when(k % 4 == 0, url).when(k % 4 == 1, said("v/", number)).otherwise(said("1.", number))
    first = said('{"', host, '": "', url, '", "x/y": ', F.when(k % 3 == 0, number).otherwise(said('"^', number, '.1"')), ', "ext-/z": "*", "', host, '": "', again, '"}')
    second = F.when(k % 5 == 1, '["a/b"]').otherwise(said('{"a/b": "file:../', number, '", "c": null}'))
    body = said('{"name": "', host, '", "dependencies": ', first, ', "devDependencies": ', second, ', "require": ', first, ', "require-dev": ', second, "}", F.when(k % 7 == 3, " x").otherwise(""))
    file = F.when(k % 2 == 0, "package.json").otherwise("composer.json")
    return table(spark, sf, "pages").select(number.alias("repo_id"), file.alias("path"), F.when(k % 11 == 5, said("[", body, "]")).otherwise(body).alias("text"))


@query(f"""WITH {TEXTS},
v AS (SELECT *, CASE WHEN NOT json_valid(text) THEN 'invalid JSON: JSONDecodeError' WHEN json_type(text) <> 'OBJECT' THEN file || ' must contain an object' END AS error FROM m),
s AS (SELECT * FROM v, (VALUES ('package.json', 0, 'dependencies', 'production'), ('package.json', 1, 'devDependencies', 'development'), ('composer.json', 0, 'require', 'production'), ('composer.json', 1, 'require-dev', 'development')) AS x(of_file, place, section, scope) WHERE of_file = file AND error IS NULL),
o AS (SELECT s.*, json_extract(text, '$."' || section || '"') AS part FROM s),
e AS (SELECT o.k, o.file, o.place, o.scope, j.key, min(j.id) AS nth, arg_max(j.atom, j.id) AS value, arg_max(j.type, j.id) AS kind FROM (SELECT * FROM o WHERE json_type(part) = 'OBJECT') AS o, json_each(o.part) AS j GROUP BY ALL),
f AS (SELECT *, CASE WHEN kind = 'VARCHAR' THEN value ->> '$' END AS version FROM e WHERE file = 'package.json' OR contains(key, '/') AND NOT starts_with(key, 'ext-') AND NOT starts_with(key, 'lib-'))
SELECT CAST(k AS VARCHAR) AS repo_id, file AS path, NULL AS error, CAST(row_number() OVER (PARTITION BY k ORDER BY place, nth) - 1 AS INTEGER) AS ord, key AS name, version, scope,
CASE WHEN file = 'composer.json' OR version IS NULL THEN 'registry' WHEN regexp_matches(version, '^(git[+]|git:|github:|gitlab:|bitbucket:)|^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+(#.*)?$') THEN 'git' WHEN starts_with(version, 'file:') THEN 'path' WHEN regexp_matches(version, '^https?://') THEN 'url' ELSE 'registry' END AS source FROM f
UNION ALL SELECT CAST(k AS VARCHAR), file, error, NULL, NULL, NULL, NULL, NULL FROM v WHERE error IS NOT NULL""")
def v17_json_manifests(spark, sf):
    found = manifests.parsed(urls_manifests(spark, sf)).select("repo_id", "path", "error", F.posexplode_outer("dependencies").alias("ord", "d"))
    return found.select("repo_id", "path", "error", "ord", "d.name", "d.version", "d.scope", "d.source")
