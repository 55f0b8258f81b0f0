"""Queries of trees and imports whose places are computed from the tables' keys and paths; the SQL finds each answer anew by
comparing paths, not by constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, structure
from .queries import query, table

#: Nodes of a tree that are shown.
SHOWN = 60

URLS = """WITH p AS (SELECT length(html) AS size, string_split(rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), '/') AS parts FROM pages),
f AS (SELECT array_to_string(string_split(parts[1], '.')[-2:], '.') AS repo_id, array_to_string(parts, '/') AS path, CAST(sum(size) AS BIGINT) AS size FROM p GROUP BY 1, 2),
n AS (SELECT repo_id, array_to_string(x[1:i], '/') AS path, array_to_string(x[1:i - 1], '/') AS parent, x[i] AS name, i AS depth, max(CASE WHEN i = len(x) THEN 1 ELSE 0 END) AS leaf, CAST(sum(size) AS BIGINT) AS size, count(*) AS below
 FROM (SELECT repo_id, size, string_split(path, '/') AS x, unnest(range(1, len(string_split(path, '/')) + 1)) AS i FROM f) GROUP BY ALL),
"""


def url_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of a repository a domain: host, then the path of the url."""
    path = F.regexp_replace(F.regexp_extract("url", "^https?://([^?#]*)", 1), "/+$", "")
    labels = F.split(F.element_at(F.split(path, "/"), 1), r"\.")
    files = table(spark, sf, "pages").select(F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)), ".").alias("repo_id"), path.alias("path"), F.char_length("html").alias("size"))
    return files.groupBy("repo_id", "path").agg(F.sum("size").alias("size")).withColumns({"ord": F.lit(0), "type": F.lit("file")})


@query(URLS + f"""l1 AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY leaf, lower(name), name) AS r FROM n WHERE depth = 1),
l2 AS (SELECT n.*, (SELECT count(*) FROM l1 x WHERE x.repo_id = n.repo_id) + row_number() OVER (PARTITION BY n.repo_id ORDER BY l1.r, n.leaf, lower(n.name), n.name) AS r FROM n JOIN l1 ON n.repo_id = l1.repo_id AND n.parent = l1.path),
l3 AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.repo_id = n.repo_id AND depth < 3) + row_number() OVER (PARTITION BY n.repo_id ORDER BY l2.r, n.leaf, lower(n.name), n.name) AS r FROM n JOIN l2 ON n.repo_id = l2.repo_id AND n.parent = l2.path),
s AS (SELECT * FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE r <= {SHOWN}),
k AS (SELECT repo_id, CAST(r AS INTEGER) AS rank, path, parent, name, CASE WHEN leaf = 1 THEN 'file' ELSE 'dir' END AS type, size, CASE WHEN leaf = 1 THEN 0 ELSE below END AS files, FALSE AS ignored FROM s
UNION ALL SELECT repo_id, 0, '', NULL, '', 'dir', CAST(sum(size) AS BIGINT), count(*), FALSE FROM f GROUP BY 1)
SELECT k.*, CAST((SELECT count(*) FROM n WHERE n.repo_id = k.repo_id AND n.parent = k.path) - (SELECT count(*) FROM s WHERE s.repo_id = k.repo_id AND s.parent = k.path) AS INTEGER) AS omitted_children FROM k""")
def g08_bounded_tree(spark, sf):
    """Each level's places by those of the level above, in the SQL."""
    return structure.bounded_tree(url_tree(spark, sf), SHOWN)


@query(URLS + """d AS (SELECT repo_id, path, CASE WHEN leaf = 1 THEN 'file' ELSE 'dir' END AS type, size, CASE WHEN leaf = 1 THEN 0 ELSE below END AS files, FALSE AS ignored FROM n)
SELECT * FROM d UNION ALL SELECT repo_id, '', 'dir', CAST(sum(size) AS BIGINT), count(*), FALSE FROM f GROUP BY 1""")
def a05_tree_totals(spark, sf):
    return structure.tree_nodes(url_tree(spark, sf))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """repo_id, path, text: a source file a customer, of five languages, in directories that several share; what a file imports
    is computed from its key, so some imports meet one file, some several and some none."""
    k = F.col("k")
    s = lambda n, of=k: (of % n).cast("string")
    t = F.floor(k / 6)
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = (
        F.when(k % 6 == 0, join("mod", s(11), "/src/com/n", s(5), "/C", s(37), ".java")).when(k % 6 == 1, join("svc", s(7), "/pkg", s(5), "/f", k.cast("string"), ".go"))
        .when(k % 6 == 2, join("cr", s(3), "/src/m", s(20), "/r", k.cast("string"), ".rs")).when(k % 6 == 3, join("pk", s(4), "/s", s(5), "/p", k.cast("string"), ".py"))
        .when(k % 6 == 4, join("lib", s(9), "/utils/u", s(28), ".py")).otherwise(join("svc", s(7), "/go.mod"))
    )
    rows = table(spark, sf, "customer").select(F.concat(F.lit("r"), (F.col("c_nationkey") % 3).cast("string")).alias("repo_id"), F.col("c_custkey").alias("k"))
    files = rows.select("repo_id", path.alias("path"), "k").groupBy("repo_id", "path").agg(F.min("k").alias("k"))
    wild = F.when(t % 2 == 0, join("com.n", s(7, t))).otherwise(join("mod", s(13, t), ".src.com.n", s(7, t)))
    text = (
        F.when(k % 6 == 0, join("import com.n", s(5, t), ".C", s(50, t), ";\nimport ", wild, ".*;\n")).when(k % 6 == 1, join('import "ex.com/svc', s(9, k + 1), "/pkg", s(8, t), '"\n'))
        .when(k % 6 == 2, join("use crate::m", s(25), "::r", (k + 30).cast("string"), "::Thing;\n")).when(k % 6 == 3, join("from ..s", s(7, t), ".p", (k + 60).cast("string"), " import x\n"))
        .when(k % 6 == 4, join("import utils.u", s(40, t), "\n")).otherwise(join("module ex.com/", F.element_at(F.split("path", "/"), 1), "\n"))
    )
    return files.select("repo_id", "path", text.alias("text"))


@query("""WITH raw AS (SELECT 'r' || (c_nationkey % 3) AS repo_id, c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'mod' || (c_custkey % 11) || '/src/com/n' || (c_custkey % 5) || '/C' || (c_custkey % 37) || '.java' WHEN 1 THEN 'svc' || (c_custkey % 7) || '/pkg' || (c_custkey % 5) || '/f' || c_custkey || '.go'
 WHEN 2 THEN 'cr' || (c_custkey % 3) || '/src/m' || (c_custkey % 20) || '/r' || c_custkey || '.rs' WHEN 3 THEN 'pk' || (c_custkey % 4) || '/s' || (c_custkey % 5) || '/p' || c_custkey || '.py' WHEN 4 THEN 'lib' || (c_custkey % 9) || '/utils/u' || (c_custkey % 28) || '.py' ELSE 'svc' || (c_custkey % 7) || '/go.mod' END AS path FROM customer),
f AS (SELECT repo_id, path, min(k) AS k, min(k) // 6 AS t, min(k) % 6 AS kind FROM raw GROUP BY 1, 2),
dirs AS (SELECT DISTINCT repo_id, array_to_string(x[1:i], '/') AS path FROM (SELECT repo_id, string_split(path, '/') AS x, unnest(range(1, len(string_split(path, '/')))) AS i FROM f)),
j AS (SELECT repo_id, path, 'com.n' || (t % 5) || '.C' || (t % 50) AS spec, FALSE AS package FROM f WHERE kind = 0 UNION ALL SELECT repo_id, path, CASE WHEN t % 2 = 0 THEN 'com.n' || (t % 7) ELSE 'mod' || (t % 13) || '.src.com.n' || (t % 7) END || '.', TRUE FROM f WHERE kind = 0),
have AS (SELECT repo_id, path, path[:-6] AS own FROM f WHERE kind = 0),
jvm AS (SELECT j.repo_id, j.path, 'Java' AS language, j.spec, CASE count(h.path) WHEN 0 THEN 'external' WHEN 1 THEN 'internal' ELSE 'unresolved' END AS kind, CASE WHEN count(h.path) = 1 THEN min(h.path) END AS target
 FROM j LEFT JOIN have h ON h.repo_id = j.repo_id AND NOT j.package AND ends_with('/' || h.own, '/' || replace(j.spec, '.', '/')) GROUP BY ALL),
g AS (SELECT repo_id, path, 'svc' || ((k + 1) % 9) AS svc, 'pkg' || (t % 8) AS pkg FROM f WHERE kind = 1),
go AS (SELECT g.repo_id, g.path, 'Go', 'ex.com/' || g.svc || '/' || g.pkg, CASE WHEN m.path IS NULL THEN 'external' WHEN d.path IS NULL THEN 'unresolved' ELSE 'internal' END, CASE WHEN m.path IS NOT NULL THEN d.path END FROM g LEFT JOIN f m ON m.repo_id = g.repo_id AND m.path = g.svc || '/go.mod' LEFT JOIN dirs d ON d.repo_id = g.repo_id AND d.path = g.svc || '/' || g.pkg),
rust AS (SELECT a.repo_id, a.path, 'Rust', 'm' || (a.k % 25) || '::r' || (a.k + 30) || '::Thing', CASE WHEN b.path IS NULL THEN 'unresolved' ELSE 'internal' END, b.path FROM f a LEFT JOIN f b ON b.repo_id = a.repo_id AND b.path = 'cr' || (a.k % 3) || '/src/m' || (a.k % 25) || '/r' || (a.k + 30) || '.rs' WHERE a.kind = 2),
rel AS (SELECT a.repo_id, a.path, 'Python', 's' || (a.t % 7) || '.p' || (a.k + 60) || '.x', 'internal', coalesce(b.path, d.path, 'pk' || (a.k % 4)) FROM f a LEFT JOIN f b ON b.repo_id = a.repo_id AND b.path = 'pk' || (a.k % 4) || '/s' || (a.t % 7) || '/p' || (a.k + 60) || '.py' LEFT JOIN dirs d ON d.repo_id = a.repo_id AND d.path = 'pk' || (a.k % 4) || '/s' || (a.t % 7) WHERE a.kind = 3),
absolute AS (SELECT a.repo_id, a.path, 'Python', 'utils.u' || (a.t % 40), 'internal', coalesce(b.path, string_split(a.path, '/')[1] || '/utils') FROM f a LEFT JOIN f b ON b.repo_id = a.repo_id AND b.path = string_split(a.path, '/')[1] || '/utils/u' || (a.t % 40) || '.py' WHERE a.kind = 4)
SELECT * FROM jvm UNION ALL SELECT * FROM go UNION ALL SELECT * FROM rust UNION ALL SELECT * FROM rel UNION ALL SELECT * FROM absolute""")
def g02_resolved_by_suffix(spark, sf):
    """Java (ambiguous classes among them), Go, Rust, relative and absolute Python imports. The fixed pattern of an import reads
    a wildcard up to its last dot, so it is external."""
    contents = sources(spark, sf)
    tree = contents.select("repo_id", F.lit(0).alias("ord"), "path", F.lit("file").alias("type"), F.length("text").cast("long").alias("size"))
    return graph.resolved(tree, contents)
