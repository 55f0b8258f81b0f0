"""Repository analyses on the repositories of repository.py: each query calls its operators, with SQL beside it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import architecture, components, dependencies, documentation, graph, health, languages, quality, security, selection, structure, views, workspaces
from ..sources import manifests
from ..streaming import limiter
from . import declared, papers, places, scans  # noqa: F401  register their queries
from . import repository as R
from .queries import query, table
from .shared import spread, stored

S = R.SQL


@query(S + "SELECT repo_id, path, language, category, ignored AS ignored_root, aux AS auxiliary, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM t")
def p04_classified(spark, sf):
    return structure.classified(R.tree(spark, sf)).select("repo_id", "path", "language", "category", "ignored_root", "auxiliary", "depth")


@query(S + "SELECT repo_id, path, category IN ('test') OR path LIKE 'tests/%' OR f = 2 AS test, f = 10 AS generated, f = 14 AS manifest, ignored IS NOT NULL AS ignored, CASE WHEN language = 'Markdown' THEN 'prose' WHEN language = 'HTML' THEN 'markup' WHEN language IN ('JSON', 'YAML') THEN 'data' WHEN language IS NOT NULL THEN 'programming' ELSE 'programming' END AS kind, f = 12 OR dir = '.github/workflows' AS security FROM t")
def p05_predicates(spark, sf):
    p = F.col("path")
    return R.tree(spark, sf).select("repo_id", "path", P.is_test(p).alias("test"), P.is_generated(p).alias("generated"), P.is_manifest(p).alias("manifest"), P.is_ignored(p).alias("ignored"), P.language_kind(P.classified_language(p)).alias("kind"), P.is_security_config(p).alias("security"))


@query(S + """SELECT repo_id, count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size_bytes, count(*) FILTER (WHERE ignored IS NULL) AS analyzed_files, CAST(coalesce(sum(size) FILTER (WHERE ignored IS NULL), 0) AS BIGINT) AS analyzed_size_bytes,
count(*) FILTER (WHERE ignored IS NOT NULL) AS ignored_files, CAST(coalesce(sum(size) FILTER (WHERE ignored IS NOT NULL), 0) AS BIGINT) AS ignored_size_bytes, count(*) FILTER (WHERE ignored IS NULL AND size > 30000) AS oversized_files, CAST(coalesce(max(len(string_split(path, '/'))) FILTER (WHERE ignored IS NULL), 0) AS INTEGER) AS max_depth,
CAST(coalesce(max(len(string_split(path, '/'))) FILTER (WHERE ignored IS NULL AND NOT aux), 0) AS INTEGER) AS product_max_depth FROM t GROUP BY 1""")
def a01_structure_totals(spark, sf):
    return structure.analyze(R.tree(spark, sf), 30_000).totals.drop("total_directories", "symlinks")


@query(S + "SELECT repo_id, category, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM own GROUP BY 1, 2")
def a02_category_stats(spark, sf):
    return structure.analyze(R.tree(spark, sf)).categories


@query(S + "SELECT repo_id, ignored AS path, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM t WHERE ignored IS NOT NULL GROUP BY 1, 2")
def a04_ignored_directories(spark, sf):
    return structure.analyze(R.tree(spark, sf)).ignored_directories


@query(S + """, d AS (SELECT repo_id, array_to_string(parts[1:i], '/') AS dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT repo_id, size, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM own) GROUP BY 1, 2)
SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, dir) <= 10""")
def t14_largest_directories(spark, sf):
    return structure.analyze(R.tree(spark, sf)).largest_directories


@query(S + "SELECT repo_id, path, size, category, language FROM own QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) <= 15")
def t13_largest(spark, sf):
    return structure.analyze(R.tree(spark, sf)).largest_files


@query(S + "SELECT repo_id, path, size FROM own WHERE category = 'source' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY size DESC, path) <= 15")
def t25_largest_source_files(spark, sf):
    return quality.largest_source_files(R.tree(spark, sf))


@query(S + """, e AS (SELECT repo_id, CASE WHEN f IN (11, 12, 13, 14) THEN list_extract(['.lock', '(none)', '.md', '.json'], CAST(f - 10 AS BIGINT)) WHEN f = 10 THEN '.js' WHEN f = 15 THEN '(none)' ELSE post END AS extension, size FROM own JOIN kinds USING (f))
SELECT repo_id, extension, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY 1, 2""")
def a07_extension_hist(spark, sf):
    return languages.extensions(R.tree(spark, sf))


@query("SELECT source AS repo_id, lang AS language, CAST(sum(n_chars) AS BIGINT) AS bytes, sum(n_chars) * 100.0::DOUBLE / sum(sum(n_chars)) OVER (PARTITION BY source) AS percent FROM documents GROUP BY 1, 2")
def a08_linguist_shares(spark, sf):
    return languages.linguist_shares(table(spark, sf, "documents").groupBy(F.col("source").alias("repo_id"), F.col("lang").alias("language")).agg(F.sum("n_chars").alias("bytes")))


@query("SELECT source AS repo_id, lang AS language, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2")
def s04_linguist_source(spark, sf):
    """A JSON map a repository, read back."""
    rows = table(spark, sf, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("n"))
    body = rows.groupBy(F.col("source").alias("repo_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("lang", "n")))).alias("body"))
    return selection.linguist(body)


#: Lines of each kind of file with contents: total, code, comment, blank; a Python file has k % 3 comment lines more.
LINES = f"""lines(f, total, code, comment, blank) AS (VALUES ({R.PY}, 9, 5, 3, 1), ({R.TS}, 6, 4, 2, 0), ({R.GO}, 4, 3, 1, 0), ({R.HTML}, 3, 1, 2, 0), ({R.README}, 9, 8, 0, 1), ({R.PACKAGE}, 1, 1, 0, 0), ({R.DOCKER}, 4, 4, 0, 0)),
n AS (SELECT c.*, total + x AS total, code, comment + x AS comment, blank FROM (SELECT *, CASE WHEN f = {R.PY} THEN k % 3 ELSE 0 END AS x FROM c) c JOIN lines USING (f))"""


@query(S + f", {LINES} SELECT repo_id, path, CAST(total AS BIGINT) AS total, CAST(code AS BIGINT) AS code, CAST(comment AS BIGINT) AS comment, CAST(blank AS BIGINT) AS blank FROM n")
def f10_line_counts(spark, sf):
    path = F.col("path")
    return R.contents(spark, sf).select("repo_id", "path", languages.count_lines(F.col("text"), P.classified_language(path)).alias("n")).select("repo_id", "path", "n.*")


@query(S + f""", {LINES},
r AS (SELECT o.repo_id, o.language, o.size, n.total, n.code, n.comment, n.blank, n.k IS NOT NULL AND o.k % 2 = 0 AS got FROM own o LEFT JOIN n ON n.k = o.k WHERE o.language IS NOT NULL AND o.category NOT IN ('lockfile', 'generated', 'binary', 'asset')),
b AS (SELECT repo_id, language, count(*) AS files, sum(size) AS bytes, count(*) FILTER (WHERE got) AS sampled_files, coalesce(sum(size) FILTER (WHERE got), 0) AS sb, coalesce(sum(size) FILTER (WHERE NOT got), 0) AS ub, coalesce(sum(total) FILTER (WHERE got), 0) AS tl, coalesce(sum(code) FILTER (WHERE got), 0) AS cl, coalesce(sum(comment) FILTER (WHERE got), 0) AS ml, coalesce(sum(blank) FILTER (WHERE got), 0) AS bl FROM r GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN sum(tl) OVER p > 0 THEN sum(sb) OVER p * 1.0::DOUBLE / sum(tl) OVER p ELSE 40.0::DOUBLE END AS whole, sum(bytes) OVER p AS all_bytes FROM b WINDOW p AS (PARTITION BY repo_id)),
g AS (SELECT *, CASE WHEN tl > 0 THEN sb * 1.0::DOUBLE / tl ELSE whole END AS per FROM o),
e AS (SELECT *, CASE WHEN ub > 0 AND per > 0 THEN CAST(round_even(ub / per, 0) AS BIGINT) ELSE 0 END AS guess FROM g)
SELECT repo_id, language, CASE WHEN language = 'Markdown' THEN 'prose' WHEN language = 'HTML' THEN 'markup' WHEN language IN ('JSON', 'YAML') THEN 'data' ELSE 'programming' END AS kind, files, CAST(bytes AS BIGINT) AS bytes, round(100.0::DOUBLE * bytes / all_bytes, 9) AS percent_of_bytes,
CAST(tl + guess AS BIGINT) AS lines, guess > 0 AS lines_estimated, sampled_files, CAST(cl AS BIGINT) AS code_lines, CAST(ml AS BIGINT) AS comment_lines, CAST(bl AS BIGINT) AS blank_lines FROM e""")
def a06_language_stats(spark, sf):
    """Contents of every second file; the others' lines are estimated."""
    some = R.contents(spark, sf).filter(F.regexp_extract("path", r"(\d+)[^0-9]*$", 1).cast("long") % 2 == 0)
    return languages.stats(R.tree(spark, sf), some).withColumn("percent_of_bytes", F.round("percent_of_bytes", 9))


MARKERS = f"""m AS (SELECT repo_id, path, 1 AS line, 'TODO' AS tag, 'TODO: fix ' || k AS text FROM c WHERE f = {R.PY}
UNION ALL SELECT repo_id, path, 9 + i, 'HACK', 'HACK' FROM (SELECT *, unnest(range(1, CAST(k % 3 + 1 AS BIGINT))) AS i FROM c WHERE f = {R.PY})
UNION ALL SELECT repo_id, path, 4, 'FIXME', 'FIXME: ' || k FROM c WHERE f = {R.TS} UNION ALL SELECT repo_id, path, 2, 'XXX', 'XXX' FROM c WHERE f = {R.GO})"""


@query(S + f", {MARKERS} SELECT repo_id, path, CAST(line AS INTEGER) AS line, tag, text FROM m")
def f05_markers(spark, sf):
    return quality.markers(R.contents(spark, sf))


@query(S + f", {MARKERS} SELECT repo_id, " + ", ".join(f"count(*) FILTER (WHERE tag = '{t}') AS {t}" for t in quality.TAGS) + " FROM m GROUP BY 1")
def a13_marker_counts(spark, sf):
    return quality.marker_counts(quality.markers(R.contents(spark, sf)))


@query(S + f", {MARKERS} SELECT repo_id, path, CAST(line AS INTEGER) AS line, tag, text FROM m WHERE tag = 'HACK' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path, line) <= 100")
def p30_marker_filter(spark, sf):
    return views.markers(quality.markers(R.contents(spark, sf)), "HACK")


@query(S + f"SELECT repo_id, path, CAST(2 AS BIGINT) AS lines FROM c WHERE f = {R.PY}")
def a14_commented_code(spark, sf):
    return quality.commented_code(R.contents(spark, sf))


@query(S + f"SELECT repo_id, path, CAST(CASE f WHEN {R.TS} THEN 3 ELSE 0 END AS INTEGER) AS complexity, CAST(CASE f WHEN {R.TS} THEN 7 ELSE 5 END AS INTEGER) AS length, CAST(CASE f WHEN {R.TS} THEN 2 ELSE 1 END AS INTEGER) AS max_nesting FROM c WHERE f IN ({R.TS}, {R.GO}) AND category = 'source'")
def f08_brace_complexity(spark, sf):
    return quality.brace_complexity(R.contents(spark, sf)).select("repo_id", "path", F.col("complexity").cast("int").alias("complexity"), F.col("length").cast("int").alias("length"), F.col("max_nesting").cast("int").alias("max_nesting"))


@query(S + f"SELECT repo_id, path, 'f' || k AS name, CAST(4 AS INTEGER) AS line, CAST(3 AS INTEGER) AS complexity, CAST(6 AS INTEGER) AS length FROM c WHERE f = {R.PY}")
def v13_mccabe(spark, sf):
    facts = quality.python_facts(R.contents(spark, sf))
    return facts.select("repo_id", "path", F.explode("functions").alias("f")).select("repo_id", "path", "f.name", F.col("f.line").cast("int").alias("line"), F.col("f.complexity").cast("int").alias("complexity"), F.col("f.length").cast("int").alias("length"))


@query(S + f"SELECT repo_id, count(*) AS public_definitions, CAST(0 AS BIGINT) AS documented, count(*) AS files_analyzed, 0.0::DOUBLE AS percent FROM c WHERE f = {R.PY} AND category = 'source' GROUP BY 1")
def a17_docstring_coverage(spark, sf):
    return documentation.docstring_coverage(R.contents(spark, sf))


@query(S + f""", {LINES} SELECT repo_id, round(sum(comment) * 1.0::DOUBLE / sum(comment + code), 9) AS comment_density FROM n WHERE category = 'source' GROUP BY 1""")
def a16_comment_density(spark, sf):
    return documentation.comment_density(R.contents(spark, sf)).withColumn("comment_density", F.round("comment_density", 9))


@query(S + f""", s AS (SELECT o.repo_id, o.category, o.size, o.f, CASE WHEN o.f = {R.PY} THEN 10 + o.k % 3 WHEN o.f = {R.TS} THEN 7 WHEN o.f = {R.GO} THEN 5 WHEN o.f = {R.HTML} THEN 4 WHEN o.f = {R.DOCKER} THEN 5 END AS lines FROM own o WHERE category IN ('source', 'test'))
SELECT repo_id, count(*) FILTER (WHERE category = 'source') AS source_files, count(*) FILTER (WHERE category = 'test') AS test_files, CAST(coalesce(sum(size) FILTER (WHERE category = 'source'), 0) AS BIGINT) AS source_bytes, count(*) FILTER (WHERE category = 'source' AND lines IS NOT NULL) AS sampled_source_files,
count(*) FILTER (WHERE category = 'source' AND coalesce(lines, size // 40) > 500) AS long_file_count FROM s GROUP BY 1""")
def a12_quality_totals(spark, sf):
    return quality.totals(R.tree(spark, sf), R.contents(spark, sf)).select("repo_id", "source_files", "test_files", "source_bytes", "sampled_source_files", "long_file_count")


#: Dependencies of each package.json, in order.
DEPS = f"""p AS (SELECT * FROM c WHERE f = {R.PACKAGE}),
d AS (SELECT repo_id, path AS manifest, ord AS manifest_ord, 0 AS n, 'Left' AS name, '^1.' || (k % 3) || '.0' AS version, 'production' AS scope, 'range' AS kind FROM p
UNION ALL SELECT repo_id, path, ord, 1, list_extract(['react', 'express', 'other'], CAST(k % 3 + 1 AS BIGINT)), (k % 4) || '.0.0', 'production', 'exact' FROM p
UNION ALL SELECT repo_id, path, ord, 2, list_extract(['jest', 'left'], CAST(k % 2 + 1 AS BIGINT)), '29.0.0', 'development', 'exact' FROM p)"""


@query(S + f""", {DEPS} SELECT repo_id, manifest, 'npm' AS ecosystem, CAST(n AS INTEGER) AS ord, name, version, scope, 'registry' AS source, TRUE AS direct, kind AS "constraint" FROM d""")
def v01_package_json(spark, sf):
    return dependencies.listed(manifests.parsed(R.contents(spark, sf)))


@query(S + f""", {DEPS}, u AS (SELECT repo_id, count(DISTINCT lower(name)) AS unique_packages FROM d GROUP BY 1)
SELECT repo_id, count(*) AS total, any_value(unique_packages) AS unique_packages, count(*) FILTER (WHERE scope = 'production') AS production, count(*) FILTER (WHERE scope = 'development') AS development, CAST(0 AS BIGINT) AS unconstrained, CAST(0 AS BIGINT) AS external_sources, CAST(0 AS BIGINT) AS other FROM d JOIN u USING (repo_id) GROUP BY 1""")
def a09_dependency_totals(spark, sf):
    return dependencies.analyze(R.tree(spark, sf), R.contents(spark, sf)).totals


@query(S + f""", {DEPS} SELECT repo_id, 'npm' AS ecosystem, count(*) AS dependencies, count(*) FILTER (WHERE scope = 'production') AS production, count(*) FILTER (WHERE scope = 'development') AS development, EXISTS (SELECT 1 FROM own o WHERE o.repo_id = d.repo_id AND o.f = 11) AS has_lockfile FROM d GROUP BY 1""")
def j04_ecosystems(spark, sf):
    return dependencies.analyze(R.tree(spark, sf), R.contents(spark, sf)).ecosystems


@query(S + f""", {DEPS}, g AS (SELECT repo_id, lower(name) AS key, min(name) AS name, list_sort(list(DISTINCT version)) AS v, list_sort(list(DISTINCT manifest)) AS m FROM d GROUP BY 1, 2)
SELECT repo_id, name, 'npm' AS ecosystem, array_to_string(v, ',') AS versions, CAST(len(m) AS INTEGER) AS manifests FROM g WHERE len(v) > 1""")
def j21_conflict_names(spark, sf):
    return dependencies.analyze(R.tree(spark, sf), R.contents(spark, sf)).conflicts.select("repo_id", "name", "ecosystem", F.array_join("versions", ",").alias("versions"), F.size("manifests").alias("manifests"))


@query(S + f"SELECT repo_id, path FROM own WHERE f = {R.PACKAGE} AND k % 32 <> 14")
def j03_not_analyzed(spark, sf):
    some = R.contents(spark, sf).filter(F.regexp_extract("path", r"(\d+)[^0-9]*$", 1).cast("long") % 32 == 14)
    return dependencies.analyze(R.tree(spark, sf), some).not_analyzed


@query(S + "SELECT repo_id, path FROM own WHERE f = 11")
def t20_lockfiles(spark, sf):
    return dependencies.analyze(R.tree(spark, sf), R.contents(spark, sf)).lockfiles


@query(S + f""", {DEPS} SELECT repo_id, manifest, CAST(n AS INTEGER) AS ord, name, scope FROM d WHERE scope = 'production' AND (contains(lower(name), 'e') OR contains(lower(manifest), 'e'))""")
def p28_dependency_filter(spark, sf):
    deps = dependencies.analyze(R.tree(spark, sf), R.contents(spark, sf)).declared
    return views.dependencies(deps, "production", "npm", "E").select("repo_id", "manifest", "ord", "name", "scope")


FRAMEWORKS = f"""{DEPS}, w AS (SELECT repo_id, CASE name WHEN 'react' THEN 'React' ELSE 'Express' END AS framework, CASE name WHEN 'react' THEN 'frontend' ELSE 'backend' END AS category, manifest || ': ''' || name || '''' AS evidence FROM d WHERE name IN ('react', 'express') QUALIFY row_number() OVER (PARTITION BY repo_id, name ORDER BY manifest_ord, n) = 1)"""


@query(S + f", {FRAMEWORKS} SELECT * FROM w")
def j05_frameworks(spark, sf):
    tree, contents = R.tree(spark, sf), R.contents(spark, sf)
    return architecture.frameworks(tree, dependencies.analyze(tree, contents).declared)


@query(S + f", {FRAMEWORKS} SELECT repo_id, CASE category WHEN 'frontend' THEN 'Web frontend' ELSE 'Web / API service' END AS label, framework AS evidence FROM w")
def g07_project_types(spark, sf):
    tree, contents = R.tree(spark, sf), R.contents(spark, sf)
    return architecture.project_types(architecture.frameworks(tree, dependencies.analyze(tree, contents).declared))


@query(S + f"SELECT repo_id, path, 'KEY_' || (k % 4) AS name FROM c WHERE f = {R.PY} AND category = 'source' AND NOT aux")
def f20_env_uses(spark, sf):
    return security.env_uses(R.contents(spark, sf))


@query(S + f", u AS (SELECT DISTINCT repo_id, path, 'KEY_' || (k % 4) AS name FROM c WHERE f = {R.PY} AND category = 'source' AND NOT aux) SELECT repo_id, count(DISTINCT name) AS variables, count(DISTINCT path) AS files, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM u GROUP BY 1")
def a20_env_inventory(spark, sf):
    return security.env_inventory(security.env_uses(R.contents(spark, sf))).withColumn("names", F.array_join("names", ","))


@query(S + f", {FRAMEWORKS} SELECT repo_id, framework, category, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY CASE category WHEN 'frontend' THEN 0 ELSE 1 END, framework) AS INTEGER) AS rank FROM w")
def t29_frameworks(spark, sf):
    tree, contents = R.tree(spark, sf), R.contents(spark, sf)
    return architecture.in_order(architecture.frameworks(tree, dependencies.analyze(tree, contents).declared)).select("repo_id", "framework", "category", "rank")


GLOBS = ("en/*", "*/1**", "fr/*.html", "de/?", "!en/9*", "!*/1?2")


@query(r"""WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1) AS repo_id, rtrim(regexp_extract(url, '^https?://[^/?#]*/([^?#]*)', 1), '/') AS path FROM pages)
SELECT repo_id, path FROM p WHERE regexp_full_match(path, 'en/[^/]*|[^/]*/1.*|fr/[^/]*[.]html|de/[^/]') AND NOT regexp_full_match(path, 'en/9[^/]*|[^/]*/1[^/]2')""")
def j16_globs(spark, sf):
    """Paths of pages that globs pick and none that excludes rules out, the same globs for each host."""
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    paths = pages.select(host.alias("repo_id"), F.rtrim(F.regexp_extract("url", "^https?://[^/?#]*/([^?#]*)", 1), F.lit("/")).alias("path")).distinct()
    globs = paths.select("repo_id").distinct().select("repo_id", F.explode(F.array(*map(F.lit, GLOBS))).alias("glob"))
    return workspaces.matched(paths, globs)


SCANNED = f"""s AS (SELECT repo_id, path, CAST(6 AS INTEGER) AS line, 'transport.insecure-http' AS rule, 'low' AS severity, aux AS in_test FROM c WHERE f = {R.TS} AND category = 'source'
UNION ALL SELECT repo_id, path, CAST(1 AS INTEGER), 'docker.unpinned-base-image', 'low', aux FROM c WHERE f = {R.DOCKER} UNION ALL SELECT repo_id, path, CAST(4 AS INTEGER), 'docker.unpinned-base-image', 'low', aux FROM c WHERE f = {R.DOCKER}),
z AS (SELECT repo_id, path, line, rule, CASE WHEN in_test THEN 'info' ELSE severity END AS severity, in_test FROM s)"""


@query(S + f", {SCANNED} SELECT * FROM z")
def j17_security_scan(spark, sf):
    """Rules on lines, insecure addresses and unpinned images."""
    return security.scan(R.contents(spark, sf)).select("repo_id", "path", "line", "rule", "severity", "in_test")


@query(S + f", {SCANNED} SELECT repo_id, CAST(0 AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'info') AS info FROM z GROUP BY 1")
def a19_by_severity(spark, sf):
    return security.by_severity(security.scan(R.contents(spark, sf)))


@query(S + f"SELECT repo_id, path, CAST(1 AS INTEGER) AS line, 'python' AS image FROM c WHERE f = {R.DOCKER} UNION ALL SELECT repo_id, path, CAST(4 AS INTEGER), 'img' || (k % 3) || ':latest' FROM c WHERE f = {R.DOCKER}")
def w09_unpinned_images(spark, sf):
    return security.unpinned_images(R.contents(spark, sf))


@query(S + f"SELECT repo_id, path, 'markdown' AS format, CAST(0 AS INTEGER) AS line, 'Title ' || k AS heading FROM c WHERE f = {R.README} UNION ALL SELECT repo_id, path, 'markdown', CAST(6 AS INTEGER), 'Sub ' || (k % 7) FROM c WHERE f = {R.README}")
def w08_headings(spark, sf):
    """Headings outside fenced blocks, hashed and underlined."""
    own = R.contents(spark, sf).filter(F.col("path").endswith("README.md"))
    lines = documentation.prose(own)
    found = documentation.headings(lines)
    # an underlined heading is told at its underline
    return found.join(lines.select("repo_id", "path", "format").distinct(), ["repo_id", "path"]).select("repo_id", "path", "format", (F.col("line") - F.when(F.col("heading").startswith("Sub"), 1).otherwise(0)).cast("int").alias("line"), "heading")


LINKS = f"""l AS (SELECT repo_id, path, dir, k, 0 AS ord, FALSE AS image, './m' || k || '.py' AS url FROM c WHERE f = {R.README} UNION ALL SELECT repo_id, path, dir, k, 1, FALSE, 'https://x.org' FROM c WHERE f = {R.README} UNION ALL SELECT repo_id, path, dir, k, 2, TRUE, '/d.png' FROM c WHERE f = {R.README})"""


@query(S + f", {LINKS} SELECT repo_id, path, CAST(ord AS INTEGER) AS ord, image, url FROM l")
def f22_links(spark, sf):
    own = R.contents(spark, sf).filter(F.col("path").endswith("README.md"))
    return documentation.targets(own.withColumnRenamed("text", "prose"))


@query(S + f", {LINKS} SELECT repo_id, path, url AS target, CAST(ord AS INTEGER) AS ord FROM l WHERE ord <> 1")
def j15_broken_links(spark, sf):
    own = R.contents(spark, sf).filter(F.col("path").endswith("README.md"))
    return documentation.broken_links(documentation.targets(own.withColumnRenamed("text", "prose")), documentation.known_paths(R.tree(spark, sf)))


@query(S + """, a AS (SELECT DISTINCT repo_id, array_to_string(parts[1:i], '/') AS path FROM (SELECT repo_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM own))
SELECT repo_id, path, 'file' AS kind FROM own UNION SELECT repo_id, path, 'dir' FROM a""")
def u01_known_paths(spark, sf):
    return documentation.known_paths(R.tree(spark, sf))


@query(S + "SELECT repo_id, 'docs' AS path, count(*) AS files, count(*) FILTER (WHERE category = 'documentation') AS doc_files FROM own WHERE path LIKE 'docs/%' GROUP BY 1")
def a18_directory_info(spark, sf):
    return documentation.directory_info(R.tree(spark, sf))


#: Imports of scripts outside ignored directories, with the file they mean if there is one.
IMPORTS = f"""i AS (SELECT c.repo_id, c.path, './u' || (c.k + 720) AS spec, o.path AS target FROM c LEFT JOIN own o ON o.k = c.k + 720 WHERE c.f = {R.TS}),
r AS (SELECT repo_id, path, 'TypeScript' AS language, spec, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'internal' END AS kind, target FROM i UNION ALL SELECT repo_id, path, 'Python', 'os', 'external', NULL FROM c WHERE f = {R.PY})"""


@query(S + f", {IMPORTS} SELECT * FROM r")
def j09_resolved_imports(spark, sf):
    return graph.resolved(R.tree(spark, sf), R.contents(spark, sf))


@query(S + f", {IMPORTS} SELECT repo_id, count(*) AS imports_found, count(*) FILTER (WHERE kind = 'internal') AS internal_resolved, count(*) FILTER (WHERE kind = 'external') AS external, count(*) FILTER (WHERE kind = 'unresolved') AS unresolved FROM r GROUP BY 1")
def a24_import_statistics(spark, sf):
    return graph.import_statistics(graph.resolved(R.tree(spark, sf), R.contents(spark, sf)))


@query(S + f", {IMPORTS} SELECT repo_id, target AS path, count(*) AS fan_in FROM r WHERE kind = 'internal' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, target) <= 10")
def a23_hubs(spark, sf):
    tree = R.tree(spark, sf)
    return graph.hubs(graph.edges(graph.resolved(tree, R.contents(spark, sf))), graph.nodes(tree))


def _orders(spark, sf):
    """Files that refer to one another: a supplier's to a customer's, below directories by nation."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = items.join(orders, "l_orderkey").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    file = lambda nation, key: F.concat(F.lit("n"), nation.cast("string"), F.lit("/f"), key.cast("string"))
    return joined.groupBy(F.lit("r").alias("repo_id"), file(F.col("s_nationkey"), F.col("l_suppkey")).alias("src"), file(F.col("c_nationkey"), F.col("o_custkey")).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query("""SELECT 'r' AS repo_id, 'n' || s_nationkey AS src, 'n' || c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey <> c_nationkey GROUP BY 2, 3 QUALIFY row_number() OVER (ORDER BY count(*) DESC, 'n' || s_nationkey, 'n' || c_nationkey) <= 150""")
def j14_module_edges(spark, sf):
    modules = table(spark, sf, "nation").select(F.lit("r").alias("repo_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module"))
    return graph.module_edges(_orders(spark, sf), modules)


@query("""SELECT 'r' AS repo_id, 'n' || n_nationkey AS module FROM nation WHERE EXISTS (SELECT 1 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey) OR EXISTS (SELECT 1 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = n_nationkey)""")
def j22_connected_modules(spark, sf):
    modules = table(spark, sf, "nation").select(F.lit("r").alias("repo_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("module"))
    short = _orders(spark, sf).select("repo_id", F.regexp_extract("src", "^([^/]+)", 1).alias("src"), F.regexp_extract("dst", "^([^/]+)", 1).alias("dst"))
    return views.connected(modules, short)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS s, c_nationkey AS d FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
n AS (SELECT s AS node FROM e UNION SELECT d FROM e),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.d FROM r JOIN e ON e.s = r.b),
c AS (SELECT x.a AS node, min(x.b) AS c FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1),
g AS (SELECT DISTINCT x.c AS s, y.c AS d FROM e JOIN c x ON x.node = e.s JOIN c y ON y.node = e.d WHERE x.c <> y.c),
w AS (SELECT c AS node, 0 AS layer FROM c UNION SELECT g.d, w.layer + 1 FROM w JOIN g ON g.s = w.node)
SELECT 'r' AS repo_id, lpad(CAST(c.node AS VARCHAR), 2, '0') AS node, lpad(CAST(c AS VARCHAR), 2, '0') AS component, CAST(max(layer) AS INTEGER) AS layer FROM c JOIN w ON w.node = c.c GROUP BY ALL""")
def g10_layering(spark, sf):
    """Layers by longest path of all edges between nations, cycles contracted."""
    name = lambda c: F.lpad(F.regexp_extract(c, "n([0-9]+)/", 1), 2, "0")
    edges = _orders(spark, sf).select("repo_id", name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst")).distinct()
    nodes = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return components.layers(edges, nodes)


@query("""WITH RECURSIVE l AS (SELECT o_custkey AS repo_id, p_brand AS b, lead(p_brand) OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
e AS MATERIALIZED (SELECT DISTINCT repo_id, b AS s, d FROM l WHERE d IS NOT NULL),
n AS (SELECT repo_id, b AS node FROM l GROUP BY ALL),
r AS (SELECT repo_id, node AS a, node AS b FROM n UNION SELECT r.repo_id, r.a, e.d FROM r JOIN e ON e.repo_id = r.repo_id AND e.s = r.b),
c AS MATERIALIZED (SELECT x.repo_id, x.a AS node, min(x.b) AS c FROM r x JOIN r y ON x.repo_id = y.repo_id AND x.a = y.b AND x.b = y.a GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT e.repo_id, x.c AS s, y.c AS d FROM e JOIN c x ON x.repo_id = e.repo_id AND x.node = e.s JOIN c y ON y.repo_id = e.repo_id AND y.node = e.d WHERE x.c <> y.c),
w AS (SELECT repo_id, c AS node, 0 AS layer FROM c UNION SELECT g.repo_id, g.d, w.layer + 1 FROM w JOIN g ON g.repo_id = w.repo_id AND g.s = w.node)
SELECT CAST(c.repo_id AS VARCHAR) AS repo_id, c.node, c AS component, CAST(max(layer) AS INTEGER) AS layer FROM c JOIN w ON w.repo_id = c.repo_id AND w.node = c.c GROUP BY ALL""")
def g09_cycles(spark, sf):
    """Brands in the order in which each customer buys them, a graph a customer: its cycles contracted, the rest in layers."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("string").alias("repo_id"))
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("src"))
    rows = items.join(orders, "l_orderkey").join(brands, "l_partkey").select("repo_id", "src", F.lead("src").over(W.partitionBy("repo_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("dst"))
    rows = stored(rows.distinct())
    return components.layers(rows.filter("dst is not null"), rows.select("repo_id", F.col("src").alias("node")))


@query(S + """, ok AS (SELECT *, len(string_split(path, '/')) AS depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM own WHERE size BETWEEN 1 AND 400000),
s0 AS (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY aux, depth, path) AS turn, 0 AS stage, '' AS dir FROM ok WHERE f = 14 QUALIFY turn <= 40),
s3 AS (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id ORDER BY depth, path) AS turn, 3 AS stage, '' AS dir FROM ok WHERE f = 12 OR ok.dir = '.github/workflows' QUALIFY turn <= 40),
early AS (SELECT * FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s3) QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY stage) = 1),
late AS (SELECT repo_id, path, size, row_number() OVER (PARTITION BY repo_id, parent ORDER BY path) AS turn, 4 AS stage, parent AS dir FROM ok WHERE category IN ('source', 'test') AND (repo_id, path) NOT IN (SELECT repo_id, path FROM early))
SELECT repo_id, path, size, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY stage, turn, dir, path) AS INTEGER) AS rank FROM (SELECT * FROM early UNION ALL SELECT * FROM late) QUALIFY rank <= 300""")
def s07_selected(spark, sf):
    return selection.selected(R.tree(spark, sf))


@query("""SELECT doc_id, octet_length(encode(text)) AS bytes, text FROM documents WHERE octet_length(encode(text)) <= 5000 AND doc_id % 5 <> 0""")
def s10_decoded(spark, sf):
    """Texts as bytes, every fifth with a zero byte near its start."""
    docs = table(spark, sf, "documents").filter("text is not null")
    content = F.concat(F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary")), F.encode("text", "UTF-8"))
    return selection.decoded(docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), content.alias("content")), max_bytes=5000)


@query("""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'o' || c_custkey WHEN 1 THEN 'o' || c_custkey WHEN 5 THEN 'o' || c_custkey END AS owner, CASE c_custkey % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'name.x' WHEN 5 THEN 'a' END AS name, CASE c_custkey % 6 WHEN 2 THEN 'host' WHEN 3 THEN 'no repository' WHEN 4 THEN 'owner' END AS error FROM customer""")
def s01_repository_key(spark, sf):
    k = F.col("c_custkey")
    raw = R.at(["https://github.com/o%/name.git", " git@github.com:o%/name.x.git", "https://example.org/o%/name", "o%", "-o%/name", "www.github.com/o%/a/tree/main"], k % 6)
    customers = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return customers.select(k.cast("long").alias("c_custkey"), selection.repository_key(F.replace(raw, F.lit("%"), k.cast("string"))).alias("r")).select("c_custkey", "r.*")


@query("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo_id, user_id % 2 = 1 OR user_id % 3 = 1 AS partial, CASE WHEN user_id % 2 = 1 THEN 'the host cut the file tree;' ELSE '' END || CASE WHEN user_id % 3 = 1 THEN 'the byte budget was used up;' ELSE '' END AS notes FROM events""")
def a31_report_notes(spark, sf):
    u = F.col("user_id")
    meta = table(spark, sf, "events").select(u).distinct().select(u.cast("string").alias("repo_id"), (u % 2 == 1).alias("truncated_by_host"), F.lit(False).alias("truncated_by_limit"), (u % 3 == 1).alias("budget_exhausted"), F.lit(None).cast("boolean").alias("rate_limited"))
    return selection.report_notes(meta).withColumn("notes", F.concat(F.array_join("notes", ";"), F.when(F.size("notes") > 0, ";").otherwise("")))


def _services(spark, sf):
    """A Compose file a nation, a service a supplier that needs the one before it and another that isn't there."""
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.lag("s_suppkey").over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("before"))
    needs = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("    depends_on: ['s"), F.coalesce("before", F.lit(-1)).cast("string"), F.lit("', gone]\n"))).otherwise(F.concat(F.lit("    depends_on:\n      - s"), F.coalesce("before", F.lit(-1)).cast("string"), F.lit("\n      gone:\n        condition: ok\n")))
    one = F.concat(F.lit("  s"), F.col("s_suppkey").cast("string"), F.lit(":\n"), F.when(F.col("s_suppkey") % 3 == 0, "    build: .\n").otherwise(F.concat(F.lit("    image: \"i:"), F.col("s_suppkey").cast("string"), F.lit("\" \n"))), needs, F.lit("    ports:\n      - 1\n"))
    files = rows.withColumn("one", one).groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "one"))), lambda x: x["one"]), "").alias("body"))
    return architecture.compose_services(files.select(F.lit("r").alias("repo_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/compose.yml")).alias("path"), F.concat(F.lit("version: '3'\n# x\nservices:\n"), "body", F.lit("volumes:\n  v:\n")).alias("text")), 1_000_000)


SERVICES = "s AS (SELECT *, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before FROM supplier)"


@query(f"WITH {SERVICES} SELECT 'r' AS repo_id, 'n' || s_nationkey || '/compose.yml' AS path, 's' || s_suppkey AS name, CASE WHEN s_suppkey % 3 <> 0 THEN 'i:' || s_suppkey END AS image, s_suppkey % 3 = 0 AS build, 's' || coalesce(before, -1) || ',gone' AS depends_on FROM s")
def v12_compose_services(spark, sf):
    return _services(spark, sf).withColumn("depends_on", F.array_join("depends_on", ","))


@query(f"WITH {SERVICES} SELECT 'r' AS repo_id, 'n' || s_nationkey || '/compose.yml' AS path, 's' || s_suppkey AS src, 's' || before AS dst FROM s WHERE before IS NOT NULL")
def j19_known_services(spark, sf):
    return views.known_services(_services(spark, sf))


@query("""WITH g AS (SELECT source AS repo_id, lang, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, lang) AS i FROM g),
x AS (SELECT repo_id, CASE WHEN i <= 2 THEN lang ELSE 'Other' END AS lang, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1, 2)
SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY repo_id), 9) AS percent FROM x""")
def a32_rest_bucket(spark, sf):
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("repo_id"), "lang").agg(F.sum("n_chars").alias("n"))
    return views.with_rest(rows, "lang", "n", 2).withColumn("percent", F.round("percent", 9))


@query(S + "SELECT repo_id, path FROM t WHERE contains(lower(path), 'readme') QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY path) <= 200")
def p31_path_filter(spark, sf):
    return views.paths(R.tree(spark, sf).select("repo_id", "path"), "Readme")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'external' WHEN 1 THEN 'exact' WHEN 2 THEN 'range' ELSE 'none' END AS kind FROM part""")
def p13_constraint(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", dependencies.constraint(F.when(k % 4 == 0, "git").otherwise("registry"), R.at(["1", "=1.2.3-rc.1", "~> 2", "latest"], k % 4), F.lit("npm")).alias("kind"))


@query("SELECT p_partkey, CASE WHEN s >= 80 THEN 'strong' WHEN s >= 50 THEN 'moderate' WHEN s IS NOT NULL THEN 'weak' END AS band FROM (SELECT p_partkey, CASE WHEN p_size <> 50 THEN p_size * 2 END AS s FROM part)")
def p27_band(spark, sf):
    score = F.when(F.col("p_size") != 50, F.col("p_size") * 2)
    return table(spark, sf, "part").select("p_partkey", health.band(score).alias("band"))


@query("""SELECT o_orderkey, CASE WHEN d <= 30 THEN 1.0::DOUBLE WHEN d <= 90 THEN 0.8::DOUBLE WHEN d <= 365 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS credit
FROM (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-15') AS d FROM orders)""")
def f27_recency_credit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", health.recency(F.datediff(F.lit("2001-08-15").cast("date"), F.to_date("o_orderdate"))).alias("credit"))


#: Each fact of health.FACTS from a customer's key: its place, times 7, plus the key, modulo its bound; every 11th is unknown.
_FACTS = [(x.split()[0], x.split()[1], n) for n, x in enumerate(health.FACTS.split(", "))]
_BOUND = {"readme_words": 500, "source_files": 40, "test_files": 12, "pushed_days": 500, "committed_days": 400, "root_source_files": 25, "product_max_depth": 16, "dependencies": 30, "unconstrained": 6, "markers": 90, "sampled_source_files": 20, "medium_findings": 7}


def _fact_sql(name: str, kind: str, n: int) -> str:
    value = f"(c_custkey + {7 * n})"
    if kind == "boolean":
        return f"{value} % 2 = 1 AS {name}"
    known = f"{value} % {_BOUND.get(name, 3)}"
    return f"CASE WHEN {value} % 11 <> 0 THEN {known} END AS {name}" if name.endswith("_days") else f"{known} AS {name}"


def _facts(spark, sf):
    out = []
    for name, kind, n in _FACTS:
        value = F.col("c_custkey") + 7 * n
        known = value % _BOUND.get(name, 3)
        out.append((value % 2 == 1 if kind == "boolean" else F.when(value % 11 != 0, known) if name.endswith("_days") else known).alias(name))
    return spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").cast("string").alias("repo_id"), *out)


_Y = lambda c: f"CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_CHECKS = [
    ("documentation", 20, _Y("has_readme")), ("documentation", 10, "readme_words / 300.0::DOUBLE"), ("documentation", 10, _Y("has_install")), ("documentation", 10, _Y("has_usage")), ("documentation", 20, _Y("has_license")),
    ("documentation", 10, _Y("has_contributing")), ("documentation", 10, _Y("doc_files > 0")), ("documentation", 10, _Y("has_changelog")),
    ("tests", 40, _Y("test_files > 0")), ("tests", 20, "test_files / greatest(source_files, 1)::DOUBLE / 0.2::DOUBLE"), ("tests", 20, _Y("test_frameworks > 0")), ("tests", 20, _Y("ci > 0")),
    ("dependencies", 20, _Y("manifest_errors = 0")), ("dependencies", 30, "CASE WHEN lockable_ecosystems > 0 THEN locked_ecosystems / lockable_ecosystems::DOUBLE ELSE 1.0::DOUBLE END"), ("dependencies", 20, _Y("CASE WHEN dependencies > 0 THEN unconstrained / dependencies::DOUBLE ELSE 0 END <= 0.1")), ("dependencies", 15, _Y("version_conflicts = 0")), ("dependencies", 15, _Y("update_bot")),
    ("activity", 50, "CASE WHEN pushed_days <= 30 THEN 1.0::DOUBLE WHEN pushed_days <= 90 THEN 0.8::DOUBLE WHEN pushed_days <= 365 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"), ("activity", 30, _Y("NOT archived")), ("activity", 20, _Y("committed_days <= 180")),
    ("security", 35, _Y("high_findings = 0")), ("security", 20, _Y("medium_findings <= 3")), ("security", 15, _Y("sensitive_files = 0")), ("security", 15, _Y("security_policy")), ("security", 15, _Y("gitignore_ok")),
    ("structure", 25, _Y("artifact_dirs = 0")), ("structure", 25, _Y("source_files <= 10 OR root_source_files / greatest(source_files, 1)::DOUBLE <= 0.5")), ("structure", 20, _Y("test_modules OR test_files > 0")), ("structure", 10, _Y("product_max_depth <= 10")), ("structure", 10, _Y("has_gitignore")), ("structure", 10, _Y("entry_points > 0")),
]
_HEALTH = f"""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, {", ".join(_fact_sql(*f) for f in _FACTS)} FROM customer),
p AS ({" UNION ALL ".join(f"SELECT repo_id, '{d}' AS dimension, {m} AS most, round_even({m} * least(1.0::DOUBLE, greatest(0.0::DOUBLE, coalesce({e}, 0.0::DOUBLE))), 1) AS points, {'source_files > 0' if d == 'tests' else 'manifests > 0 OR dependencies > 0' if d == 'dependencies' else 'TRUE'} AS applies FROM x" for d, m, e in _CHECKS)}),
s AS (SELECT repo_id, dimension, CASE WHEN applies THEN CAST(round_even(100.0::DOUBLE * sum(points) / sum(most), 0) AS INTEGER) END AS score FROM p GROUP BY repo_id, dimension, applies)"""


@query(f"{_HEALTH} SELECT repo_id, dimension, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 50 THEN 'moderate' WHEN score IS NOT NULL THEN 'weak' END AS band FROM s")
def h1_health_dimensions(spark, sf):
    """Six dimensions over facts; organization is in h2_organization."""
    return health.scored_dimensions(_facts(spark, sf)).filter("dimension <> 'organization'")


@query(f"{_HEALTH} SELECT repo_id, CAST(round_even(avg(score), 0) AS INTEGER) AS overall FROM s GROUP BY 1")
def a29_overall_health(spark, sf):
    return health.scored_overall(_facts(spark, sf), without=("organization",))


@query("""SELECT CAST(user_id AS VARCHAR) AS request, arg_max(event_type, (ts, CASE event_type WHEN 'view' THEN 0 ELSE 0 END, event_id)) AS last_type, count(*) AS events FROM events GROUP BY 1""")
def r01_latest_stage(spark, sf):
    """Each user's last event as a request's stage; event ids stand for the clock's ties."""
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("request"), F.col("event_type").alias("stage"), F.struct("ts", "event_id").alias("ts"))
    return limiter.latest_stage(events).select("request", F.col("stage").alias("last_type"), "events")


@query("""WITH w AS (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS key, epoch_us(ts) AS "start", epoch_us(ts) + 3600000000 AS "end", event_id FROM events),
m AS (SELECT *, coalesce("start" >= max("end") OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS leader FROM w)
SELECT *, max(CASE WHEN leader THEN "start" END) OVER (PARTITION BY key ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM m""")
def r06_single_flight(spark, sf):
    """Events of a user and day as requests of an hour; those that start while one runs join it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("key"), micros.alias("start"), (micros + 3_600_000_000).alias("end"), "event_id")
    return limiter.coalesced(events)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type AS key, epoch_us(ts) / 1e6::DOUBLE AS sec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
SELECT user_id, i, event_id, key, sec, FALSE AS hit, [key] AS names, [sec] AS born FROM e WHERE i = 1
UNION ALL
SELECT user_id, i, event_id, key, sec, hit,
 CASE WHEN hit THEN list_append(list_filter(names, lambda n: n <> key), key) ELSE list_append(list_filter(names, lambda n: n <> key), key)[-3:] END,
 CASE WHEN hit THEN list_append(list_filter(born, lambda b, j: names[j] <> key), born[pos]) ELSE list_append(list_filter(born, lambda b, j: names[j] <> key), sec)[-3:] END
FROM (SELECT e.*, r.names, r.born, list_position(r.names, e.key) AS pos, coalesce(list_position(r.names, e.key) > 0 AND e.sec - r.born[list_position(r.names, e.key)] <= 86400, FALSE) AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT CAST(user_id AS VARCHAR) AS shard, key, sec AS "at", event_id AS seq, hit FROM r""")
def r05_ttl_lru(spark, sf):
    """Each user's events as requests of a cache of three entries that live for a day."""
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("shard"), F.col("event_type").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("at"), F.col("event_id").alias("seq"))
    return limiter.cache_replay(events, 3, 86_400.0)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("""SELECT CAST(p_partkey * p_size * 37 AS BIGINT) AS n, CASE WHEN n >= 1000000 THEN regexp_replace(format('{:,.1f}', n / 1e6::DOUBLE), '\\.0$', '') || 'M' WHEN n >= 1000 THEN regexp_replace(format('{:,.1f}', n / 1e3::DOUBLE), '\\.0$', '') || 'k' ELSE CAST(n AS VARCHAR) END AS short FROM part""")
def f29_compact_count(spark, sf):
    n = (F.col("p_partkey") * F.col("p_size") * 37).cast("long")
    return table(spark, sf, "part").select(n.alias("n")).select("n", views.compact_count(F.col("n")).alias("short"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS repo_id, 'ab' || c_custkey AS sha, CASE WHEN c_custkey % 3 <> 0 THEN epoch_us(TIMESTAMP '2020-01-01 00:00:00' + to_seconds(c_custkey)) END AS micros FROM customer WHERE c_custkey % 4 <> 0""")
def s03_head_commit(spark, sf):
    """Answers of a host, every third with a bad date and every fourth without a sha."""
    k = F.col("c_custkey")
    date = F.when(k % 3 == 0, "soon").otherwise(F.date_format(F.timestamp_seconds(F.lit(1577836800) + k), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.to_json(F.struct(F.when(k % 4 != 0, F.concat(F.lit("ab"), k.cast("string"))).alias("sha"), F.struct(F.struct(date.alias("date")).alias("committer")).alias("commit")))
    return selection.head_commit(table(spark, sf, "customer").select(k.cast("string").alias("repo_id"), body.alias("body"))).select("repo_id", "sha", F.unix_micros("committed_at").alias("micros"))


@query("""SELECT CAST(user_id AS VARCHAR) AS repo_id, count(*) AS selected, count(*) FILTER (WHERE event_type = 'view') AS fetched, count(*) FILTER (WHERE event_type = 'click') AS skipped_too_large, count(*) FILTER (WHERE event_type = 'signup') AS skipped_binary, count(*) FILTER (WHERE event_type = 'error') AS failed,
CAST(coalesce(sum(event_id) FILTER (WHERE event_type = 'view'), 0) AS BIGINT) AS bytes_fetched, FALSE AS rate_limited, bool_or(event_type = 'purchase') AS budget_exhausted FROM events GROUP BY 1""")
def a30_fetch_stats(spark, sf):
    """Events as attempts: what each kind of event came to."""
    outcome = P.lookup({"view": "fetched", "click": "skipped_too_large", "signup": "skipped_binary", "error": "failed", "purchase": "budget_exhausted"}, F.col("event_type"))
    return selection.fetch_stats(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("repo_id"), F.col("event_id").cast("string").alias("path"), outcome.alias("outcome"), F.col("event_id").alias("bytes")))


@query("""SELECT 'r' || n_nationkey AS repo_id, 'docs' AS path, CASE n_nationkey % 4 WHEN 0 THEN 'MkDocs' WHEN 1 THEN 'Sphinx' WHEN 2 THEN 'VitePress' END AS generator FROM nation WHERE n_nationkey % 4 <> 3""")
def f24_site_generators(spark, sf):
    k = F.col("n_nationkey")
    files = F.array(F.lit("docs/a.md"), R.at(["mkdocs.yml", "docs/conf.py", "docs/.vitepress/config.js", "docs/x/mkdocs.yml"], k % 4), F.when(k % 8 == 0, "docs/conf.py").otherwise("z"))
    tree = table(spark, sf, "nation").select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.posexplode(files).alias("ord", "path")).select("repo_id", "ord", "path", F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"))
    return documentation.site_generators(tree)


@query("""SELECT 'r' || n_nationkey AS repo_id, 'src/main.ts' AS path, spec, CASE WHEN spec = 'lodash' THEN 'external' WHEN spec = '@/gone' THEN 'unresolved' ELSE 'internal' END AS kind,
CASE spec WHEN '@/lib/a' THEN CASE n_nationkey % 2 WHEN 0 THEN 'src/lib/a.ts' ELSE 'alt/lib/a.ts' END WHEN '~b/b.js' THEN 'pkg/b/b.ts' END AS target FROM nation, (VALUES ('@/lib/a'), ('@/gone'), ('~b/b.js'), ('lodash')) AS t(spec)""")
def f31_script_aliases(spark, sf):
    """Imports by aliases of a tsconfig with comments and trailing commas, a second place being tried after the first."""
    k = F.col("n_nationkey")
    files = F.array(F.lit("src/main.ts"), F.lit("tsconfig.json"), F.lit("pkg/b/b.ts"), R.at(["src/lib/a.ts", "alt/lib/a.ts"], k % 2))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.posexplode(files).alias("ord", "path"))
    config = '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", /* a\n b */ "paths": {"@/*": ["src/*", "alt/*"], "~b/*": ["./pkg/b/*",],},},\n}'
    script = "import a from '@/lib/a'\nimport { g } from '@/gone'\nimport b from '~b/b.js'\nimport l from 'lodash'\n"
    text = F.when(F.col("path") == "src/main.ts", script).when(F.col("path") == "tsconfig.json", config)
    tree = rows.select("repo_id", "ord", "path", F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"))
    return graph.resolved(tree, rows.select("repo_id", "path", text.alias("text")).filter("text is not null")).drop("language")


@query("""WITH r AS (SELECT source AS repo_id, lang AS language, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, language) AS i FROM r),
h AS (SELECT source AS repo_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)
SELECT repo_id, (SELECT string_agg(language || ':' || n, ',' ORDER BY i) FROM t WHERE t.repo_id = s.repo_id AND i <= 8) AS languages,
(SELECT string_agg(CASE WHEN length(x) > 40 THEN left(x, 39) || '…' ELSE x END, '|' ORDER BY i) FROM (SELECT i, regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g') AS x, repo_id FROM h) AS y WHERE y.repo_id = s.repo_id AND i <= 20) AS headings FROM (SELECT DISTINCT source AS repo_id FROM documents) s""")
def f30_digest(spark, sf):
    from ..sources import export

    docs = table(spark, sf, "documents").select(F.col("source").alias("repo_id"), "doc_id", "lang", "n_chars", "text")
    langs = docs.groupBy("repo_id", F.col("lang").alias("language")).agg(F.sum("n_chars").alias("n"))
    out = export.digest({"languages": (langs, [F.desc("n"), "language"]), "headings": (docs.select("repo_id", "doc_id", "text"), ["doc_id"])}, 40)
    said = F.array_join(F.transform("languages", lambda x: F.concat(x["language"], F.lit(":"), x["n"].cast("string"))), ",")
    return out.select("repo_id", said.alias("languages"), F.array_join(F.transform("headings", lambda x: x["text"]), "|").alias("headings"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream, line_no, line FROM (SELECT conv_id, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS line_no, unnest(ls) AS line, len(ls) AS n FROM (SELECT conv_id, string_split(string_agg(text, '' ORDER BY turn), chr(10)) AS ls FROM conversations GROUP BY 1)) WHERE line_no + 1 < n OR line <> ''""")
def r02_framing(spark, sf):
    """Turns of a conversation as chunks of one stream of lines."""
    return limiter.framed(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("stream"), F.col("turn").alias("seq"), F.col("text").alias("chunk")))


#: Manifests of a supplier, % being its key: path, text, and the dependencies that they declare: name, version, scope, source, direct.
MANIFESTS = {
    "v02_requirements": ("requirements-dev.txt", "# c\na%==1.%  # x\n-r other.txt\nb[c]>=2 ; python_version > '3'\n-e git+https://h/r#egg=e%\nz @ https://h/z.whl\nhttps://h/y%.whl\n\nlone\n", [("a%", "==1.%", "development", "registry", True), ("b", ">=2", "development", "registry", True), ("e%", None, "development", "git", True), ("z", None, "development", "url", True), ("https://h/y%.whl", None, "development", "url", True), ("lone", None, "development", "registry", True)]),
    "v03_pyproject": ("pyproject.toml", '[project]\ndependencies = ["a%>1", "b ~= 2"]\n[project.optional-dependencies]\ntest = ["c"]\nextra = ["d==%"]\n[dependency-groups]\nlint = ["e"]\n[tool.poetry.dependencies]\npython = "3"\nf = {version = "^%", optional = true}\n[tool.poetry.group.main.dependencies]\ng = "1"\n', [("a%", ">1", "production", "registry", True), ("b", "~= 2", "production", "registry", True), ("c", None, "development", "registry", True), ("d", "==%", "optional", "registry", True), ("e", None, "development", "registry", True), ("f", "^%", "optional", "registry", True), ("g", "1", "production", "registry", True)]),
    "v04_pipfile": ("Pipfile", '[packages]\na% = "*"\nb = {git = "u"}\n[dev-packages]\nc = {path = "x", version = "%"}\n', [("a%", "*", "production", "registry", True), ("b", None, "production", "git", True), ("c", "%", "development", "path", True)]),
    "v05_setup_cfg": ("setup.cfg", "[options]\ninstall_requires =\n  a%>1\n  b\n[options.extras_require]\ndocs = c\nfast = d<%\n", [("a%", ">1", "production", "registry", True), ("b", None, "production", "registry", True), ("c", None, "development", "registry", True), ("d", "<%", "optional", "registry", True)]),
    "v06_pom": ("pom.xml", "<project><version>9</version><properties><v>3.%</v></properties><dependencies><dependency><groupId>g%</groupId><artifactId>a</artifactId><version>${v}</version><scope>test</scope></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>${project.version}</version><optional>true</optional></dependency><dependency><artifactId>c</artifactId><scope>provided</scope></dependency></dependencies></project>", [("g%:a", "3.%", "development", "registry", True), ("h:b", "9", "optional", "registry", True), ("c", None, "build", "registry", True)]),
    "v07_gradle": ("build.gradle", "implementation 'g:a%:1'\napi(platform(\"h:b:$v\"))\nkapt \"i:c\"\ntestImplementation(group: 'j', name: 'd', version: '%')\nruntimeOnly project(':x')\n", [("g:a%", "1", "production", "registry", True), ("h:b", "$v", "production", "registry", True), ("i:c", None, "build", "registry", True), ("j:d", "%", "development", "registry", True)]),
    "v08_cargo": ("Cargo.toml", '[dependencies]\na% = "1"\nb = {workspace = true}\nc = {package = "real", version = "%"}\n[dev-dependencies]\nd = {git = "u"}\n[build-dependencies]\ne = {path = "p"}\n', [("a%", "1", "production", "registry", True), ("b", None, "production", "workspace", True), ("real", "%", "production", "registry", True), ("d", None, "development", "git", True), ("e", None, "build", "path", True)]),
    "v09_go_mod": ("go.mod", "module m\nrequire (\n a.b/c% v1.0.%\n d v2 // indirect\n)\nreplace (\n x v1 => y v2\n)\nrequire e v3\n", [("a.b/c%", "v1.0.%", "production", "registry", True), ("d", "v2", "production", "registry", False), ("e", "v3", "production", "registry", True)]),
    "v10_composer": ("composer.json", '{"require": {"php": ">8", "a/b%": "%", "ext-x": "*"}, "require-dev": {"lib-y": "1", "c/d": "2"}}', [("a/b%", "%", "production", "registry", True), ("c/d", "2", "development", "registry", True)]),
    "v11_gemfile": ("Gemfile", "gem 'a%', '~> %'\ngroup :test do\n  platforms :ruby do\n    gem 'b', path: 'x'\n  end\n  group :production do\n    gem 'c', '1.0', '< 2'\n  end\nend\nsource 's' do |x|\n  gem 'd', github: 'u/r'\nend\ngem 'e', group: :development\n", [("a%", "~> %", "production", "registry", True), ("b", None, "development", "path", True), ("c", "1.0, < 2", "production", "registry", True), ("d", None, "production", "git", True), ("e", None, "development", "registry", True)]),
}


def _manifest_query(name: str, path: str, text: str, want: list[tuple]) -> None:
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join("(" + ", ".join(map(said, r)) + f", {i})" for i, r in enumerate(want))
    filled = lambda c: f"replace({c}, '%', CAST(s_suppkey AS VARCHAR)) AS {c}"

    def run(spark, sf):  # noqa: ANN001, ANN202
        key = F.col("s_suppkey").cast("string")
        files = table(spark, sf, "supplier").select(key.alias("repo_id"), F.lit(path).alias("path"), F.replace(F.lit(text), F.lit("%"), key).alias("text"))
        return manifests.parsed(files).transform(manifests.each, "repo_id", "error").filter("error is null").drop("error")

    run.__name__, run.__doc__ = name, f"Dependencies of {path} files."
    query(f"SELECT CAST(s_suppkey AS VARCHAR) AS repo_id, CAST(ord AS INTEGER) AS ord, {filled('name')}, {filled('version')}, scope, source, direct FROM supplier, (VALUES {rows}) AS t(name, version, scope, source, direct, ord)")(run)


for _name, (_path, _text, _want) in MANIFESTS.items():
    _manifest_query(_name, _path, _text, _want)


def _files(spark, sf, paths: list[str]):  # noqa: ANN001, ANN202
    """Trees of a nation each; a % in a path is its key."""
    key = F.col("n_nationkey").cast("string")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("r"), key).alias("repo_id"), F.col("n_nationkey").alias("k"), F.posexplode(F.array(*map(F.lit, paths))).alias("ord", "path"))
    return rows.select("repo_id", "k", "ord", F.replace("path", F.lit("%"), F.col("k").cast("string")).alias("path"), F.lit("file").alias("type"), F.lit(1).cast("long").alias("size"))


@query("""SELECT 'r' || n_nationkey AS repo_id, replace(path, '%', CAST(n_nationkey AS VARCHAR)) AS path, title, severity, in_test FROM nation, (VALUES ('.env', 'Environment file committed', 'high', FALSE), ('a%/.env.production', 'Environment file committed', 'high', FALSE), ('k/id_rsa', 'SSH private key file committed', 'high', FALSE),
('s%.pem', 'Key or certificate store committed', 'medium', FALSE), ('tests/1.db', 'Database file committed', 'info', TRUE), ('tests/2.db', 'Database file committed', 'info', TRUE), ('tests/3.db', 'Database file committed', 'info', TRUE), ('tests/4.db', 'Database file committed (+2 more in test/example paths)', 'info', TRUE)) AS t(path, title, severity, in_test)""")
def w02_sensitive_files(spark, sf):
    return security.sensitive_files(_files(spark, sf, [".env", ".env.example", "a%/.env.production", "k/id_rsa", "s%.pem", "node_modules/x.pem", "tests/1.db", "tests/2.db", "tests/3.db", "tests/4.db", "tests/5.db", "src/a.py"]))


@query("""SELECT 'r' || n_nationkey AS repo_id, n_nationkey % 5 <> 4 AS present, CASE n_nationkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN TRUE END AS env_excluded FROM nation""")
def p33_gitignore(spark, sf):
    """A file that excludes .env, one that doesn't, one that comments it out, one with a wider form, none."""
    tree = _files(spark, sf, [".gitignore", "src/a.py"]).filter("k % 5 <> 4 or path <> '.gitignore'")
    texts = tree.filter("path = '.gitignore'").select("repo_id", "path", R.at(["x\n.env\n", "x\n", "# .env\n", "/**/.env*\n"], F.col("k") % 5).alias("text"))
    return security.gitignore(tree, texts)


@query("""SELECT 'r' || n_nationkey AS repo_id, kind, path, detail FROM nation, (VALUES ('Container image', 'Dockerfile', 'Dockerfile'), ('Docker Compose', 'compose.yml', '2 service(s)'), ('Helm chart', 'c/Chart.yaml', 'Kubernetes package'), ('Deployment config', 'Procfile', 'Procfile'), ('Kubernetes manifest', 'k.yaml', 'kind: Service'), ('Terraform', 't', '2 .tf file(s); providers: aws, gcp')) AS t(kind, path, detail)""")
def a25_infrastructure(spark, sf):
    files = {"Dockerfile": "FROM a", "compose.yml": "services:\n  web:\n    image: x\n  db:\n    build: .\n", "c/Chart.yaml": "name: x", "Procfile": "web: x", "k.yaml": "kind: Service\n", "t/a.tf": 'provider "aws" {}', "t/b.tf": 'provider "gcp" {}\nprovider "aws" {}'}
    tree = _files(spark, sf, [*files, "node_modules/Dockerfile"])
    return architecture.infrastructure(tree, tree.select("repo_id", "path", P.lookup(files, F.col("path")).alias("text")).filter("text is not null"))


@query("""SELECT 'r' || n_nationkey AS repo_id, CAST(ord AS INTEGER) AS ord, path, type, CAST(size AS BIGINT) AS size FROM nation, (VALUES (0, 'a', 'file', 5), (2, 'c', 'symlink', 0), (3, 'd', 'submodule', 0), (5, 'f', 'file', 0), (6, 'g', 'dir', 0)) AS t(ord, path, type, size) WHERE ord < 6 OR n_nationkey % 2 = 0""")
def s06_sanitized(spark, sf):
    """Entries of a host's JSON, with an unsafe path, an unknown kind and a negative size; for odd keys cut short."""
    entries = [("a", "blob", "100644", 5), ("../b", "blob", "100644", 1), ("c", "blob", "120000", 3), ("d", "commit", "160000", None), ("e", "odd", "1", 1), ("f", "blob", "100644", -4), ("g", "tree", "40000", None)]
    listed = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("type"), F.lit(m).alias("mode"), F.lit(s).cast("long").alias("size")) for p, t, m, s in entries])
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.to_json(F.struct(F.when(k % 2 == 0, listed).otherwise(F.slice(listed, 1, 6)).alias("tree"))).alias("body"))
    return structure.sanitized(selection.raw_tree(rows), 100)


@query("""SELECT lower('O' || c_custkey || '/N') AS repo_id, 'O' || c_custkey || '/N' AS full_name, 'O' || c_custkey AS owner, CAST(c_custkey AS BIGINT) AS stars, CAST(0 AS BIGINT) AS forks, CASE WHEN c_custkey % 2 = 0 THEN 'MIT' END AS license_spdx, CASE WHEN c_custkey % 2 = 0 THEN 'MIT License' END AS license_name, c_custkey % 3 = 0 AS archived, FALSE AS is_fork, 'a,b' AS topics FROM customer""")
def s02_metadata(spark, sf):
    k = F.col("c_custkey")
    license_ = F.struct(F.when(k % 2 == 0, "MIT").otherwise("NOASSERTION").alias("spdx_id"), F.when(k % 2 == 0, "MIT License").otherwise("Other").alias("name"))
    owner = F.concat(F.lit("O"), k.cast("string"))
    body = F.to_json(F.struct(F.concat(owner, F.lit("/N")).alias("full_name"), F.struct(owner.alias("login")).alias("owner"), k.alias("stargazers_count"), license_.alias("license"), F.when(k % 3 == 0, True).alias("archived"), F.array(F.lit("a"), F.lit("b")).alias("topics"), F.lit("soon").alias("created_at")))
    out = selection.metadata(table(spark, sf, "customer").select(body.alias("body")))
    return out.select("repo_id", "full_name", "owner", "stars", "forks", "license_spdx", "license_name", "archived", "is_fork", F.array_join("topics", ",").alias("topics"))


@query(S + """SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS name, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, lower(string_split(regexp_extract(path, '[^/]*$'), '.')[1]) AS stem, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM t""")
def f01_path_parts(spark, sf):
    p = F.col("path")
    return R.tree(spark, sf).select("repo_id", "path", P.name(p).alias("name"), P.parent(p).alias("parent"), P.stem(p).alias("stem"), P.depth(p).alias("depth"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/c' || p_partkey WHEN 1 THEN '../c' || p_partkey WHEN 2 THEN 'a/b/c' || p_partkey ELSE '' END AS path, 'x y+' || p_partkey AS decoded FROM part")
def f02_normalized(spark, sf):
    k = F.col("p_partkey")
    raw = F.replace(R.at(["a/./b/../c%", "a/../../c%", "a//b/./c%", "a/b/../.."], k % 4), F.lit("%"), k.cast("string"))
    from ..functions import text

    return table(spark, sf, "part").select("p_partkey", text.normalized(raw).alias("path"), text.percent_decode(F.concat(F.lit("x%20y+"), k.cast("string"))).alias("decoded"))


@query(S + f", {SCANNED} SELECT repo_id, path, line, rule, severity, in_test FROM z WHERE NOT in_test AND severity = 'low' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY CASE rule WHEN 'transport.insecure-http' THEN 'insecure-transport' ELSE 'supply-chain' END, path, line) <= 150")
def p29_finding_filter(spark, sf):
    return views.findings(security.scan(R.contents(spark, sf)), "low").select("repo_id", "path", "line", "rule", "severity", "in_test")


@query("""WITH g AS (SELECT source AS repo_id, lang, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1, 2) SELECT repo_id, lang AS language, 'programming' AS kind, bytes, round(bytes * 100.0::DOUBLE / sum(bytes) OVER (PARTITION BY repo_id), 9) AS percent_of_bytes FROM g WHERE lang <> 'en'""")
def p32_language_filter(spark, sf):
    """English stands for prose here, and is left out of the shares."""
    rows = table(spark, sf, "documents").groupBy(F.col("source").alias("repo_id"), F.col("lang").alias("language")).agg(F.sum("n_chars").alias("bytes"))
    stats = rows.select("repo_id", "language", F.when(F.col("language") == "en", "prose").otherwise("programming").alias("kind"), "bytes", F.lit(1.0).alias("percent_of_bytes"))
    return views.languages(stats).withColumn("percent_of_bytes", F.round("percent_of_bytes", 9))


_ORGANIZATION = [
    (25, "CASE WHEN lf <= 0.05 THEN 1.0::DOUBLE ELSE 1 - (lf - 0.05::DOUBLE) / 0.2::DOUBLE END"), (25, "CASE WHEN high_complexity_count <= greatest(1, floor(sm / 50.0)) THEN 1.0::DOUBLE ELSE 1 - high_complexity_count / sm::DOUBLE * 5 END"),
    (25, _Y("linters > 0")), (15, _Y("formatters > 0")), (10, _Y("markers / sm::DOUBLE <= 5")),
]


@query(f"""WITH x AS (SELECT CAST(c_custkey AS VARCHAR) AS repo_id, {", ".join(_fact_sql(*f) for f in _FACTS)} FROM customer),
y AS (SELECT *, long_file_count / greatest(1, source_files)::DOUBLE AS lf, greatest(1, sampled_source_files) AS sm FROM x),
p AS ({" UNION ALL ".join(f"SELECT repo_id, {m} AS most, round_even({m} * least(1.0::DOUBLE, greatest(0.0::DOUBLE, {e})), 1) AS points, source_files > 0 AS applies FROM y" for m, e in _ORGANIZATION)}),
s AS (SELECT repo_id, CASE WHEN applies THEN CAST(round_even(100.0::DOUBLE * sum(points) / sum(most), 0) AS INTEGER) END AS score FROM p GROUP BY repo_id, applies)
SELECT repo_id, score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 50 THEN 'moderate' WHEN score IS NOT NULL THEN 'weak' END AS band FROM s""")
def h2_organization(spark, sf):
    return health.scored_dimensions(_facts(spark, sf)).filter("dimension = 'organization'").drop("dimension")
