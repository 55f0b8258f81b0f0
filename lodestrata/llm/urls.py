"""URL filters by character language models, with DataFrame functions only.

Rules of host and path decide first. Their verdicts label URLs, from which two smoothed Markov models of variable order are
learned, one of accepted and one of rejected URLs: a character's probability after a context of up to ORDER - 1 characters
is its count there, plus STRENGTH times its probability after the context shortened by one, over the context's count plus
STRENGTH; the empty context falls back on a uniform alphabet. A URL's score is the mean over its characters of the
difference of log-likelihoods, in whole micronats, so sums are exact in any order. The threshold is the score that best
separates labelled URLs of a fold kept out of the models.

Models are tables of distinct grams; a third of all rows on one host makes grams frequent, which partial sums absorb. The
table is broadcast only where its counted rows are few; else its frequent grams are, and the rest is joined by shuffle.

Defined results: without an URL, or one without ://, host and path are empty and the URL is blocked if no rule fits; with
no accepted or no rejected URL to learn from everything else is allowed; repeated rows repeat; other columns are ignored;
very long URLs are scored whole; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The rules of the query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

ORDER = 5
STRENGTH = 1.5
ALPHABET = 256
FOLDS, HELD = 5, 0
MOST_BROADCAST, HOT = 200_000, 1e-5
START, STOP = "\u0002", "\u0003"


def lowered(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path of each row."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", lowered(host).alias("host"), path.alias("path"))


def ruled(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rows(host, path) with rule and ruling of the longest rule that fits; both null without one."""
    fits = [F.lit(None).cast("struct<n:int,rule:string,ruling:string>")] * 2
    for ruling, rule in rules:
        host, path = rule[: rule.find("/")], rule[rule.find("/") :]
        fit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(ruling).alias("ruling"))))
    best = F.greatest(*fits)
    return rows.withColumn("_best", best).select(*rows.columns, "_best.rule", "_best.ruling")


def characters(order: int) -> Column:
    """Every gram of a URL: each character, the stop mark included, after the order - 1 characters before it."""
    marks = F.split(F.concat(F.lit(START * (order - 1)), "host", "path", F.lit(STOP)), "")
    return F.transform(F.sequence(F.lit(order), F.size(marks)), lambda i: F.concat(*[F.element_at(marks, i - k) for k in range(order - 1, -1, -1)]))


def ratios(grams: DataFrame, order: int = ORDER, strength: float = STRENGTH, alphabet: int = ALPHABET) -> DataFrame:
    """gram, ratio: micronats of the accepted model over the rejected one, for each row of grams(gram, a, r)."""
    below = None
    for k in range(1, order + 1):
        own = grams if k == order else grams.groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.left("gram", F.lit(k - 1))
        if k == 1:
            totals = own.agg(F.sum("a").alias("ca"), F.sum("r").alias("cr")).first()
            ca, cr = F.lit(totals["ca"] or 0), F.lit(totals["cr"] or 0)
            joined, pa, pr = own, F.lit(1.0 / alphabet), F.lit(1.0 / alphabet)
        else:
            totals = own.groupBy(context.alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
            joined = own.withColumn("context", context).withColumn("shorter", F.right("gram", F.lit(k - 1))).join(totals, "context").join(below, "shorter")
            ca, cr, pa, pr = F.col("ca"), F.col("cr"), F.col("pa"), F.col("pr")
        p = lambda n, c, q: (n + strength * q) / (c + strength)
        level = joined.select("gram", p(F.col("a"), ca, pa).alias("pa"), p(F.col("r"), cr, pr).alias("pr"))
        below = level.withColumnRenamed("gram", "shorter")
    return below.select(F.col("shorter").alias("gram"), F.round((F.ln("pa") - F.ln("pr")) * 1e6).cast("long").alias("ratio"))


def scored(rows: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """rows(page_id, host, path, rule, ruling) with fold and score (null if there is nothing to learn from)."""
    text = F.concat("host", "path")
    placed = rows.withColumn("fold", F.when(F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int") % FOLDS == HELD, HELD).otherwise(HELD + 1))
    learn = lambda ruling: F.sum(F.when((F.col("ruling") == ruling) & (F.col("fold") != HELD), 1).otherwise(0))
    placed = common.stored(placed.withColumn("row_id", F.monotonically_increasing_id()))
    each = placed.withColumn("gram", F.explode(characters(order)))
    grams = common.stored(each.groupBy("gram").agg(learn("allow").alias("a"), learn("block").alias("r"), F.count(F.lit(1)).alias("n")))
    model = common.stored(ratios(grams, order, strength))
    return with_ratios(each, model, grams).groupBy("row_id", *rows.columns, "fold").agg((F.sum("ratio") / F.count(F.lit(1))).alias("score"))


def with_ratios(each: DataFrame, model: DataFrame, grams: DataFrame) -> DataFrame:
    """each(gram, ...) with its ratio. Beyond MOST_BROADCAST grams, those with a HOT share of all occurrences, of which
    there are at most 1 / HOT, are broadcast, and only the others, none of which is frequent, are shuffled."""
    if model.count() <= MOST_BROADCAST:
        return each.join(F.broadcast(model), "gram")
    total = grams.agg(F.sum("n")).first()[0]
    hot = common.stored(model.join(grams.filter(F.col("n") >= HOT * total).select("gram"), "gram", "left_semi"))
    return each.join(F.broadcast(hot), "gram").unionByName(each.join(F.broadcast(hot.select("gram")), "gram", "left_anti").join(model, "gram"))


def threshold(rows: DataFrame) -> float | None:
    """The score, in steps of 10,000 micronats, below which blocking best separates the labelled rows of the fold kept out
    (the greatest difference of shares right and wrong; ties: the lowest). None without rows of both labels."""
    bins = rows.filter((F.col("fold") == HELD) & F.col("ruling").isNotNull()).groupBy(F.floor(F.col("score") / 10_000).alias("bin")).agg(F.sum(F.when(F.col("ruling") == "allow", 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("ruling") == "block", 1).otherwise(0)).alias("r"))
    below_a = below_r = 0
    found = sorted((r["bin"], r["a"], r["r"]) for r in bins.collect())  # bins of a bounded mean: some thousands
    all_a, all_r = sum(a for _, a, _ in found), sum(r for _, _, r in found)
    if not all_a or not all_r:
        return None
    best, at = -1.0, None
    for low, a, r in found:
        if (gain := below_r / all_r - below_a / all_a) > best + 1e-12:
            best, at = gain, low * 10_000.0
        below_a, below_r = below_a + a, below_r + r
    return at


def judged(pages: DataFrame, rules: list[tuple[str, str]], order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages(page_id, url)."""
    rows = common.stored(scored(ruled(parsed(pages), rules), order, strength))
    limit = threshold(rows)
    by_score = F.lit("allow") if limit is None else F.when(F.col("score") < limit, "block").otherwise("allow")
    verdict = F.coalesce("ruling", F.when((F.col("host") == "") & (F.col("path") == ""), "block").otherwise(by_score))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged. Edge cases: see the module."""
    return judged(common.table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    levels = ["t1 AS (SELECT gram, a, r, (SELECT sum(a) FROM g) AS ca, (SELECT sum(r) FROM g) AS cr FROM (SELECT right(gram, 1) AS gram, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1))", f"p1 AS (SELECT gram, (a + {STRENGTH}::DOUBLE * (1.0::DOUBLE / {ALPHABET})) / (ca + {STRENGTH}::DOUBLE) AS pa, (r + {STRENGTH}::DOUBLE * (1.0::DOUBLE / {ALPHABET})) / (cr + {STRENGTH}::DOUBLE) AS pr FROM t1)"]
    for k in range(2, ORDER + 1):
        levels.append(f"t{k} AS (SELECT gram, CAST(sum(a) AS DOUBLE) AS a, CAST(sum(r) AS DOUBLE) AS r FROM (SELECT right(gram, {k}) AS gram, a, r FROM g) GROUP BY 1)")
        levels.append(f"p{k} AS (SELECT t.gram, (t.a + {STRENGTH}::DOUBLE * q.pa) / (c.ca + {STRENGTH}::DOUBLE) AS pa, (t.r + {STRENGTH}::DOUBLE * q.pr) / (c.cr + {STRENGTH}::DOUBLE) AS pr FROM t{k} t JOIN (SELECT left(gram, {k - 1}) AS ctx, sum(a) AS ca, sum(r) AS cr FROM t{k} GROUP BY 1) c ON left(t.gram, {k - 1}) = c.ctx JOIN p{k - 1} q ON right(t.gram, {k - 1}) = q.gram)")
    rules = " ".join(f"WHEN (host = '{r[: r.find('/')]}' OR host LIKE '%.{r[: r.find('/')]}') AND starts_with(path, '{r[r.find('/') :]}') THEN '{v} {r}'" for v, r in sorted(RULES, key=lambda x: -len(x[1])))
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {rules} END AS hit FROM h),
k AS (SELECT row_number() OVER () AS id, page_id, host, path, substr(hit, 7) AS rule, left(hit, 5) AS ruling FROM j),
s AS (SELECT *, repeat(chr(2), {ORDER - 1}) || host || path || chr(3) AS marks FROM k),
f AS (SELECT *, CASE WHEN CAST(('0x' || substr(md5(host || path), 1, 4)) AS BIGINT) % {FOLDS} = {HELD} THEN {HELD} ELSE {HELD + 1} END AS fold FROM s),
e AS (SELECT f.*, substr(marks, CAST(i AS BIGINT), {ORDER}) AS gram FROM f, unnest(range(1, length(marks) - {ORDER - 2})) AS x(i)),
g AS (SELECT gram, sum(CASE WHEN ruling = 'allow' AND fold <> {HELD} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a, sum(CASE WHEN ruling = 'block' AND fold <> {HELD} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM e GROUP BY 1),
{", ".join(levels)},
m AS (SELECT gram, CAST(round((ln(pa) - ln(pr)) * 1e6) AS BIGINT) AS ratio FROM p{ORDER}),
c AS (SELECT id, page_id, host, path, rule, ruling, fold, CAST(sum(ratio) AS DOUBLE) / count(*) AS score FROM e JOIN m USING (gram) GROUP BY ALL),
b AS (SELECT floor(score / 10000) AS bin, sum(CASE WHEN ruling = 'allow' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a, sum(CASE WHEN ruling = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS r FROM c WHERE fold = {HELD} AND ruling IS NOT NULL GROUP BY 1),
w AS (SELECT bin, round(coalesce(sum(r) OVER o, 0.0) / (SELECT sum(r) FROM b) - coalesce(sum(a) OVER o, 0.0) / (SELECT sum(a) FROM b), 12) AS gain FROM b WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT bin * 10000.0::DOUBLE AS lim FROM w ORDER BY gain DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN host = '' AND path = '' THEN 'block' WHEN score < (SELECT lim FROM z) THEN 'block' ELSE 'allow' END) AS verdict FROM c
"""


QUERIES = {"op6_urls": op6_urls}
ORACLE = {"op6_urls": _oracle()}
