"""Lines and languages: a lexical line counter as a fold, and statistics per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions import text as T
from . import generic as G
from .structure import analyzed_files, classified

LINE_COUNTS = "total", "code", "comment", "blank"


def syntax(language: Column) -> tuple[Column, Column, Column]:
    """Line prefixes (array), block start and block end ('' if none) of a language."""
    by = lambda value, default: F.coalesce(F.try_element_at(F.create_map(*[x for lang, s in C.COMMENTS.items() for x in (F.lit(lang), value(s))]), language), default)
    empty = F.array().cast("array<string>")
    prefixes = by(lambda s: F.array(*[F.lit(p) for p in s[0]]).cast("array<string>"), empty)
    start = by(lambda s: F.lit(s[1][0][0] if s[1] else ""), F.lit(""))
    end = by(lambda s: F.lit(s[1][0][1] if s[1] else ""), F.lit(""))
    return prefixes, start, end


def count_lines(text: Column, language: Column) -> Column:
    """struct(total, code, comment, blank). A block comment opens at a line's start only; what follows its end on the same
    line still counts as comment."""
    prefixes, start, end = syntax(language)
    zero = F.struct(F.lit(False).alias("open"), *[F.lit(0).cast("long").alias(c) for c in LINE_COUNTS])

    def step(acc: Column, raw: Column) -> Column:
        line = T.strip(raw)
        opens = ~acc["open"] & (start != "") & line.startswith(start)
        closed = F.when(acc["open"], F.contains(line, end)).otherwise(F.contains(F.substring(line, F.length(start) + 1, F.length(line)), end))
        blank = ~acc["open"] & (line == "")
        comment = acc["open"] | opens | (~blank & F.exists(prefixes, lambda p: F.startswith(line, p)))
        one = lambda when: F.when(when, 1).otherwise(0)
        return F.struct(((acc["open"] | opens) & ~closed).alias("open"), (acc["total"] + 1).alias("total"), (acc["code"] + one(~blank & ~comment)).alias("code"), (acc["comment"] + one(comment)).alias("comment"), (acc["blank"] + one(blank)).alias("blank"))

    return F.aggregate(T.lines(text), zero, step, lambda acc: F.struct(*[acc[c].alias(c) for c in LINE_COUNTS]))


def stats(tree: DataFrame, contents: DataFrame) -> DataFrame:
    """Per repository and language: files, bytes, share, and lines: exact for files with contents, for others estimated from
    their bytes by the language's own bytes a line, else by all languages', else by a default."""
    files = analyzed_files(classified(tree)).filter(F.col("language").isNotNull() & ~F.col("category").isin(*C.NOT_COUNTED)).select("repo_id", "path", "size", "language")
    # text stays where it is read: what is joined are line counts
    counted = contents.select("repo_id", "path", count_lines(F.col("text"), P.classified_language(F.col("path"))).alias("lines"))
    rows = files.join(counted, ["repo_id", "path"], "left")
    sampled = F.col("lines").isNotNull()
    by = rows.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(sampled).alias("sampled_files"),
        F.coalesce(F.sum(F.when(sampled, F.col("size"))), F.lit(0)).alias("sampled_bytes"), F.coalesce(F.sum(F.when(~sampled, F.col("size"))), F.lit(0)).alias("unsampled_bytes"),
        *[F.coalesce(F.sum(f"lines.{c}"), F.lit(0)).alias(f"{c}_lines") for c in LINE_COUNTS],
    )
    repo = W.partitionBy("repo_id")
    all_bytes, all_lines = F.sum("sampled_bytes").over(repo), F.sum("total_lines").over(repo)
    overall = F.when(all_lines > 0, all_bytes / F.when(all_lines > 0, all_lines)).otherwise(F.lit(float(C.BYTES_PER_LINE)))
    per_line = F.when(F.col("total_lines") > 0, F.col("sampled_bytes") / F.when(F.col("total_lines") > 0, F.col("total_lines"))).otherwise(F.col("overall"))
    guess = F.when((F.col("unsampled_bytes") > 0) & (per_line > 0), F.bround(F.col("unsampled_bytes") / F.when(per_line > 0, per_line))).otherwise(0).cast("long")
    out = by.withColumn("overall", overall).withColumn("estimated_lines", guess)
    whole = F.sum("bytes").over(repo)
    return out.select("repo_id", "language", P.language_kind(F.col("language")).alias("kind"), "files", "bytes", F.coalesce(F.lit(100.0) * F.col("bytes") / F.when(whole > 0, whole), F.lit(0.0)).alias("percent_of_bytes"), (F.col("total_lines") + F.col("estimated_lines")).alias("lines"), (F.col("estimated_lines") > 0).alias("lines_estimated"), "sampled_files", "code_lines", "comment_lines", "blank_lines")


def extensions(tree: DataFrame) -> DataFrame:
    ext = F.lower(P.suffix(F.col("path")))
    by = analyzed_files(classified(tree)).groupBy("repo_id", F.when(ext == "", "(none)").otherwise(ext).alias("extension")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return G.cap_per_group(by, ["repo_id"], [F.desc("files"), "extension"], C.TOP_EXTENSIONS)


def linguist_shares(given: DataFrame) -> DataFrame:
    """given(repo_id, language, bytes): shares of what the host counts; negative counts are left out."""
    return G.share_of_total(given.filter("bytes >= 0"), "bytes", ["repo_id"])
