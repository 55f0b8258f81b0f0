"""Text functions as columns, with the meaning that Python's string methods have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import once

# Characters at which str.splitlines() breaks, and those that str.strip() removes.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WORD = r"[A-Za-z0-9][\p{L}\p{N}_'-]*"


def lines(text: Column) -> Column:
    """str.splitlines(): no empty element after a last line break."""
    less = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return once(F.split(text, LINE_BREAK), less)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def newline_count(text: Column) -> Column:
    """text.count(newline) + 1."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty string. Sorted, equal characters are one run."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(chars), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    share = lambda run, n: F.length(run).cast("double") / n
    summed = lambda x: -F.aggregate(x["runs"], F.lit(0.0), lambda acc, run: acc + share(run, x["n"]) * F.log2(share(run, x["n"])))
    # one element, so that runs and their number of characters are found once a value
    return F.get(F.transform(F.array(F.struct(runs.alias("runs"), F.size(chars).cast("double").alias("n"))), summed), F.lit(0))


def redact(secret: Column) -> Column:
    """First four characters of what is longer than eight, stars, and the length."""
    return F.concat(F.when(F.length(secret) > 8, F.substring(secret, 1, 4)).otherwise(""), F.lit("********("), F.length(secret).cast("string"), F.lit(" chars)"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def url_path(url: Column) -> Column:
    """Host and path of an http(s) URL, as a path; without query and fragment."""
    return F.regexp_extract(url, "^https?://([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#:]*)", 1)


def clean(text: Column, limit: int = 200) -> Column:
    """Control characters as spaces, cut to limit."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), 1, limit)


def percent_decode(text: Column) -> Column:
    """Percent-decoding in which a plus stays one."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def normalized(path: Column) -> Column:
    """'.' and '..' folded; leading '..' beyond the root are kept."""
    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    step = lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, s))
    empty = F.array().cast("array<string>")
    return F.aggregate(parts, empty, lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(step(acc, s)), lambda acc: F.array_join(acc, "/"))
