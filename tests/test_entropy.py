"""Entropy against its definition, and in time that doesn't grow with the number of distinct characters."""

import math
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T


def test_entropy(spark):
    values = ["", "a", "aaaa", "abab", "abcd" * 5 + "é", "a\nb\n\n", "$^.*\\[", " \t ", "ß" * 3 + "漢字", "x" * 5000 + "y", None]
    got = {r.v: r.h for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", T.entropy(F.col("v")).alias("h")).collect()}
    for v in values[:-1]:
        assert got[v] == pytest.approx(-sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())), v
    assert got[None] is None


def test_entropy_of_many_distinct_characters(spark):
    values = [("".join(chr(0x4E00 + (i * 7919 + k) % 20000) for i in range(20000)),) for k in range(20)]
    df = spark.createDataFrame(values, "v string").select(T.entropy(F.col("v")).alias("h"))
    began = time.perf_counter()
    assert all(r.h == pytest.approx(math.log2(20000)) for r in df.collect())
    assert time.perf_counter() - began < 30
