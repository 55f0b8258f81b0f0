"""Texts made to stall patterns, and documents whose further columns bear the names of helper columns."""

import re
import time

import pytest

import corpus_pipeline
from lodestrata.llm import common, media, secrets


@pytest.mark.parametrize("piece", ["a-", "a.", "1.", "-", ".", "a", "user=", "http://", "10.0.", "x.amazonaws.com", "token=", "A1/"])
def test_op4_reads_a_megabyte_in_linear_time(piece):
    text = "user=bob " + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    secrets.weak_parts(text, secrets.base_spans(text))
    assert time.perf_counter() - began < 3


def test_op4_hosts():
    for text, host in (("user=bob1 in s3.eu-1.amazonaws.com.", "s3.eu-1.amazonaws.com"), ("user=bob1 --b.amazonaws.com", "b.amazonaws.com"), ("user=bob1 a..b.amazonaws.com/x", "b.amazonaws.com"), ("user=bob1 x.amazonaws.com.cn", "x.amazonaws.com"), ("user=bob1 x.amazonaws.comb", None), ("user=bob1 .amazonaws.com", None)):
        found = [text[a:b] for k, a, b in secrets.weak_parts(text, []) if k == "endpoint"]
        assert found == ([host] if host else []), text


@pytest.mark.parametrize("piece", [b"OggS" + b"\0" * 23, b"GIF89a!\1\1\0\0\0\0!!\1a\0", b"GIF89a\1\0\1\0\0\0\0!\1\1", b"RIFF\x24\0\0\0WAVE", b"%PDF-1", b"PK\3\4", b"fLaC"])
def test_op8_reads_a_megabyte_in_linear_time(piece):
    find = media.automaton()
    began = time.perf_counter()
    media.sniffed(piece * (1_000_000 // len(piece)), find)
    assert time.perf_counter() - began < 3


def test_op8_pages_that_share_an_end():
    page = lambda flag, body: b"OggS\0" + bytes([flag]) + b"\0" * 20 + bytes([1, len(body)]) + body
    blob = b"xx" + page(2, b"one") + page(0, b"two") + page(4, b"end") + b"OggS" + page(4, b"z")
    find, marks = media.automaton(), media.Marks(blob)
    heads = [m.start() for m in re.finditer(b"OggS", blob)]
    ends = [media._ogg(blob, at, marks) for at in heads]
    assert ends == [media._ogg(blob, at, media.Marks(blob)) for at in heads]
    assert [x and x[1] + at for at, x in zip(heads, ends, strict=True)] == [95, 95, 95, None, len(blob)]
    assert media.sniffed(blob, find) == [("audio/ogg", 2, 93), ("audio/ogg", 99, 29)]


CLASHING = "_id _added _key _times _language _language_score _copies _rows _nth _copy _slice row_id node set_key n_shingles component_id kept size order_key rank source_size target copies base added piece length `x.y`".split()


def test_pipeline_carries_columns_of_any_name(spark, folder):
    docs = common.table(spark, folder, "documents").drop("score")
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name.strip("`"), docs.doc_id * 100 + i)
    docs = common.stored(docs.union(docs.limit(3)).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "text", "lang", "source", "n_chars", *CLASHING)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, docs, folder))
        assert after.columns == docs.columns, name
        docs = after
    rows = docs.select("doc_id", *CLASHING).collect()
    assert rows
    for r in rows:
        values = r[1:]
        assert values == tuple(values[0] + i for i in range(len(CLASHING)))
        assert r[0] is None or values[0] == r[0] * 100
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() >= len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
