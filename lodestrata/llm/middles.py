"""Fill-in-the-middle: documents cut into prefix, middle and suffix, whose order is changed so that a model learns to fill in.

Where code points begin in the concatenated UTF-8 buffer of a batch is a packed bit vector. A directory holds the number of
set bits before each block of 512 bits and, within the block, before each of its 64-bit words, so rank (set bits before a
byte) takes one popcount and select (the byte of the i-th code point) one search in the directory and six halvings of a word.
A document's code points are the difference of two ranks; its two cuts are selected by rank, all documents of a batch at once.

Cuts and form come from a hash of the id alone, so a rerun and a lost executor change nothing. Row-local: no shuffle, a
batch's texts are all that is held.

Defined results: a null text counts as empty; empty texts, and those that hold one of the marks, stay plain; a null id hashes
as an empty one; repeated rows repeat; other columns are ignored, whatever their names; very long texts are cut whole; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100: documents from PLAIN on stay plain; of the others, those below SPM have the suffix first.
PLAIN, SPM = 90, 20
SEED = 1
#: Text cut at once, in bytes.
HELD = 4 << 20
BLOCK = 512


class Boundaries:
    """Rank and select over the bytes of a UTF-8 buffer at which code points begin."""

    def __init__(self, buffer: np.ndarray):
        self.size = len(buffer)
        blocks = self.size // BLOCK + 1
        packed = np.zeros(blocks * BLOCK // 8, np.uint8)
        bits = np.packbits((buffer & 0xC0) != 0x80, bitorder="little")
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64).reshape(blocks, -1)
        within = np.cumsum(counts, axis=1)
        self.before = np.concatenate(([0], np.cumsum(within[:, -1])))
        self.within = np.concatenate((np.zeros((blocks, 1), np.int64), within[:, :-1]), axis=1).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Code points that begin before each byte position of 0..size."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at // BLOCK] + self.within.reshape(-1)[word] + np.bitwise_count(self.words[word] & low).astype(np.int64)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte at which the nth code point begins, from 0; the buffer's size for the first that isn't there."""
        past = nth >= self.before[-1]
        nth = np.where(past, 0, nth)
        block = np.searchsorted(self.before, nth, side="right") - 1
        block = np.minimum(block, len(self.within) - 1)
        left = nth - self.before[block]
        step = (self.within[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.within[block, step]
        word = self.words[block * (BLOCK // 64) + step]
        bit = np.zeros(len(nth), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= low
            left = np.where(up, left - low, left)
            word = np.where(up, word >> np.uint64(half), word)
            bit += np.where(up, half, 0)
        return np.where(past, self.size, (block * (BLOCK // 64) + step) * 64 + bit)


def draws(seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, marked, h1..h4) to (doc_id, n, form, prefix_chars, middle_chars, output)."""
    marks = {"p": PREFIX.encode(), "s": SUFFIX.encode(), "m": MIDDLE.encode()}
    for batch in common.pieces(batches, "text", HELD):
        texts = batch.column("text").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at, buffer = at - at[0], np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]]
        points = Boundaries(buffer)
        ranks = points.rank(at)
        first, n = ranks[:-1], np.diff(ranks)
        h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
        a, b = h1 % (n + 1), h2 % (n + 1)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        low, high = points.select(first + lo), points.select(first + hi)
        marked = batch.column("marked").to_numpy(zero_copy_only=False)
        plain = (n == 0) | marked | (h3 % 100 >= PLAIN)
        spm = h4 % 100 < SPM
        whole, out = memoryview(buffer), []
        for i in range(len(texts)):
            start, x, y, end = at[i], low[i], high[i], at[i + 1]
            if plain[i]:
                out.append(bytes(whole[start:end]))
                continue
            prefix, middle, suffix = whole[start:x], whole[x:y], whole[y:end]
            parts = (marks["s"], suffix, marks["p"], prefix) if spm[i] else (marks["p"], prefix, marks["s"], suffix)
            out.append(b"".join((*parts, marks["m"], middle)))
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(lo, mask=plain), pa.array(hi - lo, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def transformed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = docs.select("doc_id", text.alias("text"), marked.alias("marked"), *draws(seed))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. No mark occurs in the text or can arise where parts meet, so the first
    occurrence of each is its own."""

    def between(begin: str, end: str) -> Column:
        start = F.locate(begin, output) + len(begin)
        return F.substr(output, start, F.locate(end, output) - start) if end else F.substr(output, start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, ""), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, ""), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, with digests of its output and of the text restored from it. Edge cases: see the module."""
    rows = transformed(common.table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def _oracle() -> str:
    draw = ", ".join(f"CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
b AS (SELECT doc_id, t, length(t) AS n, {draw} FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR {marked} OR h3 % 100 >= {PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM b),
e AS (SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM e
"""


QUERIES = {"op13_middles": op13_middles}
ORACLE = {"op13_middles": _oracle()}
