"""Language identification with language-bitmask n-gram filters.

Character n-grams of all learning texts are counted per language. An n-gram enters a language's filter if it is frequent
there and not rare against the language that uses it most. The filters of all languages lie bit-sliced in one array: a slot
holds one bit a language, an n-gram sets its language's bit in HASHES slots, and the AND of these slots gives at once every
language that may contain the n-gram. A text's hits per language are popcounts over its n-grams, corrected for the filter's
false positives; the language with most hits wins, ties going to the first by name.

The array's size is a parameter (SLOTS words of 63 languages), so it may be collected and broadcast at any input size. As a
language's frequencies sum to 1, no filter holds more than ORDERS / LEAST_SHARE n-grams.

Defined results: null text or text without a letter gives ``und`` with score 0, as does any text if nothing was learned;
learning skips null texts and null languages; repeated rows count repeatedly; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDERS = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 3
LEAST_SHARE = 2e-5
#: Against the share in the language that uses an n-gram most.
LEAST_RATIO = 0.2
PER_WORD = 63
#: Distinct words whose n-grams are held at once.
PORTION = 1 << 14
FOLDS, HELD = 5, 0

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of each word's letter runs, a run between two marks: hashes, and the word of each."""
    points = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    points = np.where(letters()[points], points, 32).astype(np.uint64)
    space = points == 32
    hashes, owners = [], []
    for n in ORDERS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + points[k : k + m]
        good = owner[:m] == owner[n - 1 :]
        for k in range(1, n - 1):
            good &= ~space[k : k + m]
        good &= ~(space[:m] & space[n - 1 :]) if n > 2 else ~(space[:m] & space[1:])
        hashes.append(common.mixed(h[good]))
        owners.append(owner[:m][good])
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of docs(text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, n = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in common.pieces(batches, "text", 2 << 20):
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                _, index, words = common.flat_words(lowered(texts), lower=False)
                times = np.bincount(index, minlength=len(words))
                for start in range(0, len(words), PORTION):
                    h, owner = grams(words[start : start + PORTION].to_pylist())
                    part = summed(h, times[start : start + PORTION][owner].astype(np.int64))
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                    if len(held[lang]) > 4:
                        held[lang] = [summed(np.concatenate([p[0] for p in held[lang]]), np.concatenate([p[1] for p in held[lang]]))]
                        size = sum(len(p[0]) for ps in held.values() for p in ps)
            if size > 1_000_000:  # bounds memory; the sums are added up later
                yield from out()
                held, size = {}, 0
        yield from out()
        held.clear()
        common.trim()

    rows = docs.filter("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """HASHES slots of each hash, by double hashing."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) % np.uint64(slots)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    """langs by name; array[slot, word]: bit j of word w is of language w * PER_WORD + j; false: false positives' share."""

    langs: list[str]
    array: np.ndarray
    false: np.ndarray


def fit(docs: DataFrame, slots: int = SLOTS, least_share: float = LEAST_SHARE, least_ratio: float = LEAST_RATIO) -> Filters:
    """Learns from the text and lang of all rows of docs."""
    counts = common.stored(gram_counts(docs))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in totals.select("lang").collect())  # a row a language
    words = max(1, -(-len(langs) // PER_WORD))
    array = np.zeros((slots, words), np.int64)
    if langs:
        shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
        most = shares.groupBy("gram").agg(F.max("share").alias("most"))
        kept = shares.filter(F.col("share") >= least_share).join(most, "gram").filter(F.col("share") >= least_ratio * F.col("most"))
        index = F.element_at(F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))]), F.col("lang"))
        placed = kept.select("gram", index.alias("i"))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                h, i = pdf["gram"].to_numpy(np.int64).view(np.uint64), pdf["i"].to_numpy()
                for p in places(h, slots):
                    yield pd.DataFrame({"slot": p, "word": i // PER_WORD, "mask": np.int64(1) << (i % PER_WORD).astype(np.int64)})

        bits = placed.mapInPandas(run, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
        found = bits.toPandas()  # slots x words at most
        array[found["slot"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    fill = np.array([np.count_nonzero((array[:, j // PER_WORD] >> (j % PER_WORD)) & 1) / slots for j in range(len(langs))])
    common.discard(counts)
    return Filters(langs, array, fill**HASHES)


def hits(words: list[str], filters: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Per word: its n-grams, and how many of them each language may contain."""
    n, out = np.zeros(len(words)), np.zeros((len(words), len(filters.langs)))
    for start in range(0, len(words), PORTION):
        part = words[start : start + PORTION]
        h, owner = grams(part)
        here = slice(start, start + len(part))
        n[here] = np.bincount(owner, minlength=len(part))
        masks = filters.array[(p := places(h, len(filters.array)))[0]]
        for q in p[1:]:
            masks = masks & filters.array[q]
        for j in range(len(filters.langs)):
            out[here, j] = np.bincount(owner, weights=(masks[:, j // PER_WORD] >> (j % PER_WORD)) & 1, minlength=len(part))
    return n, out


def detected(texts: pa.Array, filters: Filters) -> tuple[list[str], np.ndarray]:
    starts, index, words = common.flat_words(lowered(texts), lower=False)
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    if not len(words) or not filters.langs:
        return names, scores
    n, per_word = hits(words.to_pylist(), filters)
    before = lambda x: np.concatenate(([0], np.cumsum(x[index])))
    count = (c := before(n))[starts[1:]] - c[starts[:-1]]
    total = np.stack([(c := before(per_word[:, j]))[starts[1:]] - c[starts[:-1]] for j in range(len(filters.langs))], 1)
    corrected = np.clip((total - count[:, None] * filters.false) / (1 - np.minimum(filters.false, 0.999)), 0, None)
    best = corrected.argmax(1)
    for i in np.flatnonzero(count):
        names[i], scores[i] = filters.langs[best[i]], min(1.0, corrected[i, best[i]] / count[i])
    return names, scores


def detect(docs: DataFrame, filters: Filters, outputs: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score in place of columns of the outputs' names."""
    keep = [c for c in docs.columns if c not in outputs]
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # SLOTS x words x 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 2 << 20):
            names, scores = detected(batch.column("text").cast(pa.string()), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores)], names=[*keep, *outputs])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.DoubleType())])
    return docs.select(*keep).mapInArrow(run, schema)


LEAST_SCORE = 0.25


@common.fenced
def accepted(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs with a detected language, learned from the lang of those outside the held-out fold. Rejected are
    texts without letters and those of whose n-grams less than least_score are known to the language found."""
    filters = fit(docs.filter(common.remainder("doc_id", FOLDS) != HELD).select("text", "lang"))
    found = detect(docs, filters, ("_language", "_language_score"))
    return found.filter((F.col("_language") != "und") & (F.col("_language_score") >= least_score)).select(docs.columns)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold. Edge cases: see the module."""
    docs = common.table(spark, sf_dir, "documents")
    filters = fit(docs.filter(common.remainder("doc_id", FOLDS) != HELD).select("text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.remainder("doc_id", FOLDS) == HELD).alias("held_out"), F.col("text").cast("string").alias("text"))
    return detect(rows, filters).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language": op7_language}
ORACLE: dict[str, str] = {}
