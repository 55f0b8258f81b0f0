"""Document fingerprints by MinHash.

A fingerprint is FUNCTIONS minima of universal hash functions over a text's shingles of WORDS words, 16 bits each, as
hexadecimal digits; the share of equal minima estimates the Jaccard similarity. ``links`` joins signature bands in Spark and
verifies the similarity of what meets on full shingle sets; it tells every link, so a group of n near texts has n^2 / 2.
``link_numbers``, which the query of links uses, tells each document's class of equal sets and its number of links instead.

The query needs each document's successor by id: ids are cut into ranges at approximate quantiles, each range gets the
first document of the next one as a ghost row, and each range is streamed in order, so texts are shuffled once and there is
no global window. Ranges are of ids, so only rows that bear one and the same id could fill one.

Defined results: null text is empty; a text without words has the fingerprint of no minima, like to itself alone; rows of
one id follow each other by text; a null id comes last; an only row is its own successor; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash

WORDS = 5
FUNCTIONS = 128
LAST = -(2**63)


def texts_of(signatures: np.ndarray) -> list[str]:
    hexed = signatures.astype(">u2").tobytes().hex()
    n = signatures.shape[1] * 4
    return [hexed[i : i + n] for i in range(0, len(hexed), n)]


def fingerprint(texts: pa.Array, words: int = WORDS, functions: int = FUNCTIONS) -> np.ndarray:
    h, starts = minhash.shingled(texts, words)
    return minhash.signatures(h, starts, functions)


def fingerprints(docs: DataFrame, words: int = WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 1 << 20):
            prints = texts_of(fingerprint(batch.column("text"), words, functions))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def links(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """a < b, common, united: all verified pairs of near-equal texts, each class of equal shingle sets standing for itself by its
    smallest id. See dedup for how a large bucket is dealt to cells."""
    from . import dedup

    return dedup.every_link(docs, words, percent)


def link_numbers(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, class_id, n_links of every row: no link is lost, and none is a row."""
    from . import dedup

    return dedup.linked_classes(docs, words, percent)


def successors(docs: DataFrame) -> DataFrame:
    """Ranges of ids in descending order: rows (part, ghost, key, doc_id, text); a ghost is the next range's first row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST)))
    n = common.fan_out(docs)
    bounds = np.array(sorted({int(x) for x in rows.select("key").approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n)}), np.int64)

    @F.pandas_udf("int")
    def part_of(key):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(len(bounds) - np.searchsorted(bounds, key.to_numpy(np.int64), side="right"), dtype="int32")

    placed = rows.withColumn("part", part_of("key"))
    heads = sorted((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("key").alias("head")).collect())  # a row a range
    if not heads:
        return placed.withColumn("ghost", F.lit(0))
    after = [(part, heads[(i + 1) % len(heads)][1]) for i, (part, _) in enumerate(heads)]
    wanted = docs.sparkSession.createDataFrame(after, "part int, key long")
    ghosts = rows.join(F.broadcast(wanted), "key").groupBy("part", "key").agg(F.max("text").alias("text"))
    shape = ["part", "ghost", "key", "doc_id", "text"]
    whole = placed.withColumn("ghost", F.lit(0)).select(shape).union(ghosts.select("part", F.lit(1), "key", F.lit(None).cast("long"), "text"))
    return whole.repartitionByRange(max(1, len(heads)), "part").sortWithinPartitions("part", "ghost", F.desc("key"), F.desc("text"))


def edited_fingerprints(docs: DataFrame, words: int = WORDS, functions: int = FUNCTIONS) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and how like its fingerprint is to that and to its successor's."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in common.pieces(batches, "text", 1 << 20):
            batch = batch.select(["part", "ghost", "doc_id", "text"])
            whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            held = whole.slice(whole.num_rows - 1)
            if whole.num_rows < 2:
                continue
            texts, ghosts = whole.column("text").to_pylist(), whole.column("ghost").to_pylist()
            prints = fingerprint(whole.column("text"), words, functions)
            own = [i for i in range(whole.num_rows - 1) if not ghosts[i]]  # the last row waits for the next piece
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
            if not own:
                continue
            other = fingerprint(pa.array(edited, pa.large_string()), words, functions)
            mine, after = prints[own], prints[[i + 1 for i in own]]
            columns = [
                whole.column("doc_id").take(pa.array(own)),
                [len(texts[i]) for i in own],
                [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                texts_of(mine),
                texts_of(other),
                (mine == other).mean(1),
                (mine == after).mean(1),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return successors(docs).mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. Edge cases: see the module."""
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))


def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links, by banded signatures and verified similarity. Edge cases: see the module."""
    return link_numbers(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints, "op2_links": op2_links}
ORACLE: dict[str, str] = {}
