"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The histogram has at most `capacity` lengths whatever the input's size, so the program is solved on the driver: minimise
the number of sequences, a configuration being a multiset of lengths that fits into one. In every round a knapsack dynamic program
over the capacity finds, at the current prices, the most valuable configuration that holds each length, and these join the
columns. Multiplicative weights then scale each column's use by what
a sequence of it is worth: the sum over its tokens of how much their length still lacks, 1 where demand is met exactly. So
columns with gaps shrink, and lengths in want raise both their columns' use and, by their price, the next round's columns.

Rounding takes whole multiples of all columns, fullest first; best fit packs only what that leaves. Where the result misses the
lower bound (`least`, from the lengths above half of the capacity), the program is solved again for what is left, and then once
more from the start with the columns of best fit among its own. Best fit alone is the last check: its plan is taken only if it
has fewer sequences than every program's. No step depends on how many pieces there are.
Pieces are then dealt to places by their rank within their length; ranks come from counts per (length, slice).

Defined results: null and empty texts are one piece of the end id alone; documents longer than a sequence are cut, the first
piece being the shorter one; repeated rows are packed each on its own; an empty table gives no sequence.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END = 0
#: Rounds of pricing, of weights after each, and programs solved one after another for what rounding leaves.
ROUNDS, UPDATES, PROGRAMS = 12, 60, 3
#: How much more than in proportion a long piece is worth at first; the power of a length's want in its price and in weights.
TILT, WANT, STEP = 0.02, 0.5, 1.5
#: Slices of a length, at least; beyond so many rows of one length there are more.
SLICES, SLICE_ROWS = 64, 1 << 18
#: Bytes of text encoded at once.
PIECE = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    """The vocabulary file beside the installed tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def byte_pairs(path: str):  # noqa: ANN201
    """The byte-level vocabulary of a tokenizer file as an encoder with the file's added tokens, and each token's length in bytes.

    The file's ids are the ranks of its merges, so the same pairs are merged in the same order; tests hold the ids against
    those of `tokenizers`.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, added = file["model"]["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in added and all(c in byte_of for c in token)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), sizes


class Encoder:
    """Token ids of texts, each distinct chunk of a batch encoded once.

    A chunk is what lies between two single spaces, with the space before it. The vocabulary's pre-tokenizer never joins a
    space to what precedes it, so chunks can be encoded apart wherever the next one begins with neither white space nor the
    text's end; texts where this doesn't hold, and those with an added token's string, are encoded whole. For the same reason all chunks with a space are encoded in
    one go and told apart by the tokens' lengths in bytes.
    """

    def __init__(self, path: str) -> None:
        self.pairs, self.sizes = byte_pairs(path)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.pairs.encode(t, allowed_special="all"), np.uint32) for t in texts]

    def chunked(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, starts) of chunks that begin with a space."""
        ids = self.pairs.encode_to_numpy("".join(chunks.to_pylist())).astype(np.uint32) if len(chunks) else np.zeros(0, np.uint32)
        ends = np.cumsum(pc.binary_length(chunks).to_numpy().astype(np.int64))
        return ids, np.concatenate(([0], np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, row starts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, " ")
        flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        first = np.zeros(len(flat), bool)
        first[starts[:-1]] = True
        odd = pc.match_substring_regex(flat, r"^(?:$|[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}])").to_numpy(zero_copy_only=False) & ~first
        whole = np.add.reduceat(odd, starts[:-1]) > 0 if len(flat) else np.zeros(len(texts), bool)
        for token in self.pairs.special_tokens_set:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        inner = flat.filter(pa.array(~first & ~np.repeat(whole, np.diff(starts)))).dictionary_encode()
        ids, at = self.chunked(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), inner.dictionary, pa.scalar(" ", pa.large_string())))
        heads = iter(self.encoded([t.as_py() for t in flat.take(pa.array(starts[:-1][~whole]))]))
        slow = iter(self.encoded([texts[i].as_py() for i in np.flatnonzero(whole)]))
        index = inner.indices.to_numpy().astype(np.int64)
        n = at[index + 1] - at[index]
        ends = np.cumsum(n)
        gathered = ids[np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - at[index], n)]
        per_text = np.where(whole, 0, np.diff(starts) - 1)
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(per_text)))]
        rows = [x for i in range(len(texts)) for x in ((next(slow),) if whole[i] else (next(heads), gathered[cuts[i] : cuts[i + 1]]))]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        parts = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(np.where(whole, 1, 2))))]
        return (np.concatenate(rows) if rows else np.zeros(0, np.uint32)), parts


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, crc: bool = True) -> DataFrame:
    """A row a piece: doc_id, piece, start, length and the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in common.pieces(common.gathered(batches, "text", PIECE), "text", PIECE):
            ids, starts = encoder.batch(batch.column("text"))
            rows = []
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[starts[i] : starts[i + 1]], np.uint32(end)).astype("<u4")
                head = len(own) % capacity or capacity
                bounds = [0, *range(head, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
                rows += [(key, k, a, b - a, zlib.crc32(own[a:b].tobytes()) if crc else 0) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best[c]: the greatest value of lengths that fits into c; last[c]: the length added to reach it, at[c] <= c."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth, upto = value[lengths], np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            v = worth[:n] + best[c - lengths[:n]]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], last[c] = v[k], lengths[k]
    return best, last, np.maximum.accumulate(np.where(last > 0, np.arange(capacity + 1), 0))


def traced(last: np.ndarray, at: np.ndarray, c: int) -> list[int]:
    out = []
    while c := int(at[c]):
        out.append(int(last[c]))
        c -= int(last[c])
    return out


Config = tuple[tuple[int, int], ...]


def shape(lengths: list[int]) -> Config:
    return tuple(sorted(Counter(lengths).items(), reverse=True))


def gap(config: Config, capacity: int) -> int:
    return capacity - sum(length * a for length, a in config)


class Columns:
    """The program's columns as (length, column, times) triples, and how often each is used."""

    def __init__(self) -> None:
        self.place: dict[Config, int] = {}
        self.uses: list[float] = []
        self.length: list[int] = []
        self.column: list[int] = []
        self.times: list[int] = []

    def add(self, config: Config, use: float) -> None:
        if config not in self.place:
            self.place[config] = len(self.uses)
            self.uses.append(use)
            for length, a in config:
                self.length.append(length)
                self.column.append(self.place[config])
                self.times.append(a)

    def weighed(self, need: np.ndarray, capacity: int, updates: int) -> np.ndarray:
        """Updates the uses by multiplicative weights; what each length lacks then: its demand by what covers it."""
        length, column, times = np.array(self.length), np.array(self.column), np.array(self.times, float)
        uses = np.array(self.uses)

        def lack() -> np.ndarray:
            covered = np.bincount(length, times * uses[column], capacity + 1)
            return np.where(need > 0, need / np.maximum(covered, 1e-9), 1.0)

        for _ in range(updates):
            uses *= np.bincount(column, times * length / capacity * lack()[length], len(uses)) ** STEP
        self.uses = uses.tolist()
        return lack()


def solve(left: np.ndarray, capacity: int, start: list[tuple[Config, int]], rounds: int = ROUNDS) -> tuple[Columns, float]:
    """The program's columns with their uses, and a lower bound for the number of sequences from the rounds' prices."""
    need, live = left.astype(float), np.flatnonzero(left)
    size = np.arange(capacity + 1) / capacity
    columns, bound, price = Columns(), 0.0, size * (1 + TILT * size)
    for config, times in start:
        columns.add(config, float(times))
    for n in range(1, rounds + 1):
        best, last, at = knapsack(price, live, capacity)
        bound = max(bound, float(need @ price) / best[capacity])
        for length in live[::-1].tolist():
            config = shape([length, *traced(last, at, capacity - length)])
            columns.add(config, 0.2 * need[length] / dict(config)[length] / n)
        lack = columns.weighed(need, capacity, UPDATES)
        price = size * (1 + TILT * size) * np.clip(lack, 0.5, 2.0) ** WANT
    return columns, bound


def fill(left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Best fit decreasing on a histogram, in whole multiples of a configuration: the longest length left is joined by the
    fullest set of what is left, found by the longest that fits next, and the set is used as often as it can be."""
    out = []
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            config, room, rest = [length], capacity - length, left.copy()
            rest[length] -= 1
            while room > 0:
                below = np.flatnonzero(rest[: room + 1] > 0)
                if not len(below):
                    break
                pick = int(below[-1])
                # two that fill the room exactly are better than one that leaves a gap
                if pick < room:
                    pairs = below[rest[np.clip(room - below, 0, capacity)] > 0]
                    pairs = pairs[(room - pairs != pairs) | (rest[pairs] > 1)]
                    pick = int(pairs[-1]) if len(pairs) else pick
                config.append(pick)
                rest[pick] -= 1
                room -= pick
            found = shape(config)
            times = int(min(left[x] // a for x, a in found))
            for x, a in found:
                left[x] -= a * times
            out.append((found, times))
    return out


def histogram(counts: dict[int, int], capacity: int) -> np.ndarray:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    return left


def least(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound for the number of sequences: for each k, pieces above capacity - k are alone, other ones above half of it
    each need a sequence of their own, and those from k to half fill at best the room that these leave."""
    n = histogram(counts, capacity)
    size = n * np.arange(capacity + 1)
    half, out = capacity // 2, 0
    for k in range(half + 1):
        middle = n[half + 1 : capacity - k + 1].sum()
        small = size[max(k, 1) : half + 1].sum() - (middle * capacity - size[half + 1 : capacity - k + 1].sum())
        out = max(out, int(n[capacity - k + 1 :].sum() + middle + max(0, -(-small // capacity))))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Whole configurations that hold every piece exactly once."""
    number = lambda configs: sum(n for _, n in configs)
    whole, bound = histogram(counts, capacity), least(counts, capacity)
    alone = fill(whole.copy(), capacity)
    best: list[tuple[Config, int]] | None = None
    for start in ([], alone):
        left, out, columns_of = whole.copy(), [], start
        for _ in range(PROGRAMS):
            if not left.any():
                break
            columns, _ = solve(left, capacity, columns_of, rounds)
            out += rounded(columns, left, capacity)
            rest = fill(left.copy(), capacity)
            if best is None or number(out) + number(rest) < number(best):
                best = out + rest
            if number(best) <= bound:
                return best
            columns_of = rest if start else []
    return best if best is not None and number(best) <= number(alone) else alone


def rounded(columns: Columns, left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    """Whole multiples of the columns' uses, fullest first, taken off left."""
    out = []
    for config, use in sorted(zip(columns.place, columns.uses, strict=True), key=lambda x: (gap(x[0], capacity), -x[0][0][0], x[0])):
        whole = int(min(use, *(left[x] // a for x, a in config)))
        if whole > 0:
            out.append((config, whole))
            for x, a in config:
                left[x] -= a * whole
    return out


def places(configs: list[tuple[Config, int]]) -> pd.DataFrame:
    """Rows (length, first, upto, sequence, per, nth, offset): pieces of a length with rank first <= r < upto lie in
    sequence + (r - first) at offset."""
    rows, first, sequence = [], {}, 0
    for config, times in configs:
        offset = 0
        for length, a in config:
            for _ in range(a):
                at = first.get(length, 0)
                rows.append((length, at, at + times, sequence, offset))
                first[length] = at + times
                offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "upto", "sequence", "offset"])


def ranked(cuts: DataFrame, slices: int = SLICES) -> DataFrame:
    """cuts with rank (from 0) within their length, a window never spanning more than a slice of a length."""
    rows = cuts.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    counted = rows.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = counted.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    nth = F.row_number().over(W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("_nth", nth).join(starts, ["length", "_slice"]).withColumn("rank", F.col("_start") + F.col("_nth")).drop("_slice", "_start", "_nth")


def packed(cuts: DataFrame, capacity: int = CAPACITY, solver: Callable[..., list] = plan) -> DataFrame:
    """cuts(doc_id, piece, length, ids_crc32, ...) with sequence_id and offset. Pass a stored table: it is read twice."""
    counts = {int(r["length"]): int(r["n"]) for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    table = places(solver(counts, capacity)).astype("int64")
    by_length: dict[int, tuple[np.ndarray, ...]] = {int(k): tuple(g.sort_values("first")[c].to_numpy() for c in ("first", "sequence", "offset")) for k, g in table.groupby("length")}
    shared = cuts.sparkSession.sparkContext.broadcast(by_length)  # as many rows as configurations: by capacity, not by pieces
    keep = [c for c in cuts.columns if c not in ("sequence_id", "offset")]
    slices = max(SLICES, -(-max(counts.values(), default=0) // SLICE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                own = length == k
                first, start, at = shared.value[int(k)]
                i = np.searchsorted(first, rank[own], side="right") - 1
                sequence[own], offset[own] = start[i] + rank[own] - first[i], at[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    shape_of = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema if f.name in keep)
    return ranked(cuts, slices).select(*keep, "rank").mapInArrow(run, f"{shape_of}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most CAPACITY tokens. Edge cases: see the module."""
    cuts = common.stored(cut(common.table(spark, sf_dir, "documents"), tokenizer_path()))
    return packed(cuts)


QUERIES = {"op3_packing": op3_packing}
ORACLE: dict[str, str] = {}
