"""Katz backoff language models over words, learned and evaluated in Spark.

Texts are cut into blocks of tokens, kept as a table. Each block sends its distinct n-grams, with their counts in learning
texts, to buckets by hash; a bucket adds up counts and answers each block in the order of its request, so an answer is a
number and no text or key travels back. A frequent n-gram is one entry a block, however often it occurs, and a context's
n-grams are spread over all buckets, so no key is hot. Summed n-grams are stored as tables partitioned by kind and order.

Counts up to MOST_DISCOUNTED are discounted by Good-Turing as Katz has it, d_r = (r*/r - q) / (1 - q) with
r* = (r + 1) n_(r+1) / n_r and q = (k + 1) n_(k+1) / n_1; where counts of counts are too thin for that, by 1/2. A context h
then keeps back 1 - D(h) / c(h), D being its discounted counts, and gives it to unseen words in proportion to the shorter
context's probability, divided by exactly the mass that this has on unseen words: the probabilities of all words and of one
unknown word add up to 1 after any context. The sums over seen words are gathered per context the same way, each n-gram
being added by one block, its owner. Where all counts of a context are too high to be discounted, one more count is
reserved, so that nothing is impossible. Probabilities are then evaluated per token from the shortest context up.

Defined results: null and empty texts are the end token alone; a null id is in no fold, so it is learned from; with nothing
to learn from every token has probability 1; repeated rows count repeatedly; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ORDER = 2
MOST_DISCOUNTED = 5
BLOCK_BYTES = 16 << 20
BUCKET_KEYS = 1_500_000
FOLDS, HELD = 7, 2

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes binary, vocabulary binary, tokens binary"
REQUESTS = "order int, bucket int, block long, keys binary, counts binary"
ANSWERS = "kind string, order int, bucket int, block long, keys binary, counts binary, of_counts array<long>, total long, distinct long"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, the highest planes left out as far as they are zero."""
    v = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    n = (len(data) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return out.view("<u8").ravel()


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, held) as rows of BLOCKS: words by hash, an end token after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            vocabulary, place = np.unique(np.concatenate([w[3] for w in waiting]), return_inverse=True)
            tokens, at = [], 0
            for w in waiting:
                tokens.append(place[at : at + len(w[3])][w[2]])
                at += len(w[3])
            row = {"block": block, "doc_ids": [i for w in waiting for i in w[0]], "held": [x for w in waiting for x in w[4]], "sizes": packed(np.concatenate([w[1] for w in waiting])), "vocabulary": packed_sorted(vocabulary), "tokens": packed(np.concatenate(tokens))}
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in common.pieces(batches, "text", 4 << 20):
            starts, index, words = common.flat_words(batch.column("text"))
            sizes = np.diff(starts) + 1
            local = np.empty(int(sizes.sum()), np.int64)
            ends = np.cumsum(sizes) - 1
            is_end = np.zeros(len(local), bool)
            is_end[ends] = True
            local[~is_end], local[is_end] = index, len(words)
            waiting.append((batch.column("doc_id").to_pylist(), sizes, local, np.append(common.hash_strings(words), END), batch.column("held").to_pylist()))
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield out()
                block, waiting, size = block + 1, [], 0
        if waiting:
            yield out()

    return docs.select("doc_id", "text", "held").mapInArrow(run, BLOCKS)


class Block:
    """A block's grams. keys(k) are the k-grams of all tokens; contexts(k) the (k-1)-grams before them."""

    def __init__(self, row: dict, order: int) -> None:
        self.order, self.doc_ids, self.held = order, row["doc_ids"], row["held"]
        self.sizes = unpacked(row["sizes"]).astype(np.int64)
        self.vocabulary = unpacked_sorted(row["vocabulary"])
        self.tokens = unpacked(row["tokens"]).astype(np.int64)
        self.learned = np.repeat(~np.array(self.held, bool), self.sizes)
        pad = order - 1
        first = np.cumsum(self.sizes) - self.sizes
        docs = np.arange(len(self.sizes))
        self.at = np.arange(len(self.tokens)) + pad * (np.repeat(docs, self.sizes) + 1)
        flat = np.full(len(self.tokens) + pad * len(docs), BEGIN, np.uint64)
        flat[self.at] = self.vocabulary[self.tokens]
        self.first, self.flat, self.grams = first, flat, {1: flat}
        for k in range(2, order + 1):
            before = np.full(len(flat), BEGIN, np.uint64)
            before[k - 1 :] = flat[: len(flat) - k + 1]
            self.grams[k] = common.mixed(self.grams[k - 1] * _STEP + before)

    def keys(self, k: int) -> np.ndarray:
        return self.grams[k][self.at]

    def contexts(self, k: int) -> np.ndarray:
        return self.grams[k - 1][self.at - 1]


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a position of each, which of them each position has)."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, bool)
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket's keys start: buckets are by the top bits."""
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def batches_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def gram_requests(stored: DataFrame, order: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, order)
                for k in range(1, order + 1):
                    if k == 1:
                        keys, counts = b.vocabulary, np.bincount(b.tokens[b.learned], minlength=len(b.vocabulary))
                    else:
                        keys, _, which = grouped(b.keys(k))
                        counts = np.bincount(which[b.learned], minlength=len(keys))
                    at = cuts(keys, bits)
                    for i in range(1 << bits):
                        if at[i] < at[i + 1]:
                            yield batches_of([(k, i, row["block"], packed_sorted(keys[at[i] : at[i + 1]]), packed(counts[at[i] : at[i + 1]]))], REQUESTS)

    return stored.mapInArrow(run, REQUESTS)


def summed_grams(requests: DataFrame) -> DataFrame:
    """Per order and bucket: a row of the model, and an answer to each block: twice the sum, plus 1 if it owns the n-gram."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        parts = [unpacked_sorted(r["keys"]) for r in rows]
        counts = np.concatenate([unpacked(r["counts"]) for r in rows]).astype(np.int64)
        keys = np.concatenate(parts)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        sums = np.add.reduceat(counts[order], first)
        has = counts[order] > 0
        rank = np.cumsum(has)
        owner = has & (rank - (rank[first] - has[first])[which] == 1)
        answer = np.empty(len(keys), np.int64)
        answer[order] = 2 * sums[which] + owner
        seen = sums > 0
        known = sums[seen]
        of_counts = np.bincount(np.minimum(known, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2].tolist()
        k, bucket = rows[0]["order"], rows[0]["bucket"]
        out: list[tuple] = [("model", k, bucket, None, packed_sorted(ordered[first][seen]), packed(known), of_counts, int(known.sum()), int(seen.sum()))]
        at = 0
        for r, p in zip(rows, parts, strict=True):
            out.append(("answer", k, bucket, r["block"], None, packed(answer[at : at + len(p)]), None, None, None))
            at += len(p)
        return pa.Table.from_batches([batches_of(out, ANSWERS)])

    return requests.groupBy("order", "bucket").applyInArrow(run, ANSWERS)


def discounts(of_counts: list[int]) -> np.ndarray:
    """d_0 .. d_k; a count above k is not discounted. Counts of counts that give no discounts between 0 and 1 as they are
    (copies of texts make some too many) are first smoothed by a line through their logarithms."""
    n, k = np.array([0, *of_counts], float), MOST_DISCOUNTED
    fitted = n
    if np.count_nonzero(n[1:]) > 1:
        r = np.flatnonzero(n)
        slope, level = np.polyfit(np.log(r), np.log(n[r]), 1)
        fitted = np.concatenate(([0.0], np.exp(level + slope * np.log(np.arange(1, k + 2)))))
    for m in (n, fitted):
        if not all(m[1:]):
            continue
        q = (k + 1) * m[k + 1] / m[1]
        if q < 1:
            d = np.array([0, *(((r + 1) * m[r + 1] / m[r] / r - q) / (1 - q) for r in range(1, k + 1))])
            if all(0 < x < 1 for x in d[1:]):
                return d
    return np.array([0, *((r - 0.5) / r for r in range(1, k + 1))])


class Model:
    """What the driver keeps: discounts by order, the learning tokens, distinct ones, and the unknown word's share."""

    def __init__(self, orders: dict[int, tuple[list[int], int, int]]) -> None:
        of_counts, self.tokens, self.distinct = orders.get(1, ([0] * (MOST_DISCOUNTED + 1), 0, 0))
        self.discounts = {k: discounts(v[0]) for k, v in orders.items()}
        lost = sum(n * r * (1 - self.discounts[1][r]) for r, n in enumerate(of_counts[:MOST_DISCOUNTED], 1)) if self.tokens else 0.0
        # without a rare word, one more token is reserved for the unknown one
        self.whole = self.tokens if lost > 0 else self.tokens + 1
        self.unknown = (lost if lost > 0 else 1.0) / self.whole

    def discounted(self, k: int, counts: np.ndarray) -> np.ndarray:
        d = self.discounts.get(k, np.ones(MOST_DISCOUNTED + 1))
        return counts * np.where(counts <= MOST_DISCOUNTED, d[np.minimum(counts, MOST_DISCOUNTED)], 1.0)


class Answers:
    """A block's answers by order: counts of grams, owned, and (whole, alpha) of contexts."""

    def __init__(self, rows: list[dict]) -> None:
        self.counts: dict[int, np.ndarray] = {}
        self.owned: dict[int, np.ndarray] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[tuple[str, int], list] = {}
        for r in sorted(rows, key=lambda r: r["bucket"]):
            by.setdefault((r["kind"], r["order"]), []).append(r["counts"])
        for (kind, k), parts in by.items():
            if kind == "answer":
                v = np.concatenate([unpacked(p) for p in parts]).astype(np.int64)
                self.counts[k], self.owned[k] = v >> 1, (v & 1).astype(bool)
            else:
                pairs = [np.frombuffer(p, np.float64).reshape(2, -1) for p in parts]
                self.contexts[k] = tuple(np.concatenate([p[i] for p in pairs]) for i in (0, 1))


def probabilities(b: Block, a: Answers, model: Model, upto: int) -> np.ndarray:
    """Each token's probability by contexts of up to upto - 1 words."""
    c = a.counts[1]
    p = np.where(c > 0, model.discounted(1, c) / model.whole, model.unknown)[b.tokens]
    for k in range(2, upto + 1):
        _, _, which = grouped(b.keys(k))
        _, _, context = grouped(b.contexts(k))
        count = a.counts[k][which]
        whole, alpha = (x[context] for x in a.contexts[k])
        # a context that was never seen leaves the shorter one's probability as it is: its alpha is 1
        p = np.where(count > 0, model.discounted(k, count) / np.maximum(whole, 1), alpha * p)
    return p


CONTEXTS = "order int, bucket int, block long, keys binary, counts binary, rare binary, mass binary"


def with_answers(stored: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:  # noqa: ANN001
    """run(block row, its answers) over all blocks."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches([run(row, Answers(right.to_pylist())) for row in left.to_pylist()], schema=run(None, None).schema)

    mine = answers.filter("kind <> 'model'").select("kind", "order", "bucket", "block", "counts")
    return stored.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(both, schema)


def context_requests(stored: DataFrame, answers: DataFrame, model: Model, k: int, order: int, bits: int) -> DataFrame:
    """Per context, over the n-grams that a block owns: their counts, how many have each low count, and the probability
    that the shorter context gives their words."""

    def run(row: dict | None, a: Answers | None) -> pa.RecordBatch:
        if row is None or a is None:
            return batches_of([], CONTEXTS)
        b = Block(row, order)
        lower = probabilities(b, a, model, k - 1)
        _, position, _ = grouped(b.keys(k))
        keys, _, context = grouped(b.contexts(k))
        own = a.owned[k]
        at, n = context[position[own]], a.counts[k][own]
        counts = np.bincount(at, n, len(keys)).astype(np.int64)
        rare = np.stack([np.bincount(at[n == r], minlength=len(keys)) for r in range(1, MOST_DISCOUNTED + 1)])
        mass = np.bincount(at, lower[position[own]], len(keys))
        edge = cuts(keys, bits)
        rows = []
        for i in range(1 << bits):
            s = slice(edge[i], edge[i + 1])
            if edge[i] < edge[i + 1]:
                rows.append((k, i, row["block"], packed_sorted(keys[s]), packed(counts[s]), packed(rare[:, s].ravel()), mass[s].tobytes()))
        return batches_of(rows, CONTEXTS)

    return with_answers(stored, answers, run, CONTEXTS)


def summed_contexts(requests: DataFrame, model: Model) -> DataFrame:
    """Per order and bucket: the contexts' rows of the model (whole count and alpha), and each block's."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        parts = [unpacked_sorted(r["keys"]) for r in rows]
        k = rows[0]["order"]
        keys, which = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(which, np.concatenate([unpacked(r["counts"]) for r in rows]), len(keys))
        rare = np.concatenate([unpacked(r["rare"]).reshape(MOST_DISCOUNTED, -1) for r in rows], 1)
        d = model.discounts.get(k, np.ones(MOST_DISCOUNTED + 1))
        lost = sum(r * (1 - d[r]) * np.bincount(which, rare[r - 1], len(keys)) for r in range(1, MOST_DISCOUNTED + 1))
        mass = np.bincount(which, np.concatenate([np.frombuffer(r["mass"], np.float64) for r in rows]), len(keys))
        seen = counts > 0
        whole = np.where(lost > 0, counts, counts + 1)  # at least a count is kept back for unseen words
        kept_back = np.where(lost > 0, lost, 1.0) / np.maximum(whole, 1)
        alpha = np.where(seen, kept_back / np.maximum(1 - mass, 1e-12), 1.0)
        out: list[tuple] = [("model", k, rows[0]["bucket"], None, packed_sorted(keys[seen]), np.stack([whole[seen], alpha[seen]]).tobytes(), None, None, None)]
        at = 0
        for r, p in zip(rows, parts, strict=True):
            own = which[at : at + len(p)]
            out.append(("context", k, rows[0]["bucket"], r["block"], None, np.stack([whole[own], alpha[own]]).tobytes(), None, None, None))
            at += len(p)
        return pa.Table.from_batches([batches_of(out, ANSWERS)])

    return requests.groupBy("order", "bucket").applyInArrow(run, ANSWERS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Scores of docs(doc_id, text, held) by a model learned from the rows that are not held."""
    spark = docs.sparkSession
    stored = common.stored(blocks(docs))
    sizes = stored.agg(F.sum(F.size("doc_ids")).alias("docs"), F.sum(F.octet_length("tokens")).alias("bytes")).first()
    bits = max(1, int(np.ceil(np.log2(max(2, (sizes["bytes"] or 1) / 3 / BUCKET_KEYS)))))
    answers = common.stored(summed_grams(gram_requests(stored, order, bits)), "kind", "order")
    tally = answers.filter("kind = 'model'").groupBy("order").agg(*[F.sum(F.col("of_counts")[i]).alias(f"n{i}") for i in range(MOST_DISCOUNTED + 1)], F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    model = Model({r["order"]: ([int(r[f"n{i}"] or 0) for i in range(MOST_DISCOUNTED + 1)], int(r["total"] or 0), int(r["distinct"] or 0)) for r in tally.collect()})  # a row an order
    common.release(spark)
    for k in range(2, order + 1):
        more = common.stored(summed_contexts(context_requests(stored, answers, model, k, order, bits), model), "kind", "order")
        answers = answers.union(more.select(answers.columns))
        common.release(spark)

    def run(row: dict | None, a: Answers | None) -> pa.RecordBatch:
        if row is None or a is None:
            return batches_of([], SCORES)
        b = Block(row, order)
        c = a.counts[1][b.tokens]
        base = np.log10((c + 1) / (model.tokens + model.distinct + 1))
        score = np.log10(probabilities(b, a, model, order))
        known = (c > 0).astype(np.int64)
        columns = [np.add.reduceat(x, b.first) for x in (known, base, score)]
        rows = list(zip(b.doc_ids, b.held, b.sizes.tolist(), columns[0].tolist(), [model.tokens] * len(b.doc_ids), columns[1].tolist(), columns[2].tolist(), strict=True))
        return batches_of(rows, SCORES)

    return with_answers(stored, answers, run, SCORES)


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold. Edge cases: see the module."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), (common.remainder("doc_id", FOLDS) == HELD).alias("held")))


QUERIES = {"op1_lm": op1_lm}
ORACLE: dict[str, str] = {}
