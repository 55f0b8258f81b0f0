"""MinHash near-duplicates with sequential Bayesian verification.

Texts with one shingle set form a class, which stands in all later steps as its smallest id. Signatures of BANDS x ROWS
minima are banded. Candidates are compared batch by batch of minima; under a uniform prior the number of equal minima gives
a posterior of the similarity, and a candidate is dropped once the posterior that it reaches the threshold is below MISS.
Survivors are verified on full shingle sets, made anew from whole texts.

No pairs are made within a bucket as such. First each member meets the bucket's smallest one (a star: as many pairs as
rows). Links so found are joined into components; a bucket within one component is done. In the others, members of
different components are compared by signature in cells of at most two chunks of CHUNK members, so no task holds a large
bucket. What leaves a cell is not pairs but its members that have a candidate; their texts are sent to the cell, where all
candidates are verified at once on full sets, and a link for each two components joined is told. A pair within a component
needs no decision, as it can't change the components.

A star's smallest member, which may have as many partners as there are rows, is sent once to each few hundred of them.

The signature's chance to miss a pair is (1 - s^ROWS)^BANDS, 3e-6 at a similarity of 0.8, plus at most MISS over all batches.

Defined results: null texts and texts without words have empty sets, are linked with nothing and are kept; rows that bear
one id count as one document; a null id is linked with nothing, has a null component and is kept; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, minhash

WORDS, PERCENT = 5, 80
BANDS, ROWS = 24, 4
BATCH, MISS = 16, 1e-4
CHUNK = 400
#: Rows with an id and a word; all others are linked with nothing.
IN_A_SET = "set_key is not null and doc_id is not null"
#: Pairs compared at once.
PORTION = 50_000


def bounds(n: int, threshold: float, tail: float) -> list[int]:
    """For each multiple of BATCH up to n minima compared, the fewest equal ones with P(similarity >= threshold) >= tail
    under a uniform prior: the posterior is Beta(1 + m, 1 + k - m), whose upper tail is a binomial sum."""
    out = []
    for k in range(BATCH, n + 1, BATCH):
        terms = [math.comb(k + 1, j) * threshold**j * (1 - threshold) ** (k + 1 - j) for j in range(k + 2)]
        out.append(next(m for m in range(k + 1) if sum(terms[: m + 1]) >= tail))
    return out


def missed(least: list[int], similarity: float) -> float:
    """The probability that a pair of this similarity falls below one of the bounds, minima being independent."""
    step = np.array([math.comb(BATCH, j) * similarity**j * (1 - similarity) ** (BATCH - j) for j in range(BATCH + 1)])
    alive = np.ones(1)
    for m in least:
        alive = np.convolve(alive, step)
        alive[:m] = 0
    return 1 - float(alive.sum())


def least_matches(n: int, threshold: float, miss: float = MISS) -> list[int]:
    """The tightest bounds, the tail being halved from miss on, that lose a pair at the threshold with at most miss in all."""
    tail = miss
    while missed(found := bounds(n, threshold, tail), threshold) > miss:
        tail /= 2
    return found


def likely(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b (uint16 signatures) that no batch rules out, and their equal minima."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[left] += (a[left, part] == b[left, part]).sum(1)
        left = left[matches[left] >= m]
    return left, matches[left]


def read_signatures(column: pa.Array) -> np.ndarray:
    """uint16[rows, minima]; every value of the column has the same length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BANDS * ROWS)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the sorted set; null if empty) and signature of every row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 1 << 20):
            h, starts = minhash.shingled(batch.column("text"), words)
            own = [minhash.distinct(h[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            keys = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in own]
            signs = [x.tobytes() for x in minhash.signatures(h, starts, BANDS * ROWS)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array(keys, pa.string()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key string, signature binary")


def banded(nodes: DataFrame) -> DataFrame:
    """nodes(node, signature, ...) with a row a band, without the signature: band and its minima as key (8 bytes)."""
    size = ROWS * 2
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring(F.col("signature"), i * size + 1, F.lit(size)))
    return nodes.select("*", F.posexplode(keys).alias("band", "key")).drop("signature")


def beside_hubs(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Rows (a, salt, own, node, value): each a of pairs(a, b) and then its partners. An a with many partners is dealt to
    salts of some CHUNK partners, with its own value sent once to each, so no key is hot. Pass stored pairs."""
    salts = max(1, -(-pairs.count() // CHUNK))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)))
    hubs = salted.select("a", "salt", F.lit(True).alias("own"), F.col("a").alias("node")).distinct()
    rows = hubs.union(salted.select("a", "salt", F.lit(False), "b")).join(values.select("node", value), "node")
    return rows.select("a", "salt", "own", "node", value).repartition(common.fan_out(pairs), "a", "salt").sortWithinPartitions("a", "salt", F.desc("own"), "node")


def with_hub(batch: pa.RecordBatch, last: int) -> np.ndarray:
    """For each row the position of its hub: the last row with own, or `last` before the first."""
    own = batch.column("own").to_numpy(zero_copy_only=False)
    return np.maximum.accumulate(np.where(own, np.arange(len(own)), last))


def surviving(pairs: DataFrame, nodes: DataFrame, least: list[int]) -> DataFrame:
    """Stored pairs(a, b) that the Bayesian bounds leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1, BANDS * ROWS), np.uint16)  # the signature of the last hub of what came before
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = np.concatenate([held, read_signatures(batch.column("signature"))])
            hub = with_hub(batch, -1) + 1
            rows = np.flatnonzero(~batch.column("own").to_numpy(zero_copy_only=False))
            kept, _ = likely(sign[hub[rows]], sign[rows + 1], least)
            held = sign[hub[-1]][None]
            take = pa.array(rows[kept])
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("node").take(take)], names=["a", "b"])

    return beside_hubs(pairs, nodes, "signature").mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text of the documents in wanted(doc_id), which is broadcast if its counted rows are few."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = wanted.count() <= common.MOST_BROADCAST
    return texts.join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Stored pairs(a, b) with common and united, the sizes of intersection and union, and near: whether they are linked.

    Only texts of documents in pairs are shuffled.
    """
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).withColumnRenamed("doc_id", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64)
        for batch in common.pieces(batches, "text", 1 << 20):
            if not batch.num_rows:
                continue
            h, starts = minhash.shingled(batch.column("text"), words)
            sets = [minhash.distinct(h[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
            sets.append(held)  # at position -1
            hub = with_hub(batch, -1)
            rows = np.flatnonzero(~batch.column("own").to_numpy(zero_copy_only=False))
            shared = np.array([np.isin(sets[i], sets[hub[i]], assume_unique=True, kind="sort").sum() if len(sets[i]) else 0 for i in rows], np.int64)
            united = np.array([len(sets[i]) + len(sets[hub[i]]) for i in rows], np.int64) - shared
            held = sets[hub[-1]]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("node").take(take), pa.array(shared), pa.array(united)], names=["a", "b", "common", "united"])

    out = beside_hubs(pairs, texts, "text").mapInArrow(run, "a long, b long, common long, united long")
    return out.withColumn("near", (100 * F.col("common") >= percent * F.col("united")) & (F.col("united") > 0))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of all nodes of edges(a, b), by alternating large and small stars."""
    now = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        after = common.stored(small)
        seals = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (now, after)]
        common.discard(now)
        if seals[0] == seals[1]:
            break
        now = after
    nodes = after.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(after.select(F.col("v"), F.col("v")).distinct())


def paired(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions p < q of all pairs within each run of equal values, in portions of bounded size."""
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff(np.append(starts, len(groups)))
    for size in np.unique(sizes[sizes > 1]):
        own = starts[sizes == size]
        if size <= 64:
            x, y = np.triu_indices(size, 1)
            step = max(1, PORTION // len(x))
            for k in range(0, len(own), step):
                some = own[k : k + step, None]
                yield (some + x).ravel(), (some + y).ravel()
        else:
            for start in own:
                step = max(1, PORTION // size)
                for k in range(0, size - 1, step):
                    x, y = np.triu_indices(min(step, size - k), 1, size - k)
                    yield start + k + x, start + k + y


def whole_cells(batches: Iterator[pa.RecordBatch], least_rows: int) -> Iterator[pa.Table]:
    """Rows sorted by cell, put together so that no cell is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        last = batch.column("cell")[batch.num_rows - 1].as_py()
        if rows < least_rows or held[0].column("cell")[0].as_py() == last:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        open_at = int(np.searchsorted(whole.column("cell").to_numpy(), last))  # its cell may go on
        yield whole.slice(0, open_at)
        held = whole.slice(open_at).combine_chunks().to_batches()
        rows = whole.num_rows - open_at
    if rows:
        yield pa.Table.from_batches(held)


def open_pairs(rows: pa.Table, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of different components in rows' cells that the Bayesian bounds leave, each in the first band
    that the pair shares."""
    sign = read_signatures(rows.column("signature").combine_chunks())
    cell, band, same, chunk, part = (rows.column(c).to_numpy() for c in ("cell", "band", "same", "chunk", "component"))
    for p, q in paired(cell):
        use = (part[p] != part[q]) & (same[p] | (chunk[p] != chunk[q]))
        p, q = p[use], q[use]
        first = (sign[p, :BATCH] == sign[q, :BATCH]).sum(1) >= least[0]
        p, q = p[first], q[first]
        kept, _ = likely(sign[p], sign[q], least)
        p, q = p[kept], q[kept]
        own = (sign[p] == sign[q]).reshape(len(p), BANDS, ROWS).all(2).argmax(1) == band[p]
        yield p[own], q[own]


CELL = "cell long, band int, same boolean, chunk int, node long, component long, signature binary"


def crossing(nodes: DataFrame, labels: DataFrame, least: list[int], fewest: int = 3) -> DataFrame:
    """Rows of CELL: the members of buckets that have a candidate of another component there. A bucket's members are dealt to
    cells of two chunks at most. Buckets of less than fewest are left out: those of two were decided by their star."""
    placed = banded(nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "signature"))
    mixed = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter(f"low <> high and n >= {fewest}").select("band", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    member = placed.join(mixed, ["band", "key"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # signatures join only members of such buckets
    dealt = member.join(nodes.select("node", "signature"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
    # unequal chunks meet in their own cell; equal ones in theirs
    cells = dealt.select(F.xxhash64("band", "key", i, j).alias("cell"), "band", (i == j).alias("same"), "chunk", "node", "component", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, 20_000):
            has = np.zeros(rows.num_rows, bool)
            for p, q in open_pairs(rows, least):
                has[p] = has[q] = True
            if has.any():
                yield from rows.filter(pa.array(has)).combine_chunks().to_batches()
        common.trim()

    return cells.repartition(common.fan_out(nodes), "cell").sortWithinPartitions("cell", "node").mapInArrow(run, CELL)


def shared_counts(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[p] and sets[q]: as bit rows where they fit, else one by one."""
    ids = np.unique(np.concatenate([p, q]))
    every, place = np.unique(np.concatenate([sets[i] for i in ids]), return_inverse=True)
    width = -(-len(every) // 64)
    if len(ids) * width * 8 > 64 << 20:
        return np.array([np.isin(sets[y], sets[x], assume_unique=True, kind="sort").sum() for x, y in zip(p, q, strict=True)], np.int64)
    bits = np.zeros((len(ids), width), np.uint64)
    row = np.repeat(np.arange(len(ids)), [len(sets[i]) for i in ids])
    np.bitwise_or.at(bits, (row, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    x, y = np.searchsorted(ids, p), np.searchsorted(ids, q)
    step = max(1, (16 << 20) // (width * 8))
    return np.concatenate([np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(1).astype(np.int64) for k in range(0, len(x), step)])


def with_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows with the shingle set, as bytes, in place of the text."""
    for batch in common.pieces(batches, "text", 1 << 20):
        h, starts = minhash.shingled(batch.column("text"), words)
        sets = [minhash.distinct(h[x:y]).tobytes() for x, y in zip(starts[:-1], starts[1:], strict=True)]
        at = batch.schema.get_field_index("text")
        yield batch.remove_column(at).append_column("set", pa.array(sets, pa.large_binary()))


def verified_cells(members: DataFrame, docs: DataFrame, words: int, percent: int, least: list[int], out: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """out(rows, p, q, shared, united) for the links p, q, verified on full sets, of each portion of candidates in a cell."""
    texts = texts_of(docs, members.select(F.col("node").alias("doc_id")).distinct())
    rows = members.join(texts.withColumnRenamed("doc_id", "node"), "node").select(*[c.split()[0] for c in CELL.split(", ")], "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(with_sets(batches, words), 500):
            cell, node = table.column("cell").to_numpy(), table.column("node").to_numpy()
            again = np.concatenate(([False], (cell[1:] == cell[:-1]) & (node[1:] == node[:-1])))  # rows of one id
            table = table.filter(pa.array(~again)) if again.any() else table
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
            sizes = np.array([len(x) for x in sets], np.int64)
            table = table.drop_columns(["set"])
            tell = out(table)
            for p, q in open_pairs(table, least):
                for k in range(0, len(p), PORTION):
                    x, y = p[k : k + PORTION], q[k : k + PORTION]
                    shared = shared_counts(sets, x, y)
                    united = sizes[x] + sizes[y] - shared
                    near = np.flatnonzero((100 * shared >= percent * united) & (united > 0))
                    if len(near) and (batch := tell(x[near], y[near], shared[near], united[near])):
                        yield batch
        common.trim()

    return rows.repartition(common.fan_out(docs), "cell").sortWithinPartitions("cell", "node", F.xxhash64("text")).mapInArrow(run, schema)


def crossing_links(members: DataFrame, docs: DataFrame, words: int, percent: int, least: list[int], every: bool = False) -> DataFrame:
    """a, b, common, united: links that join different components within cells. Of the links of two components in a cell the
    first is enough, unless every one is asked for."""

    def out(rows: pa.Table) -> Callable[..., pa.RecordBatch | None]:
        node, part, cell = (rows.column(c).to_numpy() for c in ("node", "component", "cell"))
        seen: set[tuple[int, int, int]] = set()

        def tell(p: np.ndarray, q: np.ndarray, shared: np.ndarray, united: np.ndarray) -> pa.RecordBatch | None:
            keep = np.arange(len(p)) if every else []
            for i in () if every else range(len(p)):
                key = (int(cell[p[i]]), *sorted((int(part[p[i]]), int(part[q[i]]))))
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (node[p[keep]], node[q[keep]], shared[keep], united[keep])], names=["a", "b", "common", "united"]) if len(keep) else None

        return tell

    return verified_cells(members, docs, words, percent, least, out, "a long, b long, common long, united long")


def link_counts(members: DataFrame, docs: DataFrame, words: int, percent: int, least: list[int]) -> DataFrame:
    """node, n_links: with how many others each member is linked, added up over cells; no pair leaves its cell."""

    def out(rows: pa.Table) -> Callable[..., pa.RecordBatch]:
        node = rows.column("node").to_numpy()

        def tell(p: np.ndarray, q: np.ndarray, shared: np.ndarray, united: np.ndarray) -> pa.RecordBatch:
            n = np.bincount(np.concatenate([p, q]), minlength=len(node))
            return pa.RecordBatch.from_arrays([pa.array(node[n > 0]), pa.array(n[n > 0])], names=["node", "n_links"])

        return tell

    counts = verified_cells(members, docs, words, percent, least, out, "node long, n_links long")
    return counts.groupBy("node").agg(F.sum("n_links").alias("n_links"))


def sets_of(full: DataFrame) -> DataFrame:
    """set_key, node (its smallest id), signature and number n of every class of rows with one shingle set."""
    return full.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.min("signature").alias("signature"), F.count(F.lit(1)).alias("n"))


def beside_sets(full: DataFrame, by_set: DataFrame, sets: DataFrame) -> DataFrame:
    """full(doc_id, n_shingles, set_key) with the columns of sets(set_key, ...), both stored. A set of many copies is dealt to
    salts of some CHUNK rows, with its own row sent once to each, so no key is hot; by_set has the numbers of copies."""
    salts = -(-(by_set.agg(F.max("n")).first()[0] or 0) // CHUNK)
    rows = full.select("doc_id", "n_shingles", "set_key")
    if salts <= 1:
        return rows.join(sets, "set_key")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    dealt = salted.select("set_key", "salt").distinct().join(sets, "set_key")
    return salted.join(dealt, ["set_key", "salt"]).drop("salt")


def candidates(docs: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(classes of stored signed rows, their members of buckets with a candidate, bounds), each class a component by itself, so
    that all pairs of a bucket are compared in its cells."""
    by_set = common.stored(sets_of(rows.filter(IN_A_SET)))
    nodes = by_set.groupBy("node").agg(F.min("signature").alias("signature"))
    least = least_matches(BANDS * ROWS, percent / 100)
    alone = docs.sparkSession.createDataFrame([], "node long, component long")
    return by_set, common.stored(crossing(nodes, alone, least, 2)), least


def every_link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """a < b, common, united: all pairs of classes that are near, each once, by their smallest ids."""
    _, members, least = candidates(docs, common.stored(signed(docs, words)), percent)
    return crossing_links(members, docs, words, percent, least, every=True)


def linked_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, class_id and n_links of every row: the smallest id with the same shingle set (null without one), and with how
    many other sets it is linked."""
    rows = common.stored(signed(docs, words))
    by_set, members, least = candidates(docs, rows, percent)
    counts = link_counts(members, docs, words, percent, least)
    sets = common.stored(by_set.join(counts, "node", "left").select("set_key", F.col("node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    shape = ["doc_id", "class_id", "n_links"]
    rest = rows.filter(f"not ({IN_A_SET})").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return beside_sets(rows.filter(IN_A_SET), by_set, sets).select(shape).union(rest.select(shape))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs."""
    spark = docs.sparkSession
    rows = common.stored(signed(docs, words))
    full = rows.filter(IN_A_SET)
    by_set = common.stored(sets_of(full))
    # an id of several texts is one node, with the least of their signatures
    nodes = by_set.groupBy("node").agg(F.min("signature").alias("signature"))
    least = least_matches(BANDS * ROWS, percent / 100)

    keyed = banded(nodes).select("band", "key", "node")
    stars = keyed.groupBy("band", "key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = keyed.join(stars, ["band", "key"]).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    # rows that share an id but no set are one document
    same = full.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).filter("x <> y").join(full.select("doc_id", "set_key").distinct(), "doc_id").join(by_set.select("set_key", "node"), "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = common.stored(verified(common.stored(surviving(common.stored(pairs), nodes, least)), docs, words, percent)).filter("near").drop("near")
    labels = common.stored(components(found.select("a", "b").union(same)))
    members = common.stored(crossing(nodes, labels, least))
    more = common.stored(crossing_links(members, docs, words, percent, least))
    labels = common.stored(components(found.select("a", "b").union(same).union(more.select("a", "b"))))
    sets = common.stored(by_set.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id")))
    common.release(spark)
    shape = ["doc_id", "n_shingles", "component_id"]
    rest = rows.filter(f"not ({IN_A_SET})").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = beside_sets(full, by_set, sets).select(shape).union(rest.select(shape))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


@common.fenced
def unique(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that have a near-duplicate of a smaller id in their component; of several rows that bear one id, the least text's."""
    found = common.stored(near_duplicates(docs, words, percent))
    out = found.filter("not kept").select("doc_id").distinct()
    again = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    few = F.broadcast(out) if out.count() <= common.MOST_BROADCAST else out
    kept = docs.join(few, "doc_id", "left_anti").select(docs.columns)
    if again.isEmpty():
        return kept
    from pyspark.sql import Window as W

    first = kept.join(again, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(W.partitionBy("doc_id").orderBy("text"))).filter("_nth = 1")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).union(first.select(docs.columns))


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents: four-word shingles, similarity 0.8. Edge cases: see the module."""
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4)


QUERIES = {"op5_dedup": op5_dedup}
ORACLE = {
    "op5_dedup": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS r FROM documents
  UNION
  SELECT t.b, reach.r FROM reach JOIN both_ways t ON t.a = reach.a WHERE reach.r < t.b),
c AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
}
