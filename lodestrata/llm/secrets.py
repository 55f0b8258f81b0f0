"""Secret scans with multipart credential linking.

A pass over whole texts gives base spans (strong on their own) and weak parts: identifiers, secrets and endpoints that mean
nothing alone. Weak parts are then joined by interval: on (row, scope, bin of WINDOW code points) with a bound on their
distance, as semi-joins, so that no pairs are made and a bin holds at most as many parts as it has code points. Both sides
stand in every bin they reach, so that long parts are met at either end. A weak identifier needs a secret nearby, a weak
secret an identifier, an endpoint both. A scope is a paragraph.

Defined results: null and empty texts have no spans (their base digest is that of no bytes); rows with equal ids are kept
apart by a row number of the scan; an empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

# Weak parts: an identifier that is named, an unnamed secret of mixed letters and digits, an endpoint.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:(?<!secret[._-])access[_-]?key(?:[_-]?id)?|client[_-]?id|user(?:[_-]?name)?|login|account(?:[_-]?name)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
# A host is tried from the beginning of its labels alone, so a text of labels is read once.
ENDPOINT = re.compile(r"\bhttps?://[A-Za-z0-9.-]+(?::\d+)?|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b|(?<![a-z0-9-])(?<![a-z0-9-]\.)(?:(?<=\w)[a-z0-9]+\.?)?-*\b(?P<host>[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com\b)", re.A)
#: RE2; what no weak or base pattern could match without.
MAYBE = r"""(?i:password|passwd|secret|token|api_?key|access[_-]?key|client[_-]?id|user|login|account|name|id)["']? *[:=]|AKIA[A-Z0-9]|[0-9a-f]{32}"""
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

WINDOW = 400
#: Bytes of text taken at once.
PIECE = 4 << 20
LEAST_ENTROPY = 3.5


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    rank = {k: i for i, k in enumerate((*KINDS, "identifier", "secret", "endpoint"))}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that overlap no base span, nor each other. An identifier that would end within a secret gives way to it."""
    found = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if not found and not base:
        return []
    secrets = [(m.start(), m.end()) for m in SECRET.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= LEAST_ENTROPY]
    starts = [a for a, _ in secrets]
    cut = [(k, a, b) for k, a, b in found if (i := bisect.bisect_left(starts, b)) and secrets[i - 1][1] > b]
    found = sorted(set(found) - set(cut)) + [("secret", a, b) for a, b in secrets]
    found += [("endpoint", m.start("host") if m["host"] else m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    base_starts = [a for _, a, _ in sorted(base, key=lambda s: s[1])]
    base_ends = list(itertools.accumulate((b for _, _, b in sorted(base, key=lambda s: s[1])), max))
    own: list[tuple[int, int]] = []  # apart from each other, so the last one before a place ends last
    out = []
    for kind, a, b in ordered(found) + cut:
        i, j = bisect.bisect_left(base_starts, b), bisect.bisect_left(own, (b, b))
        if (i == 0 or base_ends[i - 1] <= a) and (j == 0 or own[j - 1][1] <= a):
            out.append((kind, a, b))
            own.insert(j, (a, b))
    return out


ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}
PART = pa.struct([("kind", pa.string()), ("role", pa.string()), ("weak", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCANNED = "row_id long, doc_id long, base array<struct<kind string, start long, end long>>, parts array<struct<kind string, role string, weak boolean, start long, end long, scope long>>"


def parts_of(texts: pa.Array) -> tuple[list, list]:
    """Base spans of each text, and its parts where a weak one could be linked."""
    maybe = pc.match_substring_regex(texts, MAYBE).to_numpy(zero_copy_only=False)
    base_col: list = [[]] * len(texts)
    part_col: list = [[]] * len(texts)
    for i in maybe.nonzero()[0]:
        text = texts[i].as_py()
        base = base_spans(text)
        weak = weak_parts(text, base)
        base_col[i] = [{"kind": k, "start": a, "end": b} for k, a, b in base]
        if weak and len({ROLE[k] for k, _, _ in base + weak}) > 1:
            breaks = [m.end() for m in PARAGRAPH.finditer(text)]
            part_col[i] = [{"kind": k, "role": ROLE[k], "weak": w, "start": a, "end": b, "scope": bisect.bisect_right(breaks, a)} for spans, w in ((base, False), (weak, True)) for k, a, b in spans]
    return base_col, part_col


def scan(docs: DataFrame) -> DataFrame:
    """A row a document: its base spans, and its parts where a weak one could be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in common.pieces(batches, "text", PIECE):
            base_col, part_col = parts_of(pc.fill_null(batch.column("text"), ""))
            ids = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), pa.array(base_col, pa.list_(SPAN)), pa.array(part_col, pa.list_(PART))], names=["row_id", "doc_id", "base", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCANNED)


def linked(scanned: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, added: the weak parts whose complements lie in the same scope within window code points."""
    parts = scanned.select("row_id", F.explode("parts").alias("p")).select("row_id", "p.*")
    bin_of = lambda c: F.floor(c / F.lit(window))
    weak = parts.filter("weak").withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - window), bin_of(F.col("end") + window))))
    anchors = parts.select("row_id", "scope", "role", "start", "end", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end")))).alias("bin"))

    def near(left: DataFrame, role: str) -> DataFrame:
        a, b = left.alias("l"), anchors.filter(F.col("role") == role).alias("r")
        close = (F.col("r.start") <= F.col("l.end") + window) & (F.col("r.end") >= F.col("l.start") - window)
        return a.join(b, (F.col("l.row_id") == F.col("r.row_id")) & (F.col("l.scope") == F.col("r.scope")) & (F.col("l.bin") == F.col("r.bin")) & close, "left_semi")

    keys = ["row_id", "kind", "start", "end"]
    identifiers = near(weak.filter("kind = 'identifier'"), "secret").select(keys)
    secrets = near(weak.filter("kind = 'secret'"), "identifier").select(keys)
    whole = weak.filter("kind = 'endpoint'")
    ends = near(whole, "secret").select(keys).intersect(near(whole, "identifier").select(keys))
    found = identifiers.union(secrets).union(ends).distinct()
    return found.groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))


def found_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, doc_id, base and added spans (kind, start, end; code points) of every document."""
    scanned = common.stored(scan(docs))
    return scanned.join(linked(scanned, window), "row_id", "left").select("row_id", "doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("added"))


MASK = "[secret]"
#: Texts with linked parts, counted first, whose digests and spans (some hundred bytes a text) may be broadcast.
MOST_LINKED = 100_000


@common.fenced
def redacted(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with every found span of text replaced by MASK, and n_chars, if there, set anew. Rows are never dropped.

    Spans depend on the text alone. A first pass keeps the parts of texts where some may link, by the text's digest, as a
    narrow table; in the second, texts meet the linked parts by that digest, and base spans are found where they are masked.
    """
    names = docs.columns
    texts = docs.select(F.col("text").cast("string").alias("text"))
    kept = "row_id string, parts array<struct<kind string, role string, weak boolean, start long, end long, scope long>>"

    def scan_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", PIECE):
            column = pc.fill_null(batch.column("text"), "")
            found = [(i, p) for i, p in enumerate(parts_of(column)[1]) if p]
            keys = [hashlib.sha256(column[i].as_py().encode()).hexdigest() for i, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([p for _, p in found], pa.list_(PART))], names=["row_id", "parts"])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", PIECE):
            column = batch.column("text")
            filled = pc.fill_null(column, "")
            added = batch.column("_added")
            hit = pc.or_(pc.match_substring_regex(filled, MAYBE), pc.is_valid(added)).to_numpy(zero_copy_only=False)
            changed, new = [], []
            for i in hit.nonzero()[0].tolist():
                text = filled[i].as_py()
                spans = [{"start": a, "end": b} for _, a, b in base_spans(text)] + (added[i].as_py() or [])
                if spans:
                    changed.append(i)
                    new.append(masked(text, spans))
            rows = np.zeros(batch.num_rows, bool)
            rows[changed] = True
            columns = {c: batch.column(c) for c in names}
            columns["text"] = pc.replace_with_mask(column, pa.array(rows), pa.array(new, column.type))
            if "n_chars" in columns:
                old = columns["n_chars"]
                columns["n_chars"] = pc.replace_with_mask(old, pa.array(rows), pa.array([len(t) for t in new], pa.int64()).cast(old.type))
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    scanned = common.stored(texts.mapInArrow(scan_parts, kept).dropDuplicates(["row_id"]))
    added = common.stored(linked(scanned, window).withColumnRenamed("row_id", "_key").withColumnRenamed("added", "_added"))
    few = F.broadcast(added) if added.count() <= MOST_LINKED else added
    both = docs.withColumn("_key", F.sha2(F.col("text").cast("string").cast("binary"), 256)).join(few, "_key", "left")
    return both.select(*names, "_added").mapInArrow(mask, docs.schema)


def masked(text: str, spans: list) -> str:
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at : s["start"]], MASK]
            at = s["end"]
    return "".join([*out, text[at:]])


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's spans. Edge cases: see the module."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, base, added in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "base", "added")), strict=True):
                plain = ordered([(s["kind"], s["start"], s["end"]) for s in base])
                every = ordered(plain + [(s["kind"], s["start"], s["end"]) for s in added])
                n = Counter(k for k, _, _ in plain)
                rows.append((key, *(n[k] for k in KINDS), hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return found_spans(common.table(spark, sf_dir, "documents")).select("doc_id", "base", "added").mapInArrow(run, schema)


QUERIES = {"op4_secrets": op4_secrets}
ORACLE: dict[str, str] = {}
