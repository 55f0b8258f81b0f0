"""Media columns: signature sniffing.

Aho-Corasick finds magic bytes anywhere in a blob, a validator for each format confirms structure and lengths, and from
the confirmed hits the declared type is corrected and embedded media are carved out. ``store`` is the lossless sink used
by the query: text bytes as 8-bit mono PCM in a RIFF/WAVE container, read back through the same sniffer.

Defined results: a null blob is of type ``application/x-empty`` with no embedded media, as is an empty one; a blob that
no validator accepts at offset 0 keeps a declared type that has no signature here, and else is
``application/octet-stream``. Repeated rows give repeated results; extra columns are carried along unless they bear an
output's name, in which case the output wins. Very long blobs are read whole: end marks are found once a blob, so many heads
without an end cost no more than one. An empty table gives none.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Magic bytes of the formats.
MAGIC: list[tuple[bytes, str]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"RIFF", "riff"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"fLaC", "audio/flac"),
    (b"OggS", "audio/ogg"),
]

WAV_HEADER, RATE = 44, 8000
#: Bytes inflated at once.
WINDOW = 1 << 16


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + n
        if end > len(b) or not kind.isalpha() or first and (kind != b"IHDR" or n != 13):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return "image/png", end - at
        pos, first = end, False
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    pos, frames = at + 2, 0
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return None
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if mark == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return ("image/jpeg", pos + 2 - at) if frames else None
                if b[pos + 1] != 0 and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            else:
                return None
    return None


def _gif(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """Blocks up to the trailer. A place from which blocks or sub-blocks were followed before is not followed again."""
    if at + 13 > len(b):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, at + 6)
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    if not width or not height:
        return None

    def blocks(pos: int) -> int:
        walked = []
        while pos < len(b) and b[pos] and pos not in marks.runs:
            walked.append(pos)
            pos += 1 + b[pos]
        end = marks.runs.get(pos, pos + 1)
        marks.runs.update(dict.fromkeys(walked, end))
        return end

    walked, end = [], None
    while pos < len(b) and pos not in marks.images:
        walked.append(pos)
        if b[pos] == 0x3B:
            end = pos + 1
            break
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            local = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
        else:
            break
    end = marks.images.get(pos, end)
    marks.images.update(dict.fromkeys(walked, end))
    return ("image/gif", end - at) if end else None


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    """WAVE and WEBP: chunks must fill the form exactly."""
    if at + 12 > len(b):
        return None
    n, form = struct.unpack_from("<I4s", b, at + 4)
    end, pos = at + 8 + n, at + 12
    if end > len(b) or form not in (b"WAVE", b"WEBP"):
        return None
    names = []
    while pos + 8 <= end:
        name, m = struct.unpack_from("<4sI", b, pos)
        names.append(name)
        pos += 8 + m + (m & 1)
    if pos != end or not names or form == b"WAVE" and not {b"fmt ", b"data"} <= set(names) or form == b"WEBP" and not names[0].startswith(b"VP8"):
        return None
    return "audio/wav" if form == b"WAVE" else "image/webp", end - at


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    n, reserved, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or head < 40 or not 14 + head <= start <= n or at + n > len(b):
        return None
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    return ("image/bmp", n) if struct.unpack_from("<I", b, at + 30)[0] or start + rows <= n else None


def _pdf(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """Up to the last end mark before the next document's head: an update appends to what it changes."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    after = bisect.bisect_right(marks.heads, at)
    upto = marks.heads[after] if after < len(marks.heads) else len(b)
    first, last = bisect.bisect_left(marks.eofs, at), bisect.bisect_left(marks.eofs, upto)
    if first == last:  # a document may hold others: its own end then lies beyond their heads
        first, last = first, first + 1
    if last > len(marks.eofs) or first == len(marks.eofs):
        return None
    end = marks.eofs[last - 1]
    cross = bisect.bisect_left(marks.crosses, at)
    return ("application/pdf", end + 5 - at) if cross < len(marks.crosses) and marks.crosses[cross] < end else None


def _zip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """The end record whose offsets count from here, not that of an archive stored inside."""
    whole = marks.archives.get(at)
    return ("application/zip", whole) if whole else None


def _gzip(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    flags = b[at + 3] if at + 3 < len(b) else 0
    if flags & 0xE0 or flags & 0x18 and marks.last_zero <= at:  # bits that mean nothing; a name or comment without an end
        return None
    view, pos = memoryview(b), at
    try:
        inflate = zlib.decompressobj(31)
        while pos < len(b) and not inflate.eof:  # a bounded window at a time: the content is only checked
            inflate.decompress(view[pos : pos + WINDOW], 1 << 20)
            pos += WINDOW
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return ("application/gzip", min(pos, len(b)) - at - len(inflate.unused_data)) if inflate.eof else None


class Marks:
    """Places of the end marks of a blob, each found once: %%EOF, startxref and heads of PDF; archives[start] is the length
    of a zip by its last end record whose directory and offsets are consistent with that start."""

    def __init__(self, b: bytes) -> None:
        every = lambda mark: [m.start() for m in re.finditer(re.escape(mark), b)]
        self.eofs, self.crosses, self.heads = every(b"%%EOF"), every(b"startxref"), every(b"%PDF-")
        self.last_zero = b.rfind(b"\0")
        self.archives: dict[int, int] = {}
        self.pages: dict[int, int | None] = {}  # where the stream of the Ogg page here ends, None if it doesn't
        self.images: dict[int, int | None] = {}  # the same for blocks of GIF
        self.runs: dict[int, int] = {}  # where the sub-blocks from here end
        for end in every(b"PK\x05\x06"):
            if end + 22 <= len(b):
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                at, whole = end - size - start, size + start + 22 + note
                if at >= 0 and at + whole <= len(b) and (b[at + start : at + start + 4] == b"PK\x01\x02" or size == 0):
                    self.archives[at] = whole


def _crc(polynomial: int, bits: int) -> list[int]:
    """A table of 256 remainders, most significant bit first."""
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for i in range(256):
        r = i << bits - 8
        for _ in range(8):
            r = (r << 1 ^ polynomial) & mask if r & top else r << 1 & mask
        out.append(r)
    return out


CRC8, CRC16 = _crc(0x07, 8), _crc(0x8005, 16)
FRAME = re.compile(rb"\xff[\xf8\xf9]")
#: Samples of a frame by their code; codes 6 and 7 are followed by the number less one.
BLOCK_SIZES = {1: 192} | {k: 144 << k for k in range(2, 6)} | {k: 1 << k for k in range(8, 16)}


def _frame(b: bytes, at: int) -> tuple[int, int] | None:
    """(samples, length of the header) of a FLAC frame whose header's checksum is right."""
    if at + 6 > len(b) or b[at + 2] >> 4 == 0 or b[at + 3] & 1 or b[at + 3] >> 4 > 10 or b[at + 4] >> 6 == 2:
        return None
    code, rate = b[at + 2] >> 4, b[at + 2] & 15
    ones = 8 - (~b[at + 4] & 0xFF).bit_length()  # the number's bytes are told as in UTF-8
    pos = at + 4 + (ones or 1)
    extra = {6: 1, 7: 2}.get(code, 0)
    samples = int.from_bytes(b[pos : pos + extra], "big") + 1 if extra else BLOCK_SIZES.get(code, 0)
    pos += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if rate == 15 or not samples or pos >= len(b):
        return None
    r = 0
    for x in b[at:pos]:
        r = CRC8[r ^ x]
    return (samples, pos + 1 - at) if r == b[pos] else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    """Metadata blocks, then frames until all samples are there; a frame ends where its checksum is right. Without a number
    of samples the last frame is the one after which none begins."""
    pos, last, first, left, most = at + 4, False, True, 0, 0
    while not last and pos + 4 <= len(b):
        last, kind, n = bool(b[pos] & 0x80), b[pos] & 0x7F, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127:
            return None
        if first and pos + 38 <= len(b):
            most = int.from_bytes(b[pos + 11 : pos + 14], "big")
            left = int.from_bytes(b[pos + 17 : pos + 22], "big") & (1 << 36) - 1
        pos, first = pos + 4 + n, False
    if not last or pos > len(b):
        return None
    known, found = left, 0
    while pos < len(b) and (not known or found < known):
        head = _frame(b, pos) if FRAME.match(b, pos) else None
        if not head:
            break
        r, end, upto = 0, 0, min(len(b), pos + most) if most else len(b)
        for k in range(pos, upto):
            r = (r << 8 & 0xFFFF) ^ CRC16[r >> 8 ^ b[k]]
            if r == 0 and k + 1 - pos > head[1] + 2:
                after = k + 1
                if known and found + head[0] >= known or after == len(b) or FRAME.match(b, after) and _frame(b, after):
                    end = after
                    break
        if not end:
            return None
        found, pos = found + head[0], end
    return ("audio/flac", pos - at) if found >= known else None


def _ogg(b: bytes, at: int, marks: Marks) -> tuple[str, int] | None:
    """Pages up to the last one of the stream. A head within a walk that was made is not walked again."""
    walked, pos = [], at
    while pos not in marks.pages:
        walked.append(pos)
        if b[pos : pos + 4] != b"OggS" or pos + 27 > len(b):
            marks.pages[pos] = None
            break
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if b[pos + 4] or end > len(b):
            marks.pages[pos] = None
        elif b[pos + 5] & 4:
            marks.pages[pos] = end
        pos = pos if pos in marks.pages else end
    end = marks.pages[pos]
    marks.pages |= dict.fromkeys(walked, end)
    return ("audio/ogg", end - at) if end else None


VALIDATORS: dict[str, Callable[..., tuple[str, int] | None]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "riff": _riff, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg,
}
KNOWN = {"image/png", "image/jpeg", "image/gif", "image/bmp", "image/webp", "audio/wav", "audio/flac", "audio/ogg", "application/pdf", "application/zip", "application/gzip"}


def automaton() -> ahocorasick.Automaton:
    """Bytes are scanned as Latin-1 text, one code point a byte."""
    out = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        out.add_word(magic.decode("latin-1"), (len(magic), kind))
    out.make_automaton()
    return out


def sniffed(blob: bytes, find: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Confirmed media as (type, offset, length), in order of offset; the content of a raw container is searched too,
    that of a compressed one isn't, and a hit inside a compressed one already confirmed is passed over."""
    out, closed, marks = [], 0, None
    for last, (n, kind) in find.iter(blob.decode("latin-1")):
        at = last + 1 - n
        if at < closed:
            continue
        if kind in ("application/pdf", "application/zip", "application/gzip", "audio/ogg", "image/gif"):
            marks = marks or Marks(blob)
            found = VALIDATORS[kind](blob, at, marks)
        else:
            found = VALIDATORS[kind](blob, at)
        if found:
            out.append((found[0], at, found[1]))
            if found[0] not in ("audio/wav", "image/bmp"):
                closed = at + found[1]
    return out


def stored(payload: bytes) -> bytes:
    """A RIFF/WAVE file: 8-bit mono PCM samples are the payload's bytes. The payload's length must be even."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(wav: bytes) -> bytes:
    """The sample bytes of a validated RIFF/WAVE file."""
    pos = 12
    while wav[pos : pos + 4] != b"data":
        n = struct.unpack_from("<I", wav, pos + 4)[0]
        pos += 8 + n + (n & 1)
    return wav[pos + 8 : pos + 8 + struct.unpack_from("<I", wav, pos + 4)[0]]


FOUND = T.ArrayType(T.StructType([T.StructField("media_type", T.StringType()), T.StructField("at", T.LongType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())]))


def sniff(df: DataFrame, blob: str, declared: str | None = None, carve: bool = True) -> DataFrame:
    """Adds media_type (corrected), was_declared_right boolean (null without a declared type) and embedded: the media
    confirmed beyond offset 0, with their bytes if carve."""
    outputs = ("media_type", "was_declared_right", "embedded")
    keep = [c for c in df.columns if c not in outputs]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.BooleanType()), T.StructField(outputs[2], FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in common.pieces(batches, blob, 16 << 20):
            types, right, inner = [], [], []
            names = batch.column(declared).to_pylist() if declared else [None] * batch.num_rows
            for value, name in zip(batch.column(blob), names, strict=True):
                b = value.as_py()
                found = sniffed(b, find) if b else []
                if found and found[0][1] == 0:
                    kind, rest = found[0][0], found[1:]
                else:
                    rest = found
                    kind = "application/x-empty" if not b else name if name and name not in KNOWN else "application/octet-stream"
                types.append(kind)
                right.append(None if name is None else name == kind)
                inner.append([{"media_type": k, "at": at, "length": n, "content": b[at : at + n] if carve else None} for k, at, n in rest])
            columns = [batch.column(c) for c in keep] + [pa.array(types, pa.string()), pa.array(right, pa.bool_()), pa.array(inner, ARROW_FOUND)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *outputs])

    return df.mapInArrow(run, schema)


ARROW_FOUND = pa.list_(pa.struct([("media_type", pa.string()), ("at", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as WAVE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text", 16 << 20):
            sizes, blobs = [], []
            for value in batch.column("text"):
                b = (value.as_py() or "").encode()
                sizes.append(len(b))
                blobs.append(stored(b + bytes(-len(b) % 64 or (0 if b else 64))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Reads stored media back through the sniffer's result and digests payload and stored form."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            kinds, inner = batch.column("media_type").to_pylist(), batch.column("embedded").to_pylist()
            for i, (key, n) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True)):
                wav = batch.column("media")[i].as_py()
                if kinds[i] != "audio/wav":
                    raise ValueError(f"stored media of document {key} isn't valid")
                data = samples(wav)
                carved = "+".join(f"{x['media_type']}@{x['at'] - WAV_HEADER}:{x['length']}" for x in inner[i])
                feature = f"{kinds[i]};rate={RATE};bits=8;samples={len(data)};peak={max(data)};embedded={carved}"
                rows.append((key, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), feature))
            kind = dict(string=pa.string(), long=pa.int64())
            columns = [pa.array([r[k] for r in rows], kind[x.split()[1]]) for k, x in enumerate(schema.split(", "))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return media.select("doc_id", "n_bytes", "media", "media_type", "embedded").mapInArrow(run, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as WAVE samples, sniffed, read back and digested. A null text is an empty one; see the module
    for other edge cases."""
    kept = store_texts(common.table(spark, sf_dir, "documents")).withColumn("declared", F.lit("application/octet-stream"))
    return digests(sniff(kept, "media", "declared", carve=False))


QUERIES = {"op8_media": op8_media}
ORACLE: dict[str, str] = {}
