"""Operators whose results SQL can't express, against plain definitions over random inputs."""

import gzip
import io
import random
import re
import struct
import time
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import dedup, fingerprints, language, media, packing, secrets, urls

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""",
    "access": r"(?P<v>AKIA[A-Z0-9]+)",
    "hex": r"(?P<v>[0-9a-f]+)",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}


def soup(rng):
    """Words, assignments, keys, long values, nested ones, endpoints and paragraphs."""
    value = lambda n: "".join(rng.choice("abcXYZ019+/") for _ in range(n))
    part = [
        lambda: "word " * rng.choice([1, 3, 30, 90]), lambda: f"Token={value(rng.choice([3, 8, 400, 900]))} ", lambda: f"api_key: '{'0f' * rng.choice([8, 16, 40])}' ",
        lambda: "AKIA" + value(16).upper().replace("+", "A").replace("/", "B") + " ", lambda: "ab12" * rng.choice([7, 8, 12]) + " ", lambda: f"user={rng.choice(['alice', 'bob-2', 'x'])} ",
        lambda: value(40) + " ", lambda: "https://api.corp.example:8080/x ", lambda: "\n \n", lambda: "\n", lambda: "10.0.0.1 ", lambda: f"token={'-'.join(['ab12' * 8] * 5)}-user=alice2 ",
    ]
    return "".join(rng.choice(part)() for _ in range(rng.randint(1, 14)))


def test_op4_against_plain_definitions(spark):
    rng = random.Random(3)
    texts = {i: soup(rng) for i in range(250)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in secrets.found_spans(docs).collect()}
    linked = 0
    for i, text in texts.items():
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if len(m["v"]) >= LEAST[k]]
        assert sorted((s.kind, s.start, s.end) for s in got[i].base) == sorted(base)
        weak = secrets.weak_parts(text, base)
        assert all(b <= c or d <= a for _, a, b in weak for _, c, d in base)
        assert all(x == y or x[2] <= y[1] or y[2] <= x[1] for x in weak for y in weak)
        breaks = [m.end() for m in secrets.PARAGRAPH.finditer(text)]
        scope = lambda a: sum(x <= a for x in breaks)  # noqa: B023, E731
        near = lambda x, role: any(secrets.ROLE[k] == role and scope(a) == scope(x[1]) and a <= x[2] + secrets.WINDOW and b >= x[1] - secrets.WINDOW for k, a, b in base + weak if (k, a, b) != x)  # noqa: B023, E731
        needs = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}
        want = {x for x in weak if all(near(x, role) for role in needs[x[0]])}
        assert {(s.kind, s.start, s.end) for s in got[i].added} == want, i
        linked += len(want)
    assert linked > 50
    masked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    for i, text in texts.items():
        spans = [(s.start, s.end) for s in [*got[i].base, *got[i].added]]
        left = "".join(c for k, c in enumerate(text) if not any(a <= k < b for a, b in spans))
        assert masked[i].replace(secrets.MASK, "") == left, i


def grams(marked):
    """N-grams of a word between marks, but for those with a mark at either end."""
    every = [marked[k : k + n] for n in language.ORDERS for k in range(len(marked) - n + 1)]
    return [g for g in every if not (g[0] == g[-1] == " ")]


def test_op7_filters_against_sets(spark):
    rng = random.Random(4)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(make("abcdef" if i % 2 else "defghi", 60), "x" if i % 2 else "y") for i in range(40)]
    filters = language.fit(spark.createDataFrame(rows, "text string, lang string"), slots=1 << 12, least_share=1e-3)
    counts = {"x": Counter(), "y": Counter()}
    for text, lang in rows:
        for w in text.split():
            marked = f" {w} "
            counts[lang].update(grams(marked))
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    kept = {lang: {g for g, s in share[lang].items() if s >= 1e-3 and s >= language.LEAST_RATIO * max(share["x"].get(g, 0), share["y"].get(g, 0))} for lang in "xy"}
    words = sorted({w for t, _ in rows for w in t.split()})
    n, per_word = language.hits(words, filters)
    false = 0
    for i, w in enumerate(words):
        marked = f" {w} "
        own = grams(marked)
        assert n[i] == len(own)
        for j, lang in enumerate(filters.langs):
            exact = sum(g in kept[lang] for g in own)
            assert per_word[i, j] >= exact  # a filter loses nothing
            false += per_word[i, j] - exact
    assert false / (n.sum() * 2) < 3 * filters.false.max() + 0.01
    corrected = lambda total, count, f: max(0.0, (total - count * f) / (1 - f))
    names, scores = language.detected(pa.array([" ".join(words[:9])]), filters)
    want = [corrected(per_word[:9, j].sum(), n[:9].sum(), filters.false[j]) for j in range(2)]
    assert names == [filters.langs[int(np.argmax(want))]] and scores[0] == pytest.approx(min(1.0, max(want) / n[:9].sum()))


def test_op7_repeated_rows_and_empty_tables(spark):
    assert language.fit(spark.createDataFrame([], "text string, lang string")).langs == []
    rows = [("abc def", "x")] * 3 + [("ghi", None), (None, "y")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    filters = language.fit(docs)
    assert filters.langs == ["x"] and [r.lang_pred for r in language.detect(docs, filters).collect()] == ["x"] * 3 + ["x", "und"]


def zipped(*files, stored=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def flac(frames=3, samples=16):
    """Constant mono frames of 8 bits, with both checksums worked out bit by bit."""

    def remainder(data, polynomial, bits):
        r = 0
        for byte in data:
            for k in range(7, -1, -1):
                top = r >> bits - 1 & 1 ^ byte >> k & 1
                r = (r << 1 & (1 << bits) - 1) ^ (polynomial if top else 0)
        return r

    info = struct.pack(">HH", samples, samples) + bytes(6) + (8000 << 44 | 0 << 41 | 7 << 36 | frames * samples).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, k, samples - 1])
        frame = head + bytes([remainder(head, 0x07, 8)]) + bytes([0, 40 + k])
        out += frame + struct.pack(">H", remainder(frame, 0x8005, 16))
    return out


PDF = b"%PDF-1.4\n1 0 obj\nendobj\nxref\nstartxref\n9\n%%EOF"


def test_op8_ends_where_formats_end():
    find = media.automaton()
    inner = zipped(("a.txt", b"abc"))
    outer = zipped(("inner.zip", inner), ("b", b"xyz"))
    updated = PDF + b"\n2 0 obj\nendobj\nstartxref\n20\n%%EOF"
    sound = flac()
    packed = gzip.compress(b"hello" * 100)
    blob = b"--" + outer + b"??" + updated + b"\n\n" + sound + packed + inner
    at = lambda x: blob.index(x)
    assert media.sniffed(blob, find) == [("application/zip", 2, len(outer)), ("application/pdf", at(updated), len(updated)), ("audio/flac", at(sound), len(sound)), ("application/gzip", at(packed), len(packed)), ("application/zip", len(blob) - len(inner), len(inner))]
    for cut in (outer[:-1], PDF[:-1], sound[:-1], packed[:-1], sound[:30]):
        assert not any(a == 0 for _, a, _ in media.sniffed(cut, find))
    spoilt = bytearray(sound)
    spoilt[-1] ^= 1
    assert media.sniffed(bytes(spoilt), find) == []


@pytest.mark.parametrize("piece", [b"PK\x03\x04", b"%PDF-1", b"\x1f\x8b\x08", b"%PDF-1%%EOF", b"PK\x05\x06" + bytes(8)])
def test_op8_many_heads_take_linear_time(piece):
    began = time.process_time()
    media.sniffed(piece * 40_000, media.automaton())
    assert time.process_time() - began < 3


def test_op8_repeated_rows(spark):
    blobs = spark.createDataFrame([(1, bytearray(PDF), "text/plain"), (1, bytearray(PDF), "text/plain"), (2, None, None), (3, bytearray(b""), "x/y")], "doc_id long, b binary, declared string")
    got = [(r.doc_id, r.media_type, r.was_declared_right) for r in media.sniff(blobs, "b", "declared").collect()]
    assert got == [(1, "application/pdf", False)] * 2 + [(2, "application/x-empty", None), (3, "application/x-empty", False)]


def test_op2_link_numbers_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 4)
    base = [f"w{k}" for k in range(300)]
    texts = {i: " ".join([*base[: 7 * i], f"z{i}", *base[7 * i + 1 :]]) for i in range(12)} | {50: "a b", 51: None, 52: "", 53: "A  b"}
    rows = [*texts.items(), (3, texts[3]), (None, texts[4])]
    got = defaultdict(set)
    for r in fingerprints.link_numbers(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add((r.class_id, r.n_links))
    assert got == {i: {(i, 11)} for i in range(12)} | {50: {(50, 0)}, 53: {(50, 0)}, 51: {(None, 0)}, 52: {(None, 0)}, None: {(None, 0)}}


def test_op5_hubs_are_dealt_to_salts(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 5)
    pairs = dedup.common.stored(spark.createDataFrame([(0, i) for i in range(1, 60)] + [(7, 8)], "a long, b long"))
    values = spark.createDataFrame([(i, f"t{i}") for i in range(60)], "node long, text string")
    rows = dedup.beside_hubs(pairs, values, "text").collect()
    assert sorted((r.a, r.node) for r in rows if not r.own) == sorted((r.a, r.b) for r in pairs.collect())
    groups = Counter((r.a, r.salt) for r in rows)
    assert max(groups.values()) < 20 and all(Counter((r.a, r.salt) for r in rows if r.own)[g] == 1 for g in groups)


def test_op5_bounds_lose_at_most_what_they_say():
    least = dedup.least_matches(96, 0.8)
    assert dedup.missed(least, 0.8) <= dedup.MISS
    rng = np.random.default_rng(2)
    hits = rng.random((40_000, 96)) < 0.6
    alive = np.ones(len(hits), bool)
    for k, m in enumerate(least, 1):
        alive &= hits[:, : 16 * k].sum(1) >= m
    assert 1 - alive.mean() == pytest.approx(dedup.missed(least, 0.6), abs=0.01)


@pytest.mark.parametrize(("low", "high"), [(1, 2049), (500, 1200), (600, 760), (1500, 1501), (1, 3)])
def test_op3_is_never_worse_than_best_fit(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 20_000)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan(counts)
    held: Counter = Counter()
    for config, n in plan:
        assert packing.gap(config, 2048) >= 0 and n > 0
        for k, a in config:
            held[k] += a * n
    assert held == counts
    alone = sum(n for _, n in packing.fill(packing.histogram(counts, 2048), 2048))
    number = sum(n for _, n in plan)
    assert packing.least(counts) <= number <= alone
    assert (low, high) != (600, 760) or number == -(-20_000 // 3) < alone


def test_op3_bound_against_every_partition():
    rng = random.Random(1)

    def fewest(left, bins):
        if not left:
            return len(bins)
        x, rest, out = left[0], left[1:], 99
        for i in range(len(bins)):
            if bins[i] + x <= 10 and bins[i] not in bins[:i]:
                out = min(out, fewest(rest, bins[:i] + [bins[i] + x] + bins[i + 1 :]))
        return min(out, fewest(rest, [*bins, x]))

    for _ in range(40):
        lengths = sorted((rng.randint(1, 10) for _ in range(7)), reverse=True)
        counts = dict(Counter(lengths))
        best = fewest(lengths, [])
        assert packing.least(counts, 10) <= best <= sum(n for _, n in packing.plan(counts, 10))


def test_op3_ids_of_added_tokens():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z <|endof text|>", "plain words", "", "<|endoftext|><|endoftext|> q"]
    ids, at = packing.Encoder(packing.tokenizer_path()).batch(pa.array(texts))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_op6_joins_frequent_grams_apart(spark, tmp_path, monkeypatch):
    pages = [(i, f"http://{'abc'[i % 3]}.example.{'org' if i % 2 else 'com'}/{['fr', 'de', 'es', 'en'][i % 4]}/{i % 7}", "x", "clash") for i in range(200)] + [(1, None, "x", "clash"), (2, "http://example.org/en/" + "y" * 3000, "x", "clash")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    want = sorted(map(str, urls.op6_urls(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(urls, "MOST_BROADCAST", 0)
    monkeypatch.setattr(urls, "HOT", 0.005)
    assert sorted(map(str, urls.op6_urls(spark, str(tmp_path)).collect())) == want and len(want) == 202


def test_pipeline_on_an_empty_table(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
