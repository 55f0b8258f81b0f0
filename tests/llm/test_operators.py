"""The queries on a small corpus with odd rows, against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import dedup, fingerprints, html, language, lm, media, minhash, mixing, packing, registry, secrets, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, empty, name):
    assert registry.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_op1_against_recursion(spark, folder, texts, order, monkeypatch):
    monkeypatch.setattr(lm, "ORDER", order)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", (lm.common.remainder("doc_id", 7) == 2).alias("held")).fillna("", ["text"])
    got = by_id(lm.scored(docs, order)) if order != 2 else by_id(lm.op1_lm(spark, folder))
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    counts = {k: Counter() for k in range(1, order + 1)}
    for i, t in tokens.items():
        if fold(i, 7) != 2:
            padded = ["<"] * (order - 1) + t
            for j in range(order - 1, len(padded)):
                for k in counts:
                    counts[k][tuple(padded[j - k + 1 : j + 1])] += 1
    d = {k: lm.discounts([Counter(c.values())[r] for r in range(1, 7)]) for k, c in counts.items()}
    n, v = sum(counts[1].values()), len(counts[1])
    less = lambda k, c: c * (d[k][c] if c <= 5 else 1)
    unknown = sum(c - less(1, c) for c in counts[1].values()) / n
    after = {k: defaultdict(dict) for k in counts}
    for k in range(2, order + 1):
        for g, c in counts[k].items():
            after[k][g[:-1]][g[-1]] = c

    def p(w, h):
        if not h:
            return less(1, counts[1][(w,)]) / n if (w,) in counts[1] else unknown
        k, seen = len(h) + 1, after[len(h) + 1].get(h)
        if not seen:
            return p(w, h[1:])
        total = sum(seen.values())
        lost = sum(c - less(k, c) for c in seen.values())
        whole = total if lost > 0 else total + 1
        if w in seen:
            return less(k, seen[w]) / whole
        return (lost if lost > 0 else 1) / whole / (1 - sum(p(x, h[1:]) for x in seen)) * p(w, h[1:])

    for i, t in tokens.items():
        padded = ["<"] * (order - 1) + t
        want = sum(math.log10(p(padded[j], tuple(padded[j - order + 1 : j]))) for j in range(order - 1, len(padded))) if i % 4 == 0 or i >= 80 and i != 85 else None
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.held_out, r.n_known) == (len(t), n, fold(i, 7) == 2, sum((w,) in counts[1] for w in t))
        assert r.base_score == pytest.approx(sum(math.log10((counts[1][(w,)] + 1) / (n + v + 1)) for w in t))
        assert want is None or r.score == pytest.approx(want)
    history = tuple(["<"] * (order - 1))
    assert sum(p(w, history) for (w,) in counts[1]) + p("never seen", history) == pytest.approx(1)


def test_op1_discounts():
    assert lm.discounts([100, 40, 20, 12, 8, 5])[1] == pytest.approx((2 * 40 / 100 - 6 * 5 / 100) / (1 - 6 * 5 / 100))
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [9, 9, 9, 9, 9, 9]):
        assert all(0 < x < 1 for x in lm.discounts(odd)[1:])


def test_op2_against_sets(spark, folder, texts):
    got = by_id(fingerprints.op2_fingerprints(spark, folder))
    order = sorted(texts, reverse=True)
    assert set(got) == set(order)

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    prints = {}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        text, other = texts[i] or "", texts[after] or ""
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for near, x in ((r.near_edited, edited), (r.near_next, other)):
            a, b = shingles(text), shingles(x)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[81].near_next == 1  # an empty text after another


def test_op2_few_rows(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    r = fingerprints.edited_fingerprints(one).first()
    assert r.near_next == 1
    ties = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert fingerprints.edited_fingerprints(ties).count() == 3


def test_op3_round_trip(spark, folder, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op3_packing(spark, folder).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    total = 0
    for i, t in texts.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and (len(own) == 1 or len(ids) > 2048)
        assert all(zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) == r.ids_crc32 for r in own)
    assert len(bins) <= -(-total // 2048) + 1


def test_op3_same_ids_as_the_tokenizer_library():
    from tokenizers import Tokenizer

    odd = ["", " ", "a  b", "a \nb", "\n x", "tail ", "x  y \u3000z", "don't  stop", None, "a\n\n b", "\n \n b", "a\x1c \x1db", "<|endoftext|> x <|endoftext|>", "x" * 300, " lead", "é à ß", "1 2 3", "it's we'll", "a \u00a0b", "\u2028 x", "tab\t y"]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids, starts = packing.Encoder(packing.tokenizer_path()).batch(pa.array(odd, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("seed", range(4))
def test_op3_plan_covers_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 60 if seed else 2, 400)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    got = packing.plan(counts, 64, 10)
    held = Counter()
    for config, times in got:
        assert sum(k * a for k, a in config) <= 64
        for k, a in config:
            held[k] += a * times
    room: list[int] = []  # first fit decreasing, to compare with
    for x in sorted(map(int, lengths), reverse=True):
        k = next((k for k, r in enumerate(room) if r >= x), None)
        if k is None:
            room.append(64 - x)
        else:
            room[k] -= x
    assert held == counts and sum(n for _, n in got) <= len(room)


def test_op3_program_is_no_worse_than_its_bound():
    counts = {7: 30, 5: 30, 4: 60}  # 7 + 5 + 4 fills 16 exactly, as do four fours
    assert sum(n for _, n in packing.plan(counts, 16, 20)) == 38


@pytest.mark.parametrize("low,high", [(500, 1199), (600, 759)])
def test_op3_plan_is_the_programs(monkeypatch, low, high):
    """The plan begins with rounded columns; best fit alone, which packs lengths up to the capacity well, takes more here."""
    rng, kept = np.random.default_rng(3), []
    lengths, counts = np.unique(rng.integers(low, high + 1, 30_000), return_counts=True)
    counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    rounded = packing.rounded
    monkeypatch.setattr(packing, "rounded", lambda *a: kept.append(rounded(*a)) or kept[-1])
    number = lambda configs: sum(n for _, n in configs)
    plan = packing.plan(counts)
    assert any(plan[: len(k)] == k for k in kept)
    held = Counter()
    for config, times in plan:
        for k, a in config:
            held[k] += a * times
    alone = number(packing.fill(packing.histogram(counts, 2048), 2048))
    assert held == counts and packing.least(counts) <= number(plan) <= alone
    assert number(plan) < 0.99 * alone and max(number(k) for k in kept) > number(plan) / 4


SPELLED = {"id": "AK" + "IA" + "ABCDEFGHIJKLMNOP", "secret": "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz12345678"}


def test_op4_against_patterns(spark, folder, texts):
    got = by_id(secrets.op4_secrets(spark, folder))
    for i, t in texts.items():
        base = secrets.base_spans(t or "")
        assert (got[i].n_assign, got[i].base_sha256) == (sum(k == "assign" for k, _, _ in base), hashlib.sha256(secrets.joined(base).encode()).hexdigest())


def test_op4_base_is_leftmost_and_dropped_only_after():
    text = f'é Token: secret: abcdefghij PASSWORD = "abcdefgh" api_key=short {SPELLED["id"]} {"ab12" * 8}x {"ab12" * 7}'
    spans = secrets.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in spans] == [("assign", 'PASSWORD = "abcdefgh'), ("access", SPELLED["id"]), ("hex", "ab12" * 8)]


def test_op4_links_only_complements(spark):
    far = "word " * 200
    cases = {
        1: f"{SPELLED['id']} and {SPELLED['secret']} at https://api.corp.example",
        2: f"{SPELLED['secret']} alone at https://api.corp.example",
        3: f"{SPELLED['id']} {far} {SPELLED['secret']}",
        4: f"{SPELLED['id']}\n\n{SPELLED['secret']}",
        5: f"username = alice\n{SPELLED['secret']}",
        6: None,
    }
    docs = spark.createDataFrame([(i, t) for i, t in cases.items()] + [(1, cases[1])], "doc_id long, text string")
    got = defaultdict(list)
    for r in secrets.found_spans(docs).collect():
        got[r.doc_id].append(sorted((s.kind, cases[r.doc_id][s.start : s.end]) for s in r.added))
    one = [("endpoint", "https://api.corp.example"), ("secret", SPELLED["secret"])]
    assert got == {1: [one, one], 2: [[]], 3: [[]], 4: [[]], 5: [[("identifier", "username = alice"), ("secret", SPELLED["secret"])]], 6: [[]]}
    masked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert SPELLED["secret"] not in masked[1] and SPELLED["secret"] in masked[2] and masked[6] is None and masked[1].count(secrets.MASK) == 3


def test_op4_links_values_after_an_equals_sign(spark):
    key = "Eby8vdM02xNOcqFlqUwJPLlmEtlCDXJ1OUzFT50uSRZ6IFsuFq2UVErCz4I6tq/K1SZFPTOtr/KBHBeksoGMGw=="
    base64 = SPELLED["secret"]
    cases = {
        1: f"aws_access_key_id={SPELLED['id']}\naws_secret_access_key={base64}",
        2: f"aws_access_key_id=ASIAQWERTYUIOPLKJHGF\naws_secret_access_key={base64}",
        3: f"DefaultEndpointsProtocol=https;AccountName=devstore1;AccountKey={key};EndpointSuffix=x",
        4: f"storage_account=devstore1\nstorage_access_key={key}",
        5: f"db_user=alice\ndb_key='{base64}'",
        6: f"aws_secret_access_key={base64}",
        7: f"aws_access_key_id:ASIAQWERTYUIOPLKJHGF aws_secret_access_key:{base64}",
    }
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r.doc_id: sorted((s.kind, cases[r.doc_id][s.start : s.end]) for s in r.added) for r in secrets.found_spans(docs).collect()}
    assert got == {
        1: [("secret", base64)],
        2: [("identifier", "access_key_id=ASIAQWERTYUIOPLKJHGF"), ("secret", base64)],
        3: [("identifier", "AccountName=devstore1"), ("secret", key)],
        4: [("identifier", "account=devstore1"), ("secret", key)],
        5: [("identifier", "user=alice"), ("secret", base64)],
        6: [],
        7: [("identifier", "access_key_id:ASIAQWERTYUIOPLKJHGF"), ("secret", base64)],
    }
    for r in secrets.redacted(docs).collect():
        assert (base64 in r.text or key in r.text) == (r.doc_id == 6)


@pytest.mark.parametrize("size", [500, 900, 1200])
def test_op4_links_what_follows_a_long_base_span(spark, size):
    after = " user=alice https://api.corp.example"
    cases = {i: "x" * (i * 50) + " token=" + "aB3." * (size // 4) + after for i in range(9)}
    cases[9] = "https://api.corp.example user=alice token=" + "aB3." * (size // 4)
    cases[10] = cases[0][: -len(after)] + " word" * 100 + after
    docs = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    got = {r.doc_id: sorted((s.kind, cases[r.doc_id][s.start : s.end]) for s in r.added) for r in secrets.found_spans(docs).collect()}
    both = [("endpoint", "https://api.corp.example"), ("identifier", "user=alice")]
    assert got == {i: both for i in range(10)} | {10: []}


def components(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op5_against_all_pairs(spark, folder, texts):
    got = by_id(dedup.op5_dedup(spark, folder))
    want = components(texts, 4, 80)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][1]) for i, r in got.items())


def test_op5_chains_beyond_the_bucket_star(spark, monkeypatch):
    """Texts that drift: each is near its neighbours only, so components need links that no star holds."""
    monkeypatch.setattr(dedup, "CHUNK", 3)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(14):
        t = list(base)
        for k in range(0, 6 * i, 6):
            t[k % 120] = f"z{k}"
        texts[i] = " ".join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(docs, 2, 80).collect()}
    assert got == {i: c for i, (_, c) in components(texts, 2, 80).items()}


def test_op5_many_copies_of_one_set(spark, monkeypatch):
    """More copies than one salt holds, beside a near copy, a set of its own, rows without a set and without an id."""
    monkeypatch.setattr(dedup, "CHUNK", 3)
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, text if i % 2 else text.upper()) for i in range(5, 30)] + [(3, text + " x"), (40, "a text of its own"), (41, ""), (42, None), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect())
    alone = [("40", 40, True), ("41", 41, True), ("42", 42, True), ("None", None, True), ("None", None, True)]
    assert got == sorted([(str(i), 3, i == 3) for i in (3, *range(5, 30))] + alone)
    numbers = sorted((str(r.doc_id), r.class_id, r.n_links) for r in fingerprints.link_numbers(docs).collect())
    assert numbers == sorted([("3", 3, 1), ("40", 40, 0), ("41", None, 0), ("42", None, 0), ("None", None, 0), ("None", None, 0)] + [(str(i), 5, 1) for i in range(5, 30)])


def test_op5_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + " x"), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert sorted(str(r.doc_id) for r in dedup.unique(docs).collect()) == ["1", "3", "None"]


def test_op5_bounds_keep_what_is_near():
    least = dedup.least_matches(96, 0.8)
    rng = np.random.default_rng(1)
    hits = rng.random((20_000, 96)) < 0.8
    alive = np.ones(len(hits), bool)
    for k, m in enumerate(least, 1):
        alive &= hits[:, : 16 * k].sum(1) >= m
    assert alive.mean() > 0.995


@pytest.mark.parametrize("chunk", [3, 1000])
def test_op2_links_against_all_pairs(spark, texts, chunk, monkeypatch):
    """Every pair of a group of near copies is told, once, also where the group is one component."""
    monkeypatch.setattr(dedup, "CHUNK", chunk)
    base = [f"w{k}" for k in range(300)]
    copies = {1000 + i: " ".join([*base[: 7 * i], f"z{i}", *base[7 * i + 1 :]]) for i in range(16)}
    every = copies | texts | {2000: copies[1003].upper(), 2001: None}
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = [tuple(r) for r in fingerprints.links(docs).collect()]
    first = {}
    for i, t in sorted(every.items()):
        w = words(t)
        first.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), i)
    want = {(i, j, len(x & y), len(x | y)) for x, i in first.items() for y, j in first.items() if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y)}
    assert sum(a >= 1000 for a, *_ in want) == 120 and sorted(got) == sorted(want)


def test_minhash_agrees_with_sets():
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(60, 360))
    h, starts = minhash.shingled(pa.array([a, b, "", "w1", None]), 1)
    s = minhash.signatures(h, starts, 512)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.08 and (s[2] == s[4]).all()


PAGES = [(1, "http://A.example.com/fr/1?x"), (2, "https://example.org/es/9"), (3, "https://example.org/en/12"), (4, "https://example.org/en/2"), (5, "https://x.net/en/2"), (6, None), (7, "nothing"), (8, "https://a.com/de/1#f"), (9, "http://b.org"), (10, "HTTP://C.ORG/Path?q"), (10, "HTTP://C.ORG/Path?q"), (11, "x://com/de/" + "y" * 4000)]


def test_op6_rules(spark, tmp_path):
    spark.createDataFrame([(i, u, "") for i, u in PAGES], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.host, r.path[:20], r.rule) for r in urls.op6_urls(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "a.example.com", "/fr/1", "com/fr/"), (2, "example.org", "/es/9", "example.org/es/"), (3, "example.org", "/en/12", "example.org/en/1"), (4, "example.org", "/en/2", "org/"),
        (5, "x.net", "/en/2", None), (6, "", "", None), (7, "", "", None), (8, "a.com", "/de/1", "com/de/"), (9, "b.org", "", None), (10, "c.org", "/Path", "org/"), (11, "com", "/de/" + "y" * 16, "com/de/"),
    }


def test_op6_model_is_normalised_and_separates(spark):
    good, bad = [f"https://{a}.org/news/{i}" for i in range(20) for a in "abc"], [f"https://{a}.org/spam/{i}" for i in range(20) for a in "abc"]
    fresh = ["https://q.net/news/5", "https://q.net/spam/5"]
    rules = [("allow", f"{a}.org/news/") for a in "abc"] + [("block", f"{a}.org/spam/") for a in "abc"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + fresh)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, rules).collect()}
    assert (got[120], got[121]) == ("allow", "block")
    plan = urls.judged(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_op7_accuracy_and_undetermined(spark, folder):
    got = by_id(language.op7_language(spark, folder))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (80, 81, 82, 86))
    held = [i for i in range(60) if fold(i, 5) == 0]
    assert all(got[i].held_out for i in held)
    assert sum(got[i].lang_pred == ("en" if i % 3 else "de") for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_op7_many_languages_and_no_learning(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 9 + " " + f"{chr(97 + i // 26)}q{chr(97 + i % 26)}" * 5, f"l{i:03}") for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language.fit(docs)
    assert filters.array.shape[1] == 2
    got = language.detect(docs, filters)
    assert got.filter("lang_pred = lang").count() >= 68
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.detect(docs, none).collect()} == {"und"}


def test_op8_round_trip(spark, folder, texts):
    got = by_id(media.op8_media(spark, folder))
    for i, t in texts.items():
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(padded) + 44, hashlib.sha256(media.stored(padded)).hexdigest())


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_op8_sniffs_corrects_and_carves(spark):
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00;"
    blobs = {
        1: (png(), "image/jpeg", "image/png"), 2: (b"text " + png() + b" and " + gif, "text/plain", "text/plain"), 3: (media.stored(png() + b"\0" * (len(png()) % 2)), None, "audio/wav"),
        4: (z.getvalue(), "application/zip", "application/zip"), 5: (gzip.compress(b"x" * 1000), "text/plain", "application/gzip"), 6: (png()[:-5], "image/png", "application/octet-stream"),
        7: (b"", "image/png", "application/x-empty"), 8: (None, None, "application/x-empty"), 9: (b"RIFF\xff\xff\xff\xffWAVEfmt ", "audio/wav", "application/octet-stream"), 10: (b"BM" * 50, "text/plain", "text/plain"),
        11: (gif, "image/gif", "image/gif"),
    }
    df = spark.createDataFrame([(i, b, d, "own") for i, (b, d, _) in blobs.items()], "id int, blob binary, declared string, media_type string")
    got = {r.id: r for r in media.sniff(df, "blob", "declared").collect()}
    assert {i: r.media_type for i, r in got.items()} == {i: w for i, (_, _, w) in blobs.items()}
    assert [bytes(x.content) for x in got[2].embedded] == [png(), gif] and bytes(got[3].embedded[0].content) == png()
    assert (got[1].was_declared_right, got[4].was_declared_right, got[3].was_declared_right) == (False, True, None)


def test_op9_meets_targets(spark, folder, texts):
    rows = mixing.op9_mixing(spark, folder).collect()
    again = mixing.op9_mixing(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(texts)
    assert all(r.size == len(words(texts[r.doc_id])) and r.taken <= 3 * r.size for r in rows)
    taken, targets, longest = Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        longest[source[r.doc_id]] = max(longest[source[r.doc_id]], r.size)
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in rows))
    assert all(abs(taken[s] - t) <= longest[s] + 1 for s, t in targets.items())


def test_op9_reshares_the_excess(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 100), ("c", 200), ("d", 0), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    total, weights, tops = 1310.0, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 30.0, "b": 300.0, "c": 600.0, "d": 0.0, None: 3000.0}
    stopped: dict = {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in stopped}
        level = (total - sum(stopped.values())) / sum(rest.values())
        more = {s: tops[s] for s, w in rest.items() if level * w > tops[s]}
        if not more:
            break
        stopped |= more
    assert got == pytest.approx({s: stopped.get(s, level * w) for s, w in weights.items()})


def test_op9_copies_are_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = {r.doc_id: r.copies for r in mixing.mixed(docs).collect()}
    got = Counter(r.doc_id for r in mixing.repeated(docs).collect())
    assert got == Counter({i: n for i, n in plan.items() if n})
    ties = spark.createDataFrame([(1, "a b", "s"), (1, "c d", "s"), (None, "e", "s"), (None, "f", "s")], "doc_id long, text string, source string")
    assert mixing.repeated(ties).count() == 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies, ok?</div><div id=content><article><h1>Title &amp; more</h1>
<p>First,   with <b>bold</b> and&nbsp;space.<p>Second &lt;tag&gt; line.<br>Same block.<ul><li>One item, here.<li>Two items, there.</ul>
<aside>Related: <a href=/c>C</a></aside><div class="ad">Buy now!</div><form><input><button>Go</button></form><section class=comments><p>I agree, great post.</p></section></article></div>
<div class="sidebar"><p>Popular, posts.</p></div><footer>&copy; 2024, all rights.</footer></body></html>"""


def test_op10_extracts_the_article(spark, tmp_path):
    soup = '<div class="page"><div class="left"><a href=x>x</a></div><div><div>Long first paragraph, with a comma. And a second sentence.</div><div>Another long paragraph; it has words, too.</div></div></div><div class="Newsletter-Signup">Join us, now.</div>'
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just text &eacute;"), (5, "u", soup), (6, "u", "<p>" * 3000 + "deep, text."), (7, "u", '<p title="unclosed>broken, but there</p><p>next</p>'), (7, "u", "<nav>only menu</nav>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = defaultdict(set)
    for r in html.op10_html(spark, str(tmp_path)).collect():
        assert r.n_chars == len(r.text)
        got[r.page_id].add(r.text)
    assert got[1] == {"Title & more\nFirst, with bold and space.\nSecond <tag> line. Same block.\nOne item, here.\nTwo items, there."}
    assert got[2] == got[3] == {""} and got[4] == {"just text é"} and got[6] == {"deep, text."}
    assert got[5] == {"Long first paragraph, with a comma. And a second sentence.\nAnother long paragraph; it has words, too."}
    assert "" in got[7]


LONG = "A long paragraph, with many words; it goes on, and on. " * 8
BESIDE = {
    "title and lead": f"<body><div class=post><h1>Title</h1><div class=lead>Short lead.</div><div class=entry><p>{LONG}</p><p>{LONG}</p></div></div></body>",
    "nested": f"<body><div><div><h1>Title</h1></div><div>By <a href=/j>Jane Doe</a></div><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div></body>",
    "sections": f"<body><div class=a><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div></div><div class=b><span>{LONG[:330]}</span></div></body>",
    "articles": f"<body><div><article><p>{LONG}</p><p>{LONG}</p></article><article><p>{LONG}</p></article><article><p>Short.</p></article></div></body>",
    "list of links": f"<body><article><h1>Title</h1><p>{LONG}</p><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></article></body>",
    "references": f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><div><h2>References</h2><ul><li><a href=/1>One</a></li></ul></div></div></body>",
    "boilerplate": f"<body><div><a href=/>Home</a> | <a href=/b>Blog</a></div><div class=menu>Menu, here.</div><div><p>{LONG}</p><p>{LONG}</p></div><div class=comments><article><p>I agree, and more.</p></article></div></body>",
    "comments": f"<body><main><div class=has-sidebar><article><h1>Title</h1><p>{LONG}</p></article></div><section id=comments><article><p>I agree, and more.</p></article></section></main></body>",
    "related": f"<body><article><p>{LONG}</p></article><article class='card related'><p>Another page, elsewhere.</p></article></body>",
}


def test_op10_keeps_what_stands_beside_the_longest_part():
    long = LONG.strip()
    assert {k: html.main_text(v).split("\n") for k, v in BESIDE.items()} == {
        "title and lead": ["Title", "Short lead.", long, long],
        "nested": ["Title", "By Jane Doe", long, long],
        "sections": [long, long, long, LONG[:330].strip()],
        "articles": [long, long, long, "Short."],
        "list of links": ["Title", long, "One", "Two"],
        "references": [long, long, "References", "One"],
        "boilerplate": [long, long],
        "comments": ["Title", long],
        "related": [long],
    }


def test_op10_ratios_against_sums():
    page = f"<div class='a b'><p>{LONG}</p><p>One, two.</p><ul><li><a href=/>x y</a> z</li></ul></div><div class=c><p>Q!</p></div>"
    nodes, found = html.blocks_of(page)
    label = lambda n: "" if n.up is None else f"{label(n.up)}/{n.tag}"
    paths = [("/div.a/p", LONG.strip(), 0), ("/div.a/p", "One, two.", 0), ("/div.a/ul/li", "x y z", 3), ("/div.c/p", "Q!", 0)]
    assert [(label(n), t, x) for n, t, x in found] == [(p.replace(".a", "").replace(".c", ""), t, x) for p, t, x in paths]
    raw = {}
    for p in {p for p, _, _ in paths}:
        own = [(t, x) for q, t, x in paths if q == p]
        raw[p] = (sum(len(t) - x for t, x in own) / len(own), sum(sum(c in ".,;:!?" for c in t) for t, _ in own) / len(own))
    for (n, _, _), (p, _, _) in zip(found, paths, strict=True):
        a, b = raw[p]
        others = [v for q, v in raw.items() if q != p and q.rpartition("/")[0] == p.rpartition("/")[0]]
        if others:
            a, b = ((2 * v + sum(o[i] for o in others) / len(others)) / 3 for i, v in enumerate((a, b)))
        assert html.ratios(found, nodes)[n.path] == pytest.approx(a * (b + 0.1))
    assert html.main_text(page) == f"{LONG.strip()}\nOne, two.\nx y z"


def test_op10_ratios_choose_where_markup_is_silent(monkeypatch):
    plain = f"<body><div><a href=/>Home</a> <a href=/b>Blog</a></div><div>Buy it now.</div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div>All rights, 2024.</div></body>"
    assert html.main_text(plain).split("\n") == ["Title", LONG.strip(), LONG.strip()]
    monkeypatch.setattr(html, "ratios", lambda found, nodes: {n.path: 1.0 for n, _, _ in found})
    assert "Buy it now." in html.main_text(plain)


KEPT = {
    '<p class="legal">Legal text, here.</p>': ["Legal text, here."], '<p class="search">Search text.</p>': ["Search text."], '<div class="share-prices"><p>Prices rose.</p></div>': ["Prices rose."],
    '<section class="related-work"><p>Others did this.</p></section>': ["Others did this."], '<p id="header-files">Header files.</p>': ["Header files."], '<h2 id="menu">Menu</h2>': ["Menu"],
    '<h2 id="related-work">Related work</h2>': ["Related work"], "<p>Press <button>Start</button> now</p>": ["Press Start now"], "<p>A <svg><text>q</text></svg> B</p>": ["A B"],
    '<div class="section-header"><h2>Part two</h2></div>': ["Part two"], "<header><h2>Part</h2><p>By Jane</p></header>": ["Part", "By Jane"], '<section id="menu"><p>Soup, and fish.</p></section>': ["Soup, and fish."],
    '<div class="share"><a href=x>Tweet</a> <a href=y>Post</a></div>': [], '<div class="ad">Buy now!</div>': [], "<section class=comments><h3>Comments</h3><p>I agree, great post.</p></section>": [],
    '<div class="cookie-notice">We use, ok?</div>': [], '<div class="promo-box"><p>Sale, now.</p></div>': [], "<p><button>Go</button></p>": [], "<div><button><b>Go</b></button></div>": [],
    '<ul class="menu"><li><a href=/a>A</a></ul>': [], "<select><option>One<option>Two</select>": [], '<div class="related"><a href=/x>Read this, too</a></div>': [], "<div class=header><a href=/>Home</a></div>": [],
}


@pytest.mark.parametrize("part", KEPT)
def test_op10_names_weigh_on_whole_parts_by_what_is_in_them(part):
    page = f"<html><body><nav><a href=/>x</a></nav><article><h1>T</h1><p>{LONG}</p>{part}<p>{LONG}</p></article><footer>F, x.</footer></body></html>"
    assert html.main_text(page).split("\n") == ["T", LONG.strip(), *KEPT[part], LONG.strip()]


def test_op10_titles_in_headers():
    long = LONG.strip()
    assert html.main_text(f'<body><div class="main-header"><h1>Title</h1><p>Tag, line.</p></div><div><p>{LONG}</p><p>{LONG}</p></div><div>All rights, 2024.</div></body>').split("\n") == ["Title", long, long]
    assert html.main_text(f'<body><div class="post"><header><h1>Title</h1></header><p>{LONG}</p><p>{LONG}</p></div></body>').split("\n") == ["Title", long, long]
    assert html.main_text(f"<body><header><h1><a href=/>Site</a></h1></header><div><h1>Title</h1><p>{LONG}</p></div></body>").split("\n") == ["Title", long]
    assert html.main_text(f"<body><header><h1>Site</h1></header><article><h2>Title</h2><p>{LONG}</p></article></body>").split("\n") == ["Title", long]


@pytest.mark.parametrize("seed", range(20))
def test_op10_choice_and_ancestor_against_definitions(seed):
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "section", "p", "h2"] if depth else ["p", "h2"])
        own = " ".join(rng.choice(["word", "other, word.", "<a href=/>link</a>"]) for _ in range(rng.randint(0, 9)))
        return f"<{tag} class={rng.choice('ab')}>{own}{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3))) if tag in ('div', 'section') else ''}</{tag}>"

    nodes, found = html.blocks_of(f"<body>{tree(4)}{tree(4)}<p>Last, one.</p></body>")
    prior, fused = [rng.choice([1.0, 1 / 3]) for _ in nodes], html.ratios(found, nodes)
    paths = {(n.path, prior[n.number]): fused[n.path] * prior[n.number] for n, _, _ in found}
    threshold = min(np.mean(list(paths.values())), np.std(list(paths.values())))
    got = html.chosen(found, fused, prior)
    assert all(g == (fused[n.path] * prior[n.number] >= threshold) or abs(fused[n.path] * prior[n.number] - threshold) < 1e-9 for g, (n, _, _) in zip(got, found, strict=True))
    wanted = [rng.random() < 0.3 for _ in found]
    wanted[-1] |= not any(wanted)

    def line(n):
        return [*line(n.up), n] if n.up else [n]

    lines = [line(n) for (n, _, _), w in zip(found, wanted, strict=True) if w]
    low = [level[0] for level in zip(*lines) if len({n.number for n in level}) == 1][-1]
    while low.tag in {"p", "h2"} and low.up.tag:
        low = low.up
    assert html.common_ancestor(nodes, found, wanted) is low


def test_op10_keeps_formulas_objects_and_labels():
    page = "<article><p>Formula <math>a<mi>x</mi></math> is given.</p><object>Drawn, as text.</object><label>A label.</label><fieldset>A set.</fieldset></article>"
    assert html.main_text(page) == "Formula ax is given.\nDrawn, as text.A label.\nA set."


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "deep, text.", "<div>x, y." * 30_000, "<b>" * 50_000 + "</i>" * 50_000 + "z.", "<b>" * 50_000 + "<div>q.</div>" * 50_000, "<article>" * 30_000 + "a.", "<ul><li>" * 30_000 + "a."])
def test_op10_reads_deep_pages_in_linear_time(page):
    import time

    began = time.process_time()
    assert html.main_text(page)
    assert time.process_time() - began < 20


def test_op10_carries_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "<p>a, b.", "old", 3)], "page_id long, html string, text string, n_chars int")
    assert [r.asDict() for r in html.extract(pages).collect()] == [{"page_id": 1, "n_chars": 3, "text": "a, b."}]


def test_pipeline_against_its_stages(spark, folder, texts):
    import corpus_pipeline

    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = corpus_pipeline.common.stored(docs)
        sizes[name] = docs.count()
    assert {80, 81, 82, 86}.isdisjoint(r.doc_id for r in docs.collect())
    deduplicated = {i: c for i, (_, c) in components({i: t for i, t in texts.items() if i not in (80, 81, 82, 86)}, 5, 80).items()}
    assert sizes["near_duplicates"] == sizes["secrets"] == len(set(deduplicated.values()))
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
