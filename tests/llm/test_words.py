"""Source audit, decontamination and fill-in-the-middle against plain definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import audit, leaks, middles

LETTERS = ["a", "Bc", "ß", "é", "日本", "x1", " ", "-", " ", "\n", "Z", "\U0001f600", "<", "<P", "."]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def soup(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


# -- fill-in-the-middle


def test_op13_rank_and_select():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 3000):
        raw = soup(rng, n).encode()
        points = middles.Boundaries(np.frombuffer(raw, np.uint8))
        begins = [i for i, b in enumerate(raw) if b & 0xC0 != 0x80]
        assert points.rank(np.arange(len(raw) + 1)).tolist() == [sum(b < i for b in begins) for i in range(len(raw) + 1)]
        assert points.select(np.arange(len(begins) + 1)).tolist() == [*begins, len(raw)]


def plain_cut(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def test_op13_against_plain_cuts(spark):
    rng = random.Random(2)
    rows = [(i, soup(rng, rng.choice([0, 1, 2, 5, 40, 700]))) for i in range(300)]
    rows += [(None, "null id é"), (None, None), (-5, "negative"), (7, None), (8, ""), (9, "has <M> inside"), (9, "has <M> inside"), (10, "é" * 200_000 + "x"), (11, "<<S" * 50), (12, "<"), (13, "\u0000nul")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, output string, n int").repartition(3)
    got = middles.transformed(docs)
    out = sorted(map(tuple, got.collect()), key=str)
    assert out == sorted((plain_cut(*r) for r in rows), key=str)
    assert {"plain", "psm", "spm"} == {r[2] for r in out}
    back = got.select("output", "form", middles.restored(got.output, got.form).alias("text")).collect()
    assert Counter(r.text for r in back) == Counter(t or "" for _, t in rows)


def test_op13_query(spark, folder, empty, texts):
    got = middles.op13_middles(spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) for r in got} == {(*(x := plain_cut(i, t))[:5], sha(x[5])) for i, t in texts.items()}
    assert all(r.restored_sha256 == sha(texts[r.doc_id] or "") for r in got)
    assert middles.op13_middles(spark, empty).count() == 0


# -- decontamination


def plain_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, ids = set(), set()
    for item_id, item in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(item))
        runs = [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []
        for run in runs:
            for i in range(len(words) - len(run) + 1):
                if words[i : i + len(run)] == run:
                    hit |= set(range(i, i + len(run)))
                    if item_id is not None:
                        ids.add(str(item_id))
    return words, hit, ids


ITEMS = [(3, "Alpha beta, gamma DELTA epsilon zeta eta theta iota kappa lambda mu"), (20, "short ITEM"), (1, "w w w w w w w w w w w"), (4, None), (5, "!!"), (None, "no id here"), (100, "short item"), (21, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def leaky(rng):
    bits = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "Short-item", "w " * 12, "no id here!", "other words", "alpha beta", "delta epsilon zeta eta theta iota kappa lambda mu nu", "é日本", " .. ", "\n"]
    return rng.choice(["", " ", "~ "]) + rng.choice([" ", "; ", "\t"]).join(rng.choice(bits) for _ in range(rng.randint(0, 7))) + rng.choice(["", "!", "\n"])


@pytest.fixture
def leaky_docs(spark):
    rng = random.Random(4)
    rows = [(i // 2, leaky(rng)) for i in range(240)] + [(None, "short item"), (None, None), (900, ""), (901, "- -"), (902, "x " * 40_000 + "short item"), (902, "x " * 40_000 + "short item")]
    docs = spark.createDataFrame([(*r, 1, "k", 2.5) for r in rows], "doc_id long, text string, n_words int, row string, hash double").repartition(3)
    bench = spark.createDataFrame([(*r, "x") for r in [*ITEMS, ITEMS[1]]], "item_id long, text string, length string")
    return rows, docs, bench


@pytest.mark.parametrize("most", [leaks.MOST_BROADCAST, 0])
def test_op12_against_plain_windows(spark, leaky_docs, monkeypatch, most):
    monkeypatch.setattr(leaks, "MOST_BROADCAST", most)
    rows, docs, bench = leaky_docs
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in leaks.report(docs, bench).collect())
    want = Counter((i, len(w), len(h), tuple(sorted(ids))) for i, t in rows for w, h, ids in [plain_hits(t, ITEMS)])
    assert got == want
    assert sum(1 for x in want if x[2]) > 20


def test_op12_removes_spans_or_documents(spark, leaky_docs):
    rows, docs, bench = leaky_docs
    left = leaks.removed(docs, bench, documents=True)
    assert left.columns == docs.columns
    clean = [(i, t) for i, t in rows if not plain_hits(t, ITEMS)[1]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, clean))

    def cleaned(text):
        words, hit, _ = plain_hits(text, ITEMS)
        if not hit:
            return text
        parts = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+", text)
        out, nth = [], -1
        for part in parts:
            if re.match(r"[0-9A-Za-z\x80-\U0010ffff]", part):
                nth += 1
                out.append("" if nth in hit else part)
            else:
                out.append("" if nth in hit and nth + 1 in hit else part)
        return "".join(out)

    masked = leaks.removed(docs, bench)
    assert masked.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text, r.row) for r in masked.collect()))) == sorted(map(str, ((i, cleaned(t), "k") for i, t in rows)))


def test_op12_empty_tables(spark, leaky_docs):
    rows, docs, bench = leaky_docs
    none = leaks.report(docs, bench.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.n_hit for r in none)
    assert leaks.report(docs.limit(0), bench).count() == 0
    assert Counter((r.doc_id, r.text) for r in leaks.removed(docs, bench.limit(0)).collect()) == Counter(rows)


def test_op12_is_native(spark, folder, tmp_path):
    import os

    os.symlink(f"{folder}/documents.parquet", tmp_path / "documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plan = leaks.op12_leaks(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# -- source audit


def plain_audit(docs, least=3, top=200):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))) for text, lang, source in docs]
    df, occurs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in terms:
        df[lang].update(set(words))
        occurs[lang, source].update(words)
    out = []
    for lang in {x[0] for x in terms}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for a, s in occurs if a == lang)
        whole = sum((occurs[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        of, q = {s: shares(occurs[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(x, sum(f(of[s][t], of[x][t]) for t in kept)) for x in sources if x != s]
            own = [(t, f(of[s][t], q[t])) for t in kept if occurs[lang, s][t] and of[s][t] > q[t]]
            for part, rows, limit in (("pair", pairs, None), ("term", own, top)):
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:limit])]
    return out


@pytest.mark.parametrize("block", [audit.BLOCK, 7])
def test_op11_against_plain_counts(spark, block):
    rng = random.Random(6)
    words = [soup(rng, rng.randint(1, 3)) for _ in range(80)] + ["The", "the", "THE", "ß", "\U0001f600", "￿"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40]))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "d"])) for _ in range(200)]
    rows += [(None, "en", "empty"), ("", "xx", "one"), ("123 !!", "xx", "two"), ("only here", "xx", "three"), ("a b", "yy", "alone"), ("abc", "en", "a"), ("abc", "en", "a"), ("x" * 300_000, "en", "a")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    got = sorted(map(tuple, audit.divergence(docs, block=block).collect()))
    assert got == sorted(plain_audit(rows))
    assert {r[0] for r in got} == {"en", "de", "", "xx"}
    assert audit.divergence(docs, top=2, block=block).filter("part = 'term'").count() == len([r for r in plain_audit(rows, top=2) if r[2] == "term"])


def test_op11_texts_that_touch_and_hashes_that_meet():
    texts = pa.array(["ab", "CD", "", "é", "x-Ab", "cd cd"] * 3)
    buffer, starts, ends, row = audit.slices(texts)
    found = [bytes(buffer[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == ["ab", "cd", "é", "x", "ab", "cd", "cd"] * 3
    assert row.tolist() == [k + 6 * i for i in range(3) for k in (0, 1, 3, 4, 4, 5, 5)]
    for hashed in (audit.xxhash.xxh3_64_intdigest, lambda b: 1, lambda b: len(b)):
        first, term = audit.grouped(buffer, starts, ends, hashed)
        assert [found[first[k]] for k in term] == found
        assert len(first) == 4


def test_op11_exact_beyond_doubles(spark):
    at = spark.createDataFrame([(3_000_000_000_000_000, 8_000_000_000_000_001, 7)], "n long, total long, terms long")
    assert at.select(audit.share(at.n, at.total, at.terms)).first()[0] == 1 + 10**9 * 3_000_000_000_000_001 // 8_000_000_000_000_008


def test_op11_empty_table(spark, empty):
    assert audit.op11_audit(spark, empty).count() == 0


