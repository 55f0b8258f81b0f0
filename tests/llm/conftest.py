import random

import pytest

LETTERS = {"en": "the and of tion ing her wh st".split(), "de": "sch ung ein der und keit lich ß".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    """(doc_id, text, lang, source): prose, near copies, copies, nulls, empties, odd white space, one very long text."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(rng, lang, rng.randint(1, 120)), lang, f"s{i % 4}"))
    for i in range(60, 75):
        words = rows[i - 60][1].split()
        if len(words) > 40:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    rows += [(80, None, "en", "s1"), (81, "", None, None), (82, " \t\n", "en", None), (83, "A", "en", "s9"), (84, "a  b\x0bc\u00a0d\u0085e", "en", "s9"), (85, prose(rng, "en", 6000), "en", "s0"), (86, "123 456 !!!", "en", "s2"), (87, "x" * 5000, "de", "s2")]
    rows += [(90 + i, rows[3][1], "en", "s0") for i in range(5)]
    return rows


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """documents with a clashing extra column, in a few files."""
    path = tmp_path_factory.mktemp("sf")
    rows = [(i, t, lang, s, len(t or ""), "extra") for i, t, lang, s in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def texts():
    return {i: t for i, t, _, _ in corpus()}
