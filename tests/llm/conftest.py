import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, and one that differs from another in case alone.
CLASH = DOCS + ", rank int, digest string, size int, k1 string, draw int, h int, code int, row int, seq int, base string, Text string, q double, copies int, c0 int, `__at` int, bands string"


def prose(rng: random.Random, n: int, words: str = "the of and river stone walk morning light garden paper quiet seven north bridge window letter") -> str:
    vocabulary = words.split()
    out = []
    for i in range(n):
        w = rng.choice(vocabulary) + (rng.choice(["", "s", "ed", "ing"]) if rng.random() < 0.5 else "")
        out.append(w + (".\n" if i % 17 == 16 else "." if i % 9 == 8 else ""))
    return " ".join(out)


def awkward() -> list[tuple]:
    """Nulls in each column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    text = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(30, 120)), "en", f"s{i % 3}", 100 + i) for i in range(12)]
    rows += [(None, text, "en", "s1", 300), (None, text, "en", "s1", 300), (20, None, "en", "s1", None), (21, text, None, None, None), (22, "", "en", "s2", 0), (23, " \n\t ", "en", "s2", 4), (24, "x", "fr", "s2", 1)]
    rows += [rows[2], rows[2], (25, rows[3][1], "en", "s0", 5), (26, prose(rng, 200_000), "en", "s0", None), (2, prose(rng, 50), "de", "s0", 9), (None, None, None, None, None), (27, "ß éè \U0001f600 " * 20, "fr", "s2", -5)]
    return [(i, t, lang, s, len(t) if t is not None and n is not None and n > 0 else n) for i, t, lang, s, n in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    rows = [(*r, 1, "d", 2, "k", 3, 4, 5, 6, 7, "b", "T", 0.5, 8, 9, 10, "x") for r in awkward()]
    return spark.createDataFrame(rows, CLASH).repartition(2).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
