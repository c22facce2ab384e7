"""Language identification, quality trees and nearest neighbours."""

import random
from collections import Counter
from math import log2

import numpy as np
import pytest

from matrixloom.llm import hamming, langid, quality
from tests.llm.conftest import DOCS, awkward, prose

WORDS = {"en": "the of and river stone walk morning light", "fr": "le la des rivière pierre marcher matin lumière", "de": "der die und fluß stein gehen morgen licht"}


def speech(rng, lang, n):
    return prose(rng, n, WORDS[lang])


def brute_bits(texts, text, order):
    """Code length of a text under each language, byte by byte."""
    names = sorted(texts)
    seen = {b for t in texts.values() for x in t for b in x}
    sym = lambda b: b if b in seen else None
    counts = {n: {} for n in names}
    total = {n: Counter() for n in names}
    for n in names:
        for t in texts[n]:
            for i in range(len(t)):
                for k in range(order + 1):
                    if i >= k:
                        counts[n].setdefault(t[i - k : i], Counter())[t[i]] += 1
                for k in range(1, order + 1):
                    if i + 1 >= k:
                        total[n][t[i + 1 - k : i + 1]] += 1
    tree = {b""}
    for k in range(1, order + 1):
        tree |= {g for n in names for g in total[n] if len(g) == k and max(total[m][g] for m in names) >= langid.LEAST_SEEN and g[:-1] in tree and g[1:] in tree}
    out = []
    for n in names:
        bits = 0.0
        for i, b in enumerate(text):
            ctx = text[max(0, i - order) : i]
            while ctx not in tree:
                ctx = ctx[1:]
            out_of = set()
            while True:
                here = {s: c for s, c in counts[n].get(ctx, {}).items() if s not in out_of}
                if here:
                    t, q = sum(here.values()), len(here)
                    if sym(b) in here:
                        bits -= log2(here[b] / (t + q))
                        break
                    bits -= log2(q / (t + q))
                    out_of |= set(here)
                if not ctx:
                    bits += log2(256 - len(out_of))
                    break
                ctx = ctx[1:]
        out.append(bits)
    return out


def test_code_lengths_against_a_plain_coder():
    rng = random.Random(1)
    texts = {k: [speech(rng, k, 40).encode() for _ in range(4)] for k in WORDS}
    m = langid.fit(texts, texts, 3)
    for t in (speech(rng, "fr", 25), "zzz \x00\x01 quartz", "", "é", "the the the"):
        assert langid.score_one(m, t.encode()) == pytest.approx(brute_bits(texts, t.encode(), 3), rel=1e-4, abs=1e-3)


def test_documents_of_a_batch_are_scored_apart():
    rng = random.Random(2)
    texts = {k: [speech(rng, k, 60).encode() for _ in range(3)] for k in WORDS}
    m = langid.fit(texts, texts)
    docs = [speech(rng, rng.choice(list(WORDS)), n).encode() for n in (0, 3, 50, 0, 1, 20, 0)]
    got = langid.score(m, np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)]))
    for d, g in zip(docs, got, strict=True):
        assert g == pytest.approx(langid.score_one(m, d), rel=1e-6)


@pytest.mark.parametrize("segment", [1, 3, 7, 50, 10_000])
def test_segments_of_long_texts_add_up(segment):
    rng = random.Random(2)
    texts = {k: [speech(rng, k, 60).encode() for _ in range(3)] for k in WORDS}
    m = langid.fit(texts, texts)
    docs = [speech(rng, rng.choice(list(WORDS)), n).encode() for n in (0, 3, 50, 0, 1, 20, 0)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    assert langid.score(m, data, offsets, segment) == pytest.approx(langid.score(m, data, offsets), rel=1e-6)


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(1, speech(rng, "en", 20) + str(i), "en", "s", 1) for i in range(50)] + [(2, "le la les", "fr", "s", 1)] * 60 + [(2, "the of the", "en", "s", 1), (3, "la rivière", "fr", "s", 1)]
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda texts, apart, *_: seen.update(texts=texts, apart=apart))
    langid.train(spark.createDataFrame(rows, DOCS).repartition(3), 6, 2)
    sizes = {k: len(seen["texts"][k]) + len(seen["apart"][k]) for k in seen["texts"]}
    assert sizes == {"en": 8, "fr": 2}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "fit", lambda x, y, *_: seen.update(x=x, y=y))
    quality.train(spark.createDataFrame(rows, DOCS).repartition(3), labels, 30)
    assert len(seen["x"]) == len(seen["y"]) == 30


@pytest.mark.parametrize("n", [3, 1 << 20, (1 << 20) + 1])
def test_distinct_at_any_number_of_documents(n):
    doc = np.array([0] * 10 + [n - 1] * 12)
    h = np.array([*range(10), *([5, 6] * 6)], np.uint64)
    got = quality._distinct(h, doc, n)
    assert got[0] == 10 and got[n - 1] == 2 and got.sum() == 12


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang, rng.randrange(20, 80)), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 40)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_held_out_accuracy_and_rejection(spark, spoken):
    m = langid.train(spoken, 20, 10)
    rng = random.Random(6)
    fresh = [(i, speech(rng, lang, 30), lang, "s", 1) for i, lang in enumerate(list(WORDS) * 30)]
    junk = [(1000 + i, "".join(rng.choice("qxzjkvw0123456789@#~^") for _ in range(200)), None, "s", 1) for i in range(20)]
    df = spark.createDataFrame(fresh + junk + [(2000, None, "en", "s", 1), (2001, "", "en", "s", 1)], DOCS)
    got = {r.doc_id: r for r in langid.identify(df, m).collect()}
    assert all(got[i].language == lang and got[i].accepted for i, _, lang, *_ in fresh)
    assert not any(got[i].accepted for i, *_ in junk) and got[2000].language is None and not got[2001].accepted
    assert {r.doc_id for r in langid.keep_identified(df, m).collect()} == {r[0] for r in fresh}


@pytest.mark.parametrize("each", [2, 8, 40])
def test_small_tables_reject_too(spark, each):
    rng = random.Random(8)
    rows = [(i, speech(rng, lang, rng.randrange(20, 80)), lang, "s", 1) for i, lang in enumerate(list(WORDS) * each)]
    rows += [(1000 + i, "".join(rng.choice("qxzjkvw0123456789@#~^") for _ in range(200)), None, "s", 1) for i in range(9)]
    rows += [(2000, "".join(map(chr, range(33, 127))) * 2, "xx", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    m = langid.train(df)
    assert np.isfinite(m.limits).all() and len(m.limits) == 4
    assert {r.doc_id for r in langid.keep_identified(df, m).collect()} - {2000} == set(range(3 * each))


def test_each_language_has_its_limit():
    limits = langid._limits([np.full(20, 2.0), np.array([4.0] * 18 + [9.0] * 2), np.zeros(0)])
    assert limits[0] == pytest.approx(3.2) and 5.2 <= limits[1] < 9 and limits[2] == limits[1]
    assert np.isinf(langid._limits([np.zeros(0)])).all()


def test_awkward_languages(spark, odd, clashing, none):
    for df in (odd, clashing):
        got = langid.identify(df).collect()
        assert len(got) == len(awkward()) and Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward())
        kept = langid.keep_identified(df)
        assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got)
    assert langid.identify(none).count() == langid.keep_identified(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "a b", None, None, None)], DOCS)
    assert [tuple(r) for r in langid.identify(unlabelled).collect()] == [(1, None, None, None, False)]


# --- quality ------------------------------------------------------------------------------------


def labelled(spark, n):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        t, good = prose(rng, rng.randrange(20, 120)), rng.random() < 0.7
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split()) if i % 2 else " ".join(w + rng.choice(["$$$", "%%%"]) for w in t.split())
        docs.append((i, t, "en", "s", 1))
        labels.append((i, int(good), 0))
    return docs, labels, spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_quality(spark):
    docs, labels, d, lab = labelled(spark, 400)
    trees = quality.train(d.where("doc_id < 250"), lab.where("doc_id < 250"))
    got = {r.doc_id: r.keep for r in quality.score(d.where("doc_id >= 250"), trees).collect()}
    assert sum(got[i] == bool(q) for i, q, _ in labels if i >= 250) / len(got) > 0.97


def test_flat_trees_descend_as_recursive_ones_and_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.3, 600) > 0.6).astype(float)
    trees = quality.fit(x, y, [1, 0, -1], trees=25)

    def walk(row):
        out = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            out += trees.value[at]
        return out

    assert trees.raw(x[:50]).tolist() == pytest.approx([walk(r) for r in x[:50]])
    for f, sign in ((0, 1), (2, -1)):
        grid = np.repeat(rng.random((40, 3)), 30, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 30), 40)
        assert (sign * np.diff(trees.raw(grid).reshape(40, 30), axis=1) >= -1e-12).all()
    assert ((trees.predict(x) > 0.5) == y).mean() > 0.75


@pytest.mark.parametrize("monotone", [[0, 0, 0], [1, -1, 0], [-1, 1, 1]])
def test_splits_are_the_best_of_all(monotone):
    """A tree of one split against every feature and every edge, tried one by one."""
    rng = np.random.default_rng(9)
    for _ in range(5):
        x = np.round(rng.random((300, 3)), 2)
        y = (x @ rng.normal(size=3) + rng.normal(0, 0.4, 300) > 0.3).astype(float)
        trees = quality.fit(x, y, monotone, trees=1, depth=1, rate=1.0)
        p = y.mean()
        base = np.log(p / (1 - p))
        g, h = p - y, np.full(300, p * (1 - p))
        loss = lambda rows: (lambda v: g[rows].sum() * v + 0.5 * (h[rows].sum() + 1) * v * v)(-g[rows].sum() / (h[rows].sum() + 1))
        best = (1e-6, None, None)
        for f in range(3):
            for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
                left = x[:, f] <= edge
                if min(left.sum(), 300 - left.sum()) < quality.LEAST_ROWS:
                    continue
                v = [-g[r].sum() / (h[r].sum() + 1) for r in (left, ~left)]
                if monotone[f] * (v[1] - v[0]) >= 0:
                    gain = loss(np.ones(300, bool)) - loss(left) - loss(~left)
                    best = max(best, (gain, f, edge), key=lambda b: b[0])
        if best[1] is None:
            assert np.allclose(trees.raw(x), trees.raw(x)[0])
            continue
        left = x[:, best[1]] <= best[2]
        want = np.where(left, -g[left].sum() / (h[left].sum() + 1), -g[~left].sum() / (h[~left].sum() + 1))
        assert trees.raw(x) == pytest.approx(base + want)


def test_statistics_of_one_document():
    import pyarrow as pa

    t = "Ab cd!! cd!!\nAb cd!! cd!!\nx1"
    ((_, _, x),) = quality.batch_statistics(pa.array(["", t, None]))
    got = dict(zip(quality.FEATURES, x[1], strict=True))
    n = len(t)
    want = {"log_bytes": np.log1p(n), "log_words": np.log1p(7), "mean_word": 22 / 7, "alpha": 13 / n, "digit": 1 / n, "symbol": 8 / n, "upper": 2 / n, "space": 6 / n, "distinct_words": 3 / 7, "marked_words": 4 / 7, "long_words": 0, "distinct_lines": 2 / 3, "mean_line": 7 / 3, "top_byte": 8 / n}
    assert got == pytest.approx(want)
    assert x[0].tolist() == x[2].tolist()


def test_awkward_quality(spark, odd, clashing, none):
    lab = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (22, 0, 0), (20, 1, None), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    for df in (odd, clashing):
        got = quality.score(df, quality.train(df, lab)).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in awkward()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, quality.train(none, lab)).count() == 0
    assert {r.score for r in quality.score(odd, quality.train(odd, lab.limit(0))).collect()} == {0.5}


# --- neighbours ----------------------------------------------------------------------------------


def exact(rows, k):
    ok = [(i, v) for i, v in enumerate(rows) if v[1] and all(x is not None and np.isfinite(x) for x in v[1]) and any(v[1]) and len(v[1]) == len(rows[0][1])]
    x = np.array([v[1][1] for v in ok], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return [(ok[i][1][0], ok[j][1][0], s[i, j]) for i in range(len(ok)) for j in np.argsort(-s[i], kind="stable")[:k]]


SCHEMA = "vec_id bigint, embedding array<float>"


def vectors(kind, n=900, dims=32):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims))
    if kind == "clusters":
        x = np.repeat(rng.normal(size=(n // 15, dims)), 15, axis=0) + 0.15 * x
    return [(i, [float(z) for z in v]) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
@pytest.mark.parametrize("every", [1, 10])
def test_recall(spark, kind, every):
    rows = vectors(kind)
    truth = {(a, b) for a, b, _ in exact(rows, 10) if a % every == 0}
    got = {(r.vec_id, r.neighbour_id) for r in hamming.neighbours(spark.createDataFrame(rows, SCHEMA), every=every).collect()}
    assert all(a % every == 0 for a, _ in got) and len(truth & got) / len(truth) >= 0.9


@pytest.mark.parametrize("kind", ["clusters", "sphere"])
def test_rows_and_cosines_are_those_of_a_search_over_all_codes(spark, kind, monkeypatch):
    rows, used = vectors(kind), {}
    real = hamming.learn_radius

    def note(coded, coder, *args):
        used.update(coder=coder, radius=real(coded, coder, *args))
        return used["radius"]

    monkeypatch.setattr(hamming, "learn_radius", note)
    df = spark.createDataFrame(rows, SCHEMA)
    sorted_ = [sorted(map(tuple, hamming.neighbours(df, every=3, shard_rows=n, width=w).collect())) for n, w in ((10**6, 16), (100, 16), (77, 5))]
    assert sorted_[0] == sorted_[1] == sorted_[2]  # whatever the shards, blocks and substrings
    x = np.array([v for _, v in rows], np.float32)
    x = (x / np.linalg.norm(x.astype(float), axis=1)[:, None]).astype(np.float32)
    codes, y = used["coder"].codes(x), x.astype(float)
    want = []
    for i in range(0, len(rows), 3):
        near = [j for j in range(len(rows)) if j != i and np.bitwise_count(codes[i] ^ codes[j]) <= used["radius"]]
        sims = {j: round(float(y[i] @ y[j]), 6) for j in near}
        want += [(i, n + 1, j, sims[j]) for n, j in enumerate(sorted(near, key=lambda j: (-sims[j], j))[:10])]
    assert [r[:2] for r in sorted_[0]] == [r[:2] for r in sorted(want)]
    for got, w in zip(sorted_[0], sorted(want), strict=True):
        assert got[3] == pytest.approx(w[3], abs=2e-6) and (got[2] == w[2] or abs(got[3] - w[3]) < 2e-6)


def test_look_ups_find_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    for bits, width in ((24, 8), (24, 16), (7, 16), (64, 16)):
        codes = rng.integers(0, 2**63, 400).astype(np.uint64) & np.uint64((1 << bits) - 1)
        codes[200:300] = codes[:100] ^ np.uint64(5)
        for radius in (0, 1, 3, 7, bits):
            parts = hamming.plan(bits, radius, width)
            assert sum(w for _, w, _ in parts) == bits
            i, j = hamming.Index(codes, parts, radius).within(codes[:60])
            want = np.nonzero(np.bitwise_count(codes[:60, None] ^ codes) <= radius)
            assert i.tolist() == want[0].tolist() and j.tolist() == want[1].tolist()


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (None, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0])]
    for extra, more in (((), ""), ((5, "x", 3), ", row int, code string, vec int")):
        df = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA + more)
        got = hamming.neighbours(df, k=2, target=1.0, every=1).collect()
        assert sorted((r.vec_id, r["rank"], r.neighbour_id is None, r.neighbour_id or 0) for r in got) == [(1, 1, False, 2), (1, 2, False, 2), (2, 1, False, 2), (2, 1, False, 2), (2, 2, True, 0), (2, 2, True, 0)]
        assert hamming.neighbours(df).count() == 0  # no id is divisible by 100
    for nothing in ([], [(1, None)], [(1, [0.0])], [(1, [1.0])]):
        assert hamming.neighbours(spark.createDataFrame(nothing, SCHEMA)).count() == 0
