"""Line removal and near duplicates."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from matrixloom.llm import linededup, queries, superminhash
from tests.llm.conftest import DOCS, awkward, prose


def units(text, least):
    """(key, start, stop) of each unit of a text, one word at a time."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x20]+", text)]
    line_ends = {i for i, (_, b) in enumerate(words) if i + 1 == len(words) or "\n" in text[b : words[i + 1][0]]}
    ends = [i for i, (_, b) in enumerate(words) if i in line_ends or text[b - 1] in ".!?"]
    first = 0
    for e in ends:
        if e + 1 - first >= least or e in line_ends and (not first or first - 1 in line_ends):
            stop = words[e + 1][0] if e + 1 < len(words) else len(text)
            yield " ".join(text[a:b] for a, b in words[first : e + 1]).lower(), words[first][0], stop
        first = e + 1


def brute_lines(rows, least):
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in docs:
        spans = []
        for key, a, b in units(text, least):
            if key in seen:
                spans.append((a, b))
            seen.add(key)
        at, kept = 0, []
        for a, b in spans:
            kept.append(text[at:a])
            at = b
        out[doc_id, text] = ("".join([*kept, text[at:]]), spans)
    return out


@pytest.mark.parametrize("which", ["odd", "clashing", "random"])
def test_lines_against_brute_force(spark, request, which):
    if which == "random":
        rng = random.Random(9)
        shared = [prose(rng, 40) for _ in range(5)]
        rows = [(i, " ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng, 8, "a b c Éa") for _ in range(6)), "en", "s", 1) for i in range(60)]
        df = spark.createDataFrame(rows, DOCS)
    else:
        rows, df = [r for r in awkward() if r[0] != 2], request.getfixturevalue(which).where("doc_id is null or doc_id <> 2")
    want = brute_lines(rows, linededup.LEAST_WORDS)
    got = linededup.remove_repeats(df).collect()
    assert len(got) == len(want) + len({r[0] for r in rows if r[1] is None})
    left = Counter((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in got if r.text is not None)
    assert left == Counter((k[0], v[0], tuple(v[1])) for k, v in want.items())
    assert all(r.n_removed == len(r.removed) for r in got)


def test_query_removes_lines_of_any_length_and_long_sentences(spark, tmp_path):
    texts = ["Ietzte.\nAll rights reserved.\nA line that is longer than five words.", "New one here. All rights reserved. A line that is longer than five words. Another.\nIetzte.", "ietzte.\nIetzte.", "x", "x", "Stteen Erachtz.\n\nIetzte.", "All rights\treserved."]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k[0]: v for k, v in brute_lines(rows, linededup.LEAST_WORDS).items()}
    assert got[1][0] == "New one here. All rights reserved. Another.\n" and got[2][0] == got[4][0] == got[6][0] == ""


def test_texts_of_one_id_are_ranked_once(spark):
    """Documents of equal id and different text: one of them keeps what they share, whichever it is."""
    rows = [(1, "shared line\nfirst", "en", "s", 1), (1, "shared line\nsecond", "en", "s", 1), (1, "shared line\nfirst", "en", "s", 1), (2, "shared line", "en", "s", 1)]
    got = linededup.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2]
    assert sorted(r.text.count("shared") for r in got if r.doc_id == 1) == [0, 1] and [r.text for r in got if r.doc_id == 2] == [""]


def test_no_lines(spark, none):
    assert linededup.remove_repeats(none).count() == 0


def sequential(elements, m):
    """SuperMinHash of a set, one element and one step at a time."""
    h = [float("inf")] * m
    for e in elements:
        p = list(range(m))
        for j in range(m):
            r, k = superminhash._draw(np.array([e], np.uint64), j, m)
            p[j], p[k[0]] = p[k[0]], p[j]
            h[p[j]] = min(h[p[j]], r[0] + j)
    return h


def test_signatures_are_those_of_the_sequential_algorithm():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 2, 9, 40, 300]
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    got = superminhash.signatures(np.concatenate(sets), doc, len(sizes), 16)
    for s, g in zip(sets, got, strict=True):
        assert g.tolist() == sequential(s, 16)


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(6)
    both = rng.integers(0, 2**63, 600).astype(np.uint64)
    only = rng.integers(0, 2**63, 400).astype(np.uint64)
    e = np.concatenate([both, only[:200], both, only[200:]])
    got = superminhash.signatures(e, np.repeat([0, 1], 800), 2)
    assert abs((got[0] == got[1]).mean() - 0.6) < 0.12


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute_groups(rows, threshold):
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    up = list(range(len(docs)))

    def top(i):
        return i if up[i] == i else top(up[i])

    sets = [grams(t) for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return Counter((docs[i][0], docs[top(i)][0]) for i in range(len(docs)) if sets[i])


def edited(rng, text, share):
    return " ".join(prose(rng, 1, "zz yy xx ww vv").strip(". \n") + str(rng.randrange(999)) if rng.random() < share else w for w in text.split(" "))


def near_corpus():
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
        rows += [(g * 100 + i, edited(rng, base, 0.03 if i else 0), "en", "s", 1) for i in range(rng.randrange(1, 6))]
    return rows + [(5000 + i, rows[3][1], "en", "s", 1) for i in range(40)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_corpus()
    got = superminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.group_id) for r in got) == brute_groups(rows, superminhash.THRESHOLD)
    sizes = Counter(r.group_id for r in got)
    assert all(r.group_size == sizes[r.group_id] and r.is_kept == (r.doc_id == r.group_id) for r in got)
    kept = superminhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(sizes)


def test_awkward_documents(spark, odd, clashing, none):
    rows = awkward()
    worded = [r for r in rows if grams(r[1])]
    want = brute_groups(worded, superminhash.THRESHOLD)
    for df in (odd, clashing):
        got = superminhash.near_duplicates(df).collect()
        lone = [r for r in rows if not grams(r[1])]
        assert len(got) == sum(want.values()) + len(lone)
        assert Counter((r.doc_id, r.group_id) for r in got) == want + Counter((r[0], r[0]) for r in lone)
        kept = superminhash.keep_one(df)
        assert kept.columns == df.columns
        kept = kept.collect()
        assert len([r for r in kept if not grams(r[1])]) == len(lone)
        assert len([r for r in kept if grams(r[1])]) == sum(1 for r in got if r.is_kept) - len(lone)
    assert superminhash.near_duplicates(none).count() == superminhash.keep_one(none).count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(300), 2))) for _ in range(220)} | {(i, i + 1) for i in range(400, 440)}
    df = spark.createDataFrame([(a.to_bytes(2, "big"), b.to_bytes(2, "big")) for a, b in pairs], "a binary, b binary")
    want = superminhash._roots(list(pairs))
    for n in (1, 7):
        got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in superminhash.components(df.repartition(n)).collect()}
        assert got == want
    assert superminhash.components(df.limit(0)).count() == 0


def test_buckets_are_searched_whole():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 65536, (3, 128))
    sig = np.concatenate([np.where(rng.random((40, 128)) < 0.3, rng.integers(0, 65536, (40, 128)), b) for b in base]).astype(np.uint16)
    sig = sig[rng.permutation(len(sig))]
    same = (sig[:, None] == sig[None]).sum(2)
    for high, low in ((52, 40), (70, 60), (129, 50)):
        edges, label, open_ = superminhash.links(sig, np.arange(len(sig)), np.ones(len(sig), bool), low, high)
        want = superminhash._roots([(i, i) for i in range(len(sig))] + [(i, j) for i in range(len(sig)) for j in range(i) if same[i, j] >= high])
        assert superminhash._roots([(i, i) for i in range(len(sig))] + edges) == want
        assert open_.tolist() == [any(same[i, j] >= low and want[i] != want[j] for j in range(len(sig)) if j != i) for i in range(len(sig))]


def test_exact_links():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(50)]
    plain = [set(x.tolist()) for x in sets]
    for t in (0.3, 0.5, 1.0):
        want = superminhash._roots([(i, i) for i in range(50)] + [(i, j) for i in range(50) for j in range(i) if len(plain[i] & plain[j]) / len(plain[i] | plain[j]) >= t])
        assert superminhash._roots([(i, i) for i in range(50)] + superminhash.exact_links(sets, np.arange(50), t)) == want


def at_similarity(rng, base, j):
    """A text whose trigrams have about the similarity j with those of base: its first part, then new words."""
    n = len(base)
    keep = round(2 * j / (1 + j) * n)
    return base[:keep] + [f"n{rng.randrange(10**9)}" for _ in range(n - keep)]


def test_near_the_threshold(spark):
    """Pairs just below never join, pairs just above do, save those that no band brings together."""
    rng = random.Random(31)
    rows = []
    for g in range(120):
        base = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        j = (0.36, 0.385, 0.43, 0.47)[g % 4]
        rows += [(2 * g, " ".join(base), "en", "s", 1), (2 * g + 1, " ".join(at_similarity(rng, base, j)), "en", "s", 1)]
    exact = [len(a & b) / len(a | b) for a, b in ((grams(rows[2 * g][1]), grams(rows[2 * g + 1][1])) for g in range(120))]
    got = {r.doc_id: r.group_id for r in superminhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    joined = [got[2 * g] == got[2 * g + 1] for g in range(120)]
    assert not any(x for x, j in zip(joined, exact, strict=True) if j < 0.4)
    above = [x for x, j in zip(joined, exact, strict=True) if j >= 0.4]
    assert len(above) == 60 and sum(above) >= 54


@pytest.mark.parametrize("bucket", [3, 8, 10**6])
def test_hot_buckets_in_parts(spark, bucket):
    """Two large groups and strays that share bands: the same components whatever the size of a part."""
    rng = random.Random(5)
    rows = []
    for g in range(2):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
        rows += [(g * 1000 + i, edited(rng, base, 0.1), "en", "s", 1) for i in range(40)]
    rows += [(3000 + i, " ".join(at_similarity(rng, rows[i][1].split(), 0.45)), "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    nodes = superminhash.sketches(df).select("digest", "sig", "bands")
    got = superminhash.roots_of(nodes, df, bucket=bucket).collect()
    whole = {(bytes(r.node), bytes(r.root)) for r in superminhash.roots_of(nodes, df, bucket=10**6).collect()}
    assert {(bytes(r.node), bytes(r.root)) for r in got} == whole and len(whole) > 80
