"""Mixing, sharding and packing."""

import random
from collections import Counter
from hashlib import md5
from math import floor, sqrt

import pytest

from matrixloom.llm import mixing, packing, sharding
from tests.llm.conftest import DOCS, awkward


def u(*parts):
    text = "|".join("" if p is None else str(p) for p in parts)
    return int(md5(text.encode()).hexdigest()[:13], 16)


def brute_mix(rows, rate=1.0, weights=None):
    by = {}
    for doc_id, _, _, s, n in rows:
        by.setdefault(s, []).append((doc_id, floor(sqrt(max(1 if n is None else n, 1)))))
    w = {s: floor(sqrt(len(d)) * 1000) if weights is None else weights.get(s, 0) for s, d in by.items()}
    m = floor(sum(map(len, by.values())) * rate + 0.5)
    quota = {s: m * w[s] // sum(w.values()) for s in by}
    order = sorted(by, key=lambda s: (-(m * w[s] % sum(w.values())), s is not None, s or ""))
    for s in order[: m - sum(quota.values())]:
        quota[s] += 1
    out = Counter()
    for s, docs in by.items():
        total, drawn = sum(x for _, x in docs), []
        for doc_id, x in docs:
            share = float(quota[s]) * x / total
            whole = floor(share)
            p = share - whole
            out[doc_id, s] += whole
            quota_left = (u(mixing.SEED, s, doc_id) + 0.5) / 2**52
            if p > 0:
                drawn.append(((quota_left / (1 - quota_left)) / (p / (1 - p)), doc_id is not None, doc_id or 0, x))
        need = quota[s] - sum(floor(float(quota[s]) * x / total) for _, x in docs)
        for q in sorted(drawn)[:need]:
            out[q[2] if q[1] else None, s] += 1
    return {k: v for k, v in out.items() if v}, quota


def totals(rows):
    out = Counter()
    for r in rows:
        out[r.doc_id, r.source] += r.n_copies
    return dict(out)


def test_mixing_against_brute_force(spark, odd):
    got = totals(mixing.sample_copies(odd).collect())
    assert got == brute_mix(awkward())[0]
    w = {"s0": 5, "s2": 1}
    got = totals(mixing.sample_copies(odd, 2.5, w).collect())
    want, quota = brute_mix(awkward(), 2.5, w)
    assert got == want and sum(got.values()) == sum(quota.values()) == floor(len(awkward()) * 2.5 + 0.5)


def test_mixing_has_the_size_asked_for(spark):
    rows = [(i, "t", "en", "hot" if i % 10 else "cold", 1 + i % 400) for i in range(2000)]
    got = mixing.sample_copies(spark.createDataFrame(rows, DOCS), 1.5, {"hot": 1, "cold": 1}).collect()
    by = Counter()
    for r in got:
        by[r.source] += r.n_copies
    assert by == {"hot": 1500, "cold": 1500}


def test_mixed_documents_keep_their_columns(spark, odd, clashing, none):
    want, _ = brute_mix(awkward())
    for df in (odd, clashing):
        out = mixing.mix_documents(df)
        assert out.columns == df.columns
        assert Counter((r[0], r[3]) for r in out.collect()) == want
    assert mixing.mix_documents(none).count() == mixing.sample_copies(none).count() == 0


def test_sharding_against_brute_force(spark, odd, clashing, none):
    rows = [(r[0], r[3]) for r in awkward()]
    by = {}
    for doc_id, s in rows:
        by.setdefault(s, []).append((u(sharding.SEED, s, doc_id), doc_id is not None, doc_id or 0))
    placed = sorted(((r + 0.5) / len(d), s is not None, s or "", x[1], x[2]) for s, d in by.items() for r, x in enumerate(sorted(d)))
    want = [(p[4] if p[3] else None, p[2] if p[1] else None, i + 1, i * 7 // len(placed)) for i, p in enumerate(placed)]
    for df in (odd, clashing):
        got = sorted((tuple(r) for r in sharding.interleave(df, 7).collect()), key=lambda r: r[2])
        assert got == want
    assert sharding.interleave(none).count() == 0


def test_every_shard_has_the_mixture(spark):
    rows = [(i, None, None, "a" if i % 4 else "b", None) for i in range(4000)]
    got = Counter((r.shard, r.source) for r in sharding.interleave(spark.createDataFrame(rows, DOCS), 10).collect())
    assert all(abs(got[s, "a"] - 300) <= 1 and abs(got[s, "b"] - 100) <= 1 for s in range(10))


def plain_greedy(tokens, capacity):
    """Sequence of each piece, one after the other."""
    n = max(1, -(-sum(tokens) // capacity))
    load, room, out = [0.0] * n, [capacity] * n, []
    for t in tokens:
        fit = [i for i in range(len(load)) if room[i] >= t]
        if not fit:
            load.append(0.0)
            room.append(capacity)
            fit = [len(load) - 1]
        best = min(fit, key=lambda i: (load[i], i))
        out.append(best)
        load[best] += t + float(t) ** 2 / packing.QUADRATIC
        room[best] -= t
    return out


@pytest.mark.parametrize("seed,n,most,capacity", [(1, 300, 100, 100), (2, 500, 30, 100), (3, 200, 60, 100), (4, 1, 5, 100), (5, 400, 3, 7), (6, 300, 1000, 1000)])
def test_steps_are_those_of_a_plain_loop(seed, n, most, capacity):
    rng = random.Random(seed)
    tokens = sorted((rng.randrange(1, most + 1) if rng.random() < 0.7 else most for _ in range(n)), reverse=True)
    got = []
    for start, m, seq, each in packing.greedy(Counter(tokens), capacity):
        assert start == len(got)
        got += [seq + i // each for i in range(m)]
    assert got == plain_greedy(tokens, capacity)


def test_steps_dont_grow_with_the_corpus():
    rng = random.Random(3)
    counts = Counter(min(8192, int(rng.lognormvariate(5, 1.3)) + 1) for _ in range(20_000))
    few, many = (sum(1 for _ in packing.greedy({t: n * k for t, n in counts.items()})) for k in (1000, 1_000_000))
    assert many < 1.1 * few


def whole_packing(rows, capacity):
    items = []
    for doc_id, text, *_ in rows:
        for i, s in enumerate(range(0, len(text or ""), capacity * 4)):
            e = min(s + capacity * 4, len(text))
            items.append((-(-(e - s) // 4), doc_id, i, s, e))
    items.sort(key=lambda x: (-x[0], x[1] is not None, x[1] or 0, x[2]))
    return Counter((q, x[1], x[2], x[3], x[4], x[0]) for q, x in zip(plain_greedy([x[0] for x in items], capacity), items, strict=True))


def test_packing_against_a_plain_loop_over_the_whole_table(spark, odd, clashing, none):
    rows = awkward()
    for df in (odd, clashing):
        for block in (7, 1 << 16):
            got = Counter(tuple(r)[:6] for r in packing.pack(df, 512, block).collect())
            want = whole_packing(rows, 512)
            # different texts of one id and length are ordered by hash
            plain = lambda c: sorted((q, n, k is None, k or 0, t) for (q, k, _, _, _, t), n in c.items())
            assert plain(got) == plain(want)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("rows", [[(None, f"text {i}", "en", "s", 1) for i in range(300)], [(7, "the same", "en", "s", 1)] * 300, [(7, "text " * (i % 9), "en", "s", 1) for i in range(300)], [(1, "x" * 500_000, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0)]])
def test_null_repeated_and_long_rows_are_packed(spark, rows):
    got = Counter((r.seq, r.tokens) for r in packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), 64, 50).collect())
    want = Counter()
    for (q, *_, t), n in whole_packing(rows, 64).items():
        want[q, t] += n
    assert got == want


def test_one_row_repeated_is_spread_over_the_cluster(spark, monkeypatch):
    from matrixloom.llm import common

    sizes, real = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: sizes.append([len(p) for p in df.rdd.glom().collect()]) or real(df))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame([(7, "a")] * 4000, "doc_id bigint, source string").repartition(4)
    got = common.ranked(df, "source", ["doc_id"], "r", "n")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.r for r in got.collect()) == list(range(1, 4001)) and got.columns == ["doc_id", "source", "r", "n"]
    assert sum(sizes[0]) == 4000 and max(sizes[0]) < 2000


def test_shared_folder(spark):
    from matrixloom.llm import common

    class Elsewhere:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: Elsewhere.sparkContext._jsc)
                getCheckpointDir = staticmethod(lambda: Elsewhere.sparkContext._jsc)
                isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError):
        common.shared_folder(Elsewhere)
    assert common.shared_folder(spark)
    Elsewhere.conf.get = staticmethod(lambda name, default: "hdfs://named/folder/")
    assert common.shared_folder(Elsewhere) == "hdfs://named/folder"


def test_small_goes_by_rows_and_bytes(spark):
    from matrixloom.llm.common import small

    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t")
    hint = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hint(small(df)) and not hint(small(df, rows=99)) and not hint(small(df, size=50_000))


def test_tables_in_between_are_deleted(spark, odd, tmp_path):
    from pathlib import Path

    from matrixloom.llm import common, hamming, superminhash

    def left():
        return {p for p in common._WRITTEN if Path(p.removeprefix("file://")).exists()}

    before = left()
    out = superminhash.near_duplicates(odd)
    assert len(left() - before) == 1 and out.count()  # the groups that the result reads
    out = superminhash.keep_one(odd)
    assert len(left() - before) == 2
    table = common.cut(odd)
    common.drop_cut(table)
    assert len(left() - before) == 2
    hamming.neighbours(spark.createDataFrame([(100, [1.0, 0.5]), (2, [0.5, 1.0])], "vec_id bigint, embedding array<float>"))
    assert len(left() - before) == 3
    common._delete_all()
    assert not left()
