"""The whole pipeline against brute-force versions of its stages."""

import random
import re
from collections import Counter

import corpus_pipeline
from matrixloom.llm import langid, secrets, superminhash
from tests.llm.conftest import DOCS
from tests.llm.test_dedup import brute_groups, edited
from tests.llm.test_models import brute_bits, speech
from tests.llm.test_sampling import brute_mix


def corpus():
    rng = random.Random(21)
    rows = [(i, speech(rng, ["en", "fr", "de"][i % 3], rng.randrange(30, 90)) + f" u{rng.randrange(10**9)}", ["en", "fr", "de"][i % 3], f"s{min(i % 5, 2)}", None) for i in range(60)]
    rows += [(100 + i, edited(rng, rows[i][1], 0.02), rows[i][2], "s0", None) for i in range(6)]
    rows += [(200 + i, rows[9][1], "en", "s1", None) for i in range(8)]
    rows += [(300 + i, "".join(rng.choice("qxzjkvw0123456789@#~^") for _ in range(150)), "en", "s2", None) for i in range(4)]
    rows += [(400, None, "en", "s0", None), (401, "", "en", "s0", None), (None, speech(rng, "en", 40), None, None, None)]
    rows += [(500, speech(rng, "en", 40) + " password=b7db7aa4a5fcc78305 end.", "en", "s0", None), (501, speech(rng, "de", 9000), "de", "s1", None)]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # 1: every training row is known, as there are fewer than the bound
    train = {k: [r[1].encode() for r in rows if r[2] == k and r[1] and r[0] is not None] for k in ("de", "en", "fr")}
    limit = langid.train(spark.createDataFrame(rows, DOCS)).limit
    accepted = [r for r in rows if r[1] and min(brute_bits(train, r[1].encode(), langid.ORDER)) <= limit * len(r[1].encode()) + langid.START + 1e-2]
    assert {r[0] for r in rows} - {r[0] for r in accepted} == {400, 401} | ({300, 301, 302, 303} if limit < 9 else set())
    # 2
    names = {a for a, b in brute_groups(accepted, superminhash.THRESHOLD) if a == b}
    kept = [r for r in accepted if r[0] in names]
    # 3
    clean = [(r[0], re.sub(r"(?<=password=)[0-9a-f]{18}", "[hex_secret]", r[1]), *r[2:4]) for r in kept]
    clean = [(*r, len(r[1])) for r in clean]
    assert secrets.scan(spark.createDataFrame(clean, DOCS)).count() == 0
    # 4
    drawn, _ = brute_mix(clean)
    # 5: each copy is packed whole, within the capacity
    want = Counter()
    for i, t, _, s, _ in clean:
        for at in range(0, len(t), 32768):
            want[i, at, min(at + 32768, len(t))] += drawn.get((i, s), 0)
    assert Counter((r.doc_id, r.start_char, r.end_char) for r in got) == +want
    load = Counter()
    for r in got:
        load[r.seq] += r.tokens
    assert max(load.values()) <= 8192


def test_junk_goes(spark):
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, spark.createDataFrame(corpus(), DOCS), "").collect()}
    assert not kept & {300, 301, 302, 303} and set(range(60)) <= kept


def test_stages_keep_the_columns(spark, odd, clashing, none):
    for df in (odd, clashing, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixing", "packing"]


def test_run_over_an_empty_table(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["seq", "doc_id", "piece", "start_char", "end_char", "tokens", "cost"]
