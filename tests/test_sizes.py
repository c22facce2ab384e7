"""Steps that used to hold a table, or all of a key, in one task."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from matrixloom.functions import hashing, sizes, stats, text
from matrixloom.operators import classify, fingerprint, validate
from matrixloom.plans import queries as matrix
from matrixloom.plans.audit import audit
from matrixloom.schema import OBSERVATIONS
from matrixloom.sources import jsonl, sinks


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def largest_row(df, column):
    return df.select(F.max(F.length(column))).first()[0]


def test_digests_are_chained_over_partitions(spark, small_batches, monkeypatch):
    rows = [(p, f"i{i:04d}") for p in ("x", "y") for i in range(300)]
    random.Random(3).shuffle(rows)
    pieces = spark.createDataFrame(rows, "part string, ident string").withColumn("piece", hashing.framed(F.col("ident")))
    runs = list(hashing.ordered_runs(pieces))
    # no row holds more than a batch, so none holds a part
    assert max(r.n for r in runs) <= 7 and sum(r.n for r in runs) == 600
    for p in ("x", "y"):
        want = b"".join(len(i).to_bytes(8, "big") + i.encode() for _, i in sorted(r for r in rows if r[0] == p))
        assert b"".join(r.run for r in runs if r.part == p) == want


def test_fingerprint_of_awkward_prompts(spark, small_batches):
    rows = [(f"p{i}", None if i % 3 else f'say "{i}" é', None if i % 4 else "t", f"u{i % 2}" if i % 5 else None, i if i % 5 else None, m) for i in range(40) for m in ("b", "a")]
    obs = spark.createDataFrame(rows, "prompt_id string, prompt string, task string, trace_id string, sequence_index bigint, model string")
    heads = sorted({r[:5] for r in rows}, key=lambda r: r[0])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    prompts = [{"prompt_id": i, "prompt_identity_sha256": sha(p if p is not None else f"prompt_id:{i}"), "sequence_index": s, "task": t, "trace_id": u} for i, p, t, u, s in heads]
    text = json.dumps({"models": ["a", "b"], "prompts": prompts, "schema_version": "matrixloom.observation.v1"}, separators=(",", ":"), ensure_ascii=False)
    assert fingerprint.fingerprint(obs).first()[0] == "sha256:" + sha(text)


@pytest.mark.parametrize("group", ["g", None])
def test_mersenne_clusters_span_batches(spark, small_batches, group):
    rng = random.Random(5)
    rows = [(k, f"g{i % 23:02d}", i, rng.random(), rng.random()) for k in ("k", "l", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, g string, i int, a double, b double").repartition(3)
    packed = stats._clusters(df.withColumn("__seed", F.lit(1)), ["k"], ["g", "i"], ["a", "b"], group)
    # a row has the clusters of a batch, not those of its key
    assert largest_row(packed, "sums") <= 8 * 7
    got = {(r.k, r.measure): (r.low, r.high) for r in stats.bootstrap_mersenne(df, ["k"], ["g", "i"], {"a": 0, "b": 3}, F.lit(42), group, 50).collect()}
    for k in ("k", "l", None):
        for at, name in ((3, "a"), (4, "b")):
            mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
            names = sorted({r[1] for r in mine})
            groups = [[r[at] for r in mine if r[1] == g] for g in names] if group else [[r[at]] for r in mine]
            assert got[k, name] == stats.mersenne_interval(groups, 42 + 3 * (at - 3), 50)[:2]
    assert len(got) == 6


def test_hashed_draws_serve_all_keys_and_packs(spark, small_batches, monkeypatch):
    rng = random.Random(6)
    rows = [(k, i, rng.random()) for k, n in (("k", 40), (None, 25), ("m", 1)) for i in range(n) for _ in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    calls = []
    draw = stats._replicates
    for most in (1 << 28, 1):
        monkeypatch.setattr(stats, "PACK", most)
        got = {r.k: (r.low, r.high) for r in stats.bootstrap_hashed_blocks(df, ["k"], "i", "v", 42, 60).collect()}
        for k in ("k", None, "m"):
            groups = [[r[2] for r in rows if r[:2] == (k, i)] for i in sorted({r[1] for r in rows if r[0] == k})]
            means = []
            for r in range(60):
                drawn = [groups[int(hashlib.sha256(f"matrixloom:42:{r}:{i}".encode()).hexdigest()[:13], 16) % len(groups)] for i in range(len(groups))]
                means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
            assert got[k] == pytest.approx((stats.py_percentile(means, 0.025), stats.py_percentile(means, 0.975)))
    # one hash for a replicate and position, however many keys
    monkeypatch.setattr(stats, "sha256", lambda b: calls.append(b) or hashlib.sha256(b))
    packs = [(k, 9, *stats._coded(rng_values), None) for k, rng_values in enumerate([stats.np.arange(9.0)] * 5)]
    assert len(draw(packs, "h:", [0, 1])) == 10 and len(calls) == 18


def test_written_files_can_be_read(spark, tmp_path):
    rows = [(f"p{i:03d}", "x" * (5 if i % 40 else 900), None, None, None, "m", 0.5, 1.0, 0.0, 0.0, None) for i in range(200)]
    obs = spark.createDataFrame(rows, OBSERVATIONS).coalesce(1)
    path = sinks.dump_jsonl(obs, str(tmp_path / "out"), part_bytes=4_000, max_bytes=9_000)
    files = sorted((tmp_path / "out").glob("*.txt"))
    assert len(files) > 4 and max(f.stat().st_size for f in files) <= 9_000
    assert [json.loads(x)["prompt_id"] for f in files for x in f.read_text().splitlines()] == [r[0] for r in rows]
    assert jsonl.load_jsonl(spark, path + "/*.txt", max_bytes=9_000).count() == 200


@pytest.mark.parametrize("folder", [False, True])
def test_streams_read_files_and_folders(spark, tmp_path, folder):
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2)], "conv_id bigint, turn bigint")
    rows.repartition(3 if folder else 1).write.parquet(str(tmp_path / "conversations.parquet" if folder else tmp_path / "w"))
    if not folder:
        next((tmp_path / "w").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    got = {r.trace_id: (r.n, r.first, r["last"], r.contiguous) for r in matrix.QUERIES["stream_trace_gaps"](spark, str(tmp_path)).collect()}
    assert got == {"1": (2, 0, 1, True), "2": (2, 0, 2, False)}


def test_violations_of_a_prompt_in_one_grouping(spark):
    row = lambda p, m, task="t", meta=None: (p, None, task, None, None, m, 0.5, 1.0, 0.0, 0.0, meta)
    rows = [row("a", "m"), row("a", "n"), *[row("b", "m")] * 3, row("b", "n", None), row("c", "m"), row("d", "m", meta="{}"), row("d", "n"), row("d", "n")]
    obs = spark.createDataFrame(rows, OBSERVATIONS)
    found = validate.violations(obs)
    got = sorted((r.code, r.prompt_id, r.model or "", r.detail) for r in found.collect())
    assert got == [("duplicate", "b", "m", "3"), ("duplicate", "d", "n", "2"), ("inconsistent", "b", "", "2"), ("inconsistent", "d", "", "2"), ("missing", "c", "n", "no result")]
    single = {(r.prompt_id, r.model) for r in validate.duplicates(obs).collect()}
    assert single == {r[1:3] for r in got if r[0] == "duplicate"}


def test_parts_grow_with_the_table(spark, tmp_path):
    spark.range(300_000).select(F.col("id"), F.rand(1).alias("x")).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    assert sizes.shares(t, 1 << 18) >= 2 * sizes.shares(t, 1 << 20) >= 4
    assert sizes.shares(t, 1 << 40, 1 << 40) == 1
    part = spark.range(60_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit("Brand#1").alias("p_brand"))
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    # one small file is graded by all cores
    assert matrix._answers(spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_exact_tokens_are_counted_in_bounded_rows(spark, small_batches, monkeypatch):
    rows = [("a", f"Straße straSSE x_y W{i:03d} ǰ²") for i in range(60)] + [("b", None), (None, "ab AB"), ("c", "_ a !")]
    df = spark.createDataFrame(rows, "k string, t string").coalesce(1)
    whole = {(r.k, r.token): r.n for r in text.count_exactly(df, "k", "t").groupBy("k", "token").agg(F.sum("n").alias("n")).collect()}
    want = {("a", "strasse"): 120, ("a", "ǰ²".casefold()): 60, (None, "ab"): 2} | {("a", f"w{i:03d}"): 1 for i in range(60)}
    assert whole == want
    batches = df.mapInArrow(lambda bs: (b for b in bs), df.schema)
    # counts of many texts are one row each, not one for each occurrence
    assert text.count_exactly(batches, "k", "t").count() == len(want)


def test_tokens_of_a_prompt_are_not_shuffled(spark):
    rows = [(f"p{i}", f"alpha{i % 3} beta gamma" if i % 2 else "delta epsilon zeta", "t" if i % 2 else "u") for i in range(40)] + [("none", None, None), ("short", "a b", None)]
    df = spark.createDataFrame(rows, "prompt_id string, prompt string, task string")
    for exact in (False, True):
        model = classify.fit(df, exact=exact)
        out = classify.classify(df, model, explicit=False)
        got = {r.prompt_id: (r.task, r.abstained, r.reason) for r in out.collect()}
        assert all(got[i][:2] == (t, False) for i, _, t in rows[:40])
        assert got["none"][2] == got["short"][2] == "prompt has no classifiable tokens"
        plan = out._jdf.queryExecution().executedPlan().toString()
        # neither a token nor its bucket is a key of an exchange
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and ("token" in x or "bucket" in x)]


def test_kept_rows_are_grouped_where_they_lie(spark):
    df = spark.range(200).select((F.col("id") % 50).cast("string").alias("prompt_id"), F.concat(F.lit("v"), "id").alias("v"))
    held = sizes.kept(df, "prompt_id")
    try:
        assert held.storageLevel.useDisk and not held.storageLevel.useMemory
        by = held.groupBy("prompt_id").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("n"))
        assert {r.n for r in by.collect()} == {4} and by.count() == 50
        plan = by._jdf.queryExecution().executedPlan().toString()
        outer = plan.split("InMemoryTableScan")[0]
        assert "Exchange" not in outer and "Sort [" not in outer
    finally:
        held.unpersist()


def test_clean_is_what_has_no_violations(spark):
    row = lambda p, m, task="t", q=0.5, trace=None, at=None: (p, None, task, trace, at, m, q, 1.0, 0.0, 0.0, None)
    good = [row(p, m) for p in "abc" for m in "mn"]
    for extra, complete in ([], True), ([row("d", "m")], True), ([row("d", "m")], False), ([row("a", "m")], True), ([row("d", "m"), row("d", "n", None)], True), ([row("d", "m"), row("d", None)], True), ([row("d", "m"), row("d", "n", q=2.0)], False), ([row(p, m, trace="u", at=0) for p in "de" for m in "mn"], True):
        obs = spark.createDataFrame(good + extra, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.createDataFrame([], OBSERVATIONS).schema))
        for by_prompt in (False, True):
            table = sizes.kept(obs, "prompt_id") if by_prompt else obs
            assert validate._clean(table, False, complete, by_prompt) == (not validate.violations(obs, False, complete).count())
            table.unpersist()


def test_audits_work_the_matrix_out_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = [(f"p{t:02d}-{i}", None, f"t{i % 2}", f"u{t:02d}", i, m, 0.5 + 0.1 * k, 10.0 * (k + 1), 0.1 * k, 5.0, None) for t in range(40) for i in range(3) for k, m in enumerate("ab")]
    obs = spark.createDataFrame(rows, OBSERVATIONS).mapInArrow(noted, OBSERVATIONS)
    audit(obs, 0.3, "cost", resamples=20)
    assert reads.value == len(rows)


def test_bootstrap_groups_are_spread(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("string").alias("k"), F.col("id").cast("string").alias("g"), F.rand(1).alias("v"))
    out = stats.bootstrap_mersenne(df, ["k"], ["g"], "v", F.lit(42), "g", 20)
    assert out.rdd.glom().filter(len).count() > 4


def test_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, "{}")], "line_no int, value string")
    plan = jsonl.line_violations(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
