"""Streams give what the same rows give as tables."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from matrixloom.operators.route import decide
from matrixloom.streaming import router
from tests.test_policy import policy


def stream(spark, tmp_path, batches, schema):
    """A stream whose micro-batches are the given rows, one file each."""
    src = tmp_path / "in"
    src.mkdir(parents=True)
    names = [x.split()[0] for x in schema.split(", ")]
    for i, rows in enumerate(batches):
        (src / f"{i}.json").write_text("".join(json.dumps({k: v for k, v in zip(names, r, strict=True) if v is not None}) + "\n" for r in rows))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))


def run(df, name, mode, n):
    """What the stream has put out when n rows have come in; a stream with timeouts never ends."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    for _ in range(300):
        if not query.isActive or sum(p.numInputRows for p in query.recentProgress) >= n:
            break
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_warm_models_last_from_batch_to_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    p, rng = policy(), random.Random(9)
    rows = [(f"t{i % 3}", i // 3, f"p{i}", *rng.choice([("sum", 1.0, False, "x"), ("poem", 1.0, False, "x"), ("unknown", 0.2, True, "weak")])) for i in range(30)]
    schema = "trace_id string, sequence_index bigint, prompt_id string, task string, evidence_score double, abstained boolean, reason string"
    df = stream(spark, tmp_path, [rows[:12], rows[12:20], rows[20:]], schema)
    got = {r.prompt_id: tuple(r)[2:] for r in run(router.route_stream(df, p), "routed", "append", 30).collect()}
    warm = {}
    for t, _, ident, task, score, abstained, why in rows:
        want = decide(p, task, score, abstained, why, warm.get(t))
        assert got[ident] == want
        warm[t] = want[0]
    assert len(got) == 30
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def last(table, *keys):
    """Of a table of updates the last one of each key."""
    out = {}
    for r in table.collect():
        out[tuple(r[k] for k in keys)] = r
    return out


def test_gaps_and_last_trials(spark, tmp_path):
    df = stream(spark, tmp_path / "a", [[("t", 0), ("t", 1), ("u", 5)], [("t", 3)], [("t", 2)]], "trace_id string, sequence_index bigint")
    got = last(run(router.trace_gaps(df), "gaps", "update", 5), "trace_id")
    assert {k[0]: (r.n, r.first, r["last"], r.contiguous) for k, r in got.items()} == {"t": (4, 0, 3, True), "u": (1, 5, 5, True)}
    rows = [[("a", "m", 0.1, None, 1), ("a", "n", 0.2, None, 2)], [("a", "m", 0.3, None, 3), ("a", "m", 0.9, "failed", 4), (None, "m", 0.5, None, 5)]]
    df = stream(spark, tmp_path / "b", rows, "task_id string, model string, quality double, error string, line_no bigint")
    got = last(run(router.latest_trials(df), "last_trials", "update", 5), "task_id", "model")
    assert {k: r.quality for k, r in got.items()} == {("a", "m"): 0.3, ("a", "n"): 0.2}


def test_windows(spark, tmp_path):
    rows = [[("2026-01-01 00:10:00", "m", 0.5, 10.0), ("2026-01-01 00:50:00", "m", 0.7, 30.0)], [("2026-01-01 03:00:00", "m", 0.1, 1.0)], [("2026-01-01 03:30:00", "m", 0.1, 1.0)], [("2026-01-01 00:20:00", "m", 0.0, 0.0)]]
    df = stream(spark, tmp_path, rows, "ts string, model string, quality double, latency_ms double")
    got = run(router.windowed_quality(df.withColumn("ts", F.to_timestamp("ts"))), "windows", "append", 5).collect()
    # the last row came after its window had been closed
    assert [(r.model, round(r.quality, 9), r.latency_ms, r.n) for r in got] == [("m", 0.6, 20.0, 2)]
