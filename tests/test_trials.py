"""Trials over several files, suites, graders against their exact versions, and locks."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from matrixloom.functions import text
from matrixloom.operators import trials
from matrixloom.schema import ValidationError
from matrixloom.sources import jsonl, sinks

TRIAL = "task_id string, model string, quality double, correct boolean, generation_ms double, load_ms double, error string"


def trial(task, model, quality, error=None, load=0.0):
    return (task, model, quality, quality > 0.5, 10.0 * quality, load, error)


def test_last_write_wins_over_all_files(spark, tmp_path):
    path = str(tmp_path / "trials")
    runs = [[trial("a", "m", 0.1), trial("b", "m", 0.2), trial("a", "n", 0.3, load=7.0)], [trial("a", "m", 0.4), trial("b", "m", 0.9, "failed")], [trial("b", "n", 0.6), trial("a", "m", 0.7), trial("a", "m", 0.8)]]
    for rows in runs:
        sinks.append_trials(spark.createDataFrame(rows, TRIAL).repartition(3) if len(rows) == 2 else spark.createDataFrame(rows, TRIAL).coalesce(1), path)
    (tmp_path / "trials" / "part-extra.txt").write_text('\n{"broken\n{"task_id":"a","model":"m","quality":0.05}\r\n{"task_id":"c","model":"m","quality":0.5}\n[1]\n{"task_id":"c","model":"m","quality":0.55}\n{"task_id":"","model":"m","quality":1}\n')
    read = jsonl.load_trials(spark, path)
    got = {(r.task_id, r.model): r.quality for r in trials.last_write(read).collect()}
    assert got == {("a", "m"): 0.8, ("b", "m"): 0.2, ("a", "n"): 0.3, ("b", "n"): 0.6, ("c", "m"): 0.55}
    # appended again, after having been read: the order is that of the appends
    sinks.append_trials(trials.last_write(read).where("task_id = 'b'").withColumn("quality", F.lit(0.33)), path)
    again = {(r.task_id, r.model): r.quality for r in trials.last_write(jsonl.load_trials(spark, path)).collect()}
    assert again == got | {("b", "m"): 0.33, ("b", "n"): 0.33}


def test_from_trials_to_a_matrix(spark):
    rows = [trial(t, m, 0.6, load=ld) for t, ld in (("a", 5.0), ("b", 0.0), ("c", 9.0)) for m in ("m", "n")] + [trial("d", "m", 0.6)]
    t = trials.last_write(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TRIAL + ", line_no int"))
    suite = spark.createDataFrame([(x, i, "k", "p", "exact_string") for i, x in enumerate("dcba")], "task_id string, pos int, task string, prompt string, grader string")
    got = sorted(map(tuple, trials.to_matrix(t, suite, ["m", "n"]).select("prompt_id", "sequence_index", "model", "load_ms").collect()))
    assert got == [(x, i, m, 9.0) for x, i in (("a", 2), ("b", 1), ("c", 0)) for m in ("m", "n")]
    assert [r.task_id for r in trials.dropped(t, suite, ["m", "n"]).collect()] == ["d"]
    models = spark.createDataFrame([("m",), ("n",)], "model string")
    assert [tuple(r) for r in trials.outstanding(suite, models, t).collect()] == [("d", "n")]


def test_suites(spark, tmp_path):
    one = {"id": "a", "task": "k", "prompt": " p ", "expected": "1", "grader": "exact_number"}
    path = tmp_path / "suite.jsonl"
    path.write_text("# comment\n\n" + json.dumps(one) + "\n" + json.dumps(one | {"id": "b", "grader_arg": "0.5"}) + "\n")
    got = jsonl.load_tasks(spark, str(path)).orderBy("pos").collect()
    assert [(r.task_id, r.prompt, r.grader_arg) for r in got] == [("a", "p", None), ("b", "p", "0.5")]
    for bad in (one | {"more": 1}, one | {"grader": "guess"}, one | {"prompt": " "}, one | {"grader_arg": 5}, {k: v for k, v in one.items() if k != "expected"}, one | {"prompt": "x" * 2001}):
        path.write_text(json.dumps(one | {"id": "z"}) + "\n" + json.dumps(bad) + "\n")
        with pytest.raises(ValidationError, match="line 2"):
            jsonl.load_tasks(spark, str(path))
    path.write_text(json.dumps(one) + "\n" + json.dumps(one) + "\n")
    with pytest.raises(ValidationError, match="repeated"):
        jsonl.load_tasks(spark, str(path))


def test_limits_of_files(spark, tmp_path):
    line = json.dumps({"prompt_id": "p", "model": "m", "quality": 1, "latency_ms": 1, "cost_usd": 0})
    path = tmp_path / "x.jsonl"
    path.write_text(line + "\n" + line.replace('"p"', '"q"') + "\n")
    assert jsonl.load_jsonl(spark, str(path)).count() == 2
    for limit in ({"max_bytes": 50}, {"max_rows": 1}):
        with pytest.raises(ValidationError):
            jsonl.load_jsonl(spark, str(path), **limit)
    path.write_bytes(b"\xff\xfe\n")
    with pytest.raises(ValidationError):
        jsonl.load_jsonl(spark, str(path))


def test_profiles(spark, tmp_path):
    doc = {"models": [{"model": "m", "observations": [{"repeat": i, "load_duration_ms": float(v), "total_duration_ms": 2.0 * v} for i, v in enumerate((5, 1, 9))]}]}
    (tmp_path / "profile.json").write_text(json.dumps(doc))
    got = {tuple(r) for r in trials.profile_summary(jsonl.load_profile(spark, str(tmp_path / "profile.json"))).collect()}
    assert got == {("m", "load_duration_ms", 5.0, 1.0, 9.0), ("m", "total_duration_ms", 10.0, 2.0, 18.0)}


ANSWERS = ["The answer is 42.", "<think>7</think> Final answer: 1,234.5", "```json\n{\"a\": \"Yes\", \"b\": 2}\n```", "x {\"a\": [1, 2]} y", "", "<reasoning>never closed 42", "first line\nlast line.", "**Yes**", "{bad json}", "-3e5 and .5", "A, b and C", "no numbers here", "Result: yes\nbecause"]
SPECS = [("exact_number", "42", None), ("exact_number", "1234", "1"), ("exact_number", "0.5", "x"), ("exact_number", "many", None), ("exact_number", "5", "-1"), ("exact_string", "yes", None), ("exact_string", "Last line", None), ("exact_string", " .", None), ("json_field", "yes", "a"), ("json_field", "2", "b"), ("json_field", "x", ""),
         ("contains_all", "a,b , c", None), ("contains_all", " , ", None), ("contains_all", "x", "yes,42"), ("regex", "x", r"\d+"), ("regex", "^last", None), ("regex", "(", None), ("regex", "x", "y" * 501), ("regex", "yes", None)]


def test_graders_in_columns_against_exact_python(spark):
    """Where plain Python refuses a specification, the column gives a reason and no score."""
    rows = [(i, r, e, g, a) for i, (r, (g, e, a)) in enumerate((r, s) for r in ANSWERS for s in SPECS)]
    df = spark.createDataFrame(rows, "i int, r string, e string, g string, a string")
    got = {x.i: (x.s.score, x.s.correct, x.s.reason) for x in df.select("i", text.grade(F.col("r"), F.col("e"), F.col("g"), F.col("a")).alias("s")).collect()}
    refused = 0
    for i, r, e, g, a in rows:
        try:
            want = text.py_grade(r, e, g, a)
        except text.GraderError:
            refused += 1
            assert got[i][:2] == (None, None) and got[i][2], rows[i]
            continue
        assert got[i] == want, rows[i]
    assert refused == 8 * len(ANSWERS)
    exact = df.where("g in ('exact_string', 'regex') and e not in ('(', ' .') and (a is null or length(a) < 500)")
    for x in exact.select("i", text.grade_exactly("r", "e", "g", "a").alias("s")).collect():
        assert tuple(x.s) == got[x.i]


def test_names_and_residency(spark):
    asked = lambda *names: spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    have = spark.createDataFrame([(0, "m:latest", "m:latest"), (0, "m:latest", "m"), (1, "n:7b", "n:7b"), (1, "n:7b", "m")], "pos int, canonical string, name string")
    assert sorted(map(tuple, trials.resolve_models(asked(" m ", "n:7b", "m:latest"), have).collect())) == [("m", "m:latest"), ("n:7b", "n:7b")]
    for names in (("m", "zz"), (" ",), ()):
        with pytest.raises(ValueError):
            trials.resolve_models(asked(*names), have)
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "model string")
    assert sorted(map(tuple, trials.residency_difference(one("a", "b", "b"), one("b", "c")).collect())) == [("a", "missing"), ("c", "additional")]


def test_milliseconds(spark):
    df = spark.createDataFrame([(0, "0"), (1, "1234567"), (2, "-1"), (3, "x"), (4, None)], "i int, v string")
    got = {r.i: r.ms for r in df.select("i", trials.milliseconds(F.expr("try_cast(v as double)")).alias("ms")).collect()}
    assert got == {0: 0.0, 1: 1.234567, 2: None, 3: None, 4: None}


def test_single_writer(tmp_path):
    out = tmp_path / "matrix"
    with sinks.single_writer(out):
        assert (tmp_path / "matrix.lock").read_text() == str(os.getpid())
    assert not (tmp_path / "matrix.lock").exists()
    (tmp_path / "matrix.lock").write_text("1")  # init is alive
    with pytest.raises(sinks.ConcurrentRunError), sinks.single_writer(out):
        pass
    (tmp_path / "matrix.lock").write_text("999999999")
    with sinks.single_writer(out):
        pass


def test_written_whole_or_not_at_all(tmp_path):
    target = tmp_path / "a" / "b.json"
    sinks.dump_json({"b": 1, "a": [None]}, target)
    assert list(json.loads(target.read_text())) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.dump_json({"x": float("nan")}, target)
    assert json.loads(target.read_text()) == {"a": [None], "b": 1} and [p.name for p in target.parent.iterdir()] == ["b.json"]


def test_round_robin(spark):
    rng = random.Random(1)
    rows = [(f"t{i}", i, rng.choice("xyz")) for i in range(30)]
    suite = spark.createDataFrame(rows, "task_id string, pos int, task string")
    turn, first = {}, {}
    for t, i, k in rows:
        first.setdefault(k, i)
        turn[t] = (sum(1 for _, j, m in rows if m == k and j < i), first[k])
    for n in (1, 7, 40):
        assert {r.task_id for r in trials.select_tasks(suite, n).collect()} == set(sorted(turn, key=turn.get)[:n])
    assert trials.select_tasks(suite).count() == 30
    for bad in (0, True):
        with pytest.raises(ValueError):
            trials.select_tasks(suite, bad)


def test_appends_are_stamped_in_order(spark, tmp_path):
    for q in (0.1, 0.2):
        sinks.append_trials(spark.createDataFrame([trial("a", "m", q)], TRIAL), str(tmp_path / "t"))
        time.sleep(0.001)
    stamps = [r.place.written_at for r in jsonl.load_trials(spark, str(tmp_path / "t")).orderBy("quality").collect()]
    assert stamps == sorted(stamps) and len(set(stamps)) == 2
