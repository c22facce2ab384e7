"""Classification, decisions, folds, compilation, audit and gate on matrices with known answers."""

import copy
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matrixloom.functions import hashing, stats
from matrixloom.operators import classify as cl
from matrixloom.operators import metrics, route
from matrixloom.operators.route import GLOBAL, Metrics, Policy, Rule, decide
from matrixloom.operators.select import for_prompt, records, row, sizes, subset
from matrixloom.plans.audit import STRATEGIES, audit, compile_policy, gate
from matrixloom.schema import OBSERVATIONS, OptimizationError, PolicyError, ValidationError
from matrixloom.sources.jsonl import load_policy
from matrixloom.sources.sinks import dump_policy

WORDS = {"sum": "add the numbers in column", "poem": "compose a short verse about"}
#: name: quality, latency, cost, load
MODELS = {"best": (0.95, 100.0, 1.0, 60.0), "thrifty": (0.94, 80.0, 0.1, 40.0), "quick": (0.93, 20.0, 0.5, 30.0), "useless": (0.5, 200.0, 2.0, 90.0)}


def matrix(spark, n=48, trace=None, turned=False):
    rows = []
    for i in range(n):
        task = list(WORDS)[i % 2]
        place = (f"t{i // trace:03d}", i % trace) if trace else (None, None)
        for m, (quality, latency, cost, load) in MODELS.items():
            rows.append((f"p{i:04d}", f"{WORDS[task]} item {i}", task, *place, m, quality, latency + i % 3, cost, load, None))
    return spark.createDataFrame(rows[::-1] if turned else rows, OBSERVATIONS)


@pytest.fixture(scope="module")
def plain_audit(spark):
    return audit(matrix(spark), 0.02, "balanced", seed=8, resamples=60)


@pytest.fixture(scope="module")
def traced_audit(spark):
    return audit(matrix(spark, 60, 3), 0.02, "latency", resamples=60)


def test_pool_leaves_out_what_another_model_beats(spark):
    means = metrics.aggregate_metrics(matrix(spark, 12))
    assert {r.model for r in metrics.pareto_pool(means).collect()} == {"best", "thrifty", "quick"}


@pytest.mark.parametrize("budget,objective,chosen", [(0.02, "cost", "thrifty"), (0.02, "latency", "quick"), (0.005, "cost", "best")])
def test_routes_follow_budget_and_objective(spark, budget, objective, chosen):
    p = compile_policy(matrix(spark), budget, objective)
    assert p.fallback == "best" and set(p.routes) == set(WORDS) and {r.model for r in p.routes.values()} == {chosen}
    assert "useless" not in p.pool and all(r.quality_loss <= budget for r in p.routes.values())


def test_audit_of_prompts(plain_audit):
    d = plain_audit.document
    by = {b["name"]: b for b in d["baselines"]}
    assert tuple(by) == STRATEGIES and not by["oracle"]["deployable"] and by["always-strongest"]["quality_loss"] == 0
    assert d["development_constraint"]["satisfied"] and not d["trace_complete"]
    assert all(b["switch_count"] is None and not b["residency_penalties_applied"] and b["bootstrap_method"] == "prompt" for b in by.values())
    assert not by["warm-only"]["applicable"] and by["compiled"]["confidence_intervals"]["quality"]["low"] <= by["compiled"]["quality"]
    held, upper = d["held_out_constraint"], by["compiled"]["confidence_intervals"]["quality_loss"]["high"]
    assert held["quality_loss_ci_upper"] == upper and held["satisfied"] == (held["observed_quality_loss"] <= 0.02 and upper <= 0.02)
    for name, model in (("always-strongest", "best"), ("always-cheapest", "thrifty"), ("always-fastest", "quick"), ("warm-only", "best")):
        assert set(by[name]["model_counts"]) == {model}
    assert sum(by["random"]["model_counts"].values()) == d["split"]["prompt_counts"]["test"]
    assert ["always-strongest", "warm-only"] in [sorted(set(g) & {"always-strongest", "warm-only"}) for g in d["equivalent_baselines"]]
    assert d["distinct_baseline_count"] == 8 - sum(len(g) - 1 for g in d["equivalent_baselines"])


def test_audit_of_traces(traced_audit):
    d = traced_audit.document
    by = {b["name"]: b for b in d["baselines"]}
    assert d["trace_complete"] and by["warm-only"]["applicable"]
    assert all(b["residency_penalties_applied"] and b["bootstrap_method"] == "trace_cluster" and b["bootstrap_unit_count"] == d["split"]["trace_counts"]["test"] >= 3 for b in by.values())
    # one model throughout loads once a trace and never switches
    n, t = d["split"]["prompt_counts"]["test"], d["split"]["trace_counts"]["test"]
    assert by["warm-only"]["switch_count"] == 0 and n == 3 * t
    rows = {r.prompt_id: r for r in traced_audit.assignments.where("baseline = 'warm-only'").collect()}
    want = sum(100.0 + int(p[1:]) % 3 + (60.0 if int(p[1:]) % 3 == 0 else 0) for p in rows) / n
    assert by["warm-only"]["latency_ms"] == pytest.approx(want)


def test_audit_doesnt_depend_on_the_order_of_rows(spark, plain_audit):
    again = audit(matrix(spark, turned=True).repartition(3), 0.02, "balanced", seed=8, resamples=60).document
    assert json.dumps(again, sort_keys=True) == json.dumps(plain_audit.document, sort_keys=True)


def test_small_matrices_are_refused(spark):
    for obs, why in ((matrix(spark, 29), "30 prompts"), (matrix(spark, 60, 15), "5 complete traces"), (matrix(spark, 30).where("prompt_id < 'p0012'"), "30 prompts")):
        with pytest.raises(OptimizationError, match=why):
            audit(obs)
    with pytest.raises(OptimizationError):
        audit(matrix(spark), max_quality_loss=1.5)
    with pytest.raises(OptimizationError):
        compile_policy(matrix(spark), objective="speed")
    with pytest.raises(ValidationError):
        audit(matrix(spark).withColumns({"prompt": F.lit(None).cast("string"), "task": F.lit(None).cast("string")}))


@pytest.mark.parametrize("field,other", [("schema_version", "v999"), ("workload_fingerprint", "sha256:0"), ("models", ["m"]), ("seed", 9), ("objective", "cost"), ("max_quality_loss", 0.5)])
def test_gate_refuses_what_cant_be_compared(plain_audit, field, other):
    with pytest.raises(OptimizationError, match=field):
        gate(plain_audit.document | {field: other}, plain_audit.document)


def test_gate_ceilings(plain_audit):
    def scaled(**by):
        d = copy.deepcopy(plain_audit.document)
        d["held_out_constraint"]["satisfied"] = True
        one = next(b for b in d["baselines"] if b["name"] == "compiled")
        for k, f in by.items():
            one[k] *= f
        return d

    assert gate(scaled(), scaled()) == [] and gate(scaled(), scaled(latency_ms=1.049, cost_usd=1.049)) == []
    assert [x.split()[0] for x in gate(scaled(), scaled(latency_ms=1.06, cost_usd=1.2))] == ["latency_ms", "cost_usd"]
    assert gate(scaled(), scaled(latency_ms=1.06), latency_allowance=0.1) == []
    failed = scaled()
    failed["held_out_constraint"]["satisfied"] = False
    assert len(gate(scaled(), failed)) == 1
    with pytest.raises(OptimizationError):
        gate(scaled() | {"baselines": []}, scaled())


def test_mersenne_draws_are_those_of_plain_python():
    def plain(groups, seed, n):
        rng, means = random.Random(seed), []
        for _ in range(n):
            drawn = [groups[rng.randrange(len(groups))] for _ in groups]
            means.append(sum(map(sum, drawn)) / sum(map(len, drawn)))
        means.sort()
        at = lambda p: means[int((n - 1) * p)] * (1 - (n - 1) * p % 1) + means[min(n - 1, int((n - 1) * p) + 1)] * ((n - 1) * p % 1)
        return at(0.025), at(0.975)

    rng = random.Random(2)
    for groups in ([[rng.random()] for _ in range(40)], [[rng.random() for _ in range(rng.randrange(1, 9))] for _ in range(15)]):
        low, high, c = stats.mersenne_interval(groups, 11, 200)
        assert (low, high) == pytest.approx(plain(groups, 11, 200)) and c == 0.95
    assert stats.mersenne_interval([[2.5]], 1, 10)[:2] == (2.5, 2.5)


# --- decisions ------------------------------------------------------------------------------------


def policy(load=40.0):
    m = {"best": Metrics(0.95, 100, 1, 60), "thrifty": Metrics(0.94, 80, 0.1, load), "poor": Metrics(0.5, 10, 0.1, 5)}
    other = {"best": Metrics(0.9, 90, 1, 60), "thrifty": Metrics(0.9, 70, 0.1, load), "poor": Metrics(0.4, 9, 0.1, 5)}
    return Policy("best", "cost", 0.02, ("best", "poor", "thrifty"), {"sum": Rule("thrifty", 0.94, 0.01, "cheapest"), "poem": Rule("best", 0.95, 0.0, "none is cheaper")}, {"sum": m, "poem": other, GLOBAL: m}, cl.TaskClassifier({"sum": 2, "poem": 2}, {"sum": {1: 2}, "poem": {2: 2}}, exact=False))


@pytest.mark.parametrize("switch", [0.0, 10.0, 1000.0])
def test_batch_decides_as_one_by_one(spark, switch):
    p = policy()
    rows = [(f"p{i}", None, task, warm) for i, (task, warm) in enumerate((t, w) for t in ("sum", "poem", "never seen", None) for w in (None, "", "best", "thrifty", "poor", "elsewhere"))]
    rows += [("p0", None, "sum", "best"), ("p0", None, "sum", None)]  # repeated ids stay apart
    df = spark.createDataFrame(rows, "prompt_id string, prompt string, task string, warm_model string")
    c = {(r.prompt_id, r.warm_model): r for r in cl.classify(df, p.classifier, keep=["warm_model"]).collect()}
    got = defaultdict(list)
    for r in route.route_batch(df, p, switch).collect():
        got[r.prompt_id].append(tuple(r)[1:])
    want = defaultdict(list)
    for i, _, _, warm in rows:
        r = c[i, warm]
        want[i].append(decide(p, r.task, r.evidence_score, r.abstained, r.reason, warm, switch))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()} and len(got["p0"]) == 3


def test_fold_is_a_fold_of_decisions(spark):
    p, rng = policy(), random.Random(3)
    rows = [(f"t{t}", i, f"p{t}-{i}", *rng.choice([("sum", 1.0, False, ""), ("poem", 1.0, False, ""), ("unknown", 0.3, True, "weak")])) for t in range(6) for i in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "trace_id string, sequence_index bigint, prompt_id string, task string, evidence_score double, abstained boolean, reason string").repartition(4)
    got = {r.prompt_id: tuple(r)[1:] for r in route.warm_fold(df, p).collect()}
    warm = {}
    for t, _, ident, task, score, abstained, why in rows:
        want = decide(p, task, score, abstained, why, warm.get(t))
        assert got[ident] == want
        warm[t] = want[0]
    assert len(got) == len(rows)


def test_scan_is_the_same_fold_by_steps(spark):
    rng = random.Random(4)
    steps = [("a", frozenset()), ("b", frozenset("a")), ("c", frozenset("ab")), ("a", frozenset("abc"))]
    rows = [(f"t{t}", i, f"{t}-{i}", rng.randrange(4)) for t in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "trace_id string, sequence_index bigint, prompt_id string, step int").repartition(3)
    got = {r.prompt_id: r.model for r in route.warm_scan(df, steps).collect()}
    warm = {}
    for t, _, ident, k in rows:
        model, kept = steps[k]
        warm[t] = warm[t] if warm.get(t) in kept else model
        assert got[ident] == warm[t]


def test_kept_models_are_those_that_decide_keeps():
    for load in (0.0, 10.0, 40.0):
        p = policy(load)
        for task, rule in p.routes.items():
            kept = route.kept_models(p.metrics[task], rule.model, p.fallback, p.max_quality_loss)
            assert kept == {m for m in p.pool if m != rule.model and decide(p, task, 1.0, False, "", m)[0] == m}


def test_policies_round_trip_and_refuse_contradictions(tmp_path):
    p = policy()
    assert load_policy(dump_policy(p, tmp_path / "policy.json")) == p
    good = p.to_dict()
    for change in ({"schema_version": "v999"}, {"pool": ["thrifty"]}, {"pool": ["thrifty", "best", "poor"]}, {"objective": "x"}, {"routes": {}}, {"max_quality_loss": 2}, {"model_metrics": {}}):
        with pytest.raises(PolicyError):
            load_policy(good | change)
    (tmp_path / "bad.json").write_text("{")
    for source in (tmp_path / "bad.json", {}):
        with pytest.raises(PolicyError):
            load_policy(source)
    for bad in ({"quality": float("nan")}, {"quality": 1.5}, {"latency_ms": -1.0}):
        with pytest.raises(PolicyError):
            Metrics(**({"quality": 0.5, "latency_ms": 1.0, "cost_usd": 0.0} | bad))


def test_classifier_keeps_no_words(spark):
    rows = [(f"p{i}", f"zyzzyva {WORDS[t]} {i}", t) for i, t in enumerate(["sum", "poem"] * 4)]
    heads = spark.createDataFrame(rows, "prompt_id string, prompt string, task string")
    c = cl.fit(heads)
    assert c.examples == {"sum": 4, "poem": 4} and "zyzzyva" not in json.dumps(c.to_dict()) and cl.TaskClassifier.from_dict(c.to_dict()) == c
    ask = [("a", "please add numbers", None), ("b", "a verse please", None), ("c", "quite unrelated", None), ("d", "", None), ("e", None, None), ("f", "add numbers", "poem"), ("g", "add numbers", "other")]
    got = {r.prompt_id: (r.task, r.abstained) for r in cl.classify(spark.createDataFrame(ask, "prompt_id string, prompt string, task string"), c).collect()}
    assert got["a"] == ("sum", False) and got["b"] == ("poem", False) and got["f"] == ("poem", False)
    assert all(got[k] == ("unknown", True) for k in "cdeg")
    assert c.restricted({"sum"}).tasks == ("sum",)


def test_older_classifiers_are_read(spark):
    words = {"sum": {"add": 3, "numbers": 2}, "poem": {"verse": 2, "short": 1}}
    old = {"known_tasks": ["sum", "poem"], "task_examples": {"sum": 3, "poem": 2, "rare": 1}, "token_counts": words, "min_examples": 2, "min_confidence": 0.6, "min_margin": 0.2}
    new = [cl.TaskClassifier.from_dict(d) for d in (old, old | {"type": "token-evidence-v1"})]
    assert new[0] == new[1] and new[0].min_score == 0.6 and new[0].examples == {"sum": 3, "poem": 2}
    token = spark.createDataFrame([(w,) for c in words.values() for w in c], "w string")
    column = {r.w: r.b for r in token.select("w", hashing.feature_bucket(F.col("w")).alias("b")).collect()}
    assert new[0].counts == {t: {column[w]: n for w, n in c.items()} for t, c in words.items()}
    assert cl.TaskClassifier.from_dict(new[0].to_dict()) == new[0]
    good = new[0].to_dict()
    bad = [old | {"type": "other"}, old | {"min_margin": True}, old | {"min_confidence": float("nan")}, old | {"min_examples": 0}, old | {"feature_bucket_count": 1}, old | {"known_tasks": ["none"]}, old | {"token_counts": {"sum": {"add": 1.5}, "poem": {}}}, good | {"feature_counts": {"sum": {"x": 1}, "poem": {}}}, good | {"feature_counts": []}, {}]
    for d in bad:
        with pytest.raises(PolicyError):
            cl.TaskClassifier.from_dict(d)


# --- selections -----------------------------------------------------------------------------------


def test_selections(spark):
    obs = matrix(spark, 12)
    assert for_prompt(obs, "p0003").count() == 4 and row(obs, "p0003", "quick").quality == 0.93
    with pytest.raises(KeyError):
        row(obs, "p0003", "none")
    assert tuple(sizes(subset(obs, ["p0001", "p0004", "p0004"])).first()) == (8, 2, 4) and subset(obs, []).count() == 0
    with pytest.raises(KeyError, match="p9999"):
        subset(obs, ["p0001", "p9999"])
    got = records(subset(obs, ["p0001"]))
    assert [r["model"] for r in got] == sorted(MODELS) and "trace_id" not in got[0]
