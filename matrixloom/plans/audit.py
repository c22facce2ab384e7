"""Compile a policy on train and development parts, and audit it on the held-out part."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from matrixloom.functions.hashing import hash_choice
from matrixloom.functions.sizes import kept
from matrixloom.functions.stats import stable_mean
from matrixloom.operators import classify as cl
from matrixloom.operators.evaluate import chosen_rows, compare, equivalent, intervals, model_counts
from matrixloom.operators.fingerprint import fingerprint
from matrixloom.operators.metrics import aggregate_metrics, choose, extremes, pareto_pool
from matrixloom.operators.route import GLOBAL, Metrics, Policy, Rule, warm_fold
from matrixloom.operators.split import PARTS, Split, assignment_digests, split_observations
from matrixloom.operators.validate import heads, trace_coverage, validate
from matrixloom.schema import EPSILON, OBJECTIVES, OptimizationError

LEAST_PROMPTS, LEAST_TRACES, LEAST_HELD_OUT_TRACES = 30, 5, 3
LEAST_PARTS = {"train": 10, "dev": 5, "test": 5}
STRATEGIES = ("always-strongest", "always-cheapest", "always-fastest", "random", "task-only", "warm-only", "compiled", "oracle")
ABOUT = {
    "always-strongest": "The model of best mean quality on development data, always.",
    "always-cheapest": "The model of lowest mean cost on development data, always.",
    "always-fastest": "The model of lowest mean latency on development data, always.",
    "random": "A model by the hash of the prompt id.",
    "task-only": "The compiled rule of the prompt's own task, without a classifier.",
    "warm-only": "The strongest model, kept resident through each trace.",
    "compiled": "Classifier, abstention and kept warm models.",
    "oracle": "The best choice for each prompt in hindsight: a bound, not a router.",
}
NOTES = [
    "The oracle knows the results; it can't be deployed.",
    "Qualities are scores of the graders that were used; no guarantee for other responses follows.",
    "Intervals describe sampling alone: whole traces where traces are complete, else prompts.",
]


def _options(budget: float, objective: str) -> None:
    if objective not in OBJECTIVES or not 0 <= budget <= 1:
        raise OptimizationError("unknown objective, or a quality loss outside 0 to 1")


def _classified(part: DataFrame, policy: Policy) -> DataFrame:
    """A task counts only where there is no prompt text."""
    h = heads(part).withColumn("task", F.when(F.col("prompt").isNull(), F.col("task")))
    return cl.classify(h, policy.classifier, keep=["trace_id", "sequence_index"])


def _loss(part: DataFrame, policy: Policy) -> float:
    """Mean loss of the policy's choices on a part, without warm models."""
    c = _classified(part, policy)
    model = F.lit(policy.fallback)
    for task, rule in policy.routes.items():
        model = F.when(~F.col("abstained") & (F.col("task") == task), rule.model).otherwise(model)
    asg = c.select(F.lit("policy").alias("baseline"), "prompt_id", model.alias("model"), F.lit(True).alias("covered"))
    return chosen_rows(asg, part, policy.fallback, False).agg(stable_mean(F.col("quality_loss"))).first()[0]


def build_policy(split: Split, budget: float, objective: str, seed: int, min_examples: int, exact: bool = True) -> tuple[Policy, float, bool, dict[str, str]]:
    """Policy, its development loss, whether that is within the budget, and the extreme models. What
    comes to the driver has the size of tasks x models."""
    dev = split.of("dev")
    if not dev.limit(1).count():
        raise OptimizationError("the development part is empty")
    found = aggregate_metrics(dev)
    rows = found.collect()
    means = dev.sparkSession.createDataFrame(rows, found.schema)
    extreme = extremes(means).first().asDict()
    fallback = extreme["strongest"]
    pool = tuple(sorted({r.model for r in pareto_pool(means).collect()} | {fallback}))
    by_task = means.where("scope = 'task'")
    picked = {r.task: r.model for r in choose(by_task, ["task"], fallback, budget, objective, list(pool)).collect()}
    metrics: dict[str, dict[str, Metrics]] = {}
    for r in rows:
        metrics.setdefault(r.task if r.scope == "task" else GLOBAL, {})[r.model] = Metrics(r.quality, r.latency_ms, r.cost_usd, r.load_ms, r.samples)
    classifier = cl.fit(heads(split.of("train")), min_examples, exact=exact).restricted(set(metrics) - {GLOBAL})
    routes = {}
    for t in classifier.tasks:
        m = picked.get(t, fallback)
        lost = max(0.0, metrics[t][fallback].quality - metrics[t][m].quality)
        routes[t] = Rule(m, metrics[t][m].quality, lost, f"{m} is the best {objective} choice for {t} on development data within a loss of {budget:.4f}")
    kept = {t: {m: x for m, x in ms.items() if m in pool} for t, ms in metrics.items()}
    policy = Policy(fallback, objective, budget, pool, routes, kept, classifier, seed)
    loss = _loss(dev, policy)
    if loss > budget + EPSILON:
        policy = policy.safe("classifier errors exceeded the development budget; safe fallback")
        loss = _loss(dev, policy)
    return policy, loss, loss <= budget + EPSILON, extreme


@contextmanager
def _kept_split(obs: DataFrame, seed: int, traced: bool, *parts: str) -> Iterator[Split]:
    """The split with its rows on disk, and parts that are read often by themselves."""
    split = split_observations(obs, seed, traced)
    rows = kept(split.obs)
    split = replace(split, obs=rows)
    held = {p: kept(split.of(p)) for p in parts}
    try:
        yield replace(split, held=held)
    finally:
        for df in (*held.values(), rows):
            df.unpersist()


def compile_policy(obs: DataFrame, max_quality_loss: float = 0.02, objective: str = "balanced", seed: int = 42, min_examples: int = 2, exact: bool = True) -> Policy:
    """A policy from the train and development parts; the test part is never read."""
    _options(max_quality_loss, objective)
    obs = kept(obs, "prompt_id")
    try:
        validate(obs, require_signal=True, by_prompt=True)
        facts = trace_coverage(obs).first()
        if facts.n_prompts < 3:
            raise OptimizationError("a policy needs at least three prompts")
        with _kept_split(obs, seed, facts.trace_complete, "dev") as split:
            policy, _, ok, _ = build_policy(split, max_quality_loss, objective, seed, min_examples, exact)
    finally:
        obs.unpersist()
    if not ok:
        raise OptimizationError("the development budget can't be met")
    return policy


def strategies(test: DataFrame, policy: Policy, extreme: dict[str, str], models: list[str], budget: float, objective: str, seed: int, traced: bool) -> DataFrame:
    """(baseline, prompt_id, model, covered) of all strategies."""
    h = heads(test)
    rule = F.lit(policy.fallback)
    for task, r in policy.routes.items():
        rule = F.when(F.col("task") == task, r.model).otherwise(rule)
    fixed = {
        "always-strongest": F.lit(policy.fallback), "always-cheapest": F.lit(extreme["cheapest"]), "always-fastest": F.lit(extreme["fastest"]),
        "random": hash_choice(F.col("prompt_id"), models, seed), "task-only": rule, "warm-only": F.lit(policy.fallback),
    }
    picks = F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), v.alias("model")) for k, v in fixed.items()]))
    out = h.select("prompt_id", "task").select("prompt_id", picks.alias("x")).select("x.baseline", "prompt_id", "x.model", F.lit(True).alias("covered"))
    c = _classified(test, policy)
    if not traced:  # every prompt is a trace of its own
        c = c.withColumn("trace_id", F.col("prompt_id")).withColumn("sequence_index", F.lit(0).cast("bigint"))
    compiled = warm_fold(c, policy).select(F.lit("compiled").alias("baseline"), "prompt_id", "model", (~F.col("abstained")).alias("covered"))
    best = choose(test, ["prompt_id"], policy.fallback, budget, objective).select(F.lit("oracle").alias("baseline"), "prompt_id", "model", F.lit(True).alias("covered"))
    return out.unionByName(compiled).unionByName(best)


@dataclass(frozen=True)
class Audit:
    document: dict
    policy: Policy
    assignments: DataFrame


def audit(obs: DataFrame, max_quality_loss: float = 0.02, objective: str = "balanced", seed: int = 42, min_examples: int = 2, exact: bool = True, resamples: int = 1000) -> Audit:
    """Compile, then compare all strategies once on the held-out part. The matrix and its parts are worked
    out once and kept on disk by prompt, as every step reads them again."""
    _options(max_quality_loss, objective)
    obs = kept(obs, "prompt_id")
    try:
        validate(obs, require_signal=True, by_prompt=True)
        facts = trace_coverage(obs).first()
        traced = facts.trace_complete
        if facts.n_prompts < LEAST_PROMPTS:
            raise OptimizationError(f"an audit needs {LEAST_PROMPTS} prompts; there are {facts.n_prompts}")
        if traced and obs.select("trace_id").distinct().count() < LEAST_TRACES:
            raise OptimizationError(f"an audit of traces needs {LEAST_TRACES} complete traces")
        with _kept_split(obs, seed, traced, "dev", "test") as split:
            return _audited(obs, split, facts, max_quality_loss, objective, seed, min_examples, exact, resamples)
    finally:
        obs.unpersist()


def _audited(obs: DataFrame, split: Split, facts: Row, max_quality_loss: float, objective: str, seed: int, min_examples: int, exact: bool, resamples: int) -> Audit:
    traced = facts.trace_complete
    by_prompt = split.obs.groupBy("prompt_id").agg(F.any_value("part").alias("part"), F.any_value("trace_id").alias("trace_id"))
    sizes = {r.part: r for r in by_prompt.groupBy("part").agg(F.count(F.lit(1)).alias("prompts"), F.count_distinct("trace_id").alias("traces")).collect()}
    short = [f"{p} has {sizes[p].prompts if p in sizes else 0} of {n}" for p, n in LEAST_PARTS.items() if p not in sizes or sizes[p].prompts < n]
    if short or traced and sizes["test"].traces < LEAST_HELD_OUT_TRACES:
        raise OptimizationError("parts are too small: " + (", ".join(short) or "test has too few traces"))
    policy, loss, within, extreme = build_policy(split, max_quality_loss, objective, seed, min_examples, exact)
    test = split.of("test")
    models = sorted(r.model for r in obs.select("model").distinct().collect())
    asg = strategies(test, policy, extreme, models, max_quality_loss, objective, seed, traced)
    chosen = kept(chosen_rows(asg, test, policy.fallback, traced))
    try:
        rows = {r.baseline: r.asDict() for r in compare(chosen).collect()}
        counts = {r.baseline: dict(r.model_counts) for r in model_counts(chosen).collect()}
        cis: dict[str, dict] = {}
        for r in intervals(chosen, traced, seed, {s: i for i, s in enumerate(STRATEGIES)}, resamples).collect():
            cis.setdefault(r.baseline, {})["latency_ms" if r.measure == "latency" else r.measure] = {"low": r.low, "high": r.high, "confidence": r.confidence}
        same = sorted(sorted(r.members) for r in equivalent(chosen.select("baseline", "prompt_id", "model")).collect())
        units = chosen.where("baseline = 'compiled'").agg(F.count_distinct("trace_id" if traced else "prompt_id")).first()[0]
    finally:
        chosen.unpersist()
    baselines = []
    for s in STRATEGIES:
        r = rows[s]
        baselines.append(
            {k: r[k] for k in ("quality", "quality_loss", "cost_usd", "latency_ms", "latency_p50_ms", "latency_p95_ms", "coverage", "routing_regret", "switch_count")}
            | {"name": s, "description": ABOUT[s], "deployable": s != "oracle", "applicable": traced or s != "warm-only", "residency_penalties_applied": traced, "bootstrap_method": "trace_cluster" if traced else "prompt", "bootstrap_unit_count": units, "model_counts": counts[s], "confidence_intervals": cis[s]}
        )
    held = rows["compiled"]["quality_loss"]
    upper = cis["compiled"]["quality_loss"]["high"]
    digests = {(r.unit, r.part): r for r in assignment_digests(split).collect()}
    doc = {
        "schema_version": "matrixloom.audit.v1", "objective": objective, "max_quality_loss": max_quality_loss, "seed": seed, "strongest_model": policy.fallback, "recommended_pool": list(policy.pool), "models": models,
        "workload_fingerprint": fingerprint(obs).first()[0], "trace_complete": traced, "trace_coverage": facts.coverage,
        "split": {"seed": seed, "split_unit": split.unit, "prompt_counts": {p: sizes[p].prompts for p in PARTS}, "assignment_digests": {p: digests["prompt", p].digest for p in PARTS}} | ({"trace_counts": {p: sizes[p].traces for p in PARTS}, "trace_assignment_digests": {p: digests["trace", p].digest for p in PARTS}} if traced else {}),
        "development_constraint": {"observed_quality_loss": loss, "satisfied": within},
        "held_out_constraint": {"observed_quality_loss": held, "quality_loss_ci_upper": upper, "satisfied": held <= max_quality_loss + EPSILON and upper <= max_quality_loss + EPSILON},
        "baselines": baselines, "equivalent_baselines": same, "distinct_baseline_count": len(STRATEGIES) - sum(len(g) - 1 for g in same), "policy": policy.to_dict(), "notes": NOTES,
    }
    return Audit(doc, policy, asg)


# --- gate ------------------------------------------------------------------------------------

COMPATIBLE = ("schema_version", "workload_fingerprint", "models", "seed", "objective", "max_quality_loss")


def _compiled(doc: dict) -> dict:
    for b in doc.get("baselines", []):
        if b.get("name") == "compiled":
            return b
    raise OptimizationError("there is no compiled baseline")


def gate(previous: dict, current: dict, latency_allowance: float = 0.05, cost_allowance: float = 0.05) -> list[str]:
    """What the current audit fails against a compatible earlier one; OptimizationError if the two
    can't be compared."""
    differ = [f for f in COMPATIBLE if previous.get(f) != current.get(f)]
    if differ:
        raise OptimizationError("the audits can't be compared, as these differ: " + ", ".join(differ))
    old, new = _compiled(previous), _compiled(current)
    out = []
    if current["held_out_constraint"]["satisfied"] is not True:
        out.append(f"held-out loss {current['held_out_constraint']['observed_quality_loss']:.6f} is not supported within {current['max_quality_loss']:.6f}")
    for f, allowed in (("latency_ms", latency_allowance), ("cost_usd", cost_allowance)):
        ceiling = float(old[f]) * (1.0 + allowed)
        if float(new[f]) > ceiling + EPSILON:
            out.append(f"{f} {float(new[f]):.6g} is above {ceiling:.6g}")
    return out
