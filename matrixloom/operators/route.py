"""Route decisions: the compiled rule for a task, kept warm models, and the fold over traces."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions.sizes import small_rows
from matrixloom.operators.classify import UNKNOWN, TaskClassifier, classify
from matrixloom.schema import EPSILON, OBJECTIVES, PolicyError

POLICY_VERSION = "matrixloom.policy.v1"
GLOBAL = "__global__"
DECISION = "model string, task string, evidence_score double, abstained boolean, used_warm_model boolean, fallback_model string, reason string, expected_quality double, expected_latency_ms double, expected_cost_usd double, switch_penalty_ms double"


@dataclass(frozen=True)
class Metrics:
    quality: float
    latency_ms: float
    cost_usd: float
    load_ms: float = 0.0
    samples: int = 1

    def __post_init__(self) -> None:
        values = (self.quality, self.latency_ms, self.cost_usd, self.load_ms)
        if any(isinstance(v, bool) or not math.isfinite(v) or v < 0 for v in values) or self.quality > 1 or self.samples < 1:
            raise PolicyError("expected metrics must be finite, not negative, and quality at most 1")


@dataclass(frozen=True)
class Rule:
    model: str
    expected_quality: float
    quality_loss: float
    reason: str


@dataclass(frozen=True)
class Policy:
    """Small, driver-side: at most tasks x models metrics and the classifier's counts.
    metrics: {task, or GLOBAL: {model: Metrics}}."""

    fallback: str
    objective: str
    max_quality_loss: float
    pool: tuple[str, ...]
    routes: dict[str, Rule]
    metrics: dict[str, dict[str, Metrics]]
    classifier: TaskClassifier
    seed: int = 42
    version: str = field(default=POLICY_VERSION)

    def __post_init__(self) -> None:
        if self.version != POLICY_VERSION:
            raise PolicyError(f"policy version {self.version!r} is not supported")
        if self.objective not in OBJECTIVES or not 0 <= self.max_quality_loss <= 1:
            raise PolicyError("unknown objective, or a quality loss outside 0 to 1")
        if list(self.pool) != sorted(set(self.pool)) or self.fallback not in self.pool:
            raise PolicyError("the pool must be sorted, without repeats, and hold the fallback")
        if set(self.pool) - set(self.metrics.get(GLOBAL, {})):
            raise PolicyError("every model of the pool needs global metrics")
        if any(r.model not in self.pool for r in self.routes.values()) or set(self.classifier.tasks) - set(self.routes):
            raise PolicyError("routes must lead into the pool and cover every task of the classifier")

    def metrics_for(self, task: str, model: str) -> Metrics | None:
        return self.metrics.get(task, {}).get(model) or self.metrics.get(GLOBAL, {}).get(model)

    def to_dict(self) -> dict:
        return {
            "schema_version": self.version, "fallback_model": self.fallback, "objective": self.objective, "max_quality_loss": self.max_quality_loss, "pool": list(self.pool), "seed": self.seed,
            "routes": {t: {"task": t, **vars(r)} for t, r in sorted(self.routes.items())},
            "model_metrics": {t: {m: dict(vars(x)) for m, x in sorted(ms.items())} for t, ms in sorted(self.metrics.items())},
            "classifier": self.classifier.to_dict(),
        }

    @classmethod
    def from_dict(cls, d: dict) -> Policy:
        try:
            routes = {t: Rule(r["model"], r["expected_quality"], r["quality_loss"], r["reason"]) for t, r in d["routes"].items()}
            metrics = {t: {m: Metrics(**x) for m, x in ms.items()} for t, ms in d["model_metrics"].items()}
            return cls(d["fallback_model"], d["objective"], d["max_quality_loss"], tuple(d["pool"]), routes, metrics, TaskClassifier.from_dict(d["classifier"]), d.get("seed", 42), d["schema_version"])
        except (KeyError, TypeError, AttributeError) as e:
            raise PolicyError(f"not a policy: {e}") from None

    def safe(self, reason: str) -> Policy:
        """Every route to the fallback."""
        routes = {t: Rule(self.fallback, self.metrics[t][self.fallback].quality, 0.0, reason) for t in self.routes}
        return replace(self, routes=routes)


def decide(policy: Policy, task: str, score: float, abstained: bool, why: str, warm: str | None, switch_cost: float = 0.0) -> tuple:
    """One decision, in the order of DECISION, given what the classifier said and the warm model."""

    def out(model: str, task: str, abstained: bool, used: bool, reason: str, penalty: float = 0.0) -> tuple:
        m = policy.metrics_for(task, model)
        seen = (m.quality, m.latency_ms, m.cost_usd) if m else (None, None, None)
        return (model, task, score, abstained, used, policy.fallback, reason, *seen, penalty)

    rule = policy.routes.get(task)
    if abstained or rule is None:
        why = why if abstained else "classified task has no route"
        return out(policy.fallback, task if abstained else UNKNOWN, True, warm == policy.fallback, f"abstained to strongest fallback: {why}")
    if warm is None:
        return out(rule.model, task, False, False, rule.reason)
    if warm == rule.model:
        return out(warm, task, False, True, f"routed model for {task} is warm already")
    if warm not in policy.pool:
        return out(rule.model, task, False, False, f"{rule.reason}; the warm model is outside the pool")
    chosen, held, base = (policy.metrics_for(task, m) for m in (rule.model, warm, policy.fallback))
    if chosen is None or held is None or base is None:
        return out(rule.model, task, False, False, f"{rule.reason}; no metrics to compare the warm model by")
    floor = base.quality - policy.max_quality_loss
    if held.quality + EPSILON < floor:
        return out(rule.model, task, False, False, f"{rule.reason}; warm quality {held.quality:.4f} is below the floor {floor:.4f}")
    penalty, gain = chosen.load_ms + switch_cost, max(0.0, held.latency_ms - chosen.latency_ms)
    if penalty + EPSILON >= gain:
        return out(warm, task, False, True, f"kept the warm model: loading costs {penalty:.2f} ms for a gain of {gain:.2f} ms", penalty)
    return out(rule.model, task, False, False, f"{rule.reason}; a gain of {gain:.2f} ms is worth loading for {penalty:.2f} ms", penalty)


_NAMES = [x.split()[0] for x in DECISION.split(", ")]
#: A warm model that no metrics are known of; all such are decided alike.
_ELSEWHERE = "\0elsewhere"


def decisions(spark: SparkSession, policy: Policy, switch_cost: float = 0.0) -> DataFrame:
    """(on_task, on_warm, and DECISION) of every routed task and warm model, none and one outside the
    pool included: tasks x models rows, as many as the policy itself has."""
    rows = []
    for task in policy.routes:
        for warm in (None, *policy.pool, _ELSEWHERE):
            got = decide(policy, task, 1.0, False, "", warm, switch_cost)
            rows.append((task, warm or "", *(float(x) if type(x) is int else x for x in got)))
    return spark.createDataFrame(rows, "on_task string, on_warm string, " + DECISION)


def route_batch(prompts: DataFrame, policy: Policy, switch_cost: float = 0.0) -> DataFrame:
    """Decisions for rows of prompt_id, prompt, task, warm_model: rows don't depend on each other.

    Routed tasks meet the table of all decisions; abstentions are written out as expressions. No
    row passes through Python.
    """
    c = classify(prompts, policy.classifier, keep=["warm_model"])
    routed = ~F.col("abstained") & F.col("task").isin(list(policy.routes))
    warm = F.when(F.col("warm_model").isNull(), "").when(F.col("warm_model").isin(list(policy.pool)), F.col("warm_model")).otherwise(_ELSEWHERE)
    table = decisions(prompts.sparkSession, policy, switch_cost).withColumnsRenamed({n: f"d_{n}" for n in _NAMES})
    c = c.withColumn("on_task", F.when(routed, F.col("task"))).withColumn("on_warm", warm).join(small_rows(table, len(policy.routes) * (len(policy.pool) + 2), 16), ["on_task", "on_warm"], "left")
    task = F.when(F.col("abstained"), F.col("task")).otherwise(UNKNOWN)
    why = F.when(F.col("abstained"), F.col("reason")).otherwise("classified task has no route")
    seen = policy.metrics.get(GLOBAL, {}).get(policy.fallback)
    expected = {t: policy.metrics_for(t, policy.fallback) for t in (*policy.metrics, UNKNOWN)}

    def of(field: str) -> Column:
        out = F.lit(getattr(seen, field) if seen else None).cast("double")
        for t, m in expected.items():
            if m is not None and m != seen:
                out = F.when(task == t, getattr(m, field)).otherwise(out)
        return out

    fallback = {
        "model": F.lit(policy.fallback), "task": task, "evidence_score": F.col("evidence_score"), "abstained": F.lit(True), "used_warm_model": F.coalesce(F.col("warm_model") == policy.fallback, F.lit(False)), "fallback_model": F.lit(policy.fallback),
        "reason": F.concat(F.lit("abstained to strongest fallback: "), why), "expected_quality": of("quality"), "expected_latency_ms": of("latency_ms"), "expected_cost_usd": of("cost_usd"), "switch_penalty_ms": F.lit(0.0),
    }
    known = F.col("d_model").isNotNull()
    return c.select("prompt_id", *[F.when(known, F.col("evidence_score" if n == "evidence_score" else f"d_{n}")).otherwise(fallback[n]).alias(n) for n in _NAMES])


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Traces whole and in order, for one pass that holds no more than the state of a trace."""
    return rows.repartition(keys[0]).sortWithinPartitions(*keys)


def warm_fold(classified: DataFrame, policy: Policy, switch_cost: float = 0.0) -> DataFrame:
    """(prompt_id, decision) with the model of a prompt warm for the next one of its trace.

    classified: what classify() gives, with trace_id and sequence_index. The fold is sequential
    within a trace and parallel over traces; equal situations are decided once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        trace, warm = None, None
        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("trace_id", "task", "abstained", "reason", "evidence_score")]
            rows = []
            for at, task, abstained, why, score in zip(*cols, strict=True):
                if at != trace:
                    trace, warm = at, None
                key = (task, abstained, why if abstained else None, warm)
                got = known.get(key)
                if got is None:
                    got = known[key] = decide(policy, task, score, abstained, why, warm, switch_cost)
                    if len(known) > 100_000:
                        known.clear()
                rows.append((*got[:2], score, *got[3:]))
                warm = got[0]
            if rows:
                kinds = [pa.string(), pa.string(), pa.float64(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([b.column("prompt_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["prompt_id", *_NAMES])

    return _in_order(classified, "trace_id", "sequence_index", "prompt_id").mapInArrow(run, "prompt_id string, " + DECISION)


def warm_scan(rows: DataFrame, steps: list[tuple[str, frozenset[str]]], trace: str = "trace_id", order: str = "sequence_index", keep: str = "prompt_id") -> DataFrame:
    """(trace, order, keep, model): the same fold for rows that carry the number of their step, as few
    as tasks: the model it routes to, and the warm models that are kept instead.

    One pass over sorted rows, linear in a trace of any length.
    """
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, warm = None, None
        for b in batches:
            out = []
            for t, k in zip(b.column(trace).to_pylist(), b.column("step").to_pylist(), strict=True):
                if t != at:
                    at, warm = t, None
                model, kept = steps[k]
                if warm not in kept:
                    warm = model
                out.append(warm)
            yield pa.RecordBatch.from_arrays([b.column(trace), b.column(order), b.column(keep), pa.array(out, pa.string())], names=[trace, order, keep, "model"])

    ordered = _in_order(rows.select(trace, order, keep, "step"), trace, order, keep)
    return ordered.mapInArrow(run, f"{trace} {types[trace]}, {order} {types[order]}, {keep} {types[keep]}, model string")


def kept_models(metrics: dict[str, Metrics], routed: str, fallback: str, budget: float) -> frozenset[str]:
    """Warm models of a task that are kept rather than the routed one loaded."""
    chosen = metrics[routed]
    floor = metrics[fallback].quality - budget
    return frozenset(m for m, x in metrics.items() if m != routed and x.quality + EPSILON >= floor and chosen.load_ms + EPSILON >= max(0.0, x.latency_ms - chosen.latency_ms))
