"""Means by task and model, best models, and the pool that no other model dominates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrixloom.functions.stats import scaled, stable_mean
from matrixloom.schema import EPSILON, MEASURES, OBJECTIVES


def aggregate_metrics(obs: DataFrame) -> DataFrame:
    """(scope, task, model, quality, latency_ms, cost_usd, load_ms, samples): means for each
    model, scope 'global', and for each task and model, scope 'task', in one pass."""
    sets = obs.groupingSets([[F.col("model")], [F.col("task"), F.col("model")]], F.col("task"), F.col("model"))
    out = sets.agg(F.grouping("task").alias("g"), *[stable_mean(F.col(c)).alias(c) for c in MEASURES], F.count(F.lit(1)).alias("samples"))
    out = out.where("g = 1 or task is not null")
    return out.select(F.when(F.col("g") == 1, "global").otherwise("task").alias("scope"), "task", "model", *MEASURES, "samples")


def task_model_means(obs: DataFrame) -> DataFrame:
    return obs.where("task is not null").groupBy("task", "model").agg(*[stable_mean(F.col(c)).alias(c) for c in MEASURES], F.count(F.lit(1)).alias("samples"))


def extremes(metrics: DataFrame) -> DataFrame:
    """(strongest, cheapest, fastest) of the global means, ties by the other measures, then name."""
    q, c, t, m = -F.col("quality"), F.col("cost_usd"), F.col("latency_ms"), F.col("model")
    best = lambda *o: F.min_by("model", F.struct(*[x.alias(f"o{i}") for i, x in enumerate(o)]))
    return metrics.where("scope = 'global'").agg(best(q, c, t, m).alias("strongest"), best(c, q, t, m).alias("cheapest"), best(t, q, c, m).alias("fastest"))


def undominated(metrics: DataFrame) -> DataFrame:
    """Rows of a scope and task that no other model there matches in all measures and beats in
    one. An anti-join with an inequality residual; metrics is tasks x models rows."""
    a, b = metrics.alias("a"), metrics.alias("b")
    same = (F.col("a.scope") == F.col("b.scope")) & F.col("a.task").eqNullSafe(F.col("b.task"))
    no_worse = (F.col("b.quality") >= F.col("a.quality")) & (F.col("b.cost_usd") <= F.col("a.cost_usd")) & (F.col("b.latency_ms") <= F.col("a.latency_ms")) & (F.col("b.load_ms") <= F.col("a.load_ms"))
    better = (F.col("b.quality") > F.col("a.quality")) | (F.col("b.cost_usd") < F.col("a.cost_usd")) | (F.col("b.latency_ms") < F.col("a.latency_ms")) | (F.col("b.load_ms") < F.col("a.load_ms"))
    return a.join(b, same & (F.col("a.model") != F.col("b.model")) & no_worse & better, "left_anti")


def pareto_pool(metrics: DataFrame) -> DataFrame:
    """Models that are undominated for some task or overall, and the strongest."""
    return undominated(metrics).select("model").union(extremes(metrics).select("strongest")).distinct()


def feasible(rows: DataFrame, group: list[str], fallback: str, budget: float, pool: list[str] | None = None) -> DataFrame:
    """Rows of the pool whose quality is within the budget of the fallback's in their group.
    Groups without the fallback have none. One shuffle by group serves this and the choice."""
    w = Window.partitionBy(*group)
    floor = F.max(F.when(F.col("model") == fallback, F.col("quality"))).over(w)
    out = rows.withColumn("__floor", floor)
    if pool is not None:
        out = out.where(F.col("model").isin(pool))
    return out.where(F.col("quality") + EPSILON >= F.col("__floor") - budget).drop("__floor")


def objective_order(objective: str, group: list[str]) -> list[Column]:
    """Sort key of an objective; 'balanced' scales cost and latency over the rows given."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {', '.join(OBJECTIVES)}")
    c, t, q, m = F.col("cost_usd"), F.col("latency_ms"), -F.col("quality"), F.col("model")
    if objective == "cost":
        return [c, t, q, m]
    if objective == "latency":
        return [t, c, q, m]
    w = Window.partitionBy(*group)
    return [0.5 * scaled(c, w) + 0.5 * scaled(t, w), q, c + t, m]


def choose(rows: DataFrame, group: list[str], fallback: str, budget: float, objective: str, pool: list[str] | None = None) -> DataFrame:
    """(group, model): the feasible model that the objective puts first."""
    ok = feasible(rows, group, fallback, budget, pool)
    keys = objective_order(objective, group)
    ok = ok.select(*group, "model", *[k.alias(f"__o{i}") for i, k in enumerate(keys)])
    order = F.struct(*[F.col(f"__o{i}") for i in range(len(keys))])
    return ok.groupBy(*group).agg(F.min_by("model", order).alias("model"))
