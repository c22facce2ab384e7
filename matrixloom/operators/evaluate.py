"""Evaluation of strategies, all at once, as one long table of assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrixloom.functions.stats import bootstrap_mersenne, stable_mean

DRAWS = (("quality", 0), ("quality_loss", 1), ("cost_usd", 2), ("latency", 3))


_MEASURED = ("quality", "latency_ms", "cost_usd", "load_ms")


def prompt_results(obs: DataFrame, reference: str) -> DataFrame:
    """One row for each prompt: its head, the results of all its models as a map, and the quality of
    the reference and of the best model."""
    rows = obs.groupBy("prompt_id").agg(
        *[F.any_value(c).alias(c) for c in ("task", "trace_id", "sequence_index") if c in obs.columns],
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(*_MEASURED)))).alias("results"),
    )
    best = F.array_max(F.transform(F.map_values("results"), lambda x: x["quality"]))
    return rows.withColumn("q_ref", F.try_element_at("results", F.lit(reference))["quality"]).withColumn("q_best", best)


def _charged(rows: DataFrame, traced: bool) -> DataFrame:
    """Picks with their result as r: what they cost, lose and regret, and the load of a model that
    was not resident."""
    r = F.col("r")
    if traced:
        prev = F.lag("model").over(Window.partitionBy("baseline", "trace_id").orderBy("sequence_index"))
        rows = rows.withColumn("prev", prev)
        charge = F.when(F.col("prev").isNull() | (F.col("prev") != F.col("model")), r["load_ms"]).otherwise(0.0)
        switched = (F.col("prev").isNotNull() & (F.col("prev") != F.col("model"))).cast("int")
    else:
        charge, switched = F.lit(0.0), F.lit(None).cast("int")
    return rows.select("baseline", "prompt_id", "model", "trace_id", "sequence_index", "covered", r["quality"].alias("quality"), (F.col("q_ref") - r["quality"]).alias("quality_loss"), r["cost_usd"].alias("cost_usd"), (r["latency_ms"] + charge).alias("latency"), (F.col("q_best") - r["quality"]).alias("regret"), switched.alias("switched"))


def chosen_picks(prompts: DataFrame, picks: dict[str, Column], traced: bool) -> DataFrame:
    """chosen_rows() for strategies that are expressions over prompt_results() with what was joined to
    it: no join, as every pick is looked up in the map of its prompt."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), v.alias("model")) for k, v in picks.items()]))
    rows = prompts.select("prompt_id", "trace_id", "sequence_index", "q_ref", "q_best", "results", each.alias("x"))
    r = F.try_element_at("results", F.col("x.model"))
    rows = rows.select("x.baseline", "prompt_id", "x.model", "trace_id", "sequence_index", F.lit(True).alias("covered"), "q_ref", "q_best", r.alias("r"))
    return _charged(rows.where("r is not null"), traced)


def chosen_rows(assignments: DataFrame, obs: DataFrame, reference: str, traced: bool) -> DataFrame:
    """Each assignment (baseline, prompt_id, model, covered) with its row of the matrix: quality,
    loss against the reference, cost, latency with the load of a model that was not resident, regret
    against the best of the prompt, and whether it switched.

    The matrix is shuffled once, by prompt, and meets the assignments by prompt.
    """
    rows = assignments.join(prompt_results(obs, reference), "prompt_id")
    r = F.try_element_at("results", F.col("model"))
    rows = rows.select("baseline", "prompt_id", "model", "trace_id", "sequence_index", "covered", "q_ref", "q_best", r.alias("r"))
    return _charged(rows.where("r is not null"), traced)


def compare(chosen: DataFrame) -> DataFrame:
    """One row for each baseline with its means, percentiles, coverage, regret and switches."""
    return chosen.groupBy("baseline").agg(
        stable_mean(F.col("quality")).alias("quality"),
        stable_mean(F.col("quality_loss")).alias("quality_loss"),
        stable_mean(F.col("cost_usd")).alias("cost_usd"),
        stable_mean(F.col("latency")).alias("latency_ms"),
        F.percentile("latency", 0.5).alias("latency_p50_ms"),
        F.percentile("latency", 0.95).alias("latency_p95_ms"),
        F.avg(F.col("covered").cast("double")).alias("coverage"),
        stable_mean(F.col("regret")).alias("routing_regret"),
        F.sum("switched").alias("switch_count"),
        F.count(F.lit(1)).alias("n_prompts"),
    )


def model_counts(chosen: DataFrame) -> DataFrame:
    """(baseline, model_counts): how often each model is chosen, as a map in order of names."""
    by = chosen.groupBy("baseline", "model").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("baseline").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", "n")))).alias("model_counts"))


def equivalent(assignments: DataFrame, leave_out: tuple[str, ...] = ("oracle",)) -> DataFrame:
    """(members): groups of baselines that choose alike for every prompt."""
    a = assignments.where(~F.col("baseline").isin(list(leave_out)))
    # the order of rows doesn't matter to a sum of hashes; two of them make 128 bits
    sign = a.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(s), "prompt_id", "model").cast("decimal(38,0)")).alias(f"h{s}") for s in (1, 2)])
    return sign.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("baseline")).alias("members")).where(F.size("members") > 1).select("members")


def intervals(chosen: DataFrame, traced: bool, seed: int, index: dict[str, int], resamples: int = 1000) -> DataFrame:
    """(baseline, measure, low, high, confidence): Mersenne bootstrap, by whole traces if traced.
    Each baseline and measure has its own seed, so one grouped pass serves all."""
    at = F.create_map(*[x for k, v in index.items() for x in (F.lit(k), F.lit(v))])[F.col("baseline")]
    order = ["trace_id", "sequence_index"] if traced else ["prompt_id"]
    return bootstrap_mersenne(chosen, ["baseline"], order, dict(DRAWS), F.lit(seed) + at * 10, "trace_id" if traced else None, resamples)
