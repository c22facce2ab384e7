"""Routing and trial intake as streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matrixloom.operators.route import DECISION, Policy, decide

_NAMES = [x.split()[0] for x in DECISION.split(", ")]


def route_stream(classified: DataFrame, policy: Policy, idle_ms: int = 3_600_000, switch_cost: float = 0.0) -> DataFrame:
    """Decisions for a stream of classified prompts (trace_id, sequence_index, prompt_id, task,
    evidence_score, abstained, reason). The state of a trace is its warm model alone; a trace
    that stays idle loses it. Within a micro-batch rows go by sequence_index."""

    def run(key: tuple, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        warm = state.get[0] if state.exists else None
        pdf = pd.concat(list(frames)).sort_values("sequence_index", ignore_index=True)
        rows = []
        for t, s, a, r in zip(pdf["task"], pdf["evidence_score"], pdf["abstained"], pdf["reason"], strict=True):
            rows.append(decide(policy, t, s, a, r, warm, switch_cost))
            warm = rows[-1][0]
        state.update((warm,))
        state.setTimeoutDuration(idle_ms)
        yield pd.concat([pdf[["trace_id", "prompt_id"]], pd.DataFrame(rows, columns=_NAMES)], axis=1)

    return classified.groupBy("trace_id").applyInPandasWithState(run, "trace_id string, prompt_id string, " + DECISION, "warm string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def trace_gaps(prompts: DataFrame) -> DataFrame:
    """Running (n, first, last, contiguous) of each trace of a stream, in update mode."""
    by = prompts.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.min("sequence_index").alias("first"), F.max("sequence_index").alias("last"))
    return by.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n"))


def latest_trials(trials: DataFrame) -> DataFrame:
    """The last successful trial of each task and model of a stream, in update mode."""
    ok = trials.where("error is null and task_id is not null and model is not null")
    rest = [c for c in trials.columns if c not in ("task_id", "model")]
    return ok.groupBy("task_id", "model").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select("task_id", "model", "r.*")


def windowed_quality(observations: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mean quality and latency by window and model of a stream with a ts column."""
    by = observations.withWatermark("ts", lateness).groupBy(F.window("ts", width), "model")
    return by.agg(F.avg("quality").alias("quality"), F.avg("latency_ms").alias("latency_ms"), F.count(F.lit(1)).alias("n"))
