"""A synthetic matrix in closed form: 8 tasks x N prompts x 3 models, in N complete traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions.stats import stable_mean
from matrixloom.schema import EPSILON, OBJECTIVES

MODELS = ("local-small", "local-medium", "strong-reference")
_MODEL = [("local-small", 180.0, 0.0, 95.0), ("local-medium", 470.0, 0.0003, 410.0), ("strong-reference", 920.0, 0.0048, 0.0)]
#: task: its wording and the quality of each model
_TASK = {
    "classification": ("Decide whether made-up review %d is positive, neutral or negative.", (0.938, 0.951, 0.957)),
    "coding": ("Repair the function of exercise %d and name the mistake.", (0.802, 0.916, 0.964)),
    "extraction": ("Find the invoice number and the due date in record %d.", (0.940, 0.948, 0.955)),
    "multimodal": ("Say what the chart of visual item %d shows.", (0.510, 0.867, 0.949)),
    "reasoning": ("Work out timetable puzzle %d, with the constraints.", (0.768, 0.891, 0.971)),
    "summarization": ("Put support ticket %d into three short points.", (0.910, 0.942, 0.955)),
    "tool_use": ("List the calls that check invented order %d and refund it.", (0.824, 0.921, 0.956)),
    "translation": ("Put example sentence %d from German into English.", (0.858, 0.932, 0.963)),
}
MANIFEST = {"synthetic": True, "illustrative": True, "empirical_evidence": False, "notice": "Designed values, not measurements of any model."}


def demo_observations(spark: SparkSession, prompts_per_task: int = 15) -> DataFrame:
    if prompts_per_task < 3:
        raise ValueError("at least three prompts a task are needed for a split")
    tasks = spark.createDataFrame([(i, t, text, list(q)) for i, (t, (text, q)) in enumerate(sorted(_TASK.items()))], "ti int, task string, wording string, q array<double>")
    models = spark.createDataFrame([(i, *m) for i, m in enumerate(_MODEL)], "mi int, model string, lat double, cost double, load double")
    n = spark.range(1, prompts_per_task + 1).select(F.col("id").cast("int").alias("n"))
    rows = n.crossJoin(F.broadcast(tasks)).crossJoin(F.broadcast(models))  # 8 and 3 rows
    drift = ((F.col("n") + F.col("ti")) % 5 - 2) * F.lit(0.0015)
    ident = F.lpad(F.col("n").cast("string"), 3, "0")
    return rows.select(
        F.concat_ws("-", F.lit("demo"), "task", ident).alias("prompt_id"), F.expr("format_string(wording, n)").alias("prompt"), "task", F.concat(F.lit("demo-trace-"), ident).alias("trace_id"), F.col("ti").cast("bigint").alias("sequence_index"), "model",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("q")[F.col("mi")] + drift)), 6).alias("quality"), F.round(F.col("lat") + (F.col("n") % 7) * 8.0 + F.col("ti") * 3.0 + F.col("mi"), 3).alias("latency_ms"),
        F.round(F.col("cost") * (1.0 + (F.col("n") % 4) * 0.04), 8).alias("cost_usd"), F.col("load").alias("load_ms"), F.lit('{"data_origin":"synthetic","evidence_status":"illustrative_non_evidence"}').alias("metadata"),
    )


def preview_decisions(obs: DataFrame, max_quality_loss: float = 0.02, objective: str = "balanced") -> DataFrame:
    """(task, selected_model, quality, quality_loss, latency_ms, cost_usd, eligible): a simple
    choice per task against the best mean, for explanation rather than audit."""
    if objective not in OBJECTIVES or not 0 <= max_quality_loss <= 1:
        raise ValueError("unknown objective, or a quality loss outside 0 to 1")
    means = obs.groupBy("task", "model").agg(*[stable_mean(F.col(c)).alias(c) for c in ("quality", "latency_ms", "cost_usd")])
    best = means.groupBy("task").agg(F.max("quality").alias("best"))
    ok = means.join(best, "task").where(F.col("best") - F.col("quality") <= max_quality_loss + EPSILON)
    value = {"cost": F.col("cost_usd"), "latency": F.col("latency_ms"), "balanced": F.col("cost_usd") / 0.0048 + F.col("latency_ms") / 920.0}[objective]
    pick = F.min_by(F.struct("model", "quality", (F.col("best") - F.col("quality")).alias("quality_loss"), "latency_ms", "cost_usd"), F.struct(value.alias("v"), "model"))
    out = ok.groupBy("task").agg(pick.alias("r"), F.array_sort(F.collect_set("model")).alias("eligible"))
    return out.select("task", F.col("r.model").alias("selected_model"), "r.quality", "r.quality_loss", "r.latency_ms", "r.cost_usd", "eligible")
