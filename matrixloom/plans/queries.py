"""Registered queries, one for each family of operators, each with a statement in SQL that works
out the same result independently.

The matrix is derived from events in integer arithmetic: every event is a prompt, its type the
task, its user the trace, and three models have results for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrixloom.functions import hashing, stats, text
from matrixloom.functions.sizes import shares
from matrixloom.operators import classify as cl
from matrixloom.operators import evaluate, fingerprint, metrics, route, split, trials, validate
from matrixloom.plans.audit import audit
from matrixloom.sources.demo import demo_observations, preview_decisions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix over events. One shuffle, by user, numbers the prompts of a trace, into parts whose
    number grows with the table: rows are three times as many after it, and what aggregates them next
    would otherwise hold a share of them all in each task."""
    e = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    e = e.repartition(shares(e), "user_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint") - 1
    each = e.select("event_id", "event_type", "user_id", seq.alias("seq"))
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    rows = each.select("*", k)
    return rows.select(
        F.col("event_id").cast("string").alias("prompt_id"),
        F.lit(None).cast("string").alias("prompt"),
        F.col("event_type").alias("task"),
        F.col("user_id").cast("string").alias("trace_id"),
        F.col("seq").alias("sequence_index"),
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"),
        (((F.col("event_id") * 7 + F.col("k") * 13) % 101).cast("double") / F.lit(100.0)).alias("quality"),
        (F.lit(50) + (F.col("event_id") % 7) * 8 + F.col("k") * 200).cast("double").alias("latency_ms"),
        (F.col("k").cast("double") * F.lit(0.002)).alias("cost_usd"),
        (F.lit(100) + F.col("k") * 150).cast("double").alias("load_ms"),
        F.lit(None).cast("string").alias("metadata"),
    )


OBS = """WITH RECURSIVE obs AS (
  SELECT CAST(event_id AS VARCHAR) AS prompt_id, event_id, event_type AS task, CAST(user_id AS VARCHAR) AS trace_id,
         row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) - 1 AS sequence_index, 'm' || k AS model,
         CAST((event_id * 7 + k * 13) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS quality,
         CAST(50 + (event_id % 7) * 8 + k * 200 AS DOUBLE) AS latency_ms, CAST(k AS DOUBLE) * CAST(0.002 AS DOUBLE) AS cost_usd,
         CAST(100 + k * 150 AS DOUBLE) AS load_ms
  FROM events CROSS JOIN (VALUES (0), (1), (2)) AS m(k)
)"""
_MEANS = ", ".join(f"CAST(avg(CAST({c} AS DECIMAL(38,18))) AS DOUBLE) AS {c}" for c in ("quality", "latency_ms", "cost_usd", "load_ms"))
GLOBAL = f""", g AS (SELECT model, {_MEANS}, count(*) AS samples FROM obs GROUP BY model),
t AS (SELECT task, model, {_MEANS}, count(*) AS samples FROM obs WHERE task IS NOT NULL GROUP BY task, model),
best AS (SELECT (SELECT model FROM g ORDER BY quality DESC, cost_usd, latency_ms, model LIMIT 1) AS strongest,
                (SELECT model FROM g ORDER BY cost_usd, quality DESC, latency_ms, model LIMIT 1) AS cheapest,
                (SELECT model FROM g ORDER BY latency_ms, quality DESC, cost_usd, model LIMIT 1) AS fastest)"""


def _scaled(c: str, over: str) -> str:
    lo, hi = f"min({c}) OVER ({over})", f"max({c}) OVER ({over})"
    return f"CASE WHEN abs({lo} - {hi}) <= 1e-9 * greatest(abs({lo}), abs({hi})) THEN 0 ELSE ({c} - {lo}) / ({hi} - {lo}) END"


def _routes_sql(name: str, source: str, group: str, objective: str, budget: str = "0.02") -> str:
    part = f"PARTITION BY {group}"
    order = {"cost": "cost_usd, latency_ms, quality DESC, model", "latency": "latency_ms, cost_usd, quality DESC, model", "balanced": "bal, quality DESC, cost_usd + latency_ms, model"}[objective]
    return f""", {name}_f AS (
  SELECT x.* FROM {source} x JOIN {source} f ON x.{group} = f.{group} AND f.model = (SELECT strongest FROM best)
  WHERE x.quality + 1e-12 >= f.quality - CAST({budget} AS DOUBLE)
), {name}_b AS (SELECT *, 0.5 * ({_scaled("cost_usd", part)}) + 0.5 * ({_scaled("latency_ms", part)}) AS bal FROM {name}_f
), {name} AS (SELECT {group}, model FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM {name}_b) WHERE rn = 1)"""


_COLS = ["prompt_id", "task", "trace_id", "sequence_index", "model", "quality", "latency_ms", "cost_usd", "load_ms"]


@query(OBS + f" SELECT {', '.join(_COLS)} FROM obs")
def obs_matrix(spark, sf_dir):
    return observations(spark, sf_dir).select(*_COLS)


# --- validation: the matrix with planted faults ------------------------------------------------


def _id() -> F.Column:
    return F.col("prompt_id").cast("bigint")


@query(OBS + ", d AS (SELECT prompt_id, model FROM obs UNION ALL SELECT prompt_id, model FROM obs WHERE event_id % 500 = 0) SELECT prompt_id, model, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1")
def val_duplicates(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return validate.duplicates(obs.unionByName(obs.where(_id() % 500 == 0)))


@query(OBS + ", d AS (SELECT * FROM obs WHERE NOT (event_id % 97 = 0 AND model = 'm1')) SELECT prompt_id, model FROM (SELECT DISTINCT prompt_id FROM d) CROSS JOIN (SELECT DISTINCT model FROM d) EXCEPT SELECT prompt_id, model FROM d")
def val_incomplete_matrix(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return validate.missing_pairs(obs.where(~((_id() % 97 == 0) & (F.col("model") == "m1"))))


@query(OBS + ", d AS (SELECT prompt_id, CASE WHEN event_id % 211 = 0 AND model = 'm2' THEN NULL ELSE task END AS task, trace_id, sequence_index FROM obs) SELECT prompt_id, count(DISTINCT coalesce(task, '<none>') || '|' || trace_id || '|' || sequence_index) AS n_versions FROM d GROUP BY prompt_id HAVING n_versions > 1")
def val_inconsistent(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return validate.inconsistent_prompts(obs.withColumn("task", F.when(~((_id() % 211 == 0) & (F.col("model") == "m2")), F.col("task"))))


@query(OBS + """, d AS (SELECT prompt_id, model, CASE WHEN event_id % 301 = 0 THEN quality + 1.5 ELSE quality END AS quality, CASE WHEN event_id % 401 = 0 THEN -1 ELSE latency_ms END AS latency_ms, CASE WHEN event_id % 503 = 0 THEN CAST('inf' AS DOUBLE) ELSE cost_usd END AS cost_usd, CASE WHEN event_id % 701 = 0 THEN CAST('nan' AS DOUBLE) ELSE load_ms END AS load_ms FROM obs)
SELECT 'range' AS code, prompt_id, model, 'quality' AS detail FROM d WHERE quality > 1 UNION ALL SELECT 'range', prompt_id, model, 'latency_ms' FROM d WHERE latency_ms < 0
UNION ALL SELECT 'range', prompt_id, model, 'cost_usd' FROM d WHERE isinf(cost_usd) UNION ALL SELECT 'range', prompt_id, model, 'load_ms' FROM d WHERE isnan(load_ms)""")
def val_range(spark, sf_dir):
    obs = observations(spark, sf_dir)
    for c, n, bad in (("quality", 301, F.col("quality") + 1.5), ("latency_ms", 401, F.lit(-1.0)), ("cost_usd", 503, F.lit(float("inf"))), ("load_ms", 701, F.lit(float("nan")))):
        obs = obs.withColumn(c, F.when(_id() % n == 0, bad).otherwise(F.col(c)))
    return validate.out_of_range(obs)


@query(OBS + ", d AS (SELECT prompt_id, trace_id, CASE WHEN event_id % 53 = 0 THEN 0 ELSE sequence_index END AS sequence_index FROM obs) SELECT trace_id, sequence_index, count(DISTINCT prompt_id) AS n_prompts FROM d GROUP BY ALL HAVING n_prompts > 1")
def val_shared_place(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return validate.shared_places(obs.withColumn("sequence_index", F.when(_id() % 53 == 0, F.lit(0)).otherwise(F.col("sequence_index"))))


@query(OBS + ", d AS (SELECT DISTINCT prompt_id, trace_id, sequence_index FROM obs WHERE event_id % 89 <> 0) SELECT trace_id, count(*) AS n_prompts, min(sequence_index) AS first_index, max(sequence_index) AS last_index, max(sequence_index) - min(sequence_index) + 1 = count(*) AS contiguous FROM d GROUP BY trace_id")
def trace_completeness(spark, sf_dir):
    return validate.trace_completeness(observations(spark, sf_dir).where(_id() % 89 != 0))


@query(OBS + """, d AS (SELECT DISTINCT prompt_id, CASE WHEN event_id % 10 <> 0 THEN trace_id END AS trace_id, sequence_index FROM obs),
c AS (SELECT max(sequence_index) - min(sequence_index) + 1 = count(*) AS ok FROM d WHERE trace_id IS NOT NULL GROUP BY trace_id)
SELECT count(*) AS n_prompts, count(trace_id) AS n_traced, count(trace_id) / CAST(count(*) AS DOUBLE) AS coverage, count(*) = count(trace_id) AND (SELECT bool_and(ok) FROM c) AS trace_complete FROM d""")
def trace_coverage(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return validate.trace_coverage(obs.withColumn("trace_id", F.when(_id() % 10 != 0, F.col("trace_id"))))


@query("SELECT CAST(conv_id AS VARCHAR) AS trace_id, count(*) AS n_prompts, min(turn) AS first_index, max(turn) AS last_index, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id")
def conversation_traces(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("prompt_id"), F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").alias("sequence_index"))
    return validate.trace_completeness(c)


@query(OBS + " SELECT DISTINCT prompt_id, task, trace_id, sequence_index FROM obs")
def prompt_heads(spark, sf_dir):
    return validate.heads(observations(spark, sf_dir)).drop("prompt")


@query(OBS + ", h AS (SELECT DISTINCT prompt_id, trace_id, sequence_index FROM obs) SELECT trace_id, string_agg(prompt_id, ',' ORDER BY sequence_index, prompt_id) AS prompt_ids FROM h GROUP BY trace_id")
def trace_groups(spark, sf_dir):
    return validate.trace_groups(observations(spark, sf_dir)).select("trace_id", F.array_join("prompt_ids", ",").alias("prompt_ids"))


# --- splits and hashes ---------------------------------------------------------------------------


def _unit(ident: str, seed: int = 42, ns: str = "matrixloom") -> str:
    return f"CAST(CAST('0x' || substr(sha256('{ns}:{seed}:' || {ident}), 1, 16) AS UBIGINT) AS DOUBLE) / CAST(18446744073709551616 AS DOUBLE)"


def _part(u: str) -> str:
    return f"CASE WHEN {u} < CAST(0.6 AS DOUBLE) THEN 'train' WHEN {u} < CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'dev' ELSE 'test' END"


#: Parts of whole traces, with the moves that fill parts left too small: one after the other, from
#: the largest part above its minimum, ties to the last name, the unit of lowest hash first.
PARTS = f""", tr AS (SELECT trace_id, part, row_number() OVER (PARTITION BY part ORDER BY u, trace_id) AS rn FROM (SELECT DISTINCT trace_id, {_unit('trace_id')} AS u, {_part(_unit('trace_id'))} AS part FROM obs)),
lim AS (SELECT CASE WHEN count(*) >= 5 THEN 3 ELSE 1 END AS m, count(*) >= 3 AS enough FROM tr),
mv AS (
  SELECT count(*) FILTER (part = 'train') AS nt, count(*) FILTER (part = 'dev') AS nd, count(*) FILTER (part = 'test') AS ne, 0 AS kt, 0 AS kd, 0 AS ke, '' AS donor, '' AS target FROM tr
  UNION ALL
  SELECT nt + CAST(t = 'train' AS INTEGER) - CAST(d = 'train' AS INTEGER), nd + CAST(t = 'dev' AS INTEGER) - CAST(d = 'dev' AS INTEGER), ne + CAST(t = 'test' AS INTEGER) - CAST(d = 'test' AS INTEGER),
         kt + CAST(d = 'train' AS INTEGER), kd + CAST(d = 'dev' AS INTEGER), ke + CAST(d = 'test' AS INTEGER), d, t
  FROM (SELECT mv.*, CASE WHEN nt < 1 THEN 'train' WHEN nd < 1 THEN 'dev' WHEN ne < m THEN 'test' END AS t,
               CASE WHEN nt > 1 AND nt >= CASE WHEN ne > m THEN ne ELSE 0 END AND nt >= nd THEN 'train' WHEN ne > m AND ne >= nd THEN 'test' ELSE 'dev' END AS d FROM mv, lim WHERE enough) WHERE t IS NOT NULL
), parts AS (
  SELECT tr.trace_id, coalesce(mv.target, tr.part) AS part FROM tr LEFT JOIN mv ON mv.donor = tr.part AND tr.rn = CASE mv.donor WHEN 'train' THEN kt WHEN 'dev' THEN kd WHEN 'test' THEN ke END
)"""


@query(f"SELECT doc_id, round({_unit('CAST(doc_id AS VARCHAR)')}, 12) AS u, {_part(_unit('CAST(doc_id AS VARCHAR)'))} AS part FROM documents")
def hash_split(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id")
    ident = F.col("doc_id").cast("string")
    return d.select("doc_id", F.round(hashing.unit_hash(ident, 42), 12).alias("u"), hashing.stable_split(ident, 42).alias("part"))


@query(OBS + PARTS + " SELECT trace_id, part FROM parts")
def hash_split_by_trace(spark, sf_dir):
    units = observations(spark, sf_dir).select(F.col("trace_id").alias("unit")).distinct()
    return split.assign_parts(units, 42, True).withColumnRenamed("unit", "trace_id")


@query(OBS + " SELECT DISTINCT prompt_id, 'm' || (CAST('0x' || substr(sha256('matrixloom-random:42:' || prompt_id), 1, 16) AS UBIGINT) % 3) AS model FROM obs")
def hash_choice_random(spark, sf_dir):
    h = validate.heads(observations(spark, sf_dir))
    return h.select("prompt_id", hashing.hash_choice(F.col("prompt_id"), ["m0", "m1", "m2"], 42).alias("model"))


@query(OBS + PARTS + """, u AS (SELECT DISTINCT prompt_id, part FROM obs JOIN parts USING (trace_id))
SELECT 'prompt' AS unit, part, count(*) AS n, 'sha256:' || sha256(unhex(hex('matrixloom:split:v2:prompt:42:' || CASE part WHEN 'dev' THEN 'development' ELSE part END) || '00' || string_agg(lpad(hex(strlen(prompt_id)), 16, '0') || hex(prompt_id), '' ORDER BY prompt_id))) AS digest FROM u GROUP BY part
UNION ALL SELECT 'trace', part, count(*), 'sha256:' || sha256(unhex(hex('matrixloom:split:v2:trace:42:' || CASE part WHEN 'dev' THEN 'development' ELSE part END) || '00' || string_agg(lpad(hex(strlen(trace_id)), 16, '0') || hex(trace_id), '' ORDER BY trace_id)))
FROM parts GROUP BY part""")
def assignment_digest(spark, sf_dir):
    out = split.assignment_digests(split.split_observations(observations(spark, sf_dir), 42, True))
    return out.withColumn("n", F.col("n").cast("bigint"))


@query(OBS + """, h AS (SELECT DISTINCT prompt_id, task, trace_id, sequence_index FROM obs)
SELECT 'sha256:' || sha256('{"models":["m0","m1","m2"],"prompts":[' || string_agg('{"prompt_id":"' || prompt_id || '","prompt_identity_sha256":"' || sha256('prompt_id:' || prompt_id) || '","sequence_index":' || sequence_index || ',"task":"' || task || '","trace_id":"' || trace_id || '"}', ',' ORDER BY prompt_id) || '],"schema_version":"matrixloom.observation.v1"}') AS fingerprint FROM h""")
def workload_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint(observations(spark, sf_dir))


# --- aggregates, pools and choices ------------------------------------------------------------------


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in cols})


_R = "round(quality, 9) AS quality, round(latency_ms, 9) AS latency_ms, round(cost_usd, 9) AS cost_usd, round(load_ms, 9) AS load_ms"
_M = ("quality", "latency_ms", "cost_usd", "load_ms")


@query(OBS + GLOBAL + f" SELECT task, model, {_R}, samples FROM t")
def agg_task_model(spark, sf_dir):
    return _rounded(metrics.task_model_means(observations(spark, sf_dir)), *_M)


@query(OBS + GLOBAL + f" SELECT 'task' AS scope, task, model, {_R}, samples FROM t UNION ALL SELECT 'global', NULL, model, {_R}, samples FROM g")
def agg_grouping_sets(spark, sf_dir):
    return _rounded(metrics.aggregate_metrics(observations(spark, sf_dir)), *_M)


@query(OBS + GLOBAL + " SELECT strongest FROM best")
def strongest_model(spark, sf_dir):
    return metrics.extremes(metrics.aggregate_metrics(observations(spark, sf_dir))).select("strongest")


@query(OBS + GLOBAL + " SELECT cheapest, fastest FROM best")
def cheapest_fastest(spark, sf_dir):
    return metrics.extremes(metrics.aggregate_metrics(observations(spark, sf_dir))).select("cheapest", "fastest")


@query(OBS + GLOBAL + """, a AS (SELECT '' AS task, model, quality, latency_ms, cost_usd, load_ms FROM g UNION ALL SELECT 't' || task, model, quality, latency_ms, cost_usd, load_ms FROM t)
SELECT DISTINCT model FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.task = a.task AND b.model <> a.model AND b.quality >= a.quality AND b.cost_usd <= a.cost_usd AND b.latency_ms <= a.latency_ms AND b.load_ms <= a.load_ms
  AND (b.quality > a.quality OR b.cost_usd < a.cost_usd OR b.latency_ms < a.latency_ms OR b.load_ms < a.load_ms)) UNION SELECT strongest FROM best""")
def pareto_pool(spark, sf_dir):
    return metrics.pareto_pool(metrics.aggregate_metrics(observations(spark, sf_dir)))


def _means(obs: DataFrame) -> tuple[DataFrame, Row]:
    """Means over the whole matrix, gathered once (tasks x models rows), and the extreme models."""
    found = metrics.aggregate_metrics(obs)
    means = obs.sparkSession.createDataFrame(found.collect(), found.schema)
    return means, metrics.extremes(means).first()


def _strongest(obs: DataFrame) -> str:
    return _means(obs)[1].strongest


def _rules(means: DataFrame, best: str, budget: float, objective: str = "cost") -> dict[str, str]:
    return {r.task: r.model for r in metrics.choose(means.where("scope = 'task'"), ["task"], best, budget, objective).collect()}


def _of_task(rules: dict[str, str], default: str | None = None) -> F.Column:
    """The model of a row's task; as many branches as there are tasks."""
    known = F.create_map(*[F.lit(x) for kv in sorted(rules.items()) for x in kv])
    return F.coalesce(F.try_element_at(known, F.col("task")), F.lit(default))


def _routes(spark: SparkSession, sf_dir: str, objective: str) -> DataFrame:
    means, e = _means(observations(spark, sf_dir))
    return metrics.choose(means.where("scope = 'task'").drop("scope"), ["task"], e.strongest, 0.02, objective)


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "cost") + " SELECT task, model FROM r")
def feasible_routes_cost(spark, sf_dir):
    return _routes(spark, sf_dir, "cost")


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "latency") + " SELECT task, model FROM r")
def feasible_routes_latency(spark, sf_dir):
    return _routes(spark, sf_dir, "latency")


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "balanced") + " SELECT task, model FROM r")
def feasible_routes_balanced(spark, sf_dir):
    return _routes(spark, sf_dir, "balanced")


@query(OBS + GLOBAL + _routes_sql("r", "obs", "prompt_id", "balanced") + " SELECT prompt_id, model FROM r")
def oracle_assign(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return metrics.choose(obs, ["prompt_id"], _strongest(obs), 0.02, "balanced")


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "cost") + " SELECT DISTINCT o.prompt_id, coalesce(r.model, (SELECT strongest FROM best)) AS model FROM obs o LEFT JOIN r ON o.task = r.task")
def task_only_assign(spark, sf_dir):
    obs = observations(spark, sf_dir)
    means, e = _means(obs)
    return validate.heads(obs).select("prompt_id", _of_task(_rules(means, e.strongest, 0.02), e.strongest).alias("model"))


# --- strategies ---------------------------------------------------------------------------------


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six strategies choose over the whole matrix, which is read twice: for the means, and
    with one shuffle by prompt for the choices."""
    obs = observations(spark, sf_dir)
    means, e = _means(obs)
    fixed = {"always-strongest": e.strongest, "always-cheapest": e.cheapest, "always-fastest": e.fastest, "warm-only": e.strongest}
    picks = {k: F.lit(v) for k, v in fixed.items()} | {"random": hashing.hash_choice(F.col("prompt_id"), ["m0", "m1", "m2"], 42), "task-only": _of_task(_rules(means, e.strongest, 0.02), e.strongest)}
    return evaluate.chosen_picks(evaluate.prompt_results(obs, e.strongest), picks, True)


ASG = (
    OBS
    + GLOBAL
    + _routes_sql("r", "t", "task", "cost")
    + """, h AS (SELECT DISTINCT prompt_id, task FROM obs), asg AS (
  SELECT 'always-strongest' AS baseline, prompt_id, strongest AS model FROM h, best UNION ALL SELECT 'warm-only', prompt_id, strongest FROM h, best
  UNION ALL SELECT 'always-cheapest', prompt_id, cheapest FROM h, best UNION ALL SELECT 'always-fastest', prompt_id, fastest FROM h, best
  UNION ALL SELECT 'random', prompt_id, 'm' || (CAST('0x' || substr(sha256('matrixloom-random:42:' || prompt_id), 1, 16) AS UBIGINT) % 3) FROM h
  UNION ALL SELECT 'task-only', h.prompt_id, coalesce(r.model, strongest) FROM h CROSS JOIN best LEFT JOIN r ON h.task = r.task
), c0 AS (
  SELECT a.baseline, o.*, f.quality - o.quality AS quality_loss, m.q - o.quality AS regret, lag(o.model) OVER (PARTITION BY a.baseline, o.trace_id ORDER BY o.sequence_index) AS prev
  FROM asg a JOIN obs o ON a.prompt_id = o.prompt_id AND a.model = o.model JOIN obs f ON f.prompt_id = o.prompt_id AND f.model = (SELECT strongest FROM best)
  JOIN (SELECT prompt_id, max(quality) AS q FROM obs GROUP BY prompt_id) m ON m.prompt_id = o.prompt_id
), c AS (SELECT *, latency_ms + CASE WHEN prev IS NULL OR prev <> model THEN load_ms ELSE 0 END AS latency, CASE WHEN prev IS NOT NULL AND prev <> model THEN 1 ELSE 0 END AS switched FROM c0)"""
)


@query(ASG + " SELECT baseline, prompt_id, round(quality_loss, 9) AS quality_loss FROM c")
def quality_loss_join(spark, sf_dir):
    c = _chosen(spark, sf_dir)
    return c.select("baseline", "prompt_id", F.round("quality_loss", 9).alias("quality_loss"))


@query(ASG + " SELECT baseline, round(avg(regret), 9) AS routing_regret FROM c GROUP BY baseline")
def regret(spark, sf_dir):
    c = evaluate.compare(_chosen(spark, sf_dir))
    return _rounded(c.select("baseline", "routing_regret"), "routing_regret")


@query(ASG + ", n AS (SELECT baseline, model, count(*) AS n FROM c GROUP BY ALL) SELECT baseline, string_agg(model || '=' || n, ',' ORDER BY model) AS model_counts FROM n GROUP BY baseline")
def model_counts(spark, sf_dir):
    c = evaluate.model_counts(_chosen(spark, sf_dir))
    return c.select("baseline", F.array_join(F.transform(F.map_entries("model_counts"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("model_counts"))


@query(ASG + " SELECT baseline, prompt_id, model, latency, switched FROM c")
def switch_load_penalty(spark, sf_dir):
    return _chosen(spark, sf_dir).select("baseline", "prompt_id", "model", "latency", "switched")


@query(OBS + " SELECT model, " + ", ".join(f"round(quantile_cont(latency_ms, {p}), 9) AS p{int(p * 100)}" for p in (0.05, 0.5, 0.95)) + " FROM obs GROUP BY model")
def latency_percentiles(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("model").agg(*[F.round(stats.percentile(F.col("latency_ms"), p), 9).alias(f"p{int(p * 100)}") for p in (0.05, 0.5, 0.95)])


_CMP = ("quality", "quality_loss", "cost_usd", "latency_ms", "latency_p50_ms", "latency_p95_ms", "routing_regret")


@query(ASG + """ SELECT baseline, round(avg(quality), 9) AS quality, round(avg(quality_loss), 9) AS quality_loss, round(avg(cost_usd), 9) AS cost_usd, round(avg(latency), 9) AS latency_ms, round(quantile_cont(latency, 0.5), 9) AS latency_p50_ms,
 round(quantile_cont(latency, 0.95), 9) AS latency_p95_ms, CAST(1 AS DOUBLE) AS coverage, round(avg(regret), 9) AS routing_regret, CAST(sum(switched) AS BIGINT) AS switch_count, count(*) AS n_prompts FROM c GROUP BY baseline""")
def baseline_compare(spark, sf_dir):
    return _rounded(evaluate.compare(_chosen(spark, sf_dir)), *_CMP)


@query(ASG + ", s AS (SELECT baseline, string_agg(prompt_id || '>' || model, ',' ORDER BY prompt_id) AS sig FROM asg GROUP BY baseline) SELECT string_agg(baseline, ',' ORDER BY baseline) AS members FROM s GROUP BY sig HAVING count(*) > 1")
def equivalent_baselines(spark, sf_dir):
    return evaluate.equivalent(_chosen(spark, sf_dir)).select(F.array_join("members", ",").alias("members"))


def _abstains(ident: F.Column) -> F.Column:
    return hashing.unit_hash(ident, 7) < 0.1


def _task_metrics(means: DataFrame) -> dict[str, dict[str, route.Metrics]]:
    table: dict[str, dict[str, route.Metrics]] = {}
    for r in means.collect():
        table.setdefault(r.task if r.scope == "task" else route.GLOBAL, {})[r.model] = route.Metrics(r.quality, r.latency_ms, r.cost_usd, r.load_ms, r.samples)
    return table


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "cost", "0.05") + f""", h AS (SELECT DISTINCT prompt_id, task, trace_id, sequence_index FROM obs), p AS (
  SELECT h.*, r.model AS routed, s.latency_ms AS l_sel, s.load_ms AS load_sel, f.quality AS qf, strongest, {_unit('h.prompt_id', 7)} < CAST(0.1 AS DOUBLE) AS abstained
  FROM h JOIN r ON h.task = r.task JOIN t s ON s.task = h.task AND s.model = r.model CROSS JOIN best JOIN t f ON f.task = h.task AND f.model = strongest
), fold AS (
  SELECT prompt_id, trace_id, sequence_index, CASE WHEN abstained THEN strongest ELSE routed END AS model FROM p WHERE sequence_index = 0
  UNION ALL
  SELECT p.prompt_id, p.trace_id, p.sequence_index, CASE WHEN p.abstained THEN p.strongest
    WHEN f.model <> p.routed AND w.quality + 1e-12 >= p.qf - CAST(0.05 AS DOUBLE) AND p.load_sel + 1e-12 >= greatest(0, w.latency_ms - p.l_sel) THEN f.model ELSE p.routed END
  FROM fold f JOIN p ON p.trace_id = f.trace_id AND p.sequence_index = f.sequence_index + 1 LEFT JOIN t w ON w.task = p.task AND w.model = f.model
) SELECT trace_id, sequence_index, prompt_id, model FROM fold""")
def warm_hysteresis(spark, sf_dir):
    obs = observations(spark, sf_dir)
    means, e = _means(obs)
    table, rules = _task_metrics(means), _rules(means, e.strongest, 0.05)
    tasks = sorted(rules)
    steps = [(e.strongest, frozenset()), *((rules[t], route.kept_models(table[t], rules[t], e.strongest, 0.05)) for t in tasks)]
    number = F.create_map(*[x for i, t in enumerate(tasks, 1) for x in (F.lit(t), F.lit(i))])
    step = F.when(_abstains(F.col("prompt_id")), 0).otherwise(F.try_element_at(number, F.col("task")))
    h = validate.heads(obs).where(F.col("task").isin(tasks))
    return route.warm_scan(h.withColumn("step", step), steps)


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "cost", "0.05") + f""", h AS (SELECT DISTINCT prompt_id, task FROM obs), a AS (
  SELECT h.prompt_id, CASE WHEN {_unit('h.prompt_id', 7)} < CAST(0.1 AS DOUBLE) THEN strongest ELSE r.model END AS model, strongest FROM h JOIN r ON h.task = r.task CROSS JOIN best)
SELECT round(avg(f.quality - o.quality), 9) AS development_loss FROM a JOIN obs o ON o.prompt_id = a.prompt_id AND o.model = a.model JOIN obs f ON f.prompt_id = a.prompt_id AND f.model = a.strongest""")
def dev_loss(spark, sf_dir):
    obs = observations(spark, sf_dir)
    means, e = _means(obs)
    rules = _rules(means, e.strongest, 0.05)
    prompts = evaluate.prompt_results(obs, e.strongest).where(F.col("task").isin(list(rules)))
    pick = F.when(_abstains(F.col("prompt_id")), e.strongest).otherwise(_of_task(rules))
    return evaluate.chosen_picks(prompts, {"policy": pick}, False).agg(F.round(stats.stable_mean(F.col("quality_loss")), 9).alias("development_loss"))


@query(ASG + """, s AS (SELECT baseline, avg(latency) AS latency_ms, avg(cost_usd) AS cost_usd FROM c GROUP BY baseline)
SELECT b.baseline, b.latency_ms > o.latency_ms * (1.0 + CAST(0.05 AS DOUBLE)) + 1e-12 AS latency_regressed, b.cost_usd > o.cost_usd * (1.0 + CAST(0.05 AS DOUBLE)) + 1e-12 AS cost_regressed FROM s b CROSS JOIN (SELECT * FROM s WHERE baseline = 'always-strongest') o""")
def ci_gate(spark, sf_dir):
    s = evaluate.compare(_chosen(spark, sf_dir)).select("baseline", "latency_ms", "cost_usd")
    old = s.where("baseline = 'always-strongest'").select(F.col("latency_ms").alias("l0"), F.col("cost_usd").alias("c0"))
    over = lambda new, was: F.col(new) > F.col(was) * (1.0 + F.lit(0.05)) + 1e-12
    return s.crossJoin(old).select("baseline", over("latency_ms", "l0").alias("latency_regressed"), over("cost_usd", "c0").alias("cost_regressed"))


# --- bootstrap -----------------------------------------------------------------------------------

_DRAW = "CAST(CAST('0x' || substr(sha256('matrixloom:42:' || r.r || ':' || {i}), 1, 13) AS BIGINT) % {n} AS BIGINT)"


@query(OBS + f""", v AS (SELECT task, quality, row_number() OVER (PARTITION BY task ORDER BY prompt_id) - 1 AS i, count(*) OVER (PARTITION BY task) AS n FROM obs WHERE model = 'm2'),
d AS (SELECT v.task, r.r, {_DRAW.format(i="v.i", n="v.n")} AS j FROM v CROSS JOIN range(100) r(r)),
m AS (SELECT d.task, d.r, avg(v.quality) AS q FROM d JOIN v ON v.task = d.task AND v.i = d.j GROUP BY ALL)
SELECT task, round(quantile_cont(q, 0.025), 9) AS low, round(quantile_cont(q, 0.975), 9) AS high, CAST(0.95 AS DOUBLE) AS confidence FROM m GROUP BY task""")
def bootstrap_hash_ci(spark, sf_dir):
    rows = observations(spark, sf_dir).where("model = 'm2'")
    return _rounded(stats.bootstrap_hashed_blocks(rows, ["task"], "prompt_id", "quality", 42, 100), "low", "high")


@query(OBS + f""", s AS (SELECT model, trace_id, sum(quality) AS s, count(*) AS k FROM obs GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY trace_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM s),
d AS (SELECT v.model, r.r, {_DRAW.format(i="v.i", n="v.n")} AS j FROM v CROSS JOIN range(200) r(r)),
m AS (SELECT d.model, d.r, sum(v.s) / sum(v.k) AS q FROM d JOIN v ON v.model = d.model AND v.i = d.j GROUP BY ALL)
SELECT model, round(quantile_cont(q, 0.025), 9) AS low, round(quantile_cont(q, 0.975), 9) AS high, CAST(0.95 AS DOUBLE) AS confidence FROM m GROUP BY model""")
def cluster_bootstrap_hash_ci(spark, sf_dir):
    return _rounded(stats.bootstrap_hashed_blocks(observations(spark, sf_dir), ["model"], "trace_id", "quality", 42, 200), "low", "high")


@query()
def bootstrap_hash_full_ci(spark, sf_dir):
    """Every task and model with 1,000 replicates; bootstrap_hash_ci is the part of it that DuckDB
    repeats. Tests compare with plain Python."""
    return _rounded(stats.bootstrap_hashed_blocks(observations(spark, sf_dir), ["task", "model"], "prompt_id", "quality", 42), "low", "high")


@query()
def cluster_bootstrap_hash_full_ci(spark, sf_dir):
    """cluster_bootstrap_hash_ci with 1,000 replicates."""
    return _rounded(stats.bootstrap_hashed_blocks(observations(spark, sf_dir), ["model"], "trace_id", "quality", 42), "low", "high")


@query()
def bootstrap_mt_ci(spark, sf_dir):
    """Mersenne draws are beyond SQL; tests compare with plain Python."""
    return stats.bootstrap_mersenne(observations(spark, sf_dir), ["model"], ["trace_id", "sequence_index"], "quality", F.lit(42), "trace_id")


_P = stats.PRIME
_WEIGHT = "CASE " + " ".join(f"WHEN u < CAST({float(x)!r} AS DOUBLE) THEN {i}" for i, x in enumerate(stats.POISSON)) + f" ELSE {len(stats.POISSON)} END"
_EACH = [(m, f"(sum(w * q{m}) / sum(w))") for m in range(3)]


@query(OBS + """, p AS (SELECT md5('matrixloom:42:' || prompt_id) AS h, max(CASE WHEN model = 'm0' THEN quality END) AS q0, max(CASE WHEN model = 'm1' THEN quality END) AS q1, max(CASE WHEN model = 'm2' THEN quality END) AS q2 FROM obs GROUP BY prompt_id),
k AS (SELECT q0, q1, q2, """ + ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) % {_P} AS c{i}" for i in range(4)) + f""" FROM p),
x AS (SELECT r, q0, q1, q2, CAST((((c3 * r + c2) % {_P} * r + c1) % {_P} * r + c0) % {_P} AS DOUBLE) / CAST({_P} AS DOUBLE) AS u FROM k CROSS JOIN range(1000) t(r)),
w AS (SELECT r, q0, q1, q2, {_WEIGHT} AS w FROM x), m AS (SELECT r, {', '.join(f'{e} AS a{m}' for m, e in _EACH)} FROM w GROUP BY r)
""" + " UNION ALL ".join(f"SELECT 'm{m}' AS model, round(quantile_cont(a{m}, 0.025), 9) AS low, round(quantile_cont(a{m}, 0.975), 9) AS high, CAST(0.95 AS DOUBLE) AS confidence FROM m" for m in range(3)))
def bootstrap_poisson_ci(spark, sf_dir):
    """Every row and model, 1,000 replicates, added up per partition."""
    return _rounded(stats.bootstrap_poisson(observations(spark, sf_dir), "model", "prompt_id", "quality", 42), "low", "high")


# --- text -----------------------------------------------------------------------------------------

_TOK = """WITH tok AS (SELECT doc_id, lang, lower(w) AS token FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents) WHERE length(w) > 1)"""
_BUCKET = "CAST(CAST('0x' || substr(sha256(unhex(hex('matrixloom:feature:v1') || '00' || hex(token))), 9, 8) AS BIGINT) % 65536 AS INTEGER)"


@query(_TOK + " SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY token")
def tokenize_counts(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    by = d.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return by.groupBy("token").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query(_TOK + f" SELECT DISTINCT token, {_BUCKET} AS bucket FROM tok")
def feature_buckets(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    return d.select("token", hashing.feature_bucket(F.col("token")).alias("bucket"))


def _doc_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("doc_id").cast("string")
    return _table(spark, sf_dir, "documents").select(ident.alias("prompt_id"), F.col("text").alias("prompt"), F.col("lang").alias("task"), hashing.stable_split(ident, 42).alias("part"))


_PART = _part(_unit("CAST(doc_id AS VARCHAR)"))
_FIT = _TOK + f", b AS (SELECT doc_id, lang, {_BUCKET} AS bucket, {_PART} AS part FROM tok), f AS (SELECT lang AS task, bucket, count(*) AS n FROM b WHERE part = 'train' GROUP BY ALL)"


@query(_FIT + " SELECT task, bucket, n FROM f")
def nb_fit(spark, sf_dir):
    return cl.feature_counts(_doc_heads(spark, sf_dir).where("part = 'train'"), exact=False)


@query(_FIT + f""", ex AS (SELECT lang AS task, count(*) AS e FROM documents WHERE {_PART} = 'train' GROUP BY lang), sp AS (SELECT count(DISTINCT bucket) AS v FROM f),
dn AS (SELECT task, sum(n) + (SELECT v FROM sp) AS d FROM f GROUP BY task),
q AS (SELECT doc_id, bucket, count(*) AS k FROM b WHERE part <> 'train' GROUP BY ALL),
s AS (SELECT q.doc_id, ex.task, ln(CAST(max(ex.e) AS DOUBLE) / (SELECT sum(e) FROM ex)) + sum(q.k * ln((coalesce(f.n, 0) + 1) / CAST(dn.d AS DOUBLE))) AS score
      FROM q CROSS JOIN ex JOIN dn ON dn.task = ex.task LEFT JOIN f ON f.task = ex.task AND f.bucket = q.bucket GROUP BY q.doc_id, ex.task),
w AS (SELECT doc_id, task, exp(score - max(score) OVER (PARTITION BY doc_id)) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, task) AS rn FROM s),
z AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN task END) AS win, max(CASE WHEN rn = 1 THEN w END) / sum(w) AS one, max(CASE WHEN rn = 2 THEN w ELSE 0 END) / sum(w) AS two FROM w GROUP BY doc_id),
o AS (SELECT DISTINCT q.doc_id FROM q JOIN f ON f.bucket = q.bucket),
h AS (SELECT d.doc_id, z.*, o.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id WHERE {_PART.replace("doc_id", "d.doc_id")} <> 'train')
SELECT CAST(doc_id AS VARCHAR) AS prompt_id, CASE WHEN coalesce(hit, false) AND one >= CAST(0.55 AS DOUBLE) AND one - two >= CAST(0.1 AS DOUBLE) THEN win ELSE 'unknown' END AS task, round(CASE WHEN coalesce(hit, false) THEN one ELSE 0 END, 6) AS evidence_score, NOT (coalesce(hit, false) AND one >= CAST(0.55 AS DOUBLE) AND one - two >= CAST(0.1 AS DOUBLE)) AS abstained FROM h""")
def nb_classify(spark, sf_dir):
    h = _doc_heads(spark, sf_dir)
    model = cl.fit(h.where("part = 'train'"), exact=False)
    out = cl.classify(h.where("part <> 'train'"), model, explicit=False)
    return out.select("prompt_id", "task", F.round("evidence_score", 6).alias("evidence_score"), "abstained")


def _policy(spark: SparkSession, sf_dir: str, budget: float = 0.05) -> route.Policy:
    """A policy over the whole matrix, whose tasks are given with the prompts."""
    means, e = _means(observations(spark, sf_dir))
    table, best = _task_metrics(means), e.strongest
    rules = {t: route.Rule(m, table[t][m].quality, 0.0, "compiled") for t, m in _rules(means, best, budget).items()}
    known = cl.TaskClassifier(dict.fromkeys(rules, 1), {t: {} for t in rules}, exact=False)
    return route.Policy(best, "cost", budget, tuple(sorted(table[route.GLOBAL])), rules, table, known)


@query(OBS + GLOBAL + _routes_sql("r", "t", "task", "cost", "0.05") + """, h AS (SELECT DISTINCT prompt_id, task, CASE event_id % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'm2' END AS warm FROM obs),
d AS (SELECT h.*, r.model AS sel, s.latency_ms AS l, s.load_ms AS ld, w.quality AS wq, w.latency_ms AS wl, f.quality AS qf FROM h JOIN r ON r.task = h.task JOIN t s ON s.task = h.task AND s.model = r.model CROSS JOIN best JOIN t f ON f.task = h.task AND f.model = strongest LEFT JOIN t w ON w.task = h.task AND w.model = h.warm)
SELECT prompt_id, task, CASE WHEN warm <> sel AND wq + 1e-12 >= qf - CAST(0.05 AS DOUBLE) AND ld + 1e-12 >= greatest(0, wl - l) THEN warm ELSE sel END AS model, coalesce(warm = sel OR (wq + 1e-12 >= qf - CAST(0.05 AS DOUBLE) AND ld + 1e-12 >= greatest(0, wl - l)), false) AS used_warm_model FROM d""")
def route_batch(spark, sf_dir):
    h = validate.heads(observations(spark, sf_dir))
    warm = F.when(_id() % 3 == 0, "m0").when(_id() % 3 == 1, "m2")
    return route.route_batch(h.select("prompt_id", "prompt", "task", warm.alias("warm_model")), _policy(spark, sf_dir)).select("prompt_id", "task", "model", "used_warm_model")


# --- trials and suites --------------------------------------------------------------------------


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials from line items: orders are tasks, line numbers models, rows written in order of
    supplier; a return is a failure."""
    li = _table(spark, sf_dir, "lineitem")
    line = F.col("l_suppkey") * 100_000 + F.col("l_partkey")
    return li.select(F.col("l_orderkey").cast("string").alias("task_id"), F.concat(F.lit("m"), F.col("l_linenumber") % 3).alias("model"), (F.col("l_quantity") / 50.0).alias("quality"), (F.col("l_quantity") > 25).alias("correct"), F.col("l_extendedprice").alias("generation_ms"), (F.col("l_tax") * 1000 - 20).alias("load_ms"), F.when(F.col("l_returnflag") == "R", "failed").alias("error"), line.alias("line_no"))


TRIALS = """WITH tr AS (SELECT CAST(l_orderkey AS VARCHAR) AS task_id, 'm' || (l_linenumber % 3) AS model, l_quantity / 50.0 AS quality, l_quantity > 25 AS correct, l_extendedprice AS generation_ms, l_tax * 1000 - 20 AS load_ms, CASE WHEN l_returnflag = 'R' THEN 'failed' END AS error, l_suppkey * 100000 + l_partkey AS line_no FROM lineitem)"""
LAST = TRIALS + ", la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, model ORDER BY line_no DESC, generation_ms DESC) AS rn FROM tr WHERE error IS NULL) WHERE rn = 1)"


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trials(spark, sf_dir)
    return trials.last_write(t.withColumn("place", F.struct("line_no", "generation_ms")), "place").drop("place")


@query(LAST + " SELECT task_id, model, quality, generation_ms, line_no FROM la")
def trials_last_write(spark, sf_dir):
    return _last(spark, sf_dir).select("task_id", "model", "quality", "generation_ms", "line_no")


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("task"), F.lit("p").alias("prompt"), F.lit("exact_number").alias("grader"))


@query(LAST + """, ok AS (SELECT task_id FROM la GROUP BY task_id HAVING count(DISTINCT model) = 3), cl AS (SELECT model, coalesce(max(CASE WHEN load_ms > 0 THEN load_ms END), 0) AS cold FROM la GROUP BY model),
s AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, o_orderpriority AS task, CAST(o_custkey AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sequence_index FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT task_id FROM ok))
SELECT s.task_id AS prompt_id, s.task, s.trace_id, s.sequence_index, la.model, la.quality, round(la.generation_ms, 3) AS latency_ms, round(cl.cold, 3) AS load_ms FROM s JOIN la ON la.task_id = s.task_id JOIN cl ON cl.model = la.model""")
def trials_to_matrix(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").cast("string").alias("customer"))
    m = trials.to_matrix(_last(spark, sf_dir), _suite(spark, sf_dir).join(o, "pos"), ["m0", "m1", "m2"], "customer")
    return m.select("prompt_id", "task", "trace_id", "sequence_index", "model", "quality", "latency_ms", "load_ms")


@query(LAST + " SELECT CAST(o_orderkey AS VARCHAR) AS task_id, model FROM orders CROSS JOIN (VALUES ('m0'), ('m1'), ('m2')) m(model) EXCEPT SELECT task_id, model FROM la")
def trials_outstanding(spark, sf_dir):
    models = spark.createDataFrame([("m0",), ("m1",), ("m2",)], "model string")
    return trials.outstanding(_suite(spark, sf_dir), models, _last(spark, sf_dir))


@query(LAST + ", ok AS (SELECT task_id FROM la GROUP BY task_id HAVING count(DISTINCT model) = 3) SELECT CAST(o_orderkey AS VARCHAR) AS task_id FROM orders EXCEPT SELECT task_id FROM ok")
def trials_dropped(spark, sf_dir):
    return trials.dropped(_last(spark, sf_dir), _suite(spark, sf_dir), ["m0", "m1", "m2"])


@query(TRIALS + " SELECT model, round(coalesce(max(CASE WHEN load_ms > 0 THEN load_ms END), 0), 6) AS cold_load_ms FROM tr GROUP BY model")
def cold_load(spark, sf_dir):
    return _rounded(trials.cold_load(_trials(spark, sf_dir)), "cold_load_ms").withColumn("cold_load_ms", F.round("cold_load_ms", 6))


@query(TRIALS + " SELECT model, count(*) FILTER (correct) AS n_correct, count(*) AS n, round(count(*) FILTER (correct) / CAST(count(*) AS DOUBLE), 9) AS accuracy FROM tr GROUP BY model")
def model_accuracy(spark, sf_dir):
    return _rounded(trials.accuracy(_trials(spark, sf_dir)), "accuracy")


@query("SELECT o_orderpriority AS task, count(*) AS n FROM orders GROUP BY o_orderpriority")
def suite_summary(spark, sf_dir):
    return trials.suite_summary(_suite(spark, sf_dir))


@query("WITH s AS (SELECT o_orderkey, o_orderpriority AS task, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS lead FROM orders) SELECT CAST(o_orderkey AS VARCHAR) AS task_id, task FROM s ORDER BY turn, lead LIMIT 38")
def round_robin_subset(spark, sf_dir):
    return trials.select_tasks(_suite(spark, sf_dir), 38).select("task_id", "task")


@query("SELECT c_mktsegment AS model, measure, median(v) AS median, min(v) AS low, max(v) AS high FROM (SELECT c_mktsegment, 'load_duration_ms' AS measure, abs(c_acctbal) AS v FROM customer UNION ALL SELECT c_mktsegment, 'total_duration_ms', abs(c_acctbal) * 2 FROM customer) GROUP BY ALL")
def profile_summary(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    return trials.profile_summary(c.select(F.col("c_mktsegment").alias("model"), F.abs("c_acctbal").alias("load_duration_ms"), (F.abs("c_acctbal") * 2).alias("total_duration_ms")))


# --- graders: answers in the shapes that models give ---------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    # a row costs far more to grade than to read: one file of 5 MB has a million of them
    p = p.repartition(shares(p, 1 << 18, 1 << 14), "p_partkey")
    shape = F.col("p_partkey") % 5
    n = F.col("p_size").cast("string")
    name = F.col("p_brand")
    lead = F.when(shape == 0, "The answer is ").when(shape == 1, "<think>first 99 then 7</think>\nFinal answer: ").when(shape == 2, "We try 12, 13.\n").when(shape == 3, "```\n").otherwise("<reasoning>cut off ")
    tail = F.when(shape == 3, "\n```").when(shape == 2, ".").otherwise("")
    key = F.col("p_partkey")
    return p.select("p_partkey", F.concat(lead, n, tail).alias("number"), F.concat(lead, name, tail).alias("word"), F.concat(lead, F.lit('{"size": "'), n, F.lit('", "brand": "'), name, F.lit('"}'), tail).alias("json"), n.alias("size"), name.alias("brand"), F.when(key % 2 == 0, n).otherwise(F.lit("17")).alias("want_n"), F.when(key % 3 == 0, F.lit("Brand")).otherwise(F.upper(name)).alias("want_w"))


ANS = """WITH ans AS (SELECT p_partkey, lead || p_size || tail AS number, lead || p_brand || tail AS word, lead || '{"size": "' || p_size || '", "brand": "' || p_brand || '"}' || tail AS json, CAST(p_size AS VARCHAR) AS size, p_brand AS brand,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '17' END AS want_n, CASE WHEN p_partkey % 3 = 0 THEN 'Brand' ELSE upper(p_brand) END AS want_w FROM (SELECT *,
  CASE p_partkey % 5 WHEN 0 THEN 'The answer is ' WHEN 1 THEN '<think>first 99 then 7</think>' || chr(10) || 'Final answer: ' WHEN 2 THEN 'We try 12, 13.' || chr(10) WHEN 3 THEN '```' || chr(10) ELSE '<reasoning>cut off ' END AS lead,
  CASE p_partkey % 5 WHEN 3 THEN chr(10) || '```' WHEN 2 THEN '.' ELSE '' END AS tail FROM part))"""


def _norm(c: str) -> str:
    c = f"regexp_replace({c}, '<think\\b[^>]*>.*?</think\\s*>', ' ', 'gis')"
    c = f"trim(regexp_replace({c}, '<reasoning\\b[^>]*>.*$', ' ', 'is'), chr(10) || ' ')"
    c = f"trim(regexp_replace({c}, '^```[a-zA-Z0-9_+-]*\\s*\\n?|\\n?```\\s*$', '', 'g'), chr(10) || ' ')"
    return f"trim(regexp_replace({c}, '^\\s*(?:the\\s+)?(?:final\\s+)?(?:answer|result|output|value|label)\\b\\s*(?:is\\b)?\\s*[:=]?\\s*', '', 'i'), chr(10) || ' ')"


def _canon(c: str) -> str:
    return f"lower(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[\\s\"''`*_(\\[{{]+|[\\s\"''`*_.,;:!?)\\]}}]+$', '', 'g'))"


@query(ANS + f" SELECT p_partkey, {_norm('number')} AS answer FROM ans")
def normalise_response(spark, sf_dir):
    return _answers(spark, sf_dir).select("p_partkey", text.normalise(F.col("number")).alias("answer"))


def _graded(df: DataFrame, g: F.Column) -> DataFrame:
    return df.select("p_partkey", g.alias("g")).select("p_partkey", "g.score", "g.correct", "g.reason")


@query(ANS + f""", x AS (SELECT p_partkey, {_norm('number')} AS a, want_n FROM ans), y AS (SELECT *, regexp_extract_all(a, '[-+]?[0-9]*\\.?[0-9]+') AS ns FROM x), z AS (SELECT *, ns[len(ns)] AS last FROM y)
SELECT p_partkey, CASE WHEN a <> '' AND len(ns) > 0 AND CAST(last AS DOUBLE) = CAST(want_n AS DOUBLE) THEN CAST(1 AS DOUBLE) ELSE 0 END AS score, a <> '' AND len(ns) > 0 AND coalesce(CAST(last AS DOUBLE) = CAST(want_n AS DOUBLE), false) AS correct,
CASE WHEN a = '' THEN 'empty response' WHEN len(ns) = 0 THEN 'no number in response' WHEN CAST(last AS DOUBLE) = CAST(want_n AS DOUBLE) THEN 'numeric match' ELSE 'numeric mismatch' END AS reason FROM z""")
def grade_number(spark, sf_dir):
    return _graded(_answers(spark, sf_dir), text.grade_number(F.col("number"), F.col("want_n")))


@query(ANS + f""", x AS (SELECT p_partkey, {_norm('word')} AS a, want_w FROM ans), y AS (SELECT *, list_filter(string_split(a, chr(10)), lambda s: trim(s) <> '') AS ls FROM x),
z AS (SELECT p_partkey, CASE WHEN a = '' THEN 'empty response' WHEN {_canon('a')} = {_canon('want_w')} THEN 'exact match' WHEN {_canon('ls[1]')} = {_canon('want_w')} THEN 'first-line match' WHEN {_canon('ls[len(ls)]')} = {_canon('want_w')} THEN 'final-line match' ELSE 'string mismatch' END AS reason FROM y)
SELECT p_partkey, CASE WHEN reason LIKE '%-line match' OR reason = 'exact match' THEN CAST(1 AS DOUBLE) ELSE 0 END AS score, reason LIKE '%-line match' OR reason = 'exact match' AS correct, reason FROM z""")
def grade_string(spark, sf_dir):
    return _graded(_answers(spark, sf_dir), text.grade_string(F.col("word"), F.col("want_w")))


@query(ANS + f""", x AS (SELECT p_partkey, {_norm('json')} AS a, want_w FROM ans), y AS (SELECT *, regexp_extract(a, '(?s)\\{{.*\\}}') AS b FROM x),
z AS (SELECT p_partkey, CASE WHEN a = '' THEN 'empty response' WHEN b = '' THEN 'no JSON object in response' WHEN {_canon("json_extract_string(b, '$.brand')")} = {_canon('want_w')} THEN 'field match' ELSE 'field mismatch' END AS reason FROM y)
SELECT p_partkey, CASE WHEN reason = 'field match' THEN CAST(1 AS DOUBLE) ELSE 0 END AS score, reason = 'field match' AS correct, reason FROM z""")
def grade_json_field(spark, sf_dir):
    return _graded(_answers(spark, sf_dir), text.grade_json_field(F.col("json"), F.col("want_w"), F.lit("brand")))


@query(ANS + f""", x AS (SELECT p_partkey, {_canon(_norm('json'))} AS a, lower(brand) AS w1, '17' AS w2 FROM ans), y AS (SELECT *, CAST(contains(a, w1) AS INTEGER) + CAST(contains(a, w2) AS INTEGER) AS n FROM x)
SELECT p_partkey, CASE WHEN a = '' THEN 0 ELSE n / CAST(2 AS DOUBLE) END AS score, a <> '' AND n = 2 AS correct, CASE WHEN a = '' THEN 'empty response' WHEN n = 2 THEN 'all substrings present' ELSE n || '/2 substrings present' END AS reason FROM y""")
def grade_contains_all(spark, sf_dir):
    return _graded(_answers(spark, sf_dir), text.grade_contains_all(F.col("json"), F.concat("brand", F.lit(", 17"))))


@query(ANS + f""", x AS (SELECT p_partkey, {_norm('word')} AS a FROM ans) SELECT p_partkey, CASE WHEN regexp_matches(a, 'brand#[1-3]', 'i') THEN CAST(1 AS DOUBLE) ELSE 0 END AS score, regexp_matches(a, 'brand#[1-3]', 'i') AS correct,
CASE WHEN a = '' THEN 'empty response' WHEN regexp_matches(a, 'brand#[1-3]', 'i') THEN 'pattern match' ELSE 'pattern mismatch' END AS reason FROM x""")
def grade_regex(spark, sf_dir):
    return _graded(_answers(spark, sf_dir), text.grade_regex(F.col("word"), F.lit("brand#[1-3]")))


# --- sets, demo, audit -----------------------------------------------------------------------------


@query(OBS + GLOBAL + """, a AS (SELECT DISTINCT task, model FROM obs WHERE quality >= CAST(0.5 AS DOUBLE)), b AS (SELECT DISTINCT task, model FROM obs WHERE latency_ms <= 300)
SELECT 'missing' AS side, task, model FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'additional', task, model FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_diff(spark, sf_dir):
    obs = observations(spark, sf_dir)
    a = obs.where("quality >= 0.5D").select("task", "model").distinct()
    b = obs.where("latency_ms <= 300").select("task", "model").distinct()
    return a.exceptAll(b).select(F.lit("missing").alias("side"), "task", "model").unionByName(b.exceptAll(a).select(F.lit("additional").alias("side"), "task", "model"))


@query("SELECT event_id, coalesce(array_to_string(list_sort(json_keys(props)), ','), '') AS keys FROM events")
def json_keys(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.coalesce(F.array_join(F.array_sort(F.json_object_keys("props")), ","), F.lit("")).alias("keys"))


@query("SELECT task, model, count(*) AS n FROM (VALUES ('classification'), ('coding'), ('extraction'), ('multimodal'), ('reasoning'), ('summarization'), ('tool_use'), ('translation')) t(task) CROSS JOIN (VALUES ('local-small'), ('local-medium'), ('strong-reference')) m(model) CROSS JOIN range(15) GROUP BY ALL")
def demo_matrix(spark, sf_dir):
    return demo_observations(spark).groupBy("task", "model").agg(F.count(F.lit(1)).alias("n"))


@query()
def demo_preview(spark, sf_dir):
    return preview_decisions(demo_observations(spark))


@query()
def audit_compare(spark, sf_dir):
    """The whole audit of the matrix, as one row for each strategy; intervals are drawn by the
    Mersenne twister, which SQL lacks."""
    doc = audit(observations(spark, sf_dir), objective="cost", max_quality_loss=0.05).document
    rows = [(b["name"], b["quality"], b["quality_loss"], b["cost_usd"], b["latency_ms"], b["coverage"], b["routing_regret"], b["switch_count"], b["confidence_intervals"]["quality_loss"]["high"]) for b in doc["baselines"]]
    return spark.createDataFrame(rows, "baseline string, quality double, quality_loss double, cost_usd double, latency_ms double, coverage double, routing_regret double, switch_count bigint, quality_loss_high double")


from matrixloom.plans import checks as _checks  # noqa: E402, F401, registers the other half
