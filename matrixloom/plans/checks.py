"""More registered queries: readers and writers, validation as a whole, selections, the policy and
the audit, each with its statement."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import functions as F

from matrixloom.functions import text
from matrixloom.operators import metrics, select, trials, validate
from matrixloom.plans import queries as q
from matrixloom.plans.audit import audit, compile_policy
from matrixloom.plans.queries import GLOBAL, OBS, query
from matrixloom.sources import demo, jsonl, sinks
from matrixloom.streaming import router

_ROW = ["prompt_id", "task", "trace_id", "sequence_index", "model", "quality", "latency_ms", "cost_usd", "load_ms"]


def _n() -> F.Column:
    return F.col("prompt_id").cast("bigint")


# --- lines and matrices ------------------------------------------------------------------------

_JSON = """'{"cost_usd":' || CAST(cost_usd AS VARCHAR) || ',"latency_ms":' || CAST(latency_ms AS VARCHAR) || ',"load_ms":' || CAST(load_ms AS VARCHAR) || ',"model":"' || model || '","prompt_id":"' || prompt_id || '","quality":' || CAST(quality AS VARCHAR) || ',"sequence_index":' || sequence_index || ',"task":"' || task || '","trace_id":"' || trace_id || '"}'"""


@query(OBS + f" SELECT prompt_id, model, {_JSON} AS value FROM obs")
def jsonl_lines(spark, sf_dir):
    """The matrix as the lines that the writer makes of it."""
    return sinks.jsonl_rows(q.observations(spark, sf_dir))


@query(OBS + f" SELECT {', '.join(_ROW)} FROM obs")
def jsonl_round_trip(spark, sf_dir):
    """Written as lines and read again by the strict reader."""
    return jsonl.observations(sinks.jsonl_rows(q.observations(spark, sf_dir))).select(*_ROW)


#: Faults by id modulo 7: what is done to a good line, and what the reader says.
_FAULTS = [
    ("value", None, None),
    ("replace(value, '\"model\":', '\"modell\":')", "missing_field", "model"),
    ("replace(value, '\"quality\":', '\"quality\":\"x\",\"q\":')", "type", "quality"),
    ("replace(value, ',\"trace_id\":\"', ',\"task\":\"')", "json", "not one JSON object with distinct keys"),
    ("concat('[', value, ']')", "json", "not one JSON object with distinct keys"),
    ("'  '", "blank_line", ""),
    ("replace(value, '\"sequence_index\":', '\"sequence_index\":0.5,\"s\":')", "type", "sequence_index"),
]
_SAID = " UNION ALL ".join(
    [f"SELECT line_no, '{code}' AS code, '{detail}' AS detail FROM x WHERE k = {k}" for k, (_, code, detail) in enumerate(_FAULTS) if code]
    + [f"SELECT line_no, 'unknown_field', '{field}' FROM x WHERE k = {k}" for k, field in ((1, "modell"), (2, "q"), (6, "s"))]
)


@query(OBS + f", x AS (SELECT event_id * 3 + CAST(substr(model, 2) AS BIGINT) AS line_no, event_id % 7 AS k FROM obs) {_SAID}")
def jsonl_violations(spark, sf_dir):
    """Every fault of every bad line, as rows."""
    rows = sinks.jsonl_rows(q.observations(spark, sf_dir))
    bad = F.expr("CASE " + " ".join(f"WHEN k = {k} THEN {how}" for k, (how, *_) in enumerate(_FAULTS)) + " END")
    line = _n() * 3 + F.substring("model", 2, 9).cast("bigint")
    return jsonl.line_violations(rows.select(line.alias("line_no"), (_n() % 7).alias("k"), "value").select("line_no", bad.alias("value")))


_D = """, d AS (SELECT * FROM (SELECT prompt_id, model, event_id, CASE WHEN event_id % 97 = 0 THEN ' ' || task WHEN event_id % 101 = 0 THEN NULL ELSE task END AS task, trace_id,
  CASE WHEN event_id % 53 = 0 THEN -1 ELSE sequence_index END AS sequence_index, CASE WHEN event_id % 89 = 0 THEN 7 ELSE quality END AS quality FROM obs) WHERE NOT (event_id % 103 = 0 AND model = 'm1')),
p AS (SELECT DISTINCT prompt_id, trace_id, sequence_index FROM d)
SELECT 'text' AS code, prompt_id, model, 'task' AS detail FROM d WHERE event_id % 97 = 0 UNION ALL SELECT 'no_signal', prompt_id, model, 'neither prompt nor task' FROM d WHERE task IS NULL
UNION ALL SELECT 'range', prompt_id, model, 'sequence_index' FROM d WHERE sequence_index < 0 UNION ALL SELECT 'range', prompt_id, model, 'quality' FROM d WHERE quality > 1
UNION ALL SELECT 'shared_place', NULL, NULL, trace_id || '[' || sequence_index || ']' FROM p GROUP BY trace_id, sequence_index HAVING count(*) > 1
UNION ALL SELECT 'missing', CAST(event_id AS VARCHAR), 'm1', 'no result' FROM events WHERE event_id % 103 = 0"""


@query(OBS + _D)
def val_everything(spark, sf_dir):
    """All violations of a matrix with faults of most kinds, in rows."""
    obs = q.observations(spark, sf_dir).where(~((_n() % 103 == 0) & (F.col("model") == "m1")))
    task = F.when(_n() % 97 == 0, F.concat(F.lit(" "), "task")).when(_n() % 101 != 0, F.col("task"))
    obs = obs.withColumn("task", task).withColumn("sequence_index", F.when(_n() % 53 == 0, -1).otherwise(F.col("sequence_index"))).withColumn("quality", F.when(_n() % 89 == 0, 7.0).otherwise(F.col("quality")))
    return validate.violations(obs, require_signal=True)


@query(OBS + f" SELECT {', '.join(_ROW)} FROM obs WHERE event_id IN (SELECT o_orderkey FROM orders)")
def subset_prompts(spark, sf_dir):
    """The prompts that another table names, validated anew."""
    obs = q.observations(spark, sf_dir)
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("prompt_id"))
    known = ids.join(select.unknown_ids(obs, ids), "prompt_id", "left_anti")
    return select.subset(obs, known).select(*_ROW)


@query(OBS + " SELECT CAST(o_orderkey AS VARCHAR) AS prompt_id FROM orders EXCEPT SELECT prompt_id FROM obs")
def subset_unknown(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("prompt_id"))
    return select.unknown_ids(q.observations(spark, sf_dir), ids)


@query(OBS + f" SELECT {', '.join(_ROW)} FROM obs WHERE prompt_id = '7'")
def prompt_rows(spark, sf_dir):
    return select.for_prompt(q.observations(spark, sf_dir), "7").select(*_ROW)


@query(OBS + " SELECT count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts, count(DISTINCT model) AS n_models FROM obs")
def matrix_sizes(spark, sf_dir):
    return select.sizes(q.observations(spark, sf_dir))


@query(OBS + GLOBAL + q._routes_sql("r", "t", "task", "latency", "0.3").replace("  WHERE x.quality", "  WHERE x.model IN ('m1', (SELECT strongest FROM best)) AND x.quality") + " SELECT task, model FROM r")
def feasible_routes_in_pool(spark, sf_dir):
    means, e = q._means(q.observations(spark, sf_dir))
    return metrics.choose(means.where("scope = 'task'"), ["task"], e.strongest, 0.3, "latency", ["m1", e.strongest])


# --- suites, answers, names ------------------------------------------------------------------------

_KINDS = ["grade_number", "grade_string", "grade_json_field", "grade_contains_all", "grade_regex"]


@query(" UNION ALL ".join(f"SELECT * FROM ({q.ORACLE_SQL[name]}) WHERE p_partkey % 5 = {i}" for i, name in enumerate(_KINDS)))
def grade_dispatch(spark, sf_dir):
    """Answers graded by the grader that their row names."""
    a = q._answers(spark, sf_dir)
    k = F.col("p_partkey") % 5
    pick = lambda *v: F.element_at(F.array(*v), (k + 1).cast("int"))
    none = F.lit(None).cast("string")
    grader = pick(*[F.lit(x) for x in ("exact_number", "exact_string", "json_field", "contains_all", "regex")])
    response = pick(F.col("number"), F.col("word"), F.col("json"), F.col("json"), F.col("word"))
    argument = pick(none, none, F.lit("brand"), F.concat("brand", F.lit(", 17")), F.lit("brand#[1-3]"))
    return q._graded(a, text.grade(response, F.when(k == 0, F.col("want_n")).otherwise(F.col("want_w")), grader, argument))


@query("SELECT p_partkey, true AS refused, CASE p_partkey % 3 WHEN 0 THEN 'no substring is required' WHEN 1 THEN 'a pattern must compile and have 1 to 500 characters' ELSE 'expected number and tolerance must be finite, the tolerance not negative' END AS reason FROM part")
def grade_unusable(spark, sf_dir):
    """Specifications that can't be used are a reason in their own row, and end no job."""
    k = F.col("p_partkey") % 3
    grader = F.when(k == 0, "contains_all").when(k == 1, "regex").otherwise("exact_number")
    argument = F.when(k == 0, " , ").when(k == 1, "(").otherwise("-1")
    g = q._graded(q._answers(spark, sf_dir), text.grade(F.col("number"), F.lit("5"), grader, argument))
    return g.select("p_partkey", (F.col("score").isNull() & F.col("correct").isNull()).alias("refused"), "reason")


@query("SELECT lang, token, count(*) AS n FROM (SELECT lang, replace(lower(w), 'ß', 'ss') AS token FROM (SELECT lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS w FROM documents) WHERE length(w) > 1) GROUP BY ALL")
def tokenize_casefold(spark, sf_dir):
    """Tokens by full case folding."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return text.count_exactly(d, "lang", "text").groupBy("lang", "token").agg(F.sum("n").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 > 0 THEN round(CAST(l_suppkey * 1234567 AS DOUBLE) / 1e6, 6) END AS ms FROM lineitem")
def nanoseconds(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ns = F.when(F.col("l_partkey") % 5 > 0, F.col("l_suppkey") * 1234567).otherwise(-5)
    return li.select("l_orderkey", "l_linenumber", trials.milliseconds(ns).alias("ms"))


@query("SELECT n_name AS requested, r_name AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) JOIN region ON n_regionkey = r_regionkey WHERE rn = 1")
def resolved_models(spark, sf_dir):
    """Names asked for, found among those that installed models go by: nations for regions."""
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    installed = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("canonical"), F.col("n_name").alias("name"))
    return trials.resolve_models(n.select(F.col("n_nationkey").alias("pos"), F.concat(F.lit(" "), "n_name").alias("name")), installed)


@query("SELECT DISTINCT s_name AS model, 'missing' AS side FROM supplier WHERE s_acctbal >= 0 AND s_nationkey % 2 = 0 UNION ALL SELECT DISTINCT s_name, 'additional' FROM supplier WHERE s_acctbal < 0 AND s_nationkey % 2 = 1")
def residency_changes(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumnRenamed("s_name", "model")
    return trials.residency_difference(s.where("s_acctbal >= 0 or s_nationkey % 2 = 0 and s_acctbal < 0"), s.where("s_acctbal < 0 or s_nationkey % 2 = 1 and s_acctbal >= 0"))


# --- the synthetic matrix -------------------------------------------------------------------------

_TASKS = ", ".join(f"({i}, '{t}', [{', '.join(f'CAST({x} AS DOUBLE)' for x in qs)}])" for i, (t, (_, qs)) in enumerate(sorted(demo._TASK.items())))
_MODELS = ", ".join(f"({i}, '{m}', CAST({lat} AS DOUBLE), CAST({cost} AS DOUBLE), CAST({load} AS DOUBLE))" for i, (m, lat, cost, load) in enumerate(demo._MODEL))
_DEMO = f"""WITH dm AS (SELECT 'demo-' || task || '-' || lpad(CAST(n AS VARCHAR), 3, '0') AS prompt_id, task, 'demo-trace-' || lpad(CAST(n AS VARCHAR), 3, '0') AS trace_id, ti AS sequence_index, model,
  round(greatest(0, least(1, q[mi + 1] + ((n + ti) % 5 - 2) * CAST(0.0015 AS DOUBLE))), 6) AS quality, round(lat + (n % 7) * 8 + ti * 3 + mi, 3) AS latency_ms, round(cost * (1 + (n % 4) * CAST(0.04 AS DOUBLE)), 8) AS cost_usd, load AS load_ms
  FROM range(1, 16) r(n) CROSS JOIN (VALUES {_TASKS}) t(ti, task, q) CROSS JOIN (VALUES {_MODELS}) m(mi, model, lat, cost, load))"""


@query(_DEMO + f" SELECT {', '.join(_ROW)} FROM dm")
def demo_values(spark, sf_dir):
    return demo.demo_observations(spark).select(*_ROW)


@query(_DEMO + """, a AS (SELECT task, model, avg(quality) AS quality, avg(latency_ms) AS latency_ms, avg(cost_usd) AS cost_usd FROM dm GROUP BY ALL), b AS (SELECT *, max(quality) OVER (PARTITION BY task) AS best FROM a),
ok AS (SELECT *, cost_usd / CAST(0.0048 AS DOUBLE) + latency_ms / 920 AS v FROM b WHERE best - quality <= CAST(0.02 AS DOUBLE) + 1e-12)
SELECT task, model AS selected_model, round(quality, 9) AS quality, round(best - quality, 9) AS quality_loss, round(latency_ms, 9) AS latency_ms, round(cost_usd, 9) AS cost_usd, eligible
FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY v, model) AS rn, string_agg(model, ',') OVER (PARTITION BY task ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS eligible FROM ok) WHERE rn = 1""")
def demo_choices(spark, sf_dir):
    p = demo.preview_decisions(demo.demo_observations(spark))
    return q._rounded(p, "quality", "quality_loss", "latency_ms", "cost_usd").withColumn("eligible", F.array_join("eligible", ","))


# --- policy and audit -------------------------------------------------------------------------------

_SPLIT = q.PARTS + ", dev AS (SELECT obs.* FROM obs JOIN parts USING (trace_id) WHERE part = 'dev'), tst AS (SELECT obs.* FROM obs JOIN parts USING (trace_id) WHERE part = 'test')"
_POOL = """, al AS (SELECT '' AS task, model, quality, latency_ms, cost_usd, load_ms FROM g UNION ALL SELECT 't' || task, model, quality, latency_ms, cost_usd, load_ms FROM t),
pool AS (SELECT DISTINCT model FROM al a WHERE NOT EXISTS (SELECT 1 FROM al b WHERE b.task = a.task AND b.model <> a.model AND b.quality >= a.quality AND b.cost_usd <= a.cost_usd AND b.latency_ms <= a.latency_ms AND b.load_ms <= a.load_ms
  AND (b.quality > a.quality OR b.cost_usd < a.cost_usd OR b.latency_ms < a.latency_ms OR b.load_ms < a.load_ms)) UNION SELECT strongest FROM best)"""
#: What is compiled from the development part: the routes, or the fallback where they cost too much.
_COMPILED = (
    OBS + _SPLIT + GLOBAL.replace("FROM obs", "FROM dev") + _POOL
    + q._routes_sql("r0", "t", "task", "cost", "0.05").replace("  WHERE x.quality", "  WHERE x.model IN (SELECT model FROM pool) AND x.quality")
    + """, lost AS (SELECT avg(f.quality - o.quality) AS loss FROM dev o JOIN r0 ON r0.task = o.task AND r0.model = o.model JOIN dev f ON f.prompt_id = o.prompt_id AND f.model = (SELECT strongest FROM best)),
r AS (SELECT task, CASE WHEN (SELECT loss FROM lost) > CAST(0.05 AS DOUBLE) + 1e-12 THEN (SELECT strongest FROM best) ELSE model END AS model FROM r0)"""
)


@query(_COMPILED + " SELECT r.task, r.model, round(t.quality, 9) AS expected_quality, round(greatest(0, f.quality - t.quality), 9) AS quality_loss, (SELECT string_agg(model, ',' ORDER BY model) FROM pool) AS pool FROM r JOIN t ON t.task = r.task AND t.model = r.model JOIN t f ON f.task = r.task AND f.model = (SELECT strongest FROM best)")
def policy_routes(spark, sf_dir):
    """The policy compiled from the train and development parts of the matrix."""
    p = compile_policy(q.observations(spark, sf_dir), 0.05, "cost")
    rows = [(t, r.model, round(r.expected_quality, 9), round(r.quality_loss, 9), ",".join(p.pool)) for t, r in p.routes.items()]
    return spark.createDataFrame(rows, "task string, model string, expected_quality double, quality_loss double, pool string")


_AUDIT = (
    _COMPILED + q._routes_sql("orc", "tst", "prompt_id", "cost", "0.05")
    + """, h AS (SELECT DISTINCT prompt_id, task, trace_id, sequence_index FROM tst), pr AS (
  SELECT h.*, r.model AS routed, s.latency_ms AS l_sel, s.load_ms AS load_sel, f.quality AS qf FROM h JOIN r ON h.task = r.task JOIN t s ON s.task = h.task AND s.model = r.model JOIN t f ON f.task = h.task AND f.model = (SELECT strongest FROM best)
), fold AS (
  SELECT prompt_id, trace_id, sequence_index, routed AS model FROM pr WHERE sequence_index = 0 UNION ALL
  SELECT p.prompt_id, p.trace_id, p.sequence_index, CASE WHEN f.model <> p.routed AND w.quality + 1e-12 >= p.qf - CAST(0.05 AS DOUBLE) AND p.load_sel + 1e-12 >= greatest(0, w.latency_ms - p.l_sel) THEN f.model ELSE p.routed END
  FROM fold f JOIN pr p ON p.trace_id = f.trace_id AND p.sequence_index = f.sequence_index + 1 LEFT JOIN t w ON w.task = p.task AND w.model = f.model
), asg AS (
  SELECT 'always-strongest' AS baseline, prompt_id, strongest AS model FROM h, best UNION ALL SELECT 'warm-only', prompt_id, strongest FROM h, best UNION ALL SELECT 'always-cheapest', prompt_id, cheapest FROM h, best
  UNION ALL SELECT 'always-fastest', prompt_id, fastest FROM h, best UNION ALL SELECT 'compiled', prompt_id, model FROM fold UNION ALL SELECT 'oracle', prompt_id, model FROM orc
  UNION ALL SELECT 'task-only', h.prompt_id, r.model FROM h JOIN r ON h.task = r.task UNION ALL SELECT 'random', prompt_id, 'm' || (CAST('0x' || substr(sha256('matrixloom-random:42:' || prompt_id), 1, 16) AS UBIGINT) % 3) FROM h
), c0 AS (
  SELECT a.baseline, o.*, f.quality - o.quality AS quality_loss, m.q - o.quality AS regret, lag(o.model) OVER (PARTITION BY a.baseline, o.trace_id ORDER BY o.sequence_index) AS prev
  FROM asg a JOIN tst o ON a.prompt_id = o.prompt_id AND a.model = o.model JOIN tst f ON f.prompt_id = o.prompt_id AND f.model = (SELECT strongest FROM best) JOIN (SELECT prompt_id, max(quality) AS q FROM tst GROUP BY prompt_id) m ON m.prompt_id = o.prompt_id
), c AS (SELECT *, latency_ms + CASE WHEN prev IS NULL OR prev <> model THEN load_ms ELSE 0 END AS latency, CASE WHEN prev IS NOT NULL AND prev <> model THEN 1 ELSE 0 END AS switched FROM c0)"""
)


@query(_AUDIT + """ SELECT baseline, round(avg(quality), 9) AS quality, round(avg(quality_loss), 9) AS quality_loss, round(avg(cost_usd), 9) AS cost_usd, round(avg(latency), 9) AS latency_ms, round(quantile_cont(latency, 0.5), 9) AS latency_p50_ms,
 round(quantile_cont(latency, 0.95), 9) AS latency_p95_ms, CAST(1 AS DOUBLE) AS coverage, round(avg(regret), 9) AS routing_regret, CAST(sum(switched) AS BIGINT) AS switch_count, baseline <> 'oracle' AS deployable,
 (SELECT count(DISTINCT trace_id) FROM tst) AS bootstrap_unit_count FROM c GROUP BY baseline""")
def audit_strategies(spark, sf_dir):
    """The audit of the matrix on its held-out part, without the intervals, which audit_compare has."""
    doc = audit(q.observations(spark, sf_dir), 0.05, "cost", resamples=1).document
    cols = [*q._CMP[:3], "latency_ms", "latency_p50_ms", "latency_p95_ms", "coverage", "routing_regret"]
    rows = [(b["name"], *(round(b[c], 9) for c in cols), b["switch_count"], b["deployable"], b["bootstrap_unit_count"]) for b in doc["baselines"]]
    return spark.createDataFrame(rows, "baseline string, " + ", ".join(f"{c} double" for c in cols) + ", switch_count bigint, deployable boolean, bootstrap_unit_count bigint")


# --- files and streams --------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A new folder where the cluster keeps what its executors share, deleted with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="matrix-")
    path = f"{root.rstrip('/')}/q-{uuid.uuid4().hex}"

    def delete() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # noqa: BLE001, the JVM may be gone
            pass

    atexit.register(delete)
    return path


@query(OBS + f" SELECT {', '.join(_ROW)} FROM obs")
def observations_file(spark, sf_dir):
    """The matrix written in canonical order and read by the strict reader with all its checks."""
    path = sinks.dump_jsonl(q.observations(spark, sf_dir), _folder(spark))
    return jsonl.load_jsonl(spark, path + "/*.txt", require_signal=True, max_rows=10**9).select(*_ROW)


@query("""WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id, 'm' || (c_nationkey % 3) AS model, c_custkey, c_acctbal FROM customer)
SELECT task_id, model, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 7 <> 0 THEN c_acctbal + 1 ELSE c_acctbal END AS quality FROM a""")
def trials_of_two_appends(spark, sf_dir):
    """A sidecar of two appends: the later row of a task and model counts, unless it failed."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    rows = c.select(key.cast("string").alias("task_id"), F.concat(F.lit("m"), (F.col("c_nationkey") % 3).cast("string")).alias("model"), F.col("c_acctbal").alias("quality"), key)
    path = _folder(spark)
    sinks.append_trials(rows.select("task_id", "model", "quality"), path)
    later = rows.where(key % 3 == 0).select("task_id", "model", (F.col("quality") + 1).alias("quality"), F.when(key % 7 == 0, "failed").alias("error"))
    sinks.append_trials(later, path)
    return trials.last_write(jsonl.load_trials(spark, path)).select("task_id", "model", "quality")


def _stream(spark, sf_dir: str, table: str):
    """A table as a stream, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    # as a pattern, since the source takes any other path for a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}[.]parquet")


def _streamed(df):
    """The table that a stream in complete mode ends with, kept in files and not by the driver."""
    path = _folder(df.sparkSession)
    df.sparkSession.createDataFrame([], df.schema).write.parquet(f"{path}/out")
    put = lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/out")
    done = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode("complete").trigger(availableNow=True).start()
    done.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


@query("SELECT CAST(conv_id AS VARCHAR) AS trace_id, count(*) AS n, min(turn) AS first, max(turn) AS last, max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY conv_id")
def stream_trace_gaps(spark, sf_dir):
    s = _stream(spark, sf_dir, "conversations")
    return _streamed(router.trace_gaps(s.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").alias("sequence_index"))))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS model, round(avg(event_id % 101 / CAST(100 AS DOUBLE)), 9) AS quality, round(avg(CAST(event_id % 7 AS DOUBLE)), 9) AS latency_ms, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    s = _stream(spark, sf_dir, "events")
    rows = s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("model"), (F.col("event_id") % 101 / F.lit(100.0)).alias("quality"), (F.col("event_id") % 7).cast("double").alias("latency_ms"))
    out = _streamed(router.windowed_quality(rows))
    return q._rounded(out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "model", "quality", "latency_ms", "n"), "quality", "latency_ms")
