"""Strict readers of observation, suite, trial and profile files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrixloom.functions.text import GRADERS
from matrixloom.operators.route import Policy
from matrixloom.operators.validate import untrimmed, validate
from matrixloom.schema import MAX_FILE_BYTES, MAX_LINE_BYTES, MAX_ROWS, OPTIONAL, REQUIRED, PolicyError, ValidationError


def lines(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, line_no, value) of each line of UTF-8 files of limited size. Only a line feed ends
    a line; one carriage return before it is dropped."""
    files = spark.read.format("binaryFile").load(path)
    bad = files.where((F.col("length") > max_bytes) | ~F.is_valid_utf8(F.col("content"))).select("path", "length").limit(1).collect()
    if bad:
        raise ValidationError(f"{bad[0].path} is larger than {max_bytes} bytes or not UTF-8")
    text = F.regexp_replace(F.decode("content", "utf-8"), "\\n\\z", "")
    each = files.where("length > 0").select("path", F.posexplode(F.split(text, "\n", -1)).alias("at", "value"))
    return each.select("path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("value", "\\r\\z", "").alias("value"))


def text_lines(spark: SparkSession, text: str) -> DataFrame:
    """The same rule for text in memory."""
    rows = text.split("\n")
    rows = rows[:-1] if rows[-1] == "" else rows
    return spark.createDataFrame([("text", i, r.removesuffix("\r")) for i, r in enumerate(rows, 1)], "path string, line_no int, value string")


def _kind(v: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def parsed(rows: DataFrame) -> DataFrame:
    """Adds v (the line as a variant, null unless it is one JSON object without repeated keys or
    non-numbers) and keys."""
    one = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
    parsed_once = F.when(F.coalesce(one, F.lit(False)), F.try_parse_json("value"))
    # a line is parsed here and nowhere else: what is generated isn't worked out anew by each mention of it
    out = rows.select("*", F.explode(F.array(parsed_once)).alias("v"))
    v = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v"))
    return out.select(*rows.columns, F.explode(F.array(F.struct(v.alias("v"), F.json_object_keys("value").alias("keys")))).alias("__p")).select(*rows.columns, "__p.v", "__p.keys")


def line_violations(rows: DataFrame) -> DataFrame:
    """(line_no, code, detail) of lines that are no observation."""
    p = parsed(rows)
    v, keys = F.col("v"), F.col("keys")
    checks: list[tuple[Column, str, Column]] = [
        (F.octet_length("value") > MAX_LINE_BYTES, "long_line", F.lit("")),
        (F.trim("value") == "", "blank_line", F.lit("")),
        ((F.trim("value") != "") & v.isNull(), "json", F.lit("not one JSON object with distinct keys")),
    ]
    req, every = F.array(*[F.lit(x) for x in REQUIRED]), F.array(*[F.lit(x) for x in (*REQUIRED, *OPTIONAL)])
    known = v.isNotNull()
    missing, extra = F.array_except(req, keys), F.array_except(keys, every)
    checks += [(known & (F.size(missing) > 0), "missing_field", F.array_join(missing, ",")), (known & (F.size(extra) > 0), "unknown_field", F.array_join(extra, ","))]
    has = lambda f: F.array_contains(keys, f)
    for f in ("prompt_id", "model"):
        checks.append((known & has(f) & (_kind(v, f) != "STRING"), "type", F.lit(f)))
    for f in ("prompt", "task"):
        checks.append((known & has(f) & ~_kind(v, f).isin("STRING", "VOID"), "type", F.lit(f)))
    for f in ("quality", "latency_ms", "cost_usd", "load_ms"):
        number = _kind(v, f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
        checks.append((known & has(f) & ~F.coalesce(number, F.lit(False)), "type", F.lit(f)))
    checks.append((known & (has("trace_id") != has("sequence_index")), "trace_pair", F.lit("")))
    checks.append((known & has("trace_id") & (_kind(v, "trace_id") != "STRING"), "type", F.lit("trace_id")))
    checks.append((known & has("sequence_index") & (_kind(v, "sequence_index") != "BIGINT"), "type", F.lit("sequence_index")))
    checks.append((known & has("metadata") & ~_kind(v, "metadata").startswith("OBJECT"), "type", F.lit("metadata")))
    # numbers too large for a double are infinite
    checks.append((known & has("metadata") & F.get_json_object("value", "$.metadata").rlike(r"[0-9][eE]\+?(30[89]|3[1-9][0-9]|[4-9][0-9][0-9]|[0-9]{4,})"), "not_finite", F.lit("metadata")))
    each = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), d.alias("detail"))) for c, code, d in checks])
    return p.select("line_no", F.explode(each).alias("x")).where("x is not null").select("line_no", "x.code", "x.detail")


def observations(rows: DataFrame) -> DataFrame:
    """Typed observations of lines without violations."""
    p = parsed(rows)
    get = lambda f, t: F.try_variant_get("v", f"$.{f}", t)
    meta = F.when(F.array_contains("keys", "metadata"), F.to_json(F.try_variant_get("v", "$.metadata", "variant")))
    return p.select(
        get("prompt_id", "string").alias("prompt_id"), get("prompt", "string").alias("prompt"), get("task", "string").alias("task"), get("trace_id", "string").alias("trace_id"), get("sequence_index", "bigint").alias("sequence_index"), get("model", "string").alias("model"),
        get("quality", "double").alias("quality"), get("latency_ms", "double").alias("latency_ms"), get("cost_usd", "double").alias("cost_usd"), F.coalesce(get("load_ms", "double"), F.lit(0.0)).alias("load_ms"), F.when(meta != "{}", meta).alias("metadata"),
    )


def _checked(rows: DataFrame, require_signal: bool, require_complete: bool, max_rows: int = MAX_ROWS) -> DataFrame:
    n = rows.count()
    if not n or n > max_rows:
        raise ValidationError(f"{n} rows; 1 to {max_rows} are read")
    found = line_violations(rows).orderBy("line_no", "code", "detail").limit(5).collect()
    if found:
        raise ValidationError("; ".join(f"line {x.line_no}: {x.code} {x.detail}".rstrip() for x in found))
    return validate(observations(rows), require_signal, require_complete)


def load_jsonl(spark: SparkSession, path: str, require_signal: bool = False, require_complete: bool = True, max_bytes: int = MAX_FILE_BYTES, max_rows: int = MAX_ROWS) -> DataFrame:
    """Validated observations of a JSON-lines file. The limits are those of the file format; larger
    tables are read with larger ones, or by read_observations() and validate()."""
    return _checked(lines(spark, path, max_bytes), require_signal, require_complete, max_rows)


def parse_jsonl(spark: SparkSession, text: str, require_signal: bool = False, require_complete: bool = True) -> DataFrame:
    return _checked(text_lines(spark, text), require_signal, require_complete)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a JSON-lines file without any checks."""
    from matrixloom.schema import OBSERVATIONS

    return spark.read.schema(OBSERVATIONS).json(path)


# --- suites, trials, profiles, policies --------------------------------------------------------

_TASK = ("id", "task", "prompt", "expected", "grader", "grader_arg")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, pos, task, prompt, expected, grader, grader_arg) of a suite; # starts a comment."""
    rows = lines(spark, path, 4 << 20).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    p = parsed(rows)
    get = lambda f: F.trim(F.try_variant_get("v", f"$.{f}", "string"))
    extra = F.array_except("keys", F.array(*[F.lit(x) for x in _TASK]))
    blank = None
    for f in _TASK[:5]:
        one = F.coalesce(_kind(F.col("v"), f) != "STRING", F.lit(True)) | F.coalesce(get(f) == "", F.lit(True))
        blank = one if blank is None else blank | one
    arg = F.array_contains("keys", "grader_arg") & ~_kind(F.col("v"), "grader_arg").isin("STRING", "VOID")
    bad = F.col("v").isNull() | (F.size(extra) > 0) | blank | arg | ~get("grader").isin(list(GRADERS)) | (F.length(get("prompt")) > 2000)
    wrong = p.where(F.coalesce(bad, F.lit(True))).select("line_no").orderBy("line_no").limit(1).collect()
    if wrong:
        raise ValidationError(f"line {wrong[0].line_no} is no task")
    out = p.select(get("id").alias("task_id"), F.col("line_no").alias("pos"), get("task").alias("task"), get("prompt").alias("prompt"), get("expected").alias("expected"), get("grader").alias("grader"), F.when(get("grader_arg") != "", get("grader_arg")).alias("grader_arg"))
    twice = out.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("task_id").limit(5).collect()
    if twice or not out.limit(1).count():
        raise ValidationError("repeated task ids: " + ", ".join(r.task_id for r in twice) if twice else "there are no tasks")
    return out


def load_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials of an append-only file or folder of files of any size; blank and broken lines are
    passed over. place orders rows over all files: when their append began, their number in it,
    and for rows of other writers file and line."""
    files = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), (F.col("_metadata.file_block_start")).alias("block"), F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "\\r\\z", "").alias("value"))
    get = lambda f, t: F.try_variant_get("v", f"$.{f}", t)
    rows = parsed(files).where("v is not null")
    place = F.struct(get("written_at", "bigint").alias("written_at"), get("row", "bigint").alias("row"), "path", "block", "id")
    return rows.select(get("task_id", "string").alias("task_id"), get("model", "string").alias("model"), F.coalesce(get("quality", "double"), F.lit(0.0)).alias("quality"), F.coalesce(get("correct", "boolean"), F.lit(False)).alias("correct"), F.coalesce(get("generation_ms", "double"), F.lit(0.0)).alias("generation_ms"), F.coalesce(get("load_ms", "double"), F.lit(0.0)).alias("load_ms"), F.coalesce(get("grade_reason", "string"), F.lit("")).alias("grade_reason"), F.nullif(get("error", "string"), F.lit("")).alias("error"), place.alias("place"))


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """(model, repeat, load_duration_ms, total_duration_ms) of a profile manifest."""
    models = spark.read.option("multiLine", True).json(path).select(F.explode("models").alias("m"))
    each = models.select("m.model", F.explode("m.observations").alias("o"))
    return each.select("model", "o.repeat", "o.load_duration_ms", "o.total_duration_ms")


def load_policy(source: str | Path | dict) -> Policy:
    if isinstance(source, dict):
        return Policy.from_dict(source)
    try:
        d = json.loads(Path(source).read_text("utf-8"))
    except ValueError as e:
        raise PolicyError(f"not JSON: {e}") from None
    if not isinstance(d, dict):
        raise PolicyError("a policy is a JSON object")
    return Policy.from_dict(d)


__all__ = ["line_violations", "lines", "load_jsonl", "load_policy", "load_profile", "load_tasks", "load_trials", "observations", "parse_jsonl", "read_observations", "text_lines", "untrimmed"]
