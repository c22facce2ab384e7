"""Multinomial classifier of prompts over hashed tokens, which abstains on weak evidence."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.functions.hashing import BUCKETS, bucket_of, feature_bucket
from matrixloom.functions.sizes import is_small, small_rows
from matrixloom.functions.text import count_exactly, has_tokens, has_tokens_exactly, runs
from matrixloom.schema import PolicyError

UNKNOWN = "unknown"
TYPE, LEGACY = "hashed-feature-evidence-v1", "token-evidence-v1"


@dataclass(frozen=True)
class TaskClassifier:
    """counts: {task: {bucket: n}}, bounded by tasks x BUCKETS; examples: {task: n}."""

    examples: dict[str, int]
    counts: dict[str, dict[int, int]]
    min_examples: int = 2
    min_score: float = 0.55
    min_margin: float = 0.10
    exact: bool = True
    buckets: int = BUCKETS
    tasks: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "tasks", tuple(sorted(self.examples)))
        if self.min_examples < 1 or not 0 <= self.min_score <= 1 or not 0 <= self.min_margin <= 1:
            raise PolicyError("min_examples must be positive, thresholds between 0 and 1")
        if set(self.counts) != set(self.examples) or any(n < 1 for n in self.examples.values()):
            raise PolicyError("every known task needs examples and counts")
        if any(not 0 <= b < self.buckets or n < 1 for c in self.counts.values() for b, n in c.items()):
            raise PolicyError("feature counts must be positive and their buckets in range")

    def restricted(self, tasks: set[str]) -> TaskClassifier:
        keep = [t for t in self.tasks if t in tasks]
        return TaskClassifier({t: self.examples[t] for t in keep}, {t: self.counts[t] for t in keep}, self.min_examples, self.min_score, self.min_margin, self.exact, self.buckets)

    def to_dict(self) -> dict:
        return {
            "type": TYPE, "known_tasks": list(self.tasks), "task_examples": dict(sorted(self.examples.items())), "min_examples": self.min_examples, "min_evidence_score": self.min_score, "min_margin": self.min_margin, "feature_bucket_count": self.buckets, "exact_tokens": self.exact,
            "feature_counts": {t: {f"bucket:{b}": n for b, n in sorted(self.counts[t].items())} for t in self.tasks},
        }

    @classmethod
    def from_dict(cls, d: dict) -> TaskClassifier:
        """A classifier with counts by bucket, or an older one with counts by word and other names of
        type and threshold, whose words are hashed as it is read."""
        try:
            by_word = d.get("type", LEGACY if "token_counts" in d else TYPE) == LEGACY
            if not by_word and d.get("type", TYPE) != TYPE:
                raise PolicyError(f"classifiers of type {d['type']!r} can't be read")
            buckets = _whole(d.get("feature_bucket_count", BUCKETS), 2)
            counts: dict[str, dict[int, int]] = {}
            for task in d["known_tasks"]:
                held = counts.setdefault(task, {})
                for k, n in d["token_counts" if by_word else "feature_counts"][task].items():
                    b = bucket_of(k, buckets) if by_word else int(k.removeprefix("bucket:"))
                    held[b] = held.get(b, 0) + _whole(n, 1)
            examples = {t: _whole(d["task_examples"][t], 1) for t in d["known_tasks"]}
            least = d.get("min_confidence" if by_word else "min_evidence_score", 0.55)
            for x in (least, d.get("min_margin", 0.10)):
                if isinstance(x, bool) or not isinstance(x, int | float):
                    raise PolicyError("thresholds must be numbers")
            return cls(examples, counts, _whole(d.get("min_examples", 2), 1), float(least), float(d.get("min_margin", 0.10)), bool(d.get("exact_tokens", True)), buckets)
        except (KeyError, TypeError, ValueError, AttributeError) as e:
            raise e if isinstance(e, PolicyError) else PolicyError(f"not a classifier: {e}") from None


def _whole(n: object, least: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < least:
        raise PolicyError(f"{n!r} must be a whole number of at least {least}")
    return n


def prompt_buckets(prompts: DataFrame, exact: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """(prompt_id, bucket, n): how often the tokens of a prompt fall into each bucket."""
    return _bucketed(prompts, exact, buckets).groupBy("prompt_id", "bucket").agg(F.sum("n").alias("n"))


def _bucketed(prompts: DataFrame, exact: bool, buckets: int) -> DataFrame:
    """(prompt_id, bucket, n) with a row for each token of a prompt, or several; to be added up."""
    return _counted(prompts, "prompt_id", exact).select("prompt_id", feature_bucket(F.col("token"), buckets).alias("bucket"), "n")


def _counted(rows: DataFrame, key: str, exact: bool) -> DataFrame:
    """(key, token, n) of prompts, in rows to be added up."""
    if exact:
        return count_exactly(rows, key, "prompt")
    each = rows.select(key, F.explode(runs(F.col("prompt"))).alias("run"))
    return each.select(key, F.lower("run").alias("token"), F.lit(1).cast("bigint").alias("n"))


def feature_counts(heads: DataFrame, exact: bool = True) -> DataFrame:
    """(task, bucket, n) over prompts with a task, each counted once."""
    each = _counted(heads.where("task is not null"), "task", exact).groupBy("task", "token").agg(F.sum("n").alias("n"))
    return each.groupBy("task", feature_bucket(F.col("token")).alias("bucket")).agg(F.sum("n").alias("n"))


def fit(heads: DataFrame, min_examples: int = 2, min_score: float = 0.55, min_margin: float = 0.10, exact: bool = True) -> TaskClassifier:
    """Counted on the cluster; what comes to the driver is bounded by tasks x BUCKETS."""
    examples = {r.task: r.n for r in heads.where("task is not null").groupBy("task").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_examples).collect()}
    counts: dict[str, dict[int, int]] = {t: {} for t in examples}
    if examples:
        for r in feature_counts(heads.where(F.col("task").isin(list(examples))), exact).collect():
            counts[r.task][r.bucket] = r.n
    return TaskClassifier(examples, counts, min_examples, min_score, min_margin, exact)


def classify(prompts: DataFrame, model: TaskClassifier, explicit: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(prompt_id, task, evidence_score, abstained, reason) of rows with prompt_id, prompt, task, and
    the columns to keep.

    A task that is given decides alone if explicit; else the classifier does. One join to the
    buckets, each with the logarithms for all tasks in an array, and one aggregation by prompt.
    """
    spark = prompts.sparkSession
    keep = keep or []
    p = prompts.select("prompt_id", F.col("prompt"), (F.col("task") if explicit else F.lit(None).cast("string")).alias("given"), *keep)
    found = (has_tokens_exactly if model.exact else has_tokens)(F.col("prompt"))
    k = len(model.tasks)
    space = sorted({b for c in model.counts.values() for b in c})
    out = F.struct
    unknown = F.lit(UNKNOWN)

    def result(task, score, abstained, reason):
        return out(task.alias("task"), score.cast("double").alias("evidence_score"), F.lit(abstained).alias("abstained"), reason.alias("reason"))

    known = F.col("given").isin(list(model.tasks)) if k else F.lit(False)
    ladder = F.when(F.col("given").isNotNull() & known, result(F.col("given"), F.lit(1.0), False, F.lit("explicit known task")))
    ladder = ladder.when(F.col("given").isNotNull(), result(unknown, F.lit(0.0), True, F.format_string("explicit task '%s' is unknown", "given")))
    if not k:
        ladder = ladder.otherwise(result(unknown, F.lit(0.0), True, F.lit("no supported tasks in training data")))
        return p.select("prompt_id", *keep, ladder.alias("r")).select("prompt_id", *keep, "r.*")
    p = p.withColumn("has_tokens", found)
    ladder = ladder.when(~F.col("has_tokens"), result(unknown, F.lit(0.0), True, F.lit("prompt has no classifiable tokens")))
    if not space:
        ladder = ladder.otherwise(result(unknown, F.lit(0.0), True, F.lit("classifier feature space is empty")))
        return p.select("prompt_id", *keep, ladder.alias("r")).select("prompt_id", *keep, "r.*")

    denominators = [sum(model.counts[t].values()) + len(space) for t in model.tasks]
    priors = [log(model.examples[t] / sum(model.examples.values())) for t in model.tasks]
    table = spark.createDataFrame([(b, [log((model.counts[t].get(b, 0) + 1) / d) for t, d in zip(model.tasks, denominators, strict=True)]) for b in space], "bucket int, logs array<double>")
    unseen = F.array(*[F.lit(log(1 / d)) for d in denominators])
    # at most BUCKETS rows, whatever the corpus, each as wide as there are tasks: where that is small, tokens
    # meet it where they are read, and a task's sums of a prompt are all that is shuffled
    asked, logs_of = p.where("given is null").select("prompt_id", "prompt"), small_rows(table, len(space), k)
    fits = is_small(len(space), k)
    hit = (_bucketed(asked, model.exact, model.buckets) if fits else prompt_buckets(asked, model.exact, model.buckets)).join(logs_of, "bucket", "left")
    logs = F.coalesce("logs", unseen)
    sums = hit.groupBy("prompt_id").agg(F.count("logs").alias("overlap"), *[F.sum(F.col("n") * logs[i]).alias(f"s{i}") for i in range(k)])
    scores = F.array(*[F.struct((-(F.col(f"s{i}") + F.lit(priors[i]))).alias("minus"), F.lit(t).alias("task")) for i, t in enumerate(model.tasks)])
    s = sums.select("prompt_id", "overlap", F.array_sort(scores).alias("ranked"))
    top = F.col("ranked")[0]
    weight = F.transform("ranked", lambda x: F.exp(top["minus"] - x["minus"]))
    s = s.select("prompt_id", "overlap", top["task"].alias("winner"), weight.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    s = s.select("prompt_id", "overlap", "winner", (F.col("w")[0] / total).alias("score"), (F.coalesce(F.try_element_at("w", F.lit(2)), F.lit(0.0)) / total).alias("second"))
    p = p.join(s, "prompt_id", "left")
    margin = F.col("score") - F.col("second")
    ladder = ladder.when(F.coalesce(F.col("overlap"), F.lit(0)) == 0, result(unknown, F.lit(0.0), True, F.lit("prompt has no known hashed evidence")))
    ladder = ladder.when(F.col("score") < model.min_score, result(unknown, F.col("score"), True, F.format_string("evidence score %.3f is below %.3f", F.col("score"), F.lit(model.min_score))))
    ladder = ladder.when(margin < model.min_margin, result(unknown, F.col("score"), True, F.format_string("evidence margin %.3f is below %.3f", margin, F.lit(model.min_margin))))
    ladder = ladder.otherwise(result(F.col("winner"), F.col("score"), False, F.lit("hashed-feature evidence exceeded thresholds")))
    return p.select("prompt_id", *keep, ladder.alias("r")).select("prompt_id", *keep, "r.*")
