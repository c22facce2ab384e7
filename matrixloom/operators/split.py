"""Train, development and test parts by hash, whole traces where traces are complete."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrixloom.functions.hashing import framed, ordered_runs, stable_split, unit_hash
from matrixloom.schema import NAMESPACE

PARTS = ("train", "dev", "test")


@dataclass(frozen=True)
class Split:
    """parts: (unit, part); unit is 'trace' or 'prompt'. obs carries a part for each row; held has parts
    that are kept by themselves."""

    obs: DataFrame
    parts: DataFrame
    unit: str
    seed: int
    held: dict[str, DataFrame] = field(default_factory=dict)

    def of(self, part: str) -> DataFrame:
        if part in self.held:
            return self.held[part]
        return self.obs.where(F.col("part") == part).drop("part")


def repairs(ranked: dict[str, list[str]], counts: dict[str, int], minimum: dict[str, int]) -> dict[str, str]:
    """Units to move so that each part has its minimum. ranked: the units of lowest hash of each
    part, enough of them. The largest part above its minimum gives, ties to the last name."""
    counts, moved = dict(counts), {}
    ranked = {p: list(u) for p, u in ranked.items()}
    for target in PARTS:
        while counts[target] < minimum[target]:
            donor = max((p for p in PARTS if counts[p] > minimum[p]), key=lambda p: (counts[p], p))
            unit = ranked[donor].pop(0)
            moved[unit] = target
            counts[donor] -= 1
            counts[target] += 1
    return moved


def part_of(units: DataFrame, seed: int, by_trace: bool, train: float = 0.6, dev: float = 0.2, namespace: str = NAMESPACE) -> Column:
    """The part of a row by its unit, for distinct units. Parts left too small are repaired with a few
    moves that are worked out from counts and a handful of ranked units."""
    u = units.select("unit", stable_split(F.col("unit"), seed, train, dev, namespace).alias("part"), unit_hash(F.col("unit"), seed, namespace).alias("h"))
    counts = dict.fromkeys(PARTS, 0) | {r.part: r.n for r in u.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    part = stable_split(F.col("unit"), seed, train, dev, namespace)
    if total < 3:
        return part
    minimum = {"train": 1, "dev": 1, "test": 3 if by_trace and total >= 5 else 1}
    if all(counts[p] >= minimum[p] for p in PARTS):
        return part
    w = Window.partitionBy("part").orderBy("h", "unit")
    few = u.withColumn("rn", F.row_number().over(w)).where("rn <= 5").orderBy("part", "rn").collect()
    moved = repairs({p: [r.unit for r in few if r.part == p] for p in PARTS}, counts, minimum)
    for unit, target in moved.items():
        part = F.when(F.col("unit") == unit, target).otherwise(part)
    return part


def assign_parts(units: DataFrame, seed: int, by_trace: bool, train: float = 0.6, dev: float = 0.2, namespace: str = NAMESPACE) -> DataFrame:
    """(unit, part) of distinct units."""
    return units.select("unit", part_of(units, seed, by_trace, train, dev, namespace).alias("part"))


def split_observations(obs: DataFrame, seed: int = 42, trace_complete: bool = False, train: float = 0.6, dev: float = 0.2, namespace: str = NAMESPACE) -> Split:
    unit = "trace" if trace_complete else "prompt"
    key = "trace_id" if trace_complete else "prompt_id"
    units = obs.select(F.col(key).alias("unit")).distinct()
    part = part_of(units, seed, trace_complete, train, dev, namespace)
    # a part follows from its unit alone, so no row has to meet a table of units
    tagged = obs.where(F.col(key).isNotNull()).withColumn("unit", F.col(key)).withColumn("part", part).select(*obs.columns, "part")
    return Split(tagged, units.select("unit", part.alias("part")), unit, seed)


def assignment_digests(split: Split, namespace: str = NAMESPACE) -> DataFrame:
    """(unit, part, n, digest) of the prompts of each part, and of its traces. The ids pass the driver
    in order, a partition at a time."""
    out = []
    kinds = [("prompt", "prompt_id")] + ([("trace", "trace_id")] if split.unit == "trace" else [])
    for unit, key in kinds:
        ids = split.obs.select("part", F.col(key).alias("ident")).where("ident is not null").distinct()
        digests: dict = {}
        for r in ordered_runs(ids.select("part", "ident", framed(F.col("ident")).alias("piece"))):
            name = {"dev": "development"}.get(r.part, r.part)
            n, h = digests.get(r.part) or (0, sha256(f"{namespace}:split:v2:{unit}:{split.seed}:{name}\0".encode()))
            h.update(r.run)
            digests[r.part] = (n + r.n, h)
        out += [(unit, p, n, "sha256:" + h.hexdigest()) for p, (n, h) in digests.items()]
    return split.obs.sparkSession.createDataFrame(out, "unit string, part string, n int, digest string")
