"""Writers: matrices by Spark, small documents by the driver, whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrixloom.operators.route import Policy
from matrixloom.operators.validate import validate
from matrixloom.schema import MAX_FILE_BYTES


def jsonl_rows(obs: DataFrame) -> DataFrame:
    """(prompt_id, model, value): each observation as JSON with sorted keys, absent fields and a
    zero load left out."""
    meta = F.try_parse_json("metadata") if "metadata" in obs.columns else F.lit(None).cast("variant")
    load = F.when(F.col("load_ms") != 0, F.col("load_ms")).alias("load_ms")
    one = F.struct("cost_usd", "latency_ms", load, meta.alias("metadata"), "model", "prompt", "prompt_id", "quality", "sequence_index", "task", "trace_id")
    return obs.select("prompt_id", "model", F.to_json(one).alias("value"))


#: Bytes of a file that dump_jsonl writes, about; none is larger than what the reader takes.
PART_BYTES = 16 << 20


def dump_jsonl(obs: DataFrame, path: str, check: bool = True, part_bytes: int = PART_BYTES, max_bytes: int = MAX_FILE_BYTES) -> str:
    """A folder of JSON lines in canonical order; checked again first. As many files as keep each
    within the limit of the format, which the strict reader holds against every one of them."""
    rows = jsonl_rows(validate(obs) if check else obs)
    octets = F.octet_length("value") + 1
    total, longest = rows.agg(F.sum(octets), F.max(octets)).first()
    parts, most = max(1, -(-(total or 0) // part_bytes)), max(1, max_bytes // (longest or 1))
    rows.repartitionByRange(parts, "prompt_id", "model").sortWithinPartitions("prompt_id", "model").select("value").write.mode("overwrite").option("maxRecordsPerFile", most).text(path)
    return path


def append_trials(trials: DataFrame, path: str) -> None:
    """Rows added to the sidecar of a run; load_trials and last_write read it back. Each row carries
    when its append began and its number in it, so the order holds over all files."""
    own = [c for c in trials.columns if c not in ("line_no", "place", "written_at", "row")]
    stamped = trials.select(*own, F.lit(time.time_ns()).alias("written_at"), F.monotonically_increasing_id().alias("row"))
    stamped.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


@contextmanager
def single_writer(path: str | Path) -> Iterator[None]:
    """Refuse to go on while another live process writes to the same output; a lock that a killed
    one left behind is taken over."""
    lock = Path(f"{path}.lock")
    while True:
        try:
            fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            text = lock.read_text("utf-8").strip() if lock.exists() else ""
            owner = int(text) if text.isdigit() else 0
            if owner and owner != os.getpid() and Path(f"/proc/{owner}").exists():
                raise ConcurrentRunError(f"process {owner} is writing to {path}") from None
            lock.unlink(missing_ok=True)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(str(os.getpid()))
        yield
    finally:
        lock.unlink(missing_ok=True)


class ConcurrentRunError(RuntimeError):
    """Two runs at a time would spoil each other's timings."""


def write_text(path: str | Path, text: str) -> Path:
    """Write through a temporary file in the same folder, synced and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, target)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    return target


def dump_json(value: object, path: str | Path, sort: bool = True) -> Path:
    return write_text(path, json.dumps(value, indent=2, sort_keys=sort, ensure_ascii=False, allow_nan=False) + "\n")


def dump_policy(policy: Policy, path: str | Path) -> Path:
    return dump_json(policy.to_dict(), path)
