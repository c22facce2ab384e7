"""What the corpus operators share: column selection that survives name clashes, tables
written to the shared folder, distributed ranks, and vectorised text primitives.

Text is handled as the UTF-8 bytes of Arrow buffers: a batch is cut into runs of whole
documents, and words, units and shingles are hashed with prefix sums, without a Python
object per word.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A side is broadcast only after it was measured and has no more rows and bytes, as JSON, than this.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 << 20
CHUNK_BYTES = 1 << 19

_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int", "vec_id": "bigint", "embedding": "array<float>"}


def project(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The named columns alone, cast to their usual types.

    An exact match is preferred to one that differs in case, the first of equal names to
    the others, so that further columns never clash; a column that is missing is null.
    """
    have = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(have))])
    out = []
    for alias, name in [*((n, n) for n in names), *renamed.items()]:
        at = next((i for i, c in enumerate(have) if c == name), next((i for i, c in enumerate(have) if c.lower() == name.lower()), None))
        kind = _TYPES.get(name)
        col = F.lit(None) if at is None else F.col(f"c{at}")
        out.append((col.cast(kind) if kind else col).alias(alias))
    return plain.select(*out)


def with_columns_apart(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The table under positional names c0, c1, ... and its own names, for putting back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns


def position(df: DataFrame, name: str) -> int | None:
    have = df.columns
    return next((i for i, c in enumerate(have) if c == name), next((i for i, c in enumerate(have) if c.lower() == name.lower()), None))


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that was set as the context's
    checkpoint folder; a temporary one only where there is none and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = set_.get()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="loom-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return "file://" + _OWN["dir"]


_WRITTEN: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession) -> str:
    """A path for a table of our own, deleted by drop_cut, or at the end of the driver as no result
    that reads it lives longer."""
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete_all)
    _WRITTEN[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
    _WRITTEN.pop(path, None)


def _delete_all() -> None:
    for path, spark in list(_WRITTEN.items()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, the JVM may be gone
            return


def cut(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it again: ends the lineage, survives the
    loss of executors, and fixes the value of anything nondeterministic."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        for folder in {f for f in (p.rsplit("/", 1)[0] for p in df.inputFiles()) if "/t-" in f}:
            _delete(df.sparkSession, next((p for p in _WRITTEN if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]), folder))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a table measured to be small; beyond that the table as it is."""
    n, octets = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and octets <= size else df


def arrow_batches(spark: SparkSession) -> None:
    """Keep a batch sent to Python within a few MB, unless the session has set its own."""
    for name, default, value in (("maxRecordsPerBatch", ("10000",), "2000"), ("maxBytesPerBatch", ("67108864b", "67108864", "64MB", "-1"), str(8 << 20))):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name) in default:
            spark.conf.set(name, value)


def hash52(*cols: Column) -> Column:
    """52 bits of the MD5 of the columns joined by '|', nulls as '': equal in any SQL engine."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("bigint")


def null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join in which null equals null; the key columns come from the left."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = None
    for c in on:
        one = left[c].eqNullSafe(right[f"__r_{c}"])
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def ranked(df: DataFrame, group: str | None, order: list[str], rank: str, total: str) -> DataFrame:
    """Rank 1, 2, ... of each row within its group and the group's size, without one task that
    sees a whole group: sort by range over the cluster, number the rows of each partition, and
    add the sizes of the partitions before.

    The sorted table is written before it is counted, so that ranges never change in between.
    """
    # equal rows are told apart, as they may be many
    df = df.withColumn("__salt", F.monotonically_increasing_id())
    keys = [*([group] if group else []), *order, "__salt"]
    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).drop("__salt")
    table = cut(ranged.withColumn("__at", F.monotonically_increasing_id()))
    by = [F.shiftright("__at", 33).alias("__part"), *([F.col(group).alias("__g")] if group else [])]
    parts = table.groupBy(*by).agg(F.min("__at").alias("__low"), F.count(F.lit(1)).alias("__n"))
    all_of = Window.partitionBy(*(["__g"] if group else [F.lit(0)]))
    before = all_of.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select(*parts.columns, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(all_of).alias(total)))
    cond = F.shiftright(table["__at"], 33) == parts["__part"]
    if group:
        cond = cond & table[group].eqNullSafe(parts["__g"])
    out = table.join(small(parts), cond).withColumn(rank, F.col("__before") + F.col("__at") - F.col("__low") + 1)
    return out.select(*ranged.columns, rank, total)


# --- vectorised text primitives -------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[:33] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE2 = np.uint64(0xD6E8FEB86659FD93 | 1)
#: malloc_trim where the C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        got = (both[0], both[1])
        if size <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = got
    return got


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of each values[start:end], from one pass of prefix sums modulo 2**64."""
    n = len(values)
    up, down = _powers(base, n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def give_back() -> None:
    """Return freed memory to the system, which a worker that waits for its next task would keep."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about limit bytes: (first, last, bytes, offsets). A longer
    document is a run of its own; null is as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and document of each run of non-space bytes."""
    inside = ~_SPACE[data]
    n = len(data)
    edge = offsets[:-1][offsets[:-1] < n]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = words(data, offsets)
    return span_hash(data, starts, ends), starts, ends, doc


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def complete_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by key, a few thousand rows each or more."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        first = int(np.searchsorted(keys, keys[-1], "left"))
        if first:
            yield table.slice(0, first)
            rest = table.slice(first).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
            rows = max(20_000, 2 * count)
        else:
            rows = 2 * count
    if held:
        yield pa.Table.from_batches(held)


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
