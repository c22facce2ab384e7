"""Repeated passages by a distributed suffix array (difference cover modulo 3, Kärkkäinen and
Sanders 2003).

The corpus is one string of word hashes. Level by level the suffixes that start at places 1 and 2
modulo 3 are named by the rank of their first three symbols (a range sort over the cluster), the
string of names is ordered by recursion, and the remaining suffixes are merged in by comparing
at most two symbols and a rank. A string of one block is ordered in one task. In the
finished order, neighbours whose first LEAST words agree form a run; its earliest place stays
and the others are reported as removable.

Blocks send each triple to be named once, however often it occurs in them. The merge is cut into
slices at sampled suffixes whose ranks are known, and no two suffixes are equal, so slices are even
even where most of the corpus is one passage; runs that cross from slice to slice are joined at the
end by the hash of their LEAST words.

Symbols travel in arrays, a block of the string or a slice of a sort a row, so Spark moves
thousands of rows where the string has millions of symbols.

What can't repeat is left out before: of equal texts one is sorted and the others are reported
whole; and each window of LEAST words is represented by the least hash among its runs of GRAM
words. A window that occurs twice has an equal representative, so windows whose representative
is unique in the corpus are not part of a repeat, and only stretches of the others enter the
string. This loses no repeat of LEAST words.

Words are runs of non-space bytes, ASCII and Latin-1 letters lower-cased.

Cases: null and empty texts and texts of fewer words have no findings. A null id ranks last.
Rows that repeat id and text are one document. Repeats within a document count. Passages of equal
text stay in the document of lowest id, at their first place. Texts are read whole; a very long one
is cut into blocks like the corpus. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, chunks, cut, drop_cut, new_folder, project, small, span_hash, word_hashes
from .linededup import fold

LEAST = 50
GRAM = 12
BLOCK = 1 << 19
LOCAL = BLOCK
#: Symbols in a slice of a sort.
SLICE = 1 << 19
SAMPLE = 40_000
SCHEMA = "doc_id bigint, start_char bigint, end_char bigint, like_doc_id bigint"
_U = np.uint64
Blobs = Iterator[pa.RecordBatch]


def _rows(key: list[int], data: list[bytes], name: str = "key") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(data, pa.binary())], names=[name, "data"])


def _release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that were read for the last time, and let go of old shuffle files."""
    for t in tables:
        drop_cut(t)
    gc.collect()
    spark._jvm.System.gc()


def _by_key(df: DataFrame, keys: int, tasks: int, fn: Callable[[int, dict[str, list]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn once for each key below keys, with all rows of the key as lists by column. Tasks have
    equally many keys."""

    def run(batches: Blobs) -> Blobs:
        held: dict[str, list] = {}
        now = None
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i, k in enumerate(cols["key"]):
                if k != now:
                    if now is not None:
                        yield from fn(now, held)
                    now, held = k, {n: [] for n in cols}
                for n, v in cols.items():
                    held[n].append(v[i])
        if now is not None:
            yield from fn(now, held)

    tasks = max(1, min(keys, tasks))
    return df.repartitionById(tasks, (F.col("key") % tasks).cast("int")).sortWithinPartitions("key").mapInArrow(run, schema)


# --- one level ----------------------------------------------------------------------------------


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Indices that sort rows by the first key, then by the others. Only ties of the first key, by
    which NumPy sorts with vector instructions, are sorted by the rest."""
    order = np.argsort(keys[0])
    if len(keys) == 1 or not len(order):
        return order
    first = keys[0][order]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = first[1:] != first[:-1]
    tied = np.flatnonzero(~(new[:-1] & new[1:]))
    if len(tied):
        run = np.cumsum(new[:-1])[tied]
        among = order[tied]
        order[tied] = among[np.lexsort((*(k[among] for k in reversed(keys[1:])), run))]
    return order


def _edges(cols: list[np.ndarray], splitters: list[tuple]) -> np.ndarray:
    """Where each splitter falls in columns sorted as rows."""
    out = []
    for s in splitters:
        lo, hi = 0, len(cols[0])
        for c, v in zip(cols, s, strict=True):
            lo, hi = lo + np.searchsorted(c[lo:hi], _U(v), "left"), lo + np.searchsorted(c[lo:hi], _U(v), "right")
            if lo == hi:
                break
        out.append(lo)
    return np.array([0, *out, len(cols[0])], np.int64)


def _splitters(string: DataFrame, n: int, blocks: int, slice_: int) -> list[tuple]:
    """Triples that divide a sorted sample evenly; few, whatever the size of the string."""
    parts = max(1, -(-n // slice_))
    each = max(8, SAMPLE // blocks)

    def run(batches: Blobs) -> Blobs:
        for b in batches:
            for data in b.column("data").to_pylist():
                v = np.frombuffer(data, _U)
                at = np.unique(np.linspace(0, len(v) - 3, each).astype(np.int64))
                yield _rows([0], [np.stack([v[at], v[at + 1], v[at + 2]], 1).tobytes()])

    if parts == 1:
        return []
    got = [r.data for r in string.select("data").mapInArrow(run, "key bigint, data binary").collect()]
    s = np.frombuffer(b"".join(map(bytes, got)), _U).reshape(-1, 3)
    s = s[np.lexsort((s[:, 2], s[:, 1], s[:, 0]))]
    cuts = np.unique(s[np.linspace(0, len(s), parts + 1).astype(np.int64)[1:-1]], axis=0)
    return [tuple(map(int, r)) for r in cuts]


def _to_blocks(pos: np.ndarray, value: np.ndarray, block: int) -> Blobs:
    """Pairs (place, value) sent to their blocks."""
    if not len(pos):
        return
    order = np.argsort(pos)
    pos, value = pos[order], value[order]
    b = pos // block
    heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for s, e in zip(heads, [*heads[1:], len(b)], strict=True):
        yield _rows([int(b[s])], [np.stack([pos[s:e].astype(_U), value[s:e]], 1).tobytes()])


def _place(blobs: list[bytes], key: int, block: int) -> np.ndarray:
    """The values of a block from pairs of place and value."""
    v = np.zeros(block, _U)
    for blob in blobs:
        p = np.frombuffer(blob, _U).reshape(-1, 2)
        v[(p[:, 0] - _U(key * block)).astype(np.int64)] = p[:, 1]
    return v


def _stretch(first: int, values: np.ndarray, block: int) -> Blobs:
    """Values from a place on as (key, at, data), cut at blocks, with two of a block to the one before."""
    last = first + len(values)
    for k in range(max(0, (first - 2) // block), (last - 1) // block + 1 if len(values) else 0):
        low, high = max(first, k * block), min(last, (k + 1) * block + 2)
        if low < high:
            yield _rows([k], [values[low - first : high - first].tobytes()]).add_column(1, "at", pa.array([low], pa.int64()))


def _string(stretches: DataFrame, n: int, block: int, tasks: int) -> DataFrame:
    """(key, data): blocks with two symbols of the next one."""

    def fn(key: int, rows: dict[str, list]) -> Blobs:
        size = min(block, n - key * block)
        v = np.zeros(block + 2, _U)
        for at, data in zip(rows["at"], rows["data"], strict=True):
            i = at - key * block
            v[i : i + len(data) // 8] = np.frombuffer(data, _U)
        yield _rows([key], [v[: size + 2].tobytes()])

    return _by_key(stretches, -(-n // block), tasks, fn, "key bigint, data binary")


def _triples(v: np.ndarray, key: int, block: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Sampled places of a block, from its start and in the string, its distinct triples in order,
    and which of them each place has."""
    pos = key * block + np.arange(len(v) - 2)
    at = np.flatnonzero(pos % 3 != 0)
    t = [v[at], v[at + 1], v[at + 2]]
    order = ordered(*t)
    t = [x[order] for x in t]
    new = np.ones(len(at), bool)
    new[1:] = (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1]) | (t[2][1:] != t[2][:-1])
    which = np.empty(len(at), np.int64)
    which[order] = np.cumsum(new) - 1
    return at, pos[at], [x[new] for x in t], which


def _names(string: DataFrame, block: int, tasks: int, splitters: list[tuple]) -> DataFrame:
    """(key, part, data, distinct): names of the distinct triples of each block by slice, and on one
    row of a slice how many names it gave."""

    def send(batches: Blobs) -> Blobs:
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                *_, cols, _ = _triples(np.frombuffer(data, _U), key, block)
                e = _edges(cols, splitters)
                for p in np.flatnonzero(np.diff(e)).tolist():
                    yield _rows([p], [np.stack([c[e[p] : e[p + 1]] for c in cols]).tobytes()]).add_column(1, "block", pa.array([key], pa.int64()))

    def name(p: int, rows: dict[str, list]) -> Blobs:
        each = [np.frombuffer(x, _U).reshape(3, -1) for x in rows["data"]]
        t0, t1, t2 = np.concatenate(each, axis=1)
        order = ordered(t0, t1, t2)
        t0, t1, t2 = t0[order], t1[order], t2[order]
        new = np.ones(len(order), bool)
        new[1:] = (t0[1:] != t0[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
        names = np.empty(len(order), _U)
        names[order] = (_U(p) << _U(40)) + np.cumsum(new).astype(_U)
        distinct, at = int(new.sum()), 0
        for b, x in zip(rows["block"], each, strict=True):
            n = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([p], pa.int64()), pa.array([names[at : at + n].tobytes()], pa.binary()), pa.array([distinct], pa.int64())], names=["key", "part", "data", "distinct"])
            at, distinct = at + n, 0

    sent = string.select("key", "data").mapInArrow(send, "key bigint, block bigint, data binary")
    return _by_key(sent, len(splitters) + 1, tasks, name, "key bigint, part bigint, data binary, distinct bigint")


def _named(string: DataFrame, names: DataFrame, n: int, block: int, tasks: int) -> DataFrame:
    """The string of names: those of places 1 modulo 3, then of places 2."""
    n1 = (n + 1) // 3

    def fn(key: int, rows: dict[str, list]) -> Blobs:
        own = next(d for p, d in zip(rows["part"], rows["data"], strict=True) if p is None)
        _, pos, _, which = _triples(np.frombuffer(own, _U), key, block)
        parts = sorted((p, d) for p, d in zip(rows["part"], rows["data"], strict=True) if p is not None)
        value = np.concatenate([np.frombuffer(d, _U) for _, d in parts])[which] if parts else np.zeros(0, _U)
        for kind in (1, 2):
            mine = pos % 3 == kind
            if mine.any():
                yield from _stretch(int(pos[mine][0]) // 3 + (n1 if kind == 2 else 0), value[mine], block)

    both = names.select("key", "part", "data").unionByName(string.select("key", F.lit(None).cast("bigint").alias("part"), "data"))
    stretches = _by_key(both, -(-n // block), tasks, fn, "key bigint, at bigint, data binary")
    return _string(stretches, n1 + n // 3, block, tasks)


def doubled(v: np.ndarray) -> np.ndarray:
    """Ranks 1, 2, ... of all suffixes by prefix doubling; only ties are sorted again."""
    n = len(v)
    order = np.argsort(v, kind="stable")
    new = np.ones(n, bool)
    new[1:] = v[order][1:] != v[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    k = 1
    while True:
        edge = np.append(new, True)
        tied = np.flatnonzero(~(edge[:-1] & edge[1:]))
        if not len(tied):
            return (rank + 1).astype(_U)
        at = order[tied]
        follow = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        o = np.lexsort((follow, rank[at]))
        a, f = at[o], follow[o]
        r = rank[a]
        order[tied] = a
        fresh = np.ones(len(a), bool)
        fresh[1:] = (r[1:] != r[:-1]) | (f[1:] != f[:-1])
        new[tied] = fresh
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
        rank[a] = tied[first]
        k *= 2


def _local(string: DataFrame, n: int, block: int) -> DataFrame:
    def run(batches: Blobs) -> Blobs:
        v = np.zeros(n, _U)
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(data, _U)[:-2]
                v[key * block : key * block + len(x)] = x
        rank = doubled(v)
        for key in range(-(-n // block)):
            yield _rows([key], [rank[key * block : (key + 1) * block].tobytes()])

    return string.select("key", "data").coalesce(1).mapInArrow(run, "key bigint, data binary")


def merged(zero: dict[str, np.ndarray], some: dict[str, np.ndarray]) -> np.ndarray:
    """Places of all suffixes of a slice in order: class 0 merged into the sampled ones, with those
    of class 1 by the first symbol and the rank of the rest, with those of class 2 by two symbols
    and a rank."""
    order = np.argsort(some["own"])
    some = {k: v[order] for k, v in some.items()}
    order = ordered(zero["t0"], zero["ra"])
    zero = {k: v[order] for k, v in zero.items()}
    m, n = len(zero["pos"]), len(some["pos"])
    before = np.zeros(m, np.int64)  # sampled suffixes before each of class 0
    for mine, keys in ((some["one"], ("t0", "ra")), (~some["one"], ("t0", "t1", "rb"))):
        both = ordered(*(np.concatenate([zero[k], some[k][mine]]) for k in keys))
        is_zero = both < m
        before[both[is_zero]] += np.cumsum(~is_zero)[is_zero]
    out = np.empty(m + n, np.int64)
    out[before + np.arange(m)] = zero["pos"]
    out[np.arange(n) + np.searchsorted(before, np.arange(n), "right")] = some["pos"]
    return out


def _rank_splitters(string: DataFrame, ranks: DataFrame, n: int, block: int, slice_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, first symbol and rank of the rest of sampled suffixes that divide the order evenly."""
    n1, parts = (n + 1) // 3, max(1, -(-n // slice_))
    if parts == 1:
        return (np.zeros(0, _U),) * 3
    js = np.unique(np.linspace(0, min(n1, n // 3) - 1, SAMPLE).astype(np.int64))

    def pick(wanted: list[tuple[int, np.ndarray]], halo: int):
        def run(batches: Blobs) -> Blobs:
            for b in batches:
                for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                    v = np.frombuffer(data, _U)
                    for kind, places in wanted:
                        lo, hi = np.searchsorted(places, [key * block, key * block + len(v) - halo])
                        if lo < hi:
                            yield _rows([kind], [v[places[lo:hi] - key * block].tobytes()]).add_column(1, "at", pa.array([lo], pa.int64()))

        return run

    schema = "key bigint, at bigint, data binary"
    some = ranks.select("key", "data").mapInArrow(pick([(0, js), (1, js + n1)], 0), schema).unionByName(string.select("key", "data").mapInArrow(pick([(2, 3 * js + 1)], 2), schema))
    got = np.zeros((3, len(js)), _U)
    for r in some.collect():  # SAMPLE numbers three times
        x = np.frombuffer(bytes(r.data), _U)
        got[r.key, r.at : r.at + len(x)] = x
    own, after, first = got
    cuts = np.unique(np.argsort(own)[np.linspace(0, len(js), parts + 1).astype(np.int64)[1:-1]])
    cuts = cuts[np.argsort(own[cuts])]
    return own[cuts], first[cuts], after[cuts]


def slices_of(kind: np.ndarray, own: np.ndarray, first: np.ndarray, after: np.ndarray, splitters: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How many splitters precede each suffix. Those of class 0 have no rank of their own and are
    compared by their first symbol and the rank of the rest."""
    s_own, s_first, s_after = splitters
    out = np.searchsorted(s_own, own, "right")
    zero = np.flatnonzero(kind == 0)
    lo, hi = np.searchsorted(s_first, first[zero], "left"), np.searchsorted(s_first, first[zero], "right")
    x = after[zero]
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) // 2, max(0, len(s_after) - 1))
        less = open_ & (s_after[mid] < x)
        lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    out[zero] = lo
    return out


ORDERED = "kind int, key bigint, low bigint, data binary"


def _merge(string: DataFrame, ranks: DataFrame, n: int, block: int, slice_: int, tasks: int, finish: Callable[[int, np.ndarray, np.ndarray | None], Blobs], more: bool) -> DataFrame:
    """All suffixes in order, slice by slice, given to finish. more: with the hashes of runs of
    LEAST words, which the first level carries along."""
    n1 = (n + 1) // 3
    splitters = _rank_splitters(string, ranks, n, block, slice_)

    def back(batches: Blobs) -> Blobs:
        """Ranks to the blocks that their suffixes begin in, or up to two symbols before."""
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data").to_pylist(), strict=True):
                r, base = np.frombuffer(data, _U), key * block
                split = min(max(n1 - base, 0), len(r))
                for kind, values, to in ((1, r[:split], base), (2, r[split:], base + split - n1)):
                    if len(values):
                        pos = 3 * (to + np.arange(len(values))) + kind
                        for k in range(max(0, (int(pos[0]) - 1) // block - 1), int(pos[-1]) // block + 1):
                            lo, hi = np.searchsorted(pos, [k * block, (k + 1) * block + 2])
                            if lo < hi:
                                yield _rows([k], [values[lo:hi].tobytes()]).add_column(1, "at", pa.array([int(pos[lo])], pa.int64()))

    def align(key: int, rows: dict[str, list]) -> Blobs:
        at = next(i for i, a in enumerate(rows["at"]) if a is None)
        v = np.frombuffer(rows["data"][at], _U)
        rank = np.zeros(len(v), _U)
        for first, data in zip(rows["at"], rows["data"], strict=True):
            if first is not None:
                i, x = first - key * block, np.frombuffer(data, _U)
                x = x[: -(-(len(v) - i) // 3)]
                rank[i : i + 3 * len(x) : 3] = x
        size = len(v) - 2
        pos = key * block + np.arange(size)
        kind = pos % 3
        p = slices_of(kind, rank[:-2], v[:-2], rank[1:-1], splitters)
        # few slices are sorted by their digits
        order = np.argsort(p.astype(np.uint16) if len(splitters[0]) < 1 << 16 else p, kind="stable")
        # of each class what its comparisons need
        cols = [v[:-2], v[1:-1], rank[1:-1], rank[2:], rank[:-2], pos.astype(_U), *([np.frombuffer(rows["grams"][at], _U)] if more else [])]
        cols, kind, p = [c[order] for c in cols], kind[order], p[order]
        head = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        for s, e in zip(head.tolist(), [*head[1:].tolist(), size], strict=True):
            three = [np.stack([cols[c][s:e][kind[s:e] == i] for c in use]) for i, use in enumerate(_USED if not more else [[*u, 6] for u in _USED])]
            yield pa.RecordBatch.from_arrays([pa.array([p[s]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in three)], names=["key", "c0", "c1", "c2"])

    def finished(p: int, rows: dict[str, list]) -> Blobs:
        zero, one, two = (np.concatenate([np.frombuffer(x, _U).reshape(len(_USED[i]) + more, -1) for x in rows[f"c{i}"]], axis=1) for i in range(3))
        z = dict(zip(("t0", "t1", "ra", "rb"), zero, strict=False))
        blank = np.zeros(one.shape[1], _U), np.zeros(two.shape[1], _U)
        s = {
            "t0": np.concatenate([one[0], two[0]]), "t1": np.concatenate([blank[0], two[1]]), "ra": np.concatenate([one[1], blank[1]]), "rb": np.concatenate([blank[0], two[2]]),
            "own": np.concatenate([one[2], two[3]]), "one": np.arange(one.shape[1] + two.shape[1]) < one.shape[1],
        }
        places = np.concatenate([zero[4], one[3], two[4]]).astype(np.int64)
        m = zero.shape[1]
        z["pos"], s["pos"] = np.arange(m), np.arange(m, len(places))
        at = merged(z, s)
        yield from finish(p, places[at], np.concatenate([zero[-1], one[-1], two[-1]])[at] if more else None)

    none = F.lit(None)
    rank_rows = ranks.select("key", "data").mapInArrow(back, "key bigint, at bigint, data binary").withColumn("grams", none.cast("binary"))
    own = string.select("key", none.cast("bigint").alias("at"), "data", "grams" if more else none.cast("binary").alias("grams"))
    sent = _by_key(own.unionByName(rank_rows), -(-n // block), tasks, align, "key bigint, c0 binary, c1 binary, c2 binary")
    return _by_key(sent, len(splitters[0]) + 1, tasks, finished, ORDERED)


#: Columns sent for classes 0, 1 and 2, out of t0, t1, rank+1, rank+2, own rank, place.
_USED = [[0, 1, 2, 3, 5], [0, 2, 4, 5], [0, 1, 3, 4, 5]]


def _ordered(kind: int, low: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), batch.column(0), pa.array([low], pa.int64()), batch.column(1)], names=["kind", "key", "low", "data"])


def _rank_out(block: int):
    def finish(p: int, pos: np.ndarray, _: object) -> Blobs:
        rank = (_U(p) << _U(40)) + np.arange(1, len(pos) + 1, dtype=_U)
        for batch in _to_blocks(pos, rank, block):
            yield _ordered(0, 0, batch)

    return finish


def order(string: DataFrame, n: int, block: int, local: int, slice_: int, tasks: int, finish: Callable | None = None) -> DataFrame:
    """(key, data): ranks of the suffixes in each block; or with finish, what it makes of the
    order. string: its blocks, symbols from 1, the last of them unique."""
    spark = string.sparkSession
    if n <= local and finish is None:
        return cut(_local(string, n, block))
    half = (n + 1) // 3 + n // 3
    names = cut(_names(string, block, tasks, _splitters(string, n, -(-n // block), slice_)))
    distinct = names.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    nxt = cut(_named(string, names, n, block, tasks))
    _release(spark, names)
    if distinct < half:
        ranks = order(nxt, half, block, local, slice_, tasks)
        _release(spark, nxt)
    else:  # the names are ranks
        def plain(batches: Blobs) -> Blobs:
            for b in batches:
                yield _rows(b.column("key").to_pylist(), [d[:-16] for d in b.column("data").to_pylist()])

        ranks = nxt.select("key", "data").mapInArrow(plain, "key bigint, data binary")
    if finish is not None:
        out = cut(_merge(string, ranks, n, block, slice_, tasks, finish, True))
    else:
        pairs = _merge(string, ranks, n, block, slice_, tasks, _rank_out(block), False)

        def flat(key: int, rows: dict[str, list]) -> Blobs:
            yield _rows([key], [_place(rows["data"], key, block)[: min(block, n - key * block)].tobytes()])

        out = cut(_by_key(pairs.select("key", "data"), -(-n // block), tasks, flat, "key bigint, data binary"))
    _release(spark, ranks if distinct < half else nxt)
    return out


# --- from documents to the string, and back -----------------------------------------------------


def representatives(w: np.ndarray, doc: np.ndarray, n_docs: int, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last window, and hash of each run of windows with one representative.
    Window i: the words from i to i + least of its document, i counted from the document."""
    n = len(w)
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    size = least - gram + 1
    z = np.zeros(0, np.int64)
    if n < least:
        return z, z, z, np.zeros(0, _U)
    h = span_hash(w, np.arange(n - gram + 1), np.arange(gram, n + 1))
    full = np.full(-(-len(h) // size) * size, np.iinfo(np.uint64).max, _U)
    full[: len(h)] = h
    rows = full.reshape(-1, size)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.flatnonzero((first + count)[doc] - np.arange(n) >= least)
    if not len(windows):
        return z, z, z, np.zeros(0, _U)
    low = np.minimum(right[windows], left[windows + size - 1])
    new = np.ones(len(windows), bool)
    new[1:] = (low[1:] != low[:-1]) | (windows[1:] != windows[:-1] + 1) | (doc[windows[1:]] != doc[windows[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(windows)) - 1
    # a representative that occurs twice in its own run repeats by itself, so its run is listed twice
    span = np.arange(size)
    early = (h[windows[head][:, None] + span] == low[head][:, None]).argmax(axis=1) + windows[head]
    late = windows[tail] + size - 1 - (h[windows[tail][:, None] + span[::-1]] == low[head][:, None]).argmax(axis=1)
    times = 1 + (late > early)
    head, tail = np.repeat(head, times), np.repeat(tail, times)
    d = doc[windows[head]]
    return d, windows[head] - first[d], windows[tail] - first[d], low[head]


def _representatives(least: int, gram: int):
    def run(batches: Blobs) -> Blobs:
        for b in batches:
            for at, end, data, offsets in chunks(b.column("text")):
                w, _, _, doc = word_hashes(fold(data), offsets)
                n = end - at
                d, a, z, h = representatives(w, doc, n, least, gram)
                words = np.bincount(doc, minlength=n)
                off = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(x)) for x in (a.astype(np.int32), z.astype(np.int32), h.view(np.int64))]
                keep = pa.array(words >= least)
                cols = [b.column(i).slice(at, n) for i in range(4)]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in [*cols, pa.array(words.astype(np.int32)), *lists]], names=["doc_id", "k1", "k2", "chars", "words", "a", "z", "h"])

    return run


def _cut_by_kind(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of kind 0 and of kind 1, written in one pass as tables of their own, of which each
    can be deleted when it was read for the last time."""
    spark = rows.sparkSession
    path = new_folder(spark)
    rows.write.partitionBy("kind").parquet(path)
    plain = rows.drop("kind").schema
    out = []
    for kind in (0, 1):
        # reading a folder that no row was written to is an error
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}")
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        out.append(spark.read.schema(plain).parquet(f"{path}/kind={kind}") if there else spark.createDataFrame([], plain))
    return out[0], out[1]


def _symbols(least: int, block: int):
    """Of each document the characters of its words, kind 0, and its symbols and hashes of runs
    of least words by the block they lie in, with two symbols to the block before, kind 1."""
    schema = pa.schema([("kind", pa.int32()), ("base", pa.int64()), ("key", pa.int64()), ("at", pa.int64()), *((c, pa.binary()) for c in ("data", "grams", "lo", "hi"))])

    def run(batches: Blobs) -> Blobs:
        for b in batches:
            stretches = b.column("stretches").to_pylist()
            base = b.column("base").to_pylist()
            for at, end, data, offsets in chunks(b.column("text")):
                w, s, e, doc = word_hashes(fold(data), offsets)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                first = np.searchsorted(doc, np.arange(end - at))
                rows: list[tuple] = []
                for r in range(end - at):
                    zero = chars[offsets[r]]
                    sym, gram, lo, hi = [], [], [], []
                    here = pos = base[at + r]
                    for x in stretches[at + r]:
                        i, j = first[r] + x["a"], first[r] + x["z"]
                        m = int(j - i)
                        sym += [(w[i:j] >> _U(1)) + _U(1), np.array([(1 << 63) + 1 + pos + m], _U)]
                        g = np.zeros(m + 1, _U)
                        if m >= least:
                            g[: m - least + 1] = span_hash(w[i:j], np.arange(m - least + 1), np.arange(least, m + 1)) | _U(1)
                        gram.append(g)
                        lo += [chars[s[i:j]] - zero, [0]]
                        hi += [chars[e[i:j]] - zero, [0]]
                        pos += m + 1
                    rows.append((0, here, None, None, None, None, np.concatenate(lo).astype(np.int32).tobytes(), np.concatenate(hi).astype(np.int32).tobytes()))
                    v, g = np.concatenate(sym), np.concatenate(gram)
                    for k in range(max(0, (here - 2) // block), (here + len(v) - 1) // block + 1):
                        low, high = max(here, k * block), min(here + len(v), (k + 1) * block + 2)
                        if low < high:
                            rows.append((1, here, k, low, v[low - here : high - here].tobytes(), g[low - here : high - here].tobytes(), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _assemble(n: int, block: int):
    def fn(key: int, rows: dict[str, list]) -> Blobs:
        size = min(block, n - key * block)
        v, g = np.zeros(block + 2, _U), np.zeros(block + 2, _U)
        for at, s, x in zip(rows["at"], rows["data"], rows["grams"], strict=True):
            i = at - key * block
            v[i : i + len(s) // 8] = np.frombuffer(s, _U)
            g[i : i + len(x) // 8] = np.frombuffer(x, _U)
        yield _rows([key], [v[: size + 2].tobytes()]).append_column("grams", pa.array([g[:size].tobytes()], pa.binary()))

    return fn


def _runs(block: int):
    """Of neighbours with equal prefixes the earliest stays: (place, earliest) of the others, kind 0.
    Runs at the ends of a slice may go on in the next: their places, kind 1, by their hash."""

    def finish(p: int, pos: np.ndarray, grams: np.ndarray) -> Blobs:
        new = np.ones(len(pos), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (grams[1:] == 0)
        head = np.append(np.flatnonzero(new), len(pos))
        for i in {0, len(head) - 2}:
            run = pos[head[i] : head[i + 1]]
            if grams[head[i]]:
                yield _ordered(1, int(run.min()), _rows([int(grams[head[i] : head[i] + 1].view(np.int64)[0])], [run.tobytes()]))
        pos, head = pos[head[1] : head[-2]], head[1:-1] - head[1]
        if len(pos):
            first = np.repeat(np.minimum.reduceat(pos, head[:-1]), np.diff(head))
            gone = first != pos
            for batch in _to_blocks(pos[gone], first[gone].astype(_U), block):
                yield _ordered(0, 0, batch)

    return finish


def _gone(found: DataFrame, block: int) -> DataFrame:
    """(key, data): pairs of removable places and the earliest of their run, by block."""
    ends = found.where("kind = 1").select("key", "low", "data")

    def run(batches: Blobs) -> Blobs:
        for b in batches:
            for low, data in zip(b.column("least").to_pylist(), b.column("data").to_pylist(), strict=True):
                pos = np.frombuffer(data, np.int64)
                pos = pos[pos != low]
                yield from _to_blocks(pos, np.full(len(pos), low, _U), block)

    lows = ends.groupBy("key").agg(F.min("low").alias("least"))  # two for each slice at most
    across = ends.join(small(lows), "key").select("least", "data").mapInArrow(run, "key bigint, data binary")
    return found.where("kind = 0").select("key", "data").unionByName(across)


def _spans(least: int):
    """Consecutive removable places of a block joined to one span (start, stop, like)."""

    def fn(key: int, rows: dict[str, list]) -> Blobs:
        p = np.concatenate([np.frombuffer(d, _U).reshape(-1, 2) for d in rows["data"]]).astype(np.int64)
        p = p[np.argsort(p[:, 0])]
        head = np.flatnonzero(np.concatenate([[True], np.diff(p[:, 0]) != 1]))
        tail = np.append(head[1:], len(p)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(p[head, 0]), pa.array(p[tail, 0] + least), pa.array(p[head, 1])], names=["start", "stop", "like"])

    return fn


def _characters(batches: Blobs) -> Blobs:
    """Spans of a document in characters, those that touch or overlap joined."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for doc_id, base, lo, hi, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "base", "lo", "hi", "spans")), strict=True):
            lo, hi = np.frombuffer(lo, np.int32), np.frombuffer(hi, np.int32)
            held: list[list[int]] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                if held and s["start"] <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], s["stop"])
                else:
                    held.append([s["start"], s["stop"], s["like_doc_id"]])
            for start, stop, like in held:
                for col, v in zip(out, (doc_id, int(lo[start - base]), int(hi[stop - base - 1]), like), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start_char", "end_char", "like_doc_id"])


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM, block: int = BLOCK, local: int = LOCAL, slice_: int = SLICE) -> DataFrame:
    """(doc_id, start_char, end_char, like_doc_id): every stretch made of runs of least words that
    occur earlier in the corpus, with a document that has its beginning earlier."""
    spark = docs.sparkSession
    arrow_batches(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = project(docs, "doc_id", "text").where("text is not null")
    d = d.select("doc_id", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(7)).alias("k2"), F.length("text").cast("bigint").alias("chars"), "text")
    each = cut(d.mapInArrow(_representatives(least, gram), "doc_id bigint, k1 bigint, k2 bigint, chars bigint, words int, a array<int>, z array<int>, h array<bigint>"))

    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id")).alias("low")
    texts = cut(each.groupBy("k1", "k2").agg(lowest, F.first("a").alias("a"), F.first("z").alias("z"), F.first("h").alias("h")))
    windows = texts.select("k1", "k2", "low", F.explode(F.arrays_zip("a", "z", "h")).alias("w")).select("k1", "k2", "low", "w.a", "w.z", "w.h").repartition("h")
    twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    kept = windows.join(twice, "h", "left_semi").select("k1", "k2", "low", F.struct("a", (F.col("z") + least).alias("z")).alias("s"))
    # windows that touch or overlap are one stretch
    stretch = F.expr("""aggregate(array_sort(collect_list(s)), cast(array() as array<struct<a: int, z: int>>), (acc, x) ->
        if(size(acc) > 0 and x.a <= try_element_at(acc, -1).z,
           concat(slice(acc, 1, size(acc) - 1), array(struct(try_element_at(acc, -1).a as a, greatest(try_element_at(acc, -1).z, x.z) as z))),
           concat(acc, array(x))))""")
    marks = kept.groupBy("k1", "k2").agg(F.first("low").alias("low"), stretch.alias("stretches"))
    size = F.expr("cast(aggregate(stretches, 0, (n, x) -> n + x.z - x.a + 1) as bigint)")
    marks = cut(marks.select("low.nul", "low.doc_id", "k1", "k2", "stretches", size.alias("size")))
    # of equal texts all but the first are reported whole
    copies = each.join(texts.select("k1", "k2", "low"), ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("low.doc_id")))
    whole = cut(copies.select("doc_id", F.lit(0).cast("bigint").alias("start_char"), F.col("chars").alias("end_char"), F.col("low.doc_id").alias("like_doc_id"), "k1", "k2").distinct()).drop("k1", "k2")
    _release(spark, each, texts)
    n = marks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if not n:
        return whole

    # places in the string follow the order of documents, so the earliest place is the first
    rank = ["nul", "doc_id", "k1", "k2"]
    placed = cut(marks.repartitionByRange(*rank).sortWithinPartitions(*rank).withColumn("part", F.spark_partition_id()))
    running = Window.partitionBy("part").orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("size").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = placed.withColumn("base", F.coalesce(F.sum("size").over(running), F.lit(0))).join(small(cut(parts)), "part")
    placed = cut(placed.select("doc_id", "k1", "k2", "size", "stretches", (F.col("base") + F.col("before")).alias("base")))

    # the join leaves rows that repeat id and text side by side
    once = d.select("k1", "k2", "doc_id", "text").join(placed.select("k1", "k2", F.col("doc_id").alias("owner"), "stretches", "base"), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("owner")))
    once = once.dropDuplicates(["k1", "k2"])
    symbols, pieces = _cut_by_kind(once.select("base", "stretches", "text").mapInArrow(_symbols(least, block), "kind int, base bigint, key bigint, at bigint, data binary, grams binary, lo binary, hi binary"))
    _release(spark, marks)
    string = cut(_by_key(pieces.select("key", "at", "data", "grams"), -(-n // block), tasks, _assemble(n, block), "key bigint, data binary, grams binary"))
    _release(spark, pieces)
    gone = order(string, n, block, local, slice_, tasks, _runs(block))
    _release(spark, string)
    spans = _by_key(_gone(gone, block), -(-n // block), tasks, _spans(least), "start bigint, stop bigint, like bigint")

    # from places to documents, by small ranges of places
    step = 4096
    cells = placed.select("doc_id", "base", "size", F.explode(F.sequence(F.expr(f"base div {step}"), F.expr(f"(base + size - 1) div {step}"))).alias("cell"))
    found = spans.withColumn("cell", F.expr(f"start div {step}")).join(cells.select("base", "size", "cell"), "cell").where("start >= base and start < base + size").select("start", "stop", "like", "base")
    like = cells.select(F.col("doc_id").alias("like_doc_id"), F.col("base").alias("b"), F.col("size").alias("s"), "cell")
    found = found.withColumn("cell", F.expr(f"like div {step}")).join(like, "cell").where("like >= b and like < b + s").select("base", "start", "stop", "like_doc_id")
    by_doc = found.groupBy("base").agg(F.collect_list(F.struct("start", "stop", "like_doc_id")).alias("spans"))
    by_doc = by_doc.join(placed.select("base", "doc_id"), "base").join(symbols.select("base", "lo", "hi"), "base")
    return by_doc.select("doc_id", "base", "lo", "hi", "spans").mapInArrow(_characters, SCHEMA).unionByName(whole)
