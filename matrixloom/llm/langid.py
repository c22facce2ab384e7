"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER is counted on a bounded sample of labelled
documents and then frozen. A byte costs -log2 of its probability in the longest context known,
with escapes by method C (as many escape counts as distinct successors) and exclusion of the
successors already ruled out, down to a uniform order -1. A text's language is the one whose tree
codes it shortest.

Scoring is table look-up over whole batches: the trees are laid out as one automaton whose states
are the contexts of any language, with the exact cost of every byte in every state worked out in
advance. The state after i bytes is found in ORDER steps, each a gather over the whole batch.

A text is rejected if it has no bytes or if even the shortest code spends more bits a byte than
the limit of its language and START bits besides, as its first bytes have little context and short
texts vary most; texts of no known language cost far more. A quarter of each
language's sample is held out for it, one document at least where there are two: the limit is
their lower quartile plus DEVIATIONS times their spread about it, which lies within SPREAD. A
held-out text that is FAR from the quartile counts as FAR, so that junk under a label, short of
three quarters, doesn't lift the limit above itself. A language with fewer than FEW held-out
texts takes quartile and spread of all if they are greater, one with none the widest limit; only
where no language has two labelled texts there is no limit.

Cases: null and empty texts have no language and are rejected. A null id is carried. Rows without
a label or an id, and texts longer than TRAIN_BYTES, are no training rows, but are scored; repeated rows get equal results. With no labelled
row at all every text is rejected. Ties go to the first language by name. Texts are scored whole,
however long. An empty table gives an empty result.
Other columns are ignored by identify and carried through by keep_identified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, chunks, hash52, position, project, with_columns_apart

ORDER = 4
#: Training and held-out documents for each language at most, and in this proportion where there
#: are fewer: the bound on the sample that the trees are fitted on; scoring has none.
TRAIN_DOCS = 300
HELD_OUT = 100
#: No longer text is learned from, so that the sample is bounded in bytes too; any is scored.
TRAIN_BYTES = 1 << 17
#: A context is kept if it was seen so often in any language.
LEAST_SEEN = 8
DEVIATIONS = 6.0
#: Bits a byte beyond which a held-out text counts as no farther from the quartile.
FAR = 1.0
SPREAD = 0.2, 0.5
#: Bits that the beginning of any text may cost above the limit.
START = 16.0
#: Held-out texts with which a language's own spread is relied on.
FEW = 8
#: Contexts whose costs are worked out at a time, and bytes that are scored at a time.
FIT_ROWS = 4096
SEGMENT = 1 << 19
SEED = "langid-1"


@dataclass
class Model:
    languages: list[str]
    #: Symbol of each byte; 0 is any byte never seen in training.
    symbol: np.ndarray
    #: (states, symbols) -> state
    step: np.ndarray
    #: (states, symbols, languages) -> bits
    bits: np.ndarray
    order: int
    #: Bits a byte that a text of each language may cost.
    limits: np.ndarray

    @property
    def limit(self) -> float:
        """The widest."""
        return float(self.limits.max()) if self.languages else np.inf


def _counts(texts: dict[str, list[bytes]], order: int, symbol: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Contexts, shorter first, and counts (contexts, symbols, languages)."""
    names = sorted(texts)
    grams: dict[tuple[int, int], np.ndarray] = {}
    for i, name in enumerate(names):
        for n in range(1, order + 2):
            parts = []
            for t in texts[name]:
                s = symbol[np.frombuffer(t, np.uint8)].astype(np.int64)
                if len(s) >= n:
                    code = np.zeros(len(s) - n + 1, np.int64)
                    for j in range(n):
                        code = code * k + s[j : len(s) - n + 1 + j]
                    parts.append(code)
            grams[i, n] = np.stack(np.unique(np.concatenate(parts), return_counts=True)) if parts else np.zeros((2, 0), np.int64)
    contexts: list[tuple[int, ...]] = [()]
    index: dict[int, dict[int, int]] = {0: {0: 0}}
    for n in range(1, order + 1):
        total: dict[int, int] = {}
        for i in range(len(names)):
            for g, c in grams[i, n].T.tolist():
                total[g] = max(total.get(g, 0), c)
        index[n] = {}
        for g in sorted(total):
            # both the context without its first and without its last symbol are in the tree
            if total[g] >= LEAST_SEEN and g // k in index[n - 1] and g % k ** (n - 1) in index[n - 1]:
                index[n][g] = len(contexts)
                contexts.append(tuple(g // k ** (n - 1 - j) % k for j in range(n)))
    counts = np.zeros((len(contexts), k, len(names)), np.float32)
    for i in range(len(names)):
        for n in range(order + 1):
            g, c = grams[i, n + 1]
            at = np.fromiter((index[n].get(x, -1) for x in (g // k).tolist()), np.int64, len(g))
            ok = at >= 0
            counts[at[ok], (g % k)[ok], i] = c[ok]
    return contexts, counts


def _bits(counts: np.ndarray, parent: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Cost of each symbol in each of the contexts of one language."""
    bits = np.zeros((len(contexts), counts.shape[1]))
    done = np.zeros(bits.shape, bool)  # symbols coded already
    out = np.zeros(bits.shape, bool)  # symbols excluded by a longer context
    at = contexts
    while (at >= 0).any():
        here = np.where((at >= 0)[:, None], counts[np.maximum(at, 0)], 0).astype(np.float64) * ~out
        total, distinct = here.sum(1), (here > 0).sum(1)
        known = distinct > 0
        denominator = np.where(known, total + distinct, 1)[:, None]
        hit = (here > 0) & ~done
        bits += np.where(hit, -np.log2(np.where(hit, here, 1) / denominator), 0)
        done |= hit
        bits += np.where(~done & known[:, None], -np.log2(np.where(known, distinct, 1) / np.where(known, total + distinct, 1))[:, None], 0)
        out |= here > 0
        at = np.where(at >= 0, parent[np.maximum(at, 0)], -1)
    # order -1: uniform over the bytes not excluded
    left = 256 - out.sum(1)
    return bits + np.where(~done, np.log2(np.maximum(left, 1))[:, None], 0)


def fit(texts: dict[str, list[bytes]], held_out: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Trees of the languages, and the limit from the texts held out."""
    names = sorted(texts)
    seen = np.unique(np.concatenate([np.frombuffer(t, np.uint8) for n in names for t in texts[n]] or [np.zeros(0, np.uint8)]))
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(1, len(seen) + 1)
    k = len(seen) + 1
    contexts, counts = _counts(texts, order, symbol, k)
    index = {c: i for i, c in enumerate(contexts)}
    parent = np.array([index[c[1:]] if c else -1 for c in contexts])
    step = np.zeros((len(contexts), k), np.int32)
    for i, c in enumerate(contexts):
        for s in range(k):
            longer = (*c, s)[-order:] if order else ()
            while longer not in index:
                longer = longer[1:]
            step[i, s] = index[longer]
    log = np.zeros(counts.shape, np.float32)
    for i in range(len(names)):
        for first in range(0, len(contexts), FIT_ROWS):
            log[first : first + FIT_ROWS, :, i] = _bits(counts[:, :, i], parent, np.arange(first, min(first + FIT_ROWS, len(contexts))))
    del counts
    model = Model(names, symbol, step, log, order, np.full(len(names), np.inf))
    model.limits = _limits([np.array([score_one(model, t).min() / len(t) for t in held_out.get(n, []) if t]) for n in names])
    return model


def _limits(costs: list[np.ndarray]) -> np.ndarray:
    """The limit of each language from the bits a byte of its held-out texts."""
    known = [c for c in costs if len(c)]
    if not known:
        return np.full(len(costs), np.inf)
    quartile = lambda c: float(np.quantile(c, 0.25))
    off = lambda c: np.minimum(np.abs(c - quartile(c)), FAR)
    size = lambda x: float(np.sqrt(np.mean(x**2)))
    all_at, all_far = quartile(np.concatenate(known)), size(np.concatenate([off(c) for c in known]))
    out = np.full(len(costs), -np.inf)
    for i, c in enumerate(costs):
        if len(c):
            at, far = quartile(c), size(off(c))
            if len(c) < FEW:
                at, far = max(at, all_at), max(far, all_far)
            out[i] = at + DEVIATIONS * min(max(far, SPREAD[0]), SPREAD[1])
    return np.where(np.isinf(out), out.max(), out)


def score(model: Model, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Code length in bits of each document under each language, a segment of bytes at a time."""
    n_docs, n, k = len(offsets) - 1, len(data), model.step.shape[1]
    out = np.zeros((n_docs, len(model.languages)))
    kind = np.int32 if model.step.size < 1 << 31 else np.int64
    flat, bits = model.step.ravel(), model.bits.reshape(-1, len(model.languages))
    full = np.flatnonzero(np.diff(offsets) > 0)
    begin = offsets[:-1][full]
    for first in range(0, n, segment):
        # a byte's context lies within the order bytes before it
        low, high = max(0, first - model.order), min(n, first + segment)
        s = model.symbol[data[low:high]].astype(kind)
        here = begin[np.searchsorted(begin, low) : np.searchsorted(begin, high)] - low
        # state[i]: context before byte i, out of the bytes of its own document
        state = np.zeros(high - low, kind)
        for _ in range(model.order):
            after = flat[state * k + s]
            state[1:] = after[:-1]
            state[here] = 0
        cost = bits[(state * k + s)[first - low :]]
        docs = np.arange(np.searchsorted(begin, first, "right") - 1, np.searchsorted(begin, high))
        out[full[docs]] += np.add.reduceat(cost, np.maximum(begin[docs] - first, 0), axis=0, dtype=np.float64)
    return out


def score_one(model: Model, text: bytes) -> np.ndarray:
    return score(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, held_out: int = HELD_OUT) -> Model:
    """Fit on the train_docs + held_out labelled documents of each language with lowest hash; of
    fewer, the same share is held out. Rows that repeat id and text are one, and equal texts count
    once, lest a copy is held out."""
    d = project(docs, "doc_id", "lang", "text").where("lang is not null and doc_id is not null and text <> ''")
    d = d.where(F.octet_length("text") <= TRAIN_BYTES)
    some = d.select("lang", "doc_id", F.xxhash64("text").alias("h"), hash52(F.lit(SEED), F.col("doc_id")).alias("draw"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "h")
    picked = some.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= train_docs + held_out).select("lang", "doc_id", "h", "nth").distinct().collect()
    if not picked:
        return fit({}, {})
    wanted = F.broadcast(d.sparkSession.createDataFrame(picked, "lang string, doc_id bigint, h bigint, nth int"))
    rows = d.withColumn("h", F.xxhash64("text")).join(wanted, ["lang", "doc_id", "h"]).dropDuplicates(["lang", "nth"])
    drawn: dict[str, dict[bytes, None]] = {}
    for r in sorted(rows.select("lang", "nth", F.encode("text", "utf-8").alias("body")).collect(), key=lambda r: (r.lang, r.nth)):
        drawn.setdefault(r.lang, {})[bytes(r.body)] = None
    texts: dict[str, list[bytes]] = {}
    apart: dict[str, list[bytes]] = {}
    for lang, bodies in drawn.items():
        n = len(bodies)
        first = n - max(n * held_out // (train_docs + held_out), int(held_out > 0 and n > 1))
        texts[lang], apart[lang] = list(bodies)[:first], list(bodies)[first:]
    return fit(texts, apart)


def _share(spark: SparkSession, model: Model):
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, language, bits_per_byte, margin, accepted) of each row. language is null where
    nothing can be scored; margin: bits a byte to the second language."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = _share(spark, model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, None], object)
        for b in batches:
            for first, last, data, offsets in chunks(b.column(1)):
                size = np.diff(offsets).astype(float)
                if m.languages:
                    rate = score(m, data, offsets) / np.maximum(size, 1)[:, None]
                    best = rate.argmin(1)
                    low = np.sort(rate, axis=1)
                    margin = low[:, 1] - low[:, 0] if rate.shape[1] > 1 else np.zeros(len(size))
                    low = low[:, 0]
                else:
                    best, low, margin = np.zeros(len(size), int), np.full(len(size), np.inf), np.zeros(len(size))
                void = (size == 0) | (not m.languages)
                best = np.where(void, len(m.languages), best)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, last - first), pa.array(names[best], pa.string()), pa.array(np.round(low, 6), mask=void), pa.array(np.round(margin, 6), mask=void), pa.array(~void & (low * size <= np.append(m.limits, -np.inf)[best] * np.maximum(size, 1) + START))],
                    names=["doc_id", "language", "bits_per_byte", "margin", "accepted"],
                )

    return project(docs, "doc_id", "text").mapInArrow(run, "doc_id bigint, language string, bits_per_byte double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The accepted documents with all their columns as they were."""
    spark = docs.sparkSession
    arrow_batches(spark)
    plain, names = with_columns_apart(docs)
    at = position(docs, "text")
    if at is None:
        return docs.limit(0)
    shared = _share(spark, model or train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            if m.languages:
                for first, last, data, offsets in chunks(b.column(at)):
                    size = np.diff(offsets)
                    bits = score(m, data, offsets)
                    keep[first:last] = (size > 0) & (bits.min(1) <= m.limits[bits.argmin(1)] * size + START)
            yield b.filter(pa.array(keep))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
