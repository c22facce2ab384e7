"""Cost-balanced packing of documents into training sequences.

A piece of L tokens costs L + L^2 / QUADRATIC: the linear layers and the attention within a
document. Longest first, each piece goes to the sequence of lowest cost that still has room, ties
to the first, and to a new one when none has. Documents longer than a sequence are cut into full
pieces and a rest. The order is one over the whole corpus, whatever its size.

What a piece costs depends on its tokens alone, so pieces of equal tokens are alike and so are the
sequences that took the same pieces: the greedy pass works on counts of pieces by tokens and on
intervals of sequences of equal cost and room. A step gives one piece to each sequence of an
interval; there is at most one split a token count, so its work is bounded by CAPACITY and not by
the corpus. Pieces are ranked over the cluster and meet the steps by blocks of ranks.

Tokens are estimated as one per CHARS_PER_TOKEN characters, rounded up.

Cases: null or empty texts have no tokens and are left out; null ids come first among pieces of
equal tokens, then by id, piece and hash of the text; equal rows are interchangeable, and a
document that occurs several times is packed as often. Very long texts are cut into many pieces.
An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, project, ranked

CAPACITY = 8192
CHARS_PER_TOKEN = 4
QUADRATIC = 24_576.0
#: Ranks in a block in which pieces meet the steps of the greedy pass.
BLOCK = 1 << 16


def greedy(counts: Mapping[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """Steps (start, n, seq, each): of the pieces in order of falling tokens, piece start + i, for
    i below n, goes to sequence seq + i // each. counts: pieces by tokens."""
    free = max(1, -(-sum(t * n for t, n in counts.items()) // capacity))
    ready: list[tuple[float, int, int, int]] = [(0.0, 0, free, capacity)]  # cost, first, after the last, room
    waiting: list[tuple[int, float, int, int]] = []  # by room, those without room for the tokens at hand
    start = 0

    def put(cost: float, a: int, b: int, room: int, tokens: int) -> None:
        if room >= tokens:
            heappush(ready, (cost, a, b, room))
        elif room:
            heappush(waiting, (-room, cost, a, b))

    for tokens in sorted(counts, reverse=True):
        left, cost = counts[tokens], tokens + float(tokens) ** 2 / QUADRATIC
        while waiting and -waiting[0][0] >= tokens:
            room, load, a, b = heappop(waiting)
            heappush(ready, (load, a, b, -room))
        while left and ready:
            load, a, b, room = heappop(ready)
            n = min(left, b - a)
            yield start, n, a, 1
            start, left = start + n, left - n
            put(load + cost, a, a + n, room - tokens, tokens)
            if a + n < b:
                heappush(ready, (load, a + n, b, room))
        if left:  # new sequences, each filled before the next one is begun
            each = capacity // tokens
            yield start, left, free, each
            whole, rest = divmod(left, each)
            for n, size in ((whole, each), (int(rest > 0), rest)):
                if n:
                    load = 0.0
                    for _ in range(size):
                        load += cost
                    put(load, free, free + n, capacity - size * tokens, tokens)
                    free += n
            start += left


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start_char, end_char, tokens, digest of the text): whole texts in pieces
    that fit."""
    d = project(docs, "doc_id", "text").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("chars"), F.xxhash64("text").alias("digest")).where("chars > 0")
    step = capacity * CHARS_PER_TOKEN
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"cast((chars - 1) div {step} as int)"))))
    start = F.col("piece").cast("bigint") * step
    d = d.select("doc_id", "piece", start.alias("start_char"), F.least(start + step, F.col("chars")).alias("end_char"), "digest")
    tokens = F.expr(f"cast((end_char - start_char + {CHARS_PER_TOKEN - 1}) div {CHARS_PER_TOKEN} as int)")
    return d.withColumn("tokens", tokens)


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row for each piece: its sequence, place in the text, tokens and cost."""
    found = cut(pieces(docs, capacity))
    items = ranked(found.withColumn("short", -F.col("tokens")), None, ["short", "doc_id", "piece", "digest"], "rank", "total").withColumn("at", F.col("rank") - 1)
    items = items.select("doc_id", "piece", "start_char", "end_char", "tokens", "at", F.expr(f"at div {block}").alias("block"))

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = {t: n for f in frames for t, n in zip(f["tokens"].tolist(), f["n"].tolist(), strict=True)}
        held = []
        for step in greedy(counts, capacity) if counts else ():
            held.append(step)
            if len(held) == 10_000:
                yield pd.DataFrame(held, columns=["start", "n", "seq", "each"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["start", "n", "seq", "each"])

    # at most capacity rows go into the one task
    counts = found.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).coalesce(1)
    runs = counts.mapInPandas(steps, "start bigint, n bigint, seq bigint, each bigint")
    # a block begins with the step that its first rank belongs to
    blocks = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}")))
    runs = runs.withColumn("block", blocks).select(F.greatest("start", F.col("block") * block).alias("at"), "block", F.struct("start", "seq", "each").alias("step"))
    last = Window.partitionBy("block").orderBy("at", F.col("step").isNull())
    both = items.unionByName(runs, True).withColumn("step", F.last("step", True).over(last)).where("tokens is not null")
    seq = F.col("step.seq") + F.expr("(at - step.start) div step.each")
    cost = F.col("tokens") + F.col("tokens").cast("double") * F.col("tokens") / QUADRATIC
    return both.select(seq.alias("seq"), "doc_id", "piece", "start_char", "end_char", "tokens", cost.alias("cost"))
