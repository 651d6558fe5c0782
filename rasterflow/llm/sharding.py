"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0..n-1 in an order that depends on their content alone. A balanced Feistel network over
pairs (left, right) below side = ceil(sqrt(n)) permutes 0..side^2-1; a value that lands at n or above is sent
through again (cycle walking) until it falls below n, which makes it a permutation of 0..n-1. Row i's shard is
perm(i) mod shards and its slot perm(i) div shards, so shard sizes differ by one at most, slots have no gaps, and
`unpermute` finds the row number that a shard and slot hold. Everything is a column expression.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 6
#: Fixed number of ranges in which rows are numbered; their sizes are the only thing that is broadcast.
RANGES = 4096


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("long"))


def _network(x: Column, seed: int, side: int, back: bool) -> Column:
    """All rounds as one fold over (left, right), so that the expression stays small."""

    def mix(half: Column, i: Column) -> Column:
        return F.pmod(F.xxhash64(half, F.lit(seed), i), F.lit(side).cast("long"))

    def forward(s: Column, i: Column) -> Column:
        return F.struct(s["right"].alias("left"), F.pmod(s["left"] + mix(s["right"], i), F.lit(side).cast("long")).alias("right"))

    def backward(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["right"] - mix(s["left"], i), F.lit(side).cast("long")).alias("left"), s["left"].alias("right"))

    rounds = F.array(*(F.lit(i) for i in (reversed(range(ROUNDS)) if back else range(ROUNDS))))
    halves = F.struct(_div(x, side).alias("left"), F.pmod(x, F.lit(side).cast("long")).alias("right"))
    return F.aggregate(rounds, halves, backward if back else forward, lambda s: s["left"] * side + s["right"])


def _forward(x: Column, seed: int, side: int) -> Column:
    return _network(x, seed, side, back=False)


def _backward(x: Column, seed: int, side: int) -> Column:
    return _network(x, seed, side, back=True)


def _walk(step, x: Column, n: int, seed: int) -> Column:
    """step until below n. The square has at most 2 * sqrt(n) + 1 values to walk over; past a few thousand rows
    the chance to meet 80 of them in a row is nil, and below that 80 is more than there are."""
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    once = step(x, seed, side)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(80)), once, lambda at, _: F.when(at < n, at).otherwise(step(at, seed, side)))
    return F.when(once < n, once).otherwise(more)


def permute(x: Column, n: int, seed: int = 1) -> Column:
    """Where 0 <= x < n goes under the permutation of 0..n-1 that seed names."""
    return _walk(_forward, x.cast("long"), n, seed)


def unpermute(x: Column, n: int, seed: int = 1) -> Column:
    return _walk(_backward, x.cast("long"), n, seed)


def shards(docs: DataFrame, count: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size (UTF-8 bytes of the text plus 1), text_crc32, law ('rows'), shard,
    slot, grown_shard (null: this law does not keep rows in place when shards are added), row_number.

    A null text counts as empty, and its crc32 is that of no bytes. Rows that agree in id, size and crc32 are told
    apart by nothing, so they are numbered as a run; null ids come first in their range. No rows, no result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # equal rows collapse before the shuffle; a range is a slice of the hash space, so no key makes one large
    rows = slim.groupBy("id", "size", "crc").agg(F.count("*").alias("copies")).withColumn("mix", F.xxhash64("id", "size", "crc"))
    rows = cut(rows.withColumn("range", F.pmod("mix", F.lit(RANGES)).cast("int")))
    found = sorted((r["range"], r["n"]) for r in rows.groupBy("range").agg(F.sum("copies").alias("n")).collect())
    n = sum(x for _, x in found)
    starts = reduce(lambda acc, x: [*acc, (x[0], acc[-1][1] + acc[-1][2], x[1])], found, [(-1, 0, 0)])[1:]
    offsets = docs.sparkSession.createDataFrame([(r, at) for r, at, _ in starts], "range int, start long")
    before = F.expr("sum(copies) OVER (PARTITION BY range ORDER BY mix, id NULLS FIRST, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - copies")
    numbered = rows.join(F.broadcast(offsets), "range").withColumn("first", F.col("start") + before)
    each = numbered.select("id", "size", "crc", F.expr("explode(transform(sequence(0L, copies - 1), c -> first + c))").alias("row_number"))
    placed = each.withColumn("at", permute(F.col("row_number"), max(n, 1), seed))
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.pmod("at", F.lit(count)).cast("int").alias("shard"), _div(F.col("at"), count).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
