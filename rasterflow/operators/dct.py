"""What a JPEG encoder does to samples before it packs bits: blocks of 8 by 8, forward transform, quantisation by quality, zigzag.

On row arrays, in integers throughout: the cosine basis is rounded to 1/8192 once, so sums do not depend on their order. The
transform along a row is a projection; the one down the columns gathers the eight rows of a block, in one exchange. Packing
the coefficients into bits is left out: no operator of Spark does that, and no encoder is available to executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import big, div
from .rows import let

#: The quantisation table for luma of the JPEG standard's annex K, row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
SIDE, ONE = 8, 8192


def basis() -> list[list[int]]:
    """basis()[u][x]: weight of sample x in frequency u, in 1/ONE."""
    return [[round(ONE * (math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16)) for x in range(SIDE)] for u in range(SIDE)]


def zigzag() -> list[int]:
    """Places of a block, row by row, in the order in which they are written: along the diagonals, to and fro."""
    places = [(v, u) for v in range(SIDE) for u in range(SIDE)]
    return [SIDE * v + u for v, u in sorted(places, key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]


def _literal(values: list[list[int]]) -> Column:
    return F.array(*(F.array(*(F.lit(v).cast("long") for v in row)) for row in values))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), big(0), lambda s, x: s + x)


def quantisers(quality: Column) -> Column:
    """The table for a quality of 1 to 100: half of it at 50 as it is, finer above, coarser below; 1 to 255 each."""
    q = F.greatest(F.least(big(quality), big(100)), big(1))
    scale = F.when(q < 50, div(big(5000), q)).otherwise(200 - 2 * q)
    base = F.array(*(F.lit(v).cast("long") for v in LUMA))
    return F.transform(base, lambda v: F.greatest(F.least(div(v * scale + 50, 100), big(255)), big(1)))


def coefficients(rows: DataFrame, quality: Column) -> DataFrame:
    """(image_id, block_y, block_x, coefficients): the quantised coefficients of every block of each image's first channel, in
    zigzag order. Rows must be whole. Blocks that reach over the right or lower edge repeat the last sample or row."""
    plane, last = F.get("p", 0), F.col("w").cast("int") - 1
    part = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.get(plane, F.least(F.col("block_x") * SIDE + i, last)).cast("long") - 128)
    across = rows.select("*", F.explode(F.sequence(F.lit(0), div(F.col("w") - 1, SIDE).cast("int"))).alias("block_x"))
    across = across.select("image_id", quality.alias("_q"), "y", div(F.col("y"), SIDE).cast("int").alias("block_y"), "block_x", let(part, lambda p: F.transform(_literal(basis()), lambda b: _dot(p, b))).alias("_u"))
    cells = F.array_sort(F.collect_list(F.struct("y", "_u")))
    blocks = across.groupBy("image_id", "block_y", "block_x").agg(F.first("_q").alias("_q"), cells.alias("_cells"))
    eight = F.sequence(F.lit(0), F.lit(SIDE - 1))
    down = F.transform(eight, lambda y: F.get("_cells", F.least(y, F.size("_cells") - 1))["_u"])
    columns = let(down, lambda rows: F.transform(eight, lambda u: F.transform(rows, lambda row: F.get(row, u))))
    sums = let(columns, lambda cs: F.flatten(F.transform(_literal(basis()), lambda b: F.transform(cs, lambda column: _dot(column, b)))))
    # rounded half away from zero, in integers
    step = lambda q: q * (ONE * ONE)
    levels = F.zip_with(sums, quantisers(F.col("_q")), lambda s, q: F.signum(s).cast("long") * div(2 * F.abs(s) + step(q), 2 * step(q)))
    order = F.array(*map(F.lit, zigzag()))
    ordered = let(levels, lambda found: F.transform(order, lambda i: F.get(found, i).cast("int")))
    return blocks.select("image_id", "block_y", "block_x", ordered.alias("coefficients"))
