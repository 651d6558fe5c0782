"""Pixel operators over a long table (image_id, y, x, c, v) and its images' sizes (image_id, w, h).

Geometry is a projection of coordinates, cropping a filter, tone a projection of v: nothing shuffles. Only what
needs the channels of a pixel together (luma, opaque alpha) groups, by pixel, with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import TURNS, moved

KEY = ("image_id", "y", "x")


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of 8-bit channels."""
    return F.call_function("div", 2126 * r + 7152 * g + 722 * b, F.lit(10_000)).cast("int")


def crop(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return px.filter(inside).withColumn("x", F.col("x") - x).withColumn("y", F.col("y") - y)


def reorient(px: DataFrame, w: Column, h: Column, orientation: Column) -> DataFrame:
    x, y = moved(F.col("x"), F.col("y"), w, h, orientation)
    return px.withColumns({"x": x.cast("int"), "y": y.cast("int")})


def rotate(px: DataFrame, w: Column, h: Column, degrees: int) -> DataFrame:
    """Clockwise, by quarter turns."""
    return reorient(px, w, h, F.lit(TURNS[degrees]))


def flip_h(px: DataFrame, w: Column) -> DataFrame:
    return px.withColumn("x", (w - 1 - F.col("x")).cast("int"))


def flip_v(px: DataFrame, h: Column) -> DataFrame:
    return px.withColumn("y", (h - 1 - F.col("y")).cast("int"))


def brightness(px: DataFrame, level: int, alpha: int | None = None) -> DataFrame:
    """Adds level to every channel but alpha."""
    tone = clamp(F.col("v") + level)
    return px.withColumn("v", tone if alpha is None else F.when(F.col("c") == alpha, F.col("v")).otherwise(tone))


def contrast(px: DataFrame, amount: int, alpha: int | None = None) -> DataFrame:
    """Stretches around the middle by ((100 + amount) / 100) ** 2."""
    factor = ((100.0 + amount) / 100.0) ** 2
    tone = clamp(F.floor(((F.col("v") / F.lit(255.0) - 0.5) * factor + 0.5) * 255.0))
    return px.withColumn("v", tone if alpha is None else F.when(F.col("c") == alpha, F.col("v")).otherwise(tone))


def grayscale(px: DataFrame) -> DataFrame:
    """RGB(A) to one channel of luma; alpha goes. An image of one or two channels keeps its first."""
    def channel(k: int) -> Column:
        return F.max(F.when(F.col("c") == k, F.col("v")))

    one = F.when(F.count("*") < 3, channel(0)).otherwise(luma(channel(0), channel(1), channel(2)))
    return px.groupBy(*KEY).agg(one.cast("int").alias("v")).select(*KEY, F.lit(0).alias("c"), "v")


def normalize(px: DataFrame, channels: Column) -> DataFrame:
    """RGB and RGBA stay; luma is repeated as RGB, and alpha beside luma goes."""
    into = F.when(channels >= 3, F.array(F.col("c"))).when(F.col("c") == 0, F.array(*(F.lit(k) for k in range(3)))).otherwise(F.array().cast("array<int>"))
    return px.select(*KEY, F.explode(into).alias("c"), "v")


def opaque(px: DataFrame, channels: Column, pixels: Column, least: int = 1_000_000) -> DataFrame:
    """(image_id, opaque) as the resampler judges it: three channels are; a small image with alpha is taken not to
    be, unseen; a large one is if all its alpha is 255."""
    alpha = (channels.isin(1, 3)) | ((pixels >= least) & ((F.col("c") != channels - 1) | (F.col("v") == 255)))
    return px.groupBy("image_id").agg(F.bool_and(alpha).alias("opaque"))


def pack(px: DataFrame) -> DataFrame:
    """(image_id, width, height, channels, data): the samples of each image in row order."""
    cell = F.struct("y", "x", "c", F.unhex(F.lpad(F.hex("v"), 2, "0")).alias("b"))
    ordered = F.array_sort(F.collect_list(cell))
    out = px.groupBy("image_id").agg(*((F.max(k) + 1).alias(n) for k, n in (("x", "width"), ("y", "height"), ("c", "channels"))), ordered.alias("cells"))
    return out.withColumn("data", F.unhex(F.array_join(F.transform("cells", lambda s: F.hex(s["b"])), ""))).drop("cells")


def unpack(images: DataFrame) -> DataFrame:
    """The long table of packed images."""
    wide = F.col("width") * F.col("channels")
    cells = images.select("image_id", wide.alias("row"), "channels", F.posexplode(F.expr("transform(sequence(1, length(data)), i -> CAST(conv(hex(substring(data, i, 1)), 16, 10) AS int))")).alias("i", "v"))
    step = lambda a, b: F.call_function("div", a, b).cast("int")
    return cells.select("image_id", step(F.col("i"), F.col("row")).alias("y"), step(F.col("i") % F.col("row"), F.col("channels")).alias("x"), (F.col("i") % F.col("channels")).alias("c"), "v")
