"""Telemetry of runs and quality measures of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import U32

VERSION = "1.0.0"
#: Old names of six fields, kept beside the new ones.
ALIASES = {"decodeTime": "decodeMs", "processTime": "opsMs", "encodeTime": "encodeMs", "memoryPeak": "peakRss", "inputSize": "bytesIn", "outputSize": "bytesOut"}


def u32(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(v.cast("long"), F.lit(U32).cast("long")))


def compression_ratio(bytes_in: Column, bytes_out: Column) -> Column:
    return F.coalesce(F.try_divide(bytes_out.cast("double"), bytes_in.cast("double")), F.lit(0.0))


def peak_rss(rss: Column, w: Column, h: Column, bytes_out: Column) -> Column:
    """The measured peak, or the size of the decoded image and the output where none was."""
    return u32(F.coalesce(rss.cast("long"), w.cast("long") * h.cast("long") * 4 + bytes_out.cast("long")))


def metrics(df: DataFrame) -> DataFrame:
    """The metrics record from (decodeMs, opsMs, encodeMs, cpuTime, rss, width, height, bytesIn, bytesOut, formatIn,
    formatOut, iccPreserved, metadataStripped, policyViolations); other columns stay in front."""
    total = F.col("decodeMs") + F.col("opsMs") + F.col("encodeMs")
    out = df.withColumns({
        "version": F.lit(VERSION), "totalMs": total, "processingTime": total / 1000, "peakRss": peak_rss(F.col("rss"), F.col("width"), F.col("height"), F.col("bytesOut")),
        "compressionRatio": compression_ratio(F.col("bytesIn"), F.col("bytesOut")), "bytesIn": u32(F.col("bytesIn")), "bytesOut": u32(F.col("bytesOut")),
    })
    return out.withColumns({old: F.col(new) for old, new in ALIASES.items()}).drop("rss", "width", "height")


def psnr(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, mse, psnr) of images that both have; infinite where they agree. Sizes that differ give null."""
    other = b.select("image_id", "y", "x", "c", F.col("v").alias("v2"))
    both = a.join(other, ["image_id", "y", "x", "c"], "full")
    gap = F.col("v").cast("double") - F.col("v2")
    out = both.groupBy("image_id").agg(F.avg(gap * gap).alias("mse"), F.bool_and(F.col("v").isNotNull() & F.col("v2").isNotNull()).alias("same"))
    value = F.when(F.col("mse") == 0, F.lit(math.inf)).otherwise(10 * F.log10(255.0 * 255.0 / F.col("mse")))
    return out.select("image_id", F.when(F.col("same"), F.col("mse")).alias("mse"), F.when(F.col("same"), value).alias("psnr"))


def ssim(a: DataFrame, b: DataFrame, window: int = 8) -> DataFrame:
    """(image_id, ssim): mean over channels and blocks of window by window pixels."""
    k1, k2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    other = b.select("image_id", "y", "x", "c", F.col("v").alias("v2"))
    x, y = F.col("v").cast("double"), F.col("v2").cast("double")
    block = [F.call_function("div", F.col(k), F.lit(window)).alias(f"b{k}") for k in ("y", "x")]
    sums = a.join(other, ["image_id", "y", "x", "c"]).groupBy("image_id", "c", *block).agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x * y).alias("xy"))
    mx, my = F.col("mx"), F.col("my")
    vx, vy, cov = F.col("xx") - mx * mx, F.col("yy") - my * my, F.col("xy") - mx * my
    one = ((2 * mx * my + k1) * (2 * cov + k2)) / ((mx * mx + my * my + k1) * (vx + vy + k2))
    return sums.groupBy("image_id").agg(F.avg(one).alias("ssim"))


def quality(a: DataFrame, b: DataFrame) -> DataFrame:
    return psnr(a, b).join(ssim(a, b), "image_id")


def pixel_hash(px: DataFrame) -> DataFrame:
    """(image_id, pixel_hash): SHA-256 of the samples in row order."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "c", F.lpad(F.hex("v"), 2, "0").alias("h"))))
    return px.groupBy("image_id").agg(F.sha2(F.unhex(F.array_join(F.transform(cells, lambda s: s["h"]), "")), 256).alias("pixel_hash"))


def size_gate(out: Column, ref: Column, most: Column) -> Column:
    return F.coalesce(F.try_divide(out.cast("double"), ref.cast("double")) <= most, F.lit(False))


def delta_percent(a: Column, b: Column) -> Column:
    return F.try_divide((a - b).cast("double"), b.cast("double")) * 100
