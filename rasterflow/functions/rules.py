"""Scalar rules: argument checks, output formats, encoder knobs, presets, policies. Checks give an error code or null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SIDE, MAX_PIXELS = 32_768, 100_000_000
U32 = (1 << 32) - 1
MIB = 1 << 20

# Presets, default qualities, file extensions and policies are part of the public contract.
PRESETS = (("thumbnail", 150, 150, "webp", 75), ("avatar", 200, 200, "webp", 80), ("hero", 1920, None, "jpeg", 85), ("social", 1200, 630, "jpeg", 80))
DEFAULT_QUALITY = {"jpeg": 85, "webp": 80, "avif": 60, "png": None}
EXTENSIONS = {"jpeg": "jpg", "png": "png", "webp": "webp", "avif": "avif"}
INPUT_FORMATS, OUTPUT_FORMATS = ("jpeg", "jpg", "png", "webp"), ("jpeg", "jpg", "png", "webp", "avif")
#: policy, pixels, bytes, milliseconds, whether any ICC profile is refused, most bytes of one; null: no limit.
POLICIES = (
    ("strict", 40_000_000, 32 * MIB, 5_000, True, None),
    ("lenient", 75_000_000, 48 * MIB, 30_000, False, 512 * 1024),
    ("custom", None, None, None, False, None),
    ("disabled", None, None, None, False, None),
)


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "name string, width int, height int, format string, quality int")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy string, max_pixels long, max_bytes long, timeout_ms long, reject_metadata boolean, metadata_max_bytes long")


def formats(spark: SparkSession) -> DataFrame:
    """(direction, format): what can be read and written."""
    return spark.createDataFrame([("input", x) for x in INPUT_FORMATS] + [("output", x) for x in OUTPUT_FORMATS], "direction string, format string")


def output_format(name: Column) -> Column:
    """Canonical name, or null where it is none."""
    low = F.lower(name)
    return F.when(low.isin("jpeg", "jpg"), "jpeg").when(low.isin("png", "webp", "avif"), low)


def output_quality(name: Column, quality: Column) -> Column:
    """The quality that is used: the given one up to 100, else the format's; png has none."""
    of = output_format(name)
    default = F.lit(None).cast("int")
    for k, v in DEFAULT_QUALITY.items():
        default = F.when(of == k, v).otherwise(default)
    return F.when(of == "png", F.lit(None)).otherwise(F.coalesce(F.when(quality.isNotNull(), F.least(quality, F.lit(100))), default)).cast("int")


def output_name(path: Column, fmt: Column) -> Column:
    """File name of a batch's output: the input's, with the format's extension in place of its own."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        ext = F.when(output_format(fmt) == k, v).otherwise(ext)
    return F.concat(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit("."), ext)


def resize_fit(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low.isin("inside", "cover", "fill"), low)


def integral_error(v: Column) -> Column:
    """v: a DOUBLE argument. E400 unless it is finite, whole, and fits 64 bits."""
    bad = F.isnan(v) | (F.abs(v) == math.inf) | (v != F.floor(v).cast("double")) | (F.abs(v) > 9.2e18)
    return F.when(v.isNotNull() & bad, "E400")


def resize_args_error(w: Column, h: Column) -> Column:
    def side(v: Column) -> Column:
        return F.coalesce(integral_error(v), F.when((v <= 0) | (v > MAX_SIDE), "E203"))

    one = F.coalesce(F.when(side(w).isNotNull(), "E203"), F.when(side(h).isNotNull(), "E203"))
    return F.when(w.isNull() & h.isNull(), "E203").otherwise(one)


def crop_args_error(x: Column, y: Column, w: Column, h: Column) -> Column:
    whole = F.coalesce(*(integral_error(v) for v in (x, y, w, h)))
    return F.coalesce(
        whole, F.when((x < 0) | (y < 0), "E400"), F.when((w <= 0) | (h <= 0) | (w > MAX_SIDE) | (h > MAX_SIDE), "E201"), F.when((x > U32) | (y > U32), "E400"))


def quality_error(q: Column) -> Column:
    return F.coalesce(integral_error(q), F.when(q < 0, "E400"))


def tone_error(v: Column) -> Column:
    return F.coalesce(integral_error(v), F.when((v < -100) | (v > 100), "E400"))


def rotation_error(d: Column) -> Column:
    return F.when(~d.isin(0, 90, -90, 180, -180, 270, -270), "E202")


def concurrency_error(n: Column) -> Column:
    return F.coalesce(integral_error(n), F.when(n < 0, "E400"), F.when(n > 1024, "E901"))


def limit_setting(v: Column) -> Column:
    """A limit argument: absent keeps, 0 lifts, a positive one sets, anything else is wrong."""
    wrong = F.coalesce(integral_error(v), F.when(v < 0, "E400"))
    return F.when(v.isNull(), "keep").when(wrong.isNotNull(), wrong).when(v == 0, "lift").otherwise("set")


def dimension_error(w: Column, h: Column) -> Column:
    pixels = w.cast("long") * h.cast("long")
    return F.when((w > MAX_SIDE) | (h > MAX_SIDE), "E121").when(pixels > MAX_PIXELS, "E122")


def bytes_error(size: Column, most: Column) -> Column:
    """A policy's limit on the bytes of a source; a null limit is none."""
    return F.when(size > most, "E123")


def pixels_error(w: Column, h: Column, most: Column) -> Column:
    return F.when(w.cast("long") * h.cast("long") > most, "E123")


def timeout_error(elapsed_ms: Column, most: Column) -> Column:
    """After a stage that took too long; a limit of 0 or null is none."""
    return F.when((most > 0) & (elapsed_ms > most), "E123")


def icc_policy_error(size: Column, reject: Column, most: Column) -> Column:
    """A policy's rules on an embedded profile of `size` bytes, null where there is none."""
    return F.when(size.isNotNull() & (F.coalesce(reject, F.lit(False)) | F.coalesce(size > most, F.lit(False))), "E123")


def encode_error(w: Column, h: Column, channels: Column, length: Column) -> Column:
    size = w.cast("long") * h.cast("long") * channels.cast("long")
    return F.coalesce(F.when((w == 0) | (h == 0), "E300"), dimension_error(w, h), F.when(length != size, "E130"))


def quality_band(q: Column) -> Column:
    q = F.least(q, F.lit(100))
    return F.when(q >= 85, "high").when(q >= 70, "balanced").when(q >= 50, "fast").otherwise("fastest")


def encoder_knobs(q: Column) -> dict[str, Column]:
    """Encoder settings by quality."""
    band, capped = quality_band(q), F.least(q, F.lit(100))

    def by_band(high: int, balanced: int, fast: int, fastest: int) -> Column:
        return F.when(band == "high", high).when(band == "balanced", balanced).when(band == "fast", fast).otherwise(fastest)

    return {
        "band": band, "webp_method": F.lit(4), "webp_pass": F.lit(1), "webp_preprocessing": F.lit(0),
        "webp_sns_strength": by_band(50, 70, 80, 80), "webp_filter_sharpness": by_band(2, 0, 0, 0),
        "webp_filter_strength": F.when(capped >= 80, 20).when(capped >= 60, 30).otherwise(40), "avif_speed": by_band(6, 7, 8, 9),
        "jpeg_smoothing": F.when(capped >= 90, 0).when(capped >= 70, 5).when(capped >= 60, 10).otherwise(18),
    }


def icc_flags(keep_icc: Column, keep_exif: Column, size: Column, rejected: Column) -> dict[str, Column]:
    """Whether a profile was preserved or stripped, and the violations of a policy that rejects metadata."""
    present = F.coalesce(size > 0, F.lit(False))
    preserved = keep_icc & present
    # Fixed value: the violation's name.
    violation = F.array(F.lit("firewall_rejected_metadata"))
    return {
        "icc_preserved": preserved, "metadata_stripped": present & ~preserved,
        "policy_violations": F.when((keep_icc | keep_exif) & rejected & present, violation).otherwise(F.array().cast("array<string>")),
    }
