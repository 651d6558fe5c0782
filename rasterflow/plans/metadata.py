"""Metadata of real files, read and written in the tasks that hold them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import containers, jpeg, png

MAX_SOURCE = 8 << 20


def _each(f):
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else f(bytes(c)) for c in contents], dtype=object)

    return run


def valid_profile(icc: bytes) -> bool:
    """The rules of headers.icc_valid for code that holds the bytes."""
    tags = b"".join(icc[k : k + 4] for k in (4, 12, 16, 20))
    return len(icc) >= 128 and int.from_bytes(icc[:4]) == len(icc) and icc[8] <= 10 and all(c == 0 or 32 <= c <= 126 for c in tags)


def icc_of(data: bytes) -> bytes | None:
    """The profile embedded in a JPEG, PNG, WebP or AVIF; null where there is none, or it is damaged."""
    if not 12 <= len(data) <= MAX_SOURCE:
        return None
    if data[:2] == b"\xff\xd8":
        return jpeg.icc(data)
    if data[:8] == png.SIGNATURE:
        return png.icc(data)
    return containers.webp_icc(data) if data[:4] == b"RIFF" else containers.avif_icc(data) if data[4:8] == b"ftyp" else None


def icc_profile(content: Column) -> Column:
    return F.pandas_udf(_each(icc_of), "binary")(content)


def icc_error(content: Column) -> Column:
    """E131 where a file has a profile that is none."""
    return F.pandas_udf(_each(lambda d: "E131" if (p := icc_of(d)) is not None and not valid_profile(p) else None), "string")(content)


def _broken(data: bytes) -> str | None:
    try:
        jpeg.check(data)
    except jpeg.Broken:
        return "E131"
    return None


def jpeg_error(content: Column) -> Column:
    """E131 where a JPEG's markers do not hold together."""
    return F.pandas_udf(_each(_broken), "string")(content)


def with_exif(content: Column, exif: Column, reset_orientation: bool = True, strip_gps: bool = True) -> Column:
    """A JPEG with the given EXIF, sanitised, in place of its own; other files and null EXIF leave it as it is."""

    @F.pandas_udf("binary")
    def embed(contents: pd.Series, tiffs: pd.Series) -> pd.Series:
        fits = lambda c, t: c is not None and t is not None and bytes(c[:2]) == b"\xff\xd8"
        return pd.Series([jpeg.rewritten(bytes(c), jpeg.icc(bytes(c)), jpeg.sanitised(bytes(t), reset_orientation, strip_gps)) if fits(c, t) else c for c, t in zip(contents, tiffs)], dtype=object)

    return embed(content, exif)


def exif_of(data: bytes) -> bytes | None:
    """EXIF from its byte order on, of a JPEG, PNG, WebP, HEIF or AVIF; a TIFF is EXIF itself. Null where there is none."""
    if not 12 <= len(data) <= MAX_SOURCE:
        return None
    if data[:2] == b"\xff\xd8":
        return jpeg.exif(data)
    if data[:8] == png.SIGNATURE:
        return png.exif(data)
    if data[:4] == b"RIFF":
        return containers.webp_exif(data)
    return data if data[:4] in (b"II*\0", b"MM\0*") else containers.heif_exif(data) if data[4:8] == b"ftyp" else None


def exif_raw(content: Column) -> Column:
    return F.pandas_udf(_each(exif_of), "binary")(content)


def put_icc(data: bytes, icc: bytes) -> bytes | None:
    """A JPEG, PNG or WebP with the profile in place of its own; null where the file can't be taken apart."""
    try:
        if data[:2] == b"\xff\xd8":
            return jpeg.rewritten(data, icc, jpeg.exif(data))
        if data[:8] == png.SIGNATURE:
            return png.with_icc(png.without(data, b"iCCP"), icc)
    except (ValueError, jpeg.Broken):
        return None
    return containers.webp_with_icc(data, icc)


def with_icc(content: Column, icc: Column) -> Column:
    """Files with profiles put into them; a null profile leaves a file as it is."""

    @F.pandas_udf("binary")
    def embed(contents: pd.Series, profiles: pd.Series) -> pd.Series:
        return pd.Series([c if c is None or p is None else put_icc(bytes(c), bytes(p)) for c, p in zip(contents, profiles)], dtype=object)

    return embed(content, icc)


def orientation(content: Column) -> Column:
    return F.pandas_udf(_each(lambda d: jpeg.orientation(d) if d[:2] == b"\xff\xd8" else None), "int")(content)


def sanitised_exif(exif: Column, reset_orientation: bool = True, strip_gps: bool = True) -> Column:
    return F.pandas_udf(_each(lambda d: jpeg.sanitised(d, reset_orientation, strip_gps)), "binary")(exif)


def reassembled(segments: DataFrame) -> DataFrame:
    """segments (image_id, seq, total, payload binary): (image_id, icc), null unless all segments of an image name the
    same total and their numbers are exactly 1 to it. A few hundred segments at most make up an image's profile."""
    grouped = segments.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("s"), F.min("total").alias("lo"), F.max("total").alias("hi"))
    whole = (F.col("lo") == F.col("hi")) & (F.col("s.seq").cast("array<int>") == F.sequence(F.lit(1), F.greatest(F.col("hi"), F.lit(1)).cast("int")))
    return grouped.select("image_id", F.when(whole, F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["payload"])), ""))).alias("icc"))
