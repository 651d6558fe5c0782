"""What the first bytes of an image say, as expressions over a BINARY column: no pixel is decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte(data: Column, at: int | Column) -> Column:
    """Unsigned byte at a zero-based position, null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.nullif(F.hex(F.substring(data, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


def number(data: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned integer of `size` bytes at a fixed position, null where they are not all there."""
    raw = F.substring(data, F.lit(at + 1), F.lit(size))
    raw = F.reverse(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.hex(F.substring(raw, i, F.lit(1))))) if little else F.array(F.hex(raw))
    return F.when(F.octet_length(data) >= at + size, F.conv(F.array_join(raw, ""), 16, 10).cast("long"))


def has(data: Column, at: int, text: str) -> Column:
    """Whether the hex digits `text` stand at a fixed position."""
    return F.hex(F.substring(data, F.lit(at + 1), F.lit(len(text) // 2))) == text.upper()


def ascii_at(data: Column, at: int, text: str) -> Column:
    return has(data, at, text.encode().hex())


PNG_SIGNATURE = "89504e470d0a1a0a"


def is_webp(data: Column) -> Column:
    return ascii_at(data, 0, "RIFF") & ascii_at(data, 8, "WEBP")


def is_avif(data: Column) -> Column:
    """An ISO media file whose major brand, or a compatible one, is avif or avis."""
    size = number(data, 0, 4)
    brands = F.transform(
        F.sequence(F.lit(17).cast("long"), F.greatest(size - 3, F.lit(17)), F.lit(4).cast("long")), lambda i: F.when(i + 3 <= size, F.hex(F.substring(data, i.cast("int"), F.lit(4)))))
    listed = F.exists(brands, lambda b: F.coalesce(b.isin("61766966", "61766973"), F.lit(False)))
    sane = (F.octet_length(data) >= 12) & ascii_at(data, 4, "ftyp") & (size <= F.octet_length(data)) & (size >= 12)
    return F.coalesce(sane & (ascii_at(data, 8, "avif") | ascii_at(data, 8, "avis") | ((size >= 20) & listed)), F.lit(False))


def image_format(data: Column) -> Column:
    """By magic bytes, never by name; null where none fits."""
    return (
        F.when(has(data, 0, "ffd8ff"), "jpeg").when(has(data, 0, PNG_SIGNATURE), "png").when(is_webp(data), "webp").when(is_avif(data), "avif")
        .when(ascii_at(data, 0, "GIF8"), "gif").when(has(data, 0, "49492a00") | has(data, 0, "4d4d002a"), "tiff").when(ascii_at(data, 0, "BM"), "bmp"))


def container(data: Column) -> Column:
    """The container that metadata is looked for in; null below twelve bytes."""
    heif = ascii_at(data, 4, "ftyp") & F.hex(F.substring(data, 9, 4)).isin(*(b.encode().hex().upper() for b in ("avif", "avis", "heic", "heix", "mif1")))
    kind = F.when(has(data, 0, "ffd8"), "jpeg").when(has(data, 0, "89504e47"), "png").when(is_webp(data), "webp").when(heif, "heif").when(has(data, 0, "49492a00") | has(data, 0, "4d4d002a"), "tiff")
    return F.when(F.octet_length(data) >= 12, kind)


def png_size(data: Column) -> tuple[Column, Column]:
    ok = (F.octet_length(data) >= 24) & has(data, 0, PNG_SIGNATURE)
    return F.when(ok, number(data, 16, 4)), F.when(ok, number(data, 20, 4))


def webp_size(data: Column) -> tuple[Column, Column]:
    """Of the three kinds of WebP: lossy, lossless and extended."""
    bits = number(data, 21, 4, little=True)
    lossy, lossless, extended = (is_webp(data) & ascii_at(data, 12, k) for k in ("VP8 ", "VP8L", "VP8X"))
    w = F.when(lossy, number(data, 26, 2, True) % 16384).when(lossless, bits % 16384 + 1).when(extended, number(data, 24, 3, True) + 1)
    h = F.when(lossy, number(data, 28, 2, True) % 16384).when(lossless, F.shiftright(bits, 14) % 16384 + 1).when(extended, number(data, 27, 3, True) + 1)
    return w, h


def icc_valid(icc: Column) -> Column:
    """A profile's size field is its length, its four tags are printable or zero, its major version is at most 10."""
    printable = F.forall(F.sequence(F.lit(0), F.lit(15)), lambda k: (lambda b: (b == 0) | b.between(32, 126))(byte(icc, F.when(k < 4, k + 4).otherwise(k + 8))))
    return F.coalesce((F.octet_length(icc) >= 128) & (number(icc, 0, 4) == F.octet_length(icc)) & (byte(icc, 8) <= 10) & printable, F.lit(False))
