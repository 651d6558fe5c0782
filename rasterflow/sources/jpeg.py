"""JPEG segments: a walk over the markers, and what is read from them. No decoder is available here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

EXIF, ICC = b"Exif\0\0", b"ICC_PROFILE\0"
ORIENTATION, GPS = 0x0112, 0x8825
MAX_ICC = 8 << 20
_SOS, _EOI = 0xDA, 0xD9


class Broken(ValueError):
    """The markers of a file do not hold together."""


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of each segment's payload, to the start of the scan or the end of the image, which come
    last, with what they have."""
    if data[:2] != b"\xff\xd8" or len(data) < 4:
        raise Broken("no start of image")
    at = 2
    while at + 1 < len(data):
        if data[at] != 0xFF:
            raise Broken("expected a marker")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at == len(data):
            raise Broken("cut off after a marker's prefix")
        marker, at = data[at], at + 1
        if marker == _EOI:
            yield marker, at, at
            return
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if at + 1 >= len(data):
            raise Broken("cut off in a segment's length")
        (size,) = struct.unpack_from(">H", data, at)
        if size < 2 or at + size > len(data):
            raise Broken("a segment's length is wrong")
        yield marker, at + 2, at + size
        at += size
        if marker == _SOS:
            return
    raise Broken("neither a scan nor an end")


def check(data: bytes) -> None:
    last, end = 0, 0
    for last, _, end in segments(data):
        pass
    if last == _SOS and end >= len(data):
        raise Broken("a scan without data")


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header."""
    for marker, a, b in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and b - a >= 5:
            h, w = struct.unpack_from(">HH", data, a + 1)
            return w, h
    return None


def icc(data: bytes) -> bytes | None:
    """The profile, if all its numbered parts are there once."""
    parts, counts = {}, set()
    try:
        for marker, a, b in segments(data):
            if marker == 0xE2 and data[a : a + 12] == ICC and b - a >= 14 and data[a + 12] and data[a + 13]:
                if data[a + 12] in parts:
                    return None
                parts[data[a + 12]] = data[a + 14 : b]
                counts.add(data[a + 13])
    except Broken:
        return None
    if len(counts) != 1 or sorted(parts) != list(range(1, counts.pop() + 1)):
        return None
    whole = b"".join(parts[k] for k in sorted(parts))
    return whole if len(whole) <= MAX_ICC else None


def exif(data: bytes) -> bytes | None:
    try:
        return next((data[a + 6 : b] for marker, a, b in segments(data) if marker == 0xE1 and data[a : a + 6] == EXIF), None)
    except Broken:
        return None


def _entries(tiff: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(byte order, tag, type, position of the value) in the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(tiff[:2]))
    if order is None or len(tiff) < 8:
        return
    (at,) = struct.unpack_from(f"{order}I", tiff, 4)
    if not 8 <= at <= len(tiff) - 2:
        return
    (n,) = struct.unpack_from(f"{order}H", tiff, at)
    for i in range(min(n, (len(tiff) - at - 2) // 12)):
        tag, kind = struct.unpack_from(f"{order}HH", tiff, at + 2 + 12 * i)
        yield order, tag, kind, at + 2 + 12 * i + 8


def orientation(data: bytes) -> int | None:
    """1..8, if the file says so."""
    tiff = exif(data) or b""
    for order, tag, kind, at in _entries(tiff):
        if tag == ORIENTATION and kind in (3, 4):
            (v,) = struct.unpack_from(order + ("H" if kind == 3 else "I"), tiff, at)
            return v if 1 <= v <= 8 else None
    return None


def sanitised(tiff: bytes, reset_orientation: bool = True, strip_gps: bool = True) -> bytes:
    """EXIF with its orientation set to 1 and its pointer to GPS data zeroed; the data it pointed to stay."""
    out = bytearray(tiff)
    for order, tag, kind, at in _entries(tiff):
        if reset_orientation and tag == ORIENTATION and kind == 3:
            struct.pack_into(f"{order}H", out, at, 1)
        if strip_gps and tag == GPS:
            out[at : at + 4] = bytes(4)
    return bytes(out)


def with_segment(data: bytes, marker: int, payload: bytes) -> bytes:
    """data with one more segment right after its start."""
    return data[:2] + bytes((0xFF, marker)) + struct.pack(">H", len(payload) + 2) + payload + data[2:]


def with_icc(data: bytes, profile: bytes) -> bytes:
    step = 65_519
    parts = [profile[i : i + step] for i in range(0, len(profile), step)]
    for k in reversed(range(len(parts))):
        data = with_segment(data, 0xE2, ICC + bytes((k + 1, len(parts))) + parts[k])
    return data


def with_exif(data: bytes, tiff: bytes) -> bytes:
    return with_segment(data, 0xE1, EXIF + tiff)


def rewritten(data: bytes, profile: bytes | None, tiff: bytes | None) -> bytes:
    """data with the given profile and EXIF and no others; the image itself is not touched. Other application segments
    that hold metadata go too."""
    out, at = bytearray(data[:2]), 2
    for marker, a, b in segments(data):
        if marker in (0xE1, 0xE2, 0xED):
            out += data[at : a - 4]
            at = b
    whole = bytes(out) + data[at:]
    whole = with_icc(whole, profile) if profile else whole
    return with_exif(whole, tiff) if tiff and len(tiff) <= 65_527 else whole
