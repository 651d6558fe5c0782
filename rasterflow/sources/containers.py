"""Profiles and EXIF in the containers whose pixels are not read here: RIFF chunks of WebP, and boxes of AVIF and HEIF."""

from __future__ import annotations

import struct
from collections.abc import Iterator

MAX_ICC = 8 << 20


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of each chunk of a WebP file; chunks of odd length are followed by one byte."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > end:
            return
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + size % 2


def webp_icc(data: bytes) -> bytes | None:
    """The profile; null where there is none, or its chunk is cut off."""
    return next((data[a:b] for name, a, b in riff_chunks(data) if name == b"ICCP" and 0 < b - a <= MAX_ICC), None)


def webp_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the first chunk of a lossy, lossless or extended file."""
    name, a, b = next(riff_chunks(data), (b"", 0, 0))
    if name == b"VP8X" and b - a >= 10:
        return int.from_bytes(data[a + 4 : a + 7], "little") + 1, int.from_bytes(data[a + 7 : a + 10], "little") + 1
    if name == b"VP8L" and b - a >= 5:
        both = int.from_bytes(data[a + 1 : a + 5], "little")
        return both % 16384 + 1, (both >> 14) % 16384 + 1
    if name == b"VP8 " and b - a >= 10:
        w, h = struct.unpack_from("<HH", data, a + 6)
        return w % 16384, h % 16384
    return None


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes that lie side by side in a stretch of an ISO media file."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        size = end - at if size == 0 else size
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def avif_icc(data: bytes) -> bytes | None:
    """The profile of the first colour property that holds one: meta / iprp / ipco / colr of type prof or rICC."""

    def inside(path: tuple[bytes, ...], a: int, b: int) -> bytes | None:
        for kind, x, y in boxes(data, a, b):
            if kind != path[0]:
                continue
            if len(path) > 1:
                found = inside(path[1:], x + 4 * (kind == b"meta"), y)  # meta has a version and flags in front
                if found is not None:
                    return found
            elif data[x : x + 4] in (b"prof", b"rICC") and 0 < y - x - 4 <= MAX_ICC:
                return data[x + 4 : y]
        return None

    return inside((b"meta", b"iprp", b"ipco", b"colr"), 0, len(data))


def _tiff(body: bytes | None) -> bytes | None:
    """EXIF as it starts with its byte order; some writers put the name of JPEG's segment in front."""
    body = body and body.removeprefix(b"Exif\0\0")
    return body if body and body[:4] in (b"II*\0", b"MM\0*") else None


def webp_exif(data: bytes) -> bytes | None:
    return _tiff(next((data[a:b] for name, a, b in riff_chunks(data) if name == b"EXIF"), None))


def webp_with_icc(data: bytes, icc: bytes) -> bytes | None:
    """A WebP with the profile in place of its own. A profile stands in an extended file only, so a simple one becomes that: its header
    names the size, and whether there is alpha. Null where the file can't be taken apart."""
    chunks = [(name, data[a:b]) for name, a, b in riff_chunks(data)]
    size = webp_size(data)
    if not chunks or size is None:
        return None
    kind, first = chunks[0]
    if kind == b"VP8X":
        flags, chunks = first[0], chunks[1:]
    else:
        flags = 0x10 if kind == b"VP8L" and first[4] & 0x10 else 0
    head = bytes([flags | 0x20, 0, 0, 0]) + (size[0] - 1).to_bytes(3, "little") + (size[1] - 1).to_bytes(3, "little")
    parts = [(b"VP8X", head), (b"ICCP", icc), *((k, body) for k, body in chunks if k != b"ICCP")]
    out = b"".join(k + struct.pack("<I", len(body)) + body + bytes(len(body) % 2) for k, body in parts)
    return b"RIFF" + struct.pack("<I", len(out) + 4) + b"WEBP" + out


def _number(data: bytes, at: int, size: int) -> tuple[int, int]:
    if at + size > len(data):
        raise ValueError("a box is cut off")
    return int.from_bytes(data[at : at + size], "big"), at + size


def heif_exif(data: bytes) -> bytes | None:
    """The item of type Exif of a HEIF or AVIF file: iinf tells its number, iloc where it lies, in the file or in idat."""
    meta = next(((a + 4, b) for kind, a, b in boxes(data, 0, len(data)) if kind == b"meta"), None)
    if meta is None:
        return None
    inner = {kind: (a, b) for kind, a, b in boxes(data, *meta)}
    try:
        return _tiff(_item(data, inner))
    except ValueError:
        return None


def _item(data: bytes, inner: dict[bytes, tuple[int, int]]) -> bytes | None:
    if not {b"iinf", b"iloc"} <= set(inner):
        return None
    a, b = inner[b"iinf"]
    wanted = None
    for kind, x, _ in boxes(data, a + (6 if data[a] == 0 else 8), b):
        wide = 4 if data[x] >= 3 else 2
        if kind == b"infe" and data[x] >= 2 and data[x + 6 + wide : x + 10 + wide] == b"Exif":
            wanted = int.from_bytes(data[x + 4 : x + 4 + wide], "big")
    if wanted is None:
        return None
    at, _ = inner[b"iloc"]
    version, sizes, more = data[at], data[at + 4], data[at + 5]
    count, at = _number(data, at + 6, 4 if version == 2 else 2)
    for _ in range(count):
        item, at = _number(data, at, 4 if version == 2 else 2)
        method, at = _number(data, at, 2) if version else (0, at)
        base, at = _number(data, at + 2, more >> 4)
        extents, at = _number(data, at, 2)
        parts = []
        for _ in range(extents):
            at += more & 15 if version else 0
            offset, at = _number(data, at, sizes >> 4)
            length, at = _number(data, at, sizes & 15)
            start = base + offset + (inner[b"idat"][0] if method & 15 == 1 and b"idat" in inner else 0)
            parts.append(data[start : start + length])
        if item == wanted:
            body = b"".join(parts)
            skip, _ = _number(body, 0, 4)  # how far the byte order lies behind this number
            return body[4 + skip :]
    return None
