"""PNG, read with zlib and numpy in all its layouts, and written with 8-bit samples and no interlacing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def _inflate(raw: bytes, most: int) -> bytes:
    """At most `most` bytes of a zlib stream; ValueError if there are more, so that a small file cannot grow at will."""
    push = zlib.decompressobj()
    out = push.decompress(raw, most + 1)
    if len(out) > most:
        raise ValueError("more image data than the header names")
    return out


def size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the header alone."""
    return struct.unpack_from(">II", data, 16) if len(data) >= 24 and data[:8] == SIGNATURE else None


def icc(data: bytes, most: int = 8 << 20) -> bytes | None:
    """The embedded profile; null where there is none, or it is damaged or larger than `most` bytes."""
    try:
        for kind, body in chunks(data):
            if kind == b"iCCP":
                name, _, rest = body.partition(b"\0")
                return _inflate(rest[1:], most) if rest[:1] == b"\0" else None
    except (ValueError, zlib.error):
        return None
    return None


def exif(data: bytes) -> bytes | None:
    """The body of the eXIf chunk; null where there is none, or it is no EXIF."""
    try:
        body = next((body for kind, body in chunks(data) if kind == b"eXIf"), None)
    except ValueError:
        return None
    return body if body and body[:4] in (b"II*\0", b"MM\0*") else None


def without(data: bytes, name: bytes) -> bytes:
    """A file less its chunks of one name."""
    return SIGNATURE + b"".join(_chunk(kind, body) for kind, body in chunks(data) if kind != name)


def readable(data: bytes) -> bool:
    """Whether chunks, their checksums and the layout are such that decode() takes the file."""
    try:
        at, kinds = 8, []
        for kind, body in chunks(data):
            at += 12 + len(body)
            if struct.unpack_from(">I", data, at - 4)[0] != zlib.crc32(kind + body):
                return False
            kinds.append(kind)
        w, h, bits, kind, packed, filters, laced = struct.unpack_from(">IIBBBBB", data, 16)
        return kinds[:1] == [b"IHDR"] and b"IDAT" in kinds and laced < 2 and packed == filters == 0 and bits in DEPTHS.get(kind, ())
    except (ValueError, struct.error):
        return False


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def with_icc(data: bytes, profile: bytes) -> bytes:
    """A file without a profile, with it behind its header."""
    return data[:33] + _chunk(b"iCCP", b"icc\0\0" + zlib.compress(profile)) + data[33:]


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), 0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    out = row.copy()
    left, corner = np.zeros(step, np.int64), np.zeros(step, np.int64)
    for i in range(0, len(row), step):
        up = above[i : i + step].astype(np.int64)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            a, b, c = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        left = (row[i : i + step] + guess) % 256
        out[i : i + step] = left
        corner = up
    return out


#: First column and row of an interlaced image's seven passes, and the steps between theirs.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Fixed: the depths that a kind of samples may have.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _samples(raw: np.ndarray, w: int, h: int, n: int, bits: int) -> np.ndarray:
    """Filtered rows of one pass to samples (h, w, n): below 8 bits as they are, of 16 the high byte."""
    wide = -(-w * n * bits // 8)
    rows, step = raw.reshape(h, wide + 1), max(1, n * bits // 8)
    out, above = np.empty((h, wide), np.uint8), np.zeros(wide, np.uint8)
    for y in range(h):
        if rows[y, 0] > 4:
            raise ValueError("unknown filter")
        out[y] = above = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    if bits < 8:
        one = np.unpackbits(out, axis=1).reshape(h, -1, bits)
        return (one @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : w * n].reshape(h, w, n)
    return out.reshape(h, w, n, bits // 8)[..., 0]


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) as bytes: 16-bit ones keep their high byte, those below 8 bits are spread over
    0..255, palettes become colours. No more is inflated than the header names."""
    body, palette, clear = [], None, None
    w = h = bits = kind = laced = 0
    for name, part in chunks(data):
        if name == b"IHDR":
            w, h, bits, kind, _, _, laced = struct.unpack(">IIBBBBB", part)
            if laced > 1 or bits not in DEPTHS.get(kind, ()) or not w or not h:
                raise ValueError("unsupported PNG layout")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
        elif name == b"IDAT":
            body.append(part)
    if not w:
        raise ValueError("no header")
    n = CHANNELS[kind]
    parts = [(x, y, dx, dy) for x, y, dx, dy in (PASSES if laced else ((0, 0, 1, 1),)) if x < w and y < h]
    sizes = [(-(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in parts]
    lengths = [ph * (-(-pw * n * bits // 8) + 1) for pw, ph in sizes]
    raw = np.frombuffer(_inflate(b"".join(body), sum(lengths)), np.uint8)
    if len(raw) != sum(lengths):
        raise ValueError("wrong amount of image data")
    px, at = np.empty((h, w, n), np.uint8), 0
    for (x, y, dx, dy), (pw, ph), length in zip(parts, sizes, lengths):
        px[y::dy, x::dx] = _samples(raw[at : at + length], pw, ph, n, bits)
        at += length
    if kind == 3:
        if palette is None or px.max() >= len(palette):
            raise ValueError("no colour for an index")
        colour = palette[px[..., 0]]
        if clear is None:
            return colour
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return np.concatenate([colour, alpha[px[..., 0]][..., None]], 2)
    return np.ascontiguousarray(px if bits >= 8 else px * np.uint8(255 // ((1 << bits) - 1)))


def encode(px: np.ndarray, profile: bytes | None = None, level: int = 6) -> bytes:
    """Lossless; every row is filtered by its difference from the one above."""
    h, w, n = px.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    flat = np.ascontiguousarray(px, np.uint8).reshape(h, w * n)
    diff = flat.copy()
    diff[1:] -= flat[:-1]
    rows = np.concatenate([np.full((h, 1), 2, np.uint8), diff], 1)

    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0))
    out = SIGNATURE + head + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")
    return with_icc(out, profile) if profile else out
