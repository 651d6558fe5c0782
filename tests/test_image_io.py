"""Layouts, guards before decoding, metadata on the way through, and outputs as files."""

import os
import struct
import zlib

import numpy as np
import pytest

from rasterflow.functions.errors import ImageError
from rasterflow.operators import batch
from rasterflow.plans import ops as plan
from rasterflow.plans.pipeline import Pipeline
from rasterflow.sources import containers, jpeg, png

JPEG = bytes.fromhex("ffd8ffc0000b080008000a01011100ffda0008010100003f0055ffd9")
TIFF = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, 99)


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def make_png(w, h, bits, kind, rows, laced=0, palette=None):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, laced))
    return png.SIGNATURE + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("laced", [0, 1])
@pytest.mark.parametrize("kind", [0, 3])
def test_small_depths_and_interlacing(bits, laced, kind):
    w, h = 11, 9
    px = np.random.default_rng(bits).integers(0, 1 << bits, (h, w), dtype=np.uint8)
    rows = b""
    for x, y, dx, dy in png.PASSES if laced else ((0, 0, 1, 1),):
        for row in px[y::dy, x::dx]:
            if len(row):
                spread = np.unpackbits(row[:, None], axis=1)[:, 8 - bits :].reshape(-1)
                rows += b"\0" + np.packbits(spread).tobytes()
    colours = np.arange(3 << bits, dtype=np.uint8).reshape(-1, 3)
    got = png.decode(make_png(w, h, bits, kind, rows, laced, colours.tobytes() if kind == 3 else None))
    assert (got == (colours[px] if kind == 3 else px[..., None] * (255 // ((1 << bits) - 1)))).all()


def test_interlaced_colour():
    px = np.random.default_rng(1).integers(0, 256, (5, 3, 3), dtype=np.uint8)
    rows = b"".join(b"\0" + row.tobytes() for x, y, dx, dy in png.PASSES for row in px[y::dy, x::dx] if len(row))
    assert (png.decode(make_png(3, 5, 8, 2, rows, 1)) == px).all()


def test_nothing_grows_beyond_its_header(spark):
    """A small file of many zeros is refused by its header, and one that holds more than its header names by its amount."""
    wide = make_png(30_000, 30_000, 8, 0, bytes(100))
    more = make_png(4, 4, 8, 0, bytes(50 << 20))
    huge = make_png(40_000, 1, 8, 0, bytes(40_001))
    cut = png.SIGNATURE + b"\0\0\0\x0dIHDR"
    rows = Pipeline.from_buffers(spark, [wide, more, huge, cut, JPEG]).limits(max_pixels=1000).to_buffer("png").orderBy("pos").collect()
    assert [r.code for r in rows] == ["E122", "E131", "E121", "E131", "E131"]
    bomb = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"iCCP", b"x\0\0" + zlib.compress(bytes(9 << 20)))
    assert png.icc(bomb) is None


def test_exif_on_the_way_through(spark):
    profile = bytes(range(200))
    data = jpeg.with_exif(jpeg.with_icc(JPEG, profile), TIFF)
    base = Pipeline.from_buffers(spark, [data])
    out = lambda p: bytes(p.to_buffer("jpeg", 80).first().output)
    bare = out(base.auto_orient(False))
    assert bare == JPEG
    kept = out(base.auto_orient(False).keep_metadata(icc=True, exif=True, strip_gps=False))
    assert jpeg.exif(kept) == TIFF and jpeg.icc(kept) == profile
    safe = out(base.auto_orient(False).keep_metadata(icc=False, exif=True))
    assert jpeg.orientation(safe) == 6 and jpeg.exif(safe)[-4:] == bytes(4) and jpeg.icc(safe) is None
    assert base.keep_metadata(exif=True).to_buffer("jpeg").first().code == "E131"  # it must be turned, and has no pixels to read
    upright = jpeg.with_exif(JPEG, jpeg.sanitised(TIFF, True, False))
    assert jpeg.exif(out(Pipeline.from_buffers(spark, [upright]).keep_metadata(exif=True, strip_gps=False))) == jpeg.sanitised(TIFF, True, False)
    bare = Pipeline.from_buffers(spark, [upright]).limits(max_bytes=0)
    for strict in (bare.keep_metadata(icc=True, exif=True).sanitize("strict"), bare.sanitize("strict").keep_metadata(icc=True, exif=True)):
        assert out(strict) == JPEG  # whatever the order of the calls


def test_containers():
    icc = b"p" * 131
    riff = b"VP8X" + struct.pack("<I", 10) + bytes(4) + (799).to_bytes(3, "little") + (599).to_bytes(3, "little") + b"ICCP" + struct.pack("<I", 131) + icc + b"\0"
    webp = b"RIFF" + struct.pack("<I", len(riff) + 4) + b"WEBP" + riff
    assert containers.webp_icc(webp) == icc and containers.webp_size(webp) == (800, 600) and containers.webp_icc(webp[:60]) is None
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    avif = box(b"ftyp", b"avif\0\0\0\0") + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", box(b"colr", b"nclx" + bytes(7)) + box(b"colr", b"rICC" + icc))))
    assert containers.avif_icc(avif) == icc and containers.avif_icc(avif[:-1]) is None and containers.avif_icc(b"") is None


def test_files(spark, tmp_path):
    data = png.encode(np.zeros((8, 6, 3), np.uint8))
    one, two = Pipeline.from_buffers(spark, [data]), Pipeline.from_buffers(spark, [data, b"junk"])
    done = one.rotate(90).to_file(str(tmp_path / "a.png"), "png").first()
    assert os.listdir(tmp_path) == ["a.png"] and done.outputPath.endswith("/a.png")
    assert png.decode((tmp_path / "a.png").read_bytes()).shape == (6, 8, 3) and done.bytes == (tmp_path / "a.png").stat().st_size
    rows = two.to_file(str(tmp_path / "n-{pos}.png"), "png").orderBy("pos").collect()
    assert [r.code for r in rows] == [None, "E111"] and (tmp_path / "n-0.png").exists() and not (tmp_path / "n-1.png").exists()
    assert one.to_file_with_preset(str(tmp_path / "b.jpg"), "hero").first().code == "E300"
    assert one.to_buffer_with_preset("thumbnail").first().quality == 75 and one.to_buffer_with_metrics_preset("hero").count() == 1
    for call in (lambda: one.to_file(" ", "png"), lambda: one.to_file(str(tmp_path / "no" / "a.png"), "png"), lambda: two.to_file(str(tmp_path / "a.png"), "png"), lambda: one.to_buffer("png", -1)):
        with pytest.raises(ImageError) as e:
            call()
        assert e.value.code == "E400"


def test_equal_names_overwrite_nothing(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "same.png").write_bytes(png.encode(np.full((2, 2, 1), ord(k), np.uint8)))
    names = [str(tmp_path / k / "same.png") for k in "ab"] + [str(tmp_path / "a" / "gone.png")]
    rows = batch.process_batch(spark, names, str(tmp_path / "out"), {"format": "PNG", "quality": 90, "concurrency": 2}).collect()
    assert [(r.success, r.errorCode) for r in rows] == [(True, None), (False, "E400"), (False, "E100")]
    assert png.decode((tmp_path / "out" / "same.png").read_bytes())[0, 0, 0] == ord("a")
    found = Pipeline.inspect_files(spark, [names[0], names[2], " "]).collect()
    assert {r.source: (r.width, r.error) for r in found} == {names[0]: (2, None), names[2]: (None, "E101"), " ": (None, "E400")}


def test_dimensions_ask_the_policy(spark):
    base = Pipeline.from_buffers(spark, [png.encode(np.zeros((8, 6, 3), np.uint8), struct.pack(">I4sB3x4s4s4s", 200, b"TEST", 2, b"mntr", b"RGB ", b"XYZ ") + bytes(176))])
    assert [(r.width, r.height, r.error) for r in base.dimensions().collect()] == [(6, 8, None)]
    assert base.limits(max_bytes=10).dimensions().first().error == "E123" and base.sanitize("strict").dimensions().first().error == "E123"
