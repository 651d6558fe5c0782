"""Plan building, rewriting, files and streams."""

import os
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.functions.errors import ImageError
from rasterflow.functions.geometry import inside
from rasterflow.operators import batch
from rasterflow.operators import rows as pixel_rows
from rasterflow.plans import metadata
from rasterflow.plans import ops as plan
from rasterflow.plans.pipeline import Pipeline
from rasterflow.queries import QUERIES
from rasterflow.sources import jpeg, png
from rasterflow.streaming import files


def gradient(w, h, n=3):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x % 256, y % 256, np.full_like(x, 128), np.full_like(x, 255)][:n], 2).astype(np.uint8)


@pytest.mark.parametrize(
    ("make", "code"),
    [
        (lambda: plan.resize(), "E203"), (lambda: plan.resize(0), "E203"), (lambda: plan.resize(10.5), "E203"), (lambda: plan.resize(40000), "E203"), (lambda: plan.resize(1, fit="x"), "E204"),
        (lambda: plan.crop(-1, 0, 1, 1), "E400"), (lambda: plan.crop(0, 0, 0, 1), "E201"), (lambda: plan.rotate(45), "E202"), (lambda: plan.rotate(360), "E202"), (lambda: plan.brightness(101), "E400"), (lambda: plan.contrast(float("nan")), "E400"),
    ],
)
def test_wrong_arguments_fail_at_once(make, code):
    with pytest.raises(ImageError) as e:
        make()
    assert e.value.code == code


def test_rewrites():
    r, c = plan.resize, plan.crop
    assert plan.rewrite((r(800), r(400))) == (r(400),)
    assert plan.rewrite((r(800, 600), r(400))) == (r(400),)
    assert plan.rewrite((r(800, fit="fill"), r(400))) == (r(800, fit="fill"), r(400))
    (e,) = plan.rewrite((r(200, 150), c(10, 5, 80, 60)))
    assert (e.op, e.width, e.height, e.fit, e.x, e.crop_width) == ("extract", 200, 150, "inside", 10, 80)
    assert plan.rewrite((r(200, 150, "cover"), c(10, 5, 80, 60))) == (r(200, 150, "cover"), c(10, 5, 80, 60))
    assert plan.rewrite((c(1, 1, 100, 49), r(50))) == (c(1, 1, 100, 49), r(50, 25))
    assert plan.rewrite((r(800), r(400), c(0, 0, 10, 10))) == (r(400), c(0, 0, 10, 10))
    assert plan.rewrite((r(5),)) == (r(5),)


def test_prerequisites():
    with pytest.raises(ImageError):
        plan.check((plan.Op("auto_orient", orientation=6),), frozenset((plan.PIXELS, plan.COLOR)))
    plan.check((plan.Op("grayscale"), plan.rotate(90)))


def test_inside_fits_its_box_on_a_grid(spark):
    g = spark.range(1, 33).selectExpr("id * 7 AS w").crossJoin(spark.range(1, 33).selectExpr("id * 5 AS h")).crossJoin(spark.range(1, 6).selectExpr("id * 13 AS t"))
    w, h = inside(F.col("w"), F.col("h"), F.col("t"), F.col("t") + 9)
    for r in g.select("w", "h", "t", w.alias("ow"), h.alias("oh")).collect():
        assert (r.ow, r.oh) == plan.inside_size(r.w, r.h, r.t, r.t + 9)
        assert r.ow <= r.t and r.oh <= r.t + 9


def test_png_round_trip_and_filters():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 4):
        px = rnd.integers(0, 256, (7, 5, n), dtype=np.uint8)
        assert (png.decode(png.encode(px)) == px).all()
    px = rnd.integers(0, 256, (6, 4, 3), dtype=np.uint8)
    import zlib

    rows, above = [], np.zeros(12, int)
    for y, kind in enumerate((0, 1, 2, 3, 4, 4)):
        row = px[y].reshape(-1).astype(int)
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        rows.append(bytes([kind]) + bytes(((row - [0, left, above, (left + above) // 2, paeth][kind]) % 256).astype(np.uint8)))
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert (png.decode(data) == px).all()







def test_jpeg_segments():
    icc = b"\0" * 70_000
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8825, 4, 1, 99)
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 30, 0)
    data = jpeg.with_exif(jpeg.with_icc(b"\xff\xd8" + sof + b"\xff\xda\0\x02x\xff\xd9", icc), tiff)
    jpeg.check(data)
    assert jpeg.icc(data) == icc and jpeg.orientation(data) == 6 and jpeg.size(data) == (30, 20)
    clean = jpeg.sanitised(tiff)
    assert struct.unpack_from("<H", clean, 18)[0] == 1 and clean[-4:] == bytes(4)
    for broken in (b"", b"\xff\xd8\x00\x00", b"\xff\xd8\xff\xe0\xff\xff", data[:6]):
        with pytest.raises(jpeg.Broken):
            jpeg.check(broken)


def test_batch_rows_keep_order_and_errors(spark, tmp_path):
    names = []
    for i in range(3):
        (tmp_path / f"a{i}.png").write_bytes(png.encode(gradient(40, 30)))
        names.append(str(tmp_path / f"a{i}.png"))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    names = [names[2], str(tmp_path / "missing.png"), names[0], str(tmp_path / "bad.png"), names[1]]
    rows = batch.process_batch(spark, names, str(tmp_path / "out"), "png", (plan.resize(20), plan.Op("grayscale"))).collect()
    assert [r.source for r in rows] == names
    assert [r.success for r in rows] == [True, False, True, False, True]
    assert rows[1].errorCode == "E100" and rows[1].errorCategory == 0 and rows[1].error.startswith("[E100] ") and rows[3].errorCode == "E111"
    assert png.decode(open(rows[0].outputPath, "rb").read()).shape == (15, 20, 1)
    for args, code in (((" ", "png"), "E400"), ((str(tmp_path), "bmp"), "E111")):
        with pytest.raises(ImageError) as e:
            batch.process_batch(spark, names, *args)
        assert e.value.code == code


def test_pipeline_policies_and_metrics(spark):
    profile = struct.pack(">I4sB3x4s4s4s", 200, b"TEST", 2, b"mntr", b"RGB ", b"XYZ ") + bytes(176)
    base = Pipeline.from_buffers(spark, [png.encode(gradient(30, 20), profile), b"junk"])
    strict = base.sanitize("strict").to_buffer("png").orderBy("pos").collect()
    assert [r.code for r in strict] == ["E123", "E111"]
    kept = base.keep_metadata(icc=True).limits(max_pixels=0).rotate(90).to_buffer_with_metrics("png").orderBy("pos").first()
    assert kept.iccPreserved and not kept.metadataStripped and kept.totalMs >= 0 and kept.inputSize == kept.bytesIn and kept.peakRss > 0
    assert base.limits(max_pixels=10).to_buffer("png").orderBy("pos").first().code == "E123"
    assert [(r.width, r.height, r.format) for r in base.dimensions().orderBy("pos").collect()] == [(30, 20, "png"), (None, None, None)]
    assert base.has_icc_profile().orderBy("pos").first().icc_bytes == 200
    assert base.preset("hero")[1]["quality"] == 85 and base.ops == ()
    for bad, code in ((lambda: base.sanitize("x"), "E402"), (lambda: base.preset("x"), "E401"), (lambda: base.limits(max_bytes=-1), "E400"), (lambda: base.rows("gif"), "E111")):
        with pytest.raises(ImageError) as e:
            bad()
        assert e.value.code == code


def test_segments_reassemble_only_when_complete(spark):
    rows = [(1, 2, 2, b"b"), (1, 1, 2, b"a"), (2, 1, 2, b"a"), (3, 1, 1, b"x"), (3, 1, 1, b"y"), (4, 1, 2, b"p"), (4, 2, 3, b"q")]
    got = dict(metadata.reassembled(spark.createDataFrame(rows, "image_id long, seq int, total int, payload binary")).collect())
    assert {k: None if v is None else bytes(v) for k, v in got.items()} == {1: b"ab", 2: None, 3: None, 4: None}


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(png.encode(gradient(12, 8)))
    (src / "b.png").write_bytes(b"no image")
    files.start(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), "png", [{"op": "resize", "width": 6}, {"op": "flipH"}, {"op": "autoOrient"}]).awaitTermination(120)
    rows = {r.source[-5:]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert png.decode(bytes(rows["a.png"].output)).shape == (4, 6, 3) and rows["b.png"].code == "E111"
    with pytest.raises(ImageError):
        files.stream_plan([{"op": "crop"}])


def test_a_stream_is_worked_on_in_batches(spark, tmp_path, monkeypatch):
    """Neither one batch nor one folder holds all files, every file is taken once, and what the stream lists is not kept."""
    monkeypatch.setattr(files, "BATCH_FILES", 2)
    src = tmp_path / "in"
    for folder, names in (("0", "abc"), ("1", "de")):
        (src / folder).mkdir(parents=True)
        for name in names:
            (src / folder / f"{name}.png").write_bytes(png.encode(gradient(4, 4)))
    files.start_each(spark, [str(src / "0"), str(src / "1")], str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).select("source", "code", "folder", "epoch").collect()
    assert sorted((r.source[-5:], r.code, r.folder) for r in rows) == [("a.png", None, 0), ("b.png", None, 0), ("c.png", None, 0), ("d.png", None, 1), ("e.png", None, 1)]
    assert Counter((r.folder, r.epoch) for r in rows) == {(0, 0): 2, (0, 1): 1, (1, 0): 2}
    assert files.session(spark).conf.get("spark.sql.hive.filesourcePartitionFileCacheSize") == "0"


def test_the_stream_query_deals_images_to_folders(spark, sf_dir, monkeypatch):
    whole = sorted(QUERIES["t1_stream"](spark, sf_dir).collect())
    monkeypatch.setattr(files, "BATCH_FILES", 200)
    taken, start_each = [], files.start_each
    monkeypatch.setattr(files, "start_each", lambda spark, folders, *a: (taken.extend(len(os.listdir(f.removeprefix("file:"))) for f in folders), start_each(spark, folders, *a)))
    assert sorted(QUERIES["t1_stream"](spark, sf_dir).collect()) == whole and len(whole) == 500
    assert len(taken) == 3 and all(taken)


def test_damaged_pngs_are_rows_not_crashes(spark):
    rnd, whole = random.Random(3), png.encode(gradient(9, 9))
    bad = []
    for _ in range(30):
        b = bytearray(whole)
        b[rnd.randrange(8, len(b))] ^= 1 << rnd.randrange(8)
        bad.append(bytes(b[: rnd.randrange(8, len(b))]))
    rows = Pipeline.from_buffers(spark, bad).to_buffer("png").collect()
    assert len(rows) == 30 and all(r.output is not None or r.code in ("E131", "E111", "E121", "E122") for r in rows)


def test_small_images_are_dealt_to_tasks(spark):
    """A few bytes of pixels are encoded in several tasks, and a stream's files are listed by a few, with all other settings kept."""
    told = {"opaque": F.lit(True)} | {c: F.lit(0.0) for c in ("decodeMs", "decodeCpu", "decoded")}
    data = spark.range(40).select(F.col("id").alias("image_id"), F.array_repeat(F.col("id").cast("int"), 4).alias("data"))
    made = batch.encoded(pixel_rows.from_samples(data, 2, 2, 1, "data").withColumns(told), "png", 1, None)
    dealt = made.select("pos", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.pos for r in dealt) == list(range(40)) and len({r.task for r in dealt}) > 1
    own = files.session(spark)
    assert int(own.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == files.LISTING_TASKS
    assert all(own.conf.get(k) == spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.checkpoint.dir"))
