"""Row-array operators and the engine on them against numpy, on images of mixed sizes; JPEG through the JVM; the sink."""

import math
import os
import pickle
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rasterflow.functions.geometry import TURNS
from rasterflow.operators import batch, dct
from rasterflow.operators import rows as ra
from rasterflow.plans import ops as plan
from rasterflow.plans.pipeline import Pipeline
from rasterflow.sources import files, jpeg, png, sink


def noise(w, h, n, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, n), dtype=np.uint8)


def lanczos(t):
    t = abs(t)
    return 1.0 if t < 1e-12 else 0.0 if t >= 3 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2


def axis(px, size, start, length, most):
    """Rows of px at `size`, from the window; px holds floats."""
    out = []
    for d in range(size):
        scale = length / size
        centre, wide = start + (d + 0.5) * scale, max(scale, 1.0)
        k = np.array([lanczos((s + 0.5 - centre) / wide) if abs(s + 0.5 - centre) < 3 * wide + 1 else 0.0 for s in range(len(px))])
        w = np.floor(k / k.sum() * 16384 + 0.5)
        out.append(np.clip(np.floor((np.tensordot(w, px, 1) + 8192) / 16384), 0, most))
    return np.array(out)


def scaled(px, w, h, window=None):
    px = {1: lambda: np.repeat(px, 3, 2), 2: lambda: px[..., (0, 0, 0, 1)]}.get(px.shape[2], lambda: px)()
    if (w, h) == px.shape[1::-1] and window is None:
        return px
    x, y, dx, dy = window or (0, 0, px.shape[1], px.shape[0])
    v, veiled = px.astype(float), px.shape[2] == 4
    if veiled:
        v = np.concatenate([v[..., :3] * v[..., 3:], v[..., 3:] * 255], 2)
    most = math.inf if veiled else 255
    if not w or not h:
        return np.zeros((h, w, 3), np.uint8)
    v = axis(axis(v.transpose(1, 0, 2), w, x, dx, most).transpose(1, 0, 2), h, y, dy, most)
    if veiled:
        a = np.minimum(v[..., 3:], 65025)
        v = np.concatenate([np.where(a > 0, np.floor(v[..., :3] * 255 / np.maximum(a, 1) + 0.5), 0), np.floor(a / 255 + 0.5)], 2)
    return np.clip(v, 0, 255).astype(np.uint8)


def upright(px, o):
    px = px.transpose(1, 0, 2) if o >= 5 else px
    return px[:: -1 if o in (3, 4, 7, 8) else 1, :: -1 if o in (2, 3, 6, 7) else 1]


def applied(px, op):
    h, w, n = px.shape
    if op.op == "resize":
        if op.fit == "cover":
            k = max(op.width / w, op.height / h)
            rw, rh = max(1, math.ceil(w * k)), max(1, math.ceil(h * k))
            return scaled(px, op.width, op.height, None if (w, h) == (op.width, op.height) else ((rw - op.width) // 2 * w / rw, (rh - op.height) // 2 * h / rh, op.width * w / rw, op.height * h / rh))
        return scaled(px, *((op.width, op.height) if op.fit == "fill" else plan.inside_size(w, h, op.width, op.height)))
    if op.op == "crop":
        return px[op.y : op.y + op.crop_height, op.x : op.x + op.crop_width]
    if op.op in ("rotate", "auto_orient"):
        return upright(px, TURNS[op.degrees] if op.op == "rotate" else op.orientation)
    if op.op in ("flip_h", "flip_v"):
        return px[:, ::-1] if op.op == "flip_h" else px[::-1]
    if op.op == "grayscale":
        return px[..., :1] if n < 3 else (px[..., :3].astype(int) @ np.array([2126, 7152, 722]) // 10000)[..., None].astype(np.uint8)
    if op.op == "normalize":
        return px if n >= 3 else np.repeat(px[..., :1], 3, 2)
    v = px.astype(float)
    out = np.clip(v + op.value if op.op == "brightness" else np.floor(((v / 255 - 0.5) * ((100.0 + op.value) / 100.0) ** 2 + 0.5) * 255), 0, 255).astype(np.uint8)
    if n in (2, 4):
        out[..., -1] = px[..., -1]
    return out


SIZES = [(70, 40, 3), (130, 3, 4), (1, 90, 1), (64, 64, 2), (65, 129, 3), (5, 5, 4)]


@pytest.fixture(scope="module")
def frame(spark):
    """Row arrays of images of mixed sizes and layouts."""
    import pyarrow as pa

    parts = [b for i, (w, h, n) in enumerate(SIZES) for b in batch.as_rows(i, noise(w, h, n, i), 0.0, 0.0)]
    px = spark.createDataFrame(pa.Table.from_batches(parts).select(["image_id", "w", "h", "n", "y", "x0", "p", "opaque"])).repartition(3).cache()
    sizes = spark.createDataFrame([(i, w, h, None) for i, (w, h, _) in enumerate(SIZES)], "pos long, w long, h long, code string")
    return px, sizes


def assembled(px):
    out = {}
    for r in px.collect():
        img = out.setdefault(r.image_id, np.full((r.h, r.w, r.n), -1))
        part = np.array(r.p)
        img[r.y, r.x0 : r.x0 + part.shape[1]] = part.T
    return out


QUEUES = [
    [plan.resize(33, 20, "fill")], [plan.resize(30, 30, "cover")], [plan.resize(20)], [plan.resize(None, 77)], [plan.rotate(90)], [plan.rotate(-90)], [plan.rotate(180)], [plan.Op("grayscale"), plan.Op("normalize")],
    [plan.brightness(40), plan.contrast(-30), plan.Op("flip_h"), plan.Op("flip_v")], [plan.resize(70, 40, "fill"), plan.rotate(270), plan.crop(3, 5, 30, 61), plan.resize(11, 13, "fill")], *[[plan.Op("auto_orient", orientation=o)] for o in (5, 7)],
]


@pytest.mark.parametrize("queue", QUEUES, ids=lambda q: "-".join(f"{o.op}{o.degrees or o.fit or o.orientation or ''}" for o in q))
def test_plans_on_mixed_sizes(frame, queue):
    px, sizes = batch.run_plan(frame, tuple(queue))
    got = assembled(px)
    for i, (w, h, n) in enumerate(SIZES):
        exp = noise(w, h, n, i)
        for op in queue:
            exp = applied(exp, op)
        if 0 in exp.shape:
            assert i not in got
            continue
        assert got[i].shape == exp.shape and (got[i] == exp).all(), i
    assert {(r.pos, r.w, r.h) for r in sizes.filter("code IS NULL").collect()} == {(i, *x.shape[1::-1]) for i, x in got.items()}


def test_what_does_not_fit_is_left_out(frame):
    px, sizes = batch.run_plan(frame, (plan.crop(2, 2, 60, 30), plan.Op("flip_h")))
    fine = {i for i, (w, h, _) in enumerate(SIZES) if w >= 62 and h >= 32}
    assert {r.pos for r in sizes.filter("code IS NULL").collect()} == fine == set(assembled(px)) and {r.code for r in sizes.collect()} == {None, "E200"}
    px, sizes = batch.run_plan(frame, (plan.resize(1, 1),))
    assert sizes.filter("code = 'E203'").count() > 0 and len(assembled(px)) == sizes.filter("code IS NULL").count()


def test_one_exchange(frame):
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    px, sizes = frame
    assert "Exchange hashpartitioning" not in plan_of(ra.flip_h(ra.brightness(ra.grayscale(px), 5)))
    one = plan_of(ra.resample(px, F.lit(9), F.lit(9), sizes=sizes))
    assert one.count("Exchange hashpartitioning(image_id") == 1
    assert plan_of(ra.pixel_hash(px)).count("Exchange hashpartitioning") == 1


def test_coefficients(frame):
    """Every block of images of mixed sizes, edges repeated, against a transform of whole blocks."""
    b = np.array(dct.basis())
    assert np.abs(b @ b.T / dct.ONE**2 - np.eye(8)).max() < 1e-3 and dct.zigzag()[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    for quality in (10, 50, 93):
        scale = 5000 // quality if quality < 50 else 200 - 2 * quality
        table = np.clip((np.array(dct.LUMA) * scale + 50) // 100, 1, 255)
        got = {(r.image_id, r.block_y, r.block_x): r.coefficients for r in dct.coefficients(frame[0], F.lit(quality)).collect()}
        exp = {}
        for i, (w, h, n) in enumerate(SIZES):
            px = np.pad(noise(w, h, n, i)[..., 0].astype(int), ((0, -h % 8), (0, -w % 8)), "edge") - 128
            for y in range(0, len(px), 8):
                for x in range(0, px.shape[1], 8):
                    s = (b @ px[y : y + 8, x : x + 8] @ b.T).reshape(-1)
                    d = table * dct.ONE**2
                    exp[i, y // 8, x // 8] = (np.sign(s) * ((2 * np.abs(s) + d) // (2 * d)))[dct.zigzag()].tolist()
        assert got == exp


def java_image(spark, px):
    h, w, n = px.shape
    im = spark._jvm.java.awt.image.BufferedImage(w, h, 10 if n == 1 else 5)  # TYPE_BYTE_GRAY, TYPE_3BYTE_BGR
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in (px[y, x] if n == 3 else px[y, x, [0, 0, 0]]))
            im.setRGB(x, y, r << 16 | g << 8 | b)
    return im


def write_jpeg(spark, path, px):
    assert spark._jvm.javax.imageio.ImageIO.write(java_image(spark, px), "jpg", spark._jvm.java.io.File(str(path)))


def smooth(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([40 + 3 * x, 60 + 2 * y, 120 + x + y], 2).astype(np.uint8)


def test_jpeg_through_the_jvm(spark, tmp_path):
    """Read, turned by its EXIF, resized, as a file and from memory; broken ones are E131."""
    px = smooth(40, 24)
    write_jpeg(spark, tmp_path / "a.jpg", px)
    data = (tmp_path / "a.jpg").read_bytes()
    import struct

    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    (tmp_path / "b [1].jpg").write_bytes(jpeg.with_exif(data, tiff))
    (tmp_path / "c.jpg").write_bytes(data[:120] + b"\0" * 300 + data[-40:])
    write_jpeg(spark, tmp_path / "g.jpg", px[..., :1])
    (tmp_path / "d.png").write_bytes(png.encode(px))
    names = [str(tmp_path / x) for x in ("a.jpg", "b [1].jpg", "c.jpg", "g.jpg", "d.png")] + [f"file:{tmp_path}/a.jpg"]
    rows = Pipeline.from_paths(spark, names).to_buffer("png").orderBy("pos").collect()
    assert [r.code for r in rows] == [None, None, "E131", None, None, None]
    got = [r.output and png.decode(bytes(r.output)).astype(int) for r in rows]
    near = lambda a, b: a.shape == b.shape and np.abs(a - b.astype(int)).max() <= 12
    assert near(got[0], px) and near(got[1], upright(px, 6)) and got[3].shape == (24, 40, 3) and (got[4] == px).all() and (got[5] == got[0]).all()
    memory = Pipeline.from_buffers(spark, [jpeg.with_exif(data, tiff), png.encode(px)])
    small = [png.decode(bytes(r.output)) for r in memory.resize(12).to_buffer("png").orderBy("pos").collect()]
    assert near(small[0], scaled(got[1].astype(np.uint8), 12, 20)) and (small[1] == scaled(px, 12, 7)).all()
    off = png.decode(bytes(memory.auto_orient(False).to_buffer("png").orderBy("pos").first().output))
    assert near(off, px)


def test_png_that_only_the_jvm_takes(spark, tmp_path):
    """A wrong checksum of an ancillary chunk stops this decoder, so the file goes to the JVM."""
    px = smooth(9, 5)
    whole = png.with_icc(png.encode(px), b"p" * 200)
    bad = bytearray(whole)
    bad[33 + 8 + 20] ^= 1
    assert png.readable(whole) and not png.readable(bytes(bad))
    (tmp_path / "a.png").write_bytes(bytes(bad))
    head = batch.heads(batch.images(spark, [str(tmp_path / "a.png")]), {}, False, True).first()
    assert head.fallback and head.code is None
    row = Pipeline.from_paths(spark, [str(tmp_path / "a.png")]).to_buffer("png").first()
    assert row.code == "E131" or (png.decode(bytes(row.output)) == px).all()


def test_what_has_no_decoder(spark):
    avif = b"\0\0\0\x14ftypavif\0\0\0\0avif"
    webp = b"RIFF" + (26).to_bytes(4, "little") + b"WEBPVP8X" + (10).to_bytes(4, "little") + bytes(4) + bytes([7, 0, 0, 7, 0, 0])
    rows = Pipeline.from_buffers(spark, [avif, webp, b"what"]).to_buffer("png").orderBy("pos").collect()
    assert [r.code for r in rows] == ["E131", "E131", "E111"]


def test_each_output_is_written_once(spark, tmp_path, monkeypatch):
    for i in range(6):
        (tmp_path / f"i{i}.png").write_bytes(png.encode(noise(8, 8, 3, i)))
    out = tmp_path / "out"
    done = batch.process_batch(spark, [str(tmp_path / f"i{i}.png") for i in range(6)], f"file:{out}", {"format": "png", "fastMode": True})
    names = sorted(f"i{i}.png" for i in range(6))
    assert sorted(os.listdir(out)) == names  # at once, and nothing else
    before = {n: os.stat(out / n).st_mtime_ns for n in names}
    time.sleep(0.05)
    assert done.count() == 6 and done.filter("success").count() == 6
    assert {n: os.stat(out / n).st_mtime_ns for n in names} == before


def test_a_failed_job_leaves_no_output(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    good = [(i, "s", f"file:{out}/f{i}", b"x" * i, None, None) for i in range(1, 20)]
    rows = spark.createDataFrame(good, sink.SCHEMA).repartition(4)
    bad = rows.withColumn("message", F.when(F.col("pos") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit(None).cast("string")))
    with pytest.raises(Exception):
        sink.write_files(bad, f"file:{out}")
    assert os.listdir(out) == []
    told = sink.write_files(rows, f"file:{out}").collect()
    assert sorted(os.listdir(out)) == sorted(f"f{i}" for i in range(1, 20)) and {r.bytes for r in told} == set(range(1, 20))


def test_the_driver_holds_no_list_of_outputs(spark, tmp_path):
    """What a task tells the driver doesn't grow with its files; attempts that don't count are neither moved nor reported."""
    (tmp_path / "out").mkdir()
    (tmp_path / "told").mkdir()
    writer = sink.Writer(f"file:{tmp_path}/out", f"file:{tmp_path}/told")
    rows = [Row(pos=i, source="s", outputPath=f"file:{tmp_path}/out/f{i}", output=b"x" * i, code=None if i else "E1", message=None) for i in range(300)]
    few, many, again = (writer.write(iter(r)) for r in (rows[:3], rows[3:], rows[3:]))
    assert len(pickle.dumps(few)) == len(pickle.dumps(many)) < 300
    assert len(os.listdir(tmp_path / "out")) == 596
    writer.commit([few, None, many])
    told = spark.read.schema(sink.REPORT).json(f"file:{tmp_path}/told").orderBy("pos").collect()
    assert [(r.pos, r.bytes, r.code) for r in told] == [(0, None, "E1"), *((i, i, None) for i in range(1, 300))]
    writer.abort([again])
    assert sorted(os.listdir(tmp_path / "out")) == sorted(f"f{i}" for i in range(1, 300))
    kept = sink.write_files(spark.createDataFrame([r.asDict() for r in rows], sink.SCHEMA), f"file:{tmp_path}/out")
    assert kept.count() == 300 and "LocalTableScan" not in kept._jdf.queryExecution().toString() and "LocalRelation" not in kept._jdf.queryExecution().toString()


def test_names_and_globs(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"1")
    (tmp_path / "b.png").write_bytes(b"2")
    assert len(files.found(spark, f"{tmp_path}/*.png")) == 2 and files.found(spark, str(tmp_path)) == [] and files.found(spark, "nosuch://x/y") == []
    rows = Pipeline.inspect_files(spark, [f"file://{tmp_path}/a.png", f"{tmp_path}/no.png", "hdfs://nowhere.invalid:1/x"]).collect()
    assert [r.error for r in rows] == ["E131", "E101", "E101"]
    assert batch.images(spark, [f"{tmp_path}/no.png"]).first().content is None
