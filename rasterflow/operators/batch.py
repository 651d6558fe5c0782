"""Batches: one image a row, errors as rows. Python only takes files apart and puts them together: PNG is decoded here, JPEG by
the JVM's reader, and what a plan does to pixels are Spark's operators on row arrays, for images of any sizes at once."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, headers, rules
from ..functions.errors import ImageError, with_errors
from ..functions.errors import message as error_text
from ..plans import ops as plan
from ..plans.metadata import icc_of, valid_profile
from ..sources import containers, files, jpeg, png
from ..sources.sink import write_files
from . import rows as pixel_rows

RESULT = "pos long, source string, success boolean, error string, outputPath string, errorCode string, errorCategory int"
METRICS = "decodeMs double, opsMs double, encodeMs double, cpuTime double, rss long, bytesIn long, bytesOut long, formatIn string, formatOut string, iccPreserved boolean, metadataStripped boolean, policyViolations array<string>, width int, height int"


def images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(pos, source, at, content, length) of each path or URI, in the order given; one that is blank or not there has a null
    content. Names are looked up through Hadoop's file systems, files are read by Spark."""
    at = {p: next(iter(files.found(spark, p)), None) for p in dict.fromkeys(paths)}
    listed = spark.createDataFrame([(i, p, at[p]) for i, p in enumerate(paths)], "pos long, source string, at string")
    return files.contents(spark, listed, [u for u in at.values() if u])


def buffers(spark: SparkSession, data: list[bytes]) -> DataFrame:
    """The same of bytes that the caller holds. The JVM reads JPEG from files only, so those are put into the shared folder."""
    folder = files.shared_folder(spark, "buffers") if any(sniff(b) == "jpeg" for b in data) else None
    at = [files.put(spark, f"{folder}/{i}", b) if sniff(b) == "jpeg" else None for i, b in enumerate(data)]
    rows = [(i, f"memory:{i}", at[i], bytes(b), len(b)) for i, b in enumerate(data)]
    return spark.createDataFrame(rows, "pos long, source string, at string, content binary, length long")


def sniff(data: bytes) -> str | None:
    """The same magic bytes as headers.image_format, for code that holds the bytes."""
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == png.SIGNATURE:
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp" and (data[8:12] in (b"avif", b"avis") or any(data[i : i + 4] in (b"avif", b"avis") for i in range(16, min(int.from_bytes(data[:4], "big"), len(data)), 4))):
        return "avif"
    return None


def header_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) as the header names them, before any pixel is looked at; null where it names none."""
    try:
        return {"png": png.size, "jpeg": jpeg.size, "webp": containers.webp_size}.get(sniff(data), lambda _: None)(data)
    except jpeg.Broken:
        return None


def guard(data: bytes, policy: dict) -> bytes | None:
    """The checks that come before decoding, on bytes, profile and header; returns the profile. Whether it is valid is
    asked by policies that have a rule for profiles."""
    if policy.get("max_bytes") and len(data) > policy["max_bytes"]:
        raise ImageError("E123", f"{len(data)} bytes are over the limit")
    profile = icc_of(data)
    if profile is not None and (policy.get("reject_metadata") or policy.get("metadata_max_bytes")):
        if not valid_profile(profile):
            raise ImageError("E131", "the embedded color profile is none")
        if policy.get("reject_metadata") or (policy.get("metadata_max_bytes") and len(profile) > policy["metadata_max_bytes"]):
            raise ImageError("E123", "the policy rejects the color profile")
    size = header_size(data)
    if size:
        w, h = size
        if max(w, h) > rules.MAX_SIDE:
            raise ImageError("E121", f"{w}x{h}")
        if w * h > rules.MAX_PIXELS:
            raise ImageError("E122", f"{w}x{h}")
        if policy.get("max_pixels") and w * h > policy["max_pixels"]:
            raise ImageError("E123", f"{w * h} pixels are over the limit")
    elif sniff(data) not in (None, "avif"):
        raise ImageError("E131", "the header names no size")
    return profile


def guarded(df: DataFrame, policy: dict | None = None) -> DataFrame:
    """df (content) with the code of the check that stops an image before it is decoded, or null."""

    @F.pandas_udf("string")
    def code(contents: pd.Series) -> pd.Series:
        found = []
        for c in contents:
            try:
                guard(bytes(c or b""), policy or {})
                found.append(None if c is not None else "E100")
            except ImageError as e:
                found.append(e.code)
        return pd.Series(found, dtype=object)

    return df.withColumn("code", code("content"))


def look(data: bytes, policy: dict, keep_icc: bool, auto_orient: bool) -> dict:
    """What an image is, from its bytes and header; ImageError where it is not to be decoded."""
    profile, kind = guard(data, policy), sniff(data)
    if kind not in ("png", "jpeg"):
        raise ImageError("E111" if kind is None else "E131", f"no decoder for {kind or 'this format'} here")
    if kind == "jpeg":
        try:
            jpeg.check(data)
        except jpeg.Broken as e:
            raise ImageError("E131", f"JPEG does not decode: {e}") from None
    turn = jpeg.orientation(data) if auto_orient and kind == "jpeg" else None
    w, h = header_size(data)
    return {"kind": kind, "w": w, "h": h, "turn": turn or 1, "icc": profile is not None, "profile": profile if keep_icc else None}


HEAD = "pos long, source string, at string, bytesIn long, kind string, w long, h long, turn int, icc boolean, profile binary, fallback boolean, code string, message string"


def heads(df: DataFrame, policy: dict, keep_icc: bool, auto_orient: bool) -> DataFrame:
    """HEAD of each image, before any pixel is looked at. fallback: a PNG that this decoder does not take, which the JVM may."""
    names = [c.split()[0] for c in HEAD.split(", ")]
    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (c.split() for c in HEAD.split(", "))])

    def one(pos: int, source: str, at: str | None, data: bytes | None) -> dict:
        row = dict.fromkeys(names) | {"pos": pos, "source": source, "at": at, "fallback": False}
        try:
            if data is None:
                raise ImageError("E100" if source.strip() else "E400", "no such file")
            row |= {"bytesIn": len(data)} | look(data, policy, keep_icc, auto_orient)
            row["fallback"] = row["kind"] == "png" and not png.readable(data)
        except ImageError as e:
            row |= {"code": e.code, "message": str(e).partition("] ")[2]}
        except Exception as e:
            row |= {"code": "E901", "message": repr(e)}
        return row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield pa.RecordBatch.from_pylist([one(*(b.column(c)[i].as_py() for c in ("pos", "source", "at", "content")))], kinds)

    return df.select("pos", "source", "at", "content").mapInArrow(work, HEAD)


ROWS = "image_id long, w long, h long, n long, y long, x0 long, p array<array<int>>, opaque boolean, decodeMs double, decodeCpu double, decoded double"
_ROWS = pa.schema([(c, pa.int64()) for c in ("image_id", "w", "h", "n", "y", "x0")] + [("p", pa.list_(pa.list_(pa.int32()))), ("opaque", pa.bool_()), ("decodeMs", pa.float64()), ("decodeCpu", pa.float64()), ("decoded", pa.float64())])
#: Images that are to be turned, 12 bytes each, up to which the list of them is broadcast.
BROADCAST_TURNS = 100_000
#: Samples that a task hands on at once.
HANDED = 1 << 20


def as_rows(pos: int, px: np.ndarray, ms: float, cpu: float) -> Iterator[pa.RecordBatch]:
    """Samples (height, width, channels) of one image as row arrays."""
    h, w, n = px.shape
    opaque = n in (1, 3) or bool((px[..., -1] == 255).all())
    step = max(1, HANDED // (w * n))
    for y in range(0, h, step):
        part = np.ascontiguousarray(px[y : y + step].transpose(0, 2, 1), np.int32)
        m = len(part)
        planes = pa.ListArray.from_arrays(pa.array(np.arange(m * n + 1) * w, pa.int32()), pa.array(part.reshape(-1)))
        p = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * n, pa.int32()), planes)
        same = [pa.array(np.full(m, v)) for v in (pos, w, h, n)]
        told = [pa.array(np.full(m, v), pa.float64()) for v in (ms, cpu, time.time())]
        yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(y, y + m)), pa.array(np.zeros(m, np.int64)), p, pa.array([opaque] * m), *told], schema=_ROWS)


def _timed(pos: int, read) -> Iterator[pa.RecordBatch]:
    """The rows of what read() gives; nothing where it fails, which is found out when no output comes of the image."""
    began, cpu = time.perf_counter(), time.process_time()
    try:
        px = read()
    except Exception:  # a damaged file may fail anywhere in it
        return
    yield from as_rows(pos, px, (time.perf_counter() - began) * 1000, time.process_time() - cpu)


def png_rows(df: DataFrame, of: DataFrame) -> DataFrame:
    """ROWS of the images of df that `of` (pos) names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                data = b.column("content")[i].as_py()
                yield from _timed(b.column("pos")[i].as_py(), lambda data=data: png.decode(data))

    return df.select("pos", "content").join(of, "pos", "left_semi").mapInArrow(work, ROWS)


def jvm_rows(spark: SparkSession, uris: list[str], of: DataFrame) -> DataFrame:
    """ROWS of the images at the URIs through Spark's image source, for each of `of` (pos, at). What it can't read has a width
    of -1 and gives no rows. Luma comes as RGB, as an encoder of JPEG takes it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                w, h, n, data = (b.column(c)[i].as_py() for c in ("width", "height", "nChannels", "data"))

                def read() -> np.ndarray:
                    px = np.frombuffer(data, np.uint8).reshape(h, w, n)
                    return np.repeat(px, 3, 2) if n == 1 else px[..., (2, 1, 0, 3)[:n]]

                yield from _timed(b.column("pos")[i].as_py(), read)

    found = spark.read.format("image").load([files.escaped(u) for u in uris]).select("image.*").filter("width > 0 AND nChannels IN (1, 3, 4)")
    # the source names its files with signs written out, a plus apart
    found = found.withColumn("origin", F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))))
    named = found.join(of.select("pos", "at"), files.plain("origin") == files.plain("at"))
    return named.select("pos", "width", "height", "nChannels", "data").mapInArrow(work, ROWS)


Frame = tuple[DataFrame, DataFrame]


def lowered(frame: Frame, op: plan.Op) -> Frame:
    """One operation on (pixel rows, sizes): sizes has w, h and code of each image. An image for which the operation is wrong gets
    a code, and its rows go."""
    px, sizes = frame
    w, h = F.col("w"), F.col("h")
    tw, th = (F.lit(v).cast("long") for v in (op.width, op.height))

    def to(change, error: Column | None, ww: Column, hh: Column) -> Frame:
        left = px if error is None else px.filter(error.isNull())
        told = sizes if error is None else sizes.withColumn("code", F.coalesce("code", error))
        return change(left), told.withColumns({"w": ww, "h": hh})

    if op.op == "resize":
        ww, hh = geometry.resized(w, h, tw, th, op.fit)
        error = geometry.resize_error(ww, hh)
        live = sizes.filter(F.col("code").isNull() & error.isNull())
        if op.fit == "cover" and None not in (op.width, op.height):
            return to(lambda r: pixel_rows.cover(r, tw, th, F.col("opaque"), live), error, tw, th)
        return to(lambda r: pixel_rows.resample(r, ww, hh, opaque=F.col("opaque"), sizes=live), error, ww, hh)
    if op.op == "extract":
        cw, ch = F.lit(op.crop_width), F.lit(op.crop_height)
        error = geometry.extract_window(w, h, tw, th, op.fit, F.lit(op.x), F.lit(op.y), cw, ch)["error"]
        live = sizes.filter(F.col("code").isNull() & error.isNull())
        return to(lambda r: pixel_rows.extract(r, tw, th, op.fit, F.lit(op.x), F.lit(op.y), cw, ch, F.col("opaque"), live), error, geometry.big(cw), geometry.big(ch))
    if op.op == "crop":
        x, y, cw, ch = (F.lit(v).cast("long") for v in (op.x, op.y, op.crop_width, op.crop_height))
        return to(lambda r: pixel_rows.crop(r, x, y, cw, ch), geometry.crop_error(w, h, x, y, cw, ch), cw, ch)
    if op.op == "rotate":
        o = geometry.TURNS[op.degrees]
        return to(lambda r: pixel_rows.reorient(r, F.lit(o), 5 <= o <= 8), None, *geometry.oriented(w, h, F.lit(o)))
    if op.op == "auto_orient":
        o = F.col("turn") if op.orientation is None else F.lit(op.orientation)
        return to(lambda r: pixel_rows.reorient(r, o), None, *geometry.oriented(w, h, o))
    change = {
        "flip_h": pixel_rows.flip_h, "flip_v": pixel_rows.flip_v, "grayscale": pixel_rows.grayscale, "normalize": pixel_rows.normalize,
        "brightness": lambda r: pixel_rows.brightness(r, op.value), "contrast": lambda r: pixel_rows.contrast(r, op.value),
    }[op.op]
    return to(change, None, w, h)


#: Operations after which a row may be in stretches, and those that read whole ones.
_PARTS, _WHOLE = ("resize", "extract", "rotate", "auto_orient"), ("resize", "extract")


def run_plan(frame: Frame, ops: tuple[plan.Op, ...]) -> Frame:
    parted = False
    for op in ops:
        if parted and op.op in _WHOLE:
            frame = pixel_rows.whole_rows(frame[0]), frame[1]
        frame = lowered(frame, op)
        parted = parted and op.op not in _WHOLE or op.op in _PARTS
    return frame


OUTPUT = "pos long, output binary, bad string, why string, decodeMs double, opsMs double, encodeMs double, cpuTime double, rss long, width int, height int"
_OUTPUT = pa.schema([("pos", pa.int64()), ("output", pa.binary()), ("bad", pa.string()), ("why", pa.string()), *((c, pa.float64()) for c in ("decodeMs", "opsMs", "encodeMs", "cpuTime")), ("rss", pa.int64()), ("width", pa.int32()), ("height", pa.int32())])


def encoded(px: DataFrame, fmt: str, level: int, timeout_ms: int | None) -> DataFrame:
    """OUTPUT of each image of pixel rows, gathered by image. opsMs is the time between an image's decoding and its encoding,
    waits included; cpuTime that of the worker on both, in seconds; rss the worker's peak."""

    def one(t: pa.Table) -> dict:
        began, cpu = time.perf_counter(), time.process_time()
        pos, w, h, n = (t.column(c)[0].as_py() for c in ("image_id", "w", "h", "n"))
        decode_ms, waited = t.column("decodeMs")[0].as_py(), max(0.0, (time.time() - max(t.column("decoded").to_pylist())) * 1000)
        row = {"pos": pos, "output": None, "bad": None, "why": None, "decodeMs": decode_ms, "opsMs": waited, "width": w, "height": h}
        if fmt != "png":
            return row | {"bad": "E300", "why": f"no encoder for {fmt} here"}
        px = np.zeros((h, w, n), np.uint8)
        for at, x0, planes in zip(t.column("y").to_pylist(), t.column("x0").to_pylist(), t.column("p")):
            stretch = np.asarray(planes.values.flatten()).reshape(n, -1)
            px[at, x0 : x0 + stretch.shape[1]] = stretch.T
        out = png.encode(px, level=level)
        took = (time.perf_counter() - began) * 1000
        for stage, ms in (("decode", decode_ms), ("process", decode_ms + waited), ("encode", decode_ms + waited + took)):
            if timeout_ms and ms > timeout_ms:
                return row | {"bad": "E123", "why": f"over the time limit after {stage}"}
        return row | {"output": out, "encodeMs": took, "cpuTime": t.column("decodeCpu")[0].as_py() + time.process_time() - cpu, "rss": peak_rss()}

    def work(t: pa.Table) -> pa.Table:
        try:
            row = one(t)
        except Exception as e:
            row = {"pos": t.column("image_id")[0].as_py(), "bad": "E901", "why": repr(e)}
        return pa.Table.from_pylist([row], _OUTPUT)

    # dealt by number: small images come to few bytes, by which all of them would be put into one task
    return px.repartition(tasks_of(px.sparkSession), "image_id").groupBy("image_id").applyInArrow(work, OUTPUT)


def tasks_of(spark: SparkSession) -> int:
    """Tasks of a shuffle whose work goes by rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def rewrapped(df: DataFrame, of: DataFrame, keep_icc: bool, keep_exif: bool, reset: bool, strip_gps: bool) -> DataFrame:
    """OUTPUT of JPEGs that stay JPEG with nothing to do: their samples stay, only metadata are written anew."""

    def one(pos: int, data: bytes) -> dict:
        began, cpu = time.perf_counter(), time.process_time()
        tiff = jpeg.exif(data) if keep_exif else None
        out = jpeg.rewritten(data, icc_of(data) if keep_icc else None, tiff and jpeg.sanitised(tiff, reset, strip_gps))
        w, h = header_size(data)
        return {"pos": pos, "output": out, "decodeMs": 0.0, "opsMs": 0.0, "encodeMs": (time.perf_counter() - began) * 1000, "cpuTime": time.process_time() - cpu, "rss": peak_rss(), "width": w, "height": h}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                pos = b.column("pos")[i].as_py()
                try:
                    row = one(pos, b.column("content")[i].as_py())
                except Exception as e:
                    row = {"pos": pos, "bad": "E901", "why": repr(e)}
                yield pa.RecordBatch.from_pylist([row], _OUTPUT)

    return df.select("pos", "content").join(of, "pos", "left_semi").mapInArrow(work, OUTPUT)


def peak_rss() -> int:
    """Peak memory of this worker in bytes."""
    import resource

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def _with_profile(data: str, profile: str) -> Column:
    @F.pandas_udf("binary")
    def put(data: pd.Series, profile: pd.Series) -> pd.Series:
        return pd.Series([d if d is None or p is None else png.with_icc(bytes(d), bytes(p)) for d, p in zip(data, profile)])

    return put(data, profile)


def process(df: DataFrame, ops: tuple[plan.Op, ...], fmt: str, policy: dict | None = None, keep_icc: bool = False, auto_orient: bool = True, keep_exif: bool = False, strip_gps: bool = True, fast: bool = False) -> DataFrame:
    """df (pos, source, content, at): (pos, source, output binary, code, message, and the METRICS columns). Nothing that is
    wrong with one image stops the others. The cheap checks on bytes and header run now, as they say which files the JVM is to
    read; pixels are worked on when the result is read. fast: less effort at compressing."""
    spark, policy = df.sparkSession, policy or {}
    plan.check(ops)
    if "at" not in df.columns:
        df = df.withColumn("at", F.lit(None).cast("string"))
    head = files.kept(heads(df, policy, keep_icc, auto_orient))
    good = head.filter("code IS NULL")
    stays = (F.col("kind") == fmt) & (F.col("kind") == "jpeg") & (F.col("turn") == 1) & F.lit(not ops)
    todo = good.filter(~stays)
    by_jvm = (F.col("kind") == "jpeg") | F.col("fallback")
    uris = [r.at for r in todo.filter(by_jvm & F.col("at").isNotNull()).select("at").distinct().collect()]
    turns = {r.turn for r in todo.select("turn").distinct().collect()}
    px = png_rows(df, todo.filter(~by_jvm).select("pos"))
    if uris:
        px = px.union(jvm_rows(spark, uris, todo.filter(by_jvm)))
    if turns - {1}:
        turned = todo.filter("turn <> 1").select(F.col("pos").alias("image_id"), "turn")
        px = px.join(F.broadcast(turned) if turned.count() <= BROADCAST_TURNS else turned, "image_id", "left")
        ops = (plan.Op("auto_orient"), *ops)
    sizes = head.select("pos", "w", "h", "turn", "code")
    px, sizes = run_plan((px, sizes), plan.rewrite(ops))
    done = encoded(px, fmt, 1 if fast else 6, policy.get("timeout_ms"))
    if fmt == "jpeg" and not ops:
        done = done.union(rewrapped(df, good.filter(stays).select("pos"), keep_icc, keep_exif, auto_orient, strip_gps))
    both = head.drop("w", "h", "code").join(sizes.select("pos", "code"), "pos").join(done, "pos", "left")
    code = F.coalesce("code", "bad", F.when(F.col("output").isNull(), "E131"))
    output = F.when(code.isNull(), _with_profile("output", "profile") if keep_icc and fmt == "png" else F.col("output"))
    both = both.withColumns({"output": output, "message": F.when(code.isNotNull(), F.coalesce("message", "why", F.when(F.col("code").isNotNull(), "the operation does not fit the image"), F.lit("the image does not decode"))), "code": code})
    ok = F.col("code").isNull()
    kept = F.lit(keep_icc) & F.col("icc")
    told = {"bytesOut": F.octet_length("output").cast("long"), "formatIn": F.col("kind"), "formatOut": F.lit(fmt), "iccPreserved": kept, "metadataStripped": F.col("icc") & ~kept, "policyViolations": F.array().cast("array<string>")}
    names = [c.split()[0] for c in METRICS.split(", ")]
    both = both.withColumns(told)
    return both.select("pos", "source", "output", "code", "message", *(F.when(ok, F.col(n)).alias(n) for n in names))


def check_folder(path: str) -> None:
    if not path.strip():
        raise ImageError("E400", "a blank output folder")


def check_output(spark: SparkSession, path: str) -> None:
    """An output path is not blank, and its folder is there."""
    if not str(path).strip():
        raise ImageError("E400", "a blank output path")
    if not files.folder_exists(spark, files.parent(spark, path)):
        raise ImageError("E400", f"no folder to write {path} in")


def process_batch(spark: SparkSession, inputs: list[str], out_dir: str, fmt: str | Mapping, ops: tuple[plan.Op, ...] = (), quality: int | None = None, concurrency: int = 0, policy: dict | None = None, keep_icc: bool = False, fast: bool = False) -> DataFrame:
    """RESULT rows, one per input and ordered like them. Outputs are written now, once: all are in out_dir, a folder of any store,
    when this returns, or none if the job failed. fmt: a format, or a mapping of format, quality, fastMode and concurrency. An
    input whose output would have the name of an earlier one's is an error row, and nothing is overwritten."""
    check_folder(out_dir)
    if isinstance(fmt, Mapping):
        quality, concurrency, fast, fmt = fmt.get("quality", quality), fmt.get("concurrency", concurrency), bool(fmt.get("fastMode", fast)), fmt.get("format")
    plan.quality(quality)
    if not isinstance(concurrency, int) or concurrency < 0:
        raise ImageError("E400", f"concurrency {concurrency!r}")
    if concurrency > 1024:
        raise ImageError("E901", f"concurrency {concurrency}")
    if str(fmt).lower() not in rules.OUTPUT_FORMATS:
        raise ImageError("E111", f"unknown format {fmt!r}")
    fmt = {"jpg": "jpeg"}.get(fmt.lower(), fmt.lower())
    folder = files.make_folder(spark, out_dir)
    path = F.concat(F.lit(folder.rstrip("/") + "/"), rules.output_name(F.col("source"), F.lit(fmt)))
    listed = spark.createDataFrame(list(enumerate(inputs)), "pos long, source string").withColumn("outputPath", path)
    # names alone decide, before any image is read
    first = listed.groupBy("outputPath").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    read = images(spark, inputs)
    done = process(read.coalesce(concurrency) if concurrency else read, ops, fmt, policy, keep_icc, fast=fast).join(listed.drop("source").join(first, "pos", "left"), "pos")
    again = F.col("code").isNull() & F.col("first").isNull()
    done = done.withColumns({"code": F.when(again, "E400").otherwise(F.col("code")), "message": F.when(again, "an earlier input has the same output name").otherwise(F.col("message"))})
    saved = with_errors(write_files(done, folder, ":" not in out_dir), "code")
    error = F.when(F.col("code").isNotNull(), error_text(F.col("code"), F.col("source"), F.col("message")))
    return saved.select("pos", "source", F.col("code").isNull().alias("success"), error.alias("error"), "outputPath", F.col("code").alias("errorCode"), F.col("category").alias("errorCategory")).orderBy("pos")


def inspect(df: DataFrame) -> DataFrame:
    """df (content): width, height and format from the header alone, for PNG and WebP by expressions, and for JPEG by
    its markers; error E131 where there are none."""

    @F.pandas_udf("struct<w:int,h:int>")
    def jpeg_size(contents: pd.Series) -> pd.DataFrame:
        found = []
        for c in contents:
            try:
                found.append(jpeg.size(bytes(c)) or (None, None))
            except (jpeg.Broken, TypeError):
                found.append((None, None))
        return pd.DataFrame(found, columns=["w", "h"]).astype("Int32")

    data = F.col("content")
    (pw, ph), (ww, wh) = headers.png_size(data), headers.webp_size(data)
    df = df.withColumn("format", headers.image_format(data)).withColumn("j", F.when(F.col("format") == "jpeg", jpeg_size(F.when(F.col("format") == "jpeg", data))))
    df = df.withColumn("width", F.coalesce(pw, ww, F.col("j.w")).cast("int")).withColumn("height", F.coalesce(ph, wh, F.col("j.h")).cast("int")).drop("j")
    return df.withColumn("error", F.when(F.col("width").isNull() | F.col("height").isNull(), "E131"))


