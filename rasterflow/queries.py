"""Registered queries: every operator over frames derived from the driver's tables, and the SQL that must agree.

No table holds images, so headers come from documents, pixels from embeddings, profile segments from conversations,
telemetry from events, and argument grids from part. The derivations are the CTEs below and the functions beside them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import errors, geometry, headers, rules
from .operators import batch, dct, metrics, pixels, rows
from .plans import cost, metadata
from .plans import ops as plan
from .plans.pipeline import POLICY_FIELDS
from .sources import files, png
from .sources.sink import write_files
from .streaming import files as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h, bytes_in, format, orientation, quality) of one image per document."""
    d = F.col("doc_id")
    names = F.element_at(F.array(*(F.lit(x) for x in ("jpeg", "png", "webp", "avif", "gif"))), (d % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(
        d.alias("image_id"), (1 + d * 7919 % 9000).alias("w"), (1 + d * 104729 % 7000).alias("h"), (F.col("n_chars") * 2048).alias("bytes_in"),
        names.alias("format"), (1 + d % 8).cast("int").alias("orientation"), (d * 37 % 101).cast("int").alias("quality"))


HDR = """WITH hdr AS (SELECT doc_id AS image_id, 1 + doc_id * 7919 % 9000 AS w, 1 + doc_id * 104729 % 7000 AS h, n_chars * 2048 AS bytes_in,
    ['jpeg', 'png', 'webp', 'avif', 'gif'][doc_id % 5 + 1] AS format, CAST(1 + doc_id % 8 AS INTEGER) AS orientation, CAST(doc_id * 37 % 101 AS INTEGER) AS quality
    FROM documents WHERE doc_id IS NOT NULL) """


def px(spark: SparkSession, sf_dir: str, side: int = 8, channels: int = 1) -> DataFrame:
    """(image_id, y, x, c, v): one small image per vector."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    cell = geometry.div(F.col("i"), channels)
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col("e").cast("double") + 0.5) * 255).cast("int")))
    return e.select("image_id", geometry.div(cell, side).cast("int").alias("y"), (cell % side).cast("int").alias("x"), (F.col("i") % channels).cast("int").alias("c"), v.alias("v"))


def PX(side: int = 8, channels: int = 1) -> str:
    return f"""WITH e AS (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    px AS (SELECT image_id, CAST(i // {channels} // {side} AS INTEGER) AS y, CAST(i // {channels} % {side} AS INTEGER) AS x, CAST(i % {channels} AS INTEGER) AS c,
    CAST(greatest(0, least(255, round((e + 0.5) * 255))) AS INTEGER) AS v FROM e) """


RGBA = PX(4, 4)


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir, 4, 4)


def px_rows(spark: SparkSession, sf_dir: str, side: int = 8, channels: int = 1) -> DataFrame:
    """The same images as row arrays."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.round((e.cast("double") + 0.5) * 255).cast("int"))))
    return rows.from_samples(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), v.alias("data")), side, side, channels, "data")


def one_size(spark: SparkSession, side: int) -> DataFrame:
    return spark.range(1).select(F.lit(side).cast("long").alias("w"), F.lit(side).cast("long").alias("h"))


def scaled(spark: SparkSession, sf_dir: str, side: int, channels: int, w: int, h: int) -> DataFrame:
    return rows.to_long(rows.resample(px_rows(spark, sf_dir, side, channels), F.lit(w), F.lit(h), sizes=one_size(spark, side)))


# Geometry

INSIDE = """CASE WHEN {tw} IS NOT NULL AND {th} IS NOT NULL THEN CASE WHEN CAST(w AS DOUBLE) / h > CAST({tw} AS DOUBLE) / {th} THEN {tw} ELSE CAST(round(w * ({th} / CAST(h AS DOUBLE))) AS BIGINT) END
    WHEN {tw} IS NOT NULL THEN {tw} WHEN {th} IS NOT NULL THEN CAST(round(w * ({th} / CAST(h AS DOUBLE))) AS BIGINT) ELSE w END AS out_w,
    CASE WHEN {tw} IS NOT NULL AND {th} IS NOT NULL THEN CASE WHEN CAST(w AS DOUBLE) / h > CAST({tw} AS DOUBLE) / {th} THEN CAST(round(h * ({tw} / CAST(w AS DOUBLE))) AS BIGINT) ELSE {th} END
    WHEN {tw} IS NOT NULL THEN CAST(round(h * ({tw} / CAST(w AS DOUBLE))) AS BIGINT) WHEN {th} IS NOT NULL THEN {th} ELSE h END AS out_h"""


def _inside(tw: int | None, th: int | None) -> tuple[Query, str]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w, h = geometry.inside(F.col("w"), F.col("h"), *(F.lit(x).cast("long") for x in (tw, th)))
        return hdr(spark, sf_dir).select("image_id", w.alias("out_w"), h.alias("out_h"), (geometry.resize_error(w, h)).alias("error"))

    a, b = ("CAST(NULL AS BIGINT)" if x is None else str(x) for x in (tw, th))
    return run, HDR + f"SELECT *, CASE WHEN out_w = 0 OR out_h = 0 THEN 'E203' END AS error FROM (SELECT image_id, {INSIDE.format(tw=a, th=b)} FROM hdr)"


for _name, _size in {"g12_inside": (800, 600), "g12_width_only": (1200, None), "g12_height_only": (None, 700), "g12_neither": (None, None)}.items():
    QUERIES[_name], SQL[_name] = _inside(*_size)


@query(HDR + """SELECT image_id, greatest(CAST(ceil(w * s) AS BIGINT), 1) AS resize_w, greatest(CAST(ceil(h * s) AS BIGINT), 1) AS resize_h
    FROM (SELECT *, greatest(1600 / CAST(w AS DOUBLE), 900 / CAST(h AS DOUBLE)) AS s FROM hdr)""")
def g13_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geometry.cover(F.col("w"), F.col("h"), F.lit(1600), F.lit(900))
    return hdr(spark, sf_dir).select("image_id", w.alias("resize_w"), h.alias("resize_h"))


@query(HDR + """SELECT image_id, greatest(w - cw, 0) // 2 AS x, greatest(h - ch, 0) // 2 AS y, cw AS crop_w, ch AS crop_h
    FROM (SELECT *, greatest(least(1600, w), 1) AS cw, greatest(least(900, h), 1) AS ch FROM hdr)""")
def g14_center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = geometry.center_crop(F.col("w"), F.col("h"), F.lit(1600), F.lit(900))
    return hdr(spark, sf_dir).select("image_id", *(p.alias(n) for p, n in zip(parts, ("x", "y", "crop_w", "crop_h"))))


@query(HDR + f""", r AS (SELECT image_id, w, h, {INSIDE.format(tw="800", th="600")} FROM hdr)
    SELECT image_id, CASE WHEN out_w = 0 OR out_h = 0 THEN 'E203' WHEN 10 + 80 > out_w OR 5 + 60 > out_h THEN 'E200' END AS error,
    round(CASE WHEN out_w > 0 THEN 10 / (out_w / CAST(w AS DOUBLE)) END, 6) AS src_left, round(CASE WHEN out_h > 0 THEN 5 / (out_h / CAST(h AS DOUBLE)) END, 6) AS src_top,
    round(CASE WHEN out_w > 0 THEN least(80 / (out_w / CAST(w AS DOUBLE)), w - 10 / (out_w / CAST(w AS DOUBLE))) END, 6) AS src_width,
    round(CASE WHEN out_h > 0 THEN least(60 / (out_h / CAST(h AS DOUBLE)), h - 5 / (out_h / CAST(h AS DOUBLE))) END, 6) AS src_height FROM r""")
def g5_extract_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometry.extract_window(F.col("w"), F.col("h"), F.lit(800), F.lit(600), "inside", F.lit(10), F.lit(5), F.lit(80), F.lit(60))
    numbers = {n: F.round(got[n], 6) if n == "src_left" or n == "src_top" else F.round(F.when(got["src_left"].isNotNull() if n == "src_width" else got["src_top"].isNotNull(), got[n]), 6) for n in ("src_left", "src_top", "src_width", "src_height")}
    return hdr(spark, sf_dir).select("image_id", got["error"].alias("error"), *(v.alias(n) for n, v in numbers.items()))


@query(HDR + "SELECT image_id, CASE WHEN orientation BETWEEN 5 AND 8 THEN h ELSE w END AS out_w, CASE WHEN orientation BETWEEN 5 AND 8 THEN w ELSE h END AS out_h FROM hdr")
def g9_oriented_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geometry.oriented(F.col("w"), F.col("h"), F.col("orientation"))
    return hdr(spark, sf_dir).select("image_id", w.alias("out_w"), h.alias("out_h"))


# Pixels

@query(PX() + "SELECT image_id, y - 2 AS y, x - 1 AS x, c, v FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 4")
def g4_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.crop(px(spark, sf_dir), 1, 2, 5, 3)


@query(PX(8) + "SELECT image_id, 7 - y AS x, x AS y, c, v FROM px")
def g6_rotate_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rotate(px(spark, sf_dir), F.lit(8), F.lit(8), 90)


@query(PX(8) + "SELECT image_id, 7 - x AS x, 7 - y AS y, c, v FROM px")
def g6_rotate_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rotate(px(spark, sf_dir), F.lit(8), F.lit(8), 180)


@query(PX(8) + "SELECT image_id, y AS x, 7 - x AS y, c, v FROM px")
def g6_rotate_270(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.rotate(px(spark, sf_dir), F.lit(8), F.lit(8), -90)


@query(PX() + "SELECT image_id, y, 7 - x AS x, c, v FROM px")
def g7_flip_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.flip_h(px(spark, sf_dir), F.lit(8))


@query(PX() + "SELECT image_id, 7 - y AS y, x, c, v FROM px")
def g8_flip_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.flip_v(px(spark, sf_dir), F.lit(8))


@query(PX() + """SELECT image_id, c, v, CASE o WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y WHEN 8 THEN y ELSE x END AS x,
    CASE o WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x WHEN 8 THEN 7 - x ELSE y END AS y FROM (SELECT *, 1 + image_id % 8 AS o FROM px)""")
def g9_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.reorient(px(spark, sf_dir), F.lit(8), F.lit(8), 1 + F.col("image_id") % 8).select("image_id", "y", "x", "c", "v")


@query(RGBA + """SELECT image_id, y, x, 0 AS c, CAST((2126 * max(v) FILTER (c = 0) + 7152 * max(v) FILTER (c = 1) + 722 * max(v) FILTER (c = 2)) // 10000 AS INTEGER) AS v
    FROM px GROUP BY image_id, y, x""")
def c1_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.grayscale(rgba(spark, sf_dir))


@query(RGBA + "SELECT image_id, y, x, c, CASE WHEN c = 3 THEN v ELSE greatest(0, least(255, v + 40)) END AS v FROM px")
def c2_bright(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.brightness(rgba(spark, sf_dir), 40, alpha=3)


@query(RGBA + "SELECT image_id, y, x, c, CASE WHEN c = 3 THEN v ELSE CAST(greatest(0, least(255, floor(((v / CAST(255 AS DOUBLE) - 0.5) * 1.6900000000000002 + 0.5) * CAST(255 AS DOUBLE)))) AS INTEGER) END AS v FROM px")
def c3_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.contrast(rgba(spark, sf_dir), 30, alpha=3)


@query(PX() + "SELECT image_id, y, x, CAST(k AS INTEGER) AS c, v FROM px, range(3) r(k)")
def c4_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.normalize(px(spark, sf_dir), F.lit(1))


@query(RGBA + "SELECT image_id, bool_and(c <> 3 OR v >= 0 AND v = 255) AS opaque FROM px GROUP BY image_id")
def g20_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.opaque(rgba(spark, sf_dir), F.lit(4), F.lit(16), least=1)


def _weights_sql(src: int, dst: int) -> str:
    """Lanczos weights of three lobes by SQL alone, normalised per output sample and rounded to 1/16384."""
    wide = max(src / dst, 1.0)
    t = f"((s + 0.5 - (d + 0.5) * {src / dst!r}) / {wide!r})"
    return f"""(SELECT d AS dst, s AS src, CAST(floor(k / sum(k) OVER (PARTITION BY d) * 16384 + 0.5) AS INTEGER) AS weight FROM (
        SELECT d, s, CASE WHEN abs({t}) < 1e-12 THEN 1.0 WHEN abs({t}) >= 3 THEN 0.0 ELSE 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t}) ** 2 END AS k
        FROM range({dst}) a(d), range({src}) b(s)) WHERE k <> 0) w"""


def _resample_sql(src: int, dst: int, high: int | None = None) -> str:
    across, down = _weights_sql(src, dst), _weights_sql(src, high or dst)
    value = "CAST(greatest(0, least(255, floor((sum(v * weight) + 8192) / CAST(16384 AS DOUBLE)))) AS INTEGER) AS v"
    return PX() + f""", a AS (SELECT image_id, y, CAST(dst AS INTEGER) AS x, c, {value} FROM px JOIN {across} ON x = src GROUP BY image_id, y, dst, c)
        SELECT image_id, CAST(dst AS INTEGER) AS y, x, c, {value} FROM a JOIN {down} ON y = src GROUP BY image_id, dst, x, c"""


@query(_resample_sql(8, 5))
def g16_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, 8, 1, 5, 5).filter("c = 0")


@query(_resample_sql(8, 12))
def g16_resample_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, 8, 1, 12, 12).filter("c = 0")


def _full_then_cut(src: int, rw: int, rh: int, x: int, y: int, w: int, h: int) -> str:
    full = _resample_sql(src, rw, rh)
    return f"SELECT image_id, CAST(y - {y} AS INTEGER) AS y, CAST(x - {x} AS INTEGER) AS x, c, v FROM ({full}) WHERE y BETWEEN {y} AND {y + h - 1} AND x BETWEEN {x} AND {x + w - 1}"


@query(_full_then_cut(8, 11, 11, 0, 2, 11, 6))
def g2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered in one pass; the SQL makes the whole larger image and cuts it."""
    return rows.to_long(rows.cover(px_rows(spark, sf_dir), F.lit(11), F.lit(6), sizes=one_size(spark, 8))).filter("c = 0")


@query(_resample_sql(8, 6, 10))
def g3_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, 8, 1, 6, 10).filter("c = 0")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row arrays of images of four sizes, 64 samples each."""
    v = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.round((e.cast("double") + 0.5) * 255).cast("int"))))
    w = F.get(F.array(*map(F.lit, (8, 16, 4, 32))), (F.col("vec_id") % 4).cast("int"))
    sized = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), v.alias("data"), w.alias("_w"))
    return rows.from_samples(sized, F.col("_w"), geometry.div(F.lit(64), F.col("_w")).cast("int"), 1, "data")


def _mixed_sql(tw: int, th: int, fit: str) -> str:
    """Each image at its own target, with weights made for each distinct pair of lengths."""
    target = f"CAST({tw} AS BIGINT) AS out_w, CAST({th} AS BIGINT) AS out_h" if fit == "fill" else INSIDE.format(tw=tw, th=th)
    t = "((s + 0.5 - (d + 0.5) * (src / CAST(dst AS DOUBLE))) / greatest(src / CAST(dst AS DOUBLE), 1.0))"
    wide = lambda a, b: f"""(SELECT src, dst, d, s, CAST(floor(k / sum(k) OVER (PARTITION BY src, dst, d) * 16384 + 0.5) AS INTEGER) AS weight FROM (
        SELECT src, dst, d, s, CASE WHEN abs({t}) < 1e-12 THEN 1.0 WHEN abs({t}) >= 3 THEN 0.0 ELSE 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t}) ** 2 END AS k
        FROM (SELECT *, unnest(range(src)) AS s FROM (SELECT *, unnest(range(dst)) AS d FROM (SELECT DISTINCT {a} AS src, {b} AS dst FROM sizes)))) WHERE k <> 0)"""  # noqa: E731
    value = "CAST(greatest(0, least(255, floor((sum(v * weight) + 8192) / CAST(16384 AS DOUBLE)))) AS INTEGER) AS v"
    return f"""WITH hdr AS (SELECT vec_id AS image_id, CAST([8, 16, 4, 32][vec_id % 4 + 1] AS BIGINT) AS w, CAST([8, 4, 16, 2][vec_id % 4 + 1] AS BIGINT) AS h FROM embeddings),
    sizes AS (SELECT image_id, w, h, {target} FROM hdr),
    e AS (SELECT vec_id AS image_id, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    px AS (SELECT image_id, i // w AS y, i % w AS x, CAST(greatest(0, least(255, round((e + 0.5) * 255))) AS INTEGER) AS v FROM e JOIN sizes USING (image_id)),
    a AS (SELECT image_id, y, d AS x, {value} FROM px JOIN sizes USING (image_id) JOIN {wide('w', 'out_w')} k ON k.src = w AND k.dst = out_w AND k.s = x GROUP BY image_id, y, d)
    SELECT image_id, CAST(d AS INTEGER) AS y, CAST(x AS INTEGER) AS x, c, {value} FROM a JOIN sizes USING (image_id) JOIN {wide('h', 'out_h')} k ON k.src = h AND k.dst = out_h AND k.s = y, range(3) r(c) GROUP BY image_id, d, x, c"""


@query(_mixed_sql(10, 7, "inside").replace("x, c, CAST", "x, CAST(c AS INTEGER) AS c, CAST"))
def g1_mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four sizes, each fitted into one box: four sizes come out, in one job. Luma becomes RGB."""
    px_of = mixed(spark, sf_dir)
    w, h = geometry.inside(F.col("w"), F.col("h"), F.lit(10), F.lit(7))
    sizes = spark.createDataFrame([(8, 8), (16, 4), (4, 16), (32, 2)], "w long, h long")
    return rows.to_long(rows.resample(px_of, w, h, sizes=sizes))


@query(_mixed_sql(9, 11, "fill").replace("x, c, CAST", "x, CAST(c AS INTEGER) AS c, CAST"))
def g3_mixed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of four sizes, all stretched to one; their sizes are looked for in the frame."""
    return rows.to_long(rows.resample(mixed(spark, sf_dir), F.lit(9), F.lit(11)))


_FIT_BOX = _mixed_sql(12, 8, "inside").replace("x, c, CAST", "x, CAST(c AS INTEGER) AS c, CAST")


@query(f"""SELECT image_id, x AS y, CAST(max(y) OVER (PARTITION BY image_id) - y AS INTEGER) AS x, 0 AS c,
    CAST(greatest(0, least(255, floor(((least(255, v + 12) / CAST(255 AS DOUBLE) - 0.5) * {((100.0 - 6) / 100.0) ** 2!r} + 0.5) * CAST(255 AS DOUBLE)))) AS INTEGER) AS v FROM ({_FIT_BOX}) WHERE c = 0""")
def x1_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of the stress run on images of four sizes: fitted into a box, turned, made brighter, flatter and grey, lowered as
    the engine lowers it. Of its four formats only PNG can be written here, which k8_png_pipeline does."""
    queue = plan.rewrite((plan.resize(12, 8), plan.rotate(90), plan.brightness(12), plan.contrast(-6), plan.Op("grayscale")))
    px_of = mixed(spark, sf_dir).withColumn("opaque", F.lit(True))
    sizes = px_of.select(F.col("image_id").alias("pos"), "w", "h", F.lit(None).cast("string").alias("code")).distinct()
    return rows.to_long(batch.run_plan((px_of, sizes), queue)[0])


@query(RGBA + f""", p AS (SELECT q.image_id, q.y, q.x, q.c, CASE WHEN q.c = 3 THEN q.v * 255 ELSE q.v * a.v END AS v FROM px q JOIN px a ON a.c = 3 AND q.image_id = a.image_id AND q.y = a.y AND q.x = a.x),
    h AS (SELECT image_id, y, CAST(dst AS INTEGER) AS x, c, CAST(greatest(floor((sum(v * weight) + 8192) / CAST(16384 AS DOUBLE)), 0) AS BIGINT) AS v FROM p JOIN {_weights_sql(4, 3)} ON x = src GROUP BY image_id, y, dst, c),
    r AS (SELECT image_id, CAST(dst AS INTEGER) AS y, x, c, CAST(floor((sum(v * weight) + 8192) / CAST(16384 AS DOUBLE)) AS BIGINT) AS v FROM h JOIN {_weights_sql(4, 3)} ON y = src GROUP BY image_id, dst, x, c),
    m AS (SELECT r.*, least(greatest(a.v, 0), 65025) AS a FROM r JOIN r a ON a.c = 3 AND r.image_id = a.image_id AND r.y = a.y AND r.x = a.x)
    SELECT image_id, y, x, c, CAST(greatest(0, least(255, CASE WHEN c = 3 THEN round(a / CAST(255 AS DOUBLE)) WHEN a > 0 THEN round(v * 255 / CAST(a AS DOUBLE)) ELSE 0 END)) AS INTEGER) AS v FROM m""")
def g19_resample_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir, 4, 4, 3, 3)


# Fixed values again: the quantisation table for luma.
_LUMA = "[16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]"


@query(PX() + f""", b AS (SELECT u, s, CAST(round(8192 * (CASE WHEN u = 0 THEN sqrt(0.125) ELSE 0.5 END) * cos((2 * s + 1) * u * pi() / 16)) AS BIGINT) AS k FROM range(8) a(u), range(8) c(s)),
    t AS (SELECT image_id, v.u AS fy, h.u AS fx, CAST(sum((px.v - 128) * v.k * h.k) AS BIGINT) AS s FROM px JOIN b v ON v.s = y JOIN b h ON h.s = x GROUP BY image_id, v.u, h.u),
    q AS (SELECT *, 1 + image_id % 100 AS quality FROM t),
    z AS (SELECT *, least(255, greatest(1, ({_LUMA}[CAST(8 * fy + fx AS INTEGER) + 1] * (CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END) + 50) // 100)) * 67108864 AS d FROM q)
    SELECT image_id, 0 AS block_y, 0 AS block_x, CAST(row_number() OVER (PARTITION BY image_id ORDER BY fy + fx, CASE WHEN (fy + fx) % 2 = 1 THEN fy ELSE fx END) - 1 AS INTEGER) AS place, CAST(sign(s) * ((2 * abs(s) + d) // (2 * d)) AS INTEGER) AS level FROM z""")
def k7_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised JPEG coefficients of one block per image, each image at a quality of its own."""
    found = dct.coefficients(px_rows(spark, sf_dir), 1 + F.col("image_id") % 100)
    return found.select("image_id", "block_y", "block_x", F.posexplode("coefficients").alias("place", "level"))


# Guards

@query(HDR + """, p(policy, max_pixels, max_bytes) AS (VALUES ('strict', 40000000, 33554432), ('lenient', 75000000, 50331648), ('custom', NULL, NULL), ('disabled', NULL, NULL))
    SELECT image_id, policy, CASE WHEN bytes_in > max_bytes THEN 'E123' END AS bytes_error, CASE WHEN w * h > max_pixels THEN 'E123' END AS pixels_error FROM hdr, p""")
def f7_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(p[0]).alias("policy"), F.lit(p[1]).cast("long").alias("max_pixels"), F.lit(p[2]).cast("long").alias("max_bytes")) for p in rules.POLICIES)))
    bytes_error, pixels_error = rules.bytes_error(F.col("bytes_in"), F.col("p.max_bytes")), rules.pixels_error(F.col("w"), F.col("h"), F.col("p.max_pixels"))
    return hdr(spark, sf_dir).select("*", each.alias("p")).select("image_id", "p.policy", bytes_error.alias("bytes_error"), pixels_error.alias("pixels_error"))


def _limit(name: str, column: str) -> Column:
    """A policy's limit, as a literal."""
    return F.lit({p[0]: dict(zip(POLICY_FIELDS, p[1:])) for p in rules.POLICIES}[name][column])


@query(HDR + "SELECT image_id, bytes_in FROM hdr WHERE bytes_in <= 33554432")
def f1_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdr(spark, sf_dir).filter(rules.bytes_error(F.col("bytes_in"), _limit("strict", "max_bytes")).isNull()).select("image_id", "bytes_in")


@query(HDR + "SELECT image_id, w * h AS pixels FROM hdr WHERE w * h <= 40000000")
def f2_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = rules.pixels_error(F.col("w"), F.col("h"), _limit("strict", "max_pixels")).isNull()
    return hdr(spark, sf_dir).filter(passed).select("image_id", (F.col("w") * F.col("h")).alias("pixels"))


@query("SELECT event_id, CASE WHEN value * 100 > 5000 THEN 'E123' END AS error FROM events")
def f3_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", rules.timeout_error(F.col("value") * 100, _limit("strict", "timeout_ms")).alias("error"))


@query(HDR + "SELECT image_id, CASE WHEN w * 5 > 32768 OR h * 5 > 32768 THEN 'E121' WHEN w * 5 * h * 5 > 100000000 THEN 'E122' END AS error FROM hdr")
def f8_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdr(spark, sf_dir).select("image_id", rules.dimension_error(F.col("w") * 5, F.col("h") * 5).alias("error"))


def args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, a, b): a grid of arguments, wrong ones among them."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a = F.when(k % 11 == 0, F.lit(float("nan"))).when(k % 11 == 1, F.lit(None)).when(k % 11 == 2, size + 0.5).when(k % 11 == 3, -size).when(k % 11 == 4, size * 1000).otherwise(size)
    b = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.lit(0)).when(k % 7 == 2, size * 3000).otherwise(size * 7)
    return read(spark, sf_dir, "part").select(k.alias("k"), a.cast("double").alias("a"), b.cast("double").alias("b"))


ARGS = """WITH g AS (SELECT p_partkey AS k, CAST(CASE p_partkey % 11 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN NULL WHEN 2 THEN p_size + 0.5 WHEN 3 THEN -p_size WHEN 4 THEN p_size * 1000 ELSE p_size END AS DOUBLE) AS a,
    CAST(CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN p_size * 3000 ELSE p_size * 7 END AS DOUBLE) AS b FROM part) """
_WHOLE = "({0} IS NOT NULL AND (isnan({0}) OR {0} <> floor({0})))"


@query(ARGS + f"""SELECT k, CASE WHEN a IS NULL AND b IS NULL THEN 'E203' WHEN {_WHOLE.format('a')} OR a <= 0 OR a > 32768 OR {_WHOLE.format('b')} OR b <= 0 OR b > 32768 THEN 'E203' END AS resize_error,
    CASE WHEN {_WHOLE.format('a')} THEN 'E400' WHEN a < 0 OR b < 0 THEN 'E400' WHEN a <= 0 OR b <= 0 OR a > 32768 OR b > 32768 THEN 'E201' END AS crop_error,
    CASE WHEN {_WHOLE.format('a')} OR a < 0 THEN 'E400' END AS quality_error, CASE WHEN {_WHOLE.format('a')} OR a < -100 OR a > 100 THEN 'E400' END AS tone_error,
    CASE WHEN {_WHOLE.format('a')} OR a < 0 THEN 'E400' WHEN a > 1024 THEN 'E901' END AS concurrency_error,
    CASE WHEN a IS NULL THEN 'keep' WHEN {_WHOLE.format('a')} OR a < 0 THEN 'E400' WHEN a = 0 THEN 'lift' ELSE 'set' END AS limit_setting,
    CASE WHEN a NOT IN (0, 90, -90, 180, -180, 270, -270) THEN 'E202' END AS rotation_error FROM g""")
def f10_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return args(spark, sf_dir).select(
        "k", rules.resize_args_error(a, b).alias("resize_error"), rules.crop_args_error(a, b, a, b).alias("crop_error"), rules.quality_error(a).alias("quality_error"),
        rules.tone_error(a).alias("tone_error"), rules.concurrency_error(a).alias("concurrency_error"), rules.limit_setting(a).alias("limit_setting"), rules.rotation_error(a).alias("rotation_error"))


@query(HDR + """SELECT image_id, CASE WHEN w % 50 = 0 OR h % 50 = 0 THEN 'E300' WHEN w % 50 * 700 > 32768 OR h % 50 * 700 > 32768 THEN 'E121' WHEN (w % 50) * 700 * (h % 50) * 700 > 100000000 THEN 'E122'
    WHEN bytes_in <> (w % 50) * 700 * (h % 50) * 700 * 3 THEN 'E130' END AS error FROM hdr""")
def k12_encode_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdr(spark, sf_dir).select("image_id", rules.encode_error(F.col("w") % 50 * 700, F.col("h") % 50 * 700, F.lit(3), F.col("bytes_in")).alias("error"))


def _be(v: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(v), 2 * size, "0"))


def _le(v: Column, size: int) -> Column:
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(v, 8 * i) % 256), 2, "0") for i in range(size))))


def png_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, w, h, content): PNG headers of sides up to 45,000, every seventh cut off in its size."""
    w, h = F.col("w") * 5, F.col("h") * 5
    head = F.concat(F.unhex(F.lit(headers.PNG_SIGNATURE + "0000000d49484452")), _be(w, 4), _be(h, 4), F.unhex(F.lit("0802000000")))
    content = F.when(F.col("image_id") % 7 == 0, F.substring(head, 1, 20)).otherwise(head)
    return hdr(spark, sf_dir).select("image_id", w.alias("w"), h.alias("h"), content.alias("content"))


@query(HDR + """SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 'E131' WHEN w * 5 > 32768 OR h * 5 > 32768 THEN 'E121' WHEN w * 5 * h * 5 > 100000000 THEN 'E122' WHEN w * 5 * h * 5 > 40000000 THEN 'E123' END AS error FROM hdr""")
def f9_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header alone stops, before anything is inflated."""
    strict = {p[0]: dict(zip(POLICY_FIELDS, p[1:])) for p in rules.POLICIES}["strict"]
    return batch.guarded(png_heads(spark, sf_dir), strict).select("image_id", F.col("code").alias("error"))


@query(HDR + """SELECT image_id, policy, CASE WHEN n > 0 AND policy = 'strict' THEN 'E123' WHEN n > 524288 AND policy = 'lenient' THEN 'E123' END AS error FROM (SELECT image_id, CASE WHEN image_id % 3 > 0 THEN image_id % 3 * 300000 END AS n FROM hdr), (VALUES ('strict'), ('lenient'), ('custom'), ('disabled')) p(policy)""")
def f4_icc_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("image_id") % 3 > 0, F.col("image_id") % 3 * 300_000)
    each = hdr(spark, sf_dir).select("image_id", size.alias("n")).join(F.broadcast(rules.policies(spark)))
    return each.select("image_id", "policy", rules.icc_policy_error(F.col("n"), F.col("reject_metadata"), F.col("metadata_max_bytes")).alias("error"))


# Dimensions and rules

# Fixed values, written out apart from the library's table, so that one checks the other: 0 user, 1 codec, 2 resource, 3 internal.
ERROR_ROWS = """(VALUES
    ('E100', 100, 'FileNotFound', 0, true, 'Verify the input path and ensure the file exists.'),
    ('E101', 101, 'FileReadFailed', 2, true, 'Check file permissions and disk health, then retry.'),
    ('E102', 102, 'MmapFailed', 2, true, 'Free memory or disk resources and confirm file permissions.'),
    ('E111', 111, 'UnsupportedFormat', 1, false, 'Convert the image to a supported format (jpeg, png, webp).'),
    ('E121', 121, 'DimensionExceedsLimit', 2, true, 'Resize the image to fit within the maximum dimension limits.'),
    ('E122', 122, 'PixelCountExceedsLimit', 2, true, 'Reduce resolution or process the image in smaller tiles.'),
    ('E123', 123, 'FirewallViolation', 2, true, 'Adjust firewall limits (bytes/pixels/metadata) or use smaller inputs.'),
    ('E130', 130, 'CorruptedImage', 1, false, 'Re-download or regenerate the image; the file appears corrupted.'),
    ('E131', 131, 'DecodeFailed', 1, false, 'Try opening the file in another viewer or re-encode the source image.'),
    ('E200', 200, 'InvalidCropBounds', 0, true, 'Ensure crop x/y/width/height stay within the image dimensions.'),
    ('E201', 201, 'InvalidCropDimensions', 0, true, 'Use positive crop width and height greater than zero.'),
    ('E202', 202, 'InvalidRotationAngle', 0, true, 'Use rotation angles in 90-degree increments (0, 90, 180, 270).'),
    ('E203', 203, 'InvalidResizeDimensions', 0, true, 'Provide at least one positive dimension (width or height).'),
    ('E204', 204, 'InvalidResizeFit', 0, true, 'Use fit values: inside, cover, or fill.'),
    ('E210', 210, 'UnsupportedColorSpace', 1, false, 'Convert the image to sRGB or a supported color space before processing.'),
    ('E299', 299, 'ResizeFailed', 1, false, 'Try different resize parameters or re-encode the input before resizing.'),
    ('E300', 300, 'EncodeFailed', 1, false, 'Adjust output format/quality or try re-encoding the source image.'),
    ('E301', 301, 'FileWriteFailed', 2, true, 'Check output path, permissions, and available disk space.'),
    ('E400', 400, 'InvalidArgument', 0, true, 'Pass a valid argument value as documented for this option.'),
    ('E401', 401, 'InvalidPreset', 0, true, 'Use a supported preset name (thumbnail, avatar, hero, social).'),
    ('E402', 402, 'InvalidFirewallPolicy', 0, true, 'Use firewall policy ''strict'' or ''lenient''.'),
    ('E900', 900, 'SourceConsumed', 0, true, 'Clone the engine or reload the source before reusing it.'),
    ('E901', 901, 'InternalPanic', 3, false, 'Report this issue with logs; it indicates an unexpected internal error.'),
    ('E999', 999, 'Generic', 3, false, 'Report this issue with full context; an unexpected state occurred.')) e(code, number, name, category, recoverable, hint)"""


@query(f"SELECT l_orderkey, l_linenumber, l_code AS code, name, category, recoverable, hint FROM (SELECT l_orderkey, l_linenumber, 'E' || (CASE l_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 121 WHEN 2 THEN 203 WHEN 3 THEN 300 ELSE 150 END + l_linenumber % 3) AS l_code FROM lineitem) LEFT JOIN {ERROR_ROWS} ON l_code = code")
def e1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.element_at(F.array(*(F.lit(x) for x in (100, 121, 203, 300, 150))), (F.col("l_orderkey") % 5 + 1).cast("int"))
    coded = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("E"), base + F.col("l_linenumber") % 3).alias("l_code"))
    return errors.with_errors(coded, "l_code").select("l_orderkey", "l_linenumber", F.col("l_code").alias("code"), "name", "category", "recoverable", "hint")


@query(f"SELECT code, number, name, category, recoverable, hint, count(o_orderkey) AS orders FROM {ERROR_ROWS} LEFT JOIN orders ON o_orderkey % 1000 = number GROUP BY ALL")
def e3_error_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of error, and how many orders end in its number."""
    met = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 1000).cast("int").alias("number")).agg(F.count("*").alias("orders"))
    dim = errors.error_dim(spark).withColumn("number", F.substring("code", 2, 3).cast("int"))
    return dim.join(met, "number", "left").select("code", "number", "name", "category", "recoverable", "hint", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query(f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS ec, CASE WHEN o_orderkey % 7 = 1 THEN CAST(o_orderkey % 3 AS INTEGER) END AS cat,
    CASE o_orderkey % 7 WHEN 2 THEN 'LAZY_IMAGE_CODEC_ERROR' WHEN 3 THEN 'ENOENT' END AS code, CASE WHEN o_orderkey % 7 >= 3 THEN 'E' || (100 + o_orderkey * 13 % 900) WHEN o_orderkey % 7 = 2 THEN 'x' END AS errorCode FROM orders)
    SELECT o_orderkey, coalesce(ec, cat, CASE code WHEN 'LAZY_IMAGE_CODEC_ERROR' THEN 1 END, category,
    CASE substr(errorCode, 2, 1) WHEN '1' THEN 0 WHEN '2' THEN 0 WHEN '4' THEN 0 WHEN '3' THEN 2 WHEN '9' THEN 3 END) AS category FROM o LEFT JOIN {ERROR_ROWS.replace(' e(code', ' e(known')} ON errorCode = known""")
def e5_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ec, cat = F.when(k % 7 == 0, (k % 4).cast("int")), F.when(k % 7 == 1, (k % 3).cast("int"))
    code = F.when(k % 7 == 2, "LAZY_IMAGE_CODEC_ERROR").when(k % 7 == 3, "ENOENT")
    number = F.when(k % 7 >= 3, F.concat(F.lit("E"), 100 + k * 13 % 900)).when(k % 7 == 2, "x")
    return read(spark, sf_dir, "orders").select(k, errors.classify(ec, cat, code, number).alias("category"))


# Fixed values again.
PRESET_ROWS = "(VALUES ('thumbnail', 150, 150, 'webp', 75), ('avatar', 200, 200, 'webp', 80), ('hero', 1920, NULL, 'jpeg', 85), ('social', 1200, 630, 'jpeg', 80))"


@query(HDR + ", p AS (SELECT * FROM " + PRESET_ROWS + """ p(name, width, height, format, quality))
    SELECT name, width, height, p.format, p.quality, count(*) FILTER (w >= coalesce(width, 0) AND h >= coalesce(height, 0)) AS large_enough FROM p, hdr GROUP BY ALL""")
def p2_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each preset, and how many images have its size at least."""
    fits = [F.count(F.when((F.col("w") >= (w or 0)) & (F.col("h") >= (h or 0)), 1)).alias(name) for name, w, h, *_ in rules.PRESETS]
    one = hdr(spark, sf_dir).agg(*fits)
    met = one.select(F.explode(F.array(*(F.struct(F.lit(p[0]).alias("name"), F.col(p[0]).alias("large_enough")) for p in rules.PRESETS))).alias("s")).select("s.*")
    return rules.presets(spark).join(met, "name").select("name", "width", "height", "format", "quality", "large_enough")


@query(HDR + ", p AS (SELECT * FROM " + PRESET_ROWS + f""" p(name, width, height, pformat, pquality)), j AS (SELECT hdr.*, p.* FROM hdr JOIN p ON name = ['thumbnail', 'avatar', 'hero', 'social'][image_id % 4 + 1])
    SELECT image_id, name, pformat AS format, pquality AS quality, {INSIDE.format(tw="width", th="height")} FROM j""")
def p1_preset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rules.presets(spark).select("name", "width", "height", F.col("format").alias("pformat"), F.col("quality").alias("pquality"))
    named = hdr(spark, sf_dir).withColumn("name", F.element_at(F.array(*(F.lit(x[0]) for x in rules.PRESETS)), (F.col("image_id") % 4 + 1).cast("int")))
    w, h = geometry.inside(F.col("w"), F.col("h"), F.col("width"), F.col("height"))
    return named.join(F.broadcast(p), "name").select("image_id", "name", F.col("pformat").alias("format"), F.col("pquality").alias("quality"), w.alias("out_w"), h.alias("out_h"))


_BAND = "CASE WHEN quality >= 85 THEN '{0}' WHEN quality >= 70 THEN '{1}' WHEN quality >= 50 THEN '{2}' ELSE '{3}' END"


@query(HDR + f"""SELECT image_id, {_BAND.format('high', 'balanced', 'fast', 'fastest')} AS band, 4 AS webp_method, 1 AS webp_pass, 0 AS webp_preprocessing, CAST({_BAND.format(50, 70, 80, 80)} AS INTEGER) AS webp_sns_strength,
    CAST({_BAND.format(2, 0, 0, 0)} AS INTEGER) AS webp_filter_sharpness, CASE WHEN quality >= 80 THEN 20 WHEN quality >= 60 THEN 30 ELSE 40 END AS webp_filter_strength, CAST({_BAND.format(6, 7, 8, 9)} AS INTEGER) AS avif_speed,
    CASE WHEN quality >= 90 THEN 0 WHEN quality >= 70 THEN 5 WHEN quality >= 60 THEN 10 ELSE 18 END AS jpeg_smoothing FROM hdr""")
def q1_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdr(spark, sf_dir).select("image_id", *(v.alias(n) for n, v in rules.encoder_knobs(F.col("quality")).items()))


@query("""SELECT p_partkey, CASE f WHEN 'jpg' THEN 'jpeg' WHEN 'bmp' THEN NULL ELSE f END AS format, CAST(CASE f WHEN 'png' THEN NULL WHEN 'bmp' THEN CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE least(p_size * 3, 100) END ELSE coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE least(p_size * 3, 100) END,
    CASE f WHEN 'webp' THEN 80 WHEN 'avif' THEN 60 ELSE 85 END) END AS INTEGER) AS quality FROM (SELECT *, ['jpeg', 'jpg', 'png', 'webp', 'avif', 'bmp'][p_partkey % 6 + 1] AS f FROM part)""")
def k13_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(x) for x in ("JPEG", "jpg", "Png", "webp", "AVIF", "bmp"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    given = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 3)
    return read(spark, sf_dir, "part").select("p_partkey", rules.output_format(name).alias("format"), rules.output_quality(name, given).alias("quality"))


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'img_' || p_partkey || ['.jpg', '.png', '.webp', '.avif'][p_partkey % 4 + 1] AS output_name, count(*) OVER (PARTITION BY p_partkey // 3 * 3, p_partkey % 4) AS same_name FROM part")
def k15_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("in.dir/img_"), k.cast("string"), F.element_at(F.array(F.lit(".jpg"), F.lit(""), F.lit(".tar.png")), F.lit(1)))
    fmt = F.element_at(F.array(*(F.lit(x) for x in ("jpg", "PNG", "webp", "avif"))), (k % 4 + 1).cast("int"))
    same = F.expr("count(*) OVER (PARTITION BY p_partkey div 3 * 3, p_partkey % 4)")
    return read(spark, sf_dir, "part").select(k.cast("long").alias("p_partkey"), rules.output_name(path, fmt).alias("output_name"), same.alias("same_name"))


@query("SELECT o_orderkey, CASE f WHEN 'INSIDE' THEN 'inside' WHEN ' cover ' THEN 'cover' WHEN 'fill' THEN 'fill' END AS fit, CASE WHEN f = 'outside' THEN 'E204' END AS error FROM (SELECT o_orderkey, ['INSIDE', ' cover ', 'fill', 'outside'][o_orderkey % 4 + 1] AS f FROM orders)")
def f16_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.element_at(F.array(*(F.lit(x) for x in ("INSIDE", " cover ", "fill", "outside"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", rules.resize_fit(f).alias("fit"), F.when(rules.resize_fit(f).isNull(), "E204").alias("error"))


@query(HDR + """SELECT image_id, format, format IN ('jpeg', 'jpg', 'png', 'webp') AS readable, format IN ('jpeg', 'jpg', 'png', 'webp', 'avif') AS writable FROM hdr""")
def s20_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which images have a format that is read, and one that is written."""
    lists = rules.formats(spark)
    of = lambda d, name: lists.filter(F.col("direction") == d).select("format", F.lit(True).alias(name))
    known = hdr(spark, sf_dir).join(F.broadcast(of("input", "readable")), "format", "left").join(F.broadcast(of("output", "writable")), "format", "left")
    return known.select("image_id", "format", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("readable", "writable")))


# What an operation's contract asks for, and what it does.
CONTRACT_ROWS = """(VALUES
    ('resize', 'resize', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('extract', 'extract', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('crop', 'crop', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('rotate', 'rotate', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('flip_h', 'flip', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('flip_v', 'flip', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry'),
    ('brightness', 'tonemap', 'decoded_pixels+color_state', 'mutates_pixels+normalizes_color'),
    ('contrast', 'tonemap', 'decoded_pixels+color_state', 'mutates_pixels+normalizes_color'),
    ('auto_orient', 'auto_orient', 'decoded_pixels+color_state+orientation', 'mutates_pixels+changes_geometry'),
    ('grayscale', 'grayscale', 'decoded_pixels+color_state', 'mutates_pixels+changes_geometry+normalizes_color'),
    ('normalize', 'color_space', 'decoded_pixels+color_state', 'mutates_pixels+normalizes_color')) c(op, contract, requires, effects)"""
#: Operation names by number; a queue has those of a number's last digits.
OP_NAMES = ("resize", "extract", "crop", "rotate", "flip_h", "flip_v", "brightness", "contrast", "auto_orient", "grayscale", "normalize")


def queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, ops, have): a queue of one to four operations per order, and what is there before it."""
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, OP_NAMES))
    ops = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.get(names, (F.call_function("div", k, F.pow(F.lit(7), i).cast("long")) % 11).cast("int")))
    have = F.when(k % 5 == 0, F.array(F.lit("decoded_pixels"))).when(k % 5 == 1, F.array(F.lit("decoded_pixels"), F.lit("color_state"))).otherwise(F.array(*map(F.lit, (plan.PIXELS, plan.COLOR, plan.ORIENTATION))))
    return read(spark, sf_dir, "orders").select("o_orderkey", ops.alias("ops"), have.alias("have"))


_QUEUES = """WITH RECURSIVE q AS (SELECT o_orderkey, list_transform(range(o_orderkey % 4 + 1), lambda i: ['resize', 'extract', 'crop', 'rotate', 'flip_h', 'flip_v', 'brightness', 'contrast', 'auto_orient', 'grayscale', 'normalize'][CAST(o_orderkey // CAST(pow(7, i) AS BIGINT) % 11 AS INTEGER) + 1]) AS ops,
    CASE o_orderkey % 5 WHEN 0 THEN ['decoded_pixels'] WHEN 1 THEN ['decoded_pixels', 'color_state'] ELSE ['decoded_pixels', 'color_state', 'orientation'] END AS have FROM orders) """


@query(_QUEUES + f", e AS (SELECT o_orderkey, unnest(ops) AS op FROM q) SELECT op, contract, requires, effects, count(*) AS uses FROM e JOIN {CONTRACT_ROWS} USING (op) GROUP BY ALL")
def f18_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contracts of the operations that queues hold, and how often they do."""
    used = queues(spark, sf_dir).select(F.explode("ops").alias("op")).groupBy("op").agg(F.count("*").alias("uses"))
    return plan.contracts(spark).join(used, "op").select("op", "contract", F.array_join("requires", "+").alias("requires"), F.array_join("effects", "+").alias("effects"), "uses")


@query(_QUEUES + f""", s(o_orderkey, ops, have, i, failed) AS (SELECT o_orderkey, ops, have, CAST(0 AS BIGINT), CAST(NULL AS BIGINT) FROM q UNION ALL
    SELECT s.o_orderkey, s.ops, CASE WHEN contains(c.effects, 'normalizes_color') THEN list_distinct(list_append(s.have, 'color_state')) ELSE s.have END, s.i + 1,
        CASE WHEN list_has_all(s.have, string_split(c.requires, '+')) THEN NULL ELSE s.i END
    FROM s JOIN {CONTRACT_ROWS} ON c.op = s.ops[CAST(s.i AS INTEGER) + 1] WHERE s.failed IS NULL AND s.i < len(s.ops))
    SELECT o_orderkey, CASE WHEN max(failed) IS NOT NULL THEN 'E400' END AS error, CAST(max(failed) AS INTEGER) AS failed_at FROM s GROUP BY o_orderkey""")
def f17_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues as data, each checked by a fold over its operations with the set of capabilities as state."""
    checked = plan.sequence_error(F.col("ops"), F.col("have"))
    return queues(spark, sf_dir).select("o_orderkey", checked["error"].alias("error"), checked["failed_at"].alias("failed_at"))


# Cost model and colour state

MIB = rules.MIB
PLANS = {
    "thumb": (plan.resize(200, 200),), "cover": (plan.resize(1600, 900, "cover"), plan.Op("grayscale")), "turn": (plan.rotate(90), plan.Op("normalize")),
    "fill_crop": plan.rewrite((plan.resize(800, 600, "fill"), plan.crop(10, 5, 80, 60))), "none": (),
}


@query(HDR + f""", b AS (SELECT *, w * h * (CASE WHEN format = 'jpeg' THEN 3 ELSE 4 END) AS b0, CASE WHEN format = 'jpeg' THEN 3 ELSE 4 END AS bpp FROM hdr),
    s AS (SELECT *, greatest(1600 / CAST(w AS DOUBLE), 900 / CAST(h AS DOUBLE)) AS s, {INSIDE.format(tw="200", th="200")} FROM b)
    SELECT image_id, 'none' AS plan, CAST(greatest(b0 + {8 * MIB}, b0 + w * h * (CASE WHEN format = 'jpeg' THEN 3 ELSE 4 END) // 4, {24 * MIB}) AS BIGINT) AS peak FROM b
    UNION ALL SELECT image_id, 'thumb', CAST(greatest(b0 + {8 * MIB}, b0 + out_w * out_h * 4 + {4 * MIB}, {24 * MIB}) AS BIGINT) FROM s
    UNION ALL SELECT image_id, 'cover', CAST(greatest(b0 + {8 * MIB}, b0 + 5760000 + {4 * MIB} + greatest(greatest(CAST(ceil(w * s) AS BIGINT), 1) * greatest(CAST(ceil(h * s) AS BIGINT), 1) * 4 - 5760000, 0), {24 * MIB}) AS BIGINT) FROM s
    UNION ALL SELECT image_id, 'turn', CAST(greatest(b0 + {8 * MIB}, b0 + b0 + {4 * MIB}, b0 + w * h * 3 + {2 * MIB}, {24 * MIB}) AS BIGINT) FROM b
    UNION ALL SELECT image_id, 'fill_crop', CAST(greatest(b0 + {8 * MIB}, b0 + 19200 + {4 * MIB}, {24 * MIB}) AS BIGINT) FROM b""")
def b9_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = F.explode(F.array(*(F.struct(F.lit(name).alias("plan"), plan.ops_column(ops).alias("ops")) for name, ops in PLANS.items())))
    peak = cost.peak_bytes(F.col("w"), F.col("h"), F.col("format"), F.col("ops"), F.when(F.col("format") == "jpeg", "jpeg").otherwise("png"))
    return hdr(spark, sf_dir).select("*", queues.alias("q")).select("*", "q.*").select("image_id", "plan", peak.alias("peak"))


@query(f"""SELECT o_orderkey, m AS memory, greatest(CASE WHEN m IS NULL THEN 8 WHEN u < {24 * MIB} THEN 1 ELSE greatest(least(least(u // {100 * MIB}, 16), 8), 1) END, 1) AS concurrency, CASE WHEN m IS NOT NULL THEN r END AS reserved
    FROM (SELECT *, greatest(m - r, 0) AS u FROM (SELECT *, least(greatest(m // 20, {64 * MIB}), {512 * MIB}) AS r FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 97 * {32 * MIB} END AS m FROM orders)))""")
def b6_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderkey") % 97 * (32 * MIB))
    return read(spark, sf_dir, "orders").select("o_orderkey", m.alias("memory"), cost.concurrency(m, F.lit(8)).alias("concurrency"), F.when(m.isNotNull(), cost.reserved(m)).alias("reserved"))


@query(HDR + """, s AS (SELECT image_id, ['rgb', 'rgba', 'luma', 'luma_a', 'cmyk'][image_id % 5 + 1] AS l, CASE WHEN image_id % 3 = 0 THEN 16 ELSE 8 END AS b, image_id % 2 = 0 AS i, image_id % 3 AS p FROM hdr)
    SELECT image_id, CASE WHEN p = 0 THEN 'luma' WHEN p = 2 THEN 'rgb' WHEN l = 'cmyk' THEN 'unknown' ELSE l END AS color_space, CASE WHEN p IN (0, 2) THEN '8' WHEN l = 'cmyk' THEN 'unknown' WHEN b = 16 THEN 'unknown' ELSE '8' END AS bit_depth,
    CASE WHEN p = 2 OR l <> 'cmyk' THEN 'srgb' ELSE 'unknown' END AS transfer, CASE WHEN i THEN 'present' ELSE 'absent' END AS icc FROM s""")
def c7_color_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    queues = {"0": (plan.resize(10, 10), plan.Op("grayscale")), "1": (plan.brightness(10), plan.contrast(5)), "2": (plan.Op("normalize"),)}
    k = F.col("image_id")
    layout = F.element_at(F.array(*(F.lit(x) for x in ("rgb", "rgba", "luma", "luma_a", "cmyk"))), (k % 5 + 1).cast("int"))
    rows = hdr(spark, sf_dir).join(F.broadcast(plan.ops_frame(spark, queues)), (k % 3).cast("string") == F.col("plan"))
    start = plan.color_state(layout, F.when(k % 3 == 0, 16).otherwise(8), k % 2 == 0)
    return rows.select("image_id", plan.color_state_after(start, F.col("ops")).alias("s")).select("image_id", "s.*")


# Metadata

@query("""WITH s AS (SELECT conv_id AS image_id, turn + 1 AS seq, CAST(CASE WHEN conv_id % 5 = 0 THEN 3 ELSE count(*) OVER (PARTITION BY conv_id) END AS BIGINT) AS total, text FROM conversations)
    SELECT image_id, CASE WHEN min(total) = max(total) AND list_sort(list(seq)) = range(1, max(total) + 1) THEN md5(string_agg(coalesce(text, ''), '' ORDER BY seq, coalesce(text, ''))) END AS icc_md5 FROM s GROUP BY image_id""")
def m2_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    total = F.when(F.col("conv_id") % 5 == 0, F.lit(3)).otherwise(F.col("n"))
    seg = c.join(sizes, "conv_id").select(F.col("conv_id").alias("image_id"), (F.col("turn") + 1).alias("seq"), total.alias("total"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    return metadata.reassembled(seg).select("image_id", F.md5("icc").alias("icc_md5"))


@query(HDR + """SELECT image_id, image_id % 2 = 0 AND image_id % 3 > 0 AS icc_preserved, image_id % 3 > 0 AND NOT (image_id % 2 = 0) AS metadata_stripped,
    CASE WHEN (image_id % 2 = 0 OR image_id % 7 = 0) AND image_id % 5 = 0 AND image_id % 3 > 0 THEN 'firewall_rejected_metadata' ELSE '' END AS violations FROM hdr""")
def m13_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("image_id")
    flags = rules.icc_flags(k % 2 == 0, k % 7 == 0, F.when(k % 3 > 0, k % 3 * 500), k % 5 == 0)
    return hdr(spark, sf_dir).select("image_id", flags["icc_preserved"].alias("icc_preserved"), flags["metadata_stripped"].alias("metadata_stripped"), F.array_join(flags["policy_violations"], ",").alias("violations"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): headers of several formats, cut short or damaged for some."""
    k = F.col("image_id")

    def be(v: Column, size: int) -> Column:
        return F.unhex(F.lpad(F.hex(v), 2 * size, "0"))

    raw = lambda h: F.unhex(F.lit(h))
    png_head = F.concat(raw(headers.PNG_SIGNATURE + "0000000d49484452"), be(F.col("w"), 4), be(F.col("h"), 4), raw("0802000000"))
    webp = F.concat(raw(b"RIFF".hex() + "24000000" + b"WEBPVP8X".hex() + "0a00000000000000"), raw("1f0300"), raw("570200"), raw("00"))
    avif = F.concat(be(F.lit(24), 4), raw(b"ftypmif1".hex() + "00000000" + b"miafavif".hex()))
    other = F.concat(raw("ffd8ffe0"), be(F.col("w"), 8))
    content = F.when(k % 5 == 0, png_head).when(k % 5 == 1, F.substring(png_head, 1, 20)).when(k % 5 == 2, webp).when(k % 5 == 3, avif).otherwise(other)
    return hdr(spark, sf_dir).select("image_id", "w", "h", content.alias("content"))


@query(HDR + """SELECT image_id, ['png', 'png', 'webp', 'avif', 'jpeg'][image_id % 5 + 1] AS format, ['png', 'png', 'webp', NULL, 'jpeg'][image_id % 5 + 1] AS container_or_heif,
    CASE image_id % 5 WHEN 0 THEN w WHEN 2 THEN 800 END AS width, CASE image_id % 5 WHEN 0 THEN h WHEN 2 THEN 600 END AS height, image_id % 5 = 3 AS is_avif FROM hdr""")
def s9_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.col("content")
    (pw, ph), (ww, wh) = headers.png_size(data), headers.webp_size(data)
    kind = headers.container(data)
    return blobs(spark, sf_dir).select(
        "image_id", headers.image_format(data).alias("format"), F.when(kind != "heif", kind).alias("container_or_heif"),
        F.coalesce(pw, ww).alias("width"), F.coalesce(ph, wh).alias("height"), headers.is_avif(data).alias("is_avif"))


@query(HDR + "SELECT image_id, image_id % 4 = 0 AS valid FROM hdr")
def m5_icc_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("image_id")
    size = F.when(k % 4 == 1, 999).otherwise(128 + k % 50)
    major, tag = F.when(k % 4 == 2, "0b").otherwise("02"), F.when(k % 4 == 3, F.lit(b"mn\x01r".hex())).otherwise(F.lit(b"mntr".hex()))
    head = F.concat(F.lpad(F.hex(size), 8, "0"), F.lit(b"TEST".hex()), major, F.lit("000000"), tag, F.lit(b"RGB XYZ ".hex()))
    icc = F.unhex(F.rpad(head, (2 * (128 + k % 50)).cast("int"), F.lit("0")))
    return hdr(spark, sf_dir).select("image_id", headers.icc_valid(icc).alias("valid"))


def _tiff(orientation: Column, gps: Column) -> Column:
    """EXIF of an orientation and a pointer to GPS data; the byte order follows the image's id."""
    def body(number, order: str) -> Column:
        return F.concat(
            F.unhex(F.lit(order)), number(F.lit(42), 2), number(F.lit(8), 4), number(F.lit(2), 2), number(F.lit(0x0112), 2), number(F.lit(3), 2), number(F.lit(1), 4), number(orientation, 2), number(F.lit(0), 2),
            number(F.lit(0x8825), 2), number(F.lit(4), 2), number(F.lit(1), 4), number(gps, 4))

    return F.when(F.col("image_id") % 2 == 0, body(_le, "4949")).otherwise(body(_be, "4d4d"))


JPEG = "ffd8ffc0000b080008000a01011100ffda0008010100003f0055ffd9"


@query(HDR + """SELECT image_id, CASE image_id % 4 WHEN 0 THEN orientation ELSE 1 END AS orientation, lower(CASE WHEN image_id % 2 = 0 THEN '49492a000800000002001201030001000000' || '0' || (CASE image_id % 4 WHEN 0 THEN orientation ELSE 1 END) || '00000025880400010000000' || (CASE image_id % 3 WHEN 0 THEN '9000000' ELSE '0000000' END)
    ELSE '4d4d002a00000008000201120003000000010001000088250004000000010000000' || (CASE image_id % 3 WHEN 0 THEN '9' ELSE '0' END) END) AS exif, true AS sound FROM hdr""")
def m12_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF written into JPEGs, sanitised on the way, and read back. Every fourth keeps its orientation, every third its
    pointer to GPS data."""
    k = F.col("image_id")
    rows = hdr(spark, sf_dir).select("image_id", F.unhex(F.lit(JPEG)).alias("content"), _tiff(F.col("orientation"), F.lit(9)).alias("tiff"))
    done = [[metadata.with_exif(F.col("content"), F.col("tiff"), reset, strip) for strip in (False, True)] for reset in (False, True)]
    reset, strip = k % 4 != 0, k % 3 != 0
    out = F.when(reset & strip, done[1][1]).when(reset, done[1][0]).when(strip, done[0][1]).otherwise(done[0][0])
    rows = rows.select("image_id", out.alias("content"))
    return rows.select("image_id", metadata.orientation(F.col("content")).alias("orientation"), F.lower(F.hex(metadata.exif_raw(F.col("content")))).alias("exif"), (F.hex(F.substring("content", -4, 4)) == "0055FFD9").alias("sound"))


_HEX4 = "printf('%02x%02x%02x%02x', {0} % 256, {0} // 256 % 256, {0} // 65536 % 256, {0} // 16777216 % 256)"


def _containers() -> tuple:
    raw = lambda b: F.unhex(F.lit(b.hex()))
    box = lambda kind, body: F.concat(_be(F.octet_length(body) + 8, 4), raw(kind), body)
    riff = lambda kind, body: F.concat(raw(kind), _le(F.octet_length(body), 4), body, F.when(F.octet_length(body) % 2 == 1, raw(b"\0")).otherwise(raw(b"")))
    return raw, box, riff


@query(HDR + f"""SELECT image_id, ['png', 'webp', 'heif', 'tiff', 'other'][image_id % 5 + 1] AS kind, CASE WHEN image_id % 5 < 4 AND (image_id % 7 > 0 OR image_id % 5 = 3) THEN '49492a0008000000' || {_HEX4.format('image_id')} || repeat('00', CAST(image_id % 9 AS INTEGER)) END AS exif FROM hdr""")
def m8_exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF found in containers put together here: a chunk of PNG, one of WebP, an item of HEIF, a TIFF. Every seventh has none."""
    raw, box, riff = _containers()
    k = F.col("image_id")
    tiff = F.concat(raw(b"II*\0\x08\0\0\0"), _le(k, 4), F.unhex(F.repeat(F.lit("00"), (k % 9).cast("int"))))
    some = F.when(k % 7 > 0, F.col("tiff"))
    chunk = lambda kind, body: F.concat(_be(F.octet_length(body), 4), raw(kind), body, raw(bytes(4)))  # noqa: E731  its checksum is not read
    png_file = F.concat(F.unhex(F.lit(headers.PNG_SIGNATURE)), chunk(b"IHDR", raw(bytes(13))), F.coalesce(chunk(b"eXIf", some), raw(b"")), chunk(b"IEND", raw(b"")))
    body = F.concat(raw(b"WEBP"), riff(b"VP8X", raw(b"\x08" + bytes(9))), F.coalesce(riff(b"EXIF", F.concat(F.when(k % 2 == 0, raw(b"Exif\0\0")).otherwise(raw(b"")), some)), raw(b"")))
    webp_file = F.concat(raw(b"RIFF"), _le(F.octet_length(body), 4), body)
    infe = lambda number, kind: box(b"infe", raw(b"\2\0\0\0" + number.to_bytes(2, "big") + b"\0\0" + kind + b"\0"))
    items = box(b"iinf", F.concat(raw(b"\0\0\0\0\0\2"), infe(1, b"av01"), F.when(k % 7 > 0, infe(7, b"Exif")).otherwise(infe(7, b"mime"))))
    # sizes of 4 bytes for offsets and lengths; the item lies in idat, behind a number that says how far to skip
    place = box(b"iloc", F.concat(raw(b"\1\0\0\0\x44\0\0\1\0\7\0\1\0\0\0\1\0\0\0\3"), _be(F.octet_length("tiff") + 10, 4)))
    idat = box(b"idat", F.concat(raw(b"xyz\0\0\0\6Exif\0\0"), F.col("tiff")))
    heif_file = F.concat(box(b"ftyp", raw(b"heic\0\0\0\0")), box(b"meta", F.concat(raw(bytes(4)), items, place, idat)))
    made = hdr(spark, sf_dir).select("image_id", tiff.alias("tiff"))
    content = F.when(k % 5 == 0, png_file).when(k % 5 == 1, webp_file).when(k % 5 == 2, heif_file).when(k % 5 == 3, F.col("tiff")).otherwise(raw(b"no container at all"))
    kind = F.get(F.array(*map(F.lit, ("png", "webp", "heif", "tiff", "other"))), (k % 5).cast("int"))
    return made.select("image_id", kind.alias("kind"), content.alias("content")).select("image_id", "kind", F.lower(F.hex(metadata.exif_raw(F.col("content")))).alias("exif"))


@query(HDR + f"""SELECT image_id, ['png', 'lossy', 'lossless', 'extended'][image_id % 4 + 1] AS kind, CAST(CASE image_id % 4 WHEN 0 THEN 3 ELSE 1 + image_id % 700 END AS INTEGER) AS width,
    repeat({_HEX4.format('image_id')}, CAST(1 + image_id % 40 AS INTEGER)) AS icc, image_id % 4 = 3 OR image_id % 8 = 2 AS alpha FROM hdr""")
def m10_icc_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles put into PNGs and into simple and extended WebPs, which must become extended ones, and read back with what else
    the header says; the extended ones have a profile before."""
    raw, _, riff = _containers()
    k = F.col("image_id")
    w = 1 + k % 700
    icc = F.unhex(F.repeat(F.hex(_le(k, 4)), (1 + k % 40).cast("int")))
    lossy = riff(b"VP8 ", F.concat(raw(bytes(6)), _le(w, 2), _le(F.lit(9), 2), raw(b"xyz")))
    # width less 1 in 14 bits, height less 1 in the next 14, then alpha
    lossless = riff(b"VP8L", F.concat(raw(b"/"), _le((w - 1) + F.lit(8 << 14) + F.when(k % 8 == 2, F.lit(1 << 28)).otherwise(F.lit(0)), 4), raw(b"x")))
    extended = F.concat(riff(b"VP8X", F.concat(raw(b"\x30\0\0\0"), _le(w - 1, 3), _le(F.lit(8), 3))), riff(b"ICCP", raw(b"an older one")), lossy)
    body = F.concat(raw(b"WEBP"), F.when(k % 4 == 1, lossy).when(k % 4 == 2, lossless).otherwise(extended))
    tiny = F.lit(png.encode(np.zeros((2, 3, 1), np.uint8), b"an older one"))
    content = F.when(k % 4 == 0, tiny).otherwise(F.concat(raw(b"RIFF"), _le(F.octet_length(body), 4), body))
    kind = F.get(F.array(*map(F.lit, ("png", "lossy", "lossless", "extended"))), (k % 4).cast("int"))
    done = hdr(spark, sf_dir).select("image_id", kind.alias("kind"), metadata.with_icc(content, icc).alias("content"))
    found = batch.inspect(done.withColumn("pos", F.col("image_id")))
    # of an extended file the flags are the 21st byte
    flags = F.conv(F.hex(F.substring("content", 21, 1)), 16, 10).cast("int")
    alpha = (F.col("kind") != "png") & (flags.bitwiseAND(F.lit(0x30)) == 0x30)
    return found.select("image_id", "kind", "width", F.lower(F.hex(metadata.icc_profile(F.col("content")))).alias("icc"), alpha.alias("alpha"))


@query(HDR + """SELECT image_id, ['png', 'webp', 'avif', 'jpeg'][image_id % 4 + 1] AS kind, CASE WHEN image_id % 5 > 0 THEN 128 + image_id % 50 END AS icc_bytes, CASE WHEN image_id % 5 > 0 AND image_id % 3 = 0 THEN 'E131' END AS error FROM hdr""")
def m3_icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles found in four containers that are put together here; every third profile is none, every fifth file has none."""
    k, raw = F.col("image_id"), lambda h: F.unhex(F.lit(h))
    size = 128 + k % 50
    head = F.concat(F.lpad(F.hex(size), 8, "0"), F.when(k % 3 == 0, F.lit(b"TE\x01T".hex())).otherwise(F.lit(b"TEST".hex())), F.lit("02000000"), F.lit(b"mntrRGB XYZ ".hex()))
    icc = F.when(k % 5 > 0, F.unhex(F.rpad(head, (2 * size).cast("int"), F.lit("0"))))
    box = lambda kind, body: F.concat(_be(F.octet_length(body) + 8, 4), raw(kind.encode().hex()), body)
    riff = lambda kind, body: F.concat(raw(kind.encode().hex()), _le(F.octet_length(body), 4), body, F.when(F.octet_length(body) % 2 == 1, raw("00")).otherwise(raw("")))
    none = raw("")
    colr = F.when(icc.isNotNull(), box("colr", F.concat(raw(b"prof".hex()), icc))).otherwise(none)
    meta = box("meta", F.concat(raw("00000000"), box("iprp", box("ipco", F.concat(box("ispe", raw("00" * 12)), colr)))))
    chunks = F.concat(riff("VP8X", raw("20000000000000000000")), F.when(icc.isNotNull(), riff("ICCP", icc)).otherwise(none), riff("EXIF", raw("4d4d002a")))
    segment = F.when(icc.isNotNull(), F.concat(raw("ffe2"), _be(F.octet_length(icc) + 16, 2), raw(b"ICC_PROFILE\0\1\1".hex()), icc)).otherwise(none)

    @F.pandas_udf("binary")
    def in_png(profiles: pd.Series) -> pd.Series:
        return pd.Series([png.encode(np.zeros((1, 1, 1), np.uint8), None if p is None else bytes(p)) for p in profiles])

    content = (
        F.when(k % 4 == 0, in_png(icc)).when(k % 4 == 1, F.concat(raw(b"RIFF".hex()), _le(F.octet_length(chunks) + 4, 4), raw(b"WEBP".hex()), chunks))
        .when(k % 4 == 2, F.concat(box("ftyp", raw(b"avif\0\0\0\0avifmif1".hex())), meta)).otherwise(F.concat(raw("ffd8"), segment, raw(JPEG[4:]))))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("png", "webp", "avif", "jpeg"))), (k % 4 + 1).cast("int"))
    return hdr(spark, sf_dir).select("image_id", kind.alias("kind"), content.alias("content")).select(
        "image_id", "kind", F.octet_length(metadata.icc_profile(F.col("content"))).cast("long").alias("icc_bytes"), metadata.icc_error(F.col("content")).alias("error"))


@query(HDR + "SELECT image_id, CASE WHEN image_id % 6 IN (0, 1) THEN NULL ELSE 'E131' END AS error, CAST(CASE WHEN image_id % 6 IN (0, 1, 4) THEN 10 END AS INTEGER) AS width, CAST(CASE WHEN image_id % 6 IN (0, 1, 4) THEN 8 END AS INTEGER) AS height FROM hdr")
def s19_jpeg_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JPEGs, one with fill bytes before a marker, and damaged ones; sizes come from what can be read before the damage."""
    k, raw = F.col("image_id") % 6, lambda h: F.unhex(F.lit(h))
    broken = {1: JPEG[:4] + "ffff" + JPEG[4:], 2: "00" + JPEG[2:], 3: JPEG[:8] + "0001" + JPEG[12:], 4: JPEG[: JPEG.index("ffda") + 20], 5: JPEG[:20]}
    content = raw(JPEG)
    for at, data in broken.items():
        content = F.when(k == at, raw(data)).otherwise(content)
    rows = batch.inspect(hdr(spark, sf_dir).select("image_id", content.alias("content")).withColumn("pos", F.col("image_id")))
    return rows.select("image_id", metadata.jpeg_error(F.col("content")).alias("error"), "width", "height")


# Batches and telemetry

@query(HDR + f"""SELECT image_id AS pos, e IS NULL AS success, '[' || e || '] img_' || image_id || '.png: ' || name AS error, e AS "errorCode", category AS "errorCategory" FROM (SELECT image_id, CASE WHEN w * 5 > 32768 OR h * 5 > 32768 THEN 'E121' WHEN w * 5 * h * 5 > 100000000 THEN 'E122' WHEN bytes_in > 33554432 THEN 'E123' END AS e FROM hdr) LEFT JOIN {ERROR_ROWS} ON e = code""")
def b3_batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(rules.dimension_error(F.col("w") * 5, F.col("h") * 5), F.when(F.col("bytes_in") > 32 * MIB, "E123"))
    rows = errors.with_errors(hdr(spark, sf_dir).select(F.col("image_id").alias("pos"), code.alias("e")), "e")
    path = F.concat(F.lit("img_"), F.col("pos").cast("string"), F.lit(".png"))
    return rows.select("pos", F.col("e").isNull().alias("success"), F.when(F.col("e").isNotNull(), errors.message(F.col("e"), path, F.col("name"))).alias("error"), F.col("e").alias("errorCode"), F.col("category").alias("errorCategory"))


@query("""WITH t AS (SELECT event_id, round(abs(value), 3) AS d, user_id % 50 AS o, event_id % 900 * 1000 AS bi, event_id % 700 * 900 AS bo, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id * 100000 END AS rss FROM events)
    SELECT event_id, '1.0.0' AS version, round(d + o + 1, 6) AS "totalMs", greatest(0, least(4294967295, coalesce(rss, 640 * 480 * 4 + bo))) AS "peakRss", bi AS "bytesIn", bo AS "bytesOut",
    round(CASE WHEN bi = 0 THEN 0 ELSE bo / CAST(bi AS DOUBLE) END, 9) AS "compressionRatio", bi AS "inputSize", round(d, 6) AS "decodeTime" FROM t""")
def a1_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        e, F.round(F.abs("value"), 3).alias("decodeMs"), (F.col("user_id") % 50).cast("double").alias("opsMs"), F.lit(1.0).alias("encodeMs"), F.when(e % 4 != 0, e * 100_000).alias("rss"),
        F.lit(640).alias("width"), F.lit(480).alias("height"), (e % 900 * 1000).alias("bytesIn"), (e % 700 * 900).alias("bytesOut"))
    got = metrics.metrics(rows)
    return got.select("event_id", "version", F.round("totalMs", 6).alias("totalMs"), "peakRss", "bytesIn", "bytesOut", F.round("compressionRatio", 9).alias("compressionRatio"), "inputSize", F.round("decodeTime", 6).alias("decodeTime"))


_PAIR = PX() + ", b AS (SELECT image_id, y, x, c, greatest(0, least(255, v + CAST(CASE WHEN image_id % 3 = 0 THEN 0 ELSE (x + y) % 5 - 2 END AS INTEGER))) AS v FROM px) "


def _noisy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = px(spark, sf_dir)
    return a, a.withColumn("v", pixels.clamp(F.col("v") + F.when(F.col("image_id") % 3 == 0, 0).otherwise((F.col("x") + F.col("y")) % 5 - 2)))


@query(_PAIR + """SELECT image_id, round(mse, 6) AS mse, round(CASE WHEN mse = 0 THEN 999 ELSE 10 * log10(65025.0 / mse) END, 6) AS psnr
    FROM (SELECT px.image_id, avg(CAST((px.v - b.v) * (px.v - b.v) AS DOUBLE)) AS mse FROM px JOIN b USING (image_id, y, x, c) GROUP BY px.image_id)""")
def a3_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.psnr(*_noisy(spark, sf_dir))
    return got.select("image_id", F.round("mse", 6).alias("mse"), F.round(F.when(F.col("mse") == 0, 999.0).otherwise(F.col("psnr")), 6).alias("psnr"))


@query(_PAIR + """, s AS (SELECT px.image_id, px.y // 4 AS by, px.x // 4 AS bx, avg(CAST(px.v AS DOUBLE)) AS mx, avg(CAST(b.v AS DOUBLE)) AS my, avg(CAST(px.v * px.v AS DOUBLE)) AS xx, avg(CAST(b.v * b.v AS DOUBLE)) AS yy, avg(CAST(px.v * b.v AS DOUBLE)) AS xy
    FROM px JOIN b USING (image_id, y, x, c) GROUP BY px.image_id, px.c, px.y // 4, px.x // 4)
    SELECT image_id, round(avg(((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225))), 6) AS ssim FROM s GROUP BY image_id""")
def a4_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ssim(*_noisy(spark, sf_dir), window=4).select("image_id", F.round("ssim", 6).alias("ssim"))


@query(_PAIR + """, s AS (SELECT px.image_id, avg(CAST((px.v - b.v) * (px.v - b.v) AS DOUBLE)) AS mse, avg(CAST(px.v AS DOUBLE)) AS mx, avg(CAST(b.v AS DOUBLE)) AS my, avg(CAST(px.v * px.v AS DOUBLE)) AS xx, avg(CAST(b.v * b.v AS DOUBLE)) AS yy, avg(CAST(px.v * b.v AS DOUBLE)) AS xy
    FROM px JOIN b USING (image_id, y, x, c) GROUP BY px.image_id)
    SELECT image_id, round(CASE WHEN mse = 0 THEN 999 ELSE 10 * log10(65025.0 / mse) END, 6) AS psnr, round(((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225)) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225)), 6) AS ssim FROM s""")
def a5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both measures at once, SSIM over windows of 8."""
    got = metrics.quality(*_noisy(spark, sf_dir))
    return got.select("image_id", F.round(F.when(F.col("mse") == 0, 999.0).otherwise(F.col("psnr")), 6).alias("psnr"), F.round("ssim", 6).alias("ssim"))


@query(PX() + "SELECT image_id, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x, c))) AS pixel_hash FROM px GROUP BY image_id")
def a6_pixel_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.pixel_hash(px_rows(spark, sf_dir))


@query(HDR + "SELECT image_id, CASE WHEN w = 0 THEN false ELSE h / CAST(w AS DOUBLE) <= 0.95 END AS passes, round((h - w) / CAST(w AS DOUBLE) * 100, 6) AS delta FROM hdr")
def a7_size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hdr(spark, sf_dir).select("image_id", metrics.size_gate(F.col("h"), F.col("w"), F.lit(0.95)).alias("passes"), F.round(metrics.delta_percent(F.col("h"), F.col("w")), 6).alias("delta"))


# Real bytes

@query(PX() + "SELECT image_id, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY x DESC, y))) AS pixel_hash, 8 AS width, 8 AS height FROM px GROUP BY image_id")
def k8_png_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row arrays written as PNG files, turned by a quarter and mirrored through the batch operator, and read again."""
    @F.pandas_udf("binary")
    def samples(data: pd.Series) -> pd.Series:
        return pd.Series([png.decode(d).tobytes() for d in data])

    told = {"opaque": F.lit(True)} | {c: F.lit(0.0) for c in ("decodeMs", "decodeCpu", "decoded")}
    made = batch.encoded(px_rows(spark, sf_dir).withColumns(told), "png", 6, None)
    done = batch.process(made.select("pos", F.lit("memory").alias("source"), F.col("output").alias("content")), plan.rewrite((plan.rotate(270),)), "png")
    return done.select(F.col("pos").alias("image_id"), F.sha2(samples("output"), 256).alias("pixel_hash"), "width", "height")


@query(PX() + "SELECT image_id, sha256(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x DESC))) AS pixel_hash FROM px GROUP BY image_id")
def t1_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image written as a file by the sink, taken up by a stream for each of the folders they are dealt to, mirrored on the
    way, and read again."""
    folder = files.shared_folder(spark, "stream")
    told = {"opaque": F.lit(True)} | {c: F.lit(0.0) for c in ("decodeMs", "decodeCpu", "decoded")}
    try:
        made = batch.encoded(px_rows(spark, sf_dir).withColumns(told), "png", 1, None).withColumnRenamed("bad", "code").withColumnRenamed("why", "message")
        inputs = files.make_folder(spark, f"{folder}/in")
        dealt = [files.make_folder(spark, f"{inputs}/{k}") for k in range(1 + read(spark, sf_dir, "embeddings").count() // stream.BATCH_FILES)]
        at = F.pmod(F.xxhash64("pos"), F.lit(len(dealt))).cast("string")
        write_files(made.withColumns({"source": F.lit("memory"), "outputPath": F.concat(F.lit(f"{inputs}/"), at, F.lit("/"), F.col("pos").cast("string"), F.lit(".png"))}), inputs)
        stream.start_each(spark, dealt, f"{folder}/out", f"{folder}/state", "png", [{"op": "flipH"}])

        @F.pandas_udf("binary")
        def samples(data: pd.Series) -> pd.Series:
            return pd.Series([png.decode(d).tobytes() for d in data])

        done = spark.read.parquet(f"{folder}/out")
        image = F.regexp_extract("source", "([0-9]+)[.]png$", 1).cast("long")
        return files.kept(done.select(image.alias("image_id"), F.sha2(samples("output"), 256).alias("pixel_hash")))
    finally:
        files.remove(spark, folder)
