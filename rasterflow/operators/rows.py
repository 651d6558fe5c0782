"""Pixel operators over row arrays, for images of any sizes in one frame.

A frame has a row per image row, or per stretch of one: (image_id, w, h, n, y, x0, p), where w, h and n are the image's
width, height and channels, y the row, x0 the column at which the stretch starts, and p an array per channel with the
samples of the stretch. Further columns go along. Whatever changes samples or columns within a row is a projection. Only what needs
several rows of an image, that is the vertical pass of a resample and a turn on its side, moves anything: once, by image
and block of BLOCK columns, so that no task holds more than such a block of one image.

Sizes are columns, so every image has its own. Resampling weights depend on the two lengths of an axis and the window alone;
they are worked out in Spark once for each distinct combination, and joined.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.geometry import big, div

#: Columns of a block; weights that are broadcast at most, counted as output samples of all distinct axes.
BLOCK, BROADCAST_SAMPLES = 64, 1 << 20
ONE, SUPPORT = 16_384, 3
CELL = ("y", "x0", "p")
#: Images of fewer pixels are taken to have alpha that is not all 255, unseen.
OPAQUE_FROM = 1_000_000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once: a column that is named inside a lambda only may be put in there by the optimiser,
    and would be worked out again for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def size() -> Column:
    """Columns of a stretch."""
    return F.size(F.get("p", 0))


def planes(change: Callable[[Column], Column]) -> Column:
    return F.transform("p", change)


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("int")


def from_samples(px: DataFrame, w: Column | int, h: Column | int, n: int, data: str) -> DataFrame:
    """px with an array column of all samples of an image in row order, channels side by side, as row arrays."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (w, h))
    rest = [F.col(c) for c in px.columns if c not in (data, "_w", "_h")]
    made = px.select(*rest, F.col(data).alias("_data"), w.cast("int").alias("_w"), h.cast("int").alias("_h"))
    made = made.select("*", F.explode(F.sequence(F.lit(0), F.col("_h") - 1)).alias("_y"))
    row = F.slice("_data", F.col("_y") * F.col("_w") * n + 1, F.col("_w") * n)
    plane = lambda c: let(row, lambda r: F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda x: F.get(r, x * n + c)))
    sizes = (v.cast("long").alias(c) for v, c in ((F.col("_w"), "w"), (F.col("_h"), "h"), (F.lit(n), "n")))
    return made.select(*rest, *sizes, F.col("_y").cast("long").alias("y"), F.lit(0).cast("long").alias("x0"), F.array(*(plane(c) for c in range(n))).alias("p"))


def to_long(rows: DataFrame) -> DataFrame:
    """(image_id, y, x, c, v): a row per sample."""
    each = rows.select("image_id", "y", "x0", F.posexplode("p").alias("c", "plane")).select("image_id", "y", "x0", "c", F.posexplode("plane").alias("i", "v"))
    return each.select("image_id", F.col("y").cast("int").alias("y"), (F.col("x0") + F.col("i")).cast("int").alias("x"), "c", F.col("v").cast("int").alias("v"))


# Within a row


def flip_h(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"x0": F.col("w") - F.col("x0") - size(), "p": planes(F.reverse)})


def flip_v(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.col("h") - 1 - F.col("y"))


def crop(rows: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """The part of each image that starts at (x, y); it must lie within."""
    x, y, w, h = map(big, (x, y, w, h))
    first, last = F.greatest(x - F.col("x0"), big(0)), F.least(x + w - F.col("x0"), size())
    held = rows.withColumns({"_a": first.cast("int"), "_b": last.cast("int")}).filter((F.col("_a") < F.col("_b")) & F.col("y").between(y, y + h - 1))
    cut = held.withColumn("p", planes(lambda plane: F.slice(plane, F.col("_a") + 1, F.col("_b") - F.col("_a"))))
    return cut.withColumns({"x0": F.col("x0") + F.col("_a") - x, "y": F.col("y") - y}).withColumns({"w": w, "h": h}).drop("_a", "_b")


def tone(rows: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    """change on every sample but alpha, which is the last channel of two or four."""
    alpha = F.col("n").isin(2, 4)
    return rows.withColumn("p", F.transform("p", lambda plane, c: F.when(alpha & (c == F.col("n") - 1), plane).otherwise(F.transform(plane, lambda v: clamp(change(v))))))


def brightness(rows: DataFrame, level: int) -> DataFrame:
    return tone(rows, lambda v: v + level)


def contrast(rows: DataFrame, amount: int) -> DataFrame:
    factor = ((100.0 + amount) / 100.0) ** 2
    return tone(rows, lambda v: F.floor(((v / F.lit(255.0) - 0.5) * factor + 0.5) * 255.0))


def grayscale(rows: DataFrame) -> DataFrame:
    """One channel of luma; alpha goes. An image of one or two channels keeps its first."""
    luma = F.zip_with(F.zip_with(F.get("p", 0), F.get("p", 1), lambda r, g: 2126 * r + 7152 * g), F.get("p", 2), lambda s, b: div(s + 722 * b, 10_000).cast("int"))
    return rows.withColumns({"p": F.when(F.col("n") < 3, F.slice("p", 1, 1)).otherwise(F.array(luma)), "n": big(1)})


def normalize(rows: DataFrame) -> DataFrame:
    """RGB and RGBA stay; luma is repeated as RGB, and alpha beside luma goes."""
    return rows.withColumns({"p": F.when(F.col("n") >= 3, F.col("p")).otherwise(F.array_repeat(F.get("p", 0), 3)), "n": F.greatest("n", big(3))})


def colored(rows: DataFrame) -> DataFrame:
    """Luma as RGB, luma with alpha as RGBA: what a resample reads."""
    both = F.concat(F.array_repeat(F.get("p", 0), 3), F.slice("p", 2, 1))
    p = F.when(F.col("n") >= 3, F.col("p")).when(F.col("n") == 2, both).otherwise(F.array_repeat(F.get("p", 0), 3))
    return rows.withColumns({"p": p, "n": F.when(F.col("n") >= 3, F.col("n")).otherwise(F.col("n") + 2)})


# Across rows


def blocks(rows: DataFrame) -> DataFrame:
    """A row per image and block of BLOCK columns: `cells` has (y, x0, p) of its stretches, in order."""
    block = F.explode(F.sequence(div(F.col("x0"), BLOCK), div(F.col("x0") + size() - 1, BLOCK))).alias("block")
    cut = rows.select("*", block).withColumn("_from", F.greatest(F.col("block") * BLOCK - F.col("x0"), big(0)).cast("int"))
    cut = cut.withColumn("_n", F.least(F.col("block") * BLOCK + BLOCK - F.col("x0"), size()).cast("int") - F.col("_from"))
    cut = cut.withColumns({"p": planes(lambda plane: F.slice(plane, F.col("_from") + 1, F.col("_n"))), "x0": F.col("x0") + F.col("_from")}).drop("_from", "_n")
    rest = [c for c in rows.columns if c not in (*CELL, "image_id")]
    gathered = cut.groupBy("image_id", "block").agg(*(F.first(c).alias(c) for c in rest), F.array_sort(F.collect_list(F.struct(*CELL))).alias("cells"))
    kind = dict(gathered.dtypes)["cells"]

    # stretches of one row that stand side by side become one
    def joined(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["y"].alias("y"), last["x0"].alias("x0"), F.zip_with(last["p"], s["p"], lambda a, b: F.concat(a, b)).alias("p"))
        return F.when(last["y"] == s["y"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(s))).cast(kind)

    parted = F.size(F.array_distinct(F.transform("cells", lambda s: s["y"]))) < F.size("cells")
    return gathered.withColumn("cells", F.when(parted, F.aggregate("cells", F.array().cast(kind), joined)).otherwise(F.col("cells")))


def _opened(grouped: DataFrame) -> DataFrame:
    rest = [c for c in grouped.columns if c not in ("cells", "block")]
    return grouped.select(*rest, F.explode("cells").alias("s")).select(*rest, "s.*")


def reorient(rows: DataFrame, orientation: Column, sideways: bool = True) -> DataFrame:
    """Each image turned upright from its EXIF orientation; values other than 2..8 leave it. sideways: whether
    any may be 5 to 8, which turn rows into columns; nothing moves otherwise."""
    rows = rows.withColumn("_o", F.coalesce(orientation, F.lit(1)).cast("int"))
    if sideways:
        turned = F.col("_o").between(5, 8)
        column = F.sequence(F.lit(0), F.size(F.get(F.get("cells", 0)["p"], 0)) - 1)
        start = F.get("cells", 0)["x0"]
        across = lambda i: F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda c: F.transform("cells", lambda s: F.get(F.get(s["p"], c), i)))
        lying = F.transform(column, lambda i: F.struct((start + i).cast("long").alias("y"), F.get("cells", 0)["y"].alias("x0"), across(i).alias("p")))
        rows = _opened(blocks(rows).withColumn("cells", F.when(turned, lying).otherwise(F.col("cells"))))
        rows = rows.withColumns({"w": F.when(turned, F.col("h")).otherwise(F.col("w")), "h": F.when(turned, F.col("w")).otherwise(F.col("h"))})
    # after rows became columns: 5 is done, 6 is mirrored, 7 turned by half, 8 upside down
    mirror, upset = F.col("_o").isin(2, 3, 6, 7), F.col("_o").isin(3, 4, 7, 8)
    x0, y = F.col("w") - F.col("x0") - size(), F.col("h") - 1 - F.col("y")
    return rows.withColumns({"x0": F.when(mirror, x0).otherwise(F.col("x0")), "y": F.when(upset, y).otherwise(F.col("y")), "p": F.when(mirror, planes(F.reverse)).otherwise(F.col("p"))}).drop("_o")


def whole_rows(rows: DataFrame) -> DataFrame:
    """Stretches put together, one row each."""
    rest = [c for c in rows.columns if c not in (*CELL, "image_id")]
    got = rows.groupBy("image_id", "y").agg(*(F.first(c).alias(c) for c in rest), F.array_sort(F.collect_list(F.struct("x0", "p"))).alias("parts"))
    whole = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda c: F.flatten(F.transform("parts", lambda s: F.get(s["p"], c))))
    return got.withColumns({"x0": F.get("parts", 0)["x0"], "p": whole}).drop("parts")


def kernel(t: Column) -> Column:
    """Lanczos with three lobes."""
    a, x = F.abs(t), F.abs(t) * math.pi
    return F.when(a < 1e-12, 1.0).when(a >= SUPPORT, 0.0).otherwise(SUPPORT * F.sin(x) * F.sin(x / SUPPORT) / (x * x))


def weights(axes: DataFrame) -> DataFrame:
    """axes: distinct (src, dst, start, length), all of an axis but its samples: `taps`, an array per output sample of the first
    input sample and the weights from there on, as whole parts of ONE. They depend on nothing else, and sums are in order."""
    scale = F.col("length") / F.col("dst")

    def taps(d: Column) -> Column:
        centre = F.col("start") + (d + 0.5) * scale
        wide = F.greatest(scale, F.lit(1.0))
        low = F.greatest(F.floor(centre - SUPPORT * wide), big(0))
        high = F.greatest(F.least(F.ceil(centre + SUPPORT * wide), F.col("src")), low + 1)
        raw = F.transform(F.sequence(low, high - 1), lambda s: kernel((s + 0.5 - centre) / wide))
        total = F.aggregate(raw, F.lit(0.0), lambda a, k: a + k)
        one = F.get(F.transform(F.array(F.struct(raw.alias("raw"), total.alias("total"))), lambda r: F.transform(r["raw"], lambda k: F.floor(k / r["total"] * ONE + 0.5).cast("int"))), 0)
        return F.struct(low.cast("int").alias("first"), one.alias("k"))

    return axes.withColumn("taps", F.transform(F.sequence(F.lit(0).cast("long"), F.col("dst") - 1), taps))


AXIS = ("src", "dst", "start", "length")


def _weighted(rows: DataFrame, sizes: DataFrame, src: str, dst: str, start: str, length: str) -> DataFrame:
    """rows with `taps` of their axis; sizes has the same columns, a row per image or less."""
    of = dict(zip(AXIS, (src, dst, start, length)))
    axes = sizes.select(*(F.col(c).alias(a) for a, c in of.items())).distinct()
    found = weights(axes)
    if (axes.agg(F.sum("dst")).first()[0] or 0) <= BROADCAST_SAMPLES:
        found = F.broadcast(found)
    return rows.join(found, [F.col(c) == F.col(a) for a, c in of.items()]).drop(*AXIS)


def _level(s: Column, veiled: Column) -> Column:
    """A weighted sum as a sample: bytes, but where colour is weighted by alpha, which only may not be negative."""
    value = F.floor((s + ONE // 2) / ONE)
    return F.greatest(big(0), F.when(veiled, value).otherwise(F.least(value, big(255))))


def resample(rows: DataFrame, w: Column, h: Column, window: tuple[Column, Column, Column, Column] | None = None, opaque: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Each image at w by h, from the window (left, top, width, height) of it, the whole where none is given. With alpha, colour is
    weighted by it before, and divided by what it became after; where that is 0, so is colour. Images whose size and window
    stay are left as they are. opaque: where it holds, alpha of large images is known to be 255 and weighs nothing. sizes: all
    (w, h) that rows may have, from which the weights are made; without it they are looked for in rows.

    Rows must be whole. The horizontal pass is a projection; the vertical one gathers blocks of columns, once."""
    left, top, width, height = window or (F.lit(0.0), F.lit(0.0), F.col("w").cast("double"), F.col("h").cast("double"))
    same = (big(w) == F.col("w")) & (big(h) == F.col("h")) & (left == 0) & (top == 0) & (width == F.col("w")) & (height == F.col("h"))
    known = F.lit(False) if opaque is None else F.coalesce(opaque, F.lit(False)) & (F.col("w") * F.col("h") >= OPAQUE_FROM)
    named = {"_w": big(w), "_h": big(h), "_left": left.cast("double"), "_top": top.cast("double"), "_width": width.cast("double"), "_height": height.cast("double")}
    sizes = (rows if sizes is None else sizes).select("w", "h").distinct().withColumns(named)
    rows = colored(rows).withColumns(named | {"_veiled": (F.col("n") == 4) & ~same & ~known})
    veiled = F.col("_veiled")
    weigh = F.transform("p", lambda plane, c: F.when(c == 3, F.transform(plane, lambda v: v.cast("long") * 255)).otherwise(F.zip_with(plane, F.get("p", 3), lambda v, a: v.cast("long") * a)))
    rows = rows.withColumn("p", F.when(veiled, weigh).otherwise(F.transform("p", lambda plane: plane.cast("array<long>"))))

    def dot(plane: Column, tap: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(plane, tap["first"] + 1, F.size(tap["k"])), tap["k"], lambda v, k: v * k), big(0), lambda a, v: a + v)

    rows = _weighted(rows, sizes, "w", "_w", "_left", "_width")
    rows = rows.withColumn("p", planes(lambda plane: F.transform("taps", lambda tap: _level(dot(plane, tap), veiled)))).drop("taps")
    rows = rows.withColumns({"w": F.col("_w"), "x0": big(0)})
    cols = _weighted(blocks(rows), sizes, "h", "_h", "_top", "_height")
    i_of = F.sequence(F.lit(0), F.size(F.get(F.get("cells", 0)["p"], 0)) - 1)
    upright = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda c: F.transform(i_of, lambda i: F.transform("cells", lambda s: F.get(F.get(s["p"], c), i))))
    # upright: channel, column, row
    done = let(upright, lambda up: F.transform("taps", lambda tap, y: F.struct(y.cast("long").alias("y"), F.get("cells", 0)["x0"].alias("x0"), F.transform(up, lambda plane: F.transform(plane, lambda column: _level(dot(column, tap), veiled))).alias("p"))))
    out = _opened(cols.withColumn("cells", done).drop("taps")).withColumn("h", F.col("_h"))
    alpha = F.transform(F.get("p", 3), lambda a: F.least(a, big(255 * 255)))
    lifted = F.transform("p", lambda plane, c: F.when(c == 3, F.transform(alpha, lambda a: clamp(F.round(a / 255)))).otherwise(
        F.zip_with(plane, alpha, lambda v, a: F.when(a > 0, clamp(F.round(F.try_divide(v * 255, a)))).otherwise(F.lit(0)))))
    return out.withColumn("p", F.when(veiled, lifted).otherwise(F.transform("p", lambda plane: plane.cast("array<int>")))).drop(*named, "_veiled")


def extract(rows: DataFrame, tw: Column, th: Column, fit: str, x: Column, y: Column, cw: Column, ch: Column, opaque: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """A resize and the crop after it in one pass, from the window of the source that the crop shows."""
    at = geometry.extract_window(F.col("w"), F.col("h"), tw, th, fit, x, y, cw, ch)
    return resample(rows, cw, ch, (at["src_left"], at["src_top"], at["src_width"], at["src_height"]), opaque, sizes)


def cover(rows: DataFrame, tw: Column, th: Column, opaque: Column | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Scaled to whole sides that cover the target, and cut to it around the centre, without the larger image between."""
    w, h = F.col("w"), F.col("h")
    rw, rh = geometry.cover(w, h, tw, th)
    tw, th = big(tw), big(th)
    same = (w == tw) & (h == th)
    window = (div(rw - tw, 2) * w / rw, div(rh - th, 2) * h / rh, tw * w / rw, th * h / rh)
    return resample(rows, tw, th, tuple(F.when(same, whole).otherwise(v) for v, whole in zip(window, (F.lit(0.0), F.lit(0.0), w.cast("double"), h.cast("double")))), opaque, sizes)


def pixel_hash(rows: DataFrame) -> DataFrame:
    """(image_id, pixel_hash): SHA-256 of the samples in row order, channels side by side."""
    cell = F.transform(F.sequence(F.lit(0), size() - 1), lambda i: F.array_join(F.transform("p", lambda plane: F.lpad(F.hex(F.get(plane, i)), 2, "0")), ""))
    texts = rows.select("image_id", "y", "x0", F.array_join(cell, "").alias("b"))
    parts = F.array_sort(F.collect_list(F.struct("y", "x0", "b")))
    return texts.groupBy("image_id").agg(F.sha2(F.unhex(F.array_join(F.transform(parts, lambda s: s["b"]), "")), 256).alias("pixel_hash"))
