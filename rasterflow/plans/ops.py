"""The operation algebra: what can be queued, what each operation asks for and does, and how a queue is rewritten.

A queue is a tuple of Op, checked as it is built. Rewriting happens here, before a DataFrame exists, as no Catalyst
rule knows that two resizes collapse or that a crop after a resize is one window of the source.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import ImageError
from ..functions.rules import MAX_SIDE, U32

SCHEMA = "op string, width int, height int, fit string, x long, y long, crop_width int, crop_height int, degrees int, value int, orientation int"
FITS = ("inside", "cover", "fill")
ANGLES = (0, 90, -90, 180, -180, 270, -270)

PIXELS, COLOR, ORIENTATION = "decoded_pixels", "color_state", "orientation"
MUTATES, GEOMETRY, NORMALIZES = "mutates_pixels", "changes_geometry", "normalizes_color"
_BASE = (PIXELS, COLOR)
#: op -> name of its contract, what it requires, what it does.
CONTRACTS = {
    "resize": ("resize", _BASE, (MUTATES, GEOMETRY)),
    "extract": ("extract", _BASE, (MUTATES, GEOMETRY)),
    "crop": ("crop", _BASE, (MUTATES, GEOMETRY)),
    "rotate": ("rotate", _BASE, (MUTATES, GEOMETRY)),
    "flip_h": ("flip", _BASE, (MUTATES, GEOMETRY)),
    "flip_v": ("flip", _BASE, (MUTATES, GEOMETRY)),
    "brightness": ("tonemap", _BASE, (MUTATES, NORMALIZES)),
    "contrast": ("tonemap", _BASE, (MUTATES, NORMALIZES)),
    "auto_orient": ("auto_orient", (*_BASE, ORIENTATION), (MUTATES, GEOMETRY)),
    "grayscale": ("grayscale", _BASE, (MUTATES, GEOMETRY, NORMALIZES)),
    "normalize": ("color_space", _BASE, (MUTATES, NORMALIZES)),
}


@dataclass(frozen=True)
class Op:
    op: str
    width: int | None = None
    height: int | None = None
    fit: str | None = None
    x: int | None = None
    y: int | None = None
    crop_width: int | None = None
    crop_height: int | None = None
    degrees: int | None = None
    value: int | None = None
    orientation: int | None = None


def whole(name: str, v) -> int:
    if isinstance(v, bool) or not isinstance(v, (int, float)) or (isinstance(v, float) and (not math.isfinite(v) or v != math.floor(v))):
        raise ImageError("E400", f"{name} is no whole number: {v!r}")
    return int(v)


def resize(width=None, height=None, fit: str = "inside") -> Op:
    kind = str(fit).strip().lower()
    if kind not in FITS:
        raise ImageError("E204", f"unknown fit {fit!r}")
    if width is None and height is None:
        raise ImageError("E203", "a resize needs a width or a height")
    sides = []
    for name, v in (("width", width), ("height", height)):
        if v is not None:
            try:
                v = whole(name, v)
            except ImageError:
                raise ImageError("E203", f"{name} is no whole number: {v!r}") from None
            if not 0 < v <= MAX_SIDE:
                raise ImageError("E203", f"{name} is not in 1..{MAX_SIDE}: {v}")
        sides.append(v)
    return Op("resize", *sides, fit=kind)


def crop(x, y, width, height) -> Op:
    x, y, width, height = (whole(n, v) for n, v in (("x", x), ("y", y), ("width", width), ("height", height)))
    if x < 0 or y < 0:
        raise ImageError("E400", f"a crop's offset is not negative: {x}, {y}")
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ImageError("E201", f"a crop's size is in 1..{MAX_SIDE}: {width}x{height}")
    if max(x, y) > U32:
        raise ImageError("E400", f"offset too large: {x}, {y}")
    return Op("crop", x=x, y=y, crop_width=width, crop_height=height)


def rotate(degrees) -> Op:
    d = whole("degrees", degrees)
    if d not in ANGLES:
        raise ImageError("E202", f"not a quarter turn: {d}")
    return Op("rotate", degrees=d)


def _tone(kind: str, v) -> Op:
    v = whole(kind, v)
    if not -100 <= v <= 100:
        raise ImageError("E400", f"{kind} is not in -100..100: {v}")
    return Op(kind, value=v)


def quality(v) -> int | None:
    """A quality as it is used: a whole number from 0, at most 100; null where none is given."""
    if v is None:
        return None
    if (v := whole("quality", v)) < 0:
        raise ImageError("E400", f"quality is negative: {v}")
    return min(v, 100)


def brightness(v) -> Op:
    return _tone("brightness", v)


def contrast(v) -> Op:
    return _tone("contrast", v)


def inside_size(w: int, h: int, tw: int | None, th: int | None) -> tuple[int, int]:
    half_up = lambda v: math.floor(v + 0.5)
    if tw is not None and (th is None or w / h > tw / th):
        return tw, half_up(h * (tw / w))
    return (w, h) if th is None else (half_up(w * (th / h)), th)


def check(ops: tuple[Op, ...], available: frozenset[str] = frozenset((PIXELS, COLOR, ORIENTATION))) -> None:
    """Every operation finds what its contract requires, given what those before it provide."""
    have = set(available)
    for op in ops:
        name, needs, does = CONTRACTS[op.op]
        if not have.issuperset(needs):
            raise ImageError("E400", f"{name}: operation prerequisites are not satisfied")
        if NORMALIZES in does:
            have.add(COLOR)


def _merged(run: list[Op]) -> Op:
    """Resizes of one fit in a row: the last that names both sides wins; one side alone drops the other."""
    out = run[0]
    for op in run[1:]:
        out = replace(out, width=op.width, height=op.height) if op.width is not None or op.height is not None else out
    return out


def rewrite(ops: tuple[Op, ...]) -> tuple[Op, ...]:
    """One pass from left to right. Resizes of the same fit collapse (the merged one is not looked at again); a
    resize, unless it is a cover, and the crop after it become one extract; an inside resize after a crop gets both
    its sides."""
    if len(ops) < 2:
        return ops
    out: list[Op] = []
    rest = list(ops)
    while rest:
        run = 1
        while rest[0].op == "resize" and run < len(rest) and (rest[run].op, rest[run].fit) == ("resize", rest[0].fit):
            run += 1
        pair = tuple(op.op for op in rest[:2])
        if run > 1:
            out.append(_merged(rest[:run]))
        elif pair == ("resize", "crop") and rest[0].fit != "cover":
            first, second = rest[:2]
            out.append(replace(second, op="extract", width=first.width, height=first.height, fit=first.fit))
            run = 2
        elif pair == ("crop", "resize") and rest[1].fit == "inside":
            w, h = inside_size(rest[0].crop_width, rest[0].crop_height, rest[1].width, rest[1].height)
            out += [rest[0], replace(rest[1], width=w, height=h)]
            run = 2
        else:
            out.append(rest[0])
        del rest[:run]
    return tuple(out)


def ops_frame(spark: SparkSession, plans: dict[str, tuple[Op, ...]]) -> DataFrame:
    """(plan, ops array<struct>): queues as data."""
    rows = [(name, [tuple(asdict(op).values()) for op in ops]) for name, ops in plans.items()]
    return spark.createDataFrame(rows, f"plan string, ops array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>")


def ops_column(ops: tuple[Op, ...]) -> Column:
    """One queue as a literal array of operations."""
    kind = f"array<struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>>"
    return F.from_json(F.lit(json.dumps([asdict(op) for op in ops])), kind)


def contracts(spark: SparkSession) -> DataFrame:
    """(op, contract, requires, effects): 11 rows."""
    return spark.createDataFrame([(op, name, list(needs), list(does)) for op, (name, needs, does) in CONTRACTS.items()], "op string, contract string, requires array<string>, effects array<string>")


def sequence_error(ops: Column, have: Column) -> Column:
    """Of an array of operation names and one of the capabilities at hand: the error code, and the place of the first operation
    whose contract they do not meet; both null where all are met. What an operation provides is there for those behind it."""
    needs = F.create_map(*(x for op, (_, r, _) in CONTRACTS.items() for x in (F.lit(op), F.array(*map(F.lit, r)))))
    gives = F.create_map(*(x for op, (_, _, does) in CONTRACTS.items() for x in (F.lit(op), F.array(*([F.lit(COLOR)] if NORMALIZES in does else [])).cast("array<string>"))))

    def step(s: Column, op: Column) -> Column:
        met = F.size(F.array_except(F.coalesce(F.try_element_at(needs, op), F.array(F.lit("an operation that is none"))), s["have"])) == 0
        bad = F.coalesce(s["bad"], F.when(~met, s["i"]))
        return F.struct(F.array_union(s["have"], F.coalesce(F.try_element_at(gives, op), F.array().cast("array<string>"))).alias("have"), (s["i"] + 1).alias("i"), bad.alias("bad"))

    begin = F.struct(have.alias("have"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("bad"))
    return F.aggregate(ops, begin, step, lambda s: F.struct(F.when(s["bad"].isNotNull(), "E400").alias("error"), s["bad"].alias("failed_at")))


def color_state(layout: Column, bits: Column, icc: Column) -> Column:
    """Of a decoded image: layout is rgb, rgba, luma or luma_a, bits are 8 or 16; anything else is unknown."""
    space = F.when(layout.isin("rgb", "rgba", "luma", "luma_a"), layout).otherwise("unknown")
    return F.struct(
        space.alias("color_space"), F.when(space == "unknown", "unknown").when(bits == 8, "8").when(bits == 16, "16").otherwise("unknown").alias("bit_depth"),
        F.when(space == "unknown", "unknown").otherwise("srgb").alias("transfer"), F.when(icc, "present").otherwise("absent").alias("icc"))


def color_state_after(state: Column, ops: Column) -> Column:
    """Folds an array of operations over a color_state."""

    def step(s: Column, op: Column) -> Column:
        kind = op["op"]
        tone = kind.isin("brightness", "contrast") & (s["bit_depth"] == "16")
        return F.struct(
            F.when(kind == "grayscale", "luma").when(kind == "normalize", "rgb").otherwise(s["color_space"]).alias("color_space"),
            F.when(kind.isin("grayscale", "normalize"), "8").when(tone, "unknown").otherwise(s["bit_depth"]).alias("bit_depth"),
            F.when(kind == "normalize", "srgb").otherwise(s["transfer"]).alias("transfer"), s["icc"].alias("icc"))

    return F.aggregate(ops, state, step)
