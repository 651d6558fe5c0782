"""The peak-memory model, as a fold over an operation array, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import big, cover, inside
from ..functions.rules import MIB

# Fixed values of the model.
DECODE, FILTER, LEAST, PER_IMAGE = 8 * MIB, 4 * MIB, 24 * MIB, 100 * MIB
MOST_AT_ONCE = 16


def reserved(total: Column) -> Column:
    """A twentieth of the memory, 64 MiB at least and 512 MiB at most."""
    return F.least(F.greatest(F.call_function("div", total.cast("long"), F.lit(20).cast("long")), big(64 * MIB)), big(512 * MIB))


def concurrency(memory: Column, cpus: Column) -> Column:
    """Images at once, by memory (null: unknown) and cores."""
    usable = F.greatest(memory - reserved(memory), big(0))
    fit = F.greatest(F.least(F.call_function("div", usable.cast("long"), big(PER_IMAGE)), big(MOST_AT_ONCE)), big(1))
    return F.when(memory.isNull(), cpus.cast("long")).when(usable < LEAST, big(1)).otherwise(F.greatest(F.least(fit, cpus.cast("long")), big(1)))


def peak_bytes(w: Column, h: Column, fmt: Column, ops: Column, out: Column) -> Column:
    """Peak bytes of one image under a queue of operations, from its size and formats alone."""
    one = big(1)

    def step(s: Column, op: Column) -> Column:
        kind, cw, ch, bpp = op["op"], s["w"], s["h"], s["bpp"]
        scaled = kind.isin("resize", "extract")
        tw, th = F.greatest(big(F.coalesce(op["width"], cw)), one), F.greatest(big(F.coalesce(op["height"], ch)), one)
        iw, ih = inside(cw, ch, op["width"], op["height"])
        vw, vh = cover(cw, ch, tw, th)
        rw = F.when(op["fit"] == "fill", tw).when(op["fit"] == "cover", vw).otherwise(iw)
        rh = F.when(op["fit"] == "fill", th).when(op["fit"] == "cover", vh).otherwise(ih)
        swap = ((kind == "rotate") & F.pmod(op["degrees"], F.lit(360)).isin(90, 270)) | ((kind == "auto_orient") & op["orientation"].between(5, 8))
        cut_w, cut_h = F.greatest(big(op["crop_width"]), one), F.greatest(big(op["crop_height"]), one)
        covered = (kind == "resize") & (op["fit"] == "cover")
        nw = F.when(covered, tw).when(kind == "resize", rw).when(kind == "extract", F.least(cut_w, rw)).when(kind == "crop", F.least(cut_w, cw)).when(swap, ch).otherwise(cw)
        nh = F.when(covered, th).when(kind == "resize", rh).when(kind == "extract", F.least(cut_h, rh)).when(kind == "crop", F.least(cut_h, ch)).when(swap, cw).otherwise(ch)
        nb = F.when(scaled, big(4)).when(kind == "normalize", big(3)).when(kind.isin("brightness", "contrast", "grayscale"), F.greatest(bpp, big(3))).otherwise(bpp)
        extra = F.when(scaled | kind.isin("rotate", "auto_orient"), big(FILTER)).otherwise(big(FILTER // 2))
        extra = extra + F.when(covered, F.greatest(vw * vh * 4 - tw * th * 4, big(0))).otherwise(big(0))
        return F.struct(nw.alias("w"), nh.alias("h"), nb.alias("bpp"), F.greatest(s["peak"], cw * ch * bpp + nw * nh * nb + extra).alias("peak"))

    bpp = F.when(fmt == "jpeg", big(3)).otherwise(big(4))
    start = F.struct(big(w).alias("w"), big(h).alias("h"), bpp.alias("bpp"), (big(w) * big(h) * bpp + DECODE).alias("peak"))

    def finish(s: Column) -> Column:
        size = s["w"] * s["h"]
        shown = size * F.when(out == "jpeg", big(3)).when(out.isNotNull(), big(4)).otherwise(s["bpp"])
        return F.greatest(s["peak"], size * s["bpp"] + F.call_function("div", shown, big(4)), big(LEAST))

    return F.aggregate(ops, start, step, finish)
