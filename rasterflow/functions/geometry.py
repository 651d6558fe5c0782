"""Image geometry as column expressions. Lengths are BIGINT, so products never overflow or wrap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def big(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def div(a: Column, b) -> Column:
    return F.call_function("div", a.cast("long"), big(b))


def inside(w: Column, h: Column, tw: Column, th: Column) -> Pair:
    """Size after fitting into a box with the aspect ratio kept; either target side may be null. The factor is formed
    before the product, as the rounding of the two differs."""
    w, h, tw, th = map(big, (w, h, tw, th))
    wd, hd = w.cast("double"), h.cast("double")
    by_w = F.round(hd * (tw / wd)).cast("long")
    by_h = F.round(wd * (th / hd)).cast("long")
    wide = wd / hd > tw.cast("double") / th
    both = tw.isNotNull() & th.isNotNull()
    out_w = F.when(both & wide, tw).when(both, by_h).when(tw.isNotNull(), tw).when(th.isNotNull(), by_h).otherwise(w)
    out_h = F.when(both & wide, by_w).when(both, th).when(tw.isNotNull(), by_w).when(th.isNotNull(), th).otherwise(h)
    return out_w, out_h


def cover(w: Column, h: Column, tw: Column, th: Column) -> Pair:
    """Size before the centre crop of a cover resize; an empty source gives the target, 1 at least."""
    w, h, tw, th = map(big, (w, h, tw, th))
    scale = F.greatest(tw / w.cast("double"), th / h.cast("double"))
    empty = (w == 0) | (h == 0)
    return (
        F.when(empty, F.greatest(tw, big(1))).otherwise(F.greatest(F.ceil(w * scale).cast("long"), big(1))),
        F.when(empty, F.greatest(th, big(1))).otherwise(F.greatest(F.ceil(h * scale).cast("long"), big(1))),
    )


def center_crop(w: Column, h: Column, tw: Column, th: Column) -> tuple[Column, Column, Column, Column]:
    """(x, y, width, height) of the centre crop, clamped to the image and 1 at least."""
    cw, ch = (F.greatest(F.least(big(t), big(s)), big(1)) for t, s in ((tw, w), (th, h)))
    return div(F.greatest(big(w) - cw, big(0)), 2), div(F.greatest(big(h) - ch, big(0)), 2), cw, ch


def resized(w: Column, h: Column, tw: Column, th: Column, fit: str) -> Pair:
    """What a resize gives: cover and fill need both sides, else they act as inside."""
    iw, ih = inside(w, h, tw, th)
    if fit == "inside":
        return iw, ih
    both = tw.isNotNull() & th.isNotNull()
    if fit == "fill":
        return F.when(both, big(tw)).otherwise(iw), F.when(both, big(th)).otherwise(ih)
    sw, sh = cover(w, h, tw, th)
    return F.when(both, F.least(big(tw), sw)).otherwise(iw), F.when(both, F.least(big(th), sh)).otherwise(ih)


def resize_error(w: Column, h: Column) -> Column:
    return F.when((w == 0) | (h == 0), "E203")


def crop_error(w: Column, h: Column, x: Column, y: Column, cw: Column, ch: Column) -> Column:
    """Sums are BIGINT: a crop that reaches past the image is out of bounds however large its offset is."""
    return F.when((cw == 0) | (ch == 0), "E201").when((big(x) + big(cw) > w) | (big(y) + big(ch) > h), "E200")


def extract_window(w: Column, h: Column, tw: Column, th: Column, fit: str, x: Column, y: Column, cw: Column, ch: Column) -> dict[str, Column]:
    """The source window, in fractional pixels, that a resize followed by a crop reads, and what is wrong with it."""
    both = tw.isNotNull() & th.isNotNull()
    iw, ih = inside(w, h, tw, th)
    if fit == "cover":
        sw, sh = cover(w, h, tw, th)
        rw, rh = F.when(both, sw).otherwise(iw), F.when(both, sh).otherwise(ih)
        fw, fh = F.when(both, big(tw)).otherwise(rw), F.when(both, big(th)).otherwise(rh)
        ox, oy = div(F.greatest(rw - fw, big(0)), 2), div(F.greatest(rh - fh, big(0)), 2)
    else:
        fill = both & F.lit(fit == "fill")
        rw, rh = F.when(fill, big(tw)).otherwise(iw), F.when(fill, big(th)).otherwise(ih)
        fw, fh, ox, oy = rw, rh, big(0), big(0)
    real_w, real_h = F.greatest(big(w), big(1)).cast("double"), F.greatest(big(h), big(1)).cast("double")
    sx, sy = rw / real_w, rh / real_h
    left, top = F.try_divide((ox + big(x)).cast("double"), sx), F.try_divide((oy + big(y)).cast("double"), sy)
    error = F.coalesce(F.when((big(cw) == 0) | (big(ch) == 0), "E201"), resize_error(rw, rh), crop_error(fw, fh, x, y, cw, ch))
    same = (rw == big(w)) & (rh == big(h)) & (big(x) == 0) & (big(y) == 0) & (big(cw) == rw) & (big(ch) == rh)
    return {
        "src_left": left, "src_top": top,
        "src_width": F.least(F.try_divide(big(cw).cast("double"), sx), real_w - left),
        "src_height": F.least(F.try_divide(big(ch).cast("double"), sy), real_h - top),
        "identity": same, "error": error,
    }


def turned(w: Column, h: Column, degrees: Column) -> Pair:
    swap = F.pmod(degrees, F.lit(360)).isin(90, 270)
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)


def oriented(w: Column, h: Column, orientation: Column) -> Pair:
    swap = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(swap, h).otherwise(w), F.when(swap, w).otherwise(h)


#: Orientation that each clockwise turn equals.
TURNS = {0: 1, 90: 6, 180: 3, 270: 8, -90: 8, -180: 3, -270: 6}


def moved(x: Column, y: Column, w: Column, h: Column, orientation: Column) -> Pair:
    """Where pixel (x, y) of a w by h image goes under an EXIF orientation; values other than 2..8 leave it."""
    o, rx, ry = orientation, w - 1 - x, h - 1 - y
    to_x = F.when(o.isin(2, 3), rx).when(o.isin(5, 8), y).when(o.isin(6, 7), ry).otherwise(x)
    to_y = F.when(o.isin(3, 4), ry).when(o.isin(5, 6), x).when(o.isin(7, 8), rx).otherwise(y)
    return to_x, to_y
