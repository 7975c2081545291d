"""Box and quadrilateral expressions. A box is a struct ``x0, y0, x1, y1`` of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def xywh_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def quad_box(*xy: Column) -> Column:
    """The axis-aligned box of ``x1, y1, .., x4, y4``."""
    return box(F.least(*xy[0::2]), F.least(*xy[1::2]), F.greatest(*xy[0::2]), F.greatest(*xy[1::2]))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Intersection over union; 0 for an empty union, or with ``eps`` added to the union."""
    i = intersection(a, b)
    u = area(a) + area(b) - i + eps
    return F.when(u > 0, i / u).otherwise(0.0)


def inside(a: Column, g: Column) -> Column:
    """The share of ``a`` within ``g``."""
    return F.when(area(a) > 0, intersection(a, g) / area(a)).otherwise(0.0)


def rescale(b: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """Box in another pixel space; unchanged where a size is null or 0."""
    ok = (w > 0) & (h > 0) & (to_w > 0) & (to_h > 0)
    fx, fy = F.when(ok, to_w / w).otherwise(1.0), F.when(ok, to_h / h).otherwise(1.0)
    return box(b["x0"] * fx, b["y0"] * fy, b["x1"] * fx, b["y1"] * fy)


def pad_clip(b: Column, ratio: float, w: Column, h: Column) -> Column:
    """Box grown by ``ratio`` of its sides, to whole pixels outwards, clipped to the image; null if nothing is left."""
    pw, ph = (b["x1"] - b["x0"]) * ratio, (b["y1"] - b["y0"]) * ratio
    out = box(F.greatest(F.floor(b["x0"] - pw), F.lit(0)), F.greatest(F.floor(b["y0"] - ph), F.lit(0)), F.least(F.ceil(b["x1"] + pw), w), F.least(F.ceil(b["y1"] + ph), h))
    return F.when((out["x1"] > out["x0"]) & (out["y1"] > out["y0"]), out)


def to_yolo(b: Column, w: Column, h: Column) -> Column:
    """Normalised centre and size."""
    return F.struct(((b["x0"] + b["x1"]) / 2 / w).alias("xc"), ((b["y0"] + b["y1"]) / 2 / h).alias("yc"), ((b["x1"] - b["x0"]) / w).alias("w"), ((b["y1"] - b["y0"]) / h).alias("h"))


def from_yolo(y: Column, w: Column, h: Column) -> Column:
    return box((y["xc"] - y["w"] / 2) * w, (y["yc"] - y["h"] / 2) * h, (y["xc"] + y["w"] / 2) * w, (y["yc"] + y["h"] / 2) * h)


def letterbox(b: Column, w: Column, h: Column, size: int) -> Column:
    """Box in a square of ``size`` that holds the image scaled to fit and centred."""
    s = F.least(F.lit(size) / w, F.lit(size) / h)
    dx, dy = (F.lit(size) - w * s) / 2, (F.lit(size) - h * s) / 2
    return box(b["x0"] * s + dx, b["y0"] * s + dy, b["x1"] * s + dx, b["y1"] * s + dy)


def unletterbox(b: Column, w: Column, h: Column, size: int) -> Column:
    s = F.least(F.lit(size) / w, F.lit(size) / h)
    dx, dy = (F.lit(size) - w * s) / 2, (F.lit(size) - h * s) / 2
    return box((b["x0"] - dx) / s, (b["y0"] - dy) / s, (b["x1"] - dx) / s, (b["y1"] - dy) / s)


def fit_scale(w: Column, h: Column, least_side: int, most_side: int) -> Column:
    """Scale that brings the shorter side to ``least_side`` unless the longer would pass ``most_side``."""
    s = F.lit(least_side) / F.least(w, h)
    return F.when(F.greatest(w, h) * s > most_side, F.lit(most_side) / F.greatest(w, h)).otherwise(s)


def crop_scale(w: Column, h: Column, target: int = 1400, most: float = 4.0) -> Column:
    return F.least(F.lit(most), F.lit(float(target)) / F.greatest(w, h))


def order_points(points: Column) -> Column:
    """``[top left, top right, bottom right, bottom left]`` of four ``x, y`` structs, by sum and difference of coordinates."""
    by = lambda key, last: F.element_at(F.transform(F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p.alias("p")))), lambda s: s["p"]), -1 if last else 1)
    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(by(total, False), by(diff, False), by(total, True), by(diff, True))


def dedup_points(points: Column, eps: float = 1e-3) -> Column:
    """Points without consecutive and closing doubles."""
    same = lambda a, b: (F.abs(a["x"] - b["x"]) <= eps) & (F.abs(a["y"] - b["y"]) <= eps)
    kept = F.aggregate(points, F.slice(points, 1, 1), lambda acc, p: F.when(same(F.element_at(acc, -1), p), acc).otherwise(F.array_append(acc, p)))
    closed = (F.size(kept) > 1) & same(F.element_at(kept, 1), F.element_at(kept, -1))
    return F.when(F.size(points) == 0, points).when(closed, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)


def stripes(x: Column, y: Column, w: Column, h: Column, long_side: int = 40, most: int = 3, least_side: int = 4) -> Column:
    """A box in 2 to ``most`` equal stripes along its long side if that is at least ``long_side``; too thin ones are
    dropped, and the box stays whole if none is left."""
    n = F.when(F.greatest(w, h) >= long_side * 2, most).when(F.greatest(w, h) >= long_side, 2).otherwise(1)
    wide = w >= h
    sw, sh = F.when(wide, w / n).otherwise(w.cast("double")), F.when(wide, h.cast("double")).otherwise(h / n)
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((x + F.when(wide, i * sw).otherwise(0.0)).alias("x"), (y + F.when(wide, 0.0).otherwise(i * sh)).alias("y"), sw.alias("w"), sh.alias("h")))
    kept = F.filter(parts, lambda p: (p["w"] >= least_side) & (p["h"] >= least_side))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))))


def crop_strip(boxes: Column, pad: float, w: Column, h: Column) -> Column:
    """The box around an array of boxes, grown by ``pad`` of its sides, clipped to the image and cut to whole pixels."""
    u = box(F.array_min(F.transform(boxes, lambda b: b["x0"])), F.array_min(F.transform(boxes, lambda b: b["y0"])), F.array_max(F.transform(boxes, lambda b: b["x1"])), F.array_max(F.transform(boxes, lambda b: b["y1"])))
    pw, ph = (u["x1"] - u["x0"]) * pad, (u["y1"] - u["y0"]) * pad
    whole = lambda c: c.cast("int")  # noqa: E731  towards zero
    return box(whole(F.greatest(u["x0"] - pw, F.lit(0.0))), whole(F.greatest(u["y0"] - ph, F.lit(0.0))), whole(F.least(u["x1"] + pw, w)), whole(F.least(u["y1"] + ph, h)))


def to_photo(b: Column, x: Column, y: Column, scale: Column) -> Column:
    """A box of a crop in the pixels of its photo: scaled back and moved by the corner of the crop."""
    return box(b["x0"] / scale + x, b["y0"] / scale + y, b["x1"] / scale + x, b["y1"] / scale + y)


def pad_quad(points: Column, ratio: float, w: Column, h: Column) -> Column:
    """Corners moved away from their centre by ``ratio`` and kept inside the image."""
    n = F.size(points)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[c]) / n
    cx, cy = mean("x"), mean("y")
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most - 1.0)
    return F.transform(points, lambda p: F.struct(inside(cx + (p["x"] - cx) * (1 + ratio), w).alias("x"), inside(cy + (p["y"] - cy) * (1 + ratio), h).alias("y")))
