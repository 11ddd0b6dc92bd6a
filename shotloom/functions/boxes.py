"""Box geometry as column expressions; a box is ``struct<x0,y0,x1,y1>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def polygon_bounds(points: Column) -> Column:
    """Enclosing box of ``array<array<double>>`` points; null when there is no point."""
    ok = F.filter(points, lambda p: F.size(p) >= 2)
    xs = F.transform(ok, lambda p: p[0])
    ys = F.transform(ok, lambda p: p[1])
    return F.when(F.size(ok) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def flat_bounds(b: Column) -> Column:
    """Box from four numbers in any corner order."""
    return box(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))


def area(b: Column) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    zero = F.lit(0).cast("double")
    return F.greatest(zero, w) * F.greatest(zero, h)


def overlap_ratio(a: Column, b: Column, mode: str = "union") -> Column:
    """Intersection over the union, the smaller or the larger box; 0 for a zero area."""
    inter, aa, ab = intersection(a, b), F.abs(area(a)), F.abs(area(b))
    refs = {"union": aa + ab - inter, "small": F.least(aa, ab), "large": F.greatest(aa, ab)}
    if mode not in refs:
        raise ValueError(f"mode must be one of {sorted(refs)}")
    return F.when(refs[mode] == 0, F.lit(0.0)).otherwise(inter / refs[mode])


def clamp_box(b: Column, width: int, height: int) -> Column:
    """Clip to the page; null below 24 x 12."""
    def clip(c: Column, hi: int) -> Column:
        return F.greatest(F.lit(0).cast("double"), F.least(F.lit(hi).cast("double"), c))

    c = box(clip(b["x0"], width), clip(b["y0"], height), clip(b["x1"], width), clip(b["y1"], height))
    return F.when((c["x1"] - c["x0"] >= 24) & (c["y1"] - c["y0"] >= 12), c)


def whole_frame(boxes: Column, width: Column, height: Column) -> Column:
    """Exactly one box, covering at least 75 % of the area, 85 % of the width, 55 % of the height."""
    b = F.get(boxes, F.lit(0))
    w = F.greatest(F.lit(0.0), b["x1"] - b["x0"])
    h = F.greatest(F.lit(0.0), b["y1"] - b["y0"])
    return (
        (width > 0) & (height > 0) & (F.size(boxes) == 1)
        & (w * h >= width * height * 0.75) & (w >= width * 0.85) & (h >= height * 0.55)
    )


def dedupe_boxes(boxes: Column) -> Column:
    """Smallest first; drop a box when more than 90 % of it lies in one already kept."""
    keyed = F.transform(boxes, lambda b, i: F.struct(area(b).alias("a"), i.alias("i"), b.alias("b")))
    in_order = F.transform(F.sort_array(keyed), lambda k: k["b"])
    one = F.lit(1).cast("double")
    return F.aggregate(
        in_order,
        F.slice(in_order, 1, 0),
        lambda kept, b: F.when(
            F.exists(kept, lambda k: intersection(b, k) / F.greatest(one, area(b)) > 0.9), kept
        ).otherwise(F.concat(kept, F.array(b))),
    )


def reading_order(boxes: Column, limit: int = 24) -> Column:
    """By 40-pixel row band, then x, larger first."""
    keyed = F.transform(
        boxes,
        lambda b, i: F.struct(F.floor(b["y0"] / 40).alias("r"), b["x0"].alias("x"), (-area(b)).alias("a"), i.alias("i"), b.alias("b")),
    )
    return F.slice(F.transform(F.sort_array(keyed), lambda k: k["b"]), 1, limit)
