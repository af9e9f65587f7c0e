"""Geometry expressions over boxes (x0, y0, x1, y1) and quads (array of four struct<x, y>, clockwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the grouping rules: floor of slope denominators, factor of the free quads' margin.
SLOPE_FLOOR, FREE_FACTOR = 10.0, 1.44


def trunc(value: Column) -> Column:
    """Toward zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of two boxes (keys x0 y0 x1 y1); 0 when the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda k: F.greatest(F.lit(0.0), k["x1"] - k["x0"]) * F.greatest(F.lit(0.0), k["y1"] - k["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def quad(*points: tuple[Column, Column]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def bounds(q: Column) -> dict[str, Column]:
    """The box around a quad."""
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def extent(q: Column) -> Column:
    """The larger of width and height."""
    b = bounds(q)
    return F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])


def slope(q: Column) -> Column:
    """The steeper of the top and bottom edges, as an absolute slope."""
    edge = lambda i, j: F.abs((q[j]["y"] - q[i]["y"]) / F.greatest(q[j]["x"] - q[i]["x"], F.lit(SLOPE_FLOOR)))
    return F.greatest(edge(0, 1), edge(3, 2))


def margin(width: Column, height: Column, share: float) -> Column:
    """Whole pixels of margin around a box."""
    return trunc(F.least(width, height) * share).cast("double")


def expand_free(q: Column, share: float) -> Column:
    """A sloped quad grown outward along its diagonals."""
    side = lambda i, j: F.sqrt(F.pow(q[j]["x"] - q[i]["x"], F.lit(2)) + F.pow(q[j]["y"] - q[i]["y"], F.lit(2)))
    m = trunc(F.least(side(0, 1), side(0, 3)) * (FREE_FACTOR * share))
    angle = lambda i, j: F.abs(F.atan((q[i]["y"] - q[j]["y"]) / F.greatest(q[i]["x"] - q[j]["x"], F.lit(SLOPE_FLOOR))))
    a, b = angle(0, 2), angle(1, 3)
    move = ((a, -1, -1), (b, 1, -1), (a, 1, 1), (b, -1, 1))
    return quad(*((q[i]["x"] + F.cos(t) * m * sx, q[i]["y"] + F.sin(t) * m * sy) for i, (t, sx, sy) in enumerate(move)))


def roll(q: Column, start: Column) -> Column:
    """The quad from corner ``start`` (0-based) on, cyclically."""
    start = start.cast("int")
    return F.concat(F.slice(q, start + 1, F.lit(4)), F.slice(q, F.lit(1), start))


def _first(q: Column, key) -> Column:
    return F.array_min(F.transform(q, lambda p, i: F.struct(*key(p), i.alias("i"))))["i"]


def roll_to_top_left(q: Column) -> Column:
    """From the corner with the smallest x + y, the first on ties."""
    return roll(q, _first(q, lambda p: [(p["x"] + p["y"]).alias("s")]))


def clockwise_from_top_left(q: Column) -> Column:
    """From the highest corner, the left one on ties."""
    return roll(q, _first(q, lambda p: [p["y"].alias("y"), p["x"].alias("x")]))


def scale(q: Column, factor: Column) -> Column:
    return F.transform(q, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def unrotate(q: Column, rotation: Column, width: Column, height: Column) -> Column:
    """A quad found on a page turned clockwise by ``rotation``, in the page's own frame; 0 leaves it untouched."""
    back = lambda f: clockwise_from_top_left(F.transform(q, f))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return (
        F.when(rotation == 90, back(lambda p: point(p["y"], height - p["x"])))
        .when(rotation == 180, back(lambda p: point(width - p["x"], height - p["y"])))
        .when(rotation == 270, back(lambda p: point(width - p["y"], p["x"])))
        .otherwise(q)
    )


def quad_text(q: Column) -> Column:
    """A quad as ``(x,y) (x,y) ...`` with one decimal."""
    one = lambda v: v.cast("decimal(24,6)").cast("decimal(24,1)").cast("string")
    return F.array_join(F.transform(q, lambda p: F.concat(F.lit("("), one(p["x"]), F.lit(","), one(p["y"]), F.lit(")"))), " ")


def resize_plan(width: Column, height: Column, canvas: Column, mag: float = 1.0) -> Column:
    """struct<w, h>: the longer side to ``min(mag * longer, canvas)``, truncated, at least one pixel."""
    longer = F.greatest(width, height)
    ratio = F.least(longer * mag, canvas) / longer
    return F.struct(F.greatest(F.lit(1), F.floor(width * ratio)).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(height * ratio)).cast("int").alias("h"))


def pad_to(value: Column, unit: int = 32) -> Column:
    return (F.ceil(value / unit) * unit).cast("int")


def padded_area(plan: Column) -> Column:
    return pad_to(plan["w"]).cast("bigint") * pad_to(plan["h"])


def budget_canvas(width: Column, height: Column, canvas: int, pixels: int) -> Column:
    """The largest canvas up to ``canvas`` whose padded plan has at most ``pixels``; 1 when none has.

    The area never shrinks as the canvas grows, so halving steps find it.
    """
    low, high = F.lit(1), F.lit(canvas)
    start = F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        fits = padded_area(resize_plan(width, height, middle)) <= pixels
        return F.struct(F.when(fits, middle).otherwise(s["low"]).alias("low"), F.when(fits, s["high"]).otherwise(F.greatest(s["low"], middle - 1)).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(canvas.bit_length() + 1)), start, halve, lambda s: s["low"])
