"""Boxes into text lines: slope split, line building, merging of neighbours.

Both folds carry running means that start again at a break, so they run as
ordered folds over one image's boxes, gathered as one array per image (an image holds
at most some thousands of boxes). Output: horizontal lines first, then free quads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as g

BOX = "struct<yc:double,box_no:bigint,x0:double,x1:double,y0:double,y1:double,h:double>"


def classify(quads: DataFrame, slope_ths: float = 0.1, add_margin: float = 0.1) -> DataFrame:
    """``quads`` (image_id, box_no, quad) with ``horizontal``, its box x0..y1, and ``free``, the grown quad of a sloped one."""
    b = g.bounds(F.col("quad"))
    flat = g.slope(F.col("quad")) < slope_ths
    return quads.withColumn("horizontal", flat).withColumns(b).withColumn("free", F.when(~flat, g.expand_free(F.col("quad"), add_margin)))


def _gathered(boxes: DataFrame) -> DataFrame:
    fields = F.struct(((F.col("y0") + F.col("y1")) * 0.5).alias("yc"), F.col("box_no").cast("bigint").alias("box_no"), "x0", "x1", "y0", "y1", (F.col("y1") - F.col("y0")).alias("h"))
    return boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(fields)).cast(f"array<{BOX}>").alias("boxes"))


def _split(boxes: Column, goes_on, measure) -> Column:
    """An ordered array of boxes cut into runs; ``measure`` gives the sums that ``goes_on(sums, n, last, box)`` compares."""
    state = F.struct(F.array().cast(f"array<array<{BOX}>>").alias("done"), F.array().cast(f"array<{BOX}>").alias("now"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(s: Column, x: Column) -> Column:
        a, b = measure(x)
        n = F.size(s["now"])
        on = (n == 0) | goes_on(s["a"] / n, s["b"] / n, F.element_at(s["now"], -1), x)
        # the two outcomes share one struct, so each box is judged once
        return F.struct(
            F.when(on, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"),
            F.when(on, F.concat(s["now"], F.array(x))).otherwise(F.array(x)).alias("now"),
            F.when(on, s["a"] + a).otherwise(a).alias("a"),
            F.when(on, s["b"] + b).otherwise(b).alias("b"),
        )

    return F.aggregate(boxes, state, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def lines(boxes: DataFrame, ycenter_ths: float = 0.5) -> DataFrame:
    """Rows (image_id, line_no, boxes): in order of centre, a box is on the current line while it is near its mean centre."""
    cut = _split(F.col("boxes"), lambda yc, h, last, x: F.abs(yc - x["yc"]) < h * ycenter_ths, lambda x: (x["yc"], x["h"]))
    return _gathered(boxes).select("image_id", F.posexplode(cut).alias("line_no", "boxes"))


def line_numbers(boxes: DataFrame, ycenter_ths: float = 0.5) -> DataFrame:
    """Rows (image_id, box_no, line_no)."""
    return lines(boxes, ycenter_ths).select("image_id", "line_no", F.explode("boxes").alias("x")).select("image_id", F.col("x.box_no").alias("box_no"), "line_no")


def merged_lines(boxes: DataFrame, ycenter_ths: float = 0.5, height_ths: float = 0.5, width_ths: float = 0.5, add_margin: float = 0.1) -> DataFrame:
    """Rows (image_id, line_no, part_no, n_boxes, x0, x1, y0, y1): neighbours on a line merged, grown by the margin.

    The gap is measured from the last box's right edge, the height against the run's mean.
    """
    across = F.array_sort(F.transform("boxes", lambda b: F.struct(b["x0"].alias("k"), b["yc"].alias("yc"), b["box_no"].alias("no"), b.alias("b"))))
    on = lambda h, _, last, x: (F.abs(h - x["h"]) < h * height_ths) & (x["x0"] - last["x1"] < x["h"] * width_ths)
    cut = _split(F.transform(across, lambda s: s["b"]), on, lambda x: (x["h"], F.lit(0.0)))
    parts = lines(boxes, ycenter_ths).select("image_id", "line_no", F.posexplode(cut).alias("part_no", "p"))
    low, high = (lambda k: F.array_min(F.transform("p", lambda b: b[k]))), (lambda k: F.array_max(F.transform("p", lambda b: b[k])))
    parts = parts.select("image_id", "line_no", "part_no", F.size("p").alias("n_boxes"), low("x0").alias("x0"), high("x1").alias("x1"), low("y0").alias("y0"), high("y1").alias("y1"))
    m = g.margin(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), add_margin)
    return parts.select("image_id", "line_no", "part_no", "n_boxes", (F.col("x0") - m).alias("x0"), (F.col("x1") + m).alias("x1"), (F.col("y0") - m).alias("y0"), (F.col("y1") + m).alias("y1"))


def regions(quads: DataFrame, min_size: float = 20.0) -> DataFrame:
    """Rows (image_id, region_no, quad, axis_aligned): merged lines, then free quads; those larger than ``min_size``."""
    split = classify(quads)
    flat = merged_lines(split.filter("horizontal"))
    corners = g.quad((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")), (F.col("x0"), F.col("y1")))
    both = flat.select("image_id", F.struct(F.lit(0).alias("kind"), F.col("line_no").cast("bigint").alias("a"), F.col("part_no").cast("bigint").alias("b")).alias("o"), corners.alias("quad"), F.lit(True).alias("axis_aligned"))
    free = split.filter("not horizontal").select("image_id", F.struct(F.lit(1).alias("kind"), F.col("box_no").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("o"), F.col("free").alias("quad"), F.lit(False).alias("axis_aligned"))
    kept = both.unionByName(free).filter(g.extent(F.col("quad")) > min_size)
    every = kept.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("o", "quad", "axis_aligned"))).alias("l"))
    return every.select("image_id", F.posexplode("l").alias("region_no", "x")).select("image_id", "region_no", "x.quad", "x.axis_aligned")
