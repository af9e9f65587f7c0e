"""Queries of detection: line items stand for boxes of an image (the order), score maps are synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.operators import components, grouping, imaging, scoring
from lectern.sources import table

SIDES = ("x0", "y0", "x1", "y1")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    b = l.select(F.col("l_orderkey").alias("image_id"), F.row_number().over(order).cast("bigint").alias("box_no"), (F.col("l_partkey") * 37 % 600).cast("double").alias("x0"), (F.col("l_linenumber") % 3 * 40 + F.col("l_suppkey") % 7).cast("double").alias("y0"), "l_quantity", "l_linenumber")
    return b.select("image_id", "box_no", "x0", "y0", (F.col("x0") + 20 + F.col("l_quantity")).alias("x1"), (F.col("y0") + 18 + F.col("l_linenumber") % 5).alias("y1"))


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third box leans: its right corners stand lower by a quarter of its width."""
    lean = F.when(F.col("box_no") % 3 == 0, (F.col("x1") - F.col("x0")) / 4).otherwise(0.0)
    q = g.quad((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0") + lean), (F.col("x1"), F.col("y1") + lean), (F.col("x0"), F.col("y1")))
    return _boxes(spark, sf_dir).select("image_id", "box_no", q.alias("quad"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return _rounded(scoring.candidate_pairs(b.filter("box_no % 2 = 0"), b.filter("box_no % 2 = 1"), 0.05), "iou")


def greedy_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    return _rounded(scoring.greedy_match(scoring.candidate_pairs(b.filter("box_no % 2 = 0"), b.filter("box_no % 2 = 1"), 0.05)), "iou")


def line_detection_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    out = scoring.line_detection(b.filter("box_no % 2 = 0"), b.filter("box_no % 2 = 1"), 0.05)
    return _rounded(out, "f1", "precision", "recall")


def slope_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grouping.classify(_quads(spark, sf_dir))
    free = [F.round(F.coalesce(s["free"][i][k], s["quad"][i][k]), 6).alias(f"{k}{i}") for i in range(4) for k in ("x", "y")]
    return s.select("image_id", "box_no", "horizontal", *free)


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.line_numbers(_boxes(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("bigint"))


def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grouping.merged_lines(_boxes(spark, sf_dir)).drop("part_no").withColumn("line_no", F.col("line_no").cast("bigint")).withColumn("n_boxes", F.col("n_boxes").cast("bigint")), *SIDES)


def detected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, then free quads, in output order, larger than 40 pixels."""
    r = grouping.regions(_quads(spark, sf_dir), 40.0)
    return r.select("image_id", "region_no", "axis_aligned", g.quad_text(F.col("quad")).alias("quad"))


def unrotate_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _quads(spark, sf_dir).withColumn("rotation", (F.col("box_no") % 4 * 90).cast("int"))
    u = q.withColumn("u", g.unrotate(F.col("quad"), F.col("rotation"), F.lit(700.0), F.lit(200.0)))
    return u.select("image_id", "box_no", "rotation", *(F.round(u["u"][i][k], 6).alias(f"{k}{i}") for i in range(4) for k in ("x", "y")))


def rotation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four scores of each embedding as the turns' combined mass, the next four as the link mass."""
    e = table(spark, sf_dir, "embeddings")
    part = lambda k: F.transform(F.slice("embedding", k, 4), lambda v: F.abs(v).cast("double"))
    return e.select("vec_id", components.pick_rotation(part(1), part(5)).alias("rotation"))


def heat_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "region"))
    return _rounded(components.heat_mass(e.withColumn("link", -F.col("region")), 0.1, 0.1), "region_mass", "link_mass")


def resize_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: sides from key and price."""
    p = table(spark, sf_dir, "part")
    w, h = (F.col("p_partkey") * 31 % 4000 + 1).cast("int"), (F.col("p_partkey") * 17 % 3000 + 1).cast("int")
    plan = g.resize_plan(w, h, F.lit(2560))
    return p.select("p_partkey", plan.getField("w").alias("w"), plan.getField("h").alias("h"), g.pad_to(plan.getField("w")).alias("padded_w"), g.padded_area(plan).alias("area"))


def megapixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    w, h = (F.col("p_partkey") * 31 % 4000 + 1).cast("int"), (F.col("p_partkey") * 17 % 3000 + 1).cast("int")
    return p.select("p_partkey", g.budget_canvas(w, h, 2560, 500_000).alias("canvas"))


def _maps(spark: SparkSession) -> DataFrame:
    return components.synthetic_maps(spark, 8, 96, 120)


def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.dilation(components.kept(components.statistics(components.label_components(components.foreground(_maps(spark))))))


def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = components.boxes(_maps(spark), 96, 120)
    return b.select("image_id", "label", *(F.round(b["quad"][i][k], 6).alias(f"{k}{i}") for i in range(4) for k in ("x", "y")))


def _vector_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-float embedding as a score map of 8 x 8: region and link from magnitudes, the link's from the value after."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode(F.arrays_zip("embedding", F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1)).alias("after"))).alias("i", "v"))
    score = lambda c: F.round(F.abs(F.col(c).cast("double")) * 5, 6)
    return e.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), score("v.embedding").alias("region"), score("v.after").alias("link"))


def vector_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of every map, whatever their size, with the steps each would grow by."""
    stats = components.statistics(components.label_components(components.foreground(_vector_maps(spark, sf_dir), 0.6, 0.9)))
    return components.dilation(stats)


def vector_kept_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = components.statistics(components.label_components(components.foreground(_vector_maps(spark, sf_dir), 0.6, 0.9)))
    return components.kept(stats, 1.0, 3).select("image_id", "label", "area")


def vector_grown_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each component, less those of links only, grown by its steps inside the map: their number and sums."""
    labelled = components.label_components(components.foreground(_vector_maps(spark, sf_dir), 0.6, 0.9))
    stats = components.dilation(components.statistics(labelled))
    grown = components.dilate(labelled.filter("is_text or not is_link").select("image_id", "label", "y", "x").join(stats.select("image_id", "label", "radius"), ["image_id", "label"]), 8, 8)
    return grown.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def vector_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the smallest rectangle around each component's pixels."""
    labelled = components.label_components(components.foreground(_vector_maps(spark, sf_dir), 0.6, 0.9))
    return _rounded(components.rectangle_areas(labelled.select("image_id", "label", "y", "x")), "rectangle")


def quad_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each quad, scaled, and the corner that two rules start from."""
    q = _quads(spark, sf_dir).withColumn("s", g.scale(F.col("quad"), F.lit(1.5)))
    near, high = g.roll_to_top_left(F.col("s")), g.clockwise_from_top_left(F.col("s"))
    point = lambda c, n: [F.round(c[0][k], 6).alias(f"{n}_{k}") for k in ("x", "y")]
    return q.select("image_id", "box_no", F.round(g.extent(F.col("s")), 6).alias("extent"), *point(near, "near"), *point(high, "high"))


def pixel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each embedding as the bytes of a page of 7 x 3 pixels: grey, contrast, turned, cut and normalised, as sums."""
    byte = lambda v: (F.floor(F.abs(v.cast("double")) * 1000).cast("int") % 256)
    raw = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 63), lambda v: F.lpad(F.hex(byte(v)), 2, "0")), ""))
    image = F.struct(F.lit(7).alias("width"), F.lit(3).alias("height"), raw.alias("rgb8"))

    def measure(image: dict) -> dict:
        import numpy as np

        px = imaging.as_array(image)
        flat = imaging.grey(px)
        have, high, low = imaging.contrast(flat)
        turned = imaging.rotate(flat, 90)
        cut = imaging.crop_box(flat, 1.5, -3, 4.9, 2)
        order = np.arange(1, 22)
        return {"grey": int((flat.ravel() * order).sum()), "contrast": have, "high": high, "low": low, "stretched": int((imaging.adjust_contrast(flat).ravel() * order).sum()), "turned": int((turned.ravel() * order).sum()), "cut": int(cut.sum()), "input": [float(v) for v in imaging.detector_input(px, 7, 3)[:, [0, 2, 31], [0, 6, 31]].ravel()]}

    told = imaging.map_column(table(spark, sf_dir, "embeddings").select("vec_id", image.alias("image")), "m", "struct<grey:bigint,contrast:double,high:double,low:double,stretched:bigint,turned:bigint,cut:bigint,input:array<double>>", measure, "image")
    return told.select("vec_id", "m.grey", "m.stretched", "m.turned", "m.cut", *(F.round(f"m.{c}", 6).alias(c) for c in ("contrast", "high", "low")), F.array_join(F.transform("m.input", lambda v: v.cast("decimal(12,4)").cast("string")), " ").alias("input"))


def dilate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of dilation over the events as a grid: user by minute, set where the value is high."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), (F.col("event_id") % 7).alias("y"), (F.col("event_id") % 500).alias("x"), (F.col("value") > 50).cast("int").alias("set"))
    points = e.groupBy("image_id", "y", "x").agg(F.max("set").alias("set"))
    return components.line_max(points, 3, 4)


_BOX = """
b AS (SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS box_no,
  (l_partkey * 37 % 600)::DOUBLE AS x0, (l_linenumber % 3 * 40 + l_suppkey % 7)::DOUBLE AS y0, (l_partkey * 37 % 600) + 20 + l_quantity AS x1,
  (l_linenumber % 3 * 40 + l_suppkey % 7)::DOUBLE + 18 + l_linenumber % 5 AS y1 FROM lineitem)"""
_PAIRS = f"""{_BOX},
i AS (SELECT p.image_id, p.box_no AS pred, r.box_no AS ref, greatest(0, least(p.x1, r.x1) - greatest(p.x0, r.x0)) * greatest(0, least(p.y1, r.y1) - greatest(p.y0, r.y0)) AS a,
  (p.x1 - p.x0) * (p.y1 - p.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS s FROM b p JOIN b r USING (image_id) WHERE p.box_no % 2 = 0 AND r.box_no % 2 = 1),
c AS (SELECT image_id, pred, ref, a / (s - a) AS iou FROM i WHERE a / (s - a) >= 0.05)"""
_MATCH = f"""RECURSIVE {_PAIRS},
o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, pred, ref) AS k FROM c),
m AS (SELECT image_id, k, pred, ref, iou, true AS taken, [pred] AS ps, [ref] AS rs FROM o WHERE k = 1
  UNION ALL SELECT o.image_id, o.k, o.pred, o.ref, o.iou, NOT (list_contains(m.ps, o.pred) OR list_contains(m.rs, o.ref)),
    CASE WHEN list_contains(m.ps, o.pred) OR list_contains(m.rs, o.ref) THEN m.ps ELSE list_append(m.ps, o.pred) END,
    CASE WHEN list_contains(m.ps, o.pred) OR list_contains(m.rs, o.ref) THEN m.rs ELSE list_append(m.rs, o.ref) END
  FROM m JOIN o ON o.image_id = m.image_id AND o.k = m.k + 1)"""
_LINES = f"""RECURSIVE {_BOX},
o AS (SELECT *, (y0 + y1) * 0.5 AS yc, y1 - y0 AS h, row_number() OVER (PARTITION BY image_id ORDER BY (y0 + y1) * 0.5, box_no) AS k FROM b),
f AS (SELECT image_id, box_no, k, 0 AS line_no, yc AS ys, h AS hs, 1 AS n FROM o WHERE k = 1
  UNION ALL SELECT o.image_id, o.box_no, o.k, CASE WHEN abs(f.ys / f.n - o.yc) < 0.5 * (f.hs / f.n) THEN f.line_no ELSE f.line_no + 1 END,
    CASE WHEN abs(f.ys / f.n - o.yc) < 0.5 * (f.hs / f.n) THEN f.ys + o.yc ELSE o.yc END, CASE WHEN abs(f.ys / f.n - o.yc) < 0.5 * (f.hs / f.n) THEN f.hs + o.h ELSE o.h END,
    CASE WHEN abs(f.ys / f.n - o.yc) < 0.5 * (f.hs / f.n) THEN f.n + 1 ELSE 1 END
  FROM f JOIN o ON o.image_id = f.image_id AND o.k = f.k + 1)"""
_GOES_ON = "abs(g.hs / g.n - w.h) < 0.5 * (g.hs / g.n) AND w.x0 - g.last < 0.5 * w.h"
_CORNERS = f"""{_BOX},
q AS (SELECT *, CASE WHEN box_no % 3 = 0 THEN (x1 - x0) / 4 ELSE 0 END AS lean FROM b),
c AS (SELECT image_id, box_no, x0 AS ax, y0 AS ay, x1 AS bx, y0 + lean AS bb, x1 AS cx, y1 + lean AS cy, x0 AS dx, y1 AS dy FROM q)"""
_PART = "SELECT p_partkey, (p_partkey * 31 % 4000 + 1) AS pw, (p_partkey * 17 % 3000 + 1) AS ph FROM part"
_GRID = "SELECT i.range AS image_id, r.range AS gy, c.range AS gx FROM range(8) i, range(8) r, range(10) c"

_MERGED = f"""w AS (SELECT o.*, f.line_no, row_number() OVER (PARTITION BY o.image_id, f.line_no ORDER BY o.x0, o.yc, o.box_no) AS j FROM o JOIN f USING (image_id, box_no)),
g AS (SELECT image_id, line_no, j, 0 AS part, h AS hs, 1 AS n, x1 AS last, x0, x1, y0, y1 FROM w WHERE j = 1
  UNION ALL SELECT w.image_id, w.line_no, w.j, CASE WHEN {_GOES_ON} THEN g.part ELSE g.part + 1 END, CASE WHEN {_GOES_ON} THEN g.hs + w.h ELSE w.h END,
    CASE WHEN {_GOES_ON} THEN g.n + 1 ELSE 1 END, w.x1, w.x0, w.x1, w.y0, w.y1
  FROM g JOIN w ON w.image_id = g.image_id AND w.line_no = g.line_no AND w.j = g.j + 1),
e AS (SELECT image_id, line_no::BIGINT AS line_no, part, count(*) AS n_boxes, min(x0) x0, max(x1) x1, min(y0) y0, max(y1) y1 FROM g GROUP BY ALL),
m AS (SELECT *, trunc(0.1 * least(x1 - x0, y1 - y0)) AS g FROM e)"""
_FREE = """s AS (SELECT *, greatest(abs((bb - ay) / greatest(bx - ax, 10)), abs((cy - dy) / greatest(cx - dx, 10))) < 0.1 AS horizontal,
  trunc(1.44 * 0.1 * least(sqrt((bx - ax) ** 2 + (bb - ay) ** 2), sqrt((dx - ax) ** 2 + (dy - ay) ** 2))) AS m,
  abs(atan((ay - cy) / greatest(ax - cx, 10))) AS p, abs(atan((bb - dy) / greatest(bx - dx, 10))) AS t FROM c)"""
_TEXT = lambda *points: " || ' ' || ".join(f"'(' || ({x})::DECIMAL(24,6)::DECIMAL(24,1) || ',' || ({y})::DECIMAL(24,6)::DECIMAL(24,1) || ')'" for x, y in points)
_VECTOR_MAPS = """
l AS (SELECT vec_id AS image_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS a, unnest(list_concat(embedding[2:64], embedding[1:1]))::DOUBLE AS b FROM embeddings),
px AS MATERIALIZED (SELECT image_id, i, (i // 8)::INT AS y, (i % 8)::INT AS x, round(abs(a) * 5, 6) AS region, round(abs(a) * 5, 6) > 0.6 AS is_text, round(abs(b) * 5, 6) > 0.9 AS is_link FROM l WHERE round(abs(a) * 5, 6) > 0.6 OR round(abs(b) * 5, 6) > 0.9),
reach AS (SELECT image_id, i, i AS r FROM px UNION SELECT n.image_id, n.i, reach.r FROM reach JOIN px m ON m.image_id = reach.image_id AND m.i = reach.i JOIN px n ON n.image_id = m.image_id AND abs(n.x - m.x) + abs(n.y - m.y) = 1),
least_of AS (SELECT image_id, i, min(r) AS r FROM reach GROUP BY ALL),
lab AS MATERIALIZED (SELECT px.*, dense_rank() OVER (PARTITION BY image_id ORDER BY r) AS label FROM px JOIN least_of USING (image_id, i)),
st AS (SELECT image_id, label, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(region) AS max_region FROM lab GROUP BY ALL),
dil AS (SELECT *, floor(sqrt(area * least(max_x - min_x + 1, max_y - min_y + 1) / ((max_x - min_x + 1) * (max_y - min_y + 1))) * 2)::INT AS radius FROM st)"""

QUERIES = {
    box_iou_pairs: f"WITH {_PAIRS} SELECT image_id, pred, ref, round(iou, 6) AS iou FROM c",
    greedy_iou_match: f"WITH {_MATCH} SELECT image_id, pred, ref, round(iou, 6) AS iou FROM m WHERE taken",
    line_detection_f1: f"""WITH {_MATCH},
n AS (SELECT image_id, count(*) FILTER (WHERE box_no % 2 = 0) AS n_pred, count(*) FILTER (WHERE box_no % 2 = 1) AS n_ref FROM b GROUP BY 1),
t AS (SELECT n.*, (SELECT count(*) FROM m WHERE m.image_id = n.image_id AND taken) AS matched FROM n)
SELECT *, CASE WHEN n_pred = 0 OR n_ref = 0 OR matched = 0 THEN 0 ELSE round(2 * (matched / n_pred) * (matched / n_ref) / (matched / n_pred + matched / n_ref), 6) END AS f1,
  CASE WHEN n_pred = 0 OR n_ref = 0 THEN 0 ELSE round(matched / n_pred, 6) END AS precision, CASE WHEN n_pred = 0 OR n_ref = 0 THEN 0 ELSE round(matched / n_ref, 6) END AS recall FROM t""",
    slope_split: f"""WITH {_CORNERS},
s AS (SELECT *, greatest(abs((bb - ay) / greatest(bx - ax, 10)), abs((cy - dy) / greatest(cx - dx, 10))) < 0.1 AS horizontal,
  trunc(1.44 * 0.1 * least(sqrt((bx - ax) ** 2 + (bb - ay) ** 2), sqrt((dx - ax) ** 2 + (dy - ay) ** 2))) AS m,
  abs(atan((ay - cy) / greatest(ax - cx, 10))) AS p, abs(atan((bb - dy) / greatest(bx - dx, 10))) AS t FROM c),
k AS (SELECT *, CASE WHEN horizontal THEN 0 ELSE m END AS g FROM s)
SELECT image_id, box_no, horizontal, round(ax - cos(p) * g, 6) AS x0, round(ay - sin(p) * g, 6) AS y0, round(bx + cos(t) * g, 6) AS x1, round(bb - sin(t) * g, 6) AS y1,
  round(cx + cos(p) * g, 6) AS x2, round(cy + sin(p) * g, 6) AS y2, round(dx - cos(t) * g, 6) AS x3, round(dy + sin(t) * g, 6) AS y3 FROM k""",
    line_groups: f"WITH {_LINES} SELECT image_id, box_no, line_no::BIGINT AS line_no FROM f",
    merged_lines: f"""WITH {_LINES},
w AS (SELECT o.*, f.line_no, row_number() OVER (PARTITION BY o.image_id, f.line_no ORDER BY o.x0, o.yc, o.box_no) AS j FROM o JOIN f USING (image_id, box_no)),
g AS (SELECT image_id, line_no, j, 0 AS part, h AS hs, 1 AS n, x1 AS last, x0, x1, y0, y1 FROM w WHERE j = 1
  UNION ALL SELECT w.image_id, w.line_no, w.j, CASE WHEN {_GOES_ON} THEN g.part ELSE g.part + 1 END, CASE WHEN {_GOES_ON} THEN g.hs + w.h ELSE w.h END,
    CASE WHEN {_GOES_ON} THEN g.n + 1 ELSE 1 END, w.x1, w.x0, w.x1, w.y0, w.y1
  FROM g JOIN w ON w.image_id = g.image_id AND w.line_no = g.line_no AND w.j = g.j + 1),
e AS (SELECT image_id, line_no::BIGINT AS line_no, part, count(*) AS n_boxes, min(x0) x0, max(x1) x1, min(y0) y0, max(y1) y1 FROM g GROUP BY ALL),
m AS (SELECT *, trunc(0.1 * least(x1 - x0, y1 - y0)) AS g FROM e)
SELECT image_id, line_no, n_boxes, round(x0 - g, 6) AS x0, round(x1 + g, 6) AS x1, round(y0 - g, 6) AS y0, round(y1 + g, 6) AS y1 FROM m""",
    detected_regions: f"""WITH {_LINES.replace("FROM b)", "FROM b WHERE box_no % 3 <> 0)")},
{_MERGED},
{_CORNERS.split("lineitem),")[1]},
{_FREE},
a AS (SELECT image_id, 0 AS kind, line_no AS a, part AS b, x0 - g AS ax, y0 - g AS ay, x1 + g AS bx, y0 - g AS bb, x1 + g AS cx, y1 + g AS cy, x0 - g AS dx, y1 + g AS dy FROM m
  UNION ALL SELECT image_id, 1, box_no, 0, ax - cos(p) * m, ay - sin(p) * m, bx + cos(t) * m, bb - sin(t) * m, cx + cos(p) * m, cy + sin(p) * m, dx - cos(t) * m, dy + sin(t) * m FROM s WHERE NOT horizontal),
z AS (SELECT * FROM a WHERE greatest(greatest(ax, bx, cx, dx) - least(ax, bx, cx, dx), greatest(ay, bb, cy, dy) - least(ay, bb, cy, dy)) > 40)
SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY kind, a, b) - 1)::INT AS region_no, kind = 0 AS axis_aligned, {_TEXT(("ax", "ay"), ("bx", "bb"), ("cx", "cy"), ("dx", "dy"))} AS quad FROM z""",
    unrotate_quads: f"""WITH {_CORNERS},
r AS (SELECT *, (box_no % 4 * 90)::INT AS rotation FROM c),
p AS (SELECT image_id, box_no, rotation, list_transform([[ax, ay], [bx, bb], [cx, cy], [dx, dy]], lambda v: CASE rotation WHEN 90 THEN [v[2], 200 - v[1]] WHEN 180 THEN [700 - v[1], 200 - v[2]] WHEN 270 THEN [700 - v[2], v[1]] ELSE v END) AS l FROM r),
s AS (SELECT *, CASE WHEN rotation = 0 THEN 1 ELSE list_position(list_transform(l, lambda v: [v[2], v[1]]), list_min(list_transform(l, lambda v: [v[2], v[1]]))) END AS k FROM p),
u AS (SELECT image_id, box_no, rotation, list_concat(l[k:4], l[1:k - 1]) AS l FROM s)
SELECT image_id, box_no, rotation, round(l[1][1], 6) AS x0, round(l[1][2], 6) AS y0, round(l[2][1], 6) AS x1, round(l[2][2], 6) AS y1, round(l[3][1], 6) AS x2, round(l[3][2], 6) AS y2, round(l[4][1], 6) AS x3, round(l[4][2], 6) AS y3 FROM u""",
    rotation_pick: """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda v: abs(v)::DOUBLE) a, list_transform(embedding[5:8], lambda v: abs(v)::DOUBLE) b FROM embeddings),
k AS (SELECT vec_id, CASE WHEN list_max(a[2:4]) > greatest(a[1], 1e-6) * 1.05 THEN list_position(a[2:4], list_max(a[2:4])) ELSE 0 END p, CASE WHEN list_max(b[2:4]) > greatest(b[1], 1e-6) * 1.05 THEN list_position(b[2:4], list_max(b[2:4])) ELSE 0 END q FROM e)
SELECT vec_id, CASE WHEN p = q THEN p * 90 ELSE 0 END AS rotation FROM k""",
    heat_mass: """WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS r FROM embeddings)
SELECT image_id, round(sum(CASE WHEN r > 0.1 THEN r ELSE 0 END) / count(*), 6) AS region_mass, round(sum(CASE WHEN -r > 0.1 THEN -r ELSE 0 END) / count(*), 6) AS link_mass FROM e GROUP BY image_id""",
    resize_plan: f"""WITH p AS ({_PART}), r AS (SELECT *, least(greatest(pw, ph), 2560)::DOUBLE / greatest(pw, ph) AS k FROM p),
s AS (SELECT p_partkey, greatest(1, floor(pw * k))::INT AS w, greatest(1, floor(ph * k))::INT AS h FROM r)
SELECT p_partkey, w, h, (ceil(w / 32) * 32)::INT AS padded_w, (ceil(w / 32) * 32 * ceil(h / 32) * 32)::BIGINT AS area FROM s""",
    megapixel_budget: f"""WITH p AS ({_PART}), c AS (SELECT p_partkey, pw, ph, unnest(range(1, 2561)) AS canvas FROM p),
r AS (SELECT *, least(greatest(pw, ph), canvas)::DOUBLE / greatest(pw, ph) AS k FROM c)
SELECT p_partkey, max(CASE WHEN ceil(greatest(1, floor(pw * k)) / 32) * 32 * ceil(greatest(1, floor(ph * k)) / 32) * 32 <= 500000 THEN canvas ELSE 1 END)::INT AS canvas FROM r GROUP BY p_partkey""",
    component_stats: f"SELECT image_id, (gy * 10 + gx + 1) AS label, 36::BIGINT AS area, (6 + 12 * gx)::INT AS min_x, (11 + 12 * gx)::INT AS max_x, (6 + 12 * gy)::INT AS min_y, (11 + 12 * gy)::INT AS max_y, 0.9::DOUBLE AS max_region, 4 AS radius FROM ({_GRID}) WHERE 6 + 12 * gy < 96",
    component_boxes: None,
    vector_components: f"WITH RECURSIVE {_VECTOR_MAPS} SELECT * FROM dil",
    vector_kept_components: f"WITH RECURSIVE {_VECTOR_MAPS} SELECT image_id, label, area FROM st WHERE area >= 3 AND max_region >= 1.0",
    vector_grown_components: f"""WITH RECURSIVE {_VECTOR_MAPS},
p AS (SELECT l.image_id, l.label, l.x, l.y, d.radius AS r, (d.radius + 1) // 2 AS k FROM lab l JOIN dil d USING (image_id, label) WHERE is_text OR NOT is_link),
w AS (SELECT DISTINCT image_id, label, r, k, y, unnest(range(greatest(0, x - r + k), least(7, x + k) + 1)) AS x FROM p),
t AS (SELECT DISTINCT image_id, label, x, unnest(range(greatest(0, y - r + k), least(7, y + k) + 1)) AS y FROM w)
SELECT image_id, label, count(*) AS n, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM t GROUP BY image_id, label""",
    vector_rectangles: f"""WITH RECURSIVE {_VECTOR_MAPS},
u AS (SELECT DISTINCT a.image_id, a.label, (b.x - a.x) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS ux, (b.y - a.y) / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS uy FROM lab a JOIN lab b ON a.image_id = b.image_id AND a.label = b.label AND a.i < b.i),
r AS (SELECT u.image_id, u.label, ux, uy, (max(x * ux + y * uy) - min(x * ux + y * uy)) * (max(y * ux - x * uy) - min(y * ux - x * uy)) AS area FROM u JOIN lab USING (image_id, label) GROUP BY ALL)
SELECT st.image_id, st.label, round(coalesce(min(r.area), 0), 6) AS rectangle FROM st LEFT JOIN r USING (image_id, label) GROUP BY ALL""",
    quad_corners: f"""WITH {_CORNERS},
l AS (SELECT image_id, box_no, [[ax * 1.5, ay * 1.5], [bx * 1.5, bb * 1.5], [cx * 1.5, cy * 1.5], [dx * 1.5, dy * 1.5]] AS q FROM c),
k AS (SELECT *, q[list_position(list_transform(q, lambda v: v[1] + v[2]), list_min(list_transform(q, lambda v: v[1] + v[2])))] AS near, list_min(list_transform(q, lambda v: [v[2], v[1]])) AS high,
  greatest(list_max(list_transform(q, lambda v: v[1])) - list_min(list_transform(q, lambda v: v[1])), list_max(list_transform(q, lambda v: v[2])) - list_min(list_transform(q, lambda v: v[2]))) AS extent FROM l)
SELECT image_id, box_no, round(extent, 6) AS extent, round(near[1], 6) AS near_x, round(near[2], 6) AS near_y, round(high[2], 6) AS high_x, round(high[1], 6) AS high_y FROM k""",
    pixel_measures: """WITH b AS (SELECT vec_id, list_transform(embedding[1:63], lambda v: (floor(abs(v::DOUBLE) * 1000)::INT % 256)::BIGINT) AS v FROM embeddings),
p AS (SELECT vec_id, unnest(range(21)) AS i, v FROM b),
q AS (SELECT vec_id, i, v[3 * i + 1] AS r, v[3 * i + 2] AS g, v[3 * i + 3] AS b, (4899 * v[3 * i + 1] + 9617 * v[3 * i + 2] + 1868 * v[3 * i + 3] + 8192) >> 14 AS y FROM p),
s AS (SELECT vec_id, quantile_cont(y::DOUBLE, 0.9) AS high, quantile_cont(y::DOUBLE, 0.1) AS low FROM q GROUP BY vec_id),
c AS (SELECT *, (high - low) / greatest(10.0, high + low) AS contrast FROM s)
SELECT vec_id, sum(y * (i + 1))::BIGINT AS grey, sum(CASE WHEN contrast >= 0.5 THEN y ELSE trunc(greatest(0, least(255, (y - low + 25) * (200.0::DOUBLE / greatest(10.0, high - low)))))::BIGINT END * (i + 1))::BIGINT AS stretched,
  sum(y * ((i % 7) * 3 + (2 - i // 7) + 1))::BIGINT AS turned, sum(CASE WHEN i % 7 BETWEEN 1 AND 3 AND i // 7 < 2 THEN y ELSE 0 END)::BIGINT AS cut,
  round(any_value(contrast), 6) AS contrast, round(any_value(high), 6) AS high, round(any_value(low), 6) AS low,
  concat_ws(' ', (max(CASE WHEN i = 0 THEN r END) / (255 * 0.229) - 0.485 / 0.229)::DECIMAL(12,4), (max(CASE WHEN i = 20 THEN r END) / (255 * 0.229) - 0.485 / 0.229)::DECIMAL(12,4), (-0.485 / 0.229)::DECIMAL(12,4),
    (max(CASE WHEN i = 0 THEN g END) / (255 * 0.224) - 0.456 / 0.224)::DECIMAL(12,4), (max(CASE WHEN i = 20 THEN g END) / (255 * 0.224) - 0.456 / 0.224)::DECIMAL(12,4), (-0.456 / 0.224)::DECIMAL(12,4),
    (max(CASE WHEN i = 0 THEN b END) / (255 * 0.225) - 0.406 / 0.225)::DECIMAL(12,4), (max(CASE WHEN i = 20 THEN b END) / (255 * 0.225) - 0.406 / 0.225)::DECIMAL(12,4), (-0.406 / 0.225)::DECIMAL(12,4)) AS input
FROM q JOIN c USING (vec_id) GROUP BY vec_id""",
    dilate_rows: """WITH e AS (SELECT user_id AS image_id, event_id % 7 AS y, event_id % 500 AS x, max((value > 50)::INT) AS set FROM events GROUP BY ALL)
SELECT *, max(set) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS hit FROM e""",
}
