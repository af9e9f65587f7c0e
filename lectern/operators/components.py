"""Score maps to boxes: thresholds, 4-connected components, statistics, dilation, box fitting.

Pixels are long rows (image_id, y, x, region, link). An image's components are
labelled in one grouped map (a page is bounded by its canvas); all else is
aggregates and windows keyed by (image_id, label). Labels follow the raster order of first pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEXT, LINK, LOW = 0.7, 0.4, 0.4
MIN_AREA = 10


def synthetic_maps(spark: SparkSession, images: int, height: int, width: int) -> DataFrame:
    """Pixels of blobs of 6 x 6 on a grid of 12 from 6 on: region 0.9 or 0, link 0.1."""
    n = F.col("id")
    rows = spark.range(images * height * width).select((n / (height * width)).cast("bigint").alias("image_id"), ((n % (height * width)) / width).cast("int").alias("y"), (n % width).cast("int").alias("x"))
    inside = lambda c: (F.col(c) >= 6) & ((F.col(c) - 6) % 12 < 6)
    return rows.withColumn("region", F.when(inside("y") & inside("x"), 0.9).otherwise(0.0)).withColumn("link", F.lit(0.1))


def foreground(pixels: DataFrame, low: float = LOW, link: float = LINK) -> DataFrame:
    """Pixels of text or link score above its threshold, with ``is_text`` and ``is_link``."""
    return pixels.withColumn("is_text", F.col("region") > low).withColumn("is_link", F.col("link") > link).filter("is_text or is_link")


def labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected components of pixels in raster order."""
    key = y.astype(np.int64) * (int(x.max()) + 2) + x
    least = np.arange(len(key))
    pairs = []
    for step in (1, int(x.max()) + 2):
        at = np.searchsorted(key, key + step)
        at[at == len(key)] = 0
        near = key[at] == key + step
        pairs.append((np.flatnonzero(near), at[near]))
    a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
    while True:  # smallest label of neighbours, then of labels: paths halve each round
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if (least == before).all():
            return np.unique(least, return_inverse=True)[1] + 1


def label_components(pixels: DataFrame) -> DataFrame:
    """``pixels`` (image_id, y, x, region, is_text, is_link) with ``label`` from 1 per image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], ignore_index=True)
        pdf["label"] = labels(pdf["y"].to_numpy(), pdf["x"].to_numpy())
        return pdf[["image_id", "y", "x", "region", "is_text", "is_link", "label"]]

    return pixels.select("image_id", "y", "x", "region", "is_text", "is_link").groupBy("image_id").applyInPandas(run, "image_id bigint, y int, x int, region double, is_text boolean, is_link boolean, label bigint")


def statistics(labelled: DataFrame) -> DataFrame:
    """Area, extents and highest region score of each component."""
    return labelled.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"), *(f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))), F.max("region").alias("max_region"))


def dilation(stats: DataFrame) -> DataFrame:
    """``stats`` with ``radius``, the number of dilation steps of a component."""
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return stats.withColumn("radius", F.floor(F.sqrt(F.col("area") * F.least(w, h) / (w * h)) * 2).cast("int"))


def kept(stats: DataFrame, text: float = TEXT, area: int = MIN_AREA) -> DataFrame:
    return stats.filter((F.col("area") >= area) & (F.col("max_region") >= text))


def dilate(points: DataFrame, height: int, width: int) -> DataFrame:
    """Rows (image_id, label, y, x) grown by a square of 1 + radius, anchored at its middle, one axis at a time."""
    for axis, size in (("x", width), ("y", height)):
        back = F.floor((F.col("radius") + 1) / 2)
        reach = F.sequence(F.greatest(F.lit(0), F.col(axis) - F.col("radius") + back), F.least(F.lit(size - 1), F.col(axis) + back)).cast("array<int>")
        points = points.withColumn(axis, F.explode(reach)).distinct()
    return points


def line_max(points: DataFrame, before: int, after: int) -> DataFrame:
    """One dilation pass as a range window: ``hit`` where any set pixel of the row is within reach."""
    near = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-before, after)
    return points.withColumn("hit", F.max("set").over(near))


def min_area_rect(points: np.ndarray) -> list[list[float]]:
    """Corners, clockwise from the left top, of the smallest rectangle around points; edges of the hull are tried, the first best wins."""
    pts = np.unique(points.astype(np.float64), axis=0)
    hull = _hull(pts)
    if len(hull) == 1:
        return [hull[0].tolist()] * 4
    best, found = np.inf, hull
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        u = (q - p) / np.hypot(*(q - p))
        frame = np.stack([u, [-u[1], u[0]]])
        turned = hull @ frame.T
        low, high = turned.min(axis=0), turned.max(axis=0)
        area = float(np.prod(high - low))
        if area < best - 1e-12:
            best, found = area, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ frame
    order = found[np.argsort(found[:, 0], kind="stable")]
    left, right = (s[np.argsort(s[:, 1], kind="stable")] for s in (order[:2], order[2:]))
    return [left[0].tolist(), right[0].tolist(), right[1].tolist(), left[1].tolist()]


def _hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull of sorted distinct points by the monotone chain."""
    if len(pts) < 3:
        return pts
    chains = []
    for walk in (pts, pts[::-1]):
        chain: list[np.ndarray] = []
        for p in walk:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def rectangle_areas(points: DataFrame) -> DataFrame:
    """Rows (image_id, label, rectangle): the area of the smallest rectangle around points (image_id, label, y, x)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c, _ = np.array(min_area_rect(pdf[["x", "y"]].to_numpy()))
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "label": [pdf["label"].iloc[0]], "rectangle": [float(np.hypot(*(a - b)) * np.hypot(*(b - c)))]})

    return points.groupBy("image_id", "label").applyInPandas(run, "image_id bigint, label bigint, rectangle double")


def fit_box(xy: np.ndarray) -> np.ndarray:
    """Corners of the box of points (x, y): a near-square fit falls back to the extents; from the corner nearest the origin on."""
    box = np.array(min_area_rect(xy))
    a, b = np.hypot(*(box[0] - box[1])), np.hypot(*(box[1] - box[2]))
    if abs(1 - max(a, b) / (min(a, b) + 1e-5)) <= 0.1:
        (l, t), (r, d) = xy.min(axis=0), xy.max(axis=0)
        box = np.array([[l, t], [r, t], [r, d], [l, d]], float)
    return np.roll(box, -int(box.sum(axis=1).argmin()), axis=0)


def map_boxes(region: np.ndarray, link: np.ndarray, low: float = LOW, link_ths: float = LINK, text: float = TEXT, area: int = MIN_AREA) -> list[np.ndarray]:
    """``boxes`` of one score map (h, w) where the map already is: nothing but boxes leaves the task that ran the model."""
    is_text, is_link = region > low, link > link_ths
    y, x = np.nonzero(is_text | is_link)
    out: list[np.ndarray] = []
    if not len(y):
        return out
    label = labels(y, x)
    order = np.argsort(label, kind="stable")
    ends = np.cumsum(np.bincount(label)[1:])
    for rows in np.split(order, ends[:-1]):
        ys, xs = y[rows], x[rows]
        if len(rows) < area or region[ys, xs].max() < text:
            continue
        w, h = xs.max() - xs.min() + 1, ys.max() - ys.min() + 1
        radius = int(np.sqrt(len(rows) * min(w, h) / (w * h)) * 2)
        solid = is_text[ys, xs]
        ys, xs, back = ys[solid], xs[solid], (radius + 1) // 2
        if not len(ys):
            continue
        reach = np.arange(-radius, 1) + back
        points = np.unique(np.stack([(xs[:, None, None] + reach[None, :, None] + 0 * reach[None, None]).ravel(), (ys[:, None, None] + 0 * reach[None, :, None] + reach[None, None]).ravel()], axis=1), axis=0)
        inside = (points >= 0).all(axis=1) & (points[:, 0] < region.shape[1]) & (points[:, 1] < region.shape[0])
        out.append(fit_box(points[inside]))
    return out


def masses(region: np.ndarray, link: np.ndarray, low: float = LOW, link_ths: float = LINK) -> tuple[float, float]:
    """``heat_mass`` of one score map."""
    return float(region[region > low].sum() / region.size), float(link[link > link_ths].sum() / link.size)


def fit_boxes(points: DataFrame) -> DataFrame:
    """Rows (image_id, label, quad) of points (image_id, label, y, x): near-square fits fall back to the extents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        quad = [{"x": float(x), "y": float(y)} for x, y in fit_box(pdf[["x", "y"]].to_numpy())]
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "label": [pdf["label"].iloc[0]], "quad": [quad]})

    return points.groupBy("image_id", "label").applyInPandas(run, "image_id bigint, label bigint, quad array<struct<x:double,y:double>>")


def boxes(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Rows (image_id, label, quad) in score-map space: the whole way from pixels to fitted boxes."""
    labelled = label_components(foreground(pixels))
    stats = dilation(kept(statistics(labelled)))
    solid = labelled.filter(~(F.col("is_link") & ~F.col("is_text"))).select("image_id", "label", "y", "x")
    grown = dilate(solid.join(stats.select("image_id", "label", "radius"), ["image_id", "label"]), height, width)
    return fit_boxes(grown)


def heat_mass(pixels: DataFrame, low: float = LOW, link: float = LINK, *keys: str) -> DataFrame:
    """Scores above their thresholds over the number of pixels, per image (and ``keys``)."""
    share = lambda c, t: F.sum(F.when(F.col(c) > t, F.col(c)).otherwise(0.0)) / F.count(F.lit(1))
    return pixels.groupBy("image_id", *keys).agg(share("region", low).alias("region_mass"), share("link", link).alias("link_mass"))


def best_rotation(scores: Column, margin: float = 0.05) -> Column:
    """Index (0 to 3) of the turn that beats no turn by ``margin``; the earliest of equals; 0 otherwise."""
    rest = F.slice(scores, 2, 3)
    top = F.array_max(rest)
    wins = top > F.greatest(scores[0], F.lit(1e-6)) * (1 + margin)
    return F.when(wins & (top > scores[0]), F.array_position(rest, top)).otherwise(F.lit(0)).cast("int")


def pick_rotation(combined: Column, link: Column, margin: float = 0.05) -> Column:
    """Degrees: turned only if both series choose the same turn."""
    a, b = best_rotation(combined, margin), best_rotation(link, margin)
    return F.when(a == b, a * 90).otherwise(F.lit(0))
