"""Scores of hypotheses against references: bags of tokens, boxes, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import text as t
from lectern.operators.stages import small_side

MIN_ANCHORS = 3


def bag(rows: DataFrame, key: str, items: Column, among: DataFrame | None = None) -> DataFrame:
    """Rows (key, item, n, total): how often each item occurs, and all items of the key.

    With ``among`` (item), only items that stand there are told, and only these are shuffled; the total still is of all.
    """
    sized = rows.select(F.col(key), items.alias("items")).withColumn("total", F.size("items"))
    long = sized.select(key, "total", F.explode("items").alias("item"))
    if among is not None:
        long = long.join(small_side(among.select("item").distinct()), "item", "left_semi")
    return long.groupBy(key, "total", "item").agg(F.count(F.lit(1)).alias("n"))


def bag_f1(hyp: DataFrame, ref: DataFrame, hyp_key: str, ref_key: str) -> DataFrame:
    """Rows (hyp_key, ref_key, f1, precision, recall) of bags that share an item: an equi-join on items.

    Pairs without a common item score 0 and are not made. Where ``ref`` is small (counted), it is sent to the
    tasks, and a pair's common items are summed before any shuffle, however common an item is.
    """
    shared = hyp.withColumnsRenamed({"n": "hn", "total": "ht"}).join(small_side(ref.withColumnsRenamed({"n": "rn", "total": "rt"})), "item")
    met = shared.groupBy(hyp_key, ref_key, "ht", "rt").agg(F.sum(F.least("hn", "rn")).alias("met"))
    parts = t.f1_parts(F.col("met"), F.col("ht"), F.col("rt"))
    return met.select(hyp_key, ref_key, parts.alias("p")).select(hyp_key, ref_key, "p.f1", "p.precision", "p.recall")


def candidate_pairs(pred: DataFrame, ref: DataFrame, threshold: float, cell: float = 64.0) -> DataFrame:
    """Rows (image_id, pred, ref, iou) of boxes (image_id, box_no, x0, y0, x1, y1) overlapping by ``threshold``.

    Boxes meet through the grid cells they touch, so the join is an equi-join; a pair is made in
    the first cell that both touch only.
    """

    def spread(b: DataFrame, name: str) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        out = b.select("image_id", *(F.col(c).alias(f"{name}_{c}") for c in ("box_no", "x0", "y0", "x1", "y1")), span("x0", "x1").alias("cx"), span("y0", "y1").alias("cy"))
        return out.withColumn("cx", F.explode("cx")).withColumn("cy", F.explode("cy"))

    both = spread(pred, "p").join(spread(ref, "r"), ["image_id", "cx", "cy"])
    first = (F.col("cx") == F.floor(F.greatest("p_x0", "r_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("p_y0", "r_y0") / cell))
    a, b = ({k: F.col(f"{n}_{k}") for k in ("x0", "y0", "x1", "y1")} for n in ("p", "r"))
    return both.filter(first).select("image_id", F.col("p_box_no").alias("pred"), F.col("r_box_no").alias("ref"), g.iou(a, b).alias("iou")).filter(F.col("iou") >= threshold)


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of candidate pairs (image_id, pred, ref, iou): highest first, then by pred and ref."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), F.col("pred").cast("bigint").alias("pred"), F.col("ref").cast("bigint").alias("ref"))))
    state = F.array().cast("array<struct<o:double,pred:bigint,ref:bigint>>")

    def take(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda d: (d["pred"] == x["pred"]) | (d["ref"] == x["ref"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(x)))

    found = pairs.groupBy("image_id").agg(ordered.alias("l")).select("image_id", F.explode(F.aggregate("l", state, take)).alias("m"))
    return found.select("image_id", "m.pred", "m.ref", (-F.col("m.o")).alias("iou"))


def line_detection(pred: DataFrame, ref: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (image_id, n_pred, n_ref, matched, f1, precision, recall)."""
    matched = greedy_match(candidate_pairs(pred, ref, threshold)).groupBy("image_id").agg(F.count(F.lit(1)).alias("matched"))
    n = pred.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pred")).join(ref.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_ref")), "image_id", "full").join(matched, "image_id", "left").na.fill(0)
    return n.withColumn("p", t.f1_parts(F.col("matched"), F.col("n_pred"), F.col("n_ref"))).select("image_id", "n_pred", "n_ref", "matched", "p.f1", "p.precision", "p.recall")


def engine_scores(rows: DataFrame, first: str, second: str, truth: str, *keys: str) -> DataFrame:
    """Rows (keys, char_f1, word_f1, first_cer, second_cer, first_token_f1, second_token_f1), one per row of unique ``keys``.

    Two engines' texts of a page are held against each other, and each, normalised, against the truth.
    A bag is spread over the join by its page, so no word is common to more than one page's rows.
    """
    x, y, ref = (t.normalize_text(F.col(c)) for c in (first, second, truth))
    bags = {"char_f1": (t.char_bag(F.col(first)), t.char_bag(F.col(second))), "word_f1": (t.tokens(F.col(first)), t.tokens(F.col(second))), "first_token_f1": (t.tokens(x), t.tokens(ref)), "second_token_f1": (t.tokens(y), t.tokens(ref))}
    long = None
    for name, sides in bags.items():
        for side, items in enumerate(sides):
            part = rows.select(*keys, F.lit(name).alias("score"), F.lit(side).alias("side"), F.explode_outer(items).alias("item"))
            long = part if long is None else long.unionByName(part)
    n = [F.count_if((F.col("side") == s) & F.col("item").isNotNull()) for s in (0, 1)]
    met = long.groupBy(*keys, "score", "item").agg(n[0].alias("h"), n[1].alias("r")).groupBy(*keys, "score").agg(F.sum(F.least("h", "r")).alias("met"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    f1 = met.withColumn("f1", t.f1_parts(F.col("met"), F.col("h"), F.col("r"))["f1"]).groupBy(*keys).pivot("score", list(bags)).agg(F.first("f1"))
    rates = rows.select(*keys, t.character_error_rate(ref, x).alias("first_cer"), t.character_error_rate(ref, y).alias("second_cer"))
    return rates.join(f1, list(keys)).select(*keys, "char_f1", "word_f1", "first_cer", "second_cer", "first_token_f1", "second_token_f1")


def lis_length(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence: the ends of the best runs by length, kept sorted."""

    def place(tails: Column, v: Column) -> Column:
        at = F.size(F.filter(tails, lambda x: x < v))
        return F.concat(F.slice(tails, F.lit(1), at), F.array(v), F.slice(tails, at + 2, F.greatest(F.lit(0), F.size(tails) - at - 1)))

    return F.size(F.aggregate(values, F.array().cast("array<int>"), place))


def reading_order(pairs: DataFrame, hypothesis: str, reference: str, *keys: str) -> DataFrame:
    """Rows (keys, anchors, score), one per key: order kept among tokens that occur once on both sides; null under three."""
    toks = {s: pairs.select(*keys, F.posexplode(t.tokens(F.col(c))).alias(s, "item")).groupBy(*keys, "item").agg(F.min(s).alias(s), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n") for s, c in (("h", hypothesis), ("r", reference))}
    met = toks["h"].join(toks["r"], [*keys, "item"]).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]).alias("order"))
    score = F.when(F.size("order") >= MIN_ANCHORS, lis_length(F.col("order")) / F.size("order"))
    scored = met.select(*keys, F.size("order").alias("anchors"), score.alias("score"))
    return pairs.select(*keys).distinct().join(scored, list(keys), "left").withColumn("anchors", F.coalesce("anchors", F.lit(0)))
