"""Queries of one-to-one matching under a similarity of the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import text as t
from lectern.operators import matching
from lectern.sources import table

LEAST_IOU, LEAST_SHARED = 0.4, 0.03
#: Boxes of a page, turns of a conversation, that are matched in one task; larger ones are spread. Turns of a part of a conversation that is spread.
PAGE, TALK, PART = 200_000, 2_000, 500


def _rounded(score: Column) -> Column:
    """To six places as in the SQL, where the millionfold is rounded: a half that is no binary fraction may fall either way."""
    return F.round(score * 1e6) / 1e6


def matched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items as two detectors' boxes on one page, hundreds a page, matched by IoU."""
    l = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    numbered = l.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.row_number().over(order).cast("bigint").alias("no"))  # sides are made after the shuffle
    x0, y0 = (F.col("l_partkey") * 37 % 900).cast("double"), (F.col("l_orderkey") * 11 % 700).cast("double")
    b = numbered.select("l_suppkey", "no", x0.alias("x0"), y0.alias("y0"), (x0 + 30 + F.col("l_quantity")).alias("x1"), (y0 + 25 + F.col("l_linenumber")).alias("y1"))
    a, c = ({k: F.col(f"{n}.{k}") for k in ("x0", "y0", "x1", "y1")} for n in ("p", "r"))
    least = LEAST_IOU - 1e-6  # before it is rounded
    blocks = matching.centre_cells(*(F.col(k) for k in ("x0", "y0", "x1", "y1")), least)
    iou = g.iou(a, c)
    meet = (a["x0"] < c["x1"]) & (c["x0"] < a["x1"]) & (a["y0"] < c["y1"]) & (c["y0"] < a["y1"])
    pairs = lambda d: matching.candidates(d.filter("no % 2 = 0"), d.filter("no % 2 = 1"), "l_suppkey", "no", blocks, _rounded(iou), LEAST_IOU, meet & (iou >= least))
    return matching.matched(b, pairs, "l_suppkey", matching.large_groups(l, "l_suppkey", PAGE))


def matched_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn of a conversation with the answer that shares most of its words, one to one."""
    turns = table(spark, sf_dir, "conversations")
    c = turns.filter("text is not null and turn is not null and role in ('user', 'assistant')").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", t.plain(F.col("text")).alias("text"))
    both = F.size("p.words") + F.size("r.words")
    similarity = F.transform(F.array(F.size(F.array_intersect("p.words", "r.words"))), lambda met: _rounded(F.try_divide(met, both - met)))[0]

    def pairs(d: DataFrame) -> DataFrame:
        parts = F.ceil(F.col("n") / PART) if "n" in d.columns else F.lit(1).cast("bigint")
        told = d.withColumn("words", F.array_distinct(t.cut(F.col("text")))).drop("text")
        return matching.candidates(told.filter("role = 'user'"), told.filter("role = 'assistant'"), "conv_id", "turn", matching.dealt(F.col("turn"), parts), similarity, LEAST_SHARED)

    large = matching.large_groups(turns, "conv_id", TALK)
    # texts are dealt by conversation, and cut where they arrive: words take more room
    return matching.matched(c.repartition("conv_id"), pairs, "conv_id", large)


def _rounds(group: str) -> str:
    """SQL: the pairs of ``pairs`` that are the best of both ends, round by round."""
    return f"""
r AS (
  SELECT {group}, pred, ref, score, false AS taken, false AS gone FROM pairs
  UNION ALL
  SELECT {group}, pred, ref, score, taken, bool_or(taken) OVER (PARTITION BY {group}, pred) OR bool_or(taken) OVER (PARTITION BY {group}, ref)
  FROM (SELECT {group}, pred, ref, score,
               row_number() OVER (PARTITION BY {group}, pred ORDER BY score DESC, pred, ref) = 1 AND row_number() OVER (PARTITION BY {group}, ref ORDER BY score DESC, pred, ref) = 1 AS taken
        FROM r WHERE NOT taken AND NOT gone))
SELECT {group}, pred, ref, score FROM r WHERE taken"""


QUERIES = {
    matched_boxes: f"""
WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS no FROM lineitem),
b AS (SELECT l_suppkey, no, (l_partkey * 37 % 900)::DOUBLE AS x0, (l_orderkey * 11 % 700)::DOUBLE AS y0, l_partkey * 37 % 900 + 30 + l_quantity AS x1, l_orderkey * 11 % 700 + 25 + l_linenumber AS y1 FROM n),
o AS (SELECT p.l_suppkey, p.no AS pred, r.no AS ref, (p.x1 - p.x0) * (p.y1 - p.y0) + (r.x1 - r.x0) * (r.y1 - r.y0) AS areas,
             greatest(0, least(p.x1, r.x1) - greatest(p.x0, r.x0)) * greatest(0, least(p.y1, r.y1) - greatest(p.y0, r.y0)) AS met
      FROM b p JOIN b r ON p.l_suppkey = r.l_suppkey AND p.no % 2 = 0 AND r.no % 2 = 1 AND p.x0 < r.x1 AND r.x0 < p.x1 AND p.y0 < r.y1 AND r.y0 < p.y1),
pairs AS (SELECT * FROM (SELECT l_suppkey, pred, ref, round((met / (areas - met))::DOUBLE, 6) AS score FROM o) WHERE score >= {LEAST_IOU}),{_rounds("l_suppkey")}""",
    matched_turns: rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, list_distinct(list_filter(string_split_regex(replace(lower(text), '|', ' '), '\s+'), lambda x: x <> '')) AS w FROM conversations WHERE text IS NOT NULL),
o AS (SELECT p.conv_id, p.turn AS pred, r.turn AS ref, len(list_intersect(p.w, r.w)) AS met, len(p.w) + len(r.w) AS words FROM c p JOIN c r ON p.conv_id = r.conv_id AND p.role = 'user' AND r.role = 'assistant'),
pairs AS (SELECT * FROM (SELECT conv_id, pred, ref, round((met / (words - met))::DOUBLE, 6) AS score FROM o WHERE met > 0) WHERE score >= {LEAST_SHARED}),{_rounds("conv_id")}""",
}
