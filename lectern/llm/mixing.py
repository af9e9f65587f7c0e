"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source has a target in words. Every document is due ``r = target / source
size`` copies: ``floor(r)`` are certain, and the fraction ``p = r - floor(r)`` of the source's
words is a sample. Its inclusion probabilities are unequal: short documents are preferred to
long ones (``LONG`` words or more). Of the words that could move from the long to the short, half do:
``d = min(p L, (1 - p) S) / 2`` for L words in long documents and S in short ones, so a long document
has ``p - d / L`` and a short one ``p + d / S``; both lie within 0 and 1, and the expected words are ``p`` of
the source as before. Documents are ranked by the random odds U/(1-U) over their inclusion odds (Rosén,
1997), U a hash of doc_id, so reruns agree. The sample is fixed-size in words: documents are taken
in that order until the fraction's words are reached, the one at the edge
belonging to it when its middle does.

Ranks are found without ordering a source in one task: words are summed in
``STRIPES`` intervals of the ratio (as ratio / (1 + ratio), which lies within 0 and 1),
then inside the one interval that holds the edge only, in finer intervals,
and only the last few rows are ordered.

Targets: sources by code point, null last, weigh ``weights`` repeating, and
share the total; a target stops at ``cap`` times its source's size, and the
excess is shared again by weight until none is above.

Defined cases: a null text has no words; a null source is a source; documents
without words are taken 0 times over; an empty table gives no rows; a row without a doc_id goes by a hash of its text; rows with
the same doc_id and size have the same rank and are told apart by a hash of the text, then of the columns ``keep``; very long
texts are only counted; other columns than ``keep`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.state import materialize, small_side

WEIGHTS, CAP = (5, 2, 1), 3
#: Words from which a document is long.
LONG = 500
STRIPES, ROUNDS = 1000, 2


def word_count(text: Column) -> Column:
    """Number of runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Rows (source, source_size, long_size, target), one per source of ``sized`` (source, size); long_size is of long documents.

    The level at which the excess is spent: sources in order of ``cap * size / weight``
    are full up to the first whose quota at the level of the rest is within its cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") >= LONG, F.col("size")).otherwise(0)).alias("long_size"))
    ranked = sums.withColumn("r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * cap
    known = ranked.withColumn("weight", weight.cast("double")).withColumn("full", full.cast("double"))
    order = Window.orderBy(F.col("full") / F.col("weight"), "r")
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    known = known.withColumn("level", F.when(level * F.col("weight") <= F.col("full"), level))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.select("source", "source_size", "long_size", F.coalesce(F.least("full", level * F.col("weight")), F.lit(0.0)).alias("target"))


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) from 48 bits of a hash of doc_id, or of the text where there is none."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    bits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def inclusion(size: Column, share: Column, source_size: Column, long_size: Column) -> Column:
    """The probability that a document of ``size`` words is in the sample of ``share`` of its source's words."""
    short = source_size - long_size
    moved = F.least(share * long_size, (1 - share) * short) / 2
    return F.when(size >= LONG, share - moved / F.greatest(long_size, F.lit(1))).otherwise(share + moved / F.greatest(short, F.lit(1)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken) and the columns ``keep``, one per row of ``docs`` (doc_id, text, source)."""
    # only what ranks the documents is carried on; the texts are read once
    u = uniform(F.col("doc_id"), F.col("text")).alias("u")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), u, F.xxhash64("text").alias("h"), *keep), "sized")
    goals = materialize(targets(sized, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("whole", F.floor(rate + 1e-12)).withColumn("share", F.greatest(F.lit(0.0), rate - F.col("whole")))
    goals = goals.withColumn("words", F.col("share") * F.col("source_size")).withColumnRenamed("source", "s")
    placed = sized.join(small_side(goals), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    chance = inclusion(F.col("size"), F.col("share"), F.col("source_size"), F.col("long_size"))
    ratio = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    placed = placed.withColumn("ratio", F.when(F.col("share") > 0, ratio))
    placed = placed.withColumn("v", F.least(F.col("ratio") / (1 + F.col("ratio")), F.lit(1 - 2.0**-53))).drop("long_size")
    at = goals.select("s", F.lit(0.0).alias("low"), F.lit(1.0).alias("width"), F.lit(0).cast("bigint").alias("below"), F.col("words").alias("edge_words"))
    for _ in range(ROUNDS):
        inside = placed.join(small_side(at), F.col("source").eqNullSafe(F.col("s"))).filter("v >= low and v < low + width")
        stripe = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width") * STRIPES), F.lit(STRIPES - 1))
        sums = inside.groupBy("s", "low", "width", "below", "edge_words", stripe.alias("k")).agg(F.sum("size").alias("n"))
        run = F.sum("n").over(Window.partitionBy("s").orderBy("k"))
        edge = sums.withColumn("to", F.col("below") + run).filter(F.col("to") >= F.col("edge_words"))
        edge = edge.groupBy("s", "edge_words").agg(F.min(F.struct("k", "to", "n", "low", "width")).alias("e"))
        low = F.col("e.low") + F.col("e.width") / STRIPES * F.col("e.k")
        at = edge.select("s", low.alias("low"), (F.col("e.width") / STRIPES).alias("width"), (F.col("e.to") - F.col("e.n")).alias("below"), "edge_words")
        at = materialize(at, "edge")
    placed = placed.drop("words").join(small_side(at.withColumnRenamed("edge_words", "words")), F.col("source").eqNullSafe(F.col("s")), "left")
    edge = placed.filter("share > 0 and v >= low and v < low + width")
    order = Window.partitionBy("source").orderBy("ratio", "doc_id", "h", "size", *([F.xxhash64(*keep)] if keep else []))
    run = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("more", ((F.col("below") + run - F.col("size") / 2) <= F.col("words")).cast("int"))
    away = placed.filter("not (share > 0 and low is not null and v >= low and v < low + width) or low is null")
    away = away.withColumn("more", F.expr("cast(share > 0 and (low is null or v < low) as int)"))
    taken = (F.col("size") * (F.col("whole") + F.coalesce("more", F.lit(0)))).cast("bigint")
    return edge.unionByName(away).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)
