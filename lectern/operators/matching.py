"""One-to-one matching under any similarity: pairs by blocking keys, then rounds of locally dominant pairs.

Pairs of a group are ordered by similarity, then by the two numbers, so no two are equal. A pair that is
the best of both its ends is taken by the greedy order too, whatever else there is: nothing before it can use either end. So all such
pairs are taken at once, their ends leave, and what is left is another round (Preis, 1999). The result is that
of going through all pairs of a group in order, with joins and aggregates over rows instead of one list a group.

Groups of up to ``SWEEP`` pairs that are left are gone through in order in one task each: most pages are that small, and
a chain of pairs each slightly better than the next, which rounds shorten by a pair at a time, ends there too.

Rows are copied once a block. Where each group lies in one task already, ``by_group`` keeps those copies there, so they are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.stages import discard, materialize, replaceable, small_side

SWEEP = 2000
#: Gives rows once for each of their blocks, which is in a column ``_block``.
Blocks = Callable[[DataFrame], DataFrame]


@contextmanager
def by_group(spark: SparkSession) -> Iterator[None]:
    """Joins that are run within the block leave rows that lie by group (a window, a ``repartition``) where they are; else each (group, block) is shuffled."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def candidates(pred: DataFrame, ref: DataFrame, group: str, number: str, blocks: Column | tuple[Blocks, Blocks], similarity: Column, threshold: float, likely: Column | None = None) -> DataFrame:
    """Rows (group, pred, ref, score) of pairs in one group that share a block and are similar by ``threshold`` at least.

    ``blocks`` is an array of keys, over the columns of either table; ``similarity`` is over both,
    named ``p.<column>`` and ``r.<column>``. A pair that shares several blocks is made in the least of them. Two functions, of ``pred`` and
    of ``ref``, give rows once a block, in a column ``_block``; a pair may share one at most, so rows need not carry all. Rows without
    a group, number or block meet nothing, and a null or NaN similarity is none. ``likely``, over both, is what all such pairs meet and is found faster.
    """
    once = isinstance(blocks, tuple)

    def side(rows: DataFrame, name: str, of: Column | Blocks) -> DataFrame:
        rows = rows.filter(F.col(f"`{group}`").isNotNull())
        row = [F.col(f"`{group}`").alias("group"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias(name)]
        if once:
            return of(rows).select(*row, F.col("_block").alias("block"))
        return rows.select(*row, F.array_distinct(F.array_compact(of)).alias(f"{name}_blocks")).withColumn("block", F.explode(f"{name}_blocks"))

    of_pred, of_ref = blocks if once else (blocks, blocks)
    sides = [side(pred, "p", of_pred), side(ref, "r", of_ref)]
    # the hash is only for sorting by one number; it is of the types that both sides compare in
    types = {f.name: f.dataType for f in sides[0].select("group", "block").union(sides[1].select("group", "block")).schema}
    sides = [d.withColumns({c: F.col(c).cast(kind) for c, kind in types.items() if d.schema[c].dataType.simpleString() != kind.simpleString()}).withColumn("hash", F.xxhash64("group", "block")) for d in sides]
    both = sides[0].join(sides[1], ["hash", "group", "block"])
    if likely is not None:
        both = both.filter(likely)
    if not once:
        both = both.filter(F.array_min(F.array_intersect("p_blocks", "r_blocks")) == F.col("block"))
    # exploded, so that the similarity is found once, not again in each condition on it
    scored = both.select(F.col("group").alias(group), F.col(f"p.`{number}`").alias("pred"), F.col(f"r.`{number}`").alias("ref"), F.explode(F.array(similarity.cast("double"))).alias("score"))
    return scored.filter((F.col("score") >= threshold) & ~F.isnan("score") & F.col("pred").isNotNull() & F.col("ref").isNotNull())


def matched(rows: DataFrame, pairs: Callable[[DataFrame], DataFrame], group: str, large: DataFrame | None) -> DataFrame:
    """``dominant_match`` of the candidates that ``pairs`` makes of ``rows``, which lie by group. Groups of ``large``, as by ``large_groups``, are spread over tasks by (group, block); their rows also have ``n``."""
    if large is not None:
        spread = materialize(pairs(rows.join(large, group)), "candidates")
        few = pairs(rows.join(large.select(group), group, "left_anti")).unionByName(spread)
    with by_group(rows.sparkSession):
        return dominant_match(pairs(rows) if large is None else few, group)


def large_groups(rows: DataFrame, group: str, most: int) -> DataFrame | None:
    """Rows (group, n) of the groups with more than ``most`` rows, written; None without any."""
    found = materialize(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > most) & F.col(group).isNotNull()), "large")
    return None if found.isEmpty() else small_side(found)


def dominant_match(pairs: DataFrame, group: str, sweep: int = SWEEP) -> DataFrame:
    """One-to-one matches of ``pairs`` (group, pred, ref, score): the best first, then by pred and ref; repeated pairs count once.

    ``pred`` and ``ref`` are whole numbers. Rounds are written, so a lost executor costs a re-read, and the driver sees one count for each.
    """
    spark = pairs.sparkSession
    rows = pairs.select(group, F.col("pred").cast("bigint").alias("pred"), F.col("ref").cast("bigint").alias("ref"), "score").groupBy(group, "pred", "ref").agg(F.max("score").alias("score"))
    left, path = replaceable(rows, "pairs")
    taken: list[DataFrame] = []
    key = F.struct((-F.col("score")).alias("o"), F.col("pred").alias("p"), F.col("ref").alias("r"))
    while True:
        sizes = materialize(left.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > sweep).select(group), "large")
        if sizes.isEmpty():
            break
        large = small_side(sizes)
        small = left.join(large, group, "left_anti")
        taken.append(materialize(_swept(small, group), "matches"))
        left = left.join(large, group, "left_semi")
        best = [left.groupBy(group, end).agg(F.min(key).alias("best")).select(group, F.col("best.p").alias("pred"), F.col("best.r").alias("ref"), (-F.col("best.o")).alias("score")) for end in ("pred", "ref")]
        both = materialize(best[0].join(best[1].drop("score"), [group, "pred", "ref"]), "matches")
        taken.append(both)
        gone = small_side(both)
        rest = left.join(gone.select(group, "pred"), [group, "pred"], "left_anti").join(gone.select(group, "ref"), [group, "ref"], "left_anti")
        spent = path
        left, path = replaceable(rest.select(group, "pred", "ref", "score"), "pairs")
        discard(spark, spent)
    out = _swept(left, group)
    for part in taken:
        out = out.unionByName(part)
    return out


def _swept(pairs: DataFrame, group: str) -> DataFrame:
    """The pairs that are taken when each group's are gone through in order: many groups in one stream, as one by one each would be sent to Python by itself."""
    rows = pairs.select(group, "pred", "ref", "score")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, preds, refs = object(), set(), set()
        for b in batches:
            kept = []
            for k, (g, p, r) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)):
                if not (g == at or g != g and at != at):  # NaN is one group
                    at, preds, refs = g, set(), set()
                if p not in preds and r not in refs:
                    preds.add(p)
                    refs.add(r)
                    kept.append(k)
            yield b.take(pa.array(kept, pa.int64()))

    order = [F.col(group), (-F.col("score")).asc_nulls_last(), F.col("pred"), F.col("ref")]
    return rows.repartition(group).sortWithinPartitions(*order).mapInArrow(sweep, rows.schema)


def dealt(number: Column, parts: Column) -> tuple[Blocks, Blocks]:
    """Blocks of both sides by which every pair of a group meets once: each side is dealt into ``parts`` parts by number, and each part meets each of the other's."""
    own, others = F.pmod(number, parts), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))
    return (
        lambda d: d.withColumn("_part", others).withColumn("_block", own * parts + F.col("_part")).drop("_part"),
        lambda d: d.withColumn("_part", others).withColumn("_block", F.col("_part") * parts + own).drop("_part"),
    )


def centre_cells(x0: Column, y0: Column, x1: Column, y1: Column, iou: float, base: int = 4) -> tuple[Blocks, Blocks]:
    """Blocks of both sides for pairs whose IoU is ``iou`` or more, of which such a pair shares one: a box of ``pred`` has one block, one of ``ref`` some five at 0.4.

    A box of ``pred`` stands in the cell of its centre, in the grid of its level: the power of ``base`` of its longer side, whose cells are no
    smaller than that side. At that IoU the sides of both boxes differ by a factor of ``1 / iou`` at most, and the centres by half of the sum of the sides
    times ``(1 - iou) / (1 + iou)``, or less; so a box of ``ref`` takes the cells within that reach, in the grids of all levels that its partners may have. Their number grows with the square
    of ``1 / iou``; below 0.2 ``cells`` makes fewer. A box without area, or with a side that is no finite number, has none.
    """
    w, h = x1 - x0, y1 - y0
    longer, finite = F.greatest(w, h), lambda v: F.abs(v) < F.lit(float("inf"))
    sound = (w > 0) & (h > 0) & finite(x0) & finite(x1) & finite(y0) & finite(y1) & finite(w) & finite(h)
    slack, grid = 1 + 1e-9, F.col("_level")
    middle_x, middle_y, width = x0 + w / 2, y0 + h / 2, F.pow(F.lit(float(base)), grid + 1)

    def level(side: Column) -> Column:
        return F.floor(F.log(float(base), side)).cast("int")

    def near(a: Column, b: Column, side: Column) -> Column:
        # the last term is for centres that are rounded
        reach = (F.least(side / iou, width * slack) + side) * ((1 - iou) / (1 + iou) / 2 * slack) + (F.abs(a) + F.abs(b)) * 1e-15
        return F.explode(F.sequence(F.floor((a + side / 2 - reach) / width), F.floor((a + side / 2 + reach) / width)))

    def block(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_block", F.struct("_level", "_x", "_y")).drop("_level", "_x", "_y")

    def of_pred(rows: DataFrame) -> DataFrame:
        held = rows.filter(sound).withColumn("_level", level(longer))
        return block(held.withColumns({"_x": F.floor(middle_x / width), "_y": F.floor(middle_y / width)}))

    def of_ref(rows: DataFrame) -> DataFrame:
        held = rows.filter(sound).withColumn("_level", F.explode(F.sequence(level(longer * (iou / slack)), level(longer * (slack / iou)))))
        return block(held.withColumn("_x", near(x0, x1, w)).withColumn("_y", near(y0, y1, h)))

    return of_pred, of_ref


def cells(x0: Column, y0: Column, x1: Column, y1: Column, iou: float, least: float = 16.0) -> Column:
    """Blocks of a box for pairs whose IoU is ``iou`` or more: cells of the grid of its own size and of coarser ones.

    The level of a box is the power of two of its longer side. At that IoU the longer side of the one is no less than ``iou`` times
    the other's, so their levels differ by ``log2(1 / iou)`` at most, and the finer box also takes cells of the coarser box's
    grid. A cell is no smaller than half the box, so a box has some ten blocks a level, however large it is.
    """
    level = F.floor(F.log2(F.greatest(x1 - x0, y1 - y0, F.lit(least)))).cast("int")

    def of(grid: Column) -> Column:
        cell = F.pow(F.lit(2.0), grid)
        across, down = (F.sequence(F.floor(a / cell), F.floor(b / cell)) for a, b in ((x0, x1), (y0, y1)))
        return F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(grid.alias("g"), x.alias("x"), y.alias("y")))))

    return F.flatten(F.transform(F.sequence(level, level + math.ceil(math.log2(1 / iou))), of))
