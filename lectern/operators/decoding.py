"""CTC decoding of logits: long rows (crop_id, t, class, v), class 0 blank.

The softmax runs over all classes, ignored ones included; ignored classes are
then left out and the rest renormalised. Confidence uses all non-blank steps
before collapse: product to the power 2 / sqrt(n).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.stages import small_side

#: An extension below this share of a uniform step is not tried.
SCORE_FLOOR = 0.5


def probabilities(logits: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """``logits`` with p; rows of ``ignored`` (class) are left out and the rest renormalised."""
    step = Window.partitionBy("crop_id", "t")
    e = logits.withColumn("e", F.exp(F.col("v") - F.max("v").over(step))).withColumn("p", F.col("e") / F.sum("e").over(step)).drop("e")
    if ignored is None:
        return e
    kept = e.join(small_side(ignored.select("class").distinct()), "class", "left_anti")
    return kept.withColumn("p", F.col("p") / F.sum("p").over(step))


def best_classes(p: DataFrame) -> DataFrame:
    """Rows (crop_id, t, class, p): the likeliest class of each step, the smallest on ties."""
    best = p.groupBy("crop_id", "t").agg(F.min(F.struct((-F.col("p")).alias("o"), F.col("class"))).alias("b"))
    return best.select("crop_id", "t", F.col("b.class").alias("class"), (-F.col("b.o")).alias("p"))


def ignored_classes(charset: DataFrame, allow: str = "", block: str = "") -> DataFrame:
    """Classes to leave out: those outside a non-empty ``allow``, else those in ``block``; never the blank."""
    listed = F.instr(F.lit(allow or block), F.col("ch")) > 0
    return charset.filter("class > 0").filter(~listed if allow else listed if block else F.lit(False)).select("class")


def collapse(steps: DataFrame, key: str, order: str, value: str, blank=0) -> DataFrame:
    """Steps that differ from the step before (blanks count) and are not blank."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    kept = steps.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(value)))
    return kept.filter(F.col(value) != F.lit(blank)).drop("before")


def confidence(steps: DataFrame) -> DataFrame:
    """Rows (crop_id, confidence) of best classes; 0 when all steps are blank."""
    n = F.sum(F.when(F.col("class") != 0, 1).otherwise(0))
    logs = F.sum(F.when(F.col("class") != 0, F.ln("p")).otherwise(0.0))
    return steps.groupBy("crop_id").agg(F.when(n > 0, F.exp(logs * 2 / F.sqrt(n))).otherwise(F.lit(0.0)).alias("confidence"))


def greedy_decode(logits: DataFrame, charset: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """Rows (crop_id, text, confidence); a crop whose steps are all ignored has an empty text and 0."""
    steps = best_classes(probabilities(logits, ignored))
    text = collapse(steps, "crop_id", "t", "class").join(charset, "class").groupBy("crop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ch"))), lambda x: x["ch"]), "").alias("text"))
    crops = logits.select("crop_id").distinct()
    out = crops.join(confidence(steps), "crop_id", "left").join(text, "crop_id", "left")
    return out.select("crop_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def retry(first: DataFrame, second: DataFrame, below: float = 0.1) -> DataFrame:
    """Results (crop_id, text, confidence): a crop under ``below`` takes the second pass if that is at least as sure."""
    again = second.select("crop_id", F.col("text").alias("t2"), F.col("confidence").alias("c2"))
    take = (F.col("confidence") < below) & (F.col("c2") >= F.col("confidence"))
    joined = first.join(again, "crop_id", "left")
    return joined.select("crop_id", F.when(take, F.col("t2")).otherwise(F.col("text")).alias("text"), F.when(take, F.col("c2")).otherwise(F.col("confidence")).alias("confidence"))


def beam_labels(steps: list[list[float]], width: int) -> list[int]:
    """Prefix beam search over one crop's probability rows.

    A prefix carries its mass by whether it ends in a blank. At each step the
    ``width`` heaviest prefixes (ties by label) go on: each keeps its label, and is
    extended by every class that is likely enough, the blank among them. A blank
    stays in a label only between two equal classes.
    """
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, 1.0)}
    heaviest = lambda b: sorted(b, key=lambda k: (-(b[k][0] + b[k][1]), k))
    for row in steps:
        after: dict[tuple[int, ...], list[float]] = {}
        for label in heaviest(beams)[:width]:
            solid, blank = beams[label]
            kept = after.setdefault(label, [0.0, 0.0])
            kept[0] += solid * row[label[-1]] if label else 0.0
            kept[1] += (solid + blank) * row[0]
            for c, p in enumerate(row):
                if p >= SCORE_FLOOR / len(row):
                    longer = after.setdefault(_extended(label, c), [0.0, 0.0])
                    longer[0] += p * (blank if label and label[-1] == c else solid + blank)
        beams = {k: (a, b) for k, (a, b) in after.items()}
    return list(heaviest(beams)[0])


def _extended(label: tuple[int, ...], c: int) -> tuple[int, ...]:
    last = label[-1] if label else 0
    if c == 0:
        return label if last == 0 else (*label, 0)
    if label and last == 0 and label[-2:-1] != (c,):
        return (*label[:-1], c)
    return (*label, c)


def beam_decode(logits: DataFrame, charset: DataFrame, width: int = 5, ignored: DataFrame | None = None) -> DataFrame:
    """Rows (crop_id, text, confidence): text by beam search, confidence as for greedy decoding."""
    p = probabilities(logits, ignored)
    wide = logits.select("crop_id", "t", "class").join(p.select("crop_id", "t", "class", "p"), ["crop_id", "t", "class"], "left")
    rows = wide.groupBy("crop_id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("class", F.coalesce("p", F.lit(0.0)).alias("p")))), lambda x: x["p"]).alias("row"))
    crops = rows.groupBy("crop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "row"))), lambda x: x["row"]).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels = [[c for c in beam_labels([list(r) for r in rows], width) if c] for rows in pdf["rows"]]
            yield pd.DataFrame({"crop_id": pdf["crop_id"], "labels": labels})

    found = crops.mapInPandas(run, "crop_id bigint, labels array<int>")
    spelt = found.select("crop_id", F.posexplode("labels").alias("t", "class")).join(charset, "class").groupBy("crop_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "ch"))), lambda x: x["ch"]), "").alias("text"))
    out = found.select("crop_id").join(spelt, "crop_id", "left").join(confidence(best_classes(p)), "crop_id", "left")
    return out.select("crop_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
