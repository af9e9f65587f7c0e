"""How filters interact: what each removes under every order, and its Shapley share, by multilinear extension.

Every document fails a set of filters, a mask. The removal polynomial of a part of the corpus is the multilinear

    f(x) = sum over sets T of c(T) prod(x_i, i in T),    c(T) = (-1)^(|T| + 1) * documents that fail all of T,

the number of documents removed when filter i stands with probability x_i. Its corners are what a set of
filters removes, whatever their order: differences of corners along an order are what each step removes. A filter's
Shapley value is the integral of df/dx_i along the diagonal x = (t, ..., t); there the term of T contributes
``c(T) t^(|T| - 1)``, so its integral is the rational c(T) / |T|. Over all ``n!`` orders that is scaled by n!, a whole number.

Only counts by (part, mask) are gathered: texts are read once, in the tasks, and become a mask and a 128-bit
fingerprint. Identical texts meet as counts by (fingerprint, part, labels), so a text that a third of all
documents share is a few rows when it meets.

Defined cases: a null text is empty; a null part is the empty string; documents without a doc_id come neither before nor after
another, so they never fail the filter of repeats, and have no labels; rows that repeat a doc_id with its text do not precede
each other; several labels of a document count as good or toxic when one is; very long texts are split in blocks; an
empty table gives no rows; columns other than doc_id, text and the part's are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.state import materialize
from lectern.llm.words import as_bytes

FILTERS = "ABCDE"
REPEAT = FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
BLOCK = 1 << 20
ROWS = 500
UPPER = bytes(range(65, 91))
SPACES = b" \t\n\v\f\r"


def words_of(text: bytes, block: int = BLOCK) -> tuple[int, int]:
    """Words and distinct words (by case) of a text between ASCII white space."""
    if len(text) <= block:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        end = min(len(text), at + block)
        while end < len(text) and text[end] not in SPACES:
            end += 1
        words = text[at:end].split()
        n, at = n + len(words), end
        seen.update(words)
    return n, len(seen)


def failed(text: bytes, points: int) -> int:
    """The mask of the filters on a text itself: A is bit 0, and so on; ``points`` are its code points."""
    n, distinct = words_of(text)
    upper = len(text) - len(text.translate(None, UPPER))
    marked = len(text) != len(text.translate(None, MARKS))
    return (n < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * points) << 2 | marked << 3


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """Rows (doc_id, part, mask, f): the mask without the filter of repeats, and a fingerprint of the text."""
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # all that the texts are told apart by: 128 bits, so none meet by chance
    rows = rows.select("doc_id", "part", F.unhex(F.md5(F.col("text").cast("binary"))).alias("f"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                points = pc.utf8_length(rows.column(3)).to_pylist()
                masks = [failed(t, n) for t, n in zip(as_bytes(rows.column(3)), points, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(masks, pa.int32())], names=["doc_id", "part", "f", "mask"])

    return rows.mapInArrow(run, f"doc_id {kind}, part string, f binary, mask int")


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each part that fail just the filters of ``mask``."""
    rows = materialize(masked(docs, part), "masks")
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = labels.filter("doc_id is not null").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = rows.filter("doc_id is not null").join(told, "doc_id", "left")
    # both by doc_id first: one exchange, and no key that many rows share but a doc_id's own
    by_id = known.groupBy("doc_id", "f", "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))).agg(F.count(F.lit(1)).alias("n"))
    met = by_id.groupBy("f", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    met = materialize(met, "texts")
    least = met.groupBy("f").agg(F.min("first.doc_id").alias("least"), F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all")).filter("all > 1").select("f", "least")
    held = met.join(least, "f", "left")
    stays = F.when(F.col("least").isNull(), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    repeat = F.lit(1 << REPEAT)
    each = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("stays").alias("n")), F.struct(F.col("mask").bitwiseOR(repeat).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    split = held.withColumn("stays", stays).select("part", "good", "toxic", each.alias("e")).select("part", "e.mask", "e.n", "good", "toxic").filter("n > 0")
    alone = rows.filter("doc_id is null").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"))
    every = split.unionByName(alone.select("part", "mask", "n", F.lit(False).alias("good"), F.lit(False).alias("toxic")))
    given = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), given("good").alias("good"), given("toxic").alias("toxic"))


def polynomials(counts: DataFrame) -> DataFrame:
    """Rows (part, total, c): ``c`` is a map from a set T of filters, as a mask above 0, to the coefficients (n, good, toxic) of its term."""
    every = 1 << len(FILTERS)
    subsets = F.filter(F.sequence(F.lit(0), F.lit(every - 1)), lambda t: t.bitwiseAND(F.col("mask")) == t)
    sums = counts.select("part", F.explode(subsets).alias("t"), "n", "good", "toxic").groupBy("part", "t").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    sign = F.when(F.bit_count("t") % 2 == 1, F.lit(1)).otherwise(F.lit(-1))
    term = F.struct("t", F.struct(*((sign * F.col(c)).alias(c) for c in ("n", "good", "toxic"))).alias("c"))
    # the documents that fail all filters of the empty set are all
    return sums.groupBy("part").agg(F.max(F.when(F.col("t") == 0, F.col("n"))).alias("total"), F.map_from_entries(F.collect_list(F.when(F.col("t") > 0, term))).alias("c"))


def corners(c: Column, what: str) -> Column:
    """The polynomial's value at every corner, by the corner's mask: the sum of the terms that lie within it."""
    terms = F.map_entries(c)
    value = lambda s: F.aggregate(F.filter(terms, lambda e: e["key"].bitwiseAND(s) == e["key"]), F.lit(0).cast("bigint"), lambda a, e: a + e["value"][what])
    return F.transform(F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1)), value)


def shapley(c: Column, i: int) -> Column:
    """The scaled Shapley value of filter ``i``: the diagonal integral of its derivative, exact, times the number of orders."""
    integrals = {size: Fraction(1, size) * factorial(len(FILTERS)) for size in range(1, len(FILTERS) + 1)}  # of t^(size - 1) over 0..1
    terms = F.filter(F.map_entries(c), lambda e: e["key"].bitwiseAND(F.lit(1 << i)) != 0)
    scale = F.array(*(F.lit(int(v)) for v in integrals.values()))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, e: a + e["value"]["n"] * F.element_at(scale, F.bit_count(e["key"])))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    whole = polynomials(mask_counts(docs, labels, part))
    at = whole.select("part", "total", *(corners(F.col("c"), k).alias(k) for k in ("n", "good", "toxic")), F.array(*(shapley(F.col("c"), i) for i in range(len(FILTERS)))).alias("shares"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = at.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    bit = lambda k: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {k}, 1)) - 1)")
    before = sum((F.when(F.col("step") > k, bit(k)).otherwise(F.lit(0)) for k in range(1, len(FILTERS))), F.lit(0))
    steps = steps.withColumn("i", letter).withColumn("bit", bit("step")).withColumn("before", before)
    value = lambda k, mask: F.element_at(k, (mask + 1).cast("int"))
    after, all_ = F.col("before") + F.col("bit"), (1 << len(FILTERS)) - 1
    here = lambda k: value(k, after) - value(k, F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - value("n", after)).alias("kept"),
        here("n").alias("removed"),
        (value("n", F.col("bit")) - here("n")).alias("redundant"),
        (value("n", F.lit(all_)) - value("n", F.lit(all_) - F.col("bit"))).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("i") + 1).alias("shapley"),
    )
