"""Spans of pattern matches in texts, with DataFrame functions only.

A regular expression's leftmost non-overlapping matches and their places come
from two passes of one expression: the matches themselves and the pieces of
text between them. Places are in code points, ends exclusive.

An array that grows by one element a step is copied at each step, so whatever is
folded is folded in blocks of ``BLOCK`` elements that know where they begin, and
texts are cut in pieces of ``PIECE`` code points before parts are taken out of them: the
work of a text with any number of matches is in proportion to both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, PIECE = 128, 2048
SPAN = "array<struct<start:bigint,end:bigint,match:string,before:string>>"
#: Characters before a match, back to the match before it at most, that are kept with it.
BEFORE = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """``items`` in arrays of ``BLOCK``."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK))))


def _placed(steps: Column) -> Column:
    """SPAN of a non-empty array<struct<gap, hit>>."""
    size = lambda s: F.length(s).cast("bigint")
    nothing = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + size(x["gap"])
        end = begin + size(x["hit"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("match"), F.substring(x["gap"], -BEFORE, BEFORE).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def whole(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, x: n + size(x["gap"]) + size(x["hit"])))
        return F.flatten(F.zip_with(blocks, _before(sizes, lambda a, n: a + n), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])))

    return let(_blocks(steps), whole)


def _before(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """For each value of a short array (bigint) what ``join`` makes of 0 and all values before it."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, n: F.struct(join(acc["at"], n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def matches(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """array<struct<start, end, match, before>> of ``pattern`` in ``text``; empty for null.

    ``needs`` is a cheaper condition that holds for every text with a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = lambda hits: F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = let(found, lambda hits: F.zip_with(gaps(hits), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit"))))
    # most texts have no match: they are told by one test that stops at the first
    some = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(some, let(steps, _placed)).otherwise(F.array().cast(SPAN))


def tagged(spans: Column, kind: str, order: int) -> Column:
    """array<struct<start, rank, kind, end>>: ``spans`` under a kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as ranked, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def rewrite(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``tagged`` spans replaced.

    What several spans cover is replaced once: the first span by ``instead(kind, length)``, what
    a later one adds by ``instead(null, length)``.
    """
    part = "array<struct<rank:bigint,to:bigint,kind:string,end:bigint>>"

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(acc["at"].alias("rank"), F.greatest(acc["at"], s["start"]).alias("to"), F.when(s["start"] >= acc["at"], s["kind"]).alias("kind"), s["end"].alias("end"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def parts(blocks: Column) -> Column:
        """What is kept and replaced in turn: text from ``rank`` to ``to``, then a replacement up to ``end``."""
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        return F.flatten(F.zip_with(blocks, _before(ends, F.greatest), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(part).alias("out")), step, lambda acc: acc["out"])))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` of the text in ``pieces``."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        first, rest = (a % PIECE).cast("int"), (b % PIECE).cast("int")
        across = F.concat(F.substring(piece(i), first + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(piece(j), F.lit(1), rest))
        return F.when(b <= a, "").when(i == j, F.substring(piece(i), first + 1, rest - first)).otherwise(across)

    def made(held: Column) -> Column:
        p, pieces = held["p"], held["pieces"]
        body = F.array_join(F.transform(p, lambda x: F.concat(cut(pieces, x["rank"], x["to"]), instead(x["kind"], x["end"] - x["to"]))), "")
        return F.concat(body, cut(pieces, F.element_at(p, -1)["end"], F.length(text).cast("bigint")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = let(F.struct(let(_blocks(F.array_sort(spans)), parts).alias("p"), pieces.alias("pieces")), made)
    return F.when(F.size(spans) > 0, whole).otherwise(text)
