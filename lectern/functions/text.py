"""Text expressions: tokens, normalisation, error rates, bags, small formats."""

from __future__ import annotations

import functools
import itertools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters without visible content, and the CJK ranges that expand to bigrams.
INVISIBLE = "​‌‍﻿­"
#: White space of every script, the separators of records included.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
CJK = "一-鿿㐀-䶿぀-ヿ가-힣豈-﫿"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no expression for it."""
    import unicodedata

    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


@functools.lru_cache(maxsize=1)
def _unsettled() -> str:
    """A character class that holds all that composition can change, and a little more where it is dense: made by rule."""
    import unicodedata

    ranges: list[list[int]] = []
    for c in itertools.chain(range(0x80, 0xD800), range(0xE000, 0x30000)):
        if unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c) or 0x1160 <= c < 0x1200:
            if ranges and c - ranges[-1][1] <= 48:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def composed(text: Column) -> Column:
    """``text`` in NFKC; only texts that may change go to Python."""
    # most characters are told by two ranges, before the class of many
    some = text.rlike(rf"[\xa0-\xbf\x{{100}}-\x{{10ffff}}&&{_unsettled()}]")
    return F.coalesce(nfkc(F.when(some, text)), text)


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """Non-empty pieces between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def cjk_bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; a run of one stays."""
    return F.when(F.length(run) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array(run))


def runs(token: Column) -> Column:
    """Maximal CJK and other runs of a token, in order."""
    return F.regexp_extract_all(token, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))


def plain(text: Column) -> Column:
    """What scoring tokens are cut from: NFKC, lower case, bars as spaces."""
    return F.replace(F.lower(F.translate(composed(text), INVISIBLE, "")), F.lit("|"), F.lit(" "))


def cut(plain: Column) -> Column:
    """Words of ``plain`` text, CJK runs as bigrams."""
    split = words(plain)
    expanded = F.flatten(F.transform(split, lambda w: F.flatten(F.transform(runs(w), lambda r: F.when(r.rlike(f"^[{CJK}]"), cjk_bigrams(r)).otherwise(F.array(r))))))
    return F.when(plain.rlike(f"[{CJK}]"), expanded).otherwise(split)


def tokens(text: Column) -> Column:
    """Scoring tokens: NFKC, lower case, bars as spaces, CJK runs as bigrams."""
    return cut(plain(text))


def char_bag(text: Column) -> Column:
    """Lower-case characters that are not white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), SPACE, ""), ""), lambda c: c != "")


def normalize_text(text: Column) -> Column:
    """Text without light markup: line-break tags, bullets, markup characters; one space between words; lower case."""
    for pattern in (rf"(?i)<br{SPACE}*/?>", rf"(?md)^{SPACE}*(?:[-+•]|\p{{Nd}}+[.)]){SPACE}+", r"[#|*`_>]", f"{SPACE}+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.lower(F.trim(text))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over reference length; null for an empty reference."""
    return F.when(F.length(reference) > 0, F.levenshtein(hypothesis, reference) / F.length(reference))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """The same over words: each distinct word of the pair stands as one character."""
    a, b = words(reference), words(hypothesis)
    known = F.array_distinct(F.concat(a, b))

    def coded(w: Column) -> Column:
        # code points above the surrogates, so one character each
        return F.array_join(F.transform(w, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, x) + 0x10000), 8, "0")), "UTF-32")), "")

    return F.when(F.size(a) > 0, F.levenshtein(coded(b), coded(a)) / F.size(a))


def f1_parts(matched: Column, n_pred: Column, n_ref: Column) -> Column:
    """struct<f1, precision, recall>: 1 when both sides are empty, 0 when one is."""
    p, r = matched / n_pred, matched / n_ref
    made = F.struct(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"), p.cast("double").alias("precision"), r.cast("double").alias("recall"))
    flat = lambda v: F.struct(F.lit(v).alias("f1"), F.lit(v).alias("precision"), F.lit(v).alias("recall"))
    return F.when((n_pred == 0) & (n_ref == 0), flat(1.0)).when((n_pred == 0) | (n_ref == 0), flat(0.0)).otherwise(made)


def ratio_claim(value: Column, least: float = 1.15) -> Column:
    """A ratio as ``2.3x``; null when too close to parity to be a claim."""
    # as a decimal, halves are rounded up wherever it runs
    return F.when(value >= least, F.concat(value.try_cast("decimal(24,6)").cast("decimal(24,1)").cast("string"), F.lit("x")))


def signed_delta(value: Column) -> Column:
    """``+0.125``, or a dash without a value."""
    figure = F.abs(value.try_cast("decimal(24,6)").cast("decimal(24,3)")).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.when(value < 0, "-").otherwise("+"), figure))


def host_identity(value: Column) -> Column:
    """Trimmed, ``unknown`` if blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))


def page_filename(page: Column, pages: Column) -> Column:
    """``page_007.png``: zero-padded to the page count's width, two digits at least."""
    width = F.greatest(F.lit(2), F.length(pages.cast("string")))
    return F.concat(F.lit("page_"), F.lpad(page.cast("string"), width, "0"), F.lit(".png"))


def runtime_version(tag: Column) -> Column:
    """``rel-1.2.3`` as ``1.2.3``; null unless three numbers."""
    return F.nullif(F.regexp_extract(tag, r"^rel-(\d+\.\d+\.\d+)$", 1), F.lit(""))


def cache_dir(repo: Column) -> Column:
    """``owner/name`` as the folder name of a model cache."""
    return F.concat(F.lit("models--"), F.replace(repo, F.lit("/"), F.lit("--")))


def owner_is_safe(owner: Column) -> Column:
    return owner.rlike(r"^[A-Za-z0-9_-]+$")


def utc_text(seconds: Column) -> Column:
    """Epoch seconds as ISO 8601 in UTC."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def probability(text: Column) -> Column:
    """A number in [0, 1]; null for anything else, NaN included."""
    value = text.try_cast("double")
    return F.when((value >= 0) & (value <= 1) & ~F.isnan(value), value)
