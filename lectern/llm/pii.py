"""Personal data: overlapping candidates judged by boosted trees (DataFrame functions only).

Four base kinds have fixed patterns and validators; their spans always stand.
In the rest of the text, high-recall generators propose overlapping number-like,
local-number and at-like spans. Each candidate has a few discrete format and context features;
gradient-boosted trees of depth two score it, and a candidate is added when its
score reaches the threshold that gave precision ``PRECISION`` on samples that were
not fitted, by a bound on the precision that is lower the fewer they are.

Positives are what the base patterns do not define: addresses with the signs spelt
out, numbers in local and international writing without a plus, and identity numbers, in
made lines with and without a word that announces them (``samples``). Negatives are made
lines of dates, versions, times, prices and order numbers, and every candidate outside base spans in all
documents; personal data in forms of its own in these documents
so counts against itself, which costs recall and not precision. As features are discrete, their table of
counts is all that fitting needs: one aggregate over the whole table, bounded by the feature levels. There are as many made lines
for any table, so the counts of documents are scaled to ``BASIS`` documents when there are more of them: what is
found in a text does not depend on how many others there are. The trees become nested CASE expressions.

Defined cases: null and empty texts have no spans; overlapping base spans of
different kinds all stand; an added span overlaps no base span; added spans may overlap
each other; with nothing to fit on nothing is added; repeated rows are judged alike; other columns do not
matter to ``report`` and are carried along by ``redact``; any number of spans in a text takes time in proportion.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.spans import joined, let, matches, rewrite, tagged

# Fixed patterns, in forms that stay linear on long runs: a match starts at the start of its run
# or where the last one ended, and a card's chain of digits is bounded by what can pass.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"[0-9(](?<![A-Za-z0-9].)[0-9().\x20/-]{5,28}[0-9](?![A-Za-z0-9])"
LOCAL = r"\([0-9]{2,5}\)[0-9().\x20/-]{4,20}[0-9](?![A-Za-z0-9])"
AT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){0,6}"
KINDS = ("email", "ip", "card", "phone")
#: Words that announce personal data and words that announce other numbers, by the end of what stands before.
CUES = r"(?i)(?:phone|mobile|cell|call|tel|fax|mail|reach|contact|ssn|social)[^A-Za-z0-9]*(?:me|us|is|at|on|no|number)?[^A-Za-z0-9]*\z"
OTHERWISE = r"(?i)(?:order|invoice|version|release|date|since|page|isbn|part|price|total|no|model|from|in|on)[^A-Za-z0-9]*\z"
BASIS, MADE, TREES, RATE, PRECISION = 20_000, 4_000, 16, 0.5, 0.995
FEATURES = ("at", "digits", "groups", "first_group", "last_group", "paren", "dots", "slashes", "zeros", "cue", "length")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass the Luhn check."""
    digits = F.reverse(F.filter(F.split(match, ""), lambda c: c.rlike("[0-9]")))
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def base_spans(text: Column) -> dict[str, Column]:
    """Validated spans of the four kinds."""
    parts = lambda s: F.split(s["match"], r"\.")
    return {
        "email": matches(text, EMAIL, text.contains("@")),
        "ip": F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(parts(s), lambda p: p.cast("double") <= 255)),
        "card": F.filter(matches(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda s: luhn(s["match"])),
        "phone": F.filter(matches(text, PHONE), lambda s: _digits(s["match"]).between(9, 15)),
    }


def _features(s: Column) -> Column:
    """Discrete features of a candidate: small integers."""
    m = s["match"]
    count = lambda kept, most: F.least(F.lit(most), F.length(F.regexp_replace(m, f"[^{kept}]", "")))
    groups = F.split(F.regexp_replace(m, r"^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    return F.struct(
        F.when(m.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]"), 2).when(m.contains("@"), 1).otherwise(0).alias("at"),
        F.least(F.lit(20), _digits(m)).alias("digits"),
        F.least(F.lit(6), F.size(groups)).alias("groups"),
        F.least(F.lit(6), F.length(groups[0])).alias("first_group"),
        F.least(F.lit(6), F.length(F.element_at(groups, -1))).alias("last_group"),
        count("()", 2).alias("paren"),
        count(".", 4).alias("dots"),
        count("/", 2).alias("slashes"),
        F.length(F.regexp_extract(m, r"^[^0-9]*(0{0,2})", 1)).alias("zeros"),
        F.when(s["before"].rlike(CUES), 2).when(s["before"].rlike(OTHERWISE), 0).otherwise(1).alias("cue"),
        F.least(F.lit(8), F.floor(F.length(m) / 4)).cast("int").alias("length"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with base spans by kind and ``wide``, the candidates in what these leave."""
    rows = docs.withColumns(base_spans(F.col("text")))
    base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(KINDS)))
    # a base span becomes as many characters that no candidate holds
    rest = rewrite(F.col("text"), base, lambda kind, n: F.repeat(F.lit("\x00"), n.cast("int")))
    return rows.withColumn("wide", let(rest, lambda t: F.array_distinct(F.concat(matches(t, NUMBER), matches(t, LOCAL), matches(t, AT, t.contains("@") | t.contains("(at)") | t.contains("[at]"))))))


def samples(spark: SparkSession, n: int = MADE) -> DataFrame:
    """Made lines (text, hit): ``n`` times each form, with parts drawn by hashes of the line's number."""
    draw = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    num = lambda k, digits: F.lpad(draw(k, 10**digits).cast("string"), digits, "0")
    pick = lambda k, *options: F.get(F.array(*(F.lit(o) for o in options)), draw(k, len(options)))
    first = lambda k: (draw(k, 9) + 1).cast("string")
    name = lambda k: F.substring(F.translate(F.md5(F.xxhash64("id", F.lit(k)).cast("string")), "0123456789", "ghijklmnop"), F.lit(1), draw(k + 50, 8) + 3)
    told = pick(1, "", "", "phone ", "call me at ", "Tel: ", "mobile number: ", "fax ", "contact us on ")
    mail = pick(1, "", "", "mail ", "contact me at ", "E-mail: ", "reach us at ")
    other = pick(1, "", "", "order ", "version ", "on ", "since ", "page ", "total: ", "invoice no ", "model ", "ISBN ")
    gap, mark = pick(2, " ", "-", " ", "."), pick(3, " (at) ", "(at)", " [at] ", "[at]")
    dot = F.when(mark.startswith(" "), pick(4, " (dot) ", " [dot] ")).otherwise(pick(4, "(dot)", "[dot]"))
    positive = (
        (mail, F.concat(name(5), mark, name(6), dot, pick(7, "com", "org", "net", "de"))),
        (mail, F.concat(name(5), F.lit("."), name(8), mark, name(6), dot, pick(7, "com", "org", "co.uk"))),
        (told, F.concat(F.lit("("), first(9), num(10, 2), F.lit(") "), num(11, 3), F.lit("-"), num(12, 4))),
        (told, F.concat(F.lit("(0"), first(9), num(10, 2), F.lit(") "), num(11, 3), F.lit(" "), num(12, 4))),
        (told, F.concat(F.lit("00"), first(9), num(10, 1), gap, num(11, 3), gap, num(12, 4), gap, num(13, 2))),
        (pick(1, "phone ", "call me at ", "Tel: ", "mobile number: ", "fax "), F.concat(first(9), num(10, 2), gap, num(11, 3), gap, num(12, 4))),
        (pick(1, "SSN ", "social: ", "ssn: "), F.concat(first(9), num(10, 2), F.lit("-"), num(11, 2), F.lit("-"), num(12, 4))),
    )
    negative = (
        (other, F.concat(F.lit("20"), num(9, 2), F.lit("-"), num(10, 2), F.lit("-"), num(11, 2))),
        (other, F.concat(num(9, 2), pick(2, "/", "."), num(10, 2), pick(2, "/", "."), F.lit("19"), num(11, 2))),
        (other, F.concat(num(9, 2), F.lit("."), num(10, 2), F.lit("."), num(11, 4), F.lit("-"), num(12, 1))),
        (other, F.concat(first(9), num(10, 3), pick(2, " ", "-", "/"), num(11, 4), pick(3, "", "-1", " 2"))),
        (other, num(9, 9)),
        (other, F.concat(first(9), num(10, 7), num(11, 8))),
        (other, F.concat(num(9, 4), F.lit(" "), num(10, 4), F.lit(" "), num(11, 4), F.lit(" "), num(12, 4))),
        (other, F.concat(F.lit("978-"), first(9), F.lit("-"), num(10, 2), F.lit("-"), num(11, 6), F.lit("-"), num(12, 1))),
        (other, F.concat(num(9, 3), F.lit("."), num(10, 3), F.lit("."), num(11, 3), F.lit("."), num(12, 3), F.lit("0"))),
        (pick(1, "", "see ", "thanks "), F.concat(name(5), F.lit(" @"), name(6))),
        (other, F.concat(F.lit("("), num(9, 4), F.lit(") "), num(10, 1), F.lit("."), num(11, 2), F.lit("/"), num(12, 2))),
    )
    lines = [F.struct(F.concat(F.lit("x "), told, value, F.lit(" y")).alias("text"), F.lit(hit).alias("hit")) for hit, forms in ((True, positive), (False, negative)) for told, value in forms]
    return spark.range(1, n + 1).select("id", F.explode(F.array(*lines)).alias("s")).select(F.col("id").alias("doc_id"), "s.text", "s.hit")


def fit(counts: list[tuple[tuple[int, ...], int, float]], trees: int = TREES, rate: float = RATE) -> list[tuple]:
    """Boosted depth-two trees over (features, positives, negatives); logistic loss, Newton leaves.

    A tree is (feature, cut, low, high), each side (feature, cut, value up to the cut, value above).
    """
    x = np.array([c[0] for c in counts])
    pos, neg = (np.array([c[k] for c in counts], float) for k in (1, 2))
    score, model = np.zeros(len(x)), []
    gain = lambda g, h: g * g / (h + 1.0)
    leaf = lambda g, h, rows: round(float(rate * g[rows].sum() / (h[rows].sum() + 1.0)), 6)

    def best(g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, int]:
        """The split (feature, cut) of some rows that gains most, the first of equals; (-1, 0) without any."""
        found, top = (-1, 0), 1e-9
        for k in range(x.shape[1]):
            sums = [np.cumsum(np.bincount(x[rows, k], v[rows]))[:-1] for v in (g, h)]
            gains = gain(*sums) + gain(g[rows].sum() - sums[0], h[rows].sum() - sums[1]) - gain(g[rows].sum(), h[rows].sum())
            if len(gains) and gains.max() > top:
                found, top = (k, int(gains.argmax())), gains.max()
        return found

    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
        k, c = best(g, h, np.arange(len(x)))
        if k < 0:
            break
        branches = []
        for rows in (np.flatnonzero(x[:, k] <= c), np.flatnonzero(x[:, k] > c)):
            j, d = best(g, h, rows)
            under = x[rows, j] <= d if j >= 0 else np.ones(len(rows), bool)
            values = leaf(g, h, rows[under]), leaf(g, h, rows[~under])
            score[rows] += np.where(under, *values)
            branches.append((max(j, 0), d if j >= 0 else 10**6, *values))
        model.append((k, c, *branches))
    return model


def predict(model: list[tuple], x: tuple[int, ...]) -> float:
    """The score of one feature vector."""
    total = 0.0
    for k, c, low, high in model:
        j, d, a, b = low if x[k] <= c else high
        total += a if x[j] <= d else b
    return total


def train(docs: DataFrame, precision: float = PRECISION, made: int = MADE, basis: int = BASIS) -> tuple[list[tuple], float]:
    """(trees, threshold); the threshold is infinite when no score is that precise. Trees are fitted to one half of the rows, the threshold to the other."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(False).alias("hit"), F.lit(False).alias("made"))
    rows = rows.unionByName(samples(docs.sparkSession, made).withColumn("made", F.lit(True))) if made else rows
    # rows without a doc_id are told apart by their texts
    half = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")), F.lit(1)), F.lit(2)) == 0
    told = candidates(rows).select(half.alias("fitting"), "hit", "made", F.posexplode_outer(F.transform("wide", _features)).alias("i", "x"))
    own = ~F.col("made")
    sums = (F.count_if("hit").alias("pos"), F.count_if(~F.col("hit") & F.col("made")).alias("neg"), F.count_if(own).alias("own"), F.count_if(own & (F.coalesce("i", F.lit(0)) == 0)).alias("docs"))
    table = told.groupBy("fitting", "x").agg(*sums).collect()
    weight = min(1.0, basis / max(1, sum(r["docs"] for r in table)))
    counts = sorted((tuple(r["x"]), r["pos"], r["neg"] + weight * r["own"], r["fitting"]) for r in table if r["x"])
    fitted = [c[:3] for c in counts if c[3]]
    model = fit(fitted) if fitted else []
    held: dict[float, list[float]] = {}
    for x, pos, neg, fitting in counts:
        if not fitting:
            cell = held.setdefault(round(predict(model, x), 6), [0, 0])
            cell[0] += pos
            cell[1] += neg
    return model, calibrated(held, precision)


def calibrated(held: dict[float, list[float]], precision: float = PRECISION) -> float:
    """The least score from which on the precision is ``precision`` at least, as far as (positives, negatives) by score can tell.

    The share of positives is taken as if one more negative had been seen, so few samples never suffice.
    """
    threshold, pos, neg = math.inf, 0, 1
    for s in sorted(held, reverse=True):
        pos, neg = pos + held[s][0], neg + held[s][1]
        if pos >= precision * (pos + neg):
            threshold = s
    return threshold


def _score(model: list[tuple], x: Column) -> Column:
    """The trees as one expression."""

    def leaf(j: int, d: int, a: float, b: float) -> Column:
        return F.when(x[FEATURES[j]] <= d, a).otherwise(F.lit(b))

    total = F.lit(0.0)
    for k, c, low, high in model:
        total = total + F.when(x[FEATURES[k]] <= c, leaf(*low)).otherwise(leaf(*high))
    return F.round(total, 6)


def detect(docs: DataFrame, model: list[tuple], threshold: float) -> DataFrame:
    """``docs`` with SPAN arrays email, ip, card, phone and other."""
    found = candidates(docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    if not model or math.isinf(threshold):
        return found.withColumn("other", F.filter("wide", lambda s: F.lit(False))).drop("wide")
    kept = F.filter("wide", lambda s: let(_features(s), lambda x: _score(model, x)) >= threshold)
    # two generators may propose the same span
    return found.withColumn("other", F.array_distinct(F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["match"])))).drop("wide")


def report(docs: DataFrame, model: list[tuple], threshold: float) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other), one per row of ``docs``."""
    found = detect(docs.select("doc_id", "text"), model, threshold)
    base = F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate(KINDS)))
    every = F.concat(base, tagged(F.col("other"), "other", len(KINDS)))
    count = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    found = found.withColumn("base", base).withColumn("every", every)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(count(k) for k in KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), count("other"))


def redact(docs: DataFrame, model: list[tuple], threshold: float) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans by the first one's."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text"))  # so that no column of docs can clash
    found = detect(whole, model, threshold)
    spans = F.array_sort(F.concat(*(tagged(F.col(k), k, i) for i, k in enumerate((*KINDS, "other")))))
    new = rewrite(F.col("text"), spans, lambda kind, n: F.coalesce(F.concat(F.lit("["), F.upper(kind), F.lit("]")), F.lit("")))
    return found.withColumn("text", F.when(F.size(spans) > 0, new).otherwise(F.col("row.text"))).select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
