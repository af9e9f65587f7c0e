"""Secret scans by character Markov models (DataFrame functions only).

Base spans are three fixed patterns. In the rest of the text, runs of ``SHORTEST`` or more
``[A-Za-z0-9+/_=-]`` other than plain words are candidates: the whole run, and its parts between
``/ = _ -`` where they say more. A candidate is a secret when a first-order Markov model of random strings explains its
characters so much better than one of ordinary identifiers that, of held-out ordinary
names, only a share of ``FALSE_RATE`` reaches that log-likelihood ratio (and it is ``LEAST`` nats at least).

Both models are transition counts with add-one smoothing over labelled samples
(value, is_random): random ones are derived from digests in the usual
encodings, with and without digits; ordinary ones are words, compounds, dates and numbers of the corpus: of at most
``MAX_SAMPLE`` documents, those with the smallest hash of doc_id. One in ``HELD`` samples (by a hash of its
value) is kept from the counts and calibrates. The fitted table has
128 x 128 entries whatever the corpus, and is one literal of the plan.

Defined cases: null and empty texts have no spans; base spans are never removed
or merged, and what a candidate would share with one is not part of it; repeated rows are
scanned alike; other columns are ignored; an empty corpus leaves ordinary names
with uniform transitions, and then nothing is added; any number of spans in a text takes time in proportion.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.spans import SPAN, joined, let, matches, rewrite, tagged
from lectern.llm.state import materialize

# Fixed pattern of assignments; 6 or more characters of group 2 are asked beside it.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
SHORTEST = 12
# A run that is one plain word, a letter and then lower case only, is no candidate: random strings are not written so.
RUN = rf"(?<![A-Za-z0-9+/_=-])(?![A-Za-z]?[a-z]*+(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
PART = rf"[A-Za-z0-9+]{{{SHORTEST},}}"
MAX_SAMPLE, RANDOM_SAMPLE = 2000, 3000
FALSE_RATE, LEAST, HELD = 1e-4, 10.0, 4
SIZE = 128


def random_samples(spark: SparkSession, n: int = RANDOM_SAMPLE) -> DataFrame:
    """Labelled random strings: digests of 1..n as hex, base64, upper-case alphanumerics and letters alone."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    kinds = F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest)), F.concat(F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 20, 15), 16, 36)), F.regexp_replace(F.base64(F.unhex(F.substring(digest, 1, 48))), "[+/=]", "_"), F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z]", ""))
    return spark.range(1, n + 1).select(F.explode(kinds).alias("value"), F.lit(True).alias("is_random"))


def ordinary_samples(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """Labelled ordinary names: distinct words of sampled documents, alone and in the usual compounds."""
    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample)
    words = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w"))
    words = words.distinct()
    forms = F.array("w", F.upper("w"), F.lower("w"), F.concat(F.lower("w"), F.lit("_"), F.reverse(F.substring(F.lower("w"), 1, 3))), F.concat(F.lower("w"), F.lit("_id=1")), F.concat(F.lower("w"), F.lit("-"), F.lower("w")), F.concat(F.lower("w"), F.lit("/"), F.lower("w")), F.concat(F.initcap("w"), F.initcap("w"), F.lit("2")), F.concat(F.lit("==--__"), "w"), F.date_format(F.timestamp_seconds(F.pmod(F.xxhash64("w"), F.lit(1_700_000_000))), "yyyy-MM-dd'T'HH-mm-ss-SSS"), F.concat(F.lit("000"), F.pmod(F.xxhash64("w"), F.lit(100_000)).cast("string"), F.lit("000000")), F.pmod(F.xxhash64("w"), F.lit(10**17)).cast("string"), F.concat(F.initcap("w"), F.initcap(F.reverse("w")), F.initcap("w")))
    return words.select(F.explode(forms).alias("value"), F.lit(False).alias("is_random"))


def train(samples: DataFrame, alphabet: int = 66, false_rate: float = FALSE_RATE) -> tuple[list[float], float]:
    """(log-likelihood ratio of each transition ``128 * code + next code``, random over ordinary; the least ratio of a secret)."""
    sound = samples.filter("value is not null and is_random is not null and length(value) > 1 and value rlike '^[\\\\x01-\\\\x7F]+$'")
    sound = materialize(sound.select("value", "is_random", (F.pmod(F.xxhash64("value"), F.lit(HELD)) == 0).alias("held")), "samples")
    pairs = sound.filter("not held").select("is_random", F.explode(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))).alias("p"))
    counts = pairs.groupBy("is_random", F.ascii("p").alias("a"), F.ascii(F.substring("p", 2, 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    table = {True: {}, False: {}}
    for r in counts.collect():  # at most 2 x 128 x 128 rows
        table[r["is_random"]][r["a"], r["b"]] = r["n"]
    sums = {k: {} for k in table}
    for k, t in table.items():
        for (a, _), n in t.items():
            sums[k][a] = sums[k].get(a, 0) + n
    log = lambda k, a, b: math.log((table[k].get((a, b), 0) + 1) / (sums[k].get(a, 0) + alphabet))
    model = [round(log(True, a, b) - log(False, a, b), 4) for a in range(SIZE) for b in range(SIZE)]
    reached = sound.filter(f"held and not is_random and length(value) >= {SHORTEST}").agg(F.percentile(ratio(F.col("value"), model), 1 - false_rate).alias("t")).first()["t"]
    return model, math.inf if reached is None else max(LEAST, reached)


def ratio(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of an ASCII string under the fitted table."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    steps = lambda codes: F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, (a * SIZE + b).cast("int")))
    return F.aggregate(let(F.transform(F.split(value, ""), lambda c: F.ascii(c)), steps), F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def scan(docs: DataFrame, model: list[float], least: float) -> DataFrame:
    """Rows (doc_id, assign, access, hex, markov) of SPAN arrays, one per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", matches(F.col("text"), ASSIGN, F.col("text").contains(":") | F.col("text").contains("=")).alias("assign"), matches(F.col("text"), "AKIA[A-Z0-9]{16,}").alias("access"), matches(F.col("text"), "[0-9a-f]{24,}").alias("hex"))
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 6))
    if math.isinf(least):
        return rows.withColumn("markov", F.array().cast(SPAN)).drop("text")
    # a base span becomes as many characters that no candidate holds
    rest = rewrite(F.col("text"), F.concat(*(tagged(F.col(k), k, 0) for k in ("assign", "access", "hex"))), lambda kind, n: F.repeat(F.lit("\x00"), n.cast("int")))
    score = lambda s: ratio(s["match"], model)

    def judged(run: Column) -> Column:
        """The secret spans of a run: the whole if it is one and its secret parts alone do not say more, else these parts."""
        parts = F.filter(matches(run["match"], PART), lambda p: score(p) >= least)
        placed = lambda ps: F.transform(ps, lambda p: F.struct((p["start"] + run["start"]).alias("start"), (p["end"] + run["start"]).alias("end"), p["match"], p["before"]))
        told = lambda ps: F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + score(p))
        either = lambda whole: let(parts, lambda ps: F.when((whole >= least) & (whole >= told(ps)), F.array(run)).otherwise(placed(ps)))
        # a run without separators is its own only part
        return F.when(run["match"].rlike("[/_=-]"), let(score(run), either)).when(score(run) >= least, F.array(run)).otherwise(F.array().cast(SPAN))

    found = let(rest, lambda t: F.flatten(F.transform(matches(t, RUN), judged)))
    return rows.withColumn("markov", found).drop("text")


def report(docs: DataFrame, model: tuple[list[float], float]) -> DataFrame:
    """The scan with what ``train`` gave, as counts and span lists: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)."""
    found = scan(docs, *model)
    base = F.concat(tagged(F.col("assign"), "assign", 1), tagged(F.col("access"), "access", 2), tagged(F.col("hex"), "hex", 3))
    found = found.withColumn("base", base).withColumn("every", F.concat("base", tagged(F.col("markov"), "markov", 4)))
    count = lambda c: F.size(c).cast("bigint").alias(f"n_{c}")
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"), count("markov"))
