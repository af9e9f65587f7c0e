"""Run records: assembly by left joins, summaries, ratios, regression gates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.stages import materialize, small_side

#: Samples below which a percentile is not given.
P95_LEAST, P99_LEAST = 20, 100
#: Stripes of a range of values, and values that are few enough to sort.
STRIPES, SORTED = 1000, 10_000
RSS_CEILING, THROUGHPUT_FLOOR, QUALITY_FLOOR = 1.1, 0.9, 0.9


def suppressed_percentile(value: Column, share: float, least: int) -> Column:
    """Linear-interpolation percentile; null under ``least`` values."""
    return F.when(F.count(value) >= least, F.percentile(value, share))


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median, p95, p99, mean and count of the non-null values per key; keys without values have no row, and a percentile of nothing is null."""
    v = F.col(value).cast("double")
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.median(v).alias("median"), suppressed_percentile(v, 0.95, P95_LEAST).alias("p95"), suppressed_percentile(v, 0.99, P99_LEAST).alias("p99"), F.avg(v).alias("mean"), F.count(v).alias("count"))


def range_percentiles(rows: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """Rows (keys, n and a column for each of ``shares``): linear-interpolation percentiles of groups of any size.

    No task holds a group. For each rank that is asked the values between two bounds are counted in ``STRIPES`` stripes; the
    stripe that holds the rank gives the next bounds, its own least and greatest value, until they are equal or at most ``SORTED`` values
    lie between, which are sorted. Null and non-finite values are left out, and keys without others have no row; a null key is a key.
    """
    given, keys = keys, tuple(f"key{i}" for i in range(len(keys)))  # whatever a key is called, it clashes with nothing here
    v = F.col(value).cast("double")
    base = materialize(rows.select(*(F.col(k).alias(name) for k, name in zip(given, keys, strict=True)), v.alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')"), "values")
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("n") - 1)).alias("place")) for name, share in shares.items())))
    asked = materialize(sizes.withColumn("a", asked).select("*", "a.name", "a.place").drop("a"), "asked")
    ranks = asked.select(*keys, "n", "low", "high", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")).distinct()
    open_ = materialize(ranks.select(*keys, "rank", "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("held")), "bounds")
    found: list[DataFrame] = []

    def between(bounds: DataFrame) -> DataFrame:
        named = bounds.withColumnsRenamed({k: f"of_{k}" for k in keys})
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        return base.join(small_side(named), [*same, F.col("v") >= F.col("low"), F.col("v") <= F.col("high")]).drop(*(f"of_{k}" for k in keys))

    while True:
        done = "low = high"
        found.append(open_.filter(done).select(*keys, "rank", F.col("low").alias("x")))
        few = between(open_.filter(f"not ({done}) and held <= {SORTED}")).groupBy(*keys, "rank", "below").agg(F.array_sort(F.collect_list("v")).alias("l"))
        found.append(few.select(*keys, "rank", F.element_at("l", (F.col("rank") - F.col("below") + 1).cast("int")).alias("x")))
        left = open_.filter(f"not ({done}) and held > {SORTED}")
        if left.isEmpty():
            break
        # halves first, so that the width of the widest range is still a number
        part = (F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        stripe = F.least(F.floor(part * STRIPES), F.lit(STRIPES - 1))
        sums = between(left).groupBy(*keys, "rank", "below", stripe.alias("k")).agg(F.count(F.lit(1)).alias("held"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("below") + F.sum("held").over(Window.partitionBy(*keys, "rank").orderBy("k"))
        here = sums.withColumn("upto", upto).filter("upto > rank").groupBy(*keys, "rank").agg(F.min(F.struct("k", "low", "high", "held", "upto")).alias("s"))
        open_ = materialize(here.select(*keys, "rank", "s.low", "s.high", (F.col("s.upto") - F.col("s.held")).alias("below"), "s.held"), "bounds")
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    every = materialize(every, "ranks")
    out = asked.select(*keys, "n", "name", "place")
    for end, at in (("a", F.floor("place")), ("b", F.ceil("place"))):
        named = every.withColumnsRenamed({k: f"of_{k}" for k in keys}).withColumnRenamed("x", end)
        out = out.join(small_side(named), [*(F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), at == F.col("rank")]).drop("rank", *(f"of_{k}" for k in keys))
    weight = F.col("place") - F.floor("place")
    wide = out.groupBy(*keys, "n").pivot("name", list(shares)).agg(F.first(F.col("a") * (1 - weight) + F.col("b") * weight))
    return wide.withColumnsRenamed(dict(zip(keys, given, strict=True)))


def field_summary(rows: DataFrame, fields: list[str], group: str) -> DataFrame:
    """Summary of each field per group and over all (group null): fields unpivoted, one grouping-sets aggregate."""
    long = rows.select(group, *(F.col(f).cast("double") for f in fields)).unpivot([group], fields, "field", "value").filter("value is not null")
    v = F.col("value")
    sets = long.groupingSets([["field", group], ["field"]], "field", group)
    return sets.agg(F.median(v).alias("median"), suppressed_percentile(v, 0.95, P95_LEAST).alias("p95"), F.avg(v).alias("mean"), F.count(v).alias("count"))


def paired_ratio_median(rows: DataFrame, over: str, under: str, *keys: str) -> DataFrame:
    """Median of per-row ratios; null parts and zero denominators are left out."""
    sound = rows.filter(F.col(over).isNotNull() & F.col(under).isNotNull() & (F.col(under) != 0))
    return sound.groupBy(*keys).agg(F.median(F.col(over) / F.col(under)).alias("ratio"), F.count(F.lit(1)).alias("pairs"))


def reduce_repeats(rows: DataFrame, group: str, repeat: str) -> DataFrame:
    """Repeats of (seconds, rss, cpu) as one row: median time and CPU, highest memory, the last repeat's number."""
    return rows.groupBy(group).agg(F.median("seconds").alias("seconds"), F.max("rss").alias("rss"), F.median("cpu").alias("cpu"), F.max(repeat).alias("last_repeat"))


def throughput(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds)


def warm_per_image(total: Column, build: Column, n: Column) -> Column:
    return F.when(n > 0, F.greatest((total - build) / n, F.lit(0.0)))


def speedup(own_n: Column, own_s: Column, other_n: Column, other_s: Column) -> Column:
    """Ratio of seconds per item, the other's over our own."""
    return F.when((own_n > 0) & (other_n > 0) & (own_s > 0), (other_s / other_n) / (own_s / own_n))


def exact(value: Column) -> Column:
    """A figure with six decimals, halves rounded up, so that comparing and printing agree everywhere; null if not finite."""
    return value.try_cast("decimal(24,6)")


def gate(measured: Column, baseline: Column, same_host: Column, factor: float, above: bool) -> Column:
    """Why a gate fails, in order; null when it holds. A baseline of 0 or less cannot be held against."""
    got, limit = exact(measured), exact(exact(baseline) * F.lit(Decimal(str(factor))))
    breach = got > limit if above else got < limit
    return (
        F.when(baseline.isNull(), "no baseline")
        .when(~F.coalesce(same_host, F.lit(False)), "other host")
        .when(~F.coalesce(exact(baseline) > 0, F.lit(False)), "no positive baseline")
        .when(measured.isNull(), "not measured")
        .when(got.isNull(), "not finite")
        .when(breach, F.concat(got.cast("string"), F.lit(" against "), limit.cast("string")))
    )


def rss_gate(measured: Column, baseline: Column, same_host: Column) -> Column:
    """Memory may not be above the host's own baseline by more than a tenth."""
    return gate(measured, baseline, same_host, RSS_CEILING, True)


def throughput_gate(measured: Column, baseline: Column, same_host: Column) -> Column:
    """Throughput may not be below the host's own baseline by more than a tenth."""
    return gate(measured, baseline, same_host, THROUGHPUT_FLOOR, False)


def threshold_gate(runs: DataFrame, key: str) -> DataFrame:
    """Rows (key, gate, breach) of runs (key, throughput, peak_rss, base_throughput, base_rss, same_host): both gates' breaches."""
    both = F.array(
        F.struct(F.lit("throughput").alias("gate"), throughput_gate(F.col("throughput"), F.col("base_throughput"), F.col("same_host")).alias("breach")),
        F.struct(F.lit("rss").alias("gate"), rss_gate(F.col("peak_rss"), F.col("base_rss"), F.col("same_host")).alias("breach")),
    )
    return runs.select(key, F.explode(F.filter(both, lambda b: b["breach"].isNotNull())).alias("b")).select(key, "b.*")


def batch_summary(batches: DataFrame, *keys: str) -> DataFrame:
    """``batches`` (keys, total_seconds, image_count, build_seconds, rss_mb, cpu_core_seconds) with throughput and warm seconds an image."""
    n, total = F.col("image_count"), F.col("total_seconds")
    return batches.select(*keys, "total_seconds", "image_count", throughput(n, total).alias("throughput"), warm_per_image(total, F.col("build_seconds"), n).alias("warm_per_image_seconds"), "build_seconds", "rss_mb", "cpu_core_seconds")


def headline_totals(batches: DataFrame, *keys: str) -> DataFrame:
    """Images, seconds, CPU seconds and the highest memory over the batches of an engine; batches without a time count in neither sum."""
    timed = F.col("total_seconds").isNotNull()
    sums = batches.groupBy(*keys).agg(F.sum(F.when(timed, F.col("image_count"))).alias("images"), F.sum("total_seconds").alias("seconds"), F.max("rss_mb").alias("peak_rss"), F.sum("cpu_core_seconds").alias("cpu_seconds"))
    return sums.withColumn("throughput", throughput(F.col("images"), F.col("seconds")))


def guardrails(records: DataFrame, score: str, *keys: str) -> DataFrame:
    """Contracts: the least score asked of each scored record; of labelled records that were not skipped, where these columns are there."""
    for column, holds in (("group", F.col("group") == "labeled"), ("skipped", F.col("skipped").isNull())):
        records = records.filter(holds) if column in records.columns else records
    return records.filter(F.col(score).isNotNull()).select(*keys, (F.col(score) * QUALITY_FLOOR).alias("floor"))


def versioned(contracts: DataFrame, version: str, known: int) -> DataFrame:
    """``contracts`` of the known schema version; any other version, or none, is an error and never a silent pass."""
    told = F.coalesce(F.col(version).cast("string"), F.lit("none"))
    wrong = F.raise_error(F.concat(F.lit("unsupported schema version: "), told))
    return contracts.filter(F.when(told == str(known), F.lit(True)).otherwise(wrong.cast("boolean")))


def leg_summary(reports: DataFrame) -> DataFrame:
    """Rows by leg and image of ``legs``: what was asked for and registered, and median milliseconds; a dash for a leg without images."""
    ms = lambda c: F.coalesce(exact(F.col(c)), exact(F.lit(0.0))).cast("decimal(24,1)").cast("string")
    some = F.col("image").isNotNull()
    stages = [F.when(some, ms(f"median.{c}")).otherwise("-").alias(c) for c in ("total_ms", "detect_ms", "recognize_ms")]
    return reports.select(F.coalesce("leg", F.lit("?")).alias("leg"), F.coalesce("backend", F.lit("?")).alias("backend"), F.coalesce("image", F.lit("-")).alias("image"), *stages)


def breaches(contracts: DataFrame, records: DataFrame, score: str, key: str) -> DataFrame:
    """Contracts whose record is missing, not finite or below the floor."""
    joined = contracts.join(records.select(key, F.col(score).alias("score")), key, "left")
    why = F.when(F.col("score").isNull(), "missing").when(F.isnan("score"), "not finite").when(F.col("score") < F.col("floor"), "below floor")
    return joined.withColumn("why", why).filter("why is not null")


def assemble(base: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """``base`` left-joined with each part; ``skipped`` names the first part that has no row."""
    out, reason = base, F.lit(None).cast("string")
    for name in parts:
        out = out.join(parts[name].withColumn(f"has_{name}", F.lit(True)), key, "left")
    for name in reversed(parts):
        reason = F.when(F.col(f"has_{name}").isNull(), f"no {name}").otherwise(reason)
    return out.withColumn("skipped", reason).drop(*(f"has_{n}" for n in parts))


def last_wins(batches: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, from the latest batch."""
    rest = [c for c in batches.columns if c != key]
    return batches.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def merge_side(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join in which the new side wins where it has a value."""
    return old.join(new.withColumnRenamed(value, "fresh"), key, "full").select(key, F.coalesce("fresh", value).alias(value))


def first_nonempty(results: DataFrame, key: str, rank: str, lines: str, error: str) -> DataFrame:
    """Of several engines' results per key: the first with lines, else the last error, else the last empty one."""
    full = F.min(F.when(F.col(lines) > 0, F.struct(rank, lines, error)))
    failed = F.max(F.when(F.col(error).isNotNull(), F.struct(rank, lines, error)))
    return results.groupBy(key).agg(F.coalesce(full, failed, F.max(F.struct(rank, lines, error))).alias("r")).select(key, "r.*")


def violations(rows: DataFrame, key: str, unit: list[str], counts: list[str]) -> DataFrame:
    """Rows (key, field, value) that break a rule: not finite, outside [0, 1], negative or fractional counts."""
    long = rows.select(key, *(F.col(c).cast("double") for c in unit + counts)).unpivot([key], unit + counts, "field", "value")
    bad = F.isnan("value") | (F.abs("value") == float("inf")) | (F.col("field").isin(unit) & ~F.col("value").between(0, 1)) | (F.col("field").isin(counts) & ((F.col("value") < 0) | (F.floor("value") != F.col("value"))))
    return long.filter(bad)


def digest_matches(content: Column, pin: Column) -> Column:
    """Whether content has the pinned digest, in either case; an empty pin never matches."""
    return (pin != "") & (F.sha2(content, 256) == F.lower(pin))


def stage_durations(events: DataFrame, key: str, ts: str, stage: str) -> DataFrame:
    """Seconds per stage: each event owns the time to the key's next one."""
    from pyspark.sql import Window

    until = F.lead(ts).over(Window.partitionBy(key).orderBy(ts))
    return events.withColumn("seconds", (F.unix_micros(until.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6).groupBy(key, stage).agg(F.sum("seconds").alias("seconds"))
