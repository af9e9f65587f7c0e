"""Queries of run records: events, orders and documents stand for measurements, runs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import records
from lectern.sources import table
from lectern.sources import artefacts


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def metric_summary_r7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(records.summary(table(spark, sf_dir, "events"), "value", "event_type"), "median", "p95", "p99", "mean")


def suppressed_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: many have too few events for a 99th percentile."""
    return _rounded(records.summary(table(spark, sf_dir, "events"), "value", "user_id"), "median", "p95", "p99", "mean")


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three very large groups: percentiles by ranges, with no group in one task."""
    out = records.range_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", {"median": 0.5, "p95": 0.95, "p99": 0.99}, "l_returnflag")
    return _rounded(out, "median", "p95", "p99")


def labeled_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    return _rounded(records.field_summary(orders, ["price", "customer"], "o_orderstatus"), "median", "p95", "mean")


def paired_ratio_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("a"), (F.col("l_discount") * F.col("l_quantity")).alias("b"))
    return _rounded(records.paired_ratio_median(rows, "a", "b", "l_returnflag"), "ratio")


def repeat_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("repeat"), F.col("l_quantity").alias("seconds"), F.col("l_extendedprice").alias("rss"), F.col("l_tax").alias("cpu"))
    return _rounded(records.reduce_repeats(runs, "l_suppkey", "repeat"), "seconds", "rss", "cpu")


def batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches: lines per unit of quantity, and the price of a line without the first tax."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"), F.min("l_tax").alias("build"))
    out = sums.select("l_orderkey", records.throughput(F.col("n"), F.col("total")).alias("throughput"), records.warm_per_image(F.col("total"), F.col("build"), F.col("n")).alias("warm"))
    return _rounded(out, "throughput", "warm")


def headline_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds per item of two order priorities as engines, their ratio and its claim."""
    o = table(spark, sf_dir, "orders")
    own, other = (F.col("o_orderpriority") == p for p in ("1-URGENT", "5-LOW"))
    sums = o.groupBy("o_orderstatus").agg(F.count_if(own).alias("n1"), F.sum(F.when(own, F.col("o_totalprice"))).alias("s1"), F.count_if(other).alias("n2"), F.sum(F.when(other, F.col("o_totalprice") * 1.5)).alias("s2"))
    ratio = F.round(records.speedup(F.col("n1"), F.col("s1"), F.col("n2"), F.col("s2")), 6)
    return sums.select("o_orderstatus", ratio.alias("ratio"), t.ratio_claim(ratio).alias("claim"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as hosts: suppliers' mean balance measured, customers' the baseline; one host in five differs."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.round(F.avg("s_acctbal"), 6).alias("measured"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg("c_acctbal"), 6).alias("baseline"))
    return n.join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").withColumn("same", F.col("n_nationkey") % 5 != 0)


def rss_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    return m.select("n_nationkey", records.rss_gate(F.col("measured"), F.col("baseline"), F.col("same")).alias("breach"))


def throughput_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    return m.select("n_nationkey", records.throughput_gate(F.col("measured"), F.col("baseline"), F.col("same")).alias("breach"))


def guardrail_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts from customers' balances; the new record is the balance less a part that grows with the key, every 7th missing."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") + 2000).alias("score"))
    now = c.filter("c_custkey % 7 <> 0").select("c_custkey", (F.col("score") * (1 - (F.col("c_custkey") % 20) / 100)).alias("score"))
    return records.breaches(records.guardrails(c, "score", "c_custkey"), now, "score", "c_custkey").select("c_custkey", F.round("floor", 6).alias("floor"), F.round("score", 6).alias("score"), "why")


def baseline_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's mean value per day against the day before, signed."""
    day = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    before = day.select("event_type", F.date_add("day", 1).alias("day"), F.col("v").alias("b"))
    delta = F.round(F.col("v") - F.col("b"), 6)
    return day.join(before, ["event_type", "day"], "left").select("event_type", F.col("day").cast("string").alias("day"), delta.alias("delta"), F.when(delta > 0, "up").when(delta < 0, "down").otherwise("-").alias("way"))


def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels and with benchmark items of the same number; the first part missing is the reason to skip."""
    parts = {"label": table(spark, sf_dir, "labels"), "item": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").alias("item_chars"))}
    return records.assemble(table(spark, sf_dir, "documents").select("doc_id", "lang"), parts, "doc_id")


def last_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order totals with the urgent ones' in their place."""
    o = table(spark, sf_dir, "orders")
    total = lambda d: d.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return records.merge_side(total(o), total(o.filter("o_orderpriority = '1-URGENT'")), "o_custkey", "total")


def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as engines' answers to an order: lines by discount, errors by return flag."""
    r = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("rank")).agg(F.max(F.floor(F.col("l_discount") * 20).cast("int")).alias("lines"), F.max(F.when(F.col("l_returnflag") == "R", "failed")).alias("error"))
    r = r.withColumn("lines", F.when(F.col("error").isNull(), F.greatest(F.lit(0), F.col("lines") - 1)).otherwise(0))
    return records.first_nonempty(r, "l_orderkey", "rank", "lines", "error")


def report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items whose tax times 13 leaves [0, 1], or whose half quantity is no count."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_tax").alias("tax"), F.max("l_quantity").alias("q"))
    return _rounded(records.violations(l.select("l_orderkey", (F.col("tax") * 13).alias("tax"), (F.col("q") / 2).alias("half")), "l_orderkey", ["tax"], ["half"]), "value")


def ordered_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences of the words of benchmark texts, in order."""
    w = F.array_distinct(t.words(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(w).cast("bigint").alias("n"), F.array_join(w, " ").alias("words"))


def sha256_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins made of the text itself, in upper case, empty for every fifth and wrong for every seventh."""
    d = table(spark, sf_dir, "documents")
    own = F.upper(F.sha2(F.col("text").cast("binary"), 256))
    pin = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 7 == 0, F.concat(F.lit("0"), F.substring(own, 2, 63))).otherwise(own)
    return d.select("doc_id", records.digest_matches(F.col("text").cast("binary"), pin).alias("ok"))


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(records.stage_durations(table(spark, sf_dir, "events"), "user_id", "ts", "event_type"), "seconds")


def small_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, versions and times formatted from the customers' table."""
    c = table(spark, sf_dir, "customer")
    tag = F.concat(F.lit("rel-1."), F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), F.col("c_custkey").cast("string"))))
    return c.select(
        "c_custkey",
        t.page_filename(F.col("c_custkey") + 1, F.lit(1500)).alias("page"),
        t.runtime_version(tag).alias("version"),
        t.utc_text(F.col("c_custkey") * 86399).alias("utc"),
        t.host_identity(F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name"))).alias("host"),
        t.cache_dir(F.concat(F.col("c_mktsegment"), F.lit("/"), F.col("c_name"))).alias("folder"),
        t.owner_is_safe(F.col("c_name")).alias("safe"),
        t.probability((F.col("c_acctbal") / 10000).cast("string")).isNotNull().alias("is_probability"),
    )


def batch_result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON parsed by schema."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", artefacts.from_json(F.col("props"), "k bigint").getField("k").alias("k"))


def render_batch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered as one result per image: lines in order as text with three-decimal confidence."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("role").alias("text"), (F.length("text") % 1000 / 1000.0).cast("double").alias("confidence"))
    return artefacts.render_text(c, "conv_id")


def merged_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a result as one: texts joined by a space, confidences averaged."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.col("role").alias("text"), (F.length("text") % 1000 / 1000.0).cast("double").alias("confidence"))
    return _rounded(artefacts.merge_lines(c, "conv_id"), "confidence")


_SUM = "median(value) AS median, CASE WHEN count(value) >= 20 THEN quantile_cont(value, 0.95) END AS p95, CASE WHEN count(value) >= 100 THEN quantile_cont(value, 0.99) END AS p99, avg(value) AS mean, count(value) AS count"
_SUMR = "round(median, 6) AS median, round(p95, 6) AS p95, round(p99, 6) AS p99, round(mean, 6) AS mean, count"
_FIELD = "round(median(value), 6) AS median, round(CASE WHEN count(value) >= 20 THEN quantile_cont(value, 0.95) END, 6) AS p95, round(avg(value), 6) AS mean, count(value) AS count"
_HOSTS = """
WITH m AS (SELECT n.n_nationkey, n.n_nationkey % 5 <> 0 AS same, s.v AS measured, c.v AS baseline FROM nation n
  LEFT JOIN (SELECT s_nationkey k, round(avg(s_acctbal), 6)::DECIMAL(24,6) v FROM supplier GROUP BY 1) s ON s.k = n.n_nationkey
  LEFT JOIN (SELECT c_nationkey k, round(avg(c_acctbal), 6)::DECIMAL(24,6) v FROM customer GROUP BY 1) c ON c.k = n.n_nationkey)
SELECT n_nationkey, CASE WHEN baseline IS NULL THEN 'no baseline' WHEN NOT same THEN 'other host' WHEN baseline <= 0 THEN 'no positive baseline' WHEN measured IS NULL THEN 'not measured'
"""
_LINES = "SELECT conv_id, turn, role, (length(text) % 1000) / 1000.0::DOUBLE AS confidence FROM conversations"

QUERIES = {
    metric_summary_r7: f"SELECT event_type, {_SUMR} FROM (SELECT event_type, {_SUM} FROM events WHERE value IS NOT NULL GROUP BY event_type)",
    suppressed_percentiles: f"SELECT user_id, {_SUMR} FROM (SELECT user_id, {_SUM} FROM events WHERE value IS NOT NULL GROUP BY user_id)",
    price_percentiles: """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
    labeled_all_summary: f"""
WITH l AS (SELECT o_orderstatus, 'price' AS field, o_totalprice::DOUBLE AS value FROM orders UNION ALL SELECT o_orderstatus, 'customer', o_custkey::DOUBLE FROM orders)
SELECT field, o_orderstatus, {_FIELD} FROM l GROUP BY GROUPING SETS ((field, o_orderstatus), (field))""",
    paired_ratio_median: "SELECT l_returnflag, round(median(l_extendedprice / (l_discount * l_quantity)), 6) AS ratio, count(*) AS pairs FROM lineitem WHERE l_discount * l_quantity <> 0 GROUP BY l_returnflag",
    repeat_reduction: "SELECT l_suppkey, round(median(l_quantity), 6) AS seconds, round(max(l_extendedprice), 6) AS rss, round(median(l_tax), 6) AS cpu, max(l_linenumber) AS last_repeat FROM lineitem GROUP BY l_suppkey",
    batch_throughput: "SELECT l_orderkey, round(n / total, 6) AS throughput, round(greatest((total - build) / n, 0), 6) AS warm FROM (SELECT l_orderkey, count(*) n, sum(l_quantity) total, min(l_tax) build FROM lineitem GROUP BY l_orderkey)",
    headline_speedup: """
WITH s AS (SELECT o_orderstatus, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') n1, sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') s1,
  count(*) FILTER (WHERE o_orderpriority = '5-LOW') n2, sum(o_totalprice * 1.5) FILTER (WHERE o_orderpriority = '5-LOW') s2 FROM orders GROUP BY o_orderstatus),
r AS (SELECT o_orderstatus, round((s2 / n2) / (s1 / n1), 6) AS ratio FROM s)
SELECT o_orderstatus, ratio, CASE WHEN ratio >= 1.15 THEN ratio::DECIMAL(24,6)::DECIMAL(24,1)::VARCHAR || 'x' END AS claim FROM r""",
    rss_gate: _HOSTS + "WHEN measured > (baseline * 1.1)::DECIMAL(24,6) THEN measured::VARCHAR || ' against ' || (baseline * 1.1)::DECIMAL(24,6)::VARCHAR END AS breach FROM m",
    throughput_gate: _HOSTS + "WHEN measured < (baseline * 0.9)::DECIMAL(24,6) THEN measured::VARCHAR || ' against ' || (baseline * 0.9)::DECIMAL(24,6)::VARCHAR END AS breach FROM m",
    guardrail_breaches: """
WITH c AS (SELECT c_custkey, c_acctbal + 2000 AS base FROM customer),
j AS (SELECT c_custkey, base * 0.9 AS floor, CASE WHEN c_custkey % 7 <> 0 THEN base * (1 - (c_custkey % 20) / 100.0::DOUBLE) END AS score FROM c)
SELECT c_custkey, round(floor, 6) AS floor, round(score, 6) AS score, CASE WHEN score IS NULL THEN 'missing' ELSE 'below floor' END AS why FROM j WHERE score IS NULL OR score < floor""",
    baseline_delta: """
WITH d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY ALL),
j AS (SELECT a.event_type, a.day::VARCHAR AS day, round(a.v - b.v, 6) AS delta FROM d a LEFT JOIN d b ON a.event_type = b.event_type AND a.day = b.day + 1)
SELECT *, CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE '-' END AS way FROM j""",
    record_assembly: """
SELECT d.doc_id, d.lang, l.quality, l.toxic, length(b.text)::INT AS item_chars, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN b.item_id IS NULL THEN 'no item' END AS skipped
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
    last_wins_merge: "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    outer_merge: """
WITH a AS (SELECT o_custkey, round(sum(o_totalprice), 2) t FROM orders GROUP BY 1), u AS (SELECT o_custkey, round(sum(o_totalprice), 2) t FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT coalesce(a.o_custkey, u.o_custkey) AS o_custkey, coalesce(u.t, a.t) AS total FROM a FULL JOIN u USING (o_custkey)""",
    engine_fallback: """
WITH r AS (SELECT l_orderkey, l_linenumber AS rank, max(floor(l_discount * 20)::INT) AS n, max(CASE WHEN l_returnflag = 'R' THEN 'failed' END) AS error FROM lineitem GROUP BY ALL),
e AS (SELECT l_orderkey, rank, CASE WHEN error IS NULL THEN greatest(0, n - 1) ELSE 0 END AS lines, error FROM r)
SELECT l_orderkey, rank, lines, error FROM e QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN lines > 0 THEN 0 WHEN error IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN lines > 0 THEN rank ELSE -rank END) = 1""",
    report_violations: """
WITH l AS (SELECT l_orderkey, max(l_tax) * 13 AS tax, max(l_quantity) / 2 AS half FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'tax' AS field, round(tax, 6) AS value FROM l WHERE NOT tax BETWEEN 0 AND 1 UNION ALL SELECT l_orderkey, 'half', round(half, 6) FROM l WHERE half < 0 OR floor(half) <> half""",
    ordered_dedupe: r"""
WITH w AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') l FROM benchmark),
u AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) l FROM w)
SELECT item_id, len(l) AS n, array_to_string(l, ' ') AS words FROM u""",
    sha256_check: "SELECT doc_id, NOT (doc_id % 5 = 0 OR (doc_id % 7 = 0 AND substr(sha256(text), 1, 1) <> '0')) AS ok FROM documents",
    stage_durations: """
WITH e AS (SELECT user_id, event_type, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts)) / 1e6 AS s FROM events)
SELECT user_id, event_type, round(sum(s), 6) AS seconds FROM e GROUP BY ALL""",
    small_formats: r"""
SELECT c_custkey, 'page_' || lpad((c_custkey + 1)::VARCHAR, 4, '0') || '.png' AS page,
  CASE WHEN c_custkey % 3 <> 0 THEN '1.' || c_nationkey || '.' || c_custkey END AS version,
  strftime(make_timestamp(c_custkey * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc,
  CASE WHEN c_custkey % 4 = 0 THEN 'unknown' ELSE c_name END AS host,
  'models--' || c_mktsegment || '--' || c_name AS folder,
  regexp_matches(c_name, '^[A-Za-z0-9_-]+$') AS safe, c_acctbal BETWEEN 0 AND 10000 AS is_probability FROM customer""",
    batch_result_json: "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events",
    render_batch_lines: f"SELECT conv_id, string_agg(printf('%s\t%.3f', role, confidence), chr(10) ORDER BY turn) AS rendered FROM ({_LINES}) GROUP BY conv_id",
    merged_line_text: f"SELECT conv_id, string_agg(role, ' ' ORDER BY turn) AS text, round(avg(confidence), 6) AS confidence FROM ({_LINES}) GROUP BY conv_id",
}
