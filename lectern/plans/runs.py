"""Queries of run planning: suppliers, parts and line items stand for entries, sizes and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import decoding, grouping, runs
from lectern.sources import synthetic, table


def synthetic_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.merged_lines(synthetic.boxes(spark, 200)).select(F.col("n_boxes").cast("bigint").alias("n_boxes"), "x0", "x1", "y0", "y1")


def synthetic_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = spark.range(1, 10).select(F.col("id").cast("int").alias("class"), F.col("id").cast("string").alias("ch"))
    return decoding.greedy_decode(synthetic.logits(spark, 25, 10), chars).withColumn("confidence", F.round("confidence", 6))


def language_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("languages", F.concat_ws("+", "lang", F.when(F.col("doc_id") % 3 == 0, "en")))
    return runs.group_by_languages(d, "languages", "doc_id", "doc_id").withColumn("group_no", F.col("group_no").cast("bigint"))


def corpus_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.first_entries(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


def recognition_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(F.lit("en"), F.col("lang"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", runs.recognition_language(asked, "en").alias("language"))


def run_overhead(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return runs.overhead(l, "p_size", "l_partkey", "l_quantity", "l_returnflag").withColumn("overhead", F.round("overhead", 6))


def drift_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the stored ones, a tenth of which are gone and a tenth changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    stored = o.filter("o_orderkey % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, "?").otherwise(F.col("o_orderstatus")))
    return runs.drift(o, stored)


def parity_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    other = o.filter("o_orderkey % 9 <> 0").withColumn("v", F.col("v") + F.col("o_orderkey") % 5)
    return runs.max_difference(o, other, ["o_orderkey"], "v").withColumn("largest", F.round("largest", 6))


def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, benchmark items and short documents as three groups, one of them left out."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    groups = {"labeled": table(spark, sf_dir, "labels").select("doc_id"), "breadth": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "capability": d}
    return runs.manifest(groups, ["labeled", "breadth"])


QUERIES = {
    synthetic_boxes: "SELECT 200::BIGINT AS n_boxes, -2.0::DOUBLE AS x0, (199 * 45 + 42)::DOUBLE AS x1, 8.0::DOUBLE AS y0, 32.0::DOUBLE AS y1",
    synthetic_logits: """
WITH p AS (SELECT t.range AS t, c.range AS class, exp(-abs(c.range - t.range % 10) * 0.5) AS e FROM range(25) t, range(10) c),
b AS (SELECT t, t % 10 AS class, max(e) / sum(e) AS p FROM p GROUP BY t)
SELECT 0::BIGINT AS crop_id, string_agg(class::VARCHAR, '' ORDER BY t) FILTER (WHERE class <> 0) AS text, round(exp(sum(CASE WHEN class <> 0 THEN ln(p) ELSE 0 END) * 2 / sqrt(count(*) FILTER (WHERE class <> 0))), 6) AS confidence FROM b""",
    language_groups: """
WITH d AS (SELECT doc_id, lang || CASE WHEN doc_id % 3 = 0 THEN '+en' ELSE '' END AS languages FROM documents),
g AS (SELECT languages, min(doc_id) AS first, count(*) AS n FROM d GROUP BY languages)
SELECT row_number() OVER (ORDER BY first) - 1 AS group_no, languages, n, first FROM g""",
    corpus_limit: "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100",
    recognition_language: "SELECT doc_id, lang AS language FROM documents",
    run_overhead: """
WITH l AS (SELECT l_returnflag, l_partkey, l_quantity, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT l_returnflag, min_by(l_partkey, (p_size, l_partkey)) AS smallest FROM l GROUP BY 1)
SELECT l_returnflag, smallest, round(median(l_quantity), 6) AS overhead FROM l JOIN m USING (l_returnflag) WHERE l_partkey = smallest GROUP BY ALL""",
    drift_check: """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN '?' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0)
SELECT o_orderkey, o_orderstatus, 'missing' AS side FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT * FROM s)
UNION ALL SELECT o_orderkey, o_orderstatus, 'stale' FROM (SELECT * FROM s EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""",
    parity_difference: "SELECT round(max(CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 5 END), 6)::DOUBLE AS largest, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS pairs, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS unpaired FROM orders",
    corpus_manifest: "SELECT doc_id, 'labeled' AS grp FROM labels UNION ALL SELECT item_id, 'breadth' FROM benchmark",
}
