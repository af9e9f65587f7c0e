"""Queries of models: what is asked, who provides it, and whole sets of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import models, table


def model_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as configurations whose line items ask for languages, parts' brands; the registry lacks a few, some owners are unsafe."""
    p = table(spark, sf_dir, "part")
    brand = F.substring("p_brand", 7, 2)
    registry = p.filter("p_brand <> 'Brand#11'").groupBy(brand.alias("role")).agg(F.min("p_name").alias("name"), F.count(F.lit(1)).cast("string").alias("revision"))
    registry = registry.unionByName(spark.range(1).select(F.lit(models.DETECTOR).alias("role"), F.lit("finder").alias("name"), F.lit("1").alias("revision")))
    registry = registry.select("role", "name", F.concat(F.lit("house/"), "role").alias("repo"), "revision", F.concat("role", F.lit(".onnx")).alias("file"), F.sha2(F.col("name").cast("binary"), 256).alias("sha256"))
    asked = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), brand.alias("language")), "l_partkey")
    asked = asked.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), "language")
    owner = F.when(F.col("l_suppkey") % 3 == 0, F.lit("other-house")).when(F.col("l_suppkey") % 7 == 0, F.lit("../x"))
    return models.descriptors(registry, asked, "l_suppkey", owner).select("l_suppkey", "place", "role", "name", "repo", "revision", "sha256", "error")


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as roles: what a supplier names itself, else an order's file, else a line item's, else nothing."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("role"))
    s, o, l = (table(spark, sf_dir, n) for n in ("supplier", "orders", "lineitem"))
    digest = lambda c: F.md5(c.cast("string").cast("binary"))
    own = s.select((F.col("s_suppkey") * 7).alias("role"), F.col("s_name").alias("location"), digest(F.col("s_suppkey")).alias("sha256"))
    cached = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("role"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("location"), digest(F.col("o_orderkey")).alias("sha256"))
    hub = l.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("role"), F.lpad((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string"), 12, "0").alias("location"), digest(F.col("l_orderkey")).alias("sha256"))
    return models.provided(wanted, ("given", own), ("cache", cached), ("hub", hub))


def verified_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sets of models: each line's part is one, the first line the detector; some pins are of other content, some lines repeat a role."""
    l = table(spark, sf_dir, "lineitem")
    content = F.col("l_partkey").cast("string").cast("binary")
    role = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 10 != 0), models.DETECTOR).otherwise(F.lpad((F.col("l_partkey") % 20).cast("string"), 2, "0"))
    pin = F.when(F.col("l_partkey") % 9 == 0, F.lit("")).when(F.col("l_partkey") % 13 == 0, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(F.upper(F.sha2(content, 256)))
    return models.verified_set(l.select("l_orderkey", role.alias("role"), content.alias("content"), pin.alias("sha256")), "l_orderkey")


QUERIES = {
    model_descriptors: """
WITH r AS (
  SELECT substr(p_brand, 7, 2) AS role, min(p_name) AS name, count(*)::VARCHAR AS revision FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1
  UNION ALL SELECT 'detector', 'finder', '1'),
a AS (SELECT l_suppkey, substr(p_brand, 7, 2) AS role, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
w AS (
  SELECT l_suppkey, role, row_number() OVER (PARTITION BY l_suppkey ORDER BY first, role) AS place FROM a UNION ALL SELECT DISTINCT l_suppkey, 'detector', 0 FROM a)
SELECT l_suppkey, place::INT AS place, w.role, name, CASE WHEN r.role IS NULL THEN NULL WHEN l_suppkey % 3 = 0 THEN 'other-house/' WHEN l_suppkey % 7 = 0 THEN '../x/' ELSE 'house/' END || r.role AS repo, revision, sha256(name) AS sha256,
       CASE WHEN r.role IS NULL THEN 'not in the registry' WHEN l_suppkey % 3 <> 0 AND l_suppkey % 7 = 0 THEN 'unsafe owner' END AS error
FROM w LEFT JOIN r ON r.role = w.role""",
    model_choice: """
WITH g AS (SELECT s_suppkey * 7 AS role, min(s_name) AS location, min(md5(s_suppkey::VARCHAR)) AS sha256 FROM supplier GROUP BY 1),
c AS (SELECT o_custkey AS role, min(lpad(o_orderkey::VARCHAR, 9, '0')) AS location, md5(min(o_orderkey)::VARCHAR) AS sha256 FROM orders WHERE o_totalprice > 100000 GROUP BY 1),
h AS (SELECT l_partkey AS role, min(lpad((l_orderkey * 8 + l_linenumber)::VARCHAR, 12, '0')) AS location, md5((min(l_orderkey * 8 + l_linenumber) // 8)::VARCHAR) AS sha256 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey AS role, CASE WHEN g.role IS NOT NULL THEN 'given' WHEN c.role IS NOT NULL THEN 'cache' WHEN h.role IS NOT NULL THEN 'hub' END AS provider,
       CASE WHEN g.role IS NOT NULL THEN g.location WHEN c.role IS NOT NULL THEN c.location ELSE h.location END AS location,
       CASE WHEN g.role IS NOT NULL THEN g.sha256 WHEN c.role IS NOT NULL THEN c.sha256 ELSE h.sha256 END AS sha256
FROM part LEFT JOIN g ON g.role = p_partkey LEFT JOIN c ON c.role = p_partkey LEFT JOIN h ON h.role = p_partkey""",
    verified_sets: """
WITH m AS (
  SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_orderkey % 10 <> 0 THEN 'detector' ELSE lpad((l_partkey % 20)::VARCHAR, 2, '0') END AS role,
         CASE WHEN l_partkey % 9 = 0 THEN 'no digest' WHEN l_partkey % 13 = 0 THEN 'other digest' END AS wrong FROM lineitem),
r AS (SELECT l_orderkey, role, count(*) AS n, min(wrong || ': ' || role) AS wrong FROM m GROUP BY ALL)
SELECT l_orderkey, coalesce(min(wrong), min(CASE WHEN n > 1 THEN 'role given twice: ' || role END), CASE WHEN count(*) FILTER (role = 'detector') = 0 THEN 'no detector' END) AS error FROM r GROUP BY 1""",
}
