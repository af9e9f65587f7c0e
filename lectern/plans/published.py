"""Queries of stored and published reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import reports
from lectern.operators.stages import shared_dir
from lectern.sources import published, table


def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an artefact's records, published in two writes and read back, by status and priority."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round("o_totalprice", 2).alias("price"), F.to_date("o_orderdate").alias("day"))
    path = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    told = {"table": "orders", "version": spark.version}
    published.publish(o.filter("o_orderstatus = 'F'"), path, told)
    published.publish(o.filter("o_orderstatus <> 'F'"), path, told, append=True)
    back = spark.read.format("published").option("path", path).load()
    return back.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("price"), F.min("day").cast("string").alias("day"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as reports (n, document) of three versions: suppliers are batches, customers records; every seventh is no report."""
    s = table(spark, sf_dir, "supplier").withColumn("rss", F.round(F.abs("s_acctbal"), 2)).withColumn("sec", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey") % 100 + 0.5))
    n = F.col("s_nationkey").alias("n")
    new = F.struct(F.col("sec").alias("total_seconds"), (F.col("s_suppkey") % 9).alias("image_count"), F.col("rss").alias("rss_mb"))
    old = F.struct(F.col("sec").alias("seconds"), (F.col("s_suppkey") % 9).alias("images"), F.col("rss").alias("rss_mb"))
    own, odd = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey") % 2 == 1
    by_name = lambda pick: F.map_from_entries(F.array_sort(F.collect_list(F.when(pick, F.struct("s_name", new)))))
    listed = lambda pick: F.array_sort(F.collect_list(F.when(pick, F.struct("s_name", old.alias("b")))))
    b = s.groupBy(n).agg(by_name(own).alias("own_map"), by_name(odd).alias("other_map"), F.transform(listed(own), lambda x: x["b"]).alias("own_list"), F.transform(listed(odd), lambda x: x["b"]).alias("other_list"))
    c = table(spark, sf_dir, "customer")
    skipped = F.when(F.col("c_custkey") % 5 == 0, "not found")
    r = c.withColumn("own_cold_seconds", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 50 + 0.25)).withColumn("skipped", skipped)
    r = r.groupBy(F.col("c_nationkey").alias("n")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(reports.record_dict(["own_cold_seconds", "skipped"]))), ","), F.lit("]")).alias("records"))
    meta = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(F.col("own_map").alias("own_batch"), F.col("other_map").alias("other_batch"))))
    meta = meta.when(F.col("n") % 3 == 1, F.to_json(F.struct(F.col("own_list").alias("own_batch"), F.col("other_list").alias("other_batch"))))
    meta = meta.otherwise(F.to_json(F.struct(F.struct(F.col("own_map").alias("own"), F.col("other_map").alias("other")).alias("batches"))))
    document = F.concat(F.lit('{"metadata":'), F.coalesce(meta, F.lit("{}")), F.lit(',"records":'), F.coalesce("records", F.lit("[]")), F.lit("}"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"))
    both = nations.join(b, "n", "left").join(r, "n", "left")
    return both.select("n", F.when(F.col("n") % 7 == 6, F.lit("[1, 2]")).otherwise(document).alias("document"))


def stored_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of every sound report, whatever its version."""
    read = reports.parsed(_reports(spark, sf_dir), "document").filter("error is null")
    out = reports.totals(read, "n", "own", "other")
    return out.withColumns({c: F.round(c, 4) for c in ("cold_seconds", "own_seconds", "other_seconds")})


def combined_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as leg reports, combined by nation."""
    s = table(spark, sf_dir, "supplier")
    leg = s.select("s_nationkey", F.col("s_name").alias("leg"), F.to_json(F.struct(F.col("s_name").alias("leg"), (F.col("s_suppkey") % 10).alias("images"))).alias("report"))
    return reports.combined_legs(leg, "s_nationkey")


def record_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as records: what is not known is left out, but for the reason of skipping and the format's flag."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select("doc_id", "quality", F.when(F.col("toxic") == 1, "toxic").alias("skipped"), F.lit(None).cast("boolean").alias("unsupported_format"), "source")
    return rows.select("doc_id", reports.record_dict(["doc_id", "quality", "source", "skipped", "unsupported_format"]).alias("record"))


QUERIES = {
    published_orders: """
SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(round(o_totalprice, 2)::DECIMAL(18,2))::DOUBLE AS price, min(o_orderdate::DATE)::VARCHAR AS day FROM orders GROUP BY ALL""",
    stored_totals: """
WITH s AS (
  SELECT s_nationkey AS n, s_suppkey % 2 = 0 AS own, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 100 + 0.5::DOUBLE END AS sec, s_suppkey % 9 AS images, round(abs(s_acctbal), 2) AS rss FROM supplier),
b AS (
  SELECT n, coalesce(sum(sec) FILTER (own), 0) AS own_seconds, coalesce(sum(images) FILTER (own AND sec IS NOT NULL), 0)::BIGINT AS own_images, max(rss) FILTER (own) AS own_rss_mb,
         coalesce(sum(sec) FILTER (NOT own), 0) AS other_seconds, coalesce(sum(images) FILTER (NOT own AND sec IS NOT NULL), 0)::BIGINT AS other_images, max(rss) FILTER (NOT own) AS other_rss_mb
  FROM s GROUP BY n),
c AS (SELECT c_nationkey AS n, count(*) AS scored, coalesce(sum(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 50 + 0.25::DOUBLE END), 0) AS cold_seconds FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1)
SELECT n_nationkey AS n, coalesce(scored, 0) AS scored, round(coalesce(cold_seconds, 0), 4) AS cold_seconds, round(coalesce(own_seconds, 0), 4) AS own_seconds, coalesce(own_images, 0) AS own_images, own_rss_mb,
       round(coalesce(other_seconds, 0), 4) AS other_seconds, coalesce(other_images, 0) AS other_images, other_rss_mb
FROM nation LEFT JOIN b ON b.n = n_nationkey LEFT JOIN c ON c.n = n_nationkey WHERE n_nationkey % 7 <> 6""",
    combined_reports: """
SELECT s_nationkey, '{"schema_version":1,"legs":[' || string_agg('{"leg":"' || s_name || '","images":' || (s_suppkey % 10) || '}', ',' ORDER BY s_name) || ']}' AS artefact FROM supplier GROUP BY 1""",
    record_objects: """
SELECT d.doc_id, '{"doc_id":' || d.doc_id || CASE WHEN quality IS NOT NULL THEN ',"quality":' || quality ELSE '' END || CASE WHEN source IS NOT NULL THEN ',"source":"' || source || '"' ELSE '' END
       || ',"skipped":' || CASE WHEN toxic = 1 THEN '"toxic"' ELSE 'null' END || ',"unsupported_format":null}' AS record
FROM documents d LEFT JOIN labels USING (doc_id)""",
}
