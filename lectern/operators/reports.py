"""Stored reports of several versions as one table, by VARIANT columns; artefacts made of them.

A report is a JSON document: ``metadata`` with a summary of batches for each engine, and ``records``, one for each
page. Versions differ: batches stand as an object by language group or as a list, under older or newer names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS, IMAGES = ("total_seconds", "seconds"), ("image_count", "images")
#: Fields that a record tells even where they are null.
ALWAYS = ("skipped", "unsupported_format")


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``report``, the document as VARIANT, and ``error`` where it is no JSON object."""
    rows = rows.withColumn("report", F.try_parse_json(column))
    sound = F.schema_of_variant("report").startswith("OBJECT")
    return rows.withColumn("error", F.when(F.col("report").isNull(), "no JSON").when(~sound, "no object"))


def _number(value: Column, *names: str) -> Column:
    """The first of the named fields that holds a number; text that looks like one does not."""
    found = []
    for name in names:
        field = F.try_variant_get(value, f"$.{name}", "variant")
        found.append(F.when(F.schema_of_variant(field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, f"$.{name}", "double")))
    return F.coalesce(*found)


def batches(reports: DataFrame, key: str, *engines: str) -> DataFrame:
    """Rows (key, engine, seconds, images, rss_mb), one for each batch of ``reports`` (key, report)."""
    spark, out = reports.sparkSession, None
    for engine in engines:
        held = F.coalesce(F.try_variant_get("report", f"$.metadata.{engine}_batch", "variant"), F.try_variant_get("report", f"$.metadata.batches.{engine}", "variant"))
        each = reports.select(key, held.alias("held")).lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
        value = F.col("value")
        part = each.select(key, F.lit(engine).alias("engine"), _number(value, *SECONDS).alias("seconds"), _number(value, *IMAGES).cast("bigint").alias("images"), _number(value, "rss_mb").alias("rss_mb"))
        out = part if out is None else out.unionByName(part)
    return out


def scored_records(reports: DataFrame, key: str) -> DataFrame:
    """Rows (key, record) of the records of ``reports`` (key, report) that were not skipped."""
    held = reports.select(key, F.try_variant_get("report", "$.records", "variant").alias("held"))
    each = held.lateralJoin(reports.sparkSession.tvf.variant_explode(F.col("held").outer())).select(key, F.col("value").alias("record"))
    skipped = F.try_variant_get("record", "$.skipped", "variant")
    return each.filter(skipped.isNull() | F.is_variant_null(skipped))


def totals(reports: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Rows (key, scored, cold_seconds and, for both engines, seconds, images, rss_mb), one for each of ``reports`` (key, report).

    Batches that were not timed count for memory only; a report without records or batches has zeros, and no memory.
    """
    sums = []
    for name, engine in (("own", own), ("other", other)):
        timed = F.col("seconds").isNotNull()
        found = batches(reports, key, engine).groupBy(key)
        sums.append(found.agg(F.sum(F.when(timed, F.col("seconds"))).alias(f"{name}_seconds"), F.sum(F.when(timed, F.col("images"))).alias(f"{name}_images"), F.max("rss_mb").alias(f"{name}_rss_mb")))
    cold = scored_records(reports, key).groupBy(key).agg(F.count(F.lit(1)).alias("scored"), F.sum(_number(F.col("record"), f"{own}_cold_seconds")).alias("cold_seconds"))
    out = reports.select(key)
    for part in (cold, *sums):
        out = out.join(part, key, "left")
    return out.na.fill(0, ["scored"]).na.fill(0.0, ["cold_seconds"]).na.fill(0, [f"{n}_images" for n in ("own", "other")]).na.fill(0.0, [f"{n}_seconds" for n in ("own", "other")])


def record_dict(fields: list[str], always: tuple[str, ...] = ALWAYS) -> Column:
    """The columns ``fields`` as a JSON object without nulls, but for those of ``always``."""
    inner = lambda names, options: F.regexp_extract(F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), options), r"(?s)^\{(.*)\}$", 1) if names else F.lit("")
    told = inner([f for f in fields if f not in always], {"ignoreNullFields": "true"})
    kept = inner([f for f in fields if f in always], {"ignoreNullFields": "false"})
    return F.concat(F.lit("{"), F.concat_ws(",", F.nullif(told, F.lit("")), F.nullif(kept, F.lit(""))), F.lit("}"))


def combined_legs(legs: DataFrame, key: str, version: int = 1) -> DataFrame:
    """Rows (key, artefact): the reports of ``legs`` (key, leg, report: JSON text), as they are, by leg, under a schema version."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("leg", "report"))), lambda x: x["report"])
    head = F.lit(f'{{"schema_version":{version},"legs":[')
    return legs.groupBy(key).agg(F.concat(head, F.array_join(each, ","), F.lit("]}")).alias("artefact"))


def field_types(reports: DataFrame, key: str) -> DataFrame:
    """Rows (key, schema): the one schema that all ``reports`` (key, report) of a key have in common."""
    return reports.groupBy(key).agg(F.schema_of_variant_agg("report").alias("schema"))
