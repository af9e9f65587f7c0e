"""Artefacts that are seen whole or not at all, and stored reports of several versions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import reports
from lectern.sources import published

TOLD = {"host": "here", "commit": "abc"}


def load(spark, path):
    spark.dataSource.register(published.Published)
    return spark.read.format("published").option("path", path).load()


def content(path):
    return sorted(p.relative_to(path).as_posix() for p in Path(path).rglob("*"))


def test_what_is_published_is_read_back(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "cast(id as decimal(9,2)) as d", "if(id % 3 = 0, null, array('a', cast(id as string))) as words", "date'2024-01-01' as day").repartition(5)
    published.publish(rows, str(tmp_path), TOLD)
    back = load(spark, str(tmp_path))
    assert back.schema == rows.schema and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert back.select("day", "id").agg(F.sum("id")).first()[0] == 499500
    told = published.manifest(str(tmp_path))
    assert told["provenance"] == TOLD and told["rows"] == 1000 and sum(p["rows"] for p in told["parts"]) == 1000
    published.publish(rows.limit(7), f"file://{tmp_path}", TOLD, append=True)
    assert load(spark, f"file://{tmp_path}").count() == 1007
    for _ in range(3):
        published.publish(rows.limit(3), str(tmp_path), TOLD)
    assert load(spark, str(tmp_path)).count() == 3
    assert len([n for n in content(tmp_path) if n.startswith("manifest")]) == 2 and not [n for n in content(tmp_path) if n.startswith(".")]
    assert len([n for n in content(tmp_path) if "/" not in n and not n.startswith("manifest")]) == 2


def test_a_failed_task_leaves_what_was_there(spark, tmp_path):
    published.publish(spark.range(10), str(tmp_path), TOLD)
    before = content(tmp_path)
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 63, F.raise_error(F.lit("no figure"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no figure"):
        published.publish(bad, str(tmp_path), TOLD)
    # a task that was still running may have left hidden files
    assert [n for n in content(tmp_path) if not n.startswith(".")] == before and load(spark, str(tmp_path)).count() == 10


def test_what_failed_writes_left_goes_when_it_is_old(spark, tmp_path, monkeypatch):
    (tmp_path / ".left").mkdir()
    (tmp_path / ".left" / "part").write_bytes(b"x")
    published.publish(spark.range(2), str(tmp_path), TOLD)
    assert (tmp_path / ".left").exists()
    monkeypatch.setattr(published, "STALE", -1)
    published.publish(spark.range(2), str(tmp_path), TOLD)
    assert not (tmp_path / ".left").exists() and load(spark, str(tmp_path)).count() == 2


def test_readers_see_nothing_of_an_unfinished_write(spark, tmp_path):
    """Parts are there before the manifest that names them; attempts that were not committed stay unread."""
    import pyarrow as pa

    published.publish(spark.range(10), str(tmp_path), TOLD)
    writer = published.Published({"path": str(tmp_path), "provenance": json.dumps(TOLD)}).writer(spark.range(1).schema, True)

    class Task:
        attempt = 0

        @classmethod
        def get(cls):
            return cls()

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Task.attempt += 1
            return Task.attempt

    real, published.TaskContext = published.TaskContext, Task
    try:
        batch = pa.record_batch({"id": pa.array([1, 2, 3])})
        lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    finally:
        published.TaskContext = real
    assert lost.name != kept.name and load(spark, str(tmp_path)).count() == 10
    writer.commit([kept, None])
    assert load(spark, str(tmp_path)).count() == 6


def test_refusals(spark, tmp_path):
    rows = spark.range(3)
    for told in ({}, None, [1]):
        with pytest.raises(Exception, match="provenance"):
            published.publish(rows, str(tmp_path), told)
    with pytest.raises(ValueError, match="not published"):
        published.publish(rows, str(tmp_path), TOLD, rows.filter("id = 1"))
    with pytest.raises(Exception, match="nothing is published"):
        load(spark, str(tmp_path))
    assert content(tmp_path) == []
    published.publish(rows, str(tmp_path), TOLD, rows.filter("id = 9"))
    with pytest.raises(Exception, match="another schema"):
        published.publish(rows.withColumn("more", F.lit(1)), str(tmp_path), TOLD, append=True)
    assert load(spark, str(tmp_path)).count() == 3
    published.publish(rows.filter("id > 9"), str(tmp_path), TOLD)
    assert load(spark, str(tmp_path)).count() == 0


OLD = {"metadata": {"own_batch": [{"seconds": 2.0, "images": 4, "rss_mb": 10}, {"images": 9, "rss_mb": 30.5}], "other_batch": []}, "records": [{"own_cold_seconds": 1.5, "skipped": None}, {"own_cold_seconds": 9, "skipped": "gone"}, {"own_cold_seconds": "3"}]}
NEW = {"metadata": {"own_batch": {"en": {"total_seconds": 3, "image_count": 2, "rss_mb": 7}}, "other_batch": {"en": {"total_seconds": None, "image_count": 5}}}, "records": []}
NEWER = {"metadata": {"batches": {"own": {"en": {"total_seconds": 1, "image_count": 1}}, "other": {"en": {"total_seconds": 4.5, "image_count": 3, "rss_mb": 8}}}, "more": {"x": [1]}}}


def test_totals_of_reports_of_any_version(spark):
    texts = [json.dumps(OLD), json.dumps(NEW), json.dumps(NEWER), "{}", "[1]", "{", None, '"text"']
    read = reports.parsed(spark.createDataFrame(list(enumerate(texts)), "k int, document string"), "document")
    assert [r.error for r in read.orderBy("k").select("error").collect()] == [None, None, None, None, "no object", "no JSON", "no JSON", "no object"]
    got = {r.k: tuple(r)[1:] for r in reports.totals(read.filter("error is null"), "k", "own", "other").collect()}
    assert got == {0: (2, 1.5, 2.0, 4, 30.5, 0.0, 0, None), 1: (0, 0.0, 3.0, 2, 7.0, 0.0, 0, None), 2: (0, 0.0, 1.0, 1, None, 4.5, 3, 8.0), 3: (0, 0.0, 0.0, 0, None, 0.0, 0, None)}
    schema = reports.field_types(read.filter("k < 3").select(F.lit(1).alias("k"), "report"), "k").first().schema
    assert "own_batch: VARIANT" in schema and "batches: OBJECT" in schema


def test_records_and_combined_legs(spark):
    rows = spark.createDataFrame([(1, "a\"}", None, None), (2, None, "why", True)], "k int, s string, skipped string, unsupported_format boolean")
    got = [json.loads(r.d) for r in rows.select(reports.record_dict(rows.columns).alias("d")).collect()]
    assert got == [{"k": 1, "s": 'a"}', "skipped": None, "unsupported_format": None}, {"k": 2, "skipped": "why", "unsupported_format": True}]
    assert [json.loads(r.d) for r in rows.select(reports.record_dict(["skipped"]).alias("d")).collect()] == [{"skipped": None}, {"skipped": "why"}]
    legs = spark.createDataFrame([(1, "b", '{"leg":"b", "x":1.50}'), (1, "a", '{"leg":"a"}')], "k int, leg string, report string")
    assert reports.combined_legs(legs, "k", 3).first().artefact == '{"schema_version":3,"legs":[{"leg":"a"},{"leg":"b", "x":1.50}]}'
