"""Arriving files and late rows; percentiles by ranges."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import streaming
from lectern.operators import imaging, records


def test_pages_are_read_once_however_often_a_batch_runs(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.ppm").write_bytes(b"P5\n1 1\n255\n" + bytes([k]))

    def read(batch):
        return imaging.decode_images(batch).select("path", F.col("image.width").alias("w"), "error")

    def run():
        streaming.read_pages(streaming.arriving_images(spark, str(folder)), read, target, str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(target)

    assert run().count() == 3
    (folder / "bad.ppm").write_bytes(b"x")
    got = run()
    assert got.count() == 4 and [r.error for r in got.filter("w is null").collect()] == ["unsupported image format"]
    assert run().count() == 4
    write = streaming.write_once(lambda df: df, target)
    again = spark.range(2).selectExpr("'x' as path", "1 as w", "'no' as error")
    write(again, 77)
    write(again, 77)
    assert spark.read.parquet(target).count() == 6


def test_rates_of_windows_leave_late_rows(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 10) + datetime.timedelta(minutes=minute)
    source, out = str(tmp_path / "in"), []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, key string, value double").option("maxFilesPerTrigger", 1).parquet(source)
    rows = [[(at(1), "a", 2.0), (at(3), "a", 4.0), (at(12), "b", 1.0)], [(at(90), "a", 5.0)], [(at(2), "a", 100.0), (at(91), "a", 7.0)], [(at(200), "z", 0.0)]]
    for k, some in enumerate(rows):
        spark.createDataFrame(some, "ts timestamp, key string, value double").coalesce(1).write.mode("append").parquet(source)
        query = streaming.windowed_rates(stream, "ts", "key").writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect()))
        query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.minute, r.key, r.n, r["mean"]) for r in out if r.window.start.hour == 10) == [(0, "a", 2, 3.0), (10, "b", 1, 1.0)]
    assert [(r.n, r["mean"]) for r in out if r.window.start.hour == 11] == [(2, 6.0)]


@pytest.mark.parametrize("limit", [0, 5, 10_000])
def test_percentiles_by_ranges_are_exact(spark, monkeypatch, limit):
    """Ties, one value, two values, huge and tiny values, null keys and values that are no numbers."""
    monkeypatch.setattr(records, "SORTED", limit)
    monkeypatch.setattr(records, "STRIPES", 7)
    rng = np.random.default_rng(limit)
    groups = {"same": [3.5] * 50, "one": [1.0], "two": [1.0, 2.0], "ties": rng.integers(0, 4, 101).astype(float).tolist(), "wide": [-1.7e308, 1.7e308, 0.0, 1e-300, -1e-300, 5.0], "normal": rng.normal(size=333).tolist(), None: rng.exponential(size=64).tolist()}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), ("same", float("nan")), ("one", float("inf")), ("nan", float("nan"))]
    got = records.range_percentiles(spark.createDataFrame(rows, "k string, x double"), "x", {"p0": 0.0, "p30": 0.3, "p50": 0.5, "p100": 1.0}, "k").collect()
    assert {r.k for r in got} == set(groups)
    for r in got:
        v = np.sort(groups[r.k])
        assert r.n == len(v)
        for name, share in (("p0", 0.0), ("p30", 0.3), ("p50", 0.5), ("p100", 1.0)):
            place = share * (len(v) - 1)
            a, b, w = v[int(np.floor(place))], v[int(np.ceil(place))], place - np.floor(place)
            assert r[name] == pytest.approx(a * (1 - w) + b * w)
    assert records.range_percentiles(spark.createDataFrame([], "k string, x double"), "x", {"p": 0.5}, "k").count() == 0
