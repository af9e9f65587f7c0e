"""Providers, sets and digests of models; their way to the tasks; the reader's table function."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import decoding, table_functions
from lectern.sources import models

ROWS = "role string, location string, sha256 string"


def test_first_provider_that_has_a_role(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "role string")
    given, cache = spark.createDataFrame([("b", "x", "1"), (None, "y", "2")], ROWS), spark.createDataFrame([("a", "2", "3"), ("a", "1", "4"), ("b", "0", "5")], ROWS)
    got = {tuple(r) for r in models.provided(wanted, ("given", given), ("cache", cache)).collect()}
    assert got == {("a", "cache", "1", "4"), ("b", "given", "x", "1"), ("c", None, None, None), (None, None, None, None)}
    assert {r.provider for r in models.provided(wanted).collect()} == {None}


def test_descriptors_follow_first_mention(spark):
    registry = spark.createDataFrame([("detector", "finder"), ("en", "e"), ("ko", "k")], "role string, name string").selectExpr("*", "concat('house/', name) as repo", "'1' as revision", "'f' as file", "'d' as sha256")
    asked = spark.createDataFrame([(1, 0, "ko"), (1, 1, "en"), (1, 2, "ko"), (1, 3, "xx"), (2, 0, None)], "config int, place int, language string")
    got = sorted(tuple(r)[:5] + (r.error,) for r in models.descriptors(registry, asked, "config", F.when(F.col("config") == 1, "me")).collect())
    assert got == [(1, 0, "detector", "finder", "me/finder", None), (1, 1, "ko", "k", "me/k", None), (1, 2, "en", "e", "me/e", None), (1, 3, "xx", None, None, "not in the registry"), (2, 0, "detector", "finder", "house/finder", None)]
    assert {r.error for r in models.descriptors(registry, asked.filter("config = 2"), "config", F.lit("../up")).collect()} == {"unsafe owner"}


def test_sets_and_digests(spark):
    one, sha = bytearray(b"one"), hashlib.sha256(b"one").hexdigest()
    rows = [(1, "detector", one, sha.upper()), (1, "en", one, sha), (2, "en", one, sha), (3, "detector", one, sha), (3, "detector", one, sha), (4, "detector", one, sha), (4, "en", one, "00"), (5, "detector", one, ""), (6, "detector", one, None)]
    got = {r.config: r.error for r in models.verified_set(spark.createDataFrame(rows, "config int, role string, content binary, sha256 string"), "config").collect()}
    assert got == {1: None, 2: "no detector", 3: "role given twice: detector", 4: "other digest: en", 5: "no digest: detector", 6: "no digest: detector"}
    pins = spark.createDataFrame([("AB", "ab"), ("", "ab"), (None, "ab"), ("cd", "ab")], "pin string, actual string")
    assert [r[0] for r in pins.select(models.digest_error(F.col("pin"), F.col("actual"), True)).collect()] == [None, None, None, "other digest"]
    assert [r[0] for r in pins.select(models.digest_error(F.col("pin"), F.col("actual"), False)).collect()] == [None, "no digest", "no digest", "other digest"]


def test_a_model_is_sent_once_and_loaded_once_a_worker(spark, tmp_path, monkeypatch):
    """Two readers of one model over many tasks: one file, one load in each Python process; content that was changed is refused."""
    content = b"scale 3"

    def load(raw):
        import os

        with open(f"{tmp_path}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        factor = int(raw.split()[1])
        return lambda x: x * factor

    digest = models.ship(spark, content)
    assert models.ship(spark, content) == digest and sum(digest in f for f in spark.sparkContext.listFiles) == 1
    first, second = models.shipped(digest, load), models.shipped(digest, load)

    def run(model):
        def many(batches):
            for b in batches:
                b["x"] = model(b["x"].to_numpy())
                yield b

        return spark.range(40).repartition(8).selectExpr("id as x").mapInPandas(many, "x bigint").agg(F.sum("x")).first()[0]

    assert run(first) == run(second) == 3 * 780
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 8
    (tmp_path / "changed").write_bytes(b"scale 9")
    monkeypatch.setattr("pyspark.SparkFiles.get", lambda name: str(tmp_path / "changed"))
    with pytest.raises(ValueError, match="other digest"):
        models.shipped(hashlib.sha256(b"scale 4").hexdigest(), load)(1)


def crops(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k // 7, k, (rng.normal(size=(int(rng.integers(0, 9)), 4)) * 4).round(3).tolist(), "kept out") for k in range(n)]
    return spark.createDataFrame(rows, "page int, place bigint, scores array<array<double>>, more string")


@pytest.mark.parametrize("allow, block", [("", ""), ("ac", ""), ("", "b"), ("a", "a")])
def test_table_function_gives_what_the_reader_decodes(spark, allow, block):
    table_functions.register(spark)
    df = crops(spark)
    got = spark.sql("SELECT * FROM read_lines(TABLE({c}) PARTITION BY page ORDER BY place, charset => 'abc', least => 0.2D, allow => :allow, block => :block)", {"allow": allow, "block": block}, c=df).collect()
    long = df.select(F.col("place").alias("crop_id"), F.posexplode("scores").alias("t", "row")).select("crop_id", "t", F.posexplode("row").alias("class", "v"))
    chars = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "class int, ch string")
    read = decoding.greedy_decode(long, chars, decoding.ignored_classes(chars, allow, block) if allow or block else None)
    want = {r.crop_id: (r.text, r.confidence) for r in read.collect() if r.confidence >= 0.2}
    assert want and {r.place: r.text for r in got} == {k: v[0] for k, v in want.items()}
    assert all(r.confidence == pytest.approx(want[r.place][1]) for r in got)
    for page in {r.page for r in got}:
        own = sorted((r.line_no, r.place) for r in got if r.page == page)
        assert [n for n, _ in own] == list(range(len(own))) and own == sorted(own, key=lambda x: x[1])


def test_table_function_says_what_is_wrong(spark):
    table_functions.register(spark)
    df = crops(spark, 3)
    for call, said in (("TABLE({c}) PARTITION BY page, charset => ''", "charset is empty"), ("TABLE({c}) PARTITION BY page, charset => 'a', least => 2D", "filter_ths"), ("TABLE({d}) PARTITION BY page, charset => 'a'", "lack scores"), ("1, charset => 'a'", "table of crops")):
        with pytest.raises(Exception, match=said):
            spark.sql(f"SELECT * FROM read_lines({call})", c=df, d=df.drop("scores")).collect()
    got = spark.sql("SELECT * FROM read_lines(TABLE({c}) PARTITION BY page, charset => 'abc', least => 0)", c=crops(spark, 1).withColumn("scores", F.lit(None).cast("array<array<double>>"))).first()
    assert (got.text, got.confidence) == ("", 0.0)


def test_warm_up_loads_once_in_every_slot(spark, tmp_path):
    digest = models.ship(spark, b"warm")

    def load(raw):
        import os

        with open(f"{tmp_path}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda x: x

    rows = models.warm_up(spark, digest, load, slots=4).collect()
    loads = (tmp_path / "loads").read_text().split()
    assert sorted(r.slot for r in rows) == [0, 1, 2, 3] and len({r.pid for r in rows}) == 4 and sorted(loads) == sorted(str(r.pid) for r in rows)
    again = models.warm_up(spark, digest, load, slots=2).collect()
    assert len(again) == 2 and len((tmp_path / "loads").read_text().split()) <= 4 + 2
    with pytest.raises(ValueError, match="at the same time"):
        models.warm_up(spark, digest, load, slots=500)
    assert [models.thread_budget(*a) for a in ((2,), (64,), (0,), (64, 3))] == [2, 8, 1, 3]
    with pytest.raises(ValueError):
        models.thread_budget(4, 0)
