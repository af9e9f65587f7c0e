"""Written stages: what is deleted, and what is told of them."""

from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from lectern.operators import engine, imaging, records, stages
from lectern.sources import images


def tables(spark):
    return {p.name for p in Path(stages.shared_dir(spark).removeprefix("file:")).iterdir()}


def test_scratch_tables_go_at_the_end_of_their_block(spark):
    before = tables(spark)
    with stages.scratch(spark) as paths:
        kept, path = stages.replaceable(spark.range(3), "kept")
        paths.remove(path)
        with stages.scratch(spark):
            stages.materialize(spark.range(1), "inner")
        assert len(tables(spark) - before) == 1
        stages.materialize(spark.range(5), "gone")
    assert [n.split("-")[0] for n in tables(spark) - before] == ["kept"] and kept.count() == 3


def test_progress_tells_rows_and_errors_of_each_stage_without_jobs_of_its_own(spark):
    def detector(x):
        h, w = x.shape[1] // 2, x.shape[2] // 2
        region = (x.mean(axis=0)[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3)) > 0).astype(np.float32)
        return np.stack([region, np.zeros_like(region)], axis=-1)

    def recognizer(x):
        return np.array([[[-9.0, 9.0], [9.0, -9.0]]])

    px = np.zeros((96, 160, 3), np.uint8)
    px[30:50, 20:120] = 255
    df = spark.createDataFrame([(1, (160, 96, bytearray(px.tobytes())), None), (2, None, "unsupported image format")], f"image_id bigint, image {imaging.IMAGE}, error string")
    told, tracker = [], spark.sparkContext.statusTracker()

    def jobs(run):
        spark.sparkContext.setJobGroup(run, run)
        return lambda: len(tracker.getJobIdsForGroup(run))

    reader = engine.Reader(detector, recognizer, "x")
    plain = jobs("plain")
    reader.readtext(df).count()
    n, seen = plain(), jobs("seen")
    with stages.watched(lambda *x: told.append(x)) as progress:
        reader.readtext(df).count()
    assert seen() == n
    by = {stage: (rows, failed) for _, stage, _, _, rows, failed in progress.events}
    assert by["boxes"] == (2, 1) and by["regions"] == by["crops"] == by["read"] == (1, 0) and told == [(e[1], e[4], e[5]) for e in progress.events]
    stages.materialize(df.select("image_id"), "later")
    assert len(told) == len(progress.events)
    events = progress.table(spark)
    assert [r.stage for r in events.orderBy("no").collect()] == [t[0] for t in told]
    spent = records.stage_durations(events.withColumn("run", F.lit(1)), "run", "ts", "stage").collect()
    assert {r.stage for r in spent} == set(by) and all(r.seconds is None or r.seconds >= 0 for r in spent)


def test_images_of_every_format_that_java_reads(spark, tmp_path):
    """Files as Java writes them, one that only the own decoder reads, one that none does, in folders of folders."""
    jvm = spark._jvm
    kinds = jvm.java.awt.image.BufferedImage
    rng = np.random.default_rng(0)
    flat = np.repeat(np.repeat(rng.integers(0, 256, (2, 3, 3)), 8, axis=0), 8, axis=1).astype(np.uint8)
    for name, kind in (("png", kinds.TYPE_INT_RGB), ("gif", kinds.TYPE_INT_RGB), ("bmp", kinds.TYPE_INT_RGB), ("jpg", kinds.TYPE_INT_RGB), ("alpha.png", kinds.TYPE_INT_ARGB)):
        image = kinds(24, 16, kind)
        for y in range(16):
            for x in range(24):
                r, g, b = map(int, flat[y, x])
                image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
        (tmp_path / "in").mkdir(exist_ok=True)
        assert jvm.javax.imageio.ImageIO.write(image, name.split(".")[-1], jvm.java.io.File(f"{tmp_path}/in/a.{name}"))
    (tmp_path / "p.ppm").write_bytes(b"P6\n24 16\n255\n" + flat.tobytes())
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[-1]: r for r in images.images(spark, str(tmp_path)).collect()}
    assert len(got) == 7 and got["bad.png"].image is None and got["bad.png"].error == "unsupported image format"
    for name in ("a.png", "a.bmp", "a.gif", "a.alpha.png", "p.ppm", "a.jpg"):
        px = imaging.as_array(got[name].image.asDict())
        assert got[name].error is None and px.shape == flat.shape
        off = np.abs(px.astype(int) - flat).max()
        assert off == 0 if name not in ("a.jpg", "a.gif") else np.abs(px.astype(int) - flat).mean() < 40
    told = {r.extension: r.decoder for r in images.formats(spark).collect()}
    assert told["png"] == told["jpg"] == told["gif"] == told["bmp"] == "image source" and told["ppm"] == "own"
