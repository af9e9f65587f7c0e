import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import components, decoding, engine, grouping, imaging, records, scoring


def logits(spark, crops):
    rows = [(i, t, c, float(v)) for i, steps in enumerate(crops) for t, row in enumerate(steps) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "crop_id bigint, t int, class int, v double")


def chars(spark, s="abc"):
    return spark.createDataFrame([(k, c) for k, c in enumerate(s, 1)], "class int, ch string")


def test_greedy_decode_collapses_steps_and_weighs_all(spark):
    # a, a, blank, a, b with probability 3/4 each over two live classes
    peak = lambda c: [np.log(3.0) if k == c else 0.0 if k == (0 if c else 1) else -1e3 for k in range(4)]
    got = decoding.greedy_decode(logits(spark, [[peak(1), peak(1), peak(0), peak(1), peak(2)], [peak(0)], [peak(1)]]), chars(spark)).orderBy("crop_id").collect()
    assert [r.text for r in got] == ["aab", "", "a"]
    assert got[0].confidence == pytest.approx(0.75 ** (4 * 2 / 2.0)) and got[1].confidence == 0.0 and got[2].confidence == pytest.approx(0.5625)


def test_all_ignored_is_empty(spark):
    got = decoding.greedy_decode(logits(spark, [[[0, 5, 1, 0]]]), chars(spark), decoding.ignored_classes(chars(spark), block="ab")).first()
    assert got.text in ("", "c") and 0 <= got.confidence <= 1


def test_allowlist_wins_and_keeps_blank(spark):
    assert sorted(r[0] for r in decoding.ignored_classes(chars(spark), "a", "a").collect()) == [2, 3]
    assert sorted(r[0] for r in decoding.ignored_classes(chars(spark), "", "a").collect()) == [1]


def test_beam_matches_exhaustive_on_clear_rows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p = rng.dirichlet([0.05] * 3, 4)
        best = decoding.beam_labels(p.tolist(), 50)
        total = {}
        for path in itertools.product(range(3), repeat=4):
            out = tuple(c for k, c in enumerate(path) if c and (k == 0 or path[k - 1] != c))
            total[out] = total.get(out, 0) + np.prod([p[t, c] for t, c in enumerate(path)])
        top = max(total.values())
        if top > 0.9:
            assert total[tuple(c for c in best if c)] == pytest.approx(top)


def test_retry_takes_equal_second(spark):
    a = spark.createDataFrame([(1, "x", 0.05), (2, "y", 0.5)], "crop_id bigint, text string, confidence double")
    b = spark.createDataFrame([(1, "z", 0.05), (2, "w", 0.9)], "crop_id bigint, text string, confidence double")
    assert sorted(tuple(r) for r in decoding.retry(a, b).collect()) == [(1, "z", 0.05), (2, "y", 0.5)]


def test_lines_match_a_plain_loop(spark):
    rng = random.Random(5)
    boxes = [(i, n, float(rng.randrange(300)), float(rng.randrange(60)), 0.0, 0.0) for i in range(30) for n in range(rng.randrange(1, 12))]
    boxes = [(i, n, x, y, x + rng.randrange(5, 60), y + rng.randrange(5, 30)) for i, n, x, y, _, _ in boxes]
    df = spark.createDataFrame(boxes, "image_id bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double")
    got = {(r.image_id, r.box_no): r.line_no for r in grouping.line_numbers(df).collect()}
    for i in range(30):
        line, mine = 0, []
        for b in sorted((b for b in boxes if b[0] == i), key=lambda b: ((b[3] + b[5]) / 2, b[1])):
            c, h = (b[3] + b[5]) / 2, b[5] - b[3]
            if mine and abs(sum(m[0] for m in mine) / len(mine) - c) >= 0.5 * sum(m[1] for m in mine) / len(mine):
                line, mine = line + 1, []
            mine.append((c, h))
            assert got[i, b[1]] == line


def test_merge_boundary_on_height(spark):
    make = lambda hs: spark.createDataFrame([(1, k, 30.0 * k, 0.0, 30.0 * k + 28, float(h)) for k, h in enumerate(hs)], "image_id bigint, box_no bigint, x0 double, y0 double, x1 double, y1 double")
    assert grouping.merged_lines(make([30, 30, 44])).count() == 1
    assert grouping.merged_lines(make([30, 30, 46])).count() == 2


def test_components_match_flood_fill(spark):
    rng = np.random.default_rng(1)
    grid = rng.random((14, 17)) < 0.5
    rows = [(0, int(y), int(x), float(grid[y, x]), 0.0) for y, x in np.ndindex(*grid.shape)]
    got = components.label_components(components.foreground(spark.createDataFrame(rows, "image_id bigint, y int, x int, region double, link double")))
    labels = {(r.y, r.x): r.label for r in got.collect()}
    seen, n = {}, 0
    for y, x in np.ndindex(*grid.shape):
        if grid[y, x] and (y, x) not in seen:
            n += 1
            todo = [(y, x)]
            while todo:
                p = todo.pop()
                if p in seen or not (0 <= p[0] < 14 and 0 <= p[1] < 17) or not grid[p]:
                    continue
                seen[p] = n
                todo += [(p[0] + a, p[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    assert labels == seen


def test_min_area_rect_of_a_turned_square():
    turned = np.array([[np.cos(0.5), -np.sin(0.5)], [np.sin(0.5), np.cos(0.5)]]) @ np.array([[0, 4, 4, 0], [0, 0, 2, 2]])
    box = np.array(components.min_area_rect(turned.T))
    sides = [np.hypot(*(box[k] - box[(k + 1) % 4])) for k in range(4)]
    assert sorted(sides) == pytest.approx([2, 2, 4, 4])


def test_rotation_needs_agreement(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    r = spark.range(1).select(components.pick_rotation(arr(1, 2, 1, 1), arr(1, 3, 1, 1)).alias("a"), components.pick_rotation(arr(1, 2, 1, 1), arr(1, 1, 3, 1)).alias("b"), components.pick_rotation(arr(1, 1.04, 1, 1), arr(1, 3, 1, 1)).alias("c"), components.pick_rotation(arr(0, 2, 2, 1), arr(0, 2, 2, 0)).alias("d")).first()
    assert tuple(r) == (90, 0, 0, 90)


def test_greedy_match_and_reading_order(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.9), (1, 1, 0, 0.95), (1, 1, 1, 0.2)], "image_id bigint, pred bigint, ref bigint, iou double")
    assert sorted((r.pred, r.ref) for r in scoring.greedy_match(pairs).collect()) == [(0, 1), (1, 0)]
    rows = spark.createDataFrame([(1, "a b c d x x", "a c b d x"), (2, "a b", "a b")], "k int, h string, r string")
    got = {r.k: (r.anchors, r.score) for r in scoring.reading_order(rows, "h", "r", "k").collect()}
    assert got[1] == (4, 0.75) and got[2] == (2, None)


def test_gates_and_fallback(spark):
    rows = spark.createDataFrame([(None, 1.0, True), (1.2, 1.0, True), (1.05, 1.0, True), (9.0, 1.0, False), (1.0, None, True), (float("nan"), 1.0, True)], "m double, b double, s boolean")
    why = [r[0] for r in rows.select(records.rss_gate(F.col("m"), F.col("b"), F.col("s"))).collect()]
    assert why[0] == "not measured" and why[1] == "1.200000 against 1.100000" and why[2] is None and why[3:] == ["other host", "no baseline", "not finite"]
    # halves at the seventh place are rounded up; a baseline of nothing holds no gate
    rows = spark.createDataFrame([(2.0, 1.000005), (1.0, 0.0), (1.0, -1.0), (0.5, 1.0)], "m double, b double").withColumn("s", F.lit(True))
    both = [tuple(r) for r in rows.select(records.rss_gate(F.col("m"), F.col("b"), F.col("s")), records.throughput_gate(F.col("m"), F.col("b"), F.col("s"))).collect()]
    assert both[0] == ("2.000000 against 1.100006", None) and both[1:3] == [("no positive baseline",) * 2] * 2 and both[3] == (None, "0.500000 against 0.900000")


def test_contracts_of_another_version_are_an_error(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "stem string, v int")
    assert records.versioned(rows, "v", 1).count() == 2 and records.versioned(rows.limit(0), "v", 1).count() == 0
    for wrong in (F.lit(2), F.lit(None).cast("int")):
        with pytest.raises(Exception, match="unsupported schema version"):
            records.versioned(rows.withColumn("v", wrong), "v", 1).collect()
    group = spark.createDataFrame([("a", "labeled", None, 1.0), ("b", "breadth", None, 1.0), ("c", "labeled", "why", 1.0), ("d", "labeled", None, None)], "stem string, group string, skipped string, f1 double")
    assert [tuple(r) for r in records.guardrails(group, "f1", "stem").collect()] == [("a", 0.9)]


def test_engine_scores_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, "A b", "a B", "a b c"), (2, "", "", ""), (3, "x", "", "x y"), (4, "ＡＢ", "ab", "ab")], "k int, a string, b string, t string")
    got = {r.k: r for r in scoring.engine_scores(rows, "a", "b", "t", "k").collect()}
    assert got[1].word_f1 == 1.0 and got[1].first_token_f1 == pytest.approx(0.8) and got[2].char_f1 == 1.0 and got[2].first_cer is None
    assert got[3].word_f1 == 0.0 and got[3].second_token_f1 == 0.0 and got[3].first_cer == pytest.approx(2 / 3) and got[4].word_f1 == 1.0


def test_boxes_in_the_task_are_those_of_the_pixel_table(spark):
    rng = np.random.default_rng(6)
    blocks = lambda v: np.kron(v, np.ones((5, 6)))
    region, link = blocks((rng.random((6, 8)) < 0.25) * (0.6 + 0.4 * rng.random((6, 8)))) * (rng.random((30, 48)) < 0.95), blocks((rng.random((6, 8)) < 0.1) * 0.9)
    rows = [(0, int(y), int(x), float(region[y, x]), float(link[y, x])) for y, x in np.ndindex(*region.shape)]
    told = components.boxes(spark.createDataFrame(rows, "image_id bigint, y int, x int, region double, link double"), 30, 48).orderBy("label").collect()
    mine = components.map_boxes(region, link)
    assert len(told) == len(mine) > 1
    for r, box in zip(told, mine, strict=True):
        assert [(p.x, p.y) for p in r.quad] == [pytest.approx(tuple(p)) for p in box]


def test_imaging_helpers():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    assert imaging.grey(np.array([[[100, 150, 200]]], np.uint8))[0, 0] == 141
    assert (imaging.decode(b"P6\n# c\n7 5\n255\n" + rgb.tobytes()) == rgb).all()
    rows = b"".join(b"\0" + r.tobytes() for r in rgb)
    import zlib

    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes((8, 2, 0, 0, 0))) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert (imaging.decode(png) == rgb).all()
    ramp = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert imaging.crop_box(ramp, -1, 0, 2, 2).tolist() == [[0, 1], [4, 5]]
    with pytest.raises(ValueError):
        imaging.crop_box(ramp, 5, 0, 9, 2)
    assert imaging.crop_quad(ramp, np.array([[0, 0], [3, 0], [3, 2], [0, 2]], float)).shape == (2, 3)
    assert (imaging.rotate(imaging.rotate(rgb, 90), 270) == rgb).all()
    c, high, low = imaging.contrast(np.array([0, 50, 100, 150, 200]))
    assert (high, low, c) == (180, 20, pytest.approx(0.8))
    assert imaging.recognizer_rows([np.zeros((32, 10), np.uint8)]).shape == (1, 1, 64, 64)
    assert (imaging.resize(np.full((6, 9), 77, np.uint8), 4, 3, "catmull-rom") == 77).all()


def test_reader_end_to_end_with_stub_models(spark):
    """A bright bar is found where it is; the recogniser spells by brightness."""

    def detector(x):
        h, w = x.shape[1] // 2, x.shape[2] // 2
        lum = x.mean(axis=0)[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3))
        region = (lum > 0).astype(np.float32)
        return np.stack([region, np.zeros_like(region)], axis=-1)

    def recognizer(x):
        out = np.full((1, 4, 3), -9.0)
        out[0, :2, 1] = 9
        out[0, 2:, 2] = 9
        return out

    batched = []

    def many(x):
        batched.append(len(x))
        return np.concatenate([recognizer(x[k : k + 1]) for k in range(len(x))])

    page = np.zeros((96, 160, 3), np.uint8)
    page[30:50, 20:120] = 255
    df = spark.createDataFrame([(1, (160, 96, bytearray(page.tobytes()))), (2, (160, 96, bytearray(160 * 96 * 3)))], f"image_id bigint, image {imaging.IMAGE}")
    reader = engine.Reader(detector, recognizer, "xy")
    got = reader.readtext(df).collect()
    assert [(r.image_id, r.line_no, r.text) for r in got] == [(1, 0, "xy")] and got[0].confidence > 0.9
    xs = [p.x for p in got[0].quad]
    assert 10 <= min(xs) <= 24 and 116 <= max(xs) <= 132
    assert {r.image_id for r in reader.recognize_line(df).collect()} == {1, 2}
    # every model call is behind a written stage
    assert "MapInPandas" not in reader.readtext(df)._jdf.queryExecution().explainString(reader_mode(spark))
    page[70:90, 20:120] = 255
    two = spark.createDataFrame([(1, (160, 96, bytearray(page.tobytes())))], f"image_id bigint, image {imaging.IMAGE}")
    single, batch = (sorted(map(str, engine.Reader(detector, many, "xy", recognition=engine.Recognition(batch_size=n)).readtext(two).collect())) for n in (1, 16))
    assert len(single) == 2 and single == batch
    with pytest.raises(ValueError):
        engine.Recognition(decoder="wordbeamsearch")


def reader_mode(spark):
    return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")


@pytest.mark.parametrize("degrees", [0, 90, 180, 270])
def test_reader_turns_pages_upright(spark, degrees):
    """A mark in the upright page's corner tells the detector which way is up; quads come back in the page's own frame."""

    def detector(x):
        h, w = x.shape[1] // 2, x.shape[2] // 2
        lum = x.mean(axis=0)[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3))
        region = (lum > 0).astype(np.float32)
        up = 1.0 if lum[:4, :4].min() > 0 else 0.5
        return np.stack([region * (0.5 + up / 2), region * up * 0.8], axis=-1)

    def recognizer(x):
        out = np.full((1, 2, 3), -9.0)
        out[0, 0, 1] = out[0, 1, 0] = 9
        return out

    upright = np.zeros((128, 192, 3), np.uint8)
    upright[:12, :12] = 255
    upright[60:80, 40:150] = 255
    page = np.ascontiguousarray(imaging.rotate(upright, degrees))
    ys, xs = np.nonzero(imaging.rotate(np.pad(np.ones((20, 110)), ((60, 48), (40, 42))), degrees))
    df = spark.createDataFrame([(1, (page.shape[1], page.shape[0], bytearray(page.tobytes())))], f"image_id bigint, image {imaging.IMAGE}")
    reader = engine.Reader(detector, recognizer, "xy", engine.Detection(orientation=True, min_size=40.0))
    assert reader.oriented(df).first().rotation == -degrees % 360
    for got in (reader.readtext(df).collect(), reader.detect(df).collect()):
        assert len(got) == 1
        x, y = [p.x for p in got[0].quad], [p.y for p in got[0].quad]
        assert [min(x), max(x), min(y), max(y)] == pytest.approx([xs.min(), xs.max(), ys.min(), ys.max()], abs=12)


@pytest.mark.parametrize("orientation", [False, True])
def test_failed_pages_have_one_row_that_says_why(spark, orientation):
    """Pages of one brightness each: 40 fails in the detector, 80 in the recogniser, 120 is read; one has no image at all."""

    def bright(x):
        return int(round(float(x.max()) * 58.4 + 123.7))  # the first channel's mean and deviation, undone

    def detector(x):
        if bright(x[:1]) == 40:
            raise RuntimeError("no scores")
        h, w = x.shape[1] // 2, x.shape[2] // 2
        lum = x.mean(axis=0)[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3))
        region = (lum > lum.min() + 0.1).astype(np.float32)
        return np.stack([region, np.zeros_like(region)], axis=-1)

    def recognizer(x):
        if 60 < (float(x.max()) + 1) * 127.5 < 105:
            raise RuntimeError("no text")
        out = np.full((1, 2, 3), -9.0)
        out[0, 0, 1] = out[0, 1, 2] = 9
        return out

    def page(level):
        px = np.zeros((96, 160, 3), np.uint8)
        px[30:50, 20:120] = level
        return (160, 96, bytearray(px.tobytes()))

    df = spark.createDataFrame([(1, page(40), None), (2, page(80), None), (3, page(120), None), (4, None, "unsupported image format")], f"image_id bigint, image {imaging.IMAGE}, error string")
    reader = engine.Reader(detector, recognizer, "xy", engine.Detection(orientation=orientation), engine.Recognition(contrast_ths=0.0))
    told = {r.image_id: (r.text, r.error) for r in reader.readtext(df).collect()}
    assert told == {1: (None, "no scores"), 2: (None, "no text"), 3: ("xy", None), 4: (None, "unsupported image format")}
    regions = {r.image_id: (r.quad is None, r.error) for r in reader.detect(df).collect()}
    assert regions == {1: (True, "no scores"), 2: (False, None), 3: (False, None), 4: (True, "unsupported image format")}
    lines = {r.image_id: (r.text, r.quad is None, r.error) for r in reader.recognize_line(df).collect()}
    assert lines == {1: ("xy", False, None), 2: (None, True, "no text"), 3: ("xy", False, None), 4: (None, True, "unsupported image format")}


def test_bad_images_are_rows(spark):
    files = spark.createDataFrame([(1, bytearray(b"nothing")), (2, bytearray(b"P5\n1 1\n255\n\x07"))], "image_id bigint, content binary")
    got = {r.image_id: (r.image, r.error) for r in imaging.decode_images(files).collect()}
    assert got[1] == (None, "unsupported image format") and got[2][0].rgb8 == bytearray(b"\x07\x07\x07")
