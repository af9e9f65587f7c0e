import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.functions import text as t
from lectern.sources import artefacts


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_expand_cjk_and_fold_case(spark):
    texts = ["Hello WORLD", "東京都", "a|b", "日", "ab東京cd", "x​y", ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string").select("i", t.tokens(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == [["hello", "world"], ["東京", "京都"], ["a", "b"], ["日"], ["ab", "東京", "cd"], ["xy"], []]


def test_nfkc_folds_full_width(spark):
    r = spark.createDataFrame([("ＡＢＣ",), (None,)], "s string").select(t.tokens(t.nfkc("s")).alias("t")).collect()
    assert r[0].t == ["abc"] and r[1].t is None


def test_normalize_text(spark):
    assert one(spark, t.normalize_text(F.lit("# Title\n- item<br/>two\n1. three | `x`")).alias("x")).x == "title item two three x"
    # white space of every script is one blank, at the ends none
    assert one(spark, t.normalize_text(F.lit("\u3000a\u00a0\u2003b\x1c\u0663. c\u2028")).alias("x")).x == "a b \u0663. c"


def test_tokens_are_composed(spark):
    texts = ["ＡＢＣ ﬁne", "e\u0301te\u0301", "plain", "½ x", None]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.tokens(F.col("s")).alias("t")).orderBy("i").collect()]
    assert got == [["abc", "fine"], ["été"], ["plain"], ["1⁄2", "x"], None]


def test_what_composition_may_change_is_told_by_rule():
    import re
    import unicodedata

    pattern = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), t._unsettled()))
    for c in map(chr, (*range(0x20, 0xD800), *range(0xE000, 0x30000))):
        assert pattern.match(c) or (unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c))


def test_error_rates(spark):
    r = one(spark, t.character_error_rate(F.lit("kitten"), F.lit("sitting")).alias("c"), t.character_error_rate(F.lit(""), F.lit("x")).alias("n"), t.word_error_rate(F.lit("a b c"), F.lit("a x c d")).alias("w"), t.word_error_rate(F.lit("é"), F.lit("e")).alias("u"))
    assert r.c == pytest.approx(3 / 6) and r.n is None and r.w == pytest.approx(2 / 3) and r.u == 1.0


def test_f1_parts_of_empty_sides(spark):
    r = one(spark, *(t.f1_parts(F.lit(m), F.lit(p), F.lit(q)).alias(n) for n, m, p, q in (("both", 0, 0, 0), ("one", 0, 3, 0), ("some", 2, 4, 2))))
    assert r.both.f1 == 1.0 and r.one.f1 == 0.0 and r.some.f1 == pytest.approx(2 / 3)


def test_small_formats(spark):
    r = one(spark, t.ratio_claim(F.lit(1.1)).alias("a"), t.ratio_claim(F.lit(2.34)).alias("b"), t.page_filename(F.lit(7), F.lit(120)).alias("c"), t.runtime_version(F.lit("rel-1.2.3")).alias("d"), t.runtime_version(F.lit("rel-1.2")).alias("e"), t.probability(F.lit("NaN")).alias("f"), t.probability(F.lit("0.5")).alias("g"), t.signed_delta(F.lit(0.5)).alias("h"), t.utc_text(F.lit(86399)).alias("i"))
    assert tuple(r) == (None, "2.3x", "page_007.png", "1.2.3", None, None, 0.5, "+0.500", "1970-01-01T23:59:59Z")


def test_iou(spark):
    box = lambda *v: {k: F.lit(float(x)) for k, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)}
    r = one(spark, g.iou(box(0, 0, 2, 2), box(1, 1, 3, 3)).alias("a"), g.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("b"))
    assert r.a == pytest.approx(1 / 7) and r.b == 0.0


def test_rotation_round_trip(spark):
    """A quad turned with its page and back is the quad, whichever corner comes first."""
    w, h, q = 100.0, 60.0, [(10.0, 5.0), (40.0, 8.0), (38.0, 20.0), (9.0, 18.0)]
    turned = {90: [(h - y, x) for x, y in q], 180: [(w - x, h - y) for x, y in q], 270: [(y, w - x) for x, y in q]}
    for degrees, points in turned.items():
        r = one(spark, g.unrotate(g.quad(*((F.lit(x), F.lit(y)) for x, y in points)), F.lit(degrees), F.lit(w), F.lit(h)).alias("u"))
        assert [(p.x, p.y) for p in r.u] == q


def test_budget_is_the_largest_that_fits(spark):
    for w, h in ((3630, 2777), (100, 4000), (31, 33)):
        fits = [c for c in range(1, 2561) if -(-max(1, int(w * min(max(w, h), c) / max(w, h))) // 32) * 32 * -(-max(1, int(h * min(max(w, h), c) / max(w, h))) // 32) * 32 <= 500_000]
        assert one(spark, g.budget_canvas(F.lit(w), F.lit(h), 2560, 500_000).alias("c")).c == max(fits)


def test_time_statistics(spark):
    gnu = "boom: x\nMaximum resident set size (kbytes): 2000\nUser time (seconds): 1.5\nSystem time (seconds): 0.25\n"
    bsd = "oops\n 2.00 real 1.00 user 0.50 sys\n  3000000  maximum resident set size\n"
    r = spark.createDataFrame([(gnu,), (bsd,), ("",)], "s string").select(artefacts.peak_mb(F.col("s")).alias("m"), artefacts.cpu_seconds(F.col("s")).alias("c"), artefacts.without_statistics(F.col("s")).alias("o")).collect()
    assert r[0].m == pytest.approx(2.048) and r[0].c == 1.75 and r[1].m == 3.0 and r[1].c == 1.5 and r[2].m is None and r[2].c is None


def test_batch_json_of_one_and_many(spark):
    one_image = '{"image": "a.png", "lines": [{"quad": {"points": [{"x": 1, "y": 2}]}, "text": "t", "confidence": 0.5}]}'
    rows = spark.createDataFrame([(one_image,), (f'[{one_image}, {{"image": "b.png", "error": "bad"}}]',)], "value string")
    got = artefacts.batch_results(rows).collect()
    assert sorted((r.image, r.error) for r in got) == [("a.png", None), ("a.png", None), ("b.png", "bad")]


def test_marked_region(spark):
    doc = "x <!--a--> old <!--b--> y"
    r = one(spark, artefacts.replace_marked(F.lit(doc), "<!--a-->", "<!--b-->", F.lit("n$1\\w")).alias("a"), artefacts.replace_marked(F.lit("none"), "<!--a-->", "<!--b-->", F.lit("n")).alias("b"))
    assert r.a == "x <!--a-->\nn$1\\w\n<!--b--> y" and r.b is None
