"""One-to-one matching against going through all pairs in order."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions import geometry as g
from lectern.operators import matching
from lectern.plans import matches

FOLDER = "/root/testdata/sf0.001"


def greedy(rows):
    best = {}
    for group, p, r, s in rows:
        best[group, p, r] = max(s, best.get((group, p, r), s))
    preds, refs, out = set(), set(), []
    for (group, p, r), s in sorted(best.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (group, p) not in preds and (group, r) not in refs:
            preds.add((group, p))
            refs.add((group, r))
            out.append((group, p, r, s))
    return sorted(out)


@pytest.mark.parametrize("sweep", [0, 5, 2000])
def test_rounds_give_the_greedy_matches(spark, sweep):
    """Ties, repeated pairs, a chain that rounds shorten slowly, a number that most pairs share, groups of one pair."""
    rng = np.random.default_rng(sweep)
    rows = [(int(a), int(b), int(c), round(float(d), 1)) for a, b, c, d in zip(rng.integers(0, 4, 400), rng.integers(0, 20, 400), rng.integers(0, 20, 400), rng.random(400), strict=True)]
    rows += [(9, k // 2, (k + 1) // 2, k / 100) for k in range(12)] + [(10, 0, k, 0.5) for k in range(40)] + [(11, 5, 5, 1.0)]
    df = spark.createDataFrame(rows, "page int, pred int, ref int, score double")
    assert sorted(tuple(r) for r in matching.dominant_match(df, "page", sweep).collect()) == greedy(rows)


def test_nothing_matches_nothing(spark):
    df = spark.createDataFrame([], "page string, pred bigint, ref bigint, score double")
    assert matching.dominant_match(df, "page").count() == 0


def test_a_page_of_many_pairs(spark):
    """100,000 pairs of one page, in rounds down to what one task goes through."""
    pairs = spark.range(100_000).selectExpr("'p' as page", "id % 499 as pred", "(id * 7919) % 503 as ref", "(id * 104729 % 1000) / 1000 as score")
    got = matching.dominant_match(pairs, "page", 500)
    rows = [tuple(r) for r in pairs.collect()]
    assert sorted(tuple(r) for r in got.collect()) == greedy(rows)


def test_candidates_are_all_pairs_above_the_threshold(spark):
    rng = np.random.default_rng(4)
    sides = ("x0", "y0", "x1", "y1")
    at, size = rng.integers(-50, 400, (150, 2)), 2.0 ** rng.integers(0, 9, (150, 2)) + rng.integers(1, 9, (150, 2))
    rows = [(int(k % 3), int(k), *map(float, a), *map(float, a + s)) for k, (a, s) in enumerate(zip(at, size, strict=True))]
    rows += [(r[0], r[1] + 1000, *(v + float(d) for v, d in zip(r[2:], rng.integers(-2, 3, 4), strict=True))) for r in rows] + [(None, 5000, 0.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "page int, no bigint, x0 double, y0 double, x1 double, y1 double")
    a, b = ({k: F.col(f"{n}.{k}") for k in sides} for n in ("p", "r"))
    for least in (0.34, 0.1, 0.9):
        blocks = matching.cells(*(F.col(k) for k in sides), least)
        got = matching.candidates(boxes.filter("no < 1000"), boxes.filter("no >= 1000"), "page", "no", blocks, g.iou(a, b), least)

        def iou(p, r):
            met = max(0, min(p[4], r[4]) - max(p[2], r[2])) * max(0, min(p[5], r[5]) - max(p[3], r[3]))
            return met / ((p[4] - p[2]) * (p[5] - p[3]) + (r[4] - r[2]) * (r[5] - r[3]) - met)

        want = sorted((p[0], p[1], r[1]) for p in rows for r in rows if p[1] < 1000 <= r[1] and p[0] == r[0] is not None and iou(p, r) >= least)
        assert sorted((r.page, r.pred, r.ref) for r in got.collect()) == want and len(want) > 20
    assert boxes.select(F.max(F.size(matching.cells(*(F.col(k) for k in sides), 0.4)))).first()[0] <= 36


def test_any_similarity_and_block(spark):
    rows = [(1, 0, ["a", "b"]), (1, 1, ["b", "c"]), (1, 2, None), (1, 3, []), (2, 4, ["a"])]
    df = spark.createDataFrame(rows, "page int, no int, words array<string>")
    met = F.size(F.array_intersect("p.words", "r.words"))
    pairs = matching.candidates(df, df, "page", "no", F.col("words"), met, 1.0)
    assert sorted((r.pred, r.ref, r.score) for r in pairs.collect()) == [(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0), (4, 4, 1.0)]
    assert sorted((r.pred, r.ref) for r in matching.dominant_match(pairs, "page").collect()) == [(0, 0), (1, 1), (4, 4)]
    assert matching.candidates(df, df, "page", "no", F.col("words"), F.lit(float("nan")), 0.0).count() == 0


def as_sql(query, folder, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return sorted(con.execute(matches.QUERIES[query]).fetchall())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_blocks_of_boxes_meet_once(spark):
    """All pairs by centres too, without rows that carry their blocks: boxes of many sizes and places, and boxes that are none."""
    rng = np.random.default_rng(5)
    sides = ("x0", "y0", "x1", "y1")
    at, size = rng.integers(-50, 400, (150, 2)), 2.0 ** rng.integers(0, 9, (150, 2)) + rng.integers(0, 9, (150, 2))
    rows = [(int(k % 3), int(k), *map(float, a), *map(float, a + s)) for k, (a, s) in enumerate(zip(at, size, strict=True))]
    rows += [(r[0], r[1] + 1000, *(v + float(d) for v, d in zip(r[2:], rng.integers(-2, 3, 4), strict=True))) for r in rows] + [(0, k, 1.0, 1.0, x, 9.0) for x in (1.0, 0.0, float("nan"), float("inf"), None) for k in (900, 1900)]
    rows += [(0, 901, 0.0, 0.0, 64.0, 64.0), (0, 1901, 0.0, 0.0, 64.0, 64.0), (0, 1902, 1e9, 1e9, 1e9 + 16, 1e9 + 16), (0, 902, 1e9, 1e9, 1e9 + 16, 1e9 + 16), (None, 5000, 0.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "page int, no bigint, x0 double, y0 double, x1 double, y1 double")
    pred, ref = boxes.filter("no < 1000"), boxes.filter("no >= 1000").withColumn("page", F.col("page").cast("bigint"))
    a, b = ({k: F.col(f"{n}.{k}") for k in sides} for n in ("p", "r"))
    # least() and greatest() pass over nulls, so a box without a side would count
    every = pred.dropna().alias("p").join(ref.dropna().alias("r"), F.col("p.page") == F.col("r.page")).select("p.page", F.col("p.no").alias("pred"), F.col("r.no").alias("ref"), g.iou(a, b).alias("score"))
    for least in (0.34, 0.1, 0.9, 1.0):
        blocks = matching.centre_cells(*(F.col(k) for k in sides), least)
        got = matching.candidates(pred, ref, "page", "no", blocks, g.iou(a, b), least, g.iou(a, b) > 0)
        want = sorted(tuple(r) for r in every.filter((F.col("score") >= least) & ~F.isnan("score")).collect())
        assert sorted(tuple(r) for r in got.collect()) == want and len(want) >= 2
    of_pred, of_ref = matching.centre_cells(*(F.col(k) for k in sides), 0.4)
    sound = boxes.filter("x1 > x0 and y1 > y0 and not isnan(x1) and x1 < 1e300").count()
    assert of_pred(boxes).count() == sound and of_ref(boxes).count() <= 8 * sound


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined as large ones are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_boxes_that_lie_by_page_are_not_shuffled_by_block(spark, no_broadcast):
    b = spark.range(400).selectExpr("id % 7 as page", "id * 37 % 90 as x", "id * 11 % 70 as y").withColumn("no", F.row_number().over(Window.partitionBy("page").orderBy("x", "y")))
    b = b.selectExpr("page", "no", "x + 0d as x0", "y + 0d as y0", "x + 40d as x1", "y + 40d as y1")
    a, c = ({k: F.col(f"{n}.{k}") for k in ("x0", "y0", "x1", "y1")} for n in ("p", "r"))
    pairs = lambda: matching.candidates(b.filter("no % 2 = 0"), b.filter("no % 2 = 1"), "page", "no", matching.centre_cells(*(F.col(k) for k in a), 0.4), g.iou(a, c), 0.4).groupBy("page", "pred", "ref").agg(F.max("score"))
    apart = pairs()
    assert exchanges(apart) > 2
    with matching.by_group(spark):
        together = pairs()
        assert exchanges(together) == 2  # of the window, for either side
        assert sorted(map(tuple, together.collect())) == sorted(map(tuple, apart.collect())) != []


def test_matched_boxes_round_as_the_sql(spark, tmp_path):
    """An IoU of 333/640: its millionfold ends on a half only before it is stored."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES (6748, 2770, 98, 5, 7.0::DOUBLE), (114739, 19018, 98, 2, 37.0)) v(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity)) TO '{tmp_path}/lineitem.parquet'")
    got = [tuple(r) for r in matches.matched_boxes(spark, str(tmp_path)).collect()]
    assert got == as_sql(matches.matched_boxes, tmp_path, "lineitem") == [(98, 2, 1, 0.520312)]


def test_large_pages_are_spread(spark, monkeypatch):
    """Some pages above the bound, and all of them; the result is that of the SQL."""
    want = as_sql(matches.matched_boxes, FOLDER, "lineitem")
    sizes = sorted(r["count"] for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").groupBy("l_suppkey").count().collect())
    for page in (sizes[len(sizes) // 2], 1):
        monkeypatch.setattr(matches, "PAGE", page)
        assert sorted(map(tuple, matches.matched_boxes(spark, FOLDER).collect())) == want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def shuffled_rows(spark, run):
    """Rows that the stages of ``run()`` write for shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(group := f"shuffled-{id(run)}", "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in {s for j in jobs for s in j.stageIds})


def test_turns_are_not_shuffled_by_word(spark, no_broadcast):
    n = spark.read.parquet(f"{FOLDER}/conversations.parquet").count()
    assert 0 < shuffled_rows(spark, lambda: matches.matched_turns(spark, FOLDER).collect()) < 4 * n


def test_turns_of_any_conversation_as_the_sql(spark, tmp_path, monkeypatch):
    """Long conversations, dealt into parts or not, turns without words, turns that are all alike, a half of the millionth."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(40)]
    rows = [(c, k, ("user", "assistant", "system")[k % 3 if c != 2 else k % 2], " ".join(rng.choice(words, rng.integers(0, 12)))) for c, n in ((0, 60), (1, 9), (2, 40), (3, 1)) for k in range(n)]
    rows += [(4, k, ("user", "assistant")[k % 2], ("same Words", " ", "", None)[k // 4]) for k in range(16)] + [(None, 0, "user", "a"), (None, 1, "assistant", "a"), (5, -1, "user", "a b|c"), (5, -2, "assistant", "A c")]
    rows += [(6, 0, "user", " ".join(f"a{k}" for k in range(333))), (6, 1, "assistant", " ".join(f"a{k}" for k in range(640)))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/made")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{tmp_path}/made/*.parquet') TO '{tmp_path}/conversations.parquet'")
    want = as_sql(matches.matched_turns, tmp_path, "conversations")
    assert len({r[0] for r in want}) == 6 and (6, 0, 1, 0.520312) in want
    for talk, part in ((2000, 500), (12, 7), (0, 1)):
        monkeypatch.setattr(matches, "TALK", talk)
        monkeypatch.setattr(matches, "PART", part)
        assert sorted(map(tuple, matches.matched_turns(spark, str(tmp_path)).collect())) == want
