"""Stages one by one against what they promise."""

import re
from collections import Counter

import corpus_pipeline
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER).cache()
        out.append((docs, after))
        docs = after
    return out


def test_columns_are_kept(staged):
    assert all(a.columns == b.columns for a, b in staged[:-1]) and len(staged) == 5


def test_quality_rejects_poor_and_keeps_good(spark, staged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in staged[0][1].select("doc_id").collect()}
    assert sum(q == 1 and d not in kept for d, q in labels.items()) <= 1
    assert sum(q == 0 and d in kept for d, q in labels.items()) <= 1


def test_one_of_each_group_stays(staged):
    before, after = staged[1]

    def sets(df):
        return {r.doc_id: frozenset(zip(*(r.text.lower().split()[k:] for k in range(5)), strict=False)) or frozenset([tuple(r.text.lower().split())]) for r in df.select("doc_id", "text").collect()}

    a, b = sets(before), sets(after)
    link = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert not any(link(b[i], b[j]) for i in b for j in b if i < j)
    assert all(any(link(a[i], a[j]) for j in a if j < i) for i in a if i not in b)


def test_redaction_leaves_clean_texts(staged):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in staged[2])
    assert before.keys() == after.keys()
    for i, text in after.items():
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
        assert text == before[i] or "[" in text


def test_copies_and_ids(staged):
    mixed = staged[3][1].groupBy("doc_id").count().collect()
    assert all(1 <= r["count"] <= 3 for r in mixed)
    last = staged[4][1].collect()
    assert len(last) == staged[3][1].count() and all(r.restored and r.n_ids == len(r.ids) for r in last)


def test_run_gives_what_the_stages_give(spark, staged):
    key = lambda r: (str(r.doc_id), str(r.source), r.n_ids, r.ids)
    assert sorted(map(key, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(key, staged[-1][1].collect()))


def odd_docs(spark):
    """Documents with null and repeated doc_ids: equal rows, other texts and other sources under one id."""
    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(None, text(f"n{k}x"), s) for k in range(30) for s in ("a", "b", None)]
    rows += [(k, text(f"r{k}x"), s) for k in range(40) for s in ("a", "a", "b")]
    rows += [(k, text(f"o{k}x", 10 + k), "b") for k in range(40)] + [(100, text("r0x", 41), "a"), (100, text("z"), "a"), (101, None, "a"), (None, None, "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_near_dedup_leaves_one_of_repeated_rows_and_of_rows_without_ids(spark):
    docs = odd_docs(spark)
    after = corpus_pipeline._near_duplicates(spark, docs, FOLDER)
    left = Counter((r.doc_id, r.text) for r in after.collect())
    asked = {(r.doc_id, r.text) for r in docs.collect()} - {(100, " ".join(f"r0x{i}" for i in range(41)))}
    assert after.columns == docs.columns and left == Counter(asked)
    again = corpus_pipeline._near_duplicates(spark, docs.repartition(5), FOLDER)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, after.collect()))


def test_near_dedup_of_rows_without_ids_against_others(spark):
    """A text without a doc_id leaves when a document has it or nearly has it; empty texts repeat nothing but themselves."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a"), (7, text, "b"), (None, text, "a"), (None, text + " more", "a"), (None, "alone here", "c"), (None, "alone here", "d"), (8, "", "a"), (9, "", "a"), (9, "", "a"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline._near_duplicates(spark, docs, FOLDER).collect())
    assert left == Counter([(7, text), (None, "alone here"), (8, ""), (9, ""), (None, None)])


def test_run_leaves_only_what_its_result_reads(spark):
    from pathlib import Path

    from lectern.llm.state import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before, batch = set(folder.iterdir()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = corpus_pipeline.run(spark, FOLDER)
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["stage"]
    assert rows.count() and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_mix_takes_what_the_operator_says_of_null_and_repeated_ids(spark):
    docs = odd_docs(spark)
    after = corpus_pipeline._mix(spark, docs, FOLDER)
    got, again = (Counter(map(tuple, df.collect())) for df in (after, corpus_pipeline._mix(spark, docs.repartition(3), FOLDER)))
    assert after.columns == docs.columns and got == again
    words, want, longest = Counter(), {}, Counter()
    for (_, text, source), n in got.items():
        words[source] += n * len(text.split())
    for r in corpus_pipeline.mixing.mix(docs.withColumn("told", corpus_pipeline.F.col("source")), keep=("told",)).collect():
        want[r.told], longest[r.told] = r.target, max(longest[r.told], r.size)
    assert all(abs(words[s] - t) <= longest[s] for s, t in want.items())
    assert any(i is None for i, _, _ in got)


def test_stages_of_nothing_and_of_clashing_columns(spark):
    """Empty tables give empty tables; columns named like a stage's own come through as they were."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id % 9 = 0")
    clash = docs.selectExpr("*", *(f"doc_id * 2 as {c}" for c in ("kept", "spans", "taken", "size", "copy", "h", "row", "email", "rep", "component_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        got = stage(spark, clash, FOLDER)
        assert got.columns == clash.columns, name
        assert all(r.kept == r.taken == r.row == r.email == 2 * r.doc_id for r in got.select("doc_id", "kept", "taken", "row", "email").collect())
    assert corpus_pipeline._encode(spark, docs.limit(0), FOLDER).count() == 0


def test_other_stages_keep_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    some = docs.filter("doc_id % 4 = 0")
    odd = docs.unionByName(some).unionByName(some.withColumn("doc_id", corpus_pipeline.F.lit(None).cast("bigint")))
    scored = corpus_pipeline._quality(spark, odd, FOLDER).collect()
    times = Counter((r.text, r.source) for r in odd.collect())
    assert all(n == times[x] for x, n in Counter((r.text, r.source) for r in scored).items())
    assert any(r.doc_id is None for r in scored)
    for stage in (corpus_pipeline._personal_data, corpus_pipeline._encode):
        assert Counter(r.doc_id for r in stage(spark, odd, FOLDER).collect()) == Counter(r.doc_id for r in odd.collect())


def test_stages_send_small_batches_to_python(spark, monkeypatch):
    """An executor's memory is not to grow with the rows of a partition; the session's setting is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, sent = spark.conf.get(name), []

    def encode(docs, **_):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[b.num_rows]] * b.num_rows, pa.list_(pa.int32())), pa.array([True] * b.num_rows)], names=["doc_id", "source", "ids", "restored"])

        return docs.mapInArrow(run, "doc_id bigint, source string, ids array<int>, restored boolean")

    def kept(*args, **_):
        sent.append(spark.conf.get(name))
        return args

    monkeypatch.setattr(corpus_pipeline.pieces, "encode", encode)
    docs = spark.range(2500).selectExpr("id as doc_id", "'a' as source", "concat('text ', id) as text").coalesce(1)
    got = corpus_pipeline._encode(spark, docs, FOLDER).collect()
    assert len(got) == 2500 and max(r.ids[0] for r in got) <= 1000 and spark.conf.get(name) == was
    monkeypatch.setattr(corpus_pipeline.quality, "train", kept)
    monkeypatch.setattr(corpus_pipeline.quality, "score", lambda rows, model: rows.withColumn("kept", corpus_pipeline.F.lit(True)))
    assert corpus_pipeline._quality(spark, docs, FOLDER).count() == 2500 and sent == ["1000"] and spark.conf.get(name) == was


def test_near_dedup_has_one_python_worker_a_task(spark, monkeypatch):
    """Edges that come from Python are written before the components' Python reads them."""
    plans, components = [], corpus_pipeline.minhash.connected_components

    def watched(edges, *args):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges, *args)

    monkeypatch.setattr(corpus_pipeline.minhash, "connected_components", watched)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert corpus_pipeline._near_duplicates(spark, docs, FOLDER).count() and plans
    assert not any("MapInArrow" in p for p in plans)


def test_quality_is_scored_in_small_batches(spark, monkeypatch):
    """The rows that the stage returns were scored in batches of its own size, whatever reads them later."""

    def score(rows, model):
        import pyarrow as pa

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([str(b.num_rows)] * b.num_rows), b.column(1), pa.array([True] * b.num_rows)], names=["text", "row", "kept"])

        return rows.mapInArrow(run, "text string, row struct<doc_id: bigint>, kept boolean")

    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.quality, "score", score)
    docs = spark.range(2500).selectExpr("id as doc_id", "concat('text ', id) as text").coalesce(1)
    got = corpus_pipeline._quality(spark, docs, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == [*range(2500)] and max(int(r.text) for r in got) <= 1000


def test_encoding_searches_few_bytes_together(spark, monkeypatch):
    """A task of the stage holds a group of at most 2 MB of texts; the ids are those of larger groups."""
    docs = spark.range(1500).selectExpr("id as doc_id", "'a' as source", "repeat(concat('some words ', id, ' '), 200) as text").coalesce(1)
    held, groups, encode = [], corpus_pipeline.pieces._groups, corpus_pipeline.pieces.encode

    def watched(rows, **how):
        import inspect

        group = inspect.signature(encode).bind(rows, **how)
        group.apply_defaults()
        held.extend(sum(len(t) for t in p.column(0).to_pylist()) for p in groups(rows.select("text").toArrow().to_batches(), 0, group.arguments["group"]))
        return encode(rows, **how)

    monkeypatch.setattr(corpus_pipeline.pieces, "encode", watched)
    got = {r.doc_id: r.ids for r in corpus_pipeline._encode(spark, docs, FOLDER).collect()}
    assert len(held) > 1 and max(held) <= 1 << 21 < sum(held)
    assert got == {r.doc_id: r.ids for r in encode(docs, group=1 << 23).collect()}
