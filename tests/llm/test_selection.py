"""Importance resampling, decontamination and the filter audit against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontamination as dec
from lectern.llm import interactions, resampling, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOWER))


def sentence(rng, n, pool=12):
    return " ".join(f"w{k}" for k in rng.integers(0, pool, n))


def test_words_are_bytes_of_the_words_of_the_text():
    texts = ["", "Ab1,ÄB c_d\n\x00e", "ΑΒΓ ŞI ß9-9", "x" * 50 + " " + "y" * 50, "🎉a🎉 ", "...", " lead"]
    for t in texts:
        for block in (1, 7, 1 << 20):
            assert [w.decode() for b in words.word_blocks(t.encode(), block) for w in b] == split(t)
    assert list(words.word_blocks(None)) == []


def test_ring_gives_the_crc_of_every_run_whatever_the_blocks():
    rng = np.random.default_rng(1)
    for n, runs in ((0, 3), (1, 3), (2, 3), (40, 1), (40, 3), (41, 5)):
        w = [x.encode() for x in sentence(rng, n).split()]
        want = Counter(zlib.crc32(b" ".join(w[i : i + k])) for k in range(1, runs + 1) for i in range(len(w) - k + 1))
        for size in (1, 7, 1000):
            got = [h for part in resampling.crc_ring([w[k : k + size] for k in range(0, len(w), size)], runs) for h in part.tolist()]
            assert Counter(got) == want
    some = rng.integers(0, 1 << 16, 999)
    assert resampling.numbers(resampling.planes(some)).tolist() == sorted(some.tolist()) and resampling.planes(some[:0]) == b""


def brute_resample(docs, target, percent=5, least=20, seed=42, runs=3, buckets=10000):
    feats = lambda t: Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for w in [split(t)] for k in range(1, runs + 1) for i in range(len(w) - k + 1))
    own, wanted = [feats(t) for _, t in docs], sum((feats(t) for t in target), Counter())
    s, total, want = sum(own, Counter()), sum(sum(c.values()) for c in own), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log(((wanted[b] + 1) * (total + buckets)) / ((s[b] + 1) * (want + buckets))))
    rows = []
    for (i, t), c in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(split(t)) >= least])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resampling_equals_plain_python(spark, percent, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    rng = np.random.default_rng(percent)
    docs = [(i, sentence(rng, int(rng.integers(0, 60)))) for i in range(120)] + [(500 + i, "Same TEXT! " * 15) for i in range(40)] + [(900, None), (901, ""), (902, "?!"), (None, sentence(rng, 30)), (903, "É" * 5000 + sentence(rng, 3000))]
    target = [sentence(rng, 50, 4), None, ""]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, score string, kept int").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_resample(docs, target, percent), key=key)


def test_resampling_of_repeats_and_nothing(spark):
    row = (7, "one two three four five " * 5)
    df = spark.createDataFrame([row] * 30, "doc_id bigint, text string")
    target = spark.createDataFrame([], "text string")
    got = resampling.resample(df, target, 50).collect()
    assert len(got) == 30 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16)) and len({(r.weight, r.score) for r in got}) == 1
    assert resampling.resample(df.filter("false"), target).count() == 0
    other = df.limit(2).withColumn("kept", F.lit(3)).withColumn("rank", F.lit("mine"))
    assert resampling.resample(other, target, keep=("kept",)).columns == ["doc_id", "n_features", "weight", "score", "rank", "kept"]
    with pytest.raises(ValueError):
        resampling.resample(df, target, buckets=1 << 20)


def brute_items(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for name, text in items:
            v = split(text)
            size = min(window, len(v))
            runs = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)} if v else set()
            at = [k for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in runs] if v else []
            hit.update(k + j for k in at for j in range(size))
            names.update([name or ""] if at else [])
        out.append((i, len(w), len(hit), sorted(names)))
    return out


CASES = [(None, "x"), ("e", None), ("e2", ""), ("punct", "?!"), ("one", "Unique"), ("pair", "w1 w2"), ("twin", "w3 w3 w3"), ("twin2", "W3, w3! w3"), ("same id", "w5 w5 w5 w5"), ("same id", "w6 w6 w6")]


def case_docs(rng):
    docs = [(i, sentence(rng, int(rng.integers(0, 90)), 3)) for i in range(60)] + [(100 + i, sentence(rng, 40, 200)) for i in range(20)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "unique"), (204, "w1"), (205, "w1 w2"), (None, "x w5 w5 w5 w5"), (206, "w0 " * 5000), (206, "w0 " * 5000)]
    return docs


@pytest.mark.parametrize("shard, block", [(1 << 19, 1 << 20), (50, 1 << 20), (300, 40)])
def test_decontamination_equals_plain_python(spark, monkeypatch, shard, block):
    monkeypatch.setattr(dec, "SHARD_WORDS", shard)
    monkeypatch.setattr(dec, "STEPS", 4)
    rng = np.random.default_rng(shard)
    items = CASES + [(f"i{k}", sentence(rng, int(n), 3)) for k, n in enumerate(rng.integers(8, 25, 12))]
    docs = case_docs(rng)
    docs += [(300 + k, f"w0 w9 {t} w8 w1") for k, (_, t) in enumerate(items) if t]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, spans int").repartition(3)
    got = dec.find_items(df, spark.createDataFrame(items, "item_id string, text string"), block_words=block)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows), key=key) == sorted(brute_items(docs, items), key=key)
    assert all(sum(s.words for s in r.spans) == r.n_hit and all(a.at + a.words < b.at for a, b in zip(r.spans, r.spans[1:], strict=False)) for r in rows)


def test_decontaminated_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, "p"), (1, "clean", 2, "q"), (2, None, 3, "r")], "doc_id int, text string, n_hit int, row string")
    items = spark.createDataFrame([(9, "B c d e f g h i j K")], "item_id int, text string")
    left = dec.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.n_hit for r in left.collect()) == [2, 3]
    nothing = items.filter("false")
    assert dec.decontaminate(docs, nothing).count() == 3 and [r.n_words for r in dec.find_items(docs.orderBy("n_hit"), nothing).collect()] == [11, 1, 0]
    assert dec.find_items(docs.filter("false"), items).count() == 0


def test_suffixes_are_in_order_and_longest_matches_are_found(spark):
    rng = np.random.default_rng(3)
    for top, n, depth in ((1, 60, 70), (2, 200, 200), (3, 400, 30), (60, 500, 20)):
        ids = rng.integers(0, top + 1, n)
        bits = max(1, (top + 2).bit_length())
        array = dec.SuffixArray(ids.astype(np.int64), bits, depth)

        def told(k, ids=ids, depth=depth):
            part = ids[k : k + depth].tolist()
            return part[: part.index(0)] if 0 in part else part

        keys = [told(k) for k in array.order.tolist()]
        assert keys == sorted(keys) and sorted(array.order.tolist()) == np.flatnonzero(ids).tolist()
    docs = case_docs(rng)
    items = [(f"i{k}", sentence(rng, int(n), 4)) for k, n in enumerate(rng.integers(1, 60, 15))] + [("far", docs[3][1] + " nowhere " + docs[5][1]), ("none", "qq")]
    got = {r.item_id: r for r in dec.longest_matches(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")).collect()}
    for name, text in items:
        v = split(text)

        def longest(v=v):
            for size in range(len(v), 0, -1):
                runs = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
                for _, t in docs:
                    w = split(t)
                    if any(tuple(w[k : k + size]) in runs for k in range(len(w) - size + 1)):
                        return size
            return 0

        if not longest():
            assert name not in got
            continue
        r = got[name]
        assert r.n_words == longest()
        there = [split(t) for i, t in docs if str(i) == r.doc_id]
        assert any(w[r.doc_at : r.doc_at + r.n_words] == v[r.item_at : r.item_at + r.n_words] for w in there)


def brute_audit(docs, labels):
    good, toxic = ({i for i, *f in labels if f[k] == 1} for k in (0, 1))
    fails, rows = [], []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in docs)
        marks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), twin)
        fails.append((s or "", {f for f, x in zip("ABCDE", marks, strict=True) if x}, i in good, i in toxic))
    for part in {f[0] for f in fails}:
        own, walks, shares = [f for f in fails if f[0] == part], [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out = [d for d in left if f in d[1]]
                shares[f] += len(out)
                walks.append([part, "".join(order), step, len(left) - len(out), len(out), sum(f in d[1] for d in own) - len(out), sum(d[1] == {f} for d in own), sum(d[2] for d in out), sum(d[3] for d in out)])
                left = [d for d in left if f not in d[1]]
        rows += [(*r, shares[r[1][r[2] - 1]]) for r in walks]
    return sorted(rows)


def test_audit_equals_walking_every_order(spark):
    rng = np.random.default_rng(5)
    pool = [sentence(rng, int(n), int(p)) for n, p in zip(rng.integers(0, 300, 25), rng.integers(2, 400, 25), strict=True)]
    pool += [None, "", "ABC " * 210, "x$" * 3, "é" * 99 + "A", "one\x0btwo\x1cthree", "#"]
    docs = [(int(i), pool[int(k)], (None, "", "a", "b")[int(s)]) for i, k, s in zip(rng.integers(0, 90, 200), rng.integers(0, len(pool), 200), rng.integers(0, 4, 200), strict=True)]
    docs += [(None, pool[0], "a"), (None, pool[0], "c"), (5, "A " * 400, "only"), (6, "x" * 40_000 + " y" * 300, "only")]
    docs += docs[:10]
    labels = [(int(i), int(q), int(t)) for i, q, t in zip(rng.integers(0, 95, 60), rng.integers(0, 2, 60), rng.integers(0, 2, 60), strict=True)] + [(5, None, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "m", 1) for d in docs], "doc_id bigint, text string, source string, mask string, n int").repartition(4)
    got = interactions.audit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)
    assert interactions.audit(df.filter("false"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


def test_words_of_long_texts_are_counted_in_blocks():
    rng = np.random.default_rng(6)
    text = sentence(rng, 500, 300).replace("w1", "\n\t").encode() + b" " + b"z" * 90 + b"\x0b"
    for block in (1, 10, 1000, 1 << 20):
        assert interactions.words_of(text, block) == (len(text.split()), len(set(text.split())))


def test_polynomial_by_hand(spark):
    """Two documents fail A, one A and B: A removes 3 alone, its share is 2 + 1/2 of 120."""
    counts = spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 3, 1, 0, 1), ("p", 0, 4, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    row = interactions.polynomials(counts).select("total", interactions.corners(F.col("c"), "n").alias("v"), interactions.shapley(F.col("c"), 0).alias("a"), interactions.shapley(F.col("c"), 1).alias("b")).first()
    assert row.total == 7 and row.v[:4] == [0, 3, 1, 3] and (row.a, row.b) == (300, 60)
