"""Near-duplicate texts and vectors against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import graph, minhash, textkernel, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k : k + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"] * rng.randrange(3)
    return out


def corpus():
    """Copies, near copies from clear to just under the threshold, chains, a common line, a large group, odd texts."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n", "one", "ONE", "one two three four", "one two three four", "One two  three\tfour five", "x" * 300_000]
    common = [word() for _ in range(12)]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(6, 200))]
        texts += [" ".join(common + edited(rng, base, rng.randrange(0, 6))) for _ in range(rng.randrange(1, 4))]
    big = [word() for _ in range(90)]
    texts += [" ".join(common + edited(rng, big, rng.randrange(0, 9))) for _ in range(150)]
    step = [word() for _ in range(120)]
    for _ in range(12):  # a chain: ends are far apart, neighbours are not
        step = edited(rng, step, 2)
        texts += [" ".join(step)]
    texts += [" ".join(common + [word() for _ in range(3)]) for _ in range(100)] + texts[20:30]
    return texts


@pytest.mark.parametrize(("limit", "large"), [(64, 32), (8, 4)])
def test_near_duplicates_match_brute_force(spark, limit, large):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), links)
    docs = spark.createDataFrame([(i, t, i, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, rep int, v string")
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, list_limit=limit, large=large).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)


def test_near_duplicates_of_repeated_rows_match_brute_force(spark):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(range(len(texts)), links)
    docs = spark.createDataFrame([(i, t) for _ in range(2) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, list_limit=8, large=4).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), want[i], want[i] == i) for i, s in enumerate(sets) for _ in range(2))


def test_prefixes_of_repeated_rows_are_whole(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:36] + ["x", "y"])]
    picks = spark.createDataFrame([(i, i + 7, h) for i, h in enumerate(r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(minhash.text_hash()).collect())], "rep bigint, doc_id bigint, h bigint")
    found = []
    for times in (1, 2):
        docs = spark.createDataFrame([(i + 7, t) for i, t in enumerate(texts) for _ in range(times)], "doc_id bigint, text string")
        found.append(sorted(map(tuple, minhash._prefixes(minhash._texts(docs, picks), picks).collect())))
    assert found[0] and found[0] == found[1]


def test_texts_of_one_id_link_by_themselves(spark):
    text = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a", 60)), (2, text("b", 60)), (5, text("a", 62)), (5, text("b", 62)), (5, text("b", 62)), (6, text("c", 60)), (6, text("c", 62)), (7, text("c", 64))]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()))
    assert [(d, c) for d, _, c, _ in got] == [(1, 1), (2, 2), (5, 1), (5, 2), (5, 2), (6, 6), (6, 6), (7, 6)]
    assert [d for d, *_, kept in got if kept] == [1, 2, 6]


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True), (2, 0, 2, True)], key=str)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abÉ日 \t", k=rng.randrange(1, 9))) for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "z" * 500]
    whole = textkernel.shingle_sets(pa.array(texts))
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]
    monkeypatch.setattr(textkernel, "BLOCK", 37)
    assert all((a == b).all() for a, b in zip(whole, textkernel.shingle_sets(pa.array(texts)), strict=True))
    assert all((a == b).all() for a, b in zip(whole[5:], textkernel.shingle_sets(pa.array(texts).slice(5)), strict=True))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 240)] + [(3, 3), (None, 4), (8, 7)]
    got = dict(map(tuple, graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, 8, *range(200, 240)]}}


def test_error_bounds_are_rigorous():
    rng = np.random.default_rng(0)
    for scale in (1.0, 1e-3):
        u = rng.normal(size=(60, 24)) * np.where(rng.random((60, 24)) < 0.1, 1, scale)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        q, s, w, e = vectors.quantise(u)
        near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
        assert (np.abs(u @ u.T - near) <= w[:, None] * e + e[:, None] + 1e-12).all()


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = rng.normal(size=8)
            for noise in (0, 0.05, 0.1, 0.2)[: rng.integers(1, 5)]:
                rows.append((n, [float(x) for x in (base + noise * rng.normal(size=8)).astype(np.float32)], label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, None, 0), (n + 4, [], 0), (n + 5, [0.0] * 8, 0), (n + 6, [float("nan")] * 8, 0), (n + 7, [1.0, None], 0), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0), (n + 10, [1e30, 1e30], 0), (n + 11, [1e-30, 1e-30], 0)]
    ok = {i: np.array(v, float) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: l for i, _, l in rows}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in ok.items()}
    links = [(i, j) for i in ok for j in ok if j < i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and float(unit[i] @ unit[j]) >= 0.98]
    want = components([i for i, *_ in rows], links)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumnRenamed("x", "x")
    for block in (1024, 7):
        got = {r.vec_id: r for r in vectors.near_duplicate_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        for i, _, _ in rows:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in l for l in links), want[i], want[i] == i)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0
