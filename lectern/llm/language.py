"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes (ASCII letters in lower case) are cut into windows of
``WINDOW`` bytes. A GRU runs over each window in both directions, every
position gets language probabilities from both states, and a document's
probabilities are the mean over all of its positions. The network is trained in
numpy by backpropagation through time (Adam) on windows of at most ``PER_LANGUAGE``
documents of each language, those with the smallest hash of doc_id among the learnable ones, so that no language is missing;
prediction reads every whole text. State is laid out (unit, window), so a step
is one small matrix product and a few contiguous vector operations for thousands of
windows at once; windows are ordered by length and drop out of a step when they end.

Defined cases: a text that is null or has no letter gives ``und`` and score 0;
ties go to the first language by code point; with nothing to learn from every
text is ``und``; repeated rows predict alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.textkernel import flat

WINDOW, UNITS = 128, 8
PER_LANGUAGE, SPOTS, TRAIN_WINDOW = 700, 3, 48
_GROUP = 2048
_FOLD = np.arange(256)
_FOLD[65:91] += 32


class Network:
    """Weights of both directions and of the output; ``in*`` are (3 units, 256) tables of the byte's share of the gates."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages, self.units = languages, units
        small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"in0": small(3 * units, 256), "re0": small(3 * units, units), "in1": small(3 * units, 256), "re1": small(3 * units, units), "out0": small(len(languages), units), "out1": small(len(languages), units), "bias": np.zeros((len(languages), 1), np.float32)}

    def _states(self, x: np.ndarray, way: int) -> list[tuple]:
        """Per step (in order of time) what backpropagation needs; x is (time, windows)."""
        u, wi, wr = self.units, self.p[f"in{way}"], self.p[f"re{way}"]
        h, steps = np.zeros((u, x.shape[1]), np.float32), []
        for t in range(len(x))[:: -1 if way else 1]:
            a, g = np.take(wi, x[t], axis=1), wr @ h
            zr = 0.5 * np.tanh(0.5 * (a[: 2 * u] + g[: 2 * u])) + 0.5
            n = np.tanh(a[2 * u :] + zr[u:] * g[2 * u :])
            new = n + zr[:u] * (h - n)
            steps.append((t, h, zr[:u], zr[u:], n, g[2 * u :], new))
            h = new
        return steps

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean weighted cross-entropy over all positions, and its gradients; windows are full."""
        u, p = self.units, self.p
        ways = [self._states(x, 0), self._states(x, 1)]
        seen = [{s[0]: s[6] for s in w} for w in ways]
        d_h, loss, total = [{}, {}], 0.0, float(weight.sum()) * len(x)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        hot = np.zeros((len(self.languages), x.shape[1]), np.float32)
        hot[y, np.arange(len(y))] = 1
        for t in range(len(x)):
            o = p["out0"] @ seen[0][t] + p["out1"] @ seen[1][t] + p["bias"]
            o = np.exp(o - o.max(axis=0))
            o /= o.sum(axis=0)
            loss -= float((np.log(o[y, np.arange(len(y))] + 1e-9) * weight).sum()) / total
            d = ((o - hot) * (weight / total)).astype(np.float32)
            g["bias"] += d.sum(axis=1, keepdims=True)
            for way in (0, 1):
                g[f"out{way}"] += d @ seen[way][t].T
                d_h[way][t] = p[f"out{way}"].T @ d
        for way in (0, 1):
            back, wr = np.zeros((u, x.shape[1]), np.float32), p[f"re{way}"]
            gates, steps = [], ways[way]
            for t, h, z, r, n, gn, _ in reversed(steps):
                d = back + d_h[way][t]
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (h - n) * z * (1 - z)
                d_r = d_n * gn * r * (1 - r)
                d_g = np.concatenate([d_z, d_r, d_n * r])
                g[f"re{way}"] += d_g @ h.T
                back = d * z + wr.T @ d_g
                gates.append((x[t], np.concatenate([d_z, d_r, d_n])))
            rows = np.concatenate([b for b, _ in gates])
            flows = np.concatenate([f for _, f in gates], axis=1)
            for k in range(3 * u):
                g[f"in{way}"][k] += np.bincount(rows, flows[k], 256)
        return loss, g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 220, batch: int = 256, rate: float = 0.03, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.languages))
        weight = (1 / np.maximum(share, 1))[y] * len(y) / len(self.languages)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), min(batch, 4 * len(y)))
            _, g = self.gradients(x[:, pick], y[pick], weight[pick])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in self.p.items():
                a, b = m[k]
                a += 0.1 * (g[k] - a)
                b += 0.01 * (g[k] * g[k] - b)
                v -= (pace * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def probabilities(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(languages, windows): sums of the position probabilities of windows, which come longest first."""
        u, p, n = self.units, self.p, len(starts)
        top = int(lengths[0]) if n else 0
        at = np.minimum(starts + np.arange(top)[:, None], len(data) - 1)
        x = _FOLD[data[at]]
        active = np.searchsorted(-lengths, -np.arange(top), "left")  # windows longer than t
        logits = np.empty((top, len(self.languages), n), np.float32)
        total = np.zeros((len(self.languages), n), np.float32)
        half = np.full((3 * u, 1), 0.5, np.float32)
        half[2 * u :] = 1
        for way in (0, 1):
            # a sigmoid is a tanh of half its argument: the halves are in the weights
            wi, wr, wo = p[f"in{way}"] * half, p[f"re{way}"] * half, p[f"out{way}"]
            h = np.zeros((u, n), np.float32)
            a_all, g_all, o_all = (np.empty((k, n), np.float32) for k in (3 * u, 3 * u, len(self.languages)))
            for t in range(top)[:: -1 if way else 1]:
                k = int(active[t])
                a, g, o, now = (a_all, g_all, o_all, h) if k == n else (np.empty((3 * u, k), np.float32), np.empty((3 * u, k), np.float32), np.empty((len(self.languages), k), np.float32), h[:, :k])
                np.take(wi, x[t, :k], axis=1, out=a, mode="clip")
                np.matmul(wr, now, out=g)
                zr, c = a[: 2 * u], a[2 * u :]
                zr += g[: 2 * u]
                np.tanh(zr, out=zr)
                zr *= 0.5
                zr += 0.5
                reset = g[2 * u :]
                reset *= zr[u:]
                c += reset
                np.tanh(c, out=c)
                now -= c
                now *= zr[:u]
                now += c
                np.matmul(wo, now, out=o)
                if not way:
                    logits[t, :, :k] = o
                else:
                    o += logits[t, :, :k]
                    o += p["bias"]
                    np.minimum(o, 60, out=o)
                    np.exp(o, out=o)
                    o /= o.sum(axis=0)
                    total[:, :k] += o
        return total

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, mean probability of it) for each text of an Arrow column."""
        data, offsets = flat(column)
        sizes = np.diff(offsets)
        many = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        starts = offsets[:-1][owner] + within * WINDOW
        lengths = np.minimum(WINDOW, offsets[1:][owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        sums = np.zeros((len(sizes), len(self.languages)))
        for at in range(0, len(order), _GROUP):
            part = order[at : at + _GROUP]
            got = self.probabilities(data, starts[part], lengths[part])
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(owner[part], got[k], len(sizes))
        mean = sums / np.maximum(sizes, 1)[:, None]
        best = mean.argmax(axis=1)
        return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: crc32 of doc_id as text leaves 2 modulo 4 (a null doc_id is held out)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True)))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network trained on rows of ``docs`` (doc_id, text, lang) that are not held out and have a language."""
    fit = held_out(docs.select("doc_id", "text", "lang")).filter(F.expr("not held_out and lang is not null") & F.col("text").rlike(r"\p{L}"))
    # a few windows of each, so that no text is sorted
    width = F.length("text")
    spots = [F.substring("text", F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), width - TRAIN_WINDOW)).cast("int"), F.lit(TRAIN_WINDOW)) for k in range(SPOTS)]
    fit = fit.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("g"), *(s.alias(f"t{k}") for k, s in enumerate(spots)))
    # each task passes on no more than the first of a language, so a common language is no more to one task than a rare one
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "g")
    rows = fit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    # what reaches the driver is bounded by per_language
    got = rows.drop("h", "g", "rank").orderBy("doc_id", "lang", "t0").collect()
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    x, y = [], []
    for r in got:
        for k in range(SPOTS):
            raw = r[f"t{k}"].encode() * (1 + TRAIN_WINDOW // max(1, len(r[f"t{k}"])))
            if len(raw) >= TRAIN_WINDOW:
                x.append(_FOLD[np.frombuffer(raw[:TRAIN_WINDOW], np.uint8)])
                y.append(languages.index(r["lang"]))
    if not x:
        return None
    net = Network(languages)
    net.train(np.stack(x).T, np.array(y))
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``; only the text is an input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                letters = np.array(part.column(2).to_pylist(), bool)
                if net is None:
                    names, scores = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    best, scores = net.predict(part.column(3))
                    names = [net.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                    scores = np.where(letters, scores, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = held_out(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "held_out", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
