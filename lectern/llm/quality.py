"""Quality by ordinal regression on graded ratings over hashed text.

Proportional-odds model: one weight vector for all grades and ordered
thresholds, ``P(grade > k) = sigmoid(w.x - t_k)``. Features are hashed words
(normalised counts in ``BUCKETS`` buckets) and a few shape figures of the text.
The score of a text is its expected grade and the probability of reaching ``GOOD``.

Ratings come as (doc_id, grade). Weights are fitted in numpy on at most
``MAX_RATED`` rated documents, those with the smallest hash of doc_id; every
document is scored, in whole, by vectorised passes over Arrow batches.

Defined cases: null and empty texts have no words, an empty text's score is the
thresholds' alone and it is not ``kept``; ratings without a document and null
grades are ignored; with no ratings every text keeps the prior 0.5 and is kept;
repeated rows score alike; other columns are carried along, those with the new
columns' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.textkernel import flat, word_hashes

BUCKETS, SHAPES = 1 << 12, 8
MAX_RATED, GRADES, GOOD = 6000, 4, 2
#: A document is rejected when the odds of a good grade are below this probability.
KEEP_AT = 0.5


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, bucket of each word, weight of each word, shapes) of a batch."""
    data, offsets = flat(column)
    words, bounds = word_hashes(data, offsets)
    counts, n_bytes = np.diff(bounds), np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    bucket = (words >> np.uint64(40)).astype(np.int64) % BUCKETS
    weight = (1.0 / np.sqrt(np.maximum(counts, 1)))[owner]

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n_bytes, 1)

    upper, lower, odd = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    upper[65:91], lower[97:123], odd[[33, 35, 36, 37, 38, 42, 124]] = True, True, True
    # distinct words against words: repetition
    order = np.lexsort((words, owner))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(counts))
    shapes = np.stack(
        [np.ones(len(counts)), share(upper[data]) * 4, share(lower[data]), share(odd[data]) * 8, share(data == 10) * 8, np.sqrt(distinct / np.maximum(counts, 1)), np.log1p(counts) / 6, np.minimum(n_bytes / np.maximum(counts, 1), 20) / 10], axis=1
    )
    return owner, bucket, weight, shapes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def fit(texts: list[str | None], grades: np.ndarray, grades_n: int = GRADES, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of texts and their grades."""
    return fit_features(*features(pa.array(texts, pa.string())), grades, grades_n, steps, l2)


def loss_and_gradient(w: np.ndarray, raw: np.ndarray, owner: np.ndarray, bucket: np.ndarray, weight: np.ndarray, shapes: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood of the cumulative links with a weight penalty, and its gradient by (w, raw).

    ``raw`` holds the first threshold and the logarithms of the steps to the next ones, so thresholds stay ordered.
    """
    n, steps = len(y), np.exp(raw[1:])
    cuts = np.concatenate([[raw[0]], raw[0] + np.cumsum(steps)])
    z = np.bincount(owner, w[bucket] * weight, n) + shapes @ w[BUCKETS:]
    padded = np.concatenate([[-np.inf], cuts, [np.inf]])
    high, low = _sigmoid(padded[y + 1] - z), _sigmoid(padded[y] - z)
    p = np.maximum(high - low, 1e-9)
    d_high, d_low = high * (1 - high) / p / n, low * (1 - low) / p / n
    dz = d_high - d_low  # of the negative log-likelihood by z
    by_bucket = np.bincount(bucket, dz[owner] * weight, BUCKETS) if len(bucket) else np.zeros(BUCKETS)
    g_cut = np.zeros(len(cuts))
    np.add.at(g_cut, y[y < len(cuts)], -d_high[y < len(cuts)])
    np.add.at(g_cut, y[y > 0] - 1, d_low[y > 0])
    g_raw = np.concatenate([[g_cut.sum()], steps * np.cumsum(g_cut[::-1])[::-1][1:]])
    return float(-np.log(p).mean() + l2 / 2 * w @ w), np.concatenate([by_bucket, shapes.T @ dz, g_raw]) + np.concatenate([l2 * w, np.zeros(len(raw))])


def fit_features(owner: np.ndarray, bucket: np.ndarray, weight: np.ndarray, shapes: np.ndarray, grades: np.ndarray, grades_n: int = GRADES, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on ``loss_and_gradient``."""
    y = grades.astype(int)
    w, raw = np.zeros(BUCKETS + SHAPES), np.concatenate([[-1.0], np.zeros(grades_n - 2)])
    state = [np.zeros(len(w) + len(raw)), np.zeros(len(w) + len(raw))]
    for step in range(1, steps + 1):
        _, g = loss_and_gradient(w, raw, owner, bucket, weight, shapes, y, l2)
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        move = 0.05 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, raw = w - move[: len(w)], raw - move[len(w) :]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED, grades_n: int = GRADES) -> tuple[np.ndarray, np.ndarray] | None:
    """The model fitted on rated documents: ``ratings`` has (doc_id, grade in 0..grades_n-1). None without any.

    Features are made where the texts are; the at most ``max_rated`` rows of them are fitted in one task,
    and only the weights and thresholds reach the driver.
    """
    chosen = ratings.filter(f"grade between 0 and {grades_n - 1} and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    # max_rated rows of two numbers: a proven bound
    rated = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("grade", "text", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                owner, bucket, weight, shapes = features(part.column(1))
                cells, at = np.unique(owner * BUCKETS + bucket, return_inverse=True)
                ends = pa.array(np.searchsorted(cells, np.arange(part.num_rows + 1) * BUCKETS), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((cells % BUCKETS).astype(np.int32), np.bincount(at, weight, len(cells)))]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SHAPES, pa.int32()), pa.array(shapes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), rows, *lists], names=["doc_id", "grade", "shapes", "buckets", "weights"])

    def fitted(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = {c: table.column(c).chunk(0) for c in ("shapes", "buckets", "weights")}
        owner = np.repeat(np.arange(len(table)), np.diff(lists["buckets"].offsets.to_numpy()))
        bucket, weight, shapes = (lists[c].flatten().to_numpy() for c in ("buckets", "weights", "shapes"))
        # sums of features in the order of the documents, so that the fit does not depend on how rows arrived
        ids = table.column("doc_id").to_numpy()
        order = np.lexsort((np.bincount(owner, weight * (bucket + 1), len(table)), ids))
        place = np.empty(len(table), int)
        place[order] = np.arange(len(table))
        rows = np.argsort(place[owner], kind="stable")
        w, cuts = fit_features(place[owner][rows], bucket[rows].astype(np.int64), weight[rows], shapes.reshape(-1, SHAPES)[order], table.column("grade").to_numpy()[order], grades_n)
        return pa.table({"w": pa.array([w.tolist()], pa.list_(pa.float64())), "cuts": pa.array([cuts.tolist()], pa.list_(pa.float64()))})

    # a row has at most BUCKETS entries however long its text is
    kept = rated.mapInArrow(run, "doc_id bigint, grade int, shapes array<double>, buckets array<int>, weights array<double>")
    kept = kept.orderBy("doc_id", "buckets").limit(max_rated)
    found = kept.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "w array<double>, cuts array<double>").first()
    return (np.array(found["w"]), np.array(found["cuts"])) if found else None


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from (doc_id, quality, toxic): 0 poor and toxic, 1 poor, 2 good but toxic, 3 good."""
    return labels.select("doc_id", (F.col("quality") * 2 + 1 - F.coalesce("toxic", F.lit(0))).cast("int").alias("grade"))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, good: int = GOOD, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` with expected_grade, p_good (of a grade >= ``good``) and kept."""
    new = ["expected_grade", "p_good", "kept"]
    docs = docs.drop(*new)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 250):
                part = batch.slice(start, 250)
                n = part.num_rows
                if model is None:
                    tail, expected = np.full((n, GRADES - 1), 0.5), np.full(n, (GRADES - 1) / 2)
                    kept = np.ones(n, bool)
                else:
                    w, cuts = model
                    owner, bucket, weight, shapes = features(part.column(at))
                    z = np.bincount(owner, w[bucket] * weight, n) + shapes @ w[BUCKETS:]
                    tail = _sigmoid(z[:, None] - cuts)
                    expected = tail.sum(axis=1)
                    kept = (tail[:, good - 1] >= keep_at) & (np.bincount(owner, minlength=n) > 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(expected), pa.array(tail[:, good - 1]), pa.array(kept)], names=[*names, *new])

    kinds = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, k) for c, k in zip(new, kinds, strict=True))]))
