"""Importance resampling towards a target distribution, by hashed n-gram features.

A text's features are its runs of one to ``runs`` consecutive words, each hashed to
``crc32 % buckets``. One scan per text keeps the zlib states of the last ``runs`` starts in a ring;
a word opens one state and extends the others by a space and itself, and every state then gives a bucket.
The buckets are written once, sorted, as a plane of high and a plane of low bytes.

Each bucket's gain is ``floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))`` of its counts in target and corpus.
A document's weight is the sum of gains over its features; Gumbel noise from a hash of its
doc_id is added, and the ``percent`` highest scores among documents of enough words are drawn (the
Gumbel top-k form of sampling without replacement in proportion to exp(weight / 1000)).

Ranks need no common sort: rows are dealt to ranges of the score, whose sizes give each range's first rank, and
only ranges that hold drawn rows are ordered. Counts are summed in the tasks before they are
shuffled; the driver sees ``buckets`` gains, nothing that grows with the corpus.

Defined cases: null, empty and wordless texts have no features, weight 0, a score and no rank; a null doc_id is hashed as ``null``
and ties after all others; ties go by doc_id, then by a hash of the text, and equal rows in any order; repeated rows each have
their own rank; an empty corpus gives no rows, an empty target a gain for every bucket all the same; very long texts are split in
blocks of ``BLOCK`` bytes, and need memory for their buckets; of other columns only ``keep`` comes through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.state import materialize, small_side
from lectern.llm.words import as_bytes, word_blocks

RUNS, BUCKETS, PERCENT, LEAST_WORDS, SEED = 3, 10_000, 5, 20, 42
#: Rows of a range of scores, and how many ranges there are at most.
RANGE_ROWS, RANGES = 2000, 2048
#: Rows of a result batch.
ROWS = 500


def crc_ring(blocks: Iterable[list[bytes]], runs: int = RUNS) -> Iterator[np.ndarray]:
    """The CRC-32 of every run of 1 to ``runs`` words, a block at a time; the ring goes on from block to block."""
    crc32 = zlib.crc32
    ring: list[int] = []
    for words in blocks:
        out: list[int] = []
        for word in words:
            more = b" " + word
            ring = [crc32(word), *[crc32(more, state) for state in ring[: runs - 1]]]
            out += ring
        yield np.array(out, dtype=np.uint32)


def planes(buckets: np.ndarray) -> bytes:
    """Sorted 16-bit numbers, high bytes first: those are few and repeat, so a table of them packs well."""
    ordered = np.sort(buckets.astype(np.uint16))
    return (ordered >> 8).astype(np.uint8).tobytes() + ordered.astype(np.uint8).tobytes()


def numbers(packed: bytes) -> np.ndarray:
    """What ``planes`` packed."""
    both = np.frombuffer(packed, dtype=np.uint8).reshape(2, -1).astype(np.int64)
    return (both[0] << 8) | both[1]


def bucketed(rows: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> DataFrame:
    """``rows``, whose last column is a text, with (n_words, n_features, packed) in place of the text."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string("n_words bigint, n_features bigint, packed binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                words, packed = [], []
                for text in as_bytes(part.column(part.num_columns - 1)):
                    lengths: list[int] = []

                    def told(text: bytes | None = text, lengths: list[int] = lengths) -> Iterator[list[bytes]]:
                        for block in word_blocks(text):
                            lengths.append(len(block))
                            yield block

                    found = [hashed % np.uint32(buckets) for hashed in crc_ring(told(), runs)]
                    words.append(sum(lengths))
                    packed.append(planes(np.concatenate(found)) if found else b"")
                sizes = [len(p) // 2 for p in packed]
                new = [pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def bucket_counts(packed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): how often each bucket occurs in ``packed`` (packed), summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts += np.bincount(numbers(value.as_py()), minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["bucket", "n"])

    return packed.select("packed").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, gain), one for every bucket, of the counts (bucket, n) of corpus and target."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    # buckets are at most 65,536 rows
    total = lambda c: F.sum(c).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upper = (F.col("t").cast("double") + 1) * (total("s").cast("double") + buckets)
    lower = (F.col("s").cast("double") + 1) * (total("t").cast("double") + buckets)
    return both.select("bucket", F.floor(1000 * F.log(upper / lower)).cast("bigint").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from 32 bits of a hash of doc_id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    bits = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((bits + 0.5) / 4294967296.0))).cast("bigint")


def weighed(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """``packed`` with ``weight``, the sum of its buckets' gains, in place of its last column."""
    schema = T.StructType([*packed.schema.fields[:-1], T.StructField("weight", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gains[numbers(value.as_py())].sum()) for value in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=schema.names)

    return packed.mapInArrow(run, schema)


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, h, no, n_words, score, ...) with the ``rank`` of drawn rows, by ``no`` among equals."""
    fit = scored.filter(F.col("n_words") >= least_words)
    n = fit.count()
    drawn = percent * n // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("no")]
    ranges = max(1, min(RANGES, -(-n // RANGE_ROWS)))
    dealt = materialize(fit.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("held"))  # a row for each range
    before = F.coalesce(F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(small_side(sizes.select("range", before.alias("before"))), "range")
    at = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    none = F.lit(None).cast("bigint")
    head = placed.filter(F.col("before") < drawn).withColumn("rank", at).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    tail = placed.filter(F.col("before") >= drawn).withColumn("rank", none)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", none)
    return head.unionByName(tail).drop("range", "before").unionByName(rest)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    runs: int = RUNS,
    buckets: int = BUCKETS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank) and the columns ``keep``, one per row of ``docs`` (doc_id, text).

    ``target`` (text) is the distribution to resample towards; ``rank`` is null for rows that are not drawn.
    """
    spark = docs.sparkSession
    # what is kept goes in one column, so that its names cannot clash
    kept = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else []
    rows = docs.select("doc_id", *kept, F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("no"), F.col("text").cast("string").alias("text"))
    packed = materialize(bucketed(rows, runs, buckets), "buckets")
    wanted = bucketed(target.select(F.col("text").cast("string").alias("text")), runs, buckets)
    told = bucket_gains(bucket_counts(packed, buckets), bucket_counts(wanted, buckets), buckets).collect()
    gains = np.zeros(buckets, dtype=np.int64)
    gains[[r["bucket"] for r in told]] = [r["gain"] for r in told]
    scored = weighed(packed, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    ranked = draw(materialize(scored, "scored"), percent, least_words)
    return ranked.select("doc_id", "n_features", "weight", "score", "rank", *(F.col(f"kept.`{c}`") for c in keep))
