"""Benchmark decontamination by suffix arrays of the training texts.

Documents are dealt to shards of about ``SHARD_WORDS`` words (whole documents; one that is longer is a shard
by itself). A shard's words become numbers by the vocabulary of the test items, 0 for words that no item
has and between documents, and its suffixes are sorted: several words are packed into one 64-bit key, and ties
are refined by the keys further on. Suffixes that begin with a 0 can meet no item and are left out.

Every suffix of a test item is then searched by bisection in every shard. Its first ``WINDOW`` words (the
whole item, if it has fewer) bound an interval of the array: all places where they stand verbatim. The words
there are *hit*. Without that bound the bisection goes on to the longest match, see ``longest_matches``.

Items are searched in blocks of about ``BLOCK_WORDS`` words, so that what is sent to the tasks is bounded
however many items there are: a block is one more step over the same rows, which carry their hits along. Nothing is
shuffled, and the driver sees the items of one block at a time, never a document.

Defined cases: null, empty and wordless texts have no words and no hits; items without words are never met; an item
without an id goes by the empty string, and ids are told once however many items share them; equal rows have
equal results; no items, no hits; an empty table gives no rows; very long texts are one shard, which takes
some 60 bytes a word; other columns come through as they are, and one of a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.state import materialize
from lectern.llm.words import as_bytes, word_blocks

WINDOW = 10
SHARD_WORDS, BLOCK_WORDS = 1 << 19, 1 << 20
#: Steps over the rows in one stage; beyond, they are written between.
STEPS = 16
HITS = "n_words bigint, items array<string>, starts array<int>, ends array<int>"


def packed(words: np.ndarray, bits: int) -> np.ndarray:
    """For each position the next ``63 // bits`` words in one number; from the first 0 on, zeros."""
    keys, alive = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=bool)
    for step in range(63 // bits):
        ahead = np.zeros(len(words), dtype=np.int64)
        ahead[: max(0, len(words) - step)] = words[step:]
        alive &= ahead > 0
        keys = (keys << bits) | np.where(alive, ahead, 0)
    return keys


class SuffixArray:
    """The suffixes of ``words`` that begin with a number above 0, in order of their first ``depth`` words."""

    def __init__(self, words: np.ndarray, bits: int, depth: int) -> None:
        self.bits, self.per, self.keys = bits, 63 // bits, packed(words, bits)
        starts = np.flatnonzero(words)
        self.order = starts[np.argsort(self.keys[starts], kind="stable")]
        self.first = self.keys[self.order]
        self._refine(depth)

    def ahead(self, places: np.ndarray) -> np.ndarray:
        """The keys at ``places``, which may lie beyond the end."""
        found = np.zeros(len(places), dtype=np.int64)
        inside = places < len(self.keys)
        found[inside] = self.keys[places[inside]]
        return found

    def _refine(self, depth: int) -> None:
        """Order suffixes of equal keys by the keys further on, until ``depth`` words are told apart."""
        full, last = (1 << self.bits) - 1, self.first
        group = np.arange(len(last))
        group[1:][last[1:] == last[:-1]] = 0
        group = np.maximum.accumulate(group)
        open_ = (last & full) != 0  # a key that ends in 0 is told to its end
        at, seen = np.flatnonzero(open_ & _tied(group)), self.per
        while seen < depth and len(at):
            places = self.order[at]
            keys, groups = self.ahead(places + seen), group[at]
            sort = np.lexsort((keys, groups))
            self.order[at], keys, groups = places[sort], keys[sort], groups[sort]
            new = np.ones(len(at), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])
            group[at] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            at = at[((keys & full) != 0) & _tied(group[at])]
            seen += self.per

    def lower(self, low: np.ndarray, high: np.ndarray, value: np.ndarray, seen: int) -> np.ndarray:
        """For each interval the first suffix whose key after ``seen`` words is not below ``value``."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            below = self.ahead(self.order[mid] + seen) < value[open_]
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low

    def find(self, queries: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with ``lengths`` words at places ``queries`` of the text of ``keys``."""
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(self.order))
        for seen in range(0, int(lengths.max(initial=0)), self.per):
            asked = np.flatnonzero((lengths > seen) & (low < high))
            rest = self.bits * np.maximum(0, self.per - (lengths[asked] - seen))
            least = (keys[queries[asked] + seen] >> rest) << rest
            beyond = least + (np.int64(1) << rest)
            if seen:
                bounds = [self.lower(low[asked], high[asked], v, seen) for v in (least, beyond)]
            else:
                bounds = [np.searchsorted(self.first, v) for v in (least, beyond)]
            low[asked], high[asked] = bounds
        return low, high

    def longest(self, queries: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the length of its longest match and a place where it stands."""
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(self.order))
        length, place, asked, seen = np.zeros(len(queries), dtype=np.int64), np.zeros(len(queries), dtype=np.int64), np.arange(len(queries)), 0
        shifts = self.bits * np.arange(self.per)[::-1]
        while len(asked) and len(self.order):
            there = queries[asked] + seen
            value = np.where(there < len(keys), keys[np.minimum(there, len(keys) - 1)], 0)
            words = (((value[:, None] >> shifts) & ((1 << self.bits) - 1)) != 0).sum(axis=1)
            left, right = self.lower(low[asked], high[asked], value, seen), self.lower(low[asked], high[asked], value + 1, seen)
            for near in (left - 1, left):  # the neighbours of where it would stand share most
                inside = (near >= low[asked]) & (near < high[asked])
                at = self.order[np.minimum(np.maximum(near, 0), len(self.order) - 1)]
                same = ((self.ahead(at + seen)[:, None] >> shifts) == (value[:, None] >> shifts)).sum(axis=1)
                got = seen + np.minimum(same, words)
                better = inside & (got > length[asked])
                length[asked[better]], place[asked[better]] = got[better], at[better]
            go_on = (left < right) & (words == self.per)
            low[asked], high[asked] = left, right
            asked, seen = asked[go_on], seen + self.per
        return length, place


def _tied(group: np.ndarray) -> np.ndarray:
    """Whether a neighbour is in the same group."""
    same = group[1:] == group[:-1]
    return np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(group) else np.zeros(0, dtype=bool)


class Items:
    """A block of test items: their words as numbers, and their distinct windows."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names, texts, windows = [], [], {}
        at = 0
        self.owner: list[int] = []
        for name, text in rows:
            words = [w for block in word_blocks(text) for w in block]
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[k : k + size]), (at + k, size, set()))[2].add(name)
            texts += [*ids, 0]
            self.owner += [len(self.names)] * (len(ids) + 1)
            self.names.append(name)
            at += len(ids) + 1
        # the largest number is kept free, so that a key's successor does not overflow
        self.bits = max(1, (len(self.vocabulary) + 2).bit_length())
        self.words = np.array(texts, dtype=np.int64)
        self.keys = packed(self.words, self.bits)
        held = list(windows.values())
        self.places = np.array([h[0] for h in held], dtype=np.int64)
        self.sizes = np.array([h[1] for h in held], dtype=np.int64)
        self.named = [sorted(h[2]) for h in held]
        self.depth = int(self.sizes.max(initial=0))


def _shards(batch: pa.RecordBatch, column: int, items: Items) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch, with their words as numbers (a 0 after each document) and where each document begins and the last ends."""
    get, first, parts, bounds = items.vocabulary.get, 0, [], [0]
    for row, text in enumerate(as_bytes(batch.column(column))):
        n = 0
        for words in word_blocks(text):
            parts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
            n += len(words)
        parts.append(np.zeros(1, dtype=np.int64))
        bounds.append(bounds[-1] + n + 1)
        if bounds[-1] >= SHARD_WORDS or row == batch.num_rows - 1:
            yield batch.slice(first, row + 1 - first), np.concatenate(parts), np.array(bounds)
            first, parts, bounds = row + 1, [], [0]


def _search(shard: pa.RecordBatch, words: np.ndarray, bounds: np.ndarray, items: Items) -> pa.RecordBatch:
    """The rows of a shard (row, text, n_words, items, starts, ends) with the hits of a block of items added to those that they carry."""
    array = SuffixArray(words, items.bits, items.depth)
    low, high = array.find(items.places, items.sizes, items.keys)
    met = np.flatnonzero(high > low)
    many = high[met] - low[met]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    window = np.repeat(met, many)
    place = array.order[np.repeat(low[met], many) + within]
    n = len(words)
    edge = np.bincount(place, minlength=n + 1) - np.bincount(place + items.sizes[window], minlength=n + 1)
    owner = np.searchsorted(bounds, place, "right") - 1
    pairs = np.unique(owner * max(1, len(items.places)) + window)
    names = [set(x) for x in shard.column(3).to_pylist()]
    for pair in pairs.tolist():
        names[pair // len(items.places)].update(items.named[pair % len(items.places)])
    for row, (a, b) in enumerate(zip(shard.column(4).to_pylist(), shard.column(5).to_pylist(), strict=True)):
        for s, e in zip(a, b, strict=True):  # what earlier blocks hit
            edge[bounds[row] + s] += 1
            edge[bounds[row] + e] -= 1
    hit = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    starts, ends = turn[::2], turn[1::2]  # a document ends in a 0, so no run passes over it
    of = np.searchsorted(bounds, starts, "right") - 1
    offsets = pa.array(np.searchsorted(of, np.arange(len(names) + 1)), pa.int32())
    spans = [pa.ListArray.from_arrays(offsets, pa.array((x - bounds[of]).astype(np.int32))) for x in (starts, ends)]
    new = [pa.array(np.diff(bounds) - 1), pa.array([sorted(x) for x in names], pa.list_(pa.string())), *spans]
    return pa.RecordBatch.from_arrays([*shard.columns[:2], *new], names=["row", "text", "n_words", "items", "starts", "ends"])


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items (item_id, text) in blocks of about ``block_words`` words, each by itself on the driver; repeated rows once."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("bigint"))).first()[0] or 0
    many = -(-words // block_words)
    for k in range(many):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k).orderBy("item_id", "text")
        yield [(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()]


def find_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (text, ...) with what of ``items`` (item_id, text) stands in them.

    New columns: n_words, n_hit, items (sorted ids of items with windows there), and spans, the runs of hit words as (at, words).
    """
    new = ["n_words", "n_hit", "items", "spans"]
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("n_words", F.lit(0).cast("bigint")).withColumn("items", F.array().cast("array<string>")).withColumns({c: F.array().cast("array<int>") for c in ("starts", "ends")})
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string(HITS).fields])

    def step(rows: DataFrame, block: list[tuple[str, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Items(block, window)
            for batch in batches:
                for shard, words, bounds in _shards(batch, 1, held):
                    yield _search(shard, words, bounds, held)

        return rows.mapInArrow(run, schema)

    some = False
    for k, block in enumerate(_blocks(items, block_words)):
        rows, some = step(materialize(rows, "searched") if k and k % STEPS == 0 else rows, block), True
    if not some:  # the words are still to be counted
        rows = step(rows, [])
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    spans = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("at"), (e - s).alias("words")))
    return rows.select(*(F.col(f"row.`{c}`") for c in kept), "n_words", hit.alias("n_hit"), "items", spans.alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of an item."""
    # what find_items adds stands beside the row, whatever that is called
    rows = docs.select(F.struct("*").alias("whole"), F.col("text"))
    return find_items(rows, items, window).filter("n_hit = 0").select("whole.*")


def longest_matches(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (item_id, n_words, item_at, doc_id, doc_at): of each item that shares a word with a document its longest verbatim match.

    Of several the one first in the item, then in the smallest doc_id, is told. Places are numbers of words.
    """
    spark = docs.sparkSession
    out = "item_id string, n_words bigint, item_at bigint, doc_id string, doc_at bigint"
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(block: list[tuple[str, bytes]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Items(block, WINDOW)
            queries = np.flatnonzero(held.words)
            owner = np.array(held.owner, dtype=np.int64)
            begins = np.searchsorted(owner, np.arange(len(held.names)))
            for batch in batches:
                for shard, words, bounds in _shards(batch, 1, held):
                    array = SuffixArray(words, held.bits, int(np.diff(np.append(begins, len(owner))).max(initial=0)))
                    length, place = array.longest(queries, held.keys)
                    best = np.lexsort((queries, -length, owner[queries]))
                    best = best[np.unique(owner[queries][best], return_index=True)[1]]
                    best = best[length[best] > 0]
                    at = place[best]
                    doc = np.searchsorted(bounds, at, "right") - 1
                    of = owner[queries[best]]
                    columns = [pa.array([held.names[i] for i in of.tolist()], pa.string()), pa.array(length[best]), pa.array(queries[best] - begins[of]), shard.column(0).take(pa.array(doc)), pa.array(at - bounds[doc])]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "n_words", "item_at", "doc_id", "doc_at"])

        return rows.mapInArrow(run, out)

    found = spark.createDataFrame([], out)
    for block in _blocks(items, block_words):
        found = found.unionByName(search(block))
    best = F.max_by(F.struct("n_words", "item_at", "doc_id", "doc_at"), F.struct("n_words", -F.col("item_at")))
    return found.groupBy("item_id").agg(best.alias("m")).select("item_id", "m.*")
