"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes);
   its *sketch* is the ``k`` smallest. Equal sets are one class, numbered and
   represented by one text (smallest doc_id, then hash of the text), so copies
   and repeated rows never multiply pairs.
2. Inverted lists of retained values give candidates. Lists of up to
   ``list_limit`` classes are *cold*: their pairs are counted, and a pair is a
   candidate when it shares enough retained values. For a pair at the
   threshold each retained value of the union's sketch is shared with
   probability 0.75, so ``k = 48`` values are shared 36 times on average and
   fewer than 20 times with probability 2e-7.
3. Longer lists are *hot* (a boilerplate line, a large group of near copies).
   A pair that the cold lists miss shares at least 20 retained values and no
   cold one, so only classes with 20 hot values take part. Each is first
   compared with the leaders of a few of its lists (the class with the most hot
   values: the least edited copy). What is then still in different components
   goes through an exact prefix filter over the full sets of these classes,
   rarest shingles first: a linked pair must share one of the first
   ``n - ceil(0.75 n) + 1``, early enough for the rest to suffice. A class and a
   large component that meet there are compared as a whole, in tiles of two
   blocks, which give one link a class instead of every pair. No list is cut, no
   candidate is dropped.
4. Candidates are verified on the full sets, read again from the texts: first
   the union sketch estimates the similarity, then exact Jaccard decides. One
   pair per class is verified first, and only pairs that still cross
   components follow.

Defined cases: null or word-free texts have no shingles, link with nothing and
are kept, as are rows without a doc_id (their component is null); a repeated doc_id stands for one document per distinct text, which links
by its own text only; repeated rows of a kept document are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import connected_components
from lectern.llm.state import materialize, small_side
from lectern.llm.textkernel import overlap, shingle_sets, splitmix

K, LIST_LIMIT, PERCENT, WIDTH = 48, 64, 75, 5
#: Retained values shared by a pair at the threshold (fewer with probability 2e-7), and cold ones asked of a candidate without hot ones.
SHARED, ASKED = 20, 8
#: Classes that make a shingle a very common one in the join for its count.
OFTEN = 128
#: Classes that make a component large, and classes in a block of a tile.
LARGE, BLOCK = 32, 256
#: Share of the union sketch below which a pair at 0.75 falls with probability under 1e-7.
ESTIMATE_FLOOR = 0.4


def sketches(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_shingles, f1, f2, sketch, h): f1, f2 are a 128-bit fingerprint of the set, h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1), width)
                wide = [s.view(np.uint64) for s in sets]
                prints = [[int(np.sum(splitmix(s ^ np.uint64(x)), dtype=np.uint64).astype(np.int64)) for s in wide] for x in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                kept = [s[:k] for s in sets]
                ends = np.cumsum([0] + [len(s) for s in kept]).astype(np.int32)
                values = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[0], pa.int64()), pa.array(prints[1], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), part.column(2)],
                    names=["doc_id", "n_shingles", "f1", "f2", "sketch", "h"],
                )

    return _keyed(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch array<bigint>, h bigint")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, h) of ``docs``; a document is a doc_id with a text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("h"))


def text_hash() -> Column:
    """The hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _floor(n: Column) -> Column:
    """Retained values that a linked pair shares, whose smaller set has ``n`` shingles."""
    return F.least(F.lit(SHARED), F.ceil(n * 0.75)).cast("int")


def _sized(pairs: DataFrame) -> DataFrame:
    """Pairs whose set sizes alone allow the similarity."""
    return pairs.filter(f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb) and a < b")


def verify(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, width: int = WIDTH, k: int = K) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts' full sets reach ``percent`` per cent Jaccard similarity."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right_text"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left_text", "right_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep = []
                for x, y in zip(shingle_sets(part.column(2), width), shingle_sets(part.column(3), width), strict=True):
                    union = np.union1d(x[:k], y[:k])[:k]
                    both = overlap(union, np.intersect1d(x[:k], y[:k], assume_unique=True))
                    if len(union) == k and both < ESTIMATE_FLOOR * k:
                        keep.append(False)
                        continue
                    shared = overlap(x, y)
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a bigint, b bigint")


def _cold(index: DataFrame, hot: DataFrame, heated: DataFrame | None, limit: int) -> DataFrame:
    """Candidates from lists of up to ``limit`` classes: pairs that share enough of them.

    A pair shares ``_floor`` retained values, of which at most the smaller number of hot values (``heated``) is hot.
    """
    lists = index.join(hot, "v", "left_anti").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("rep", "n"))).alias("l")).filter("size(l) > 1")
    pairs = lists.select("l", F.posexplode("l").alias("i", "x")).select("x", F.explode(F.expr("slice(l, i + 2, size(l))")).alias("y"))
    pairs = _sized(pairs.select(F.col("x.rep").alias("a"), F.col("x.n").alias("na"), F.col("y.rep").alias("b"), F.col("y.n").alias("nb")))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("na", "nb")).alias("m"))
    strong = F.col("shared") >= F.least(F.lit(ASKED), _floor(F.col("m")))
    if heated is None:
        return counted.filter(strong).select("a", "b")
    for end in ("a", "b"):
        counted = counted.join(heated.select(F.col("rep").alias(end), F.col("h").alias(f"h{end}")), end, "left")
    return counted.filter(strong | F.coalesce(F.col("shared") + F.col("ha") >= _floor(F.col("m")), F.lit(False)) & F.coalesce(F.col("shared") + F.col("hb") >= _floor(F.col("m")), F.lit(False))).select("a", "b")


def _prefixes(texts: DataFrame, tied: DataFrame) -> DataFrame:
    """Rows (v, rep, n, i): of each class the rarest shingles, one of which is shared with every similar class, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1), WIDTH)
                sizes = np.array([len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), sizes))), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["rep", "n", "v"])

    own = texts.join(small_side(tied.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    rows = own.select("doc_id", "text").mapInArrow(run, "rep bigint, n bigint, v bigint")
    seen = materialize(rows.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "seen")
    # rows of a shingle that very many classes have are told their count by a broadcast, and then spread over the join for the others
    often = small_side(seen.filter(F.col("c") > OFTEN).select("v", F.col("c").alias("often")))
    salt = F.when(F.col("often").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) + 1).cast("int").alias("salt")
    rows = rows.join(often, "v", "left").select("rep", "n", "v", "often", salt)
    rows = rows.join(seen.filter(F.col("c") <= OFTEN).withColumn("salt", F.lit(0)), ["v", "salt"], "left").withColumn("c", F.coalesce("often", "c"))
    ordered = rows.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "v"))).alias("l"))
    first = F.slice("l", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 0.75) + 1).cast("int"))
    return ordered.select("rep", "n", F.posexplode(first).alias("i", "x")).filter("x.c > 1").select("x.v", "rep", "n", (F.col("i") + 1).alias("i"))


def _against_large(rows: DataFrame, sizes: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of prefix rows (v, rep, n, i, c) and the large components (c, members) of others.

    A class and a component that meet in a list are compared as a whole: the component's classes and those to be
    compared are dealt to blocks of ``BLOCK``, a tile holds one block of each, and gives one link per class at most.
    """
    there = rows.join(small_side(sizes), "c").groupBy("v", "c").agg(F.max(F.col("n") - F.col("i")).alias("rest"), F.min("n").alias("least"), F.max("n").alias("longest"))
    # as for single pairs: what follows a common shingle must suffice, for the best case of the component
    fits = f"c <> rc and {100 + PERCENT} * (1 + least(rest, rn - ri)) >= {PERCENT} * (least + rn) and 100 * longest >= {PERCENT} * rn and 100 * rn >= {PERCENT} * least"
    asked = rows.select("v", F.col("rep").alias("r"), F.col("n").alias("rn"), F.col("i").alias("ri"), F.col("c").alias("rc")).join(there, "v").filter(fits)
    asked = materialize(asked.groupBy("r", "c").agg(F.first("rn").alias("rn")).select("r", "c"), "asked")
    blocks = sizes.join(asked.groupBy("c").agg(F.count(F.lit(1)).alias("asking")), "c").select("c", F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("asking") / BLOCK).cast("int").alias("ab"))
    blocks = small_side(materialize(blocks, "blocks"))
    place = lambda node, n: F.pmod(F.xxhash64(node), F.col(n)).cast("int")
    one = asked.join(blocks, "c").select("c", place("r", "ab").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), F.lit(True).alias("asks"), F.col("r").alias("doc_id"))
    members = groups.join(rows.select(F.col("rep").alias("node")).distinct(), "node", "left_semi").select(F.col("component").alias("c"), "node")
    two = members.join(blocks, "c").select("c", F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("i"), place("node", "mb").alias("j"), F.lit(False).alias("asks"), F.col("node").alias("doc_id"))

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), bool)
        ids, sets = table.column("doc_id").to_numpy(), shingle_sets(table.column("text"), WIDTH)
        held = [k for k in range(len(sets)) if not asks[k]]
        sizes_held = np.array([len(sets[k]) for k in held])
        every = np.concatenate([sets[k] for k in held]) if held else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        values, owner = every[order], np.repeat(np.arange(len(held)), sizes_held)[order]
        found: list[tuple[int, int]] = []
        for k in np.flatnonzero(asks) if held else ():
            low, high = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
            many = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(held))
            hits = np.flatnonzero((100 * shared >= PERCENT * (len(sets[k]) + sizes_held - shared)) & (shared > 0))
            if len(hits):
                a, b = int(ids[k]), int(ids[held[hits[0]]])
                found.append((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    both = one.unionByName(two).join(texts, "doc_id")
    return both.groupBy("c", "i", "j").applyInArrow(run, "a bigint, b bigint").filter("a <> b").distinct()


def _texts(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows (doc_id, text), one per class of ``picks`` (rep, doc_id, h): the class's number and its text, however often it stands in ``docs``."""
    texts = materialize(_keyed(docs).join(small_side(picks), ["doc_id", "h"]).select(F.col("rep").alias("doc_id"), "text"), "texts")
    again = materialize(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id"), "again")
    if not again.take(1):
        return texts
    side = small_side(again)
    once = texts.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.first("text").alias("text"))
    return materialize(texts.join(side, "doc_id", "left_anti").unionByName(once), "texts")


def near_duplicates(docs: DataFrame, k: int = K, list_limit: int = LIST_LIMIT, large: int = LARGE, hashed: bool = False) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``; see the module's text. With ``hashed`` also h, the ``text_hash``."""
    sigs = materialize(sketches(docs, k), "sketches")
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("f1", "f2", "n_shingles").agg(F.min(F.struct("doc_id", "h")).alias("lead"), F.min_by("sketch", "doc_id").alias("sketch"))
    # a doc_id with several texts is in several classes: from here to the result a class goes by its number, fixed by being written
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    index = classes.select(F.explode("sketch").alias("v"), "rep", F.col("n_shingles").cast("int").alias("n"))
    hot = materialize(index.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > list_limit).select("v"), "hot")
    some_hot = bool(hot.take(1))
    hot_side = small_side(hot)
    heated = None
    if some_hot:
        m = F.ceil(F.col("n") * 0.75)
        heated = index.join(hot_side, "v").groupBy("rep", "n").agg(F.array_sort(F.collect_list("v")).alias("hv")).withColumn("h", F.size("hv"))
        heated = materialize(heated.filter(F.col("h") > _floor(m) - ASKED), "heated")
        tied = heated.filter(F.col("h") >= _floor(m))
    cold = materialize(_cold(index, hot_side, small_side(heated.select("rep", "h")) if some_hot else None, list_limit), "cold")
    first = cold.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    if some_hot:
        led = tied.select("rep", "n", "h", F.explode(F.slice("hv", 1, 2)).alias("v"))
        leaders = led.groupBy("v").agg(F.max(F.struct("h", F.xxhash64("rep").alias("x"), F.col("rep").alias("lead"), F.col("n").alias("ln"))).alias("s")).select("v", "s.lead", "s.ln")
        starts = led.join(leaders, "v").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b"), F.col("n").alias("na"), F.col("ln").alias("nb"))
        first = materialize(first.unionByName(_sized(starts).select("a", "b")).distinct(), "first")

    wanted = cold.select(F.col("a").alias("rep")).unionByName(cold.select(F.col("b").alias("rep")))
    if some_hot:
        wanted = wanted.unionByName(tied.select("rep"))
    wanted = materialize(classes.select("rep", "lead.doc_id", "lead.h").join(wanted.distinct(), "rep", "left_semi"), "wanted")
    texts = _texts(docs, wanted)

    links = materialize(verify(first, texts), "links")
    groups = materialize(connected_components(links), "groups")

    def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        ends = pairs
        for end in ("a", "b"):
            ends = ends.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return ends.filter("ca <> cb").select("a", "b")

    rest = apart(cold, groups)
    if some_hot:
        rows = _prefixes(texts, tied).join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "n", "i", F.coalesce("component", "rep").alias("c"), "v")
        rows = materialize(rows, "rows")
        sizes = groups.join(small_side(tied.select(F.col("rep").alias("node"))), "node", "left_semi").groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= large)
        sizes = materialize(sizes, "large")
        links = materialize(links.unionByName(_against_large(rows, sizes, groups, texts)), "links")
        # what is left of the lists: pairs of small components
        rows = rows.join(small_side(sizes), "c", "left").withColumn("large", F.col("members").isNotNull()).drop("members")
        most = rows.groupBy("v", "c", "large").agg(F.count(F.lit(1)).alias("s")).groupBy("v").agg(F.max(F.struct("s", "c")).alias("top"), F.sum(F.when(~F.col("large"), F.col("s"))).alias("all"))
        # a list is dealt to tiles of two blocks, so that no task holds a long one
        most = most.filter("all > 1").select("v", F.col("top.c").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"))
        place = lambda node: F.pmod(F.xxhash64(node), F.col("blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        rows = rows.filter("not large").join(small_side(materialize(most, "most")), "v")
        aside = rows.filter("c <> top").select("v", place("rep").alias("p"), every.alias("q"), F.col("rep").alias("r"), F.col("n").alias("rn"), F.col("i").alias("ri"), F.col("c").alias("rc"))
        rows = rows.select("v", every.alias("p"), place("rep").alias("q"), "rep", "n", "i", "c")
        # from a common shingle on, two classes cannot share more than what follows in either
        cross = aside.join(rows, ["v", "p", "q"]).filter(f"c <> rc and {100 + PERCENT} * (1 + least(n - i, rn - ri)) >= {PERCENT} * (n + rn)")
        ends = [F.when(F.col("rep") < F.col("r"), F.struct(F.col(x).alias("id"), F.col(y).alias("n"), F.col(z).alias("i"))).otherwise(F.struct(F.col(p).alias("id"), F.col(q).alias("n"), F.col(w).alias("i"))) for x, y, z, p, q, w in (("rep", "n", "i", "r", "rn", "ri"), ("r", "rn", "ri", "rep", "n", "i"))]
        cross = cross.select("v", ends[0].alias("x"), ends[1].alias("y")).groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        cross = cross.agg(F.count_distinct("v").alias("shared"), F.max("x.i").alias("i"), F.max("y.i").alias("j")).withColumn("most", F.col("shared") + F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")))
        cross = materialize(cross.filter(f"{100 + PERCENT} * most >= {PERCENT} * (na + nb)").select("a", "b", "shared"), "cross")
        # each class with its likeliest partner first: most of the others then are within one component
        likely = cross.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b")).unionByName(cross.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")).distinct()
        links = materialize(links.unionByName(verify(likely, texts)), "links")
        groups = materialize(connected_components(links), "groups")
        rest = materialize(apart(rest.unionByName(cross.select("a", "b")).distinct(), groups), "rest")
    # written, as a task that also goes on to the components' Python would hold two workers
    more = materialize(verify(rest, texts), "links")
    groups = connected_components(links.unionByName(more))

    named = materialize(classes.select("f1", "f2", "n_shingles", "rep", "lead").join(groups.withColumnRenamed("node", "rep"), "rep", "left"), "named")
    # a component goes by its smallest doc_id
    heads = materialize(named.filter("component is not null").groupBy("component").agg(F.min("lead").alias("head")), "heads")
    linked = named.filter("component is not null").join(small_side(heads), "component").select("f1", "f2", "n_shingles", "head")
    reps = linked.unionByName(named.filter("component is null").select("f1", "f2", "n_shingles", F.col("lead").alias("head")))
    out = sigs.select("doc_id", "n_shingles", "f1", "f2", "h").join(reps, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("head.doc_id", "doc_id"))
    kept = F.when(F.col("doc_id").isNull() | F.col("head").isNull(), F.lit(True)).otherwise((F.col("doc_id") == F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), *(["h"] if hashed else []))
