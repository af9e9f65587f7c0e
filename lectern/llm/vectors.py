"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, exact where it matters.

A vector x with unit direction u is stored as ``q = round(u / s)`` in int8 with
its own scale ``s``. With ``w = s q`` and ``e = u - w``,

    u1.u2 = w1.w2 + w1.e2 + e1.u2,  so  |u1.u2 - w1.w2| <= |w1||e2| + |e1|.

Integer products are exact in float32 (127 * 127 * dim < 2**24 for dim <= 1040;
wider vectors use float64), so only pairs with ``w1.w2 + bound >= threshold``
can be links, and just those are computed in double precision.

Equal vectors of one label are one class. The classes of a label are dealt to
blocks of about ``block`` rows by a hash, and each pair of blocks is one tile:
a tile holds at most two blocks however large a label is. Vectors travel in the type they have, once
per block of their label. A tile returns counts
per class and a spanning forest of its links, never the pairs themselves; results go back to rows by a 128-bit
hash of the vector.
The work is the pairs within labels, as asked; no pair is left out.

Defined cases: null labels, and vectors that are null, empty, zero or hold null
or non-finite components, link with nothing, nor do rows without a vec_id (kept, component null); vectors of unequal length do not
link; repeated rows count as separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.graph import connected_components, union
from lectern.llm.state import materialize

THRESHOLD, BLOCK = 0.98, 2048
#: Pairs recomputed at once.
_CHUNK = 1 << 15


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, |w|, |e|) of unit rows; the norms are rounded up, so that the bound holds in floating point."""
    s = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / s[:, None])
    w = q * s[:, None]
    up = 1 + 1e-12
    return q.astype(np.int8), s, np.linalg.norm(w, axis=1) * up, np.linalg.norm(unit - w, axis=1) * up + 1e-12


def tile_links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of x and y with cosine >= threshold; i < j where ``same``."""
    (ux, nx), (uy, ny) = ((v / n[:, None], n) for v, n in ((x, np.linalg.norm(x, axis=1)), (y, np.linalg.norm(y, axis=1))))
    (qx, sx, wx, ex), (qy, sy, wy, ey) = quantise(ux), quantise(uy)
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    qy_t = qy.astype(kind).T
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        dots = (qx[part].astype(kind) @ qy_t).astype(np.float64) * sx[part, None] * sy
        dots += wx[part, None] * ey + ex[part, None] + 1e-9
        i, j = np.nonzero(dots >= threshold)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), _CHUNK):
            a, b = i[k : k + _CHUNK], j[k : k + _CHUNK]
            sure = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
            yield a[sure], b[sure]


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pandas()
        first, second = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        out = []
        for _, group in rows.groupby(rows["embedding"].map(len)):
            left = group[group["at"] == first]
            right = left if first == second else group[group["at"] == second]
            if not len(left) or not len(right):
                continue
            x, y = (np.stack(g["embedding"].to_numpy()).astype(np.float64) for g in (left, right))
            # rescaled so that squares neither overflow nor vanish; cosines do not change
            x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
            ids_x, ids_y = left["rep"].to_numpy(), right["rep"].to_numpy()
            many_x, many_y = left["many"].to_numpy(), right["many"].to_numpy()
            count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            base = 0 if first == second else len(x)
            root = np.arange(base + len(y))
            for a, b in tile_links(x, y, threshold, first == second):
                np.add.at(count_x, a, many_y[b])
                np.add.at(count_y, b, many_x[a])
                root = union(root, a, b + base)
            edges = np.flatnonzero(root != np.arange(len(root)))
            ids = ids_x if first == second else np.concatenate([ids_x, ids_y])
            counts = count_x + count_y if first == second else np.concatenate([count_x, count_y])
            hit = counts > 0
            out.append(pd.DataFrame({"a": ids[hit], "b": ids[hit], "n": counts[hit]}))
            out.append(pd.DataFrame({"a": ids[root[edges]], "b": ids[edges], "n": np.zeros(len(edges), np.int64)}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []})
        return pa.Table.from_pandas(found.astype("int64"), preserve_index=False)

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of ``vectors`` (vec_id, embedding, label); see the module's text."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding"))
    sound = "vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    prints = [F.xxhash64("embedding").alias("f1"), F.xxhash64(F.lit(1), "embedding").alias("f2")]
    classes = rows.filter(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    classes = materialize(classes.select("*", *prints), "vector-classes")
    blocks = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = classes.join(blocks, "label").withColumn("at", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    tiles = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("label", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "rep", "many", "embedding")
    found = materialize(tiles.groupBy("label", "i", "j").applyInArrow(_tile(threshold), "a bigint, b bigint, n bigint"), "vector-links")
    links = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    groups = connected_components(found.filter("n = 0").select("a", "b"), "vector-components").withColumnRenamed("node", "rep")
    known = classes.select("label", "f1", "f2", "rep", "many").join(links, "rep", "left").join(groups, "rep", "left")
    known = known.select("label", "f1", "f2", (F.col("many") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.select("vec_id", "label", *(F.when(F.expr(sound), p).alias(n) for p, n in zip(prints, ("f1", "f2"), strict=True))).join(known, ["label", "f1", "f2"], "left")
    known_id = F.col("vec_id").isNotNull()
    component, links = F.when(known_id, F.coalesce("c", "vec_id")), F.when(known_id, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    return out.select("vec_id", links.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
