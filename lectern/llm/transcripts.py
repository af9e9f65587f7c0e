"""Transcript parsing: roles of lines by a hidden Markov model, then canonical turns.

A transcript is a list of lines. States are (role, place): a line begins a
turn of its role or continues it. A line is observed as a marker class (what a
speaker marker at its start suggests), a length class, its end (question,
colon, other) and whether it looks like a list or code. Start, transition and
emission probabilities are counts over labelled lines with add-one smoothing;
roles are recovered by Viterbi and turns rendered as ``<|role|>`` blocks.

Lines of one transcript are decoded in blocks of ``BLOCK``: a block is
first reduced to its 6 x 6 matrix of best path scores, matrices of a transcript
give the best score into and out of every block, and each block is then decoded
between its own best boundary states. So a transcript that holds a third of all lines
puts no more than ``BLOCK`` lines, or one matrix per ``BLOCK`` lines, in a task, and
the path is the one Viterbi would find on the whole.

Defined cases: rows without an id belong to no transcript and are left out; null text is one empty line; an unmarked transcript is decoded
from its other features; equal scores go to the first state; rows of the same
id and place are all kept, ordered by a hash of their text; rows without a place come first, as place 0; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.state import materialize

ROLES = ("user", "assistant", "system")
STATES = tuple((r, p) for r in ROLES for p in ("begin", "go on"))
BLOCK = 4096
#: Lines that are decoded side by side.
HELD_LINES = 16_384
#: What speaker markers suggest; fixed word lists.
MARKERS = {
    "user": r"(?i)^[^\p{L}\p{N}]{0,4}(?:user|human|question|q|customer|me)[^\p{L}\p{N}]{0,3}[:>\]-]",
    "assistant": r"(?i)^[^\p{L}\p{N}]{0,4}(?:assistant|ai|bot|answer|a|agent|model)[^\p{L}\p{N}]{0,3}[:>\]-]",
    "system": r"(?i)^[^\p{L}\p{N}]{0,4}(?:system|sys|instructions?)[^\p{L}\p{N}]{0,3}[:>\]-]",
    "dash": r"^\s*(?:--?|>>|\*)\s",
}
SHAPES = (5, 6, 3, 3)  # levels of marker, length, end, look


def observed(line: Column) -> Column:
    """One number for the observed features of a line."""
    marker = F.lit(0)
    for k, pattern in reversed(list(enumerate(MARKERS.values(), 1))):
        marker = F.when(line.rlike(pattern), k).otherwise(marker)
    n = F.length(line)
    length = F.when(n == 0, 0).when(n <= 40, 1).when(n <= 120, 2).when(n <= 300, 3).when(n <= 800, 4).otherwise(5)
    end = F.when(line.rlike(r"\?\s*$"), 1).when(line.rlike(r":\s*$"), 2).otherwise(0)
    look = F.when(line.rlike(r"^\s*(?:[0-9]+[.)]|[|#])\s"), 1).when(line.rlike(r"^(?:```|\t| {4})"), 2).otherwise(0)
    return (((marker * SHAPES[1] + length) * SHAPES[2] + end) * SHAPES[3] + look).cast("int")


def unmarked(line: Column) -> Column:
    """The line without a speaker marker."""
    for pattern in list(MARKERS.values())[:3]:
        line = F.regexp_replace(line, pattern + r"[\]:>\x20\t]{0,4}", "")
    return line


def spread_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (id, place, text, ...) as one row per line: (id, pos, line) and the other columns; ``pos`` orders by (place, line)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    return rows.select("*", F.posexplode(lines).alias("line_no", "line")).drop(text)


class Model:
    """Log-probabilities: start (6), move (6 x 6), emit (6 x observations)."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        smooth = lambda c: np.log((c + 1.0) / (c + 1.0).sum(axis=-1, keepdims=True))
        self.start = smooth(counts["start"])
        self.move = smooth(counts["move"])
        # features are taken as independent given the state, so rare combinations keep a share
        grid = counts["emit"].reshape(len(STATES), *SHAPES)
        parts = [smooth(grid.sum(axis=tuple(k + 1 for k in range(4) if k != j))) for j in range(4)]
        self.emit = sum(p.reshape(len(STATES), *[SHAPES[j] if j == k else 1 for k in range(4)]) for j, p in enumerate(parts)).reshape(len(STATES), -1)


def train(lines: DataFrame) -> Model:
    """The model of labelled lines (id, place, line_no, obs, role): ``place`` numbers turns, ``role`` is theirs.

    Turns follow each other by ``place``; the move from a turn's last line is to the next turn's first.
    """
    known = lines.filter(F.col("role").isin(*ROLES))
    code = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role")).cast("int") - 1
    known = known.select("id", "place", "line_no", "obs", (2 * code + F.when(F.col("line_no") > 0, 1).otherwise(0)).cast("int").alias("state"))
    emit = known.groupBy("state", "obs").agg(F.count(F.lit(1)).alias("n")).collect()
    turns = known.groupBy("id", "place").agg(F.max("line_no").alias("last"), F.min("state").alias("state"))
    after = turns.select("id", (F.col("place") - 1).alias("place"), F.col("state").alias("next"))
    moves = turns.join(after, ["id", "place"], "left").groupBy("state", "next", F.when(F.col("last") > 0, 1).otherwise(0).alias("long")).agg(F.count(F.lit(1)).alias("n"), F.sum("last").alias("lines")).collect()
    start = turns.groupBy("id").agg(F.min_by("state", "place").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()
    s = len(STATES)
    counts = {"start": np.zeros(s), "move": np.zeros((s, s)), "emit": np.zeros((s, int(np.prod(SHAPES))))}
    for r in start:
        counts["start"][r["state"]] += r["n"]
    for r in emit:
        counts["emit"][r["state"], r["obs"]] += r["n"]
    for r in moves:
        begin = r["state"]
        if r["long"]:
            counts["move"][begin, begin + 1] += r["n"]
            counts["move"][begin + 1, begin + 1] += r["lines"] - r["n"]
        if r["next"] is not None:
            counts["move"][begin + r["long"], r["next"]] += r["n"]
    model = Model(counts)
    # a role's lines go on under that role only
    for i in range(s):
        for j in range(1, s, 2):
            if i // 2 != j // 2:
                model.move[i, j] = -1e6
    model.start[1::2] = -1e6
    return model


def _best(score: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Max-plus product of rows of ``score`` with ``by``."""
    return (score[:, :, None] + by[None]).max(axis=1)


def block_matrix(obs: np.ndarray, model: Model) -> np.ndarray:
    """Best score from the state before the block (row) to the state of its last line (column)."""
    m = np.where(np.eye(len(STATES), dtype=bool), 0.0, -1e9)
    for o in obs:
        m = _best(m, model.move) + model.emit[:, o]
    return m


def viterbi(obs: np.ndarray, entry: np.ndarray, leave: np.ndarray, model: Model) -> np.ndarray:
    """Best states of a block: ``entry`` scores its first line's state before emission, ``leave`` is added at the last line."""
    score, back = entry + model.emit[:, obs[0]], []
    for o in obs[1:]:
        ways = score[:, None] + model.move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + model.emit[:, o]
    path = [int((score + leave).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.array(path[::-1])


def many_viterbi(obs: np.ndarray, starts: np.ndarray, entry: np.ndarray, leave: np.ndarray, model: Model) -> np.ndarray:
    """``viterbi`` for many blocks at once: block k is ``obs[starts[k]:starts[k + 1]]``; the states of all lines."""
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    n, top = lengths[order], int(lengths.max())
    at = starts[:-1][order]
    score = entry[order] + model.emit.T[obs[at]]
    back = np.zeros((top, len(n), len(STATES)), np.int8)
    active = np.searchsorted(-n, -np.arange(top), "left")  # blocks longer than t
    for t in range(1, top):
        k = int(active[t])
        ways = score[:k, :, None] + model.move
        back[t, :k] = ways.argmax(axis=1)
        score[:k] = ways.max(axis=1) + model.emit.T[obs[at[:k] + t]]
    state = (score + leave[order]).argmax(axis=1)
    out = np.zeros(len(obs), np.int8)
    for t in range(top - 1, -1, -1):
        k = int(active[t])
        out[at[:k] + t] = state[:k]
        if t:
            state[:k] = back[t, np.arange(k), state[:k]]
    return out


def decode(lines: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``lines`` (id, pos, obs, line) with role, begins (a turn of its role), b (its block) and upto (turns begun so far in it), less obs.

    ``pos`` counts a transcript's lines from 0; lines of one place are ordered by their text.
    """
    lines = lines.select(F.col("id").cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"), "obs", "line").withColumn("b", F.floor(F.col("pos") / block).cast("bigint"))
    s = len(STATES)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        obs = pdf.sort_values(["pos", "h"])["obs"].to_numpy()
        first = pdf["b"].iloc[0] == 0
        # the first block's rows stand for the start, so its matrix leaves out the first move
        m = np.tile((model.start + model.emit[:, obs[0]])[None], (s, 1)) if first else block_matrix(obs[:1], model)
        for o in obs[1:]:
            m = _best(m, model.move) + model.emit[:, o]
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "b": [pdf["b"].iloc[0]], "m": [m.ravel().tolist()]})

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        ms = [np.array(m).reshape(s, s) for m in pdf["m"]]
        entry, leave = [model.start], [np.zeros(s)]
        reached = ms[0][0]
        for m in ms[1:]:
            entry.append((reached[:, None] + model.move).max(axis=0))
            reached = (reached[:, None] + m).max(axis=0)
        for m in ms[:0:-1]:
            leave.append((m + leave[-1][None]).max(axis=1))
        return pd.DataFrame({"id": pdf["id"], "b": pdf["b"], "entry": [e.tolist() for e in entry], "leave": [x.tolist() for x in leave[::-1]]})

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks stand together and in order; the last one of a batch waits for the next batch."""
        held: pa.Table | None = None
        for batch in itertools.chain(batches, (None,)):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
                if len(held) < HELD_LINES:
                    continue
            if held is None or not len(held):
                continue
            ids, blocks = (held.column(c).to_numpy() for c in ("id", "b"))
            starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])]))
            whole = len(held) if batch is None else int(starts[-1])
            if not whole:
                continue
            starts = np.append(starts[starts < whole], whole)
            part = held.slice(0, whole).combine_chunks()
            held = held.slice(whole)
            edge = [np.array(part.column(c).take(pa.array(starts[:-1])).to_pylist(), float).reshape(-1, s) for c in ("entry", "leave")]
            states = many_viterbi(part.column("obs").to_numpy(), starts, *edge, model)
            begins = states % 2 == 0
            upto = np.cumsum(begins)
            upto -= np.repeat(upto[starts[:-1]] - begins[starts[:-1]], np.diff(starts))
            roles = pa.DictionaryArray.from_arrays(pa.array(states // 2, pa.int8()), pa.array(ROLES)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("id", "pos", "line", "b")), roles, pa.array(begins), pa.array(upto, pa.int64())], names=["id", "pos", "line", "b", "role", "begins", "upto"])

    long = lines.groupBy("id").agg(F.max("b").alias("blocks")).filter("blocks > 0").select("id")
    told = lines.select("id", "b", "pos", "obs", F.xxhash64("line").alias("h")).join(long, "id", "left_semi")
    edges = told.groupBy("id", "b").applyInPandas(reduce, "id bigint, b bigint, m array<double>").groupBy("id").applyInPandas(bounds, "id bigint, b bigint, entry array<double>, leave array<double>")
    entry, leave = F.array(*(F.lit(float(x)) for x in model.start)), F.array(*(F.lit(0.0) for _ in range(s)))
    placed = lines.join(edges, ["id", "b"], "left").withColumn("entry", F.coalesce("entry", entry)).withColumn("leave", F.coalesce("leave", leave))
    # work is by line and not by byte, so the partitions are not to be merged
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.withColumn("h", F.xxhash64("line")).repartition(parts, "id", "b").sortWithinPartitions("id", "b", "pos", "h")
    return placed.select("id", "pos", "line", "b", "obs", "entry", "leave").mapInArrow(paths, "id bigint, pos bigint, line string, b bigint, role string, begins boolean, upto bigint")


def render(role: Column, text: Column) -> Column:
    """The canonical form of a turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>"))


STYLES = (("User: ", "Assistant: ", "System: "), ("Human> ", "AI> ", "Sys> "), ("[Q]: ", "[A]: ", "[SYSTEM]: "), ("### user: ", "### bot: ", "### instructions: "))
#: Of 10 turns, how many carry a speaker marker.
MARKED = 8


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """Plain transcripts of (conv_id, turn, role, text): each conversation in one style of marker, a fifth of the turns unmarked.

    Rows (id, place, line_no, pos, line, role) with the true role of each line.
    """
    styles = F.array(*(F.array(*(F.lit(m) for m in style)) for style in STYLES))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    code = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role")).cast("int")
    marker = F.when((code > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(10)) < MARKED), F.get(F.get(styles, style), code - 1)).otherwise(F.lit(""))
    text = F.concat(marker, F.coalesce(F.col("text"), F.lit("")))
    return number_lines(conversations.select(F.col("conv_id").cast("bigint").alias("id"), F.col("turn").cast("bigint").alias("place"), "role", text.alias("text")))


def number_lines(rows: DataFrame) -> DataFrame:
    """Lines of (id, place, role, text) with ``pos``, their number in the transcript.

    Turns are numbered from sums of lines per block of turns, so no transcript is ordered in one task.
    """
    from pyspark.sql import Window

    sized = rows.filter("id is not null").withColumn("n", F.size(F.split("text", "\n"))).withColumn("k", F.floor(F.coalesce("place", F.lit(0)) / 1024))
    sums = sized.groupBy("id", "k").agg(F.sum("n").alias("s"))
    before = sums.select("id", "k", (F.sum("s").over(Window.partitionBy("id").orderBy("k")) - F.col("s")).alias("before"))
    order = Window.partitionBy("id", "k").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = sized.withColumn("upto", F.sum("n").over(order)).join(before, ["id", "k"]).withColumn("from", F.col("before") + F.col("upto") - F.col("n"))
    return first.select("id", "place", "role", "from", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("id", "place", "role", "line_no", (F.col("from") + F.col("line_no")).alias("pos"), "line")


def parse(transcripts: DataFrame, model: Model) -> DataFrame:
    """Recovered turns of ``transcripts`` (id, pos, line): (id, turn, first_pos, role, text, rendered), one row per turn.

    A turn's lines are gathered, no more: its text is at most the turn itself.
    """
    from pyspark.sql import Window

    lines = transcripts.select("id", F.coalesce(F.col("pos"), F.lit(0)).alias("pos"), F.coalesce(F.col("line"), F.lit("")).alias("line")).filter("id is not null")
    found = materialize(decode(lines.withColumn("obs", observed(F.col("line"))), model), "roles")
    # turns of earlier blocks, for transcripts that have some
    sums = found.groupBy("id", "b").agg(F.max("upto").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("id").orderBy("b")) - F.col("s")).filter("before > 0").select("id", "b", "before")
    held = found.join(before, ["id", "b"], "left").withColumn("turn", F.coalesce("before", F.lit(0)) + F.col("upto") - 1)
    turns = held.groupBy("id", "turn", "role").agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("pos", F.xxhash64("line").alias("h"), "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x, i: F.when(i == 0, unmarked(x["line"])).otherwise(x["line"])), "\n")
    return turns.select("id", "turn", "first_pos", "role", text.alias("text"), render(F.col("role"), text).alias("rendered"))
