"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation maximises the sum of piece scores. The search goes through a text from left to
right and keeps, of all that lies before, the best scores of as many boundaries as the longest piece has characters: no piece
reaches further back. Every ``CHUNK`` characters the boundaries from which a piece goes on beyond are the
ends of the paths that can still win; these are followed back until they meet in one boundary, and the ids up to it are final and leave the window.

Texts are searched side by side, one in each of up to ``LANES`` lanes of numpy arrays: a step takes one
character of every lane, a lane whose text ends takes the next text. Pieces are found for a chunk of all lanes at once by
walking a prefix tree, whose edges stand in one hash table. A lane whose paths do not meet within ``PENDING`` characters
(a long run of one character), and the last ``FEW`` lanes, go on from their last final boundary in ``stream``, the same search for one text.

Scores are whole numbers, in units of 1 / ``UNIT`` nats, so sums are exact and do not depend on where
a search began: the ids are the same whatever the chunks and lanes.
Of segmentations with equal scores the one whose last piece is longest wins, and so on
backwards from every boundary.

The vocabulary file is a parameter. Scores of a unigram vocabulary are taken as
they are. A merge vocabulary holds ranks in their place (0, -1, -2, ...), whose
sum is no likelihood; its scores are Zipf log-probabilities of the ranks,
``-log(rank + ZIPF)``, which favour long frequent pieces as merging does. Text
maps to pieces by a leading word marker and one for every space, nothing else is
normalised. A character outside the vocabulary costs 10 more than the worst
score and becomes its UTF-8 bytes, so decoding restores every text exactly.

Defined cases: a null text gives null ids and decodes to null; an empty text
gives no ids; other columns are kept, one that has the new column's name is replaced; rows are
independent of each other, so repeated rows get equal ids; a very long text needs memory for itself
and its ids, the search only for what is not final yet; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stands for a word marker of the text itself; no text that is valid UTF-8 holds it.
OWN_MARK = "\ud800"
#: Characters of the texts that are searched side by side, and of a chunk; lanes; see the module's text.
GROUP, CHUNK, LANES, PENDING, FEW = 1 << 23, 32, 512, 1024, 40
#: Bytes that a row counts for in a group beside its text.
ROW = 32
#: Characters whose ids are gathered at once.
BLOCK = 1 << 18
ZIPF, UNIT = 200, 1_000_000


_LOW = -(1 << 62)


class Pieces:
    """A vocabulary and the search over it."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        told = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [told.id_to_piece(i) for i in range(told.get_piece_size())]
        self.bytes = {told.piece_to_id(f"<0x{b:02X}>"): b for b in range(256) if told.is_byte(told.piece_to_id(f"<0x{b:02X}>"))}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        normal = [i for i in range(len(self.pieces)) if not (told.is_byte(i) or told.is_control(i) or told.is_unknown(i) or told.is_unused(i))]
        scores = [told.get_score(i) for i in normal]
        if all(x <= 0 and x == int(x) for x in scores):
            scores = [-math.log(ZIPF - x) for x in scores]
        self.ids = {self.pieces[i]: (round(x * UNIT), i) for i, x in zip(normal, scores, strict=True)}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((s for s, _ in self.ids.values()), default=0) - 10 * UNIT
        self.root: dict[str, tuple] = {}  # prefix tree: character -> (children, score, id), id -1 where no piece ends
        for piece, (score, i) in self.ids.items():
            node = self.root
            for char in piece[:-1]:
                node = node.setdefault(char, ({}, 0, -1))[0]
            node[piece[-1]] = (node.get(piece[-1], ({},))[0], score, i)
        plain = {i: self.pieces[i].replace(MARK, " ").encode() for _, i in self.ids.values()}
        self.spelt = [bytes([self.bytes[i]]) if i in self.bytes else plain.get(i, b"") for i in range(len(self.pieces))]
        self.met = 0  # how often paths met and ids became final before their text ended
        self._number()

    def _number(self) -> None:
        """The prefix tree as arrays: its edges (node, class of character) in a hash table, and of each node the score and id of its piece."""
        classes = {c: k for k, c in enumerate(sorted({c for p in self.ids for c in p}), 1)}
        self.classes, self.class_of = len(classes) + 1, np.zeros(0x110000, dtype=np.int16 if len(classes) < 1 << 15 else np.int32)
        self.class_of[[ord(c) for c in classes]] = list(classes.values())
        edges: dict[int, int] = {}
        held: list[tuple[int, int]] = [(0, -1)]
        for piece, (score, i) in self.ids.items():
            node = 0
            for char in piece:
                node = edges.setdefault(node * self.classes + classes[char], len(held))
                if node == len(held):
                    held.append((0, -1))
            held[node] = (score, i)
        self.node_score, self.node_id = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
        bits = max(4, (4 * len(edges)).bit_length())
        slots = 1 << bits
        kind = np.int32 if len(held) * self.classes < 1 << 31 else np.int64  # a table that fits a cache
        self.shift = np.uint32(32 - bits) if kind is np.int32 else np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full(slots, -1, dtype=kind), np.zeros(slots, dtype=np.int32)
        keys = np.array(list(edges), dtype=kind)
        nodes, at = np.array(list(edges.values()), dtype=np.int32), self._slot(keys)
        while len(keys):  # of those that want a slot the first gets it, if it is free; the others try the next one
            free = np.flatnonzero(self.slot_key[at] < 0)
            wanted, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.slot_key[wanted], self.slot_node[wanted] = keys[taken], nodes[taken]
            left = np.ones(len(keys), dtype=bool)
            left[taken] = False
            keys, nodes, at = keys[left], nodes[left], (at[left] + 1) % slots
        every = np.arange(self.classes)
        self.first = self._children(np.zeros(self.classes, dtype=np.int32), every)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        if keys.dtype == np.int32:
            return ((keys.view(np.uint32) * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _children(self, nodes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The nodes that ``classes`` lead to, -1 where there is none."""
        keys = nodes.astype(self.slot_key.dtype, copy=False) * self.slot_key.dtype.type(self.classes) + classes.astype(self.slot_key.dtype, copy=False)
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_node[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slot_key)
            found = self.slot_key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_node[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _extend(self, window: str, best: list[int], back: list[int], which: list[int], at: int, stop: int) -> None:
        """Extend the starts ``at`` to ``stop`` of the window by every piece that begins there."""
        root, unknown, longest = self.root, self.unknown, self.longest
        for start in range(at, stop):
            so_far, node, end, single = best[start], root, start, False
            for char in window[start : start + longest]:
                found = node.get(char)
                if found is None:
                    break
                node, score, i = found
                end += 1
                if i >= 0:
                    score += so_far
                    if score > best[end]:
                        best[end], back[end], which[end] = score, start, i
                    if end == start + 1:
                        single = True
            if not single and so_far + unknown > best[start + 1]:
                best[start + 1], back[start + 1], which[start + 1] = so_far + unknown, start, -1

    def stream(self, chunks: Iterable[str], spelt: bool = True) -> Iterator[int]:
        """Ids of a text given in chunks, each as soon as it is certain; unless ``spelt``, a character c of no piece is -1 - c."""
        longest, coming = self.longest, iter(chunks)
        window, at = "", 0  # what is retained, and how far starts in it are extended
        best, back, which = [0], [-1], [-1]  # at each position of the window: score, start of the last piece, its id
        chunk = next(coming, None)
        while chunk is not None:
            n, window, chunk = len(chunk), window + chunk, next(coming, None)
            best += [_LOW] * n
            back += [-1] * n
            which += [-1] * n
            if chunk is None:
                self._extend(window, best, back, which, at, len(window))
                yield from self._path(window, back, which, len(window), spelt)
                return
            # a start is extended when all characters a piece may need are there
            stop = max(at, len(window) - longest + 1)
            self._extend(window, best, back, which, at, stop)
            at = stop
            # paths that can still win end here, or beyond with a piece that starts before
            ends = {at, *(e for e in range(at + 1, min(at + longest, len(best))) if 0 <= back[e] < at)}
            while len(ends) > 1:
                last = max(ends)
                ends.discard(last)
                ends.add(back[last])
            meet = ends.pop()
            self.met += meet > 0
            yield from self._path(window, back, which, meet, spelt)
            window, best, at = window[meet:], best[meet:], at - meet
            back, which = [x - meet for x in back[meet:]], which[meet:]

    def _path(self, window: str, back: list[int], which: list[int], end: int, spelt: bool) -> list[int]:
        out: list[int] = []
        while end > 0:
            start = back[end]
            if which[end] >= 0:
                out.append(which[end])
            elif not spelt:
                out.append(-1 - ord(window[start]))
            else:
                out.extend(self.byte_ids[b] for b in reversed(window[start:end].replace(OWN_MARK, MARK).encode()))
            end = start
        return out[::-1]

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, one after the other, and where each text's begin (and the last one's end)."""
        order = np.argsort([-len(t) for t in texts], kind="stable")  # long ones first, so that lanes end together
        waiting = [int(k) for k in order if texts[k]]
        found = Found(texts)
        if waiting:
            Lanes(self, texts, waiting, found).run()
        return found.ids(self)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.search([text])[0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _marked(text: str) -> str:
    """A text as it is searched; made when it is needed, as the marker takes two bytes a character."""
    return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""


def _codes(marked: str) -> np.ndarray:
    return np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), dtype=np.int32)


class Found:
    """Pieces as they become final, each entered at the boundary of its text where it ends.

    For a character that is in no piece ``HERE`` stands at its own end; -1 - c for a character c stands anywhere.
    """

    NONE, HERE = -(1 << 31), 1 - (1 << 31)

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.base = np.cumsum([0, *(len(t) + 1 if t else 0 for t in texts)])  # the boundary before a text's first character is the one after the last text's
        self.which = np.full(int(self.base[-1]) + 1, self.NONE, dtype=np.int32)

    def enter(self, text: np.ndarray, end: np.ndarray, which: np.ndarray) -> None:
        self.which[self.base[text] + end] = which

    def ids(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and where each text's begin; a few texts at a time, as what is made on the way is several times the ids."""
        parts, bounds, first = [np.zeros(0, dtype=np.int32)], np.zeros(len(self.base), dtype=np.int64), 0
        while first < len(self.texts):
            stop = max(first + 1, int(np.searchsorted(self.base, self.base[first] + BLOCK, "right")) - 1)
            values, ends = self._part(pieces, first, stop)
            parts.append(values)
            bounds[first + 1 : stop + 1] = bounds[first] + ends
            first = stop
        return np.concatenate(parts), bounds

    def _part(self, pieces: Pieces, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts from ``first`` to ``stop``, and where each text's end."""
        base = self.base[first : stop + 1] - self.base[first]
        held = self.which[self.base[first] + 1 : self.base[stop] + 1]
        at = np.flatnonzero(held != self.NONE)
        which, ends = held[at], np.searchsorted(at, base[1:])
        here = np.flatnonzero(which == self.HERE)
        cuts = np.searchsorted(at[here], base)
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            own = here[cuts[k] : cuts[k + 1]]
            which[own] = -1 - _codes(_marked(self.texts[first + k]))[at[own] - base[k]]
        odd = np.flatnonzero(which < 0)
        if not len(odd):
            return which, ends
        many = np.ones(len(which), dtype=np.int64)
        codes, of = np.unique(-1 - which[odd], return_inverse=True)
        spelt = [[pieces.byte_ids[b] for b in chr(c).replace(OWN_MARK, MARK).encode()] for c in codes.tolist()]
        many[odd] = np.array([len(x) for x in spelt], dtype=np.int64)[of]
        out = np.repeat(which, many)
        out[np.repeat(which < 0, many)] = np.concatenate([np.array(spelt[k], dtype=np.int32) for k in of.tolist()])
        return out, np.concatenate([[0], np.cumsum(many)])[ends]


class Lanes:
    """The search over many texts at once; column k of every array is lane k.

    Scores are kept times ``scale``; the rest below is the length of the last piece less 1, so of equal scores the longer piece is the greater.
    """

    NONE = -(1 << 60)

    def __init__(self, pieces: Pieces, texts: list[str], waiting: list[int], found: Found) -> None:
        self.pieces, self.texts, self.waiting, self.found = pieces, texts, waiting[::-1], found
        self.reach = pieces.longest
        self.scale = 1 << max(1, (self.reach - 1).bit_length())
        self.size = {k: len(texts[k]) + 1 for k in waiting}
        starts = np.cumsum([0, *(self.size[k] + 1 for k in waiting)]).tolist()  # class 0, which is in no piece, ends each text
        self.begin = dict(zip(waiting, starts, strict=False))
        # of the texts the classes of their characters are held and nothing else
        self.kinds = np.zeros(starts[-1] + CHUNK + self.reach, dtype=self.pieces.class_of.dtype)
        for k, start in self.begin.items():
            codes = _codes(_marked(texts[k]))
            self.kinds[start : start + len(codes)] = np.where(codes == 0, 0, self.pieces.class_of[codes])
        n = min(LANES, len(waiting))
        self.clock = self.base = 0  # boundaries passed, and the one before the first kept row
        self.text, self.at, self.end, self.done, self.first = (np.zeros(n, dtype=np.int64) for _ in range(5))
        self.best = np.full((self.reach + CHUNK, n), self.NONE, dtype=np.int64)
        self.score = np.full((CHUNK + self.reach + 1, self.reach, n), self.NONE, dtype=np.int64)
        self.which = np.zeros(self.score.shape, dtype=np.int32)
        self.back, self.last = np.zeros((0, n), dtype=np.int64), np.zeros((0, n), dtype=np.int32)
        self.lane: np.ndarray | None = None
        self._fill(np.arange(n))

    def _fill(self, lanes: np.ndarray) -> None:
        """Begin the next texts in ``lanes``."""
        reach = self.reach
        for lane in lanes.tolist():
            text = self.waiting.pop()
            self.text[lane], self.at[lane] = text, self.begin[text]
            self.end[lane] = self.clock + self.size[text]
        self.done[lanes] = self.first[lanes] = self.clock
        self.best[:, lanes] = self.NONE
        self.best[reach - 1, lanes] = 0
        self.score[: reach + 1, :, lanes] = self.NONE

    def _keep(self, lanes: np.ndarray) -> None:
        for name in ("text", "at", "end", "done", "first", "best", "score", "which", "back", "last"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., lanes]))

    def run(self) -> None:
        while len(self.text):
            live = self._match()
            self._step()
            self._settle(live)
            over = self.end <= self.clock
            aside = ~over & (self.clock - self.done > PENDING)
            if not self.waiting and np.count_nonzero(~over) <= FEW:
                aside = ~over
            for lane in np.flatnonzero(aside).tolist():
                self._aside(lane)
            over |= aside
            refilled = np.flatnonzero(over)[: len(self.waiting)]
            self._fill(refilled)
            over[refilled] = False
            if over.any():
                self._keep(np.flatnonzero(~over))

    def _match(self) -> np.ndarray:
        """Enter the pieces that begin in the next chunk by their ends; which boundaries a piece leaves that ends beyond it."""
        pieces, reach, n = self.pieces, self.reach, len(self.text)
        if self.lane is None or len(self.lane) != CHUNK * n:
            row, self.lane = (x.ravel().astype(np.int32) for x in np.indices((CHUNK, n)))
            # where a piece of one character that begins at a place is entered; a longer one is a row lower and a column to the left for each more
            self.row, self.slot = row, ((row + 1) * reach + (reach - 1)) * n + self.lane
        place = (self.at + np.arange(CHUNK)[:, None]).ravel()
        live = np.zeros((CHUNK + 1, n), dtype=bool)
        live[CHUNK] = True
        score, which = self.score.reshape(-1), self.which.reshape(-1)
        node = pieces.first[self.kinds[place]]
        going = np.flatnonzero(node >= 0)
        single = np.zeros(CHUNK * n, dtype=bool)
        single[going] = pieces.node_id[node[going]] >= 0
        odd = np.flatnonzero(~single)
        score[self.slot[odd]], which[self.slot[odd]] = pieces.unknown * self.scale, Found.HERE
        node, size = node[going], 1
        while True:
            whole = np.flatnonzero(pieces.node_id[node] >= 0)
            hit, at = going[whole], node[whole]
            slot = self.slot[hit] + (size - 1) * (reach - 1) * n
            score[slot], which[slot] = pieces.node_score[at] * self.scale + (size - 1), pieces.node_id[at]
            if size > 1:
                beyond = hit[self.row[hit] + size > CHUNK]
                live.reshape(-1)[beyond] = True
            size += 1
            if size > reach or not len(going):
                return live
            node = pieces._children(node, self.kinds[place[going] + (size - 1)])
            alive = np.flatnonzero(node >= 0)
            going, node = going[alive], node[alive]

    def _step(self) -> None:
        """Go through the chunk: the best way to every boundary."""
        reach, n = self.reach, len(self.text)
        sums, top, length = np.empty((reach, n), dtype=np.int64), np.empty(n, dtype=np.int64), np.empty((CHUNK, n), dtype=np.int64)
        for k in range(CHUNK):
            np.add(self.best[k : k + reach], self.score[k + 1], out=sums)
            np.maximum.reduce(sums, axis=0, out=top)
            np.bitwise_and(top, self.scale - 1, out=length[k])
            np.subtract(top, length[k], out=self.best[k + reach])
        last = np.take_along_axis(self.which[1 : CHUNK + 1], (reach - 1 - length)[:, None], axis=1)[:, 0]
        self.back, self.last = np.concatenate([self.back, length + 1]), np.concatenate([self.last, last])
        self.best[:reach] = self.best[CHUNK:].copy()
        self.score[1 : reach + 1] = self.score[CHUNK + 1 :].copy()
        self.which[1 : reach + 1] = self.which[CHUNK + 1 :].copy()
        self.score[reach + 1 :] = self.NONE
        self.at += CHUNK
        self.clock += CHUNK

    def _settle(self, live: np.ndarray) -> None:
        """Follow the paths that can still win back to where they meet; what lies before is final."""
        n, first = len(self.text), self.clock - CHUNK
        rows = np.arange(max(0, CHUNK - self.reach + 1), CHUNK + 1)
        ends = np.where(live[rows], first + rows[:, None], self.clock)
        over = self.end <= self.clock
        ends[:, over] = self.end[over]
        ends = np.maximum(ends, self.done)
        open_ = np.flatnonzero(ends.max(axis=0) > ends.min(axis=0))
        while len(open_):
            part = ends[:, open_]
            top = part.max(axis=0)
            start = top - self.back[top - self.base - 1, open_]
            part = np.where(part == top, start, part)
            ends[:, open_] = part
            open_ = open_[part.max(axis=0) > part.min(axis=0)]
        meet = ends[0]
        lanes = np.flatnonzero(meet > self.done)
        self.pieces.met += int(np.count_nonzero(~over[lanes]))
        at = meet[lanes]
        while len(lanes):
            row = at - self.base - 1
            self.found.enter(self.text[lanes], at - self.first[lanes], self.last[row, lanes])
            at = at - self.back[row, lanes]
            more = at > self.done[lanes]
            lanes, at = lanes[more], at[more]
        self.done = np.maximum(self.done, meet)
        waste = int(self.done.min(initial=self.clock)) - self.base if n else 0
        self.back, self.last, self.base = self.back[waste:], self.last[waste:], self.base + waste

    def _aside(self, lane: int) -> None:
        """Search what is not final of one lane's text by itself."""
        text, gone = int(self.text[lane]), int(self.done[lane] - self.first[lane])
        rest = _marked(self.texts[text])[gone:]
        chunks = (rest[k : k + CHUNK] for k in range(0, len(rest), CHUNK))
        ids = np.fromiter(self.pieces.stream(chunks, spelt=False), dtype=np.int32)
        # in order is enough: no more pieces than characters
        self.found.enter(np.full(len(ids), text), gone + 1 + np.arange(len(ids)), ids)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", ids: str = "ids", restored: str = "", keep_text: bool = True, group: int = GROUP) -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>) of the piece ids of ``text``.

    With ``restored``, a boolean column of that name says whether decoding the ids gives the text back.
    Without ``keep_text`` the texts are not sent back by the tasks, and their column is left out.
    ``group`` is how many bytes of texts are searched together: the ids are the same for any, fewer take less memory and more time.
    """
    new = [ids, *([restored] if restored else [])]
    docs = docs.drop(*new)
    model, names = _model(vocabulary), docs.columns  # half a megabyte, travels with the plan
    at = names.index(text)
    held = [k for k in range(len(names)) if keep_text or k != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for part in _groups(batches, at, group):
            texts = part.column(at).to_pylist()
            values, bounds = pieces.search([t or "" for t in texts])
            missing = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()), mask=missing)
            columns = [*(part.column(k) for k in held), lists]
            if restored:
                columns.append(pa.array([t is None or pieces.decode(values[a:b].tolist()) == t for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*(names[k] for k in held), *new])

    out = _with(docs if keep_text else docs.drop(text), ids, "array<int>")
    return docs.mapInArrow(run, out.add(restored, "boolean") if restored else out)


def _groups(batches: Iterable[pa.RecordBatch], column: int, group: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, however many they come in, by groups whose texts have about ``group`` bytes together; a longer text is one by itself."""
    group = group or GROUP
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        sizes, first = np.cumsum([0, *(ROW + (len(t.as_buffer()) if t.is_valid else 0) for t in batch.column(column))]), 0
        while first < batch.num_rows:
            stop = max(first + (not held), int(np.searchsorted(sizes, sizes[first] + group - total, "right")) - 1)
            if stop > first:
                held.append(batch.slice(first, stop - first))
                total += int(sizes[stop] - sizes[first])
            first = max(first, stop)
            if first < batch.num_rows:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with a column ``text`` (string) restored from ``ids``."""
    rows = rows.drop(text)
    model, names = _model(vocabulary), rows.columns
    at = names.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], names=[*names, text])

    return rows.mapInArrow(run, _with(rows, text, "string"))


def _with(df: DataFrame, name: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind), True)])
