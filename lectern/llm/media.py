"""MPEG audio columns: headers, tags, variable-bitrate tables, checksums, durations, seek offsets.

``parse`` reads a stream as found: it skips an ID3v2 tag, finds frames by their
sync word confirmed by the next header, steps over junk between them and
resynchronises, reads a Xing, Info or VBRI table (frames, bytes, seek places, an encoder's delay and padding) and an
ID3v1 tag, verifies the CRC-16 of protected frames of Layers I and III (of Layer II it covers bits whose number
depends on the allocation, and is not verified), and gives exact durations (samples over rate, delay and padding
included) and the byte offset of every ``SEEK_STEP``-th frame.

``compose`` builds a stream from bytes: Layer III frames whose main data is
empty (their side information is zero) and whose ancillary data, the rest of each frame, is the payload.
The frame unit is the byte. All frames but the last have the largest bitrate, the
last the smallest that fits, so the stream is of variable bitrate and has a Xing table;
the payload's length stands in an ID3v2 text frame. ``payload`` reads the bytes back.

Defined cases: null or empty bytes have no frames; a truncated last frame is
counted apart and not played; streams without any frame give zero durations;
equal bytes give equal columns; other columns are kept, one of the new column's name is replaced, and
``document_digests`` takes doc_id and text alone; an empty table gives no rows; a very long text is held with its stream in one row.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


SEEK_STEP = 64
# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1, layer) or (MPEG-2, layer), and sampling rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {1: 384, 2: 1152, 3: 1152}
#: Mono Layer III with CRC at 32 kHz: header, checksum and side information before the payload's bytes.
_HEAD, _CRC, _SIDE, _RATE = 4, 2, 17, 32000


def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return tuple(out)


_TABLE = _crc_table()


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    return c


def header(b: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """(frame length, samples, rate, layer, protected, side bytes) of 4 bytes; None if they are no header."""
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or b[3] & 3 == 2:
        return None
    kbps, hz = BITRATES[1 if version == 3 else 2, layer][bits], RATES[version][rate]
    samples = 576 if layer == 3 and version != 3 else SAMPLES[layer]
    pad = b[2] >> 1 & 1
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mono = b[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return size, samples, hz, layer, not b[1] & 1, side


def _frame(bits: int, body: bytes) -> bytes:
    """One frame of bitrate index ``bits`` whose bytes after the side information are ``body``, padded with zeros."""
    known = _HEADS.get(bits)
    if known is None:
        head = bytes((0xFF, 0xFA, bits << 4 | 2 << 2, 0xC0))
        check = crc16(head[2:] + bytes(_SIDE))
        known = _HEADS[bits] = (head + check.to_bytes(2, "big") + bytes(_SIDE), header(head)[0])
    start, size = known
    return start + body + bytes(size - len(start) - len(body))


_HEADS: dict[int, tuple[bytes, int]] = {}
_ROOM = tuple(0 if not k else 144000 * k // _RATE - _HEAD - _CRC - _SIDE for k in BITRATES[1, 3])


def compose(data: bytes) -> bytes:
    """An MPEG-1 Layer III stream that carries ``data``."""
    frames = [_frame(14, data[i : i + _ROOM[14]]) for i in range(0, len(data) // _ROOM[14] * _ROOM[14], _ROOM[14])]
    if rest := data[len(frames) * _ROOM[14] :]:
        frames.append(_frame(next(k for k in range(1, 15) if _ROOM[k] >= len(rest)), rest))
    total = sum(map(len, frames))
    info_size = len(_frame(5, b""))
    whole, at, marks = total + info_size, info_size, []
    for f in frames:
        marks.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * marks[len(marks) * i // 100] // whole) if marks else 0 for i in range(100))
    info = _frame(5, b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + whole.to_bytes(4, "big") + toc)
    text = b"\x00payload\x00" + str(len(data)).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    size = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + size + tag + info + b"".join(frames)


def _id3(data: bytes) -> tuple[int, dict[str, str]]:
    """(bytes to skip, text frames) of a leading ID3v2 tag."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 128 for x in data[6:10]):
        return 0, {}
    size = 10 + sum(x << s for x, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    found, at, end = {}, 10, min(size, len(data))
    while at + 10 <= end and data[at] and data[3] in (3, 4):
        raw = data[at + 4 : at + 8]
        n = int.from_bytes(raw, "big") if data[3] == 3 else sum(x << s for x, s in zip(raw, (21, 14, 7, 0), strict=True))
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(at + 10 + n, end)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 3: "utf-8"}.get(body[0], "utf-16"), "replace")
            key, _, value = text.partition("\x00")
            found[f"TXXX:{key}" if name == "TXXX" else name] = value if name == "TXXX" else key
        at += 10 + n
    return size + (10 if data[5] & 16 else 0), found


def frames(data: bytes, at: int = 0) -> Iterator[tuple[int, tuple]]:
    """(offset, header) of the frames of ``data`` from ``at``; a truncated last frame is given too.

    A sync word counts where the frame's end meets another header of that kind, a tag, or the end of data.
    """
    end, sure = len(data), False
    while True:
        h = header(data[at : at + 4])
        if h and not sure:
            after = at + h[0]
            then = header(data[after : after + 4])
            sure = after >= end or data[after : after + 3] == b"TAG" or bool(then and then[2:4] == h[2:4])
        if h and sure:
            yield at, h
            at += h[0]
        else:
            sure = False
            at = data.find(b"\xff", at + 1)
            if at < 0:
                return
        if at >= end:
            return


def _is_table(data: bytes, at: int, h: tuple) -> int:
    """Offset of a Xing, Info or VBRI table in the frame, else -1."""
    for skip in (_HEAD + h[5], _HEAD + _CRC + h[5]):
        if data[at + skip : at + skip + 4] in (b"Xing", b"Info"):
            return at + skip
    return at + _HEAD + 32 if data[at + _HEAD + 32 : at + _HEAD + 36] == b"VBRI" else -1


def _read_table(data: bytes, frame: int, t: int, out: dict) -> None:
    """What the table at ``t`` of the frame at ``frame`` tells, into ``out``; fields that are cut off are left out."""
    number = lambda a, n: int.from_bytes(data[a : a + n], "big")
    if data[t : t + 4] == b"VBRI":
        out["table_bytes"], out["table_frames"] = number(t + 10, 4), number(t + 14, 4)
        entries, scale, width = number(t + 18, 2), number(t + 20, 2), number(t + 22, 2)
        steps = [number(t + 26 + k * width, width) * scale for k in range(entries)] if 0 < width <= 4 and t + 26 + entries * width <= len(data) else []
        out["table_seek"] = [frame + s for s in itertools.accumulate(steps)]
        return
    flags, t = number(t + 4, 4), t + 8
    for bit, key in ((1, "table_frames"), (2, "table_bytes")):
        if flags & bit:
            out[key] = number(t, 4)
            t += 4
    if flags & 4:
        # a hundred places in 256ths of the stream
        if out["table_bytes"] and t + 100 <= len(data):
            out["table_seek"] = [frame + x * out["table_bytes"] // 256 for x in data[t : t + 100]]
        t += 100
    t += 4 if flags & 8 else 0
    if data[t : t + 4] in (b"LAME", b"Lavf", b"Lavc") and t + 24 <= len(data):
        both = number(t + 21, 3)
        out["delay"], out["padding"] = both >> 12, both & 0xFFF


def _protected(head: bytes, layer: int, side: int) -> int | None:
    """Bytes after the checksum that it covers; None for Layer II, where they depend on the bit allocation."""
    if layer == 3:
        return side
    mode, bound = head[3] >> 6, (head[3] >> 4 & 3) * 4 + 4
    return None if layer == 2 else 16 if mode == 3 else (32 + bound) // 2 if mode == 1 else 32


def parse(data: bytes | None) -> dict:
    """Columns of one stream; see ``FIELDS``."""
    out = dict(frames=0, samples=0, rate=0, layer=0, duration=0.0, crc_checked=0, crc_failed=0, truncated=0, junk_bytes=0, table_frames=None, table_bytes=None, table_seek=[], delay=None, padding=None, tags={}, seek=[])
    if not data:
        return out
    at, out["tags"] = _id3(data)
    end = len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        out["tags"] = {"TITLE": data[-125:-95].rstrip(b"\x00 ").decode("latin-1")} | out["tags"]
    expected, played = at, data[:end]
    for offset, h in frames(played, at):
        size, samples, hz, layer, protected, side = h
        out["junk_bytes"] += offset - expected
        expected = min(offset + size, end)
        if offset + size > end:
            out["truncated"] += 1
            continue
        covered = _protected(played[offset : offset + 4], layer, side) if protected else None
        if covered is not None:
            body = played[offset + 2 : offset + 4] + played[offset + 6 : offset + 6 + covered]
            out["crc_checked"] += 1
            out["crc_failed"] += crc16(body) != int.from_bytes(played[offset + 4 : offset + 6], "big")
        if not out["frames"] and out["table_frames"] is None and (t := _is_table(played, offset, h)) >= 0:
            _read_table(played, offset, t, out)
            out["table_frames"] = out["table_frames"] or 0
            continue
        if out["frames"] % SEEK_STEP == 0:
            out["seek"].append(offset)
        out["frames"] += 1
        out["samples"] += samples
        out["rate"], out["layer"] = out["rate"] or hz, out["layer"] or layer
    out["junk_bytes"] += end - expected
    out["duration"] = out["samples"] / out["rate"] if out["rate"] else 0.0
    return out


def payload(data: bytes) -> bytes:
    """The bytes that ``compose`` stored in ``data``, from the frames' ancillary data."""
    at, tags = _id3(data)
    parts = []
    for k, (offset, h) in enumerate(frames(data, at)):
        if k or _is_table(data, offset, h) < 0:
            parts.append(data[offset + _HEAD + _CRC + h[5] : offset + h[0]])
    return b"".join(parts)[: int(tags["TXXX:payload"])]


#: What ``parse`` tells, by Arrow type; Spark's follow from them.
FIELDS = [
    pa.field("frames", pa.int64()), pa.field("samples", pa.int64()), pa.field("rate", pa.int32()), pa.field("layer", pa.int32()), pa.field("duration", pa.float64()), pa.field("crc_checked", pa.int64()), pa.field("crc_failed", pa.int64()),
    pa.field("truncated", pa.int32()), pa.field("junk_bytes", pa.int64()), pa.field("table_frames", pa.int64()), pa.field("table_bytes", pa.int64()), pa.field("table_seek", pa.list_(pa.int64())), pa.field("delay", pa.int32()), pa.field("padding", pa.int32()), pa.field("tags", pa.map_(pa.string(), pa.string())), pa.field("seek", pa.list_(pa.int64())),
]


def parse_column(df: DataFrame, content: str = "content", into: str = "audio") -> DataFrame:
    """``df`` with a struct column ``into`` parsed from the binary column ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse(x) for x in batch.column(at).to_pylist()]
            for r in rows:
                r["tags"] = list(r["tags"].items())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.struct(FIELDS))], names=[*names, into])

    df = df.drop(into)
    names, at = df.columns, df.columns.index(content)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.StructType([T.StructField(f.name, from_arrow_type(f.type)) for f in FIELDS]))]))


def compose_column(df: DataFrame, data: str = "data", into: str = "content") -> DataFrame:
    """``df`` with a binary column ``into``: the stream that carries the binary column ``data`` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compose(x or b"") for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, into])

    df = df.drop(into)
    names, at = df.columns, df.columns.index(data)
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType())]))


def document_digests(docs: DataFrame, unit: int = 192) -> DataFrame:
    """Every text as UTF-8, padded with spaces to a positive multiple of ``unit``, stored as a stream and read back."""
    raw = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols: list[list] = [[] for _ in range(7)]
            for x in batch.column(1).to_pylist():
                stored = compose(x + b" " * (-len(x) % unit if x else unit))
                back, told = payload(stored), parse(stored)
                seek = hashlib.sha256(",".join(map(str, told["seek"])).encode()).hexdigest()[:16]
                feature = f"layer{told['layer']};rate={told['rate']};frames={told['frames']};samples={told['samples']};table={told['table_frames']}/{told['table_bytes']};crc={told['crc_checked']}/{told['crc_failed']};junk={told['junk_bytes']};seek={len(told['seek'])}:{seek}"
                for c, v in zip(cols, (len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return raw.select(F.col("doc_id").cast("bigint").alias("doc_id"), "raw").mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
