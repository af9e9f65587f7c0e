"""Words of whole texts as bytes: maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at once.
BLOCK = 1 << 20
#: Every byte as it stands in a word, a space for those that stand in none.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def word_blocks(text: bytes | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of about ``block`` bytes; null has none."""
    folded, at = (text or b"").translate(FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + block)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def as_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text of a column, one at a time."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py()
