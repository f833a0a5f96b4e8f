"""Words of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased, cut from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: What each byte becomes: letters and digits stay, A-Z go to a-z, bytes from 128 on stay, all else is a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a text given as UTF-8, in order, with repeats; none of a null text."""
    return text.translate(TABLE).split() if text else []


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of a binary column that hold about so many bytes together, one row at least."""
    size = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
    a = 0
    while a < len(size):
        b, held = a + 1, size[a]
        while b < len(size) and held + size[b] <= most:
            held += size[b]
            b += 1
        yield a, b
        a = b
