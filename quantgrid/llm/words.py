"""Delimited texts in bounded slices."""

from __future__ import annotations

from collections.abc import Iterator

SLICE_BYTES = 1 << 20


def slices(text: bytes, context: int, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(words of context, slice) of a text whose words are parted by spaces.

    Slices of about ``size`` bytes end at word ends; all but the first are led by up to ``context`` earlier words.
    """
    size = size or SLICE_BYTES
    at, lead = 0, b""
    while True:
        cut = len(text) if len(text) - at <= size else text.find(b" ", at + size)
        piece = lead + b" " + text[at:cut if cut >= 0 else len(text)]
        yield len(lead.split()), piece
        if cut < 0 or cut >= len(text):
            return
        at, lead = cut, b" ".join(piece.rsplit(None, context)[-context:])
