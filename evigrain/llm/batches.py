"""Texts in groups of bounded size, within the batches that Arrow hands over."""

from __future__ import annotations

from collections.abc import Iterator

#: Texts that are worked on together: so many bytes, or a single longer text.
GROUP_BYTES = 4 << 20


def groups(texts: list[bytes], most: int = GROUP_BYTES) -> Iterator[slice]:
    """Runs of texts of about `most` bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if texts:
        yield slice(start, len(texts))
