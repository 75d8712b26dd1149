"""Words of Arrow texts as arrays, for tasks that handle whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the texts that are handled at once, about.
SPAN = 1 << 20


def spans(text: pa.Array) -> Iterator[pa.Array]:
    """The texts, in order, as large strings without nulls, in pieces of about SPAN bytes; a text is never cut."""
    text = text.cast(pa.large_string()).fill_null("")
    if not len(text):
        return
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    low = 0
    while low < len(text):
        high = max(low + 1, int(np.searchsorted(at, at[low] + SPAN, "right")) - 1)
        yield text.slice(low, high - low)
        low = high


def word_edges(text: pa.Array, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of large strings, which of them are of words, where words begin and end (exclusive), and each text's number of words.

    Words are the longest runs of bytes that member marks; the end of a text ends its last word.
    """
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at, mask = at - at[0], member[data]
    step = np.zeros(len(mask) + 1, bool)
    step[:-1] = mask
    step[1:] ^= mask
    begins = step[:-1] & mask
    inner = at[(at > 0) & (at < len(mask))]
    begins[inner] = mask[inner]
    closes = np.zeros(len(mask) + 1, bool)
    closes[1:] = step[1:] & mask
    closes[inner] = mask[inner - 1]
    begins = np.flatnonzero(begins)
    return data, mask, begins, np.flatnonzero(closes), np.diff(np.searchsorted(begins, at))
