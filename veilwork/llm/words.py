"""Words of Arrow text columns as numpy arrays, and bit tables of bounded size.

A batch of texts is cut into words by looking its bytes up in a table of
separators; nothing is looped over in Python.  Null texts have no words.  Bytes
of 128 and above are never separators, so characters are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20  # texts that are handled at once; one longer text is a chunk of its own
MIXER = np.uint64(0x9E3779B97F4A7C15)


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true from the first to the last byte of every span."""
    table = np.zeros(256, bool)
    for first, last in spans:
        table[first : last + 1] = True
    return table


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NO_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))  # ASCII other than letters and digits


class Words(NamedTuple):
    text: pa.LargeStringArray  # the words of all rows, one after the other
    row: np.ndarray  # row of each word
    start: np.ndarray  # first byte of each word in ``data``
    end: np.ndarray
    data: np.ndarray  # the bytes of all rows
    offsets: np.ndarray  # first byte of every row, and the end


def words_of(texts: pa.Array, separators: np.ndarray) -> Words:
    """The words between separators of a column of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    seams = offsets[1:-1]
    seams = seams[(seams > 0) & (seams < len(data))]
    first[seams] = inside[seams]
    last[seams - 1] = inside[seams - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(data[inside].tobytes()))
    return Words(text, np.searchsorted(offsets[1:], start, side="right"), start, end, data, offsets)


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts have at most ``limit`` bytes, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of every string (polynomial over its bytes): the same in all tasks and runs."""
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    lengths = at[1:] - at[:-1]
    if not len(lengths) or at[-1] == at[0]:
        return mixed(lengths.astype(np.uint64))
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
    places = np.arange(len(data)) - np.repeat(at[:-1] - at[0], lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, MIXER, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[places], dtype=np.uint64)])
    at = at - at[0]
    return mixed(sums[at[1:]] - sums[at[:-1]] + lengths.astype(np.uint64))


# --- bit tables -------------------------------------------------------------------------------------------------


def bit_table(slots: DataFrame, bits: int) -> bytes:
    """A table of ``2**bits`` bits with those of the column ``slot`` set.

    The bits are gathered by Spark in rows of 4096 bytes, so the driver gets
    ``2**bits / 8`` bytes at most, however many slots there are.  A filled
    table lets more pass and loses nothing.
    """
    whole = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
    page, place = F.shiftright("slot", 15), F.col("slot").bitwiseAND(F.lit((1 << 15) - 1))
    for r in slots.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(place).alias("bits")).collect():
        whole[r["page"] * 4096 : r["page"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return whole.tobytes()


def slot_of(key: Column, bits: int, shift: int = 0) -> Column:
    """The slot of a 64-bit hash; ``shift`` tells tables of different groups apart."""
    return (F.shiftrightunsigned(key, 24) + F.lit(shift)).bitwiseAND(F.lit((1 << bits) - 1))


def among(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set in a table given as bytes."""
    slots = slots.astype(np.int64)
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
