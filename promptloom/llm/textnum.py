"""Texts as numpy arrays: byte buffers of Arrow batches, words in them, and 64-bit hashes.

Hashes of byte and word strings are polynomials modulo 2**64 with an odd base, read
off prefix sums, so the hash of any substring costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 2**64))
#: Bytes of text that are worked on at once; a longer single text is worked on alone.
CHUNK = 1 << 20

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            row = np.full(max(n, 1 << 16), base, U)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finishing steps of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of values[k] * BASE**k for i <= k < j."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Scrambled hashes of values[start:stop]."""
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with about ``limit`` bytes of text each; null texts are empty.
    Row i's text is bytes[offsets[i]:offsets[i + 1]]."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, stop - at), data[ends[at] : ends[stop]], ends[at : stop + 1] - ends[at]
            at = stop


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


WHITE = byte_class(b" \t\n\x0b\x0c\r")


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first): byte spans of the words of all rows, and for each row the
    number of its first word (one more entry than rows)."""
    inside = ~separators[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edges[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | edges[1:])) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    return between(prefix_sums(data.astype(U) + U(1)), starts, stops)
