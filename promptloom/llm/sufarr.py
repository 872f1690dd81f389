"""Substring deduplication on suffixes sorted block by block with a difference cover.

Bytes of a text go if a string of ``WINDOW`` bytes over them also starts elsewhere. The
stages before (``runs``) leave the contexts of possible repeats, dealt to groups by
prefixes. In a group:

1. Cover. D = ``COVER`` is a difference cover modulo ``PERIOD``: each difference of two
   numbers modulo PERIOD is one of two members of D. So of any two positions i, j
   there is a shift under PERIOD that takes both to sample positions, those whose place
   modulo PERIOD is in D.
2. Ranks of the sample. Sample suffixes are ranked by their first PERIOD bytes, then by
   twice as many: PERIOD bytes further lies a sample position again. Ranks stop at the
   last power that a window holds.
3. Blocks. The suffixes that can begin a repeat are taken one bucket (range of first
   bytes) at a time, so that a block's arrays bound the memory. A block is sorted by the
   first PERIOD bytes of its suffixes and the last of their windows; ties are resolved
   by the ranks at the shifts of D: two windows are equal if and only if they tie and
   have equal ranks at the shift that fits both, from where the ranks cover the rest of
   the window. No text is compared beyond PERIOD bytes, however long the tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm import runs as rn
from promptloom.llm.common import stash
from promptloom.llm.packing import packed_texts

WINDOW, GRAM = 400, 200
#: The differences of the cover's members give every number modulo the period.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Text per group of runs, and of contexts; suffixes that are sorted at once.
GROUP, CONTEXTS, BLOCK = 12 << 20, 4 << 20, 500_000
#: Contexts of one prefix that are sorted together.
CROWD = 2048
U = np.uint64


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data.astype(U) + U(1), offsets


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.arange(len(data))
    return place, place + 1, offsets


def byte_units(window: int = WINDOW, gram: int = GRAM) -> rn.Units:
    longer = sorted({gram + (window - gram) // 2, window - (window - gram) // 4, window - (window - gram) // 8} - {gram})
    return rn.Units(_bytes, _bounds, window, gram, tuple(longer), batch=2 << 20, every=True)


def in_cover(place: np.ndarray) -> np.ndarray:
    table = np.zeros(PERIOD, bool)
    table[list(COVER)] = True
    return table[place % PERIOD]


def dense(*columns: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows of numbers, equal for equal rows, in their order."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def first_bytes(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The PERIOD bytes from each place, as two numbers."""
    eight, rest = np.zeros(len(at), U), np.zeros(len(at), U)
    for k in range(8):
        eight = (eight << U(8)) | text[at + k]
    for k in range(8, PERIOD):
        rest = (rest << U(8)) | text[at + k]
    return eight, rest


def cover_ranks(text: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """(rank at each place, for sample positions, by the bytes from there; how many bytes).
    ``text`` ends with two windows of zeros."""
    sample = np.flatnonzero(in_cover(np.arange(len(text) - window)))
    rank, depth = np.zeros(len(text), np.int64), PERIOD
    rank[sample] = dense(*first_bytes(text, sample)) + 1
    while 2 * depth + PERIOD <= window:
        rank[sample] = dense(rank[sample], rank[sample + depth]) + 1
        depth *= 2
    return rank, depth


def equal_windows(text: np.ndarray, starts: np.ndarray, rank: np.ndarray, depth: int, window: int) -> np.ndarray:
    """A number for each of these suffixes, the same where their first ``window`` bytes are."""
    tie = dense(*first_bytes(text, starts), *first_bytes(text, starts + window - PERIOD))
    found = np.arange(len(starts))
    for shift in range(PERIOD):
        own = np.flatnonzero(in_cover(starts + shift))
        at = starts[own] + shift
        keys, place = [tie[own], rank[at]], shift
        while place + depth < window - PERIOD:  # further on, a multiple of PERIOD each time, until the last bytes
            place += min(depth, (window - depth - place) // PERIOD * PERIOD)
            keys.append(rank[starts[own] + place])
        group = dense(*keys)
        least = np.full(int(group.max(initial=-1)) + 1, len(starts))
        np.minimum.at(least, group, own)
        found[own] = np.minimum(found[own], least[group])
    return found


def repeated_windows(heads: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(id, start) of the windows of a group's contexts that occur elsewhere among them."""
    text = np.append(data, np.zeros(2 * window, np.uint8))
    rank, depth = cover_ranks(text, window)
    count = heads[:, 4]
    own = np.repeat(np.arange(len(heads)), count)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    starts, doc, at = offsets[:-1][own] + inner, heads[own, 1], heads[own, 2] + inner
    first = first_bytes(text, starts)[0]
    order = np.argsort(first, kind="stable")
    edge = np.flatnonzero(np.append(True, first[order][1:] != first[order][:-1]))
    out = []
    for lo, hi in blocks(edge, len(order), block):
        part = order[lo:hi]
        number = equal_windows(text, starts[part], rank, depth, window)
        by = np.lexsort((at[part], doc[part], number))
        n, d, s = number[by], doc[part][by], at[part][by]
        head = np.maximum.accumulate(np.where(np.append(True, n[1:] != n[:-1]), np.arange(len(n)), 0))
        other = (d != d[head]) | (s != s[head])
        hit = np.bincount(n, weights=other, minlength=len(n))[n] > 0
        out.append((d[hit], s[hit]))
    return np.concatenate([d for d, _ in out]), np.concatenate([s for _, s in out])


def blocks(edge: np.ndarray, total: int, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole buckets with about ``block`` suffixes; a larger bucket is one range."""
    ends, lo = np.append(edge[1:], total), 0
    while lo < total:
        at = int(np.searchsorted(ends, lo + block, "right"))
        hi = int(ends[at - 1]) if at and ends[at - 1] > lo else int(ends[at])
        yield lo, hi
        lo = hi


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, groups: int | None = None, **tuning: int) -> DataFrame:
    """id, lo, hi: bytes covered by repeated windows; spans may overlap. ``docs`` has id, text."""
    units, limit = byte_units(window, gram), tuning.pop("limit", CROWD)
    units = replace(units, batch=tuning.pop("batch", units.batch))
    settled = rn.repeated_runs(docs, units, groups or rn.group_count(docs, GROUP), **tuning)
    found = stash(rn.contexts(docs, settled, units), "contexts")
    together, alone = rn.dealt(found, units, limit)

    def sort_group(table: pa.Table) -> pa.Table:
        doc, at = repeated_windows(*rn.unpack_group(table), window)
        return rn.spans(doc, at, at + window)

    sent = rn.packed_groups(together, groups or rn.body_groups(found, CONTEXTS))
    equal = sent.groupBy("group").applyInArrow(sort_group, "id long, lo long, hi long")
    known = settled.filter("key is null").select("id", "lo", "hi").union(equal)
    return known.union(rn.single_windows(alone, units)) if alone.limit(1).count() else known


def remove_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, groups: int | None = None, **tuning: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every row.
    ``tuning``: limit, batch, sample and crowd, as in ``runs``.

    A byte goes if a string of ``window`` bytes over it also starts anywhere else, in any
    document. Matches do not cross documents. An id stands for one document, so rows
    that repeat are treated alike and are not copies of one another; rows with null ids
    are documents of their own. Null texts are empty; an empty table gives an empty
    result. Other columns are not read.
    """
    numbered = docs.select("doc_id", rn.stand_in(F.col("doc_id"), F.col("text")).alias("id"), "text")
    cover = removed_spans(numbered, window, gram, groups, **tuning).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("cover"))
    joined = packed_texts(numbered).join(cover, "id", "left").select("id", "packed", "cover")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc, packed, pairs in zip(*[c.to_pylist() for c in batch.slice(at, 256).columns], strict=True):
                    text = unpack.decompress(packed)
                    kept, n_spans, here, removed = [], 0, 0, 0
                    for lo, hi in sorted((p["lo"], p["hi"]) for p in pairs or ()):
                        if lo > here or not n_spans:
                            n_spans += 1
                        kept.append(text[here:lo])
                        removed += max(0, hi - max(lo, here))
                        here = max(here, hi)
                    kept.append(text[here:])
                    rows.append((None if doc < -(2**60) else doc, len(text), removed, n_spans, b"".join(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(rewrite, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
