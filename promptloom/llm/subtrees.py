"""Substring deduplication on prefix-partitioned suffix trees over words.

A repeat of ``WINDOW`` words is found where the suffix tree of the corpus is at least so
deep. The tree is never built as a whole:

* It is sparse: runs of windows that cannot repeat are left out beforehand, and equal runs
  are one (``runs``).
* It is partitioned by prefixes. Suffixes start at anchors, and go to groups by the words
  that follow there; a prefix that too many of them share is made longer, so that every
  group fits a task's memory. All windows that are equal have the same prefix.
* A group's subtree is built from its windows' words, compared word by word: the suffixes
  are sorted, and the lengths of the prefixes that neighbours share give its internal
  nodes. Of the leaves below a node of depth ``WINDOW`` or more the first (smallest doc_id,
  then start) stays. Neighbouring removed windows join up to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm import runs as rn
from promptloom.llm import textnum as tn
from promptloom.llm.common import stash
from promptloom.llm.packing import packed_texts, unpacked

WINDOW, PREFIX = 20, 10
#: Text per group of runs, and of contexts.
GROUP, CONTEXTS = 12 << 20, 4 << 20


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, stop, first = tn.words(data, offsets)
    return tn.word_hashes(data, begin, stop), first


def word_units(window: int = WINDOW, prefix: int = PREFIX) -> rn.Units:
    longer = sorted({prefix + (window - prefix) // 2, window - (window - prefix) // 4, window} - {prefix})
    return rn.Units(_hashes, tn.words, window, prefix, tuple(longer), batch=4 << 20, every=False)


def word_numbers(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only: all bytes are compared."""
    size = stop - begin
    ends = np.append(0, np.cumsum(size))
    source = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
    listed = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[source]))])
    return listed.dictionary_encode().indices.to_numpy().astype(np.int64)


def sorted_suffixes(numbers: np.ndarray, first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order of the suffixes that begin at ``starts`` and go on to the end of their context
    (numbers[first[i]:first[i + 1]]), by doubling the number of words compared. A suffix
    that is the beginning of another comes before it."""
    stop = np.repeat(first[1:], np.diff(first))
    rank, done, place = numbers + 1, 1, np.arange(len(numbers))  # 0 stands for what lies behind an end
    while done < np.diff(first).max():
        behind = place + done
        following = np.where(behind < stop, rank[np.minimum(behind, len(rank) - 1)], 0)
        rank = np.unique(rank * (int(rank.max()) + 1) + following, return_inverse=True)[1] + 1
        done *= 2
    return np.argsort(rank[starts], kind="stable")


def shared_words(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it (0 for the first)."""
    shared, going = np.zeros(len(starts), np.int64), np.arange(1, len(starts))
    depth = 0
    while len(going):
        a, b = starts[going - 1] + depth, starts[going] + depth
        fits = (a < ends[going - 1]) & (b < ends[going])
        going, a, b = going[fits], a[fits], b[fits]
        going = going[numbers[a] == numbers[b]]
        shared[going] += 1
        depth += 1
    return shared


def deep_nodes(shared: np.ndarray, depth: int) -> np.ndarray:
    """The number of the topmost internal node of at least this depth above each leaf of a
    tree, given its sorted leaves' shared lengths; a leaf alone has a number of its own."""
    return np.cumsum(shared < depth)


def later_windows(heads: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Build the subtrees of a group of contexts. (id, start) of the leaves below deep nodes
    but for each node's first."""
    begin, stop, first = tn.words(data, offsets)
    numbers = word_numbers(data, begin, stop)
    count = heads[:, 4]
    own = np.repeat(np.arange(len(heads)), count)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    starts, ends = first[:-1][own] + inner, first[1:][own]
    doc, at = heads[own, 1], heads[own, 2] + inner
    order = sorted_suffixes(numbers, first, starts)
    node = deep_nodes(shared_words(numbers, starts[order], ends[order]), window)
    doc, at = doc[order], at[order]
    by = np.lexsort((at, doc, node))
    doc, at, node = doc[by], at[by], node[by]
    head = np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), np.arange(len(node)), 0))
    later = (doc != doc[head]) | (at != at[head])
    return doc[later], at[later]


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, groups: int | None = None, **tuning: int) -> DataFrame:
    """Word spans (id, lo, hi) covered by windows that occur earlier. ``docs`` has id, text."""
    units, limit = word_units(window, prefix), tuning.pop("limit", rn.LIMIT)
    units = replace(units, batch=tuning.pop("batch", units.batch))
    settled = rn.repeated_runs(docs, units, groups or rn.group_count(docs, GROUP), **tuning)
    found = stash(rn.contexts(docs, settled, units), "contexts")
    together, alone = rn.dealt(found, units, limit)

    def subtree(table: pa.Table) -> pa.Table:
        doc, at = later_windows(*rn.unpack_group(table), window)
        return rn.spans(doc, at, at + window)

    sent = rn.packed_groups(together, groups or rn.body_groups(found, CONTEXTS))
    deep = sent.groupBy("group").applyInArrow(subtree, "id long, lo long, hi long")
    known = settled.filter("key is null").select("id", "lo", "hi").union(deep)
    return known.union(rn.single_windows(alone, units)) if alone.limit(1).count() else known


def kept_words(data: np.ndarray, offsets: np.ndarray, cover: list) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words, removed, kept text) per row; cover: (lo, hi) pairs of each row or None."""
    begin, stop, first = tn.words(data, offsets)
    n = np.diff(first)
    drop = np.zeros(len(begin) + 1, np.int64)
    for i, pairs in enumerate(cover):
        for p in pairs or ():
            lo, hi = first[i] + min(p["lo"], n[i]), first[i] + min(p["hi"], n[i])
            drop[lo] += 1
            drop[hi] -= 1
    stay = np.cumsum(drop[:-1]) == 0
    row = np.repeat(np.arange(len(n)), n)
    kept = np.bincount(row[stay], minlength=len(n)) if len(row) else np.zeros(len(n), np.int64)
    size = stop[stay] - begin[stay] + 1  # a space follows each word
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.arange(len(out)) - np.repeat(ends - size, size)
    body = inner < np.repeat(size, size) - 1
    out[body] = data[(np.repeat(begin[stay], size) + inner)[body]]
    edge = np.append(0, ends)[np.append(0, np.cumsum(kept))]
    raw = out.tobytes()
    return n, n - kept, [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, groups: int | None = None, **tuning: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) for every
    row of ``docs``. ``tuning``: limit, batch, sample and crowd, as in ``runs``.

    A word goes if a window over it starts earlier too: in a smaller doc_id, or before in
    the same document. An id stands for one document, so rows that repeat are treated
    alike and not as copies of one another; rows with null ids are documents of their own
    that come first. Texts without words (null ones too) keep the empty text; an empty
    table gives an empty result. Other columns are not read.
    """
    numbered = docs.select("doc_id", rn.stand_in(F.col("doc_id"), F.col("text")).alias("id"), "text")
    found = repeats(numbered, window, prefix, groups, **tuning).groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("cover"))
    joined = packed_texts(numbered).join(found, "id", "left").select("id", "packed", "cover")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in unpacked(batches):
            n, removed, kept = kept_words(data, offsets, part.column(2).to_pylist())
            ids = [None if i < -(2**60) else i for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(rewrite, "doc_id long, n_words long, n_removed long, kept string")
