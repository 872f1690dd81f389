"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch that were not met before are laid end to end in one array
of symbol ids. In each round every sequence applies its own lowest-rank pair, at all
of that pair's places, and all sequences do so in the same few array operations; a
sequence is done when no adjacent pair has a rank. Its surviving symbols are its
tokens. Only counts leave the function; texts are read whole.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm import textnum as tn
from promptloom.shipping import ship

#: Fixed values of the vocabulary file: what counts as a pre-token, and the end mark.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
LIMIT = 2048
#: Pre-tokens whose counts a worker remembers; beyond that it forgets and starts anew.
REMEMBERED = 1 << 19
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is
    printable and no space, else one from U+0100 on, in order."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def load(path: str) -> dict:
    """What counting needs of a vocabulary file: arrays, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left = np.array([ids[a] for a, _ in merges], np.int64)
    right = np.array([ids[b] for _, b in merges], np.int64)
    made = np.array([ids[a + b] for a, b in merges], np.int64)
    size = max(ids.values()) + 1
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    keys, order = keys[order], order.astype(np.int64)
    symbols = byte_symbols()
    return {
        "size": size, "keys": keys, "ranks": order, "made": made[order],
        "inner": np.array([ids[s] for s in symbols], np.int64), "last": np.array([ids[s + END] for s in symbols], np.int64),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def merge_counts(pieces: list[bytes], model: dict) -> np.ndarray:
    """Tokens of each piece (not empty)."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    symbols = model["inner"][data]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = model["last"][data[ends - 1]]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    counts = lengths.copy()
    keys, ranks, made, size = model["keys"], model["ranks"], model["made"], model["size"]
    while len(symbols) > 1:
        pair = symbols[:-1] * size + symbols[1:]
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        known = (keys[found] == pair) & (owner[:-1] == owner[1:])
        rank = np.where(known, ranks[found], NONE)
        rank = np.append(rank, NONE)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.minimum.reduceat(rank, first)
        live = lowest < NONE
        if not live.any():
            break
        per_symbol = np.repeat(lowest, np.diff(np.append(first, len(symbols))))
        chosen = (rank == per_symbol) & (rank < NONE)
        # in a run of places that overlap (a a a), every second one from the left merges
        at = np.flatnonzero(chosen)
        fresh = np.append(True, at[1:] != at[:-1] + 1)
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        symbols[at] = made[found[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        # sequences without any pair left are finished and leave the arrays
        done = ~np.repeat(live, np.diff(np.append(first, len(symbols))))
        counts[owner[first[~live]]] = np.diff(np.append(first, len(symbols)))[~live]
        keep &= ~done
        symbols, owner = symbols[keep], owner[keep]
        counts[owner] = 0
    if len(symbols):
        rest, n = np.unique(owner, return_counts=True)
        counts[rest] = n
    return counts


class Counter:
    def __init__(self, model: dict) -> None:
        self.model, self.seen = model, {}
        self.piece = regex.compile(PIECE)
        self.special = regex.compile("|".join(map(regex.escape, model["special"]))) if model["special"] else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        out: list[str] = []
        for part in parts:
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # else lower() looks at what follows a sigma
            out += self.piece.findall(part.lower())
        return out, len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = [p for p in set().union(*[p for p, _ in split]) if p not in self.seen]
        if new:
            self.seen.update(zip(new, merge_counts([p.encode() for p in new], self.model).tolist(), strict=True))
        return [sum(map(self.seen.__getitem__, p)) + n for p, n in split]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    ``path`` is the vocabulary file, read on the driver; its tables (of fixed size) go to
    the workers in a broadcast. Null and empty texts have no bytes and no tokens; rows
    that repeat are counted each; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for rows, _, offsets in tn.chunks(batches):
            texts = rows.column(1).fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text")
    counted = sized.mapInArrow(run, f"doc_id {sized.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

