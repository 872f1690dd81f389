"""N-gram Jaccard join by MinHash banding.

A document is the set of its word shingles. Documents with equal sets are one class
of copies, represented by its smallest id; only representatives are compared. Their
MinHash signature is cut into bands; representatives that share a band's hash meet
in a bucket, and every pair of a bucket is verified on the full sets of 64-bit shingle
hashes. A pair that shares several bands is verified in the first of them only, and a
bucket whose members all share an earlier one is left out: so most sets move once.

``ROWS`` and ``BANDS`` follow from the target recall: at similarity s a pair is met
with probability 1 - (1 - s**rows)**bands, which is 0.9998 at 0.8.

A bucket is never one unit of work: it is dealt into blocks of some ``BLOCK``
members, and pairs of blocks go to tasks. Inside a task, pairs exist as a matrix;
what leaves it is a row per member: number of links, and the smallest member of its
linked group there. The groups are joined up as connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm import textnum as tn
from promptloom.llm.common import stash
from promptloom.llm.graph import components
from promptloom.llm.packing import packed_texts, unpacked
from promptloom.shipping import ship

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9995
ROWS = 4
BLOCK = 512
U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands that meets a pair at the threshold with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the sorted distinct shingle hashes of row i are
    hashes[first[i]:first[i + 1]]. A row of fewer than ``size`` words, but not none, has
    one shingle of all its words."""
    starts, stops, first_word = tn.words(data, offsets)
    n = np.diff(first_word)
    sums = tn.prefix_sums(tn.word_hashes(data, starts, stops))
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first_word[:-1][row]
    h = tn.between(sums, at, at + np.minimum(size, n[row]))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(n) + 1))


def band_hashes(h: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per row and band, for rows with shingles (others get zeros)."""
    full = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, bands), U)
    if not len(full):
        return out
    factors = tn.mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    for band in range(bands):
        joined = np.full(len(full), band + 1, U)
        for k in range(rows):
            factor = factors[band * rows + k]
            joined = tn.mix(joined * tn.BASE + np.minimum.reduceat(tn.mix(h * factor), first[full]))
        out[full, band] = joined
    return out


def set_prints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each row's set: two independent sums over its hashes."""
    a = np.append(U(0), np.cumsum(tn.mix(h)))
    b = np.append(U(0), np.cumsum(tn.mix(h ^ U(0xA5A5A5A5A5A5A5A5))))
    return (a[first[1:]] - a[first[:-1]]).view(np.int64), (b[first[1:]] - b[first[:-1]]).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, anonymous, print (two longs), shingles, bands for every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tn.chunks(batches):
            h, first = shingle_sets(data, offsets, size)
            found = band_hashes(h, first, bands, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel()))
            p, q = set_prints(h, first)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array(q), pa.array(np.diff(first)), lists], ["doc_id", "anonymous", "p", "q", "shingles", "bands"])

    return docs.select("doc_id", "anonymous", "text").mapInArrow(run, "doc_id long, anonymous boolean, p long, q long, shingles long, bands array<long>")


def bucket_members(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Representatives with their sets, a row for each pair of blocks they take part in.
    wanted: id, p, q, copies, bands, buckets (array of bucket, band, blocks)."""
    rows = packed_texts(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(wanted, F.col("doc") == F.col("id")).select("packed", "id", "p", "q", "copies", "bands", "buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in unpacked(batches):
            h, first = shingle_sets(data, offsets, size)
            p, q = set_prints(h, first)
            cols = {n: part.column(part.schema.get_field_index(n)).to_pylist() for n in ("id", "p", "q", "copies", "bands", "buckets")}
            out: dict[str, list] = {n: [] for n in ("bucket", "low", "high", "block", "band", "id", "copies", "bands", "hashes")}
            for i, buckets in enumerate(cols["buckets"]):
                if p[i] != cols["p"][i] or q[i] != cols["q"][i]:
                    continue  # another text under the same id
                packed, bands = h[first[i] : first[i + 1]].tobytes(), np.array(cols["bands"][i], np.int64).tobytes()
                for b in buckets:
                    own = int(tn.mix(np.array([cols["id"][i]], np.int64).view(U))[0] % U(b["blocks"]))
                    for other in range(b["blocks"]):
                        for name, value in (("bucket", b["bucket"]), ("low", min(own, other)), ("high", max(own, other)), ("block", own), ("band", b["band"]), ("id", cols["id"][i]), ("copies", cols["copies"][i]), ("bands", bands), ("hashes", packed)):
                            out[name].append(value)
                if len(out["id"]) >= 256:
                    yield _members(out)
                    out = {n: [] for n in out}
            if out["id"]:
                yield _members(out)

    return rows.mapInArrow(run, "bucket long, low int, high int, block int, band int, id long, copies long, bands binary, hashes binary")


def _members(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"low": pa.int32(), "high": pa.int32(), "block": pa.int32(), "band": pa.int32(), "bands": pa.binary(), "hashes": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], list(out))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The matrix of intersection sizes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    number = np.cumsum(fresh) - 1
    common = np.bincount(number) > 1  # hashes of one set alone are in no intersection
    slot = np.cumsum(common) - 1
    keep = common[number]
    slot, owner = slot[number[keep]], owner[keep]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(common.sum()), 4096):
        part = (slot >= at) & (slot < at + 4096)
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[part], slot[part] - at] = 1
        total += m @ m.T
    return total


def verify(members: list[tuple], threshold: float) -> list[tuple[int, int, int, int]]:
    """members: (block, band, id, copies, bands, hashes) of one pair of blocks. Returns
    (id, linked documents, linked texts, smallest id of the linked group)."""
    ids = np.array([m[2] for m in members], np.int64)
    _, once = np.unique(ids, return_index=True)  # a row that comes twice counts once
    members, ids = [members[i] for i in once], ids[once]
    if len(ids) < 2:
        return []
    block, copies = np.array([m[0] for m in members]), np.array([m[3] for m in members], np.int64)
    bands = np.stack([np.frombuffer(m[4], np.int64) for m in members])
    sets = [np.frombuffer(m[5], U) for m in members]
    pair = ~np.eye(len(ids), dtype=bool)
    if block.min() != block.max():
        pair &= block[:, None] != block[None, :]
    for k in range(members[0][1]):
        pair &= bands[:, k][:, None] != bands[:, k][None, :]
    if not pair.any():
        return []
    sizes = np.array([len(s) for s in sets])
    both = shared_counts(sets)
    linked = pair & (both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9)
    label = np.arange(len(ids))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1))
        if (new == label).all():
            break
        label = new
    found = np.flatnonzero(linked.any(1))
    return [(int(ids[i]), int(copies[linked[i]].sum()), int(linked[i].sum()), int(ids[label[i]])) for i in found]


def links(members: DataFrame, threshold: float) -> DataFrame:
    """id, documents, texts, root: verified links, summed up per pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for row in zip(*cols, strict=True):
                if row[:3] != key:
                    found += verify(held, threshold) if len(held) > 1 else []
                    key, held = row[:3], []
                held.append(row[3:])
            if found:
                yield _links(found)
                found = []
        found += verify(held, threshold) if len(held) > 1 else []
        if found:
            yield _links(found)

    dealt = members.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return dealt.mapInArrow(run, "id long, documents long, texts long, root long")


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["id", "documents", "texts", "root"])


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, rows: int = ROWS, bands: int | None = None, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, copy_id (smallest id with the same shingle set),
    class_id (smallest id of its group of linked documents) and n_links (other documents
    with a similarity of ``threshold`` or more, copies included).

    Documents without words, null texts among them, are linked with nothing. Rows that
    repeat are copies of each other. A null id stays null, and stands in other
    rows' columns as a hash of its text. An empty table gives an empty result; other columns are not read.
    """
    bands = bands or bands_for(threshold, RECALL, rows)
    docs = docs.select(_identity().alias("doc_id"), F.col("doc_id").isNull().alias("anonymous"), "text")
    signed = stash(signatures(docs, bands, rows, size), "signatures")
    filled = signed.filter("shingles > 0")
    reps = filled.groupBy("p", "q").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = stash(reps, "representatives")
    own = filled.select(F.col("doc_id").alias("id"), "p", "q", "bands").dropDuplicates(["id", "p", "q"])
    tables = stash(own.join(reps, ["id", "p", "q"]), "band-tables")
    each = tables.select("id", "p", "q", F.posexplode("bands").alias("band", "bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = each.join(counts, "bucket").join(tables.select("id", "p", "q", "bands"), ["id", "p", "q"])
    ends = [f(F.get("bands", F.lit(k))).alias(f"{name}{k}") for k in range(bands) for name, f in (("min", F.min), ("max", F.max))]
    earlier = reduce(or_, [(F.col("band") > k) & (F.col(f"min{k}") == F.col(f"max{k}")) for k in range(bands)])
    needed = shared.groupBy("bucket", "band", "n").agg(*ends).filter(~earlier).select("bucket", "n")
    met = each.join(needed, "bucket").select("id", "p", "q", F.struct("bucket", "band", F.ceil(F.col("n") / block).cast("int").alias("blocks")).alias("b"))
    wanted = met.groupBy("id", "p", "q").agg(F.collect_list("b").alias("buckets")).join(tables, ["id", "p", "q"])
    found = stash(links(bucket_members(docs, wanted, size), threshold), "links")
    grouped = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("id").agg(F.sum("documents").alias("documents"))
    summary = stash(reps.join(totals, "id", "left").join(grouped.withColumnRenamed("node", "id"), "id", "left").select("p", "q", F.col("id").alias("copy_id"), F.coalesce("label", "id").alias("class_id"), (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    named = signed.select("doc_id", "anonymous", "p", "q", "shingles").join(summary, ["p", "q"], "left")
    alone = F.col("shingles") == 0
    return named.select(F.when(~F.col("anonymous"), F.col("doc_id")).alias("doc_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.col("doc_id").alias(IDENTITY))


#: The column with each row's id or what stands for it.
IDENTITY = "identity"


def _identity():
    """The id, or a hash of the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit("no id")))


def keep_one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those in a group with a smaller
    id. The ids to drop are written first, so that few of them are broadcast and many
    are joined in a shuffle."""
    groups = jaccard_join(docs, threshold, size)
    dropped = stash(groups.filter(F.col(IDENTITY) != F.col("class_id")).select(F.col(IDENTITY).alias("__dropped")).distinct(), "dropped")
    names = docs.columns
    return docs.withColumn("__id", _identity()).join(dropped, F.col("__id") == F.col("__dropped"), "left_anti").select(*[F.col(f"`{c}`") for c in names])
