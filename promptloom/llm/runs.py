"""Which parts of the texts can hold a repeated window: sparse suffixes, cut out.

Both substring operators look for windows of ``window`` units (words or bytes) that
occur twice. Every window has an anchor: of its positions that start ``gram`` units, the
one where those hash lowest. Equal windows have equal anchors at the same distance, so
comparing texts from anchor to anchor loses nothing. Consecutive windows with one anchor
are a run; the text under a run is its context.

1. Runs of equal contexts (128 bits of fingerprint) are settled here: in a batch before
   the shuffle, then per group. One of them, the first by (id, start), goes on.
2. A run whose anchor gram has no other context cannot repeat and ends here.
3. The others are cut out of their documents: the contexts that the operators sort.

Groups go by the anchor's gram and are sized by the input. Grams with very many
contexts are found in a sample beforehand, and are dealt out by context instead: all
their contexts go on, and a task sends each of them once or twice, not once a batch. The
sample decides only where rows go.

Contexts are then dealt to groups by prefixes of variable length (``dealt``): a prefix
with more contexts than a task should hold is made longer, and longer again, until only
equal windows are left together, which are settled by a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm import textnum as tn
from promptloom.llm.common import stash
from promptloom.llm.packing import packed_texts, unpacked
from promptloom.shipping import ship

U = np.uint64
RUN = np.dtype([("key", "<u8"), ("print", "<u8"), ("id", "<i8"), ("start", "<i4"), ("count", "<i2"), ("off", "<i2"), ("many", "?")])
SPANS = pa.schema([("id", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
SENT = pa.schema([("bucket", pa.int64()), ("payload", pa.binary()), *SPANS])
SETTLED = pa.schema([*SPANS, ("key", pa.int64()), ("off", pa.int64())])
CONTEXT = "prefix long, id long, lo long, off int, count int, body binary"
#: One document in so many is looked at for grams with more contexts than CROWD.
SAMPLE, CROWD = 32, 20_000
#: Contexts of one prefix that are sorted together.
LIMIT = 5_000


@dataclass(frozen=True)
class Units:
    """What texts are made of. ``cut``: (hash of each unit, first unit of each row) of a
    buffer of rows; ``bounds``: (byte where each unit starts, where it ends, first unit of
    each row)."""

    cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    bounds: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    window: int
    gram: int
    #: Lengths of the prefixes that crowded contexts get, one after another.
    longer: tuple[int, ...]
    #: Text worked on at once.
    batch: int
    #: Whether every occurrence of a repeat counts, or all but the first.
    every: bool


def stand_in(doc_id: Column, text: Column) -> Column:
    """The id, or for null a negative number made from the text, so that rows without ids
    are documents of their own that come before all others."""
    return F.coalesce(doc_id.cast("long"), -F.abs(F.shiftright(F.xxhash64(text), 2)) - F.lit(2**62))


def group_count(docs: DataFrame, group: int) -> int:
    """Groups of about ``group`` bytes of text, from the size of the files to be read, or if
    Spark does not know that, from the lengths of the texts."""
    size = 2 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, size // group)


def body_groups(found: DataFrame, group: int) -> int:
    """Groups of about ``group`` bytes of contexts, by their lengths: near copies compress so
    well that file sizes tell little."""
    return max(8, (found.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // group)


def lowest(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` neighbours, by doubling."""
    done, out = 1, values
    while done * 2 <= span:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    if done < span and len(out) > span - done:
        out = np.minimum(out[: len(out) - (span - done)], out[span - done :])
    return out[: max(len(values) - span + 1, 0)]


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For each position the first of the ``span`` positions from it with the least gram."""
    low = U((1 << 24) - 1)
    at = np.arange(len(grams), dtype=U) & low
    best = lowest((grams & ~low) | at, span) & low
    start = np.arange(len(best))
    return start + ((best.astype(np.int64) - start) & ((1 << 24) - 1))


def runs_of(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The runs of a batch of rows: row i has the units hashes[first[i]:first[i + 1]]."""
    n = np.diff(first)
    count = np.maximum(n - window + 1, 0)
    if not count.any():
        return np.zeros(0, RUN)
    sums = tn.prefix_sums(hashes)
    place = np.arange(len(hashes) - gram + 1)
    grams = tn.between(sums, place, place + gram)
    anchor = anchors(grams, window - gram + 1)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]
    own = anchor[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(fresh)
    runs = np.zeros(len(head), RUN)
    length = np.diff(np.append(head, len(at)))
    begin, a = at[head], own[head]
    runs["key"], runs["id"], runs["start"], runs["count"], runs["off"] = grams[a], ids[row[head]], begin - first[:-1][row[head]], length, a - begin
    runs["print"] = tn.mix(tn.between(sums, begin, begin + length - 1 + window) ^ ((a - begin).astype(U) * U(4096) + length.astype(U)))
    return runs


def settle(runs: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs sorted by context, the first of each context, and which runs are repeats
    entirely). A run that stands for ``many`` of its context is one with ``every``."""
    order = np.lexsort((runs["start"], runs["id"], runs["print"], runs["key"]))
    r = runs[order]
    head = np.ones(len(r), bool)
    head[1:] = (r["key"][1:] != r["key"][:-1]) | (r["print"][1:] != r["print"][:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    other = (r["id"] != r["id"][first][group]) | (r["start"] != r["start"][first][group])
    many = np.bincount(group, weights=other | r["many"], minlength=len(first)) > 0
    return r, first, (many[group] if every else other)


def spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Union of spans per document."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(doc):
        return SPANS.empty_table()
    new_doc = np.append(True, doc[1:] != doc[:-1])
    shift = np.cumsum(new_doc) * (int(hi.max()) + 1)  # documents one after another on one line
    reach = np.maximum.accumulate(hi + shift)
    fresh = new_doc | np.append(True, (lo + shift)[1:] > reach[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return pa.Table.from_arrays([pa.array(doc[first]), pa.array(lo[first]), pa.array(reach[last] - shift[last])], schema=SPANS)


def crowded_grams(docs: DataFrame, units: Units, sample: int, crowd: int) -> np.ndarray:
    """Grams that are expected to have more contexts than ``crowd``: at most one for so many
    runs of the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tn.chunks(batches, limit=units.batch):
            hashes, first = units.cut(data, offsets)
            runs = runs_of(hashes, first, part.column(0).to_numpy(zero_copy_only=False), units.window, units.gram)
            r, head, _ = settle(runs, units.every)
            key, n = np.unique(r["key"][head], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    looked_at = docs.filter(F.pmod(F.xxhash64("id"), F.lit(sample)) == 0).select("id", "text")
    seen = looked_at.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > max(1, crowd // sample))
    return np.sort(np.array([r.key for r in seen.select("key").collect()], np.int64).view(U))


def one_of(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def repeated_runs(docs: DataFrame, units: Units, groups: int, sample: int = SAMPLE, crowd: int = CROWD) -> DataFrame:
    """Written: spans that are repeats entirely (key null), and the contexts that may hold
    repeats (key, off: the anchor's distance from lo), one of each. ``docs`` has id, text."""
    ship(docs.sparkSession)
    window = units.window
    hot = docs.sparkSession.sparkContext.broadcast(crowded_grams(docs, units, sample, crowd))

    def to_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent_before: dict[tuple[int, int], tuple[int, int]] = {}
        for part, data, offsets in tn.chunks(batches, limit=units.batch):
            hashes, unit = units.cut(data, offsets)
            runs = runs_of(hashes, unit, part.column(0).to_numpy(zero_copy_only=False), window, units.gram)
            if not len(runs):
                continue
            r, first, gone = settle(runs, units.every)
            sent = r[first]
            if units.every:
                sent["many"] = gone[first]
            crowded = one_of(sent["key"], hot.value)
            known = r[gone]
            if crowded.any():
                again = sent_already(sent, np.flatnonzero(crowded), sent_before, units.every)
                known, sent, crowded = np.concatenate([known, sent[again]]), sent[~again], crowded[~again]
            spread = np.where(crowded, tn.mix(sent["key"] ^ sent["print"]), sent["key"])
            bucket = (spread % U(groups)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            sent, bucket = sent[by], bucket[by]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            payload = [sent[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(sent)), strict=True)] if len(sent) else []
            none = pa.nulls(len(payload), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.array(payload, pa.binary()), none, none, none], schema=SENT)
            for b in spans(known["id"], known["start"], _stop(known, window)).to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() % groups), pa.nulls(b.num_rows, pa.binary()), *b.columns], schema=SENT)

    def settle_group(table: pa.Table) -> pa.Table:
        out = [_known(table.filter(table["payload"].is_null()).select(["id", "lo", "hi"]))]
        runs = np.frombuffer(b"".join(p for p in table["payload"].to_pylist() if p is not None), RUN)
        if len(runs):
            r, first, gone = settle(runs, units.every)
            stop = _stop(r, window)
            out.append(_known(spans(r["id"][gone], r["start"][gone], stop[gone])))
            rep, stop = r[first], stop[first]
            bucket = np.cumsum(np.append(True, rep["key"][1:] != rep["key"][:-1])) - 1
            go = (np.bincount(bucket) > 1)[bucket] | one_of(rep["key"], hot.value)
            if units.every:  # nothing is left to find in contexts that are all repeats entirely
                go &= (np.bincount(bucket, weights=~gone[first]) > 0)[bucket] | one_of(rep["key"], hot.value)
            left = rep[go]
            out.append(pa.Table.from_arrays([pa.array(left["id"]), pa.array(left["start"].astype(np.int64)), pa.array(stop[go]), pa.array(np.ascontiguousarray(left["key"]).view(np.int64)), pa.array(left["off"].astype(np.int64))], schema=SETTLED))
        return pa.concat_tables(out)

    sent = docs.select("id", "text").mapInArrow(to_groups, "bucket long, payload binary, id long, lo long, hi long")
    return stash(sent.groupBy("bucket").applyInArrow(settle_group, "id long, lo long, hi long, key long, off long"), "settled")


def sent_already(sent: np.ndarray, looked_at: np.ndarray, before: dict[tuple[int, int], tuple[int, int]], every: bool) -> np.ndarray:
    """Which of a batch's runs the task need not send, as it has sent their contexts: they
    are repeats entirely. With ``every`` a context is sent twice, the second time as
    ``many``; else again only from a place before the one sent."""
    out = np.zeros(len(sent), bool)
    for i, context, place in zip(looked_at.tolist(), zip(sent["key"][looked_at].tolist(), sent["print"][looked_at].tolist(), strict=True), zip(sent["id"][looked_at].tolist(), sent["start"][looked_at].tolist(), strict=True), strict=True):
        known = before.get(context)
        if known is None:
            before[context] = (0, bool(sent["many"][i])) if every else place
        elif every:
            out[i] = known[1]
            sent["many"][i] = True
            before[context] = (0, True)
        elif known < place:
            out[i] = True
        else:
            before[context] = place
    return out


def _stop(runs: np.ndarray, window: int) -> np.ndarray:
    return runs["start"].astype(np.int64) + runs["count"] - 1 + window


def _known(table: pa.Table) -> pa.Table:
    none = pa.nulls(table.num_rows, pa.int64())
    return pa.Table.from_arrays([*[c.cast(pa.int64()) for c in table.columns], none, none], schema=SETTLED)


def contexts(docs: DataFrame, settled: DataFrame, units: Units) -> DataFrame:
    """The contexts that may hold repeats, with their text (CONTEXT)."""
    wanted = settled.filter("key is not null").groupBy("id").agg(F.collect_list(F.struct("lo", "hi", "key", "off")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in unpacked(batches):
            begin, end, first = units.bounds(data, offsets)
            raw, out = data.tobytes(), []
            for i, (doc, places) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                for w in places:
                    lo, hi = first[i] + w["lo"], first[i] + w["hi"]
                    if hi <= first[i + 1]:  # else another text under the same id
                        out.append((w["key"], doc, w["lo"], w["off"], w["hi"] - w["lo"] - units.window + 1, raw[begin[lo] : end[hi - 1]]))
            yield _rows(out)

    return packed_texts(docs).join(wanted, "id").select("id", "packed", "wanted").mapInArrow(cut, CONTEXT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["prefix", "id", "lo", "off", "count", "body"])


def pieces(row: tuple, units: Units, length: int) -> list[tuple]:
    """The contexts with prefixes of ``length`` units that a context is split into. The prefix
    that starts k units before the anchor is in the windows that start between k and
    k + window - length before it, and so in all windows equal to one of those."""
    key, doc, lo, off, count, body = row
    data = np.frombuffer(body, np.uint8)
    whole = np.array([0, len(data)])
    hashes, first = units.cut(data, whole)
    begin, end, _ = units.bounds(data, whole)
    sums, width, out = tn.prefix_sums(hashes), units.window - length + 1, []
    for k in range(0, units.window, width):
        a, b = max(0, off - k - width + 1), min(count - 1, off - k)
        if a <= b:
            at = np.array([off - k])
            prefix = int(tn.mix(tn.between(sums, at, at + length) ^ U(k + 1)).view(np.int64)[0])
            out.append((prefix, doc, lo + a, off - a, b - a + 1, body[begin[a] : end[b + units.window - 1]]))
    return out


def dealt(found: DataFrame, units: Units, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(contexts whose prefixes have at most ``limit`` contexts each, windows that are left
    alone): prefixes with more are made longer, one step after another. Written."""
    done = []
    for length in units.longer:
        hot = stash(found.groupBy("prefix").count().filter(F.col("count") > limit).select("prefix"), "hot-prefixes")
        if not hot.limit(1).count():
            return _union([*done, found]), found.limit(0)
        done.append(found.join(hot, "prefix", "left_anti"))

        def split(batches: Iterator[pa.RecordBatch], length: int = length) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True)
                yield _rows([p for row in rows for p in pieces(row, units, length)])

        columns = ("prefix", "id", "lo", "off", "count", "body")
        found = stash(found.join(hot, "prefix", "left_semi").select(*columns).mapInArrow(split, CONTEXT), "longer-prefixes")
    hot = stash(found.groupBy("prefix").count().filter(F.col("count") > limit).select("prefix"), "hot-prefixes")
    return _union([*done, found.join(hot, "prefix", "left_anti")]), found.join(hot, "prefix", "left_semi")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def single_windows(found: DataFrame, units: Units) -> DataFrame:
    """Spans of the repeats among windows under prefixes that stay crowded: a row for each
    window and its 128-bit fingerprint, counted in an aggregation that combines before
    the shuffle, and joined back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, doc, lo, _, count, body in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                data = np.frombuffer(body, np.uint8)
                hashes, _ = units.cut(data, np.array([0, len(data)]))
                at = np.arange(count)
                p = tn.between(tn.prefix_sums(hashes), at, at + units.window)
                q = tn.between(tn.prefix_sums(tn.mix(hashes)), at, at + units.window)
                out += zip(p.view(np.int64).tolist(), q.view(np.int64).tolist(), [doc] * count, (lo + at).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["p", "q", "id", "at"])

    rows = stash(found.select("prefix", "id", "lo", "off", "count", "body").mapInArrow(each, "p long, q long, id long, at long"), "single-windows")
    ends = rows.groupBy("p", "q").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.struct("id", "at")).alias("last")).filter("first <> last")
    met = rows.join(ends, ["p", "q"])
    hit = met if units.every else met.filter(F.struct("id", "at") != F.col("first"))
    return hit.select("id", F.col("at").alias("lo"), (F.col("at") + units.window).alias("hi"))


def packed_groups(found: DataFrame, groups: int) -> DataFrame:
    """Contexts by group of prefixes, those of a batch compressed together: group, payload.
    Dealt to tasks of some groups each: their few bytes would be coalesced into few tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            group = (tn.mix(batch.column(0).to_numpy().view(U)) % U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            edge = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else order
            names, out = group[order][edge], []
            for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
                rows = batch.take(pa.array(order[a:b]))
                heads = np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(5)], 1)
                bodies = rows.column(5).to_pylist()
                sizes = np.array([len(x) for x in bodies], np.int64)
                out.append(squeeze.compress(b"".join([len(sizes).to_bytes(8, "little"), heads.tobytes(), sizes.tobytes(), *bodies])))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["group", "payload"])

    packed = found.select("prefix", "id", "lo", "off", "count", "body").mapInArrow(pack, "group long, payload binary")
    return packed.repartition(max(found.sparkSession.sparkContext.defaultParallelism, groups // 4), "group")


def unpack_group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(heads: prefix, id, lo, off, count of each context; bytes; offsets of the bodies)."""
    unpack, heads, sizes, bodies = zstandard.ZstdDecompressor(), [], [], []
    for payload in table["payload"].to_pylist():
        raw = unpack.decompress(payload)
        n = int.from_bytes(raw[:8], "little")
        heads.append(np.frombuffer(raw, np.int64, 5 * n, 8).reshape(n, 5))
        sizes.append(np.frombuffer(raw, np.int64, n, 8 + 40 * n))
        bodies.append(raw[8 + 48 * n :])
    return np.concatenate(heads), np.frombuffer(b"".join(bodies), np.uint8), np.append(0, np.cumsum(np.concatenate(sizes)))
