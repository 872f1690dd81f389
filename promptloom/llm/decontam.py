"""Benchmark decontamination with a positional inverted index, in DataFrame operations.

The index is written once: of every training text, the postings (term, document,
position) of the terms that occur in test items, and one posting that ends the
document and so tells its number of words. Texts are split into words in this pass
only; everything below reads the index.

A test window is looked up from its two rarest terms, by their counts in the index:
each posting of the rarest is a place, and stays one if the other term has a posting
within ``WITHIN`` words of it. Only then are the postings of all of the window's terms
around the remaining places fetched. With each posting shifted back by its term's
offset in the window, a place where all lists agree is an exact phrase match; one
where every term is within ``WITHIN`` words of the rarest is a proximity match.

Joins on a term are salted, so a term that makes up a third of all words is spread;
joins around a place are cut into cells of positions, so neither a very long document
nor one that repeats a line gives all pairs of its postings. Nothing is broadcast but
what Spark knows to be small from the size of written files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import fold_ascii, stash, whole

TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LENGTH = 10
#: Words between a proximity match's rarest term and its others.
WITHIN = 20
#: Pieces that the postings of a term are spread over where they are joined in a shuffle.
SALTS = 8
#: The term of a document's last posting has this mark, which no word has, and a number
#: that spreads it.
END = "\x00"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(fold_ascii(text), F.lit(TERM), F.lit(0))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The postings (code, doc, pos from 0) of the terms in ``vocabulary`` (code, term), and
    of each document's end, which has no code but the doc_id and ``print``, a hash of the
    text. doc is a number of the row, so rows that repeat are documents of their own.
    Written; ``vocabulary`` is written, so that its size is known."""
    addressed = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.xxhash64(whole(F.col("text"))).alias("print"), terms(F.col("text")).alias("words"))
    end = F.concat(F.lit(END), F.pmod(F.col("print"), F.lit(1024)).cast("string"))
    each = addressed.select("doc", "doc_id", "print", F.posexplode(F.concat("words", F.array(end))).alias("pos", "term"))
    last = F.startswith("term", F.lit(END))
    kept = each.join(vocabulary, "term", "left").filter(F.col("code").isNotNull() | last)
    return stash(kept.select("code", "doc", "pos", *[F.when(last, F.col(c)).alias(c) for c in ("doc_id", "print")]), "index")


def documents_of(index: DataFrame) -> DataFrame:
    """doc, doc_id, print and n_words of every document."""
    return index.filter("code is null").select("doc", "doc_id", "print", F.col("pos").cast("long").alias("n_words"))


def test_windows(items: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows: window, words, size; window and item_id; vocabulary: code, term) of all test
    items, written. words are codes. An item shorter than ``length`` is one window; one
    without words has none."""
    split = stash(items.select("item_id", terms(F.col("text")).alias("words")).filter("size(words) > 0"), "items")
    vocabulary = stash(split.select(F.explode("words").alias("term")).distinct().select(F.monotonically_increasing_id().alias("code"), "term"), "vocabulary")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (length - 1)))
    cut = split.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, length))).alias("words")).distinct()
    named = stash(cut.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "phrases")
    coded = named.select("window", F.posexplode("words").alias("offset", "term")).join(vocabulary, "term")
    words = F.transform(F.array_sort(F.collect_list(F.struct("offset", "code"))), lambda s: s["code"])
    windows = stash(coded.groupBy("window").agg(words.alias("words")).withColumn("size", F.size("words")), "windows")
    return windows, stash(cut.join(named, "words").select("window", "item_id"), "window-items"), vocabulary


def rare_terms(windows: DataFrame, index: DataFrame) -> DataFrame:
    """window, and the (offset, code) of its rarest and second rarest term, written. Windows
    with a term that no document has are gone."""
    each = windows.select("window", "size", F.posexplode("words").alias("offset", "code"))
    counts = index.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("count"))
    ranked = each.join(counts, "code").groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("count", "offset", "code"))).alias("ranks"))  # at most a window's terms
    first, second = F.get("ranks", F.lit(0)), F.coalesce(F.get("ranks", F.lit(1)), F.get("ranks", F.lit(0)))
    pair = lambda r: F.struct(r["offset"].alias("offset"), r["code"].alias("code"))
    return stash(ranked.filter(F.size("ranks") == F.col("size")).select("window", pair(first).alias("first"), pair(second).alias("second")), "rare-terms")


def term_lists(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """window, doc, pos of the postings of the terms in ``wanted`` (window, code)."""
    salted = wanted.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    postings = index.select("code", "doc", "pos", F.pmod(F.col("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    return postings.join(salted, ["code", "salt"]).select("window", "doc", "pos")


def cells(pos: Column, within: int) -> Column:
    """The cell of positions that ``pos`` is in, and its neighbours."""
    cell = F.floor(pos / (within + 1))
    return F.explode(F.array(cell - 1, cell, cell + 1))


def places(index: DataFrame, rare: DataFrame, within: int) -> DataFrame:
    """window, doc, at: postings of rarest terms with the second rarest near, written."""
    a = term_lists(index, rare.select("window", "first.code")).withColumn("cell", cells(F.col("pos"), within)).alias("a")
    b = term_lists(index, rare.select("window", "second.code")).withColumn("cell", F.floor(F.col("pos") / (within + 1))).alias("b")
    near = (F.col("a.window") == F.col("b.window")) & (F.col("a.doc") == F.col("b.doc")) & (F.col("a.cell") == F.col("b.cell")) & (F.abs(F.col("a.pos") - F.col("b.pos")) <= within)
    return stash(a.join(b, near).select("a.window", "a.doc", F.col("a.pos").alias("at")).distinct(), "places")


def matches(index: DataFrame, windows: DataFrame, within: int = WITHIN) -> DataFrame:
    """Every match of a window: doc, window, at (its rarest term), start, size, and whether it
    is ``exact``. Written."""
    rare = rare_terms(windows, index)
    found = places(index, rare, within)
    # the postings of documents with places: these few documents are the side that is hashed
    of_docs = found.select("doc").distinct().hint("shuffle_hash")
    nearby = index.filter("code is not null").select("code", "doc", "pos").join(of_docs, "doc", "left_semi").withColumn("cell", F.floor(F.col("pos") / (within + 1))).alias("i")
    placed = found.join(rare.select("window", F.col("first.offset").alias("from")), "window").join(windows, "window")
    wanted = placed.select("window", "doc", "at", "size", (F.col("at") - F.col("from")).alias("start"), F.size(F.array_distinct("words")).alias("different"), F.posexplode("words").alias("offset", "code")).withColumn("cell", cells(F.col("at"), within)).alias("w")
    met = wanted.join(nearby, (F.col("w.doc") == F.col("i.doc")) & (F.col("w.code") == F.col("i.code")) & (F.col("w.cell") == F.col("i.cell")) & (F.abs(F.col("i.pos") - F.col("w.at")) <= within))
    on_place = F.when(F.col("i.pos") - F.col("w.offset") == F.col("w.start"), F.col("w.offset"))
    judged = met.groupBy("w.doc", "w.window", "w.at", "w.start", "w.size", "w.different").agg(F.count_distinct("w.code").alias("codes"), F.count_distinct(on_place).alias("agree"))
    return stash(judged.filter("codes = different").select("doc", "window", "at", "start", "size", (F.col("agree") == F.col("size")).alias("exact")), "matches")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = LENGTH, within: int = WITHIN) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit (words inside any exact occurrence of a test
    window), n_items and items_sha256 (items with such windows; ids sorted as strings,
    comma-joined), contaminated (n_hit > 0), and n_near and near_sha256 (items with
    proximity matches, exact ones among them).

    Null texts have no words; without items, or in an empty table, nothing is hit. Rows
    that repeat are documents of their own, with the same result; null ids are ordinary
    values; other columns are not read.
    """
    windows, of_items, vocabulary = test_windows(items, length)
    index = build_index(docs, vocabulary)
    found = matches(index, windows, within)
    spans = found.filter("exact").groupBy("doc", "start").agg(F.max("size").alias("size")).withColumn("end", F.col("start") + F.col("size"))
    before = Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0))).withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen")))
    covered = fresh.groupBy("doc").agg(F.sum("new").alias("n_hit"))
    item = F.col("item_id").cast("string")
    named = found.join(of_items, "window").groupBy("doc").agg(F.sort_array(F.collect_set(F.when(F.col("exact"), item))).alias("items"), F.sort_array(F.collect_set(item)).alias("near"))
    joined = documents_of(index).join(covered, "doc", "left").join(named, "doc", "left")
    hit, none = F.coalesce(F.col("n_hit"), F.lit(0)), F.array().cast("array<string>")
    digest = lambda name: F.sha2(F.array_join(F.coalesce(F.col(name), none), ","), 256)
    count = lambda name: F.size(F.coalesce(F.col(name), none)).cast("long")
    return joined.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), count("items").alias("n_items"), digest("items").alias("items_sha256"), (hit > 0).alias("contaminated"), count("near").alias("n_near"), digest("near").alias("near_sha256"))


def clean_rows(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` in which no test window occurs exactly, with all their columns."""
    windows, _, vocabulary = test_windows(items, length)
    index = build_index(docs, vocabulary)
    hit = matches(index, windows).filter("exact").select("doc").distinct()
    # written first, so that its size is known when the join is planned: few are broadcast
    dirty = stash(documents_of(index).join(hit, "doc").select(F.col("doc_id").alias("__id"), F.col("print").alias("__print")).distinct(), "dirty")
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["__id"]) & (F.xxhash64(whole(docs["text"])) == dirty["__print"]), "left_anti")
