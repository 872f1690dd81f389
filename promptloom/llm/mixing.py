"""Mixing sources to target weights by capped water-filling, in DataFrame operations.

Targets: each source's share of the total is clamped at ``max_epochs`` times its
size; the excess is shared again by weight until no source is above its clamp.
That fixed point is one water level L with target = min(cap, weight * L). Sorted
by cap / weight, the clamped sources are a prefix, so L follows from cumulative
sums over one row per source, without a loop. The sums run by ranges of sources, so
that sources may be as many as web hosts.

Sampling: target / size gives whole repetitions of every document and one
fractional repetition. The fraction takes documents in a seeded hash order until
the source's words are used up; the document at the end is taken in part, so that
the words taken equal the target but for rounding. Sums per (source, hash
bucket) locate the end; only the documents of that one bucket are ordered, so a
source with a third of all rows is never sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import WORD, numbered, stash, sums_before, whole

WEIGHTS = (5.0, 2.0, 1.0)
#: Hash buckets of a source: leading hexadecimal digits of the draw.
BUCKET_DIGITS = 3


def sizes(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, source and size (words split at white space; null texts have none)."""
    return docs.select("doc_id", *carry, "source", F.regexp_count(whole(F.col("text")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Weights are dealt to the sources in code point order, null last, repeating. A source
    without words gets target 0.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("absent", F.col("source").isNull())
    ranked = numbered(sums, "absent", "source", out="place")
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.get(dealt, (F.col("place") % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight"))
    # of the sources before each one in the order of their caps: the sums of caps and of weights
    leveled = stash(sums_before(ranked, "fill", "place", totals=True, capped="cap", light="weight"), "mix-levels")
    level = (F.col("all") * F.lit(float(share)) - F.col("capped")) / (F.col("light_total") - F.col("light"))
    total = leveled.agg(F.sum("source_size").alias("all"))  # one row
    levels = leveled.join(F.broadcast(total)).withColumn("level", level)
    # the water level is that of the first source, in this order, that is not clamped
    water = levels.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min_by("level", F.struct("fill", "place")).alias("water"))  # one row
    return leveled.join(F.broadcast(water)).select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("water")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = 3.0, seed: int = 17, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of the document),
    and the columns of ``docs`` named in ``carry``.

    ``taken`` is size times the whole repetitions, plus size for documents inside the
    fractional repetition, plus part of the size for the one at its end. Reruns agree:
    the order is a hash of seed and doc_id, then doc_id, then size; repeated rows are
    interchangeable. Null ids and sources are ordinary values. An empty table gives an
    empty result.
    """
    sized = stash(sizes(docs, carry), "mix-sizes")
    targets = source_targets(sized, weights, share, max_epochs).withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    targets = targets.withColumn("rest", F.round(F.col("target")) - F.col("times") * F.col("source_size")).withColumn("rest", F.greatest(F.col("rest"), F.lit(0.0)).cast("long"))
    hashed = sized.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(run)).withColumn("from", F.col("upto") - F.col("words"))
    t = targets.alias("t")
    ends = sums.alias("s").join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(F.col("s.source").alias("source"), "bucket", "from", "upto", "source_size", "target", "times", "rest")
    rows = hashed.alias("d").join(ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket"))).select("doc_id", *carry, "d.source", "d.bucket", "draw", "size", "source_size", "target", "times", "rest", "from", "upto")
    last = (F.col("from") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    inside = rows.filter(~last).withColumn("part", F.when(F.col("upto") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size")
    at_end = rows.filter(last).withColumn("before", F.col("from") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at_end = at_end.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    return inside.unionByName(at_end).select("doc_id", *carry, "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes words of, with all their columns and size,
    target and taken. Columns of ``docs`` with these names are replaced."""
    marked = docs.withColumn("__print", F.xxhash64("text", "source"))
    part = mix(marked, weights, share, max_epochs, seed, carry=("__print",)).filter("taken > 0").dropDuplicates(["doc_id", "__print"]).alias("m")
    names = [c for c in docs.columns if c not in ("size", "target", "taken")]
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.__print") == F.col("m.__print"))
    return marked.alias("d").join(part, same).select(*[F.col(f"d.`{c}`").alias(c) for c in names], "m.size", "m.target", "m.taken")
