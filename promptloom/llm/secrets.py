"""Secret scans with an incremental blob ledger, in DataFrame operations only.

A version is a row (path id, text). Its blob is addressed by the SHA-256 of the
text. The ledger lists (blob, rule version) pairs that were scanned; a scan takes
one copy of each blob not listed there, and its findings, joined back by blob,
hold for all paths and versions with that content.

Spark has no function for match positions, so each rule's matches are extracted
and the text is split at them: lengths of pieces and matches, summed up, give
the spans, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.llm.common import stash, whole


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is
    shorter than ``least`` characters are dropped. ``base`` rules are counted."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


#: In both patterns with a bare run the length is part of the pattern: a run of one
#: character class is matched as a whole, so this drops the same matches.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 20, base=False),
)
RULE_VERSION = "1"
LEDGER = "blob string, rule_version string"
FINDINGS = "blob string, rule_version string, kind string, start long, end long"


def blobs(versions: DataFrame) -> DataFrame:
    """The address of each version: doc_id, blob. Null texts are empty blobs."""
    return versions.select("doc_id", F.sha2(whole(F.col("text")), 256).alias("blob"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row (blob, content) for each blob whose pair with the rule version is not in
    the ledger. Which copy is read is settled on ids; texts are shuffled once."""
    addressed = versions.select("doc_id", F.sha2(whole(F.col("text")), 256).alias("blob"))
    chosen = addressed.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    if ledger is not None:
        chosen = chosen.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    texts = versions.select("doc_id", whole(F.col("text")).alias("content")).withColumn("blob", F.sha2("content", 256))
    picked = chosen.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"))
    rows = texts.join(picked.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(picked["d"]) & (texts["blob"] == picked["b"]))
    # filters stay above a projection with the partition's id: else the optimizer would apply
    # the rules below the join, to all texts and not only to unseen blobs
    return rows.select("blob", F.when(F.spark_partition_id() >= 0, F.col("content")).alias("content"))


def scan(contents: DataFrame, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings (blob, rule_version, kind, start, end) in ``contents`` (blob, content).
    Rows of one blob that come twice give each finding once."""
    found = contents.select("blob", "content", *[F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0)).alias(f"m_{r.kind}") for r in rules]).filter(" OR ".join(f"size(m_{r.kind}) > 0" for r in rules))
    hit = "struct<kind:string,gap:bigint,len:bigint,x:string>"
    per_rule = []
    for r in rules:
        matched = f"m_{r.kind}"
        # the text before each match, and the match; what follows the last one is of no use
        gaps = F.slice(F.transform(F.split("content", r.pattern, -1), F.length), 1, F.size(matched))
        pairs = F.arrays_zip(F.col(matched).alias("m"), gaps.alias("p"))
        kind = F.lit(r.kind)
        listed = F.transform(pairs, lambda z: F.struct(kind.alias("kind"), z["p"].cast("long").alias("gap"), F.length(z["m"]).cast("long").alias("len"), z["m"].alias("x")))  # noqa: B023
        per_rule.append(F.when(F.size(matched) > 0, listed).otherwise(F.array().cast(f"array<{hit}>")))
    rows = found.select("blob", F.explode(F.array(*per_rule)).alias("hits")).select("blob", F.posexplode("hits").alias("at", "hit")).select("blob", "at", "hit.*")
    least = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.least))])
    value = F.col("len")
    for r in rules:
        if r.group:
            value = F.when(F.col("kind") == r.kind, F.length(F.regexp_extract("x", r.pattern, r.group))).otherwise(value)
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("value", value).drop("x").distinct()  # a row that comes twice counts once
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
    rows = rows.filter(F.col("value") >= least[F.col("kind")])
    return rows.select("blob", F.lit(rule_version).alias("rule_version"), "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def scan_increment(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of unseen blobs, ledger rows to append). With the ledger and findings
    of earlier runs appended, a rerun over the same versions scans nothing."""
    todo = unseen(versions, ledger, rule_version)
    return scan(todo, rules, rule_version), blobs(versions).select("blob", F.lit(rule_version).alias("rule_version")).distinct()


def report(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to all versions: doc_id, n_<kind> of the base rules,
    base_sha256, spans. Versions without findings get zeros and the digest of ''."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = [r.kind for r in rules if r.base]
    shown = lambda keep: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))), keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    per_blob = findings.groupBy("blob").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base], shown(lambda s: s["kind"].isin(base)).alias("base"), shown(lambda s: s["kind"].isNotNull()).alias("spans"))
    per_blob = stash(per_blob, "findings")  # a plain shuffle on both sides, so a hot blob can be split
    return blobs(versions).join(per_blob, "blob", "left").select(
        "doc_id", *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in base], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def secret_scan(versions: DataFrame, ledger: DataFrame | None = None, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Secrets of every version. ``ledger`` and ``known`` are the pairs and findings of
    earlier runs. Empty tables give empty results; other columns are not read."""
    findings, _ = scan_increment(versions, ledger, rules, rule_version)
    if known is not None:
        findings = findings.unionByName(known.filter(F.col("rule_version") == rule_version))
    return report(versions, findings, rules)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_into(versions: DataFrame, store: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """``report`` of ``versions``, with the ledger and the findings kept in the folder ``store``
    from run to run: only blobs that no run with these rules has seen are scanned.

    Findings are appended before the ledger, so a run that breaks off between the two
    scans its blobs again; the findings that then come twice count once.
    """
    spark = versions.sparkSession
    ledger, known = (stored(spark, f"{store}/{name}", schema) for name, schema in (("ledger", LEDGER), ("findings", FINDINGS)))
    todo = stash(unseen(versions, ledger, rule_version), "unseen")
    scan(todo, rules, rule_version).write.mode("append").parquet(f"{store}/findings")
    todo.select("blob", F.lit(rule_version).alias("rule_version")).distinct().write.mode("append").parquet(f"{store}/ledger")
    known = stored(spark, f"{store}/findings", FINDINGS).filter(F.col("rule_version") == rule_version).distinct()
    return report(versions, known, rules)
