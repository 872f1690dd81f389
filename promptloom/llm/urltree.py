"""URL filters from a path-template tree, in DataFrame operations.

Every url is judged first by host/path rules. The urls a rule settles are the
labelled ones. Per host, paths become templates: segments that look like ids, and
segments of a place in the tree with many different values, turn into wildcards.

Branches are merged at every level: of the children of a node, those whose subtrees'
labelled block rate does not differ from their siblings' by ``Z`` standard errors share
their counts. A node that is an only child is one with its parent. A template's purity
(block rate) is read from the root down: each branch's rate, with the counts it shares,
smoothed by that of the branch above, the root's by the overall rate. A template is
rejected if its purity reaches a threshold; one without labels stands where the branch
above it does.

All tree work runs on one row per (host, shape of path), aggregated beforehand, so a
host with a third of all pages is no larger than its number of path shapes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import ASCII_LOWER, ASCII_UPPER, stash


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: A segment of one of these shapes is variable: digits, long hexadecimal, with or without an extension.
VARIABLE = r"^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}-[0-9]{2})((\.[a-z]{2,5})?)$"
#: Levels of the tree between two written tables.
LEVELS = 3
MAX_CHILDREN = 16
SMOOTHING = 4.0
THRESHOLD = 0.5
Z = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first :// and /, ?, # or the end, A-Z lower-cased; path: from there
    to ?, # or the end. Both are empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: Sequence[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """Segments of the path with variable ones as '*'."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(s, VARIABLE, "*$2"))


def template_tree(shapes: DataFrame, levels: int = LEVELS, max_children: int = MAX_CHILDREN) -> DataFrame:
    """``shapes`` (host, shape, blocked, labelled) with ``path``, the segments of its template:
    level by level, places with more than ``max_children`` different segments become
    wildcards. Goes on until no shape has a segment left; a shape that is alone at its
    place has no siblings further down and ends there, with the rest as one segment."""
    columns = [*shapes.columns, "path"]
    tree, level, done = stash(shapes.withColumn("path", F.array().cast("array<string>")), "urltree"), 0, []
    while True:
        done.append(tree.filter(F.size("shape") <= level).select(columns))
        tree = tree.filter(F.size("shape") > level)
        if not tree.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        for at in range(level, level + levels):
            segment = F.get("shape", F.lit(at))
            children = tree.groupBy("host", "path").agg(F.count_distinct(segment).alias("children"))
            step = F.when(F.col("children") > max_children, F.lit("*")).otherwise(segment)
            tree = tree.join(children, ["host", "path"]).withColumn("path", F.when(segment.isNull(), F.col("path")).otherwise(F.array_append("path", step))).drop("children")
        level += levels
        alone = tree.filter(F.size("shape") > level).groupBy("host", "path").agg((F.count("*") == 1).alias("alone"))
        rest = F.array_append("path", F.array_join(F.slice("shape", level + 1, F.size("shape")), "/"))
        tree = stash(tree.join(alone, ["host", "path"], "left").withColumn("alone", F.col("alone") & (F.size("shape") > level)).withColumn("path", F.when(F.col("alone"), rest).otherwise(F.col("path"))), "urltree")
        done.append(tree.filter("alone").select(columns))
        tree = tree.filter(~F.coalesce("alone", F.lit(False))).select(columns)


def template_purity(tree: DataFrame, smoothing: float = SMOOTHING, z: float = Z) -> DataFrame:
    """host, path, purity of the templates of a tree."""
    leaves = stash(tree.groupBy("host", "path").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n")), "templates")
    total = leaves.agg(F.coalesce(F.sum("b") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("prior"))  # one row
    # each leaf hangs by an end mark below its last segment, where longer paths may go on
    steps = F.array_append("path", F.lit(""))
    up = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("level"), F.slice(steps, F.lit(1), k).alias("node")))
    above = stash(leaves.select("host", "path", "b", "n", F.inline(up)), "branches")
    nodes = above.groupBy("host", "level", "node").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    parent = F.when(F.col("level") > 0, F.slice("node", F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))))
    nodes = stash(nodes.withColumn("parent", parent), "nodes")
    families = nodes.filter("level > 0").groupBy("host", "parent").agg(F.sum("b").alias("pb"), F.sum("n").alias("pn"), F.count(F.lit(1)).alias("children")).filter("children > 1")
    rate = F.col("pb") / F.col("pn")
    spread = F.sqrt(rate * (1 - rate) * (1 / F.col("n") + 1 / (F.col("pn") - F.col("n"))))
    apart = F.abs(F.col("b") / F.col("n") - (F.col("pb") - F.col("b")) / (F.col("pn") - F.col("n")))
    similar = F.when((F.col("n") > 0) & (F.col("pn") > F.col("n")), apart <= z * spread).otherwise(F.lit(False))
    marked = stash(nodes.join(families, ["host", "parent"]).withColumn("similar", similar), "siblings")
    merged = marked.filter("similar").groupBy("host", "parent").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn"))
    shared = marked.join(merged, ["host", "parent"], "left").select("host", "node", F.when(F.col("similar"), F.col("sb")).otherwise(F.col("b")).alias("gb"), F.when(F.col("similar"), F.col("sn")).otherwise(F.col("n")).alias("gn"))
    root = nodes.filter("level = 0").select("host", "node", F.col("b").alias("gb"), F.col("n").alias("gn"))
    chain = above.select("host", "path", "level", "node").join(root.unionByName(shared), ["host", "node"]).groupBy("host", "path").agg(F.array_sort(F.collect_list(F.struct("level", "gb", "gn"))).alias("chain"))  # as long as the path
    down = F.aggregate("chain", F.col("prior"), lambda p, x: (x["gb"] + F.lit(smoothing) * p) / (x["gn"] + F.lit(smoothing)))
    return chain.join(F.broadcast(total)).select("host", "path", down.alias("purity"))


def url_filter(pages: DataFrame, rules: Sequence[UrlRule] = RULES, levels: int = LEVELS, max_children: int = MAX_CHILDREN, smoothing: float = SMOOTHING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row of ``pages``.

    Null urls and urls without :// have empty host and path and are judged together.
    Rows that repeat are judged alike. An empty table gives an empty result. Other
    columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parsed.withColumn("rule", by_rule(F.col("host"), F.col("path"), rules, lambda r: r.text)).withColumn("ruled", by_rule(F.col("host"), F.col("path"), rules, lambda r: r.verdict)).withColumn("shape", shape(F.col("path")))
    shapes = judged.groupBy("host", "shape").agg(F.count_if(F.col("ruled") == "block").alias("blocked"), F.count("ruled").alias("labelled"))
    tree = stash(template_tree(shapes, levels, max_children), "templates")
    known = tree.select("host", "shape", F.col("path").alias("steps")).join(template_purity(tree, smoothing).withColumnRenamed("path", "steps"), ["host", "steps"])
    known = known.withColumn("template", F.concat(F.when(F.size("steps") > 0, "/").otherwise(F.lit("")), F.array_join("steps", "/")))
    return judged.join(known, ["host", "shape"]).select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
