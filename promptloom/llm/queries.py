"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm import bpecount, decontam, exact, jaccard, mixing, secrets, subtrees, sufarr, toxicity, urltree
from promptloom.llm.common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.url_filter(read(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents")).drop(jaccard.IDENTITY)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = subtrees.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def vocabulary_path() -> str:
    """The public vocabulary file that op6 counts with; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.token_counts(read(spark, sf_dir, "documents"), vocabulary_path())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sufarr.remove_strings(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PEM = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 'assign' AS kind, 0 AS place, 12 AS least, string_split_regex(t, '{_ASSIGN}') AS pieces, regexp_extract_all(t, '{_ASSIGN}', 0) AS matches, regexp_extract_all(t, '{_ASSIGN}', 1) AS secrets FROM d
  UNION ALL SELECT doc_id, 'access', 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 16, string_split_regex(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+', 0), regexp_extract_all(t, '[0-9a-f]+', 0) FROM d
  UNION ALL SELECT doc_id, 'pem', 3, 0, string_split_regex(t, '{_PEM}'), regexp_extract_all(t, '{_PEM}', 0), regexp_extract_all(t, '{_PEM}', 0) FROM d
),
each AS (SELECT doc_id, kind, place, least, unnest(pieces[1:len(matches)]) AS piece, unnest(matches) AS m, unnest(secrets) AS secret, unnest(range(len(matches))) AS i FROM found WHERE len(matches) > 0),
ended AS (SELECT *, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM each),
spans AS (SELECT doc_id, kind, place, stop - length(m) AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span FROM ended WHERE length(secret) >= least),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY start, place) FILTER (kind <> 'pem') AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '{_TERM}') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, w[s:s + least(10, len(w)) - 1] AS words, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
),
doc_windows AS (
  SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, s, size, item_id FROM doc_windows JOIN item_windows USING (phrase, size)),
words_hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id),
items_hit AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id),
-- proximity: all terms of a window within 20 words of one posting of its rarest term
tokens AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
counts AS (SELECT term, count(*) AS n FROM tokens GROUP BY term),
window_terms AS (SELECT phrase, unnest(words) AS term, unnest(range(size)) AS place FROM (SELECT DISTINCT phrase, words, size FROM item_windows)),
rarest AS (
  SELECT phrase, term FROM (SELECT phrase, term, row_number() OVER (PARTITION BY phrase ORDER BY coalesce(n, 0), place) AS r FROM window_terms LEFT JOIN counts USING (term)) WHERE r = 1
),
places AS (SELECT phrase, doc_id, pos AS at_pos FROM rarest JOIN tokens USING (term)),
near AS (
  SELECT p.phrase, p.doc_id FROM places p JOIN (SELECT DISTINCT phrase, term FROM window_terms) w ON p.phrase = w.phrase
  JOIN tokens t ON t.doc_id = p.doc_id AND t.term = w.term AND abs(t.pos - p.at_pos) <= 20
  GROUP BY p.phrase, p.doc_id, p.at_pos
  HAVING count(DISTINCT w.term) = (SELECT len(list_distinct(string_split(p.phrase, ' '))))
),
items_near AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM near JOIN item_windows USING (phrase)) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_ids, '')) AS near_sha256
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id) LEFT JOIN items_near USING (doc_id)
"""

_SHAPE = r"regexp_replace(x, '^([0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}-[0-9]{2})((\.[a-z]{2,5})?)$', '*\2')"


OP3_SQL = rf"""
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(ruled, rhost, rpath)),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(ruled, length(rhost || rpath)) AS ruled FROM hp JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
j AS (SELECT hp.*, rule, ruled, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {_SHAPE}) AS shape FROM hp LEFT JOIN fit USING (page_id)),
t AS (
  SELECT host, shape, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labelled, []::VARCHAR[] AS steps, 0 AS level FROM j GROUP BY host, shape
  UNION ALL
  SELECT host, shape, blocked, labelled, list_append(steps, CASE WHEN children > 16 THEN '*' ELSE shape[level + 1] END), level + 1
  FROM (SELECT *, count(DISTINCT shape[level + 1]) OVER (PARTITION BY host, steps) AS children FROM t WHERE len(shape) > level)
),
tree AS (SELECT host, shape, steps, blocked, labelled FROM t WHERE level = len(shape)),
leaf AS (SELECT host, steps, sum(blocked)::DOUBLE AS b, sum(labelled)::DOUBLE AS n FROM tree GROUP BY host, steps),
above AS (SELECT host, steps, b, n, k AS level, list_append(steps, '')[1:k] AS node FROM (SELECT *, unnest(range(0, len(steps) + 2)) AS k FROM leaf)),
nodes AS (SELECT host, level, node, sum(b) AS b, sum(n) AS n, CASE WHEN level > 0 THEN node[1:level - 1] END AS parent FROM above GROUP BY host, level, node),
siblings AS (SELECT *, sum(b) OVER family AS pb, sum(n) OVER family AS pn, count(*) OVER family AS children FROM nodes WHERE level > 0 WINDOW family AS (PARTITION BY host, parent)),
m AS (SELECT *, CASE WHEN n > 0 AND pn > n THEN abs(b / n - (pb - b) / (pn - n)) <= 1.96 * sqrt(pb / pn * (1 - pb / pn) * (1 / n + 1 / (pn - n))) ELSE false END AS alike FROM siblings WHERE children > 1),
g AS (
  SELECT host, node, CASE WHEN alike THEN sum(b) FILTER (alike) OVER (PARTITION BY host, parent) ELSE b END AS gb, CASE WHEN alike THEN sum(n) FILTER (alike) OVER (PARTITION BY host, parent) ELSE n END AS gn FROM m
  UNION ALL SELECT host, node, b, n FROM nodes WHERE level = 0
),
prior AS (SELECT coalesce(sum(b) / nullif(sum(n), 0), 0) AS prior FROM leaf),
chain AS (SELECT a.host, a.steps, list({{'b': gb, 'n': gn}} ORDER BY level) AS chain FROM above a JOIN g ON a.host = g.host AND a.node = g.node GROUP BY a.host, a.steps),
purity AS (SELECT host, steps, list_reduce(list_prepend({{'b': prior, 'n': 0.0}}, chain), lambda p, x: {{'b': (x.b + 4.0 * p.b) / (x.n + 4.0), 'n': 0.0}}).b AS purity FROM chain CROSS JOIN prior)
SELECT page_id, j.host AS host, path, rule, coalesce(ruled, CASE WHEN purity.purity >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN len(tree.steps) > 0 THEN '/' ELSE '' END || array_to_string(tree.steps, '/') AS template, round(purity.purity, 6) AS purity
FROM j JOIN tree ON j.host = tree.host AND j.shape = tree.shape JOIN purity ON purity.host = tree.host AND purity.steps = tree.steps
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, source_size * 3.0::DOUBLE AS cap, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
-- the water level: of each source's own level (those with a lower cap/weight clamped), the first under which it fits
level AS (
  SELECT a.source, a.cap / a.weight AS fill, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(b.cap) FILTER (b.cap / b.weight < a.cap / a.weight), 0)) / sum(b.weight) FILTER (b.cap / b.weight >= a.cap / a.weight) AS surface
  FROM w a CROSS JOIN w b GROUP BY a.source, a.cap, a.weight
),
water AS (SELECT arg_min(surface, fill) AS surface FROM level WHERE surface <= fill),
t AS (SELECT source, source_size, least(cap, weight * (SELECT surface FROM water)) AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
o AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.times, round(r.target)::BIGINT - r.times * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (times * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_exact_dedup": op7_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_mixing": op9_mixing,
}
ORACLES: dict[str, str] = {"op1_secret_scans": OP1_SQL, "op2_benchmark_decontamination": OP2_SQL, "op3_url_filters": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_mixing": OP9_SQL}
