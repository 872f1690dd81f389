import pytest

from compare import same_rows

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    from promptloom.llm import queries as q

    for name, sql in q.ORACLES.items():
        same_rows(q.QUERIES[name](spark, SF), sql, SF)


def test_eleven_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as c
    from promptloom.llm import decontam, exact, jaccard
    from promptloom.llm.common import DOCUMENT_COLUMNS, read

    docs = read(spark, SF, "documents").select(*DOCUMENT_COLUMNS)
    stages = dict(c.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram jaccard join", "benchmark decontamination", "mixing to target weights"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == list(DOCUMENT_COLUMNS) and 0 < clean.count() <= docs.count()
    once = stages["exact dedup"](spark, docs, SF)
    best = {}
    for r in docs.collect():
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(best.values()) == {r.doc_id for r in exact.exact_dedup(docs).filter("kept").collect()}
    groups = {r.doc_id: r.class_id for r in jaccard.jaccard_join(docs).collect()}
    assert {r.doc_id for r in stages["n-gram jaccard join"](spark, docs, SF).collect()} == set(groups.values())
    dirty = {r.doc_id for r in decontam.decontaminate(docs, read(spark, SF, "benchmark")).filter("contaminated").collect()}
    assert {r.doc_id for r in stages["benchmark decontamination"](spark, docs, SF).collect()} == set(groups) - dirty
    mixed = stages["mixing to target weights"](spark, docs, SF)
    assert mixed.filter("taken <= 0").count() == 0 and set(DOCUMENT_COLUMNS) < set(mixed.columns)


@pytest.mark.parametrize("name", ["pipeline"])
def test_runs(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, SF).count() > 0


LABELS = "doc_id long, quality int, toxic int"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Documents with nulls in every column, rows that repeat, empty and long texts, and
    further columns with names that stages use."""
    words = [f"w{i * 7 % 311}" for i in range(120)]
    near = " ".join([*words[:60], "other", *words[61:]])
    rows = [(1, " ".join(words), "en", "a", 5), (2, near, "en", "a", 5), (3, " ".join(words), None, None, None), (3, " ".join(words), None, None, None), (None, "no id here", "en", "b", 1), (None, "no id here", "en", "b", 1), (4, "", "en", "b", 0), (5, None, "en", "b", None), (6, "the exam phrase of this very test is right here", "en", "b", 9), (7, "z" * 60_000, "en", "c", 60_000), (8, "a b " * 15_000, "en", "c", 60_000), (9, "horrible gnarx words gnarx", "en", "c", 4)]
    df = spark.createDataFrame(rows, COLUMNS)
    return df.selectExpr("*", "1 AS score", "2 AS digest", "3 AS id", "4 AS print", "5 AS taken", "6 AS size", "7 AS target", "8 AS toxic", "9 AS doc", "'x' AS words")


def tables(spark, tmp_path, docs, labels=(), items=()):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline as c

    labels = [(1, 1, 0), (2, 1, 0), (9, 0, 1), (None, 1, 1), (7, None, None), (4, 1, 0), (99, 1, 1)]
    sf = tables(spark, tmp_path, awkward(spark), labels, [(1, "exam phrase of this very test"), (2, None), (3, "")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    got = {name: stage(spark, docs, sf) for name, stage in c.STAGES}
    for name in list(got)[:-1]:
        assert got[name].columns == list(c.DOCUMENT_COLUMNS), name
    assert set(ids(got["toxicity"])) <= set(ids(docs)) and got["toxicity"].count() <= n
    # equal texts: 1 and 3 (3 stays), the two without ids, 4 and 5 (5 stays)
    assert ids(got["exact dedup"]) == [0, 2, 3, 5, 6, 7, 8, 9]
    # 1, 2 and 3 are linked (1 stays); the rows without id repeat
    assert ids(got["n-gram jaccard join"]) == [0, 0, 1, 4, 5, 6, 7, 8, 9]
    assert ids(got["benchmark decontamination"]) == ids(docs.filter("doc_id is null or doc_id <> 6"))
    mixed = got["mixing to target weights"]
    assert mixed.filter("taken <= 0").count() == 0 and not {4, 5} & set(ids(mixed)) and set(mixed.columns) == {*c.DOCUMENT_COLUMNS, "size", "target", "taken"}
    assert 0 < c.run(spark, sf).count() <= 7


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    sf = tables(spark, tmp_path, awkward(spark).limit(0))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in c.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
    assert c.run(spark, sf).count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    import re

    import corpus_pipeline as c
    from promptloom.llm.common import DOCUMENT_COLUMNS, read

    docs = read(spark, SF, "documents").select(*DOCUMENT_COLUMNS)
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^ \t-\r]+", r.text or "")
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, b in enumerate(ids):
        for a in ids[:k]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {r.doc_id for r in dict(c.STAGES)["n-gram jaccard join"](spark, docs, SF).collect()}
    assert kept == {i for i in ids if find(i) == i}


def test_toxicity_and_mixing_stages_against_plain_rules(spark):
    import re
    from collections import Counter

    import corpus_pipeline as c
    from promptloom.llm import mixing, toxicity
    from promptloom.llm.common import DOCUMENT_COLUMNS, read

    docs, labels = read(spark, SF, "documents").select(*DOCUMENT_COLUMNS), read(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    import pyarrow as pa

    rows = docs.collect()
    score = toxicity.scores(model, pa.array([r.text for r in rows], pa.string()))
    kept = {r.doc_id for r in dict(c.STAGES)["toxicity"](spark, docs, SF).collect()}
    assert kept == {r.doc_id for r, s in zip(rows, score, strict=True) if s < toxicity.LINE}
    size = {r.doc_id: len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in rows}
    taken, sources = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}, Counter()
    mixed = dict(c.STAGES)["mixing to target weights"](spark, docs, SF).collect()
    assert {r.doc_id: r.taken for r in mixed} == {i: t for i, t in taken.items() if t > 0}
    for r in mixed:
        assert 0 < r.taken <= 3 * size[r.doc_id] and r.size == size[r.doc_id]
        sources[r.source] += r.taken
    target = {r.source: r.target for r in mixed}
    assert all(abs(sources[s] - t) <= 1 for s, t in target.items())
