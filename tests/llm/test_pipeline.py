"""The stages, each against what its own operator decides on the stage's input."""

import corpus_pipeline
from plumbline.llm.common import connected_components, materialise, table


def test_stages(spark, sf_dir):
    from plumbline.llm.minhash import near_duplicates
    from plumbline.llm.pii import base_spans
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf_dir), name)
        kept.append((name, docs.select("doc_id").distinct().count()))
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "minhash_near_dedup":
            assert docs.count() == near_duplicates(before).select("component_id").distinct().count()
            assert near_duplicates(docs).where("not kept").count() == 0
        if name == "pii":
            assert docs.count() == before.count()
            assert docs.where(F.size(base_spans(F.col("text"))) > 0).count() == 0
            same = docs.join(before.withColumnRenamed("text", "old"), "doc_id")
            assert same.where("text <> old AND NOT contains(text, '[')").count() == 0
    assert [n for n, _ in kept] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "pii", "best_fit_packing"]
    counts = [n for _, n in kept]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 0
    assert docs.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, base string, row string, m long"


def _odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns that have helpers' names."""
    plain = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    rest = ("en", "s", 1, True, 0.5, "b", "r", 1)
    rows = [(1, plain(1), *rest), (1, plain(1), *rest), (1, plain(2), *rest), (2, plain(1) + " mail a.b@c.example.com", *rest), (None, plain(3), *rest), (None, plain(3), *rest), (3, None, *rest), (4, "", *rest), (5, "word " * 20000, *rest), (6, plain(6), *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_stages_on_odd_rows(spark, sf_dir):
    docs = _odd(spark)
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    ruled = stages["quality_rules"](spark, docs, sf_dir)
    assert ruled.columns == docs.columns and ids(ruled.where("text is null or text = '' or text like 'word word%'")) == []
    assert ids(stages["quality_classifier"](spark, docs, sf_dir)) is not None
    apart = stages["minhash_near_dedup"](spark, docs, sf_dir)
    # one of the copies of the first text (id 1 or 2), the second text of id 1, the null id, the two without words, 5 and 6
    assert apart.columns == docs.columns and ids(apart) == ["1", "1", "3", "4", "5", "6", "None"]
    clean = stages["pii"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and ids(clean) == ids(docs)
    assert clean.where("text like '%@%'").isEmpty() and clean.where("doc_id = 3 and text is null").count() == 1
    packed = stages["best_fit_packing"](spark, docs, sf_dir)
    assert set(ids(packed)) == set(ids(docs))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}
