"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, base string"
ROWS = [
    (1, "alpha beta gamma delta epsilon mail me at a.b@c.example.com or +1 (264) 555-5961 please " * 3, "en", "s1", 1, True, 0.5, "x"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "s1", 0, True, 0.5, "x"),
    (4, "   \n \t ", "en", "s2", 6, True, 0.5, "x"),
    (None, "token = abcdef0123456789abcdef0123456789 and é日本 words", "en", None, 1, None, None, None),
    (5, "word " * 30000, "en", "s1", 150000, True, 0.5, "x"),
    (6, "w" * 20000, "en", "s3", 20000, True, 0.5, "x"),
    (7, "same text here for both rows of one id", "en", "s1", 1, True, 0.5, "x"),
    (7, "same text here for both rows of one id", "en", "s1", 1, True, 0.5, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (6, 0), (None, 1), (99, 1), (7, None)], "doc_id long, quality int")


def _packing(docs, labels):
    import public_tokenizers
    from plumbline.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).groupBy("doc_id").agg(F.count("*"))


def _bpe(docs, labels):
    import public_tokenizers
    from plumbline.llm.bpe import encode_documents

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _pii(docs, labels):
    from plumbline.llm.pii import find_personal_data

    return find_personal_data(docs).select("row.*", "found")


def _secrets(docs, labels):
    from plumbline.llm.secrets import scan_secrets

    return scan_secrets(docs)


def _sharding(docs, labels):
    from plumbline.llm.sharding import shard_documents

    return shard_documents(docs, carry=["kept", "score"])


def _minhash(docs, labels):
    from plumbline.llm.minhash import near_duplicates

    return near_duplicates(docs)


def _rules(docs, labels):
    from plumbline.llm.quality_rules import quality_rules

    return quality_rules(docs, labels.where("quality = 1").select("doc_id")).select("row.doc_id", "kept", "n_words")


def _classifier(docs, labels):
    from plumbline.llm.quality_classifier import classify_quality

    return classify_quality(docs, labels).select("row.*", "predicted")


OPERATORS = [_packing, _bpe, _pii, _secrets, _sharding, _minhash, _rules, _classifier]


@pytest.mark.parametrize("operator", OPERATORS)
def test_every_row_comes_back(docs, labels, operator):
    out = operator(docs, labels).collect()
    ids = sorted(r[0] if operator is not _pii and operator is not _classifier else r["doc_id"] for r in out if r["doc_id"] is not None)
    assert ids == ([1, 2, 3, 4, 5, 6, 7] if operator is _packing else [1, 2, 3, 4, 5, 6, 7, 7])
    assert sum(r["doc_id"] is None for r in out) == 1


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_tables(docs, labels, operator):
    assert operator(docs.limit(0), labels.limit(0)).count() == 0


def test_vectors(spark):
    from plumbline.llm.embeddings import near_vectors

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 1), (10, [0.0, 1.0], 2), (11, [], 1)]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<float>, label int, kept boolean")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (9, 0, 9, True), (None, 0, None, False), (11, 0, 11, True)} <= got
    assert all(n == 0 and k for i, n, _, k in got if i in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_of_doubles_keep_their_digits(spark):
    """Two vectors whose cosine reaches 0.93 in double precision only, and one that stays just below."""
    import math

    from plumbline.llm.embeddings import near_vectors

    at = lambda c: [c, math.sqrt(1 - c * c)]
    rows = [(1, [1.0, 0.0], 1), (2, at(0.93 + 2e-12), 1), (3, [0.93 - 2e-12, -math.sqrt(1 - (0.93 - 2e-12) ** 2)], 1)]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in out} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_urls(spark):
    from plumbline.llm.url_filter import filter_captures

    pages = spark.createDataFrame([(1, "http://A.b.example.com/x/y", "2024-03-01"), (1, "http://A.b.example.com/x/y", "2024-03-01"), (2, "http://b.example.com", "2024-02-01"), (3, None, "2024-03-01"), (4, "nonsense", "2024-03-01"), (5, "http://b.example.com:80/", None), (None, "https://u@b.example.com?q", "2024-05-01")], "page_id long, url string, day string")
    entries = spark.createDataFrame([("l", "b.example.com", "2024-02-10", "add"), ("l", "b.example.com", "2024-02-20", "add"), ("l", "b.example.com", "2024-04-01", "remove"), ("m", "a.b.example.com/x", "2024-03-01", "add"), (None, "b.example.com", "2024-01-01", "add")], "list string, key string, day string, action string").withColumn("day", F.col("day").cast("date"))
    got = sorted(((r["page_id"] or 0, r["n_entries"], ",".join(r["lists"]), r["blocked"]) for r in filter_captures(pages, entries).collect()))
    assert got == [(0, 0, "", False), (1, 2, "l,m", True), (1, 2, "l,m", True), (2, 0, "", False), (3, 0, "", False), (4, 0, "", False), (5, 0, "", False)]
    assert filter_captures(pages.limit(0), entries).count() == 0
    assert filter_captures(pages, entries.limit(0)).where("blocked").count() == 0
