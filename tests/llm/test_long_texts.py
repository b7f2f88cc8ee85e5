"""Texts of a megabyte and more, and texts with very many matches."""

import base64
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers
    import tiktoken
    from plumbline.llm.bpe import _Encoder

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _Encoder(path, public_tokenizers.PATTERN), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(encoders, text):
    mine, theirs = encoders
    ((ids, decoded),) = mine([text])
    return decoded == text.encode() and np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text)


@pytest.mark.parametrize("kind", ["letters", "digits", "ideographs"])
def test_very_long_pieces(encoders, kind):
    rng = random.Random(kind)
    one = {"letters": lambda: rng.choice(LETTERS), "digits": lambda: rng.choice("0123456789"), "ideographs": lambda: chr(rng.randrange(0x4E00, 0x9FA5))}[kind]
    assert same(encoders, "".join(one() for _ in range({"letters": 1_000_000, "digits": 300_000, "ideographs": 100_000}[kind])))


@pytest.mark.parametrize("unit", ["a", "0", "-", "=-", "abc", "abcdefg", " ", "\n", "é", "日本", "***", "#$%", "the", "aab"])
@pytest.mark.parametrize("start", ["", "b", "xyz"])
def test_runs_whose_period_does_not_fit(encoders, unit, start):
    assert same(encoders, start + unit * (12_000 // len(unit)))


def test_pieces_of_every_length_around_the_window(encoders):
    rng = random.Random(2)
    words = ["the", "ing", "tion", "er", "un", "ly", "q", "zz", "ness"]
    for n in [1000, 1023, 1024, 1025, 1026, 1063, 1064, 1065, 1100, *(rng.randrange(1025, 9000) for _ in range(25))]:
        text = "".join(rng.choice(words) for _ in range(n))[:n]
        assert same(encoders, text) and same(encoders, "x " + text + " y" * 3 + "!" * n)


def test_long_pieces_are_not_kept(encoders):
    mine = encoders[0]
    list(mine(["w" * 50_000, "short words"]))
    assert max(map(len, mine.words)) < 2000 and max(map(len, mine.pieces)) < 2000


def test_many_matches_of_one_text(spark):
    from plumbline.llm.pii import find_personal_data, sanitised

    n = 100_000
    mails, hosts = [f"a{i}@b.cd" for i in range(n)], [f"10.{i % 256}.{i // 256 % 256}.7" for i in range(n)]
    df = spark.createDataFrame([(1, " ".join(mails)), (2, "é ".join(hosts))], "doc_id long, text string")
    began = time.time()
    out = find_personal_data(df).select("row.doc_id", F.col("found.start").alias("start"), F.col("found.end").alias("end"), sanitised(F.col("row.text"), F.col("found")).alias("text"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert time.time() - began < 120
    for i, parts, gap, tag in ((1, mails, " ", "[EMAIL]"), (2, hosts, "é ", "[IP]")):
        assert got[i]["text"] == gap.join([tag] * n)
        ends = np.cumsum([len(p) + len(gap) for p in parts]) - len(gap)
        assert got[i]["end"] == ends.tolist() and got[i]["start"] == (ends - [len(p) for p in parts]).tolist()


def test_touched_words_and_contexts_keep_their_places(spark):
    """Masks against a plain version, with matches beside words, beside each other and inside each other."""
    import re

    from plumbline.llm.pii import MASK, _masked, base_spans

    texts = ["mail abc@d.efg, and x9@y.z.co+49 123 456 789abc def", "ipéé10.0.0.1éé.10.0.0.300 4111 1111 1111 1111word tail", "+1 (264) 555-5961 10.1.2.3@a.bc +4915112345678end", "a@b.c" * 50 + "é" * 3000 + " 1.2.3.4", "one\x01two 1.2.3.4three four", "😀x 1.2.3.4 y😀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", base_spans(F.col("t")).alias("b"))
    for r in df.select("t", "b", _masked(F.col("t"), F.col("b")).alias("m")).collect():
        t = r["t"].replace(MASK, " ")
        held = np.zeros(len(t) + 2, bool)
        for s in r["b"]:
            held[s["start"] + 1 : s["end"] + 1] = True
        want = [" "] * len(t)
        for w in re.finditer(r"[^\W\d_]+", t):
            touched = held[w.start() : w.end() + 2].any()
            want[w.start() : w.end()] = MASK * len(w[0]) if touched else w[0]
        assert len(r["m"]) == len(t)
        assert [x for x in re.split(r"[^\w\x01]+|[\d_]", r["m"]) if x and MASK not in x] == [x for x in "".join(want).replace(MASK, " ").split(" ") if x]


def test_other_operators_on_texts_of_a_megabyte(spark):
    from plumbline.llm.lm import language_model_scores
    from plumbline.llm.minhash import near_duplicates
    from plumbline.llm.quality_classifier import text_features
    from plumbline.llm.quality_rules import quality_rules
    from plumbline.llm.secrets import scan_secrets

    texts = ["w" * 600_000, "x" * 300_000 + "@" + "y" * 300_000 + ".com", " ".join(f"10.0.{i % 256}.{i % 99}" for i in range(50_000)), " ".join(f"token=abc{i}def" for i in range(30_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    assert scan_secrets(df).count() == 4 and near_duplicates(df).count() == 4 and language_model_scores(df).count() == 4
    assert quality_rules(df, df.limit(0).select("doc_id")).count() == 4 and np.isfinite(text_features(pa.array(texts))).all()
