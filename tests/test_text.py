import pytest
from plumbline.functions import text as tx
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "expected"), [("1.234,5", 1234.5), ("214.7", 214.7), ("", None), (None, None), ("0x10", 16.0), ("1d", None), ("Infinity", None), ("1e3", 1000.0), ("  7 ", 7.0), ("1,2,3", None)])
def test_parse_number(spark, value, expected):
    assert one(spark, tx.parse_number, value) == expected


@pytest.mark.parametrize(("value", "expected"), [(0.25, "0,3"), (2.45, "2,5"), (1234.55, "1.234,6"), (-0.04, "-0,0"), (None, "-"), (float("nan"), "-"), (float("inf"), "-")])
def test_number_text(spark, value, expected):
    assert one(spark, tx.number_text, value, "double") == expected


@pytest.mark.parametrize(("value", "digits", "expected"), [(30.849999999999998, 1, "30,9"), (27.7 - 21.25, 1, "6,5"), (-30.849999999999998, 1, "-30,9"), (-0.0, 1, "-0,0"), (21.34, 1, "21,3"), (2.675, 2, "2,68"), (9.5, 0, "10"), (1e15 + 0.5, 1, "1.000.000.000.000.000,5"), (1e300, 0, None)])
def test_number_text_of_sums(spark, value, digits, expected):
    """Means and differences are half-up although their additions end just below the half."""
    text = one(spark, lambda x: tx.number_text(x, digits), value, "double")
    assert text == expected if expected else len(text) == 401


def test_signed_and_plain_numbers(spark):
    assert one(spark, tx.signed_text, 3.0, "double") == "+3,0"
    assert one(spark, tx.signed_text, -3.0, "double") == "-3,0"
    assert one(spark, tx.plain_number, 200.0, "double") == "200"


def test_search_keys_differ_on_inner_space(spark):
    assert one(spark, tx.search_key, "  ESCOLA  MUNICÍPAL   ") == "escola  municipal"
    assert one(spark, tx.catalog_key, "  São\n Paulo ") == "sao paulo"
    assert one(spark, tx.catalog_key, "ß º ñ Å") == "ß º n a"


def test_damaged_text_is_restored_longest_first(spark):
    assert one(spark, tx.clean_text, " MANH� ") == "MANHÃ"
    assert one(spark, tx.clean_text, "5� Ano") == "5º Ano"
    assert one(spark, tx.clean_text, None) == ""


@pytest.mark.parametrize(("value", "text", "year"), [("Matemática 8º ano", "matematica", "8º ano"), ("9 ano e 6o ano", "e", "9º ano"), ("5º ano", "5º ano", None), ("", "", None), ("x8 ano", "x8 ano", None)])
def test_parse_query(spark, value, text, year):
    assert tx.parse_query(value) == tx.ParsedQuery(text, year)
    assert one(spark, tx.parsed_grade, value) == year


def test_lines_and_headers(spark):
    assert one(spark, tx.clean_lines, " a  b\n\n c­d ") == "a b cd"
    assert one(spark, lambda x: tx.clean_lines(x, True), " a  b\n\n c ") == "a b\nc"
    assert one(spark, tx.without_running_header, "12\nA\nB\nbody") == "body"
    assert one(spark, tx.without_running_header, "body\nmore") == "body\nmore"


def test_labels(spark):
    row = spark.createDataFrame([("N", "R", "", "9")], "n string, r string, g string, u string")
    assert row.select(tx.unit_label(F.col("n"), F.col("r"), F.col("g"), F.col("u")).alias("y")).first()["y"] == "N — R — Cód. 9"
    assert one(spark, tx.slug, "Língua Inglesa!") == "lingua-inglesa"
    assert one(spark, tx.csv_cell, 'a"b') == '"a""b"'
    assert one(spark, tx.csv_cell, None) == '""'


def test_folding_agrees_on_every_code_point(spark):
    """The key of a text holds the key of the same text as a literal; the literal's own folding differs only where Unicode versions do."""
    import unicodedata as u

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"x{chr(c)}y") for c in points], "c int, t string")
    out = df.select("c", "t", tx.catalog_key(F.col("t")).alias("k"), tx.composed(F.col("t")).alias("n"), tx.decomposed(F.col("t")).alias("d"), tx.search_key(F.col("t")).alias("s"))
    assert out.where("k is null").count() == 0
    rows = out.collect()
    old = {r["c"] for r in rows if u.category(chr(r["c"])) != "Cn"}
    assert all(r["n"] == u.normalize("NFC", r["t"]) and r["d"] == u.normalize("NFD", r["t"]) for r in rows if r["c"] in old)
    assert all(r["k"] == tx.fold(r["t"]) and r["s"] == tx.search_fold(r["t"]) for r in rows if r["c"] in old)
    twice = spark.createDataFrame([(tx.fold(r["t"]), r["k"]) for r in rows], "f string, k string")
    assert twice.where(tx.catalog_key(F.col("f")) != F.col("k")).count() == 0


def test_search_finds_accents_of_all_scripts(spark):
    df = spark.createDataFrame([("Việt Nam",), ("ΆΛΦΑ βήτα",), ("ё й",)], "t string")
    found = lambda q: [r["t"] for r in df.where(tx.holds(F.col("t"), tx.catalog_key, q)).collect()]
    assert found("Việt") == found("viet nam") == ["Việt Nam"]
    assert found("αλφα ΒΗΤΑ") == ["ΆΛΦΑ βήτα"] and found("е и") == ["ё й"]


@pytest.mark.parametrize(("value", "expected"), [(0.0005, "0.0005"), (12345678.0, "12345678"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (0.1 + 0.2, "0.30000000000000004"), (-2e-3, "-0.002"), (-0.0, "0"), (0.0, "0"), (2e23, "2e+23"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (None, None), (123456.789, "123456.789")])
def test_plain_numbers(spark, value, expected):
    assert one(spark, tx.plain_number, value, "double") == expected


@pytest.mark.parametrize(("value", "expected"), [("0X1f", 31.0), ("0b101", 5.0), ("0o17", 15.0), ("0x", None), ("-0x10", None), ("   ", 0.0), (" 7﻿", 7.0), ("0x10,5", None), ("1_0", None)])
def test_numbers_as_the_site_reads_them(spark, value, expected):
    assert one(spark, tx.parse_number, value) == expected


def test_natural_order(spark):
    given = ["Zebra", "Água", "Ensino 10", "Ensino 9", "ensino 9", "a 007", "a 7", "10º", "9º", "a 99999999999999999999999", "a 100000000000000000000000"]
    df = spark.createDataFrame([(x,) for x in given], "x string")
    assert [r["x"] for r in df.orderBy(tx.natural_order(F.col("x")), "x").collect()] == ["9º", "10º", "a 007", "a 7", "a 99999999999999999999999", "a 100000000000000000000000", "Água", "ensino 9", "Ensino 9", "Ensino 10", "Zebra"]
    assert [r["x"] for r in df.limit(4).orderBy(tx.collated(F.col("x"))).collect()] == ["Água", "Ensino 10", "Ensino 9", "Zebra"]


def test_lines_are_composed(spark):
    assert one(spark, tx.clean_lines, "é  \x1f a  b\r\nc") == "é a b c"
