import pytest
from plumbline.operators import catalog as oc
from plumbline.operators import extract as ox
from plumbline.operators import validate as ov
from pyspark.sql import functions as F

RECORD = "code string, subject string, year string, years array<string>, unit string, object string, field string, area string, skills array<int>, text string, ord long"


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("EF07LP01", "LP", "7º ano", ["7º ano"], None, "o1", "Campo", None, [1], "Consciência  socioambiental.", 0),
        ("EF67LP01", "LP", "6º e 7º", ["6º ano", "7º ano"], None, "o2", "Campo", None, [2, 3], "Texto", 1),
        ("EF89LP01", "LP", "8º e 9º", ["8º ano", "9º ano"], None, "o1", None, None, [3], "Outro", 2),
        ("EF08MA01", "MA", "8º ano", ["8º ano"], "Números", "o1", None, None, None, "Calcular", 3),
    ]
    return spark.createDataFrame(rows, RECORD)


@pytest.mark.parametrize(("args", "codes"), [({"year": "7º ano"}, {"EF07LP01", "EF67LP01"}), ({"query": "CONSCIENCIA socio"}, {"EF07LP01"}), ({"query": "8º ano"}, {"EF89LP01", "EF08MA01"}), ({"query": "lp 8º ano"}, {"EF89LP01"}), ({"skill": "3"}, {"EF67LP01", "EF89LP01"}), ({"skill": "x"}, set()), ({"unit": "Campo", "obj": "o2"}, {"EF67LP01"}), ({"query": "zzz"}, set())])
def test_filters(records, args, codes):
    assert {r["code"] for r in records.where(oc.matches(**args)).collect()} == codes


def test_lookup_neighbours_related(records):
    assert oc.lookup(records, "ef08ma01").first()["subject"] == "MA"
    near = {r["code"]: (r["previous"], r["next"]) for r in oc.neighbours(records, ["subject"]).collect()}
    assert near["EF67LP01"] == ("EF07LP01", "EF89LP01") and near["EF08MA01"] == (None, None)
    same = oc.related_by_group(records.withColumn("g", oc.unit_of()), ["subject", "g"]).collect()
    assert {(r["code"], r["related"]) for r in same} == {("EF07LP01", "EF67LP01"), ("EF67LP01", "EF07LP01")}
    over = oc.related_by_overlap(records, ["subject"], "skills").collect()
    assert {(r["code"], r["related"]) for r in over} == {("EF67LP01", "EF89LP01"), ("EF89LP01", "EF67LP01")}


def test_routes_and_union(records):
    urls = {r["url"] for r in oc.routes(records, ["7º ano"]).collect()}
    assert urls == {"/lp", "/ma", "/lp/7-ano", "/c/ef07lp01", "/c/ef67lp01", "/c/ef89lp01", "/c/ef08ma01"}
    both = oc.union_records(records, records.select("code").limit(1))
    assert both.count() == 5 and both.where("source_no = 1").first()["text"] is None


def test_facets_order_numbers(spark):
    df = spark.createDataFrame([("10º",), ("9º",), ("",), (None,)], "v string")
    assert [r["value"] for r in oc.facet(df, F.col("v")).collect()] == ["9º", "10º"]


def test_rules_quarantine_and_status(spark):
    rows = spark.createDataFrame([("EF06MA01", "Ok.", 0), ("EF06MA01", "Ok.", 1), ("XX", "", 2), ("EF06MA03", "x2 sem ponto", 3), ("EF06MA04", "bad �.", 4)], "code string, text string, i int")
    rules = [*ov.required("text"), ov.pattern("code", "^EF06MA[0-9]{2}$"), ov.duplicates(["code"], ["i"]), ov.control_characters("text"), ov.final_punctuation("text"), ov.lost_superscript("text")]
    out = ov.checked(rows, rules)
    errors = {r["i"]: r["errors"] for r in out.collect()}
    assert errors == {0: [], 1: ["duplicate:code"], 2: ["required:text", "pattern:code"], 3: [], 4: ["control:text"]}
    assert {r["i"] for r in out.where(F.array_contains("warnings", "superscript:text")).collect()} == {3}
    gaps = ov.sequence_gaps(ov.accepted(out).withColumn("n", F.substring("code", 7, 2).try_cast("int")).withColumn("p", F.lit("a")), ["p"], "n")
    assert [r["missing"] for r in gaps.collect()] == [2]
    assert ov.status(out, gaps).first()["status"] == ov.REVIEW
    assert ov.status(out.where("i = 0")).first()["status"] == ov.VALID


def test_write_only_if_valid(spark, tmp_path):
    out = ov.checked(spark.createDataFrame([("a",), ("",)], "t string"), ov.required("t"))
    assert not ov.write_if_valid(out, None, f"{tmp_path}/d", f"{tmp_path}/r")
    assert not (tmp_path / "d").exists() and (tmp_path / "r").exists()
    assert ov.write_if_valid(out.where("t <> ''"), None, f"{tmp_path}/d", f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 1


def test_guarded_enrichment(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r["v"] for r in ov.guarded_enrichment(left, right, "k", "v").collect()} == {"a", "b"}
    assert {r["v"] for r in ov.guarded_enrichment(left.where("k = 1"), right, "k", "v").collect()} == {None}


def test_fill_asof_gaps(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (2, 3, None)], "s int, n int, u string")
    assert [r["f"] for r in ox.forward_fill(rows, ["s"], ["n"], F.nullif("u", F.lit("")), "f").orderBy("n").collect()] == ["a", "a", None]
    left, right = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "s int, t int"), spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "s int, t int, v string")
    got = lambda **k: [r["asof_v"] for r in ox.asof_backward(left, right, ["s"], "t", "v", **k).orderBy("t").collect()]
    assert got() == [None, "x", "y"] and got(clamp=True) == ["x", "x", "y"]
    isl = ox.gap_groups(spark.createDataFrame([(1, 0.0), (1, 18.0), (1, 40.0)], "s int, y double"), ["s"], "y", 18.0)
    assert [r["island"] for r in isl.orderBy("y").collect()] == [0, 0, 1]


def test_first_in_row_then_carry(spark):
    lines = spark.createDataFrame([(1, 1, 1, "A"), (1, 1, 2, "B"), (1, 2, 1, None), (1, 3, 1, "C")], "s int, r int, n int, v string")
    out = ox.first_in_row_then_carry(lines, ["s"], "r", ["n"], F.col("v"), "f").orderBy("r").collect()
    assert [x["f"] for x in out] == ["A", "B", "C"]


def test_intervals_segments_pages(spark):
    edges = ox.boundary_pairs(spark.createDataFrame([(1, 0.0), (1, 10.0), (1, 20.0)], "p int, y double"), ["p"], "y")
    assert {(r["top"], r["bottom"]) for r in edges.collect()} == {(0, 10), (10, 20)}
    inside = ox.in_intervals(spark.createDataFrame([(1, 10.0), (1, 20.0)], "p int, y double"), edges, ["p"], "y")
    assert [(r["top"], r["y"]) for r in inside.collect()] == [(10, 10)]
    seg = ox.segments(spark.createDataFrame([(1, "pre #A one #B two")], "k int, t string"), "k", "t", "#[A-Z]")
    assert [(r["heading"], r["body"]) for r in seg.orderBy("segment_no").collect()] == [("#A", " one "), ("#B", " two")]
    pages = spark.createDataFrame([(1, "u"), (2, "s"), (3, "v")], "page int, text string")
    assert [(r["page"], r["facing_text"]) for r in ox.facing_pages(pages, 1).collect()] == [(1, "s")]
    rules = ox.table_rules(spark.createDataFrame([(1, 0.0, 200.0, 300.001, 300.0), (1, 0.0, 50.0, 310.0, 310.0)], "page int, x0 double, x1 double, y0 double, y1 double"))
    assert [r["y"] for r in rules.collect()] == [300.0]


def test_matches_digits_corrections(spark):
    df = spark.createDataFrame([(1, "(EF01) um (EF02) dois")], "k int, t string")
    assert [(r["code"], r["body"]) for r in ox.all_matches(df, "t", r"\((EF[0-9]+)\) ([^(]*)", ["code", "body"]).collect()] == [("EF01", "um "), ("EF02", "dois")]
    assert spark.range(1).select(ox.digit_list(F.lit("3, 1 e 3")).alias("d")).first()["d"] == [1, 3]
    rules = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "y", "z")], "k string, seq int, old string, new string")
    assert {r["t"] for r in ox.corrected(spark.createDataFrame([("a", "x"), ("b", "x")], "k string, t string"), rules, "k", "t").collect()} == {"z", "x"}


def test_grades_of_codes(spark):
    from plumbline.operators.catalog import GRADE_KEYS, grade_label, grade_years, with_grades

    assert [grade_label(k) for k in ("01", "12", "35", "15", "67", "89", "69")] == ["1º ano", "1º e 2º ano", "3º ao 5º ano", "1º ao 5º ano", "6º e 7º ano", "8º e 9º ano", "6º ao 9º ano"]
    assert grade_years("35") == ["3º ano", "4º ano", "5º ano"] and len(GRADE_KEYS) == 15
    got = with_grades(spark.createDataFrame([("EF69LP01",), ("EFxxLP01",), (None,)], "code string")).select("code", "grade_label").collect()
    assert {r[0]: r[1] for r in got} == {"EF69LP01": "6º ao 9º ano", "EFxxLP01": None, None: None}


def test_edges_summary_and_checks(spark):
    from plumbline.operators import extract as ox
    from plumbline.operators import validate as ov

    edges = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "page int, y double")
    closing = spark.createDataFrame([(1, 15.0), (2, 9.0), (3, 9.0)], "page int, y double")
    assert sorted(map(tuple, ox.with_edges(edges, ["page"], "y", 0.0, closing).collect())) == [(1, 0.0), (1, 10.0), (1, 20.0), (2, 0.0), (2, 5.0), (2, 9.0)]
    rows = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "f string, g string")
    assert sorted(map(str, (tuple(r) for r in ov.summary(rows, ["f", "g"]).collect()))) == ["('f', 'a', 2)", "('g', 'x', 2)", "('total', None, 3)"]
    reports = spark.createDataFrame([("valido",), (None,)], "status string")
    assert ov.overall_status(reports).first()["status"] == ov.REVIEW and ov.overall_status(reports.limit(0)).first()["status"] == ov.VALID
    assert tuple(ov.distinct_check(rows, "g").first()) == (3, 2, False)
    numbers = spark.createDataFrame([(1,), (3,)], "n int")
    assert [r[0] for r in ov.fixed_range_gaps(numbers, "n", 4).orderBy("missing").collect()] == [2, 4]
    assert ov.fixed_range_gaps(numbers.limit(0), "n", 3).count() == 3


def test_forward_fill_skips_empty_text(spark):
    from plumbline.operators.extract import forward_fill
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, None), (2, 1, "")], "s int, n int, v string")
    assert [r["f"] for r in forward_fill(rows, ["s"], ["n"], F.col("v"), "f").orderBy("s", "n").collect()] == ["a", "a", "a", None]


def test_options_have_places(spark):
    df = spark.createDataFrame([("Ensino 10", "b"), ("Ensino 9", None), ("Água", ""), ("Zebra", "b"), ("Zebra", "a")], "v string, w string")
    got = oc.option_places(df, {"v": F.col("v"), "w": F.col("w")}).orderBy("facet", "place").collect()
    assert [(r["facet"], r["value"], r["place"]) for r in got] == [("v", "Água", 1), ("v", "Ensino 9", 2), ("v", "Ensino 10", 3), ("v", "Zebra", 4), ("w", "a", 1), ("w", "b", 2)]
    assert oc.option_places(df.limit(0), {"v": F.col("v")}).count() == 0


def test_gaps_beside_a_stray_number(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 4), ("a", 4), ("a", None), ("b", 2_000_000_000), ("b", 1_999_999_998), ("c", -3), ("d", None)], "p string, n int")
    assert sorted(map(tuple, ov.sequence_gaps(rows.where("p <> 'b'"), ["p"], "n").collect())) == [("a", 2), ("a", 3)]
    near = rows.where("p = 'b'").union(spark.range(1, 6).selectExpr("'b'", "cast(id as int)"))
    upto = ov.sequence_gaps(near, ["p"], "n", 7).collect()
    assert sorted(r["missing"] for r in upto) == [6, 7]
    assert sorted(map(tuple, ov.sequence_gaps(rows.where("p in ('a', 'c')"), ["p"], "n", 2).collect())) == [("a", 2), ("c", 1), ("c", 2)]


def test_numbers_once_years_and_digits(spark):
    rows = spark.createDataFrame([(0, 1, ["a"], "EF1"), (1, 1, ["b"], "EF2"), (2, 9, None, "EF9"), (3, None, ["a"], None)], "i int, n int, y array<string>, c string")
    out = ov.checked(rows, [*ov.numbered_once("n", 5, ["i"]), ov.array_equals("y", F.array(F.lit("a"))), ov.digit_equals("n", "c", 3)])
    assert {r["i"]: r["errors"] for r in out.collect()} == {0: [], 1: ["repeated:n", "years:y", "digit:n"], 2: ["number:n", "years:y"], 3: ["number:n", "digit:n"]}


def test_guard_runs_nothing_before_the_action(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (3, "b")], "k int, v string")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    plan = ov.guarded_enrichment(left, right, "k", "v")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == before
    assert {r["v"] for r in plan.collect()} == {None}


def test_rules_by_scope(spark):
    records = spark.createDataFrame([("a", "x1", 5), ("a", None, 5), ("b", "x1", 50), ("c", "zz", 1)], "s string, code string, n int")
    rows = [("a", 1, "code", "pattern", "code", ["^x[0-9]$"], "reject"), ("a", 2, "n", "between", "n", ["1", "10"], "warn"), ("b", 1, "n", "between", "n", ["1", "10"], "warn"), ("b", 2, "code", "known", "code", ["y"], "reject"), ("b", 0, "none", "required", "other", [], "reject")]
    schema = "scope string, seq int, rule string, kind string, column string, params array<string>, severity string"
    out = ov.rules_by_scope(records, spark.createDataFrame(rows, schema), "s", ["code", "n"])
    assert {(r["s"], r["code"]): (r["errors"], r["warnings"]) for r in out.collect()} == {("a", "x1"): ([], []), ("a", None): (["code"], []), ("b", "x1"): (["none", "code"], ["n"]), ("c", "zz"): ([], [])}
    assert out.columns == ["s", "code", "n", "errors", "warnings"]
    totals = {r["scope"]: (r["total"], r["rejected"], r["status"]) for r in ov.scope_totals(out, "s").collect()}
    assert totals == {"a": (2, 1, ov.REVIEW), "b": (1, 1, ov.REVIEW), "c": (1, 0, ov.VALID)}
    with pytest.raises(Exception, match="no such kind"):
        ov.rules_by_scope(records, spark.createDataFrame([("a", 1, "q", "magic", "code", [], "warn")], schema), "s", ["code"]).collect()


def test_publication_is_all_or_nothing(spark, tmp_path):
    from pyspark.sql.functions import udf

    good = ov.checked(spark.createDataFrame([("a",), ("b",)], "t string"), ov.required("t"))
    data, report = f"{tmp_path}/d", f"{tmp_path}/r"
    assert ov.write_if_valid(good, None, data, report) and spark.read.parquet(data).count() == 2
    broken = ov.checked(spark.range(3).select(F.when(F.col("id") < 2, "x").otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("t")), ov.required("t"))
    with pytest.raises(Exception, match="lost"):
        ov.write_if_valid(broken, None, data, report)
    assert {r["t"] for r in spark.read.parquet(data).collect()} == {"a", "b"}
    assert not ov.write_if_valid(good.union(ov.checked(spark.createDataFrame([("",)], "t string"), ov.required("t"))), None, data, report)
    assert spark.read.parquet(data).count() == 2 and spark.read.json(report).first()["rejected"] == 1
    assert ov.write_if_valid(good.limit(1), None, data, report, check_only=True) and spark.read.parquet(data).count() == 2
    assert ov.write_if_valid(good.where("t = 'b'"), None, data, report) and [r["t"] for r in spark.read.parquet(data).collect()] == ["b"]
    calls = spark.sparkContext.accumulator(0)
    counted = udf(lambda t: calls.add(1) or t)
    ov.write_if_valid(good.withColumn("t", counted.asNondeterministic()("t")), None, data, report)
    assert calls.value == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["d", "r"]


def test_points_in_boxes(spark):
    import random

    rng = random.Random(5)
    points = [(i, i % 3, rng.uniform(-50, 900), rng.choice([rng.uniform(-50, 600), 100.0, 200.0])) for i in range(400)] + [(400, 1, None, 5.0)]
    boxes = [(i, i % 3, a, a + rng.uniform(-5, 300), b, b + rng.uniform(-2, 250)) for i in range(60) for a, b in [(rng.choice([rng.uniform(-60, 800), 100.0]), rng.choice([rng.uniform(-60, 500), 100.0]))]] + [(60, 0, None, 1.0, 0.0, 1.0)]
    p, b = spark.createDataFrame(points, "i int, s int, y double, x double"), spark.createDataFrame(boxes, "j int, s int, top double, bottom double, left double, right double")
    want = {(i, j) for i, s, y, x in points for j, t, top, bottom, left, right in boxes if s == t and y is not None and top is not None and top + 1 <= y < bottom - 1 and left <= x <= right}
    out = ox.in_boxes(p, b, ["s"], "y", "x", (70.0, 110.0), 1.0)
    rows = [(r["i"], r["j"]) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_paragraphs(spark):
    lines = spark.createDataFrame([(1, 10.0, "Análise linguística/ "), (1, 20.0, " semiótica "), (1, 30.0, "fim"), (1, 60.0, "novo"), (2, 5.0, None), (2, 9.0, "b")], "p int, y double, t string")
    got = [tuple(r) for r in ox.paragraphs(lines, ["p"], "y", 18.0, "t").orderBy("p", "paragraph").collect()]
    assert got == [(1, 0, 10.0, "Análise linguística/semiótica\nfim"), (1, 1, 60.0, "novo"), (2, 0, 5.0, "b")]


def test_matches_over_pages(spark):
    import re

    pages = spark.createDataFrame([(1, 1, "uma (EF01) é"), (1, 2, "😀 quebra (EF"), (1, 3, "02) e (EF03)"), (2, 7, None), (2, 9, "(EF04)")], "d int, p int, t string")
    out = {(r["d"], r["match"]): (r["start"], r["end"], r["page"], r["n"]) for r in ox.matches_on_pages(pages, ["d"], "p", "t", r"\(EF\n?([0-9]+)\)", ["n"]).collect()}
    text = "uma (EF01) é\n😀 quebra (EF\n02) e (EF03)"
    want = {(1, m[0]): (m.start(), m.end()) for m in re.finditer(r"\(EF\n?([0-9]+)\)", text)} | {(2, "(EF04)"): (1, 7)}
    assert {k: v[:2] for k, v in out.items()} == want
    assert {k: v[2:] for k, v in out.items()} == {(1, "(EF01)"): (1, "01"), (1, "(EF\n02)"): (2, "02"), (1, "(EF03)"): (3, "03"), (2, "(EF04)"): (9, "04")}


def test_headings(spark):
    pages = spark.createDataFrame([(1, "LINGUAGENS E SUAS \nTECNOLOGIAS"), (2, "Matemática\ne suas"), (3, None)], "page int, text string")
    assert ox.heading_page(pages, "linguagens e suas tecnologias", folded=True).first()["page"] == 1
    assert ox.heading_page(pages, "MATEMÁTICA E", 2).first()["page"] == 2
    assert ox.heading_page(pages, "matematica e", folded=True).first()["page"] == 2
    for args in (("LINGUAGENS", 2), ("none", 0)):
        with pytest.raises(Exception, match="not found from page"):
            ox.heading_page(pages, *args).collect()


def test_stretches_change_nothing(spark):
    import random

    rng = random.Random(8)
    data = [(i, rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(0, 4000)) + i / 1000, rng.choice(["", None, "x", "y", "z"])) for i in range(600)]
    df = spark.createDataFrame(data, "i int, s string, t double, v string")
    stretch = F.floor(F.col("t") / 97)
    got = lambda out, c: {r["i"]: r[c] for r in out.collect()}
    plain, split = (ox.forward_fill(df, ["s"], ["t"], F.col("v"), "f", x) for x in (None, stretch))
    assert got(plain, "f") == got(split, "f") and sorted(plain.columns) == sorted(split.columns)
    for gap in (5.0, 40.0, 200.0):
        plain, split = (ox.gap_groups(df, ["s"], "t", gap, stretch=x) for x in (None, stretch))
        assert got(plain, "island") == got(split, "island")
    right = df.where("i % 3 = 0").select("s", (F.col("t") + 900).alias("t"), "v")
    for clamp in (False, True):
        plain, split = (ox.asof_backward(df.where("i % 3 = 1"), right, ["s"], "t", "v", clamp, x) for x in (None, stretch))
        assert got(plain, "asof_v") == got(split, "asof_v") and (clamp or None in got(plain, "asof_v").values())


def test_neighbours_in_stretches(spark):
    rows = [(f"c{i}" if i % 7 else None, "a" if i % 5 else None, i * 3) for i in range(200)] + [("lone", "z", 10_000)]
    df = spark.createDataFrame(rows, "code string, subject string, ord long")
    plain, split = (sorted(map(str, oc.neighbours(df, ["subject"], x).collect())) for x in (None, F.floor(F.col("ord") / 17)))
    assert plain == split and len(plain) == 201


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_related_by_overlap_is_dealt_before_it_grows(spark):
    rows = [(f"c{i:03d}", "g" if i % 3 else None, sorted({i % 5, i % 7, 99} if i % 11 else {i})) for i in range(300)]
    df = spark.createDataFrame(rows, "code string, g string, skills array<int>").coalesce(1)
    near = oc.related_by_overlap(df, ["g"], "skills")
    want = {(c, o, k) for c, g, s in rows for k, o in enumerate([o for o, h, t in rows if o != c and h == g and set(s) & set(t)][:4], 1)}
    assert {tuple(r) for r in near.collect()} == want
    assert "REPARTITION_BY_COL" in _plan(near) and "collect_list(_codes" in _plan(near)


def test_key_mismatches_are_one_aggregation(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    out = ov.key_mismatches(keys(1, 1, 2, 2, None, None), keys(2, 3, 3, 3, None), "k")
    assert sorted(map(tuple, out.collect()), key=str) == [("left", 1), ("left", None), ("right", 3), ("right", None)]
    assert [tuple(r) for r in ov.key_mismatches(keys(1, None), keys(1), "k").collect()] == [("left", None)]
    assert "Join" not in _plan(out)


def test_corrected_rows_of_a_key_stay_apart(spark):
    rules = spark.createDataFrame([("a", 1, "x", "y"), ("a", 2, "y", "z"), ("b", 1, "x", "w")], "k string, seq int, old string, new string")
    rows = spark.createDataFrame([(k, f"x{i}") for i in range(200) for k in ("a", "b", "c", None)], "k string, t string")
    want = {(k, f"{ {'a': 'z', 'b': 'w'}.get(k, 'x') }{i}") for i in range(200) for k in ("a", "b", "c", None)}
    few, many = ox.corrected(rows, rules, "k", "t"), ox.corrected(rows, rules, "k", "t", most=0)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()} == want
    assert few.columns == many.columns == ["k", "t"]
    assert "strategy=broadcast" in _plan(few) and "_place" in _plan(many)
