import pytest
from plumbline.operators import assessment as oa
from plumbline.operators import report as orp
from pyspark.sql import functions as F

SCHEMA = "year int, network string, region string, unit string, unit_name string, grade string, period string, subject string, score double, ord long"


def raw(spark, *rows):
    base = {"year": 2024, "network": "Rede Estadual", "region": "1", "unit": "100", "unit_name": "ESCOLA TESTE", "grade": "5º Ano EF", "period": "GERAL", "subject": "LÍNGUA PORTUGUESA", "score": 200.0}
    return spark.createDataFrame([tuple({**base, **r, "ord": i}.values()) for i, r in enumerate(rows)], SCHEMA)


def test_period_dedup_prefers_whole_then_mean(spark):
    by = lambda *rows: oa.executive(raw(spark, *rows)).first()["prof2024"]
    assert by({"period": "MANHÃ", "score": 180.0}, {"period": "TARDE", "score": 220.0}, {"score": 205.0}) == 205
    assert by({"period": "MANHÃ", "score": 180.0}, {"period": "TARDE", "score": 220.0}) == 200
    assert by({"period": "TARDE", "score": 214.7}) == 214.7
    assert by({"score": 1.0}, {"score": 2.0}) == 1.0  # the first whole row


def test_pairing_and_single_years(spark):
    row = oa.executive(raw(spark, {}, {"year": 2025, "score": 215.0})).first()
    assert (row["diff"], row["percent"], row["status"], row["tone"]) == (15, 7.5, "Evolução positiva", "positive")
    alone = oa.executive(raw(spark, {})).first()
    assert (alone["prof2025"], alone["diff"], alone["status"]) == (None, None, "Sem comparação")
    assert oa.executive(raw(spark, {"year": 2023})).count() == 0
    assert oa.executive(raw(spark, {"score": float("nan")}, {"year": 2025})).first()["prof2024"] is None


@pytest.mark.parametrize(("diff", "status"), [(1.0, "Pequena variação"), (-1.0, "Pequena variação"), (1.1, "Evolução positiva"), (-1.1, "Evolução negativa")])
def test_thresholds_are_strict(spark, diff, status):
    assert oa.executive(raw(spark, {}, {"year": 2025, "score": 200.0 + diff})).first()["status"] == status


def test_percent_of_zero_is_null(spark):
    assert oa.executive(raw(spark, {"score": 0.0}, {"year": 2025})).first()["percent"] is None


def test_last_row_wins_in_detail(spark):
    assert oa.detail_comparison(raw(spark, {"score": 1.0}, {"score": 2.0})).first()["prof2024"] == 2


def test_identity_and_aliases(spark):
    rows = raw(spark, {"unit_name": "OLD"}, {"year": 2025, "unit_name": "NEW"}, {"year": 2025, "unit_name": "OTHER"})
    assert oa.latest_identity(rows).first()["unit_name"] == "NEW"
    assert oa.alias_lists(rows).first()["aliases"] == ["OLD", "OTHER"]
    first, counts = oa.match_units(oa.search_index(rows), " óld ")
    assert [r["unit"] for r in first.collect()] == ["100"]
    assert counts.first()["total"] == 1
    assert oa.match_units(oa.search_index(rows), "")[0].count() == 0


def test_benchmark_counts_and_filters(spark):
    rows = raw(spark, {"score": 100.0}, {"unit": "2", "score": 200.0, "network": "Rede Municipal"})
    ex = oa.executive(rows)
    b = oa.benchmark(ex).first()
    assert (b["state2024"], b["units2024"], b["state2025"], b["units2025"]) == (150, 2, None, 0)
    assert oa.benchmark(ex.where(oa.state_filter(network="Rede Municipal"))).first()["state2024"] == 200


# diff, gap of 2024, gap of 2025, position
POSITIONS = [(3.0, 2.0, 5.0, "DESTAQUE"), (-3.0, 2.0, 5.0, "ATENCAO"), (0.5, 9.0, 5.0, "ATENCAO"), (3.0, -8.0, -5.0, "RECUPERACAO"), (0.5, -8.0, -3.0, "RECUPERACAO"), (0.5, -5.0, -5.0, "RECUPERACAO"), (-3.0, -5.0, -5.0, "PRIORIDADE"), (3.0, None, None, "SEM_REFERENCIA"), (None, None, 5.0, "SEM_EVOLUCAO"), (None, None, -5.0, "SEM_EVOLUCAO"), (0.5, None, 0.0, "RECUPERACAO"), (2.0, None, 3.0, "DESTAQUE")]


@pytest.mark.parametrize(("diff", "g24", "g25", "expected"), POSITIONS)
def test_positions(spark, diff, g24, g25, expected):
    df = spark.createDataFrame([(diff, g24, g25)], "d double, a double, b double")
    key, label, _ = oa.position(F.col("a"), F.col("b"), F.col("d"))
    row = df.select(key.alias("k"), label.alias("l")).first()
    assert row["k"] == expected
    if expected == "SEM_EVOLUCAO":
        assert row["l"].startswith("Acima" if g25 > 0 else "Abaixo")


def test_diagnosis_and_priorities(spark):
    mat = {"subject": "MATEMÁTICA"}
    rows = raw(spark, {"score": 220.0}, {"year": 2025, "score": 240.0}, {"unit": "2"}, {"unit": "2", "year": 2025}, {**mat, "score": 210.0}, {**mat, "year": 2025, "score": 195.0}, {**mat, "unit": "2", "score": 250.0}, {**mat, "unit": "2", "year": 2025, "score": 250.0})
    ex = oa.executive(rows)
    mine = oa.against_benchmark(ex, oa.benchmark(ex)).where("unit = '100'")
    said = {r["bucket"]: r["sentence"] for r in orp.diagnosis(mine).collect()}
    assert "avanço de 20,0" in said["destaques"] and "queda de 15,0" in said["atencao"]
    ranked = orp.priorities(mine).orderBy("rank").collect()
    assert [(r["priority"], r["subject"]) for r in ranked] == [("ALTA", "MATEMÁTICA"), ("DESTAQUE", "LÍNGUA PORTUGUESA")]
    assert said["destaques"].startswith("Língua Portuguesa no 5º Ano EF passou de 220,0 para 240,0 pontos, avanço de 20,0 pontos.")
    assert said["destaques"].endswith("A evolução da escola foi superior à observada no recorte.")
    assert "25,0 pontos" not in said["destaques"] and said["atencao"].endswith("27,5 pontos abaixo da média das escolas do recorte.")
    lines = orp.printed_reports(mine, "T").first()["text"].split("\n")
    assert lines[:2] == ["T", "Escola: ESCOLA TESTE — Rede Estadual · Região 1 — Cód. 100"]
    assert "- LÍNGUA PORTUGUESA (5º Ano EF): 220 -> 240 (Evolução positiva)" in lines
    assert lines[-2:] == ["- [ALTA] MATEMÁTICA (5º Ano EF): Variação: -15,0 pts · Gap para o recorte: -27,5 pts", "- [DESTAQUE] LÍNGUA PORTUGUESA (5º Ano EF): Variação: +20,0 pts · Gap para o recorte: +20,0 pts"]


def test_csv_line(spark):
    rows = raw(spark, {"unit_name": 'ESCOLA "TESTE"; LTDA', "unit": "42", "region": "3"}, {"unit_name": 'ESCOLA "TESTE"; LTDA', "unit": "42", "region": "3", "year": 2025, "score": 215.0})
    assert orp.csv_lines(oa.detail_comparison(rows)).first()["line"].startswith('"ESCOLA ""TESTE""; LTDA";"42";"3";')
    assert len(orp.CSV_HEADERS) == 12


def test_restrict_year(spark):
    ex = oa.executive(raw(spark, {}, {"year": 2025, "score": 215.0}))
    assert oa.restrict_to_year(ex, "2024").first()["prof2025"] is None
    assert oa.restrict_to_year(ex, "Comparativo").first()["diff"] == 15


def test_input_order_is_data(spark):
    rows = raw(spark, {"unit_name": "A"}, {"unit_name": "B"}, {"year": 2025, "score": 215.0, "unit_name": "C"}, {"period": "TARDE", "score": 7.0})
    assert sorted(map(str, oa.executive(rows).collect())) == sorted(map(str, oa.executive(rows.orderBy(F.desc("ord"))).collect()))


def test_headline_is_not_the_mean_of_differences(spark):
    ex = oa.executive(raw(spark, {"score": 100.0}, {"year": 2025, "score": 110.0}, {"unit": "2", "score": 300.0}))
    assert oa.group_average(ex, "subject").first()["diff"] == 10
    assert oa.subject_headline(ex).first()["diff"] == -90


def test_variants_are_those_of_each_period(spark):
    rows = raw(spark, {"period": "MANHÃ", "score": 180.0, "unit_name": "OLD"}, {"period": "TARDE", "score": 220.0}, {"period": "TARDE", "score": 230.0, "year": 2025, "unit_name": "NEW"}, {"score": 205.0})
    got = {r["variant"]: (r["prof2024"], r["prof2025"], r["unit_name"]) for r in oa.executive_variants(rows, ["MANHÃ", "TARDE"]).collect()}
    assert got == {"all": (205.0, 230.0, "NEW"), "MANHÃ": (180.0, None, "OLD"), "TARDE": (220.0, 230.0, "NEW")}


def test_flagship_scans_the_facts_twice(spark, sf_dir):
    from plumbline.plans.queries import QUERIES

    plan = QUERIES["flagship_position"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("lineitem.parquet") <= 2


def test_series_and_cap_flags(spark):
    rows = spark.createDataFrame([("b", 1.0, None, None), ("a", 2.0, 3.0, 1.0), ("", None, None, None)], "grade string, prof2024 double, prof2025 double, diff double")
    assert [(r["name"], r["place"]) for r in oa.series(rows, "grade").orderBy("place").collect()] == [("a", 1), ("b", 2)]
    index = spark.createDataFrame([(str(k), f"SCHOOL {k}", f"school {k}") for k in range(40)], "unit string, unit_name string, search_key string")
    flags = lambda q: tuple(oa.match_state(index, q).first())
    assert flags("school 39") == (1, True, False, False, True) and flags("school 3") == (11, False, True, False, True)
    assert flags("school") == (40, False, False, True, False) and flags("") == (0, False, False, False, False)


def test_means_do_not_depend_on_the_order(spark):
    """Ten units of 0.1 have a mean of 0.1 and a gap of 0, which counts as below; adding them up one by one ends under 1."""
    rows = [(y, "n", "r", str(u), f"U{u}", "g", "GERAL", "s", 0.1, u) for y in (2024, 2025) for u in range(10)]
    raw = spark.createDataFrame(rows, "year int, network string, region string, unit string, unit_name string, grade string, period string, subject string, score double, ord long")
    units = oa.executive(raw)
    compared = oa.against_benchmark(units, oa.benchmark(units)).collect()
    assert len(compared) == 10 and {(r["gap2025"], r["position"]) for r in compared} == {(0.0, "RECUPERACAO")}
    means = spark.createDataFrame([("b", 1e300), ("b", -1e300), ("c", None)], "k string, x double").groupBy("k").agg(oa.mean(F.col("x")).alias("m"))
    assert {r["k"]: r["m"] for r in means.collect()} == {"b": 0.0, "c": None}
