"""One query per operator over the driver's tables, each beside the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import assessment as oa
from plumbline.operators import catalog as oc
from plumbline.operators import extract as ox
from plumbline.operators import report as orp
from plumbline.operators import validate as ov

from .adapters import ASSESSMENT_SQL, CATALOG_SQL, GRADES_SQL, assessment, catalog, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places: engines add in different orders."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_STATUS = "CASE WHEN {0} IS NULL THEN 'Sem comparação' WHEN {0} > 1 THEN 'Evolução positiva' WHEN {0} < -1 THEN 'Evolução negativa' ELSE 'Pequena variação' END"
_TONE = "CASE WHEN {0} > 1 THEN 'positive' WHEN {0} < -1 THEN 'negative' ELSE 'neutral' END"
_LATEST = "latest AS (SELECT unit, unit_name, network, region FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY year DESC, ord) AS k FROM {0}) WHERE k = 1)"
_PAIR = ", ".join(f"coalesce(max(CASE WHEN year = {y} AND period = 'GERAL' THEN score END), avg(CASE WHEN year = {y} THEN score END)) AS prof{y}" for y in (2024, 2025))


def _executive(rows: str = "raw") -> str:
    return f"""{_LATEST.format(rows)},
paired AS (SELECT unit, grade, subject, min(ord) AS ord, {_PAIR} FROM {rows} GROUP BY unit, grade, subject),
executive AS (
  SELECT unit, grade, subject, ord, prof2024, prof2025, diff, CASE WHEN prof2024 <> 0 THEN diff / prof2024 * 100 END AS percent, {_STATUS.format("diff")} AS status, {_TONE.format("diff")} AS tone, unit_name, network, region
  FROM (SELECT *, prof2025 - prof2024 AS diff FROM paired) JOIN latest USING (unit) WHERE prof2024 IS NOT NULL OR prof2025 IS NOT NULL)"""


_BENCH = "bench AS (SELECT grade, subject, avg(prof2024) AS state2024, count(prof2024) AS units2024, avg(prof2025) AS state2025, count(prof2025) AS units2025 FROM executive{0} GROUP BY grade, subject)"
_COMPARED = """compared AS (
  SELECT *, CASE WHEN gap2025 IS NULL THEN 'SEM_REFERENCIA' WHEN diff IS NULL THEN 'SEM_EVOLUCAO' WHEN gap2025 > 0 AND (diff < -1 OR coalesce(gap_change < -1, false)) THEN 'ATENCAO' WHEN gap2025 > 0 THEN 'DESTAQUE'
         WHEN diff > 1 OR coalesce(gap_change > 1, false) THEN 'RECUPERACAO' WHEN diff < -1 OR coalesce(gap_change < -1, false) THEN 'PRIORIDADE' ELSE 'RECUPERACAO' END AS position
  FROM (SELECT *, gap2025 - gap2024 AS gap_change FROM (
    SELECT e.*, b.state2024, b.state2025, e.prof2024 - b.state2024 AS gap2024, e.prof2025 - b.state2025 AS gap2025, b.state2025 - b.state2024 AS state_diff, b.grade IS NOT NULL AS has_reference
    FROM executive e LEFT JOIN bench b ON b.grade = e.grade AND b.subject = e.subject)))"""
_E = f"WITH {ASSESSMENT_SQL}, {_executive()}"
_B = f"{_E}, {_BENCH.format('')}"
_C = f"{_B}, {_COMPARED}"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oa.executive(assessment(spark, sf_dir))
    return oa.against_benchmark(rows, oa.benchmark(rows))


@query(f"{_C} SELECT unit, unit_name, network, region, grade, subject, round(prof2024, 6) AS prof2024, round(prof2025, 6) AS prof2025, round(diff, 6) AS diff, round(gap2024, 6) AS gap2024, round(gap2025, 6) AS gap2025, round(gap_change, 6) AS gap_change, position FROM compared")
def flagship_position(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).select("unit", "unit_name", "network", "region", "grade", "subject", "prof2024", "prof2025", "diff", "gap2024", "gap2025", "gap_change", "position"))


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')} SELECT * FROM latest")
def identity_latest(spark, sf_dir):
    return oa.latest_identity(assessment(spark, sf_dir))


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')} SELECT DISTINCT r.unit, r.unit_name AS alias FROM raw r JOIN latest l ON l.unit = r.unit AND l.unit_name <> r.unit_name")
def unit_aliases(spark, sf_dir):
    return oa.unit_aliases(assessment(spark, sf_dir)).select("unit", "alias")


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')}, p AS (SELECT unit, grade, period, subject, max(CASE WHEN year = 2024 THEN score END) AS prof2024, max(CASE WHEN year = 2025 THEN score END) AS prof2025 FROM raw GROUP BY ALL), d AS (SELECT *, prof2025 - prof2024 AS diff FROM p) SELECT unit, unit_name, grade, period, subject, round(prof2024, 6) AS prof2024, round(prof2025, 6) AS prof2025, round(diff, 6) AS diff, round(diff / prof2024 * 100, 6) AS percent, {_STATUS.format('diff')} AS status FROM d JOIN latest USING (unit)")
def detail_comparison(spark, sf_dir):
    return rounded(oa.detail_comparison(assessment(spark, sf_dir)).select("unit", "unit_name", "grade", "period", "subject", "prof2024", "prof2025", "diff", "percent", "status"))


@query(f"WITH {ASSESSMENT_SQL} SELECT unit, grade, subject, year, round(coalesce(max(CASE WHEN period = 'GERAL' THEN score END), avg(score)), 6) AS score FROM raw GROUP BY unit, grade, subject, year")
def period_dedup(spark, sf_dir):
    return rounded(oa.period_dedup(assessment(spark, sf_dir)))


@query(f"{_E} SELECT unit, unit_name, network, region, grade, subject, round(prof2024, 6) AS prof2024, round(prof2025, 6) AS prof2025, round(diff, 6) AS diff, round(percent, 6) AS percent, status, tone FROM executive")
def executive(spark, sf_dir):
    return rounded(oa.executive(assessment(spark, sf_dir)).select("unit", "unit_name", "network", "region", "grade", "subject", "prof2024", "prof2025", "diff", "percent", "status", "tone"))


@query(f"{_E} SELECT status, tone, count(*) AS n FROM executive GROUP BY ALL")
def variation_class(spark, sf_dir):
    return oa.executive(assessment(spark, sf_dir)).groupBy("status", "tone").agg(F.count("*").alias("n"))


@query(f"{_B} SELECT grade, subject, round(state2024, 6) AS state2024, units2024, round(state2025, 6) AS state2025, units2025 FROM bench")
def benchmark(spark, sf_dir):
    return rounded(oa.benchmark(oa.executive(assessment(spark, sf_dir))))


@query(f"{_E}, {_BENCH.format(chr(32) + 'WHERE network = ' + chr(39) + 'AMERICA' + chr(39))} SELECT grade, subject, round(state2024, 6) AS state2024, units2024, round(state2025, 6) AS state2025, units2025 FROM bench")
def benchmark_by_network(spark, sf_dir):
    return rounded(oa.benchmark(oa.executive(assessment(spark, sf_dir)).where(oa.state_filter(network="AMERICA"))))


@query(f"WITH {ASSESSMENT_SQL}, morning AS (SELECT * FROM raw WHERE period = 'MANHA'), {_executive('morning')}, {_BENCH.format('')} SELECT grade, subject, round(state2024, 6) AS state2024, units2024, round(state2025, 6) AS state2025, units2025 FROM bench")
def benchmark_period_variant(spark, sf_dir):
    return rounded(oa.benchmark(oa.executive(assessment(spark, sf_dir), "MANHA")))


@query(f"{_E} SELECT unit, grade, subject, CAST(NULL AS DOUBLE) AS prof2024, round(prof2025, 6) AS prof2025, CAST(NULL AS DOUBLE) AS diff, 'Sem comparação' AS status FROM executive WHERE prof2025 IS NOT NULL")
def restrict_year(spark, sf_dir):
    return rounded(oa.paid_years(oa.restrict_to_year(oa.executive(assessment(spark, sf_dir)), "2025")).select("unit", "grade", "subject", "prof2024", "prof2025", "diff", "status"))


@query(f"{_C} SELECT unit, grade, subject, has_reference, round(gap2024, 6) AS gap2024, round(gap2025, 6) AS gap2025, round(state_diff, 6) AS state_diff FROM compared")
def gap_to_benchmark(spark, sf_dir):
    return rounded(_compared(spark, sf_dir).select("unit", "grade", "subject", "has_reference", "gap2024", "gap2025", "state_diff"))


@query(f"{_B} SELECT r.unit, r.grade, r.period, r.subject, round(r.score - b.state2025, 6) AS gap2025 FROM raw r LEFT JOIN bench b ON b.grade = r.grade AND b.subject = r.subject WHERE r.year = 2025")
def table_gap(spark, sf_dir):
    raw = assessment(spark, sf_dir)
    out = oa.table_gap(oa.detail_comparison(raw), oa.benchmark(oa.executive(raw)))
    return rounded(out.where("prof2025 is not null").select("unit", "grade", "period", "subject", "gap2025"))


@query(f"{_E} SELECT network AS name, round(avg(prof2024), 6) AS prof2024, round(avg(prof2025), 6) AS prof2025, round(avg(diff), 6) AS diff FROM executive GROUP BY network")
def group_average(spark, sf_dir):
    return rounded(oa.group_average(oa.executive(assessment(spark, sf_dir)), "network"))


@query(f"{_E} SELECT subject, round(avg(prof2024), 6) AS mean2024, round(avg(prof2025), 6) AS mean2025, round(avg(prof2025) - avg(prof2024), 6) AS diff FROM executive GROUP BY subject")
def component_headline(spark, sf_dir):
    return rounded(oa.subject_headline(oa.executive(assessment(spark, sf_dir))).drop("tone"))


@query(f"{_E} SELECT unit, grade, subject, round(diff, 6) AS diff FROM executive WHERE diff > 1 ORDER BY executive.diff DESC, unit, grade, subject LIMIT 8")
def ranking_growth(spark, sf_dir):
    return rounded(oa.growth_ranking(oa.executive(assessment(spark, sf_dir))).select("unit", "grade", "subject", "diff"))


@query(f"{_E} SELECT unit, grade, subject, round(diff, 6) AS diff FROM executive WHERE diff < -1 ORDER BY executive.diff, unit, grade, subject LIMIT 8")
def ranking_decline(spark, sf_dir):
    return rounded(oa.decline_ranking(oa.executive(assessment(spark, sf_dir))).select("unit", "grade", "subject", "diff"))


@query(f"{_C} SELECT unit, grade, subject, CASE position WHEN 'PRIORIDADE' THEN 'ALTA' WHEN 'ATENCAO' THEN 'ATENÇÃO' WHEN 'RECUPERACAO' THEN 'MONITORAR' WHEN 'DESTAQUE' THEN 'DESTAQUE' END AS priority, CAST(CASE position WHEN 'PRIORIDADE' THEN 1 WHEN 'ATENCAO' THEN 2 WHEN 'RECUPERACAO' THEN 3 WHEN 'DESTAQUE' THEN 4 ELSE 5 END AS INTEGER) AS rank FROM compared WHERE has_reference AND diff IS NOT NULL")
def priorities(spark, sf_dir):
    return orp.priorities(_compared(spark, sf_dir)).select("unit", "grade", "subject", "priority", "rank")


@query(f"{_C} SELECT CASE WHEN position IN ('DESTAQUE', 'RECUPERACAO') THEN 'destaques' ELSE 'atencao' END AS bucket, count(*) AS n FROM compared WHERE diff IS NOT NULL GROUP BY ALL")
def diagnosis_bucket(spark, sf_dir):
    return orp.diagnosis(_compared(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("n"))


_TENTH = "replace(printf('%.1f', floor(abs({0}) * 10 + 0.5) / 10), '.', ',')"
_N = _TENTH.format


@query(f"""{_C}, said AS (
  SELECT *, subject || ' no ' || grade || ' passou de ' || {_N('prof2024')} || ' para ' || {_N('prof2025')} || ' pontos, ' || CASE WHEN diff >= 0 THEN 'avanço' ELSE 'queda' END || ' de ' || {_N('diff')} || ' pontos.' AS base FROM compared WHERE diff IS NOT NULL)
SELECT unit, grade, subject, CASE WHEN position IN ('DESTAQUE', 'RECUPERACAO') THEN 'destaques' ELSE 'atencao' END AS bucket,
  base || CASE WHEN gap2024 < 0 AND gap2025 >= 0 THEN ' A escola passou de ' || {_N('gap2024')} || ' pontos abaixo da média das escolas do recorte em 2024 para ' || {_N('gap2025')} || ' pontos acima em 2025.'
       WHEN gap2025 < 0 AND gap_change > 1 THEN ' A escola reduziu a distância para a média das escolas do recorte em ' || {_N('gap_change')} || ' pontos, mas o resultado permanece ' || {_N('gap2025')} || ' pontos abaixo da média das escolas do recorte.'
       WHEN gap2025 < 0 THEN ' O resultado permanece ' || {_N('gap2025')} || ' pontos abaixo da média das escolas do recorte.'
       WHEN diff > state_diff THEN ' A evolução da escola foi superior à observada no recorte.' ELSE '' END
  || CASE WHEN position = 'ATENCAO' THEN ' Este resultado merece investigação.' ELSE '' END AS sentence FROM said""")
def diagnosis_text(spark, sf_dir):
    return orp.diagnosis(_compared(spark, sf_dir)).drop("ord")


#: Raw rows with whole scores, so that many pairs of years differ by the same and means are short.
_WHOLE = "whole AS (SELECT * REPLACE (round(score) AS score) FROM raw)"
_WE = f"WITH {ASSESSMENT_SQL}, {_WHOLE}, {_executive('whole')}"
_WC = f"{_WE}, {_BENCH.format('')}, {_COMPARED}"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment(spark, sf_dir).withColumn("score", F.round("score"))


def _whole_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = oa.executive(_whole(spark, sf_dir))
    return oa.against_benchmark(rows, oa.benchmark(rows))


@query(f"{_WE} SELECT 'growth' AS list, unit, grade, subject, round(diff, 6) AS diff, row_number() OVER (ORDER BY executive.diff DESC, ord) AS place FROM executive WHERE executive.diff > 1 QUALIFY place <= 8 UNION ALL SELECT 'decline', unit, grade, subject, round(diff, 6), row_number() OVER (ORDER BY executive.diff, ord) AS place FROM executive WHERE executive.diff < -1 QUALIFY place <= 8")
def rankings_with_ties(spark, sf_dir):
    rows = oa.executive(_whole(spark, sf_dir))
    place = lambda df, name, by: df.select(F.lit(name).alias("list"), "unit", "grade", "subject", "diff", F.row_number().over(Window.orderBy(by, "ord")).cast("long").alias("place"))  # noqa: E731  eight rows
    return rounded(place(oa.growth_ranking(rows), "growth", F.desc("diff")).union(place(oa.decline_ranking(rows), "decline", F.col("diff"))))


@query(f"{_WC}, r AS (SELECT *, CASE position WHEN 'PRIORIDADE' THEN 1 WHEN 'ATENCAO' THEN 2 WHEN 'RECUPERACAO' THEN 3 WHEN 'DESTAQUE' THEN 4 ELSE 5 END AS rank FROM compared WHERE has_reference AND diff IS NOT NULL) SELECT unit, grade, subject, row_number() OVER (PARTITION BY unit ORDER BY rank, ord) AS place FROM r")
def priorities_in_order(spark, sf_dir):
    ranked = orp.priorities(_whole_compared(spark, sf_dir))
    return ranked.select("unit", "grade", "subject", F.row_number().over(Window.partitionBy("unit").orderBy("rank", "ord")).cast("long").alias("place"))


def _plain(x: str) -> str:
    """SQL text of a number: DuckDB's shortest digits, exponents between -7 and 21 written out as zeros."""
    return f"""(CASE WHEN {x} IS NULL THEN '' WHEN {x} = 0 THEN '0' WHEN contains({x}::VARCHAR, 'e') AND abs({x}) >= 0.000001
      THEN CASE WHEN {x} < 0 THEN '-' ELSE '' END || '0.' || repeat('0', -CAST(split_part({x}::VARCHAR, 'e', 2) AS INTEGER) - 1) || replace(split_part(abs({x})::VARCHAR, 'e', 1), '.', '')
      ELSE regexp_replace(regexp_replace({x}::VARCHAR, '\\.0(e|$)', '\\1'), 'e-0', 'e-') END)"""


@query(f"""{_WC}, text AS (
  SELECT *, {_plain('prof2024')} AS p24, {_plain('prof2025')} AS p25, CASE WHEN position IN ('DESTAQUE', 'RECUPERACAO') THEN 'destaques' ELSE 'atencao' END AS bucket,
    CASE position WHEN 'PRIORIDADE' THEN 1 WHEN 'ATENCAO' THEN 2 WHEN 'RECUPERACAO' THEN 3 WHEN 'DESTAQUE' THEN 4 ELSE 5 END AS rank,
    subject || ' no ' || grade || ' passou de ' || {_N('prof2024')} || ' para ' || {_N('prof2025')} || ' pontos, ' || CASE WHEN diff >= 0 THEN 'avanço' ELSE 'queda' END || ' de ' || {_N('diff')} || ' pontos.'
    || CASE WHEN gap2024 < 0 AND gap2025 >= 0 THEN ' A escola passou de ' || {_N('gap2024')} || ' pontos abaixo da média das escolas do recorte em 2024 para ' || {_N('gap2025')} || ' pontos acima em 2025.'
       WHEN gap2025 < 0 AND gap_change > 1 THEN ' A escola reduziu a distância para a média das escolas do recorte em ' || {_N('gap_change')} || ' pontos, mas o resultado permanece ' || {_N('gap2025')} || ' pontos abaixo da média das escolas do recorte.'
       WHEN gap2025 < 0 THEN ' O resultado permanece ' || {_N('gap2025')} || ' pontos abaixo da média das escolas do recorte.'
       WHEN diff > state_diff THEN ' A evolução da escola foi superior à observada no recorte.' ELSE '' END
    || CASE WHEN position = 'ATENCAO' THEN ' Este resultado merece investigação.' ELSE '' END AS said,
    CASE WHEN diff > 0 THEN '+' WHEN diff < 0 THEN '-' ELSE '' END || {_N('diff')} AS sdiff, CASE WHEN gap2025 > 0 THEN '+' WHEN gap2025 < 0 THEN '-' ELSE '' END || {_N('gap2025')} AS sgap
  FROM compared)
SELECT unit, 'Relatório' || chr(10) || 'Escola: ' || any_value(unit_name) || ' — ' || any_value(network) || ' · Região ' || any_value(region) || ' — Cód. ' || unit || chr(10)
  || chr(10) || 'Resumo por componente e série:' || chr(10) || string_agg('- ' || subject || ' (' || grade || '): ' || coalesce(nullif(p24, ''), '-') || ' -> ' || coalesce(nullif(p25, ''), '-') || ' (' || status || ')', chr(10) ORDER BY ord) || chr(10)
  || chr(10) || 'Destaques:' || chr(10) || coalesce(string_agg('- ' || said, chr(10) ORDER BY ord) FILTER (WHERE diff IS NOT NULL AND bucket = 'destaques'), '- Nenhum.') || chr(10)
  || chr(10) || 'Pontos de atenção:' || chr(10) || coalesce(string_agg('- ' || said, chr(10) ORDER BY ord) FILTER (WHERE diff IS NOT NULL AND bucket = 'atencao'), '- Nenhum.') || chr(10)
  || chr(10) || 'Prioridades para análise:' || chr(10) || coalesce(string_agg('- [' || CASE rank WHEN 1 THEN 'ALTA' WHEN 2 THEN 'ATENÇÃO' WHEN 3 THEN 'MONITORAR' WHEN 4 THEN 'DESTAQUE' ELSE '' END || '] ' || subject || ' (' || grade || '): Variação: ' || sdiff || ' pts · Gap para o recorte: ' || sgap || ' pts', chr(10) ORDER BY rank, ord) FILTER (WHERE has_reference AND diff IS NOT NULL), '- Nenhuma.') AS text
FROM text GROUP BY unit""")
def printed_reports(spark, sf_dir):
    return orp.printed_reports(_whole_compared(spark, sf_dir), "Relatório")


@query(f"{_E}, d AS (SELECT least(min(prof2024), min(prof2025)) AS low, greatest(max(prof2024), max(prof2025)) AS high FROM executive) SELECT round(low, 6) AS low, round(high, 6) AS high, round(low - greatest((high - low) * 0.18, 6.0), 6) AS axis_low, round(high + greatest((high - low) * 0.18, 6.0), 6) AS axis_high FROM d")
def domain_minmax(spark, sf_dir):
    return rounded(orp.value_domain(oa.executive(assessment(spark, sf_dir)), ["prof2024", "prof2025"]))


@query("WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - 1 AS i FROM supplier) SELECT s_suppkey, round(max(s_acctbal - 30.0 * i) OVER (PARTITION BY s_nationkey ORDER BY i) + 30.0 * i, 6) AS place FROM s")
def label_spread(spark, sf_dir):
    return rounded(orp.spread_labels(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"]).select("s_suppkey", "place"))


@query(f"WITH {CATALOG_SQL} SELECT 'year' AS facet, year AS value FROM catalog GROUP BY ALL UNION ALL SELECT 'unit', unit FROM catalog GROUP BY ALL UNION ALL SELECT 'subject', subject FROM catalog GROUP BY ALL")
def facet_values(spark, sf_dir):
    records = catalog(spark, sf_dir)
    out = [oc.facet(records, F.col(c)).select(F.lit(c).alias("facet"), "value") for c in ("year", "unit", "subject")]
    return out[0].union(out[1]).union(out[2])


@query(f"WITH {CATALOG_SQL} SELECT DISTINCT object AS value FROM catalog WHERE list_contains(years, '7º ano') AND unit = 'Brand#2'")
def facet_dependent(spark, sf_dir):
    records = catalog(spark, sf_dir)
    return oc.facet(records, F.col("object"), oc.matches(year="7º ano", unit="Brand#2"))


@query("SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'), 'que la')")
def text_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(tx.catalog_key(F.col("text")), F.lit(tx.fold("Quê  Lá")))).select("doc_id")


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[\\s]+', ' ', 'g')) AS folded FROM documents")
def text_search_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.catalog_key(F.col("text")).alias("folded"))


@query(f"WITH {CATALOG_SQL}, q AS (SELECT code, 'Ciências do ' || year || ' e ' || object AS q FROM catalog) SELECT code, nullif(regexp_extract(lower(strip_accents(q)), '(?:^|[^a-z0-9_])([6-9])(?:º|o)?\\s*ano(?:[^a-z0-9_]|$)', 1), '') || 'º ano' AS grade FROM q")
def grade_query_parse(spark, sf_dir):
    q = F.concat(F.lit("Ciências do "), F.col("year"), F.lit(" e "), F.col("object"))
    return catalog(spark, sf_dir).select("code", tx.parsed_grade(q).alias("grade"))


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')}, hits AS (SELECT unit, unit_name FROM latest WHERE contains(lower(unit_name), 'supplier')), t AS (SELECT count(*) AS total FROM hits) SELECT unit, unit_name, total, greatest(total - 30, 0) AS hidden FROM (SELECT * FROM hits ORDER BY unit_name, unit LIMIT 30), t")
def search_cap(spark, sf_dir):
    first, counts = oa.match_units(oa.search_index(assessment(spark, sf_dir)), "  SUPPLIER ")
    return first.select("unit", "unit_name").crossJoin(counts)  # thirty rows beside one


@query(f"WITH {CATALOG_SQL} SELECT code FROM catalog WHERE list_contains(years, '7º ano') AND subject = 'ECONOMY' AND unit IN ('Brand#2', 'Brand#7')")
def array_year_filter(spark, sf_dir):
    return catalog(spark, sf_dir).where(oc.matches(year="7º ano") & (F.col("subject") == "ECONOMY") & F.col("unit").isin("Brand#2", "Brand#7")).select("code")


@query(f"WITH {CATALOG_SQL} SELECT code FROM catalog WHERE list_contains(skills, 3) AND contains(lower(code || ' ' || text || ' ' || object || ' ' || unit || ' ' || subject), 'ring 1')")
def competency_filter(spark, sf_dir):
    return catalog(spark, sf_dir).where(oc.matches("Ring 1", skill="3")).select("code")


@query(f"WITH {CATALOG_SQL} SELECT code, subject, unit FROM catalog WHERE lower(code) = '77'")
def code_lookup(spark, sf_dir):
    return oc.lookup(catalog(spark, sf_dir), "77").select("code", "subject", "unit")


@query(f"WITH {CATALOG_SQL} SELECT code, subject, year, lag(code) OVER w AS previous, lead(code) OVER w AS next FROM catalog WINDOW w AS (PARTITION BY subject, year ORDER BY ord)")
def adjacent(spark, sf_dir):
    return oc.neighbours(catalog(spark, sf_dir), ["subject", "year"])


@query(f"WITH {CATALOG_SQL} SELECT code, subject, lag(code) OVER w AS previous, lead(code) OVER w AS next FROM catalog WINDOW w AS (PARTITION BY subject ORDER BY ord)")
def adjacent_component(spark, sf_dir):
    return oc.neighbours(catalog(spark, sf_dir), ["subject"])


@query(f"WITH {CATALOG_SQL}, p AS (SELECT a.code, b.code AS related, row_number() OVER (PARTITION BY a.code ORDER BY (a.object = b.object) DESC, b.code) AS place FROM catalog a JOIN catalog b ON a.subject = b.subject AND a.year = b.year AND a.unit = b.unit AND a.code <> b.code) SELECT code, related, CAST(place AS INTEGER) AS place FROM p WHERE place <= 4")
def related_group(spark, sf_dir):
    return oc.related_by_group(catalog(spark, sf_dir), ["subject", "year", "unit"])


@query(f"WITH {CATALOG_SQL}, e AS (SELECT code, subject, unnest(skills) AS e FROM catalog), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, e ORDER BY code) AS k FROM e) WHERE k <= 5), p AS (SELECT DISTINCT a.code, b.code AS related FROM e a JOIN f b ON a.subject = b.subject AND a.e = b.e AND a.code <> b.code), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY related) AS place FROM p) SELECT code, related, CAST(place AS INTEGER) AS place FROM r WHERE place <= 4")
def related_overlap(spark, sf_dir):
    return oc.related_by_overlap(catalog(spark, sf_dir), ["subject"], "skills")


@query(f"WITH {CATALOG_SQL} SELECT DISTINCT '/' || lower(subject) AS url FROM catalog UNION ALL SELECT DISTINCT '/' || lower(subject) || '/' || y[1] || '-ano' FROM (SELECT subject, unnest(years) AS y FROM catalog) WHERE y IN ('6º ano', '7º ano', '8º ano', '9º ano') UNION ALL SELECT '/c/' || lower(code) FROM catalog")
def route_enumeration(spark, sf_dir):
    return oc.routes(catalog(spark, sf_dir), ["6º ano", "7º ano", "8º ano", "9º ano"])


@query("SELECT 'orders without lines' AS fault, o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL SELECT DISTINCT 'lines without order', l_orderkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)")
def referential_anti(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    side = F.when(F.col("side") == "left", "orders without lines").otherwise("lines without order")
    return ov.key_mismatches(orders, lines, "key").select(side.alias("fault"), "key")


@query(f"{_E} SELECT unit, grade, subject, status FROM executive WHERE unit IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal > 5000)")
def selection_semi(spark, sf_dir):
    chosen = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("unit"))
    return oa.selected_units(oa.executive(assessment(spark, sf_dir)), chosen).select("unit", "grade", "subject", "status")


def _line_rules() -> list[ov.Rule]:
    return [*ov.required("l_returnflag"), ov.one_of("l_linestatus", ["F"]), ov.pattern("l_returnflag", "^[AN]$"), ov.Rule("discount", F.col("l_discount") > 0.08, "warn")]


_LINE_ERRORS = "CAST(l_linestatus <> 'F' AS INTEGER) + CAST(l_returnflag NOT IN ('A', 'N') AS INTEGER)"


@query(f"SELECT 'known:l_linestatus' AS rule, count(*) AS n FROM lineitem WHERE l_linestatus <> 'F' UNION ALL SELECT 'pattern:l_returnflag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'discount', count(*) FROM lineitem WHERE l_discount > 0.08")
def rule_violations(spark, sf_dir):
    return ov.rule_totals(ov.checked(table(spark, sf_dir, "lineitem"), _line_rules()))


@query(f"SELECT count(*) AS total, count(*) FILTER ({_LINE_ERRORS} = 0) AS accepted, count(*) FILTER ({_LINE_ERRORS} > 0) AS rejected, count(*) FILTER (l_discount > 0.08) AS warned, CAST(0 AS BIGINT) AS gaps, 'revisao_necessaria' AS status FROM lineitem")
def report_status(spark, sf_dir):
    return ov.status(ov.checked(table(spark, sf_dir, "lineitem"), _line_rules()))


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS surplus FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    rows = ov.checked(table(spark, sf_dir, "lineitem"), [ov.duplicates(["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])])
    return ov.rejected(rows).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("surplus"))


@query("SELECT doc_id FROM documents WHERE right(trim(text, ' '), 1) NOT IN ('.', '!', '?', ')', '\"', '”') OR trim(text, ' ') = ''")
def punctuation_warn(spark, sf_dir):
    return ov.checked(table(spark, sf_dir, "documents"), [ov.final_punctuation("text")]).where(F.size("warnings") > 0).select("doc_id")


@query("WITH m AS (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, CAST(g AS INTEGER) AS missing FROM m, UNNEST(range(1, m + 1)) AS r(g) WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = m.l_orderkey AND l.l_linenumber = g)")
def sequence_gaps(spark, sf_dir):
    return ov.sequence_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT r_name, count(n_nationkey) FILTER (n_nationkey % 7 = 0) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def scope_totals(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    some = table(spark, sf_dir, "nation").where("n_nationkey % 7 = 0").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return ov.totals(some, ["r_name"], region.select("r_name"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def global_totals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT DISTINCT l_partkey AS key FROM lineitem), ok AS (SELECT NOT EXISTS (SELECT 1 FROM l WHERE key NOT IN (SELECT p_partkey FROM part)) AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey NOT IN (SELECT key FROM l)) AS ok) SELECT l.key, CASE WHEN ok.ok THEN p.p_brand END AS p_brand FROM l LEFT JOIN part p ON p.p_partkey = l.key, ok")
def guarded_enrichment(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).distinct()
    return ov.guarded_enrichment(lines, table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key"), "key", "p_brand")


@query("SELECT conv_id, turn, role, last_value(nullif(CASE WHEN role = 'user' THEN text END, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def forward_fill(spark, sf_dir):
    return ox.forward_fill(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("text")), "asked").select("conv_id", "turn", "role", "asked")


@query("SELECT p.event_id, v.event_id AS asof_view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_backward(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return ox.asof_backward(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", "view_id").select("event_id", "asof_view_id")


@query("WITH g AS (SELECT event_id, user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events) SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS island FROM g")
def gap_groups(spark, sf_dir):
    return ox.gap_groups(table(spark, sf_dir, "events"), ["user_id"], "ts", F.expr("interval 1 day")).select("event_id", "island")


@query("WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'signup') SELECT user_id, ts AS top, n AS bottom FROM e WHERE n IS NOT NULL")
def boundary_pairs(spark, sf_dir):
    return ox.boundary_pairs(table(spark, sf_dir, "events").where("event_type = 'signup'"), ["user_id"], "ts")


@query("WITH e AS (SELECT user_id, ts AS top, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS bottom FROM events WHERE event_type = 'error') SELECT v.event_id, e.top, e.bottom FROM events v JOIN e ON e.user_id = v.user_id AND v.ts >= e.top AND v.ts < e.bottom WHERE v.event_type = 'click'")
def interval_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bounds = ox.boundary_pairs(events.where("event_type = 'error'"), ["user_id"], "ts")
    return ox.in_intervals(events.where("event_type = 'click'"), bounds, ["user_id"], "ts").select("event_id", "top", "bottom")


@query("SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS label FROM pages")
def regex_multi(spark, sf_dir):
    return ox.all_matches(table(spark, sf_dir, "pages").select("page_id", "html"), "html", '<a href="([^"]*)">([^<]*)</a>', ["href", "label"]).drop("match_no")


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(173), ''), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), ' ') AS cleaned FROM documents")
def line_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.clean_lines(F.col("text")).alias("cleaned"))


#: Scores of very different sizes: some units' below 0.001, some above 10,000,000.
_SIZES = "sized AS (SELECT * REPLACE (score * CASE CAST(unit AS INTEGER) % 5 WHEN 1 THEN 0.000015 WHEN 2 THEN 900000.5 ELSE 1.0 END AS score) FROM raw)"


@query(f"""WITH {ASSESSMENT_SQL}, {_SIZES}, {_LATEST.format('sized')}, p AS (SELECT unit, grade, period, subject, max(CASE WHEN year = 2024 THEN score END) AS a, max(CASE WHEN year = 2025 THEN score END) AS b FROM sized GROUP BY ALL),
d AS (SELECT *, b - a AS diff FROM p), v AS (SELECT *, diff / a * 100 AS percent, {_STATUS.format('diff')} AS status FROM d),
c AS (SELECT *, unnest([unit_name, unit, region, grade, subject, period, network, {_plain('a')}, {_plain('b')}, {_plain('diff')}, {_plain('percent')}, status]) AS cell, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12], 1) AS i FROM v JOIN latest USING (unit))
SELECT unit, grade, subject, period, string_agg('"' || replace(cell, '"', '""') || '"', ';' ORDER BY i) AS line FROM c GROUP BY unit, grade, subject, period""")
def csv_cells(spark, sf_dir):
    n = F.col("unit").cast("int") % 5
    raw = assessment(spark, sf_dir).withColumn("score", F.col("score") * F.when(n == 1, 0.000015).when(n == 2, 900000.5).otherwise(1.0))
    return orp.csv_lines(oa.detail_comparison(raw)).drop("ord")


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN replace(replace(text, 'eau', 'eaux'), 'xx', 'x') WHEN 'de' THEN replace(text, 'ung', 'UNG') ELSE text END AS text FROM documents")
def corrections(spark, sf_dir):
    rules = spark.createDataFrame([("fr", 1, "eau", "eaux"), ("fr", 2, "xx", "x"), ("de", 1, "ung", "UNG")], "lang string, seq int, old string, new string")
    return ox.corrected(table(spark, sf_dir, "documents"), rules, "lang", "text").select("doc_id", "text")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("WITH t AS (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, doc_id FROM documents) SELECT a.doc_id, a.n AS page, b.line AS facing_text FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.n = a.n + 1 WHERE a.n % 2 = 1")
def facing_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", (F.col("page") + 1).cast("long"))
    return ox.facing_pages(lines, 1, ("doc_id",)).select("doc_id", "page", "facing_text")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def first_items(spark, sf_dir):
    return ox.first_items(table(spark, sf_dir, "orders"), [], "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT min(page_id) AS page FROM pages WHERE page_id >= 10 AND contains(upper(replace(html, chr(10), ' ')), '<A HREF')")
def heading_page(spark, sf_dir):
    return ox.heading_page(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text")), "<a href", 10)


_CODED = """coded AS (
  SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'EF' || key || 'LP' || right('0' || (p_partkey % 90), 2) END AS code, CASE WHEN p_partkey % 11 = 0 THEN 'competencia_especifica' WHEN p_partkey % 13 = 0 THEN 'competencia_geral' ELSE 'habilidade' END AS kind,
         CASE WHEN p_partkey % 5 = 0 THEN 'Ensino Médio' ELSE 'Ensino Fundamental' END AS stage, p_type AS area, p_brand AS subject, CAST(p_size AS INTEGER) AS number, p_partkey AS ord
  FROM (SELECT *, (['01', '12', '35', '89', '69', 'xx'])[CAST(p_partkey % 6 AS INTEGER) + 1] AS key FROM part))"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all kinds over `part`, with codes that name grades; specific competences have no code."""
    key = F.element_at(F.array(*[F.lit(k) for k in ("01", "12", "35", "89", "69", "xx")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    n = F.col("p_partkey")
    code = F.concat(F.lit("EF"), key, F.lit("LP"), F.lpad((n % 90).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select(
        F.when(n % 11 != 0, code).alias("code"), F.when(n % 11 == 0, oc.SPECIFIC).when(n % 13 == 0, oc.GENERAL).otherwise(oc.SKILL).alias("kind"),
        F.when(n % 5 == 0, "Ensino Médio").otherwise("Ensino Fundamental").alias("stage"), F.col("p_type").alias("area"), F.col("p_brand").alias("subject"), F.col("p_size").cast("int").alias("number"), n.alias("ord"),
    )


@query(f"WITH {_CODED} SELECT ord, subject, row_number() OVER (PARTITION BY subject ORDER BY CASE WHEN kind = 'competencia_especifica' THEN 0 ELSE 1 END, coalesce(code, ''), number, ord) AS place FROM coded")
def dataset_order(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("subject").orderBy(*oc.dataset_order(), "ord"))
    return _coded(spark, sf_dir).select("ord", "subject", place.cast("long").alias("place"))


_GRADES = f"g AS (SELECT k, label, array_to_string(years, '|') AS years FROM {GRADES_SQL} AS v(k, label, years))"


@query(f"WITH {_CODED}, {_GRADES} SELECT ord, label AS grade_label, years AS grade_years FROM coded LEFT JOIN g ON substring(code, 3, 2) = k")
def grade_lookup(spark, sf_dir):
    return oc.with_grades(_coded(spark, sf_dir)).select("ord", "grade_label", F.array_join("grade_years", "|").alias("grade_years"))


@query(f"WITH {_CODED}, {_GRADES} SELECT ord FROM coded LEFT JOIN g ON substring(code, 3, 2) = k WHERE label IS DISTINCT FROM CASE WHEN stage = 'Ensino Médio' THEN '1º ano' ELSE label END")
def grade_label_rule(spark, sf_dir):
    expected = F.when(F.col("stage") == "Ensino Médio", "1º ano").otherwise(F.col("grade_label"))
    return ov.rejected(ov.checked(oc.with_grades(_coded(spark, sf_dir)), [ov.equals_lookup("grade_label", expected)])).select("ord")


@query(f"""WITH {_CODED} SELECT ord,
  CASE kind WHEN 'competencia_geral' THEN 'Competência geral · Competência ' || number || ' de 10' WHEN 'competencia_especifica' THEN 'Competência específica · ' || area || ' · Competência ' || number
       ELSE CASE WHEN stage = 'Ensino Médio' THEN 'Habilidade · Ensino Médio · ' || area || ' · ' || subject ELSE 'Habilidade · ' || stage || ' · 6º ano · ' || subject END END AS label,
  CASE kind WHEN 'competencia_geral' THEN '/c/competencias-gerais#competencia-' || number WHEN 'competencia_especifica' THEN '/c/ensino-medio/' || CASE area WHEN 'ECONOMY' THEN 'um' ELSE '' END || '#competencia-' || number ELSE '/c/' || lower(code) END AS href FROM coded""")
def record_labels(spark, sf_dir):
    records = _coded(spark, sf_dir).withColumn("year", F.lit("6º ano"))
    return records.select("ord", oc.record_label().alias("label"), oc.record_href("/c", {"ECONOMY": "um"}).alias("href"))


@query(f"WITH {_CODED} SELECT kind, count(*) AS n FROM coded WHERE kind <> 'competencia_geral' GROUP BY kind")
def kind_filter(spark, sf_dir):
    return oc.of_kind(_coded(spark, sf_dir), oc.SPECIFIC, oc.SKILL).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, replace(text, chr(10), ' · ') AS label, len(string_split(text, chr(10))) AS n_lines FROM documents")
def object_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "object")
    return docs.select("doc_id", oc.object_label().alias("label"), F.size(oc.object_lines()).cast("long").alias("n_lines"))


@query(f"WITH {_CODED} SELECT DISTINCT subject, CASE subject WHEN 'Brand#1' THEN 'first' ELSE lower(replace(subject, '#', '-')) END AS slug FROM coded")
def mapped_slugs(spark, sf_dir):
    return _coded(spark, sf_dir).select("subject", oc.mapped_slug(F.col("subject"), {"Brand#1": "first"}).alias("slug")).distinct()


@query(f"WITH {CATALOG_SQL} SELECT 'year' AS facet, unnest(years) AS value FROM catalog UNION SELECT 'unit', unit FROM catalog WHERE list_contains(years, '7º ano') UNION SELECT 'object', object FROM catalog WHERE list_contains(years, '7º ano') AND unit = 'Brand#2'")
def facets_all(spark, sf_dir):
    return oc.dependent_facets(catalog(spark, sf_dir), "7º ano", "Brand#2")


@query("SELECT 'total' AS facet, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM orders UNION ALL SELECT 'status', nullif(o_orderstatus, 'O'), count(*) FROM orders WHERE o_orderstatus <> 'O' GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def summary_totals(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.nullif("o_orderstatus", F.lit("O")).alias("status"), F.col("o_orderpriority").alias("priority"))
    return ov.summary(orders, ["status", "priority"])


@query("WITH s AS (SELECT o_orderpriority, CASE WHEN count(*) FILTER (o_totalprice > 400000) > 0 THEN 'revisao_necessaria' ELSE 'valido' END AS status FROM orders GROUP BY 1) SELECT count(*) AS scopes, CASE WHEN coalesce(bool_and(status = 'valido'), true) THEN 'valido' ELSE 'revisao_necessaria' END AS status FROM s")
def overall_status(spark, sf_dir):
    scopes = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.when(F.count_if(F.col("o_totalprice") > 400000) > 0, ov.REVIEW).otherwise(ov.VALID).alias("status"))
    return ov.overall_status(scopes)


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS distinct_keys, count(*) = count(DISTINCT l_orderkey) AS \"unique\" FROM lineitem")
def distinct_check(spark, sf_dir):
    return ov.distinct_check(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT CAST(g AS INTEGER) AS missing FROM range(1, 61) AS r(g) WHERE g NOT IN (SELECT p_size FROM part WHERE p_size % 4 <> 0)")
def fixed_range_gaps(spark, sf_dir):
    return ov.fixed_range_gaps(table(spark, sf_dir, "part").where("p_size % 4 <> 0"), "p_size", 60)


@query("WITH a AS (SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_quantity < 3), b AS (SELECT p_partkey AS key FROM part WHERE p_size < 40) SELECT 'left' AS side, key FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT 'right', key FROM b WHERE key NOT IN (SELECT key FROM a)")
def mapping_mismatch(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("key"))
    return ov.key_mismatches(lines, table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("key")), "key")


@query("WITH s AS (SELECT user_id, event_type, date_diff('second', TIMESTAMP '2024-01-01', ts) / 1.0 AS pos FROM events), e AS (SELECT user_id, pos FROM s WHERE event_type = 'signup'), m AS (SELECT user_id, max(pos) AS last FROM e GROUP BY 1), c AS (SELECT user_id, max(pos) AS pos FROM s WHERE event_type = 'error' GROUP BY 1) SELECT user_id, pos FROM e UNION ALL SELECT c.user_id, c.pos FROM c JOIN m ON m.user_id = c.user_id WHERE c.pos > m.last UNION ALL SELECT user_id, -1.0 FROM m")
def boundary_edges(spark, sf_dir):
    pos = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))).cast("double")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", pos.alias("pos"))
    closing = events.where("event_type = 'error'").groupBy("user_id").agg(F.max("pos").alias("pos"))
    return ox.with_edges(events.where("event_type = 'signup'"), ["user_id"], "pos", -1.0, closing)


@query(f"WITH {ASSESSMENT_SQL} SELECT DISTINCT 'Período ' || period AS period, 'periodo ' || lower(period) AS file FROM raw")
def file_labels(spark, sf_dir):
    period = F.concat(F.lit("Período "), F.col("period"))
    return assessment(spark, sf_dir).select(period.alias("period"), tx.file_label(period).alias("file")).distinct()


@query(f"{_B}, p AS (SELECT unit, grade, period, subject, max(CASE WHEN year = 2024 THEN score END) AS a, max(CASE WHEN year = 2025 THEN score END) AS b FROM raw GROUP BY unit, grade, period, subject ORDER BY min(ord) LIMIT 300) SELECT p.unit, p.grade, p.period, p.subject, round(p.b - b.state2025, 6) AS gap2025 FROM p LEFT JOIN bench b ON b.grade = p.grade AND b.subject = p.subject")
def table_cap(spark, sf_dir):
    raw = assessment(spark, sf_dir)
    return rounded(oa.table_rows(oa.detail_comparison(raw), oa.benchmark(oa.executive(raw))).select("unit", "grade", "period", "subject", "gap2025"))


@query(f"{_E}, s AS (SELECT grade AS name, avg(prof2024) AS a, avg(prof2025) AS b FROM executive GROUP BY grade) SELECT name, round(a, 6) AS prof2024, round(b, 6) AS prof2025, CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS place FROM s")
def series_order(spark, sf_dir):
    return rounded(oa.series(oa.executive(assessment(spark, sf_dir)), "grade").select("name", "prof2024", "prof2025", "place"))


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')}, t AS (SELECT count(*) AS total FROM latest WHERE contains(lower(unit_name), 'supplier')) SELECT total, total = 1 AS single, total BETWEEN 2 AND 30 AS within_cap, total > 30 AS over_cap, total BETWEEN 1 AND 30 AS detailed FROM t")
def match_flags(spark, sf_dir):
    return oa.match_state(oa.search_index(assessment(spark, sf_dir)), "Supplier")


@query(f"{_C} SELECT unit, grade, subject, CASE position WHEN 'DESTAQUE' THEN 'tone-destaque' WHEN 'RECUPERACAO' THEN 'tone-recuperacao' WHEN 'ATENCAO' THEN 'tone-atencao' WHEN 'PRIORIDADE' THEN 'tone-prioridade' ELSE 'tone-sem-referencia' END AS badge FROM compared")
def badges(spark, sf_dir):
    return _compared(spark, sf_dir).select("unit", "grade", "subject", orp.badge(F.col("position")).alias("badge"))


_VARIANTS = "WITH " + ASSESSMENT_SQL + ", v AS (SELECT *, 'all' AS variant FROM raw UNION ALL SELECT *, period FROM raw WHERE period IN ('MANHA', 'NOITE')), who AS (SELECT variant, unit, unit_name FROM (SELECT *, row_number() OVER (PARTITION BY variant, unit ORDER BY year DESC, ord) AS k FROM v) WHERE k = 1)"


@query(f"{_VARIANTS}, p AS (SELECT variant, unit, grade, subject, {_PAIR} FROM v GROUP BY ALL) SELECT variant, unit, unit_name, grade, subject, round(prof2024, 6) AS prof2024, round(prof2025, 6) AS prof2025 FROM p JOIN who USING (variant, unit)")
def executive_variants(spark, sf_dir):
    return rounded(oa.executive_variants(assessment(spark, sf_dir), ["MANHA", "NOITE"]).select("variant", "unit", "unit_name", "grade", "subject", "prof2024", "prof2025"))


@query(f"""WITH n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal END AS x FROM supplier), t AS (SELECT s_suppkey, x, CAST(floor(abs(x) * 10 + 0.5) AS BIGINT) AS t FROM n),
f AS (SELECT s_suppkey, x, CASE WHEN x IS NULL THEN '-' ELSE CASE WHEN x < 0 THEN '-' ELSE '' END || replace(format('{{:,}}', t // 10), ',', '.') || ',' || (t % 10) END AS number FROM t) SELECT s_suppkey, number, CASE WHEN x > 0 THEN '+' ELSE '' END || number AS signed FROM f""")
def number_formats(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("x"))
    return rows.select("s_suppkey", tx.number_text(F.col("x")).alias("number"), tx.signed_text(F.col("x")).alias("signed"))


@query(f"WITH {CATALOG_SQL}, p AS (SELECT a.code, b.code AS related, row_number() OVER (PARTITION BY a.code ORDER BY (a.object = b.object) DESC, b.code) AS place FROM catalog a JOIN catalog b ON a.subject = b.subject AND a.year = b.year AND nullif(a.unit, 'Brand#3') IS NOT DISTINCT FROM nullif(b.unit, 'Brand#3') AND a.code <> b.code) SELECT code, related, CAST(place AS INTEGER) AS place FROM p WHERE place <= 4")
def related_clashing(spark, sf_dir):
    """`related_group` where the keys have the names of helpers, and one is null."""
    records = catalog(spark, sf_dir).withColumnsRenamed({"subject": "g", "year": "k"}).withColumn("same", F.nullif("unit", F.lit("Brand#3")))
    return oc.related_by_group(records, ["g", "k", "same"])


@query(f"WITH {CATALOG_SQL} SELECT code FROM catalog ORDER BY ord LIMIT 36")
def load_more(spark, sf_dir):
    return oc.page(catalog(spark, sf_dir), 2).select("code")


@query(f"WITH {CATALOG_SQL} SELECT count(unit) > 0 AS any_unit, count(object) > 0 AS any_object, false AS any_field FROM catalog")
def existence_flags(spark, sf_dir):
    return oc.existence_flags(catalog(spark, sf_dir))


@query(f"WITH {CATALOG_SQL} SELECT subject, count(*) AS n FROM catalog GROUP BY subject")
def hub_totals(spark, sf_dir):
    return oc.hub_totals(catalog(spark, sf_dir))


@query(f"WITH {ASSESSMENT_SQL} SELECT unit, grade, period, subject, round(score, 6) AS score FROM raw WHERE network = 'ASIA' AND period = 'TARDE' AND year = 2025")
def row_filters(spark, sf_dir):
    return rounded(assessment(spark, sf_dir).where(oa.row_filter(network="ASIA", period="TARDE", year="2025")).select("unit", "grade", "period", "subject", "score"))


@query(f"WITH {ASSESSMENT_SQL}, {_LATEST.format('raw')} SELECT r.unit, r.period, r.year, round(r.score, 6) AS score, coalesce(l.unit_name, '') AS unit_name, coalesce(l.network, '') AS network FROM raw r LEFT JOIN (SELECT * FROM latest WHERE network <> 'ASIA') l USING (unit)")
def rehydrated(spark, sf_dir):
    raw = assessment(spark, sf_dir)
    known = oa.latest_identity(raw).where("network <> 'ASIA'")
    return rounded(oa.rehydrate(raw.select("unit", "period", "year", "score"), known).select("unit", "period", "year", "score", "unit_name", "network"))


@query("SELECT o_orderkey, CASE WHEN len(string_split(o_orderpriority, '-')) < 2 THEN ['constant'] ELSE [] END AS errors FROM (SELECT * FROM orders WHERE o_orderpriority NOT IN ('2-HIGH') OR o_orderstatus <> 'F')")
def constant_rules(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority <> '2-HIGH' or o_orderstatus <> 'F'")
    return ov.checked(orders, [ov.Rule("constant", F.size(F.split("o_orderpriority", "-")) < 2)]).select("o_orderkey", "errors")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 2 OR l_linenumber > 5 OR l_quantity > 40")
def array_range_rule(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("numbers", F.array(F.col("l_linenumber").cast("int"), F.when(F.col("l_quantity") <= 40, F.lit(3))))
    return ov.rejected(ov.checked(rows, [ov.ints_between("numbers", 2, 5)])).select("l_orderkey", "l_linenumber")


@query("WITH m AS (SELECT l_orderkey, list(DISTINCT l_linenumber ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(list_transform(n, lambda x: right('0' || x, 2)), ', ') AS numbers FROM m")
def padded_lists(spark, sf_dir):
    numbers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    return numbers.select("l_orderkey", ov.padded_list(F.col("n")).alias("numbers"))


_LISTED = "listed AS (SELECT (['Ensino ', 'ensino ', 'Água ', 'agua ', 'Zebra ', 'Ênfase ', 'a 0', ''])[CAST(p_partkey % 8 AS INTEGER) + 1] || p_size || (['', 'º ano', ' a 10', 'b'])[CAST(p_partkey % 4 AS INTEGER) + 1] AS label, p_brand AS brand FROM part)"


def _listed(spark: SparkSession, sf_dir: str) -> dict:
    n = F.col("p_partkey")
    start = F.element_at(F.array(*[F.lit(x) for x in ("Ensino ", "ensino ", "Água ", "agua ", "Zebra ", "Ênfase ", "a 0", "")]), (n % 8 + 1).cast("int"))
    end = F.element_at(F.array(*[F.lit(x) for x in ("", "º ano", " a 10", "b")]), (n % 4 + 1).cast("int"))
    return {"label": F.concat(start, F.col("p_size").cast("string"), end), "brand": F.col("p_brand")}


@query(f"WITH {_LISTED}, v AS (SELECT DISTINCT 'label' AS facet, label AS value FROM listed UNION SELECT 'brand', brand FROM listed), k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(value, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN right('000000000000000' || ltrim(x, '0'), 15) ELSE x END), '') AS key FROM v) SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY key COLLATE pt, value) AS INTEGER) AS place FROM k")
def facet_places(spark, sf_dir):
    return oc.option_places(table(spark, sf_dir, "part"), _listed(spark, sf_dir))


@query(f"WITH {_LISTED}, v AS (SELECT DISTINCT 'label' AS facet, label AS value FROM listed UNION SELECT 'brand', brand FROM listed) SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value COLLATE pt, value) AS INTEGER) AS place FROM v")
def option_places(spark, sf_dir):
    return oc.option_places(table(spark, sf_dir, "part"), _listed(spark, sf_dir), numeric=False)


#: A letter for each order, over the blocks of accented Latin, Greek, Cyrillic, extended Latin and extended Greek letters.
_BLOCKS = [(0x00C0, 0x0250), (0x0386, 0x03D0), (0x0400, 0x0483), (0x048A, 0x0530), (0x1E00, 0x1F00), (0x1F00, 0x1FB0)]
_LETTER_SQL = "CASE " + " ".join(f"WHEN k < {sum(b - a for a, b in _BLOCKS[: i + 1])} THEN k - {sum(b - a for a, b in _BLOCKS[:i])} + {a}" for i, (a, _) in enumerate(_BLOCKS)) + " END"
_LETTERS = f"letters AS (SELECT o_orderkey, 'a' || chr(CAST({_LETTER_SQL} AS INTEGER)) || 'z ' || o_orderpriority AS t FROM (SELECT *, o_orderkey % {sum(b - a for a, b in _BLOCKS)} AS k FROM orders))"


def _char(code):
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, code, done = F.col("o_orderkey") % sum(b - a for a, b in _BLOCKS), F.lit(None).cast("long"), 0
    for a, b in _BLOCKS:
        code = F.coalesce(code, F.when(k < done + b - a, k - done + a))
        done += b - a
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a"), _char(code), F.lit("z "), F.col("o_orderpriority")).alias("t"))


@query(f"WITH {_LETTERS} SELECT o_orderkey, lower(strip_accents(t)) AS folded FROM letters")
def fold_letters(spark, sf_dir):
    return _letters(spark, sf_dir).select("o_orderkey", tx.catalog_key(F.col("t")).alias("folded"))


@query(f"WITH {_LETTERS} SELECT o_orderkey, t = nfc_normalize(t) AND contains(lower(strip_accents(t)), lower(strip_accents(t))) AS found FROM letters")
def literal_letters(spark, sf_dir):
    """Every letter is found by the key of its text, and composed texts stay."""
    rows = _letters(spark, sf_dir)
    composed = F.col("t") == tx.composed(F.col("t"))
    return rows.select("o_orderkey", (composed & F.contains(tx.search_key(F.col("t")), tx.search_key(tx.decomposed(F.col("t"))))).alias("found"))


@query("WITH m AS (SELECT o_orderkey, chr(CAST(97 + o_orderkey % 26 AS INTEGER)) || chr(CAST(768 + o_orderkey // 26 % 112 AS INTEGER)) || chr(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 803 ELSE 769 END AS INTEGER)) || '  x' AS t FROM orders) SELECT o_orderkey, replace(nfc_normalize(t), '  ', ' ') AS cleaned FROM m")
def compose_marks(spark, sf_dir):
    n = F.col("o_orderkey")
    t = F.concat(_char(97 + n % 26), _char(768 + F.floor(n / 26) % 112), _char(F.when(n % 3 == 0, 803).otherwise(769)), F.lit("  x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.clean_lines(t).alias("cleaned"))


_MATCH = "(qu|er)[a-z]+"


@query(f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{_MATCH}') AS m, string_split_regex(text, '{_MATCH}') AS p FROM documents),
x AS (SELECT doc_id, unnest(m) AS match, unnest(p[1:len(m)]) AS piece, unnest(range(len(m))) AS match_no FROM t),
o AS (SELECT doc_id, match_no, match, CAST(sum(length(piece) + length(match)) OVER (PARTITION BY doc_id ORDER BY match_no) - length(match) AS BIGINT) AS start FROM x),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS page FROM documents),
s AS (SELECT doc_id, page, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l)
SELECT o.doc_id, CAST(match_no AS INTEGER) AS match_no, o.start, match, CAST(s.page AS INTEGER) AS page FROM o ASOF JOIN s ON o.doc_id = s.doc_id AND o.start >= s.start""")
def matches_on_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "line"))
    return ox.matches_on_pages(lines, ["doc_id"], "page", "line", _MATCH).select("doc_id", "match_no", F.col("start").cast("long").alias("start"), "match", "page")


_BOXES = "boxes AS (SELECT s_suppkey, (['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])[CAST(s_suppkey % 5 AS INTEGER) + 1] AS scope, CAST(s_suppkey * 71 % 2000 AS DOUBLE) AS top, CAST(s_suppkey * 71 % 2000 + s_suppkey % 90 AS DOUBLE) AS bottom, s_suppkey * 3701 % 300000 AS x0, s_suppkey * 3701 % 300000 + 40000 AS x1 FROM supplier)"


@query(f"WITH {_BOXES}, p AS (SELECT o_orderkey, o_orderpriority AS scope, CAST(date_diff('day', DATE '1995-01-01', o_orderdate) AS DOUBLE) AS y, o_totalprice AS x FROM orders) SELECT o_orderkey, s_suppkey FROM p JOIN boxes b ON b.scope = p.scope AND y >= top + 1 AND y < bottom - 1 AND x >= x0 AND x <= x1")
def boxes_join(spark, sf_dir):
    n = F.col("s_suppkey")
    scope = F.element_at(F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (n % 5 + 1).cast("int"))
    top, left = (n * 71 % 2000).cast("double"), (n * 3701 % 300000).cast("double")
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", scope.alias("scope"), top.alias("top"), (top + n % 90).alias("bottom"), left.alias("left"), (left + 40000).alias("right"))
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double")
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scope"), day.alias("y"), F.col("o_totalprice").alias("x"))
    return ox.in_boxes(points, boxes, ["scope"], "y", "x", (60.0, 40000.0), 1.0).select("o_orderkey", "s_suppkey")


_GAP = "CASE WHEN y - lag(y) OVER (PARTITION BY user_id ORDER BY y) > 86400 THEN 1 ELSE 0 END"


@query(f"""WITH e AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) AS y, event_type || CASE WHEN event_id % 4 = 0 THEN '/' WHEN event_id % 4 = 1 THEN ' ' ELSE '' END AS line FROM events),
i AS (SELECT user_id, y, rtrim(line) AS line, {_GAP} AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY y) AS paragraph FROM i)
SELECT user_id, CAST(paragraph AS BIGINT) AS paragraph, min(y) AS top, replace(string_agg(line, chr(10) ORDER BY y, line), '/' || chr(10), '/') AS line FROM g GROUP BY user_id, paragraph""")
def paragraph_fold(spark, sf_dir):
    tail = F.when(F.col("event_id") % 4 == 0, "/").when(F.col("event_id") % 4 == 1, " ").otherwise("")
    y = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    lines = table(spark, sf_dir, "events").select("user_id", y.alias("y"), F.concat("event_type", tail).alias("line"))
    return ox.paragraphs(lines, ["user_id"], "y", 86400.0, "line")


#: Twenty-three scopes, each with rules of its own: parameters follow the scope's number.
_SCOPES = 23
_SCOPE_RULES = [(f"s{i}", *rule) for i in range(_SCOPES) for rule in (
    (1, "type", "required", "kind", [], "reject"), (2, "code", "pattern", "code", [f"^EF[0-9]{{2}}LP[0-{i % 10}][0-9]$"], "reject"), (3, "size", "between", "number", ["1", str(20 + i)], "reject"),
    (4, "stage", "known", "stage", ["Ensino Médio"] if i % 4 == 0 else ["Ensino Médio", "Ensino Fundamental"], "warn"), (5, "skill", "constant", "kind", ["habilidade"], "warn" if i % 2 else "reject"),
    (6, "grade", "label", "grade", ["code", "3", "01", "1º ano", "12", "1º e 2º ano", "35", "3º ao 5º ano"], "warn"), (7, "digit", "digit", "first", ["code", "3"], "reject"), (8, "end", "ending", "area", ["R", "L", "Y"], "warn"),
)]
_RULED = """ruled AS (SELECT *, 's' || (ord % 23) AS scope, ord % 23 AS i, CASE WHEN ord % 7 = 0 THEN '0' ELSE substring(code, 3, 1) END AS first,
  CASE substring(code, 3, 2) WHEN '01' THEN '1º ano' WHEN '12' THEN '1º e 2º ano' WHEN '35' THEN '3º ano' WHEN '89' THEN '8º e 9º ano' END AS grade FROM coded),
broken AS (SELECT *, [
  CASE WHEN coalesce(trim(kind), '') = '' THEN 'type' END, CASE WHEN coalesce(regexp_matches(code, '^EF[0-9][0-9]LP[0-' || (i % 10) || '][0-9]$'), false) THEN NULL ELSE 'code' END,
  CASE WHEN number BETWEEN 1 AND 20 + i THEN NULL ELSE 'size' END, CASE WHEN i % 2 = 0 AND kind IS DISTINCT FROM 'habilidade' THEN 'skill' END, CASE WHEN coalesce(substring(code, 3, 1) = first, false) THEN NULL ELSE 'digit' END] AS bad,
  [CASE WHEN i % 4 = 0 AND stage <> 'Ensino Médio' THEN 'stage' END, CASE WHEN i % 2 = 1 AND kind IS DISTINCT FROM 'habilidade' THEN 'skill' END,
  CASE WHEN coalesce(CASE substring(code, 3, 2) WHEN '01' THEN '1º ano' WHEN '12' THEN '1º e 2º ano' WHEN '35' THEN '3º ao 5º ano' END = grade, false) THEN NULL ELSE 'grade' END, CASE WHEN right(trim(area), 1) IN ('R', 'L', 'Y') THEN NULL ELSE 'end' END] AS odd FROM ruled),
judged AS (SELECT *, list_filter(bad, lambda x: x IS NOT NULL) AS errors, list_filter(odd, lambda x: x IS NOT NULL) AS warnings FROM broken)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.substring("code", 3, 2)
    first = F.when(F.col("ord") % 7 == 0, "0").otherwise(F.substring("code", 3, 1))
    grade = F.when(key == "01", "1º ano").when(key == "12", "1º e 2º ano").when(key == "35", "3º ano").when(key == "89", "8º e 9º ano")
    records = _coded(spark, sf_dir).withColumns({"scope": F.concat(F.lit("s"), (F.col("ord") % _SCOPES).cast("string")), "first": first, "grade": grade})
    rules = spark.createDataFrame(_SCOPE_RULES, "scope string, seq int, rule string, kind string, column string, params array<string>, severity string")
    return ov.rules_by_scope(records, rules, "scope", ["kind", "code", "number", "stage", "grade", "first", "area"])


@query(f"WITH {_CODED}, {_RULED} SELECT ord, scope, errors, warnings FROM judged")
def rules_by_scope(spark, sf_dir):
    return _ruled(spark, sf_dir).select("ord", "scope", "errors", "warnings")


@query(f"WITH {_CODED}, {_RULED} SELECT scope, count(*) AS total, count(*) FILTER (len(errors) = 0) AS accepted, count(*) FILTER (len(errors) > 0) AS rejected, count(*) FILTER (len(warnings) > 0) AS warned, CASE WHEN count(*) FILTER (len(errors) > 0) = 0 THEN 'valido' ELSE 'revisao_necessaria' END AS status FROM judged GROUP BY scope")
def scope_reports(spark, sf_dir):
    return ov.scope_totals(_ruled(spark, sf_dir), "scope")


@query(f"WITH {_CODED}, {_GRADES} SELECT ord, NOT coalesce(years = CASE WHEN ord % 3 = 0 THEN '1º ano|2º ano' ELSE years END, years IS NULL AND ord % 3 <> 0) AS wrong_years, NOT coalesce(TRY_CAST(substring(code, 3, 1) AS INTEGER) = number % 4, false) AS wrong_digit FROM coded LEFT JOIN g ON substring(code, 3, 2) = k")
def code_rules(spark, sf_dir):
    records = oc.with_grades(_coded(spark, sf_dir)).withColumn("digit", F.col("number") % 4)
    records = records.withColumn("years", F.when(F.col("ord") % 3 == 0, F.array(F.lit("1º ano"), F.lit("2º ano"))).otherwise(F.col("grade_years")))
    out = ov.checked(records, [ov.array_equals("years", F.col("grade_years")), ov.digit_equals("digit", "code", 3)])
    return out.select("ord", F.array_contains("errors", "years:years").alias("wrong_years"), F.array_contains("errors", "digit:digit").alias("wrong_digit"))


@query(f"WITH {_CODED}, n AS (SELECT *, row_number() OVER (PARTITION BY subject, number ORDER BY ord) AS k FROM coded) SELECT ord, coalesce(number NOT BETWEEN 1 AND 40, true) AS outside, k > 1 AS repeated FROM n")
def numbered_once(spark, sf_dir):
    out = ov.checked(_coded(spark, sf_dir), ov.numbered_once("number", 40, ["ord"], ["subject"]))
    return out.select("ord", F.array_contains("errors", "number:number").alias("outside"), F.array_contains("errors", "repeated:number").alias("repeated"))


@query("SELECT s_suppkey, s_name AS a, 'x;' || s_nationkey || '\"y' AS b, '' AS c, CAST(s_acctbal AS VARCHAR) AS d FROM supplier")
def split_cells(spark, sf_dir):
    """Lines with quotes that open inside cells, doubled quotes and semicolons inside quotes, cut into the cells they were made of."""
    from plumbline.sources.files import split_cells as cut

    line = F.concat_ws(";", F.concat(F.substring("s_name", 1, 3), F.lit('"'), F.expr("substring(s_name, 4)"), F.lit('"')), F.concat(F.lit('"x;'), F.col("s_nationkey").cast("string"), F.lit('""y"')), F.lit('""'), F.col("s_acctbal").cast("string"))
    cells = table(spark, sf_dir, "supplier").select("s_suppkey", cut(line).alias("c"))
    return cells.select("s_suppkey", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("WITH c AS (SELECT p_type, CASE WHEN p_size > 20 THEN p_brand END AS unit, CASE WHEN p_type LIKE 'ECONOMY%' THEN p_name END AS field FROM part) SELECT p_type, count(unit) > 0 AS any_unit, false AS any_object, count(field) > 0 AS any_field FROM c GROUP BY p_type")
def existence_by_subject(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") > 20, F.col("p_brand")).alias("unit"), F.lit(None).cast("string").alias("object"), F.when(F.col("p_type").startswith("ECONOMY"), F.col("p_name")).alias("field"))
    return oc.existence_flags(part, ["p_type"])


def _day(column: str):
    """The day of a time: a stretch for hot scopes."""
    return F.date_diff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date"))


@query("SELECT event_id, last_value(nullif(CASE WHEN event_type = 'view' THEN event_type || event_id END, '') IGNORE NULLS) OVER (PARTITION BY event_type = 'error' ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events")
def forward_fill_stretches(spark, sf_dir):
    """Two scopes that hold all events, each filled in stretches of a day."""
    events = table(spark, sf_dir, "events").withColumn("wrong", F.col("event_type") == "error")
    value = F.when(F.col("event_type") == "view", F.concat("event_type", F.col("event_id").cast("string")))
    return ox.forward_fill(events, ["wrong"], ["ts", "event_id"], value, "seen", _day("ts")).select("event_id", "seen")


@query(ORACLES["asof_backward"])
def asof_stretches(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return ox.asof_backward(events.where("event_type = 'purchase'"), views, ["user_id"], "ts", "view_id", stretch=_day("ts")).select("event_id", "asof_view_id")


@query(ORACLES["gap_groups"])
def gap_groups_stretches(spark, sf_dir):
    return ox.gap_groups(table(spark, sf_dir, "events"), ["user_id"], "ts", F.expr("interval 1 day"), stretch=F.floor(_day("ts") / 30)).select("event_id", "island")


@query(ORACLES["adjacent_component"])
def adjacent_stretches(spark, sf_dir):
    return oc.neighbours(catalog(spark, sf_dir), ["subject"], F.floor(F.col("ord") / 100))
