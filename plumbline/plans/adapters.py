"""The driver's tables in the shape that the operators take, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.catalog import GRADE_KEYS, grade_label, grade_years


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw score rows: suppliers as units, two ship years, part types as periods; some units lack a year or whole rows."""
    t = lambda n: table(spark, sf_dir, n)
    year = F.year("l_shipdate")
    lines = t("lineitem").where(year.isin(2000, 2001) & ~((F.col("l_suppkey") % 7 == 1) & (year == 2001)) & ~((F.col("l_suppkey") % 7 == 2) & (year == 2000)))
    period = F.when(F.col("p_type").startswith("ECONOMY"), "MANHA").when(F.col("p_type").startswith("SMALL"), "TARDE").otherwise("NOITE")
    lines = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", (year + 24).alias("year"), F.col("l_returnflag").alias("grade"), F.col("l_linestatus").alias("subject"), period.alias("period"), "l_quantity")
    # partial sums by supplier before any dimension is joined
    keys = ["l_suppkey", "year", "grade", "subject"]
    by_period = lines.groupBy(*keys, "period").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    rows = by_period.groupingSets([[*keys, "period"], keys], *keys, "period").agg(F.sum("q").alias("q"), F.sum("n").alias("n"), F.grouping("period").alias("whole"))
    rows = rows.where("whole = 0 or l_suppkey % 3 <> 0").withColumn("period", F.when(F.col("whole") == 1, "GERAL").otherwise(F.col("period")))
    units = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "s_nationkey", "r_name")
    rows = rows.join(units, F.col("l_suppkey") == F.col("s_suppkey"))
    renamed = (F.col("year") == 2025) & (F.col("l_suppkey") % 10 == 3)
    places = F.array(*[F.lit(p) for p in ("GERAL", "MANHA", "TARDE", "NOITE")])
    return rows.select(
        "year",
        F.col("r_name").alias("network"),
        F.col("s_nationkey").cast("string").alias("region"),
        F.col("l_suppkey").cast("string").alias("unit"),
        F.when(renamed, F.concat("s_name", F.lit(" (NEW)"))).otherwise(F.col("s_name")).alias("unit_name"),
        "grade", "period", "subject",
        (F.col("q") / F.col("n")).alias("score"),
        # input order: by year, then the last supplier first
        ((F.col("year") - 2024).cast("long") * 10**12 + (10**9 - F.col("l_suppkey")) * 1000 + F.locate("A", "grade") * 100 + F.locate("N", "grade") * 200 + F.locate("R", "grade") * 300 + F.locate("O", "subject") * 10 + F.array_position(places, F.col("period"))).alias("ord"),
    )


ASSESSMENT_SQL = """
lines AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) + 24 AS year, l_returnflag AS grade, l_linestatus AS subject, l_quantity,
         CASE WHEN p_type LIKE 'ECONOMY%' THEN 'MANHA' WHEN p_type LIKE 'SMALL%' THEN 'TARDE' ELSE 'NOITE' END AS period
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE year(l_shipdate) IN (2000, 2001) AND NOT (l_suppkey % 7 = 1 AND year(l_shipdate) = 2001) AND NOT (l_suppkey % 7 = 2 AND year(l_shipdate) = 2000)),
scored AS (
  SELECT l_suppkey, year, grade, subject, period, sum(l_quantity) / count(*) AS score FROM lines GROUP BY ALL
  UNION ALL
  SELECT l_suppkey, year, grade, subject, 'GERAL', sum(l_quantity) / count(*) FROM lines WHERE l_suppkey % 3 <> 0 GROUP BY l_suppkey, year, grade, subject),
raw AS (
  SELECT year, r_name AS network, CAST(s_nationkey AS VARCHAR) AS region, CAST(l_suppkey AS VARCHAR) AS unit,
         CASE WHEN year = 2025 AND l_suppkey % 10 = 3 THEN s_name || ' (NEW)' ELSE s_name END AS unit_name, grade, period, subject, score,
         CAST(year - 2024 AS BIGINT) * 1000000000000 + (1000000000 - l_suppkey) * 1000 + list_position(['A', 'N', 'R'], grade) * 100 + (subject = 'O')::INT * 10 + list_position(['GERAL', 'MANHA', 'TARDE', 'NOITE'], period) AS ord
  FROM scored JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue records over `part`."""
    gk = (F.col("p_size") % 15 + 1).cast("int")
    labels = F.array(*[F.lit(grade_label(g)) for g in GRADE_KEYS])
    years = F.array(*[F.array(*[F.lit(y) for y in grade_years(g)]) for g in GRADE_KEYS])
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("code"), F.lit("habilidade").alias("kind"), F.col("p_type").alias("subject"), F.element_at(labels, gk).alias("year"), F.element_at(years, gk).alias("years"),
        F.col("p_brand").alias("unit"), F.col("p_size").cast("string").alias("object"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("area"),
        F.array_distinct(F.array((F.col("p_partkey") % 7 + 1).cast("int"), (F.col("p_partkey") % 5 + 1).cast("int"))).alias("skills"), F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"),
    )


#: Labels and years of the fifteen grade keys, written out for the oracles (fixed values).
GRADES_SQL = """(VALUES
  ('01', '1º ano', ['1º ano']), ('02', '2º ano', ['2º ano']), ('03', '3º ano', ['3º ano']), ('04', '4º ano', ['4º ano']), ('05', '5º ano', ['5º ano']),
  ('06', '6º ano', ['6º ano']), ('07', '7º ano', ['7º ano']), ('08', '8º ano', ['8º ano']), ('09', '9º ano', ['9º ano']),
  ('12', '1º e 2º ano', ['1º ano', '2º ano']), ('35', '3º ao 5º ano', ['3º ano', '4º ano', '5º ano']),
  ('15', '1º ao 5º ano', ['1º ano', '2º ano', '3º ano', '4º ano', '5º ano']), ('67', '6º e 7º ano', ['6º ano', '7º ano']),
  ('89', '8º e 9º ano', ['8º ano', '9º ano']), ('69', '6º ao 9º ano', ['6º ano', '7º ano', '8º ano', '9º ano']))"""
CATALOG_SQL = f"""
grades AS (SELECT *, row_number() OVER () AS nth FROM {GRADES_SQL} AS g(k, label, years)),
catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS code, p_type AS subject, label AS year, years, p_brand AS unit, CAST(p_size AS VARCHAR) AS object,
         list_distinct([p_partkey % 7 + 1, p_partkey % 5 + 1]) AS skills, p_name AS text, p_partkey AS ord
  FROM part JOIN grades ON nth = p_size % 15 + 1)"""
