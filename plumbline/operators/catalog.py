"""Coded catalogues: union of sources, faceted and accent-free search, lookup, neighbours, related items, routes.

Records: code, kind, subject, year (label), years array<string>, unit, object, field, area, skills array<int>, text, ord.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import catalog_key, collated, holds, natural_order, parse_query, slug


#: Grade keys of codes, in order: single years, then ranges from the first digit to the second (fixed values).
GRADE_KEYS = ["01", "02", "03", "04", "05", "06", "07", "08", "09", "12", "35", "15", "67", "89", "69"]
#: Kinds of records (fixed values).
GENERAL, SPECIFIC, SKILL = "competencia_geral", "competencia_especifica", "habilidade"


def grade_years(key: str) -> list[str]:
    first, last = int(key[0]) or int(key[1]), int(key[1])
    return [f"{y}º ano" for y in range(first, last + 1)]


def grade_label(key: str) -> str:
    """One year, two years joined by "e", or a range by "ao"."""
    first, last = int(key[0]), int(key[1])
    return f"{last}º ano" if first == 0 else f"{first}º {'e' if last == first + 1 else 'ao'} {last}º ano"


def grade_dimension(spark: SparkSession) -> DataFrame:
    """(grade_key, label, years) of all grade keys."""
    return spark.createDataFrame([(k, grade_label(k), grade_years(k)) for k in GRADE_KEYS], "grade_key string, grade_label string, grade_years array<string>")


def with_grades(records: DataFrame, code: str = "code") -> DataFrame:
    """Records with the label and years that their code's third and fourth characters stand for; null where they stand for none."""
    key = F.substring(F.col(code), 3, 2)
    return records.join(F.broadcast(grade_dimension(records.sparkSession)), key == F.col("grade_key"), "left")  # fifteen rows


def dataset_order() -> list[Column]:
    """The order of a written dataset: specific competences before skills, then by code, then by number."""
    return [F.when(F.col("kind") == SPECIFIC, 0).otherwise(1), F.coalesce("code", F.lit("")), F.coalesce("number", F.lit(0))]


def of_kind(records: DataFrame, *kinds: str) -> DataFrame:
    return records.where(F.col("kind").isin(*kinds))


def object_label() -> Column:
    """The object's lines on one line."""
    return F.replace(F.col("object"), F.lit("\n"), F.lit(" · "))


def object_lines() -> Column:
    return F.split("object", "\n")


def mapped_slug(x: Column, known: dict[str, str]) -> Column:
    """The known slug of a name, else one made of the name."""
    table = F.create_map(*[F.lit(v) for pair in known.items() for v in pair]) if known else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, x), slug(x))


def record_label() -> Column:
    """What a record is, by its kind and stage (texts are fixed values)."""
    number = F.col("number").cast("string")
    parts = lambda *xs: F.concat(*[y for i, x in enumerate(xs) for y in ([F.lit(" · ")] if i else []) + [F.coalesce(x, F.lit(""))]])
    return (
        F.when(F.col("kind") == GENERAL, F.concat(F.lit("Competência geral · Competência "), number, F.lit(" de 10")))
        .when(F.col("kind") == SPECIFIC, parts(F.lit("Competência específica"), F.col("area"), F.concat(F.lit("Competência "), number)))
        .when(F.col("stage") == "Ensino Médio", parts(F.lit("Habilidade"), F.col("stage"), F.col("area"), F.col("subject")))
        .otherwise(parts(F.lit("Habilidade"), F.col("stage"), F.col("year"), F.col("subject")))
    )


def record_href(root: str, area_slugs: dict[str, str]) -> Column:
    """The link of a record, by its kind; an area without a slug leaves its place empty."""
    anchor = F.concat(F.lit("#competencia-"), F.col("number").cast("string"))
    table = F.create_map(*[F.lit(v) for pair in area_slugs.items() for v in pair]) if area_slugs else F.create_map().cast("map<string,string>")
    area = F.coalesce(F.try_element_at(table, F.col("area")), F.lit(""))
    return (
        F.when(F.col("kind") == GENERAL, F.concat(F.lit(f"{root}/competencias-gerais"), anchor))
        .when(F.col("kind") == SPECIFIC, F.concat(F.lit(f"{root}/ensino-medio/"), area, anchor))
        .otherwise(F.concat(F.lit(f"{root}/"), F.lower("code")))
    )


def dependent_facets(records: DataFrame, year: str = "", unit: str = "") -> DataFrame:
    """(facet, value): years of all records, units of the records of the year, objects of those of the year and unit.

    One pass: every record offers its values, with the facets that it may serve.
    """
    in_year = F.array_contains(F.coalesce("years", F.array("year")), year) if year else F.lit(True)
    in_unit = F.coalesce(unit_of() == unit, F.lit(False)) if unit else F.lit(True)
    pair = lambda name, x: F.struct(F.lit(name).alias("facet"), x.alias("value"))
    years = F.transform(F.coalesce("years", F.array("year")), lambda y: pair("year", y))
    units = F.when(in_year, F.array(pair("unit", unit_of()))).otherwise(F.array().cast(_FACETS))
    objects = F.when(in_year & in_unit, F.array(pair("object", F.col("object")))).otherwise(F.array().cast(_FACETS))
    offered = records.select(F.explode(F.concat(years, units, objects)).alias("f")).select("f.*")
    return offered.where("value is not null and value <> ''").distinct()


_FACETS = "array<struct<facet:string,value:string>>"


def union_records(*sources: DataFrame) -> DataFrame:
    """All records of all sources, in the order given; a column that a source lacks is null."""
    tagged = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def unit_of() -> Column:
    return F.coalesce(F.col("unit"), F.col("field"))


def matches(query: str = "", year: str = "", skill: str = "", unit: str = "", obj: str = "") -> Column:
    """The filter of the catalogue: grade in the record's years, skill number, unit or field, object, folded free text.

    A grade named in the query counts unless `year` is given, and leaves the text either way. A skill that is no number
    matches nothing. The text is sought in the record's texts joined by spaces, across their borders.
    """
    parsed = parse_query(query)
    out = F.lit(True)
    if grade := year or parsed.year:
        out = out & F.array_contains(F.coalesce("years", F.array("year")), grade)
    if skill:
        out = out & (F.array_contains("skills", int(skill)) if skill.strip().lstrip("+-").isdigit() else F.lit(False))
    if unit:
        out = out & ((F.col("unit") == unit) | (F.col("field") == unit))
    if obj:
        out = out & (F.col("object") == obj)
    if parsed.text:
        hay = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("code", "text", "object", "unit", "field", "subject", "area")])
        out = out & holds(hay, catalog_key, parsed.text)
    return F.coalesce(out, F.lit(False))


def lookup(records: DataFrame, code: str) -> DataFrame:
    """The first record with this code, in either case."""
    return records.where(F.lower("code") == code.lower()).orderBy("ord").limit(1)


def neighbours(records: DataFrame, within: list[str], stretch: Column | None = None) -> DataFrame:
    """Each record with the code before and after it in its group, in catalogue order.

    stretch: a number that never falls along ord. A group is then taken stretch by stretch, and the first and last records
    of a stretch look into the ones beside it: no task sees a whole hot group.
    """
    keys = within if stretch is None else [*within, "_stretch"]
    w = Window.partitionBy(*keys).orderBy("ord")
    cut = records if stretch is None else records.withColumn("_stretch", stretch)
    near = cut.select("code", *keys, F.lag("code").over(w).alias("previous"), F.lead("code").over(w).alias("next"), F.row_number().over(w).alias("_k"), "ord")
    if stretch is None:
        return near.drop("_k", "ord")
    ends = cut.groupBy(*keys).agg(F.min_by("code", "ord").alias("_first"), F.max_by("code", "ord").alias("_last"), F.max("ord").alias("_end"))
    along = Window.partitionBy(*within).orderBy("_stretch")
    ends = ends.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], "_end", F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_behind"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    previous, following = F.when(F.col("_k") == 1, F.col("_before")).otherwise(F.col("previous")), F.when(F.col("ord") == F.col("_end"), F.col("_behind")).otherwise(F.col("next"))
    return near.join(ends, same).select("code", *within, previous.alias("previous"), following.alias("next"))


def related_by_group(records: DataFrame, keys: list[str], n: int = 4) -> DataFrame:
    """For each record up to n others that agree on all keys (null equals null): same object first, then by code.

    Candidates come down to a few per group before any join: of its own object a record can need the n + 1 first codes; of
    other objects the n first, and these are among the group's 2n first once each object offers n at most.
    """
    base = records.select("code", "object", F.struct(*keys).alias("_g"))
    ranked = base.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "object").orderBy("code")))
    near = ranked.where(F.col("_k") <= n + 1)
    far = ranked.where(F.col("_k") <= n).withColumn("_n", F.row_number().over(Window.partitionBy("_g").orderBy("code"))).where(F.col("_n") <= 2 * n)
    same_keys = F.col("a._g").eqNullSafe(F.col("b._g"))
    same_object = F.col("a.object").eqNullSafe(F.col("b.object"))

    def pairs(others: DataFrame, cond: Column, same: bool) -> DataFrame:
        joined = base.alias("a").join(others.alias("b"), same_keys & cond & (F.col("a.code") != F.col("b.code")))
        return joined.select(F.col("a.code").alias("code"), F.col("b.code").alias("related"), F.lit(same).alias("same"))

    both = pairs(near, same_object, True).union(pairs(far, ~same_object, False))
    w = Window.partitionBy("code").orderBy(F.desc("same"), "related")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("code", "related", "place")


def related_by_overlap(records: DataFrame, within: list[str], array: str, n: int = 4) -> DataFrame:
    """For each record up to n others of its group that share an array element, by code: explode and equi-join, not a theta join.

    Each (group, element) keeps its n + 1 first codes before the join: of more, none could be among a record's first n. A
    record meets them as one list for each of its elements, not as a pair for each code. The records are dealt by code
    before they grow, so that a small file's few tasks don't hold all their lists.
    """
    base = records.select("code", F.struct(*within).alias("_g"), F.array_distinct(array).alias("_a")).repartition("code")
    each = base.select("code", "_g", F.explode("_a").alias("_e"))
    first = each.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_e").orderBy("code"))).where(F.col("_k") <= n + 1)
    lists = first.groupBy(F.col("_g").alias("_og"), F.col("_e").alias("_oe")).agg(F.collect_list("code").alias("_codes"))
    met = each.join(lists, F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_e") == F.col("_oe"))).select("code", "_codes")
    others = F.filter(F.flatten(F.collect_list("_codes")), lambda c: c != F.col("code"))
    near = met.groupBy("code").agg(others.alias("_o")).select("code", F.slice(F.array_sort(F.array_distinct("_o")), 1, n).alias("_o"))
    return near.select("code", F.posexplode("_o").alias("place", "related")).select("code", "related", (F.col("place") + 1).alias("place"))


def facet(records: DataFrame, value: Column, where: Column | None = None) -> DataFrame:
    """Distinct non-empty values of a facet among the records that satisfy a condition, in alphabetical order, numbers by value."""
    rows = records if where is None else records.where(where)
    return rows.select(value.alias("value")).where("value is not null and value <> ''").distinct().orderBy(natural_order(F.col("value")), "value")


def option_places(records: DataFrame, facets: dict[str, Column], numeric: bool = True) -> DataFrame:
    """(facet, value, place): the distinct non-empty values of several facets, each with its place in its facet's list, from 1.

    Alphabetical in the site's language; with `numeric`, runs of digits compare as numbers. Values that compare equal stand
    by their code points. One pass over the records; after it a facet's list has each value once.
    """
    offered = F.explode(F.array(*[F.struct(F.lit(name).alias("facet"), value.cast("string").alias("value")) for name, value in facets.items()]))
    values = records.select(offered.alias("f")).select("f.*").where("value is not null and value <> ''").distinct()
    order = (natural_order if numeric else collated)(F.col("value"))
    return values.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(order, "value")))


def routes(records: DataFrame, valid_years: list[str]) -> DataFrame:
    """URLs: one per subject, per subject and valid year, and per code."""
    subject = F.concat(F.lit("/"), slug(F.col("subject")))
    hubs = records.select(subject.alias("url"))
    years = records.select(subject.alias("s"), F.explode("years").alias("y")).where(F.col("y").isin(valid_years)).select(F.concat("s", F.lit("/"), F.substring("y", 1, 1), F.lit("-ano")).alias("url"))
    codes = records.where("code is not null").select(F.concat(F.lit("/c/"), F.lower("code")).alias("url"))
    return hubs.distinct().union(years.distinct()).union(codes)


def page(records: DataFrame, number: int, size: int = 18) -> DataFrame:
    """The records of pages 1 to `number`, in catalogue order."""
    return records.orderBy("ord").limit(size * number)


def existence_flags(records: DataFrame, within: Iterable[str] = ()) -> DataFrame:
    """One row, or one of each group: whether any record has a unit, an object, a field."""
    return records.groupBy(*within).agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(f"any_{c}") for c in ("unit", "object", "field")])


def hub_totals(records: DataFrame) -> DataFrame:
    return records.groupBy("subject").agg(F.count("*").alias("n"))
