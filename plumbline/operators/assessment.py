"""Paired-year assessment analytics.

Raw rows: year int, network, region, unit, unit_name, grade, period, subject string, score double, ord long (input order,
which settles every tie). Every function takes and returns DataFrames and leaves the physical plan to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import collated, finite, or_default, search_fold, search_key

#: The period whose row stands for a whole unit (fixed value).
WHOLE = "GERAL"
YEARS = (2024, 2025)
#: Statuses and tones of a variation (fixed values).
NO_COMPARISON, UP, DOWN, SMALL = "Sem comparação", "Evolução positiva", "Evolução negativa", "Pequena variação"


def variation(diff: Column) -> tuple[Column, Column]:
    """(status, tone) of a difference; the thresholds of 1 are strict."""
    status = F.when(diff.isNull(), NO_COMPARISON).when(diff > 1, UP).when(diff < -1, DOWN).otherwise(SMALL)
    tone = F.when(diff > 1, "positive").when(diff < -1, "negative").otherwise("neutral")
    return status, tone


def with_variation(df: DataFrame) -> DataFrame:
    """Adds diff, percent (null where the first year is 0), status and tone to rows with prof2024 and prof2025."""
    diff = F.col("prof2025") - F.col("prof2024")
    out = df.withColumns({"diff": diff, "percent": F.try_divide(diff, F.col("prof2024")) * 100})
    status, tone = variation(F.col("diff"))
    return out.withColumns({"status": status, "tone": tone})


def latest_identity(raw: DataFrame) -> DataFrame:
    """unit, unit_name, network, region as the highest year has them; of equal years the first row."""
    last = F.max_by(F.struct("unit_name", "network", "region"), F.struct("year", -F.col("ord"))).alias("i")
    return raw.groupBy("unit").agg(last).select("unit", "i.*")


def unit_aliases(raw: DataFrame) -> DataFrame:
    """(unit, alias, first_ord): names that a unit had beside its current one."""
    names = raw.groupBy("unit", "unit_name").agg(F.min("ord").alias("first_ord"))
    current = latest_identity(raw).select("unit", F.col("unit_name").alias("current"))
    return names.join(current, "unit").where("unit_name <> current").select("unit", F.col("unit_name").alias("alias"), "first_ord")


def alias_lists(raw: DataFrame) -> DataFrame:
    """(unit, aliases): the aliases of each renamed unit in order of first appearance."""
    each = unit_aliases(raw).groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("first_ord", "alias"))).alias("a"))
    return each.select("unit", F.col("a.alias").alias("aliases"))


def search_index(raw: DataFrame) -> DataFrame:
    """Identities with a search key over the current name and all aliases."""
    joined = latest_identity(raw).join(alias_lists(raw), "unit", "left")
    return joined.withColumn("search_key", search_key(F.concat_ws(" ", F.array("unit_name"), F.coalesce("aliases", F.array()))))


def mean(x: Column) -> Column:
    """The mean of a group's numbers, the same whatever order they are added in. An aggregate.

    Multiples of 2 ** -20 add up without rounding (sums up to 2 ** 33), and what is left of each number is so small that the
    rounding of its sum hardly ever reaches the mean's last bit. Numbers from 2 ** 30 on are added as they are.
    """
    high = F.when(F.abs(x) < 2.0**30, F.floor(x * 2.0**20) / 2.0**20).otherwise(0.0)
    return F.try_divide(F.sum(high) + F.sum(x - high), F.count(x))


def one_of_year(year: int, by: Column) -> Column:
    return F.max_by(F.when(F.col("year") == year, finite(F.col("score"))), F.when(F.col("year") == year, by))


def paid_years(df: DataFrame) -> DataFrame:
    """Rows that have a score in one of both years."""
    return df.where("prof2024 is not null or prof2025 is not null")


def _paired(raw: DataFrame, scope: list[str], keys: list[str], scores: list[Column]) -> DataFrame:
    """Scores by scope and keys, with variation and the scope's latest identity, in one pass over the raw rows.

    Every group carries the identity of its own latest row; a window over the groups, not the rows, picks the scope's.
    ord is that of the group's first row: groups stand in the order in which the input first names them.
    """
    when = F.struct("year", (-F.col("ord")).alias("_before"))
    who = F.max_by(F.struct("unit_name", "network", "region"), when)
    pairs = raw.groupBy(*scope, *keys).agg(*scores, F.min("ord").alias("ord"), who.alias("_who"), F.max(when).alias("_when"))
    latest = F.max_by("_who", "_when").over(Window.partitionBy(*scope))
    out = with_variation(paid_years(pairs.withColumn("_latest", latest)))
    return out.select(*[c for c in out.columns if c not in ("_who", "_when", "_latest")], "_latest.*")


def detail_comparison(raw: DataFrame) -> DataFrame:
    """One row per unit, grade, period and subject with both years' scores (the last row of a year wins) and variation."""
    return _paired(raw, ["unit"], ["grade", "period", "subject"], [one_of_year(y, F.col("ord")).alias(f"prof{y}") for y in YEARS])


def period_score(year: int | None = None) -> Column:
    """The first WHOLE row's score, else the mean over the periods; of one year if given. An aggregate."""
    of = F.lit(True) if year is None else F.col("year") == year
    score = finite(F.col("score"))
    whole = F.min_by(F.when(of & (F.col("period") == WHOLE), score), F.when(of & (F.col("period") == WHOLE), F.col("ord")))
    return F.coalesce(whole, mean(F.when(of, score)))


def period_dedup(raw: DataFrame) -> DataFrame:
    return raw.groupBy("unit", "grade", "subject", "year").agg(period_score().alias("score"))


def executive(raw: DataFrame, period: str | None = None) -> DataFrame:
    """One row per unit, grade and subject: periods reduced, years paired, latest identity, variation.

    period keeps only that period's rows before anything else. One aggregation over raw rows on (unit, grade, subject), then
    one exchange of its groups on unit.
    """
    rows = raw if period is None else raw.where(F.col("period") == period)
    return _paired(rows, ["unit"], ["grade", "subject"], [period_score(y).alias(f"prof{y}") for y in YEARS])


def executive_variants(raw: DataFrame, periods: list[str]) -> DataFrame:
    """The executive rows of all periods and of each single one, told apart by `variant`, for a table partitioned by it.

    A raw row counts for "all" and, if its period is asked for, for that: one aggregation for all variants.
    """
    variant = F.array_compact(F.array(F.lit("all"), F.when(F.col("period").isin(periods), F.col("period"))))
    rows = raw.withColumn("variant", F.explode(variant))
    return _paired(rows, ["variant", "unit"], ["grade", "subject"], [period_score(y).alias(f"prof{y}") for y in YEARS])


def state_filter(grade: str = "", subject: str = "", network: str = "") -> Column:
    """Equality on each given facet; an empty string does not filter."""
    out = F.lit(True)
    for name, value in (("grade", grade), ("subject", subject), ("network", network)):
        if value:
            out = out & (F.col(name) == value)
    return out


def row_filter(grade: str = "", subject: str = "", network: str = "", period: str = "", year: str = "") -> Column:
    """`state_filter` for raw rows, with period, and year unless it asks for the comparison of both."""
    out = state_filter(grade, subject, network)
    if period:
        out = out & (F.col("period") == period)
    if year and year != "Comparativo":
        out = out & (F.col("year") == int(year))
    return out


def restrict_to_year(df: DataFrame, year: str) -> DataFrame:
    """Only "2024" or "2025" of paired rows: the other year becomes null and the derived columns follow."""
    if year not in ("2024", "2025"):
        return df
    other = "prof2025" if year == "2024" else "prof2024"
    return with_variation(df.withColumn(other, F.lit(None).cast("double")))


def benchmark(rows: DataFrame) -> DataFrame:
    """Unweighted means of each grade and subject over executive rows, and how many units each mean has."""
    aggs = [f(F.col(f"prof{y}")).alias(f"{n}{y}") for y in YEARS for f, n in ((mean, "state"), (F.count, "units"))]
    return rows.groupBy("grade", "subject").agg(*aggs)


def position(gap24: Column, gap25: Column, diff: Column) -> tuple[Column, Column, Column]:
    """(key, label, tone) of a unit against its benchmark, first matching row of the decision table.

    Comparisons with an unknown change of gap are false. A gap of 0 counts as below.
    """
    change = gap25 - gap24
    rose = F.coalesce((diff > 1) | (change > 1), diff > 1, F.lit(False))
    fell = F.coalesce((diff < -1) | (change < -1), diff < -1, F.lit(False))
    # key, label, tone (fixed values)
    table = [
        (gap25.isNull(), "SEM_REFERENCIA", F.lit("Sem referência no recorte"), "neutral"),
        (diff.isNull(), "SEM_EVOLUCAO", F.concat(F.when(gap25 > 0, "Acima").otherwise("Abaixo"), F.lit(" do recorte, sem comparação anual")), "neutral"),
        ((gap25 > 0) & fell, "ATENCAO", F.lit("Atenção"), "attention"),
        (gap25 > 0, "DESTAQUE", F.lit("Destaque"), "positive"),
        (rose, "RECUPERACAO", F.lit("Em recuperação"), "info"),
        (fell, "PRIORIDADE", F.lit("Prioridade de análise"), "negative"),
        (F.lit(True), "RECUPERACAO", F.lit("Em recuperação"), "info"),
    ]
    key = label = tone = None
    for cond, k, text, t in table:
        key = F.when(cond, F.lit(k)) if key is None else key.when(cond, F.lit(k))
        label = F.when(cond, text) if label is None else label.when(cond, text)
        tone = F.when(cond, F.lit(t)) if tone is None else tone.when(cond, F.lit(t))
    return key, label, tone


def against_benchmark(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Executive rows with their benchmark, gaps, change of gap, and position. Rows without a benchmark stay."""
    joined = rows.join(bench.withColumn("has_reference", F.lit(True)), ["grade", "subject"], "left")
    out = joined.withColumns({
        "has_reference": F.coalesce("has_reference", F.lit(False)),
        "gap2024": F.col("prof2024") - F.col("state2024"),
        "gap2025": F.col("prof2025") - F.col("state2025"),
        "state_diff": F.col("state2025") - F.col("state2024"),
    })
    out = out.withColumn("gap_change", F.col("gap2025") - F.col("gap2024"))
    key, label, tone = position(F.col("gap2024"), F.col("gap2025"), F.col("diff"))
    return out.withColumns({"position": key, "position_label": label, "position_tone": tone})


def table_gap(detail: DataFrame, bench: DataFrame) -> DataFrame:
    """Period-level rows with the gap of 2025 to the executive benchmark of their grade and subject."""
    return detail.join(bench.select("grade", "subject", "state2025"), ["grade", "subject"], "left").withColumn("gap2025", F.col("prof2025") - F.col("state2025"))


def group_average(rows: DataFrame, key: str) -> DataFrame:
    """Means by one column, null and empty as "Nao informado"; diff is the mean of paired differences."""
    return rows.groupBy(or_default(F.col(key)).alias("name")).agg(*[mean(F.col(c)).alias(c) for c in ("prof2024", "prof2025", "diff")])


def subject_headline(rows: DataFrame) -> DataFrame:
    """Means by subject; here diff is the difference of the means, over unequal populations."""
    out = rows.groupBy("subject").agg(*[mean(F.col(f"prof{y}")).alias(f"mean{y}") for y in YEARS])
    out = out.withColumn("diff", F.col("mean2025") - F.col("mean2024"))
    return out.withColumn("tone", variation(F.col("diff"))[1])


def growth_ranking(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n rows that grew most, ties in input order."""
    return rows.where("diff > 1").orderBy(F.desc("diff"), "ord").limit(n)


def decline_ranking(rows: DataFrame, n: int = 8) -> DataFrame:
    """The n rows that fell most, ties in input order."""
    return rows.where("diff < -1").orderBy("diff", "ord").limit(n)


def selected_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    return rows.join(units.select("unit"), "unit", "left_semi")


def rehydrate(detail: DataFrame, identities: DataFrame) -> DataFrame:
    """Detail rows with their unit's current identity; an unknown unit gets empty texts."""
    out = detail.join(identities.select("unit", "unit_name", "network", "region"), "unit", "left")
    return out.na.fill("", ["unit_name", "network", "region"])


def series(rows: DataFrame, key: str) -> DataFrame:
    """Chart series: the means by one column that have a year at all, with their place in the alphabet of names."""
    means = paid_years(group_average(rows, key))
    return means.withColumn("place", F.row_number().over(Window.orderBy(collated(F.col("name")), "name")))  # a row for each name


def table_rows(detail: DataFrame, bench: DataFrame, n: int = 300) -> DataFrame:
    """The first rows of the detail table, in input order, with the gap to the benchmark."""
    return table_gap(detail.orderBy("ord").limit(n), bench)


def match_units(index: DataFrame, query: str, cap: int = 30) -> tuple[DataFrame, DataFrame]:
    """(first matches by name, one row of total and hidden); an empty query matches nothing."""
    hits = index.where(F.contains(F.col("search_key"), search_key(F.lit(query)))) if search_fold(query) else index.where(F.lit(False))
    counts = hits.agg(F.count("*").alias("total")).withColumn("hidden", F.greatest(F.col("total") - cap, F.lit(0)))
    return hits.orderBy(collated(F.col("unit_name")), "unit").limit(cap), counts


def match_state(index: DataFrame, query: str, cap: int = 30) -> DataFrame:
    """One row: how many units match, and whether that is one, several within the cap, or more than the cap."""
    total = F.col("total")
    _, counts = match_units(index, query, cap)
    return counts.select("total", (total == 1).alias("single"), total.between(2, cap).alias("within_cap"), (total > cap).alias("over_cap"), total.between(1, cap).alias("detailed"))
