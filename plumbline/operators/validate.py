"""Expectation rules, quarantine, coverage gaps, totals and status reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VALID, REVIEW = "valido", "revisao_necessaria"


@dataclass(frozen=True)
class Rule:
    """violated: true where a record breaks the rule. severity "reject" quarantines the record, "warn" only reports it."""

    id: str
    violated: Column
    severity: str = "reject"


def required(*columns: str) -> list[Rule]:
    return [Rule(f"required:{c}", F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in columns]


def pattern(column: str, regex: str) -> Rule:
    return Rule(f"pattern:{column}", ~F.coalesce(F.col(column).rlike(regex), F.lit(False)))


def one_of(column: str, allowed: Iterable[str]) -> Rule:
    return Rule(f"known:{column}", ~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def equals_lookup(column: str, expected: Column) -> Rule:
    return Rule(f"label:{column}", ~F.col(column).eqNullSafe(expected))


def ints_between(column: str, low: int, high: int) -> Rule:
    bad = (F.size(column) < 1) | F.exists(column, lambda x: x.isNull() | (x < low) | (x > high))
    return Rule(f"range:{column}", F.coalesce(bad, F.lit(True)))


def control_characters(column: str) -> Rule:
    """C0 controls but tab and line ends, and U+FFFD."""
    return Rule(f"control:{column}", F.coalesce(F.col(column).rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFD]"), F.lit(False)))


def final_punctuation(column: str, allowed: str = ".!?)\"”") -> Rule:
    return Rule(f"punctuation:{column}", ~F.coalesce(F.substring(F.trim(F.col(column)), -1, 1).isin(list(allowed)), F.lit(False)), "warn")


def lost_superscript(column: str) -> Rule:
    return Rule(f"superscript:{column}", F.coalesce(F.col(column).rlike(r"(?i)\b(ax|x|m|cm|km)2\b"), F.lit(False)), "warn")


def array_equals(column: str, expected: Column) -> Rule:
    """The array has the expected elements in the expected order."""
    return Rule(f"years:{column}", ~F.col(column).eqNullSafe(expected))


def digit_equals(column: str, code: str, place: int) -> Rule:
    """The digit at a place (from 1) of the code is the record's number."""
    return Rule(f"digit:{column}", ~F.coalesce(F.substring(code, place, 1).try_cast("int") == F.col(column), F.lit(False)))


def numbered_once(column: str, last: int, order: list[str], within: list[str] = ()) -> list[Rule]:
    """The number is from 1 to `last`, and of each number only the first record of its group in this order stands."""
    outside = Rule(f"number:{column}", ~F.coalesce(F.col(column).between(1, last), F.lit(False)))
    return [outside, Rule(f"repeated:{column}", F.row_number().over(Window.partitionBy(*within, column).orderBy(*order)) > 1)]


def duplicates(key: list[str], order: list[str]) -> Rule:
    """Every record but the first of its key, whether or not the first is otherwise valid."""
    return Rule("duplicate:" + ",".join(key), F.row_number().over(Window.partitionBy(*key).orderBy(*order)) > 1)


def checked(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """Records with `errors` and `warnings`: ids of the broken rules, in the order of the rules."""
    flags = {f"_r{i}": r.violated for i, r in enumerate(rules)}
    out = records.withColumns(flags)
    named = lambda severity: F.array_compact(F.array(*[F.when(F.col(f"_r{i}"), F.lit(r.id)) for i, r in enumerate(rules) if r.severity == severity]).cast("array<string>"))
    return out.withColumns({"errors": named("reject"), "warnings": named("warn")}).drop(*flags)


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.size("errors") == 0)


def rejected(records: DataFrame) -> DataFrame:
    return records.where(F.size("errors") > 0)


def rule_totals(records: DataFrame) -> DataFrame:
    """(rule, records that break it)."""
    return records.select(F.explode(F.concat("errors", "warnings")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def sequence_gaps(records: DataFrame, prefix: list[str], number: str, last: int | None = None) -> DataFrame:
    """Numbers missing from 1 to each prefix's greatest (or to `last`); a prefix without numbers has none.

    Between neighbouring numbers only the hole is spelt out, so the work is that of the records and of what is missing.
    """
    numbers = records.where(F.col(number).isNotNull()).select(*prefix, F.col(number).alias("_n")).distinct()
    inside = numbers.where(F.col("_n") >= 1 if last is None else F.col("_n").between(1, last))
    before = F.coalesce(F.lag("_n").over(Window.partitionBy(*prefix).orderBy("_n")), F.lit(0))
    holes = inside.select(*prefix, before.alias("_a"), F.col("_n").alias("_b"))
    if last is not None:
        # the hole behind the greatest number; a prefix whose numbers all lie outside misses everything
        ends = numbers.groupBy(*prefix).agg(F.coalesce(F.max(F.when(F.col("_n").between(1, last), F.col("_n"))), F.lit(0)).alias("_a"))
        holes = holes.unionByName(ends.withColumn("_b", F.lit(last + 1)))
    holes = holes.where(F.col("_b") - F.col("_a") > 1)
    return holes.select(*prefix, F.explode(F.sequence(F.col("_a") + 1, F.col("_b") - 1).cast(f"array<{dict(records.dtypes)[number]}>")).alias("missing"))


def padded_list(numbers: Column) -> Column:
    """Numbers of an array as text: two digits each, joined by commas."""
    return F.array_join(F.transform(numbers, lambda n: F.lpad(n.cast("string"), 2, "0")), ", ")


def totals(records: DataFrame, keys: list[str], known: DataFrame | None = None) -> DataFrame:
    """Counts by key; with `known` keys, those without records count 0."""
    counts = records.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts if known is None else known.join(counts, keys, "left").na.fill(0, ["n"])


def status(records: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """One row: total, accepted, rejected, warned, gaps, status. A rejected record or a gap asks for review."""
    out = records.agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("rejected"), F.count_if(F.size("warnings") > 0).alias("warned"))
    n = (gaps if gaps is not None else records.limit(0)).agg(F.count("*").alias("gaps"))
    out = out.crossJoin(n)  # one row beside one row
    return out.withColumn("status", F.when((F.col("rejected") == 0) & (F.col("gaps") == 0), VALID).otherwise(REVIEW))


def summary(records: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, n): counts by each facet and, as facet "total", of all, in one pass; nulls of a facet are not counted by it."""
    out = records.groupingSets([[f] for f in facets] + [[]], *facets).agg(F.count("*").alias("n"), *[F.grouping(f).alias(f"_{f}") for f in facets])
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for f in facets:
        facet, value = F.when(F.col(f"_{f}") == 0, f).otherwise(facet), F.when(F.col(f"_{f}") == 0, F.col(f).cast("string")).otherwise(value)
    return out.select(facet.alias("facet"), value.alias("value"), "n").where("facet = 'total' or value is not null")


def overall_status(reports: DataFrame) -> DataFrame:
    """One row: scopes, and "valido" if every scope's status is; without scopes it is."""
    every = F.coalesce(F.bool_and(F.coalesce(F.col("status") == VALID, F.lit(False))), F.lit(True))
    return reports.agg(F.count("*").alias("scopes"), F.when(every, VALID).otherwise(REVIEW).alias("status"))


def distinct_check(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys (null counts as one), and whether every row has a key of its own."""
    out = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct_keys"))
    return out.withColumn("unique", F.col("n") == F.col("distinct_keys"))


def key_mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has, each once; a null equals no other, so it is named for every side that has one.

    One aggregation over both sides' keys, so that each key leaves its task once however often it stands there.
    """
    a, b = left.select(F.col(key).alias("key"), F.lit(1).alias("_side")), right.select(F.col(key).alias("key"), F.lit(2).alias("_side"))
    held = a.union(b).groupBy("key").agg(F.bit_or("_side").alias("_held"))
    alone = lambda bit, side: F.when((F.col("_held") == bit) | (F.col("key").isNull() & (F.col("_held") == 3)), side)
    return held.where("key is null or _held < 3").select(F.explode(F.array_compact(F.array(alone(1, "left"), alone(2, "right")))).alias("side"), "key")


def fixed_range_gaps(records: DataFrame, number: str, last: int) -> DataFrame:
    """Numbers from 1 to `last` that no record has; all of them if there is no record."""
    wanted = records.sparkSession.range(1, last + 1).select(F.col("id").cast("int").alias("missing"))
    return wanted.join(records.select(F.col(number).alias("_have")), F.col("missing") == F.col("_have"), "left_anti")


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def publish(spark: SparkSession, staged: str, path: str) -> None:
    """Put a staged folder in the place of the one at path by renaming; a failure leaves the old one there."""
    fs, at = _folder(spark, path)
    old = at(f"{path}-old-{uuid.uuid4().hex}")
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), old):
        raise OSError(f"cannot move {path}")
    if not fs.rename(at(staged), at(path)):
        if had:
            fs.rename(old, at(path))
        raise OSError(f"cannot publish {path}")
    if had:
        fs.delete(old, True)


def write_if_valid(records: DataFrame, gaps: DataFrame | None, dataset_path: str, report_path: str, check_only: bool = False) -> bool:
    """Publish the status report always and the accepted records only if the status is valid; if check_only, neither.

    Records are evaluated once, into a staged table beside the dataset. The report and the dataset come from that table,
    the dataset is counted against the report, and only then do both take the places of their predecessors, by renaming.
    Whatever fails before leaves the published ones as they were; staged folders go in any case.
    """
    spark = records.sparkSession
    mark = uuid.uuid4().hex
    checked_, data, told = (f"{path}-staged-{name}-{mark}" for path, name in ((dataset_path, "checked"), (dataset_path, "accepted"), (report_path, "report")))
    try:
        records.write.parquet(checked_)
        kept = spark.read.schema(records.schema).parquet(checked_)
        status(kept, gaps).write.json(told)
        report = spark.read.json(told).first()
        ok = report["status"] == VALID
        if ok and not check_only:
            accepted(kept).drop("errors", "warnings").write.parquet(data)
            if (n := spark.read.parquet(data).count()) != report["accepted"]:
                raise OSError(f"{n} records were written, {report['accepted']} were accepted")
        if not check_only:
            publish(spark, told, report_path)
        if ok and not check_only:
            publish(spark, data, dataset_path)
        return ok
    finally:
        for path in (checked_, data, told):
            fs, at = _folder(spark, path)
            fs.delete(at(path), True)


def guarded_enrichment(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Join a column only if both sides have the same keys, else leave it null in every row; `key_mismatches` names the keys.

    The guard is a scalar subquery of the same plan: nothing runs before the caller's action.
    """
    fits = key_mismatches(left, right, key).agg((F.count("*") == 0).alias("fits")).scalar()
    return left.join(right.select(key, column), key, "left").withColumn(column, F.when(fits, F.col(column)))


#: What a rule row's kind tests, given the value of its column as text, its parameters, and its record's values by column.
RULE_KINDS = {
    "required": lambda v, p, all_: F.coalesce(F.trim(v), F.lit("")) != "",
    "pattern": lambda v, p, all_: F.rlike(v, p[0]),
    "known": lambda v, p, all_: F.array_contains(p, v),
    "constant": lambda v, p, all_: v == p[0],
    "between": lambda v, p, all_: v.try_cast("double").between(p[0].try_cast("double"), p[1].try_cast("double")),
    "ending": lambda v, p, all_: F.array_contains(p, F.substring(F.trim(v), -1, 1)),
    "digit": lambda v, p, all_: F.substring(F.try_element_at(all_, p[0]), p[1].cast("int"), 1) == v,
    "label": lambda v, p, all_: F.try_element_at(F.map_from_arrays(F.filter(p, lambda _, i: (i > 1) & (i % 2 == 0)), F.filter(p, lambda _, i: (i > 1) & (i % 2 == 1))), F.substring(F.try_element_at(all_, p[0]), p[1].cast("int"), 2)) == v,
}


def rules_by_scope(records: DataFrame, rules: DataFrame, scope: str, columns: list[str]) -> DataFrame:
    """Records with the `errors` and `warnings` of the rules of their scope, all scopes in one pass.

    rules: rows of (scope, seq, rule, kind, column, params array<string>, severity). kind is one of RULE_KINDS; column is one
    of `columns`. A record breaks a rule unless its test is true; null fails. "label" looks two characters of a column
    (params: column, place, key, value, key, value ...) up, "digit" takes one (params: column, place). The ids of the broken
    rules come in order of seq. A scope without rules has no errors; an unknown kind fails the query.
    """
    each = rules.groupBy(F.col("scope").alias("_scope")).agg(F.array_sort(F.collect_list(F.struct("seq", "rule", "kind", "column", "params", "severity"))).alias("_rules"))
    values = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])

    def broken(rule: Column) -> Column:
        value = F.try_element_at(F.col("_values"), rule["column"])
        test = F.lit(None).cast("boolean")
        for kind, holds in RULE_KINDS.items():
            test = F.when(rule["kind"] == kind, holds(value, rule["params"], F.col("_values"))).otherwise(test)
        known = rule["kind"].isin(list(RULE_KINDS))
        return F.when(~known, F.raise_error(F.concat(F.lit("no such kind of rule: "), rule["kind"])).cast("boolean")).otherwise(~F.coalesce(test, F.lit(False)))

    out = records.withColumn("_values", values).join(each, F.col(scope) == F.col("_scope"), "left")
    out = out.withColumn("_broken", F.filter(F.coalesce("_rules", F.array().cast(dict(each.dtypes)["_rules"])), broken))
    named = lambda severity: F.transform(F.filter("_broken", lambda r: r["severity"] == severity), lambda r: r["rule"])
    return out.withColumns({"errors": named("reject"), "warnings": named("warn")}).drop("_values", "_scope", "_rules", "_broken")


def scope_totals(records: DataFrame, scope: str) -> DataFrame:
    """(scope, total, accepted, rejected, warned, status) of checked records, all scopes in one pass."""
    out = records.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("total"), F.count_if(F.size("errors") == 0).alias("accepted"), F.count_if(F.size("errors") > 0).alias("rejected"), F.count_if(F.size("warnings") > 0).alias("warned"))
    return out.withColumn("status", F.when(F.col("rejected") == 0, VALID).otherwise(REVIEW))
