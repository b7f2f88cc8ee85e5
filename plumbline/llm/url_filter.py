"""URL filter: dated list entries become validity intervals, and each capture meets those that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def url_keys(url: Column) -> Column:
    """What a list may name of a URL: its host, each parent domain of two labels or more, and the host with its first path segment."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, SEGMENT, 1)
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(domains, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until): an "add" is valid until the next "remove" of the same list and key, exclusive, or for ever.

    Of several entries of one list, key and day a "remove" wins. A second "add" changes nothing.
    """
    daily = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')")
    daily = daily.groupBy("list", "key", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "key").orderBy("day")
    turns = daily.withColumn("before", F.lag("action").over(order)).where("before is null or before <> action")
    ended = turns.withColumn("until", F.lead("day").over(order)).where("action = 'add'")
    return ended.select("list", "key", F.col("day").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day") -> DataFrame:
    """Judge every capture: id, url, day, n_entries (active entries that name it), lists (their lists, sorted), blocked.

    entries: (list, key, day, action). Captures of one key and day meet the intervals once, however many they are: a host
    with a third of all captures comes down to its days before the join by key, and the way back joins on key and day.
    Nulls: a capture without URL, host or day is not blocked and has no lists; entries with a null are ignored. Repeated
    captures are judged alike, one row each. An empty capture table gives no rows, an empty list blocks nothing.
    """
    rows = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day")).withColumn("u", F.monotonically_increasing_id())
    rows = materialise(rows, "captures")
    each = rows.select("u", "day", F.explode(url_keys(F.col("url"))).alias("key")).where("day is not null")
    asked = each.groupBy("key", "day").agg(F.lit(1).alias("one")).select("key", "day")
    valid = materialise(intervals(entries), "intervals").withColumnRenamed("key", "named")
    active = (F.col("key") == F.col("named")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    hits = asked.join(valid, active).groupBy("key", "day").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("list")).alias("lists"))
    hits = materialise(hits, "active").withColumnsRenamed({"key": "hit_key", "day": "hit_day"})
    found = each.join(hits, (F.col("key") == F.col("hit_key")) & (F.col("day") == F.col("hit_day")))
    found = found.groupBy("u").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lists")))).alias("l"))
    out = rows.join(found.withColumnRenamed("u", "v"), F.col("u") == F.col("v"), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("day").alias(day_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("l", none).alias("lists"), F.col("n").isNotNull().alias("blocked"))


def _page_captures(pages: DataFrame) -> DataFrame:
    """`pages` has no fetch times: page n counts as fetched on day n modulo 360 of 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 360).cast("int")).alias("day"))


def _page_entries(pages: DataFrame) -> DataFrame:
    """Two dated lists over the pages' own keys of three labels or a path, by digits of the keys' MD5."""
    keys = pages.select(F.explode(url_keys(F.col("url"))).alias("key")).distinct().where(r"key like '%.%.%' or key like '%/%'")
    d = lambda k: F.ascii(F.substring(F.md5("key"), k, 1))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    keys = keys.withColumns({"a": d(1), "b": d(2), "c": d(3), "e": d(4)})
    entry = lambda name, n, action, cond: keys.where(cond).select(F.lit(name).alias("list"), "key", day(n).alias("day"), F.lit(action).alias("action"))
    b = F.col("b") * 2 - 96
    out = entry("abuse", b, "add", "a < 52").union(entry("abuse", b + 60, "remove", "a < 52 and c < 97")).union(entry("abuse", b + 150, "add", "a < 52 and c < 52"))
    return out.union(entry("spam", F.col("c") * 2 - 96, "add", "e < 50")).union(entry("spam", F.col("c") * 2 + 20, "remove", "e < 50 and b < 56"))


def op6_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_captures(_page_captures(pages), _page_entries(pages))
    return out.select("page_id", "url", "day", "n_entries", F.array_join("lists", ",").alias("lists"), "blocked")


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 360 AS INTEGER) AS day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS segment FROM pages),
labelled AS (SELECT *, string_split(host, '.') AS labels FROM parts WHERE host <> ''),
keyed AS (
  SELECT DISTINCT page_id, url, day, key FROM (
    SELECT page_id, url, day, array_to_string(list_slice(labels, i, len(labels)), '.') AS key FROM labelled, UNNEST(range(1, greatest(len(labels) - 1, 1) + 1)) AS r(i)
    UNION ALL SELECT page_id, url, day, host || '/' || segment FROM labelled WHERE segment <> '')),
keys AS (
  SELECT key, ascii(substr(md5(key), 1, 1)) AS a, ascii(substr(md5(key), 2, 1)) AS b, ascii(substr(md5(key), 3, 1)) AS c, ascii(substr(md5(key), 4, 1)) AS e
  FROM (SELECT DISTINCT key FROM keyed) WHERE key LIKE '%.%.%' OR key LIKE '%/%'),
entries AS (
  SELECT 'abuse' AS list, key, DATE '2024-01-01' + (b * 2 - 96) AS day, 'add' AS action FROM keys WHERE a < 52
  UNION ALL SELECT 'abuse', key, DATE '2024-01-01' + (b * 2 - 36), 'remove' FROM keys WHERE a < 52 AND c < 97
  UNION ALL SELECT 'abuse', key, DATE '2024-01-01' + (b * 2 + 54), 'add' FROM keys WHERE a < 52 AND c < 52
  UNION ALL SELECT 'spam', key, DATE '2024-01-01' + (c * 2 - 96), 'add' FROM keys WHERE e < 50
  UNION ALL SELECT 'spam', key, DATE '2024-01-01' + (c * 2 + 20), 'remove' FROM keys WHERE e < 50 AND b < 56),
daily AS (SELECT list, key, day, max(action) AS action FROM entries GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list, key ORDER BY day) AS before FROM daily) WHERE before IS NULL OR before <> action),
valid AS (SELECT list, key, day AS since, until FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM turns) WHERE action = 'add'),
hits AS (
  SELECT k.page_id, k.url, k.day, count(*) AS n, array_to_string(list_sort(list_distinct(list(v.list))), ',') AS lists
  FROM keyed k JOIN valid v ON v.key = k.key AND k.day >= v.since AND (v.until IS NULL OR k.day < v.until) GROUP BY ALL)
SELECT p.page_id, p.url, p.day, CAST(coalesce(h.n, 0) AS BIGINT) AS n_entries, coalesce(h.lists, '') AS lists, h.n IS NOT NULL AS blocked
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id
"""
