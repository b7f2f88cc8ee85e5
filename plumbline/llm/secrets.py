"""Secret scan: base patterns, and corpus-wide ownership frequency of candidate hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, materialise, table
from .spans import count_of, listed, none, ordered, spans

#: The base patterns (fixed values of the contract, stated so that Java's engine takes linear time).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: A bare token that may be a credential: long, letters and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}+"
#: A value that at most so many owners have is theirs; one that more share is an example.
OWNERS = 2
#: A bare token needs this many different characters to count by itself.
DISTINCT_CHARACTERS = 12


def base_spans(text: Column) -> Column:
    assign = F.filter(spans(text, ASSIGN, "assign", 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    return ordered(assign, spans(text, ACCESS, "access", 1, text.contains("AKIA")), spans(text, HEX, "hex", 2))


def secret_of(span: Column) -> Column:
    """What a span keeps secret: the value of an assignment, else the match."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", owners: int = OWNERS) -> DataFrame:
    """Secrets of every text: (id, base, found): arrays of spans (start, end, kind, value, n_owners, n_repos, verdict).

    base: matches of the base patterns. found: base, and bare tokens that the method adds. Every candidate (the value of a
    base match, or a bare token of 16 characters or more with letters and digits) is hashed and counted over the whole
    corpus by distinct repositories and owners. verdict is "example" for a value that more than `owners` owners have, else
    "owned". A bare token outside the base matches is added, as kind "reused", if it is owned and some document has it in
    a base match, or, as kind "opaque", if it is owned, mixes upper and lower case and digits and has DISTINCT_CHARACTERS
    different characters. Verdicts never drop a base match.
    Nulls: a null text has no spans; null owners and repositories count as one owner and one repository. Repeated rows are
    rows of their own; they add neither owners nor repositories. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.concat_ws("\n", *[F.col(c).cast("string") for c in repo_cols]).alias("repo"), F.col(text_col).cast("string").alias("_text"))
    token = spans(text, TOKEN, "token", 9)
    token = F.filter(token, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    rows = rows.select("id", "owner", "repo", base_spans(text).alias("base"), token.alias("token"))
    outside = F.filter("token", lambda t: ~F.exists(F.col("base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    rows = rows.select(F.monotonically_increasing_id().alias("u"), "id", "owner", "repo", "base", F.when(F.size("token") > 0, F.when(F.size("base") > 0, outside).otherwise(F.col("token"))).otherwise(none()).alias("token"))
    rows = materialise(rows, "secret-spans")
    some = rows.where((F.size("base") > 0) | (F.size("token") > 0))
    each = some.select("u", "owner", "repo", F.explode(F.concat("base", "token")).alias("s"))
    each = each.select("u", "owner", "repo", "s", F.sha2(secret_of(F.col("s")), 256).alias("h"), (F.col("s.kind") != "token").alias("is_base"))
    held = each.groupBy("h", "owner", "repo").agg(F.max("is_base").alias("is_base"), F.count("*").alias("m"))
    held = held.groupBy("h", "owner").agg(F.count("*").alias("n"), F.max("is_base").alias("is_base"), F.sum("m").alias("m"))
    owned = held.groupBy(F.col("h").alias("hash")).agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.max("is_base").alias("in_base"), F.sum("m").alias("m"))
    judged = join_groups(each, materialise(owned, "secret-owners"), F.col("h") == F.col("hash"), how="inner")
    verdict = F.when(F.col("n_owners") > owners, "example").otherwise("owned")
    value = F.col("s.value")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARACTERS)
    kind = F.when(F.col("is_base"), F.col("s.kind")).when(verdict == "example", None).when(F.col("in_base"), "reused").when(mixed, "opaque")
    rank = F.when(F.col("is_base"), F.col("s.rank")).when(kind == "reused", 3).otherwise(4)
    judged = judged.select("u", F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.end").alias("end"), kind.alias("kind"), value.alias("value"), "n_owners", "n_repos", verdict.alias("verdict")).alias("s")).where("s.kind is not null")
    found = judged.groupBy("u").agg(F.array_sort(F.collect_list("s")).alias("found"))
    return rows.select("u", "id", "base").join(found, "u", "left").select(F.col("id").alias(id_col), "base", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    judged = F.transform("found", lambda s: s["verdict"])
    verdicts = [(F.size("found") - F.size(F.array_remove(judged, v))).cast("long").alias(f"n_{v}") for v in ("owned", "example")]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), *verdicts)
