"""Quality rules: surface counts of every text, and a hashed n-gram log-likelihood ratio between a trusted target and the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, table

#: Buckets of the hashed word unigrams and bigrams.
BUCKETS = 16384
#: A text goes when its mean log-likelihood ratio per n-gram is below this.
THRESHOLD = -0.35
#: Trusted ids up to this number (16 bytes each in a hashed relation) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
WINDOW = 8


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def pair_hashes(hashes: Column, apart: int) -> Column:
    """One hash for each two entries that lie `apart` from each other."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def bucket(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def repeated_words(h4: Column) -> Column:
    """Words that lie in an eight-word window found twice or more; h4: hashes of all four-word windows.

    Only a text that repeats four words has its eight-word windows hashed; those are sorted by hash, equal neighbours kept,
    and the union of their spans counted.
    """
    h8 = pair_hashes(h4, WINDOW // 2)

    def covered(hashes: Column) -> Column:
        s = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
        at = F.transform(F.array(s), lambda s: F.array_sort(F.transform(same(s), lambda x: x["i"])))
        reach = F.transform(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
        return F.get(reach, F.lit(0))

    return F.when(F.size(h4) > F.size(F.array_distinct(h4)), covered(h8)).otherwise(0)


def rule_columns(text: Column, words: Column) -> dict[str, Column]:
    """The counts of the base rules; words: the text's word array as a column of its own."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def target_model(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One row: `model`, the log ratio of target and raw probability by bucket, both with add-one smoothing.

    Raw counts cover all documents, target counts all documents whose id is in `trusted`. Each task sums its own counts
    first, so that at most `buckets` rows leave it. Without a target n-gram all ratios are 0.
    """
    ids = materialise(trusted.select(F.col(trusted.columns[0]).alias("_tid")).where("_tid is not null").distinct(), "trusted")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    flagged = texts.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), F.col("_id") == F.col("_tid"), "left")
    words = flagged.select(F.when(F.col("_tid").isNotNull(), 1).otherwise(0).alias("t"), words_of(F.col("_text")).alias("w"))
    placed = words.select("t", "w", F.posexplode("w").alias("i", "x"))
    one, after = F.xxhash64("x"), F.get("w", F.col("i") + 1)
    two = F.when(after.isNotNull(), bucket(F.xxhash64(one, F.xxhash64(after)), buckets))
    grams = placed.select("t", F.explode(F.array(bucket(one, buckets), two)).alias("b")).where("b is not null")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    sums = every.agg(F.sum("raw").alias("n"), F.sum("target").alias("m"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    ratio = F.transform("c", lambda x: F.log((x["target"] + 1.0) / (F.col("m") + buckets)) - F.log((x["raw"] + 1.0) / (F.col("n") + buckets)))
    flat = F.array_repeat(F.lit(0.0), buckets)
    return materialise(sums.select(F.when(F.col("m") > 0, ratio).otherwise(flat).alias("model")), "ngram-ratio")


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Judge every document: (row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed, kept).

    row holds all columns of the document, so that none can clash. base_failed: fewer than 20 words, or over 30 % of the
    words in repeated eight-word windows. llr: the mean over the text's word unigrams and bigrams of
    log(p_target / p_raw); kept: not base_failed and llr >= threshold. With no trusted document, every llr is 0
    and the base rules decide alone. Words lie between white space of the ASCII range.
    Nulls: a null text has no words, llr null, fails the base rule; a null id is judged but is never trusted. Repeated rows
    are judged alike. An empty table gives no rows. Only DataFrame functions are used.
    """
    model = target_model(docs, trusted, id_col, text_col, buckets).scalar()
    t, w, h1, h2, h4 = (F.col(c) for c in ("_text", "_words", "_h1", "_h2", "_h4"))
    base = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_text")).withColumn("_words", words_of(t))
    base = base.withColumns({"_h1": F.transform(w, lambda x: F.xxhash64(x)), "_model": model})
    base = base.withColumn("_h2", pair_hashes(h1, 1)).withColumn("_h4", pair_hashes(h2, 2))
    ratio = lambda total, h: total + F.get(F.col("_model"), bucket(h, buckets))
    total = F.aggregate(h1, F.lit(0.0), ratio) + F.aggregate(h2, F.lit(0.0), ratio)
    out = base.select("row", *[c.alias(n) for n, c in rule_columns(t, w).items()], repeated_words(h4).cast("long").alias("n_repeat_words"), F.when(F.size(w) > 0, total / (2 * F.size(w) - 1)).alias("llr"), F.monotonically_increasing_id().alias("_at"))
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = out.withColumn("base_failed", failed)
    # a filter on `kept` must not move below the counts, where each use of a column would compute it again: the row number,
    # always 0 or more, is not deterministic to the optimiser and holds the filter above the projection that makes it
    passed = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)) & (F.col("_at") >= 0)
    return out.withColumn("kept", passed).drop("_at")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that reviewers marked as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
