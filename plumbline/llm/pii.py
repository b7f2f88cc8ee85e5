"""PII: base patterns, and information-theoretic sanitisation of terms that reveal protected values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .spans import SPAN, between, blocks_of, bound, count_of, digits_of, listed, luhn, none, ordered, reached, spans

#: The base patterns (fixed values of the contract, stated so that Java's engine takes linear time: a match starts where
#: its run of characters starts, or where the match before it ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: Characters on either side of a protected value that are its context, which tells copies of one passage from new ones.
CONTEXT = 80
#: A term goes when its pointwise mutual information with a value is this share of the value's information content ...
DISCLOSURE = 0.8
#: ... and the texts that hold both have the value in so many different contexts: copies of one passage are one context.
CONTEXTS = 3
MIN_LETTERS = 4
#: Stands for every character of a base match in a masked text; a word that holds it touches a match and is no term.
MASK = "\x01"
#: Texts with terms up to this number (a kilobyte or so each) are broadcast; more are joined by a shuffle.
BROADCAST_TEXTS = 50_000


def _kinds(text: Column) -> list[tuple[str, str, Column | None, Callable[[Column], Column]]]:
    """(kind, pattern, a condition without which no text matches, what else a match must be), in the contract's order."""
    return [
        ("email", EMAIL, text.contains("@"), lambda v: F.lit(True)),
        ("ip", IP, None, lambda v: v.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$")),
        ("card", CARD, None, lambda v: F.length(digits_of(v)).between(12, 19) & luhn(digits_of(v))),
        ("phone", PHONE, text.contains("+"), lambda v: F.length(digits_of(v)).between(9, 15)),
    ]


def base_spans(text: Column) -> Column:
    """The personal data of a text column, by start and then as email, ip, card, phone."""

    def right(found: Column, ok: Callable[[Column], Column]) -> Column:
        return F.filter(found, lambda s: ok(s["value"]))

    return ordered(*[right(spans(text, pattern, kind, rank, gate), ok) for rank, (kind, pattern, gate, ok) in enumerate(_kinds(text))])


def _touched(text: Column, pattern: str, ok: Callable[[Column], Column]) -> Column:
    """The text with MASK for each letter of a match and of the words that touch one; all else stays in its place.

    The text is cut at the matches; of each piece the letters at its ends are replaced where a match stands there.
    """

    def masked(x: Column) -> Column:
        return F.regexp_replace(x, r"\p{L}", MASK)

    def piece(p: Column, before: Column, behind: Column) -> Column:
        left = F.when(before, F.length(F.regexp_extract(p, r"^\p{L}*+", 0))).otherwise(0)
        right = F.when(behind & (left < F.length(p)), F.length(F.regexp_extract(F.reverse(p), r"^\p{L}*+", 0))).otherwise(0)
        mid = F.substring(p, left + 1, F.length(p) - left - right)
        return bound(F.struct(left.alias("l"), right.alias("r"), mid.alias("m")), lambda x: F.concat(F.repeat(F.lit(MASK), x["l"]), x["m"], F.repeat(F.lit(MASK), x["r"])))

    def joined(x: Column) -> Column:
        # with a match of its own before and behind, every piece has two neighbours
        at = lambda i: F.coalesce(F.get(x["ok"], i), F.lit(False))
        pieces = F.transform(x["between"], lambda p, i: F.concat(piece(p, (i > 0) & at(i - 1), at(i)), F.coalesce(F.when(at(i), masked(F.get(x["found"], i))).otherwise(F.get(x["found"], i)), F.lit(""))))
        return F.array_join(pieces, "")

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = bound(found, lambda f: F.struct(F.split(text, pattern, -1).alias("between"), f.alias("found"), F.transform(f, ok).alias("ok")))
    return bound(parts, joined)


def _masked(text: Column, base: Column) -> Column:
    """The text's words in their places, one character apart; a word that touches a base match is MASK, as long as the word.

    Copies of the text, one for each kind of match, are masked by themselves; their words stand in the same places.
    """
    text = F.translate(text, MASK, " ")
    cut = rf"[^\p{{L}}{MASK}]"

    def without(words: Column, kind: str, pattern: str, ok: Callable[[Column], Column]) -> Column:
        copy = F.split(_touched(text, pattern, ok), cut)
        masked = lambda all_: F.zip_with(all_, copy, lambda w, c: F.when(c.contains(MASK), F.repeat(F.lit(MASK), F.length(w))).otherwise(w))
        return bound(words, lambda all_: F.when(F.exists(base, lambda s: s["kind"] == kind), masked(all_)).otherwise(all_))

    words = F.split(text, cut)
    for kind, pattern, _, ok in _kinds(text):
        words = without(words, kind, pattern, ok)
    return F.array_join(words, " ")


def _values(text: Column, base: Column) -> Column:
    """Hashes of the base matches, each with the hash of its context."""

    def value(s: Column, blocks: Column) -> Column:
        near = lambda a, b: between(blocks, a, b)
        context = F.xxhash64(near(F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]), near(s["end"], s["end"] + CONTEXT))
        return F.struct(F.xxhash64(s["kind"], s["value"]).alias("e"), context.alias("context"))

    return bound(blocks_of(text), lambda blocks: F.transform(base, lambda s: value(s, blocks)))


def revealing_terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, terms): for the texts with these two hashes, all spans of terms that reveal a protected value of the text.

    A protected value e is a base match. Over the whole corpus of N documents: n_e hold e, n_t hold term t, n_te hold both,
    wherever in the text they stand. IC(e) = log(N / n_e), PMI(t; e) = log(N * n_te / (n_t * n_e)); t discloses e where
    PMI >= DISCLOSURE * IC > 0 and the texts with both have e in at least CONTEXTS different contexts (a text counts with
    one context). Terms are runs of letters of MIN_LETTERS characters or more that touch no base match, lower-cased.
    """
    text, key = F.col("_text"), ["k1", "k2"]
    rows = docs.select(F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    held = rows.select("_text", base_spans(text).alias("base")).where(F.size("base") > 0)
    texts = held.select(F.xxhash64(text).alias("k1"), F.md5(text).alias("k2"), _masked(text, F.col("base")).alias("masked"), _values(text, F.col("base")).alias("values"))
    # equal texts are one row, with the number of documents
    texts = materialise(texts.groupBy(*key).agg(F.count("*").alias("m"), F.first("masked").alias("masked"), F.first("values").alias("values")), "held-texts")
    values = materialise(texts.select(*key, "m", F.explode("values").alias("x")).groupBy(*key, "m", "x.e").agg(F.min("x.context").alias("context")), "values")
    # distinct contexts are counted in two steps, so that a value of a third of all documents is spread first; a value
    # with too few contexts has no term
    n_e = values.groupBy("e", "context").agg(F.sum("m").alias("m")).groupBy("e").agg(F.sum("m").alias("n_e"), F.count("*").alias("n_c")).where(F.col("n_c") >= CONTEXTS)
    n_e = materialise(n_e.select("e", "n_e"), "value-counts")
    values = materialise(values.join(n_e.select("e"), "e"), "frequent-values")
    asked = texts.join(values.select(*key).distinct(), key)
    whole = F.filter(F.split("masked", rf"[^\p{{L}}{MASK}]"), lambda w: (F.length(w) >= MIN_LETTERS) & ~w.contains(MASK))
    words = materialise(asked.select(*key, F.explode(F.array_distinct(F.transform(whole, F.lower))).alias("t")), "held-words")
    both = words.join(values, key)
    pairs = both.groupBy("e", "t", "context").agg(F.sum("m").alias("m")).groupBy("e", "t").agg(F.sum("m").alias("n_te"), F.count("*").alias("n_c"))
    pairs = materialise(pairs.where(F.col("n_c") >= CONTEXTS), "pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], f"k1 long, k2 string, terms {SPAN}")
    terms = materialise(pairs.select(F.col("t").alias("pt")).distinct(), "terms")
    words_of_all = rows.select(F.explode(F.array_distinct(F.transform(F.split(text, r"[^\p{L}]+"), F.lower))).alias("t"))
    # counted by task before the join, so that the join sees each word once, however frequent it is; an inner join with
    # the distinct terms, as the optimiser moves a semi-join below the count
    n_t = words_of_all.groupBy("t").agg(F.count("*").alias("n_t")).join(terms, F.col("t") == F.col("pt")).select("t", "n_t")
    n = docs.count()
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    revealing = materialise(pairs.join(n_e, "e").join(n_t, "t").where((ic > 0) & (pmi >= DISCLOSURE * ic)).select("e", "t"), "revealing")
    marked = materialise(both.join(revealing, ["e", "t"]).select(*key, "t").distinct(), "marked")
    # every occurrence: all words of the texts with their places, then those that are marked in their text
    placed = texts.join(marked.select(*key).distinct(), key).select(*key, F.posexplode(F.split("masked", rf"[^\p{{L}}{MASK}]")).alias("pos", "w"))
    start = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = placed.select(*key, F.lower("w").alias("t"), start.alias("start"), (start + F.length("w")).alias("end"))
    spans_ = placed.join(marked, [*key, "t"]).select(*key, F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"), F.col("t").alias("value")).alias("s"))
    return spans_.groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("terms"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data of every text: (row, base, found): row holds all columns of the document; base and found are arrays of
    spans (start, rank, end, kind, value) in code points.

    base: matches of the base patterns. found: base and, as kind "term", the words that by corpus co-occurrence reveal a
    base match of their text (`revealing_terms`). Terms belong to texts, not rows: copies share them.
    Nulls: a null text has no spans; ids play no part. Repeated rows are treated alike. An empty table gives no rows.
    """
    terms = materialise(revealing_terms(docs, id_col, text_col), "term-spans")
    text = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("_text")).withColumn("base", base_spans(text))
    if (n := terms.count()) == 0:
        return out.select("row", "base", F.col("base").alias("found"))
    out = out.withColumns({"h1": F.xxhash64("_text"), "h2": F.when(F.size("base") > 0, F.md5("_text"))})
    out = out.join(F.broadcast(terms) if n <= BROADCAST_TEXTS else terms, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select("row", "base", ordered("base", F.coalesce("terms", none())).alias("found"))


def sanitised(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the first kind.

    The parts, text before a span and its kind, are one array that is joined at the end.
    """

    def parts(x: Column) -> Column:
        tag = lambda s, at: F.concat(between(x["blocks"], at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        tags = F.zip_with(found, x["reached"], lambda s, at: F.when(s["start"] >= at, tag(s, at)).otherwise(""))
        rest = between(x["blocks"], F.greatest(F.array_max(x["reached"]), F.element_at(found, -1)["end"]), x["size"])
        return F.concat(F.array_join(tags, ""), rest)

    given = F.struct(blocks_of(text).alias("blocks"), reached(found).alias("reached"), F.length(text).alias("size"))
    return F.when(F.size(found) > 0, bound(given, parts)).otherwise(text)


def op2_information_theoretic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("row.doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
