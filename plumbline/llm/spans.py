"""Spans of regular expressions as array columns, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches that are placed one after another before their array is closed.
CHUNK = 256
#: Code points of the blocks that a text is cut in, so that a place in it is found without reading all that stands before.
BLOCK = 1024
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def spans(text: Column, pattern: str, kind: str, rank: int, gate: Column | None = None) -> Column:
    """All leftmost non-overlapping matches, by start; positions count code points, end exclusive.

    The matches come from regexp_extract_all and the text between them from split with the same pattern: a match starts
    after the pieces and matches before it. gate: a cheap condition without which no text can match.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(SPAN).alias("out"))

    def add_chunk(acc: Column, chunk: Column) -> Column:
        begin = F.struct(F.element_at(acc, -1)["at"].alias("at"), none().alias("out"))
        return F.concat(acc, F.array(F.aggregate(chunk, begin, add)))

    # matches are added to arrays of CHUNK at most, as each addition copies the array
    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
    chunks = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice(p, k + 1, F.lit(CHUNK))))[0]
    first = F.array(F.struct(F.lit(0).alias("at"), none().alias("out")))
    placed = F.aggregate(chunks, first, add_chunk, lambda acc: F.flatten(F.transform(acc, lambda x: x["out"])))
    hit = text.rlike(pattern)
    return F.when(hit if gate is None else gate & hit, placed).otherwise(none())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once: inside use it is a variable, and not the expression again for each element."""
    return F.transform(F.array(value), use)[0]


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points; the last one may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points from start to end of a text in blocks; reads the blocks that hold them."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.greatest(F.ceil(end / BLOCK).cast("int") - first, F.lit(0)))
    return F.when(end > start, F.substring(F.array_join(some, ""), start - first * BLOCK + 1, end - start)).otherwise("")


def reached(found: Column) -> Column:
    """For each span the greatest end of the spans before it, 0 for the first; found is an array by start.

    Maxima are taken in chunks of CHUNK spans, and over the chunks before.
    """
    ends = F.concat(F.array(F.lit(0)), F.transform(found, lambda s: s["end"]))
    chunks = bound(ends, lambda e: F.transform(F.sequence(F.lit(0), F.size(e) - 1, F.lit(CHUNK)), lambda k: F.slice(e, k + 1, F.lit(CHUNK))))

    def all_of(c: Column) -> Column:
        tops = F.transform(c, F.array_max)
        return bound(tops, lambda top: F.flatten(F.transform(c, lambda chunk, k: bound(F.coalesce(F.array_max(F.slice(top, F.lit(1), k)), F.lit(0)), lambda low: F.transform(chunk, lambda _, i: F.greatest(low, F.array_max(F.slice(chunk, F.lit(1), i + 1))))))))

    return F.slice(bound(chunks, all_of), F.lit(1), F.size(found))


def ordered(*kinds: Column) -> Column:
    """One array of all spans, by start and then by rank."""
    return F.array_sort(F.concat(*kinds))


def listed(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") / 5).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0
