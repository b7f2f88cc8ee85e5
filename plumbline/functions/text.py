"""Text and number functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: U+FFFD and what stands for it in damaged text, longest first (fixed values).
DAMAGED = [("MANH�", "MANHÃ"), ("L�NGUA", "LÍNGUA"), ("MATEM�TICA", "MATEMÁTICA"), ("�", "º")]


#: White space as JavaScript's \\s and trim see it, and as Python's \\s does: the inside of a character class of the engine.
JS_SPACE, PYTHON_SPACE = r"\t-\r\p{Z}\uFEFF", r"\t-\r\x1C-\x1F\x85\p{Z}"
#: The normaliser among the libraries that the engine's own collations use.
_NORMALISER = "com.ibm.icu.text.Normalizer"


def _normalised(x: Column, form: str) -> Column:
    return F.when(x.isNotNull(), F.reflect(F.lit(_NORMALISER), F.lit(form), F.coalesce(x, F.lit("")), F.lit(False)))


def decomposed(x: Column) -> Column:
    """Canonical decomposition (NFD) of any text."""
    return _normalised(x, "decompose")


def composed(x: Column) -> Column:
    """Canonical composition (NFC) of any text."""
    return _normalised(x, "compose")


def trimmed(x: Column, space: str = JS_SPACE) -> Column:
    return F.regexp_replace(x, f"^[{space}]+|[{space}]+$", "")


def strip_accents(x: Column) -> Column:
    """The decomposed text without its non-spacing marks (those that the engine's Java knows)."""
    return F.regexp_replace(decomposed(x), r"\p{Mn}+", "")


@cache
def _diacritics() -> str:
    """All code points with the Unicode property Diacritic, as the inside of a character class."""
    import regex

    has = regex.compile(r"\p{Diacritic}").fullmatch
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and has(chr(c))]
    starts = [c for i, c in enumerate(codes) if i == 0 or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i == len(codes) - 1 or codes[i + 1] != c + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True))


def search_key(x: Column) -> Column:
    """Lower-case text without diacritics of any kind, spacing ones as well, trimmed; inner white space stays."""
    return trimmed(F.lower(F.regexp_replace(decomposed(x), f"[{_diacritics()}]+", "")))


def catalog_key(x: Column) -> Column:
    """Lower-case text without the combining marks U+0300 to U+036F, each run of white space as one space, trimmed."""
    plain = F.lower(F.regexp_replace(decomposed(x), "[\u0300-\u036F]+", ""))
    return F.trim(F.regexp_replace(plain, f"[{JS_SPACE}]+", " "))


@dataclass(frozen=True)
class ParsedQuery:
    text: str
    year: str | None


def fold(value: str) -> str:
    """`catalog_key` of a Python literal, for query strings; the engine folds it once more, so that both sides agree."""
    import regex

    plain = "".join(c for c in unicodedata.normalize("NFD", value) if not "\u0300" <= c <= "\u036f")
    return regex.sub(f"[{JS_SPACE}]+", " ", plain.lower()).strip(" ")


def search_fold(value: str) -> str:
    """`search_key` of a Python literal."""
    import regex

    return regex.sub(f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "", regex.sub(r"\p{Diacritic}", "", unicodedata.normalize("NFD", value)).lower())


def holds(hay: Column, key: Callable[[Column], Column], query: str) -> Column:
    """Whether a text holds a literal once both have the same key."""
    return F.contains(key(hay), key(F.lit(query)))


def parse_query(value: str) -> ParsedQuery:
    """Free text and the first grade named in it (6 to 9); every mention of a grade leaves the text."""
    text = fold(value)
    grade = re.compile(r"(?<![a-z0-9_])([6-9])(?:º|o)?\s*ano(?![a-z0-9_])")
    found = grade.search(text)
    return ParsedQuery(re.sub(r"\s+", " ", grade.sub(" ", text)).strip(), f"{found[1]}º ano" if found else None)


def parsed_grade(x: Column) -> Column:
    """`parse_query(...).year` for a text column; null where no grade is named."""
    digit = F.regexp_extract(catalog_key(x), r"(?<![a-z0-9_])([6-9])(?:º|o)?\s*ano(?![a-z0-9_])", 1)
    return F.when(digit != "", F.concat(digit, F.lit("º ano")))


def _whole(digits: Column, base: int) -> Column:
    """The number that digits of a base stand for."""
    each = F.regexp_extract_all(F.lower(digits), F.lit("([0-9a-f])"), F.lit(1))
    return F.aggregate(each, F.lit(0.0), lambda n, d: n * base + (F.position(d, F.lit("0123456789abcdef")) - 1))


def parse_number(x: Column) -> Column:
    """A double from text as the site reads it; else null, also for infinity.

    With a comma, points are thousands marks and the first comma is the decimal point. Decimal and exponent forms, and
    unsigned 0x, 0o and 0b numbers. Text of white space alone is 0, empty text is null.
    """
    t = trimmed(x)
    comma = F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), "^([^,]*),", "$1.")
    plain = F.when(F.contains(t, F.lit(",")), comma).otherwise(t)
    out = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    for letter, base, digits in (("x", 16, "[0-9a-f]"), ("o", 8, "[0-7]"), ("b", 2, "[01]")):
        out = out.when(plain.rlike(f"(?i)^0{letter}{digits}+$"), _whole(F.substring(plain, 3, 1 << 30), base))
    return F.when(x != "", finite(out.when(plain == "", F.lit(0.0))))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_text(x: Column) -> Column:
    """Trimmed text, null as empty, damaged characters restored."""
    out = F.trim(F.coalesce(x, F.lit("")))
    for bad, good in DAMAGED:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def clean_lines(x: Column, keep_lines: bool = False) -> Column:
    """Composed lines without soft hyphens and with single spaces; blank lines go; joined by a space or a line feed."""

    lines = F.split(F.replace(composed(x), F.lit("\u00ad"), F.lit("")), "[\n\x0B\f\r\x1c-\x1e\x85\u2028\u2029]")
    lines = F.transform(lines, lambda line: F.trim(F.regexp_replace(line, f"[{PYTHON_SPACE}]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n" if keep_lines else " ")


def without_running_header(x: Column) -> Column:
    """The text without its first three lines, if the first is a page number."""
    return F.when(x.rlike(r"^[0-9]{1,3}(\n|$)"), F.array_join(F.slice(F.split(x, "\n"), 4, 1_000_000), "\n")).otherwise(x)


def or_default(x: Column, default: str = "Nao informado") -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def number_text(x: Column, digits: int = 1) -> Column:
    """Half-up decimal text with point for thousands and comma for decimals; "-" for null and non-finite numbers.

    Half-up by arithmetic: a mean of 30.85 that has become 30.849999999999998 by its additions is 30,9. Numbers whose
    double has no more than those decimals are printed as they are.
    """
    n, power = finite(x), 10.0**digits
    size = F.abs(n)
    nearest = F.when(size < 2.0**52 / power, F.floor(size * power + 0.5) / power * F.signum(n)).otherwise(n)
    return F.when(n.isNotNull(), F.translate(F.format_string(f"%,.{digits}f", nearest), ",.", ".,")).otherwise("-")


def signed_text(x: Column, digits: int = 1) -> Column:
    return F.when(x > 0, F.concat(F.lit("+"), number_text(x, digits))).otherwise(number_text(x, digits))


def _shortest(x: Column) -> Column:
    """A positive number's shortest digits in exponent form: of 15, 16 or 17 digits the fewest that read back as the number."""
    forms = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
    return F.coalesce(*[F.when(f.cast("double") == x, f) for f in forms[:-1]], forms[-1])


def plain_number(x: Column) -> Column:
    """A number as a spreadsheet cell: shortest digits, no exponent from 0.000001 up to 10 ** 21, no ".0"."""
    parts = F.split(_shortest(F.abs(x)), "e")
    digits = F.regexp_replace(F.replace(parts[0], F.lit("."), F.lit("")), "(?<=[0-9])0+$", "")
    given = F.struct(digits.alias("d"), parts[1].cast("int").alias("e"), F.length(digits).alias("n"))

    def text(v: Column) -> Column:
        rest = F.when(v["n"] > 1, F.concat(F.lit("."), F.substring(v["d"], F.lit(2), v["n"]))).otherwise("")
        power = F.concat(F.substring(v["d"], 1, 1), rest, F.when(v["e"] < 0, "e-").otherwise("e+"), F.abs(v["e"]).cast("string"))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -v["e"] - 1), v["d"])
        whole = F.concat(v["d"], F.repeat(F.lit("0"), v["e"] + 1 - v["n"]))
        both = F.concat(F.substring(v["d"], F.lit(1), v["e"] + 1), F.lit("."), F.substring(v["d"], v["e"] + 2, v["n"]))
        plain = F.when(v["e"] < 0, small).when(v["e"] + 1 >= v["n"], whole).otherwise(both)
        return F.when(v["e"].between(-6, 20), plain).otherwise(power)

    shown = F.concat(F.when(x < 0, "-").otherwise(""), F.transform(F.array(given), text)[0])
    return F.when(x == 0, "0").when(F.isnan(x), "NaN").when(F.abs(x) == float("inf"), F.concat(F.when(x < 0, "-").otherwise(""), F.lit("Infinity"))).when(x.isNotNull(), shown)


def title_case(x: Column) -> Column:
    return F.initcap(F.lower(x))


def unit_label(name: Column, network: Column, region: Column, unit: Column) -> Column:
    """name — network · Região r — Cód. c; the region only where there is one."""
    middle = F.when(F.coalesce(region, F.lit("")) != "", F.concat(F.lit(" · Região "), region)).otherwise("")
    return F.concat(name, F.lit(" — "), network, middle, F.lit(" — Cód. "), unit)


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def file_label(x: Column) -> Column:
    """A name as part of a file name: lower case without accents."""
    return F.lower(strip_accents(x))


def collated(x: Column) -> Column:
    """A sort key in the alphabet of the site's language."""
    return F.collate(x, "pt")


def natural_order(x: Column) -> Column:
    """`collated` with each run of digits as a number: its length without leading zeros stands before it, so 9 comes before 10.

    Values that differ in leading zeros alone are equal here; a second key must order them.
    """
    parts = F.regexp_extract_all(x, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def padded(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 6, "0"), number)).otherwise(part)

    return collated(F.array_join(F.transform(parts, padded), ""))


def csv_cell(x: Column) -> Column:
    """A quoted cell; quotes doubled, null as empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(x, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
