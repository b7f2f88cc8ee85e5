"""Ordered extraction: forward fill, as-of, intervals, gap groups, segments and multi-match patterns over positioned rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import clean_lines, strip_accents


def _same(scope: list[str], left: str = "a", right: str = "b") -> Column:
    """Null-safe equality of the scope and the stretch on both sides of a join."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in [*scope, "_stretch"]])


def forward_fill(rows: DataFrame, scope: list[str], order: list[str], value: Column, name: str, stretch: Column | None = None) -> DataFrame:
    """The last non-empty value at or before each row of its scope; a scope (section, page, cycle) resets the fill.

    stretch: a number that never falls along the order, such as the order divided by a width. A scope is then filled in
    tasks stretch by stretch, each with the last value of the stretches before it: no task sees a whole hot scope.
    """
    filled = F.when(value.cast("string") != "", value)
    w = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if stretch is None:
        return rows.withColumn(name, F.last(filled, ignorenulls=True).over(w(*scope)))
    cut = rows.withColumns({"_stretch": stretch, "_filled": filled})
    ends = cut.groupBy(*scope, "_stretch").agg(F.max_by("_filled", F.when(F.col("_filled").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.partitionBy(*scope).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).where("_carried is not null")
    own = cut.withColumn("_own", F.last("_filled", ignorenulls=True).over(w(*scope, "_stretch")))
    both = own.alias("a").join(carried.alias("b"), _same(scope), "left")
    return both.select(*[F.col(f"a.{c}") for c in rows.columns if c != name], F.coalesce("a._own", "b._carried").alias(name))


def first_in_row_then_carry(lines: DataFrame, scope: list[str], row: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Per table row: its own first value, else the last value of the rows before it; later values of a row only carry on."""
    each = lines.groupBy(*scope, row).agg(F.min_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_own"), F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_carry"))
    w = Window.partitionBy(*scope).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn(name, F.coalesce("_own", F.last("_carry", ignorenulls=True).over(w))).drop("_own", "_carry")


def asof_backward(left: DataFrame, right: DataFrame, scope: list[str], time: str, value: str, clamp: bool = False, stretch: Column | None = None) -> DataFrame:
    """Each left row with the value of the last right row at or before it; with `clamp`, of the first one if none precedes.

    Both sides become one sequence and a running last() does the match: one shuffle on the scope, no range join. stretch: a
    number that never falls along the time, by which hot scopes are split (`forward_fill`).
    """
    tagged = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    other = right.select(*scope, time, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both, name = tagged.unionByName(other, allowMissingColumns=True), f"asof_{value}"
    if stretch is None:
        got = F.last("_v", ignorenulls=True).over(Window.partitionBy(*scope).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        both = both.withColumn(name, got)
    else:
        both = both.withColumn("_value", F.struct("_v"))  # an empty text is a value here
        both = forward_fill(both, scope, [time, "_side"], F.when(F.col("_v").isNotNull(), F.col("_value")), name, stretch).withColumn(name, F.col(f"{name}._v")).drop("_value")
    if clamp:
        both = both.withColumn(name, F.coalesce(name, F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(time))).over(Window.partitionBy(*scope))))
    return both.where("_side = 1").drop("_side", "_v")


def gap_groups(rows: DataFrame, scope: list[str], order: str, gap: Column | float, name: str = "island", stretch: Column | None = None) -> DataFrame:
    """Number the islands of each scope: a new one begins where the order value leaves the one before by more than `gap`.

    stretch: a number that never falls along the order. Islands are then numbered stretch by stretch, and a stretch goes on
    from the number and the last order value of the one before: no task sees a whole hot scope.
    """
    keys = scope if stretch is None else [*scope, "_stretch"]
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows if stretch is None else rows.withColumn("_stretch", stretch)
    new = cut.withColumn("_new", F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0))
    numbered = new.withColumn(name, F.sum("_new").over(run))
    if stretch is None:
        return numbered.drop("_new")
    ends = new.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.sum("_new").alias("_inner"))
    along = Window.partitionBy(*scope).orderBy("_stretch")
    begins = F.when(F.col("_low") - F.lag("_high").over(along) > gap, 1).otherwise(0)
    ends = ends.withColumn("_begins", begins)
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_before", F.sum(F.col("_begins") + F.col("_inner")).over(upto) - F.col("_inner"))
    both = numbered.alias("a").join(ends.alias("b"), _same(scope))
    return both.select(*[F.col(f"a.{c}") for c in rows.columns if c != name], (F.col(f"a.{name}") + F.col("b._before")).alias(name))


def paragraphs(lines: DataFrame, scope: list[str], order: str, gap: float, text: str, joiner: Column | None = None) -> DataFrame:
    """(scope..., paragraph, top, text): lines folded into paragraphs, a new one where the order value leaps by more than `gap`.

    A paragraph's lines are joined in order by line feeds, without trailing white space; a line that ends in "/" is a broken
    word and takes the next line on directly. joiner: what stands before each line instead. Lines of one order value stand by
    their text. Paragraphs are numbered from 0 in their scope; a null line is empty.
    """
    rows = gap_groups(lines.withColumn("_text", F.rtrim(F.coalesce(F.col(text), F.lit("")))), scope, order, gap, "paragraph")
    each = rows.groupBy(*scope, "paragraph").agg(F.min(order).alias("top"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("_text").alias("line")))).alias("_lines"))

    def with_joint(x: Column, i: Column) -> Column:
        before = F.get(F.col("_lines"), i - 1)["line"]
        usual = F.lit("\n") if joiner is None else joiner
        return F.when((i == 0) | (before == ""), x["line"]).when(before.endswith("/"), F.ltrim(x["line"])).otherwise(F.concat(usual, x["line"]))

    return each.select(*scope, "paragraph", "top", F.array_join(F.transform("_lines", with_joint), "").alias(text))


def boundary_pairs(edges: DataFrame, scope: list[str], at: str) -> DataFrame:
    """Neighbouring boundaries as intervals [top, bottom); the last boundary of a scope opens none."""
    w = Window.partitionBy(*scope).orderBy(at)
    return edges.select(*scope, F.col(at).alias("top"), F.lead(at).over(w).alias("bottom")).where("bottom is not null")


def with_edges(edges: DataFrame, scope: list[str], at: str, lead: float | None = None, closing: DataFrame | None = None) -> DataFrame:
    """Boundaries with a lead-in before each scope's first one and a closing edge after its last.

    closing: (scope..., at), at most one row per scope; it is added where it lies beyond the scope's last boundary, which
    itself stays. A scope without boundaries gets neither.
    """
    out = edges.select(*scope, at)
    last = edges.groupBy(*scope).agg(F.max(at).alias("_last"))
    if closing is not None:
        out = out.unionByName(closing.join(last, scope).where(F.col(at) > F.col("_last")).select(*scope, at))
    if lead is not None:
        out = out.unionByName(last.select(*scope, F.lit(lead).cast(dict(edges.dtypes)[at]).alias(at)))
    return out


def in_intervals(rows: DataFrame, bounds: DataFrame, scope: list[str], at: str) -> DataFrame:
    """Rows inside the intervals of their scope: an equi-join on the scope with the range as its condition."""
    same = [F.col(f"r.{k}") == F.col(f"b.{k}") for k in scope]
    cond = reduce(lambda x, y: x & y, [*same, F.col(f"r.{at}") >= F.col("b.top"), F.col(f"r.{at}") < F.col("b.bottom")])
    return rows.alias("r").join(bounds.alias("b"), cond).select("r.*", "b.top", "b.bottom")


def in_boxes(points: DataFrame, boxes: DataFrame, scope: list[str], y: str, x: str, cell: tuple[float, float], margin: float = 0.0) -> DataFrame:
    """Points inside the boxes (top, bottom, left, right) of their scope: top + margin <= y < bottom - margin, left <= x <= right.

    The plane is cut in cells of the given height and width; a box stands for every cell that it covers, a point for one, so
    the join is an equi-join on scope and cell, and a hot scope is spread over its cells. A cell of about a usual box's size
    keeps both the copies of a box and the points beside it few. A point comes once for each box that holds it; points and
    boxes with nulls meet nothing.
    """
    down, across = (lambda v, size: F.floor(v / size)), (lambda a, b, size: F.sequence(F.floor(a / size), F.floor(b / size)))
    whole = (F.col("top") + margin <= F.col("bottom") - margin) & (F.col("left") <= F.col("right"))
    cells = boxes.where(whole).withColumn("_cy", F.explode(across(F.col("top") + margin, F.col("bottom") - margin, cell[0]))).withColumn("_cx", F.explode(across(F.col("left"), F.col("right"), cell[1])))
    placed = points.withColumns({"_cy": down(F.col(y), cell[0]), "_cx": down(F.col(x), cell[1])})
    same = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in [*scope, "_cy", "_cx"]]
    inside = [F.col(f"p.{y}") >= F.col("b.top") + margin, F.col(f"p.{y}") < F.col("b.bottom") - margin, F.col(f"p.{x}") >= F.col("b.left"), F.col(f"p.{x}") <= F.col("b.right")]
    out = placed.alias("p").join(cells.alias("b"), reduce(lambda a, b: a & b, same + inside))
    extra = [c for c in boxes.columns if c not in scope]
    return out.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"b.{c}") for c in extra])


def facing_pages(pages: DataFrame, start: int, scope: tuple[str, ...] = ()) -> DataFrame:
    """Page n beside page n + 1 of its scope from `start` on, in steps of two; a last page without a partner is left out."""
    left = pages.where((F.col("page") >= start) & ((F.col("page") - start) % 2 == 0))
    right = pages.select(*scope, (F.col("page") - 1).alias("page"), F.col("text").alias("facing_text"))
    return left.join(right, [*scope, "page"])


def all_matches(rows: DataFrame, text: str, pattern: str, groups: list[str]) -> DataFrame:
    """One row per match of a pattern, with its groups as columns and its number in the text."""
    arrays = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(i + 1)).alias(g) for i, g in enumerate(groups)])
    out = rows.select(*[c for c in rows.columns if c != text], F.posexplode(arrays).alias("match_no", "_m"))
    return out.select(*[c for c in out.columns if c != "_m"], *[F.col(f"_m.{g}").alias(g) for g in groups])


def matches_with_offsets(texts: DataFrame, key: list[str], text: str, pattern: str, groups: list[str] = ()) -> DataFrame:
    """(key..., match_no, start, end, match, groups...): every match of a pattern in a text, offsets in code points, end exclusive.

    A match starts behind the pieces and matches before it, whose lengths are added up over the rows of its text.
    """
    of = F.col(text)
    found = [F.regexp_extract_all(of, F.lit(pattern), F.lit(i)).alias(g) for i, g in enumerate(["match", *groups])]
    parts = F.arrays_zip(*found, F.slice(F.split(of, pattern, -1), F.lit(1), F.size(found[0])).alias("_piece"))
    rows = texts.select(*key, F.posexplode(parts).alias("match_no", "_m")).select(*key, "match_no", "_m.*")
    w = Window.partitionBy(*key).orderBy("match_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("_piece") + F.length("match")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("match")).select(*key, "match_no", "start", "end", "match", *groups)


def matches_on_pages(pages: DataFrame, scope: list[str], page: str, text: str, pattern: str, groups: list[str] = ()) -> DataFrame:
    """Matches of a pattern in the pages of each scope joined in order by line feeds, each with the page on which it starts.

    A match may run over a page's end. The page is that of the last page start at or before the match's offset: an as-of join.
    """
    joined = pages.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("_pages"))
    texts = joined.select(*scope, F.array_join("_pages.text", "\n").alias("_text"))
    w = Window.partitionBy(*scope).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    each = joined.select(*scope, F.posexplode("_pages").alias("_no", "_p")).select(*scope, "_no", F.col("_p.page").alias("page"), F.length("_p.text").alias("_n"))
    starts = each.select(*scope, F.coalesce(F.sum(F.col("_n") + 1).over(w), F.lit(0)).cast("long").alias("start"), "page")
    found = matches_with_offsets(texts, scope, "_text", pattern, groups)
    return asof_backward(found, starts, scope, "start", "page", clamp=True).withColumnRenamed("asof_page", "page")


def digit_list(x: Column) -> Column:
    """Distinct numbers of a text, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit("([0-9]+)"), F.lit(1)), lambda d: d.cast("int"))))


def first_items(items: DataFrame, scope: list[str], number: str, order: list[str]) -> DataFrame:
    """Numbered items: of each number the first occurrence."""
    w = Window.partitionBy(*scope, number).orderBy(*order)
    return items.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def segments(texts: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """Text between consecutive headings: (key, segment_no, heading, body); text before the first heading is left out."""
    bodies = F.slice(F.split(F.col(text), heading, -1), F.lit(2), F.size(F.split(F.col(text), heading, -1)))
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(heading), F.lit(0)).alias("h"), bodies.alias("b"))
    return texts.select(key, F.posexplode(both).alias("segment_no", "_s")).select(key, "segment_no", F.col("_s.h").alias("heading"), F.col("_s.b").alias("body"))


def table_rules(drawings: DataFrame, low: float = 150.0, high: float = 790.0, width: float = 100.0) -> DataFrame:
    """Heights of horizontal table rules by page: level lines, wide enough, inside the body, rounded, distinct."""
    level = (F.abs(F.col("y1") - F.col("y0")) <= 0.2) & (F.col("x1") - F.col("x0") >= width) & F.col("y0").between(low, high)
    return drawings.where(level).select("page", F.round("y0", 2).alias("y")).distinct()


def heading_page(pages: DataFrame, heading: str, start: int = 0, folded: bool = False) -> DataFrame:
    """The first page from `start` on that holds a heading, in either case and over line ends; the query fails if none does.

    folded: pages are cleaned first and accents don't count.
    """
    key = (lambda x: F.upper(strip_accents(clean_lines(x)))) if folded else (lambda x: F.upper(F.replace(x, F.lit("\n"), F.lit(" "))))
    wanted = F.upper(strip_accents(F.lit(heading))) if folded else F.upper(F.lit(heading))
    none = F.raise_error(F.lit(f"heading {heading!r} not found from page {start}")).cast(dict(pages.dtypes)["page"])
    held = pages.where((F.col("page") >= start) & F.contains(key(F.col("text")), wanted))
    return held.agg(F.min("page").alias("_first")).select(F.coalesce("_first", none).alias("page"))


#: Up to this number of corrections are broadcast; with more, each key's rows are dealt to so many places.
BROADCAST_CORRECTIONS, PLACES = 100_000, 64


def corrected(rows: DataFrame, corrections: DataFrame, key: str, column: str, most: int = BROADCAST_CORRECTIONS) -> DataFrame:
    """Literal replacements by key, in their order: corrections (key, seq, old, new) are folded over the column.

    The rows of a key never meet in one task: up to `most` corrections go to the rows, beyond that the rows of a key are
    dealt by their text to PLACES places, each with the key's corrections.
    """
    lists = corrections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("_c"))
    if corrections.count() <= most:
        out = rows.join(F.broadcast(lists), key, "left")
    else:
        places = lists.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
        out = rows.withColumn("_place", F.pmod(F.hash(column), F.lit(PLACES))).join(places, [key, "_place"], "left").drop("_place")
    fixed = F.aggregate("_c", F.col(column), lambda t, c: F.replace(t, c["old"], c["new"]))
    return out.withColumn(column, F.coalesce(fixed, F.col(column))).drop("_c")
