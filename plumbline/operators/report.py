"""Diagnoses, priorities, chart domains, label spreading and text exports over compared rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import csv_cell, number_text, plain_number, signed_text, title_case, unit_label

#: Priority label of each position, in report order (fixed values).
PRIORITIES = {"PRIORIDADE": "ALTA", "ATENCAO": "ATENÇÃO", "RECUPERACAO": "MONITORAR", "DESTAQUE": "DESTAQUE"}
ORDER = ["ALTA", "ATENÇÃO", "MONITORAR", "DESTAQUE"]
#: Style class of each position (fixed values).
BADGES = {"DESTAQUE": "tone-destaque", "RECUPERACAO": "tone-recuperacao", "ATENCAO": "tone-atencao", "PRIORIDADE": "tone-prioridade", "SEM_REFERENCIA": "tone-sem-referencia", "SEM_EVOLUCAO": "tone-sem-referencia"}
#: CSV headers in order (fixed values), and the columns below them.
CSV_HEADERS = ["Escola", "Codigo", "Regiao", "Serie/Ano", "Componente", "Periodo", "Rede", "Prof 2024", "Prof 2025", "Diferenca", "Variacao %", "Status"]
CSV_TEXTS, CSV_NUMBERS = ["unit_name", "unit", "region", "grade", "subject", "period", "network"], ["prof2024", "prof2025", "diff", "percent"]
#: Texts of the sentences; {} take formatted numbers (fixed values).
BASE = "{} no {} passou de {} para {} pontos, {} de {} pontos."
CROSSED = " A escola passou de {} pontos abaixo da média das escolas do recorte em 2024 para {} pontos acima em 2025."
NEARER = " A escola reduziu a distância para a média das escolas do recorte em {} pontos, mas o resultado permanece {} pontos abaixo da média das escolas do recorte."
BELOW = " O resultado permanece {} pontos abaixo da média das escolas do recorte."
AHEAD = " A evolução da escola foi superior à observada no recorte."
LOOK = " Este resultado merece investigação."


def filled(template: str, *values: Column) -> Column:
    """The template with its {} replaced by columns, in order."""
    parts = template.split("{}")
    return F.concat(F.lit(parts[0]), *[x for v, t in zip(values, parts[1:], strict=True) for x in (v, F.lit(t))])


def sentence() -> Column:
    """One sentence on a compared row; the first case that holds adds its second half, comparisons with nulls being false."""
    c = F.col
    size = lambda name: number_text(F.abs(c(name)))
    word = F.when(c("diff") >= 0, "avanço").otherwise("queda")
    base = filled(BASE, title_case(c("subject")), c("grade"), number_text(c("prof2024")), number_text(c("prof2025")), word, size("diff"))
    cases = [
        (~c("has_reference"), F.lit("")),
        ((c("gap2024") < 0) & (c("gap2025") >= 0), filled(CROSSED, size("gap2024"), size("gap2025"))),
        ((c("gap2025") < 0) & (c("gap_change") > 1), filled(NEARER, size("gap_change"), size("gap2025"))),
        (c("gap2025") < 0, filled(BELOW, size("gap2025"))),
        (c("diff") > c("state_diff"), F.lit(AHEAD)),
    ]
    rest = F.lit("")
    for cond, text in reversed(cases):
        rest = F.when(cond, text).otherwise(rest)
    return F.concat(base, rest)


def diagnosis(compared: DataFrame) -> DataFrame:
    """Rows with a variation, each in a bucket ("destaques" or "atencao") with its sentence.

    A row with a benchmark goes by its position; one without goes to "destaques" unless it fell.
    """
    rows = compared.where("diff is not null")
    own = F.when(F.col("tone") == "negative", "ATENCAO").otherwise("DESTAQUE")
    rows = rows.withColumn("_key", F.when(F.col("has_reference"), F.col("position")).otherwise(own))
    bucket = F.when(F.col("_key").isin("DESTAQUE", "RECUPERACAO"), "destaques").otherwise("atencao")
    text = F.when(F.col("_key") == "ATENCAO", F.concat(sentence(), F.lit(LOOK))).otherwise(sentence())
    return rows.select("unit", "grade", "subject", bucket.alias("bucket"), text.alias("sentence"), "ord")


def priorities(compared: DataFrame) -> DataFrame:
    """Rows with a benchmark and a variation, ranked ALTA, ATENÇÃO, MONITORAR, DESTAQUE; positions without a label last.

    Rows of one rank stand in input order, by ord.
    """
    label = F.lit(None).cast("string")
    for k, v in PRIORITIES.items():
        label = F.when(F.col("position") == k, v).otherwise(label)
    rows = compared.where("has_reference and diff is not null").withColumn("priority", label)
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("priority"))
    gap = F.when(F.col("gap2025").isNotNull(), filled("Gap para o recorte: {} pts", signed_text(F.col("gap2025"))))
    evidence = F.concat_ws(" · ", filled("Variação: {} pts", signed_text(F.col("diff"))), gap)
    return rows.select("unit", "grade", "subject", "priority", F.coalesce(rank, F.lit(len(ORDER) + 1)).cast("int").alias("rank"), F.col("position_label").alias("situation"), evidence.alias("evidence"), F.col("position_tone").alias("tone"), "ord")


def badge(position: Column) -> Column:
    """The style class of a position; null for an unknown one."""
    out = F.lit(None).cast("string")
    for key, tone in BADGES.items():
        out = F.when(position == key, tone).otherwise(out)
    return out


def value_domain(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Chart domain over several columns: least, greatest, and both with a padding of 18 % of the range, 6 at least."""
    out = rows.agg(F.least(*[F.min(c) for c in columns]).alias("low"), F.greatest(*[F.max(c) for c in columns]).alias("high"))
    span = F.when(F.col("high") > F.col("low"), F.col("high") - F.col("low")).otherwise(1.0)
    pad = F.greatest(span * 0.18, F.lit(6.0))
    return out.withColumns({"axis_low": F.col("low") - pad, "axis_high": F.col("high") + pad})


def spread_labels(rows: DataFrame, group: list[str], y: str, order: list[str], gap: float = 30.0) -> DataFrame:
    """Label places at least `gap` apart, in order of y: y_i = max(y_i, place of the label before + gap).

    Closed form: gap * i + the running maximum of y_j - gap * j.
    """
    w = Window.partitionBy(*group).orderBy(y, *order)
    i = F.row_number().over(w) - 1
    rows = rows.withColumn("_lifted", F.col(y) - gap * i).withColumn("_i", i)
    run = F.max("_lifted").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("place", run + gap * F.col("_i")).drop("_lifted", "_i")


def csv_lines(detail: DataFrame) -> DataFrame:
    """One text line per detail row, every cell quoted, semicolons between; `CSV_HEADERS` is the header, unquoted."""
    cells = [F.col(c) for c in CSV_TEXTS] + [plain_number(F.col(c)) for c in CSV_NUMBERS] + [F.col("status")]
    return detail.select("unit", "grade", "subject", "period", F.concat_ws(";", *[csv_cell(c) for c in cells]).alias("line"), "ord")


def printed_reports(compared: DataFrame, title: str) -> DataFrame:
    """(unit, text): each unit's plain report: title, label, results, both buckets and priorities, rows in input order."""
    said = diagnosis(compared).select("unit", "grade", "subject", F.col("bucket").alias("b"), F.col("sentence").alias("s"))
    ranked = priorities(compared).select("unit", "grade", "subject", "priority", "rank", "evidence")
    keys = ["unit", "grade", "subject"]
    rows = compared.join(said, keys, "left").join(ranked, keys, "left")
    line = filled("- {} ({}): {} -> {} ({})", F.col("subject"), F.col("grade"), *[F.coalesce(plain_number(F.col(c)), F.lit("-")) for c in ("prof2024", "prof2025")], F.col("status"))
    urgent = filled("- [{}] {} ({}): {}", F.coalesce("priority", F.lit("")), F.col("subject"), F.col("grade"), F.coalesce("evidence", F.lit("")))

    def section(head: str, keep: Column, order: list[Column], text: Column, none: str) -> Column:
        each = F.array_sort(F.collect_list(F.when(keep, F.struct(*order, F.col("ord"), text.alias("_text")))))
        lines = F.array_join(F.transform(each, lambda x: x["_text"]), "\n")
        return F.concat(F.lit(f"\n{head}\n"), F.when(F.size(each) > 0, lines).otherwise(none))

    text = F.concat_ws(
        "\n",
        F.lit(title),
        F.concat(F.lit("Escola: "), F.first(unit_label(F.col("unit_name"), F.col("network"), F.col("region"), F.col("unit")))),
        section("Resumo por componente e série:", F.lit(True), [], line, ""),
        section("Destaques:", F.col("b") == "destaques", [], F.concat(F.lit("- "), "s"), "- Nenhum."),
        section("Pontos de atenção:", F.col("b") == "atencao", [], F.concat(F.lit("- "), "s"), "- Nenhum."),
        section("Prioridades para análise:", F.col("rank").isNotNull(), [F.col("rank")], urgent, "- Nenhuma."),
    )
    return rows.groupBy("unit").agg(text.alias("text"))
