import importlib.util
import json

import pytest
from plumbline.operators import assessment as oa
from plumbline.operators import report as orp
from plumbline.sources import files

HEADER = "DEPADM;DEPBOL;NOMEDEPBOL;CODRMET;CODESC;NOMESC;SERIE_ANO;COD_PER;PERIODO;CO_COMP;DS_COMP;MEDPROF"


@pytest.mark.parametrize("encoding", ["utf-8", "windows-1252"])
def test_extract_round_trip(spark, tmp_path, encoding):
    lines = [HEADER, '1;1;Rede Estadual;3;10;"ESCOLA ""A""; B";9º Ano EF;1;MANHÃ;1;LÍNGUA PORTUGUESA;191,9', "1;1;;3;11;X;9º Ano EF;1;GERAL;1;MATEMÁTICA;1.234,5", "1;1;R;3;12;Y;9º Ano EF;1;GERAL;1;MATEMÁTICA;"]
    paths = {}
    for year in (2024, 2025):
        (tmp_path / f"{year}.csv").write_bytes("\r\n".join(lines).encode(encoding))
        paths[year] = str(tmp_path / f"{year}.csv")
    rows = files.read_extract(spark, paths).orderBy("ord").collect()
    assert [(r["year"], r["unit"], r["score"]) for r in rows] == [(2024, "10", 191.9), (2024, "11", 1234.5), (2025, "10", 191.9), (2025, "11", 1234.5)]
    assert (rows[0]["unit_name"], rows[0]["period"], rows[1]["network"]) == ('ESCOLA "A"; B', "MANHÃ", "Nao informado")


def test_partitions_bundles_hashes(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/10005.json").write_text(json.dumps([{"year": 2024, "serieAno": "9º", "periodo": "GERAL", "componente": "M", "medprof": 230.8}]))
    assert tuple(files.read_partitions(spark, str(tmp_path / "p")).first()) == ("10005", 2024, "9º", "GERAL", "M", 230.8)
    assert files.partition_units(spark, str(tmp_path / "p")).first()["unit"] == "10005"
    (tmp_path / "b.json").write_text(json.dumps({"metadata": {"v": "1"}, "registros": [{"codigo": "A"}, {"codigo": "B"}]}))
    assert [r["codigo"] for r in files.read_bundle(spark, str(tmp_path / "b.json")).orderBy("ord").collect()] == ["A", "B"]
    assert len(files.source_hashes(spark, str(tmp_path / "b.json")).first()["sha256"]) == 64


def test_sinks(spark, tmp_path, sf_dir):
    from plumbline.plans.adapters import assessment

    raw = assessment(spark, sf_dir)
    files.write_variants(oa.executive_variants(raw, ["MANHA", "NOITE"]), f"{tmp_path}/v")
    assert {r["variant"] for r in spark.read.parquet(f"{tmp_path}/v").select("variant").distinct().collect()} == {"all", "manha", "noite"}
    files.write_details(raw, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").count() == raw.count()
    files.write_csv_export(orp.csv_lines(oa.detail_comparison(raw)), orp.CSV_HEADERS, f"{tmp_path}/c")
    text = "".join(f.read_text(encoding="utf-8") for f in sorted((tmp_path / "c").glob("part-*")))
    first = text.split("\n")[0]
    assert text.count("\n") == oa.detail_comparison(raw).count() + 1
    files.write_identities(raw, f"{tmp_path}/i")
    files.write_aliases(raw, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/i").count() == raw.select("unit").distinct().count() and spark.read.parquet(f"{tmp_path}/a").columns == ["unit", "aliases"]
    assert first.startswith("﻿Escola;") and first.count(";") == 11


def test_stream_of_scores(spark, tmp_path):
    from plumbline.streaming.benchmarks import windowed_benchmark

    spark.createDataFrame([("2024-01-01 10:00:00", "g", "s", 1.0), ("2024-01-01 11:00:00", "g", "s", 3.0)], "ts string, grade string, subject string, score double").selectExpr("cast(ts as timestamp) ts", "grade", "subject", "score").write.parquet(f"{tmp_path}/in")
    stream = windowed_benchmark(spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("bench").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["state"], r["units"]) for r in spark.table("bench").collect()] == [(2.0, 2)]


def test_queries_match_their_oracles(spark, sf_dir):
    import os

    import duckdb
    import numpy as np
    import pandas as pd
    from plumbline.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    assert set(ORACLES) <= set(QUERIES)
    def plain(v):
        """Nulls and whole numbers as one kind each: pandas makes integers beside nulls doubles."""
        if isinstance(v, list | tuple | np.ndarray):
            return [plain(x) for x in v]
        return None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v

    for name, sql in ORACLES.items():
        mine, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(mine.columns) == cols, name
        rows = [sorted(str([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist()) for df in (mine, want)]
        assert rows[0] == rows[1], name


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    whole = all(importlib.util.find_spec(m) for m in ("plumbline.llm", "corpus_pipeline"))
    assert ("pipeline" in e.queries()) == whole


def cells_by_hand(line):
    """Character by character: a quote toggles, two inside quotes are one."""
    out, cell, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and inside and line[i + 1 : i + 2] == '"':
            cell += '"'
            i += 1
        elif c == '"':
            inside = not inside
        elif c == ";" and not inside:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]


def test_cells_of_lines(spark):
    import itertools

    from pyspark.sql import functions as F

    lines = ['ab"cd;e"f', "", ";", '"a""b";c', '""', '""""', '"""', 'a"""b;c', '"open;a', "x\x01a;y\x01b", *("".join(x) for n in range(1, 7) for x in itertools.product('";a', repeat=n))]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", files.split_cells(F.col("x")).alias("c")).collect()
    assert {r["x"]: r["c"] for r in got} == {x: cells_by_hand(x) for x in lines}
    assert cells_by_hand('ab"cd;e"f') == ["abcd;ef"]


def test_extract_with_quotes_inside_cells(spark, tmp_path):
    rows = ["﻿" + HEADER, '1;1;Rede;3;10;ESC"OLA; A"B;9º Ano EF;1;GERAL;1;MAT;1,5', "", '1;1;Rede;3;11;"X ""Y""";9º Ano EF;1;GERAL;1;MAT;0x10;extra', "1;1;Rede;3;12;curta"]
    (tmp_path / "a.csv").write_text("\n".join(rows), encoding="utf-8")
    got = files.read_extract(spark, {2024: str(tmp_path / "a.csv")}).orderBy("ord").collect()
    assert [(r["unit"], r["unit_name"], r["score"]) for r in got] == [("10", "ESCOLA; AB", 1.5), ("11", 'X "Y"', 16.0)]


def test_sources_raw_and_parsed(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"n": 1,\n "m": ["x"]}')
    (tmp_path / "s/b.json").write_text("no json")
    got = {r["path"].rsplit("/", 1)[1]: (r["raw"], r["data"] and (r["data"]["n"], r["data"]["m"])) for r in files.read_sources(spark, f"{tmp_path}/s", "n int, m array<string>").collect()}
    assert got == {"a.json": ('{"n": 1,\n "m": ["x"]}', (1, ["x"])), "b.json": ("no json", (None, None))}
    assert files.write_json(spark.range(2), f"{tmp_path}/j") == len('{"id":0}\n{"id":1}\n')
    assert sorted(x for f in (tmp_path / "j").glob("part-*") for x in f.read_text().split("\n") if x) == ['{"id":0}', '{"id":1}']


def test_ties_stand_in_input_order(spark):
    rows = [(y, "n", "r", u, u, "g", p, "s", sc, o) for o, (y, u, p, sc) in enumerate([(2024, "z", "GERAL", 1.0), (2024, "a", "GERAL", 1.0), (2024, "m", "GERAL", 5.0), (2025, "m", "GERAL", 9.0), (2025, "a", "GERAL", 5.0), (2025, "z", "GERAL", 5.0), (2025, "late", "GERAL", 1.0)])]
    raw = spark.createDataFrame(rows, "year int, network string, region string, unit string, unit_name string, grade string, period string, subject string, score double, ord long")
    pairs = oa.executive(raw)
    assert [r["unit"] for r in oa.growth_ranking(pairs).collect()] == ["z", "a", "m"]
    assert [r["unit"] for r in oa.growth_ranking(pairs, 2).collect()] == ["z", "a"]
    detail = oa.detail_comparison(raw)
    assert {r["unit"] for r in oa.table_rows(detail, oa.benchmark(pairs), 2).collect()} == {"z", "a"}
    ranked = orp.priorities(oa.against_benchmark(pairs, oa.benchmark(pairs)))
    assert [r["unit"] for r in ranked.orderBy("rank", "ord").collect()][-2:] == ["a", "m"] or ranked.count() == 3
