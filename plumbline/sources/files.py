"""Readers and writers: delimited extracts in either encoding, JSON partitions, record bundles, text and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.text import clean_text, file_label, or_default, parse_number
from plumbline.operators.assessment import alias_lists, latest_identity

#: Columns of the extract that are kept, and their names here (fixed values; the header is matched trimmed, in lower case).
EXTRACT = {"nomedepbol": "network", "codrmet": "region", "codesc": "unit", "nomesc": "unit_name", "serie_ano": "grade", "periodo": "period", "ds_comp": "subject", "medprof": "score"}
#: A file with more undecodable characters than this is read as windows-1252.
DAMAGE = 4

PARTITION_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("serieAno", T.StringType()),
    T.StructField("periodo", T.StringType()),
    T.StructField("componente", T.StringType()),
    T.StructField("medprof", T.DoubleType()),
])


def damaged_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files that are no UTF-8: counted by the lines Spark decodes, without reading a file whole; one row per file comes back."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("f"), F.regexp_count("value", F.lit("�")).alias("n"))
    return [r["f"] for r in lines.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") > DAMAGE).collect()]


def split_cells(line: Column) -> Column:
    """The cells of a line between semicolons: a quote anywhere opens or closes quoting and is dropped, two inside quotes are one.

    Pieces between quotes are outside and inside in turn. Semicolons inside are set aside before the line is cut; an empty
    piece outside, between two quotes, is a quote that stands for itself.
    """
    pieces = F.split(F.replace(line, F.lit("\x01"), F.lit("\x01a")), '"', -1)

    def read(all_: Column) -> Column:
        inner = lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(";"), F.lit("\x01b"))).when((p == "") & (i > 0) & (i < F.size(all_) - 1), '"').otherwise(p)
        cells = F.split(F.array_join(F.transform(all_, inner), ""), ";", -1)
        return F.transform(cells, lambda c: F.replace(F.replace(c, F.lit("\x01b"), F.lit(";")), F.lit("\x01a"), F.lit("\x01")))

    return F.transform(F.array(pieces), read)[0]


def read_extract(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """Raw assessment rows of yearly extracts {year: path}, as `operators.assessment` takes them.

    Semicolon-separated, quoted (`split_cells`), header-driven; unknown columns are not read. Rows without unit, name or score go. ord
    follows the years in the order given, then the place in the file. A path is one file.
    """
    out = None
    for i, (year, path) in enumerate(paths.items()):
        encoding = "windows-1252" if damaged_files(spark, [path]) else "UTF-8"
        # lines whole, as one column that the header line names; split_cells reads quotes as the site does
        raw = spark.read.options(sep="\x1f", quote="", header=True, encoding=encoding).csv(path)
        head = spark.range(1).select(split_cells(F.lit(raw.columns[0])).alias("c")).first()["c"]
        raw = raw.withColumnRenamed(raw.columns[0], "line").where(F.trim("line") != "").select(split_cells(F.col("line")).alias("cells"))
        place = {c.strip().lower().lstrip("\ufeff"): i for i, c in enumerate(head)}
        text = {name: clean_text(F.get("cells", F.lit(place[c]))) if c in place else F.lit("") for c, name in EXTRACT.items()}
        rows = raw.select(
            F.lit(year).alias("year"),
            or_default(text["network"]).alias("network"),
            *[text[n].alias(n) for n in ("region", "unit", "unit_name", "grade", "period", "subject")],
            parse_number(text["score"]).alias("score"),
            (F.monotonically_increasing_id() + F.lit(i) * F.lit(1 << 56)).alias("ord"),
        ).where("unit <> '' and unit_name <> '' and score is not null")
        out = rows if out is None else out.unionByName(rows)
    return out


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Per-unit JSON files (one array of rows each) as (unit, year, grade, period, subject, score); the file name is the unit."""
    rows = spark.read.schema(PARTITION_SCHEMA).json(path)
    unit = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(unit.alias("unit"), "year", F.col("serieAno").alias("grade"), F.col("periodo").alias("period"), F.col("componente").alias("subject"), F.col("medprof").alias("score"))


def partition_units(spark: SparkSession, path: str) -> DataFrame:
    """The units that have a partition file."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("unit"), "length")


def read_bundle(spark: SparkSession, path: str, records: str = "registros") -> DataFrame:
    """Records of {metadata, records} documents, one row each, with the document's metadata."""
    doc = spark.read.option("multiLine", True).json(path)
    meta = ["metadata"] if "metadata" in doc.columns else []
    return doc.select(*meta, F.posexplode(records).alias("ord", "r")).select(*meta, "ord", "r.*")


def source_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of source documents."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_sources(spark: SparkSession, path: str, schema: str, root: str = "") -> DataFrame:
    """(path, raw, data): each source's path below root with forward slashes, its whole text, and that parsed as JSON.

    A document that is no JSON of this schema has null data.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    name = F.replace(F.replace("path", F.lit("\\"), F.lit("/")), F.lit(root), F.lit("")) if root else F.replace("path", F.lit("\\"), F.lit("/"))
    return files.select(name.alias("path"), "raw", F.from_json("raw", schema).alias("data"))


def write_variants(executive: DataFrame, path: str) -> None:
    """The executive table, one folder per period variant, named without accents in lower case."""
    executive.withColumn("variant", file_label(F.col("variant"))).write.mode("overwrite").partitionBy("variant").parquet(path)


def write_identities(raw: DataFrame, path: str) -> None:
    """The dimension of units: latest identity of each."""
    latest_identity(raw).write.mode("overwrite").parquet(path)


def write_aliases(raw: DataFrame, path: str) -> None:
    """Units with former names, and these in order of first appearance."""
    alias_lists(raw).write.mode("overwrite").parquet(path)


def write_details(raw: DataFrame, path: str) -> None:
    """Detail rows clustered by unit in sorted files: a reader of few units skips by statistics.

    Adaptive execution sets the number of files by their size, and splits a unit that is too large for one.
    """
    kept = raw.select("unit", "year", "grade", "period", "subject", "score")
    kept.hint("rebalance", F.col("unit")).sortWithinPartitions("unit", "year").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> int:
    """Compact JSON lines; returns the bytes of the files written."""
    df.write.mode("overwrite").json(path)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def write_csv_export(lines: DataFrame, header: list[str], path: str) -> None:
    """A download: byte order mark and header first, then the lines in input order, as text in part files whose names are in order."""
    spark = lines.sparkSession
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("\ufeff" + ";".join(header)).alias("value"))
    body = lines.select(F.lit(1).alias("part"), F.col("ord").alias("k"), F.col("line").alias("value"))
    head.union(body).orderBy("part", "k").select("value").write.mode("overwrite").text(path)
