"""Shared helpers of the training-data operators: inputs, written intermediate tables, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir.

    Only a local master, where one machine is the whole cluster, may leave it unset; a temporary folder serves then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch that goes to a Python worker, where the application sets no number: texts are long, and the worker as
#: well as its executor (outside the heap) hold whole batches.
ARROW_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark.sparkContext.getConf().contains(key) and int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Names of groups up to this number (under 100 bytes each when hashed) are broadcast; of more, those of groups with over HOT rows.
BROADCAST_NAMES, HOT = 500_000, 200_000


def join_groups(rows: DataFrame, names: DataFrame, on: Column, size: str = "m", how: str = "left") -> DataFrame:
    """Join rows with the one row that names their group, so that no task gets a large group.

    names: materialised, with the group's number of rows as `size`. Few names are broadcast. Of many, the names of groups
    with over HOT rows are (of which there are at most the rows' number / HOT), and the others meet their rows by a shuffle.
    on: an equality of columns whose names differ on both sides. A row without a name stays if how is "left".
    """
    if names.count() <= BROADCAST_NAMES:
        return rows.join(F.broadcast(names), on, how)
    hot = F.broadcast(names.where(F.col(size) > HOT))
    rest = rows.join(hot, on, "left_anti").join(names.where(F.col(size) <= HOT), on, how)
    return rows.join(hot, on).unionByName(rest)


def hashed_sample(rows: DataFrame, key: Column, n: int, wanted: int, name: str) -> DataFrame:
    """About `wanted` of n rows, some more rather than fewer, those of the least hashes of a key that tells rows apart, written.

    The cut comes before any sort, so that a limit on what is left moves no more than that from all tasks together.
    """
    grain = 1 << 30
    share = min(1.0, 1.1 * wanted / max(n, 1) + 200 / max(n, 1))
    return materialise(rows.where(F.pmod(F.xxhash64(key), F.lit(grain)) < int(share * grain)) if share < 1 else rows, name)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of the edges with the smallest node it reaches.

    Rounds of hooking (every node takes the smallest label among its neighbours') and pointer jumping, each round written
    to the shared folder. Labels and edges meet in plain equi-joins on node, with an exchange on both sides, so that
    adaptive execution can split the partition of a hub. Ends when a round changes no label.
    Nulls: an edge with a null end is ignored. No edges: no rows. Repeated edges and loops change nothing.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = materialise(both.union(both.select("v", "u")).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"), "edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "labels")
    while True:
        near = both.join(labels, "u").groupBy(F.col("v").alias("u")).agg(F.min("l").alias("n"))
        hooked = labels.join(near, "u", "left").select("u", "l", F.least("l", "n").alias("n"))
        # a root (its own label) that has found a smaller label passes it on to all that point at it
        roots = hooked.groupBy(F.col("l").alias("r")).agg(F.min("n").alias("m"))
        step = materialise(hooked.join(roots, F.col("l") == F.col("r"), "left").select("u", F.least("n", "m").alias("l"), F.col("l").alias("old")), "labels")
        changed = not step.where("l <> old").isEmpty()
        labels = step.select("u", "l")
        if changed:
            jump = labels.select(F.col("u").alias("p"), F.col("l").alias("q"))
            labels = materialise(labels.join(jump, F.col("l") == F.col("p"), "left").select("u", F.coalesce("q", "l").alias("l")), "labels")
        else:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
