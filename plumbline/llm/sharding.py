"""Sharding by histogram sort: exact byte counts below key boundaries, refined until the splitters hold, one exchange."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, n_partitions, table

KEY_BITS, FIRST_BITS, NEXT_BITS = 63, 14, 8


class _Bins:
    """Counted key intervals [start, start + 2**shift) as arrays, in key order."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.start, self.shift, self.bytes, self.rows = (np.array([r[i] for r in rows], dtype=object if i == 0 else np.int64) for i in range(4))

    def list(self):
        return list(zip(self.start.tolist(), self.shift.tolist(), self.bytes.tolist(), self.rows.tolist(), strict=True))


def _count(keys: DataFrame, bins: _Bins | None, finer: np.ndarray) -> list[tuple]:
    """Rows and bytes of finer bins: key >> finer[0] over all keys, or key >> finer[k] within each bin k whose finer is not -1.

    A task sums its own counts first. The tasks get the bins' starts, of which there are few (see `splitters`).
    """
    if bins is None:
        at = F.shiftleft(F.shiftrightunsigned("_key", int(finer[0])), int(finer[0]))
        got = keys.groupBy(at.alias("b")).agg(F.sum("_size"), F.count("*")).collect()
        return [(r[0], int(finer[0]), r[1], r[2]) for r in got]
    starts = bins.start.astype(np.int64)

    @F.pandas_udf("long")
    def place(k: pd.Series) -> pd.Series:
        key = k.to_numpy()
        by = finer[np.searchsorted(starts, key, side="right") - 1]
        return pd.Series(np.where(by >= 0, key >> np.maximum(by, 0) << np.maximum(by, 0), -1))

    got = keys.groupBy(place("_key").alias("b")).agg(F.sum("_size"), F.count("*")).where("b >= 0").collect()
    return [(r[0], int(finer[np.searchsorted(starts, r[0], side="right") - 1]), r[1], r[2]) for r in got]


def splitters(keys: DataFrame, shards: int, ranges: int, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of key ranges, their shard, and the rows of that shard before each range.

    keys: (_key, _size). Round by round the bins that hold a wanted cut beyond the tolerance are counted again in
    2**NEXT_BITS finer bins, and those with more than a range's share of rows or bytes in about four finer bins for each
    share; the others keep their counts. Only counts reach the driver: 2**FIRST_BITS rows at first, then in each round at
    most 16 * ranges + 2**NEXT_BITS * shards, however many rows there are.
    """
    bins = _Bins(_count(keys, None, np.array([KEY_BITS - FIRST_BITS])))
    if not len(bins.rows):
        return np.array([0], np.int64), np.zeros(1, np.int32), np.zeros(1, np.int64)
    total, n = int(bins.bytes.sum()), int(bins.rows.sum())
    goals = [total * i // shards for i in range(1, shards)]
    slack = tolerance * total / shards
    while True:
        ends = np.cumsum(bins.bytes)
        shares = np.maximum(bins.rows / max(1, n / ranges), bins.bytes / max(1, total / ranges))
        bits = np.where(shares > 1, np.ceil(np.log2(4 * np.maximum(shares, 1))), 0).astype(np.int64)
        for g in goals:
            k = int(np.searchsorted(ends, g))
            if min(abs(ends[k] - g), abs(ends[k] - bins.bytes[k] - g)) > slack:
                bits[k] = max(bits[k], NEXT_BITS)
        bits[(bins.shift == 0) | (bins.rows <= 1)] = 0
        if not bits.any():
            break
        finer = np.where(bits > 0, np.maximum(bins.shift - bits, 0), -1)
        deeper = _count(keys, bins, finer)
        bins = _Bins([x for k, x in enumerate(bins.list()) if bits[k] == 0] + deeper)
    ends = np.cumsum(bins.bytes)
    cuts = set()  # a cut after bin k - 1
    for g in goals:
        k = int(np.searchsorted(ends, g))
        cuts.add(k + 1 if abs(ends[k] - g) <= abs(ends[k] - bins.bytes[k] - g) else k)
    # several goals may fall on one huge row: their shards stay empty, numbers stay in order
    shard_of_goal = sorted((k + 1 if abs(ends[k] - g) <= abs(ends[k] - bins.bytes[k] - g) else k) for g in goals for k in [int(np.searchsorted(ends, g))])
    starts, shard, before, rows_in, held, kept = [], [], [], 0, 0, 0
    for k, (start, _, size, rows) in enumerate(bins.list()):
        s = int(np.searchsorted(shard_of_goal, k, side="right"))
        new = not shard or s != shard[-1]
        if new:
            rows_in = 0
        if new or held + rows > n / ranges or kept + size > total / ranges:
            starts.append(start if starts else 0)
            shard.append(s)
            before.append(rows_in)
            held = kept = 0
        held, kept, rows_in = held + rows, kept + size, rows_in + rows
    return np.array(starts, np.int64), np.array(shard, np.int32), np.array(before, np.int64)


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, tolerance: float = 0.001, carry: list[str] | None = None) -> DataFrame:
    """Put rows into shards whose bytes are near equal, by histogram sort over a 63-bit key.

    A row's size is its text's UTF-8 bytes plus `overhead`. The key's high 20 bits come from the text, the others from the
    id and the row's number in the scan: equal texts are neighbours in the sort, yet a group of copies of any size can be
    cut. A shard's bytes are off an equal share by `tolerance` shares at either end, or by one row if that is larger.
    Returns (id, size, text_crc32, shard, slot) and the columns of `carry`; slots run from 0 without gaps in each shard.
    Nulls: a null text counts as empty; a null id is an id like any other. Repeated rows are rows of their own. An empty
    table gives no rows. Other columns are not read; a carried column may have any name but those returned.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(
        F.struct(*[F.col(c) for c in dict.fromkeys([id_col, *(carry or [])])]).alias("_row"),
        (F.octet_length(text).cast("long") + overhead).alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_h"),
        F.monotonically_increasing_id().alias("_uid"),
    )
    id_ = F.col(f"_row.`{id_col}`")
    key = F.shiftleft(F.shiftrightunsigned("_h", 44), 43).bitwiseOR(F.shiftrightunsigned(F.xxhash64(id_, "_uid"), 21))
    kept = materialise(kept.withColumn("_key", key).drop("_h"), "shard-keys")
    ranges = max(4 * shards, min(16384, 4 * n_partitions(spark)))
    starts, shard, before = splitters(kept, shards, ranges, tolerance)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(starts, k.to_numpy(), side="right") - 1).astype(np.int32))

    @F.pandas_udf("int")
    def shard_of(r: pd.Series) -> pd.Series:
        return pd.Series(shard[r.to_numpy()])

    @F.pandas_udf("long")
    def rows_before(r: pd.Series) -> pd.Series:
        return pd.Series(before[r.to_numpy()])

    order = Window.partitionBy("_range").orderBy("_key", "_uid")
    placed = kept.withColumn("_range", range_of("_key")).withColumn("_rank", F.row_number().over(order) - 1)
    return placed.select(
        id_.alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        shard_of("_range").alias("shard"),
        (rows_before("_range") + F.col("_rank")).alias("slot"),
        *[F.col(f"_row.`{c}`").alias(c) for c in carry or [] if c != id_col],
    )


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
