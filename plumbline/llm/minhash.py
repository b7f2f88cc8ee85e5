"""Near-duplicates by HyperMinHash: compressed registers in bands, collision-corrected estimates, then whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_NAMES, bound_batches, connected_components, join_groups, materialise, table

#: Registers of a sketch; a register holds 6 bits of leading zeros and 10 bits of mantissa.
REGISTERS, BAND_ROWS, MANTISSA_BITS = 128, 4, 10
#: Estimates this far below the threshold still go to verification: over five standard errors of 128 registers.
SLACK = 0.22
#: Members of a bucket that one task compares with one another; a larger bucket is cut in blocks and all pairs of blocks.
BLOCK = 1024
#: Partners of one class that a task confirms; its set goes once to each such block.
PARTNERS = 64
#: Share of register collisions between sets of equal size, at one register (Yu and Weber, HyperMinHash, algorithm 4).
COLLISION = 0.169919487159739093975315012348

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_CONST = np.random.default_rng(20240229)
_BYTE = _CONST.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _CONST.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _CONST.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _CONST.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_starts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 texts that lie one after another are white space, and where words start."""
    gap = _SPACE[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = ~gap[inner]
    return gap, np.flatnonzero(begins)


def word_hashes(data: np.ndarray, bounds: np.ndarray, cut: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 texts that lie one after another, A-Z lowered, and each text's first word.

    bounds: where texts begin, and the end; cut: what `word_starts` gives for them, if known. A word's hash is a polynomial
    of a random value for each byte.
    """
    gap, starts = cut or word_starts(data, bounds)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    at = np.arange(len(data))
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    at -= np.maximum.accumulate(first)
    at[gap] = 0
    powers = np.full(int(at.max()) + 1, _BASE)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = _BYTE[_LOWER[data]] * powers[at]
    terms[gap] = 0
    return _mixed(np.add.reduceat(terms, starts)), np.searchsorted(starts, bounds)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of fewer words, the hash of all of them."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, 5)
    total = words[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total = _mixed(total) + words[j : n - k + 1 + j] * _PLACE[j]
    return np.unique(_mixed(total + np.uint64(k)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash sketch: for each hash function, leading zeros and mantissa bits of the least hash of the set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[i : i + 4096, None] * _MULT + _ADD).min(axis=0))
    zeros = 53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    rest = np.where(zeros < 53, least << (zeros + 1).astype(np.uint64), 0).astype(np.uint64) >> np.uint64(64 - MANTISSA_BITS)
    return (np.minimum(zeros, 63).astype(np.uint64) << np.uint64(MANTISSA_BITS) | rest).astype(np.uint16)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the shingle sets of their second column."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            text = rows.column(1).fill_null("").cast(pa.large_binary())
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            words, first = word_hashes(data, bounds - bounds[0]) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
            yield rows, [shingle_set(words[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def _identity(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: two sums over the set."""
    with np.errstate(over="ignore"):
        one = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
        two = [int(_mixed(s * _PLACE[1]).sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
    return np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64)


def sketch_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_shingles, s1, s2, sketch); the sketch is null for a text without words."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _shingled(batches):
            s1, s2 = _identity(sets)
            sketch = [registers(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1), pa.array(s2), pa.array(sketch, pa.binary())], ["id", "text_hash", "n_shingles", "s1", "s2", "sketch"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), text, F.xxhash64(text)).mapInArrow(sketched, f"id {kind}, text_hash long, n_shingles long, s1 long, s2 long, sketch binary")


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(c, n, sketch, shingles, low) of the wanted classes (c, id, n_shingles, s1, s2, sketch), from their representatives' whole texts.

    low: the shingles' sorted low 32 bits as bytes. Few wanted ids go to the texts; else texts and ids meet by a shuffle.
    """
    kind = dict(wanted.dtypes)["id"]
    n = wanted.count()
    few = (lambda df: F.broadcast(df)) if n <= BROADCAST_NAMES else (lambda df: df)
    ids = wanted.select(F.xxhash64("id").alias("w")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(few(ids), F.xxhash64("id") == F.col("w"), "left_semi")

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _shingled(batches):
            s1, s2 = _identity(sets)
            low = [np.sort(s.astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(s1), pa.array(s2), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(low, pa.binary())], ["id", "s1", "s2", "shingles", "low"])

    sets = texts.mapInArrow(rows_of, f"id {kind}, s1 long, s2 long, shingles binary, low binary").withColumnRenamed("id", "id_")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("a1") == F.col("s1")) & (F.col("a2") == F.col("s2"))
    keys = wanted.select("c", "id", F.col("n_shingles").alias("n"), "sketch", F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    found = materialise(sets.join(few(keys), same).select("c", "n", "sketch", "shingles", "low"), "sets")
    # an id that occurs several times with one set brings its class as often
    return found if found.count() == n else materialise(found.dropDuplicates(["c"]), "sets")


def _estimates(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows x and y (broadcast against each other)."""
    equal = (x == y).sum(axis=-1)
    chance = REGISTERS * COLLISION * 2.0**-MANTISSA_BITS * 4 * nx * ny / (nx + ny) ** 2
    return (equal - chance) / (REGISTERS - chance)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets satisfy 100 * intersection >= percent * union.

    The partners of each a are cut in blocks; the set of a goes once to each block, not once to each pair.
    """
    partners = materialise(pairs.groupBy(F.col("a").alias("lead")).agg(F.count("*").alias("m")), "partners")
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / PARTNERS)).cast("int")
    theirs = join_groups(pairs, partners, F.col("a") == F.col("lead"), how="inner").select("a", F.col("b").alias("c"), block.alias("block"))
    own = theirs.select("a", F.col("a").alias("c"), "block").distinct()
    asked = theirs.union(own).join(sets.select("c", "shingles"), "c")

    def confirm(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        c, x = group["c"].to_numpy(), [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        mine = x[int(np.flatnonzero(c == key[0])[0])]
        good = []
        for b, theirs in zip(c.tolist(), x, strict=True):
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            common = int(np.count_nonzero(mine[at] == theirs))
            if b != key[0] and 100 * common >= percent * (len(mine) + len(theirs) - common):
                good.append((key[0], b))
        return pd.DataFrame(good, columns=["a", "b"], dtype="int64")

    return asked.groupBy("a", "block").applyInPandas(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents that are linked, directly or through others, by Jaccard >= percent / 100 of five-word shingle sets.

    One row per document: id, n_shingles, text_hash, component_id (the smallest id of the group), kept (id = component_id)
    and keeper (exactly one row of each group, also where ids repeat).

    1. One pass over the texts leaves a set's size, its 128-bit identity and its sketch. Equal sets form one class.
    2. 32 bands of four registers bucket the classes. Two sets at Jaccard 0.75 miss all bands once in 190,000 times.
    3. Each class meets only the smallest class of its bucket, the lead; estimates, then whole sets, confirm links; links
       give components. A bucket whose other members are of one component is done: it can add no connection.
    4. In each remaining bucket, the pairs of other members that cross components and whose sizes allow a link are
       estimated, block by block, inside a task, then compared by the low 32 bits of their shingles; only pairs within a hundredth of the
       threshold leave the task, and whole sets confirm them. So no confirmed connection depends on which class led a
       bucket, no bucket is capped, and the pairs of a family of loose copies are never written out.
    Nulls: a null text has no words, an empty group of its own; a null id is treated alike and is never a component id
    unless the group has no other. Repeated rows fall in one group. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = materialise(sketch_documents(docs, id_col, text_col).withColumn("u", F.monotonically_increasing_id()), "sketches")
    worded = rows.where("n_shingles > 0")
    classes = worded.groupBy("s1", "s2", "n_shingles").agg(F.min("u").alias("c"), F.min("id").alias("least_id"), F.count("*").alias("m"))
    classes = materialise(classes, "classes")
    reps = rows.select("u", "id", "sketch").join(classes, F.col("u") == F.col("c")).select("c", "id", F.col("n_shingles"), "s1", "s2", "sketch")
    reps = materialise(reps, "representatives")

    @F.pandas_udf("array<long>")
    def bands(sketch: pd.Series) -> pd.Series:
        keys = np.frombuffer(b"".join(sketch), "<i8").reshape(len(sketch), -1)
        return pd.Series(list(keys))

    banded = reps.select("c", F.posexplode(bands("sketch")).alias("band", "key"))
    bucket = lambda b, k: (F.col("band") == F.col(b)) & (F.col("key") == F.col(k))
    leads = banded.groupBy(F.col("band").alias("lb"), F.col("key").alias("lk")).agg(F.min("c").alias("lead"), F.count("*").alias("m"))
    leads = materialise(leads.where("m > 1"), "leads")
    shared = materialise(join_groups(banded, leads, bucket("lb", "lk"), how="inner").select("band", "key", "c", "lead"), "buckets")

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series, nx: pd.Series, ny: pd.Series) -> pd.Series:
        a, b = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), -1) for s in (x, y))
        return pd.Series(_estimates(a, b, nx.to_numpy(), ny.to_numpy()))

    fits = lambda a, b: (F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100)
    cut = percent / 100 - SLACK
    side = lambda k, n, s: reps.select(F.col("c").alias(k), F.col("n_shingles").alias(n), F.col("sketch").alias(s))
    star = shared.where("c <> lead").select(F.col("lead").alias("a"), F.col("c").alias("b")).distinct()
    star = star.join(side("a", "nx", "x"), "a").join(side("b", "ny", "y"), "b").where(fits("nx", "ny"))
    star = materialise(star.where(estimate("x", "y", "nx", "ny") >= cut).select("a", "b"), "candidates")
    active = materialise(reps.join(shared.select("c").distinct(), "c", "left_semi"), "active")
    sets = _sets_of(docs, active, id_col, text_col)
    links = materialise(_verified(star, sets, percent), "links")
    first = connected_components(links)

    # all members of a bucket have met its lead; what is left to compare are the other members of different components
    labelled = shared.where("c <> lead").join(first, F.col("c") == F.col("node"), "left").select("band", "key", "c", F.coalesce("component", "c").alias("g"))
    labelled = materialise(labelled, "labelled")
    parts = labelled.groupBy("band", "key", "g").agg(F.count("*").alias("m"))
    open_ = parts.groupBy(F.col("band").alias("ob"), F.col("key").alias("ok")).agg(F.max_by("g", "m").alias("big"), F.max("m").alias("most"), F.sum("m").alias("m"), F.count("*").alias("parts"))
    open_ = materialise(open_.where("parts > 1"), "open-buckets")
    # the largest component meets the rest of its bucket only; the rest meets all; both in blocks, each pair of blocks once
    nb, nr = (F.ceil(n / BLOCK).cast("int") for n in (F.col("most"), F.col("m") - F.col("most")))
    spread = join_groups(labelled, open_, bucket("ob", "ok"), how="inner").withColumns({"nb": nb, "nr": nr})
    large = F.col("g") == F.col("big")
    own = F.when(large, F.col("nr") + F.pmod(F.xxhash64("c"), "nb")).otherwise(F.pmod(F.xxhash64("c"), "nr")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(large, F.col("nr") - 1).otherwise(F.col("nr") + F.col("nb") - 1)))
    spread = spread.select("band", "key", "c", "g", own.alias("own"), other.alias("other"))
    spread = spread.select("band", "key", "c", "g", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    members = spread.join(sets.select("c", F.col("n").alias("n_shingles"), "sketch", "low"), "c")

    def crossing(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        band, _, i, j = key
        joined = b"".join(group["sketch"])
        s, keys = np.frombuffer(joined, "<u2").reshape(len(group), -1), np.frombuffer(joined, "<i8").reshape(len(group), -1)
        low = [np.frombuffer(x, "<u4") for x in group["low"]]
        n, g, c, own = (group[k].to_numpy() for k in ("n_shingles", "g", "c", "own"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        for k in left:
            ok = right[(g[right] != g[k]) & (n[right] * percent <= n[k] * 100) & (n[k] * percent <= n[right] * 100) & ((own[right] != own[k]) | (c[right] > c[k]))]
            ok = ok[(keys[ok] == keys[k]).argmax(axis=1) == band]  # a pair meets in its first common band only
            ok = ok[_estimates(s[ok], s[k], n[ok], n[k]) >= cut]
            for x in ok:
                at = np.minimum(np.searchsorted(low[k], low[x]), len(low[k]) - 1)
                common = np.count_nonzero(low[k][at] == low[x])
                if 100 * common >= (percent - 1) * (n[k] + n[x] - common):
                    found.append((min(c[k], c[x]), max(c[k], c[x])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    more = members.groupBy("band", "key", "i", "j").applyInPandas(crossing, "a long, b long").distinct()
    more = materialise(more.join(star, ["a", "b"], "left_anti"), "candidates")
    second = materialise(_verified(more, sets, percent), "links")
    groups = first if second.isEmpty() else connected_components(links.union(second))

    # a class of one row without a link needs no name; a component's number is its least class, whose first row stays
    named = classes.join(groups, F.col("c") == F.col("node"), "left").where("component is not null or m > 1")
    named = materialise(named.withColumn("g", F.coalesce("component", "c")), "named")
    least = materialise(named.groupBy(F.col("g").alias("keeper_u")).agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")), "groups")
    names = join_groups(named.select("g", "m", F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("n_shingles").alias("an")), least, F.col("g") == F.col("keeper_u"), "size", "inner")
    names = materialise(names.drop("g", "size"), "names")
    same = (F.col("s1") == F.col("a1")) & (F.col("s2") == F.col("a2")) & (F.col("n_shingles") == F.col("an"))
    out = join_groups(rows.drop("sketch"), names, same)
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", "text_hash", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"), F.coalesce(F.col("u") == F.col("keeper_u"), F.lit(True)).alias("keeper"))


def one_of_each_group(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row left of each group of near-duplicates, all columns as they were.

    Documents without words stay, but for rows that repeat an id and text. A row is told by hashes of its id and its text.
    Null ids and texts are values like any other here. An empty table gives no rows.
    """
    groups = materialise(near_duplicates(docs, percent, id_col, text_col), "near-duplicates")
    told = groups.groupBy(F.xxhash64(id_col).alias("_i"), F.col("text_hash").alias("_t")).agg(F.bool_or("keeper").alias("stays"), F.count("*").alias("n"))
    told = materialise(told.where("n > 1 or not stays"), "not-kept")
    gone = told.where("not stays").select("_i", "_t")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col).alias("_own"), F.xxhash64(F.col(text_col).cast("string")).alias("_h"))
    rows = rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_NAMES else gone, (F.col("_own") == F.col("_i")) & (F.col("_h") == F.col("_t")), "left_anti")
    if not told.where("stays").isEmpty():
        rows = rows.dropDuplicates(["_own", "_h"])
    return rows.select("row.*")


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
