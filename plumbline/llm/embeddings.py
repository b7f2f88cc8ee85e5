"""Embedding near-duplicates by an inverted multi-index: codebooks of vector halves, their product grid, nearest cells, verification."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, hashed_sample, join_groups, materialise, table

_LOG = logging.getLogger(__name__)

#: Vectors that the codebooks are fitted on, and further vectors whose links to all vectors set the number of visited cells.
SAMPLE, QUERIES = 20_000, 2_000
#: Share of the queries' true links that the visited cells must hold; cells are then doubled.
RECALL = 0.995
#: With fewer true links than this, links made at the threshold itself must be held too.
ENOUGH_LINKS = 1_000
LEAST_CELLS = 4
#: Numbers that a block of cell distances or of visited cells may hold.
BLOCK = 4_000_000
#: Members and queries of a cell that meet in one task; a larger cell is cut in blocks and all pairs of blocks.
MEMBERS, ASKED = 2048, 4096


class MultiIndex:
    """Codebooks of both halves of unit vectors, and how many cells of their grid a query visits."""

    def __init__(self, vectors: np.ndarray, cells: int):
        self.dim, self.half = vectors.shape[1], vectors.shape[1] // 2
        rng = np.random.default_rng(5)
        self.books = [self._kmeans(np.ascontiguousarray(h), cells, rng) for h in (vectors[:, : self.half], vectors[:, self.half :])]
        self.visits = LEAST_CELLS

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
        k = min(k, len(x))
        centres = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
        for _ in range(8):
            own = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
            n = np.bincount(own, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, own, x)
            centres[n > 0] = sums[n > 0] / n[n > 0, None]
        return centres

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves to their centres, less the half's own square."""
        return [(book**2).sum(1) - 2 * h @ book.T for h, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True)]

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each unit vector, nearest first, by the sum of both halves' squared distances.

        Both halves' centres are sorted by distance; the cells of the n least sums lie among pairs of ranks (i, j) with
        (i + 1) * (j + 1) <= n, which is the staircase that a multi-sequence traversal walks.
        """
        ranks, far = [], []
        for d in self.distances(x):
            ranks.append(np.argsort(d, axis=1, kind="stable")[:, :n])
            far.append(np.take_along_axis(d, ranks[-1], axis=1))
        i, j = np.nonzero(np.outer(np.arange(1, far[0].shape[1] + 1), np.arange(1, far[1].shape[1] + 1)) <= n)
        out = np.empty((len(x), min(n, len(i))), np.int64)
        step = max(1, BLOCK // len(i))
        for a in range(0, len(x), step):
            z = slice(a, a + step)
            best = np.argsort(far[0][z][:, i] + far[1][z][:, j], axis=1, kind="stable")[:, :n]
            out[z] = np.take_along_axis(ranks[0][z][:, i] * len(self.books[1]) + ranks[1][z][:, j], best, axis=1)
        return out

    def places(self, far: list[np.ndarray], row: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The place of each cell among all cells, nearest first, seen from that row of `distances`; ties count as nearer."""
        out = np.empty(len(row), np.int64)
        step = max(1, BLOCK // self.cells)
        for a in range(0, len(row), step):
            r, c = row[a : a + step], cell[a : a + step]
            mine = far[0][r, c // len(self.books[1])] + far[1][r, c % len(self.books[1])]
            out[a : a + step] = (far[0][r][:, :, None] + far[1][r][:, None, :] <= mine[:, None, None] + 1e-12).sum((1, 2)) - 1
        return out

    def calibrate(self, queries: np.ndarray, seen: dict[int, int], threshold: float) -> None:
        """Visit enough cells to hold RECALL of the links seen, {place of the partner's cell: links}; then double.

        Too few links say little about the rest: links made at the threshold, each query with a vector in a random direction
        from it, then have to be held as well. They are as far apart as links can be.
        """
        need = _quantile(seen)
        if sum(seen.values()) < ENOUGH_LINKS:
            away = np.random.default_rng(6).normal(size=queries.shape)
            away -= (away * queries).sum(1, keepdims=True) * queries
            away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
            cosine = float(np.clip(threshold, -1, 1))
            made = cosine * queries + np.sqrt(1 - cosine**2) * away
            place = self.places(self.distances(queries), np.arange(len(queries)), self.nearest(made, 1)[:, 0])
            need = max(need, _quantile(dict(enumerate(np.bincount(place).tolist()))))
            _LOG.warning("%d links seen from %d queries: links made at the threshold set the visited cells to %d of %d", sum(seen.values()), len(queries), min(self.cells, 2 * need), self.cells)
        self.visits = int(min(self.cells, max(LEAST_CELLS, 2 * need)))


def _quantile(places: dict[int, int]) -> int:
    """The least number of cells that holds RECALL of the links; 0 without links."""
    if not places:
        return 0
    at = np.array(sorted(places))
    upto = np.cumsum([places[k] for k in at.tolist()])
    return int(at[np.searchsorted(upto, RECALL * upto[-1])]) + 1


def _link_places(unit: DataFrame, index: MultiIndex, queries: np.ndarray, labels: list, classes: np.ndarray, threshold: float) -> dict[int, int]:
    """{place of the partner's cell as the query sees it: true links}, from every query to all rows (v, c, label) of unit.

    Tasks compare whole blocks and return counts by place, of which there are at most as many as cells.
    """
    codes = {label: k for k, label in enumerate(dict.fromkeys(labels))}
    of = np.array([codes[label] for label in labels])
    asked = {k: np.flatnonzero(of == k) for k in codes.values()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, total = index.distances(queries), np.zeros(index.cells, np.int64)
        for b in batches:
            b = b.filter(pc.equal(pc.list_value_length(b.column(0)), index.dim))
            code = np.array([codes.get(label, -1) for label in b.column(2).to_pylist()], np.int64)
            x, c = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, index.dim), b.column(1).to_numpy()
            for k in np.unique(code[code >= 0]).tolist():
                mine = np.flatnonzero(code == k)
                y = x[mine] / np.linalg.norm(x[mine], axis=1, keepdims=True)
                home = None
                for a in range(0, len(asked[k]), 256):
                    q = asked[k][a : a + 256]
                    i, j = np.nonzero(queries[q] @ y.T >= threshold)
                    keep = classes[q[i]] != c[mine[j]]
                    if not keep.any():
                        continue
                    home = index.nearest(y, 1)[:, 0] if home is None else home
                    pair, times = np.unique(q[i[keep]] * index.cells + home[j[keep]], return_counts=True)
                    np.add.at(total, index.places(far, pair // index.cells, pair % index.cells), times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["place", "n"])

    found = unit.select("v", "c", "label").mapInArrow(count, "place long, n long")
    return {int(r[0]): int(r[1]) for r in found.groupBy("place").agg(F.sum("n")).collect()}


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Link vectors of one label whose cosine is at least `threshold`: id, n_links, component_id, kept (id = component_id).

    Equal vectors of a label form one class, counted by its size. Codebooks come from at most SAMPLE classes; every class
    is indexed in its nearest cell and visits `visits` cells, a number set on the links of QUERIES classes with all classes
    and bounded by the number of cells only. In a cell, whole blocks of queries and members are compared
    in double precision; a link found from both ends is counted once for each end, one found from one end for both.
    Links never leave a task as pairs: a task sends a count and the component's smallest class for each of its classes.
    Vectors that are null, zero, hold null or non-finite components or have no label link with nothing. Vectors of another
    length than the sample's most common one share one cell for each length. Null ids are kept. An empty table gives no rows.
    """
    v = F.col("v")
    # what goes to the cells: numbers as wide as they were given, which loses nothing
    number = np.dtype("<f4" if dict(vectors.dtypes)[vector_col] == "array<float>" else "<f8")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label")).withColumn("u", F.monotonically_increasing_id())
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.coalesce(v.isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    rows = materialise(rows.withColumn("key", F.when(valid, F.md5(F.array_join(F.transform(v, lambda x: (x + 0.0).cast("string")), ",")))), "vectors")
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("u").alias("c"), F.count("*").alias("m"), F.min("id").alias("least_id"))
    classes = materialise(classes, "vector-classes")
    unit = rows.select("u", "v").join(classes.select("c", "m", "label"), F.col("u") == F.col("c")).select("c", "m", "label", "v")
    unit = materialise(unit, "vector-members")

    n = unit.count()
    sample = hashed_sample(unit.select("label", "v", "c"), F.col("c"), n, SAMPLE + QUERIES, "vector-sample").orderBy(F.xxhash64("c"), "c").limit(SAMPLE + QUERIES).toPandas()
    index = None
    if len(sample):
        length = int(sample["v"].map(len).mode()[0])
        sample = sample[sample["v"].map(len) == length]
        x = np.array(sample["v"].tolist())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if length > 1:
            index = MultiIndex(x[:SAMPLE], int(np.clip(np.sqrt(n / 50), 4, 256)))
            # the last ones: centres lie nearer to the vectors that they were fitted on than to others
            x, label, c = x[-QUERIES:], sample["label"].tolist()[-QUERIES:], sample["c"].to_numpy()[-QUERIES:]
            index.calibrate(x, _link_places(unit, index, x, label, c, threshold), threshold)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // (index.visits if index is not None else 1))
        for b in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            vs = b.column(0).to_pylist()
            cells = [[0]] * len(vs)
            same = [i for i, x in enumerate(vs) if index is not None and len(x) == index.dim]
            if same:
                x = np.array([vs[i] for i in same])
                for i, c in zip(same, index.nearest(x / np.linalg.norm(x, axis=1, keepdims=True), index.visits).tolist(), strict=True):
                    cells[i] = c
            ends = np.cumsum([0, *map(len, vs)], dtype="<i4") * number.itemsize
            data = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(number)
            packed = pa.Array.from_buffers(pa.binary(), len(vs), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([packed, *(b.column(k) for k in range(1, b.num_columns)), pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    kind = dict(unit.dtypes)["label"]
    indexed = unit.select("v", "c", "m", "label").mapInArrow(visited, f"v binary, c long, m long, label {kind}, cells array<int>")
    indexed = materialise(indexed.withColumn("dim", (F.octet_length("v") / number.itemsize).cast("int")), "vector-index")
    members = indexed.select("label", "dim", F.get("cells", F.lit(0)).alias("cell"), "c", "m", "cells", "v", F.lit(True).alias("held"))
    asked = indexed.select("label", "dim", F.explode("cells").alias("cell"), "c", "m", F.slice("cells", 1, 1).alias("cells"), "v", F.lit(False).alias("held"))
    place = ["label", "dim", "cell"]
    held = members.groupBy(*place).agg(F.count("*").alias("nm"))
    asks = asked.groupBy(*place).agg(F.count("*").alias("nq"))
    sizes = materialise(held.join(asks, place).select(*place, F.ceil(F.col("nm") / MEMBERS).cast("int").alias("bm"), F.ceil(F.col("nq") / ASKED).cast("int").alias("bq")), "cells")
    both = members.union(asked).join(sizes, place)
    own = F.pmod(F.xxhash64("c"), F.when(F.col("held"), F.col("bm")).otherwise(F.col("bq"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("held"), F.col("bq")).otherwise(F.col("bm")) - 1))
    both = both.select(*place, "c", "m", "cells", "v", "held", own.alias("own"), other.alias("other"))
    both = both.select(*place, "c", "m", "cells", "v", "held", F.when(F.col("held"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("held"), F.col("other")).otherwise(F.col("own")).alias("j"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        unit = np.frombuffer(b"".join(group["v"]), number).reshape(len(group), -1).astype(np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        held, c, m = (group[k].to_numpy() for k in ("held", "c", "m"))
        home = np.array([x[0] for x in group["cells"]])
        mine, ask = np.flatnonzero(held), np.flatnonzero(~held)
        goes = np.array(group["cells"].iloc[mine].tolist()) if len(mine) else None
        n, a, b = np.zeros(len(group), np.int64), [], []
        for k in range(0, len(ask) if len(mine) else 0, 256):
            q = ask[k : k + 256]
            x, y = np.nonzero(unit[q] @ unit[mine].T >= threshold)
            other = c[q[x]] != c[mine[y]]
            x, y = x[other], y[other]
            np.add.at(n, q[x], m[mine[y]])
            back = ~(goes[y] == home[q[x], None]).any(axis=1)  # the member does not visit the query's cell
            np.add.at(n, mine[y[back]], m[q[x[back]]])
            a.append(c[q[x]])
            b.append(c[mine[y]])
        a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
        if not len(a):
            return pd.DataFrame({"c": [], "n": [], "root": []}, dtype="int64")
        ids, root = _forest(a, b)
        counts = pd.Series(n).groupby(c).sum()
        return pd.DataFrame({"c": ids, "n": counts.reindex(ids, fill_value=0).to_numpy(), "root": root})

    found = materialise(both.groupBy(*place, "i", "j").applyInPandas(compare, "c long, n long, root long"), "vector-links")
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("root <> c").select("c", "root"), "c", "root")
    named = classes.join(counts, "c", "left").join(components, F.col("c") == F.col("node"), "left").withColumn("g", F.coalesce("component", "c"))
    # a class alone with one row needs no name: it links with nothing
    named = materialise(named.where("n is not null or m > 1"), "linked-classes")
    least = materialise(named.groupBy("g").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")).withColumnRenamed("g", "group"), "vector-groups")
    named = join_groups(named, least, F.col("g") == F.col("group"), "size", "inner")
    named = materialise(named.select(F.col("label").alias("l"), F.col("key").alias("k"), "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "vector-names")
    out = join_groups(rows.select("id", "label", "key"), named, (F.col("label") == F.col("l")) & (F.col("key") == F.col("k")))
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op5_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
