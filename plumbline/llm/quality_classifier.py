"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically into lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, hashed_sample, materialise, table
from .minhash import word_hashes, word_starts

#: The model is fitted on at most this many labelled ids, those of the smallest hashes.
TRAINING_ROWS = 20_000
#: A document with a lower score goes.
CUT = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 48, 12, 6, 120, 40, 0.15

FEATURES = [
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "symbol_share", "bar_share", "mark_share", "stop_share", "newline_share", "high_byte_share",
    "distinct_share", "neighbour_repeats", "top_word_share", "trigram_repeats", "longest_word",
]

_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:", b"\n", bytes(range(0x80, 0x100)), b"abcdefghijklmnopqrstuvwxyz"], start=1):
    _CLASS[list(_bytes)] = _k
_N_CLASSES = 10
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def text_features(text: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text of an Arrow array, from its bytes and word hashes; null and empty texts give zeros."""
    out = np.zeros((len(text), len(FEATURES)))
    for at in range(0, len(text), 256):
        part = text.slice(at, 256).fill_null("").cast(pa.large_binary())
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        if not len(data):
            continue
        bounds = bounds - bounds[0]
        owner = np.repeat(np.arange(len(part)), np.diff(bounds))
        n = np.bincount(owner * _N_CLASSES + _CLASS[data], minlength=len(part) * _N_CLASSES).reshape(-1, _N_CLASSES)
        size = np.maximum(n.sum(1), 1)
        letters = np.maximum(n[:, 1] + n[:, 8] + n[:, 9], 1)
        cut = gap, starts = word_starts(data, bounds)
        words, first = word_hashes(data, bounds, cut)
        longest = np.add.reduceat(~gap, starts, dtype=np.int64) if starts.size else starts
        x = out[at : at + len(part)]
        x[:, 2] = n[:, 1] / letters
        x[:, 3:10] = (n[:, 2:9] / size[:, None])[:, [0, 1, 2, 3, 4, 5, 6]]
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if w := b - a:
                mine = words[a:b]
                _, times = np.unique(mine, return_counts=True)
                three = mine[:-2] * _PAIR * _PAIR + mine[1:-1] * _PAIR + mine[2:]
                spread = len(np.unique(three)) if w > 2 else 0
                x[i, 0], x[i, 1] = np.log(w), (bounds[i + 1] - bounds[i]) / w
                x[i, 10:14] = len(times) / w**0.9, (mine[1:] == mine[:-1]).mean() if w > 1 else 0, times.max() / w, 1 - spread / (w - 2) if w > 2 else 0
                x[i, 14] = np.log(longest[a:b].max())
    return out


@dataclass
class AdditiveModel:
    """Sums of lookup tables: bin edges of each feature, a table for each feature, and a table for each kept pair."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], side="right")]
        bins = {k: np.searchsorted(self.coarse[k], x[:, k], side="right") for i, j, _ in self.pairs for k in (i, j)}
        for i, j, values in self.pairs:
            total += values[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _step(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over ordered bins: up to `leaves` intervals, split where the gain is greatest; its value for each bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            lg, lh, rg, rh = cg[:-1], ch[:-1], cg[-1] - cg[:-1], ch[-1] - ch[:-1]
            gain = lg**2 / (lh + 1) + rg**2 / (rh + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            gain[(lh < 0.5) | (rh < 0.5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], a + k + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid in two by two blocks: its gain and the blocks' values."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    best, at = 0.0, None
    for r in range(1, len(g)):
        for blocks in [[(cg[r, 1:-1], ch[r, 1:-1]), (cg[r, -1] - cg[r, 1:-1], ch[r, -1] - ch[r, 1:-1]), (cg[-1, 1:-1] - cg[r, 1:-1], ch[-1, 1:-1] - ch[r, 1:-1]), (cg[-1, -1] - cg[r, -1] - cg[-1, 1:-1] + cg[r, 1:-1], ch[-1, -1] - ch[r, -1] - ch[-1, 1:-1] + ch[r, 1:-1])]]:
            gain = sum(a**2 / (b + 1) for a, b in blocks)
            c = int(gain.argmax())
            if gain[c] > best:
                best, at = float(gain[c]), (r, c + 1)
    out = np.zeros_like(g)
    if at:
        r, c = at
        for rows in (slice(0, r), slice(r, None)):
            for cols in (slice(0, c), slice(c, None)):
                out[rows, cols] = _leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost the tables of all features in turn, round after round, then those of the pairs that gain most on what is left.

    Works on a sample of a stated size. With rows of one class only, or none, the model is the smoothed share of ones.
    """
    prior = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return model
    cut = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
    model.edges = [cut(x[:, k], BINS) for k in range(x.shape[1])]
    model.coarse = [cut(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            g, h = (np.bincount(b, v, len(model.tables[k])) for v in (y - p, p * (1 - p)))
            add = RATE * _step(g, h)
            model.tables[k] += add
            total += add[b]
    small = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.coarse)]
    wide = [len(e) + 1 for e in model.coarse]

    def grids(i: int, j: int) -> list[np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return [np.bincount(small[i] * wide[j] + small[j], v, wide[i] * wide[j]).reshape(wide[i], wide[j]) for v in (y - p, p * (1 - p))]

    gains = sorted(((_quadrants(*grids(i, j))[0], i, j) for i in range(len(bins)) for j in range(i + 1, len(bins)) if min(wide[i], wide[j]) > 1), reverse=True)
    model.pairs = [(i, j, np.zeros((wide[i], wide[j]))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, values in model.pairs:
            add = RATE * _quadrants(*grids(i, j))[1]
            values += add
            total += add[small[i], small[j]]
    return model


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> AdditiveModel:
    """Fit on at most `rows` labelled ids outside the held-out fifth; features are computed by the tasks, for these ids only.

    Null labels, null ids and ids without a document are left out. An id counts once: of several labels their mean, of
    several texts that of the least hash.
    """
    label = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    ids = docs.where(~held_out(id_col)).select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    known = materialise(ids.join(label, F.col("_id") == F.col("_lid")).select(F.col("_id").alias("_lid"), "y"), "labelled-ids")
    chosen = hashed_sample(known, F.col("_lid"), known.count(), rows, "chosen-ids")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_features(b.column(0))
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([vectors, b.column(1), b.column(2)], ["x", "y", "o"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid"))
    one = texts.groupBy("_lid", "y").agg(F.min_by("_text", F.xxhash64("_text")).alias("t"))
    both = materialise(one.select("t", "y", F.xxhash64("_lid").alias("o")).mapInArrow(featured, "x array<double>, y double, o long"), "labelled")
    sample = both.orderBy("o", "y", "x").limit(rows).select("x", "y").toPandas()
    if not len(sample):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array(sample["x"].tolist()), sample["y"].to_numpy())


def score_column(model: AdditiveModel, text: F.Column) -> F.Column:
    """The score of a text column: bins and table additions over whole Arrow batches."""

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(t)))

    return score(text.cast("string"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS, cut: float = CUT) -> DataFrame:
    """Score every document: (row, score, predicted); row holds all columns of the document, so that none can clash.

    score lies between 0 and 1, higher for label 1; it depends on the text alone. predicted is 1 from `cut` on. Null and
    empty texts are scored as texts without words. Repeated rows get equal scores. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, label_col, rows)
    out = docs.select(F.struct("*").alias("row"), score_column(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op10_pairwise_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "score", "predicted")
