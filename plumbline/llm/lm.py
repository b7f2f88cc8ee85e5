"""Language-model scores: a gated recurrent network over word units, with a class-factored softmax and state kept through a text."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, hashed_sample, materialise, table
from .minhash import word_hashes, word_starts

#: Units of the model: the most frequent words (and the end of a text) by themselves, all others by a hash of their ending.
HEAD, ENDINGS = 512, 512
#: Classes of the output and units of a class; units are dealt to classes by frequency.
CLASSES, MEMBERS = 32, 32
UNITS = HEAD + ENDINGS
STATE = 16
#: Steps between gradients' cuts; streams of texts read side by side, in training (fewer for few tokens) and in scoring.
WINDOW, LANES, SCORE_LANES = 16, 512, 512
#: Tokens of a stream that are worth another one.
STREAM = 2048
#: Tokens that a task gathers before it trains or scores them.
GATHERED = 1_500_000
#: The starting weights are fitted on about so many texts, and read no more than so many tokens of them, in so many passes and streams.
WARM_TEXTS, WARM_TOKENS, WARM_PASSES, WARM_LANES = 1500, 800_000, 3, 48
#: Counts of at most so many words, the most frequent ones, are sent to the tasks; texts meet the others by a shuffle.
KNOWN = 500_000
SMOOTH = 0.1
#: Weights are averaged in integers of this grain, so that the order of addition doesn't matter.
GRAIN = 1 << 24

SHAPES = {"x": (UNITS + 1, 3 * STATE), "u": (STATE, 3 * STATE), "wc": (STATE, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, STATE, MEMBERS), "bm": (CLASSES, MEMBERS)}
START = UNITS


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes, endings, first): words of an Arrow array's texts, A-Z lowered, and each text's first word.

    An ending is a hash of a word's last three bytes, its number below ENDINGS.
    """
    part = text.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
    data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
    cut = gap, starts = word_starts(data, bounds)
    words, first = word_hashes(data, bounds, cut)
    size = np.add.reduceat(~gap, starts, dtype=np.int64) if starts.size else starts
    last, mix = starts + size - 1, np.zeros(len(starts), np.uint32)
    for back in range(3):
        byte = data[np.maximum(last - back, 0)].astype(np.uint32)
        byte += np.uint32(32) * ((byte >= 65) & (byte <= 90))
        mix = mix * np.uint32(2654435761) + np.where(size > back, byte, 0)
    return words, ((mix ^ (mix >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(22)).astype(np.int32) % ENDINGS, first


@dataclass
class Vocabulary:
    """What tasks need of the corpus counts.

    known, counts: hashes, sorted, of the most frequent words, and their counts. unit: each one's unit, or -1 if only its
    ending is one. within: for each ending, log10 of the denominator of its other words' shares. total: log10 of the base's.
    """

    known: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    end_unit: int
    ending_unit: np.ndarray
    within: np.ndarray
    total: float
    end_count: int

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among the known, and which do: from a table by their low bits, which frequent words hold, else by search."""
        if not hasattr(self, "slots"):
            by_count = np.argsort(self.counts, kind="stable")
            self.slots = np.zeros(1 << 20, np.int32)
            self.slots[(self.known[by_count] & np.uint64((1 << 20) - 1)).astype(np.int64)] = by_count
            self.slot_words = self.known[self.slots]
        slot = (words & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = self.slots[slot]
        rest = np.flatnonzero(self.slot_words[slot] != words)
        at[rest] = np.minimum(np.searchsorted(self.known, words[rest]), len(self.known) - 1)
        hit = np.ones(len(words), bool)
        hit[rest] = self.known[at[rest]] == words[rest]
        return at, hit

    def read(self, text: pa.Array, whole: bool = True) -> tuple[np.ndarray, ...]:
        """(first, units, counts, hashes, endings) of all tokens, ends included, or the first two of these.

        Counts are -1 where not known; endings are -1 for ends and for words that are units.
        """
        words, endings, first = tokens(text)
        c, unit = np.full(len(words), -1, np.int64), self.ending_unit[endings]
        if len(self.known):
            at, hit = self.places(words)
            own = hit & (self.unit[at] >= 0)
            unit[own] = self.unit[at[own]]
            if whole:
                c[hit] = self.counts[at[hit]]
                endings[own] = -1
        ends, all_first = first[1:], first + np.arange(len(first))
        units = np.insert(unit, ends, self.end_unit)
        return (all_first, units, np.insert(c, ends, self.end_count), np.insert(words, ends, 0), np.insert(endings, ends, -1)) if whole else (all_first, units)


class Network:
    """A GRU whose input weights are a row of gate inputs for each unit; outputs are a class and a member of the class."""

    def __init__(self, weights: np.ndarray | None = None):
        self.p, at = {}, 0
        rng = np.random.default_rng(7)
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.p[name] = (rng.normal(0, 0.1, shape) * (not name.startswith("b")) if weights is None else weights[at : at + n].reshape(shape)).astype(np.float32)
            at += n
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.updates = 0

    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in SHAPES]).astype(np.float64)

    def _run(self, inputs: np.ndarray, h: np.ndarray, keep: np.ndarray, kept: list | None = None) -> np.ndarray:
        """States (steps, lanes, STATE) of a window of inputs (steps, lanes) after h (STATE, lanes); keep is 0 where a new text begins.

        Lanes lie next to each other in memory, so that gates are whole rows.
        """
        x = self.p["x"].T.take(inputs, axis=1).transpose(1, 0, 2)
        u, n = np.ascontiguousarray(self.p["u"].T), 2 * STATE
        out = np.empty((len(inputs), *h.shape), x.dtype)
        with np.errstate(over="ignore"):
            for t in range(len(inputs)):
                h = h * keep[t]
                a = u @ h
                gates = x[t, :n] + a[:n]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.divide(1, gates, out=gates)
                new = gates[STATE:] * a[n:]
                new += x[t, n:]
                np.tanh(new, out=new)
                if kept is not None:
                    kept.append((h, gates, new, a[n:]))
                h = h - new
                h *= gates[:STATE]
                h += new
                out[t] = h
        return np.ascontiguousarray(out.transpose(0, 2, 1))

    def _outputs(self, states: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, their exponentials, the sums of these) of one softmax."""
        logits = states @ w
        logits += b
        if not self.bounded:
            logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return logits, e, e @ np.ones(e.shape[1], e.dtype)

    def log_probability(self, states: np.ndarray, units: np.ndarray, grads: dict | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of the units' probabilities after the states; with grads, adds gradients there ("h": the states')."""
        # states are within -1 and 1, so small weights cannot overflow
        self.bounded = all(float(np.abs(self.p[w]).sum(-2).max() + np.abs(self.p[b]).max()) < 80 for w, b in (("wc", "bc"), ("wm", "bm")))
        # places sorted by class, so that the members of each class are one product
        c, m = np.divmod(units, MEMBERS)
        order, every = np.argsort(c.astype(np.int16), kind="stable"), np.arange(len(units))
        place = np.empty_like(order)
        place[order] = every
        states, c, m = states.take(order, axis=0), c[order], m[order]
        cuts = np.searchsorted(c, np.arange(CLASSES + 1))
        logits, e, total = self._outputs(states, self.p["wc"], self.p["bc"])
        out = logits[every, c] - np.log(total)
        if grads is not None:
            weight = weight[order]
            e *= (weight / total)[:, None]
            e[every, c] -= weight
            grads["wc"], grads["bc"], grads["h"] = states.T @ e, e.sum(0), e @ self.p["wc"].T
            grads["wm"], grads["bm"] = np.zeros_like(self.p["wm"]), np.zeros_like(self.p["bm"])
        for k in np.flatnonzero(np.diff(cuts)):
            rows = slice(cuts[k], cuts[k + 1])
            s, mine, some = states[rows], m[rows], every[: cuts[k + 1] - cuts[k]]
            logits, e, total = self._outputs(s, self.p["wm"][k], self.p["bm"][k])
            out[rows] += logits[some, mine] - np.log(total)
            if grads is not None:
                e *= (weight[rows] / total)[:, None]
                e[some, mine] -= weight[rows]
                grads["wm"][k], grads["bm"][k] = s.T @ e, e.sum(0)
                grads["h"][rows] += e @ self.p["wm"][k].T
        if grads is not None:
            grads["h"] = grads["h"].take(place, axis=0)
        return out[place]

    def _update(self, grads: dict, rate: float) -> None:
        self.updates += 1
        fix = np.sqrt(1 - 0.99**self.updates) / (1 - 0.9**self.updates)
        for k, g in grads.items():
            first, second = self.moments[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            self.p[k] -= (rate * fix) * first / (np.sqrt(second) + 1e-6)

    def train(self, units: np.ndarray, firsts: np.ndarray, rate: float, most: int = LANES) -> int:
        """One pass over texts that lie one after another: cut in lanes, read in windows; the state goes on, gradients stop.

        Returns the number of windows.
        """
        if not len(units):
            return 0
        lanes = max(1, min(most, len(units) // STREAM))
        steps = -(-len(units) // (lanes * WINDOW)) * WINDOW
        inputs, begins = np.empty_like(units), np.zeros(len(units), bool)
        inputs[1:] = units[:-1]
        begins[firsts] = True
        inputs[begins] = START
        grid = lambda a, fill: np.concatenate([a, np.full(lanes * steps - len(a), fill, a.dtype)]).reshape(lanes, steps).T
        inputs, begins, units, there = grid(inputs, START), grid(begins, True), grid(units, 0), grid(np.ones(len(units), np.float32), 0)
        h = np.zeros((STATE, lanes), np.float32)
        for t in range(0, steps, WINDOW):
            at = slice(t, t + WINDOW)
            h = self._window(inputs[at], units[at], h, 1 - begins[at].astype(np.float32), there[at], rate)
        return steps // WINDOW

    def _window(self, inputs: np.ndarray, units: np.ndarray, h: np.ndarray, keep: np.ndarray, there: np.ndarray, rate: float) -> np.ndarray:
        kept: list = []
        out = self._run(inputs, h, keep, kept)
        grads: dict = {}
        weight = there.ravel() / max(float(there.sum()), 1.0)
        self.log_probability(out.reshape(-1, STATE), units.ravel(), grads, weight)
        back = np.ascontiguousarray(grads.pop("h").reshape(out.shape).transpose(0, 2, 1))
        n, dh, du = 2 * STATE, np.zeros_like(h), np.zeros_like(self.p["u"])
        dx = np.empty((len(inputs), 3 * STATE, inputs.shape[1]), back.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            before, gates, new, a = kept[t]
            dh += back[t]
            slope = gates * (1 - gates)
            da, z = dx[t], gates[:STATE]
            np.multiply(before - new, slope[:STATE], out=da[:STATE])
            da[:STATE] *= dh
            dn = (1 - z) * dh
            dn *= 1 - new * new
            np.multiply(dn, a, out=da[STATE:n])
            da[STATE:n] *= slope[STATE:]
            np.multiply(dn, gates[STATE:], out=da[n:])
            du += before @ da.T
            dh *= z
            dh += self.p["u"] @ da
            dh *= keep[t]
            da[n:] = dn
        # a unit's gradient is the sum over its places
        ids = inputs.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        firsts = np.flatnonzero(np.diff(ids, prepend=-1))
        gx = np.zeros_like(self.p["x"])
        gx[ids[firsts]] = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, 3 * STATE).take(order, axis=0), firsts)
        self._update({**grads, "u": du, "x": gx}, rate)
        return np.ascontiguousarray(out[-1].T)

    def score(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each text's natural log probability. Whole texts are dealt to lanes, longest first; a lane reads text after text."""
        sizes = np.diff(first)
        loads = [(0, k) for k in range(min(SCORE_LANES, len(sizes)))]
        lanes: list[list[int]] = [[] for _ in loads]
        for i in np.argsort(-sizes, kind="stable").tolist():
            load, k = heapq.heappop(loads)
            lanes[k].append(i)
            heapq.heappush(loads, (load + int(sizes[i]), k))
        length = np.array([int(sizes[lane].sum()) for lane in lanes])
        by_length = np.argsort(-length, kind="stable")
        length = length[by_length]
        texts = np.array([i for k in by_length for i in lanes[k]])
        # the tokens in the order of the lanes, and where each lane begins among them
        places = np.repeat(first[texts] - np.cumsum(sizes[texts]) + sizes[texts], sizes[texts]) + np.arange(len(units))
        begin = np.cumsum(length) - length
        inputs = np.empty_like(units)
        inputs[1:] = units[:-1]
        inputs[first[:-1]] = START
        keep = (inputs != START).astype(np.float32)
        out, h = np.zeros(len(units)), np.zeros((STATE, len(length)), np.float32)
        for t in range(0, length[0], WINDOW):
            lanes_left = np.count_nonzero(length > t)
            length, begin, h = length[:lanes_left], begin[:lanes_left], h[:, :lanes_left]
            # a lane that ends within the window reads its last token again, and that isn't counted
            steps = np.arange(t, t + WINDOW)[:, None]
            at = places[begin + np.minimum(steps, length - 1)]
            states = self._run(inputs[at], h, keep[at])
            h = np.ascontiguousarray(states[-1].T)
            real = steps < length
            out[at[real]] = self.log_probability(states[real], units[at[real]])
        return np.add.reduceat(out, first[:-1])


def _gathered(batches: Iterator[pa.RecordBatch], column: int, vocabulary: Vocabulary, whole: bool) -> Iterator[tuple]:
    """(batches, what the vocabulary read of them), in lots of about GATHERED tokens."""
    held, got, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            held.append(rows)
            got.append(vocabulary.read(rows.column(column), whole))
            n += len(got[-1][1])
            if n >= GATHERED:
                yield held, *_joined(got)
                held, got, n = [], [], 0
    if held:
        yield held, *_joined(got)


def _joined(got: list[tuple]) -> tuple[np.ndarray, ...]:
    """What was read of several batches as one: arrays one after another, firsts shifted."""
    shift = np.cumsum([0, *[g[0][-1] for g in got]])
    first = np.concatenate([*[g[0][:-1] + k for g, k in zip(got, shift, strict=False)], shift[-1:]])
    return (first, *[np.concatenate([g[k] for g in got]) for k in range(1, len(got[0]))])


def count_words(texts: DataFrame, text_col: str) -> DataFrame:
    """(word, ending, c) of all words of the texts, a word being its hash; tasks count before words meet."""
    bound_batches(texts.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            words, at, c = np.unique(np.concatenate([w for w, _ in held]), return_index=True, return_counts=True)
            endings = np.concatenate([e for _, e in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(endings), pa.array(c)], ["word", "ending", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                held.append(tokens(batch.column(0).slice(at, 256))[:2])
                n += len(held[-1][0])
                if n >= 2 * GATHERED:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    parts = texts.select(F.col(text_col).cast("string")).mapInArrow(counted, "word long, ending int, c long")
    return parts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class LanguageModel:
    """vocabulary and weights go to tasks; rare: (word, c) of the words that the vocabulary doesn't know."""

    vocabulary: Vocabulary
    weights: np.ndarray
    rare: DataFrame
    train_tokens: int


def _vocabulary(counts: DataFrame, n_texts: int) -> tuple[Vocabulary, DataFrame, int]:
    """From counts (word, ending, c), all of the corpus: the vocabulary, the rare words' counts, and the number of tokens."""
    grades = sorted(counts.groupBy(F.floor(F.log2("c") * 16).alias("grade")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    enough, n = 1 << 62, 0
    for r in grades:
        n += r["n"]
        if n > KNOWN:
            break
        enough = r["least"]
    top = counts.where(F.col("c") >= enough).toArrow()
    known, counts_, endings = (top.column(c).to_numpy() for c in ("word", "c", "ending"))
    known = known.astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    known, counts_, endings = known[order], counts_[order].astype(np.int64), endings[order].astype(np.int64)
    frequent = np.lexsort((known, -counts_))[: HEAD - 1]

    mass, distinct = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["ending"]], distinct[r["ending"]] = r["c"], r["n"]
    total, v = int(mass.sum()) + n_texts, int(distinct.sum()) + (n_texts > 0)
    np.subtract.at(mass, endings[frequent], counts_[frequent])
    np.subtract.at(distinct, endings[frequent], 1)
    # units by frequency: the frequent words, the end, the endings of all other words
    sizes = np.concatenate([counts_[frequent], np.zeros(HEAD - 1 - len(frequent)), [n_texts], mass])
    place = np.empty(UNITS, np.int64)
    place[np.argsort(-sizes, kind="stable")] = np.arange(UNITS)
    unit = np.full(len(known), -1, np.int64)
    unit[frequent] = place[: len(frequent)]
    vocabulary = Vocabulary(known, counts_, unit, int(place[HEAD - 1]), place[HEAD:], np.log10(mass + SMOOTH * (distinct + 1)), float(np.log10(total + SMOOTH * (v + 1))), n_texts)
    return vocabulary, counts.where(F.col("c") < enough).select("word", "c"), total


def _fitted(texts: DataFrame, vocabulary, weights: np.ndarray | None, rate: float, passes: int, lanes: int, limit: int | None) -> np.ndarray | None:
    """Weights trained in every task from the same ones, averaged by the number of windows that each task has read."""

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, windows, left = Network(weights), 0, limit
        for _, first, units in _gathered(batches, 0, vocabulary.value, whole=False):
            units = units if left is None else units[:left]
            for _ in range(passes):
                windows += net.train(units, first[:-1][first[:-1] < len(units)], rate, lanes)
            left = left if left is None else left - len(units)
            if left == 0:
                break
        for _ in batches:
            pass
        if windows:
            whole = np.rint(net.weights() * windows * GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole) + 1, dtype=np.int32)), pa.array(np.append(whole, windows))], ["k", "v"])

    got = texts.mapInArrow(trained, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    if not got.num_rows:
        return weights
    sums = got.column("v").to_numpy()[np.argsort(got.column("k").to_numpy())]
    return sums[:-1] / (float(sums[-1]) * GRAIN)


def fit_language_model(docs: DataFrame, trained_on: Column, id_col: str, text_col: str) -> LanguageModel:
    """Counts of all words of the texts that trained_on marks, and a network that has read all these texts.

    Starting weights come from a small hashed sample, in one task. From these every task trains on all its texts, by
    truncated backpropagation, and the weights of all tasks are averaged; the driver gets one sum for each weight, and the
    counts of at most KNOWN words.
    """
    spark = docs.sparkSession
    texts = docs.where(trained_on).select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    n = texts.count()
    counts = materialise(count_words(texts, "text"), "word-counts")
    vocabulary, rare, total = _vocabulary(counts, n)
    shared = spark.sparkContext.broadcast(vocabulary)
    key = F.concat_ws(":", F.col("id").cast("string"), "text")
    sample = hashed_sample(texts, key, n, WARM_TEXTS, "first-texts").repartition(1).sortWithinPartitions(F.xxhash64(key), "text")
    weights = _fitted(sample.select("text"), shared, None, 0.006, WARM_PASSES, WARM_LANES, WARM_TOKENS)
    weights = _fitted(texts.select("text"), shared, weights, 0.004, 1, LANES, None)
    return LanguageModel(vocabulary, Network().weights() if weights is None else weights, rare, total)


def score_texts(docs: DataFrame, model: LanguageModel, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_tokens, n_known, base_score, score) of every text, in log10.

    base_score: the texts' tokens by their smoothed counts. score: by the network; a word that is no unit of its own has
    its ending's probability times its smoothed share of that ending's other words. Tasks know the counts of the frequent
    words; the others of a text are written beside it and meet their counts by a shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared, weights = spark.sparkContext.broadcast(model.vocabulary), spark.sparkContext.broadcast(model.weights.astype(np.float32))
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = shared.value, Network(weights.value)
        for held, first, units, c, words, endings in _gathered(batches, 1, v, whole=True):
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            per_text = lambda x, of: np.bincount(of, x, len(first) - 1)
            n = np.diff(first)
            seen, tail = c >= 0, np.flatnonzero((c < 0) & (endings >= 0))
            base = np.where(seen, np.log10(np.maximum(c, 0) + SMOOTH), 0.0)
            own = endings >= 0
            score = net.score(units, first) / np.log(10) + per_text(base[own] - v.within[endings[own]], owner[own])
            table_ = {"n_tokens": n, "n_known": np.bincount(owner[c > 0], minlength=len(n)), "base": per_text(base, owner) - n * v.total, "score": score}
            offsets = np.searchsorted(tail, first)
            rare = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(words[tail].view(np.int64)))
            ids = pa.chunked_array([h.column(0) for h in held]).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, table_.values()), rare], ["id", *table_, "rare"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(scored, f"id {kind}, n_tokens long, n_known long, base double, score double, rare array<long>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "first-scores")
    words = rows.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("m"))
    found = words.join(model.rare, F.col("w") == F.col("word"), "left").select("row", "m", F.coalesce("c", F.lit(0)).alias("c"))
    more = found.groupBy("row").agg(F.sum(F.col("m") * F.log10(F.col("c") + SMOOTH)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more_known"))
    out = rows.drop("rare").join(more, "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return out.select("row", "id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), (F.col("base") + add).alias("base_score"), (F.col("score") + add).alias("score"))


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Scores of all texts by a model of those whose id's crc32 modulo folds is not 0.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens: words, A-Z lowered, then one end.
    Words are told apart by a 64-bit hash. Nulls: a null text is empty (its end is its one token); a null id is held out.
    Repeated rows are scored alike but for the network's rounding (single precision). Without training texts the network
    has its first weights and every token the base's smoothing. An empty table gives no rows. Other columns are not read.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))
    model = fit_language_model(docs, ~held_out, id_col, text_col)
    out = score_texts(docs, model, id_col, text_col).withColumnRenamed("id", id_col)
    return out.select(id_col, held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_gated_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
