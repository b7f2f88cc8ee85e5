"""Best-fit packing: a configuration linear program over the length histogram, multiplicative weights, bounded knapsack pricing in whole sequences."""

from __future__ import annotations

import json
import logging
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, materialise, table

_LOG = logging.getLogger(__name__)

#: Entries that each of a worker's two token caches holds before it is emptied; about 200 bytes each.
CACHE = 150_000
#: The plan may use this share of sequences more than the dual bound; else it is made again with the next smaller step.
GAP = 0.01
#: Share of a pattern's scarcest length that is placed at once, before lengths are priced anew.
STEPS = (0.5, 0.2)

#: Counts by task and length up to this number (under 50 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_COUNTS = 500_000

_TOKENIZERS: dict[str, _WordTokenizer] = {}


#: Normaliser and splitter of the tokenizers whose words can be encoded one by one (fixed values).
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _WordTokenizer(dict):
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, as `tokenizers` gives them without adding special tokens.

    Words are encoded one by one for a tokenizer of WORD_RULES; with other rules, and where a text holds an added token of
    the file (which the library cuts out as such), the whole text goes through the library.

    The tokenizer's normaliser turns white space into one space and its splitter never crosses a space, so that a text's
    ids are those of its words one after another. Words repeat: their ids are kept here, up to CACHE words. A new word that is
    letters and then ASCII punctuation, all below U+0250 (where lower-casing and NFC act on single characters), is two of
    the splitter's pieces, whose ids come from the tokenizer's model and are kept too; any other new word goes through the
    whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = all(rules[k] == v for k, v in WORD_RULES.items()) and rules["post_processor"] is None
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)", re.IGNORECASE)
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: to_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x250)}
        self.model = self.tokenizer.model
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.id_bytes
        got = b"".join([ids[t.id] for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.as_bytes))])
        if len(piece) < 100:
            self.pieces[piece] = got
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        low = word.lower()
        letters = low.rstrip(string.punctuation)
        if letters.isalpha() and (word.isascii() or max(word) < "\u0250"):
            got = self.pieces.get(letters) or self._piece(letters)
            if tail := low[len(letters) :]:
                got += self.pieces.get(tail) or self._piece(tail)
        else:
            got = self._whole(word)
        if len(word) < 100:
            self[word] = got
        return got

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.added.search(text):
            return self._whole(text)
        # str.split also splits at U+001C to U+001F, which the tokenizer keeps: such a text counts as one word
        words = [text] if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else text.split()
        return b"".join(map(self.__getitem__, words))


def _tokenizer(path: str) -> _WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenise_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, [ids]) and the piece's task and number among the task's pieces of its length."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), [0] * (capacity + 1), _tokenizer(tokenizer_path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                cols = owner, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for row, text in enumerate(rows.column(1).to_pylist()):
                    got = encode(text or "") + b"\0\0\0\0"
                    n = len(got) // 4
                    for p, s in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - s)
                        mine = got if size == n else got[4 * s : 4 * (s + size)]
                        owner.append(row)
                        piece.append(p)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(mine))
                        rank.append(seen[size])
                        seen[size] += 1
                        if with_ids:
                            ids.append(mine)
                out = [rows.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:6]), pa.array([part] * len(owner), pa.int32())]
                names = [id_col, "piece", "start", "length", "ids_crc32", "_rank", "_part"]
                if with_ids:
                    ends = np.cumsum([0, *length]).astype(np.int32)
                    out, names = [*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, _rank long, _part int" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pieces, schema)


class _Knapsack:
    """Patterns {length: copies} of the greatest value for every room up to the capacity, no length oftener than it is left."""

    def __init__(self, value: np.ndarray, left: np.ndarray, capacity: int):
        self.items: list[tuple[int, int]] = []
        for size in np.flatnonzero((left > 0) & (value > 0))[::-1].tolist():  # of equal values the longer pieces
            copies, n = min(int(left[size]), capacity // size), 1
            while copies > 0:  # lots of 1, 2, 4, ... copies make up every number of copies
                self.items.append((size, min(n, copies)))
                copies, n = copies - n, 2 * n
        self.best = np.zeros(capacity + 1)
        took = np.full((len(self.items), capacity + 1), -1, np.int32)
        for k, (size, n) in enumerate(self.items):
            room = size * n
            got = self.best[: capacity + 1 - room] + n * value[size]
            took[k, room:][got > self.best[room:] + 1e-12] = k
            np.maximum(self.best[room:], got, out=self.best[room:])
        self.last = np.maximum.accumulate(took, axis=0, out=took)

    def pattern(self, room: int) -> dict[int, int]:
        out: dict[int, int] = {}
        k = len(self.items) - 1
        while k >= 0 and (k := int(self.last[k, room])) >= 0:
            size, n = self.items[k]
            out[size] = out.get(size, 0) + n
            room -= size * n
            k -= 1
        return out


def dual_bound(need: np.ndarray, capacity: int) -> float:
    """A bound of the covering program from below: the best of the dual prices 1 beyond capacity - t, 0 below t, else size / capacity."""
    size = np.arange(capacity + 1)
    count, volume = np.cumsum(need), np.cumsum(need * size)
    t = np.arange(1, capacity // 2 + 1)
    return float(max((count[-1] - count[capacity - t] + (volume[capacity - t] - volume[t - 1]) / capacity).max(initial=0.0), volume[-1] / capacity))


def _placed(need: np.ndarray, capacity: int, step: float) -> dict[tuple, int]:
    """{pattern: sequences} that holds all pieces: multiplicative weights price the lengths, those placed least dearest."""
    left, used = need.copy(), {}
    while left.any():
        share = np.divide(left, need, out=np.zeros(len(need)), where=need > 0)
        value = np.arange(capacity + 1) / capacity * np.exp(GAP * share / share.max())
        knapsack = _Knapsack(value, left, capacity)
        # from one table: the best pattern, and for each length, longest first, the best one that holds it, where that is worth as much
        good = [k for k in range(capacity, 0, -1) if left[k] and knapsack.best[capacity - k] + value[k] >= (1 - GAP / 2) * knapsack.best[capacity]] + [0]
        for k in good:
            pattern = knapsack.pattern(capacity - k)
            if k:
                pattern[k] = pattern.get(k, 0) + 1
            fits = min(int(left[s]) // c for s, c in pattern.items())
            if times := min(fits, max(1, int(step * fits))):
                key = tuple(sorted(pattern.items()))
                used[key] = used.get(key, 0) + times
                for s, c in key:
                    left[s] -= c * times
    return used


def solve_configurations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(pattern {length: copies}, sequences that use it)] that holds exactly the pieces of the histogram.

    The covering program: least sum of x_p so that every length is covered as often as it occurs. Multiplicative weights
    price lengths by the share that is still to be placed; a knapsack table, bounded by the pieces left, finds the dearest
    patterns, which are used for whole sequences and a small share of their scarcest length. So rounding leaves nothing.
    The number of sequences is held against the dual bound; beyond GAP smaller steps are tried, and then a warning logged.
    Everything here has the size of the histogram (at most `capacity` lengths) times the logarithm of its counts.
    """
    need = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        need[size] = n
    plan: list[tuple[dict[int, int], int]] = []
    for size in range(capacity, capacity // 2, -1):  # nothing fits beside these: exact
        if need[size] and not need[1 : capacity - size + 1].any():
            plan.append(({size: 1}, int(need[size])))
            need[size] = 0
    if not need.any():
        return plan
    bound, best, n = dual_bound(need, capacity), None, 0
    for step in STEPS:
        used = _placed(need, capacity, step)
        if best is None or sum(used.values()) < n:
            best, n = used, sum(used.values())
        if n <= np.ceil((1 + GAP) * bound):
            break
    else:
        _LOG.warning("%d sequences, %.2f %% above the dual bound of %.1f", n, 100 * (n / bound - 1), bound)
    return plan + [(dict(key), times) for key, times in best.items()]


def _runs(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Per run of pieces of one length: key (length and first rank in one number), first rank, first sequence, copies, offset."""
    rows, used, base = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for size, copies in pattern.items():
            first = used.get(size, 0)
            rows.append((size, first, base, copies, offset))
            used[size] = first + copies * times
            offset += size * copies
        base += times
    rows.sort()
    size, first, base_, copies, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    return (size << 44) + first, first, base_, copies, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack every document's tokens, then id 0, into few sequences of at most `capacity` tokens.

    Only documents longer than a sequence are cut. One row per piece: id, piece, start, length, ids_crc32, sequence_id,
    offset and (with_ids) the ids themselves. Pieces of a length are numbered by their task's count plus the counts of the
    tasks before it; the number alone decides the sequence, so that no task ever sees all pieces of a length.
    Nulls: a null text is empty and becomes the one token 0; a null id is kept. Repeated rows are packed as rows of their
    own. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    pieces = materialise(tokenise_pieces(docs, tokenizer_path, capacity, id_col, text_col, with_ids), "pieces")
    counts = materialise(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    key, first, base, copies, offset = _runs(solve_configurations(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    small = counts.count() <= BROADCAST_COUNTS
    ranked = pieces.join(F.broadcast(counts) if small else counts, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_part")
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            k = np.searchsorted(key, (size << 44) + rank, side="right") - 1
            nth = rank - first[k]
            seq, off = base[k] + nth // copies[k], offset[k] + nth % copies[k] * size
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id long, offset long")


def op1_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
