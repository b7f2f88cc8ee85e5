"""Merkle manifest of a dataset: ternary trees per group, a tree over the groups, and the authentication path of every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, materialise, table
from .conversations import CRC32_SQL

#: Children of a node; levels that one task climbs, so that an aligned block has 3 ** 6 = 729 nodes.
ARITY, LEVELS = 3, 6
BLOCK = ARITY**LEVELS

#: (siblings to the left, siblings to the right) of one level, as hex text.
Step = tuple[bytes, bytes]


def _h(digests: list[bytes]) -> bytes:
    """The digest of digests; all are hex text."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


class _Treehash:
    """A run of nodes of one level, grown leaf by leaf; under each level at most two digests wait for their run to fill."""

    def __init__(self, level: int):
        self.waiting: list[list[bytes]] = [[] for _ in range(level + 1)]

    def push(self, leaf: bytes) -> None:
        self.waiting[0].append(leaf)
        for x in range(len(self.waiting) - 1):
            if len(self.waiting[x]) < ARITY:
                return
            self.waiting[x + 1].append(_h(self.waiting[x]))
            self.waiting[x] = []

    def run(self) -> list[bytes]:
        """The nodes of the level; leaves that fill no run are one all the same."""
        for x in range(len(self.waiting) - 1):
            if self.waiting[x]:
                self.waiting[x + 1].append(_h(self.waiting[x]))
                self.waiting[x] = []
        return self.waiting[-1]


def _levels(nodes: int) -> int:
    """Levels that a block climbs if its group has so many nodes: to the group's single node, or LEVELS."""
    n = 0
    while n < LEVELS and nodes > 1:
        n, nodes = n + 1, -(-nodes // ARITY)
    return n


def _paths(leaves: list[bytes], levels: int) -> Iterator[list[Step]]:
    """The authentication path of each leaf of a block, from the one before.

    At each level the run that holds the leaf is at hand, while a treehash grows the run that follows by one leaf in each
    step; it is ready when the leaf enters it. Beside the leaves themselves, the memory is that of the levels squared.
    """
    runs, ahead = [], []
    for level in range(levels):
        first = _Treehash(level)
        for leaf in leaves[: ARITY ** (level + 1)]:
            first.push(leaf)
        runs.append(first.run())
        ahead.append(_Treehash(level))
    for i in range(len(leaves)):
        path = []
        for level, run in enumerate(runs):
            at = i // ARITY**level % ARITY
            path.append((b"".join(run[:at]), b"".join(run[at + 1 :])))
        yield path
        for level in range(levels):
            span = ARITY ** (level + 1)
            if i + span < len(leaves):
                ahead[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                runs[level], ahead[level] = ahead[level].run(), _Treehash(level)


def _folded(digest: bytes, path: list[Step]) -> bytes:
    for left, right in path:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def _packed(path: list[Step]) -> bytes:
    """A path as bytes: for each level the numbers of digests on either side, then the digests."""
    return b"".join(bytes([len(x) // 64, len(y) // 64]) + bytes.fromhex((x + y).decode()) for x, y in path)


def _unpacked(path: bytes) -> list[Step]:
    out, at = [], 0
    while at < len(path):
        mid = at + 2 + 32 * path[at]
        end = mid + 32 * path[at + 1]
        out.append((path[at + 2 : mid].hex().encode(), path[mid:end].hex().encode()))
        at = end
    return out


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by (g, block, pos): the node on top of each block, by one treehash, and how many its group has now."""

    def rows() -> Iterator[dict]:
        key, grow = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["g"], r["block"], r["n"]) != key:
                    if key is not None:
                        yield top(key, grow)
                    key, grow = (r["g"], r["block"], r["n"]), _Treehash(_levels(r["n"]))
                grow.push(r["digest"].hex().encode())
        if key is not None:
            yield top(key, grow)

    def top(key: tuple, grow: _Treehash) -> dict:
        return {"g": key[0], "pos": key[1], "n": -(-key[2] // BLOCK), "digest": bytes.fromhex(grow.run()[0].decode())}

    return _batched(rows(), pa.schema([("g", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """(the row above, the rows) of each block of rows sorted by (g, block, pos), where the row above has pos -1."""
    above, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["pos"] < 0:
                if above is not None:
                    yield above, rows
                above, rows = r, []
            else:
                rows.append(r)
    if above is not None:
        yield above, rows


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == 4 * BLOCK:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    yield pa.RecordBatch.from_pylist(some, schema)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each node to the top: inside its block, then the block's own."""

    def rows() -> Iterator[dict]:
        for above, nodes in _blocks(batches):
            leaves = [r["digest"].hex().encode() for r in nodes]
            for r, path in zip(nodes, _paths(leaves, _levels(nodes[0]["n"])), strict=True):
                yield {"g": r["g"], "pos": r["pos"], "path": _packed(path) + above["path"], "subroot": above["subroot"], "root": above["root"]}

    return _batched(rows(), pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.string()), ("root", pa.string())]))


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0 in the group's order) and n (the group's rows), without a task that sees a whole group.

    Rows are sorted in ranges and written; a row's number is its place in its range plus the rows of the group before it.
    """
    at = materialise(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    runs = at.groupBy(part.alias("run_part"), F.col(group).alias("run_g")).agg(F.min("at").alias("first"), F.count("*").alias("m"))
    of = Window.partitionBy("run_g")
    before = F.coalesce(F.sum("m").over(of.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialise(runs.select("run_part", "run_g", "m", (before - F.col("first")).alias("shift"), F.sum("m").over(of).alias("n")), "runs")
    both = join_groups(at, runs, (part == F.col("run_part")) & (F.col(group) == F.col("run_g")), how="inner")
    return both.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "run_part", "run_g", "m", "shift")


def _sorted_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(nodes of each round, the single nodes (g, pos, n, digest) on top), a round being LEVELS levels of every group."""
    rounds, block = [], F.floor(F.col("pos") / BLOCK).alias("block")
    while True:
        rounds.append(nodes)
        nodes = materialise(_sorted_blocks(nodes.select("g", block, "pos", "n", "digest")).mapInArrow(_climb, "g string, pos long, n long, digest binary"), "tops")
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds, nodes


def _under(nodes: DataFrame, above: DataFrame, carry: list[str]) -> DataFrame:
    """Nodes and, before each block, the row above it: (g, block, pos, n, digest, path, subroot, root, *carry)."""
    kinds = dict(nodes.dtypes)
    null = lambda **of: [F.lit(None).cast(t).alias(c) for c, t in of.items()]
    top = above.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *null(n="long", digest="binary"), "path", "subroot", "root", *null(**{c: kinds[c] for c in carry}))
    return _sorted_blocks(top.unionByName(nodes.select("g", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", *null(path="binary", subroot="string", root="string"), *carry)))


def _down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, pos, path, subroot, root) of the first round's nodes, from those above the last round's."""
    for nodes in reversed(rounds):
        above = materialise(_under(nodes, above, []).mapInArrow(_descend, "g string, pos long, path binary, subroot string, root string"), "paths")
    return above


def encoded(values: list[Column]) -> Column:
    """Values one after another, each as its UTF-8 length, a colon and its text; null is a dash."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def merkle_manifest(docs: DataFrame, fields: list[str], id_col: str, group_col: str, seen: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of docs and a check of each row against it.

    A row's leaf is the SHA-256 of its encoded fields. Leaves of a group ascend by id; three consecutive nodes become one
    until one is left, the group's subroot; subroots, by group (null first, by UTF-8 bytes), likewise give the root.
    seen: what a later reader found in place of some fields. folded_root is recomputed from the leaf as seen and the row's
    authentication path; verified tells whether it equals the root.
    Returns id, leaf, subroot, root, proof_sha256 (of all siblings, level by level, left to right), folded_root, verified.

    Rows are numbered by ranges, so that a group of any size is spread. Aligned blocks of BLOCK nodes go to tasks: a first
    pass finds each block's top node, round after round of LEVELS levels; then paths come down, each block's upper path
    once per block, and tasks advance the paths inside a block from leaf to leaf with treehash stacks.
    Nulls: a null id comes first, a null group is a group of its own. Rows of one id are ordered by leaf; equal rows are
    leaves of their own. An empty table has no root and gives no rows. Other columns are not read.
    """
    seen = seen or {}
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    now = [seen.get(c, F.col(c)) for c in fields]
    changed = F.lit(False)
    for c in seen:
        changed = changed | ~seen[c].eqNullSafe(F.col(c))
    leaf, found = (F.unhex(F.sha2(encoded(v), 256)) for v in ([F.col(c) for c in fields], now))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf.alias("digest"), F.when(changed, found).alias("seen"))
    leaves = materialise(_numbered(materialise(rows, "leaves"), "g", ["id", "digest"]), "numbered")
    rounds, tops = _rounds(leaves)
    forest = materialise(_numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "g", ["of"]), "subroots")
    upper, top = _rounds(forest)
    above = _down(upper, top.select("g", "pos", F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("digest")).alias("root")))
    named = forest.select(F.col("pos").alias("at"), "of", F.lower(F.hex("digest")).alias("sub"))
    above = above.join(named, F.col("pos") == F.col("at")).select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("sub").alias("subroot"), "root")
    above = _down(rounds[1:], above)
    results = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rows() -> Iterator[dict]:
            for top, nodes in _blocks(chain([first], batches)):
                upper, root, known = _unpacked(top["path"]), top["root"].encode(), {}
                siblings = b"".join([x + y for x, y in upper])
                for r, path in zip(nodes, _paths([r["digest"].hex().encode() for r in nodes], _levels(nodes[0]["n"])), strict=True):
                    proof = hashlib.sha256(b"".join([x + y for x, y in path]) + siblings).hexdigest()
                    inner = _folded((r["digest"] if r["seen"] is None else r["seen"]).hex().encode(), path)
                    if inner not in known:  # equal digests have equal ways up
                        known[inner] = _folded(inner, upper)
                    yield dict(zip(["id", *results, "verified"], [r["id"], r["digest"].hex(), top["subroot"], top["root"], proof, known[inner].decode(), known[inner] == root], strict=True))

        yield from _batched(rows(), pa.schema([first.schema.field("id"), *[(c, pa.string()) for c in results], ("verified", pa.bool_())]))

    schema = f"id {kind}, " + ", ".join(f"{c} string" for c in results) + ", verified boolean"
    return _under(leaves, above, ["id", "seen"]).mapInArrow(checked, schema).withColumnRenamed("id", id_col)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later texts have lost their line breaks where crc32 of the id is even."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(table(spark, sf_dir, "documents"), FIELDS, "doc_id", "source", {"text": changed})


_LEAF = "sha256(concat(" + ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + "))"

#: All nodes of the sources' trees (t = 0) and of the tree over them (t = 1); then every leaf climbs, its siblings beside it.
OP12_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_LEAF} AS leaf,
         {_LEAF.replace("text", "seen")} AS seen_leaf
  FROM (SELECT *, CASE WHEN {CRC32_SQL.format(x="doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS seen FROM documents)),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, seen_leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows),
tree AS (
  SELECT 0 AS lv, g, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT lv + 1, g, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lv, g, pos // 3),
subroots AS (SELECT g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
forest AS (
  SELECT 0 AS lv, pos, n, digest FROM subroots
  UNION ALL
  SELECT lv + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM forest WHERE n > 1 GROUP BY lv, pos // 3),
beside AS (
  SELECT t, lv, g, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM (SELECT 0 AS t, lv, g, pos, digest FROM tree WHERE n > 1 UNION ALL SELECT 1, lv, '', pos, digest FROM forest WHERE n > 1)
  WINDOW w AS (PARTITION BY t, lv, g, pos // 3 ORDER BY pos)),
climb AS (
  SELECT doc_id, g, leaf, seen_leaf AS now, 0 AS lv, pos, '' AS proof, 0 AS t, row_number() OVER () AS k FROM leaves
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, CASE WHEN b.t IS NULL THEN c.now ELSE sha256(b.lft || c.now || b.rgt) END,
         CASE WHEN b.t IS NULL THEN 0 ELSE c.lv + 1 END, CASE WHEN b.t IS NULL THEN s.pos ELSE c.pos // 3 END,
         c.proof || coalesce(b.lft || b.rgt, ''), CASE WHEN b.t IS NULL THEN c.t + 1 ELSE c.t END, c.k
  FROM climb c JOIN subroots s ON s.g = c.g
  LEFT JOIN beside b ON b.t = c.t AND b.lv = c.lv AND b.pos = c.pos AND b.g = CASE c.t WHEN 0 THEN c.g ELSE '' END
  WHERE c.t < 2),
root AS (SELECT digest FROM forest WHERE n = 1)
SELECT c.doc_id, c.leaf, s.digest AS subroot, r.digest AS root, sha256(c.proof) AS proof_sha256, c.now AS folded_root, c.now = r.digest AS verified
FROM climb c JOIN subroots s ON s.g = c.g, root r WHERE c.t = 2
"""
