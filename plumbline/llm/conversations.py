"""Conversation prefix trie: chained digests name every prefix, grouped prefixes are nodes, paths carry subtree sums upward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_groups, materialise, table

#: Ids of one block (2 to this power) of a node's conversations become one piece of the list that is hashed.
ID_BITS = 12


def _framed(role: Column, text: Column) -> Column:
    """The digest of a turn; the role's length in front tells ("ab", "c") from ("a", "bc")."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def number_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn, size): turns of a conversation numbered from 1, each as its digest and its text's UTF-8 bytes.

    Order: by turn, null first; turns of one number by their digest. A null role or text is empty. Rows without a
    conversation are left out.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("at"), _framed(*said).alias("turn"), F.octet_length(said[1]).cast("long").alias("size"))
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "turn"))
    return rows.select("conv", pos.alias("pos"), "turn", "size")


def whole_turns(turns: DataFrame) -> DataFrame:
    """(conv, depth, turn, size, last) of conversations as they stand: their turns, and a row of depth 0 for each."""
    last = turns.groupBy("conv").agg(F.max("pos").alias("last"))
    root = last.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"), "last")
    return root.unionByName(turns.join(last, "conv").select("conv", F.col("pos").alias("depth"), "turn", "size", "last"))


def spliced_turns(turns: DataFrame, family: int, most: int) -> DataFrame:
    """As whole_turns, with the first h turns of every conversation c taken from c - c % family; h = crc32(c) % most.

    A family's first turns are read by at most 2 * family - 1 conversations, so this join has no hot key. Fewer than h
    turns in the family's first conversation: all of them; no such conversation: none. A conversation can end up without
    turns; its row of depth 0 stays. The remainder takes the sign of c.
    """
    n = turns.groupBy("conv").agg(F.max("pos").alias("n"))
    c = n.select("conv", "n", (F.col("conv") - F.col("conv") % family).alias("base"), (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("h"))
    c = c.join(n.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    c = materialise(c.select("conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")), "rebuilt")
    root = c.select("conv", F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("size"), "last")
    taken = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base")
    first = c.join(taken, "base").where("pos <= h").select("conv", F.col("pos").alias("depth"), "turn", "size", "last")
    own = turns.join(c, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "turn", "size", "last")
    return root.unionByName(first).unionByName(own)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, depth): the digest of a prefix is that of its parent's digest and its last turn."""
    now = b""
    for batch in batches:
        digests, parents = [], []
        for depth, turn in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parents.append(now if depth else None)
            now = hashlib.sha256(now + turn if depth else b"").digest()
            digests.append(now)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(parents, pa.binary()), batch.column(3), batch.column(4)], ["conv", "depth", "digest", "parent", "size", "last"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (digest, block): the hash of each digest's pieces, joined by commas, while they pass."""
    node, state = None, None
    for batch in batches:
        done = []
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = digest, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())], ["digest", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations given as (conv, depth, turn, size, last): one row per distinct prefix, from the root.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's; root: null), n_convs, n_children, n_leaves and
    saved_tokens (sums over the node's subtree), ends_sha256 (the members that end here, by number) and digest.

    Every prefix of every conversation is one row, named by its chained digest; tasks count their prefixes before these
    meet by digest, so neither the root nor a common first turn is a hot group. The smallest member of a node owns it; the
    nodes that a conversation owns are the lower end of its path. Each node then goes to all its ancestors along its
    owner's path. What one path sends to the same ancestor is added up first, as a running sum from the path's end, so a
    path of n turns sends n rows and not n * n / 2. The chain of one conversation is followed by one task, row by row,
    with no more memory than a digest; so is the list of a node's members, which arrives in pieces.
    Copies are members like any others. No conversation: no rows, as there is no root then.
    """
    rows = turns.repartition("conv").sortWithinPartitions("conv", "depth")
    prefixes = materialise(rows.mapInArrow(_chained, "conv long, depth int, digest binary, parent binary, size long, last int"), "prefixes")
    nodes = prefixes.groupBy("digest").agg(F.min("conv").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    nodes = materialise(nodes, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.join(children, F.col("digest") == F.col("p"), "left").select("digest", "conv_id", "depth", "n_convs", "parent", "size", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")), "nodes")
    parents = materialise(nodes.where("n_children > 0").select(F.col("digest").alias("p"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("m")), "parents")

    given = nodes.select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    below = Window.partitionBy("conv").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sent = prefixes.join(given, (F.col("conv") == F.col("owner")) & (F.col("depth") == F.col("at")), "left")
    sent = sent.select("digest", F.sum(F.coalesce("saved", F.lit(0))).over(below).alias("saved"), F.sum(F.coalesce("leaf", F.lit(0))).over(below).alias("leaf"))
    sums = sent.where("saved > 0 or leaf > 0").groupBy("digest").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    ended = prefixes.where("depth = last").groupBy("digest", F.shiftright("conv", ID_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("piece"))
    ends = ended.repartition("digest").sortWithinPartitions("digest", "block").mapInArrow(_ends, "digest binary, ends_sha256 string")

    out = join_groups(nodes, parents, F.col("parent") == F.col("p")).join(sums, "digest").join(ends, "digest", "left")
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*long, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(number_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(spliced_turns(turns, family=5, most=9)).drop("digest")


#: crc32 of a decimal text, bit by bit: xor each byte, then eight times halve and, if a bit fell out, xor the polynomial.
CRC32_SQL = """(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)))"""

OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
cut AS (SELECT c, turns, {CRC32_SQL.format(x="c")} % 9 AS h FROM own),
rebuilt AS (SELECT a.c, list_concat(CASE WHEN b.turns IS NULL OR a.h = 0 THEN [] ELSE b.turns[1:a.h] END, a.turns[a.h + 1:]) AS t FROM cut a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefixes AS (SELECT c, t, unnest(range(len(t) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, CASE WHEN d = 0 THEN [] ELSE t[1:d] END AS k, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(t) = d), '') AS ends
  FROM prefixes GROUP BY 1, 2),
linked AS (SELECT *, CASE WHEN d > 1 THEN k[1:d - 1] WHEN d = 1 THEN [] END AS p FROM nodes),
children AS (SELECT p, count(*) AS n FROM linked WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT l.*, coalesce(c.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d][2]) END AS saved FROM linked l LEFT JOIN children c ON c.p = l.k),
sent AS (SELECT unnest(range(d + 1)) AS up, k, saved, n_children FROM full_nodes),
sums AS (SELECT CASE WHEN up = 0 THEN [] ELSE k[1:up] END AS k, sum(saved) AS saved, sum((n_children = 0)::INT) AS leaves FROM sent GROUP BY 1)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.k = n.k LEFT JOIN nodes q ON q.k = n.p
"""
