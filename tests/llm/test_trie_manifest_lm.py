"""Conversation trie, Merkle manifest and language model against plain Python versions."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

WS = re.compile(r"[^\x20\x09-\x0D]+")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def crc(x):
    return zlib.crc32(str(x).encode())


def trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    nodes = collections.defaultdict(list)
    for c, own in turns.items():
        h = crc(c) % 9
        t = turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append((c, d == len(t)))
    children = collections.defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out, sums = [], {}
    for k in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = (sum(sums[x][0] for x in children[k]) or 1, saved + sum(sums[x][1] for x in children[k]))
        ends = ",".join(str(c) for c, end in sorted(nodes[k]) if end)
        parent = min(c for c, _ in nodes[k[:-1]]) if k else None
        out.append((min(c for c, _ in nodes[k]), len(k), parent, len(nodes[k]), len(children[k]), *sums[k], sha(ends)))
    return sorted(out, key=str)


def spark_trie(spark, rows, extra=False):
    from plumbline.llm.conversations import number_turns, prefix_trie, spliced_turns

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    if extra:
        df = df.withColumns({"depth": F.lit("x"), "digest": F.lit(1), "pos": F.lit(None).cast("int")})
    return sorted((tuple(r[c] for c in NODE) for r in prefix_trie(spliced_turns(number_turns(df), 5, 9)).collect()), key=str)


def test_trie_of_odd_conversations(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"t{min(t, c % 3)} é") for c in range(-12, 60) for t in range(c % 12)]
    rows += [(70, None, "a", "b"), (70, 1, None, None), (71, 1, "ab", "c"), (72, 1, "a", "bc"), (None, 1, "a", "b"), (73, 5, "", ""), (73, 5, "", "")]
    rows += [(c, t, "user", f"same {t}") for c in range(100_000, 100_400, 5) for t in range(3)]
    rows += [(10**12, t, "user", "x" * (t % 7)) for t in range(3000)]
    assert spark_trie(spark, rows, extra=True) == trie(rows)


def test_trie_of_nothing(spark):
    assert spark_trie(spark, []) == [] and spark_trie(spark, [(None, 1, "a", "b")]) == []
    assert spark_trie(spark, [(1, 0, None, None)]) == trie([(1, 0, None, None)])


def test_trie_query(spark, sf_dir):
    from plumbline.llm.conversations import op11_prefix_trie

    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    assert sorted((tuple(r[c] for c in NODE) for r in op11_prefix_trie(spark, sf_dir).collect()), key=str) == trie(rows)


def test_whole_conversations(spark):
    from plumbline.llm.conversations import number_turns, prefix_trie, whole_turns

    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "s", "b"), (2, 0, "u", "a"), (3, 0, "u", "z")], "conv_id long, turn long, role string, text string")
    got = {(r["depth"], r["conv_id"]): (r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in prefix_trie(whole_turns(number_turns(df))).collect()}
    assert got == {(0, 1): (3, 2, 2, 1), (1, 1): (2, 1, 1, 1), (2, 1): (1, 0, 1, 0), (1, 3): (1, 0, 1, 0)}


def text_of(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """All levels of the tree over these leaves."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_in(levels, at):
    """(left, right) siblings, level by level."""
    out = []
    for level in levels[:-1]:
        run = at - at % 3
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 3])))
        at //= 3
    return out


def manifest(rows):
    leaf_of = lambda r: sha("".join(map(text_of, r)))
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        upper = path_in(top, k)
        for at, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = path_in(trees[s], at) + upper
            now = leaf
            if r[0] is not None and crc(r[0]) % 2 == 0 and r[4] is not None:
                now = leaf_of((*r[:4], r[4].replace("\n", "")))
            for left, right in path:
                now = sha(left + now + right)
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def spark_manifest(spark, rows, extra=False):
    from plumbline.llm.manifest import FIELDS, merkle_manifest

    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    if extra:
        df = df.withColumns({c: F.lit(0) for c in ("g", "pos", "n", "id", "leaf", "seen", "path", "digest", "root")})
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle_manifest(df, FIELDS, "doc_id", "source", {"text": changed})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_manifest_of_odd_rows(spark):
    """A source of more than two blocks, more sources than a block has nodes, nulls, ties and equal rows."""
    rows = [(i, "hot", "en", i, f"line {i}\nline") for i in range(1700)]
    rows += [(10_000 + i, f"s{i}é" if i % 2 else f"ß{i}", None, None, "a\nb" if i % 3 else "") for i in range(760)]
    rows += [(5000, None, "en", 1, None), (5001, None, "", None, "x" * 300_000), (None, "hot", "en", 1, "a\n"), (7, "hot", "de", 1, "a"), (7, "hot", "de", 1, "a"), (7, "hot", "de", 1, "b"), (8, "", "", 0, "")]
    assert spark_manifest(spark, rows, extra=True) == manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 729, 730])
def test_manifest_sizes(spark, n):
    rows = [(i, "one", "en", 1, f"{i}\n") for i in range(n)]
    assert spark_manifest(spark, rows) == manifest(rows)


def test_manifest_query(spark, sf_dir):
    from plumbline.llm.manifest import op12_merkle_manifest

    rows = duckdb.sql(f"SELECT doc_id, source, lang, n_chars, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = sorted((tuple(r) for r in op12_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == manifest(rows)
    assert all(r[6] == (crc(r[0]) % 2 == 1 or "\n" not in (t or "")) for r, t in zip(sorted(got, key=lambda r: r[0]), (x[4] for x in sorted(rows)), strict=True))


def test_paths_advance_in_small_memory():
    from plumbline.llm.manifest import LEVELS, _levels, _paths, _Treehash

    leaves = [sha(str(i)).encode() for i in range(600)]
    levels = tree([x.decode() for x in leaves])
    for i, path in enumerate(_paths(leaves, _levels(600))):
        assert [(a.decode(), b.decode()) for a, b in path] == path_in(levels, i)
    grow = _Treehash(LEVELS)
    for leaf in leaves:
        grow.push(leaf)
        assert all(len(w) < 3 for w in grow.waiting[:-1])


def words_of(text):
    return WS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_scores(docs):
    """docs: (id, text) rows."""
    count = collections.Counter()
    for i, text in docs:
        if i is not None and crc(i) % 10:
            count.update(words_of(text))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in docs:
        toks = [*words_of(text), None]
        out.append((i, i is None or crc(i) % 10 == 0, len(toks), sum(count[t] > 0 for t in toks), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in toks)))
    return sorted(out, key=str)


def check_base(got, docs):
    want = base_scores(docs)
    got = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def test_language_model_query(spark, sf_dir):
    from plumbline.llm.lm import op13_gated_recurrent

    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = op13_gated_recurrent(spark, sf_dir).collect()
    check_base(got, docs)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 5 and sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_language_model_on_odd_texts(spark):
    from plumbline.llm.lm import language_model_scores

    docs = [(i, f"the Cat {i % 7} sat ON the mat. " * (i % 5)) for i in range(40)]
    docs += [(40, None), (41, ""), (42, " \n\t "), (None, "never seen the cat"), (43, "word " * 30_000), (44, "w" * 100_000), (45, "é" * 50), (46, "twice"), (46, "twice"), (47, "a\x0bb\x1cc Ä ä")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1.0), "row": F.lit("x"), "c": F.lit(0), "rare": F.lit(2)}).repartition(3)
    got = language_model_scores(df).collect()
    check_base(got, docs)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert language_model_scores(df.limit(0)).count() == 0
    alone = language_model_scores(df.where("doc_id is null")).collect()
    check_base(alone, [docs[43]])


def test_rare_words_meet_their_counts(spark, sf_dir, monkeypatch):
    """With few known words all others take the shuffle, to the same base scores."""
    from plumbline.llm import lm

    monkeypatch.setattr(lm, "KNOWN", 300)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    check_base(lm.op13_gated_recurrent(spark, sf_dir).collect(), docs)


def naive_score(net, v, text):
    """The log10 probability of one text, step by step in double precision, without the words' shares of their endings."""
    import pyarrow as pa
    from plumbline.llm.lm import MEMBERS, START, STATE

    p, s = {k: x.astype(np.float64) for k, x in net.p.items()}, STATE
    units = v.read(pa.array([text]))[1]
    h, before, total = np.zeros(s), START, 0.0
    for unit in units:
        x, a = p["x"][before], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[k * s : (k + 1) * s] + a[k * s : (k + 1) * s]))) for k in (0, 1))
        h = (1 - z) * np.tanh(x[2 * s :] + r * a[2 * s :]) + z * h
        c, m = divmod(int(unit), MEMBERS)
        classes, members = h @ p["wc"] + p["bc"], h @ p["wm"][c] + p["bm"][c]
        total += classes[c] - np.log(np.exp(classes).sum()) + members[m] - np.log(np.exp(members).sum())
        before = int(unit)
    return total / np.log(10)


def vocabulary(texts):
    import pyarrow as pa
    from plumbline.llm.lm import ENDINGS, HEAD, UNITS, Vocabulary, tokens

    known, counts = np.unique(tokens(pa.array(texts))[0], return_counts=True)
    unit = np.where(np.arange(len(known)) < HEAD - 1, np.arange(len(known)), -1)
    return Vocabulary(known, counts, unit, HEAD - 1, np.arange(ENDINGS) + UNITS - ENDINGS, np.zeros(ENDINGS), 1.0, len(texts))


def test_state_is_carried_over_windows_and_lanes():
    import pyarrow as pa
    from plumbline.llm.lm import Network, _joined

    texts = ["a b c d " * 60, "", "b", "c d x y z " * 15, "a" * 9, "x y " * 400] * 3
    v = vocabulary(texts[:4])
    net = Network()
    net.p = {k: x * 4 for k, x in net.p.items()}
    first, units = _joined([v.read(pa.array(x), False) for x in (texts[:7], texts[7:])])
    got = net.score(units, first) / np.log(10)
    assert np.allclose(got, [naive_score(net, v, t) for t in texts], rtol=1e-4)


def test_gradients_are_those_of_the_window():
    """The analytic gradient of every weight against differences of the loss."""
    from plumbline.llm.lm import START, STATE, UNITS, Network

    rng = np.random.default_rng(1)
    inputs, units = rng.integers(0, UNITS, (5, 3)), rng.integers(0, UNITS, (5, 3))
    inputs[0] = START
    keep, there = np.ones((5, 3), np.float32), np.ones((5, 3), np.float32)
    keep[3, 1], inputs[3, 1], there[4, 2] = 0, START, 0
    net = Network()
    net.p = {k: (x * 3).astype(np.float64) for k, x in net.p.items()}
    h = rng.normal(0, 0.5, (STATE, 3)).astype(np.float32)

    def loss():
        states = net._run(inputs, h, keep).reshape(-1, STATE)
        return -(net.log_probability(states, units.ravel()) * there.ravel()).sum() / there.sum()

    got = {}
    net._update = lambda grads, rate: got.update({k: g.copy() for k, g in grads.items()})
    net._window(inputs, units, h, keep, there, 0.0)
    for k, g in got.items():
        for at in np.argsort(-np.abs(g).ravel())[:6]:
            place, step = np.unravel_index(at, g.shape), 1e-2
            was = net.p[k][place]
            net.p[k][place] = was + step
            up = loss()
            net.p[k][place] = was - step
            slope, net.p[k][place] = (up - loss()) / (2 * step), was
            assert abs(slope - g[place]) < 0.02 * abs(g[place]) + 2e-4, (k, place)


def test_training_learns_what_follows():
    import pyarrow as pa
    from plumbline.llm.lm import Network, _joined

    texts = ["a b c d " * 50] * 40
    v = vocabulary(texts[:1])
    net = Network()
    first, units = v.read(pa.array(texts), False)
    before = net.score(units, first)
    for _ in range(60):
        net.train(units, first[:-1], 0.01)
    after = net.score(units, first)
    assert (after > before / 8).all() and np.allclose(after, after[0], rtol=1e-3)
