"""The prefix trie against a plain one, and the centroid rollup against sums over all ancestors."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spendlens.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    whole = own
    if rebuild:
        whole = {}
        for c, ts in own.items():
            h = zlib.crc32(str(c).encode()) % 6
            whole[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, ms in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(ms) - 1) * len(node[-1][1]) if node else 0
    out = set()
    for node, ms in members.items():
        ends = ",".join(map(str, sorted(c for c in ms if tuple(whole[c]) == node)))
        out.add((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(kids.get(node, [])), leaves[node], saved[node],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, local_nodes=P.LOCAL_NODES, chunk=P.CHUNK, rebuild=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    numbered = P.number_turns(df)
    if rebuild:
        turns, convs = P.rebuilt_conversations(numbered)
    else:
        turns = P.whole_conversations(numbered)
        convs = turns.select("conv_id", "length").distinct()
    out = P.trie_report(P.prefix_paths(turns, convs, chunk), local_nodes)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(seed, n=120):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-150, 400), n):
        for turn in range(rnd.randint(1, 7)):
            rows.append((c, rnd.choice([turn, turn, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "yo", "é𝔘", "", None])))
    return rows + rows[:5] + [(None, 0, "user", "lost")]


@pytest.mark.parametrize(("seed", "local_nodes", "chunk"), [(1, 100_000, 4096), (2, 5, 2), (3, 40, 3)])
def test_against_a_plain_trie(spark, seed, local_nodes, chunk):
    rows = conversations(seed)
    assert trie(spark, rows, local_nodes, chunk) == plain(rows)


def test_deep_chain_hub_and_equal_conversations(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(60)]  # one long conversation
    rows += [(c, 0, "user", f"only {c}") for c in range(2, 40)]  # a hub
    rows += [(c, t, "a", "same") for c in range(70_000, 70_030) for t in range(3)] + [(200_000, t, "a", "same") for t in range(3)]  # copies over id blocks
    assert trie(spark, rows, 8, 4, rebuild=False) == plain(rows, rebuild=False)


def test_equal_rows_fill_a_conversation(spark):
    rows = [(7, 1, "user", "again")] * 50 + [(7, None, None, None), (300, 0, "user", "x")]
    assert trie(spark, rows, 10, 8) == plain(rows)


def test_empty_and_absent(spark):
    assert trie(spark, []) == set() and trie(spark, [(None, 1, "user", "x")]) == set()
    rows = [(c, 0, "user", "a") for c in range(101, 130)]  # no conversation 100: some are left without a turn
    assert trie(spark, rows) == plain(rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "ab", "x", 3, b"q")], SCHEMA + ", digest string, length int, node binary")
    turns = P.whole_conversations(P.number_turns(df))
    got = P.trie_report(P.prefix_paths(turns, turns.select("conv_id", "length"))).collect()
    assert {(r.depth, r.n_children, r.n_leaves) for r in got} == {(0, 1, 1), (1, 0, 1)}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "forest"])
def test_centroid_totals(shape):
    rnd = random.Random(4)
    for n in (1, 2, 3, 17, 200):
        parent = np.array([-1] + [{"random": rnd.randrange(i), "chain": i - 1, "star": 0, "forest": rnd.randrange(-1, i)}[shape] for i in range(1, n)])
        values = np.array([[rnd.randint(-5, 9), i] for i in range(n)])
        want = values.copy()
        for i in range(n):
            a = parent[i]
            while a >= 0:
                want[a] += values[i]
                a = parent[a]
        assert np.array_equal(P.centroid_totals(parent, values), want)
