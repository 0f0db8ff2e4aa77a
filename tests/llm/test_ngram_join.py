"""N-gram join against brute force, in one block and in many."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlens.llm import ngram_join as J


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    rows = []
    passage = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(5, 120))]
        for _ in range(rnd.choice([1, 2, 3, 9])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w))
            if rnd.random() < .3:
                rows.append(rows[-1])
    rows += [" ".join([word() for _ in range(30)] + passage) for _ in range(6)]  # a passage in common is no link
    rows += [None, "", " \n", "a b", "a b", "A  b", "x", "w " * 20_000]
    return [(i, t, "x") for i, t in enumerate(rows)] + [(None, "a b", "y"), (None, None, None)]


def brute(rows):
    def parts(t):
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = {t: parts(t) for _, t, _ in rows}
    texts = [t for t in sets if sets[t]]
    links = defaultdict(set)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                links[a].add(b)
                links[b].add(a)
    group = {}
    for t in texts:
        todo = [t]
        while todo:
            u = todo.pop()
            if u not in group:
                group[u] = t
                todo += links[u]
    least = defaultdict(list)
    for i, t, _ in rows:
        if sets[t] and i is not None:
            least[group[t]].append(i)
    copies = Counter(t for _, t, _ in rows)
    return Counter((i, min(least[group[t]], default=None) if sets[t] else i, len(links[t]), copies[t] if sets[t] else 1) for i, t, _ in rows)


@pytest.mark.parametrize("seed, block", [(1, 400), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", 30 * block)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(4)
    out = J.jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in out) == brute(rows)


def test_representatives(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, _h string").repartition(4)
    kept = J.keep_representatives(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    classes = Counter(c for i, c, _, n in brute(rows).elements())
    with_words = [r for r in rows if (r[1] or "").split()]
    assert all(got[i, t] == 1 for i, t, _ in rows if not (t or "").split())
    kept_ids = {i for i, t in got if (t or "").split()}
    assert kept_ids == {c for i, c, _, _ in brute(rows) if any(r[0] == i for r in with_words) and c is not None}
    assert sum(got.values()) == len(kept_ids) + len(rows) - len(with_words)
    assert classes


def test_pruning_bound():
    need = J.least_agreements()
    assert need == sorted(need) and need[0] > 0 and all(m <= J.STEP * (k + 1) for k, m in enumerate(need))


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(7, 7)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        root[find(a)] = find(b)
    out = J.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {r.node for r in out} == linked and len(out) == len(linked)
    groups, expected = defaultdict(set), defaultdict(set)
    for r in out:
        groups[r.label].add(r.node)
        expected[find(r.node)].add(r.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(docs).count() == 0
    assert J.keep_representatives(docs).count() == 0
    assert J.jaccard_join(spark.createDataFrame([(1, None)], docs.schema)).collect()[0].class_id == 1


def test_near_copies_of_a_block_in_bounded_memory():
    """2,000 near copies: every pair is linked, and the pairs do not all lie in memory."""
    import tracemalloc
    from fractions import Fraction

    n = 2000
    common = " ".join(f"w{k}" for k in range(150))
    sets = [J.shingles(f"{common} own{k}") for k in range(n)]
    sigs = np.stack([J.signature(x) for x in sets])
    every = np.arange(n)
    tracemalloc.start()
    links = [(len(x), int((x[:, 0] < x[:, 1]).sum())) for x in J._block_links(every, every, sigs, sets, J.least_agreements(), Fraction("0.8"))]
    half = [len(x) for x in J._block_links(every[:n // 2], every[n // 2:], sigs, sets, J.least_agreements(), Fraction("0.8"), tile=300)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x for x, _ in links) == sum(x for _, x in links) == n * (n - 1) // 2
    assert sum(half) == n * n // 4
    assert peak < 150e6
