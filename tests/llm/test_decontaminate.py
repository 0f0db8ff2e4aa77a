"""Decontamination against brute force, proximity by hand, several blocks of items."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spendlens.llm import decontaminate as D


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items):
    wins = [(i, w[k:k + 13]) for i, t in items if i is not None for w in [words(t)] if w for k in range(max(1, len(w) - 12))]
    out = Counter()
    for i, t, *_ in docs:
        w, hit, found = words(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit.update(range(k, k + len(win)))
                    found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "a", "und", "É", "x9"]) if rnd.random() < .5 else "".join(rnd.choice("abcdef") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(3, items[0][1]), (99, None), (98, ""), (97, "?!"), (None, "the of a")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rnd.randint(0, 80))]
        if rnd.random() < .5:
            t = words(rnd.choice(items[:12])[1])
            a = rnd.randint(0, len(w))
            w[a:a] = t[rnd.choice([0, 0, 1]):]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w), "x"))
    docs += [(None, items[5][1], "y"), (7, None, "x"), (7, "", "x"), (8, " . ", "x"), (8, "the " * 30_000, "x"), (8, "the " * 30_000, "x")]
    return docs, items


@pytest.mark.parametrize("seed, max_terms, block_docs", [(1, D.MAX_TEST_TERMS, 4000), (2, 30, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, max_terms, block_docs):
    monkeypatch.setattr(D, "BLOCK_DOCS", block_docs)
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    out = D.digest(D.contamination(d, it, max_terms=max_terms)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == brute(docs, items)


def test_passes_over_other_splits(spark, monkeypatch):
    """The written texts are dealt to other partitions from the third pass on."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")
    plain = D.build_index
    dealt = []

    def build(docs, *args, **options):
        if len(dealt) == 2:
            for name in names:
                spark.conf.set(name, "1")
        again = docs.sparkSession.read.schema(docs.schema).parquet(*{f.rsplit("/", 1)[0] for f in docs.inputFiles()})  # planned anew
        dealt.append(again.rdd.getNumPartitions())
        return plain(again, *args, **options)

    monkeypatch.setattr(D, "build_index", build)
    monkeypatch.setattr(D, "BLOCK_DOCS", 7)
    docs, items = corpus(3)
    d = spark.createDataFrame(docs, "doc_id long, text string, _uid string").repartition(3)
    try:
        out = D.digest(D.contamination(d, spark.createDataFrame(items, "item_id long, text string"), max_terms=30)).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(dealt) > 2 and len(set(dealt)) == 2
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == brute(docs, items)


def test_rows_that_go(spark):
    docs, items = corpus(4)
    d = spark.createDataFrame(docs, "doc_id long, text string, _sha string")
    kept = D.drop_contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns
    bad = {t for i, t, _ in docs if next(iter(brute([(i, t)], items)))[-1]}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, t) for i, t, _ in docs if t not in bad)


def test_proximity(spark):
    item = [f"t{i}" for i in range(13)]
    near = item[:6] + ["and", "so"] + item[6:]
    far = item[:6] + ["z"] * 9 + item[6:]
    swapped = [item[1], item[0], *item[2:]]
    docs = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(swapped))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.length) for s in r.spans] for r in D.contamination(docs, items, slack=3).collect()}
    assert got == {1: [("phrase", 0, 13)], 2: [("proximity", 0, 15)], 3: [], 4: []}
    digest = {r.doc_id: r.n_hit for r in D.digest(D.contamination(docs, items, slack=3)).collect()}
    assert digest == {1: 13, 2: 0, 3: 0, 4: 0}


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.digest(D.contamination(docs, items)).collect()] == [0, 0]
    assert D.contamination(docs.limit(0), items).count() == 0
    assert D.drop_contaminated(docs, items).count() == 2


def test_hit_words(spark):
    df = spark.createDataFrame([([(1, 0, 13, "phrase"), (2, 5, 13, "phrase"), (1, 30, 2, "phrase")],)],
                               "spans array<struct<item_id:bigint,start:bigint,length:bigint,kind:string>>")
    assert df.select(D.hit_words(F.col("spans")).alias("n")).first().n == 20
