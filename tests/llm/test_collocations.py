"""Collocations against brute force in plain Python, and the shards' mining on its own."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from spendlens.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, support=30, max_words=4, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(FOLD)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(ws[i:i + k])) for i in range(len(ws) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    rows = {}
    for (lang, ws), a in cand.items():
        inside = any(b >= Fraction(8, 10) * a and g == lang and any(long[i:i + len(ws)] == ws for i in range(len(long) - len(ws) + 1))
                     for (g, long), b in cand.items() if len(long) > len(ws))
        if not inside:
            cuts = [(floor(Fraction(2000000 * a, f[lang, ws[:k]] + f[lang, ws[k:]])), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, found in rows.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])}


def corpus(seed, size=300):
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "Ab", "é", "ß x", "zz", "\x00", "x\x1cy", "q" * 50]
    stock = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9))) for _ in range(12)]
    docs = []
    for i in range(size):
        parts = [rnd.choice(stock) if rnd.random() < 0.6 else rnd.choice(vocabulary) for _ in range(rnd.randint(0, 8))]
        docs.append((i, rnd.choice([" ", ". ", "\t", "\n", "\r", "  ", ";"]).join(parts), rnd.choice(["en", "de", None])))
    return docs + [(None, None, "en"), (1, "", "fr"), (2, ".,;", "fr")] + [docs[0]] * 40


def result(df):
    return {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.mark.parametrize(("seed", "shard_bytes", "support", "bits"), [(1, 1 << 20, 30, 20), (2, 300, 7, 15), (3, 2000, 30, 15), (4, 50, 3, 15)])
def test_against_brute_force(spark, seed, shard_bytes, support, bits):
    docs = corpus(seed)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    assert result(C.collocations(df, support=support, shard_bytes=shard_bytes, filter_bits=bits)) == brute(docs, support)


def test_top_and_ties(spark):
    docs = [(i, "b a. a b. c a. a c", "en") for i in range(40)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert result(C.collocations(df, top=3)) == brute(docs, top=3)


def test_empty_and_rare(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.collocations(none).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "one two three", "en"), (2, None, None)], SCHEMA)).collect() == []


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([("x y", "en", 1, "q", 7)] * 31, "text string, lang string, n long, phrase string, score int")
    assert result(C.collocations(df)) == {("en", 1, "x y", 31, 31, 31, 62, 1000000)}


def test_local_support_prunes_but_loses_nothing(spark):
    """Four equal shards at a quarter of the support: only what is frequent in some shard is counted."""
    docs = [(i, f"a b. r{i} s{i}", "en") for i in range(40)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(1)
    shards = C.encode_shards(df, shard_bytes=110).collect()
    assert len(shards) > 2 and sum(s.n_words for s in shards) == 160
    assert result(C.collocations(df, shard_bytes=110)) == {("en", 1, "a b", 40, 40, 40, 160, 1000000)}


def test_shard_round_trip():
    words = C.words_of("Ab  a.\tb a, x")
    assert words == [b"ab", b"a", b".", b"b", b"a", b".", b"x"]
    ids = np.array([1, 2, 0, 3, 2, 0, 4], dtype="<i4").tobytes()
    shard = C.Shard("en", b"ab a b x", ids)
    at, _, count = shard.phrases(2, np.array([0, 3]))
    assert {shard.text(i, 2) for i in at} == {"ab a", "b a"} and list(count) == [1, 1]
