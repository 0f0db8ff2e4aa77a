"""Positive-unlabelled learning: accuracy on rows held out, defined cases."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F


from spendlens.llm import toxicity as T

SF01 = "/root/testdata/sf0.01"


def corpus(seed, n=1200, share=.15):
    rnd = random.Random(seed)
    bad, common = ["vile", "scornful", "hateful"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(common) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < share
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        docs.append((i, " ".join(words)))
        if rnd.random() < .6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = d.select("doc_id", T.held_out(F.col("doc_id")).alias("held_out"), T.score_documents(d, lab).alias("score")).collect()
    score = {r.doc_id: r.score for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(y, score[i] >= T.THRESHOLD) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    found = sum(y and p for y, p in held)
    assert found >= .9 * sum(y for y, _ in held) and found >= .9 * sum(p for _, p in held)


def test_labels_held_out_change_nothing(spark):
    docs, labels = corpus(2, 400)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    other = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    models = [T.train(d, spark.createDataFrame(x, "doc_id long, toxic int"), may_train=~T.held_out(F.col("id"))) for x in (labels, other)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias


def test_risk_stays_non_negative():
    rnd = np.random.default_rng(1)
    noise = [np.unique(rnd.integers(0, 50, 8).astype("<u4")) for _ in range(300)]
    toxic = [np.unique(np.append(x, 999).astype("<u4")) for x in noise[:60]]
    model = T.fit_nnpu(toxic, noise + toxic, prior=60 / 360)
    assert model.weights[999] > 0 and np.isfinite(model.weights).all()
    score = model.weights[999] + model.bias
    assert score > 0 > model.bias


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x y", 0), (1, "a" * 100_000, 0), (1, "a" * 100_000, 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    score = T.score_documents(docs, none)
    assert {round(r.s, 6) for r in docs.select(score.alias("s")).collect()} == {0.0}
    odd = spark.createDataFrame([(None, 1), (1, None), (9, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    assert docs.select(T.score_documents(docs, odd).alias("s")).count() == 5
    assert docs.limit(0).select(T.score_documents(docs.limit(0), odd).alias("s")).count() == 0


def test_features():
    assert len(T.features(None)) == len(T.features("12 , .")) == 0
    assert set(T.features("Abc abc")) == set(T.features("abc"))
    assert len(T.features("abcdefgh")) == 4  # the word and three beginnings


def test_table_shape(spark):
    from spendlens.llm.queries import QUERIES

    rows = QUERIES["op7_toxicity"](spark, SF01).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= .3) for r in rows)


def test_corpus_half_toxic(spark):
    docs, labels = corpus(3, share=.5)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in d.select("doc_id", T.score_documents(d, lab).alias("score")).collect()}
    held = [(y, score[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    toxic, clean = ([s for y, s in held if y == k] for k in (1, 0))
    # every toxic text scores above nearly every clean one: the terms are found though the ratio is at most log 2
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) > .97


def test_gradient_is_that_of_the_risk():
    rnd = np.random.default_rng(3)
    for prior in (0.05, 0.4):
        zp, zu = rnd.normal(size=7), rnd.normal(size=11)
        by_p, by_u = T.nnpu_gradient(zp, zu, prior)
        positive, negative = T.nnpu_risk(zp, zu, prior)
        loss = lambda z, y: np.log1p(np.exp(-y * z)).mean()
        assert np.isclose(positive, prior * loss(zp, 1)) and np.isclose(negative, loss(zu, -1) - prior * loss(zp, -1)) and negative > 0
        for z, by in ((zp, by_p), (zu, by_u)):
            for i in range(len(z)):
                eps = 1e-6
                z[i] += eps
                up = sum(T.nnpu_risk(zp, zu, prior))
                z[i] -= 2 * eps
                down = sum(T.nnpu_risk(zp, zu, prior))
                z[i] += eps
                assert np.isclose(by[i], (up - down) / (2 * eps), atol=1e-6)
    # where the second part is negative the step goes against it
    zp, zu = np.full(4, 6.0), np.full(5, -6.0)
    assert T.nnpu_risk(zp, zu, 0.5)[1] < 0
    by_p, by_u = T.nnpu_gradient(zp, zu, 0.5)
    s = 1 / (1 + np.exp(-6.0))
    assert np.allclose(by_p, 0.5 * s / 4) and np.allclose(by_u, -(1 - s) / 5)


def test_scores_without_toxic_texts_are_zero(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.s for r in docs.select(T.score_documents(docs, none).alias("s")).collect()} == {0.0}


def test_one_id_with_many_texts_stays_bounded(spark):
    word = lambda i: f"w{chr(97 + i % 26)}{chr(97 + i // 26)}"
    rows = [(7, f"{word(i)} vile") for i in range(300)] + [(i + 100, f"{word(i)} kind") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (150, 0), (160, 0)], "doc_id long, toxic int")
    model = T.train(docs, labels, max_positive=40, max_unlabelled=90)
    assert model.score(["vile"])[0] > model.score(["kind"])[0]
