"""Language identification: the kernel and the regression against plain computations, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string"


def plain_spectrum(text):
    return {text[i:i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}


def test_spectrum_is_the_set_of_ngrams():
    rnd = random.Random(1)
    for _ in range(50):
        text = "".join(rnd.choice("ab é𝔘一 ") for _ in range(rnd.randint(1, 60)))
        got = L.spectrum(text)
        want = sorted(sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g)) for g in plain_spectrum(text))
        assert got.tolist() == want


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " " + "".join(random.Random(2).choice("abcdefgh ") for _ in range(999)) + " "
    whole = L.spectrum(text)
    monkeypatch.setattr(L, "PART", 7)
    assert np.array_equal(L.spectrum(text), whole)


def test_kernel_and_fit_against_plain_computation(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 100)  # several blocks
    rnd = random.Random(3)
    alphabet = {"aa": "abcde ", "bb": "cdefg ", "cc": "xyzab "}
    rows = [(i, "".join(rnd.choice(alphabet[g]) for _ in range(rnd.randint(5, 60))) + "x", g) for i, g in enumerate(["aa", "bb", "cc"] * 15)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = L.fit(df, landmarks=9, ridge=0.05)
    texts = [r.x for r in df.orderBy("doc_id").select(L.folded(F.col("text")).alias("x")).collect()]
    sets = [plain_spectrum(t) for t in texts]
    marks = [{int(g) for g in grams} for grams in L._spectra_of(model.landmarks)]
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    plain = np.array([[len({number(g) for g in s} & m) / np.sqrt(len(s) * len(m)) for m in marks] for s in sets])
    assert np.allclose(model.landmarks.kernel([L.spectrum(t) for t in texts]), plain, atol=1e-6)
    # the ridge solution minimises the weighted loss: its gradient is zero
    w = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(w)
    root = vectors @ np.diag(values ** -0.5) @ vectors.T
    phi = np.hstack([plain @ root, np.ones((len(texts), 1))])
    y = np.array([[1.0 if r[2] == g else -1.0 for g in model.languages] for r in rows])
    penalty = np.diag([0.05] * len(marks) + [0.0])
    direct = np.linalg.solve(phi.T @ phi / len(rows) + penalty, phi.T @ y / len(rows))
    assert np.allclose(model.margins([L.spectrum(t) for t in texts]), phi @ direct, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and sum(r.lang_pred == r.lang for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_never_reads_the_language_of_held_out_rows(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice(["der", "die", "the", "of"]) for _ in range(20)), rnd.choice(["x", "y"])) for i in range(60)]
    held = [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in rows]
    a = L.identify(spark.createDataFrame(rows, SCHEMA)).orderBy("doc_id").collect()
    b = L.identify(spark.createDataFrame([(i, t, "z" if h else g) for (i, t, g), h in zip(rows, held, strict=True)], SCHEMA)).orderBy("doc_id").collect()
    assert a == b and [r.held_out for r in a] == held


@pytest.mark.parametrize("lang", ["string", "int"])
def test_defined_cases(spark, lang):
    rows = [(i, "ab ba " * (i % 3 + 1) if i % 2 else "xy yx", "1" if i % 2 else "2") for i in range(40)]
    rows += [(100, None, "1"), (101, "12 .,", "2"), (102, "", None), (None, "ab", "1"), (104, "ab ba", None)] + [(105, "xy", "2")] * 50
    df = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.col("lang").cast(lang)).withColumn("score", F.lit(7)).withColumn("h", F.lit("q"))
    out = L.identify(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(rows)
    said = {r.doc_id: r for r in out.collect()}
    assert [said[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and said[100].score == 0
    assert said[104].lang_pred == "1" and said[105].lang_pred == "2" and not said[None].held_out
    empty = df.where("false")
    assert L.identify(empty).collect() == []
    unlabelled = L.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_sample_is_bounded_and_copies_do_not_fill_it(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "if(id < 2000, 'same text', 'word' || translate(id, '0123456789', 'abcdefghij')) AS text",
                                        "if(id < 2000 or id % 2 = 0, 'a', 'b') AS lang")
    labelled = rows.select("lang", L.folded(F.col("text")).alias("x"))
    sample, languages = L.draw_sample(labelled, 100, 10)
    got = sample.collect()
    assert languages == ["a", "b"] and 100 < len(got) < 300 and len({(r.lang, r.x) for r in got}) == len(got)
