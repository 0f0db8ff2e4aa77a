"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts (P) and unlabelled
ones (U).  Its loss is the class-prior-corrected risk
``prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))``; where the second part turns
negative, the step goes against it (the non-negative estimator's correction).
Labels other than "toxic" are not used as negatives; all labelled texts give
the class prior.

Features are the distinct words of the whole text and their first four to six
characters, hashed; each weighs the log-ratio of its share in P and in U.  The fit runs in numpy on a bounded
sample: at most about ``max_positive`` toxic and ``max_unlabelled`` other texts,
chosen by a hash of the text's id (documented bound, the only sample here; where ids
repeat with different texts, by a hash of those).
Scoring reads every whole text of every row on the executors; the model is one
array of ``2 ** BITS`` floats.

Defined cases: a null or empty text has no words and gets the score of the
bias alone; labels without a document and documents without labels are fine; a
document labelled twice is toxic if any label says so; null ids are never
training rows; without toxic training texts every score is 0; repeated rows are
scored each; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import crc_remainder, materialize

BITS = 18
PREFIXES = (4, 5, 6)  # characters
_WORD = re.compile(r"[^\W\d_]+")
HELD_OUT_MODULUS, HELD_OUT_REMAINDER = 4, 2
THRESHOLD = 0.3
NEVER = -500.0  # the bias of a model without toxic texts: every score is 0


def features(text: str | None) -> np.ndarray:
    """The hashed distinct words of the whole text, and the beginnings of its words."""
    if not text:
        return np.zeros(0, dtype="<u4")
    words = set(_WORD.findall(text.lower()))
    parts = {w[:k] + "*" for k in PREFIXES for w in words if len(w) > k}
    codes = [crc32(w) for w in "\n".join(words | parts).encode("utf-8", "replace").split(b"\n")] if words else []
    return np.unique(np.array(codes, dtype="<u4") & np.uint32((1 << BITS) - 1))


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32[2 ** BITS]
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[features(t)].sum(dtype="float64") for t in texts], dtype="float64") + self.bias
        return np.where(z > NEVER, 1.0 / (1.0 + np.exp(-np.clip(z, NEVER, -NEVER))), 0.0)


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return owner, np.concatenate(rows) if rows else np.zeros(0, dtype="<u4")


def toxic_features(in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, min_texts: int = 4, min_z: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Which features are used, and every feature's log-ratio, from the numbers of texts that have them.

    Used are those that stand significantly (``min_z``) more often in the toxic
    texts than in the unlabelled ones, in ``min_texts`` of them at least.  How
    much more often is no condition: U holds toxic texts too, so where they are
    many the ratio is small for all; the penalty decides what a feature weighs.
    """
    share = (in_u + 0.5) / (n_u + 1.0)
    ratio = np.log((in_p + 0.5) / (n_p + 1.0)) - np.log(share)
    z = (in_p - n_p * share) / np.sqrt(n_p * share * (1 - share) + 0.25)
    return (in_p >= min_texts) & (z >= min_z), ratio


def nnpu_risk(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk with the logistic loss: of P as positive, and of the negatives (U less the share of P in it)."""
    return float(prior * np.logaddexp(0, -z_p).mean()), float(np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean())


def nnpu_gradient(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The direction of a step by the logits of P and of U: the gradient of the risk, or, where its second part is negative, against that part's."""
    s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
    of_p, of_u = -prior * s_p / len(z_p), s_u / len(z_u)  # of the second part
    if nnpu_risk(z_p, z_u, prior)[1] < 0:
        return -of_p, -of_u
    return of_p + prior * (s_p - 1) / len(z_p), of_u


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, l2: float = 2e-3) -> ToxicityModel:
    """Full-batch Adam on the non-negative risk with the logistic loss, over the ``toxic_features`` of the rows."""
    size = 1 << BITS
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(size, dtype="float32"), NEVER)
    (po, pf), (uo, uf) = _flat(positive), _flat(unlabelled)
    in_p, in_u = np.bincount(pf, minlength=size), np.bincount(uf, minlength=size)
    used, ratio = toxic_features(in_p, in_u, len(positive), len(unlabelled))
    column = np.cumsum(used) - 1
    keep = used[pf]
    po, pf = po[keep], column[pf[keep]]
    keep = used[uf]
    uo, uf = uo[keep], column[uf[keep]]
    x = np.minimum(ratio[used], 4.0)
    k, n_p, n_u = len(x), len(positive), len(unlabelled)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)

    def logits(owner: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(owner, weights=(w * x)[cols], minlength=n) + b

    def gradient(owner: np.ndarray, cols: np.ndarray, by_row: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, weights=by_row[owner], minlength=k) * x, by_row.sum())

    for step in range(1, steps + 1):
        by_p, by_u = nnpu_gradient(logits(po, pf, n_p), logits(uo, uf, n_u), prior)
        g = gradient(po, pf, by_p) + gradient(uo, uf, by_u)
        g[:k] += l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:k], b - move[k]
    weights = np.zeros(size, dtype="float32")
    weights[used] = (w * x).astype("float32")
    return ToxicityModel(weights, float(b))


@F.pandas_udf(T.BinaryType())
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).tobytes() for t in texts], dtype="object")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          may_train: Column | None = None, max_positive: int = 10_000, max_unlabelled: int = 30_000) -> ToxicityModel:
    """Sample, featurise on the executors, fit on the driver.  ``may_train``: a condition on ``key`` for learning labels."""
    ok = F.col("id").isNotNull()
    if may_train is not None:
        ok = ok & may_train
    marks = (labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where(F.col("y").isNotNull()).where(ok)
             .groupBy("id").agg(F.max((F.col("y") == 1).cast("int")).alias("y")))
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).where(ok)
    n_pos, n_lab = marks.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    n_docs = texts.count()
    if not n_pos or n_docs <= n_pos:
        return ToxicityModel(np.zeros(1 << BITS, dtype="float32"), NEVER)
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share_p, share_u = min(1.0, max_positive / n_pos), min(1.0, max_unlabelled / n_docs)
    # the drawn ids are few and written first, so the planner sees that they can be broadcast and the texts stay where they are
    toxic = materialize(marks.where((F.col("y") == 1) & (draw < share_p)).select("id"), "toxic-ids")
    p = texts.where(draw < share_p).join(toxic, "id", "left_semi").select(F.lit(1).alias("p"), _features("t").alias("f"))
    u = texts.where(draw < share_u).select(F.lit(0).alias("p"), _features("t").alias("f"))
    sample = materialize(p.unionByName(u).distinct(), "toxicity-sample")  # texts with the same words are one: copies are no evidence
    sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}
    most = {1: 2 * max_positive, 0: 2 * max_unlabelled}
    if any(n > most[k] for k, n in sizes.items()):  # ids with many different texts: drawn again by the texts
        rate = F.when(F.col("p") == 1, max_positive / max(1, sizes.get(1, 0))).otherwise(max_unlabelled / max(1, sizes.get(0, 0)))
        sample = materialize(sample.where(F.pmod(F.xxhash64("f"), F.lit(1_000_003)) / F.lit(1_000_003.0) < rate), "toxicity-sample")
        sizes = {r["p"]: r["count"] for r in sample.groupBy("p").count().collect()}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for kind, part in f.groupby("p"):
                got, n = np.unique(np.frombuffer(b"".join(part["f"]), dtype="<u4"), return_counts=True)
                yield pd.DataFrame({"p": np.int32(kind), "feature": got.astype("int64"), "n": n})

    texts_with = {k: np.zeros(1 << BITS, dtype="int64") for k in (0, 1)}
    counted = sample.mapInPandas(count, "p int, feature bigint, n bigint").groupBy("p", "feature").agg(F.sum("n").alias("n"))
    for kind, part in counted.toPandas().groupby("p"):  # at most 2 ** BITS rows for each
        texts_with[kind][part["feature"].to_numpy()] = part["n"].to_numpy()
    used, _ = toxic_features(texts_with[1], texts_with[0], sizes.get(1, 0), sizes.get(0, 0))

    @F.pandas_udf(T.BinaryType())
    def only_used(rows: pd.Series) -> pd.Series:
        sets = (np.frombuffer(x, dtype="<u4") for x in rows)
        return pd.Series([x[used[x]].tobytes() for x in sets], dtype="object")

    rows = sample.select("p", only_used("f").alias("f")).toPandas()  # the bounded sample, a few features each
    sides = [[np.frombuffer(x, dtype="<u4") for x in rows.loc[rows["p"] == kind, "f"]] for kind in (1, 0)]
    return fit_nnpu(*sides, prior=min(0.9, max(0.01, n_pos / n_lab)))


def scorer(spark: SparkSession, model: ToxicityModel):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return score


def held_out(key: Column) -> Column:
    """True where labels must not be learned; a null id is never learned from but not held out."""
    return F.coalesce(crc_remainder(key, HELD_OUT_MODULUS) == HELD_OUT_REMAINDER, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """The score column for ``docs``, of a model trained on them outside the held-out rows."""
    model = train(docs, labels, key, text, may_train=~held_out(F.col("id")))
    return scorer(docs.sparkSession, model)(F.col(text))
