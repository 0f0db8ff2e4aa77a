"""URL filter: ordered host/path rules, then a character language-model ratio.

Two variable-order Markov models (order 0 to 3, Witten-Bell smoothed: each
order falls back on the next shorter context as far as its context has been
seen with few characters) are trained from the URLs that the rules accept and
reject.  A URL without a rule is judged by the difference of the two
log-likelihoods divided by its length, against a threshold calibrated on URLs
left out of a first training (every ``HOLD_OUT``-th by hash); then their counts are added.

Scale: characters are folded to ``SYMBOLS`` classes, so all n-gram counts of a
model are one table of at most ``SYMBOLS ** ORDER`` cells (2.6 million), counted
on the executors with partial aggregation and sent to them as one array: its
size does not grow with the data.  All URLs count; those that differ only in the case of
a-z, in digits or in other bytes (all that is not ASCII, and marks other than ``MARKS``) score alike.

Rules: a rule is a host and a path.  It fits the host itself and its subdomains
if the URL's path starts with the rule's path; of several the longest wins.
Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and no rule; the model scores a null URL like an empty text; equally long
rules: the first of the list wins; without accepted or without rejected
training URLs everything that no rule rejects is allowed; repeated rows count
each time; other columns are kept, but for those with the names that ``judge_urls`` adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import unused

# classes of characters: other bytes, a-z, digits as one, marks, and the edge
MARKS = "/.-_?=&:#%~+@"
OTHER, DIGIT, EDGE = 0, 27, 28 + len(MARKS)
SYMBOLS = EDGE + 1
ORDER = 4  # characters of an n-gram, the last one included
HOLD_OUT = 5
BINS, REACH = 4000, 4.0  # the histogram of scores for the threshold

_FOLD = np.zeros(256, dtype="int64")
for _c in range(26):
    _FOLD[97 + _c] = _FOLD[65 + _c] = 1 + _c
_FOLD[48:58] = DIGIT
for _k, _c in enumerate(MARKS):
    _FOLD[ord(_c)] = 28 + _k


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The index in ``rules`` of the longest rule that fits, else null."""
    best = F.lit(None).cast("int")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        best = F.when(fits, F.lit(i)).otherwise(best)
    return best


def _grams(urls: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all n-grams (one per character and one for the end), and how many each URL has."""
    data = [(u or "").encode("utf-8", "replace") for u in urls]
    pad, end = [EDGE] * (ORDER - 1), [EDGE]
    if not data:
        return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
    lengths = np.array([len(d) + 1 for d in data], dtype="int64")
    codes = np.concatenate([x for d in data for x in (pad, _FOLD[np.frombuffer(d, dtype="uint8")], end)]).astype("int64")
    grams = np.zeros(len(codes) - ORDER + 1, dtype="int64")
    for k in range(ORDER):
        grams = grams * SYMBOLS + codes[k:len(codes) - ORDER + 1 + k]
    return grams[_starts(lengths)], lengths  # without those that run into the next URL


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Positions of the n-grams' first characters in the padded concatenation."""
    base = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(base, lengths) + within


def count_grams(urls: DataFrame, url: str, group: str) -> DataFrame:
    """``group``, ``gram`` and ``n``: n-gram counts over all rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g, part in f.groupby("g"):
                grams, n = np.unique(_grams(part["u"].tolist())[0], return_counts=True)
                yield pd.DataFrame({"g": np.int32(g), "gram": grams, "n": n})

    rows = urls.select(F.col(group).cast("int").alias("g"), F.col(url).alias("u")).where("g IS NOT NULL")
    return rows.mapInPandas(count, "g int, gram bigint, n bigint").groupBy("g", "gram").agg(F.sum("n").alias("n"))


def log_probabilities(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural-log probability of each n-gram's last character by Witten-Bell back-off, as float32[SYMBOLS ** ORDER]."""
    counts = np.zeros(SYMBOLS ** ORDER, dtype="float64")
    counts[grams] = n
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, SYMBOLS ** (order - 1), SYMBOLS).sum(axis=0) if order < ORDER else counts.reshape(-1, SYMBOLS)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS if order > 1 else 1, 1))
        seen = np.maximum(total + kinds, 1)
        p = np.where(total > 0, (c + kinds * lower) / seen, lower)
    return np.log(p).astype("float32").reshape(-1)


@dataclass
class UrlModel:
    ratio: np.ndarray | None  # log-likelihood difference by n-gram; None: nothing to compare
    threshold: float

    def score(self, urls: list[str | None]) -> np.ndarray:
        if self.ratio is None or not len(urls):
            return np.zeros(len(urls))
        grams, lengths = _grams(urls)
        return np.add.reduceat(self.ratio[grams].astype("float64"), np.cumsum(lengths) - lengths) / lengths


def scorer(spark, model: UrlModel):
    """A column function: the length-normalised difference (the array is broadcast; SYMBOLS ** ORDER floats)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(urls: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(urls.tolist()), dtype="float64")

    return score


def train(labelled: DataFrame, url: str, accepted: str) -> UrlModel:
    """Fit both models on four fifths (by hash) of the rows, calibrate the threshold on the rest, and refit on all.

    The threshold is the score with the best balanced accuracy on the rows left
    out, the lowest of equal ones (accept when in doubt).
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(url).alias("u"), F.col(accepted).cast("int").alias("a")).where("a IS NOT NULL")
    held = F.pmod(F.xxhash64(F.coalesce("u", F.lit(""))), F.lit(HOLD_OUT)) == 0
    first, others = (count_grams(rows.where(part), "u", "a").toPandas() for part in (~held, held))  # at most 2 * SYMBOLS ** ORDER rows each
    counts = pd.concat([first, others]).groupby(["g", "gram"], as_index=False)["n"].sum()
    if counts["g"].nunique() < 2:
        return UrlModel(None, 0.0)

    def ratio(counts: pd.DataFrame) -> np.ndarray:
        logs = [log_probabilities(*(counts.loc[counts["g"] == g, c].to_numpy() for c in ("gram", "n"))) for g in (0, 1)]
        return logs[1] - logs[0]

    model = UrlModel(ratio(counts), 0.0)
    if first["g"].nunique() < 2:
        return model
    score = scorer(spark, UrlModel(ratio(first), 0.0))
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((score("u") + REACH) / (2 * REACH) * BINS))).cast("int")
    seen = rows.where(held).select("a", bin_.alias("bin")).groupBy("a", "bin").count().collect()  # at most 2 * BINS rows
    table = np.zeros((2, BINS))
    for a, b, n in seen:
        table[a, b] = n
    if table.sum(axis=1).min() > 0:
        kept = table[:, ::-1].cumsum(axis=1)[:, ::-1] / table.sum(axis=1, keepdims=True)  # share at or above each bin
        gain = kept[1] - kept[0]
        model.threshold = float(np.argmax(gain) / BINS * 2 * REACH - REACH)
    return model


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict``, ``llr`` (the score) to the rows."""
    i = unused(pages, "_rule")
    u = F.col(url)
    rows = pages.withColumns({"host": url_host(u), "path": url_path(u)})
    rows = rows.withColumn(i, match_rule(F.col("host"), F.col("path"), rules))
    names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    rows = rows.withColumns({"rule": F.get(names, F.col(i)), "verdict": F.get(verdicts, F.col(i))})
    label = unused(rows, "_label")
    model = train(rows.withColumn(label, F.when(F.col(i).isNotNull(), (F.col("verdict") == "allow").cast("int"))), url, label)
    llr = scorer(pages.sparkSession, model)(u)
    own = F.when(F.col("llr") >= model.threshold, "allow").otherwise("block")
    return (rows.withColumn("llr", llr).withColumn("verdict", F.coalesce("verdict", own)).drop(i))
