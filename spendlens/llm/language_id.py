"""Language identification with string kernels.

A text is folded (lower case, every run of other code points than letters and
marks one space, one space at both ends).  Its blended spectrum G is the set of
its code-point n-grams of 1 to 3.  The presence kernel of two texts is
k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).

Nystroem approximation: with landmark texts L and W = k(L, L), a text becomes
phi(x) = k(x, L) W^(-1/2).  For each language a kernel ridge regression of +1
(that language) against -1 (the rest) is solved on phi; the weights and W^(-1/2)
make one matrix, so that a block of texts is scored by two matrix products: its
0/1 n-gram matrix times the landmarks', and the kernel values times the weights.

Fitting takes a bounded sample: of each of the ``max_languages`` languages with
most different texts about ``per_language`` different texts, by a hash of the
text (the share comes from a mergeable estimate of their number, so copies
neither fill the sample nor meet in one place), and ``landmarks`` of them.  The
normal equations are summed on the executors; the driver gets matrices of
landmarks x landmarks.  Every text is scored whole.

Defined cases: a null text and one without a letter are ``und`` with score 0,
and so is every text if nothing can be learned; texts without a language are
not learned from; a text of several languages counts for each; ties go to the
language first in order; long texts are read in overlapping parts; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import crc_remainder, materialize

UNKNOWN = "und"
LONGEST = 3
PER_LANGUAGE = 1500
MAX_LANGUAGES = 200
LANDMARKS = 96
RIDGE = 1e-2
PART = 1 << 20  # code points of a long text read at a time
CELLS = 1 << 22  # of a block's 0/1 matrix
#: a landmark has so many code points, if there are such texts
LANDMARK_SIZE = (300, 3000)


def folded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def spectrum(text: str, longest: int = LONGEST) -> np.ndarray:
    """The different n-grams of a folded text, sorted, as numbers of 21 bits a code point (none is 0)."""
    found = []
    for start in range(0, max(1, len(text)), PART):
        points = np.frombuffer(text[start:start + PART + longest - 1].encode("utf-32-le"), dtype="<u4").astype(np.int64)
        grams, code = [points], points
        for n in range(2, longest + 1):
            code = (code[:-1] << 21) | points[n - 1:]
            grams.append(code)
        found.append(np.unique(np.concatenate(grams)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


@dataclass
class Landmarks:
    """The landmarks' n-grams: sorted vocabulary, 0/1 matrix (n-gram x landmark) and the sizes' roots."""

    vocabulary: np.ndarray
    presence: np.ndarray
    roots: np.ndarray

    @classmethod
    def of(cls, spectra: list[np.ndarray]) -> Landmarks:
        vocabulary = np.unique(np.concatenate(spectra))
        presence = np.zeros((len(vocabulary), len(spectra)), dtype=np.float32)
        for j, grams in enumerate(spectra):
            presence[np.searchsorted(vocabulary, grams), j] = 1
        return cls(vocabulary, presence, np.sqrt([len(g) for g in spectra]))

    def kernel(self, spectra: list[np.ndarray]) -> np.ndarray:
        """k(x, L) for a list of spectra, block by block."""
        out = np.empty((len(spectra), len(self.roots)))
        rows = max(1, CELLS // len(self.vocabulary))
        for start in range(0, len(spectra), rows):
            block = spectra[start:start + rows]
            cells = np.zeros((len(block), len(self.vocabulary)), dtype=np.float32)
            for i, grams in enumerate(block):
                at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
                cells[i, at[self.vocabulary[at] == grams]] = 1
            out[start:start + rows] = (cells @ self.presence) / (np.sqrt([len(g) for g in block])[:, None] * self.roots)
        return out


def inverse_root(w: np.ndarray) -> np.ndarray:
    """W^(-1/2) on the part of the space that W spans."""
    values, vectors = np.linalg.eigh(w)
    kept = values > 1e-8 * max(values[-1], 1e-300)
    return (vectors[:, kept] / np.sqrt(values[kept])) @ vectors[:, kept].T


def solve_ridge(gram: np.ndarray, target: np.ndarray, ridge: float) -> np.ndarray:
    """Weights from phi'phi and phi'y (both weighted means); the last row is the constant and not penalised."""
    penalty = ridge * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(gram + penalty, target)


@dataclass
class Model:
    languages: list[str]
    landmarks: Landmarks | None = None
    weights: np.ndarray | None = None  # (landmarks + 1) x languages

    def margins(self, spectra: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.kernel(spectra) @ self.weights[:-1] + self.weights[-1]


def draw_sample(labelled: DataFrame, per_language: int, max_languages: int) -> tuple[DataFrame, list[str]]:
    """About ``per_language`` different folded texts ``(lang, h, x)`` of each language learned, and the languages."""
    hashed = labelled.withColumn("h", F.xxhash64("x"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    rates = [(r.lang, min(1.0, per_language / r.n)) for r in sizes]
    known = labelled.sparkSession.createDataFrame(rates, "lang string, rate double")  # at most max_languages rows
    place = F.pmod(F.xxhash64("h", F.lit(12)), F.lit(1 << 30)) / float(1 << 30)
    drawn = hashed.join(F.broadcast(known), "lang").where((F.col("rate") >= 1) | (place < F.col("rate")))
    return drawn.groupBy("lang", "h").agg(F.min("x").alias("x")), sorted(r.lang for r in sizes)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES,
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from the texts with a letter and a language."""
    labelled = (docs.where(F.col(lang).isNotNull() & has_letter(F.col(text)))
                .select(F.col(lang).cast("string").alias("lang"), folded(F.col(text)).alias("x")))
    drawn, languages = draw_sample(labelled, per_language, max_languages)
    if not languages:
        return Model([])
    sample = materialize(drawn.repartition(16, "h"), "language-sample")  # bounded by the two parameters
    marks = _pick_landmarks(sample, max(1, landmarks // len(languages)))
    root = inverse_root(marks.kernel(_spectra_of(marks)))
    gram, target = _normal_equations(sample, marks, root, languages)
    weights = solve_ridge(gram, target, ridge)
    return Model(languages, marks, np.vstack([root @ weights[:-1], weights[-1:]]))


def _pick_landmarks(sample: DataFrame, each: int) -> Landmarks:
    size = F.length("x")
    odd = ~size.between(*LANDMARK_SIZE)
    order = F.struct(odd.alias("odd"), F.when(odd, F.abs(size - LANDMARK_SIZE[0])).alias("far"), "h")
    # the first by order: sort_array of at most per_language small structs a language
    first = sample.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(order)), 1, each).alias("o")).select("lang", F.explode("o.h").alias("h"))
    chosen = sample.join(F.broadcast(first), ["lang", "h"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spectrum(x).tobytes() for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.binary())], ["lang", "h", "grams"])

    rows = chosen.select("lang", "h", "x").mapInArrow(grams, "lang string, h long, grams binary").collect()
    return Landmarks.of([np.frombuffer(r.grams, dtype=np.int64) for r in sorted(rows, key=lambda r: (r.lang, r.h))])


def _spectra_of(marks: Landmarks) -> list[np.ndarray]:
    return [marks.vocabulary[marks.presence[:, j] > 0] for j in range(len(marks.roots))]


def _normal_equations(sample: DataFrame, marks: Landmarks, root: np.ndarray, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class-balanced means of phi'phi and phi'y over the sample; one small row from each of its few partitions."""
    sent = sample.sparkSession.sparkContext.broadcast((marks, root, languages))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, root, languages = sent.value
        m, k = len(marks.roots) + 1, len(languages)
        gram, own, n = np.zeros((k, m, m)), np.zeros((k, m)), np.zeros(k)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist())
            phi = marks.kernel([spectrum(x) for x in batch.column("x").to_pylist()]) @ root
            phi = np.hstack([phi, np.ones((len(phi), 1))])
            for j, name in enumerate(languages):
                mine = phi[langs == name]
                gram[j] += mine.T @ mine
                own[j] += mine.sum(axis=0)
                n[j] += len(mine)
        for j in range(k):
            if n[j]:
                yield pa.RecordBatch.from_pydict({"j": pa.array([j], pa.int32()), "n": [float(n[j])],
                                                  "own": [own[j].tolist()], "gram": [gram[j].ravel().tolist()]})

    rows = sample.select("lang", "x").mapInArrow(partial, "j int, n double, own array<double>, gram array<double>")
    size = (len(marks.roots) + 1) ** 2
    total = rows.groupBy("j").agg(F.sum("n").alias("n"), *[_sum_arrays(c, s) for c, s in (("own", len(marks.roots) + 1), ("gram", size))])
    k, m = len(languages), len(marks.roots) + 1
    gram, mean = np.zeros((m, m)), np.zeros((k, m))
    for r in total.toLocalIterator():
        gram += np.array(r.gram).reshape(m, m) / (r.n * k)
        mean[r.j] = np.array(r.own) / (r.n * k)
    target = (2 * mean - mean.sum(axis=0)).T  # +1 for the language's own, -1 for the others'
    return gram, target


def _sum_arrays(column: str, size: int) -> Column:
    """Elementwise sum of the few arrays of a group."""
    zero = F.array_repeat(F.lit(0.0), size)
    return F.aggregate(F.collect_list(column), zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias(column)


def predictor(spark, model: Model):
    """A function of a text column to ``struct<lang_pred, score>``; the model is broadcast (bounded by the parameters)."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        label = np.full(len(texts), UNKNOWN, dtype=object)
        score = np.zeros(len(texts))
        known = np.flatnonzero(texts.notna()) if model.languages else np.zeros(0, dtype=int)
        values = texts.to_numpy(dtype=object)
        rows = 256
        for start in range(0, len(known), rows):
            at = known[start:start + rows]
            margins = model.margins([spectrum(values[i]) for i in at])
            best = margins.argmax(axis=1)
            label[at] = np.array(model.languages, dtype=object)[best]
            score[at] = np.clip((margins[np.arange(len(at)), best] + 1) / 2, 0, 1)
        return pd.DataFrame({"lang_pred": label, "score": np.round(score, 6)})

    def of(text: Column) -> Column:
        return predict(F.when(has_letter(text), folded(text)))

    return of


def held_out(key: Column) -> Column:
    """Rows that are not learned from (contract: crc32 of the id, remainder 1 of 3); a null id is in neither part."""
    return F.coalesce(crc_remainder(key, 3) == 1, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """``(key, held_out, lang_pred, score)`` of every row; learned from the rows with an id that are not held out."""
    model = fit(docs.where(crc_remainder(F.col(key), 3) != 1), text, lang, **options)
    said = predictor(docs.sparkSession, model)(F.col(text))
    out = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), said.alias("_said"))
    return out.select(key, "held_out", "_said.lang_pred", "_said.score")
