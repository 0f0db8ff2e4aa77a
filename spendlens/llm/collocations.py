"""Phrase collocation mining by SON partitioning.

A phrase is 2 to ``max_words`` contiguous words of a piece of text; f counts
all its occurrences, overlaps included, per language.  ``mine_phrases`` finds
every phrase with f >= ``support``, exactly; ``collocations`` scores them and
drops those that a longer one explains.

Method (Savasere, Omiecinski and Navathe's partitioning, level by level):

1. ``encode_shards`` cuts the corpus into shards of about ``shard_bytes`` of
   text, one row for each language in it, as arrays of word numbers, and writes
   them once.  All further passes read these.
2. Each shard is mined completely at the proportionally lowered local support
   t = max(1, ceil(support * words of the shard / words of the language)).
3. The locally frequent phrases are united by hash.  One that a shard did not
   report has at most t - 1 occurrences there, so f is at most the sum of the
   reported counts plus t - 1 for each silent shard; phrases whose bound stays
   below the support are not candidates.  (Where t is 1, from ``support`` equal
   shards on, every occurring phrase is locally frequent and the bound is f.)
   A shard sends 40 bits of the hash and its surplus over t - 1 as a part of what
   the language's surpluses must reach; phrases that share the bits add up, which
   can only make candidates.
4. The shards count the candidates, as text, and the sums are the exact f.

Levels: words first, then pairs of frequent words, then the longer phrases all of
whose pairs are frequent; a part of a phrase is at least as frequent as it.

Scale: a shard is one Python value of bounded size.  What passes between the
levels is a bitmap of ``2**filter_bits`` bits (collected and broadcast, its size
does not depend on the data) of the hashes of what is frequent; a bit set by
another phrase costs a needless count, never a result, since the counts that
decide are of the texts.  Shuffles are preceded by counting within the shard and
by Spark's partial aggregate, so a phrase or a language with any share of the
rows is a row a task; the ranking cuts to ``top`` within salts before a language meets.

Defined cases: null text is empty; null ``lang`` counts as ``und``; a text longer
than a shard makes a longer shard; repeated rows count each time; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import bitmap_of, marked, materialize
from spendlens.operators.attach import attach

SUPPORT = 30
MAX_WORDS = 4
TOP = 2000
SHARD_BYTES = 4 << 20
FILTER_BITS = 26
SALTS = 64
#: A longer phrase with this share (in percent) of a phrase's occurrences explains it.
EXPLAINED = 80

#: A-Z become a-z, a tab a space, and what ends a piece a full stop (no word holds one).
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz .........")
_BREAK = b"."
_UNITED = np.uint64((1 << 40) - 1)


def words_of(text: str) -> list[bytes]:
    """The words of a text, with ``.`` where a piece ends."""
    return text.encode("utf-8").translate(_FOLD).replace(b".", b" . ").split()


def encode_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, n_words, vocab, ids)``: the words of a shard's language, space-joined, and its texts as int32 places in them (0: a break)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for name, words in held.items():
                codes, vocab = pd.factorize(np.array([_BREAK, *words], dtype=object))
                n = int(np.count_nonzero(codes))
                if n:
                    yield pa.RecordBatch.from_pydict({"lang": [name], "n_words": [n], "vocab": [b" ".join(vocab[1:])], "ids": [codes.astype("<i4").tobytes()]})
            held.clear()

        for batch in batches:
            for name, value in zip(*[batch.column(c).to_pylist() for c in ("lang", "text")], strict=True):
                words = held.setdefault(name, [])
                words += words_of(value)
                words.append(_BREAK)
                size += len(value)
                if size >= shard_bytes:
                    yield from rows()
                    size = 0
        yield from rows()

    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(encode, "lang string, n_words long, vocab binary, ids binary")


class Shard:
    """One shard of one language: its words, their hashes and where phrases can start."""

    def __init__(self, lang: str, vocab: bytes, ids: bytes):
        self.words = [_BREAK, *vocab.split(b" ")]
        self.ids = np.frombuffer(ids, dtype="<i4").astype(np.int64)
        seed = xxhash.xxh32_intdigest(lang.encode("utf-8"))
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], dtype=np.uint64)

    def alive_words(self, bitmap: np.ndarray) -> np.ndarray:
        """For each position: a word that the bitmap has (a break is none)."""
        known = marked(bitmap, self.hashes)
        known[0] = False
        return known[self.ids]

    def phrases(self, n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different phrases of ``n`` words at ``starts``: a start of each, its hash and its count."""
        key = self.ids[starts]
        for k in range(1, n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]  # so that the next product fits
            key = key * len(self.words) + self.ids[starts + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        at = starts[first]
        return at, self.hash_at(at, n), count

    def hash_at(self, at: np.ndarray, n: int) -> np.ndarray:
        h = self.hashes[self.ids[at]]
        for k in range(1, n):
            h = mixed(h) + self.hashes[self.ids[at + k]]
        return mixed(h)

    def text(self, at: int, n: int) -> str:
        return b" ".join([self.words[i] for i in self.ids[at:at + n]]).decode("utf-8")


def shards_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, Shard]]:
    """Language, local support, what the reported surpluses must sum to, and the shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            lang, local, need, vocab, ids = (batch.column(c)[i].as_py() for c in ("lang", "local", "need", "vocab", "ids"))
            yield lang, local, need, Shard(lang, vocab, ids)


def repeated(value: str, n: int) -> pa.Array:
    return pa.array([value], pa.string()).take(pa.array(np.zeros(n, dtype=np.int64)))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping arithmetic)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _alive(shard: Shard, words: np.ndarray, pairs: np.ndarray | None, n: int) -> np.ndarray:
    """Starts of ``n`` words in one piece, each frequent, and each pair frequent where the pairs are known."""
    live = shard.alive_words(words)
    last = len(live) - n + 1
    if last < 1:
        return np.zeros(0, dtype=np.int64)
    if pairs is None:
        ok = live[:last].copy()
        for k in range(1, n):
            ok &= live[k:last + k]
        return np.flatnonzero(ok)
    both = np.flatnonzero(live[:-1] & live[1:])
    pair = np.zeros(len(live), dtype=bool)
    pair[both[marked(pairs, shard.hash_at(both, 2))]] = True
    ok = pair[:last].copy()
    for k in range(1, n - 1):
        ok &= pair[k:last + k]
    return np.flatnonzero(ok)


def _level(shards: DataFrame, lengths: range, words: bytes, pairs: bytes | None, support: int, bits: int) -> DataFrame:
    """``(lang, n, phrase, f)`` of the frequent phrases of these lengths: steps 2 to 4."""
    context = shards.sparkSession.sparkContext
    known = context.broadcast((words, pairs))

    def starts(shard: Shard, n: int) -> np.ndarray:
        w, p = known.value
        return _alive(shard, np.frombuffer(w, np.uint8), None if p is None else np.frombuffer(p, np.uint8), n)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, local, need, shard in shards_in(batches):
            for n in lengths:
                _, h, count = shard.phrases(n, starts(shard, n))
                frequent = count >= local
                yield pa.RecordBatch.from_pydict({"h": (h[frequent] & _UNITED).view(np.int64), "part": (count[frequent] - (local - 1)) / need})

    united = shards.mapInArrow(mine, "h long, part double").groupBy("h").agg(F.sum("part").alias("part"))
    candidates = bitmap_of(united.where(F.col("part") >= 1 - 1e-6).select("h"), bits)
    wanted = context.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.frombuffer(wanted.value, np.uint8)
        for lang, _, _, shard in shards_in(batches):
            for n in lengths:
                at, h, c = shard.phrases(n, starts(shard, n))
                hit = marked(chosen, h)
                texts = pa.array([shard.text(a, n) for a in at[hit].tolist()], pa.string())
                yield pa.RecordBatch.from_pydict({"lang": repeated(lang, len(texts)), "n": np.full(len(texts), n, np.int32), "phrase": texts, "f": c[hit]})

    counted = shards.mapInArrow(count, "lang string, n int, phrase string, f long")
    return counted.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= support)


def phrase_hashes(phrases: DataFrame) -> DataFrame:
    """The hashes of ``(lang, phrase)``, as the shards compute them."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(*[batch.column(c).to_pylist() for c in ("lang", "phrase")], strict=True):
                words = phrase.encode("utf-8").split(b" ")
                shard = Shard(lang, b" ".join(words), np.arange(1, len(words) + 1, dtype="<i4").tobytes())
                at = np.zeros(1, dtype=np.int64)
                out.append(int((shard.hash_at(at, len(words)) if len(words) > 1 else shard.hashes[1:2]).view(np.int64)[0]))
            yield pa.RecordBatch.from_pydict({"h": pa.array(out, pa.int64())})

    return phrases.select("lang", "phrase").mapInArrow(hashes, "h long")


def mine_phrases(docs: DataFrame, support: int = SUPPORT, max_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES,
                 filter_bits: int = FILTER_BITS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The frequent phrases ``(lang, n, phrase, f)``, single words (n = 1) included, and ``(lang, n_words)``."""
    if support < 1 or max_words < 2:
        raise ValueError("support must be at least 1 and max_words at least 2")
    shards = materialize(encode_shards(docs, shard_bytes, text, lang), "phrase-shards")
    words_by_lang = materialize(shards.groupBy("lang").agg(F.sum("n_words").alias("n_words")), "phrase-words-by-lang")
    share = F.ceil(F.lit(support).cast("decimal(18,0)") * F.col("n_words") / F.col("all_words")).cast("long")
    shards = (attach(shards, words_by_lang.withColumnRenamed("n_words", "all_words"), ["lang"], spread="ids")
              .withColumn("local", F.greatest(F.lit(1).cast("long"), share)).drop("all_words"))
    slack = shards.groupBy("lang").agg(F.sum(F.col("local") - 1).alias("slack"))  # below the support, as local - 1 is below the shard's share of it
    needed = materialize(slack.select("lang", (F.lit(support).cast("long") - F.col("slack")).alias("need")), "phrase-slack")
    shards = attach(shards, needed, ["lang"], spread="ids")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, shard in shards_in(batches):
            counts = np.bincount(shard.ids, minlength=len(shard.words))
            texts = pa.array(shard.words[1:], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict({"lang": repeated(name, len(texts)), "phrase": texts, "f": counts[1:]})

    single = shards.mapInArrow(words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    levels = [materialize(single.where(F.col("f") >= support).select("lang", F.lit(1).alias("n"), "phrase", "f"), "phrase-words")]
    frequent_words = bitmap_of(phrase_hashes(levels[0]), filter_bits)
    levels.append(materialize(_level(shards, range(2, 3), frequent_words, None, support, filter_bits), "phrase-pairs"))
    if max_words > 2:
        frequent_pairs = bitmap_of(phrase_hashes(levels[1]), filter_bits)
        longer = _level(shards, range(3, max_words + 1), frequent_words, frequent_pairs, support, filter_bits)
        levels.append(materialize(longer, "phrase-longer"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, words_by_lang


def _part(first: Column, last: Column) -> Column:
    """Words ``first`` to ``last`` (from 1) of the phrase, space-joined."""
    return F.array_join(F.slice("ws", first, last - first + 1), " ")


def score_cuts(found: DataFrame) -> DataFrame:
    """``(lang, n, phrase, a, l, r, score)`` of the phrases of two words or more: the cut with the lowest score (ties: the first).

    Every part of a frequent phrase is frequent, so the joins lose nothing.
    """
    of = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    whole = found.where("n > 1").withColumnRenamed("f", "a").withColumn("ws", F.split("phrase", " "))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    cuts = cuts.select("lang", "n", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("n")).alias("right"))
    cuts = cuts.join(of.withColumnsRenamed({"part": "left", "of_part": "l"}), ["lang", "left"])
    cuts = cuts.join(of.withColumnsRenamed({"part": "right", "of_part": "r"}), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(28, 0)) * 2000000) div (CAST(l AS DECIMAL(28, 0)) + r)").cast("long")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "n", "phrase", "a").agg(best).select("lang", "n", "phrase", "a", "best.l", "best.r", "best.score")


def explained(found: DataFrame, percent: int = EXPLAINED) -> DataFrame:
    """``(lang, phrase)`` of those that stand contiguously in a longer one with ``percent`` of their occurrences."""
    longer = found.where("n > 2").withColumn("ws", F.split("phrase", " "))
    size = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n") - 1)))
    parts = size.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)))
    most = (parts.select("lang", _part(F.col("i"), F.col("i") + F.col("m") - 1).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("most")))
    both = most.join(found.where("n > 1"), ["lang", "phrase"])
    return both.where(F.col("most").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent).select("lang", "phrase")


def top_ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` by score, then a, then phrase, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    few = some.where(F.col("rank") <= top).drop("salt", "rank")  # at most top * SALTS a language
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``; options as for ``mine_phrases``."""
    found, words_by_lang = mine_phrases(docs, **options)
    kept = score_cuts(found).join(explained(found), ["lang", "phrase"], "left_anti").drop("n")
    ranked = top_ranked(kept, top).join(words_by_lang.withColumnRenamed("n_words", "n"), "lang")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
