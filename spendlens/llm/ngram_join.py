"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two texts are linked if the Jaccard similarity of their sets of five-word
shingles is at least 0.8.

1. Exact copies become one text (grouped by MD5 of the text, partial
   aggregation), with its MinHash signature of ``BANDS * ROWS`` values.
2. Texts that agree in a whole band of values are candidates: each is linked to
   the least text of its bucket, and connected components of these star edges
   are the candidate clusters.  No list of a bucket's pairs is ever written.
3. In a cluster every two texts are compared.  A cluster is cut into blocks of
   about ``BLOCK_SHINGLES`` shingles, a task gets two blocks; a text goes to as many
   tasks as its cluster has blocks.  Only the texts of clusters are shuffled: a bitmap of
   ``2**FILTER_BITS`` bits of their hashes, of fixed size, is broadcast, and what it
   lets through by chance goes in the join.  MinHash values are compared
   ``STEP`` at a time; with a uniform prior the posterior of reaching the
   threshold after ``m`` of ``n`` agreements is ``P(Binomial(n + 1, t) <= m)``, and
   pairs for which it falls below ``TOLERANCE`` are dropped.
4. The rest is verified exactly on the shingle sets (64-bit shingle ids).  A
   task returns how many links each text has and a spanning forest of them, so
   what is written grows with the texts, not with the pairs.
5. Connected components of the links are the classes.

Recall: a pair at exactly 0.8 shares no band with probability 5e-6, and is
pruned with probability ``TOLERANCE`` per step; above 0.8 both fall fast.

Words: A-Z lower-cased, ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one
shingle.

Defined cases: texts without words (null too) have no links, are no copies of
each other, and each is a class of its own; repeated rows and copies are one
text and share class and links; a class has the least document id of its
members as its id (null if all are null); an empty table gives an empty result;
other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import bitmap_of, marked, materialize, unused

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 40
BLOCK_SHINGLES = 1 << 19  # of the texts of a block, about: 4 MB of shingle ids
FILTER_BITS = 26
TILE = 1024  # texts of a block that are compared at once with as many of another: what pairs need of a task's memory
SIGNED = 20_000  # texts whose signature a worker remembers
STEP, STEPS = 16, 6
TOLERANCE = 1e-5
WORD_CACHE = 300_000

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, ROWS * BANDS, dtype="uint64") * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, ROWS * BANDS, dtype="uint64")


class _WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return code


_CODES = _WordCodes()


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit ids of a text's distinct shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype="uint64")
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype="uint64", count=len(words))
    size = min(SHINGLE, len(codes))
    n = len(codes) - size + 1
    ids = np.full(n, size, dtype="uint64")
    for k in range(size):
        ids = (ids ^ codes[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        ids ^= ids >> np.uint64(29)
    return np.unique(ids)


def signature(ids: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set."""
    best = np.full(len(_A), 0xFFFFFFFF, dtype="uint32")
    for at in range(0, len(ids), 2048):
        part = ids[at:at + 2048]
        best = np.minimum(best, ((_A[:, None] * part[None, :] + _B[:, None]) >> np.uint64(32)).min(axis=1).astype("uint32"))
    return best


def least_agreements(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each step: the least number of agreements with which a pair stays."""
    need = []
    for step in range(1, STEPS + 1):
        n, total, m = STEP * step, 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        need.append(m)
    return need


def _linked(a: list[int], b: list[int], sigs: np.ndarray, sets: list[np.ndarray], need: list[int], limit: Fraction) -> np.ndarray:
    """Pairs (row in a, row in b) of positions that are linked."""
    left, right = sigs[a], sigs[b]
    x, y = None, None
    agree = np.zeros((len(a), len(b)), dtype="int16")
    for step, least in enumerate(need):
        part = slice(step * STEP, (step + 1) * STEP)
        if x is None:
            for k in range(part.start, part.stop):
                agree += left[:, k][:, None] == right[:, k][None, :]
            x, y = np.nonzero(agree >= least)
            n = agree[x, y].astype("int64")
        else:
            for k in range(part.start, part.stop):
                n += left[x, k] == right[y, k]
            stay = n >= least
            x, y, n = x[stay], y[stay], n[stay]
    if not len(x):
        return np.zeros((0, 2), dtype="int64")
    if len(x) < 2 * (len(a) + len(b)):
        shared = np.array([len(np.intersect1d(sets[a[i]], sets[b[j]], assume_unique=True)) for i, j in zip(x, y, strict=True)])
    else:
        exact = "float32" if max(len(sets[b[j]]) for j in np.unique(y)) < 1 << 24 else "float64"  # counts are whole numbers
        both = np.zeros((len(a), len(b)), dtype=exact)
        rows_a, rows_b = np.unique(x), np.unique(y)
        universe = np.unique(np.concatenate([sets[b[j]] for j in rows_b]))
        for at in range(0, len(universe), 4096):
            part = universe[at:at + 4096]

            def table(members: list[int], rows: np.ndarray, part: np.ndarray = part) -> np.ndarray:
                t = np.zeros((len(members), len(part)), dtype=exact)
                for r in rows:
                    s = sets[members[r]]
                    s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                    k = np.searchsorted(part, s)
                    t[r, k[part[k] == s]] = 1
                return t

            both += table(a, rows_a) @ table(b, rows_b).T
        shared = both[x, y].astype("int64")
    sizes = np.array([len(s) for s in sets], dtype="int64")
    total = sizes[np.array(a)[x]] + sizes[np.array(b)[y]] - shared
    ok = shared * limit.denominator >= total * limit.numerator
    return np.stack([x[ok], y[ok]], axis=1)


def _block_links(a: np.ndarray, b: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], need: list[int], limit: Fraction,
                 tile: int = TILE) -> Iterator[np.ndarray]:
    """Linked pairs of positions, those of two tiles at a time; each pair once, and of a block with itself those in order."""
    same = len(a) == len(b) and bool((a == b).all())
    for at in range(0, len(a), tile):
        for bt in range(at if same else 0, len(b), tile):
            left, right = a[at:at + tile], b[bt:bt + tile]
            links = _linked(left.tolist(), right.tolist(), sigs, sets, need, limit)
            links = np.stack([left[links[:, 0]], right[links[:, 1]]], axis=1)
            yield links[links[:, 0] < links[:, 1]] if same and at == bt else links


def connected_components(edges: DataFrame, name: str = "component") -> DataFrame:
    """``node`` and ``label`` (one node of its component) for the ends of ``a``-``b`` edges.

    Each round maps a node to the node with the least random priority within
    two steps and contracts the graph, which takes about log(nodes) rounds.
    """
    both = materialize(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    labels = None
    rounds = 0
    while True:
        rounds += 1
        arcs = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(rounds)).alias("h"), c.alias("v"))  # noqa: B023, E731
        # written: a join of two plain shuffles can be split where a node has very many arcs
        one = materialize(arcs.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m")).select("a", F.least("m", rank(F.col("a"))).alias("m")), f"{name}-one")
        two = (arcs.join(one.select(F.col("a").alias("b"), "m"), "b").groupBy("a").agg(F.min("m").alias("m2"))
               .join(one, "a").select(F.col("a").alias("node"), F.least("m", "m2")["v"].alias("to")))
        step = materialize(two, f"{name}-step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        to = lambda end: step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_"))  # noqa: B023, E731
        both = materialize(both.join(to("a"), "a").join(to("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
                           .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
        if both.isEmpty():
            return materialize(labels, f"{name}-labels")


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per text with words: ``h``, ``uid``, least id, number of copies, signature, ``size`` (shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[bytes, int]] = {}  # copies of a text are often near each other
        for batch in batches:
            hashes, out = batch.column("h").to_pylist(), []
            for h, t in zip(hashes, batch.column("t").to_pylist(), strict=True):
                if h not in known:
                    if len(known) >= SIGNED:
                        known.clear()
                    ids = shingles(t)
                    known[h] = signature(ids).astype("<u4").tobytes(), len(ids)
                out.append(known[h])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("id"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64())],
                                             ["h", "id", "sig", "size"])

    rows = docs.where(_has_words(F.col(text))).select(_digest(F.col(text)).alias("h"), F.col(key).cast("bigint").cast("string").alias("id"), F.col(text).alias("t"))
    signed = rows.mapInArrow(sign, "h binary, id string, sig binary, size bigint")
    texts = signed.groupBy("h").agg(F.min(F.col("id").cast("bigint")).alias("first_id"), F.count(F.lit(1)).alias("n_copies"), F.min("sig").alias("sig"), F.max("size").alias("size"))
    return materialize(texts.withColumn("uid", F.monotonically_increasing_id()), "texts")


def among(spark: SparkSession, hashes: DataFrame):
    """A condition on a long column: it may be one of ``h``; other values pass with the share of the bits that are set."""
    sent = spark.sparkContext.broadcast(bitmap_of(hashes, FILTER_BITS))

    @F.pandas_udf("boolean")
    def known(values: pd.Series) -> pd.Series:
        return pd.Series(marked(np.frombuffer(sent.value, np.uint8), values.to_numpy(dtype=np.int64).view(np.uint64)))

    return known


def candidate_clusters(texts: DataFrame) -> DataFrame:
    """``node`` (uid) and ``label`` of the texts that share a band with another."""
    size = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * size + 1, F.lit(size))))
    bands = texts.select("uid", F.explode(keys).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("uid").alias("first"), F.max("uid").alias("last")).where("first <> last")
    edges = bands.join(buckets.select("key", "first"), "key").select(F.col("first").alias("a"), F.col("uid").alias("b"))
    return connected_components(edges, "candidates")


def verified_links(docs: DataFrame, text: str, texts: DataFrame, clusters: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(a, null, n)``: the text ``a`` has ``n`` links in a pair of blocks; ``(a, b, null)``: a link of the forest."""
    own = clusters.join(texts.select(F.col("uid").alias("node"), "h", "sig", "size"), "node")
    own = materialize(own, "cluster-members")
    sizes = own.groupBy("label").agg(F.ceil(F.sum("size") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = own.drop("size").join(sizes, "label")
    n_small = (own.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) // BLOCK_SHINGLES + 1
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    candidate = among(docs.sparkSession, members.select(F.xxhash64("h").alias("h")))
    # only texts of clusters, grouped before the join: of many copies a map task sends one
    whole = (docs.where(_has_words(F.col(text))).select(_digest(F.col(text)).alias("h"), F.col(text).alias("t"))
             .where(candidate(F.xxhash64("h"))).groupBy("h").agg(F.min("t").alias("t")))
    rows = materialize(members.withColumn("own", own).join(whole, "h").drop("h"), "members")
    rows = rows.withColumn("other", other).select(
        "label", "node", "own", "sig", "t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(n_small))).otherwise(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other"))).alias("task"))
    need, limit = least_agreements(threshold), Fraction(str(threshold))

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b, out_n = [], [], []
        for (_, i, j), part in frame.groupby(["label", "i", "j"], sort=False):
            nodes = part["node"].to_numpy()
            own = part["own"].to_numpy()
            sigs = np.frombuffer(b"".join(part["sig"]), dtype="<u4").reshape(len(part), -1)
            sets = [shingles(t) for t in part["t"]]
            a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
            count = np.zeros(len(part), dtype="int64")
            root = list(range(len(part)))

            def find(v: int, root: list[int] = root) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for links in _block_links(a, b, sigs, sets, need, limit):
                count += np.bincount(links.reshape(-1), minlength=len(part))
                while len(links):  # most links of a tile are within a tree already
                    tops = np.array([find(v) for v in range(len(part))])
                    links = links[tops[links[:, 0]] != tops[links[:, 1]]]
                    for u, v in links[:TILE].tolist():
                        ru, rv = find(u), find(v)
                        if ru != rv:
                            root[rv] = ru
                            out_a.append(nodes[u])
                            out_b.append(nodes[v])
                            out_n.append(None)
                    links = links[TILE:]
            for u in np.flatnonzero(count).tolist():
                out_a.append(nodes[u])
                out_b.append(None)
                out_n.append(int(count[u]))
        return pd.DataFrame({"a": pd.array(out_a, dtype="Int64"), "b": pd.array(out_b, dtype="Int64"), "n": pd.array(out_n, dtype="Int64")})

    return materialize(rows.groupBy("task").applyInPandas(verify, "a bigint, b bigint, n bigint"), "links")


def linked_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per text with words: ``h``, ``class_id``, ``class_h`` (the class's text that stays), ``n_links``, ``n_copies``."""
    texts = distinct_texts(docs, key, text)
    links = verified_links(docs, text, texts, candidate_clusters(texts), threshold)
    classes = connected_components(links.where("b IS NOT NULL"), "classes")
    counts = links.where("n IS NOT NULL").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n_links"))
    rows = (texts.drop("sig").join(classes.withColumnRenamed("node", "uid"), "uid", "left").join(counts, "uid", "left")
            .withColumn("label", F.coalesce("label", "uid")))
    rows = materialize(rows, "linked")
    first = F.struct(F.col("first_id").isNull().alias("no_id"), "first_id", "h")
    heads = rows.groupBy("label").agg(F.min(first).alias("head")).select("label", F.col("head.first_id").alias("class_id"), F.col("head.h").alias("class_h"))
    return rows.join(heads, "label").select("h", "class_id", "class_h", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies")


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``key``, ``class_id``, ``n_links`` (other texts linked) and ``n_copies`` (rows of the same text)."""
    found = linked_texts(docs, key, text, threshold)
    rows = docs.select(F.col(key), F.when(_has_words(F.col(text)), _digest(F.col(text))).alias("h"))
    return rows.join(found, "h", "left").select(
        F.col(key), F.when(F.col("h").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row per class (of the class's first text the row with the least id) and all rows without words."""
    from pyspark.sql import Window

    found = linked_texts(docs, key, text, threshold)
    h, n = unused(docs, "_h"), unused(docs, "_n")
    stay = found.where("h = class_h").select(F.col("h").alias(h))
    rows = docs.where(_has_words(F.col(text))).withColumn(h, _digest(F.col(text)))
    first = Window.partitionBy(h).orderBy(F.col(key).asc_nulls_last())  # a limit per group: of many copies a map task sends one
    rows = rows.withColumn(n, F.row_number().over(first)).where(F.col(n) == 1).drop(n).join(stay, h, "left_semi").drop(h)
    return rows.unionByName(docs.where(~_has_words(F.col(text))))
