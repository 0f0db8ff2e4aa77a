"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` reads the training texts once and stores postings: per block
of documents and per term, the sorted positions of the term in the block's
word stream.  Only terms that the test items use are stored (no other list is
ever asked for).  ``phrase_matches`` takes the document frequencies of the
test terms from the stored index, and in each block intersects a window's
lists from its rarest term on, each shifted by the term's offset; what is left
after the last term are exact occurrences.  ``slack`` > 0 also returns
proximity matches: places where all terms of a window stand in order within
its length plus ``slack`` words.

Scale: nothing is keyed by a term, so a frequent word or a passage that a third
of all documents share is spread like the documents.  A block is a bounded
number of words and documents (a longer document is a block of its own).  The
test items are a query set: they are taken in blocks of at most
``MAX_TEST_TERMS`` distinct terms, which bounds what each task gets with its
code; more items mean more passes over the texts, which are then written once
with an id for every row: the passes are joined on it, however Spark deals the files.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (digits, a-z, all that is
not ASCII).  A window is 13 consecutive words of an item; an item of fewer, but
not none, is one window.

Defined cases: null and empty texts have no words, documents without words
have no hits, items without words no windows; repeated items each count, with
their own ids; rows with a null item id are not items; documents with null or
repeated ids keep a row each; either table may be empty; only the named
columns of the inputs are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.common import materialize, unused

WINDOW = 13
MAX_TEST_TERMS = 400_000
BLOCK_WORDS = 400_000
BLOCK_DOCS = 4_000
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

DOC_ROWS = "\x00documents"  # no term contains this character
_INDEX = "block string, term string, n_docs bigint, positions binary, keys array<string>, uids array<string>"
_SPANS = "uid string, key string, n_words bigint, spans array<struct<item_id:bigint,start:bigint,length:bigint,kind:string>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def item_windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    words = words_of(text)
    return [tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def test_blocks(items: DataFrame, key: str, text: str, max_terms: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``max_terms`` words each (one longer item is a block of its own)."""
    block, n = [], 0
    for row in items.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint"), F.col(text)).toLocalIterator():
        w = len(words_of(row[1]))
        if block and n + w > max_terms:
            yield block
            block, n = [], 0
        if w:
            block.append((row[0], row[1]))
            n += w
    if block:
        yield block


def build_index(docs: DataFrame, terms: set[bytes], key: str = "doc_id", text: str = "text", gap: int = WINDOW,
                name: str = "postings", uid: str | None = None) -> DataFrame:
    """The stored index: per block and term the positions, and one row per block with its documents.

    ``positions`` are little-endian int32 in the block's stream, in which
    documents stand ``gap`` words apart, so that no phrase runs from one into
    the next.  The row of the documents has their ids in ``keys`` and in
    ``positions`` their starts and numbers of words; ``uids`` has the values of the
    column ``uid``, or else names that hold for this index alone.
    """

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        number, block = -1, []

        def flush() -> pd.DataFrame:
            nonlocal number
            number += 1
            lists: dict[bytes, list] = defaultdict(list)
            starts, counts, at = [], [], 0
            for _, _, words in block:
                starts.append(at)
                counts.append(len(words))
                for p, w in enumerate(words, at):
                    if w in terms:
                        lists[w].append(p)
                at += len(words) + gap
            starts_ = np.array(starts, dtype="int64")
            rows = []
            for w, ps in lists.items():
                arr = np.array(ps, dtype="<i4")
                n_docs = len(np.unique(np.searchsorted(starts_, arr, side="right")))
                rows.append((f"{part}-{number}", w.decode("utf-8", "replace"), n_docs, arr.tobytes(), None, None))
            uids = [f"{part}-{number}-{d}" if u is None else u for d, (u, _, _) in enumerate(block)]
            rows.append((f"{part}-{number}", DOC_ROWS, len(block), np.array(starts + counts, dtype="<i4").tobytes(), [i for _, i, _ in block], uids))
            return pd.DataFrame(rows, columns=["block", "term", "n_docs", "positions", "keys", "uids"])

        n = 0
        for frame in frames:
            for u, i, t in zip(frame["uid"].tolist(), frame["key"].tolist(), frame["text"].tolist(), strict=True):
                words = words_of(t)
                if block and (n + len(words) > BLOCK_WORDS or len(block) >= BLOCK_DOCS):
                    yield flush()
                    block, n = [], 0
                block.append((u, i, words))
                n += len(words) + gap
        if block:
            yield flush()

    own = F.lit(None) if uid is None else F.col(uid)
    rows = docs.select(own.cast("string").alias("uid"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInPandas(index, _INDEX), name)


def _chains(places: dict[bytes, np.ndarray], window: tuple[bytes, ...], order: list[int], slack: int) -> np.ndarray:
    """Starts at which the window's words stand in order within its length plus ``slack`` (ends need not be adjacent)."""
    anchor = order[0]
    found = []
    reach = len(window) + slack
    for p in places[window[anchor]].tolist():
        low, ok = p, True
        for j in range(anchor - 1, -1, -1):  # the last place before
            a = places[window[j]]
            k = int(np.searchsorted(a, low)) - 1
            if k < 0 or a[k] <= p - reach:
                ok = False
                break
            low = int(a[k])
        high = p
        if ok:
            for j in range(anchor + 1, len(window)):
                a = places[window[j]]
                k = int(np.searchsorted(a, high, side="right"))
                if k == len(a) or a[k] >= low + reach:
                    ok = False
                    break
                high = int(a[k])
        if ok:
            found.append((low, high - low + 1))
    return np.array(sorted(set(found)), dtype="int64").reshape(-1, 2)


def phrase_matches(index: DataFrame, items: list[tuple[int, str]], size: int = WINDOW, slack: int = 0) -> DataFrame:
    """One row per indexed document: its id (as text), number of words and matched spans (item, start, length, kind)."""
    windows: dict[tuple[bytes, ...], set[int]] = defaultdict(set)
    for item, t in items:
        for w in item_windows(t, size):
            windows[w].add(item)
    freq = {r[0].encode(): r[1] for r in index.where(F.col("term") != DOC_ROWS).groupBy("term").agg(F.sum("n_docs")).collect()}  # a row per test term at most
    plans: dict[bytes, list] = defaultdict(list)  # by rarest term
    for w, ids in windows.items():
        if all(t in freq for t in w):
            order = sorted(range(len(w)), key=lambda k: (freq[w[k]], k))
            plans[w[order[0]]].append((w, order, sorted(ids)))
    plans = dict(plans)

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        places: dict[bytes, np.ndarray] = {}
        starts, counts, doc_keys, doc_uids = (), (), (), ()
        for term, pos, keys, uids in zip(frame["term"], frame["positions"], frame["keys"], frame["uids"], strict=True):
            if term == DOC_ROWS:
                (starts, counts), doc_keys = np.frombuffer(pos, dtype="<i4").astype("int64").reshape(2, -1), keys
                doc_uids = uids
            else:
                places[term.encode()] = np.frombuffer(pos, dtype="<i4").astype("int64")
        spans: dict[int, set] = defaultdict(set)

        def add(at: int, length: int, ids: list[int], kind: str) -> None:
            d = int(np.searchsorted(starts, at, side="right")) - 1
            for i in ids:
                spans[d].add((i, int(at - starts[d]), length, kind))

        for rarest in places.keys() & plans.keys():
            for w, order, ids in plans[rarest]:
                if not all(t in places for t in w):
                    continue
                at = places[rarest] - order[0]
                for k in order[1:]:
                    if not len(at):
                        break
                    a = places[w[k]]
                    j = np.minimum(np.searchsorted(a, at + k), len(a) - 1)
                    at = at[a[j] == at + k]
                for s in at.tolist():
                    add(s, len(w), ids, "phrase")
                if slack:
                    exact = set(at.tolist())
                    for s, length in _chains(places, w, order, slack).tolist():
                        if s not in exact or length != len(w):
                            add(s, length, ids, "proximity")
        return pd.DataFrame({
            "uid": list(doc_uids),
            "key": list(doc_keys),
            "n_words": counts,
            "spans": [[{"item_id": i, "start": s, "length": n, "kind": k} for i, s, n, k in sorted(spans.get(d, ()))] for d in range(len(starts))],
        })

    return index.groupBy("block").applyInPandas(match, _SPANS)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", size: int = WINDOW, slack: int = 0, max_terms: int = MAX_TEST_TERMS) -> DataFrame:
    """One row per document: ``uid``, ``key``, ``n_words`` and ``spans`` of all items."""
    gap = size + slack
    key_type = docs.schema[key].dataType
    found, uid = None, None
    blocks = test_blocks(items, item_key, item_text, max_terms)
    first, second = next(blocks, None), next(blocks, None)
    if second:  # several passes must name the same documents, so the names are written with them
        uid = unused(docs, "_uid")
        docs = materialize(docs.select(key, text, F.monotonically_increasing_id().alias(uid)), "texts")
    for block in chain((b for b in (first, second) if b), blocks):
        terms = {w for _, t in block for w in words_of(t)}
        index = build_index(docs, terms, key, text, gap, uid=uid)
        part = phrase_matches(index, block, size, slack)
        if found is None:
            found = part
        else:
            more = part.select("uid", F.col("spans").alias("more"))
            found = found.join(more, "uid", "left").select("uid", "key", "n_words", F.concat("spans", F.coalesce("more", F.array())).alias("spans"))
    if found is None:
        found = phrase_matches(build_index(docs, set(), key, text, gap), [], size)
    return found.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)


def hit_words(spans: Column) -> Column:
    """The number of words in the union of the spans."""
    ends = F.aggregate(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] + s["length"]).alias("b")))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
                                F.greatest(acc["end"], s["b"]).alias("end")))
    return ends["n"]


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contamination ledger of ``contamination``'s result: phrase hits, items and the verdict (20 * n_hit >= n_words)."""
    phrases = F.filter("spans", lambda s: s["kind"] == "phrase")
    return (found.withColumn("p", phrases)
            .withColumn("items", F.array_sort(F.array_distinct(F.transform("p", lambda s: s["item_id"].cast("string")))))
            .select("uid", F.col(key), F.col("n_words"), hit_words(F.col("p")).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without its contaminated rows.  The verdict depends on the text alone, so rows go by their text's SHA-256."""
    h = unused(docs, "_sha")
    keyed = docs.withColumn(h, F.sha2(F.col(text), 256))
    ledger = digest(contamination(keyed.select(h, text), items, key=h, text=text, **options), h)
    return keyed.join(ledger.where("contaminated").select(h).distinct(), h, "left_anti").drop(h)
