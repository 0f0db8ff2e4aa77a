"""Best-fit-decreasing packing of token sequences.

``cut_pieces`` tokenises whole texts and cuts those longer than a sequence.
``best_fit_pack`` puts pieces into as few sequences as best-fit decreasing
finds: longest piece first, each into the open sequence with the least room
that still holds it, found by a segment tree over the remaining capacities.

Best-fit decreasing only looks at lengths, and a length is at most the
capacity.  So the packing is planned on the histogram of lengths (at most
``capacity`` rows, whatever the corpus): all sequences with the same room are
kept as ranges of sequence numbers, and a whole run of equal pieces is placed
at a time.  The plan says for the ``r``-th piece of a length where it goes; the
executors number the pieces of each length (counts by partition, then a running
sum over partitions) and look their places up.  No piece passes through the
driver and no length is a task of its own.

Defined cases: a null text is an empty one, whose only token is the end token;
a very long text is cut as a whole; repeated rows and null ids are packed like
any others; an empty table gives an empty result; other columns of the items
are kept but for those with the names of the added ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendlens.llm.common import materialize, unused

SEQUENCE = 1024
END_TOKEN = 2
WORD_CACHE = 200_000  # words whose ids a Python worker remembers


class CapacityTree:
    """Segment tree over the capacities 0..n with open bins: marks, and the least marked capacity >= x."""

    def __init__(self, n: int):
        self.size = 1 << max(1, n).bit_length()
        self.tree = bytearray(2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.tree[i] = is_open
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.tree[i]:
            return least
        while i > 1:  # up, until a right sibling has an open bin
            if not i & 1 and self.tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.size:  # down, leftmost
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts of lengths.

    Returns segments ``(length, first_rank, end_rank, first_sequence, offset,
    per_sequence)``: the pieces of that length with ranks in [first, end) go to
    consecutive sequences from ``first_sequence``, ``per_sequence`` into each,
    the first of them at ``offset``.
    """
    tree = CapacityTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, number of sequences)]
    new, plan = 0, []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                tree.mark(room, True)
            ranges[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit into {capacity}")
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, new, -(-left // (capacity // length))
                new += n
            else:
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    tree.mark(room, False)
            each = room // length  # the emptied room is the tightest again while it holds one more
            full = min(n, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, capacity - room, each))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left:  # fewer than one sequence takes
                    plan.append((length, rank, rank + left, first + full, capacity - room, each))
                    put(room - left * length, first + full, 1)
                    put(room, first + full + 1, n - full - 1)
                    left = 0
                else:
                    put(room, first + full, n - full)
    return plan


def best_fit_pack(items: DataFrame, length: str = "length", capacity: int = SEQUENCE, sequence: str = "sequence_id",
                  offset: str = "offset") -> DataFrame:
    """Add ``sequence`` and ``offset`` to the items (columns of theirs with these names go); lengths must lie in 1..``capacity``."""
    items = items.drop(*[c for c in items.columns if c.lower() in (sequence.lower(), offset.lower())])
    part, rank = unused(items, "_part"), unused(items, "_rank")
    schema = items.withColumns({part: F.lit(0).cast("int"), rank: F.lit(0).cast("bigint")}).schema

    def number(frames: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        here, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype="int64")
        for batch in frames:
            n = batch.column(length).to_numpy(zero_copy_only=False).astype("int64")
            order = np.argsort(n, kind="stable")
            runs, starts, counts = np.unique(n[order], return_index=True, return_counts=True)
            ranks = np.empty(len(n), dtype="int64")
            ranks[order] = np.arange(len(n)) - np.repeat(starts, counts) + np.repeat(seen[runs], counts)
            seen[runs] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), here, dtype="int32")), pa.array(ranks)],
                                             names=[*batch.schema.names, part, rank])

    # written once, so that the numbers within a partition stay as counted
    numbered = materialize(items.mapInArrow(number, schema), "pieces")
    n = unused(numbered, "_n")
    counts = numbered.groupBy(part, length).agg(F.count(F.lit(1)).alias(n))
    counts = materialize(counts, "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy(length).agg(F.sum(n)).collect()}  # at most ``capacity`` rows
    plan = np.array(plan_best_fit(histogram, capacity), dtype="int64").reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 48 | plan[:, 1]  # by length, then by first rank
    before = Window.partitionBy(length).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(part, length, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(rank + "0"))
    placed = numbered.join(base, [part, length]).select(*items.columns, (F.col(rank) + F.col(rank + "0")).alias(rank))

    @F.pandas_udf("struct<s:bigint,o:bigint>")
    def place(n: pd.Series, r: pd.Series) -> pd.DataFrame:
        n, r = n.to_numpy("int64"), r.to_numpy("int64")
        at = plan[np.searchsorted(keys, n << 48 | r, side="right") - 1] if len(n) else plan[:0]
        k = r - at[:, 1]
        each = np.maximum(at[:, 5], 1)
        return pd.DataFrame({"s": at[:, 3] + k // each, "o": at[:, 4] + k % each * n})

    to = unused(placed, "_to")
    return (placed.withColumn(to, place(F.col(length).cast("bigint"), F.col(rank)))
            .select(*items.columns, F.col(f"{to}.s").alias(sequence), F.col(f"{to}.o").alias(offset)))


class _WordIds(dict):
    """By word: the ids (little-endian uint32) of the word with a space before it; forgets all when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return ids


_ENCODERS: dict[str, object] = {}


def text_encoder(path: str):
    """A function from a text to the bytes of its ids (uint32), equal to the ids of the tokenizer file at ``path``.

    The byte-level BPE never merges over the space before a word, so words are
    encoded once and remembered.  A text in which a space stands before other
    white space or at the end, or which holds a special token's string, goes
    through the tokenizer as a whole.
    """
    import json
    import re

    if path in _ENCODERS:
        return _ENCODERS[path]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    special = [t["content"] for t in spec.get("added_tokens", [])]
    odd = re.compile("|".join([r" (?=\s)", r" \Z", *map(re.escape, special)]))
    encode = _ranked(spec) or (lambda w: whole.encode(w, add_special_tokens=False).ids)
    words = _WordIds(encode)

    def ids(text: str) -> bytes:
        if odd.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(encode(first), dtype="<u4").tobytes() + b"".join(map(words.__getitem__, rest))

    _ENCODERS[path] = ids
    return ids


def byte_pieces(path: str) -> dict[bytes, int]:
    """The pieces (as bytes) of a byte-level vocabulary file, without special tokens."""
    import json

    return _as_bytes(json.load(open(path, encoding="utf-8")))


def _as_bytes(spec: dict) -> dict[bytes, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as themselves
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}


def _ranked(spec: dict):
    """A faster encoder of the same byte-level BPE, where the file's vocabulary is in merge order; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    import tiktoken

    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in merges]
    if merged != sorted(merged):
        return None
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_as_bytes(spec), special_tokens={}).encode_ordinary


def cut_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = SEQUENCE,
               end_token: int = END_TOKEN) -> DataFrame:
    """``key``, ``piece``, ``start``, ``length`` and ``ids`` (little-endian uint32) of every piece.

    Of a document longer than ``capacity`` the first piece takes the remainder,
    all others are full.
    """
    schema = docs.select(F.col(key), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"),
                         F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("ids")).schema
    end = np.array([end_token], dtype="<u4").tobytes()

    def cut(frames: Iterator) -> Iterator:
        import pyarrow as pa

        encode = text_encoder(tokenizer)
        for batch in frames:
            rows, pieces, starts, lengths, ids = [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                data = (encode(t) if t else b"") + end
                n = len(data) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + (n % capacity or capacity if piece == 0 else capacity)
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(to - at)
                    ids.append(data[4 * at:4 * to])
                    at, piece = to, piece + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())], names=[f.name for f in schema])

    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema)
