"""Best-fit packing: the plan against a brute-force best-fit decreasing, pieces against the tokenizer."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spendlens.llm import packing
from spendlens.llm.queries import packed, tokenizer_path


def brute_rooms(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((r for r in rooms if r >= n), default=None)
        if best is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(best)] -= n
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([1, 5, 10, 37, 64])
    lengths = [rnd.randint(1, cap if rnd.random() < .6 else max(1, cap // 4)) for _ in range(rnd.randint(0, 150))]
    at = defaultdict(list)
    for n, first, end, seq, off, each in packing.plan_best_fit(Counter(lengths), cap):
        for r in range(first, end):
            at[seq + (r - first) // each].append((off + (r - first) % each * n, n))
    assert Counter(n for x in at.values() for _, n in x) == Counter(lengths)
    for x in at.values():
        pos = 0
        for off, n in sorted(x):
            assert off == pos
            pos += n
        assert pos <= cap
    assert sorted(cap - sum(n for _, n in x) for x in at.values()) == brute_rooms(lengths, cap)


def test_tree_finds_the_tightest():
    tree, marked, rnd = packing.CapacityTree(50), set(), random.Random(3)
    for _ in range(2000):
        c = rnd.randint(0, 50)
        tree.mark(c, c not in marked)
        marked ^= {c}
        x = rnd.randint(0, 50)
        assert tree.tightest(x) == min((m for m in marked if m >= x), default=None)


def test_too_long_a_piece_is_an_error():
    with pytest.raises(ValueError):
        packing.plan_best_fit({6: 1}, 5)


TEXTS = ["", "a  b", " a", "a ", "a \n b", "x\n\n b\t c", "x<|endoftext|> y", "it's  don't z", "\x1c a \x1c b", "a\x85 b 12ab  ", "日本 語テ スト",
         "word " * 3000, "tail\n \n", " \n a", "é è  ü\u00a0x y"]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    encode, whole = packing.text_encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in TEXTS:
        assert np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", None, 2), (3, None, "x", 3), (3, None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, _part int").repartition(3)
    out = packed(docs, tokenizer_path()).collect()
    expected = Counter()
    for i, t, *_ in rows:
        ids = [*(whole.encode(t or "", add_special_tokens=False).ids), 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        pos = 0
        for off, n in sorted(x):
            assert off == pos
            pos += n
        assert pos <= 1024
    assert len(by) == len(brute_rooms([r.length for r in out], 1024))


def test_items_keep_their_columns_and_may_be_none(spark):
    items = spark.createDataFrame([(7, "a"), (3, "b"), (3, "b"), (10, None)], "n long, _rank string")
    out = packing.best_fit_pack(items, length="n", capacity=10, sequence="s", offset="o").collect()
    assert Counter((r.n, r["_rank"]) for r in out) == Counter([(7, "a"), (3, "b"), (3, "b"), (10, None)])
    assert len({r.s for r in out}) == 3
    assert packing.best_fit_pack(items.limit(0), length="n").count() == 0
    assert packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
