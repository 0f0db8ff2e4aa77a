"""Quality ledger: measurements against a plain definition, policies and ablations against row counts."""

import random
import re
from collections import Counter

from spendlens.llm import quality as Q

TEXTS = [None, "", " \n\t", "a b c", "one two three four five six seven eight nine ten eleven", "a b c d e " * 9, "x\n\nx\nx \ny", "\x1c \x85 é b\u00a0c",
         "- a\n* b\n• c\n- d", "a...\nb…\nc... \nd", "# $ % & | < > *", "x" * 50_000, "\r\n\x0b\x0c a"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {k for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines),
            sum(bool(re.match(r"[\x20\x09-\x0D]*[-*•]", x)) for x in lines), sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines))


def test_measurements():
    rnd = random.Random(1)
    texts = TEXTS + [" ".join(rnd.choice("abcd") + rnd.choice(["", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert Q.measure(t) == plain(t), t


def frame(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(TEXTS)] + [(None, "a b", "y", 6), (1, "", "x", 7), (1, "", "x", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_words string, _kept int").repartition(2)


def test_ledger_and_policy(spark):
    rows, docs = frame(spark)
    out = Q.apply_policy(Q.build_ledger(docs), Q.POLICIES["v1"]).collect()
    assert Counter((r.doc_id, *(r[m] for m in Q.MEASURES)) for r in out) == Counter((r[0], *plain(r[1])) for r in rows)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        v1 = 10 * r.n_symbols > 3 * r.n_words or 100 * r.n_dup_lines > 50 * r.n_lines
        assert r.kept == (not r.base_failed and not v1)


def test_verdict_keeps_columns(spark):
    rows, docs = frame(spark)
    judged, kept = Q.with_verdict(docs, Q.POLICIES["v2"])
    assert judged.columns == [*docs.columns, kept] and kept == "_kept_"
    ledger = Q.apply_policy(Q.build_ledger(docs), Q.POLICIES["v2"])
    assert judged.where(kept).count() == ledger.where("kept").count()


def test_ablations(spark):
    _, docs = frame(spark)
    ledger = Q.build_ledger(docs)
    bits = [r.fail_bits for r in ledger.collect()]
    for r in Q.ablations(ledger).collect():
        mask, bit = Q.POLICIES[r.policy].mask, Q.BIT[r.rule]
        assert (r.n_failed, r.n_failed_only_this) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits))
        assert (r.n_kept, r.n_kept_without) == (sum(not b & mask for b in bits), sum(not b & (mask & ~bit) for b in bits))
    assert {r.n_kept for r in Q.ablations(Q.build_ledger(docs.limit(0))).collect()} == {0}


def test_stored_ledger_is_read_without_the_texts(spark):
    _, docs = frame(spark)
    ledger = Q.stored_ledger(docs)
    for version in Q.POLICIES:
        judged = Q.apply_policy(ledger, Q.POLICIES[version])
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert all("/quality-ledger-" in f for f in judged.inputFiles()) and "Python" not in plan
        assert judged.where("kept").count() == Q.apply_policy(Q.build_ledger(docs), Q.POLICIES[version]).where("kept").count()
    from_texts = sorted(map(tuple, Q.ablations(Q.build_ledger(docs)).collect()))
    assert sorted(map(tuple, Q.ablations(ledger).collect())) == from_texts
