"""Quality rules as a bitmask ledger.

``build_ledger`` reads every whole text once and stores its measurements and
one bit per failed rule.  Policies are versioned masks over those bits, so
``apply_policy`` and ``ablations`` never read a text again: an ablation is one
aggregate over the (at most ``2**len(RULES)``) distinct masks.

Words are ``[^\\x20\\x09-\\x0D]+``.  All rules compare integers, so the same
row gives the same bits everywhere.

Defined cases: a null text has no words (like an empty one) and fails
``few_words``; a very long text is read whole; repeated rows and null ids each
keep their own row; an empty table gives an empty ledger; other columns of the
input, whatever their names, are not touched (the ledger selects the key and
its own columns; ``with_verdict`` keeps the input's columns and picks an unused
name for the verdict).
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.llm.common import WS, materialize, unused

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_bullet_lines", "n_ellipsis_lines")

#: (name, SQL condition of failure).  The position is the bit and never changes; new rules go to the end.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("bullet_lines", "n_lines >= 3 AND 100 * n_bullet_lines > 90 * n_lines"),
    ("ellipsis_lines", "n_lines >= 3 AND 100 * n_ellipsis_lines > 50 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version is a set of rules; a text is kept if none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (
    BASE,
    Policy("v1", BASE.rules + ("many_symbols", "duplicate_lines")),
    Policy("v2", tuple(name for name, _ in RULES)),
)}
DEFAULT_POLICY = "v2"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    covered = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        again = bytearray(len(windows))
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                again[i] = again[j] = 1
        end = 0  # words before it are counted
        for i, hit in enumerate(again):
            if hit:
                covered += i + WINDOW - max(i, end)
                end = i + WINDOW
    lines = [s for s in text.split("\n") if s.strip(WS)]
    heads = [s.strip(WS) for s in lines]
    return (
        n,
        len(text) - sum(map(text.count, WS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        covered,
        len(lines),
        sum(h[0] in "-*•" for h in heads),
        sum(h.endswith(("...", "…")) for h in heads),
    )


_MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.pandas_udf(_MEASURED)
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES), dtype="int64")


def _fail_bits(m: str) -> Column:
    """The failure bits from the measurements in the struct column ``m``."""
    bits = F.lit(0).cast("bigint")
    for name, failed in RULES:
        for measure_name in MEASURES:
            failed = failed.replace(measure_name, f"{m}.{measure_name}")
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(BIT[name])).otherwise(0).cast("bigint"))
    return bits


def build_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, the measurements and ``fail_bits`` over all rules."""
    one = docs.select(F.col(key), _measures(F.col(text)).alias("m"))
    return one.select(F.col(key), "m.*", _fail_bits("m").alias("fail_bits"))


def stored_ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger written once: policies and ablations read it (numbers, no text) as often as they like."""
    return materialize(build_ledger(docs, key, text), "quality-ledger")


def apply_policy(ledger: DataFrame, policy: Policy) -> DataFrame:
    """Add ``base_failed``, ``kept`` and the policy's version to a ledger."""
    return ledger.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0,
        "policy": F.lit(policy.version),
    })


def with_verdict(docs: DataFrame, policy: Policy, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with all its columns and one boolean column more, whose name is returned."""
    m, kept = unused(docs, "_measures"), unused(docs, "_kept")
    return (docs.withColumn(m, _measures(F.col(text)))
            .withColumn(kept, _fail_bits(m).bitwiseAND(F.lit(policy.mask | BASE.mask)) == 0).drop(m), kept)


def ablations(ledger: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """Per policy and rule: rows that fail it, that fail nothing else, and rows kept without it.

    The ledger is first counted by mask (partial aggregation, at most
    ``2**len(RULES)`` rows), the ablations are bit operations on those counts.
    """
    spark = ledger.sparkSession
    masks = ledger.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p.version, r, p.mask, BIT[r]) for p in (policies or list(POLICIES.values())) for r in p.rules]
    each = spark.createDataFrame(rows, "policy string, rule string, mask bigint, bit bigint")
    bits, mask, bit = F.col("fail_bits"), F.col("mask"), F.col("bit")
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint")
    pairs = each.join(masks, F.lit(True), "left")  # a nested loop over a few rules and at most 2**len(RULES) masks, whatever the corpus
    return pairs.groupBy("policy", "rule").agg(
        n(bits.bitwiseAND(bit) != 0).alias("n_failed"),
        n(bits.bitwiseAND(mask) == bit).alias("n_failed_only_this"),
        n(bits.bitwiseAND(mask) == 0).alias("n_kept"),
        n(bits.bitwiseAND(mask).bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )
