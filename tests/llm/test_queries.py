"""The registered queries against their SQL, and the pipeline stage by stage against the operators' definitions."""

import pytest

import corpus_pipeline as P
from oracle_compare import compare, duck
from spendlens.llm import quality
from spendlens.llm.oracle import ORACLE_SQL
from spendlens.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
NAMES = {"1": "packing", "2": "html", "3": "quality", "4": "warc", "5": "ngram", "6": "url", "7": "toxicity", "8": "lm", "9": "decontamination", "10": "tool",
         "11": "prefix_trie", "12": "language", "13": "collocations"}


def test_one_query_for_each_operator():
    numbers = [n[2:].split("_")[0] for n in QUERIES]
    assert sorted(numbers) == sorted(NAMES) and all(NAMES[k] in n for k, n in zip(numbers, QUERIES, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    r = compare(spark, duck(SF001), name, QUERIES[name], ORACLE_SQL[name], SF001)
    assert r["schema"], r["names"]
    assert r["rows"][0] == r["rows"][1] and r["hash"]


@pytest.mark.parametrize("name", ["op2_html_extraction", "op4_warc_derivatives", "op6_url_filters"])
def test_a_row_for_every_page(spark, name):
    n = spark.read.parquet(f"{SF001}/pages.parquet").count()
    assert QUERIES[name](spark, SF001).count() == n * (2 if "op4" in name else 1)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    frame = {"start": docs}
    for (name, stage), before in zip(P.STAGES, ["start", *(n for n, _ in P.STAGES)], strict=False):
        out = stage(spark, frame[before], SF001).cache()
        frame[name] = out
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            assert out.join(frame[before], docs.columns, "left_semi").count() == out.count() <= frame[before].count()
    ids = {n: {r.doc_id for r in f.select("doc_id").collect()} for n, f in frame.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    mask = quality.POLICIES[quality.DEFAULT_POLICY]
    ledger = quality.apply_policy(quality.build_ledger(docs), mask)
    assert ids["quality_rules"] == {r.doc_id for r in ledger.where("kept").collect()}
    kept = [texts[i] for i in ids["ngram_jaccard_join"]]
    assert len(kept) == len(set(kept)) and {texts[i] for i in ids["ngram_jaccard_join"]} <= {texts[i] for i in ids["toxicity"]}
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]
    assert P.run(spark, SF001).select("doc_id", "piece", "start", "length", "ids_crc32").exceptAll(
        frame["best_fit_packing"].select("doc_id", "piece", "start", "length", "ids_crc32")).count() == 0
