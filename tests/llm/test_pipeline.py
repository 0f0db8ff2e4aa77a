"""The pipeline's stages on odd inputs: nulls, repeats, clashing columns, empty tables."""

import pytest

import corpus_pipeline as P

SF001 = "/root/testdata/sf0.001"
CLASHING = "h string, score int, kept int, uid int, n_words int, _h int, class_id int, sequence_id int, t string, _kept int"
GOOD = " ".join(f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in ("one", "two", "three", "four", "five", "six"))


def frame(spark, rows):
    extra = ("x", 1, 0, 5, 9, 3, 4, 2, "y", 1)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


ROWS = [(1, GOOD, "en", "a", 5), (2, None, "en", None, None), (3, "", None, "b", 0), (None, GOOD + " more words here", "en", "a", 1), (5, "short", "en", "a", 5),
        (1, GOOD, "en", "a", 5), (7, GOOD, "de", "c", 5), (8, "word " * 30_000, "en", "a", 5), (9, GOOD.replace("alpha", "omega"), None, None, 5)]


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_odd_rows(spark, name):
    stage = dict(P.STAGES)[name]
    docs = frame(spark, ROWS)
    out = stage(spark, docs, SF001)
    rows = out.collect()
    if name == "best_fit_packing":
        assert sorted({str(r.doc_id) for r in rows}) == ["1", "2", "3", "5", "7", "8", "9", "None"] and all(r.offset + r.length <= 1024 for r in rows)
        assert sum(r.piece == 0 for r in rows) == len(ROWS)
    else:
        assert out.columns == docs.columns and {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}
    ids = [r.doc_id for r in rows]
    if name == "quality_rules":
        assert sorted(map(str, ids)) == ["1", "1", "7", "9", "None"]  # none, too short and too repetitive ones go
    if name == "ngram_jaccard_join":
        assert sorted(map(str, ids)) == ["1", "2", "3", "5", "8", "9"]  # texts without words stay, of copies the first, a near copy goes
    if name in ("toxicity", "benchmark_decontamination"):
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty(spark, name):
    assert dict(P.STAGES)[name](spark, frame(spark, []), SF001).collect() == []
