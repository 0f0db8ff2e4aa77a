"""URL filter: rules by hand, the model against a plain recursion."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendlens.llm import url_filter as U
from spendlens.llm.queries import URL_RULES

CASES = [  # url, host, path, rule
    ("http://a.net/x", "a.net", "/x", "net/"),
    ("http://NET/x?y", "net", "/x", "net/"),
    ("http://a.net", "a.net", "", None),
    ("http://xnet/", "xnet", "/", None),
    ("https://m.Example.NET/en/1#t", "m.example.net", "/en/1", "example.net/en/"),
    ("https://example.net/en", "example.net", "/en", "net/"),
    ("http://example.com/de/a/b?c://d", "example.com", "/de/a/b", "example.com/de/"),
    ("http://example.com/DE/", "example.com", "/DE/", None),
    ("x://y.org/fr/#", "y.org", "/fr/", "org/fr/"),
    ("http://a.net:80/x", "a.net:80", "/x", None),
    ("http://u?p/q", "u", "", None),
    ("://z.net/", "z.net", "/", "net/"),
    ("no scheme.net/", "", "", None),
    ("", "", "", None),
    (None, "", "", None),
    ("http://é.net/\nx", "é.net", "/\nx", "net/"),
    ("a\nb://c.net/d", "c.net", "/d", "net/"),
]


def test_hosts_and_rules(spark):
    rows = [(i, c[0], "r") for i, c in enumerate(CASES)]
    out = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, _rule string"), URL_RULES).collect()
    verdicts = {r.name: r.verdict for r in URL_RULES}
    for r in sorted(out, key=lambda r: r.page_id):
        _, host, path, rule = CASES[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")
        assert r["_rule"] == "r"


def plain_log_p(training, text):
    """Sum of log probabilities by recursion over dictionaries."""
    def codes(t):
        return [U.EDGE] * (U.ORDER - 1) + [int(U._FOLD[b]) for b in t.encode()] + [U.EDGE]

    seen = [Counter() for _ in range(U.ORDER)]
    for t in training:
        c = codes(t)
        for i in range(U.ORDER - 1, len(c)):
            for k in range(U.ORDER):
                seen[k][tuple(c[i - k:i + 1])] += 1

    def p(gram):
        if not gram:
            return 1 / U.SYMBOLS
        lower = p(gram[1:])
        n = sum(v for g, v in seen[len(gram) - 1].items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in seen[len(gram) - 1])
        return (seen[len(gram) - 1][gram] + kinds * lower) / (n + kinds) if n else lower

    c = codes(text)
    return sum(math.log(p(tuple(c[i - U.ORDER + 1:i + 1]))) for i in range(U.ORDER - 1, len(c)))


def test_model_equals_plain_recursion():
    training = ["http://a.b/1", "http://a.b/22?x", "", "zz"]
    grams, n = np.unique(U._grams(training)[0], return_counts=True)
    logs = U.log_probabilities(grams, n)
    for t in ["http://a.b/3", "", "qqq-é", "zz"]:
        got = logs[U._grams([t])[0]].astype(float).sum()
        assert got == pytest.approx(plain_log_p(training, t), rel=1e-5)
    assert np.exp(logs.reshape(-1, U.SYMBOLS).astype(float)).sum(axis=1) == pytest.approx(1, rel=1e-4)


def test_learns_from_rules(spark):
    rnd = random.Random(2)
    name = lambda abc: "".join(rnd.choice(abc) for _ in range(9))
    rows = [(i, f"http://{name('abcde')}.ok/{name('abcde')}") for i in range(400)] + [(1000 + i, f"http://{name('vwxyz')}.no/{name('vwxyz')}") for i in range(400)]
    rows += [(5000 + i, f"http://{name('abcde')}.q/{name('abcde')}") for i in range(60)] + [(6000 + i, f"http://{name('vwxyz')}.q/{name('vwxyz')}") for i in range(60)]
    out = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [U.Rule("allow", "ok"), U.Rule("block", "no")])
    right = out.where("page_id >= 5000").where((F.col("verdict") == "allow") == (F.col("page_id") < 6000)).count()
    assert right >= 114
    assert out.where("rule = 'ok/' AND verdict = 'allow'").count() == 400


def test_without_training(spark):
    pages = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in U.judge_urls(pages, []).collect()} == {"allow"}
    assert U.judge_urls(pages.limit(0), URL_RULES).count() == 0


def test_all_urls_count(spark):
    rows = [(f"http://a.ok/{w}", 1) for w in "abcdefghijklmnop"] + [(f"http://b.no/{w}", 0) for w in "qrstuvwxyz"]
    model = U.train(spark.createDataFrame(rows, "url string, ok int"), "url", "ok")
    logs = [U.log_probabilities(*np.unique(U._grams([u for u, a in rows if a == g])[0], return_counts=True)) for g in (0, 1)]
    assert np.array_equal(model.ratio, logs[1] - logs[0])
