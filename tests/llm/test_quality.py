"""The Kneser-Ney model against a plain one, and both ways of scoring."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import quality
from tests.llm.test_documents import SCHEMA


def plain_model(texts, order):
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = b"\0" * (order - 1) + t.encode()
        counts[order].update(b[i : i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    disc, tot, off = {}, defaultdict(int), defaultdict(float)
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (sum(v == i for v in counts[k].values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        disc[k] = [min(max(v, 0.01), m - 0.01) for v, m in zip(d, (1, 2, 3))]
        for g, n in counts[k].items():
            tot[k, g[:-1]] += n
            off[k, g[:-1]] += disc[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        if (k, g[:-1]) not in tot:
            return p(g[1:])
        n = counts[k][g]
        t = tot[k, g[:-1]]
        return (n - disc[k][min(n, 3) - 1] if n else 0) / t + off[k, g[:-1]] / t * p(g[1:])

    return p


@pytest.mark.parametrize("most", [10**6, 0])
def test_quality(spark, most):
    base = ["the cat sat on the mat", "the dog sat on the log and the cat", "a man a plan a canal", "der hund ist im haus", "die katze ist im garten"]
    rows = [(i, base[i % 5] + " " + base[(i * 3) % 4], "de" if i % 5 > 2 else "en") for i in range(40)]
    rows += [(100, "XQZ!! ZZQX%%% QQ", "en"), (101, None, "en"), (102, "", None), (103, "é漢", None), (100, "XQZ!! ZZQX%%% QQ", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(40)] + [(1, 0), (3, None)], "doc_id long, quality int")
    p = plain_model([t for i, t, _ in rows if i < 40 and i % 2], 3)
    for r in quality.quality(d, lab, order=3, most_rows=most).collect():
        t = next(t for i, t, _ in rows if i == r.doc_id)
        if not t:
            assert r.perplexity is None and not r.keep
            continue
        b = b"\0\0" + t.encode()
        want = math.exp(-sum(math.log(p(b[i : i + 3])) for i in range(len(b) - 2)) / (len(b) - 2))
        assert r.perplexity == pytest.approx(want, rel=1e-5)
        assert r.keep == (r.low <= r.perplexity <= r.high)
        if r.doc_id == 100:
            assert not r.keep


def test_quality_empty(spark):
    e = spark.createDataFrame([], SCHEMA)
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality(e, lab).count() == 0
    got = quality.quality(spark.createDataFrame([(1, "ab", "en")], "doc_id long, text string, lang string"), lab).collect()
    assert got[0].perplexity == pytest.approx(256) and got[0].keep


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    """Only the training joins texts with their labels: the scores are joined without them."""
    plans, save = [], quality.Scratch.save
    monkeypatch.setattr(quality.Scratch, "save", lambda self, df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), save(self, df))[1])
    spark.createDataFrame([(i, f"some text {i}", "en") for i in range(20)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/d")
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    got = quality.quality(spark.read.parquet(f"{tmp_path}/d"), lab, order=3)
    assert sum(r.trusted for r in got.collect()) == 10
    scored = next(p for p in plans if "MapInArrow" in p and "log_p" in p)
    assert len(scored.split("MapInArrow")[1].split("SortMergeJoin")) == 1


def test_grams_of_fewer_bytes_than_the_order():
    for text in (b"", b"a", b"abc", b"abcde"):
        raw = np.frombuffer(text, np.uint8)
        got = quality.grams(raw, np.array([0, len(raw)]), 5).tolist()
        assert got == [int.from_bytes(text[: k + 1].rjust(5, b"\0")[-5:]) for k in range(len(text))]
    assert quality.grams(np.frombuffer(b"abc", np.uint8), np.array([0, 1, 1, 3]), 5).tolist() == [97, 98, 98 << 8 | 99]
