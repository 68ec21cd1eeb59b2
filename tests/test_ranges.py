"""Operators over ranges and rare tokens against plain versions: heavy tails, ties, nulls, tokens in every record."""

import random
import re
from collections import Counter
from math import sqrt

import numpy as np
import pytest

from tallymark.operators import entity, evaluate, evidence
from tallymark.operators.running import running_sum


def values(n=3000):
    rng = random.Random(5)
    return [None if i % 50 == 0 else float(int(10 ** (rng.random() * 9))) if i % 3 else 7.0 for i in range(n)]


def test_shares_and_percentiles(spark):
    v = values()
    d = spark.createDataFrame(list(enumerate(v)), "i int, v double")
    known = np.sort([x for x in v if x is not None])
    for r in evidence.ecdf(d, "v", "share").collect():
        assert r.share == pytest.approx(0 if r.v is None else np.searchsorted(known, r.v, "right") / len(known), abs=1e-12)
    low, high = np.percentile(known, [1, 99])
    got = {r.i: r.v for r in evidence.winsorize(d, "v").collect()}
    assert len(got) == len(v)
    for i, x in enumerate(v):
        assert got[i] is None if x is None else got[i] == pytest.approx(min(max(x, low), high))


def test_shares_of_few_rows(spark):
    none = spark.createDataFrame([(1, None), (2, None)], "i int, v double")
    assert [r.share for r in evidence.ecdf(none, "v", "share").collect()] == [0, 0]
    assert [r.v for r in evidence.winsorize(none, "v").collect()] == [None, None]
    assert evidence.winsorize(none.limit(0), "v").count() == 0
    one = spark.createDataFrame([(1, 4.0)], "i int, v double")
    assert evidence.winsorize(one, "v").first().v == 4.0 and evidence.ecdf(one, "v", "s").first().s == 1.0


def test_running_sum(spark):
    rows = [(f"g{i % 3}", i) for i in range(500)]
    got = running_sum(spark.createDataFrame(rows, "g string, i int"), ["g", "i"], "i", "upto").collect()
    total, want = 0, {}
    for g, i in sorted(rows):
        total += i
        want[g, i] = total
    assert {(r.g, r.i): r.upto for r in got} == want


def test_report_lines(spark):
    e = spark.createDataFrame([("b", "y", "leader", 90.0), ("a", "y", "contender", 60.0), ("c", "x", "contender", 61.5), ("d", "z", "odd", 1.0)], "entity_id string, name string, band string, score_pct double")
    c = spark.createDataFrame([("s2", "two"), ("s1", "one")], "stage string, text string")
    got = sorted((r.section, r.line_no, r.line) for r in evaluate.report_lines(e, c).collect())
    assert got == [
        (1, 0, "## leader"), (1, 1, "(none)"), (2, 0, "## contender"), (2, 1, "- x: 61.50"), (2, 2, "- y: 60.00"), (3, 0, "## candidate"), (3, 1, "(none)"),
        (4, 0, "## unverified"), (4, 1, "- z: 1.00"), (5, 1, "- stage s1 one"), (5, 2, "- stage s2 two"),
    ]


@pytest.mark.parametrize("least", [0.35, 0.7, 0.95, 1.0])
def test_cosine_pairs(spark, least):
    rng = random.Random(3)
    words = ["inc", "group", *[f"w{i}" for i in range(12)]]
    texts = [" ".join(["Inc", *rng.choices(words, k=rng.randint(0, 6))]) for _ in range(120)] + ["", None, "inc", "INC inc", "inc inc"]
    bags = [Counter(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    want = {}
    for i in range(len(bags)):
        for j in range(i + 1, len(bags)):
            a, b = bags[i], bags[j]
            if a and b:
                c = sum(n * b[w] for w, n in a.items()) / sqrt(sum(n * n for n in a.values())) / sqrt(sum(n * n for n in b.values()))
                if round(c, 12) >= least:
                    want[i, j] = c
    got = {(r.a, r.b): r.cosine for r in entity.cosine_pairs(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", ["t"], least).collect()}
    assert got == pytest.approx(want)
