"""Shortlists of all entities and axes, and shares over passes, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.config import TextConfig
from tallymark.operators import evidence
from tallymark.operators.shortlist import shortlists
from tallymark.sources.store import BatchLog


def plain(rows, axes, cfg):
    out = {}
    for e, s, v in rows:
        if v is None or len(v) != 4 or any(c is None for c in v):
            continue
        for name, a in axes.items():
            norm = math.sqrt(sum(c * c for c in v)) * math.sqrt(sum(c * c for c in a))
            cos = sum(p * q for p, q in zip(v, a)) / norm if norm else 0.0
            if cos >= cfg.min_cosine:
                out.setdefault((e, name), []).append((-cos, s))
    return {(e, n, k, s) for (e, n), found in out.items() for k, (_, s) in enumerate(sorted(found)[: cfg.top_k], 1)}


@pytest.mark.parametrize("most", [10, 1 << 18])
def test_shortlists(spark, most):
    rng = random.Random(5)
    rows = [(("hot", "a", "b", None)[min(k % 9, 3)] if k % 3 else "hot", k, [float(rng.randint(0, 3)) for _ in range(4)]) for k in range(600)]
    rows += [("a", 1000, None), ("a", 1001, [1.0]), ("a", 1002, [1.0, None, 0.0, 0.0]), ("zero", 1003, [0.0] * 4)]
    axes = {"x": [1.0, 0.0, 0.0, 0.0], "xy": [2.0, 2.0, 0.0, 0.0], "none": [0.0] * 4, "all": [1.0] * 4}
    d = spark.createDataFrame([(*r, "clash", 1, 0.5) for r in rows], "entity_id string, seq long, vector array<double>, axis string, place int, cosine double")
    cfg = TextConfig(top_k=7)
    for parts in (1, 5):
        got = {(r.entity_id, r.axis, r.place, r.seq) for r in shortlists(d.repartition(parts), axes, cfg=cfg, most=most).collect()}
        assert got == plain(rows, axes, cfg)
    assert shortlists(d, {}).count() == 0 and shortlists(d.limit(0), axes).count() == 0
    with pytest.raises(ValueError, match="at most"):
        shortlists(d, {"wide": [0.0] * (1 << 21)})


def test_shares_of_a_pass_are_those_of_a_whole_run(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, k % 4, None if k % 17 == 0 else float(rng.choice((1, 1, 1, k % 50, -0.5)))) for k in range(800)]
    d = spark.createDataFrame(rows, "id int, part int, v double")
    log = BatchLog(spark, f"file://{tmp_path}/shares")
    for k in (0, 1, 1, 2, 3):
        got = {r.id: r.share for r in evidence.ecdf_pass(log, k, d.where(F.col("part") == k), "v", "share").collect()}
        whole = evidence.ecdf(d.where(F.col("part") <= k), "v", "share").where(F.col("part") == k)
        assert got == {r.id: r.share for r in whole.collect()} and len(got) == 200
    assert len(log.entries()) == 4
    empty = evidence.ecdf_pass(BatchLog(spark, f"file://{tmp_path}/none"), 0, d.limit(0), "v", "share")
    assert empty.count() == 0
