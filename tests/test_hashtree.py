"""Hash trees and folds in order against plain Python."""

import hashlib

import pytest

from tallymark import streaming
from tallymark.operators import hashtree, snapshot


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def plain_fingerprint(rows):
    out = {}
    for e, c in rows:
        if e is not None:
            out.setdefault(e, []).append(sha(c))
    return {e: sha("\n".join(sorted(h))) for e, h in out.items()}


ROWS = [("a", f"t{k % 40}") for k in range(120)] + [("b", None), ("b", ""), ("c", "x"), (None, "y")] + [("hot", "same")] * 9000


def test_fingerprint_passes_hashes_in_order(spark):
    d = spark.createDataFrame(ROWS, "entity_id string, content string")
    assert {r.entity_id: r.hash for r in snapshot.fingerprint(d.repartition(7)).collect()} == plain_fingerprint(ROWS)
    assert snapshot.fingerprint(d.limit(0)).count() == 0
    numbers = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "entity_id long, content string")
    assert {r.entity_id: r.hash for r in snapshot.fingerprint(numbers).collect()} == plain_fingerprint([(1, "a"), (2, "b"), (1, "c")])


def test_changed_ranges(spark, tmp_path):
    schema = "entity_id string, content string, hash string, prefix string, n int"  # columns that clash are left alone
    wide = lambda rows: spark.createDataFrame([(e, c, "h", "p", 1) for e, c in rows], schema)
    after = [r for r in ROWS if r[0] != "c"] + [("d", "new"), ("hot", "same"), ("a", "t3"), ("a", "more")]
    b = hashtree.write_tree(wide(ROWS), f"file://{tmp_path}/b")
    a = hashtree.write_tree(wide(after).repartition(5), f"file://{tmp_path}/a")
    got = {(r.entity_id, r.prefix): (r.n_before, r.n_after) for r in hashtree.changed_ranges(b, a).collect()}
    want = {}
    for side, rows in enumerate((ROWS, after)):
        for e, c in rows:
            if e is not None:
                want.setdefault((e, sha(c)[:6]), ({}, {}))[side].setdefault(sha(c), []).append(1)
    want = {k: (sum(map(len, x.values())), sum(map(len, y.values()))) for k, (x, y) in want.items() if x != y}
    assert got == want
    assert {k for k in got} == {("c", sha("x")[:6]), ("d", sha("new")[:6]), ("hot", sha("same")[:6]), ("a", sha("t3")[:6]), ("a", sha("more")[:6])}
    # The same rows in another order make the same tree, also when read again.
    again = hashtree.write_tree(wide(ROWS[::-1]).repartition(3), f"file://{tmp_path}/c")
    assert hashtree.changed_ranges(hashtree.read_tree(wide(ROWS), f"file://{tmp_path}/b"), again).count() == 0
    changed = {r.entity_id: r.changed for r in snapshot.changed(b.roots, a.roots).collect()}
    assert changed == {"a": True, "b": False, "d": True, "hot": True}
    empty = hashtree.write_tree(wide(ROWS).limit(0), f"file://{tmp_path}/d")
    assert {r.entity_id for r in hashtree.changed_ranges(empty, b).collect()} == {"a", "b", "c", "hot"}
    with pytest.raises(ValueError):
        hashtree.write_tree(wide(ROWS), f"file://{tmp_path}/e", digits=(2, 4))
    with pytest.raises(ValueError):
        hashtree.changed_ranges(b, hashtree.HashTree((0, 3), a.levels[:2]))


def test_token_bucket_goes_on_over_batches(spark):
    rows = [("u", k * 7.0, k) for k in range(500)] + [(None, k * 20.0, 1000 + k) for k in range(50)] + [("u", None, 2000)]
    d = spark.createDataFrame(rows, "k string, at double, id long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r.id: r.granted for r in streaming.token_bucket(d.repartition(5), "k", "at", "id", 2.0).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {2000: False}
    for key in ("u", None):
        tokens, last = 2.0, None
        for k, t, i in rows:
            if k == key and t is not None:
                tokens = tokens if last is None else min(2.0, tokens + (t - last) * 2.0 / 60)
                last, want[i] = t, tokens + 1e-9 >= 1
                tokens -= want[i]
    assert got == want and 0 < sum(want.values()) < len(want)
