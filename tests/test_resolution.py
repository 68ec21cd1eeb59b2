"""Resolution from class counts against all pairs, and components of hubs."""

import itertools
import random
import re
from collections import Counter
from math import sqrt

import pytest
from pyspark.sql import functions as F

from tallymark.operators import entity
from tallymark.operators.graph import connected_components
from tallymark.operators.incremental import ResolutionStore

RECORDS = "seq long, ids array<string>, name string, description string, url string"


def closed(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def bag(r):
    return Counter(re.findall("[a-z0-9]+", f"{r[2] or ''} {r[3] or ''}".lower()))


def cosine(a, b):
    dot = sum(a[t] * b[t] for t in a)
    return dot / sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0


def plain(rows, alike=None, same=None):
    edges, count = [], Counter()
    for a, b in itertools.combinations(rows, 2):
        known = bool((set(a[1] or ()) & set(b[1] or ())) - {None})
        c = round((alike or (lambda x, y: cosine(bag(x), bag(y))))(a, b), 12)
        if known or c >= 0.92:
            count["auto"] += 1
            edges.append((a[0], b[0]))
        elif c >= 0.7:
            count["gray"] += 1
            if same and same(a, b):
                count["llm"] += 1
                edges.append((a[0], b[0]))
    n = len(rows)
    return closed([r[0] for r in rows], edges), (n * (n - 1) // 2, count["gray"], count["auto"], count["llm"])


def got(spark, rows, **kw):
    r = entity.resolve(spark.createDataFrame(rows, RECORDS).repartition(3), **kw)
    j = r.journal.first()
    return {x.seq: x.cluster for x in r.clusters.collect()}, (j.pairs_total, j.pairs_gray, j.merges_auto, j.merges_llm)


def some_rows(n=160, seed=4):
    r = random.Random(seed)
    words = "red blue tea cup big old new box".split()
    out = []
    for k in range(n):
        ids = [f"i{r.randrange(40)}" for _ in range(r.choice([0, 0, 1, 1, 3]))] + (["hub", "hub2"] if k % 11 == 0 else []) + [None] * (k % 7 == 0) + [f"own{k}"]
        out.append((k, ids if k % 13 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 6))) if k % 17 else None, r.choice(["", "plain words here", None, "other"]), f"u{k % 3}"))
    return out



def test_resolution_against_all_pairs(spark):
    rows = some_rows()
    assert got(spark, rows) == plain(rows)
    clusters, counts = got(spark, rows, adjudicator=lambda a: a.withColumn("same", a["a_context"]["url"] == a["b_context"]["url"]), context=("name", "description", "url"))
    assert (clusters, counts) == plain(rows, same=lambda a, b: a[4] == b[4])
    assert counts[1] > counts[3] > 0
    assert got(spark, rows, adjudicator=lambda a: a.withColumn("same", F.lit(None).cast("boolean"))) == plain(rows)


def test_resolution_with_a_similarity_put_in(spark):
    rows = some_rows(60)

    def same_start(records, key, texts, least):
        x = records.select(key, F.coalesce(F.substring(texts[0], 1, 3), F.lit("")).alias("s"), *texts)
        y = x.toDF(*[f"_{c}" for c in x.columns])
        return x.join(y, (F.col("s") == F.col("_s")) & (F.col(key) < F.col(f"_{key}"))).select(F.col(key).alias("a"), F.col(f"_{key}").alias("b"), F.lit(0.8).alias("cosine"))

    def alike(a, b):
        return 1.0 if a[2:4] == b[2:4] else 0.8 * ((a[2] or "")[:3] == (b[2] or "")[:3])

    assert got(spark, rows, similarity=same_start) == plain(rows, alike)


def test_batches_in_turn_equal_one_run(spark, tmp_path):
    """Keys that don't rise, classes that meet in later batches, a batch offered twice, an empty one; names of untouched clusters stay."""
    rows = some_rows(90, 6)
    store = ResolutionStore(spark, f"file://{tmp_path}/r", adjudicator=lambda a: a.withColumn("same", a["a_context"]["url"] == a["b_context"]["url"]), context=("name", "description", "url"))
    for batch, of in ((0, 2), (1, 0), (1, 0), (2, None), (3, 1)):
        store.add(spark.createDataFrame([r for r in rows if r[0] % 3 == of], RECORDS), batch)
    j = store.journal().first()
    found = {x.seq: x.cluster for x in store.clusters().collect()}, (j.pairs_total, j.pairs_gray, j.merges_auto, j.merges_llm)
    assert found == plain(rows, same=lambda a, b: a[4] == b[4])
    assert len(store.log.entries()) == 4


def test_hot_identifiers_and_texts_make_no_pairs(spark):
    n = 5000
    rows = [(k, ["hub"] if k % 2 else [], "one name", "", "u") for k in range(n)]
    df = spark.createDataFrame(rows, RECORDS)
    r = entity.resolve(df)
    assert r.clusters.select("cluster").distinct().collect() == [(0,)]
    assert tuple(r.journal.first()) == (n * (n - 1) // 2, 0, n * (n - 1) // 2, 0)
    m = entity.members_of(df, "seq", ["name"], ["name"])
    shared = entity.shared_identifiers(m)
    assert shared.count() == n // 2 and entity.identifier_subsets(shared).count() == n // 2


def test_questions_do_not_grow_with_identifiers(spark, tmp_path):
    """Two texts whose records have many lists of identifiers are one question, which counts the pairs that share none."""
    rows = [(k, [f"p{k % 7}", f"q{k % 5}"], "red blue tea " + ("cup" if k % 2 else "box"), "", "u") for k in range(60)]
    asked = []

    def adjudicator(a):
        asked.append(a.select("a", "b", "n").collect())
        return a.withColumn("same", F.lit(True))

    want = plain(rows, same=lambda a, b: True)
    assert got(spark, rows, adjudicator=adjudicator) == want
    assert [[tuple(r) for r in q] for q in asked] == [[(0, 1, want[1][3])]]
    asked.clear()
    store = ResolutionStore(spark, f"file://{tmp_path}/r", adjudicator=adjudicator)
    for batch in range(3):
        store.add(spark.createDataFrame([r for r in rows if r[0] // 20 == batch], RECORDS), batch)
    j = store.journal().first()
    assert (j.pairs_total, j.pairs_gray, j.merges_auto, j.merges_llm) == want[1]
    assert sum(map(len, asked)) == 1


def test_too_many_shared_identifiers(spark):
    rows = [(k, [f"i{j}" for j in range(20) if k == 0 or j == k - 1], "", "", "") for k in range(21)]
    with pytest.raises(Exception, match="shares over 16"):
        entity.resolve(spark.createDataFrame(rows, RECORDS)).journal.collect()
    # Identifiers of the same records count as one.
    rows = [(k, [f"i{j}" for j in range(20)], "", "", "") for k in range(3)]
    assert got(spark, rows) == plain(rows)


def test_resolution_of_nothing(spark):
    assert got(spark, []) == ({}, (0, 0, 0, 0))
    assert got(spark, [(3, None, None, None, None)]) == ({3: 3}, (0, 0, 0, 0))


def test_components_with_hubs(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, 1000 + k) for k in range(400)] + [(2000 + k, 2001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    nodes = sorted({n for e in edges for n in e if n is not None} | {9999})
    want = closed(nodes, [e for e in edges if None not in e])
    df, some = spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in nodes], "node long")
    for heavy in (5, 10_000):
        found = connected_components(some, df, least_heavy=heavy).collect()
        assert {x.node: x.component for x in found} == want and len(found) == len(nodes)
    assert connected_components(some, df.limit(0)).where("node <> component").count() == 0
