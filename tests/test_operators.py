"""Hand fixtures for what the tables don't exercise."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallymark import streaming
from tallymark.functions import expr as x
from tallymark.operators import evaluate, evidence, records
from tallymark.sources import hits, requests

URLS = {
    "HTTP://Ex.COM:80/a//": "http://ex.com:80/a",
    "https://x.y/p?b=2&a=1&UTM_Source=z#frag": "https://x.y/p?a=1&b=2",
    "https://x.y/p?k=&k": "https://x.y/p?k=&k=",
    "https://x.y/?q=a+b%7E*": "https://x.y?q=a+b~%2A",
    "": "",
    None: "",
    "///": "/",
    "plain": "plain",
}


def test_canonical_url(spark):
    d = spark.createDataFrame([(u,) for u in URLS], "u string")
    assert {r.u: r.c for r in d.select("u", x.canonical_url(F.col("u")).alias("c")).collect()} == URLS


def test_strip_boilerplate(spark):
    d = spark.createDataFrame([("> quoted\n a  b \n  > more\n\nc",), (None,), ("  ",)], "t string")
    assert [r[0] for r in d.select(x.strip_boilerplate(F.col("t"))).collect()] == ["a b c", "", ""]


def test_rebuild_abstract(spark):
    d = spark.sql("select map('world', array(1), 'hello', array(0, 2), 'x', array(2)) m")
    assert d.select(x.rebuild_abstract(F.col("m"))).first()[0] == "hello world x"


def test_network_slot(spark):
    rows = [(1.0, None, None, 0.4), (2.0, None, [], 0.4), (3.0, 0.7, [(1.0,)], 0.4), (4.0, None, [(2.0,), (None,), (0.5,)], None)]
    d = spark.createDataFrame([("code", c, 0.0, n, g, a) for c, n, g, a in rows], "signal_type string, primary_count double, dt_months double, network double, dependents array<struct<criticality:double>>, authority double")
    got = {r.primary_count: r.network_w for r in evidence.normalize_evidence(d).collect()}
    assert got == {1.0: 0.4, 2.0: 0.0, 3.0: 0.7, 4.0: 2.5}


def test_band_rule_row_and_column(spark):
    """The row form of the stream and the column form agree everywhere."""
    r = random.Random(5)
    rows = [(r.choice([0, 4.99, 5, 19.99, 20, 24.99, 25, 50, 54.99, 55, 79.99, 80, 85, r.uniform(0, 100)]) * 1.0, r.choice([None, "leader", "contender", "candidate", "unverified", "odd"]), r.random() < 0.1) for _ in range(600)]
    d = spark.createDataFrame(rows, "s double, p string, d boolean")
    for g in d.select("s", "p", "d", evidence.assign_band(F.col("s"), F.col("p"), F.col("d"))["band"].alias("b")).collect():
        assert g.b == streaming.next_band(g.s, g.p, g.d)


def test_band_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[("a", 1, 81.0), ("a", 2, 52.0), ("b", 1, 19.0)], [("a", 3, 4.0), ("b", 2, 24.0), ("b", 3, 25.0)]]):
        spark.createDataFrame([(*r, False) for r in rows], "entity_id string, pass long, score double, dead boolean").coalesce(1).write.mode("append").parquet(f"file://{src}/{k}")
    s = spark.readStream.schema("entity_id string, pass long, score double, dead boolean").option("maxFilesPerTrigger", 1).parquet(f"file://{src}/*")
    q = streaming.band_stream(s).writeStream.format("memory").queryName("bands").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["entity_id"], r["pass"]): r["band"] for r in spark.table("bands").collect()}
    assert got == {("a", 1): "leader", ("a", 2): "candidate", ("a", 3): "candidate", ("b", 1): "unverified", ("b", 2): "unverified", ("b", 3): "candidate"}


def test_accumulate_stream(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    for ids in ([1, 2, 2], [2, 3]):
        streaming.accumulate_stream(spark.createDataFrame([(i,) for i in ids], "k long"), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_kappa_edges(spark):
    k = lambda rows: evaluate.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"]
    assert k([]) == 0.0 and k([("x", "x")]) == 1.0 and k([("x", "y")]) == 0.0
    assert k([("l", "l"), ("u", "u"), ("c", "o"), ("u", "u")]) == pytest.approx(0.6364, abs=1e-4)


def test_recrawl_boundaries(spark):
    now = datetime(2026, 9, 24, 12)
    rows = [(False, datetime(2026, 8, 25, 12)), (False, datetime(2026, 8, 25, 11)), (False, datetime(2027, 1, 1)), (False, None), (True, now)]
    d = spark.createDataFrame(rows, "dead boolean, newest timestamp_ntz")
    p = x.recrawl_plan(F.col("dead"), F.col("newest"), F.lit("2026-09-24 12:00:00").cast("timestamp_ntz"))
    assert [r[0] for r in d.select(p["tier"]).collect()] == ["active", "stable", "active", "stable", "dead"]


def test_request_and_bucket():
    replies = [requests.Response(429, {"Retry-After": "2"}), requests.Response(403, {"X-RateLimit-Reset": "15"}), requests.Response(200, {}, {"items": [1]})]
    waits, c = [], requests.Counters()
    r = requests.request(lambda *a, **k: replies.pop(0), "u", {}, {}, c, sleep=waits.append, now=lambda: 10.0)
    assert r.json() == {"items": [1]} and waits == [2.0, 5.0] and (c.search_calls, c.rest_calls, c.hits_403_429) == (3, 0, 2)
    t = [0.0]
    b = requests.TokenBucket(2, clock=lambda: t[0])
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    t[0] = 30.0
    assert b.take() and not b.take()


def test_wait_is_that_of_the_last_header_with_a_number():
    assert requests.asked_wait({"Retry-After": "7", "X-RateLimit-Reset": "12"}, 10.0) == 2.0
    assert requests.asked_wait({"x-ratelimit-reset": "12", "RETRY-AFTER": "7"}, 10.0) == 7.0
    assert requests.asked_wait({"Retry-After": "soon", "x-ratelimit-reset": "3"}, 10.0) == 0.0


def test_paced_transport():
    asked, t = [], [0.0]

    def opener(url, headers):
        asked.append(url)
        if "bad" in url:
            raise OSError("no route")
        return 200, {}, b"no json" if "text" in url else b'{"items": [1]}'

    def sleep(s):
        t[0] += s

    p = requests.Paced(opener, "https://forum.test/search", sleep, lambda: t[0])
    assert p("topic one").json() == {"items": [1]} and asked == ["https://forum.test/search?query=topic+one"]
    p("https://api.github.com/search/x", params={"q": "a b"})
    assert p("https://api.github.com/repos/text?p=1", params={"q": 2}).json() == {} and t[0] == 1.2
    assert asked[1:] == ["https://api.github.com/search/x?q=a+b", "https://api.github.com/repos/text?p=1&q=2"]
    assert p("https://bad.test/").status == 599 and len(p.notes) == 1


def test_token_bucket_fold(spark):
    d = spark.createDataFrame([("u", 0.0, 1), ("u", 1.0, 2), ("u", 2.0, 3), ("u", 31.0, 4), ("v", 0.0, 5)], "k string, at double, id long")
    got = {r.id: r.granted for r in streaming.token_bucket(d, "k", "at", "id", 2.0).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_hit_source(spark, tmp_path):
    (tmp_path / "code.jsonl").write_text('{"query": "q", "items": [{"id": 1, "html_url": "h", "body": "abcdef", "stars": 5, "comments": ["x", "y"]}, {"id": 2, "stars": 1}]}\n')
    (tmp_path / "forum.jsonl").write_text('{"query": "q", "items": [{"objectID": "9", "title": "t", "points": 7}]}\n')
    spark.dataSource.register(hits.HitSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    d = spark.read.format("tally_hits").option("path", str(tmp_path)).option("max_chars", "3").option("max_comments", "1").load()
    got = {(r.connector, r.id): (r.body, list(r.comments), r.truncated) for r in d.where("count >= 5").collect()}
    assert got == {("code", "1"): ("abc", ["x"], 2), ("forum", "9"): ("t", [], 0)}
    assert hits.search_params("citation", "q", 3, "2020-01-01") == {"search": "q", "filter": "cited_by_count:>3,from_publication_date:2020-01-01"}
    assert hits.search_params("forum", "q", 3)["numericFilters"] == "points>=3"


def test_signals_and_snippets(spark):
    cols = "entity_id string, seq long, kind string, title string, body string, comments array<string>, comment_text string, abstract string, stars long, points long, cited_by_count long, product_mentions long, pushed_at string, created_at string, created_at_i long, publication_date string, last_change string"
    rows = [
        ("e", 1, "code", "t", "b", ["c1", ""], None, None, 5, None, None, None, "2026-09-01T00:00:00Z", None, None, None, None),
        ("e", 2, "forum_issue", "ft", None, None, "", None, None, 9, None, None, None, None, 1756684800, None, None),
        ("e", 3, "citation", "ct", None, None, None, "abs", None, None, 4, None, None, None, None, "nonsense", None),
    ]
    d = spark.createDataFrame(rows, cols)
    assert [(r.seq, r.pos, r.text) for r in records.snippets_of(d).orderBy("seq", "pos").collect()] == [(1, 0, "c1"), (1, 1, "b"), (2, 0, "ft"), (3, 0, "abs")]
    s = {r.seq: (r.primary_count, r.dt_months) for r in records.build_signals(d, F.lit("2026-09-24 12:00:00").cast("timestamp_ntz")).collect()}
    assert s[1] == (5.0, 0.77) and s[3] == (4.0, 36.0) and s[2][0] == 9.0
