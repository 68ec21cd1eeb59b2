"""Lookups and counts whose texts stay where they are read."""

from tallymark.operators import text


def test_texts_are_looked_up_by_hash(spark):
    s = spark.createDataFrame([(1, "s1", "> said\n a  b ", "a b"), (2, "s2", "a b", "a b"), (3, "s3", None, "")], "seq long, sid string, raw string, stripped string")
    index = text.sid_index(s)
    assert "text" not in index.columns
    q = spark.createDataFrame([(1, "a b"), (2, "  a   b\n"), (3, "> said\n a  b "), (4, None), (5, "none")], "k int, quote string")
    found = text.lookup_sid(q, index)
    assert found.columns == ["k", "quote", "sid"]
    assert {r.k: r.sid for r in found.collect()} == {1: "s1", 2: "s1", 3: "s1", 4: "s3", 5: None}


def test_titles_of_one_entity_are_dealt_out(spark):
    """All titles are of one entity, and no task has more than a small share of them."""
    hits = spark.range(2000).selectExpr("'e' as entity_id", "concat('some tool w', id % 10, ' of ', id) as title")
    e = spark.createDataFrame([("e", "tool", "plausible")], "entity_id string, name string, scope string")
    out = text.competitors(hits, e)
    assert {r.competitor: r.n for r in out.where("competitor like 'w%'").collect()} == {f"w{k}": 200 for k in range(10)}
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
