"""Names in texts, and in the text that texts make together, against plain search."""

import random

import pyarrow as pa

from tallymark.operators import patterns, snapshot
from tallymark.operators.patterns import find_names, joined_blocks


def made(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randint(0, 9)))
    texts = [word() * r.randint(1, 4) for _ in range(120)] + ["", None, "x" * 5000 + "needle"]
    names = sorted({word()[: r.randint(1, 9)] for _ in range(300)} | {"", "z", "needle", "abcdefgh", "é", "a b"})
    return texts, names


def test_names_in_texts(spark):
    texts, names = made()
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    n = spark.createDataFrame([(x,) for x in [*names, names[3], None]], "name string")
    got = sorted(map(tuple, find_names(t, n).collect()))
    assert got == sorted((i, x) for i, s in enumerate(texts) for x in names if x and s and x in s)
    assert find_names(t.limit(0), n).count() == 0 and find_names(t, n.limit(0)).count() == 0


def test_blocks_of_joined_texts(spark):
    texts, _ = made()
    whole = " ".join(t or "" for t in texts) + " "
    t = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(4)
    for longest, block in ((7, 10), (50, 16), (1, 1024), (0, 8)):
        b = sorted(map(tuple, joined_blocks(t, ["seq"], "text", longest, block).collect()))
        size = max(longest, block)
        assert b == [(k, whole[k * size : (k + 1) * size + max(longest - 1, 0)]) for k in range(-(-len(whole) // size))]


def test_mentions_across_titles(spark):
    titles = spark.createDataFrame([(2, "Beta"), (1, "the Alpha"), (3, None), (4, "end")], "seq long, title string")
    frozen = spark.createDataFrame([(1, "e1", "ALPHA beta"), (2, "e2", "beta alpha"), (3, "the", ""), (4, None, "beta  end"), (5, "", "Gone"), (6, "e1", "none")], "o int, entity_id string, name string")
    got = {r.key: r.woken for r in snapshot.mentions(frozen, titles, ["seq"], order="o").collect()}
    assert got == {"e1": False, "ALPHA beta": True, "e2": False, "beta alpha": False, "the": True, "beta  end": True, "Gone": False, "none": False}
    assert snapshot.mentions(frozen.limit(0), titles, ["seq"]).count() == 0


def test_texts_are_read_once_for_names(spark):
    """Names are found where the texts lie: no text is shuffled or joined, though common pieces are everywhere."""
    t = spark.createDataFrame([(k, "the same common words " + "é" * (k % 9) + f" rare{k}") for k in range(500)], "id long, text string").repartition(3)
    n = spark.createDataFrame([("common words é",), ("rare77",), ("words   ",), ("e" * 30,), ("rare499",)], "name string")
    found = find_names(t, n, ids=False)
    assert sorted(r.name for r in found.collect()) == ["common words é", "rare499", "rare77"]
    assert "text" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert sorted(r.id for r in find_names(t, n).where("name = 'common words é'").collect()) == [k for k in range(500) if k % 9]


def test_names_in_joined_texts(spark):
    """Names within, over and at the ends of texts, with every character that may stand for what is left out but one, or with all."""
    texts, names = made(3)
    texts += ["éa" * 3000 + "within" + "b" * 3000 + "last", "first" + "c" * 4000, None, "", "last"]
    whole = " ".join(t or "" for t in texts) + " "
    names += ["within", "last first", "c   last", "éé", "needle é", "".join(patterns.GAPS[1:]), "b" + patterns.GAPS[0] + "l"]
    t = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").repartition(4)
    for some in (names[:-1], names, [" "], []):
        n = spark.createDataFrame([(x,) for x in [*some, *some[:1], None]], "name string")
        got = sorted(r.name for r in patterns.find_in_joined(t, ["seq"], "text", n).collect())
        assert got == sorted({x for x in some if x and x in whole})


def test_only_ends_of_texts_are_joined(spark, monkeypatch):
    """Of long titles no more is shuffled than what a name may share with the next ones."""
    sent = []
    monkeypatch.setattr(patterns, "joined_blocks", lambda texts, *a: sent.append(texts) or joined_blocks(texts, *a))
    titles = spark.createDataFrame([(k, f"Abc{k} " + "filler " * 900 + f"xyz{k}") for k in range(20)], "seq long, title string")
    frozen = spark.createDataFrame([(1, "XYZ3 abc4", "xyz3 abc5"), (2, "filler xyz7", "abc7 xyz7")], "o int, entity_id string, name string")
    got = {r.key: r.woken for r in snapshot.mentions(frozen, titles, ["seq"], order="o").collect()}
    assert got == {"XYZ3 abc4": True, "xyz3 abc5": True, "filler xyz7": True, "abc7 xyz7": True}
    assert [len(r.text) for r in sent[0].collect()] == [2 * (len("filler xyz7") - 1) + 1] * 20


def test_stretches_that_are_no_names_stay_few(spark):
    """With many names of a common beginning hardly anything else is given, and what was given is not given again."""
    n = spark.range(0, 2_000_000, 10).selectExpr("concat('the same ', lpad(id, 7, '0')) AS name")
    find = patterns._finder(n)[3]()
    batch = pa.record_batch({"text": [f"the same {k:07d}" for k in range(20_000)]})
    once, again = (sum(b.num_rows for b in find([batch], False)) for _ in range(2))
    assert 2000 <= once < 2200 and again < 20
