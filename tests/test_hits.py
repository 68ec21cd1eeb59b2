"""Recorded replies: splits by bytes, merged filters, streams over growing files."""

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, Not

from tallymark.sources import hits


def record(folder, name, replies, end="\n"):
    folder.mkdir(parents=True, exist_ok=True)
    with open(folder / name, "a") as f:
        f.write("\n".join(json.dumps(r) for r in replies) + end)


def replies(n, start=0):
    return [{"query": f"q{k % 3}", "items": [{"id": k * 10 + i, "html_url": f"u{k}", "body": "é" * (k % 7), "stars": k} for i in range(k % 4)]} for k in range(start, start + n)]


def reader(folder, **options):
    return hits.HitFilterReader({"path": str(folder), **options})


def rows(r):
    return [tuple(tuple(v) if isinstance(v, list) else v for v in row.values()) for p in r.partitions() for b in r.read(p) for row in b.to_pylist()]


def test_splits_lose_and_repeat_no_line(tmp_path):
    record(tmp_path, "code.jsonl", replies(40))
    record(tmp_path / "connector=code", "part-0.txt", replies(5, 40), end="")
    (tmp_path / "_notes.jsonl").write_text("no recording")
    (tmp_path / "connector=code" / ".part-0.txt.crc").write_text("x")
    whole = rows(reader(tmp_path))
    assert len(whole) == sum(k % 4 for k in range(45)) and len(set(whole)) == len(whole)
    for size in (1, 7, 64, 100, 1000):
        assert rows(reader(tmp_path, split_bytes=str(size))) == whole
    by_file = {}
    for r in whole:
        by_file.setdefault(r[-1], []).append(r[2])
    assert len(by_file) == 2 and all(s == sorted(set(s)) for s in by_file.values())
    assert rows(reader(tmp_path / "nothing")) == [] and rows(reader(tmp_path, connector="forum")) == []
    (tmp_path / "forum.jsonl").write_text("{broken\n")
    with pytest.raises(ValueError, match="byte 0"):
        rows(reader(tmp_path, connector="forum"))


def test_filters_add_up(tmp_path):
    record(tmp_path, "code.jsonl", replies(40))
    whole = rows(reader(tmp_path))

    def left(*filters):
        r = reader(tmp_path)
        back = list(r.pushFilters(list(filters)))
        return back, rows(r)

    count, query = ("count",), ("query",)
    for pair in ([GreaterThan(count, 5), GreaterThanOrEqual(count, 3)], [GreaterThanOrEqual(count, 3), GreaterThan(count, 5)]):
        assert left(*pair) == ([], [r for r in whole if r[7] > 5])
    assert left(EqualTo(query, "q0"), EqualTo(query, "q1")) == ([], [])
    assert left(In(query, ("q0", "q1")), EqualTo(query, "q1")) == ([], [r for r in whole if r[1] == "q1"])
    assert left(EqualTo(("connector",), "forum")) == ([], [])
    less = LessThan(count, 9)
    assert left(less, GreaterThan(count, 5)) == ([less], [r for r in whole if r[7] > 5])


def test_filters_of_filters_go_back_to_spark(tmp_path):
    record(tmp_path, "code.jsonl", replies(8))
    other = Not(EqualTo(("query",), "q1"))
    r = reader(tmp_path)
    assert list(r.pushFilters([other, GreaterThan(("count",), 5)])) == [other]
    assert {row[7] for row in rows(r)} == {6, 7}


def test_filters_through_spark(spark, tmp_path):
    record(tmp_path, "code.jsonl", replies(40))
    want = sorted(r[3] for r in rows(reader(tmp_path)) if 5 < r[7] < 30 and r[1] == "q1")
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            d = hits.load(spark, str(tmp_path), split_bytes=500)
            got = d.where("count > 5 and count >= 3 and count < 30 and query = 'q1' and query in ('q0', 'q1')")
            assert sorted(r.id for r in got.collect()) == want and want
            assert d.where("query = 'q0' and query = 'q1'").count() == 0
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_filters_of_one_part_do_not_hold_for_another(spark, tmp_path):
    record(tmp_path, "code.jsonl", replies(40))
    want = {r[3]: r for r in rows(reader(tmp_path))}
    old = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for on in ("true", "false"):
            spark.conf.set("spark.sql.python.filterPushdown.enabled", on)
            d = hits.load(spark, str(tmp_path))
            assert sorted(r.id for r in d.unionByName(d.where("count > 5 and query = 'q1'")).collect()) == sorted([*want, *(i for i, r in want.items() if r[7] > 5 and r[1] == "q1")])
            asked = hits.load(spark, str(tmp_path), pushdown=True).where("count > 5 and query = 'q1'")
            assert sorted(r.id for r in asked.collect()) == sorted(i for i, r in want.items() if r[7] > 5 and r[1] == "q1")
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", old)


def test_stream_goes_on_from_its_offsets(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    spark.dataSource.register(hits.HitSource)

    def run_pass():
        d = spark.readStream.format("tally_hits").option("path", str(folder)).option("split_bytes", "300").load()
        q = d.select("id", "seq", "file").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.id, r.seq) for r in spark.read.parquet(out).collect())

    record(folder, "code-1.jsonl", replies(20))
    with open(folder / "code-1.jsonl", "a") as f:
        f.write('{"query": "q", "items": [{"id": "half"')  # still being written
    first = run_pass()
    assert len(first) == sum(k % 4 for k in range(20)) and run_pass() == first
    with open(folder / "code-1.jsonl", "a") as f:
        f.write("}]}\n")
    record(folder, "code-2.jsonl", replies(5, 20))
    assert sorted(i for i, _ in run_pass()) == sorted(r[3] for r in rows(reader(folder)))
    s = hits.HitStream({"path": str(folder)})
    with pytest.raises(ValueError, match="only grow"):
        s.partitions({str(folder / "gone.jsonl"): 5}, s.latestOffset())
