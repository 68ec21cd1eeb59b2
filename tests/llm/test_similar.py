"""Groups parted by sketches, and blocks that give back links, not pairs."""

import numpy as np
import pyarrow as pa

from tallymark.llm import similar
from tests.llm.test_documents import roots


def test_sketches_part_a_group_and_lose_no_near_pair(monkeypatch):
    """2,000 members of one signature, some of them near each other: few stars, and near members share one."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, (1900, 20)).astype(np.uint64)
    # Near copies differ in two elements on each side.
    near = base[:100].copy()
    near[:, :2] = r.integers(0, 1 << 62, (100, 2)).astype(np.uint64)
    g = np.concatenate([base, near])
    off = np.arange(len(g) + 1) * 20
    key = np.sort(similar.sketched(np.full(len(g), 7 << 40, np.uint64), g.ravel(), off, np.arange(len(g)), 4))
    order = np.argsort(similar.sketched(np.full(len(g), 7 << 40, np.uint64), g.ravel(), off, np.arange(len(g)), 4), kind="stable")
    for wide in (256, 1 << 30):
        monkeypatch.setattr(similar, "WIDE", wide)
        stars = similar.near_stars(key, order)
        of = {}
        for a, b in stars.tolist():
            of.setdefault(b, {b}).add(a)
            of.setdefault(a, {a})
        assert all(of[k] & of[1900 + k] for k in range(100))
        assert len(set(map(tuple, stars.tolist()))) < 1000
    monkeypatch.setattr(similar, "MOST_TRIES", 0)
    monkeypatch.setattr(similar, "WIDE", 1 << 30)
    assert len(similar.near_stars(key, order)) == len(g) - 1


def test_blocks_give_back_no_more_links_than_join_them():
    """Near copies in families: links make the components of all pairs, but are fewer than the members."""
    r = np.random.default_rng(5)
    sets = []
    for _ in range(4):
        base = r.integers(0, 1 << 62, 100).astype(np.uint64)
        for _ in range(30):
            x = base.copy()
            x[r.choice(100, 3, replace=False)] = r.integers(0, 1 << 62, 3).astype(np.uint64)
            sets.append(np.sort(x))
    m = len(sets)
    links = [(i, j) for i in range(m) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    no = pa.array([False] * m)
    t = pa.table({"a": pa.array([0] * m), "b": pa.array(range(m)), "near": no, "mid": no, "label": pa.array(range(m)), "own": pa.array([0] * m, pa.int32()), "i": pa.array([0] * m, pa.int32()), "j": pa.array([0] * m, pa.int32()), "n": pa.array([100] * m), "elements": pa.array([x.tobytes() for x in sets])})
    got = similar._try_blocks(85)(t)
    found = list(zip(got.column("a").to_pylist(), got.column("b").to_pylist()))
    assert len(links) > m > len(found)
    assert {(a, b) for a, b in found} <= {(min(x), max(x)) for x in links}
    assert roots(range(m), found) == roots(range(m), links)


def test_only_members_that_may_have_a_partner_send_their_sets():
    """Sets of one leader, all pairs free: members of a similar pair are kept, nearly all others are not, however batches cut the blocks."""
    r = np.random.default_rng(6)
    sets = [np.sort(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in r.choice([4, 30, 33, 60, 66, 300, 2500], 400)]
    for k in range(0, 60, 2):
        x = sets[k].copy()
        x[: len(x) // 14] = r.integers(0, 1 << 62, len(x) // 14).astype(np.uint64)
        sets[k + 1] = np.sort(np.append(x, r.integers(0, 1 << 62, len(x) // 40).astype(np.uint64)))
    n = np.array([len(x) for x in sets])
    sketch = similar.parities(np.concatenate(sets), n)
    assert all(8 * len(s) < 64 * x for s, x in zip(sketch, n) if x > 30)
    m = len(sets)
    a = np.repeat([0, 1, 2], [60, 3, m - 63])
    no = pa.array([False] * m)
    t = pa.record_batch({"a": pa.array(a), "b": pa.array(range(m)), "near": no, "mid": no, "label": pa.array(range(m)), "own": pa.array([0] * m, pa.int32()), "i": pa.array([0] * m, pa.int32()), "j": pa.array([0] * m, pa.int32()), "nb": pa.array(n), "sketch": pa.array(sketch, pa.binary())})
    for step in (7, 60, m):
        got = [x for b in similar._may_link((t.slice(k, step) for k in range(0, m, step)), 85) for x in b.column("b").to_pylist()]
        assert len(got) == len(set(got)) and set(range(60)) <= set(got) and len(got) < 75
    two = pa.array([k % 2 for k in range(m)], pa.int32())
    t = t.set_column(5, "own", two).set_column(7, "j", pa.array([1] * m, pa.int32()))
    assert set(range(60)) <= {x for b in similar._may_link(iter([t]), 85) for x in b.column("b").to_pylist()}
