"""Substring, paragraph and embedding deduplication against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from tallymark.llm import common, embedding_dedup, paragraph_dedup, substring_dedup
from tests.llm.test_documents import SCHEMA, corpus, roots


def texts():
    r = random.Random(11)
    rows = [(i, t) for i, t, *_ in corpus()]
    passage = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 99)) for _ in range(40))
    rows += [(5000 + k, f"start {k} {r.random()} " + passage[r.randint(0, 60) :] + f" end {r.random()}") for k in range(12)]
    rows += [(6000, "z" * 700), (6001, "ab" * 160), (6002, "q" + "ab" * 90), (6003, "é" * 120), (6004, "x" * 99), (6005, "x" * 100), (6006, "x" * 101)]
    rows += [(7000, "\n".join([passage, "other line here now ok", passage])), (7001, passage + " x"), (7002, "other line here now ok")]
    return rows


@pytest.mark.parametrize("hot", [2048, 1])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = texts()
    seen, want = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        want[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.substring_dedup(d).collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert len(got) == len(want)


def removed(spark, rows):
    """Rows in the order of doc_id and text hash with what goes of each, from a plain pass."""
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) h")
    seen, out = set(), []
    for r in sorted(d.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        raw = r.text.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            gone[p : p + 100] |= raw[p : p + 100] in seen
            seen.add(raw[p : p + 100])
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((str(r.doc_id), len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def noise(r, n):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_substring_dedup_repeated_and_null_ids(spark):
    r = random.Random(5)
    passage = noise(r, 180)
    rows = [(1, passage[:120])] * 3 + [(2, noise(r, 150))] * 2 + [(2, noise(r, 300)), (-(1 << 63), noise(r, 130))]
    rows += [(None, noise(r, k) + passage + noise(r, 40)) for k in (400, 0, 30)] + [(None, noise(r, 105))] * 2 + [(None, "short")] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.substring_dedup(d).collect())
    assert got == removed(spark, rows)


@pytest.mark.parametrize("hot", [50, 199, 200])
def test_substring_dedup_gram_over_several_ranges(spark, monkeypatch, hot):
    """200 contexts of one gram, which equals every splitter: about 50 in each of 4 ranges."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    r = random.Random(6)
    grams = [noise(r, 32) for _ in range(5000)]
    raw, at = np.frombuffer("".join(grams).encode(), np.uint8), np.arange(5000) * 32
    gram = grams[int(np.argmin(substring_dedup.mix(substring_dedup.span_hashes(raw, at, at + 32))))]
    blocks = [noise(r, 34) + gram + noise(r, 34) for _ in range(10)]
    rows = [(i, noise(r, 15) + blocks[i % 10] + noise(r, 15)) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substring_dedup.substring_dedup(d).collect())
    assert got == removed(spark, rows)


def test_windows_of_one_hash_are_told_apart_by_their_bytes():
    raw = np.frombuffer(b"aaaabbbbaaaacccc", np.uint8)
    start = np.array([0, 4, 8, 12])
    name = substring_dedup._told_apart(np.array([7, 7, 7, 9], np.uint64), raw, start, 4)
    assert name[0] == name[2] and len({int(x) for x in name}) == 3 and name[3] == 9
    assert substring_dedup._told_apart(np.array([7, 8, 7, 9], np.uint64), raw, start, 4).tolist() == [7, 8, 7, 9]


def test_multikey_order():
    g = np.random.default_rng(0)
    keys = [g.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order = substring_dedup.multikey_order(*keys)
    rows = list(zip(*[k[order].tolist() for k in keys]))
    assert rows == sorted(rows)


def test_substring_numbers_rows_only_where_doc_ids_do_not(spark, tmp_path):
    """With doc_ids of their own texts are not sorted, neither at first nor in the joins; negative ones come first."""
    part = "".join(chr(97 + k * k % 23) for k in range(120))
    rows = [(5, part + "x"), (-3, "y" + part), (1 << 40, part)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert {r.doc_id: r.n_removed for r in out.collect()} == {-3: 0, 5: 120, 1 << 40: 120}


def test_shuffle_files_of_a_long_step_go(spark, monkeypatch):
    """What a written step has shuffled is off the disk soon after it, not when the driver happens to collect garbage."""
    monkeypatch.setattr(common, "LONG_STEP", -1)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    scratch = common.Scratch(spark)
    before = tracker.shuffleStatuses().size()
    for _ in range(3):
        scratch.save(spark.range(1000).repartition(4, "id"))
    for _ in range(100):
        if tracker.shuffleStatuses().size() < before + 3:
            break
        time.sleep(0.1)
    assert tracker.shuffleStatuses().size() < before + 3


def test_substring_empty(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def paragraph_rows():
    """The fixture rows, and passages of 50 words and more inside other words, of lines, with changes, and in repeated rows."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8)))
    passages = [[word() for _ in range(n)] for n in (50, 51, 60, 90)]
    rows = texts()
    for k in range(24):
        p = list(passages[k % 4])
        if k % 6 == 5:
            p[3] = p[3] + "x"
        rows.append((9000 + k, " ".join([word() for _ in range(r.randint(0, 40))] + p) + "\n" * (k % 3 == 0) + " " + " ".join(word() for _ in range(r.randint(0, 40)))))
    rows += [(9500, rows[-1][1]), (9500, rows[-1][1]), (None, rows[-2][1]), (None, " ".join(passages[3]).upper()), (9500, " ".join(word() for _ in range(70)))]
    clean = [(9600 + k, " ".join(word() for _ in range(120)) + "\nsame short line of nine words in every text\nOf.") for k in range(10)]
    return rows + clean, passages


def test_paragraph_dedup(spark):
    rows, _ = paragraph_rows()
    h = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    keys = sorted({((i is not None, i or 0), h[t or ""], t or "") for i, t in rows})
    para = []
    for key, hash_, t in keys:
        p = paragraph_dedup.Paragraphs(paragraph_dedup.pa.array([t]))
        words = t.encode().lower().split() if t.isascii() else [w.lower() for w in paragraph_dedup.text_bytes(paragraph_dedup.pa.array([t]))[0].tobytes().split()]
        for pos in p.pos.tolist():
            w = words[pos : pos + 24]
            assert len(w) == 24
            para.append((key, hash_, t, pos, frozenset(tuple(w[k : k + 5]) for k in range(20)), w[:2]))
    links = [(a, b) for a in range(len(para)) for b in range(a) if para[a][5] == para[b][5] and 100 * len(para[a][4] & para[b][4]) >= 80 * len(para[a][4] | para[b][4])]
    comp, gone = roots(range(len(para)), links), {}
    for k, c in comp.items():
        if para[k][:3] != para[c][:3] or para[k][3] - para[c][3] >= 24:
            gone.setdefault(para[k][:3], set()).add(para[k][3])
    assert len(links) > 100 and any(0 < len(para[a][4] & para[b][4]) < 20 for a, b in links)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = paragraph_dedup.paragraph_dedup(d).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        t = t or ""
        out = gone.get(((i is not None, i or 0), h[t], t), set())
        spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
        kept, upto = b"", 0
        off = {w for x in out for w in range(x, x + 24)}
        for w, (s, _) in enumerate(spans):
            if w in off and w - 1 not in off:
                kept += t.encode()[upto:s]
            if w in off:
                upto = spans[w + 1][0] if w + 1 < len(spans) else spans[w][1]
        want.setdefault((i, hashlib.sha256(kept + t.encode()[upto:]).hexdigest(), len(out), len(off)), []).append(1)
    have = {}
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        have.setdefault((r.doc_id, r.kept_sha256, r.n_removed, r.n_words_removed), []).append(1)
    # Bands may miss a pair near the threshold; none of these does.
    assert have == want
    assert paragraph_dedup.paragraph_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_paragraphs_catch_passages_and_leave_clean_texts(spark):
    """Every text but the first with a passage of 50 words loses some of it; short common lines cost nothing."""
    rows, passages = paragraph_rows()
    d = spark.createDataFrame([x for x in rows if x[0] and x[0] >= 9000], "doc_id long, text string")
    got = {r.doc_id: r for r in paragraph_dedup.paragraph_dedup(d).collect() if r.doc_id != 9500}
    assert all(got[9000 + k].n_removed > 0 for k in range(6, 24) if k % 6 != 5)
    assert all(got[9000 + k].n_removed == 0 for k in range(4)) and all(got[9600 + k].n_removed == 0 for k in range(10))


def test_minhash_bands_meet_near_the_threshold():
    """Pairs of one anchor and 18 of 22 shingles in common (.818) share a band as often as the formula says."""
    r = random.Random(3)
    hit = 0
    for k in range(400):
        words = [f"w{r.random()}" for _ in range(24)]
        other = words[:-2] + [f"v{r.random()}", f"u{r.random()}"]
        a, b = (paragraph_dedup.Paragraphs(paragraph_dedup.pa.array([" ".join(x)])) for x in (words, other))
        hit += bool(set(a.bands()[1].tolist()) & set(b.bands()[1].tolist()))
    assert hit >= 0.98 * 400


def test_bands_meet_for_every_pair_at_the_threshold():
    """Other first words, moved stretches, repeated words, few shingles: all pairs at the threshold share a band, few others do."""
    r = random.Random(8)
    made = []
    for k in range(60):
        w = [f"w{r.randrange(10**9 if k % 3 else 4)}" for _ in range(27)]
        if k % 5 == 0:
            w[18:] = w[:9]
        made += [w[:24], w[1:25], w[2:26], ["x"] + w[1:24], ["x", "y"] + w[2:24], w[:22] + ["x", "y"], ["x"] + w[1:23] + ["y"], w[3:27]]
    made += [[c] * 24 for c in "ab"] + [list("abcde" * 5)[:24], list("abcdef" * 4), list("fabcde" * 4), list("abcdefg" * 4)[:24]]
    p = paragraph_dedup.Paragraphs(paragraph_dedup.pa.array([" ".join(w) for w in made]))
    assert len(p.at) == len(made)
    own, sig = p.bands(same_anchor=False)
    have = [set() for _ in made]
    for k, v in zip(own.tolist(), sig.tolist()):
        have[k].add(v)
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(20)) for w in made]
    near, other = 0, 0
    for a in range(len(made)):
        for b in range(a):
            if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near += 1
                assert have[a] & have[b]
            elif not sets[a] & sets[b]:
                other += bool(have[a] & have[b])
    assert near > 500 and other < 100


def test_paragraphs_of_few_shingles_do_not_meet_in_empty_ranges():
    """Cycles of few words have few shingles and most ranges empty: those without a shingle in common share no band, similar ones do."""
    made = [[f"w{k}.{i % n}" for i in range(24)] for n in (1, 2, 3, 4, 5, 6) for k in range(60 * n, 60 * n + 60)]
    made += [(w[:n] * 5)[:20] + w[:3] + ["x"] for n in (4, 5, 6) for w in made if len(set(w)) == n]
    p = paragraph_dedup.Paragraphs(paragraph_dedup.pa.array([" ".join(w) for w in made]))
    own, sig = p.bands(same_anchor=False)
    have = [set(sig[own == k].tolist()) for k in range(len(made))]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(20)) for w in made]
    near = 0
    for a in range(len(made)):
        for b in range(a):
            if not sets[a] & sets[b]:
                assert not have[a] & have[b]
            elif sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                near += 1
                assert have[a] & have[b]
    assert near >= 60


def test_paragraphs_of_other_anchors_link(spark):
    """A passage again with other first words at each of its paragraphs."""
    r = random.Random(5)
    w = [f"w{r.randrange(10**9)}" for _ in range(24)]
    d = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(["other", "two", *w[2:]])), (3, " ".join(["much", "more", "else", *w[3:]]))], "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in paragraph_dedup.paragraph_dedup(d, same_anchor=False).collect()} == {1: 0, 2: 1, 3: 0}


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SIZE", 16)
    g = np.random.default_rng(4)
    base = g.standard_normal((150, 16))
    near = [base[k % 10] + g.standard_normal(16) * s for k in range(120) for s in (0.05, 0.3)]
    vecs = [*base, *near, base[3], base[3], base[5] * 2]
    rows = [(i * 7, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vecs)]
    short = [(20000 + k, [1.0, 2.0 + k * 0.01, 0.5], 1) for k in range(4)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [None] + [1.0] * 15, 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] * 16, 1), (9006, [], 1)]
    d = spark.createDataFrame(rows + odd + short, "vec_id long, embedding array<float>, label int")
    u = np.array([v for _, v, _ in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    m = u @ u.T >= 0.9
    np.fill_diagonal(m, False)
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(d).collect()}
    assert len(got) == len(rows) + len(odd) + len(short)
    assert all((got[i].n_links, got[i].component_id) == (3, 20000) for i, *_ in short)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd)
    found = sum(got[i * 7].n_links for i in range(len(vecs)))
    assert found <= m.sum() and found >= 0.95 * m.sum()
    comp = roots(range(len(vecs)), [(int(a), int(b)) for a, b in zip(*np.nonzero(m)) if a > b])
    same = sum(got[i * 7].component_id == comp[i] * 7 for i in comp)
    assert same >= 0.9 * len(comp)
    assert embedding_dedup.embedding_dedup(d.limit(0)).count() == 0


def test_substring_writes_no_copy_of_the_texts(spark, monkeypatch):
    """Texts are read again where they lie as long as doc_ids name the rows."""
    saved, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df: (saved.append(df.columns), save(self, df))[1])
    t = noise(random.Random(8), 150)
    out = substring_dedup.substring_dedup(spark.createDataFrame([(1, t), (2, "x" + t)], "doc_id long, text string"))
    assert sum(r.n_removed for r in out.collect()) == 150
    assert saved and not any("text" in c for c in saved)
