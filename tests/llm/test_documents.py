"""Operators on documents against plain versions on small fixtures."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallymark.llm import exact_dedup, jaccard_join, language_id, mixing, queries, sentencepiece_sampling, similar, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, raw string, `key` int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Copies, near copies, nulls, empties, a long text, ties, and columns whose names clash with inner ones."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 120))) for _ in range(60)]
    for k in range(40):
        w = texts[k % 5].split(" ")
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [texts[3]] * 7 + [None, None, "", "", "   \n", "a", "A", "a b c", "A b C", "x\x0by\tz w q", " ".join(words * 60)]
    texts += [texts[0].upper(), texts[0] + " ", "é" * 5000, "a" * 9000 + "b", "a" * 9000 + "c"]
    langs, sources = ["en", "de", None], ["b", "a", "ä", None, "zz"]
    rows = [(i * 3 % 1009, t, langs[i % 3], sources[0] if i % 3 else sources[i % 5], None, "x", "y", 1) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def roots(nodes, links):
    up = {x: x for x in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("block,bits", [(2048, 64), (7, 64), (16, 3)])
def test_exact_dedup(docs, block, bits):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    got = exact_dedup.exact_dedup(docs, block_bytes=block, hash_bits=bits).drop("text_hash").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(corpus())


def test_exact_dedup_edges(spark, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    d = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect())
    assert got == {(1, 1, 3, True): 2, (1, 1, 1, True): 1, (None, 1, 3, False): 1, (None, None, 1, True): 1}
    kept = exact_dedup.dedup_stage(d).collect()
    assert len([r for r in kept if r.doc_id is None]) == 1


def plain_sets(n=4):
    out = {}
    for i, t, *_ in corpus():
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        out[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("percent,chunk,block", [(85, 1 << 20, 1024), (85, 100, 3), (70, 100, 3)])
def test_jaccard_join(docs, monkeypatch, percent, chunk, block):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(similar, "BLOCK", block)
    s = plain_sets()
    ids = sorted(s)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])]
    comp = roots(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, percent=percent).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in ids}


def test_jaccard_empty(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_signatures_lose_no_link():
    """Random sets at and just above the threshold share a signature."""
    import numpy as np

    r = np.random.default_rng(3)
    for size in (6, 7, 13, 20, 39, 40, 55, 100, 140, 300):
        for _ in range(40):
            a = r.integers(0, 1 << 62, size).astype(np.uint64)
            # |A & B| / |A | B| >= .85 with the fewest elements in common
            d = next(d for d in range(size, -1, -1) if 100 * (size - d) >= 85 * (size + d))
            x = r.integers(0, d + 1)
            y = 0
            while 100 * (size - x) >= 85 * (size + y + 1):
                y += 1
            b = np.concatenate([a[x:], r.integers(0, 1 << 62, y).astype(np.uint64)])
            if x == y == 0:
                continue
            g = np.concatenate([np.sort(a), np.sort(b)])
            sets, sigs = jaccard_join.signatures(g, np.array([0, len(a), len(a) + len(b)]))
            assert set(sigs[sets == 0]) & set(sigs[sets == 1])


def plain_mix():
    rows = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s, *_ in corpus()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(size.values()) * 1.5, {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in full}
        open_ -= full
    return rows, size, target


def test_mixing(docs):
    rows, size, target = plain_mix()
    got = {r.doc_id: r for r in mixing.mix_digest(docs).collect()}
    assert len(got) == len(rows)
    taken = Counter()
    for i, s, n in rows:
        g = got[i]
        assert (g["size"], g.source_size) == (n, size[s]) and abs(g.target - target[s]) < 1e-5
        assert 0 <= g.taken <= 2 * n
        taken[s] += g.taken
    assert all(taken[s] == int(target[s] + 1e-9) for s in size)
    again = {r.doc_id: r for r in mixing.mix_digest(docs.repartition(3)).collect()}
    assert got == again


def test_mixing_agrees_on_rows_without_ids_in_any_order(spark):
    rows = [(None, "one", "a"), (None, "one two three four five", "a"), (None, "x y z", "a"), (3, "a b c d e", "a"), (3, "q", "a"), (3, "q", "a"), (4, None, "b"), (None, None, "b"), (None, "w w", None)]
    made = lambda r: sorted(map(repr, mixing.mix_digest(spark.createDataFrame(r, "doc_id long, text string, source string").coalesce(1)).collect()))
    want = made(rows)
    for seed in range(3):
        assert made(random.Random(seed).sample(rows, len(rows))) == want
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    names = list(mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).columns)
    found = con.sql(queries.ORACLE_SQL["op3_mix_sources"])
    plain = [tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()]
    got = [tuple(r) for r in mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain))


def test_letters_of_words():
    text = "½ ² ① a½b x²y Straße été_o 12ab IV Ⅳ 漢字 q"
    assert language_id._words(text) == language_id._LETTERS.findall(text) == ["a", "b", "x", "y", "Straße", "été", "o", "ab", "IV", "漢字", "q"]


def test_mixing_positions(docs):
    """Positions follow the schedule: a fading source has more of its words in the first half."""
    m = mixing.plan_mix(docs).collect()
    first = sum(c.words for r in m if r.source == "a" for c in r.copies if c.position < 0.5)
    whole = sum(c.words for r in m if r.source == "a" for c in r.copies)
    assert 0.5 < first / whole < 0.75
    assert all(0 <= c.position <= 1 for r in m for c in r.copies)


def test_mixing_stage(docs, empty):
    out = mixing.mix_stage(docs)
    assert out.columns == docs.columns
    n = Counter(r.doc_id for r in out.collect())
    plan = {r.doc_id: sum(2 * c.words >= r["size"] for c in r.copies) for r in mixing.plan_mix(docs).collect()}
    assert n == Counter({k: v for k, v in plan.items() if v})
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix_stage(empty).count() == 0


def test_stages_keep_distinct_texts_of_shared_and_null_ids(spark):
    r = random.Random(9)
    rows = [(None if k % 2 else 7, " ".join(r.choice("abcdefghij") * 2 for _ in range(r.randint(5, 30))) + f" {k}", "s", k) for k in range(60)]
    rows += [(1, "single text", "s", 1), (None, rows[1][1], "s", 500), (7, rows[0][1], "s", 501)]
    best = {(i, t): n for i, t, _, n in sorted(rows, key=lambda x: x[3])}
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    kept = exact_dedup.dedup_stage(d)
    assert kept.columns == d.columns
    assert sorted((str(x.doc_id), x.text, x.n) for x in kept.collect()) == sorted((str(i), t, n) for (i, t), n in best.items())
    # One source has its target at one and a half epochs: every text comes once or twice
    out = mixing.mix_stage(d)
    assert out.columns == d.columns
    n = Counter((x.doc_id, x.text) for x in out.collect())
    assert set(n) == set(best) and set(n.values()) == {1, 2}
    assert {x.n for x in out.collect()} == set(best.values())
    assert n == Counter((x.doc_id, x.text) for x in mixing.mix_stage(d.repartition(3)).collect())


def test_language_id(spark, empty):
    r = random.Random(1)
    syll = {"en": ["the", "ing", "wh", "ed"], "de": ["sch", "ung", "über", "ein"], "fr": ["eau", "ment", "é", "que"]}
    rows = [(i, " ".join("".join(r.choice(syll[x]) for _ in range(r.randint(1, 4))) for _ in range(30)) + ".", x) for i in range(300) for x in [r.choice(list(syll))]]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "de"), (1003, "schungung", None), (1004, "½ ² ①", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", language_id.F.lit(5))
    got = {x.doc_id: x for x in language_id.language_id(d).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i, t, x in rows[:300] if got[i].held_out]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "de", "und"]
    assert all(0 <= x.score <= 1 for x in got.values())
    # lang, source and doc_id are no inputs: other values on a held-out row change nothing
    assert language_id.language_id(empty).count() == 0
    none = language_id.language_id(d.withColumn("lang", language_id.F.lit(None).cast("string"))).collect()
    assert {x.lang_pred for x in none} == {"und"}


def _plain_word(m, w):
    """Scores of a word, read one window at a time."""
    ids, scores = m.words
    if w in ids:
        return scores[:, ids[w]]
    p, out = f" {w} ", 0.0
    for end in range(2, len(p) + 1):
        i = next((m.grams[g] for n in range(min(language_id.LONGEST, end), 0, -1) if (g := p[end - n : end]) in m.grams), len(m.grams))
        out = out + m.scores[:, i] + m.steps[0, i] * language_id.BACKOFF
    return (out / (len(p) - 1)).astype(np.float32)


def _language_model(r):
    syll = {"en": ["the", "ing", "wh", "ed"], "de": ["sch", "ung", "über", "ein"], "el": ["ος", "και", "漢", "字"]}
    return language_id.Model([(" ".join("".join(r.choice(syll[x]) for _ in range(r.randint(1, 4))) for _ in range(30)), x) for x in sorted(syll) for _ in range(50)])


def test_language_of_texts_at_once_is_that_of_single_words(monkeypatch):
    r = random.Random(3)
    m = _language_model(r)
    texts = ["", " \n", "12 34 !!", "a", "Über,schung-ing 12ab½c²d x_y ΟΔΟΣ.ΟΣ", "漢字。字、かな漢字" * 50, "whed\u2028thing\x1cein\x85ung\u200bing", "\0a\0the", "the" * 5000, "Ⅳ İstanbul ﬁne"]
    texts += ["".join(r.choice("thewhinguübersc漢ος.,;½1 \t_'\u00a0\0") for _ in range(r.randint(1, 300))) for _ in range(300)]
    monkeypatch.setattr(language_id, "REMEMBERED", 150)
    tokens = language_id.Tokens(m)
    for k in range(0, len(texts), 7):
        some = texts[k : k + 7]
        got = tokens.sums([list(map(tokens.__getitem__, language_id._tokens(t))) for t in some])
        words = [language_id._LETTERS.findall(t.lower()) for t in some]
        assert got[-1].tolist() == list(map(len, words))
        want = [sum((_plain_word(m, w).astype(float) for w in ws), np.zeros(len(m.langs))) for ws in words]
        assert np.allclose(got[:-1].T, want, rtol=1e-6, atol=1e-6)


def test_unseen_words_are_not_read_one_gram_at_a_time():
    r = random.Random(4)
    m = _language_model(r)
    words = ["".join(r.choice(["the", "ing", "sch", "über", "ος", "qu", "x"]) for _ in range(4)) + str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(20_000)]
    began = time.process_time()
    want = np.array([_plain_word(m, w) for w in words]).T
    between = time.process_time()
    got = m.read(words, language_id.Windows(m.grams))
    assert time.process_time() - between < (between - began) / 3
    assert np.allclose(got, want, rtol=1e-6)


def test_language_sample_keeps_rare_languages(spark):
    rows = [(i, "t", "en" if i % 400 else "xx") for i in range(8000)]
    n = Counter(x for _, x in language_id.sample_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=40))
    assert n["xx"] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _, x in rows if x == "xx") and 130 < n["en"] < 270


def test_toxicity(spark, empty):
    r = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 9 == 0
        w = [r.choice(base) for _ in range(40)] + ([r.choice(["zork", "blag", "idiot"]) for _ in range(6)] if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad) if i % 50 else None))
    rows += [(2000, None), (2001, ""), (2001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", toxicity.F.lit(9))
    lab = spark.createDataFrame(labels + [(5, 1, 0)], "doc_id long, quality int, toxic int")
    got = [x for x in toxicity.toxicity(d, lab).collect()]
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
    assert all(by[i].predicted == int(i % 9 == 0) for i in range(900) if by[i].held_out)
    assert by[2000].predicted == 0 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    kept = toxicity.toxicity_stage(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(1 - x.predicted for x in got)
    assert toxicity.toxicity(empty, lab).count() == 0
    assert {x.predicted for x in toxicity.toxicity(d, lab.limit(0)).collect()} == {0}


def test_label_model_discounts_correlated_voters():
    import numpy as np

    g = np.random.default_rng(0)
    y = g.random(4000) < 0.3
    a, b = np.where(y, g.random(4000) < 0.8, g.random(4000) < 0.1), np.where(y, g.random(4000) < 0.8, g.random(4000) < 0.1)
    m = toxicity.LabelModel(np.stack([a, a, b], 1), y.astype(float))
    assert m.correlation[0, 1] > 0.9 > m.correlation[0, 2]
    assert m.share[0] < 0.6 < m.share[2]
    assert abs(m.on_toxic[2] - 0.8) < 0.06 and abs(m.on_clean[2] - 0.1) < 0.05


def test_label_model_learns_from_rows_without_a_label():
    """A voter that no labelled row shows gets its rates from votes alone."""
    import numpy as np

    g = np.random.default_rng(1)
    y = g.random(6000) < 0.2
    votes = np.stack([np.where(y, g.random(6000) < p, g.random(6000) < 0.03) for p in (0.7, 0.6, 0.65, 0.8)], 1)
    anchor = np.full(6000, np.nan)
    anchor[:300] = y[:300]
    votes[:300, 3] = False
    m = toxicity.LabelModel(votes, anchor)
    assert m.on_toxic[3] > 0.6 and m.on_clean[3] < 0.08 and abs(m.prior - 0.2) < 0.05
    assert ((m.fitted > 0.5) == y)[300:].mean() > 0.95


def test_sentencepiece_round_trip(docs, empty):
    e = sentencepiece_sampling.encode(docs, draws=3)
    rows = e.collect()
    texts = {i: t or "" for i, t, *_ in corpus()}
    assert all(r.decoded for r in rows) and {r.doc_id for r in rows} == set(texts)
    back = {(r.doc_id, r.draw): r.text for r in sentencepiece_sampling.decode(e).collect()}
    assert all(t == texts[i] for (i, _), t in back.items())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.log_prob <= 0 and 0 < r.inclusion <= 1 or r.log_prob < -500
    for x in by.values():
        assert len({tuple(r.ids) for r in x}) == len(x) and sorted(r.draw for r in x) == list(range(1, len(x) + 1))
    again = {(r.doc_id, r.draw): r.ids_sha256 for r in sentencepiece_sampling.encode(docs.repartition(2), draws=3, ids=False).collect()}
    assert again == {(r.doc_id, r.draw): r.ids_sha256 for r in rows}
    assert sentencepiece_sampling.encode(empty).count() == 0


def test_sentencepiece_frequencies():
    """Draws against the law of sampling without replacement over all segmentations of a short word."""
    import numpy as np
    import pyarrow as pa

    v = sentencepiece_sampling.Pieces.load(sentencepiece_sampling.MODEL_PATH)
    all_ = {(tuple(x)): np.exp(p) for _, _, x, p, _, _ in sentencepiece_sampling.sample_batch(v, pa.array(["an"]), np.arange(1), 50)}
    assert abs(sum(all_.values()) - 1) < 1e-6
    n = 30000
    rows = sentencepiece_sampling.sample_batch(v, pa.array(["an"] * n), np.arange(n), 2)
    first, second = Counter(tuple(r[2]) for r in rows if r[1] == 1), Counter(tuple(r[2]) for r in rows if r[1] == 2)
    for x, p in all_.items():
        q = sum(all_[y] * p / (1 - all_[y]) for y in all_ if y != x)
        assert abs(first[x] / n - p) < 0.01 and abs(second[x] / n - q) < 0.012
