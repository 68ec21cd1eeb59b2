"""The whole pipeline, each stage held against a plain version of it on its own input."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from tallymark.llm import sentencepiece_sampling, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, component_id string, kept string, draw string"


def table():
    """Clean and toxic texts, exact and near copies, nulls, empties, shared and missing ids, a long text."""
    r = random.Random(5)
    clean, foul = [f"w{k}" for k in range(300)], [f"slur{k}" for k in range(12)]
    texts = [" ".join(r.choice(clean) for _ in range(r.randint(1, 150))) for _ in range(70)]
    texts += [" ".join(r.choice(foul if k % 2 else clean) for k in range(40)) for _ in range(30)]
    for k in range(30):
        w = texts[k % 6].split(" ")
        w[r.randrange(len(w))] = r.choice(clean)
        texts.append(" ".join(w))
    texts += [texts[9]] * 6 + [texts[10].upper(), None, None, "", "  ", "a", " ".join(clean * 120)]
    rows = [(i, t, "en", ["b", "a", None, "ä"][i % 7 % 4], None, "x", "y", "z", "u") for i, t in enumerate(texts)]
    own = lambda t, i=None: (i, t, None, "b", 0, "x", "y", "z", "u")
    rows += [rows[12], rows[12], own(texts[13]), own("nobody else has these words"), own("nor has anyone these", 20), own("no id and no copy here")]
    return rows, [(i, None, int(70 <= i < 100), "x") for i in range(130) if i % 5]


def shingles(t):
    w = [m.group().lower() if m.group().isascii() else m.group() for m in WORD.finditer(t or "")]
    return {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def least_of_components(rows):
    """doc_id and text of the rows that are the least of their component; those without an id stay."""
    sets = [shingles(r.text) for r in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if None not in (rows[a].doc_id, rows[b].doc_id) and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    low = defaultdict(list)
    for k, r in enumerate(rows):
        low[root(k)].append(r.doc_id)
    ids = {min(v) for v in low.values() if None not in v}
    return Counter((r.doc_id, r.text) for r in rows if r.doc_id is None or r.doc_id in ids)


def targets(sizes):
    """Words to take of each source: shares by weight, the excess over twice the source dealt out again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    """Each stage's name with the rows that it got, and the result."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows, labels = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    got, stages = {}, corpus_pipeline.STAGES
    watched = lambda name, stage: (name, lambda s, docs, path: (got.update({name: docs}), stage(s, docs, path))[1])
    with pytest.MonkeyPatch.context() as m:
        m.setattr(corpus_pipeline, "STAGES", [watched(*x) for x in stages])
        out = corpus_pipeline.run(spark, d)
    assert all(x.columns == got["toxicity"].columns for x in got.values())
    return d, {k: x.collect() for k, x in got.items()}, out


def pairs(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_toxicity_stage(spark, ran):
    d, got, _ = ran
    s = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).collect()
    clean = Counter(r.doc_id for r in s if not r.predicted)
    assert Counter(r.doc_id for r in got["exact_dedup"]) == clean
    ids = {r.doc_id for r in got["exact_dedup"]}
    assert len([i for i in range(70, 100) if i not in ids]) >= 27
    assert set(range(70)) <= ids


def test_exact_dedup_stage(ran):
    _, got, _ = ran
    best = {}
    for r in got["exact_dedup"]:
        t = r.text or ""
        best[t] = r.doc_id if best.get(t) is None else max(best[t], best[t] if r.doc_id is None else r.doc_id)
    assert Counter((r.doc_id, r.text or "") for r in got["ngram_jaccard"]) == Counter((i, t) for t, i in best.items())


def test_ngram_jaccard_stage(ran):
    _, got, _ = ran
    assert pairs(got["mixing"]) == least_of_components(got["ngram_jaccard"])
    assert len(got["mixing"]) < len(got["ngram_jaccard"])


def test_mixing_stage(ran):
    _, got, _ = ran
    size, most, taken = Counter(), Counter(), Counter()
    words = lambda r: len(WORD.findall(r.text or ""))
    for r in got["mixing"]:
        size[r.source] += words(r)
        most[r.source] = max(most[r.source], words(r))
    for r in got["sentencepiece"]:
        taken[r.source] += words(r)
    for s, want in targets(size).items():
        assert abs(taken[s] - want) <= most[s], s
    before = pairs(got["mixing"])
    assert all(n <= 2 * before[k] for k, n in pairs(got["sentencepiece"]).items())


def test_encoding_stage(ran):
    _, got, out = ran
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in got["sentencepiece"]}
    assert all(r.decoded for r in rows)
    texts = {(r.doc_id, r.text) for r in got["sentencepiece"]}
    back = sentencepiece_sampling.decode(out).collect()
    assert len(back) == len(rows) and {(r.doc_id, r.text) for r in back} == texts


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
