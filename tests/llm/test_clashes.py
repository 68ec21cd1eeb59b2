"""Stages and operators on a table whose further columns bear the names that the operators use inside."""

import pytest

from tallymark.llm import exact_dedup, jaccard_join, language_id, mixing, paragraph_dedup, quality, substring_dedup, toxicity

NAMES = "_id _h __id _at _start _row _t _l _q _r key n gone rep component component_id pos size copies score predicted held_out keep_id kept first fa fb hist taken target line pid marks bucket packed label toxic quality perplexity words x h w source_size count name level".split()
SIX = "one two three four five six"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, SIX, "en", "a"), (2, None, None, None), (3, "", "de", ""), (None, SIX, None, "a"), (4, "word " * 30000, "en", "b"), (5, SIX, "en", "a"), (5, SIX, "en", "a"), (6, "   ", "fr", None), (7, "x" * 100000, "en", "b"), (8, "ein zwei drei vier", "de", "a")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in NAMES)
    return spark.createDataFrame([(*r, None, *("z",) * len(NAMES)) for r in rows], schema)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (3, None, 1, "z"), (None, 1, 1, "z"), (5, 1, 1, "z"), (8, 0, None, "z"), (1, 1, 0, "z")], "doc_id long, quality int, toxic int, text string")


def ids(df, docs):
    assert df.columns == docs.columns
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is not None, i))


def test_stages(docs):
    assert ids(exact_dedup.dedup_stage(docs), docs) == [3, 4, 5, 6, 7, 8]
    assert ids(jaccard_join.jaccard_stage(docs), docs) == [None, 1, 2, 3, 4, 6, 7, 8]
    assert set(ids(mixing.mix_stage(docs), docs)) <= {None, 1, 4, 5, 7, 8}


def test_stages_empty(docs):
    for stage in (exact_dedup.dedup_stage, jaccard_join.jaccard_stage, mixing.mix_stage):
        assert ids(stage(docs.limit(0)), docs) == []


def test_toxicity(docs, labels):
    assert set(ids(toxicity.toxicity_stage(docs, labels), docs)) <= {None, *range(1, 9)}
    assert toxicity.toxicity(docs, labels).count() == 10


def test_operators(docs, labels):
    for out in (language_id.language_id(docs), paragraph_dedup.paragraph_dedup(docs), substring_dedup.substring_dedup(docs), quality.quality(docs, labels)):
        assert out.count() == 10
