"""Language identification by words first, then shorter and shorter character n-grams.

A known word scores its log frequency in every language. A word outside the
vocabulary is read character by character with the longest known n-gram that ends
there, from LONGEST characters down to one, each step down at a fixed discount.
Texts are cut at white space and common marks first; a token's words are found and scored once, and
many texts and words are added up at a time.

The model is fitted on a bounded sample of rows with a language (about SAMPLE_ROWS shared
equally among the languages, by hash of doc_id) outside the held-out fold, and keeps at
most VOCABULARY words and NGRAMS n-grams of each length.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .toxicity import SHARES, held_out

SAMPLE_ROWS, VOCABULARY, NGRAMS, LONGEST = 6000, 50_000, 20_000, 4
#: Rows of each language at least, if it has them, however many languages share SAMPLE_ROWS.
LEAST_ROWS = 200
FOLDS, HELD_OUT = 4, 2
#: What a word is padded with, so that its first window has LONGEST characters and ends with its first letter.
BEFORE = "\0" * (LONGEST - 2)
#: log of the factor for each step to a shorter n-gram.
BACKOFF = np.log(0.4)
#: Characters that count as word characters of a pattern but are neither letters nor digits, such as fractions.
_NUMERIC = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_LETTERS = re.compile(rf"[^\W\d_{_NUMERIC}]+")
_RUNS = re.compile(r"[^\W\d_]+")
#: Common marks that are no letters: they part tokens as white space does, so that fewer of them differ.
MARKS = ".,;:!?\"'()-\u3001\u3002\uff0c"
#: Tokens, and windows of LONGEST characters, that a worker remembers before it starts anew; characters and scores of those tokens.
REMEMBERED, CHARACTERS, SCORES = 400_000, 16_000_000, 20_000_000
#: Tokens of texts that are added up at once, but for those of one text.
AT_ONCE = 1 << 15


def _words(text: str) -> list[str]:
    """The runs of letters; only runs with other numeric characters in them are looked at twice."""
    found = _RUNS.findall(text)
    return found if all(map(str.isalpha, found)) else [w for run in found for w in ([run] if run.isalpha() else _LETTERS.findall(run))]


def _sums(table: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of table, its values at the places, added up by consecutive groups of the given sizes; a column per group."""
    out = np.zeros((len(table), len(sizes)))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        for i, row in enumerate(table):
            out[i, some] = np.add.reduceat(row[at], starts, dtype=np.float64)
    return out


def _tokens(text: str) -> list[str]:
    """Pieces of a text in small letters; no run of letters goes beyond one."""
    text = text.lower()
    for mark in MARKS:
        text = text.replace(mark, " ")
    return text.split()


class Windows(dict):
    """Rows of the longest known n-grams that windows of at most LONGEST characters end with."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams

    def __missing__(self, window: str) -> int:
        i = self[window] = next((self.grams[g] for k in range(len(window)) if (g := window[k:]) in self.grams), len(self.grams))
        return i


class Model:
    def __init__(self, rows: list[tuple[str, str]]):
        """rows: (text, language)."""
        self.langs = sorted({lang for _, lang in rows})
        at = {x: i for i, x in enumerate(self.langs)}
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, lang in rows:
            counts[lang].update(_words(text.lower()))
        total = Counter()
        for c in counts.values():
            total.update(c)
        known = sorted((w for w, n in total.items() if n > 1), key=lambda w: (-total[w], w))[:VOCABULARY]
        self.words = self._table(known, [counts[x] for x in self.langs])
        self.grams: dict[str, int] = {}
        #: Scores and steps down of the n-grams, a column each; the last is for characters that no n-gram ends with.
        tables, steps = [], []
        for n in range(1, LONGEST + 1):
            by = [Counter() for _ in self.langs]
            for lang, c in counts.items():
                for w, k in c.items():
                    p = f" {w} "
                    for i in range(len(p) - n + 1):
                        by[at[lang]][p[i : i + n]] += k
            all_n = sum(by, Counter())
            top = sorted(all_n, key=lambda g: (-all_n[g], g))[:NGRAMS]
            ids, scores = self._table(top, by)
            self.grams |= {g: len(self.grams) + i for g, i in ids.items()}
            tables.append(scores)
            steps += [LONGEST - n] * len(top)
        tables.append(np.full((len(self.langs), 1), -12.0, np.float32))
        self.scores, self.steps = np.hstack(tables), np.array([[*steps, 0]], np.int8)

    def _table(self, keys: list[str], by: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
        sums = np.array([sum(c.values()) for c in by], float)
        n = np.array([[c[k] for c in by] for k in keys], float).reshape(len(keys), len(by))
        return {k: i for i, k in enumerate(keys)}, np.ascontiguousarray(np.log((n + 0.1) / (sums + 0.1 * (len(keys) + 1))).astype(np.float32).T)

    def read(self, words: list[str], windows: Windows) -> np.ndarray:
        """Scores of the words, a column each."""
        ids, scores = self.words
        at = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))
        out, other = np.zeros((len(self.langs), len(words)), np.float32), np.flatnonzero(at < 0)
        out[:, at >= 0] = scores[:, at[at >= 0]]
        # No n-gram has a zero character: windows that begin with some end with shorter ones.
        padded = [f"{BEFORE} {words[i]} " for i in other]
        ends = np.fromiter(map(len, padded), np.int64, len(padded)) - LONGEST + 1
        grams = np.fromiter(map(windows.__getitem__, (p[i : i + LONGEST] for p in padded for i in range(len(p) - LONGEST + 1))), np.int64, ends.sum())
        out[:, other] = (_sums(self.scores, grams, ends) + BACKOFF * _sums(self.steps, grams, ends)) / ends
        return out


class Tokens(dict):
    """Numbers of the tokens met so far. Each has a column with the sum of its words' scores in every language, and the count of its words last."""

    def __init__(self, model: Model):
        self.model, self.windows = model, Windows(model.grams)
        self.columns = np.zeros((len(model.langs) + 1, 1024))
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        self.new.append(token)
        return i

    def sums(self, texts: list[list[int]]) -> np.ndarray:
        """Columns of the texts, given as numbers of their tokens. These numbers may be void afterwards."""
        self._learn()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = _sums(self.columns, np.fromiter(chain.from_iterable(texts), np.int64, sizes.sum()), sizes)
        if len(self) > REMEMBERED or self.characters > CHARACTERS or len(self) * len(self.columns) > SCORES:
            self.clear()
            self.characters = 0
        if len(self.windows) > REMEMBERED:
            self.windows.clear()
        return out

    def _learn(self) -> None:
        """Fill the columns of the new tokens."""
        found = [_words(t) for t in self.new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        words = self.model.read(list(chain.from_iterable(found)), self.windows)
        if len(self) > self.columns.shape[1]:
            self.columns = np.hstack([self.columns, np.zeros((len(self.columns), len(self)))])
        first = len(self) - len(found)
        self.columns[:-1, first : len(self)] = _sums(words, np.arange(words.shape[1]), sizes)
        self.columns[-1, first : len(self)] = sizes
        self.characters += sum(map(len, self.new))
        self.new = []


def sample_rows(docs: DataFrame, most: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """(text, language) of about equally many rows of each language, of a rare one all."""
    some = docs.where(~held_out(FOLDS, HELD_OUT)).where("lang is not null and text is not null and doc_id is not null")
    counts = some.groupBy("lang").count().collect()
    each = max(most // max(len(counts), 1), LEAST_ROWS)
    share = docs.sparkSession.createDataFrame([(str(r[0]), int(SHARES * min(1, each / r[1]))) for r in counts], "_lang string, _share long")
    some = some.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).join(F.broadcast(share), F.col("lang") == F.col("_lang"))
    rows = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < F.col("_share")).select("doc_id", "text", "lang")
    return [(t, str(x)) for _, t, x in sorted(map(tuple, rows.collect()))]


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    The prediction depends on the text alone. Null, empty and letterless texts give
    `und` with score 0.0, as does every text where no row has a language. Ties go to
    the language first in order. The score is the posterior of the languages under
    equal priors, tempered by the square root of the number of words.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(Model(sample_rows(docs)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        tokens = Tokens(m)
        number = tokens.__getitem__
        for b in batches:
            langs, sure, waiting, n = [], [], [], 0
            for k, t in enumerate(b.column("text"), 1):
                waiting.append(list(map(number, _tokens(t.as_py()))) if t.is_valid and m.langs else [])
                n += len(waiting[-1])
                if n < AT_ONCE and k < len(b):
                    continue
                sums = tokens.sums(waiting)
                for x, count in zip(sums[:-1].T, sums[-1]):
                    x = x / np.sqrt(max(count, 1))
                    best = int(x.argmax()) if count else 0
                    langs.append(m.langs[best] if count else "und")
                    sure.append(round(float(1 / np.exp(x - x[best]).sum()), 6) if count else 0.0)
                waiting, n = [], 0
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
