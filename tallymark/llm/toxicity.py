"""Toxicity by weak supervision.

Many voters (words of fixed lexicons, patterns, and words that the labelled rows
show to be telling) each vote toxic or abstain; one votes clean. A generative label
model estimates their accuracies, and the correlations between them, by expectation
maximisation over the votes on a sample of all rows, most of them without a label. Labels only
anchor it: one enters as the vote of one more voter, of fixed accuracy, on its row. A
linear classifier is trained on the posterior labels of all these rows and scores every
document.

Labels come only from documents outside the held-out fold, and so do the rows of the
sample: about SAMPLE_TOXIC and SAMPLE_CLEAN labelled rows of each class and SAMPLE_ALL
rows of any kind, taken by hash of doc_id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_ALL = 3000, 6000, 6000
#: Values of the hash by which rows are sampled, so many that no share of them rounds to none.
SHARES = 1 << 62
#: How often a label is right, as a vote.
ANCHOR = 0.95
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Lengths of the stems that can vote, for words of abuse that are inflected.
STEMS = (5, 7)
#: A word or stem votes from this likelihood ratio and this ratio of its rates in toxic and clean rows on.
LEAST_G2, LEAST_RATIO = 24.0, 8.0
#: Most words that become voters, and most features of the classifier.
WORD_VOTERS, FEATURES = 64, 400
#: Words of abuse and of threat by language.
LEXICONS = {
    "insult_en": "idiot moron stupid loser trash worthless pathetic disgusting scum clown fool dumb garbage ugly liar jerk vermin filth",
    "insult_de": "idiot trottel dumm abschaum versager blödmann widerlich ekelhaft lügner",
    "insult_fr": "idiot imbécile stupide crétin ordure minable dégoûtant nul menteur",
    "insult_es": "idiota estúpido imbécil basura asqueroso inútil tonto mentiroso",
    "threat": "kill murder die hang destroy töten tuer matar",
}
#: Patterns of abusive style.
PATTERNS = {"address": r"\byou (?:are|re) (?:an? )?\w+", "shout": r"!{2,}|\?!", "capitals": r"\b[A-Z]{4,}\b(?: \b[A-Z]{4,}\b){2,}"}
_WORDS = re.compile(r"[^\W_]+")


def held_out(folds: int = FOLDS, fold: int = HELD_OUT, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def words_of(text: str | None) -> set[str]:
    """The words of a text in lower case, and the stems that two or more different longer words share (with a hyphen)."""
    words = set(_WORDS.findall(text.lower())) if text else set()
    stems = set()
    for k in STEMS:
        once: set[str] = set()
        for w in words:
            if len(w) > k:
                x = w[:k]
                if x in once:
                    stems.add(x + "-")
                else:
                    once.add(x)
    return words | stems


class LabelModel:
    """p(toxic | votes) with an accuracy for every voter and discounted correlated ones.

    votes: rows by voters, true where a voter votes. Each voter has a rate of voting on
    toxic and on clean rows. The share of a voter's weight that it has in common with
    others, from the correlation of their votes within each class, is divided out. anchor: 1, 0
    or, without a label, nan by row. Rates start from the labelled rows and are then
    estimated from the votes on all rows; so is the share of toxic rows, from those without a label.
    """

    def __init__(self, votes: np.ndarray, anchor: np.ndarray, rounds: int = 20):
        v, known = votes.astype(float), ~np.isnan(anchor)
        hint = np.where(known, np.where(anchor == 1, 1.0, -1.0) * np.log(ANCHOR / (1 - ANCHOR)), 0.0)
        q = np.where(known, np.where(anchor == 1, ANCHOR, 1 - ANCHOR), 0.0)
        weight, self.prior = known.astype(float), min(max(float(np.nanmean(anchor)), 0.01), 0.99)
        for k in range(rounds):
            yes, no = q * weight, (1 - q) * weight
            self.on_toxic, self.on_clean = (yes @ v + 0.5) / (yes.sum() + 2), (no @ v + 0.5) / (no.sum() + 2)
            corr = np.zeros((v.shape[1], v.shape[1]))
            for w, mean in ((yes, self.on_toxic), (no, self.on_clean)):
                r = (v - mean) * np.sqrt(w)[:, None]
                cov = r.T @ r / max(w.sum(), 1)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                corr = np.maximum(corr, np.clip(cov / sd[:, None] / sd[None, :], 0, 1))
            np.fill_diagonal(corr, 0)
            self.correlation = corr
            self.share = 1 / (1 + np.where(corr > 0.3, corr, 0).sum(1))
            q, weight = self.posterior(votes, hint), np.ones(len(v))
            if not known.all():
                self.prior = min(max(float(q[~known].mean()), 0.01), 0.99)
        self.fitted = q

    def posterior(self, votes: np.ndarray, hint: np.ndarray | float = 0.0) -> np.ndarray:
        yes = np.log(self.on_toxic / self.on_clean) * self.share
        no = np.log((1 - self.on_toxic) / (1 - self.on_clean)) * self.share
        z = np.log(self.prior / (1 - self.prior)) + votes @ yes + (~votes) @ no + hint
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[str | None, int]], more: list[str | None] = ()) -> dict:
    """The classifier from (text, label) rows and texts without a label: words, weights, bias. Without rows of both classes it scores the prior."""
    y = np.array([label for _, label in rows], float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return {"words": {}, "weights": np.zeros(0), "bias": float(np.log(p / (1 - p)) if len(y) else -3.0)}
    by = (Counter(), Counter())
    for text, label in rows:
        by[label].update(words_of(text))
    n = (float((y == 0).sum()), float((y == 1).sum()))

    def telling(w: str) -> float:
        """The signed likelihood ratio of a word's rates in toxic and in clean rows."""
        a, b = by[1][w], by[0][w]
        share = n[1] / (n[0] + n[1])
        g2 = 2 * ((a * np.log(a / ((a + b) * share)) if a else 0.0) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0))
        return float(g2 if a * n[0] > b * n[1] else -g2)

    def ratio(w: str) -> float:
        return (by[1][w] + 0.5) / (n[1] + 1) / ((by[0][w] + 0.5) / (n[0] + 1))

    seen = [w for w in by[1].keys() | by[0].keys() if by[1][w] + by[0][w] >= 5]
    strong = sorted(((telling(w), w) for w in seen), key=lambda x: (-x[0], x[1]))
    voters = [w for s, w in strong if s > LEAST_G2 and ratio(w) > LEAST_RATIO][:WORD_VOTERS]
    weak = [w for s, w in sorted(strong, key=lambda x: (-abs(x[0]), x[1])) if abs(s) > LEAST_G2][:FEATURES]
    lexicons, patterns = [set(x.split()) for x in LEXICONS.values()], [re.compile(p) for p in PATTERNS.values()]
    names = list(dict.fromkeys([*voters, *weak, *sorted(w for x in lexicons for w in x if by[1][w] + by[0][w])]))
    at = {w: i for i, w in enumerate(names)}
    texts = [t for t, _ in rows] + list(more)
    votes, x = np.zeros((len(texts), len(voters) + len(lexicons) + len(patterns) + 1), bool), np.zeros((len(texts), len(names)), np.float32)
    for i, text in enumerate(texts):
        has = words_of(text)
        x[i, [at[w] for w in at.keys() & has]] = 1
        row = [w in has for w in voters] + [bool(has & l) for l in lexicons] + [bool(p.search(text or "")) for p in patterns]
        votes[i] = [*row, not any(row[: len(voters)])]
    soft = LabelModel(votes, np.concatenate([y, np.full(len(texts) - len(y), np.nan)])).fitted
    # Balanced logistic regression with a ridge, by Newton's method.
    w, xb = np.zeros(len(names) + 1), np.hstack([x, np.ones((len(texts), 1), np.float32)]).astype(float)
    ridge = np.full(len(names) + 1, 0.1)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        step = np.linalg.solve((xb * (p * (1 - p))[:, None]).T @ xb + np.diag(ridge), xb.T @ (p - soft) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"words": at, "weights": w[:-1], "bias": float(w[-1])}


def sample_rows(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, some: int = SAMPLE_ALL) -> tuple[list[tuple[str | None, int]], list[str | None]]:
    """(text, label) of a bounded number of labelled rows, and texts of other rows, all outside the held-out fold.

    Of rows that share a doc_id the greatest text counts.
    """
    known = labels.where(~held_out()).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = lambda most, n: F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < int(SHARES * min(1, most / max(n, 1)))
    part = known.where(((F.col("toxic") == 1) & share(toxic, counts.get(1, 0))) | ((F.col("toxic") == 0) & share(clean, counts.get(0, 0))))
    able = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(~held_out() & F.col("doc_id").isNotNull())
    rows = able.join(F.broadcast(part), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    other = able.where(share(some, able.count())).groupBy("doc_id").agg(F.max("text").alias("text")).collect()
    ids = {r.doc_id for r in rows}
    return [(r.text, int(r.toxic)) for r in sorted(rows, key=lambda r: r.doc_id)], [r.text for r in sorted(other, key=lambda r: r.doc_id) if r.doc_id not in ids]


def _scorer(docs: DataFrame, labels: DataFrame):
    """A function from a column of texts to scores."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample_rows(docs, labels)))

    def score(texts: pa.Array) -> np.ndarray:
        m = model.value
        keys = m["words"].keys()
        z = [m["bias"] + sum(m["weights"][m["words"][w]] for w in sorted(keys & words_of(t.as_py()))) for t in texts]
        return np.round(1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50))), 6)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The score is a function of the text alone, so repeated rows get equal scores. Null
    and empty texts have no feature and get the score of the bias. Labels that are null
    or conflict: null ones are left out, of several for one doc_id the largest counts. With
    no labels at all every text scores about 0.05. Empty docs give no rows.
    """
    scores = _scorer(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity_stage(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns, in one pass over the texts."""
    scores = _scorer(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
