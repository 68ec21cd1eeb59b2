"""Quality by perplexity under an interpolated modified Kneser-Ney model of bytes.

The model is trained on the whole trusted text (documents labelled good). Counts of
ORDER-byte grams are joined, level by level, to the counts of their histories and to the
probabilities of their suffixes; all of it is keyed by gram, so it is sharded by gram.
Each document then gets its perplexity, and is kept if that lies between two quantiles of
the trusted documents of its language.

The finished tables are sent to the scoring tasks whole if they have no more than
MOST_ROWS rows, which is counted first; beyond that the grams of the documents are
joined to them. Both ways give the same perplexities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ranked, slices, text_bytes

ORDER = 5
QUANTILES = (0.005, 0.98)
MOST_ROWS = 4_000_000
BATCH_BYTES = 2 << 20


def grams(raw: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte, as an integer, first byte highest; zero bytes stand before a text."""
    sizes = np.diff(offsets)
    inner = np.arange(len(raw)) - np.repeat(offsets[:-1], sizes)
    out = np.zeros(len(raw), np.int64)
    for k in range(order):
        b = np.zeros(len(raw), np.int64)
        b[k:] = raw[: max(len(raw) - k, 0)]
        out |= np.where(inner >= k, b, 0) << (8 * k)
    return out


def _counts(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, BATCH_BYTES):
            g, n = np.unique(grams(*text_bytes(b.column("text")), order), return_counts=True)
            yield pa.record_batch({"gram": pa.array(g), "n": pa.array(n)})


def train(scratch: Scratch, trusted: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """([p by gram for each level], [gamma by history for each level]), levels from 1 up.

    Level k has grams of k bytes. The highest level counts occurrences, the lower ones the
    different bytes that come before.
    """
    top = scratch.save(trusted.mapInArrow(lambda it: _counts(it, order), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    levels = [top]
    for k in range(order - 1, 0, -1):
        levels.insert(0, scratch.save(levels[0].groupBy(F.col("gram").bitwiseAND((1 << (8 * k)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    ps, gammas, below = [], [], None
    for k, level in enumerate(levels, 1):
        n1, n2, n3, n4 = (float(x or 0) for x in level.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(max(x, 0.01), m - 0.01) for x, m in ((1 - 2 * y * n2 / n1 if n1 else 0.5, 1), (2 - 3 * y * n3 / n2 if n2 else 1.0, 2), (3 - 4 * y * n4 / n3 if n3 else 1.5, 3))]
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        h = F.shiftright("gram", 8)
        hist = level.groupBy(h.alias("h")).agg(F.sum("n").alias("total"), F.sum(cut).alias("off"))
        hist = scratch.save(hist.select("h", "total", (F.col("off") / F.col("total")).alias("gamma")))
        x = level.withColumn("h", h).join(hist, "h")
        own = (F.col("n") - cut) / F.col("total")
        if k == 1:
            p = x.select("gram", (own + F.col("gamma") / 256).alias("p"))
        else:
            x = x.withColumn("s", F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1)).join(below.toDF("s", "q"), "s")
            p = x.select("gram", (own + F.col("gamma") * F.col("q")).alias("p"))
        below = scratch.save(p)
        ps.append(below)
        gammas.append(hist.select("h", "gamma"))
    return ps, gammas


def _log_probs(g: np.ndarray, tables) -> np.ndarray:
    """log p of each gram, down to shorter ones where it was not seen; histories never seen cost nothing."""
    out, open_ = np.zeros(len(g)), np.arange(len(g))
    for k in range(len(tables), 0, -1):
        (keys, p), (hist, gamma) = tables[k - 1]
        x = g[open_] & ((1 << (8 * k)) - 1)
        at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
        hit = keys[at] == x if len(keys) else np.zeros(len(x), bool)
        out[open_[hit]] += np.log(p[at[hit]]) if hit.any() else 0
        open_, x = open_[~hit], x[~hit] >> 8
        at = np.minimum(np.searchsorted(hist, x), max(len(hist) - 1, 0))
        known = hist[at] == x if len(hist) else np.zeros(len(x), bool)
        out[open_[known]] += np.log(gamma[at[known]]) if known.any() else 0
    out[open_] -= np.log(256)
    return out


def perplexities(scratch: Scratch, docs: DataFrame, ps: list[DataFrame], gammas: list[DataFrame], most_rows: int = MOST_ROWS) -> DataFrame:
    """docs (doc_id, text, lang) to (doc_id, lang, n_bytes, perplexity); a text without bytes has none."""
    spark = docs.sparkSession
    order = len(ps)
    rows = sum(t.count() for t in (*ps, *gammas))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, lang string, n_bytes long, log_p double"
    if rows <= most_rows:
        def table(t: DataFrame) -> tuple[np.ndarray, np.ndarray]:
            a = t.toArrow()
            k, v = a.column(0).to_numpy(), a.column(1).to_numpy()
            o = np.argsort(k)
            return k[o], v[o]

        model = spark.sparkContext.broadcast([(table(p), table(g)) for p, g in zip(ps, gammas)])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, BATCH_BYTES):
                    raw, off = text_bytes(b.column("text"))
                    g, inverse = np.unique(grams(raw, off, len(model.value)), return_inverse=True)
                    run = np.concatenate([[0.0], np.cumsum(_log_probs(g, model.value)[inverse])])
                    yield pa.record_batch({"doc_id": b.column("doc_id"), "lang": b.column("lang"), "n_bytes": pa.array(np.diff(off)), "log_p": pa.array(run[off[1:]] - run[off[:-1]])})

        s = docs.select("doc_id", "lang", "text").mapInArrow(score, shape)
    else:
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, BATCH_BYTES):
                    raw, off = text_bytes(b.column("text"))
                    g = grams(raw, off, order)
                    for i in range(b.num_rows):
                        x, n = np.unique(g[off[i] : off[i + 1]], return_counts=True)
                        if len(x):
                            yield pa.record_batch({"key": b.column("key").slice(i, 1).take(pa.array(np.zeros(len(x), np.int64))), "gram": pa.array(x), "n": pa.array(n)})

        keyed = docs.select("doc_id", "lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"))
        r = keyed.select("key", "text").distinct().mapInArrow(split, "key long, gram long, n long").withColumn("log", F.lit(0.0)).withColumn("open", F.lit(True))
        for k in range(len(ps), 0, -1):
            x = F.when(F.col("open"), F.col("gram").bitwiseAND((1 << (8 * k)) - 1))
            r = r.withColumn("x", x).join(ps[k - 1].toDF("x", "p"), "x", "left").withColumn("h", F.when(F.col("open") & F.col("p").isNull(), F.shiftright("x", 8)))
            r = r.join(gammas[k - 1].toDF("h", "gamma"), "h", "left")
            r = r.select("key", "gram", "n", (F.col("log") + F.coalesce(F.log("p"), F.log("gamma"), F.lit(0.0))).alias("log"), (F.col("open") & F.col("p").isNull()).alias("open"))
        sums = r.groupBy("key").agg(F.sum(F.col("n") * (F.col("log") - F.when(F.col("open"), np.log(256.0)).otherwise(0.0))).alias("log_p"))
        s = keyed.join(sums, "key", "left").select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce("log_p", F.lit(0.0)).alias("log_p"))
    return s.select("doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))).alias("perplexity"))


def limits(scratch: Scratch, s: DataFrame, quantiles: tuple[float, float]) -> DataFrame:
    """(_l, _q): by language the exact quantiles of the perplexities of trusted documents, or where there are none of all.

    The quantile q of n values is the ceil(q * n)-th least one (the first at least); its place is found in one range sort.
    """
    known = s.where("perplexity is not null").select("lang", "perplexity", "trusted")
    by = known.groupBy(F.col("lang").alias("_l")).agg(F.count(F.when(F.col("trusted"), 1)).alias("good"))
    some = known.join(by, F.col("lang").eqNullSafe(F.col("_l"))).where("trusted or good = 0").select("lang", "perplexity")
    some = scratch.save(ranked(scratch, some, ["lang", "perplexity"], "place"))
    at = [(F.col("least") + F.greatest(F.ceil(F.col("n") * q), F.lit(1)) - 1).alias(f"p{k}") for k, q in enumerate(quantiles)]
    at = some.groupBy(F.col("lang").alias("_l")).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n")).select("_l", *at)
    hit = some.join(at, F.col("lang").eqNullSafe(F.col("_l")))
    return hit.groupBy("_l").agg(F.array(*[F.max(F.when(F.col("place") == F.col(f"p{k}"), F.col("perplexity"))) for k in range(len(quantiles))]).alias("_q"))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantiles: tuple[float, float] = QUANTILES, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, perplexity, low, high, keep) for each row of docs.

    Trusted are documents whose label quality is 1 (the largest, of several). Null and empty
    texts have no perplexity and are not kept. A null language is one of its own. Where no
    document of a language is trusted, its own documents set the quantiles, which are exact. With no
    trusted text every byte costs the same and all texts are alike. Repeated rows give
    equal rows.
    """
    scratch = Scratch(docs.sparkSession)
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct().withColumn("_t", F.lit(True))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trusted = d.join(good.hint("merge"), F.col("doc_id") == F.col("_id"), "left_semi").select("text")
    ps, gammas = train(scratch, trusted, order)
    # Texts are shuffled for the training alone; which documents are trusted is joined to their perplexities.
    s = perplexities(scratch, d, ps, gammas, most_rows).join(good.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    s = scratch.save(s.select("doc_id", "lang", F.coalesce("_t", F.lit(False)).alias("trusted"), "n_bytes", "perplexity"))
    out = s.join(limits(scratch, s, quantiles), F.col("lang").eqNullSafe(F.col("_l")), "left")
    low, high = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    keep = F.coalesce((F.col("perplexity") >= low) & (F.col("perplexity") <= high), F.lit(False))
    return out.select("doc_id", "lang", "trusted", "n_bytes", F.round("perplexity", 6).alias("perplexity"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), keep.alias("keep"))
