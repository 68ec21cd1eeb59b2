"""Text mining: vectors, branches, shortlists, expansion, fusion, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import PROXY_TOOLS, STOP_WORDS, TextConfig
from ..functions import expr as x
from .records import first_wins


#: Keys that the titles of one entity are dealt over.
SALTS = 256


def bucket(token: Column, dims: int = 64) -> Column:
    """A stable bucket of a token: the last byte of its MD5."""
    return F.conv(F.substring(F.md5(token), 31, 2), 16, 10).cast("int") % dims


def hashed_bow(df: DataFrame, key: str, text: str, distinct: bool = False) -> DataFrame:
    """(key, bucket, n): token counts by bucket; distinct counts each token once."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    t = df.select(key, F.explode(F.array_distinct(tokens) if distinct else tokens).alias("t"))
    return t.groupBy(key, bucket(F.col("t")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def shortlist(df: DataFrame, vector: str, axis: Column, seq: str, cfg: TextConfig = TextConfig()) -> DataFrame:
    """The top rows by cosine to an axis, from the least cosine on; ties by seq."""
    s = df.withColumn("cosine", cosine(F.transform(vector, lambda v: v.cast("double")), axis))
    return s.where(F.col("cosine") >= cfg.min_cosine).orderBy(F.desc("cosine"), seq).limit(cfg.top_k)


def branch_a(snippets: DataFrame, seq: str = "seq", text: str = "text") -> DataFrame:
    """Stripped, not empty, and of equal ones the first."""
    s = snippets.withColumn("stripped", x.strip_boilerplate(F.col(text))).where("stripped <> ''")
    return first_wins(s, ["stripped"], seq)


def sid_index(snippets: DataFrame) -> DataFrame:
    """(key, sid): the SHA-256 of raw and stripped texts to the first snippet that has them."""
    # Both texts are hashed where a snippet is read, so neither is shuffled nor stripped twice.
    both = snippets.select(F.explode(F.array(F.sha2("raw", 256), F.sha2("stripped", 256))).alias("key"), "sid", "seq")
    return both.groupBy("key").agg(F.min_by("sid", "seq").alias("sid"))


def lookup_sid(quotes: DataFrame, index: DataFrame) -> DataFrame:
    """quotes with the snippet of the text of each, as it is or stripped."""
    i = index.toDF("_t", "_sid")
    keys = F.transform(F.array("quote", x.strip_boilerplate(F.col("quote"))), lambda t: F.sha2(t, 256))
    q = quotes.select("*", keys.alias("_keys")).select("*", F.col("_keys")[0].alias("_raw"), F.col("_keys")[1].alias("_stripped"))
    q = q.join(i, F.col("_raw") == F.col("_t"), "left").select(*quotes.columns, "_stripped", F.col("_sid").alias("raw_sid"))
    return q.join(i, F.col("_stripped") == F.col("_t"), "left").select(*quotes.columns, F.coalesce("raw_sid", "_sid").alias("sid"))


def pseudo_relevance(docs: DataFrame, terms: list[str], seq: str, text: str, top_docs: int, top_terms: int) -> DataFrame:
    """(term, df): terms of the first matching documents by document frequency."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for t in terms:
        hit = hit | low.contains(t.lower())
    d = docs.where(hit).orderBy(seq).limit(top_docs)
    tokens = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\b[a-z0-9_\-]+\b"), F.lit(0)), lambda t: F.btrim(t, F.lit("-_")))
    seeds = sorted({w for t in terms for w in t.lower().split()})
    tokens = F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*seeds)))
    return d.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(top_terms)


def rrf_fuse(ranked: DataFrame, k: int = 60) -> DataFrame:
    """(item, score) from (list, rank, item), ranks from 1, by falling score."""
    return ranked.groupBy("item").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), "item")


def competitors(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, competitor, n): words of the titles that name an entity, once per title."""
    e = entities.where(x.in_scope(F.col("scope"), F.col("name"))).select("entity_id", F.lower(F.trim("name")).alias("_name"))
    # Titles of one entity are dealt over SALTS keys, so that no task reads all of them.
    e = e.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    h = hits.withColumn("_salt", F.pmod(F.xxhash64("title"), F.lit(SALTS)).cast("int")).join(e, ["entity_id", "_salt"]).where(F.lower("title").contains(F.col("_name")))
    words = F.transform(F.regexp_extract_all("title", F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0)), lambda t: F.lower(F.btrim(t, F.lit("-_"))))
    words = F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 2) & (t != F.col("_name")) & ~t.isin(*STOP_WORDS)))
    return h.select("entity_id", F.explode(words).alias("competitor")).groupBy("entity_id", "competitor").agg(F.count(F.lit(1)).alias("n"))


def facet_search(entities: DataFrame, facets: list[str], sources: list[str], titles: DataFrame) -> DataFrame:
    """(entity_id, facet, source, title) for plausible entities: each facet in each source."""
    spark = entities.sparkSession
    combos = spark.createDataFrame([(f, s) for f in facets for s in sources], "facet string, source string")
    e = entities.where(x.in_scope(F.col("scope"))).crossJoin(F.broadcast(combos))
    return e.join(titles, ["source", "facet", "name"]).select("entity_id", "facet", "source", "title")


def proxy_golden(df: DataFrame, text: str, pattern: str = PROXY_TOOLS) -> DataFrame:
    return df.where(F.col(text).rlike(pattern))


def fan_out(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """Every query in every source, queries first in order; both are short lists."""
    return queries.crossJoin(F.broadcast(sources))


def profile_topic(topics: DataFrame, registry: DataFrame, fallback=None) -> DataFrame:
    """topics (topic) with the first registry domain of that name or synonym; misses go to the fallback, a column function."""
    terms = registry.select("ord", "domain", F.explode(F.concat(F.array("domain"), "synonyms")).alias("term"))
    terms = terms.groupBy(F.lower(F.trim("term")).alias("term")).agg(F.min_by("domain", "ord").alias("domain"))
    out = topics.join(terms, F.lower(F.trim("topic")) == F.col("term"), "left").drop("term")
    out = out.withColumn("hit", F.col("domain").isNotNull())
    return out.withColumn("domain", F.coalesce("domain", fallback(F.col("topic")))) if fallback else out
