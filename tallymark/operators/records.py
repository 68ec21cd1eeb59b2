"""Records: deduplication, stores, caps, snippets, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DiscoveryConfig
from ..functions import expr as x


def first_wins(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of least seq for each key."""
    w = Window.partitionBy(*keys).orderBy(seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cap_per_parent(children: DataFrame, parent: str, seq: str, body: str, most: int, cfg: DiscoveryConfig = DiscoveryConfig()) -> DataFrame:
    """The first rows of each parent, their bodies cut by characters, and whether each was cut."""
    w = Window.partitionBy(parent).orderBy(seq)
    c = children.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    return c.withColumn("cut", F.length(body) > cfg.max_chars).withColumn(body, F.substring(body, 1, cfg.max_chars))


def accumulate(store: DataFrame, batch: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """store with the records of the batch that it lacks, of several the first."""
    fresh = first_wins(batch, keys, seq).join(store.select(*keys).distinct(), [batch[k].eqNullSafe(store[k]) for k in keys], "left_anti")
    return store.unionByName(fresh, allowMissingColumns=True)


def enrich_comments(issues: DataFrame, comments: DataFrame, most: int) -> DataFrame:
    """issues with their first comments as an ordered array; issues without any get an empty one."""
    w = Window.partitionBy("issue_id").orderBy("seq")
    c = comments.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    c = c.groupBy("issue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "body"))), lambda s: s["body"]).alias("comments"))
    return issues.join(c, "issue_id", "left").withColumn("comments", F.coalesce("comments", F.array().cast("array<string>")))


def enrich_repos(records: DataFrame, repos: DataFrame, most: int = 4) -> DataFrame:
    """records joined to a dimension of repositories by slug; only the first few slugs by seq are looked up."""
    slugs = records.withColumn("slug", x.repo_slug(F.col("url")))
    few = slugs.where("slug is not null").groupBy("slug").agg(F.min("seq").alias("s")).orderBy("s").limit(most).select("slug")
    dim = repos.join(F.broadcast(few), "slug").select("slug", F.col("stars").alias("_stars"), F.col("pushed_at").alias("_pushed"))
    return slugs.join(dim, "slug", "left").withColumn("stars", F.coalesce("stars", "_stars")).withColumn("pushed_at", F.coalesce("pushed_at", "_pushed")).drop("_stars", "_pushed")


def readmes_of(records: DataFrame, readmes: DataFrame, most_chars: int = 8000) -> DataFrame:
    """(entity_id, markdown) of entities whose first record by seq names a repository; readmes has slug and markdown."""
    first = records.groupBy("entity_id").agg(F.min_by("url", "seq").alias("url")).withColumn("slug", x.repo_slug(F.col("url")))
    return first.join(readmes, "slug").select("entity_id", F.substring("markdown", 1, most_chars).alias("markdown"))


def recent_commits(repos: DataFrame, commits: DataFrame, most_files: int = 5) -> DataFrame:
    """(slug, commits): the commits of each repository in order, with their files for the first few that look like documentation.

    commits has slug, seq, message and files; the other commits keep null files, as they are not looked up.
    """
    looks = F.lower(F.trim("message")).rlike(x.DOC_MESSAGE)
    w = Window.partitionBy("slug").orderBy("seq")
    c = commits.withColumn("_n", F.sum(looks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = c.withColumn("files", F.when(looks & (F.col("_n") <= most_files), F.col("files")))
    c = c.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("seq", "message", "files"))).alias("commits"))
    return repos.select("slug").join(c, "slug", "left")


def snippets_of(records: DataFrame) -> DataFrame:
    """(entity_id, seq, pos, text): by kind, code its comments then body, forum comment or title, citation abstract or title, other title."""
    one = lambda c: F.array(c)
    texts = (
        F.when(F.col("kind") == "code", F.concat(F.coalesce("comments", F.array().cast("array<string>")), one(F.col("body"))))
        .when(F.col("kind") == "forum_issue", one(x.truthy(F.col("comment_text"), F.col("title"))))
        .when(F.col("kind") == "citation", one(x.truthy(F.col("abstract"), F.col("title"))))
        .otherwise(one(F.col("title")))
    )
    return records.select("entity_id", "seq", F.posexplode(F.filter(texts, lambda t: t != "")).alias("pos", "text"))


def build_signals(records: DataFrame, now) -> DataFrame:
    """One signal per record by its kind, with the count and the age that the kind is judged by."""
    k = F.col("kind")
    count = F.when(k == "code", F.col("stars")).when(k == "forum_issue", F.col("points")).when(k == "citation", F.col("cited_by_count")).when(k == "product", F.col("product_mentions"))
    then = (
        F.when(k == "code", F.col("pushed_at").try_cast("timestamp_ntz"))
        .when(k == "forum_issue", F.coalesce(F.col("created_at").try_cast("timestamp_ntz"), F.timestamp_seconds("created_at_i").cast("timestamp_ntz")))
        .when(k == "citation", F.col("publication_date").try_cast("timestamp_ntz"))
        .when(k == "product", F.col("last_change").try_cast("timestamp_ntz"))
    )
    out = records.withColumn("signal_type", k).withColumn("primary_count", F.coalesce(count, F.lit(0)).cast("double"))
    return out.withColumn("dt_months", x.months_before(now, then))
