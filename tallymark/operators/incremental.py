"""Resolution of new records against known clusters, batch by batch.

The store holds members with the cluster that each had when it came, the groups of equal texts, identifiers with their
first record, rare tokens of each group, resembling groups, what the adjudicator merged, and which clusters were
merged into which. A batch is compared with these through keys; of the clusters only those that gain an edge are
looked at, and only their entry in the list of merged clusters changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EntityConfig
from ..sources.store import BatchLog
from . import entity
from .graph import connected_components
from .running import written


class ResolutionStore:
    """Clusters of records over batches, the same as entity.resolve() gives for all of them at once.

    A record's key must be new. A cluster's name is its least key, so names stay where keys rise
    from batch to batch; where two clusters merge, the greater name goes. The adjudicator is that of entity.resolve()
    and is asked once for each two classes. Tokens are ranked by the batch that they came with and how many groups had
    them then, later ones as rarer: an order that holds for groups of all batches. A token that becomes frequent later makes more candidates, none is lost.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "seq", texts: tuple[str, ...] = ("name", "description"), cfg: EntityConfig = EntityConfig(), adjudicator: Callable[[DataFrame], DataFrame] | None = None, context: tuple[str, ...] | None = None):
        self.log, self.key, self.texts, self.cfg = BatchLog(spark, path), key, list(texts), cfg
        self.adjudicator, self.context = adjudicator, list(context or texts)

    def _old(self, name: str, like: DataFrame, latest: bool = False) -> DataFrame:
        """A table of the store, or an empty one like the batch's."""
        t = self.log.table(name, latest)
        return like.limit(0) if t is None else t.select(*like.columns)

    def add(self, batch: DataFrame, batch_id: int | str) -> bool:
        """Resolve a batch; False if it was added before."""
        if self.log.has(batch_id):
            return False
        cfg, order = self.cfg, len(self.log.entries())
        m = entity.members_of(batch, self.key, self.texts, self.context)
        m = m.join(batch.select(F.col(self.key).alias("k"), entity.bag(self.texts).alias("bag")), "k")
        found = m.where("alike is not null").groupBy("alike").agg(F.min("k").alias("rep"), F.min("bag").alias("bag"))
        known = self._old("groups", found)
        groups = written(found.join(known.select("alike"), "alike", "left_anti"))
        m = m.drop("bag").join(known.unionByName(groups).select("alike", "rep"), "alike", "left")
        m = written(m.withColumn("class", entity.class_key()))
        vectors = written(entity.token_vectors(groups, "rep", "bag"))
        seen = vectors.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).select("token", F.lit(order).alias("born"), "groups")
        old_tokens = self._old("tokens", seen)
        tokens = written(seen.join(old_tokens.select("token"), "token", "left_anti"))
        rare = written(self._rare(vectors, old_tokens.unionByName(tokens)))
        near = written(self._near(rare, self._old("rare", rare), vectors, known))
        all_near = self._old("near", near).unionByName(near)
        old = self._old("members", m.withColumn("cluster", F.col("k")))
        answers = self._answers(m, old, all_near)
        said = answers.where("same").select("a", "b", "a_class", "b_class")
        e = m.select("k", F.explode("ids").alias("i"))
        first = e.groupBy("i").agg(F.min("k").alias("first"))
        old_first = self._old("identifiers", first)
        edges = e.join(first, "i").select(F.col("first").alias("a"), F.col("k").alias("b")).union(first.join(old_first.toDF("i", "_f"), "i").select("_f", "first"))
        edges = edges.union(m.select("rep", "k")).union(near.where(F.col("cosine") >= cfg.auto).select("a", "b")).union(said.select("a", "b"))
        edges = written(edges.where("a <> b"))
        merged = self._merged(edges, m, old)
        members = m.join(merged.toDF("k", "_c"), "k", "left").withColumn("cluster", F.coalesce("_c", "k")).select(*old.columns)
        away = merged.where("node <> component").join(m.select(F.col("k").alias("node")), "node", "left_anti").toDF("cluster", "to")
        moved = self._old("moved", away, latest=True)
        moved = moved.join(away.toDF("to", "_to"), "to", "left").select("cluster", F.coalesce("_to", "to").alias("to")).unionByName(away)
        tables = {"members": members, "groups": groups.select(*found.columns), "tokens": tokens, "rare": rare, "near": near, "said": said, "moved": moved, "asked": answers.select("a_class", "b_class")}
        tables["identifiers"] = first.join(old_first.select("i"), "i", "left_anti")
        return self.log.commit(batch_id, tables)

    def _rare(self, vectors: DataFrame, tokens: DataFrame) -> DataFrame:
        """(token, rep): tokens of which resembling groups have one in common."""
        w = Window.partitionBy("rep").orderBy("born", F.desc("groups"), "token").rowsBetween(Window.unboundedPreceding, 0)
        d = vectors.join(tokens, "token").withColumn("rest", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w).cast("double")))
        return d.where(F.col("rest") >= F.col("norm") * (self.cfg.gray - 1e-9)).select("token", "rep")

    def _near(self, rare: DataFrame, old_rare: DataFrame, vectors: DataFrame, known: DataFrame) -> DataFrame:
        """(a, b, cosine) of resembling groups of which one at least is new."""
        x = rare.toDF("token", "a")
        tried = x.join(rare.toDF("token", "b"), "token").where("a < b").union(x.join(old_rare.toDF("token", "b"), "token")).select("a", "b").distinct()
        tried = written(tried)
        old = entity.token_vectors(known.join(tried.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi"), "rep", "bag")
        right = vectors.unionByName(old).toDF("b", "token", "tf_b", "norm_b")
        dots = tried.join(vectors.toDF("a", "token", "tf_a", "norm_a"), "a").join(right, ["b", "token"]).groupBy("a", "b")
        dots = dots.agg(F.round(F.sum(F.col("tf_a") * F.col("tf_b")) / (F.first("norm_a") * F.first("norm_b")), 12).alias("cosine"))
        return dots.where(F.col("cosine") >= self.cfg.gray).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")

    def _answers(self, m: DataFrame, old: DataFrame, near: DataFrame) -> DataFrame:
        """(a, b, a_class, b_class, same): records of two classes that the adjudicator was not asked about before, and what it says."""
        gray = near.where(F.col("cosine") < self.cfg.auto)
        here = m.select("rep").where("rep is not null").distinct()
        ends = gray.join(here.toDF("a"), "a", "left_semi").unionByName(gray.join(here.toDF("b"), "b", "left_semi")).distinct()
        if not self.adjudicator:
            ends = ends.limit(0)
        concerned = ends.select(F.col("a").alias("rep")).union(ends.select("b")).distinct()
        columns = ["k", "rep", "ids", "context", "class"]
        both = written(old.join(concerned, "rep", "left_semi").select(*columns).unionByName(m.join(concerned, "rep", "left_semi").select(*columns)))
        asked = entity.questions(both, ends, self.log.table("asked"))
        answers = self.adjudicator(asked) if self.adjudicator else asked.withColumn("same", F.lit(False))
        return written(answers.select("a", "b", "a_class", "b_class", "same"))

    def _merged(self, edges: DataFrame, m: DataFrame, old: DataFrame) -> DataFrame:
        """(node, component) of new records and of clusters that gain an edge, by the names of clusters."""
        ends = edges.select("a").union(edges.select("b")).distinct().toDF("k")
        at = old.join(ends, "k", "left_semi").select("k", "cluster")
        moved = self.log.table("moved", latest=True)
        if moved is not None:
            at = at.join(moved, "cluster", "left").select("k", F.coalesce("to", "cluster").alias("cluster"))
        at = written(at.unionByName(m.select("k", F.col("k").alias("cluster"))))
        e = edges.join(at.toDF("a", "_a"), "a").join(at.toDF("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        e = written(e)
        return written(connected_components(e.select(F.col("a").alias("node")).union(e.select("b")), e))

    def clusters(self) -> DataFrame:
        """(key, cluster) of all records so far."""
        members, moved = self.log.table("members"), self.log.table("moved", latest=True)
        c = members.select("k", "cluster").join(moved, "cluster", "left")
        return c.select(F.col("k").alias(self.key), F.coalesce("to", "cluster").alias("cluster"))

    def journal(self) -> DataFrame:
        """The counts of pairs over all records so far, from the sizes of classes."""
        members, near, said = (self.log.table(t) for t in ("members", "near", "said"))
        n = entity.unlinked_pairs(members.where("rep is not null").select("k", "ids", "class"), said.select("a_class", "b_class"))
        return entity.journal(members.select("k", "ids", "rep"), near, n, self.cfg)
