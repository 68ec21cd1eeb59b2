"""Hash trees over the contents of entities: digests by range of content hash, and differences that walk down.

A content's SHA-256 says where it lies: a node is an entity and the first hex digits of the hashes below it, so the
same contents make the same tree however the rows are dealt. Equal contents are counted before anything else is
gathered, and only contents of one range at the deepest level, or children of one node, ever meet in a row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of the nodes, from the root to the leaves. At most 256 children a node; a leaf holds the share of
#: 16 ** -6 of an entity's distinct contents: 2,000 of 3 * 10 ** 10.
DIGITS = (0, 2, 4, 6)


@dataclass
class HashTree:
    """Levels from the root to the leaves, each (entity_id, prefix, hash, n); n counts the rows below a node."""

    digits: tuple[int, ...]
    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(entity_id, hash) of whole entities, as snapshot.changed takes them."""
        return self.levels[0].select("entity_id", "hash")


def content_counts(records: DataFrame, entity: str = "entity_id", content: str = "content") -> DataFrame:
    """(entity_id, h, n): each distinct content of an entity by its SHA-256, and how often it has it.

    A null content counts as empty; rows without an entity are left out.
    """
    r = records.where(F.col(entity).isNotNull())
    return r.groupBy(F.col(entity).alias("entity_id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def write_tree(records: DataFrame, path: str, entity: str = "entity_id", content: str = "content", digits: tuple[int, ...] = DIGITS) -> HashTree:
    """The tree of the records as tables in a folder, one a level; records are read once, each level from the table below.

    A leaf's hash is the SHA-256 of its lines `hash:count` in order, another node's that of its children's
    `prefix:hash`. No records make empty tables.
    """
    if digits[0] != 0 or digits[-1] > 64 or list(digits) != sorted(set(digits)):
        raise ValueError("digits go up from 0 to 64 at most")
    spark = records.sparkSession
    below = content_counts(records, entity, content).select("entity_id", F.col("h").alias("prefix"), F.concat_ws(":", "h", "n").alias("item"), "n")
    levels = []
    for k in digits[::-1]:
        node = below.groupBy("entity_id", F.substring("prefix", 1, k).alias("prefix"))
        node = node.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("item")), "\n"), 256).alias("hash"), F.sum("n").alias("n"))
        node.write.parquet(f"{path}/digits={k}")
        levels.insert(0, spark.read.schema(node.schema).parquet(f"{path}/digits={k}"))
        below = levels[0].select("entity_id", "prefix", F.concat_ws(":", "prefix", "hash").alias("item"), "n")
    return HashTree(tuple(digits), levels)


def read_tree(records: DataFrame, path: str, entity: str = "entity_id", digits: tuple[int, ...] = DIGITS) -> HashTree:
    """A tree that write_tree wrote, for entities of the type that records has."""
    kind = records.schema[entity].dataType.simpleString()
    schema = f"entity_id {kind}, prefix string, hash string, n long"
    return HashTree(tuple(digits), [records.sparkSession.read.schema(schema).parquet(f"{path}/digits={k}") for k in digits])


def changed_ranges(before: HashTree, after: HashTree) -> DataFrame:
    """(entity_id, prefix, n_before, n_after): the leaves that differ, with the rows that they had and have.

    Only children of nodes that differ are compared, from the roots down: a level's rows meet the differing nodes of
    the level above first. Entities and ranges that are only on one side have 0 rows on the other.
    """
    if before.digits != after.digits:
        raise ValueError("trees of other digits can't be compared")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    differ, parent = None, 0
    for k, b, a in zip(before.digits, before.levels, after.levels):
        b = b.select("entity_id", "prefix", F.col("hash").alias("_b"), none.alias("_a"), F.col("n").alias("_nb"), zero.alias("_na"))
        a = a.select("entity_id", "prefix", none.alias("_b"), F.col("hash").alias("_a"), zero.alias("_nb"), F.col("n").alias("_na"))
        both = b.unionByName(a)
        if differ is not None:
            above = differ.select(F.col("entity_id").alias("_e"), F.col("prefix").alias("_p"))
            both = both.join(above, (F.col("entity_id") == F.col("_e")) & (F.substring("prefix", 1, parent) == F.col("_p")), "left_semi")
        node = both.groupBy("entity_id", "prefix").agg(F.max("_b").alias("_b"), F.max("_a").alias("_a"), F.sum("_nb").alias("n_before"), F.sum("_na").alias("n_after"))
        differ, parent = node.where(~F.col("_b").eqNullSafe(F.col("_a"))).drop("_b", "_a"), k
    return differ
