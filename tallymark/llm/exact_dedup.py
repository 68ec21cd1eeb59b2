"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Each text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered; then adjacent names are paired, the distinct pairs sorted
and numbered, and so on, until each document is left with one name. Two texts
get the same name after the same number of rounds exactly when they are equal.

Blocks are matched with their numbers by a 64-bit hash so that the raw bytes are
shuffled once. Whether two blocks share a hash is checked on the bytes (the least
and the greatest block of each hash), and blocks of such a hash are numbered and
joined by their bytes, so the names never collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rest_of, unused

BLOCK_BYTES = 2048


def block_names(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(id, h, sha, n, level, name): the identity of each text is (level, name).

    Rows that repeat both id and text give one row with their number n; rows of one id with several
    texts are told apart by a hash of the text. hash_bits weakens the block hash
    and is there for tests.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("raw"), F.xxhash64(text).alias("h"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("raw") / block_bytes).cast("int"), F.lit(1)) - 1), lambda i: F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes)))
    blocks = raw.select("id", "h", "raw", F.posexplode(cut).alias("pos", "block"))
    bh = F.xxhash64("block") if hash_bits == 64 else F.shiftright(F.xxhash64("block"), 64 - hash_bits)
    sha, n = F.when(F.col("pos") == 0, F.sha2("raw", 256)), F.when(F.col("pos") == 0, F.lit(1).cast("long"))
    rows = blocks.select("id", "h", "pos", "block", bh.alias("bh"), sha.alias("sha"), n.alias("n"))

    one = rows.groupBy("bh").agg(F.min("block").alias("block"), F.max("block").alias("last"))
    names = scratch.save(one.sortWithinPartitions("block").select("bh", (F.col("block") != F.col("last")).alias("shared"), F.monotonically_increasing_id().alias("name")))
    shared = names.where("shared").select("bh")
    if shared.isEmpty():
        named = rows.select("id", "h", "pos", "bh", "sha", "n").join(names.select("bh", "name"), "bh")
    else:
        named = rows.select("id", "h", "pos", "bh", "sha", "n").join(names.where("not shared").select("bh", "name"), "bh").drop("bh")
        clash = rows.join(shared, "bh", "left_semi")
        apart = scratch.save(clash.select("block").distinct().sortWithinPartitions("block").select("block", (-1 - F.monotonically_increasing_id()).alias("name")))
        named = named.unionByName(clash.select("id", "h", "pos", "block", "sha", "n").join(apart, "block").drop("block"))

    def gathered(long: DataFrame) -> DataFrame:
        """One row per text with its names in order."""
        g = long.groupBy("id", "h").agg(F.max("sha").alias("sha"), F.sum("n").alias("n"), F.sort_array(F.collect_set(F.struct("pos", "name"))).alias("g"))
        return g.select("id", "h", "sha", "n", F.transform("g", lambda x: x["name"]).alias("names"))

    done, level = [], 0
    state = scratch.save(gathered(named))
    while True:
        done.append(state.where(F.size("names") == 1).select("id", "h", "sha", "n", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = state.where(F.size("names") > 1)
        if rest.isEmpty():
            break
        level += 1
        two = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size("names") / 2).cast("int") - 1),
            lambda i: F.struct(F.get("names", 2 * i).alias("a"), F.get("names", 2 * i + 1).alias("b")),
        )
        pairs = rest.select("id", "h", F.posexplode(two).alias("pos", "two"), "sha", "n").select("id", "h", "pos", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("sha", "n")], "two.a", "two.b")
        # A null marks the lack of a partner at the end of a text; no name is null.
        numbered = scratch.save(pairs.select("a", "b").distinct().sortWithinPartitions("a", "b").select(F.col("a").alias("x"), F.col("b").alias("y"), F.monotonically_increasing_id().alias("name")))
        state = scratch.save(gathered(pairs.join(numbered, (F.col("a") == F.col("x")) & F.col("b").eqNullSafe(F.col("y"))).select("id", "h", "pos", "sha", "n", "name")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, text_hash), one row per document.

    Of equal texts the row with the largest id stays. Texts are compared byte by
    byte with no normalisation; null counts as empty, so null and "" are equal.
    A repeated row (same id and text) gives a row each time, and counts each time. A null id sorts below
    every other, and stays only where its text has no other row. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    ident = scratch.save(block_names(scratch, docs, id_col, text_col, block_bytes, hash_bits))
    groups = ident.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
    each = ident.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return each.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("h").alias("text_hash")
    )


def dedup_stage(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns.

    Rows that repeat doc_id and text stay once, the one of greatest other columns as JSON. Different
    texts of one doc_id, or of none, all stay.
    """
    i, h = unused(docs, "_id"), unused(docs, "_h")
    keep = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h))
    match = F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h))
    kept = docs.join(keep, match, "left_semi")
    again = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if again.isEmpty():
        return kept
    row, text = unused(docs, "_r"), unused(docs, "_t")
    best = F.max_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), F.to_json(F.struct("doc_id", *rest_of(docs)))))
    return kept.groupBy("doc_id", F.coalesce("text", F.lit("")).alias(text)).agg(best.alias(row)).select(f"{row}.*")
