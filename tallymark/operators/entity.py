"""Entity resolution: identifier matches first, then token cosine on candidates that share a token.

Records of one identifier or of equal texts may be any number: they are linked as stars, and their pairs are counted from the sizes of classes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import EntityConfig
from .graph import connected_components
from .running import written


#: Identifiers that one record shares with others, of those that differ in their records.
MOST_SHARED = 16


class Resolution(NamedTuple):
    """clusters: (seq, cluster); journal: one row of counts."""

    clusters: DataFrame
    journal: DataFrame


def token_vectors(records: DataFrame, key: str, *texts: str) -> DataFrame:
    """(key, token, tf, norm) from the lower-case alphanumeric tokens of some columns."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    t = records.select(key, F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))).alias("token"))
    t = t.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    norms = t.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("norm"))
    return t.join(norms, key)


def bag(texts: list[str]) -> Column:
    """The lower-case alphanumeric tokens of some columns, sorted, as one text."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(t), F.lit("")) for t in texts]))
    return F.array_join(F.array_sort(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))), " ")


def cosine_pairs(records: DataFrame, key: str, texts: list[str], least: float) -> DataFrame:
    """(a, b, cosine) of all pairs a < b with cosine >= least > 0.

    Equal token bags are joined once and their pairs spread to the records of the bags. With the
    tokens of each bag in the order of how many bags have them, rarest first, a bag's last tokens
    that are too short a vector to reach the cosine by themselves are left out of the search: two
    bags alike enough share a token among the others. So frequent tokens make no pairs, none is
    lost, and the cosines of the pairs found are taken over all tokens.
    """
    member = records.select(F.col(key).alias("k"), bag(texts).alias("bag"))
    bags = member.groupBy("bag").agg(F.min("k").alias("rep")).where("bag <> ''")
    v = token_vectors(bags, "rep", "bag")
    in_bags = v.groupBy("token").agg(F.count(F.lit(1)).alias("in_bags"))
    rest = Window.partitionBy("rep").orderBy(F.desc("in_bags"), "token").rowsBetween(Window.unboundedPreceding, 0)
    rare = v.join(in_bags, "token").withColumn("rest", F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(rest).cast("double")))
    rare = rare.where(F.col("rest") >= F.col("norm") * (least - 1e-9)).select("rep", "token")
    tried = rare.toDF("a", "token").join(rare.toDF("b", "token"), "token").where("a < b").select("a", "b").distinct()
    left, right = v.toDF("a", "token", "tf_a", "norm_a"), v.toDF("b", "token", "tf_b", "norm_b")
    dots = tried.join(left, "a").join(right, ["b", "token"]).groupBy("a", "b").agg((F.sum(F.col("tf_a") * F.col("tf_b")) / (F.first("norm_a") * F.first("norm_b"))).alias("cosine"))
    dots = dots.where(F.round("cosine", 12) >= least)
    m = member.join(bags, "bag").select("k", "rep")
    out = dots.join(m.toDF("x", "a"), "a").join(m.toDF("y", "b"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
    equal = m.toDF("a", "rep").join(m.toDF("b", "rep"), "rep").where("a < b").select("a", "b", F.lit(1.0).alias("cosine"))
    return out.unionByName(equal)


def shared_identifiers(members: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """(k, ids) of members (k, ids): the identifiers that another member has too, sorted, one for all that the same members have.

    A member with over `most` of them raises a ValueError, as their subsets are counted.
    """
    e = members.select("k", F.explode("ids").alias("i"))
    # Sums and exclusive ors of two hashes tell sets of members apart.
    by = e.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("x")).where("n > 1")
    kept = by.groupBy("n", "s", "x").agg(F.min("i").alias("i")).select("i")
    out = e.join(kept, "i").groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    too_many = F.raise_error(F.lit(f"a record shares over {most} identifiers that differ in their records"))
    return out.select("k", F.when(F.size("ids") > most, too_many).otherwise(F.col("ids")).alias("ids"))


def identifier_subsets(shared: DataFrame) -> DataFrame:
    """(k, part, sign) of (k, ids): every subset of a member's identifiers that isn't empty; sign is 1 for odd sizes, else -1.

    Summed with its sign, the number of pairs that share a subset counts each pair with common identifiers once.
    """
    d = shared.select("k", "ids", F.expr("explode(sequence(1, shiftleft(1, size(ids)) - 1))").alias("m"))
    part = F.filter("ids", lambda x, i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == 1)
    return d.select("k", part.alias("part"), (F.size(part) % 2 * 2 - 1).cast("long").alias("sign"))


def _pairs(n: str) -> Column:
    return F.expr(f"{n} * ({n} - 1) div 2")


class PairCounts(NamedTuple):
    """by_identifier: pairs that share one. within: pairs of equal groups that share none. between: (a, b, pairs) of groups, those that share none."""

    by_identifier: DataFrame
    within: DataFrame
    between: DataFrame


def pair_counts(members: DataFrame, near: DataFrame) -> PairCounts:
    """Counts of pairs of members (k, ids, rep) without the pairs, by inclusion and exclusion over classes.

    rep names a group of equal texts, null for members that resemble none; near has (a, b) of groups that resemble
    each other. Rows grow with members, their subsets of shared identifiers, and near, whatever the size of a group or the use of an identifier.
    """
    parts = identifier_subsets(shared_identifiers(members)).join(members.select("k", "rep"), "k")
    parts = written(parts.groupBy("part", "sign", "rep").agg(F.count(F.lit(1)).alias("n")))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    whole = parts.groupBy("part", "sign").agg(F.sum("n").alias("n"))
    ids = whole.agg(zero(F.col("sign") * _pairs("n"), "pairs"))
    sizes = members.where("rep is not null").groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    equal = sizes.agg(zero(_pairs("n"), "equal"))
    linked = parts.where("rep is not null").agg(zero(F.col("sign") * _pairs("n"), "linked"))
    within = equal.crossJoin(linked).select((F.col("equal") - F.col("linked")).alias("pairs"))
    own = parts.where("rep is not null")
    both = near.select("a", "b").join(own.select(F.col("rep").alias("a"), "part", "sign", F.col("n").alias("na")), "a")
    both = both.join(own.select(F.col("rep").alias("b"), "part", F.col("n").alias("nb")), ["b", "part"])
    both = both.groupBy("a", "b").agg(F.sum(F.col("sign") * F.col("na") * F.col("nb")).alias("linked"))
    between = near.select("a", "b").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").join(both, ["a", "b"], "left")
    return PairCounts(ids, within, between.select("a", "b", (F.col("na") * F.col("nb") - F.coalesce("linked", F.lit(0))).cast("long").alias("pairs")))


def members_of(records: DataFrame, key: str, texts: list[str], context: list[str], similarity=None) -> DataFrame:
    """(k, ids, alike, context): sorted identifiers, the hash of the texts that count as equal, what an adjudicator may see.

    Of texts without a similarity put in the bags of their tokens count, and empty ones resemble nothing.
    """
    if similarity is None:
        text = bag(texts)
        alike = F.when(text != "", F.sha2(text.cast("binary"), 256))
    else:
        alike = F.sha2(F.to_json(F.struct(*texts), {"ignoreNullFields": "false"}).cast("binary"), 256)
    ids = F.array_sort(F.array_distinct(F.filter("ids", lambda i: i.isNotNull())))
    return records.select(F.col(key).alias("k"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), alike.alias("alike"), F.struct(*context).alias("context"))


def class_key(texts: str = "alike", context: str = "context") -> Column:
    """A key of records with equal texts and context; their identifiers may differ."""
    return F.sha2(F.to_json(F.struct(texts, context), {"ignoreNullFields": "false"}).cast("binary"), 256)


def unlinked_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a_class, b_class, n) of pairs of classes of members (k, ids, class): how many pairs of their records share no identifier, from counts as in pair_counts()."""
    sizes = written(members.groupBy("class").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("n")))
    parts = identifier_subsets(shared_identifiers(members)).join(members.select("k", "class"), "k").join(sizes.select("class", "c"), "class")
    parts = written(parts.groupBy(F.xxhash64("part").alias("h"), "part", "sign", "c").agg(F.count(F.lit(1)).alias("n")))
    p = pairs.join(sizes.toDF("a_class", "a", "na"), "a_class").join(sizes.toDF("b_class", "b", "nb"), "b_class")
    p = written(p.select("a_class", "b_class", "a", "b", (F.col("na") * F.col("nb")).alias("n")))
    own = lambda x: parts.select(F.col("c").alias(x), "h", "part", "sign", F.col("n").alias(f"{x}_n"))
    both = p.select("a", "b").join(own("a"), "a").join(own("b").drop("sign"), ["b", "h", "part"])
    both = both.groupBy("a", "b").agg(F.sum(F.col("sign") * F.col("a_n") * F.col("b_n")).alias("linked"))
    return p.join(both, ["a", "b"], "left").select("a_class", "b_class", (F.col("n") - F.coalesce("linked", F.lit(0))).cast("long").alias("n"))


def questions(members: DataFrame, gray: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine, a_context, b_context, n, a_class, b_class): pairs of classes of members (k, ids, rep, context, class) of resembling groups; n counts their
    records' pairs that share no identifier, and pairs without any are left out, as those of asked (a_class, b_class).

    If all of two classes' records share identifiers they are one cluster already, and else one link joins them, since records
    of equal texts hang together: so there is no need to tell records of other identifiers apart, whose lists grow in number with the records.
    """
    classes = members.where("rep is not null").groupBy(F.col("rep").alias("group"), "class").agg(F.min("k").alias("rep"), F.first("context").alias("context"))
    left, right = (classes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("rep", "group", "class", "context")]) for side in "xy")
    d = gray.select(F.col("a").alias("x_group"), F.col("b").alias("y_group"), "cosine").join(left, "x_group").join(right, "y_group")
    first = F.col("x_rep") < F.col("y_rep")
    pick = lambda c: [F.when(first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")), F.when(first, F.col(f"y_{c}")).otherwise(F.col(f"x_{c}"))]
    (a, b), (ka, kb), (ca, cb) = pick("rep"), pick("class"), pick("context")
    d = d.select(a.alias("a"), b.alias("b"), "cosine", ca.alias("a_context"), cb.alias("b_context"), ka.alias("a_class"), kb.alias("b_class"))
    if asked is not None:
        d = d.join(asked.union(asked.select("b_class", "a_class")), ["a_class", "b_class"], "left_anti")
    d = written(d)
    n = unlinked_pairs(members.where("rep is not null").select("k", "ids", "class"), d.select("a_class", "b_class")).where("n > 0")
    return d.join(n, ["a_class", "b_class"]).select("a", "b", "cosine", "a_context", "b_context", "n", "a_class", "b_class")


def resolve(records: DataFrame, key: str = "seq", texts: tuple[str, ...] = ("name", "description"), cfg: EntityConfig = EntityConfig(), adjudicator: Callable[[DataFrame], DataFrame] | None = None, similarity: Callable[[DataFrame, str, list[str], float], DataFrame] | None = None, context: tuple[str, ...] | None = None) -> Resolution:
    """Clusters of records. records has a key without repeats, an array `ids` of strings and text columns.

    Records that share an identifier merge. Of the others pairs with cosine >= auto merge, and those
    in [gray, auto) merge where the adjudicator says so. Pairs are counted and not made: records of one identifier hang on
    the least of them, records of equal texts too, and the journal's counts of pairs come from the sizes of classes.

    The adjudicator takes (a, b, cosine, a_context, b_context, n) and adds a column `same`; null is no. It is asked once for
    two classes of records with the same bag and context (structs of the columns in `context`, by default the texts), of which a < b are the
    least keys and n counts the pairs that share no identifier. similarity stands in for the cosine of tokens: it takes what cosine_pairs takes,
    records of different texts, and returns (a, b, cosine); equal texts count as 1.
    """
    if not cfg.gray <= cfg.auto <= 1:
        raise ValueError("gray must not exceed auto, nor auto 1")
    m = written(members_of(records, key, list(texts), list(context or texts), similarity))
    groups = m.where("alike is not null").groupBy("alike").agg(F.min("k").alias("rep"))
    m = written(m.join(groups, "alike", "left").withColumn("class", class_key()))
    reps = records.join(m.select(F.col("rep").alias(key)).where("rep is not null").distinct(), key, "left_semi")
    near = written((similarity or cosine_pairs)(reps, key, list(texts), cfg.gray).select("a", "b", F.round("cosine", 12).alias("cosine")))
    auto, gray = near.where(F.col("cosine") >= cfg.auto), near.where((F.col("cosine") >= cfg.gray) & (F.col("cosine") < cfg.auto))
    said = near.select("a", "b", F.lit(0).cast("long").alias("n")).limit(0)
    if adjudicator:
        said = written(adjudicator(questions(m, gray).drop("a_class", "b_class")).where("same").select("a", "b", "n"))
    stars = m.select("k", F.explode("ids").alias("i"))
    stars = stars.join(stars.groupBy("i").agg(F.min("k").alias("a")), "i").select("a", F.col("k").alias("b"))
    edges = stars.union(m.select("rep", "k")).union(auto.select("a", "b")).union(said.select("a", "b"))
    clusters = connected_components(m.select(F.col("k").alias("node")), edges).toDF(key, "cluster")
    return Resolution(clusters, journal(m, near, said, cfg))


def journal(members: DataFrame, near: DataFrame, said: DataFrame, cfg: EntityConfig = EntityConfig()) -> DataFrame:
    """One row of counts of pairs: all, gray, merged of themselves, merged by the adjudicator."""
    count = pair_counts(members, near)
    between = count.between.join(near, ["a", "b"])
    total = lambda d, c, name: d.agg(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name))
    n = members.agg(F.count(F.lit(1)).alias("n")).select(_pairs("n").alias("pairs_total"))
    sums = between.agg(*[F.coalesce(F.sum(F.when(c, F.col("pairs"))), F.lit(0)).cast("long").alias(name) for c, name in ((F.col("cosine") >= cfg.auto, "auto"), (F.col("cosine") < cfg.auto, "pairs_gray"))])
    merged = count.by_identifier.toDF("known").crossJoin(count.within.toDF("equal")).crossJoin(sums).select("pairs_gray", (F.col("known") + F.col("equal") + F.col("auto")).alias("merges_auto"))
    return n.crossJoin(merged).crossJoin(total(said, "n", "merges_llm"))


def entities_from_clusters(records: DataFrame, clusters: DataFrame, key: str = "seq") -> DataFrame:
    """(entity_id, name, n_records): first domain, else first name, else 'unknown'; clusters of one id merge."""
    c = records.join(clusters, key).groupBy("cluster").agg(
        F.min_by("name", F.when(F.col("name") != "", F.col(key))).alias("name"),
        F.min_by("domain", F.when(F.col("domain") != "", F.col(key))).alias("domain"),
        F.count(F.lit(1)).alias("n"),
    )
    c = c.withColumn("entity_id", F.coalesce(F.expr("nullif(domain, '')"), F.expr("nullif(name, '')"), F.lit("unknown")))
    return c.groupBy("entity_id").agg(F.min_by("name", "cluster").alias("name"), F.sum("n").cast("long").alias("n_records"))
