"""Every registered query of the core library over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import streaming
from ..functions import expr as x
from ..operators import capability, entity, evaluate, evidence, graph, hashtree, incremental, models, records, running, shortlist, snapshot, text
from ..sources import artifacts, hits
from ..sources.store import BatchLog, RecordStore
from ..streaming import passes

#: The fixed clock of the event queries.
NOW = "2024-03-10 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def signals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "code").when(F.col("event_type") == "view", "forum_issue").when(F.col("event_type") == "signup", "citation").when(F.col("event_type") == "purchase", "product").otherwise("other")
    return e.select(
        "event_id",
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("entity_id"),
        kind.alias("signal_type"),
        F.col("value").alias("primary_count"),
        x.months_before(now(), F.col("ts")).alias("dt_months"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("network"),
    )


def bands(spark: SparkSession, d: str) -> DataFrame:
    e = evidence.entity_evidence(evidence.normalize_evidence(signals(spark, d)))
    b = evidence.assign_band(F.col("score_pct"), F.lit(None).cast("string"), F.col("dead"))
    return e.select("entity_id", "dead", F.round("best", 6).alias("best"), "score_pct", b["band"].alias("band"))


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    Q[f.__name__] = f
    return f


@query
def entity_band(spark, d):
    return bands(spark, d)


@query
def evidence_score(spark, d):
    e = evidence.normalize_evidence(signals(spark, d))
    return e.select("event_id", F.round("usage_pct", 6).alias("usage_pct"), F.round("recency_w", 6).alias("recency_w"), F.round("score", 6).alias("score"), "dead")


@query
def ecdf_usage(spark, d):
    return evidence.ecdf(table(spark, d, "events").select("event_id", "value"), "value", "share").select("event_id", F.round("share", 8).alias("share"))


@query
def winsorize_price(spark, d):
    return evidence.winsorize(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query
def dead_signals(spark, d):
    s = signals(spark, d)
    return s.groupBy("signal_type").agg(F.count(F.lit(1)).alias("n"), F.sum(x.mark_dead(F.col("signal_type"), F.col("dt_months")).cast("int")).cast("long").alias("dead"))


@query
def decay_weights(spark, d):
    o = table(spark, d, "orders")
    dt = x.months_before(F.lit("2002-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return o.select("o_orderkey", dt.alias("dt"), F.round(x.decay_weight(dt, F.lit(24.0)), 8).alias("weight"))


@query
def band_transitions(spark, d):
    """Every band before and after, from the share of each event's value."""
    e = evidence.ecdf(table(spark, d, "events").select("event_id", "user_id", "value"), "value", "share")
    prev = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("leader", "contender", "candidate", "unverified", "odd"))), (F.col("user_id") % 6 + 1).cast("int"))
    g = e.select("event_id", (F.col("share") * 100).alias("score"), prev.alias("prev"), (F.col("event_id") % 7 == 0).alias("dead"))
    b = evidence.assign_band(F.col("score"), F.col("prev"), F.col("dead"))
    return g.select("event_id", F.round("score", 6).alias("score"), "prev", "dead", b["band"].alias("band"), b["flip_from"].alias("flip_from"))


@query
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", x.canonical_url(F.col("url")).alias("canon"))


@query
def url_dedup(spark, d):
    p = table(spark, d, "pages").withColumn("canon", x.canonical_url(F.col("url")))
    return records.first_wins(p, ["canon"], "page_id").select("page_id", "canon")


@query
def dedup_first_text(spark, d):
    return records.first_wins(table(spark, d, "documents").withColumn("h", F.sha2("text", 256)), ["h"], "doc_id").select("doc_id", "h")


@query
def branch_a(spark, d):
    s = text.branch_a(table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text"))
    return s.select("seq", F.sha2("stripped", 256).alias("h"))


@query
def sid_lookup(spark, d):
    s = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("s"), F.col("doc_id")).alias("sid"), F.col("text").alias("raw"), x.strip_boilerplate(F.col("text")).alias("stripped"))
    q = table(spark, d, "documents").select("doc_id", F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("quote"))
    return text.lookup_sid(q, text.sid_index(s)).select("doc_id", "sid")


@query
def comment_cap(spark, d):
    c = records.cap_per_parent(table(spark, d, "conversations"), "conv_id", "turn", "text", 5)
    return c.select("conv_id", "turn", F.sha2("text", 256).alias("h"), "cut")


@query
def comment_enrichment(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("issue_id"), F.col("turn").alias("seq"), F.col("text").alias("body"))
    e = records.enrich_comments(table(spark, d, "customer").select(F.col("c_custkey").alias("issue_id")), c, 3)
    return e.select("issue_id", F.array_join("comments", "|").alias("comments"))


@query
def token_cosine_pairs(spark, d):
    p = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("k"))
    return entity.cosine_pairs(p, "k", ["p_name", "p_type"], 0.7).select("a", "b", F.round("cosine", 6).alias("cosine"))


def _suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("group "), F.col("s_nationkey").cast("string")).alias("name"), F.concat(F.lit("d"), F.col("s_suppkey") % 40).alias("domain"), F.array(F.concat(F.lit("d"), (F.col("s_suppkey") % 40).cast("string"))).alias("ids"), F.lit("").alias("description"))


@query
def resolve_clusters(spark, d):
    s = _suppliers(spark, d)
    r = entity.resolve(s)
    return r.clusters


@query
def resolve_journal(spark, d):
    return entity.resolve(_suppliers(spark, d)).journal


@query
def cluster_entities(spark, d):
    s = _suppliers(spark, d)
    return entity.entities_from_clusters(s, entity.resolve(s).clusters)


def _parties(spark, d):
    """Customers as records: some share identifiers, one of them a ninth of all; many texts are alike but not equal."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    ids = F.array(F.when(k % 4 == 0, text("d", k % 101)), F.when(k % 9 == 0, F.lit("hub")), F.when(k % 12 == 0, text("o", k % 37)), F.when(k % 8 == 0, text("e", k % 101)))
    return c.select(k.alias("seq"), F.array_compact(ids).alias("ids"), F.concat(F.lit("Team "), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_mktsegment")).alias("name"), text("unit ", k % 40).alias("description"), text("u", k % 4).alias("url"))


def _same_party(asked):
    """An adjudicator: the names and URLs that it may see are equal."""
    a, b = F.col("a_context"), F.col("b_context")
    return asked.withColumn("same", (a["name"] == b["name"]) & (a["url"] == b["url"]))


def _party_resolution(spark, d):
    return entity.resolve(_parties(spark, d), adjudicator=_same_party, context=("name", "url"))


@query
def party_clusters(spark, d):
    return _party_resolution(spark, d).clusters


@query
def party_journal(spark, d):
    return _party_resolution(spark, d).journal


def _party_store(spark, d):
    """Customers in three batches, the second one offered twice."""
    store = incremental.ResolutionStore(spark, f"{running.shared_folder(spark)}/parties-{uuid.uuid4().hex}", adjudicator=_same_party, context=("name", "url"))
    for batch in (0, 1, 1, 2):
        store.add(_parties(spark, d).where(F.col("seq") % 3 == batch), batch)
    return store


@query
def party_batches(spark, d):
    """Clusters and journal after all batches."""
    store = _party_store(spark, d)
    return store.clusters().crossJoin(F.broadcast(store.journal()))


@query
def components(spark, d):
    o = table(spark, d, "orders")
    e = o.select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("b"))
    n = e.select(F.col("a").alias("node")).union(e.select("b"))
    return graph.connected_components(n, e)


@query
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("axis"))
    return text.shortlist(e.crossJoin(F.broadcast(q)), "v", F.col("axis"), "vec_id", text.TextConfig(min_cosine=0.05)).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query
def axis_shortlists(spark, d):
    """The best snippets of every source for an axis of each nation and each brand, by counts of hashed words."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("axis")).union(table(spark, d, "part").select("p_brand")).distinct()
    axes = {r.axis: r.vector for r in models.embed(names, "axis", "axis").collect()}  # 25 nations and 25 brands at every size
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("doc_id").alias("seq"), x.strip_boilerplate(F.col("text")).alias("stripped"))
    s = records.first_wins(docs.where("stripped <> ''"), ["entity_id", "stripped"], "seq")
    found = shortlist.shortlists(s.join(models.embed(s, "seq", "stripped"), "seq"), axes)
    return found.withColumn("cosine", F.round("cosine", 6))


@query
def ecdf_passes(spark, d):
    """Events in three passes, the second one offered twice: the share of each value within its pass and those before."""
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("pass"), F.when(F.col("event_id") % 11 > 0, F.floor("value")).alias("value"))
    log, out = BatchLog(spark, f"{running.shared_folder(spark)}/shares-{uuid.uuid4().hex}"), None
    for k in (0, 1, 1, 2):
        part = evidence.ecdf_pass(log, k, e.where(F.col("pass") == k), "value", "share")
        out = part if out is None else out.unionByName(part)
    return out.distinct().select("event_id", "pass", F.round("share", 8).alias("share"))


@query
def hashed_bow(spark, d):
    return text.hashed_bow(table(spark, d, "documents"), "doc_id", "text")


@query
def competitor_cooccurrence(spark, d):
    docs = table(spark, d, "documents")
    e = spark.createDataFrame([("e1", "and", "plausible"), ("e2", "that", "plausible"), ("e3", "in", "below-plausible")], "entity_id string, name string, scope string")
    hits = docs.select(F.explode(F.split("text", "\n")).alias("title")).crossJoin(F.broadcast(e.select("entity_id")))
    return text.competitors(hits, e)


@query
def query_expansion(spark, d):
    return text.pseudo_relevance(table(spark, d, "documents"), ["that"], "doc_id", "text", 20, 50)


@query
def rrf_fusion(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("item")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("v"))
    both = o.withColumn("list", F.lit("orders")).unionByName(c.withColumn("list", F.lit("balance")))
    ranks = both.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(F.desc("v"), "item")))
    return text.rrf_fuse(ranks.select("list", "rank", "item")).select("item", F.round("score", 8).alias("score"))


@query
def authority_topk(spark, d):
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber")
    top = li.withColumn("n", F.row_number().over(w)).where("n <= 20")
    deps = top.groupBy("l_suppkey").agg(F.collect_list(F.col("l_quantity").cast("double")).alias("deps"))
    return deps.select("l_suppkey", x.top_sum(F.col("deps")).alias("authority"))


COMMITS = [("typography refactor", None), ("docs: fix", ["src/a.py"]), ("docs: fix", ["docs/a.md", "README"]), ("Fix bug", ["a.py"]), ("readme", []), ("doc-update", ["LICENSE"]), ("docstring pass", ["x.rst"]), ("", [])]


@query
def cadence_docs_only(spark, d):
    """Each order has one of the commits."""
    kinds = F.array(*[F.struct(F.lit(m).alias("message"), F.lit(f).cast("array<string>").alias("files") if f is None else F.array(*map(F.lit, f)).cast("array<string>").alias("files")) for m, f in COMMITS])
    c = table(spark, d, "orders").select("o_orderkey", F.get(kinds, (F.col("o_orderkey") % len(COMMITS)).cast("int")).alias("c"))
    return c.select("o_orderkey", x.docs_only(F.col("c.message"), F.col("c.files")).alias("docs_only"))


#: Headings that come before the lines of a document in turn; none before some.
HEADINGS = ("# Top", "## Features ##", "### Detail", "", "## Other", "## Benchmarks", "", "### License", "#### Sub", "", "# Limitations", "###### deep", "")


@query
def readme_slice(spark, d):
    """Documents with a heading before each line, sliced by sections."""
    heads = F.array(*map(F.lit, HEADINGS))
    lines = F.transform(F.split("text", "\n"), lambda v, i: F.concat(F.get(heads, ((F.col("doc_id") + i) % len(HEADINGS)).cast("int")), F.lit("\n"), v))
    marked = table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("markdown"))
    return capability.slice_sections(marked, "doc_id", "markdown").select("doc_id", F.sha2("sliced", 256).alias("h"))


@query
def readme_fallback(spark, d):
    s = capability.slice_sections(table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.sha2("sliced", 256).alias("h"))


@query
def parse_replies(spark, d):
    """Replies about documents: two right ones, another label, another key, another field, a list, the text itself."""
    docs = table(spark, d, "documents")
    axis = lambda label, **more: F.struct(F.substring("text", 1, 20).alias("axis"), F.lit(label).alias("classification"), *[F.lit(v).alias(k) for k, v in more.items()])
    report = lambda *axes, **more: F.to_json(F.struct(F.array(*axes).alias("axes"), *[F.lit(v).alias(k) for k, v in more.items()]))
    replies = [report(axis("yes")), report(axis("maybe")), report(axis("no"), more=1), report(axis("partial", x=1)), F.to_json(F.array("text")), F.col("text"), report(axis("no"), axis("unclear"), axis("yes"))]
    kind, reply = F.col("doc_id") % len(replies), F.lit(None).cast("string")
    for k, r in enumerate(replies):
        reply = F.when(kind == k, r).otherwise(reply)
    p = capability.parse_report(reply)
    return docs.select("doc_id", p["valid"].alias("valid"), F.coalesce(F.size(p["axes"]), F.lit(-1)).alias("axes"))


@query
def snapshot_changed(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("text").alias("content"), "doc_id")
    # The pass before: sources up to src3 had other texts, and src9 had another name.
    before = docs.select(F.when(F.col("entity_id") == "src9", "old9").otherwise(F.col("entity_id")).alias("entity_id"), F.when(F.col("entity_id") <= "src3", F.concat(F.col("content"), F.lit(" before"))).otherwise(F.col("content")).alias("content"))
    return snapshot.changed(snapshot.fingerprint(before), snapshot.fingerprint(docs))


@query
def snapshot_ranges(spark, d):
    """Hash trees of two passes, written, and the ranges of content hashes that differ."""
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("text").alias("content"), "doc_id")
    # The pass before: some texts of src3 were others, src9 had another name, and every fifth document of src5 was not there.
    before = docs.where("not (entity_id = 'src5' and doc_id % 5 = 0)").select(
        F.when(F.col("entity_id") == "src9", "old9").otherwise(F.col("entity_id")).alias("entity_id"),
        F.when((F.col("entity_id") == "src3") & (F.col("doc_id") % 7 == 0), F.concat("content", F.lit(" before"))).otherwise(F.col("content")).alias("content"),
    )
    base = f"{running.shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    return hashtree.changed_ranges(hashtree.write_tree(before, f"{base}/before"), hashtree.write_tree(docs, f"{base}/after"))


@query
def fingerprint(spark, d):
    return snapshot.fingerprint(table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("text").alias("content")))


def _orders_now() -> F.Column:
    return F.lit("2001-08-05 00:00:00").cast("timestamp_ntz")


@query
def recrawl_tiers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.bool_or(F.col("o_orderstatus") == "P").alias("p"))
    plan = x.recrawl_plan(F.col("o_custkey") % 10 == 0, F.col("newest"), _orders_now())
    return o.select("o_custkey", plan["tier"].alias("tier"), plan["interval_days"].alias("interval_days"), plan["frozen"].alias("frozen"))


@query
def recrawl_priority(spark, d):
    return snapshot.priority(table(spark, d, "orders"), "o_custkey", "o_orderdate", _orders_now()).select("entity_id", F.round("priority", 6).alias("priority"))


@query
def wake_on_spike(spark, d):
    frozen = spark.createDataFrame([("e-and", "thand"), ("zzz.dev", "Nowhere"), ("inth", "Qqq"), ("", "tion")], "entity_id string, name string")
    return snapshot.wake_on_spike(frozen, table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("title")))


@query
def woken_entities(spark, d):
    """An entity for each turn of a conversation: its first words are the id, its last ones the name; all documents are the titles."""
    o = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("o")
    words = F.filter(F.split("text", "[.,?!\n ]+"), lambda w: w != "")
    # Passed through a lambda and inline, the words are split once; columns of one projection would each split them again.
    named = lambda w: F.struct(F.array_join(F.slice(w, 1, 3), " ").alias("entity_id"), F.array_join(F.when(F.size(w) > 2, F.slice(w, -2, 2)).otherwise(w), " ").alias("name"))
    f = table(spark, d, "conversations").select(o, F.inline(F.transform(F.array(words), named)))
    # A document is one title: a space is between its lines as it is between titles.
    titles = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"))
    return snapshot.mentions(f, titles, ["doc_id"], order="o")


@query
def recall_golden(spark, d):
    g = table(spark, d, "labels").select(F.col("doc_id").alias("snippet_id"), (F.col("quality") == 1).alias("is_true"))
    caught = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("snippet_id"))
    r = evaluate.recall(g, caught)
    return r.withColumn("recall", F.round("recall", 8))


@query
def recall_proxy(spark, d):
    docs = table(spark, d, "documents")
    g = text.proxy_golden(docs, "text", r"(?i)(^|[^A-Za-z0-9_])(license|mit)([^A-Za-z0-9_]|$)").select(F.col("doc_id").alias("snippet_id"), F.lit(True).alias("is_true"))
    return evaluate.recall(g, docs.where("source < 'src5'").select(F.col("doc_id").alias("snippet_id"))).withColumn("recall", F.round("recall", 8))


@query
def kappa_stability(spark, d):
    return evaluate.kappa(table(spark, d, "labels"), "quality", "toxic").withColumn("kappa", F.round("kappa", 8))


@query
def recorded_hits(spark, d):
    """Documents written as recorded replies of three connectors and read back, whole and by bounds on query and count."""
    k, doc = F.col("doc_id") % 3, table(spark, d, "documents")
    id_, title = F.col("doc_id").cast("string"), F.concat(F.lit("t"), "doc_id")
    said = F.when(F.col("doc_id") % 4 == 0, F.split("text", "\n"))
    n = F.coalesce("n_chars", F.lit(0)) % 1000
    shapes = {
        "code": F.struct(id_.alias("id"), F.concat(F.lit("https://code.test/"), id_).alias("html_url"), title.alias("title"), F.col("text").alias("body"), n.alias("stars"), said.alias("comments")),
        "forum": F.struct(id_.alias("objectID"), title.alias("title"), F.col("text").alias("comment_text"), n.alias("points"), said.alias("comments")),
        "citation": F.struct(id_.alias("doi"), title.alias("title"), F.col("text").alias("abstract"), n.alias("cited_by_count"), said.alias("comments")),
    }
    path = f"{running.shared_folder(spark)}/recordings-{uuid.uuid4().hex}"
    for i, (name, shape) in enumerate(shapes.items()):
        doc.where(k == i).select(F.to_json(F.struct(F.col("source").alias("query"), F.array(shape).alias("items"))).alias("value")).write.text(f"{path}/connector={name}")
    h = hits.load(spark, path, split_bytes=1 << 22)
    row = [F.col(c) for c in ("connector", "query", "id", "url", "title", "count", "truncated")] + [F.sha2("body", 256).alias("h"), F.size("comments").alias("said")]
    some = hits.load(spark, path, split_bytes=1 << 22, pushdown=True).where("count > 500 and count >= 300 and query in ('src1', 'src2', 'src3') and query <> 'src2'")
    return h.select(F.lit("all").alias("kind"), *row).unionByName(some.select(F.lit("some").alias("kind"), *row))


@query
def store_antijoin(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"))
    return records.accumulate(records.first_wins(o.where("seq % 5 = 0"), ["k"]), o.where("seq % 5 <> 0"), ["k"])


@query
def store_batches(spark, d):
    """First orders of customers from four batches, one of them offered twice."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), "o_orderdate")
    store = RecordStore(spark, f"{running.shared_folder(spark)}/orders-{uuid.uuid4().hex}", ["k"])
    for batch in (0, 1, 1, 2, 3):
        store.append(o.where(F.col("seq") % 4 == batch), batch)
    return store.read().select("k", "seq", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query
def flag_split(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("repo"))
    kept, flagged = evidence.filter_flagged(c, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "repo string"))
    return kept.withColumn("flagged", F.lit(False)).union(flagged.withColumn("flagged", F.lit(True)))


@query
def fan_out(spark, d):
    return text.fan_out(table(spark, d, "nation").select("n_name"), table(spark, d, "region").select("r_name"))


@query
def registry_lookup(spark, d):
    """A registry of regions, whose nations are synonyms, written and loaded; what customers look up."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    names = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat("n_name", F.lit(" ")))).alias("synonyms"))
    r = region.join(names, F.col("r_regionkey") == F.col("n_regionkey"))
    path = f"{running.shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    r.select(F.col("r_regionkey").cast("int").alias("ord"), F.lower("r_name").alias("domain"), F.array(F.lit("code")).alias("sources"), F.array("r_name").alias("seed_queries"), "synonyms").write.json(path)
    c, k = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_custkey") % 4
    topic = F.when(k == 0, F.concat(F.lit("  "), F.lower("n_name"))).when(k == 1, F.col("n_name")).when(k == 2, F.concat("r_name", F.lit(" "))).otherwise(F.col("c_mktsegment"))
    found = text.profile_topic(c.select("c_custkey", topic.alias("topic")), artifacts.load_registry(spark, path=path), lambda t: F.concat(F.lit("new:"), t))
    return found.select("c_custkey", "topic", "domain", "hit")


@query
def topic_keys(spark, d):
    k = F.col("doc_id") % 3
    topic = F.concat(F.when(k == 0, " V2.1/").when(k == 1, "v10 - ").otherwise("version "), F.substring("text", 1, 40))
    t, h = x.normalize_topic(topic)
    return table(spark, d, "documents").select("doc_id", t.alias("text"), h.alias("key"))


#: Domains that orders are of in turn.
DOMAINS = ("Databases ", "odd", "ai-ml", None, "web-frameworks", "compilers", " DevSecOps", "cloud-native", "DATA-engineering")


@query
def domain_samples(spark, d):
    domain = F.get(F.array(*[F.lit(v) for v in DOMAINS]), (F.col("o_orderkey") % len(DOMAINS)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", x.domain_sample(domain).alias("n"))


@query
def coverage_rollup(spark, d):
    e = table(spark, d, "events").withColumn("v", F.round("value", 2).cast("decimal(18,2)"))
    return evaluate.coverage(e, "event_type", {"total": "v"}).withColumn("total", F.col("total").cast("double"))


@query
def complaint_families(spark, d):
    docs = table(spark, d, "documents").select(F.concat("text", F.when(F.col("lang") == "fr", " It CRASHED and is not  working").otherwise("")).alias("t"), "doc_id")
    return docs.select("doc_id", *x.pattern_flags(F.col("t")))


@query
def report_lines(spark, d):
    b = bands(spark, d).select("entity_id", F.col("entity_id").alias("name"), "band", "score_pct")
    return evaluate.report_lines(b)


@query
def prompts(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_name")).alias("s"))
    return p.select("p_brand", x.extraction_prompt(F.col("s"), F.lit("h")).alias("prompt"))


@query
def token_bucket(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").withColumn("at", F.col("us") / 1e6)
    return streaming.token_bucket(e, "user_id", "at", "event_id", per_minute=2.0)


@query
def band_passes(spark, d):
    """Bands over weekly passes with the band before as state, as a fold over each entity's passes."""
    s = signals(spark, d)
    e = table(spark, d, "events").select("event_id", F.floor(F.dayofyear("ts") / 7).cast("long").alias("pass"), "user_id")
    ev = evidence.normalize_evidence(s).join(e, "event_id").groupBy("user_id", "pass").agg(x.score_percent(F.avg("score")).alias("score"), F.lit(False).alias("dead"))
    steps = F.array_sort(F.collect_list(F.struct("pass", "score")))
    fold = F.aggregate(
        "steps",
        F.struct(F.lit(None).cast("string").alias("band"), F.lit(0).cast("long").alias("flips")),
        lambda a, v: F.struct(evidence.assign_band(v["score"], a["band"], F.lit(False))["band"].alias("band"), (a["flips"] + F.coalesce((a["band"] != evidence.assign_band(v["score"], a["band"], F.lit(False))["band"]).cast("long"), F.lit(0).cast("long"))).alias("flips")),
    )
    return ev.groupBy("user_id").agg(steps.alias("steps")).select("user_id", fold["band"].alias("band"), fold["flips"].alias("flips"))


def _passes(spark, d):
    """Passes of five days over users: mean score, and a hash that doesn't always change. A quarter of the users is away in most passes."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor((F.dayofyear("ts") - 1) / 5).cast("long").alias("pass")).where("user_id % 4 <> 1 or pass in (0, 4)")
    s = evidence.normalize_evidence(signals(spark, d)).select("event_id", "score").join(e, "event_id").groupBy("user_id", "pass")
    s = s.agg(F.round(F.avg("score") * 130 - 15, 6).alias("score"), F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("types"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (F.col("pass") + 1) * 5 * 86400)
    newest = F.timestamp_seconds(F.unix_seconds(at) - F.col("user_id") % 60 * 86400)
    return s.select(F.col("user_id").cast("string").alias("entity_id"), at.alias("at"), "pass", "score", (F.col("user_id") % 13 + F.col("pass") == 9).alias("dead"), F.concat_ws("/", "types", F.col("n") % 2).alias("hash"), F.col("n").cast("string").alias("attributes"), newest.alias("newest"))


@query
def entity_passes(spark, d):
    """A refresh for each pass, each one a run of the stream that goes on from its checkpoint."""
    base = f"{running.shared_folder(spark)}/passes-{uuid.uuid4().hex}"
    all_ = running.written(_passes(spark, d))
    for (number,) in sorted(all_.select("pass").distinct().collect()):
        all_.where(F.col("pass") == number).write.mode("append").parquet(f"{base}/in")
        passes.refresh(spark, f"{base}/in", all_.schema, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("due", F.date_format("due", "yyyy-MM-dd"))


@query
def record_keys(spark, d):
    none = F.lit(None).cast("string")
    k = x.record_key(none, F.col("url"), F.lit(""), F.col("page_id").cast("string"), F.lit("other"))
    return table(spark, d, "pages").select("page_id", k["url"].alias("canon"), k["id"].alias("id"))


@query
def identifier_lists(spark, d):
    blank = F.when(F.col("c_nationkey") % 3 > 0, F.lit(" "))
    keys = x.identifier_keys(blank, F.col("c_name"), F.lit(""), F.when(F.col("c_custkey") % 2 == 0, F.lit("o-1")), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(keys, "|").alias("keys"))


@query
def adjudicator_context(spark, d):
    c = x.build_context(F.col("p_name"), F.lit(None).cast("string"), F.col("p_type"), F.array("p_brand"))
    return table(spark, d, "part").withColumn("c", c).select("p_partkey", F.to_json("c").alias("context"))


@query
def repo_slugs(spark, d):
    url = F.concat(F.when(F.col("n_regionkey") == 1, F.lit("http")).otherwise("https"), F.lit("://github.com/"), "n_name", F.lit("/Repo-"), F.col("n_nationkey").cast("string"), F.lit("/issues?x=1#y"))
    return table(spark, d, "nation").select("n_nationkey", x.repo_slug(url).alias("slug"))


@query
def abstract_rebuild(spark, d):
    words = F.filter(F.split("text", " "), lambda w: w != "")
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words).alias("pos", "word"))
    c = c.groupBy("conv_id", "turn", "word").agg(F.collect_list("pos").alias("places")).groupBy("conv_id", "turn")
    index = c.agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("conv_id", "turn", x.rebuild_abstract(F.col("index")).alias("abstract"))


@query
def fresh_orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", x.is_fresh(F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderdate")), _orders_now(), 365.0).alias("fresh"))


@query
def page_hashes(spark, d):
    plain = x.normalize_for_hash(F.col("html"), ["<[^>]*>", "[ \\t\\n\\r]+"])
    return table(spark, d, "pages").select("page_id", x.content_hash(plain).alias("h"))


@query
def response_headers(spark, d):
    h = F.create_map(F.lit("ETag"), F.col("n_name"), F.lit("LAST-modified"), F.col("n_nationkey").cast("string"), F.lit("x"), F.lit("y"))
    one = F.create_map(F.lit("etag"), F.col("n_name"))
    c = x.conditional_headers(F.when(F.col("n_regionkey") == 0, one).otherwise(h))
    status = F.element_at(F.array(*map(F.lit, ("304", "200", "no", " 304 "))), F.col("n_nationkey") % 4 + 1)
    return table(spark, d, "nation").select("n_nationkey", c["etag"].alias("etag"), c["last_modified"].alias("last_modified"), x.is_not_modified(status).alias("not_modified"))


@query
def recrawl_intervals(spark, d):
    return table(spark, d, "orders").select("o_orderkey", x.recrawl_interval(F.concat("o_orderpriority", F.element_at(F.array(*map(F.lit, ("-Active", "-STABLE", "-frozen", "-dead", ""))), (F.col("o_orderkey") % 5 + 1).cast("int")))).alias("days"))


@query
def audit_prompts(spark, d):
    return table(spark, d, "region").select("r_regionkey", x.audit_prompt(F.col("r_name"), ["query speed", "tenancy"]).alias("prompt"))


@query
def verbatim_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", x.quote_is_verbatim(F.split("text", "\n"), F.concat("lang", F.lit(""))).alias("found"))


@query
def notes_distinct(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]).alias("roles"))
    return c.select("conv_id", F.array_join(x.dedupe_notes(F.col("roles")), "|").alias("notes"))


def _commits(spark, d):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    files = F.when(key % 3 == 0, F.array(F.lit("docs/a.md"), F.lit("src/a.py"))).when(key % 3 == 1, F.array(F.lit("README"), F.lit("b.rst")))
    return o.select("o_orderkey", F.col("o_custkey"), pick(("docs: x", "Fix bug", "README", "typography", "docstring"), key % 5).alias("message"), files.alias("files"))


@query
def cadence_commits(spark, d):
    return evidence.cadence(_commits(spark, d)).select("o_orderkey")


@query
def commit_files(spark, d):
    c = _commits(spark, d).select(F.col("o_custkey").alias("slug"), F.col("o_orderkey").alias("seq"), "message", "files")
    r = records.recent_commits(c.select("slug").distinct(), c, 2)
    return r.select("slug", F.size("commits").alias("n"), F.size(F.filter("commits", lambda v: v["files"].isNotNull())).alias("with_files"))


@query
def carried_forward(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("text").alias("content"), "lang")
    before = docs.select("entity_id", F.when(F.col("entity_id") <= "src3", F.concat("content", F.lit(" before"))).otherwise(F.col("content")).alias("content"))
    marks = snapshot.changed(snapshot.fingerprint(before), snapshot.fingerprint(docs))
    now_ = docs.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    then = docs.where("lang = 'en'").groupBy("entity_id").agg((-F.count(F.lit(1))).alias("n"))
    return snapshot.carry_forward(now_, then, marks, ["n"])


@query
def last_fingerprint(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return snapshot.last_fingerprint(docs)


def _repo_records(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("seq"), F.concat(F.lit("https://github.com/o/r"), (F.col("c_custkey") % 6).cast("string")).alias("url"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey")).alias("stars"), F.lit(None).cast("string").alias("pushed_at"), F.col("c_nationkey").alias("entity_id"))


def _repos(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("o/r"), F.col("n_nationkey").cast("string")).alias("slug"), (F.col("n_nationkey") * 100).cast("long").alias("stars"), F.col("n_name").alias("pushed_at"), F.repeat("n_name", 2000).alias("markdown"))


@query
def repo_enrichment(spark, d):
    """Only the first four repositories are looked up: the feature's limit."""
    return records.enrich_repos(_repo_records(spark, d), _repos(spark, d)).select("c_custkey", "stars", "pushed_at")


@query
def readme_table(spark, d):
    r = records.readmes_of(_repo_records(spark, d), _repos(spark, d).select("slug", "markdown"))
    return r.select("entity_id", F.sha2("markdown", 256).alias("h"))


@query
def facet_titles(spark, d):
    p = table(spark, d, "part")
    e = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id")).withColumn("scope", F.when(F.col("entity_id") % 4 == 0, "below-plausible").when(F.col("entity_id") % 4 == 1, "plausible"))
    titles = p.select(F.col("p_brand").alias("source"), F.col("p_type").alias("facet"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("title"))
    return text.facet_search(e, ["PROMO", "SMALL", "LARGE"], ["Brand#13", "Brand#5"], titles)


def _kinds(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("code", "forum_issue", "citation", "product"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").withColumn("kind", kind)


@query
def snippet_rows(spark, d):
    r = _kinds(spark, d).select(F.col("source").alias("entity_id"), F.col("doc_id").alias("seq"), "kind", F.array("lang", F.lit("")).alias("comments"), F.col("text").alias("body"), F.when(F.col("doc_id") % 8 == 1, "").otherwise(F.col("text")).alias("comment_text"), F.col("lang").alias("title"), F.when(F.col("doc_id") % 8 == 2, F.col("text")).alias("abstract"))
    return records.snippets_of(r).select("entity_id", "seq", "pos", F.sha2("text", 256).alias("h"))


@query
def signal_rows(spark, d):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    r = _kinds(spark, d).select("doc_id", "kind", F.col("n_chars").alias("stars"), (F.col("n_chars") + 1).alias("points"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") + 2).alias("cited_by_count"), (F.col("n_chars") + 3).alias("product_mentions"), day.alias("pushed_at"), F.lit(None).cast("string").alias("created_at"), F.lit(1704067200).alias("created_at_i"), F.when(F.col("doc_id") % 8 == 2, "odd").otherwise(day).alias("publication_date"), day.alias("last_change"))
    return records.build_signals(r, now()).select("doc_id", "signal_type", "primary_count", "dt_months")


@query
def run_kappa(spark, d):
    docs = table(spark, d, "documents")
    run = lambda where, k: docs.where(where).select(F.col("doc_id").alias("entity_id"), F.when(F.length("text") % k < 2, "leader").otherwise("candidate").alias("band"))
    return evaluate.kappa_of_runs(run("doc_id % 5 > 0", 4), run("doc_id % 7 > 0", 8)).withColumn("kappa", F.round("kappa", 8))


def _report(spark, d):
    """Suppliers as entities, regions as findings, event types as stages; and the report of them."""
    s = table(spark, d, "supplier")
    band = F.element_at(F.array(*map(F.lit, ("Leader", "candidate", "odd"))), (F.col("s_suppkey") % 3 + 1).cast("int"))
    axes = F.when(F.col("s_suppkey") % 2 == 0, F.array(F.struct(F.lit("speed").alias("axis"), F.lit("yes").alias("classification")), F.struct(F.lit("size").alias("axis"), F.lit("no").alias("classification"))))
    e = s.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), band.alias("band"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey").cast("int")).alias("score_pct"), axes.alias("axes"), F.create_map(F.lit("zeta"), F.lit(1), F.lit("alpha"), F.lit(2)).alias("competitors"))
    e = e.withColumn("competitors", F.when(F.col("entity_id") % 3 == 0, F.col("competitors")))
    found = table(spark, d, "region").select(F.lit("").alias("tool"), F.col("r_name").alias("entity"), F.when(F.col("r_regionkey") % 2 == 0, "claimed").alias("claim"), F.lit("said").alias("quote"))
    stages = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).cast("string").alias("tokens_in"), F.lit("0").alias("tokens_out"))
    return e, found, evaluate.report_rows(e, stages, found)


@query
def report_whole(spark, d):
    return _report(spark, d)[2]


@query
def published_run(spark, d):
    """Two runs published, the second one offered twice; report lines, entities and findings of the last."""
    e, found, report = _report(spark, d)
    log = BatchLog(spark, f"{running.shared_folder(spark)}/runs-{uuid.uuid4().hex}")
    artifacts.publish(log, "first", report.where("section > 4"), e.where("entity_id % 2 = 0"), found)
    for _ in range(2):
        artifacts.publish(log, "second", report, e, found)
    lines, people, said = (log.table(n, latest=True) for n in ("report_lines", "entities", "findings"))
    out = lines.select(F.lit("report").alias("kind"), F.col("place").cast("string").alias("key"), "line")
    out = out.union(people.select(F.lit("entity"), "entity_id", F.concat_ws("|", "name", "band", "score_pct", F.array_sort(F.map_keys("competitors")))))
    return out.union(said.select(F.lit("finding"), "entity", F.concat_ws("|", "tool", "claim", "quote")))


@query
def topic_profiles(spark, d):
    p = models.profile(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", p["domain"].alias("domain"), F.array_join(p["seed_queries"], "|").alias("seeds"))


@query
def axis_replies(spark, d):
    a = models.classify(F.col("text"), ["the speed", "that size"])
    return table(spark, d, "documents").select("doc_id", a.alias("reply"), models.extract(F.col("text"), ["s1", "s2"], ["s2"]).alias("evidence"))


@query
def bow_vectors(spark, d):
    v = models.embed(table(spark, d, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn")), "k", "text")
    return v.select("k", F.array_join(F.transform("vector", lambda c: c.cast("int").cast("string")), ",").alias("vector"))


QUERIES = dict(Q)
