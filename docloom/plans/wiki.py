"""Queries of the graph, the replay of logs, lint and the concept ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph, lint, replay
from docloom.operators.invalidation import Invalidation, merged_evidence, merged_points
from docloom.sources.tables import table


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers by their orders' numbers."""
    n = F.lit(table(spark, sf_dir, "customer").count())
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("from_page_id"), (F.col("o_orderkey") * 7 % n + 1).alias("to_page_id"), F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("relation"),
        (F.col("o_orderkey") % 100 / 100).alias("confidence"),
    )


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_custkey") % 5 == 0, "deleted").when(F.col("c_custkey") % 7 == 0, "draft").otherwise("active")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), status.alias("status"))


def gr1_active_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 2 == 0, "source_of").otherwise("extracted_concept").alias("relation_type"),
    )
    return graph.active_nodes(_pages(spark, sf_dir), relations)


def gr1_active_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.active_edges(_links(spark, sf_dir), _pages(spark, sf_dir)).groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def gr3_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _pages(spark, sf_dir).filter("page_id % 50 = 1").select(F.col("page_id").alias("query_id"), "page_id")
    edges = _links(spark, sf_dir).filter("relation <> 'r2'").dropDuplicates(["from_page_id", "to_page_id"]).withColumn("confidence", (F.col("from_page_id") * 13 + F.col("to_page_id")) % 1000 / 1000)
    return graph.neighbourhood(seeds, edges)


def gr6_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    bridge = line.select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") % 500).alias("source_page_id"), (F.col("l_partkey") % 40).alias("concept_page_id"))
    tombs = table(spark, sf_dir, "orders").filter("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("document_id"))
    manual = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 500).alias("from_page_id"), (F.col("p_partkey") % 41).alias("to_page_id"), (F.col("p_partkey") % 2 == 0).alias("present")
    ).dropDuplicates(["from_page_id", "to_page_id", "present"]).groupBy("from_page_id", "to_page_id").agg(F.every("present").alias("present"))
    return graph.source_concept_links(bridge, tombs, manual)


def gr7_unordered_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select(
        F.col("from_page_id").alias("source"), F.col("to_page_id").alias("target"), "relation", F.col("confidence"),
    ).withColumn("position", F.col("source") * 10000 + F.col("target") * 3 + F.substring("relation", 2, 1).cast("int"))
    slugs = _pages(spark, sf_dir).filter("page_id % 4 = 0").select(F.col("page_id").alias("slug"), (F.col("page_id") - 1).alias("canonical"))
    return graph.unordered_links(links.select("source", "target", "relation", "position").distinct(), slugs)


def gr8_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree of threes, with every hundredth one a root too."""
    tree = _pages(spark, sf_dir).select(F.col("page_id").alias("node"), F.when(F.col("page_id") > 1, F.floor((F.col("page_id") + 1) / 3)).alias("parent"))
    return graph.descendants(tree, tree.filter("node % 100 = 5").select("node"))


def gr9_related_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 3).alias("ref"), (F.col("l_partkey") % 30).alias("slug"))
    return graph.related_pairs(claims).groupBy("a", "b").agg(F.count("*").alias("documents"))


def _link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("a"), u % 40).alias("artifact"), e.alias("sequence"), F.when(F.col("event_type") == "click", "remove").otherwise("add").alias("op"),
        (u % 9).alias("source"), (e % 5).alias("target"), F.lit("r").alias("relation"), F.when((F.col("event_type") != "click") | (e % 3 == 0), e % 4).alias("entry_id"),
        F.when(e % 17 == 0, F.concat(F.lit("o"), e % 997)).alias("requires_operation"), F.concat(F.lit("o"), e % 500).alias("operation"),
    )


def ev2_supported_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.supported_links(_link_events(spark, sf_dir))


def ev4_surviving_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("page_id"), F.col("event_id").alias("sequence"), "event_type")
    refs = F.array(F.col("sequence") % 31, F.col("sequence") % 37)
    evidence = events.filter("event_type = 'view'").select("page_id", F.col("sequence").alias("evidence_id"), "sequence", refs.alias("refs"))
    invalid = events.filter("event_type = 'error'").select("page_id", (F.col("sequence") % 31).alias("ref"), "sequence")
    deletes = events.filter("sequence % 1009 = 0").select("page_id", "sequence")
    return replay.surviving_evidence(evidence, invalid, deletes).select("page_id", "evidence_id")


def ev4_invalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of users' events as records of pages after the references and claims that later ones invalidated: a row for each part that stays."""
    e, t = F.col("sequence"), F.array().cast("array<bigint>")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_id").alias("sequence"), "event_type")
    claim = lambda n: F.concat(F.lit("c"), e % n)
    records = rows.select(
        "page_id", "sequence", F.when(e % 11 == 0, "manual").otherwise("ingest").alias("artifact_type"), F.when(F.col("event_type") == "error", F.array(e % 31, e % 19)).otherwise(t).alias("invalidated_refs"),
        F.when(e % 50 == 0, F.array(claim(97), claim(41))).otherwise(F.array().cast("array<string>")).alias("invalidated_claims"),
    )
    units = rows.select("page_id", "sequence", claim(97).alias("evidence_id"), F.concat(F.lit("t"), e % 13).alias("claim"), F.array(e % 31, e % 37).alias("refs"))
    left = Invalidation(records, units)
    cited = rows.select("page_id", "sequence", F.explode(F.array(e % 31, e % 29)).alias("ref")).distinct()
    claims = rows.select("page_id", "sequence", F.explode(F.array(claim(97), claim(89))).alias("evidence_id")).distinct()
    points = rows.select("page_id", "sequence", F.lit(0).alias("place"), F.concat(F.lit("t"), e % 13).alias("text"), F.when(e % 2 == 0, F.array(e % 37, e % 31)).otherwise(F.array(e % 23)).alias("refs"))
    changes = rows.select("page_id", "sequence", F.lit(0).alias("place"), F.when(e % 3 < 2, "add").otherwise("move").alias("op"), F.array(e % 31, e % 43).alias("refs"), F.when(e % 4 == 0, F.array(claim(89))).otherwise(F.array().cast("array<string>")).alias("claims"))
    part = lambda df, kind, item: df.select(F.lit(kind).alias("kind"), "page_id", "sequence", item.alias("item"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    out = part(left.left_units(), "unit", F.col("evidence_id")).union(part(left.left_refs(cited), "ref", F.col("ref").cast("string"))).union(part(left.left_claims(claims), "claim", F.col("evidence_id")))
    out = out.union(part(left.left_points(points), "point", F.concat_ws("|", "text", listed(F.col("refs")))))
    return out.union(part(left.left_changes(changes), "change", F.concat_ws("|", "op", listed(F.col("refs")), listed(F.col("claims")))))


def ev5_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contributions: half of them are in the ledger, two thirds are pending, some with another payload, sequence or link."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 100).alias("page_id"), k.alias("operation_id"), (F.col("o_custkey") % 90).alias("document_id"), F.col("o_totalprice").cast("string").alias("payload"), k.alias("sequence"),
        (k % 4 < 3).alias("active"), F.when(k % 5 == 0, k % 9).alias("linked_by"), (k % 13 == 0).alias("source_removed"), F.col("o_orderdate").alias("created_at"),
    )
    other = lambda n, value, c: F.when(k_ % n == 1, value).otherwise(F.col(c)).alias(c)
    k_ = F.col("operation_id")
    pending = rows.filter(k_ % 3 != 0).select(
        "page_id", "operation_id", "document_id", other(10, F.lit("other"), "payload"), F.when(k_ % 7 != 0, other(17, k_ + 1, "sequence")).alias("sequence"), "active", F.when(k_ % 6 != 0, F.col("linked_by")).alias("linked_by"),
        F.when(k_ % 12 == 2, "RESTORE").alias("kind"), (k_ % 101 == 0).alias("rejected"), "created_at", F.when(k_ % 19 == 0, F.col("created_at")).alias("superseded_at"),
    )
    tombstones = table(spark, sf_dir, "customer").filter("c_custkey % 9 = 0").select((F.col("c_custkey") % 90).alias("document_id"), F.to_date(F.lit("1995-06-17")).alias("deleted_at"))
    out = replay.with_pending(rows.filter("operation_id % 2 = 0").drop("created_at"), pending, tombstones)
    return out.groupBy("state", "active").agg(F.count("*").alias("n"), F.sum("operation_id").alias("ids"))


def ev6_undo_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        (e % 700).alias("row_key"), e.alias("id"), F.when(e % 6 != 0, F.concat(F.lit("v"), e % 11)).alias("before_value"), F.when(e % 5 != 0, F.concat(F.lit("v"), e % 13)).alias("after_value")
    )
    last = log.groupBy("row_key").agg(F.max_by(F.struct("after_value"), "id").alias("a"))
    current = last.filter("a.after_value IS NOT NULL").select("row_key", F.when(F.col("row_key") % 9 == 0, "changed").otherwise(F.col("a.after_value")).alias("value"))
    return replay.undo_plan(log, current)


def ev7_merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 80).alias("page_id"), e.alias("sequence"), F.when(e % 3 == 0, " ").otherwise(F.concat(F.lit("t"), e)).alias("title"), F.when(e % 4 == 0, F.concat(F.lit("d"), e)).alias("definition"),
        F.array(e % 5, e % 7).alias("refs"), F.when((F.col("user_id") % 2 == 0) & (e % 3 == 1), F.array(e % 11)).otherwise(F.array().cast("array<bigint>")).alias("mention_refs"),
        F.array(F.concat(F.lit("a"), e % 3)).alias("aliases"), (e % 17).alias("mention_count"), F.col("value").alias("importance"),
    )
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return replay.merged_pages(rows).select("page_id", "title", "definition", listed("refs"), listed("aliases"), "mention_count", "importance", "n")


def ev7_merged_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of pages in its last version, and their distinct key points."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 80).alias("page_id"), e.alias("sequence"), (e % 3).alias("place"), (e % 23).cast("string").alias("evidence_id"), F.concat(F.lit("v"), e % 29).alias("text"), F.array(e % 2).alias("refs"))
    first = lambda df, kind, item: df.select("page_id", F.lit(kind).alias("kind"), item.alias("item"), "first.sequence", "first.place", F.col("text"))
    return first(merged_evidence(rows), "evidence", F.col("evidence_id")).union(first(merged_points(rows.drop("evidence_id")), "point", F.col("refs")[0].cast("string")))


def st2_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit events of users as documents, the odd half on top of the state of the even half."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("document_id"), F.concat(F.lit("w"), F.col("user_id") % 3).alias("workspace_id"), F.col("event_id").alias("revision"),
        F.sha2(F.col("event_type"), 256).alias("content_hash"), F.col("ts").cast("string").alias("created_at"),
    )
    empty = events.limit(0)
    return replay.latest_state(replay.latest_state(empty, events.filter("revision % 2 = 0")), events.filter("revision % 2 = 1"))


def lq5_orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") + F.col("l_partkey") % 2).alias("block_id"), F.col("l_suppkey").alias("page_id"))
    blocks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("block_id"))
    return lint.orphan_refs(cited, blocks).groupBy("page_id").agg(F.count("*").alias("n"))


def lq6_orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).select("from_page_id", "to_page_id", "relation").distinct()
    managed = links.filter("to_page_id % 3 = 0")
    return lint.orphan_links(links, _pages(spark, sf_dir), managed, managed.filter("from_page_id % 2 = 0"))


def lq8_invalidated_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), o.alias("id"), F.when(o % 6 == 0, "failed").otherwise("succeeded").alias("status"), F.when(o % 5 != 0, F.col("o_orderdate")).alias("finished_at"),
        F.col("o_orderdate").alias("created_at"), F.array(o % 4, o % 9, o % 11).alias("refs"),
    )
    return lint.invalidated_refs(runs)


def lq8_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs over customers as documents."""
    o = F.col("o_orderkey")
    relation = lambda n, m: F.struct(F.concat(F.lit("s"), o % n).alias("source"), F.concat(F.lit("t"), o % m).alias("target"), F.when(o % 4 > 0, "related_to").alias("relation"))
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("document_id"), (F.col("o_custkey") % 6).alias("workspace_id"), o.alias("id"), F.when(o % 6 == 0, "failed").otherwise("succeeded").alias("status"),
        F.when(o % 5 != 0, F.col("o_orderdate")).alias("finished_at"), F.col("o_orderdate").alias("created_at"), (o % 8 == 1).alias("reconciled"), F.array((o % 9).cast("string")).alias("invalidated"),
        F.when(o % 3 > 0, F.array(F.concat(F.lit("c"), o % 13), F.concat(F.lit("c"), o % 17))).alias("concepts"), F.array(relation(7, 11), relation(5, 3)).alias("relations"),
    )
    linked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.concat(F.lit("c"), o % 13).alias("slug"))
    return lint.reconciled(runs, linked).withColumn("key", F.replace("key", F.lit("\x1f"), F.lit("|")))


def lq3_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    items = table(spark, sf_dir, "part").select(
        (p % 4).alias("workspace_id"), (p % 20).alias("cluster_id"), F.concat(F.lit("Term "), p % 6).alias("cluster_name"),
        F.when(p % 7 == 0, "no detail").otherwise(F.concat(F.lit("TERM-"), (p / 3).cast("long") % 12, F.lit(" - text"))).alias("line"),
    )
    return lint.promoted_clusters(items)


def lq9_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    entries = table(spark, sf_dir, "customer").select(c.alias("entry_id"), F.when(c % 3 != 0, c * c % 97 + 1).alias("parent_entry_id"), (c % 4 == 0).alias("has_page"))
    references = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 90).alias("entry_id"), (F.col("o_orderkey") % 4).alias("page_id"))
    return lint.entry_decisions(entries, references)


def lq10_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    box = lambda dx, dy: [((F.col("l_partkey") * dx) % 80).cast("double").alias("x0"), ((F.col("l_suppkey") * dy) % 80).cast("double").alias("y0")]
    shape = lambda rows, dx, dy: rows.select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("page"), "id", *box(dx, dy), "l_quantity").select("document_id", "page", "id", "x0", "y0", (F.col("x0") + 10 + F.col("l_quantity")).alias("x1"), (F.col("y0") + 30.0).alias("y1"))
    return lint.box_matches(shape(line.filter("l_partkey % 2 = 0"), 7, 3), shape(line.filter("l_partkey % 2 = 1"), 5, 11))


def lq16_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), (F.col("l_quantity") > 5).alias("passed"),
        (F.col("l_discount") > 0.08).alias("retry"), F.col("l_quantity").cast("double").alias("score"), F.col("l_linenumber").alias("n_blocks"),
        F.when(F.col("l_quantity") > 5, F.array().cast("array<string>")).otherwise(F.array(F.col("l_partkey").cast("string"), F.col("l_returnflag"))).alias("issues"),
    )
    return lint.merged_evaluations(windows).withColumns({"score": F.round("score", 6), "issues": F.array_join("issues", ",")})


def lq19_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each document as quoted by itself and, altered, by every third one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = F.regexp_replace(F.substring("text", 20, 60), " ", "  ")
    quotes = docs.select("doc_id", F.lit(1).alias("quote_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(middle, F.lit("@@"))).otherwise(middle).alias("quote"))
    return lint.quoted(quotes, docs)


def lq20_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 2 == 0, " Part").otherwise("PART"), p % 50, F.when(p % 3 == 0, ".md").otherwise(""))
    items = table(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 5 != 0, p % 8).alias("parent_id"), F.when(p % 4 == 0, "folder").otherwise("document").alias("type"), name.alias("name"))
    return lint.same_names(items)


def er7_resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as incoming concepts, every fourth under a second name that another has; suppliers as known ones."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    slug = lambda n: F.concat(F.lit("i"), n)
    name = lambda n: F.concat(F.lit("n"), n)
    known = table(spark, sf_dir, "supplier").select((s % 3).alias("workspace_id"), F.concat(F.lit("k"), s).alias("slug"), name(s * 10).alias("key"))
    customers = table(spark, sf_dir, "customer").withColumn("workspace_id", c % 3)
    incoming = customers.select("workspace_id", slug(c).alias("slug"), F.explode(F.when(c % 4 == 0, F.array(name(c), name(c + 3))).otherwise(F.array(name(c)))).alias("key"))
    on = F.when(c % 8 == 3, c + 6).when(c % 8 == 1, c + 3).otherwise(c + 12)
    judged = customers.filter("c_custkey % 8 IN (1, 3, 5)").select("workspace_id", slug(c).alias("slug"), slug(on).alias("target"))
    return lint.resolved_names(incoming, known, judged)


def er9_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("i"), F.col("l_orderkey")).alias("incoming_slug"), F.concat(F.lit("c"), F.col("l_partkey")).alias("candidate_slug"),
        F.element_at(F.array(F.lit("same"), F.lit("related"), F.lit("none"), F.lit("none")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("choice"),
        (F.col("l_partkey") % 101 / 100).alias("probability"),
    ).distinct()
    out = lint.judged_pairs(pairs)
    return out.select("incoming_slug", "decision", "merge_into", F.array_join("link_to", ",").alias("link_to"))


QUERIES = {
    "gr1_active_nodes": gr1_active_nodes, "gr1_active_edges": gr1_active_edges, "gr3_neighbourhood": gr3_neighbourhood, "gr6_source_links": gr6_source_links,
    "gr7_unordered_links": gr7_unordered_links, "gr8_descendants": gr8_descendants, "gr9_related_pairs": gr9_related_pairs, "ev2_supported_links": ev2_supported_links,
    "ev4_surviving_evidence": ev4_surviving_evidence, "ev4_invalidated": ev4_invalidated, "ev5_pending": ev5_pending, "ev6_undo_plan": ev6_undo_plan, "ev7_merged_pages": ev7_merged_pages, "ev7_merged_evidence": ev7_merged_evidence,
    "st2_latest_state": st2_latest_state, "lq3_promoted": lq3_promoted, "lq5_orphan_refs": lq5_orphan_refs, "lq6_orphan_links": lq6_orphan_links,
    "lq8_invalidated_refs": lq8_invalidated_refs, "lq8_reconciled": lq8_reconciled, "lq9_decisions": lq9_decisions, "lq10_boxes": lq10_boxes, "lq16_evaluations": lq16_evaluations,
    "lq19_quotes": lq19_quotes, "lq20_same_names": lq20_same_names, "er7_resolved_names": er7_resolved_names, "er9_judgements": er9_judgements,
}

_LINKS = """links AS (
    SELECT o_custkey AS f, o_orderkey * 7 % (SELECT count(*) FROM customer) + 1 AS t, 'r' || o_orderkey % 3 AS relation, o_orderkey % 100 / 100 AS confidence FROM orders)"""
_PAGES = """pages_ AS (SELECT c_custkey AS page_id, CASE WHEN c_custkey % 5 = 0 THEN 'deleted' WHEN c_custkey % 7 = 0 THEN 'draft' ELSE 'active' END AS status FROM customer)"""

ORACLE_SQL = {
    "gr1_active_nodes": f"""
        WITH {_PAGES}, oldest AS (
            SELECT o_custkey AS page_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS document_id FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL)
        SELECT page_id, status, document_id FROM pages_ LEFT JOIN oldest USING (page_id) WHERE status = 'active'""",
    "gr1_active_edges": f"""
        WITH {_LINKS}, {_PAGES}, a AS (SELECT page_id FROM pages_ WHERE status = 'active')
        SELECT relation, count(*) AS n, round(sum(confidence), 4) AS confidence FROM links WHERE f IN (SELECT * FROM a) AND t IN (SELECT * FROM a) GROUP BY relation""",
    "gr3_neighbourhood": f"""
        WITH {_LINKS}, edges AS (SELECT DISTINCT f, t, (f * 13 + t) % 1000 / 1000 AS c FROM links WHERE relation <> 'r2'),
        ways AS (SELECT f AS p, t AS q, f, t, c FROM edges UNION SELECT t, f, f, t, c FROM edges),
        s0 AS (SELECT c_custkey AS query_id, c_custkey AS page_id, 0 AS depth FROM customer WHERE c_custkey % 50 = 1),
        u0 AS (SELECT query_id, 0 AS used FROM s0),
        k1 AS (
            SELECT query_id, f, t, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f, t) AS k
            FROM (SELECT DISTINCT x.query_id, f, t, c FROM s0 x JOIN ways w ON w.p = x.page_id
                  WHERE NOT EXISTS (SELECT 1 FROM (SELECT NULL, NULL WHERE false) b(query_id, page_id) WHERE b.query_id = x.query_id AND b.page_id = w.q))),
        t1 AS (SELECT query_id, f, t FROM k1 JOIN u0 USING (query_id) WHERE k + used <= 200),
        u1 AS (SELECT u.query_id, any_value(used) + count(t.f) AS used FROM u0 u LEFT JOIN t1 t USING (query_id) GROUP BY u.query_id),
        s1 AS (
            SELECT DISTINCT query_id, page_id, 1 AS depth FROM (SELECT query_id, unnest([f, t]) AS page_id FROM t1) e
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, page_id FROM s0) b WHERE b.query_id = e.query_id AND b.page_id = e.page_id)),
        k2 AS (
            SELECT query_id, f, t, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f, t) AS k
            FROM (SELECT DISTINCT x.query_id, f, t, c FROM s1 x JOIN ways w ON w.p = x.page_id
                  WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, page_id FROM s0) b(query_id, page_id) WHERE b.query_id = x.query_id AND b.page_id = w.q))),
        t2 AS (SELECT query_id, f, t FROM k2 JOIN u1 USING (query_id) WHERE k + used <= 200),
        u2 AS (SELECT u.query_id, any_value(used) + count(t.f) AS used FROM u1 u LEFT JOIN t2 t USING (query_id) GROUP BY u.query_id),
        s2 AS (
            SELECT DISTINCT query_id, page_id, 2 AS depth FROM (SELECT query_id, unnest([f, t]) AS page_id FROM t2) e
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, page_id FROM s0 UNION ALL SELECT query_id, page_id FROM s1) b WHERE b.query_id = e.query_id AND b.page_id = e.page_id)),
        k3 AS (
            SELECT query_id, f, t, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, f, t) AS k
            FROM (SELECT DISTINCT x.query_id, f, t, c FROM s2 x JOIN ways w ON w.p = x.page_id
                  WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, page_id FROM s0 UNION ALL SELECT query_id, page_id FROM s1) b(query_id, page_id) WHERE b.query_id = x.query_id AND b.page_id = w.q))),
        t3 AS (SELECT query_id, f, t FROM k3 JOIN u2 USING (query_id) WHERE k + used <= 200),
        u3 AS (SELECT u.query_id, any_value(used) + count(t.f) AS used FROM u2 u LEFT JOIN t3 t USING (query_id) GROUP BY u.query_id),
        s3 AS (
            SELECT DISTINCT query_id, page_id, 3 AS depth FROM (SELECT query_id, unnest([f, t]) AS page_id FROM t3) e
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT query_id, page_id FROM s0 UNION ALL SELECT query_id, page_id FROM s1 UNION ALL SELECT query_id, page_id FROM s2) b WHERE b.query_id = e.query_id AND b.page_id = e.page_id))
        SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""",
    "gr6_source_links": """
        WITH derived AS (SELECT DISTINCT l_orderkey % 500 AS f, l_partkey % 40 AS t FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0)),
        manual AS (SELECT p_partkey % 500 AS f, p_partkey % 41 AS t, bool_and(p_partkey % 2 = 0) AS present FROM part GROUP BY ALL)
        SELECT coalesce(d.f, m.f) AS from_page_id, coalesce(d.t, m.t) AS to_page_id, present IS NOT NULL AS by_hand
        FROM derived d FULL JOIN manual m ON d.f = m.f AND d.t = m.t WHERE coalesce(present, true)""",
    "gr7_unordered_links": f"""
        WITH {_LINKS}, l AS (SELECT DISTINCT f, t, relation, f * 10000 + t * 3 + relation[2]::int AS position FROM links),
        m AS (
            SELECT CASE WHEN f % 4 = 0 AND f IN (SELECT c_custkey FROM customer) THEN f - 1 ELSE f END AS source,
                   CASE WHEN t % 4 = 0 AND t IN (SELECT c_custkey FROM customer) THEN t - 1 ELSE t END AS target, relation, position FROM l)
        SELECT source, target, relation FROM (
            SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY position) AS k FROM m WHERE source <> target) WHERE k = 1""",
    "gr8_descendants": """
        WITH RECURSIVE tree AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN (c_custkey + 1) // 3 END AS parent FROM customer),
        d AS (SELECT node AS root, node, 0 AS depth FROM tree WHERE node % 100 = 5 UNION ALL SELECT root, tree.node, depth + 1 FROM d JOIN tree ON tree.parent = d.node)
        SELECT * FROM d""",
    "gr9_related_pairs": """
        WITH c AS (SELECT DISTINCT l_orderkey AS d, l_linenumber % 3 AS r, l_partkey % 30 AS s FROM lineitem),
        p AS (SELECT DISTINCT x.d, x.s AS a, y.s AS b FROM c x JOIN c y ON x.d = y.d AND x.r = y.r AND x.s < y.s)
        SELECT a, b, count(*) AS documents FROM p GROUP BY ALL""",
    "ev2_supported_links": """
        WITH e AS (
            SELECT 'a' || user_id % 40 AS artifact, event_id AS seq, event_type = 'click' AS gone, user_id % 9 AS source, event_id % 5 AS target, 'r' AS relation,
                   CASE WHEN event_type <> 'click' OR event_id % 3 = 0 THEN event_id % 4 END AS entry_id,
                   CASE WHEN event_id % 17 = 0 THEN 'o' || event_id % 997 END AS needs, 'o' || event_id % 500 AS operation FROM events),
        adds AS (SELECT artifact, source, target, relation, entry_id, max(seq) AS sequence, arg_max({'n': needs}, seq).n AS needs FROM e WHERE NOT gone GROUP BY ALL)
        SELECT artifact, source, target, relation, entry_id, sequence FROM adds a
        WHERE NOT EXISTS (
            SELECT 1 FROM e WHERE gone AND e.artifact = a.artifact AND e.source = a.source AND e.target = a.target AND e.relation = a.relation
              AND (e.entry_id IS NULL OR e.entry_id = a.entry_id) AND e.seq >= a.sequence)
          AND (needs IS NULL OR needs IN (SELECT operation FROM e))""",
    "ev4_surviving_evidence": """
        WITH e AS (SELECT user_id % 60 AS page_id, event_id AS s, event_type FROM events),
        cut AS (SELECT page_id, max(s) AS d FROM e WHERE s % 1009 = 0 GROUP BY ALL)
        SELECT page_id, s AS evidence_id FROM e LEFT JOIN cut USING (page_id)
        WHERE event_type = 'view' AND s > coalesce(d, -1) AND NOT EXISTS (
            SELECT 1 FROM e i WHERE i.event_type = 'error' AND i.page_id = e.page_id AND i.s > e.s AND i.s % 31 IN (e.s % 31, e.s % 37))""",
    "ev4_invalidated": """
        WITH e AS (SELECT user_id AS p, event_id AS s, event_type, event_id % 11 = 0 AS manual FROM events),
        inv AS (SELECT p, ref, max(s) AS last FROM (SELECT p, s, unnest([s % 31, s % 19]) AS ref FROM e WHERE event_type = 'error') GROUP BY ALL),
        stale AS (SELECT e.p, e.s, ref FROM e JOIN inv ON inv.p = e.p AND last > e.s WHERE NOT manual),
        u AS (SELECT p, s, manual, 'c' || s % 97 AS c, unnest([s % 31, s % 37]) AS ref FROM e),
        dropped AS (
            SELECT p, c FROM u JOIN stale USING (p, s, ref)
            UNION SELECT i.p, i.c FROM (SELECT p, s, unnest(['c' || s % 97, 'c' || s % 41]) AS c FROM e WHERE s % 50 = 0) i JOIN e ON e.p = i.p AND e.s < i.s AND NOT e.manual),
        gone AS (SELECT DISTINCT p, s FROM u JOIN dropped USING (p, c) WHERE NOT manual),
        refs AS (SELECT DISTINCT p, s, unnest([s % 31, s % 29]) AS ref FROM e),
        claims AS (SELECT DISTINCT p, s, manual, unnest(['c' || s % 97, 'c' || s % 89]) AS c FROM e),
        points AS (SELECT p, s, unnest(CASE WHEN s % 2 = 0 THEN [s % 37, s % 31] ELSE [s % 23] END) AS ref FROM e),
        adds AS (SELECT p, s, unnest([s % 31, s % 43]) AS ref, unnest([1, 2]) AS place FROM e WHERE s % 3 < 2),
        add_refs AS (SELECT p, s, string_agg(ref::varchar, ',' ORDER BY place) AS refs FROM adds ANTI JOIN stale USING (p, s, ref) GROUP BY ALL),
        add_claims AS (SELECT p, s, c FROM (SELECT p, s, manual, 'c' || s % 89 AS c FROM e WHERE s % 3 < 2 AND s % 4 = 0) WHERE manual OR (p, c) NOT IN (SELECT p, c FROM dropped))
        SELECT 'unit' AS kind, p AS page_id, s AS sequence, 'c' || s % 97 AS item FROM e ANTI JOIN gone USING (p, s)
        UNION ALL SELECT 'ref', p, s, ref::varchar FROM refs WHERE (p, s, ref) NOT IN (SELECT p, s, ref FROM stale)
            AND NOT ((p, s) IN (SELECT p, s FROM gone) AND ref IN (s % 31, s % 37))
        UNION ALL SELECT 'claim', p, s, c FROM claims WHERE manual OR (p, c) NOT IN (SELECT p, c FROM dropped)
        UNION ALL SELECT 'point', p, s, 't' || s % 13 || '|' || CASE WHEN s % 2 = 0 THEN s % 37 || ',' || s % 31 ELSE (s % 23)::varchar END FROM e
            WHERE (p, s) NOT IN (SELECT p, s FROM points JOIN stale USING (p, s, ref))
              AND NOT ((p, s) IN (SELECT p, s FROM gone) AND (s % 2 = 0 OR (s % 31 = s % 37 AND s % 23 = s % 31)))
        UNION ALL SELECT 'change', p, s, 'add|' || coalesce(refs, '') || '|' || coalesce(c, '') FROM add_refs FULL JOIN add_claims USING (p, s)
        UNION ALL SELECT 'change', p, s, 'move|' || s % 31 || ',' || s % 43 || '|' || CASE WHEN s % 4 = 0 THEN 'c' || s % 89 ELSE '' END FROM e WHERE s % 3 = 2""",
    "ev5_pending": """
        WITH r AS (
            SELECT o_orderkey AS k, o_custkey % 90 AS doc, o_orderkey % 4 < 3 AS active, o_orderdate < DATE '1995-06-17' AND o_custkey % 9 = 0 AS trashed,
                   CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 9 END AS link FROM orders),
        w AS (
            SELECT *, k % 2 = 0 AS stored, k % 3 <> 0 AND k % 19 <> 0 AS waiting, active AND NOT trashed AS live,
                   CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 17 = 1 THEN k + 1 ELSE k END END AS ps, CASE WHEN k % 6 <> 0 THEN link END AS pl FROM r),
        j AS (
            SELECT *, k % 10 <> 1 AND (link IS NOT DISTINCT FROM pl OR (k % 12 = 2 AND pl IS NULL AND ps IS NOT NULL))
                      AND active = (live AND k % 13 <> 0) AND (ps IS NULL OR ps = k) AS agrees FROM w WHERE stored OR waiting)
        SELECT CASE WHEN waiting AND k % 101 = 0 THEN 'conflict' WHEN stored AND waiting THEN CASE WHEN agrees THEN 'stored' ELSE 'conflict' END WHEN stored THEN 'stored'
                    WHEN ps IS NULL THEN 'unresolved' ELSE 'pending' END AS state, CASE WHEN stored THEN active ELSE live END AS active, count(*) AS n, sum(k)::bigint AS ids
        FROM j GROUP BY ALL""",
    "ev6_undo_plan": """
        WITH l AS (
            SELECT event_id % 700 AS row_key, event_id AS id, CASE WHEN event_id % 6 <> 0 THEN 'v' || event_id % 11 END AS b, CASE WHEN event_id % 5 <> 0 THEN 'v' || event_id % 13 END AS a FROM events),
        ends AS (SELECT row_key, arg_min({'v': b}, id).v AS b, arg_max({'v': a}, id).v AS a FROM l GROUP BY row_key),
        now AS (SELECT *, CASE WHEN a IS NOT NULL THEN CASE WHEN row_key % 9 = 0 THEN 'changed' ELSE a END END AS v FROM ends)
        SELECT row_key, CASE WHEN v IS DISTINCT FROM a THEN 'conflict' WHEN b IS NOT DISTINCT FROM a THEN 'nothing' WHEN b IS NULL THEN 'delete'
                             WHEN a IS NULL THEN 'insert' ELSE 'update' END AS action, b AS value FROM now""",
    "ev7_merged_pages": """
        WITH e AS (
            SELECT user_id % 80 AS page_id, user_id % 2 = 0 AS even, event_id AS s, CASE WHEN event_id % 3 <> 0 THEN 't' || event_id END AS title, CASE WHEN event_id % 4 = 0 THEN 'd' || event_id END AS definition, value FROM events),
        r AS (SELECT page_id, x, min(k) AS k FROM (SELECT page_id, s % 5 AS x, 2 * s AS k FROM e UNION ALL SELECT page_id, s % 7, 2 * s + 1 FROM e) GROUP BY ALL),
        j AS (SELECT page_id, string_agg(x::varchar, ',' ORDER BY k) AS refs FROM r GROUP BY ALL),
        a AS (SELECT page_id, string_agg(x, ',' ORDER BY k) AS aliases FROM (SELECT page_id, 'a' || s % 3 AS x, min(s) AS k FROM e GROUP BY ALL) GROUP BY ALL),
        m AS (SELECT page_id, count(DISTINCT s % 11) AS mentions FROM e WHERE even AND s % 3 = 1 GROUP BY ALL)
        SELECT page_id, arg_max(title, s) FILTER (title IS NOT NULL) AS title, arg_max(definition, s) FILTER (definition IS NOT NULL) AS definition, any_value(refs) AS refs, any_value(aliases) AS aliases,
               coalesce(any_value(mentions), max(s % 17))::bigint AS mention_count, max(value) AS importance, count(*) AS n
        FROM e JOIN j USING (page_id) JOIN a USING (page_id) LEFT JOIN m USING (page_id) GROUP BY page_id""",
    "ev7_merged_evidence": """
        WITH e AS (SELECT user_id % 80 AS page_id, event_id AS s FROM events)
        SELECT page_id, 'evidence' AS kind, (s % 23)::varchar AS item, min(s) AS sequence, min(s) % 3 AS place, 'v' || max(s) % 29 AS text FROM e GROUP BY page_id, s % 23
        UNION ALL SELECT page_id, 'point', (s % 2)::varchar, min(s), min(s) % 3, 'v' || s % 29 FROM e GROUP BY page_id, s % 2, s % 29""",
    "st2_latest_state": """
        SELECT user_id AS document_id, 'w' || user_id % 3 AS workspace_id, max(event_id) AS revision, sha256(arg_max(event_type, event_id)) AS content_hash,
               regexp_replace(arg_max(ts, event_id)::varchar, '\\.?0+$', '') AS created_at FROM events GROUP BY user_id""",
    "lq3_promoted": """
        WITH t AS (SELECT p_partkey % 4 AS workspace_id, p_partkey % 20 AS cluster_id, 'term ' || p_partkey % 6 AS own, 'term ' || (p_partkey // 3) % 12 AS key FROM part WHERE p_partkey % 7 <> 0)
        SELECT workspace_id, cluster_id, count(DISTINCT key) AS n FROM t WHERE key <> own GROUP BY ALL HAVING count(DISTINCT key) >= 5""",
    "lq5_orphan_refs": """
        SELECT l_suppkey AS page_id, count(*) AS n FROM lineitem x
        WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + x.l_partkey % 2) GROUP BY l_suppkey""",
    "lq6_orphan_links": f"""
        WITH {_LINKS}, {_PAGES}, l AS (SELECT DISTINCT f, t, relation FROM links), g AS (SELECT page_id FROM pages_ WHERE status = 'deleted'),
        r AS (SELECT *, CASE WHEN f IN (SELECT * FROM g) OR t IN (SELECT * FROM g) THEN 'endpoint_deleted' WHEN t % 3 = 0 AND f % 2 <> 0 THEN 'unsupported' END AS reason FROM l)
        SELECT f AS from_page_id, t AS to_page_id, relation, reason FROM r WHERE reason IS NOT NULL""",
    "lq8_invalidated_refs": """
        WITH r AS (SELECT o_custkey AS d, o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS fin, o_orderdate AS cre FROM orders WHERE o_orderkey % 6 <> 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY fin DESC NULLS LAST, cre DESC, id DESC) AS k FROM r),
        x AS (SELECT d, k, unnest([id % 4, id % 9, id % 11]) AS ref FROM k)
        SELECT DISTINCT d AS document_id, ref FROM x WHERE k > 1 AND (d, ref) NOT IN (SELECT d, ref FROM x WHERE k = 1)""",
    "lq8_reconciled": """
        WITH r AS (SELECT o_custkey AS d, o_custkey % 6 AS w, o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS fin, o_orderdate AS cre FROM orders WHERE o_orderkey % 6 <> 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY fin DESC NULLS LAST, cre DESC, id DESC) = 1 AS now FROM r),
        l AS (SELECT d, id % 8 = 1 AS done FROM k WHERE now),
        rel AS (SELECT d, w, now, unnest(['s' || id % 7 || '|t' || id % 11, 's' || id % 5 || '|t' || id % 3]) || '|' || CASE WHEN id % 4 > 0 THEN 'related_to' ELSE '' END AS key FROM k),
        con AS (SELECT d, unnest(['c' || id % 13, 'c' || id % 17]) AS key FROM k WHERE now AND id % 3 > 0)
        SELECT d AS document_id, 'ref' AS kind, d || ':' || id % 9 AS key, true AS removable FROM k JOIN l USING (d) WHERE now AND NOT done
        UNION ALL
        SELECT DISTINCT o_custkey, 'concept', 'c' || o_orderkey % 13, true FROM orders JOIN l ON d = o_custkey WHERE NOT done AND (o_custkey, 'c' || o_orderkey % 13) NOT IN (SELECT d, key FROM con)
        UNION ALL
        SELECT DISTINCT x.d, 'relation', x.key, (x.w, x.key) NOT IN (SELECT w, key FROM rel WHERE now) FROM rel x JOIN l USING (d)
        WHERE NOT x.now AND NOT done AND (x.d, x.key) NOT IN (SELECT d, key FROM rel WHERE now)""",
    "lq9_decisions": """
        WITH e AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * c_custkey % 97 + 1 END AS p, c_custkey % 4 = 0 AS h FROM customer),
        k AS (SELECT p, count(*) AS n FROM e WHERE p IS NOT NULL GROUP BY p), g AS (SELECT o_custkey % 90 AS c, count(DISTINCT o_orderkey % 4) AS n FROM orders GROUP BY ALL),
        j AS (SELECT e.c, h, coalesce(k.n, 0) AS children, coalesce(g.n, 0) AS pages FROM e LEFT JOIN k ON k.p = e.c LEFT JOIN g ON g.c = e.c)
        SELECT c AS entry_id, children, pages, CASE WHEN h AND children <= 2 THEN 'merge_back' WHEN NOT h AND children >= 5 THEN 'split'
               WHEN NOT h AND pages >= 2 THEN 'promote' ELSE 'keep' END AS decision FROM j""",
    "lq10_boxes": """
        WITH s AS (SELECT l_orderkey AS d, l_linenumber % 2 AS page, l_orderkey * 10 + l_linenumber AS id, l_partkey AS p, l_suppkey AS q, l_quantity AS w FROM lineitem),
        b AS (SELECT *, (p * 7 % 80)::double AS x0, (q * 3 % 80)::double AS y0 FROM s WHERE p % 2 = 0),
        c AS (SELECT *, (p * 5 % 80)::double AS x0, (q * 11 % 80)::double AS y0 FROM s WHERE p % 2 = 1),
        m AS (
            SELECT c.id AS cid, b.id AS bid, greatest(least(b.x0 + 10 + b.w, c.x0 + 10 + c.w) - greatest(b.x0, c.x0), 0) * greatest(least(b.y0, c.y0) + 30 - greatest(b.y0, c.y0), 0)
                   / least((10 + b.w) * 30, (10 + c.w) * 30) AS r,
                   c.x0 + (10 + c.w) / 2 BETWEEN b.x0 AND b.x0 + 10 + b.w AND c.y0 + 15 BETWEEN b.y0 AND b.y0 + 30 AS inside
            FROM b JOIN c ON b.d = c.d AND b.page = c.page)
        SELECT cid AS candidate_id, arg_max(bid, (round(r, 9), -bid)) AS box_id, round(max(r), 6) AS ratio FROM m WHERE r >= 0.25 OR inside GROUP BY cid""",
    "lq16_evaluations": """
        SELECT l_orderkey AS document_id, bool_and(l_quantity > 5) AS passed, bool_or(l_discount > 0.08) AS retry,
               round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS score, count(*) AS windows,
               coalesce(string_agg(l_partkey || ',' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (l_quantity <= 5), '') AS issues FROM lineitem GROUP BY ALL""",
    "lq19_quotes": """
        WITH q AS (SELECT doc_id, text, replace(substring(text, 20, 60), ' ', '  ') || CASE WHEN doc_id % 3 = 0 THEN '@@' ELSE '' END AS quote FROM documents)
        SELECT doc_id, 1 AS quote_id, contains(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), trim(regexp_replace(quote, '[ \\t\\n\\r]+', ' ', 'g'))) AS found FROM q""",
    "lq20_same_names": """
        WITH i AS (
            SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 8 END AS parent_id, CASE WHEN p_partkey % 4 = 0 THEN 'folder' ELSE 'document' END AS type,
                   'part' || p_partkey % 50 || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN '.md' ELSE '' END AS same_name FROM part)
        SELECT parent_id, type, same_name, count(*) AS n, min(id) AS first_id FROM i GROUP BY ALL HAVING count(*) > 1""",
    "er7_resolved_names": """
        WITH RECURSIVE i AS (
            SELECT c_custkey % 3 AS w, 'i' || c_custkey AS slug, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['n' || c_custkey, 'n' || c_custkey + 3] ELSE ['n' || c_custkey] END) AS key FROM customer),
        p AS (SELECT *, 0 AS old FROM i UNION ALL SELECT s_suppkey % 3, 'k' || s_suppkey, 'n' || s_suppkey * 10, 1 FROM supplier),
        f AS (SELECT w, slug, min(key) AS f FROM p GROUP BY ALL),
        m AS (SELECT i.w, i.slug, count(DISTINCT p.slug) AS n, min(p.slug) AS t, min(old) AS old FROM i JOIN p ON p.w = i.w AND p.key = i.key AND p.slug <> i.slug GROUP BY ALL),
        d AS (
            SELECT o.w, o.slug, m.t, CASE WHEN n > 1 THEN 'create' WHEN n = 1 AND (old = 1 OR (g.f, m.t) < (f.f, o.slug)) THEN 'merge' ELSE 'judge' END AS decision
            FROM (SELECT DISTINCT w, slug FROM i) o JOIN f USING (w, slug) LEFT JOIN m USING (w, slug) LEFT JOIN f g ON g.w = o.w AND g.slug = m.t),
        j AS (
            SELECT c_custkey % 3 AS w, 'i' || c_custkey AS slug, 'i' || c_custkey + CASE c_custkey % 8 WHEN 3 THEN 6 WHEN 1 THEN 3 ELSE 12 END AS t
            FROM customer WHERE c_custkey % 8 IN (1, 3, 5)),
        s AS (SELECT w, slug, t FROM d WHERE decision = 'merge' UNION ALL SELECT j.* FROM j JOIN d USING (w, slug) WHERE decision = 'judge' AND (j.w, j.t) IN (SELECT w, slug FROM p)),
        k AS (
            SELECT w, slug, t, [slug] AS seen FROM d WHERE decision = 'merge'
            UNION ALL SELECT k.w, k.slug, s.t, list_append(seen, k.t) FROM k JOIN s ON s.w = k.w AND s.slug = k.t WHERE NOT list_contains(seen, k.t))
        SELECT d.w AS workspace_id, d.slug, any_value(decision) AS decision, arg_max(k.t, len(seen)) AS merge_into FROM d LEFT JOIN k ON k.w = d.w AND k.slug = d.slug GROUP BY ALL""",
    "er9_judgements": """
        WITH p AS (
            SELECT DISTINCT 'i' || l_orderkey AS i, 'c' || l_partkey AS c, ['same', 'related', 'none', 'none'][(l_suppkey % 4 + 1)::int] AS choice, l_partkey % 101 / 100 AS pr FROM lineitem),
        s AS (
            SELECT i, arg_max(c, (pr, c)) FILTER (choice = 'same') AS merge_into,
                   coalesce(string_agg(c, ',' ORDER BY pr DESC, c) FILTER (choice = 'related' AND pr >= 0.9), '') AS links FROM p GROUP BY i)
        SELECT i AS incoming_slug, CASE WHEN merge_into IS NOT NULL THEN 'merge' WHEN links <> '' THEN 'link' ELSE 'new' END AS decision, merge_into,
               CASE WHEN merge_into IS NULL THEN links ELSE '' END AS link_to FROM s""",
}
