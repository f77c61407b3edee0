"""Queries of units, evidence, and the resolution of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import blocks as bl
from docloom.operators import names
from docloom.operators import resolution as rs
from docloom.operators import units as un
from docloom.sources.tables import table

C = F.col


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def tx3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a block."""
    lines = table(spark, sf_dir, "documents").select(C("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("position", "text")).filter("text <> ''")
    chunks = bl.retrieval_chunks(lines.withColumn("block_id", F.concat(F.lit("B"), "position")))
    return chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("longest"))


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: a front matter, then their sentences in turn under four headings, some citing a block twice."""
    parts = F.transform(F.split("text", "[.]"), lambda s, i: F.concat(
        F.when(i % 5 == 0, F.concat(F.lit("## "), F.element_at(F.array(*map(F.lit, ("Key Points", "Mentions", "Observations", "Other"))), (i / 5).cast("int") % 4 + 1), F.lit("\n"))).otherwise(""),
        F.lit("- s"), i % 7, F.when(i % 3 == 0, "").otherwise(F.concat(F.lit(" [B000"), i % 4, F.lit(", d1:B0002]")))))
    head = F.concat(F.lit("---\ntitle: 'T"), "doc_id", F.lit("'\nnote [B0009]\n---\n"))
    return table(spark, sf_dir, "documents").select(C("doc_id").alias("page_id"), F.concat(head, F.array_join(parts, "\n")).alias("markdown"))


def tx6_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return un.page_units(_markdown(spark, sf_dir)).select("page_id", "unit_type", F.array_join("block_refs", ",").alias("refs"), "text", "weight")


def tx7_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as units of their part; an order's line numbers below another's as entries."""
    line = table(spark, sf_dir, "lineitem")
    ref = lambda x: F.concat(F.lit("B"), x)
    units = line.select((C("l_partkey") % 50).alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), F.array(ref(C("l_linenumber")), ref(C("l_suppkey") % 5)).alias("block_refs"))
    entries = table(spark, sf_dir, "supplier").select((C("s_suppkey") % 50).alias("page_id"), C("s_suppkey").alias("entry_id"), F.transform(F.sequence(F.lit(0), (C("s_suppkey") % 6).cast("int")), ref).alias("block_refs"))
    return un.attached_units(units, entries).groupBy("page_id", "entry_id").agg(F.count("*").alias("n"))


def tx9_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _markdown(spark, sf_dir)
    return pages.select("page_id", tx.frontmatter(C("markdown"), "title").alias("title"), F.size(tx.section_items(C("markdown"), "Observations")).alias("n_items"), F.length(tx.without_section(C("markdown"), "Key Points")).alias("rest"))


def sr13_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.split(c, " ")
    rows = table(spark, sf_dir, "part").select(
        C("p_partkey").alias("unit_id"), (C("p_partkey") % 10 / 10).alias("page_score"), F.lit(1.3).alias("weight"), (C("p_partkey") % 7 / 7).alias("hybrid"),
        words("p_type").alias("query_tokens"), words("p_name").alias("unit_tokens"), (C("p_partkey") % 3 == 0).alias("in_role"), (C("p_partkey") % 4 / 10).alias("bonus"))
    return un.evidence_scores(rows).select("unit_id", F.round("score", 6).alias("score"))


def sr15_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda x: F.concat(F.lit("B"), x % 7)
    refs = F.when(C("l_suppkey") % 3 == 0, F.array(ref(C("l_suppkey")), ref(C("l_suppkey") + 1))).otherwise(F.array(ref(C("l_suppkey"))))
    rows = table(spark, sf_dir, "lineitem").select((C("l_orderkey") % 40).alias("query_id"), (C("l_partkey") % 5).alias("page_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"), refs.alias("block_refs"), (C("l_partkey") % 101 / 101).alias("score"))
    return un.chosen_paragraphs(rows).select("query_id", "page_id", "unit_id", _joined("block_refs"), "rank")


def sr17_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(C("source").alias("workspace_id"), C("doc_id").alias("item_id"), (C("doc_id") % 17 / 17).alias("score"), "text")
    return un.within_budget(items)


def er5_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, their turns as blocks, two words of each turn as the names of concepts."""
    turns = table(spark, sf_dir, "conversations")
    blocks = turns.select(C("conv_id").alias("document_id"), F.concat(F.lit("B"), "turn").alias("block_id"), "text")
    word = lambda k: F.coalesce(F.get(F.split("text", " "), F.lit(k)), F.lit(""))
    concepts = turns.select(C("conv_id").alias("document_id"), F.concat(F.lit("c"), "turn").alias("slug"), F.array(tx.upper_each(word(0)), word(3)).alias("names"), (C("turn") % 3).cast("double").alias("importance"))
    return names.expanded_mentions(concepts, blocks).select("document_id", "slug", _joined("block_refs"), "mention_count", "importance")


def er10_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = C("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("slug"), F.when(c % 3 == 0, "merge").otherwise("create").alias("action"), F.when(c % 3 == 0, c * 2 % 200).alias("target"), F.array(c, c + 1, c + 1, c * 5 % 900).cast("array<string>").alias("links"))
    rows = rows.withColumns({"slug": C("slug").cast("string"), "target": C("target").cast("string")})
    known = table(spark, sf_dir, "customer").filter("c_nationkey % 4 <> 0").select(c.cast("string").alias("slug"))
    return rs.valid_decisions(rows, known).select("slug", "action", "target", _joined("links"), "warned")


def er11_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("slug"), p.alias("position"), (p % 5 == 0).alias("existing"), C("p_name").alias("title"), C("p_type").alias("definition"), F.array("p_brand", C("p_size").cast("string")).alias("aliases"), (p % 4).alias("importance"))
    slugs = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(p.alias("slug"), (p % 30).alias("canonical"))
    return rs.merged_ledger(rows, slugs).select("canonical", "title", "definition", _joined("aliases"), "importance", "members")


def er13_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(C("o_custkey").alias("key"), o.alias("position"), C("o_orderpriority").alias("text"), F.array(o % 7, C("o_custkey") % 3).cast("array<string>").alias("refs"))
    return rs.merged_items(rows, "key").select("key", "text", _joined("refs"))


def er16_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = C("c_custkey"), C("o_orderkey")
    pages = table(spark, sf_dir, "customer").select((c % 3).alias("workspace_id"), c.alias("page_id"), C("c_name").alias("slug"), F.when(c % 4 == 0, "source").otherwise("concept").alias("page_type"), F.when(c % 5 == 0, "draft").otherwise("active").alias("status"))
    entries = table(spark, sf_dir, "orders").select(C("o_custkey").alias("page_id"), o.alias("entry_id"), C("o_orderpriority").alias("name"))
    found = rs.concept_index(pages, entries)
    return found.select("workspace_id", "page_id", "slug", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["entry_id"].cast("string"), e["name"])), ",").alias("entries"))


def er18_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    updates = line.select(C("l_orderkey").alias("candidate_id"), F.when(C("l_linenumber") % 2 == 0, "same_concept").otherwise("new").alias("relation"), (C("l_partkey") % 90).alias("concept"))
    candidates = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select(C("o_orderkey").alias("candidate_id"), F.concat(F.lit("claim "), C("o_custkey")).alias("claim"))
    known = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("slug"))
    return rs.judged_updates(updates, candidates, known).select("concept", F.size("claims").alias("n"), F.md5(F.array_join("claims", ",")).alias("digest"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C("o_orderkey")
    refs = F.when(o % 6 == 0, F.array()).otherwise(F.array(F.concat(F.lit("d"), C("o_custkey"), F.lit(":B0001")), F.concat(F.lit("d"), o % 9, F.lit(":B0002"))))
    return table(spark, sf_dir, "orders").select((o % 3).alias("workspace_id"), o.alias("slug"), o.alias("position"), F.concat(F.lit("c"), C("o_custkey") % 50).alias("claim"), refs.cast("array<string>").alias("refs"))


def lq1_cluster_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "orders").select((C("o_orderkey") % 3).alias("workspace_id"), C("o_orderkey").alias("slug"), (C("o_orderkey") % 60).alias("cluster"))
    return rs.cluster_claims(_claims(spark, sf_dir), decisions).select("workspace_id", "cluster", _joined("claims"), _joined("sources"))


def lq2_merged_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(o, (o % 40).alias("cluster"), o.alias("position"), F.concat(F.lit("c"), C("o_custkey") % 30).alias("claim"), F.when(o % 21 == 0, C("o_orderpriority")).alias("promotion"))
    part = lambda k: rows.filter(o % 2 == k).drop("o_orderkey")
    return rs.merged_clusters(part(0), part(1)).select("cluster", _joined("claims"), "promotion")


def lq7_concept_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "part").select(C("p_partkey").alias("page_id"))
    cited = table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("page_id"), C("l_orderkey").alias("document_id"))
    live = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(C("o_orderkey").alias("document_id"))
    return rs.concept_sources(concepts, cited, live, cited.filter("document_id % 10 = 0"))


def lq12_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    ref = lambda x: F.concat(F.lit("B"), x)
    refs = F.when(C("l_suppkey") % 4 == 0, F.array()).otherwise(F.array(ref(C("l_linenumber")), ref(C("l_linenumber") + C("l_partkey") % 3)))
    item = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    items = line.select(C("l_orderkey").alias("document_id"), item.alias("item_id"), refs.cast("array<string>").alias("refs")).distinct()
    blocks = line.select(C("l_orderkey").alias("document_id"), ref(C("l_linenumber")).alias("block_id"))
    return rs.reference_guards(items, blocks).select("document_id", "item_id", "reason", _joined("unknown"))


def lq14_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks, two of three ending in numbered entries; concepts cite two turns."""
    turns = table(spark, sf_dir, "conversations")
    entries = F.when(C("turn") % 3 > 0, F.repeat(F.lit(" [12] (1999)"), 40)).otherwise("")
    blocks = turns.select(C("conv_id").alias("document_id"), C("turn").cast("string").alias("block_id"), F.concat("text", entries).alias("text"))
    concepts = turns.select(C("conv_id").alias("document_id"), F.concat(F.lit("c"), "turn").alias("slug"), F.array(C("turn"), C("turn") * 2).cast("array<string>").alias("refs"))
    return rs.demoted(concepts, rs.reference_lists(blocks))


def qa5_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C("p_partkey")
    links = lambda *x: F.array(*x).cast("array<string>")
    action = lambda x: F.element_at(F.array(F.lit("merge"), F.lit("link"), F.lit("new")), (x % 3 + 1).cast("int"))
    option = lambda x, y: F.struct(action(x).alias("action"), links(y, y + 1).alias("links"))
    cases = table(spark, sf_dir, "part").select(p.alias("case_id"), F.array(option(p, p % 5), option(p + 1, p % 4)).alias("options"), action(C("p_size")).alias("chosen"), links(p % 5, p % 4 + 2).alias("links"))
    return rs.decision_scores(cases)


QUERIES = {
    "tx3_chunks": tx3_chunks, "tx6_units": tx6_units, "tx7_attached": tx7_attached, "tx9_sections": tx9_sections, "sr13_evidence": sr13_evidence,
    "sr15_paragraphs": sr15_paragraphs, "sr17_budget": sr17_budget, "er5_mentions": er5_mentions, "er10_decisions": er10_decisions, "er11_ledger": er11_ledger,
    "er13_items": er13_items, "er16_index": er16_index, "er18_updates": er18_updates, "lq1_cluster_claims": lq1_cluster_claims, "lq2_merged_clusters": lq2_merged_clusters,
    "lq7_concept_sources": lq7_concept_sources, "lq12_guards": lq12_guards, "lq14_demoted": lq14_demoted, "qa5_decisions": qa5_decisions,
}

_LINES = "l AS (SELECT doc_id AS page_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) - 1 AS i FROM documents)"

ORACLE_SQL = {
    "tx6_units": f"""
        WITH {_LINES}, u AS (
            SELECT page_id, ['key_point', 'mention', 'observation', 'source_block'][i // 5 % 4 + 1] AS unit_type, 'B000' || i % 4 || ',d1:B0002' AS refs, 's' || i % 7 AS text FROM l WHERE i % 3 <> 0)
        SELECT DISTINCT page_id, unit_type, CASE WHEN refs = 'B0002,d1:B0002' THEN refs ELSE refs END AS refs, text,
               CASE unit_type WHEN 'key_point' THEN 1.35 WHEN 'observation' THEN 1.3 ELSE 1.0 END::double AS weight FROM u WHERE unit_type <> 'mention'""",
    "tx7_attached": """
        WITH u AS (SELECT l_partkey % 50 AS page_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id, [l_linenumber, l_suppkey % 5] AS r FROM lineitem),
        e AS (SELECT s_suppkey % 50 AS page_id, s_suppkey AS entry_id, s_suppkey % 6 AS top FROM supplier),
        f AS (SELECT page_id, unit_id, count(*) AS m, min(entry_id) AS entry_id FROM (SELECT DISTINCT * FROM u) JOIN e USING (page_id) WHERE list_max(r) <= top GROUP BY ALL HAVING count(*) = 1)
        SELECT page_id, f.entry_id, count(*) AS n FROM u LEFT JOIN f USING (page_id, unit_id) GROUP BY ALL""",
    "sr13_evidence": """
        WITH t AS (SELECT *, string_split(p_type, ' ') AS q, string_split(p_name, ' ') AS u FROM part)
        SELECT p_partkey AS unit_id, round(p_partkey % 10 / 10 + p_partkey % 10 / 10 * 1.3::double + p_partkey % 7 / 7
            + 0.2::double * len(list_distinct(list_intersect(q, u))) / greatest(len(list_distinct(q)), 1) + CASE WHEN p_partkey % 3 = 0 THEN 0.25 ELSE 0 END + p_partkey % 4 / 10, 6) AS score FROM t""",
    "sr15_paragraphs": """
        WITH c AS (
            SELECT l_orderkey % 40 AS query_id, l_partkey % 5 AS page_id, l_orderkey || '-' || l_linenumber AS unit_id, l_suppkey % 3 = 0 AS several,
                   'B' || l_suppkey % 7 AS a, 'B' || (l_suppkey + 1) % 7 AS b, l_partkey % 101 / 101 AS score FROM lineitem),
        atoms AS (SELECT *, row_number() OVER (PARTITION BY query_id, page_id, a ORDER BY score DESC, unit_id) AS k FROM c WHERE NOT several),
        named AS (SELECT DISTINCT query_id, page_id, unnest([a, b]) AS a FROM c WHERE several),
        both_ AS (
            SELECT x.query_id, x.page_id, unit_id, x.a AS refs, score, n.a IS NOT NULL AS named FROM atoms x LEFT JOIN named n ON n.query_id = x.query_id AND n.page_id = x.page_id AND n.a = x.a WHERE k = 1
            UNION ALL SELECT query_id, page_id, unit_id, a || ',' || b, score, false FROM c WHERE several)
        SELECT query_id, page_id, unit_id, refs AS block_refs, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, page_id ORDER BY named DESC, score DESC, unit_id)::int AS rank FROM both_) WHERE rank <= 4""",
    "er5_mentions": """
        WITH c AS (SELECT conv_id, turn, [upper(coalesce(string_split(text, ' ')[1], '')), coalesce(string_split(text, ' ')[4], '')] AS names FROM conversations),
        n AS (SELECT conv_id, turn, unnest(names) AS name FROM c),
        m AS (SELECT DISTINCT n.conv_id, n.turn, 'B' || b.turn AS block_id FROM n JOIN conversations b USING (conv_id) WHERE trim(name) <> '' AND contains(lower(b.text), lower(trim(name))))
        SELECT c.conv_id AS document_id, 'c' || c.turn AS slug, coalesce(string_agg(block_id, ',' ORDER BY block_id), '') AS block_refs, count(block_id)::int AS mention_count,
               (c.turn % 3 + 0.25 * count(block_id))::double AS importance FROM c LEFT JOIN m USING (conv_id, turn) GROUP BY c.conv_id, c.turn""",
    "er10_decisions": """
        WITH k AS (SELECT c_custkey AS s FROM customer WHERE c_nationkey % 4 <> 0),
        d AS (SELECT c_custkey AS c, c_custkey % 3 = 0 AS merge, c_custkey * 2 % 200 AS target FROM customer),
        l AS (SELECT DISTINCT c, CASE WHEN c + 1 = link THEN 1 ELSE 2 END AS i, link FROM (SELECT c, unnest([c + 1, c * 5 % 900]) AS link FROM d) WHERE link <> c AND link IN (SELECT s FROM k)),
        g AS (SELECT c, string_agg(link, ',' ORDER BY i) AS links FROM l GROUP BY c),
        j AS (SELECT *, merge AND (target NOT IN (SELECT s FROM k) OR target = c) AS bad FROM d)
        SELECT c::varchar AS slug, CASE WHEN merge AND NOT bad THEN 'merge' ELSE 'create' END AS action, CASE WHEN merge AND NOT bad THEN target::varchar END AS target,
               coalesce(links, '') AS links, bad AS warned FROM j LEFT JOIN g USING (c)""",
    "er11_ledger": """
        WITH m AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 30 ELSE p_partkey END AS canonical FROM part),
        a AS (SELECT canonical, x, min(p) AS p FROM (
            SELECT canonical, p_brand AS x, p_partkey * 2 AS p FROM m UNION ALL SELECT canonical, p_size::varchar, p_partkey * 2 + 1 FROM m) GROUP BY ALL)
        SELECT canonical, arg_min(p_name, (p_partkey % 5 <> 0, p_partkey)) AS title, arg_max(p_type, (length(p_type), -p_partkey)) AS definition, any_value(aliases) AS aliases,
               sum(p_partkey % 4)::bigint AS importance, count(*) AS members
        FROM m JOIN (SELECT canonical, string_agg(x, ',' ORDER BY p) AS aliases FROM a GROUP BY canonical) USING (canonical) GROUP BY canonical""",
    "er13_items": """
        WITH r AS (
            SELECT o_custkey AS key, (o_orderkey % 7)::varchar AS x, o_orderkey * 2 AS p FROM orders
            UNION ALL SELECT o_custkey, (o_custkey % 3)::varchar, o_orderkey * 2 + 1 FROM orders),
        f AS (SELECT key, x, min(p) AS p FROM r GROUP BY ALL)
        SELECT key, arg_min(o_orderpriority, o_orderkey) AS text, any_value(refs) AS refs
        FROM orders JOIN (SELECT key, string_agg(x, ',' ORDER BY p) AS refs FROM f GROUP BY key) ON key = o_custkey GROUP BY key""",
    "er16_index": """
        SELECT c_custkey % 3 AS workspace_id, c_custkey AS page_id, c_name AS slug, string_agg(o_orderkey || ':' || o_orderpriority, ',' ORDER BY o_orderkey) AS entries
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 4 <> 0 AND c_custkey % 5 <> 0 GROUP BY ALL""",
    "er18_updates": """
        WITH u AS (
            SELECT DISTINCT l_partkey % 90 AS concept, 'claim ' || o_custkey AS claim FROM lineitem JOIN orders ON l_orderkey = o_orderkey
            WHERE l_linenumber % 2 = 0 AND o_orderkey % 3 <> 0 AND l_partkey % 90 IN (SELECT s_suppkey FROM supplier))
        SELECT concept, count(*)::int AS n, md5(string_agg(claim, ',' ORDER BY claim)) AS digest FROM u GROUP BY concept""",
    "lq1_cluster_claims": """
        WITH c AS (SELECT o_orderkey % 3 AS w, o_orderkey AS o, 'c' || o_custkey % 50 AS claim, 'd' || o_custkey AS a, 'd' || o_orderkey % 9 AS b FROM orders),
        p AS (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM c k WHERE k.w = c.w AND k.o = c.o % 60) THEN c.o % 60 ELSE c.o END AS cluster FROM c WHERE c.o % 6 <> 0),
        f AS (SELECT w, cluster, claim, min(o) AS o FROM p GROUP BY ALL),
        s AS (SELECT DISTINCT w, cluster, unnest([a, b]) AS s FROM p)
        SELECT w AS workspace_id, cluster, claims, sources FROM (SELECT w, cluster, string_agg(claim, ',' ORDER BY o) AS claims FROM f GROUP BY ALL)
        JOIN (SELECT w, cluster, string_agg(s, ',' ORDER BY s) AS sources FROM s GROUP BY ALL) USING (w, cluster)""",
    "lq2_merged_clusters": """
        WITH r AS (SELECT o_orderkey % 40 AS cluster, o_orderkey % 2 AS late, o_orderkey AS p, 'c' || o_custkey % 30 AS claim, CASE WHEN o_orderkey % 21 = 0 THEN o_orderpriority END AS promotion FROM orders),
        f AS (SELECT cluster, claim, min((late, p)) AS place FROM r GROUP BY ALL)
        SELECT cluster, claims, promotion FROM (SELECT cluster, string_agg(claim, ',' ORDER BY place) AS claims FROM f GROUP BY cluster)
        LEFT JOIN (SELECT cluster, arg_min(promotion, (late, p)) AS promotion FROM r WHERE promotion IS NOT NULL GROUP BY cluster) USING (cluster)""",
    "lq7_concept_sources": """
        WITH a AS (SELECT l_partkey AS page_id, count(DISTINCT l_orderkey) AS live, count(DISTINCT l_orderkey) FILTER (l_orderkey % 10 <> 0) AS missing
                   FROM lineitem WHERE l_orderkey % 5 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL)
        SELECT p_partkey AS page_id, CASE WHEN live IS NULL THEN 'unsourced' ELSE 'relink' END AS state, coalesce(missing, 0) AS missing
        FROM part LEFT JOIN a ON page_id = p_partkey WHERE live IS NULL OR missing > 0""",
    "lq12_guards": """
        WITH i AS (SELECT DISTINCT l_orderkey AS d, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS n, l_suppkey % 4 = 0 AS bare, l_linenumber + l_partkey % 3 AS other FROM lineitem)
        SELECT d AS document_id, n AS item_id, CASE WHEN bare THEN 'no_refs' ELSE 'unknown_refs' END AS reason, CASE WHEN NOT bare THEN 'B' || other END AS unknown
        FROM i WHERE bare OR NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = d AND x.l_linenumber = other)""",
    "lq14_demoted": """
        WITH b AS (
            SELECT conv_id, turn, len(regexp_extract_all(t, '\\[[0-9]+\\]|\\([12][0-9]{3}\\)')) AS n, length(t) AS c
            FROM (SELECT conv_id, turn, text || CASE WHEN turn % 3 > 0 THEN repeat(' [12] (1999)', 40) ELSE '' END AS t FROM conversations)),
        l AS (SELECT conv_id, turn FROM b WHERE n >= 2 AND n * 1000 >= 1.5 * c)
        SELECT conv_id AS document_id, 'c' || turn AS slug FROM conversations x
        WHERE (conv_id, turn) IN (SELECT conv_id, turn FROM l) AND EXISTS (SELECT 1 FROM l WHERE l.conv_id = x.conv_id AND l.turn = x.turn * 2)""",
    "qa5_decisions": """
        WITH o AS (
            SELECT p_partkey AS p, unnest([{'i': 0, 'a': p_partkey % 3, 'y': p_partkey % 5}, {'i': 1, 'a': (p_partkey + 1) % 3, 'y': p_partkey % 4}]) AS o,
                   p_size % 3 AS chosen, list_distinct([p_partkey % 5, p_partkey % 4 + 2]) AS l FROM part),
        t AS (SELECT p, o.i AS i, o.a = chosen AS hit, len(list_filter(l, lambda x: x NOT IN (o.y, o.y + 1)))::int AS extra,
                     ((NOT list_contains(l, o.y))::int + (NOT list_contains(l, o.y + 1))::int)::int AS missing FROM o)
        SELECT p AS case_id, b.hit AS hit, b.extra AS extra, b.missing AS missing
        FROM (SELECT p, arg_min({'hit': hit, 'extra': extra, 'missing': missing}, (NOT hit, missing + extra, i)) AS b FROM t GROUP BY p)""",
}
