"""Queries of the concept ledger, evidence, page views, guards and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import concepts
from docloom.plans.wiki import _LINKS, _PAGES, _links, _pages
from docloom.sources.tables import table


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a number of their own."""
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey"))


def sc9_language_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.language_score(F.col("text")), 6).alias("score"))


def er2_merged_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir).select(
        (F.col("l_suppkey") % 30).alias("document_id"), (F.col("l_partkey") % 20).alias("key"), F.col("pos").alias("position"),
        F.array(F.col("l_partkey") % 4, F.col("l_suppkey") % 4).alias("anchors"), F.expr("repeat('x', cast(l_quantity AS int))").alias("text"),
    )
    merged = concepts.merged_terms(line)
    return merged.select("document_id", "key", F.array_join("anchors", ",").alias("anchors"), F.length("text").alias("longest"))


def er3_merged_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("document_id"), (F.col("o_orderkey") % 15).alias("name_key"), F.concat(F.lit("s"), F.col("o_orderkey")).alias("slug"),
        F.floor("o_totalprice").cast("double").alias("importance"), F.col("o_orderkey").cast("int").alias("rank"), F.array(F.col("o_orderkey") % 3).alias("aliases"),
    )
    merged = concepts.merged_concepts(rows)
    return merged.select("document_id", "name_key", "slug", F.round("importance", 2).alias("importance"), F.array_join("aliases", ",").alias("aliases"))


def er4_attached_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    known = table(spark, sf_dir, "part").select((p % 10).alias("document_id"), F.concat(F.lit("n"), p % 70).alias("name_key"), F.concat(F.lit("s"), p % 90).alias("slug"))
    o = F.col("o_orderkey")
    hint = F.when(o % 3 == 0, F.concat(F.lit("s"), o % 90)).otherwise(F.concat(F.lit("n"), o % 80))
    evidence = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("document_id"), o.alias("evidence_id"), hint.alias("hint"))
    return concepts.attached_evidence(evidence, known).groupBy("document_id", "slug").agg(F.count("*").alias("n"))


def er6_split_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    aliases = table(spark, sf_dir, "customer").select(c.alias("slug"), (c * 7 % 200).alias("key"))
    titles = table(spark, sf_dir, "customer").select(c.alias("slug"), (c % 300).alias("key"))
    return concepts.split_aliases(aliases, titles)


def sr14_evidence_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _line(spark, sf_dir).select(
        (F.col("l_orderkey") % 300).alias("query_id"), (F.col("l_suppkey") % 6).alias("page_id"), F.col("pos").alias("unit_id"), (F.col("l_partkey") % 97).alias("text"),
        ((F.col("l_quantity") * 7 + F.col("l_partkey")) % 100 / 100).alias("score"),
    )
    return concepts.evidence_band(scored).select("query_id", "rank", "unit_id", "score")


def sr14_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidates: orders in groups are queries, suppliers pages, every other candidate names two blocks."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    block = lambda x: F.concat(F.lit("B"), x)
    candidates = _line(spark, sf_dir).select(
        (F.col("l_orderkey") % 300).alias("query_id"), (q % 6).alias("page_id"), (q % 6 * 7 % 6 + q % 2).alias("page_rank"), F.col("pos").alias("place"), (q % 3).alias("document_id"), F.concat(F.lit("t"), p % 19).alias("text"),
        F.when(p % 2 == 0, F.array(block(p % 5), block(q % 4))).otherwise(F.array(block(p % 5))).alias("blocks"), ((F.col("l_quantity") * 7 + p) % 100 / 100 - 0.1).cast("double").alias("score"),
    )
    return concepts.selected_evidence(candidates, least=0.05).withColumn("score", F.round("score", 6))


def gr2_page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page_id"), (F.col("o_orderkey") % 50).alias("document_id"), F.when(F.col("o_orderkey") % 2 == 0, "source_of").otherwise("extracted_concept").alias("relation_type")
    )
    view = concepts.page_view(_pages(spark, sf_dir), relations, _links(spark, sf_dir))
    return view.select("page_id", F.array_join("documents", ",").alias("documents"), F.array_join("related", ",").alias("related"))


def ev8_living_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "error", "manual").when(F.col("event_type") == "click", "evidence").otherwise("note")
    refs = F.when(e % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), e % 5, F.lit(":B0001"))))
    records = table(spark, sf_dir, "events").select((u * 31 + e % 40).alias("page_id"), kind.alias("kind"), refs.alias("refs"))
    return concepts.living_pages(records).select("page_id", "lives", F.array_join("documents", ",").alias("documents"))


def lq11_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    entries = table(spark, sf_dir, "customer").select(c.alias("page_id"), (c % 9).alias("entry_id"))
    references = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("home_page_id"), (o % 9).alias("entry_id"), o.alias("reference_id"))
    return concepts.dangling_references(references, entries, _pages(spark, sf_dir)).select("reference_id", "home_page_id")


def lq13_ungrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir)
    number = lambda c: tx.number_tokens(F.concat_ws(" ", F.lit("about"), *c))
    items = line.select(F.col("l_orderkey").alias("document_id"), F.col("pos").alias("item_id"), number([F.col("l_partkey").cast("string")]).alias("numbers"), F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("refs"))
    blocks = line.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ref"), number([F.col("l_suppkey").cast("string"), (F.col("l_partkey") - F.col("l_partkey") % 2).cast("string")]).alias("numbers"))
    found = concepts.ungrounded_numbers(items, blocks)
    return found.select("document_id", "item_id", F.array_join("missing", ",").alias("missing"))


def lq15_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _line(spark, sf_dir).select(
        (F.col("l_orderkey") % 200).alias("document_id"), (F.col("l_partkey") % 9).alias("signature"), F.col("pos").alias("position"),
        F.expr("repeat('s', cast(l_quantity AS int))").alias("summary"), F.sequence(F.lit(1), F.col("l_linenumber").cast("int")).alias("anchors"), F.array(F.col("l_suppkey")).alias("claims"),
    )
    kept = concepts.kept_observations(line)
    return kept.select("document_id", "signature", F.length("summary").alias("length"), F.size("anchors").alias("anchors"), "n")


def us6_purge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = lambda c: (F.col(c) % 7).alias("workspace_id")
    return concepts.purge_counts(
        F.col("workspace_id").isin(2, 5),
        orders=table(spark, sf_dir, "orders").select(space("o_custkey")), events=table(spark, sf_dir, "events").select(space("user_id")), customers=table(spark, sf_dir, "customer").select(space("c_custkey")),
    )


def us7_without_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda c, m: F.concat(F.lit("d"), F.col(c) % m, F.lit(":B0001"))
    clusters = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).alias("workspace_id"), (F.col("l_partkey") % 50).alias("cluster_id"), F.array(ref("l_partkey", 3), ref("l_suppkey", 3)).alias("refs"))
    return concepts.without_document(clusters, F.lit("d1"))


def qa6_granularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select((o % 2).alias("run"), F.col("o_custkey").alias("document_id"), o.alias("page_id"), (o % 3).alias("head"))
    links = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("run"), F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    return concepts.granularity(pages, links)


QUERIES = {
    "sc9_language_score": sc9_language_score, "er2_merged_terms": er2_merged_terms, "er3_merged_concepts": er3_merged_concepts, "er4_attached_evidence": er4_attached_evidence,
    "er6_split_aliases": er6_split_aliases, "sr14_evidence_band": sr14_evidence_band, "sr14_evidence": sr14_evidence, "gr2_page_view": gr2_page_view, "ev8_living_pages": ev8_living_pages,
    "lq11_dangling": lq11_dangling, "lq13_ungrounded": lq13_ungrounded, "lq15_observations": lq15_observations, "us6_purge_counts": us6_purge_counts,
    "us7_without_document": us7_without_document, "qa6_granularity": qa6_granularity,
}

_COMMON = ", ".join(f"'{w}'" for w in tx.COMMON_WORDS)
_POS = "l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey"

ORACLE_SQL = {
    "sc9_language_score": rf"""
        WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents),
        w AS (SELECT *, regexp_extract_all(f, '[A-Za-z]+') AS w, len(regexp_extract_all(f, '\p{{L}}')) AS letters FROM t)
        SELECT doc_id, CASE WHEN f = '' THEN -100.0 ELSE round(letters / greatest(1, length(f)) + len(regexp_extract_all(f, '[aeiouAEIOU]')) / greatest(1, letters) * 0.3
            + len(list_filter(w, lambda x: lower(x) IN ({_COMMON}))) / greatest(1, len(w)) * 0.5 - len(regexp_extract_all(f, '[^\p{{L}}\p{{N}}_\s.,:;!?%+\-/()]{{2,}}')) * 0.3
            - len(list_filter(regexp_extract_all(f, '[A-Za-z0-9]+'), lambda x: regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]'))) / greatest(1, len(w)) * 0.5
            - len(list_filter(w, lambda x: regexp_matches(x, '^[B-DF-HJ-NP-TV-Z]{{3,}}$'))) / greatest(1, len(w)) * 0.4, 6) END AS score FROM w""",
    "er2_merged_terms": f"""
        WITH l AS (SELECT l_suppkey % 30 AS d, l_partkey % 20 AS k, {_POS} AS pos, l_partkey % 4 AS a, l_suppkey % 4 AS b, l_quantity AS q FROM lineitem),
        x AS (
            SELECT d, k, x, min(p) AS f FROM (
                SELECT d, k, a AS x, {{'p': pos, 'x': [a, b], 'i': 0}} AS p FROM l UNION ALL SELECT d, k, b, {{'p': pos, 'x': [a, b], 'i': 1}} FROM l) GROUP BY ALL),
        j AS (SELECT d, k, string_agg(x::varchar, ',' ORDER BY f) AS anchors FROM x GROUP BY ALL)
        SELECT d AS document_id, k AS key, anchors, max(q)::int AS longest FROM l JOIN j USING (d, k) GROUP BY ALL""",
    "er3_merged_concepts": """
        WITH c AS (SELECT o_custkey % 40 AS d, o_orderkey % 15 AS k, o_orderkey AS r, floor(o_totalprice) AS imp FROM orders),
        a AS (SELECT d, k, r % 3 AS x, min(r) AS f FROM c GROUP BY ALL),
        j AS (SELECT d, k, string_agg(x::varchar, ',' ORDER BY f) AS aliases FROM a GROUP BY ALL)
        SELECT d AS document_id, k AS name_key, 's' || min(r) AS slug, round(arg_min(imp, r) + 0.5 * (sum(imp) - arg_min(imp, r)) + greatest(0, 10 - min(r)), 2) AS importance, aliases
        FROM c JOIN j USING (d, k) GROUP BY d, k, aliases""",
    "er4_attached_evidence": """
        WITH c AS (SELECT p_partkey % 10 AS d, 'n' || p_partkey % 70 AS k, 's' || p_partkey % 90 AS s FROM part),
        u AS (SELECT d, k, min(s) AS s FROM c GROUP BY d, k HAVING count(DISTINCT s) = 1), g AS (SELECT DISTINCT d, s FROM c),
        e AS (SELECT o_custkey % 10 AS d, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey % 90 ELSE 'n' || o_orderkey % 80 END AS h FROM orders)
        SELECT e.d AS document_id, coalesce(u.s, g.s) AS slug, count(*) AS n FROM e LEFT JOIN u ON u.d = e.d AND u.k = h LEFT JOIN g ON g.d = e.d AND g.s = h GROUP BY ALL""",
    "er6_split_aliases": """
        WITH a AS (SELECT c_custkey AS s, c_custkey * 7 % 200 AS k FROM customer), t AS (SELECT c_custkey AS s, c_custkey % 300 AS k FROM customer),
        x AS (SELECT a.s, a.k, t.s AS o FROM a JOIN t ON a.k = t.k AND a.s <> t.s)
        SELECT DISTINCT s AS slug, k AS key, o AS link_to FROM x WHERE (o, s) NOT IN (SELECT s, o FROM x)""",
    "sr14_evidence_band": f"""
        WITH s AS (SELECT l_orderkey % 300 AS q, l_suppkey % 6 AS p, {_POS} AS u, l_partkey % 97 AS t, (l_quantity * 7 + l_partkey) % 100 / 100 AS s FROM lineitem),
        b AS (SELECT * FROM (SELECT *, max(s) OVER (PARTITION BY q, p) AS top FROM s) WHERE s >= 0.85 * top),
        o AS (SELECT q, t, max({{'s': s, 'u': -u}}) AS m FROM b GROUP BY ALL),
        k AS (SELECT q, m.s AS s, -m.u AS u, row_number() OVER (PARTITION BY q ORDER BY m.s DESC, -m.u)::int AS rank FROM o)
        SELECT q AS query_id, rank, u AS unit_id, s AS score FROM k WHERE rank <= 8""",
    "sr14_evidence": f"""
        WITH c AS (
            SELECT l_orderkey % 300 AS q, l_suppkey % 6 AS page, l_suppkey % 6 * 7 % 6 + l_suppkey % 2 AS pr, {_POS} AS place, l_suppkey % 3 AS doc, 't' || l_partkey % 19 AS text,
                   CASE WHEN l_partkey % 2 = 0 THEN ['B' || l_partkey % 5, 'B' || l_suppkey % 4] ELSE ['B' || l_partkey % 5] END AS blocks, ((l_quantity * 7 + l_partkey) % 100 / 100 - 0.1)::double AS s FROM lineitem),
        o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, text, doc, blocks ORDER BY pr, place) AS k FROM c) WHERE k = 1),
        j AS (SELECT *, s >= CASE WHEN top > 0 THEN greatest(0.05::double, top * 0.85::double) ELSE 0.05::double END AS stays FROM (SELECT *, max(s) OVER (PARTITION BY q, page) AS top FROM o)),
        n AS (SELECT DISTINCT q, page, unnest(blocks) AS b FROM j WHERE stays AND len(blocks) > 1),
        w AS (SELECT j.* FROM j WHERE stays OR (len(blocks) = 1 AND (q, page, blocks[1]) IN (SELECT q, page, b FROM n))),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, stays DESC, pr, place)::int AS rank FROM w)
        SELECT q AS query_id, rank, page AS page_id, place, round(s, 6) AS score FROM r WHERE rank <= 8""",
    "gr2_page_view": f"""
        WITH {_LINKS}, {_PAGES}, a AS (SELECT page_id FROM pages_ WHERE status = 'active'),
        d AS (SELECT o_custkey AS p, array_to_string(list_sort(list(DISTINCT o_orderkey % 50)), ',') AS documents FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
        r AS (SELECT f AS p, array_to_string(list_sort(list(DISTINCT t)), ',') AS related FROM links WHERE t IN (SELECT * FROM a) GROUP BY ALL)
        SELECT page_id, coalesce(documents, '') AS documents, coalesce(related, '') AS related FROM a LEFT JOIN d ON d.p = page_id LEFT JOIN r ON r.p = page_id""",
    "ev8_living_pages": """
        SELECT user_id * 31 + event_id % 40 AS page_id, bool_or(event_type = 'error' OR (event_type = 'click' AND event_id % 3 <> 0)) AS lives,
               coalesce(string_agg(DISTINCT 'd' || event_id % 5, ',' ORDER BY 'd' || event_id % 5) FILTER (event_id % 3 <> 0), '') AS documents FROM events GROUP BY ALL""",
    "lq11_dangling": """
        SELECT o_orderkey AS reference_id, o_custkey AS home_page_id FROM orders
        WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 9 = o_orderkey % 9 AND c_custkey % 5 <> 0)""",
    "lq13_ungrounded": f"""
        WITH b AS (SELECT l_orderkey AS d, l_linenumber AS r, unnest([l_suppkey, l_partkey - l_partkey % 2]) AS n FROM lineitem)
        SELECT l_orderkey AS document_id, {_POS} AS item_id, l_partkey::varchar AS missing FROM lineitem
        WHERE l_partkey > 9 AND NOT EXISTS (SELECT 1 FROM b WHERE d = l_orderkey AND r IN (l_linenumber, l_linenumber + 1) AND n = l_partkey)""",
    "lq15_observations": f"""
        SELECT l_orderkey % 200 AS document_id, l_partkey % 9 AS signature, arg_max(l_quantity, (l_linenumber, l_quantity, -({_POS})))::int AS length,
               max(l_linenumber)::int AS anchors, count(*) AS n FROM lineitem GROUP BY ALL""",
    "us6_purge_counts": """
        SELECT 'orders' AS "table", o_custkey % 7 AS workspace_id, count(*) AS n FROM orders WHERE o_custkey % 7 IN (2, 5) GROUP BY ALL
        UNION ALL SELECT 'events', user_id % 7, count(*) FROM events WHERE user_id % 7 IN (2, 5) GROUP BY ALL
        UNION ALL SELECT 'customers', c_custkey % 7, count(*) FROM customer WHERE c_custkey % 7 IN (2, 5) GROUP BY ALL""",
    "us7_without_document": """
        WITH c AS (SELECT l_orderkey % 3 AS w, l_partkey % 50 AS c, (l_partkey % 3 <> 1)::int + (l_suppkey % 3 <> 1)::int AS n FROM lineitem)
        SELECT w AS workspace_id, c AS cluster_id, count(*) AS claims, sum(n)::bigint AS refs FROM c WHERE n > 0 GROUP BY ALL""",
    "qa6_granularity": """
        WITH p AS (SELECT o_orderkey % 2 AS run, o_custkey AS d, o_orderkey AS page, o_orderkey % 3 AS head FROM orders),
        l AS (SELECT l_orderkey % 2 AS run, unnest([l_orderkey, l_partkey]) AS page FROM lineitem),
        h AS (SELECT run, d, count(*) FILTER (k > 1) AS head_groups FROM (SELECT run, d, head, count(*) AS k FROM p GROUP BY ALL) GROUP BY ALL)
        SELECT run, d AS document_id, count(*) AS pages, count(*) FILTER ((run, page) NOT IN (SELECT run, page FROM l)) AS unlinked, any_value(head_groups) AS head_groups
        FROM p JOIN h USING (run, d) GROUP BY ALL""",
}
