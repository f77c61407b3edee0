"""Queries of slugs, heads, sub-entries, contributions and workspace reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import assignment as ag
from docloom.operators import lint
from docloom.sources.tables import table

C = F.col


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


def er12_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as new concepts under few slugs, customers as the index."""
    o, c = C("o_orderkey"), C("c_custkey")
    key = lambda x: F.concat(F.lit("k"), x)
    space = F.floor(o / 40) % 50
    concepts = table(spark, sf_dir, "orders").select(space.alias("workspace_id"), F.concat(F.lit("t"), o % 3).alias("slug"), o.alias("place"), F.array(key(o % 17), key(o % 400)).alias("keys"))
    status = F.when(c % 3 == 0, "deleted").otherwise("active")
    index = table(spark, sf_dir, "customer").select((c % 50).alias("workspace_id"), F.when(c % 4 == 0, F.concat(F.lit("t"), c % 3, F.lit("-"), 2 + c % 5)).otherwise(F.concat(F.lit("x"), c)).alias("slug"), status.alias("status"), F.array(key(c % 400)).alias("keys"))
    return ag.allocated_slugs(concepts, index)


def er14_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged pairs of a detail and a head, from one set of concepts for each customer segment."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select((C("l_orderkey") % 40).alias("document_id"), (C("l_partkey") % 25).alias("detail"), (C("l_suppkey") * 7 % 25).alias("head"), (C("l_linenumber") % 2 == 0).alias("is_term"),
                       (C("l_quantity") * 31 % 101 / 101).alias("similarity"), (0.8 + C("l_partkey") * 13 % 20 / 100).alias("probability"))
    rows = rows.filter("detail <> head").groupBy("document_id", "detail", "head").agg(*[F.max(x).alias(x) for x in ("is_term", "similarity", "probability")])
    return ag.assigned_heads(rows)


def er15_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = C("p_partkey"), C("s_suppkey")
    details = table(spark, sf_dir, "part").select((p % 20).alias("document_id"), F.concat(F.lit("e"), p).alias("detail"), F.concat(F.lit("k"), p % 60).alias("key"), (p % 3).alias("parent"), p.alias("place"))
    entries = table(spark, sf_dir, "supplier").select(s.alias("entry_id"), F.array(F.concat(F.lit("e"), s * 3), F.concat(F.lit("e"), s * 5)).alias("slugs"), F.concat(F.lit("k"), s % 50).alias("key"))
    return ag.matched_entries(details, entries)


def er15_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C("o_orderkey")
    refs = F.transform(F.sequence(F.lit(0), (o % 4).cast("int")), lambda k: F.concat(F.lit("B"), (o + k * 7) % 30))
    return ag.capped_mentions(table(spark, sf_dir, "orders").select((C("o_custkey") % 50).alias("document_id"), o.alias("slug"), refs.alias("refs")))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = C("o_orderkey")
    refs = F.array(F.concat(F.lit("B"), o % 40), F.concat(F.lit("B"), o % 7))
    return table(spark, sf_dir, "orders").select((C("o_custkey") % 30).alias("document_id"), o.alias("place"), F.concat(F.lit(" point "), o % 211).alias("text"), refs.alias("refs"))


def er17_key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.key_points(_notes(spark, sf_dir)).select("document_id", "place", "text", _joined("refs"))


def er17_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C("p_partkey")
    refs = F.when(p % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("B"), p % 40)))
    concepts = table(spark, sf_dir, "part").select((p % 30).alias("document_id"), F.concat(F.lit("c"), p).alias("slug"), refs.alias("refs"))
    return ag.concept_key_points(concepts, ag.key_points(_notes(spark, sf_dir)))


def ev1_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = C("p_partkey"), C("s_suppkey"), C("l_orderkey")
    block = lambda x: F.concat(F.lit("B"), x)
    concepts = table(spark, sf_dir, "part").select((p % 30).alias("document_id"), F.concat(F.lit("c"), p).alias("slug"), F.array(p % 11, p % 13).cast("array<long>").alias("evidence_ids"), F.array(block(p % 9)).alias("refs"))
    evidence = table(spark, sf_dir, "supplier").select((s % 30).alias("document_id"), (s % 12).cast("long").alias("evidence_id"), F.array(block(s % 8), block(s % 5)).alias("refs")).dropDuplicates(["document_id", "evidence_id", "refs"])
    blocks = table(spark, sf_dir, "customer").select((C("c_custkey") % 30).alias("document_id"), block(C("c_custkey") % 7).alias("block_id"))
    links = table(spark, sf_dir, "lineitem").select((C("l_partkey") % 30).alias("document_id"), F.concat(F.lit("c"), "l_partkey").alias("slug"), (n % 9).alias("target"))
    points = ag.key_points(_notes(spark, sf_dir))
    return ag.contributions(concepts, evidence, blocks, points, links).select("document_id", "slug", _joined("evidence"), _joined("blocks"), F.size("points").alias("n_points"), _joined("links"))


def ev3_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of the sub-entries of few pages."""
    e, u = C("event_id"), C("user_id")
    op = F.element_at(F.array(*map(F.lit, ("add", "add", "add", "move", "remove", "revive"))), (e % 6 + 1).cast("int"))
    parent = F.when(e % 5 > 0, F.concat(F.lit("e"), e * 7 % 12))
    changes = table(spark, sf_dir, "events").select(u.alias("page_id"), e.alias("sequence"), op.alias("op"), (e % 4).alias("operation_id"), F.concat(F.lit("e"), F.floor(e / 6) % 12).alias("entry_id"), parent.alias("parent_entry_id"),
                                                     F.concat(F.lit("n"), e).alias("name"), F.array(F.concat(F.lit("B"), e % 9)).alias("refs"))
    return ag.replayed_entries(changes).select("page_id", "entry_id", "name", "parent_entry_id", _joined("refs"), F.array_join(F.transform("operations", lambda x: x.cast("string")), ",").alias("operations"))


def lq4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = C("c_custkey"), C("o_orderkey")
    w = lambda x: (x % 4).alias("workspace_id")
    promotion = F.when(c % 3 == 0, "candidate").when(c % 3 == 1, "needs_review").otherwise("none")
    refs = F.when(c % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r")))
    clusters = table(spark, sf_dir, "customer").select(w(c), c.alias("cluster_id"), promotion.alias("promotion"), refs.alias("promotion_refs"), (c % 9).alias("n_details"))
    claims = table(spark, sf_dir, "orders").select(w(C("o_custkey")), C("o_custkey").alias("cluster_id"), o.alias("claim_id"), C("o_orderpriority").alias("text"), F.when(o % 50 == 0, "needs_review").alias("decision"), F.array(o % 97, o % 89).alias("refs"))
    stale = table(spark, sf_dir, "supplier").select(w(C("s_suppkey")), (C("s_suppkey") * 3 % 97).alias("ref"))
    restated = claims.filter("claim_id % 2 = 0").select("workspace_id", "cluster_id", "claim_id", "text")
    return lint.workspace_report(clusters, claims, stale, restated)


def lq17_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = C("o_orderkey"), C("p_partkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("d"), C("o_custkey")).alias("document_id"), o.alias("question"), (o % 4 == 0).alias("passed"), (o % 7 > 0).alias("question_ok"), F.when(o % 5 == 0, 1).alias("n_contradictions"), (o % 3 > 0).alias("gold_hit"),
        F.when(o % 11 == 0, F.array(F.lit("x"))).alias("missing_claims"), (o % 13 > 0).alias("answerable"), (o % 100 / 100).alias("recall"), (o % 90 / 90).alias("alignment"),
        F.when(o % 2 == 0, F.concat(F.lit("d"), C("o_custkey") % 50)).alias("source_document_id"), F.array(F.concat(F.lit("B"), o % 40)).alias("block_ids"))
    trashed = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d"), C("s_suppkey")).alias("document_id"))
    local = F.concat(F.lit("B"), p % 40)
    units = table(spark, sf_dir, "part").select(F.concat(F.lit("d"), p % 300).alias("source_document_id"), F.array(local, F.concat(F.lit("d"), p % 41, F.lit(":B"), p % 37)).alias("block_refs"))
    return lint.quality_failures(rows, trashed, units)


def er1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as items of notes that cite up to six blocks, some twice and some unknown."""
    n = C("l_orderkey") * 31 + C("l_partkey") * 7 + C("l_linenumber")
    refs = F.transform(F.sequence(F.lit(0), (n % 6).cast("int")), lambda k: F.concat(F.lit("B"), (n * (k + 1)) % 60))
    items = table(spark, sf_dir, "lineitem").select((C("l_orderkey") % 40).alias("document_id"), (C("l_partkey") % 3).alias("kind"), C("l_orderkey").alias("note"), C("l_linenumber").alias("place"),
                                                    F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("text"), refs.alias("refs"))
    blocks = table(spark, sf_dir, "customer").select((C("c_custkey") % 40).alias("document_id"), F.concat(F.lit("B"), C("c_custkey") % 57).alias("block_id"))
    return ag.anchored_items(items.distinct(), blocks).select("document_id", "kind", "number", "text", _joined("anchors"), _joined("unknown"))


QUERIES = {f.__name__: f for f in (er1_items, er12_slugs, er14_heads, er15_entries, er15_mentions, er17_key_points, er17_of_concepts, ev1_contributions, ev3_entries, lq4_report, lq17_failures)}

_NOTES = "notes AS (SELECT o_custkey % 30 AS d, o_orderkey AS place, 'point ' || o_orderkey % 211 AS text, ['B' || o_orderkey % 40, 'B' || o_orderkey % 7] AS refs FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 30, o_orderkey % 211 ORDER BY o_orderkey) = 1)"
ORACLE_SQL = {
    "er1_items": """
        WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS p, l_partkey % 3 AS kind, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS text, l_orderkey * 31 + l_partkey * 7 + l_linenumber AS n FROM lineitem),
        i AS (SELECT o % 40 AS d, kind, text, n, row_number() OVER (PARTITION BY o % 40, kind ORDER BY o, p, text)::int AS number FROM l),
        r AS (SELECT d, kind, number, 'B' || (n * (k + 1)) % 60 AS b, min(k) AS k FROM (SELECT *, unnest(range(0, n % 6 + 1)) AS k FROM i) GROUP BY ALL),
        m AS (SELECT r.*, EXISTS (SELECT 1 FROM customer WHERE c_custkey % 40 = d AND 'B' || c_custkey % 57 = b) AS known FROM r),
        a AS (SELECT d, kind, number, coalesce(array_to_string(list(b ORDER BY k) FILTER (known)[1:3], ','), '') AS anchors, coalesce(string_agg(b, ',' ORDER BY k) FILTER (NOT known), '') AS unknown FROM m GROUP BY ALL)
        SELECT d AS document_id, kind, number, text, anchors, unknown FROM i JOIN a USING (d, kind, number)""",
    "er12_slugs": """
        WITH n AS (SELECT o_orderkey // 40 % 50 AS w, 't' || o_orderkey % 3 AS slug, o_orderkey AS place, unnest(list_distinct([o_orderkey % 17, o_orderkey % 400])) AS key FROM orders),
        x AS (SELECT c_custkey % 50 AS w, CASE WHEN c_custkey % 4 = 0 THEN 't' || c_custkey % 3 || '-' || 2 + c_custkey % 5 ELSE 'x' || c_custkey END AS slug, CASE WHEN c_custkey % 3 = 0 THEN 'deleted' ELSE 'active' END AS status, c_custkey % 400 AS key FROM customer),
        h AS (SELECT DISTINCT n.w, n.slug, place, x.slug AS hit, status FROM n JOIN x ON n.w = x.w AND n.key = x.key),
        s AS (SELECT w, slug, place, count(*) FILTER (status = 'active') AS a, count(*) FILTER (status = 'deleted') AS d, min(hit) FILTER (status = 'active') AS ha, min(hit) FILTER (status = 'deleted') AS hd FROM h GROUP BY ALL),
        r AS (SELECT w, slug, place, CASE WHEN a = 1 THEN ha ELSE hd END AS allocated FROM s WHERE a = 1 OR (a = 0 AND d = 1) QUALIFY row_number() OVER (PARTITION BY w, allocated ORDER BY place, slug) = 1),
        rest AS (SELECT *, row_number() OVER (PARTITION BY w, slug ORDER BY place) AS k FROM (SELECT DISTINCT w, slug, place FROM n) WHERE (w, slug, place) NOT IN (SELECT (w, slug, place) FROM r)),
        free AS (SELECT w, slug, t, row_number() OVER (PARTITION BY w, slug ORDER BY i) AS k FROM (
            SELECT w, slug, i, slug || CASE WHEN i = 1 THEN '' ELSE '-' || i END AS t FROM (SELECT DISTINCT w, slug FROM rest), (SELECT unnest(range(1, 10)) AS i)) WHERE (w, t) NOT IN (SELECT (w, slug) FROM x))
        SELECT w AS workspace_id, slug, place, allocated FROM r
        UNION ALL SELECT rest.w, rest.slug, place, t FROM rest LEFT JOIN free ON rest.w = free.w AND rest.slug = free.slug AND rest.k = free.k""",
    "er15_entries": """
        WITH e AS (SELECT s_suppkey AS id, unnest([s_suppkey * 3, s_suppkey * 5]) AS s FROM supplier),
        a AS (SELECT 'e' || s AS detail, max(id) AS a FROM e GROUP BY ALL), b AS (SELECT 'k' || s_suppkey % 50 AS key, min(s_suppkey) AS b FROM supplier GROUP BY ALL),
        d AS (SELECT p_partkey % 20 AS document_id, 'e' || p_partkey AS detail, 'k' || p_partkey % 60 AS key, p_partkey % 3 AS parent, p_partkey AS place FROM part),
        f AS (SELECT *, first(detail) OVER (PARTITION BY document_id, parent, key ORDER BY place) AS f FROM d)
        SELECT document_id, detail, key, parent, place, coalesce(a, b) AS entry_id, CASE WHEN f <> detail THEN f END AS same_as FROM f LEFT JOIN a USING (detail) LEFT JOIN b USING (key)""",
    "er15_mentions": """
        WITH m AS (SELECT o_custkey % 50 AS d, o_orderkey AS slug, list_sort(list_distinct(list_transform(generate_series(0, o_orderkey % 4), lambda k: 'B' || (o_orderkey + k * 7) % 30))) AS refs FROM orders),
        b AS (SELECT d, slug, len(refs)::int AS n, refs[1] AS block FROM m QUALIFY row_number() OVER (PARTITION BY d, refs[1] ORDER BY len(refs) DESC, slug) <= 2)
        SELECT d AS document_id, slug, n, block, row_number() OVER (PARTITION BY d ORDER BY n DESC, block, slug)::int AS rank FROM b QUALIFY rank <= 20""",
    "er17_key_points": f"WITH {_NOTES} SELECT d AS document_id, place, text, array_to_string(refs, ',') AS refs FROM notes",
    "ev1_contributions": f"""
        WITH {_NOTES},
        c AS (SELECT p_partkey % 30 AS d, 'c' || p_partkey AS slug, list_distinct([p_partkey % 11, p_partkey % 13]) AS ev, 'B' || p_partkey % 9 AS ref FROM part),
        e AS (SELECT DISTINCT s_suppkey % 30 AS d, s_suppkey % 12 AS ev, ['B' || s_suppkey % 8, 'B' || s_suppkey % 5] AS refs FROM supplier),
        n AS (SELECT c.d, slug, e.ev, refs FROM (SELECT d, slug, unnest(ev) AS ev FROM c) c JOIN e ON e.d = c.d AND e.ev = c.ev),
        r AS (SELECT d, slug, ref FROM c UNION SELECT d, slug, unnest(refs) FROM n),
        b AS (SELECT d, slug, string_agg(d || ':' || ref, ',' ORDER BY d || ':' || ref) AS blocks FROM r WHERE (d, ref) IN (SELECT (c_custkey % 30, 'B' || c_custkey % 7) FROM customer) GROUP BY ALL),
        p AS (SELECT r.d, slug, count(DISTINCT place) AS n FROM r JOIN (SELECT d, place, unnest(refs) AS ref FROM notes) x ON x.d = r.d AND x.ref = r.ref GROUP BY ALL),
        k AS (SELECT slug, string_agg(t::varchar, ',' ORDER BY t) AS links FROM (SELECT DISTINCT 'c' || l_partkey AS slug, l_orderkey % 9 AS t FROM lineitem) GROUP BY ALL),
        ev AS (SELECT d, slug, string_agg(x, ',' ORDER BY x) AS evidence FROM (SELECT DISTINCT d, slug, d || ':' || ev AS x FROM n) GROUP BY ALL)
        SELECT c.d AS document_id, c.slug, coalesce(evidence, '') AS evidence, coalesce(blocks, '') AS blocks, coalesce(n, 0)::int AS n_points, coalesce(links, '') AS links
        FROM c LEFT JOIN ev ON ev.slug = c.slug LEFT JOIN b ON b.slug = c.slug LEFT JOIN p ON p.slug = c.slug LEFT JOIN k ON k.slug = c.slug""",
    "lq4_report": """
        WITH bad AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 4 = o_custkey % 4 AND s_suppkey * 3 % 97 IN (o_orderkey % 97, o_orderkey % 89))),
        doubt AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey % 50 = 0),
        f AS (SELECT c_custkey AS c, c_custkey IN (FROM bad) AS bad, c_custkey IN (FROM doubt) AS doubt FROM customer)
        SELECT c % 4 AS workspace_id, c AS cluster_id, finding FROM (
            SELECT c, 'no_refs' AS finding FROM f WHERE c % 3 = 0 AND c % 5 = 0
            UNION ALL SELECT c, 'too_few_details' FROM f WHERE c % 3 = 0 AND c % 5 > 0 AND c % 9 < 5
            UNION ALL SELECT c, 'promote' FROM f WHERE c % 3 = 0 AND c % 5 > 0 AND c % 9 >= 5 AND NOT bad
            UNION ALL SELECT c, 'needs_review' FROM f WHERE c % 3 = 1 OR bad OR doubt)""",
    "lq17_failures": """
        WITH u AS (SELECT 'd' || p_partkey % 300 || ':B' || p_partkey % 40 AS ref FROM part UNION SELECT 'd' || p_partkey % 41 || ':B' || p_partkey % 37 FROM part),
        e AS (SELECT 'd' || o_custkey AS document_id, o_orderkey AS o, 'd' || CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 ELSE o_custkey END || ':B' || o_orderkey % 40 AS ref FROM orders
              WHERE o_orderkey % 4 > 0 AND o_custkey NOT IN (SELECT s_suppkey FROM supplier)),
        f AS (SELECT document_id, o AS question, CASE WHEN o % 7 = 0 THEN 'question' WHEN o % 5 = 0 THEN 'contradictory' WHEN o % 3 = 0 THEN CASE WHEN ref IN (FROM u) THEN 'retrieval' ELSE 'not_in_wiki' END
              WHEN o % 11 = 0 OR o % 13 = 0 OR o % 100 < 75 THEN 'incomplete' WHEN o % 90 / 90 < 0.75 THEN 'imprecise' END AS failure FROM e)
        FROM f WHERE failure IS NOT NULL""",
}
