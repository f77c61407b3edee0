"""Queries of blocks, duplicates, edit events, embedding tables and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import content_hash
from docloom.operators import blocks as bl
from docloom.operators import duplicates, evaluation, search
from docloom.plans.common import SQL_BM25, SQL_DOCS, SQL_QUERIES, queries_from_benchmark, workspace_docs
from docloom.sources.tables import table
from docloom.streaming import edits


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line as a paragraph, every fourth line a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i % 4 == 0) & (F.length(F.trim(x)) > 0), F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n\n").alias("text"))


def tx1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bl.blocks(_paragraphs(spark, sf_dir))
    return found.select("document_id", "block_id", F.md5("text").alias("digest"), "line_start", "line_end", "block_type")


def tx2_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bl.packets(bl.blocks(_paragraphs(spark, sf_dir)), budget=1500)
    return found.select("document_id", "chunk_id", F.array_join("block_ids", ",").alias("block_ids"))


def tx4_block_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third document without its second line, each fifth with a new last line."""
    docs = _paragraphs(spark, sf_dir)
    old = bl.blocks(docs)
    lines = F.split("text", "\n\n")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.slice(lines, 1, 1), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))))).otherwise(lines)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(changed, F.array(F.lit("one more line")))).otherwise(changed)
    return bl.block_changes(old, bl.blocks(docs.withColumn("text", F.array_join(changed, "\n\n"))))


def tx5_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    derived = docs.select("doc_id", F.sha2("text", 256).alias("edited_hash"), F.when(F.col("doc_id") % 3 != 0, F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("ingested_hash"))
    return bl.stale_documents(derived).select("doc_id")


def sr11_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries and their line items as units with two blocks each."""
    ranked = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("unit_id"), (F.col("l_partkey") % 101 / 100).alias("probability"),
        F.array(F.col("l_partkey") % 3, F.col("l_suppkey") % 3).alias("blocks"),
    )
    return bl.cover(ranked, 3)


def lq18_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") * 7 % 1000).alias("created_at"))
    return duplicates.near_duplicates(docs)


def _edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON messages; some lack a field, some are no JSON."""
    e = F.col("event_id")
    fields = F.struct(
        F.concat(F.lit("d"), F.col("user_id")).alias("document_id"), F.concat(F.lit("w"), F.col("user_id") % 4).alias("workspace_id"), F.when(e % 13 != 0, e.cast("string")).alias("revision"),
        F.when(e % 11 == 0, "").otherwise(F.sha1("event_type")).alias("content_hash"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    return table(spark, sf_dir, "events").select(F.when(e % 17 == 0, F.concat(F.lit("{broken "), e)).otherwise(F.to_json(fields)).alias("value"))


def st1_parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.parsed(_edit_events(spark, sf_dir)).groupBy("valid").agg(F.count("*").alias("n"), F.sum("revision").alias("revisions"))


def st3_accepted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    purged = spark.createDataFrame([("w1",), ("w3",)], "workspace_id string")
    return edits.accepted(_edit_events(spark, sf_dir), purged).groupBy("document_id").agg(F.count("*").alias("n"), F.max("revision").alias("revision"))


def st4_mark_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    state = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max_by(F.sha1("event_type"), e).alias("content_hash"), F.max(e).alias("revision"))
    state = state.withColumn("ingested_hash", F.when(F.col("document_id") % 2 == 0, "before"))
    ingested = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.min_by(F.sha1("event_type"), e).alias("hash"))
    return edits.mark_ingested(state, ingested).select("document_id", "revision", "ingested_hash")


def em1_pages_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose representation is not the one that was embedded, or never was."""
    pages = table(spark, sf_dir, "pages").select("page_id", content_hash(F.col("url"), F.col("html")).alias("representation_hash"))
    hashes = F.when(F.col("page_id") % 3 == 0, F.sha2("representation_hash", 256)).otherwise(F.col("representation_hash"))
    vectors = pages.filter("page_id % 5 <> 0").select("page_id", hashes.alias("representation_hash"), F.when(F.col("page_id") % 7 == 0, "failed").otherwise("completed").alias("status"))
    return evaluation.to_embed(pages, vectors).select("page_id", F.substring("representation_hash", 1, 12).alias("representation"))


def em2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as units of two models: each distinct text is embedded once by each, known ones are skipped."""
    lines = table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    units = lines.select("workspace_id", F.when(F.length("line") % 2 == 0, "m0").otherwise("m1").alias("embedding_model"), F.sha1("line").alias("representation_hash"))
    first = F.substring("representation_hash", 1, 1)
    known = units.drop("workspace_id").filter(first.isin("0", "1", "2", "3")).distinct()
    vectors = known.withColumn("status", F.when(first == "3", "failed").otherwise("completed")).union(known.filter(first == "2").withColumn("status", F.lit("failed")))
    return evaluation.embedding_counts(units, vectors)


def _gold_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of its workspace that holds a query's own words."""
    queries = queries_from_benchmark(spark, sf_dir)
    ranked = search.ranked(search.bm25(queries, workspace_docs(spark, sf_dir)), "query_id").select("query_id", "doc_id", "rank")
    docs = workspace_docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[ \n]+", " ").alias("flat"))
    return evaluation.gold_ranks(queries, ranked, docs, F.col("question"))


def qa1_gold_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold_ranks(spark, sf_dir).select("query_id", "gold_rank", F.round("reciprocal", 6).alias("reciprocal"))


def qa1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = _gold_ranks(spark, sf_dir).withColumn("part", F.col("query_id") % 3)
    return evaluation.gold_summary(ranks, "part").withColumn("mean_reciprocal", F.round("mean_reciprocal", 6))


def _routing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routing cases: the status was expected, the key's remainder answered, and every ninth was not answered."""
    k, routes = F.col("o_orderkey"), F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("expected"), F.when(k % 9 != 4, routes[(k % 3).cast("int")]).alias("actual"), F.when(k % 4 == 0, F.array(F.lit("O"), F.lit("P"))).when(k % 4 == 1, F.array(F.lit("F"))).alias("acceptable")
    )


def qa4_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.routing_matrix(_routing_cases(spark, sf_dir))


def qa4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.routing_summary(_routing_cases(spark, sf_dir), ("O",))


def _run_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as concepts of three runs; words of their texts are titles and aliases, sources the documents."""
    word = lambda k: F.coalesce(F.get(F.split("text", "[ \n]+"), F.lit(k)), F.lit(""))
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 3).alias("run"), F.col("source").alias("document_id"), F.col("doc_id").alias("concept_id"),
        F.concat(word(0), F.lit("-"), word(1), F.lit(" x ("), word(2), F.lit(")")).alias("title"), F.array(F.upper(word(3)), F.lit("-")).alias("aliases"),
    )


def qa6_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.alignment(_run_concepts(spark, sf_dir))


def qa6_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = _run_concepts(spark, sf_dir).filter("run <> 1 OR document_id <> 'src3'")
    return evaluation.page_spread(concepts.withColumnRenamed("concept_id", "page_id"))


def qa6_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.head_groups(_run_concepts(spark, sf_dir)).select("run", "document_id", "head", F.size("titles").alias("n"), F.md5(F.array_join("titles", "|")).alias("digest"))


QUERIES = {
    "tx1_blocks": tx1_blocks, "tx2_packets": tx2_packets, "tx4_block_changes": tx4_block_changes, "tx5_stale": tx5_stale, "sr11_cover": sr11_cover,
    "lq18_near_duplicates": lq18_near_duplicates, "st1_parsed_events": st1_parsed_events, "st3_accepted_events": st3_accepted_events, "st4_mark_ingested": st4_mark_ingested,
    "em1_pages_to_embed": em1_pages_to_embed, "em2_vector_dedup": em2_vector_dedup, "qa1_gold_rank": qa1_gold_rank, "qa1_summary": qa1_summary, "qa4_routing": qa4_routing, "qa4_summary": qa4_summary, "qa6_alignment": qa6_alignment, "qa6_spread": qa6_spread, "qa6_heads": qa6_heads,
}

_EVENTS = """e AS (
    SELECT *, event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 11 <> 0 AS valid,
           CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 THEN event_id END AS revision FROM events)"""

_GOLD = f"""{SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25},
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::int AS rank FROM bm25),
    h AS (
        SELECT query_id, min(rank) AS gold_rank FROM k JOIN queries USING (query_id) JOIN documents USING (doc_id)
        WHERE contains(regexp_replace(text, '[ \\n]+', ' ', 'g'), question) GROUP BY query_id)"""
_FOLDED = lambda x: f"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_CONCEPTS = """w AS (SELECT doc_id % 3 AS run, source, doc_id, list_transform([1, 2, 3, 4], lambda k: coalesce(regexp_split_to_array(text, '[ \\n]+')[k], '')) AS w FROM documents),
    c AS (SELECT *, w[1] || '-' || w[2] || ' x (' || w[3] || ')' AS title, upper(w[4]) AS alias FROM w)"""
_ROUTES = """c AS (
    SELECT o_orderstatus AS expected, CASE WHEN o_orderkey % 9 <> 4 THEN ['F', 'O', 'P'][(o_orderkey % 3 + 1)::int] END AS actual,
           CASE o_orderkey % 4 WHEN 0 THEN ['O', 'P'] WHEN 1 THEN ['F'] ELSE [] END AS acceptable FROM orders),
    r AS (SELECT *, coalesce(expected = actual OR list_contains(acceptable, actual), false) AS fine FROM c)"""

ORACLE_SQL = {
    "tx1_blocks": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l WHERE regexp_matches(x, '\\S'))
        SELECT doc_id AS document_id, printf('B%04d', n) AS block_id,
               md5(trim(regexp_replace(CASE WHEN i % 4 = 1 THEN '## ' || x ELSE x END, '\\s+', ' ', 'g'))) AS digest, (2 * i - 1)::int AS line_start,
               (2 * i - 1)::int AS line_end,
               CASE WHEN i % 4 = 1 OR starts_with(ltrim(x), '#') THEN 'heading' WHEN regexp_matches(x, '^\\s*([-*]|1[.]) ') THEN 'list'
                    WHEN starts_with(ltrim(x), '```') THEN 'code' ELSE 'paragraph' END AS block_type FROM k""",
    "tx5_stale": """
        WITH h AS (SELECT doc_id, sha256(text) AS edited, CASE WHEN doc_id % 3 <> 0 THEN sha256(CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END) END AS ingested FROM documents)
        SELECT doc_id FROM h WHERE ingested IS DISTINCT FROM edited""",
    "lq18_near_duplicates": """
        WITH RECURSIVE n AS (
            SELECT doc_id, doc_id * 7 % 1000 AS created, regexp_replace(nfc_normalize(replace(lower(nfc_normalize(coalesce(text, ''))), 'ß', 'ss')), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
        c AS (SELECT * FROM n WHERE length(t) >= 20),
        g AS (SELECT DISTINCT doc_id, substring(t, i, 3) AS g FROM (SELECT doc_id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM c)),
        s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY ALL),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE k >= 0.85 * (x.n + y.n - k) - 1e-9),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        o AS (SELECT r.a AS doc_id, arg_min(r.b, (c.created, r.b)) AS original_id FROM r JOIN c ON c.doc_id = r.b GROUP BY r.a)
        SELECT doc_id, original_id FROM o WHERE doc_id <> original_id""",
    "st1_parsed_events": f"WITH {_EVENTS} SELECT valid, count(*) AS n, sum(revision)::bigint AS revisions FROM e GROUP BY valid",
    "st3_accepted_events": f"""
        WITH {_EVENTS} SELECT 'd' || user_id AS document_id, count(*) AS n, max(revision) AS revision FROM e WHERE valid AND user_id % 4 NOT IN (1, 3) GROUP BY ALL""",
    "st4_mark_ingested": """
        SELECT user_id AS document_id, max(event_id) AS revision, CASE WHEN arg_min(event_type, event_id) = arg_max(event_type, event_id) THEN sha1(arg_max(event_type, event_id))
               WHEN user_id % 2 = 0 THEN 'before' END AS ingested_hash FROM events GROUP BY user_id""",
    "em1_pages_to_embed": """
        WITH p AS (SELECT page_id, sha256(coalesce(url, '') || chr(10) || coalesce(html, '')) AS h FROM pages),
        v AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN sha256(h) ELSE h END AS done FROM p WHERE page_id % 5 <> 0 AND page_id % 7 <> 0)
        SELECT page_id, left(h, 12) AS representation FROM p LEFT JOIN v USING (page_id) WHERE done IS DISTINCT FROM h""",
    "em2_vector_dedup": """
        WITH u AS (SELECT source AS workspace_id, length(x) % 2 AS m, sha1(x) AS h FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '')
        SELECT workspace_id, count(*) AS units, count(DISTINCT (m, h)) AS texts, count(DISTINCT (m, h)) FILTER (h[1] IN ('0', '1', '2')) AS skipped, count(DISTINCT (m, h)) FILTER (h[1] = '3') AS failed,
               count(DISTINCT (m, h)) FILTER (h[1] NOT IN ('0', '1', '2')) AS to_embed FROM u GROUP BY workspace_id""",
    "qa1_gold_rank": f"WITH {_GOLD} SELECT query_id, gold_rank, coalesce(round(1 / gold_rank, 6), 0.0) AS reciprocal FROM queries LEFT JOIN h USING (query_id)",
    "qa1_summary": f"""
        WITH {_GOLD} SELECT query_id % 3 AS part, count(*) AS cases, count(gold_rank) AS found, count(*) FILTER (gold_rank <= 1) AS within_1, count(*) FILTER (gold_rank <= 5) AS within_5,
               count(*) FILTER (gold_rank <= 10) AS within_10, round(avg(coalesce(1 / gold_rank, 0.0)), 6) AS mean_reciprocal FROM queries LEFT JOIN h USING (query_id) GROUP BY part""",
    "qa4_routing": f"WITH {_ROUTES} SELECT expected, actual, count(*) AS n, count(*) FILTER (fine) AS accepted FROM r GROUP BY ALL",
    "qa4_summary": f"""
        WITH {_ROUTES} SELECT count(*) AS cases, count(*) FILTER (expected = actual) AS correct, count(*) FILTER (fine) AS accepted, count(*) FILTER (actual IS NULL) AS failed,
               count(*) FILTER (actual = 'O' AND NOT fine) AS false_changes FROM r""",
    "qa6_alignment": f"""
        WITH {_CONCEPTS}, r AS (SELECT run, doc_id, unnest([title, alias, regexp_replace(title, '\\(.*?\\)', '', 'g'), regexp_replace(alias, '\\(.*?\\)', '', 'g')]) AS name FROM c),
        n AS (SELECT DISTINCT run, doc_id, {_FOLDED('name')} AS key FROM r), k AS (SELECT DISTINCT run AS other, key FROM n WHERE key <> ''),
        f AS (SELECT run, other, count(DISTINCT doc_id) AS aligned FROM n JOIN k USING (key) WHERE run <> other GROUP BY ALL),
        t AS (SELECT run, count(*) AS concepts FROM c GROUP BY run)
        SELECT a.run, b.run AS other, a.concepts, coalesce(aligned, 0) AS aligned, round(coalesce(aligned, 0) / a.concepts, 3) AS share
        FROM t a JOIN t b ON a.run <> b.run LEFT JOIN f ON f.run = a.run AND f.other = b.run""",
    "qa6_spread": """
        WITH c AS (SELECT source AS d, doc_id % 3 AS run FROM documents WHERE doc_id % 3 <> 1 OR source <> 'src3'),
        g AS (SELECT d, r.run, count(c.run) AS n FROM (SELECT DISTINCT d FROM c) CROSS JOIN (SELECT DISTINCT run FROM c) r LEFT JOIN c USING (d, run) GROUP BY ALL)
        SELECT d AS document_id, min(n) AS least, max(n) AS most, max(n) - min(n) AS spread FROM g GROUP BY d""",
    "qa6_heads": f"""
        WITH {_CONCEPTS}, h AS (SELECT DISTINCT run, source, doc_id, title, {_FOLDED('word')} AS head FROM (
            SELECT *, unnest(list_concat([string_split_regex(trim(title), '\\s+')[1]], regexp_extract_all(title, '\\((.*?)\\)', 1))) AS word FROM c))
        SELECT run, source AS document_id, head, count(*)::int AS n, md5(string_agg(title, '|' ORDER BY title)) AS digest FROM h WHERE head <> '' GROUP BY ALL HAVING count(*) > 1""",
}
