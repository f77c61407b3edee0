"""Queries of search and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import names, retrieval, search
from docloom.operators.vectors import VectorIndex, hybrid_top
from docloom.plans.common import SQL_BM25, SQL_QUERIES_AS, SQL_DOCS, SQL_QUERIES, queries_from_benchmark, sql_raw_tokens, unit_vectors, workspace_docs
from docloom.sources.tables import table


def sr1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir))
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def sr1_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir))
    return search.best(scored, 10, "query_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def sr2_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.overlap(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir))
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("asked"))


def sr3_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's vector and the one its workspace's queries start from, that of the query's number."""
    queries = queries_from_benchmark(spark, sf_dir).join(_query_vectors(spark, sf_dir), "query_id")
    docs = workspace_docs(spark, sf_dir).select("workspace_id", "doc_id").join(unit_vectors(spark, sf_dir), "doc_id", "left")
    score = search.similarity(F.col("asked"), F.col("embedding"))
    return queries.join(docs, "workspace_id").select("query_id", "doc_id", F.round(score, 6).alias("score"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_from_benchmark(spark, sf_dir).join(_query_vectors(spark, sf_dir), "query_id", "left")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, item, text, v): every document, with its vector where it has one."""
    return workspace_docs(spark, sf_dir).join(unit_vectors(spark, sf_dir), "doc_id", "left").select("workspace_id", F.col("doc_id").alias("item"), "text", F.col("embedding").alias("v"))


def sr3_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = VectorIndex(_items(spark, sf_dir).drop("text"), ["workspace_id"])
    found, _ = index.search(_asked(spark, sf_dir).drop("question"), 10)
    return found.select("query_id", "rank", F.col("item").alias("doc_id"), "score")


def sr4_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, items = _asked(spark, sf_dir).withColumn("weight", search.dense_weight(F.col("question"))), _items(spark, sf_dir)
    text = search.bm25(queries, items.withColumnRenamed("item", "doc_id")).select("query_id", F.col("doc_id").alias("item"), F.col("score").alias("text"))
    index = VectorIndex(items.drop("text"), ["workspace_id"])
    return hybrid_top(queries.drop("question"), text, items.drop("text"), index, 20).select("query_id", "rank", F.col("item").alias("doc_id"), "score")


def sr6_semantic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _items(spark, sf_dir).filter("v IS NOT NULL")
    page = F.col("item") % 50
    units = units.select("workspace_id", page.alias("page_id"), F.when(page < 20, "source").otherwise("concept").alias("page_type"), F.col("v").alias("embedding"))
    return retrieval.semantic_pages(_asked(spark, sf_dir).filter("asked IS NOT NULL"), units, 5)


def sr10_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language is a workspace here; each document is two units on two pages, one of them with white space around its text."""
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")])
    queries = _asked(spark, sf_dir).withColumn("workspace_id", langs[(F.col("query_id") % 4).cast("int")])
    docs = table(spark, sf_dir, "documents").join(unit_vectors(spark, sf_dir), "doc_id", "left").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    text = F.when(F.col("copy") == 1, F.concat(F.lit("  "), F.col("text"), F.lit(" "))).otherwise(F.col("text"))
    units = docs.select(
        F.col("lang").alias("workspace_id"), (F.col("doc_id") * 2 + F.col("copy")).alias("unit_id"), text.alias("text"), F.array(F.lit("B0002"), F.lit("B0001")).alias("block_refs"),
        F.col("doc_id").alias("document_id"), F.col("source").alias("title"), (F.col("doc_id") % 7 + F.col("copy")).alias("page_id"), F.col("embedding").alias("v"),
    )
    found = retrieval.evidence_candidates(queries, units)
    return found.select("query_id", "rank", "unit_id", "score", F.array_join("titles", ",").alias("titles"), F.array_join("page_ids", ",").alias("pages"))


def er8_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as concepts: every fiftieth is new, all are known."""
    known = table(spark, sf_dir, "documents").join(unit_vectors(spark, sf_dir), "doc_id", "left").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").alias("slug"), F.concat(F.lit("Title"), F.col("doc_id") % 97).alias("title"), F.array(F.col("source"), F.lit("")).alias("aliases"),
        F.array("lang").alias("tags"), F.col("text").alias("definition"), F.col("embedding").alias("v"),
    )
    return retrieval.concept_candidates(known.filter("slug % 50 = 0"), known, 10)


def _named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: words of the text are title and aliases, a third are sources."""
    word = lambda k: F.coalesce(F.get(F.split("text", "[ \n]+"), F.lit(k)), F.lit(""))
    aliases = F.concat(F.lit("# Page\n## Aliases\n- "), word(2), F.lit(", -, "), word(4), F.lit("\n\n## Notes\n- "), word(6))
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 3 == 0, "source").otherwise("concept").alias("page_type"),
        F.concat(word(0), F.lit(" ("), F.col("lang"), F.lit(")")).alias("title"), F.concat(F.lit("doc-"), F.col("doc_id") % 200).alias("slug"), aliases.alias("markdown"),
    )


def _name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_match(names.query_names(queries_from_benchmark(spark, sf_dir)), names.page_names(_named_pages(spark, sf_dir)))


def sr7_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_matches(spark, sf_dir)


def sr7_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir)).withColumnRenamed("doc_id", "page_id")
    return names.with_name_floors(scored, _name_matches(spark, sf_dir)).select("query_id", "page_id", F.round("score", 6).alias("score"))


def sr9_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts that a query is about by score, and those that it names."""
    concepts = _named_pages(spark, sf_dir).filter("page_type = 'concept'")
    scored = search.bm25(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir)).withColumnRenamed("doc_id", "page_id").withColumn("score", F.round("score", 6))
    focus = names.focus_concepts(scored.join(concepts.select("page_id"), "page_id", "left_semi"))
    direct = names.direct_matches(_name_matches(spark, sf_dir), concepts)
    return focus.withColumn("kind", F.lit("focus")).union(direct.withColumn("kind", F.lit("direct")))


def sr9_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25(queries_from_benchmark(spark, sf_dir), workspace_docs(spark, sf_dir))
    return search.near_best(scored, "query_id", "score", 0.02, 15).select("query_id", "rank", "doc_id")


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units from line items: an order's parts by return flag; the supplier is the page."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"), F.concat("l_returnflag", "l_linestatus").alias("text"),
        (F.col("l_partkey") % 40).alias("document_id"), F.array(F.concat(F.lit("B"), F.col("l_linenumber")), F.lit("B0")).alias("block_refs"),
        F.concat(F.lit("t"), F.col("l_suppkey") % 5).alias("title"), (F.col("l_suppkey") % 9).alias("page_id"),
    )


def sr10_grouped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = search.grouped_units(_units(spark, sf_dir))
    return grouped.select("document_id", "text", F.array_join("block_refs", ",").alias("refs"), "unit_id", F.array_join("titles", ",").alias("titles"), F.array_join("page_ids", ",").alias("pages"))


def sr12_page_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, their line items as units in order, parts as pages."""
    ranked = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.concat(F.lit("u"), F.col("l_suppkey")).alias("unit_id"),
        F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 7).alias("page_ids"),
    )
    return search.page_hits(ranked)


def sr16_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.recent_context(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("context").alias("digest"))


QUERIES = {
    "sr1_bm25": sr1_bm25, "sr1_top_documents": sr1_top_documents, "sr2_overlap": sr2_overlap, "sr3_dense": sr3_dense, "sr3_top": sr3_top, "sr4_hybrid": sr4_hybrid,
    "sr6_semantic_pages": sr6_semantic_pages, "sr10_candidates": sr10_candidates, "er8_candidates": er8_candidates,
    "sr7_name_match": sr7_name_match, "sr7_lifted": sr7_lifted, "sr9_concepts": sr9_concepts, "sr9_seeds": sr9_seeds, "sr10_grouped_units": sr10_grouped_units, "sr12_page_hits": sr12_page_hits, "sr16_context": sr16_context,
}

_DENSE = """dense AS (
    SELECT query_id, d.doc_id, least(1.0, greatest(0.0, coalesce(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)), 0.0))) AS score
    FROM queries JOIN embeddings q ON q.vec_id = query_id JOIN docs d USING (workspace_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
_BEST = lambda source, n: f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::int AS rank FROM {source}) WHERE rank <= {n}"

_PLAIN = lambda x: f"regexp_replace(regexp_replace(lower(trim({x})), '\\([^)]*\\)', '', 'g'), '[^a-z0-9가-힣]+', '', 'g')"
_QUESTION_WORDS = ", ".join(f"'{w}'" for w in names.QUESTION_WORDS)
#: Keywords of a question are among its tokens, so its names come from the tokens alone (no Hangul here).
_NAMES = f"""named AS (SELECT DISTINCT workspace_id, query_id, {_PLAIN('t')} AS name FROM (SELECT *, unnest({sql_raw_tokens('question')}) AS t FROM queries)),
    q AS (SELECT * FROM named WHERE name <> '' AND name NOT IN ({_QUESTION_WORDS})),
    pages_ AS (SELECT source AS workspace_id, doc_id AS page_id, doc_id % 3 <> 0 AS concept, lang, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents),
    parted AS (
        SELECT workspace_id, page_id, concept, unnest([coalesce(w[1], '') || ' (' || lang || ')', 'doc-' || page_id % 200]) AS name FROM pages_
        UNION ALL SELECT workspace_id, page_id, concept, unnest(string_split(coalesce(w[3], '') || ',' || coalesce(w[5], ''), ',')) FROM pages_),
    n AS (SELECT DISTINCT workspace_id, page_id, concept, {_PLAIN('name')} AS name FROM parted WHERE name <> ''),
    matches AS (
        SELECT query_id, page_id, max(CASE WHEN q.name = n.name THEN 1.0::double ELSE 0.85::double END) AS score FROM q JOIN n USING (workspace_id)
        WHERE n.name <> '' AND (q.name = n.name OR (concept AND length(q.name) >= 2 AND length(n.name) >= 2 AND (contains(n.name, q.name) OR contains(q.name, n.name)))) GROUP BY ALL)"""

ORACLE_SQL = {
    "sr7_name_match": f"WITH {SQL_QUERIES}, {_NAMES} SELECT * FROM matches",
    "sr7_lifted": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25}, {_NAMES}
        SELECT b.query_id, doc_id AS page_id, round(CASE WHEN m.score = 1 THEN greatest(b.score, 0.95) WHEN m.score = 0.85 THEN greatest(b.score, 0.88) ELSE b.score END, 6) AS score
        FROM bm25 b LEFT JOIN matches m ON m.query_id = b.query_id AND m.page_id = doc_id""",
    "sr9_concepts": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25}, {_NAMES},
        scored AS (SELECT query_id, doc_id AS page_id, round(score, 6) AS score FROM bm25 WHERE doc_id % 3 <> 0),
        near AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM scored) WHERE top + 1e-9 >= 0.45 AND score >= top - 0.001),
        f AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id)::int AS rank, 'focus' AS kind FROM near),
        d AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id)::int AS rank, 'direct' AS kind FROM matches WHERE score = 1 AND page_id % 3 <> 0)
        SELECT * FROM f WHERE rank <= 10 UNION ALL SELECT * FROM d WHERE rank <= 10""",
    "sr1_bm25": f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25} SELECT query_id, doc_id, round(score, 6) AS score FROM bm25",
    "sr1_top_documents": f"WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25} {_BEST('bm25', 10)}",
    "sr2_overlap": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS},
        asked AS (SELECT DISTINCT query_id, workspace_id, unnest({sql_raw_tokens('question')}) AS term FROM queries),
        has AS (SELECT DISTINCT workspace_id, doc_id, unnest({sql_raw_tokens('text')}) AS term FROM docs)
        SELECT query_id, doc_id, round(count(*) / max(n), 6) AS score
        FROM asked JOIN has USING (workspace_id, term) JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY ALL) USING (query_id) GROUP BY query_id, doc_id""",
    "sr3_dense": f"WITH {SQL_QUERIES}, {SQL_DOCS}, {_DENSE} SELECT query_id, doc_id, round(score, 6) AS score FROM dense",
    "sr3_top": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS}, {_DENSE},
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::int AS rank FROM dense)
        SELECT query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "sr10_candidates": f"""
        WITH {SQL_QUERIES_AS.format("['en', 'de', 'fr', 'es'][item_id % 4 + 1]")}, docs AS (SELECT lang AS workspace_id, doc_id, trim(text, ' ') AS text FROM documents WHERE trim(text, ' ') <> ''), {SQL_BM25}, {_DENSE},
        mixed AS (SELECT query_id, d.doc_id, 0.75::double * round(d.score, 6) + 0.25::double * coalesce(b.score, 0.0) AS score FROM dense d LEFT JOIN bm25 b USING (query_id, doc_id))
        SELECT query_id, rank, doc_id * 2 AS unit_id, score, source AS titles, doc_id % 7 || ',' || (doc_id % 7 + 1) AS pages
        FROM ({_BEST('mixed', 200)}) JOIN documents USING (doc_id)""",
    "er8_candidates": f"""
        WITH docs AS (
            SELECT source AS workspace_id, doc_id, 'Title' || doc_id % 97 || ' ' || source || ' ' || lang || ' ' || text AS text FROM documents WHERE trim(text, ' ') <> ''),
        queries AS (SELECT doc_id AS query_id, workspace_id, text AS question FROM docs WHERE doc_id % 50 = 0), {SQL_BM25}, {_DENSE.replace('JOIN embeddings q', 'LEFT JOIN embeddings q')},
        mixed AS (SELECT query_id, d.doc_id, 0.75::double * round(d.score, 6) + 0.25::double * coalesce(b.score, 0.0) AS score FROM dense d LEFT JOIN bm25 b USING (query_id, doc_id) WHERE query_id <> d.doc_id)
        SELECT query_id AS slug, doc_id AS candidate, score, rank FROM ({_BEST('mixed', 10)})""",
    "sr6_semantic_pages": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS},
        s AS (
            SELECT query_id, CASE WHEN d.doc_id % 50 < 20 THEN 'source' ELSE 'concept' END AS page_type, d.doc_id % 50 AS page_id,
                   max(round(least(1.0, greatest(0.0, list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: p[1]::double * p[2]::double)))), 6)) AS score
            FROM queries JOIN embeddings q ON q.vec_id = query_id JOIN docs d USING (workspace_id) JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_type ORDER BY score DESC, page_id)::int AS rank FROM s) WHERE rank <= 5""",
    "sr4_hybrid": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25}, {_DENSE},
        mixed AS (
            SELECT query_id, d.doc_id, w * round(d.score, 6) + (1 - w) * coalesce(b.score, 0.0) AS score
            FROM dense d LEFT JOIN bm25 b USING (query_id, doc_id)
            JOIN (SELECT query_id, CASE WHEN regexp_matches(question, '[가-힣ㄱ-ㆎ]') THEN 0.9::double ELSE 0.6::double END AS w FROM queries) USING (query_id))
        {_BEST('mixed', 20)}""",
    "sr9_seeds": f"""
        WITH {SQL_QUERIES}, {SQL_DOCS}, {SQL_BM25},
        near AS (SELECT * FROM (SELECT *, max(round(score, 6)) OVER (PARTITION BY query_id) AS top FROM bm25) WHERE round(score, 6) >= top - 0.02)
        SELECT query_id, rank, doc_id FROM ({_BEST('near', 15)})""",
    "sr10_grouped_units": """
        WITH u AS (
            SELECT l_orderkey || '-' || l_linenumber AS unit_id, l_returnflag || l_linestatus AS text, l_partkey % 40 AS document_id,
                   array_to_string(list_sort(['B' || l_linenumber, 'B0']), ',') AS refs, 't' || l_suppkey % 5 AS title, l_suppkey % 9 AS page FROM lineitem)
        SELECT document_id, text, refs, min(unit_id) AS unit_id, string_agg(DISTINCT title, ',' ORDER BY title) AS titles,
               array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM u GROUP BY document_id, text, refs""",
    "sr12_page_hits": """
        WITH u AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, 'u' || l_suppkey AS unit_id, unnest([l_partkey % 7, l_suppkey % 7]) AS page_id FROM lineitem)
        SELECT query_id, page_id, min({'r': rank, 'u': unit_id}).r AS rank, min({'r': rank, 'u': unit_id}).u AS unit_id FROM u GROUP BY query_id, page_id""",
    "sr16_context": """
        WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
        SELECT conv_id, md5(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS digest FROM t WHERE k <= 6 GROUP BY conv_id""",
}
