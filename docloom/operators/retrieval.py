"""Candidates by vectors and texts together: evidence for questions and known concepts for new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.mixing import mixed_top
from docloom.operators.search import bm25
from docloom.operators.vectors import VectorIndex, hybrid_top

#: The vectors' share of candidate scores, and how many candidates go on.
CANDIDATE_WEIGHT, EVIDENCE_CANDIDATES, CONCEPT_CANDIDATES, ENTRY_CANDIDATES = 0.75, 200, 100, 10


def _hybrid(queries: DataFrame, items: DataFrame, most: int, weight: float) -> DataFrame:
    """Rows (query_id, item, score, rank); queries: query_id, workspace_id, question, asked; items: workspace_id, item, text, v."""
    text = bm25(queries, items.withColumnRenamed("item", "doc_id")).select("query_id", F.col("doc_id").alias("item"), F.col("score").alias("text"))
    vectors = items.select("workspace_id", "item", "v")
    asked = queries.select("query_id", "workspace_id", "asked", F.lit(weight).alias("weight"))
    return hybrid_top(asked, text, vectors, VectorIndex(vectors, ["workspace_id"]), most)


def evidence_candidates(queries: DataFrame, units: DataFrame, most: int = EVIDENCE_CANDIDATES, weight: float = CANDIDATE_WEIGHT) -> DataFrame:
    """Rows (query_id, rank, unit_id, score, titles, page_ids): the best units of each query's workspace.

    queries: query_id, workspace_id, question, asked; units: workspace_id, unit_id, text, block_refs, document_id, title, page_id, v.
    Units with one text, document and set of references are one: smallest id, sorted titles and pages. Units without
    a text or a reference take no part.
    """
    able = units.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.size("block_refs") > 0))
    same = [F.col("workspace_id"), F.trim("text").alias("text"), F.col("document_id"), F.array_sort("block_refs").alias("block_refs")]
    title = F.when(F.col("title") != "", F.col("title"))
    grouped = able.groupBy(*same).agg(
        F.min("unit_id").alias("item"), F.min_by("v", "unit_id").alias("v"),
        F.array_sort(F.collect_set(title)).alias("titles"), F.array_sort(F.collect_set("page_id")).alias("page_ids"),
    )
    found = _hybrid(queries, grouped.select("workspace_id", "item", "text", "v"), most, weight)
    return found.join(grouped.select("item", "titles", "page_ids"), "item").select("query_id", "rank", F.col("item").alias("unit_id"), "score", "titles", "page_ids")


def concept_text(title: str = "title", aliases: str = "aliases", tags: str = "tags", definition: str = "definition") -> Column:
    """The parts that are not empty, joined by blanks."""
    parts = F.concat(F.array(title), F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.coalesce(F.col(tags), F.array().cast("array<string>")), F.array(definition))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def concept_candidates(concepts: DataFrame, pool: DataFrame, most: int = CONCEPT_CANDIDATES, weight: float = CANDIDATE_WEIGHT) -> DataFrame:
    """Rows (slug, candidate, score, rank): the known concepts of the workspace that are nearest to each new one. Both tables:
    workspace_id, slug, title, aliases, tags, definition, v. Concepts without a definition are neither asked nor candidates, and none
    is its own."""
    defined = lambda t: t.filter(F.trim(F.coalesce("definition", F.lit(""))) != "")
    queries = defined(concepts).select(F.col("slug").alias("query_id"), "workspace_id", concept_text().alias("question"), F.col("v").alias("asked"))
    items = defined(pool).select("workspace_id", F.col("slug").alias("item"), concept_text().alias("text"), "v")
    # One more than wanted, for the concept itself.
    found = mixed_top(queries, items, most + 1, weight).filter(F.col("query_id") != F.col("item"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return found.withColumn("rank", place).filter(F.col("rank") <= most).select(F.col("query_id").alias("slug"), F.col("item").alias("candidate"), "score", "rank")


def semantic_pages(queries: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """Rows (query_id, page_type, page_id, score, rank): for each query (query_id, workspace_id, asked) and page type the pages whose
    best unit (workspace_id, page_id, page_type, embedding) is nearest."""
    index = VectorIndex(units.select("workspace_id", "page_type", F.col("page_id").alias("item"), F.col("embedding").alias("v")), ["workspace_id", "page_type"])
    types = units.select("workspace_id", "page_type").distinct()
    asked = queries.join(types, "workspace_id").select(F.col("query_id").alias("of"), F.to_json(F.struct("query_id", "page_type")).alias("query_id"), "workspace_id", "page_type", "asked")
    found, _ = index.search(asked.drop("of"), most)
    named = asked.select("query_id", "of", "page_type")
    return found.join(named, "query_id").select(F.col("of").alias("query_id"), "page_type", F.col("item").alias("page_id"), "score", "rank")
