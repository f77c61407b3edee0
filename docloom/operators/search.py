"""Ranking for tables of queries, each within its workspace: BM25, overlap, vectors and their mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import raw_tokens, tokens
from docloom.sources.store import written

HANGUL = "[가-힣ㄱ-ㆎ]"
#: Stands for a document's length among its terms; no token has a blank.
LENGTH = " "


def _terms(queries: DataFrame) -> DataFrame:
    """Rows (query_id, workspace_id, term, uses)."""
    terms = queries.select("query_id", "workspace_id", F.explode(tokens(F.col("question"))).alias("term"))
    return terms.groupBy("query_id", "workspace_id", "term").agg(F.count("*").alias("uses"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Rows (query_id, doc_id, score) for the documents that share a term with a query of their workspace.

    Scores are divided by the query's best one. A term counts as often as the query has it. Texts are cut into tokens once: a
    document leaves a row of its length and a row for each term that some query of its workspace has.
    """
    asked = _terms(queries)
    # Written, so that its size is known: a small one is broadcast by Spark's own threshold, and no other token is shuffled.
    wanted = written(asked.select("workspace_id", "term").distinct())
    listed = docs.select("workspace_id", "doc_id", tokens(F.col("text")).alias("terms"))
    every = F.array_append(F.coalesce("terms", F.array().cast("array<string>")), F.lit(LENGTH))
    held = listed.select("workspace_id", "doc_id", F.when(F.col("terms").isNotNull(), F.size("terms")).alias("length"), F.explode(every).alias("term"))
    lengths = docs.select("workspace_id").distinct().select("workspace_id", F.lit(LENGTH).alias("term"))
    own = held.join(wanted.union(lengths), ["workspace_id", "term"], "left_semi")
    counts = written(own.groupBy("workspace_id", "doc_id", "length", "term").agg(F.count("*").alias("tf")))
    scope = counts.filter(F.col("term") == LENGTH).groupBy("workspace_id").agg(F.sum("tf").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
    postings = counts.filter(F.col("term") != LENGTH)
    frequency = postings.groupBy("workspace_id", "term").agg(F.count("*").alias("df"))
    weighted = frequency.join(scope, "workspace_id").withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = postings.join(weighted, ["workspace_id", "term"]).join(asked, ["workspace_id", "term"])
    raw = scored.groupBy("query_id", "doc_id").agg(F.sum(F.col("uses") * F.col("idf") * saturation).alias("raw"))
    best = F.max("raw").over(Window.partitionBy("query_id"))
    return raw.select("query_id", "doc_id", F.when(best > 0, F.col("raw") / best).otherwise(0.0).alias("score"))


def overlap(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, score): the share of a query's distinct terms that a document of its workspace has.
    Terms keep their endings here."""
    asked = queries.select("query_id", "workspace_id", F.explode(F.array_distinct(raw_tokens(F.col("question")))).alias("term")).distinct()
    size = asked.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    has = docs.select("workspace_id", "doc_id", F.explode(F.array_distinct(raw_tokens(F.col("text")))).alias("term"))
    hits = has.join(asked, ["workspace_id", "term"]).groupBy("query_id", "doc_id").agg(F.count("*").alias("hits"))
    return hits.join(size, "query_id").select("query_id", "doc_id", (F.col("hits") / F.col("n_terms")).alias("score"))


def newest_vectors(vectors: DataFrame) -> DataFrame:
    """Of each hash's completed vectors the newest: (representation_hash, embedding)."""
    done = vectors.filter("status = 'completed'")
    return done.groupBy("representation_hash").agg(F.max_by("embedding", F.struct("updated_at", "id")).alias("embedding"))


def dot(x: Column, y: Column) -> Column:
    """The inner product of two arrays, null if their lengths differ."""
    pairs = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.when(F.size(x) == F.size(y), F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p))


def similarity(x: Column, y: Column) -> Column:
    """The inner product clamped to [0, 1]; 0 where a vector is missing or of another length."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(dot(x, y), F.lit(0.0))))


def dense_weight(question: Column) -> Column:
    """The weight of vectors by the question's script: 0.9 with Hangul, 0.6 without."""
    return F.when(F.rlike(question, F.lit(HANGUL)), 0.9).otherwise(0.6)


def hybrid(dense: Column, text: Column, weight: Column | float = 0.8) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(weight)
    return weight * F.coalesce(dense, F.lit(0.0)) + (1 - weight) * F.coalesce(text, F.lit(0.0))


def ranked(scored: DataFrame, *keys: str, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Every row with its rank within its keys, scores compared at six decimals, ties by id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 6)), tie)))


def best(scored: DataFrame, n: int, *keys: str, score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The n best rows of each key, with their rank."""
    return ranked(scored, *keys, score=score, tie=tie).filter(F.col("rank") <= n)


def near_best(scored: DataFrame, key: str, score: str, margin: float, most: int, least: float = 0.0, tie: str = "doc_id") -> DataFrame:
    """Rows within a margin of their key's best score and not below least, at most so many."""
    top = F.max(F.round(score, 6)).over(Window.partitionBy(key))
    close = scored.withColumn("__top", top).filter((F.round(score, 6) >= F.col("__top") - margin) & (F.round(score, 6) >= least)).drop("__top")
    return best(close, most, key, score=score, tie=tie)


def grouped_units(units: DataFrame) -> DataFrame:
    """Units with one text, document and set of references as one: smallest id, sorted titles and pages."""
    return units.groupBy("document_id", "text", F.array_sort("block_refs").alias("block_refs")).agg(
        F.min("unit_id").alias("unit_id"),
        F.array_sort(F.collect_set("title")).alias("titles"),
        F.array_sort(F.collect_set("page_id")).alias("page_ids"),
    )


def page_hits(ranked: DataFrame) -> DataFrame:
    """Of each query and page the first unit in rank order; ranked: query_id, rank, unit_id, page_ids."""
    pages = ranked.select("query_id", "rank", "unit_id", F.explode("page_ids").alias("page_id"))
    first = pages.groupBy("query_id", "page_id").agg(F.min(F.struct("rank", "unit_id")).alias("hit"))
    return first.select("query_id", "page_id", "hit.*")


def recent_context(messages: DataFrame, n: int = 6) -> DataFrame:
    """Rows (conv_id, context): a conversation's last n messages as labelled lines, in order."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    line = F.concat_ws(": ", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    last = messages.withColumn("k", place).filter(F.col("k") <= n).groupBy("conv_id")
    lines = last.agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))
