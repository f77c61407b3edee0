"""What the registered queries share: DuckDB spellings of the column functions and derived tables.

Each derived table is given twice, by the same arithmetic: as a DataFrame and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.sources.tables import table


def sql_without_particle(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{p}') THEN CASE WHEN length({t}) > {len(p) + 1} THEN left({t}, length({t}) - {len(p)}) ELSE {t} END" for p in tx.PARTICLES)
    return f"CASE {cases} ELSE {t} END"


def sql_raw_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{tx.TOKEN}')"


def sql_tokens(text: str) -> str:
    return f"list_transform({sql_raw_tokens(text)}, lambda t: {sql_without_particle('t')})"


def queries_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, workspace_id, question): the first eight words of each benchmark passage, for one workspace."""
    words = F.slice(F.split("text", "[ \n]+"), 1, 8)
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("workspace_id"), F.array_join(words, " ").alias("question")
    )


SQL_QUERIES_AS = """queries AS (
    SELECT item_id AS query_id, {} AS workspace_id,
           array_to_string(regexp_split_to_array(text, '[ \\n]+')[1:8], ' ') AS question FROM benchmark)"""
SQL_QUERIES = SQL_QUERIES_AS.format("'src' || item_id % 20")


def workspace_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(workspace_id, doc_id, text): documents by their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("workspace_id"), "doc_id", "text")


SQL_DOCS = "docs AS (SELECT source AS workspace_id, doc_id, text FROM documents)"

SQL_BM25 = f"""listed AS (SELECT workspace_id, doc_id, {sql_tokens('text')} AS terms FROM docs),
    scope AS (SELECT workspace_id, count(*) AS n, greatest(avg(len(terms)), 1.0) AS mean FROM listed GROUP BY ALL),
    postings AS (
        SELECT workspace_id, doc_id, len, term, count(*) AS tf
        FROM (SELECT workspace_id, doc_id, len(terms) AS len, unnest(terms) AS term FROM listed) GROUP BY ALL),
    df AS (SELECT workspace_id, term, count(*) AS df FROM postings GROUP BY ALL),
    asked AS (
        SELECT query_id, workspace_id, term, count(*) AS uses
        FROM (SELECT query_id, workspace_id, unnest({sql_tokens('question')}) AS term FROM queries) GROUP BY ALL),
    raw AS (
        SELECT query_id, doc_id, sum(uses * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS raw
        FROM postings JOIN df USING (workspace_id, term) JOIN scope USING (workspace_id) JOIN asked USING (workspace_id, term) GROUP BY ALL),
    bm25 AS (SELECT query_id, doc_id, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM raw)"""


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, embedding): the embedding with the document's number, as if of its text."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def usage_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger from events: the type gives status and provider, the value the tokens, props.k the cached ones."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    status = F.when(kind == "error", "failed").when(F.col("event_id") % 11 == 0, "started").otherwise("completed")
    tokens_in = F.when(F.col("event_id") % 7 != 0, F.floor("value").cast("long"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("w"), F.col("user_id") % 5).alias("workspace_id"), F.concat(F.lit("u"), F.col("user_id") % 13).alias("user_id"),
        F.concat(F.lit("p"), F.col("event_id") % 3).alias("provider"), F.concat(F.lit("m"), F.col("event_id") % 4).alias("requested_model"), kind.alias("model"),
        status.alias("status"), tokens_in.alias("input_tokens"), F.floor(F.col("value") / 2).cast("long").alias("output_tokens"),
        F.when(k % 2 == 0, k).alias("cached_input_tokens"), F.col("ts").alias("started_at"),
        F.when(status != "started", F.col("ts") + F.expr("INTERVAL 3 SECONDS")).alias("finished_at"),
    )


SQL_CALLS = """calls AS (
    SELECT event_id AS id, 'w' || user_id % 5 AS workspace_id, 'u' || user_id % 13 AS user_id, 'p' || event_id % 3 AS provider,
           'm' || event_id % 4 AS requested_model, event_type AS model,
           CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 11 = 0 THEN 'started' ELSE 'completed' END AS status,
           CASE WHEN event_id % 7 <> 0 THEN floor(value)::bigint END AS input_tokens, floor(value / 2)::bigint AS output_tokens,
           CASE WHEN (props->>'$.k')::bigint % 2 = 0 THEN (props->>'$.k')::bigint END AS cached_input_tokens, ts AS started_at,
           CASE WHEN event_type <> 'error' AND event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL 3 SECOND END AS finished_at
    FROM events)"""
