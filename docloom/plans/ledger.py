"""Queries of usage, retention and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import usage
from docloom.plans.common import SQL_CALLS, usage_calls
from docloom.sources.tables import table

NOW, START, END = "2024-01-20 00:00:00", "2024-01-05 00:00:00", "2024-01-15 00:00:00"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def us1_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = usage.close_abandoned(usage_calls(spark, sf_dir), _ts(NOW))
    return usage.summarize(calls, _ts(START), _ts(END))


def us2_close_abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = usage.close_abandoned(usage_calls(spark, sf_dir), _ts(NOW))
    return calls.groupBy("workspace_id", "status").agg(F.count("*").alias("n"), F.max("finished_at").cast("string").alias("last_end"))


def us3_calls_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.calls_finished(usage_calls(spark, sf_dir), _ts(START), _ts(END)).select("id", "workspace_id", "status")


def us4_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts from events: some counts are no numbers, some cached counts exceed the input."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k")
    usage_json = F.concat(
        F.lit('{"input_tokens":'), F.when(e % 9 == 0, F.lit('"many"')).otherwise(F.floor("value").cast("string")),
        F.lit(',"output_tokens":'), F.when(e % 8 == 0, F.lit("-1")).otherwise(F.lit("5")),
        F.lit(',"input_token_details":{'), F.when(e % 2 == 0, F.concat(F.lit('"cache_read":'), k)).otherwise(F.concat(F.lit('"cached_tokens":'), k)),
        F.lit(',"cache_creation":'), (e % 3).cast("string"), F.lit(',"ephemeral_5m_input_tokens":2,"ephemeral_1h_input_tokens":'), (e % 4).cast("string"), F.lit("}}"),
    )
    return usage.receipts(table(spark, sf_dir, "events").select(e.alias("id"), usage_json.alias("usage")))


def us5_expired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "failed", "running", "cancelled")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    runs = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("finished_at"))
    kind = F.when(F.col("l_linestatus") == "O", "started").otherwise("done")
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), kind.alias("status"))
    return usage.expired_runs(runs, attempts, _ts("1996-01-01 00:00:00")).select("id", "status")


def us8_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created_at"), (F.col("event_id") % 9).alias("attempts"), (F.col("event_type") == "error").alias("failed"))
    stepped = usage.outbox_step(rows)
    waits = stepped.groupBy("state").agg(F.sum("wait_s").alias("waiting_s"))
    health = usage.outbox_health(stepped).join(waits, "state")
    return health.select("state", "n", F.col("oldest").cast("string").alias("oldest"), "most_attempts", "waiting_s")


def us9_purge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("seen_at"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit(None).cast("timestamp").alias("seen_at"))
    live = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"))
    plan = usage.purge_plan(events.union(orders), live, _ts("2024-01-02 00:00:00"))
    return plan.select("id", F.col("first_seen").cast("string").alias("first_seen"), "decision")


def qa2_rag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(c) % len(v) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("category"), (F.col("l_linenumber") != 1).alias("answerable"),
        pick("l_partkey", "sufficient", "partial", "none").alias("support"), pick("l_suppkey", "correct", "partial", "wrong").alias("correctness"),
        (F.col("l_quantity") > 45).alias("hallucination"), F.col("l_quantity").cast("double").alias("seconds"),
        F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey") % 5 / 4).alias("recall"), (F.col("l_partkey") % 9).alias("evidence_count"),
    )
    summary = usage.rag_summary(rows)
    return summary.select("variant", "category", "runs", *[F.round(c, 6).alias(c) for c in summary.columns[3:]])


def em3_newest_vectors(spark: SparkSession, sf_dir: str, n: int = 20_000) -> DataFrame:
    """Events as cached vectors, users dealt to three workspaces."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("workspace_id"), "user_id", "event_id", "ts")
    return usage.newest(rows, n, "workspace_id", F.desc("ts"), F.col("event_id")).select("user_id", "event_id")


QUERIES = {
    "us1_usage_summary": us1_usage_summary, "us2_close_abandoned": us2_close_abandoned, "us3_calls_finished": us3_calls_finished, "us4_receipts": us4_receipts,
    "us5_expired_runs": us5_expired_runs, "us8_outbox": us8_outbox, "us9_purge_plan": us9_purge_plan, "qa2_rag_summary": qa2_rag_summary, "em3_newest_vectors": em3_newest_vectors,
}

_CLOSED = f"""closed AS (
    SELECT * REPLACE (CASE WHEN stale THEN 'abandoned' ELSE status END AS status, CASE WHEN stale THEN TIMESTAMP '{NOW}' ELSE finished_at END AS finished_at)
    FROM (SELECT *, status = 'started' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AS stale FROM calls))"""
_KNOWN = ", ".join(f"coalesce(sum({c}), 0)::bigint AS known_{c}" for c in ("input_tokens", "output_tokens", "cached_input_tokens"))

ORACLE_SQL = {
    "us1_usage_summary": f"""
        WITH {SQL_CALLS}, {_CLOSED}
        SELECT workspace_id, user_id, provider, requested_model, model, count(*) AS calls, count(*) FILTER (status = 'failed') AS failed_calls,
               count(*) FILTER (status IN ('started', 'abandoned')) AS unfinished_calls,
               count(*) FILTER (input_tokens IS NULL OR output_tokens IS NULL) AS unknown_usage_calls, {_KNOWN},
               count(*) FILTER (cached_input_tokens IS NULL) AS unknown_cache_usage_calls
        FROM closed WHERE started_at >= TIMESTAMP '{START}' AND started_at < TIMESTAMP '{END}' GROUP BY ALL""",
    "us2_close_abandoned": f"""
        WITH {SQL_CALLS}, {_CLOSED} SELECT workspace_id, status, count(*) AS n, max(finished_at)::varchar AS last_end FROM closed GROUP BY ALL""",
    "us3_calls_finished": f"""
        WITH {SQL_CALLS} SELECT id, workspace_id, status FROM calls WHERE finished_at >= TIMESTAMP '{START}' AND finished_at < TIMESTAMP '{END}'""",
    "us4_receipts": """
        WITH t AS (
            SELECT event_id AS e, CASE WHEN event_id % 9 <> 0 THEN floor(value)::bigint END AS given, (props->>'$.k')::bigint AS k FROM events)
        SELECT e AS id, CASE WHEN given >= 0 THEN given END AS input_tokens, CASE WHEN e % 8 <> 0 THEN 5 END::bigint AS output_tokens,
               CASE WHEN NOT coalesce(k > CASE WHEN given >= 0 THEN given END, false) THEN k END AS cached_input_tokens,
               (CASE WHEN e % 3 = 0 THEN 2 + e % 4 ELSE e % 3 END)::bigint AS cache_creation_tokens FROM t""",
    "us5_expired_runs": """
        SELECT o_orderkey AS id, ['completed', 'failed', 'running', 'cancelled'][(o_orderkey % 4 + 1)::int] AS status FROM orders
        WHERE o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 90 DAY AND o_orderkey % 4 <> 2
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""",
    "us8_outbox": """
        WITH t AS (
            SELECT ts, event_id % 9 + 1 AS attempts, CASE WHEN event_type <> 'error' THEN 'sent' WHEN event_id % 9 + 1 >= 8 THEN 'dead' ELSE 'pending' END AS state FROM events)
        SELECT state, count(*) AS n, min(ts)::varchar AS oldest, max(attempts) AS most_attempts,
               sum(CASE WHEN state = 'pending' THEN least(3600, pow(2, attempts))::bigint END)::bigint AS waiting_s FROM t GROUP BY state""",
    "us9_purge_plan": """
        WITH seen AS (SELECT user_id AS id, ts FROM events UNION ALL SELECT o_custkey, NULL FROM orders),
        first AS (SELECT id, min(ts) AS t FROM seen WHERE id IS NOT NULL GROUP BY id)
        SELECT id, t::varchar AS first_seen, CASE WHEN t IS NULL THEN 'skip_no_time' WHEN t >= TIMESTAMP '2024-01-02' THEN 'skip_recent' ELSE 'purge' END AS decision
        FROM first WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)""",
    "qa2_rag_summary": """
        WITH r AS (
            SELECT l_linestatus AS variant, l_returnflag AS category, l_linenumber <> 1 AS a, ['sufficient', 'partial', 'none'][(l_partkey % 3 + 1)::int] AS s,
                   ['correct', 'partial', 'wrong'][(l_suppkey % 3 + 1)::int] AS c, l_quantity > 45 AS h, l_quantity::double AS t,
                   CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 5 / 4 END AS recall, l_partkey % 9 AS k FROM lineitem)
        SELECT variant, category, count(*) AS runs, round(count(*) FILTER (a AND s = 'sufficient') / nullif(count(*) FILTER (a), 0), 6) AS evidence_sufficient,
               round(count(*) FILTER (a AND s = 'partial') / nullif(count(*) FILTER (a), 0), 6) AS evidence_partial,
               round(count(*) FILTER (a AND s = 'none') / nullif(count(*) FILTER (a), 0), 6) AS evidence_none, round(count(*) FILTER (c = 'partial') / count(*), 6) AS partial,
               round(count(*) FILTER (c = 'wrong') / count(*), 6) AS wrong, round(count(*) FILTER (NOT a AND c = 'correct') / greatest(1, count(*) FILTER (NOT a)), 6) AS unanswerable_correct,
               round(coalesce(sum(recall) FILTER (a), 0) / nullif(count(*) FILTER (a), 0), 6) AS code_recall, round(sum(k) / count(*), 6) AS evidence_count,
               round(count(*) FILTER (c = 'correct') / count(*), 6) AS correct, round(count(*) FILTER (h) / count(*), 6) AS hallucination,
               round(count(*) FILTER (a AND c <> 'correct' AND s = 'sufficient') / nullif(count(*) FILTER (a), 0), 6) AS fail_generation,
               round(count(*) FILTER (a AND c <> 'correct' AND s <> 'sufficient') / nullif(count(*) FILTER (a), 0), 6) AS fail_retrieval, round(avg(t), 6) AS seconds
        FROM r GROUP BY GROUPING SETS ((variant), (variant, category))""",
    "em3_newest_vectors": """
        SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 20000""",
}
