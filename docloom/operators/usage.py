"""Model-usage ledger, retention and outbox: aggregations over large fact tables with few groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End states after which a run may expire.
END_STATES = ["completed", "partial_failed", "failed", "conflicted", "rejected", "cancelled"]


def close_abandoned(calls: DataFrame, now: Column) -> DataFrame:
    """Calls that began more than an hour before now and never ended are abandoned and end now."""
    stale = (F.col("status") == "started") & (F.col("started_at") < now - F.expr("INTERVAL 1 HOUR"))
    return calls.withColumns({"finished_at": F.when(stale, now).otherwise(F.col("finished_at")), "status": F.when(stale, "abandoned").otherwise(F.col("status"))})


def summarize(calls: DataFrame, start: Column, end: Column) -> DataFrame:
    """Calls that began in [start, end) by workspace, user, provider and model. Unknown counts are counted, not taken for 0."""
    known = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"known_{c}")
    return (
        calls.filter((F.col("started_at") >= start) & (F.col("started_at") < end))
        .groupBy("workspace_id", "user_id", "provider", "requested_model", "model")
        .agg(
            F.count("*").alias("calls"),
            F.count_if(F.col("status") == "failed").alias("failed_calls"),
            F.count_if(F.col("status").isin("started", "abandoned")).alias("unfinished_calls"),
            F.count_if(F.col("input_tokens").isNull() | F.col("output_tokens").isNull()).alias("unknown_usage_calls"),
            known("input_tokens"),
            known("output_tokens"),
            known("cached_input_tokens"),
            F.count_if(F.col("cached_input_tokens").isNull()).alias("unknown_cache_usage_calls"),
        )
    )


def calls_finished(calls: DataFrame, start: Column, end: Column) -> DataFrame:
    return calls.filter((F.col("finished_at") >= start) & (F.col("finished_at") < end))


def calls_of_run(calls: DataFrame, run: Column) -> DataFrame:
    return calls.filter(F.col("run_id") == run)


def finished(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """calls with what their ends (id, status, finished_at, counts) report; one that was closed as abandoned keeps status and time and only
    takes the counts, so that it stays in one period."""
    counts = [c for c in ends.columns if c not in ("id", "status", "finished_at")]
    late = ends.select("id", F.lit(True).alias("__ended"), F.col("status").alias("__status"), F.col("finished_at").alias("__at"), *[F.col(c).alias(f"__{c}") for c in counts])
    ended, open_ = F.col("__ended").isNotNull(), F.col("status") != "abandoned"
    new = {c: F.when(ended, F.col(f"__{c}")).otherwise(F.col(c)) for c in counts}
    new["status"] = F.when(ended & open_, F.col("__status")).otherwise(F.col("status"))
    new["finished_at"] = F.when(ended & open_, F.col("__at")).otherwise(F.col("finished_at"))
    return calls.join(late, "id", "left").withColumns(new).select(*calls.columns)


def token_count(text: Column) -> Column:
    """A count as a whole number of at least 0, else null."""
    n = F.when(F.rlike(text, F.lit("^[0-9]{1,18}$")), text.try_cast("long"))
    return n


def receipts(raw: DataFrame) -> DataFrame:
    """raw (id, usage: JSON) with input_tokens, output_tokens, cached_input_tokens and cache_creation_tokens.

    Counts that are no whole numbers are unknown; more cached than given is unknown; without a total of created
    cache the parts by lifetime are added.
    """
    read = lambda path: token_count(F.get_json_object("usage", f"$.{path}"))
    cached = F.coalesce(read("input_token_details.cache_read"), read("input_token_details.cached_tokens"))
    parts = [read(f"input_token_details.{k}") for k in ("ephemeral_5m_input_tokens", "ephemeral_1h_input_tokens")]
    both = F.coalesce(parts[0], F.lit(0)) + F.coalesce(parts[1], F.lit(0))
    created = read("input_token_details.cache_creation")
    return raw.select(
        "id",
        read("input_tokens").alias("input_tokens"),
        read("output_tokens").alias("output_tokens"),
        F.when(~F.coalesce(cached > read("input_tokens"), F.lit(False)), cached).alias("cached_input_tokens"),
        F.when((F.coalesce(created, F.lit(0)) == 0) & (both > 0), both).otherwise(created).alias("cache_creation_tokens"),
    )


def expired_runs(runs: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Runs in an end state for more than 90 days without an attempt that may still be open."""
    old = runs.filter((F.col("finished_at") < now - F.expr("INTERVAL 90 DAYS")) & F.col("status").isin(END_STATES))
    return old.join(attempts.filter(F.col("status").isin("started", "unknown")).select("run_id").distinct(), old["id"] == F.col("run_id"), "left_anti")


def outbox_step(rows: DataFrame, most: int = 8) -> DataFrame:
    """Rows (event_id, attempts, failed) after an attempt: its number, state and the seconds to the next one."""
    n = F.col("attempts") + 1
    state = F.when(~F.col("failed"), "sent").when(n >= most, "dead").otherwise("pending")
    wait = F.when(state == "pending", F.least(F.lit(3600), F.pow(F.lit(2.0), n)).cast("long"))
    return rows.select("event_id", "created_at", n.alias("attempts"), state.alias("state"), wait.alias("wait_s"))


def outbox_health(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"), F.max("attempts").alias("most_attempts"))


def purge_plan(seen: DataFrame, live: DataFrame, start: Column) -> DataFrame:
    """Ids seen in any table, the earliest time each, that the live list lacks: purge, or why not.

    seen: (id, seen_at) from all tables; start: the time of the export, after which ids may be new.
    """
    earliest = seen.filter("id IS NOT NULL").groupBy("id").agg(F.min("seen_at").alias("first_seen"))
    gone = earliest.join(live.select("id").distinct(), "id", "left_anti")
    decision = F.when(F.col("first_seen").isNull(), "skip_no_time").when(F.col("first_seen") >= start, "skip_recent").otherwise("purge")
    return gone.withColumn("decision", decision)


def rag_summary(rows: DataFrame) -> DataFrame:
    """Evaluation rows by variant, and by variant and category (category null for the whole variant)."""
    answerable = F.col("answerable")
    part = lambda cond, of: F.when(of > 0, F.count_if(cond) / of)
    n, na = F.count("*"), F.count_if(answerable)
    wrong = answerable & (F.col("correctness") != "correct")
    return rows.groupingSets([["variant"], ["variant", "category"]], "variant", "category").agg(
        n.alias("runs"),
        part(answerable & (F.col("support") == "sufficient"), na).alias("evidence_sufficient"),
        part(answerable & (F.col("support") == "partial"), na).alias("evidence_partial"),
        part(answerable & ~F.coalesce(F.col("support").isin("sufficient", "partial"), F.lit(False)), na).alias("evidence_none"),
        *[part(F.col("correctness") == c, n).alias(c) for c in ("correct", "partial", "wrong")],
        part(F.col("hallucination"), n).alias("hallucination"),
        (F.count_if(~answerable & (F.col("correctness") == "correct")) / F.greatest(F.lit(1), F.count_if(~answerable))).alias("unanswerable_correct"),
        part(wrong & (F.col("support") == "sufficient"), na).alias("fail_generation"),
        part(wrong & ~F.coalesce(F.col("support") == "sufficient", F.lit(False)), na).alias("fail_retrieval"),
        F.when(na > 0, F.coalesce(F.sum(F.when(answerable, F.col("recall"))), F.lit(0.0)) / na).alias("code_recall"),
        (F.sum("evidence_count") / n).alias("evidence_count"),
        F.avg("seconds").alias("seconds"),
    )


def newest(rows: DataFrame, n: int, key: str, *order: Column) -> DataFrame:
    """The first n rows of each key in an order."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")
