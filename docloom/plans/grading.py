"""Queries of conversion grades, payloads and streams, late ends of calls, hints, observations and ungrounded items."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import concepts, grading, usage
from docloom.plans.common import SQL_CALLS, usage_calls
from docloom.sources.store import shared_dir
from docloom.sources.streams import file_events, messages
from docloom.sources.tables import json_rows, table
from docloom.streaming import edits

_RUNS = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"]


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as converted documents, their line items as sentences and as table rows. Some sentences and rows are lost, some orders
    come out by part instead of by line."""
    line = table(spark, sf_dir, "lineitem").withColumn("position", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    sentence = F.format_string("Item **%d** from – %d &amp; line %d.", "l_partkey", "l_suppkey", "l_linenumber")
    cells = F.array(F.concat(F.lit("<b>P"), "l_partkey", F.lit("</b>")), F.lit("-"), F.concat(F.lit("S "), "l_suppkey", F.lit(";")))
    ints = lambda *c: F.array(*[F.col(x).cast("long") for x in c])
    place = F.when(F.col("l_orderkey") % 5 == 0, ints("l_partkey", "l_suppkey", "l_linenumber")).otherwise(ints("l_linenumber", "l_partkey", "l_suppkey"))
    plain = F.when(F.col("l_partkey") % 7 != 0, F.format_string("ITEM %d from - %d & line %d.", "l_partkey", "l_suppkey", "l_linenumber"))
    row = F.when(F.col("l_suppkey") % 6 == 0, F.format_string("| S %d; | P%d |", "l_suppkey", "l_partkey")).when(
        F.col("l_suppkey") % 6 == 1, F.format_string("<tr><td>P%d</td><td>S %d;</td></tr>", "l_partkey", "l_suppkey")
    ).otherwise(F.format_string("| P%d | S %d; |", "l_partkey", "l_suppkey"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(c).alias("x")))), lambda v: v["x"]), "\n")
    parts = line.select("l_orderkey", place.alias("p"), plain.alias("s"), row.alias("r")).groupBy("l_orderkey").agg(listed("s").alias("s"), listed("r").alias("r"))
    orders = table(spark, sf_dir, "orders").select(*_RUNS)
    results = orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.lit(1).alias("run"), F.col("o_orderpriority").alias("type"), F.when(F.col("o_custkey") % 9 == 0, "failed").otherwise("completed").alias("status"),
        (F.col("o_custkey") % 50).cast("double").alias("seconds"), F.concat("s", F.lit("\n\n"), "r").alias("markdown"),
    )
    key = F.col("l_orderkey").alias("id")
    return results, line.select(key, "position", sentence.alias("sentence")), line.select(key, cells.alias("cells"))


def qa3_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.conversion_grades(*_gold(spark, sf_dir)).select("id", "status", "missing", "order_errors", "table_errors", "sentences", "table_rows", "ok")


def qa3_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grading.grade_summary(grading.conversion_grades(*_gold(spark, sf_dir)))


def io3_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events as records."""
    events = json_rows(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long")
    return events.select("event_id", F.col("props.k").alias("k"))


def io4_followed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a stream, followed to its end; the state that it leaves."""
    given = file_events(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    events = given.select(
        F.concat(F.lit("d"), "user_id").alias("document_id"), F.concat(F.lit("w"), F.col("user_id") % 4).alias("workspace_id"), F.col("event_id").alias("revision"),
        F.when(F.col("event_id") % 13 != 0, F.sha1("event_type")).alias("content_hash"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    place = f"{shared_dir(spark)}/edits-{uuid.uuid4().hex}"
    purged = table(spark, sf_dir, "nation").filter("n_nationkey = 3").select(F.concat(F.lit("w"), "n_nationkey").alias("workspace_id"))
    edits.follow(messages(events).select("value"), purged, f"{place}/state", f"{place}/checkpoint").awaitTermination()
    return edits.current(spark, f"{place}/state").select("document_id", "workspace_id", "revision", "content_hash")


def us2_late_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls closed as abandoned and the late ends of every third call."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    calls = usage.close_abandoned(usage_calls(spark, sf_dir), now).withColumn("run_id", F.col("id") % 40)
    ends = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(
        F.col("event_id").alias("id"), F.lit("completed").alias("status"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("finished_at"), (F.col("event_id") % 100).alias("output_tokens")
    )
    done = usage.finished(calls, ends)
    return done.groupBy("run_id", "status").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"), F.max("finished_at").cast("string").alias("last_end"))


def us3_calls_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = usage_calls(spark, sf_dir).withColumn("run_id", F.col("id") % 40)
    return usage.calls_of_run(calls, F.lit(7)).select("id", "status", F.col("started_at").cast("string").alias("started_at"))


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    known = table(spark, sf_dir, "part").select((p % 10).alias("document_id"), F.concat(F.lit("n"), p % 70).alias("name_key"), F.concat(F.lit("s"), p % 90).alias("slug"), (p % 5).alias("importance"))
    hint = F.when(o % 3 == 0, F.concat(F.lit("s"), o % 90)).otherwise(F.concat(F.lit("n"), o % 80))
    evidence = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("document_id"), o.alias("evidence_id"), hint.alias("hint"), (o % 13 / 10).alias("confidence"), F.concat(F.lit("c"), o).alias("claim")
    )
    return known, concepts.attached_evidence(evidence, known)


def er4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, attached = _evidence(spark, sf_dir)
    first = known.groupBy("document_id", "slug").agg(F.max("importance").alias("importance"))
    return concepts.evidence_importance(first, attached).select("document_id", "slug", F.round("importance", 4).alias("importance"))


def er4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = concepts.unmatched_hints(_evidence(spark, sf_dir)[1])
    return hints.select("document_id", "hint", "n", F.array_join("samples", ",").alias("samples"), "max_confidence")


def lq13_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: line items as items and blocks, and as the evidence of their suppliers."""
    line = table(spark, sf_dir, "lineitem").withColumn("pos", F.col("l_linenumber") * 100_000 + F.col("l_partkey"))
    number = lambda *c: tx.number_tokens(F.concat_ws(" ", F.lit("about"), *c))
    d = F.col("l_orderkey").alias("document_id")
    items = line.select(d, F.col("pos").alias("item_id"), number(F.col("l_partkey").cast("string")).alias("numbers"), F.array(F.col("l_linenumber"), F.col("l_linenumber") + 1).alias("refs"))
    blocks = line.select(d, F.col("l_linenumber").alias("ref"), number((F.col("l_partkey") - F.col("l_partkey") % 2).cast("string")).alias("numbers"))
    ledger = line.groupBy(d, (F.col("l_suppkey") % 3).alias("slug")).agg(F.array_sort(F.collect_list("pos")).alias("evidence_ids"))
    kept, linked = concepts.without_ungrounded(items, concepts.ungrounded_numbers(items, blocks), ledger)
    counts = kept.groupBy("document_id").agg(F.count("*").alias("kept"))
    return linked.join(counts, "document_id", "left").select("document_id", "slug", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.coalesce("kept", F.lit(0)).alias("kept"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as observations; some say nothing, some are placeholders, some cite nothing."""
    d = F.col("doc_id")
    none = F.array().cast("array<string>")
    summary = F.when(d % 11 == 0, " - ").when(d % 13 == 0, "").when(d % 17 == 0, F.concat("text", F.lit(" ["))).when(d % 19 == 0, F.concat(F.lit("(a) ("), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        (d % 50).alias("document_id"), d.alias("observation_id"), F.col("source").alias("title"), summary.alias("summary"),
        F.when(d % 2 == 0, none).otherwise(F.array("source")).alias("claims"), F.when(d % 5 == 0, none).otherwise(F.array("lang")).alias("anchors"),
    )


def lq15_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.observation_findings(_observations(spark, sf_dir))


def lq15_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that are alike, by document."""
    signature = concepts.observation_signature(F.lit(""), F.col("summary"), F.col("title"))
    alike = _observations(spark, sf_dir).groupBy("document_id", F.md5(signature).alias("signature")).agg(F.count("*").alias("n"), F.min("observation_id").alias("first_id"))
    return alike


QUERIES = {
    "qa3_grades": qa3_grades, "qa3_summary": qa3_summary, "io3_payloads": io3_payloads, "io4_followed_edits": io4_followed_edits, "us2_late_ends": us2_late_ends,
    "us3_calls_of_run": us3_calls_of_run, "er4_importance": er4_importance, "er4_unmatched": er4_unmatched, "lq13_dropped": lq13_dropped, "lq15_findings": lq15_findings,
    "lq15_signatures": lq15_signatures,
}

_NORM = lambda t: f"lower(regexp_replace(regexp_replace(replace({t}, '&amp;', '&'), '</?[A-Za-z][^>]*>', '', 'g'), '[\\s*_`#>|\\\\\\-−–—~∼・•·]+', '', 'g'))"
_GRADES = f"""l AS (
        SELECT *, 'Item **' || l_partkey || '** from – ' || l_suppkey || ' &amp; line ' || l_linenumber || '.' AS sentence,
               CASE WHEN l_partkey % 7 <> 0 THEN 'ITEM ' || l_partkey || ' from - ' || l_suppkey || ' & line ' || l_linenumber || '.' END AS plain,
               CASE WHEN l_suppkey % 6 = 0 THEN 'S ' || l_suppkey || ';P' || l_partkey ELSE 'P' || l_partkey || 'S ' || l_suppkey || ';' END AS cells,
               CASE WHEN l_orderkey % 5 = 0 THEN [l_partkey, l_suppkey, l_linenumber] ELSE [l_linenumber, l_partkey, l_suppkey] END AS place FROM lineitem),
    t AS (SELECT l_orderkey AS id, {_NORM("string_agg(plain, chr(10) ORDER BY place)")} AS text, list({_NORM("cells")}) AS rows FROM l GROUP BY ALL),
    g AS (SELECT t.*, o_orderpriority AS type, CASE WHEN o_custkey % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, (o_custkey % 50)::double AS seconds FROM t JOIN orders ON o_orderkey = id),
    p AS (
        SELECT id, [l_linenumber, l_partkey, l_suppkey] AS k, nullif(coalesce(strpos(text, {_NORM("sentence")}), 0), 0) AS pl,
               len(list_filter(rows, lambda r: regexp_matches(r, 'p' || l_partkey || '.*s' || l_suppkey || ';'))) = 0 AS lost
        FROM g JOIN l ON l_orderkey = id WHERE status = 'completed'),
    c AS (SELECT id, count(*) AS n, count(*) FILTER (pl IS NULL) AS missing, count(*) FILTER (lost) AS table_errors FROM p GROUP BY id),
    u AS (SELECT id, count(*) FILTER (turned) AS order_errors FROM (SELECT id, lag(pl) OVER (PARTITION BY id ORDER BY k) > pl AS turned FROM p WHERE pl IS NOT NULL) GROUP BY id),
    grades AS (
        SELECT id, type, status, seconds, missing, CASE WHEN status = 'completed' THEN coalesce(order_errors, 0) END AS order_errors, table_errors, n AS sentences, n AS table_rows,
               coalesce(missing + coalesce(order_errors, 0) + table_errors = 0, false) AS ok FROM g LEFT JOIN c USING (id) LEFT JOIN u USING (id))"""
_OBSERVED = """o AS (
        SELECT doc_id, source, CASE WHEN doc_id % 11 = 0 THEN ' - ' WHEN doc_id % 13 = 0 THEN '' WHEN doc_id % 17 = 0 THEN text || ' [' WHEN doc_id % 19 = 0 THEN '(a) (' || text ELSE text END AS s
        FROM documents)"""
_OPEN = " OR ".join(f"length(s) - length(replace(s, '{a}', '')) > length(s) - length(replace(s, '{b}', ''))" for a, b in ("()", "[]", "{}", "“”"))
_ENDS = " OR ".join(f"ends_with(regexp_replace(s, '\\s+$', ''), {c})" for c in ("'('", "'['", "'{'", "'“'", "'\"'", "''''"))
_ATTACHED = """c AS (SELECT p_partkey % 10 AS d, 'n' || p_partkey % 70 AS k, 's' || p_partkey % 90 AS s, p_partkey % 5 AS importance FROM part),
        u AS (SELECT d, k, min(s) AS s FROM c GROUP BY d, k HAVING count(DISTINCT s) = 1), g AS (SELECT DISTINCT d, s FROM c),
        e AS (SELECT o_custkey % 10 AS d, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_orderkey % 90 ELSE 'n' || o_orderkey % 80 END AS h, o_orderkey % 13 / 10 AS f FROM orders),
        a AS (SELECT e.*, coalesce(u.s, g.s) AS slug FROM e LEFT JOIN u ON u.d = e.d AND u.k = h LEFT JOIN g ON g.d = e.d AND g.s = h)"""

ORACLE_SQL = {
    "qa3_grades": f"WITH {_GRADES} SELECT id, status, missing, order_errors, table_errors, sentences, table_rows, ok FROM grades",
    "qa3_summary": f"""
        WITH {_GRADES}
        SELECT type, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (ok) AS ok, coalesce(sum(missing), 0)::bigint AS missing,
               coalesce(sum(order_errors), 0)::bigint AS order_errors, coalesce(sum(table_errors), 0)::bigint AS table_errors, coalesce(sum(sentences), 0)::bigint AS sentences,
               coalesce(sum(table_rows), 0)::bigint AS table_rows, round(avg(seconds) FILTER (status = 'completed'), 1) AS seconds,
               round(1 - sum(missing) / sum(sentences), 4) AS restored, round(1 - sum(table_errors) / sum(table_rows), 4) AS table_restored
        FROM grades GROUP BY ROLLUP (type)""",
    "io3_payloads": "SELECT event_id, (props->>'$.k')::bigint AS k FROM events",
    "io4_followed_edits": """
        SELECT 'd' || user_id AS document_id, 'w' || user_id % 4 AS workspace_id, max(event_id) AS revision, sha1(arg_max(event_type, event_id)) AS content_hash
        FROM events WHERE event_id % 13 <> 0 AND user_id % 4 <> 3 GROUP BY user_id""",
    "us2_late_ends": f"""
        WITH {SQL_CALLS},
        d AS (
            SELECT *, id % 3 = 0 AS late, status = 'started' AND started_at < TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR AS stale FROM calls)
        SELECT id % 40 AS run_id, CASE WHEN stale THEN 'abandoned' WHEN late THEN 'completed' ELSE status END AS status, count(*) AS n,
               sum(CASE WHEN late THEN id % 100 ELSE output_tokens END)::bigint AS output_tokens,
               max(CASE WHEN stale THEN TIMESTAMP '2024-01-20' WHEN late THEN TIMESTAMP '2024-02-01' ELSE finished_at END)::varchar AS last_end FROM d GROUP BY ALL""",
    "us3_calls_of_run": f"WITH {SQL_CALLS} SELECT id, status, started_at::varchar AS started_at FROM calls WHERE id % 40 = 7",
    "er4_importance": f"""
        WITH {_ATTACHED}, b AS (SELECT d, s, max(importance) AS importance FROM c GROUP BY ALL)
        SELECT b.d AS document_id, b.s AS slug, round(any_value(importance) + 2 * coalesce(sum(greatest(0, least(1, f))) FILTER (a.slug IS NOT NULL), 0), 4)::double AS importance
        FROM b LEFT JOIN a ON a.d = b.d AND a.slug = b.s GROUP BY ALL""",
    "er4_unmatched": f"""
        WITH {_ATTACHED}, k AS (SELECT *, row_number() OVER (PARTITION BY d, h ORDER BY id) AS k FROM a WHERE slug IS NULL)
        SELECT d AS document_id, h AS hint, count(*) AS n, string_agg('c' || id, ',' ORDER BY k) FILTER (k <= 2) AS samples, max(f)::double AS max_confidence FROM k GROUP BY ALL""",
    "lq13_dropped": """
        WITH b AS (SELECT l_orderkey AS d, l_linenumber AS r, l_partkey - l_partkey % 2 AS n FROM lineitem),
        i AS (
            SELECT l_orderkey AS d, l_linenumber * 100000 + l_partkey AS pos, l_suppkey % 3 AS slug,
                   l_partkey <= 9 OR EXISTS (SELECT 1 FROM b WHERE d = l_orderkey AND r IN (l_linenumber, l_linenumber + 1) AND n = l_partkey) AS stays FROM lineitem)
        SELECT d AS document_id, slug, coalesce(string_agg(pos::varchar, ',' ORDER BY pos) FILTER (stays), '') AS evidence_ids,
               (SELECT count(*) FROM i j WHERE j.d = i.d AND stays) AS kept FROM i GROUP BY d, slug""",
    "lq15_findings": f"""
        WITH {_OBSERVED}
        SELECT doc_id % 50 AS document_id, doc_id AS observation_id, 'missing_ref' AS finding FROM o WHERE doc_id % 5 = 0
        UNION ALL SELECT doc_id % 50, doc_id, 'broken' FROM o WHERE trim(s) IN ('-', '없음', 'N/A') OR {_OPEN} OR {_ENDS} OR (trim(s) = '' AND doc_id % 2 = 0)""",
    "lq15_signatures": f"""
        WITH {_OBSERVED}, c AS (SELECT *, regexp_replace(trim(regexp_replace(lower(s), '\\s+', ' ', 'g')), '[^0-9a-z가-힣 ]+', '', 'g') AS x, lower(source) AS y FROM o)
        SELECT doc_id % 50 AS document_id, md5(CASE WHEN x <> '' THEN 's:' || x[1:80] WHEN regexp_replace(y, '[^0-9a-z가-힣 ]+', '', 'g') <> '' THEN 't:' || regexp_replace(y, '[^0-9a-z가-힣 ]+', '', 'g') END) AS signature,
               count(*) AS n, min(doc_id) AS first_id FROM c GROUP BY ALL""",
}
