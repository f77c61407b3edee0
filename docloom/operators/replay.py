"""Event-sourced pages: which links, evidence and values survive the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.invalidation import first_places


def supported_links(events: DataFrame) -> DataFrame:
    """Links that the log leaves in place.

    events: artifact, sequence, op ('add' or 'remove'), source, target, relation, entry_id, requires_operation and
    the operation itself. An add is undone by a later remove of its entry, or by a later remove without an entry of
    the whole link; one that another operation carried needs that operation to be in the log.
    """
    link = ["artifact", "source", "target", "relation"]
    adds = events.filter("op = 'add'").groupBy(*link, "entry_id").agg(F.max_by(F.struct("sequence", "requires_operation"), "sequence").alias("x")).select(*link, "entry_id", "x.*")
    removes = events.filter("op = 'remove'")
    whole = removes.filter("entry_id IS NULL").groupBy(*link).agg(F.max("sequence").alias("cleared"))
    single = removes.filter("entry_id IS NOT NULL").groupBy(*link, F.col("entry_id").alias("gone_entry")).agg(F.max("sequence").alias("removed"))
    operations = events.select(F.col("operation").alias("requires_operation")).distinct().withColumn("there", F.lit(True))
    a, s = adds.alias("a"), single.alias("s")
    same = [F.col(f"a.{c}") == F.col(f"s.{c}") for c in link] + [F.col("a.entry_id") == F.col("s.gone_entry")]
    joined = a.join(s, same, "left").select("a.*", "removed").join(whole, link, "left").join(operations, "requires_operation", "left")
    kept = joined.filter((F.col("sequence") > F.coalesce("cleared", F.lit(-1))) & (F.col("sequence") > F.coalesce("removed", F.lit(-1))) & (F.col("requires_operation").isNull() | F.col("there")))
    return kept.select(*link, "entry_id", "sequence")


def surviving_evidence(evidence: DataFrame, invalidations: DataFrame, deletes: DataFrame) -> DataFrame:
    """Evidence after its page's last delete without those of which a later entry invalidated a reference.

    evidence: page_id, evidence_id, sequence, refs; invalidations: page_id, ref, sequence; deletes: page_id, sequence.
    """
    cut = deletes.groupBy("page_id").agg(F.max("sequence").alias("deleted"))
    alive = evidence.join(cut, "page_id", "left").filter(F.col("sequence") > F.coalesce("deleted", F.lit(-1))).drop("deleted")
    latest = invalidations.groupBy("page_id", "ref").agg(F.max("sequence").alias("stale"))
    cited = alive.select("page_id", "evidence_id", "sequence", F.explode("refs").alias("ref"))
    stale = cited.join(latest, ["page_id", "ref"]).filter("stale > sequence").select("page_id", "evidence_id", "sequence").distinct()
    return alive.join(stale, ["page_id", "evidence_id", "sequence"], "left_anti")


def with_pending(ledger: DataFrame, pending: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows (page_id, operation_id, document_id, payload, sequence, active, state): the ledger with what has not arrived in it yet.

    ledger: page_id, operation_id, document_id, payload, sequence, active, linked_by, source_removed; pending: the same without source_removed, with
    kind, rejected, created_at and superseded_at; tombstones: document_id, deleted_at. Superseded rows do not count. A document that was deleted after a
    pending row was made leaves it inactive. A pending row that is in the ledger too must agree with it (document, payload, whether active,
    link, and sequence if it has one) or is a conflict, as is one that the receiver rejected; one without a sequence that is not
    there is unresolved.
    """
    key = ["page_id", "operation_id"]
    waiting = pending.filter("superseded_at IS NULL")
    deleted = tombstones.groupBy("document_id").agg(F.max("deleted_at").alias("deleted_at"))
    waiting = waiting.join(deleted, "document_id", "left").withColumn("live", F.coalesce("active", F.lit(False)) & ~F.coalesce(F.col("deleted_at") > F.col("created_at"), F.lit(False)))
    fields = ("document_id", "payload", "sequence", "linked_by")
    a = ledger.select(*key, *fields, F.coalesce("active", F.lit(False)).alias("active"), F.coalesce("source_removed", F.lit(False)).alias("removed"), F.lit(True).alias("stored"))
    b = waiting.select(*key, *[F.col(c).alias(f"p_{c}") for c in fields], "live", "kind", F.coalesce("rejected", F.lit(False)).alias("rejected"), F.lit(True).alias("waiting"))
    both = a.join(b, key, "full")
    linked = F.col("linked_by").eqNullSafe(F.col("p_linked_by")) | (F.col("kind").eqNullSafe(F.lit("RESTORE")) & F.col("p_linked_by").isNull() & F.col("p_sequence").isNotNull())
    removed = F.col("p_document_id").isNotNull() & F.col("removed")
    agrees = (
        F.col("document_id").eqNullSafe(F.col("p_document_id")) & F.col("payload").eqNullSafe(F.col("p_payload")) & linked
        & (F.col("active") == (F.col("live") & ~removed)) & (F.col("p_sequence").isNull() | F.col("sequence").eqNullSafe(F.col("p_sequence")))
    )
    state = (
        F.when(F.col("rejected"), "conflict")
        .when(F.col("stored") & F.col("waiting"), F.when((F.col("sequence") > 0) & agrees, "stored").otherwise("conflict"))
        .when(F.col("stored"), "stored")
        .when(F.col("p_sequence").isNull(), "unresolved")
        .otherwise("pending")
    )
    either = lambda c: F.when(F.col("stored"), F.col(c)).otherwise(F.col(f"p_{c}")).alias(c)
    return both.select(*key, either("document_id"), either("payload"), either("sequence"), F.when(F.col("stored"), F.col("active")).otherwise(F.col("live")).alias("active"), state.alias("state"))


def undo_plan(log: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (row_key, action, value) that take a run's changes back, its first before-values against today's rows.

    log: row_key, id, before_value, after_value; current: row_key, value. A row that no longer is what the run left
    is a conflict.
    """
    ends = log.groupBy("row_key").agg(F.min_by(F.struct(F.col("before_value").alias("v")), "id").alias("b"), F.max_by(F.struct(F.col("after_value").alias("v")), "id").alias("a"))
    now = ends.join(current, "row_key", "left")
    action = (
        F.when(~F.col("value").eqNullSafe(F.col("a.v")), "conflict")
        .when(F.col("b.v").eqNullSafe(F.col("a.v")), "nothing")
        .when(F.col("b.v").isNull(), "delete")
        .when(F.col("a.v").isNull(), "insert")
        .otherwise("update")
    )
    return now.select("row_key", action.alias("action"), F.col("b.v").alias("value"))


def merged_pages(contributions: DataFrame) -> DataFrame:
    """A page's surviving contributions (page_id, sequence, title, definition, refs, mention_refs, aliases, mention_count, importance) as one: the last
    title and definition that are not empty, lists in order without repeats, the largest importance. Mentions are counted by
    their references, or else the largest count that was recorded stays."""
    given = lambda c: F.when(F.trim(c) != "", F.col(c))
    last = lambda c: F.max_by(given(c), F.when(given(c).isNotNull(), F.col("sequence"))).alias(c)
    pages = contributions.groupBy("page_id").agg(last("title"), last("definition"), F.max("importance").alias("importance"), F.max("mention_count").alias("most"), F.count("*").alias("n"))
    kinds = dict(contributions.dtypes)
    for name in ("refs", "mention_refs", "aliases"):
        pages = pages.join(first_places(contributions, ["page_id"], name, name), "page_id", "left").withColumn(name, F.coalesce(name, F.array().cast(kinds[name])))
    count = F.when(F.size("mention_refs") > 0, F.size("mention_refs")).otherwise(F.coalesce("most", F.lit(0)))
    return pages.withColumn("mention_count", count.cast("long")).drop("most")


def latest_state(old: DataFrame, events: DataFrame) -> DataFrame:
    """Each document's state by its largest revision; a revision never goes back, ties keep what is there."""
    best = events.groupBy("document_id").agg(F.max_by(F.struct("workspace_id", "revision", "content_hash", "created_at"), "revision").alias("e")).select("document_id", "e.*")
    both = old.withColumn("__new", F.lit(0)).unionByName(best.withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("revision"), "__new"))
    return both.withColumn("__k", place).filter("__k = 1").drop("__k", "__new")
