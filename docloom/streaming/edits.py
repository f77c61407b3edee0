"""The stream of edit events: parsing, the latest state of each document, and what is still to be ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.replay import latest_state
from docloom.sources.keyed import BUCKETS, current, merge  # noqa: F401 (current reads the state)

EVENT = "document_id string, workspace_id string, revision string, content_hash string, created_at string"


def parsed(raw: DataFrame) -> DataFrame:
    """raw (value: JSON text or bytes) with the event's fields and whether it is valid; nothing is dropped."""
    event = F.from_json(F.col("value").cast("string"), EVENT)
    fields = raw.withColumn("e", event).select(
        "value", "e.document_id", "e.workspace_id", F.col("e.revision").try_cast("long").alias("revision"), "e.content_hash", F.try_to_timestamp("e.created_at").alias("created_at")
    )
    named = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("document_id", "workspace_id", "content_hash")]
    return fields.withColumn("valid", named[0] & named[1] & named[2] & F.col("revision").isNotNull() & F.col("created_at").isNotNull())


def accepted(raw: DataFrame, purged: DataFrame) -> DataFrame:
    """Valid events of workspaces that have not been purged; purged is a static table."""
    events = parsed(raw).filter("valid").drop("value", "valid")
    return events.join(purged.select("workspace_id").distinct(), "workspace_id", "left_anti").select("document_id", "workspace_id", "revision", "content_hash", "created_at")


def rejected(raw: DataFrame) -> DataFrame:
    return parsed(raw).filter("NOT valid").select("value")


def follow(raw: DataFrame, purged: DataFrame, state_path: str, checkpoint: str, rejected_path: str | None = None, buckets: int = BUCKETS):
    """Starts the stream that keeps the state table at state_path (see sources.keyed) and, if a path is given, what was rejected.

    Each micro-batch reads the buckets of its documents and rewrites those that it changes, so what is written is bounded by
    the batch's keys. A batch that is run again leaves the same state: a revision never goes back. What a batch
    rejects is a folder named by the batch, which a retry overwrites.
    """

    def merge_batch(batch: DataFrame, number: int) -> None:
        if rejected_path:
            rejected(batch).write.mode("overwrite").parquet(f"{rejected_path}/batch={number:012d}")
        merge(state_path, accepted(batch, purged), ["document_id"], latest_state, buckets)

    return raw.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mark_ingested(state: DataFrame, ingested: DataFrame) -> DataFrame:
    """state with ingested_hash where what was ingested (document_id, hash) is still the last edit."""
    joined = state.join(ingested.select("document_id", F.col("hash").alias("__hash")), "document_id", "left")
    return joined.withColumn("ingested_hash", F.when(F.col("__hash") == F.col("content_hash"), F.col("__hash")).otherwise(F.col("ingested_hash"))).drop("__hash")
