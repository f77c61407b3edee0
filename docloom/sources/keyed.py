"""Tables in a folder that are merged by key: only the buckets that a load touches are read, and only those it changes are written.

A table is Parquet partitioned by `bucket`, a hash of its keys; the number of buckets is chosen once, so that a bucket is some tens of
megabytes. A merge reads the buckets of the new rows' keys, combines old and new rows, and overwrites by Spark's dynamic partition
overwrite those buckets whose rows differ afterwards. A merge that is run again after a crash reads what is there and comes to
the same rows, if combining is repeatable (newest version wins, sets are united, documents are replaced): all that are here are.
One writer at a time; a reader during the commit may see some buckets before and some after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.store import forget, written

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = _folder(spark, path)
    return fs.exists(folder) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(folder))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table's rows, or None if nothing was ever merged into it."""
    return spark.read.parquet(path).drop("bucket") if exists(spark, path) else None


def merge(path: str, new: DataFrame, keys: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> list[int]:
    """Merges new into the table at path by combine(old, new), both without other keys' buckets; the buckets that were written.

    new has the table's columns, or combine gives them to old rows that are none yet. At most `buckets` numbers come to the driver.
    """
    spark = new.sparkSession
    rows = written(new.withColumn("bucket", bucket_of(keys, buckets)))
    touched = sorted(b for (b,) in rows.select("bucket").distinct().collect())
    if not touched:
        forget(rows)
        return []
    if exists(spark, path):
        before = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        old = before.drop("bucket")
    else:
        before, old = None, combine(rows.drop("bucket").limit(0), rows.drop("bucket").limit(0))
    after = written(combine(old, rows.drop("bucket")).withColumn("bucket", bucket_of(keys, buckets)))
    names = sorted(c for c in after.columns if c != "bucket")
    digest = lambda t: {b: (n, d) for b, n, d in t.groupBy("bucket").agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).collect()}
    had, has = digest(before) if before is not None else {}, digest(after)
    changed = [b for b in touched if b in has and has[b] != had.get(b)]
    if changed:
        out = after.filter(F.col("bucket").isin(changed)).repartition("bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    emptied = [b for b in touched if b in had and b not in has]
    fs, _ = _folder(spark, path)
    for b in emptied:
        fs.delete(_folder(spark, f"{path}/bucket={b}")[1], True)
    forget(rows, after)
    return changed + emptied


def united(old: DataFrame, new: DataFrame, keys: list[str], version: str, arrays: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """Of each key the row with the largest version (the smallest, if first), new before old among equals; its arrays hold the distinct values of all
    its rows, sorted."""
    columns = old.columns if old.columns else new.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    order = [F.col(version).asc_nulls_last(), F.asc("__new")] if first else [F.col(version).desc_nulls_last(), F.desc("__new")]
    best = both.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k", "__new", *arrays)
    for name in arrays:
        values = both.select(*keys, F.explode(name).alias("__value")).filter("__value IS NOT NULL").distinct()
        best = best.join(values.groupBy(*keys).agg(F.array_sort(F.collect_list("__value")).alias(name)), keys, "left")
        best = best.withColumn(name, F.coalesce(name, F.array().cast(dict(both.dtypes)[name])))
    return best.select(*columns)


def upsert(path: str, rows: DataFrame, keys: list[str], version: str, arrays: tuple[str, ...] = (), first: bool = False, buckets: int = BUCKETS) -> list[int]:
    """Inserts rows or replaces those with their keys (see united); the buckets that were written."""
    return merge(path, rows, keys, lambda old, new: united(old, new, keys, version, arrays, first), buckets)


def replace_documents(path: str, documents: DataFrame, blocks: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Puts the blocks (document_id, block_id, ...) of documents (document_id) in place of all that they had; the buckets that were written.

    A document without new blocks loses its old ones. Rows carry a snapshot, a hash of their document's blocks: documents whose
    snapshot is the one that is there are left alone.
    """
    names = [c for c in blocks.columns if c != "document_id"]
    row = F.sha2(F.to_json(F.struct(*names)), 256)
    snapshots = blocks.groupBy("document_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("snapshot"))
    new = documents.select("document_id").distinct().join(blocks.join(snapshots, "document_id"), "document_id", "left").select("document_id", *names, "snapshot")

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        there = old.select("document_id", F.col("snapshot").alias("__there")).distinct()
        same = new.select("document_id", "snapshot").distinct().join(there, "document_id").filter("snapshot = __there").select("document_id")
        fresh = new.join(same, "document_id", "left_anti")
        return old.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh.filter("snapshot IS NOT NULL"))

    return merge(path, new, ["document_id"], combine, buckets)
