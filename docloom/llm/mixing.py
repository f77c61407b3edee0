"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions alone.

Every document of a source gets the same fractional number of copies, target / source size. The whole part is
taken at once; the fraction, as a mass of fraction * size words, is rounded pairwise: of two documents, one gives
mass to the other, in a direction drawn so that each keeps its expectation, until one of them holds nothing or
its full size. The sum of masses never changes. Pairing runs in groups of bounded expected size among documents
of like size (tiers of powers of two); each group leaves at most one unfinished document, and those meet again,
group by group, in a reduction tree until one is left for each source and tier. These few, from the largest to
the smallest, round the mass that is left, so a source misses its target by about one of its smallest documents.

Nulls: a null text has size 0; the null source is a source of its own, the last one. Documents of size 0 take 0.
Repeated rows are documents of their own, in the same group. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import written

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Rows (source, source_size, n_docs, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn. A source's target is the smaller of cap times its
    size and level times its weight, with the level at which the targets add up to share of all sizes: the fixed
    point of sharing by weight, stopping full sources and sharing their excess again.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((ranked - 1) % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    full_before = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("share_of_all") - full_before) / open_weight
    return (
        sources.withColumn("weight", turn)
        .withColumn("most", cap * F.col("source_size"))
        .withColumn("fills_at", F.col("most") / F.col("weight"))
        .withColumn("share_of_all", share * F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(everything))
        .withColumn("target", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))))
        .select("source", "source_size", "n_docs", "target")
    )


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)


def _pair(state: Column, item: Column, seed: int) -> Column:
    """One pivotal step: the unfinished document of the state meets the next one."""
    left = state["rest"]
    to_left = F.least(left["size"] - left["mass"], item["mass"])
    to_item = F.least(left["mass"], item["size"] - item["mass"])
    # A step to the left of size a is drawn with probability b / (a + b): nobody's expectation changes.
    goes_left = _uniform(F.lit(seed), left["h"], item["h"]) * (to_left + to_item) < to_item
    drawn = F.array(F.struct(goes_left.alias("left"), to_left.alias("a"), to_item.alias("b")))

    def settle(move: Column) -> Column:
        moved = F.when(move["left"], move["a"]).otherwise(-move["b"])
        left_done = F.when(move["left"], move["a"] >= left["size"] - left["mass"]).otherwise(move["b"] >= left["mass"])
        item_done = F.when(move["left"], move["a"] >= item["mass"]).otherwise(move["b"] >= item["size"] - item["mass"])
        now = lambda x, mass: F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h"), x["size"].alias("size"), mass.alias("mass"))
        left_now = now(left, left["mass"] + moved)
        item_now = now(item, item["mass"] - moved)
        ended = lambda x, up: F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h"), x["size"].alias("size"), up.alias("up"))
        left_end, item_end = ended(left, move["left"]), ended(item, ~move["left"])
        done = F.when(left_done & item_done, F.array(left_end, item_end)).when(left_done, F.array(left_end)).otherwise(F.array(item_end))
        rest = F.when(left_done & item_done, F.lit(None)).when(left_done, item_now).otherwise(left_now)
        return F.struct(F.concat(state["done"], done).alias("done"), rest.alias("rest"))

    return F.when(left.isNull(), F.struct(state["done"].alias("done"), item.alias("rest"))).otherwise(F.transform(drawn, settle)[0])


def _round(items: DataFrame, seed: int, id_type: str) -> DataFrame:
    """Rows (source, tier, node, done, rest) from rows (source, tier, node, item): a node's documents, paired in turn."""
    item = f"struct<doc_id:{id_type},h:bigint,size:double,mass:double>"
    empty = F.struct(
        F.array().cast(f"array<struct<doc_id:{id_type},h:bigint,size:double,up:boolean>>").alias("done"),
        F.lit(None).cast(item).alias("rest"),
    )
    queue = F.array_sort(F.collect_list("item"), lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    grouped = items.groupBy("source", "tier", "node").agg(queue.alias("queue"))
    return grouped.select("source", "tier", "node", F.aggregate("queue", empty, lambda s, x: _pair(s, x, seed)).alias("out")).select("source", "tier", "node", "out.*")


def _settle(last: DataFrame, seed: int) -> DataFrame:
    """Rounds the last document of each tier, the largest first, by what is left of their masses' sum."""
    order = lambda a, b: F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1).when(a["h"] < b["h"], -1).otherwise(1)
    queue = F.array_sort(F.collect_list(F.struct("doc_id", "h", "size")), order).alias("queue")
    queues = last.groupBy("source").agg(queue, F.sum("mass").alias("mass"), F.sum("size").alias("sizes"))
    done = f"array<{last.select(F.struct('doc_id', 'h', 'size', F.lit(True).alias('up')).alias('x')).schema['x'].dataType.simpleString()}>"
    start = F.struct(F.array().cast(done).alias("done"), F.col("mass").alias("left"), F.col("sizes").alias("smaller"))

    def step(state: Column, x: Column) -> Column:
        left, size, smaller = state["left"], x["size"], state["smaller"] - x["size"]
        # Both ways are open while the smaller documents can still make up the rest exactly.
        can_take, can_leave = (left >= size) & (left - size <= smaller), left <= smaller
        drawn = _uniform(F.lit(seed), x["h"]) * size < left
        up = F.when(can_take & can_leave, drawn).when(can_take | can_leave, can_take).otherwise(left > size / 2)
        ended = F.struct(x["doc_id"].alias("doc_id"), x["h"].alias("h"), size.alias("size"), up.alias("up"))
        rest = left - F.when(up, size).otherwise(0.0)
        return F.struct(F.concat(state["done"], F.array(ended)).alias("done"), rest.alias("left"), smaller.alias("smaller"))

    return queues.select("source", F.explode(F.aggregate("queue", start, step)["done"]).alias("d")).select("source", "d.*")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
    group: int = 64,
) -> DataFrame:
    """The plan of the mix, a row for each document: doc_id, row_hash, size, source_size, target, copies, taken.

    row_hash tells rows that share a doc_id apart. Other columns of docs are ignored, whatever their names.
    """
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("row_hash"),
        )
    )
    targets = written(source_targets(sized, weights, share, cap)).withColumnRenamed("source", "of")
    largest, rows = targets.agg(F.max("n_docs"), F.sum("n_docs")).first()
    largest, rows = largest or 0, rows or 0
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("whole", F.floor(copies))
        .withColumn("mass", (copies - F.floor(copies)) * F.col("size"))
    )
    fractional = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    id_type = sized.schema["doc_id"].dataType.simpleString()
    item = F.struct("doc_id", F.col("row_hash").alias("h"), F.col("size").cast("double").alias("size"), "mass")
    tier = F.floor(F.log2("size")).alias("tier")
    nodes = F.greatest(F.ceil(F.col("n_docs") / group), F.lit(1))
    level = _round(planned.filter(fractional).select("source", tier, F.pmod("row_hash", nodes).alias("node"), item.alias("item")), seed, id_type)
    left = math.ceil(largest / group)
    rounded = []
    while True:
        level = written(level, rows)
        rounded.append(level.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        if left <= 1:
            break
        rest = level.filter("rest IS NOT NULL").select("source", "tier", F.floor(F.col("node") / group).alias("node"), F.col("rest").alias("item"))
        level, left = _round(rest, seed, id_type), math.ceil(left / group)
    rounded.append(_settle(level.filter("rest IS NOT NULL").select("source", "rest.*"), seed))
    drawn = rounded[0]
    for more in rounded[1:]:
        drawn = drawn.union(more)
    drawn = drawn.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", F.col("h").alias("row_hash"), F.col("size").cast("long").alias("size"), "source_size", "target",
        (F.floor(copies) + F.col("up").cast("long")).alias("copies"),
    )
    settled = planned.filter(~fractional).select("doc_id", "row_hash", "size", "source_size", "target", "whole").withColumnRenamed("whole", "copies")
    return settled.union(drawn).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs as often as mix_sources takes them, with the columns of docs.

    Rows that are equal in id, source and text share their copies, those that are equal in all columns as one row; others in equal parts.
    """
    seed = options.get("seed", 7)
    key = F.xxhash64(F.lit(seed), *[F.col(options.get(f"{c}_col", d)) for c, d in (("id", "doc_id"), ("source", "source"), ("text", "text"))])
    rows = docs.withColumn("__row", key).withColumn("__whole", F.xxhash64(F.lit(seed + 1), *docs.columns))
    plan = mix_sources(docs, **options).groupBy(F.col("row_hash").alias("__row")).agg(F.sum("copies").alias("c"), F.count("*").alias("n")).filter("c > 0")
    # Of a hash's n rows those numbered from upto - k to upto - 1 are equal in all columns.
    kinds = rows.groupBy("__row", "__whole").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(Window.partitionBy("__row").orderBy("__whole")))
    shares = kinds.join(plan, "__row").select("__row", "__whole", F.expr("int(c * upto div n - c * (upto - k) div n)").alias("__copies")).filter("__copies > 0")
    once = rows.dropDuplicates(["__row", "__whole"])
    return once.join(shares, ["__row", "__whole"]).withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[once[c] for c in docs.columns])
