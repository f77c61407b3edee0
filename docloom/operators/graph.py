"""The page graph: active view, neighbourhoods, derived links, pairs and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import written


def active_nodes(pages: DataFrame, relations: DataFrame) -> DataFrame:
    """Active pages with the document of their oldest source_of relation."""
    oldest = relations.filter("relation_type = 'source_of'").groupBy("page_id").agg(F.min_by("document_id", F.struct("created_at", "document_id")).alias("document_id"))
    return pages.filter("status = 'active'").join(oldest, "page_id", "left")


def active_edges(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges of which both ends are active pages."""
    active = pages.filter("status = 'active'").select("page_id")
    for end in ("from_page_id", "to_page_id"):
        edges = edges.join(active.withColumnRenamed("page_id", end), end, "left_semi")
    return edges


def neighbourhood(seeds: DataFrame, edges: DataFrame, rounds: int = 3, most: int = 200) -> DataFrame:
    """Rows (query_id, page_id, depth): pages within so many steps of a query's seeds, either way along edges. All
    rounds together follow at most so many edges a query, in each round the most confident first; edges back to pages
    seen before the frontier take no place, and an edge inside the frontier takes one."""
    edges = edges.distinct()
    rest = [c for c in edges.columns if c not in ("from_page_id", "to_page_id", "confidence")]
    ways = edges.withColumns({"page_id": F.col("from_page_id"), "next": F.col("to_page_id")})
    ways = ways.union(edges.withColumns({"page_id": F.col("to_page_id"), "next": F.col("from_page_id")}))
    seen = seeds.select("query_id", "page_id").distinct().withColumn("depth", F.lit(0))
    used = seen.select("query_id").distinct().withColumn("used", F.lit(0))
    frontier = seen
    for depth in range(1, rounds + 1):
        before = seen.filter(F.col("depth") < depth - 1).select("query_id", F.col("page_id").alias("next"))
        steps = frontier.select("query_id", "page_id").join(ways, "page_id").join(before, ["query_id", "next"], "left_anti")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "from_page_id", "to_page_id", *rest))
        ranked = steps.select("query_id", *edges.columns).distinct().withColumn("k", place).filter(F.col("k") <= most)
        taken = written(ranked.join(used, "query_id").filter(F.col("used") + F.col("k") <= most).select("query_id", "from_page_id", "to_page_id"))
        used = used.union(taken.select("query_id", F.lit(1))).groupBy("query_id").agg(F.sum("used").alias("used"))
        ends = taken.select("query_id", F.explode(F.array("from_page_id", "to_page_id")).alias("page_id")).distinct()
        frontier = written(ends.join(seen, ["query_id", "page_id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(frontier)
    return seen


def source_concept_links(bridge: DataFrame, tombstones: DataFrame, manual: DataFrame) -> DataFrame:
    """Links from source pages to the concepts their document named, without trashed documents; a manual link that is
    present is added, one that is absent removes."""
    live = bridge.join(tombstones.select("document_id").distinct(), "document_id", "left_anti")
    derived = live.select(F.col("source_page_id").alias("from_page_id"), F.col("concept_page_id").alias("to_page_id")).distinct()
    both = derived.withColumn("derived", F.lit(True)).join(manual, ["from_page_id", "to_page_id"], "full")
    return both.filter(F.coalesce(F.col("present"), F.col("derived"))).select("from_page_id", "to_page_id", F.col("present").isNotNull().alias("by_hand"))


def unordered_links(links: DataFrame, slug_map: DataFrame) -> DataFrame:
    """One link for each unordered pair after merged slugs are followed; the first in order wins, none to itself."""
    to = slug_map.select(F.col("slug").alias("s"), F.col("canonical"))
    for end in ("source", "target"):
        links = links.join(to, F.col(end) == F.col("s"), "left").withColumn(end, F.coalesce("canonical", end)).drop("s", "canonical")
    pair = [F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    return links.filter("source <> target").groupBy(*pair).agg(F.min_by(F.struct("source", "target", "relation"), "position").alias("l")).select("l.*")


def descendants(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, node, depth) of all nodes below each root, the root included; cycles end where they meet themselves."""
    found = roots.select(F.col("node").alias("root"), "node").withColumn("depth", F.lit(0))
    edge = tree.filter("parent IS NOT NULL").select(F.col("parent"), F.col("node").alias("child"))
    level, depth = found, 0
    while True:
        depth += 1
        below = level.join(edge, level["node"] == edge["parent"]).select("root", F.col("child").alias("node")).distinct()
        level = written(below.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not level.take(1):
            return found
        found = found.union(level)


def related_pairs(claims: DataFrame) -> DataFrame:
    """Rows (document_id, a, b): concepts of a document that share a reference, a before b."""
    shared = claims.select("document_id", "ref", "slug").distinct()
    other = shared.select("document_id", "ref", F.col("slug").alias("b"))
    return shared.withColumnRenamed("slug", "a").join(other, ["document_id", "ref"]).filter("a < b").select("document_id", "a", "b").distinct()


def overlap_ratio(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """The common area of two boxes (x0, y0, x1, y1) by the smaller one's area."""
    ax0, ay0, ax1, ay1 = map(F.col, a)
    bx0, by0, bx1, by1 = map(F.col, b)
    width = F.greatest(F.least(ax1, bx1) - F.greatest(ax0, bx0), F.lit(0.0))
    height = F.greatest(F.least(ay1, by1) - F.greatest(ay0, by0), F.lit(0.0))
    smaller = F.least((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0))
    return F.when(smaller > 0, width * height / smaller).otherwise(0.0)
