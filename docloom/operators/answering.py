"""From a question to pages and paths: candidate pages, section scores, scored walks. All built-in, for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import section
from docloom.operators.search import bm25, hybrid
from docloom.sources.store import written

#: Sections of source pages and what they add to a page's score.
SECTION_WEIGHTS = {"Categories": 0.10, "Core Concepts": 0.20, "Section Candidates": 0.25, "Mentions": 0.15}
#: The link between a source page and a concept.
NAMES_CONCEPT = "source_mentions_concept"


def _most(limits: Mapping[str, int]) -> Column:
    """The limit of a row's page type, 0 for types that are not listed."""
    pairs = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return F.coalesce(pairs[F.col("page_type")], F.lit(0))


def candidate_pages(queries: DataFrame, pages: DataFrame, units: DataFrame, limits: Mapping[str, int], rank: Callable = bm25) -> DataFrame:
    """Rows (query_id, page_type, page_id, exact, score, rank): the pages to read for each query (query_id, workspace_id, question).

    pages: workspace_id, page_id, page_type, title, slug, summary, updated_at; units: page_id, unit_id, text. Of each page type,
    the best by exact name, text rank of the names and recency are united with the best by their best unit's rank, and ranked anew over
    all their text. A page without a shared term can only get in by recency, so it competes only if it is among its type's newest. Nulls
    in texts count as empty; ties go to the smaller page_id.
    """
    most = _most(limits)
    kinds = pages.select("page_id", "page_type", "updated_at")
    label = F.concat_ws(" ", "title", "slug", "summary")

    named = rank(queries, pages.select("workspace_id", F.col("page_id").alias("doc_id"), label.alias("text"))).withColumnRenamed("doc_id", "page_id")
    names = pages.select("workspace_id", "page_id", F.explode(F.array_distinct(F.array(F.lower("title"), F.lower("slug")))).alias("name"))
    asked = queries.select("query_id", "workspace_id", F.lower("question").alias("name"))
    exact = asked.join(names, ["workspace_id", "name"]).select("query_id", "page_id").distinct().withColumn("exact", F.lit(1))
    by_age = Window.partitionBy("workspace_id", "page_type").orderBy(F.desc("updated_at"), "page_id")
    newest = pages.withColumn("k", F.row_number().over(by_age)).filter(F.col("k") <= most).select("workspace_id", "page_id")
    newest = newest.join(queries.select("query_id", "workspace_id"), "workspace_id").select("query_id", "page_id")
    entrants = named.select("query_id", "page_id").union(exact.select("query_id", "page_id")).union(newest).distinct()
    entrants = entrants.join(named, ["query_id", "page_id"], "left").join(exact, ["query_id", "page_id"], "left").join(kinds, "page_id").fillna(0, ["score", "exact"])
    by_name = Window.partitionBy("query_id", "page_type").orderBy(F.desc("exact"), F.desc(F.round("score", 6)), F.desc("updated_at"), "page_id")
    first = entrants.withColumn("k", F.row_number().over(by_name)).filter(F.col("k") <= most).select("query_id", "page_id", "exact")

    texts = units.join(pages.select("page_id", "workspace_id"), "page_id").select("workspace_id", F.col("unit_id").alias("doc_id"), "text")
    hits = rank(queries, texts).withColumnRenamed("doc_id", "unit_id").join(units.select("unit_id", "page_id"), "unit_id")
    hits = hits.groupBy("query_id", "page_id").agg(F.max(F.round("score", 6)).alias("best")).join(kinds, "page_id")
    by_unit = Window.partitionBy("query_id", "page_type").orderBy(F.desc("best"), "page_id")
    second = hits.withColumn("k", F.row_number().over(by_unit)).filter(F.col("k") <= most).select("query_id", "page_id", F.lit(0).alias("exact"))

    chosen = written(first.union(second).groupBy("query_id", "page_id").agg(F.max("exact").alias("exact")))
    inside = units.join(chosen.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id")
    whole = inside.agg(F.array_sort(F.collect_list(F.struct("unit_id", "text"))).alias("units"))
    parts = F.transform("units", lambda u: F.coalesce(u["text"], F.lit("")))
    text = F.concat_ws(" ", label, F.coalesce(F.array_join(parts, " "), F.lit("")))
    read = chosen.join(pages.drop("workspace_id"), "page_id").join(whole, "page_id", "left").select(F.col("query_id").alias("workspace_id"), F.col("page_id").alias("doc_id"), text.alias("text"))
    own = queries.select("query_id", F.col("query_id").alias("workspace_id"), "question")
    scores = rank(own, read).withColumnRenamed("doc_id", "page_id")
    last = chosen.join(scores, ["query_id", "page_id"], "left").join(kinds, "page_id").fillna(0, ["score"])
    return last.withColumn("rank", F.row_number().over(by_name)).filter(F.col("rank") <= most).select("query_id", "page_type", "page_id", "exact", "score", "rank")


def structure_scores(queries: DataFrame, pages: DataFrame, base: DataFrame, dense: DataFrame | None = None, weight: float = 0.8) -> DataFrame:
    """base (query_id, page_id, score) with what the best of a source page's named sections adds, 1 at most.

    pages: workspace_id, page_id, markdown; dense, if given: query_id, page_id, section, score; without it text alone counts. A section
    without a shared term and without a vector adds nothing, as does a page without sections.
    """
    kinds = F.array(*[F.struct(F.lit(name).alias("section"), section(F.col("markdown"), name).alias("body"), F.lit(w).alias("weight")) for name, w in SECTION_WEIGHTS.items()])
    found = pages.select("workspace_id", "page_id", F.explode(kinds).alias("s")).select("workspace_id", "page_id", "s.*").filter("body IS NOT NULL")
    key = F.struct("page_id", "section")
    text = bm25(queries, found.select("workspace_id", key.alias("doc_id"), F.concat_ws("\n", "section", "body").alias("text")))
    text = text.select("query_id", "doc_id.page_id", "doc_id.section", F.col("score").alias("text_score"))
    if dense is None:
        scored = text.withColumn("mixed", F.col("text_score"))
    else:
        both = text.join(dense.withColumnRenamed("score", "dense_score"), ["query_id", "page_id", "section"], "full")
        scored = both.withColumn("mixed", hybrid(F.col("dense_score"), F.col("text_score"), weight))
    weights = found.select("page_id", "section", "weight").distinct()
    added = scored.join(weights, ["page_id", "section"]).groupBy("query_id", "page_id").agg(F.max(F.col("mixed") * F.col("weight")).alias("added"))
    total = F.least(F.lit(1.0), F.col("score") + F.coalesce("added", F.lit(0.0)))
    return base.join(added, ["query_id", "page_id"], "left").withColumn("score", total).drop("added")


def scored(rows: DataFrame, scores: DataFrame | Column, pages: DataFrame | None = None) -> DataFrame:
    """rows (query_id, page_id, ...) that have a score, with it: from a table (query_id, page_id, score), or by a column of both ids for those of
    the pages (page_id), if these are given. A column is computed for the rows alone, where a table would hold all pairs."""
    if isinstance(scores, DataFrame):
        return rows.join(scores, ["query_id", "page_id"])
    return (rows if pages is None else rows.join(pages.select("page_id"), "page_id", "left_semi")).withColumn("score", scores)


def scored_walk(
    seeds: DataFrame, links: DataFrame, scores: DataFrame | Column, depth: int = 3, floor: float = 0.95, fan: int = 8, pages: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Walks from each query's seeds along links to pages that score at least floor of its best seed.

    seeds: query_id, page_id, place (0, 1, ... in a query); links: from_page_id, to_page_id, link_type, of traversable types only;
    scores, pages: as in scored; a column scores the pages that a walk meets and no others. A page is expanded where it is met first, in
    breadth-first order, to its fan best neighbours off its own path. Because of that a level is one join and one rank by page, and a page's
    place in the order is its parent's place times fan plus its own. Returns paths (query_id, nodes, link_types, score, depth, place), nodes
    (query_id, page_id, score, depth) and stops (query_id, stop_reason). Seeds without a score have 0; repeated links are one.
    """
    ends = links.select("from_page_id", "to_page_id", "link_type").distinct()
    ways = ends.select(F.col("from_page_id").alias("at"), F.col("to_page_id").alias("page_id"), "link_type")
    ways = ways.union(ends.select(F.col("to_page_id"), F.col("from_page_id"), "link_type"))
    ways = written(ways if pages is None else ways.join(pages.select("page_id"), "page_id", "left_semi").select("at", "page_id", "link_type"))
    known = scored(seeds.select("query_id", "page_id").distinct(), scores, pages).select("query_id", "page_id", "score")
    start = written(seeds.join(known, ["query_id", "page_id"], "left").fillna(0.0, ["score"]))
    best = start.groupBy("query_id").agg(F.max("score").alias("top"))
    kind = seeds.schema["page_id"].dataType.simpleString()
    frontier = written(
        start.join(best.filter("top > 0"), "query_id").select("query_id", F.col("page_id").alias("at"), F.col("place").cast("long").alias("place"), F.array("page_id").alias("nodes"), F.array().cast("array<string>").alias("link_types"), "top")
    )
    nodes = start.select("query_id", "page_id", "score", F.lit(0).alias("depth"))

    def steps(front: DataFrame) -> DataFrame:
        met = front.join(ways, "at").filter(~F.array_contains("nodes", F.col("page_id")))
        return scored(met, scores).filter(F.col("score") >= F.col("top") * floor)

    paths, turns = [], []
    for level in range(depth):
        by = Window.partitionBy("query_id", "at", "place").orderBy(F.desc("score"), "page_id", "link_type")
        taken = steps(frontier).withColumn("k", F.row_number().over(by) - 1).filter(F.col("k") < fan)
        taken = taken.select("query_id", F.col("page_id").cast(kind).alias("page_id"), "score", (F.col("place") * fan + F.col("k")).alias("place"), F.col("place").alias("parent"),
                             F.array_append("nodes", F.col("page_id")).alias("nodes"), F.array_append("link_types", F.col("link_type")).alias("link_types"), "top")
        taken = written(taken)
        paths.append(taken.select("query_id", "nodes", "link_types", "score", F.lit(level + 1).alias("depth"), "place"))
        first = F.row_number().over(Window.partitionBy("query_id", "page_id").orderBy("place"))
        fresh = written(taken.join(nodes, ["query_id", "page_id"], "left_anti").withColumn("k", first).filter("k = 1").drop("k"))
        # A query's last page of a level that led anywhere; of the seeds the last one.
        tried = taken.groupBy("query_id").agg(F.max("parent").alias("tried"))
        grown = fresh.groupBy("query_id").agg(F.max("parent").alias("grew"))
        turn = tried.withColumn("last", F.col("tried")) if level else frontier.groupBy("query_id").agg(F.max("place").alias("last")).join(tried, "query_id", "left")
        closed = F.coalesce(F.col("tried") == F.col("last"), F.lit(False)) & (F.coalesce("grew", F.lit(-1)) < F.col("last"))
        turns.append(turn.join(grown, "query_id", "left").select("query_id", F.lit(level).alias("level"), closed.alias("closed")))
        nodes = nodes.union(fresh.select("query_id", "page_id", "score", F.lit(level + 1)))
        frontier = fresh.select("query_id", F.col("page_id").alias("at"), "place", "nodes", "link_types", "top")
    # One step more is enough to know, and most queries have one from any few of their last pages.
    few = written(steps(frontier.filter(F.pmod(F.xxhash64("place"), F.lit(16)) == 0)).select("query_id").distinct())
    more = steps(frontier.join(few, "query_id", "left_anti")).select("query_id").distinct()
    deeper = few.union(more).withColumn("deeper", F.lit(True))
    every, last = paths[0], turns[0]
    for path, turn in zip(paths[1:], turns[1:], strict=True):
        every, last = every.union(path), last.union(turn)
    closed = last.groupBy("query_id").agg(F.max_by("closed", "level").alias("closed"))
    stops = best.join(closed, "query_id", "left").join(deeper, "query_id", "left")
    reason = F.when(F.col("top") <= 0, "no_relevant_seed").when(F.col("deeper"), "max_depth").when(F.col("closed"), "relative_score_floor").otherwise("no_frontier")
    return every, nodes, stops.select("query_id", reason.alias("stop_reason"))


def with_focus_sources(seeds: DataFrame, focus: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (query_id, page_id): a query's seeds and the pages linked, either way, with one of its focus concepts (query_id, page_id)."""
    naming = links.filter(F.col("link_type") == NAMES_CONCEPT)
    ways = naming.select(F.col("to_page_id").alias("page_id"), F.col("from_page_id").alias("other"))
    ways = ways.union(naming.select("from_page_id", "to_page_id"))
    found = focus.select("query_id", "page_id").join(ways, "page_id").select("query_id", F.col("other").alias("page_id"))
    return seeds.select("query_id", "page_id").union(found).distinct()


def direct_paths(paths: DataFrame, nodes: DataFrame, links: DataFrame, direct: DataFrame) -> DataFrame:
    """Paths (query_id, first, last, score, direct) with one more for every link that names a directly matched concept (query_id, page_id), if
    both its ends are among the query's nodes (query_id, page_id, score) and no path joins them yet; it scores the better end."""
    naming = links.filter(F.col("link_type") == NAMES_CONCEPT).select(F.col("from_page_id").alias("first"), F.col("to_page_id").alias("last")).distinct()
    scored = nodes.select("query_id", "page_id", "score")
    hit = direct.select("query_id", F.col("page_id").alias("last")).distinct().join(naming, "last")
    hit = hit.join(scored.toDF("query_id", "last", "to_score"), ["query_id", "last"]).join(scored.toDF("query_id", "first", "from_score"), ["query_id", "first"])
    new = hit.join(paths, ["query_id", "first", "last"], "left_anti")
    new = new.select("query_id", "first", "last", F.greatest("to_score", "from_score").alias("score"), F.lit(True).alias("direct"))
    return paths.select("query_id", "first", "last", "score", F.lit(False).alias("direct")).union(new)
