"""Resolving concepts: mentions, judged decisions, merged ledgers, claims of clusters, guards and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(lists: str, *order: str) -> F.Column:
    """Arrays of a group's rows in order as one, the first of equal items kept."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(lists).alias("own")))), lambda r: r["own"])))


def valid_decisions(decisions: DataFrame, known: DataFrame) -> DataFrame:
    """decisions (slug, action, target, links) against known slugs: a merge into an unknown target creates, with a warning; links to the
    concept itself, or to unknown ones, go."""
    exists = known.select(F.col("slug").alias("target")).distinct().withColumn("exists", F.lit(True))
    joined = decisions.join(exists, "target", "left")
    bad = (F.col("action") == "merge") & (F.col("exists").isNull() | (F.col("target") == F.col("slug")))
    links = decisions.select("slug", F.posexplode("links").alias("i", "link")).filter("link <> slug").join(known.select(F.col("slug").alias("link")).distinct(), "link", "left_semi")
    kept = links.groupBy("slug").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "link"))), lambda x: x["link"])).alias("kept"))
    return joined.join(kept, "slug", "left").select(
        "slug", F.when(bad, "create").otherwise(F.col("action")).alias("action"), F.when((F.col("action") == "merge") & ~bad, F.col("target")).alias("target"),
        F.coalesce("kept", F.array().cast("array<string>")).alias("links"), bad.alias("warned"),
    )


def merged_ledger(concepts: DataFrame, slug_map: DataFrame) -> DataFrame:
    """Concepts (slug, position, existing, title, definition, aliases, importance) by canonical slug (slug, canonical): lists united in
    order, importance summed, the longest definition, the title of an existing concept before others."""
    joined = concepts.join(slug_map, "slug", "left").withColumn("canonical", F.coalesce("canonical", "slug"))
    rank = F.struct((~F.col("existing")).alias("new"), "position")
    longest = F.struct(F.length("definition"), -F.col("position"))
    return joined.groupBy("canonical").agg(
        F.min_by("title", rank).alias("title"), F.max_by("definition", longest).alias("definition"), ordered_union("aliases", "position").alias("aliases"),
        F.sum("importance").alias("importance"), F.count("*").alias("members"),
    )


def merged_items(items: DataFrame, *keys: str) -> DataFrame:
    """Items (keys, position, text, refs) of one key as one: the first text, references united in order."""
    return items.groupBy(*keys).agg(F.min_by("text", "position").alias("text"), ordered_union("refs", "position").alias("refs"))


def concept_index(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Active concept pages (workspace_id, page_id, slug, title, page_type, status) with their entries (page_id, entry_id, name), sorted."""
    own = entries.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "name"))).alias("entries"))
    active = pages.filter("page_type = 'concept' AND status = 'active'").drop("page_type", "status")
    return active.join(own, "page_id", "left")


def judged_updates(updates: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Claims by the concept they update: of updates (candidate_id, relation, concept) those of known candidates (candidate_id, claim) that are
    the same as a known concept, each once."""
    same = updates.filter("relation = 'same_concept'").join(known.select(F.col("slug").alias("concept")).distinct(), "concept", "left_semi")
    return same.select("candidate_id", "concept").distinct().join(candidates, "candidate_id").groupBy("concept").agg(F.array_sort(F.collect_set("claim")).alias("claims"))


def cluster_claims(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (workspace_id, cluster, claims, sources): candidates with references (workspace_id, slug, position, claim, refs) by decided cluster
    (workspace_id, slug, cluster); one whose cluster is none of the workspace's slugs is its own."""
    cited = candidates.filter("size(refs) > 0")
    valid = candidates.select("workspace_id", F.col("slug").alias("cluster")).distinct()
    decided = decisions.join(valid, ["workspace_id", "cluster"], "left_semi")
    placed = cited.join(decided, ["workspace_id", "slug"], "left").withColumn("cluster", F.coalesce("cluster", "slug"))
    claims = F.transform(F.array_sort(F.collect_list(F.struct("position", "claim"))), lambda x: x["claim"])
    sources = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("refs", lambda r: F.split_part(r, F.lit(":"), F.lit(1)))))))
    return placed.groupBy("workspace_id", "cluster").agg(F.array_distinct(claims).alias("claims"), sources.alias("sources"))


def merged_clusters(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Clusters (cluster, position, claim, promotion): new claims after the stored ones, none twice; a stored promotion stays."""
    both = stored.withColumn("late", F.lit(0)).unionByName(new.withColumn("late", F.lit(1)))
    first = both.groupBy("cluster", "claim").agg(F.min(F.struct("late", "position")).alias("place"))
    promotion = both.filter("promotion IS NOT NULL").groupBy("cluster").agg(F.min_by("promotion", F.struct("late", "position")).alias("promotion"))
    listed = first.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "claim"))), lambda x: x["claim"]).alias("claims"))
    return listed.join(promotion, "cluster", "left")


def concept_sources(concepts: DataFrame, cited: DataFrame, live: DataFrame, links: DataFrame) -> DataFrame:
    """Concept pages that need work: unsourced, if no document they cite (page_id, document_id) is live, or relink, if a live one is not linked
    (page_id, document_id)."""
    alive = cited.join(live.select("document_id").distinct(), "document_id", "left_semi").select("page_id", "document_id").distinct()
    missing = alive.join(links, ["page_id", "document_id"], "left_anti").groupBy("page_id").agg(F.count("*").alias("missing"))
    state = concepts.select("page_id").join(alive.groupBy("page_id").agg(F.count("*").alias("live")), "page_id", "left").join(missing, "page_id", "left")
    named = state.withColumn("state", F.when(F.col("live").isNull(), "unsourced").when(F.col("missing") > 0, "relink"))
    return named.filter("state IS NOT NULL").select("page_id", "state", F.coalesce("missing", F.lit(0)).alias("missing"))


def reference_guards(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """items (document_id, item_id, refs) that cite nothing, or blocks their document does not have, with those blocks."""
    cited = items.select("document_id", "item_id", F.explode("refs").alias("block_id")).distinct()
    unknown = cited.join(blocks.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")
    found = unknown.groupBy("document_id", "item_id").agg(F.array_sort(F.collect_set("block_id")).alias("unknown"))
    joined = items.join(found, ["document_id", "item_id"], "left")
    reason = F.when(F.size(F.coalesce("refs", F.array().cast("array<string>"))) == 0, "no_refs").when(F.col("unknown").isNotNull(), "unknown_refs")
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("document_id", "item_id", "reason", "unknown")


#: The form of an entry of a reference list, and how many make a block one.
REFERENCE_ENTRY, LEAST_ENTRIES, ENTRIES_PER_THOUSAND = r"\[[0-9]+\]|\([12][0-9]{3}\)", 2, 1.5


def reference_lists(blocks: DataFrame) -> DataFrame:
    """Blocks (document_id, block_id, text) that are lists of references: at least two entries, and 1.5 for every thousand characters."""
    n = F.regexp_count("text", F.lit(REFERENCE_ENTRY))
    listed = blocks.withColumn("n_entries", n).filter((F.col("n_entries") >= LEAST_ENTRIES) & (F.col("n_entries") * 1000 >= ENTRIES_PER_THOUSAND * F.length("text")))
    return listed.select("document_id", "block_id", "n_entries")


def demoted(concepts: DataFrame, lists: DataFrame) -> DataFrame:
    """Core concepts (document_id, slug, refs) all of whose blocks are lists of references."""
    cited = concepts.select("document_id", "slug", F.explode("refs").alias("block_id")).distinct()
    marked = cited.join(lists.select("document_id", "block_id", F.lit(1).alias("listed")), ["document_id", "block_id"], "left")
    return marked.groupBy("document_id", "slug").agg(F.count("*").alias("n"), F.count("listed").alias("listed")).filter("n = listed").select("document_id", "slug")


def decision_scores(cases: DataFrame) -> DataFrame:
    """cases (case_id, options, chosen, links) against the best of their acceptable options (action and links): whether one is met, and how
    many links are in none but too many for the best one."""
    tried = cases.select("case_id", "chosen", "links", F.posexplode("options").alias("i", "o"))
    hit = F.col("o.action") == F.col("chosen")
    extra = F.size(F.array_except("links", "o.links"))
    missing = F.size(F.array_except("o.links", "links"))
    tried = tried.select("case_id", "i", hit.alias("hit"), extra.alias("extra"), missing.alias("missing"))
    best = F.struct(~F.col("hit"), F.col("missing") + F.col("extra"), "i")
    return tried.groupBy("case_id").agg(F.min_by(F.struct("hit", "extra", "missing"), best).alias("b")).select("case_id", "b.*")
