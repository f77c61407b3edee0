"""Concepts and evidence: merging items, names and candidates, evidence bands, what keeps a page alive, purges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def united(column: str, order: str, most: int | None = None) -> Column:
    """The lists of a group one after another in order, each item once, the first few."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column])
    whole = F.array_distinct(F.flatten(lists))
    return whole if most is None else F.slice(whole, 1, most)


def merged_terms(items: DataFrame) -> DataFrame:
    """Items of one document and key as one: anchors united in order, the longest text (the first of equals)."""
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("position")))
    return items.groupBy("document_id", "key").agg(united("anchors", "position").alias("anchors"), longest.alias("text"), F.count("*").alias("n"))


def merged_concepts(concepts: DataFrame) -> DataFrame:
    """Concepts of one document and name key as one: the first one's slug, importance of the first plus half of the
    others', and a bonus of 10 less the first one's rank."""
    first = F.min_by(F.struct("slug", "importance", "rank"), "rank")
    sums = concepts.groupBy("document_id", "name_key").agg(first.alias("f"), F.sum("importance").alias("all"), united("aliases", "rank").alias("aliases"))
    bonus = F.greatest(F.lit(0), 10 - F.col("f.rank"))
    importance = F.col("f.importance") + 0.5 * (F.col("all") - F.col("f.importance")) + bonus
    return sums.select("document_id", "name_key", F.col("f.slug").alias("slug"), importance.alias("importance"), "aliases")


def attached_evidence(evidence: DataFrame, concepts: DataFrame) -> DataFrame:
    """Evidence (document_id, evidence_id, hint, confidence) with the one concept of its document whose name key is the
    hint, else the one whose slug is; unmatched hints keep a null slug."""
    by_key = concepts.groupBy("document_id", F.col("name_key").alias("hint")).agg(F.countDistinct("slug").alias("n"), F.min("slug").alias("by_key")).filter("n = 1").drop("n")
    by_slug = concepts.select("document_id", F.col("slug").alias("hint"), F.col("slug").alias("by_slug")).distinct()
    return evidence.join(by_key, ["document_id", "hint"], "left").join(by_slug, ["document_id", "hint"], "left").withColumn("slug", F.coalesce("by_key", "by_slug")).drop("by_key", "by_slug")


def evidence_importance(concepts: DataFrame, attached: DataFrame) -> DataFrame:
    """concepts with importance plus twice the confidence, between 0 and 1, of each evidence attached to them."""
    gain = attached.filter("slug IS NOT NULL").groupBy("document_id", "slug").agg(F.sum(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).alias("gain"))
    return concepts.join(gain, ["document_id", "slug"], "left").withColumn("importance", F.col("importance") + 2 * F.coalesce("gain", F.lit(0.0))).drop("gain")


def unmatched_hints(attached: DataFrame, most: int = 2) -> DataFrame:
    """Hints that named no concept: how often, the first claims by evidence id, and the largest confidence."""
    place = F.row_number().over(Window.partitionBy("document_id", "hint").orderBy("evidence_id"))
    placed = attached.filter("slug IS NULL").withColumn("k", place)
    samples = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "claim")))), lambda x: x["claim"])
    return placed.groupBy("document_id", "hint").agg(F.count("*").alias("n"), samples.alias("samples"), F.greatest(F.lit(0.0), F.max("confidence")).alias("max_confidence"))


def split_aliases(aliases: DataFrame, titles: DataFrame) -> DataFrame:
    """Aliases (slug, key) that are another concept's title, unless each is the other's: dropped, a link instead.

    Either side brings along the other names of its concept, so a pair is judged where it is made: pairs are not shuffled, however many
    concepts have one name. A concept's own aliases and titles are taken to be few.
    """
    names = lambda t: t.select("slug", "key").dropna().distinct()
    also = lambda t, name: names(t).groupBy("slug").agg(F.collect_list("key").alias(name))
    asked = names(aliases).join(also(titles, "titles"), "slug", "left")
    other = names(titles).join(also(aliases, "aliases"), "slug", "left").withColumnRenamed("slug", "link_to")
    each = F.coalesce(F.arrays_overlap("titles", "aliases"), F.lit(False))
    return asked.join(other, "key").filter((F.col("slug") != F.col("link_to")) & ~each).select("slug", "key", "link_to")


def evidence_band(scored: DataFrame, share: float = 0.85, most: int = 8) -> DataFrame:
    """Of each query the best evidence, at most so much, of what is within a share of its page's best score."""
    top = F.max("score").over(Window.partitionBy("query_id", "page_id"))
    band = scored.withColumn("top", top).filter(F.col("score") >= share * F.col("top")).drop("top")
    once = band.groupBy("query_id", "text").agg(F.max(F.struct("score", (-F.col("unit_id")).alias("u"))).alias("b")).select("query_id", (-F.col("b.u")).alias("unit_id"), F.col("b.score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id"))
    return once.withColumn("rank", place).filter(F.col("rank") <= most)


def selected_evidence(candidates: DataFrame, least: float = 0.0, share: float = 0.85, most: int = 8) -> DataFrame:
    """Rows (query_id, rank, page_id, place, score): the evidence to show for each query.

    candidates: query_id, page_id, page_rank, place, document_id, text, blocks, score; a query's pages are bounded by their ranking. Candidates with one
    text and one list of blocks of a document are one, the first by page and place. Of each page stay those within a share of its best score, and not
    below least. A single-block candidate of a page comes along if one of several blocks that stays names its block. The best of all
    are shown; of equal scores those that stayed come first, then by page and place.
    """
    by_place = [F.col("page_rank"), F.col("place")]
    copies = F.row_number().over(Window.partitionBy("query_id", "text", "document_id", "blocks").orderBy(*by_place))
    page = Window.partitionBy("query_id", "page_id")
    once = candidates.withColumn("k", copies).filter("k = 1").drop("k").withColumn("top", F.max("score").over(page))
    floor = F.when(F.col("top") > 0, F.greatest(F.lit(least), F.col("top") * share)).otherwise(F.lit(least))
    judged = once.withColumn("stays", F.col("score") >= floor)
    named = judged.filter("stays AND size(blocks) > 1").select("query_id", "page_id", F.explode("blocks").alias("block")).distinct().withColumn("named", F.lit(True))
    whole = judged.withColumn("block", F.when(F.size("blocks") == 1, F.col("blocks")[0])).join(named, ["query_id", "page_id", "block"], "left")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("stays"), *by_place))
    shown = whole.filter(F.col("stays") | F.coalesce("named", F.lit(False))).withColumn("rank", place).filter(F.col("rank") <= most)
    return shown.select("query_id", "rank", "page_id", "place", "score")


def page_view(pages: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Active pages with their source documents and the active pages their links go to, each list sorted."""
    active = pages.filter("status = 'active'").select("page_id")
    sources = relations.filter("relation_type = 'source_of'").groupBy("page_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    near = edges.join(active.select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_semi").groupBy(F.col("from_page_id").alias("page_id"))
    related = near.agg(F.array_sort(F.collect_set("to_page_id")).alias("related"))
    none = F.array().cast("array<bigint>")
    return active.join(sources, "page_id", "left").join(related, "page_id", "left").select("page_id", F.coalesce("documents", none).alias("documents"), F.coalesce("related", none).alias("related"))


def living_pages(records: DataFrame) -> DataFrame:
    """Whether each page has a manual record, an entry or a supporting record, and its documents from references."""
    supports = F.col("kind").isin("manual", "entry") | ((F.col("kind") == "evidence") & (F.size("refs") > 0))
    documents = F.array_distinct(F.flatten(F.collect_list(F.transform("refs", lambda r: F.substring_index(r, ":", 1)))))
    return records.groupBy("page_id").agg(F.bool_or(supports).alias("lives"), F.array_sort(documents).alias("documents"))


def dangling_references(references: DataFrame, entries: DataFrame, pages: DataFrame) -> DataFrame:
    """References to entries that are gone or whose home page is deleted."""
    home = entries.join(pages.filter("status <> 'deleted'"), "page_id", "left_semi").select("page_id", "entry_id")
    return references.join(home.withColumnRenamed("page_id", "home_page_id"), ["home_page_id", "entry_id"], "left_anti")


def ungrounded_numbers(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Items (document_id, item_id, numbers, refs) with numbers that none of their blocks (document_id, ref, numbers) has."""
    cited = items.select("document_id", "item_id", F.explode("refs").alias("ref")).join(blocks.withColumnRenamed("numbers", "given"), ["document_id", "ref"])
    given = cited.groupBy("document_id", "item_id").agg(F.array_distinct(F.flatten(F.collect_list("given"))).alias("given"))
    missing = F.array_except("numbers", F.coalesce("given", F.array().cast("array<string>")))
    return items.join(given, ["document_id", "item_id"], "left").select("document_id", "item_id", missing.alias("missing")).filter(F.size("missing") > 0)


def without_ungrounded(items: DataFrame, ungrounded: DataFrame, concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items without the ungrounded ones, and concepts (document_id, slug, evidence_ids) without what points to none that stays."""
    kept = items.join(ungrounded.select("document_id", "item_id").distinct(), ["document_id", "item_id"], "left_anti")
    links = concepts.select("document_id", "slug", F.posexplode("evidence_ids").alias("i", "item_id")).join(kept.select("document_id", "item_id").distinct(), ["document_id", "item_id"], "left_semi")
    left = F.transform(F.array_sort(F.collect_list(F.struct("i", "item_id"))), lambda x: x["item_id"])
    joined = concepts.join(links.groupBy("document_id", "slug").agg(left.alias("left")), ["document_id", "slug"], "left")
    return kept, joined.withColumn("evidence_ids", F.coalesce("left", F.slice("evidence_ids", 1, 0))).drop("left")


#: What stands for an absent summary, and signs that must be closed.
PLACEHOLDERS, PAIRED = ["-", "없음", "N/A"], ["()", "[]", "{}", "“”", '""', "''"]


def broken(text: Column) -> Column:
    """Whether a summary is a placeholder, ends in an opening sign or closes fewer than it opens; an empty or null one is not."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    found = bare.isin(PLACEHOLDERS)
    for opener, closer in PAIRED:
        found = found | F.endswith(bare, F.lit(opener)) | (count(opener) > count(closer))
    return found


def observation_findings(observations: DataFrame) -> DataFrame:
    """Rows (document_id, observation_id, finding) of observations (title, summary, claims, anchors): missing_ref without anchors; broken if the
    summary is broken, or neither summary nor claims say anything."""
    said = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    claimed = F.exists(F.coalesce("claims", F.array().cast("array<string>")), lambda c: F.trim(c) != "")
    no_anchor = F.coalesce(F.size("anchors"), F.lit(0)) < 1
    findings = F.array(F.when(no_anchor, "missing_ref"), F.when(broken(F.col("summary")) | (~said("summary") & ~claimed), "broken"))
    return observations.select("document_id", "observation_id", F.explode(F.array_compact(findings)).alias("finding"))


def observation_signature(query: Column, summary: Column, title: Column) -> Column:
    """By what observations are alike: the query, else 80 characters of the summary, else the title; null if all are empty."""
    compact = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " ")), "[^0-9a-z가-힣 ]+", "")
    named = lambda kind, c: F.when(c != "", F.concat(F.lit(kind), c))
    return F.coalesce(named("q:", compact(query)), named("s:", F.substring(compact(summary), 1, 80)), named("t:", compact(title)))


def kept_observations(observations: DataFrame) -> DataFrame:
    """One observation for each document and signature: most anchors, longest summary, most claims; anchors united."""
    rank = F.struct(F.size("anchors").alias("a"), F.length("summary").alias("b"), F.size("claims").alias("c"), (-F.col("position")).alias("d"))
    return observations.groupBy("document_id", "signature").agg(F.max_by("summary", rank).alias("summary"), united("anchors", "position").alias("anchors"), F.count("*").alias("n"))


def purge_counts(workspace: Column, **tables: DataFrame) -> DataFrame:
    """How many rows of each table a workspace's purge deletes: (table, workspace_id, n)."""
    parts = [df.groupBy("workspace_id").agg(F.count("*").alias("n")).filter(workspace).select(F.lit(name).alias("table"), "workspace_id", "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_document(clusters: DataFrame, document: Column) -> DataFrame:
    """Cluster claims without those that cite a document, references to it dropped; clusters left empty are gone."""
    left = F.filter("refs", lambda r: F.substring_index(r, ":", 1) != document)
    kept = clusters.withColumn("had", F.size("refs")).withColumn("refs", left).filter((F.size("refs") > 0) | (F.col("had") == 0))
    return kept.groupBy("workspace_id", "cluster_id").agg(F.count("*").alias("claims"), F.sum(F.size("refs")).alias("refs"))


def granularity(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages of each document and run, how many of them no link touches, and how many heads have several pages."""
    ends = links.select("run", F.col("source").alias("page_id")).union(links.select("run", "target")).distinct().withColumn("linked", F.lit(True))
    joined = pages.join(ends, ["run", "page_id"], "left")
    heads = pages.groupBy("run", "document_id", "head").agg(F.count("*").alias("k")).groupBy("run", "document_id").agg(F.count_if(F.col("k") > 1).alias("head_groups"))
    counts = joined.groupBy("run", "document_id").agg(F.count("*").alias("pages"), F.count_if(F.col("linked").isNull()).alias("unlinked"))
    return counts.join(heads, ["run", "document_id"])
