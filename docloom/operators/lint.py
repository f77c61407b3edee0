"""Keeping the wiki clean: references and links without ends, reconciliation, promotion and quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.helpers import folded
from docloom.sources.store import written


def orphan_refs(cited: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, block_id, ...) of cited that name no block."""
    return cited.join(blocks.select("document_id", "block_id").distinct(), ["document_id", "block_id"], "left_anti")


def orphan_links(links: DataFrame, pages: DataFrame, managed: DataFrame, supported: DataFrame) -> DataFrame:
    """Links to report and why: an end is deleted, or the log once managed the link and no longer supports it."""
    link = ["from_page_id", "to_page_id", "relation"]
    gone = pages.filter("status = 'deleted'").select("page_id")
    ends = links.join(gone.select(F.col("page_id").alias("from_page_id"), F.lit(True).alias("from_gone")), "from_page_id", "left")
    ends = ends.join(gone.select(F.col("page_id").alias("to_page_id"), F.lit(True).alias("to_gone")), "to_page_id", "left")
    known = ends.join(managed.select(*link).distinct().withColumn("managed", F.lit(True)), link, "left")
    known = known.join(supported.select(*link).distinct().withColumn("supported", F.lit(True)), link, "left")
    reason = F.when(F.coalesce("from_gone", "to_gone").isNotNull(), "endpoint_deleted").when(F.col("managed") & F.col("supported").isNull(), "unsupported")
    return known.withColumn("reason", reason).filter("reason IS NOT NULL").select(*link, "reason")


def latest_runs(runs: DataFrame) -> DataFrame:
    """Each document's latest succeeded run: by end (unknown ends last), then by start, then by id."""
    order = [F.col("finished_at").desc_nulls_last(), F.desc("created_at"), F.desc("id")]
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return runs.filter("status = 'succeeded'").withColumn("k", place).filter("k = 1").drop("k")


def invalidated_refs(runs: DataFrame) -> DataFrame:
    """Rows (document_id, ref): references of earlier succeeded runs that the latest one no longer has."""
    ok = runs.filter("status = 'succeeded'").select("document_id", "id", F.explode("refs").alias("ref"))
    last = latest_runs(runs).select("document_id", F.col("id").alias("latest"))
    marked = ok.join(last, "document_id")
    now = marked.filter("id = latest").select("document_id", "ref")
    return marked.filter("id <> latest").select("document_id", "ref").distinct().join(now, ["document_id", "ref"], "left_anti")


def reconciled(runs: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (document_id, kind, key, removable): what the latest succeeded run of each document takes back, unless that run is reconciled already.

    runs: document_id, workspace_id, id, status, finished_at, created_at, reconciled, invalidated (block ids), concepts (slugs) and relations (source, target,
    relation); linked: document_id, slug of the pages that a document supports now. Invalidated blocks are named under their
    document; a linked concept that the latest run has not is stale, as is a relation of an earlier run that it has not, which
    can only be removed if no other document's latest run of the workspace has it. All kinds are items of one exploded list.
    """
    text = lambda *parts: F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), "\x1f")
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    lists = [
        F.transform("invalidated", lambda b: item("ref", F.concat(F.col("document_id").cast("string"), F.lit(":"), b.cast("string")))),
        F.transform("concepts", lambda c: item("concept", c.cast("string"))),
        F.transform("relations", lambda r: item("relation", text(r["source"].cast("string"), r["target"].cast("string"), r["relation"].cast("string")))),
    ]
    none = F.array().cast("array<struct<kind:string,key:string>>")
    last = latest_runs(runs).select("document_id", F.col("id").alias("latest"), F.coalesce("reconciled", F.lit(False)).alias("done"))
    items = runs.filter("status = 'succeeded'").join(last, "document_id").select("document_id", "workspace_id", "done", (F.col("id") == F.col("latest")).alias("now"), F.explode(F.concat(*[F.coalesce(x, none) for x in lists])).alias("x"))
    items = items.select("document_id", "workspace_id", "done", "now", "x.*").distinct()
    now = items.filter("now").select("document_id", "workspace_id", "kind", "key")
    before = items.filter("NOT now AND NOT done AND kind = 'relation'").select("document_id", "workspace_id", "kind", "key")
    open_docs = last.filter("NOT done").join(runs.select("document_id", "workspace_id").distinct(), "document_id").select("document_id", "workspace_id")
    concepts = linked.join(open_docs, "document_id").select("document_id", "workspace_id", F.lit("concept").alias("kind"), F.col("slug").cast("string").alias("key")).distinct()
    stale = before.union(concepts).join(now.drop("workspace_id"), ["document_id", "kind", "key"], "left_anti")
    held = now.filter("kind = 'relation'").select("workspace_id", "kind", "key").distinct().withColumn("held", F.lit(True))
    gone = items.filter("now AND NOT done AND kind = 'ref'").select("document_id", "kind", "key", F.lit(True).alias("removable"))
    return stale.join(held, ["workspace_id", "kind", "key"], "left").select("document_id", "kind", "key", F.col("held").isNull().alias("removable")).union(gone)


def promoted_clusters(items: DataFrame, least: int = 5) -> DataFrame:
    """Clusters with at least so many distinct detail terms besides their own name: (workspace_id, cluster_id, n)."""
    key = F.regexp_replace(F.lower(F.trim(F.get(F.split("line", " - "), F.lit(0)))), "[-_ ]+", " ")
    own = F.regexp_replace(F.lower(F.trim("cluster_name")), "[-_ ]+", " ")
    terms = items.filter(F.contains("line", F.lit(" - "))).withColumn("key", key).filter((F.col("key") != "") & (F.col("key") != own))
    return terms.groupBy("workspace_id", "cluster_id").agg(F.countDistinct("key").alias("n")).filter(F.col("n") >= least)


def entry_decisions(entries: DataFrame, references: DataFrame, split_at: int = 5, merge_at: int = 2, promote_at: int = 2) -> DataFrame:
    """Split entries with many children, merge back pages with few, promote entries that several pages refer to."""
    children = entries.filter("parent_entry_id IS NOT NULL").groupBy(F.col("parent_entry_id").alias("entry_id")).agg(F.count("*").alias("children"))
    pages = references.groupBy("entry_id").agg(F.countDistinct("page_id").alias("pages"))
    counted = entries.join(children, "entry_id", "left").join(pages, "entry_id", "left").fillna(0, ["children", "pages"])
    decision = (
        F.when(F.col("has_page") & (F.col("children") <= merge_at), "merge_back")
        .when(~F.col("has_page") & (F.col("children") >= split_at), "split")
        .when(~F.col("has_page") & (F.col("pages") >= promote_at), "promote")
        .otherwise("keep")
    )
    return counted.select("entry_id", "children", "pages", decision.alias("decision"))


def merged_evaluations(windows: DataFrame) -> DataFrame:
    """A document's windows (document_id, position, passed, retry, score, n_blocks, issues) as one evaluation: all passed, any retry, scores
    weighted by blocks, issues one after another."""
    weight = F.greatest(F.col("n_blocks"), F.lit(1))
    issues = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "issues"))), lambda w: w["issues"]))
    return windows.groupBy("document_id").agg(
        F.every("passed").alias("passed"), F.some("retry").alias("retry"), (F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"), F.count("*").alias("windows"),
        issues.alias("issues"),
    )


def same_names(items: DataFrame) -> DataFrame:
    """Items of one parent and type whose names are equal but for case, composition, blanks around and a closing .md of documents."""
    trimmed = folded(F.trim("name"))
    name = F.when(F.col("type") == "document", F.regexp_replace(trimmed, "[.]md$", "")).otherwise(trimmed)
    groups = items.groupBy("parent_id", "type", name.alias("same_name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return groups.filter("n > 1")


def quoted(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether each quote (doc_id, quote_id, quote) stands in its document when runs of blanks are one blank."""
    flat = lambda c: F.trim(F.regexp_replace(F.col(c), "[ \t\n\r]+", " "))
    return quotes.join(docs, "doc_id").select("doc_id", "quote_id", F.contains(flat("text"), flat("quote")).alias("found"))


#: A page's grid has at most so many columns and rows.
GRID = 64


def box_matches(boxes: DataFrame, candidates: DataFrame, least: float = 0.25) -> DataFrame:
    """Each candidate's best box of its page: overlap of at least so much, or its centre inside.

    A page is cut into a grid of about the mean box's size; boxes and candidates are dealt to the cells that they touch and meet
    there, a pair only in the first cell that both touch. So a page costs what its boxes and their neighbours are, not all pairs.
    """
    from docloom.operators.graph import overlap_ratio

    a, b, page = ("x0", "y0", "x1", "y1"), ("cx0", "cy0", "cx1", "cy1"), ["document_id", "page"]
    both = boxes.select(*page, *a).union(candidates.select(*page, *a))
    side = lambda lo, hi: F.greatest(F.avg(F.col(hi) - F.col(lo)), (F.max(hi) - F.min(lo)) / GRID, F.lit(1e-9))
    grid = both.groupBy(*page).agg(F.min("x0").alias("left"), F.min("y0").alias("top"), side("x0", "x1").alias("wide"), side("y0", "y1").alias("high"))
    cell = lambda x, origin, size: F.floor((F.col(x) - F.col(origin)) / F.col(size)).cast("int")

    def placed(rows: DataFrame, names: tuple[str, ...], mark: str) -> DataFrame:
        x0, y0, x1, y1 = names
        ends = rows.join(grid, page).select(*rows.columns, cell(x0, "left", "wide").alias(f"{mark}i"), cell(y0, "top", "high").alias(f"{mark}j"), cell(x1, "left", "wide").alias("i1"), cell(y1, "top", "high").alias("j1"))
        down = ends.withColumn("i", F.explode(F.sequence(F.col(f"{mark}i"), F.greatest("i1", f"{mark}i"))))
        return down.withColumn("j", F.explode(F.sequence(F.col(f"{mark}j"), F.greatest("j1", f"{mark}j")))).drop("i1", "j1")

    named = candidates.select(*page, F.col("id").alias("candidate_id"), *[F.col(x).alias(y) for x, y in zip(a, b)])
    middle = lambda p, q: (F.col(p) + F.col(q)) / 2
    inside = middle("cx0", "cx1").between(F.col("x0"), F.col("x1")) & middle("cy0", "cy1").between(F.col("y0"), F.col("y1"))
    met = placed(boxes.select(*page, "id", *a), a, "b").join(placed(named, b, "c"), [*page, "i", "j"])
    once = met.filter((F.col("i") == F.greatest("bi", "ci")) & (F.col("j") == F.greatest("bj", "cj")))
    near = once.withColumn("ratio", overlap_ratio(a, b)).filter((F.col("ratio") >= least) | inside)
    return near.groupBy("candidate_id").agg(F.max_by("id", F.struct(F.round("ratio", 9), -F.col("id"))).alias("box_id"), F.round(F.max("ratio"), 6).alias("ratio"))


def resolved_names(incoming: DataFrame, known: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """What the incoming concepts' names decide: rows (workspace_id, slug, decision, merge_into).

    incoming, known: workspace_id, slug, key, a row for each name; judged: workspace_id, slug, target, merges decided otherwise. A concept that
    shares a key with exactly one other, known or incoming, merges into it, but into an incoming one only if that one's smallest key, then
    slug, comes first. With several others it is created; without any it is left to judgement. A merge goes on through merges of its target, its
    own or judged ones, as long as they lead to concepts that exist, and stops where it would come round.
    """
    own = ["workspace_id", "slug"]
    both = incoming.select(*own, "key").withColumn("old", F.lit(False)).unionByName(known.select(*own, "key").withColumn("old", F.lit(True))).distinct()
    facts = both.groupBy(*own).agg(F.min("key").alias("first_key"), F.some(~F.col("old")).alias("fresh"))
    # Two entries may be the concept's own, and two others settle that it is no unique match.
    place = F.row_number().over(Window.partitionBy("workspace_id", "key").orderBy("slug", "old"))
    few = both.withColumn("k", place).filter("k <= 4").select("workspace_id", "key", F.col("slug").alias("other"), "old")
    met = incoming.select(*own, "key").distinct().join(few, ["workspace_id", "key"]).filter("slug <> other").select(*own, "other", "old").distinct()
    unique = met.groupBy(*own).agg(F.count("*").alias("n"), F.min("other").alias("target"))
    target = facts.select("workspace_id", F.col("slug").alias("target"), F.col("first_key").alias("target_key"), F.col("fresh").alias("target_fresh"))
    placed = incoming.select(*own).distinct().join(facts.drop("fresh"), own).join(unique, own, "left").join(target, ["workspace_id", "target"], "left")
    earlier = ~F.col("target_fresh") | (F.struct("target_key", "target") < F.struct("first_key", "slug"))
    decision = F.when(F.col("n") > 1, "create").when((F.col("n") == 1) & earlier, "merge").otherwise("judge")
    decided = written(placed.select(*own, decision.alias("decision"), F.when(decision == "merge", F.col("target")).alias("merge_into")))

    steps = decided.filter("decision = 'merge'").select(*own, F.col("merge_into").alias("next"))
    if judged is not None:
        open_ones = judged.join(decided.filter("decision = 'judge'"), own, "left_semi").groupBy(*own).agg(F.min("target").alias("next"))
        exists = facts.select("workspace_id", F.col("slug").alias("next"))
        steps = steps.unionByName(open_ones.join(exists, ["workspace_id", "next"], "left_semi").select(*own, "next"))
    steps = steps.select("workspace_id", F.col("slug").alias("merge_into"), "next")
    walk = written(decided.filter("decision = 'merge'").select(*own, "merge_into", F.array("slug").alias("seen")))
    ends = [walk.limit(0).select(*own, "merge_into")]
    while walk.take(1):  # a round for each merge of the longest chain
        joined = walk.join(steps, ["workspace_id", "merge_into"], "left")
        goes_on = F.col("next").isNotNull() & ~F.array_contains("seen", F.col("merge_into"))
        marked = written(joined.withColumn("goes_on", goes_on))
        ends.append(marked.filter("NOT goes_on").select(*own, "merge_into"))
        walk = marked.filter("goes_on").select(*own, F.col("next").alias("merge_into"), F.array_append("seen", F.col("merge_into")).alias("seen"))
    final = reduce(DataFrame.unionByName, ends)
    return decided.drop("merge_into").join(final, own, "left")


def judged_pairs(pairs: DataFrame, related_at: float = 0.9) -> DataFrame:
    """Decisions from pair judgements: the best `same` merges, else all `related` of enough probability link, else new.
    A merge into what is itself merged would make a chain or cycle and is dropped, which leaves a new one."""
    best = F.max_by("candidate_slug", F.when(F.col("choice") == "same", F.struct("probability", F.col("candidate_slug"))))
    links = F.collect_list(F.when((F.col("choice") == "related") & (F.col("probability") >= related_at), F.struct((-F.col("probability")).alias("p"), "candidate_slug")))
    sums = pairs.groupBy("incoming_slug").agg(best.alias("merge_into"), F.array_sort(links).alias("links"))
    decision = F.when(F.col("merge_into").isNotNull(), "merge").when(F.size("links") > 0, "link").otherwise("new")
    linked = F.when(decision == "link", F.transform("links", lambda x: x["candidate_slug"])).otherwise(F.array().cast("array<string>"))
    decided = sums.select("incoming_slug", decision.alias("decision"), "merge_into", linked.alias("link_to"))
    merged = decided.filter("decision = 'merge'").select(F.col("incoming_slug").alias("merged"))
    chained = F.col("merge_into").isNotNull() & F.col("merged").isNotNull()
    key = F.coalesce("merge_into", "incoming_slug")  # nulls would all meet in one task
    return decided.join(merged, key == F.col("merged"), "left").select(
        "incoming_slug", F.when(chained, "new").otherwise(F.col("decision")).alias("decision"), F.when(~chained, F.col("merge_into")).alias("merge_into"), "link_to"
    )


def workspace_report(clusters: DataFrame, claims: DataFrame, stale: DataFrame, restated: DataFrame, least: int = 5) -> DataFrame:
    """Rows (workspace_id, cluster_id, finding): promote, needs_review, no_refs and too_few_details.

    clusters: workspace_id, cluster_id, promotion, promotion_refs, n_details; claims: workspace_id, cluster_id, claim_id, text, decision, refs;
    stale: workspace_id, ref; restated: workspace_id, cluster_id, claim_id, text. A claim that cites a stale reference and was not stated
    again blocks its cluster, which is then reviewed rather than promoted.
    """
    key = ["workspace_id", "cluster_id"]
    cites = claims.select(*key, "claim_id", "text", F.explode("refs").alias("ref")).join(stale.distinct(), ["workspace_id", "ref"], "left_semi")
    blocked = cites.join(restated, [*key, "claim_id", "text"], "left_anti").select(*key).distinct().withColumn("blocked", F.lit(True))
    doubted = claims.filter("decision = 'needs_review'").select(*key).distinct().withColumn("doubted", F.lit(True))
    c = clusters.join(blocked, key, "left").join(doubted, key, "left")
    is_candidate, has_refs, reaches = F.col("promotion") == "candidate", F.coalesce(F.size("promotion_refs"), F.lit(0)) > 0, F.col("n_details") >= least
    findings = F.array(
        F.when(is_candidate & ~has_refs, "no_refs"), F.when(is_candidate & has_refs & ~reaches, "too_few_details"),
        F.when(is_candidate & has_refs & reaches & F.col("blocked").isNull(), "promote"),
        F.when((F.col("promotion") == "needs_review") | F.col("blocked") | F.col("doubted"), "needs_review"),
    )
    return c.select(*key, F.explode(F.array_compact(findings)).alias("finding"))


#: The share of recall and of alignment that a good answer has.
LEAST_QUALITY = 0.75


def quality_failures(evaluations: DataFrame, trashed: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (document_id, question, failure): why an evaluation of a living document failed; those without a reason are left out.

    evaluations: document_id, question, passed, question_ok, n_contradictions, gold_hit, missing_claims, answerable, recall, alignment,
    source_document_id, block_ids; units: source_document_id, block_refs of active pages, global (document:block) or of the
    unit's document. Nulls count as false and 0.
    """
    source = F.coalesce("source_document_id", "document_id")
    failed = evaluations.filter(~F.coalesce("passed", F.lit(False))).join(trashed.select("document_id").distinct(), "document_id", "left_anti")
    failed = failed.withColumn("gold", F.transform("block_ids", lambda b: F.concat_ws(":", source, b)))
    ref = F.col("ref")
    whole = F.when(F.contains(ref, F.lit(":")), ref).otherwise(F.concat_ws(":", "source_document_id", ref))
    indexed = units.select("source_document_id", F.explode("block_refs").alias("ref")).select(whole.alias("ref")).distinct()
    found = failed.select("document_id", "question", F.explode("gold").alias("ref")).join(indexed, "ref", "left_semi")
    found = found.select("document_id", "question").distinct().withColumn("indexed", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    incomplete = (F.coalesce(F.size("missing_claims"), F.lit(0)) > 0) | ~yes("answerable") | (number("recall") < LEAST_QUALITY)
    failure = (
        F.when(~yes("question_ok"), "question").when(number("n_contradictions") > 0, "contradictory")
        .when(~yes("gold_hit"), F.when(F.col("indexed"), "retrieval").otherwise("not_in_wiki"))
        .when(incomplete, "incomplete").when(number("alignment") < LEAST_QUALITY, "imprecise")
    )
    return failed.join(found, ["document_id", "question"], "left").select("document_id", "question", failure.alias("failure")).filter("failure IS NOT NULL")
