"""Searchable units of pages, and evidence chosen from them. All built-in; a page's lines are numbered in one pass and never leave it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.helpers import SECTION_WEIGHTS, evidence_units, paragraphs, section_of
from docloom.functions.text import UNIT_TYPES, UNIT_WEIGHTS, block_refs, without_refs
from docloom.sources.store import written


def _looked_up(table: dict, key: F.Column, default: object) -> F.Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], F.lit(default))


def page_units(pages: DataFrame) -> DataFrame:
    """Rows (page_id, unit_type, block_refs, text, weight) of the lines of pages (page_id, markdown) that cite blocks, without mentions.

    Lines between two lines of three hyphens are not part of a page. Equal units of a page are one. A null text has none.
    """
    lines = pages.select("page_id", F.posexplode(F.split("markdown", "\r\n|\n|\r")).alias("n", "raw")).withColumn("line", F.trim("raw"))
    upto = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    is_rule = F.col("line") == "---"
    body = lines.withColumn("rules", F.sum(is_rule.cast("int")).over(upto)).filter(~is_rule & (F.col("rules") % 2 == 0))
    heading = F.when(F.rlike("line", F.lit(r"^##+\s+.")), F.regexp_extract("line", r"^##+\s+(.+?)\s*$", 1))
    named = body.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(upto))
    kind = _looked_up(UNIT_TYPES, F.lower(F.trim(F.coalesce("section", F.lit("body")))), "source_block")
    refs = block_refs(F.col("line"))
    bare = F.trim(F.regexp_replace(without_refs(F.col("line")), r"^[-*]\s+", ""))
    units = named.filter("heading IS NULL").select("page_id", kind.alias("unit_type"), refs.alias("block_refs"), bare.alias("text"))
    units = units.filter("size(block_refs) > 0 AND unit_type <> 'mention' AND text <> ''").distinct()
    return units.withColumn("weight", _looked_up(UNIT_WEIGHTS, F.col("unit_type"), 1.0))


def attached_units(units: DataFrame, entries: DataFrame) -> DataFrame:
    """units (page_id, unit_id, block_refs) with entry_id: the one entry (page_id, entry_id, block_refs) of the page that cites all its blocks.

    A page's different sets of blocks are looked up, each once, among the different sets of its entries: those that have the block of it that
    the fewest of them have. Units of one page and set share what is found, so they are neither multiplied nor shuffled for it.
    """
    blocks = F.array_sort(F.array_distinct("block_refs"))
    held = entries.select("page_id", "entry_id", blocks.alias("held")).groupBy("page_id", "held").agg(F.count("*").alias("m"), F.min("entry_id").alias("entry_id"))
    has = held.select("*", F.explode("held").alias("ref"))
    often = has.groupBy("page_id", "ref").agg(F.count("*").alias("often"))
    asked = units.select("page_id", blocks.alias("blocks")).distinct().select("*", F.explode("blocks").alias("ref")).join(often, ["page_id", "ref"], "left")
    rare = asked.groupBy("page_id", "blocks").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "ref")).alias("least")).filter("least.often > 0")
    met = rare.select("page_id", "blocks", "least.ref").join(has, ["page_id", "ref"]).filter(F.size(F.array_except("blocks", "held")) == 0)
    single = met.groupBy("page_id", "blocks").agg(F.sum("m").alias("m"), F.min("entry_id").alias("entry_id")).filter("m = 1").drop("m")
    # Written, so that its size is known: a small one is broadcast by Spark's own threshold.
    return units.withColumn("blocks", blocks).join(written(single), ["page_id", "blocks"], "left").drop("blocks")


def paragraph_units(pages: DataFrame) -> DataFrame:
    """Rows (page_id, paragraph, place, unit, section, weight): the units of the paragraphs of pages (page_id, markdown), from 0, with the section that their
    paragraph opens with and its weight. A page's text is cut where it stands; nothing is shuffled."""
    cut = pages.select("page_id", F.posexplode(paragraphs("markdown")).alias("paragraph", "text"))
    section = F.coalesce(section_of("text"), F.lit("paragraph"))
    units = cut.select("page_id", "paragraph", section.alias("section"), F.posexplode(evidence_units("text")).alias("place", "unit"))
    return units.select("page_id", "paragraph", "place", "unit", "section", _looked_up(SECTION_WEIGHTS, F.col("section"), 1.0).alias("weight"))


#: Weights of evidence scores.
TOKEN_WEIGHT, ROLE_BONUS = 0.20, 0.25


def evidence_scores(candidates: DataFrame) -> DataFrame:
    """candidates (page_score, weight, hybrid, query_tokens, unit_tokens, in_role, bonus) with score."""
    shared = F.size(F.array_intersect("query_tokens", "unit_tokens")) / F.greatest(F.size(F.array_distinct("query_tokens")), F.lit(1))
    role = F.when(F.col("in_role"), ROLE_BONUS).otherwise(0.0)
    return candidates.withColumn("score", F.col("page_score") + F.col("page_score") * F.col("weight") + F.col("hybrid") + TOKEN_WEIGHT * shared + role + F.col("bonus"))


def chosen_paragraphs(candidates: DataFrame, most: int = 4) -> DataFrame:
    """Of each query's page the paragraphs to show (query_id, page_id, unit_id, block_refs, score): the best single-block unit of every
    block that a unit of several blocks names comes first, then the rest by score."""
    by = Window.partitionBy("query_id", "page_id", "ref").orderBy(F.desc("score"), "unit_id")
    single = candidates.filter("size(block_refs) = 1").withColumn("ref", F.col("block_refs")[0])
    atoms = single.withColumn("k", F.row_number().over(by)).filter("k = 1").drop("k")
    named = candidates.filter("size(block_refs) > 1").select("query_id", "page_id", F.explode("block_refs").alias("ref")).distinct().withColumn("named", F.lit(True))
    first = atoms.join(named, ["query_id", "page_id", "ref"], "left").select("query_id", "page_id", "unit_id", "block_refs", "score", F.coalesce("named", F.lit(False)).alias("named"))
    rest = candidates.filter("size(block_refs) > 1").select("query_id", "page_id", "unit_id", "block_refs", "score", F.lit(False).alias("named"))
    place = Window.partitionBy("query_id", "page_id").orderBy(F.desc("named"), F.desc("score"), "unit_id")
    return first.union(rest).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most).drop("named")


def within_budget(items: DataFrame, budget: int = 24_000, joint: int = 2) -> DataFrame:
    """Of each workspace's items (workspace_id, item_id, score, text) those that fit a budget of characters, best first: an item that
    does not fit is skipped. Longer ones than the budget are cut to what is left; joint characters part two items.

    Only sizes are gathered by workspace, and only those that can be taken: of items of one size the best fit first, and no more than
    fill the budget, so some budget * ln(budget) items at most are gathered whatever the workspace holds.
    """
    size = F.least(F.length("text"), F.lit(budget + 1))
    best = F.row_number().over(Window.partitionBy("workspace_id", "__n").orderBy(F.desc("score"), "item_id"))
    items = items.filter("text <> ''").withColumn("__n", size).withColumn("__k", best).filter(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.lit(budget + joint) / (F.col("__n") + joint))))
    item = F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("id"), size.alias("n"))
    listed = items.groupBy("workspace_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kind = items.schema["item_id"].dataType.simpleString()
    start = F.struct(F.array().cast(f"array<struct<item_id:{kind},chars:int>>").alias("taken"), F.lit(0).alias("used"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        left = F.lit(budget) - state["used"] - joint
        chars = F.when(x["n"] > budget, left).otherwise(x["n"])
        fits = (chars > 0) & (chars <= left)
        taken = F.array_append(state["taken"], F.struct(x["id"].alias("item_id"), chars.cast("int").alias("chars")))
        return F.when(fits, F.struct(taken.alias("taken"), (state["used"] + chars + joint).cast("int").alias("used"))).otherwise(state)

    chosen = listed.select("workspace_id", F.explode(F.aggregate("items", start, step)["taken"]).alias("t"))
    return chosen.select("workspace_id", "t.item_id", "t.chars")
