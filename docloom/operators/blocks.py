"""Markdown documents as addressable blocks, packets of blocks, and differences between versions.

Splitting and packing keep state from line to line or block to block, and versions are aligned by longest runs, so these are small
functions, one document at a time; everything around them is built-in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import written

BLOCK = "block_id string, text string, position int, line_start int, line_end int, block_type string, section_path array<string>"


def split_blocks(text: str) -> list[tuple[str, str, int, int]]:
    """(type, text, first line, last line) of each block: fenced code as a whole, a heading alone, else up to a blank line.

    Every line gets a label from the number of fences before it; runs of one label are blocks.
    """
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    fences = list(accumulate(line.startswith("```") for line in bare))

    def label(i: int) -> tuple[str, int]:
        if bare[i].startswith("```") or fences[i] % 2:
            return "code", (fences[i] + 1) // 2
        if bare[i].startswith("#"):
            return "heading", i
        return ("text" if bare[i] else "blank"), 0

    found = []
    for (kind, _), run in groupby(range(len(lines)), label):
        own = list(run)
        if kind != "blank":
            if kind == "text":
                kind = "list" if bare[own[0]].startswith(("- ", "* ", "1. ")) else "paragraph"
            found.append((kind, "\n".join(lines[own[0] : own[-1] + 1]).strip("\n"), own[0] + 1, own[-1] + 1))
    return found


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (document_id, block_id, text, position, line_start, line_end, block_type, section_path); null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for document, text in zip(batch["document_id"], batch["text"]):
                path: list[str] = []
                for k, (kind, raw, first, last) in enumerate(split_blocks(text or ""), 1):
                    if kind == "heading":
                        bare = raw.strip()
                        level = len(bare) - len(bare.lstrip("#"))
                        path = path[: max(0, level - 1)] + [bare.lstrip("#").strip()]
                    rows.append((document, f"B{k:04d}", re.sub(r"\s+", " ", raw).strip(), k, first, last, kind, list(path)))
            yield pd.DataFrame(rows, columns=["document_id", "block_id", "text", "position", "line_start", "line_end", "block_type", "section_path"])

    keyed = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    return keyed.mapInPandas(run, f"document_id {keyed.schema['document_id'].dataType.simpleString()}, {BLOCK}")


def greedy_runs(sizes: list[int], budget: int, overlap: int = 0, most: int | None = None) -> list[tuple[int, int]]:
    """Runs [start, end) of items in order: each takes items while their sizes fit the budget (and no more than most),
    one at least; the last overlap items of a run begin the next."""
    runs, start, used = [], 0, 0
    for k, size in enumerate(sizes):
        if k > start and (used + size > budget or (most is not None and k - start >= most)):
            runs.append((start, k))
            start = max(start, k - overlap)
            used = sum(sizes[start:k])
        used += size
    if start < len(sizes):
        runs.append((start, len(sizes)))
    return runs


def _runs(blocks: DataFrame, size: F.Column, budget: int, overlap: int) -> DataFrame:
    """Rows (document_id, k, items): the runs of a document's blocks in order; items: block_id, text. One Arrow pass over grouped rows."""
    items = F.array_sort(F.collect_list(F.struct("position", "block_id", "text", size.cast("int").alias("size"))))
    listed = blocks.groupBy("document_id").agg(items.alias("items"))

    def cut(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda x: [[a, b] for a, b in greedy_runs(x.tolist(), budget, overlap)])

    cuts = F.pandas_udf(cut, "array<array<int>>")(F.transform("items", lambda x: x["size"]))
    runs = listed.select("document_id", "items", F.posexplode(cuts).alias("k", "cut"))
    return runs.select("document_id", "k", F.slice("items", F.col("cut")[0] + 1, F.col("cut")[1] - F.col("cut")[0]).alias("items"))


def packets(blocks: DataFrame, budget: int = 7000, overlap: int = 1) -> DataFrame:
    """Rows (document_id, chunk_id, block_ids) of budgeted runs of a document's blocks; a block's size is its text, its
    id and 4."""
    runs = _runs(blocks, F.length("text") + F.length("block_id") + 4, budget, overlap)
    return runs.select("document_id", F.format_string("chunk_%04d", F.col("k") + 1).alias("chunk_id"), F.transform("items", lambda x: x["block_id"]).alias("block_ids"))


def retrieval_chunks(blocks: DataFrame, most: int = 900) -> DataFrame:
    """Rows (document_id, chunk, text, block_ids): consecutive blocks joined by line feeds up to so many characters; longer blocks are cut."""
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / most).cast("int") - 1, F.lit(0)))).alias("part")
    cut = blocks.select("document_id", "block_id", "position", "text", parts)
    place = F.struct("position", "part")
    cut = cut.select("document_id", "block_id", place.alias("position"), F.substring("text", F.col("part") * most + 1, F.lit(most)).alias("text"))
    runs = _runs(cut, F.length("text") + 1, most + 1, 0)
    texts, ids = F.transform("items", lambda x: x["text"]), F.transform("items", lambda x: x["block_id"])
    return runs.select("document_id", F.col("k").alias("chunk"), F.array_join(texts, "\n").alias("text"), F.array_distinct(ids).alias("block_ids"))


def _aligned(key: tuple, before: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    """Pairs of places (i, j) of the longest common runs of two versions' block hashes."""
    before, after = (x.sort_values("place")["h"].tolist() for x in (before, after))
    runs = SequenceMatcher(None, before, after, autojunk=False).get_matching_blocks()
    return pd.DataFrame([(key[0], i + k, j + k) for i, j, size in runs for k in range(size)], columns=["document_id", "i", "j"])


def block_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (document_id, state, block_id, position): the new version's blocks with the ids they keep, and deleted ones.

    Longest common runs match, then of the rest each text that is there once on both sides. A match that changed its
    place moved, else it is unchanged. Where one old and one new block alone lie between two matches that are next to each other in the
    old version, the block was modified. What is left is deleted or added; added blocks are numbered on from the largest number in use, or
    from the document's last_number, if old has such a column for numbers of blocks that are gone.

    Documents whose blocks are all equal are settled by a hash. For the others only hashes of blocks are aligned, a document
    at a time; moves, modifications and numbers are joins, windows and counts.
    """
    doc = ["document_id"]
    order = Window.partitionBy("document_id").orderBy("position")
    last = F.col("last_number") if "last_number" in old.columns else F.lit(None)
    numbered = lambda df, *more: df.select(*doc, (F.row_number().over(order) - 1).alias("place"), F.md5("text").alias("h"), *more)
    was, now = numbered(old, "block_id", last.cast("long").alias("last_number")), numbered(new, "position")
    digest = lambda df, name: df.groupBy(*doc).agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda b: b["h"]), "")).alias(name))
    same = digest(was, "x").join(digest(now, "y"), doc).filter("x = y").select(*doc)
    settled = now.join(same, doc, "left_semi").join(was.select(*doc, "place", "block_id"), [*doc, "place"])
    settled = settled.select(*doc, F.lit("unchanged").alias("state"), "block_id", F.col("position").cast("int").alias("position"))

    kind = old.schema["document_id"].dataType.simpleString()
    was, now = (written(x.join(same, doc, "left_anti")) for x in (was, now))
    places = lambda x: x.select(*doc, "place", "h").groupBy(*doc)
    runs = written(places(was).cogroup(places(now)).applyInPandas(_aligned, f"document_id {kind}, i int, j int"))
    single = lambda x, at, name: x.join(runs.select(*doc, F.col(at).alias("place")), [*doc, "place"], "left_anti").groupBy(*doc, "h").agg(F.min("place").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    moves = single(was, "i", "i").join(single(now, "j", "j"), [*doc, "h"]).select(*doc, "i", "j")
    pairs = written(runs.union(moves))
    ends = was.groupBy(*doc).agg(F.count("*").alias("i")).join(now.groupBy(*doc).agg(F.count("*").alias("j")), doc, "full")
    ends = ends.select(*doc, F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"))
    by_old = Window.partitionBy("document_id").orderBy("i")
    gaps = pairs.union(ends).withColumn("a", F.lag("i", 1, -1).over(by_old)).withColumn("b", F.lag("j", 1, -1).over(by_old))
    modified = gaps.filter("i - a = 2 AND j - b = 2").select(*doc, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.lit("modified").alias("state"))
    # A modified block takes the place of a move to where it stands now.
    moved = pairs.join(modified.select(*doc, "j"), [*doc, "j"], "left_anti").select(*doc, "i", "j", F.when(F.col("i") == F.col("j"), "unchanged").otherwise("moved").alias("state"))
    kept = written(moved.union(modified))
    of_old = was.select(*doc, F.col("place").alias("i"), "block_id")
    number = F.when(F.rlike("block_id", F.lit("^B[0-9]+$")), F.substring("block_id", 2, 30).cast("long"))
    numbers = was.groupBy(*doc).agg(F.greatest(F.max(number), F.max("last_number"), F.lit(0)).alias("last"))
    added = now.join(kept.select(*doc, F.col("j").alias("place")), [*doc, "place"], "left_anti").join(numbers, doc, "left")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("place"))
    added = added.select(*doc, F.lit("added").alias("state"), F.format_string("B%04d", F.coalesce("last", F.lit(0)) + place).alias("block_id"), F.col("position").cast("int"))
    stay = kept.join(of_old, [*doc, "i"]).join(now.select(*doc, F.col("place").alias("j"), "position"), [*doc, "j"]).select(*doc, "state", "block_id", F.col("position").cast("int"))
    gone = of_old.join(kept.select(*doc, "i"), [*doc, "i"], "left_anti").select(*doc, F.lit("deleted").alias("state"), "block_id", F.lit(None).cast("int").alias("position"))
    return settled.union(stay).union(added).union(gone)


def stale_documents(derived: DataFrame) -> DataFrame:
    """Documents whose last ingested hash is not the last edited one, unknown hashes included."""
    return derived.filter(~F.col("ingested_hash").eqNullSafe(F.col("edited_hash")))


def cover(ranked: DataFrame, most: int) -> DataFrame:
    """Of each query's units (query_id, unit_id, probability, blocks), the most probable first, those that add a block
    to what is covered, at most so many: (query_id, unit_id, rank). A query's candidates are bounded by its ranking."""
    unit = F.struct((-F.col("probability")).alias("p"), "unit_id", "blocks")
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    start = F.struct(F.array().cast(f"array<{kinds['unit_id']}>").alias("taken"), F.array().cast(kinds["blocks"]).alias("covered"))

    def step(state: F.Column, u: F.Column) -> F.Column:
        adds = (F.size(state["taken"]) < most) & (F.size(F.array_except(u["blocks"], state["covered"])) > 0)
        more = F.struct(F.array_append(state["taken"], u["unit_id"]).alias("taken"), F.array_union(state["covered"], u["blocks"]).alias("covered"))
        return F.when(adds, more).otherwise(state)

    taken = listed.select("query_id", F.aggregate("units", start, step)["taken"].alias("taken"))
    return taken.select("query_id", F.posexplode("taken").alias("k", "unit_id")).select("query_id", "unit_id", (F.col("k") + 1).alias("rank"))
