"""Where concepts go: slugs, heads, sub-entries, key points and what a document contributes to each concept."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import written

#: The numbers that a taken slug is tried with, and the slug that nobody gets.
SLUG_NUMBERS, NO_SLUG = range(2, 10), "untitled"


def allocated_slugs(concepts: DataFrame, index: DataFrame) -> DataFrame:
    """Rows (workspace_id, slug, place, allocated) of concepts (workspace_id, slug, place, keys), in the order of place and slug.

    index: workspace_id, slug, status (active or deleted), keys. The one active concept with a key of it gives its slug, else, without an
    active one, the one deleted; that goes to the first concept only. All others take the first free one of slug, slug-2 ... slug-9, null
    if none is. Concepts can only be in each other's way below one root (the slug without such endings); of one slug only the first
    nine can get anything, so a root's list is bounded by its different slugs.

    Of a key's slugs in the index only the least and the greatest count, as a concept has one hit if all of its are equal: concepts do not
    meet the index's rows but one row for each key. All tables that are joined to the concepts are written first, so small ones are broadcast.
    """
    keyed = concepts.select("workspace_id", "slug", "place", F.explode("keys").alias("key"))
    known = index.select("workspace_id", F.struct(F.col("slug").alias("match")).alias("hit"), "status", F.explode("keys").alias("key"))
    of = lambda status: F.when(F.col("status") == status, F.col("hit"))
    ends = {f"{end}_{status}": of(status) for status in ("active", "deleted") for end in ("min", "max")}
    least = lambda name, c: (F.min(c) if name.startswith("min") else F.max(c)).alias(name)
    by_key = written(known.groupBy("workspace_id", "key").agg(*[least(name, c) for name, c in ends.items()]))
    sums = keyed.join(by_key, ["workspace_id", "key"]).groupBy("workspace_id", "slug", "place").agg(*[least(name, F.col(name)) for name in ends])
    one = lambda status: F.when(F.col(f"min_{status}") == F.col(f"max_{status}"), F.col(f"min_{status}.match"))
    reuse = F.when(F.col("min_active").isNull(), one("deleted")).otherwise(one("active"))
    wished = sums.select("workspace_id", "slug", "place", reuse.alias("allocated")).filter("allocated IS NOT NULL")
    reused = wished.groupBy("workspace_id", "allocated").agg(F.min(F.struct("place", "slug")).alias("x"))
    reused = written(reused.select("workspace_id", "x.slug", "x.place", "allocated"))
    rest = concepts.select("workspace_id", "slug", "place").join(reused, ["workspace_id", "slug", "place"], "left_anti")

    numbers = f"(-[{SLUG_NUMBERS[0]}-{SLUG_NUMBERS[-1]}])+$"
    root = F.regexp_replace("slug", numbers, "")
    turn = F.dense_rank().over(Window.partitionBy("workspace_id", "slug").orderBy("place"))
    early = written(rest.withColumn("turn", turn).filter(F.col("turn") <= len(SLUG_NUMBERS) + 1).distinct().withColumn("root", root))
    waiting = written(early.groupBy("workspace_id", "root").agg(F.array_sort(F.collect_list(F.struct("place", "slug"))).alias("waiting")))
    taken = index.select("workspace_id", "slug", root.alias("root")).join(waiting, ["workspace_id", "root"], "left_semi")
    taken = taken.groupBy("workspace_id", "root").agg(F.collect_set("slug").alias("taken"))
    none = F.array().cast("array<string>")
    place = concepts.schema["place"].dataType.simpleString()
    start = F.struct(F.coalesce("taken", none).alias("taken"), F.array().cast(f"array<struct<place:{place},slug:string,allocated:string>>").alias("out"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        tries = F.array(x["slug"], *[F.concat(x["slug"], F.lit(f"-{n}")) for n in SLUG_NUMBERS])
        free = F.get(F.filter(tries, lambda t: (t != NO_SLUG) & ~F.array_contains(state["taken"], t)), F.lit(0))
        now = F.when(free.isNull(), state["taken"]).otherwise(F.array_append(state["taken"], free))
        return F.struct(now.alias("taken"), F.array_append(state["out"], F.struct(x["place"].alias("place"), x["slug"].alias("slug"), free.alias("allocated"))).alias("out"))

    given = waiting.join(taken, ["workspace_id", "root"], "left").select("workspace_id", F.explode(F.aggregate("waiting", start, step)["out"]).alias("x"))
    given = given.select("workspace_id", "x.slug", "x.place", "x.allocated")
    last = written(early.filter(F.col("turn") == len(SLUG_NUMBERS) + 1).select("workspace_id", "slug", F.col("place").alias("last")))
    late = rest.join(last, ["workspace_id", "slug"]).filter(F.col("place") > F.col("last")).select("workspace_id", "slug", "place").distinct()
    return reused.union(given).union(late.withColumn("allocated", F.lit(None).cast("string")))


def _acyclic(edges: pd.DataFrame) -> pd.DataFrame:
    """Edges taken in order unless the head already lies below the detail; above holds all heads over each node."""
    above: dict[object, set] = defaultdict(set)
    below: dict[object, set] = defaultdict(set)
    keep = []
    for detail, head in zip(edges["detail"], edges["head"], strict=True):
        good = detail != head and detail not in above[head]
        keep.append(good)
        if good:
            tops, lows = above[head] | {head}, below[detail] | {detail}
            for x in lows:
                above[x] |= tops
            for x in tops:
                below[x] |= lows
    return edges[pd.Series(keep, index=edges.index, dtype=bool)]


def assigned_heads(judged: DataFrame, most: int = 5, least: float = 0.9) -> DataFrame:
    """Rows (document_id, detail, head, probability): the heads a detail is part of.

    judged: document_id, detail, head, is_term, similarity, probability. Of each kind of head the most similar count; of these, pairs of
    enough probability stay unless both ways hold; likely ones first, one that would close a cycle is left out. Only edges between
    nodes that are both detail and head can lie on a cycle; just those go to the ordered check, a document at a time.
    """
    near = Window.partitionBy("document_id", "detail", "is_term").orderBy(F.desc("similarity"), "head")
    close = judged.withColumn("k", F.row_number().over(near)).filter((F.col("k") <= most) & (F.col("probability") >= least))
    sure = close.groupBy("document_id", "detail", "head").agg(F.max("probability").alias("probability"))
    back = sure.select("document_id", F.col("detail").alias("head"), F.col("head").alias("detail"))
    one_way = sure.join(back, ["document_id", "detail", "head"], "left_anti")
    details = one_way.select("document_id", F.col("detail").alias("head")).distinct().withColumn("is_detail", F.lit(True))
    heads = one_way.select("document_id", F.col("head").alias("detail")).distinct().withColumn("is_head", F.lit(True))
    marked = one_way.join(details, ["document_id", "head"], "left").join(heads, ["document_id", "detail"], "left").select("document_id", "detail", "head", "probability", (F.col("is_detail") & F.col("is_head")).alias("risky"))
    safe = marked.filter("risky IS NULL").drop("risky")
    risky = marked.filter("risky").drop("risky")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return _acyclic(part.sort_values(["probability", "detail", "head"], ascending=[False, True, True]))

    return safe.union(risky.groupBy("document_id").applyInPandas(run, risky.schema))


def matched_entries(details: DataFrame, entries: DataFrame) -> DataFrame:
    """details (document_id, detail, key, parent, place) with entry_id and same_as.

    entries: entry_id, slugs, key. A detail is the entry that once had its slug (the last such entry), else the first entry with its key.
    Of details of one document, parent and key the later ones are the same as the first.
    """
    by_slug = entries.select(F.explode("slugs").alias("detail"), "entry_id").groupBy("detail").agg(F.max("entry_id").alias("by_slug"))
    by_key = entries.groupBy("key").agg(F.min("entry_id").alias("by_key"))
    first = F.first("detail").over(Window.partitionBy("document_id", "parent", "key").orderBy("place", "detail"))
    found = details.withColumn("first", first).join(by_slug, "detail", "left").join(by_key, "key", "left")
    same = F.when(F.col("first") != F.col("detail"), F.col("first"))
    return found.select("document_id", "detail", "key", "parent", "place", F.coalesce("by_slug", "by_key").alias("entry_id"), same.alias("same_as"))


def capped_mentions(mentions: DataFrame, most: int = 20, per_block: int = 2) -> DataFrame:
    """Of each document's mentions (document_id, slug, refs) those to be judged: with most references first, then by first reference and
    slug; so many of one first reference, and so many of a document. Mentions without references are none."""
    refs = F.array_sort(F.array_distinct("refs"))
    ordered = mentions.filter("size(refs) > 0").select("document_id", "slug", F.size(refs).alias("n"), refs[0].alias("block"))
    order = [F.desc("n"), "block", "slug"]
    of_block = ordered.withColumn("k", F.row_number().over(Window.partitionBy("document_id", "block").orderBy(*order))).filter(F.col("k") <= per_block)
    return of_block.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order))).filter(F.col("rank") <= most).drop("k")


def key_points(notes: DataFrame) -> DataFrame:
    """notes (document_id, place, text, refs) without empty texts, each text of a document once, where it comes first."""
    bare = notes.withColumn("text", F.trim("text")).filter("text <> ''")
    first = F.row_number().over(Window.partitionBy("document_id", "text").orderBy("place"))
    return bare.withColumn("k", first).filter("k = 1").drop("k")


def concept_key_points(concepts: DataFrame, points: DataFrame) -> DataFrame:
    """Rows (document_id, slug, place, text): the key points that share a reference with a concept (document_id, slug, refs), in order, without
    those of which a reference was used already. A concept without references takes from all points of its document."""
    asked = concepts.select("document_id", "slug", F.explode("refs").alias("ref")).distinct()
    cited = points.select("document_id", "place", "text", "refs", F.explode("refs").alias("ref"))
    shared = asked.join(cited, ["document_id", "ref"]).select("document_id", "slug", "place", "text", "refs").distinct()
    free = concepts.filter("coalesce(size(refs), 0) <= 0").select("document_id", "slug").join(points, "document_id").select("document_id", "slug", "place", "text", "refs")
    listed = shared.union(free).groupBy("document_id", "slug").agg(F.array_sort(F.collect_list(F.struct("place", "text", "refs"))).alias("points"))
    kinds = {name: points.schema[name].dataType.simpleString() for name in ("place", "refs")}
    start = F.struct(F.array().cast(kinds["refs"]).alias("used"), F.array().cast(f"array<struct<place:{kinds['place']},text:string>>").alias("kept"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        kept = F.struct(F.concat(state["used"], x["refs"]).alias("used"), F.array_append(state["kept"], F.struct(x["place"].alias("place"), x["text"].alias("text"))).alias("kept"))
        return F.when(F.size(F.array_intersect(state["used"], x["refs"])) > 0, state).otherwise(kept)

    chosen = listed.select("document_id", "slug", F.explode(F.aggregate("points", start, step)["kept"]).alias("p"))
    return chosen.select("document_id", "slug", "p.place", "p.text")


def contributions(concepts: DataFrame, evidence: DataFrame, blocks: DataFrame, points: DataFrame, links: DataFrame) -> DataFrame:
    """One row (document_id, slug, evidence, blocks, points, links) a concept (document_id, slug, place, evidence_ids, refs): its evidence that
    exists, the blocks that it or its evidence cites, key points that cite one of these, and where it links to; each sorted, evidence and
    blocks under ids that hold everywhere (document:id).

    evidence: document_id, evidence_id, refs; blocks: document_id, block_id; points: document_id, place, refs; links: document_id, slug, target.
    """
    keys = ["document_id", "slug"]
    wide = lambda c: F.concat_ws(":", F.col("document_id"), F.col(c))
    named = concepts.select(*keys, F.explode("evidence_ids").alias("evidence_id")).distinct().join(evidence, ["document_id", "evidence_id"])
    cited = concepts.select(*keys, F.explode("refs").alias("block_id")).union(named.select(*keys, F.explode("refs"))).distinct()
    about = points.select("document_id", "place", F.explode("refs").alias("block_id")).join(cited, ["document_id", "block_id"])
    gather = lambda rows, c, name: rows.groupBy(*keys).agg(F.array_sort(F.collect_set(c)).alias(name))
    out = concepts.select(*keys).distinct()
    for rows, c, name in (
        (named, wide("evidence_id"), "evidence"), (cited.join(blocks, ["document_id", "block_id"], "left_semi"), wide("block_id"), "blocks"),
        (about, F.col("place"), "points"), (links, F.col("target"), "links"),
    ):
        out = out.join(gather(rows, c, name), keys, "left")
    kinds = dict(out.dtypes)
    return out.select(*keys, *[F.coalesce(name, F.array().cast(kinds[name])).alias(name) for name in ("evidence", "blocks", "points", "links")])


class Outline:
    """Which entries of a page stand, and below what: structure alone. An entry is (parent, the sequence numbers of its adds)."""

    def __init__(self):
        self.standing: dict[object, tuple[object, list]] = {}
        self.cut: dict[object, tuple[object, list]] = {}
        self.beneath: dict[object, set] = defaultdict(set)  # parent -> entries that ever stood below it

    def tree(self, top: object, *layers: dict) -> list:
        """top and what stands below it, by the first of the layers that has an entry."""
        seen = lambda x: next((layer[x] for layer in layers if x in layer), None)
        found = [top] if seen(top) else []
        known = set(found)
        for x in found:  # grows while it is read
            more = [y for y in self.beneath[x] if y not in known and (e := seen(y)) and e[0] == x]
            known.update(more)
            found += more
        return found

    def put(self, x: object, parent: object, adds: list) -> None:
        self.standing[x] = parent, adds
        self.beneath[parent].add(x)

    def add(self, x: object, parent: object, sequence: object) -> None:
        if x not in self.standing:
            self.put(x, parent, [])
        self.standing[x][1].append(sequence)

    def move(self, x: object, parent: object, sequence: object) -> None:
        if x in self.standing and parent not in self.tree(x, self.standing):
            self.put(x, parent, self.standing[x][1])

    def remove(self, x: object, parent: object, sequence: object) -> None:
        lost = set(self.tree(x, self.standing))
        for y in [y for y in self.standing if y in lost]:
            self.cut[y] = self.standing.pop(y)

    def revive(self, x: object, parent: object, sequence: object) -> None:
        if x in self.cut and x not in self.standing:
            back = set(self.tree(x, self.standing, self.cut))
            for y in [y for y in self.cut if y in back]:
                self.put(y, *self.cut.pop(y))

    def risen(self) -> list[tuple[object, object, list]]:
        """(entry, parent, adds) in order; who stands below nothing, or below itself, stands on the page."""
        out = []
        for x, (parent, adds) in list(self.standing.items()):
            up, chain = parent, {x}
            while up in self.standing and up not in chain:
                chain.add(up)
                up = self.standing[up][0]
            if parent not in self.standing or up == x:
                parent = None
                self.standing[x] = None, adds
            out.append((x, parent, adds))
        return out


def _outlined(changes: pd.DataFrame) -> pd.DataFrame:
    outline = Outline()
    steps = {op: getattr(outline, op) for op in ("add", "move", "remove", "revive")}
    for op, x, parent, sequence in changes.sort_values("sequence", kind="stable")[["op", "entry_id", "parent_entry_id", "sequence"]].itertuples(index=False):
        if op in steps:
            steps[op](x, parent or None, sequence)
    page = changes["page_id"].iloc[0] if len(changes) else None
    return pd.DataFrame([(page, *row) for row in outline.risen()], columns=["page_id", "entry_id", "parent_entry_id", "adds"])


#: What adds of an entry bring: arrays of values.
BROUGHT = ("refs", "evidence_claim_ids", "aliases", "tags")


def replayed_entries(changes: DataFrame) -> DataFrame:
    """Rows (page_id, entry_id, name, definition, parent_entry_id, refs, evidence_claim_ids, slugs, aliases, tags, operations): what is left of
    each page's sub-entries.

    changes: page_id, sequence, op, operation_id, entry_id, parent_entry_id, name, and, where there are any, definition, slug, refs,
    evidence_claim_ids, aliases, tags. The first add of an entry names and defines it, later ones add to its lists; move
    changes the parent unless that lies below; remove takes everything below along; revive brings back what is removed, with what lies
    below. Entries whose parent is not left, or lies below them, rise to the page. Without an entry_id a change is none. Sequence numbers
    are unique on a page. Only a page's structure (who, below whom, when) is replayed as one group; what the adds bring is joined by
    sequence and united by value, first place first.
    """
    kinds = dict(changes.dtypes)
    known = changes.filter("entry_id IS NOT NULL")
    for name, kind in {"definition": "string", "slug": "string", **dict.fromkeys(BROUGHT, "array<string>")}.items():
        if name not in kinds:
            known = known.withColumn(name, F.lit(None).cast(kind))
    schema = f"page_id {kinds['page_id']}, entry_id {kinds['entry_id']}, parent_entry_id {kinds['entry_id']}, adds array<{kinds['sequence']}>"
    left = known.select("page_id", "sequence", "op", "entry_id", "parent_entry_id").groupBy("page_id").applyInPandas(_outlined, schema)
    key = ["page_id", "entry_id"]
    adds = left.select(*key, F.explode("adds").alias("sequence")).join(known.drop("op", "parent_entry_id"), [*key, "sequence"])
    text = lambda c: F.coalesce(F.min_by(c, "sequence"), F.lit("")).alias(c)
    named = adds.groupBy(*key).agg(text("name"), text("definition"))
    out = left.drop("adds").join(named, key)
    lists = {**{c: F.col(c) for c in BROUGHT}, "slugs": F.array("slug"), "operations": F.array("operation_id")}
    for name, column in lists.items():
        each = adds.select(*key, "sequence", F.posexplode(column).alias("at", "value")).filter(F.col("value").isNotNull())
        if name in ("slugs", "operations"):
            each = each.filter(F.col("value").cast("string") != "")
        first = each.groupBy(*key, "value").agg(F.min(F.struct("sequence", "at")).alias("first"))
        ordered = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("x"))
        out = out.join(ordered.select(*key, F.transform("x", lambda x: x["value"]).alias(name)), key, "left")
    kinds = dict(out.dtypes)
    arrays = [F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in ("refs", "evidence_claim_ids", "slugs", "aliases", "tags", "operations")]
    return out.select(*key, "name", "definition", "parent_entry_id", *arrays)


def anchored_items(items: DataFrame, blocks: DataFrame, most: int = 3) -> DataFrame:
    """Rows (document_id, kind, number, text, anchors, unknown) of items of notes (document_id, kind, note, place, text, refs).

    Items of a document and kind are numbered from 1 in reading order (note, place, then text). Anchors are the first most different
    references that are blocks (document_id, block_id) of the document, in the order cited; unknown are those that are not.
    """
    order = F.row_number().over(Window.partitionBy("document_id", "kind").orderBy("note", "place", "text"))
    numbered = items.withColumn("number", order)
    key = ["document_id", "kind", "number"]
    cited = numbered.select(*key, F.posexplode(F.array_distinct("refs")).alias("at", "block_id"))
    known = blocks.select("document_id", "block_id").distinct().withColumn("known", F.lit(True))
    at = F.struct("at", "block_id")
    checked = cited.join(known, ["document_id", "block_id"], "left").groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(F.col("known"), at))).alias("good"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), at))).alias("bad")
    )
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x["block_id"]), F.array().cast("array<string>"))
    return numbered.join(checked, key, "left").select(*key, "text", F.slice(ids("good"), 1, most).alias("anchors"), ids("bad").alias("unknown"))
