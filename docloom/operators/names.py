"""Names in texts and names against names: many patterns at once by an automaton with failure links.

The names of a key (a document, a workspace) are built into automata of at most NAME_ROWS names and its texts are streamed through them in parts of
TEXT_ROWS, so a text is read once for all names of a part and no pair of a name and a text is ever tried.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import keywords, lower_each, raw_tokens, retrieval_query, without_particle

NAME_ROWS, TEXT_ROWS = 50_000, 4096
#: Tokens of a question that are no names.
QUESTION_WORDS = ["뭐", "뭐야", "무엇", "어떻게", "왜", "차이", "설명", "알려줘", "what", "is", "are", "the", "a", "an"]
#: Scores of an equal and of a contained name, the floors they lift a page's score to, focus and limits.
EQUAL, HELD, EQUAL_FLOOR, HELD_FLOOR = 1.0, 0.85, 0.95, 0.88
FOCUS_LEAST, FOCUS_MARGIN, MOST_CONCEPTS = 0.45, 0.001, 10


def _match(keys: list[str], kinds: list[pa.DataType], id_type: pa.DataType):
    names_out = [*keys, "name", "text_id"]

    def run(names: pa.Table, texts: pa.Table) -> pa.Table:
        import ahocorasick

        schema = pa.schema(list(zip(names_out, [*kinds, pa.string(), id_type])))
        if not names.num_rows or not texts.num_rows:
            return schema.empty_table()
        own, found = names.column("name").to_pylist(), ahocorasick.Automaton()
        for i, name in enumerate(own):
            found.add_word(name, i)
        found.make_automaton()
        hits = [(i, row) for row, text in enumerate(texts.column("text").to_pylist()) for i in {i for _, i in found.iter(text)}]
        rows = pa.array([row for _, row in hits], pa.int64())
        columns = [texts.column(f"{k}_t").take(rows) for k in keys] + [pa.chunked_array([pa.array([own[i] for i, _ in hits], pa.string())]), texts.column("text_id").take(rows)]
        return pa.table(columns, schema=schema)

    return run


def names_held(names: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys..., name, text_id): the names (keys..., name) that each text (keys..., text_id, text) of their key holds. Empty and null names and texts
    match nothing; repeated names and texts give repeated rows once."""
    own = names.filter("name <> ''").select(*keys, "name").distinct()
    given = texts.filter("text <> ''").select(*keys, "text_id", "text")
    count = lambda df, by, most, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    grid = count(own, keys, NAME_ROWS, "nps").join(count(given, keys, TEXT_ROWS, "tps"), keys)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, of: F.pmod(F.xxhash64(*of), F.col(c)).cast("int")
    left = own.join(grid, keys).withColumn("np", part("nps", ["name"])).withColumn("tp", every("tps"))
    right = given.join(grid, keys).withColumn("tp", part("tps", ["text_id"])).withColumn("np", every("nps"))
    group = [*keys, "np", "tp"]
    right = right.select(*[F.col(c).alias(f"{c}_t") for c in group], "text_id", "text")
    fields = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    arrow = lambda k: {"bigint": pa.int64(), "int": pa.int32()}.get(k, pa.string())
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + f", name string, text_id {fields['text_id']}"
    match = _match(keys, [arrow(fields[k]) for k in keys], arrow(fields["text_id"]))
    return left.select(*group, "name").groupBy(*group).cogroup(right.groupBy(*[f"{c}_t" for c in group])).applyInArrow(match, schema).distinct()


def expanded_mentions(concepts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (document_id, slug, block_refs, mention_count, importance): the blocks of a concept's document that hold its title or an alias,
    without regard to case; each adds a quarter to the importance. concepts: document_id, slug, names, importance."""
    names = concepts.select("document_id", "slug", F.explode("names").alias("name")).select("document_id", "slug", lower_each(F.trim("name")).alias("name"))
    hits = names_held(names, blocks.select("document_id", F.col("block_id").alias("text_id"), lower_each(F.col("text")).alias("text")), ["document_id"])
    found = names.join(hits, ["document_id", "name"]).groupBy("document_id", "slug").agg(F.array_sort(F.collect_set("text_id")).alias("block_refs"))
    joined = concepts.select("document_id", "slug", "importance").join(found, ["document_id", "slug"], "left")
    refs = F.coalesce("block_refs", F.array().cast("array<string>"))
    return joined.select("document_id", "slug", refs.alias("block_refs"), F.size(refs).alias("mention_count"), (F.col("importance") + 0.25 * F.size(refs)).alias("importance"))


def plain_name(name: Column) -> Column:
    """A name in lower case without what stands in parentheses, of letters and digits alone; Hangul ones without their particle."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"\([^)]*\)", ""), "[^a-z0-9가-힣]+", "")
    return F.when(F.rlike(plain, F.lit("[가-힣]")), without_particle(plain)).otherwise(plain)


def query_names(queries: DataFrame) -> DataFrame:
    """Rows (workspace_id, query_id, name): the tokens of a question, of its retrieval query and of its keywords as plain names."""
    q = F.col("question")
    found = F.array_distinct(F.transform(F.concat(raw_tokens(q), raw_tokens(retrieval_query(q)), raw_tokens(F.array_join(keywords(q), " "))), plain_name))
    return queries.select("workspace_id", "query_id", F.explode(found).alias("name")).filter((F.col("name") != "") & ~F.col("name").isin(QUESTION_WORDS))


def aliases_of(markdown: Column) -> Column:
    """The comma-separated names of the sections named Aliases."""
    bodies = F.regexp_extract_all(markdown, F.lit(r"(?im)^[ \t]*##[ \t]+aliases[ \t]*$((?:\n(?![ \t]*##[ \t]+\S).*+)*+)"), F.lit(1))
    lines = F.transform(F.flatten(F.transform(bodies, lambda b: F.split(b, "\n"))), lambda x: F.regexp_replace(F.trim(x), "^- ", ""))
    return F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda x: F.trim(x)), lambda x: ~x.isin("", "-"))


def page_names(pages: DataFrame) -> DataFrame:
    """Rows (workspace_id, page_id, page_type, name): a page's title, slug and aliases as plain names."""
    every = F.concat(F.array("title", "slug"), F.coalesce(aliases_of(F.col("markdown")), F.array().cast("array<string>")))
    names = F.array_distinct(F.transform(F.filter(every, lambda x: x.isNotNull()), plain_name))
    return pages.select("workspace_id", "page_id", "page_type", F.explode(names).alias("name")).filter("name <> ''")


def name_match(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (query_id, page_id, score): 1 where a name of the query is one of the page, 0.85 where one holds the other
    and both have two characters or more (concepts only).

    asked: workspace_id, query_id, name; names: workspace_id, page_id, page_type, name. Equal names are an equi-join; for the rest the distinct
    names of either side run through automata of the other side's.
    """
    exact = asked.join(names.drop("page_type"), ["workspace_id", "name"]).select("query_id", "page_id", F.lit(EQUAL).alias("score"))
    concepts = names.filter("page_type = 'concept' AND length(name) >= 2")
    short, long = asked.filter("length(name) >= 2"), concepts
    distinct = lambda df: df.select("workspace_id", "name").distinct()
    texts = lambda df: distinct(df).select("workspace_id", F.col("name").alias("text_id"), F.col("name").alias("text"))
    held = names_held(distinct(short), texts(long), ["workspace_id"]).toDF("workspace_id", "asked", "name")
    holds = names_held(distinct(long), texts(short), ["workspace_id"]).toDF("workspace_id", "name", "asked").select("workspace_id", "asked", "name")
    pairs = held.union(holds).distinct()
    part = pairs.join(asked.withColumnRenamed("name", "asked"), ["workspace_id", "asked"]).join(concepts, ["workspace_id", "name"])
    return exact.union(part.select("query_id", "page_id", F.lit(HELD).alias("score"))).groupBy("query_id", "page_id").agg(F.max("score").alias("score"))


def with_name_floors(scored: DataFrame, matches: DataFrame) -> DataFrame:
    """scored (query_id, page_id, score) with scores lifted by the pages' name matches."""
    lifted = F.when(F.col("name") >= EQUAL, F.greatest("score", F.lit(EQUAL_FLOOR))).when(F.col("name") >= HELD, F.greatest("score", F.lit(HELD_FLOOR))).otherwise(F.col("score"))
    return scored.join(matches.withColumnRenamed("score", "name"), ["query_id", "page_id"], "left").withColumn("score", lifted).drop("name")


def focus_concepts(scored: DataFrame) -> DataFrame:
    """Rows (query_id, page_id, rank): concepts within FOCUS_MARGIN of the query's best one, if that reaches FOCUS_LEAST; ties by page."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page_id"))
    near = scored.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).filter((F.col("top") + 1e-9 >= FOCUS_LEAST) & (F.col("score") >= F.col("top") - FOCUS_MARGIN))
    return near.withColumn("rank", place).filter(F.col("rank") <= MOST_CONCEPTS).select("query_id", "page_id", "rank")


def direct_matches(matches: DataFrame, concepts: DataFrame) -> DataFrame:
    """Rows (query_id, page_id, rank): the first concepts (page_id) whose name the query has."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("page_id"))
    found = matches.filter(F.col("score") >= EQUAL).join(concepts.select("page_id").distinct(), "page_id", "left_semi")
    return found.withColumn("rank", place).filter(F.col("rank") <= MOST_CONCEPTS).select("query_id", "page_id", "rank")
