"""What is to be embedded, and how well retrieval and routing did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.helpers import folded


def to_embed(pages: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pages (page_id, representation_hash) whose representation is not the one of their completed vector (page_id, representation_hash, status),
    or that have none."""
    done = vectors.filter("status = 'completed'").select("page_id", F.col("representation_hash").alias("__done"))
    return pages.join(done, "page_id", "left").filter(~F.col("representation_hash").eqNullSafe(F.col("__done"))).drop("__done")


def embedding_counts(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows (workspace_id, units, texts, skipped, failed, to_embed): of the distinct texts of units (workspace_id, embedding_model, representation_hash)
    those that are embedded already by their model, in any workspace, those that failed before, and all that are to be embedded, failed ones included.

    vectors: embedding_model, representation_hash, status.
    """
    key = ["embedding_model", "representation_hash"]
    known = vectors.groupBy(*key).agg(F.max(F.col("status") == "completed").alias("done"), F.max(F.col("status") == "failed").alias("bad"))
    texts = units.groupBy("workspace_id", *key).agg(F.count("*").alias("n")).join(known, key, "left")
    done = F.coalesce("done", F.lit(False))
    return texts.groupBy("workspace_id").agg(
        F.sum("n").alias("units"), F.count("*").alias("texts"), F.count_if(done).alias("skipped"), F.count_if(~done & F.coalesce("bad", F.lit(False))).alias("failed"), F.count_if(~done).alias("to_embed")
    )


def gold_ranks(cases: DataFrame, ranked: DataFrame, docs: DataFrame, quote: Column) -> DataFrame:
    """Each case (query_id, ...) with gold_rank, the rank of its first document (query_id, doc_id, rank) whose text (doc_id, flat) holds the quote, and reciprocal."""
    hits = ranked.join(cases, "query_id").join(docs, "doc_id").filter(F.contains(F.col("flat"), quote)).groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    return cases.join(hits, "query_id", "left").withColumn("reciprocal", F.coalesce(1 / F.col("gold_rank"), F.lit(0.0)))


def gold_summary(ranks: DataFrame, *keys: str, within: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """By keys the number of cases, of those with a gold document at all and within the first ranks, and the mean reciprocal rank."""
    counts = [F.count_if(F.col("gold_rank") <= n).alias(f"within_{n}") for n in within]
    return ranks.groupBy(*keys).agg(F.count("*").alias("cases"), F.count("gold_rank").alias("found"), *counts, F.avg("reciprocal").alias("mean_reciprocal"))


def routing_matrix(cases: DataFrame) -> DataFrame:
    """Rows (expected, actual, n, accepted): how often each route was taken where another was expected, and how often that was acceptable.

    cases: expected, actual, acceptable (an array of further routes). A case without an answer has failed: actual is null.
    """
    fine = F.coalesce((F.col("expected") == F.col("actual")) | F.array_contains("acceptable", F.col("actual")), F.lit(False))
    return cases.groupBy("expected", "actual").agg(F.count("*").alias("n"), F.count_if(fine).alias("accepted"))


def routing_summary(cases: DataFrame, changing: tuple[str, ...]) -> DataFrame:
    """One row: cases, correct, accepted, failed, and false_changes, the cases that were routed to a change of data though neither expected nor acceptable."""
    right = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    fine = right | F.coalesce(F.array_contains("acceptable", F.col("actual")), F.lit(False))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(right).alias("correct"), F.count_if(fine).alias("accepted"), F.count_if(F.col("actual").isNull()).alias("failed"),
        F.count_if(F.coalesce(F.col("actual").isin(list(changing)), F.lit(False)) & ~fine).alias("false_changes"),
    )


def _keyed(rows: DataFrame, values: Column) -> DataFrame:
    """rows once for each different key of an array of names: letters and digits alone, without case."""
    each = rows.withColumn("__name", F.explode(values)).withColumn("key", F.regexp_replace(folded("__name"), r"(?U)[\W_]+", ""))
    return each.filter("key <> ''").drop("__name").distinct()


def concept_names(concepts: DataFrame) -> DataFrame:
    """Rows (run, concept_id, key): the names by which concepts (run, concept_id, title, aliases) are compared: title and aliases, with and without what stands
    in parentheses."""
    raw = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = F.concat(raw, F.transform(raw, lambda n: F.regexp_replace(n, r"\(.*?\)", "")))
    return _keyed(concepts.select("run", "concept_id", F.filter(every, lambda n: n.isNotNull()).alias("names")), F.col("names")).select("run", "concept_id", "key").distinct()


def alignment(concepts: DataFrame) -> DataFrame:
    """Rows (run, other, concepts, aligned, share) for all ordered pairs of runs: how many of a run's concepts share a name with one of the other.

    Names meet in an equi-join; a name that many concepts have is one row of each run on the other side.
    """
    names = concept_names(concepts)
    there = names.select(F.col("run").alias("other"), "key").distinct()
    found = names.join(there, "key").filter(F.col("run") != F.col("other")).select("run", "concept_id", "other").distinct()
    counts = concepts.select("run", "concept_id").distinct().groupBy("run").agg(F.count("*").alias("concepts"))
    runs = counts.agg(F.collect_set("run").alias("runs"))  # as many as there are runs
    pairs = counts.join(F.broadcast(runs)).select("run", "concepts", F.explode("runs").alias("other")).filter(F.col("run") != F.col("other"))
    hits = found.groupBy("run", "other").agg(F.count("*").alias("aligned"))
    out = pairs.join(hits, ["run", "other"], "left").withColumn("aligned", F.coalesce("aligned", F.lit(0).cast("long")))
    return out.select("run", "other", "concepts", "aligned", F.round(F.col("aligned") / F.col("concepts"), 3).alias("share"))


def page_spread(pages: DataFrame) -> DataFrame:
    """Rows (document_id, least, most, spread) of pages (run, document_id, page_id): the numbers of pages over all runs, 0 where a run has none."""
    runs = pages.select("run").distinct().count()
    counts = pages.groupBy("document_id", "run").agg(F.count("*").alias("n"))
    some = counts.groupBy("document_id").agg(F.min("n").alias("low"), F.max("n").alias("most"), F.count("*").alias("k"))
    least = F.when(F.col("k") < runs, F.lit(0).cast("long")).otherwise(F.col("low"))
    return some.select("document_id", least.alias("least"), "most", (F.col("most") - least).alias("spread"))


def head_groups(concepts: DataFrame) -> DataFrame:
    """Rows (run, document_id, head, titles): heads that several concepts (run, document_id, concept_id, title) of a document have, titles sorted. A title's
    heads are its first word and what stands in parentheses."""
    words = F.concat(F.slice(F.split(F.trim("title"), r"\s+"), 1, 1), F.regexp_extract_all("title", F.lit(r"\((.*?)\)"), F.lit(1)))
    keyed = _keyed(concepts.select("run", "document_id", "concept_id", "title"), words)
    groups = keyed.groupBy("run", "document_id", F.col("key").alias("head")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    return groups.filter("size(titles) > 1")
