"""What is to be embedded, ranks of gold documents, routing; and the fill of a budget."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from docloom.operators import evaluation as E
from docloom.operators.units import within_budget


def test_what_is_to_be_embedded(spark):
    pages = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3"), ("d", None)], "page_id string, representation_hash string")
    vectors = spark.createDataFrame([("a", "h1", "completed"), ("b", "old", "completed"), ("c", "h3", "failed"), ("d", None, "completed")], "page_id string, representation_hash string, status string")
    assert sorted(r.page_id for r in E.to_embed(pages, vectors).collect()) == ["b", "c"]
    units = spark.createDataFrame([("w", "m", "x"), ("w", "m", "x"), ("w", "n", "x"), ("w", "m", "y"), ("v", "m", "x"), ("v", "m", "z")], "workspace_id string, embedding_model string, representation_hash string")
    known = spark.createDataFrame([("m", "x", "failed"), ("m", "x", "completed"), ("m", "y", "failed")], "embedding_model string, representation_hash string, status string")
    got = {r.workspace_id: (r.units, r.texts, r.skipped, r.failed, r.to_embed) for r in E.embedding_counts(units, known).collect()}
    assert got == {"w": (4, 3, 1, 1, 2), "v": (2, 2, 1, 0, 1)}


def test_gold_ranks(spark):
    cases = spark.createDataFrame([(1, "red fox"), (2, "blue"), (3, "none")], "query_id int, question string")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 7), (3, 10, 1)], "query_id int, doc_id int, rank int")
    docs = spark.createDataFrame([(10, "the blue one"), (11, "a red fox here"), (12, "red fox")], "doc_id int, flat string")
    ranks = E.gold_ranks(cases, ranked, docs, F.col("question"))
    assert {r.query_id: (r.gold_rank, r.reciprocal) for r in ranks.collect()} == {1: (2, 0.5), 2: (7, 1 / 7), 3: (None, 0.0)}
    (row,) = E.gold_summary(ranks).collect()
    assert (row.cases, row.found, row.within_1, row.within_5, row.within_10) == (3, 2, 0, 1, 2) and abs(row.mean_reciprocal - (0.5 + 1 / 7) / 3) < 1e-12


def test_routing(spark):
    rows = [("read", "read", None), ("read", "edit", ["edit"]), ("read", "edit", []), ("edit", None, ["read"]), ("edit", "read", None)]
    cases = spark.createDataFrame(rows, "expected string, actual string, acceptable array<string>")
    (row,) = E.routing_summary(cases, ("edit",)).collect()
    assert tuple(row) == (5, 1, 2, 1, 1)
    assert {(r.expected, r.actual): (r.n, r.accepted) for r in E.routing_matrix(cases).collect()} == {("read", "read"): (1, 1), ("read", "edit"): (2, 1), ("edit", None): (1, 0), ("edit", "read"): (1, 0)}


def test_a_budget_is_filled_as_one_by_one(spark):
    rnd = random.Random(8)
    rows = [(w, i, rnd.choice([0.1, 0.5, 0.5, 0.9]), "x" * rnd.choice([0, 1, 2, 3, 3, 7, 30, 80])) for w in ("a", "b") for i in range(150)]
    want = []
    for w in ("a", "b"):
        used = 0
        for _, i, score, text in sorted((r for r in rows if r[0] == w and r[3]), key=lambda r: (-r[2], r[1])):
            left = 60 - used - 2
            chars = left if len(text) > 60 else len(text)
            if 0 < chars <= left:
                want.append((w, i, chars))
                used += chars + 2
    got = within_budget(spark.createDataFrame(rows, "workspace_id string, item_id int, score double, text string"), budget=60)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_alignment_spread_and_heads(spark):
    rows = [
        ("a", "d", 1, "Pod (Kubernetes)", ["Container Group"]), ("a", "d", 2, "Pod-Lifecycle", None), ("a", "e", 3, "Straße", []), ("a", "e", 4, "--", ["?"]),
        ("b", "d", 1, "POD", []), ("b", "d", 2, "container_group", [None]), ("b", "d", 3, "Kubernetes", []), ("c", "f", 1, "strasse", []),
    ]
    concepts = spark.createDataFrame(rows, "run string, document_id string, concept_id int, title string, aliases array<string>")
    got = {(r.run, r.other): (r.concepts, r.aligned, r.share) for r in E.alignment(concepts).collect()}
    assert got == {("a", "b"): (4, 1, 0.25), ("b", "a"): (3, 2, 0.667), ("a", "c"): (4, 1, 0.25), ("c", "a"): (1, 1, 1.0), ("b", "c"): (3, 0, 0.0), ("c", "b"): (1, 0, 0.0)}
    spread = {r.document_id: (r.least, r.most, r.spread) for r in E.page_spread(concepts.withColumnRenamed("concept_id", "page_id")).collect()}
    assert spread == {"d": (0, 3, 3), "e": (0, 2, 2), "f": (0, 1, 1)}
    more = concepts.union(spark.createDataFrame([("b", "d", 9, "Limits (Pod)", [])], concepts.schema))
    assert [(r.run, r.document_id, r["head"], r.titles) for r in E.head_groups(more).collect()] == [("b", "d", "pod", ["Limits (Pod)", "POD"])]
