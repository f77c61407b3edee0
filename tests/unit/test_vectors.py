"""The vector index against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import vectors as V
from docloom.operators.retrieval import concept_candidates, semantic_pages
from docloom.operators.search import bm25


def six(x):
    return np.floor(x * 1e6 + 0.5) / 1e6


def brute(queries, rows, k, weight=None):
    """(query_id, item, score, rank) by all pairs; queries: (id, space, vector), rows: (space, item, vector)."""
    fine = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q, space, asked in queries:
        best = {}
        for s, item, v in rows:
            if s == space:
                ok = fine(v) and fine(asked) and len(v) == len(asked)
                score = float(six(min(1.0, max(0.0, float(np.dot(asked, v)))))) if ok else 0.0
                best[item] = max(score, best.get(item, 0.0))
        ranked = sorted(best.items(), key=lambda x: (-six((weight or {}).get(q, 1.0) * x[1]), x[0]))[:k]
        out += [(q, item, score, r) for r, (item, score) in enumerate(ranked, 1)]
    return sorted(out)


def clustered(seed, n, dim=8):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (15, dim))
    x = centres[rnd.integers(0, 15, n)] + rnd.normal(0, 0.05, (n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL_ROWS", 20), ("PART_ROWS", 90), ("CHUNK_ROWS", 40), ("QUERY_ROWS", 7)):
        monkeypatch.setattr(V, name, value)


def test_equals_all_pairs_and_looks_at_less(spark, small):
    points = clustered(1, 600)
    rows = [("a" if i % 3 else "b", i, v) for i, v in enumerate(points)]
    rows += [("a", 1000 + i, points[1]) for i in range(150)]  # copies beyond a chunk
    rows += [("a", 5, None), ("a", 2000, None), ("a", -7, [float("nan")] * 8), ("b", 2001, [0.5, 0.5]), ("b", 2002, []), ("c", 1, None), ("a", 3, points[9])]
    queries = [(i, "a" if i % 2 else "b", points[i]) for i in range(0, 120, 3)] + [(500, "a", None), (501, "c", points[0]), (502, "b", [1.0, 0.0]), (503, "none", points[0]), (504, "a", [-x for x in points[2]])]
    table = spark.createDataFrame(rows, "space string, item long, v array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, space string, asked array<double>")
    index = V.VectorIndex(table, ["space"])
    assert index.cells.groupBy("space", "dim", "cell", "chunk").count().agg(F.max("count")).first()[0] < 80
    for k in (1, 7, 30):
        found, looked = index.search(asked, k)
        assert sorted((r.query_id, r.item, r.score, r["rank"]) for r in found.collect()) == brute(queries, rows, k)
        if k == 7:
            per_query = looked.filter("query_id < 500").groupBy("query_id").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0]
            assert per_query < 0.5 * 400, "rows scored for a query, of 200 and 550 in its space"


def test_weights_and_empty_tables(spark, small):
    rnd = random.Random(4)
    rows = [("a", f"i{i:03}", [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(120)]
    queries = [(f"q{i}", "a", [rnd.uniform(-1, 1) for _ in range(3)], [0.0, 0.6, 0.9][i % 3]) for i in range(12)]
    table = spark.createDataFrame(rows, "space string, item string, v array<float>")
    asked = spark.createDataFrame(queries, "query_id string, space string, asked array<float>, weight double")
    rows = [(s, i, np.float32(v).astype(float).tolist()) for s, i, v in rows]
    plain = [(q, s, np.float32(v).astype(float).tolist()) for q, s, v, _ in queries]
    index = V.VectorIndex(table, ["space"])
    found, _ = index.search(asked, 5)
    assert sorted((r.query_id, r.item, r.score, r["rank"]) for r in found.collect()) == brute(plain, rows, 5, {q: w for q, _, _, w in queries})
    assert index.search(asked.limit(0), 5)[0].count() == 0
    assert V.VectorIndex(table.limit(0), ["space"]).search(asked, 5)[0].count() == 0


@pytest.mark.parametrize("k", [1, 6, 40])
def test_hybrid_equals_all_pairs(spark, small, k):
    rnd = random.Random(k)
    points = clustered(k, 150)
    rows = [("a", i, v if i % 11 else None) for i, v in enumerate(points)]
    queries = [(i, "a", points[i + 3], [0.6, 0.75, 0.9][i % 3]) for i in range(10)] + [(99, "a", None, 0.75)]
    text = [(q, i, rnd.random()) for q, *_ in queries for i in rnd.sample(range(150), 40)]
    table = spark.createDataFrame(rows, "workspace_id string, item long, v array<double>")
    asked = spark.createDataFrame(queries, "query_id long, workspace_id string, asked array<double>, weight double")
    scores = spark.createDataFrame(text, "query_id long, item long, text double")
    got = V.hybrid_top(asked, scores, table, V.VectorIndex(table, ["workspace_id"]), k).collect()
    known, want = {(q, i): t for q, i, t in text}, []
    for q, _, v, w in queries:
        dense = {i: float(six(min(1.0, max(0.0, float(np.dot(v, x)))))) if v and x else 0.0 for _, i, x in rows}
        mixed = sorted((-float(six(w * d + (1 - w) * known.get((q, i), 0.0))), i) for i, d in dense.items())[:k]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(mixed, 1)]
    assert sorted((r.query_id, r.item, r.score, r["rank"]) for r in got) == sorted(want)


def test_pages_by_their_best_unit(spark, small):
    points = clustered(5, 300)
    units = [("w", i % 40, "source" if i % 40 < 15 else "concept", v) for i, v in enumerate(points)]
    queries = [(i, "w", points[i]) for i in range(8)]
    got = semantic_pages(spark.createDataFrame(queries, "query_id long, workspace_id string, asked array<double>"), spark.createDataFrame(units, "workspace_id string, page_id long, page_type string, embedding array<double>"), 4)
    want = []
    for kind in ("source", "concept"):
        want += [(q, kind, i, s, r) for q, i, s, r in brute(queries, [(w, p, v) for w, p, t, v in units if t == kind], 4)]
    assert sorted((r.query_id, r.page_type, r.page_id, r.score, r["rank"]) for r in got.collect()) == sorted(want)


def test_concepts_are_not_their_own_candidates(spark):
    rows = [("w", f"c{i}", f"name {i % 4}", ["x", ""], None, "about a thing" if i != 3 else " ", [1.0, float(i)]) for i in range(9)]
    known = spark.createDataFrame(rows, "workspace_id string, slug string, title string, aliases array<string>, tags array<string>, definition string, v array<double>")
    got = concept_candidates(known, known, 3).collect()
    assert {r.slug for r in got} == {f"c{i}" for i in range(9) if i != 3} and len(got) == 24
    assert all(r.slug != r.candidate and r.candidate != "c3" for r in got)


def test_bm25_counts_documents_without_tokens(spark):
    docs = spark.createDataFrame([("w", 1, "red fox"), ("w", 2, ""), ("w", 3, None), ("w", 4, "red red dog 사과는")], "workspace_id string, doc_id long, text string")
    queries = spark.createDataFrame([("w", 1, "red 사과를")], "workspace_id string, query_id long, question string")
    mean = (2 + 0 + 4) / 3
    term = lambda tf, df, n: np.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))
    raw = {1: term(1, 2, 2), 4: term(2, 2, 4) + term(1, 1, 4)}
    got = {r.doc_id: r.score for r in bm25(queries, docs).collect()}
    assert got == pytest.approx({i: x / raw[4] for i, x in raw.items()})
