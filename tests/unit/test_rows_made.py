"""Joins on few keys: right results, and no step makes a row for each pair of rows that share a key."""

import random

import pytest

from docloom.operators import answering as an
from docloom.operators import assignment as ag
from docloom.operators import concepts as cs
from docloom.operators import mixing
from docloom.operators import units as un
from docloom.operators.retrieval import _hybrid, concept_candidates


def most_rows(spark, run):
    """(what run returns, the most rows that a node of any plan gave while it ran)."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = run()
    bus.waitUntilEmpty(30_000)
    most, runs = 0, store.executionsList(before, 1000)
    for i in range(runs.size()):
        values, nodes = store.executionMetrics(runs.apply(i).executionId()), store.planGraph(runs.apply(i).executionId()).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size()):
                found = values.get(metrics.apply(k).accumulatorId())
                if metrics.apply(k).name() == "number of output rows" and found.isDefined():
                    most = max(most, int(found.get().replace(",", "")))
    return out, most


def test_attached_units(spark):
    rng = random.Random(1)
    some = lambda: rng.sample(["B1", "B2", "B3", "B4"], rng.randint(0, 4)) + ["B1"] * rng.randint(0, 1)
    units, entries = [(rng.randint(0, 3), f"u{i}", some()) for i in range(80)] + [(0, "n", None), (0, "m", ["B1", None])], [(rng.randint(0, 3), i, some()) for i in range(20)] + [(3, 90, ["B9"]), (3, 90, ["B9"]), (1, 91, None)]
    units += [(3, "v", ["B9"]), (3, "w", ["B9", "B8"])]
    want = {}
    for page, unit, refs in units:
        fit = [e for p, e, held in entries if p == page and refs and None not in refs and set(refs) <= set(held or [])]
        want[unit] = fit[0] if len(fit) == 1 else None
    frames = spark.createDataFrame(units, "page_id int, unit_id string, block_refs array<string>"), spark.createDataFrame(entries, "page_id int, entry_id int, block_refs array<string>")
    got = un.attached_units(*frames).collect()
    assert len(got) == len(units) and {r.unit_id: r.entry_id for r in got} == want and any(want.values())
    same = lambda name: spark.range(300).selectExpr("1 AS page_id", f"id AS {name}", "array('B1', 'B2') AS block_refs")
    got, most = most_rows(spark, lambda: un.attached_units(same("unit_id"), same("entry_id")).collect())
    assert len(got) == 300 and most < 3000  # of 90,000 pairs


def test_split_aliases(spark):
    rng = random.Random(2)
    aliases, titles = ([(rng.randint(0, 9), rng.randint(0, 6)) for _ in range(40)] + [(1, None), (None, 2)] for _ in range(2))
    pairs = {(s, k, o) for s, k in aliases for o, t in titles if k == t and None not in (s, k, o) and s != o}
    want = {(s, k, o) for s, k, o in pairs if not any((o, s) == (x, z) for x, _, z in pairs)}
    frame = lambda rows: spark.createDataFrame(rows, "slug int, key int")
    got = [tuple(r) for r in cs.split_aliases(frame(aliases), frame(titles)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    few = spark.range(400).selectExpr("id AS slug", "id % 2 AS key")
    # Here all pairs are mutual; none goes from step to step.
    got, most = most_rows(spark, lambda: cs.split_aliases(few, few).collect())
    assert not got and most < 2000 < 80_000


def test_slugs_of_shared_keys(spark):
    concepts = spark.range(300).selectExpr("1 AS workspace_id", "concat('c', id) AS slug", "id AS place", "array('k', concat('j', id % 3)) AS keys")
    index = spark.range(300).selectExpr("1 AS workspace_id", "concat('x', id) AS slug", "'active' AS status", "array('k') AS keys")
    got, most = most_rows(spark, lambda: ag.allocated_slugs(concepts, index).collect())
    assert {(r.slug, r.allocated) for r in got} == {(f"c{i}", f"c{i}") for i in range(300)} and most < 5000  # of 90,000 pairs
    # One hit by two keys is one; two are none; a deleted one counts only without an active one; the first place gets it.
    known = [(1, "a", "active", ["p", "q"]), (1, "b", "active", ["r"]), (1, "c", "deleted", ["s"]), (1, "d", "deleted", ["r"]), (1, None, "active", ["t"]), (1, "e", "draft", ["s"])]
    asked = [(1, "u", 1, ["p", "q"]), (1, "v", 2, ["p", "r"]), (1, "w", 3, ["s"]), (1, "x", 0, ["s"]), (1, "y", 5, ["r"]), (1, "z", 6, ["t", "s"])] + [(1, "n", i, []) for i in range(12)] * 2
    got = ag.allocated_slugs(spark.createDataFrame(asked, "workspace_id int, slug string, place int, keys array<string>"), spark.createDataFrame(known, "workspace_id int, slug string, status string, keys array<string>")).collect()
    assert {(r.slug, r.place): r.allocated for r in got} == {("u", 1): "a", ("v", 2): "v", ("w", 3): "w", ("x", 0): "c", ("y", 5): "b", ("z", 6): "z", ("n", 0): "n"} | {("n", i): f"n-{i + 1}" for i in range(1, 9)} | {("n", i): None for i in range(9, 12)}
    assert len(got) == 18


def test_walk_by_a_column_scores_what_it_meets(spark, tmp_path):
    from docloom.plans.answering import _walk, gr4_stops, gr4_walk_paths, gr5_answer_paths

    n, suppliers = 2000, 300
    spark.range(n).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).selectExpr("id AS o_orderkey", "id * 37 % 2000 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(suppliers).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    for query in (gr4_stops, gr4_walk_paths, gr5_answer_paths):
        _, most = most_rows(spark, lambda query=query: query(spark, str(tmp_path)).collect())
        assert most < 60_000 < n * suppliers
    seeds, links, score, pages = _walk(spark, str(tmp_path))
    queries = seeds.select("query_id").distinct()
    every = queries.crossJoin(pages).withColumn("score", score)
    by_column, by_table = an.scored_walk(seeds, links, score, pages=pages), an.scored_walk(seeds, links, every)
    for a, b in zip(by_column, by_table, strict=True):
        a, b = (sorted(map(str, x.collect())) for x in (a, b))
        assert a == b and a


@pytest.mark.parametrize("small", [False, True])
def test_mixed_top_equals_pairs(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(mixing, "QUERY_ROWS", 4)
        monkeypatch.setattr(mixing, "ITEM_ROWS", 7)
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["fox", "hen", "사과는", "dog", "x1", "cat"]) for _ in range(rng.randint(0, 9)))
    vector = lambda: rng.choice([None, [1.0], [float("nan"), 1.0]]) if rng.random() < 0.3 else [rng.random(), rng.random() / 2]
    items = [(rng.choice("ab"), i, text() if i % 9 else None, vector()) for i in range(60)]
    queries = [(i, rng.choice("abc"), text() if i else "zebra", vector()) for i in range(14)]
    items, queries = spark.createDataFrame(items, "workspace_id string, item long, text string, v array<double>"), spark.createDataFrame(queries, "query_id long, workspace_id string, question string, asked array<double>")
    got, want = (sorted(map(tuple, f(queries, items, 5, 0.75).select("query_id", "rank", "item", "score").collect())) for f in (mixing.mixed_top, _hybrid))
    assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want]) and len(got) > 20


def test_concepts_of_shared_words(spark):
    rows = spark.range(200).selectExpr("'w' AS workspace_id", "id AS slug", "'t' AS title", "array('') AS aliases", "array('') AS tags", "concat_ws(' ', transform(sequence(1, 30), i -> concat('word', i + id % 3))) AS definition", "array(1.0D, double(id)) AS v")
    got, most = most_rows(spark, lambda: concept_candidates(rows, rows, 3).collect())
    assert len(got) == 600 and most < 20_000  # 40,000 pairs share some 30 words each
