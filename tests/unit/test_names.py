"""Names in texts and names against names, against plain loops."""

from __future__ import annotations

import random

import pytest

from docloom.operators import names as N


@pytest.mark.parametrize("small", [False, True])
def test_names_held(spark, monkeypatch, small):
    if small:  # many automata and many parts
        monkeypatch.setattr(N, "NAME_ROWS", 5)
        monkeypatch.setattr(N, "TEXT_ROWS", 4)
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("ab가 ") for _ in range(rnd.randint(0, n)))
    names = [(rnd.randint(0, 2), word(4)) for _ in range(60)] + [(0, None), (0, "a"), (0, "a"), (7, "b")]
    texts = [(rnd.randint(0, 3), i, word(30)) for i in range(50)] + [(0, 90, None), (0, 91, ""), (8, 92, "a")]
    got = N.names_held(spark.createDataFrame(names, "k int, name string"), spark.createDataFrame(texts, "k int, text_id long, text string"), ["k"])
    want = {(k, n, i) for k, n in names for j, i, t in texts if k == j and n and t and n in t}
    rows = [(r.k, r.name, r.text_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_mentions(spark):
    concepts = spark.createDataFrame([("d", "s1", ["Fox ", "", None], 1.0), ("d", "s2", ["hen", "FOX"], 0.0), ("e", "s1", ["fox"], 2.0), ("d", "s3", [], 0.5)], "document_id string, slug string, names array<string>, importance double")
    blocks = spark.createDataFrame([("d", "B1", "A fOx."), ("d", "B2", "the hens"), ("d", "B3", None), ("e", "B1", "none")], "document_id string, block_id string, text string")
    got = {(r.document_id, r.slug): (r.block_refs, r.mention_count, r.importance) for r in N.expanded_mentions(concepts, blocks).collect()}
    assert got == {("d", "s1"): (["B1"], 1, 1.25), ("d", "s2"): (["B1", "B2"], 2, 0.5), ("e", "s1"): ([], 0, 2.0), ("d", "s3"): ([], 0, 0.5)}


def test_mentions_of_letters_with_uneven_cases(spark, tmp_path):
    from docloom.plans.resolving import er5_mentions

    turns = [(1, 0, "Berß und so weiter"), (1, 1, "die bERß steht"), (1, 2, "ﬁn İa ΟΔΟΣ ΟΔΟΣ"), (1, 3, "x οδοσα FIN"), (1, 4, "ﬁn")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in turns], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.slug: r.block_refs for r in er5_mentions(spark, str(tmp_path)).collect()}
    assert got == {"c0": "B0,B1", "c1": "B1", "c2": "B2,B3,B4", "c3": "B3", "c4": "B2,B4"}


def test_variants_and_scores(spark):
    markdown = "# P\n##  Aliases \n- 코끼리는, Big Cat\n-\n\n## More\n- no\n## aliases\nthird (x), -\n### deep"
    pages = spark.createDataFrame(
        [("w", "p1", "concept", "Fox (animal)", "red-fox", markdown), ("w", "p2", "source", "Foxes", "s-2", None), ("w", "p3", "concept", "X", "zz", ""), ("v", "p4", "concept", "fox", "f", "")],
        "workspace_id string, page_id string, page_type string, title string, slug string, markdown string",
    )
    names = N.page_names(pages)
    assert sorted(r.name for r in names.filter("page_id = 'p1'").collect()) == ["bigcat", "deep", "fox", "redfox", "third", "코끼리"]
    queries = spark.createDataFrame([("w", "q1", "What is the FOX?"), ("w", "q2", "코끼리가 x"), ("w", "q3", "foxesandmore"), ("w", "q4", "the a")], "workspace_id string, query_id string, question string")
    asked = N.query_names(queries)
    assert sorted((r.query_id, r.name) for r in asked.collect()) == [("q1", "fox"), ("q2", "x"), ("q2", "코끼리"), ("q3", "foxesandmore")]
    matches = N.name_match(asked, names)
    got = sorted((r.query_id, r.page_id, r.score) for r in matches.collect())
    assert got == [("q1", "p1", 1.0), ("q2", "p1", 1.0), ("q2", "p3", 1.0), ("q3", "p1", 0.85)]  # x is too short to be held, sources only match whole
    scored = spark.createDataFrame([("q1", "p1", 0.2), ("q1", "p3", 0.4), ("q3", "p1", 0.9), ("q2", "p1", 0.97), ("q2", "p3", 0.9695)], "query_id string, page_id string, score double")
    lifted = N.with_name_floors(scored, matches)
    assert {(r.query_id, r.page_id): r.score for r in lifted.collect()} == {("q1", "p1"): 0.95, ("q1", "p3"): 0.4, ("q3", "p1"): 0.9, ("q2", "p1"): 0.97, ("q2", "p3"): 0.9695}
    assert sorted((r.query_id, r.page_id, r["rank"]) for r in N.focus_concepts(lifted).collect()) == [("q1", "p1", 1), ("q2", "p1", 1), ("q2", "p3", 2), ("q3", "p1", 1)]
    assert N.focus_concepts(scored.filter("score < 0.45")).count() == 0
    assert sorted((r.query_id, r.page_id, r["rank"]) for r in N.direct_matches(matches, pages.filter("page_id <> 'p3'")).collect()) == [("q1", "p1", 1), ("q2", "p1", 1)]
