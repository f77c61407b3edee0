import random
from collections import defaultdict

from docloom.operators import answering as an
from docloom.operators import assignment as ag
from docloom.operators import lint


def test_slugs_against_one_by_one(spark):
    rng = random.Random(3)
    names = ["a", "a-2", "a-2-3", "b", "untitled"]
    index = [("w", f"a-{n}", "active", [f"k{n}"]) for n in (3, 4)] + [("w", "b", "deleted", ["k9"]), ("w", "c", "deleted", ["k3", "k8"]), ("w", "z", "draft", ["k5"])]
    concepts = [("w", rng.choice(names), i, [f"k{rng.randrange(40)}"]) for i in range(45)]
    taken, assigned, expected = {x[1] for x in index}, set(), {}
    for w, slug, place, keys in concepts:  # reused slugs are taken from the start, so one pass in order is the definition
        found = {s: [x[1] for x in index if x[2] == s and set(keys) & set(x[3])] for s in ("active", "deleted")}
        wish = found["active"] if len(found["active"]) == 1 else found["deleted"] if not found["active"] and len(found["deleted"]) == 1 else []
        tries = [slug] + [f"{slug}-{n}" for n in range(2, 10)]
        free = next((t for t in tries if t != "untitled" and t not in taken | assigned), None)
        expected[place] = wish[0] if wish and wish[0] not in assigned else free
        assigned.add(expected[place])
    got = ag.allocated_slugs(
        spark.createDataFrame(concepts, "workspace_id string, slug string, place int, keys array<string>"), spark.createDataFrame(index, "workspace_id string, slug string, status string, keys array<string>")
    ).collect()
    assert {r.place: r.allocated for r in got} == expected and len(got) == len(concepts) and None in expected.values()


def test_heads_against_one_by_one(spark):
    rng = random.Random(5)
    pairs = {(d, a, b) for d in range(3) for a in range(12) for b in range(12) if a != b and rng.random() < 0.5}
    rows = [(d, a, b, b % 2 == 0, rng.random(), round(rng.uniform(0.85, 1), 4)) for d, a, b in sorted(pairs)]
    near = defaultdict(list)
    for r in rows:
        near[r[0], r[1], r[3]].append(r)
    likely = {r[:3]: r[5] for group in near.values() for r in sorted(group, key=lambda r: (-r[4], r[2]))[:5] if r[5] >= 0.9}
    expected = set()

    def reaches(d, a, b):
        return a == b or any(reaches(d, y, b) for e, x, y in expected if e == d and x == a)

    for (d, a, b), _ in sorted(likely.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (d, b, a) not in likely and not reaches(d, b, a):
            expected.add((d, a, b))
    schema = "document_id int, detail int, head int, is_term boolean, similarity double, probability double"
    got = [(r.document_id, r.detail, r.head) for r in ag.assigned_heads(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted(expected) and len(expected) < len([k for k in likely if (k[0], k[2], k[1]) not in likely])
    assert ag.assigned_heads(spark.createDataFrame([], schema)).count() == 0


def test_replayed_entries(spark):
    log = [  # page, op, operation, entry, parent, name, refs
        ("p", "add", "o1", "a", None, "A", ["B1"]), ("p", "add", "o1", "b", "a", "B", None), ("p", "add", "o2", "a", "b", "other", ["B2", "B1"]), ("p", "add", "o2", "c", "b", "C", []),
        ("p", "move", "o3", "a", "c", None, None), ("p", "remove", "o3", "b", None, None, None), ("p", "revive", "o4", "c", None, None, None), ("p", "remove", "o4", "x", None, None, None),
        ("q", "add", "o1", "a", "gone", "A", None), ("q", "remove", "o1", "a", None, None, None), ("q", "add", "o2", None, None, "no", None),
        ("r", "add", "o1", "a", "b", "A", None), ("r", "add", "o1", "b", "a", "B", None), ("r", "add", "o1", "s", "s", "S", None),
        ("t", "add", "o1", "a", None, "A", ["B1"]), ("t", "add", "o1", "b", "a", "B", ["B2"]), ("t", "remove", "o2", "a", None, None, None), ("t", "revive", "o3", "a", None, None, None),
    ]
    rows = [(p, n, *rest) for n, (p, *rest) in enumerate(log)]
    df = spark.createDataFrame(rows, "page_id string, sequence int, op string, operation_id string, entry_id string, parent_entry_id string, name string, refs array<string>")
    got = {(r.page_id, r.entry_id): (r.name, r.parent_entry_id, r.refs, r.operations) for r in ag.replayed_entries(df).collect()}
    assert got == {
        ("p", "a"): ("A", None, ["B1", "B2"], ["o1", "o2"]), ("p", "c"): ("C", None, [], ["o2"]),  # b is removed with c; c alone comes back and rises
        ("r", "a"): ("A", None, [], ["o1"]), ("r", "b"): ("B", "a", [], ["o1"]), ("r", "s"): ("S", None, [], ["o1"]),  # a cycle opens at its first
        ("t", "a"): ("A", None, ["B1"], ["o1"]), ("t", "b"): ("B", "a", ["B2"], ["o1"]),
    }


def test_replayed_lists_and_older_entries(spark):
    cols = "page_id string, sequence int, op string, operation_id string, entry_id string, parent_entry_id string, name string, definition string, slug string, refs array<string>, evidence_claim_ids array<string>, aliases array<string>, tags array<string>"
    add = lambda n, x, parent, name, d, slug, refs, tags: ("p", n, "add", f"o{n}", x, parent, name, d, slug, refs, [f"c{n}"], [name.lower()], tags)
    step = lambda n, op, x: ("p", n, op, f"o{n}", x, None, None, None, None, None, None, None, None)
    rows = [
        add(1, "a", "", "A", "first", "sa", ["B1"], ["t"]), add(2, "b", "a", "B", None, "", ["B2"], None), add(3, "a", None, "Z", "second", "sa", ["B3", "B1"], ["u", "t"]), add(4, "b", "x", "C", "late", "sb", [], ["t"]),
        step(5, "remove", "a"), add(6, "b", "a", "new", "new", "sn", ["B9"], None), step(7, "revive", "a"), step(8, "unknown", "a"),
    ]
    got = {r.entry_id: r for r in ag.replayed_entries(spark.createDataFrame(rows, cols)).collect()}
    a, b = got["a"], got["b"]
    assert (a.name, a.definition, a.parent_entry_id, a.refs, a.evidence_claim_ids) == ("A", "first", None, ["B1", "B3"], ["c1", "c3"])
    assert (a.slugs, a.aliases, a.tags, a.operations) == (["sa"], ["a", "z"], ["t", "u"], ["o1", "o3"])
    # b comes back with a as it was removed, in place of the one that was added meanwhile.
    assert (b.name, b.definition, b.parent_entry_id, b.refs, b.slugs, b.operations) == ("B", "", "a", ["B2"], ["sb"], ["o2", "o4"])


def test_concept_key_points(spark):
    notes = spark.createDataFrame(
        [(1, 1, " x ", ["B1", "B2"]), (1, 2, "y", ["B2", "B3"]), (1, 3, "x", ["B4"]), (1, 4, "z", ["B3"]), (1, 5, "  ", ["B1"]), (1, 6, "w", []), (2, 1, None, ["B1"])],
        "document_id int, place int, text string, refs array<string>",
    )
    points = ag.key_points(notes)
    assert sorted((r.document_id, r.place, r.text) for r in points.collect()) == [(1, 1, "x"), (1, 2, "y"), (1, 4, "z"), (1, 6, "w")]
    concepts = spark.createDataFrame([(1, "a", ["B2", "B3"]), (1, "b", []), (1, "c", ["B9"]), (2, "d", None)], "document_id int, slug string, refs array<string>")
    got = sorted((r.slug, r.place) for r in ag.concept_key_points(concepts, points).collect())
    assert got == [("a", 1), ("a", 4), ("b", 1), ("b", 4), ("b", 6)]  # y shares B2 with x


def test_walk_stops(spark):
    links = spark.createDataFrame([(i, i + 1, "l") for i in range(6)] + [(0, 2, "l"), (20, 21, "l"), (20, 21, "l"), (40, 40, "l")], "from_page_id int, to_page_id int, link_type string")
    seeds = spark.createDataFrame([(1, 0, 0), (2, 20, 0), (2, 21, 1), (3, 30, 0), (4, 99, 0)], "query_id int, page_id int, place int")
    scores = spark.createDataFrame([(1, p, 1.0 - p / 100) for p in range(7)] + [(2, 20, 0.9), (2, 21, 0.9), (3, 30, 0.5), (3, 40, 0.5)], "query_id int, page_id int, score double")
    paths, nodes, stops = an.scored_walk(seeds, links, scores)
    assert {r.query_id: r.stop_reason for r in stops.collect()} == {1: "max_depth", 2: "relative_score_floor", 3: "no_frontier", 4: "no_relevant_seed"}
    found = sorted((r.query_id, r.nodes) for r in paths.collect())
    # 2 is met from 0 first, and expanded with that path only
    assert found == [(1, [0, 1]), (1, [0, 1, 2]), (1, [0, 2]), (1, [0, 2, 1]), (1, [0, 2, 3]), (1, [0, 2, 3, 4]), (2, [20, 21]), (2, [21, 20])]
    assert {(r.query_id, r.page_id): r.depth for r in nodes.collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 20): 0, (2, 21): 0, (3, 30): 0, (4, 99): 0}


def test_report_and_failures_of_nulls(spark):
    clusters = spark.createDataFrame([("w", 1, "candidate", None, 9), ("w", 2, None, None, None), ("w", 3, "candidate", ["r"], 5)], "workspace_id string, cluster_id int, promotion string, promotion_refs array<string>, n_details int")
    claims = spark.createDataFrame([("w", 3, 1, "t", None, ["x"]), ("w", 2, 1, None, None, None)], "workspace_id string, cluster_id int, claim_id int, text string, decision string, refs array<string>")
    stale = spark.createDataFrame([("w", "x")], "workspace_id string, ref string")
    report = lint.workspace_report(clusters, claims, stale, claims.filter("false"))
    assert sorted((r.cluster_id, r.finding) for r in report.collect()) == [(1, "no_refs"), (3, "needs_review")]
    schema = "document_id string, question string, passed boolean, question_ok boolean, n_contradictions int, gold_hit boolean, missing_claims array<string>, answerable boolean, recall double, alignment double, source_document_id string, block_ids array<string>"
    rows = [("d", "q1", *[None] * 10), ("d", "q2", None, True, None, False, None, None, None, None, None, ["B1"]), ("d", "q3", None, True, 0, None, [], None, None, None, "e", ["B1"]),
            ("d", "q4", False, True, 0, True, [], True, 0.8, None, None, None), ("d", "q5", False, True, 0, True, [], True, 0.8, 0.8, None, None), ("t", "q6", *[None] * 10)]
    units = spark.createDataFrame([("e", ["B1"]), ("f", None)], "source_document_id string, block_refs array<string>")
    got = lint.quality_failures(spark.createDataFrame(rows, schema), spark.createDataFrame([("t",)], "document_id string"), units)
    assert {r.question: r.failure for r in got.collect()} == {"q1": "question", "q2": "not_in_wiki", "q3": "retrieval", "q4": "imprecise"}


def test_anchored_items(spark):
    items = spark.createDataFrame(
        [(1, "e", 1, 1, "b", ["B3", "B9", "B1", "B3", "B2", "B4"]), (1, "e", 0, 5, "a", None), (1, "o", 1, 1, "c", []), (2, "e", 0, 0, None, ["B1", None])],
        "document_id int, kind string, note int, place int, text string, refs array<string>",
    )
    blocks = spark.createDataFrame([(1, f"B{i}") for i in (1, 2, 3, 4, 4)], "document_id int, block_id string")
    got = {(r.document_id, r.kind, r.number): (r.text, r.anchors, r.unknown) for r in ag.anchored_items(items, blocks).collect()}
    assert got == {(1, "e", 1): ("a", [], []), (1, "e", 2): ("b", ["B3", "B1", "B2"], ["B9"]), (1, "o", 1): ("c", [], []), (2, "e", 1): (None, [], ["B1", None])}
