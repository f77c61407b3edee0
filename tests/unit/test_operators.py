import json
import math
import random
from collections import defaultdict
import re
from itertools import combinations

import pytest

from docloom.operators import blocks as bl
from docloom.operators import duplicates, graph, lint, replay, search
from docloom.streaming import edits


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("w", 1, "apple banana apple"), ("w", 2, "banana cherry"), ("w", 3, "durian"), ("v", 4, "apple")], "workspace_id string, doc_id long, text string")
    queries = spark.createDataFrame([(1, "w", "apple banana"), (2, "w", "nothing"), (3, "v", "apple apple")], "query_id long, workspace_id string, question string")
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    term = lambda n, df, tf, length, mean: idf(n, df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))
    first = term(3, 1, 2, 3, 2) + term(3, 2, 1, 3, 2)
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(queries, docs).collect()}
    assert got == {(1, 1): pytest.approx(1.0), (1, 2): pytest.approx(term(3, 2, 1, 2, 2) / first), (3, 4): pytest.approx(1.0)}


def test_split_blocks():
    text = "# Title\nline one\nline two\n\n- item\n- item\n\n```\ncode\n\n# no heading\n```\nafter\n## Sub\n1. x"
    assert [(k, a, b) for k, _, a, b in bl.split_blocks(text)] == [
        ("heading", 1, 1), ("paragraph", 2, 3), ("list", 5, 6), ("code", 8, 12), ("paragraph", 13, 13), ("heading", 14, 14), ("list", 15, 15),
    ]
    assert bl.split_blocks("") == [] and bl.split_blocks("\n \n") == []
    assert [k for k, *_ in bl.split_blocks("```\nnever closed")] == ["code"]


def test_blocks_have_heading_paths(spark):
    docs = spark.createDataFrame([(1, "# A\n\nx\n\n## B\n\ny\n\n# C\n\nz"), (2, None)], "doc_id long, text string")
    got = [(r.block_id, r.text, r.section_path) for r in bl.blocks(docs).orderBy("position").collect()]
    assert got == [("B0001", "# A", ["A"]), ("B0002", "x", ["A"]), ("B0003", "## B", ["A", "B"]), ("B0004", "y", ["A", "B"]), ("B0005", "# C", ["C"]), ("B0006", "z", ["C"])]


def test_greedy_runs():
    assert bl.greedy_runs([5, 5, 5, 5], 10) == [(0, 2), (2, 4)]
    assert bl.greedy_runs([5, 5, 5], 10, overlap=1) == [(0, 2), (1, 3)]
    assert bl.greedy_runs([20, 1, 1], 10) == [(0, 1), (1, 3)]
    assert bl.greedy_runs([1] * 5, 10, most=2) == [(0, 2), (2, 4), (4, 5)]
    assert bl.greedy_runs([], 10) == []


def changes_of(spark, cases):
    """(state, block id, place) by case, new blocks first in order; cases: name -> (old (id, text) pairs, new texts, last number)."""
    old = spark.createDataFrame([(k, b, t, i, n) for k, (blocks, _, n) in cases.items() for i, (b, t) in enumerate(blocks)], "document_id string, block_id string, text string, position int, last_number int")
    new = spark.createDataFrame([(k, t, i) for k, (_, texts, _) in cases.items() for i, t in enumerate(texts)], "document_id string, text string, position int")
    got = defaultdict(list)
    for r in sorted(bl.block_changes(old, new).collect(), key=lambda r: (r.position is None, r.position, r.block_id)):
        got[r.document_id].append((r.state, r.block_id, r.position))
    return got


def test_block_changes(spark):
    old = [("B0001", "a"), ("B0002", "b"), ("B0003", "c"), ("B0004", "d")]
    cases = {
        "same": (old, ["a", "b", "c", "d"], None), "turned": (old, ["b", "c", "d", "a"], None), "two": (old, ["a", "x", "y", "d"], None), "one": (old, ["a", "B", "c", "d"], None),
        "less": (old, ["a", "c", "d"], None), "more": (old, ["a", "b", "new", "c", "d"], None), "last": (old, ["a", "b", "c", "d", "e"], 9), "new": ([], ["p", "q"], None), "gone": (old, [], None),
        "crossed": (old, ["a", "d", "c", "e"], None), "twice": ([("B0001", "a"), ("B0002", "x"), ("x7", "a")], ["a", "y", "a", "a"], None),
    }
    got = changes_of(spark, cases)
    assert got["same"] == [("unchanged", f"B000{k + 1}", k) for k in range(4)]
    assert got["turned"] == [("moved", f"B000{k}", j) for j, k in enumerate((2, 3, 4, 1))]
    assert got["two"] == [("unchanged", "B0001", 0), ("added", "B0005", 1), ("added", "B0006", 2), ("unchanged", "B0004", 3), ("deleted", "B0002", None), ("deleted", "B0003", None)]
    assert got["one"][1] == ("modified", "B0002", 1) and len(got["one"]) == 4
    assert got["less"] == [("unchanged", "B0001", 0), ("moved", "B0003", 1), ("moved", "B0004", 2), ("deleted", "B0002", None)]
    assert got["more"][2] == ("added", "B0005", 2) and got["last"][-1] == ("added", "B0010", 4)
    assert got["new"] == [("added", "B0001", 0), ("added", "B0002", 1)]
    assert got["gone"] == [("deleted", f"B000{k}", None) for k in range(1, 5)]
    # Between a and c one block stood and one stands: b became what d moved to, and d itself is gone.
    assert got["crossed"] == [("unchanged", "B0001", 0), ("modified", "B0002", 1), ("unchanged", "B0003", 2), ("added", "B0005", 3), ("deleted", "B0004", None)]
    assert got["twice"] == [("unchanged", "B0001", 0), ("modified", "B0002", 1), ("unchanged", "x7", 2), ("added", "B0003", 3)]


def test_cover(spark):
    rows = [("q", "u1", 0.9, ["a", "b"]), ("q", "u2", 0.8, ["a"]), ("q", "u3", 0.7, ["c"]), ("q", "u4", 0.7, ["d"])]
    ranked = spark.createDataFrame(rows, "query_id string, unit_id string, probability double, blocks array<string>")
    assert [(r.unit_id, r["rank"]) for r in bl.cover(ranked, 2).orderBy("rank").collect()] == [("u1", 1), ("u3", 2)]


def brute_duplicates(rows, least=0.85):
    norm = {i: re.sub(r"[\W_]", "", t.lower()) for i, t, _ in rows}
    sets = {i: {n[k : k + 3] for k in range(max(1, len(n) - 2))} for i, n in norm.items() if len(n) >= 20}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
            parent[find(a)] = find(b)
    at = {i: (c, i) for i, _, c in rows}
    groups = {}
    for i in sets:
        groups.setdefault(find(i), []).append(at[i])
    return sorted((i, min(g)[1]) for g in groups.values() for _, i in g if i != min(g)[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        base = [rnd.choice("abcdefghij ") for _ in range(rnd.randint(15, 120))]
        for _ in range(rnd.randint(1, 5)):
            own = list(base)
            for _ in range(rnd.randint(0, 6)):
                own[rnd.randrange(len(own))] = rnd.choice("xyz,.")
            rows.append((len(rows), "".join(own), f"2024-{rnd.randint(1, 9)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, created_at string")
    assert sorted((r.doc_id, r.original_id) for r in duplicates.near_duplicates(docs).collect()) == brute_duplicates(rows)


def test_replayed_links(spark):
    rows = [
        ("p", 1, "add", "s", "t", "r", "e1", None, "o1"), ("p", 2, "add", "s", "t", "r", "e2", None, "o2"), ("p", 3, "remove", "s", "t", "r", "e1", None, "o3"),
        ("p", 4, "add", "s", "u", "r", "e1", "o9", "o4"), ("p", 5, "add", "s", "v", "r", None, None, "o5"), ("p", 6, "remove", "s", "v", "r", None, None, "o6"),
        ("p", 7, "add", "s", "v", "r", "e1", "o1", "o7"),
    ]
    events = spark.createDataFrame(rows, "artifact string, sequence long, op string, source string, target string, relation string, entry_id string, requires_operation string, operation string")
    assert sorted((r.target, r.entry_id) for r in replay.supported_links(events).collect()) == [("t", "e2"), ("v", "e1")]


def brute_neighbourhood(seeds, edges, rounds, most):
    """One query's expansion, link by link."""
    seen, frontier, left = dict.fromkeys(seeds, 0), set(seeds), most
    for depth in range(1, rounds + 1):
        closed = set(seen) - frontier
        near = [e for e in set(edges) if (e[0] in frontier and e[1] not in closed) or (e[1] in frontier and e[0] not in closed)]
        taken = sorted(near, key=lambda e: (-e[2], e[0], e[1]))[:left]
        left -= len(taken)
        frontier = {p for e in taken for p in e[:2]} - set(seen)
        seen |= dict.fromkeys(frontier, depth)
    return seen


def test_neighbourhood(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60), rnd.randint(0, 20) / 20) for _ in range(150)] + [(100 + i, 101 + i, 0.5) for i in range(6)]
    starts = {"a": [1, 2, 3], "b": [4], "c": [100], "d": [999]}
    table = spark.createDataFrame(edges + edges[:9], "from_page_id long, to_page_id long, confidence double")
    seeds = spark.createDataFrame([(q, p) for q, pages in starts.items() for p in pages], "query_id string, page_id long")
    for rounds, most in ((3, 12), (3, 25), (2, 6)):
        want = sorted((q, p, d) for q, pages in starts.items() for p, d in brute_neighbourhood(pages, edges, rounds, most).items())
        assert sorted(tuple(r) for r in graph.neighbourhood(seeds, table, rounds, most).collect()) == want


def test_neighbourhood_query_reaches_depth_three(spark, tmp_path):
    from docloom.plans import wiki

    spark.createDataFrame([(i,) for i in range(1, 201)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([((i * 3 + i // 5) % 200 + 1, i) for i in range(1, 301)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.depth for r in wiki.gr3_neighbourhood(spark, str(tmp_path)).collect()} == {0, 1, 2, 3}


def test_descendants_stop_at_cycles(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "node long, parent long")
    got = sorted(tuple(r) for r in graph.descendants(tree, tree.filter("node IN (1, 4)").select("node")).collect())
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (4, 4, 0), (4, 5, 1)]


def test_judged_pairs(spark):
    rows = [("a", "x", "same", 0.6), ("a", "y", "same", 0.8), ("b", "x", "related", 0.95), ("b", "y", "related", 0.9), ("b", "z", "related", 0.5), ("c", "x", "none", 1.0)]
    got = {r.incoming_slug: (r.decision, r.merge_into, r.link_to) for r in lint.judged_pairs(spark.createDataFrame(rows, "incoming_slug string, candidate_slug string, choice string, probability double")).collect()}
    assert got == {"a": ("merge", "y", []), "b": ("link", None, ["x", "y"]), "c": ("new", None, [])}


def test_latest_state_query_applies_every_event(spark, tmp_path):
    from docloom.plans import more, wiki

    ts = "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id)"
    spark.range(1, 13).selectExpr("id AS event_id", "(id - 1) DIV 3 AS user_id", "'view' AS event_type", f"{ts} AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.document_id: r.revision for r in wiki.st2_latest_state(spark, str(tmp_path)).collect()} == {0: 3, 1: 6, 2: 9, 3: 12}
    spark.createDataFrame([(i, 1) for i in range(1, 9)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    line = spark.createDataFrame([(i, i, i) for i in range(1, 8)], "l_orderkey long, l_partkey long, l_linenumber int")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {str(r.run): r.unlinked for r in more.qa6_granularity(spark, str(tmp_path)).collect()}
    assert got == {"0": 1, "1": 0}


def test_newest_vectors_of_a_workspace(spark, tmp_path):
    from docloom.plans import ledger

    spark.range(60).selectExpr("id AS event_id", "id % 2 * 3 AS user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id DIV 4) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    keep = lambda *n: sorted(r.event_id for r in ledger.em3_newest_vectors(spark, str(tmp_path), *n).collect())
    assert keep() == list(range(60))
    assert keep(6) == [52, 53, 56, 57, 58, 59]


def test_judged_pairs_drop_chained_merges(spark):
    same = lambda a, b, p=0.9: (a, b, "same", p)
    rows = [same("a", "b"), same("b", "c"), same("d", "e"), same("e", "d"), same("f", "g"), ("g", "h", "related", 0.95), same("i", "b", 0.5), same("i", "z", 0.6)]
    pairs = spark.createDataFrame(rows, "incoming_slug string, candidate_slug string, choice string, probability double")
    got = {r.incoming_slug: (r.decision, r.merge_into, r.link_to) for r in lint.judged_pairs(pairs).collect()}
    new = ("new", None, [])
    assert got == {"a": new, "b": ("merge", "c", []), "d": new, "e": new, "f": ("merge", "g", []), "g": ("link", None, ["h"]), "i": ("merge", "z", [])}


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    event = lambda d, r: json.dumps({"document_id": d, "workspace_id": "w" + d[-1:], "revision": r, "content_hash": f"h{r}", "created_at": "2024-01-01T00:00:00Z"})
    messages = [event(f"d{rnd.randint(0, 5)}", rnd.randint(1, 40)) for _ in range(80)] + ["{broken", "null", '{"document_id": "d1"}', event("", 1)]
    messages += rnd.sample(messages, 20)
    rnd.shuffle(messages)
    source = tmp_path / "in"
    source.mkdir()
    for k in range(6):
        (source / f"{k}.json").write_text("\n".join(messages[k::6]))
    purged = spark.createDataFrame([("w3",)], "workspace_id string")
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    places = [str(tmp_path / x) for x in ("state", "checkpoint", "rejected")]
    edits.follow(raw, purged, *places, buckets=5).awaitTermination(120)
    batch = edits.accepted(spark.read.text(str(source)), purged)
    want = replay.latest_state(batch.limit(0), batch)
    key = lambda df: sorted((r.document_id, r.workspace_id, r.revision, r.content_hash) for r in df.collect())
    assert key(edits.current(spark, str(tmp_path / "state"))) == key(want)
    assert edits.rejected(spark.read.text(str(source))).count() == sum("document_id" not in m or '"document_id": ""' in m or m == '{"document_id": "d1"}' for m in messages)
    bad = spark.read.parquet(places[2])
    assert sorted(r.value for r in bad.collect()) == sorted(r.value for r in edits.rejected(spark.read.text(str(source))).collect())

    # The stream goes on where it was: one document's event changes one bucket, and an old one changes none.
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    before = files()
    (source / "late.json").write_text(event("d1", 99))
    edits.follow(raw, purged, *places, buckets=5).awaitTermination(120)
    new = set(files()) - set(before)
    assert {p.parent.name for p in new} == {p.parent.name for p in set(before) - set(files())} and len({p.parent.name for p in new}) == 1
    assert {r.document_id: r.revision for r in edits.current(spark, places[0]).collect()}["d1"] == 99
    before = files()
    (source / "older.json").write_text(event("d1", 98) + "\n" + event("d2", 0))
    edits.follow(raw, purged, *places, buckets=5).awaitTermination(120)
    assert files() == before
