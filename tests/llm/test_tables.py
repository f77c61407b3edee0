import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.kdtree import Best, KdTree, top_k
from docloom.llm.mixing import mix_sources, mixed
from docloom.llm.revisit import resolve_revisits
from docloom.operators.components import components


def brute_top(rows, k):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in usable]
    out = []
    asked = {i: min((list(w), v) for (j, v), (_, w) in zip(sound, usable) if j == i)[1] for i, _ in sound if i % 20 == 0}
    for q, v in asked.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v)))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [float(np.float32(rnd.uniform(-1, 1))) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(60)]
    rows += [(1000, None), (1020, [None] * 6), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, rows[0][1]), (1080, [0.5, 0.5]), (1081, [0.25, 1.0])]
    vectors = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F

    got = top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 20)
    assert top_k(vectors.limit(0), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("copies", [1, 400])
def test_tree_search_over_many_leaves(copies):
    rnd = np.random.default_rng(copies)
    points = rnd.integers(-20, 20, (3000, 8)).astype(float)
    points[:copies] = points[0]
    ids = rnd.permutation(10_000)[:3000]
    queries, own = points[::50], ids[::50]
    best = Best(queries, own, 10)
    for half in (slice(0, 1700), slice(1700, 3000)):
        best.search(KdTree(points[half], ids[half], 11))
    for q, me, scores, found in zip(queries, own, best.scores, best.ids):
        want = sorted((-s, i) for s, i in zip((points @ q).tolist(), ids.tolist()) if i != me)[:10]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == want


def test_repeated_rows_in_a_group_of_copies(spark):
    """A query whose own rows are among more than k equal vectors, and a neighbour with more than k rows."""
    from pyspark.sql import functions as F

    own = [0.75, -0.5]
    rows = [(0, own)] * 6 + [(i, own) for i in range(1, 31)] + [(40, [-0.5, 0.75])] * 3 + [(i, [-0.5, 0.75]) for i in range(41, 50)]
    rows += [(51, [0.25, 0.25])] * 24 + [(i, [0.25, 0.25]) for i in range(52, 60)] + [(i, [-1.0, -1.0]) for i in range(61, 70)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (1, 5, 20):
        got = top_k(vectors, F.col("vec_id") % 20 == 0, k=k).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, k)


def test_a_query_id_with_unlike_vectors(spark, monkeypatch):
    """Its smallest vector asks, whatever the order of rows; shards and blocks hold a bounded number of bytes."""
    monkeypatch.setattr("docloom.llm.kdtree.MOST_BYTES", 8 * 3 * 40)
    rnd = random.Random(3)
    rows = [(20 * (i % 7), [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(60)] + [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(1, 90)]
    rows += [(40, [-9.0, 0.0]), (41, [1.0, 1.0])]  # the smallest vector of 40 is of another length
    for _ in range(3):
        rnd.shuffle(rows)
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = top_k(vectors, F.col("vec_id") % 20 == 0, k=5).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 5)


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """The targets by sharing out, stopping full sources and sharing their excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            got[s] += unit * weight[s]
            if got[s] >= cap * sizes[s]:
                left += got[s] - cap * sizes[s]
                got[s] = float(cap * sizes[s])
                open_.discard(s)
    return got


@pytest.mark.parametrize("group", [4, 64])
def test_mixing(spark, group):
    rnd = random.Random(group)
    rows = [(i, " ".join(["w"] * int(rnd.paretovariate(0.9))), rnd.choice(["hot"] * 6 + ["a", "b", "c", "é", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "only empty"), (1002, " \n", None), (None, "x y", "b"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    plan = mix_sources(docs, group=group).collect()
    assert sorted((str(r.doc_id), r.size) for r in plan) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    sizes, taken, source = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for r in plan:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = targets(sizes)
    for r in plan:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s in sizes:
        # One document without others of nearly its size may be left to round alone.
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], max(r.size for r in plan if source[r.doc_id] == s) / 2), s
    again = mix_sources(docs.repartition(7), group=group).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    rows_out = mixed(docs, group=group)
    assert rows_out.columns == docs.columns and rows_out.count() == sum(r.copies for r in plan)
    assert mix_sources(docs.limit(0)).collect() == []


def test_copies_of_rows_that_differ_elsewhere(spark):
    """Rows equal in id, source and text keep their other columns, and share their copies."""
    rows = [(1, "w " * 50, "a", lang) for lang in ("en", "en", "de", None)] * 3 + [(1, "w " * 50, "b", "fr"), (2, "x", "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    plan, out = mix_sources(docs).collect(), mixed(docs).collect()
    assert len(out) == sum(r.copies for r in plan)
    found = defaultdict(int)
    for r in out:
        found[r.source, r.lang] += 1
    share = sum(r.copies for r in plan if r.doc_id == 1 and r.source_size == 601) / 12
    assert {k for k in found if k[0] == "a"} == {("a", "en"), ("a", "de"), ("a", None)}
    assert abs(found["a", "de"] - 3 * share) < 1 and abs(found["a", None] - 3 * share) < 1


def test_copies_keep_their_expectation(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "s" if i % 2 else "t") for i in range(200)], "doc_id long, text string, source string")
    shares = [mix_sources(docs, weights=(1.0,), share=0.5, seed=k).groupBy().avg("copies").first()[0] for k in range(4)]
    assert np.mean(shares) == pytest.approx(0.5, abs=0.05)


def record(i, url, time, kind, etag=None, modified=None, digest=None, headers=None):
    return (i, url, time, kind, etag, modified, digest, headers, "clash")


def test_revisits(spark):
    rows = [
        record(1, "http://A.com:80/x/?utm_source=f#t", 10, "response", '"a"', "d1", "p1", {"etag": '"a"', "content-length": "9", "date": "old"}),
        record(2, "HTTP://a.com/x", 20, "revisit", 'W/"a"', None, None, {"date": "new", "content-length": "0", "server": "z"}),
        record(3, "http://a.com/x", 30, "revisit", '"b"', "d1", "p1"),
        record(4, "http://a.com/x", 40, "revisit", None, "d1", None, None),
        record(5, "http://a.com/x", 50, "revisit"),
        record(6, "http://a.com/x", 60, "response", None, None, "p2"),
        record(7, "http://a.com/x", 60, "revisit", None, None, "p2"),
        record(8, "http://a.com/x", 5, "revisit", '"a"'),
        record(9, None, 70, "revisit", '"a"'),
        record(10, "http://a.com/x", None, "revisit", '"a"'),
        record(11, "http://b.com/", 70, "revisit", '"a"'),
        record(12, "http://a.com/x?b=1", 70, "revisit", '"a"'),
    ]
    kinds = "record_id long, url string, time long, kind string, etag string, last_modified string, digest string, headers map<string,string>, outcome string"
    records = spark.createDataFrame(rows, kinds)
    want = {
        2: ("resolved", 1, {"etag": '"a"', "content-length": "9", "date": "new"}), 3: ("mismatch", None, None),
        4: ("resolved", 1, {"etag": '"a"', "content-length": "9", "date": "old"}), 5: ("unvalidated", None, None),
        7: ("resolved", 6, {}), 8: ("no_response", None, None), 9: ("no_key", None, None), 10: ("no_key", None, None),
        11: ("no_response", None, None), 12: ("no_response", None, None),
    }
    for bucket_rows in (1, 10_000):
        got = {r.record_id: (r.outcome, r.response_id, r.headers) for r in resolve_revisits(records, bucket_rows).collect()}
        assert got == want
    assert resolve_revisits(records.limit(0)).collect() == []


def test_components(spark):
    rnd = random.Random(4)
    links = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_the_bound_goes_from_shard_to_shard(spark, monkeypatch):
    monkeypatch.setattr("docloom.llm.kdtree.LEAST_SHARD", 30)
    monkeypatch.setattr("docloom.llm.kdtree.MOST_SHARD", 60)
    monkeypatch.setattr("docloom.llm.kdtree.QUERY_BLOCK", 20)
    rng = np.random.default_rng(9)
    points = rng.integers(-8, 8, (400, 5)) / 64
    points[300:340] = points[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_k(vectors, F.col("vec_id") % 4 == 0, k=7).select("query_id", "rank", "vec_id", "score").collect())
    whole = np.floor(points * 64).astype(int)
    want = []
    for q in range(0, 400, 4):
        best = sorted((-int(whole[q] @ whole[j]), j) for j in range(400) if j != q)[:7]
        want += [(q, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_shards_are_pruned_by_their_boxes(spark, monkeypatch):
    """Clustered vectors in many shards, a third of them copies of one, some of another length: whole results, fewer shards asked."""
    from docloom.llm import kdtree

    monkeypatch.setattr(kdtree, "LEAST_SHARD", 40)
    rnd = np.random.default_rng(4)
    centres = rnd.uniform(-4, 4, (12, 5))
    points = centres[rnd.integers(0, 12, 900)] + rnd.normal(0, 0.05, (900, 5))
    points[600:] = points[0]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]
    rows += [(1000 + i, [0.5 * i, -1.0]) for i in range(50)] + [(2000, []), (2001, [])] + rows[20:60]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(rows, 20)

    keyed = vectors.select(F.size("embedding").alias("dim"), F.xxhash64("vec_id").alias("key"), "vec_id", F.transform("embedding", lambda x: 64 * x).alias("v"), F.lit(True).alias("q"))
    cells = kdtree._cells(keyed, len(rows), 120)
    dealt = keyed.mapInArrow(cells.deal, "dim int, shard int, vec_id long, v array<double>, q boolean")
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert len(sizes) > 4 and sum(sizes) == len(rows) and max(sizes) < 300
    best = F.lit(64.0 * 64 * 40)
    asked = dealt.select("dim", F.col("shard").alias("own"), "vec_id", "v", best.alias("floor"))
    routed = asked.mapInArrow(cells.route, "dim int, own int, vec_id long, v array<double>, floor double, shards array<int>")
    assert 0 < routed.filter("dim = 5").agg(F.avg(F.size("shards"))).first()[0] < 0.7 * (cells.shards - 1)
