from pyspark.sql import functions as F

from docloom.operators import concepts, grading, lint, usage
from docloom.sources.streams import messages
from docloom.streaming import edits


def test_grades_count_missing_turned_and_lost(spark):
    results = spark.createDataFrame(
        [("a", 1, "t", "completed", 2.0, "# Ｆirst — line\nthird\nSecond &amp; more\n| x | 1 | 2 |\n<tr><td>y<br/></td><td>3</td></tr>"), ("b", 1, "t", "failed", None, None), ("c", 1, "u", "completed", 4.0, None)],
        "id string, run int, type string, status string, seconds double, markdown string",
    )
    gold = spark.createDataFrame(
        [("a", 1, "First line"), ("a", 2, "- second & **more**"), ("a", 3, "Third"), ("a", 4, "fourth"), ("b", 1, "x"), ("c", 1, "x")], "id string, position int, sentence string"
    )
    rows = spark.createDataFrame([("a", ["x", "-", "1 2"]), ("a", ["1", "x"]), ("a", ["Y", "3"]), ("a", ["x", "3"])], "id string, cells array<string>")
    grades = grading.conversion_grades(results, gold, rows)
    got = {r["id"]: r for r in grades.collect()}
    counts = ("missing", "order_errors", "table_errors", "sentences", "table_rows", "ok")
    assert [got["a"][c] for c in counts] == [1, 1, 2, 4, 4, False]
    assert [got["b"][c] for c in counts] == [None] * 5 + [False]
    assert [got["c"][c] for c in counts] == [1, 0, 0, 1, 0, False]
    total = {r["type"]: r for r in grading.grade_summary(grades).collect()}
    assert (total[None]["runs"], total[None]["completed"], total[None]["seconds"], total[None]["restored"]) == (3, 2, 3.0, 0.6)
    assert total["u"]["table_restored"] is None
    assert grading.conversion_grades(results.limit(0), gold, rows).count() == 0


def test_names_merge_once_and_follow_chains(spark):
    shape = "workspace_id int, slug string, key string"
    incoming = [(1, "a", "x"), (1, "b", "x"), (1, "c", "k"), (1, "d", "m"), (1, "e", "m"), (1, "f", "m"), (1, "g", "none"), (1, "h", "q"), (1, "h", "r"), (2, "z", "k")]
    known = [(1, "old", "k"), (1, "p", "q"), (1, "p", "r"), (1, "w", "w")]
    judged = spark.createDataFrame([(1, "a", "g"), (1, "g", "a"), (1, "c", "w"), (1, "d", "w")], "workspace_id int, slug string, target string")
    df = lambda rows: spark.createDataFrame(rows, shape)
    got = {(r["workspace_id"], r["slug"]): (r["decision"], r["merge_into"]) for r in lint.resolved_names(df(incoming), df(known), judged).collect()}
    # b merges into a; a goes on to g, which leads back to a.
    assert got[1, "b"] == ("merge", "a") and got[1, "a"] == ("judge", None)
    assert got[1, "c"] == ("merge", "old") and got[1, "h"] == ("merge", "p")
    assert {got[1, s] for s in "def"} == {("create", None)}
    assert got[1, "g"] == ("judge", None) and got[2, "z"] == ("judge", None)
    straight = spark.createDataFrame([(1, "a", "w"), (1, "w", "gone")], judged.schema)
    again = {r["slug"]: r["merge_into"] for r in lint.resolved_names(df(incoming), df(known), straight).collect()}
    assert again["b"] == "w"
    assert lint.resolved_names(df([]), df(known)).count() == 0


def test_names_of_many_equal_concepts_are_no_match(spark):
    many = spark.range(500).select(F.lit(1).alias("workspace_id"), F.concat(F.lit("s"), "id").alias("slug"), F.lit("same").alias("key"))
    got = lint.resolved_names(many, many.limit(0)).groupBy("decision").count().collect()
    assert [tuple(r) for r in got] == [("create", 500)]


def test_late_ends_keep_status_and_time(spark):
    calls = spark.createDataFrame([(1, "abandoned", "t1", None), (2, "started", None, None), (3, "started", None, 5)], "id int, status string, finished_at string, output_tokens int")
    ends = spark.createDataFrame([(1, "completed", "t9", 7), (2, "failed", "t9", None)], calls.schema)
    got = sorted(tuple(r) for r in usage.finished(calls, ends).collect())
    assert got == [(1, "abandoned", "t1", 7), (2, "failed", "t9", None), (3, "started", None, 5)]


def test_findings_of_observations(spark):
    rows = [(1, "whole (text)", ["c"], ["B1"]), (2, "N/A", [], ["B1"]), (3, "", [" "], []), (4, None, ["c"], ["B1"]), (5, "cut [", [], None), (6, "a “b", [], ["B1"]), (7, "b) a", [], ["B1"])]
    df = spark.createDataFrame(rows, "observation_id int, summary string, claims array<string>, anchors array<string>").withColumns({"document_id": F.lit(1), "title": F.lit("t")})
    got = sorted((r["observation_id"], r["finding"]) for r in concepts.observation_findings(df).collect())
    assert got == [(2, "broken"), (3, "broken"), (3, "missing_ref"), (5, "broken"), (5, "missing_ref"), (6, "broken")]
    signs = df.select("observation_id", concepts.observation_signature(F.lit(""), F.col("summary"), F.col("title")).alias("s"))
    assert [r["s"] for r in signs.orderBy("observation_id").collect()][:4] == ["s:whole text", "s:na", "t:t", "t:t"]


def test_ungrounded_items_lose_their_links(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "document_id int, item_id int")
    bad = spark.createDataFrame([(1, 2)], items.schema)
    ledger = spark.createDataFrame([(1, "a", [2, 1]), (1, "b", [2]), (2, "a", [])], "document_id int, slug string, evidence_ids array<int>")
    kept, linked = concepts.without_ungrounded(items, bad, ledger)
    assert sorted(tuple(r) for r in kept.collect()) == [(1, 1), (2, 1)]
    assert sorted((r["document_id"], r["slug"], r["evidence_ids"]) for r in linked.collect()) == [(1, "a", [1]), (1, "b", []), (2, "a", [])]


def test_messages_are_read_back(spark):
    events = spark.createDataFrame([("d1", "w1", 3, "h", "2024-01-01 00:00:00"), ("d2", "w1", 4, None, None)], "document_id string, workspace_id string, revision int, content_hash string, created_at string")
    sent = messages(events)
    assert [r["key"] for r in sent.collect()] == ["d1", "d2"]
    got = {r["document_id"]: r["valid"] for r in edits.parsed(sent).collect()}
    assert got == {"d1": True, "d2": False}
