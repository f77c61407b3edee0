"""Tables merged by key: what is left, and what is written for it."""

from __future__ import annotations

import random
from collections import defaultdict

from docloom.sources import keyed


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_upsert_unites_arrays_and_writes_what_changes(spark, tmp_path):
    rnd, path = random.Random(2), tmp_path / "t"
    schema = "key long, version int, name string, tags array<string>"
    newest, tags = {}, defaultdict(set)
    for k in range(4):
        rows = [(rnd.randint(0, 30), 100 * k + i, f"n{k}{i}", [rnd.choice("abcde"), None] if i % 7 else None) for i in range(40)]
        keyed.upsert(str(path), spark.createDataFrame(rows, schema), ["key"], "version", ("tags",), buckets=7)
        for key, version, name, own in rows:
            newest[key] = max(newest.get(key, (0, "")), (version, name))
            tags[key] |= {t for t in own or [] if t}
    got = {r.key: (r.version, r.name, r.tags) for r in keyed.current(spark, str(path)).collect()}
    assert got == {k: (*newest[k], sorted(tags[k])) for k in newest}
    before = files(path)
    old = spark.createDataFrame([(5, 1, "old", ["a"]), (5, 2, "old", [])], schema)
    if "a" in tags[5]:
        assert keyed.upsert(str(path), old, ["key"], "version", ("tags",), buckets=7) == [] and files(path) == before
    written = keyed.upsert(str(path), spark.createDataFrame([(5, 999, "new", ["z"])], schema), ["key"], "version", ("tags",), buckets=7)
    assert len(written) == 1 and {p.parent.name for p in set(files(path)) - set(before)} == {f"bucket={written[0]}"}
    row = keyed.current(spark, str(path)).filter("key = 5").first()
    assert (row.version, row.name, row.tags) == (999, "new", sorted(tags[5] | {"z"}))


def test_first_version_names_an_entry(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "key string, version int, name string, refs array<string>"
    for version, name, refs in ((3, "first", ["B2"]), (9, "later", ["B1", "B2"])):
        keyed.upsert(path, spark.createDataFrame([("k", version, name, refs)], schema), ["key"], "version", ("refs",), first=True)
    assert [tuple(r) for r in keyed.current(spark, path).collect()] == [("k", 3, "first", ["B1", "B2"])]


def test_documents_are_replaced_whole(spark, tmp_path):
    path = tmp_path / "blocks"
    load = lambda docs, blocks: keyed.replace_documents(str(path), spark.createDataFrame([(d,) for d in docs], "document_id string"), spark.createDataFrame(blocks, "document_id string, block_id string, text string"), buckets=8)
    blocks = {f"d{i}": [(f"d{i}", f"B{k}", f"text {i} {k}") for k in range(3)] for i in range(12)}
    everything = [b for rows in blocks.values() for b in rows]
    assert load(blocks, everything)
    kept = lambda: sorted((r.document_id, r.block_id, r.text) for r in keyed.current(spark, str(path)).collect())
    assert kept() == sorted(everything)
    before = files(path)
    assert load(blocks, list(reversed(everything))) == [] and files(path) == before  # equal snapshots
    changed = [("d1", "B0", "other"), *blocks["d2"]]
    written = load(["d1", "d2", "d3", "d99"], changed)  # d1 anew, d2 as it was, d3 emptied, d99 never had any
    assert 1 <= len(written) <= 2
    assert {p.parent.name for p in set(files(path)) - set(before)} <= {f"bucket={b}" for b in written}
    assert kept() == sorted([b for b in everything if b[0] not in ("d1", "d3")] + [("d1", "B0", "other")])
    load(blocks, [])
    assert kept() == [] if keyed.exists(spark, str(path)) else True
    assert load(["d1"], changed[:1]) and kept() == [("d1", "B0", "other")]
