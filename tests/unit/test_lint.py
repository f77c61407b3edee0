"""Boxes against all pairs, and what runs take back."""

from __future__ import annotations

from datetime import datetime

import numpy as np

from docloom.operators import lint


def test_boxes_of_a_large_page(spark):
    """10,000 boxes of a page, tiny ones, one as large as the page, some without any extent, and a second page."""
    rnd = np.random.default_rng(5)
    low = rnd.uniform(-50, 1000, (10_000, 2)).round(1)
    boxes = np.hstack([low, low + rnd.choice([0, 1, 4, 30], (10_000, 1)) * rnd.uniform(0.5, 2, (10_000, 2)).round(2)])
    boxes[0] = [-100, -100, 1100, 1100]
    found = np.hstack([low[:300] + 1.3, low[:300] + rnd.choice([2, 8, 40], (300, 1))])
    found = np.vstack([found, [[5000, 5000, 5001, 5001]]])
    rows = lambda x, page, base: [("d", page, base + i, *map(float, r)) for i, r in enumerate(x)]
    schema = "document_id string, page int, id long, x0 double, y0 double, x1 double, y1 double"
    one, other = rows(boxes, 1, 0) + rows(boxes[1:9], 2, 20_000), rows(found, 1, 50_000) + rows(found[:5], 3, 60_000)
    got = {r.candidate_id: (r.box_id, r.ratio) for r in lint.box_matches(spark.createDataFrame(one, schema), spark.createDataFrame(other, schema)).collect()}
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    want = {}
    for i, c in enumerate(found):
        wide, high = (np.maximum(np.minimum(boxes[:, k + 2], c[k + 2]) - np.maximum(boxes[:, k], c[k]), 0) for k in (0, 1))
        least = np.minimum(area(boxes), area(c))
        ratio = np.where(least > 0, wide * high / np.where(least > 0, least, 1), 0)
        middle = (c[:2] + c[2:]) / 2
        near = np.flatnonzero((ratio >= 0.25) | ((boxes[:, :2] <= middle) & (middle <= boxes[:, 2:])).all(axis=1))
        if len(near):
            best = min(near, key=lambda k: (-round(ratio[k], 9), k))
            want[50_000 + i] = (best, round(ratio[near].max(), 6))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_reconciled(spark):
    at = lambda day: datetime(2024, 1, day)
    rel = lambda *pairs: [(s, t, r) for s, t, r in pairs]
    runs = spark.createDataFrame(
        [
            ("d1", "w", 1, "succeeded", at(1), at(1), False, ["B1"], ["a", "b"], rel(("x", "y", "r"), ("x", "z", None))),
            ("d1", "w", 2, "succeeded", at(2), at(2), None, ["B2", "B3"], ["a"], rel(("x", "y", "r"))),
            ("d1", "w", 3, "failed", at(3), at(3), None, ["B9"], [], None),
            ("d2", "w", 4, "succeeded", at(1), at(1), None, None, None, rel(("x", "z", ""))),
            ("d3", "w", 5, "succeeded", at(1), at(1), None, [], ["c"], rel(("x", "z", ""), ("p", "q", "r"))),
            ("d3", "w", 6, "succeeded", at(2), at(2), None, [], ["c"], None),
            ("d4", "v", 7, "succeeded", at(2), at(2), True, ["B1"], [], None),
        ],
        "document_id string, workspace_id string, id int, status string, finished_at timestamp, created_at timestamp, reconciled boolean, invalidated array<string>, concepts array<string>, relations array<struct<source string, target string, relation string>>",
    )
    linked = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d1", "b"), ("d3", "c"), ("d4", "z"), ("d9", "a")], "document_id string, slug string")
    got = sorted((r.document_id, r.kind, r.key.replace("\x1f", "|"), r.removable) for r in lint.reconciled(runs, linked).collect())
    assert got == [
        ("d1", "concept", "b", True), ("d1", "ref", "d1:B2", True), ("d1", "ref", "d1:B3", True), ("d1", "relation", "x|z|", False),
        ("d3", "relation", "p|q|r", True), ("d3", "relation", "x|z|", False),
    ]
