"""Invalidation across records against a page-by-page computation, and the overlay of what is pending."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from docloom.operators import replay
from docloom.operators.invalidation import Invalidation, merged_evidence, since_delete


def page_by_page(records):
    """What is left of a page's records, by the rules, from the last record to the first."""
    later_refs, later_claims, stale, dropped = set(), set(), {}, set()
    for r in sorted(records, key=lambda r: -r["sequence"]):
        if not r["manual"]:
            stale[r["sequence"]] = set(later_refs)
            dropped |= later_claims
        later_refs |= set(r["inv_refs"])
        later_claims |= set(r["inv_claims"])
    dropped |= {u["id"] for r in records for u in r["units"] if set(u["refs"]) & stale.get(r["sequence"], set())}
    out = set()
    for r in records:
        s, old, d = r["sequence"], stale.get(r["sequence"], set()), set() if r["manual"] else dropped
        lost, held = [u for u in r["units"] if u["id"] in d], [u for u in r["units"] if u["id"] not in d]
        only = {x for u in lost for x in u["refs"]} - {x for u in held for x in u["refs"]}
        out |= {("unit", s, u["id"]) for u in held} | {("ref", s, x) for x in r["cited"] if x not in old | only} | {("claim", s, c) for c in r["claims"] if c not in d}
        out |= {("point", s, k) for k, (text, refs) in enumerate(r["points"]) if not set(refs) & old and not any(u["claim"] == text and set(u["refs"]) == set(refs) for u in lost)}
        for k, (op, refs, claims) in enumerate(r["changes"]):
            if op == "add":
                left = [x for x in refs if x not in old], [c for c in claims if c not in d]
                if (refs or claims) and not any(left):
                    continue
                refs, claims = left
            out.add(("change", s, k, op, tuple(refs), tuple(claims)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_invalidation(spark, seed):
    rnd = random.Random(seed)
    some = lambda pool, most: rnd.sample(pool, rnd.randint(0, most))
    refs, ids, texts = [f"B{i}" for i in range(12)], [f"c{i}" for i in range(15)], ["x", "y", "z"]
    pages = {}
    for page in ("p", "q", "only manual", "none"):
        pages[page] = [
            {"sequence": 3 * k, "manual": page == "only manual" or rnd.random() < 0.2, "inv_refs": some(refs, 2) if rnd.random() < 0.4 else [], "inv_claims": some(ids, 1) if rnd.random() < 0.2 else [], "cited": some(refs, 4), "claims": some(ids, 3),
             "units": [{"id": i, "claim": rnd.choice(texts), "refs": some(refs, 2)} for i in some(ids, 3)], "points": [(rnd.choice(texts), some(refs, 2)) for _ in range(3)], "changes": [(rnd.choice(["add", "add", "move"]), some(refs, 2), some(ids, 2)) for _ in range(3)]}
            for k in range(14 if page != "none" else 0)
        ]
    flat = [(page, r) for page, records in pages.items() for r in records]
    make = lambda rows, schema: spark.createDataFrame(rows, f"page_id string, sequence int, {schema}")
    records = make([(p, r["sequence"], "manual" if r["manual"] else None, r["inv_refs"], r["inv_claims"]) for p, r in flat], "artifact_type string, invalidated_refs array<string>, invalidated_claims array<string>")
    units = make([(p, r["sequence"], u["id"], u["claim"], u["refs"]) for p, r in flat for u in r["units"]], "evidence_id string, claim string, refs array<string>")
    left = Invalidation(records, units)
    got = {("unit", r.page_id, r.sequence, r.evidence_id) for r in left.left_units().collect()}
    got |= {("ref", r.page_id, r.sequence, r.ref) for r in left.left_refs(make([(p, r["sequence"], x) for p, r in flat for x in r["cited"]], "ref string")).collect()}
    got |= {("claim", r.page_id, r.sequence, r.evidence_id) for r in left.left_claims(make([(p, r["sequence"], x) for p, r in flat for x in r["claims"]], "evidence_id string")).collect()}
    got |= {("point", r.page_id, r.sequence, r.place) for r in left.left_points(make([(p, r["sequence"], k, *x) for p, r in flat for k, x in enumerate(r["points"])], "place int, text string, refs array<string>")).collect()}
    changes = left.left_changes(make([(p, r["sequence"], k, *x) for p, r in flat for k, x in enumerate(r["changes"])], "place int, op string, refs array<string>, claims array<string>")).collect()
    got |= {("change", r.page_id, r.sequence, r.place, r.op, tuple(r.refs), tuple(r.claims)) for r in changes}
    want = {(kind, page, *rest) for page, records in pages.items() for kind, *rest in page_by_page(records)}
    assert got == want and len([r for r in changes]) == len({x for x in want if x[0] == "change"})


def test_deletes_cut_records(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 5), ("p", 6), ("q", 1)], "page_id string, sequence int")
    deletes = spark.createDataFrame([("p", 2), ("p", 5)], "page_id string, sequence int")
    assert sorted(map(tuple, since_delete(rows, deletes).collect())) == [("p", 6), ("q", 1)]


def test_pending_rows(spark):
    at = lambda day: datetime(2024, 1, day)
    ledger = spark.createDataFrame(
        [("p", "stored", "d", "x", 1, True, None, False), ("p", "other", "d", "y", 2, True, None, False), ("p", "trashed", "gone", "x", 3, False, None, False), ("p", "removed", "d", "x", 4, False, None, True), ("p", "restored", "d", "x", 5, True, "l", False), ("p", "alone", "d", "x", 6, False, None, False)],
        "page_id string, operation_id string, document_id string, payload string, sequence int, active boolean, linked_by string, source_removed boolean",
    )
    row = lambda op, doc="d", payload="x", seq=None, active=True, link=None, kind=None, bad=None, made=at(5), over=None: ("p", op, doc, payload, seq, active, link, kind, bad, made, over)
    pending = spark.createDataFrame(
        [row("stored", seq=1), row("other"), row("trashed", doc="gone"), row("removed", seq=4), row("restored", seq=5, kind="RESTORE"), row("new", seq=9), row("late", doc="gone", seq=8), row("early", doc="gone", seq=8, made=at(9)),
         row("open"), row("old", seq=1, over=at(6)), row("bad", seq=2, bad=True)],
        "page_id string, operation_id string, document_id string, payload string, sequence int, active boolean, linked_by string, kind string, rejected boolean, created_at timestamp, superseded_at timestamp",
    )
    tombstones = spark.createDataFrame([("gone", at(7)), ("gone", at(2))], "document_id string, deleted_at timestamp")
    got = {r.operation_id: (r.state, r.active, r.sequence) for r in replay.with_pending(ledger, pending, tombstones).collect()}
    assert got == {
        "stored": ("stored", True, 1), "other": ("conflict", True, 2), "trashed": ("stored", False, 3), "removed": ("stored", False, 4), "restored": ("stored", True, 5), "alone": ("stored", False, 6),
        "new": ("pending", True, 9), "late": ("pending", False, 8), "early": ("pending", True, 8), "open": ("unresolved", True, None), "bad": ("conflict", True, 2),
    }


def test_merged_pages_and_evidence(spark):
    rows = [("p", 1, "A", "def", ["B2", "B1"], [], ["x"], 4, 0.5), ("p", 2, " ", "", ["B1", "B3"], None, ["y", "x"], 9, None), ("p", 3, "C", None, [], [], [], None, 0.25), ("q", 1, None, None, None, ["m", "m", "n"], None, 7, None)]
    merged = replay.merged_pages(spark.createDataFrame(rows, "page_id string, sequence int, title string, definition string, refs array<string>, mention_refs array<string>, aliases array<string>, mention_count int, importance double"))
    p, q = merged.orderBy("page_id").collect()
    assert (p.title, p.definition, p.refs, p.aliases, p.mention_count, p.importance, p.n) == ("C", "def", ["B2", "B1", "B3"], ["x", "y"], 9, 0.5, 3)
    assert (q.title, q.mention_refs, q.mention_count, q.importance) == (None, ["m", "n"], 2, None)
    units = spark.createDataFrame([("p", 1, 0, "a", "old"), ("p", 1, 1, "b", "b"), ("p", 4, 0, "a", "new")], "page_id string, sequence int, place int, evidence_id string, text string")
    got = sorted((tuple(r["first"]), r.evidence_id, r.text) for r in merged_evidence(units).collect())
    assert got == [((1, 0), "a", "new"), ((1, 1), "b", "b")]
