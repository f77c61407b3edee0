"""Source divergence against a plain computation."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import divergence as D
from docloom.llm import kernels as K

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, min_docs, most):
    """The result's rows for (text, lang, source) rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = Counter(), Counter()
    for text, lang, source in rows:
        docs.update({(lang, t) for t in terms_of(text)})
        counts.update((lang, source, t) for t in terms_of(text))
    kept = defaultdict(list)
    for (lang, term), n in docs.items():
        if n >= min_docs:
            kept[lang].append(term)
    groups = {(lang, source) for _, lang, source in rows}
    out = []
    for lang in {g[0] for g in groups}:
        sources, v = sorted(s for x, s in groups if x == lang), len(kept[lang])
        own = {s: {t: counts[lang, s, t] for t in kept[lang]} for s in sources}
        own[None] = {t: sum(own[s][t] for s in sources) for t in kept[lang]}
        p = {s: {t: 1 + 10**9 * (c + 5) // (sum(of.values()) + 5 * v) for t, c in of.items()} for s, of in own.items()}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept[lang]), o) for o in sources if o != s]
            above = [(p[s][t] - p[None][t], t) for t in kept[lang] if own[s][t] and p[s][t] > p[None][t]]
            for part, values, upto in (("pair", pairs, len(pairs)), ("term", above, most)):
                ordered = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:upto]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def sample(seed, n=400):
    pick = random.Random(seed)
    words = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["É", "é", "日本", "Zoo", "naïve"]
    rows = []
    for _ in range(n):
        source = pick.choice(["a", "a", "a", "b", "c", None, "é", ""])
        own = words[: 20 + 25 * len(source or "xx")]
        rows.append((" ".join(pick.choice(own) for _ in range(pick.randint(0, 40))), pick.choice(["en", "en", "fr", None]), source))
    # A language with no kept term, a group without terms, repeated rows, a long text.
    return rows + [("only here", "xx", "a"), (None, "xx", "b"), ("42 ! \x00", "en", "none"), ("tab " * 30_000, "en", "b")] + rows[:3] * 2


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 1 << 13)])
def test_equals_plain(spark, monkeypatch, seed, block):
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    rows = sample(seed)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, k int, term string").repartition(3)
    got = D.divergence(docs, min_docs=6, most_terms=9)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 9)


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_are_sent_in_parts(monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    rows = sample(3, 150)
    counts, got = D.Counts(), Counter()
    for lo in range(0, len(rows), 9):
        part = rows[lo : lo + 9]
        groups = np.array([counts.groups.setdefault((lang or "", source or ""), len(counts.groups)) for _, lang, source in part])
        for a, b, data, offsets in K.text_chunks(pa.array([t for t, _, _ in part], pa.string()), 400):
            counts.add(data, offsets, groups[a:b])
            sent = [*counts.rows(), *(counts.rows(last=True) if lo + 9 >= len(rows) and b == len(part) else ())]
            for r in (r for batch in sent for r in batch.to_pylist()):
                got[r["lang"], r["source"], r["term"], "n"] += r["n"]
                got[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
    want = Counter()
    for text, lang, source in rows:
        for term, n in Counter(terms_of(text)).items():
            want[lang or "", source or "", term, "n"] += n
            want[lang or "", source or "", term, "docs"] += 1
    assert got == want


def test_runs():
    pick = np.random.default_rng(1)
    for _ in range(50):
        dense = pick.choice([0, 0, 0, 1, 2, 7], (2, 40))
        dense[0, :5] = dense[0, 4]
        columns = []
        for x in dense:
            rows = np.flatnonzero(x)
            starts, values = D.runs(rows, x[rows], len(x))
            assert np.repeat(values, np.diff(np.append(starts, len(x)))).tolist() == x.tolist()
            assert (np.diff(values) != 0).all()
            columns.append((starts, D.shares(values, 10**30 + 7)))
        times = pick.integers(1, 5, 40)
        p, q = (np.array([1 + 10**9 * (int(c) + 5) // (10**30 + 7) for c in x]) for x in dense)
        assert D.run_distance(*columns, np.concatenate([[0], np.cumsum(times)])) == (abs(p - q) * times).sum()
    assert D.shares(np.array([3, 10**15, 3]), 10**16 + 3).tolist() == [1 + 10**9 * (c + 5) // (10**16 + 3) for c in (3, 10**15, 3)]
