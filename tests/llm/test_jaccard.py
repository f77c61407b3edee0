import random
import re

import numpy as np
import pytest

from docloom.llm.jaccard import Sets, jaccard_components, join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    """Rows (doc_id, n_shingles, component_id) by comparing all pairs; rows with one id are one document."""
    sets = [shingles(t, n) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:k]):
            if a is None or b is None or not sets[k] or not sets[j]:
                continue
            if den * len(sets[k] & sets[j]) >= num * len(sets[k] | sets[j]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets)), key=str)


def near_copies(seed, groups, copies, length, edits):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.randint(*length))]
        for _ in range(rnd.randint(1, copies)):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            out.append(" ".join(own))
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("seed,n,num,den,chunk", [(1, 3, 90, 100, 1 << 20), (2, 3, 90, 100, 1500), (3, 5, 80, 100, 1500)])
def test_equals_all_pairs(spark, seed, n, num, den, chunk, monkeypatch):
    if seed > 1:  # many flushes and segments, so that keys meet at their owners
        monkeypatch.setattr("docloom.llm.bloom.FLUSH", 50)
        monkeypatch.setattr("docloom.llm.bloom.SEGMENT_KEYS", 300)
    texts = near_copies(seed, 12, 30, (8, 120), 6) + ["", " \n", "one", "one", "one two", "One  TWO", None, None, "x " * 5000]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (3, "another text under one id"), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, n, num, den, chunk=chunk).collect()), key=str)
    assert got == brute(rows, n, num, den)


@pytest.mark.parametrize("seed", [4, 5])
def test_common_passages(spark, seed, monkeypatch):
    """Texts that share passages, near copies among them: hot keys everywhere."""
    monkeypatch.setattr("docloom.llm.bloom.FLUSH", 200 if seed == 5 else 1 << 19)
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 5000)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    texts = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(5, 80))), rnd.choice(passages), rnd.choice(passages)]
        rnd.shuffle(parts)
        texts.append(" ".join(parts))
    for t in list(texts[:25]):
        for _ in range(rnd.randint(1, 4)):
            own = t.split()
            for _ in range(rnd.randint(0, len(own) // 40)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, 5, 80, 100).collect()), key=str)
    assert got == brute(rows, 5, 80, 100)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs, 3, 90, 100).collect() == []


def test_tree_join_equals_all_pairs():
    rnd = np.random.default_rng(5)
    base = [rnd.integers(0, 1 << 63, rnd.integers(3, 200)).astype(np.uint64) for _ in range(6)]
    sets = []
    for _ in range(300):
        b = base[rnd.integers(6)]
        drop = rnd.integers(0, max(1, len(b) // 6) + 1)
        extra = rnd.integers(0, 1 << 63, rnd.integers(0, 4)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rnd.permutation(b)[drop:], extra])))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    whole = Sets(np.concatenate(sets), at, np.arange(len(sets)))
    list(join(whole, None, 90, 100))
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if common and 100 * common >= 90 * (len(sets[i]) + len(sets[j]) - common):
                x, y = parent[i], parent[j]
                parent = [x if p == y else p for p in parent]
    same = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == v).tolist()) for v in set(np.array(labels).tolist())}
    assert same(whole.labels) == same(parent)


def test_files_follow_rows_not_partitions(spark, tmp_path, monkeypatch):
    """Small tables that are dealt over many partitions are not written as a file for each."""
    from docloom.llm import jaccard as module
    from docloom.operators import components as links

    for m in (module, links):
        monkeypatch.setattr(m, "forget", lambda *tables: None)
    monkeypatch.setattr("docloom.sources.store.shared_dir", lambda spark: str(tmp_path))
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        base = [f"w{rnd.randint(0, 500)}" for _ in range(60)]
        rows += [" ".join([*base[:cut], f"x{cut}", *base[cut:]]) for cut in (1, 30)]
    rows = list(enumerate(rows))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 80, 100).collect()), key=str)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == sorted(brute(rows, 3, 80, 100), key=str) and any(i != c for i, _, c in got)
    files = [len(list(table.glob("part-*"))) for table in tmp_path.iterdir()]
    assert sum(n > 1 for n in files) <= 1, files  # the links that components starts from
