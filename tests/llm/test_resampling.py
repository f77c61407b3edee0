"""Importance resampling against a plain computation, and the radix sort against sorting."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import kernels as K
from docloom.llm import radix
from docloom.llm.queries import op12_importance_resampling
from docloom.llm.resampling import crcs, features, gains, id_keys, importance_resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def features_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain(rows, targets, percent=25, min_words=20, seed=7):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, in any order."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own, target = (Counter(bucket(f) for t in texts for f in features_of(t)[1]) for texts in ([t for _, t in rows], targets))
    s_all, t_all = sum(own.values()), sum(target.values())
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((own[b] + 1) * (t_all + 10000))))
    out = []
    for doc_id, text in rows:
        words, found = features_of(text)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = k
    return [tuple(r[:5]) for r in out]


def sample_rows(n, seed):
    pick = random.Random(seed)
    words = [f"wOrd{i}" for i in range(60)] + ["É", "日本", "a-b", "x\x00y", "naïve", "42"]
    texts = [" ".join(pick.choice(words) for _ in range(pick.choice([0, 3, 19, 20, 21, 80]))) for _ in range(n)]
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0] + " end" * 30), (10**17, None), (10**17 + 1, ""), (10**17 + 2, "Long " * 40_000), rows[5], rows[5]]


def test_features():
    texts = [t for _, t in sample_rows(80, 1)] + ["z" * 500 + " " + "é" * 300 + " q"]
    for lo, hi, data, offsets in K.text_chunks(pa.array(texts), 700):
        n, single, double, pairs = features(data, offsets)
        at = np.concatenate([[0], np.cumsum(n)])
        for i in range(hi - lo):
            words, found = features_of(texts[lo + i])
            assert n[i] == len(words)
            got = [*single[at[i] : at[i + 1]].tolist(), *double[pairs[i] : pairs[i + 1]].tolist()]
            assert got == [zlib.crc32(f.encode()) % 10000 for f in found]


def test_crcs_go_on():
    data = np.frombuffer(b"abcdefghij" * 20, np.uint8)
    starts, ends = np.array([0, 3, 5, 0]), np.array([3, 3, 200, 100])
    before = np.array([zlib.crc32(b"xy"), 7, 0, zlib.crc32(b"q")], np.uint32)
    assert crcs(data, starts, ends, before).tolist() == [zlib.crc32(data[s:e].tobytes(), int(b)) for s, e, b in zip(starts, ends, before)]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_draw(spark, tmp_path, seed):
    rows = sample_rows(300, seed)
    targets = ["word1 word2 word3 42 naïve"] * 5 + [None, ""]
    spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, id int, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = op12_importance_resampling(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(plain(rows, targets), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert importance_resample(docs.limit(0), docs).count() == 0
    (row,) = importance_resample(docs, docs.limit(0), percent=100).collect()
    own = np.bincount([zlib.crc32(b"a") % 10000] * 30 + [zlib.crc32(b"a a") % 10000] * 29, minlength=10000)
    gain = gains(own, np.zeros(10000, np.int64))[np.flatnonzero(own)]
    assert row["rank"] == 1 and row["weight"] in {(30 * a + 29 * b) // 59 for a, b in (gain, gain[::-1])}


@pytest.mark.parametrize("block_bits,digit_bits,word_bits", [(3, 2, 7), (5, 4, 62), (15, 12, 62)])
def test_radix_ranks(spark, monkeypatch, block_bits, digit_bits, word_bits):
    for name, value in (("BLOCK_BITS", block_bits), ("DIGIT_BITS", digit_bits), ("WORD_BITS", word_bits)):
        monkeypatch.setattr(radix, name, value)
    pick = random.Random(block_bits)
    rows = [(5 if i % 3 == 0 else pick.randint(0, 31), pick.randint(0, 100), i, "t" * (i % 3)) for i in range(400)]
    table = spark.createDataFrame(rows, "a int, b long, place int, note string").repartition(3)
    got = radix.radix_ranks(table.withColumnRenamed("place", "c"), [(F.col("a"), 5), (F.col("b"), 7)]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 401))
    assert [(r.a, r.b) for r in got] == sorted((a, b) for a, b, _, _ in rows)
    assert sorted((r.a, r.b, r.c, r.note) for r in got) == sorted(rows)
    # Stable: with c as the least significant key ties are gone.
    exact = radix.radix_ranks(table.withColumnRenamed("place", "c"), [(F.col("a"), 5), (F.col("b"), 7), (F.col("c"), 9)]).orderBy("rank").collect()
    assert [(r.a, r.b, r.c) for r in exact] == sorted((a, b, c) for a, b, c, _ in rows)


def test_ids_of_any_size(spark):
    ids = [-(2**63), 2**63 - 1, 0, None, -1, 5, 2**40]
    table = spark.createDataFrame([(i,) for i in ids], "id long")
    got = radix.radix_ranks(table, id_keys(-(2**63), 2**63 - 1)).orderBy("rank").collect()
    assert [r.id for r in got] == sorted((i for i in ids if i is not None)) + [None]
