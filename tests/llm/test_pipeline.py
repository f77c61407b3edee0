"""The stages of the corpus pipeline against brute-force versions, each on its own input."""

import random
from collections import Counter

import pytest
from test_jaccard import brute
from test_text_operators import WORD, brute_lines, brute_measures

pytest.importorskip("public_tokenizers")
import corpus_pipeline as cp  # noqa: E402

from docloom.llm.quality import MEASURES  # noqa: E402

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = say(12)
    out = []
    for k in range(60):
        base = [say(rnd.randint(8, 30)) for _ in range(rnd.randint(3, 8))]
        if k % 5 == 0:
            base.insert(1, shared)
        out.append("\n".join(base))
        if k % 6 == 0:  # near copies whose lines all differ
            out += ["\n".join(line + f" end{c}" if i % 4 == 0 else line for i, line in enumerate([" ".join(base)])) for c in range(3)]
    out += [out[0], out[4], say(5), "", None, " ".join(x + "%%%" for x in say(60).split()), "stop " * 80]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(out)]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), KINDS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in cp.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "packing"]
    kept = cp.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = rows_of(kept)
    base = {r[0] for r in corpus() if len(WORD.findall(r[1] or "")) >= 20 and 100 * brute_measures(r[1])[MEASURES.index("n_repeat_words")] <= 30 * len(WORD.findall(r[1]))}
    junk = {r[0] for r in corpus() if "%%%" in (r[1] or "")}
    assert {r[0] for r in got} == base - junk

    lines = rows_of(cp.line_dedup(spark, spark.createDataFrame(got, KINDS), ""))
    want = {(i, text) for i, _, _, text in brute_lines(got)}
    assert {(r[0], r[1]) for r in lines} == want and all(r[4] == len(r[1]) for r in lines)

    single = rows_of(cp.jaccard_join(spark, spark.createDataFrame(lines, KINDS), ""))
    keep = {i for i, _, component in brute([(r[0], r[1]) for r in lines], 5, 80, 100) if i == component}
    assert single == [r for r in lines if r[0] in keep] and len(single) < len(lines)

    mix = rows_of(cp.mixing(spark, spark.createDataFrame(single, KINDS), ""))
    times = Counter(mix)
    assert set(times) <= set(single) and max(times.values()) <= 2
    size = lambda rows: sum(len(WORD.findall(r[1])) for r in rows)
    assert abs(size(mix) - 1.5 * size(single)) <= 0.05 * size(single)

    pieces = cp.packing(spark, spark.createDataFrame(mix, KINDS), "").collect()
    per_doc = Counter()
    for p in pieces:
        per_doc[p.doc_id] += p.length
    tokens = {p.doc_id: p.doc_tokens for p in pieces}
    copies = Counter(r[0] for r in mix)
    assert per_doc == {i: tokens[i] * n for i, n in copies.items()}
    assert len(cp.run(spark, str(tmp_path)).collect()) == len(pieces)
