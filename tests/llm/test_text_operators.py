import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import kernels as K
from docloom.llm.bloom import dealt, suspects
from docloom.llm.bpe import WordMemo
from docloom.llm.jaccard import jaccard_components
from docloom.llm.language import fit, identify, viterbi
from docloom.llm.linededup import dedup_lines
from docloom.llm.packing import WINDOW, pack
from docloom.llm.quality import judged, measure, measure_chunk, thresholds
from docloom.llm.substring import dedup_substrings
from docloom.llm.wordpiece import Automaton, count_pieces
from docloom.llm.wordpiece import vocabulary as pieces_in

P = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", " ", "\n", "\n\n", "a", " a\n", "é à\tb", "x " * 3000, "Der Fluß 日本語 テスト", "a\x00b \x1f c\x85d e", "# * $ % & | < >", None]


def texts(seed, n=120):
    """Invented texts that share lines, passages and whole copies, and the odd ones."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(25)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    out = []
    for _ in range(n):
        parts = [rnd.choice(lines) if rnd.random() < 0.4 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25))) for _ in range(rnd.randint(1, 8))]
        if rnd.random() < 0.3:
            own = passage.split()[rnd.randint(0, 20) : rnd.randint(36, 60)]
            parts.insert(rnd.randint(0, len(parts)), " ".join(own))
        if rnd.random() < 0.1:
            parts.append("again and " * 40)
        out.append(rnd.choice(["\n", " \n", "\n "]).join(parts).swapcase() if rnd.random() < 0.1 else "\n".join(parts))
    return out + rnd.sample(out, 10) + ODD


def docs_of(spark, seed):
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 7 else None, len(t or ""), "clash") for i, t in enumerate(texts(seed))]
    rows += [(None, "a null id with a line of its own\n" + rows[3][1], "en", "s1", 0, "clash"), rows[5], rows[6]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_dropped string")


def test_words_and_windows_equal_python():
    column = pa.array([t or "" for t in texts(3)])
    seen = {}
    for lo, hi, data, offsets in K.text_chunks(column, 4000):
        starts, ends, at = K.words(data, offsets)
        hashes = K.span_hashes(data, starts, ends)
        raw = data.tobytes()
        for i in range(hi - lo):
            own = [raw[s:e].decode() for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])]
            assert own == WORD.findall(column[lo + i].as_py())
            for w, h in zip(own, hashes[at[i] : at[i + 1]].tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute_lines(rows):
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders[line_key(line)].add(float("inf") if i is None else i)
    out = []
    for i, t, *_ in rows:
        me, lines = float("inf") if i is None else i, (t or "").split("\n")
        kept = [x for x in lines if len(line_key(x)) < 10 or me == min(holders[line_key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows, docs = docs_of(spark, seed)
    found = dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=str) == brute_lines(rows)
    assert dedup_lines(docs.limit(0)).collect() == []


def brute_windows(rows, n):
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for (i, *_), w in zip(rows, words):
        gone = {j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,most", [(1, 400), (2, 3)])
def test_substring_dedup(spark, seed, most, monkeypatch):
    monkeypatch.setattr("docloom.llm.substring.MOST_CONTEXTS", most)
    rows, docs = docs_of(spark, seed)
    found = dedup_substrings(docs, window=35).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in found), key=str) == brute_windows(rows, 35)
    assert all(sum(s.end - s.start for s in r.removed_spans) == r.n_removed for r in found)
    assert dedup_substrings(docs.limit(0)).collect() == []


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    twice = Counter(grams)
    repeats = {j for k, g in enumerate(grams) if twice[g] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    marks = re.findall(r"[!-/:-@\[-`{-~]", t)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeats), len(marks), max(Counter(w).values(), default=0), len(set(w)), sum(a == b for a, b in zip(w, w[1:]))]


def test_quality_measures_equal_python():
    own = [t or "" for t in texts(4)]
    for lo, hi, data, offsets in K.text_chunks(pa.array(own), 3000):
        assert np.stack(measure_chunk(data, offsets), axis=1).tolist() == [brute_measures(t) for t in own[lo:hi]]


def test_quality_rules_keep_clean_and_drop_junk(spark):
    rnd = random.Random(1)
    plain = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rnd.randint(0, 99)) for _ in range(60)) for _ in range(300)]
    junk = [t.replace(" ", "%%% ", 40) for t in plain[:40]]
    rows = [(i, t, "en", "a" if i % 2 else None, 0, "x") for i, t in enumerate(plain + junk + ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long, kept string")
    measured = measure(docs)
    got = {r.doc_id: r for r in judged(measured, thresholds(measured)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(300)) and not any(got[i].kept for i in range(300, 340))
    assert all(got[i].base_failed for i in range(340, 340 + len(ODD)))
    empty = measure(docs.limit(0))
    assert judged(empty, thresholds(empty)).collect() == []


def test_fences_follow_the_source(spark):
    """A text that is usual in one source is an outlier in another, for each metric."""
    rnd = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("na", "ti", "su", "ve") for c in ("r", "s", "nt", "la")]

    def say(marks=0.1, common=0.05, stutter=0.01, long=False, n=200):
        words = [rnd.choice(vocabulary) if rnd.random() > common else "the" for _ in range(n)]
        words = [w * 3 if long and w != "the" else w for w in words]
        for i in range(1, n):
            if rnd.random() < stutter:
                words[i] = words[i - 1]
        return " ".join(w + ("," if rnd.random() < marks else "") for w in words)

    odd = {"marks": dict(marks=0.9), "common": dict(common=0.6), "stutter": dict(stutter=0.4), "word_length": dict(long=True)}
    rows = [(say(), "plain") for _ in range(400)] + [(say(**how), name) for name, how in odd.items() for _ in range(400)]
    rows += [(say(n=2000), "plain") for _ in range(3)] + [(say(n=2000), "long") for _ in range(400)]  # many words, few of them distinct
    rows += [(say(**how), "plain") for how in odd.values()]
    docs = spark.createDataFrame([(i, t, "xx", s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    measured = measure(docs)
    limits = {r["of"].source: r.fences for r in thresholds(measured).collect()}
    for name, metric in [("marks", "marks_high"), ("common", "common_high"), ("stutter", "stutter_high"), ("word_length", "word_length_high"), ("long", "distinct_low")]:
        assert limits[name][metric] != limits["plain"][metric]
    got = {r.doc_id: r for r in judged(measured, thresholds(measured)).collect()}
    lost = Counter(r.source for r in got.values() if not r.kept and not r.base_failed and r.source not in ("plain", "long"))
    assert all(n <= 8 for n in lost.values()), lost
    failed = lambda ids: [not got[i].kept and not got[i].base_failed for i in ids]
    assert all(failed(range(len(rows) - len(odd), len(rows)))) and all(failed(range(2000, 2003)))
    assert sum(failed(range(400))) <= 8 and sum(failed(range(2003, 2403))) <= 8


def test_words_that_a_polynomial_hash_takes_for_equal():
    """A Thue-Morse word and its complement, and such sequences of words."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, other = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    pair = pa.array([one, other, " ".join(one), " ".join(other), one[:1024], other[:1024]])
    (_, _, data, offsets), = K.text_chunks(pair)
    starts, ends, at = K.words(data, offsets)
    hashes = K.span_hashes(data, starts, ends)
    assert len({*hashes[:2].tolist(), *hashes[-2:].tolist()}) == 4
    grams = K.gram_hashes(hashes, 2048)
    assert grams[at[2]] != grams[at[3]]
    memo = WordMemo(P.path("byte_bpe_50k.json"))
    ids, rows = memo.encode(data, offsets)
    assert ids[rows[0] : rows[1]].tolist() != ids[rows[1] : rows[2]].tolist()


#: Two words that the unseeded hash does not tell apart, and a text for each that is equal but for them.
MEETING = ("abcdefghijklmnop", "yjFIl3TF9blIgmFq")


def test_words_that_an_unseeded_hash_takes_for_equal(spark):
    text = " ".join(MEETING)
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = K.words(data, np.array([0, len(data)]))
    hashes = [K.span_hashes(data, starts, ends, K.new_seed()) for _ in range(3)]
    assert all(len(set(h.tolist())) == 2 for h in hashes) and len({h[0] for h in hashes}) == 3
    filler = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*filler[:30], w, *filler[30:]]), "en", "s") for i, w in enumerate(MEETING)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.n_removed for r in dedup_substrings(docs, window=35).collect()} == {0}
    assert {r.component_id for r in jaccard_components(docs, n=3, num=99, den=100).collect()} == {0, 1}
    twice = docs.withColumn("text", F.lit(" ".join([*filler[:7], MEETING[0], *filler[:7], MEETING[1]])))
    assert {r.n_repeat_words for r in measure(twice).collect()} == {0}


def test_memo_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    own = [t or "" for t in texts(5)] + ["don't x's, y.. ...z é% %%% a1 b2, 日本. __ - a- \"q\" (r) ª º. Ⅳ ²3 ـ. <|endoftext|>", "j　 k .­x f g  h i  l"]
    memo = WordMemo(path)
    for _ in range(2):
        for lo, hi, data, offsets in K.text_chunks(pa.array(own), 5000):
            ids, at = memo.encode(data, offsets)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in own[lo:hi]]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows, docs = docs_of(spark, 6)
    pieces = [r.asDict() for r in pack(docs, path).collect()]
    ids = {i: np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in rows}
    copies = Counter(i for i, *_ in rows)
    assert sum(p["length"] for p in pieces) == sum(len(ids[i]) * n for i, n in copies.items())
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
    cover = Counter((p["doc_id"], k) for p in pieces for k in range(p["start"], p["start"] + p["length"]))
    assert all(n == copies[i] for (i, _), n in cover.items())
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in by_sequence.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= WINDOW
    assert pack(docs.limit(0), path).collect() == []


def test_pieces_equal_greedy_longest_match(spark):
    rnd = random.Random(2)
    vocabulary = {bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 5))) for _ in range(30)} - {b"c"}

    def greedy(word):
        n = 0
        while word:
            size = max((k for k in range(1, len(word) + 1) if word[:k] in vocabulary), default=0)
            if not size:
                return -1
            word, n = word[size:], n + 1
        return n

    automaton = Automaton(sorted(vocabulary))
    for _ in range(3000):
        word = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 14)))
        assert automaton.count(word) == greedy(word), word
    rows, docs = docs_of(spark, 7)
    got = count_pieces(docs, P.path("byte_bpe_50k.json")).collect()
    known = set(pieces_in(P.path("byte_bpe_50k.json")))
    longest = max(map(len, known))

    def pieces(word):
        rest, n = b" " + word.encode(), 0
        while rest:
            size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in known), 0)
            if not size:
                return None
            rest, n = rest[size:], n + 1
        return n

    def counts(text):
        own = [pieces(w) for w in WORD.findall(text or "")]
        return len(own), sum(1 if n is None else n for n in own), own.count(None)

    assert sorted(((r.doc_id, r.n_words, r.n_pieces, r.n_unknown) for r in got), key=str) == sorted(((i, *counts(t)) for i, t, *_ in rows), key=str)
    assert count_pieces(docs.limit(0), P.path("byte_bpe_50k.json")).collect() == []


def test_viterbi_equals_all_labellings():
    rng = np.random.default_rng(4)
    lengths = [0, 1, 5, 3, 6, 0, 2]
    at = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(at[-1], 3)).astype(np.float32)
    for switch in (0.0, 0.7, 3.0):
        labels = viterbi(scores, at, switch)
        for a, b in zip(at, at[1:]):
            value = lambda way: sum(float(scores[a + i][x]) for i, x in enumerate(way)) - switch * sum(x != y for x, y in zip(way, way[1:]))  # noqa: B023, E731
            best = max(map(value, itertools.product(range(3), repeat=b - a)))
            assert abs(value(labels[a:b].tolist()) - best) < 1e-5
    wide = np.zeros((4, 300), np.float32)
    wide[:, 299] = 9
    assert viterbi(wide, np.array([0, 4]), 1.0).tolist() == [299] * 4


def test_language_needs_a_letter(spark):
    learned = [(i, "дом лес река" if i % 2 else "the wing thing", "zz" if i % 2 else "xx") for i in range(80)]
    bare = ["\U0001f600 \U0001f680\U0001f600", "٣٤٥ ١٢", "१२३ ४५", "๑๒๓", "\u0300\u0301 \u0308", "،؛؟", "। ॥", "12 \U0001d7d8", "\u20ac \u2603", "\ufe0f"]
    lettered = ["\U0001f600 the", "\u0301дом", "１２ ａ", "々", "ⁿ", "\U00020000", "ª"]
    rows = learned + [(100 + i, t, None) for i, t in enumerate(bare)] + [(200 + i, t, None) for i, t in enumerate(lettered)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(docs, fit(docs, "doc_id", "text", "lang")).collect()}
    for i, t in enumerate(bare):
        assert (got[100 + i].lang_pred, got[100 + i].score, got[100 + i].spans) == ("und", 0.0, []), t
    for i, t in enumerate(lettered):
        assert got[200 + i].lang_pred in ("xx", "zz") and got[200 + i].score == 1.0, t
    assert [got[i].lang_pred for i in (200, 201)] == ["xx", "zz"]


def test_language_spans(spark):
    rnd = random.Random(3)
    stems = {"xx": ["tion", "ing", "the", "wh"], "yy": ["schö", "ung", "lich", "keit"], "zz": ["дом", "лес", "рек", "мир"]}
    say = lambda lang, n: " ".join("".join(rnd.choice(stems[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(list(stems) * 60)]
    rows += [(900, say("xx", 30) + " " + say("yy", 20) + " " + say("zz", 10), None), (901, None, "xx"), (902, "12 34 %", "xx"), (903, "", None), (None, say("xx", 5), "xx")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(docs, fit(docs, "doc_id", "text", "lang")).collect()}
    held_out = [i for i, _, lang in rows[:180] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held_out and all(got[i].lang_pred == rows[i][2] for i in held_out)
    assert [(s.start, s.end, s.lang) for s in got[900].spans] == [(0, 30, "xx"), (30, 50, "yy"), (50, 60, "zz")]
    assert [(got[i].lang_pred, got[i].score) for i in (901, 902, 903)] == [("und", 0.0)] * 3
    nothing = identify(docs, fit(docs.limit(0), "doc_id", "text", "lang")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert identify(docs.limit(0), fit(docs, "doc_id", "text", "lang")).collect() == []


@pytest.mark.parametrize("flush,segment", [(40, 60), (1 << 19, 1 << 19)])
def test_suspects_are_all_repeats(spark, flush, segment, monkeypatch):
    """Keys that occur twice pass with all their rows, whether they meet in a flush or at their owner."""
    monkeypatch.setattr("docloom.llm.bloom.FLUSH", flush)
    monkeypatch.setattr("docloom.llm.bloom.SEGMENT_KEYS", segment)
    rnd = np.random.default_rng(6)
    keys = np.concatenate([rnd.integers(0, 400, 500), np.full(300, 7), np.arange(1000, 1500)])
    rows = [(i, int(K.mix(np.array([k], np.uint64))[0].view(np.int64)), i if i % 50 else 1 << 62) for i, k in enumerate(rnd.permutation(keys))]
    given = spark.createDataFrame(rows, "i int, k long, doc long").repartition(5)

    def find(batch):
        yield [batch.column("k").to_numpy().view(np.uint64), batch.column("doc").to_numpy(), batch.column("i").to_numpy()]

    got = [(r.key, r.doc, r.i) for r in suspects(given, find, {"doc": "near", "i": "int"}, len(rows)).collect()]
    times = Counter(k for _, k, _ in rows)
    wanted = {(k, doc, i) for i, k, doc in rows if times[k] > 1}
    assert len(got) == len(set(got)) and wanted <= set(got) <= {(k, doc, i) for i, k, doc in rows}
    assert len(got) - len(wanted) < 20
    assert suspects(given.limit(0), find, {"doc": "near", "i": "int"}, 0).collect() == []


def test_clashing_names_and_repeated_rows(spark):
    """Columns named like an operator's own, and a table of one row repeated."""
    line = "a line that is long enough"
    names = ["doc_id", "text", "doc", "h", "given", "spans", "drops", "group", "of", "fences", "base_failed", "marks_low", "n_words", "removed_spans", "n_pieces", "lang", "source"]
    schema = ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names)
    same = spark.createDataFrame([(None, " ".join([line] * 12), *"x" * 15)] * 40, schema)
    assert {(r.n_dropped, r.doc, r.h, r.drops) for r in dedup_lines(same).collect()} == {(0, "x", "x", "x")}
    assert {(r.n_removed, r.n_words, r.spans, r.text) for r in dedup_substrings(same).collect()} == {(72, 72, "x", "")}
    measured = measure(same)
    got = judged(measured, thresholds(measured)).collect()
    assert len(got) == 40 and {(r.of, r.fences, r.group, r.base_failed) for r in got} == {("x", "x", "x", True)}
    assert {(r.n_words, r.h) for r in count_pieces(same, P.path("byte_bpe_50k.json")).collect()} == {(72, "x")}


def test_a_very_long_text(spark):
    text = " ".join(f"w{i % 5000} x{i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, "short one here", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.n_words for r in measure(docs).collect()} == {1: 800_000, 2: 3, 3: 0}
    assert {r.doc_id: r.n_removed for r in dedup_substrings(docs).collect()} == {1: 0, 2: 0, 3: 0}
    assert {r.doc_id: r.n_dropped for r in dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 0}


def test_substring_dedup_of_many_equal_rows(spark):
    """Rows equal in id and text, null ids with one text, and a near copy whose contexts differ."""
    rnd = random.Random(9)
    own = [f"v{rnd.randint(0, 10**6)}" for _ in range(400)]
    near = own[:150] + ["other"] + own[151:330] + ["last"]
    rows = [(7, " ".join(own))] * 2000 + [(None, " ".join(own[:90] + own[:90]))] * 300 + [(8, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedup_substrings(docs, window=35)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect())
    assert got == Counter(brute_windows(rows, 35))
    assert max(len(r.removed_spans) for r in found.collect()) <= 2


def test_owners_of_anchors_hold_alike(spark, monkeypatch):
    """Anchors are smallest hashes; still no owner gets many more of them than the others."""
    held = []

    def seen(rows, find, payload, keys):
        sizes = dealt(rows, find, payload, keys).filter("kind = 0").selectExpr("segment", "size(key) AS n").groupBy("segment").sum("n").collect()
        held.append([n for _, n in sizes])
        return suspects(rows, find, payload, keys)

    monkeypatch.setattr("docloom.llm.bloom.SEGMENT_KEYS", 300)
    monkeypatch.setattr("docloom.llm.substring.suspects", seen)
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(1000))) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in dedup_substrings(docs, window=35).collect()} == {0}
    anchors = held[0]
    assert len(anchors) > 8 and sum(anchors) > 2000
    assert max(anchors) < 1.5 * sum(anchors) / len(anchors)
