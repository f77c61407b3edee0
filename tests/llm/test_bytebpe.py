"""Byte-level BPE against the library that reads the same rank files, and words whose hashes meet."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from docloom.llm import bytebpe as B
from docloom.llm import kernels as K
from docloom.llm.bpe import WordMemo
from docloom.llm.memo import SpanMemo
from docloom.llm.queries import op11_byte_bpe
from docloom.llm.wordpiece import Counter

PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: Two words that one fixed-constant 64-bit word hash does not tell apart.
MEETING = ("abcdefghijklmnop", "yjFIl3TF9blIgmFq")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n: int) -> list[str]:
    pieces = ["a", "s", "t", "re", "r", "ve", "ll", "l", "m", "d", "'", " ", "\n", "\t", "1", "٣", "é", "日", "!", "-", "  ", "'s", "'re", "👍", "　", "\x00", "\x85", "\xa0", "A", "hello", "Über", "Ᲊ", "²"]
    pick = random.Random(7)
    return ["".join(pick.choice(pieces) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_ids_and_offsets(library):
    coder = B.Coder(PATH)
    texts = odd_texts(4000) + ["", "'", "''s", "'s's're'", " 's", "x's", "\n's", "x" * 5000, "ab" * 3000, " " * 4000 + "a", "\n" * 999]
    for lo, _, data, offsets in K.text_chunks(pa.array(texts), 20_000):
        ids, places, rows = coder.encode(data, offsets)
        for i in range(len(rows) - 1):
            text, own = texts[lo + i], ids[rows[i] : rows[i + 1]].tolist()
            assert own == library.encode_ordinary(text)
            sizes = [len(coder.tokens[x]) for x in own]
            assert places[rows[i] : rows[i + 1]].tolist() == [sum(sizes[:k]) for k in range(len(sizes))]


def test_scans_compose():
    scanner = B.Scanner()
    pick = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 999, 1000, 5000):
        symbols = pick.integers(0, 2 * B.ROW, n).astype(np.uint8)
        state, want = B.FRESH, []
        for x in symbols.tolist():
            state, begins = B.step(state, x)
            want.append(begins)
        assert scanner.token_starts(symbols).tolist() == want
    one, two, three = pick.integers(0, scanner.size, (3, 500))
    assert (scanner.after(scanner.after(one, two), three) == scanner.after(one, scanner.after(two, three))).all()


def test_query_on_odd_rows(spark, tmp_path, library):
    long = " ".join(odd_texts(400)) * 60
    texts = [None, "", "one two", "one two", *MEETING, " ".join(MEETING), long]
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(texts)] + [(2, "one two", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = [tuple(r) for r in op11_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_columns_that_clash_and_decoding(spark):
    docs = spark.createDataFrame([(1, "héllo wörld", 5, "z"), (2, None, 6, "z")], "doc_id long, text string, ids int, decoded string")
    out = B.decode(B.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "offsets", "decoded"]
    first, second = out.orderBy("doc_id").collect()
    assert bytes(first.decoded).decode() == "héllo wörld" and bytes(second.decoded) == b"" and second.ids == []
    for k in range(len(first.ids)):  # offsets tell what part of the text a run of ids is
        tail = spark.createDataFrame([(first.ids[k:],)], "ids array<int>")
        assert bytes(B.decode(tail, PATH).first().decoded) == "héllo wörld".encode()[first.offsets[k] :]
    assert B.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).first().decoded is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([([1 << 30],)], "ids array<int>"), PATH).collect()
    assert B.encode(docs.limit(0), PATH).count() == 0 == B.decode(B.encode(docs.limit(0), PATH), PATH).count()


def test_memos_compare_bytes():
    made = []
    memo = SpanMemo(lambda b: made.append(b) or list(b), places=4, most_values=200, most_long=3)
    pick = random.Random(5)
    known = ["".join(pick.choice("ab") for _ in range(pick.randint(0, 24))) for _ in range(60)]
    for _ in range(20):
        words = [pick.choice(known).encode() for _ in range(50)]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        at, count = memo.lookup(data, ends - [len(w) for w in words], ends)
        assert [bytes(memo.values[a : a + n].tolist()) for a, n in zip(at, count)] == words
    assert set(made) <= {k.encode() for k in known}


def test_words_whose_hashes_meet():
    text = " ".join(MEETING).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    memo = WordMemo(P.path("byte_bpe_50k.json"))
    assert memo.encode(data, offsets)[0].tolist() == memo.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    counter = Counter(P.path("byte_bpe_50k.json"))
    starts, ends, _ = K.words(data, offsets)
    alone = [Counter(P.path("byte_bpe_50k.json"))(data, starts[i : i + 1], ends[i : i + 1])[0] for i in (0, 1)]
    assert counter(data, starts, ends).tolist() == alone


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in docs.select("doc_id", F.coalesce("text", F.lit(""))).collect():
        ids = library.encode_ordinary(text)
        assert got[doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
