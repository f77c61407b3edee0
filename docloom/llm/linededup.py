"""Line dedup: two Bloom filters find lines that may repeat; only those are confirmed and looked up.

The filters of once-seen and twice-seen keys are cut into segments (see bloom), each sized by its own keys and held by
one owner; lines that hit a twice-seen filter are suspects. Lines carry a 128-bit digest of their key;
grouping suspects by digest confirms repeats across documents and picks the smallest document. Lines found in more than
one in HOT_SHARE of all suspects, HOT_SHARE at most, learn their first document by broadcast, the others by join.

Nulls: a null or empty text is one empty line. A null id is one document that comes after all others; rows that
share an id are one document, and rows with equal ids and texts look up their lines together. Lines whose key is
shorter than min_chars stay. An empty table gives an empty result. Other columns are kept, whatever their names. A text
is split as a whole, at about 150 bytes for each of its lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bloom import suspects
from docloom.sources.store import written

HOT_SHARE = 1000
STRIP = b" \t\n\x0b\x0c\r"
LAST_ID = (1 << 63) - 1


def line_keys(text: bytes, min_chars: int) -> list[bytes]:
    """For each \\n-split line its key, or b"" if the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(STRIP).lower()  # on bytes, lower() changes A-Z only
        if len(key) < min_chars or (len(key) < 4 * min_chars and sum(c & 0xC0 != 0x80 for c in key) < min_chars):
            key = b""
        out.append(key)
    return out


def texts(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def repeated_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (doc, h, key, check) for the documents (doc, h, text): lines to drop, those of a digest that a document with a
    smaller id holds. key and check are the halves of the digest."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0

    def find(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        found, counts = [], []
        for text in texts(batch.column("text")):
            own = {k for k in line_keys(text, min_chars) if k}
            found += map(digest, own)
            counts.append(len(own))
        halves = np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)
        doc, h = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("doc", "h"))
        yield [halves[:, 0], doc, h, halves[:, 1].view(np.int64)]

    found = written(suspects(docs, find, {"doc": "near", "h": "long", "check": "long"}, lines), lines)
    n_found = found.count()
    counted = found.groupBy("key", "check").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
    confirmed = written(counted.filter("first < last").select("key", "check", "first", "n"), n_found)
    same = ["key", "check"]
    is_hot = F.col("n") * HOT_SHARE > n_found
    hot = F.broadcast(confirmed.filter(is_hot).drop("n"))
    by_broadcast = found.join(hot, same)
    by_shuffle = found.join(hot, same, "left_anti").join(confirmed.filter(~is_hot).drop("n"), same)
    return by_broadcast.union(by_shuffle).filter("doc > first").select("doc", "h", *same)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with text reduced to the lines that stay, and n_lines (before) and n_dropped; those replace columns of the same names.

    Keys of at least min_chars code points that two documents hold lose all their lines but those in the
    document with the smallest id, which must be an integer.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.struct(*kept).alias("given"))
    drops = repeated_lines(keyed.select("doc", "h", "text"), min_chars).groupBy("doc", "h").agg(F.flatten(F.collect_set(F.array("key", "check"))).alias("drops"))
    joined = keyed.drop("text").join(drops.hint("shuffle_hash"), ["doc", "h"], "left").select("given.*", F.col("drops").alias("n_dropped"))
    schema = docs.select(*kept).schema.add("n_lines", "long").add("n_dropped", "long")
    at = kept.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, out = [], [], []
            drops = batch.column("n_dropped")
            cuts, halves = drops.offsets.to_numpy() * 8, drops.values.to_numpy().tobytes()
            for i, text in enumerate(texts(batch.column(at))):
                parts = text.split(b"\n")
                lines.append(len(parts))
                gone = {halves[k : k + 16] for k in range(cuts[i], cuts[i + 1], 16)}
                if gone:
                    keys = line_keys(text, min_chars)
                    parts = [p for p, k in zip(parts, keys) if not k or digest(k) not in gone]
                    text = b"\n".join(parts)
                dropped.append(lines[-1] - len(parts))
                out.append(text)
            columns = [batch.column(i) for i in range(len(kept))]
            columns[at] = pa.array(out, pa.large_binary()).cast(pa.large_string()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*kept, "n_lines", "n_dropped"])

    return joined.mapInArrow(rewrite, schema)
