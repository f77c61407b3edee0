"""N-gram Jaccard self-join with signature trees.

Documents with equal shingle sets are one class, kept by its smallest id. Classes that can link are brought
together without loss: two sets of at most u shingles with similarity t differ in at most d = 2u(1-t)/(1+t)
shingles, so when the hash space is cut into d + 1 + r buckets, at least r + 1 buckets hold the same shingles of both. The
content of a bucket is a key. Sizes are handled in classes of ratio SIZE_RATIO; a set also emits the keys of the next
larger class if a partner can be there. Keys of whole buckets are equal for near copies and rarely else. They go, 39
bits of each, to the owner of their segment (see bloom), which counts each key's documents and names the smallest, its
hub. Owners hold a bounded number of keys whatever the input, and a hot key reaches its owner once from every flush of a task.

Of its d + 1 + r keys each set leaves out the r most frequent (ties by key). As frequency is one order for all, the d + 1
others of two sets that link still share a key. So a document with r shared keys or fewer is in no block at all, and keys of common
passages fall away first. All classes that have kept keys of one hub are that hub's block; a class can be in several.

Each block is joined with itself by signature trees: leaves hold a set's token bitmap and size, inner nodes the
OR of the bitmaps, the range of sizes and the most tokens that bits can hide. A dual traversal follows pairs of
nodes and drops a pair if the largest overlap its bitmaps and sizes allow is below what the smallest sizes need,
or if all its documents are in one component already; pairs of leaves are verified on the full sets. Blocks of
more than CHUNK shingles are dealt out in chunks that each also hold the block's smallest class. What has then been
linked to that class needs no more comparing within itself; the rest is compared with everything, by pairs
of chunks. So a huge group of near copies costs a pass, not all pairs, and no link is lost.

Nulls: texts without words have the empty set and link with nothing. Rows with a null id are never linked. Rows
that share an id are one document with the links of each. An empty table gives an empty result. Columns other than
the id and the text are not looked at. A text is hashed as a whole, at about 40 bytes for each of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import kernels as K
from docloom.llm.bloom import HEAD, KNOWN, SINGLE, dealt, unpacked
from docloom.operators.components import components
from docloom.sources.store import forget, written

SIZE_RATIO, SPARE, FANOUT, LEADERS = 1.3, 0.15, 8, 8
#: Shingles of a chunk of a block, where each set counts SET_COST more for its bitmap.
CHUNK, SET_COST = 1 << 21, 128
#: Of how many keys there is a task of owners, and of how many shingles in blocks one that compares sets, where the shuffle has more.
OWNER_KEYS, BLOCK_SHINGLES = 1 << 17, 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in rising order, and the rows' offsets among them."""
    data = K.LOWER[data]
    starts, ends, at = K.words(data, offsets)
    counts = np.diff(at)
    words = K.span_hashes(data, starts, ends, seed)
    row_of = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(np.arange(len(words)) + n <= at[1:][row_of])
    row, hashes = row_of[first], K.gram_hashes(words, n)[first]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            own = K.gram_hashes(K.ragged(words, at[short], counts[short]), k)[::k]
            row, hashes = np.concatenate([row, short]), np.concatenate([hashes, own])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[new], hashes[new]
    return hashes, np.searchsorted(row, np.arange(len(counts) + 1))


class Classes:
    """Size classes and their numbers of buckets for a similarity of num / den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40):
        self.num, self.den = num, den
        edges, x = [1], 1.0
        while edges[-1] <= largest:
            x *= SIZE_RATIO
            edges.append(max(edges[-1] + 1, math.ceil(x)))
        self.low = np.array(edges, np.int64)
        high = self.low[1:] - 1
        differ = 2 * high * (den - num) // (den + num)
        self.spare = np.ceil(SPARE * (differ + 1)).astype(np.int64) + (differ < 7)
        self.buckets = np.where(differ > 0, differ + 1 + self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1

    def reaches(self, sizes: np.ndarray, klass: np.ndarray) -> np.ndarray:
        """Whether a set of that size can link with the smallest one of a larger class."""
        return self.den * sizes >= self.num * self.low[klass]


def keys(hashes: np.ndarray, at: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, each one's row, each one's size class)."""
    sizes = np.diff(at)
    rows = np.flatnonzero(sizes)
    own = classes.of(sizes[rows])
    row = np.concatenate([rows, rows])
    klass = np.concatenate([own, own + 1])
    use = classes.buckets[klass] > 0
    use[len(rows) :] &= classes.reaches(sizes[rows], own + 1)
    row, klass = row[use], klass[use]
    buckets = classes.buckets[klass]
    base = np.cumsum(buckets) - buckets
    lengths = sizes[row]
    values = K.ragged(hashes, at[row], lengths)
    segment = np.repeat(base, lengths) + ((values >> np.uint64(32)) * np.repeat(buckets, lengths).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    total = int(buckets.sum())
    content = np.zeros(total, np.uint64)
    if len(segment):
        edges = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        content[segment[edges]] = np.add.reduceat(K.mix(values), edges)
    part = np.repeat(np.arange(len(row)), buckets)
    place = (np.arange(total) - base[part]).astype(np.uint64)
    key = K.mix(content ^ K.mix((klass[part].astype(np.uint64) << np.uint64(48)) + place * np.uint64(64) + np.uint64(1)))
    return key, row[part], klass[part]


def prints(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """A 128-bit fingerprint of each set, as two numbers."""
    out = []
    for values in (hashes, K.mix(hashes ^ K.U(0xA5A5))):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        out.append(K.mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out


def describe(docs: DataFrame, n: int, classes: Classes) -> DataFrame:
    """Rows (doc_id, n_shingles, f1, f2, spare); f1 and f2 are the fingerprint of the set, spare is how many keys of an even and of
    an odd size class it leaves out."""

    seed = K.new_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                hashes, at = shingle_sets(data, offsets, n, seed)
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at)), *map(pa.array, prints(hashes, at))]
                own = classes.of(np.maximum(np.diff(at), 1))
                spare = classes.spare[np.stack([own + own % 2, own + (own + 1) % 2], axis=1)]
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * 2, pa.int32()), pa.array(spare.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "spare"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, spare array<long>")


ENTRY = {"doc": "near", "tag": "tiny"}


def _entries(n: int, classes: Classes):
    """Finds (key, document, tag) for the keys of a batch's sets, each different set once; tags hold bits 32 to 38 of the key
    and, lowest, whether its size class is odd."""

    seed = K.new_seed()

    def find(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
        seen: set[int] = set()
        for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
            hashes, at = shingle_sets(data, offsets, n, seed)
            sizes, fresh = np.diff(at), []
            for i, f in enumerate(prints(hashes, at)[0].tolist()):
                if sizes[i] and f not in seen:
                    seen.add(f)
                    fresh.append(i)
            own = np.array(fresh, np.int64)
            lengths = sizes[own]
            key, row, klass = keys(K.ragged(hashes, at[own], lengths), np.concatenate([[0], np.cumsum(lengths)]), classes)
            doc = batch.column("doc_id").slice(lo, hi - lo).to_numpy(zero_copy_only=False)[own][row]
            yield [key, doc, ((key >> np.uint64(32) & np.uint64(127)) << np.uint64(1)).astype(np.uint8) | (klass % 2).astype(np.uint8)]

    return find


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, doc, key, odd, hub, n) of keys that several documents have. SINGLE: a document's key with its hub and number of
    documents; HEAD: a key and its hub; KNOWN: a document's key. Keys with heads are left to a join, as only their rows tell how
    many documents they have."""

    def out(kind: int, doc: np.ndarray, key: np.ndarray, hub: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(doc), kind), pa.int8()), pa.array(doc), pa.array(key >> 1), pa.array((key & 1).astype(np.int8)), pa.array(hub), pa.array(n, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "doc", "key", "odd", "hub", "n"])

    for group in K.grouped(batches, ["deal"]):
        kind, parts = group.column("kind").to_numpy(), []
        for k in (SINGLE, HEAD, KNOWN):
            segment, (low, doc, tag) = unpacked(group.filter(pa.array(kind == k)), ENTRY)
            tag = tag.view(np.uint8).astype(np.int64)
            parts.append((((segment.astype(np.int64) << 39 | tag >> 1 << 32 | low.view(np.uint32).astype(np.int64)) << 1) | (tag & 1), doc))
        known, docs = parts[KNOWN]
        if len(known):
            yield out(KNOWN, docs, known, docs, np.zeros(len(known)))
        key, doc = (np.concatenate(x) for x in zip(parts[SINGLE], parts[HEAD]))
        if not len(key):
            continue
        is_head = np.arange(len(key)) >= len(parts[SINGLE][0])
        order = np.lexsort((doc, key))
        key, doc, is_head = key[order], doc[order], is_head[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.append(starts, len(key)))
        headed = np.bitwise_or.reduceat(is_head, starts)
        first = starts[headed]
        yield out(HEAD, doc[first], key[first], doc[first], np.zeros(len(first)))
        loose = np.repeat(headed, sizes) & ~is_head
        yield out(KNOWN, doc[loose], key[loose], doc[loose], np.zeros(int(loose.sum())))
        shared = np.repeat(~headed & (sizes > 1), sizes)
        yield out(SINGLE, doc[shared], key[shared], np.repeat(doc[starts], sizes)[shared], np.repeat(sizes, sizes)[shared])


def stars(docs: DataFrame, spare: DataFrame, n: int, classes: Classes, n_keys: int) -> DataFrame:
    """Rows (a, b): documents and the hubs of the shared keys that they keep. spare: (doc, spare) of describe."""
    found = written(dealt(docs, _entries(n, classes), ENTRY, n_keys, narrow=True).mapInArrow(_owners, "kind tinyint, doc long, key long, odd tinyint, hub long, n int"), n_keys, OWNER_KEYS)
    single = found.filter(F.col("kind") == SINGLE).select("doc", "key", "odd", "hub", "n")
    known = found.filter(F.col("kind") == KNOWN).select("doc", "key", "odd")
    hubs = found.filter(F.col("kind") == HEAD).select("key", "hub").join(known.groupBy("key").agg(F.count("*").cast("int").alias("n")), "key")
    rows = single.union(known.join(hubs, "key").select("doc", "key", "odd", "hub", "n"))
    place = F.row_number().over(Window.partitionBy("doc", "odd").orderBy(F.desc("n"), "key"))
    kept = rows.withColumn("place", place).join(spare, "doc").filter(F.col("place") > F.get("spare", F.col("odd")))
    placed = written(kept.filter("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct(), found.count())
    forget(found)
    return placed


class Tree:
    """A signature tree over sets; levels[0] are the leaves, one for each set."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, bits: int):
        sizes = np.diff(at)
        self.order = np.lexsort((hashes[np.minimum(at[:-1], max(len(hashes) - 1, 0))] if len(hashes) else sizes, sizes))
        words = np.zeros((len(sizes), bits // 64), np.uint64)
        bit = (hashes & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(words, (np.repeat(np.arange(len(sizes)), sizes), bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        words, sizes = words[self.order], sizes[self.order]
        hidden = sizes - np.bitwise_count(words).sum(axis=1).astype(np.int64)
        self.levels = [(words, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > FANOUT:
            w, low, high, h = self.levels[-1]
            cut = np.arange(0, len(w), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(w, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(h, cut)))

    def names(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level the component that all sets of a node are in, or -1."""
        out = [labels[self.order]]
        for level in self.levels[1:]:
            cut = np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(out[-1], cut), np.maximum.reduceat(out[-1], cut)
            out.append(np.where(low == high, low, -1))
        return out


def _can_link(a, b, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the bitmaps and sizes of node pairs allow a link below them."""
    (wa, la, ha, xa), (wb, lb, hb, xb) = a, b
    keep = (den * ha[i] >= num * lb[j]) & (den * hb[j] >= num * la[i])
    most = np.minimum(ha[i], hb[j])
    for lo in range(0, len(i), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        shared = np.bitwise_count(wa[i[part]] & wb[j[part]]).sum(axis=1).astype(np.int64)
        most[part] = np.minimum(most[part], shared + np.minimum(xa[i[part]], xb[j[part]]))
    return keep & ((num + den) * most >= num * (la[i] + lb[j]))


def candidate_pairs(a: Tree, b: Tree, labels_a: np.ndarray, labels_b: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal: leaf pairs, as set numbers, that no bound and no common component excludes."""
    names_a, names_b = a.names(labels_a), b.names(labels_b)
    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.levels[-1][0])), np.arange(len(b.levels[-1][0])), indexing="ij"))
    stack = [(top_a, top_b, i, j)]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > 1 << 16:
            half = len(i) // 2
            stack += [(la, lb, i[half:], j[half:]), (la, lb, i[:half], j[:half])]
            continue
        if a is b:
            keep = i <= j
            i, j = i[keep], j[keep]
        known = (names_a[la][i] >= 0) & (names_a[la][i] == names_b[lb][j])
        i, j = i[~known], j[~known]
        keep = _can_link(a.levels[la], b.levels[lb], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if la == lb == 0:
            if a is b:
                i, j = i[i < j], j[i < j]
            yield a.order[i], b.order[j]
            continue
        split = np.arange(FANOUT)
        if la >= lb and la:
            i, j, la = (i[:, None] * FANOUT + split).ravel(), np.repeat(j, FANOUT), la - 1
            ok = i < len(a.levels[la][0])
            i, j = i[ok], j[ok]
            if a is b:
                j, lb = (j[:, None] * FANOUT + split).ravel(), lb - 1
                i = np.repeat(i, FANOUT)
                ok = j < len(b.levels[lb][0])
                i, j = i[ok], j[ok]
        else:
            j, i, lb = (j[:, None] * FANOUT + split).ravel(), np.repeat(i, FANOUT), lb - 1
            ok = j < len(b.levels[lb][0])
            i, j = i[ok], j[ok]
        stack.append((la, lb, i, j))


def linked(common: int | np.ndarray, a, b, num: int, den: int):
    """den * intersection >= num * union, and neither set empty."""
    return (den * common >= num * (a + b - common)) & (common > 0)


class Sets:
    """Shingle sets of some documents with their components so far."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, labels: np.ndarray):
        self.hashes, self.at, self.sizes, self.labels = hashes, at, np.diff(at), labels

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.at[k] : self.at[k + 1]]

    def common_with(self, one: np.ndarray) -> np.ndarray:
        """Each set's overlap with one set."""
        if not len(one):
            return np.zeros(len(self.sizes), np.int64)
        place = np.minimum(np.searchsorted(one, self.hashes), len(one) - 1)
        return K.per_row(one[place] == self.hashes, self.at)


def join(a: Sets, b: Sets | None, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that connect the sets of a (with those of b), as many as their components need.

    Labels are those of components known before; they are updated with each link found.
    """
    same = b is None
    b = a if same else b

    def unite(x: int, y: int) -> None:
        for s in {id(a): a, id(b): b}.values():
            s.labels[s.labels == y] = x

    todo = np.arange(len(b.sizes))
    for _ in range(LEADERS if same else 0):  # a tight group is linked through its first set
        if not len(todo):
            break
        lead = int(todo[0])
        hits = np.flatnonzero(linked(b.common_with(b.of(lead)), b.sizes, b.sizes[lead], num, den))
        for k in hits:
            if b.labels[k] != b.labels[lead]:
                yield lead, int(k)
                unite(b.labels[lead], b.labels[k])
        todo = todo[(b.labels[todo] != b.labels[lead])]
    bits = 1 << int(np.clip(int(max(a.sizes.max(initial=1), b.sizes.max(initial=1)) * 2 - 1).bit_length(), 8, 13))
    tree_a = Tree(a.hashes, a.at, bits)
    tree_b = tree_a if same else Tree(b.hashes, b.at, bits)
    for pairs in candidate_pairs(tree_a, tree_b, a.labels.copy(), b.labels.copy(), num, den):
        for i, j in zip(*(p.tolist() for p in pairs)):
            if a.labels[i] != b.labels[j]:
                one, other = a.of(i), b.of(j)
                place = np.minimum(np.searchsorted(other, one), len(other) - 1) if len(other) else None
                common = int((other[place] == one).sum()) if place is not None else 0
                if linked(common, len(one), len(other), num, den):
                    yield i, j
                    unite(a.labels[i], b.labels[j])


def _sets(texts: pa.Array, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [shingle_sets(data, offsets, n, seed) for _, _, data, offsets in K.text_chunks(texts)]
    sizes = np.concatenate([np.diff(at) for _, at in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _within(n: int, num: int, den: int):
    seed = K.new_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.grouped(batches, ["block", "chunk"]):
            ids = group.column("doc_id").to_numpy()
            sets = Sets(*_sets(group.column("text").combine_chunks(), n, seed), np.arange(len(ids)))
            found = list(join(sets, None, num, den))
            if found:
                yield _links([int(ids[i]) for i, _ in found], [int(ids[j]) for _, j in found])

    return run


def _between(n: int, num: int, den: int):
    seed = K.new_seed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in K.grouped(batches, ["block", "left", "right"]):
            side = group.column("side").to_numpy()
            ids, labels = group.column("doc_id").to_numpy(), group.column("label").to_numpy()
            _, labels = np.unique(labels, return_inverse=True)
            texts = group.column("text").combine_chunks()
            own = [np.flatnonzero(side == s) for s in (0, 1)]
            left, right = (Sets(*_sets(texts.take(pa.array(k)), n, seed), labels[k]) if len(k) else None for k in own)
            if left is None or (right is None and group.column("left")[0] != group.column("right")[0]):
                continue
            found = list(join(left, right, num, den))
            if found:
                names = ids[own[0]], ids[own[1]] if right is not None else ids[own[0]]
                yield _links([int(names[0][i]) for i, _ in found], [int(names[1][j]) for _, j in found])

    return run


def jaccard_components(docs: DataFrame, n: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): each row's number of distinct n-word shingles (A-Z lower-cased) and
    the smallest id reachable over links of similarity num / den or more."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = Classes(num, den)
    described = written(describe(docs, n, sizes))
    n_docs, n_shingles = described.agg(F.count("*"), F.sum("n_shingles")).first()
    linkable = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["f1", "f2", "n_shingles"]
    classes = written(linkable.groupBy(*same).agg(F.min("doc_id").alias("rep")), n_docs)
    # Documents that others stand for; one with several texts also stands for itself.
    of_several = linkable.groupBy("doc_id").agg(F.countDistinct(*same).alias("texts"))
    copies = linkable.join(classes, same).filter("doc_id <> rep").select("doc_id", "rep").distinct().join(of_several, "doc_id")
    copies = written(copies.select("doc_id", "rep", (F.col("texts") > 1).alias("several")), n_docs)

    rate = (1 + SPARE) * 2 * (den - num) / (den + num) * 2
    n_keys = int(rate * (n_shingles or 0))
    # A document of several texts has the keys of all and leaves none out.
    spare = linkable.groupBy(F.col("doc_id").alias("doc")).agg(F.array(*[F.when(F.count("*") > 1, 0).otherwise(F.min(F.col("spare")[k])).alias("s") for k in (0, 1)]).alias("spare"))
    found = stars(docs.filter("doc_id IS NOT NULL"), spare, n, sizes, n_keys)
    n_members = 2 * found.count()
    for end in ("a", "b"):
        known = copies.withColumnsRenamed({"doc_id": "copy", "rep": "of"})
        stood_for = F.when(F.col("of").isNull(), F.array(end)).when(F.col("several"), F.array("of", end)).otherwise(F.array("of"))
        found = found.join(known, F.col(end) == F.col("copy"), "left").withColumn(end, F.explode(stood_for)).select("a", "b")
    members = found.select(F.col("a").alias("doc_id"), F.col("b").alias("block")).filter("doc_id <> block").distinct()
    members = written(members.union(members.select("block", "block").distinct()), n_members)
    weights = linkable.groupBy("doc_id").agg(F.sum(F.col("n_shingles") + SET_COST).alias("weight"))
    n_members = members.count()
    members = written(members.join(weights, "doc_id"), n_members + n_docs)
    totals = members.groupBy("block").agg(F.ceil(F.sum("weight") / chunk).cast("long").alias("chunks"))
    members = written(members.join(totals, "block"), n_members)
    in_blocks = members.agg(F.sum("weight")).first()[0] or 0

    own = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    all_chunks = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    places = members.select("doc_id", "block", F.explode(F.when(F.col("doc_id") == F.col("block"), all_chunks).otherwise(F.array(own))).alias("chunk"))
    dealt_texts = docs.join(places.hint("shuffle_hash"), "doc_id").repartition("block", "chunk").sortWithinPartitions("block", "chunk")
    links = written(dealt_texts.mapInArrow(_within(n, num, den), "a long, b long"), in_blocks, BLOCK_SHINGLES)

    large = members.filter("chunks > 1")
    if large.take(1):
        labels = written(components(links))
        named = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        named = named.join(labels.withColumnRenamed("node", "block"), "block", "left").withColumn("of_first", F.coalesce("component", "block")).drop("component")
        with_first = F.col("label") == F.col("of_first")
        named = written(named.withColumn("first", with_first))
        counts = named.groupBy("block").agg(*[F.ceil(F.sum(F.when(c, F.col("weight")).otherwise(0)) / chunk).cast("long").alias(x) for x, c in (("firsts", F.col("first")), ("rests", ~F.col("first")))])
        deal = F.xxhash64("doc_id")
        part = F.when(F.col("first"), F.col("rests") + F.pmod(deal, F.col("firsts"))).otherwise(F.pmod(deal, F.col("rests")))
        placed = named.join(counts.filter("rests > 0"), "block").withColumn("part", part)
        # Parts below rests are compared with all parts, themselves included; the others only with those.
        lefts = F.transform(F.sequence(F.lit(0).cast("long"), F.least("part", F.col("rests") - 1)), lambda x: F.struct(x.alias("left"), F.col("part").alias("right"), (x != F.col("part")).cast("int").alias("side")))
        rights = F.transform(F.sequence(F.col("part"), F.col("rests") + F.col("firsts") - 1), lambda x: F.struct(F.col("part").alias("left"), x.alias("right"), F.lit(0).alias("side")))
        pairs = F.when(F.col("part") < F.col("rests"), F.array_distinct(F.concat(lefts, rights))).otherwise(lefts)
        sides = placed.select("block", "doc_id", "label", F.explode(pairs).alias("p")).select("block", "p.*", "doc_id", "label")
        sides = docs.join(sides.hint("shuffle_hash"), "doc_id").repartition("block", "left", "right").sortWithinPartitions("block", "left", "right")
        links = written(links.union(sides.mapInArrow(_between(n, num, den), "a long, b long")))
        forget(labels, named)

    ends = components(links.union(copies.filter("several").select("doc_id", "rep")))
    names = classes.join(ends.withColumnRenamed("node", "rep"), "rep", "left")
    names = written(names.select(*same, F.coalesce("component", "rep").alias("component_id")), n_docs)
    forget(classes, copies, members, links)
    joined = described.drop("spare").join(names, same, "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
