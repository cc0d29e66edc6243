"""Near copies by word shingles: all pairs of texts whose shingle sets reach a Jaccard similarity.

A text's words, A-Z lower-cased, give a set of hashed shingles of ``SHINGLE`` words. Two sets of
similarity ``SIMILAR`` share all but a fifth of the larger one, so if the shingles of all texts are
put in one order, the first fifth of each (and one more) share a shingle. Only these are dealt out.
The order is by hash, with common shingles last; a sample tells which are common, and any order
gives the same pairs.

Nodes are distinct sets. Where nodes share a dealt shingle, pairs are dropped by two bounds that no
pair of the similarity breaks: the sizes, and the differing bits of a parity bitmap of the set. What
is left is compared in full. Neighbours in the groups of a set's ``EARLY`` first shared shingles are
compared first; then all pairs of a group that lie in different components still, so a large group
of near copies makes no square of pairs. There a pair that shares several shingles is taken up at
the first: a row has the ``BACK`` shared shingles before its own, and where two rows have one of
these in common, they have met before.

Defined cases: null, empty and blank texts are one set; texts of fewer words than a shingle are one
shingle; sets are told apart by 64-bit hashes; rows without doc_id are searched too but never name a
component; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.simhash import BLOCK, SEED, fingerprint, linked_fingerprints
from quotemill.llm.token_binary import _partition
from quotemill.llm.tokenizing import _mix, relieve, sliced
from quotemill.operators import graph

SHINGLE = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: Bits of the bitmap.
BITMAP = 512
#: Neighbours of a group, and shared shingles of a set, compared in the first round; shared shingles that a row looks back on.
CHAIN, EARLY, BACK = 4, 8, 4
#: Sets whose texts are picked out by broadcast, and rows that go, at most; beyond it by a shuffle.
BROADCAST_ROWS = 1_000_000
#: One text in so many is looked at for common shingles, of which there are so many at most; they decide on the order alone.
SAMPLED, COMMON, OFTEN = 16, 20_000, 4
#: Sets whose shingles a task has dealt out, remembered at most.
SEEN = 1 << 20


class _Words(dict):
    """Hashes of words, found out once each."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()
#: Words remembered by a worker.
KNOWN_WORDS = 200_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(_words) > KNOWN_WORDS:
        _words.clear()
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n, size = max(1, len(words) - size + 1), min(size, len(words))
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n])
    return np.unique(out)


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def _bitmap(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP).astype(np.uint8) & 1).tobytes()


def _wide(s: np.ndarray) -> bytes:
    """The size of a set and its parity bitmap of about a bit for each shingle."""
    size = max(BITMAP, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.uint64(len(s)).tobytes() + np.packbits(odd).tobytes()


def _may_be_similar(one: bytes, two: bytes) -> bool:
    """A bound on the differing shingles; the wider bitmap is folded to the other's size."""
    total = int(np.frombuffer(one[:8], np.uint64)[0] + np.frombuffer(two[:8], np.uint64)[0])
    a, b = sorted((np.frombuffer(x[8:], np.uint8) for x in (one, two)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) * (SIMILAR[1] + SIMILAR[0]) <= total * (SIMILAR[1] - SIMILAR[0])


def _similar(one: bytes, two: bytes) -> bool:
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64), pa.int64())


def _marked(batches):
    row = _partition() << 40
    for batch in batches:
        for b in sliced(batch):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            marks = [pa.array(row + np.arange(b.num_rows), pa.int64()), _long([_node(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([_bitmap(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*marks, *b.columns], ["uid", "node", "n", "bits", *b.schema.names])
            row += b.num_rows
    relieve()


def _all(batches):
    for b in batches:
        for t in b.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([_long(shingles(t))], ["key"])


def _prefixes(common_: np.ndarray):
    """(key, node): the first shingles of each set."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            keys, nodes = [], []
            for node, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                s = shingles(t)
                last = common_[np.searchsorted(common_[:-1], s)] == s if len(common_) else np.zeros(len(s), bool)
                first = len(s) + 1 + (-len(s) * SIMILAR[0] // SIMILAR[1])
                keys.append(np.concatenate([s[~last], s[last]])[:first])
                nodes.append(np.full(len(keys[-1]), node, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(keys)), pa.array(np.concatenate(nodes), pa.int64())], ["key", "node"])

    return run


def _whole(batches, rows: int = 100_000):
    """Sorted (key, x, y, ...) as lists of columns that hold whole groups of (key, x, y); no more than ``rows`` and one group."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            at = [b.column(i).to_numpy() for i in range(3)]
            same = np.logical_and.reduce([c == c[-1] for c in at])
            if not same.all():
                last = int(np.flatnonzero(~same)[-1]) + 1
                yield pa.Table.from_batches([*held[:-1], b.slice(0, last)])
                held, n = [b.slice(last)], b.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _starts(t: pa.Table, cols) -> np.ndarray:
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for c in cols:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _shared(batches):
    """Drops repeated rows of sorted (key, x, y, node) and groups of one node."""
    for t in _whole(batches):
        t = t.filter(pa.array(_starts(t, range(4))))
        new = _starts(t, range(3))
        alone = new & np.append(new[1:], True)
        yield from t.filter(pa.array(~alone)).to_batches()


def _pairs(reach: int | None):
    """(a, b) of sorted (key, x, y, node, label, n, bits, shared shingles before): pairs of a group at ``reach`` rows at most, of different labels, that the bounds leave."""

    def run(batches):
        for t in _whole(batches):
            node, label, n = (t.column(i).to_numpy() for i in (3, 4, 5))
            bits = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint64).reshape(len(node), -1)
            back = [t.column(7 + i).to_numpy() for i in range(BACK)]
            group = np.cumsum(_starts(t, range(3)))
            at, d, out = np.arange(len(node)), 1, []
            while reach is None or d <= reach:
                at = at[at + d < len(node)]
                at = at[group[at] == group[at + d]]
                if not len(at):
                    break
                x = at[label[at] != label[at + d]]
                x = x[np.minimum(n[x], n[x + d]) * SIMILAR[1] >= np.maximum(n[x], n[x + d]) * SIMILAR[0]]
                apart = np.bitwise_count(bits[x] ^ bits[x + d]).sum(axis=1, dtype=np.int64)
                x = x[apart * (SIMILAR[1] + SIMILAR[0]) <= (n[x] + n[x + d]) * (SIMILAR[1] - SIMILAR[0])]
                for one in back:
                    for two in back:
                        x = x[one[x] != two[x + d]]
                if len(x):
                    out.append(np.stack([np.minimum(node[x], node[x + d]), np.maximum(node[x], node[x + d])], axis=1))
                d += 1
            if out:
                found = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i], pa.int64()) for i in range(2)], ["a", "b"])

    return run


def _described(describe):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([describe(shingles(t)) for t in b.column(1).to_pylist()], pa.binary())], ["node", "what"])

    return run


def _kept(test):
    def run(batches):
        for b in batches:
            keep = pa.array([test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    return run


_BACK = [f"before{i}" for i in range(BACK)]


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (an intermediate table), to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _links(marked: DataFrame, groups: DataFrame, reach: int | None, name: str) -> DataFrame:
    """The pairs of ``groups`` (key, x, y, node, label, n, bits, shared shingles before) that are similar."""
    cols = ["key", "x", "y"]
    sorted_ = groups.select(*cols, "node", "label", "n", "bits", *_BACK).repartition(*cols).sortWithinPartitions(*cols, "node")
    spark = marked.sparkSession
    pairs, at = common.materialize(sorted_.mapInArrow(_pairs(reach), "a long, b long").distinct(), f"{name}-pairs")
    # The wide bitmaps drop pairs of long texts before their sets are fetched.
    for describe, test in ((_wide, _may_be_similar), (np.ndarray.tobytes, _similar)):
        ends, used = common.materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), f"{name}-ends")
        texts = marked.select("node", "text").join(_few(ends), "node", "left_semi").dropDuplicates(["node"])
        sets, of = common.materialize(texts.mapInArrow(_described(describe), "node long, what binary"), f"{name}-sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("what").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("what").alias("two")), "b")
        left, to = common.materialize(both.select("a", "b", "one", "two").mapInArrow(_kept(test), "a long, b long"), f"{name}-links")
        for path in (at, of, used):
            common.release(spark, path)
        pairs, at = left, to
    return pairs


def _fingerprinted(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _long([fingerprint(t) for t in b.column(1).to_pylist()])], ["node", "fp"])


def _simhash_links(marked: DataFrame) -> DataFrame:
    """(a, b): sets that the SimHash operator's fingerprints, search and distance connect, each linked to the least of them."""
    prints, _ = common.materialize(marked.select("node", "text").mapInArrow(_fingerprinted, "node long, fp long").distinct(), "set-fingerprints")
    fps, _ = common.materialize(prints.select("fp").distinct(), "distinct-fingerprints")
    roots = graph.roots(linked_fingerprints(fps)).withColumnRenamed("node", "fp")
    rooted = prints.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")).distinct()
    least = rooted.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return common.materialize(rooted.join(least, "root").where("node <> b").select(F.col("node").alias("a"), "b"), "simhash-links")[0]


def _classes(marked: DataFrame, nodes: DataFrame, block: int, known: DataFrame | None = None) -> DataFrame:
    """(node, root): the least node that each of ``nodes`` (node, n, bits) can reach over similar sets and the links ``known`` (a, b)."""
    sample = marked.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(_all, "key long")
    often = sample.groupBy("key").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "key").limit(COMMON).select("key").collect()
    last = np.sort(np.array([r.key for r in often], np.int64).view(np.uint64))
    dealt, at = common.materialize(marked.select("node", "text").mapInArrow(_prefixes(last), "key long, node long"), "prefixes")
    large = dealt.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = (
        dealt.join(large, "key", "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node")
    )
    cols = ["key", "x", "y", "node"]
    shared = placed.repartition("key", "x", "y").sortWithinPartitions(*cols).mapInArrow(_shared, "key long, x int, y int, node long")
    own = Window.partitionBy("node").orderBy("key")
    # A crowded key stands several times; where there is none before, the set's own hash is in its place.
    before = [F.when(F.lag("key", i + 1).over(own) != F.col("key"), F.lag("key", i + 1).over(own)).otherwise(F.col("node")).alias(c) for i, c in enumerate(_BACK)]
    groups, of = common.materialize(shared.join(nodes.select("node", "n", "bits"), "node").select("*", F.row_number().over(own).alias("rank"), *before), "shared-shingles")
    common.release(marked.sparkSession, at)
    alone = {c: F.col("node") for c in ("label", *_BACK)}
    near = _links(marked, groups.where(F.col("rank") <= EARLY).withColumns(alone), CHAIN, "chain")
    near = near if known is None else near.unionByName(known)
    labelled = groups.join(graph.roots(near), "node", "left").withColumn("label", F.coalesce("root", F.col("node")))
    roots = graph.roots(near.unionByName(_links(marked, labelled, None, "rest")))
    common.release(marked.sparkSession, of)
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _prepared(docs: DataFrame, others: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with their sets' marks, and the distinct sets with the first of their rows."""
    typed = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    marked, _ = common.materialize(rows.mapInArrow(_marked, "uid long, node long, n long, bits binary, doc_id long, text string" + typed), "shingle-sets")
    # The least id, no id last; of one id the least hashes, so that only rows alike tie.
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(0), *others).alias("o"), "uid")
    nodes, _ = common.materialize(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(rank).alias("head"), F.count("*").alias("_rows"), F.min("n").alias("n"), F.min("bits").alias("bits")), "shingle-nodes")
    return marked, nodes


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable over similar texts) of each row of ``docs`` (doc_id, text)."""
    marked, nodes = _prepared(docs, ())
    classes = nodes.join(_classes(marked, nodes, block), "node")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named, _ = common.materialize(classes.join(least, "root").select("node", "component_id", "_rows"), "components")
    return common.join_crowded(marked.select("doc_id", "node"), named, "node").select("doc_id", "component_id")


def without_near_copies(docs: DataFrame, others: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One row of each component of ``docs`` (doc_id, text, others): the one with the least doc_id, or, without any, the first by hash.

    SimHash links come first; the search of similar sets finds the near copies beyond their distance.
    Components are those of both kinds of links, and no pair that is connected is left for its last round.
    """
    marked, nodes = _prepared(docs, others)
    heads = nodes.join(_classes(marked, nodes, block, _simhash_links(marked)), "node").groupBy("root").agg(F.min("head").alias("head"))
    gone, _ = common.materialize(marked.select("uid").join(heads.select(F.col("head.uid").alias("uid")), "uid", "left_anti"), "near-copies")
    return marked.join(_few(gone), "uid", "left_anti").select("doc_id", "text", *others)
