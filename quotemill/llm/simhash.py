"""SimHash near-duplicates by a generalised pigeonhole search.

A text's words, A-Z lower-cased, give shingles; each shingle's XXH64 votes on 64 bits. Distinct
fingerprints are linked at ``DISTANCE`` or fewer differing bits. Bits that go together (by their
correlation in a sample) share a partition; a dynamic program gives the partitions thresholds
t >= -1 with sum(t + 1) = DISTANCE + 1, so two linked fingerprints are within t of each other in at
least one partition. It minimises the rows to be dealt out and the candidates, both estimated from
the sample. A partition with threshold t is probed by all its values with t bits masked.

A bucket is searched in place: pairs are verified there, and only a spanning forest of its links
leaves it. Buckets over ``BLOCK`` fingerprints are cut into blocks, and each pair of blocks is a
task's work of its own, so no link is lost and no task gathers an unbounded group.

In a block the fingerprints are held against each other, so a bucket costs the square of its
distinct fingerprints at worst, spread over tasks of ``BLOCK`` by ``BLOCK``; the plan's partitions
are chosen to keep buckets small.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; texts of
fewer words than a shingle are one shingle; exact copies share a fingerprint and so a component;
rows without doc_id link others and get a component too but never name one, so a component without
any doc_id is null; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.operators import graph

DISTANCE, SHINGLE, SEED = 3, 3, 42
BLOCK = 4096
#: Fingerprints that the bits' correlation and the candidates are estimated from.
SAMPLE = 3000
#: Cost of a candidate as a part of that of a row dealt out.
CANDIDATE = 0.01
_BITS = 64


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(line, SEED))
    ends = list(accumulate(len(w) + 1 for w in words))
    votes, n = np.zeros(_BITS, np.int64), len(words) - shingle + 1
    starts = [0, *ends[:-1]]
    for lo in range(0, n, 65536):
        hi = min(lo + 65536, n)
        raw = b"".join([digest(line[x : y - 1], SEED) for x, y in zip(starts[lo:hi], ends[lo + shingle - 1 : hi + shingle - 1], strict=True)])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes())


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(fp.view(np.int64), pa.int64())})

    return run


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float64)


def group_bits(fps: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of nearly the same size, each filled with the bits that go most with those it has."""
    bits = _bits(fps)
    dev = bits - bits.mean(axis=0)
    scale = np.sqrt((dev**2).sum(axis=0))
    scale[scale == 0] = 1
    tied = np.abs((dev / scale).T @ (dev / scale))
    left, out = list(range(_BITS)), []
    for p in range(parts):
        size = _BITS // parts + (p < _BITS % parts)
        sub = tied[np.ix_(left, left)]
        part = [left[int(sub.sum(axis=1).argmax())]]
        left.remove(part[0])
        while len(part) < size:
            best = max(left, key=lambda x: tied[x, part].sum())
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[dict[int, float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of the partitions with the least total cost and sum(t + 1) = distance + 1."""
    best = {0: (0.0, [])}
    for cost in costs:
        nxt = {}
        for used, (total, ts) in best.items():
            for t, c in cost.items():
                u = used + t + 1
                if u <= distance + 1 and (u not in nxt or total + c < nxt[u][0]):
                    nxt[u] = (total + c, [*ts, t])
        best = nxt
    return best[distance + 1]


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask of a partition's bits, threshold) for each partition that is probed."""
    n = len(sample)
    best = None
    for parts in range(2, distance + 3):
        groups = group_bits(sample, parts) if n > 1 else [list(range(p, _BITS, parts)) for p in range(parts)]
        costs = []
        for g in groups:
            seen = np.zeros(3)
            for i in range(n - 1):
                d = np.bitwise_count((sample[i] ^ sample[i + 1 :]) & np.uint64(_mask(g)))
                seen += [(d <= t).sum() for t in range(3)]
            cost, masks = {-1: 0.0}, [1, len(g), len(g) * (len(g) - 1) // 2]
            for t in range(3):
                odds = max(seen[t] / max(1, n * (n - 1) / 2), sum(masks[: t + 1]) / 2.0 ** len(g))
                cost[t] = total * masks[t] + CANDIDATE * total * total / 2 * odds * (t + 1)
            costs.append(cost)
        found = allocate(costs, distance)
        if best is None or found[0] < best[0]:
            best = (found[0], [(_mask(g), t) for g, t in zip(groups, found[1], strict=True) if t >= 0])
    return best[1]


def _keys(parts: list[tuple[int, int]]):
    """Each fingerprint's probes: its partitions' values with as many bits masked as the threshold has."""
    probes = [mask & ~_mask(off) for mask, t in parts for off in combinations([b for b in range(_BITS) if mask >> b & 1], t)]

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for j, mask in enumerate(probes):
                key = (fps & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_pydict({"probe": pa.array(np.full(len(fps), j), pa.int32()), "key": pa.array(key.view(np.int64), pa.int64()), "fp": b.column(0)})

    return run


def _forest(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints of the same group (groups lie together)."""
    label = np.arange(len(fps))
    at, d = np.arange(len(fps)), 1
    while True:
        at = at[at + d < len(fps)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        x = at[label[at] != label[at + d]]
        x = x[np.bitwise_count(fps[x] ^ fps[x + d]) <= distance]
        while len(x):
            a, b = label[x], label[x + d]
            apart = a != b
            x, a, b = x[apart], a[apart], b[apart]
            if len(x):
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
        d += 1
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _search(distance: int, rows: int = 200_000):
    """Streams sorted (probe, key, x, y, fp); holds whole groups, and no more than ``rows`` and one group."""

    def links(held):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        a, b = _forest(np.cumsum(new), cols[4].view(np.uint64), distance)
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    def run(batches):
        held, n = [], 0
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(5)]
            if not len(cols[0]):
                continue
            held.append(cols)
            n += len(cols[0])
            if n >= rows:
                same = np.logical_and.reduce([c == c[-1] for c in cols[:4]])
                last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if last:
                    held[-1] = [c[:last] for c in cols]
                    yield links(held)
                    held, n = [[c[last:] for c in cols]], len(cols[0]) - last
        if held:
            yield links(held)

    return run


def linked_fingerprints(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps`` (fp long) that connect all that are within ``distance`` bits."""
    total = fps.count()
    drawn = [r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    probes = fps.select("fp").mapInArrow(_keys(plan(np.array(drawn, np.int64).view(np.uint64), total, distance)), "probe int, key long, fp long")
    large = probes.groupBy("probe", "key").count().where(F.col("count") > block).select("probe", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        probes.join(large, ["probe", "key"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        .select("probe", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    cols = ["probe", "key", "x", "y"]
    return dealt.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(_search(distance), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable) of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked, _ = common.materialize(texts.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "fingerprints")
    nodes, at = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_rows")), "distinct-fingerprints")
    roots = graph.roots(linked_fingerprints(nodes.select("fp"), distance))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "_rows", F.coalesce("root", "fp").alias("root"))
    classes, _ = common.materialize(rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id", "_rows"), "components")
    common.release(docs.sparkSession, at)
    return common.join_crowded(marked, classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
