"""Packing along a space-filling curve.

Each document's ids are hashed into a vector, which a fixed random projection takes to few
dimensions; documents are range-sorted by the Hilbert key of that point (ties by doc_id and input
order) and laid end to end along the curve. Sequences are cut from this line at every
``SEQUENCE`` ids, so only the last one is padded, and neighbours on the curve share sequences.

Defined cases: a null or empty text has its end id only; rows that share a doc_id are documents of
their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.token_binary import _each, _partition
from quotemill.llm.tokenizing import encoder, relieve, sliced, vocabulary_path

SEQUENCE = 2048
#: Buckets of a hashed document vector, dimensions of its projection, bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 3, 16
_BATCH = 2000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """The place of each point (a row of unsigned integers below 2^bits) on the Hilbert curve."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > one:  # undo the rotations of each level
        p = q - one
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > one:
        t = np.where((x[-1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


def _projection() -> np.ndarray:
    directions = np.random.default_rng(7).normal(size=(BUCKETS, DIMENSIONS))
    return directions / np.linalg.norm(directions, axis=0)


def curve_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie one after the other."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64) % BUCKETS
    doc = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes)
    vectors = np.log1p(np.bincount(doc + bucket, minlength=len(sizes) * BUCKETS)).reshape(-1, BUCKETS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    points = np.clip((vectors @ _projection() + 1) / 2, 0, 1) * ((1 << BITS) - 1)
    return hilbert_keys(points.astype(np.uint64), BITS)


def _tokenized(vocabulary: str, end_id: int):
    def run(batches):
        encode, row = encoder(vocabulary), _partition() << 40
        for b in batches:
            for part in sliced(b):
                ids, sizes = encode(part.column(1).to_pylist())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                out = []
                for x, y in zip(starts.tolist(), ends.tolist(), strict=True):
                    doc = np.append(ids[x:y], np.uint32(end_id))
                    out.append(doc.astype("<u2" if doc.max() <= 0xFFFF else "<u4").tobytes())
                yield pa.RecordBatch.from_pydict({"uid": pa.array(row + np.arange(len(out)), pa.int64()), "doc_id": part.column(0), "key": pa.array(_keys(ids, sizes), pa.int64()), "n": pa.array(sizes + 1, pa.int64()), "ids": pa.array(out, pa.binary())})
                row += len(out)
        relieve()

    return run


def _keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Curve keys, some documents at a time: an empty text costs a vector too."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.concatenate([curve_keys(ids[ends[lo] : ends[min(lo + _BATCH, len(sizes))]], sizes[lo : lo + _BATCH]) for lo in range(0, len(sizes), _BATCH)])


def _placed(batches):
    shard, at = _partition(), 0
    for b in batches:
        n = b.column("n").to_numpy()
        ends = at + np.cumsum(n)
        yield pa.RecordBatch.from_pydict({"uid": b.column("uid"), "shard": pa.array(np.full(len(n), shard), pa.int32()), "n": pa.array(n, pa.int64()), "inside": pa.array(ends - n, pa.int64())})
        at = int(ends[-1]) if len(n) else at


def _cut(with_ids: bool):
    def run(batches):
        out, n_ids = [], 0

        def rows():
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = [pa.array(c, pa.int64()) for c in list(zip(*out, strict=True))[:7]]
            if with_ids:
                ids = [x[7] for x in out]
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
            return pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

        for doc_id, n, first, raw in _each(batches, "doc_id", "n", "first", "ids"):
            ids, at = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"), 0
            while at < n:
                sequence, offset = divmod(first + at, SEQUENCE)
                size = min(n - at, SEQUENCE - offset)
                piece = ids[at : at + size].astype("<u4")
                out.append((doc_id, at, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None))
                at, n_ids = at + size, n_ids + size * with_ids
                if len(out) >= _BATCH or n_ids >= 1 << 20:
                    yield rows()
                    out, n_ids = [], 0
        if out:
            yield rows()

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text) in the packed sequences; with the piece's ids if asked for."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens, _ = common.materialize(texts.mapInArrow(_tokenized(vocabulary, end_id), "uid long, doc_id long, key long, n long, ids binary"), "packing-ids")
    along = tokens.select("uid", "doc_id", "key", "n").repartitionByRange("key", "doc_id", "uid").sortWithinPartitions("key", "doc_id", "uid")
    placed, _ = common.materialize(along.mapInArrow(_placed, "uid long, shard int, n long, inside long"), "packing-places")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    base = placed.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    first = placed.join(F.broadcast(base), "shard").select("uid", (F.col("base") + F.col("inside")).alias("first"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return tokens.join(first, "uid").select("doc_id", "n", "first", "ids").mapInArrow(_cut(with_ids), schema)


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), vocabulary_path("byte_bpe_50k.json"))
