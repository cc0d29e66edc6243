"""Token ids in binary files: frequency-ranked ids in byte-aligned variable-length coding.

Ids get ranks by their frequency in the corpus (the most frequent is 0, ties by id). A block holds
whole documents in ascending doc_id order. Its ranks take one to four data bytes each; the sizes
stand in a separate control stream, two bits a rank, four ranks to a control byte. Decoding looks
control bytes up in a numpy table. Blocks are rows of a Parquet table that Spark writes, so a lost
executor leaves no half-written file; ``blocks_to_bytes`` has a block's layout.

A block is closed at ``BLOCK_IDS`` ids, texts are encoded a few MB at a time and blocks are taken one
by one from what a task reads, so a task's memory follows neither its share of rows nor Arrow's
batches; a document of more ids than a block has is a block of its own.

Defined cases: a null or empty text has the end id only; rows that share a doc_id are in the order
of their texts' hashes, null first; null doc_ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.tokenizing import encoder, relieve, sliced, vocabulary_path

MAGIC = b"QMTB"
#: Ids in a block, at most, but for a longer document's.
BLOCK_IDS = 1 << 18
#: Blocks whose places may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
_SIZES = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks under 2^32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ranks again; sizes come from a table of all 256 control bytes."""
    sizes = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(sizes) - sizes
    out = raw[at].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in (1, 2, 3):
        long = np.flatnonzero(sizes > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block_to_bytes(doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    """MAGIC, then documents, ids and control bytes as unsigned 64-bit counts, then doc_ids, null marks, sizes, control and data."""
    control, data = encode_ranks(ranks)
    return b"".join([MAGIC, struct.pack("<QQQ", len(doc_ids), len(ranks), len(control)), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), sizes.astype("<u4").tobytes(), control, data])


def bytes_to_block(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    block = memoryview(block)
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, c = struct.unpack_from("<QQQ", block, 4)
    at = 28
    doc_ids = np.frombuffer(block, "<i8", docs, at)
    nulls = np.frombuffer(block, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(block, "<u4", docs, at := at + docs)
    at += 4 * docs
    return doc_ids, nulls.astype(bool), sizes.astype(np.int64), decode_ranks(block[at : at + c], block[at + c :], n)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


_IDS = "shard int, block int, docs binary, nulls binary, sizes binary, ids binary, wide boolean"


def _tokenized(vocabulary: str, end_id: int):
    """Arrow batches of (doc_id, text) to rows of whole documents' ids, BLOCK_IDS a row at most."""

    def run(batches):
        encode, shard, block = encoder(vocabulary), _partition(), 0
        held, n = [], 0

        def row():
            d, u, s, i = (np.concatenate(x) for x in zip(*held, strict=True))
            wide = bool(i.max() > 0xFFFF)
            blobs = [d.astype("<i8"), u.astype(np.uint8), s.astype("<u4"), i.astype("<u4" if wide else "<u2")]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([wide])], ["shard", "block", "docs", "nulls", "sizes", "ids", "wide"])

        for batch in batches:
            for b in sliced(batch):
                ids, sizes = encode(b.column(1).to_pylist())
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                out = np.full(int(ends[-1]), end_id, np.uint32)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = ids
                doc_ids, nulls = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
                lo, base = 0, 0
                while lo < len(sizes):
                    hi = int(np.searchsorted(ends, base + BLOCK_IDS - n, "right"))
                    if hi > lo or not n:
                        hi = max(hi, lo + 1)
                        held.append((doc_ids[lo:hi], nulls[lo:hi], sizes[lo:hi], out[base : ends[hi - 1]]))
                        n += int(ends[hi - 1]) - base
                        lo, base = hi, int(ends[hi - 1])
                    if lo < len(sizes):
                        yield row()
                        held, n, block = [], 0, block + 1
                held = [tuple(x.copy() for x in h) for h in held]  # no views of what is large
        if held:
            yield row()
        relieve()

    return run


def _each(batches, *names: str):
    """The rows of record batches one by one; binary values as buffers."""
    for b in batches:
        cols = [b.column(n) for n in names]
        for k in range(b.num_rows):
            yield [c[k].as_buffer() if pa.types.is_binary(c.type) else c[k].as_py() for c in cols]


def _ids(ids, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2")


def _count(batches):
    total = np.zeros(0, np.int64)
    for ids, wide in _each(batches, "ids", "wide"):
        n = np.bincount(_ids(ids, wide))
        if len(n) > len(total):
            total = np.concatenate([total, np.zeros(len(n) - len(total), np.int64)])
        total[: len(n)] += n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Write ``docs`` (doc_id, text) to ``path``: blocks in ``path/blocks`` and, by rank, ids in ``path/ranks``."""
    spark = docs.sparkSession
    # Rows of one id may be many, and alike: they are dealt by the hash of their text and their place.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_at").sortWithinPartitions("doc_id", "_hash", "_at").select("doc_id", "text")
    rows, held = common.materialize(ordered.mapInArrow(_tokenized(vocabulary, end_id), _IDS), "token-ids")
    # No more rows than the vocabulary has ids.
    counts = rows.select("ids", "wide").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r.id for r in counts.orderBy(F.desc("n"), "id").collect()]
    common.write(spark.createDataFrame([(i, x) for i, x in enumerate(ranked)], "rank long, id long").coalesce(1), f"{path}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[np.array(ranked, np.int64)] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    def pack(batches):
        for shard, block, docs, nulls, sizes, ids, wide in _each(batches, "shard", "block", "docs", "nulls", "sizes", "ids", "wide"):
            ids = _ids(ids, wide)
            out = block_to_bytes(np.frombuffer(docs, "<i8"), np.frombuffer(nulls, np.uint8), np.frombuffer(sizes, "<u4"), shared.value[ids])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([out], pa.binary())})

    common.write(rows.mapInArrow(pack, "shard int, block int, n_ids long, payload binary"), f"{path}/blocks", "uncompressed")
    common.release(spark, held)


def read_token_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    blocks = spark.read.schema("shard int, block int, n_ids long, payload binary").parquet(f"{path}/blocks")
    by_rank = [r.id for r in spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").collect()]  # no more than the vocabulary has
    shared = spark.sparkContext.broadcast(np.array(by_rank, "<u4"))
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each written partition
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("base") + F.col("inside")).alias("first"))
    if blocks.count() <= BROADCAST_BLOCKS:
        places = F.broadcast(places)

    def unpack(batches):
        for first, payload in _each(batches, "first", "payload"):
            doc_ids, nulls, sizes, ranks = bytes_to_block(payload)
            ids = shared.value[ranks]
            ends = np.cumsum(sizes)
            starts = ends - sizes
            raw = memoryview(ids).cast("B")
            out = {"doc_id": pa.array(doc_ids, pa.int64(), mask=nulls), "start": pa.array(first + starts, pa.int64()), "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(places, ["shard", "block"]).select("first", "payload").mapInArrow(unpack, schema)


def token_files_query(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    write_token_files(common.documents(spark, sf_dir), path, vocabulary_path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
