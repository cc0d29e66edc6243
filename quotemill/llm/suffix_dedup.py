"""Removal of repeated byte strings with a run-length index.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (in a document of smaller
doc_id, or earlier in the same one) goes. The corpus is too large for one index, so each window of
WIDTH bytes is dealt by its minimiser, the least hash of the SEED-byte strings in it: equal windows
have the same one. The windows that share an occurrence of a minimiser form a stretch of bytes.

1. Stretches equal as a whole, by 96 bits of XXH3 beside the minimiser's own hash, are settled first:
   all but the earliest go. Each task does so for its own before the shuffle, so copies and popular
   passages don't pile up at a minimiser. Minimisers that hold a large share of all stretches are
   dealt to several tasks.
2. Stretches that share a minimiser and differ are fetched from the texts. For each batch of such
   groups a run-length Burrows-Wheeler index is built and matching statistics are streamed from it;
   windows with a match of WIDTH bytes or more are held against the earliest equal one.
3. Groups too large for a batch are cut into several as they are streamed; the windows that their
   indexes leave are settled by 128 bits of XXH3 of the window.

Long texts are scanned ``BLOCK`` windows at a time, and a stretch may end there.

Defined cases: null is the empty text; texts under WIDTH bytes lose nothing; rows that share a
doc_id, or have none, are documents of their own, ordered by doc_id (null first), then text; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.runindex import RunIndex
from quotemill.llm.token_binary import _each, _partition
from quotemill.llm.tokenizing import relieve, sliced

WIDTH = 100
SEED = 32
#: Stretches of a minimiser in one batch at most; larger groups are cut.
GROUP = 4000
#: Bytes of stretches in an index, at least, but for a task's last one.
BATCH_BYTES = 1 << 19
#: Stretches held in a task until their first ones are passed on.
HELD = 1 << 19
#: Windows of a text scanned at once; rows of windows passed on at once.
BLOCK, SLICE = 1 << 20, 1 << 16
#: One stretch in so many is looked at for crowded minimisers, of which there are so many at most.
SAMPLED, SHARES = 16, 20_000
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_PLACE = np.uint64((1 << 31) - 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            _power[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, base, np.uint64))])
    return _power[0], _power[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix(raw: np.ndarray) -> np.ndarray:
    power, _ = _tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * power[: len(raw)], out=out[1:])
    return out


def _digests(raw, first, end) -> np.ndarray:
    """XXH3 of the strings from ``first`` to ``end``: two 64-bit numbers each."""
    digest, view = xxhash.xxh3_128_digest, memoryview(raw)
    return np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(first.tolist(), end.tolist(), strict=True)]), ">u8").astype(np.uint64).reshape(-1, 2)


def stretches(text, width: int = WIDTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the minimiser, two hashes of the stretch) for each stretch of the bytes ``text``."""
    raw = np.frombuffer(text, np.uint8)
    found = [_stretches(raw[lo : lo + BLOCK + width - 1], lo, width, seed) for lo in range(0, len(raw) - width + 1, BLOCK)]
    if not found:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.uint64, np.uint64, np.int32))
    first, last, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    whole = _digests(text, first, last + width)
    return first, last, anchor, whole[:, 0], (whole[:, 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _stretches(raw: np.ndarray, base: int, width: int, seed: int):
    n = len(raw)
    total = _prefix(raw)
    _, inverse = _tables(n + 1)
    own = _mix((total[seed:] - total[: n - seed + 1]) * inverse[: n - seed + 1])
    least = (own & ~_PLACE) | np.arange(len(own), dtype=np.uint64)
    size, span = 1, width - seed + 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    at = (least & _PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.append(first[1:], len(at)) - 1
    return first + base, last + base, own[at[first]]


def _merged(ord_: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, joined where they touch."""
    by = np.lexsort((start, ord_))
    o, s, e = ord_[by], start[by], end[by]
    if not len(o):
        return o, s, e
    doc = np.concatenate([[0], np.cumsum(o[1:] != o[:-1])])
    reach = np.maximum.accumulate(e + doc * (1 << 40)) - doc * (1 << 40)
    opens = np.ones(len(o), bool)
    opens[1:] = (o[1:] != o[:-1]) | (s[1:] > reach[:-1])
    heads = np.flatnonzero(opens)
    return o[heads], s[heads], np.maximum.reduceat(e, heads)


_SCHEMA = "kind int, a long, b long, c int, ord long, start long, end long"
_MARK, _STRETCH, _WINDOW = 0, 1, 2


def _rows(kind: int, a, b, c, ord_, start, end) -> pa.RecordBatch:
    n = len(ord_)
    zero = np.zeros(n, np.int64)
    cols = [np.full(n, kind, np.int32), *(zero if x is None else x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in (a, b)), (zero if c is None else c).astype(np.int32), *(x.astype(np.int64) for x in (ord_, start, end))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["kind", "a", "b", "c", "ord", "start", "end"])


def _firsts(group: np.ndarray, ord_: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a row is the earliest of its group."""
    step = np.diff(ord_)
    by = np.lexsort((start, ord_)) if ((step < 0) | (step == 0) & (np.diff(start) < 0)).any() else np.arange(len(ord_))
    first = np.zeros(len(group), bool)
    codes = pd.factorize(group[by])[0]
    where = np.full(codes.max(initial=-1) + 1, -1, np.int64)
    where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    first[by[where]] = True
    return first


def _scan(width: int, seed: int):
    """Texts to stretches; of stretches equal in a task's memory only the earliest goes on, the others are marked."""

    def settle(held):
        ord_, first, last, anchor, whole, more = (np.concatenate(c) for c in zip(*held, strict=True))
        second, kinds = pd.factorize(more)
        keep = _firsts(pd.factorize(whole)[0].astype(np.int64) * len(kinds) + second, ord_, first)
        yield _rows(_STRETCH, anchor[keep], whole[keep], more[keep], ord_[keep], first[keep], last[keep] + width)
        o, s, e = _merged(ord_[~keep], first[~keep], last[~keep] + width)
        if len(o):
            yield _rows(_MARK, None, None, None, o, s, e)

    def run(batches):
        held, n = [], 0
        for k, raw in _each(batches, "ord", "raw"):
            if raw is None or len(raw) < width:
                continue
            first, last, *rest = stretches(raw, width, seed)
            held.append((np.full(len(first), k, np.int64), first, last, *rest))
            n += len(first)
            if n >= HELD:
                yield from settle(held)
                held, n = [], 0
        if held:
            yield from settle(held)
        del held
        relieve()

    return run


def _match(group: int):
    """Streams stretches (a, b, c, ord, start, end, deal) sorted by (a, b, c, ord, start): marks the repeated ones, passes
    on the first ones of minimisers that have several, or that are dealt to several tasks. A minimiser's rows go on
    with b = -1, or, beyond ``group`` of them or dealt, with the number of the batch they are for."""

    def passed(cols, rank, size):
        a, ord_, start, end, deal = cols
        salted = (size > group) | (deal >= 0)
        out = salted | (size > 1)
        salt = np.where(salted, (deal + 1 << 32) + rank // group, -1)
        a, salt, ord_, start, end = (x[out] for x in (a, salt, ord_, start, end))
        return _rows(_STRETCH, a, salt, None, ord_, start, end)

    def run(batches):
        seen, held, done = None, None, 0  # last (a, b, c); first stretches of that a not yet passed on, or how many were
        for batch in batches:
            a, b, c, ord_, start, end, deal = (batch.column(i).to_numpy() for i in range(7))
            if not len(a):
                continue
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            fresh[0] = seen != (a[0], b[0], c[0])
            if not fresh.all():
                yield _rows(_MARK, None, None, None, ord_[~fresh], start[~fresh], end[~fresh])
            now = [x[fresh] for x in (a, ord_, start, end, deal)]
            if held is not None:
                now = [np.concatenate(pair) for pair in zip(held, now, strict=True)]
            before, seen = seen, (a[-1], b[-1], c[-1])
            if not len(now[0]):
                continue
            heads = np.concatenate([[0], np.flatnonzero(now[0][1:] != now[0][:-1]) + 1])
            n = np.diff(np.append(heads, len(now[0])))
            rank = np.arange(len(now[0])) - np.repeat(heads, n)
            sizes = n.copy()
            if done and before[0] == now[0][0]:
                sizes[0] += done
                rank[: n[0]] += done
            # The last minimiser may go on in the next batch.
            cut, done, held = len(rank), int(sizes[-1]), None
            if done <= group:
                cut, done, held = heads[-1], 0, [x[heads[-1] :] for x in now]
            if cut:
                yield passed([x[:cut] for x in now], rank[:cut], np.repeat(sizes, n)[:cut])
        if held is not None:
            yield passed(held, np.arange(len(held[0])), np.full(len(held[0]), len(held[0])))

    return run


def _deals(stretch: DataFrame, group: int) -> DataFrame:
    """(a, deals): minimisers that take up more than a ``1 / SHARES`` of a hashed sample, so ``SHARES`` rows at most,
    and the number of tasks to deal them to. The sample decides on nothing but the dealing."""
    part = stretch.where(F.pmod(F.xxhash64("a", "ord", "start"), F.lit(SAMPLED)) == 0)
    least = max(group // SAMPLED, part.count() // SHARES)
    return part.groupBy("a").count().where(F.col("count") > least).select("a", (F.ceil(F.col("count") * SAMPLED / group) + 1).cast("long").alias("deals"))


def _lists(column) -> tuple[list[int], dict[str, np.ndarray]]:
    """Ends of a column's lists of structs (null: empty), and the structs' fields, one list after the other."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    flat = column.flatten()
    return ends, {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


def _fetch(batches):
    """(ord, raw, parts: stretches of it) to a row for each stretch with its bytes."""
    for b in batches:
        if not b.num_rows:
            continue
        ends, part = _lists(b.column("parts"))
        out, at = [], 0
        for ord_, raw, end in zip(b.column("ord").to_pylist(), (x.as_buffer() for x in b.column("raw")), ends, strict=True):
            for lo in range(at, end, 20_000):
                own = [part[k][lo : min(end, lo + 20_000)].tolist() for k in ("a", "b", "start", "end")]
                view = memoryview(raw)
                out.extend((x, salt, ord_, s, salt >= 0, view[s:e]) for x, salt, s, e in zip(*own, strict=True))
                if len(out) >= 20_000:
                    yield _fetched(out)
                    out = []
            at = end
        if out:
            yield _fetched(out)


def _fetched(rows) -> pa.RecordBatch:
    kinds = {"a": pa.int64(), "salt": pa.int64(), "ord": pa.int64(), "start": pa.int64(), "salted": pa.bool_(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(map(bytes, c) if n == "data" else c, k, size=len(c)) for c, (n, k) in zip(zip(*rows, strict=True), kinds.items(), strict=True)], list(kinds))


def _index(width: int, size: int = BATCH_BYTES):
    """Streams stretches sorted by (a, salt): builds the index of a batch of groups, marks repeated windows, passes on those of salted groups."""

    def settle(held):
        salted = np.array([r[3] for r in held])
        ord_, start = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
        index = RunIndex([r[4] for r in held])
        start = start - (index.ends - index.sizes)  # from a place in the index to one in the text
        at, group = index.repeated(width)
        own = index.owner[at]
        keep = _firsts(group, ord_[own], start[own] + at)
        gone, by = at[~keep], own[~keep]
        o, s, e = _merged(ord_[by], start[by] + gone, start[by] + gone + width)
        if len(o):
            yield _rows(_MARK, None, None, None, o, s, e)
        if salted.any():
            left = (index.room >= width) & np.repeat(salted, index.sizes)
            left[gone] = False
            every = np.flatnonzero(left)
            for lo in range(0, len(every), SLICE):
                here = every[lo : lo + SLICE]
                two, own = _digests(index.text, here, here + width), index.owner[here]
                yield _rows(_WINDOW, two[:, 0].copy(), two[:, 1].copy(), None, ord_[own], start[own] + here, start[own] + here + width)

    def run(batches):
        held, n, last = [], 0, None
        for a, salt, *row, data in _each(batches, "a", "salt", "ord", "start", "salted", "data"):
            if held and n >= size and (a, salt) != last:
                yield from settle(held)
                held, n = [], 0
            held.append((a, *row, bytes(data)))
            n, last = n + len(data), (a, salt)
        if held:
            yield from settle(held)
        del held
        relieve()

    return run


def _typed(docs: DataFrame, names: tuple[str, ...]) -> str:
    return "".join(f", {n} {docs.schema[n].dataType.simpleString()}" for n in names)


def _number(batches):
    at = _partition() << 40
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(b.num_rows), pa.int64()), *b.columns], ["ord", *b.schema.names])
        at += b.num_rows


def numbered(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """(ord, doc_id, text, others) where ord is distinct and ordered as the documents are."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *others)
    state = texts.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    if state.known == state.n and not texts.groupBy("doc_id").count().where("count > 1").limit(1).collect():
        return texts.select(F.col("doc_id").alias("ord"), "*")
    # Ranges go by the texts' beginnings, which tie only where the rest is sorted in one task: the driver samples them.
    ordered = texts.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text", *others)
    return common.materialize(ordered.mapInArrow(_number, "ord long, doc_id long, text string" + _typed(docs, others)), "numbered")[0]


def _raw() -> Column:
    return F.col("text").cast("binary").alias("raw")


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(ord, start, end): byte spans to remove from ``docs`` (ord, text); spans may overlap."""
    spark = docs.sparkSession
    one, at_one = common.materialize(docs.select("ord", _raw()).mapInArrow(_scan(width, seed), _SCHEMA), "stretches")
    stretch = one.where(F.col("kind") == _STRETCH).select("a", "b", "c", "ord", "start", "end")
    deal = F.coalesce(F.pmod(F.xxhash64("b"), F.col("deals")), F.lit(-1)).alias("deal")
    marked = stretch.join(F.broadcast(_deals(stretch, group)), "a", "left").select("a", "b", "c", "ord", "start", "end", deal)
    dealt = marked.repartition("a", "deal").sortWithinPartitions("a", "b", "c", "ord", "start")
    two, at_two = common.materialize(dealt.mapInArrow(_match(group), _SCHEMA), "shared-minimisers")
    marks, _ = common.materialize(one.where(F.col("kind") == _MARK).unionByName(two.where(F.col("kind") == _MARK)), "marks")
    shared = two.where(F.col("kind") == _STRETCH)
    parts = shared.groupBy("ord").agg(F.collect_list(F.struct("a", "b", "start", "end")).alias("parts"))
    data = docs.select("ord", _raw()).join(parts, "ord").mapInArrow(_fetch, "a long, salt long, ord long, start long, salted boolean, data binary")
    three, _ = common.materialize(data.repartition("a", "salt").sortWithinPartitions("a", "salt", "ord", "start").mapInArrow(_index(width), _SCHEMA), "index-marks")
    common.release(spark, at_one)
    common.release(spark, at_two)
    earliest = Window.partitionBy("a", "b").orderBy("ord", "start")
    late = three.where(F.col("kind") == _WINDOW).withColumn("n", F.row_number().over(earliest)).where("n > 1")
    spans = ["ord", "start", "end"]
    return marks.select(spans).unionByName(three.where(F.col("kind") == _MARK).select(spans)).unionByName(late.select(spans))


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            for b in sliced(batch):
                yield cut(b)

    def cut(b):
        out, at = [], 0
        ends, span = _lists(b.column("spans"))
        for doc_id, raw, end in zip(b.column("doc_id").to_pylist(), (x.as_buffer() for x in b.column("raw")), ends, strict=True):
            view = memoryview(raw) if raw is not None else memoryview(b"")
            kept, removed, n = view, 0, 0
            if end > at:
                _, s, e = _merged(np.zeros(end - at, np.int64), span["start"][at:end], span["end"][at:end])
                removed, n = int((e - s).sum()), len(s)
                edges = [0, *(x for p in zip(s.tolist(), e.tolist(), strict=True) for x in p), len(view)]
                kept = b"".join(view[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            row = (doc_id, len(view), removed, n, hashlib.sha256(kept).hexdigest())
            if with_text:
                shown = None if raw is None else str(view, "utf-8", "replace")
                if n:  # a character of which a byte stays, stays
                    stay = np.ones(len(view), bool)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        stay[x:y] = False
                    codes = np.frombuffer(raw, np.uint8)
                    lead = np.flatnonzero((codes & 0xC0) != 0x80)
                    whole = np.repeat(np.logical_or.reduceat(stay, lead), np.diff(np.append(lead, len(codes))))
                    shown = codes[whole].tobytes().decode("utf-8", "replace")
                row = (*row, shown)
            out.append(row)
            at = end
        kinds = [pa.int64()] * 4 + [pa.string()] * (1 + with_text)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * with_text
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)), *b.columns[3:]], names + b.schema.names[3:])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, width: int = WIDTH, others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text); with the text that is kept if asked for, and the row's ``others``."""
    ready = numbered(docs, others)
    spans = repeated_spans(ready, width)
    gone = spans.groupBy("ord").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text + _typed(docs, others)
    return ready.join(gone, "ord", "left").select("doc_id", _raw(), "spans", *others).mapInArrow(_cut(with_text), schema)


def suffix_dedup_query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))
