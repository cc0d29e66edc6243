"""Quality classifier by co-training of a text view and a page-metadata view.

Two models see different things: one the words and the shape of the text, the other what is known of
its page (source, language, size). The text view has log odds of hashed words and word pairs, the
page view those of its fields; each view's odds become a probability by a logistic calibration. In
every round all unlabelled documents are scored by both views, and what one view is sure of teaches
the other: its words, or its fields, are counted in beside those of the labelled rows, with a weight
that keeps them from outnumbering these. Documents that both are sure of but judge differently teach
nobody. At last the calibrated log odds of both views are combined, and every document is scored.

Calibrations are fitted to labelled rows by log odds that their own fold of ``FOLDS`` didn't teach.
At most ``FIT_ROWS`` labelled documents (least hash of doc_id first) are learnt from; unlabelled ones
all are, by counts that tasks add up. The driver holds ``BUCKETS`` numbers a class and fold.

Defined cases: null texts and metadata are empty; a label with a null quality or doc_id teaches
nothing; a document labelled both ways is good; with labels of one kind only, all scores are their
share (no labels: 0.5); repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.tokenizing import sliced
from quotemill.llm.toxicity import fit_logistic

FIT_ROWS = 12_000
#: Rounds of exchange, and how sure a view must be to teach the other.
ROUNDS, SURE = 2, 0.9
#: Hashed words and word pairs; folds of the labelled rows; what is added to each count.
BUCKETS, FOLDS, SMOOTH = 1 << 16, 4, 0.5
_SOURCES, _LANGS, _SIZES = 32, 8, 16
_PAGE = _SOURCES + _LANGS + _SIZES
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 300_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def grams(words: list[str]) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    if len(_hashes) > KNOWN_WORDS:
        _hashes.clear()
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ one[1:] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
    return (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)


def shape(t: str, words: list[str]) -> list[float]:
    """What a text looks like, whatever its words."""
    n, size = max(1, len(words)), max(1, len(t))
    lines = [x for x in t.split("\n") if x.strip()]
    letters = max(1, sum(map(len, words)))
    symbols = sum(t.count(c) for c in "#*$%&<>")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(len(words)) / 5,
        letters / n / 10,
        len(set(words)) / n,
        runs / n,
        symbols / size * 20,
        t.count("!") / size * 20,
        t.count("|") / size * 20,
        sum(map(str.isupper, words)) / n,
        sum(t.count(c) for c in ".?") / n * 5,
        t.count(",") / n * 5,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        min(1.0, len(words) / max(1, len(lines)) / 50),
        min(1.0, (t.count("http") + t.count("@")) / n * 20),
    ]


_SHAPE = 13


def fields(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of a page's source, language and size."""
    size = min(_SIZES - 1, max(0, n_chars or 0).bit_length())
    return [zlib.crc32((source or "").encode()) % _SOURCES, _SOURCES + zlib.crc32((lang or "").encode()) % _LANGS, _SOURCES + _LANGS + size]


def _odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of each bucket from the counts (class, bucket), each class's as shares."""
    share = np.log(counts + SMOOTH) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTH * counts.shape[1])
    return (share[1] - share[0]).astype(np.float32)


def _views(row, words_odds: np.ndarray, page_odds: np.ndarray) -> tuple[list[float], list[float]]:
    """Features of a document for the text's and the page's calibration."""
    text, source, lang, n_chars = row
    t = text or ""
    words = t.split()
    g = grams(words)
    return [1.0, float(words_odds[g].mean()) if len(g) else 0.0, *shape(t, words)], [1.0, *page_odds[fields(source, lang, n_chars)].tolist()]


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


#: Counts go from task to task as slices of so many buckets, a row each.
SLICE = 1 << 12
_COUNTED = "view int, fold int, label int, slice int, n binary"


def _counts(view: int, fold: int, label: int, n: np.ndarray) -> pa.RecordBatch:
    parts = {k // SLICE: n[k : k + SLICE] for k in range(0, len(n), SLICE)}
    parts = {k: v.astype("<f8").tobytes() for k, v in parts.items() if v.any()}
    keys = [pa.array([x] * len(parts), pa.int32()) for x in (view, fold, label)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["view", "fold", "label", "slice", "n"])


def _added(batches):
    """The sums of counts that have the same keys, of which a task has a few."""
    total: dict = {}
    for b in batches:
        for *key, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            v = np.frombuffer(n, "<f8")
            total[tuple(key)] = total[tuple(key)] + v if tuple(key) in total else v
    if total:
        cols = list(zip(*total, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["view", "fold", "label", "slice", "n"])


def _counted(batches):
    """Counts of labelled rows (text, source, lang, n_chars, y, fold) by view, fold and label; view 2 counts the rows."""
    total: dict = {}
    for batch in batches:
        for b in sliced(batch, 0):
            for text, source, lang, n_chars, y, fold in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                words, page, rows = total.setdefault((fold, y), (np.zeros(BUCKETS), np.zeros(_PAGE), np.zeros(1)))
                words += np.bincount(grams((text or "").split()), minlength=BUCKETS)
                page[fields(source, lang, n_chars)] += 1
                rows += 1
    for (fold, y), kinds in total.items():
        for view, n in enumerate(kinds):
            yield _counts(view, fold, y, n)


def _taught(model):
    """Counts that each view takes from the other, of rows (text, source, lang, n_chars) that it is sure of."""

    def run(batches):
        out = [[np.zeros(k) for _ in range(2)] for k in (BUCKETS, _PAGE, 1, 1)]
        for batch in batches:
            for b in sliced(batch, 0):
                for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    x, z = _views(row, model["words"], model["page"])
                    p, q = (float(_probability(np.array(v), model[k])) for v, k in ((x, "text_fit"), (z, "page_fit")))
                    says = [1 if v >= SURE else 0 if v <= 1 - SURE else -1 for v in (p, q)]
                    if says[0] >= 0 and says[1] >= 0 and says[0] != says[1]:
                        continue
                    if says[1] >= 0:
                        out[0][says[1]] += np.bincount(grams((row[0] or "").split()), minlength=BUCKETS)
                        out[2][says[1]] += 1
                    if says[0] >= 0:
                        out[1][says[0]][fields(*row[1:])] += 1
                        out[3][says[0]] += 1
        for view, kinds in enumerate(out):
            for label, n in enumerate(kinds):
                yield _counts(view, 0, label, n)

    return run


def _sums(counted: DataFrame, folds: int) -> list[np.ndarray]:
    """Counts by view as arrays (fold, label, bucket); there are no more rows than these have numbers."""
    out = [np.zeros((folds, 2, k)) for k in (BUCKETS, _PAGE, 1, 1)]
    for r in counted.repartition("view", "slice").mapInArrow(_added, _COUNTED).collect():  # a row for each slice of these arrays
        v = np.frombuffer(r.n, "<f8")
        out[r.view][r.fold, r.label, r.slice * SLICE : r.slice * SLICE + len(v)] += v
    return out


def _calibrated(sample: DataFrame, own: list[np.ndarray], more: list[np.ndarray]) -> dict:
    """The model of these counts: log odds of all, calibrated on labelled rows by those that leave a row's fold out."""
    tables = [[_odds(c.sum(axis=0) - c[k] + m) for k in range(FOLDS)] for c, m in zip(own, more, strict=True)]

    def run(batches):
        for batch in batches:
            for b in sliced(batch, 0):
                *rows, y, fold = (b.column(i).to_pylist() for i in range(6))
                x = [sum(_views(row, tables[0][k], tables[1][k]), []) for row, k in zip(zip(*rows, strict=True), fold, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = sorted((tuple(r.x), r.y) for r in sample.mapInArrow(run, "y int, x array<double>").collect())  # FIT_ROWS at most
    x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got], float)
    cut = 2 + _SHAPE
    text_fit, page_fit = fit_logistic(x[:, :cut], y), fit_logistic(x[:, cut:], y)
    both = np.stack([np.ones(len(y)), x[:, :cut] @ text_fit, x[:, cut:] @ page_fit], axis=1)
    return {"words": _odds(own[0].sum(axis=0) + more[0]), "page": _odds(own[1].sum(axis=0) + more[1]), "text_fit": text_fit, "page_fit": page_fit, "both": fit_logistic(both, y)}


_COLUMNS = ["text", "source", "lang", "n_chars"]


def train(docs: DataFrame, labels: DataFrame, fold=None, rounds: int = ROUNDS) -> dict:
    """Both views' models and their combination, from labelled rows and all unlabelled ones; ``fold``: which documents may teach."""
    ids = labels.where("doc_id is not null and quality is not null")
    rest = docs
    if fold is not None:
        ids, rest = ids.where(fold), rest.where(fold)
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max((F.col("quality") != 0).cast("int")).alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    ids, _ = common.materialize(ids.withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).cast("int")), "quality-labels")
    one = docs.select(F.col("doc_id").cast("long").alias("_id"), *_COLUMNS).join(F.broadcast(ids), "_id").select(*_COLUMNS, "y", "fold")
    sample, _ = common.materialize(one, "quality-sample")
    kinds = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return {"share": float(max(kinds, default=0.5))}
    own = _sums(sample.mapInArrow(_counted, _COUNTED), FOLDS)[:2]
    model = _calibrated(sample, own, [np.zeros((2, BUCKETS)), np.zeros((2, _PAGE))])
    unlabelled = rest.select(F.col("doc_id").cast("long").alias("_id"), *_COLUMNS).join(F.broadcast(ids.select("_id")), "_id", "left_anti").select(*_COLUMNS)
    for _ in range(rounds):
        found = _sums(unlabelled.mapInArrow(_taught(model), _COUNTED), 1)
        # As many rows as are labelled weigh in full, more of them as much together.
        more = [c[0] * min(1.0, sum(kinds.values()) / max(1.0, rows.sum())) for c, rows in zip(found[:2], found[2:], strict=True)]
        model = _calibrated(sample, own, more)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, text_score, page_score and score of each row of ``docs`` (doc_id, text, source, lang, n_chars)."""

    def run(batches):
        for batch in batches:
            for b in sliced(batch, 0):
                if "share" in model:
                    out = [np.full(b.num_rows, model["share"])] * 3
                else:
                    views = [_views(row, model["words"], model["page"]) for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)]
                    x, z = (np.array(v) for v in zip(*views, strict=True))
                    odds = np.stack([np.ones(len(x)), x @ model["text_fit"], z @ model["page_fit"]], axis=1)
                    out = [_probability(x, model["text_fit"]), _probability(z, model["page_fit"]), _probability(odds, model["both"])]
                yield pa.RecordBatch.from_arrays([b.column(4), *map(pa.array, out)], ["doc_id", "text_score", "page_score", "score"])

    return docs.select(*_COLUMNS, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, text_score double, page_score double, score double")


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    held = (common.fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return score(docs, model).select("doc_id", held, "text_score", "page_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
