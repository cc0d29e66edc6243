"""Language identification by mixture inference.

Letter trigrams of labelled texts give each language's likelihood of a word. Expectation
maximisation over a document's distinct words and their counts estimates its language proportions,
and the language set is the one of the best penalised likelihood among the likeliest two, three and
so on; the largest share in it is the prediction. Memory follows a document's distinct words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text
if there is nothing to learn from; rows with a null lang teach nothing; ties go to the language
that sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.tokenizing import sliced

#: Documents of each language at most that its trigrams are counted in, least hash of doc_id first.
FIT_ROWS = 1500
#: Hashed trigrams.
BUCKETS = 1 << 16
#: Rounds of expectation maximisation; penalty of a language in units of log(words).
ROUNDS, PENALTY = 8, 3.0
#: Distinct words kept by a worker; words whose likelihoods are in memory at once, but for a document of more.
KNOWN_WORDS, AT_ONCE = 400_000, 100_000


def _letters(word: str) -> str:
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def _grams(word: str) -> list[int]:
    w = f"  {word} "
    return [((ord(a) * 31 + ord(b)) * 8191 + ord(c)) * 0x9E3779B1 >> 7 & BUCKETS - 1 for a, b, c in zip(w, w[1:], w[2:])]


def _counted(batches):
    counts: dict[str, np.ndarray] = {}
    words: dict[tuple[str, str], int] = {}

    def settle():
        for (lang, w), n in words.items():
            if w := _letters(w):
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in _grams(w):
                    total[g] += n
        words.clear()

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in (text or "").lower().split():
                words[lang, w] = words.get((lang, w), 0) + 1
            if len(words) > KNOWN_WORDS:
                settle()
    settle()
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "gram": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})


def train(docs: DataFrame, fold=None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and for each the log likelihoods of the hashed trigrams."""
    ids = docs.where("doc_id is not null and text is not null and lang is not null")
    if fold is not None:
        ids = ids.where(fold)
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    sizes = {r.lang: r.n for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BUCKETS), np.float32)
    # First a share by hash that holds enough rows of each language, then exactly the least hashes.
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, int(min(1.0, (2 * FIT_ROWS + 200) / sizes[k]) * (1 << 30)))])
    drawn = ids.where(h < share[F.col("lang")]).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))).where(F.col("k") <= FIT_ROWS).select("doc_id", F.col("lang").alias("taught"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").join(F.broadcast(drawn) if len(langs) <= 200 else drawn, "doc_id").where("lang = taught").select("text", "lang")
    rows = texts.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # no more than BUCKETS for a language
    total = np.zeros((len(langs), BUCKETS))
    at = {k: i for i, k in enumerate(langs)}
    total[[at[k] for k in rows["lang"].to_pylist()], rows["gram"].to_numpy()] = rows["n"].to_numpy()
    smooth = 0.05
    return langs, np.log((total + smooth) / (total.sum(axis=1, keepdims=True) + smooth * BUCKETS)).astype(np.float32)


def _mixture(like: np.ndarray, counts: np.ndarray, doc: np.ndarray, starts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the ``allowed`` languages (a row for each document) and the log likelihoods, by expectation maximisation."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    words = np.add.reduceat(counts, starts)[:, None]
    top = like.max(axis=1, keepdims=True)
    odds = np.exp(like - top)
    for _ in range(ROUNDS):
        part = odds * share[doc]
        part *= (counts / np.maximum(part.sum(axis=1), 1e-30))[:, None]
        share = np.add.reduceat(part, starts) / words
    total = np.add.reduceat(counts * (np.log(np.maximum((odds * share[doc]).sum(axis=1), 1e-30)) + top[:, 0]), starts)
    return share, total


def infer(like: np.ndarray, starts: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the languages in each document's chosen set and its score; ``like`` has the log likelihoods of its distinct words, ``counts`` how often they stand."""
    n, langs = len(starts), like.shape[1]
    counts = np.ones(len(like)) if counts is None else counts.astype(float)
    sizes = np.diff(np.append(starts, len(like)))
    doc = np.repeat(np.arange(n), sizes)
    single = np.add.reduceat(like * counts[:, None], starts)
    best = single.argmax(axis=1)
    rows = np.arange(n)
    share = np.zeros((n, langs))
    share[rows, best] = 1
    penalty = PENALTY * np.log(np.add.reduceat(counts, starts) + 1.0)
    worth = single[rows, best].astype(float)
    if langs > 1:
        full, total = _mixture(like, counts, doc, starts, np.ones((n, langs)))
        rank = (-full).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
        for size in range(2, langs + 1):
            # No set fits better than all languages do, so most documents need no further look.
            open_ = np.flatnonzero(total - penalty * (size - 1) > worth)
            if not len(open_):
                break
            pick = np.isin(doc, open_)
            at = np.concatenate([[0], np.cumsum(sizes[open_])[:-1]])
            part, fit = _mixture(like[pick], counts[pick], np.repeat(np.arange(len(open_)), sizes[open_]), at, (rank[open_] < size).astype(float))
            better = fit - penalty[open_] * (size - 1) > worth[open_]
            worth[open_[better]] = (fit - penalty[open_] * (size - 1))[better]
            share[open_[better]] = part[better]
    if langs > 1:
        two = np.partition(single, -2, axis=1)
        sure = 1 / (1 + np.exp(-np.clip(np.abs(two[:, -1] - two[:, -2]), 0, 30)))
    else:
        sure = np.ones(n)
    return share, np.clip(share.max(axis=1) * sure, 0, 1)


class Identifier:
    """Predicts batches of texts; keeps the likelihoods of distinct words."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        self._reset()

    def _reset(self):
        self.at: dict[str, int] = {}
        self.like = np.zeros((1 << 12, len(self.langs)), np.float32)

    def _learn(self, words) -> None:
        for w in list(words):
            k = len(self.at) + 1
            if letters := _letters(w):
                if k >= len(self.like):
                    self.like = np.concatenate([self.like, np.zeros_like(self.like)])
                self.like[k] = self.table[:, _grams(letters)].sum(axis=1)
                self.at[w] = k
            else:
                self.at[w] = -k  # no letter

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[list[str]], list[list[float]]]:
        """For each text its language, the score, and the languages of its set with their shares, the largest first."""
        out = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        if not self.langs:
            return out
        held, size = [], 0
        for i, t in enumerate(texts):
            counts = Counter((t or "").lower().split())
            if any(w not in self.at for w in counts):
                if len(self.at) + len(counts) > KNOWN_WORDS and self.at:
                    if held:  # their words' places are about to go
                        self._finish(held, out)
                        held, size = [], 0
                    self._reset()
                self._learn(w for w in counts if w not in self.at)
            ids = np.fromiter(map(self.at.__getitem__, counts), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))[ids > 0]
            ids = ids[ids > 0]
            if len(ids):
                held.append((i, ids, n))
                size += len(ids)
            if size >= AT_ONCE:
                self._finish(held, out)
                held, size = [], 0
        if held:
            self._finish(held, out)
        return out

    def _finish(self, held, out) -> None:
        sizes = np.array([len(x) for _, x, _ in held])
        share, sure = infer(self.like[np.concatenate([x for _, x, _ in held])], np.cumsum(sizes) - sizes, np.concatenate([n for _, _, n in held]))
        order = (-share).argsort(axis=1, kind="stable")
        for (i, *_), by, row, s in zip(held, order.tolist(), share.tolist(), sure.tolist(), strict=True):
            by = [k for k in by if row[k] > 0]
            out[0][i], out[1][i], out[2][i], out[3][i] = self.langs[by[0]], s, [self.langs[k] for k in by], [row[k] for k in by]


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, and the document's languages with their shares, of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, table))

    def run(batches):
        model = Identifier(*shared.value)
        for batch in batches:
            for b in sliced(batch):
                pred, score, languages, shares = model(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(languages, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], ["doc_id", "lang_pred", "score", "languages", "shares"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


def langid_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    fold = common.fold(F.col("doc_id"), 4)
    found = identify(docs, *train(docs.select("doc_id", "text", "lang"), fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "languages", "shares")
