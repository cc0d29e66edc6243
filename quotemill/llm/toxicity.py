"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of context windows.

The lexicon is learnt from labelled documents: words that far more toxic texts have than others,
beside a few fixed seeds. A lazily built automaton over sets of (trie node, errors) finds the terms
within one error of a word; each distinct word goes through it once in a Python worker. A hit's
window of words tells abuse (a person addressed) from quotation (quotation marks, verbs of
reporting). A logistic model over these sums, fitted to at most ``FIT_ROWS`` labelled documents,
gives the score.

Defined cases: null, empty and blank texts have no hits and get the score of a text without any; a
label with a null toxic or doc_id teaches nothing; a text with labels of both kinds, by itself or as
a repeated row, is toxic; where no label of either kind is there, the model is the fixed one of
``DEFAULT``; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm import common
from quotemill.llm.tokenizing import sliced

#: Labelled documents at most that lexicon and model are fitted to, least hash of doc_id first.
FIT_ROWS = 20_000
#: Toxic documents with a term at least; its least log odds ratio.
SUPPORT, ODDS = 3, 2.5
#: Letters at least of a term, and of one that is matched with an error.
LETTERS, FUZZY = 4, 5
#: Words looked at on either side of a hit.
WINDOW = 6
#: Distinct words kept by a worker, and states of its automaton.
KNOWN_WORDS, STATES = 250_000, 200_000
#: Words that address a person, verbs of reporting, marks of quotation.
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi ton ta vous votre tú ti usted eres vosotros".split())
REPORT = frozenset("said says say wrote writes called calls quoted quote quotes word term means sagte sagt schrieb wort dit écrit mot dijo dice escribió palabra".split())
QUOTES = "\"“”„«»‘’"
#: Terms known without any label.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting")
FEATURES = ["one", "most", "exact", "fuzzy", "quoted", "aimed", "dense"]
#: Weights of the features where there is nothing to learn from.
DEFAULT = [-3.0, 0.6, 0.6, 0.3, -0.4, 0.3, 0.5]
_STRIP = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"


class LexiconAutomaton:
    """Terms and their weights in a trie, intersected with Levenshtein automata of one error."""

    def __init__(self, weights: dict[str, float], errors: int = 1):
        self.errors, self.next, self.term = errors, [{}], [None]
        self.weights = weights
        for w in weights:
            at = 0
            for ch in w:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                at = self.next[at][ch]
            self.term[at] = w
        self.ids, self.states, self.moves = {}, [], []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes.items())
        while todo:  # a term's letter left out
            node, e = todo.pop()
            if e < self.errors:
                for child in self.next[node].values():
                    if nodes.get(child, e + 2) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        if not nodes:
            return -1
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node, e):
            if e <= self.errors and nodes.get(node, e + 1) > e:
                nodes[node] = e

        for node, e in self.states[state]:
            reach(node, e + 1)  # a letter too many
            for letter, child in self.next[node].items():
                reach(child, e + (letter != ch))
        out = self.moves[state][ch] = self._state(nodes)
        return out

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best term near ``word``: fewest errors, then the largest weight."""
        at, moves = self.start, self.moves
        for ch in word:
            to = moves[at].get(ch)
            at = self._move(at, ch) if to is None else to
            if at < 0:
                return None
        best = None
        for node, e in self.states[at]:
            t = self.term[node]
            if t is not None and (not e or len(t) >= FUZZY):
                found = (e, -self.weights[t])
                best = found if best is None or found < best else best
        return best and (-best[1], best[0])


class Scorer:
    """Features of texts; keeps what it has found out of distinct words."""

    def __init__(self, weights: dict[str, float]):
        self.automaton = LexiconAutomaton(weights)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def _learn(self, words: set[str], fresh: set[str]) -> None:
        """Look up the ``fresh`` ones of a text's words; after a reset, all of them."""
        if len(self.known) > KNOWN_WORDS:
            self.known, self.hits = set(), {}
            if len(self.automaton.states) > STATES:
                self.automaton = LexiconAutomaton(self.automaton.weights)
            fresh = words
        for raw in fresh:
            word = raw.strip(_STRIP)
            if len(word) >= LETTERS - 1 and (found := self.automaton.match(word)):
                self.hits[raw] = found
        self.known.update(fresh)

    def features(self, text: str | None) -> list[float]:
        words = (text or "").lower().split()
        distinct = set(words)
        if fresh := distinct - self.known:
            self._learn(distinct, fresh)
        mine = {w: self.hits[w] for w in distinct if w in self.hits} if self.hits else {}
        if not mine:
            return [1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
        most = exact = fuzzy = quoted = aimed = 0.0
        n = 0
        for i, w in enumerate(words):
            if w not in mine:
                continue
            weight, errors = mine[w]
            n += 1
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            marks = w[0] in QUOTES or any(x[0] in QUOTES for x in before), w[-1] in QUOTES or any(x[-1] in QUOTES for x in after)
            if all(marks) or any(x.strip(_STRIP) in REPORT for x in before):
                quoted += weight
            elif any(x.strip(_STRIP) in ADDRESS for x in (*before, *after)):
                aimed += weight
            if errors:
                fuzzy += weight
            else:
                exact += weight
                most = max(most, weight)
        return [1.0, most, math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(aimed), math.log1p(100 * n / len(words))]


def _word_counts(batches):
    counts: dict[str, list[int]] = {}
    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w in {x.strip(_STRIP) for x in set((text or "").lower().split())}:
                if len(w) >= LETTERS:
                    counts.setdefault(w, [0, 0])[toxic] += 1
    if counts:
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(counts), pa.string()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(weights: dict[str, float]):
    def run(batches):
        scorer = Scorer(weights)
        for b in batches:
            rows = np.array([scorer.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in rows.T)], ["toxic", *FEATURES])

    return run


def train(docs: DataFrame, labels: DataFrame, fold=None) -> tuple[dict[str, float], list[float]]:
    """Lexicon and model from labelled rows; ``fold``: which of them may teach."""
    ids = labels.where("doc_id is not null and toxic is not null")
    if fold is not None:
        ids = ids.where(fold)
    # At most FIT_ROWS rows of two numbers.
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sample, _ = common.materialize(texts.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    counts = sample.select("text", "toxic").mapInArrow(_word_counts, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Words that stand in SUPPORT of at most FIT_ROWS documents.
    learnt = counts.where(F.col("toxic") >= SUPPORT).select("term", odds.alias("odds")).where(F.col("odds") >= ODDS).orderBy(F.desc("odds"), "term").collect()
    weights = dict.fromkeys(SEEDS, ODDS) | {r.term: r.odds for r in learnt}
    if not clean or not toxic:
        return weights, DEFAULT
    rows = sample.select("toxic", "text").mapInArrow(_featured(weights), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES)).select(*FEATURES, "toxic").collect()  # FIT_ROWS at most
    data = np.array(sorted(map(tuple, rows)), float)
    return weights, fit_logistic(data[:, :-1], data[:, -1]).tolist()


def score(docs: DataFrame, weights: dict[str, float], model: list[float], others: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text), and the row's ``others``, of which the text may be one."""
    rest = [c for c in others if c != "text"]

    def run(batches):
        scorer, w = Scorer(weights), np.array(model)
        for batch in batches:
            for b in sliced(batch):
                x = np.array([scorer.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))), *(b.column(c) for c in others)], ["doc_id", "score", *others])

    typed = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest).mapInArrow(run, "doc_id long, score double" + typed)


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    weights, model = train(docs, common.table(spark, sf_dir, "labels"), common.fold(F.col("doc_id"), 5) != 0)
    return score(docs, weights, model).select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
