"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of a bias and the weights of its
words, and a document's score is the noisy-or of its sentences' scores and a leak, which stands for
labels that no sentence explains: ``1 - (1 - leak) * prod(1 - p_sentence)``. Weights are trained from
document labels only, through that formula, so training itself finds out which sentences offend.

The classifier is fitted on the driver to a bounded sample of labelled documents: at most
``max_docs`` of them in the order of a hash of the id, and of those as many as hold ``max_chars``
together. Scoring is on the executors, over whole texts, with the few words that have a weight.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casequarry.llm.common import fresh

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: A word, or what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
#: Lengths of the beginnings of words that are features beside the words.
PREFIXES = (4, 6)


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample, and of the training."""

    max_docs: int = 6000
    max_chars: int = 24_000_000
    #: A word needs so many documents of the sample to get a weight.
    min_docs: int = 3
    rounds: int = 200
    #: Where the leak starts.
    leak: float = 0.005
    rate: float = 0.6
    #: L1 penalty at max_docs documents: evidence below it gives no weight. It goes with the root of their
    #: number, as the chance evidence of a word does.
    penalty: float = 0.4
    #: Every so many rounds all features are looked at. In between, those without a weight rest whose gradient
    #: was below this share of the penalty: it takes more than the penalty to give them one.
    look: int = 10
    nap: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    leak: float


def features(word: str) -> tuple[str, ...]:
    """A lower-case word, and its beginnings, which the forms of a word share."""
    return (word, *("^" + word[:n] for n in PREFIXES if len(word) >= n))


def sentences(text: str) -> list[str]:
    return SENTENCE.findall(text)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order; sorting them is faster here than numpy's hashing."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _pairs(texts: list[str], min_docs: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names of the features that ``min_docs`` texts have, which sentence has which (two arrays), and each sentence's text.

    Sentences without such a feature are left out.
    """
    number = dict.fromkeys(".!?\n", 0)
    tokens, lengths = array("i"), []
    for text in texts:
        before = len(tokens)
        tokens.append(0)  # a text begins a sentence
        for token in TOKEN.findall(text.lower()):
            tokens.append(number.setdefault(token, len(number)))
        lengths.append(len(tokens) - before)
    at: dict[str, int] = {}
    of_word = [[] if not i else [at.setdefault(f, len(at)) for f in features(word)] for word, i in number.items()]
    n_of = np.array([len(found) for found in of_word], dtype=np.int64)
    first, flat = np.cumsum(n_of) - n_of, np.array([f for found in of_word for f in found], dtype=np.int64)
    word = np.frombuffer(tokens, dtype=np.int32)
    doc, sentence = np.repeat(np.arange(len(texts)), lengths), np.cumsum(word == 0)

    def distinct(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a group and a feature, in order."""
        own, of = np.divmod(_distinct(group * len(of_word) + word), len(of_word))
        n = n_of[of]
        place = np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.divmod(_distinct(np.repeat(own, n) * len(at) + flat[place]), max(1, len(at)))

    often = np.bincount(distinct(doc)[1], minlength=len(at)) >= min_docs
    names = [name for name, enough in zip(at, often, strict=True) if enough]
    own, of = distinct(sentence)
    own, of = own[often[of]], (np.cumsum(often) - 1)[of[often[of]]]
    kept = _distinct(own)
    return names, np.searchsorted(kept, own), of, doc[np.searchsorted(sentence, kept)]


def fit(texts: list[str], labels: list[int], settings: Settings = Settings()) -> Model:
    """Train on whole texts and their labels; without a positive one the model calls nothing toxic."""
    if not any(labels):
        return Model({}, -20.0, 0.0)
    names, row, column, owner = _pairs(texts, settings.min_docs)
    n_sentences = len(owner)
    if not n_sentences:
        return Model({}, -20.0, float(np.mean(labels)))
    truth = np.array(labels, dtype=bool)
    base = float(truth.mean())
    weights, bias, leak = np.zeros(len(names)), math.log(base / max(1.0, n_sentences / len(texts))), math.log(settings.leak / (1 - settings.leak))
    penalty = settings.penalty * math.sqrt(len(texts) / settings.max_docs)
    past, past_bias, past_leak = np.full(len(names), 1e-8), 1e-8, 1e-8
    awake, some = np.ones(len(names), dtype=bool), (row, column)
    for turn in range(settings.rounds):
        look = turn % settings.look == 0
        at, of = (row, column) if look else some
        z = bias + np.bincount(at, weights[of], n_sentences)
        p = 1 / (1 + np.exp(-z))
        leak_p = 1 / (1 + math.exp(-leak))
        clean = np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)) + math.log1p(-leak_p))
        pull = np.where(truth, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        slope = pull[owner] * p
        gradient = np.bincount(of, slope[at], len(names))
        past += gradient**2 * np.where(awake, 1, settings.look)
        step = settings.rate / np.sqrt(past)
        moved = weights - step * gradient
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        if look:
            awake = (weights != 0) | (np.abs(gradient) > settings.nap * penalty)
            chosen = awake[column]
            some = row[chosen], column[chosen]
        total, total_leak = float(slope.sum()), float(pull.sum()) * leak_p
        past_bias, past_leak = past_bias + total**2, past_leak + total_leak**2
        bias -= settings.rate * total / math.sqrt(past_bias)
        leak -= settings.rate * total_leak / math.sqrt(past_leak)
    used = np.flatnonzero(weights)
    return Model({names[i]: float(weights[i]) for i in used}, bias, 1 / (1 + math.exp(-leak)))


def sample(labelled: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> tuple[list[str], list[int]]:
    """The bounded training sample: texts and labels of ``labelled`` (doc_id, toxic).

    A repeated id counts once, as toxic if any of its rows says so; null ids and labels are left out.
    """
    chosen = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_docs)
    sizes = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.length("text").alias("n")).where("n IS NOT NULL")
    room, taken = settings.max_chars, []
    for row in sizes.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if row["n"] <= room:
            room -= row["n"]
            taken.append((row["doc_id"], int(row["toxic"])))
    if not taken:
        return [], []
    ids = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id")
    texts, labels = [], []
    for row in rows.toLocalIterator():
        texts.append(row["text"])
        labels.append(row["toxic"])
    return texts, labels


def _logistic(z: float) -> float:
    """1 / (1 + exp(-z)) for any z."""
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


class Scorer:
    """Scores texts with a model; remembers the features with a weight of the words it has met."""

    MOST = 200_000

    def __init__(self, model: Model):
        self._model = model
        self._met: dict[str, tuple[str, ...]] = {}

    def _weighed(self, word: str) -> tuple[str, ...]:
        if len(self._met) >= self.MOST:
            self._met.clear()
        found = self._met[word] = tuple(f for f in features(word) if f in self._model.weights)
        return found

    def sentence(self, text: str) -> float:
        """Score of one sentence."""
        found = {f for word in WORD.findall(text.lower()) for f in (self._met[word] if word in self._met else self._weighed(word))}
        return _logistic(self._model.bias + sum(self._model.weights[f] for f in found))

    def __call__(self, text: str | None) -> tuple[float, int, float]:
        """Document score, and number (from 0, or -1) and score of the sentence that offends most."""
        model, met, weigh = self._model, self._met, self._weighed
        best, worst, log_clean = -math.inf, -1, math.log1p(-model.leak)
        for i, sentence in enumerate(sentences((text or "").lower())):
            found = {f for word in WORD.findall(sentence) for f in (met[word] if word in met else weigh(word))}
            if found:
                z = model.bias + sum(model.weights[f] for f in found)
                log_clean -= z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
                if z > best:
                    best, worst = z, i
        return 1 - math.exp(log_clean), worst, _logistic(best) if worst >= 0 else 0.0


def score_text(text: str | None, model: Model) -> tuple[float, int, float]:
    return Scorer(model)(text)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, worst_sentence and worst_score as further columns; whole texts are scored.

    A null or empty text is a bag without sentences, and its score is the leak. So is that of a text of which no sentence has a
    feature with a weight, however long it is: such a sentence says nothing. worst_sentence is the
    number of the sentence that offends most, -1 if no word of the text has a weight. Other columns,
    rows and repeats stay as they are; a column named like a new one is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, worst_sentence int, worst_score double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for part in texts:
            yield pd.DataFrame([scorer(t) for t in part], columns=["score", "worst_sentence", "worst_score"])

    (all_three,) = fresh(docs, "toxicity")
    new = {name: F.col(f"{all_three}.{name}") for name in ("score", "worst_sentence", "worst_score")}
    return docs.withColumn(all_three, scored(F.col("text"))).withColumns(new).drop(all_three)


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number from 0), text, score of the sentences that score at least ``least``.

    A document without one gives no row; ids repeat as they do in ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<sentence:int,text:string,score:double>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in texts:
            yield part.map(lambda text: [(i, s, p) for i, s in enumerate(sentences(text or "")) if (p := scorer.sentence(s)) >= least])

    return docs.select("doc_id", F.explode(found(F.col("text"))).alias("s")).select("doc_id", "s.sentence", "s.text", "s.score")
