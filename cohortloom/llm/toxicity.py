"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the document's label is known. A sentence's
score is the logistic function of the weights of its distinct words, each word's own and
those of its first letters, so that inflected forms share what is learned; the document's score
is their noisy-or: toxic if any sentence is. Training moves both at once, by gradients of
the document likelihood, so weight gathers on the sentences that explain the labels, and
the sentence scores then show where the offending passages are.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of
from .pieces import forget
from .sampling import is_held_out, spread_sample

#: Documents of each label that the model learns from, at most.
PER_LABEL = 2000
#: Documents of the sample in which a word must occur to get a weight.
LEAST_DOCS = 4
#: Steps of gradient descent, their size, and the strength of the pull towards zero.
STEPS, RATE, PULL = 150, 0.15, 2e-4
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Lengths of the word beginnings that have weights of their own.
HEADS = (4, 5, 6)
#: Words whose summed weights a task remembers.
CACHE = 150_000
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Code point ranges of the sentences of a text."""
    begin = 0
    for m in _SENTENCE.finditer(text):
        if m.start() > begin:
            yield begin, m.start()
        begin = m.end()
    if begin < len(text):
        yield begin, len(text)


def features(word: str) -> list[str]:
    """What a word stands for: itself and its beginnings, marked as such."""
    return [word, *[word[:n] + "-" for n in HEADS if len(word) > n]]


class _Weights(dict):
    """Summed weights of the words met so far, a bounded number of them."""

    def __init__(self, of_feature: dict[str, float]) -> None:
        super().__init__()
        self.of_feature = of_feature

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        weight = sum(self.of_feature.get(f, 0.0) for f in features(word))
        if len(word) <= 32:
            self[word] = weight
        return weight

    def __reduce__(self) -> tuple:
        return _Weights, (self.of_feature,)


@dataclass
class Model:
    """Weights of words and word beginnings, and the weight that every sentence starts from."""

    words: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0

    def __post_init__(self) -> None:
        self.of_word = _Weights(self.words)

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of each sentence of a text."""
        lower, weights = text.lower(), self.of_word
        if len(lower) != len(text):  # a few characters grow when lower-cased
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out = []
        for a, b in sentences(lower):
            z = self.bias + sum(map(weights.__getitem__, set(_WORD.findall(lower, a, b))))
            out.append((a, b, _logistic(z)))
        return out

    def score(self, text: str) -> float:
        """Noisy-or of the sentences of the whole text."""
        weight, bias = self.of_word.__getitem__, self.bias
        total = 0.0
        for sentence in _SENTENCE.split(text.lower()):
            if sentence:
                total += _log_not(bias + sum(map(weight, set(_WORD.findall(sentence)))))
        return -math.expm1(total)


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _log_not(z: float) -> float:
    """Logarithm of one minus the logistic of z."""
    return -math.log1p(math.exp(z)) if z < 30 else -z


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Learn a model from documents and their labels; without both labels, the empty one."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    texts, y = [texts[i] for i in order], np.array([labels[i] for i in order], dtype=float)
    if not 0 < y.sum() < len(y):
        return Model()
    seen: Counter[str] = Counter()
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        seen.update({f for w in words for f in features(w)})
    index = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= LEAST_DOCS))}
    del seen
    # Flat arrays of numbers: the document of each sentence, the sentence of each feature.
    docs, sents, feats = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for sentence in _SENTENCE.split(text.lower()):
            if not sentence:
                continue
            for w in sorted(set(_WORD.findall(sentence))):
                found = [i for f in features(w) if (i := index.get(f)) is not None]
                feats.extend(found)
                sents.extend([len(docs)] * len(found))
            docs.append(d)
    if not docs:
        return Model()
    doc_of, sent_of, word_of = (np.frombuffer(a, dtype=np.int32) if len(a) else np.zeros(0, dtype=np.int32) for a in (docs, sents, feats))
    n_sent = len(doc_of)
    w, bias = np.zeros(len(index)), math.log(0.05 / max(1.0, n_sent / len(texts)))
    momentum, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    # Half-way between equal classes and the sample's own shares: scores stay close to chances.
    weight = np.sqrt(weight)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(sent_of, w[word_of], n_sent) + bias, -35, 35)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(doc_of, -np.logaddexp(0, z), len(y))  # log of: no sentence is toxic
        any_ = np.maximum(-np.expm1(none), 1e-9)
        # d loss / d z of a sentence: p for clean documents, -p (1 - any) / any for toxic ones.
        of_doc = weight * np.where(y > 0, -np.exp(none) / any_, 1.0)
        g_sent = p * of_doc[doc_of] / len(y)
        g = np.append(np.bincount(word_of, g_sent[sent_of], len(w)) + PULL * np.sign(w), g_sent.sum())
        momentum = 0.9 * momentum + 0.1 * g
        spread = 0.99 * spread + 0.01 * g * g
        move = RATE * (momentum / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
        if step > steps // 2:
            w[np.abs(w) < 0.02] = 0
    return Model({k: float(w[i]) for k, i in index.items() if w[i]}, float(bias))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from at most ``per_label`` labelled documents of each label.

    Rows of the held-out fold and rows without a label are never learned from.
    """
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("mark")).where("doc_id IS NOT NULL AND mark IN (0, 1)").where(~is_held_out())
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = spread_sample(marks, "mark", per_label)
    # At most 2 x per_label rows: a bounded table of identifiers.
    # Of rows that share an id the smallest text counts, so the sample is the same every time.
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text")).select("text", "mark").collect()
    return fit([r.text or "" for r in rows], [r.mark for r in rows])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one per row of ``docs``; no shuffle.

    Only the text is read for a score, as a whole; a null or empty text has no sentence
    and scores 0. Repeated rows stay; a null doc_id counts as not held out; an empty table
    gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def offending_sentences(docs: DataFrame, model: Model, least: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, start, end, score) of every sentence that scores ``least`` or more.

    Ranges are in code points, the end exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(i, *s) for i, t in zip(ids, texts_of(batch, "text")) for s in shared.value.sentence_scores(t) if s[2] >= least]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "start", "end", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, end long, score double")


def keep_clean(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([shared.value.score(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
