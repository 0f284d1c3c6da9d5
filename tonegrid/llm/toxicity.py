"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is a logistic function of its words;
the document's is their noisy-or, 1 - prod(1 - p).  Weights are trained from document labels
only, through the noisy-or, so that the sentences which carry a label are found without having
been marked.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import append_columns
from .sampling import labelled_sample

#: Sentence ends to newlines, A-Z to lower case, all other bytes that are no letters to blanks.
SENTENCE_BYTES = bytes(
    10 if b in b".!?\n" else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Bounds of the sample that the model is fitted on: labelled rows, characters of a text.
SAMPLE_ROWS, SAMPLE_CHARS = 10_000, 50_000
THRESHOLD = 0.3

SENTENCES = T.ArrayType(T.StructType([T.StructField("sentence", T.LongType()), T.StructField("words", T.StringType()), T.StructField("score", T.DoubleType())]))


@dataclass
class NoisyOr:
    weights: dict[bytes, float]
    bias: float
    prior: float | None = None  # without both labels in the sample: the score of every text

    def sentences(self, text: str | None) -> list[tuple[int, bytes, float]]:
        """(number, words, log-odds) of each sentence with words."""
        w = self.weights
        parts = text.encode().translate(SENTENCE_BYTES).split(b"\n") if text else []
        return [(i, s, self.bias + sum([w[x] for x in set(words) if x in w])) for i, s in enumerate(parts) if (words := s.split())]

    def score(self, text: str | None) -> tuple[float, list[tuple[int, str, float]]]:
        """Noisy-or over all sentences; the sentences of probability 0.5 and more."""
        found = self.sentences(text)
        if self.prior is not None:
            return self.prior, []
        z = np.array([x for _, _, x in found])
        return float(-np.expm1(-np.logaddexp(0, z).sum())), [(i, b" ".join(s.split()).decode(), float(1 / (1 + np.exp(-x)))) for i, s, x in found if x >= 0]


def fit(sample: list[tuple[str, int]], least_docs: int = 5, steps: int = 250, l1: float = 2e-5) -> NoisyOr:
    """Adam on the noisy-or likelihood of the document labels, with an L1 penalty on the words."""
    labels = np.array([y for _, y in sample], float)
    if not len(labels) or labels.min() == labels.max():
        return NoisyOr({}, 0.0, float(labels.mean()) if len(labels) else 0.5)
    ids: dict[bytes, int] = {}
    word, size, doc, frequency = array("i"), array("i"), array("i"), np.zeros(0, np.int64)
    for d, (t, _) in enumerate(sample):
        start = len(word)
        for s in t.encode().translate(SENTENCE_BYTES).split(b"\n"):
            if found := set(s.split()):
                word.extend([ids.setdefault(x, len(ids)) for x in sorted(found)])
                size.append(len(found))
                doc.append(d)
        frequency = np.append(frequency, np.zeros(max(0, len(ids) - len(frequency)), np.int64))
        frequency[np.unique(np.frombuffer(word, np.intc)[start:])] += 1
    number = np.where(frequency >= least_docs, np.cumsum(frequency >= least_docs) - 1, -1).astype(np.int32)
    vocabulary = {w: int(number[i]) for w, i in ids.items() if number[i] >= 0}
    del ids
    doc, n = np.array(doc, np.int32), len(size)
    sentence, word = np.repeat(np.arange(n, dtype=np.int32), np.array(size)), number[np.frombuffer(word, np.intc)]
    sentence, word = sentence[word >= 0], word[word >= 0]
    theta = np.zeros(len(vocabulary) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], n)
        hidden = np.bincount(doc, np.logaddexp(0, z), len(labels))  # -log of the chance that no sentence is toxic
        slope = np.where(labels > 0, -1 / np.maximum(np.expm1(np.minimum(hidden, 50)), 1e-9), 1.0)
        dz = slope[doc] / (1 + np.exp(-z)) / len(labels)
        g = np.append(np.bincount(word, dz[sentence], len(vocabulary)), dz.sum())
        g[:-1] += l1 * np.sign(theta[:-1])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return NoisyOr({w: float(theta[i]) for w, i in vocabulary.items() if abs(theta[i]) > 0.25}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, rows: int = SAMPLE_ROWS) -> NoisyOr:
    return fit(labelled_sample(docs, labels, "toxic", folds, fold, rows, SAMPLE_CHARS))


def score_toxicity(docs: DataFrame, model: NoisyOr, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1), ``predicted`` (int) and ``sentences`` (number, words, score of offending ones).

    Only the text is looked at, all of it.  Null texts and texts without words have no sentences and
    so score 0; repeated rows are scored each on its own; an empty table gives no rows.  A model
    fitted without both labels gives every text the share of label 1 in its sample (0.5 without rows).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most one number per word of the sample
    fields = [T.StructField("score", T.DoubleType()), T.StructField("sentences", SENTENCES)]

    def compute():
        own = sent.value

        def run(texts: list, _) -> list:
            found = [own.score(t) for t in texts]
            return [[min(1.0, max(0.0, s)) for s, _ in found], [[{"sentence": i, "words": w, "score": p} for i, w, p in x] for _, x in found]]

        return run

    return append_columns(docs, text, fields, compute).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
