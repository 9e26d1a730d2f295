"""Toxicity by multiple-instance learning: a document is a bag of sentences,
toxic if any of them is.

A sentence's probability is logistic in the marks (words and word parts) it
holds; the document's is the noisy-or of its sentences,
``1 - prod(1 - p_s)``, and only that is compared with the document's label.
The gradient shares a toxic document's blame among its sentences by how
likely each is already, so sentences end up scored though none was labelled.

Training uses a bounded sample of labelled documents (``MAX_DOCS``,
``MAX_CHARS``; those with the smallest hashes of their ids, whatever the
table's order); every document is scored, sentence by sentence.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repeatlens.llm.common import flat_map, table
from repeatlens.session import write_shared

#: Bounds of the training sample: documents, and characters of their texts.
MAX_DOCS = 5000
MAX_CHARS = 12_000_000
#: A mark is learned if so many training documents hold it and its share
#: among toxic ones exceeds that among others by so many standard errors.
MIN_DOCS = 5
MIN_Z = 4.0
GRAMS = (4, 5, 6)
ROUNDS = 300
RATE = 0.1
SHRINK = 1e-3
#: A task remembers the weights of so many words.
CACHE_WORDS = 500_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences that hold a word."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m.group())]


def marks(word: str) -> set[str]:
    """The word and its parts of 4 to 6 letters; ``^`` and ``$`` at its ends."""
    w = f"^{word}$"
    return {w, *(w[i:i + n] for n in GRAMS for i in range(len(w) - n + 1))}


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def screen(docs: list[tuple[str, int]]) -> list[str]:
    """Marks over-represented in toxic documents, strongest first."""
    seen = (Counter(), Counter())
    total = [0, 0]
    for text, label in docs:
        total[label] += 1
        seen[label].update(set().union(*map(marks, set(_words(text)))) if text else ())
    if not all(total):
        return []
    out = []
    for mark, n in seen[1].items():
        m = seen[0][mark]
        if n + m < MIN_DOCS:
            continue
        p, q = n / total[1], m / total[0]
        both = (n + m) / sum(total)
        z = (p - q) / (both * (1 - both) * (1 / total[0] + 1 / total[1]) + 1e-12) ** 0.5
        if z >= MIN_Z:
            out.append((-z, mark))
    return [mark for _, mark in sorted(out)]  # bounded by the sample's characters


def fit(docs: list[tuple[str, int]]) -> dict:
    """{"bias": b, "weights": {mark: w >= 0}} from (text, label) pairs.

    Without documents of both kinds nothing is learned and all scores are
    near 0.
    """
    names = screen(docs)
    index = {m: i for i, m in enumerate(names)}
    known: dict[str, list[int]] = {}
    feature, sentence, doc, label = [], [], [], []
    n = 0
    for text, y in docs:
        for a, b in sentences(text):
            hits = set()
            for w in set(_words(text[a:b])):
                if w not in known:
                    known[w] = [index[m] for m in marks(w) if m in index]
                hits.update(known[w])
            feature.extend(hits)
            sentence.extend([n] * len(hits))
            doc.append(len(label))
            n += 1
        label.append(y)
    y = np.array(label, bool)
    if not names or not n:
        return {"bias": -12.0, "weights": {}}
    feature, sentence, doc = (np.array(x, np.int64) for x in (feature, sentence, doc))
    size, k = len(label), len(names)
    theta = np.zeros(k + 1)
    theta[:k] = 1.0
    theta[k] = -6.0
    mean, var = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, ROUNDS + 1):
        z = theta[k] + np.bincount(sentence, theta[feature], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        log_none = np.bincount(doc, -np.log1p(-np.minimum(p, 1 - 1e-12)), size)
        none = np.exp(-log_none)  # the chance that no sentence is toxic
        blame = np.where(y, -none / np.maximum(1 - none, 1e-9), 1.0)
        dz = blame[doc] * p / size
        grad = np.append(np.bincount(feature, dz[sentence], k) + SHRINK * theta[:k] / size,
                         dz.sum())
        mean = 0.9 * mean + 0.1 * grad
        var = 0.999 * var + 0.001 * grad * grad
        theta -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(var / (1 - 0.999 ** step)) + 1e-10)
        np.maximum(theta[:k], 0, out=theta[:k])
    return {"bias": float(theta[k]),
            "weights": {m: float(w) for m, w in zip(names, theta) if w > 1e-3}}


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: dict):
        self.bias, self.weights = model["bias"], model["weights"]
        self.known: dict[str, frozenset[str]] = {}

    def _hits(self, word: str) -> frozenset[str]:
        hits = frozenset(m for m in marks(word) if m in self.weights)
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = hits
        return hits

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(score, offending): the sentences of probability 0.5 or more, or
        the likeliest one if only together they pass, as (start, end, p)."""
        log_none = 0.0
        known, weights = self.known, self.weights
        found: list[tuple[int, int, float]] = []
        plain = 0  # sentences without a mark
        for a, b in sentences(text or ""):
            hits: set[str] = set()
            for w in _words(text[a:b]):
                h = known.get(w)
                if h is None:
                    h = self._hits(w)
                if h:
                    hits.update(h)
            if hits:
                z = self.bias + sum(weights[m] for m in sorted(hits))
                log_none += np.logaddexp(0.0, z)
                found.append((a, b, float(1 / (1 + np.exp(-z)))))
            else:
                plain += 1
        log_none += plain * np.logaddexp(0.0, self.bias)
        score = float(-np.expm1(-log_none))
        top = [x for x in found if x[2] >= 0.5]
        if not top and found and score >= 0.5:
            top = [max(found, key=lambda x: x[2])]
        return score, top


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS,
          max_chars: int = MAX_CHARS) -> dict:
    """Fits on a sample of the labelled documents that are not held out.

    A document with several labels is toxic if one says so; null ids and
    labels are left out.
    """
    known = (labels.filter("doc_id is not null and toxic is not null")
             .filter(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)  # bounds the broadcast
    sample = write_shared(
        docs.select("doc_id", "text").filter("text is not null")
        .join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("doc_id", "text").alias("h"), F.length("text").alias("n"), "text",
                "toxic"), "sample")
    used, taken = 0, []
    sizes = sample.groupBy("h").agg(F.sum("n").alias("n"))
    for h, n in sizes.orderBy("h").limit(max_docs).collect():
        if used + n <= max_chars:  # a text too long is passed over, others still fit
            used += n
            taken.append(h)
    kept = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h in taken], "h long"))
    # repeated rows of one id have one label: they are learned from once
    rows = (sample.join(kept, "h").groupBy("h")
            .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect())
    return fit([(r.text, int(r.toxic > 0)) for r in sorted(rows, key=lambda r: (r.h, r.text))])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score, offending (spans of sentences in
    code points, end exclusive, with their probabilities).

    Null and empty texts score 0 and have no sentences; repeated rows score
    alike.  Other columns are ignored.  Empty input, empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                         T.StructField("score", T.DoubleType())])

    def make():
        scorer = Scorer(shared.value)

        def one(i, text):
            s, top = scorer.score(text)
            return [(i, s, [{"start": a, "end": b, "score": p} for a, b, p in top])]
        return one

    return flat_map(rows, make, T.StructType([
        rows.schema["doc_id"], T.StructField("score", T.DoubleType()),
        T.StructField("offending", T.ArrayType(span))]))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
