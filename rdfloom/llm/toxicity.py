"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a logistic score over its hashed
words; the text's score is their noisy-or, 1 - (1 - leak) * prod(1 - p). Only
texts have labels: the gradient of the text's loss is shared out to its sentences,
so that training finds which of them offend, and they can be located afterwards.

Training uses a bounded sample of labelled rows (at most max_rows of each label
and max_words words in all, taken in the order of a hash of the id) on the driver;
scoring runs over all rows. Words are features by their hash, so that nothing but
the text is an input of a score.

Defined cases: a null or empty text has no sentence and scores the leak. Labels
that are null or neither 0 nor 1, and rows with a null id, aren't trained on. If
one label is missing, every text scores the leak. Repeated rows score alike; of
different texts under one id the smallest is trained on. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.llm.common import small_batches

BITS = 18
PREFIXES = (4, 5, 6)
LEAK = 1e-3
MAX_ROWS, MAX_WORDS = 3000, 3_000_000

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|\n")
_WORD = re.compile(r"\w+")


class _Features(dict):
    """word -> hashes of the word and of its beginnings (stems of inflected words)."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        parts = [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)]
        self[word] = f = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) >> (32 - BITS) for x in parts)
        return f


_FEATURES = _Features()


def sentences(text: str | None) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text or "") if _WORD.search(text, *m.span())]


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words in order, and the sentence of each."""
    feats: list[int] = []
    sizes: list[int] = []
    for part in _SENTENCE.findall((text or "").lower()):
        own = set(chain.from_iterable(map(_FEATURES.__getitem__, _WORD.findall(part))))
        if own:
            feats += own
            sizes.append(len(own))
    return np.array(feats, dtype=np.int32), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


class Model:
    """Weights of the sentence scores."""

    def __init__(self, weights: np.ndarray, bias: float, trained: bool = True):
        self.weights, self.bias, self.trained = weights, bias, trained

    def sentence_scores(self, feats: np.ndarray, of: np.ndarray) -> np.ndarray:
        n = int(of[-1]) + 1 if len(of) else 0
        z = self.bias + np.bincount(of, self.weights[feats], minlength=n)[:n]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        if not self.trained:
            return LEAK
        p = self.sentence_scores(*bag(text))
        return float(1 - (1 - LEAK) * np.exp(np.log1p(-np.clip(p, 0, 1 - 1e-12)).sum()))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) in code points of the sentences that score least or more."""
        found = []
        for start, end in sentences(text) if self.trained else ():
            p = self.sentence_scores(*bag(text[start:end]))
            if len(p) and p.max() >= least:
                found.append((start, end, float(p.max())))
        return found


def fit(texts: list[str | None], labels: list[int], rounds: int = 150, rate: float = 0.15, least_z: float = 4.5, least_texts: int = 5, bias: float = -5.0) -> Model:
    """Adam on the mean noisy-or loss of bags; label 1 weighs two fifths, whatever its share.

    Only features whose share of texts differs between the labels by least_z
    standard errors are trained; the others keep weight zero, so that wrong labels
    and words of a few texts teach nothing.
    """
    y = np.array(labels, dtype=np.float64)
    w = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(w, bias, trained=False)
    bags = [bag(t) for t in texts]
    ones, zeros = y.sum(), (1 - y).sum()
    has1, has0 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (f, _), label in zip(bags, y):
        (has1 if label else has0)[np.unique(f)] += 1
    share = (has1 + has0) / len(y)
    z = (has1 / ones - has0 / zeros) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / ones + 1 / zeros))
    keep = (np.abs(z) >= least_z) & (has1 + has0 >= least_texts)
    n_sent = np.array([int(of[-1]) + 1 if len(of) else 0 for _, of in bags])
    starts = np.concatenate([[0], np.cumsum(n_sent)[:-1]])
    own = [keep[f] for f, _ in bags]
    used, index = np.unique(np.concatenate([f[k] for (f, _), k in zip(bags, own)]), return_inverse=True)
    of = np.concatenate([o[k] + s for (_, o), k, s in zip(bags, own, starts)])
    doc = np.repeat(np.arange(len(y)), n_sent)
    weight = np.where(y == 1, 0.4 / ones, 0.6 / zeros)
    x, m1, m2 = np.zeros(len(used) + 1), 0.0, 0.0  # the last is the bias
    x[-1] = bias
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x[-1] + np.bincount(of, x[index], minlength=len(doc)), -30, 30)))
        q = np.exp(np.log1p(-LEAK) + np.bincount(doc, np.log1p(-np.clip(p, 0, 1 - 1e-12)), minlength=len(y)))
        g = (weight * np.where(y == 1, -q / np.maximum(1 - q, 0.02), 1.0))[doc] * p  # of the loss, by each sentence's z
        grad = np.append(np.bincount(index, g[of], minlength=len(used)) + 1e-4 * x[:-1], g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        x -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    w[used] = x[:-1]
    return Model(w.astype(np.float32), float(x[-1]))


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> list:
    """A bounded sample: at most max_rows of each label in the order of a hash of the id, as far as max_words words reach."""
    named = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("y")).where("_id is not null and y in (0, 1)").groupBy("_id").agg(F.max("y").alias("y"))
    key = F.xxhash64(F.col("_id"), F.lit("sample"))
    counts = {r.y: r["count"] for r in named.groupBy("y").count().collect()}
    chosen = []
    for v in sorted(counts):
        # a bound on the hash that some max_rows ids pass, so that no task sends more than its share
        share = min(1.0, 1.1 * max_rows / counts[v])
        some = named.where((F.col("y") == v) & (F.pmod(key, F.lit(1 << 30)) <= int(share * (1 << 30)))).select("_id", key.alias("k")).collect()
        chosen += sorted((r.k, r["_id"], v) for r in some)[:max_rows]
    if not chosen:
        return []
    kind = docs.schema[doc_id].dataType
    small = lambda rows: F.broadcast(docs.sparkSession.createDataFrame(rows, T.StructType([T.StructField("_id", kind), T.StructField("y", T.IntegerType())])))  # noqa: E731  max_rows of each label
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("t"))
    # sizes first, so that only what is used reaches the driver; of rows that share an id the smallest text is taken
    sized = {r["_id"]: r.n for r in own.join(small([(i, int(v)) for _, i, v in chosen]), "_id").groupBy("_id").agg(F.length(F.coalesce(F.min("t"), F.lit(""))).alias("n")).collect()}
    total, kept = 0, []
    for _, i, v in sorted(chosen):
        if i in sized and total + sized[i] // 5 <= max_words:
            total += sized[i] // 5
            kept.append((i, int(v)))
    if not kept:
        return []
    return own.join(small(kept), "_id").groupBy("_id", "y").agg(F.min("t").alias("t")).orderBy(key, "_id").select("t", "y").collect()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, score, offending) for every row; offending: array of (start, end, score) of sentences."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the data
    small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shipped.value
        for rows in batches:
            scores = [m.score(t) for t in rows["t"]]
            where = [m.offending(t) if spans and s >= 0.5 else [] for t, s in zip(rows["t"], scores)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": scores, "offending": [[{"start": a, "end": b, "score": p} for a, b, p in w] for w in where]})

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    return own.mapInPandas(run, T.StructType([own.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(span))]))
