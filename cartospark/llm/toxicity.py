"""Toxicity by multiple-instance learning: sentence scores trained from document labels.

A sentence's probability is a logistic score of the words in it and of the
words' beginnings (so that inflected and compound forms count); a document is
toxic if any of its sentences is, which noisy-or states as 1 - prod(1 - p). The
weights come from document labels alone, by gradient steps on the documents'
likelihood, and then point at the sentences that make a document toxic.

The training sample is bounded: ``MAX_TRAIN`` labelled documents, in order of a
hash of doc_id. The model has a weight for each of the ``MAX_WORDS`` words and
beginnings of that sample that mark a class most strongly; both numbers are the
model's size, whatever the corpus. Scores cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import small_batches

#: Bounds of what is gathered for training: labelled documents, and words of the model.
MAX_TRAIN, MAX_WORDS, MIN_DOCS = 6_000, 20_000, 3
#: Lengths in bytes of the beginnings of longer words.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    words: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    bias: float

    def logits(self, h: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Each sentence's logit; a word counts once in a sentence."""
        out = np.full(n, self.bias)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            both = np.unique(sentence[hit] * len(self.words) + at[hit])
            np.add.at(out, both // len(self.words), self.weights[both % len(self.words)])
        return out


def sentences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: feature hashes, the sentence of each, each text's first sentence (and the end), start and end byte of each sentence from its text's start.

    Sentences end at . ! ? and line ends; a text has one at least.
    """
    for _, data, offsets in hashing.slices(texts):
        h, _, start, end = hashing.words(data, offsets, letters=True)
        stops = np.flatnonzero(_STOP[data]) + 1
        lengths = np.diff(offsets)
        starts = np.unique(np.concatenate([offsets[:-1][lengths > 0], stops[~np.isin(stops, offsets)]]))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        # empty texts get a sentence of their own
        empty = np.flatnonzero(lengths == 0)
        owner, order = np.concatenate([owner, empty]), None
        starts = np.concatenate([starts, offsets[empty]])
        order = np.argsort(owner, kind="stable")
        full = np.concatenate([np.ones(len(owner) - len(empty), dtype=bool), np.zeros(len(empty), dtype=bool)])[order]
        owner, starts = owner[order], starts[order]
        first = np.searchsorted(owner, np.arange(len(offsets)))
        where = np.flatnonzero(full)
        sentence = where[np.searchsorted(starts[where], start, side="right") - 1] if len(start) else np.zeros(0, dtype=np.int64)
        more = hashing.prefixes(data, start, end, BEGINNINGS)
        h = np.concatenate([h, *(x for _, x in more)])
        sentence = np.concatenate([sentence, *(sentence[i] for i, _ in more)])
        ends = np.append(starts[1:], offsets[-1]) if len(starts) else starts
        yield h, sentence, first, starts - offsets[owner], ends - offsets[owner]


def train(texts: list[str], labels: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fit the noisy-or of sentence logits to document labels by Adam on the mean log-likelihood."""
    y = np.asarray(labels, dtype=float)
    none = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -20.0)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: everything is what was seen, or clean
        return Model(none.words, none.weights, 20.0 if len(y) and y.min() == 1 else -20.0)
    # pass 1, in slices: document frequencies of all features, and those of toxic documents
    seen, toxic, done = [], [], 0
    for h, sentence, first, _, _ in sentences(pa.array(texts, pa.large_string())):
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[sentence]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        seen.append(h[new])
        toxic.append(h[new][y[done + owner[new]] == 1])
        done += len(first) - 1
    words, df = np.unique(np.concatenate(seen), return_counts=True)
    words, df = words[df >= MIN_DOCS], df[df >= MIN_DOCS]
    del seen
    if not len(words):
        return none
    marked, n_marked = np.unique(np.concatenate(toxic), return_counts=True)
    at = np.minimum(np.searchsorted(marked, words), max(0, len(marked) - 1))
    pos = np.where(marked[at] == words, n_marked[at], 0) if len(marked) else np.zeros(len(words))
    lift = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((df - pos + 0.5) / (len(y) - y.sum() + 1))
    words = np.sort(words[np.argsort(-np.abs(lift) * np.sqrt(df), kind="stable")[:MAX_WORDS]])
    keep = words
    # pass 2: (sentence, feature) pairs of what was chosen, and each sentence's document
    ss, ff, docs, n_sent, done = [], [], [], 0, 0
    for h, sentence, first, _, _ in sentences(pa.array(texts, pa.large_string())):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        pair = np.unique(sentence[hit] * len(words) + at[hit])
        ss.append(pair // len(words) + n_sent)
        ff.append(pair % len(words))
        docs.append(np.repeat(np.arange(len(first) - 1), np.diff(first)) + done)
        n_sent += int(first[-1])
        done += len(first) - 1
    s, f, doc = np.concatenate(ss), np.concatenate(ff), np.concatenate(docs)
    w = np.zeros(len(keep) + 1)
    w[-1] = -4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.clip(w[-1] + np.bincount(s, weights=w[f], minlength=n_sent), -30, 30)
        p = 1 / (1 + np.exp(-z))
        log_clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=len(y))
        clean = np.exp(np.minimum(log_clean, -1e-9))
        slope = np.where(y == 1, -clean / (1 - clean), 1.0)[doc] * p / len(y)
        g = np.append(np.bincount(f, weights=slope[s], minlength=len(keep)), slope.sum())
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(words, w[:-1], float(w[-1]))


def train_from(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on labelled documents for which ``keep`` (of ``doc_id``) holds, at most MAX_TRAIN by hash of doc_id."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & keep)
    marked = marked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marked), "doc_id").toPandas().sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), (rows["y"] > 0).to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_sentences, n_offending, worst_sentence) for every row.

    score is the noisy-or over sentences, predicted 1 from 0.5 up; n_offending
    counts sentences of probability 0.5 or more, worst_sentence is the likeliest
    one of a document predicted toxic (else null; the first of equals). Null
    texts count as empty and have one empty sentence. Ids may be null or repeat;
    other columns are ignored.
    """

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = pdf["text"].tolist()
            score, n, bad, worst = [], [], [], []
            for h, sentence, first, start, end in sentences(pa.array(texts, pa.large_string())):
                z = model.logits(h, sentence, int(first[-1]))
                log_clean = -np.logaddexp(0, z)
                for i in range(len(first) - 1):
                    zs = z[first[i] : first[i + 1]]
                    p = float(-np.expm1(log_clean[first[i] : first[i + 1]].sum()))
                    j = int(first[i] + np.argmax(zs))
                    worst.append(texts[len(score)].encode()[start[j] : end[j]].decode(errors="replace").strip() if p >= 0.5 else None)
                    score.append(p)
                    n.append(len(zs))
                    bad.append(int((zs >= 0).sum()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": score, "predicted": (np.array(score) >= 0.5).astype("int32"), "n_sentences": n, "n_offending": bad, "worst_sentence": worst})

    small_batches(docs.sparkSession, 256)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double, predicted int, n_sentences long, n_offending long, worst_sentence string")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
