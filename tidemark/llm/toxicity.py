"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, boxed, checkpointed, held_out, read, release, thinned

SENTENCE = re.compile(r"[^.!?\n]+")
#: A sentence with what ends it.
PART = r"[^.!?\n]*+[.!?\n]|[^.!?\n]++"
WORD = re.compile(r"\w+")
#: Bounds of the fitting sample: labelled documents of each class; documents of each class with over LONG code points;
#: code points of a document, of which longer ones are represented by some of their sentences.
MAX_POSITIVE, MAX_NEGATIVE, LONG, MAX_LONG, MAX_CHARS = 2_000, 3_000, 8_000, 40, 150_000
#: Features of the model: those that lean most to either class. This bound changes results: it selects features, and so keeps
#: the model from learning chance words of a small sample (on held-out rows of sf0.1, 3,000 to 12,000 features find 82 to 84 of 97
#: toxic documents and accuse 1 or 2 of 728 clean ones; all 70,332 find 76 and accuse 5).
MAX_FEATURES = 6_000
FOLDS, HELD_OUT = 5, 0


def features(word: str) -> list[int]:
    """32-bit hashes of a word in lower case as it is, by its beginnings and by its ends."""
    word = word.lower()
    n = len(word)
    names = [word] + [f"{word[:k]}_" for k in (3, 4, 5, 6) if n > k] + [f"_{word[-k:]}" for k in (4, 5) if n > k]
    return [crc32(x.encode()) for x in names]


@dataclass
class Model:
    """Weights by feature. A sentence's score is the logistic of the bias and its distinct words' weights."""

    bias: float
    weights: dict[int, float]

    def __post_init__(self):
        self.word = Memo(self._word, 60_000)

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def _word(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence that has a word."""
        out, word = [], self.word.__getitem__
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m[0]))
            if words:
                out.append((m.start(), m.end(), self.bias + math.fsum(map(word, words))))
        self.word.trim()
        return out


def noisy_or(logits: list[float]) -> float:
    """1 - product of (1 - p): the chance that at least one sentence is toxic; 0 without sentences."""
    hidden = math.fsum(z if z > 30 else math.log1p(math.exp(z)) for z in logits)
    return -math.expm1(-hidden)


def fit(texts: list[str], labels: list[int], rounds: int = 300, max_features: int | None = MAX_FEATURES) -> Model:
    """Noisy-or of logistic sentence scores, fitted to document labels by gradient descent (Adam, L2 penalty).

    Only features that lean to toxic or clean documents (by the log-odds of their document counts) take part, `max_features` of
    them (None: all that four documents of the sample have). Texts are those of `sample`, where parts stand for long ones.
    Without both classes the model scores every text as its constant share of toxic labels.
    """
    share = sum(labels) / len(labels) if labels else 0.0
    if not 0 < share < 1:
        return Model(-30.0 if share == 0 else 30.0, {})
    hashed = Memo(lambda w: np.array(features(w), dtype=np.uint32), 100_000)
    # one array of distinct features for each sentence: compact, as the driver holds the whole sample
    sentences, doc_of, seen = [], [], ([], [])
    for d, (text, label) in enumerate(zip(texts, labels)):
        first = len(sentences)
        for sentence in SENTENCE.findall(text):
            words = set(WORD.findall(sentence))
            if words:
                sentences.append(np.unique(np.concatenate([hashed[w] for w in words])))
                doc_of.append(d)
        hashed.trim()
        if len(sentences) > first:
            seen[label].append(np.unique(np.concatenate(sentences[first:])))
    del hashed
    if not sentences:
        return Model(math.log(share / (1 - share)), {})
    positive, negative = sum(labels), len(labels) - sum(labels)
    kinds = np.unique(np.concatenate([*seen[0], *seen[1]]))
    clean, toxic = (np.bincount(np.searchsorted(kinds, np.concatenate(x)), minlength=len(kinds)) if x else np.zeros(len(kinds)) for x in seen)
    odds = np.log((toxic + 0.5) / (positive - toxic + 0.5)) - np.log((clean + 0.5) / (negative - clean + 0.5))
    spread = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5) + 1 / (positive - toxic + 0.5) + 1 / (negative - clean + 0.5))
    lean = np.where(toxic + clean >= 4, np.abs(odds) / spread, -1.0)
    order = np.argsort(-lean, kind="stable")[:max_features]
    chosen = np.sort(kinds[order[lean[order] >= 0]])
    rows, cols = [], []
    for i, found in enumerate(sentences):
        at = np.minimum(np.searchsorted(chosen, found), max(len(chosen) - 1, 0))
        at = at[chosen[at] == found] if len(chosen) else at[:0]
        cols.append(at)
        rows.append(np.full(len(at), i))
    rows, cols, doc_of = np.concatenate(rows), np.concatenate(cols), np.array(doc_of)
    del sentences, seen
    y = np.array(labels, float)
    theta, bias = np.zeros(len(chosen)), -5.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, theta[cols], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        hidden = np.bincount(doc_of, np.logaddexp(0, z), len(y))  # -log of the chance that no sentence is toxic
        pull = np.where(y > 0, -np.exp(-hidden) / np.maximum(-np.expm1(-hidden), 1e-9), 1.0)
        g = pull[doc_of] * p / len(y)
        grad = np.append(np.bincount(cols, g[rows], len(chosen)) + 1e-4 * theta, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    return Model(float(bias), {int(f): float(w) for f, w in zip(chosen, theta) if w})


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """The fitting sample: at most MAX_POSITIVE and MAX_NEGATIVE labelled texts of up to LONG code points, and MAX_LONG
    longer ones of each class, outside the held-out fold.

    Documents are chosen by a hash of doc_id, so that a rerun takes the same. An id with several labels counts as toxic
    if one says so; of its several texts the one with the smallest hash is taken. Ids without text take no part.
    """
    fold = held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic in (0, 1) and doc_id is not null").filter(~fold)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    sizes = texts.select("doc_id", (F.char_length("text") > LONG).alias("long"))
    there = checkpointed(sizes.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.max("long").alias("long")))
    limits = {(y, long): MAX_LONG if long else MAX_POSITIVE if y else MAX_NEGATIVE for y in (0, 1) for long in (False, True)}
    counts = {(r["toxic"], r["long"]): r["count"] for r in there.groupBy("toxic", "long").count().collect()}  # four rows at most
    # somewhat more than is wanted of each kind, then the first ones by hash
    steps, share = 1 << 20, F.lit(0)
    for (y, long), n in counts.items():
        wanted = min(steps, math.ceil(steps * 1.3 * limits[y, long] / n))
        share = F.when((F.col("toxic") == y) & (F.col("long") == long), wanted).otherwise(share)
    there = there.filter(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(steps)) < share)
    place = F.row_number().over(Window.partitionBy("toxic", "long").orderBy(F.xxhash64("doc_id"), "doc_id"))
    most = F.when(F.col("long"), MAX_LONG).when(F.col("toxic") == 1, MAX_POSITIVE).otherwise(MAX_NEGATIVE)
    chosen = there.withColumn("place", place).filter(F.col("place") <= MAX_NEGATIVE).filter(F.col("place") <= most)
    # as many ids as the sample has: a bounded broadcast, and a bounded number of bounded texts for the driver
    rows = texts.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    found = rows.select("doc_id", "toxic", thinned(F.col("text"), MAX_CHARS, PART).alias("text")).toArrow().sort_by("doc_id")
    return found.column("text").to_pylist(), found.column("toxic").to_pylist()


def train(docs: DataFrame, labels: DataFrame, max_features: int | None = MAX_FEATURES) -> Model:
    """The model of the fitting sample, of at most `max_features` features; no labels or no documents make a model that finds
    nothing toxic."""
    model = fit(*sample(docs, labels), max_features=max_features)
    release()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), offending: array of (start, end, score) of the sentences
    whose own score reaches the threshold, in code points, end exclusive.

    Null and empty texts have score 0 and no sentences; an empty table has no rows. Whole texts are read, however long;
    equal texts have equal scores, and rows that repeat or have no id stay. Other columns are not looked at.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, spans = [], []
            for x in batch.column(1):
                found = model.sentences(x.as_py() or "")
                scores.append(noisy_or([z for *_, z in found]))
                spans.append(
                    [{"start": a, "end": b, "score": p} for a, b, z in found if (p := noisy_or([z])) >= threshold]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, span)], ["doc_id", "score", "offending"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs, in their own columns, without the rows whose text scores at least the threshold.

    Null and empty texts score 0 and stay, unless threshold is 0. Each row is judged by its own whole text, so copies go
    or stay together, whether ids repeat or not; an empty table stays empty; other columns pass, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            columns = batch.column(0).flatten()
            keep = [noisy_or([z for *_, z in model.sentences(x.as_py() or "")]) < threshold for x in columns[at]]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return boxed(docs).mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document: doc_id, held_out, score, predicted; and the offending sentences."""
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        "offending",
    )
