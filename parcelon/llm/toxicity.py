"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a score from its words: with z the weights of
its distinct words and s the logistic function, 1 - (1 - s(bias + z)) / (1 - s(bias)), that is, how
much likelier than a sentence without any known word it is to be bad; such a sentence has 0. The
scores of a document are joined by noisy-or, 1 - prod(1 - score), so that one bad sentence makes a
bad document, and a long text none. The weights are trained from labels of documents alone, by
gradient descent through the same noisy-or; the sentences that carry a document's score come out of
it, and are listed as the offending ones.

Training takes a bounded sample of labelled rows (the rows with the smallest hashes of their ids, up
to TRAIN_ROWS rows and TRAIN_BYTES bytes of text); all else covers all rows. Only texts are inputs of
a score.

Defined cases: a null, empty or blank text has no sentence that scores, and gets the score of an
empty bag, 0; a text of any length is scored whole; repeated rows get equal scores; without labelled
rows of both kinds all scores are 0; rows without a label are never trained on, and of several
labels of one id the largest counts; an empty table gives no rows; further columns stay as they are,
but for those named as the results, which are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_of

#: Most labelled rows, and most bytes of their texts, that training reads.
TRAIN_ROWS = 5_000
TRAIN_BYTES = 32 << 20
#: A feature is weighed from so many documents labelled 1; beginnings of words are features too.
LEAST_DOCS = 3
PREFIXES = (4, 5)
#: Steps, step size, shrinking of each step (keeps few features); weights and bias at the start, and
#: most that one document pulls (a document labelled 1 that scores 0 would pull without bound).
EPOCHS, RATE, SHRINK = 80, 0.3, 4e-5
START, BIAS, PULL = 0.5, -5.0, 50.0
#: The bias of a model that has learned nothing.
NEVER = -30.0
#: A sentence of this score is offending.
OFFENDING = 0.5
_SENTENCE = re.compile(r"[.!?\n]+")
_EDGES = ".,;:!?\"'()[]{}|*#"


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end (code points) of each sentence that is not blank."""
    cuts = [0, *(x for m in _SENTENCE.finditer(text) for x in m.span()), len(text)]
    return [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b and not text[a:b].isspace()]


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    return [w.strip(_EDGES) for w in sentence.lower().split()]


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected forms share."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Weights(dict):
    """Weight of a raw word, the sum over its features; remembered up to a bound."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known = known

    def __missing__(self, raw: str) -> float:
        if len(self) >= 150_000:
            self.clear()
        self[raw] = found = sum(self.known.get(f, 0.0) for f in features(raw.strip(_EDGES)))
        return found


def excess(bias: float, z: float) -> float:
    """-log(1 - score) of a sentence; 0 for z = 0."""
    return math.log1p(math.exp(min(30.0, bias + z))) - math.log1p(math.exp(bias))


class Model:
    """Weights of features; none is negative."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.of = Weights(weights)

    def __reduce__(self):
        return Model, (self.weights, self.bias)

    def sentence_excess(self, sentence: str) -> float:
        z = sum(map(self.of.__getitem__, set(sentence.lower().split())))
        return excess(self.bias, z) if z else 0.0

    def sentence_scores(self, text: str) -> list[float]:
        return [-math.expm1(-self.sentence_excess(s)) for s in sentences(text)]

    def score(self, text: str) -> float:
        """Noisy-or of sentence_scores."""
        # Most texts have no known word at all.
        if not any(map(self.of.__getitem__, set(text.lower().split()))):
            return 0.0
        return -math.expm1(-sum(map(self.sentence_excess, sentences(text))))

    def offending(self, text: str, least: float = OFFENDING) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences that score `least` or more."""
        return [(a, b, p) for a, b in sentence_spans(text) if (p := -math.expm1(-self.sentence_excess(text[a:b]))) >= least]


def train(texts: list[str], labels: list[int]) -> Model:
    """Proximal gradient descent (Adam steps, then shrinking) on the log loss of documents
    through the noisy-or."""
    # Documents labelled 1 say which features can count; the others are searched for those only.
    bad_docs, clean = {}, {}
    for text, y in zip(texts, labels, strict=True):
        if y:
            for f in {f for w in set(words_of(text)) for f in features(w)}:
                bad_docs[f] = bad_docs.get(f, 0) + 1
    bad_docs = {f: n for f, n in bad_docs.items() if n >= LEAST_DOCS}
    for text, y in zip(texts, labels, strict=True):
        if not y:
            for f in {f for w in set(words_of(text)) for f in features(w) if f in bad_docs}:
                clean[f] = clean.get(f, 0) + 1
    share = max(1, sum(labels)) / max(1, len(labels))
    # Features whose documents are labelled 1 more often than chance would have it.
    rank = {}
    for f, n in bad_docs.items():
        total = n + clean.get(f, 0)
        rank[f] = (n - share * total) / (share * (1 - share) * total + 1) ** 0.5
    vocab = {f: i for i, f in enumerate(sorted(f for f, r in rank.items() if r > 1))}
    if not vocab or len(set(labels)) < 2:
        return Model({}, NEVER)
    rows, cols, doc = array("q"), array("q"), array("q")
    for d, text in enumerate(texts):
        for s in sentences(text):
            known = [vocab[f] for w in set(words_of(s)) for f in features(w) if f in vocab]
            rows.extend([len(doc)] * len(known))
            cols.extend(known)
            doc.append(d)
    rows, cols, doc, y = np.array(rows, np.int64), np.array(cols, np.int64), np.array(doc), np.array(labels, float)
    w, bias = np.full(len(vocab), START), BIAS
    m = v = np.zeros(len(vocab) + 1)
    for step in range(1, EPOCHS + 1):
        z = np.clip(np.bincount(rows, w[cols], len(doc)), 0, 30 - bias)
        base = 1 / (1 + math.exp(-bias))
        steep = 1 / (1 + np.exp(-(bias + z)))
        bad = -np.expm1(-np.bincount(doc, np.log1p(np.exp(bias + z)) - math.log1p(math.exp(bias)), len(y)))
        # Derivatives: of the loss by -log(1 - score) of a document, then by z and by the bias.
        g = np.where(y > 0, np.maximum((bad - 1) / np.maximum(bad, 1e-9), -PULL), 1.0)[doc]
        grad = np.append(np.bincount(cols, (g * steep)[rows], len(vocab)), (g * (steep - base)).sum()) / len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)
        move = rate * m / (1 - 0.9**step)
        w = np.maximum(0.0, w - move[:-1] - rate[:-1] * SHRINK)
        bias -= move[-1]
    return Model({f: float(w[i]) for f, i in vocab.items() if w[i] > 0}, float(bias))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on labelled rows whose crc32 of the id, modulo 5, is not 0."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).withColumn("order", F.xxhash64("doc_id"))
    known = known.orderBy("order", "doc_id").limit(rows)  # the bounded sample
    found = docs.select("doc_id", text_of().alias("text")).join(known, "doc_id")
    found = found.orderBy("order", "doc_id", "text").limit(rows)  # ids may repeat
    size = F.sum(F.octet_length("text")).over(Window.orderBy("order", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("size", size).where(F.col("size") <= most_bytes).select("text", F.col("toxic").cast("int").alias("toxic"))

    # The sample is one partition by now: it is trained on where it lies, and the driver gets weights.
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
        model = train(texts, labels)
        names = [None, *model.weights]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([model.bias, *model.weights.values()], pa.float64())], ["feature", "weight"])

    weights = dict(found.mapInArrow(learn, "feature string, weight double").collect())
    return Model({f: w for f, w in weights.items() if f is not None}, weights.get(None, NEVER))


def score_documents(docs: DataFrame, model: Model, name: str = "score", spans: str | None = None, text: str = "text") -> DataFrame:
    """The columns of docs, then the score and, if `spans` names a column, the offending sentences:
    an array of their starts, ends (code points) and scores."""
    made = [n for n in (name, spans) if n]
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in made}))
    place = docs.columns.index(text)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    listed = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            scores = [model.score(t) for t in texts]
            more = [pa.array(scores, pa.float64())]
            if spans:
                found = [model.offending(t) if s else [] for t, s in zip(texts, scores, strict=True)]
                more.append(pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in f] for f in found], listed))
            yield pa.record_batch([*batch.columns, *more], [*batch.schema.names, *made])

    shape = [*docs.schema.fields, T.StructField(name, T.DoubleType())]
    if spans:
        shape.append(T.StructField(spans, kind))
    return docs.mapInArrow(score, T.StructType(shape))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), spans="offending")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
