"""Language identification: sparse multinomial logistic regression.

Features are hashed character n-grams (one to three characters, lower case, white
space as one blank) weighted by TF-IDF and scaled to length one. Weights are
learnt by follow-the-regularised-leader with an elastic net: the L1 part keeps
most of them at exactly zero. A temperature fitted on rows kept from the training
makes the probabilities honest. The same rows say how sure the classifier is of
texts in languages it knows; the pipeline rejects what is told much less surely,
as gibberish and texts in other languages are.

Learnt from a bounded sample (``PER_LANGUAGE``, ``SAMPLE``, ``SAMPLE_BYTES``) of
the learning fold; document frequencies of the n-grams and languages are counted
over all its rows.

Defined results: ``und`` with score 0 for a null text or one without a letter, and
for every text if nothing could be learnt; otherwise the most probable language
(ties: the first by name) and its probability; null languages are not learnt from;
repeated rows give repeated rows; further columns are ignored; an empty table
gives an empty one. With a single learned language nothing can be told apart, and
every text with a letter passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import fold, text_chunks

LETTER = regex.compile(r"\p{L}")
BITS = 15
ORDERS = (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
#: Bounds of the training sample.
PER_LANGUAGE, SAMPLE, SAMPLE_BYTES = 400, 4000, 32 << 20
#: Of the FTRL steps: rate, smoothing, L1, L2, and passes.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.02, 0.05, 4
#: Characters counted in one step.
STEP = 1 << 20
UNKNOWN = "und"
#: The pipeline rejects below the middle, in log odds, of chance and of what all but
#: this share of the calibration rows reach.
UNSURE = 0.01
# Multipliers of the n-gram hash: odd parts of the golden ratio and of roots.
_MIX = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams, and how often each occurs."""
    text = " " + " ".join(text.lower().split()) + " "
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for s in range(0, len(text), STEP):
        part = text[s : s + STEP + max(ORDERS) - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype="<u4")
        own = min(STEP, len(text) - s)
        mixed = np.full(len(codes), 0, dtype=np.uint32)
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                break
            mixed = (mixed[:m] * np.uint32(31)) ^ (codes[n - 1 :] * _MIX[n - 1])
            hashed = ((mixed * _MIX[0]) ^ (mixed >> np.uint32(15))) * _MIX[1]
            counts += np.bincount(hashed[:own] >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    least: float = -np.inf  # log odds below which the pipeline rejects

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = gram_counts(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.features(text)
        return (x @ self.weights[at] + self.bias) / self.temperature

    def readable(self, text: str | None) -> bool:
        return bool(self.languages and text and LETTER.search(text))

    def told(self, text: str | None) -> bool:
        """Whether the language is told with enough confidence."""
        return self.readable(text) and bool(log_odds(self.logits(text)) >= self.least)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.readable(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text))
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def log_odds(z: np.ndarray) -> np.ndarray:
    """Log odds of the greatest class against the others; unlike its probability it doesn't round to one."""
    z = np.sort(z, axis=-1)
    if z.shape[-1] == 1:
        return np.full(z.shape[:-1], np.inf)
    ahead = z[..., :-1] - z[..., -1:]
    most = ahead[..., -1]
    return -most - np.log(np.exp(ahead - most[..., None]).sum(axis=-1))


class Leader:
    """Follow-the-regularised-leader, one coordinate table for all classes."""

    def __init__(self, features: int, classes: int):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def step(self, at: np.ndarray, x: np.ndarray, truth: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[truth] -= 1
        g = x[:, None] * p
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(
    rows: list[tuple[str | None, str]], seed: int = 11, frequencies: tuple[int, np.ndarray] | None = None
) -> Model:
    """A model from ``(text, language)`` rows; ``frequencies`` are those of ``document_frequencies``, else of the rows."""
    rows = [(t, lang) for t, lang in rows if lang is not None and t and LETTER.search(t)]
    languages = sorted({lang for _, lang in rows})
    size = 1 << BITS
    model = Model(languages, np.zeros((size, len(languages))), np.zeros(len(languages)), np.ones(size))
    if not rows:
        return model
    counted = [gram_counts(t) for t, _ in rows]
    if frequencies is None:
        df = np.zeros(size)
        for at, _ in counted:
            df[at] += 1
        frequencies = len(rows), df
    model.idf = np.log((1 + frequencies[0]) / (1 + frequencies[1])) + 1
    data = []
    for (at, n), (_, lang) in zip(counted, rows):
        x = (1 + np.log(n)) * model.idf[at]
        # the last coordinate is the intercept
        data.append((np.append(at, size), np.append(x / np.sqrt(x @ x), 1.0), languages.index(lang)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept = len(data) // 5
    leader = Leader(size + 1, len(languages))
    for _ in range(PASSES):
        for i in rng.permutation(order[kept:]):
            leader.step(*data[i])
    w = leader.weights(np.arange(size + 1))
    model.weights, model.bias = w[:-1], w[-1]
    if kept:
        logits = np.asarray([data[i][1] @ w[data[i][0]] for i in order[:kept]])
        model.temperature = temperature(logits, np.asarray([data[i][2] for i in order[:kept]]))
        model.least = least_odds(logits / model.temperature)
    return model


def temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The divisor of the logits at which the kept rows are likeliest."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 200))
    rows = np.arange(len(truth))
    loss = [-np.log(np.maximum(softmax(logits / t)[rows, truth], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def least_odds(logits: np.ndarray) -> float:
    """Half way from chance, which no text is below, to where nearly all of the kept rows lie above."""
    classes = logits.shape[1]
    if classes == 1:
        return -np.inf
    chance = -np.log(classes - 1)
    return float((chance + np.quantile(log_odds(logits), UNSURE)) / 2)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts have a letter, and in how many of those each bucket occurs.

    A task adds its texts up, so at most the buckets of each task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, dtype=np.int64)  # the last counts texts
        for b in text_chunks(batches, 0):
            for text in b.column(0).to_pylist():
                if text and LETTER.search(text):
                    df[gram_counts(text)[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    found = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect()
    df = np.zeros((1 << BITS) + 1)
    for bucket, n in found:
        df[bucket] = n
    return int(df[-1]), df[:-1]


def fit(docs: DataFrame) -> Model:
    learn = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold("doc_id", FOLDS) != HELD_OUT, F.lit(False))
    ).select("doc_id", "text", "lang")
    ids = sampling.by_class(learn.select("doc_id", "lang"), "doc_id", "lang", PER_LANGUAGE, SAMPLE, "language")
    columns = ["doc_id", "text", "lang"]
    rows = sampling.gather(learn, ids, ["doc_id", "lang"], columns, "text", "lang", SAMPLE_BYTES, "language")
    return train([(text, lang) for _, text, lang in rows], frequencies=document_frequencies(learn))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for b in text_chunks(batches):
            found = [predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", held).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, whose language is told with enough confidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value.told
        for b in text_chunks(batches, at):
            yield b.filter(pa.array([told(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
