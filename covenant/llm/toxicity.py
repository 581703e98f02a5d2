"""Toxicity: a convolutional text classifier, trained here in numpy.

A word is the mean of hashed embeddings of itself and of its beginnings, so words
never seen share what their beginnings tell. Filters of several widths slide over
the words, each keeps its greatest response over the whole text (max pooling), and
a logistic layer scores those. As embedding and filter are both linear, a trained
filter's response to a bucket is a table, and scoring a text is lookups and sums.

The model learns from every labelled document of the learning fold, where they lie:
the words' buckets are dealt to shards by a hash of the ids, each shard passes over its
rows once a round, and a round ends with the mean of the shards' models, an embedding's
over the shards that changed it. A table of up to ``SHARD_ROWS`` rows is one sequence.
Calibration is cross-fitted there: beside the model three others are trained, each
without a third of the rows, and each row is scored by the one that wasn't taught it.
Those scores, all counted in bins of 1/256, give the logistic curve (Platt's method),
moved so that ``THRESHOLD`` is the cut of the best F1, which keeps it a useful cut where
toxic rows are few, and for each language the score above which a document is flagged.
Language sets that threshold only; the score sees nothing but the text. The settings
below were chosen by the same cross-validation, without a look at held-out rows.

Defined results: a null, empty or wordless text has the score of no response;
rows with an unknown language, or one with too few calibration rows, use the
common threshold; equal texts have equal scores; labels that are null or other
than 0 and 1 are not learnt from, an id with several labels counts as toxic if any
says so; further columns are ignored; an empty table gives an empty one, and with
no label of either class all scores are 0.
"""

from __future__ import annotations

import copy
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling
from .common import cut, fold, text_chunks, tidy

WORD = re.compile(r"[^\W\d_]+")
#: Bounds of ``learning_rows``: labelled rows of each class, and bytes of text.
SAMPLE = {0: 3000, 1: 2000}
SAMPLE_BYTES = 48 << 20
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: Lengths of the beginnings that a word is hashed by, besides itself.
PREFIXES = (4, 5, 7)
EPOCHS, RATE, DECAY = 5, 0.2, 1e-6
#: Of the embeddings before training: small, so that unseen words hardly respond.
SPREAD = 0.1
#: Slope of the rectifier below zero.
LEAK = 0.05
#: Parts of the learning rows that are scored by models of the other parts, to calibrate;
#: those models are trained beside the whole one.
PARTS = 3
MODELS = PARTS + 1
#: Rows that are passed over in one sequence; more rows make more shards, but no more than these.
SHARD_ROWS, MOST_SHARDS = 10_000, 64
#: Pieces in which the shards' embeddings are averaged.
BLOCKS = 64
#: Bins of calibration logits to the unit.
BINS = 256
#: Rows of either label that a language's own threshold needs.
FEW = 5
SEED = 7
#: For each word under each filter, all first words before all second ones: the filter, and the word.
SLOT_FILTER = np.asarray([i * FILTERS + f for j in range(max(WIDTHS)) for i, w in enumerate(WIDTHS) if j < w for f in range(FILTERS)])
SLOT_WORD = np.asarray([j for j in range(max(WIDTHS)) for w in WIDTHS if j < w for _ in range(FILTERS)])
#: Words that a worker remembers, and words of a text taken in one step.
CACHE, STEP = 120_000, 1 << 15


#: What a beginning's checksum starts from, its mark.
MARK = zlib.crc32(b"^")


def word_buckets(word: str) -> list[int]:
    if word.isascii():
        raw = word.encode()
        return [zlib.crc32(raw) % BUCKETS, *(zlib.crc32(raw[:n], MARK) % BUCKETS for n in PREFIXES)]
    raw = [word, *("^" + word[:n] for n in PREFIXES)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw]


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def text_buckets(text: str | None) -> np.ndarray:
    """The buckets of a text's words, a row a word, as narrow integers."""
    flat = [b for w in words_of(text) for b in word_buckets(w)]
    return np.asarray(flat, dtype=np.int32).reshape(-1, 1 + len(PREFIXES))


@dataclass
class Model:
    embedding: np.ndarray  # buckets x dim
    filters: list[np.ndarray]  # for each width: width x dim x filters
    bias: np.ndarray  # of all filters
    weights: np.ndarray
    offset: float
    platt: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    known: bool = True

    def scorer(self) -> Callable[[str | None], float]:
        return Scorer(self).score


def leaky(x: np.ndarray) -> np.ndarray:
    """A rectifier that lets a little through below zero, so no filter dies in training."""
    return np.where(x > 0, x, LEAK * x)


class Scorer:
    """Scores texts from response tables; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        flat = [model.filters[f // FILTERS][j, :, f % FILTERS] for f, j in zip(SLOT_FILTER, SLOT_WORD)]
        self.table = (model.embedding @ np.stack(flat, axis=1)).astype(np.float32)
        self.rows = np.zeros((1 << 12, self.table.shape[1]), dtype=np.float32)
        self.at = {"": 0}  # row 0 pads

    def _learn(self, words: list[str]) -> None:
        if len(self.at) + len(words) > CACHE:
            self.at = {"": 0}
        start = len(self.at)
        while start + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        buckets = np.asarray([word_buckets(w) for w in words], dtype=np.intp).T
        total = self.table.take(buckets[0], axis=0)
        for b in buckets[1:]:
            total += self.table.take(b, axis=0)
        self.rows[start : start + len(words)] = total / np.float32(len(buckets))
        self.at.update(zip(words, range(start, start + len(words))))

    def pooled(self, words: list[str]) -> np.ndarray:
        """The greatest response of every filter over the words."""
        pad, best = max(WIDTHS) - 1, None
        for s in range(0, max(len(words), 1), STEP):
            part = words[s : s + STEP + pad]
            found = list(map(self.at.get, part))
            if None in found:
                new = list(dict.fromkeys(w for w, f in zip(part, found) if f is None))
                if len(self.at) + len(new) > CACHE:
                    new = list(dict.fromkeys(part))
                self._learn(new)
                found = list(map(self.at.get, part))
            n, at = len(found) or 1, FILTERS * len(WIDTHS)
            got = self.rows.take(np.asarray(found + [0] * (n + pad - len(found)), dtype=np.intp), axis=0)
            got = np.ascontiguousarray(got.T)  # a row a slot: sums and maxima run along the words
            total = got[:at, :n]
            for j in range(1, max(WIDTHS)):
                more = int((SLOT_WORD == j).sum())
                total[-more:] += got[at : at + more, j : n + j]
                at += more
            now = total.max(axis=1)
            best = now if best is None else np.maximum(best, now)
        return best

    def logit(self, words: list[str]) -> float:
        m = self.model
        return float(leaky(self.pooled(words) + m.bias) @ m.weights + m.offset)

    def score(self, text: str | None) -> float:
        if not self.model.known:
            return 0.0
        a, b = self.model.platt
        return float(1 / (1 + np.exp(-np.clip(a * self.logit(words_of(text)) + b, -40, 40))))


def fresh(seed: int) -> tuple[Model, np.random.Generator]:
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    return Model(
        rng.normal(0, SPREAD, (BUCKETS, DIM)),
        [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS],
        np.zeros(total),
        rng.normal(0.2, 0.1, total),
        -1.0,
    ), rng


class State:
    """What training has come to, of the ``PARTS`` cross-fitted models and then the whole one.

    Embeddings are rows of ``(bucket, model)``; of them only those that training has
    changed are carried from round to round, the others follow from the seed.
    """

    def __init__(self, seed: int):
        m, _ = fresh(seed)
        flat = np.stack([m.filters[f // FILTERS][j, :, f % FILTERS] for f, j in zip(SLOT_FILTER, SLOT_WORD)])
        start = [np.stack([v] * MODELS) for v in (flat, m.bias, m.weights, np.asarray([m.offset]))]
        self.seed, self.dense = seed, [v.astype(np.float32) for v in (*start, *(np.full_like(v, 1e-3) for v in start))]
        self.index = np.zeros(0, dtype=np.int32)
        self.rows = self.squares = np.zeros((0, DIM), dtype=np.float32)

    def embedding(self) -> tuple[np.ndarray, np.ndarray]:
        """All embeddings, and their sums of squared gradients."""
        rows = np.repeat(fresh(self.seed)[0].embedding.astype(np.float32), MODELS, axis=0)
        squares = np.full_like(rows, 1e-3)
        rows[self.index], squares[self.index] = self.rows, self.squares
        return rows, squares

    def after(self, found: list[tuple]) -> State:
        """The state with the ``(block, index, rows, squares)`` of a round: dense values, and embeddings' changes."""
        new = copy.copy(self)
        rows, squares = self.embedding()
        changed = [self.index]
        for block, index, value, square in found:
            if block < 0:
                ends = np.cumsum([v.size for v in self.dense])
                parts = np.split(np.frombuffer(value, dtype=np.float32), ends[:-1])
                new.dense = [x.reshape(v.shape).copy() for x, v in zip(parts, self.dense)]
            else:
                at = np.frombuffer(index, dtype=np.int32)
                rows[at] += np.frombuffer(value, dtype=np.float16).reshape(-1, DIM)
                squares[at] += np.frombuffer(square, dtype=np.float16).reshape(-1, DIM)
                changed.append(at)
        new.index = np.unique(np.concatenate(changed))
        new.rows, new.squares = rows[new.index], squares[new.index]
        return new

    def model(self, k: int) -> Model:
        flat, bias, weights, offset = (v[k] for v in self.dense[:4])
        filters = [np.empty((w, DIM, FILTERS), dtype=np.float32) for w in WIDTHS]
        for value, f, j in zip(flat, SLOT_FILTER, SLOT_WORD):
            filters[f // FILTERS][j, :, f % FILTERS] = value
        return Model(self.embedding()[0].reshape(BUCKETS, MODELS, DIM)[:, k].copy(), filters, bias, weights, float(offset[0]))


def pooled(table: np.ndarray, filters: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response, and its first place, of each ``(model, filter)`` over a text's words."""
    n, pad, best = len(buckets), max(WIDTHS) - 1, None
    models, k = table.shape[1], 1 + len(PREFIXES)
    flat = table.reshape(len(table), -1)
    for s in range(0, max(n, 1), STEP):
        part, m = buckets[s : s + STEP + pad].astype(np.intp), max(min(STEP, n - s), 1)
        x = np.zeros((m + pad, flat.shape[1]), dtype=np.float32)
        for c in range(k):
            x[: len(part)] += flat.take(part[:, c], axis=0)
        z = (filters / np.float32(k)) @ x.reshape(m + pad, models, DIM).transpose(1, 2, 0)
        total, at = z[:, : FILTERS * len(WIDTHS), :m], FILTERS * len(WIDTHS)
        for j in range(1, max(WIDTHS)):
            more = (SLOT_WORD == j).sum()
            total[:, -more:] += z[:, at : at + more, j : m + j]
            at += more
        t = total.argmax(axis=2)
        now, t = total[np.arange(models)[:, None], np.arange(total.shape[1]), t], t + s
        if best is None:
            best, where = now, t
        else:
            where = np.where(now > best, t, where)
            best = np.maximum(best, now)
    return best, where


def summed(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of a few indexes, and the sums of their values; most are there once."""
    n, width = values.shape
    index, order = np.divmod(np.sort(index * n + np.arange(n)), n)
    first = np.concatenate([[True], index[1:] != index[:-1]])
    again = np.flatnonzero(~first)
    total = values.take(order[first], axis=0)
    if len(again):
        at = (np.cumsum(first)[again] - 1)[:, None] * width + np.arange(width)
        np.add.at(total.reshape(-1), at.ravel(), values.take(order[again], axis=0).ravel())
    return index[first], total


class Trainer:
    """Passes over a shard's rows: Adagrad steps, a document at a time, of all models at once.

    A document's part goes by its turn among the shard's rows of its label; the model
    of that part isn't taught by it. Only pooled positions get gradients.
    """

    def __init__(self, state: State, counts: dict[int, int], shard: int = 0, epoch: int = 0):
        self.rows, self.squares = state.embedding()
        self.state = state
        self.table = self.rows.reshape(BUCKETS, MODELS, DIM)
        self.dense = [v.copy() for v in state.dense]
        self.touched = np.zeros(len(self.rows), dtype=bool)
        self.share = {y: sum(counts.values()) / (2 * counts[y]) for y in (0, 1)}
        # a label of a single row is taught to all
        self.apart = min(counts.values()) > 1
        self.shard, self.turn = shard, {0: shard, 1: shard}
        self.rng = np.random.default_rng([state.seed, epoch, shard])

    def parts(self, labels: list[int]) -> list[int]:
        """The part of each of the next rows."""
        out = []
        for y in labels:
            out.append(self.turn[y] % PARTS)
            self.turn[y] += 1
        return out

    def learn(self, docs: list[np.ndarray], labels: list[int]) -> None:
        parts = self.parts(labels)
        for i in self.rng.permutation(len(docs)).tolist():
            self.step(docs[i], labels[i], parts[i] if self.apart else MODELS)

    def logits(self, docs: list[np.ndarray], labels: list[int]) -> list[float]:
        """Each row's logit by the model that wasn't taught it."""
        filters, bias, weights, offset = self.dense[:4]
        out = []
        # of their own: rows are taken from a contiguous table without a copy of it
        tables = [np.ascontiguousarray(self.table[:, k : k + 1]) for k in range(PARTS)]
        for buckets, k in zip(docs, self.parts(labels)):
            best, _ = pooled(tables[k], filters[k : k + 1], buckets)
            out.append(float(leaky(best[0] + bias[k]) @ weights[k] + offset[k, 0]))
        return out

    def step(self, buckets: np.ndarray, y: int, part: int) -> None:
        filters, bias, weights, offset, g_f, g_b, g_w, g_o = self.dense
        best, where = pooled(self.table, filters, buckets)
        raw = best + bias
        slope = np.where(raw > 0, np.float32(1), np.float32(LEAK))
        h = raw * slope
        p = 1 / (1 + np.exp(-np.clip((h * weights).sum(axis=1) + offset[:, 0], -30, 30)))
        live = np.abs(p - y) >= 1e-3
        live[part : part + 1] = False
        at = np.flatnonzero(live)
        if not len(at):
            return
        d = ((p[at] - y) * self.share[y]).astype(np.float32)[:, None]
        d_h = d * weights[at] * slope[at]
        for value, square, by in ((weights, g_w, d * h[at] + np.float32(DECAY) * weights[at]), (offset, g_o, d), (bias, g_b, d_h)):
            square[at] += by * by
            value[at] -= RATE * by / np.sqrt(square[at])
        # a slot is one of the words under a filter: responses are sums over its slots
        grad, n, k = d_h[:, SLOT_FILTER], len(buckets), 1 + len(PREFIXES)
        place = where[at][:, SLOT_FILTER] + SLOT_WORD
        inside = place < n
        x = np.zeros((*place.shape, DIM), dtype=np.float32)
        if n:
            rows = buckets[np.minimum(place, n - 1)] * np.intp(MODELS) + at[:, None, None]
            got = self.rows.take(rows.ravel(), axis=0).reshape(-1, k, DIM)
            x = got[:, 0] + got[:, 1]
            for c in range(2, k):
                x += got[:, c]
            x = x.reshape(*place.shape, DIM) * (inside * np.float32(1 / k))[..., None]
        d_f = x * grad[..., None]
        old, square = filters[at], g_f[at]
        square += d_f * d_f
        g_f[at] = square
        filters[at] = old - RATE * d_f / np.sqrt(square)
        used = np.flatnonzero(inside & (grad != 0))
        if not len(used):
            return
        d_x = old.reshape(-1, DIM).take(used, axis=0) * (grad.take(used) * np.float32(1 / k))[:, None]
        flat, steps = summed(rows.reshape(-1, k).take(used, axis=0).ravel(), np.repeat(np.concatenate([d_x, d_x * d_x], axis=1), k, axis=0))
        squares = self.squares.take(flat, axis=0) + steps[:, DIM:]
        self.squares[flat] = squares
        self.rows[flat] = self.rows.take(flat, axis=0) - RATE * steps[:, :DIM] / np.sqrt(squares)
        self.touched[flat] = True

    def found(self) -> list[tuple]:
        """``(block, shard, index, rows, squares)``: dense values, and changes of embeddings.

        The changes, and they alone, are rounded to half precision, which halves what is moved.
        """
        before = self.state.embedding()
        index = np.flatnonzero(self.touched).astype(np.int32)
        out = [(-1, self.shard, b"", np.concatenate([v.ravel() for v in self.dense]).tobytes(), b"")]
        blocks = index // (len(self.rows) // BLOCKS)
        for block in np.unique(blocks).tolist():
            at = index[blocks == block]
            change = [np.clip(now[at] - old[at], -60_000, 60_000).astype(np.float16) for now, old in zip((self.rows, self.squares), before)]
            out.append((block, self.shard, at.tobytes(), *(v.tobytes() for v in change)))
        return out


def averaged(block: pa.Table) -> pa.Table:
    """One row of a block's rows by all shards: the mean of dense values, or of an embedding's changes by those that made any."""
    by_shard = block.sort_by("shard").to_pydict()
    index = np.concatenate([np.frombuffer(b, dtype=np.int32) for b in by_shard["index"]])
    kind = np.float32 if by_shard["block"][0] < 0 else np.float16
    values = [[np.frombuffer(b, dtype=kind) for b in by_shard[c]] for c in ("rows", "squares")]
    if kind is np.float32:
        out = [np.mean(values[0], axis=0, dtype=np.float64), np.zeros(0)]
    else:
        order = index.argsort(kind="stable")
        index = index[order]
        starts = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        times = np.diff([*starts, len(index)])[:, None]
        index = index[starts]
        out = [np.add.reduceat(np.concatenate(v).reshape(-1, DIM)[order].astype(np.float64), starts) / times for v in values]
    row = [by_shard["block"][0], 0, index.tobytes(), *(v.astype(kind).tobytes() for v in out)]
    return pa.table([[v] for v in row], schema=block.schema)


def calibrated(state: State, bins: dict[str | None, list[tuple]]) -> Model:
    """The whole model, with its curve and thresholds from rows counted by ``(bin, toxic, clean)``.

    ``bins`` has them for all rows under ``None``, and for each language.
    """
    tables = {lang: np.asarray(sorted(b, reverse=True), dtype=np.float64).T for lang, b in bins.items()}
    at, toxic, clean = tables.pop(None)
    m = state.model(PARTS)
    slope, _ = platt(at / BINS, toxic, clean)
    # the cut of the best F1 over all languages stands at THRESHOLD
    offset = float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * best_threshold(at, toxic, clean))
    m.platt = slope, offset
    for lang, (at, toxic, clean) in tables.items():
        if toxic.sum() >= FEW and clean.sum() >= FEW:
            cut_at = slope * best_threshold(at, toxic, clean) + offset
            m.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(cut_at, -40, 40))))
    return m


def bin_of(logit: float) -> int:
    return int(np.floor(np.clip(logit, -128, 128) * BINS + 0.5))


def unknown(seed: int) -> Model:
    m, _ = fresh(seed)
    m.known = False
    return m


def train(rows: list[tuple[str | None, str | None, int]], seed: int = SEED) -> Model:
    """A model from ``(text, language, label)`` rows that are all here: one shard."""
    labels = [y for _, _, y in rows]
    counts = {y: labels.count(y) for y in (0, 1)}
    if not all(counts.values()):
        return unknown(seed)
    docs, state = [text_buckets(text) for text, _, _ in rows], State(seed)
    for epoch in range(EPOCHS):
        one = Trainer(state, counts, 0, epoch)
        one.learn(docs, labels)
        state = state.after([(b, i, v, g) for b, _, i, v, g in one.found()])
    bins: dict = {}
    for logit, (_, lang, y) in zip(Trainer(state, counts).logits(docs, labels), rows):
        for of in (None, str(lang)):
            bins.setdefault(of, {}).setdefault(bin_of(logit), [0, 0])[1 - y] += 1
    return calibrated(state, {of: [(b, *n) for b, n in got.items()] for of, got in bins.items()})


def platt(logits: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits the counts at each logit best (smoothed targets)."""
    pos, neg, n = toxic.sum(), clean.sum(), toxic + clean
    target = toxic * ((pos + 1) / (pos + 2)) + clean / (neg + 2)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        off = n * p - target
        grad = np.asarray([(off * logits).sum(), off.sum()])
        hess = np.asarray([[(w * logits * logits).sum(), (w * logits).sum()], [(w * logits).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-6 * np.eye(2), grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def best_threshold(at: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The logit in the middle of the gap of bins, from the greatest down, at which F1 is greatest."""
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(toxic + clean) + toxic.sum())
    i = int(np.argmax(f1))
    return float((at[i] + (at[i + 1] if i + 1 < len(at) else at[i] - 1)) / 2 / BINS)


def known_labels(labels: DataFrame) -> DataFrame:
    """``(doc_id, _toxic)`` of the learning fold, once an id."""
    good = F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)
    return labels.where(good).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))


def learning_rows(docs: DataFrame, labels: DataFrame) -> list[tuple]:
    """``(text, lang, label)`` rows for ``train`` on the driver, a bounded sample; ``fit`` doesn't use it."""
    known = known_labels(labels)
    # so many of each class, in the order of a hash of the id: a top-k on two numbers a row
    order = [F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")), F.col("doc_id")]
    parts = [known.where(F.col("_toxic") == y).orderBy(*order).limit(n) for y, n in SAMPLE.items()]
    ids = parts[0].union(parts[1])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    narrow = docs.select("doc_id", "text", lang.cast("string").alias("lang"))
    columns = ["doc_id", "text", "lang", "_toxic"]
    rows = sampling.gather(narrow, ids, ["doc_id"], columns, "text", "_toxic", SAMPLE_BYTES, "toxicity")
    return [(text, lang, int(y)) for _, text, lang, y in rows]


def learning_table(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """``(order, lang, label, words)`` of every labelled document of the learning fold, a partition a shard.

    Of an id's rows one is taken, that of the shortest text that is not null (ties: the
    least as compressed). A shard's rows are in the order of a hash of their ids. Texts move
    once, compressed and straight to their shard, where they meet their labels; a shard is
    the partition of its number, in however many partitions a session shuffles.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("None")) if "lang" in docs.columns else F.lit("None")
    key = F.col("doc_id").cast("string")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches):
            packed = pa.array([zlib.compress((t or "").encode(), 1) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], packed], names=["id", "lang", "none", "n", "packed"])

    texts = docs.where(fold("doc_id", FOLDS) != HELD_OUT).select(key, "text", lang, F.col("text").isNull(), F.octet_length("text"))
    texts = texts.mapInArrow(pack, "id string, lang string, none boolean, n int, packed binary")
    row = F.struct("none", "n", "packed", "lang").alias("row")
    told = known.select(key.alias("id"), F.lit(None).alias("row"), F.col("_toxic").cast("int").alias("label"))
    order = F.xxhash64(F.lit("toxicity"), F.col("id"))
    both = texts.select("id", row, F.lit(None).cast("int").alias("label")).union(told)
    both = both.select(F.pmod(order, F.lit(shards)).cast("int").alias("shard"), order.alias("order"), "id", "row", "label")
    one = both.repartitionById(shards, "shard").groupBy("shard", "order", "id").agg(F.min("row").alias("row"), F.max("label").alias("label"))
    one = one.where("row IS NOT NULL AND label IS NOT NULL").sortWithinPartitions("shard", "order", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bytes] = {}
        for batch in batches:
            for b in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                words = []
                for raw in b.column(3).to_pylist():
                    mine = words_of(zlib.decompress(raw).decode())
                    for w in mine:
                        if w not in seen:
                            seen[w] = np.asarray(word_buckets(w), dtype=np.uint16).tobytes()
                    words.append(zlib.compress(b"".join([seen[w] for w in mine]), 1))
                    if len(seen) > CACHE:
                        seen = {}
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(words, pa.binary())], names=["order", "lang", "label", "words"])

    return cut(one.select("order", "row.lang", "label", "row.packed").mapInArrow(run, "order long, lang string, label int, words binary"))


def unpacked(b: pa.RecordBatch) -> tuple[list[np.ndarray], list[int]]:
    docs = [np.frombuffer(zlib.decompress(w), dtype=np.uint16).reshape(-1, 1 + len(PREFIXES)) for w in b.column("words").to_pylist()]
    return docs, b.column("label").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """A model of all labelled documents of the learning fold, trained where they lie."""
    known = known_labels(labels)
    tally = known.join(docs.select("doc_id"), "doc_id", "left_semi").groupBy("_toxic").count().collect()
    counts = {int(y): n for y, n in tally}
    if len(counts) < 2:
        return unknown(seed)
    shards = min(MOST_SHARDS, -(-sum(counts.values()) // SHARD_ROWS))
    rows, sc = learning_table(docs, known, shards), docs.sparkSession.sparkContext
    tidy(docs.sparkSession)
    state = State(seed)
    for epoch in range(EPOCHS):
        shared = sc.broadcast(state)
        found = one_round(rows, shared, counts, epoch, shards).toArrow()
        # the driver's copies go too, in memory and on disk
        shared.destroy()
        state = state.after([(b.as_py(), *(x.as_buffer() for x in more)) for b, *more in zip(*found.columns)])
        del found
        tidy(docs.sparkSession)
    shared = sc.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in batches:
            one = one or Trainer(shared.value, counts, TaskContext.get().partitionId())
            bins = [bin_of(x) for x in one.logits(*unpacked(b))]
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(bins, pa.int32()), b.column("label")], names=["lang", "bin", "label"])

    found = rows.mapInArrow(run, "lang string, bin int, label int")
    sums = [F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")]
    found = cut(found.groupBy("lang", "bin").agg(*sums))
    shared.destroy()
    both = [F.sum(c).alias(c) for c in ("toxic", "clean")]
    enough = found.groupBy("lang").agg(*both).where(f"toxic >= {FEW} AND clean >= {FEW}")
    bins: dict = {None: [tuple(r) for r in found.groupBy("bin").agg(*both).collect()]}
    for lang, *row in found.join(enough.select("lang"), "lang", "left_semi").select("lang", "bin", "toxic", "clean").collect():
        bins.setdefault(lang, []).append(tuple(row))
    return calibrated(state, bins)


def one_round(rows: DataFrame, shared, counts: dict[int, int], epoch: int, shards: int) -> DataFrame:
    """``(block, index, rows, squares)`` for ``State.after``: each shard has passed over its rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = None
        for b in batches:
            if b.num_rows:
                one = one or Trainer(shared.value, counts, TaskContext.get().partitionId(), epoch)
                one.learn(*unpacked(b))
        for row in one.found() if one else ():
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["block", "shard", "index", "rows", "squares"])

    kind = "block int, shard int, index binary, rows binary, squares binary"
    found = rows.mapInArrow(run, kind)
    if shards > 1:
        found = found.groupBy("block").applyInArrow(averaged, kind)
    return found.select("block", "index", "rows", "squares")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted, threshold, flagged)`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, thresholds = shared.value.scorer(), shared.value.thresholds
        for b in text_chunks(batches):
            scores = np.asarray([score(t) for t in b.column(1).to_pylist()])
            limits = np.asarray([thresholds.get(str(x), THRESHOLD) for x in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(3),
                    pa.array(scores),
                    pa.array((scores >= THRESHOLD).astype(np.int32)),
                    pa.array(limits),
                    pa.array(scores >= limits),
                ],
                names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", "text", lang.cast("string"), held).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, threshold double, flagged boolean"
    )


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, all columns, whose score is below their language's threshold: those not ``flagged``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    lang = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, thresholds = shared.value.scorer(), shared.value.thresholds
        for b in text_chunks(batches, at):
            langs = [None] * b.num_rows if lang is None else b.column(lang).to_pylist()
            clean = [score(t) < thresholds.get(str(x), THRESHOLD) for t, x in zip(b.column(at).to_pylist(), langs)]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
