"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of words; the whole text, whatever its length). Every passage is described by
numbers from its bytes and words and by hashed counts of its character trigrams and word pairs, encoded by a dense layer,
weighted by gated attention (tanh and sigmoid branches) and summed; the score is a logistic function of the weighted
passage representation. The model is fitted on the driver to a bounded sample: at most ``sample`` labelled documents,
those whose hashed ids are smallest, and of each at most TRAINED passages, evenly spread (scores take all); their numbers
are computed on the executors. Training ends when the loss has settled. Scoring is one pass over all documents without a
shuffle.

Defined results: a null or empty text is a bag with one passage of no words and gets a score; repeated rows give repeated
rows; an empty table gives an empty table; with labels of one kind only, or none, every score is that kind's share
(0.5 without labels); other columns than doc_id, text and the labels' doc_id and quality are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, doc_texts, lower_ascii, passes, raw, released, word_hashes, words
from .merging import ragged

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 6000
#: Words of a passage.
PASSAGE = 64
#: Passages of a document that the model is fitted to, at most.
TRAINED = 32
#: Bytes of text in one pass: its numbers take some fifty times as many.
PASS = 1 << 19
HIDDEN, GATES = 24, 12
#: Training ends when SETTLED epochs lower the mean loss by less than a thousandth, or after EPOCHS.
EPOCHS, SETTLED = 1000, 40
#: Pull of the weights towards zero.
DECAY = 1e-3
#: Places of hashed trigrams, and of hashed word pairs.
HASHED = 64

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WIDE = np.arange(256) >= 128
_LINE = np.arange(256) == 10
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,"])
_SHOUT = np.isin(np.arange(256), [ord(c) for c in "!?"])
_BAR = np.isin(np.arange(256), [ord(c) for c in "|/<>[]{}="])
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SIGN &= ~(_STOP | _SHOUT | _BAR)
_KINDS = (_UPPER, _LOWER, _DIGIT, _WIDE, _LINE, _STOP, _SHOUT, _BAR, _SIGN)
WIDTH = len(_KINDS) + 8 + 2 * HASHED


def _hashed(code: np.ndarray, row: np.ndarray, rows: int, size: np.ndarray) -> np.ndarray:
    """Signed counts of 32-bit codes in HASHED places of each row, by the root of the row's size."""
    place = row * HASHED + (code >> np.uint32(20)).astype(np.int64) % HASHED
    sign = np.where(code & np.uint32(1 << 15), 1.0, -1.0)
    return np.bincount(place, sign, rows * HASHED).reshape(rows, HASHED) / np.sqrt(np.maximum(size, 1))[:, None]


def _grams(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray, first_word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashed character trigrams and word pairs of passages at byte ``starts`` and words ``first_word``."""
    rows, letters, pairs = len(starts), np.maximum(sizes - 2, 0), np.maximum(counts - 1, 0)
    at = ragged(starts, letters)
    code = body[at].astype(np.uint32) * np.uint32(0x9E3779B1) + body[at + 1].astype(np.uint32) * np.uint32(0x85EBCA77) + body[at + 2].astype(np.uint32) * np.uint32(0xC2B2AE3D)
    code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    word = ragged(first_word, pairs)
    both = ((h[word] * U64(0x9E3779B97F4A7C15) ^ h[word + 1]) * U64(0xD6E8FEB86659FD93) >> U64(32)).astype(np.uint32)
    index = np.arange(rows)
    return np.concatenate([_hashed(code, np.repeat(index, letters), rows, letters), _hashed(both, np.repeat(index, pairs), rows, pairs)], 1)


def passage_numbers(body: np.ndarray, offsets: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of every passage of consecutive texts, and for each text the index of its first passage."""
    starts, ends, heads = words(body, offsets)
    counts = np.diff(heads)
    bags = np.maximum(1, -(-counts // passage))
    first = np.concatenate([[0], np.cumsum(bags)])
    out = np.zeros((first[-1], WIDTH), np.float32)
    if not len(starts):
        return out, first
    lower = lower_ascii(body)
    h = word_hashes(lower, starts, ends)
    doc = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(starts)) - heads[doc]
    number = first[doc] + inside // passage
    begin = np.flatnonzero(inside % passage == 0)
    full = number[begin]
    n = np.diff(np.append(begin, len(starts))).astype(np.float64)
    a, b = starts[begin], np.append(begin[1:], len(starts)) - 1
    z = ends[b]
    size = (z - a).astype(np.float64)
    cols = []
    for kind in _KINDS:
        total = np.concatenate([[0], np.cumsum(kind[body])])
        cols.append((total[z] - total[a]) / size)
    length = (ends - starts).astype(np.float64)
    mean = np.add.reduceat(length, begin) / n
    cols.append(mean / 10)
    cols.append(np.sqrt(np.maximum(0, np.add.reduceat(length * length, begin) / n - mean * mean)) / 10)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (inside[1:] % passage != 0)
    cols.append(np.add.reduceat(again, begin) / n)
    key = np.lexsort((h, number))
    new = np.ones(len(h))
    new[1:] = (h[key][1:] != h[key][:-1]) | (number[key][1:] != number[key][:-1])
    cols.append(np.bincount(number[key], new, first[-1])[full] / n)
    cols.append(np.add.reduceat((length <= 3).astype(np.float64), begin) / n)
    tail = body[ends - 1]
    cols.append(np.add.reduceat((_SIGN | _SHOUT | _BAR)[tail].astype(np.float64), begin) / n)
    cols.append(np.add.reduceat(_UPPER[body[starts]].astype(np.float64), begin) / n)
    cols.append(np.log1p(n) / 4)
    out[full] = np.concatenate([np.stack(cols, 1), _grams(lower, a, z - a, h, begin, n.astype(np.int64))], 1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Dense encoder, gated attention over passages, logistic output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: dict[str, np.ndarray], constant: float | None = None):
        self.mean, self.scale, self.w, self.constant = mean, scale, weights, constant

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["E"] + w["e"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        raw_weight = (t * s) @ w["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        up = np.exp(raw_weight - np.maximum.reduceat(raw_weight, first[:-1])[bag])
        share = up / np.add.reduceat(up, first[:-1])[bag]
        z = np.add.reduceat(h * share[:, None], first[:-1])
        return {"h": h, "t": t, "s": s, "share": share, "z": z, "bag": bag, "p": _sigmoid(z @ w["o"] + w["b"][0])}

    def score(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward((numbers - self.mean) / self.scale, first)["p"]


def fit(numbers: np.ndarray, first: np.ndarray, labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the mean log loss until it has settled, both kinds weighted alike in sum at most 3 to 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, share)
    mean, scale = numbers.mean(0, dtype=np.float64).astype(np.float32), (numbers.std(0, dtype=np.float64) + 1e-3).astype(np.float32)
    x = (numbers - mean) / scale
    r = np.random.default_rng(seed)
    g = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b)).astype(np.float32)
    none = lambda n: np.zeros(n, np.float32)
    w = {"E": g(WIDTH, HIDDEN), "e": none(HIDDEN), "V": g(HIDDEN, GATES), "U": g(HIDDEN, GATES), "a": g(GATES, 1)[:, 0], "o": g(HIDDEN, 1)[:, 0], "b": none(1)}
    model = Model(mean, scale, w)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    weight = np.where(labels == 1, 1.0, min(3.0, share / (1 - share)) if share > 0.5 else 1.0)
    weight /= weight.sum()
    losses: list[float] = []
    for step in range(1, epochs + 1):
        f = model.forward(x, first)
        p = np.clip(f["p"], 1e-9, 1 - 1e-9)
        losses.append(float(-(weight * np.where(labels == 1, np.log(p), np.log(1 - p))).sum()))
        if step > 2 * SETTLED and min(losses[-SETTLED:]) > min(losses[:-SETTLED]) - 1e-3:
            break
        d = (weight * (f["p"] - labels)).astype(np.float32)
        dz = d[:, None] * w["o"]
        per = dz[f["bag"]]
        dshare = (per * f["h"]).sum(1)
        dot = np.add.reduceat(dshare * f["share"], first[:-1])
        draw = f["share"] * (dshare - dot[f["bag"]])
        dg = draw[:, None] * w["a"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh = per * f["share"][:, None] + dt @ w["V"].T + ds @ w["U"].T
        de = dh * (1 - f["h"] ** 2)
        grads = {"E": x.T @ de, "e": de.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ draw, "o": f["z"].T @ d, "b": np.array([d.sum()])}
        for k in w:
            grad = grads[k] + DECAY * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            w[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """The rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out."""
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    labelled = labelled.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = labelled.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    texts = doc_texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def run(batches):
        for batch in batches:
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets, PASS):
                numbers, first = passage_numbers(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bags = []
                for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                    bags.append(numbers[x:y] if y - x <= TRAINED else numbers[x + np.arange(TRAINED) * (y - x) // TRAINED])
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([x.tobytes() for x in bags], pa.binary())], names=["doc_id", "quality", "numbers"])

    found = texts.mapInArrow(released(run), "doc_id long, quality int, numbers binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", "numbers")).alias("s")).select("doc_id", "s.*").toLocalIterator()  # one row for a doc_id
    rows = sorted(rows, key=lambda r: r.doc_id)
    parts = [np.frombuffer(r.numbers, np.float32).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return fit(np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32), first, np.array([r.quality for r in rows], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets, PASS):
                numbers, first = passage_numbers(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(held.value.score(numbers, first), pa.float64())], names=["doc_id", "score"])

    return doc_texts(docs).mapInArrow(released(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that score at least ``threshold``; one pass, no shuffle of texts."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("text").cast("string").alias("t"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            body, offsets = raw(batch.column(0))
            for a, b in passes(offsets, PASS):
                numbers, first = passage_numbers(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                good = pa.array(held.value.score(numbers, first) >= threshold)
                yield pa.record_batch([batch.column(1).slice(a, b - a).filter(good)], names=["row"])

    kept = rows.mapInArrow(released(run), T.StructType([T.StructField("row", rows.schema["row"].dataType)]))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
