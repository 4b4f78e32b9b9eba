"""Concatenate and cut: token streams of documents packed into windows of a fixed length.

Pass 1 tokenises and writes, for each input partition, the documents' ids and the place of each document within the
partition. Prefix sums over the partition totals give each partition's global offset (a table with one row for each
partition). Pass 2 reads the ids, adds the offsets and cuts at the windows' global bounds, with a boundary record for
each piece. Nothing but the partition totals is gathered, and a lost executor only repeats its tasks: the places were
written once, with the ids.

Defined results: a null or empty text has only the closing id; repeated rows are packed as often as they occur; an empty
table gives no pieces; a document longer than a window is cut freely; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _classes, boundaries, byte_places
from .common import PASS_BYTES, doc_texts, materialise, passes, raw, released, words
from .merging import PairTable, distinct, merge, ragged

_PLAIN = np.zeros(0x130, bool)
#: Code points whose lower case, normal form and class are the same under every library.
_PLAIN[[*range(0x21, 0x7F), *range(0xA1, 0x130)]] = True


class WordEncoder:
    """Ids of white-space separated words under a BPE with word ends.

    White space always separates in this kind of tokenizer, so each word stands for itself, and each distinct word of a
    pass is merged once. Plain words are cut into pieces and merged on arrays; any other word goes to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as file:
            model = json.load(file)["model"]
        vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[letter[b] + "</w>"] for b in range(256)], np.int32)
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        self.table = PairTable(left, right, np.arange(len(pairs)), made.astype(np.int32))
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4

    def _plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of plain words, each closed by a line feed."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        starts = boundaries(points, np.zeros(len(points), bool))
        kind = _classes()[points]
        starts |= kind == 1  # each number is a piece of its own
        at = np.flatnonzero(starts)
        closing = points[at] == 10
        place = byte_places(points)[np.append(at, len(points))]
        body = np.frombuffer(text.lower().encode(), np.uint8)
        a, size = place[:-1][~closing], np.diff(place)[~closing]
        symbols = self.inner[body[ragged(a, size)]]
        bounds = np.concatenate([[0], np.cumsum(size)])
        symbols[bounds[1:] - 1] = self.final[body[a + size - 1]]
        ids, bounds = merge(symbols, bounds, self.table)
        return ids, bounds[np.concatenate([[0], np.cumsum(~closing)[closing]])]

    def _fill(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of distinct words."""
        size = ends - starts
        closed = np.concatenate([[0], np.cumsum(size + 1)])
        joined = np.full(closed[-1], 10, np.uint8)
        joined[ragged(closed[:-1], size)] = body[ragged(starts, size)]
        text = joined.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        odd = (points >= 0x130) | ~_PLAIN[np.minimum(points, 0x12F)]
        breaks = points == 10
        odd[breaks] = False
        odd[:-1] |= (points[:-1] == 60) & (points[1:] == 124)  # what may be a special token
        word = np.cumsum(breaks) - breaks
        special = np.zeros(len(size), bool)
        special[word[odd]] = True
        rows = np.flatnonzero(special)
        other = [np.array(self.tokenizer.encode(joined[closed[i] : closed[i + 1] - 1].tobytes().decode(), add_special_tokens=False).ids, np.int32) for i in rows.tolist()]
        keep = np.ones(len(joined), bool)
        keep[ragged(closed[rows], size[rows] + 1)] = False
        count = np.zeros(len(size), np.int64)
        ids, bounds = self._plain(joined[keep].tobytes().decode())
        plain = np.flatnonzero(~special)
        count[plain], count[rows] = np.diff(bounds), [len(x) for x in other]
        out_bounds = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(out_bounds[-1], np.int32)
        out[ragged(out_bounds[plain], count[plain])] = ids
        if other:
            out[ragged(out_bounds[rows], count[rows])] = np.concatenate(other)
        return out, out_bounds

    def encode(self, body: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts with ``end_id`` after each, and the bounds of the texts."""
        starts, ends, heads = words(body, offsets)
        first, number = distinct(body, starts, ends)
        ids, bounds = self._fill(body, starts[first], ends[first])
        size = np.diff(bounds)[number]
        total = np.concatenate([[0], np.cumsum(size)])
        out_bounds = total[heads] + np.arange(len(offsets))
        out = np.full(out_bounds[-1], end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[out_bounds[1:] - 1] = False
        out[inner] = ids[ragged(bounds[:-1][number], size)]
        return out, out_bounds


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Pass 1: part, begins (the document's place within the part, in ids), doc_id, n_tokens, ids (binary).

    Ids are little-endian and unsigned, of two bytes where the vocabulary allows, else of four.
    """

    def run(batches):
        e, part, total = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets, 4 * PASS_BYTES):
                ids, bounds = e.encode(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                data, at = memoryview(ids.astype(f"<u{e.width}").view(np.uint8)), (bounds * e.width).tolist()
                yield pa.record_batch(
                    [pa.array(np.full(b - a, part, np.int32)), pa.array(total + bounds[:-1]), batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array([data[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())],
                    names=["part", "begins", "doc_id", "n_tokens", "ids"],
                )
                total += int(bounds[-1])

    return doc_texts(docs).mapInArrow(released(run), "part int, begins long, doc_id long, n_tokens long, ids binary")


def cut(streams: DataFrame, window: int = 2048) -> DataFrame:
    """Pass 2: boundary records of the pieces of written streams (as from tokenise)."""
    # One row for each partition of pass 1: some tens of bytes each, a small part of what the scheduler itself keeps.
    totals = streams.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in totals], dtype=np.int64)
    base = streams.sparkSession.sparkContext.broadcast({r.part: int(e) - r.n for r, e in zip(totals, ends)})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        for batch in batches:
            part, begins, doc, n = (np.array(batch.column(i)) for i in range(4))
            body, offsets = raw(batch.column(4))
            place = begins + np.array([base.value[p] for p in part.tolist()], np.int64) if len(part) else begins
            pieces = np.where(n > 0, (place + n - 1) // window - place // window + 1, 0)
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(place[row], (place[row] // window + k) * window)
            end = np.minimum((place + n)[row], (place[row] // window + k + 1) * window)
            width = 2 if len(n) == 0 or len(body) == 2 * n.sum() else 4
            wide = np.frombuffer(body.tobytes(), f"<u{width}")
            first = offsets[row] // width + begin - place[row]
            view = memoryview(wide.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + end - begin).tolist())]
            ids = pa.array(doc[row], pa.int64()) if batch.column(2).null_count == 0 else batch.column(2).take(pa.array(row))
            yield pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (begin - place[row], end - begin, crc, n[row], begin // window, begin % window))], names=names)

    return streams.select("part", "begins", "doc_id", "n_tokens", "ids").mapInArrow(released(run), ", ".join(f"{x} long" for x in names))


def concat_and_cut(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Boundary records of every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return cut(materialise(tokenise(docs, path, end_id)), window)
