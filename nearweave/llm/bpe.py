"""Byte-level BPE encoding and decoding.

Pre-tokenisation works on arrays of code points. Each code point becomes one of a few symbols (its class, with one or
two code points of look-ahead folded in), each symbol is a transition function of a small automaton, and an associative
scan over these functions gives the automaton's state before every code point and with it the places where pieces start.
Functions are numbered and composed by a table, so the scan is a gather for each code point. The slices between
boundaries feed cached pair merging: within a pass of bounded size each distinct slice is merged once, all of them
together on arrays. Offsets of the pieces are kept, and decoding joins the bytes of the ids.

Defined results: a null text counts as the empty text; the empty text has no ids; repeated rows give repeated rows;
an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import PASS_BYTES, doc_texts, passes, raw
from .merging import PairTable, encode_slices, merge, ragged

# Symbols: letter, number, other, space before non-space, other white space before non-space, white space before white
# space or the end, apostrophe of a one-letter and of a two-letter suffix, end of text.
LETTER, NUMBER, OTHER, JOIN, LONE, BLANK, SHORT, LONG, END = range(9)
# States: start or after a lone blank, in letters, in numbers, in others, after a joining space, in blanks,
# before the one letter or the two letters of a suffix, after a suffix.
_FRESH, _LETTERS, _NUMBERS, _OTHERS, _JOINED, _BLANKS, _ONE, _TWO, _DONE = range(9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece starts at this code point."""
    if symbol == END:
        return _FRESH, True
    if state == _TWO:
        return _ONE, False
    if state == _ONE:
        return _DONE, False
    if symbol in (SHORT, LONG):
        if state in (_JOINED, _OTHERS):  # the mark belongs to a run that is under way
            return _OTHERS, False
        return (_ONE if symbol == SHORT else _TWO), True
    if symbol == BLANK:
        return _BLANKS, state != _BLANKS
    if symbol == LONE:
        return _FRESH, True
    if symbol == JOIN:
        return _JOINED, True
    run = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS}[symbol]
    return run, state not in (run, _JOINED)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, the table that composes numbered functions, and the functions themselves."""
    generators = [tuple(_step(s, y)[0] for s in range(9)) for y in range(9)]
    identity = tuple(range(9))
    known, todo = {identity: 0}, [identity]
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    functions = np.array(list(known), np.uint8)
    compose = np.empty((len(known), len(known)), np.uint16)
    for i, f in enumerate(functions):
        for j, g in enumerate(functions):
            compose[i, j] = known[tuple(int(x) for x in g[f])]
    return np.array([known[g] for g in generators], np.uint16), compose, functions


_GENERATOR, _COMPOSE, _FUNCTIONS = _monoid()
_STARTS = np.array([[_step(s, y)[1] for y in range(9)] for s in range(9)])
_CLASS: np.ndarray | None = None


def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every code point."""
    global _CLASS
    if _CLASS is None:
        table = np.full(0x110000, 2, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        at = np.array(points)
        for k, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[at[m.start() : m.end()]] = k
        _CLASS = table
    return _CLASS


def scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The automaton's state before each symbol, from an associative scan in three steps.

    Within blocks of ``width`` symbols all blocks advance together; block totals are scanned by doubling; then the
    state that enters a block is applied to the block's prefixes.
    """
    n = len(symbols)
    rows = -(-n // width)
    f = np.zeros(rows * width, np.uint16)
    f[:n] = _GENERATOR[symbols]
    f = np.ascontiguousarray(f.reshape(rows, width).T)
    before = np.empty_like(f)
    held = np.zeros(rows, np.uint16)
    for j in range(width):
        before[j] = held
        held = _COMPOSE[held, f[j]]
    step = 1
    while step < rows:
        held[step:] = _COMPOSE[held[:-step], held[step:]]
        step *= 2
    entry = np.zeros(rows, np.uint8)
    entry[1:] = _FUNCTIONS[held[:-1], 0]
    return _FUNCTIONS[before, entry[None, :]].T.reshape(-1)[:n]


_ONE_LETTER = np.zeros(128, bool)
_ONE_LETTER[[ord(c) for c in "stmd"]] = True


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where a piece starts. ``points``: code points, ``ends``: True at the marker that closes each text."""
    kind = _classes()[points]
    kind[ends] = 3
    symbols = kind.copy()
    n = len(points)
    following = np.empty(n, np.uint8)
    following[:-1], following[-1:] = kind[1:], 3
    blank = kind == 3
    last = blank & (following != 3)
    symbols[blank] = BLANK
    symbols[last] = LONE
    symbols[last & (points == 32)] = JOIN
    mark = np.flatnonzero((points == 39) & (following == 0))
    if len(mark):
        one = points[mark + 1]
        two = points[np.minimum(mark + 2, n - 1)]
        short = (one < 128) & _ONE_LETTER[np.minimum(one, 127)]
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        symbols[mark[short]] = SHORT
        symbols[mark[pair]] = LONG
    symbols[ends] = END
    return _STARTS[scan(symbols), symbols]


def byte_places(points: np.ndarray) -> np.ndarray:
    """Place of each code point in UTF-8, and the end."""
    out = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=out[1:])
    return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int64).T
        self.table = PairTable(left, right, rank, np.arange(size, dtype=np.int32))
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = {v: k for k, v in self.ranks.items()}
        self.size = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)
        # A piece that is a token as a whole is that token, even where merges would not build it.
        listed = [t for t in self.ranks if len(t) > 1]
        ids, bounds = merge(self.single[np.frombuffer(b"".join(listed), np.uint8)], np.concatenate([[0], np.cumsum([len(t) for t in listed])]), self.table)
        self.unbuilt = {t: self.ranks[t] for t, a, b in zip(listed, bounds[:-1].tolist(), bounds[1:].tolist()) if b - a != 1}
        self.unbuilt_sizes = np.array(sorted({len(t) for t in self.unbuilt}), np.int64)

    def _fill(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        ids, bounds = merge(self.single[body[ragged(starts, size)]], np.concatenate([[0], np.cumsum(size)]), self.table)
        if self.unbuilt:
            fixed = {int(i): r for i in np.flatnonzero(np.isin(size, self.unbuilt_sizes)) if (r := self.unbuilt.get(body[starts[i] : ends[i]].tobytes())) is not None}
            if fixed:
                drop = np.zeros(len(ids), bool)
                count = np.diff(bounds)
                for i, r in fixed.items():
                    ids[bounds[i]], drop[bounds[i] + 1 : bounds[i + 1]], count[i] = r, True, 1
                ids, bounds = ids[~drop], np.concatenate([[0], np.cumsum(count)])
        return ids, bounds

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, bounds of each text among them, byte offsets of all pieces, bounds of each text among those.

        Texts are joined with a marker after each; a marker ends the piece before it and is no piece itself.
        """
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.zeros(len(points), bool)
        closing = np.cumsum([len(t) + 1 for t in texts]) - 1
        ends[closing] = True
        starts = np.flatnonzero(boundaries(points, ends))
        real = ~ends[starts[:-1]]
        place = byte_places(points)[starts]
        body = np.frombuffer(joined.encode(), np.uint8)
        a, b = place[:-1][real], place[1:][real]
        ids, bounds = encode_slices(body, a, b, lambda x, y: self._fill(body, x, y))
        piece = np.concatenate([[0], np.searchsorted(starts[:-1][real], closing)])
        return ids, bounds[piece], a, piece

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, and the bounds in bytes that belong to the given bounds in ids."""
        size = self.size[ids]
        out = self.tokens[ragged(self.place[ids], size)]
        return out, np.concatenate([[0], np.cumsum(size)])[bounds]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


_DECIMALS = np.array([b"%d," % i for i in range(100_000)])


def decimals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids as decimals with a comma after each: bytes, and the places of the ids."""
    if len(ids) and ids.max() >= 100_000:
        raise ValueError("ids of at most five digits are expected")
    digits = 1 + (ids >= 10).astype(np.int64) + (ids >= 100) + (ids >= 1000) + (ids >= 10_000)
    wide = _DECIMALS[ids].view(np.uint8).reshape(len(ids), 6)
    return wide[np.arange(6)[None, :] <= digits[:, None]], np.concatenate([[0], np.cumsum(digits + 1)])


def text_passes(column: pa.Array, limit: int = 4 * PASS_BYTES) -> Iterator[list[str]]:
    """The texts of a column in lists of bounded size, null as empty."""
    _, offsets = raw(column)
    for a, b in passes(offsets, limit):
        yield ["" if t is None else t for t in column.slice(a, b - a).to_pylist()]


def _cut(body: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    view, at = memoryview(np.ascontiguousarray(body)), bounds.tolist()
    return [view[a:b] for a, b in zip(at[:-1], at[1:])]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and piece_offsets (the same, in bytes)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            doc, at = batch.column(0), 0
            for texts in text_passes(batch.column(1)):
                ids, bounds, offsets, piece = c.encode(texts)
                heads = np.concatenate([[0], np.cumsum([len(t.encode()) + 1 for t in texts])])[:-1]
                local = (offsets - np.repeat(heads, np.diff(piece))).astype("<u4").view(np.uint8)
                yield pa.record_batch(
                    [doc.slice(at, len(texts)), pa.array(np.diff(bounds)), pa.array(_cut(ids.astype("<u4").view(np.uint8), 4 * bounds), pa.binary()), pa.array(_cut(local, 4 * piece), pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "piece_offsets"],
                )
                at += len(texts)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary, piece_offsets binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) from doc_id and ids; null ids give an empty text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids, bounds = raw(batch.column(1))
            body, places = c.decode(np.frombuffer(ids.tobytes(), "<u4").astype(np.int64), bounds // 4)
            yield pa.record_batch([batch.column(0), pa.array(_cut(body, places), pa.binary())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces: texts are encoded, and the ids digested and decoded."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            doc, at = batch.column(0), 0
            for texts in text_passes(batch.column(1)):
                ids, bounds, _, piece = c.encode(texts)
                shown, places = decimals(ids)
                body, ends = c.decode(ids, bounds)
                listed = np.stack([places[bounds[:-1]], np.maximum(places[bounds[1:]] - 1, places[bounds[:-1]])], 1).tolist()
                view = memoryview(np.ascontiguousarray(shown))
                yield pa.record_batch(
                    [
                        doc.slice(at, len(texts)),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in listed], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _cut(body, ends)], pa.string()),
                        pa.array(np.diff(piece)),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces"],
                )
                at += len(texts)

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long")
