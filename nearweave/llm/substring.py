"""Substring dedup: every word of a passage of ``window`` or more words that also starts earlier is removed.

The corpus is its own reference. One automaton of everything could not be broadcast at scale, and broadcasting automata
of shards one after the other would read the corpus once for each, so the reference is dealt into shards by content and
each shard's suffix automaton meets only the segments that can match it:

1. Each window of ``window`` consecutive words has an anchor, the least hash among its runs of ``GRAM`` words. Equal
   windows have equal anchors. Anchors (about two in 17 words) are counted over the corpus.
2. Windows whose anchor occurs more than once are candidates. Consecutive candidates with one anchor form a segment of
   word hashes, dealt by anchor. Where an anchor is very frequent, each of its windows is a segment of its own, dealt by
   content, so no anchor makes a large shard.
3. Equal segments are combined before and after the shuffle, keeping the earliest place. A later copy of a segment is
   removed whole; only earliest copies go on.
4. Each shard's segments stream, in order of their places, through a suffix automaton that grows with them. Matching
   statistics (the longest suffix seen before) of at least ``window`` mark a window as repeated; the others are fresh.
5. Removed windows of a document are its candidates without the fresh ones; maximal spans of covered words go.

Windows are judged on the input, not on what is left. Defined results: words are runs of anything but the blank and the
five controls from tab to carriage return; null and empty texts have no words; rows equal in doc_id and text are one
document (both are returned); rows equal in doc_id only are ordered by a digest of their words; a null doc_id comes
before all others; an empty table gives an empty table; other columns are ignored, or carried along by ``rewrite``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import Tables
from .common import LOWEST, U64, gram_hashes, id_filter, lowest_id, may_hold, mix, partitions, passes, raw, released, word_hashes, words
from .merging import ragged

WINDOW, GRAM = 20, 5
#: Occurrences from which an anchor's windows are dealt one by one.
FREQUENT = 20_000
#: Bytes of a word's hash that travel with segments: sequences are only compared where an anchor of 64 bits agrees.
WORD = 6


class _Pass:
    """Words and windows of consecutive texts; windows are numbered by their first word."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, window: int):
        self.body, self.window = body, window
        self.starts, self.ends, self.heads = words(body, offsets)
        self.h = word_hashes(body, self.starts, self.ends)
        counts = np.diff(self.heads)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        n, width = len(self.h) - window + 1, window - GRAM + 1
        if n > 0:
            grams = gram_hashes(self.h, GRAM)
            least = grams[:n].copy()
            self.anchor = np.zeros(n, np.int64)
            for j in range(1, width):
                lower = grams[j : j + n] < least
                least[lower] = grams[j : j + n][lower]
                self.anchor[lower] = j
            self.anchor += np.arange(n)
            self.key = least.view(np.int64)
            self.whole = self.doc[:n] == self.doc[window - 1 :]
        else:
            self.anchor, self.key, self.whole = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def digests(self) -> np.ndarray:
        """A digest of each text's words."""
        place = np.arange(len(self.h)) - self.heads[:-1][self.doc] if len(self.h) else np.zeros(0, np.int64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.h + place.astype(np.uint64) * U64(0x9E3779B97F4A7C15)))])
        return (total[self.heads[1:]] - total[self.heads[:-1]]).view(np.int64)

    def candidates(self, keys: np.ndarray) -> np.ndarray:
        return self.whole & np.isin(self.key, keys)


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(lowest_id().alias("d"), F.col("text").cast("string").alias("t"))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """key, d, c: anchors of each document and how often they are chosen there."""

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets):
                p = _Pass(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
                at = np.flatnonzero(p.whole)
                if len(at):
                    new = np.ones(len(at), bool)
                    new[1:] = p.anchor[at][1:] != p.anchor[at][:-1]
                    at = at[new]
                    doc, key = p.doc[at], p.key[at]
                    order = np.lexsort((key, doc))
                    doc, key = doc[order], key[order]
                    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
                    yield pa.record_batch([pa.array(key[head]), pa.array(ids[a:b][doc[head]]), pa.array(np.diff(np.append(head, len(doc))))], names=["key", "d", "c"])

    return docs.mapInArrow(released(run), "key long, d long, c long")


def _repeated(docs: DataFrame, window: int) -> DataFrame:
    """d, few, many: the document's anchors that occur more than once, and those of them that are very frequent."""
    anchors = _anchors(docs, window)
    counts = anchors.groupBy("key").agg(F.sum("c").alias("n")).filter("n > 1").select("key", (F.col("n") > FREQUENT).alias("hot"))
    found = anchors.select("key", "d").join(counts, "key")
    few = F.collect_set(F.when(~F.col("hot"), F.col("key")))
    return found.groupBy("d").agg(few.alias("few"), F.collect_set(F.when(F.col("hot"), F.col("key"))).alias("many"))


def _keys(column: pa.Array, a: int, b: int) -> np.ndarray:
    return np.unique(np.asarray(column.slice(a, b - a).flatten(), dtype=np.int64))


_SEGMENT = "route long, c1 long, c2 long, d long, h long, start long, words binary"


def _segments(keyed: DataFrame, window: int) -> DataFrame:
    """Candidate segments; equal ones of a pass are combined to the earliest."""

    def run(batches):
        for batch in batches:
            ids = np.array(batch.column(0))
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets):
                few, many = _keys(batch.column(2), a, b), _keys(batch.column(3), a, b)
                if not len(few) and not len(many):
                    continue
                p = _Pass(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
                hot = p.candidates(many)
                at = np.flatnonzero(p.candidates(few) | hot)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (p.anchor[at][1:] != p.anchor[at][:-1]) | hot[at[1:]]
                head = np.flatnonzero(new)
                begin, size = at[head], np.diff(np.append(head, len(at))) + window - 1
                total = np.concatenate([[0], np.cumsum(size)])
                flat = p.h[ragged(begin, size)]
                place = (np.arange(len(flat)) - np.repeat(total[:-1], size)).astype(np.uint64)
                c1, c2 = (np.add.reduceat(mix(flat * U64(m) + place * U64(0x9E3779B97F4A7C15)), total[:-1]).view(np.int64) for m in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
                doc = p.doc[begin]
                h, start = p.digests()[doc], begin - p.heads[:-1][doc]
                order = np.lexsort((start, h, ids[a:b][doc], c2, c1))
                first = order[np.append(True, (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1]))]
                route = np.where(hot[begin], c1, p.key[begin])
                data = flat.view(np.uint8).reshape(-1, 8)[:, :WORD].tobytes()
                yield pa.record_batch(
                    [*(pa.array(x[first]) for x in (route, c1, c2, ids[a:b][doc], h, start)), pa.array([data[WORD * total[i] : WORD * total[i + 1]] for i in first.tolist()], pa.binary())],
                    names=["route", "c1", "c2", "d", "h", "start", "words"],
                )

    return keyed.mapInArrow(released(run), _SEGMENT)


def _sequence(body: bytes) -> list[int]:
    out = np.zeros((len(body) // WORD, 8), np.uint8)
    out[:, :WORD] = np.frombuffer(body, np.uint8).reshape(-1, WORD)
    return out.reshape(-1).view(np.int64).tolist()


class Automaton:
    """Suffix automaton of the sequences put in so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the suffixes of q that end p's transition, made by copying q."""
        clone = len(self.length)
        self.next.append(self.next[q].copy())
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def put(self, sequence: list[int]) -> list[int]:
        """Add a sequence; for each place, the length of the longest suffix there that had occurred before."""
        out, last = [], 0
        following, link, length = self.next, self.link, self.length
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._split(last, q, c)
                last = q
                out.append(length[q])
                continue
            new = len(length)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = new
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new
            out.append(length[link[new]])
        return out


def _fresh(segments: DataFrame, window: int) -> DataFrame:
    """d, h, start, n: runs of candidate windows that do not start earlier."""
    first = segments.groupBy("route", "c1", "c2").agg(F.min(F.struct("d", "h", "start", "words")).alias("s"))
    dealt = first.select("route", "s.*").repartition(partitions(segments), "route").sortWithinPartitions("route", "d", "h", "start")

    def shard(held: list[tuple]) -> list[tuple]:
        if len(held) == 1:  # windows of one segment differ
            d, h, start, body = held[0]
            return [(d, h, start, len(body) // WORD - window + 1)]
        automaton, rows = Automaton(), []
        for d, h, start, body in held:
            seen = np.array(automaton.put(_sequence(body))[window - 1 :]) >= window
            edge = np.flatnonzero(np.diff(np.concatenate([[1], seen, [1]])))
            rows += [(d, h, start + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
        return rows

    def run(batches):
        now, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for route, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if route != now:
                    if held:
                        out += shard(held)
                    now, held = route, []
                held.append(row)
            yield table(out)
        yield table(shard(held) if held else [])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["d", "h", "start", "n"])

    return dealt.mapInArrow(released(run), "d long, h long, start long, n long")


def _kept(batch: pa.RecordBatch, window: int):
    """For each pass of a batch with d, t, few, many, fresh: rows a to b, the pass, and which of its words are removed."""
    body, offsets = raw(batch.column(1))
    for a, b in passes(offsets):
        p = _Pass(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window)
        gone = np.zeros(len(p.h), bool)
        keys = np.concatenate([_keys(batch.column(i), a, b) for i in (2, 3)])
        if len(keys):
            repeated = p.candidates(keys)
            digests = p.digests()
            for i, spans in enumerate(batch.column(4).slice(a, b - a).to_pylist()):
                for s in spans or ():
                    if s["h"] == digests[i]:
                        at = p.heads[i] + s["start"]
                        repeated[at : at + s["n"]] = False
            edge = np.zeros(len(p.h) + 1, np.int32)
            at = np.flatnonzero(repeated)
            edge[at] += 1
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
        yield a, b, p, gone


def _joined(p: _Pass, gone: np.ndarray) -> tuple[memoryview, list[int]]:
    """Kept words with a blank after each, and the bounds of the texts."""
    left = np.flatnonzero(~gone)
    size = p.ends[left] - p.starts[left]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 32, np.uint8)
    out[ragged(at[:-1], size)] = p.body[ragged(p.starts[left], size)]
    return memoryview(out), at[np.concatenate([[0], np.cumsum(~gone)])[p.heads]].tolist()


def _located(docs: DataFrame, window: int, extra: tuple = ()) -> DataFrame:
    """d, t, few, many, fresh and extra columns of every row.

    Documents without repeated anchors, but for the few that pass a filter of fixed size, are not shuffled.
    """
    prepared = docs.select(lowest_id().alias("d"), F.col("text").cast("string").alias("t"), *extra)
    with Tables(docs.sparkSession) as tables:
        keys = tables.keep(_repeated(_prepared(docs), window))
        bits = id_filter(keys, "d")
        keyed = prepared.filter(may_hold(bits, "d")).join(keys.hint("merge"), "d", "left")
        fresh = tables.keep(_fresh(_segments(keyed.select("d", "t", "few", "many"), window), window).groupBy("d").agg(F.collect_list(F.struct("h", "start", "n")).alias("fresh")))
    alone = prepared.filter(~may_hold(bits, "d")).withColumns({c: F.lit(None).cast("array<long>") for c in ("few", "many")})
    alone = alone.withColumn("fresh", F.lit(None).cast(fresh.schema["fresh"].dataType))
    every = keyed.join(fresh.hint("merge"), "d", "left").unionByName(alone)
    return every.select("d", "t", "few", "many", "fresh", *[c for c in every.columns if c == "row"])


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def run(batches):
        for batch in batches:
            for a, b, p, gone in _kept(batch, window):
                text, at = _joined(p, gone)
                digests = [hashlib.sha256(text[x : max(x, y - 1)]).hexdigest() for x, y in zip(at[:-1], at[1:])]
                lost = np.concatenate([[0], np.cumsum(gone)])[p.heads]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(p.heads)), pa.array(np.diff(lost)), pa.array(digests, pa.string())], names=["d", "n_words", "n_removed", "kept_sha256"])

    out = _located(docs, window).mapInArrow(released(run), "d long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("d") != LOWEST, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def rewrite(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; a text that loses words becomes its kept words joined by one blank."""

    def run(batches):
        for batch in batches:
            for a, b, p, gone in _kept(batch, window):
                text, at = _joined(p, gone)
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[p.heads]).tolist()
                old = batch.column(1).slice(a, b - a).to_pylist()
                texts = [bytes(text[x : max(x, y - 1)]).decode() if n else t for x, y, n, t in zip(at[:-1], at[1:], lost, old)]
                yield pa.record_batch([batch.column(5).slice(a, b - a), pa.array(texts, pa.string())], names=["row", "new_text"])

    located = _located(docs, window, (F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),))
    out = located.mapInArrow(released(run), T.StructType([T.StructField("row", located.schema["row"].dataType), T.StructField("new_text", T.StringType())]))
    return out.select(*[F.col("new_text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def oracle_sql(window: int = WINDOW) -> str:
    """All windows as texts; for small tables."""
    return f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a FROM documents),
starts AS (SELECT doc_id, a, unnest(range(1, len(a) - {window - 2})) AS s FROM w WHERE len(a) >= {window}),
windows AS (SELECT doc_id, s, array_to_string(a[s:s + {window - 1}], ' ') AS k FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {window})) AS i FROM later),
words AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w)
SELECT w.doc_id, len(w.a)::BIGINT AS n_words, count(gone.i) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY w.doc_id, len(w.a)"""
