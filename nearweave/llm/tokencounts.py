"""Token counts by separator scan over flat, unindexed token files.

A flat file is a stream of 16-bit ids in blocks of fixed size, documents one after the other, each closed by the
end-of-document id; nothing in it tells where a document starts. Each block is searched for the separator by one
vectorised comparison. Block summaries (number of separators, place of the last one) go through a prefix scan for each
file, which stitches documents that cross blocks; only these summaries and the separators' places are shuffled.
A list of the documents' names by their order in the file, without lengths, stands beside each file.

Defined results: a null or empty text has 0 tokens; repeated rows are counted each; an empty table gives an empty table;
a document may span any number of blocks; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec, text_passes
from .common import doc_texts, materialise

#: Ids of a block.
BLOCK = 1 << 18


def flat_files(docs: DataFrame, path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """file, block, ids (binary); rows with a negative block list the file's doc_ids (binary) in order instead.

    One file for each input partition. Ids are little-endian, unsigned, of two bytes: a vocabulary with larger ids is an
    error, and so is a text that holds end_id.
    """
    if not 0 <= end_id < 1 << 16:
        raise ValueError("flat files hold ids of two bytes")

    def run(batches):
        c, file = codec(path), TaskContext.get().partitionId()
        held, number, lists = np.zeros(0, np.uint16), 0, 0
        row = lambda k, ids, docs: pa.record_batch([pa.array([file], pa.int32()), pa.array([k], pa.int64()), pa.array([ids], pa.binary()), pa.array([docs], pa.binary())], names=["file", "block", "ids", "doc_ids"])
        for batch in batches:
            for texts in text_passes(batch.column(1)):
                ids, bounds, _, _ = c.encode(texts)
                if len(ids) and (ids.max() >= 1 << 16 or (ids == end_id).any()):
                    raise ValueError("an id doesn't fit into two bytes, or is the separator's")
                stream = np.full(len(ids) + len(texts), end_id, np.uint16)
                keep = np.ones(len(stream), bool)
                keep[bounds[1:] + np.arange(len(texts))] = False
                stream[keep] = ids
                held = np.concatenate([held, stream])
                while len(held) >= block:
                    yield row(number, held[:block].astype("<u2").tobytes(), None)
                    held, number = held[block:], number + 1
            if batch.num_rows:
                lists += 1
                named = [-1 if d is None else d for d in batch.column(0).to_pylist()]
                known = [d is not None for d in batch.column(0).to_pylist()]
                yield row(-lists, np.array(known, np.uint8).tobytes(), np.array(named, "<i8").tobytes())
        if len(held):
            yield row(number, held.astype("<u2").tobytes(), None)

    return doc_texts(docs).mapInArrow(run, "file int, block long, ids binary, doc_ids binary")


def separator_scan(blocks: DataFrame, end_id: int, block: int = BLOCK) -> DataFrame:
    """file, ordinal, n_tokens of every document of flat files with columns file, block and ids."""

    def run(batches):
        for batch in batches:
            places = []
            for number, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                places.append((np.flatnonzero(np.frombuffer(ids, "<u2") == end_id) + number * block).tolist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int64()))], names=["file", "block", "places"])

    found = blocks.select("file", "block", "ids").mapInArrow(run, "file int, block long, places array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file",
        F.coalesce(F.sum(F.size("places")).over(before), F.lit(0)).alias("ordinal_before"),
        F.concat(F.array(F.coalesce(F.max(F.element_at(F.when(F.size("places") > 0, F.col("places")), -1)).over(before), F.lit(-1).cast("long"))), F.col("places")).alias("marks"),
    )
    lengths = F.transform(F.slice("marks", 2, F.size("marks") - 1), lambda x, i: x - F.element_at("marks", i + 1) - 1)
    return stitched.select("file", "ordinal_before", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("ordinal_before") + F.col("i")).alias("ordinal"), "n_tokens")


def document_names(lists: DataFrame) -> DataFrame:
    """file, ordinal and doc_id from the lists that stand beside flat files."""

    def run(batches):
        for batch in batches:
            names = [[d if k else None for d, k in zip(np.frombuffer(x, "<i8").tolist(), y)] for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names, pa.list_(pa.int64()))], names=["file", "block", "names"])

    read = lists.select("file", "block", "doc_ids", "ids").mapInArrow(run, "file int, block long, names array<long>")
    before = Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    placed = read.select("file", "names", F.coalesce(F.sum(F.size("names")).over(before), F.lit(0)).alias("ordinal_before"))
    return placed.select("file", "ordinal_before", F.posexplode("names").alias("i", "doc_id")).select("file", (F.col("ordinal_before") + F.col("i")).alias("ordinal"), "doc_id")


def token_counts(docs: DataFrame, path: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, file, ordinal: write flat files to the shared folder, then scan them."""
    written = materialise(flat_files(docs, path, end_id, block))
    counts = separator_scan(written.filter("block >= 0"), end_id, block)
    return document_names(written.filter("block < 0")).join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal")
