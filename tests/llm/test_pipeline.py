"""The pipeline: its stages in order, each against a plain version of its own input; queries with SQL against DuckDB."""

import gc
import os
import shutil
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearweave.llm import common, lines, minhash, queries, substring
from nearweave.llm.common import materialise

from nearweave.plans import tables

from . import brute


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "substring_dedup", "concat_and_cut"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = materialise(steps["quality_classifier"](spark, docs, sf_dir))
    assert kept.columns == columns and 0.7 < kept.count() / docs.count() < 1
    before = rows(kept)

    lined = materialise(steps["line_dedup"](spark, kept, sf_dir))
    gone = brute.line_removals(before.items())
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in before.items()}
    assert lined.columns == columns and rows(lined) == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = materialise(steps["minhash_near_dedup"](spark, lined, sf_dir))
    groups = brute.groups(want.items(), 5, 80, 100)
    assert single.columns == columns and rows(single) == {i: t for i, t in want.items() if groups[i][1] == i}

    before = rows(single)
    cut = materialise(steps["substring_dedup"](spark, single, sf_dir))
    repeats = brute.repeats(before.items())
    assert cut.columns == columns and all(len(brute.words(t)) == repeats[i][0] - repeats[i][1] for i, t in rows(cut).items())

    packed = steps["concat_and_cut"](spark, cut, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, a missing id, a repeated row, empty and long texts, and columns with names that operators use inside."""
    docs = materialise(brute.documents(spark).withColumn("_dropped", F.lit(1)).withColumn("at", F.lit("x")))
    texts, none = dict(brute.corpus()), docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, sf_dir).count() == 0
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        assert out.columns == docs.columns and all(r.row == "row" and r._dropped == 1 for r in rows)
        got = sorted((r.doc_id, r.text) for r in rows if r.doc_id is not None)
        if name == "quality_classifier":
            assert {i for i, _ in got} < set(texts) and all(texts[i] == t for i, t in got)
        if name == "line_dedup":
            gone = brute.line_removals(texts.items())
            want = {i: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) for i, t in texts.items()}
            assert sorted(got, key=str) == sorted([*want.items(), (3, want[3])], key=str)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
        if name == "minhash_near_dedup":
            groups = brute.groups(list(texts.items()), 5, 80, 100)
            assert [i for i, _ in got] == sorted(i for i, (_, c) in groups.items() if c == i)
            assert sum(r.doc_id is None for r in rows) == 1
        if name == "substring_dedup":
            repeats = brute.repeats(texts.items())
            assert all(len(brute.words(t)) == repeats[i][0] - repeats[i][1] for i, t in got) and len(got) == len(texts) + 1
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, none, sf_dir).count() == 0
    assert {r.doc_id for r in pack(spark, docs, sf_dir).collect()} == {None, *texts}


def test_workers_hand_back_what_a_task_left():
    """Idle workers stay beside the next stage: blocks freed below one that is still held would stay in their heap."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    held = []

    def run(batches):
        for n in batches:
            blocks = [bytearray(b"x" * 60_000) for _ in range(n)]
            held.append(bytearray(b"y" * 60_000))
            yield len(blocks)

    before = resident()
    assert list(common.released(run)(iter([3000]))) == [3000]
    assert held and resident() < before + 60


def test_driver_hands_back_what_its_jvm_left(spark):
    """Buffers outside the Java heap, most of which are freed; the others keep their pages from going back by themselves."""
    jvm = spark._jvm
    pid = jvm.java.lang.management.ManagementFactory.getRuntimeMXBean().getName().split("@")[0]
    resident = lambda: int(open(f"/proc/{pid}/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(4000)]
    held = buffers[::50]
    del buffers
    gc.collect()
    for _ in range(4):
        time.sleep(0.5)
        jvm.System.gc()
    before = resident()
    tables._free_jvm_pages(spark)
    assert held and resident() < before - 100


def test_stages_deal_small_batches_to_workers(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    docs = brute.documents(spark, [(i, f"text number {i}") for i in range(20)])
    try:
        for given, want in ((held, corpus_pipeline.BATCH), (0, corpus_pipeline.BATCH), (7, 7)):
            spark.conf.set(key, given)
            out = corpus_pipeline.concat_and_cut(spark, docs, sf_dir)
            assert int(spark.conf.get(key)) == want and out.select("doc_id").distinct().count() == 20
    finally:
        spark.conf.set(key, held)


def test_operators_leave_nothing_but_what_their_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_root", lambda spark: str(tmp_path))
    docs = brute.documents(spark, [(i, f"a line of some words {i % 3}\nand the next one") for i in range(9)])
    for operator in (minhash.near_duplicates, lines.removal_digests, substring.removal_digests):
        out = operator(docs)
        assert out.count() == 9
        read = {f.rpartition("/")[0].removeprefix("file:").replace("///", "/") for f in out.inputFiles()}
        assert {str(p) for p in tmp_path.iterdir()} <= read
        for p in tmp_path.iterdir():
            shutil.rmtree(p)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf_dir}/{file}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(str([r[i] for i in order]) for r in want.fetchall()) == sorted(str(list(r)) for r in got.select(*columns).collect())
