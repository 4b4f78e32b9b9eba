"""MinHash near-duplicate groups, confirmed on full shingle sets.

1. Every whole text becomes its set of word shingles (64-bit hashes), the set's 128-bit digest and its signature: the
   minima of many universal hash functions.
2. Texts with equal sets form a class; only the class's smallest id goes on, so exact copies cost one row each.
3. Signatures are cut into bands. Members of a bucket are tied to a few leaders of the bucket (its least id and the
   least under some permutations): as many candidate pairs as members, whatever the bucket's size.
4. Candidate pairs are verified on signatures with a generous margin, and large-star and small-star give candidate
   clusters. In a bucket that holds several clusters, every member outside its largest one then meets every member of
   the others whose number of shingles allows a link; pairs within the margin unite their clusters. So each pair that
   shares a bucket is in one cluster or was compared. Links hold only inside clusters.
5. Each cluster's full sets meet once: a search from member to member over the members not yet reached finds exactly the
   linked groups, and emits a spanning edge for each member it reaches. A cluster whose sets exceed a bound is cut into
   salted blocks, and every pair of blocks meets in a task of its own, so no task holds an unbounded group.
6. Large-star and small-star over the confirmed edges give the components.

Defined results: null texts and texts without words have no shingles, belong to no class and are linked with nothing;
texts with fewer words than a shingle have one shingle, the whole sequence; rows with one doc_id count as one document in
links, whichever of their texts is linked (each row is returned); rows with a null doc_id are returned unlinked; an empty
table gives an empty table; other columns are ignored. ``one_of_each`` keeps one row of each group, of repeated rows
(equal in doc_id and set) and of rows without doc_id and with equal sets, if no document with a doc_id has that set.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables
from .common import LOWEST, U64, doc_texts, gram_hashes, id_filter, lower_ascii, lowest_id, may_hold, mix, partitions, passes, raw, released, word_hashes, words
from .components import connected_components

#: Shingles of a cluster that meet in one task, at most.
BLOCK = 4_000_000
#: Leaders of a bucket besides its least id.
LEADERS = 3
#: Members of a bucket with several clusters that meet in one task, at most: those outside its largest cluster, and all.
FEW, MANY = 4096, 16384
#: Signature estimates may fall short of the threshold by so much in step 4.
MARGIN = 0.25


def shingle_sets(body: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of consecutive texts and their bounds."""
    starts, ends, heads = words(body, offsets)
    h = word_hashes(body, starts, ends)
    grams = gram_hashes(h, k)
    parts = []
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        if b - a >= k:
            parts.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            parts.append(gram_hashes(h[a:b], b - a, seed=b - a))
        else:
            parts.append(h[:0])
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else h[:0]), bounds


def signatures(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Upper halves of the minima of ``size`` functions a * x + b modulo 2**64; all ones for an empty set."""
    r = np.random.default_rng(977)
    a, b = r.integers(0, 1 << 63, size, dtype=np.uint64) * U64(2) + U64(1), r.integers(0, 1 << 63, size, dtype=np.uint64)
    out = np.full((len(bounds) - 1, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        held = np.empty_like(shingles)
        for j in range(size):
            np.multiply(shingles, a[j], out=held)
            np.add(held, b[j], out=held)
            out[full, j] = np.minimum.reduceat(held, bounds[full]) >> U64(32)
    return out


def _digests(shingles: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    out = []
    for odd in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles * U64(odd)))])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out


def sketch(docs: DataFrame, k: int, size: int) -> DataFrame:
    """doc_id, n (shingles), s1, s2 (digest of the set), sig (binary)."""

    def run(batches):
        for batch in batches:
            body, offsets = raw(batch.column(1))
            for a, b in passes(offsets):
                shingles, bounds = shingle_sets(lower_ascii(body[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], k)
                s1, s2 = _digests(shingles, bounds)
                sig = [x.tobytes() for x in signatures(shingles, bounds, size)]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary())], names=["doc_id", "n", "s1", "s2", "sig"])

    return doc_texts(docs).mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, sig binary")


def _bands(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """key and id: one row for each band of every signature."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            body, _ = raw(batch.column(1))
            sig = np.frombuffer(body.tobytes(), np.uint32).reshape(n, -1)[:, : bands * rows].reshape(n, bands, rows).astype(np.uint64)
            key = np.arange(1, bands + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + np.zeros((n, 1), np.uint64)
            for j in range(rows):
                key = mix(key ^ sig[:, :, j]) * U64(0xC2B2AE3D27D4EB4F)
            ids = np.repeat(np.array(batch.column(0)), bands)
            yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(released(run), "key long, id long")


def _shared(bands: DataFrame) -> DataFrame:
    """key, id and leaders: the members of buckets with more than one row."""
    held = [F.min_by("id", F.xxhash64("id", F.lit(s))) for s in range(LEADERS)]
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.array(F.min("id"), *held).alias("leaders")).filter("n > 1").select("key", "leaders")
    return bands.join(buckets, "key")


def _stars(shared: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u > v, of members and leaders of buckets."""
    pairs = shared.select("id", F.explode(F.array_distinct("leaders")).alias("leader")).filter("id <> leader")
    return pairs.select(F.greatest("id", "leader").alias("u"), F.least("id", "leader").alias("v")).distinct()


def _low(reps: DataFrame) -> DataFrame:
    """id, n and low: one byte of each place of the signature."""

    def narrow(batches):
        for batch in batches:
            body, _ = raw(batch.column(2))
            sig = np.ascontiguousarray(np.frombuffer(body.tobytes(), np.uint32).reshape(batch.num_rows, -1).astype(np.uint8))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in sig], pa.binary())], names=["id", "n", "low"])

    return reps.select("id", "n", "sig").mapInArrow(released(narrow), "id long, n long, low binary")


def _share(agree: np.ndarray) -> np.ndarray:
    """Estimated similarity by the share of places whose bytes agree."""
    return (agree - 1 / 256) / (1 - 1 / 256)


def _estimated(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in at least that share of places, by one byte of each place."""

    def compare(batches):
        for batch in batches:
            a, b = (np.frombuffer(raw(batch.column(i))[0].tobytes(), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            share = _share((a == b).mean(1)) if batch.num_rows else np.zeros(0)
            keep = pa.array(share >= least)
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    low = _low(reps).drop("n")
    both = pairs.join(low.withColumnsRenamed({"id": "u", "low": "lu"}), "u").join(low.withColumnsRenamed({"id": "v", "low": "lv"}), "v")
    return both.select("u", "v", "lu", "lv").mapInArrow(released(compare), "u long, v long")


def united(side: np.ndarray, n: np.ndarray, cluster: np.ndarray, low: np.ndarray, least: float, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning edges between clusters with a pair of members that may be linked, one of them with side >= 2, the other odd."""
    num, den = share
    right = np.flatnonzero(side & 1)
    right = right[np.argsort(n[right], kind="stable")]
    size, body = n[right], low[right]
    names, label = np.unique(cluster, return_inverse=True)
    group = np.arange(len(names))
    edges = []
    for i in np.flatnonzero(side >= 2).tolist():
        # Sets whose sizes differ by more than the threshold can't be linked.
        a, b = np.searchsorted(size * den, num * n[i], "left"), np.searchsorted(size * num, den * n[i], "right")
        own = group[label[i]]
        near = a + np.flatnonzero(group[label[right[a:b]]] != own)
        if len(near):
            hit = label[right[near[_share((body[near] == low[i]).mean(1)) >= least]]]
            for other in np.unique(group[hit]).tolist():
                edges.append((int(names[own]), int(names[other])))
                group[group == other] = own
    return edges


def _between(shared: DataFrame, clusters: DataFrame, reps: DataFrame, least: float, share: tuple[int, int]) -> DataFrame:
    """Edges (u, v) between clusters that meet in a bucket and have a pair of members within the margin there."""
    placed = shared.select("key", "id").join(clusters, "id", "left").select("key", "id", F.coalesce("cluster", "id").alias("cluster"))
    parts = placed.groupBy("key", "cluster").agg(F.count("*").alias("n"))
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "cluster")).alias("most"), F.count("*").alias("c")).filter("c > 1")
    few, many = F.ceil((F.col("n") - F.col("most.n")) / FEW).cast("int"), F.ceil(F.col("n") / MANY).cast("int")
    buckets = buckets.select("key", F.col("most.cluster").alias("most"), few.alias("few"), many.alias("many"))
    i, j = (F.pmod(F.xxhash64("id", F.lit(s)), F.col(x)).cast("int") for s, x in ((5, "few"), (6, "many")))
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    minor = F.col("cluster") != F.col("most")
    rights = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda x: at(x, F.col("own_j"), 1))
    lefts = F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda x: at(F.col("own_i"), x, 2))
    meets = F.when((F.col("few") == 1) & (F.col("many") == 1), F.array(F.when(minor, at(F.lit(0), F.lit(0), 3)).otherwise(at(F.lit(0), F.lit(0), 1)))).otherwise(
        F.when(minor, F.concat(rights, lefts)).otherwise(rights)
    )
    dealt = placed.join(buckets, "key").withColumns({"own_i": i, "own_j": j}).select("key", "id", "cluster", F.explode(meets).alias("at"))
    dealt = dealt.select("key", "at.i", "at.j", "at.side", "cluster", "id").join(_low(reps), "id").select("key", "i", "j", "side", "n", "cluster", "low")

    def meet(batches):
        held: list[tuple] = []
        now = None

        def close():
            side, n, cluster = (np.array(x, np.int64) for x in list(zip(*held))[:3])
            low = np.frombuffer(b"".join(x[3] for x in held), np.uint8).reshape(len(held), -1)
            us, vs = zip(*found) if (found := united(side, n, cluster, low, least, share)) else ((), ())
            return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(x).to_pylist() for x in range(7))):
                if (key, i, j) != now:
                    if len(held) > 1:
                        yield close()
                    held, now = [], (key, i, j)
                held.append(row)
        if len(held) > 1:
            yield close()

    return dealt.repartition(partitions(shared), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(released(meet), "u long, v long")


def linked(ids: np.ndarray, shingles: np.ndarray, bounds: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Spanning edges of the exact links among sets: den * |both| >= num * |either|, each member reached once."""
    num, den = share
    n = len(ids)
    _, codes = np.unique(shingles, return_inverse=True)
    size = np.diff(bounds)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int32)
    left = np.arange(n)
    parts = [codes[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    edges, seen_size = [], size.copy()
    while len(left):
        queue = deque([int(left[0])])
        left = left[1:]
        stale = True
        while queue and len(left):
            if stale:
                flat = np.concatenate([parts[i] for i in left])
                heads = np.concatenate([[0], np.cumsum(seen_size[left])[:-1]])
                stale = False
            i = queue.popleft()
            mark[parts[i]] = 1
            common = np.add.reduceat(mark[flat], heads)
            mark[parts[i]] = 0
            hit = den * common.astype(np.int64) >= num * (size[i] + size[left] - common)
            if hit.any():
                got = left[hit].tolist()
                edges += [(int(ids[i]), int(ids[j])) for j in got]
                queue.extend(got)
                left, stale = left[~hit], True
    return edges


def _confirmed(docs: DataFrame, members: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Spanning edges of the exact links inside clusters. members: id, n, cluster."""
    blocks = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    blocks = blocks.select("cluster", F.ceil(F.col("total") / BLOCK).cast("int").alias("g"))
    salt = F.pmod(F.xxhash64("id", F.lit(5)), F.col("g")).cast("int")
    meets = F.when(F.col("g") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda t: F.struct(F.least(t, F.col("salt")).alias("i"), F.greatest(t, F.col("salt")).alias("j")))
    )
    placed = members.join(blocks, "cluster").withColumn("salt", salt).select("id", "cluster", F.explode(meets).alias("at")).select("id", "cluster", "at.i", "at.j")

    def sets(batches):
        for batch in batches:
            body, offsets = raw(batch.column(4))
            for a, b in passes(offsets):
                shingles, bounds = shingle_sets(lower_ascii(body[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], k)
                data, at = shingles.tobytes(), (8 * bounds).tolist()
                yield pa.record_batch([*(batch.column(i).slice(a, b - a) for i in range(4)), pa.array([data[x:y] for x, y in zip(at[:-1], at[1:])], pa.binary())], names=["cluster", "i", "j", "id", "shingles"])

    def meet(batches):
        held: list[tuple] = []
        now = None

        def close():
            ids, bodies = zip(*dict.fromkeys(held))  # one doc_id may have several sets
            bounds = np.concatenate([[0], np.cumsum([len(x) // 8 for x in bodies])]).astype(np.int64)
            edges = linked(np.array(ids), np.frombuffer(b"".join(bodies), np.uint64), bounds, share) if len(ids) > 1 else []
            us, vs = zip(*edges) if edges else ((), ())
            return pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for batch in batches:
            for c, i, j, doc, body in zip(*(batch.column(x).to_pylist() for x in range(5))):
                if (c, i, j) != now:
                    if len(held) > 1:
                        yield close()
                    held, now = [], (c, i, j)
                held.append((doc, body))
        if len(held) > 1:
            yield close()

    kind = "cluster long, i int, j int, id long, shingles binary"
    # Texts of no cluster are left out by a filter of fixed size before any text is shuffled.
    texts = doc_texts(docs).filter("doc_id is not null").withColumnRenamed("doc_id", "id")
    texts = texts.filter(may_hold(id_filter(members, "id"), "id")).join(placed.hint("merge"), "id").select("cluster", "i", "j", "id", "text").mapInArrow(released(sets), kind)
    return texts.repartition(partitions(docs), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").mapInArrow(released(meet), "u long, v long")


def _grouped(tables: Tables, docs: DataFrame, k: int, share: tuple[int, int], bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Tables of the run: doc_id, n, s1, s2 of every row; and with component, the least doc_id reachable, of every set."""
    sketched = tables.settle(sketch(docs, k, bands * rows))
    known = sketched.filter("n > 0 and doc_id is not null")
    classes = tables.settle(known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep")))
    alone = classes.select(F.col("rep").alias("doc_id"), "n", "s1", "s2")
    reps = known.join(alone, ["doc_id", "n", "s1", "s2"], "left_semi").select(F.col("doc_id").alias("id"), "n", "sig")
    least = share[0] / share[1] - MARGIN
    shared = tables.settle(_shared(_bands(reps, bands, rows)))
    named = lambda edges: connected_components(edges, tables).withColumnsRenamed({"node": "id", "component": "cluster"})
    clusters = named(_estimated(_stars(shared), reps, least))
    clusters = named(clusters.toDF("u", "v").union(_between(shared, clusters, reps, least, share)))
    tables.drop(shared)
    members = tables.settle(reps.select("id", "n").join(clusters, "id"))
    # Rows of one doc_id are one document: the classes it belongs to are linked through it.
    through = known.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id").join(known, "doc_id").join(classes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    edges = _confirmed(docs, members, k, share).union(through.filter("u <> v"))
    components = connected_components(edges, tables).withColumnRenamed("node", "rep")
    return sketched.select("doc_id", "n", "s1", "s2"), classes.join(components, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def near_duplicates(docs: DataFrame, k: int = 3, share: tuple[int, int] = (85, 100), bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Bands of 24 x 5 miss a pair at the threshold 0.85 with a chance below 1e-6; take more and shorter bands for lower
    thresholds (30 x 4 at 0.8: below 1e-6).
    """
    with Tables(docs.sparkSession) as tables:
        every, sets = _grouped(tables, docs, k, share, bands, rows)
        component = F.coalesce("component", "doc_id")
        out = every.join(sets, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
        return tables.keep(out)


def one_of_each(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), bands: int = 30, rows: int = 4) -> DataFrame:
    """The documents, with all their columns, without those that belong to a group with a smaller doc_id."""
    spark = docs.sparkSession
    named = docs.select(lowest_id().alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    with Tables(spark) as tables:
        every, sets = _grouped(tables, docs, k, share, bands, rows)
        found = every.filter("doc_id is not null").join(sets, ["n", "s1", "s2"])
        dropped = tables.keep(found.filter("doc_id <> component").select(F.col("doc_id").alias("d")).distinct())
        # Rows that share a doc_id, or have none, are told apart by their sets; there are few of them, if any.
        again = tables.keep(every.groupBy(F.coalesce("doc_id", F.lit(LOWEST)).alias("d")).agg(F.count("*").alias("c")).filter(f"c > 1 or d = {LOWEST}").select("d"))
        single = named.join(dropped, "d", "left_anti")
        if again.isEmpty():
            return single.select("row.*")
        several = tables.settle(single.join(again, "d", "left_semi").withColumn("at", F.monotonically_increasing_id()))
        told = sketch(several.select(F.col("at").alias("doc_id"), F.col("row.text").alias("text")), k, 1).withColumnRenamed("doc_id", "at")
        told = several.select("d", "at").join(told, "at").join(sets.select("n", "s1", "s2", F.lit(True).alias("held")), ["n", "s1", "s2"], "left")
        told = told.filter((F.col("d") != LOWEST) | F.col("held").isNull())
        first = told.groupBy("d", "n", "s1", "s2").agg(F.min("at").alias("at"))
        return single.join(again, "d", "left_anti").select("row.*").unionByName(tables.keep(several.join(first.select("at"), "at", "left_semi").select("row.*")))


def oracle_sql(k: int = 3, share: tuple[int, int] = (85, 100)) -> str:
    """All pairs that share a shingle, and what each document reaches; for small tables."""
    num, den = share
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS a FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(a[s:s + {k - 1}], ' ') AS g
  FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - {k - 2}, 2))) AS s FROM w WHERE len(a) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE {den} * c >= {num} * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.b, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(least.b, w.doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.a = w.doc_id"""
