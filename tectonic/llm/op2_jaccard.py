"""Near-duplicate documents by an n-gram Jaccard join with rare-first prefix filtering.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 80 %.

1. Every set is read once for its size and a 128-bit digest; documents with equal sets are one class
   (linked, similarity 1), represented by their smallest id. The same pass counts shingles in a hashed
   sketch of fixed size, summed over tasks; ``(count, hash)`` is the global order, rare first. The
   sketch decides speed only: any common order gives the same links.
2. A document indexes its prefix, the n - ceil(0.8 n) + 1 rarest of its n shingles: linked documents
   share a prefix shingle. Copies that a task has met already are not indexed again. Shingles that one
   document alone has in its prefix are dropped.
3. The join on prefix shingles keeps pairs that pass the length filter and the positional filter (what
   can still follow the common shingle must suffice), later also a suffix filter: each set has a parity
   bitmap, one bit per hash range, and two bitmaps differ in at most as many bits as the sets differ in
   shingles. A shingle's documents are not all paired. In each
   of a few rounds every document meets a pivot per seed, the least by a seeded hash of those its
   shingles' documents offer, unless both are in one component already; verified pairs merge components.
   Shingles whose documents are all in one component drop out.
4. The exact rest: all pairs of documents of different components that share a prefix shingle and pass
   the filters. The largest component of a shingle's documents meets the others only, and the others
   each other, so members of a large group are not compared among themselves and no link between
   components is lost.
5. A pair is verified once, by intersection of the two sets (48 bits of each hash), sent only if the
   bitmaps leave it possible.
6. The links: steps 3 and 4 find components, not all links, but every link lies within a component. A
   component's classes are dealt by size class (linked sets differ by one class at most) into chunks of
   bounded size, and each pair of chunks is a cell: one group, in which every pair of sets is intersected.
   A document's links are counted there, a linked class by its number of documents; no pair becomes a row.

The intermediate tables are written to the shared folder, so a lost executor repeats one step only.

Defined results: null, empty or blank text has no shingles, links with nothing, has a class of its own and
is its own component; equal texts are linked; equal ids are one node; rows with a null id are left out; further columns, whatever their names, are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forget_shuffles, materialize, release, table
from .shingles import WORDS, shingle_sets

#: Least similarity, as a fraction of integers.
SIMILAR = (80, 100)
SKETCH_BITS = 22      # 2**22 counters of 4 bytes: 16 MB, whatever the corpus
SKETCH_PARTS = 16
SENT_BYTES = 6        # of each hash in a set sent for verification
PARITY_BITS = 512
PARITY = [f"parity{i}" for i in range(PARITY_BITS // 64)]
#: Least documents and shingles that more than one chunk of a component's size class has on average.
CHUNK_DOCS, CHUNK_SHINGLES = 128, 1 << 18
#: Ratio of the bounds of a size class: above 1 / SIMILAR, so that linked sets are in the same or adjacent classes.
SIZE_CLASS = 1.26
#: Seeds of the rounds with pivots.
ROUNDS = ((0,), (1, 2, 3, 4))


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def _sizes_and_sketch(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, n, key) of documents and, with part >= 0, rows of the task's counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        any_row = False
        for batch in batches:
            n, keys, tops, held = np.zeros(len(batch), np.int64), [], [], 0
            for row, grams in shingle_sets(batch.column(1), k):
                n[row] = len(grams)
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                tops.append(grams >> np.uint64(64 - SKETCH_BITS))
                held += len(grams)
                if held > 1 << 18:
                    np.add.at(counts, np.concatenate(tops).astype(np.int64), 1)
                    tops, held = [], 0
            if held:
                np.add.at(counts, np.concatenate(tops).astype(np.int64), 1)
            any_row = any_row or len(batch) > 0
            none = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(keys, pa.binary()), pa.array(np.full(len(batch), -1, np.int32)), none],
                ["doc_id", "n", "key", "part", "counts"])
        if any_row:
            blocks = [zlib.compress(b.tobytes(), 1) for b in np.split(counts, SKETCH_PARTS)]   # mostly zero bytes
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.int64()), pa.nulls(SKETCH_PARTS, pa.binary()),
                 pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), pa.array(blocks, pa.binary())],
                ["doc_id", "n", "key", "part", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, part int, counts binary")


def _sum_sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters: SKETCH_PARTS rows of fixed size reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = np.frombuffer(zlib.decompress(raw.as_buffer()), np.int32)
                sums[part] = sums[part] + block if part in sums else block
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())], ["part", "counts"])

    summed = rows.repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, counts binary")
    total = np.zeros(1 << SKETCH_BITS, np.int32)
    width = len(total) // SKETCH_PARTS
    for row in summed.collect():
        total[row.part * width:(row.part + 1) * width] = np.frombuffer(row.counts, np.int32)
    return total


def _prefix_index(docs: DataFrame, sketch: np.ndarray, k: int) -> DataFrame:
    """(gram, doc_id, pos, n): every document's prefix in the global order."""
    share, of = SIMILAR
    shared = docs.sparkSession.sparkContext.broadcast(sketch.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.int32)
        met: set[bytes] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            rows, sizes, grams_out = [], [], []

            def flush():
                each = np.array([len(g) for g in grams_out], np.int64)
                ends = np.cumsum(each)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(grams_out).view(np.int64)), pa.array(np.repeat(ids[rows], each)),
                     pa.array((np.arange(ends[-1]) - np.repeat(ends - each, each)).astype(np.int32)),
                     pa.array(np.repeat(np.array(sizes, np.int32), each))], ["gram", "doc_id", "pos", "n"])

            held = 0
            for row, grams in shingle_sets(batch.column(1), k):
                n = len(grams)
                if not n:
                    continue
                key = xxhash.xxh3_128_digest(grams.tobytes())
                if key in met:
                    continue
                met.add(key)
                order = np.argsort(counts[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                prefix = n - -(-share * n // of) + 1
                rows.append(row)
                sizes.append(n)
                grams_out.append(grams[order[:prefix]])
                held += prefix
                if held > 1 << 17:
                    yield flush()
                    rows, sizes, grams_out, held = [], [], [], 0
            if held:
                yield flush()

    return docs.mapInArrow(run, "gram long, doc_id long, pos int, n int")


def _may_be_close(na, nb, bits_a, bits_b):
    """Suffix filter: whether sets of these sizes and parity bitmaps can be similar enough."""
    share, of = SIMILAR
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits_a, bits_b, strict=True)), F.lit(0))
    return (share + of) * (na + nb - apart) >= 2 * share * (na + nb)


def _passes(a: str, b: str, parity: bool = False):
    """Length, positional and, with parity bitmaps, suffix filter of two index rows of one shingle."""
    share, of = SIMILAR
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))   # with the common shingle itself
    enough = (of * F.least(na, nb) >= share * F.greatest(na, nb)) & ((share + of) * rest >= share * (na + nb))
    if parity:
        enough &= _may_be_close(na, nb, [f"{a}.{p}" for p in PARITY], [f"{b}.{p}" for p in PARITY])
    return enough


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, grams, parity bitmap) of the documents named."""
    shift = np.uint64(64 - int(math.log2(PARITY_BITS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, blobs, parity = [], [], []
            for _, grams in shingle_sets(batch.column(1), k):
                n.append(len(grams))
                odd = np.bincount((grams >> shift).astype(np.int64), minlength=PARITY_BITS) & 1
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                blobs.append(grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT_BYTES].tobytes())
            bitmaps = np.array(parity, np.int64).reshape(-1, len(PARITY))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(blobs, pa.binary()),
                 *[pa.array(np.ascontiguousarray(b)) for b in bitmaps.T]], ["id", "n", "grams", *PARITY])

    wanted = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    return wanted.mapInArrow(run, "id long, n int, grams binary, " + ", ".join(f"{p} long" for p in PARITY))


def _close_enough(common: int, na: int, nb: int) -> bool:
    share, of = SIMILAR
    return of * common >= share * (na + nb - common)


def _both(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    out = pairs
    for side in ("a", "b"):
        out = out.join(sets.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return out.select("a", "b", *[f"{c}_{s}" for c in columns for s in "ab"])


def _hashes(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).reshape(-1, SENT_BYTES)
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, :SENT_BYTES] = parts
    return out.view(">u8").ravel().astype(np.uint64)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: suffix filter, then exact intersection."""
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = _hashes(x.as_buffer()), _hashes(y.as_buffer())
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(_close_enough(common, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    bits = _both(pairs, sets, "n", *PARITY)
    likely = bits.where(_may_be_close(F.col("n_a"), F.col("n_b"), [f"{p}_a" for p in PARITY], [f"{p}_b" for p in PARITY])).select("a", "b")
    return _both(likely, sets, "grams").mapInArrow(exact, "a long, b long")


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.where("id <> other").select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _pivot_pairs(active: DataFrame, seeds: tuple[int, ...]) -> DataFrame:
    """Per document and seed one pair with a pivot of another component, if any of its shingles has one."""
    bitmap = [p for p in PARITY if p in active.columns]
    drawn = [F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("draw"), "id", "pos", "n", "component", *bitmap)).alias(f"p{seed}") for seed in seeds]
    pivots = materialize(active.groupBy("gram").agg(*drawn), "pivots")   # a join side of its own: hot shingles split
    y = pivots.select("gram", F.explode(F.array(*[F.struct(F.lit(seed).alias("seed"), F.col(f"p{seed}").alias("p")) for seed in seeds])).alias("s"))
    y = y.select("gram", "s.seed", "s.p.*")
    x, y = active.alias("x"), y.alias("y")
    near = x.join(y, F.col("x.gram") == F.col("y.gram")).where((F.col("x.component") != F.col("y.component")) & _passes("x", "y", bool(bitmap)))
    best = near.groupBy("x.id", "seed").agg(F.min(F.struct("draw", F.col("y.id").alias("pivot"))).alias("best"))
    return _pairs(best.select("id", F.col("best.pivot").alias("other")))


def _mixed(live: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Index rows, with components and bitmaps, of the shingles whose documents are in several components."""
    placed = live.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = placed.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    return placed.join(materialize(spread, "mixed"), "gram").join(sets.select("id", *PARITY), "id")


def _rest_pairs(active: DataFrame) -> DataFrame:
    """All pairs of documents of different components that share a shingle and pass the filters."""
    sizes = active.groupBy("gram", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("gram").agg(F.max_by("component", F.struct("m", "component")).alias("largest"))
    marked = materialize(active.join(materialize(largest, "largest"), "gram"), "marked")
    most, others = marked.where("component = largest"), marked.where("component <> largest")
    x, y, z = most.alias("x"), others.alias("y"), others.alias("z")
    first = x.join(y, (F.col("x.gram") == F.col("y.gram")) & _passes("x", "y", True)).select("x.id", F.col("y.id").alias("other"))
    second = z.join(y, (F.col("z.gram") == F.col("y.gram")) & (F.col("z.component") < F.col("y.component")) & _passes("z", "y", True))
    return _pairs(first.unionByName(second.select("z.id", F.col("y.id").alias("other"))))


def _cells(nodes: DataFrame) -> DataFrame:
    """(cell, second, id, w) of nodes (id, component, n, w): every pair of nodes of a component whose sizes
    may be similar meets in one cell, once. In a cell of two chunks ``second`` tells them apart, in a cell of
    one chunk it is null."""
    sized = nodes.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_CLASS)).cast("int"))
    chunks = sized.groupBy("component", "size").agg(F.ceil(F.greatest(
        F.count("*") / F.lit(CHUNK_DOCS), F.sum(F.col("n").cast("long")) / F.lit(CHUNK_SHINGLES))).cast("int").alias("chunks"))
    chunks = materialize(chunks, "chunks")
    near = chunks.select("component", (F.col("size") - 1).alias("size"), F.col("chunks").alias("above"))
    near = chunks.join(near, ["component", "size"], "left")
    below = chunks.select("component", (F.col("size") + 1).alias("size"), F.col("chunks").alias("below"))
    near = materialize(near.join(below, ["component", "size"], "left"), "chunks")
    placed = sized.join(near, ["component", "size"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def many(n, cell):
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>")), cell)

    def cell(size, i, j, across, second):
        return F.struct(size.alias("size"), i.alias("i"), j.alias("j"), F.lit(across).alias("across"), second.alias("second"))

    own, size = F.col("chunk"), F.col("size")
    cells = F.concat(
        many(F.col("chunks"), lambda c: cell(size, F.least(own, c), F.greatest(own, c), False, F.when(own != c, own > c))),
        many(F.coalesce("above", F.lit(0)), lambda c: cell(size, own, c, True, F.lit(False))),
        many(F.coalesce("below", F.lit(0)), lambda c: cell(size - 1, c, own, True, F.lit(True))))
    return placed.select("component", "id", "w", F.explode(cells).alias("c")).select("component", "c.*", "id", "w")


def _cell_counts(cell: pa.Table) -> pa.Table:
    """(id, links): for every document of a cell the weights of those linked with it there."""
    share, of = SIMILAR
    second = cell.column("second")
    halves = [slice(None)] * 2 if second.null_count else [second.to_numpy() == flag for flag in (False, True)]
    ids, w = cell.column("id").to_numpy(), cell.column("w").to_numpy()
    rows = [np.arange(len(ids))[half] for half in halves]
    rows = [r[np.unique(ids[r], return_index=True)[1]] for r in rows]       # repeated rows of one id: one node
    if not len(rows[0]) or not len(rows[1]):
        return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    grams = [_hashes(g.as_buffer()) for g in cell.column("grams")]
    sizes = np.array([len(g) for g in grams], np.int64)
    known, place = np.unique(np.concatenate(grams), return_inverse=True)
    place = np.split(place, np.cumsum(sizes)[:-1])
    others = np.concatenate([place[r] for r in rows[1]])
    starts = np.cumsum(sizes[rows[1]]) - sizes[rows[1]]
    links, held = np.zeros(len(ids), np.int64), np.zeros(len(known), np.int32)
    for r in rows[0]:
        held[place[r]] = 1
        common = np.add.reduceat(held[others], starts).astype(np.int64)
        held[place[r]] = 0
        close = (of * common >= share * (sizes[r] + sizes[rows[1]] - common)) & (ids[rows[1]] != ids[r])
        links[r] += w[rows[1][close]].sum()
        if not second.null_count:
            links[rows[1][close]] += w[r]
    named = np.union1d(*rows)
    return pa.table({"id": pa.array(ids[named]), "links": pa.array(links[named])})


def _link_counts(comp: DataFrame, sets: DataFrame, members: DataFrame) -> DataFrame:
    """(id, links): the number of documents of other classes that every class with any is linked with."""
    weights = members.distinct().groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("m"))
    sizes = sets.groupBy("id").agg(F.first("n").alias("n"))
    nodes = comp.join(sizes, "id").join(weights, "id", "left").select("id", "component", "n", F.coalesce("m", F.lit(1)).alias("w"))
    cells = _cells(materialize(nodes, "nodes")).join(sets.select("id", "grams"), "id")
    counts = cells.groupBy("component", "size", "i", "j", "across").applyInArrow(_cell_counts, "id long, links long")
    return materialize(counts.groupBy("id").agg(F.sum("links").alias("links")), "link-counts")


def _joined(docs: DataFrame, k: int, id_col: str, text_col: str, links_too: bool) -> DataFrame:
    docs = _inputs(docs, id_col, text_col)
    first = materialize(_sizes_and_sketch(docs, k), "sets")
    meta = first.where("part < 0").select("doc_id", "n", "key")
    sketch = _sum_sketch(first.where("part >= 0").select("part", "counts"))

    # documents with equal sets: one class, represented by its smallest id
    full = meta.where("n > 0")
    classes = materialize(full.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1")
                          .select("key", "rep"), "classes")
    members = materialize(full.join(classes, "key").select("doc_id", "rep"), "members")

    index = materialize(_prefix_index(docs, sketch, k), "prefixes")
    shared = materialize(index.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "shared")
    live = index.join(shared, "gram").join(members.distinct(), "doc_id", "left")
    live = live.groupBy("gram", F.coalesce("rep", "doc_id").alias("id")).agg(F.first("pos").alias("pos"), F.first("n").alias("n"))
    live = materialize(live, "live")
    for done in (index, shared):
        release(done)

    sets = materialize(_sets(docs, live.select("id").distinct(), k), "shingle-sets")
    del index, shared, full, classes
    forget_shuffles(docs.sparkSession)

    # rounds with pivots
    links = tried = None
    active = live.withColumn("component", F.col("id"))
    for seeds in ROUNDS:
        pairs = materialize(_pivot_pairs(active, seeds), "pairs")
        found = materialize(_verify(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), sets), "links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        comp = materialize(components(links), "components")
        active = materialize(_mixed(live, comp, sets), "active")
        forget_shuffles(docs.sparkSession)
        if not active.take(1):
            break
    release(live)

    cross = materialize(_rest_pairs(active).join(tried.distinct(), ["a", "b"], "left_anti"), "cross")
    more = materialize(_verify(cross, sets), "links")
    release(active)
    if not links_too:
        release(sets)
    comp = materialize(components(links.unionByName(more)), "components")
    forget_shuffles(docs.sparkSession)

    # a document's class, the class's component
    named = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    by_class = meta.join(named, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    result = by_class.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    size, component = F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    if not links_too:
        return result.select("doc_id", size, component)
    counts = _link_counts(comp, sets, members)
    release(sets)
    alike = members.distinct().groupBy("rep").agg((F.count("*") - 1).alias("alike"))
    result = result.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(alike, "rep", "left")
    return result.select("doc_id", size, F.col("rep").alias("class_id"),
                         (F.coalesce("links", F.lit(0)) + F.coalesce("alike", F.lit(0))).alias("n_links"), component)


def similar_documents(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of every document's set and the smallest id that its
    links reach."""
    return _joined(docs, k, id_col, text_col, links_too=False)


def similarity_join(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, n_links, component_id): also the smallest id of an equal set and the
    number of other documents that the document is linked with, equal sets included."""
    return _joined(docs, k, id_col, text_col, links_too=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))
