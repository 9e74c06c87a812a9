"""Ranked lexical search: every document is scanned by an automaton of all item terms.

The distinct terms of the items, each between two boundary marks, form one Aho-Corasick automaton per
block of items. Text is folded to the terms' bytes with one mark for every byte between terms, so the
automaton's matches are whole terms and nothing else; each match is a term number, which maps to the items
that hold the term. No document index is built: the texts are scanned once for the collection's
statistics (documents, terms, documents per term) and once to score. A task keeps the best documents per
item while it scans, and only those are sent on and ranked again.

Blocks of items are bounded in bytes and number (``BLOCK_BYTES``, ``BLOCK_ITEMS``), so is what is
broadcast; each block scans the texts anew. Long texts are matched piece by piece, cut between terms.

Defined results: a null or empty text has no term and is no document of the statistics; an item without
a term has no rows; every item row is an item of its own, so equal item rows give equal results twice;
documents with equal ids are separate documents; a null doc_id ranks after all others of its score; other
columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scan_tasks, table
from .textnum import text_slices

TOP = 20
BLOCK_BYTES = 1 << 20
BLOCK_ITEMS = 4096
PIECE_BYTES = 1 << 20
SCORES_AT_ONCE = 1 << 21
MARK = 0x20
#: A-Z in lower case; every other byte below 0x80 that is no letter or digit becomes the boundary mark.
FOLD = bytes(MARK if c < 0x80 and not chr(c).isalnum() else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

Posting = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class TermAutomaton:
    """The terms of a block of items: the automaton over them and the items that each term maps to."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[bytes, int] = {}
        held = [Counter(numbers.setdefault(t, len(numbers)) for t in terms_of(text)) for text in texts]
        entries = sorted((term, item, times) for item, counts in enumerate(held) for term, times in counts.items())
        self.n_items, self.terms = len(texts), list(numbers)
        term, item, times = np.array(entries, np.int64).reshape(-1, 3).T
        self.first = np.searchsorted(term, np.arange(len(numbers) + 1))
        self.item, self.times = item.copy(), times.copy()
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, number in numbers.items():
            self.machine.add_word(f" {t.decode('latin-1')} ", number)
        if numbers:
            self.machine.make_automaton()

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Posting]:
        """Of texts as bytes: how many terms each has, and (document, term, count) of the items' terms."""
        n_docs, n_terms = len(offsets) - 1, max(len(self.terms), 1)
        folded = np.frombuffer(data.tobytes().translate(FOLD), np.uint8)
        inside = folded != MARK
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = offsets[:-1][offsets[:-1] < len(data)]
        begins[starts] = inside[starts]
        lengths = np.diff(np.searchsorted(np.flatnonzero(begins), offsets))
        # a mark before and after every text; text i then starts at offsets[i] + i + 1
        marked = np.insert(folded, offsets, MARK).tobytes().decode("latin-1")
        limits = offsets[1:] + np.arange(1, n_docs + 1)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = 0
        while self.terms and at < len(marked) - 1:
            end = len(marked) if len(marked) - at <= PIECE_BYTES else marked.rfind(" ", at + 1, at + PIECE_BYTES) + 1
            end = end or marked.find(" ", at + 1) + 1     # one term longer than a piece
            found = np.fromiter(chain.from_iterable(self.machine.iter(marked, at, end)), np.int64).reshape(-1, 2)
            here, times = np.unique(np.searchsorted(limits, found[:, 0]) * n_terms + found[:, 1], return_counts=True)
            keys, counts = np.concatenate([keys, here]), np.concatenate([counts, times])
            at = end - 1                                   # pieces share the mark between them
        keys, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, counts)
        return lengths, (keys // n_terms, keys % n_terms, total)

    def scores(self, n_docs: int, postings: Posting, saturation: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of every (document, item); ``saturation`` is a document's m."""
        doc, term, tf = postings
        value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * saturation[doc]))
        fan = self.first[term + 1] - self.first[term]
        done = np.cumsum(fan) - fan
        entry = np.repeat(self.first[term] - done, fan) + np.arange(fan.sum())
        out = np.zeros((n_docs, self.n_items), np.int64)
        np.add.at(out.reshape(-1), np.repeat(doc, fan) * self.n_items + self.item[entry], np.repeat(value, fan) * self.times[entry])
        return out


def _statistics(docs: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and per term number of the block the documents that hold it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(shared.value)
        df, n_docs, n_terms = np.zeros(len(automaton.terms), np.int64), 0, 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                lengths, (_, term, _) = automaton.scan(data, offsets)
                df += np.bincount(term, minlength=len(df))
                n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen.tolist()], pa.int64()),
                                          pa.array([n_docs, n_terms, *df[seen].tolist()], pa.int64())], ["term", "n"])

    found = scan_tasks(docs.select("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    totals = {r["term"]: r["n"] for r in found.collect()}   # at most two rows more than the block has terms
    return totals.pop(-2, 0), totals.pop(-1, 0), totals


def _best(docs: DataFrame, shared, n_docs: int, n_terms: int, weights: np.ndarray, top: int) -> DataFrame:
    """(item, doc_id, score): per task the best documents of each item of the block."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TermAutomaton(shared.value)
        # per item a heap of (score, null id last, -id)
        heaps: list[list[tuple[int, bool, int]]] = [[] for _ in range(automaton.n_items)]
        least = np.ones(automaton.n_items, np.int64)
        step = max(1, SCORES_AT_ONCE // max(automaton.n_items, 1))
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column(0)):
                lengths, (doc, term, tf) = automaton.scan(data, offsets)
                m = np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
                for a in range(0, hi - lo, step):
                    b = min(a + step, hi - lo)
                    part = slice(*np.searchsorted(doc, [a, b]))
                    found = automaton.scores(b - a, (doc[part] - a, term[part], tf[part]), m[a:b], weights)
                    for d, i in zip(*(x.tolist() for x in np.nonzero(found >= least)), strict=True):
                        doc_id, heap = ids[lo + a + d], heaps[i]
                        entry = (int(found[d, i]), doc_id is not None, -(doc_id or 0))
                        if len(heap) < top:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == top:
                            least[i] = heap[0][0]
        rows = [(i, -number if known else None, score) for i, heap in enumerate(heaps) for score, known, number in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return scan_tasks(docs).mapInArrow(search, "item long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of bounded size, dealt by their hash; a single longer item text is a block's most."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["bytes"] // BLOCK_BYTES))
    for block in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block) if n > 1 else items
        found = [(r["item_id"], r["text"]) for r in rows.collect()]
        if found:
            yield found


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item."""
    spark = docs.sparkSession
    texts = docs.select(docs[text_col].alias("text"), docs[id_col].cast("long").alias("doc_id"))
    wanted = items.select(items[item_col].alias("item_id"), items[item_text_col].alias("text"))
    item_type = wanted.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id long, score long")
    for block in _blocks(wanted):
        shared = spark.sparkContext.broadcast([text for _, text in block])
        n_docs, n_terms, df = _statistics(texts, shared)
        if not df:
            continue
        weights = np.zeros(max(df) + 1, np.int64)
        for term, n in df.items():
            weights[term] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * n + 1))))
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {item_type.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _best(texts, shared, n_docs, n_terms, weights, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL),
it AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(terms) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
c AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * n_docs) // n_terms)))) AS c FROM tf JOIN w USING (term), s),
sc AS (SELECT i, item_id, r, doc_id, sum(c * times)::BIGINT AS score FROM it JOIN c USING (term) GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""
