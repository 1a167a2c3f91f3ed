"""Ranked lexical search by windowed bucket scoring.

Documents are read once for the terms that a block of queries asks for; their counts are staged, with the statistics of all
documents. In order of doc_id, windows of so many documents that an array of scores fits into a core's cache are turned
into postings. Each query walks the postings of its terms, adds what they give into the array and marks the places in
a bitset; what is marked is harvested into the query's heap, which holds the best so far. The heaps of all tasks
are merged in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.llm.common import stage, unstage
from swarf.shipping import ship

#: Documents of a window: an array of 64-bit scores of 256 KB.
WINDOW = 1 << 15
#: Bytes of query texts that are searched for in one reading of the documents: what the driver holds and sends to tasks.
BLOCK = 8 << 20
#: Of UTF-8 bytes: digits, letters (A-Z in lower case) and all that is not ASCII make up terms, anything else parts them.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def counted(vocabulary: dict[bytes, int]):
    """The mapInArrow function from (doc_id, text) to (doc_id, n, term, tf): its terms, and of those asked for number and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.get
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                ids, n, ends, which, often = [], [], [0], [], []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                    found = terms(text.as_py())
                    if not found:
                        continue
                    held = Counter(map(look, found))
                    held.pop(None, None)
                    ids.append(doc_id)
                    n.append(len(found))
                    which += held.keys()
                    often += held.values()
                    ends.append(len(which))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (which, often)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return run


class Buckets:
    """Scores of one window at a time, and a heap for each query over all windows of a task."""

    def __init__(self, asked: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int, window: int):
        self.asked, self.weights, self.docs, self.total, self.k = asked, weights, docs, total, k
        self.scores, self.marks = np.zeros(window, np.int64), np.zeros(-(-window // 64), np.uint64)
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in asked]
        self.before = 0

    def postings(self, n: np.ndarray, many: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """By term, ascending places: what a document gives to a query that has the term."""
        place = np.repeat(np.arange(len(n)), many)
        m = 50 + (50 * n * self.docs) // self.total
        gives = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[place]))
        order = np.argsort(term, kind="stable")
        self.place, self.gives = place[order], gives[order]
        self.word, self.bit = self.place >> 6, np.uint64(1) << (self.place & 63).astype(np.uint64)
        self.first = np.searchsorted(term[order], np.arange(len(self.weights) + 1))

    def window(self, ids: list[int | None], n: np.ndarray, many: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.postings(n, many, term, tf)
        for heap, asked in zip(self.heaps, self.asked, strict=True):
            starts, ends = self.first[asked], self.first[asked + 1]
            held = starts < ends
            for a, b in zip(starts[held].tolist(), ends[held].tolist(), strict=True):
                self.scores[self.place[a:b]] += self.gives[a:b]  # a term has a document once
                np.bitwise_or.at(self.marks, self.word[a:b], self.bit[a:b])
            self.harvest(heap, ids)
        self.before += len(ids)

    def harvest(self, heap: list[tuple[int, int, int | None]], ids: list[int | None]) -> None:
        """Into the heap: those above its least one once it is full, as later documents of equal score rank behind."""
        words = np.flatnonzero(self.marks)
        bits = np.flatnonzero(np.unpackbits(self.marks[words].view(np.uint8), bitorder="little"))
        places = words[bits >> 6] * 64 + (bits & 63)
        scores = self.scores[places]
        self.scores[places], self.marks[words] = 0, 0
        better = scores > (heap[0][0] if len(heap) == self.k else 0)
        places, scores = places[better], scores[better]
        best = np.argsort(-scores, kind="stable")[: self.k]
        for place, score in zip(places[best].tolist(), scores[best].tolist(), strict=True):
            one = (score, -(self.before + place), ids[place])
            if len(heap) < self.k:
                heapq.heappush(heap, one)
            elif one > heap[0]:
                heapq.heapreplace(heap, one)


def scored(asked: list[np.ndarray], weights: np.ndarray, docs: int, total: int, k: int, window: int):
    """The mapInArrow function from staged rows in order of doc_id to (item, doc_id, score): the k best of this task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, held, size = Buckets(asked, weights, docs, total, k, window), [], 0

        def flush(rows: pa.Table) -> None:
            lists = {c: rows[c].combine_chunks() for c in ("term", "tf")}
            flat = {c: v.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c, v in lists.items()}
            buckets.window(rows["doc_id"].to_pylist(), rows["n"].to_numpy(), lists["term"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), flat["term"], flat["tf"])

        for b in batches:
            held.append(b.select(["doc_id", "n", "term", "tf"]))
            size += b.num_rows
            while size >= window:
                rows = pa.Table.from_batches(held)
                flush(rows.slice(0, window))
                held, size = rows.slice(window).to_batches(), size - window
        if size:
            flush(pa.Table.from_batches(held))
        out = [(item, one[2], one[0]) for item, heap in enumerate(buckets.heaps) for one in heap]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item its k documents of the highest scores above 0, by doc_id where these tie.

    From all docs (doc_id, text) for all items (item_id, text). Null and empty texts have no terms: such documents count
    nowhere, such items have no rows. Documents of one id are ranked each by its text, a null id behind the others; rows of one
    item_id and text are one item, and texts that differ under one item_id are ranked apart. Very long texts are read whole.
    Queries are taken in blocks of about `block` bytes of text, one text at least, each block with all documents; the
    driver holds the terms of one block and the document frequencies of these. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block))
    out = None
    for at in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == at)
        best = search_block(docs, [(r["item_id"], terms(r["text"].encode())) for r in part.collect()], k, window)
        out = best if out is None else out.unionByName(best)
    return out


def search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int, window: int) -> DataFrame:
    """search() for items that the driver holds, as (item_id, terms)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    asked = [np.array(sorted({vocabulary[t] for t in ts}), np.int64) for _, ts in items]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(counted(vocabulary), "doc_id long, n long, term array<int>, tf array<int>")
    rows = stage(rows, "term-counts")
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in rows.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # at most the block's terms
        weights[r["term"]] = math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * r["df"] + 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.where(F.size("term") > 0).select(F.col("doc_id").isNull().alias("z"), "doc_id", F.monotonically_increasing_id().alias("uid"), "n", "term", "tf")
    placed = placed.repartitionByRange(parts, "z", "doc_id", "uid").sortWithinPartitions("z", "doc_id", "uid")
    found = placed.mapInArrow(scored(asked, weights, total["docs"], total["terms"], k, window), "item long, doc_id long, score long")
    found = stage(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(parts) + 1))), "heaps")
    unstage(rows)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(items)], "item long, item_id long")
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
