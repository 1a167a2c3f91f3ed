"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes of a text puts chunk boundaries where its low bits are zero, so boundaries move
with the content and an insertion disturbs only the chunks around it. Chunks are deduplicated by digest over the corpus:
the first of equal chunks, by document and place, is the owner. A run of chunks that are all owned elsewhere is a seed: it
grows to both sides as long as the bytes are those beside the owners of its outer chunks, and is removed if it then holds
enough words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from swarf.llm.common import stage, unstage
from swarf.shipping import ship


#: Bytes of the rolling hash, a power of two.
WINDOW = 16


@dataclass(frozen=True)
class Chunking:
    """bits: a boundary every 2**bits bytes on average; least and most: bytes of a chunk; words: of a removed run, grown.

    What two texts share lies hardly ever more than two longest chunks beyond the whole chunks that they share, so no more than
    `beside` bytes beside an owner are looked at. Half of 50 words is far more than chance repeats hold.
    """

    bits: int = 5
    least: int = 12
    most: int = 128
    words: int = 25

    @property
    def beside(self) -> int:
        return 2 * self.most


@lru_cache(1)
def gear() -> np.ndarray:
    """256 random 64-bit numbers from a fixed seed."""
    return np.random.default_rng(20240229).integers(0, 2**63, 256, np.int64).view(np.uint64)


def boundaries(data: np.ndarray, c: Chunking) -> np.ndarray:
    """Ends of the chunks of bytes `data`.

    The rolling value of WINDOW bytes, sum of gear << age, is doubled up in vector steps. Cuts nearer than `least` to the
    one before are skipped, gaps over `most` are cut evenly from their start. No chunk ends inside a UTF-8 character.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear()[data]
    for age in (1 << k for k in range(WINDOW.bit_length() - 1)):
        h[age:] = h[age:] + (h[:-age] << np.uint64(age))
    starts = np.append((data[1:] & 0xC0) != 0x80, True)  # a character starts after this byte
    cuts = np.flatnonzero(((h >> np.uint64(WINDOW - c.bits)) & np.uint64((1 << c.bits) - 1) == 0) & starts) + 1
    ends, last = [], 0
    for cut in [*cuts.tolist(), n]:
        while cut - last > c.most:
            last += c.most
            while not starts[last - 1]:
                last -= 1
            ends.append(last)
        if cut - last >= c.least or cut == n > last:
            ends.append(cut)
            last = cut
    return np.array(ends, np.int64)


def chunked(rows: DataFrame, c: Chunking) -> DataFrame:
    """From (uid, doc_id, text) one row a chunk: uid, doc_id, at (its number), digest (128 bits)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                uids, docs, ats, digests = [], [], [], []
                for uid, doc, text in zip(b.column("uid").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                    raw = text.as_py().encode()
                    ends = boundaries(np.frombuffer(raw, np.uint8), c).tolist()
                    digests += [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip([0, *ends], ends)]
                    uids += [uid] * len(ends)
                    docs += [doc] * len(ends)
                    ats += range(len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(docs, pa.int64()), pa.array(ats, pa.int32()), pa.array(digests, pa.binary())], ["uid", "doc_id", "at", "digest"])

    return rows.mapInArrow(run, "uid long, doc_id long, at int, digest binary")


def grown(raw: bytes, start: int, end: int, left: bytes, right: bytes, least: int) -> tuple[int, int]:
    """The range start:end of raw grown while its neighbours end with `left` and begin with `right`, then cut back to whole words.

    It never grows beyond `least` to the left.
    """
    a, b = start, end
    while a > least and start - a < len(left) and raw[a - 1] == left[a - start - 1]:
        a -= 1
    while b < len(raw) and b - end < len(right) and raw[b] == right[b - end]:
        b += 1
    while a < start and a > 0 and not raw[a - 1 : a].isspace():
        a += 1
    while b > end and b < len(raw) and not (raw[b : b + 1].isspace() or raw[b - 1 : b].isspace()):
        b -= 1
    return a, b


def removed_spans(raw: bytes, runs: list[dict], c: Chunking) -> list[tuple[int, int]]:
    """Byte ranges of grown runs with enough words, or that make up the whole text. A run: first and last (chunks), left and
    right (bytes beside the owners), and kept (the chunk of its own text that owns its first chunk, which must stay; or null).
    """
    ends = boundaries(np.frombuffer(raw, np.uint8), c).tolist()
    starts, out = [0, *ends], []
    for r in runs:
        a, b = starts[r["first"]], ends[r["last"]]
        least = max(out[-1][1] if out else 0, ends[r["kept"]] if r["kept"] is not None else 0)
        a, b = grown(raw, a, b, r["left"], r["right"], min(a, least))
        if len(raw[a:b].split()) >= c.words or a == 0 and b == len(raw):
            if out and a < out[-1][1]:  # the run before has grown into this one
                a, b = out[-1][0], max(b, out.pop()[1])
            out.append((a, b))
    return out


def beside_owners(rows: DataFrame, wanted: DataFrame, c: Chunking) -> DataFrame:
    """From texts (uid, text) and (digest, owner_uid, owner_at): also left and right, the bytes beside those chunks."""
    lists = wanted.groupBy(F.col("owner_uid").alias("uid")).agg(F.collect_list(F.struct(F.col("owner_at").alias("at"), "digest")).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 200) for i in range(0, big.num_rows, 200)):
                out = []
                for uid, text, chunks in zip(b.column("uid").to_pylist(), b.column("text"), b.column("chunks").to_pylist(), strict=True):
                    raw = text.as_py().encode()
                    ends = boundaries(np.frombuffer(raw, np.uint8), c).tolist()
                    starts = [0, *ends]
                    out += [(x["digest"], uid, x["at"], raw[max(0, starts[x["at"]] - c.beside) : starts[x["at"]]], raw[ends[x["at"]] : ends[x["at"]] + c.beside]) for x in chunks]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["digest", "owner_uid", "owner_at", "left", "right"])

    return rows.select("uid", "text").join(lists, "uid").select("uid", "text", "chunks").mapInArrow(run, "digest binary, owner_uid long, owner_at int, left binary, right binary")


def substring_dedup(docs: DataFrame, c: Chunking = Chunking()) -> DataFrame:
    """One row per input row: doc_id, text (without repeated runs), n_chunks, n_repeated, removed ('start:end' in code points of the input).

    The first of equal chunks by (doc_id, nulls last, row, place) stays, so a passage that occurs twice in one text loses
    the second, and of repeated rows all but one go whole. A text made of repeated chunks alone goes whole, whatever its
    length. Null and empty texts are empty and have no chunks; very long ones have more. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stage(rows, "numbered")  # one numbering for the chunks and for the texts that they are cut from
    chunks = stage(chunked(rows, c), "chunks")
    twice = stage(chunks.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "twice")
    # staged, the small sides of the joins leave Spark free to split a digest that very many chunks share
    repeated = stage(chunks.join(twice, "digest"), "repeated")  # most chunks occur once and go no further
    unstage(chunks)
    unstage(twice)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "uid", "at")
    owners = stage(repeated.groupBy("digest").agg(F.min(order).alias("owner")).select("digest", F.col("owner.uid").alias("owner_uid"), F.col("owner.at").alias("owner_at")), "owners")
    again = repeated.join(owners, "digest").where("uid <> owner_uid or at <> owner_at").select("uid", "at", "digest")
    by = Window.partitionBy("uid").orderBy("at")
    runs = again.withColumn("island", F.col("at") - F.row_number().over(by)).groupBy("uid", "island")
    runs = stage(runs.agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min_by("digest", "at").alias("head"), F.max_by("digest", "at").alias("tail")).drop("island"), "runs")
    unstage(repeated)
    wanted = runs.select(F.explode(F.array("head", "tail")).alias("digest")).distinct().join(owners, "digest")
    sides = stage(beside_owners(rows, wanted, c), "beside")
    unstage(owners)
    heads = sides.select(F.col("digest").alias("head"), "left", "owner_uid", "owner_at")
    runs = runs.join(heads, "head").join(sides.select(F.col("digest").alias("tail"), "right"), "tail")
    kept = F.when(F.col("owner_uid") == F.col("uid"), F.col("owner_at")).alias("kept")
    lists = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last", "left", "right", kept))).alias("runs"))
    joined = rows.join(lists, "uid", "left").select("doc_id", "text", "runs")
    names = ["doc_id", "text", "n_chunks", "n_repeated", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 500) for i in range(0, big.num_rows, 500)):
                texts, counts, hits, spans = [], [], [], []
                for text, found in zip(b.column("text"), b.column("runs"), strict=True):
                    raw, found = text.as_py().encode(), found.as_py() or []
                    kept, last, said, points = [], 0, [], 0
                    for s, e in removed_spans(raw, found, c):
                        kept.append(raw[last:s])
                        a = points + len(raw[last:s].decode())
                        points = a + len(raw[s:e].decode())
                        said.append(f"{a}:{points}")
                        last = e
                    kept.append(raw[last:])
                    texts.append(b"".join(kept).decode())
                    counts.append(len(boundaries(np.frombuffer(raw, np.uint8), c)))
                    hits.append(sum(r["last"] - r["first"] + 1 for r in found))
                    spans.append(",".join(said))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.string())], names)

    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()), strict=True)])
    return joined.mapInArrow(run, schema)
