"""Exact dedup: a log-structured merge index over text digests.

Memtables are the input tasks: each sorts its rows by digest and flushes them as one Parquet run. Compaction merges the
runs of a batch into one level that keeps, for each digest, the best identifier and the count; it combines map-side, so a
group of any size leaves one row a task. A filter of the digests that some other row has as well goes to all tasks: what it
doesn't let through is alone, and stays where it is. The others meet the level, and are compared byte by byte with the row that
stays.

An index in a folder takes further batches. Of each batch it holds a level (sorted by digest), the texts of its new
entries on shelves by hashed digest (a folder each), and a filter: a bitmap of the hashed digests in small rows. A new batch's
digests go to the filters of earlier levels first; only what these let through is joined with the levels, and hits are verified
by their bytes, for which the shelves that hold none of them aren't read. When the levels get too many they are compacted into
one, which keeps each entry's best identifier.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.llm.common import SPACE, document, exists, listed, remove, stage

#: So many copies share one shipped text of the row that stays, when bytes are compared.
COPIES_A_TEXT = 1000
#: Levels of an index before they are compacted into one.
LEVELS = 8
#: Bytes of a filter that may be sent to all tasks; beyond that (32 million repeated digests) all rows go to the join.
FILTER_BYTES = 64 << 20
#: Bits of a filter's row, and the rows of a filter for each so many digests: some 16 bits a digest.
FILTER_BITS, DIGESTS_A_ROW = 32768, 2048
#: Texts of a level on one shelf, and the most shelves of a level.
TEXTS_A_SHELF, SHELVES = 8192, 4096


def normalised(text: Column) -> Column:
    """Equality ignores white space; a null text counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def whole_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def flush_runs(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Level 0: one sorted run for each input task."""
    norm = normalised(F.col("row.text"))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), document(docs).alias("row"))
    rows = rows.select("uid", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("row.text"), F.lit(0)).alias("points"), F.sha2(norm, 256).alias("text_sha256"), digest(norm).alias("digest"), "row")
    return stage(rows.sortWithinPartitions("digest"), "runs")


def rank(of: str = "") -> list[Column]:
    """What makes a row stay: most code points, smallest doc_id, nulls last."""
    return [(-F.col(f"{of}points")).alias("p"), F.col(f"{of}doc_id").isNull().alias("z"), F.col(f"{of}doc_id").alias("doc_id")]


def compact(runs: DataFrame, *keys: str) -> DataFrame:
    """Level 1: of each key the row that stays (the first row where these tie) and the count."""
    first = F.min(F.struct(*rank(), "uid")).alias("first")
    return runs.groupBy(*keys).agg(first, F.count("*").alias("group_size")).select(*keys, F.col("first.uid").alias("keep_uid"), F.col("first.doc_id").alias("keep_id"), (-F.col("first.p")).alias("points"), "group_size")


def differing(runs: DataFrame, level: DataFrame) -> DataFrame:
    """The digests under which some row's bytes differ from those of the row that stays."""
    hits = runs.where("maybe").join(level.where("group_size > 1").select("digest", "keep_uid", "group_size"), "digest").select("digest", "uid", "keep_uid", normalised(F.col("row.text")).alias("norm"), F.ceil(F.col("group_size") / COPIES_A_TEXT).alias("salts"))
    hits = stage(hits, "hits")
    stays = hits.where("uid = keep_uid").select("digest", F.col("norm").alias("kept_norm"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    copies = hits.where("uid <> keep_uid").select("digest", "norm", F.pmod(F.xxhash64("uid"), F.col("salts")).alias("salt"))
    return stage(copies.join(stays, ["digest", "salt"]).where("norm <> kept_norm").select("digest").distinct(), "differing")


def filtered(runs: DataFrame, level: DataFrame) -> DataFrame:
    """Adds maybe: whether some other row may have the digest, by a filter of those that the level has counted twice or more."""
    again = level.where("group_size > 1").select("digest")
    n = again.count()
    if max(1, -(-n // DIGESTS_A_ROW)) * FILTER_BITS // 8 > FILTER_BYTES:
        return runs.withColumn("maybe", F.lit(True))
    bits = stage(filter_of(again, n), "filter").select("row", "bits")  # of that size at most
    row, bit = place(F.col("digest"), F.lit(max(1, -(-n // DIGESTS_A_ROW))).cast("long"))
    held = runs.withColumns({"row_": row, "bit_": bit}).join(F.broadcast(bits.withColumnRenamed("row", "row_")), "row_", "left")
    return held.withColumn("maybe", F.coalesce(is_set(F.col("bits"), F.col("bit_")), F.lit(False))).drop("row_", "bit_", "bits")


def grouped(docs: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The runs of a batch with the digest and bytes ('' unless digests clash) that tell its groups apart, and its level by these."""
    runs = flush_runs(docs, digest)
    level = stage(compact(runs, "digest").withColumn("bytes", F.lit("")).sortWithinPartitions("digest"), "level")
    runs = filtered(runs, level)
    clashing = differing(runs, level)
    if not clashing.take(1):
        return runs.withColumn("bytes", F.lit("")), level
    marked = runs.join(clashing.withColumn("clash", F.lit(True)), "digest", "left").withColumn("bytes", F.when(F.col("clash"), normalised(F.col("row.text"))).otherwise(F.lit(""))).drop("clash")
    return marked, stage(compact(marked, "digest", "bytes").sortWithinPartitions("digest"), "level")


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = whole_digest) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, row (the whole input row as a struct).

    Null texts equal empty ones and each other; very long ones are compared whole. Ties go to the smaller doc_id, a null one
    last; of repeated rows with one doc_id just one is kept. An empty table gives an empty result. Should bytes differ under
    one digest, the rows of that digest are grouped by their bytes as well.
    """
    runs, level = grouped(docs, digest)
    out = runs.where("maybe").join(level.where("group_size > 1").select("digest", "bytes", "keep_uid", "keep_id", "group_size"), ["digest", "bytes"], "left")
    out = out.select(
        "doc_id", F.when(F.col("keep_uid").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("keep_uid", "uid") == F.col("uid")).alias("kept"), "text_sha256", "row",
    )
    alone = runs.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
    return alone.unionByName(out)


def place(digest: Column, rows: Column) -> tuple[Column, Column]:
    """Where the bit of a digest stands: the filter's row and the bit in it."""
    return F.pmod(F.xxhash64(digest, F.lit("row")), rows), F.pmod(F.xxhash64(digest, F.lit("bit")), F.lit(FILTER_BITS).cast("long"))


def filter_of(digests: DataFrame, n: int) -> DataFrame:
    """rows, row, bits: a bitmap of hashed digests, 4 KB a row."""
    rows = max(1, -(-n // DIGESTS_A_ROW))
    row, bit = place(F.col("digest"), F.lit(rows).cast("long"))
    return digests.select(row.alias("row"), bit.alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).select(F.lit(rows).cast("long").alias("rows"), "row", "bits")


def is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8).cast("int") + 1)) != 0


def passed(digests: DataFrame, filters: DataFrame) -> DataFrame:
    """Of distinct digests those that some filter may hold."""
    sizes = sorted(r["rows"] for r in filters.select("rows").distinct().collect())  # at most one for each level
    looked = digests.select("digest", F.explode(F.array(*[F.lit(r).cast("long") for r in sizes])).alias("rows"))
    row, bit = place(F.col("digest"), F.col("rows"))
    looked = looked.select("digest", "rows", row.alias("row"), bit.alias("bit")).join(filters, ["rows", "row"])
    return looked.where(is_set(F.col("bits"), F.col("bit"))).select("digest").distinct()


def shelf(digest: Column, shelves: Column) -> Column:
    """The shelf of a digest in a level of so many: both numbers, as levels differ in size."""
    return F.concat_ws("-", shelves.cast("string"), F.pmod(F.xxhash64(digest, F.lit("shelf")), shelves.cast("long")).cast("string"))


class Index:
    """Levels, filters and texts in a folder. Each compaction begins a generation; the newest one with a finished level counts,
    and in it the levels that are finished, so that a batch or a compaction which fails midway leaves the index as it was.
    """

    ENTRY = "digest string, entry string, doc_id long, points int, group_size long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        done = {}
        for g in listed(spark, self.folder):
            batches = [b for b in listed(spark, f"{self.folder}/{g}") if exists(spark, f"{self.folder}/{g}/{b}/level/_SUCCESS")]
            if batches:
                done[g] = batches
        self.generation = max(done, default="g000000")
        self.batches = sorted(done.get(self.generation, []))

    def read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{self.generation}/{b}/{part}" for b in self.batches])

    def entries(self) -> DataFrame:
        """One row an entry: what stays so far, and how many rows were equal to it."""
        best = F.min(F.struct(*rank())).alias("first")
        e = self.read("level", self.ENTRY).groupBy("digest", "entry").agg(best, F.sum("group_size").alias("group_size"))
        return e.select("digest", "entry", F.col("first.doc_id").alias("doc_id"), (-F.col("first.p")).cast("int").alias("points"), "group_size")

    def filters(self) -> DataFrame:
        return self.read("filter", "rows long, row long, bits binary, shelves int")

    def texts(self, of: DataFrame | None = None) -> DataFrame:
        """digest, entry, norm of all entries, or of those with the digests of another table, for which only their shelves are read.

        The names of the shelves that hold one go through the driver: SHELVES for a level at most, of LEVELS + 1 levels.
        """
        at = [f"{self.folder}/{self.generation}/{b}/texts" for b in self.batches]
        found = [self.spark.read.schema("digest string, entry string, norm string, shelf string").parquet(a) for a in at]
        if of is not None:
            sizes = [r["shelves"] for r in self.filters().select("shelves").distinct().collect()]  # at most one for each level
            wanted = of.select(F.explode(F.array(*[shelf(F.col("digest"), F.lit(n)) for n in sizes])).alias("shelf")).distinct()
            names = [r["shelf"] for r in wanted.collect()]
            found = [f.where(F.col("shelf").isin(names)).join(of.select("digest"), "digest", "left_semi") for f in found]
        return reduce(DataFrame.unionByName, [f.select("digest", "entry", "norm") for f in found])

    def write(self, batch: str, texts: DataFrame, level: DataFrame, generation: str | None = None) -> None:
        """The level last: only then does the batch count."""
        at = f"{self.folder}/{generation or self.generation}/{batch}"
        n = level.count()
        shelves = max(1, min(SHELVES, n // TEXTS_A_SHELF))
        on = texts.select("digest", "entry", "norm", shelf(F.col("digest"), F.lit(shelves)).alias("shelf"))
        on.repartitionByRange("shelf", "digest").sortWithinPartitions("shelf", "digest").write.partitionBy("shelf").option("compression", "zstd").parquet(f"{at}/texts")
        filter_of(level, n).withColumn("shelves", F.lit(shelves)).write.parquet(f"{at}/filter")
        level.select("digest", "entry", "doc_id", "points", "group_size").sortWithinPartitions("digest").write.parquet(f"{at}/level")

    def compact(self) -> None:
        """All levels into one of the next generation; what was before goes."""
        old = self.generation
        self.write("b" + uuid.uuid4().hex, self.texts(), stage(self.entries(), "entries"), f"g{int(old[1:]) + 1:06d}")
        remove(self.spark, f"{self.folder}/{old}")


def add(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = whole_digest) -> DataFrame:
    """exact_dedup() of a batch against the index in a folder, which takes the batch in.

    Rows as of exact_dedup(), as things stand after this batch: keep_id and group_size cover all batches so far, and kept is
    true for the row of this batch that stays, if one does. A later batch may hold a longer original; ties stay with the
    earlier one. Of the texts of the index only the shelves are read that hold a digest which a filter lets through, and only the texts of
    such digests go on. New texts are shuffled once, to their shelves.
    """
    spark, index, batch = docs.sparkSession, Index(docs.sparkSession, folder), "b" + uuid.uuid4().hex
    runs, level = grouped(docs, digest)
    norms = runs.select("digest", "bytes", "uid", normalised(F.col("row.text")).alias("norm"))
    mine = level.select("digest", "bytes", "keep_uid", F.col("keep_id").alias("doc_id"), "points", "group_size")
    if index.batches:
        maybe = stage(passed(level.select("digest").distinct(), index.filters()), "maybe")
        here = mine.join(maybe, "digest", "left_semi").join(norms.select("digest", "bytes", F.col("uid").alias("keep_uid"), "norm"), ["digest", "bytes", "keep_uid"])
        there = index.texts(maybe).withColumnRenamed("norm", "old_norm")
        same = here.join(there, "digest").where("norm = old_norm").select("digest", "bytes", "entry")
        old = index.entries().join(maybe, "digest", "left_semi").select("digest", "entry", *[F.col(c).alias(f"old_{c}") for c in ("doc_id", "points", "group_size")])
        mine = mine.join(same.join(old, ["digest", "entry"]), ["digest", "bytes"], "left")
    else:
        mine = mine.select("*", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("long").alias("old_doc_id"), F.lit(None).cast("int").alias("old_points"), F.lit(None).cast("long").alias("old_group_size"))
    wins = F.col("entry").isNull() | (F.struct(*rank()) < F.struct(*rank("old_")))
    mine = stage(mine.withColumn("known", F.col("entry").isNotNull()).withColumn("wins", wins).withColumn("entry", F.coalesce("entry", F.concat(F.lit(batch), F.lit("-"), F.col("keep_uid").cast("string")))), "entries")
    fresh = mine.where("not known").select("digest", "bytes", F.col("keep_uid").alias("uid"), "entry").join(norms, ["digest", "bytes", "uid"])
    index.write(batch, fresh, mine.select("digest", "entry", "doc_id", "points", "group_size"))
    if len(index.batches) + 1 > LEVELS:
        Index(spark, folder).compact()
    stands = mine.select("digest", "bytes", "keep_uid", F.when(F.col("wins"), F.col("doc_id")).otherwise(F.col("old_doc_id")).alias("keep_id"), (F.col("group_size") + F.coalesce("old_group_size", F.lit(0))).alias("group_size"), "wins")
    return runs.join(stands, ["digest", "bytes"]).select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("uid") == F.col("keep_uid"))).alias("kept"), "text_sha256", "row")
