"""Mixing sources to target weights by systematic sampling.

Within a source each document is expected target / source_size times. The prefix sums of that, shifted by one random
offset of the source, cross integers; a document is emitted once for each integer it crosses. Documents are ordered by
size first, so every stretch of sizes gets its share and the words taken differ from the target by about one large document
at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.llm.common import WORD, document, ranked, stage

WEIGHTS = (5, 2, 1)


def uniform(*of: Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of the values."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *of).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """From (no_source, source, source_size), one row a source: its target.

    Water filling in closed form: in order of cap over weight, a source stays at its cap as long as the level that is
    left for it and those after it lies above. Sources number far fewer than rows; only this table is sorted whole.
    """
    up, down = share
    by_name = Window.orderBy("no_source", "source")
    w = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), "no_source", "source")
    whole = Window.partitionBy()
    left = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    left = left.select("*", F.row_number().over(order).alias("k"), (F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("capped"), F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("ws"), F.sum("source_size").over(whole).alias("total"))
    rest = up * F.col("total") - down * F.col("capped")
    left = left.withColumn("full", down * F.col("cap") * F.col("ws") <= rest * F.col("w")).withColumn("level", rest / (down * F.col("ws")))
    left = left.withColumn("level", F.min(F.when(~F.col("full"), F.struct("k", "level"))).over(whole)["level"])
    return left.select("no_source", "source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: str = "mix", carry: bool = True) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, and with carry row (the whole input row).

    Null and empty texts have size 0 and take nothing away from the words; a source of only such rows has target 0 and no
    copies. A null source is one source, the last. Repeated rows are numbered apart; an empty table gives an empty result.
    Rows of one size are ordered by a hash of their id; rows that tie in all of it are alike and share the copies. Only sizes
    are put in order: texts, whose bytes would pile up where the long ones come together, join by row at the end.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"), *[document(docs).alias("row")] * carry)
    rows = stage(rows.select("uid", "doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("size"), *["row"] * carry), "numbered")
    narrow = rows.select("uid", "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    narrow = narrow.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    placed = ranked(narrow, ["no_source", "source"], ["size", "_h", "doc_id", "uid"])
    per_source = stage(targets(placed.groupBy("no_source", "source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    offset = uniform(F.lit(seed), F.col("no_source").cast("string"), F.col("source"))
    crossed = F.floor(rate * (F.col("rank") + 1) + F.col("offset")) - F.floor(rate * F.col("rank") + F.col("offset"))
    out = placed.join(per_source.withColumn("offset", offset), ["no_source", "source"]).withColumn("copies", crossed.cast("long"))
    out = out.select("uid", "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
    return (out.join(rows.select("uid", "row"), "uid") if carry else out).drop("uid")
