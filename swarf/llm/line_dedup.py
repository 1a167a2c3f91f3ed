"""Line dedup: lines that many documents share go from all of them.

Normalised lines are hashed where they stand and the hashes staged, 16 bytes a line. Exploded, they are counted by document
with map-side combine; those of enough documents are joined back to the places that hold them, and each document is put
together again from the places that are left. Texts travel once, to the places that they lose.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import document, let, stage

#: The white space that is stripped from both ends of a line.
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped and with A-Z in lower case; lower() does the same and faster where all is ASCII."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_dedup(docs: DataFrame, documents: int = 10, least: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, text (the lines that stay), row (the whole input row).

    Lines whose key has `least` code points or more and occurs in `documents` rows or more are dropped, all of them. A null
    text is one empty line, like an empty one; very long texts are read whole. Each row is a document of its own, whatever its
    doc_id, so repeated rows count as often as they are there; a line counts once for each document. A hash is 128 bits of
    MD5. An empty table gives an empty result.
    """
    digest = lambda c: F.unhex(F.md5(c.cast("binary")))
    # rows of one id and one text lose the same lines, so these two name a row, the same in each reading
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), document(docs).alias("row"))
    rows = rows.withColumn("key", digest(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text"))))
    hashed = F.transform(lines_of(F.col("text")), lambda x: let(line_key(x), lambda k: F.when(F.length(k) >= least, digest(k))))
    hashes = stage(rows.select("key", hashed.alias("hashes")), "line-hashes")
    counts = hashes.select(F.explode(F.array_distinct(F.array_compact("hashes"))).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    shared = stage(counts.where(F.col("n") >= documents).select("hash"), "shared-lines")  # staged, so that a hot line can be split in the join
    places = hashes.select("key", F.posexplode("hashes").alias("place", "hash")).where("hash is not null").join(shared, "hash")
    lost = places.groupBy("key").agg(F.collect_set("place").alias("lost"))
    out = rows.join(lost, "key", "left").withColumn("lines", lines_of(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    text = F.when(F.col("lost").isNull(), F.col("text")).otherwise(let(F.col("lines"), lambda ls: F.array_join(F.transform(left, lambda i: ls[i]), "\n")))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("text"), "row")
