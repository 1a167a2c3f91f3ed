"""Pieces shared by the training-data operators: the shared folder, staged tables, distributed ranks, let-bindings.

Every operator reads only the columns it needs by name, so further columns, also ones with the names used here, do no harm.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of every word rule, as a regex character class for Java and RE2.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where that is unset and all is one process (tests).

    On a cluster without that setting it raises, as what executors write to disks of their own is lost to the others.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or getattr(context, "_swarf_shared", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="swarf-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = context._swarf_shared = f"file://{own}"
    return found.rstrip("/")


#: Spark's setting that removes the shuffle files of a query as it ends; else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and outlives a lost executor.

    The shuffle files go as soon as it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    was = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        conf.unset(TIDY) if was is None else conf.set(TIDY, was)
    context = df.sparkSession.sparkContext
    context._swarf_staged = [*getattr(context, "_swarf_staged", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def sweep(spark: SparkSession) -> None:
    """Remove all that this session has staged. For the caller, once results are written: they read staged tables until then."""
    for folder in getattr(spark.sparkContext, "_swarf_staged", []):
        remove(spark, folder)
    spark.sparkContext._swarf_staged = []


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)) if exists(spark, folder) else []


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


#: Steps summed up in one go: appending to an array copies it, so long ones are cut.
STEPS = 256


def starts(steps: Column) -> Column:
    """From array<struct<b, w>> the places where each w starts, if b and w follow each other: array<int>, in time in proportion.

    Each stretch of STEPS is summed up by itself, then the sums of the stretches, which are added.
    """
    def cut(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEPS).cast("int")), lambda k: F.slice(s, k * STEPS + 1, F.lit(STEPS)))).otherwise(F.array().cast("array<array<struct<b:int,w:int>>>"))

    ints = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + x["b"] + x["w"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["b"])).alias("out"))
    parts = let(steps, lambda s: F.transform(cut(s), lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), ints.alias("out")), step)))
    before = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("at"), ints.alias("out")), lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    return let(parts, lambda ps: F.flatten(F.zip_with(ps, before(ps), lambda p, at: F.transform(p["out"], lambda x: x + at))))


def document(df: DataFrame) -> Column:
    """The whole row as one struct, so that an operator can carry it whatever its columns are called."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row among those with equal `by` (no nulls there), ordered by `order`.

    Rows are range partitioned by both, so a hot `by` spreads over many tasks; each task numbers its own rows and the
    counts by task and key, at most one row more than tasks and keys together, give the offsets. The placed rows are
    staged: all later reads see one numbering.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = stage(placed, "ranked")
    counts = placed.groupBy("_task", *by).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", *by, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    return placed.join(offsets, ["_task", *by]).withColumn(name, F.col("_place") + F.col("_offset")).drop("_task", "_place", "_offset")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the least node of its connected component.

    Alternates large-star and small-star rounds (Kiveris et al., 2014), each a min by node with map-side combine and one
    join, staged; the state is one edge for each node once stars remain. The small side of a join is staged too, so that
    adaptive execution may split the edges of a node that very many share. Empty edges give an empty table.
    """
    state = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = low_large = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = stage(large, "large-star")
        low = low_small = stage(large.groupBy("a").agg(F.min("b").alias("low")), "low")
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*")
        after = stage(small.where("a <> b").distinct(), "small-star")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (state, large, low_large, low_small):
            unstage(old)
        state = after
        if now == mark:
            break
        mark = now
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
