"""Readers of the driver's tables, and the part tables derived from them (the same in SQL for the oracle).

Lengths are summed as whole thousandths of an inch, so that no result depends on the order of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The order of a part's lines. Nulls come last, and lengths are rounded, halves to even, both as in DuckDB.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


# How many segments a task works on, so that its lines, faces and pairs stay in memory, and at most how many tasks there are.
SEGMENTS, TASKS = 50_000, 20_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows by key in as many partitions as their number asks for; few rows are left to Spark.

    What is left to Spark is coalesced by the bytes of the shuffle, which tell little of what a part's segments grow to. The
    number comes from the footers.
    """
    n = min(-(-rows.count() // SEGMENTS), TASKS)
    return rows.repartition(n, key) if n > 1 else rows


def r6(x: Column) -> Column:
    """Six decimals, by floor: agrees between engines at ties."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def segments(spark: SparkSession, sf_dir: str, short: bool = False, small: bool = False, gaps: bool = False, bad: bool = False) -> DataFrame:
    """part_id, seq, z_start, z_end, od_diameter, id_diameter, confidence: orders as parts, lines as segments.

    short: thousandths of an inch for a unit of quantity instead of tenths; small: diameters that are close together; gaps:
    some segments start later; bad: some rows break the rules. One shuffle on part_id.
    """
    li = spread(table(spark, sf_dir, "lineitem").withColumn("part_id", F.col("l_orderkey")), "part_id")
    by = Window.partitionBy("part_id").orderBy(*[F.asc_nulls_last(c) for c in ORDER])
    length = F.rint(F.col("l_quantity") * (1 if short else 100)).cast("long")
    od = (500 + F.col("l_partkey") % 8 * 5) if small else (500 + F.col("l_partkey") % 40 * 50)
    li = li.withColumn("len_mil", length).withColumn("od_mil", od).withColumn("d", F.round(F.col("l_discount") * 100).cast("int")).withColumn("t", F.round(F.col("l_tax") * 100).cast("int"))
    li = li.select("part_id", F.row_number().over(by).cast("long").alias("seq"), "len_mil", F.sum("len_mil").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("end_mil"), "od_mil", "d", "t", "l_linenumber", "l_suppkey")
    mil = lambda x: x / F.lit(1000.0)
    start = F.col("end_mil") - F.col("len_mil")
    if gaps:
        start = start + F.when(F.col("t") == 3, F.least(F.lit(10), F.col("len_mil") - 1)).when(F.col("t") == 5, F.least(F.lit(100), F.col("len_mil") - 1)).otherwise(0)
    end, odm = F.col("end_mil"), F.col("od_mil")
    idm = F.when(F.col("d") == 0, F.lit(0.0)).when(F.col("d") == 10, odm + 10.0).otherwise(F.floor(odm * F.col("d") / F.lit(10.0)).cast("double"))
    if bad:
        end = F.when(F.col("l_suppkey") % 23 == 0, start).otherwise(end)
        idm = F.when(F.col("l_suppkey") % 19 == 0, F.lit(-1000.0)).otherwise(idm)
        odm = F.when(F.col("l_suppkey") % 17 == 0, F.lit(0)).otherwise(odm)
    return li.select("part_id", "seq", mil(start).alias("z_start"), mil(end).alias("z_end"), mil(odm).alias("od_diameter"), mil(idm).alias("id_diameter"), ((35 + 9 * F.col("l_linenumber")) / F.lit(100.0)).alias("confidence"))


def segments_sql(short: bool = False, small: bool = False, gaps: bool = False, bad: bool = False) -> str:
    """The CTEs up to `segments` in DuckDB's SQL."""
    start = "(end_mil - len_mil)" + (" + CASE t WHEN 3 THEN least(10, len_mil - 1) WHEN 5 THEN least(100, len_mil - 1) ELSE 0 END" if gaps else "")
    idm = "CASE WHEN d = 0 THEN 0 WHEN d = 10 THEN od_mil + 10 ELSE floor(od_mil * d / 10.0::DOUBLE) END"
    return f"""li AS (SELECT *, l_orderkey AS part_id, CAST(l_quantity * {1 if short else 100} AS BIGINT) AS len_mil,
            {"500 + l_partkey % 8 * 5" if small else "500 + l_partkey % 40 * 50"} AS od_mil, CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) AS t FROM lineitem),
        seg AS (SELECT part_id, row_number() OVER w AS seq, len_mil, (sum(len_mil) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS end_mil, od_mil, d, t, l_linenumber, l_suppkey
            FROM li WINDOW w AS (PARTITION BY part_id ORDER BY {", ".join(ORDER)})),
        segments AS (SELECT part_id, seq, ({start}) / 1000.0::DOUBLE AS z_start, ({f"CASE WHEN l_suppkey % 23 = 0 THEN {start} ELSE end_mil END" if bad else "end_mil"}) / 1000.0::DOUBLE AS z_end,
            ({"CASE WHEN l_suppkey % 17 = 0 THEN 0 ELSE od_mil END" if bad else "od_mil"}) / 1000.0::DOUBLE AS od_diameter,
            ({f"CASE WHEN l_suppkey % 19 = 0 THEN -1000 ELSE {idm} END" if bad else idm}) / 1000.0::DOUBLE AS id_diameter, (35 + 9 * l_linenumber) / 100.0::DOUBLE AS confidence FROM seg)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_id and what an inference says of a part: method, validation_passed, units, overall, crop_partial, has_z_range, part_no."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("part_id"), F.when(k % 4 < 2, "anchor_dimension").when(k % 4 == 2, "estimated").otherwise("guess").alias("method"), (k % 7 != 0).alias("validation_passed"),
        F.when(k % 11 == 0, "mm").when(k % 11 == 1, "ft").otherwise("in").alias("units"), ((50 + k % 50) / F.lit(100.0)).alias("overall"), (k % 13 == 0).alias("crop_partial"), (k % 5 != 0).alias("has_z_range"),
        F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit(" PN-"), k.cast("string"))).alias("part_no"),
    )


PARTS_SQL = """parts AS (SELECT o_orderkey AS part_id, CASE WHEN o_orderkey % 4 < 2 THEN 'anchor_dimension' WHEN o_orderkey % 4 = 2 THEN 'estimated' ELSE 'guess' END AS method,
        o_orderkey % 7 <> 0 AS validation_passed, CASE o_orderkey % 11 WHEN 0 THEN 'mm' WHEN 1 THEN 'ft' ELSE 'in' END AS units, (50 + o_orderkey % 50) / 100.0::DOUBLE AS overall,
        o_orderkey % 13 = 0 AS crop_partial, o_orderkey % 5 <> 0 AS has_z_range, CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE ' PN-' || o_orderkey END AS part_no FROM orders)"""
