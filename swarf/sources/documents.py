"""Documents of jobs as JSON files: an overwriting sink, readers that mark what doesn't parse, and uploads from file contents."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swarf.sources import files

BAD = "bad"
# Fixed value: where a job's documents lie below the folder of all jobs.
OUTPUTS = r"/([^/]+)/outputs/[^/]+$"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: below spark.checkpoint.dir, or one of our own where that is unset and all is one process."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="swarf-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(docs: DataFrame, folder: str, by: tuple[str, ...] = ()) -> None:
    """One JSON document a row, one line each. What the folder held goes; with `by`, only in the partitions that docs has."""
    docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static").partitionBy(*by).json(folder)


def save_text(docs: DataFrame, folder: str) -> None:
    """The same for documents that are text already (column doc)."""
    docs.select("doc").write.mode("overwrite").text(folder)


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Documents of one line each by a schema, with `bad`: the line where it doesn't parse, else null. Blank lines are none."""
    return spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(folder)


def load_files(spark: SparkSession, folder: str, schema: str, name: str = "part_summary.json") -> DataFrame:
    """One document a file, of any number of lines, below folder/<job>/outputs/: job, doc (by the schema), error.

    error is INVALID_JSON, NOT_AN_OBJECT, or null; doc is null where there is one. Files of other names aren't read, and Spark passes over empty ones.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(folder).select("path", F.decode("content", "UTF-8").alias("value"))
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    f = f.select(F.regexp_extract("path", OUTPUTS, 1).alias("job"), F.col("value"), text.startswith("{").alias("object"), (text == "null").alias("none"))
    f = f.withColumn("doc", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    inner = F.get_json_object(F.concat(F.lit('{"a":'), F.col("value"), F.lit("}")), "$.a")
    error = F.when(F.col("object"), F.when(F.col(f"doc.{BAD}").isNotNull(), "INVALID_JSON")).when(F.col("none") | inner.isNotNull(), "NOT_AN_OBJECT").otherwise("INVALID_JSON")
    return f.withColumn("error", error).select("job", F.when(F.col("error").isNull(), F.col("doc").dropFields(BAD)).alias("doc"), "error")


def job_of(path: Column) -> Column:
    """The job of an uploaded file below <folder>/<job>/."""
    return F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """job, name, content of all files in folder/<job>/, read on the executors."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select(job_of(F.col("path")).alias("job"), F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "content", F.col("modificationTime").alias("ts"))


def ingest(uploaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, events) of uploads (job, name, content, ts): job, name, size, source; and a CREATED event for each job that got a file.

    PDFs are kept by their clean name, archives give the PDFs in them, and everything else is skipped. Names that clash
    within an archive get _1, _2 ...; a file that can't be read as an archive gives nothing, nor does an empty name.
    """
    ending = lambda e: F.lower("name").endswith(e)
    pdfs = uploaded.where(ending(".pdf")).select("job", files.clean_name(F.col("name")).alias("name"), F.length("content").cast("long").alias("size"), F.lit("pdf").alias("source"), "ts")
    archives = uploaded.where(ending(".zip"))
    # an archive is known by its job and name
    members = files.unzip(archives.select(F.struct("job", F.col("name").alias("archive"), "ts").alias("key"), "content"))
    packed = members.select("key.job", "name", F.length("content").cast("long").alias("size"), F.lit("zip").alias("source"), "key.ts")
    kept = pdfs.unionByName(packed)
    events = kept.groupBy("job").agg(F.min("ts").alias("ts"), F.count("*").alias("n_files")).withColumn("status", F.lit("CREATED"))
    return kept.drop("ts"), events
