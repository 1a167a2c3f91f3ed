"""Files of jobs: documents written, read back and marked; uploads; run reports; the choice of a view."""

import io
import json
import random
import zipfile
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from swarf.operators import jobs as jb
from swarf.operators import views as vw
from swarf.sources import documents as dc

SCHEMA = "units string, segments array<struct<z_start: double, z_end: double>>"


def test_documents_one_a_file(spark, tmp_path):
    docs = {"a": '{\n "units": "in",\n "segments": [{"z_start": 0, "z_end": 1.5}]\n}', "b": '{"units": "in", "segments": [', "c": "[1, 2]", "d": "null", "e": "12", "f": "", "g": "{}", "h": "[1, 2", "i": '{"units": 7, "more": {"x": 1}}'}
    for job, text in docs.items():
        out = tmp_path / "jobs" / job / "outputs"
        out.mkdir(parents=True)
        (out / "part_summary.json").write_text(text)
        (out / "other.json").write_text("{")
    got = {r["job"]: r for r in dc.load_files(spark, f"file://{tmp_path}/jobs", SCHEMA).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": "INVALID_JSON", "c": "NOT_AN_OBJECT", "d": "NOT_AN_OBJECT", "e": "NOT_AN_OBJECT", "g": None, "h": "INVALID_JSON", "i": None}
    assert got["a"]["doc"]["units"] == "in" and got["a"]["doc"]["segments"][0]["z_end"] == 1.5 and got["b"]["doc"] is None and got["i"]["doc"]["units"] == "7"


def test_the_sink_overwrites(spark, tmp_path):
    folder = f"file://{tmp_path}/docs"
    df = spark.createDataFrame([(1, "x", 0), (2, "y", 1)], "id long, v string, p int")
    dc.save(df, folder)
    dc.save(df.where("id = 2"), folder)
    assert [(r["id"], r["v"], r["bad"]) for r in dc.load(spark, folder, "id long, v string").collect()] == [(2, "y", None)]
    parted = f"file://{tmp_path}/parted"
    dc.save(df, parted, ("p",))
    dc.save(df.where("id = 2").withColumn("v", F.lit("new")), parted, ("p",))
    assert {(r["id"], r["v"]) for r in dc.load(spark, parted, "id long, v string").collect()} == {(1, "x"), (2, "new")}
    dc.save_text(spark.createDataFrame([('{"id": 1, "v": "a"}',), ('{"id": 1, "v',), ("",)], "doc string"), folder)
    got = {(r["id"], r["v"], r["bad"]) for r in dc.load(spark, folder, "id long, v string").cache().collect()}
    assert (1, "a", None) in got and len(got) == 2 and any(b == '{"id": 1, "v' for _, _, b in got)


def zipped(*names):
    with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
        for n in names:
            z.writestr(n, n)
    return buf.getvalue()


def test_uploads_from_files(spark, tmp_path):
    """PDFs kept, archives expanded, the rest skipped; jobs with a file get their event."""
    given = {"1": {"plan.pdf": b"pdf", "notes.txt": b"no", "all.ZIP": zipped("a/x.pdf", "b/x.pdf", "c.PDF", "d.txt")}, "2": {"notes.txt": b"no"}, "3": {"broken.zip": b"PK no archive"}, "4": {"one.zip": zipped("x.pdf"), "two.zip": zipped("x.pdf", "dir/")}}
    for job, fs in given.items():
        (tmp_path / "up" / job).mkdir(parents=True)
        for name, content in fs.items():
            (tmp_path / "up" / job / name).write_bytes(content)
    kept, events = dc.ingest(dc.uploads(spark, f"file://{tmp_path}/up"))
    assert Counter((r["job"], r["name"], r["source"]) for r in kept.collect()) == Counter([("1", "plan.pdf", "pdf"), ("1", "x.pdf", "zip"), ("1", "x_1.pdf", "zip"), ("1", "c.PDF", "zip"), ("4", "x.pdf", "zip"), ("4", "x.pdf", "zip")])
    got = {r["job"]: (r["status"], r["n_files"]) for r in events.collect()}
    assert got == {"1": ("CREATED", 4), "4": ("CREATED", 2)} and events.where("ts is null").count() == 0
    log = events.select(F.col("job").cast("long").alias("job_id"), "ts", F.lit(1).alias("n"), "status", F.lit(None).cast("string").alias("mode"))
    assert {r["job_id"]: r["status"] for r in jb.latest(log).collect()} == {1: "CREATED", 4: "CREATED"}


def test_run_reports_against_a_fold(spark, tmp_path):
    rng, t0, rows = random.Random(7), datetime(2024, 1, 1), []
    for job in range(40):
        for n in range(rng.randint(1, 12)):
            rows.append((job, rng.choice("abc"), n, t0 + timedelta(seconds=n * 7 + job), rng.choice(["running", "running", "completed", "failed", None]), rng.choice([None, "x"])))
    want, open_ = [], {}
    for job, name, n, ts, status, error in rows:
        key = (job, name)
        if status == "running":
            open_[key] = len(want)
            want.append([job, name, n, ts, None, "running", None])
        elif status:
            at = open_.pop(key, None)
            if at is None:
                want.append([job, name, n, ts, ts, status, error])
            else:
                want[at][4:] = [ts, status, error]
        else:
            open_.pop(key, None)  # a row without status comes between
    df = spark.createDataFrame(rows, "job_id long, name string, n long, ts timestamp, status string, error string")
    got = jb.paired_stages(df).collect()
    assert sorted(map(str, ([r["job_id"], r["name"], r["n"], r["started_at"], r["finished_at"], r["status"], r["error"]] for r in got))) == sorted(map(str, want))
    folder = f"file://{tmp_path}/reports"
    dc.save(jb.run_reports(df), folder)
    back = {r["job_id"]: r for r in dc.load(spark, folder, "job_id long, status string, stage_count long, distinct_stages long, duration_ms double, stages array<struct<n: long>>, errors array<string>").collect()}
    for job in {w[0] for w in want}:
        mine, r = [w for w in want if w[0] == job], back[job]
        state = "running" if any(w[4] is None for w in mine) else "failed" if any(w[5] == "failed" for w in mine) else "completed"
        assert r["status"] == state and [s["n"] for s in r["stages"]] == sorted(w[2] for w in mine) and len(r["errors"]) == sum(w[6] is not None for w in mine)
        assert r["stage_count"] == sum(x[0] == job for x in rows) and r["distinct_stages"] == len({x[1] for x in rows if x[0] == job})
        if state != "running":
            assert r["duration_ms"] == (max(w[4] for w in mine) - min(w[3] for w in mine)).total_seconds() * 1000


def test_selection_of_views(spark):
    box = lambda k: (f"box{k}", [k, k, k + 1, k + 1], float(k))
    pages = spark.createDataFrame([(1, 0, [box(0), box(1)], "100x100"), (1, 1, [], "1x1"), (1, 2, [("b", None, 1.0)], None), (2, 0, None, None)], "job_id long, page long, views array<struct<box:string,box_pixels:array<int>,area:double>>, image_size string")
    results = spark.createDataFrame([(1, [(0, 1)], (0, 0)), (2, [], (0, 0)), (3, [], None), (4, None, (0, None))], "job_id long, ranked_views array<struct<page:int,view_index:int>>, best_view struct<page:int,view_index:int>")
    asked = [(1, None, None), (1, 0, "1"), (1, 0, "0"), (1, 0, " 1 "), (1, 0, "2"), (1, 0, "-1"), (1, 0, "one"), (1, 1, "0"), (1, 2, "0"), (1, 9, "0"), (1, 0, None), (2, None, None), (3, None, None), (3, 0, "0"), (4, None, None), (5, None, None)]
    got = vw.select_view(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i long, job_id long, page long, view_index string").drop("i"), results, pages).collect()
    assert Counter((r["job_id"], r["source"], r["ranked"], r["box"], r["error"]) for r in got) == Counter([
        (1, "best", False, "box0", None), (1, "given", True, "box1", None), (1, "given", False, "box0", None), (1, "given", True, "box1", None), (1, "given", False, None, "INDEX_OUT_OF_RANGE"), (1, "given", False, None, "INDEX_OUT_OF_RANGE"),
        (1, "given", False, None, "INDEX_NOT_INTEGER"), (1, "given", False, None, "NO_VIEWS"), (1, "given", False, None, "MISSING_BOX"), (1, "given", False, None, "MISSING_PAGE"), (1, "best", False, "box0", None), (2, "best", False, None, "NO_VIEWS"),
        (3, None, False, None, "NO_BEST_VIEW"), (3, "given", False, None, "MISSING_PAGE"), (4, "best", False, None, "MISSING_SELECTION"), (5, None, False, None, "NO_BEST_VIEW"),
    ])
