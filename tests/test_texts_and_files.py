"""Texts, paths, archives and the job log against models and cases."""

import io
import zipfile

import pytest
from conftest import SF
from pyspark.sql import functions as F

from swarf.functions import text as tx
from swarf.plans import other_queries
from swarf.sources import files as fl
from swarf.streaming import jobs as sj


def test_dimensions(spark):
    rows = [(1, '1.245"'), (2, "1.245 in"), (3, "1-1/4"), (4, "[31.6]"), (5, "1.245 [31.6]"), (6, None), (7, "3–1/2 and 2-1/0")]
    got = {}
    for r in tx.dimensions(spark.createDataFrame(rows, "key long, text string")).collect():
        got.setdefault(r["key"], []).append(r["value"])
    assert got == {1: [1.245, 1.245], 2: [1.245, 1.245], 3: [1.25], 5: [1.245], 7: [3.5]}
    once = tx.dimensions(spark.createDataFrame(rows, "key long, text string"), distinct=True).where("key = 2").count()
    assert once == 1


def test_dimensions_of_documents_include_fractions(spark, tmp_path):
    spark.createDataFrame([(1, "bore 1-1/4 deep"), (2, "od 1.5")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in other_queries.x01_dimensions(spark, str(tmp_path)).collect()}
    assert got == {(1, 3, 1.25, "1-1/4"), (2, 2, 1.5, "1.5")}


def test_hints_far_behind_the_head_of_a_text(spark, tmp_path):
    rows = [(7, "word " * 200 + "DIA 4"), (8, "word " * 9000 + "see Section"), (9, "word " * 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["view_id"]: (r["dia_conf"], r["section_conf"]) for r in other_queries.x03_v15_text_hints(spark, str(tmp_path)).collect()}
    assert got == {7: (0.7, 0.0), 8: (0.0, 0.8), 9: (0.0, 0.0)}


@pytest.mark.parametrize("given,want", [([], ""), ([4], "4"), ([1, 2, 3], "1-3"), ([1, 2, 3, 5, 6], "1-3 and 5-6"), ([1, 3, 5], "1, 3, and 5"), ([1, 2, 4, 7, 8, 9], "1-2, 4, and 7-9")])
def test_ranges(spark, given, want):
    assert spark.createDataFrame([(given,)], "l array<bigint>").select(tx.ranges(F.col("l"))).first()[0] == want


def said(numbers):
    out = []
    for x in numbers:
        if out and out[-1][1] + 1 == x:
            out[-1][1] = x
        else:
            out.append([x, x])
    t = [str(a) if a == b else f"{a}-{b}" for a, b in out]
    return t[0] if len(t) == 1 else " and ".join(t) if len(t) == 2 else ", ".join(t[:-1]) + ", and " + t[-1]


def model(segs, overall):
    text = [f"This part has {len(segs)} turned section{'s' * (len(segs) != 1)}."]
    best = max(range(len(segs)), key=lambda i: (segs[i].z_end - segs[i].z_start, -i))
    text.append(f"The longest section is {segs[best].z_end - segs[best].z_start:.2f} in (section {best + 1}).")
    pick = lambda f: [i + 1 for i, s in enumerate(segs) if f(s)]
    if thin := pick(lambda s: 0 < (s.od - s.bore) / 2 < 0.05):
        text.append(f"One thin-wall area was detected in section {thin[0]} and needs review." if len(thin) == 1 else f"{len(thin)} thin-wall areas were detected in sections {said(thin)} and need review.")
    bores = pick(lambda s: s.bore > 0)
    text.append("No internal bore detected (solid part)." if not bores else "Internal bore is present throughout all sections." if len(bores) == len(segs) else f"Internal bore appears only in section {bores[0]}." if len(bores) == 1 else f"Internal bore appears in sections {said(bores)}.")
    if overall is not None and (low := pick(lambda s: s.confidence < 0.65)):
        text.append(f"Section {low[0]} has low confidence and may need manual review." if len(low) == 1 else f"Sections {said(low)} have low confidence and may need manual review.")
    for flag in dict.fromkeys(f for s in segs for f in s.flags):
        mine, words = pick(lambda s, flag=flag: flag in s.flags), tx.FLAGS[flag]
        text.append(f"Section {mine[0]} {words.replace('have', 'has', 1)}." if len(mine) == 1 else f"Sections {said(mine)} {words}.")
    if overall is not None:
        text.append(f"Overall detection confidence is {'high' if overall >= 0.85 else 'medium' if overall >= 0.65 else 'low'} ({overall * 100:.0f}%).")
    return " ".join(text)


def test_explanations_follow_the_model(spark):
    seen = {}
    explain = tx.explanation
    try:
        tx.explanation = lambda stacks: seen.setdefault("stacks", stacks)
        other_queries.x04_explanations(spark, SF)
    finally:
        tx.explanation = explain
    got = {r["part_id"]: r["explanation"] for r in tx.explanation(seen["stacks"]).collect()}
    rows = seen["stacks"].collect()
    assert len(rows) > 1000
    for r in rows:
        assert got[r["part_id"]] == model(r["seg"], r["overall"])
    nothing = seen["stacks"].limit(1).withColumn("seg", F.slice("seg", 1, 0))
    assert tx.explanation(nothing).first()["explanation"] == "No segments found in this part."


@pytest.mark.parametrize("path,safe", [("../etc/passwd", False), ("..\\windows\\system32", False), ("inputs/../../../etc/passwd", False), ("/etc/passwd", False), ("C:\\windows\\system32", False), ("inputs/file.pdf", True), ("outputs/result.json", True), ("inputs/subfolder/file.pdf", True)])
def test_safe_paths(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(fl.safe_path(F.col("p"))).first()[0] is safe


def test_names(spark):
    long = "a" * 300 + ".pdf"
    rows = [("x/y.pdf", "y.pdf"), ("", "file"), ("a..b", "a_b"), ("a\\b\x00", "a_b_"), (long, "a" * 250 + ".pdf")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "p string").select(fl.clean_name(F.col("p"))).collect()
    assert [r[0] for r in got] == [b for _, b in rows]


def test_archives(spark):
    with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
        for name in ("a.pdf", "in/a.pdf", "in/b.PDF", "c.txt", "deep/er/a.pdf"):
            z.writestr(name, name)
    rows = fl.unzip(spark.createDataFrame([(1, buf.getvalue())], "key long, content binary")).collect()
    assert {(r["name"], bytes(r["content"]).decode()) for r in rows} == {("a.pdf", "a.pdf"), ("a_1.pdf", "in/a.pdf"), ("a_2.pdf", "deep/er/a.pdf"), ("b.PDF", "in/b.PDF")}


def test_archives_are_taken_apart_without_a_shuffle(spark):
    with zipfile.ZipFile(buf := io.BytesIO(), "w") as z:
        for k in range(300):
            z.writestr(f"{k}/a.pdf", str(k))
            z.writestr(f"{k}/..pdf", "")
    rows = fl.unzip(spark.createDataFrame([("x", buf.getvalue()), ("y", None), (None, b"none"), ("z", buf.getvalue())], "key string, content binary"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InPandas" not in plan and "Arrow" not in plan
    got = {(r["key"], r["name"], bytes(r["content"]).decode()) for r in rows.collect()}
    assert got == {(key, name.format(f"_{k}" if k else ""), text) for key in "xz" for k in range(300) for name, text in (("a{}.pdf", str(k)), ("_pdf{}", ""))}


def test_log_as_a_stream(spark, tmp_path):
    rows = other_queries.log(spark, SF)
    rows.repartition(3).write.parquet(str(tmp_path / "log"))
    q = sj.latest_states(sj.read_log(spark, str(tmp_path / "log"), files_a_trigger=1)).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in other_queries.jb.latest(rows).select("job_id", "status", "mode").collect()}
    assert {tuple(r) for r in spark.sql("select job_id, status, mode from states").collect()} == want


def test_newest_jobs_come_first(spark):
    got = [(-r["created_us"], r["job_id"]) for r in other_queries.io07_newest_first(spark, SF).collect()]
    assert got == sorted(got) and len(got) > 10
