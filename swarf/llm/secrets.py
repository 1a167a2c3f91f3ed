"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed by the sha256 of its text. A ledger row says of a blob which rule versions
scanned it in one run, and what they found. A run first compares digests with the ledger, then fetches and scans only blobs
and rule versions not seen yet, once however many paths hold the blob, appends what it has scanned to the ledger, and joins
the findings of all runs back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import exists, let, stage, starts

LEDGER = "blob string, scanned array<string>, found array<struct<rule: string, start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches, scanned leftmost and without overlap, count if `group` has `least` code points.

    fast, where given, finds the same matches in linear time in Spark's regex engine, each from where its run of characters
    starts; the match itself begins at the first `begins` therein.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    fast: str | None = None
    begins: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", fast=r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?eyJ)[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", begins="eyJ"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)
RULES = (*BASE, *MORE)


NONE = "array<struct<rule: string, start: int, end: int>>"


def matches(text: Column, rule: Rule) -> Column:
    """array<struct<rule, start, end>> in code points: what lies between matches and the matches' own lengths add up."""
    pattern = rule.fast or rule.pattern
    pat = F.lit(pattern)
    between = F.split(text, pattern, -1)
    whole, part = F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(rule.group))
    lead = lambda w: F.length(F.substring_index(w, rule.begins, 1)) if rule.begins else F.lit(0)
    sizes = F.zip_with(whole, part, lambda w, g: F.struct(F.length(w).alias("w"), F.length(g).alias("g"), lead(w).alias("lead")))
    none = F.array().cast(NONE)

    def spans(ms: Column) -> Column:
        at = starts(F.zip_with(ms, F.slice(between, F.lit(1), F.size(ms)), lambda m, b: F.struct(F.length(b).alias("b"), m["w"].alias("w"))))
        each = F.zip_with(ms, at, lambda m, s: F.struct(F.lit(rule.key).alias("rule"), (s + m["lead"]).alias("start"), (s + m["w"]).alias("end"), (m["g"] >= rule.least).alias("ok")))
        return F.transform(F.filter(each, lambda x: x["ok"]), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end")))

    found = F.rlike(text, pat)
    return F.when(F.contains(text, F.lit(rule.begins)) & found if rule.begins else found, let(sizes, spans)).otherwise(none)


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, additions to the ledger) of versions (path, text).

    findings has one row for each version: path, blob, found (array of rule, start, end by start, then in the order of
    rules). A null text is the empty blob; very long texts are scanned whole, in time in proportion. Repeated versions and
    equal texts are one blob, scanned once. Ledger rows that are there twice, or overlap in rules, count once. An empty table
    gives empty results.
    """
    text, keys = F.coalesce("text", F.lit("")), F.array(*[F.lit(r.key) for r in rules])
    nothing = F.array().cast("array<string>")
    paths = versions.select("path", F.sha2(text, 256).alias("blob"))
    fresh = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    if ledger is None:
        fresh = fresh.dropDuplicates(["blob"]).withColumn("scanned", nothing)
    else:  # digests first: texts of known blobs go no further than the scan, and if few are new, no text is shuffled but theirs
        known = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("scanned"))
        todo = paths.select("blob").distinct().join(known, "blob", "left").withColumn("scanned", F.coalesce("scanned", nothing))
        todo = stage(todo.where(F.size(F.array_except(keys, "scanned")) > 0), "unseen")
        fresh = fresh.join(todo.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).join(todo, "blob")
    found = F.concat(*[F.when(F.array_contains("scanned", r.key), F.array().cast(NONE)).otherwise(matches(F.col("text"), r)) for r in rules])
    added = stage(fresh.select("blob", F.array_except(keys, "scanned").alias("scanned"), found.alias("found")), "ledger")
    every = added if ledger is None else ledger.select("blob", "scanned", "found").unionByName(added)
    if ledger is not None:  # a blob has a row for each run that scanned it; what two runs have both scanned counts once
        every = every.join(paths.select("blob").distinct(), "blob", "left_semi").withColumn("scanned", F.sort_array("scanned"))
        runs = every.groupBy("blob", "scanned").agg(F.first("found").alias("found")).groupBy("blob").agg(F.collect_list(F.struct("scanned", "found")).alias("runs"))
        fresh_of = lambda acc, r: F.filter(r["found"], lambda f: ~F.array_contains(acc["seen"], f["rule"]))
        step = lambda acc, r: F.struct(F.concat(acc["seen"], r["scanned"]).alias("seen"), F.concat(acc["found"], F.array(fresh_of(acc, r))).alias("found"))
        every = runs.select("blob", F.flatten(F.aggregate("runs", F.struct(nothing.alias("seen"), F.array().cast(f"array<{NONE}>").alias("found")), step)["found"]).alias("found"))
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    ours = F.transform(F.filter("found", lambda f: F.array_contains(keys, f["rule"])), lambda f: F.struct(f["start"].alias("start"), rank[f["rule"]].alias("k"), f["end"].alias("end"), f["rule"].alias("rule")))
    listed = F.transform(F.sort_array(ours), lambda f: F.struct(f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end")))
    return paths.join(every.select("blob", listed.alias("found")), "blob").select("path", "blob", "found"), added


def scan_into(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of scan(), against the ledger kept in a folder, to which this run's additions are appended."""
    spark = versions.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(folder) if exists(spark, folder) else None  # its files are listed here, so without what is appended below
    findings, added = scan(versions, rules, ledger)
    added.write.mode("append").parquet(folder)
    return findings


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the given rules, comma-joined."""
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    mine = F.filter(found, lambda f: f["rule"].isin(*[r.key for r in rules]))
    return F.array_join(F.transform(mine, lambda f: F.concat_ws(":", kind[f["rule"]], f["start"].cast("string"), f["end"].cast("string"))), ",")


def counted(found: Column, rule: Rule) -> Column:
    return F.size(F.filter(found, lambda f: f["rule"] == rule.key)).cast("long")
