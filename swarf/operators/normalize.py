"""Stack normaliser: boundary snap by windows, then one ordered fold a part that merges short and similar segments.

The fold is a higher-order `aggregate` over the part's ordered array, inside the JVM; a part has tens of segments, and one of
very many is folded in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.functions import geometry as g
from swarf.operators.validate import listed
from swarf.params import DEFAULT, Params


def snap(seg: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Neighbours nearer than the tolerance meet at the midpoint, then z starts at 0. Adds z0, z1, snapped, range.

    A part without a positive range stays as it is. Each boundary moves on its own, so lead and lag do it in one pass.
    """
    by, part = Window.partitionBy("part_id").orderBy("z_start", "seq"), Window.partitionBy("part_id")
    s = seg.select("*", (F.max("z_end").over(part) - F.min("z_start").over(part)).alias("range"), F.min("z_start").over(part).alias("low"), F.lead("z_start").over(by).alias("next"), F.lag("z_end").over(by).alias("prev"))
    eps = F.when(F.col("range") > 0, F.greatest(F.lit(p.snap[0]), p.snap[1] * F.col("range"))).otherwise(F.lit(-1.0))
    up, down = F.coalesce(F.abs(F.col("next") - F.col("z_end")) < eps, F.lit(False)), F.coalesce(F.abs(F.col("z_start") - F.col("prev")) < eps, F.lit(False))
    shift = F.when(F.col("range") > 0, F.col("low")).otherwise(0.0)
    z1 = F.when(up, (F.col("z_end") + F.col("next")) / 2).otherwise(F.col("z_end")) - shift
    z0 = F.when(down, (F.col("prev") + F.col("z_start")) / 2).otherwise(F.col("z_start")) - shift
    return s.select(*seg.columns, z0.alias("z0"), z1.alias("z1"), (up | down).alias("snapped"), "range")


def _merged(a: Column, b: Column) -> Column:
    """One segment from two: lengths weigh the diameters, no length at all gives those of the first."""
    la, lb = a["z1"] - a["z0"], b["z1"] - b["z0"]
    mean = lambda c: F.when(la + lb > 0, (a[c] * la + b[c] * lb) / F.when(la + lb > 0, la + lb)).otherwise(a[c])
    return F.struct(
        a["z0"].alias("z0"), b["z1"].alias("z1"), mean("od").alias("od"), mean("bore").alias("bore"), (a["k"] + b["k"]).alias("k"), (a["snapped"] | b["snapped"]).alias("snapped"),
        (a["clamped"] | b["clamped"]).alias("clamped"), (a["base"] + b["base"]).alias("base"), a["at"].alias("at"),
    )


#: What the fold knows of a merged segment; at is the place of its first segment, from 1: with k it tells which they are.
FIELDS = ("z0", "z1", "od", "bore", "k", "snapped", "clamped", "base")
MERGED = "struct<z0:double,z1:double,od:double,bore:double,k:int,snapped:boolean,clamped:boolean,base:double,at:int>"

#: So many segments are folded into one array. Spark copies the state of a fold at each step, so it must not hold all that came before.
BLOCK = 64


def _fields(s: Column) -> Column:
    return F.struct(*[s[c].alias(c) for c in (*FIELDS, "at")])


def _pass(segs: Column, width: Column, p: Params, short: bool, similar: bool) -> Column:
    """The fold over ordered segments, each knowing its successor.

    It goes on by what it has merged last, so a long part is folded in blocks: first for what each of them begins with, then
    for what it gives.
    """
    near = F.greatest(F.lit(p.short[0]), p.short[1] * width)
    none = F.lit(None).cast(MERGED)
    state = lambda last, skip, done: F.struct(last.alias("last"), F.lit(skip).alias("skip"), done.alias("done"))

    def step(now: Column, s: Column) -> Column:
        """What is merged last, whether the next one is in it, and the one before if that is done."""
        last = now["last"]
        mean = (last["od"] + s["od"]) / 2
        limit = F.greatest(F.lit(p.similar[0]), p.similar[1] * mean)
        alike = (F.abs(last["od"] - s["od"]) < limit) & (F.abs(last["bore"] - s["bore"]) < limit)
        eat = F.lit(short) & s["next"].isNotNull() & (s["z1"] - s["z0"] < near)
        grown = F.when(F.lit(similar) & alike, state(_merged(last, s), False, none)).otherwise(state(_fields(s), False, last))
        return F.when(now["skip"], state(last, False, none)).when(eat, state(_merged(s, s["next"]), True, last)).otherwise(grown)

    def given(block: Column, start: Column, at_end: Column) -> Column:
        """What is done before the last one of a block, and that too at the end of the part."""
        add = lambda out, *xs: F.concat(out, F.filter(F.array(*xs), lambda x: x.isNotNull()))
        out = lambda acc: F.when(acc["now"]["done"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]["done"])))
        begin = F.struct(F.array().cast(f"array<{MERGED}>").alias("out"), start.alias("now"))
        return F.aggregate(block, begin, lambda acc, s: F.struct(out(acc).alias("out"), step(acc["now"], s).alias("now")), lambda acc: F.when(at_end, add(acc["out"], acc["now"]["done"], acc["now"]["last"])).otherwise(acc["out"]))

    first = state(none, False, none)
    n = F.ceil(F.size(segs) / BLOCK).cast("int")
    block = lambda k: F.slice(segs, k * BLOCK + 1, F.lit(BLOCK))
    seen = lambda acc: F.concat(acc["starts"], F.array(acc["now"]))
    begin = F.struct(F.array().cast(f"array<struct<last:{MERGED},skip:boolean,done:{MERGED}>>").alias("starts"), first.alias("now"))
    starts = F.aggregate(F.sequence(F.lit(0), n - 2), begin, lambda acc, k: F.struct(seen(acc).alias("starts"), F.aggregate(block(k), acc["now"], step).alias("now")), seen)
    return F.when(n > 1, F.flatten(F.transform(starts, lambda start, k: given(block(k), start, k == n - 1)))).otherwise(given(segs, first, F.lit(True)))


def normalise(seg: DataFrame, p: Params = DEFAULT, two_pass: bool = False) -> DataFrame:
    """Merged segments: part_id, place, z0, z1, od, bore, k (merged from so many), snapped, clamped, base, seqs, range.

    seg may have clamped and base (confidence before penalties). two_pass merges the short ones first and the similar
    ones in a second fold.
    """
    cols = seg.columns
    seg = seg.withColumn("clamped", F.col("clamped") if "clamped" in cols else F.lit(False)).withColumn("base", F.col("base") if "base" in cols else F.col("confidence"))
    s = snap(seg, p)
    one = F.struct("z_start", "seq", F.struct("z0", "z1", F.col("od_diameter").alias("od"), F.col("id_diameter").alias("bore"), F.lit(1).alias("k"), "snapped", "clamped", "base").alias("s"))
    parts = s.groupBy("part_id").agg(F.sort_array(F.collect_list(one)).alias("a"), F.first("range").alias("range"))

    def linked(a: Column) -> Column:
        return F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1))), lambda x, n: F.struct(*[x[c].alias(c) for c in (*FIELDS, "at")], n.alias("next")))

    parts = parts.withColumn("seqs", F.transform("a", lambda x: x["seq"].cast("bigint"))).withColumn("a", F.transform("a", lambda x, k: F.struct(*[x["s"][c].alias(c) for c in FIELDS], (k + 1).alias("at"))))
    for short, similar in ((True, False), (False, True)) if two_pass else ((True, True),):
        parts = parts.withColumn("l", linked(F.col("m" if similar and two_pass else "a"))).withColumn("m", _pass(F.col("l"), F.col("range"), p, short, similar))
    out = parts.withColumn("m", F.when(F.col("range") > 0, F.col("m")).otherwise(F.transform("a", _fields)))
    # every part has a segment; for an inner explode the optimizer would filter by the size of m first, and fold again for that
    out = out.select("part_id", "range", "seqs", F.posexplode_outer("m").alias("place", "s"))
    return out.select("part_id", (F.col("place") + 1).cast("long").alias("place"), *[f"s.{c}" for c in FIELDS], F.slice("seqs", F.col("s.at"), F.col("s.k")).alias("seqs"), "range")


def confidence(merged: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds confidence after penalties and the flags of each normalised segment."""
    wall, rel = g.wall_thickness(F.col("od"), F.col("bore")), F.coalesce(F.try_divide(F.col("z1") - F.col("z0"), F.when(F.col("range") > 0, F.col("range"))), F.lit(1.0))
    m = merged.withColumn("wall", wall).withColumn("rel", rel)
    thin, brief = (F.col("wall") > 0) & (F.col("wall") < p.thin_wall), F.col("rel") < p.short_share
    cost = (
        F.when(F.col("k") > 1, F.least(F.lit(0.20), 0.05 * (F.col("k") - 1))).otherwise(0.0) + F.when(F.col("snapped"), 0.05).otherwise(0.0) + F.when(F.col("clamped"), 0.15).otherwise(0.0)
        + F.when(thin, 0.10 * (1 - F.col("wall") / p.thin_wall)).otherwise(0.0) + F.when(brief, 0.10 * (1 - F.col("rel") / p.short_share)).otherwise(0.0)
    )
    m = m.withColumn("confidence", g.clamp(F.col("base") / F.col("k") - cost))
    flags = listed((F.col("k") > 1, "auto_merged"), (F.col("clamped"), "id_assumed_solid"), (thin, "thin_wall"), (brief, "short_segment"), (F.col("confidence") < p.low_confidence, "low_confidence"))
    return m.withColumn("flags", flags)


def overall(merged: DataFrame) -> DataFrame:
    """One row a part: overall (confidence after penalties by length; their mean if there is no length) and total_length."""
    length = F.col("z1") - F.col("z0")
    t = merged.groupBy("part_id").agg(F.sum(length).alias("total_length"), F.sum(length * F.col("confidence")).alias("w"), F.avg("confidence").alias("mean"))
    return t.select("part_id", F.when(F.col("total_length") > 0, F.col("w") / F.col("total_length")).otherwise(F.col("mean")).alias("overall"), "total_length")


#: Of the design: from here on a part goes through by itself, or to a review.
AUTO, REVIEW = 0.85, 0.60


def decide(scored: DataFrame) -> DataFrame:
    """One row a part: overall, n_valid, n, action (auto_use, manual_review or fallback_to_manual).

    scored: part_id, dimension, completeness, consistency (0 to 1 each, by segment), valid, and axis (by part). A segment's
    confidence weighs the three by 0.4, 0.3, 0.3; overall weighs their mean, the axis and the share of valid segments by 0.6,
    0.2, 0.2. By itself goes only a part whose segments are all valid, to a review one that has some. Nulls count as 0; sums that reach a limit but for their last bits have reached it.
    """
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    one = num("dimension") * 0.4 + num("completeness") * 0.3 + num("consistency") * 0.3
    t = scored.groupBy("part_id").agg(F.avg(one).alias("mean"), F.max(num("axis")).alias("axis"), F.count_if("valid").alias("n_valid"), F.count("*").alias("n"))
    t = t.withColumn("overall", 0.6 * F.col("mean") + 0.2 * F.col("axis") + 0.2 * F.col("n_valid") / F.col("n"))
    action = F.when((F.col("overall") >= AUTO - 1e-9) & (F.col("n_valid") == F.col("n")), "auto_use").when((F.col("overall") >= REVIEW - 1e-9) & (F.col("n_valid") > 0), "manual_review").otherwise("fallback_to_manual")
    return t.select("part_id", "overall", "n_valid", "n", action.alias("action"))
