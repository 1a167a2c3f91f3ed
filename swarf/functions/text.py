"""Text of drawings and of explanations: dimensions, fractions, hints, lists of ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of dimensions in inches, tried one after the other.
DIMENSIONS = (r"(\d+\.\d+)\s*[\"']", r"(\d+\.\d+)\s*in", r"(\d+\.\d+)", r"(\d+)[-–](\d+)/(\d+)")
#: Brackets as near as this on both sides mark a metric value.
BRACKET = 10


def dimensions(texts: DataFrame, distinct: bool = False) -> DataFrame:
    """From key, text: key, pattern, at, value, match of every dimension; a value that two patterns find comes twice.

    Offsets are needed to look for brackets, hence pandas. distinct keeps the first of equal values at one place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text in zip(b["key"], b["text"].fillna(""), strict=True):
                places = set()
                for k, pattern in enumerate(DIMENSIONS):
                    for m in re.finditer(pattern, text, re.IGNORECASE):
                        a, z = m.span()
                        if "[" in text[max(0, a - BRACKET) : a] and "]" in text[z : z + BRACKET]:
                            continue
                        if k == 3 and not float(m[3]):
                            continue
                        value = float(m[1]) + float(m[2]) / float(m[3]) if k == 3 else float(m[1])
                        if distinct and (a, value) in places:
                            continue
                        places.add((a, value))
                        out.append((key, k, a, value, m[0]))
            yield pd.DataFrame(out, columns=["key", "pattern", "at", "value", "match"])

    return texts.mapInPandas(run, "key long, pattern long, at long, value double, match string")


def fraction(x: Column) -> Column:
    """1-1/4 as 1.25; null where it is no fraction."""
    part = lambda k: F.regexp_extract(x, r"^(\d+)[-–](\d+)/(\d+)$", k).try_cast("double")
    return part(1) + F.try_divide(part(2), part(3))


def ranges(numbers: Column) -> Column:
    """An ascending list as text: [1, 2, 3, 5, 6] is '1-3 and 5-6', three or more take ', and '."""
    end = lambda acc: F.element_at(acc, -1)
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(pair(end(acc)["a"], x)))
        return F.when((F.size(acc) > 0) & (end(acc)["b"] + 1 == x), longer).otherwise(F.concat(acc, F.array(pair(x, x))))

    pairs = F.aggregate(numbers.cast("array<bigint>"), F.array().cast("array<struct<a:bigint,b:bigint>>"), step)
    said = F.transform(pairs, lambda p: F.when(p["a"] == p["b"], p["a"].cast("string")).otherwise(F.concat_ws("-", p["a"].cast("string"), p["b"].cast("string"))))
    n = F.size(said)
    head = F.array_join(F.slice(said, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.element_at(said, 1)).when(n == 2, F.concat(head, F.lit(" and "), F.element_at(said, -1))).otherwise(F.concat(head, F.lit(", and "), F.element_at(said, -1)))


# How a flag reads in a sentence about several sections.
FLAGS = {"auto_merged": "were automatically merged", "id_assumed_solid": "had ID assumed as solid", "thin_wall": "have thin walls", "short_segment": "are short segments", "low_confidence": "have low confidence", "boundary_snapped": "had boundaries snapped"}


def explanation(stacks: DataFrame, units: str = "in") -> DataFrame:
    """From part_id, seg (ordered array of z_start, z_end, od, bore, confidence, flags), overall: a paragraph in English."""
    seg, n, overall = F.col("seg"), F.size("seg"), F.col("overall")
    where = lambda cond: F.filter(F.transform(seg, lambda s, i: F.when(cond(s), i + 1)), lambda x: x.isNotNull())

    def sentence(list_: Column, one: str, many: str) -> Column:
        """one and many with {} for the list, and {n} for its length."""
        put = lambda t, x: F.concat(*[F.lit(p) if p not in ("{}", "{n}") else (x if p == "{}" else F.size(list_).cast("string")) for p in re.split(r"(\{n?\})", t) if p])
        return F.when(F.size(list_) == 1, put(one, F.element_at(list_, 1).cast("string"))).when(F.size(list_) > 1, put(many, ranges(list_)))

    longest = F.aggregate(F.transform(seg, lambda s, i: F.struct((s["z_end"] - s["z_start"]).alias("l"), (i + 1).alias("i"))), F.struct(F.lit(0.0).alias("l"), F.lit(1).alias("i")), lambda a, s: F.when(s["l"] > a["l"], s).otherwise(a))
    thin = where(lambda s: ((s["od"] - s["bore"]) / 2 > 0) & ((s["od"] - s["bore"]) / 2 < 0.05))
    bores, low = where(lambda s: s["bore"] > 0), where(lambda s: overall.isNotNull() & (s["confidence"] < 0.65))
    bore = F.when(F.size(bores) == 0, "No internal bore detected (solid part).").when(F.size(bores) == n, "Internal bore is present throughout all sections.").otherwise(sentence(bores, "Internal bore appears only in section {}.", "Internal bore appears in sections {}."))
    order = F.array_distinct(F.flatten(F.transform(seg, lambda s: F.coalesce(s["flags"], F.array().cast("array<string>")))))

    def flagged(flag: Column) -> Column:
        mine = F.filter(F.transform(seg, lambda s, i: F.when(F.array_contains(s["flags"], flag), i + 1)), lambda x: x.isNotNull())
        said = F.replace(flag, F.lit("_"), F.lit(" "))
        for k, v in FLAGS.items():
            said = F.when(flag == k, v).otherwise(said)
        single = F.when(said.startswith("have"), F.concat(F.lit("has"), F.substring(said, F.lit(5), F.length(said)))).otherwise(said)
        return F.when(F.size(mine) == 1, F.concat(F.lit("Section "), F.element_at(mine, 1).cast("string"), F.lit(" "), single, F.lit("."))).otherwise(F.concat(F.lit("Sections "), ranges(mine), F.lit(" "), said, F.lit(".")))

    level = F.when(overall >= 0.85, "high").when(overall >= 0.65, "medium").otherwise("low")
    said = F.concat_ws(
        " ", F.concat(F.lit("This part has "), n.cast("string"), F.when(n == 1, " turned section.").otherwise(" turned sections.")),
        F.when(longest["l"] > 0, F.concat(F.lit("The longest section is "), F.format_string("%.2f", longest["l"]), F.lit(f" {units} (section "), longest["i"].cast("string"), F.lit(")."))),
        sentence(thin, "One thin-wall area was detected in section {} and needs review.", "{n} thin-wall areas were detected in sections {} and need review."), bore,
        sentence(low, "Section {} has low confidence and may need manual review.", "Sections {} have low confidence and may need manual review."),
        F.array_join(F.transform(order, flagged), " "),
        F.when(overall.isNotNull(), F.concat(F.lit("Overall detection confidence is "), level, F.format_string(" (%.0f%%).", overall * 100))),
    )
    text = F.when(n == 0, "No segments found in this part.").otherwise(F.trim(F.regexp_replace(said, "  +", " ")))
    return stacks.select("part_id", text.alias("explanation"))


def step_label(radius: Column, z0: Column, z1: Column) -> Column:
    head = F.format_string("Ø%.3f", radius * 2)
    return F.when(F.abs(z0) < 0.01, F.concat(head, F.format_string(" up to %.3f", z1))).otherwise(F.concat(head, F.format_string(" from %.3f to %.3f", z0, z1)))
