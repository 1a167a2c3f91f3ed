"""Quality rules: distribution divergence against language references.

Each document's histogram of character classes, and that of the common words of several languages, is compared with the
mean histogram of its language by Jensen-Shannon distance. The references are aggregates over all documents of the
language that pass the base rules; a language with few such documents is held against all languages together. A text of
several languages is also held against their references mixed by its own shares of words that only one language has.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swarf.llm.common import SPACE, WORD, let, stage

# Frequent function words of English, French, German and Spanish.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "by", "on", "this", "from", "be", "are", "as", "at", "an"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "est", "pas"],
    "de": ["der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "nicht", "ein", "eine", "im", "dem", "des", "auf", "als", "auch", "sich", "er"],
    "es": ["el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "para", "se", "su", "no", "es", "al", "lo"],
}
WORDS = sorted({w for ws in COMMON.values() for w in ws})
#: Of each language, the places in WORDS of those that no other has.
ALONE = {k: [WORDS.index(w) for w in ws if not any(w in other for j, other in COMMON.items() if j != k)] for k, ws in COMMON.items()}
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:?!'\"()-]", "symbol": r"[#*$%&|<>]", "space": SPACE}


@dataclass(frozen=True)
class Limits:
    """Distances are in [0, 1]. A text shorter than a guard passes that test; slack / sqrt(n) allows for short samples."""

    chars: float = 0.20
    words: float = 0.18
    chars_slack: float = 1.2
    words_slack: float = 1.2
    least_chars: int = 200
    least_words: int = 50
    least_docs: int = 50
    base_words: int = 50
    base_repeat_percent: int = 50


def repeat_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more; windows are compared by a 64-bit hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda p: F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when((F.get(p, j - 1)["h"] == F.get(p, j)["h"]) | (F.get(p, j + 1)["h"] == F.get(p, j)["h"]), F.get(p, j)["i"])), lambda i: i.isNotNull())
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(3))).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(let(pairs, again)), start, step, lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(words) >= 4, let(words, counted)).otherwise(F.lit(0).cast("long"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def share(x: Column) -> Column:
    """Counts as shares of their sum; null without any."""
    return let(total(x), lambda t: F.when(t > 0, F.transform(x, lambda v: v / t)))


def apart(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares; 0 if one is null."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return F.coalesce(F.sqrt(F.greatest(total(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)), F.lit(0.0))), F.lit(0.0))


def distance(p: Column, q: Column) -> Column:
    """The same of two arrays of counts."""
    return let(share(p), lambda a: let(share(q), lambda b: F.when(a.isNotNull() & b.isNotNull(), apart(a, b)).otherwise(F.lit(0.0))))


def histograms(docs: DataFrame, limits: Limits) -> DataFrame:
    """Base figures and both histograms of every document; the text itself goes no further."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE + "+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    common = F.filter(F.transform(words, F.lower), lambda w: w.isin(*WORDS))
    rows = rows.select(
        "doc_id", "lang", F.length("text").alias("n_chars"),
        *[F.regexp_count("text", F.lit(p)).cast("double").alias(k) for k, p in CLASSES.items()],
        F.size(words).cast("long").alias("n_words"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(words).alias("n_repeat_words"),
        let(common, lambda c: F.array(*[(F.size(c) - F.size(F.array_remove(c, w))).cast("double") for w in WORDS])).alias("common"),
    )
    known = sum((F.col(k) for k in CLASSES), F.lit(0.0))
    return rows.select(
        "doc_id", "lang", "n_chars", "n_words", (F.col("n_chars") - F.col("space")).cast("long").alias("word_chars"), F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.base_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.array(*CLASSES, F.col("n_chars") - known).alias("chars"),
        F.concat("common", F.array((F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda s, v: s + v)).cast("double"))).alias("words"),
    )


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A null or empty text has no words and fails the base rules. A null language is one language. Repeated rows are judged
    alike; an empty table gives an empty result.
    """
    rows = stage(histograms(docs, limits), "histograms")
    nc, nw = len(CLASSES) + 1, len(WORDS) + 1
    sums = [F.sum(F.when(~F.col("base_failed"), F.col(k)[i])).alias(f"{k}{i}") for k, n in (("chars", nc), ("words", nw)) for i in range(n)]
    ref = rows.groupBy("lang").agg(F.count_if(~F.col("base_failed")).alias("n"), *sums)
    every = Window.partitionBy()
    pick = lambda c: F.when(F.col("n") >= limits.least_docs, F.col(c)).otherwise(F.sum(c).over(every))
    ref = ref.select("lang", F.array(*[F.coalesce(pick(f"chars{i}"), F.lit(0.0)) for i in range(nc)]).alias("ref_chars"), F.array(*[F.coalesce(pick(f"words{i}"), F.lit(0.0)) for i in range(nw)]).alias("ref_words"))
    ref = ref.withColumn("ref_chars", share(F.col("ref_chars"))).withColumn("ref_words", share(F.col("ref_words")))
    known = [F.coalesce(F.max(F.when(F.col("lang") == k, F.col("ref_words"))).over(every), F.array_repeat(F.lit(0.0), nw)).alias(f"known_{k}") for k in COMMON]
    ref = stage(ref.select("*", *known), "references")
    own = F.array(*[sum((F.col("words")[i] for i in at), F.lit(0.0)) for at in ALONE.values()])

    def blend(o: Column) -> Column:
        """The references weighed by o; each weight is worked out once a row."""
        times = lambda k, weight: F.transform(f"known_{k}", lambda v: v * weight)
        weighed = [times(k, o[i]) for i, k in enumerate(ALONE)]
        return functools.reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a + b), weighed)

    def nearest(p: Column) -> Column:
        mixed = let(share(let(own, blend)), lambda q: F.when(q.isNotNull(), apart(p, q)))
        return F.least(apart(p, F.col("ref_words")), mixed)

    out = rows.join(ref, "lang").withColumn("char_distance", apart(share(F.col("chars")), F.col("ref_chars"))).withColumn("word_distance", let(share(F.col("words")), nearest))
    near = lambda d, n, least, limit, slack: (F.col(n) < least) | (F.col(d) <= limit + slack / F.sqrt(F.greatest(F.col(n), F.lit(1))))
    verdict = near("char_distance", "n_chars", limits.least_chars, limits.chars, limits.chars_slack) & near("word_distance", "n_words", limits.least_words, limits.words, limits.words_slack)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "char_distance", "word_distance")
