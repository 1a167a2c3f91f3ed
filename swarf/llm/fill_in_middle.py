"""Fill-in-middle transformation: a text's middle goes behind its end, so that a model learns to fill gaps.

An Arrow-batched pandas UDF walks each text with the regex library's finditer and keeps the end of every unit in a compact
array. Two look-ups in it give the places where prefix and middle end, and the text is sliced there. Where to cut, and in
which form to write, comes from the SHA-256 of a seed and the doc_id, so that reruns agree and rows need not meet.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import document
from swarf.shipping import ship

#: What stands before prefix, suffix and middle.
TOKENS = ("<P>", "<S>", "<M>")
#: A unit is a code point.
UNIT = r"(?s)."


def ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit of a text ends, in code points; what no unit covers goes to the unit after it, or is one at the end."""
    found = array("I", (m.end() for m in unit.finditer(text)))
    if (found[-1] if found else 0) < len(text):
        found.append(len(text))
    return found


def seeds(seed: str, doc_id: int | None) -> list[int]:
    """Four 32-bit numbers of a document; a null doc_id is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def form_of(text: str, h: list[int], rate: int, spm: int, tokens: tuple[str, str, str]) -> str:
    if not text or any(t in text for t in tokens) or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def written(prefix: str, middle: str, suffix: str, form: str, tokens: tuple[str, str, str] = TOKENS) -> str:
    p, s, m = tokens
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restore(output: str, form: str, tokens: tuple[str, str, str] = TOKENS) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    p, s, m = tokens
    first, second = (p, s) if form == "psm" else (s, p)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(m)
    return a + middle + b if form == "psm" else b + middle + a


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, unit: str = UNIT, tokens: tuple[str, str, str] = TOKENS, carry: bool = True) -> DataFrame:
    """One row per input row: doc_id, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256; and with carry
    output (the text in its form) and row (the whole input row).

    `rate` of 100 texts are cut, `spm` of 100 of these with the suffix first. A null text is an empty one; empty texts and
    such as hold one of `tokens` stay plain, and so does any that would not be restored exactly. A null doc_id has the seed
    alone, so rows without an id and of one length are cut alike, as repeated rows are. Very long texts are read whole, four
    bytes a unit. No row depends on another; an empty table gives an empty result.
    """
    if len(set(tokens)) < 3 or not all(tokens):
        raise ValueError("three different tokens are needed")
    ship(docs.sparkSession)
    kind = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    def cut(doc_id: int | None, text: str | None, pattern: regex.Pattern) -> tuple:
        text = text or ""
        at, h = ends(text, pattern), seeds(seed, doc_id)
        n, form, a, b, output = len(at), form_of(text, h, rate, spm, tokens), None, None, text
        if form != "plain":
            first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            a, b = at[first - 1] if first else 0, at[last - 1] if last else 0
            output = written(text[:a], text[a:b], text[b:], form, tokens)
            if restore(output, form, tokens) != text:
                form, a, b, output = "plain", None, None, text
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (n, form, a, None if a is None else b - a, sha(output), sha(restore(output, form, tokens)), *[output] * carry)

    @F.pandas_udf(kind + ", output string" * carry)
    def transformed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * carry]
        for ids, texts in batches:
            out = pd.DataFrame([cut(None if i is None else int(i), t, pattern) for i, t in zip(ids, texts, strict=True)], columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *[document(docs).alias("row")] * carry)
    # ids go as text: a column of longs with nulls would come as floats, which lose digits
    return rows.withColumn("cut", transformed(F.col("doc_id").cast("string"), "text")).select("doc_id", "cut.*", *["row"] * carry)
