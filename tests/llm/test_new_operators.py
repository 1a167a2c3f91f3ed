"""Line dedup, lexical search and fill-in-middle against plain Python, and on odd tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
import regex
from conftest import SF
from pyspark.sql import functions as F

from swarf.llm import common, fill_in_middle, lexical, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, key string, term int, place int"
LONG = "\n".join(f"line {k % 700} ünï" for k in range(40_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, equal and repeated rows, and columns with the operators' names."""
    rows = [
        (1, "Same line\nown line\n\tSAME LINE \r\n", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, " \t\n\n", "fr", None), (5, LONG, "en", "a"), (6, LONG + "\nend", "en", "a"),
        (None, "same line", "en", "a"), (7, "x\nSame Line\x0b", None, "a"), (7, "x\nSame Line\x0b", None, "a"), (8, "ÉCOLE same\x00line 😀\nécole", "xx", ""),
        (None, None, None, None), (9, "has <S> in it", "en", "c"), (9, "same id, other text", "en", "c"), (10, "a<\n<P\n<", "en", "c"), (-11, "same same line", "en", "c"),
    ]
    return spark.createDataFrame([(*r, None, "clash", 7, "clash", 3, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, SF, "documents")


def ascii_lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


# ---- 11 ----


def without_shared_lines(rows, documents, least):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    out = []
    for doc_id, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if n[key(x)] < documents]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return Counter(out)


@pytest.mark.parametrize(("documents", "least"), [(10, 1), (2, 1), (3, 8), (1, 1)])
def test_line_dedup(docs, odd, documents, least):
    for df in (docs, odd):
        got = line_dedup.line_dedup(df, documents, least)
        assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()) == without_shared_lines([(r["doc_id"], r["text"]) for r in df.collect()], documents, least)
        assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, df.collect()))


def test_line_dedup_of_nothing(odd):
    out = line_dedup.line_dedup(odd.limit(0))
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "text", "row"] and out.count() == 0


def test_a_line_that_all_documents_share(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('The Licence\n', id, '\n the licence') as text")
    got = line_dedup.line_dedup(df)
    assert got.where("text = cast(doc_id as string) and n_dropped = 2 and n_lines = 3").count() == 20_000


# ---- 12 ----


def ranked(rows, items, k):
    """item_id, rank, doc_id, score by the formula, in whole numbers."""
    cut = lambda t: [ascii_lower(x) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, Counter(ts), len(ts)) for i, t in rows if (ts := cut(t))]
    n, total, df = len(docs), sum(d[2] for d in docs), Counter(t for d in docs for t in d[1])
    out = []
    for item_id, text in {(i, t) for i, t in items}:
        scores = []
        for i, held, many in docs:
            m = 50 + 50 * many * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * held[t] // (1000 * held[t] + 20 * m)) for t in set(cut(text)) if t in held)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 15])
def test_search_in_windows_and_blocks(spark, docs, odd, window):
    asked = [(1, "same line"), (2, "SAME same école écolE 😀 line 5"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (None, "line x"), (1, "same line"), (1, "other text"), (6, " ".join(str(k) for k in range(3000)))]
    items = spark.createDataFrame([(i, t, "clash") for i, t in asked], "item_id long, text string, doc_id string")
    want = ranked([(r["doc_id"], r["text"]) for r in odd.collect()], [a for a in asked if a[1]], 3)
    for block in (1 << 23, 5000):
        got = lexical.search(odd, items, 3, window, block)
        assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == want


def test_search_ties_go_to_the_smaller_id(spark):
    docs = spark.range(5000).selectExpr("5000 - id as doc_id", "case when id % 2 = 0 then 'alpha beta' else 'gamma delta' end as text").repartition(16)
    got = lexical.search(docs, spark.createDataFrame([(1, "beta")], "item_id long, text string"), 50, 100).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(2, 102, 2)) and [r["rank"] for r in got] == list(range(1, 51)) and len({r["score"] for r in got}) == 1


def test_search_of_nothing(spark, docs, odd):
    none, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(odd, none).count() == 0 and lexical.search(odd.limit(0), item).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string"), item).count() == 0


# ---- 13 ----


def cut(doc_id, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (doc_id, n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m) if h[3] % 100 < 20 else (doc_id, n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m)


def test_fill_in_middle(spark, docs, odd):
    for df in (docs, odd):
        out = fill_in_middle.fill_in_middle(df)
        got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
        assert Counter(map(tuple, got)) == Counter(cut(r["doc_id"], r["text"]) for r in df.collect())
        assert {r["form"] for r in got} >= {"plain", "psm"}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for r in out.select("output", "form", "output_sha256", "restored_sha256", F.col("row.text").alias("text")).collect():
            assert fill_in_middle.restore(r["output"], r["form"]) == (r["text"] or "")
            assert r["output_sha256"] == sha(r["output"]) and r["restored_sha256"] == sha(r["text"] or "")
        assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, df.collect()))
        assert fill_in_middle.fill_in_middle(df.limit(0)).count() == 0
        again = fill_in_middle.fill_in_middle(df.repartition(3), carry=False)
        assert sorted(map(str, again.select("output_sha256").collect())) == sorted(map(str, out.select("output_sha256").collect()))


def test_large_ids_keep_all_digits(spark):
    ids = [(1 << 62) + 1, (1 << 62) + 2, -5, None]
    out = fill_in_middle.fill_in_middle(spark.createDataFrame([(i, "abcdefghij" * 9) for i in ids], "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out) == Counter(cut(i, "abcdefghij" * 9) for i in ids)


def test_units_of_words_and_what_none_covers(spark):
    """Cuts fall behind words only; what stands after the last is a unit as well."""
    text = "one two  three, four!\n"
    assert list(fill_in_middle.ends(text, regex.compile(r"\w+"))) == [3, 7, 14, 20, 22]
    out = fill_in_middle.fill_in_middle(spark.range(300).selectExpr("id as doc_id", f"'{text[:-1]}\\n' as text"), rate=100, unit=r"\w+").collect()
    at = {0, 3, 7, 14, 20, 22}
    assert all(r["n"] == 5 and r["prefix_chars"] in at and r["prefix_chars"] + r["middle_chars"] in at for r in out) and {r["form"] for r in out} == {"psm", "spm"}


@pytest.mark.parametrize("tokens", [("ab", "ba", "aa"), ("<", "<<", "<<<")])
def test_never_a_form_that_is_not_restored(spark, tokens):
    """Tokens whose ends can run into the text: such rows stay plain."""
    docs = spark.range(200).selectExpr("id as doc_id", "substr('bxaxbbxa<xx', 1, 1 + cast(id % 11 as int)) as text")
    for r in fill_in_middle.fill_in_middle(docs, rate=100, tokens=tokens).collect():
        assert fill_in_middle.restore(r["output"], r["form"], tokens) == r["row"]["text"]
    with pytest.raises(ValueError):
        fill_in_middle.fill_in_middle(docs, tokens=("<P>", "<P>", "<M>"))
