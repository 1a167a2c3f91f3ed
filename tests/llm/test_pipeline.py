"""The corpus pipeline, stage by stage."""

import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from conftest import SF

from swarf.llm import common, quality_model, sentencepiece
from swarf.llm.queries import MODEL_FILE

SPACES = re.compile("[\x20\x09-\x0d]")


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, common.read(spark, SF, "documents")
    for k, (name, f) in enumerate(cp.STAGES):
        after = common.stage(f(spark, docs, SF), name)
        out[name] = (docs, after)
        docs = after
    return out


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "exact", "near", "mixed", "pieces"]
    for name, (before, after) in stages.items():
        if name != "pieces":
            assert after.columns == before.columns


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_quality_drops_what_it_rejects(spark, stages):
    before, after = stages["quality"]
    forest = quality_model.train(before, common.read(spark, SF, "labels"))
    keep = {r["doc_id"] for r in quality_model.classify(before, forest).where("predicted = 1").collect()}
    assert rows(after) == rows(before.where(before.doc_id.isin(list(keep)))) and keep


def test_exact_keeps_one_of_each(stages):
    before, after = stages["exact"]
    best = {}
    for r in before.collect():
        key = SPACES.sub("", r["text"] or "")
        best[key] = min(best.get(key, (1, 1)), (-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for _, i in best.values())


def grams(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_leaves_no_near_copy_and_keeps_the_rest(stages):
    before, after = stages["near"]
    kept = {r["doc_id"]: grams(r["text"]) for r in after.collect()}
    like = lambda a, b: len(a & b) / len(a | b)
    ids = sorted(kept)
    left = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if like(kept[a], kept[b]) >= 0.8]
    assert not left
    every = {r["doc_id"]: grams(r["text"]) for r in before.collect()}
    for i in set(every) - set(kept):
        assert max(like(every[i], g) for j, g in every.items() if j != i) >= 0.8  # a link of its own, be it to one that goes as well


def test_mixed_repeats_whole_rows(stages):
    before, after = stages["mixed"]
    n, was = rows(after), rows(before)
    assert set(n) <= set(was) and max(n.values()) <= 2
    size = lambda c: sum(k * len((r[1] or "").split()) for r, k in c.items())
    assert size(n) == pytest.approx(1.5 * size(was), rel=0.25)


def test_pieces_decode(stages):
    before, after = stages["pieces"]
    m = sentencepiece.lattice(MODEL_FILE)
    assert Counter((r["doc_id"], m.decode(r["ids"])) for r in after.collect()) == Counter((r["doc_id"], r["text"]) for r in before.collect())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated and equal rows, and columns with the operators' names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, uid long, digest string, kept boolean"
    prose = "The of and to in is that for it was with by on this from be are as at an. " * 8
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, prose + "More words here. " * 9, "en", None), (None, None, None, None), (4, " \t", "", ""), (5, prose * 300, "fr", "a"), (6, prose + " end", "en", "a"), (7, "short", "en", "c")]
    return spark.createDataFrame([(*r, None, "clash", 7, "clash", None) for r in rows], schema)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_take_odd_tables(spark, odd, name):
    f = dict(cp.STAGES)[name]
    plain = lambda df: Counter(map(str, df.collect()))
    before, after, none = plain(odd), f(spark, odd, SF), f(spark, odd.limit(0), SF)
    assert none.count() == 0 and after.count() > 0
    if name == "pieces":
        m = sentencepiece.lattice(MODEL_FILE)
        assert Counter((r["doc_id"], m.decode(r["ids"])) for r in after.collect()) == Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
        return
    assert after.columns == odd.columns == none.columns and set(plain(after)) <= set(before)
    if name in ("exact", "near"):
        texts = [" ".join((r["text"] or "").split()) for r in after.collect()]
        assert plain(after) <= before and len(texts) == len(set(texts)) and set(texts) <= {" ".join((r["text"] or "").split()) for r in odd.collect()}
    if name == "exact":
        assert len(texts) == len({"".join((r["text"] or "").split()) for r in odd.collect()}) and 1 in [r["doc_id"] for r in after.collect()]
    if name == "quality":
        assert plain(after) <= before
    if name == "mixed":
        assert all(k <= 2 * before[r] for r, k in plain(after).items())


def test_run_gives_the_last_stage(spark, stages):
    assert rows(cp.run(spark, SF).select("doc_id", "n_pieces")) == rows(stages["pieces"][1].select("doc_id", "n_pieces"))
