import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(1)
    cells = [rng.integers(0, k, 200) for k in (4, 3, 5)]
    tokens = rng.uniform(10, 100, 200)
    targets = [t / t.sum() * tokens.sum() for t in (rng.uniform(1, 3, k) for k in (4, 3, 5))]
    weight = mixing.rake(cells, tokens, targets, 200)
    for value, target in zip(cells, targets, strict=True):
        assert np.allclose(np.bincount(value, weights=tokens * weight), target, rtol=1e-6)


@pytest.fixture
def docs(make, words):
    sources = ["big"] * 200 + ["mid"] * 60 + ["small"] * 20 + [None] * 10
    return make([(i, words(5 + i % 40, i), "en" if i % 3 else "de", s) for i, s in enumerate(sources)])


def test_rare_values_weigh_more_and_weights_undo_the_cap(docs):
    got = mixing.mixed(docs).collect()
    by = lambda s: [r["__p"] for r in got if r.row.source == s]
    assert np.mean(by("big")) < np.mean(by("mid")) < np.mean(by("small"))
    assert all(0 < r["__p"] <= 1 and r["__weight"] >= 1 - 1e-9 for r in got)


def test_the_same_in_spark(docs):
    few = {r.row.doc_id: (r["__p"], r["__kept"]) for r in mixing.mixed(docs).collect()}
    many = {r.row.doc_id: (r["__p"], r["__kept"]) for r in mixing.mixed(docs, most=0).collect()}
    assert few.keys() == many.keys()
    assert all(abs(few[d][0] - many[d][0]) < 1e-9 and few[d][1] == many[d][1] for d in few)


def test_sample_has_the_rows_columns_and_is_fixed(docs):
    a, b = mixing.sampled(docs), mixing.sampled(docs.repartition(7))
    assert a.columns == docs.columns
    assert sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
    assert a.join(docs, docs.columns, "left_anti").count() == a.filter(F.col("source").isNull()).count()


def test_odd_rows(odd, make):
    docs, rows = odd
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    twos = {(r["__p"], r["__kept"]) for r in got if r.row.doc_id == 2}
    assert len(twos) == 1
    assert {r["__topic"] for r in got if not (r.row.text or "").strip(" ")} == {"blank"}
    assert mixing.sampled(make([])).count() == 0


@pytest.fixture
def rare(make):
    """A source of four fifths, and ten of a fiftieth each, of which the targets ask for more than there is."""
    return make([(i, "one two three four five", "de" if i % 4 == 0 else "en", "big" if i < 1600 else f"rare{i % 10}") for i in range(2000)])


def test_the_sample_itself_meets_the_targets(rare):
    kept = [(r.source, r.lang) for r in mixing.sampled(rare).collect()]
    assert abs(len(kept) / 2000 - 0.5) < 0.03
    assert all(sum(s == f"rare{n}" for s, _ in kept) == 40 for n in range(10))  # all there is
    de = 0.5 / (0.5 + 0.75**0.5)
    assert abs(sum(lang == "de" for _, lang in kept) / len(kept) - de) < 0.03


def test_probabilities_under_the_cap_meet_attainable_targets(rare):
    few = {r.row.doc_id: r["__p"] for r in mixing.mixed(rare, capped=True).collect()}
    many = {r.row.doc_id: r["__p"] for r in mixing.mixed(rare, most=0, capped=True).collect()}
    assert max(few.values()) <= 1 and abs(sum(few.values()) - 1000) < 2
    assert few.keys() == many.keys() and all(abs(few[d] - many[d]) < 1e-6 for d in few)


def test_names_of_columns(spark):
    fields = "doc_id long, text string, source string, lang string, f int, __p int, __weight int, __kept int, __source int, __topic int, __tokens int, topic int, row int"
    rows = [(i, "a few words", f"s{i % 2}", "en", *range(9)) for i in range(40)]
    docs = spark.createDataFrame(rows, fields)
    for capped in (True, False):
        got = mixing.mixed(docs, capped=capped)
        assert sorted(tuple(r.row) for r in got.collect()) == rows
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns and set(map(tuple, kept.collect())) <= set(rows)
