"""Small random surveys against a slow model in plain Python."""

import math
import random

import numpy as np
import pytest

from tallyloom.functions import logic as lg
from tallyloom.functions.special import chi2_upper, f_upper, t_two_sided
from tallyloom.meta import Meta
from tallyloom.operators import weighting
from tallyloom.plans import sigtests, tabulate
from tallyloom.survey import Survey

WEIGHTS = [0.2, 0.5, 1.0, 2.0, None]
FIELDS = "id long, a int, b int, s array<int>, n double, w double"


def rows_of(seed, n):
    """a: single 1..3 and a code (9) that the metadata lack; b: single 1..2; s: set 1..4; n: number; w: weight."""
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.15 else x
    return [(i, some(rng.choice([1, 2, 3, 9])), some(rng.choice([1, 2])), some(sorted(rng.sample([1, 2, 3, 4, 8], rng.randint(1, 3)))), some(float(rng.randint(-3, 6))), rng.choice(WEIGHTS)) for i in range(n)]


def survey_of(spark, rows):
    meta = Meta()
    meta.add("a", "single", "A", [(1, "one"), (2, "two"), (3, "three")])
    meta.add("b", "single", "B", [(1, "x"), (2, "y")])
    meta.add("s", "delimited set", "S", [(c, f"s{c}") for c in range(1, 5)])
    for n, kind in (("id", "int"), ("n", "float"), ("w", "float")):
        meta.add(n, kind, n)
    return Survey(spark.createDataFrame(rows, FIELDS), meta)


CODES = {"a": [1, 2, 3], "b": [1, 2], "s": [1, 2, 3, 4]}
AT = {"id": 0, "a": 1, "b": 2, "s": 3, "n": 4, "w": 5}


def codes(row, name):
    v = row[AT[name]]
    return [c for c in (v if isinstance(v, list) else [v]) if c in CODES[name]] if v is not None else []


def weight(row, w):
    return 1.0 if w is None else row[AT[w]] or None


def cells(rows, x, y, w=None, exclude=(), base_all=False, where=lambda r: True):
    """{(x code, y code): weighted count} with margins."""
    out = {(a, b): 0.0 for a in ["All", *(str(c) for c in CODES[x] if c not in exclude)] for b in ["@", *(map(str, CODES[y]) if y else ())]}
    for r in rows:
        xs = codes(r, x)
        ys = codes(r, y) if y else []
        if not where(r) or set(exclude) & set(xs) or not xs or y and not ys and not base_all or weight(r, w) is None:
            continue
        for a in ["All", *map(str, xs)]:
            for b in ["@", *map(str, ys)]:
                out[a, b] += weight(r, w)
    return out


def got_cells(df, column="w"):
    return {(r.x_code, r.y_code): r[column] for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None) and (a[k] is None or math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-9)), (k, a[k], b[k])


@pytest.fixture(scope="module", params=[(1, 40), (2, 25), (3, 0)], ids=str)
def small(request, spark):
    rows = rows_of(*request.param)
    return survey_of(spark, rows), rows


@pytest.mark.parametrize(("x", "y", "w"), [("a", "b", None), ("a", "s", "w"), ("s", "s", "w"), ("s", None, "w"), ("b", "a", None)])
def test_counts(small, x, y, w):
    s, rows = small
    same(got_cells(tabulate.cells(s, x, y, w)), cells(rows, x, y, w))


def test_base_rules(small):
    s, rows = small
    same(got_cells(tabulate.cells(s, "a", "b", base_all=True)), cells(rows, "a", "b", base_all=True))
    same(got_cells(tabulate.cells(s, "s", "b", "w", exclude=[2])), cells(rows, "s", "b", "w", exclude=[2]))
    same(got_cells(tabulate.cells(s, "a", "b", None, {"s": [1, 3]})), cells(rows, "a", "b", where=lambda r: bool({1, 3} & set(r[3] or []))))


def test_nets_count_respondents_once(small):
    s, rows = small
    table = got_cells(tabulate.cells(s, "s", "b", "w", nets=tabulate.nets_of([{"low": [1, 2]}, {"high": [3, 4]}], "after")))
    for name, own in (("low", {1, 2}), ("high", {3, 4})):
        want = 0.0
        for r in rows:
            if codes(r, "s") and codes(r, "b") and r[5] is not None and own & set(codes(r, "s")):
                want += r[5]
        assert math.isclose(table[f"net:{name}", "@"], want, abs_tol=1e-9)
        assert table[f"net:{name}", "@"] <= sum(table[str(c), "@"] for c in own) + 1e-9


def test_fused_is_the_single_links(small):
    s, rows = small
    made = tabulate.fused(s, ["a", "s"], ["b", "s"], [None, "w"])
    for x in ("a", "s"):
        for y in ("@", "b", "s"):
            for w in (None, "w"):
                own = made.filter((made.x_var == x) & (made.y_var == y) & (made.weight == (w or "")))
                same(got_cells(own), cells(rows, x, None if y == "@" else y, w))


def percentile(scored, p):
    """Definition 6, k = (W + 1) p; rows of equal score in order of id."""
    scored = sorted(scored)
    c = np.cumsum([w for *_, w in scored])
    k = (c[-1] + 1) * p
    if len(scored) == 1 or c[0] > k:
        return scored[0][0]
    if c[-1] <= k:
        return scored[-1][0]
    j = max(i for i in range(len(c)) if c[i] <= k)
    e, v = k - c[j], scored[j + 1][2]
    a, b = scored[j][0], scored[j + 1][0]
    return b if e >= 1 else (1 - e) * a + e * b if v >= 1 else (1 - e / v) * a + e / v * b


@pytest.mark.parametrize("w", [None, "w"])
def test_statistics(small, w):
    s, rows = small
    got = {r.y_code: r for r in tabulate.summarize(s, "n", "b", w, order="id").collect()}
    for y in ("@", "1", "2"):
        own = [(r[4], r[0], weight(r, w)) for r in rows if r[4] is not None and codes(r, "b") and weight(r, w) is not None and y in ("@", str(r[2]))]
        total = sum(x[2] for x in own)
        assert math.isclose(got[y].base, total, abs_tol=1e-9)
        if not own:
            assert got[y]["mean"] is None
            continue
        mean = sum(v * q for v, _, q in own) / total
        assert math.isclose(got[y]["mean"], mean, abs_tol=1e-9)
        assert (got[y]["min"], got[y]["max"]) == (min(own)[0], max(own)[0])
        var = sum(q * (v - mean) ** 2 for v, _, q in own) / (total - 1) if total != 1 else 0
        assert math.isclose(got[y]["var"] or 0, var if var > 1e-12 else 0, abs_tol=1e-9)
        if w is None:  # ties of unequal small weights have no one answer
            for name, p in (("lower_q", 0.25), ("median", 0.5), ("upper_q", 0.75)):
                assert math.isclose(got[y][name], percentile(own, p), abs_tol=1e-9), (y, name)


SPECS = [
    {"x": "a"},
    {"x": "b", "exclude": [2]},
    {"x": "s", "factors": {1: 10.0, 3: -2.0}, "drop": True},
    {"x": "n"},
    {"x": "n", "exclude": [0]},
    {"x": "s", "source": "n"},
    {"x": "n", "source": "s"},
]


def scored(row, spec):
    """The factors of a row's codes, or its number; none if it doesn't take part."""
    source = spec.get("source", spec["x"])
    if source != spec["x"] and not (codes(row, spec["x"]) if spec["x"] in CODES else row[AT[spec["x"]]] is not None):
        return []
    if source not in CODES:
        v = row[AT[source]]
        return [] if v is None or v in spec.get("exclude", ()) else [v]
    own = codes(row, source)
    if set(own) & set(spec.get("exclude", ())):
        return []
    by = {**({} if spec.get("drop") else {c: float(c) for c in CODES[source]}), **spec.get("factors", {})}
    return [by[c] for c in own if c in by]


@pytest.mark.parametrize("limit", [tabulate.MOST_ANSWERS, 0])
def test_fused_statistics(small, limit, monkeypatch):
    """Whether rows collapse or not."""
    monkeypatch.setattr(tabulate, "MOST_ANSWERS", limit)
    s, rows = small
    got = {(r.spec, r.y_var, r.y_code, r.weight): r for r in tabulate.fused_stats(s, SPECS, ["b", "s"], [None, "w"]).collect()}
    assert len(got) == len(SPECS) * 9 * 2
    for (i, y, c, w), r in got.items():
        heads = lambda row, y=y, c=c: y == "@" or bool(codes(row, y)) and c in ("@", *map(str, codes(row, y)))
        own = [(f, weight(row, w or None)) for row in rows if (f := scored(row, SPECS[i])) and heads(row) and weight(row, w or None) is not None]
        total = sum(q for _, q in own)
        same({"base": r["base"], "b2": r["b2"]}, {"base": total, "b2": sum(q * q for _, q in own)})
        if not own:
            assert all(r[k] is None for k in tabulate.MOMENT_STATS)
            continue
        mean = sum(sum(f) * q for f, q in own) / total
        same({k: r[k] for k in ("mean", "min", "max")}, {"mean": mean, "min": min(sum(f) for f, _ in own), "max": max(sum(f) for f, _ in own)})
        if not math.isclose(total, 1):
            var = sum(q * (v - mean) ** 2 for f, q in own for v in f) / (total - 1)
            assert math.isclose(r["var"] or 0, var if var > 1e-12 else 0, abs_tol=1e-9), (i, y, c, w)


def test_arrays_are_made_of_collapsed_rows(spark):
    """No array is made, nor asked for its size, of each respondent: the optimizer must leave such tests above the aggregation."""
    s = survey_of(spark, rows_of(5, 20))
    for made in (tabulate.fused(s, ["a", "s"], ["b", "s"], [None, "w"]), tabulate.fused_stats(s, [{"x": "a"}, {"x": "s"}], ["b", "s"], [None, "w"]), tabulate.cells(s, "a", "b", "w")):
        below = made._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate [")[2].split("\n", 1)[1]
        assert "lambda" not in below and "size(" not in below and "Generate" not in below, below


LOGICS = {
    "any": (lg.has_any([1, 3]), lambda v: bool({1, 3} & set(v or []))),
    "any only": (lg.has_any([1, 3], True), lambda v: bool({1, 3} & set(v or [])) and not set(v) - {1, 3}),
    "not any": (lg.not_any([1, 3]), lambda v: not {1, 3} & set(v or [])),
    "not any, answered": (lg.not_any([1, 3], True), lambda v: v is not None and not {1, 3} & set(v)),
    "all": (lg.has_all([1, 2]), lambda v: {1, 2} <= set(v or [])),
    "not all": (lg.not_all([1, 2]), lambda v: not {1, 2} <= set(v or [])),
    "count": (lg.has_count([1, 2]), lambda v: 1 <= len(v or []) <= 2),
    "none": (lg.has_count(0), lambda v: not v),
    "count of": (lg.has_count([1, 2, [1, 2, 3]]), lambda v: 1 <= len(set(v or []) & {1, 2, 3}) <= 2),
    "compared": (lg.has_count([lg.is_ge(2)]), lambda v: len(v or []) >= 2),
    "not count": (lg.not_count(1), lambda v: v is not None and len(v) != 1),
    "union": (lg.union([lg.has_any([1]), lg.has_any([4])]), lambda v: bool({1, 4} & set(v or []))),
    "difference": (lg.difference([lg.has_any([1, 2]), lg.has_any([3])]), lambda v: bool({1, 2} & set(v or [])) and 3 not in v),
    "symmetric": (lg.symmetric_difference([lg.has_any([1]), lg.has_any([2])]), lambda v: (1 in (v or [])) != (2 in (v or []))),
}


def test_logic(small):
    s, rows = small
    names = list(LOGICS)
    got = {r.id: r for r in s.df.select("id", *[s.logic({"s": LOGICS[n][0]}).alias(n) for n in names]).collect()}
    for r in rows:
        for n in names:
            assert got[r[0]][n] is LOGICS[n][1](r[3]), (n, r[3])


@pytest.mark.parametrize(
    ("logic", "key"),
    [
        (lg.has_any([1, 2]), "x[{1,2}]:y"), (lg.has_all([1, 2]), "x[{1&2}]:y"), (lg.not_any([1]), "x[~{1}]:y"), (lg.has_any([1], True), "x[e{1}]:y"),
        (lg.is_gt(5), "x[(>5)]:y"), (lg.union([lg.has_any([1]), lg.has_any([2])]), "x[({1},{2})]:y"),
    ],
)
def test_logic_keys(logic, key):
    assert lg.logic_key(logic) == key


@pytest.mark.parametrize("bad", [lambda: lg.has_any("1"), lambda: lg.has_any([1.5]), lambda: lg.is_lt("x"), lambda: lg.union(3), lambda: lg.has_count([1, 2, [3], 4])])
def test_logic_arguments(bad):
    with pytest.raises((TypeError, IndexError)):
        bad()


def test_recode_rules(small):
    s, rows = small
    s = s.clone()
    s.derive("d", "single", "D", [(1, "one", {"a": [1]}), (2, "any", {"s": [1, 2]})])
    got = {r.id: r.d for r in s.df.select("id", "d").collect()}
    for r in rows:  # of several that hold the later code wins
        assert got[r[0]] == (2 if {1, 2} & set(r[3] or []) else 1 if r[1] == 1 else None)
    s.derive("m", "delimited set", "M", [(1, "one", {"a": [1]}), (2, "any", {"s": [1, 2]})])
    got = {r.id: r.m for r in s.df.select("id", "m").collect()}
    for r in rows:
        assert got[r[0]] == ([c for c, hit in ((1, r[1] == 1), (2, bool({1, 2} & set(r[3] or [])))) if hit] or None)


def test_overlaps_and_tests(spark):
    rows = rows_of(11, 400)
    s = survey_of(spark, rows)
    got = {(r.y1, r.y2): r.ov for r in sigtests.overlaps(s, "a", "s").collect()}
    for i in range(1, 5):
        for j in range(i + 1, 5):
            assert got.get((str(i), str(j)), 0) == sum(codes(r, "a") != [] and {i, j} <= set(r[3] or []) for r in rows)
    pairs = sigtests.proportions(s, "a", "b", p_values=True).collect()
    table = cells(rows, "a", "b")
    for r in pairs:
        k1, k2, b1, b2 = table[r.x_code, "1"], table[r.x_code, "2"], table["All", "1"], table["All", "2"]
        p = (k1 + k2) / (b1 + b2)
        t = (k1 / b1 - k2 / b2) / math.sqrt(p * (1 - p) * (1 / b1 + 1 / b2))
        assert math.isclose(r.t, t, rel_tol=1e-9) and r.dof == b1 + b2 - 2
        assert math.isclose(r.p, float(t_two_sided(t, r.dof)), rel_tol=1e-9)


def test_tail_probabilities():
    # values of printed tables
    assert math.isclose(float(t_two_sided(2.228, 10)), 0.05, abs_tol=2e-5)
    assert math.isclose(float(t_two_sided(1.96, 1e7)), 0.05, abs_tol=1e-5)
    assert math.isclose(chi2_upper(3.841, 1), 0.05, abs_tol=2e-5) and math.isclose(chi2_upper(18.307, 10), 0.05, abs_tol=2e-5)
    assert math.isclose(float(f_upper(4.965, 1, 10)), 0.05, abs_tol=2e-5)


def test_raked_margins_meet_their_targets(spark):
    rows = [r for r in rows_of(7, 300)]
    s = survey_of(spark, rows)
    scheme = weighting.Scheme("t").targets([{"a": {1: 50, 2: 30, 3: 20}}, {"b": {1: 40, 2: 60}}])
    s.weight(scheme, "rim")
    got = [(r.a, r.b, r.rim) for r in s.df.select("a", "b", "rim").collect()]
    whole = [(a, b, w) for a, b, w in got if a in (1, 2, 3) and b is not None]
    total = sum(w for *_, w in whole)
    for code, share in ((1, 50), (2, 30), (3, 20)):
        assert math.isclose(100 * sum(w for a, _, w in whole if a == code) / total, share, abs_tol=0.2)
    for code, share in ((1, 40), (2, 60)):
        assert math.isclose(100 * sum(w for _, b, w in whole if b == code) / total, share, abs_tol=0.2)
    assert all(w == 1 for a, b, w in got if a not in (1, 2, 3) or b is None)  # rows without a code of some target


def test_capped_weights_stay_within():
    cells_ = [{"a": 1}, {"a": 2}]
    w, _ = weighting.rake(cells_, np.array([90.0, 10.0]), [{"a": {1: 50, 2: 50}}], cap=3.0)
    assert w.max() <= 3.0 + 1e-6 and math.isclose(float((w * [90, 10]).sum()), 100, rel_tol=1e-6)
    with pytest.raises(ValueError, match="not 100"):
        weighting.Scheme("t").targets({"a": {1: 50, 2: 40}})
