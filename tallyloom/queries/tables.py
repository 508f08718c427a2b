"""Counts, percents, nets, statistics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logic import has_any, has_count, is_ge
from ..plans import rules, sigtests, tabulate
from ..plans.tabulate import Net
from .data import GRID, LINES, ORDERS, USERS, grid, lines, orders, users

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def values(df: DataFrame, column: str = "w", digits: int = 5) -> DataFrame:
    return df.select("x_code", "y_code", F.round(F.col(column).cast("double"), digits).alias("value"))


#: x, y and w of rows to cells with margins; xs and ys are lists.
def cell_sql(base: str, rows: str, x_codes: list[int], y_codes: list[int] | None, value: str = "coalesce(sum(w), 0)") -> str:
    xs = ", ".join(f"'{c}'" for c in ["All", *x_codes])
    ys = ", ".join(f"'{c}'" for c in ["@", *(y_codes or [])])
    return f"""WITH {base}, r AS ({rows}),
e AS (SELECT w, unnest(list_prepend('All', list_transform(xs, lambda c: CAST(c AS VARCHAR)))) AS x_code, ys FROM r),
f AS (SELECT w, x_code, unnest(list_prepend('@', list_transform(ys, lambda c: CAST(c AS VARCHAR)))) AS y_code FROM e),
s AS (SELECT x_code, y_code, sum(w) AS w, sum(w * w) AS w2 FROM f GROUP BY ALL),
fr AS (SELECT * FROM (SELECT unnest([{xs}]) AS x_code), (SELECT unnest([{ys}]) AS y_code)),
c AS (SELECT x_code, y_code, coalesce(w, 0) AS w, coalesce(w2, 0) AS w2 FROM fr LEFT JOIN s USING (x_code, y_code))"""


LS = cell_sql(LINES, "SELECT [rf] AS xs, [ls] AS ys, CAST(1 AS DOUBLE) AS w FROM lines", [1, 2, 3], [1, 2])
LSW = cell_sql(LINES, "SELECT [rf] AS xs, [ls] AS ys, w FROM lines", [1, 2, 3], [1, 2])
SEG = cell_sql(LINES, "SELECT [seg] AS xs, [rf] AS ys, w FROM lines WHERE seg IS NOT NULL", [1, 2, 3, 4], [1, 2, 3])
FLG = cell_sql(ORDERS, "SELECT flags AS xs, [prio] AS ys, w FROM ord WHERE flags IS NOT NULL", [1, 2, 3], [1, 2, 3, 4, 5])
FLG2 = cell_sql(ORDERS, "SELECT flags AS xs, flags AS ys, w FROM ord WHERE flags IS NOT NULL", [1, 2, 3], [1, 2, 3])
ALL_ROUND = " SELECT x_code, y_code, round(CAST(w AS DOUBLE), 5) AS value FROM c"


@query("xt_counts", LS + ALL_ROUND)
def xt_counts(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "rf", "ls"))


@query("xt_counts_w", LSW + ALL_ROUND)
def xt_counts_w(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "rf", "ls", "w"))


@query("xt_null_x", SEG + ALL_ROUND)
def xt_null_x(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "seg", "rf", "w"))


@query("xt_base_all", cell_sql(LINES, "SELECT [rf] AS xs, CASE WHEN seg IS NULL THEN [] ELSE [seg] END AS ys, w FROM lines", [1, 2, 3], [1, 2, 3, 4]) + ALL_ROUND)
def xt_base_all(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "rf", "seg", "w", base_all=True))


@query("xt_one_way", cell_sql(LINES, "SELECT [rf] AS xs, CAST([] AS INT[]) AS ys, w FROM lines", [1, 2, 3], None) + ALL_ROUND)
def xt_one_way(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "rf", None, "w"))


@query("xt_set_by_single", FLG + ALL_ROUND)
def xt_set_by_single(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "prio", "w"))


@query("xt_set_by_set", FLG2 + ALL_ROUND)
def xt_set_by_set(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "flags", "w"))


@query("xt_filtered", cell_sql(ORDERS, "SELECT flags AS xs, [prio] AS ys, CAST(1 AS DOUBLE) AS w FROM ord WHERE flags IS NOT NULL AND list_has_any(flags, [1, 2]) AND total >= 200000", [1, 2, 3], [1, 2, 3, 4, 5]) + ALL_ROUND)
def xt_filtered(spark, sf):
    s = orders(spark, sf)
    return values(tabulate.cells(s, "flags", "prio", where=[{"flags": has_any([1, 2])}, {"total": is_ge(200000)}]))


@query("xt_filter_text", cell_sql(LINES, "SELECT [rf] AS xs, [ls] AS ys, w FROM lines WHERE ls = 1 AND num > 2", [1, 2, 3], [1, 2]) + ALL_ROUND)
def xt_filter_text(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "rf", "ls", "w", where="ls==1 & num>2"))


@query("xt_colpct", SEG + " SELECT x_code, y_code, round(100 * w / max(CASE WHEN x_code = 'All' THEN w END) OVER (PARTITION BY y_code), 5) AS value FROM c")
def xt_colpct(spark, sf):
    return values(tabulate.column_percent(tabulate.cells(lines(spark, sf), "seg", "rf", "w")), "value")


@query("xt_rowpct", SEG + " SELECT x_code, y_code, round(100 * w / max(CASE WHEN y_code = '@' THEN w END) OVER (PARTITION BY x_code), 5) AS value FROM c")
def xt_rowpct(spark, sf):
    return values(tabulate.row_percent(tabulate.cells(lines(spark, sf), "seg", "rf", "w")), "value")


@query("xt_res_colpct", FLG + " SELECT x_code, y_code, round(100 * w / sum(w) OVER (PARTITION BY y_code), 5) AS value FROM c WHERE x_code <> 'All'")
def xt_res_colpct(spark, sf):
    return values(tabulate.response_percent(tabulate.cells(orders(spark, sf), "flags", "prio", "w")), "value")


@query("xt_rebase", FLG + ", b AS (SELECT CAST(prio AS VARCHAR) AS y_code, sum(w) AS b FROM ord WHERE st IS NOT NULL GROUP BY 1 UNION ALL SELECT '@', sum(w) FROM ord WHERE st IS NOT NULL) SELECT x_code, y_code, round(100 * w / b, 5) AS value FROM c JOIN b USING (y_code)")
def xt_rebase(spark, sf):
    s = orders(spark, sf)
    return values(tabulate.rebased(tabulate.cells(s, "flags", "prio", "w"), tabulate.cells(s, "st", "prio", "w")), "value")


@query("xt_rebase_cells", cell_sql(LINES, "SELECT [rf] AS xs, [ls] AS ys, w FROM lines", [1, 2, 3], [1, 2]) + ", b AS (SELECT CAST(rf AS VARCHAR) AS x_code, sum(w) AS b FROM lines GROUP BY 1 UNION ALL SELECT 'All', sum(w) FROM lines) SELECT x_code, y_code, round(100 * c.w / c2.w, 5) AS value FROM c JOIN (SELECT x_code, y_code, w FROM c) c2 USING (x_code, y_code)")
def xt_rebase_cells(spark, sf):
    made = tabulate.cells(lines(spark, sf), "rf", "ls", "w")
    return values(tabulate.rebased(made, made, per_cell=True), "value")


@query("xt_sum", FLG + " SELECT y_code, round(sum(w), 5) AS value FROM c WHERE x_code <> 'All' GROUP BY y_code")
def xt_sum(spark, sf):
    return tabulate.raw_sum(tabulate.cells(orders(spark, sf), "flags", "prio", "w")).select("y_code", F.round("value", 5).alias("value"))


@query("xt_cumsum", SEG + " SELECT x_code, y_code, round(sum(w) OVER (PARTITION BY y_code ORDER BY x_code), 5) AS value FROM c WHERE x_code <> 'All'")
def xt_cumsum(spark, sf):
    return values(tabulate.cumulative(tabulate.cells(lines(spark, sf), "seg", "rf", "w")), "value")


@query("xt_cumpct", SEG + ", b AS (SELECT y_code, w AS b FROM c WHERE x_code = 'All') SELECT x_code, y_code, round(100 * sum(w) OVER (PARTITION BY y_code ORDER BY x_code) / b, 5) AS value FROM c JOIN b USING (y_code) WHERE x_code <> 'All'")
def xt_cumpct(spark, sf):
    return values(tabulate.cumulative(tabulate.cells(lines(spark, sf), "seg", "rf", "w"), percent=True), "value")


@query("xt_ebase", SEG + " SELECT x_code, y_code, round(w * w / w2, 5) AS value FROM c")
def xt_ebase(spark, sf):
    return values(tabulate.effective_base(tabulate.cells(lines(spark, sf), "seg", "rf", "w")), "value")


@query("xt_exclude", cell_sql(ORDERS, "SELECT flags AS xs, [prio] AS ys, w FROM ord WHERE flags IS NOT NULL AND NOT list_contains(flags, 2)", [1, 3], [1, 2, 3, 4, 5]) + ALL_ROUND)
def xt_exclude(spark, sf):
    """A respondent who gives an excluded code leaves with all codes."""
    s = orders(spark, sf)
    s.meta.set_missings("flags", {"exclude": [2]}, hide_on_y=False)
    return values(tabulate.cells(s, "flags", "prio", "w"))


@query("xt_limit", FLG + " SELECT x_code, y_code, round(w, 5) AS value FROM c WHERE x_code <> '2'")
def xt_limit(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "prio", "w", limit=[1, 3]))


@query("xt_labels", LSW + " SELECT CASE x_code WHEN '1' THEN 'A' WHEN '2' THEN 'N' WHEN '3' THEN 'R' ELSE x_code END AS x_text, CASE y_code WHEN '1' THEN 'F' WHEN '2' THEN 'O' END AS y_text, round(w, 1) AS value FROM c WHERE y_code <> '@'")
def xt_labels(spark, sf):
    return lines(spark, sf).crosstab("rf", "ls", "w", text=True).select("x_text", "y_text", "value")


@query("xt_pivot", f"WITH {LINES} SELECT x_code, round(sum(w), 5) AS \"@\", round(sum(w) FILTER (WHERE ls = 1), 5) AS \"1\", round(sum(w) FILTER (WHERE ls = 2), 5) AS \"2\" FROM (SELECT 'All' AS x_code, * FROM lines UNION ALL SELECT CAST(rf AS VARCHAR), * FROM lines) GROUP BY 1")
def xt_pivot(spark, sf):
    made = tabulate.cells(lines(spark, sf), "rf", "ls", "w").withColumn("value", F.round("w", 5))
    return tabulate.pivoted(made).drop("x_var")


@query("frequency", cell_sql(LINES, "SELECT [seg] AS xs, CAST([] AS INT[]) AS ys, CAST(1 AS DOUBLE) AS w FROM lines WHERE seg IS NOT NULL", [1, 2, 3, 4], None) + ALL_ROUND)
def frequency(spark, sf):
    return values(lines(spark, sf).frequency("seg"), "value")


def net_sql(hit: str, name: str = "n") -> str:
    rows = f"SELECT list_concat(list_transform(flags, lambda c: CAST(c AS VARCHAR)), CASE WHEN {hit} THEN ['net:{name}'] ELSE [] END) AS xs, [prio] AS ys, w FROM ord WHERE flags IS NOT NULL"
    return cell_sql(ORDERS, rows, [1, 2, 3, f"net:{name}"], [1, 2, 3, 4, 5])


@query("net_simple", net_sql("list_has_any(flags, [1, 3])") + " SELECT x_code, y_code, round(w, 5) AS value FROM c WHERE x_code IN ('All', 'net:n')")
def net_simple(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=[Net("n", (1, 3))]))


@query("net_logic", net_sql("len(flags) BETWEEN 2 AND 3") + " SELECT x_code, y_code, round(w, 5) AS value FROM c WHERE x_code IN ('All', 'net:n')")
def net_logic(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=[Net("n", logic=has_count([2, 3]))]))


@query("net_expand_after", net_sql("list_has_any(flags, [1, 3])") + " SELECT x_code, y_code, round(w, 5) AS value, CASE x_code WHEN 'All' THEN 0 WHEN 'net:n' THEN 1 WHEN '1' THEN 2 ELSE 3 END AS pos FROM c WHERE x_code <> '2'")
def net_expand_after(spark, sf):
    made = tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=[Net("n", (1, 3), expand="after")])
    return made.select("x_code", "y_code", F.round("w", 5).alias("value"), F.col("x_pos").alias("pos"))


@query("net_expand_before", net_sql("list_has_any(flags, [1, 3])") + " SELECT x_code, y_code, round(w, 5) AS value, CASE x_code WHEN 'All' THEN 0 WHEN '1' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS pos FROM c WHERE x_code <> '2'")
def net_expand_before(spark, sf):
    made = tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=[Net("n", (1, 3), expand="before")])
    return made.select("x_code", "y_code", F.round("w", 5).alias("value"), F.col("x_pos").alias("pos"))


@query("net_complete", net_sql("list_has_any(flags, [1, 3])") + " SELECT x_code, y_code, round(w, 5) AS value FROM c")
def net_complete(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=[Net("n", (1, 3), expand="after")], complete=True))


NET2 = cell_sql(ORDERS, "SELECT list_concat(CASE WHEN list_has_any(flags, [1, 2]) THEN ['net:a'] ELSE [] END, CASE WHEN list_contains(flags, 3) THEN ['net:b'] ELSE [] END) AS xs, [prio] AS ys, w FROM ord WHERE flags IS NOT NULL", ["net:a", "net:b"], [1, 2, 3, 4, 5])


@query("net_calc", NET2 + " SELECT * FROM (SELECT x_code, y_code, round(w, 5) AS value FROM c UNION ALL SELECT 'calc:gap', y_code, round(max(CASE WHEN x_code = 'net:a' THEN w END) - max(CASE WHEN x_code = 'net:b' THEN w END), 5) FROM c GROUP BY y_code)")
def net_calc(spark, sf):
    made = tabulate.cells(orders(spark, sf), "flags", "prio", "w", nets=tabulate.nets_of([{"a": [1, 2]}, {"b": [3]}]))
    return values(tabulate.calc(made, "gap", "net:a", "-", "net:b"))


@query("calc_ratio", SEG + " SELECT 'calc:r' AS x_code, y_code, round(100 * max(CASE WHEN x_code = '1' THEN w END) / max(CASE WHEN x_code = '2' THEN w END), 5) AS value FROM c GROUP BY y_code")
def calc_ratio(spark, sf):
    return values(tabulate.calc(tabulate.cells(lines(spark, sf), "seg", "rf", "w"), "r", "1", "/", "2", only=True))


@query("calc_scalar", SEG + " SELECT 'calc:s' AS x_code, y_code, round(max(CASE WHEN x_code = '1' THEN w END) * 2.5, 5) AS value FROM c GROUP BY y_code")
def calc_scalar(spark, sf):
    return values(tabulate.calc(tabulate.cells(lines(spark, sf), "seg", "rf", "w"), "s", "1", "*", 2.5, only=True))


# ------------------------------------------------------------------- statistics


def stat_sql(value: str, rows: str = "SELECT seg AS f, w, ls FROM lines WHERE seg IS NOT NULL") -> str:
    return f"""WITH {LINES}, r AS ({rows}),
e AS (SELECT f, w, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM r),
m AS (SELECT y_code, sum(w) AS b, sum(w * f) / sum(w) AS mean FROM e GROUP BY y_code),
v AS (SELECT y_code, b, mean, sum(w * (f - mean) * (f - mean)) / (b - 1) AS v FROM e JOIN m USING (y_code) GROUP BY y_code, b, mean)
SELECT y_code, round({value}, 5) AS value FROM v"""


def one_stat(name: str, x: str = "seg", **more):
    def made(spark, sf):
        return tabulate.summarize(lines(spark, sf), x, "ls", "w", stats=[name], **more).select("y_code", F.round(name, 5).alias("value"))

    return made


for _name, _value in (("mean", "mean"), ("var", "v"), ("stddev", "sqrt(v)"), ("sem", "sqrt(v / b)"), ("varcoeff", "sqrt(v) / mean")):
    query(f"stat_{_name}", stat_sql(_value))(one_stat(_name))

query("stat_mean_numeric", stat_sql("mean", "SELECT qty AS f, w, ls FROM lines"))(one_stat("mean", "qty"))
query("stat_min", f"WITH {LINES} SELECT y_code, CAST(min(seg) AS DOUBLE) AS value FROM (SELECT seg, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM lines WHERE seg IS NOT NULL) GROUP BY 1")(one_stat("min"))
query("stat_max", f"WITH {LINES} SELECT y_code, CAST(max(seg) AS DOUBLE) AS value FROM (SELECT seg, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM lines WHERE seg IS NOT NULL) GROUP BY 1")(one_stat("max"))
query("stat_rescale", stat_sql("mean", "SELECT CASE seg WHEN 1 THEN -100 WHEN 4 THEN 100 ELSE seg END AS f, w, ls FROM lines WHERE seg IS NOT NULL"))(one_stat("mean", factors={1: -100.0, 4: 100.0}))
query("stat_drop", stat_sql("mean", "SELECT CASE seg WHEN 1 THEN -100 WHEN 4 THEN 100 END AS f, w, ls FROM lines WHERE seg IN (1, 4)"))(one_stat("mean", factors={1: -100.0, 4: 100.0}, drop=True))
query("stat_exclude", stat_sql("mean", "SELECT seg AS f, w, ls FROM lines WHERE seg IN (1, 2, 3)"))(one_stat("mean", exclude=[4]))
query("stat_source", stat_sql("mean", "SELECT qty AS f, w, ls FROM lines WHERE seg IS NOT NULL"))(one_stat("mean", "seg", source="qty"))


def percentile_sql(p: float) -> str:
    """Definition 6 over distinct scores with unit weights: k = (W + 1) p."""
    return f"""WITH {LINES}, e AS (SELECT qty AS s, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM lines),
o AS (SELECT y_code, s, row_number() OVER (PARTITION BY y_code ORDER BY s) AS c, count(*) OVER (PARTITION BY y_code) AS n FROM e),
k AS (SELECT DISTINCT y_code, n, (n + 1) * {p} AS k FROM o)
SELECT y_code, round(CASE WHEN k < 1 THEN min(s) WHEN k >= n THEN max(s)
  ELSE max(CASE WHEN c = floor(k) THEN s END) * (1 - (k - floor(k))) + max(CASE WHEN c = floor(k) + 1 THEN s END) * (k - floor(k)) END, 5) AS value
FROM o JOIN k USING (y_code, n) GROUP BY y_code, k, n"""


def one_percentile(name: str):
    return lambda spark, sf: tabulate.summarize(lines(spark, sf), "qty", "ls", stats=[name]).select("y_code", F.round(name, 5).alias("value"))


for _name, _p in (("lower_q", 0.25), ("median", 0.5), ("upper_q", 0.75)):
    query(f"stat_{_name}", percentile_sql(_p))(one_percentile(_name))


@query("stat_summary", f"""WITH {LINES}, e AS (SELECT qty AS s, w, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM lines),
m AS (SELECT y_code, sum(w) AS b, sum(w * s) / sum(w) AS mean, min(s) AS mn, max(s) AS mx FROM e GROUP BY 1)
SELECT y_code, round(b, 5) AS base, round(mean, 5) AS mean, round(sqrt(sum(w * (s - mean) * (s - mean)) / (b - 1)), 5) AS stddev, mn AS "min", mx AS "max" FROM e JOIN m USING (y_code) GROUP BY y_code, b, mean, mn, mx""")
def stat_summary(spark, sf):
    made = tabulate.summarize(lines(spark, sf), "qty", "ls", "w", stats=["mean", "stddev", "min", "max"])
    return made.select("y_code", *[F.round(c, 5).alias(c) for c in ("base", "mean", "stddev")], "min", "max")


@query("stat_set_mean", f"WITH {ORDERS}, e AS (SELECT list_sum(flags) AS f, w, unnest(['@', CAST(prio AS VARCHAR)]) AS y_code FROM ord WHERE flags IS NOT NULL) SELECT y_code, round(sum(w * f) / sum(w), 5) AS value FROM e GROUP BY 1")
def stat_set_mean(spark, sf):
    """A set's score is the sum of its codes' factors."""
    return tabulate.summarize(orders(spark, sf), "flags", "prio", "w", stats=["mean"]).select("y_code", F.round("mean", 5).alias("value"))


# ------------------------------------------------------------------------ tests

ASKIA = SEG + """, k AS (SELECT x_code, y_code, w, max(CASE WHEN x_code = 'All' THEN w END) OVER (PARTITION BY y_code) AS b,
  max(CASE WHEN y_code = '@' THEN w END) OVER (PARTITION BY x_code) AS rw FROM c),
t AS (SELECT (SELECT max(w) FROM c WHERE x_code = 'All' AND y_code = '@') AS n),
p AS (SELECT a.x_code, a.y_code AS y1, z.y_code AS y2, a.w / a.b - z.w / z.b AS d,
  sqrt(a.w / a.b * (1 - a.w / a.b) / a.b + z.w / z.b * (1 - z.w / z.b) / z.b) AS se
  FROM k a JOIN k z ON a.x_code = z.x_code AND a.y_code < z.y_code CROSS JOIN t
  WHERE a.x_code <> 'All' AND a.y_code <> '@' AND z.y_code <> '@' AND a.rw * a.b / n >= 5 AND z.rw * z.b / n >= 5)"""


@query("test_props_askia_t", ASKIA + " SELECT x_code, y1 AS y_code1, y2 AS y_code2, round(d, 6) AS diff, round(d / se, 4) AS t FROM p")
def test_props_askia_t(spark, sf):
    made = sigtests.proportions(lines(spark, sf), "seg", "rf", "w", mimic="askia", p_values=True)
    return made.select("x_code", "y_code1", "y_code2", F.round("diff", 6).alias("diff"), F.round("t", 4).alias("t"))


@query("test_props_askia", ASKIA + " SELECT x_code, CASE WHEN d > 0 THEN y1 ELSE y2 END AS y_code, string_agg(CASE WHEN d > 0 THEN y2 ELSE y1 END, ',' ORDER BY CASE WHEN d > 0 THEN y2 ELSE y1 END) AS value FROM p WHERE abs(d / se) > 0.8 AND d <> 0 GROUP BY ALL")
def test_props_askia(spark, sf):
    return sigtests.proportions(lines(spark, sf), "seg", "rf", "w", mimic="askia", level=0.8).select("x_code", "y_code", "value")


@query("test_props_dim_t", SEG + """, k AS (SELECT x_code, y_code, w, max(CASE WHEN x_code = 'All' THEN w END) OVER (PARTITION BY y_code) AS b,
  max(CASE WHEN x_code = 'All' THEN w * w / w2 END) OVER (PARTITION BY y_code) AS eb FROM c)
SELECT a.x_code, a.y_code AS y_code1, z.y_code AS y_code2, round(a.w / a.b - z.w / z.b, 6) AS diff, round(a.eb + z.eb - 2, 3) AS dof,
  round((a.w / a.b - z.w / z.b) / sqrt((a.w + z.w) / (a.b + z.b) * (1 - (a.w + z.w) / (a.b + z.b)) * (1 / a.eb + 1 / z.eb)), 4) AS t
FROM k a JOIN k z ON a.x_code = z.x_code AND a.y_code < z.y_code WHERE a.x_code <> 'All' AND a.y_code <> '@' AND z.y_code <> '@'""")
def test_props_dim_t(spark, sf):
    made = sigtests.proportions(lines(spark, sf), "seg", "rf", "w", p_values=True)
    return made.select("x_code", "y_code1", "y_code2", F.round("diff", 6).alias("diff"), F.round("dof", 3).alias("dof"), F.round("t", 4).alias("t"))


@query("test_props_dim")
def test_props_dim(spark, sf):
    """Needs the t distribution: held against a model in the tests."""
    return sigtests.proportions(lines(spark, sf), "seg", "rf", "w", level=0.5, flag_bases=(30, 100))


@query("test_props_total")
def test_props_total(spark, sf):
    return sigtests.proportions(orders(spark, sf), "flags", "prio", "w", level=0.3, test_total=True)


@query("test_means_askia_t", f"""WITH {LINES}, e AS (SELECT seg AS f, w, CAST(rf AS VARCHAR) AS y FROM lines WHERE seg IS NOT NULL),
m AS (SELECT y, sum(w) AS b, sum(w * f) / sum(w) AS mean FROM e GROUP BY 1),
v AS (SELECT y, b, mean, sqrt(sum(w * (f - mean) * (f - mean)) / (b - 1)) AS sd FROM e JOIN m USING (y) GROUP BY y, b, mean)
SELECT a.y AS y_code1, z.y AS y_code2, round(a.mean - z.mean, 6) AS diff, round((a.mean - z.mean) / sqrt(a.sd / a.b + z.sd / z.b), 4) AS t FROM v a JOIN v z ON a.y < z.y""")
def test_means_askia_t(spark, sf):
    made = sigtests.means(lines(spark, sf), "seg", "rf", "w", mimic="askia", p_values=True)
    return made.select("y_code1", "y_code2", F.round("diff", 6).alias("diff"), F.round("t", 4).alias("t"))


@query("test_means_dim_t", f"""WITH {LINES}, e AS (SELECT seg AS f, w, CAST(rf AS VARCHAR) AS y FROM lines WHERE seg IS NOT NULL),
m AS (SELECT y, sum(w) AS b, sum(w * w) AS b2, sum(w * f) / sum(w) AS mean FROM e GROUP BY 1),
v AS (SELECT y, b, b2, mean, sum(w * (f - mean) * (f - mean)) AS ss, b * b / b2 AS eb, b2 / b AS ssw FROM e JOIN m USING (y) GROUP BY y, b, b2, mean)
SELECT a.y AS y_code1, z.y AS y_code2, round(a.mean - z.mean, 6) AS diff, round(a.eb + z.eb - 2, 3) AS dof,
  round((a.mean - z.mean) / sqrt((a.ss + z.ss) / ((a.b - a.ssw) + (z.b - z.ssw)) * (1 / a.eb + 1 / z.eb)), 4) AS t FROM v a JOIN v z ON a.y < z.y""")
def test_means_dim_t(spark, sf):
    made = sigtests.means(lines(spark, sf), "seg", "rf", "w", p_values=True)
    return made.select("y_code1", "y_code2", F.round("diff", 6).alias("diff"), F.round("dof", 3).alias("dof"), F.round("t", 4).alias("t"))


@query("test_means_dim")
def test_means_dim(spark, sf):
    return sigtests.means(lines(spark, sf), "seg", "rf", "w", level=0.5)


@query("test_overlap", f"WITH {ORDERS}, p AS (SELECT w, unnest([[1, 2], [1, 3], [2, 3]]) AS q, flags FROM ord WHERE flags IS NOT NULL AND prio IS NOT NULL) SELECT CAST(q[1] AS VARCHAR) AS y1, CAST(q[2] AS VARCHAR) AS y2, round(sum(w) * sum(w) / sum(w * w), 5) AS ov FROM p WHERE list_has_all(flags, q) GROUP BY ALL")
def test_overlap(spark, sf):
    return sigtests.overlaps(orders(spark, sf), "prio", "flags", "w").select("y1", "y2", F.round("ov", 5).alias("ov"))


@query("test_flags", SEG + " SELECT y_code, CASE WHEN w * w / w2 < 15000 THEN '**' WHEN w * w / w2 < 25000 THEN '*' ELSE '' END AS flag FROM c WHERE x_code = 'All'")
def test_flags(spark, sf):
    base = tabulate.effective_base(tabulate.cells(lines(spark, sf), "seg", "rf", "w")).filter("x_code = 'All'")
    return base.select("y_code", F.when(F.col("value") < 15000, "**").when(F.col("value") < 25000, "*").otherwise("").alias("flag"))


# ----------------------------------------------------------- nests, grids, levels


@query("nest_two_levels", cell_sql(LINES, "SELECT [seg] AS xs, [(rf - 1) * 2 + ls] AS ys, w FROM lines WHERE seg IS NOT NULL", [1, 2, 3, 4], [1, 2, 3, 4, 5, 6]) + ALL_ROUND)
def nest_two_levels(spark, sf):
    return values(tabulate.cells(lines(spark, sf), "seg", "rf > ls", "w"))


@query("nest_of_sets", cell_sql(ORDERS, "SELECT [prio] AS xs, list_transform(flags, lambda c: (c - 1) * 3 + st) AS ys, w FROM ord WHERE flags IS NOT NULL", [1, 2, 3, 4, 5], list(range(1, 10))) + ALL_ROUND)
def nest_of_sets(spark, sf):
    return values(tabulate.cells(orders(spark, sf), "prio", "flags > st", "w"))


@query("array_summary", f"""WITH {GRID}, e AS (SELECT unnest(['g_1', 'g_2', 'g_3']) AS y_code, unnest([g_1, g_2, g_3]) AS c FROM grid),
f AS (SELECT y_code, unnest(['All', CAST(c AS VARCHAR)]) AS x_code FROM e WHERE c IS NOT NULL)
SELECT x_code, y_code, CAST(count(*) AS DOUBLE) AS value FROM f GROUP BY ALL""")
def array_summary(spark, sf):
    return values(tabulate.grid_cells(grid(spark, sf), "g"))


@query("level_array", f"""WITH {GRID}, e AS (SELECT half, unnest([g_1, g_2, g_3]) AS c FROM grid),
f AS (SELECT c, unnest(['@', CAST(half AS VARCHAR)]) AS y_code FROM e WHERE c IS NOT NULL),
g AS (SELECT y_code, unnest(['All', CAST(c AS VARCHAR)]) AS x_code FROM f)
SELECT x_code, y_code, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY ALL""")
def level_array(spark, sf):
    return values(tabulate.level_cells(grid(spark, sf), "g", "half"))


@query("level_percent", f"""WITH {GRID}, e AS (SELECT half, unnest([g_1, g_2, g_3]) AS c FROM grid),
f AS (SELECT c, unnest(['@', CAST(half AS VARCHAR)]) AS y_code FROM e WHERE c IS NOT NULL),
g AS (SELECT y_code, unnest(['All', CAST(c AS VARCHAR)]) AS x_code FROM f), n AS (SELECT x_code, y_code, count(*) AS n FROM g GROUP BY ALL)
SELECT x_code, y_code, round(100.0 * n / max(n) OVER (PARTITION BY y_code), 5) AS value FROM n""")
def level_percent(spark, sf):
    return values(tabulate.column_percent(tabulate.level_cells(grid(spark, sf), "g", "half")), "value")


# ------------------------------------------------------------------------ batches

FUSED = f"""WITH {LINES}, u AS (SELECT *, 'w' AS weight, w AS ww FROM lines UNION ALL SELECT *, '' AS weight, 1.0 AS ww FROM lines),
x AS (SELECT weight, ww, rf, ls, seg, unnest([{{'v': 'rf', 'c': rf}}, {{'v': 'ls', 'c': ls}}, {{'v': 'seg', 'c': seg}}]) AS x FROM u),
y AS (SELECT weight, ww, x, unnest([{{'v': '@', 'c': 0}}, {{'v': 'ls', 'c': ls}}, {{'v': 'seg', 'c': seg}}]) AS y FROM x WHERE x.c IS NOT NULL),
e AS (SELECT weight, ww, x.v AS x_var, unnest(['All', CAST(x.c AS VARCHAR)]) AS x_code, y FROM y WHERE y.c IS NOT NULL),
f AS (SELECT weight, ww, x_var, x_code, y.v AS y_var, unnest(CASE WHEN y.v = '@' THEN ['@'] ELSE ['@', CAST(y.c AS VARCHAR)] END) AS y_code FROM e)
SELECT weight, x_var, x_code, y_var, y_code, round(CAST(sum(ww) AS DOUBLE), 4) AS value FROM f GROUP BY ALL"""


@query("bt_fused_report", FUSED)
def bt_fused_report(spark, sf):
    """Three by three variables and two weights from one scan; cells of no respondent left out."""
    made = tabulate.fused(lines(spark, sf), ["rf", "ls", "seg"], ["ls", "seg"], [None, "w"])
    return made.filter("n > 0").select("weight", "x_var", "x_code", "y_var", "y_code", F.round("w", 4).alias("value"))


# -------------------------------------------------------------------------- rules


@query("rl_sort", SEG + " SELECT x_code, CAST(row_number() OVER (ORDER BY CASE WHEN x_code = 'All' THEN 0 ELSE 1 END, w DESC) - 1 AS INT) AS pos FROM c WHERE y_code = '@'")
def rl_sort(spark, sf):
    return rules.sorted_by(tabulate.cells(lines(spark, sf), "seg", "rf", "w")).filter("y_code = '@'").select("x_code", F.col("x_pos").alias("pos"))


@query("rl_sort_fixed", SEG + " SELECT x_code, CAST(row_number() OVER (ORDER BY CASE x_code WHEN 'All' THEN 0 WHEN '2' THEN 2 ELSE 1 END, w) - 1 AS INT) AS pos FROM c WHERE y_code = '3'")
def rl_sort_fixed(spark, sf):
    made = rules.sorted_by(tabulate.cells(lines(spark, sf), "seg", "rf", "w"), "3", fixed=[2], ascending=True)
    return made.filter("y_code = '3'").select("x_code", F.col("x_pos").alias("pos"))


@query("rl_slice", SEG + " SELECT x_code, y_code, round(w, 5) AS value, CASE x_code WHEN 'All' THEN 0 WHEN '3' THEN 1 ELSE 2 END AS pos FROM c WHERE x_code IN ('All', '3', '1')")
def rl_slice(spark, sf):
    made = rules.sliced(tabulate.cells(lines(spark, sf), "seg", "rf", "w"), [3, 1])
    return made.select("x_code", "y_code", F.round("w", 5).alias("value"), F.col("x_pos").alias("pos"))


@query("rl_drop", SEG + " SELECT x_code, y_code, round(w, 5) AS value FROM c WHERE x_code <> '2' AND y_code <> '1'")
def rl_drop(spark, sf):
    s = lines(spark, sf)
    s.meta.hide("seg", [2], "x")
    s.meta.hide("rf", [1], "y")
    return values(rules.applied(s, tabulate.cells(s, "seg", "rf", "w"), "seg", "rf"))


@query("rl_min_count", f"WITH {LINES} SELECT CAST(seg AS VARCHAR) AS code FROM lines WHERE seg IS NOT NULL GROUP BY 1 HAVING count(*) < 12000")
def rl_min_count(spark, sf):
    made = tabulate.cells(lines(spark, sf), "seg").filter((F.col("x_code") != "All") & (F.col("w") < 12000))
    return made.select(F.col("x_code").alias("code"))


@query("ad_codes_in_data", f"WITH {USERS} SELECT DISTINCT unnest(acts) AS code FROM users")
def ad_codes_in_data(spark, sf):
    return users(spark, sf).codes_in_data("acts")
