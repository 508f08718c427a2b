"""Metadata edits, seen through the data: what is counted, and under which name, label and place, once they are made."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import logic as lg
from ..meta import SET, Meta
from ..operators import weighting
from ..plans import rules
from ..plans.tabulate import ALL, quoted
from ..report.stack import Stack
from ..session import local_frame, shared_dir
from ..sources.spss import write_spss
from ..survey import Survey
from .data import GRID, LINES, ORDERS, USERS, grid, lines, orders, users

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def counted(s: Survey, name: str, text_key: str | None = None, axis: str | None = None) -> DataFrame:
    """pos, code, label of a variable's codes, and the rows that have them."""
    own = s.meta[name]
    column = F.explode(quoted(name)) if own.type == SET else quoted(name)
    n = s.df.select(column.alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("rows"))
    codes = local_frame(s.spark, [(i, c, t) for i, (c, t) in enumerate(s.meta.value_texts(name, text_key, axis).items(), 1)], "pos int, code int, label string")
    return codes.join(n, F.col("code") == F.col("of"), "left").select("pos", "code", "label", F.coalesce("rows", F.lit(0)).alias("n"))


def answered(s: Survey, columns: dict[str, str]) -> DataFrame:
    """pos, name, label of columns, and the rows that have a value in them; one pass over the data."""
    counts = s.df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(c).alias("name"), F.lit(t).alias("label"), F.col(f"n{i}").alias("n")) for i, (c, t) in enumerate(columns.items())])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def codes_sql(cte: str, table: str, column: str, rows: str, exploded: bool = False) -> str:
    """The codes given as (pos, code, 'label') rows, and how often a column has each."""
    source = f"SELECT unnest({column}) AS c FROM {table}" if exploded else f"SELECT {column} AS c FROM {table}"
    return f"WITH {cte}, m(pos, code, label) AS (VALUES {rows}), d AS ({source}) SELECT pos, code, label, count(c) AS n FROM m LEFT JOIN d ON c = code GROUP BY ALL"


def columns_sql(cte: str, table: str, rows: list[tuple[str, str, str]]) -> str:
    """For (name, label, column) how many rows have a value."""
    return f"WITH {cte} " + " UNION ALL ".join(f"SELECT {i} AS pos, '{n}' AS name, '{t}' AS label, count({c}) AS n FROM {table}" for i, (n, t, c) in enumerate(rows, 1))


# ------------------------------------------------------------------ codes and labels


@query("md_value_texts", codes_sql(LINES, "lines", "rf", "(1, 1, 'accepted'), (2, 2, 'N'), (3, 3, 'came back')"))
def md_value_texts(spark, sf):
    s = lines(spark, sf)
    s.meta.set_value_texts("rf", {1: "accepted", 3: "came back"})
    return counted(s, "rf")


@query("md_axis_texts", codes_sql(LINES, "lines", "rf", "(1, 1, 'A'), (2, 2, 'none'), (3, 3, 'R')"))
def md_axis_texts(spark, sf):
    """A label for one axis alone."""
    s = lines(spark, sf)
    s.meta.set_value_texts("rf", {2: "none"}, axis="y")
    return counted(s, "rf", axis="y")


@query("md_reorder_values", codes_sql(LINES, "lines", "seg", "(1, 3, 'segment 3'), (2, 1, 'segment 1'), (3, 4, 'segment 4'), (4, 2, 'segment 2')"))
def md_reorder_values(spark, sf):
    s = lines(spark, sf)
    s.meta.reorder_values("seg", [3, 1, 4, 2])
    return counted(s, "seg")


@query("md_extend_values", codes_sql(LINES, "lines", "rf", "(1, 1, 'A'), (2, 2, 'N'), (3, 3, 'R'), (4, 4, 'other'), (5, 9, 'unknown')"))
def md_extend_values(spark, sf):
    s = lines(spark, sf)
    s.meta.extend_values("rf", ["other", (9, "unknown")])
    return counted(s, "rf")


@query("md_remove_values", codes_sql(USERS, "users", "list_filter(acts, lambda c: c NOT IN (2, 5))", "(1, 1, 'click'), (2, 3, 'purchase'), (3, 4, 'signup')", exploded=True))
def md_remove_values(spark, sf):
    """Codes that leave the metadata leave the data."""
    s = users(spark, sf)
    s.remove_values("acts", [2, 5])
    return counted(s, "acts")


@query("md_codes_from_label", f"WITH {ORDERS} SELECT prio, count(*) AS n FROM ord WHERE prio IN (1, 2) GROUP BY 1")
def md_codes_from_label(spark, sf):
    s = orders(spark, sf)
    codes = s.meta.codes_from_label("prio", ["urgent", "high"], exact=False)
    return s.df.filter(F.col("prio").isin(codes)).groupBy("prio").agg(F.count(F.lit(1)).alias("n"))


@query("md_text_keys", codes_sql(LINES, "lines", "ls", "(1, 1, 'fertig'), (2, 2, 'O')"))
def md_text_keys(spark, sf):
    """A second language, filled from the first where it lacks a label, then kept alone."""
    s = lines(spark, sf)
    s.meta.set_value_texts("ls", {1: "fertig"}, text_key="de-DE")
    s.meta.force_texts("de-DE", "main")
    s.meta.select_text_keys("de-DE")
    return counted(s, "ls", "de-DE")


@query("md_replace_texts", codes_sql(LINES, "lines", "seg", "(1, 1, 'part 1'), (2, 2, 'part 2'), (3, 3, 'part 3'), (4, 4, 'part 4')"))
def md_replace_texts(spark, sf):
    s = lines(spark, sf)
    s.meta.set_value_texts("seg", {i: f"<b>segment</b> {i}" for i in range(1, 5)})
    s.meta.remove_html()
    s.meta.replace_texts({"segment": "part"})
    return counted(s, "seg")


@query("md_duplicate_texts", f"WITH {ORDERS} SELECT 'late' AS label, prio AS code, count(*) AS n FROM ord WHERE prio IN (4, 5) GROUP BY 2")
def md_duplicate_texts(spark, sf):
    s = orders(spark, sf)
    s.meta.set_value_texts("prio", {4: "late", 5: "late"})
    ((label, codes),) = s.meta.duplicate_texts("prio").items()
    return s.df.filter(F.col("prio").isin(codes)).groupBy(F.col("prio").alias("code")).agg(F.count(F.lit(1)).alias("n")).withColumn("label", F.lit(label))


@query("md_factors", f"WITH {LINES} SELECT ls, round(avg(CASE seg WHEN 1 THEN 10.0 WHEN 2 THEN 5.0 WHEN 4 THEN -5.0 END), 6) AS mean FROM lines WHERE ls IS NOT NULL GROUP BY 1")
def md_factors(spark, sf):
    """Means of the factors that the codes carry; a code whose factor is cleared counts no more."""
    s = lines(spark, sf)
    s.meta.set_factors("seg", {1: 10, 2: 5, 3: 0, 4: -5})
    kept = {c: f for c, f in s.meta.factors("seg").items() if c != 3}
    s.meta.clear_factors("seg")
    s.meta.set_factors("seg", kept)
    score = F.coalesce(*[F.when(F.col("seg") == c, F.lit(float(f))) for c, f in s.meta.factors("seg").items()])
    return s.df.filter("ls IS NOT NULL").groupBy("ls").agg(F.round(F.avg(score), 6).alias("mean"))


@query("md_missings", f"WITH {LINES} SELECT CAST(seg AS VARCHAR) AS x_code, count(*) AS n FROM lines WHERE seg <= 3 GROUP BY 1 UNION ALL SELECT 'All', count(*) FROM lines WHERE seg <= 3")
def md_missings(spark, sf):
    """A code flagged as missing leaves counts and base."""
    s = lines(spark, sf)
    s.meta.set_missings("seg", {"exclude": [4]}, hide_on_y=False)
    return s.crosstab("seg").filter("x_code != '4'").select("x_code", F.col("value").cast("long").alias("n"))


# --------------------------------------------------------------------------- rules


@query("md_hide", f"WITH {LINES} SELECT CAST(seg AS VARCHAR) AS x_code, CAST(rf AS VARCHAR) AS y_code, count(*) AS n FROM lines WHERE seg IN (1, 3, 4) AND rf IN (1, 2) GROUP BY ALL")
def md_hide(spark, sf):
    """Codes hidden on either axis."""
    s = lines(spark, sf)
    s.meta.hide("seg", [2], "x")
    s.meta.hide("rf", [3], "y")
    return s.crosstab("seg", "rf", rules=True).filter("x_code != 'All'").select("x_code", "y_code", F.col("value").cast("long").alias("n"))


@query("md_slice_rule", f"WITH {LINES} SELECT CAST(seg AS VARCHAR) AS x_code, CASE seg WHEN 4 THEN 1 ELSE 2 END AS x_pos, count(*) AS n FROM lines WHERE seg IN (4, 2) GROUP BY ALL")
def md_slice_rule(spark, sf):
    s = lines(spark, sf)
    s.meta.slice_rule("seg", [4, 2], "x")
    return s.crosstab("seg", rules=True).filter("x_code != 'All'").select("x_code", "x_pos", F.col("value").cast("long").alias("n"))


@query("md_sort_rule", f"WITH {LINES}, c AS (SELECT seg, count(*) AS n FROM lines WHERE seg IS NOT NULL GROUP BY 1) SELECT CAST(seg AS VARCHAR) AS x_code, CAST(row_number() OVER (ORDER BY (seg = 1)::INT, n, seg) AS INT) AS x_pos, n FROM c")
def md_sort_rule(spark, sf):
    """Ascending by the total, one code fixed last."""
    s = lines(spark, sf)
    s.meta.sort_rule("seg", fix=[1], ascending=True)
    return s.crosstab("seg", rules=True).filter("x_code != 'All'").select("x_code", "x_pos", F.col("value").cast("long").alias("n"))


@query("md_min_value_count", f"WITH {LINES}, c AS (SELECT seg, count(*) AS n FROM lines WHERE seg IS NOT NULL GROUP BY 1), t AS (SELECT median(n) AS m FROM c) SELECT CAST(seg AS VARCHAR) AS y_code, n FROM c, t WHERE n >= m")
def md_min_value_count(spark, sf):
    """Codes with fewer rows than the median code has are hidden from the columns."""
    s = lines(spark, sf)
    sizes = s.df.filter("seg IS NOT NULL").groupBy("seg").count().agg(F.median("count")).first()[0]
    s.min_value_count("seg", least=sizes)
    found = s.crosstab("ls", "seg", rules=True)
    return found.filter("x_code != 'All'").groupBy("y_code").agg(F.sum("value").cast("long").alias("n"))


# -------------------------------------------------------------- variables and their order


@query("md_rename", columns_sql(LINES, "lines", [("flag", "Return flag", "rf"), ("segment", "Segment", "seg")]))
def md_rename(spark, sf):
    s = lines(spark, sf)
    s.rename_all({"rf": "flag", "seg": "segment"})
    return answered(s, {n: s.meta.text(n) for n in ("flag", "segment")})


@query("md_order", columns_sql(LINES, "lines", [(n, n, n) for n in ("seg", "ls", "rf", "w", "okey")]))
def md_order(spark, sf):
    """A subset, put in a new order, with one variable moved before another."""
    s = lines(spark, sf).subset(["okey", "rf", "ls", "seg", "w"])
    s.order(["seg", "rf", "ls", "w", "okey"])
    s.order(reposition=[{"rf": "ls"}])
    return answered(s, {n: n for n in s.meta.sets["data file"]})


@query("md_copy_only", codes_sql(USERS, "users", "list_filter(acts, lambda c: c IN (1, 4))", "(1, 1, 'click'), (2, 4, 'signup')", exploded=True))
def md_copy_only(spark, sf):
    s = users(spark, sf)
    return counted(s, s.copy("acts", "few", copy_only=[1, 4]))


@query("md_drop", columns_sql(LINES, "lines", [(n, n, n) for n in ("okey", "num", "rf", "ls", "qty", "disc", "w")]))
def md_drop(spark, sf):
    s = lines(spark, sf)
    s.drop(["price", "tax", "seg", "ship"])
    return answered(s, {c: c for c in s.df.columns})


@query("md_by_type", columns_sql(LINES, "lines", [("rf", "single", "rf"), ("ls", "single", "ls"), ("seg", "single", "seg"), ("ship", "date", "ship")]))
def md_by_type(spark, sf):
    s = lines(spark, sf)
    return answered(s, {n: t for t, names in s.meta.by_type(["single", "date"]).items() for n in names})


@query("md_find", columns_sql(GRID, "grid", [("g_1", "size", "g_1"), ("g_2", "price", "g_2"), ("g_3", "key", "g_3"), ("size", "size", "size")]))
def md_find(spark, sf):
    """Variables by parts of their names, grids as their items."""
    s = grid(spark, sf)
    return answered(s, {c: s.meta.text(c) for c in s.meta.unroll(s.meta.find(["g", "siz"])) if c != "pkey"})


@query("md_create_set", columns_sql(GRID, "grid", [("half", "half", "half"), ("g_1", "g", "g_1"), ("g_2", "g", "g_2"), ("g_3", "g", "g_3")]))
def md_create_set(spark, sf):
    s = grid(spark, sf)
    s.meta.create_set("mine", included=["g", "half"])
    names = sorted(s.meta.sets["mine"], reverse=True)
    return answered(s, {c: (s.meta.parents(c) or [c])[0] for c in s.meta.unroll(names)})


@query("md_to_dict", codes_sql(ORDERS, "ord", "flags", "(1, 1, 'A'), (2, 2, 'N'), (3, 3, 'back')", exploded=True))
def md_to_dict(spark, sf):
    """Metadata written as JSON and read again."""
    s = orders(spark, sf)
    s.meta.set_value_texts("flags", {3: "back"})
    return counted(Survey(s.df, Meta.from_json(s.meta.to_json())), "flags")


@query("md_merged", codes_sql(LINES, "lines", "rf", "(1, 1, 'A'), (2, 2, 'N'), (3, 3, 'R'), (4, 7, 'seven')"))
def md_merged(spark, sf):
    """Metadata of two waves: the second one's further codes come last."""
    a, b = lines(spark, sf), lines(spark, sf)
    b.meta.extend_values("rf", [(7, "seven")])
    return counted(Survey(a.df, a.meta.merged(b.meta)), "rf")


@query("md_inferred", columns_sql(ORDERS, "ord", [("okey", "int", "okey"), ("total", "float", "total"), ("flags", "delimited set", "flags")]))
def md_inferred(spark, sf):
    df = orders(spark, sf).df.select("okey", "total", "flags")
    meta = Meta.inferred(df.schema)
    return answered(Survey(df, meta), {c: meta[c].type for c in df.columns})


# ------------------------------------------------------------------------------ grids


@query("md_reorder_items", columns_sql(GRID, "grid", [("g_3", "key", "g_3"), ("g_1", "bulk", "g_1"), ("g_2", "price", "g_2")]))
def md_reorder_items(spark, sf):
    s = grid(spark, sf)
    s.meta.set_item_texts("g", {1: "bulk"})
    s.meta.reorder_items("g", [3, 1, 2])
    return answered(s, s.meta.item_texts("g"))


@query("md_remove_items", columns_sql(GRID, "grid", [("g_1", "size", "g_1"), ("g_3", "key", "g_3"), ("g_4", "none", "nullif(1, 1)")]))
def md_remove_items(spark, sf):
    s = grid(spark, sf)
    s.extend_items("g", ["none"])
    s.remove_items("g", [2])
    return answered(s, s.meta.item_texts("g"))


@query("md_item_texts", columns_sql(GRID, "grid", [("g_1", "Ratings - size", "g_1"), ("g_2", "Ratings - price", "g_2"), ("g_3", "Ratings - key", "g_3")]))
def md_item_texts(spark, sf):
    """Items' labels with the grid's in front, cut off and put back."""
    s = grid(spark, sf)
    s.meta.restore_item_texts()
    s.meta.cut_item_texts()
    s.meta.restore_item_texts(["g"])
    return answered(s, s.meta.item_texts("g"))


@query("md_unbind", columns_sql(GRID, "grid", [("g_1", "g_1", "g_1"), ("g_2", "g_2", "g_2"), ("g_3", "g_3", "g_3")]))
def md_unbind(spark, sf):
    """A grid taken apart and bound anew under another name."""
    s = grid(spark, sf)
    s.meta.unbind("g")
    s.to_array("h", ["g_1", "g_2", "g_3"], "Again")
    return answered(s, {c: c for c in s.meta.sources("h")})


@query("md_copy_grid", f"WITH {GRID} SELECT 'h_1' AS item, g_1 AS code, count(*) AS n FROM grid WHERE half = 1 AND g_1 IN (1, 3) GROUP BY 2 UNION ALL SELECT 'h_3', g_3, count(*) FROM grid WHERE half = 1 AND g_3 IN (1, 3) GROUP BY 2 UNION ALL SELECT 'h_2', g_2, count(*) FROM grid WHERE half = 1 AND g_2 IN (1, 3) GROUP BY 2")
def md_copy_grid(spark, sf):
    """A grid's copy without a code and with the data of some rows."""
    s = grid(spark, sf)
    s.rename_all({"g": "h", "g_1": "h_1", "g_2": "h_2", "g_3": "h_3"})
    new = s.copy("h", "two", copy_not=[2], slicer={"half": [1]})
    cells = F.array(*[F.struct(F.lit(old).alias("item"), quoted(c).alias("code")) for old, c in zip(s.meta.sources("h"), s.meta.sources(new), strict=True)])
    return s.df.select(F.explode(cells).alias("c")).select("c.*").filter("code IS NOT NULL").groupBy("item", "code").agg(F.count(F.lit(1)).alias("n"))


@query("md_dimensionize", columns_sql(GRID, "grid", [("g_1", "g", "g_1"), ("g_2", "g", "g_2"), ("g_3", "g", "g_3")]))
def md_dimensionize(spark, sf):
    """Names of the Dimensions kind and back."""
    s = grid(spark, sf)
    s.dimensionize()
    s.undimensionize()
    return answered(s, {c: s.meta.parents(c)[0] for c in s.meta.sources("g")})


# ---------------------------------------------------------------------------- filters


@query("md_is_subfilter", f"WITH {LINES} SELECT 'wide' AS name, count(*) FILTER (WHERE rf IN (1, 2)) AS n FROM lines UNION ALL SELECT 'narrow', count(*) FILTER (WHERE rf = 1 AND ls = 1) FROM lines")
def md_is_subfilter(spark, sf):
    """Two filters, listed from the wider one."""
    s = lines(spark, sf)
    s.add_filter_var("narrow", [{"rf": lg.has_any([1])}, {"ls": lg.has_any([1])}])
    s.add_filter_var("wide", [{"rf": lg.has_any([1, 2])}])
    names = ["wide", "narrow"] if s.is_subfilter("wide", "narrow") and not s.compare_filter("wide", "narrow") else []
    counts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in names])
    return s.df.agg(*[F.sum(s.manifest_filter(n).cast("long")).alias(n) for n in names]).select(F.explode(counts).alias("r")).select("r.*")


@query("md_take", f"WITH {USERS} SELECT user_id, n FROM users WHERE list_contains(acts, 3) AND n > 5")
def md_take(spark, sf):
    """A filtered survey, filtered once more."""
    s = users(spark, sf).filter("buyers", {"acts": lg.has_any([3])})
    return s.df.filter(s.take({"n": lg.is_gt(5)})).select("user_id", "n")


# ------------------------------------------------------------- rules, stacks, weights


@query("md_new_text_key", codes_sql(LINES, "lines", "ls", "(1, 1, 'fini'), (2, 2, 'ouvert')"))
def md_new_text_key(spark, sf):
    """Labels of a language that the metadata didn't know before."""
    s = lines(spark, sf)
    s.meta.extend_text_keys(["fr-BE-x"])
    s.meta.set_value_texts("ls", {1: "fini", 2: "ouvert"}, text_key="fr-BE-x")
    return counted(s, "ls", "fr-BE-x")


@query("rl_slicers", f"WITH {LINES}, c AS (SELECT seg, count(*) AS n FROM lines WHERE seg IS NOT NULL AND seg <> 2 GROUP BY 1) SELECT 'x' AS axis, CAST(row_number() OVER (ORDER BY n DESC, seg) AS INT) AS pos, CAST(seg AS VARCHAR) AS code FROM c")
def rl_slicers(spark, sf):
    """The order that rules give to codes, one of which they hide."""
    s = lines(spark, sf)
    s.meta.sort_rule("seg")
    s.meta.hide("seg", [2], "x")
    told = rules.shown(s, "seg", axis="x")["x"]
    found = rules.slicers(s, s.crosstab("seg"), "seg") if set(told) == {"sortx", "dropx"} else {}
    return local_frame(spark, [("x", i, c) for i, c in enumerate((c for c in found["x"] if c != ALL), 1)], "axis string, pos int, code string")


@query("bt_from_spss", f"WITH {GRID} SELECT CAST(half AS VARCHAR) AS x_code, CAST(count(*) AS DOUBLE) AS value FROM grid GROUP BY 1")
def bt_from_spss(spark, sf):
    """A stack of a survey that an SPSS file holds."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    os.makedirs(path.removeprefix("file://"))
    write_spss(grid(spark, sf), f"{path.removeprefix('file://')}/grid.sav")
    made = Stack.from_spss(spark, "parts", f"{path}/grid.sav")
    made.add_link("parts", x=["half"], y=["@"], views=["counts"])
    return made.results.filter("x_var = 'half' AND view LIKE '%counts'").select("x_code", "value")


@query("bt_survey_of_stack", f"WITH {LINES} SELECT rf, count(*) AS n FROM lines WHERE ls = 1 GROUP BY 1")
def bt_survey_of_stack(spark, sf):
    """A stack's survey under one of its filters."""
    made = Stack(spark, "s", {"lines": lines(spark, sf)})
    made.add_link("lines", filters=[{"done": {"ls": [1]}}], x=["rf"], y=["@"])
    return made.survey("lines", "done").df.groupBy("rf").agg(F.count(F.lit(1)).alias("n"))


@query("bt_merge_link", f"WITH {LINES} SELECT CAST(rf AS VARCHAR) AS x_code, CAST(count(*) AS DOUBLE) AS value FROM lines GROUP BY 1")
def bt_merge_link(spark, sf):
    """One stack takes over a link's views from another."""
    a, b = (Stack(spark, n, {"lines": lines(spark, sf)}) for n in "ab")
    for s, views in ((a, ["cbase"]), (b, ["cbase", "counts"])):
        s.add_link("lines", x=["rf"], y=["@"], views=views)
    a.merge_link(b, "lines", "no_filter", "rf", "@")
    return a.results.filter("view LIKE '%counts'").select("x_code", "value")


@query("wt_impute", f"""WITH {LINES}, md AS (SELECT seg AS mode FROM lines WHERE seg IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
f AS (SELECT coalesce(seg, mode) AS seg FROM lines, md), n AS (SELECT seg, count(*) AS n FROM f GROUP BY 1), t AS (SELECT sum(n) AS t FROM n)
SELECT seg, round(CASE seg WHEN 1 THEN 0.4 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 0.1 END * t / n, 6) AS weight FROM n, t""")
def wt_impute(spark, sf):
    """Weights to one target; rows without a code count as the most frequent one."""
    s = lines(spark, sf)
    s.weight(weighting.Scheme("one").targets({"seg": {1: 40.0, 2: 30.0, 3: 20.0, 4: 10.0}}).impute("mode"), "rim")
    return s.df.filter("seg IS NOT NULL").groupBy("seg").agg(F.round(F.avg("rim"), 6).alias("weight"))
