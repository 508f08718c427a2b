"""Batches, stacks, chains, files and audits."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..audit import Audit
from ..operators.recode import format_set
from ..report.batch import Batch
from ..report.chains import Chain
from ..report.stack import Stack
from ..session import shared_dir
from ..sources import documents, spss
from .data import GRID, LINES, ORDERS, USERS, grid, lines, orders, users
from .tables import FUSED

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _stack(spark, sf) -> Stack:
    survey = lines(spark, sf)
    b = Batch(survey, "main", weights=[None, "w"])
    b.add_downbreak(["rf", "ls", "seg"])
    b.add_crossbreak(["ls", "seg"])
    made = Stack(spark, "lines", {"lines": survey})
    made.populate_batches("lines")
    return made


def _cells(stack: Stack, digits: int = 4):
    return stack.results.select("x_var", "x_code", "y_var", "y_code", "weight", "view", F.round("value", digits).alias("value"))


_ALL = f"""f AS ({FUSED}), heads AS (SELECT DISTINCT weight, y_var, y_code FROM f), codes AS (SELECT DISTINCT x_var, x_code FROM f),
c AS (SELECT weight, x_var, x_code, y_var, y_code, coalesce(value, 0) AS value, max(CASE WHEN x_code = 'All' THEN value END) OVER (PARTITION BY weight, x_var, y_var, y_code) AS base,
  max(CASE WHEN y_code = '@' THEN value END) OVER (PARTITION BY weight, x_var, x_code, y_var) AS row_base
  FROM heads CROSS JOIN codes LEFT JOIN f USING (weight, x_var, x_code, y_var, y_code))"""


@query("bt_stack_views", f"""WITH {_ALL}
SELECT x_var, x_code, y_var, y_code, weight, 'x|f|x:||' || weight || '|cbase' AS view, round(value, 4) AS value FROM c WHERE x_code = 'All'
UNION ALL SELECT x_var, x_code, y_var, y_code, weight, 'x|f|:||' || weight || '|counts', round(value, 4) FROM c WHERE x_code <> 'All'
UNION ALL SELECT x_var, x_code, y_var, y_code, weight, 'x|f|:|y|' || weight || '|c%', round(100 * value / nullif(base, 0), 4) FROM c WHERE x_code <> 'All'
UNION ALL SELECT x_var, x_code, y_var, y_code, weight, 'x|f|:|x|' || weight || '|r%', round(100 * value / nullif(row_base, 0), 4) FROM c WHERE x_code <> 'All'""")
def bt_stack_views(spark, sf):
    """Bases, counts, column and row percents of a batch of three by three variables and two weights, from one scan."""
    made = _stack(spark, sf)
    made.aggregate(["cbase", "counts", "c%", "r%"])
    return _cells(made)


@query("bt_stack_nets", f"""WITH {LINES}, r AS (SELECT seg, ls, w FROM lines WHERE seg IS NOT NULL AND ls IS NOT NULL),
y AS (SELECT seg, w, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM r),
n AS (SELECT y_code, sum(w) AS base, sum(CASE WHEN seg IN (1, 2) THEN w ELSE 0 END) AS low, sum(CASE WHEN seg IN (3, 4) THEN w ELSE 0 END) AS high FROM y GROUP BY 1),
l AS (SELECT y_code, base, unnest(['net:low', 'net:high', 'calc:difference']) AS x_code, unnest([low, high, low - high]) AS v FROM n)
SELECT x_code, y_code, round(v, 4) AS count, round(100 * v / base, 4) AS pct FROM l""")
def bt_stack_nets(spark, sf):
    """Two nets and their difference, weighted."""
    made = _stack(spark, sf)
    made.add_nets(["seg"], [{"low": [1, 2]}, {"high": [3, 4]}], calc={"calc": ("net_1", "-", "net_2"), "text": "difference"})
    own = made.results.filter("x_var = 'seg' AND y_var = 'ls' AND weight = 'w'")
    pct = F.col("view").contains("|y|")
    return own.groupBy("x_code", "y_code").agg(F.round(F.max(F.when(~pct, F.col("value"))), 4).alias("count"), F.round(F.max(F.when(pct, F.col("value"))), 4).alias("pct"))


@query("bt_stack_stats", f"""WITH {LINES}, r AS (SELECT CASE seg WHEN 1 THEN 100.0 WHEN 2 THEN 50.0 WHEN 3 THEN 0.0 END AS s, ls, w FROM lines WHERE seg IN (1, 2, 3) AND ls IS NOT NULL),
y AS (SELECT s, w, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM r),
m AS (SELECT y_code, sum(w) AS n, sum(w * s) / sum(w) AS mean, sum(w * s * s) AS q FROM y GROUP BY 1)
SELECT y_code, round(mean, 5) AS mean, round(sqrt((q - n * mean * mean) / (n - 1)), 5) AS stddev FROM m""")
def bt_stack_stats(spark, sf):
    made = _stack(spark, sf)
    made.add_stats(["seg"], ["mean", "stddev"], rescale={1: 100, 2: 50, 3: 0})
    own = made.results.filter("y_var = 'ls' AND weight = 'w'")
    return own.groupBy("y_code").agg(*[F.round(F.max(F.when(F.col("x_code") == s, F.col("value"))), 5).alias(s) for s in ("mean", "stddev")])


@query("bt_stack_cumulative", f"""WITH {LINES}, y AS (SELECT seg, w, unnest(['@', CAST(ls AS VARCHAR)]) AS y_code FROM lines WHERE seg IS NOT NULL AND ls IS NOT NULL),
s AS (SELECT seg, y_code, sum(w) AS w FROM y GROUP BY ALL)
SELECT CAST(seg AS VARCHAR) AS x_code, y_code, round(sum(w) OVER (PARTITION BY y_code ORDER BY seg), 4) AS value FROM s""")
def bt_stack_cumulative(spark, sf):
    made = _stack(spark, sf)
    made.cumulative_sum(["seg"])
    return made.results.filter("view = 'x|f.c:f|x++:||w|counts_cumsum' AND y_var = 'ls'").select("x_code", "y_code", F.round("value", 4).alias("value"))


@query("bt_stack_tests")
def bt_stack_tests(spark, sf):
    """Column tests of counts and means of the whole batch at 5 %."""
    made = _stack(spark, sf)
    made.add_tests([0.05])
    return made.results.select("x_var", "x_code", "y_var", "y_code", "weight", "view", "text")


@query("bt_describe", f"""WITH {_ALL} SELECT x_var, y_var, weight, CAST(count(DISTINCT x_code) - 1 AS INT) AS rows, CAST(count(DISTINCT y_code) AS INT) AS cols FROM c GROUP BY ALL""")
def bt_describe(spark, sf):
    made = _stack(spark, sf)
    made.aggregate(["counts"], unweighted_base=False)
    return made.describe().select("x_var", "y_var", "weight", "rows", "cols")


@query("ch_table", f"""WITH {_ALL}, t AS (SELECT * FROM c WHERE weight = '' AND x_var = 'rf' AND (y_var = '@' OR y_var = 'ls' AND y_code <> '@'))
SELECT x_code, round(max(CASE WHEN y_var = '@' THEN 100 * value / base END), 4) AS total, round(max(CASE WHEN y_code = '1' THEN 100 * value / base END), 4) AS f, round(max(CASE WHEN y_code = '2' THEN 100 * value / base END), 4) AS o
FROM t WHERE x_code <> 'All' GROUP BY 1""")
def ch_table(spark, sf):
    """One chain laid out: column percents of the total and two heads."""
    made = _stack(spark, sf)
    made.aggregate(["cbase", "c%"])
    wide = Chain.of(made, "lines", "no_filter", "rf", ["@", "ls"], ["x|f|:|y||c%"]).concat()
    return wide.select("x_code", *[F.round(F.col(f"`{c}`").cast("double"), 4).alias(n) for c, n in (("@:@", "total"), ("ls:1", "f"), ("ls:2", "o"))])


@query("bt_open_ends", f"""WITH {USERS} SELECT CAST(user_id AS VARCHAR) AS user_id, coalesce(array_to_string(list_transform(acts, lambda c: ['click', 'error', 'purchase', 'signup', 'view'][c]), ', '), '') AS acts
FROM users WHERE coalesce(list_has_any(acts, [3]), false)""")
def bt_open_ends(spark, sf):
    """A listing with codes as labels, under a filter."""
    s = users(spark, sf)
    b = Batch(s, "main")
    b.add_open_ends(["acts"], ["user_id"], drop_empty=True, filter_by={"acts": [3]})
    return b.open_ends("open ends")


@query("bt_hide_empty", "SELECT 'g_4' AS name")
def bt_hide_empty(spark, sf):
    s = grid(spark, sf)
    s.extend_items("g", ["nothing"])
    b = Batch(s, "main")
    b.add_downbreak(["g", "half"])
    return spark.createDataFrame([(n,) for n in b.hide_empty()], "name string")


@query("bt_to_dataset", f"WITH {ORDERS} SELECT prio, st FROM ord WHERE st = 1")
def bt_to_dataset(spark, sf):
    s = orders(spark, sf)
    b = Batch(s, "main")
    b.add_downbreak(["prio"])
    b.add_crossbreak(["st"])
    b.add_filter("finished", {"st": [1]})
    return b.to_dataset().df.select("prio", "st")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("io_document", f"WITH {USERS} SELECT user_id, CASE WHEN acts IS NULL THEN NULL ELSE array_to_string(acts, ';') || ';' END AS acts, n, round(total, 4) AS total FROM users")
def io_document(spark, sf):
    """Written as a JSON document and CSV, and read back."""
    where = _folder(spark)
    documents.write_survey(users(spark, sf), f"{where}/meta", f"{where}/data")
    back = documents.read_survey(spark, f"{where}/meta", f"{where}/data")
    return back.df.select("user_id", format_set(F.col("acts")).alias("acts"), "n", F.round("total", 4).alias("total"))


@query("io_parquet", f"WITH {ORDERS} SELECT okey, prio, st, CASE WHEN flags IS NULL THEN NULL ELSE array_to_string(flags, ';') || ';' END AS flags FROM ord")
def io_parquet(spark, sf):
    where = _folder(spark)
    documents.save_parquet(orders(spark, sf), where)
    return documents.load_parquet(spark, where).df.select("okey", "prio", "st", format_set(F.col("flags")).alias("flags"))


@query("io_spss", f"WITH {GRID} SELECT pkey, g_1, g_2, g_3, half FROM grid")
def io_spss(spark, sf):
    """Written as an SPSS system file, and read back by the reader."""
    where = _folder(spark)
    path = where.removeprefix("file://")
    if "://" in path:
        raise ValueError("SPSS files are written to local folders alone")
    os.makedirs(path)
    spss.write_spss(grid(spark, sf), f"{path}/grid.sav")
    return spss.read_spss(spark, f"{where}/grid.sav").df.select(F.col("pkey").cast("long"), *[F.col(c).cast("int") for c in ("g_1", "g_2", "g_3", "half")])


@query("ad_audit", "SELECT 'cats' AS report, 'seg' AS name UNION ALL SELECT 'labels', 'rf'")
def ad_audit(spark, sf):
    a, b = lines(spark, sf), lines(spark, sf)
    b.meta.remove_values("seg", [4])
    b.meta.set_variable_text("rf", "What came back", "main")
    found = Audit({"a": a, "b": b})
    rows = [("cats", r["name"]) for r in found.report_cat_diffs()] + [("labels", r["name"]) for r in found.report_label_diffs()]
    return spark.createDataFrame(rows, "report string, name string")
