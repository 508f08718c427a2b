"""Batches and chains: what a batch asks for, and how tables are cut, ordered, joined and labelled."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import logic as lg
from ..plans.tabulate import ALL, TOTAL
from ..report.batch import Batch
from ..report.chains import Chain, ChainManager, Cluster
from ..report.stack import Stack
from ..session import shared_dir
from .data import LINES, lines

QUERIES: dict = {}
ORACLES: dict = {}

COUNTS, PERCENTS, BASE = "x|f|:|||counts", "x|f|:|y||c%", "x|f|x:|||cbase"
_N = "CAST(count(*) AS DOUBLE)"


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _stack(spark, sf, edit=None, views=("cbase", "counts", "c%")) -> Stack:
    """A batch of seg and rf against ls; ``edit`` changes the batch before it is counted."""
    survey = lines(spark, sf)
    batch = Batch(survey, "main")
    batch.add_downbreak(["seg", "rf"])
    batch.add_crossbreak(["ls"])
    if edit:
        edit(batch)
    made = Stack(spark, "lines", {"lines": survey})
    made.populate_batches("lines")
    made.aggregate(list(views))
    return made


def _chain(spark, sf, x="seg", views=(BASE, COUNTS, PERCENTS)) -> Chain:
    return Chain.of(_stack(spark, sf), "lines", "no_filter", x, ["@", "ls"], list(views))


def _counts(stack: Stack):
    """The counts of all links, totals and bases left out."""
    rows = stack.results.filter(F.col("view").endswith("|counts") & (F.col("x_code") != ALL) & (F.col("y_code") != TOTAL) & (F.col("value") != 0))
    return rows.select("x_var", "x_code", "y_var", "y_code", "value")


def _pair(x: str, y: str, where: str = "") -> str:
    return f"SELECT '{x}' AS x_var, CAST({x} AS VARCHAR) AS x_code, '{y}' AS y_var, CAST({y} AS VARCHAR) AS y_code, {_N} AS value FROM lines WHERE {x} IS NOT NULL AND {y} IS NOT NULL {where} GROUP BY ALL"


# -------------------------------------------------------------------------- batches


@query("bt_extend_x", f"WITH {LINES} {_pair('seg', 'ls')} UNION ALL {_pair('rf', 'ls')} UNION ALL {_pair('ls', 'ls')}")
def bt_extend_x(spark, sf):
    """A further variable down the side."""
    return _counts(_stack(spark, sf, lambda b: b.extend_x(["ls"]), ("counts",)))


@query("bt_extend_y", f"WITH {LINES} {_pair('seg', 'ls')} UNION ALL {_pair('rf', 'ls')} UNION ALL {_pair('seg', 'rf')}")
def bt_extend_y(spark, sf):
    """A further head for one variable alone."""
    return _counts(_stack(spark, sf, lambda b: b.extend_y(["rf"], on=["seg"]), ("counts",)))


@query("bt_replace_y", f"WITH {LINES} {_pair('rf', 'ls')} UNION ALL {_pair('seg', 'rf')}")
def bt_replace_y(spark, sf):
    """Heads of its own for one variable."""
    return _counts(_stack(spark, sf, lambda b: b.replace_y(["rf"], on=["seg"]), ("counts",)))


@query("bt_filter", f"WITH {LINES} {_pair('seg', 'ls', 'AND qty > 25')} UNION ALL {_pair('rf', 'ls', 'AND qty > 25')}")
def bt_filter(spark, sf):
    return _counts(_stack(spark, sf, lambda b: b.add_filter("many", {"qty": lg.is_gt(25)}), ("counts",)))


@query("bt_extend_filter", f"WITH {LINES} {_pair('seg', 'ls', 'AND qty > 25 AND rf = 2')} UNION ALL {_pair('rf', 'ls', 'AND qty > 25')}")
def bt_extend_filter(spark, sf):
    """A batch's filter, narrower for one variable."""

    def edit(b):
        b.add_filter("many", {"qty": lg.is_gt(25)})
        b.extend_filter({"seg": {"rf": [2]}})

    return _counts(_stack(spark, sf, edit, ("counts",)))


@query("bt_sample_size", f"WITH {LINES} SELECT 'main' AS batch, count(*) AS n FROM lines WHERE qty > 25 UNION ALL SELECT 'all', count(*) FROM lines")
def bt_sample_size(spark, sf):
    survey = lines(spark, sf)
    one, two = Batch(survey, "main"), Batch(survey, "all")
    one.add_filter("many", {"qty": lg.is_gt(25)})
    return spark.createDataFrame([(b.name, b.sample_size()) for b in (one, two)], "batch string, n long")


@query("bt_edits", f"WITH {LINES}, m(code, label) AS (VALUES (1, 'first'), (2, 'segment 2'), (3, 'segment 3'), (4, 'segment 4')) SELECT label, count(*) AS n FROM lines JOIN m ON seg = code GROUP BY 1")
def bt_edits(spark, sf):
    """Labels that a batch changes for itself."""
    survey = lines(spark, sf)
    batch = Batch(survey, "main")
    batch.add_downbreak(["seg"])
    batch.set_value_texts("seg", {1: "first"})
    texts = batch.edited().meta.value_texts("seg")
    label = F.coalesce(*[F.when(F.col("seg") == c, F.lit(t)) for c, t in texts.items()])
    return survey.df.filter("seg IS NOT NULL").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- chains

_SEG = f"WITH {LINES}, t AS (SELECT seg, ls FROM lines WHERE seg IS NOT NULL), c AS (SELECT seg, count(*) AS n, count(*) FILTER (WHERE ls = 1) AS f, count(*) FILTER (WHERE ls = 2) AS o FROM t GROUP BY 1), b AS (SELECT sum(n) AS n, sum(f) AS f, sum(o) AS o FROM c)"


@query("ch_paint", f"{_SEG} SELECT 'segment ' || seg AS x_label, 'F' AS y_label, CAST(f AS DOUBLE) AS value FROM c UNION ALL SELECT 'segment ' || seg, 'O', CAST(o AS DOUBLE) FROM c")
def ch_paint(spark, sf):
    """Counts with labels in place of codes."""
    painted = _chain(spark, sf).paint()
    return painted.frame.filter((F.col("view") == COUNTS) & (F.col("y_var") == "ls") & (F.col("y_code") != TOTAL) & (F.col("x_code") != ALL)).select("x_label", "y_label", "value")


@query("ch_sorted", f"{_SEG} SELECT CAST(seg AS VARCHAR) AS x_code, CAST(row_number() OVER (ORDER BY n DESC, seg) AS INT) AS x_pos, round(100.0 * n / (SELECT n FROM b), 4) AS value FROM c")
def ch_sorted(spark, sf):
    """Rows by the total's percents."""
    made = _chain(spark, sf, views=(PERCENTS,)).sorted()
    return made.frame.filter(F.col("y_code") == TOTAL).select("x_code", "x_pos", F.round("value", 4).alias("value"))


@query("ch_cut", f"{_SEG} SELECT 'counts' AS kind, CAST(seg AS VARCHAR) AS x_code, CAST(n AS DOUBLE) AS value FROM c WHERE seg IN (2, 3) UNION ALL SELECT 'cbase', 'All', CAST(n AS DOUBLE) FROM b")
def ch_cut(spark, sf):
    """Two rows of counts, with their base."""
    made = _chain(spark, sf).cut([2, 3], ci="counts", base=True)
    return made.frame.filter(F.col("y_code") == TOTAL).select(F.element_at(F.split("view", r"\|"), -1).alias("kind"), "x_code", "value").distinct()


@query("ch_save", f"{_SEG} SELECT CAST(seg AS VARCHAR) AS x_code, CAST(f AS DOUBLE) AS f, CAST(o AS DOUBLE) AS o FROM c")
def ch_save(spark, sf):
    """A chain stored and read again."""
    where = f"{shared_dir(spark)}/chain-{uuid.uuid4().hex}"
    _chain(spark, sf, views=(COUNTS,)).save(where)
    wide = Chain.load(spark, where).concat().filter(F.col("x_code") != ALL)
    return wide.select("x_code", *[F.col(f"`ls:{c}`").cast("double").alias(n) for c, n in ((1, "f"), (2, "o"))])


@query("ch_describe", f"{_SEG} SELECT 'seg' AS x_var, CAST(seg AS VARCHAR) AS x_code, 'normal counts' AS kind FROM c")
def ch_describe(spark, sf):
    """What kind each row of counts is."""
    return _chain(spark, sf, views=(COUNTS,)).describe().filter(F.col("x_code") != ALL).select("x_var", "x_code", "kind")


def _manager(spark, sf, views=(COUNTS,)) -> ChainManager:
    return ChainManager(_stack(spark, sf)).get("lines", x_keys=["seg", "rf"], y_keys=["@", "ls"], views=list(views))


_BOTH = f"WITH {LINES}, t AS (SELECT 'seg' AS x_var, seg AS code FROM lines UNION ALL SELECT 'rf', rf FROM lines)"


@query("cm_join", f"{_BOTH} SELECT x_var, CAST(code AS VARCHAR) AS x_code, {_N} AS value FROM t WHERE code IS NOT NULL GROUP BY ALL")
def cm_join(spark, sf):
    """Two chains as one summary."""
    made = _manager(spark, sf).join("All").chains[0]
    return made.frame.filter((F.col("y_code") == TOTAL) & (F.col("x_code") != ALL)).select("x_var", "x_code", "value").distinct()


@query("cm_reorder", f"{_BOTH} SELECT 1 AS place, 'flags' AS chain, CAST(code AS VARCHAR) AS x_code, {_N} AS value FROM t WHERE x_var = 'rf' GROUP BY ALL UNION ALL SELECT 2, 'seg', CAST(code AS VARCHAR), {_N} FROM t WHERE x_var = 'seg' AND code IS NOT NULL GROUP BY ALL")
def cm_reorder(spark, sf):
    """Chains in a new order, one with a new name, after a round trip through their files."""
    where = f"{shared_dir(spark)}/chains-{uuid.uuid4().hex}"
    _manager(spark, sf).reorder(["rf", "seg"]).rename({"rf": "flags"}).save(where)
    made = None
    for i, c in enumerate(ChainManager.load(spark, where), 1):
        own = c.frame.filter((F.col("y_code") == TOTAL) & (F.col("x_code") != ALL)).select(F.lit(i).alias("place"), F.lit(c.name).alias("chain"), "x_code", "value").distinct()
        made = own if made is None else made.unionByName(own)
    return made


@query("cm_cut", f"{_BOTH} SELECT x_var, CAST(code AS VARCHAR) AS x_code, {_N} AS value FROM t WHERE code = 1 GROUP BY ALL")
def cm_cut(spark, sf):
    """One code's row of every chain, in a folder."""
    made = _manager(spark, sf).cut([1]).fold("firsts").folders["firsts"]
    rows = made[0].frame.unionByName(made[1].frame)
    return rows.filter(F.col("y_code") == TOTAL).select("x_var", "x_code", "value").distinct()


@query("cl_bank", f"WITH {LINES} SELECT 'segments' AS label, CAST(count(seg) AS DOUBLE) AS value FROM lines UNION ALL SELECT 'flags', CAST(count(rf) AS DOUBLE) FROM lines")
def cl_bank(spark, sf):
    """The bases of two chains as rows of one table."""
    seg, rf = _manager(spark, sf, (BASE,)).chains
    bank = Cluster("bases").bank_chains("Bases", [(seg, BASE, "segments"), (rf, BASE, "flags")])
    return bank.frame.filter(F.col("y_code") == TOTAL).select(F.col("x_code").alias("label"), "value").distinct()
