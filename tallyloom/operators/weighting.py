"""Rim weighting.

Raking moves all rows with the same target codes alike, so the rows collapse to
the cells of the targets' codes in one aggregation, the rounds run in numpy on the
cells, and the factors join back by broadcast. The number of cells is the product
of the targets' codes at most; it is checked before it is collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tabulate import quoted

MOST_CELLS = 1_000_000


@dataclass
class Group:
    name: str
    where: object = None
    targets: list[dict[str, dict[int, float]]] = field(default_factory=list)


@dataclass
class Scheme:
    """Targets in percent by group; groups may get shares of the whole."""

    name: str
    groups: list[Group] = field(default_factory=list)
    group_shares: dict[str, float] = field(default_factory=dict)
    cap: float | tuple[float, float] | None = None
    total: float = 0.0
    most_rounds: int = 1000
    fills: dict[str | None, str] = field(default_factory=dict)

    def targets(self, targets: dict | list[dict], group: str = "all", where=None) -> Scheme:
        made = [targets] if isinstance(targets, dict) else targets
        self.groups.append(Group(group, where, [{v: t} for d in made for v, t in d.items()]))
        self.check(self.groups[-1])
        return self

    def impute(self, method: str, variable: str | None = None) -> Scheme:
        """Rows without a code of a target (of any that isn't named) are raked as if they had the mean, rounded, or the mode."""
        if method not in ("mean", "mode"):
            raise ValueError("missing codes are filled by mean or mode")
        self.fills[variable] = method
        return self

    def shares(self, shares: dict[str, float]) -> Scheme:
        """Below 2 in all they are parts of one, else percent."""
        scale = 100.0 if sum(shares.values()) > 2 else 1.0
        self.group_shares = {g: s / scale for g, s in shares.items()}
        return self

    def check(self, group: Group) -> None:
        for target in group.targets:
            for v, by in target.items():
                if abs(sum(by.values()) - 100) > 0.01:
                    raise ValueError(f"{self.name}, {group.name}: the targets of {v} sum to {sum(by.values())}, not 100")


def rake(cells: list[dict[str, int]], n: np.ndarray, targets: list[dict[str, dict[int, float]]], cap: float | tuple[float, float] | None = None, most_rounds: int = 1000) -> tuple[np.ndarray, int]:
    """The weight of each cell's rows, and the rounds taken."""
    w, total = np.ones(len(n)), float(n.sum())
    plans = []
    for target in targets:
        for v, by in target.items():
            codes = np.array([c[v] for c in cells])
            plans.append([(codes == code, max(share / 100 * total, 1e-8)) for code, share in by.items()])
    low, high = (None, None) if cap is None else (None, cap) if not isinstance(cap, tuple) else cap
    before, change = w.copy(), np.inf
    rounds = 0
    for rounds in range(1, most_rounds + 1):
        for plan in plans:
            for mask, wanted in plan:
                now = (w * n)[mask].sum()
                if now > 0:
                    w[mask] *= wanted / now
        if cap is not None:
            while ((w > high * (1 + 1e-9)).any() if high else False) or ((w < low * (1 - 1e-9)).any() if low else False):
                if high:
                    w = np.minimum(w, high)
                if low:
                    w = np.maximum(w, low)
                w = w / ((w * n).sum() / total)
        last, change = change, float((np.abs(w - before) * n).sum())
        before = w.copy()
        if change == 0 or not change < 0.99 * last:
            break
    return w, rounds


def weights(survey, scheme: Scheme, name: str = "weight") -> tuple[DataFrame, dict[str, int]]:
    """All rows with their weight, and the rounds of each group.

    Rows without a code of some target aren't raked and have weight 1. Rows of no
    group have none.
    """
    df = survey.df
    if len(scheme.groups) == 1 and scheme.groups[0].where is None:
        group = F.lit(scheme.groups[0].name)
    else:
        group = F.coalesce(*[F.when(survey.condition(g.where), F.lit(g.name)) for g in scheme.groups])
    variables = sorted({v for g in scheme.groups for t in g.targets for v in t})
    df = df.withColumn("__g", group)
    code = {v: quoted(v) for v in variables}
    if scheme.fills:
        asked = {v: scheme.fills.get(v, scheme.fills.get(None)) for v in variables}
        whole = {v: (F.round(F.avg(quoted(v))) if how == "mean" else F.mode(quoted(v), True)).cast(df.schema[v].dataType) for v, how in asked.items() if how}
        got = df.agg(*[c.alias(v) for v, c in whole.items()]).first() if whole else {}
        code |= {v: F.coalesce(quoted(v), F.lit(got[v])) for v in whole}
    found = df.filter("__g IS NOT NULL").groupBy("__g", *[c.alias(v) for v, c in code.items()]).agg(F.count(F.lit(1)).alias("n")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"the targets have over {MOST_CELLS} cells")
    rows, rounds, sizes, sums = [], {}, {}, {}
    for g in scheme.groups:
        names = [v for t in g.targets for v in t]
        own = [r for r in found if r["__g"] == g.name]
        whole = [r for r in own if all(r[v] is not None and any(r[v] in by for t in g.targets for tv, by in t.items() if tv == v) for v in names)]
        sizes[g.name] = sum(r.n for r in own)
        if whole:
            w, rounds[g.name] = rake([r.asDict() for r in whole], np.array([r.n for r in whole], float), g.targets, scheme.cap, scheme.most_rounds)
            w = np.where(w == 0, 1.0, w)
        else:
            w, rounds[g.name] = np.zeros(0), 0
        by_cell = {id(r): float(x) for r, x in zip(whole, w, strict=True)}
        sums[g.name] = sum(by_cell.get(id(r), 1.0) * r.n for r in own)
        rows += [[g.name, *(r[v] for v in variables), by_cell.get(id(r), 1.0)] for r in own]
    everyone = sum(sizes.values())
    for g, share in scheme.group_shares.items():
        if sizes.get(g):
            factor = share / (sizes[g] / everyone)
            for r in rows:
                if r[0] == g:
                    r[-1] *= factor
    if scheme.total:
        scale = everyone / scheme.total
        for r in rows:
            if r[-1] != 1:
                r[-1] /= scale
    schema = ", ".join(["__h string", *[f"`__v{i}` {df.schema[v].dataType.simpleString()}" for i, v in enumerate(variables)], "__w double"])
    table = survey.spark.createDataFrame([tuple(r) for r in rows], schema)
    on = F.col("__g") == F.col("__h")
    for i, v in enumerate(variables):
        on = on & code[v].eqNullSafe(F.col(f"__v{i}"))
    # as many rows as cells, which were counted above
    met = df.join(F.broadcast(table) if len(rows) < 100_000 else table, on, "left")
    return met.withColumn(name, F.col("__w")).drop("__g", "__h", "__w", *[f"__v{i}" for i in range(len(variables))]), rounds


def report(df: DataFrame, weight: str, by: str | None = None) -> DataFrame:
    """n, weighted n, efficiency, mean, min, max and their ratio."""
    w = quoted(weight)
    n, s, q = F.count(w), F.sum(w), F.sum(w * w)
    asked = [n.alias("n"), s.alias("n_weighted"), (100 * s * s / (n * q)).alias("efficiency"), F.avg(w).alias("mean"), F.min(w).alias("min"), F.max(w).alias("max"), (F.max(w) / F.min(w)).alias("ratio")]
    return df.filter(w.isNotNull()).groupBy(*([quoted(by)] if by else [])).agg(*asked)


def target_report(survey, weight: str, variable: str) -> DataFrame:
    """Of each code: rows and weighted rows, with percents."""
    w = quoted(weight)
    total = survey.df.filter(w.isNotNull() & quoted(variable).isNotNull())
    sums = total.groupBy(quoted(variable).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"))
    from pyspark.sql import Window

    everything = Window.partitionBy()
    return sums.select("code", "n", (100 * F.col("n") / F.sum("n").over(everything)).alias("n_pct"), "w", (100 * F.col("w") / F.sum("w").over(everything)).alias("w_pct"))


def checked(survey, group: Group) -> dict[str, dict[str, object]]:
    """Of each target variable: rows without a value, mean, mode and median."""
    out = {}
    for t in group.targets:
        for v in t:
            rows = survey.filtered(group.where)
            c = quoted(v)
            r = rows.agg(F.sum(c.isNull().cast("int")).alias("missing"), F.avg(c).alias("mean"), F.mode(c).alias("mode"), F.median(c).alias("median")).first()
            out[v] = r.asDict()
    return out
