"""Multivariate measures from one pass of sums; what is left is small and done in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_upper, f_upper, t_two_sided
from ..plans.tabulate import ALL, TOTAL, cells, quoted, weight_of


def moments(survey, names: list[str], weight: str | None = None, where=None, listwise: bool = True) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(rows, W, weighted sums, weighted cross-products) of rows with all values, from one aggregation."""
    w = weight_of(survey, weight)
    rows = survey.filtered(where).select(w.alias("__w"), *[quoted(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)]).dropna()
    k = len(names)
    asked = [F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w")]
    asked += [F.sum(F.col("__w") * F.col(f"v{i}")).alias(f"s{i}") for i in range(k)]
    asked += [F.sum(F.col("__w") * F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    r = rows.agg(*asked).first()
    cross = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return float(r.n), float(r.w or 0), np.array([r[f"s{i}"] or 0.0 for i in range(k)]), cross


def covariance(survey, x: list[str], y: list[str], weight: str | None = None, where=None, listwise: bool = False) -> DataFrame:
    """Of each pair: n, cov (over W - 1) and corr with its two-sided p."""
    rows = []
    for a in x:
        for b in y:
            names = list(dict.fromkeys([a, b, *(x + y if listwise else [])]))
            n, w, s, c = moments(survey, names, weight, where)
            i, j = names.index(a), names.index(b)
            cov = lambda i, j, c=c, s=s, w=w: (c[i, j] - s[i] * s[j] / w) / (w - 1) if w > 1 else math.nan
            sd = math.sqrt(max(cov(i, i), 0) * max(cov(j, j), 0))
            r = cov(i, j) / sd if sd else math.nan
            t = r * math.sqrt((w - 2) / (1 - r * r)) if w > 2 and abs(r) < 1 else math.inf
            p = float(t_two_sided(t, w - 2)) if math.isfinite(t) and w > 2 else 0.0
            rows.append((a, b, int(n), w, float(cov(i, j)), float(r), p))
    return survey.spark.createDataFrame(rows, "x string, y string, n long, w double, cov double, corr double, p double")


def covariance_column(x: str, y: str, weight=None) -> F.Column:
    """Weighted covariance as one aggregate expression."""
    w = weight if weight is not None else F.lit(1.0)
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    both = a.isNotNull() & b.isNotNull() & w.isNotNull()
    s = lambda c: F.sum(F.when(both, c))
    return (s(w * a * b) - s(w * a) * s(w * b) / s(w)) / (s(w) - 1)


def observed(survey, x: str, y: str, weight: str | None = None, where=None) -> tuple[list[str], list[str], np.ndarray]:
    """The inner table on the driver: x codes, y codes, counts."""
    rows = cells(survey, x, y, weight, where).filter((F.col("x_code") != ALL) & (F.col("y_code") != TOTAL)).collect()
    xs = [c for c, _ in sorted({(r.x_code, r.x_pos) for r in rows}, key=lambda v: v[1])]
    ys = [c for c, _ in sorted({(r.y_code, r.y_pos) for r in rows}, key=lambda v: v[1])]
    table = np.zeros((len(xs), len(ys)))
    for r in rows:
        table[xs.index(r.x_code), ys.index(r.y_code)] = r.w
    return xs, ys, table


def mass(table: np.ndarray, margin: str | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    row, column = table.sum(axis=1) / table.sum(), table.sum(axis=0) / table.sum()
    return row if margin == "x" else column if margin == "y" else (row, column)


def expected(table: np.ndarray) -> np.ndarray:
    return np.outer(table.sum(axis=1), table.sum(axis=0)) / table.sum()


def expected_counts(result: DataFrame) -> DataFrame:
    """Row total times column total over the total, cell by cell, in Spark."""
    inner = result.filter((F.col("x_code") != ALL) & (F.col("y_code") != TOTAL))
    over = lambda *k: Window.partitionBy(*[F.col(c) for c in k])
    made = F.sum("w").over(over("x_code")) * F.sum("w").over(over("y_code")) / F.nullif(F.sum("w").over(over("x_var", "y_var")), F.lit(0.0))
    return inner.withColumn("value", made)


def chi_square(table: np.ndarray, as_inertia: bool = False) -> dict[str, float]:
    e = expected(table)
    stat = float((np.where(e > 0, (table - e) ** 2 / np.where(e > 0, e, 1), 0)).sum())
    dof = (table.shape[0] - 1) * (table.shape[1] - 1)
    return {"chi2": stat / table.sum() if as_inertia else stat, "dof": dof, "p": chi2_upper(stat, dof) if dof else 1.0}


def correspondence(table: np.ndarray, norm: str = "sym") -> dict[str, np.ndarray]:
    """Coordinates of rows and columns, and each axis' inertia with its share."""
    p = table / table.sum()
    r, c = p.sum(axis=1), p.sum(axis=0)
    residual = (p - np.outer(r, c)) / np.sqrt(np.outer(r, c))
    u, s, vt = np.linalg.svd(residual, full_matrices=False)
    k = min(table.shape) - 1
    u, s, vt = u[:, :k], s[:k], vt[:k]
    power = {"sym": (0.5, 0.5), "rows": (1.0, 0.0), "cols": (0.0, 1.0), "principal": (1.0, 1.0)}[norm]
    inertia = s**2
    return {"rows": u / np.sqrt(r)[:, None] * s ** power[0], "columns": vt.T / np.sqrt(c)[:, None] * s ** power[1], "inertia": inertia, "share": inertia / inertia.sum() if inertia.sum() else inertia}


@dataclass
class Fit:
    """Weighted least squares of y on x from cross-products."""

    names: list[str]
    coefs: np.ndarray
    se: np.ndarray
    t: np.ndarray
    p: np.ndarray
    n: float
    r2: float
    adjusted: float
    f: float
    f_p: float
    betas: np.ndarray
    sums: dict[str, float] = field(default_factory=dict)


def _fit(s: np.ndarray, c: np.ndarray, w: float, k: list[int]) -> tuple[np.ndarray, float, float]:
    """Coefficients (intercept first), regression and total sums of squares; y is the last variable."""
    y = len(s) - 1
    a = np.zeros((len(k) + 1, len(k) + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = w, s[k], s[k], c[np.ix_(k, k)]
    b = np.concatenate([[s[y]], c[k, y]])
    coefs = np.linalg.solve(a, b)
    total = c[y, y] - s[y] ** 2 / w
    return coefs, float(coefs @ b - s[y] ** 2 / w), float(total)


def linear_model(survey, y: str, x: list[str], weight: str | None = None, where=None) -> Fit:
    n, w, s, c = moments(survey, [*x, y], weight, where)
    k = list(range(len(x)))
    coefs, explained, total = _fit(s, c, w, k)
    dof = w - len(x) - 1
    rest = total - explained
    a = np.zeros((len(x) + 1, len(x) + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = w, s[k], s[k], c[np.ix_(k, k)]
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(a)) * rest / dof, 0))
    t = coefs / np.where(se > 0, se, np.nan)
    sd = np.sqrt(np.maximum(np.diag(c) - s**2 / w, 0))
    f = (explained / len(x)) / (rest / dof) if rest > 0 else math.inf
    r2 = explained / total if total else math.nan
    return Fit(["intercept", *x], coefs, se, t, np.asarray(t_two_sided(t, dof)), n, r2, 1 - (1 - r2) * (w - 1) / dof, f, float(f_upper(f, len(x), dof)) if math.isfinite(f) else 0.0, coefs[1:] * sd[:-1] / sd[-1], {"model": explained, "residual": rest, "total": total})


def shapley_r2(survey, y: str, x: list[str], weight: str | None = None, where=None, norm: bool = True) -> dict[str, float]:
    """Each variable's mean gain in R2 over all subsets of the others (averaged by subset size); one aggregation in all."""
    _, w, s, c = moments(survey, [*x, y], weight, where)

    def r2(k: tuple[int, ...]) -> float:
        if not k:
            return 0.0
        _, explained, total = _fit(s, c, w, list(k))
        return explained / total

    known = {k: r2(k) for size in range(len(x) + 1) for k in combinations(range(len(x)), size)}
    out = {}
    for i, name in enumerate(x):
        by_size: dict[int, list[float]] = {}
        for k, value in known.items():
            if i not in k:
                by_size.setdefault(len(k), []).append(known[tuple(sorted((*k, i)))] - value)
        out[name] = float(np.mean([np.mean(v) for v in by_size.values()]))
    whole = sum(out.values())
    return {n: v / whole * 100 for n, v in out.items()} if norm and whole else out


def action_matrix(performance: dict[str, float], importance: dict[str, float]) -> dict[str, tuple[float, float, str]]:
    """z-scores of performance and importance, and the quadrant."""

    def z(values: dict[str, float]) -> dict[str, float]:
        v = np.array(list(values.values()))
        sd = v.std(ddof=1) if len(v) > 1 else 1.0
        return {n: float((x - v.mean()) / sd) if sd else 0.0 for n, x in values.items()}

    p, i = z(performance), z(importance)
    names = {(True, True): "maintain", (True, False): "overdone", (False, True): "improve", (False, False): "observe"}
    return {n: (p[n], i[n], names[p[n] >= 0, i[n] >= 0]) for n in performance}
