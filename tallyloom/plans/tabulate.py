"""Cross-tabulation: cells of x by y from one aggregation, and all that follows from it.

A respondent enters a cell's base if x, and unless told otherwise y, has a valid
code. Each variable becomes an array of its valid codes with the margin in front,
so a respondent counts once in every margin however many codes are given. Rows
with equal codes collapse before they are exploded; that first aggregation runs
map-side in generated code, and what is shuffled and exploded is as large as the
number of distinct answers, not of respondents.

The long result has a row for each cell: x_var, x_code, x_pos, y_var, y_code,
y_pos, n (rows), w (weighted), w2 (squared weights). Codes are text; margins are
"All" on x and "@" on y. Codes without a respondent are there with zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import Logic, logic_key
from ..meta import CATEGORICAL, NUMERIC, SET, MetaError, Variable
from ..session import local_frame

ALL, TOTAL = "All", "@"
_MARGIN = -(1 << 31)
#: Cells up to which a result is broadcast to be joined with its frame: some tens of bytes each.
MOST_CELLS = 200_000
CELL = "x_var string, x_code string, x_pos int, y_var string, y_code string, y_pos int"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Axis:
    """A variable made ready: its valid codes as an array, and which rows it rules out."""

    name: str
    codes: list[int]
    texts: dict[int, str]
    #: the raw columns that decide the codes; rows collapse by these, which are mostly whole numbers
    keys: list[Column]
    #: the array of valid codes, made from the raw columns or from copies of them
    build: Callable[[list[Column]], Column]
    #: rows that no excluded code takes out
    valid: Column
    #: rows with a valid code
    answered: Column
    is_set: bool = False
    factors: dict[int, float] = field(default_factory=dict)
    #: codes of the levels of a nest, by code
    levels: dict[int, tuple[int, ...]] = field(default_factory=dict)
    #: codes left out; a variable's axes have equal raw columns if these are equal
    gone: frozenset[int] = frozenset()

    @property
    def array(self) -> Column:
        return self.build(self.keys)

    @property
    def combinations(self) -> float:
        """Different answers that there can be."""
        return 2.0 ** min(len(self.codes), 60) if self.is_set else len(self.codes) + 1.0


def _as_array(column: Column, kind: str, codes: Iterable[int]) -> Column:
    codes = list(codes)
    if kind == SET:
        return F.coalesce(F.filter(F.array_distinct(column), lambda c: c.isin(codes)), F.expr("cast(array() as array<int>)"))
    return F.when(column.isin(codes), F.array(column.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def axis(survey, name: str, exclude: Iterable[int] = (), stats: bool = False) -> Axis:
    """A variable, or a nest ``a > b`` of variables, as an axis. ``stats``: codes left out of statistics go too."""
    if ">" in name:
        return _nest(survey, [axis(survey, p.strip(), exclude) for p in name.split(">")], name)
    own: Variable = survey.meta[name]
    if own.type in NUMERIC and not own.values:
        raise MetaError(f"{name!r} is numeric; band or categorise it, or ask for statistics")
    if own.type not in CATEGORICAL and not own.values:
        raise MetaError(f"{name!r} is of type {own.type} and can't be tabulated")
    gone = {c for c, f in own.missings.items() if f == "exclude" or stats} | set(exclude)
    column = survey.column(name)
    kept = [v for v in own.values if v.code not in gone]
    codes = [v.code for v in kept]
    valid = F.lit(True)
    if gone:  # a respondent who gives an excluded code leaves the table with all of their codes
        hit = F.arrays_overlap(column, F.array(*map(F.lit, gone)).cast("array<int>")) if own.type == SET else column.isin(list(gone))
        valid = ~F.coalesce(hit, F.lit(False))
        column = F.when(valid, column)

    def build(keys: list[Column]) -> Column:
        return _as_array(keys[0], own.type, codes)

    answered = F.coalesce(F.exists(column, lambda c: c.isin(codes)) if own.type == SET else column.isin(codes), F.lit(False))
    key = survey.meta.text_key
    texts = {v.code: v.text.get(key) or next(iter(v.text.values()), "") for v in kept}
    return Axis(name, codes, texts, [column], build, valid, answered, own.type == SET, {v.code: float(v.code if v.factor is None else v.factor) for v in kept}, gone=frozenset(gone))


def _product(left: Column, left_codes: list[int], right: Column, right_codes: list[int]) -> Column:
    """The numbers of all pairs of codes of two arrays."""
    lefts, rights = (F.array(*map(F.lit, c)).cast("array<int>") for c in (left_codes, right_codes))
    pair = lambda a: lambda b: ((F.array_position(lefts, a) - 1) * len(right_codes) + F.array_position(rights, b)).cast("int")
    return F.flatten(F.transform(left, lambda a: F.transform(right, pair(a))))


def _nest(survey, parts: list[Axis], name: str) -> Axis:
    """Every combination of codes, in product order, as a code of its own."""
    made = parts[0]
    levels = {c: (c,) for c in made.codes}
    texts = made.texts
    for part in parts[1:]:
        n = len(part.codes)
        numbered = {i * n + j + 1: (a, b) for i, a in enumerate(made.codes) for j, b in enumerate(part.codes)}
        levels = {c: (*levels[a], b) for c, (a, b) in numbered.items()}
        texts = {c: f"{texts[a]} / {part.texts[b]}" for c, (a, b) in numbered.items()}

        def build(keys: list[Column], one: Axis = made, two: Axis = part) -> Column:
            k = len(one.keys)
            return _product(one.build(keys[:k]), one.codes, two.build(keys[k:]), two.codes)

        made = Axis(name, list(numbered), texts, [*made.keys, *part.keys], build, made.valid & part.valid, made.answered & part.answered, made.is_set or part.is_set)
    return replace(made, levels=levels, factors={c: float(c) for c in made.codes})


@dataclass(frozen=True)
class Net:
    """Codes (or a logic) counted together."""

    name: str
    codes: tuple[int, ...] = ()
    logic: Logic | dict | None = None
    expand: str | None = None
    text: str = ""


def nets_of(groups, expand: str | None = None) -> list[Net]:
    """From ``[1, 2]``, ``{"name": [1, 2]}``, a list of such dicts, or logic."""
    if isinstance(groups, (Logic, tuple)) or isinstance(groups, list) and groups and not isinstance(groups[0], (dict, Net)):
        groups = [{"net": groups}]
    made = []
    for g in [groups] if isinstance(groups, (dict, Net)) else groups:
        if isinstance(g, Net):
            made.append(g)
            continue
        own = dict(g)
        more = {k: own.pop(k) for k in ("expand", "text") if k in own}
        ((name, what),) = own.items()
        listed = isinstance(what, (list, range)) and all(isinstance(c, int) for c in what)
        made.append(Net(name, tuple(what) if listed else (), None if listed else what, more.get("expand", expand), more.get("text", "")))
    return made


def weight_of(survey, weight: str | None) -> Column:
    """Null and zero weights take a row out of weighted figures."""
    if weight in (None, "@1"):
        return F.lit(1.0)
    w = survey.column(weight).cast("double")
    return F.when(w != 0, w)


def _codes_of(made: Axis) -> list[tuple[str, int]]:
    return [(str(c), i + 1) for i, c in enumerate(made.codes)]


def frame(survey, x: list[tuple[str, str, int]], y: list[tuple[str, str, int]]) -> DataFrame:
    """The cells of the product, which are few and made on the driver."""
    return local_frame(survey.spark, [(*a, *b) for a in x for b in y], CELL)


def collapsed(survey, xa: Axis, ya: Axis | None, weight: str | None, where=None, base_all: bool = False, more: dict[str, Column] | None = None) -> DataFrame:
    """Distinct answers with rows, weights and squared weights: xs, ys (margins in front), n, w, w2."""
    axes = {"__x": xa} | ({"__y": ya} if ya is not None else {})
    keys = {f"{n}{i}": k for n, a in axes.items() for i, k in enumerate(a.keys)} | (more or {})
    rows = survey.filtered(where).filter(xa.valid & xa.answered if ya is None else xa.valid & ya.valid & xa.answered)
    if ya is not None and not base_all:
        rows = rows.filter(ya.answered)
    rows = rows.select(*[c.alias(n) for n, c in keys.items()], weight_of(survey, weight).alias("__w"))
    met = rows.filter("__w IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__w")).alias("w2"))
    arrays = {n: a.build([F.col(f"{n}{i}") for i in range(len(a.keys))]) for n, a in axes.items()}
    arrays.setdefault("__y", F.expr("cast(array() as array<int>)"))
    margin = F.array(F.lit(_MARGIN))
    return met.withColumns(arrays).withColumns({"__xs": F.concat(margin, "__x"), "__ys": F.concat(margin, "__y")})


def exploded(rows: DataFrame, name: str, array: Column | str, *more: Column | str, empty: bool = False) -> DataFrame:
    """Of collapsed rows a row for each element. ``empty``: arrays can be, and elements are never null.

    With a plain explode the optimizer tests that the array isn't empty, and as that
    depends on the answers alone, it does so below the aggregation, for every respondent.
    """
    made = rows.select(F.explode_outer(array).alias(name), *more)
    return made.filter(F.col(name).isNotNull()) if empty else made


def cells(survey, x: str, y: str | None = None, weight: str | None = None, where=None, base_all: bool = False, nets: list[Net] | None = None, complete: bool = False, exclude: Iterable[int] = (), limit: Iterable[int] | None = None, keep=None) -> DataFrame:
    """The long result of one link.

    nets: pseudo-codes ``net:<name>``; with expand their codes stand before or after
    them, and with complete the codes of no net too. limit: codes to keep, the base
    as it is. keep: a logic; rows it doesn't hold for stay in the base alone.
    """
    xa, ya = axis(survey, x, exclude), axis(survey, y) if y else None
    shown = _codes_of(xa)
    more: dict[str, Column] = {}
    if nets:
        _check_nets(nets, complete)
        more = {f"__net{i}": survey.logic(n.logic, x) for i, n in enumerate(nets) if n.logic is not None}
    if keep is not None:
        more["__keep"] = survey.logic(keep, x)
    met = collapsed(survey, xa, ya, weight, where, base_all, more)
    codes = F.col("__x")
    if limit is not None:
        codes = F.filter(codes, lambda c: c.isin(list(limit)))
        shown = [(c, i) for c, i in shown if int(c) in set(limit)]
    if keep is not None:
        codes = F.when(F.col("__keep"), codes).otherwise(F.expr("cast(array() as array<int>)"))
    texts = F.transform(codes, lambda c: c.cast("string"))
    if nets:
        hits = [F.when(F.col(f"__net{i}") if n.logic is not None else F.arrays_overlap(codes, F.array(*map(F.lit, n.codes)).cast("array<int>")), F.lit(f"net:{n.name}")) for i, n in enumerate(nets)]
        texts = F.concat(texts, F.array_compact(F.array(*hits)))
        shown = _net_order(nets, xa.codes, complete)
    met = exploded(met, "x_code", F.concat(F.array(F.lit(ALL)), texts), "__ys", "n", "w", "w2")
    met = exploded(met, "y_raw", "__ys", "x_code", "n", "w", "w2")
    y_code = F.when(F.col("y_raw") == _MARGIN, F.lit(TOTAL)).otherwise(F.col("y_raw").cast("string"))
    sums = met.groupBy("x_code", y_code.alias("y_code")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    all_cells = frame(survey, [(x, ALL, 0), *((x, c, i) for c, i in shown)], [(y or TOTAL, TOTAL, 0), *(((y, c, i) for c, i in _codes_of(ya)) if ya else ())])
    return filled(all_cells, sums)


def filled(all_cells: DataFrame, sums: DataFrame, on: Iterable[str] = ("x_code", "y_code"), few: bool = True) -> DataFrame:
    """All cells with their sums, zero where there are none. ``few``: at most MOST_CELLS of them."""
    # sums have a row for each cell of the metadata's codes at most, and those were counted on the driver
    sums = F.broadcast(sums) if few else sums
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("n", "long"), ("w", "double"), ("w2", "double"))}
    return all_cells.join(sums, list(on), "left").select(*all_cells.columns, *[c.alias(n) for n, c in zero.items()])


def _check_nets(nets: list[Net], complete: bool) -> None:
    if complete or any(n.expand for n in nets):
        codes = [c for n in nets for c in n.codes]
        if len(codes) > len(set(codes)):
            raise ValueError("with expand or complete a code can be in one net only")


def _net_order(nets: list[Net], codes: list[int], complete: bool) -> list[tuple[str, int]]:
    """Nets with their codes around them; with complete the unused codes at their places."""
    blocks: list[tuple[float, list[str]]] = []
    for n in nets:
        own = [str(c) for c in n.codes] if n.expand and len(n.codes) > 1 else []
        name = f"net:{n.name}"
        at = min((codes.index(c) for c in n.codes if c in codes), default=len(codes))
        blocks.append((at, [name, *own] if n.expand == "after" else [*own, name]))
    if complete:
        used = {c for n in nets for c in n.codes}
        blocks += [(i, [str(c)]) for i, c in enumerate(codes) if c not in used]
        blocks.sort(key=lambda b: b[0])
    return [(c, i + 1) for i, c in enumerate(c for _, own in blocks for c in own)]


# --------------------------------------------------------------- what follows


def margin(result: DataFrame, x_code: str | None, y_code: str | None, name: str) -> DataFrame:
    """The rows of one margin, renamed for a join: column base (x_code All) or row base (y_code @)."""
    if x_code is not None:
        return result.filter(F.col("x_code") == x_code).select(F.col("y_code").alias("__y"), F.col("w").alias(name))
    return result.filter(F.col("y_code") == y_code).select(F.col("x_code").alias("__x"), F.col("w").alias(name))


def share(value: Column, base: Column) -> Column:
    """Percent; null where there's no base."""
    return F.when(base != 0, value / base * 100)


def column_percent(result: DataFrame) -> DataFrame:
    base = F.max(F.when(F.col("x_code") == ALL, F.col("w"))).over(Window.partitionBy("y_code"))
    return result.withColumn("value", share(F.col("w"), base))


def row_percent(result: DataFrame) -> DataFrame:
    base = F.max(F.when(F.col("y_code") == TOTAL, F.col("w"))).over(Window.partitionBy("x_code"))
    return result.withColumn("value", share(F.col("w"), base))


def raw_sum(result: DataFrame) -> DataFrame:
    """Mentions: the sum over all codes, for each y; nets are no mentions."""
    return result.filter((F.col("x_code") != ALL) & ~F.col("x_code").startswith("net:")).groupBy("x_var", "y_var", "y_code", "y_pos").agg(F.sum("w").alias("value"))


def response_percent(result: DataFrame) -> DataFrame:
    """Of all mentions."""
    base = F.sum(F.when(F.col("x_code") != ALL, F.col("w"))).over(Window.partitionBy("y_code"))
    return result.filter(F.col("x_code") != ALL).withColumn("value", share(F.col("w"), base))


def cumulative(result: DataFrame, percent: bool = False) -> DataFrame:
    """Running sums down the codes in order."""
    down = Window.partitionBy("y_code").orderBy("x_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.max(F.when(F.col("x_code") == ALL, F.col("w"))).over(Window.partitionBy("y_code"))
    made = F.sum(F.when(F.col("x_code") != ALL, F.col("w"))).over(down)
    return result.withColumn("value", share(made, base) if percent else made).filter(F.col("x_code") != ALL)


def effective_base(result: DataFrame) -> DataFrame:
    """Kish: squared sum of weights over sum of squared weights."""
    return result.withColumn("value", F.when(F.col("w2") > 0, F.col("w") * F.col("w") / F.col("w2")))


def rebased(result: DataFrame, other: DataFrame, per_cell: bool = False) -> DataFrame:
    """Percent of another variable's column base, or cell by cell of its codes in order."""
    if per_cell:
        base = other.select(F.col("x_pos").alias("__p"), F.col("y_code").alias("__y"), F.col("w").alias("__b"))
        met = result.join(base, (F.col("x_pos") == F.col("__p")) & (F.col("y_code") == F.col("__y")), "left")
    else:
        met = result.join(margin(other, ALL, None, "__b"), F.col("y_code") == F.col("__y"), "left")
    return met.withColumn("value", share(F.col("w"), F.col("__b"))).select(*result.columns, "value")


_OPERATIONS = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b != 0, a / b * 100),
}


def calc(result: DataFrame, name: str, left: str, sign: str, right: str | float, column: str = "w", only: bool = False, on: str = "x") -> DataFrame:
    """Adds a row (or, on y, a column) computed from two others, or from one and a number; division gives percent."""
    code, keys = f"{on}_code", [c for c in result.columns if c.startswith("y_" if on == "x" else "x_")]
    pick = lambda c: F.max(F.when(F.col(code) == c, F.col(column)))
    made = result.groupBy(*keys).agg(pick(left).alias("__a"), (F.lit(float(right)) if not isinstance(right, str) else pick(right)).alias("__b"))
    last = F.lit(1 << 20)
    fixed = {f"{on}_var": F.lit(None).cast("string"), code: F.lit(f"calc:{name}"), f"{on}_pos": last.cast("int"), column: _OPERATIONS[sign](F.col("__a"), F.col("__b"))}
    made = made.select(*[(fixed[c] if c in fixed else F.col(c) if c in keys else F.lit(None).cast(result.schema[c].dataType)).alias(c) for c in result.columns])
    return made if only else result.unionByName(made)


# ------------------------------------------------------------------- statistics

STATS = ("mean", "var", "stddev", "sem", "varcoeff", "min", "max", "median", "lower_q", "upper_q")


def score_of(survey, x: str, factors: dict[int, float] | None = None, exclude: Iterable[int] = (), drop: bool = False) -> tuple[Column, Column, Column, Column]:
    """Which rows have a score, the score (the sum of their codes' factors), the sum of squared factors, and the number of codes."""
    own = survey.meta[x]
    if own.type in NUMERIC:
        gone = list(exclude)
        value = survey.column(x).cast("double")
        return value.isNotNull() & (~value.isin(gone) if gone else F.lit(True)), value, value * value, F.lit(1)
    xa = axis(survey, x, exclude, stats=True)
    score, squares, mentions = _code_scores(xa, xa.array, factors, drop)
    return xa.valid & (mentions > 0), score, squares, mentions


def _code_scores(xa: Axis, array: Column, factors: dict[int, float] | None, drop: bool) -> tuple[Column, Column, Column]:
    """Of an array of codes the sum of their factors, that of the squares, and how many have one."""
    by = {**({} if drop and factors else xa.factors), **(factors or {})}
    by = {c: f for c, f in by.items() if c in set(xa.codes)}
    if not by:
        raise ValueError(f"no code of {xa.name!r} has a factor")
    pairs = F.create_map(*[F.lit(v) for c, f in by.items() for v in (c, float(f))])
    held = F.filter(array, lambda c: c.isin(list(by)))
    zero = F.lit(0.0)
    score = F.aggregate(held, zero, lambda a, c: a + pairs[c])
    squares = F.aggregate(held, zero, lambda a, c: a + pairs[c] * pairs[c])
    return score, squares, F.size(held)


def _scored(survey, x: str, y: str | None, weight: str | None, where, factors: dict[int, float] | None, exclude: Iterable[int], drop: bool, order: str | None) -> tuple[DataFrame, Axis | None]:
    """Distinct scores by y (margins in front): score, squares of its codes' factors, w, and the first row's weight."""
    ya = axis(survey, y) if y else None
    w = weight_of(survey, weight)
    takes_part, score, squares, mentions = score_of(survey, x, factors, exclude, drop)
    rows = survey.filtered(where).filter(takes_part)
    if ya is not None:
        rows = rows.filter(ya.valid & ya.answered)
    ys = F.concat(F.array(F.lit(_MARGIN)), ya.array) if ya is not None else F.array(F.lit(_MARGIN))
    picked = rows.select(score.alias("s"), squares.alias("q"), mentions.alias("m"), w.alias("w"), ys.alias("ys"), (survey.column(order) if order else F.lit(0)).alias("o")).filter("w IS NOT NULL")
    # equal answers collapse before the explode; the least in order stands for the first of them
    met = picked.groupBy("s", "q", "m", "ys").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "w")).alias("first"))
    return met.withColumn("y", F.explode_outer("ys")), ya  # the margin is always there; see exploded


def _from_moments() -> dict[str, Column]:
    """Statistics from base, ws, wq and wm: sums of weights, scores, squared factors and codes."""
    mean = F.col("ws") / F.nullif(F.col("base"), F.lit(0.0))
    # the sum of w (f - mean)^2 over rows and codes, expanded
    spread = F.col("wq") - 2 * mean * F.col("ws") + mean * mean * F.col("wm")
    free = F.nullif(F.col("base") - 1, F.lit(0.0))
    var = F.when(spread / free > 1e-12, spread / free)
    return {"mean": mean, "var": var, "stddev": F.sqrt(var), "sem": F.sqrt(var / F.col("base")), "varcoeff": F.when(mean != 0, F.sqrt(var) / F.nullif(mean, F.lit(0.0)))}


def summarize(survey, x: str, y: str | None = None, weight: str | None = None, where=None, stats: Iterable[str] = STATS, factors: dict[int, float] | None = None, exclude: Iterable[int] = (), drop: bool = False, source: str | None = None, order: str | None = None, plain_sd_base: bool = False) -> DataFrame:
    """A row for each y code (margin @): base and the statistics asked for.

    source: the variable that the scores come from, on the rows where x has an
    answer. factors: code -> factor (with drop: codes without one leave). order:
    the column by which, of rows with equal scores, the first is found.
    """
    stats = list(stats)
    if source:
        where = [w for w in (where, _answered(survey, x)) if w is not None]
        x = source
    met, ya = _scored(survey, x, y, weight, where, factors, exclude, drop, order)
    sums = met.groupBy("y").agg(
        F.sum("w").alias("base"),
        F.sum("n").alias("n"),
        F.sum(F.col("w") * F.col("s")).alias("ws"),
        F.sum(F.col("w") * F.col("q")).alias("wq"),
        F.sum(F.col("w") * F.col("m")).alias("wm"),
        F.min("s").alias("min"),
        F.max("s").alias("max"),
    )
    sums = sums.withColumns(_from_moments())
    wanted = [s for s in ("lower_q", "median", "upper_q") if s in stats]
    if wanted:
        found = percentiles(met, {"lower_q": 0.25, "median": 0.5, "upper_q": 0.75})
        sums = sums.join(found, "y", "left")
    codes = [(TOTAL, _MARGIN, 0), *((c, int(c), i) for c, i in (_codes_of(ya) if ya else ()))]
    all_y = local_frame(survey.spark, codes, "y_code string, y int, y_pos int")
    return all_y.join(sums, "y", "left").select(F.lit(x).alias("x_var"), F.lit(y or TOTAL).alias("y_var"), "y_code", "y_pos", F.coalesce("base", F.lit(0.0)).alias("base"), *stats)


def _answered(survey, x: str) -> Column:
    own = survey.meta[x]
    if own.type in NUMERIC:
        return survey.column(x).isNotNull()
    made = axis(survey, x)
    return made.valid & made.answered


def percentiles(met: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Weighted percentiles of definition 6, k = (W + 1) p, from distinct scores.

    Between two scores the result depends on the weight of the first row of the
    upper one only, so the scan runs over distinct scores, not rows.
    """
    scores = met.groupBy("y", "s").agg(F.sum("w").alias("w"), F.min("first").alias("first"))
    up = Window.partitionBy("y").orderBy("s")
    over = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = scores.select(
        "y", "s", F.sum("w").over(over).alias("c"), F.lead("s").over(up).alias("next"), F.lead("first.w").over(up).alias("v"),
        F.sum("w").over(Window.partitionBy("y")).alias("total"), F.row_number().over(up).alias("i"), F.col("first.w").alias("own"),
    )
    out = []
    for name, p in wanted.items():
        k = (F.col("total") + 1) * p
        e = k - F.col("c")
        step = F.when(F.col("v") >= 1, e).otherwise(e / F.col("v"))
        between = F.when((e >= 1) | (e >= F.col("v")), F.col("next")).otherwise((1 - step) * F.col("s") + step * F.col("next"))
        # the last score whose cumulated weight is within k decides; none: the first score
        decided = F.when(F.col("c") <= k, F.when(F.col("next").isNull(), F.col("s")).otherwise(between))
        out.append(F.coalesce(F.max_by(decided, F.when(F.col("c") <= k, F.col("i"))), F.min_by("s", "i")).alias(name))
    return placed.groupBy("y").agg(*out)


# -------------------------------------------------------------- grids and levels


def grid_cells(survey, grid: str, weight: str | None = None, where=None, exclude: Iterable[int] = ()) -> DataFrame:
    """Codes by items; each item has its own base, the rows that answer it. Excluded codes leave item by item."""
    own = survey.meta.grids[grid]
    gone = {c for c, f in own.missings.items() if f == "exclude"} | set(exclude)
    codes = [v.code for v in own.values if v.code not in gone]
    items = [F.struct(F.lit(i).alias("item"), _as_array(survey.column(i), own.type, codes).alias("codes")) for i in own.items]
    rows = survey.filtered(where).select(weight_of(survey, weight).alias("w"), F.explode(F.array(*items)).alias("i")).select("w", "i.*").filter((F.size("codes") > 0) & F.col("w").isNotNull())
    met = rows.groupBy("item", "codes").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    met = exploded(met, "x_code", F.concat(F.array(F.lit(ALL)), F.transform("codes", lambda c: c.cast("string"))), "item", "n", "w", "w2")
    sums = met.groupBy("x_code", F.col("item").alias("y_code")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    all_cells = frame(survey, [(grid, ALL, 0), *((grid, str(c), i + 1) for i, c in enumerate(codes))], [(grid, i, n + 1) for n, i in enumerate(own.items)])
    return filled(all_cells, sums)


def level_cells(survey, grid: str, y: str | None = None, weight: str | None = None, where=None) -> DataFrame:
    """A grid's answers summed over its items; the base is the mentions, not the respondents."""
    own = survey.meta.grids[grid]
    ya = axis(survey, y) if y else None
    codes = [v.code for v in own.values if own.missings.get(v.code) != "exclude"]
    mentions = F.flatten(F.array(*[_as_array(survey.column(i), own.type, codes) for i in own.items]))
    ys = F.concat(F.array(F.lit(_MARGIN)), ya.array) if ya is not None else F.array(F.lit(_MARGIN))
    rows = survey.filtered(where)
    if ya is not None:
        rows = rows.filter(ya.valid & ya.answered)
    rows = rows.select(weight_of(survey, weight).alias("w"), mentions.alias("x"), ys.alias("ys")).filter("w IS NOT NULL")
    met = rows.groupBy("x", "ys").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    met = exploded(exploded(met, "c", "x", "ys", "n", "w", "w2", empty=True), "y", "ys", "c", "n", "w", "w2")
    each = F.explode(F.array(F.lit(ALL), F.col("c").cast("string")))
    y_code = F.when(F.col("y") == _MARGIN, F.lit(TOTAL)).otherwise(F.col("y").cast("string"))
    sums = met.select("n", "w", "w2", y_code.alias("y_code"), each.alias("x_code")).groupBy("x_code", "y_code").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w2").alias("w2"))
    all_cells = frame(survey, [(grid, ALL, 0), *((grid, str(c), i + 1) for i, c in enumerate(codes))], [(y or TOTAL, TOTAL, 0), *(((y, c, i) for c, i in _codes_of(ya)) if ya else ())])
    return filled(all_cells, sums)


# -------------------------------------------------------------------- many links


_NET = -(1 << 30)


#: Different answers up to which rows collapse before they are exploded; beyond, they would hardly get fewer.
MOST_ANSWERS = 200_000


def _pairs(array: Column, at: int, nets: Iterable[Column] = ()) -> Column:
    """(variable, code) of the margin, the codes and the nets of a row that has an answer; else nothing."""
    codes = F.concat(F.array(F.lit(_MARGIN)), array, *([F.array_compact(F.array(*nets))] if nets else []))
    pairs = F.transform(codes, lambda c: F.struct(F.lit(at).alias("v"), c.alias("c")))
    return F.when(F.size(array) > 0, pairs).otherwise(F.expr("cast(array() as array<struct<v:int,c:int>>)"))


def _all_pairs(arrays: list[Column]) -> Column:
    total = F.array(F.struct(F.lit(-1).alias("v"), F.lit(_MARGIN).alias("c")))
    return F.concat(total, *[_pairs(a, i) for i, a in enumerate(arrays)])


def fused(survey, xs: list[str], ys: list[str], weights: list[str | None] = (None,), where=None, nets: dict[str, list[Net]] | None = None) -> DataFrame:
    """Counts of all x by all y for several weights from one scan.

    Adds the column weight. Rows collapse by their raw answers if there can be few
    different ones, and are exploded to (variable, code) pairs of x and of y; a
    variable brings its margin only if answered, which is a cell's base rule. nets:
    of some x, counted beside its codes as ``net:<name>``.
    """
    nets = nets or {}
    xa, ya = [axis(survey, x) for x in xs], [axis(survey, y) for y in ys]
    keys: dict[str, Column] = {}
    named: dict[str, list[str]] = {}  # axis -> its key columns; an axis on both sides has them once
    for i, a in enumerate({a.name: a for a in [*xa, *ya]}.values()):
        named[a.name] = [f"__k{i}_{j}" for j in range(len(a.keys))]
        keys |= dict(zip(named[a.name], a.keys, strict=True))
    for i, a in enumerate(xa):
        keys |= {f"__net{i}_{k}": survey.logic(n.logic, a.name) for k, n in enumerate(nets.get(a.name, ())) if n.logic is not None}
    n = range(len(weights))
    picked = survey.filtered(where).select(*[c.alias(k) for k, c in keys.items()], *[weight_of(survey, w).alias(f"w{i}") for i, w in enumerate(weights)])
    sums = {f"{k}{i}": f(F.col(f"w{i}")) for i in n for k, f in (("n", lambda c: F.when(c.isNotNull(), F.lit(1))), ("s", lambda c: c), ("q", lambda c: c * c))}
    if math.prod(a.combinations for a in {a.name: a for a in [*xa, *ya]}.values()) <= MOST_ANSWERS:
        met = picked.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    else:
        met = picked.select(*keys, *[c.alias(k) for k, c in sums.items()])
    array = lambda a: a.build([F.col(k) for k in named[a.name]])
    x_pairs = []
    for i, a in enumerate(xa):
        hits = [F.when(F.col(f"__net{i}_{k}") if net.logic is not None else F.arrays_overlap(array(a), F.array(*map(F.lit, net.codes)).cast("array<int>")), F.lit(_NET - k)) for k, net in enumerate(nets.get(a.name, ()))]
        x_pairs.append(_pairs(array(a), i, hits))
    met = met.select(F.concat(*x_pairs).alias("x"), _all_pairs([array(a) for a in ya]).alias("y"), *sums)
    met = exploded(exploded(met, "x", "x", "y", *sums, empty=True), "y", "y", F.col("x.v").alias("xv"), F.col("x.c").alias("xc"), *sums)
    cube = met.groupBy("xv", "xc", F.col("y.v").alias("yv"), F.col("y.c").alias("yc")).agg(*[F.sum(k).alias(k) for k in sums])
    rows = F.array(*[F.struct(F.lit(w or "").alias("weight"), F.col(f"n{i}").cast("long").alias("n"), F.col(f"s{i}").alias("w"), F.col(f"q{i}").alias("w2")) for i, w in enumerate(weights)])
    flat = cube.select("xv", "xc", "yv", "yc", F.explode(rows).alias("r")).select("xv", "xc", "yv", "yc", "r.*")
    frame_rows = []
    for i, a in enumerate(xa):
        own_x = [(i, _MARGIN, a.name, ALL, 0), *((i, c, a.name, str(c), p + 1) for p, c in enumerate(a.codes))]
        own_x += [(i, _NET - k, a.name, f"net:{net.name}", len(a.codes) + k + 1) for k, net in enumerate(nets.get(a.name, ()))]
        frame_rows += [(*p, *q, w or "") for p in own_x for q in _y_frame(ya) for w in weights]
    all_cells = local_frame(survey.spark, frame_rows, "xv int, xc int, x_var string, x_code string, x_pos int, yv int, yc int, y_var string, y_code string, y_pos int, weight string")
    return filled(all_cells, flat, ("xv", "xc", "yv", "yc", "weight"), len(frame_rows) <= MOST_CELLS).drop("xv", "xc", "yv", "yc")


def _y_frame(ya: list[Axis]) -> list[tuple]:
    made = [(-1, _MARGIN, TOTAL, TOTAL, 0)]
    for j, b in enumerate(ya):
        made += [(j, _MARGIN, b.name, TOTAL, 0), *((j, c, b.name, str(c), p + 1) for p, c in enumerate(b.codes))]
    return made


_MOMENTS = "array<struct<base:double,b2:double,ws:double,wq:double,min:double,max:double>>"
MOMENT_STATS = ("mean", "var", "stddev", "sem", "varcoeff", "min", "max")


def fused_stats(survey, specs: list[dict], ys: list[str], weights: list[str | None] = (None,), where=None) -> DataFrame:
    """Statistics of many x by all y for several weights from one scan.

    Rows collapse by their raw answers, as in :func:`fused`, before scores are made of
    them and before they are exploded. A spec has x and, as wanted, factors, exclude,
    drop, source (the variable whose scores count, on the rows where x has an answer).
    Result: spec (its number), x_var, y_var, y_code, y_pos, weight, base, b2 (squared
    weights) and MOMENT_STATS.
    """
    ya = [axis(survey, y) for y in ys]
    n = range(len(weights))
    keys: dict[str, Column] = {}
    named: dict[tuple[str, frozenset[int]], list[str]] = {}  # axis -> its key columns; equal axes have them once
    answers = 1.0

    def array(a: Axis) -> Column:
        nonlocal answers
        if (at := (a.name, a.gone)) not in named:
            named[at] = [f"__k{len(named)}_{j}" for j in range(len(a.keys))]
            keys.update(zip(named[at], a.keys, strict=True))
            answers *= a.combinations
        return a.build([F.col(k) for k in named[at]])

    y_pairs = _all_pairs([array(a) for a in ya])
    values: dict[str, Column] = {}
    # of rows of equal answers (or of one row): sums, least and greatest
    sums = {f"{k}{i}": f(F.col(f"w{i}")) for i in n for k, f in (("s", lambda c: c), ("q", lambda c: c * c))}
    ends: dict[str, Column] = {}
    scores = []
    for j, spec in enumerate(specs):
        x, source = spec["x"], spec.get("source") or spec["x"]
        answered = F.lit(True)
        if x != source and survey.meta[x].type in NUMERIC:
            keys[f"__a{j}"], answered = _answered(survey, x), F.col(f"__a{j}")
            answers *= 2
        elif x != source:
            answered = F.size(array(axis(survey, x))) > 0
        if survey.meta[source].type in NUMERIC:  # of too many values to be kept apart: the moments are summed
            held, value, _, _ = score_of(survey, source, None, spec.get("exclude", ()))
            values[f"v{j}"] = F.when(held, value)
            v = F.col(f"v{j}")
            for i in n:
                w = F.when(v.isNotNull(), F.col(f"w{i}"))
                sums |= {f"base{j}_{i}": w, f"b2{j}_{i}": w * w, f"ws{j}_{i}": w * v, f"wq{j}_{i}": w * (v * v)}
                ends[f"{j}_{i}"] = F.when(w.isNotNull(), v)
            moments = F.array(*[F.struct(*[F.col(f"{k}{j}_{i}").alias(k) for k in ("base", "b2", "ws", "wq", "min", "max")]) for i in n])
            scores.append(F.when(answered, F.struct(F.lit(j).alias("spec"), *[F.lit(None).cast(t).alias(k) for k, t in (("s", "double"), ("q", "double"), ("m", "int"))], moments.alias("p"))))
        else:
            xa = axis(survey, source, spec.get("exclude", ()), stats=True)
            score, squares, mentions = _code_scores(xa, array(xa), spec.get("factors"), spec.get("drop", False))
            scores.append(F.when(answered & (mentions > 0), F.struct(F.lit(j).alias("spec"), score.alias("s"), squares.alias("q"), mentions.alias("m"), F.lit(None).cast(_MOMENTS).alias("p"))))
    picked = survey.filtered(where).select(*[c.alias(k) for k, c in {**keys, **values}.items()], *[weight_of(survey, w).alias(f"w{i}") for i, w in enumerate(weights)])
    if answers <= MOST_ANSWERS:
        met = picked.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()], *[f(c).alias(f"{k}{at}") for at, c in ends.items() for k, f in (("min", F.min), ("max", F.max))])
    else:
        met = picked.select(*keys, *[c.alias(k) for k, c in sums.items()], *[c.alias(f"{k}{at}") for at, c in ends.items() for k in ("min", "max")])
    names = [f"{k}{i}" for i in n for k in "sq"]
    met = met.select(F.array_compact(F.array(*scores)).alias("x"), y_pairs.alias("y"), *names)
    met = exploded(exploded(met, "x", "x", "y", *names, empty=True), "y", "y", "x", *names)
    asked = []
    for i in n:
        w, score, own = F.col(f"s{i}"), F.col("x.s"), F.col("x.p")[i]
        end = F.when(w.isNotNull(), score)
        # a number is one mention
        parts = {"base": (w, own["base"]), "b2": (F.col(f"q{i}"), own["b2"]), "ws": (w * score, own["ws"]), "wq": (w * F.col("x.q"), own["wq"]), "wm": (w * F.col("x.m"), own["base"]), "min": (end, own["min"]), "max": (end, own["max"])}
        asked += [{"min": F.min, "max": F.max}.get(k, F.sum)(F.when(F.col("x.p").isNull(), of_codes).otherwise(of_number)).alias(f"{k}_{i}") for k, (of_codes, of_number) in parts.items()]
    cube = met.groupBy(F.col("x.spec").alias("spec"), F.col("y.v").alias("yv"), F.col("y.c").alias("yc")).agg(*asked)
    names = ("base", "b2", "ws", "wq", "wm", "min", "max")
    rows = F.array(*[F.struct(F.lit(w or "").alias("weight"), *[F.col(f"{k}_{i}").alias(k) for k in names]) for i, w in enumerate(weights)])
    flat = cube.select("spec", "yv", "yc", F.explode(rows).alias("r")).select("spec", "yv", "yc", "r.*").withColumns(_from_moments())
    frame_rows = [(i, spec["x"], *q, w or "") for i, spec in enumerate(specs) for q in _y_frame(ya) for w in weights]
    all_cells = local_frame(survey.spark, frame_rows, "spec int, x_var string, yv int, yc int, y_var string, y_code string, y_pos int, weight string")
    met = all_cells.join(F.broadcast(flat) if len(frame_rows) <= MOST_CELLS else flat, ["spec", "yv", "yc", "weight"], "left")
    return met.select("spec", "x_var", "y_var", "y_code", "y_pos", "weight", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("b2", F.lit(0.0)).alias("b2"), *MOMENT_STATS)


def labelled(survey, result: DataFrame, text_key: str | None = None) -> DataFrame:
    """Adds x_text and y_text."""
    rows = []
    for name in [*survey.meta.columns, *survey.meta.grids]:
        own = survey.meta[name]
        rows += [(name, str(v.code), t) for v, t in zip(own.values or (), survey.meta.value_texts(name, text_key).values() if own.values else (), strict=False)]
        rows += [(name, i, t) for i, t in survey.meta.item_texts(name, text_key).items()]
    texts = local_frame(survey.spark, rows or [("", "", "")], "var string, code string, text string")
    for a in "xy":
        own = texts.select(F.col("var").alias(f"{a}_var"), F.col("code").alias(f"{a}_code"), F.col("text").alias(f"{a}_text"))
        result = result.join(F.broadcast(own), [f"{a}_var", f"{a}_code"], "left").withColumn(f"{a}_text", F.coalesce(f"{a}_text", F.regexp_replace(f"{a}_code", "^(net|calc):", "")))
    return result


def pivoted(result: DataFrame, value: str = "value") -> DataFrame:
    """A row for each x code and a column for each y code: the edge of the engine."""
    columns = [r.y_code for r in result.select("y_code", "y_pos").distinct().orderBy("y_pos").collect()]
    return result.groupBy("x_var", "x_code", "x_pos").pivot("y_code", columns).agg(F.first(value)).orderBy("x_pos").drop("x_pos")


def view_key(method: str, condition: str = ":", rel_to: str = "", weight: str | None = None, name: str = "") -> str:
    """``x|method|condition|rel_to|weight|name``."""
    return f"x|{method}|{condition}|{rel_to}|{weight or ''}|{name}"


def net_condition(nets: list[Net], complete: bool = False) -> str:
    parts = []
    for n in nets:
        if n.logic is not None:
            parts.append(logic_key(n.logic)[:-2])
            continue
        codes = "{" + ",".join(map(str, n.codes)) + "}"
        parts.append(f"x[{codes}+]" if n.expand == "after" else f"x[+{codes}]" if n.expand == "before" else f"x[{codes}]")
    return ",".join(parts) + ("*:" if complete else ":")


