"""Column tests between the columns of a table.

All pairs of columns are compared on sums that one aggregation gives: bases,
squared weights, cells and, for columns that share respondents, the overlap. Mode
"dim" uses pooled errors, effective bases, overlap and p-values; mode "askia"
unpooled errors, critical values and a floor for expected counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import t_p_value
from .tabulate import ALL, TOTAL, Net, axis, cells, collapsed, exploded, fused_stats

P_LEVELS = {"low": 0.10, "mid": 0.05, "high": 0.01}
T_LEVELS = {"low": 1.65, "mid": 1.96, "high": 2.576}


def level_of(level: str | float, mimic: str) -> float:
    """A named level, or a probability (dim) or critical value (askia) as it is."""
    return level if not isinstance(level, str) else (P_LEVELS if mimic == "dim" else T_LEVELS)[level]


def overlaps(survey, x: str, y: str, weight: str | None = None, where=None) -> DataFrame:
    """Respondents that two columns share, as an effective number if weighted: y1, y2, ov."""
    xa, ya = axis(survey, x), axis(survey, y)
    met = collapsed(survey, xa, ya, weight, where)
    m = F.size("__x") if weight not in (None, "@1") else F.lit(1)
    pairs = F.flatten(F.transform("__y", lambda a: F.transform(F.filter("__y", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    flat = exploded(met, "p", pairs, "w", "w2", "n", m.alias("m"), empty=True)
    if weight in (None, "@1"):
        ov = F.sum("n").cast("double")
    else:  # the squared sum of the shared rows' sums over the sum of their squares
        ov = F.pow(F.sum(F.col("w") * F.col("m")), F.lit(2)) / F.sum(F.col("w2") * F.col("m") * F.col("m"))
    return flat.groupBy(F.col("p.a").cast("string").alias("y1"), F.col("p.b").cast("string").alias("y2")).agg(ov.alias("ov"))


LINK = ("x_var", "y_var", "weight")


def _pairs(columns: DataFrame, keys: list[str], test_total: bool) -> DataFrame:
    """Columns of a link against each other (1 is before 2); with the total, that comes first."""
    names = [c for c in columns.columns if c not in keys]
    one, two = (columns.select(*keys, *[F.col(c).alias(f"{c}{i}") for c in names]) for i in (1, 2))
    # a link's columns are as few as its heads' codes
    met = one.join(two, keys).filter("y_pos1 < y_pos2")
    return met if test_total else met.filter(F.col("y_code1") != TOTAL)


def _found(tested: DataFrame, hit, keep: list[str]) -> DataFrame:
    """For each cell the columns it is higher than, @H and @L for the total, sorted and joined."""
    both = tested.filter(hit)
    higher = F.when(F.col("d") > 0, F.col("y_code1")).otherwise(F.col("y_code2"))
    lower = F.when(F.col("d") > 0, F.col("y_code2")).otherwise(F.col("y_code1"))
    is_total = F.col("y_code1") == TOTAL
    told = both.select(*keep, F.when(is_total, F.col("y_code2")).otherwise(higher).alias("y_code"), F.when(is_total, F.when(F.col("d") > 0, "@L").otherwise("@H")).otherwise(lower).alias("lower"))
    made = told.groupBy(*keep, "y_code").agg(F.array_sort(F.collect_set(F.struct(F.coalesce(F.expr("try_cast(lower as int)"), F.lit(-1)).alias("n"), "lower"))).alias("l"))
    return made.select(*keep, "y_code", F.array_join(F.col("l.lower"), ",").alias("value"))


def _keyed(table: DataFrame, x: str, y: str, weight: str | None) -> DataFrame:
    return table.withColumns({"x_var": F.lit(x), "y_var": F.lit(y), "weight": F.lit("" if weight in (None, "@1") else weight)})


def _shared(survey, x: str, y: str, weight: str | None, where, overlap: bool) -> DataFrame | None:
    """The overlaps of a link whose head is a set; None where columns can't share respondents."""
    if not overlap or not axis(survey, y).is_set:
        return None
    return _keyed(overlaps(survey, x, y, weight, where), x, y, weight)


def _with_overlap(met: DataFrame, shared: DataFrame | None) -> DataFrame:
    if shared is None:
        return met.withColumn("ov", F.lit(0.0))
    own = shared.withColumnsRenamed({"y1": "y_code1", "y2": "y_code2"})
    return met.join(own, [*LINK, "y_code1", "y_code2"], "left").withColumn("ov", F.coalesce("ov", F.lit(0.0)))


def _effective(base: str, squares: str, use_ebase: bool) -> F.Column:
    kish = F.col(base) * F.col(base) / F.nullif(F.col(squares), F.lit(0.0))
    return F.when(F.col("weight") != "", kish).otherwise(F.col(base)) if use_ebase else F.col(base)


def proportions_of(table: DataFrame, level: str | float = "mid", mimic: str = "dim", test_total: bool = False, use_ebase: bool = True, shared: DataFrame | None = None, flag_bases: tuple[int, int] | None = None, p_values: bool = False) -> DataFrame:
    """Tests of all links of a long result at once: LINK, x_code, y_code, value (the columns it is significantly higher than).

    ``shared``: overlaps (LINK, y1, y2, ov) of links whose columns share respondents.
    """
    keys = list(LINK)
    base = table.filter(F.col("x_code") == ALL).select(*keys, "y_code", F.col("w").alias("b"), F.col("w2").alias("b2")).withColumn("eb", _effective("b", "b2", use_ebase))
    columns = table.filter(F.col("x_code") != ALL).join(base, [*keys, "y_code"])
    columns = columns.select(*keys, "x_code", "y_code", "y_pos", F.col("w").alias("k"), "b", "eb", (F.col("w") / F.nullif(F.col("b"), F.lit(0.0))).alias("p"))
    met = _pairs(columns, [*keys, "x_code"], test_total)
    d = F.col("p1") - F.col("p2")
    if mimic == "askia":
        of_total = lambda c: F.max(F.when(F.col("y_code") == TOTAL, F.col(c)))
        row = columns.groupBy(*keys, "x_code").agg(of_total("k").alias("row"), of_total("b").alias("all"))
        se = F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.nullif(F.col("b1"), F.lit(0.0)) + F.col("p2") * (1 - F.col("p2")) / F.nullif(F.col("b2"), F.lit(0.0)))
        # cells of which fewer than five are to be expected don't take part
        enough = (F.col("row") * F.col("b1") / F.nullif(F.col("all"), F.lit(0.0)) >= 5) & (F.col("row") * F.col("b2") / F.nullif(F.col("all"), F.lit(0.0)) >= 5)
        met = met.join(row, [*keys, "x_code"])
        tested = met.withColumns({"d": d, "se": se}).withColumn("t", F.when((F.col("se") > 0) & enough, F.col("d") / F.nullif(F.col("se"), F.lit(0.0))))
        hit = (F.abs("t") > level_of(level, mimic)) & (F.col("d") != 0)
    else:
        pooled = (F.col("k1") + F.col("k2")) / F.nullif(F.col("b1") + F.col("b2"), F.lit(0.0))
        met = _with_overlap(met, shared).filter("b1 > 0 AND b2 > 0")
        bracket = 1 / F.col("eb1") + 1 / F.col("eb2") - 2 * F.col("ov") / (F.col("eb1") * F.col("eb2"))
        tested = met.withColumns({"d": d, "se": F.sqrt(pooled * (1 - pooled) * bracket), "dof": F.col("eb1") + F.col("eb2") - F.col("ov") - 2})
        tested = tested.withColumn("t", F.when(F.col("se") > 0, F.col("d") / F.nullif(F.col("se"), F.lit(0.0))))
        tested = tested.withColumn("p", t_p_value("t", "dof"))
        hit = (F.col("p") < level_of(level, mimic)) & (F.col("d") != 0)
    if p_values:
        return tested.select(*keys, "x_code", "y_code1", "y_code2", F.col("d").alias("diff"), "se", "t", *(["dof", "p"] if mimic == "dim" else []))
    return _flagged(_found(tested, hit, [*keys, "x_code"]), base, flag_bases)


def proportions(survey, x: str, y: str, weight: str | None = None, where=None, level: str | float = "mid", mimic: str = "dim", test_total: bool = False, use_ebase: bool = True, overlap: bool = True, flag_bases: tuple[int, int] | None = None, nets: list[Net] | None = None, p_values: bool = False) -> DataFrame:
    """Tests of one link's column percents: x_code, y_code, value.

    With ``p_values`` the pairs themselves: diff, se, t, dof, p.
    """
    table = _keyed(cells(survey, x, y, weight, where, base_all=test_total, nets=nets), x, y, weight)
    shared = _shared(survey, x, y, weight, where, overlap and mimic == "dim")
    return proportions_of(table, level, mimic, test_total, use_ebase, shared, flag_bases, p_values).drop(*LINK)


def _flagged(made: DataFrame, base: DataFrame, flags: tuple[int, int] | None) -> DataFrame:
    """Columns under the smaller base lose their results to **, those under the larger get a *."""
    if flags is None:
        return made
    least, small = flags
    met = made.join(base.select(*LINK, "y_code", "eb"), [*LINK, "y_code"])
    said = F.when(F.col("eb") < least, "**").when(F.col("eb") < small, F.concat("value", F.lit("*"))).otherwise(F.col("value"))
    return met.select(*[c for c in made.columns if c != "value"], said.alias("value"))


def means_of(stats: DataFrame, level: str | float = "mid", mimic: str = "dim", test_total: bool = False, use_ebase: bool = True, shared: DataFrame | None = None, flag_bases: tuple[int, int] | None = None, p_values: bool = False, sd_quirk: bool = True) -> DataFrame:
    """Tests of the means of all links of a result of fused_stats: LINK, stat, y_code, value."""
    keys = list(LINK)
    columns = stats.select(*keys, "y_code", "y_pos", "base", "b2", "mean", "stddev").withColumn("eb", _effective("base", "b2", use_ebase))
    pairs = _pairs(columns, keys, test_total).filter("base1 > 0 AND base2 > 0")
    d = F.col("mean1") - F.col("mean2")
    if mimic == "askia":
        part = (lambda i: F.col(f"stddev{i}")) if sd_quirk else (lambda i: F.col(f"stddev{i}") * F.col(f"stddev{i}"))
        tested = pairs.withColumns({"d": d, "se": F.sqrt(part(1) / F.col("base1") + part(2) / F.col("base2"))})
        tested = tested.withColumn("t", F.when(F.col("se") > 0, F.col("d") / F.nullif(F.col("se"), F.lit(0.0))))
        hit = (F.abs("t") > level_of(level, mimic)) & (F.col("d") != 0)
    else:
        pairs = _with_overlap(pairs, shared)
        ssw = lambda i: F.col(f"b2{i}") / F.col(f"base{i}")
        ss = lambda i: F.pow(F.col(f"stddev{i}"), F.lit(2)) * (F.col(f"base{i}") - 1)
        pooled = (F.coalesce(ss(1), F.lit(0.0)) + F.coalesce(ss(2), F.lit(0.0))) / F.nullif((F.col("base1") - ssw(1)) + (F.col("base2") - ssw(2)), F.lit(0.0))
        bracket = 1 / F.col("eb1") + 1 / F.col("eb2") - 2 * F.col("ov") / (F.col("eb1") * F.col("eb2"))
        tested = pairs.withColumns({"d": d, "se": F.sqrt(pooled * bracket), "dof": F.col("eb1") + F.col("eb2") - F.col("ov") - 2})
        tested = tested.withColumn("t", F.when(F.col("se") > 0, F.col("d") / F.nullif(F.col("se"), F.lit(0.0))))
        tested = tested.withColumn("p", t_p_value("t", "dof"))
        hit = (F.col("p") < level_of(level, mimic)) & (F.col("d") != 0)
    if p_values:
        return tested.select(*keys, "y_code1", "y_code2", F.col("d").alias("diff"), "se", "t", *(["dof", "p"] if mimic == "dim" else []))
    made = _found(tested.withColumn("stat", F.lit("mean")), hit, [*keys, "stat"])
    return _flagged(made, columns, flag_bases)


def means(survey, x: str, y: str, weight: str | None = None, where=None, level: str | float = "mid", mimic: str = "dim", test_total: bool = False, use_ebase: bool = True, overlap: bool = True, flag_bases: tuple[int, int] | None = None, factors: dict[int, float] | None = None, exclude=(), p_values: bool = False, sd_quirk: bool = True) -> DataFrame:
    """Tests of one link's means. ``sd_quirk``: askia's unpooled error from standard deviations instead of variances."""
    stats = fused_stats(survey, [{"x": x, "factors": factors, "exclude": exclude}], [y], [weight], where).filter(F.col("y_var") == y)
    shared = _shared(survey, x, y, weight, where, overlap and mimic == "dim" and bool(survey.meta[x].values))
    return means_of(_keyed(stats, x, y, weight), level, mimic, test_total, use_ebase, shared, flag_bases, p_values, sd_quirk).drop(*LINK)


def letter(i: int, upper: bool = True) -> str:
    """0, 1, ... as A, B, ... Z, AA, ..."""
    made = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        made = chr(65 + r) + made
    return made if upper else made.lower()


def letters(result: DataFrame, columns: list[str], upper: bool = True) -> DataFrame:
    """Codes in results as column letters A, B, ... Z, AA, ..."""
    pairs = F.create_map(*[F.lit(v) for i, c in enumerate(columns) for v in (c, letter(i, upper))])
    return result.withColumn("value", F.array_join(F.transform(F.split("value", ","), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "."))
