"""Display rules on the long result: slice, then sort, then drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tabulate import ALL, TOTAL


def sliced(result: DataFrame, codes: list, axis: str = "x", keep_margins: bool = True) -> DataFrame:
    """Keeps and orders codes."""
    place = F.array_position(F.array(*[F.lit(str(c)) for c in codes]), F.col(f"{axis}_code")).cast("int")
    is_margin = F.col(f"{axis}_code") == (ALL if axis == "x" else TOTAL)
    made = result.withColumn(f"{axis}_pos", F.when(is_margin, 0).otherwise(place))
    return made.filter((F.col(f"{axis}_pos") > 0) | (is_margin if keep_margins else F.lit(False)))


def dropped(result: DataFrame, codes: list, axis: str = "x") -> DataFrame:
    return result.filter(~F.col(f"{axis}_code").isin([str(c) for c in codes]))


def sorted_by(result: DataFrame, sort_on: str = "@", fixed: list | None = None, ascending: bool = False, value: str = "w", nets: dict[str, list[str]] | None = None, within: bool = True, between: bool = True) -> DataFrame:
    """New x_pos by a column's values: the margin first, fixed codes last in their order.

    nets: net -> its codes; between sorts the blocks by their net's value, within the
    codes of a block. Ties keep the order they had.
    """
    key = F.max(F.when(F.col("y_code") == str(sort_on), F.col(value))).over(Window.partitionBy("x_code"))
    keyed = result.withColumn("__key", key)
    last = F.coalesce(F.array_position(F.array(*[F.lit(str(c)) for c in fixed or ["\0"]]), F.col("x_code")), F.lit(0))
    first = F.when(F.col("x_code") == ALL, 0).when(last > 0, 2).otherwise(1)
    sign = F.lit(1.0 if ascending else -1.0)
    if nets:
        owner = {str(c): n for n, codes in nets.items() for c in codes} | {n: n for n in nets}
        pairs = F.create_map(*[F.lit(v) for c, n in owner.items() for v in (c, n)])
        keyed = keyed.withColumn("__net", F.coalesce(F.try_element_at(pairs, F.col("x_code")), F.col("x_code")))
        block = Window.partitionBy("__net")
        keyed = keyed.withColumns({"__block": F.max(F.when(F.col("x_code") == F.col("__net"), F.col("__key"))).over(block), "__at": F.min("x_pos").over(block)})
        head = (F.col("x_code") == F.col("__net")).cast("int")
        net_first = F.max(F.when((F.col("x_code") == F.col("__net")) & (F.col("x_pos") == F.col("__at")), 1).otherwise(0)).over(block)
        order = [first, last, (F.col("__block") * sign if between else F.col("__at")), F.col("__at"), F.when(net_first == 1, -head).otherwise(head), (F.col("__key") * sign if within else F.col("x_pos")), F.col("x_pos")]
    else:
        order = [first, last, F.col("__key") * sign, F.col("x_pos")]
    rows = keyed.select("x_code", *[o.alias(f"__o{i}") for i, o in enumerate(order)]).distinct()
    ranked = rows.select(F.col("x_code").alias("__x"), (F.row_number().over(Window.orderBy(*[f"__o{i}" for i in range(len(order))])) - 1).alias("__pos"))
    # as many rows as codes
    return result.join(ranked, F.col("x_code") == F.col("__x")).withColumn("x_pos", F.col("__pos").cast("int")).drop("__x", "__pos")


def applied(survey, result: DataFrame, x: str, y: str | None = None, axes: tuple[str, ...] = ("x", "y"), value: str = "w") -> DataFrame:
    """The rules that the metadata hold for x and y."""
    for name, axis in ((x, "x"), (y, "y")):
        if not name or name == TOTAL or name not in survey.meta or axis not in axes:
            continue
        own = survey.meta[name].rules.get(axis, {})
        if "slicex" in own:
            result = sliced(result, own["slicex"]["values"], axis)
        if "sortx" in own and axis == "x":
            s = own["sortx"]
            result = sorted_by(result, s["sort_on"], s["fixed"], s["ascending"], value)
        if "dropx" in own:
            result = dropped(result, own["dropx"]["values"], axis)
    return result


def viable_axes(view: str) -> list[str]:
    """The axes that rules may touch, from a view key: conditions that name codes fix theirs."""
    _, method, condition, *_ = view.split("|")
    left, _, right = condition.partition(":")
    axes = ["x", "y"]
    if left.strip("x") or method.startswith("d."):
        axes.remove("x")
    if right.strip("y"):
        axes.remove("y")
    return axes


def visible_tests(result: DataFrame, hidden: list) -> DataFrame:
    """Test results without the columns that are hidden."""
    gone = F.array(*[F.lit(str(c)) for c in hidden])
    kept = F.array_except(F.split("value", ","), gone)
    return dropped(result, hidden, "y").withColumn("value", F.array_join(kept, ",")).filter("value != ''")


def shown(survey, x: str, y: str | None = None, axis: str | None = None) -> dict[str, dict]:
    """The rules that the metadata hold for x and y."""
    if axis not in (None, "x", "y"):
        raise ValueError("the axis is x or y")
    return {a: dict(survey.meta[n].rules.get(a, {})) if n and n != TOTAL else {} for a, n in (("x", x), ("y", y)) if axis in (None, a)}


def slicers(survey, result: DataFrame, x: str, y: str | None = None, value: str = "w") -> dict[str, list[str]]:
    """The codes of either axis in the order that the rules give; as many as codes."""
    made = applied(survey, result, x, y, value=value)
    return {a: [r[0] for r in made.select(f"{a}_code", f"{a}_pos").distinct().orderBy(f"{a}_pos").collect()] for a in ("x", "y")}
