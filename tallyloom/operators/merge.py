"""Merging of case data: left merge with updates, append, and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tabulate import quoted


def hmerge(left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, sets: tuple[str, ...] = (), merge_existing: bool | list[str] = False, columns: list[str] | None = None) -> DataFrame:
    """Left rows with the right's columns.

    Columns of both sides take the right's value where there is one; set columns stay as they are unless they
    are to be merged, and are united then. Right keys that repeat multiply rows.
    """
    lk, rk = left_on or on, right_on or on
    wanted = [c for c in (columns or right.columns) if c != rk and not (c == lk and lk != rk)]
    right = right.select(quoted(rk).alias("__rk"), F.lit(True).alias("__hit"), *[quoted(c).alias(f"__r_{c}") for c in wanted])
    met = left.join(right, quoted(lk).eqNullSafe(F.col("__rk")) & quoted(lk).isNotNull(), "left")

    def value(c: str) -> Column:
        new = quoted(f"__r_{c}")
        if c not in left.columns:
            return new
        if c in sets:
            if merge_existing is True or isinstance(merge_existing, list) and c in merge_existing:
                return F.when(new.isNull(), quoted(c)).when(quoted(c).isNull(), new).otherwise(F.array_sort(F.array_union(quoted(c), new)))
            return quoted(c)
        return F.coalesce(new.cast(left.schema[c].dataType), quoted(c))

    shared = {c: value(c).alias(c) for c in wanted if c in left.columns}
    return met.select(*[shared.get(c, quoted(c)) for c in left.columns], *[value(c).alias(c) for c in wanted if c not in left.columns])


def update(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The left's columns alone, with the right's values where there are any."""
    return hmerge(left, right, on).select(*[quoted(c) for c in dict.fromkeys([*left.columns, *right.columns])])


def vmerge(left: DataFrame, right: DataFrame, on: str | None = None, left_on: str | None = None, right_on: str | None = None, row_id_name: str | None = None, left_id=None, right_id=None, sets: tuple[str, ...] = ()) -> DataFrame:
    """The right's rows appended; with a key only those whose key the left lacks.

    A column that is a set on one side becomes one on the other. Columns are the
    left's, then the right's new ones.
    """
    lk, rk = left_on or on, right_on or on
    if lk:
        right = right.join(left.select(quoted(lk).alias("__k")), quoted(rk) == F.col("__k"), "left_anti")
        if lk != rk:
            right = right.withColumnRenamed(rk, lk)
    if row_id_name:
        left, right = (d.withColumn(row_id_name, F.lit(i)) if i is not None else d for d, i in ((left, left_id), (right, right_id)))
    for c in set(left.columns) & set(right.columns):
        a, b = (d.schema[c].dataType.simpleString() for d in (left, right))
        if a != b and "array<int>" in (a, b):
            lift = lambda d, c=c: d.withColumn(c, F.when(quoted(c).isNotNull(), F.array(quoted(c).cast("int"))))
            left, right = (lift(left), right) if b.startswith("array") else (left, lift(right))
        elif a != b:
            left, right = (d.withColumn(c, quoted(c).cast("double" if {a, b} <= {"int", "bigint", "double", "float"} else "string")) for d in (left, right))
    return left.unionByName(right, allowMissingColumns=True)


def vmerge_all(frames: list[DataFrame], **how) -> DataFrame:
    return reduce(lambda a, b: vmerge(a, b, **how), frames)


def duplicates(df: DataFrame, name: str = "identity") -> DataFrame:
    """Values that occur at least twice, with their number."""
    return df.groupBy(quoted(name)).count().filter("count >= 2")


def drop_duplicates(df: DataFrame, key: str = "identity", keep: str = "first", sort_by: str | list[str] | None = None) -> DataFrame:
    """One row for each key: the first or the last in the order given (of all columns, if none is).

    Combined before the shuffle, so a key sends a row for each task. Of ties the row
    of least (first) or greatest (last) other columns stays.
    """
    names = [sort_by] if isinstance(sort_by, str) else sort_by or []
    # structs order nulls first, as ascending sorts do
    order = F.struct(*[quoted(c) for c in dict.fromkeys([*names, *(c for c in df.columns if c != key)])])
    whole = F.struct(*[quoted(c) for c in df.columns])
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(quoted(key).alias("__key")).agg(pick(whole, order).alias("__row")).select("__row.*")


def unique_key(df: DataFrame, key: str, multiplier: int) -> DataFrame:
    """The key moved into a range of its own; the old one is kept beside it."""
    return df.withColumn(f"original_{key}", quoted(key)).withColumn(key, quoted(key) + F.lit(multiplier * 10**8))
