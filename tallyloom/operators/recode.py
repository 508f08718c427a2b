"""Recoding and derivation as Column expressions; nothing here starts a job unless it must see the data."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.logic import frange
from ..meta import BOOLEAN, DATE, FLOAT, INT, SET, SINGLE, SPARK_TYPES, STRING, MetaError, Value
from ..plans.tabulate import quoted

_EMPTY = "cast(array() as array<int>)"


def _or_null(array: Column) -> Column:
    """An array, or null where it's empty."""
    return F.when(F.size(array) > 0, array)


def compact(parts: Iterable[Column]) -> Column:
    return _or_null(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))))


def recoded(survey, target: str, mapper: dict, default: str | None = None, append: bool = False, intersect=None, initialize=None, fillna=None) -> Column:
    """The values of ``target`` after a recode {code: logic}.

    Singles and numbers: of several codes that hold, the last in code order wins.
    Sets: codes that hold replace the old ones, or join them with ``append``; rows
    without a hit keep what they have. ``default`` names the variable that bare lists
    and codes are about; ``intersect`` is a logic that all of them need as well.
    ``initialize``: a column to start from, or None-like ``"empty"`` to clear first.
    ``fillna``: the code for rows left empty.
    """
    kind = survey.meta[target].type
    now = quoted(target)
    if initialize is not None:
        now = F.lit(None).cast(SPARK_TYPES[kind]) if initialize == "empty" else quoted(initialize)
    also = survey.logic(intersect, default) if intersect is not None else None

    def hit(logic) -> Column:
        made = survey.logic(logic, default)
        return made if also is None else made & also

    if kind == SET:
        hits = compact([F.when(hit(logic), F.lit(int(code))) for code, logic in sorted(mapper.items())])
        made = _or_null(F.array_sort(F.array_distinct(F.concat(F.coalesce(now, F.expr(_EMPTY)), F.coalesce(hits, F.expr(_EMPTY)))))) if append else F.coalesce(hits, now)
    elif kind in (SINGLE, INT, FLOAT):
        made = now
        for code, logic in sorted(mapper.items()):
            made = F.when(hit(logic), F.lit(code).cast(SPARK_TYPES[kind])).otherwise(made)
    else:
        raise MetaError(f"{target!r} of type {kind} can't be recoded")
    if fillna is not None:
        fill = F.array(F.lit(int(fillna))) if kind == SET else F.lit(fillna)
        made = F.coalesce(made, fill.cast(SPARK_TYPES[kind]))
    return made.cast(SPARK_TYPES[kind])


def uncoded(survey, target: str, mapper: dict, default: str | None = None, intersect=None) -> Column:
    """``target`` without the codes whose logic holds."""
    kind, made = survey.meta[target].type, quoted(target)
    also = survey.logic(intersect, default) if intersect is not None else F.lit(True)
    for code, logic in sorted(mapper.items()):
        hit = survey.logic(logic, default) & also
        if kind == SET:
            made = F.when(hit, _or_null(F.array_remove(made, int(code)))).otherwise(made)
        else:
            made = F.when(hit & (made == code), None).otherwise(made)
    return made.cast(SPARK_TYPES[kind])


def banded(column: Column, bands: list) -> tuple[Column, list[tuple[int, str]]]:
    """Codes 1, 2, ... by band, and their labels. A band: a number, (low, high), or {label: band}; whole numbers only."""
    made, values = F.lit(None).cast("int"), []
    for code, band in enumerate(bands, 1):
        label = None
        if isinstance(band, dict):
            ((label, band),) = band.items()
        if isinstance(band, str):
            numbers = frange(band)
            low, high = min(numbers), max(numbers)
            hit = column.isin(numbers) if len(numbers) != high - low + 1 else column.between(low, high)
        elif isinstance(band, (tuple, list)):
            low, high = band
            hit = column.between(low, high)
        else:
            low = high = band
            hit = column == band
        whole = column == F.floor(column)
        made = F.when(hit & whole, F.lit(code)).otherwise(made)
        values.append((code, label or (str(low) if low == high else f"{low}-{high}")))
    return made.cast("int"), values


def interlocked(survey, variables: list[str], separator: str = "/") -> tuple[Column, str, list[tuple[int, str]]]:
    """The code product of variables: column, type and codes with joined labels."""
    parts = [(v, survey.meta.codes(v), survey.meta.value_texts(v)) for v in variables]
    values = [(i, separator.join(t[c] for (_, _, t), c in zip(parts, combo, strict=True))) for i, combo in enumerate(product(*(c for _, c, _ in parts)), 1)]
    if all(survey.meta[v].type == SINGLE for v in variables):
        made = F.lit(0)
        for v, codes, _ in parts:
            place = F.coalesce(*[F.when(quoted(v) == c, F.lit(i)) for i, c in enumerate(codes)])
            made = made * len(codes) + place
        return (made + 1).cast("int"), SINGLE, values
    made = F.array(F.lit(0))
    for v, codes, _ in parts:
        own = quoted(v) if survey.meta[v].type == SET else F.when(quoted(v).isNotNull(), F.array(quoted(v)))
        listed = F.array(*map(F.lit, codes)).cast("array<int>")
        places = F.transform(F.filter(own, lambda c: c.isin(codes)), lambda c: (F.array_position(listed, c) - 1).cast("int"))
        n = len(codes)
        made = F.flatten(F.transform(made, lambda a: F.transform(places, lambda b: a * n + b)))
    return _or_null(F.array_sort(F.transform(made, lambda c: c + 1))).cast("array<int>"), SET, values


def dichotomized(survey, name: str, ignore: Iterable[int] = ()) -> dict[int, Column]:
    """code -> 0/1; no answer is 0."""
    return {c: F.coalesce(_holds(survey, name, c).cast("int"), F.lit(0)) for c in survey.meta.codes(name) if c not in set(ignore)}


def _holds(survey, name: str, code: int) -> Column:
    return F.array_contains(quoted(name), code) if survey.meta[name].type == SET else quoted(name) == code


def dummies(survey, name: str) -> dict[str, Column]:
    """The 0/1 matrix of a variable; of a grid, item by item."""
    names = survey.meta.sources(name) or [name]
    return {f"{n}_{c}" if len(names) > 1 else str(c): col for n in names for c, col in dichotomized(survey, n).items()}


def set_from_dichotomous(columns: dict[int, str], yes: int = 1) -> Column:
    """code -> 0/1 column to a set."""
    return compact([F.when(quoted(v) == yes, F.lit(c)) for c, v in columns.items()])


def set_from_singles(columns: list[str]) -> Column:
    return compact([quoted(v).cast("int") for v in columns])


def sniffed_single(df: DataFrame, columns: dict[int, str], yes: int = 1) -> tuple[Column, str]:
    """A 0/1 block as a single if no row has two answers, else as a set; one aggregation decides."""
    total = reduce(lambda a, b: a + b, [F.coalesce((quoted(v) == yes).cast("int"), F.lit(0)) for v in columns.values()])
    if (df.agg(F.max(total)).first()[0] or 0) <= 1:
        return F.coalesce(*[F.when(quoted(v) == yes, F.lit(c)) for c, v in columns.items()]).cast("int"), SINGLE
    return set_from_dichotomous(columns, yes), SET


def ones_and_twos(column: Column, codes: Iterable[int], yes: int = 1, no: int = 2) -> dict[int, Column]:
    """A set as columns of yes and no."""
    return {c: F.when(F.coalesce(F.array_contains(column, c), F.lit(False)), yes).otherwise(no) for c in codes}


def parse_set(column: Column) -> Column:
    """``"1;3;"`` as an array, in the order given."""
    parts = F.filter(F.split(column, ";"), lambda x: F.trim(x) != "")
    return _or_null(F.transform(parts, lambda x: x.cast("double").cast("int")))


def format_set(column: Column) -> Column:
    return F.when(F.size(column) > 0, F.concat(F.array_join(F.transform(column, lambda x: x.cast("string")), ";"), F.lit(";")))


def set_tokens(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """Distinct tokens of a text column of sets, with their place in order."""
    made = df.select(F.explode(F.split(quoted(column), sep)).alias("token")).filter(F.trim("token") != "").distinct()
    order = F.coalesce(F.expr("try_cast(token as double)"), F.lit(float("inf")))
    return made.withColumn("place", F.row_number().over(Window.orderBy(order, "token")))


def split_columns(column: Column, sep: str, names: list[str]) -> dict[str, Column]:
    return {n: F.try_element_at(F.split(column, sep), F.lit(i + 1)) for i, n in enumerate(names)}


def first_answers(column: Column, n: int = 3) -> tuple[list[Column], Column]:
    """The first n answers in stored order, and the set of the others."""
    return [F.try_element_at(column, F.lit(i + 1)) for i in range(n)], F.when(F.size(column) > n, F.slice(column, n + 1, F.greatest(F.size(column) - n, F.lit(1))))


def flattened(survey, grid: str, codes: list[int]) -> Column:
    """The numbers of the items that give one of the codes."""
    items = survey.meta.sources(grid)
    return compact([F.when(survey.logic({i: list(codes)}), F.lit(n)) for n, i in enumerate(items, 1)])


def transposed(survey, grid: str, ignore_items: Iterable[int] = (), ignore_values: Iterable[int] = ()) -> dict[int, Column]:
    """code -> the set of item numbers with that code."""
    items = [(n, i) for n, i in enumerate(survey.meta.sources(grid), 1) if n not in set(ignore_items)]
    return {c: compact([F.when(survey.logic({i: [c]}), F.lit(n)) for n, i in items]) for c in survey.meta.codes(grid) if c not in set(ignore_values)}


def unified(survey, name: str, code_map: dict[int, int], where=None, exclusive: bool = False) -> Column:
    """Codes renamed or merged; with exclusive a set gives way to the new code alone."""
    column, kind = quoted(name), survey.meta[name].type
    pairs = F.create_map(*[F.lit(int(x)) for p in code_map.items() for x in p])
    if kind == SET:
        made = F.transform(column, lambda c: F.coalesce(F.try_element_at(pairs, c), c))
        if exclusive:
            new = F.filter(column, lambda c: c.isin(list(code_map)))
            made = F.when(F.size(new) > 0, F.transform(new, lambda c: F.try_element_at(pairs, c))).otherwise(column)
        made = F.array_sort(F.array_distinct(made))
    else:
        made = F.coalesce(F.try_element_at(pairs, column), column)
    return F.when(survey.logic(where), made).otherwise(column) if where is not None else made


def converted(survey, name: str, to: str) -> tuple[Column, list[Value] | None]:
    """A column in another type, and its codes where they must be read from the data (None: as they are)."""
    own, column = survey.meta[name], quoted(name)
    kind = own.type
    if kind == to:
        return column, own.values
    if to == STRING:
        if kind == SET:
            return format_set(column), None
        if own.values:
            texts = F.create_map(*[F.lit(x) for c, t in survey.meta.value_texts(name).items() for x in (c, t)])
            return F.try_element_at(texts, column), None
        return (F.date_format(column, "yyyy-MM-dd HH:mm:ss") if kind == DATE else column.cast("string")), None
    if to == SET:
        if kind != SINGLE:
            raise MetaError(f"{kind} to set: make it a single first")
        return F.when(column.isNotNull(), F.array(column)).cast("array<int>"), own.values
    if to in (INT, FLOAT):
        if kind == SET:
            raise MetaError("a set is no number")
        return (F.expr(f"try_cast(`{name}` as double)") if kind == STRING else column).cast(SPARK_TYPES[to]), None
    if to == SINGLE:
        if kind == SET:
            return F.try_element_at(column, F.lit(1)), own.values
        return categories(survey, name)
    raise MetaError(f"no way from {kind} to {to}")


def categories(survey, name: str) -> tuple[Column, list[Value]]:
    """A single with a code for each distinct value in order; the values are read from the data, and must be few."""
    own, column = survey.meta[name], quoted(name)
    found = sorted(r[0] for r in survey.df.select(column).filter(column.isNotNull()).distinct().limit(10_001).collect())
    if len(found) > 10_000:
        raise MetaError(f"{name!r} has too many values for categories")
    key = survey.meta.text_key
    if own.type in (INT, BOOLEAN):
        return column.cast("int"), [Value(int(v), {key: str(v)}) for v in found]
    if not found:
        return F.lit(None).cast("int"), []
    codes = F.create_map(*[x for i, v in enumerate(found, 1) for x in (F.lit(v), F.lit(i))])
    return F.try_element_at(codes, column), [Value(i, {key: str(v)}) for i, v in enumerate(found, 1)]


def code_count(survey, name: str, only: Iterable[int] | None = None, without: Iterable[int] | None = None) -> Column:
    """Answers a row; of a grid, over all items."""
    codes = None if only is None and without is None else [c for c in survey.meta.codes(name) if (only is None or c in set(only)) and c not in set(without or ())]
    from ..functions.logic import count_of

    return reduce(lambda a, b: a + b, [count_of(quoted(n), survey.meta[n].type == SET, None if codes is None else tuple(codes)) for n in survey.meta.sources(name) or [name]])


def derotated(df: DataFrame, levels: list[str], groups: dict[str, list[str]], others: list[str], level_name: str = "level") -> DataFrame:
    """Wide groups of columns as long rows: others, level number, level label, one column a group.

    A row and level stays if any group has a value there.
    """
    n = len(levels)
    if any(len(columns) != n for columns in groups.values()):
        raise ValueError("each group needs a column for each level")
    rows = F.array(*[F.struct(F.lit(i + 1).alias(level_name), F.lit(label).alias(f"{level_name}_text"), *[quoted(c[i]).alias(g) for g, c in groups.items()]) for i, label in enumerate(levels)])
    made = df.select(*[quoted(o) for o in others], F.inline(rows))
    return made.filter(reduce(lambda a, b: a | b, [quoted(g).isNotNull() for g in groups]))


def as_datetime(column: Column, date_format: str = "dmy", date_sep: str = "/", time_format: str = "hm", time_sep: str = ":") -> Column:
    """Text to timestamp; unparsable text is null."""
    names = {"d": "d", "m": "M", "y": "yyyy"}
    clock = {"h": "H", "m": "m", "s": "s"}
    pattern = date_sep.join(names[c] for c in date_format) + (" " + time_sep.join(clock[c] for c in time_format) if time_format else "")
    return F.try_to_timestamp(column, F.lit(pattern))


def time_of_day(column: Column) -> Column:
    """Seconds since midnight."""
    return F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)


def summarized_time(df: DataFrame, column: str) -> DataFrame:
    """min, median, mean, mode and max of durations in seconds."""
    c = quoted(column)
    return df.agg(F.min(c).alias("min"), F.median(c).alias("median"), F.avg(c).alias("mean"), F.mode(c).alias("mode"), F.max(c).alias("max"))


def like_numeric(df: DataFrame, name: str) -> bool:
    """Whether all texts of a column are numbers; stops at the first that isn't."""
    return not df.filter(quoted(name).isNotNull() & F.expr(f"try_cast(`{name}` as double) IS NULL")).head(1)


def ascii_like(column: Column) -> Column:
    """Curly quotes, dashes and the like as plain signs."""
    return F.replace(F.translate(column, "‘’‚“”„–—−\u00a0", "'''\"\"\"--- "), F.lit("…"), F.lit("..."))
