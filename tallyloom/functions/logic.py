"""Row logic: expressions that compile to a Column that is never null.

``has_any([1, 2])`` and its kin make :class:`Logic` values; a dict applies one to
another variable, a list stands for ``has_any``, an int for one code, a string for
equality, and ``(a, union, b)`` is infix.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SYMBOL = {"lt": "<", "le": "<=", "eq": "", "ne": "!=", "ge": ">=", "gt": ">"}
_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "eq": lambda c, v: c == v,
    "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "ge": lambda c, v: c >= v, "gt": lambda c, v: c > v,
}


@dataclass(frozen=True)
class Logic:
    kind: str
    values: object = None
    exclusive: bool = False


def _codes(values: object, name: str) -> list[int]:
    values = [values] if isinstance(values, int) else values
    if not isinstance(values, (list, tuple, set, range)) or not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        raise TypeError(f"{name}() takes whole numbers, not {values!r}")
    return list(values)


def has_any(values, exclusive: bool = False) -> Logic:
    """Rows with at least one of the codes; exclusive: and no other."""
    return Logic("any", tuple(_codes(values, "has_any")), exclusive)


def not_any(values, exclusive: bool = False) -> Logic:
    """Rows without, those without any answer included; exclusive: answered rows only."""
    return Logic("not_any", tuple(_codes(values, "not_any")), exclusive)


def has_all(values, exclusive: bool = False) -> Logic:
    return Logic("all", tuple(_codes(values, "has_all")), exclusive)


def not_all(values, exclusive: bool = False) -> Logic:
    return Logic("not_all", tuple(_codes(values, "not_all")), exclusive)


def _responses(responses, name: str) -> tuple:
    made = list(responses) if isinstance(responses, list) else [responses]
    if not 1 <= len(made) <= 3:
        raise IndexError(f"{name}() takes [n], [min, max], [min, max, codes], [comparison] or [comparison, codes]")
    if isinstance(made[0], Logic):
        if made[0].kind not in _SYMBOL or len(made) > 2:
            raise TypeError(f"{name}(): {made[0].kind} doesn't compare")
        return (made[0], None, tuple(_codes(made[1], name)) if len(made) == 2 else None)
    _codes(made[:2], name)
    return (made[0], made[1] if len(made) > 1 else made[0], tuple(_codes(made[2], name)) if len(made) == 3 else None)


def has_count(responses, exclusive: bool = False) -> Logic:
    """Rows by number of answers; none is 0."""
    return Logic("count", _responses(responses, "has_count"), exclusive)


def not_count(responses, exclusive: bool = False) -> Logic:
    """The complement among rows with an answer."""
    return Logic("not_count", _responses(responses, "not_count"), exclusive)


def _comparison(kind: str) -> Callable[[object], Logic]:
    def made(value) -> Logic:
        if not isinstance(value, (int, float)) or isinstance(value, bool):
            raise TypeError(f"is_{kind}() takes a number, not {value!r}")
        return Logic(kind, value)

    made.__name__ = f"is_{kind}"
    return made


is_lt, is_le, is_eq, is_ne, is_ge, is_gt = map(_comparison, ("lt", "le", "eq", "ne", "ge", "gt"))


def _several(kind: str) -> Callable[..., Logic]:
    def made(logics) -> Logic:
        if not isinstance(logics, (list, tuple)):
            raise TypeError(f"{kind}() takes a list")
        return Logic(kind, tuple(logics))

    made.__name__ = kind
    return made


union, intersection, difference, symmetric_difference = map(_several, ("union", "intersection", "difference", "symmetric_difference"))
_FOLD = {
    "union": lambda a, b: a | b, "intersection": lambda a, b: a & b,
    "difference": lambda a, b: a & ~b, "symmetric_difference": lambda a, b: a != b,
}
_JOIN = {"union": ",", "intersection": "&", "difference": "~", "symmetric_difference": "^"}


def _normal(logic):
    """Lists, whole numbers and infix triples in the long form."""
    if isinstance(logic, bool):
        raise TypeError("a truth value is no logic")
    if isinstance(logic, int):
        return has_any([logic])
    if isinstance(logic, (list, range)):
        return has_any(list(logic))
    if isinstance(logic, tuple) and len(logic) == 3 and callable(logic[1]):
        return logic[1]([logic[0], logic[2]])
    return logic


def count_of(column: Column, is_set: bool, codes: tuple[int, ...] | None = None) -> Column:
    """Number of answers, among some codes if given; never null."""
    if is_set:
        return F.coalesce(F.size(column if codes is None else F.filter(column, lambda c: c.isin(list(codes)))), F.lit(0))
    hit = column.isNotNull() if codes is None else column.isin(list(codes))
    return F.coalesce(hit.cast("int"), F.lit(0))


class Compiler:
    """Compiles logic for one survey: ``column(name)`` gives a Column, ``kind(name)`` its type."""

    def __init__(self, column: Callable[[str], Column], kind: Callable[[str], str]):
        self.column, self.kind = column, kind

    def __call__(self, logic, name: str | None = None) -> Column:
        logic = _normal(logic)
        if isinstance(logic, dict):
            if len(logic) != 1:
                raise ValueError("one variable a dict")
            ((name, inner),) = logic.items()
            return self(inner, name)
        if isinstance(logic, Logic) and logic.kind in _FOLD:
            return reduce(_FOLD[logic.kind], [self(x, name) for x in logic.values])
        if name is None:
            raise ValueError("which variable is the logic about?")
        if isinstance(logic, str):
            return F.coalesce(self.column(name) == logic, F.lit(False))
        if not isinstance(logic, Logic):
            raise TypeError(f"no logic: {logic!r}")
        return self._leaf(logic, self.column(name), self.kind(name) == "delimited set")

    def _leaf(self, logic: Logic, column: Column, is_set: bool) -> Column:
        kind, values = logic.kind, logic.values
        if kind in _COMPARE:
            return F.coalesce(_COMPARE[kind](column, values), F.lit(False))
        if kind in ("count", "not_count"):
            least, most, codes = values
            n = count_of(column, is_set, codes)
            hit = _COMPARE[least.kind](n, least.values) if isinstance(least, Logic) else (n >= least) & (n <= most)
            if logic.exclusive and codes is not None:
                hit = hit & (n == count_of(column, is_set))
            return hit if kind == "count" else ~hit & column.isNotNull()
        codes = list(dict.fromkeys(values))
        if is_set:
            wanted = F.array(*map(F.lit, codes)).cast("array<int>")
            if kind in ("any", "not_any"):
                hit = F.arrays_overlap(column, wanted)
            else:
                hit = F.size(F.array_intersect(column, wanted)) == len(codes)
            if logic.exclusive and kind in ("any", "all"):
                hit = hit & (F.size(F.array_except(column, wanted)) == 0)
        elif kind in ("any", "not_any"):
            hit = column.isin(codes)
        else:
            hit = column == codes[0] if len(codes) == 1 else F.lit(False)
        hit = F.coalesce(hit, F.lit(False))
        if kind in ("any", "all"):
            return hit
        return ~hit & column.isNotNull() if logic.exclusive else ~hit


# --------------------------------------------------------------------- key texts


def key_of(logic, name: str | None = None) -> str:
    """The part of a view key that names a logic."""
    logic = _normal(logic)
    if isinstance(logic, dict):
        ((name, inner),) = logic.items()
        return f"{name}={key_of(inner)}"
    if isinstance(logic, str):
        return f"{{{logic}}}"
    kind, values = logic.kind, logic.values
    if kind in _FOLD:
        return f"({_JOIN[kind].join(key_of(x) for x in values)})"
    if kind in _SYMBOL:
        return f"({_SYMBOL[kind]}{values})"
    no, only = "~" if kind.startswith("not_") else "", "e" if logic.exclusive else ""
    if kind.endswith("count"):
        least, most, codes = values
        span = f"{_SYMBOL[least.kind]}{least.values}" if isinstance(least, Logic) else f"{least}" if most == least else f"{least}-{most}"
        return f"{no}{{{span}}}" if codes is None else f"{only}({','.join(map(str, codes))}){no}{{{span}}}"
    return f"{no}{only}{{{('&' if kind.endswith('all') else ',').join(map(str, values))}}}"


def logic_key(logic) -> str:
    return f"x[{key_of(logic)}]:y"


def frange(text: str, sep: str = ",") -> list[int]:
    """``'1-5,8'`` as a list; ``'5-1'`` counts down."""
    out: list[int] = []
    for part in str(text).split(sep):
        if m := re.fullmatch(r"\s*(-?\d+)\s*-\s*(-?\d+)\s*", part):
            a, b = int(m[1]), int(m[2])
            out += range(a, b + 1) if a <= b else range(a, b - 1, -1)
        elif part.strip():
            out.append(int(part))
    return out


_PANDAS_QUERY = [(re.compile(r"\s*==\s*"), " = "), (re.compile(r"\s*&\s*"), ") AND ("), (re.compile(r"\s*\|\s*"), ") OR ("), (re.compile(r"~\s*\("), "NOT (")]


def query_column(text: str) -> Column:
    """A filter in the notation of data-frame queries: ``a==1 & b>2``."""
    for pattern, to in _PANDAS_QUERY:
        text = pattern.sub(to, text)
    return F.coalesce(F.expr(f"(({text}))"), F.lit(False))
