"""Views: named ways to aggregate a link, their keys, and what a key tells.

A key is ``x|method|condition|relation|weight|name``. The condition names what the
rows are: ``:`` the codes, ``x:`` a margin, ``x++:`` running sums, ``x[{1,2}]:`` a
net, with ``+`` beside the codes that stand around it and ``*`` if the other codes
fill up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

from ..functions.logic import logic_key
from ..plans.tabulate import Net

#: Preset name, method, condition, relation, text.
PRESETS: dict[str, tuple[str, str, str, str]] = {
    "default": ("default", ":", "", ""),
    "cbase": ("f", "x:", "", "Base"),
    "cbase_gross": ("f", "x:", "", "Gross base"),
    "rbase": ("f", ":y", "", "Base"),
    "ebase": ("f", "x:", "", "Effective Base"),
    "counts": ("f", ":", "", ""),
    "c%": ("f", ":", "y", ""),
    "r%": ("f", ":", "x", ""),
    "res_c%": ("f", ":", "counts_sum", ""),
    "counts_sum": ("f.c:f", "x:", "", "Total Sum"),
    "c%_sum": ("f.c:f", "x:", "y", "Total Sum"),
    "counts_cumsum": ("f.c:f", "x++:", "", ""),
    "c%_cumsum": ("f.c:f", "x++:", "y", ""),
    "mean": ("d.mean", "x:", "", ""),
    "stddev": ("d.stddev", "x:", "", ""),
    "min": ("d.min", "x:", "", ""),
    "max": ("d.max", "x:", "", ""),
    "median": ("d.median", "x:", "", ""),
}
COUNT_VIEWS = ("cbase", "cbase_gross", "rbase", "ebase", "counts", "c%", "r%", "res_c%", "counts_sum", "c%_sum", "counts_cumsum", "c%_cumsum")
STAT_TEXTS = {
    "mean": "Mean", "stddev": "Std. dev.", "sem": "Std. err. of mean", "median": "Median", "var": "Sample variance", "varcoeff": "Coefficient of variation",
    "min": "Min", "max": "Max", "lower_q": "Lower quartile", "upper_q": "Upper quartile",
}


def preset_key(name: str, weight: str | None = None) -> str:
    method, condition, relation, _ = PRESETS[name]
    return f"x|{method}|{condition}|{relation}|{weight or ''}|{name}"


def factor_condition(factors: dict[int, float] | None) -> str:
    """``x[{100,50,0}]:`` for rescaled scores."""
    if not factors:
        return "x:"
    return "x[{" + ",".join(f"{f:g}" for f in factors.values()) + "}]:"


def nets_condition(nets: Iterable[Net], complete: bool = False, calc: tuple | None = None) -> str:
    parts, named = [], {}
    for n in nets:
        codes = "{" + ",".join(map(str, n.codes)) + "}"
        if n.logic is not None:
            parts.append(logic_key(n.logic).removesuffix(":y"))
        else:
            parts.append(f"x[{codes}+]" if n.expand == "after" else f"x[+{codes}]" if n.expand == "before" else f"x[{codes}]")
        named[n.name] = codes
    if calc:
        left, sign, right = calc
        parts.append(f"x[{named.get(left, left)}{sign}{named.get(right, right) if isinstance(right, str) else right}]")
    return ",".join(parts) + ("*:" if complete else ":")


@dataclass(frozen=True)
class View:
    """What a key says."""

    key: str

    @property
    def parts(self) -> list[str]:
        return self.key.split("|")

    method = property(lambda self: self.parts[1])
    condition = property(lambda self: self.parts[2])
    relation = property(lambda self: self.parts[3])
    weight = property(lambda self: self.parts[4] or None)
    name = property(lambda self: self.parts[5])
    is_weighted = property(lambda self: bool(self.parts[4]))
    is_base = property(lambda self: self.name in ("cbase", "cbase_gross", "rbase", "ebase"))
    is_sum = property(lambda self: self.name in ("counts_sum", "c%_sum"))
    is_cumulative = property(lambda self: self.condition.startswith("x++"))
    is_pct = property(lambda self: bool(self.relation) and self.method.startswith("f"))
    is_stat = property(lambda self: self.method.startswith("d."))
    is_propstest = property(lambda self: self.method.startswith("t.props"))
    is_meanstest = property(lambda self: self.method.startswith("t.means"))
    is_net = property(lambda self: self.method.startswith("f") and "[" in self.condition)
    is_counts = property(lambda self: self.method.startswith("f") and not self.relation and not self.is_base and not self.is_sum)
    #: the level of a test, 0.05 for ``t.props.Dim.05``
    level = property(lambda self: float("0." + self.method.split(".")[3].split("+")[0]) if self.method.startswith("t.") else None)

    def describe(self) -> dict[str, object]:
        kinds = ("is_weighted", "is_base", "is_sum", "is_cumulative", "is_pct", "is_stat", "is_propstest", "is_meanstest", "is_net", "is_counts")
        return {"key": self.key, "name": self.name, "method": self.method, "condition": self.condition, "relation": self.relation, "weight": self.weight, **{k: getattr(self, k) for k in kinds}}

    def text(self, text_key: str = "en-GB") -> str:
        """A statistic's or base's name for the reader."""
        if self.is_stat:
            return STAT_TEXTS.get(self.method.removeprefix("d."), self.name)
        return PRESETS.get(self.name, ("", "", "", ""))[3]


def row_kind(x_code: str) -> str:
    """Of a row of a block: normal, net, calc, margin or sum."""
    return {"All": "margin", "sum": "sum"}.get(x_code) or ("net" if x_code.startswith("net:") else "calc" if x_code.startswith("calc:") else "normal")


# ------------------------------------------------------------- own view methods


@dataclass
class Method:
    name: str
    method: Callable | str
    kwargs: dict = field(default_factory=dict)
    iterators: dict[str, list] = field(default_factory=dict)


class ViewMapper:
    """Named methods, presets among them: the place for aggregations of one's own.

    A method is a preset's name or a callable ``(survey, link, **kwargs)`` that
    returns a DataFrame with x_code, x_pos, y_code, y_pos and value; ``link`` has x,
    y, where and weight.
    """

    def __init__(self, names: Iterable[str] = ()):
        self.methods: dict[str, Method] = {n: Method(n, n) for n in names}
        self.template: tuple[Callable | str | None, dict, dict] = (None, {}, {})
        if unknown := [n for n in names if n not in PRESETS]:
            raise KeyError(f"no presets: {unknown}")

    def make_template(self, method: Callable | str, kwargs: dict | None = None, iterators: dict[str, list] | None = None) -> None:
        """What methods added from here on have where they don't say otherwise."""
        self.template = method, kwargs or {}, iterators or {}

    def add_method(self, name: str, method: Callable | str | None = None, kwargs: dict | None = None, iterators: dict[str, list] | None = None) -> None:
        base, shared, loops = self.template
        if (method or base) is None:
            raise ValueError(f"{name!r} has no method, and there is no template")
        self.methods[name] = Method(name, method or base, {**shared, **(kwargs or {})}, iterators or loops)

    def subset(self, names: Iterable[str], strict: bool = True) -> ViewMapper:
        made = ViewMapper()
        for n in names:
            if n in self.methods:
                made.methods[n] = self.methods[n]
            elif strict:
                raise KeyError(f"no method {n!r}")
        return made

    def calls(self) -> Iterable[tuple[Method, dict]]:
        """Each method with each combination of its iterators' values."""
        for m in self.methods.values():
            for values in product(*m.iterators.values()):
                yield m, {**m.kwargs, **dict(zip(m.iterators, values, strict=True))}


def net(name: str, condition, text: str | dict = "", expand: str | None = None) -> dict:
    """A net's definition, for add_nets."""
    return {name: condition, **({"text": text} if text else {}), **({"expand": expand} if expand else {})}


def calc(left: str, sign: str, right: str | float, text: str = "", exclusive: bool = False) -> dict:
    """A calculation on nets, for add_nets; exclusive: without the nets themselves."""
    return {"calc": (left, sign, right), "text": text, "exclusive": exclusive}


# ------------------------------------------------------------------ ordered keys


class ViewManager:
    """The keys of a report's views in the order they are shown."""

    def __init__(self, available: Iterable[str], weight: str | None = None, tests: Iterable[float] = ()):
        self.available = list(available)
        self.weight = weight
        self.tests = list(tests)
        self.views: list[str] = []
        self.cell_items = "colpct"

    def get_views(self, cell_items: str = "colpct", freqs: bool = True, nets: bool = True, stats: Iterable[str] = ("mean", "stddev"), sums: str | None = "bottom", bases: str = "auto", order: str = "normal") -> ViewManager:
        """cell_items: counts, colpct, rowpct or several joined by _; order: normal has percents first."""
        items = {"c": "counts", "p": "colpct", "cp": "counts_colpct"}.get(cell_items, cell_items).split("_")
        if bad := set(items) - {"counts", "colpct", "rowpct"}:
            raise ValueError(f"no cell items: {sorted(bad)}")
        if bases not in ("auto", "both", "weighted", "unweighted"):
            raise ValueError(f"no bases: {bases!r}")
        self.cell_items = "_".join(items)
        relation = {"colpct": "y", "rowpct": "x", "counts": ""}
        wanted = [relation[i] for i in (items if order == "switched" else sorted(items, key=lambda i: i == "counts"))]
        all_views = [View(k) for k in self.available]
        own = [v for v in all_views if v.weight == self.weight]
        plain = [v for v in all_views if v.weight is None]
        picked = [v for v in {"auto": own, "weighted": own, "unweighted": plain, "both": [*plain, *(own if self.weight else [])]}[bases] if v.name == "cbase"]
        in_order = lambda views: [v for r in wanted for v in views if v.relation == r]
        inner = [v for v in own if v.name in ("counts", "c%", "r%") or v.is_cumulative] if freqs else []
        complete = {v.condition for v in own if v.is_net and v.condition.endswith("*:")}
        if complete or any(v.is_cumulative for v in own):
            inner = [v for v in inner if v.is_cumulative or not complete]
        body = in_order(inner)
        if nets:
            conditions = list(dict.fromkeys(v.condition for v in own if v.is_net))
            body += [v for c in conditions for v in in_order([v for v in own if v.is_net and v.condition == c])]
        total = in_order([v for v in own if v.is_sum])
        numbers = [v for s in stats or () for v in own if v.is_stat and v.method == f"d.{s}"]
        body = picked + body + (total + numbers if sums == "mid" else numbers + total if sums == "bottom" else numbers)
        self.views = [v.key for v in self._with_tests(body, own)]
        return self

    def _with_tests(self, body: list[View], own: list[View]) -> list[View]:
        out = []
        for v in body:
            out.append(v)
            kind = "t.means" if v.is_stat and v.method == "d.mean" else "t.props" if v.relation == "y" and not v.is_sum and not v.is_cumulative else ""
            if kind:
                out += [t for t in own if t.method.startswith(kind) and t.condition == v.condition and (not self.tests or t.level in self.tests)]
        return out

    def set_bases(self, base: str | None = "w", gross: str | bool = False, effective: str | bool = False, order: Iterable[str] = ("base", "gross", "effective"), unweighted_first: bool = True) -> ViewManager:
        """base, gross, effective: "w" (weighted), "uw", "both" or nothing."""
        names = {"base": ("cbase", base), "gross": ("cbase_gross", gross), "effective": ("ebase", effective)}
        made = []
        for o in order:
            name, which = names[o]
            weights = {"w": [self.weight], "uw": [None], "both": [None, self.weight] if unweighted_first else [self.weight, None]}.get(which or "", [])
            made += [preset_key(name, w) for w in dict.fromkeys(weights)]
        self.views = [*made, *(k for k in self.views if not View(k).is_base)]
        return self

    def group(self, style: str = "reduce", switch: bool = False) -> list[list[str]] | list[str]:
        """Keys that share rows (counts, percents, tests of the same codes) side by side, as lists; reduce: lists of one flat."""
        by: dict[tuple, list[str]] = {}
        for k in self.views:
            v = View(k)
            rows = (v.condition, "stat" if v.is_stat or v.is_meanstest else v.name if v.is_base or v.is_sum else "cells")
            by.setdefault((*rows, k if v.is_base or v.is_stat else ""), []).append(k)
        made = [own[::-1] if switch and len(own) > 1 else own for own in by.values()]
        return [own[0] if len(own) == 1 and style == "reduce" else own for own in made]


def shake(keys: Iterable[list[str] | str]) -> list[list[str]]:
    """Groups of keys without repeats."""
    seen: set[str] = set()
    out = []
    for own in keys:
        kept = [k for k in ([own] if isinstance(own, str) else own) if k not in seen]
        seen.update(kept)
        if kept:
            out.append(kept)
    return out
