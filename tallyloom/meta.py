"""The metadata document: variables, grids, value lists, sets and texts.

It lives on the driver; it is small however large the case data are.
"""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from difflib import SequenceMatcher

SINGLE, SET, INT, FLOAT, STRING, DATE, TIME, BOOLEAN = "single", "delimited set", "int", "float", "string", "date", "time", "boolean"
CATEGORICAL, NUMERIC = (SINGLE, SET), (INT, FLOAT)
TYPES = (SINGLE, SET, INT, FLOAT, STRING, DATE, TIME, BOOLEAN)
RESERVED = frozenset("batches columns filter info items lib masks name parent properties sets subtype text type values".split())
SPARK_TYPES = {SINGLE: "int", SET: "array<int>", INT: "long", FLOAT: "double", STRING: "string", DATE: "timestamp", TIME: "string", BOOLEAN: "boolean"}
LANGUAGES = tuple("ar-AR da-DK de-DE en-AR en-GB es-ES fi-FI fr-BE fr-FR it-IT main nb-NO pl-PL sv-SE tr-TR".split())


class MetaError(ValueError):
    """Something the metadata doesn't have or can't hold."""


@dataclass
class Value:
    code: int
    text: dict[str, str]
    factor: float | None = None
    edits: dict[str, dict[str, str]] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)


@dataclass
class Variable:
    name: str
    type: str
    text: dict[str, str]
    values: list[Value] | None = None
    parent: str | None = None
    edits: dict[str, dict[str, str]] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)
    #: code -> "exclude" (from everything) or "d.exclude" (from statistics)
    missings: dict[int, str] = field(default_factory=dict)
    #: axis -> {"sortx": ..., "slicex": ..., "dropx": ...}
    rules: dict[str, dict] = field(default_factory=dict)


@dataclass
class Grid(Variable):
    """Columns that share a value list. ``type`` is the type of its items."""

    items: list[str] = field(default_factory=list)


def as_text(label: str | dict[str, str] | None, text_key: str) -> dict[str, str]:
    return dict(label) if isinstance(label, dict) else {text_key: label or ""}


def as_values(categories: Iterable | None, text_key: str) -> list[Value] | None:
    """Codes with labels from any of: labels, codes, (code, label) pairs."""
    if categories is None:
        return None
    made = []
    for i, c in enumerate(categories, 1):
        if isinstance(c, Value):
            made.append(c)
        elif isinstance(c, tuple):
            made.append(Value(int(c[0]), as_text(c[1], text_key), c[2] if len(c) > 2 else None))
        elif isinstance(c, int):
            made.append(Value(c, {text_key: str(c)}))
        else:
            made.append(Value(i, as_text(c, text_key)))
    codes = [v.code for v in made]
    if len(set(codes)) < len(codes):
        raise MetaError(f"codes given twice: {sorted({c for c in codes if codes.count(c) > 1})}")
    return made


def pick_text(text: dict[str, str], text_key: str | list[str], edits: dict[str, dict[str, str]] | None = None, axis: str | None = None) -> str:
    """The text of the first key there is, an axis edit before the plain one, any language at last."""
    keys = [text_key] if isinstance(text_key, str) else list(text_key)
    for source in ([edits[axis]] if axis and edits and axis in edits else []) + [text]:
        for key in keys:
            if source.get(key):
                return source[key]
    return next(iter(text.values()), "")


class Meta:
    """Everything known about the columns of a survey."""

    def __init__(self, text_key: str = "main", name: str = ""):
        self.text_key, self.name = text_key, name
        self.columns: dict[str, Variable] = {}
        self.grids: dict[str, Grid] = {}
        self.sets: dict[str, list[str]] = {"data file": []}
        self.batches: dict[str, dict] = {}
        self.languages = list(LANGUAGES)

    # ------------------------------------------------------------------ lookup

    def __contains__(self, name: str) -> bool:
        return name in self.columns or name in self.grids

    def __getitem__(self, name: str) -> Variable:
        if name in self.grids:
            return self.grids[name]
        if name in self.columns:
            return self.columns[name]
        raise MetaError(f"no variable {name!r}")

    def resolve(self, name: str) -> list[str] | str | None:
        """Names that differ from this one in case at most; one of them, several, or none."""
        found = [v for v in [*self.columns, *self.grids] if v.lower() == name.lower()]
        return found[0] if len(found) == 1 else found or None

    def is_grid(self, name: str) -> bool:
        return name in self.grids

    def is_item(self, name: str) -> bool:
        return name in self.columns and self.columns[name].parent is not None

    def sources(self, name: str) -> list[str]:
        return list(self.grids[name].items) if name in self.grids else []

    def parents(self, name: str) -> list[str]:
        return [p] if (p := self.columns[name].parent if name in self.columns else None) else []

    def item_number(self, name: str) -> int:
        return self.grids[self.columns[name].parent].items.index(name) + 1

    def values(self, name: str) -> list[Value]:
        made = self[name].values
        if made is None:
            raise MetaError(f"{name!r} has no codes; categorise it first")
        return made

    def codes(self, name: str) -> list[int]:
        return [v.code for v in self.values(name)]

    def factors(self, name: str) -> dict[int, float]:
        return {v.code: v.factor for v in self.values(name) if v.factor is not None}

    def text(self, name: str, text_key: str | None = None, axis: str | None = None, shorten: bool = True) -> str:
        own = self[name]
        found = pick_text(own.text, text_key or self.text_key, own.edits, axis)
        if not shorten and self.is_item(name):
            grid = self.grids[self.columns[name].parent]
            return f"{pick_text(grid.text, text_key or self.text_key, grid.edits, axis)} - {found}"
        return found

    def value_texts(self, name: str, text_key: str | None = None, axis: str | None = None) -> dict[int, str]:
        return {v.code: pick_text(v.text, text_key or self.text_key, v.edits, axis) for v in self.values(name)}

    def item_texts(self, name: str, text_key: str | None = None, axis: str | None = None) -> dict[str, str]:
        return {i: self.text(i, text_key, axis) for i in self.sources(name)}

    def codes_from_label(self, name: str, label: str | list[str], text_key: str | None = None, exact: bool = True) -> list[int]:
        wanted = [label] if isinstance(label, str) else label
        texts = self.value_texts(name, text_key)
        return [c for w in wanted for c, t in texts.items() if (t == w if exact else w.lower() in t.lower())]

    def duplicate_texts(self, name: str, text_key: str | None = None) -> dict[str, list[int]]:
        by: dict[str, list[int]] = {}
        for c, t in self.value_texts(name, text_key).items():
            by.setdefault(t, []).append(c)
        return {t: c for t, c in by.items() if len(c) > 1}

    def variables(self, setname: str = "data file", numeric: bool = True, string: bool = True, date: bool = True, boolean: bool = True, blacklist: Iterable[str] = ()) -> list[str]:
        if setname not in self.sets:
            raise MetaError(f"no set {setname!r}")
        drop = {t for t, keep in ((INT, numeric), (FLOAT, numeric), (STRING, string), (DATE, date), (TIME, date), (BOOLEAN, boolean)) if not keep}
        return [v for v in self.sets[setname] if v in self and self[v].type not in drop and v not in set(blacklist)]

    def by_type(self, types: str | list[str] | None = None) -> dict[str, list[str]]:
        wanted = [types] if isinstance(types, str) else types
        out: dict[str, list[str]] = {}
        for n, v in self.columns.items():
            out.setdefault(v.type, []).append(n)
        if self.grids:
            out["array"] = list(self.grids)
        return {t: n for t, n in out.items() if not wanted or t in wanted}

    def find(self, tags: str | list[str], suffixed: bool = False) -> list[str]:
        tags = [tags] if isinstance(tags, str) else tags
        return [n for n in [*self.grids, *(c for c in self.columns if not self.is_item(c))] if any(n.endswith(t) if suffixed else t in n for t in tags)]

    def weak_duplicates(self) -> dict[str, list[str]]:
        by: dict[str, list[str]] = {}
        for n in [*self.columns, *self.grids]:
            by.setdefault(n.lower(), []).append(n)
        return {k: v for k, v in by.items() if len(set(v)) > 1}

    def enumerator(self, name: str) -> str:
        n = 1
        while f"{name}_{n}" in self:
            n += 1
        return f"{name}_{n}"

    def unroll(self, names: Iterable[str], keep: Iterable[str] = (), both: Iterable[str] | str = ()) -> list[str]:
        """Grids as their items; inside nests too."""
        both = list(self.grids) if both == "all" else list(both)
        out = []
        for name in names:
            levels = []
            for part in (p.strip() for p in name.split(">")):
                if part in self.grids and part not in set(keep):
                    levels.append(([part] if part in both else []) + self.sources(part))
                else:
                    levels.append([part])
            made = [""]
            for level in levels:
                made = [f"{m} > {x}" if m else x for m in made for x in level]
            out += made
        return list(dict.fromkeys(out))

    def roll_up(self, names: Iterable[str], ignore: Iterable[str] = ()) -> list[str]:
        """Items as their grids."""
        return list(dict.fromkeys(p if (p := self.columns[n].parent if n in self.columns else None) and p not in set(ignore) else n for n in names))

    # ------------------------------------------------------------------- change

    def add(self, name: str, kind: str, label: str | dict, categories: Iterable | None = None, items: Iterable | None = None, text_key: str | None = None, replace: bool = True) -> Variable:
        """Declares a variable, or, with items, a grid and its columns ``name_1``, ``name_2``, ..."""
        if kind not in TYPES:
            raise MetaError(f"{kind!r} is not one of {TYPES}")
        if kind in CATEGORICAL and categories is None:
            raise MetaError(f"{name!r} needs categories")
        if name in self and not replace:
            raise MetaError(f"{name!r} is there already")
        if name in RESERVED:
            name = f"_{name}"
        text_key = text_key or self.text_key
        values = as_values(categories, text_key)
        if kind == SET and len(values) == 1:
            kind = SINGLE  # a set of one code is a single
        if items is None:
            made = self.columns[name] = Variable(name, kind, as_text(label, text_key), values)
        else:
            numbered = [(i[0], i[1]) if isinstance(i, tuple) else (n, i) for n, i in enumerate(items, 1)]
            names = [f"{name}_{n}" for n, _ in numbered]
            for column, (_, text) in zip(names, numbered, strict=True):
                self.columns[column] = Variable(column, kind, as_text(text, text_key), values, parent=name)
            made = self.grids[name] = Grid(name, kind, as_text(label, text_key), values, items=names)
        if name not in self.sets["data file"]:
            self.sets["data file"].append(name)
        return made

    def drop(self, name: str, ignore_items: bool = False) -> list[str]:
        """Forgets a variable everywhere; returns the columns that go with it."""
        gone = [] if name in self.grids and ignore_items else self.sources(name)
        if name in self.grids:
            for i in self.sources(name):
                if ignore_items:
                    self.columns[i].parent = None
                    self.sets["data file"].append(i)
            del self.grids[name]
        else:
            gone = [name]
        for c in gone:
            own = self.columns.pop(c)
            if own.parent and own.parent in self.grids:
                self.grids[own.parent].items.remove(c)
        for s in self.sets.values():
            s[:] = [v for v in s if v != name and v not in gone]
        return gone

    def rename(self, mapper: dict[str, str]) -> None:
        if clash := [n for o, n in mapper.items() if n in self and n not in mapper]:
            raise MetaError(f"names in use: {clash}")
        to = lambda n: mapper.get(n, n)
        self.columns = {to(n): v for n, v in self.columns.items()}
        self.grids = {to(n): v for n, v in self.grids.items()}
        for n, v in [*self.columns.items(), *self.grids.items()]:
            v.name = n
            v.parent = to(v.parent) if v.parent else None
            if isinstance(v, Grid):
                v.items = [to(i) for i in v.items]
        self.sets = {s: [to(v) for v in names] for s, names in self.sets.items()}
        self.batches = json.loads(json.dumps(self.batches))
        for spec in self.batches.values():
            for key in ("x", "y"):
                spec[key] = [" > ".join(to(p.strip()) for p in v.split(">")) for v in spec.get(key, [])]

    def to_grid(self, name: str, variables: list[str], label: str | dict, safe: bool = True) -> Grid:
        """Binds columns of equal type and codes."""
        own = [self.columns[v] for v in variables]
        if safe and name in self:
            raise MetaError(f"{name!r} is there already")
        if len({(v.type, tuple(x.code for x in v.values or ())) for v in own}) != 1:
            raise MetaError("items differ in type or codes")
        for v in own:
            v.parent, v.values = name, own[0].values
        made = self.grids[name] = Grid(name, own[0].type, as_text(label, self.text_key), own[0].values, items=list(variables))
        at = [i for i, v in enumerate(self.sets["data file"]) if v in variables]
        self.sets["data file"] = [v for v in self.sets["data file"] if v not in variables]
        self.sets["data file"].insert(min(at, default=len(self.sets["data file"])), name)
        return made

    def unbind(self, name: str) -> None:
        self.drop(name, ignore_items=True)

    def reorder_values(self, name: str, order: list[int] | None = None) -> None:
        values = self.values(name)
        order = sorted(v.code for v in values) if order is None else order
        if sorted(order) != sorted(v.code for v in values):
            raise MetaError("the order must name every code once")
        values.sort(key=lambda v: order.index(v.code))

    def extend_values(self, name: str, more: Iterable, text_key: str | None = None, safe: bool = True) -> None:
        values = self.values(name)
        top = max((v.code for v in values), default=0)
        listed = [more] if isinstance(more, (str, tuple, int)) else list(more)
        for m in listed:
            made = as_values([m if not isinstance(m, str) else (top + 1, m)], text_key or self.text_key)[0]
            if made.code in {v.code for v in values}:
                raise MetaError(f"code {made.code} is there already")
            if safe and made.text in [v.text for v in values]:
                raise MetaError(f"label {made.text} is there already")
            values.append(made)
            top = max(top, made.code)

    def remove_values(self, name: str, remove: Iterable[int]) -> None:
        gone = set(remove)
        self.values(name)[:] = [v for v in self.values(name) if v.code not in gone]
        self[name].missings = {c: f for c, f in self[name].missings.items() if c not in gone}

    def reorder_items(self, name: str, order: list[int]) -> None:
        grid = self.grids[name]
        if sorted(order) != list(range(1, len(grid.items) + 1)):
            raise MetaError("the order must name every item's number once")
        grid.items = [grid.items[n - 1] for n in order]

    def remove_items(self, name: str, remove: Iterable[int]) -> list[str]:
        gone = [self.grids[name].items[n - 1] for n in remove]
        for g in gone:
            self.drop(g)
        return gone

    def extend_items(self, name: str, more: Iterable, text_key: str | None = None) -> list[str]:
        grid, made = self.grids[name], []
        top = max((int(m[1]) for i in grid.items if (m := re.search(r"_(\d+)$", i))), default=len(grid.items))
        for m in more:
            n, text = m if isinstance(m, tuple) else (top + 1, m)
            top = max(top, n)
            column = f"{name}_{n}"
            if column in self:
                raise MetaError(f"{column!r} is there already")
            self.columns[column] = Variable(column, grid.type, as_text(text, text_key or self.text_key), grid.values, parent=name)
            grid.items.append(column)
            made.append(column)
        return made

    def copy_variable(self, name: str, new: str, only: Iterable[int] | None = None, drop: Iterable[int] | None = None) -> dict[str, str]:
        """Declares a copy; returns old to new column names."""
        keep = lambda values: None if values is None else [copy.deepcopy(v) for v in values if (only is None or v.code in set(only)) and v.code not in set(drop or ())]
        own = self[name]
        values = keep(own.values)
        if name in self.grids:
            names = {i: f"{new}_{i.rsplit('_', 1)[-1]}" for i in own.items}
            for old, column in names.items():
                made = copy.deepcopy(self.columns[old])
                made.name, made.parent, made.values = column, new, values
                self.columns[column] = made
            grid = copy.deepcopy(own)
            grid.name, grid.items, grid.values = new, list(names.values()), values
            self.grids[new] = grid
        else:
            names = {name: new}
            made = copy.deepcopy(own)
            made.name, made.values, made.parent = new, values, None
            self.columns[new] = made
        if new not in self.sets["data file"]:
            self.sets["data file"].append(new)
        self[new].properties["created"] = True
        self[new].properties["recoded_from"] = name
        return names

    # -------------------------------------------------------------------- texts

    def _all_texts(self) -> Iterable[tuple[dict[str, str], dict[str, dict[str, str]]]]:
        seen = set()
        for v in [*self.columns.values(), *self.grids.values()]:
            yield v.text, v.edits
            for x in v.values or ():
                if id(x) not in seen:
                    seen.add(id(x))
                    yield x.text, x.edits

    def set_variable_text(self, name: str, text: str, text_key: str | None = None, axis: str | list[str] | None = None) -> None:
        self._set_text(self[name], text, text_key, axis)

    def _set_text(self, own: Variable | Value, text: str, text_key: str | None, axis: str | list[str] | None) -> None:
        key = text_key or self.text_key
        if key not in self.languages:
            raise MetaError(f"{key!r} is no known text key")
        for a in [axis] if isinstance(axis, (str, type(None))) else axis:
            (own.text if a is None else own.edits.setdefault(a, {}))[key] = text

    def set_value_texts(self, name: str, texts: dict[int, str], text_key: str | None = None, axis: str | None = None) -> None:
        by = {v.code: v for v in self.values(name)}
        for code, text in texts.items():
            if code not in by:
                raise MetaError(f"{name!r} has no code {code}")
            self._set_text(by[code], text, text_key, axis)

    def set_item_texts(self, name: str, texts: dict[int, str], text_key: str | None = None, axis: str | None = None) -> None:
        for n, text in texts.items():
            self._set_text(self.columns[self.grids[name].items[n - 1]], text, text_key, axis)

    def extend_text_keys(self, more: Iterable[str]) -> None:
        """Text keys that may be used besides those that are known."""
        self.languages += [k for k in dict.fromkeys(more) if k not in self.languages]

    def used_text_keys(self) -> list[str]:
        return sorted({k for t, e in self._all_texts() for k in [*t, *(x for d in e.values() for x in d)]})

    def force_texts(self, to: str | list[str] | None = None, source: str | list[str] | None = None, update: bool = False) -> None:
        """Fills languages from the first of the sources that has a text."""
        to = [to] if isinstance(to, str) else to or self.used_text_keys()
        source = [source] if isinstance(source, str) else source or [self.text_key]
        for text, edits in self._all_texts():
            for own in (text, *edits.values()):
                found = next((own[s] for s in source if own.get(s)), None)
                for t in to:
                    if found is not None and (update or not own.get(t)):
                        own[t] = found

    def select_text_keys(self, keep: str | list[str] | None = None) -> None:
        keep = {keep} if isinstance(keep, str) else set(keep or [self.text_key])
        for text, edits in self._all_texts():
            for own in (text, *edits.values()):
                for k in [k for k in own if k not in keep]:
                    del own[k]

    def replace_texts(self, replace: dict[str, str], text_key: str | list[str] | None = None) -> None:
        self._apply(lambda s: [s := s.replace(a, b) for a, b in replace.items()][-1] if replace else s, text_key)

    def remove_html(self) -> None:
        def clean(s: str) -> str:
            s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
            s = re.sub(r"<[^>]+>|[_*]|\$\w+(?:\.\w+)*\$?", "", s)
            return s.strip()

        self._apply(clean)

    def _apply(self, change, text_key: str | list[str] | None = None) -> None:
        keys = None if text_key is None else {text_key} if isinstance(text_key, str) else set(text_key)
        for text, edits in self._all_texts():
            for own in (text, *edits.values()):
                for k in own:
                    if keys is None or k in keys:
                        own[k] = change(own[k])

    def cut_item_texts(self, grids: Iterable[str] | None = None) -> None:
        """Items' labels without the grid's label before them."""
        for g in grids or list(self.grids):
            for i in self.sources(g):
                for own, lead in ((self.columns[i].text, self.grids[g].text), *((e, self.grids[g].edits.get(a, {})) for a, e in self.columns[i].edits.items())):
                    for k, t in own.items():
                        if lead.get(k) and t.startswith(lead[k]):
                            own[k] = t[len(lead[k]) :].lstrip(" -–:")

    def restore_item_texts(self, grids: Iterable[str] | None = None) -> None:
        """Items' labels with the grid's label in front, where they lack it."""
        for g in grids or list(self.grids):
            for i in self.sources(g):
                own = self.columns[i].text
                for k, t in own.items():
                    lead = self.grids[g].text.get(k, "")
                    if lead and not t.startswith(lead):
                        own[k] = f"{lead} - {t}"

    def repair_text_edits(self, text_key: str | None = None) -> None:
        for v in [*self.columns.values(), *self.grids.values(), *(x for c in self.columns.values() for x in c.values or ())]:
            v.edits = {a: t if isinstance(t, dict) else {text_key or self.text_key: t} for a, t in v.edits.items()}

    # ------------------------------------------------------- factors, properties

    def set_factors(self, name: str, factors: dict[int, float], safe: bool = False) -> None:
        if self[name].type != SINGLE:
            raise MetaError("only singles have factors")
        by = {v.code: v for v in self.values(name)}
        if unknown := [c for c in factors if c not in by]:
            if safe:
                raise MetaError(f"{name!r} has no codes {unknown}")
        for c, f in factors.items():
            if c in by:
                by[c].factor = f

    def clear_factors(self, name: str) -> None:
        for v in self.values(name):
            v.factor = None

    def get_property(self, name: str, prop: str):
        return self[name].properties.get(prop)

    def set_property(self, name: str, prop: str, value, ignore_items: bool = False) -> None:
        self[name].properties[prop] = value
        if name in self.grids and not ignore_items:
            for i in self.sources(name):
                self.columns[i].properties[prop] = value

    def set_missings(self, names: str | list[str], flags: dict | str = "default", hide_on_y: bool = True, ignore: Iterable[str] = ()) -> None:
        """flags: {"exclude": codes, "d.exclude": codes}, or "default": codes of 90 and up that look like no answer."""
        for name in [names] if isinstance(names, str) else names:
            if name in set(ignore):
                continue
            own = self[name]
            if flags == "default":
                made = {v.code: "d.exclude" for v in own.values or () if v.code in (92, 93, 94, 95, 96, 97, 98, 99)}
            else:
                made = {c: f for f, codes in flags.items() for c in ([codes] if isinstance(codes, int) else codes)}
                if bad := set(made.values()) - {"exclude", "d.exclude"}:
                    raise MetaError(f"no such flags: {bad}")
            own.missings = made
            for i in self.sources(name):
                self.columns[i].missings = made
            if hide_on_y and made:
                self.hide(name, list(made), "y")

    # --------------------------------------------------------------------- rules

    def sort_rule(self, name: str, on="@", within: bool = False, between: bool = False, fix: list[int] | None = None, ascending: bool = False, weight: str = "auto") -> None:
        self[name].rules.setdefault("x", {})["sortx"] = {"sort_on": on, "within": within, "between": between, "fixed": fix or [], "ascending": ascending, "with_weight": weight}

    def slice_rule(self, name: str, codes: list[int], axis: str | list[str] = "y") -> None:
        for a in [axis] if isinstance(axis, str) else axis:
            self[name].rules.setdefault(a, {})["slicex"] = {"values": list(codes)}

    def hide(self, name: str, codes: list, axis: str | list[str] = "y", hide_values: bool = True) -> None:
        for a in [axis] if isinstance(axis, str) else axis:
            own = self[name].rules.setdefault(a, {}).setdefault("dropx", {"values": []})
            own["values"] = list(dict.fromkeys([*own["values"], *codes]))
            if name in self.grids and hide_values:
                for i in self.sources(name):
                    self.columns[i].rules.setdefault(a, {})["dropx"] = {"values": list(own["values"])}

    # ---------------------------------------------------------------------- sets

    def create_set(self, name: str = "new_set", based_on: str = "data file", included: list[str] | None = None, excluded: list[str] | None = None, strings: str = "keep", arrays: str = "masks", replace: dict | None = None, overwrite: bool = False) -> list[str]:
        if name in self.sets and not overwrite:
            raise MetaError(f"set {name!r} is there already")
        made = self.filtered(based_on, arrays == "masks", included, excluded, strings)
        made = [(replace or {}).get(v, v) for v in made]
        if arrays in ("columns", "both"):
            made = self.unroll(made, both="all" if arrays == "both" else ())
        self.sets[name] = made
        return made

    def filtered(self, based_on: str, grids: bool = True, included: list[str] | None = None, excluded: list[str] | None = None, strings: str | None = None) -> list[str]:
        made = self.sets[based_on] if grids else self.unroll(self.sets[based_on])
        if included:
            made = [v for v in made if v in included]
        made = [v for v in made if v not in (excluded or ())]
        if strings == "drop":
            made = [v for v in made if self[v].type != STRING]
        elif strings == "only":
            made = [v for v in made if self[v].type == STRING]
        return list(made)

    def order(self, new: list[str] | None = None, reposition: list[dict] | None = None, regroup: bool = False) -> None:
        now = self.sets["data file"]
        if regroup:
            kids: dict[str, list[str]] = {}
            for v in now:
                if v in self and (p := self[v].properties.get("recoded_from")) in now:
                    kids.setdefault(p, []).append(v)
            moved = {k for own in kids.values() for k in own}
            now = [x for v in now if v not in moved for x in (v, *kids.get(v, ()))]
        if new:
            now = [*new, *(v for v in now if v not in new)]
        for step in reposition or ():
            for before, moved in step.items():
                moved = [moved] if isinstance(moved, str) else moved
                rest = [v for v in now if v not in moved]
                at = rest.index(before) if before in rest else len(rest)
                now = rest[:at] + list(moved) + rest[at:]
        self.sets["data file"] = now

    def align_order(self, names: list[str], against: str = "data file", suffixes: tuple[str, ...] = ("_rc", "_rb"), fix: list[str] | None = None) -> list[str]:
        fix = fix or []
        place = {v: i for i, v in enumerate(self.sets[against])}

        def at(v: str) -> tuple:
            root = next((v[: -len(s)] for s in suffixes if v.endswith(s) and v[: -len(s)] in place), v)
            return (place.get(root, len(place)), v != root)

        return [*fix, *sorted((v for v in names if v not in fix), key=at)]

    # ------------------------------------------------------------- names of grids

    def dimensionized(self, names: list[str] | None = None) -> dict[str, str]:
        """To names of the form grid.grid_grid and grid[{item}].grid_grid."""
        made = {}
        for g in names or list(self.grids):
            if g in self.grids:
                made[g] = f"{g}.{g}_grid"
                made |= {i: f"{g}[{{{i}}}].{g}_grid" for i in self.sources(g)}
        return made

    def undimensionized(self, names: list[str] | None = None) -> dict[str, str]:
        made = {}
        for n in names or [*self.grids, *self.columns]:
            if m := re.fullmatch(r"(.+)\[\{(.+)\}\]\..+_grid", n):
                made[n] = m[2]
            elif m := re.fullmatch(r"(.+)\.\1_grid", n):
                made[n] = m[1]
        return made

    # -------------------------------------------------------- merge, compare, store

    def merged(self, other: Meta, names: Iterable[str] | None = None, overwrite_text: bool = False) -> Meta:
        """A copy with the other's variables; code lists and texts extended."""
        out = copy.deepcopy(self)
        for n in names or other.sets["data file"]:
            if n not in other:
                continue
            if n not in out:
                if n in other.grids:
                    out.grids[n] = copy.deepcopy(other.grids[n])
                    for i in other.sources(n):
                        out.columns[i] = copy.deepcopy(other.columns[i])
                        out.columns[i].values = out.grids[n].values
                else:
                    out.columns[n] = copy.deepcopy(other.columns[n])
                out.sets["data file"].append(n)
                continue
            for c in [n, *other.sources(n)]:
                if c in out:
                    _merge_variable(out[c], other[c], overwrite_text)
        return out

    def compare(self, other: Meta, names: Iterable[str] | None = None, strict: bool = False, text_key: str | None = None) -> dict[str, list[str]]:
        """Differences in type, label, codes and code labels."""
        out: dict[str, list[str]] = {}
        key = text_key or self.text_key
        ratio = 1.0 if strict else 0.8
        for n in names or [v for v in self.sets["data file"] if v in other]:
            if n not in self or n not in other:
                out[n] = ["missing"]
                continue
            a, b, found = self[n], other[n], []
            if a.type != b.type:
                found.append(f"type {a.type} / {b.type}")
            if SequenceMatcher(None, pick_text(a.text, key), pick_text(b.text, key)).ratio() < ratio:
                found.append("label")
            if a.values and b.values:
                if {v.code for v in a.values} != {v.code for v in b.values}:
                    found.append("codes")
                texts = {v.code: pick_text(v.text, key) for v in b.values}
                if any(v.code in texts and SequenceMatcher(None, pick_text(v.text, key), texts[v.code]).ratio() < ratio for v in a.values):
                    found.append("code labels")
            if isinstance(a, Grid) and isinstance(b, Grid) and a.items != b.items:
                found.append("items")
            if found:
                out[n] = found
        return out

    def to_dict(self) -> dict:
        return {
            "text_key": self.text_key,
            "name": self.name,
            "columns": {n: asdict(v) for n, v in self.columns.items()},
            "grids": {n: asdict(v) for n, v in self.grids.items()},
            "sets": self.sets,
            "batches": self.batches,
        }

    @classmethod
    def from_dict(cls, made: dict) -> Meta:
        out = cls(made.get("text_key", "main"), made.get("name", ""))
        ints = lambda d: {int(k): v for k, v in d.items()}
        value = lambda v: None if v is None else [Value(**x) for x in v]
        for n, v in made["grids"].items():
            out.grids[n] = Grid(**{**v, "values": value(v["values"]), "missings": ints(v["missings"])})
        for n, v in made["columns"].items():
            own = Variable(**{**v, "values": value(v["values"]), "missings": ints(v["missings"])})
            if own.parent in out.grids:
                own.values = out.grids[own.parent].values
            out.columns[n] = own
        out.sets, out.batches = made["sets"], made.get("batches", {})
        return out

    def to_json(self, key: str | None = None, collection: str | None = None) -> str:
        made = self.to_dict()
        if collection:
            made = made[collection]
        return json.dumps(made[key] if key else made, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Meta:
        return cls.from_dict(json.loads(text))

    @classmethod
    def inferred(cls, schema, text_key: str = "main") -> Meta:
        """Of a bare frame: whole numbers are int, others float, arrays sets without codes, the rest by type."""
        out = cls(text_key)
        kinds = {"int": INT, "bigint": INT, "smallint": INT, "tinyint": INT, "double": FLOAT, "float": FLOAT, "string": STRING, "timestamp": DATE, "date": DATE, "timestamp_ntz": DATE, "boolean": BOOLEAN}
        for f in schema.fields:
            kind = kinds.get(f.dataType.simpleString(), FLOAT if f.dataType.simpleString().startswith("decimal") else None)
            if f.dataType.simpleString().startswith("array<"):
                out.columns[f.name] = Variable(f.name, SET, {text_key: f.name}, [])
            elif kind:
                out.columns[f.name] = Variable(f.name, kind, {text_key: f.name})
            else:
                continue
            out.sets["data file"].append(f.name)
        return out


def _merge_variable(own: Variable, other: Variable, overwrite: bool) -> None:
    compatible(own, other)
    own.text = {**own.text, **other.text} if overwrite else {**other.text, **own.text}
    if own.values is not None and other.values is not None:
        by = {v.code: v for v in own.values}
        for v in other.values:
            if v.code in by:
                by[v.code].text = {**by[v.code].text, **v.text} if overwrite else {**v.text, **by[v.code].text}
            else:
                own.values.append(copy.deepcopy(v))
    if own.type == SINGLE and other.type == SET:
        own.type = SET


def compatible(a: Variable, b: Variable) -> str | None:
    """A warning where two types can be brought together; an error where they can't."""
    if a.type == b.type:
        return None
    pair = {a.type, b.type}
    if pair in ({SINGLE, SET}, {INT, FLOAT}, {SINGLE, INT}, {SINGLE, FLOAT}):
        return f"{a.name}: {a.type} meets {b.type}"
    raise MetaError(f"{a.name}: {a.type} can't hold {b.type}")
