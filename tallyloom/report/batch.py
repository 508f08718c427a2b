"""Batches: what a report shows, kept in the survey's metadata."""

from __future__ import annotations

import copy
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import STRING, MetaError
from ..plans.tabulate import quoted
from ..survey import Survey


def _listed(x) -> list:
    return [] if x is None else [x] if isinstance(x, (str, int, float, dict)) else list(x)


def _fresh(name: str, text_key: str) -> dict:
    return {
        "name": name, "x": [], "y": ["@"], "variables": [], "sections": {}, "total": True, "extended_y": {}, "replaced_y": {}, "x_filters": {}, "filter": None,
        "y_on_y": [], "y_on_y_filters": {}, "texts": {}, "transposed": [], "leveled": {}, "summaries": [], "open_ends": [], "cell_items": ["c", "p"], "unweighted_counts": False,
        "weights": [None], "tests": {"levels": [], "flags": [30, 100], "test_total": False, "mimic": "dim"}, "language": text_key, "additions": [], "addition_to": None,
        "edits": {}, "hidden": [], "sample_size": None,
    }


class Batch:
    """One report's specification. Every change is in ``survey.meta.batches`` at once."""

    def __init__(self, survey: Survey, name: str, cell_items: Iterable[str] = ("c", "p"), weights=None, tests=None):
        if "-" in name:
            raise ValueError("no '-' in names of batches")
        self.survey, self.name = survey, name
        if name not in survey.meta.batches:
            survey.meta.batches[name] = _fresh(name, survey.meta.text_key)
            self.set_cell_items(cell_items)
            self.set_weights(weights)
            if tests:
                self.set_sigtests(tests)

    @property
    def spec(self) -> dict:
        return self.survey.meta.batches[self.name]

    # ------------------------------------------------------------------ lifecycle

    def clone(self, name: str, where=None, as_addition: bool = False) -> Batch:
        self.survey.meta.batches[name] = {**copy.deepcopy(self.spec), "name": name, "additions": [], "addition_to": None}
        made = Batch(self.survey, name)
        if where is not None:
            made.add_filter(*where) if isinstance(where, tuple) else made.add_filter(where)
        if as_addition:
            made.as_addition(self.name)
        return made

    def remove(self) -> None:
        del self.survey.meta.batches[self.name]
        for spec in self.survey.meta.batches.values():
            spec["additions"] = [a for a in spec["additions"] if a != self.name]

    def rename(self, new: str) -> None:
        if new in self.survey.meta.batches:
            raise ValueError(f"batch {new!r} is there already")
        batches = self.survey.meta.batches
        batches[new] = {**batches.pop(self.name), "name": new}
        for spec in batches.values():
            spec["additions"] = [new if a == self.name else a for a in spec["additions"]]
            spec["addition_to"] = new if spec["addition_to"] == self.name else spec["addition_to"]
        self.name = new

    def as_addition(self, main: str) -> None:
        """Becomes part of a main batch; open ends and y-on-y blocks don't go with it."""
        own = self.survey.meta.batches[main]["additions"]
        if self.name not in own:
            own.append(self.name)
        self.spec.update(addition_to=main, open_ends=[], y_on_y=[], y_on_y_filters={})

    def as_main(self, keep: bool = True) -> None:
        main = self.spec["addition_to"]
        if main is None:
            return
        self.spec["addition_to"] = None
        own = self.survey.meta.batches[main]["additions"]
        own.remove(self.name)
        if not keep:
            self.spec["additions"] = []

    # ------------------------------------------------------------------ variables

    def _known(self, names: Iterable[str]) -> None:
        parts = [p.strip() for n in names for p in n.split(">")]
        if unknown := [p for p in parts if p != "@" and p not in self.survey.meta]:
            raise MetaError(f"no variables {unknown}")

    def add_downbreak(self, names) -> None:
        """Variables down the side; a dict gives one a text of its own. Grids bring their items."""
        made, texts = [], {}
        for n in _listed(names):
            if isinstance(n, dict):
                ((n, text),) = n.items()
                texts[n] = text
            made.append(n)
        made = self.survey.meta.unroll(made, both="all")
        self._known(made)
        self.spec.update(x=made, texts={**self.spec["texts"], **texts})

    add_x = add_downbreak

    def extend_x(self, more) -> None:
        """Names go to the end; {x: names} go before x."""
        now = list(self.spec["x"])
        for m in _listed(more):
            for at, names in m.items() if isinstance(m, dict) else [(None, [m])]:
                made = [n for n in self.survey.meta.unroll(_listed(names), both="all") if n not in now]
                self._known(made)
                i = now.index(at) if at is not None else len(now)
                now[i:i] = made
        self.spec["x"] = now

    def add_crossbreak(self, names) -> None:
        """Variables across the head; the total comes first."""
        made = [n for n in self.survey.meta.unroll(_listed(names)) if n != "@"]
        self._known(made)
        self.spec["y"] = (["@"] if self.spec["total"] else []) + made

    add_y = add_crossbreak

    def extend_y(self, more, on=None) -> None:
        """Further heads, for all x or for some."""
        made = _listed(more)
        self._known(made)
        if on is None:
            self.spec["y"] += [n for n in made if n not in self.spec["y"]]
            return
        for x in self.survey.meta.unroll(_listed(on)):
            if x in self.spec["replaced_y"]:
                raise ValueError(f"{x!r} has heads of its own")
            own = self.spec["extended_y"].setdefault(x, [])
            own += [n for n in made if n not in own]

    def replace_y(self, new, on) -> None:
        made = [n for n in _listed(new) if n != "@"]
        self._known(made)
        for x in self.survey.meta.unroll(_listed(on)):
            self.spec["extended_y"].pop(x, None)
            self.spec["replaced_y"][x] = (["@"] if self.spec["total"] else []) + made

    def add_total(self, total: bool = True) -> None:
        self.spec["total"] = total
        self.add_crossbreak(self.spec["y"])

    def add_variables(self, names) -> None:
        self._known(_listed(names))
        self.spec["variables"] = list(dict.fromkeys([*self.spec["variables"], *_listed(names)]))

    def add_section(self, x: str, title: str) -> None:
        self.spec["sections"][x] = title

    def sections(self) -> dict[str, list[str]]:
        """Title -> the x that follow its start."""
        out: dict[str, list[str]] = {}
        title = None
        for x in self.spec["x"]:
            title = self.spec["sections"].get(x, title)
            if title is not None:
                out.setdefault(title, []).append(x)
        return out

    # -------------------------------------------------------------------- filters

    def add_filter(self, name: str, logic=None, overwrite: bool = False) -> None:
        if logic is not None:
            self.survey.add_filter_var(name, [logic], overwrite)
        elif not self.survey.is_filter(name):
            raise MetaError(f"no filter {name!r}")
        self.spec["filter"] = name
        self.spec["sample_size"] = None

    def remove_filter(self) -> None:
        self.spec.update(filter=None, x_filters={}, y_on_y_filters={})

    def extend_filter(self, more: dict) -> None:
        """{x: logic}: further conditions for some x."""
        for names, logic in more.items():
            for x in _listed(names):
                new = f"{self.spec['filter'] or self.name}_{x}"
                if self.spec["filter"]:
                    self.survey.extend_filter_var(self.spec["filter"], [logic], new)
                else:
                    self.survey.add_filter_var(new, [logic], overwrite=True)
                for v in [x, *self.survey.meta.sources(x)]:
                    self.spec["x_filters"][v] = new

    def add_y_on_y(self, name: str, y_filter=None, main: str = "extend") -> None:
        """Heads against heads. main: extend, replace or drop the batch's filter."""
        if main not in ("extend", "replace", "drop"):
            raise ValueError("main is extend, replace or drop")
        base = self.spec["filter"]
        if y_filter is None:
            made = base if main == "extend" else None
        elif base and main == "extend":
            made = self.survey.extend_filter_var(base, [y_filter], f"{base}_{name}".replace(" ", "_"))
        else:
            made = self.survey.add_filter_var(f"{self.name}_{name}".replace(" ", "_"), [y_filter], overwrite=True)
        if name not in self.spec["y_on_y"]:
            self.spec["y_on_y"].append(name)
        self.spec["y_on_y_filters"][name] = made

    def sample_size(self) -> int:
        self.spec["sample_size"] = n = self.survey.filtered(self.spec["filter"]).count()
        return n

    # -------------------------------------------------------------------- settings

    def set_weights(self, weights=None) -> None:
        made = [None if w in (None, "") else w for w in (_listed(weights) or [None])]
        self._known([w for w in made if w])
        self.spec["weights"] = made

    def set_cell_items(self, items) -> None:
        made = _listed(items)
        if bad := set(made) - {"c", "p", "cp"}:
            raise ValueError(f"no cell items: {sorted(bad)}")
        self.spec["cell_items"] = made

    def set_unwgt_counts(self, on: bool = False) -> None:
        self.spec["unweighted_counts"] = on

    def set_sigtests(self, levels=None, flags: list[int] | None = None, test_total: bool = False, mimic: str | None = None) -> None:
        if levels and self.spec["total"] is False and test_total:
            raise ValueError("there is no total to test against")
        self.spec["tests"] = {"levels": _listed(levels), "flags": flags or [30, 100], "test_total": test_total, "mimic": mimic or "dim"}

    def set_language(self, text_key: str) -> None:
        if text_key not in self.survey.meta.languages:
            raise MetaError(f"{text_key!r} is no known text key")
        self.spec["language"] = text_key

    def exclusive_arrays(self, grids) -> None:
        """Grids shown as summaries alone, without their items."""
        self.spec["summaries"] = list(dict.fromkeys([*self.spec["summaries"], *_listed(grids)]))

    def transpose(self, grids) -> None:
        """Grids shown the other way round as well."""
        self.spec["transposed"] = list(dict.fromkeys([*self.spec["transposed"], *_listed(grids)]))

    def level(self, grids, y=None) -> None:
        """Grids summed over their items as well."""
        for g in _listed(grids):
            if g not in self.survey.meta.grids:
                raise MetaError(f"{g!r} is no grid")
            self.spec["leveled"][g] = _listed(y) or list(self.spec["y"])

    def hide_empty(self, xs: bool = True, summaries: bool = True) -> list[str]:
        """Takes out x, and of grids the items, that nobody of the batch's filter answers. One pass."""
        columns = [n for x in self.spec["x"] for n in (self.survey.meta.sources(x) or [x])]
        gone = set(self.survey.empty(list(dict.fromkeys(columns)), self.spec["filter"]))
        if summaries:
            for g in [x for x in self.spec["x"] if x in self.survey.meta.grids]:
                items = [i for i in self.survey.meta.sources(g) if i in gone]
                if items:
                    self.edits(g).setdefault("rules", {}).setdefault("x", {})["dropx"] = {"values": items}
        if xs:
            whole = {g for g in self.survey.meta.grids if set(self.survey.meta.sources(g)) <= gone}
            self.spec["x"] = [x for x in self.spec["x"] if x not in gone and x not in whole]
        self.spec["hidden"] = sorted(gone)
        return sorted(gone)

    # ------------------------------------------------- edits that hold here alone

    def edits(self, name: str) -> dict:
        return self.spec["edits"].setdefault(name, {})

    def sorting(self, name: str, on="@", within: bool = False, between: bool = False, fix=None, ascending: bool = False, weight: str = "auto") -> None:
        self.edits(name).setdefault("rules", {}).setdefault("x", {})["sortx"] = {"sort_on": on, "within": within, "between": between, "fixed": _listed(fix), "ascending": ascending, "with_weight": weight}

    def slicing(self, name: str, codes: list[int], axis: str = "y") -> None:
        for a in _listed(axis):
            self.edits(name).setdefault("rules", {}).setdefault(a, {})["slicex"] = {"values": list(codes)}

    def hiding(self, name: str, codes: list, axis: str = "y") -> None:
        for a in _listed(axis):
            self.edits(name).setdefault("rules", {}).setdefault(a, {})["dropx"] = {"values": list(codes)}

    def min_value_count(self, name: str, least: int = 50, weight: str | None = None, axis: str = "y") -> list[int]:
        part = self.survey.clone()
        codes = part.min_value_count(name, least, weight, self.spec["filter"], axis)
        if codes:
            self.hiding(name, codes, axis)
        return codes

    def set_variable_text(self, name: str, text: str, text_key: str | None = None) -> None:
        self.edits(name).setdefault("text", {})[text_key or self.spec["language"]] = text

    def set_value_texts(self, name: str, texts: dict[int, str], text_key: str | None = None) -> None:
        self.edits(name).setdefault("values", {}).setdefault(text_key or self.spec["language"], {}).update({str(c): t for c, t in texts.items()})

    def set_property(self, name: str, prop: str, value) -> None:
        self.edits(name).setdefault("properties", {})[prop] = value

    def edited(self) -> Survey:
        """The survey with this batch's edits and language."""
        made = self.survey.clone()
        made.meta.text_key = self.spec["language"]
        for name, change in self.spec["edits"].items():
            own = made.meta[name]
            own.text.update(change.get("text", {}))
            own.properties.update(change.get("properties", {}))
            for key, texts in change.get("values", {}).items():
                made.meta.set_value_texts(name, {int(c): t for c, t in texts.items()}, key)
            for axis, rules in change.get("rules", {}).items():
                own.rules.setdefault(axis, {}).update(copy.deepcopy(rules))
        return made

    # ------------------------------------------------------------------- open ends

    def add_open_ends(self, oe, break_by=None, drop_empty: bool = True, incl_nan: bool = False, replacements: dict | None = None, split: bool = False, title="open ends", filter_by=None, overwrite: bool = True) -> None:
        oe, break_by, titles = _listed(oe), _listed(break_by), _listed(title)
        if self.spec["addition_to"]:
            raise ValueError("additions have no open ends")
        if both := [v for v in oe if v in break_by]:
            raise ValueError(f"{both} can't be both a text and what it is broken by")
        if not oe and not break_by:
            raise ValueError("which variables?")
        self._known([*oe, *break_by])
        if split and len(oe) != len(titles):
            raise ValueError("as many titles as texts, please")
        if replacements and all(isinstance(v, dict) for v in replacements.values()):
            replacements = replacements[self.spec["language"]]
        where = self.spec["filter"]
        if filter_by is not None:
            new = f"{where or self.name}_{titles[0]}".replace(" ", "_")
            where = self.survey.extend_filter_var(where, [filter_by], new) if where else self.survey.add_filter_var(new, [filter_by], overwrite=True)
        for t, own in zip(titles, [[o] for o in oe] if split else [oe], strict=False):
            if any(o["title"] == t for o in self.spec["open_ends"]):
                if not overwrite:
                    continue
                self.spec["open_ends"] = [o for o in self.spec["open_ends"] if o["title"] != t]
            self.spec["open_ends"].append({"title": t, "filter": where, "columns": own, "break_by": break_by, "incl_nan": incl_nan, "drop_empty": drop_empty, "replace": replacements})

    def open_ends(self, title: str) -> DataFrame:
        """The rows of one listing: what it is broken by, then the texts; codes as labels."""
        spec = next(o for o in self.spec["open_ends"] if o["title"] == title)
        rows = self.survey.filtered(spec["filter"])
        names = [*spec["break_by"], *spec["columns"]]
        if spec["drop_empty"] and spec["columns"]:
            filled = [self._text_column(n).isNotNull() & (F.trim(self._text_column(n)) != "") for n in spec["columns"]]
            some = filled[0]
            for f in filled[1:]:
                some = some | f
            rows = rows.filter(F.coalesce(some, F.lit(False)))
        made = []
        for n in names:
            column = self._text_column(n)
            for old, new in (spec["replace"] or {}).items():
                column = F.replace(column, F.lit(old), F.lit(new))
            made.append((F.coalesce(column, F.lit("__NaN__")) if spec["incl_nan"] else F.coalesce(column, F.lit(""))).alias(n))
        return rows.select(*made)

    def _text_column(self, name: str) -> Column:
        own, column = self.survey.meta[name], quoted(name)
        if own.type == STRING or not own.values:
            return column.cast("string")
        texts = self.survey.meta.value_texts(name, self.spec["language"])
        pairs = F.create_map(*[F.lit(v) for c, t in texts.items() for v in (c, t)])
        if own.type == "delimited set":
            return F.array_join(F.transform(column, lambda c: F.try_element_at(pairs, c)), ", ")
        return F.try_element_at(pairs, column)

    # ------------------------------------------------------------------------ maps

    def heads_of(self, x: str) -> list[str]:
        spec = self.spec
        return list(dict.fromkeys(spec["replaced_y"].get(x) or [*spec["y"], *spec["extended_y"].get(x, [])]))

    def x_y_map(self) -> list[tuple[str, list[str]]]:
        """Each x with its heads, in order; grids against the total alone, their items as the batch lists them."""
        spec, meta, out = self.spec, self.survey.meta, []
        hidden = lambda g: set(spec["edits"].get(g, {}).get("rules", {}).get("x", {}).get("dropx", {}).get("values", []))
        for x in spec["x"]:
            if x in meta.grids:
                out.append((x, ["@"]))
                if x in spec["leveled"]:
                    out.append((f"{x}_level", spec["leveled"][x]))
                if x not in spec["summaries"]:
                    out += [(i, self.heads_of(i)) for i in meta.sources(x) if i in spec["x"] and i not in hidden(x)]
                if x in spec["transposed"]:
                    out.append(("@", [x]))
            elif not (meta.is_item(x) and meta.parents(x)[0] in spec["x"]):
                out.append((x, self.heads_of(x)))
        return out

    def filter_of(self, x: str) -> str | None:
        return self.spec["x_filters"].get(x, self.spec["filter"])

    def codes_in_data(self, name: str) -> DataFrame:
        return self.survey.codes_in_data(name, self.spec["filter"])

    def to_dataset(self, from_set: str = "data file", additions: bool = True, misc: Iterable[str] = (), edits: bool = True) -> Survey:
        """The batch's respondents and variables, in the set's order; edits applied if asked for."""
        made = self.edited() if edits else self.survey.clone()
        specs = [self.spec, *(self.survey.meta.batches[a] for a in self.spec["additions"] if additions)]
        wanted = [*misc]
        for spec in specs:
            wanted += [*spec["x"], *spec["y"], *(y for ys in [*spec["extended_y"].values(), *spec["replaced_y"].values()] for y in ys), *spec["variables"], *(w for w in spec["weights"] if w)]
            wanted += [v for o in spec["open_ends"] for v in [*o["columns"], *o["break_by"]]]
        names = {p.strip() for n in wanted for p in n.split(">") if p.strip() != "@"}
        names = set(self.survey.meta.roll_up(sorted(names)))
        ordered = [n for n in self.survey.meta.sets[from_set] if n in names]
        made.df = made.filtered(self.spec["filter"])
        return made.subset([*ordered, *sorted(names - set(ordered))])


def get_batch(survey: Survey, name: str) -> Batch:
    if name not in survey.meta.batches:
        raise KeyError(f"no batch {name!r}")
    return Batch(survey, name)


def batches(survey: Survey, main: bool = True, additions: bool = True) -> list[str]:
    return [n for n, s in survey.meta.batches.items() if (additions if s["addition_to"] else main)]
