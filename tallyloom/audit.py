"""Several surveys side by side: what differs in variables, types, labels, codes and items, and how to bring them together."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from difflib import SequenceMatcher

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meta import SPARK_TYPES, Grid, Variable, pick_text
from .plans.tabulate import quoted
from .sources.documents import save_parquet
from .survey import Survey


def alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


class Audit:
    def __init__(self, surveys: dict[str, Survey] | Iterable[Survey]):
        self.surveys = dict(surveys) if isinstance(surveys, dict) else {s.name: s for s in surveys}
        if len(self.surveys) < 2:
            raise ValueError("an audit needs two surveys at least")

    # ------------------------------------------------------------------ inventory

    def _names(self, survey: Survey) -> list[str]:
        return [n for n in [*survey.meta.grids, *survey.meta.columns] if not survey.meta.is_item(n)]

    @property
    def all_names(self) -> list[str]:
        return list(dict.fromkeys(n for s in self.surveys.values() for n in self._names(s)))

    def shared(self) -> list[str]:
        return [n for n in self.all_names if sum(n in s.meta for s in self.surveys.values()) > 1]

    def _picked(self, which) -> dict[str, Survey]:
        return self.surveys if which == "all" else {k: self.surveys[k] for k in ([which] if isinstance(which, str) else which)}

    def validate_all(self, spss_limits: bool = False) -> dict[str, DataFrame]:
        return {k: s.validate(spss_limits) for k, s in self.surveys.items()}

    # ------------------------------------------------------------------ differences

    def mismatches(self) -> list[dict]:
        """Variables that some surveys lack, with names that come near there: the same in another case, or one inside the other."""
        out = []
        for n in self.all_names:
            lacking = [k for k, s in self.surveys.items() if n not in s.meta]
            if not lacking:
                continue
            hints = {}
            for k in lacking:
                names = self._names(self.surveys[k])
                hints[k] = [x for x in names if x.lower() == n.lower()] or [x for x in names if x.lower() in n.lower() or n.lower() in x.lower()]
            out.append({"name": n, "missing_in": lacking, "hints": {k: h for k, h in hints.items() if h}})
        return out

    def _each_shared(self, tell) -> list[dict]:
        """Rows for shared variables whose ``tell`` differs between surveys."""
        out = []
        for n in self.shared():
            found = {k: tell(s, n) for k, s in self.surveys.items() if n in s.meta}
            if len({repr(v) for v in found.values()}) > 1:
                out.append({"name": n, **found})
        return out

    def report_type_diffs(self) -> list[dict]:
        return self._each_shared(lambda s, n: f"array {s.meta[n].type}" if n in s.meta.grids else s.meta[n].type)

    def report_cat_diffs(self) -> list[dict]:
        return self._each_shared(lambda s, n: [v.code for v in s.meta[n].values] if s.meta[n].values is not None else None)

    def report_item_diffs(self) -> list[dict]:
        return self._each_shared(lambda s, n: s.meta.sources(n))

    def _text_diffs(self, texts_of, strict: float) -> list[dict]:
        """texts_of(survey, name, text key) -> {part: text}; rows for parts less alike than ``strict``."""
        out = []
        for n in self.shared():
            own = {k: s for k, s in self.surveys.items() if n in s.meta}
            keys = {t for s in own.values() for t in s.meta.used_text_keys()}
            for key in sorted(keys):
                found = {k: texts_of(s, n, key) for k, s in own.items()}
                for part in dict.fromkeys(p for t in found.values() for p in t):
                    said = {k: t[part] for k, t in found.items() if t.get(part)}
                    values = list(said.values())
                    if len(values) > 1 and any(alike(values[0], v) < strict for v in values[1:]):
                        out.append({"name": n, "text_key": key, "part": part, **said})
        return out

    def report_label_diffs(self, strict: float = 0.95) -> list[dict]:
        return self._text_diffs(lambda s, n, key: {"label": s.meta[n].text.get(key, "")}, strict)

    def report_cat_text_diffs(self, strict: float = 0.9) -> list[dict]:
        return self._text_diffs(lambda s, n, key: {v.code: v.text.get(key, "") for v in s.meta[n].values or ()}, strict)

    def report_item_text_diffs(self, strict: float = 0.9) -> list[dict]:
        return self._text_diffs(lambda s, n, key: {i: s.meta.columns[i].text.get(key, "") for i in s.meta.sources(n)}, strict)

    # ------------------------------------------------------------------ alignment

    def rename_by(self, name: str, which="all", ignore: Iterable[str] = ()) -> dict[str, dict[str, str]]:
        """Names that differ from the master's in case only become the master's."""
        master = {n.lower(): n for n in self._names(self.surveys[name])}
        done = {}
        for k, s in self._picked(which).items():
            if k == name:
                continue
            mapper = {n: master[n.lower()] for n in self._names(s) if n.lower() in master and n != master[n.lower()] and n not in set(ignore) and master[n.lower()] not in s.meta}
            if mapper:
                s.rename_all(mapper)
            done[k] = mapper
        return done

    def rename_from_mapper(self, mapper: dict[str, str], which="all") -> None:
        for s in self._picked(which).values():
            if own := {a: b for a, b in mapper.items() if a in s.meta}:
                s.rename_all(own)

    def relabel_by(self, variables: list[str] | str, text_key: str, name: str, which="all") -> None:
        """Labels of the master, in one language; ``text_key`` may be ``"x edits"`` or ``"y edits"``."""
        master = self.surveys[name].meta
        for k, s in self._picked(which).items():
            for v in [variables] if isinstance(variables, str) else variables:
                if k == name or v not in s.meta or v not in master:
                    continue
                if text_key.endswith("edits"):
                    axis = text_key.split()[0]
                    s.meta[v].edits[axis] = dict(master[v].edits.get(axis, {}))
                else:
                    s.meta[v].text[text_key] = pick_text(master[v].text, text_key)

    def align_cats_by(self, variables: list[str] | str, text_key: str, name: str, which="all", overwrite: bool = False, extend: bool = False, reorder: bool = False) -> None:
        """Code lists after the master's: its labels, its further codes, its order. The data stay as they are."""
        master = self.surveys[name].meta
        for k, s in self._picked(which).items():
            for v in [variables] if isinstance(variables, str) else variables:
                if k == name or v not in s.meta or v not in master:
                    continue
                theirs = {x.code: x for x in master.values(v)}
                mine = s.meta.values(v)
                if overwrite:
                    for x in mine:
                        if x.code in theirs and theirs[x.code].text.get(text_key):
                            x.text[text_key] = theirs[x.code].text[text_key]
                if extend:
                    known = {x.code for x in mine}
                    mine += [copy.deepcopy(x) for c, x in theirs.items() if c not in known]
                if reorder:
                    place = {c: i for i, c in enumerate(theirs)}
                    mine.sort(key=lambda x: place.get(x.code, len(place)))

    def remove_mismatches(self, which="all", ignore: Iterable[str] = ()) -> list[str]:
        gone = [m["name"] for m in self.mismatches() if m["name"] not in set(ignore)]
        for s in self._picked(which).values():
            s.drop([n for n in gone if n in s.meta])
        return gone

    def fill_mismatches_by(self, name: str | list[str] = "all", which="all", ignore: Iterable[str] = ()) -> None:
        """Variables that a survey lacks, as the masters have them, without data."""
        masters = self._picked(name)
        for k, s in self._picked(which).items():
            for m, master in masters.items():
                if m == k:
                    continue
                for n in self._names(master):
                    if n in s.meta or n in set(ignore):
                        continue
                    own: Variable = copy.deepcopy(master.meta[n])
                    columns = master.meta.sources(n) or [n]
                    if isinstance(own, Grid):
                        s.meta.grids[n] = own
                    for c in columns:
                        made = copy.deepcopy(master.meta.columns[c])
                        if isinstance(own, Grid):
                            made.values = own.values
                        s.meta.columns[c] = made
                    s.meta.sets["data file"].append(n)
                    s.df = s.df.select(*[quoted(c) for c in s.df.columns], *[F.lit(None).cast(SPARK_TYPES[s.meta.columns[c].type]).alias(c) for c in columns if c not in s.df.columns])

    def save(self, path: str, which="all", suffix: str = "_audit") -> None:
        for k, s in self._picked(which).items():
            save_parquet(s, f"{path}/{k}{suffix}")
