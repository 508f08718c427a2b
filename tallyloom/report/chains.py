"""Chains: results put together as tables for readers, and managers of many of them.

A chain is a long frame (section, row and column places, codes, texts, value or
test text) over a stack's results; laying it out wide and painting it with labels
happens at the edge.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import Meta
from ..plans import rules as display
from ..plans.sigtests import letter
from ..plans.tabulate import ALL, TOTAL
from .batch import _listed
from .stack import NO_FILTER, Stack
from .views import View, row_kind

FRAME = "view_pos int, view string, x_var string, x_code string, x_pos int, y_var string, y_code string, y_pos int, y_var_pos int, weight string, value double, text string"


class Chain:
    """Some views of one x against several y (or of several x against one)."""

    def __init__(self, name: str, frame: DataFrame, meta: Meta | None = None, kind: str = "table"):
        self.name, self.frame, self.meta, self.kind = name, frame, meta, kind
        self.hidden = False
        self.annotations: dict[str, dict[str, str]] = {}
        self.painted: dict[str, str] | None = None
        self.test_letters: dict[tuple[str, str], str] | None = None

    # ------------------------------------------------------------------- contents

    @classmethod
    def of(cls, stack: Stack, key: str, where: str, x_keys, y_keys, views: list, rules: bool = False, rules_weight: str | None = None, name: str | None = None) -> Chain:
        """views: keys in the order of their rows; lists of keys share rows."""
        keys = [k for own in views for k in _listed(own)]
        x_keys, y_keys = _listed(x_keys), _listed(y_keys)
        rows = stack.results.filter((F.col("dataset") == key) & (F.col("filter") == where) & F.col("x_var").isin(x_keys) & F.col("y_var").isin(y_keys) & F.col("view").isin(keys))
        place = lambda names, column: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column)).cast("int")
        rows = rows.select(place(keys, "view").alias("view_pos"), "view", "x_var", "x_code", "x_pos", "y_var", "y_code", "y_pos", place(y_keys, "y_var").alias("y_var_pos"), "weight", "value", "text")
        # heads other than the total bring a total of their own; it is shown once
        if len(y_keys) > 1:
            rows = rows.filter((F.col("y_code") != TOTAL) | (F.col("y_var") == y_keys[0]))
        survey = stack.surveys[key]
        if rules:
            for x in x_keys:
                if x not in survey.meta or survey.meta[x].values is None:
                    continue
                order = stack.get_rules_slicer(key, where, x, rules_weight) if survey.meta[x].rules.get("x") else None
                if order is not None:
                    viable = [k for k in keys if "x" in display.viable_axes(k) and not View(k).is_base]
                    at = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("x_code")).cast("int")
                    touched = (F.col("x_var") == x) & F.col("view").isin(viable) & F.col("x_code").rlike("^-?[0-9]+$")
                    rows = rows.filter(~touched | (at > 0)).withColumn("x_pos", F.when(touched, at).otherwise(F.col("x_pos")))
            for y in y_keys:
                own = survey.meta[y].rules.get("y", {}) if y in survey.meta else {}
                hidden = [str(c) for c in own.get("dropx", {}).get("values", [])]
                shown = [str(c) for c in own.get("slicex", {}).get("values", [])]
                mine = (F.col("y_var") == y) & (F.col("y_code") != TOTAL)
                if shown:
                    at = F.array_position(F.array(*[F.lit(c) for c in shown]), F.col("y_code")).cast("int")
                    rows = rows.filter(~mine | (at > 0)).withColumn("y_pos", F.when(mine, at).otherwise(F.col("y_pos")))
                if hidden:
                    rows = rows.filter(~mine | ~F.col("y_code").isin(hidden))
                    kept = F.array_join(F.array_except(F.split("text", ","), F.array(*[F.lit(c) for c in hidden])), ",")
                    rows = rows.withColumn("text", F.when(mine & F.col("text").isNotNull(), F.nullif(kept, F.lit(""))).otherwise(F.col("text")))
        return cls(name or "_".join(x_keys), rows, survey.meta)

    @classmethod
    def from_rows(cls, spark: SparkSession, name: str, table: list[dict], meta: Meta | None = None) -> Chain:
        """A free table: rows with x_code and a value for each column."""
        columns = list(dict.fromkeys(c for r in table for c in r if c != "x_code"))
        rows = [(1, "x|own|:|||own", name, str(r["x_code"]), i, TOTAL, c, j, 1, "", None if r.get(c) is None else float(r[c]), None) for i, r in enumerate(table, 1) for j, c in enumerate(columns, 1)]
        return cls(name, spark.createDataFrame(rows, FRAME), meta, "free")

    def _new(self, frame: DataFrame, name: str | None = None) -> Chain:
        made = copy.copy(self)
        made.frame, made.name, made.annotations = frame, name or self.name, copy.deepcopy(self.annotations)
        return made

    def clone(self) -> Chain:
        return self._new(self.frame)

    copy = clone

    @property
    def views(self) -> list[str]:
        return [r.view for r in self.frame.select("view", "view_pos").distinct().orderBy("view_pos").collect()]

    def describe(self) -> DataFrame:
        """Each row's kind: base, counts, net, calc, statistic, test..."""
        rows = self.frame.select("view_pos", "view", "x_var", "x_pos", "x_code").distinct().orderBy("view_pos", "x_pos").collect()

        def kind(r) -> str:
            v = View(r.view)
            if v.is_base or v.is_sum or v.is_stat:
                return "base" if v.is_base else "sum" if v.is_sum else "stat"
            return "test" if v.method.startswith("t.") else f"{row_kind(r.x_code)} {'pct' if v.is_pct else 'counts'}"

        made = [(r.x_var, r.x_code, r.view, kind(r)) for r in rows]
        return self.frame.sparkSession.createDataFrame(made, "x_var string, x_code string, view string, kind string")

    def view_sizes(self) -> dict[str, tuple[int, int]]:
        rows = self.frame.groupBy("view").agg(F.countDistinct("x_var", "x_code").alias("r"), F.countDistinct("y_var", "y_code").alias("c")).collect()
        return {r.view: (r.r, r.c) for r in rows}

    def view_lengths(self) -> dict[str, int]:
        return {v: r for v, (r, _) in self.view_sizes().items()}

    # ---------------------------------------------------------------------- labels

    def paint(self, text_key: str | None = None, transform_tests: bool = True, axes: Iterable[str] = ("x", "y")) -> Chain:
        """Adds labels (x_label, y_label, x_title, y_title) and turns tested columns into letters."""
        axes = list(axes)
        meta = self.meta
        if meta is None:
            return self
        rows = []
        for n in [*meta.columns, *meta.grids]:
            own = meta[n]
            if own.values is not None:
                rows += [(n, str(c), t) for c, t in meta.value_texts(n, text_key).items()]
            rows += [(n, str(p["name"]) and f"net:{p['name']}", p["text"]) for p in own.properties.get("nets", ())]
            rows += [(n, i, t) for i, t in meta.item_texts(n, text_key).items()]
        labels = self.frame.sparkSession.createDataFrame(rows or [("", "", "")], "var string, code string, label string")
        titles = self.frame.sparkSession.createDataFrame([(n, meta.text(n, text_key)) for n in [*meta.columns, *meta.grids]], "var string, title string")
        made = self.frame
        view_text = {k: View(k).text() for k in self.views}
        texts = F.create_map(*[F.lit(v) for k, t in view_text.items() for v in (k, t)])
        # as many labels as codes
        for a in "xy":
            own = labels.select(F.col("var").alias(f"{a}_var"), F.col("code").alias(f"{a}_code"), F.col("label").alias("__l"))
            head = titles.select(F.col("var").alias(f"{a}_var"), F.col("title").alias("__t"))
            made = made.join(F.broadcast(own), [f"{a}_var", f"{a}_code"], "left").join(F.broadcast(head), f"{a}_var", "left")
            plain = F.regexp_replace(f"{a}_code", "^(net|calc):", "")
            if a == "x":
                plain = F.coalesce(F.nullif(F.try_element_at(texts, F.col("view")), F.lit("")), plain)
            else:
                plain = F.when(F.col("y_code") == TOTAL, F.lit("Total")).otherwise(plain)
            on = a in axes
            made = made.withColumns({f"{a}_label": F.coalesce("__l", plain) if on else F.col(f"{a}_code"), f"{a}_title": F.coalesce("__t", F.col(f"{a}_var")) if on else F.col(f"{a}_var")}).drop("__l", "__t")
        out = self._new(made)
        out.painted = {"text_key": text_key or meta.text_key}
        return out.transform_tests() if transform_tests else out

    def toggle_labels(self) -> Chain:
        """Labels where there are codes, codes where there are labels."""
        if self.painted is None:
            return self.paint()
        made = self._new(self.frame.drop("x_label", "y_label", "x_title", "y_title"))
        made.painted = None
        return made

    def column_letters(self, upper: bool = True) -> dict[tuple[str, str], str]:
        heads = self.frame.filter(F.col("y_code") != TOTAL).select("y_var_pos", "y_var", "y_pos", "y_code").distinct().orderBy("y_var_pos", "y_pos").collect()
        return {(r.y_var, r.y_code): letter(i, upper) for i, r in enumerate(heads)}

    def transform_tests(self, upper: bool = True, display_level: bool = False) -> Chain:
        """Codes in test results as column letters; of two levels the stricter in capitals, the other small."""
        tests = [v for v in self.views if v.split("|")[1].startswith("t.")]
        if not tests:
            return self
        levels = sorted({View(v).level for v in tests})
        made = self.frame
        names = self.column_letters(upper)
        pairs = F.create_map(*[F.lit(v) for (y, c), n in names.items() for v in (f"{y}\0{c}", n)]) if names else None
        if pairs is None:
            return self
        each = F.transform(F.split("text", ","), lambda c: F.coalesce(F.try_element_at(pairs, F.concat("y_var", F.lit("\0"), c)), c))
        said = F.array_join(each, ".")
        for v in tests:
            own = said if len(levels) < 2 or View(v).level == levels[0] else F.lower(said)
            if display_level:
                own = F.concat(own, F.lit(f" [{View(v).level:g}]"))
            made = made.withColumn("text", F.when(F.col("view") == v, own).otherwise(F.col("text")))
        out = self._new(made)
        out.test_letters = names
        return out

    # ---------------------------------------------------------------------- layout

    def concat(self, order: Iterable[str] = ("view_pos", "x_pos")) -> DataFrame:
        """Views down, heads across: one column for each (y, code)."""
        heads = self.frame.select("y_var_pos", "y_var", "y_pos", "y_code").distinct().orderBy("y_var_pos", "y_pos").collect()
        names = [f"{r.y_var}:{r.y_code}" for r in heads]
        label = [c for c in ("x_title", "x_label") if c in self.frame.columns]
        cell = F.coalesce(F.col("text"), F.col("value").cast("string"))
        named = self.frame.withColumn("head", F.concat_ws(":", "y_var", "y_code"))
        rows = named.groupBy("view_pos", "view", "x_var", "x_pos", "x_code", *label).pivot("head", names)
        return rows.agg(F.first(cell)).orderBy(*order)

    def export(self):
        """The wide table as a pandas frame, for edits by hand."""
        return self.concat().toPandas()

    def assign(self, edited) -> Chain:
        """The chain with the values of an edited export."""
        heads = [c for c in edited.columns if ":" in c]
        rows = []
        for _, r in edited.iterrows():
            for i, h in enumerate(heads, 1):
                y, _, code = h.rpartition(":")
                v = r[h]
                number = _number(v)
                rows.append((int(r["view_pos"]), r["view"], r["x_var"], r["x_code"], int(r["x_pos"]), y, code, i, 1, "", number, None if number is not None or v is None else str(v)))
        return self._new(self.frame.sparkSession.createDataFrame(rows, FRAME))

    def cut(self, rows: Iterable[str], ci: str | None = None, base: bool = False, tests: bool = False) -> Chain:
        """Some rows: x codes, names of nets or statistics. ci: counts or pct alone."""
        wanted = [str(r) for r in rows]
        keep = F.col("x_code").isin(wanted + [f"net:{r}" for r in wanted])
        views = [View(k) for k in self.views]
        shown = [v.key for v in views if v.is_stat or (v.is_counts and ci != "pct") or (v.is_pct and ci != "counts") or (tests and v.method.startswith("t."))]
        bases = [v.key for v in views if v.is_base] if base else []
        return self._new(self.frame.filter((keep & F.col("view").isin(shown)) | F.col("view").isin(bases)))

    def sorted(self, on: str = TOTAL, ascending: bool = False, view: str | None = None) -> Chain:
        """Rows of codes by one column's values; bases and sums stay."""
        view = view or next((v for v in self.views if View(v).is_pct or View(v).is_counts), None)
        key = self.frame.filter((F.col("view") == view) & (F.col("y_code") == on)).select("x_code", F.col("value").alias("k"))
        ranked = key.orderBy(F.col("k").asc() if ascending else F.col("k").desc(), "x_code").collect()
        order = F.array(*[F.lit(r.x_code) for r in ranked])
        at = F.array_position(order, F.col("x_code")).cast("int")
        return self._new(self.frame.withColumn("x_pos", F.when(at > 0, at).otherwise(F.col("x_pos")))) if ranked else self

    # --------------------------------------------------------------------- the rest

    def annotate(self, text: str, category: str = "header", position: str = "title") -> None:
        """category: header, footer or notes; position: title, left, center, right."""
        if category not in ("header", "footer", "notes") or position not in ("title", "left", "center", "right"):
            raise ValueError(f"no place for notes: {category}, {position}")
        self.annotations.setdefault(category, {})[position] = text

    def save(self, path: str) -> None:
        self.frame.write.mode("overwrite").parquet(f"{path}/frame")
        made = {"name": self.name, "kind": self.kind, "annotations": self.annotations, "meta": self.meta.to_dict() if self.meta else None}
        self.frame.sparkSession.createDataFrame([(json.dumps(made, ensure_ascii=False),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/chain")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Chain:
        made = json.loads(spark.read.text(f"{path}/chain", wholetext=True).first()[0])
        out = cls(made["name"], spark.read.parquet(f"{path}/frame"), Meta.from_dict(made["meta"]) if made["meta"] else None, made["kind"])
        out.annotations = made["annotations"]
        return out


def _number(v) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


class ChainManager:
    """Chains in order, alone or in folders."""

    def __init__(self, stack: Stack | None = None):
        self.stack = stack
        self.items: list[Chain | tuple[str, list[Chain]]] = []

    # ---------------------------------------------------------------------- access

    @property
    def chains(self) -> list[Chain]:
        return [c for i in self.items for c in (i[1] if isinstance(i, tuple) else [i])]

    @property
    def folders(self) -> dict[str, list[Chain]]:
        return dict(i for i in self.items if isinstance(i, tuple))

    def names(self, show_hidden: bool = False) -> list[str]:
        return [c.name for c in self.chains if show_hidden or not c.hidden]

    def __len__(self) -> int:
        return len(self.items)

    def __iter__(self):
        return iter(self.chains)

    def __getitem__(self, name: str | int) -> Chain | list[Chain]:
        if isinstance(name, int):
            made = self.items[name]
            return made[1] if isinstance(made, tuple) else made
        if name in self.folders:
            return self.folders[name]
        for c in self.chains:
            if c.name == name:
                return c
        raise KeyError(f"no chain {name!r}")

    # ----------------------------------------------------------------------- making

    def get(self, key: str, where: str = NO_FILTER, x_keys=(), y_keys=(TOTAL,), views: list = (), orient: str = "x", rules: bool = True, rules_weight: str | None = None, folder: str | None = None) -> ChainManager:
        """A chain for each x (orient x) or for each y."""
        made = []
        for own in _listed(x_keys) if orient == "x" else _listed(y_keys):
            xs, ys = (own, y_keys) if orient == "x" else (x_keys, own)
            made.append(Chain.of(self.stack, key, where, xs, ys, list(views), rules, rules_weight, own))
        if folder:
            self.items.append((folder, made))
        else:
            self.items += made
        return self

    def add(self, table: list[dict], name: str, meta: Meta | None = None) -> None:
        self.items.append(Chain.from_rows(self.stack.spark, name, table, meta))

    def paint_all(self, *args, **more) -> None:
        self._each(lambda c: c.paint(*args, **more))

    def _each(self, change, names: Iterable[str] | None = None) -> None:
        wanted = None if names is None else set(_listed(names))
        to = lambda c: change(c) if wanted is None or c.name in wanted else c
        self.items = [(i[0], list(map(to, i[1]))) if isinstance(i, tuple) else to(i) for i in self.items]

    def cut(self, rows, ci: str | None = None, base: bool = False, tests: bool = False) -> ChainManager:
        self._each(lambda c: c.cut(_listed(rows), ci, base, tests))
        return self

    def join(self, title: str = "Summary") -> ChainManager:
        """All chains as one: their rows one below the other, of the columns that all have."""
        shared = set.intersection(*[{(r.y_var, r.y_code) for r in c.frame.select("y_var", "y_code").distinct().collect()} for c in self.chains])
        ok = reduce(lambda a, b: a | b, [(F.col("y_var") == y) & (F.col("y_code") == c) for y, c in sorted(shared)], F.lit(False))
        parts = [c.frame.filter(ok).withColumn("view_pos", F.col("view_pos") + 1000 * i) for i, c in enumerate(self.chains)]
        frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        self.items = [Chain(title, frame, self.chains[0].meta, "summary")]
        return self

    # --------------------------------------------------------------------- ordering

    def fold(self, folder: str | None = None, chains=None) -> ChainManager:
        """Some chains in a folder; without names each in its own."""
        if folder is None:
            self.items = [i if isinstance(i, tuple) else (i.name, [i]) for i in self.items]
            return self
        wanted = self.names(True) if chains is None else _listed(chains)
        moved = [c for c in self.chains if c.name in wanted]
        at = min((n for n, i in enumerate(self.items) if any(c in moved for c in (i[1] if isinstance(i, tuple) else [i]))), default=len(self.items))
        self._remove(moved)
        self.items.insert(min(at, len(self.items)), (folder, moved))
        return self

    def unfold(self, folder=None) -> ChainManager:
        wanted = None if folder is None else set(_listed(folder))
        self.items = [x for i in self.items for x in (i[1] if isinstance(i, tuple) and (wanted is None or i[0] in wanted) else [i])]
        return self

    def merge(self, folders, new_name: str | None = None, drop: bool = True) -> ChainManager:
        """Folders as one, chain by chain: the first chains of each become one table, and so on."""
        names = _listed(folders)
        lists = [self.folders[f] for f in names]
        made = []
        for group in zip(*lists, strict=True):
            frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.frame.withColumn("view_pos", F.col("view_pos") + 1000 * i) for i, c in enumerate(group)])
            made.append(group[0]._new(frame))
        at = next(n for n, i in enumerate(self.items) if isinstance(i, tuple) and i[0] == names[0])
        if drop:
            self.items = [i for i in self.items if not (isinstance(i, tuple) and i[0] in names)]
        self.items.insert(min(at, len(self.items)), (new_name or names[0], made))
        return self

    def insert(self, other: ChainManager, index: int = -1, safe_names: bool = False) -> ChainManager:
        made = [(i[0], list(i[1])) if isinstance(i, tuple) else i.clone() for i in other.items]
        if safe_names:
            taken = set(self.names(True))
            for c in made:
                if isinstance(c, Chain) and c.name in taken:
                    c.name += "_1"
        at = len(self.items) if index == -1 else index
        self.items[at:at] = made
        return self

    def reorder(self, order: list, folder: str | None = None) -> ChainManager:
        """Names or places, in the new order; what isn't named goes."""
        named = {(i[0] if isinstance(i, tuple) else i.name): i for i in self.items}
        if folder is not None:
            own = {c.name: c for c in self.folders[folder]}
            made = [own[o] if isinstance(o, str) else self.folders[folder][o] for o in order]
            self.items = [(folder, made) if isinstance(i, tuple) and i[0] == folder else i for i in self.items]
            return self
        self.items = [named[o] if isinstance(o, str) else self.items[o] for o in order]
        return self

    def rename(self, names: dict[str, str], folder: str | None = None) -> ChainManager:
        for c in self.folders[folder] if folder else self.chains:
            c.name = names.get(c.name, c.name)
        self.items = [(names.get(i[0], i[0]), i[1]) if isinstance(i, tuple) and folder is None else i for i in self.items]
        return self

    def _remove(self, gone: list[Chain]) -> None:
        made = []
        for i in self.items:
            if isinstance(i, tuple):
                if rest := [c for c in i[1] if not any(c is g for g in gone)]:
                    made.append((i[0], rest))
            elif not any(i is g for g in gone):
                made.append(i)
        self.items = made

    def remove(self, names, folder: str | None = None) -> ChainManager:
        self._remove([c for c in (self.folders[folder] if folder else self.chains) if c.name in _listed(names)])
        return self

    def hide(self, names) -> None:
        for c in self.chains:
            if c.name in _listed(names):
                c.hidden = True

    def unhide(self, names=None) -> None:
        for c in self.chains:
            if names is None or c.name in _listed(names):
                c.hidden = False

    # -------------------------------------------------------------------- inspection

    def describe(self, by_folder: bool = False, show_hidden: bool = False) -> list[dict]:
        out = []
        for n, i in enumerate(self.items):
            for c in i[1] if isinstance(i, tuple) else [i]:
                if show_hidden or not c.hidden:
                    out.append({"item": n, "folder": i[0] if isinstance(i, tuple) else None, "chain": c.name, "kind": c.kind, "views": len(c.views)})
        return sorted(out, key=lambda r: str(r["folder"])) if by_folder else out

    def compare(self, other: ChainManager, strict: bool = True) -> list[tuple[str, str]]:
        """(chain, what differs)."""
        found = []
        if self.names(True) != other.names(True):
            found.append(("", f"chains {self.names(True)} / {other.names(True)}"))
        mine = {c.name: c for c in self.chains}
        for c in other.chains:
            if c.name not in mine:
                continue
            keys = [k for k in ("view", "x_var", "x_code", "y_var", "y_code", "value", "text")]
            a, b = (x.frame.select(*keys).withColumn("value", F.round("value", 12 if strict else 6)) for x in (mine[c.name], c))
            if a.exceptAll(b).head(1) or b.exceptAll(a).head(1):
                found.append((c.name, "cells"))
        return found

    def equals(self, other: ChainManager) -> bool:
        return not self.compare(other)

    def clone(self) -> ChainManager:
        made = ChainManager(self.stack)
        made.items = [(i[0], [c.clone() for c in i[1]]) if isinstance(i, tuple) else i.clone() for i in self.items]
        return made

    # ------------------------------------------------------------------------ storage

    def save(self, path: str, keep_stack: bool = False) -> None:
        shape = [[i[0], [c.name for c in i[1]]] if isinstance(i, tuple) else i.name for i in self.items]
        for n, c in enumerate(self.chains):
            c.save(f"{path}/{n}")
        made = json.dumps({"shape": shape, "hidden": [c.name for c in self.chains if c.hidden]})
        spark = self.stack.spark if self.stack else self.chains[0].frame.sparkSession
        spark.createDataFrame([(made,)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/manager")
        if keep_stack and self.stack:
            self.stack.save(f"{path}/kept_stack")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stack: Stack | None = None) -> ChainManager:
        made = json.loads(spark.read.text(f"{path}/manager", wholetext=True).first()[0])
        out, n = cls(stack), 0
        for i in made["shape"]:
            if isinstance(i, list):
                out.items.append((i[0], [Chain.load(spark, f"{path}/{n + k}") for k in range(len(i[1]))]))
                n += len(i[1])
            else:
                out.items.append(Chain.load(spark, f"{path}/{n}"))
                n += 1
        out.hide(made["hidden"])
        return out

    @classmethod
    def from_cluster(cls, cluster: Cluster) -> ChainManager:
        made = cls(None)
        made.items = list(cluster.chains.values())
        return made

    @classmethod
    def from_tab_book(cls, spark: SparkSession, book: dict, cell_items: str = "c") -> ChainManager:
        """Tables of another tool as chains: {"tables": [{"name", "columns", "base", "rows": [{"label", "counts"}]}]}; p: cell / base * 100."""
        made = cls(None)
        for t in book["tables"]:
            rows = [{"x_code": ALL, **dict(zip(t["columns"], t["base"], strict=True))}]
            for r in t["rows"]:
                cells = [100 * c / b if b else None for c, b in zip(r["counts"], t["base"], strict=True)] if cell_items == "p" else r["counts"]
                rows.append({"x_code": r["label"], **dict(zip(t["columns"], cells, strict=True))})
            made.items.append(Chain.from_rows(spark, t["name"], rows))
        return made


class Cluster:
    """Chains by name, and rows of several under one title."""

    def __init__(self, name: str = ""):
        self.name = name
        self.chains: dict[str, Chain] = {}

    def add_chain(self, chains) -> None:
        for c in chains if isinstance(chains, list) else [chains]:
            self.chains[c.name] = c

    def bank_chains(self, title: str, parts: list[tuple[Chain, str, str]]) -> Chain:
        """parts: (chain, view, label): that view's row of each chain, labelled, in one table."""
        frames = []
        for i, (chain, view, label) in enumerate(parts, 1):
            rows = chain.frame.filter(F.col("view") == view)
            frames.append(rows.withColumns({"x_code": F.lit(label), "x_pos": F.lit(i), "x_var": F.lit(title)}))
        made = Chain(title, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), parts[0][0].meta, "banked")
        self.chains[title] = made
        return made

    def merge(self) -> DataFrame:
        """All chains' rows, one below the other."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [c.frame.withColumn("chain", F.lit(n)) for n, c in self.chains.items()])

    def save(self, path: str) -> None:
        made = ChainManager(None)
        made.items = list(self.chains.values())
        made.save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, name: str = "") -> Cluster:
        out = cls(name)
        out.add_chain(ChainManager.load(spark, path).chains)
        return out

