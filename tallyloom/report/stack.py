"""The stack: results of all links of all surveys and batches in one long table.

Columns: dataset, filter, x_var, x_code, x_pos, y_var, y_code, y_pos, weight, view
(its key), value, text (of tests). Links of one filter are counted together in one
scan (see :func:`tallyloom.plans.tabulate.fused`); percents, bases, sums, running
sums and tests follow from those counts. Results are as small as the tables shown
and are stored in the folder of ``spark.checkpoint.dir``, which cuts lineage.
"""

from __future__ import annotations

import copy
import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..meta import CATEGORICAL, NUMERIC, SET, Meta
from ..plans import rules, sigtests, tabulate
from ..plans.tabulate import ALL, TOTAL, Net, nets_of, share
from ..session import stored
from ..sources.spss import read_spss
from ..survey import Survey
from .batch import Batch, _listed, batches, get_batch
from .views import COUNT_VIEWS, PRESETS, STAT_TEXTS, View, ViewMapper, factor_condition, nets_condition, preset_key

RESULT = "dataset string, filter string, x_var string, x_code string, x_pos int, y_var string, y_code string, y_pos int, weight string, view string, value double, text string"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
NO_FILTER = "no_filter"


class Link:
    """What a view method gets."""

    def __init__(self, x: str, y: str, where, weight: str | None):
        self.x, self.y, self.where, self.weight = x, y, where, weight


class Stack:
    def __init__(self, spark: SparkSession, name: str = "", surveys: dict[str, Survey] | None = None):
        self.spark, self.name = spark, name
        self.surveys: dict[str, Survey] = {}
        #: (dataset, filter name) -> {"where": condition, "links": {(x, y): weights}}
        self.links: dict[tuple[str, str], dict] = {}
        self.results: DataFrame = spark.createDataFrame([], RESULT)
        self._frozen: dict[str, Meta] = {}
        self.own_methods: dict[str, ViewMapper] = {}
        for key, survey in (surveys or {}).items():
            self.add_data(key, survey)

    # ------------------------------------------------------------------ inventory

    def add_data(self, key: str, survey: Survey) -> None:
        if "@1" not in survey.df.columns:
            survey = Survey(survey.df.withColumn("@1", F.lit(1.0)), survey.meta, survey.name)
        self.surveys[key] = survey

    def remove_data(self, keys) -> None:
        for k in _listed(keys):
            del self.surveys[k]
            self.links = {at: own for at, own in self.links.items() if at[0] != k}
        self.reduce(data_keys=keys)

    @classmethod
    def from_spss(cls, spark, key: str, path: str, name: str = "") -> Stack:
        """A stack of one survey, read from an SPSS file."""
        return cls(spark, name or key, {key: read_spss(spark, path)})

    def survey(self, key: str | None = None, filter: str = NO_FILTER) -> Survey:
        """A survey of the stack, under one of its filters."""
        if key is None and len(self.surveys) > 1:
            raise ValueError("the stack has several surveys; name one")
        key = next(iter(self.surveys)) if key is None else key
        own = self.surveys[key]
        return own.clone() if filter == NO_FILTER else own.filter(filter, self.links[key, filter]["where"])

    def merge_link(self, other: Stack, key: str, filter: str, x: str, y: str, views=None, overwrite: bool = False) -> None:
        """Takes over another stack's views of one link; those that are here stay unless ``overwrite``."""
        at = (F.col("dataset") == key) & (F.col("filter") == filter) & (F.col("x_var") == x) & (F.col("y_var") == y)
        new = other.results.filter(at if views is None else at & F.col("view").isin(_listed(views)))
        here = self.results.filter(at).select("view").distinct()
        self._add([new if overwrite else new.join(here, "view", "left_anti")])

    def variable_types(self, key: str, only: str | None = None) -> dict[str, list[str]]:
        return self.surveys[key].meta.by_type(only)

    def describe(self, index=None, columns=None, query: str | None = None, split_view_names: bool = False) -> DataFrame:
        """A row for each view of each link; with index (and columns) the number of views by those keys."""
        made = self.results.groupBy("dataset", "filter", "x_var", "y_var", "weight", "view").agg(F.countDistinct("x_code").cast("int").alias("rows"), F.countDistinct("y_code").cast("int").alias("cols"))
        if split_view_names:
            names = ("method", "condition", "relation", "view_weight", "name")
            made = made.withColumns({n: F.split("view", r"\|")[i] for i, n in enumerate(names, 1)})
        if query:
            made = made.filter(query)
        if index is None:
            return made
        grouped = made.groupBy(*_listed(index))
        return grouped.pivot(columns).count() if columns else grouped.count()

    def reduce(self, data_keys=None, filters=None, x=None, y=None, variables=None, views=None) -> None:
        """Takes results out by their keys; what is named in all arguments given goes."""
        wanted: list[Column] = []
        for column, names in (("dataset", data_keys), ("filter", filters), ("x_var", x), ("y_var", y), ("view", views)):
            if names is not None:
                wanted.append(F.col(column).isin(_listed(names)))
        if variables is not None:
            wanted.append(F.col("x_var").isin(_listed(variables)) | F.col("y_var").isin(_listed(variables)))
        if wanted:
            self._keep(self.results.filter(~reduce(lambda a, b: a & b, wanted)))

    def _keep(self, rows: DataFrame) -> None:
        self.results = stored(rows.select(*COLUMNS), "stack")

    def _add(self, made: list[DataFrame]) -> None:
        if made:
            new = reduce(DataFrame.unionByName, [m.select(*COLUMNS) for m in made])
            new = stored(new, "stack-part")
            keys = new.select("dataset", "filter", "x_var", "y_var", "weight", "view").distinct()
            # results asked for again take the place of the old ones
            self._keep(self.results.join(keys, keys.columns, "left_anti").unionByName(new))

    # ------------------------------------------------------------------ meta edits

    def apply_meta_edits(self, batch: str, key: str, freeze: bool = False) -> None:
        if freeze:
            self.freeze_master_meta(key)
        own = self.surveys[key]
        self.surveys[key] = Survey(own.df, get_batch(own, batch).edited().meta, own.name)

    def freeze_master_meta(self, key: str) -> None:
        self._frozen[key] = copy.deepcopy(self.surveys[key].meta)

    def restore_meta(self, key: str) -> None:
        own = self.surveys[key]
        self.surveys[key] = Survey(own.df, self._frozen[key], own.name)

    # ----------------------------------------------------------------------- links

    def add_link(self, data_keys=None, filters=None, x=None, y=None, views=None, weights=None) -> None:
        """Links of all x and y (heads; ``@`` is the total). filters: names of filter variables, query texts, or {name: logic}."""
        for key in _listed(data_keys) or list(self.surveys):
            for f in _listed(filters) or [NO_FILTER]:
                name, where = next(iter(f.items())) if isinstance(f, dict) else (f, None if f == NO_FILTER else f)
                own = self.links.setdefault((key, name), {"where": where, "links": {}})
                for a in _listed(x):
                    for b in _listed(y) or [TOTAL]:
                        known = own["links"].setdefault((a, b), [])
                        known += [w for w in _listed(weights) or [None] if w not in known]
        if views is not None:
            self.aggregate(views)

    populate = add_link

    def populate_batches(self, key: str, names="all") -> None:
        """All links of a survey's batches; equal requests of several batches are one."""
        survey = self.surveys[key]
        for b in self._batches(key, names):
            spec = b.spec
            for a, heads in b.x_y_map():
                if a == TOTAL:
                    continue
                where = b.filter_of(a.removesuffix("_level"))
                self.add_link(key, where or NO_FILTER, a, heads, weights=spec["weights"])
            for block in spec["y_on_y"]:
                where = spec["y_on_y_filters"].get(block)
                plain = [y for y in spec["y"] if y != TOTAL and ">" not in y and y not in survey.meta.grids]
                self.add_link(key, where or NO_FILTER, plain, spec["y"], weights=spec["weights"])

    def _batches(self, key: str, names="all") -> list[Batch]:
        survey = self.surveys[key]
        return [get_batch(survey, n) for n in batches(survey) if names == "all" or n in _listed(names)]

    def _picked(self, on: Iterable[str] | None = None, batch_names="all") -> Iterable[tuple[Survey, str, str, object, dict]]:
        """(survey, key, filter, where, {(x, y): weights}) of links, of some x, of some batches."""
        for (key, name), own in self.links.items():
            survey, links = self.surveys[key], own["links"]
            if on is not None:
                wanted = set(on) | {i for x in on for i in survey.meta.sources(x)}
                links = {(x, y): w for (x, y), w in links.items() if x in wanted}
            if batch_names != "all":
                allowed = {(x, y, b.filter_of(x) or NO_FILTER) for b in self._batches(key, batch_names) for x, ys in b.x_y_map() for y in ys}
                links = {(x, y): w for (x, y), w in links.items() if (x, y, name) in allowed}
            if links:
                yield survey, key, name, own["where"], links

    @staticmethod
    def _is_plain(survey: Survey, x: str) -> bool:
        return x in survey.meta and x not in survey.meta.grids and survey.meta[x].type in CATEGORICAL

    # ----------------------------------------------------------------- aggregation

    def aggregate(self, views: Iterable[str] | ViewMapper = ("cbase", "counts", "c%"), unweighted_base: bool = True, categorize: Iterable[str] = (), batches="all", xs: list[str] | None = None, bases: dict | None = None) -> None:
        """Views of all links. Numbers have count views only if categorised; others get their statistics.

        bases: {"cbase" | "cbase_gross" | "ebase": {"unwgt": bool, "wgt": bool}}: base views asked for beside.
        """
        mapper = views if isinstance(views, ViewMapper) else None
        names = [] if mapper else ["counts" if v == "default" else v for v in _listed(views)]
        if unknown := [n for n in names if n not in PRESETS]:
            raise KeyError(f"no presets: {unknown}")
        made: list[DataFrame] = []
        for survey, key, name, where, links in self._picked(xs, batches):
            for n in categorize:
                if n in survey.meta and f"{n}#" not in survey.meta:
                    survey.categorize(n)
            self.surveys[key] = survey
            if mapper:
                made += self._own(mapper, survey, key, name, where, links)
                continue
            counted = [n for n in names if n in COUNT_VIEWS]
            extra = self._base_weights(bases, unweighted_base, links)
            plain = {at: w for at, w in links.items() if self._is_plain(survey, at[0])}
            alias = {f"{n}#": n for n in categorize}
            plain |= {(f"{x}#", y): w for (x, y), w in links.items() if x in alias.values()}
            if plain and (counted or extra):
                table = self._counts(survey, plain, where, extra)
                made.append(self._long(_derived(table, counted, extra), key, name).withColumn("x_var", F.regexp_replace("x_var", "#$", "")))
            made += self._grids(survey, key, name, where, links, counted)
            if numbers := {at: w for at, w in links.items() if at[0] in survey.meta and survey.meta[at[0]].type in NUMERIC}:
                wanted = [n for n in names if n not in COUNT_VIEWS] or ["mean", "stddev", "min", "median", "max"]
                made += self._stats(survey, key, name, where, numbers, wanted, [{}], {})
            stats = [n for n in names if n not in COUNT_VIEWS and n != "default"]
            singles = {at: w for at, w in plain.items() if survey.meta[at[0]].type != SET}
            if stats and singles:
                made += self._stats(survey, key, name, where, singles, stats, [{}], {})
        self._add(made)

    @staticmethod
    def _base_weights(bases: dict | None, unweighted: bool, links: dict) -> dict[str, list[str | None]]:
        weights = list(dict.fromkeys(w for own in links.values() for w in own))
        out: dict[str, list[str | None]] = {}
        if unweighted and any(weights):
            out["cbase"] = [None]
        for name, how in (bases or {}).items():
            own = ([None] if how.get("unwgt") else []) + ([w for w in weights if w] if how.get("wgt") else [])
            out[name] = list(dict.fromkeys([*out.get(name, []), *own]))
        return out

    @staticmethod
    def _pairs_frame(survey: Survey, links: dict, extra_weights: Iterable[str | None] = ()) -> DataFrame:
        rows = [(x, y, w or "", w in own) for (x, y), own in links.items() for w in dict.fromkeys([*own, *extra_weights])]
        return survey.spark.createDataFrame(rows, "x_var string, y_var string, weight string, asked boolean")

    def _counts(self, survey: Survey, links: dict, where, extra: dict | None = None, nets: dict[str, list[Net]] | None = None) -> DataFrame:
        """The fused counts of the links asked for, stored. Base rules with and without missing codes: column gross (the margin's)."""
        xs, ys = list(dict.fromkeys(x for x, _ in links)), list(dict.fromkeys(y for _, y in links if y != TOTAL))
        more = [w for own in (extra or {}).values() for w in own]
        weights = list(dict.fromkeys(w for own in [*links.values(), more] for w in own))
        pairs = self._pairs_frame(survey, links, more)
        table = tabulate.fused(survey, xs, ys, weights, where, nets).join(F.broadcast(pairs), ["x_var", "y_var", "weight"])
        if any("exclude" in survey.meta[x].missings.values() for x in xs):
            whole = survey.clone()
            for v in [*whole.meta.columns.values(), *whole.meta.grids.values()]:
                v.missings = {}
            gross = tabulate.fused(whole, xs, ys, weights, where).filter(F.col("x_code") == ALL).select("x_var", "y_var", "y_code", "weight", F.col("w").alias("gross"))
            table = table.join(gross, ["x_var", "y_var", "y_code", "weight"], "left")
        else:
            table = table.withColumn("gross", F.when(F.col("x_code") == ALL, F.col("w")))
        return stored(table, "counts")

    def _grids(self, survey: Survey, key: str, name: str, where, links: dict, counted: list[str]) -> list[DataFrame]:
        """Summaries of grids and their levels: bases, counts and percents."""
        made = []
        for (x, y), weights in links.items():
            level = x.removesuffix("_level") if x not in survey.meta else None
            if not counted or not (x in survey.meta.grids and y == TOTAL or level in survey.meta.grids):
                continue
            for w in weights:
                if level:
                    table = tabulate.level_cells(survey, level, None if y == TOTAL else y, w, where).withColumn("x_var", F.lit(x))
                else:
                    table = tabulate.grid_cells(survey, x, w, where).withColumn("y_var", F.lit(TOTAL))
                table = table.withColumns({"weight": F.lit(w or ""), "asked": F.lit(True), "gross": F.when(F.col("x_code") == ALL, F.col("w"))})
                made.append(self._long(_derived(table, [c for c in counted if c in ("cbase", "cbase_gross", "counts", "c%", "counts_sum")], {}), key, name))
        return made

    def _long(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(F.lit(key).alias("dataset"), F.lit(name).alias("filter"), "x_var", "x_code", "x_pos", "y_var", "y_code", "y_pos", "weight", "view", "value", F.lit(None).cast("string").alias("text"))

    def _own(self, mapper: ViewMapper, survey: Survey, key: str, name: str, where, links: dict) -> list[DataFrame]:
        made = []
        presets = [m.name for m in mapper.methods.values() if isinstance(m.method, str) and m.method in COUNT_VIEWS]
        plain = {at: w for at, w in links.items() if self._is_plain(survey, at[0])}
        if presets and plain:
            made.append(self._long(_derived(self._counts(survey, plain, where), presets, {}), key, name))
        for method, kwargs in mapper.calls():
            if isinstance(method.method, str):
                continue
            for (x, y), weights in links.items():
                for w in weights:
                    got = method.method(survey, Link(x, y, where, w), **kwargs)
                    said = ",".join(f"{k}={v}" for k, v in kwargs.items() if k in method.iterators)
                    view = f"x|{method.name}|{said}:||{w or ''}|{method.name}"
                    made.append(self._long(got.withColumns({"x_var": F.lit(x), "y_var": F.lit(y), "weight": F.lit(w or ""), "view": F.lit(view)}), key, name))
        return made

    def cumulative_sum(self, on: list[str], batches="all") -> None:
        """Running sums in place of the plain counts and percents."""
        made = []
        for survey, key, name, where, links in self._picked(on, batches):
            made.append(self._long(_derived(self._counts(survey, links, where), ["counts_cumsum", "c%_cumsum"], {}), key, name))
        self._add(made)
        self._without_plain(made, on)

    def _without_plain(self, made: list[DataFrame], on: list[str]) -> None:
        if made:
            self._keep(self.results.filter(~(F.col("x_var").isin(_listed(on)) & F.element_at(F.split("view", r"\|"), 6).isin("counts", "c%"))))

    def add_nets(self, on: list[str], net_map: list, expand: str | None = None, calc: dict | None = None, rebase: str | None = None, text_prefix: str = "Net:", complete: bool | None = None, recode: str | None = None, batches="all") -> None:
        """Nets beside their codes. calc: {"calc": (net, sign, net or number), "text": ...}, nets by name or as net_1, net_2...

        rebase: percents of another variable's base. recode: see :func:`recode_from_net_def`.
        """
        nets = nets_of(net_map, expand)
        complete = bool(expand) if complete is None else complete
        tabulate._check_nets(nets, complete)
        by_number = {f"net_{i}": n.name for i, n in enumerate(nets, 1)}
        formula = None
        if calc:
            left, sign, right = calc["calc"]
            formula = (by_number.get(left, left), sign, by_number.get(right, right) if isinstance(right, str) else right)
        made = []
        for survey, key, name, where, links in self._picked(on, batches):
            grids = {x for x, _ in links if x in survey.meta.grids}
            if grids and any(n.logic is not None for n in nets):
                raise ValueError("nets of grids are lists of codes")
            plain = {at: w for at, w in links.items() if self._is_plain(survey, at[0])}
            if not plain:
                continue
            table = self._counts(survey, plain, where, None, {x: nets for x, _ in plain})
            order = {x: tabulate._net_order(nets, survey.meta.codes(x), complete) for x, _ in plain}
            frame = survey.spark.createDataFrame([(x, c, p) for x, own in order.items() for c, p in own], "x_var string, x_code string, net_pos int")
            rows = table.join(F.broadcast(frame), ["x_var", "x_code"]).withColumn("x_pos", F.col("net_pos")).drop("net_pos")
            if formula:
                pick = lambda c: F.max(F.when(F.col("x_code") == f"net:{c}", F.col("w")))
                a, b = pick(formula[0]), F.lit(float(formula[2])) if not isinstance(formula[2], str) else pick(formula[2])
                sums = rows.groupBy("x_var", "y_var", "y_code", "y_pos", "weight").agg(tabulate._OPERATIONS[formula[1]](a, b).alias("w"))
                text = calc.get("text") or "calc"
                sums = sums.withColumns({"x_code": F.lit(f"calc:{text if isinstance(text, str) else next(iter(text.values()))}"), "x_pos": F.lit(1 << 20)})
                rows = rows.unionByName(sums, allowMissingColumns=True)
                if calc.get("exclusive"):
                    rows = rows.filter(F.col("x_code").startswith("calc:"))
            base = table.filter(F.col("x_code") == ALL)
            if rebase:
                other = tabulate.fused(survey, [rebase], [y for _, y in plain if y != TOTAL], list(dict.fromkeys(w for own in plain.values() for w in own)), where)
                base = base.drop("w").join(other.filter(F.col("x_code") == ALL).select("y_var", "y_code", "weight", "w"), ["y_var", "y_code", "weight"])
            bases = base.select("x_var", "y_var", "y_code", "weight", F.col("w").alias("base"))
            condition = nets_condition(nets, complete, formula)
            method = "f.c:f" if formula else "f"
            met = rows.join(bases, ["x_var", "y_var", "y_code", "weight"])
            # a quotient of nets is a percent as it is
            pct = F.when(F.col("x_code").startswith("calc:"), F.col("w") if formula and formula[1] == "/" else share(F.col("w"), F.col("base"))).otherwise(share(F.col("w"), F.col("base")))
            views = F.array(
                F.struct(F.concat(F.lit(f"x|{method}|{condition}||"), "weight", F.lit("|net")).alias("view"), F.col("w").alias("value")),
                F.struct(F.concat(F.lit(f"x|{method}|{condition}|{rebase or 'y'}|"), "weight", F.lit("|net")).alias("view"), pct.alias("value")),
            )
            made.append(self._long(met.withColumn("v", F.explode(views)).select("*", "v.*"), key, name))
            for x in {x for x, _ in plain}:
                survey.meta[x].properties["nets"] = [{"name": n.name, "text": f"{text_prefix} {n.text or n.name}".strip(), "codes": list(n.codes)} for n in nets]
            if recode:
                for x in {x for x, _ in plain}:
                    self.recode_from_net_def(key, x, nets, recode, text_prefix)
        self._add(made)
        if complete:
            self._without_plain(made, on)

    def recode_from_net_def(self, key: str, x: str, nets: list[Net], recode: str = "collect_codes", text_prefix: str = "Net:") -> str:
        """A variable from nets. extend_codes: the codes and the nets; drop_codes: the nets; collect_codes[@other]: the nets and one code for the rest."""
        survey = self.surveys[key]
        kind, _, rest = recode.partition("@")
        texts, codes = survey.meta.value_texts(x), survey.meta.codes(x)
        made = [(c, texts[c], {x: [c]}) for c in codes] if kind == "extend_codes" else []
        top = max(codes) if made else 0
        rows = [(top + i, f"{text_prefix} {n.text or n.name}".strip(), n.logic if n.logic is not None else {x: list(n.codes)}) for i, n in enumerate(nets, 1)]
        used = [c for n in nets for c in n.codes]
        others = [c for c in codes if c not in used]
        if kind == "collect_codes" and others:
            rows.append((top + len(nets) + 1, rest or "Other", {x: others}))
        name = f"{x}_rc"
        if name in survey.meta:
            name = survey.meta.enumerator(name)
        overlapping = len(used) > len(set(used)) or any(n.logic is not None for n in nets)
        qtype = "delimited set" if survey.meta[x].type == SET or made or overlapping else "single"
        name = survey.derive(name, qtype, dict(survey.meta[x].text), made + rows)
        survey.meta[name].properties.update(recoded_net=x, recoded_from=x)
        return name

    def add_stats(self, on: list[str], stats: Iterable[str] = ("mean",), other_source: str | None = None, rescale: dict[int, float] | None = None, drop: bool = True, exclude: Iterable[int] = (), factor_labels: bool = True, custom_text: str | None = None, recode: bool = False, batches="all") -> None:
        """Statistics of x, rescaled if asked for; sets need another variable as their source."""
        stats = _listed(stats)
        if bad := [s for s in stats if s not in STAT_TEXTS]:
            raise ValueError(f"no statistics: {bad}")
        made = []
        for survey, key, name, where, links in self._picked(on, batches):
            usable = {at: w for at, w in links.items() if at[0] not in survey.meta.grids and at[0] in survey.meta}
            if any(survey.meta[x].type == SET for x, _ in usable) and not other_source:
                raise ValueError("sets have no statistics of their own; name another source")
            spec = {k: v for k, v in (("factors", rescale), ("exclude", list(exclude)), ("drop", drop and bool(rescale)), ("source", other_source)) if v}
            made += self._stats(survey, key, name, where, usable, stats, [spec], {"custom": custom_text})
            for x in {x for x, _ in usable}:
                if rescale and survey.meta[x].type == "single":
                    survey.meta.set_factors(x, rescale)
                if rescale and factor_labels:
                    survey.meta[x].properties["factor_labels"] = {str(c): f"[{f:g}]" for c, f in rescale.items()}
                if recode:
                    self._recode_from_stat(survey, x, rescale, drop, set(exclude))
        self._add(made)

    @staticmethod
    def _recode_from_stat(survey: Survey, x: str, rescale: dict | None, drop: bool, exclude: set[int]) -> str:
        """x with the codes that count, as their factors."""
        texts = survey.meta.value_texts(x)
        by = {c: (rescale or {}).get(c, c) for c in survey.meta.codes(x) if c not in exclude and (not drop or not rescale or c in rescale)}
        name = f"{x}_rc" if f"{x}_rc" not in survey.meta else survey.meta.enumerator(f"{x}_rc")
        made = {}
        for c, f in by.items():
            made.setdefault(int(f), []).append(c)
        survey.derive(name, "single", dict(survey.meta[x].text), [(f, " / ".join(texts[c] for c in own), {x: own}) for f, own in sorted(made.items())])
        survey.meta[name].properties["recoded_stat"] = x
        return name

    def _stats(self, survey: Survey, key: str, name: str, where, links: dict, stats: list[str], specs: list[dict], more: dict) -> list[DataFrame]:
        xs, ys = list(dict.fromkeys(x for x, _ in links)), list(dict.fromkeys(y for _, y in links if y != TOTAL))
        weights = list(dict.fromkeys(w for own in links.values() for w in own))
        pairs = F.broadcast(self._pairs_frame(survey, links))
        made = []
        fast = [s for s in stats if s in tabulate.MOMENT_STATS]
        for spec in specs:
            source = f"{spec['source']}:" if spec.get("source") else factor_condition(spec.get("factors"))
            label = more.get("custom") or "stat"
            key_of = lambda s, source=source: F.concat(F.lit(f"x|d.{s}|{source}||"), "weight", F.lit(f"|{label if spec or more else s}"))  # noqa: B023, E731
            fixed = {"x_code": None, "x_pos": F.lit(1)}
            if fast:
                rows = tabulate.fused_stats(survey, [{"x": x, **spec} for x in xs], ys, weights, where).join(pairs, ["x_var", "y_var", "weight"])
                views = F.array(*[F.struct(key_of(s).alias("view"), F.lit(s).alias("x_code"), F.col(s).alias("value")) for s in fast])
                made.append(self._long(rows.withColumn("v", F.explode(views)).select("*", "v.*").withColumn("x_pos", fixed["x_pos"]), key, name))
            for s in [s for s in stats if s not in fast]:
                for (x, y), own in links.items():
                    for w in own:
                        got = tabulate.summarize(survey, x, None if y == TOTAL else y, w, where, [s], spec.get("factors"), spec.get("exclude", ()), spec.get("drop", False), spec.get("source"))
                        got = got.withColumns({"x_var": F.lit(x), "weight": F.lit(w or ""), "x_code": F.lit(s), "x_pos": F.lit(1), "value": F.col(s)})
                        made.append(self._long(got.withColumn("view", key_of(s)), key, name))
        return made

    def add_tests(self, levels=None, mimic: str = "dim", test_total: bool = False, flags: tuple[int, int] | None = None, batches="all") -> None:
        """Column tests of the counts and means that are there, for pairs of batches that ask for levels, or for the levels given."""
        made = []
        for survey, key, name, where, links in self._picked(None, batches):
            specs = [(lv, s["mimic"], s["test_total"], tuple(s["flags"])) for b in self._batches(key, batches) for s in [b.spec["tests"]] for lv in s["levels"]] if levels is None else [(lv, mimic, test_total, flags) for lv in _listed(levels)]
            usable = {(x, y): w for (x, y), w in links.items() if y != TOTAL and x in survey.meta and x not in survey.meta.grids}
            if not specs or not usable:
                continue
            plain = {at: w for at, w in usable.items() if self._is_plain(survey, at[0])}
            table = self._counts(survey, plain, where) if plain else None
            numbers = {at: w for at, w in usable.items() if survey.meta[at[0]].type != SET}
            stats = stored(tabulate.fused_stats(survey, [{"x": x} for x in dict.fromkeys(x for x, _ in numbers)], list(dict.fromkeys(y for _, y in numbers)), list(dict.fromkeys(w for own in numbers.values() for w in own)), where), "stats") if numbers else None
            heads = {y for _, y in usable if tabulate.axis(survey, y).is_set}
            parts = [sigtests._shared(survey, x, y, w, where, True) for (x, y), own in usable.items() if y in heads and survey.meta[x].values for w in own]
            shared = stored(reduce(DataFrame.unionByName, parts), "overlaps") if parts and any(mode == "dim" for _, mode, _, _ in specs) else None
            for lv, mode, total, bases in dict.fromkeys(specs):
                said = f"{'Dim' if mode == 'dim' else mode}.{f'{lv:.2f}'.split('.')[1] if isinstance(lv, float) else lv}{'+@' if total else ''}"
                if table is not None:
                    cells = table
                    if total:  # against the total, whose base doesn't ask for an answer to the head
                        cells = reduce(DataFrame.unionByName, [sigtests._keyed(tabulate.cells(survey, x, y, w, where, base_all=True), x, y, w) for (x, y), own in plain.items() for w in own])
                    got = sigtests.proportions_of(cells, lv, mode, total, True, shared, bases)
                    made.append(self._tested(survey, got, key, name, usable, f"x|t.props.{said}|:||"))
                if stats is not None:
                    asked = F.broadcast(self._pairs_frame(survey, numbers).drop("asked"))
                    got = sigtests.means_of(stats.join(asked, list(sigtests.LINK)), lv, mode, total, True, shared, bases).withColumnRenamed("stat", "x_code")
                    made.append(self._tested(survey, got, key, name, usable, f"x|t.means.{said}|x:||"))
        self._add(made)

    def _tested(self, survey: Survey, got: DataFrame, key: str, name: str, links: dict, view: str) -> DataFrame:
        places = [(v, str(c), i) for v in dict.fromkeys(n for at in links for n in at) if v != TOTAL and (">" in v or survey.meta[v].values) for i, c in enumerate(tabulate.axis(survey, v).codes, 1)]
        frame = survey.spark.createDataFrame(places, "var string, code string, pos int")
        for a in "xy":  # as many rows as codes
            own = frame.select(F.col("var").alias(f"{a}_var"), F.col("code").alias(f"{a}_code"), F.col("pos").alias(f"{a}_pos"))
            got = got.join(F.broadcast(own), [f"{a}_var", f"{a}_code"], "left").withColumn(f"{a}_pos", F.coalesce(f"{a}_pos", F.lit(1)))
        got = got.withColumnRenamed("value", "text").withColumns({"dataset": F.lit(key), "filter": F.lit(name), "view": F.concat(F.lit(view), "weight", F.lit("|significance"))})
        return got.withColumn("value", F.lit(None).cast("double"))

    def refresh(self, key: str, new: Survey | None = None, new_key: str | None = None, new_weight: str | None = None) -> None:
        """The same preset views again, on other data, under another key, or with one more weight."""
        at = new_key or key
        if new is not None:
            self.add_data(at, new)
        elif new_key:
            self.surveys[at] = self.surveys[key]
        for (dataset, name), own in list(self.links.items()):
            if dataset == key:
                copied = copy.deepcopy(own)
                if new_weight:
                    copied["links"] = {k: list(dict.fromkeys([*w, new_weight])) for k, w in copied["links"].items()}
                self.links[(at, name)] = copied
        names = [r.name for r in self.results.filter(F.col("dataset") == key).select(F.element_at(F.split("view", r"\|"), 6).alias("name")).distinct().collect()]
        others = {k: v for k, v in self.links.items() if k[0] != at}
        self.links = {k: v for k, v in self.links.items() if k[0] == at}
        self.aggregate([n for n in PRESETS if n in names])
        self.links = {**others, **self.links}

    # ----------------------------------------------------------------- what is there

    def get(self, key: str | None = None, where: str = NO_FILTER, x=None, y=None, views=None, weight: str | None = None) -> DataFrame:
        """Rows of results by their keys, in order."""
        rows = self.results.filter(F.col("filter") == where)
        for column, names in (("dataset", key), ("x_var", x), ("y_var", y), ("view", views)):
            if names is not None:
                rows = rows.filter(F.col(column).isin(_listed(names)))
        if weight is not None:
            rows = rows.filter(F.col("weight") == weight)
        return rows.orderBy("x_var", "view", "x_pos", "y_var", "y_pos")

    def view_keys(self, key: str | None = None, where: str = NO_FILTER, x: str | None = None, y: str | None = None) -> list[str]:
        rows = self.get(key, where, x, y).select("view").distinct().collect()
        return sorted(r.view for r in rows)

    def get_frequency(self, key: str, where: str, x: str, weight: str | None = None) -> DataFrame:
        """Counts of x against the total: those there are, or new ones."""
        return self._known(key, where, x, preset_key("counts", weight), "counts", weight)

    def get_descriptive(self, key: str, where: str, x: str, stat: str = "mean", weight: str | None = None) -> DataFrame:
        return self._known(key, where, x, preset_key(stat, weight), stat, weight)

    def _known(self, key: str, where: str, x: str, view: str, name: str, weight: str | None) -> DataFrame:
        found = self.get(key, where, x, TOTAL, view)
        if not found.head(1):
            self.add_link(key, where, x, TOTAL, weights=weight)
            self.aggregate([name], xs=[x])
            found = self.get(key, where, x, TOTAL, view)
        return found

    def get_rules_slicer(self, key: str, where: str, x: str, weight: str | None = None) -> list[str]:
        """The x codes in the order that the rules give."""
        survey = self.surveys[key]
        table = self.get_frequency(key, where, x, weight).select("x_var", "x_code", "x_pos", "y_var", "y_code", "y_pos", F.col("value").alias("w"))
        made = rules.applied(survey, table, x, None, ("x",))
        return [r.x_code for r in made.select("x_code", "x_pos").distinct().orderBy("x_pos").collect()]

    def sort_expanded_nets(self, rows: DataFrame, x: str, nets: list[Net], on: str = TOTAL, within: bool = True, between: bool = True, ascending: bool = False, fix: list | None = None) -> DataFrame:
        blocks = {f"net:{n.name}": [str(c) for c in n.codes] for n in nets}
        return rules.sorted_by(rows, on, fix, ascending, "value", blocks, within, between)

    # ---------------------------------------------------------------------- storage

    def save(self, path: str) -> None:
        """Results as Parquet, metadata and links as one JSON row; the case data stay where they are."""
        self.results.write.mode("overwrite").parquet(f"{path}/results")
        links = [{"dataset": d, "filter": f, "where": own["where"] if isinstance(own["where"], (str, type(None))) else None, "links": [[x, y, w] for (x, y), w in own["links"].items()]} for (d, f), own in self.links.items()]
        made = {"name": self.name, "meta": {k: s.meta.to_dict() for k, s in self.surveys.items()}, "links": links}
        self.spark.createDataFrame([(json.dumps(made, ensure_ascii=False),)], "json string").coalesce(1).write.mode("overwrite").text(f"{path}/stack")

    @classmethod
    def load(cls, spark: SparkSession, path: str, data: dict[str, DataFrame] | None = None) -> Stack:
        """``data``: case data by key, for a stack that is to aggregate further."""
        made = json.loads(spark.read.text(f"{path}/stack", wholetext=True).first()[0])
        out = cls(spark, made["name"])
        for key, meta in made["meta"].items():
            own = Meta.from_dict(meta)
            out.surveys[key] = Survey((data or {}).get(key, spark.createDataFrame([], "`@1` double")), own)
        for own in made["links"]:
            out.links[(own["dataset"], own["filter"])] = {"where": own["where"], "links": {(x, y): w for x, y, w in own["links"]}}
        out.results = spark.read.schema(RESULT).parquet(f"{path}/results")
        return out


def _derived(table: DataFrame, names: list[str], extra: dict[str, list[str | None]]) -> DataFrame:
    """Preset views of fused counts: each row tells its views as an array, so one pass gives all."""
    link = ["x_var", "y_var", "weight"]
    is_all, is_code = F.col("x_code") == ALL, ~F.col("x_code").isin(ALL) & ~F.col("x_code").startswith("net:")
    column = Window.partitionBy(*link, "y_code")
    base = F.max(F.when(is_all, F.col("w"))).over(column)
    row_base = F.max(F.when(F.col("y_code") == TOTAL, F.col("w"))).over(Window.partitionBy(*link, "x_code"))
    mentions = F.sum(F.when(is_code, F.col("w"))).over(column)
    running = F.sum(F.when(is_code, F.col("w"))).over(column.orderBy("x_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w = F.col("w")
    rows: dict[str, tuple[Column, Column, Column]] = {  # name -> (which rows, x_code, value)
        "cbase": (is_all, F.col("x_code"), w),
        "cbase_gross": (is_all, F.col("x_code"), F.coalesce("gross", w)),
        "ebase": (is_all, F.lit("All (eff.)"), F.when(F.col("w2") > 0, w * w / F.col("w2"))),
        "rbase": (is_code & (F.col("y_code") == TOTAL), F.col("x_code"), row_base),
        "counts": (is_code, F.col("x_code"), w),
        "c%": (is_code, F.col("x_code"), share(w, base)),
        "r%": (is_code, F.col("x_code"), share(w, row_base)),
        "res_c%": (is_code, F.col("x_code"), share(w, mentions)),
        "counts_sum": (is_all, F.lit("sum"), F.coalesce(mentions, F.lit(0.0))),
        "c%_sum": (is_all, F.lit("sum"), share(mentions, base)),
        "counts_cumsum": (is_code, F.col("x_code"), running),
        "c%_cumsum": (is_code, F.col("x_code"), share(running, base)),
    }
    made = []
    for name in dict.fromkeys([*names, *extra]):
        keep, code, value = rows[name]
        asked = F.col("asked") if name in names else F.lit(False)
        if name in extra:
            asked = asked | F.col("weight").isin([x or "" for x in extra[name]])
        method, condition, relation, _ = PRESETS[name]
        key = F.concat(F.lit(f"x|{method}|{condition}|{relation}|"), "weight", F.lit(f"|{name}"))
        made.append(F.when(keep & asked, F.struct(key.alias("view"), code.alias("x_code"), value.cast("double").alias("value"))))
    wanted = table.withColumn("v", F.array_compact(F.array(*made)))
    flat = wanted.select("x_var", "x_pos", "y_var", "y_code", "y_pos", "weight", F.explode("v").alias("v"))
    return flat.select("x_var", "v.x_code", "x_pos", "y_var", "y_code", "y_pos", "weight", "v.view", "v.value")
