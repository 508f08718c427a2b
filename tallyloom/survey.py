"""A survey: case data as a DataFrame with its metadata, and everything one does with them."""

from __future__ import annotations

import copy
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.logic import Compiler, Logic, query_column
from .meta import CATEGORICAL, INT, SET, SINGLE, SPARK_TYPES, Meta, MetaError, Value, Variable
from .operators import merge, recode, weighting
from .plans import tabulate
from .plans.tabulate import quoted


class Survey:
    """Changes return nothing and swap the DataFrame; DataFrames never change, so clones are free."""

    def __init__(self, df: DataFrame, meta: Meta | None = None, name: str = "", text_key: str = "main"):
        self.df = df
        self.meta = meta or Meta.inferred(df.schema, text_key)
        self.name = name or self.meta.name
        self._saved: tuple[DataFrame, Meta] | None = None

    # ------------------------------------------------------------------ basics

    @property
    def spark(self):
        return self.df.sparkSession

    def __contains__(self, name: str) -> bool:
        return name in self.meta

    def column(self, name: str) -> Column:
        return quoted(name)

    def logic(self, logic, default: str | None = None) -> Column:
        if isinstance(logic, Column):
            return logic
        return Compiler(self.column, lambda n: self.meta[n].type)(logic, default)

    def condition(self, where) -> Column:
        """A filter: logic, a Column, a filter variable's name, a query text, or a list of them that all hold."""
        if where is None:
            return F.lit(True)
        if isinstance(where, Column):
            return F.coalesce(where, F.lit(False))
        if isinstance(where, str):
            return F.coalesce(F.array_contains(quoted(where), 0), F.lit(False)) if self.is_filter(where) else query_column(where)
        if isinstance(where, list):
            return reduce(lambda a, b: a & b, map(self.condition, where), F.lit(True))
        return self.logic(where)

    def filtered(self, where=None) -> DataFrame:
        return self.df if where is None else self.df.filter(self.condition(where))

    def clone(self) -> Survey:
        return Survey(self.df, copy.deepcopy(self.meta), self.name)

    def split(self) -> tuple[Meta, DataFrame]:
        return self.meta, self.df

    def save(self) -> None:
        self._saved = self.df, copy.deepcopy(self.meta)

    def revert(self) -> None:
        if self._saved is None:
            raise ValueError("nothing saved")
        self.df, self.meta = self._saved[0], copy.deepcopy(self._saved[1])

    def _with(self, columns: dict[str, Column]) -> None:
        self.df = self.df.withColumns(columns)

    def filter(self, alias: str, condition, inplace: bool = False) -> Survey:
        made = self if inplace else self.clone()
        made.df, made.name = made.filtered(condition), alias
        made.meta.name = alias
        return made

    def take(self, condition) -> Column:
        return self.condition(condition)

    def subset(self, variables: list[str] | None = None, from_set: str | None = None, inplace: bool = False) -> Survey:
        names = variables or self.meta.sets[from_set]
        made = self if inplace else self.clone()
        keep = set(names) | {i for n in names for i in made.meta.sources(n)}
        for n in [*made.meta.grids, *made.meta.columns]:
            if n in made.meta and n not in keep:
                made.meta.drop(n, ignore_items=n in made.meta.grids)
        made.df = made.df.select(*[quoted(c) for c in made.df.columns if c in keep or c not in self.meta])
        made.meta.sets["data file"] = [n for n in names if n in made.meta]
        return made

    def drop(self, names: str | list[str], ignore_items: bool = False) -> None:
        for n in [names] if isinstance(names, str) else names:
            gone = self.meta.drop(n, ignore_items)
            self.df = self.df.drop(*gone)

    def add_meta(self, name: str, qtype: str, label, categories=None, items=None, text_key: str | None = None, replace: bool = True) -> str:
        made = self.meta.add(name, qtype, label, categories, items, text_key, replace)
        for c in self.meta.sources(made.name) or [made.name]:
            if c not in self.df.columns:
                self._with({c: F.lit(None).cast(SPARK_TYPES[made.type])})
        return made.name

    def copy(self, name: str, suffix: str = "rec", copy_data: bool = True, slicer=None, copy_only=None, copy_not=None) -> str:
        new = f"{name}_{suffix}"
        kind = self.meta[name].type
        for old, column in self.meta.copy_variable(name, new, copy_only, copy_not).items():
            made = quoted(old) if copy_data else F.lit(None).cast(SPARK_TYPES[kind])
            if copy_only is not None or copy_not is not None:
                codes = self.meta.codes(new)
                made = recode._or_null(F.filter(made, lambda c: c.isin(codes))) if kind == SET else F.when(made.isin(codes), made)
            if slicer is not None:
                made = F.when(self.condition(slicer), made)
            self._with({column: made.cast(SPARK_TYPES[kind])})
        return new

    def copy_array_data(self, source: str, target: str, source_items: list[int] | None = None, target_items: list[int] | None = None, slicer=None) -> None:
        a, b = self.meta.sources(source), self.meta.sources(target)
        pairs = zip([a[i - 1] for i in source_items] if source_items else a, [b[i - 1] for i in target_items] if target_items else b, strict=True)
        self._with({t: quoted(s) if slicer is None else F.when(self.condition(slicer), quoted(s)).otherwise(quoted(t)) for s, t in pairs})

    def rename(self, name: str, new: str) -> None:
        self.rename_all({name: new})

    def rename_all(self, mapper: dict[str, str]) -> None:
        self.meta.rename(mapper)
        self.df = self.df.select(*[quoted(c).alias(mapper.get(c, c)) for c in self.df.columns])

    def dimensionize(self, names: list[str] | None = None) -> None:
        self.rename_all(self.meta.dimensionized(names))

    def undimensionize(self, names: list[str] | None = None) -> None:
        self.rename_all(self.meta.undimensionized(names))

    def order(self, new: list[str] | None = None, reposition: list[dict] | None = None, regroup: bool = False) -> None:
        self.meta.order(new, reposition, regroup)
        listed = self.meta.unroll(self.meta.sets["data file"])
        self.df = self.df.select(*[quoted(c) for c in [*listed, *(c for c in self.df.columns if c not in listed)]])

    def meta_table(self, name: str) -> DataFrame:
        """A variable's codes or items as rows."""
        own = self.meta[name]
        rows = [(name, own.type, v.code, t, own.missings.get(v.code), v.factor) for v, t in zip(own.values or [], self.meta.value_texts(name).values() if own.values else [], strict=True)]
        return self.spark.createDataFrame(rows, "variable string, type string, code int, text string, missing string, factor double")

    def text_table(self) -> DataFrame:
        rows = [(n, v.type, self.meta.text(n)) for n, v in [*self.meta.columns.items(), *self.meta.grids.items()]]
        return self.spark.createDataFrame(rows, "variable string, type string, text string")

    # ------------------------------------------------------------------- codes

    def codes_in_data(self, name: str, where=None) -> DataFrame:
        own = self.meta[name]
        column = F.explode(quoted(name)) if own.type == SET else quoted(name)
        return self.filtered(where).select(column.alias("code")).filter("code IS NOT NULL").distinct()

    def remove_values(self, name: str, remove: int | list[int]) -> None:
        gone = [remove] if isinstance(remove, int) else list(remove)
        own = self.meta[name]
        for c in self.meta.sources(name) or [name]:
            made = recode._or_null(F.filter(quoted(c), lambda x: ~x.isin(gone))) if own.type == SET else F.when(~quoted(c).isin(gone), quoted(c))
            self._with({c: made})
        self.meta.remove_values(name, gone)

    def remove_items(self, name: str, remove: list[int]) -> None:
        self.df = self.df.drop(*self.meta.remove_items(name, remove))

    def extend_items(self, name: str, items: list, text_key: str | None = None) -> None:
        made = self.meta.extend_items(name, items, text_key)
        self._with({c: F.lit(None).cast(SPARK_TYPES[self.meta[name].type]) for c in made})

    # ------------------------------------------------------------- row functions

    def any(self, name: str, codes: int | list[int]) -> Column:
        return reduce(lambda a, b: a | b, [self.logic({n: [codes] if isinstance(codes, int) else codes}) for n in self.meta.sources(name) or [name]])

    def all(self, name: str, codes: int | list[int]) -> Column:
        wanted = Logic("all", tuple([codes] if isinstance(codes, int) else codes))
        return reduce(lambda a, b: a & b, [self.logic({n: wanted}) for n in self.meta.sources(name) or [name]])

    def code_count(self, name: str, count_only=None, count_not=None) -> Column:
        return recode.code_count(self, name, count_only, count_not)

    def is_nan(self, name: str) -> Column:
        return quoted(name).isNull()

    def is_like_numeric(self, name: str) -> bool:
        return recode.like_numeric(self.df, name)

    # ---------------------------------------------------------------- recoding

    def recode(self, target: str, mapper: dict, default=None, append=False, intersect=None, initialize=None, fillna=None, inplace=True) -> Column | None:
        unknown = set(mapper) - set(self.meta.codes(target)) if self.meta[target].values is not None else set()
        if unknown:
            raise MetaError(f"{target!r} has no codes {sorted(unknown)}")
        made = recode.recoded(self, target, mapper, default, append, intersect, initialize, fillna)
        if not inplace:
            return made
        self._with({target: made})
        return None

    def uncode(self, target: str, mapper: dict, default=None, intersect=None, inplace=True) -> Column | None:
        made = recode.uncoded(self, target, mapper, default, intersect)
        if not inplace:
            return made
        self._with({target: made})
        return None

    def derive(self, name: str, qtype: str, label, cond_map: list[tuple], text_key: str | None = None, default: str | None = None) -> str:
        """cond_map: (code, label, logic)."""
        made = self.add_meta(name, qtype, label, [(c, t) for c, t, _ in cond_map], text_key=text_key)
        self.recode(made, {c: logic for c, _, logic in cond_map}, default)
        return made

    def interlock(self, name: str, label, variables: list, separator: str = "/") -> str:
        """Variables, or {variable: bands} for numbers."""
        names = []
        for v in variables:
            if isinstance(v, dict):
                ((v, bands),) = v.items()
                v = self.band(v, bands, f"{v}_banded")
            names.append(v)
        column, kind, values = recode.interlocked(self, names, separator)
        self.meta.add(name, kind, label, values)
        self._with({name: column})
        return name

    def band(self, name: str, bands: list, new_name: str | None = None, label=None, text_key: str | None = None) -> str:
        new = new_name or f"{name}_banded"
        column, values = recode.banded(quoted(name), bands)
        self.meta.add(new, SINGLE, label or self.meta[name].text, values, text_key=text_key)
        self._with({new: column})
        return new

    def categorize(self, name: str, new: str | None = None) -> str:
        new = new or f"{name}#"
        column, values = recode.categories(self, name)
        self.meta.add(new, SINGLE, dict(self.meta[name].text), values)
        self._with({new: column})
        return new

    def dichotomize(self, name: str, value_texts: tuple[str, str] | None = None, keep_variable_text: bool = True, ignore: Iterable[int] = (), replace: bool = False) -> list[str]:
        yes, no = value_texts or ("Yes", "No")
        texts, made = self.meta.value_texts(name), []
        for code, column in recode.dichotomized(self, name, ignore).items():
            label = f"{self.meta.text(name)}: {texts[code]}" if keep_variable_text else texts[code]
            self.meta.add(f"{name}_{code}", SINGLE, label, [(1, yes), (0, no)])
            self._with({f"{name}_{code}": column})
            made.append(f"{name}_{code}")
        if replace:
            self.drop(name)
        return made

    def to_delimited_set(self, name: str, label, variables: list[str], from_dichotomous: bool = True, codes_from_name: bool = True) -> str:
        if from_dichotomous:
            codes = {int(v.rsplit("_", 1)[-1]) if codes_from_name else i: v for i, v in enumerate(variables, 1)}
            categories = [(c, self.meta.text(v)) for c, v in codes.items()]
            column = recode.set_from_dichotomous(codes)
        else:
            texts: dict[int, str] = {}
            for v in variables:
                texts |= {c: t for c, t in self.meta.value_texts(v).items() if c not in texts}
            categories, column = sorted(texts.items()), recode.set_from_singles(variables)
        self.meta.add(name, SET, label, categories)
        self._with({name: column if self.meta[name].type == SET else F.try_element_at(column, F.lit(1))})
        return name

    def to_array(self, name: str, variables: list[str], label, safe: bool = True) -> None:
        self.meta.to_grid(name, variables, label, safe)

    def first_responses(self, name: str, n: int = 3, others: str = "others", reduce_values: bool = False) -> list[str]:
        firsts, rest = recode.first_answers(quoted(name), n)
        made = []
        for i, column in enumerate(firsts, 1):
            self.meta.copy_variable(name, f"{name}_{i}")
            self.meta[f"{name}_{i}"].type = SINGLE
            made.append((f"{name}_{i}", column))
        self.meta.copy_variable(name, f"{name}_{others}")
        made.append((f"{name}_{others}", rest))
        self._with(dict(made))
        if reduce_values:
            for v, _ in made:
                seen = {r.code for r in self.codes_in_data(v).collect()}
                self.meta.remove_values(v, [c for c in self.meta.codes(v) if c not in seen])
        return [v for v, _ in made]

    def flatten(self, name: str, codes: list[int], new_name: str | None = None) -> str:
        new = new_name or f"{name}_flat"
        column = recode.flattened(self, name, codes)
        self.meta.add(new, SET, dict(self.meta[name].text), list(enumerate(self.meta.item_texts(name).values(), 1)))
        self._with({new: column})
        return new

    def transpose(self, name: str, new_name: str | None = None, ignore_items=(), ignore_values=(), copy_data: bool = True) -> str:
        new = new_name or f"{name}_trans"
        columns = recode.transposed(self, name, ignore_items, ignore_values)
        texts = self.meta.value_texts(name)
        items = [(n, t) for n, t in enumerate(self.meta.item_texts(name).values(), 1) if n not in set(ignore_items)]
        self.meta.add(new, SET, dict(self.meta[name].text), items, [(c, texts[c]) for c in columns])
        self._with({f"{new}_{c}": col if copy_data else F.lit(None).cast("array<int>") for c, col in columns.items()})
        return new

    def unify_values(self, name: str, code_map: dict[int, int], slicer=None, exclusive: bool = False) -> None:
        self._with({n: recode.unified(self, n, code_map, slicer, exclusive) for n in self.meta.sources(name) or [name]})

    def convert(self, name: str, to: str) -> None:
        for n in self.meta.sources(name) or [name]:
            column, values = recode.converted(self, n, to)
            self._with({n: column})
            own = self.meta.columns[n]
            own.type, own.values = to, values if to in CATEGORICAL else None
        if name in self.meta.grids:
            self.meta.grids[name].type = to

    def make_dummy(self, name: str) -> DataFrame:
        return self.df.select(*[c.alias(n) for n, c in recode.dummies(self, name).items()])

    def derotate(self, levels: dict[str, list], mapper: list[dict[str, list[str]]], other: list[str] | None = None, unique_key: str = "identity") -> Survey:
        ((level, labels),) = levels.items()
        groups = {g: c for m in mapper for g, c in m.items()}
        others = list(dict.fromkeys([unique_key, *(other or [])]))
        made = Meta(self.meta.text_key, f"{self.name}_derotated")
        for o in others:
            made.columns[o] = copy.deepcopy(self.meta[o]) if o in self.meta else Variable(o, INT, {self.meta.text_key: o})
        names = [n if isinstance(n, str) else next(iter(n)) for n in labels]
        made.columns[level] = Variable(level, SINGLE, {self.meta.text_key: level}, [Value(i, {self.meta.text_key: t}) for i, t in enumerate(names, 1)])
        for g, columns in groups.items():
            made.columns[g] = copy.deepcopy(self.meta[columns[0]])
            made.columns[g].name, made.columns[g].parent = g, None
        made.sets["data file"] = list(made.columns)
        rows = recode.derotated(self.df, names, groups, others, level).drop(f"{level}_text")
        return Survey(rows, made)

    def empty(self, name: str | list[str], condition=None) -> list[str]:
        """The variables without any value; one pass over the data."""
        names = [name] if isinstance(name, str) else name
        got = self.filtered(condition).agg(*[F.count(quoted(n)).alias(n) for n in names]).first()
        return [n for n in names if got[n] == 0]

    def empty_items(self, name: str, condition=None, by_name: bool = True) -> list:
        found = self.empty(self.meta.sources(name), condition)
        return found if by_name else [self.meta.item_number(i) for i in found]

    def hide_empty_items(self, condition=None, arrays: list[str] | None = None) -> None:
        for a in arrays or list(self.meta.grids):
            if gone := self.empty_items(a, condition):
                self.meta.hide(a, gone, "x", hide_values=False)

    def fully_hidden_arrays(self) -> list[str]:
        return [g for g, v in self.meta.grids.items() if set(v.items) <= set(v.rules.get("x", {}).get("dropx", {}).get("values", ()))]

    def min_value_count(self, name: str, least: int = 50, weight: str | None = None, condition=None, axis: str | list[str] = "y") -> list[int]:
        """Hides codes with fewer respondents; those that occur and those that don't."""
        rows = tabulate.cells(self, name, None, weight, condition).filter((F.col("x_code") != tabulate.ALL) & (F.col("y_code") == tabulate.TOTAL) & (F.col("w") < least))
        codes = sorted(int(r.x_code) for r in rows.select("x_code").collect())
        self.meta.hide(name, codes, axis)
        return codes

    # ----------------------------------------------------------------- filters

    def is_filter(self, name: str) -> bool:
        return name in self.meta and bool(self.meta[name].properties.get("recoded_filter"))

    def add_filter_var(self, name: str, logics: list, overwrite: bool = False) -> str:
        """A set with a code for each logic that holds, and 0 where all do."""
        if name in self.meta and not overwrite:
            raise MetaError(f"{name!r} is there already")
        named = [next(iter(x.items())) if isinstance(x, dict) and "label" not in x and len(x) == 1 and not next(iter(x)) in self.meta else (f"condition {i}", x) for i, x in enumerate(logics, 1)]
        self.meta.columns[name] = Variable(name, SET, {self.meta.text_key: name}, [Value(0, {self.meta.text_key: "keep"}), *(Value(i, {self.meta.text_key: t}) for i, (t, _) in enumerate(named, 1))])
        self.meta[name].properties["recoded_filter"] = True
        if name not in self.meta.sets["data file"]:
            self.meta.sets["data file"].append(name)
        self._with({name: self._filter_column({i: self.condition(x) for i, (_, x) in enumerate(named, 1)})})
        return name

    def _filter_column(self, hits: dict[int, Column]) -> Column:
        every = reduce(lambda a, b: a & b, hits.values(), F.lit(True))
        return recode.compact([F.when(every, F.lit(0)), *[F.when(c, F.lit(i)) for i, c in hits.items()]])

    def _filter_hits(self, name: str) -> dict[int, Column]:
        return {c: F.coalesce(F.array_contains(quoted(name), c), F.lit(False)) for c in self.meta.codes(name) if c}

    def extend_filter_var(self, name: str, logics: list, extend_as: str | None = None) -> str:
        if extend_as:
            self.meta.copy_variable(name, extend_as)
            self._with({extend_as: quoted(name)})
            name = extend_as
        hits = self._filter_hits(name)
        for logic in logics:
            code = max([0, *self.meta.codes(name)]) + 1
            self.meta.values(name).append(Value(code, {self.meta.text_key: f"condition {code}"}))
            hits[code] = self.condition(logic)
        self._with({name: self._filter_column(hits)})
        return name

    def reduce_filter_var(self, name: str, values: int | list[int]) -> None:
        self.meta.remove_values(name, [values] if isinstance(values, int) else values)
        self._with({name: self._filter_column(self._filter_hits(name))})

    def manifest_filter(self, name: str) -> Column:
        return F.coalesce(F.array_contains(quoted(name), 0), F.lit(False))

    def merge_filter(self, name: str, filters: list[str]) -> str:
        either = reduce(lambda a, b: a | b, [self.manifest_filter(f) for f in filters])
        return self.add_filter_var(name, [either], overwrite=True)

    def compare_filter(self, one: str, other: str) -> bool:
        return not self.df.filter(self.manifest_filter(one) != self.manifest_filter(other)).head(1)

    def is_subfilter(self, one: str, other: str) -> bool:
        """Whether every row of ``other`` is one of ``one``."""
        return not self.df.filter(self.manifest_filter(other) & ~self.manifest_filter(one)).head(1)

    # ------------------------------------------------------------------ merging

    def hmerge(self, other: Survey | list[Survey], on: str | None = None, left_on: str | None = None, right_on: str | None = None, overwrite_text: bool = False, from_set: str | None = None, inplace: bool = True, merge_existing=None) -> Survey:
        made = self if inplace else self.clone()
        for right in other if isinstance(other, list) else [other]:
            names = right.meta.sets[from_set] if from_set else right.meta.sets["data file"]
            columns = [c for c in right.df.columns if c in set(right.meta.unroll(names)) or c == (right_on or on)]
            sets = tuple(n for n, v in right.meta.columns.items() if v.type == SET)
            merged = made.meta.merged(right.meta, names, overwrite_text)
            made.df = merge.hmerge(made.df, right.df.select(*map(quoted, columns)), on, left_on, right_on, sets, merge_existing or False)
            made.meta = merged
        return made

    def update(self, data: DataFrame, on: str = "identity") -> None:
        self.df = merge.update(self.df, data, on)

    def vmerge(self, other: Survey | list[Survey], on: str | None = None, left_on: str | None = None, right_on: str | None = None, row_id_name: str | None = None, left_id=None, right_id=None, row_ids: list | None = None, overwrite_text: bool = False, inplace: bool = True) -> Survey:
        made = self if inplace else self.clone()
        others = other if isinstance(other, list) else [other]
        for i, right in enumerate(others):
            rid = row_ids[i + 1] if row_ids else right_id
            lid = (row_ids[0] if row_ids else left_id) if i == 0 else None
            merged = made.meta.merged(right.meta, None, overwrite_text)
            left = made.df
            if row_id_name and i == 0 and lid is not None:
                left = left.withColumn(row_id_name, F.lit(lid))
            extra = right.df.withColumn(row_id_name, F.lit(rid)) if row_id_name and rid is not None else right.df
            made.df, made.meta = merge.vmerge(left, extra, on, left_on, right_on), merged
        return made

    def duplicates(self, name: str = "identity") -> DataFrame:
        return merge.duplicates(self.df, name)

    def drop_duplicates(self, unique_id: str = "identity", keep: str = "first", sort_by=None) -> None:
        self.df = merge.drop_duplicates(self.df, unique_id, keep, sort_by)

    def merge_texts(self, other: Survey) -> None:
        for n in self.meta.columns:
            if n in other.meta.columns:
                self.meta[n].text = {**other.meta[n].text, **self.meta[n].text}

    # ----------------------------------------------------------------- weighting

    def weight(self, scheme: weighting.Scheme, weight_name: str = "weight", subset=None) -> dict[str, int]:
        """Adds rim weights; with a subset the other rows have none."""
        if subset is None:
            self.df, rounds = weighting.weights(self, scheme, weight_name)
        else:
            inside = self.condition(subset)
            part = Survey(self.df.filter(inside), self.meta)
            made, rounds = weighting.weights(part, scheme, weight_name)
            rest = self.df.filter(~inside).withColumn(weight_name, F.lit(None).cast("double"))
            self.df = made.unionByName(rest.select(*map(quoted, made.columns)))
        self.meta.columns[weight_name] = Variable(weight_name, "float", {self.meta.text_key: weight_name})
        if weight_name not in self.meta.sets["data file"]:
            self.meta.sets["data file"].append(weight_name)
        return rounds

    # -------------------------------------------------------------- tabulation

    def crosstab(self, x: str, y: str | None = None, w: str | None = None, pct: bool = False, decimals: int = 1, text: bool = False, rules: bool = False, xtotal: bool = False, f=None) -> DataFrame:
        """Counts or column percents in long form: x_code, y_code, value."""
        made = tabulate.cells(self, x, None if y in (None, "@") else y, w, f)
        made = tabulate.column_percent(made) if pct else made.withColumn("value", F.col("w"))
        if rules:
            from .plans.rules import applied

            made = applied(self, made, x, y)
        if y and y != "@" and not xtotal:
            made = made.filter(F.col("y_code") != tabulate.TOTAL)
        made = made.withColumn("value", F.round("value", decimals))
        return tabulate.labelled(self, made) if text else made

    def frequency(self, x: str, w: str | None = None, **more) -> DataFrame:
        return self.crosstab(x, None, w, **more)

    # ------------------------------------------------------------------ checking

    def validate(self, spss_limits: bool = False) -> DataFrame:
        """A row for each problem: name, text, categories, codes in the data that the metadata lack, columns without either."""
        found: list[tuple[str, str]] = []
        for names in self.meta.weak_duplicates().values():
            found += [(n, "name differs from another in case only") for n in names]
        for n, v in [*self.meta.columns.items(), *self.meta.grids.items()]:
            if not v.text.get(self.meta.text_key):
                found.append((n, "no label"))
            if v.type in CATEGORICAL and not v.values:
                found.append((n, "no codes"))
            found += [(n, f"code {x.code} has no label") for x in v.values or () if not x.text.get(self.meta.text_key)]
            if spss_limits:
                if len(n) > 64:
                    found.append((n, "name over 64 characters"))
                if len(v.text.get(self.meta.text_key, "")) > 256:
                    found.append((n, "label over 256 characters"))
                found += [(n, f"label of code {x.code} over 120 characters") for x in v.values or () if len(x.text.get(self.meta.text_key, "")) > 120]
        found += [(n, "not in the data") for n in self.meta.columns if n not in self.df.columns]
        found += [(c, "not in the metadata") for c in self.df.columns if c not in self.meta.columns and c != "@1"]
        checks = []
        for n, v in self.meta.columns.items():
            if v.type in CATEGORICAL and v.values and n in self.df.columns:
                codes = [x.code for x in v.values]
                wild = F.exists(quoted(n), lambda c: ~c.isin(codes)) if v.type == SET else ~quoted(n).isin(codes)
                checks.append((n, F.max(F.coalesce(wild, F.lit(False)))))
        if checks:
            got = self.df.agg(*[c.alias(f"c{i}") for i, (_, c) in enumerate(checks)]).first()
            found += [(n, "codes in the data that the metadata lack") for i, (n, _) in enumerate(checks) if got[i]]
        return self.spark.createDataFrame(found, "variable string, problem string")

    def compare(self, other: Survey, variables=None, strict: bool = False, text_key: str | None = None) -> dict[str, list[str]]:
        return self.meta.compare(other.meta, variables, strict, text_key)

    def repair(self) -> None:
        """Renames reserved and weakly equal names, drops what the data lack, adds the constant column."""
        for names in self.meta.weak_duplicates().values():
            for n in names[1:]:
                self.rename(n, self.meta.enumerator(n))
        for n in [n for n in self.meta.columns if n not in self.df.columns]:
            self.meta.drop(n)
        if "@1" not in self.df.columns:
            self._with({"@1": F.lit(1.0)})

    def __repr__(self) -> str:
        return f"Survey({self.name!r}, {len(self.meta.columns)} columns, {len(self.meta.grids)} grids)"


