"""Dimensions surveys: metadata as XML, case data as an SQLite file with a table for each level.

Both files are read by Spark, so any store will do. An SQLite file is one unit: a task
reads a table of it and hands rows on in batches. Levels below the respondent are
pivoted to columns ``grid[{element}].field``. Writing gives the two scripts and the two
CSV inputs that the vendor's converters take; the converters themselves aren't called.
"""

from __future__ import annotations

import re
import sqlite3
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import BOOLEAN, DATE, FLOAT, INT, SET, SINGLE, STRING, Grid, Meta, Value, Variable
from ..operators.recode import _or_null
from ..plans.tabulate import quoted
from ..survey import Survey
from .documents import load_text

#: Suffixes of columns in the data file, and type numbers in the metadata.
DATA_TYPES = {"X": STRING, "L": INT, "D": FLOAT, "T": DATE, "C1": SINGLE, "S": SET, "B": BOOLEAN}
META_TYPES = {"1": INT, "2": STRING, "3": "categorical", "5": DATE, "6": FLOAT, "7": BOOLEAN}
SCRIPT_TYPES = {SINGLE: "mr.Categorical", SET: "mr.Categorical", INT: "mr.Long", FLOAT: "mr.Double", STRING: "mr.Text", DATE: "mr.Date", BOOLEAN: "mr.Boolean"}
OWN_PROPERTIES = {"SqlClmnName", "TableName", "__SYS", "NativeValue", "Value"}
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
_BATCH = 10_000


# ---------------------------------------------------------------------- case data


def _sqlite(spark: SparkSession, path: str, sql: str, names: list[str]) -> DataFrame:
    """The rows of a query, as text, read by a task from the file's bytes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content in batch.column("content"):
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(content.as_py())
                    found = db.execute(sql)
                    while got := found.fetchmany(_BATCH):
                        yield pa.RecordBatch.from_arrays([pa.array([None if v is None else str(v) for v in c], pa.string()) for c in zip(*got, strict=True)], names=names)

    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, fields)


def read_ddf(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every level's table, and Levels, with column names as in the file; all values as text."""
    tables = [r.name for r in _sqlite(spark, path, "SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name LIKE 'L%'", ["name"]).collect()]
    if "Levels" not in tables:
        raise KeyError("no table Levels: the file may be empty")
    out = {}
    for t in tables:
        names = [r.name for r in _sqlite(spark, path, f"SELECT name FROM pragma_table_info('{t}')", ["name"]).collect()]
        listed = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
        out[t] = _sqlite(spark, path, f'SELECT {listed} FROM "{t}"', names)
    return out


def ole_timestamp(days: Column) -> Column:
    """A day number since 1899-12-30 as a timestamp."""
    return F.timestamp_millis(F.round((days.try_cast("double") - 25569) * 86_400_000).cast("long"))


def _typed(column: str, kind: str | None) -> Column:
    c = quoted(column)
    if kind == SET:
        return _or_null(F.transform(F.filter(F.split(c, ";"), lambda x: F.trim(x) != ""), lambda x: x.try_cast("double").cast("int")))
    if kind == SINGLE:
        n = F.replace(c, F.lit(";"), F.lit("")).try_cast("double").cast("int")
        return F.when(n != -1, n)
    if kind == DATE:
        return ole_timestamp(c)
    if kind == BOOLEAN:
        return F.coalesce(c.try_cast("double") != 0, F.lower(c) == "true")
    return c.try_cast({INT: "long", FLOAT: "double"}.get(kind, "string"))


def _levels(tables: dict[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(table, name, parent's name) of each level; the first is the respondent."""
    rows = tables["Levels"].collect()
    name = {r.TableName: "HDATA" if r.TableName == "L1" else r.DSCTableName for r in rows}
    return [(r.TableName, name[r.TableName], "" if r.TableName == "L1" else name.get(r.ParentName, "HDATA")) for r in rows]


def _cleaned(df: DataFrame, depth: int) -> tuple[DataFrame, list[str]]:
    """id0 (respondent) ... id<depth> (row of this level), level (element's number), and the fields, typed."""
    names = df.columns
    ids = names[: depth + 1]
    fields = names[depth + 2 :]
    made = [quoted(n).alias(f"id{i}") for i, n in enumerate(ids)] + [F.replace(quoted(names[depth + 1]), F.lit(";"), F.lit("")).alias("level")]
    plain = []
    for f in fields:
        base, _, suffix = f.rpartition(":")
        made.append(_typed(f, DATA_TYPES.get(suffix)).alias(base or f))
        plain.append(base or f)
    return df.select(*made), plain


def as_columns(child: DataFrame, fields: list[str], elements: list[str], name_of, parent: DataFrame | None = None, outer: list[str] | None = None) -> DataFrame:
    """A loop's rows as columns of its respondent: one for each element (pair of elements) and field, in one aggregation."""
    if parent is not None:
        child = child.join(parent.select(F.col("id0").alias("__r"), F.col("id1").alias("__p"), F.col("level").alias("outer")), (F.col("id0") == F.col("__r")) & (F.col("id1") == F.col("__p")))
    asked = []
    for f in fields:
        for e in elements:
            for o in outer or [None]:
                hit = F.col("level") == e if o is None else (F.col("level") == e) & (F.col("outer") == o)
                asked.append(F.first(F.when(hit, quoted(f)), ignorenulls=True).alias(name_of(f, e, o)))
    return child.groupBy("id0").agg(*asked)


# ----------------------------------------------------------------------- metadata


class Mdd:
    """The parts of a metadata file that are looked up."""

    def __init__(self, text: str):
        self.root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
        strip = lambda e: e.tag.rsplit("}", 1)[-1]
        for e in self.root.iter():
            e.tag = strip(e)
        self.definitions: dict[str, ET.Element] = {}
        self.by_id: dict[str, ET.Element] = {}
        for d in self.root.iter("definition"):
            for v in d.iter("variable"):
                self.definitions.setdefault(v.get("name"), v)
                self.by_id[v.get("id")] = v
        self.numbers = {c.get("name").lower(): int(c.get("value")) for m in self.root.iter("categorymap") for c in m.iter("categoryid")}
        self.names = {n: c for c, n in self.numbers.items()}
        self.loops = {e.get("name"): e for d in self.root.iter("design") for e in d.iter() if e.tag in ("loop", "grid")}
        languages = next(self.root.iter("languages"), None)
        base = (languages.get("base") if languages is not None else "en-GB").split("-")
        self.language = f"{base[0].lower()}-{base[1]}" if len(base) > 1 else base[0].lower()
        fields = next((f for d in self.root.iter("design") for f in d.iter("fields")), None)
        self.order = [e.get("name") for e in fields if e.tag in ("variable", "loop", "grid")] if fields is not None else []

    @staticmethod
    def texts(e: ET.Element | None) -> dict[str, str]:
        own = e.find("labels") if e is not None else None
        return {} if own is None else {t.get(_LANG): t.text or "" for t in own.iter("text") if t.get(_LANG)}

    @staticmethod
    def properties(e: ET.Element) -> dict[str, str]:
        own = e.find("properties")
        return {} if own is None else {p.get("name"): p.get("value") for p in own if p.get("name") not in OWN_PROPERTIES}

    def values(self, variable: ET.Element) -> tuple[list[Value], dict[int, int]]:
        """Codes by the categories' names (``...a5``, ``...aminus1``), else by a native value, else by place; and the file's numbers of them."""
        categories = [c for own in variable.iter("categories") for c in own if c.tag == "category"]
        endings = [re.search(r"a(minus)?(\d+)$", c.get("name")) for c in categories]
        native = [{p.get("name"): p.get("value") for p in c.iter("property")} for c in categories]
        codes: list[int] = []
        if all(endings):
            codes = [-int(m[2]) if m[1] else int(m[2]) for m in endings]
        for key in ("NativeValue", "Value"):
            if (not codes or len(set(codes)) < len(codes)) and native and all(key in n for n in native):
                codes = [int(n[key]) for n in native]
        if not codes or len(set(codes)) < len(codes):
            codes = list(range(1, len(categories) + 1))
        made, numbers = [], {}
        for code, c in zip(codes, categories, strict=True):
            factor = c.get("factor-value")
            made.append(Value(code, self.texts(c), float(factor) if factor else None, {}, self.properties(c)))
            if (n := self.numbers.get(c.get("name").lower())) is not None:
                numbers[n] = code
        return made, numbers

    def kind(self, variable: ET.Element) -> str:
        kind = META_TYPES.get(variable.get("type"), STRING)
        if kind != "categorical":
            return kind
        several = len([c for own in variable.iter("categories") for c in own if c.tag == "category"]) > 1
        return SET if variable.get("max") != "1" and several else SINGLE

    def field(self, loop: str, name: str) -> ET.Element | None:
        """A loop's field by its reference: several loops may have fields of one name."""
        own = self.loops.get(loop)
        for v in own.iter("variable") if own is not None else ():
            if v.get("name") == name and v.get("ref") in self.by_id:
                return self.by_id[v.get("ref")]
        return self.definitions.get(name)

    def elements(self, loop: str) -> dict[str, dict[str, str]]:
        """Name in lower case -> texts."""
        own = self.loops.get(loop)
        first = next(own.iter("categories"), None) if own is not None else None
        return {} if first is None else {c.get("name").lower(): self.texts(c) for c in first if c.tag == "category"}


def _mapped(column: Column, kind: str, numbers: dict[int, int]) -> Column:
    """File numbers as codes; unknown ones go."""
    if not numbers:
        return column
    pairs = F.create_map(*[F.lit(v) for n, c in numbers.items() for v in (n, c)])
    if kind == SET:
        return _or_null(F.array_sort(F.array_compact(F.transform(column, lambda x: F.try_element_at(pairs, x)))))
    return F.try_element_at(pairs, column)


def read_dimensions(spark: SparkSession, path_mdd: str, path_ddf: str, fields: list[str] | None = None, grids: list[str] | None = None) -> Survey:
    """Respondents with all their loops as grids."""
    mdd = Mdd(load_text(spark, path_mdd))
    tables = read_ddf(spark, path_ddf)
    levels = _levels(tables)
    base, plain = _cleaned(tables["L1"], 0)
    base = base.select("id0", *[quoted(f) for f in plain if fields is None or f in fields])
    table_of = {name: t for t, name, _ in levels}
    parent_of = {name: p for _, name, p in levels}
    items: dict[str, list[tuple[str, str, str]]] = {}  # grid -> (column, field, element)
    for name in grids or [n for n, p in parent_of.items() if p == "HDATA"]:
        child = next((n for n, p in parent_of.items() if p == name), None)
        elements = {e: str(mdd.numbers[e]) for e in mdd.elements(name) if e in mdd.numbers}
        if child is None:
            rows, own = _cleaned(tables[table_of[name]], 1)
            if not own or not elements:
                continue
            back = {n: e for e, n in elements.items()}
            title = lambda f, e, _, name=name, back=back: f"{name}[{{{back[e]}}}].{f}"
            wide = as_columns(rows, own, list(elements.values()), title)
            for f in own:
                items[f"{name}.{f}"] = [(title(f, n, None), f, e) for e, n in elements.items()]
        else:
            outer_rows, _ = _cleaned(tables[table_of[name]], 1)
            rows, own = _cleaned(tables[table_of[child]], 2)
            inner = {e: str(mdd.numbers[e]) for e in mdd.elements(child) if e in mdd.numbers}
            if not own or not elements or not inner:
                continue
            back_o, back_i = {n: e for e, n in elements.items()}, {n: e for e, n in inner.items()}
            title = lambda f, e, o, name=name, child=child, a=back_o, b=back_i: f"{name}[{{{a[o]}}}].{child}[{{{b[e]}}}].{f}"
            wide = as_columns(rows, own, list(inner.values()), title, outer_rows, list(elements.values()))
            for f in own:
                items[f"{name}.{child}.{f}"] = [(title(f, i, o), f, f"{eo} - {ei}") for eo, o in elements.items() for ei, i in inner.items()]
        base = base.join(wide.withColumnRenamed("id0", "__of"), F.col("id0") == F.col("__of"), "left").drop("__of")
    meta = Meta(mdd.language, path_mdd.rsplit("/", 1)[-1].split(".")[0])
    meta.languages = list(dict.fromkeys([*meta.languages, mdd.language]))
    changed: dict[str, Column] = {}
    for c in [c for c in base.columns if c != "id0" and "[{" not in c]:
        variable = mdd.definitions.get(c)
        if variable is None:
            continue
        kind = mdd.kind(variable)
        values, numbers = mdd.values(variable) if kind in (SINGLE, SET) else (None, {})
        meta.columns[c] = Variable(c, kind, mdd.texts(variable) or {mdd.language: c}, values, properties=mdd.properties(variable))
        changed[c] = _mapped(_as_kind(base, c, kind), kind, numbers)
    for grid, own in items.items():
        loop, field = grid.split(".")[0], own[0][1]
        variable = mdd.field(grid.split(".")[-2], field)
        kind = mdd.kind(variable) if variable is not None else STRING
        values, numbers = mdd.values(variable) if variable is not None and kind in (SINGLE, SET) else (None, {})
        labels = {**mdd.elements(loop)}
        for column, _, element in own:
            text = labels.get(element) or {mdd.language: element}
            meta.columns[column] = Variable(column, kind, dict(text), values, parent=grid)
            changed[column] = _mapped(_as_kind(base, column, kind), kind, numbers)
        meta.grids[grid] = Grid(grid, kind, mdd.texts(mdd.loops.get(loop)) or {mdd.language: grid}, values, properties=mdd.properties(mdd.loops[loop]), items=[c for c, _, _ in own])
    meta.sets["data file"] = [n for o in mdd.order for n in ([o] if o in meta.columns else [g for g in meta.grids if g.startswith(f"{o}.")])]
    meta.sets["data file"] += [c for c in meta.columns if not meta.is_item(c) and c not in meta.sets["data file"]]
    return Survey(base.withColumns(changed).withColumnRenamed("id0", "id_L1"), meta)


def _as_kind(df: DataFrame, name: str, kind: str) -> Column:
    """Where the data file has a set of one, or text, for what the metadata call a single."""
    have = df.schema[name].dataType.simpleString()
    c = quoted(name)
    if kind == SINGLE and have == "array<int>":
        return F.try_element_at(c, F.lit(1))
    if kind == SET and have == "int":
        return F.when(c.isNotNull(), F.array(c))
    return c


def verify_columns(survey: Survey) -> tuple[list[str], list[str]]:
    """Columns that the data lack, and columns that the metadata lack."""
    return [c for c in survey.meta.columns if c not in survey.df.columns], [c for c in survey.df.columns if c not in survey.meta.columns and c != "id_L1"]


# ------------------------------------------------------------------------- writing


def category_name(variable: str, code: int) -> str:
    return f"{variable}aminus{-code}" if code < 0 else f"{variable}a{code}"


def category_text(column: Column, variable: str, kind: str) -> Column:
    """Codes as category names, several joined by ``;``."""
    name = lambda c: F.when(c < 0, F.concat(F.lit(f"{variable}aminus"), (-c).cast("string"))).otherwise(F.concat(F.lit(f"{variable}a"), c.cast("string")))
    return F.array_join(F.transform(column, name), ";") if kind == SET else name(column)


def _labels(target: str, text: dict[str, str], languages: dict[str, str]) -> list[str]:
    said = lambda t: t.replace('"', '""').replace("\n", " ")
    return [f'{target}.Labels("Label").Text("Analysis", "{languages.get(k, k)}") = "{said(t)}"' for k, t in text.items()]


#: The converters' names of languages.
SCRIPT_LANGUAGES = {"en-GB": "ENG", "en-US": "ENU", "de-DE": "DEU", "fr-FR": "FRA", "es-ES": "ESN", "it-IT": "ITA", "da-DK": "DAN", "sv-SE": "SVE", "nb-NO": "NOR", "fi-FI": "FIN", "pl-PL": "PLK", "tr-TR": "TRK"}


def _categories(variable: str, kind: str, values: list[Value]) -> list[str]:
    out = [f"newVar.MaxValue = {1 if kind == SINGLE else len(values)}"]
    for v in values:
        out += [f'Set newElement = MDM.CreateElement("{category_name(variable, v.code)}")', *_labels("newElement", v.text, SCRIPT_LANGUAGES), "newElement.Type = 0", "newVar.Elements.Add(newElement)"]
    return out


def metadata_script(meta: Meta, path_mdd: str, suffix: str = "_grid") -> str:
    """A script that makes the metadata file."""
    lines = ["Dim MDM, newVar, newElement, newGrid", 'Set MDM = CreateObject("MDM.Document")']
    lines += [f'MDM.Languages.Add("{SCRIPT_LANGUAGES.get(k, k)}")' for k in meta.used_text_keys()]
    lines.append(f'MDM.Languages.Current = "{SCRIPT_LANGUAGES.get(meta.text_key, meta.text_key)}"')
    for n in meta.sets["data file"]:
        own = meta[n]
        name = n.split(".")[0]
        lines += ["", f"' {name}"]
        if n in meta.grids:
            lines += [f'Set newGrid = MDM.CreateGrid("{name}")', *_labels("newGrid", own.text, SCRIPT_LANGUAGES)]
            for i in own.items:
                element = m[1] if (m := re.search(r"\[\{(.+?)\}\]", i)) else i
                lines += [f'Set newElement = MDM.CreateElement("{element}")', *_labels("newElement", meta.columns[i].text, SCRIPT_LANGUAGES), "newGrid.Elements.Add(newElement)"]
            variable, into = f"{name}{suffix}", "newGrid"
        else:
            variable, into = name, "MDM"
        lines += [f'Set newVar = MDM.CreateVariable("{variable}")', f"newVar.DataType = {SCRIPT_TYPES.get(own.type, 'mr.Text')}"]
        if n not in meta.grids:
            lines += _labels("newVar", own.text, SCRIPT_LANGUAGES)
        if own.values is not None:
            lines += _categories(name, own.type, own.values)
        lines.append(f"{into}.Fields.Add(newVar)")
        if n in meta.grids:
            lines.append("MDM.Fields.Add(newGrid)")
    return "\n".join([*lines, "", f'MDM.Save("{path_mdd}")'])


def data_script(master: str, crlf: str = "CR") -> str:
    """A script that loads the CSV inputs into a data file."""
    return "\n".join([
        f'#define MASTER_INPUT "{master}"', f'#define CRLF "{crlf}"',
        "InputDatasource(Input)", '    ConnectionString = "Provider=mrOleDB.Provider.2; Data Source=mrCsvDsc; Location=" + MASTER_INPUT + "_paired.csv"', "End InputDatasource",
        "OutputDatasource(Output)", '    ConnectionString = "Provider=mrOleDB.Provider.2; Data Source=mrDataFileDsc; Location=" + MASTER_INPUT + ".ddf"', '    MetaDataOutputName = MASTER_INPUT + ".mdd"', "End OutputDatasource",
    ])


def datastore(survey: Survey) -> DataFrame:
    """Case data as the converters take them: category names, numbers or NULL, text without commas and line ends."""
    made = []
    for n, v in survey.meta.columns.items():
        c, variable = quoted(n), n.split("[{")[0] if "[{" in n else (v.parent or n)
        if v.type in (SINGLE, SET):
            made.append(F.coalesce(category_text(c, variable, v.type), F.lit("")).alias(n))
        elif v.type in (INT, FLOAT):
            made.append(F.coalesce(c.cast("string"), F.lit("NULL")).alias(n))
        else:
            text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "\r\n|\n", "")
            made.append(F.replace(text, F.lit(","), F.lit(">_>_>")).alias(n))
    return survey.df.select(*made)


def write_dimensions(survey: Survey, path: str, text_key: str | None = None, crlf: str = "CR") -> None:
    """In folder ``path``: create_mdd, create_ddf (scripts), paired (a header) and datastore (CSV parts)."""
    made = survey.clone()
    if text_key:
        made.meta.select_text_keys(text_key)
        made.meta.text_key = text_key
    name = made.meta.name or "survey"
    spark = survey.spark
    for part, text in (("create_mdd", metadata_script(made.meta, f"{name}.mdd")), ("create_ddf", data_script(name, crlf)), ("paired", "\t".join(made.meta.columns))):
        spark.createDataFrame([(text,)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/{part}")
    datastore(made).write.mode("overwrite").csv(f"{path}/datastore", header=True)
