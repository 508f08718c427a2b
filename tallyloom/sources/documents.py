"""Metadata documents (JSON) with case data as CSV, and Parquet with metadata beside it.

A document has ``columns``, ``masks`` (grids and other bundles), ``lib`` (shared value
lists and texts, referred to as ``lib@values@name``) and ``sets`` (ordered lists of
``columns@name`` and ``masks@name``). Sets of codes are ``"1;2;"`` in CSV.

Documents are small and read on the driver by Spark's own readers, so any store Spark
knows will do; case data never pass through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import BOOLEAN, DATE, FLOAT, INT, SET, SINGLE, SPARK_TYPES, STRING, TIME, Grid, Meta, Value, Variable
from ..operators.recode import format_set, parse_set
from ..plans.tabulate import quoted
from ..survey import Survey

_KINDS = {SINGLE, SET, INT, FLOAT, STRING, DATE, TIME, BOOLEAN}


def load_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(load_text(spark, path))


def save_json(spark: SparkSession, made: object, path: str) -> None:
    """One JSON text in a folder of that name."""
    spark.createDataFrame([(json.dumps(made, ensure_ascii=False),)], "json string").coalesce(1).write.mode("overwrite").text(path)


def load_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, encoding=encoding, multiLine=True, escape='"')


# ---------------------------------------------------------------------- documents


def _text(made, languages: list[str], texts: dict) -> dict[str, str]:
    """A label from a dict, a list in the order of the languages, a reference, or plain text."""
    if isinstance(made, dict):
        return {k: v for k, v in made.items() if isinstance(v, str)}
    if isinstance(made, list):
        if len(made) == 1 and isinstance(made[0], str) and made[0].startswith("lib@text@"):
            return _text(texts.get(made[0].split("@", 2)[2], ""), languages, texts)
        return {languages[i] if i < len(languages) else f"text{i}": t for i, t in enumerate(made)}
    if isinstance(made, str) and made.startswith("lib@text@"):
        return _text(texts.get(made.split("@", 2)[2], ""), languages, texts)
    return {languages[0]: made or ""}


def _edits(made) -> dict[str, dict[str, str]]:
    if not isinstance(made, dict):
        return {}
    return {axis.split()[0]: t for axis, t in made.items() if axis in ("x edits", "y edits") and isinstance(t, dict)}


class _Reader:
    def __init__(self, document: dict):
        self.document, self.lib = document, document.get("lib", {})
        mapped = self.lib.get("text map", {}).get("map", [])
        first = self.lib.get("default text", "main")
        self.languages = list(dict.fromkeys([first, *mapped])) if first in mapped or not mapped else [first, *mapped[1:]]
        self.shared: dict[str, list[Value]] = {}

    def value(self, v: dict) -> Value:
        text = v.get("text", "")
        return Value(int(v["value"]), _text(text, self.languages, self.lib.get("text", {})), v.get("factor"), _edits(text), v.get("properties") or {})

    def values(self, made, flags: dict[int, str]) -> list[Value] | None:
        if made is None:
            return None
        if isinstance(made, str):
            if made not in self.shared:
                own = self.lib.get("values", {})
                for part in made.split("@")[2:]:
                    own = own[part]
                self.shared[made] = [self.value(v) for v in self._flat(own, flags)]
            return self.shared[made]
        return [self.value(v) for v in self._flat(made, flags)]

    def _flat(self, made: list, flags: dict[int, str]) -> list[dict]:
        """Lists may hold references to further lists."""
        out = []
        for v in made:
            if isinstance(v, str):
                own = self.lib.get("values", {})
                for part in v.split("@")[2:]:
                    own = own[part]
                out += self._flat(own, flags)
            else:
                if v.get("missing"):
                    flags[int(v["value"])] = "exclude"
                out.append(v)
        return out

    def variable(self, name: str, own: dict, kind: type = Variable) -> Variable:
        flags: dict[int, str] = {}
        values = self.values(own.get("values"), flags)
        for code, flag in (own.get("missings") or {}).items():
            for c in flag if isinstance(flag, list) else [code]:
                flags[int(c)] = code if isinstance(flag, list) else flag
        text = own.get("text", "")
        parent = next(iter(own.get("parent") or {}), None)
        made = kind(name, own.get("subtype") or own.get("type"), _text(text, self.languages, self.lib.get("text", {})), values, parent.split("@", 1)[1] if parent else None, _edits(text), dict(own.get("properties") or {}), flags)
        made.rules = {a: dict(r) for a, r in (own.get("rules") or {}).items()}
        return made


def from_document(document: dict, columns: list[str] | None = None) -> Meta:
    """Metadata from a document; ``columns``: those of the data, the others are left out."""
    reader = _Reader(document)
    out = Meta(reader.languages[0], (document.get("info") or {}).get("name", ""))
    out.languages = list(dict.fromkeys([*out.languages, *reader.languages]))
    for name, own in document["columns"].items():
        if columns is not None and name not in columns:
            continue
        out.columns[name] = reader.variable(name, own)
        if out.columns[name].type not in _KINDS:
            out.columns[name].type = STRING
    for name, own in document.get("masks", {}).items():
        items = [i["source"].split("@", 1)[1] for i in own.get("items", ())]
        items = [i for i in items if i in out.columns]
        if not items:
            continue
        grid = reader.variable(name, own, Grid)
        grid.items = items
        first = out.columns[items[0]]
        grid.type = first.type
        grid.values = grid.values if grid.values is not None else first.values
        for spec, item in zip([i for i in own["items"] if i["source"].split("@", 1)[1] in items], items, strict=True):
            column = out.columns[item]
            column.parent = name
            if spec.get("text"):
                column.text = _text(spec["text"], reader.languages, reader.lib.get("text", {}))
            if [v.code for v in column.values or ()] == [v.code for v in grid.values or ()]:
                column.values = grid.values  # shared as long as the lists are equal
        out.grids[name] = grid
    for c in out.columns.values():
        if c.parent not in out.grids:
            c.parent = None
    batches = document.get("sets", {}).get("batches")
    out.batches = batches if isinstance(batches, dict) else {}
    for name, own in document.get("sets", {}).items():
        if isinstance(own, dict) and "items" in own and name not in out.grids:
            out.sets[name] = _resolved(document["sets"], name, out)
    if not out.sets.get("data file"):
        out.sets["data file"] = [n for n in [*out.columns] if not out.is_item(n)] + list(out.grids)
    return out


def _resolved(sets: dict, name: str, meta: Meta, seen: tuple[str, ...] = ()) -> list[str]:
    out: list[str] = []
    for item in sets[name]["items"]:
        kind, _, own = item.partition("@")
        if kind == "sets" and own in sets and own not in seen:
            out += _resolved(sets, own, meta, (*seen, name))
        elif own in meta:
            out.append(own)
    return list(dict.fromkeys(out))


def to_document(meta: Meta) -> dict:
    def text(t: dict, edits: dict) -> dict:
        return {**t, **{f"{a} edits": e for a, e in edits.items()}}

    def value(v: Value) -> dict:
        return {"value": v.code, "text": text(v.text, v.edits), **({"factor": v.factor} if v.factor is not None else {}), **({"properties": v.properties} if v.properties else {})}

    def variable(v: Variable) -> dict:
        made = {"name": v.name, "type": v.type, "text": text(v.text, v.edits), "parent": {}, "properties": v.properties}
        if v.rules:
            made["rules"] = v.rules
        if v.missings:
            made["missings"] = {str(c): f for c, f in v.missings.items()}
        return made

    ref = lambda n: f"masks@{n}" if n in meta.grids else f"columns@{n}"
    out: dict = {"type": "pandas.DataFrame", "info": {"name": meta.name}, "lib": {"default text": meta.text_key, "values": {}}, "columns": {}, "masks": {}, "sets": {}}
    for n, g in meta.grids.items():
        if g.values is not None:
            out["lib"]["values"][n] = [value(v) for v in g.values]
        made = variable(g) | {"type": "array", "subtype": g.type, "items": [{"source": f"columns@{i}", "text": text(meta.columns[i].text, meta.columns[i].edits), "properties": {}} for i in g.items]}
        out["masks"][n] = made | ({"values": f"lib@values@{n}"} if g.values is not None else {})
    for n, v in meta.columns.items():
        made = variable(v)
        if v.parent in meta.grids:
            made["parent"] = {f"masks@{v.parent}": {"type": "array"}}
        if v.values is not None:
            made["values"] = f"lib@values@{v.parent}" if v.parent in meta.grids and v.values is meta.grids[v.parent].values else [value(x) for x in v.values]
        out["columns"][n] = made
    for n, names in meta.sets.items():
        out["sets"][n] = {"text": n, "items": [ref(v) for v in names]}
    for n, g in meta.grids.items():
        out["sets"].setdefault(n, {"items": [f"columns@{i}" for i in g.items]})
    if meta.batches:
        out["sets"]["batches"] = meta.batches
    return out


# --------------------------------------------------------------------- case data


def typed(df: DataFrame, meta: Meta) -> DataFrame:
    """Text columns as their variables' types; what can't be read as a number or date is null. Unknown columns stay text."""
    made = []
    for c in df.columns:
        own = meta.columns.get(c)
        text = F.nullif(F.trim(quoted(c)), F.lit(""))
        if own is None:
            made.append(quoted(c))
        elif own.type == SET:
            made.append(parse_set(text).alias(c))
        elif own.type in (SINGLE, INT):
            made.append(text.try_cast("double").try_cast(SPARK_TYPES[own.type]).alias(c))
        elif own.type == DATE:
            made.append(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))).alias(c))
        elif own.type == BOOLEAN:
            made.append(text.try_cast("boolean").alias(c))
        else:
            made.append(text.try_cast(SPARK_TYPES[own.type]).alias(c))
    return df.select(*made)


def read_survey(spark: SparkSession, path_json: str, path_csv: str, reset: bool = True) -> Survey:
    """A document and its CSV. A first column without a name is a row number and goes. reset: only variables of the data."""
    rows = spark.read.csv(path_csv, header=True, inferSchema=False, multiLine=True, escape='"')
    if rows.columns and rows.columns[0] in ("_c0", ""):
        rows = rows.drop(rows.columns[0])
    meta = from_document(load_json(spark, path_json), rows.columns if reset else None)
    return Survey(typed(rows, meta), meta)


def flat(survey: Survey) -> DataFrame:
    """The case data with sets as ``"1;2;"`` and everything else as text."""
    made = []
    for c in survey.df.columns:
        own = survey.meta.columns.get(c)
        made.append(format_set(quoted(c)).alias(c) if own is not None and own.type == SET else quoted(c).cast("string").alias(c))
    return survey.df.select(*made)


def write_survey(survey: Survey, path_json: str, path_csv: str) -> None:
    save_json(survey.spark, to_document(survey.meta), path_json)
    flat(survey).write.mode("overwrite").csv(path_csv, header=True, escape='"')


def save_parquet(survey: Survey, path: str) -> None:
    """Case data typed as they are and split over files, the document beside them."""
    survey.df.write.mode("overwrite").parquet(f"{path}/data")
    save_json(survey.spark, to_document(survey.meta), f"{path}/meta")


def load_parquet(spark: SparkSession, path: str) -> Survey:
    return Survey(spark.read.parquet(f"{path}/data"), from_document(load_json(spark, f"{path}/meta")))


# ------------------------------------------------------------------- agreement


def verify_types(df: DataFrame, meta: Meta) -> list[tuple[str, str, str, bool]]:
    """(column, type in the data, type in the metadata, whether they agree)."""
    fits = {"int": {SINGLE, INT}, "bigint": {SINGLE, INT}, "double": {FLOAT, INT, SINGLE}, "float": {FLOAT}, "string": {STRING, TIME, DATE}, "timestamp": {DATE}, "date": {DATE}, "boolean": {BOOLEAN}, "array<int>": {SET}}
    return [(f.name, f.dataType.simpleString(), meta.columns[f.name].type, meta.columns[f.name].type in fits.get(f.dataType.simpleString(), ())) for f in df.schema.fields if f.name in meta.columns]


def coerce_types(df: DataFrame, meta: Meta) -> DataFrame:
    """Whole-number variables that the data hold as floats, as whole numbers."""
    wanted = {n: SPARK_TYPES[v.type] for n, v in meta.columns.items() if v.type in (SINGLE, INT) and n in df.columns and df.schema[n].dataType.simpleString() in ("double", "float")}
    return df.select(*[quoted(c).cast(wanted[c]).alias(c) if c in wanted else quoted(c) for c in df.columns])


def update_from_csv(survey: Survey, path: str, merge: bool = True, unique_key: str = "identity", sep: str = ",") -> Survey | DataFrame:
    """A sheet saved as CSV, merged by its key or returned as a survey of its own."""
    rows = load_csv(survey.spark, path, sep)
    other = Survey(rows, Meta.inferred(rows.schema, survey.meta.text_key))
    return survey.hmerge(other, on=unique_key) if merge else other
