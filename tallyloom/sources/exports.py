"""Exports of fieldwork tools: a JSON questionnaire with tab-separated data, and coded verbatims as XML with UTF-16 data."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import FLOAT, INT, SET, SINGLE, STRING, Grid, Meta, Value, Variable
from ..operators.recode import compact
from ..plans.tabulate import quoted
from ..survey import Survey
from .documents import load_json, typed

#: Questionnaire types and what they are here.
DECIPHER_TYPES = {"text": STRING, "number": INT, "float": FLOAT, "single": SINGLE, "multiple": SET}


def _columns(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, encoding=encoding, multiLine=encoding != "UTF-8")


def _set_of(columns: dict[int, str]) -> Column:
    """The codes whose 0/1 columns are 1."""
    return compact([F.when(quoted(c).try_cast("double") == 1, F.lit(code)) for code, c in columns.items()])


def _code(label: str, at: int) -> int:
    """The number a label ends with, else the place."""
    m = re.search(r"(\d+)$", label)
    return int(m[1]) if m else at


# ------------------------------------------------------------------------ decipher


def read_decipher(spark: SparkSession, path_json: str, path_txt: str, text_key: str = "main") -> Survey:
    """Variables as they are; multiple-choice questions as sets, questions of several like variables as grids, quota markers as singles."""
    document = load_json(spark, path_json)
    rows = _columns(spark, path_txt)
    meta = Meta(text_key)
    names = set(rows.columns)
    quotas: dict[str, list[dict]] = {}
    for var in document["variables"]:
        if any(q in var["vgroup"] for q in ("vqtable", "voqtable")):
            quotas.setdefault(var["vgroup"], []).append(var)
        name = var["label"]
        if name not in names:
            continue
        values = [Value(int(v["value"]), {text_key: v["title"]}) for v in var.get("values", ())] if var["type"] == "single" else None
        kind = DECIPHER_TYPES[var["type"]]
        meta.columns[name] = Variable(name, INT if kind == SET else kind, {text_key: var["title"]}, values)
        meta.sets["data file"].append(name)
    df = typed(rows, meta)
    made: dict[str, Column] = {}
    for question in document["questions"]:
        variables = [v for v in question["variables"] if v["label"] in names]
        if len(variables) < 2:
            continue
        groups: dict[str, list[dict]] = {}
        for v in variables:
            groups.setdefault(v["vgroup"], []).append(v)
        if question["type"] == "multiple":
            sets = []
            for group, own in groups.items():
                if any(v["type"] != "multiple" for v in own):
                    continue
                by = {_code(v["label"], i): v for i, v in enumerate(own, 1)}
                made[group] = _set_of({c: v["label"] for c, v in by.items()})
                title = own[0].get("rowTitle") or question["qtitle"] if len(groups) > 1 else question["qtitle"]
                meta.columns[group] = Variable(group, SET, {text_key: title}, [Value(c, {text_key: v.get("colTitle") or v.get("rowTitle") or v["title"]} if len(groups) > 1 else {text_key: v.get("rowTitle") or v["title"]}) for c, v in by.items()])
                _replace(meta.sets["data file"], [v["label"] for v in own], group)
                sets.append(group)
            if len(sets) > 1:
                _grid(meta, re.sub(r"[cr]\d+$", "", sets[0]) or question["qlabel"], sets, question["qtitle"], text_key)
            continue
        if len({v["type"] for v in variables}) > 1:
            meta.sets[question.get("qlabel") or next(iter(groups))] = [v["label"] for v in variables]
        for group, own in groups.items():
            alike = len({(v["type"], tuple(int(x["value"]) for x in v.get("values", ()))) for v in own}) == 1
            if len(own) > 1 and alike:
                _grid(meta, group if group not in meta.columns else f"{group}_grid", [v["label"] for v in own], question["qtitle"], text_key, [v.get("rowTitle") or v["title"] for v in own])
    for group, own in quotas.items():
        marks = [v for v in own if v["label"] in names]
        if not marks or group in meta:
            continue
        hits = [F.when(quoted(v["label"]).isNotNull() & ~quoted(v["label"]).cast("string").isin("0", ""), F.lit(i)) for i, v in enumerate(marks, 1)]
        made[group] = F.coalesce(*hits)
        meta.columns[group] = Variable(group, SINGLE, {text_key: group}, [Value(i, {text_key: v.get("rowTitle") or v["title"]}) for i, v in enumerate(marks, 1)])
        _replace(meta.sets["data file"], [v["label"] for v in marks], group)
    return Survey(df.withColumns(made) if made else df, meta)


def _replace(names: list[str], gone: Iterable[str], new: str) -> None:
    gone = set(gone)
    at = min((i for i, n in enumerate(names) if n in gone), default=len(names))
    names[:] = [n for n in names[:at] if n not in gone] + [new] + [n for n in names[at:] if n not in gone and n != new]


def _grid(meta: Meta, name: str, items: list[str], text: str, text_key: str, labels: list[str] | None = None) -> None:
    first = meta.columns[items[0]]
    for i, label in zip(items, labels or [meta.columns[i].text[text_key] for i in items], strict=True):
        meta.columns[i].parent, meta.columns[i].values, meta.columns[i].text = name, first.values, {text_key: label}
    meta.grids[name] = Grid(name, first.type, {text_key: text}, first.values, items=list(items))
    _replace(meta.sets["data file"], items, name)


# ------------------------------------------------------------------------- ascribe


def read_ascribe(spark: SparkSession, path_xml: str, path_txt: str, text_key: str = "main") -> Survey:
    """Coded questions: 0/1 columns become a single where nobody has two codes, else a set. One pass finds which."""
    root = ET.fromstring(spark.read.format("binaryFile").load(path_xml).select("content").first()[0])
    rows = _columns(spark, path_txt, "UTF-16")
    key = rows.columns[0]
    meta = Meta(text_key)
    meta.columns["responseid"] = Variable("responseid", INT, {text_key: "responseid"})
    meta.sets["data file"] = ["responseid"]
    clean = lambda s: (s or "").replace("\n", " ")
    found: dict[str, dict[int, str]] = {}
    for form in root.iter("MultiForm"):
        name, answers = form.findtext("Name"), form.findall("./Answers/Answer")
        columns = {int(a.get("Precode")): f"{name}_{int(a.get('Precode'))}" for a in answers}
        columns = {c: n for c, n in columns.items() if n in rows.columns}
        if not columns:
            continue  # a question without codes has no variable
        found[name] = columns
        values = [Value(int(a.get("Precode")), {text_key: clean(a.findtext("./Texts/Text"))}) for a in answers if int(a.get("Precode")) in columns]
        meta.columns[name] = Variable(name, SET, {text_key: clean(form.findtext("./FormTexts/FormText/Text"))}, values)
        meta.sets["data file"].append(name)
    if not found:
        return Survey(rows.select(quoted(key).try_cast("long").alias("responseid")), meta)
    sets = {n: _set_of(c) for n, c in found.items()}
    df = rows.select(quoted(key).try_cast("long").alias("responseid"), *[c.alias(n) for n, c in sets.items()])
    most = df.agg(*[F.max(F.size(quoted(n))).alias(n) for n in found]).first()
    for n in found:
        if (most[n] or 0) <= 1:
            meta.columns[n].type = SINGLE
    return Survey(df.select("responseid", *[(F.try_element_at(quoted(n), F.lit(1)) if meta.columns[n].type == SINGLE else quoted(n)).alias(n) for n in found]), meta)
