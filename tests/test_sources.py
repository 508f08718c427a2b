"""Round trips and small exports."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tallyloom.audit import Audit
from tallyloom.meta import Meta
from tallyloom.sources import dimensions, documents, exports, spss
from tallyloom.survey import Survey


@pytest.fixture
def small(spark):
    df = spark.createDataFrame(
        [(1, 1, [1, 3], 2.5, "a, \"b\"\nc", 1, 2), (2, 2, None, None, None, None, 1), (3, None, [2], -1.0, "ü", 2, None)],
        "id long, sex int, likes array<int>, cost double, say string, g_1 int, g_2 int",
    ).withColumn("at", F.expr("timestamp '2020-03-04 05:06:07'"))
    meta = Meta("en-GB", "small")
    meta.add("id", "int", "Number")
    meta.add("sex", "single", "Sex", [(1, "m"), (2, "f")])
    meta.add("likes", "delimited set", "Likes", [(1, "red"), (2, "green"), (3, "blue")])
    meta.add("cost", "float", "Cost")
    meta.add("say", "string", "Said")
    meta.add("g", "single", "Grid", [(1, "no"), (2, "yes")], ["one", "two"])
    meta.add("at", "date", "When")
    return Survey(df, meta)


def rows(survey, *names):
    return sorted(tuple(r) for r in survey.df.select(*names).collect())


def test_document_round_trip(small, tmp_path, spark):
    documents.write_survey(small, f"{tmp_path}/m", f"{tmp_path}/d")
    back = documents.read_survey(spark, f"{tmp_path}/m", f"{tmp_path}/d")
    names = ("id", "sex", "likes", "cost", "say", "g_1", "g_2", "at")
    assert repr(rows(back, *names)) == repr(rows(small, *names))
    assert back.meta.grids["g"].items == ["g_1", "g_2"] and back.meta.columns["g_1"].values is back.meta.grids["g"].values
    assert documents.to_document(back.meta) == documents.to_document(small.meta)


def test_parquet_round_trip(small, tmp_path, spark):
    documents.save_parquet(small, f"{tmp_path}/p")
    back = documents.load_parquet(spark, f"{tmp_path}/p")
    assert repr(rows(back, "id", "likes", "at")) == repr(rows(small, "id", "likes", "at"))


def test_shared_lists_references_and_missing_codes():
    document = {
        "lib": {"default text": "en-GB", "text": {"dk": ["Don't know", "weiss nicht"]}, "values": {"core": {"dk": [{"value": 97, "text": ["lib@text@dk"], "missing": True}]}, "q": [{"value": 1, "text": {"en-GB": "x"}}]}},
        "columns": {"a": {"type": "single", "text": {"en-GB": "A"}, "values": ["lib@values@core@dk", {"value": 2, "text": {"en-GB": "two"}}]}, "b": {"type": "single", "text": "B", "values": "lib@values@q"}},
        "masks": {"m": {"type": "array", "text": "M", "items": [{"source": "columns@b", "text": "b"}]}},
        "sets": {"data file": {"items": ["columns@a", "sets@more"]}, "more": {"items": ["masks@m", "sets@data file"]}},
    }
    meta = documents.from_document(document)
    assert meta.codes("a") == [97, 2] and meta["a"].missings == {97: "exclude"}
    assert meta["a"].values[0].text["en-GB"] == "Don't know"
    assert meta.sets["data file"] == ["a", "m"] and meta.codes("m") == [1]


def test_types_and_coercion(spark):
    df = spark.createDataFrame([(1.0, "x")], "a double, b string")
    meta = Meta()
    meta.add("a", "int", "A")
    meta.add("b", "float", "B")
    assert [(n, ok) for n, _, _, ok in documents.verify_types(df, meta)] == [("a", True), ("b", False)]
    assert documents.coerce_types(df, meta).schema["a"].dataType.simpleString() == "bigint"


def test_spss_round_trip(small, tmp_path, spark):
    small.df = small.df.withColumn("say", F.when(F.col("id") == 1, F.repeat(F.lit("long text "), 40)).otherwise(F.col("say")))
    spss.write_spss(small, f"{tmp_path}/s.sav")
    back = spss.read_spss(spark, f"{tmp_path}/s.sav", "en-GB")
    got = rows(back, "id", "sex", "likes", "cost", "say", "g_1", "g_2")
    want = [(i, s, li, c, (t or "").strip() or None, a, b) for i, s, li, c, t, a, b in rows(small, "id", "sex", "likes", "cost", "say", "g_1", "g_2")]
    # a null set and an empty one are both no answer; members count from one in order
    assert got == want
    assert back.meta["likes"].type == "delimited set" and list(back.meta.value_texts("likes").values()) == ["red", "green", "blue"]
    assert back.meta.value_texts("sex") == {1: "m", 2: "f"} and back.meta.text("cost") == "Cost"


def test_spss_bytecode_and_sets():
    d = spss.Dictionary([spss.SavVariable("a", 0), spss.SavVariable("t", 4)], 1, 100.0, 2, "<", "utf-8", 0, [])
    raw = bytes([101, 253, 255, 254, 252, 0, 0, 0]) + b"abcd    "
    assert list(spss.read_records(raw, d)) == [[1.0, "abcd"], [None, ""]]
    sets = spss._sets("$a=C 5 hello v1 v2\n$b=D1 1 0  v3 v4\n", {"V1": "one", "V2": "two"})
    assert sets[0] == {"name": "a", "kind": "C", "counted": None, "label": "hello", "variables": ["one", "two"]}
    assert (sets[1]["kind"], sets[1]["counted"], sets[1]["label"], sets[1]["variables"]) == ("D", "1", "", ["v3", "v4"])
    assert spss.clean_name("2 b?", {"v2_b_"}) == "v2_b" and spss.clean_name("x", {"x"}) == "x_1"


def test_decipher(spark, tmp_path):
    v = lambda label, group, kind, **more: {"label": label, "vgroup": group, "type": kind, "title": f"t {label}", **more}
    codes = [{"value": 1, "title": "one"}, {"value": 2, "title": "two"}]
    single, multi = v("q1", "q1", "single", values=codes), [v(f"q2r{i}", "q2", "multiple", rowTitle=f"row {i}") for i in (1, 2, 5)]
    grid = [v(f"q3r{i}", "q3", "single", values=codes, rowTitle=f"item {i}") for i in (1, 2)]
    document = {
        "variables": [v("n", "n", "number"), single, *multi, *grid],
        "questions": [{"type": "single", "qtitle": "Q1", "qlabel": "q1", "variables": [single]}, {"type": "multiple", "qtitle": "Q2", "qlabel": "q2", "variables": multi}, {"type": "single", "qtitle": "Q3", "qlabel": "q3", "variables": grid}],
    }
    (tmp_path / "m.json").write_text(json.dumps(document))
    (tmp_path / "d.txt").write_text("n\tq1\tq2r1\tq2r2\tq2r5\tq3r1\tq3r2\n7\t2\t1\t0\t1\t1\t2\n8\t\t0\t0\t0\t\t1\n")
    s = exports.read_decipher(spark, f"{tmp_path}/m.json", f"{tmp_path}/d.txt")
    assert rows(s, "n", "q1", "q2", "q3r1") == [(7, 2, [1, 5], 1), (8, None, None, None)]
    assert s.meta.sets["data file"] == ["n", "q1", "q2", "q3"] and s.meta.grids["q3"].items == ["q3r1", "q3r2"]
    assert s.meta.value_texts("q2") == {1: "row 1", 2: "row 2", 5: "row 5"}


def test_ascribe(spark, tmp_path):
    form = lambda n, codes: f"<MultiForm><Name>{n}</Name><FormTexts><FormText><Title>x</Title><Text>Why {n}?</Text></FormText></FormTexts><Answers>{''.join(f'<Answer Precode=\"{c}\"><Texts><Text>a{c}</Text></Texts></Answer>' for c in codes)}</Answers></MultiForm>"
    (tmp_path / "a.xml").write_text(f"<CodedQuestions>{form('q1', [1, 2])}{form('q2', [1, 9])}{form('q3', [])}</CodedQuestions>")
    (tmp_path / "a.txt").write_text("responseid\tq1_1\tq1_2\tq2_1\tq2_9\n11\t1\t0\t1\t1\n12\t0\t1\t0\t0\n", encoding="utf-16")
    s = exports.read_ascribe(spark, f"{tmp_path}/a.xml", f"{tmp_path}/a.txt")
    assert rows(s, "responseid", "q1", "q2") == [(11, 1, [1, 9]), (12, 2, None)]
    assert s.meta["q1"].type == "single" and s.meta.text("q2") == "Why q2?"


MDD = """<?xml version="1.0"?><xml xmlns:mdm="http://example.org/mdm"><mdm:metadata><languages base="EN-GB"/>
<definition>
 <variable id="1" name="sex" type="3" max="1"><labels><text xml:lang="en-GB">Sex</text></labels><categories><category name="sexa1"><labels><text xml:lang="en-GB">Male</text></labels></category><category name="sexa2" factor-value="5"><labels><text xml:lang="en-GB">Female</text></labels></category></categories></variable>
 <variable id="2" name="likes" type="3"><labels><text xml:lang="en-GB">Likes</text></labels><categories><category name="red"/><category name="blue"/></categories></variable>
 <variable id="3" name="when" type="5"><labels><text xml:lang="en-GB">When</text></labels></variable>
 <variable id="4" name="rate" type="3" max="1"><labels><text xml:lang="en-GB">Rate</text></labels><categories><category name="ratea1"/><category name="rateaminus1"/></categories></variable>
</definition>
<design><fields><variable name="sex" ref="1"/><loop name="brands"><labels><text xml:lang="en-GB">Brands</text></labels><categories><category name="X"><labels><text xml:lang="en-GB">Brand X</text></labels></category><category name="Y"/></categories><fields><variable name="rate" ref="4"/></fields></loop><variable name="likes" ref="2"/><variable name="when" ref="3"/></fields></design>
<categorymap><categoryid name="sexa1" value="11"/><categoryid name="sexa2" value="12"/><categoryid name="red" value="21"/><categoryid name="blue" value="22"/><categoryid name="ratea1" value="31"/><categoryid name="rateaminus1" value="32"/><categoryid name="x" value="41"/><categoryid name="y" value="42"/></categorymap>
</mdm:metadata></xml>"""


def test_dimensions(spark, tmp_path):
    (tmp_path / "s.mdd").write_text(MDD)
    db = sqlite3.connect(tmp_path / "s.ddf")
    db.executescript("""
      CREATE TABLE Levels(TableName TEXT, ParentName TEXT, DSCTableName TEXT);
      INSERT INTO Levels VALUES ('L1', '', 'HDATA'), ('L2', 'L1', 'brands');
      CREATE TABLE L1(":P0" INTEGER, "LevelId" TEXT, "sex:C1" INTEGER, "likes:S" TEXT, "when:T" REAL);
      INSERT INTO L1 VALUES (1, '1', 12, '22;21;', 43831.5), (2, '2', -1, '99;', NULL);
      CREATE TABLE L2(":P0" INTEGER, ":P1" INTEGER, "LevelId" TEXT, "rate:C1" TEXT);
      INSERT INTO L2 VALUES (1, 1, '41;', '31'), (1, 2, '42;', '32'), (2, 3, '41;', '32');
    """)
    db.commit()
    db.close()
    s = dimensions.read_dimensions(spark, f"{tmp_path}/s.mdd", f"{tmp_path}/s.ddf")
    got = {r.id_L1: r for r in s.df.collect()}
    assert (got["1"].sex, got["1"].likes, str(got["1"].when)) == (2, [1, 2], "2020-01-01 12:00:00")
    assert (got["2"].sex, got["2"].likes) == (None, None)
    assert got["1"]["brands[{x}].rate"] == 1 and got["1"]["brands[{y}].rate"] == -1 and got["2"]["brands[{x}].rate"] == -1
    assert s.meta.sets["data file"] == ["sex", "brands.rate", "likes", "when"]
    assert s.meta.value_texts("sex") == {1: "Male", 2: "Female"} and s.meta.factors("sex") == {2: 5.0}
    assert s.meta.text("brands[{x}].rate") == "Brand X" and s.meta.codes("brands.rate") == [1, -1]
    assert dimensions.verify_columns(s) == ([], [])
    script = dimensions.metadata_script(s.meta, "o.mdd")
    assert 'MDM.CreateGrid("brands")' in script and '"brandsaminus1"' in script and script.endswith('MDM.Save("o.mdd")')
    first = dimensions.datastore(s).orderBy("sex").collect()[-1]
    assert first["sex"] == "sexa2" and first["likes"] == "likesa1;likesa2"
    dimensions.write_dimensions(s, f"{tmp_path}/out")
    assert spark.read.csv(f"{tmp_path}/out/datastore", header=True).count() == 2


def test_audit(small, tmp_path):
    other = small.clone()
    other.rename("cost", "COST")
    other.meta.remove_values("sex", [2])
    other.meta.set_variable_text("likes", "Something else", "en-GB")
    other.drop("say")
    a = Audit({"a": small, "b": other})
    assert {m["name"] for m in a.mismatches()} == {"cost", "COST", "say"}
    assert a.report_cat_diffs()[0]["name"] == "sex" and a.report_label_diffs()[0]["name"] == "likes"
    a.rename_by("a")
    assert "cost" in other.meta and "cost" in other.df.columns
    a.align_cats_by("sex", "en-GB", "a", extend=True, reorder=True)
    assert other.meta.codes("sex") == [1, 2]
    a.relabel_by("likes", "en-GB", "a")
    a.fill_mismatches_by("a")
    assert other.df.columns.count("say") == 1 and not a.mismatches()
    assert not (a.report_type_diffs() or a.report_cat_diffs() or a.report_label_diffs() or a.report_item_diffs() or a.report_cat_text_diffs() or a.report_item_text_diffs())
    a.save(f"{tmp_path}/kept")
