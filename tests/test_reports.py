"""Batches, stacks, chains and sheets of a small survey."""

import re
import zipfile
from xml.etree import ElementTree as ET

import pytest

from tallyloom.functions.logic import has_any
from tallyloom.meta import Meta
from tallyloom.report import sheets, views
from tallyloom.report.batch import Batch, batches, get_batch
from tallyloom.report.chains import Chain, ChainManager, Cluster
from tallyloom.report.stack import Stack
from tallyloom.survey import Survey

CB, C, P = "x|f|x:|||cbase", "x|f|:|||counts", "x|f|:|y||c%"


def make(spark):
    rows = [(i, i % 3 + 1, i % 2 + 1, [1, 2] if i % 4 == 0 else [i % 3 + 1], i % 5 + 1 if i % 5 else None, i % 3 + 1, f"said {i}" if i % 7 == 0 else None, 1.0 + i % 2) for i in range(60)]
    meta = Meta("en-GB", "small")
    meta.add("id", "int", "Id")
    meta.add("q", "single", "Question", [(1, "red"), (2, "green"), (3, "blue")])
    meta.add("sex", "single", "Sex", [(1, "m"), (2, "f")])
    meta.add("s", "delimited set", "Several", [(1, "a"), (2, "b"), (3, "c")])
    meta.add("g", "single", "Grid", [(c, str(c)) for c in range(1, 6)], ["first", "second"])
    meta.add("say", "string", "Said")
    meta.add("w", "float", "Weight")
    return Survey(spark.createDataFrame(rows, "id long, q int, sex int, s array<int>, g_1 int, g_2 int, say string, w double"), meta)


@pytest.fixture
def survey(spark):
    return make(spark)


@pytest.fixture(scope="module")
def stack(spark):
    s = make(spark)
    b = Batch(s, "main", weights=[None])
    b.add_downbreak(["q", "s", "g"])
    b.add_crossbreak(["sex"])
    made = Stack(spark, "st", {"d": s})
    made.populate_batches("d")
    made.aggregate(["cbase", "counts", "c%"])
    return made


def test_batch_specification(survey):
    b = Batch(survey, "main")
    b.add_downbreak(["q", "g"])
    b.add_crossbreak(["sex"])
    assert b.x_y_map() == [("q", ["@", "sex"]), ("g", ["@"]), ("g_1", ["@", "sex"]), ("g_2", ["@", "sex"])]
    b.extend_y("s", on="q")
    b.replace_y("q > sex", on="g_1")
    b.exclusive_arrays([])
    b.transpose("g")
    assert b.x_y_map() == [("q", ["@", "sex", "s"]), ("g", ["@"]), ("g_1", ["@", "q > sex"]), ("g_2", ["@", "sex"]), ("@", ["g"])]
    b.exclusive_arrays("g")
    assert [x for x, _ in b.x_y_map()] == ["q", "g", "@"]
    b.extend_x({"q": ["s"]})
    b.add_section("s", "First")
    b.add_section("g", "Second")
    assert b.sections() == {"First": ["s", "q"], "Second": ["g", "g_1", "g_2"]}
    b.add_total(False)
    assert b.heads_of("s") == ["sex"]
    with pytest.raises(ValueError, match="unknown|no variables"):
        b.add_downbreak(["nothing"])
    with pytest.raises(ValueError):
        Batch(survey, "a-b")


def test_batch_lifecycle_and_filters(survey):
    b = Batch(survey, "main")
    b.add_downbreak(["q"])
    b.add_filter("men", {"sex": [1]})
    assert b.sample_size() == 30
    b.extend_filter({"q": {"s": has_any([1])}})
    assert b.filter_of("q") == "men_q" and survey.filtered("men_q").count() < 30
    more = b.clone("more", as_addition=True)
    assert batches(survey) == ["main", "more"] and batches(survey, additions=False) == ["main"]
    more.as_main()
    more.rename("other")
    assert batches(survey, additions=False) == ["main", "other"]
    b.sorting("q", fix=[3])
    b.set_value_texts("q", {1: "RED"})
    assert b.edited().meta.value_texts("q")[1] == "RED" and survey.meta.value_texts("q")[1] == "red"
    assert get_batch(survey, "main").to_dataset().df.count() == 30
    more.remove()
    assert batches(survey) == ["main"]


def test_open_ends(survey):
    b = Batch(survey, "main")
    b.add_open_ends(["say"], ["q"], replacements={"said": "SAID"}, filter_by={"sex": [1]})
    got = b.open_ends("open ends").collect()
    assert len(got) == len([i for i in range(0, 60, 7) if i % 2 == 0])
    assert all(r.say.startswith("SAID") and r.q in ("red", "green", "blue") for r in got)
    with pytest.raises(ValueError):
        b.add_open_ends(["q"], ["q"])


def test_stack_counts_and_replacement(stack, spark):
    rows = {(r.view, r.x_code, r.y_code): r.value for r in stack.get("d", x="q", y="sex").collect()}
    assert rows[CB, "All", "@"] == 60 and rows[CB, "All", "1"] == 30
    assert rows[C, "1", "1"] == 10 and round(rows[P, "1", "1"], 4) == 33.3333
    n = stack.results.count()
    stack.aggregate(["cbase", "counts", "c%"])  # the same again takes the old ones' place
    assert stack.results.count() == n
    assert {r.x_var for r in stack.describe().collect()} == {"q", "s", "g", "g_1", "g_2"}
    assert stack.get_rules_slicer("d", "no_filter", "q")[0] == "1"


def test_stack_own_methods_and_storage(stack, spark, tmp_path):
    mapper = views.ViewMapper(["counts"])
    mapper.make_template(lambda survey, link, times=1: survey.filtered(link.where).groupBy().count().selectExpr("'n' AS x_code", "1 AS x_pos", "'@' AS y_code", "0 AS y_pos", f"CAST(count * {times} AS DOUBLE) AS value"), iterators={"times": [1, 2]})
    mapper.add_method("rows")
    own = Stack(spark, "own", {"d": make(spark)})
    own.add_link("d", x="q", y="@")
    own.aggregate(mapper)
    assert sorted(r.value for r in own.results.filter("view LIKE '%rows%'").collect()) == [60, 120]
    stack.save(f"{tmp_path}/st")
    back = Stack.load(spark, f"{tmp_path}/st")
    assert back.results.exceptAll(stack.results).count() == 0 and back.links.keys() == stack.links.keys()


def test_nets_and_their_variables(spark):
    own = Stack(spark, "own", {"d": make(spark)})
    own.add_link("d", x=["q", "s"], y=["@", "sex"])
    own.add_nets(["q"], [{"warm": [1]}, {"cold": [2, 3]}], expand="after", calc={"calc": ("net_1", "/", "net_2"), "text": "ratio"}, recode="collect_codes")
    rows = {(r.view.split("|")[3], r.x_code): r.value for r in own.get("d", x="q", y="@").collect()}
    assert rows["", "net:warm"] == 20 and rows["", "net:cold"] == 40 and rows["", "calc:ratio"] == 50
    assert rows["y", "net:cold"] == pytest.approx(200 / 3) and rows["", "2"] == 20
    assert "q_rc" in own.surveys["d"].meta
    with pytest.raises(ValueError, match="another source"):
        own.add_stats(["s"])


def test_view_keys():
    v = views.View("x|t.props.Dim.05|x[{1,2}+]*:||w|significance")
    assert (v.is_propstest, v.level, v.weight, v.is_stat) == (True, 0.05, "w", False)
    assert views.View("x|f|x[{1,2}]:|y||net").is_net and views.View(P).is_pct and views.View(CB).is_base
    keys = [CB, "x|f|x:||w|cbase", C, P, "x|f|:|y|w|c%", "x|f|:||w|counts", "x|d.mean|x:||w|stat", "x|t.props.Dim.05|:||w|significance", "x|t.means.Dim.05|x:||w|significance"]
    made = views.ViewManager(keys, "w").get_views("counts_colpct", bases="both")
    assert made.views == [CB, "x|f|x:||w|cbase", "x|f|:|y|w|c%", "x|t.props.Dim.05|:||w|significance", "x|f|:||w|counts", "x|d.mean|x:||w|stat", "x|t.means.Dim.05|x:||w|significance"]
    assert made.group()[2] == ["x|f|:|y|w|c%", "x|t.props.Dim.05|:||w|significance", "x|f|:||w|counts"]
    assert made.set_bases("both", effective="w").views[:3] == [CB, "x|f|x:||w|cbase", "x|f|x:||w|ebase"]
    assert views.shake([["a", "b"], ["b"], ["c", "a"]]) == [["a", "b"], ["c"]]


def test_chains(stack, spark, tmp_path):
    cm = ChainManager(stack).get("d", x_keys=["q", "s"], y_keys=["@", "sex"], views=[CB, C, P])
    assert cm.names() == ["q", "s"] and cm["q"].view_lengths() == {CB: 1, C: 3, P: 3}
    wide = {(r.view, r.x_code): r for r in cm["q"].concat().collect()}
    assert float(wide[C, "2"]["sex:1"]) == 10 and float(wide[P, "2"]["@:@"]) == pytest.approx(100 / 3)
    other = cm.clone()
    assert cm.equals(other)
    other.rename({"q": "QQ"}).reorder(["s", "QQ"]).fold("both")
    assert list(other.folders) == ["both"] and other.names() == ["s", "QQ"] and not cm.equals(other)
    other.unfold().hide("s")
    assert other.names() == ["QQ"] and other.names(True) == ["s", "QQ"]
    cm.paint_all()
    texts = {r.x_label for r in cm["q"].frame.select("x_label").collect()}
    assert {"red", "green", "blue", "Base"} <= texts
    cm.save(f"{tmp_path}/cm")
    assert ChainManager.load(spark, f"{tmp_path}/cm").equals(cm)
    joined = cm.clone().cut(["1"], ci="counts").join("Both")
    assert joined.names() == ["Both"] and {r.x_var for r in joined["Both"].frame.collect()} == {"q", "s"}
    cluster = Cluster("c")
    banked = cluster.bank_chains("Bank", [(cm["q"], C, "from q"), (cm["s"], C, "from s")])
    assert {r.x_code for r in banked.frame.select("x_code").collect()} == {"from q", "from s"}


def test_sort_rules_and_hidden_columns(spark):
    s = make(spark)
    s.meta.sort_rule("s", fix=[1])
    s.meta.hide("sex", [2], "y")
    own = Stack(spark, "own", {"d": s})
    own.add_link("d", x="s", y=["@", "sex"])
    own.aggregate(["counts"])
    chain = Chain.of(own, "d", "no_filter", "s", ["@", "sex"], [C], rules=True)
    rows = chain.frame.filter("y_code = '@'").orderBy("x_pos").collect()
    counts = [r.value for r in rows]
    assert rows[-1].x_code == "1" and counts[:-1] == sorted(counts[:-1], reverse=True)
    assert {r.y_code for r in chain.frame.select("y_code").collect()} == {"@", "1"}


def test_sheets_pages_and_slides(stack, tmp_path):
    cm = ChainManager(stack).get("d", x_keys=["q"], y_keys=["@", "sex"], views=[CB, P])
    cm["q"].annotate("All & every <respondent>", "header")
    sheets.write_workbook(f"{tmp_path}/a.xlsx", cm, {"texts": stack.surveys["d"].df.select("id", "say")})
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx") as z:
        for n in z.namelist():
            ET.fromstring(z.read(n))
        book = z.read("xl/workbook.xml").decode()
        assert re.findall(r'sheet name="([^"]+)"', book) == ["TOC", "q", "texts"]
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
        assert "All &amp; every &lt;respondent&gt;" in sheet and "<v>60.0</v>" in sheet and "green" in sheet
    sheets.write_html(f"{tmp_path}/a.html", cm)
    assert "<td>33.3</td>" in (tmp_path / "a.html").read_text()
    sheets.write_slides(f"{tmp_path}/a.pptx", cm)
    with zipfile.ZipFile(f"{tmp_path}/a.pptx") as z:
        for n in z.namelist():
            ET.fromstring(z.read(n))
        assert "ppt/slides/slide1.xml" in z.namelist()
    rows, heads, values = sheets.chart_frame(cm["q"])
    assert rows == ["red", "green", "blue"] and heads == ["Total", "m", "f"] and len(values) == 3
