"""Sinks for readers: workbooks (Office Open XML, written with the standard library), HTML pages and slides.

What is written is as large as the tables shown, so it is collected; a table of over
``MOST_CELLS`` cells is refused.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from html import escape
from xml.sax.saxutils import escape as xml_escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sigtests import letter
from .chains import Chain, ChainManager
from .views import View

MOST_CELLS = 5_000_000


@dataclass
class Table:
    """Laid-out text and numbers: heads (two lines), rows of (kind, label, cells)."""

    title: str
    heads: list[tuple[str, str]]
    rows: list[tuple[str, str, list]]
    notes: dict[str, dict[str, str]]


def laid_out(chain: Chain) -> Table:
    """A painted chain as rows: a view's codes together, tests under what they test."""
    painted = chain if chain.painted else chain.paint()
    frame = painted.frame
    if (size := frame.count()) > MOST_CELLS:
        raise ValueError(f"{chain.name}: {size} cells are too many to lay out")
    label = [c for c in ("x_title", "x_label", "y_title", "y_label") if c in frame.columns]
    got = frame.select("view_pos", "view", "x_var", "x_pos", "x_code", "y_var_pos", "y_var", "y_pos", "y_code", "value", "text", *label).collect()
    heads = sorted({(r.y_var_pos, r.y_var, r.y_pos, r.y_code) for r in got})
    names = {}
    for r in got:
        names[r.y_var_pos, r.y_var, r.y_pos, r.y_code] = (r.y_title, r.y_label) if "y_label" in label else (r.y_var, r.y_code)
    by: dict[tuple, dict] = {}
    for r in got:
        row = by.setdefault((r.view_pos, r.x_pos, r.view, r.x_code), {"label": r.x_label if "x_label" in label else r.x_code})
        row[r.y_var_pos, r.y_var, r.y_pos, r.y_code] = r.text if r.text is not None else r.value
    rows = []
    for (_, _, view, _), row in sorted(by.items(), key=lambda i: i[0][:2]):
        v = View(view)
        kind = "base" if v.is_base else "test" if v.method.startswith("t.") else "stat" if v.is_stat else "sum" if v.is_sum else "net" if v.is_net else "pct" if v.is_pct else "counts"
        rows.append((kind, row["label"] or "", [row.get(h) for h in heads]))
    title = frame.select(F.first("x_title")).first()[0] if "x_title" in label else chain.name
    return Table(title or chain.name, [names[h] for h in heads], rows, chain.annotations)


# ---------------------------------------------------------------------- workbooks

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Cell styles by number: default, bold, one decimal, whole, two decimals, centred, italic.
_STYLES = (
    f'<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0"/></numFmts>'
    '<fonts count="3"><font><sz val="10"/><name val="Arial"/></font><font><b/><sz val="10"/><name val="Arial"/></font><font><i/><sz val="10"/><name val="Arial"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="7"><xf/><xf fontId="1" applyFont="1"/><xf numFmtId="164" applyNumberFormat="1"/><xf numFmtId="1" applyNumberFormat="1"/>'
    '<xf numFmtId="2" applyNumberFormat="1"/><xf applyAlignment="1"><alignment horizontal="center" wrapText="1"/></xf><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>'
)
_FORMAT = {"base": 3, "counts": 3, "sum": 3, "net": 2, "pct": 2, "stat": 4, "test": 5}


class Workbook:
    """Sheets of cells; enough of the format for every common reader."""

    def __init__(self) -> None:
        self.sheets: list[tuple[str, list[list[tuple[object, int]]]]] = []

    def add(self, name: str, rows: list[list[tuple[object, int]]]) -> None:
        clean = "".join(c for c in name if c not in r"[]:*?/\\")[:31] or "Sheet"
        taken, made, n = {s.lower() for s, _ in self.sheets}, clean, 1
        while made.lower() in taken:
            made, n = f"{clean[:28]}_{n}", n + 1
        self.sheets.append((made, rows))

    @staticmethod
    def _cell(row: int, column: int, value: object, style: int) -> str:
        at = f'{letter(column)}{row}" s="{style}'
        if value is None:
            return f'<c r="{at}"/>'
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else f'<c r="{at}"/>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{xml_escape(_printable(str(value)))}</t></is></c>'

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        n = range(1, len(self.sheets) + 1)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in n)
            z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
            z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            sheets = "".join(f'<sheet name="{xml_escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (s, _) in zip(n, self.sheets, strict=True))
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{sheets}</sheets></workbook>')
            rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n)
            z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">{rels}<Relationship Id="rId{len(self.sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?>{_STYLES}')
            for i, (_, rows) in zip(n, self.sheets, strict=True):
                body = "".join(f'<row r="{r}">{"".join(self._cell(r, c, v, s) for c, (v, s) in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
                z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><cols><col min="1" max="1" width="45" customWidth="1"/></cols><sheetData>{body}</sheetData></worksheet>')
        return out.getvalue()


def _printable(s: str) -> str:
    return "".join(c for c in s if c in "\t\n\r" or ord(c) >= 32)


def _sheet_rows(table: Table, decimals: int) -> list[list[tuple[object, int]]]:
    rows: list[list[tuple[object, int]]] = []
    header, footer, notes = (table.notes.get(k, {}) for k in ("header", "footer", "notes"))
    rows += [[(t, 6)] for t in header.values()]
    rows.append([(table.title, 1)])
    last = None
    titles = []
    for t, _ in table.heads:
        titles.append((t if t != last else None, 5))
        last = t
    rows.append([(None, 0), *titles])
    rows.append([(None, 0), *((h, 5) for _, h in table.heads)])
    if any(k == "test" for k, _, _ in table.rows):
        place, marks = 0, []
        for _, h in table.heads:
            marks.append((None if h == "Total" else letter(place), 5))
            place += h != "Total"
        rows.append([(None, 0), *marks])
    before = None
    for kind, label, cells in table.rows:
        shown = None if kind == "test" and label == before else label
        before = label
        rows.append([(shown, 1 if kind in ("base", "net") else 0), *((round(c, decimals) if isinstance(c, float) and kind in ("pct", "net", "stat") else c, _FORMAT[kind]) for c in cells)])
    rows += [[(t, 6)] for d in (footer, notes) for t in d.values()]
    return rows


def workbook(chains: ChainManager | Iterable[Chain], decimals: int = 2, toc: bool = True, single_sheet: str | None = None) -> Workbook:
    """A sheet for each folder, or for each chain outside of one; a list of all tables first."""
    manager = chains if isinstance(chains, ChainManager) else None
    items = manager.items if manager else list(chains)
    made, contents, sheets = Workbook(), [[("Contents", 1)]], []
    held: list[list[tuple[object, int]]] = []
    for item in items:
        name, own = item if isinstance(item, tuple) else (item.name, [item])
        rows: list[list[tuple[object, int]]] = []
        for c in [c for c in own if not c.hidden]:
            table = laid_out(c)
            contents.append([(table.title, 0), (single_sheet or name, 0)])
            rows += [*_sheet_rows(table, decimals), []]
        if rows:
            (held.extend(rows) if single_sheet else sheets.append((name, rows)))
    if single_sheet:
        sheets = [(single_sheet, held)]
    if toc:
        made.add("TOC", contents)
    for name, rows in sheets:
        made.add(name, rows)
    return made


def write_workbook(path: str, chains: ChainManager | Iterable[Chain], open_ends: dict[str, DataFrame] | None = None, most_rows: int = 1_000_000, **options) -> None:
    """open_ends: listings by title, a sheet each; the format holds about a million rows a sheet, more are refused."""
    made = workbook(chains, **options)
    for title, rows in (open_ends or {}).items():
        got = rows.limit(most_rows + 1).collect()
        if len(got) > most_rows:
            raise ValueError(f"{title}: over {most_rows} rows don't fit a sheet")
        made.add(title, [[(c, 1) for c in rows.columns], *([(v, 0) for v in r] for r in got)])
    with open(path, "wb") as f:
        f.write(made.to_bytes())


# --------------------------------------------------------------------------- pages


def html_table(table: Table, decimals: int = 1) -> str:
    head = "".join(f"<th>{escape(t)}<br>{escape(h)}</th>" for t, h in table.heads)
    body = []
    for kind, label, cells in table.rows:
        shown = "".join(f"<td>{'' if c is None else escape(f'{c:.{0 if kind in ('base', 'counts', 'sum') else decimals}f}' if isinstance(c, float) else str(c))}</td>" for c in cells)
        body.append(f'<tr class="{kind}"><th>{escape(label)}</th>{shown}</tr>')
    return f"<table><caption>{escape(table.title)}</caption><thead><tr><th></th>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>"


def write_html(path: str, chains: ChainManager | Iterable[Chain], decimals: int = 1) -> None:
    own = chains.chains if isinstance(chains, ChainManager) else list(chains)
    tables = "".join(html_table(laid_out(c), decimals) for c in own if not c.hidden)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>{tables}</body></html>')


def frame_to_html(rows: DataFrame, path: str) -> None:
    """All rows of a DataFrame as a page, written as they arrive; a partition's rows are held at a time."""
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body><table>\n')
        f.write(cells(rows.columns, "th"))
        for row in rows.toLocalIterator():
            f.write(cells(row, "td"))
        f.write("</table></body></html>")


# -------------------------------------------------------------------------- slides

_A = "http://schemas.openxmlformats.org/drawingml/2006/main"
_P = "http://schemas.openxmlformats.org/presentationml/2006/main"
_EMU = 12700  # to a point


def chart_frame(chain: Chain) -> tuple[list[str], list[str], list[list[float | None]]]:
    """What a chart shows: categories (rows of percents, else of counts), series (columns), values."""
    table = laid_out(chain)
    kinds = {k for k, _, _ in table.rows}
    wanted = "pct" if "pct" in kinds else "counts" if "counts" in kinds else "stat"
    rows = [(label, cells) for kind, label, cells in table.rows if kind == wanted]
    return [r for r, _ in rows], [h for _, h in table.heads], [[c if isinstance(c, float) else None for c in cells] for _, cells in rows]


def _slide(table: Table, most_rows: int) -> str:
    width = 9_144_000 - 914_400
    columns = len(table.heads) + 1
    grid = "".join(f'<a:gridCol w="{width // columns}"/>' for _ in range(columns))
    cell = lambda t: f"<a:tc><a:txBody><a:bodyPr/><a:p><a:r><a:rPr sz=\"900\"/><a:t>{xml_escape(_printable(t))}</a:t></a:r></a:p></a:txBody><a:tcPr/></a:tc>"
    lines = [["", *(h for _, h in table.heads)]]
    for kind, label, cells in table.rows[:most_rows]:
        lines.append([label, *("" if c is None else f"{c:.{0 if kind in ('base', 'counts', 'sum') else 1}f}" if isinstance(c, float) else str(c) for c in cells)])
    rows = "".join(f'<a:tr h="{20 * _EMU}">{"".join(map(cell, line))}</a:tr>' for line in lines)
    title = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Title"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="228600"/><a:ext cx="{width}" cy="{40 * _EMU}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/><a:p><a:r><a:rPr sz="1800" b="1"/><a:t>{xml_escape(_printable(table.title))}</a:t></a:r></a:p></p:txBody></p:sp>'
    frame = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="3" name="Table"/><p:cNvGraphicFramePr/><p:nvPr/></p:nvGraphicFramePr><p:xfrm><a:off x="457200" y="914400"/><a:ext cx="{width}" cy="{20 * _EMU * len(lines)}"/></p:xfrm><a:graphic><a:graphicData uri="{_A.replace("main", "table")}"><a:tbl><a:tblPr firstRow="1"/><a:tblGrid>{grid}</a:tblGrid>{rows}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    return f'<?xml version="1.0" encoding="UTF-8"?><p:sld xmlns:a="{_A}" xmlns:r="{_REL}" xmlns:p="{_P}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{title}{frame}</p:spTree></p:cSld></p:sld>'


def write_slides(path: str, chains: ChainManager | Iterable[Chain], most_rows: int = 20) -> None:
    """A slide with a title and a table for each chain; rows beyond ``most_rows`` go on to further slides."""
    own = chains.chains if isinstance(chains, ChainManager) else list(chains)
    slides = []
    for c in [c for c in own if not c.hidden]:
        table = laid_out(c)
        for at in range(0, max(len(table.rows), 1), most_rows):
            slides.append(_slide(Table(table.title, table.heads, table.rows[at : at + most_rows], {}), most_rows))
    kind = "application/vnd.openxmlformats-officedocument.presentationml"
    n = range(1, len(slides) + 1)
    tree = '<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/></p:spTree></p:cSld>'
    colours = "".join(f'<a:{c}><a:srgbClr val="{v}"/></a:{c}>' for c, v in zip("dk1 lt1 dk2 lt2 accent1 accent2 accent3 accent4 accent5 accent6 hlink folHlink".split(), "000000 FFFFFF 333333 EEEEEE 4472C4 ED7D31 A5A5A5 FFC000 5B9BD5 70AD47 0563C1 954F72".split(), strict=True))
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fill, line, effect = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>', '<a:ln><a:solidFill><a:schemeClr val="phClr"/></a:solidFill></a:ln>', "<a:effectStyle><a:effectLst/></a:effectStyle>"
    theme = f'<a:theme xmlns:a="{_A}" name="Plain"><a:themeElements><a:clrScheme name="Plain">{colours}</a:clrScheme><a:fontScheme name="Plain"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="Plain"><a:fillStyleLst>{fill * 3}</a:fillStyleLst><a:lnStyleLst>{line * 3}</a:lnStyleLst><a:effectStyleLst>{effect * 3}</a:effectStyleLst><a:bgFillStyleLst>{fill * 3}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    space = f'xmlns:a="{_A}" xmlns:r="{_REL}" xmlns:p="{_P}"'
    rel = lambda *targets: f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/{k}" Target="{t}"/>' for i, (k, t) in enumerate(targets, 1)) + "</Relationships>"
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i + 1}"/>' for i in n)
    parts = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/ppt/presentation.xml" ContentType="{kind}.presentation.main+xml"/><Override PartName="/ppt/slideMasters/slideMaster1.xml" ContentType="{kind}.slideMaster+xml"/><Override PartName="/ppt/slideLayouts/slideLayout1.xml" ContentType="{kind}.slideLayout+xml"/><Override PartName="/ppt/theme/theme1.xml" ContentType="application/vnd.openxmlformats-officedocument.theme+xml"/>' + "".join(f'<Override PartName="/ppt/slides/slide{i}.xml" ContentType="{kind}.slide+xml"/>' for i in n) + "</Types>",
        "_rels/.rels": rel(("officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<?xml version="1.0" encoding="UTF-8"?><p:presentation {space}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(("slideMaster", "slideMasters/slideMaster1.xml"), *(("slide", f"slides/slide{i}.xml") for i in n)),
        "ppt/slideMasters/slideMaster1.xml": f'<?xml version="1.0" encoding="UTF-8"?><p:sldMaster {space}>{tree}<p:clrMap bg1="lt1" tx1="dk1" bg2="lt2" tx2="dk2" accent1="accent1" accent2="accent2" accent3="accent3" accent4="accent4" accent5="accent5" accent6="accent6" hlink="hlink" folHlink="folHlink"/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>',
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": rel(("slideLayout", "../slideLayouts/slideLayout1.xml"), ("theme", "../theme/theme1.xml")),
        "ppt/slideLayouts/slideLayout1.xml": f'<?xml version="1.0" encoding="UTF-8"?><p:sldLayout {space} type="blank">{tree}</p:sldLayout>',
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rel(("slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/theme/theme1.xml": f'<?xml version="1.0" encoding="UTF-8"?>{theme}',
    }
    for i, s in zip(n, slides, strict=True):
        parts[f"ppt/slides/slide{i}.xml"] = s
        parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = rel(("slideLayout", "../slideLayouts/slideLayout1.xml"))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
