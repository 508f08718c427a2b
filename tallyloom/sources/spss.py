"""SPSS system files (.sav, .zsav), read and written without the vendor's library.

A file is one unit of work: a task decodes it and hands rows on in batches, so many
files are read side by side. Writing streams the rows to one file, as the format has
it. The layout follows the public description of the format.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import DATE, FLOAT, INT, SET, SINGLE, STRING, TIME, Meta, Value, Variable
from ..operators.recode import _or_null, compact
from ..plans.tabulate import quoted
from ..survey import Survey

SYSMIS = -1.7976931348623157e308
#: Print formats that are dates, date-times or times of day; seconds from the calendar's start to 1970.
DATE_FORMATS, TIME_FORMATS = {20, 22, 23, 24, 28, 29, 30, 38, 39, 41}, {21, 25}
EPOCH = 12_219_379_200
_BATCH = 5_000


@dataclass
class SavVariable:
    name: str
    width: int  # 0: number, else bytes of text
    label: str = ""
    format: tuple[int, int, int] = (5, 8, 2)  # kind, width, decimals
    labels: dict = field(default_factory=dict)
    missing: list = field(default_factory=list)
    slots: int = 1  # places of 8 bytes


@dataclass
class Dictionary:
    variables: list[SavVariable]
    compression: int
    bias: float
    n_cases: int
    order: str
    encoding: str
    start: int
    sets: list[dict]


class _Bytes:
    def __init__(self, raw: bytes, order: str = "<", at: int = 0):
        self.raw, self.order, self.at = raw, order, at

    def take(self, n: int) -> bytes:
        made = self.raw[self.at : self.at + n]
        self.at += n
        return made

    def int(self) -> int:
        return struct.unpack(f"{self.order}i", self.take(4))[0]

    def float(self) -> float:
        return struct.unpack(f"{self.order}d", self.take(8))[0]


def read_dictionary(raw: bytes) -> Dictionary:
    if raw[:4] not in (b"$FL2", b"$FL3"):
        raise ValueError("no SPSS system file")
    order = "<" if struct.unpack("<i", raw[64:68])[0] in (2, 3) else ">"
    r = _Bytes(raw, order, 68)
    _, compression, _, n_cases = r.int(), r.int(), r.int(), r.int()
    bias = r.float()
    r.at = 176
    variables: list[SavVariable] = []
    slot: list[SavVariable | None] = []
    long_names: dict[str, str] = {}
    long_widths: dict[str, int] = {}
    pending: list[tuple[list[tuple[bytes, bytes]], list[int]]] = []
    raw_sets: list[bytes] = []
    encoding, labels_raw, texts = "utf-8", [], []
    while True:
        kind = r.int()
        if kind == 2:
            width, has_label, n_missing, shown, _ = r.int(), r.int(), r.int(), r.int(), r.int()
            name = r.take(8)
            label = b""
            if has_label:
                n = r.int()
                label = r.take(-(-n // 4) * 4)[:n]
            missing = [r.take(8) for _ in range(abs(n_missing))]
            if width == -1:
                slot.append(None)
                variables[-1].slots += 1
                continue
            made = SavVariable("", width, "", (shown >> 16 & 255, shown >> 8 & 255, shown & 255))
            texts.append((made, name, label))
            if width == 0:
                made.missing = [struct.unpack(f"{order}d", m)[0] for m in missing] if n_missing >= 0 else []
            variables.append(made)
            slot.append(made)
        elif kind == 3:
            own = []
            for _ in range(r.int()):
                value, n = r.take(8), r.take(1)[0]
                own.append((value, r.take(-(-(n + 1) // 8) * 8 - 1)[:n]))
            labels_raw = own
        elif kind == 4:
            pending.append((labels_raw, [r.int() for _ in range(r.int())]))
        elif kind == 6:
            r.at += 80 * r.int()
        elif kind == 7:
            subtype, size, count = r.int(), r.int(), r.int()
            data = r.take(size * count)
            if subtype == 20:
                encoding = data.decode("ascii", "replace").strip("\0 ").lower() or encoding
            elif subtype == 13:
                long_names = dict(p.split("=", 1) for p in data.decode(encoding, "replace").split("\t") if "=" in p)
            elif subtype == 14:
                long_widths = {k: int(v) for k, v in (p.split("=", 1) for p in data.decode("ascii", "replace").replace("\0", "").split("\t") if "=" in p)}
            elif subtype in (7, 19):
                raw_sets.append(data)
        elif kind == 999:
            r.int()
            break
        else:
            raise ValueError(f"record type {kind} is unknown")
    text = lambda b: b.decode(encoding, "replace").rstrip(" \0")
    for made, name, label in texts:
        made.name, made.label = text(name), text(label)
    for own, places in pending:
        for p in places:
            v = slot[p - 1]
            if v is not None:
                v.labels = {(struct.unpack(f"{order}d", value)[0] if v.width == 0 else text(value)): text(label) for value, label in own}
    merged, i = [], 0
    while i < len(variables):  # texts over 255 bytes come in pieces
        v = variables[i]
        whole = long_widths.get(v.name)
        i += 1
        if whole:
            pieces = -(-whole // 252)
            v.slots += sum(x.slots for x in variables[i : i + pieces - 1])
            v.width = whole
            i += pieces - 1
        v.name = long_names.get(v.name, v.name)
        merged.append(v)
    sets = [s for data in raw_sets for s in _sets(data.decode(encoding, "replace"), long_names)]
    return Dictionary(merged, compression, bias, n_cases, order, encoding, r.at, sets)


def _sets(text: str, long_names: dict[str, str]) -> list[dict]:
    """``$name=C 5 label a b`` (same codes) and ``$name=D1 1 5 label a b`` (a value counted)."""
    out = []
    for line in text.strip("\0\n ").split("\n"):
        m = re.match(r"\$?(?P<name>[^=]+)=(?:C|E[^ ]* |D)", line)
        if not m:
            continue
        rest, kind, counted = line[line.index("=") + 1 :], line[line.index("=") + 1], None
        rest = rest[1:]
        if kind in "DE":
            rest = re.sub(r"^ ?(?:1|11) ", "", rest) if kind == "E" else rest
            n, rest = rest.split(" ", 1)
            counted, rest = rest[: int(n)], rest[int(n) :]
        n, rest = rest.lstrip(" ").split(" ", 1)
        label, rest = rest[: int(n)], rest[int(n) :]
        lower = {k.lower(): v for k, v in long_names.items()}
        names = [lower.get(v.lower(), v) for v in rest.split()]
        out.append({"name": m["name"], "kind": "C" if kind == "C" else "D", "counted": counted, "label": label, "variables": names})
    return out


def _slots(raw: bytes, d: Dictionary) -> Iterator[bytes]:
    """The data as places of 8 bytes."""
    if d.compression == 0:
        for at in range(d.start, len(raw) - 7, 8):
            yield raw[at : at + 8]
        return
    body = raw[d.start :]
    if d.compression == 2:
        _, trailer, _ = struct.unpack(f"{d.order}qqq", body[:24])
        blocks = struct.unpack(f"{d.order}i", raw[trailer + 20 : trailer + 24])[0]
        parts = []
        for i in range(blocks):
            _, at, _, n = struct.unpack(f"{d.order}qqii", raw[trailer + 24 + 24 * i : trailer + 48 + 24 * i])
            parts.append(zlib.decompress(raw[at : at + n]))
        body = b"".join(parts)
    missing, blank = struct.pack(f"{d.order}d", SYSMIS), b" " * 8
    numbers = [struct.pack(f"{d.order}d", c - d.bias) for c in range(256)]
    at, end = 0, len(body)
    while at < end:
        codes = body[at : at + 8]
        at += 8
        for c in codes:
            if c == 0:
                continue
            if c == 252:
                return
            if c == 253:
                yield body[at : at + 8]
                at += 8
            elif c == 254:
                yield blank
            elif c == 255:
                yield missing
            else:
                yield numbers[c]


def read_records(raw: bytes, d: Dictionary) -> Iterator[list]:
    slots = _slots(raw, d)
    unpack = struct.Struct(f"{d.order}d").unpack
    try:
        while True:
            row = []
            for v in d.variables:
                own = [next(slots) for _ in range(v.slots)]
                if v.width == 0:
                    number = unpack(own[0])[0]
                    row.append(None if number == SYSMIS else number)
                    continue
                if v.width <= 255:
                    data = b"".join(own)[: v.width]
                else:  # pieces of 255 bytes in 256, the last shorter
                    data = b"".join(b"".join(own[i : i + 32])[:255] for i in range(0, len(own), 32))
                row.append(data.decode(d.encoding, "replace").rstrip(" \0"))
            yield row
    except (StopIteration, RuntimeError):
        return


def _json_dictionary(raw: bytes) -> str:
    d = read_dictionary(raw)
    return json.dumps({"variables": [{"name": v.name, "width": v.width, "label": v.label, "format": v.format, "labels": [[k, t] for k, t in v.labels.items()], "missing": v.missing} for v in d.variables], "sets": d.sets})


def read_spss(spark: SparkSession, path: str, text_key: str = "main", dichotomies: dict | None = None, dates_as_strings: bool = False) -> Survey:
    """Data and dictionary: labelled numbers are singles, sets of several answers are sets, formats tell dates and whole numbers.

    ``path`` may name several files of one dictionary.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def head(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([_json_dictionary(c.as_py()) for c in batch.column("content")])], names=["json"])

    found = json.loads(files.limit(1).mapInArrow(head, "json string").first()[0])
    variables = found["variables"]
    kinds = {v["name"]: pa.string() if v["width"] else pa.float64() for v in variables}
    names = list(kinds)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for content in batch.column("content"):
                raw = content.as_py()
                held: list[list] = []
                for row in read_records(raw, read_dictionary(raw)):
                    held.append(row)
                    if len(held) == _BATCH:
                        yield _batch(held, kinds)
                        held = []
                if held:
                    yield _batch(held, kinds)

    df = files.mapInArrow(run, ", ".join(f"`{n.replace('`', '``')}` {'string' if k == pa.string() else 'double'}" for n, k in kinds.items()))
    meta = Meta(text_key)
    made = {}
    for v in variables:
        n, text = v["name"], {text_key: v["label"] or v["name"]}
        shown, _, decimals = v["format"]
        c = quoted(n)
        if v["width"]:
            meta.columns[n] = Variable(n, STRING, text)
            made[n] = F.nullif(F.trim(c), F.lit(""))
        elif shown in DATE_FORMATS:
            meta.columns[n] = Variable(n, STRING if dates_as_strings else DATE, text)
            stamp = F.timestamp_seconds(c - EPOCH)
            made[n] = F.date_format(stamp, "yyyy-MM-dd HH:mm:ss") if dates_as_strings else stamp
        elif shown in TIME_FORMATS:
            meta.columns[n] = Variable(n, TIME, text)
            made[n] = F.date_format(F.timestamp_seconds(c), "HH:mm:ss")
        elif v["labels"] and all(float(k).is_integer() for k, _ in v["labels"]):
            meta.columns[n] = Variable(n, SINGLE, text, [Value(int(k), {text_key: t}) for k, t in v["labels"]])
            made[n] = c.cast("int")
        elif decimals == 0:
            meta.columns[n] = Variable(n, INT, text)
            made[n] = c.cast("long")
        else:
            meta.columns[n] = Variable(n, FLOAT, text)
        if v["missing"] and n in meta.columns:
            meta.columns[n].missings = {int(m): "exclude" for m in v["missing"] if float(m).is_integer()}
        meta.sets["data file"].append(n)
    df = df.withColumns(made) if made else df
    gone: list[str] = []
    sets = {}
    for s in found["sets"]:
        own = [v for v in s["variables"] if v in names]
        if not own:
            continue
        text = {text_key: s["label"] or s["name"]}
        if s["kind"] == "C":
            column = compact([quoted(v).cast("int") for v in own])
            values = meta.columns[own[0]].values or []
        else:
            yes = s["counted"]
            hit = lambda v, yes=yes: quoted(v) == yes if kinds[v] == pa.string() else quoted(v).cast("double") == float(yes)
            column = compact([F.when(hit(v), F.lit(i)) for i, v in enumerate(own, 1)])
            values = [Value(i, {text_key: meta.columns[v].text[text_key]}) for i, v in enumerate(own, 1)]
        sets[s["name"]] = column
        meta.columns[s["name"]] = Variable(s["name"], SET, text, values)
        at = meta.sets["data file"].index(own[0])
        meta.sets["data file"].insert(at, s["name"])
        gone += own
    for name, (columns, yes) in (dichotomies or {}).items():
        sets[name] = compact([F.when(quoted(v).cast("double") == yes, F.lit(i)) for i, v in enumerate(columns, 1)])
        meta.columns[name] = Variable(name, SET, {text_key: name}, [Value(i, {text_key: meta.columns[v].text[text_key]}) for i, v in enumerate(columns, 1)])
        meta.sets["data file"].append(name)
        gone += columns
    if sets:
        df = df.withColumns(sets)
    for n in dict.fromkeys(gone):
        meta.drop(n)
    return Survey(df.drop(*dict.fromkeys(gone)), meta)


def _batch(rows: list[list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))


# ------------------------------------------------------------------------- writing


def clean_name(name: str, taken: set[str]) -> str:
    """A name that the format allows, and that isn't taken."""
    made = re.sub(r"[^A-Za-z0-9_.$#@]", "_", name).rstrip("._") or "v"
    made = (made if made[0].isalpha() else f"v{made}")[:60]
    n, out = 1, made
    while out.lower() in taken:
        out, n = f"{made}_{n}", n + 1
    taken.add(out.lower())
    return out


def number_format(most: float | None, decimals: int) -> tuple[int, int, int]:
    """F with the width that the largest number takes."""
    whole = len(str(int(abs(most or 0)))) + 1
    return 5, min(40, whole + (decimals + 1 if decimals else 0)), decimals


def write_spss(survey: Survey, path: str, text_key: str | None = None, drop_sets: bool = True, mrset_tag: str = "__", from_set: str | None = None) -> None:
    """One file: sets as 0/1 variables with a definition of the set, dates as text, labels of 120 bytes at most.

    Rows come one partition at a time, so memory holds a partition and not the whole.
    """
    key = text_key or survey.meta.text_key
    names = survey.meta.unroll(survey.meta.sets[from_set or "data file"])
    names = [n for n in names if n in survey.meta.columns and n in survey.df.columns]
    taken: set[str] = set()
    columns, variables, sets, numeric = [], [], [], []
    for n in names:
        own, c = survey.meta.columns[n], quoted(n)
        label = survey.meta.text(n, key)
        if own.type == SET:
            stem, members = clean_name(n, taken), []
            for v in own.values or ():
                member = clean_name(f"{stem}_{v.code}" if v.code >= 0 else f"{stem}_m{-v.code}", taken)
                columns.append(F.when(c.isNull(), None).otherwise(F.array_contains(c, v.code).cast("double")).alias(member))
                variables.append(SavVariable(member, 0, survey.meta.value_texts(n, key)[v.code], (5, 1, 0), {0.0: "No", 1.0: "Yes"}))
                members.append(member)
            sets.append((f"{mrset_tag}{stem}".strip("_") or stem, label, members))
            if not drop_sets:
                columns.append(F.concat_ws(";", F.transform(c, lambda x: x.cast("string"))).alias(f"{stem}_set"))
                variables.append(SavVariable(clean_name(f"{stem}_set", taken), -1, label))
        elif own.type in (SINGLE, INT, FLOAT):
            columns.append(c.cast("double").alias(n))
            labels = {float(k): t for k, t in survey.meta.value_texts(n, key).items()} if own.values else {}
            variables.append(SavVariable(clean_name(n, taken), 0, label, (5, 8, 2 if own.type == FLOAT else 0), labels))
            numeric.append((len(columns) - 1, own.type == FLOAT))
        else:
            columns.append((F.date_format(c, "yyyy-MM-dd") if own.type == DATE else c.cast("string")).alias(n))
            variables.append(SavVariable(clean_name(n, taken), -1, label))
    rows = survey.df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    asked = [F.count(F.lit(1)).alias("n")]
    for i, v in enumerate(variables):
        asked.append((F.max(F.length(F.encode(f"c{i}", "UTF-8"))) if v.width else F.max(F.abs(f"c{i}"))).alias(f"m{i}"))
    got = rows.agg(*asked).first()
    for i, v in enumerate(variables):
        if v.width:
            v.width = max(1, got[f"m{i}"] or 1)
            v.format = (1, min(255, v.width), 0)
        else:
            v.format = number_format(got[f"m{i}"], v.format[2])
    with open(path, "wb") as out:
        out.write(_header(variables, sets, got["n"], survey.meta.name))
        pack, missing = struct.Struct("<d").pack, struct.pack("<d", SYSMIS)
        for r in rows.toLocalIterator(prefetchPartitions=False):
            out.write(b"".join(_text_slots((x or "").encode(), v.width) if v.width else missing if x is None else pack(x) for x, v in zip(r, variables, strict=True)))


def _text_slots(data: bytes, width: int) -> bytes:
    if width <= 255:
        return data[:width].ljust(-(-width // 8) * 8)
    out = []
    for i in range(-(-width // 252)):
        own = 255 if i < -(-width // 252) - 1 else width - 252 * i
        out.append(data[255 * i : 255 * i + 255].ljust(-(-own // 8) * 8)[: -(-own // 8) * 8] if own < 255 else data[255 * i : 255 * i + 255].ljust(255) + b" ")
    return b"".join(out)


def _header(variables: list[SavVariable], sets: list, n: int, name: str) -> bytes:
    i4 = lambda *x: struct.pack(f"<{len(x)}i", *x)
    now = datetime.now()
    pieces: list[tuple[str, SavVariable, int, bool]] = []  # short name, variable, bytes, whether first
    long_names, widths = [], []
    for k, v in enumerate(variables):
        short = f"V{k:07d}"
        long_names.append(f"{short}={v.name}")
        if v.width > 255:
            widths.append(f"{short}={v.width:05d}\0")
            count = -(-v.width // 252)
            for i in range(count):
                own = 255 if i < count - 1 else v.width - 252 * i
                pieces.append((short if i == 0 else f"W{k:04d}{i:03d}"[:8], v, own, i == 0))
        else:
            pieces.append((short, v, v.width, True))
    slots = sum(max(1, -(-w // 8)) for _, _, w, _ in pieces)
    out = [b"$FL2", b"@(#) SPSS DATA FILE".ljust(60), i4(2, slots, 0, 0, n), struct.pack("<d", 100.0), now.strftime("%d %b %y").encode()[:9].ljust(9), now.strftime("%H:%M:%S").encode(), name.encode()[:64].ljust(64), b"\0\0\0"]
    places: dict[int, int] = {}
    at = 1
    for short, v, width, first in pieces:
        if first:
            places[id(v)] = at
        label = v.label.encode()[:120].decode("utf-8", "ignore").encode() if first else b""
        kind, w, decimals = v.format if first else (1, min(255, width), 0)
        shown = kind << 16 | (min(255, width) if width else w) << 8 | decimals
        out += [i4(2, width, bool(label), 0, shown, shown), short.encode().ljust(8)]
        if label:
            out += [i4(len(label)), label.ljust(-(-len(label) // 4) * 4)]
        for _ in range(-(-width // 8) - 1):
            out += [i4(2, -1, 0, 0, 0, 0), b" " * 8]
        at += max(1, -(-width // 8))
    for v in variables:
        if v.labels:
            out.append(i4(3, len(v.labels)))
            for code, text in v.labels.items():
                label = text.encode()[:120].decode("utf-8", "ignore").encode()
                out += [struct.pack("<d", code), bytes([len(label)]), label.ljust(-(-(len(label) + 1) // 8) * 8 - 1)]
            out.append(i4(4, 1, places[id(v)]))
    extension = lambda subtype, size, data: i4(7, subtype, size, len(data) // size) + data
    out.append(extension(3, 4, i4(1, 0, 0, -1, 1, 1, 2, 65001)))
    out.append(extension(4, 8, struct.pack("<3d", SYSMIS, 1.7976931348623157e308, -1.797693134862315e308)))
    if sets:
        short_of = {v.name: s.split("=")[0] for v, s in zip(variables, long_names, strict=True)}
        text = "".join(f"${name}=D1 1 {len(label.encode())} {label} {' '.join(short_of[m].lower() for m in members)}\n" for name, label, members in sets)
        out.append(extension(7, 1, text.encode()))
    out.append(extension(13, 1, "\t".join(long_names).encode()))
    if widths:
        out.append(extension(14, 1, "\t".join(widths).encode()))
    out.append(extension(20, 1, b"UTF-8"))
    out.append(i4(999, 0))
    return b"".join(out)


def sav_timestamp(seconds: float) -> datetime:
    return datetime(1582, 10, 14) + timedelta(seconds=seconds)
