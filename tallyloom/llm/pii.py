"""Personal data by bootstrapped contextual extraction.

Base expressions find emails, IPv4 addresses, card numbers (Luhn) and telephone
numbers; long values of letters and digits that a text assigns to a name ('token =
"..."') are taken for secrets. These are the seed entities. The words beside them
induce lexical patterns ("<tel:" to the left, "number _ call" around). Candidates
are whatever might identify: words with a digit or an @, groups of numbers, values
behind = and :, addresses written with (at), of any shape and length. Spark scores
the graph of patterns and instances in turns: a pattern is as sure of a kind as the
share of its distinct instances that are known to be of that kind, an instance as
sure as its patterns together; instances of sure patterns become known and vouch for
further patterns, until a turn adds none. What is found so is added, as of its
pattern's kind, to the base spans, which all stay. Secrets have no base spans: also
their seeds need a sure pattern.

Instances are known by their exact text, patterns by the exact words beside them.

Defined results: a null or empty text has no spans. Rows repeated with the same
doc_id and text give a row each with the same spans; rows of one doc_id with
different texts have their own. Null doc_ids stay. Of two kinds as sure the one
listed first holds. Very long texts and words are read whole. Empty tables give no
rows. Offsets are code points, ends exclusive. Other columns are not read, whatever
they are called.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
#: What a pattern and an instance need, and distinct known instances that a pattern needs.
SURE_PATTERN, SURE_INSTANCE, SUPPORT = 0.75, 0.75, 5
#: Characters of an assigned value of letters and digits that make it a seed.
SECRET_CHARS = 16
#: Rows of a batch whose places are Python objects at once.
SLICE_ROWS = 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# digits before a start would have been part of the match, so looking back changes nothing but the time taken
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_HOLDS = re.compile("[0-9@]")
_HELD = frozenset("0123456789@")
_LOOSE_EMAIL = re.compile(r"(?<!\S)[^\s@<>()\[\]]++\s?[(\[](?:at|@)[)\]]\s?[^\s@<>()\[\]]++", re.I)
_ASSIGNED = re.compile(r"[=:]\s*+(\S++)")
_TOKEN = re.compile(r"\S+")
_GROUP = re.compile(r"[+(]?[0-9][0-9().+/-]*")
_AROUND = "\"'`()[]{}<>.,;:!?*#$%&|=«»“”"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email expression; each takes the run of local characters before its @, in linear time."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((start, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base expressions, by kind and start."""
    spans = [(0, a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return spans
    spans += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 60 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


def tokens(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text start and end."""
    found = [m.span() for m in _TOKEN.finditer(text)]
    return [a for a, _ in found], [b for _, b in found]


def _bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without the marks around it."""
    while start < end and text[start] in _AROUND:
        start += 1
    while end > start and text[end - 1] in _AROUND:
        end -= 1
    return start, end


def loose_spans(text: str, base: list[tuple[int, int, int]], starts: list[int], ends: list[int]) -> list[tuple[int, int, bool]]:
    """(start, end, assigned) of candidates; none overlaps a base span or another one."""
    made: dict[tuple[int, int], bool] = {}
    low = text.lower() if "(" in text or "[" in text else ""
    if any(x in low for x in ("(at)", "[at]", "(@)", "[@]")):
        made.update({_bare(text, *m.span()): False for m in _LOOSE_EMAIL.finditer(text)})
    for m in _ASSIGNED.finditer(text):
        made[_bare(text, *m.span(1))] = True
    at = 0
    while m := _HOLDS.search(text, at):
        i = bisect_right(starts, m.start()) - 1
        first = i
        while _GROUP.fullmatch(text, *_bare_end(text, starts[i], ends[i])) and i + 1 < len(starts) and _GROUP.fullmatch(text, *_bare_end(text, starts[i + 1], ends[i + 1])):
            i += 1
        made.setdefault(_bare(text, starts[first], ends[i]), False)
        at = ends[i]
    taken = sorted((a, b) for _, a, b in base)
    out: list[tuple[int, int, bool]] = []
    for (a, b), assigned in sorted(made.items(), key=lambda x: (x[0][0], -x[0][1])):
        j = bisect_right(taken, (b,))
        # spans of one kind don't overlap, so the last few that start before the end are all that can reach it
        if a < b and not any(a < y for _, y in taken[max(0, j - len(KINDS)) : j]) and not (out and a < out[-1][1]):
            out.append((a, b, assigned))
    return out


def _bare_end(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?":
        end -= 1
    return start, end


def contexts(text: str, start: int, end: int, starts: list[int], ends: list[int]) -> list[str]:
    """Lexical patterns of a place: the word before, two words before, the word after, and both sides.

    What is glued to the place, up to the next digit or @, counts as a word, if there is more of it than marks.
    """
    first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
    before = [text[starts[i] : ends[i]].lower() for i in range(max(0, first - 2), first)]
    left = start
    while left > starts[first] and text[left - 1] not in _HELD:
        left -= 1
    if glued := text[left:start].strip("\"'`([{<«“.,;-+"):
        before.append(glued.lower())
    held = _HOLDS.search(text, end, ends[last])
    after = text[end : held.start() if held else ends[last]].strip(_AROUND) or (text[starts[last + 1] : ends[last + 1]] if last + 1 < len(starts) else "")
    right = after.lower()
    made = []
    if before:
        made.append(f"<{before[-1]}")
        if len(before) > 1:
            made.append(f"<{before[-2]} {before[-1]}")
    if right:
        made.append(f">{right}")
        if before:
            made.append(f"{before[-1]} _ {right}")
    return [p for p in made if any(map(str.isalpha, p))]


def _is_secret(value: str) -> bool:
    return len(value) >= SECRET_CHARS and value.isascii() and any(map(str.isdigit, value)) and any(map(str.isalpha, value)) and "/" not in value and "@" not in value


_SPAN = "struct<kind:int,start:int,end:int>"
_SEEN = "struct<kind:int,start:int,end:int,value:string,patterns:array<string>>"
_SEEN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def places(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds (with their kind) and candidates (without) of a text, with their patterns."""
    if not base and not _HOLDS.search(text) and "=" not in text and ":" not in text and "(" not in text and "[" not in text:
        return []
    starts, ends = tokens(text)
    found = list(base)
    found += [(SECRET if assigned and _is_secret(text[a:b]) else None, a, b) for a, b, assigned in loose_spans(text, base, starts, ends)]
    return [{"kind": k, "start": a, "end": b, "value": text[a:b], "patterns": contexts(text, a, b, starts, ends)} for k, a, b in found]


def seen(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), base spans, and seeds and candidates with their patterns."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                bases, found = [], []
                for text in part.column("text").to_pylist():
                    base = base_spans(text)
                    bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                    found.append(places(text, base))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(bases, _SPAN_TYPE), pa.array(found, _SEEN_TYPE)], names=["doc_id", "key", "base", "seen"]
                )

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    return texts.mapInArrow(run, f"doc_id long, key long, base array<{_SPAN}>, seen array<{_SEEN}>")


def sure_values(edges: DataFrame, turns: int | None = None) -> DataFrame:
    """value, kind of the instances of no base kind that patterns of known ones vouch for.

    ``edges``: pattern, value, kind (of seeds, else null), a row for each pattern of each place.
    """
    edges = written(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-graph")
    sure = edges.sparkSession.createDataFrame([], "value string, kind int")
    open_ones = F.col("kind").isNull() | (F.col("kind") == SECRET)
    if not edges.filter(open_ones).head(1):
        return sure
    size = F.count(F.lit(1))
    n, turn = 0, 0
    while turns is None or turn < turns:
        state = edges.join(sure.withColumnRenamed("kind", "found"), "value", "left").withColumn("now", F.coalesce("kind", "found"))
        of_kind = state.filter("now IS NOT NULL").groupBy("pattern", "now").agg(size.alias("support")).filter(F.col("support") >= SUPPORT)
        patterns = of_kind.join(edges.groupBy("pattern").agg(size.alias("n")), "pattern").withColumn("conf", F.col("support") / (F.col("n") + 1))
        patterns = patterns.filter(F.col("conf") >= SURE_PATTERN).select("pattern", "now", "conf")
        vouched = edges.filter(open_ones).join(patterns, "pattern").groupBy("value", "now").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
        best = vouched.filter(F.col("score") >= SURE_INSTANCE).groupBy("value").agg(F.min(F.struct((-F.col("score")).alias("less"), "now")).alias("best"))
        # a value keeps the kind it was found with, so every turn adds to the last
        met = best.select("value", F.col("best.now").alias("new")).join(sure, "value", "full_outer")
        sure = written(met.select("value", F.coalesce("kind", "new").alias("kind")), "pii-sure")
        turn += 1
        if (now := sure.count()) == n:
            break
        n = now
    return sure


def personal_data(docs: DataFrame, turns: int | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind number, start, end, sorted) of every row."""
    rows = written(seen(docs), "pii-seen")
    flat = rows.select("doc_id", "key", F.explode("seen").alias("s")).select("doc_id", "key", "s.*")
    sure = sure_values(flat.select("kind", "value", F.explode("patterns").alias("pattern")), turns)
    met = flat.filter(F.col("kind").isNull() | (F.col("kind") == SECRET)).drop("kind").join(sure, "value")
    added = met.groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)"))))
    same = rows.doc_id.eqNullSafe(F.col("of")) & (rows.key == F.col("of_key"))
    return rows.join(added, same, "left").select("doc_id", F.array_sort("base").alias("base"), spans.alias("spans"))


def listed(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kind_test(number: int):
    return lambda span: span["kind"] == number


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, with counts and a digest of the base ones."""
    found = personal_data(documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _kind_test(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
