"""Benchmark decontamination by template windows.

Words of items and documents become template tokens: numbers, units and names turn
into typed placeholders, other words lose case and punctuation at their ends. A
number with the unit behind or glued to it is one number, names side by side are one
name, and what a word is depends on the word alone, so a text reads the same
wherever it stands. Windows of template tokens of the documents are hash-joined
with those of the items. Where they meet, document and item are compared along the
diagonal, by words and by tokens. Slots must be filled consistently: one value of
the item always stands for one value of the document and the other way round, so a
question with new numbers is caught and two texts that share a pattern with numbers
all over are not. An item leaks into a document by

* ``RUN`` of its words in a row, verbatim;
* ``RUN`` of its tokens in a row, or a part of such a run with as many words besides
  its slots, with consistent slots;
* ``SHARE`` of all its tokens on a diagonal, or on two that are at most ``SHIFT``
  apart (words put in or left out), where a like share of the slots is consistent;
* being the whole document, if it has fewer than ``LEAST`` tokens.

How it is spread. A task reads its documents once and keeps the places of windows
that an item may have: a screen of the items' window hashes goes to the tasks while
there are up to ``SCREEN_WINDOWS`` of them; beyond, all windows are places. Places
and items' windows meet in a join, salted for windows that many documents hold.
Then a document meets the items it shares a window with, in groups of at most about
``ITEM_BYTES`` of items.

Defined results: null and empty texts, as documents or items, match nothing. Rows
alike in id and text give their matches once each; rows of one doc_id with different
texts are different documents. Null ids stay null. Of several diagonals the one of
greatest share, then longest run, then first place is told. Very long texts are
compared whole. Empty tables give no rows. Other columns are not read, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, documents, free, mixed, table, text_blocks, written

WIDTH, LEAST = 8, 5
RUN, SHARE, SHIFT = 10, 0.8, 2
#: Share of a match's tokens that must be words rather than slots.
WORDS = 0.5
#: Window hashes of the items that go to every task (8 bytes each), at most.
SCREEN_WINDOWS = 4_000_000
#: Contaminated documents whose keys go to every task (16 bytes each), at most.
BROADCAST_ROWS = 500_000
#: UTF-8 bytes of items that a document is compared with at once.
ITEM_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
#: Parts into which the documents with one window are dealt.
SALTS = 16

# fixed values
_EDGE = b"\"'()[]{}<>.,;:!?*_`~|"
_UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb lbs oz t ml l cl dl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months"
    b" year years km/h mph m/s kmh hz khz mhz ghz w kw mw kwh j kj n pa kpa bar v a c f k usd eur gbp dollar dollars cent cents euro euros pound pounds percent meter meters"
    b" metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres degree degrees".split()
)
_NUMBER_WORDS = frozenset(
    b"two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy"
    b" eighty ninety hundred thousand million".split()
)
_NUMBER = regex.compile(rb"[+\-]?[$#]?(?:\xe2\x82\xac|\xc2\xa3)?[0-9][0-9.,:/]*(?:%|st|nd|rd|th|([a-z/]+))?")
_WORD, _NUM, _UNIT, _NAME = range(4)
_NAMES = np.array([0, *((xxhash.xxh64_intdigest(x) & ~7) for x in (b"\0number", b"\0unit", b"\0name"))], np.uint64)
_ENDS = 4  # low bits of a word's hash: its kind, and whether it ends a sentence


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGE)
        shown = bare.decode("utf-8", "replace")
        low = shown.lower().encode()
        number = _NUMBER.fullmatch(low)
        if number and (number[1] is None or number[1] in _UNITS) or low in _NUMBER_WORDS:
            kind = _NUM
        elif low in _UNITS:
            kind = _UNIT
        else:
            kind = _NAME if shown[:1].isupper() and len(shown) > 1 and not shown.isupper() else _WORD
        ends = _ENDS if word.rstrip(b"\"')]}*_")[-1:] in (b".", b"!", b"?", b":") else 0
        made = self[word] = (xxhash.xxh64_intdigest(low) & ~7) | kind | ends
        return made


class Template(NamedTuple):
    """Template tokens of texts: words (hashes of all words), where each token's words begin, its name, whether it is a slot, and where texts start and the last ends."""

    words: np.ndarray
    begins: np.ndarray
    names: np.ndarray
    slots: np.ndarray
    ends: np.ndarray


class Templates:
    def __init__(self) -> None:
        self.words = _Words()
        self.rolling = Rolling(0xA0761D6478BD642F)

    def of(self, texts: list[bytes]) -> Template:
        if len(self.words) > 400_000:
            self.words.clear()
        split = [t.split() for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        made = np.fromiter((self.words[w] for own in split for w in own), np.uint64, int(ends[-1]))
        kind = (made & np.uint64(3)).astype(np.int64)
        joins = np.zeros(len(made), bool)  # to the token of the word before
        before = np.where(made[:-1] & np.uint64(_ENDS) > 0, -1, kind[:-1])
        joins[1:] = (kind[1:] == _NAME) & (before == _NAME) | (kind[1:] == _UNIT) & (before == _NUM)
        joins[ends[:-1][ends[:-1] < len(made)]] = False
        begins = np.flatnonzero(~joins)
        kind, made = kind[begins], made & ~np.uint64(7)
        return Template(made, begins, np.where(kind == _WORD, made[begins], _NAMES[kind]), kind != _WORD, np.searchsorted(begins, ends))

    def values(self, t: Template) -> np.ndarray:
        """A hash of each token's words."""
        return self.rolling.ranges(self.rolling.prefixes(t.words), t.begins, np.append(t.begins[1:], len(t.words)))

    def windows(self, t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of all windows of a width that lie in one text; of a negative width the texts of so many words, by their words."""
        if width < 0:
            last = np.append(t.begins, len(t.words))[t.ends]
            own = np.flatnonzero(np.diff(last) == -width)
            return t.ends[own], mixed(self.rolling.ranges(self.rolling.prefixes(t.words), last[own], last[own + 1]) + np.uint64(WIDTH - width))
        n = len(t.names) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = np.zeros(len(t.names) + 1, bool)
        inside[t.ends[:-1]] = True
        first = np.maximum.accumulate(np.where(inside[:-1], np.arange(len(t.names)), 0))  # of each token its text's first
        at = np.flatnonzero(first[width - 1 :] <= np.arange(n))
        # the width is part of the hash
        return at, mixed(self.rolling.ranges(self.rolling.prefixes(t.names), at, at + width) + np.uint64(width))


def window_width(n: int, n_words: int) -> int:
    """The window for an item of n tokens: all words of a short one; of others so little that a change in the middle leaves one beside it."""
    return -n_words if n < LEAST else min(WIDTH, max(4, (n - 1) // 2))


# -------------------------------------------------------------------- judging


def _runs(same: np.ndarray) -> list[tuple[int, int]]:
    """Where stretches of true begin and end."""
    edges = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def _consistent(a: list, b: list) -> bool:
    """Whether the values map one to one."""
    there: dict = {}
    back: dict = {}
    return all(there.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(a, b, strict=True))


def _consistent_run(slots: np.ndarray, mine: list, theirs: list) -> tuple[int, int] | None:
    """The longest stretch of an inconsistent or slot-heavy run with consistent slots, no more of them than WORDS allows, and RUN words."""
    said = np.concatenate([[0], np.cumsum(~slots)]).tolist()
    heavy = np.concatenate([[0.0], np.cumsum(slots - (1 - WORDS))]).tolist()
    there: dict = {}  # a value's last partner, and where
    back: dict = {}
    left, best = 0, None
    for j in range(len(slots)):
        if slots[j]:
            for at, x, y in ((there, mine[j], theirs[j]), (back, theirs[j], mine[j])):
                if x in at and at[x][0] != y:
                    left = max(left, at[x][1] + 1)
                at[x] = (y, j)
        for i in range(left, j + 1 - (best[1] - best[0] if best else 0)):
            if said[j + 1] - said[i] < RUN:
                break
            if heavy[j + 1] <= heavy[i]:
                best = (i, j + 1)
                break
    return best


def _agreeing(mine: list, theirs: list, slots: list[bool]) -> list[bool]:
    """Which tokens are words, or slots whose values stand for each other more often than for any other (first come, first kept)."""
    seen: dict = {}
    for x, y, s in zip(mine, theirs, slots, strict=True):
        if s:
            seen[x, y] = seen.get((x, y), 0) + 1
    there: dict = {}
    back: dict = {}
    for (x, y), _ in sorted(seen.items(), key=lambda p: -p[1]):
        if x not in there and y not in back:
            there[x], back[y] = y, x
    return [not s or there.get(x) == y for x, y, s in zip(mine, theirs, slots, strict=True)]


class Match(NamedTuple):
    share: float
    run: int
    start: int
    verbatim: bool


def _better(a: Match | None, b: Match | None) -> Match | None:
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda m: (m.share, m.run, -m.start))


class Pair:
    """An item and a document, to be compared along diagonals (document token less item token)."""

    def __init__(self, item: Template, mine: np.ndarray, doc: Template, theirs: np.ndarray):
        self.item, self.mine, self.doc, self.theirs = item, mine, doc, theirs

    def same(self, shift: int) -> np.ndarray:
        """For each token of the item whether the document's on the diagonal has its name."""
        n, m = len(self.item.names), len(self.doc.names)
        out = np.zeros(n, bool)
        lo, hi = max(0, -shift), min(n, m - shift)
        if lo < hi:
            out[lo:hi] = self.item.names[lo:hi] == self.doc.names[lo + shift : hi + shift]
        return out

    def verbatim(self, shift: int, runs: list[tuple[int, int]], share: float) -> Match | None:
        """The longest run of RUN equal words beside tokens that meet on the diagonal."""
        a, b = self.item.words, self.doc.words
        best = None
        for away in {int(self.doc.begins[i + shift] - self.item.begins[i]) for i, _ in runs}:
            lo, hi = max(0, -away), min(len(a), len(b) - away)
            for begin, end in _runs(a[lo:hi] == b[lo + away : hi + away]):
                if end - begin >= RUN:
                    best = _better(best, Match(share, end - begin, lo + away + begin, True))
        return best

    def consistent(self, shift: int, runs: list[tuple[int, int]], share: float) -> Match | None:
        """The longest run of RUN tokens, or part of it, with consistent slots and enough words."""
        best = None
        for begin, end in runs:
            if end - begin < RUN:
                continue
            slots = self.item.slots[begin:end]
            mine, theirs = self.mine[begin:end].tolist(), self.theirs[begin + shift : end + shift].tolist()
            picks = np.flatnonzero(slots).tolist()
            if not (len(picks) <= (1 - WORDS) * (end - begin) and _consistent([mine[j] for j in picks], [theirs[j] for j in picks])):
                part = _consistent_run(slots, mine, theirs)
                if part is None:
                    continue
                begin, end = begin + part[0], begin + part[1]
            verbatim = bool((self.mine[begin:end] == self.theirs[begin + shift : end + shift]).all())
            best = _better(best, Match(share, end - begin, int(self.doc.begins[begin + shift]), verbatim))
        return best

    def whole(self, shift: int, same: np.ndarray) -> Match | None:
        """SHARE of the item on this diagonal, or on this one and, from some token on, one beside it."""
        n = len(same)
        ways = [(int(same.sum()), 0, n)]
        for other in range(-SHIFT, SHIFT + 1):
            if other:
                then = np.cumsum(self.same(shift + other)[::-1])[::-1]
                total = np.concatenate([[0], np.cumsum(same)]) + np.concatenate([then, [0]])
                at = int(total.argmax())
                ways.append((int(total[at]), other, at))
        for count, other, at in sorted(ways, key=lambda w: (-w[0], abs(w[1]), w[1])):
            if count < SHARE * n:
                return None
            use = np.flatnonzero(np.where(np.arange(n) < at, same, self.same(shift + other)))
            there = use + np.where(use < at, shift, shift + other)
            mine, theirs, slots = self.mine[use].tolist(), self.theirs[there].tolist(), self.item.slots[use].tolist()
            agree = _agreeing(mine, theirs, slots)
            said = sum(agree)
            filled = sum(s for s, g in zip(slots, agree, strict=True) if g)
            if said < SHARE * n or filled < SHARE * sum(slots) or filled > (1 - WORDS) * said:
                continue
            kept = np.zeros(n, bool)
            kept[use[np.array(agree)]] = True
            begin, end = max(_runs(kept), key=lambda r: (r[1] - r[0], -r[0]))
            first = int(there[np.flatnonzero(use == begin)[0]])
            return Match(round(said / n, 4), end - begin, int(self.doc.begins[first]), mine == theirs)
        return None

    def match(self, shift: int) -> Match | None:
        same = self.same(shift)
        n = len(same)
        if n < LEAST:
            alike = shift == 0 and np.array_equal(self.item.words, self.doc.words)
            return Match(1.0, n, 0, True) if alike else None
        runs = _runs(same)
        share = round(float(same.sum()) / n, 4)
        return _better(self.whole(shift, same), _better(self.verbatim(shift, runs, share), self.consistent(shift, runs, share)))


# -------------------------------------------------------------------- in Spark

_KEYED = "doc_id long, key long, text binary"


def _places(screen: dict[int, np.ndarray] | None, widths: list[int], blocks: Iterator[tuple[pa.RecordBatch, list[bytes]]], keep: list[str], every: bool) -> Iterator[pa.RecordBatch]:
    """Rows with ``hits``: hash and start of their windows on the screen (all windows without one); rows without any only if ``every``."""
    templates = Templates()
    for batch, texts in blocks:
        t = templates.of(texts)
        at, h = [], []
        for width in widths:
            own_at, own_h = templates.windows(t, width)
            if screen is not None:
                near, known = screen[width]
                use = np.flatnonzero(near[(own_h >> np.uint64(42)).astype(np.int64)])
                own_at, own_h = own_at[use], own_h[use]
                if len(use):
                    use = known[np.minimum(np.searchsorted(known, own_h), len(known) - 1)] == own_h
                    own_at, own_h = own_at[use], own_h[use]
            at.append(own_at)
            h.append(own_h)
        at, h = np.concatenate(at), np.concatenate(h)
        row = np.searchsorted(t.ends, at, "right") - 1
        order = np.argsort(row, kind="stable")
        at, h, row = at[order], h[order], row[order]
        counts = np.bincount(row, minlength=len(texts))
        hits = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array((at - t.ends[row]).astype(np.int64))], names=["h", "at"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), hits)
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "hits"])
        yield out if every else out.filter(pa.array(counts > 0))


_HITS = "hits array<struct<h: long, at: long>>"


def item_windows(items: DataFrame) -> DataFrame:
    """number, item_id, text, times, n (tokens), width and hits of each distinct item with a word; stored."""
    alike = items.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("times"))
    alike = written(alike.withColumn("number", F.monotonically_increasing_id()), "decontamination-items")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in rows:
            for i, text in enumerate(batch.column("text").to_pylist()):
                t = templates.of([text])
                if not len(t.names):
                    continue
                width = window_width(len(t.names), len(t.words))
                at, h = templates.windows(t, width)
                one = batch.slice(i, 1)
                hits = pa.array([[{"h": x, "at": y} for x, y in zip(h.view(np.int64).tolist(), at.tolist(), strict=True)]], pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in ("number", "item_id", "text", "times")), pa.array([width], pa.int32()), hits], names=["number", "item_id", "text", "times", "width", "hits"])

    return written(alike.mapInArrow(run, f"number long, item_id long, text binary, times long, width int, {_HITS}"), "decontamination-windows")


def _screen(windows: DataFrame, widths: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]] | None:
    """For each width the items' window hashes and which leading bits they have; none if there are more than SCREEN_WINDOWS."""
    if windows.agg(F.sum(F.size("hits"))).first()[0] > SCREEN_WINDOWS:
        return None
    got = windows.select("width", F.explode("hits.h").alias("h")).distinct().toPandas()
    made = {}
    for width in widths:
        known = np.sort(got.h[got.width == width].to_numpy(np.int64).view(np.uint64))
        near = np.zeros(1 << 22, bool)
        near[(known >> np.uint64(42)).astype(np.int64)] = True
        made[width] = near, known
    return made


def _judge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of rows of (doc_id, key, text, met: number, item_id, text, times and shifts of items)."""
    templates = Templates()
    known: dict[int, tuple[Template, np.ndarray]] = {}
    for batch in rows:
        out = []
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            doc_id, key, text = (one.column(c)[0].as_py() for c in ("doc_id", "key", "text"))
            doc = templates.of([text])
            theirs = templates.values(doc)
            for met in one.column("met")[0].as_py():
                if met["number"] not in known:
                    if len(known) > 20_000:
                        known.clear()
                    item = templates.of([met["text"]])
                    known[met["number"]] = item, templates.values(item)
                pair = Pair(*known[met["number"]], doc, theirs)
                best = None
                for shift in sorted(met["shifts"]):
                    best = _better(best, pair.match(shift))
                if best:
                    out += [(doc_id, key, met["item_id"], best.start, best.run, best.share, best.verbatim)] * met["times"]
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "key", "item_id", "start", "run", "share", "verbatim"])


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, key (a hash of the text), item_id, start, run, share, verbatim; a row of each match of each row of ``docs``."""
    schema = "doc_id long, key long, item_id long, start long, run long, share double, verbatim boolean"
    spark = docs.sparkSession
    windows = item_windows(items)
    widths = sorted(r.width for r in windows.select("width").distinct().collect())
    if not widths:
        return spark.createDataFrame([], schema)
    screen = spark.sparkContext.broadcast(_screen(windows, widths))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).withColumn("key", F.xxhash64("text"))

    def search(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _places(screen.value, widths, text_blocks(rows, "text", BLOCK_BYTES), ["doc_id", "key", "text"], False)

    # of each document with a place all that is needed later, so that the others aren't read again
    near = written(texts.mapInArrow(search, f"{_KEYED}, {_HITS}"), "decontamination-places")
    salt = F.pmod(F.xxhash64("key", "doc_id"), F.lit(SALTS))
    places = near.select("doc_id", "key", salt.alias("salt"), F.explode("hits").alias("hit")).select("doc_id", "key", "salt", "hit.h", "hit.at").distinct()
    theirs = windows.select("number", F.explode("hits").alias("hit"), F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>").alias("salts"))
    theirs = theirs.select("number", F.explode("salts").alias("salt"), "hit.h", F.col("hit.at").alias("place"))
    met = places.join(theirs, ["h", "salt"]).groupBy("doc_id", "key", "number").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    size = windows.agg(F.sum(F.length("text"))).first()[0]
    named = met.join(windows.select("number", "item_id", "text", "times"), "number").withColumn("part", F.pmod(F.xxhash64("number"), F.lit(-(-size // ITEM_BYTES))))
    groups = named.groupBy("doc_id", "key", "part").agg(F.collect_list(F.struct("number", "item_id", "text", "times", "shifts")).alias("met"))
    groups = groups.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "met")
    asked = near.join(groups, near.doc_id.eqNullSafe(F.col("of")) & (near.key == F.col("of_key"))).select("doc_id", "key", "text", "met")
    return asked.mapInArrow(_judge, schema)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start (word), run (words or tokens), share, verbatim for each document and item that it leaks."""
    return _leaks(docs, items).drop("key")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that no item contaminates."""
    of, of_key = free(docs, "of"), free(docs, "of_key")
    bad = written(_leaks(docs, items).select(F.col("doc_id").alias(of), F.col("key").alias(of_key)).distinct(), "decontamination-leaks")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(of)) & (key == F.col(of_key)), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of benchmark items in the documents; documents without any have no row."""
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
