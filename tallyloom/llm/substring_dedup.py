"""Exact removal of repeated word windows by locally consistent recompression.

Words are ``[^ \\t-\\r]+``; a window is 20 consecutive words of one document. A
word goes when a window that covers it has a word sequence that starts earlier
(smaller doc_id, or the same document and an earlier start), judged on the input.

How. Two rounds of recompression name the tokens: a round joins runs of equal
symbols, then pairs whose left symbol falls in one half of the alphabet and whose
right one in the other, the halves drawn by a hash. Names are hashes of what they
stand for, so every task gives equal substrings equal interior symbols without a
dictionary. Where two symbols meet that the second round leaves apart, and each
spans at most two words, the boundary depends on the five words around it only.
Of the boundaries in the middle of a window the one of least name is its anchor,
so equal windows have equal anchors at equal places; all windows of one anchor
form a span, the high-level symbol. Then

1. spans are grouped by anchor (the ten words around it). A span equal to an
   earlier one is a repeat as a whole. An anchor seen with one span only, once, is
   unique text. Spans of an anchor with several different spans are left over;
2. the windows of what is left over are compared by 128-bit hash.

Before either shuffle each block of documents sends one row for a span or window
that it holds many times, and one row for an anchor with many spans, so that a
passage found in a third of all documents is as many rows as there are blocks.

A row is known by its doc_id and a 64-bit hash of its text through all steps, so rows
of one doc_id, or of none, meet no places but their own. Spans of one anchor arrive
sorted and are judged as they pass: a group of any size takes the memory of two rows.

Names are hashes: two different runs of words are taken for equal only if 128 bits
agree (anchor and span, or both hashes of a window). No words are compared after that.

Defined results: null and blank texts have no words; kept text is empty. Rows with
one doc_id and different texts are different documents, ordered by a hash of the
text; rows alike in both are one document and each returns its result. A null
doc_id sorts last. Of equal windows at one place there is one. Very long texts are
named whole. Empty tables give no rows. Other columns are not read, whatever they
are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, WordHashes, as_binary, documents, mixed, paired, text_blocks, written

WINDOW = 20
#: An anchor stands at least so many words from either end of its windows.
MARGIN = 5
#: UTF-8 bytes of text that are named at once.
BLOCK_BYTES = 4 << 20
_FIRST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Kinds of rows: a span or window to be judged, a repeat, a span left over, an anchor with several spans.
OPEN, REPEAT, REST, MANY = range(4)


def places(kind: int, count: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row's kind, its number of windows and the first one, in 64 bits."""
    return np.int64(kind << 36) | count.astype(np.int64) << np.int64(32) | start.astype(np.int64)


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 36, place >> 32 & 15, place & 0xFFFFFFFF


class Namer:
    """Spans of the documents of a block."""

    def __init__(self) -> None:
        self.words = WordHashes()
        self.rolling = Rolling(0x9E3779B97F4A7C15)
        self.second = Rolling(0xC2B2AE3D27D4EB4F)

    def names(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The names of all words of the block, and where each document starts (and the last ends)."""
        split = [t.split() for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)
        return self.words.of([w for x in split for w in x]), ends

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """For each position the name of the boundary before it, or _NONE where there's none to use."""
        n = len(h)
        out = np.full(n, _NONE, np.uint64)
        left = (mixed(h + np.uint64(11)) & np.uint64(1)).astype(bool)
        joined = (h[:-1] == h[1:]) | (left[:-1] & ~left[1:])
        starts = np.flatnonzero(np.concatenate([[True], ~joined]))
        ends = np.concatenate([starts[1:], [n]])
        short = ends - starts <= 2
        names = self.rolling.ranges(self.rolling.prefixes(h), starts, ends)
        left = (mixed(names + np.uint64(13)) & np.uint64(1)).astype(bool)
        joined = (names[:-1] == names[1:]) | (left[:-1] & ~left[1:])
        use = np.flatnonzero(~joined & short[:-1] & short[1:])
        out[starts[use + 1]] = np.minimum(paired(names[use], names[use + 1]), _NONE - np.uint64(1))
        return out

    def spans(self, h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor, span name, first window, windows) of the block's windows."""
        n = len(h)
        windows = n - WINDOW + 1
        if windows <= 0:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        whole = doc[:windows] == doc[WINDOW - 1 :]
        f = self.anchors(h)
        best = np.arange(n)

        def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(f[a] <= f[b], a, b)

        for step in (1, 2, 4):  # the least of 8 from each position on, then of 11 in all
            best = less(best[:-step], best[step:])
        best = less(best[:-3], best[3:])
        best = best[MARGIN : MARGIN + windows]
        at = np.flatnonzero(whole)
        anchor = best[at]
        alone = f[anchor] == _NONE  # a window without an anchor stands for itself
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | alone[1:] | alone[:-1] | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [len(at)]]))
        lo, p, alone = at[first], anchor[first], alone[first]
        hi = lo + count - 1 + WINDOW
        prefixes = self.rolling.prefixes(h)
        span = mixed(self.rolling.ranges(prefixes, lo, hi) + (p - lo).astype(np.uint64) * ~alone)
        key = self.rolling.ranges(prefixes, np.where(alone, lo, p - MARGIN), np.where(alone, hi, p + MARGIN))
        return mixed(key + alone.astype(np.uint64)), span, lo, count

    def windows(self, h: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes and the start of every window of the ranges given."""
        start = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        return (
            self.rolling.ranges(self.rolling.prefixes(h), start, start + WINDOW),
            self.second.ranges(self.second.prefixes(h), start, start + WINDOW),
            start,
        )


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=list(_COLUMNS))


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before in any column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _first(new: np.ndarray) -> np.ndarray:
    """Of each row the place of the last change at or before it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def combined(a: np.ndarray, s: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray, spans: bool) -> Iterator[pa.RecordBatch]:
    """A block's rows with what the block alone decides: its repeats, and, of spans, anchors with several."""
    place = places(OPEN, count, start)
    a, s = a.view(np.int64), s.view(np.int64)
    order = np.lexsort((place, key, doc, s, a))
    a, s, doc, key, place = a[order], s[order], doc[order], key[order], place[order]
    new_a = _changes(a)
    new_s = new_a | _changes(s)
    first = _first(new_s)
    zeros = np.zeros(len(a), np.int64)

    def known(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        # decided rows are dealt by their document, not by what they repeat
        spread = mixed(a[rows].view(np.uint64) + doc[rows].view(np.uint64) + key[rows].view(np.uint64))
        return _rows(spread, zeros[: len(rows)], doc[rows], key[rows], place[rows] | np.int64(kind << 36))

    yield known(np.flatnonzero((doc != doc[first]) | (key != key[first]) | (place != place[first])), REPEAT)
    keep = new_s
    if spans:
        group = np.cumsum(new_a) - 1
        many = (np.bincount(group[new_s]) > 1)[group]
        yield known(np.flatnonzero(new_s & many), REST)
        told = np.flatnonzero(new_a & many)  # sorts before all spans of its anchor
        yield _rows(a[told], np.full(len(told), _FIRST), zeros[: len(told)], zeros[: len(told)], np.full(len(told), MANY << 36, np.int64))
        keep = new_s & ~many
    own = np.flatnonzero(keep)
    yield _rows(a[own], s[own], doc[own], key[own], place[own])


def judged(rows: Iterator[pa.RecordBatch], spans: bool) -> Iterator[pa.RecordBatch]:
    """(doc, key, place) of repeats and of spans left over, from rows sorted by a, s, doc, key, place.

    What is carried from batch to batch is the last open row, the first row of its
    run, and whether its anchor has several spans; of an anchor whose second span has
    not come yet the first one waits.
    """
    last = None  # (a, s) of the last open or telling row
    head = None  # (doc, key, place) of its run's first row
    many, waiting = False, None
    for batch in rows:
        if not batch.num_rows:
            continue
        a, s, doc, key, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in _COLUMNS)
        kind = unplaced(place)[0]
        decided = (kind == REPEAT) | (kind == REST)
        out = [(doc[decided], key[decided], place[decided])]
        use = np.flatnonzero(~decided)
        if len(use):
            a, s, doc, key, place, kind = a[use], s[use], doc[use], key[use], place[use], kind[use]
            new_a = _changes(a)
            new_s = new_a | _changes(s)
            if last is not None and last[0] == a[0]:
                new_a[0] = False
                new_s[0] = last[1] != s[0]
            first = _first(new_s)
            head_doc, head_key, head_place = doc[first], key[first], place[first]
            if not new_s[0]:  # the run began in a batch before
                end = int(np.argmax(new_s)) if new_s.any() else len(new_s)
                head_doc[:end], head_key[:end], head_place[:end] = head
            repeat = (kind == OPEN) & ((doc != head_doc) | (key != head_key) | (place != head_place))
            out.append((doc[repeat], key[repeat], place[repeat] | np.int64(REPEAT << 36)))
            if spans:
                group = np.cumsum(new_a) - int(new_a[0])
                runs = np.bincount(group, weights=new_s) + 2 * np.bincount(group, weights=kind == MANY)
                if not new_a[0]:
                    runs[0] += 2 if many else 1  # what came before in this anchor
                several = runs > 1
                if waiting is not None:
                    if not new_a[0] and several[0]:
                        out.append(tuple(np.array([x]) for x in waiting))
                        waiting = None
                    elif new_a[0] or len(several) > 1:
                        waiting = None  # its anchor had no other span
                rest = (kind == OPEN) & new_s & several[group]
                out.append((doc[rest], key[rest], place[rest] | np.int64(REST << 36)))
                many = bool(several[-1])
                at = int(np.argmax(group == group[-1]))
                if not many and new_a[at]:
                    waiting = doc[at], key[at], place[at] | np.int64(REST << 36)
            last = a[-1], s[-1]
            head = head_doc[-1], head_key[-1], head_place[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc", "key", "place"])


_COLUMNS = ("a", "s", "doc", "key", "place")
_JUDGED = "doc long, key long, place long"
_ROWS = "a long, s long, doc long, key long, place long"


def _span_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    namer = Namer()
    for batch, texts in text_blocks(rows, "text", BLOCK_BYTES):
        h, ends = namer.names(texts)
        a, s, lo, count = namer.spans(h, ends)
        if len(a):
            at = np.searchsorted(ends, lo, "right") - 1
            yield from combined(a, s, _doc_ids(batch.column("doc_id"))[at], _keys(batch.column("key"))[at], lo - ends[at], count, True)


def _places_of(column: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, windows) of the places of a kind."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    kinds, count, start = unplaced(np.ascontiguousarray(flat, dtype=np.int64))
    own = kinds == kind
    return np.repeat(np.arange(len(column)), lengths)[own], start[own], count[own]


def _window_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    namer = Namer()
    for batch, texts in text_blocks(rows, "text", BLOCK_BYTES):
        h, ends = namer.names(texts)
        row, start, count = _places_of(batch.column("places"), REST)
        if len(row):
            w1, w2, at = namer.windows(h, ends[row] + start, count)
            row = np.repeat(row, count)
            yield from combined(w1, w2, _doc_ids(batch.column("doc_id"))[row], _keys(batch.column("key"))[row], at - ends[row], np.ones(len(row), np.int64), False)


def _kept_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_blocks(rows, "text", BLOCK_BYTES):
        row, start, count = _places_of(batch.column("places"), REPEAT)
        order = np.argsort(row, kind="stable")
        row, start, count = row[order], start[order], count[order]
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        n_words, n_removed, kept = [], [], []
        for i, text in enumerate(texts):
            words = text.split()
            n_words.append(len(words))
            gone = 0
            if cut[i] < cut[i + 1]:
                change = np.zeros(len(words) + 1, np.int64)
                own = slice(cut[i], cut[i + 1])
                np.add.at(change, start[own], 1)
                np.add.at(change, start[own] + count[own] - 1 + WINDOW, -1)
                stays = np.cumsum(change[:-1]) == 0
                gone = len(words) - int(stays.sum())
                words = [words[j] for j in np.flatnonzero(stays).tolist()]
            n_removed.append(gone)
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, with single spaces) of every row of ``docs``."""
    texts = as_binary(docs, "doc_id").withColumn("key", F.xxhash64("text"))
    # texts meet their places by doc_id and key twice; it's the same exchange
    keyed = texts.select("doc_id", "text", F.col("key").alias("of_key"), F.coalesce("doc_id", F.lit(_LAST)).alias("of"))

    def sorted_by_name(rows: DataFrame) -> DataFrame:
        return rows.repartition("a").sortWithinPartitions(*_COLUMNS)

    def with_places(found: DataFrame, how: str) -> DataFrame:
        # a document has at most as many places as windows
        lists = found.groupBy("doc", "key").agg(F.collect_list("place").alias("places"))
        met = keyed.join(lists.hint("shuffle_hash"), (F.col("of") == F.col("doc")) & (F.col("of_key") == F.col("key")), how)
        return met.select("doc_id", F.col("of_key").alias("key"), "text", "places")

    spans = sorted_by_name(texts.mapInArrow(_span_rows, _ROWS)).mapInArrow(lambda rows: judged(rows, True), _JUDGED)
    spans = written(spans, "substring-spans")
    kind = F.shiftright("place", 36)
    rest = with_places(spans.filter(kind == REST), "inner").mapInArrow(_window_rows, _ROWS)
    windows = written(sorted_by_name(rest).mapInArrow(lambda rows: judged(rows, False), _JUDGED), "substring-windows")
    repeats = spans.filter(kind == REPEAT).unionByName(windows)
    return with_places(repeats, "left").mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows, as counts and a digest."""
    found = substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM t),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER f AS seq, count(*) OVER f AS n
      FROM w WHERE word <> '' WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, word, CASE WHEN n = 20 THEN row_number() OVER (PARTITION BY seq, n ORDER BY doc_id, i) ELSE 1 END > 1 AS again FROM g),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
}
