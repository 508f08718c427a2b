"""SimHash near-deduplication by anchor points of a covering code.

Fingerprints link at 3 or fewer differing bits, so in one of two halves (31 and
33 bits) they differ in at most one. A half's anchors are the words of a covering
code: the perfect Hamming code of 31 bits, of covering radius 1, times the plain
code of the 2 bits left over. A fingerprint goes to every anchor within radius
plus 1 of its half: 16 or 18 of them. Of a linked pair, one has its nearest
anchor within 1, and the other is within 2 of that anchor, so they meet there and
are compared in full. Equal fingerprints are one node. An anchor met by more than
``CROWD`` fingerprints is not compared by all pairs: its members go on to 20
finer tables (3 of 6 blocks equal, which 3 differing bits always leave), which
keep every link.

Defined results: null and blank texts have fingerprint zero, which links like any
other. Rows repeated with one doc_id are one row each, in the same component. A
null doc_id gets a fingerprint and its component's id; it never is that id unless
all of its component's are null. Equal fingerprints are linked by being equal. Very
long texts are read whole. Empty tables give no rows. Other columns are not read,
whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import as_binary, documents, free, mixed, text_bytes, written
from .components import components, forest

BITS = 3
CROWD = 2048


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of the ASCII-lower-cased text, repeats included."""
    words = text.lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = [majority(shingle_hashes(t, width)) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return as_binary(docs, "doc_id").mapInArrow(run, "doc_id long, fp long")


# --------------------------------------------------------------------- anchors

_CHECKS = [sum(1 << i for i in range(31) if (i + 1) >> k & 1) for k in range(5)]
#: For each syndrome, the pairs of positions whose flips lead to a code word.
_TWO = np.array([[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s)] if s else [0] * 15 for s in range(32)], np.uint64)
_ONE = np.array([0] + [1 << i for i in range(31)], np.uint64)


def _anchors_31(part: np.ndarray) -> np.ndarray:
    """Code words within 2: the nearest one, then up to 15 more (the nearest again where there are none)."""
    syndrome = sum(((np.bitwise_count(part & np.uint64(m)) & 1).astype(np.int64) << k) for k, m in enumerate(_CHECKS))
    home = part ^ _ONE[syndrome]
    more = np.where((syndrome > 0)[:, None], part[:, None] ^ _TWO[syndrome], home[:, None])
    return np.concatenate([home[:, None], more], axis=1)


def anchor_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every anchor that the fingerprints are replicated to."""
    low, high = fps & np.uint64(0x7FFFFFFF), fps >> np.uint64(31)
    left = _anchors_31(low)
    rest, extra = high & np.uint64(0x7FFFFFFF), high >> np.uint64(31)
    right = _anchors_31(rest)
    beside = np.stack([right[:, 0] | ((extra ^ np.uint64(b)) << np.uint64(31)) for b in (1, 2)], axis=1)
    right = np.concatenate([right | (extra << np.uint64(31))[:, None], beside], axis=1) | np.uint64(1 << 40)
    keys = np.concatenate([left, right], axis=1)
    first = np.ones(keys.shape, bool)  # code words have no second of their own
    first[:, 1:16] = left[:, 1:] != left[:, :1]
    first[:, 17:32] = right[:, 1:16] != right[:, :1]
    return np.nonzero(first)[0], keys[first]


_BLOCKS = [((1 << 11) - 1 if i < 4 else (1 << 10) - 1) << (11 * min(i, 4) + 10 * max(0, i - 4)) for i in range(6)]
_TABLES = [sum(_BLOCKS[i] for i in three) for three in combinations(range(6), 3)]


def finer_keys(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the tables that a crowded anchor's members go on to."""
    made = [mixed(mixed(keys + np.uint64(n + 1)) + (fps & np.uint64(m))) for n, m in enumerate(_TABLES)]
    return np.tile(np.arange(len(fps)), len(made)), np.concatenate(made)


def close_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints, in blocks of bounded memory."""
    us, vs = [], []
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at:]) <= BITS
        i, j = np.nonzero(near)
        keep = j > i
        a, b = forest(fps[at + i[keep]].view(np.int64), fps[at + j[keep]].view(np.int64))
        us.append(a)
        vs.append(b)
    return forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2


def _compared(rows: Iterator[pa.RecordBatch], finer: bool) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, fp) sorted by key; rows of crowded keys come out again if ``finer``.

    Out: u, v and a flag; flagged rows are (key, fp) of crowds. Groups of up to
    CROWD rows are held; larger ones pass through piece by piece.
    """

    def table(u: np.ndarray, v: np.ndarray, crowd: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.full(len(u), crowd))], names=["u", "v", "crowd"])

    held_k = held_f = np.zeros(0, np.uint64)
    crowded = None
    for batch in chain(_in_parts(rows), [None]):
        if batch is not None:
            keys = np.concatenate([held_k, batch[0]])
            fps = np.concatenate([held_f, batch[1]])
            end = np.searchsorted(keys.view(np.int64), keys[-1].view(np.int64)) if len(keys) else 0  # the last key may go on
        else:
            keys, fps, end = held_k, held_f, len(held_k)
        if crowded is not None and end == 0 and batch is not None and len(keys) and keys[0] == crowded:
            yield table(keys, fps, True)
            held_k = held_f = np.zeros(0, np.uint64)
            continue
        held_k, held_f = keys[end:], fps[end:]
        keys, fps = keys[:end], fps[:end]
        if crowded is not None and (late := keys == crowded).any():  # the rest of a crowd that began in another batch
            yield table(keys[late], fps[late], True)
            keys, fps = keys[~late], fps[~late]
        if finer and batch is not None and len(held_k) > CROWD:  # another crowd, so only now that the one before is through
            crowded = held_k[0]
            yield table(held_k, held_f, True)
            held_k = held_f = np.zeros(0, np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([starts, [len(keys)]]))
        group = np.repeat(sizes, sizes)
        offset = np.arange(len(keys)) - np.repeat(starts, sizes)
        for step in range(1, min(16, int(sizes.max(initial=1)))):  # the small groups, all at once
            i = np.flatnonzero((group <= 16) & (offset + step < group))
            i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= BITS]
            if len(i):
                yield table(fps[i], fps[i + step], False)
        for n in np.flatnonzero(sizes > 16):
            own = fps[starts[n] : starts[n] + sizes[n]]
            if finer and len(own) > CROWD:
                yield table(keys[starts[n] : starts[n] + sizes[n]], own, True)
            else:
                yield table(*close_pairs(own), False)
        if crowded is not None and len(held_k) and held_k[0] != crowded:
            crowded = None


def _in_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in rows:
        if batch.num_rows:
            yield tuple(batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("key", "fp"))


def _keyed(fps: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = anchor_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64))], names=["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """u, v: links that connect all distinct fingerprints (column fp) within BITS of each other."""
    flagged = "u long, v long, crowd boolean"
    dealt = _keyed(fps).repartition("key").sortWithinPartitions("key")
    first = written(dealt.mapInArrow(lambda rows: _compared(rows, True), flagged), "simhash-links")
    crowds = first.filter("crowd").select(F.col("u").alias("key"), F.col("v").alias("fp"))

    def spread(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, own in _in_parts(rows):
            row, key = finer_keys(keys, own)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own[row].view(np.int64))], names=["key", "fp"])

    again = crowds.mapInArrow(spread, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return first.filter("not crowd").select("u", "v").unionByName(again.mapInArrow(lambda rows: _compared(rows, False), flagged).select("u", "v"))


def _rooted(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint that stands for the component), component_id for each row of ``docs``."""
    rows = written(fingerprints(docs, width), "simhash-fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "simhash-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids.withColumnRenamed("root", "of"), F.col("root") == F.col("of")).select(F.col("fp").alias("of_fp"), "root", "component_id")
    return rows.join(by_fp, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "root", "component_id")


def near_groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``."""
    return _rooted(docs, width).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, width: int = 3) -> DataFrame:
    """The rows of ``docs``, all their columns: of each component the one of least doc_id.

    Of rows repeated with that doc_id, or of a component without any doc_id, the
    one of least text stays.
    """
    groups = written(_rooted(docs, width), "simhash-groups")
    is_least = F.col("doc_id").eqNullSafe(F.col("component_id"))
    by_id = written(groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(is_least).alias("stays")).filter("stays"), "simhash-least")
    if not by_id.filter("rows > 1 OR doc_id IS NULL").head(1):
        of = free(docs, "of")
        least = by_id.select(F.col("doc_id").alias(of)).hint("shuffle_hash")
        return docs.join(least, docs["doc_id"] == F.col(of), "left_semi")
    # rows share a doc_id: tell them apart by fingerprint, then by text
    fp = free(docs, "fp")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = _with_fingerprints(docs, width, fp).select(whole, F.col(f"`{fp}`").alias("own_fp"))
    own = groups.select("fp", "root", "component_id").distinct()
    met = packed.join(own, F.col("own_fp") == F.col("fp")).filter(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    # combined before the shuffle, so however many rows a component has, a task sends one
    order = F.struct(F.col("row.text").isNotNull().alias("a"), F.col("row.text").alias("b"))
    return met.groupBy("root").agg(F.min_by("row", order).alias("row")).select("row.*")


def _with_fingerprints(docs: DataFrame, width: int, name: str) -> DataFrame:
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = [majority(shingle_hashes(t, width)) for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, 3-word shingles, 3 bits."""
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
