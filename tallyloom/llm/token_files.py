"""Token ids in binary files of independent zstandard frames with a seek table.

A file holds the ids of one run of documents in ascending doc_id order:

* frames: each the zstandard frame of whole documents' ids, as little-endian
  unsigned 32-bit integers one after the other;
* index frame: a zstandard skippable frame (magic 0x184D2A50) with, for every
  document, its doc_id (int64), tokens (uint32), frame (uint32) and the place of
  its first id in that frame (uint32);
* seek table: that of the public seekable format, a skippable frame (magic
  0x184D2A5E) with an entry for each frame before it (compressed size, size, low
  32 bits of the XXH64 of the ids, all uint32; the index frame is the last entry,
  of size 0) and a footer of 9 bytes: number of entries (uint32), a flag byte for
  checksums and the magic 0x8F92EAB1.

A reader takes the footer, then the tables, then decompresses the frames of the
documents asked for and no others. Plain zstandard tools skip the tables and see
the ids; readers of the seekable format find the frames.

Documents are dealt to tasks by ranges of doc_id and the first characters of the
text, so neither one task sees the whole order nor do all rows of one doc_id, or of
none, meet in one; starts come from the counts of the files before, a row for each
file. A task closes a file at ``FILE_IDS`` ids or ``FILE_DOCS`` documents and begins
another, so what it holds of a file (its index) is bounded. A file's name is drawn
anew by each attempt of a task and only those of attempts that succeeded are in the
manifest, so lost executors leave garbage but no wrong rows.

Defined results: a null or empty text has the end id alone. The strings of added
tokens in a text are those tokens, as the library does by default. Rows with equal
doc_id are written side by side, in the order of their texts; rows alike have a
place each. A null doc_id comes first. A very long text has a frame of its own.
Empty tables make no file. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, new_path, written

END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Ids that a frame takes before the next begins; a longer document has a frame of its own.
FRAME_IDS = 1 << 16
#: Rows of a batch whose texts are Python strings at once.
SLICE_ROWS = 250
#: Cuts of texts whose ids an encoder remembers.
WORDS = 1_000_000
#: Ids and documents at which a file is closed.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
#: Characters of a text that tell ranges of one doc_id apart.
RANGE_CHARS = 32
INDEX, SKIPPABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_INDEX = np.dtype([("doc_id", "<i8"), ("tokens", "<u4"), ("frame", "<u4"), ("at", "<u4")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


def _check(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file to an open stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._index = array("q")
        self.seeks: list[tuple[int, int, int]] = []
        self.held: list[np.ndarray] = []
        self.n = self.tokens = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if self.n and self.n + len(ids) > self.frame_ids:
            self._frame()
        self._index.extend((doc_id, len(ids), len(self.seeks), self.n))
        self.held.append(ids)
        self.n += len(ids)
        self.tokens += len(ids)

    @property
    def n_docs(self) -> int:
        return len(self._index) // 4

    def _frame(self) -> None:
        raw = np.concatenate(self.held).astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.seeks.append((len(packed), len(raw), _check(raw)))
        self.held, self.n = [], 0

    def close(self) -> None:
        if self.n:
            self._frame()
        rows = np.empty(self.n_docs, _INDEX)
        for i, name in enumerate(_INDEX.names):
            rows[name] = np.frombuffer(self._index, np.int64)[i::4]
        index = zstandard.ZstdCompressor(level=3).compress(rows.tobytes())
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        self.seeks.append((len(index) + 8, 0, _check(b"")))
        table = np.array(self.seeks, _SEEK).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + _FOOTER.size) + table)
        self.out.write(_FOOTER.pack(len(self.seeks), 0x80, SEEKABLE))


class FrameReader:
    """Reads documents of one file, by place; decompresses only the frames they are in."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOTER.size)
        frames, _, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        table = frames * _SEEK.itemsize
        source.seek(size - _FOOTER.size - table)
        self.seeks = np.frombuffer(source.read(table), _SEEK)
        index = int(self.seeks["packed"][-1])
        source.seek(size - _FOOTER.size - table - 8 - index)
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(source.read(index)[8:])
        self.index = np.frombuffer(raw, _INDEX)
        self.starts = np.concatenate([[0], np.cumsum(self.seeks["packed"].astype(np.int64))])
        self.unpacker = zstandard.ZstdDecompressor()
        self._last: tuple[int, np.ndarray] | None = None

    def frame(self, number: int) -> np.ndarray:
        if self._last is None or self._last[0] != number:
            packed, size, check = (int(x) for x in self.seeks[number])
            self.source.seek(int(self.starts[number]))
            raw = self.unpacker.decompress(self.source.read(packed), max_output_size=size)
            if _check(raw) != check:
                raise ValueError(f"frame {number} doesn't match its checksum")
            self._last = number, np.frombuffer(raw, "<u4")
        return self._last[1]

    def document(self, row: int) -> np.ndarray:
        _, tokens, frame, at = (int(x) for x in self.index[row])
        return self.frame(frame)[at : at + tokens] if tokens else np.zeros(0, "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Rows of a document."""
        return np.flatnonzero(self.index["doc_id"] == doc_id).tolist()


_UNEVEN = re.compile(r" (?:\s|\Z)")
#: The pre-tokens of a byte-level pre-tokenizer, and the characters that show their bytes to the model.
_PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b)) for b in range(256)}


class Encoder:
    """Ids of texts by a byte-level BPE of the tokenizers library.

    Such a BPE never joins across pre-tokens, and one always begins at a space
    before a character that isn't white space. So a text is cut there, and each
    distinct cut goes through the library's model once; texts
    repeat their words far more often than they bring new ones. A text with the
    string of an added token goes through the library whole.
    """

    def __init__(self, path: str, limit: int = WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        state = json.loads(self.whole.to_str())
        before = state["pre_tokenizer"] or {}
        self.by_cuts = state["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in state["added_tokens"]) or r"(?!)")
        self.model, self.limit = self.whole.model, limit
        self.cuts: _Cuts = _Cuts(self)
        self.marks = {c: self._pre_token(c) for c in ".,;:!?"}

    def _pre_token(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def cut(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._pre_token, _PIECES.findall(text)))

    def spaced(self, part: str) -> bytes:
        """The ids of a space and ``part``."""
        if part.isalpha():
            return self._pre_token(" " + part)
        if part[-1:] in self.marks and part[:-1].isalpha():  # letters and one mark are two pre-tokens
            return self.cuts[part[:-1]] + self.marks[part[-1]]
        return self.cut(" " + part)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.by_cuts or self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.cuts) > self.limit:
            self.cuts.clear()
        first, *parts = text.split(" ")
        if _UNEVEN.search(text):
            cuts = [first]
            for part in parts:  # a space before white space or the end is no start
                if part and not part[0].isspace():
                    cuts.append(" " + part)
                else:
                    cuts[-1] += " " + part
            return np.frombuffer(b"".join(map(self.cut, cuts)), "<u4")
        return np.frombuffer(self.cut(first) + b"".join(map(self.cuts.__getitem__, parts)), "<u4")


class _Cuts(dict):
    """By what follows the space."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.encoder.spaced(part)
        return ids


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_tokens(docs: DataFrame, where: str, vocabulary: str | None = None, end_id: int = END_ID, frame_ids: int = FRAME_IDS, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS, words: int = WORDS) -> DataFrame:
    """Writes the ids of every text and of the end id after it to files in folder ``where`` (a URI all executors share).

    Returns the manifest, a row for each file: path, part and nth (files in ascending
    doc_id order), n_docs, n_tokens, n_bytes. words: cuts that an encoder remembers.
    """
    vocabulary = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    folder, at = pafs.FileSystem.from_uri(where)
    folder.create_dir(at)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        encoder.limit = words
        store, folder = pafs.FileSystem.from_uri(where)
        out = writer = part = None
        done: list[dict] = []
        schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("nth", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])

        def close() -> None:
            writer.close()
            done.append({"path": name, "part": part, "nth": len(done), "n_docs": writer.n_docs, "n_tokens": writer.tokens, "n_bytes": out.tell()})
            out.close()

        for batch in rows:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part_rows = batch.slice(at, SLICE_ROWS)
                part = part_rows.column("part")[0].as_py()
                ids = part_rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_pylist()
                for doc_id, text in zip(ids, part_rows.column("text").to_pylist(), strict=True):
                    if writer is None:
                        name = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}.zst"
                        out = store.open_output_stream(name, compression=None)
                        writer = FrameWriter(out, frame_ids)
                    writer.add(doc_id, np.append(encoder.ids(text), np.uint32(end_id)))
                    if writer.tokens >= file_ids or writer.n_docs >= file_docs:
                        close()
                        writer = None
        if writer is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(files, "doc_id", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    return written(ordered.mapInArrow(run, "path string, part int, nth int, n_docs long, n_tokens long, n_bytes long"), "tokens-manifest")


def _placed(manifest: DataFrame) -> DataFrame:
    """path, start of each file, a task for each: rows this small would else be gathered in one."""
    # a row for each file; the running sum over them is one small task
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return manifest.select("path", before.alias("start")).repartition(max(1, manifest.count()))


def _frames(rows: Iterator[pa.RecordBatch], where: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, starts, ids of all, where a document's ids begin and the last end) of each frame of the files."""
    store, _ = pafs.FileSystem.from_uri(where)
    for batch in rows:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with store.open_input_file(path) as source:
                reader = FrameReader(source)
                tokens = reader.index["tokens"].astype(np.int64)
                starts = start + np.cumsum(tokens) - tokens
                row = 0
                while row < len(tokens):
                    frame = int(reader.index["frame"][row])
                    end = int(np.searchsorted(reader.index["frame"], frame, "right"))
                    ids = np.concatenate([reader.document(i) for i in range(row, end)])
                    yield reader.index["doc_id"][row:end].astype(np.int64), starts[row:end], ids, np.concatenate([[0], np.cumsum(tokens[row:end])])
                    row = end


def _ids_or_null(doc_ids: np.ndarray) -> pa.Array:
    return pa.array(doc_ids, mask=doc_ids == np.iinfo(np.int64).min)


def read_tokens(manifest: DataFrame, where: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids of every document in the files of a manifest."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ids, offsets in _frames(rows, where):
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([_ids_or_null(doc_ids), pa.array(starts), lists], names=["doc_id", "start", "ids"])

    return _placed(manifest).mapInArrow(run, "doc_id long, start long, ids array<int>")


def digests(manifest: DataFrame, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; the ids stay in the task that reads them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, starts, ids, offsets in _frames(rows, where):
            raw = ids.astype("<u4")
            crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([_ids_or_null(doc_ids), pa.array(starts), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(manifest).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files and read back from them."""
    where = new_path(spark, "tokens")
    return digests(write_tokens(documents(spark, sf_dir), where), where)
