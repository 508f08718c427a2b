"""Helpers that the corpus operators share.

Everything that has to outlive a task is written to the folder named by
``spark.checkpoint.dir``; executors and driver share no other folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, return.
BLANKS = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder all executors see; a temporary one only where the session names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tallyloom-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, stored once and read back: lineage ends at the shared folder."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, with a number after it where ``df`` has such a column, by any case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if n.lower() not in taken)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a binary or string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_binary(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the columns an operator reads, the text as UTF-8 bytes (null: empty)."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(text))


class WordHashes(dict):
    """XXH64 of words, each computed once; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paired(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Names of ordered pairs of names."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + mixed(b + np.uint64(salt * 2 + 1)))


class Rolling:
    """Hashes of any range of a sequence of 64-bit names, from prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base = base | 1
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._power) < n:
            n = max(n, 2 * len(self._power))
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            self._power = np.multiply.accumulate(steps)
            steps[1:] = pow(self.base, -1, 1 << 64)
            self._inverse = np.multiply.accumulate(steps)

    def prefixes(self, names: np.ndarray) -> np.ndarray:
        self._grow(len(names) + 1)
        out = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(names * self._power[: len(names)], out=out[1:])
        return out

    def ranges(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((prefixes[ends] - prefixes[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))


def batches_of(rows: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """The same rows in tables of at least ``least`` rows (the last may be shorter)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_blocks(rows: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``most`` bytes of text each; one document is never cut."""
    for batch in rows:
        texts = text_bytes(batch.column(column))
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > most:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
