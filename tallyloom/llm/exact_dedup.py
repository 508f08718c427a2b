"""Exact deduplication against immutable snapshots screened by binary fuse filters.

Texts are equal when identical after deleting ``[ \\t-\\r]``. A snapshot is a
table of distinct digests, dealt into buckets by the leading digest bits, with
one static filter per bucket. A batch is grouped by digest first, so a text
copied a million times is one digest; each distinct digest asks its bucket's
filter. Only positives join the snapshot's exact digests; negatives, which are
surely new, are grouped among themselves alone.

Equal digests are not taken on trust: the texts of digests with several rows are
compared byte by byte, and a difference stops the job, since it would be a collision
of SHA-256. A task compares equal digests it meets by itself and passes each on once
(again only if more than ``HELD_BYTES`` of other texts came between), so of a text
that a third of all rows hold a task sends one. Up to ``SCREEN_KEYS`` such digests
are known to every task, which sends no other text; beyond, all texts are sent once.

Buckets are as many as the larger side needs, so a batch against an empty snapshot
is dealt as a snapshot of its size would be.

Defined results: a null text is empty; all blank texts are equal to it. A null
doc_id sorts after every other. Of rows with as many code points the one of least
doc_id stays. Rows repeated with the same doc_id and text stay separate rows of one
group of which exactly one is kept. Very long texts are read whole. Empty tables
give no rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import BLANKS, as_binary, documents, text_bytes, written

#: Distinct digests that a bucket, and so a filter and a task's group, holds on average.
BUCKET_ROWS = 200_000
#: Leading digest bytes (8 each) of digests with several rows that go to every task, at most, and the texts a task holds for comparison.
SCREEN_KEYS, HELD_BYTES = 2_000_000, 64 << 20
#: What orders the members of a group, the least of which stays.
RANK = ("less", "unnamed", "doc_id")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the text), sha (32 bytes), size (bytes after deletion)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n_chars, sha, size = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                bare = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
                n_chars.append(len(text))
                sha.append(hashlib.sha256(bare).digest())
                size.append(len(bare))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_chars, pa.int64()), pa.array(sha, pa.binary()), pa.array(size, pa.int64())],
                names=["doc_id", "n_chars", "sha", "size"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, sha binary, size long")


def grouped(rows: DataFrame) -> DataFrame:
    """A row for each digest: best (the row that stays), members. Combined before the shuffle."""
    rank = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    return rows.groupBy("sha", "size").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("members"))


def bucket(sha: str, buckets: int) -> F.Column:
    return F.pmod(F.conv(F.hex(F.substring(F.col(sha), 1, 7)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def _keys(sha: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x[8:16] for x in sha.to_pylist()), np.uint64)


def filters(groups: DataFrame, buckets: int) -> DataFrame:
    """bucket, filter: one static filter for each bucket of a snapshot."""

    def run(part: pa.Table) -> pa.Table:
        made = fuse.build(_keys(part.column("sha")))
        return pa.table({"bucket": pa.array([part.column("bucket")[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})

    return groups.select("sha", bucket("sha", buckets).alias("bucket")).groupBy("bucket").applyInArrow(run, "bucket int, filter binary")


def screened(batch: DataFrame, snapshot_filters: DataFrame, buckets: int) -> DataFrame:
    """The batch's groups with ``maybe``: false where the filter rules the snapshot out."""
    flat = batch.select("sha", "size", "members", *(F.col(f"best.{c}").alias(c) for c in RANK), bucket("sha", buckets).alias("bucket"))
    columns = flat.columns[:-1]

    def run(part: pa.Table, filter_: pa.Table) -> pa.Table:
        known = filter_.column("filter")[0].as_py() if filter_.num_rows else b""
        maybe = pa.array(fuse.probe(known, _keys(part.column("sha"))))
        return pa.table([*(part.column(c) for c in columns), maybe], names=[*columns, "maybe"])

    asked = (
        flat.groupBy("bucket")
        .cogroup(snapshot_filters.groupBy("bucket"))
        .applyInArrow(run, "sha binary, size long, members long, less long, unnamed boolean, doc_id long, maybe boolean")
    )
    return asked.select("sha", "size", F.struct(*RANK).alias("best"), "members", "maybe")


def merged(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: sha, best, members.

    ``snapshot`` and ``batch`` are results of :func:`grouped`.
    """
    buckets = max(1, -(-max(snapshot.count(), batch.count()) // BUCKET_ROWS))
    asked = written(screened(batch, filters(snapshot, buckets), buckets), "exact-screened")
    positive = asked.filter("maybe").select("sha", "size", F.col("best").alias("new_best"), F.col("members").alias("new_members"))
    # a false positive of the filter finds no partner; the bytes of those that do are compared in byte_check
    both = snapshot.join(positive, ["sha", "size"], "full_outer")
    met = both.select(
        "sha",
        F.least("best", "new_best").alias("best"),
        (F.coalesce("members", F.lit(0)) + F.coalesce("new_members", F.lit(0))).alias("members"),
    )
    return met.unionByName(asked.filter(~F.col("maybe")).select("sha", "best", "members"))


def byte_check(docs: DataFrame, several: DataFrame) -> None:
    """Compares the texts of ``docs`` whose digests (column sha) several rows have; raises if two with one digest differ."""
    n = several.count()
    if not n:
        return
    spark = docs.sparkSession
    few = spark.sparkContext.broadcast(np.sort(_keys(several.toArrow().column("sha"))) if n <= SCREEN_KEYS else None)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        size = 0
        for batch in rows:
            out: list[tuple[bytes, bytes]] = []
            for text in text_bytes(batch.column("text")):
                bare = text.translate(None, BLANKS)
                sha = hashlib.sha256(bare).digest()
                if few.value is not None:
                    key = np.frombuffer(sha[8:16], np.uint64)[0]
                    at = int(np.searchsorted(few.value, key))
                    if at == len(few.value) or few.value[at] != key:
                        continue
                if (own := held.get(sha)) is None:
                    if size > HELD_BYTES:
                        held.clear()
                        size = 0
                    held[sha] = bare
                    size += len(bare)
                    out.append((sha, bare))
                elif own != bare:
                    raise ValueError(f"two texts have the digest {sha.hex()}")
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["sha", "bare"])

    sent = as_binary(docs).mapInArrow(run, "sha binary, bare binary")
    met = sent.join(several.select("sha"), "sha", "left_semi") if few.value is None else sent
    # a digest has a row for each task at most
    apart = met.groupBy("sha").agg(F.min("bare").alias("least"), F.max("bare").alias("most")).filter("least != most").select("sha").head(1)
    if apart:
        raise ValueError(f"two texts have the digest {apart[0].sha.hex()}")


def exact_dedup(docs: DataFrame, in_snapshot: F.Column) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    ``in_snapshot`` tells which rows the snapshot holds; the others are the new batch.
    """
    rows = written(digests(docs), "exact-digests").withColumn("old", F.coalesce(in_snapshot, F.lit(False)))
    groups = merged(written(grouped(rows.filter("old")), "exact-snapshot"), written(grouped(rows.filter(~F.col("old"))), "exact-batch"))
    groups = written(groups, "exact-groups")
    byte_check(docs, groups.filter("members > 1").select("sha"))
    # rows alike in all columns are told apart by their number; a text's copies meet a single row here, which a skewed join splits
    alike = rows.groupBy("sha", "n_chars", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    is_best = alike.doc_id.eqNullSafe(F.col("best.doc_id")) & (alike.n_chars == -F.col("best.less"))
    return (
        alike.join(groups.withColumnRenamed("sha", "of"), F.col("sha") == F.col("of"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.col("members").alias("group_size"),
            (is_best & (F.col("nth") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replayed as a snapshot (about half of the rows, by a hash of doc_id) and a new batch (the rest)."""
    return exact_dedup(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


ORACLE_SQL = {
    "op9_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
           FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn,
             count(*) OVER (PARTITION BY sha) AS group_size
      FROM t WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha AS text_sha256 FROM r
"""
}
