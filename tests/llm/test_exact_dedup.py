import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, fuse


def brute(rows):
    bare = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    out = []
    for (d, t), b in zip(rows, bare, strict=True):
        own = [(-len(u or ""), e is None, e or 0) for (e, u), c in zip(rows, bare, strict=True) if c == b]
        keep = min(own)
        out.append((d, None if keep[1] else keep[2], len(own), hashlib.sha256(b.encode()).hexdigest(), (-len(t or ""), d is None, d or 0) == keep))
    return out


@pytest.mark.parametrize("half", ["none", "all", "hash"])
def test_odd_rows(odd, half):
    docs, rows = odd
    snapshot = {"none": F.lit(False), "all": F.lit(True), "hash": F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0}[half]
    got = exact_dedup.exact_dedup(docs, snapshot).collect()
    want = brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3])
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted((w[:4] for w in want), key=key)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted({w[3] for w in want})  # one of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table(make):
    assert exact_dedup.exact_dedup(make([]), F.lit(False)).count() == 0


def test_filters_know_their_members():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        made = fuse.build(keys)
        assert fuse.probe(made, keys).all()
        others = rng.integers(2**63, 2**64, 20_000, dtype=np.uint64)
        assert fuse.probe(made, others).mean() < 0.02
        assert n < 1000 or len(made) < 1.5 * n


def test_screening_by_several_filters(make, words, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_ROWS", 10)
    rows = [(i, words(5, i % 60)) for i in range(200)]
    got = exact_dedup.exact_dedup(make(rows), F.col("doc_id") < 70).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in got) == sorted(brute(rows))


@pytest.mark.parametrize(("name", "value"), [("SCREEN_KEYS", 0), ("HELD_BYTES", 10), ("BUCKET_ROWS", 3)])
def test_limits_change_nothing(make, words, monkeypatch, name, value):
    monkeypatch.setattr(exact_dedup, name, value)
    rows = [(i, words(5, i % 20)) for i in range(60)]
    got = exact_dedup.exact_dedup(make(rows), F.lit(False)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256, r.kept) for r in got) == sorted(brute(rows))


def test_texts_of_one_digest_are_compared_byte_by_byte(make, spark):
    """With a digest that tells nothing apart all texts meet, and those that differ are noticed."""

    class Poor:
        def __init__(self, data):
            self.data = data

        def digest(self):
            return b"\0" * 32

    class Module:
        sha256 = Poor

    run = exact_dedup.byte_check
    several = spark.createDataFrame([(bytearray(32),)], "sha binary")
    own = {**run.__globals__, "hashlib": Module}
    poor = type(run)(run.__code__, own, run.__name__, run.__defaults__, run.__closure__)
    poor(make([(1, "a b"), (2, "ab"), (3, " ab ")]).repartition(3), several)
    with pytest.raises(Exception, match="digest"):
        poor(make([(1, "a b"), (2, "ab"), (3, "abc")]).repartition(3), several)
    with pytest.raises(Exception, match="digest"):
        poor(make([(1, "a b"), (2, "abc")]).coalesce(1), several)
