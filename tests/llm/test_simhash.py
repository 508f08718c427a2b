import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.components import components, forest


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", text)
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, fps):
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                own[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(fps))]


def test_odd_rows(odd):
    docs, rows = odd
    got = simhash.near_groups(docs).collect()
    fps = [fingerprint(t) for _, t in rows]
    want = sorted(zip((str(d) for d, _ in rows), fps, map(str, brute_components([d for d, _ in rows], fps)), strict=True))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want


def test_empty_table(make):
    assert simhash.near_groups(make([])).count() == 0
    assert simhash.representatives(make([])).count() == 0


def planted(n, seed):
    """Clusters around centres, chains and lonely ones."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        centre = int(rng.integers(0, 2**64, dtype=np.uint64))
        out.append(centre)
        for _ in range(int(rng.integers(0, 6))):
            x = centre
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return list(dict.fromkeys(out))


def test_anchors_meet_all_links():
    fps = np.array(planted(300, 5), np.uint64)
    row, key = simhash.anchor_keys(fps)
    held = [set(key[row == i].tolist()) for i in range(len(fps))]
    close = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert len(close) > 2 * len(fps) and all(held[i] & held[j] for i, j in close)
    assert max(map(len, held)) <= 34


def test_finer_tables_meet_all_links():
    fps = np.array(planted(300, 6), np.uint64)
    row, key = simhash.finer_keys(np.zeros(len(fps), np.uint64), fps)
    held = [set(key[row == i].tolist()) for i in range(len(fps))]
    assert all(held[i] & held[j] for i, j in np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_comparison_of_sorted_groups(monkeypatch, size):
    """Groups cut over batches, and crowds, come out whole."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "CROWD", 50)
    rng = np.random.default_rng(3)
    keys, fps = [], []
    for k, n in enumerate([1, 2, 3, 17, 40, 49, 50, 51, 200, 1, 120, 5]):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(n):
            x = base
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            keys.append(k)
            fps.append(x)
    keys, fps = np.array(keys, np.int64), np.array(fps, np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(fps[i : i + size].view(np.int64))], names=["key", "fp"]) for i in range(0, len(keys), size)]
    out = [b for b in simhash._compared(iter(batches), True)]
    u, v, crowd = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in out]) for c in ("u", "v", "crowd"))
    for k in np.unique(keys):
        own = fps[keys == k]
        passed = v[crowd & (u == k)]
        if (keys == k).sum() > 50:
            assert sorted(passed.tolist()) == sorted(own.view(np.int64).tolist())
        else:
            assert not len(passed)
            a, b = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= 3)
            want = dict(zip(*(x.tolist() for x in forest(own[a].view(np.int64), own[b].view(np.int64))), strict=True))
            mine = np.isin(u, own.view(np.int64)) & ~crowd
            got = dict(zip(*(x.tolist() for x in forest(u[mine], v[mine])), strict=True))
            assert got == want


def test_links_of_many_fingerprints(spark):
    fps = planted(200, 9)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    got = [roots.get(s, s) for s in signed]
    want = brute_components(signed, fps)
    assert got == want


def test_components_of_a_long_chain(spark):
    n = 3000
    order = np.random.default_rng(2).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1)], "u long, v long").repartition(4)
    got = components(edges).collect()
    assert len(got) == n - 1 and {r.root for r in got} == {0}


def test_representatives(odd, make, words):
    docs, rows = odd
    got = simhash.representatives(docs)
    assert got.columns == docs.columns
    groups = {r.component_id if r.component_id is not None else f"null {r.fp}" for r in simhash.near_groups(docs).collect()}
    assert got.count() == len(groups)
    shared = make([(5, words(50, 1)), (5, words(50, 2)), (3, words(50, 2)), (None, words(50, 3)), (None, words(50, 3)), (None, None)])
    assert sorted((str(r.doc_id), r.text or "") for r in simhash.representatives(shared).collect()) == sorted([("5", words(50, 1)), ("3", words(50, 2)), ("None", words(50, 3)), ("None", "")])
    plain = make([(1, words(50, 1)), (2, words(50, 1)), (3, words(50, 2))])
    assert sorted(r.doc_id for r in simhash.representatives(plain).collect()) == [1, 3]


@pytest.mark.parametrize("size", range(1, 61))
def test_adjacent_crowds_come_out_whole_at_all_batch_sizes(monkeypatch, size):
    monkeypatch.setattr(simhash, "CROWD", 8)
    keys = np.repeat(np.array([1, 2, 3, 4], np.int64), [20, 25, 3, 30])
    fps = np.arange(len(keys), dtype=np.int64) << 20
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(fps[i : i + size])], names=["key", "fp"]) for i in range(0, len(keys), size)]
    out = [(u, v) for b in simhash._compared(iter(batches), True) for u, v, crowd in zip(*(c.to_pylist() for c in b.columns), strict=True) if crowd]
    assert sorted(out) == [(k, f) for k, f in zip(keys.tolist(), fps.tolist(), strict=True) if k != 3]


def test_names_of_columns(spark, words):
    fields = "doc_id long, text string, of int, __of int, fp int, root int, component_id int, row int, own_fp int"
    rows = [(1, words(40, 1), *range(7)), (2, words(40, 1), *range(7)), (3, words(40, 2), *range(7))]
    assert sorted(map(tuple, simhash.representatives(spark.createDataFrame(rows, fields)).collect())) == [rows[0], rows[2]]
    twice = [*rows, (1, words(40, 1) + " x", *range(7))]
    got = sorted(map(tuple, simhash.representatives(spark.createDataFrame(twice, fields)).collect()))
    assert len(got) in (2, 3) and rows[2] in got
