import random
import re

import pyarrow as pa
import pytest

from tallyloom.llm import substring_dedup


def brute(docs):
    """doc_id, text in order -> (words, removed, kept)."""
    seen, out = set(), []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def check(make, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(make(rows).repartition(3)).collect()}
    rows = sorted(rows)
    assert [got[d] for d, _ in rows] == brute(rows)


def test_planted_repeats(make, words):
    rng = random.Random(4)
    passages = [words(rng.randint(18, 90), 100 + i) for i in range(12)]
    rows = []
    for d in range(80):
        parts = [words(rng.randint(0, 60), 1000 + d)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            a = rng.randint(0, 10)
            parts += [" ".join(p[a : len(p) - rng.randint(0, 10)]), words(rng.randint(0, 5), rng.random())]
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(parts)))
    check(make, rows)


def test_small_alphabets(make):
    """Runs and periods of words, where anchors are rare."""
    rng = random.Random(5)
    rows = [(d, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120)))) for d in range(25)]
    rows += [(100, "a " * 300), (101, "a " * 45 + "b " * 45), (102, "a b " * 100), (103, "a b c " * 60), (104, "b " * 20), (105, "a " * 19), (106, "a " * 20)]
    check(make, rows)


def test_odd_rows(odd):
    docs, rows = odd
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    base = rows[0][1].split()
    assert (by[1].n_words, by[1].n_removed) == (120, 0) and by[1].kept == " ".join(base)
    assert (by[2].n_words, by[2].n_removed, by[2].kept) == (120, 120, "")
    assert [r.n_removed for r in got if r.doc_id == 2] == [120, 120]  # rows alike are one document
    assert (by[6].n_removed, by[6].kept) == (120, "tail")
    assert [(by[d].n_words, by[d].n_removed, by[d].kept) for d in (3, 4, 5)] == [(0, 0, "")] * 3
    assert (by[9].n_removed, by[9].kept) == (199, "a") and by[8].n_removed == 0  # the first of 200 equal words is in one window, which is the earliest


def test_empty_table(make):
    assert substring_dedup.substring_dedup(make([])).count() == 0


def test_same_id_with_other_texts(make, words):
    a = words(40, 1)
    got = substring_dedup.substring_dedup(make([(1, a), (1, a + " more"), (2, a)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id == 2) == [(2, 40, 40)]
    assert sum(r.n_removed for r in got if r.doc_id == 1) == 40  # one of the two came first


@pytest.mark.parametrize("size", [60, 300, 5000])
def test_blocks(make, words, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", size)
    check(make, [(d, words(30, d % 4) + " " + words(25, d)) for d in range(20)])


def test_rows_of_no_id_and_of_one_id_keep_their_own_words(make, words):
    """Thousands of rows that an id doesn't tell apart: only what repeats goes, and of equal rows all agree."""
    passage = words(40, 5)
    texts = [words(30, 5000 + i) for i in range(1500)]
    rows = [(None, t) for t in texts] + [(7, t + " " + words(25, 9000 + i)) for i, t in enumerate(texts[:300])]
    rows += [(None, f"{words(21, 3)} {passage}"), (None, f"{passage} {words(22, 4)}"), (None, texts[0])]
    got = substring_dedup.substring_dedup(make(rows).repartition(5)).collect()
    assert len(got) == len(rows)
    removed = {}
    for r in got:
        if r.doc_id is None:
            removed.setdefault(r.n_words, []).append(r.n_removed)
    assert sorted(removed[61] + removed[62]) == [0, 40]  # one of the two holds the passage first
    assert removed[30].count(30) == 301 and len(removed[30]) == 1501 and set(removed[30]) == {0, 30}  # doc 7 comes before rows without an id
    assert all(r.n_removed == 0 for r in got if r.doc_id == 7)


def test_groups_are_judged_alike_over_all_batches():
    rng = random.Random(8)
    for spans in (True, False):
        for _ in range(150):
            rows = set()
            for _ in range(rng.randint(1, 25)):
                a = rng.randint(0, 3)
                if spans and rng.random() < 0.15:
                    rows.add((a, -(1 << 63), 0, 0, substring_dedup.MANY << 36))
                elif rng.random() < 0.2:
                    rows.add((a, 0, rng.randint(0, 3), rng.randint(0, 2), substring_dedup.REPEAT << 36 | 1 << 32 | rng.randint(0, 4)))
                else:
                    rows.add((a, rng.randint(-1, 1), rng.randint(0, 3), rng.randint(0, 2), 1 << 32 | rng.randint(0, 4)))
            rows = sorted(rows)
            want, kind = [], lambda r: r[4] >> 36
            for r in rows:
                if kind(r) == substring_dedup.REPEAT:
                    want.append(r[2:])
                if kind(r) == substring_dedup.OPEN:
                    run = [x for x in rows if x[:2] == r[:2] and kind(x) == substring_dedup.OPEN]
                    several = len({x[1] for x in rows if x[0] == r[0] and kind(x) == substring_dedup.OPEN}) > 1 or any(x[0] == r[0] and kind(x) == substring_dedup.MANY for x in rows)
                    if r != run[0]:
                        want.append((*r[2:4], r[4] | substring_dedup.REPEAT << 36))
                    elif spans and several:
                        want.append((*r[2:4], r[4] | substring_dedup.REST << 36))
            size = rng.randint(1, 6)
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)], names=["a", "s", "doc", "key", "place"]) for i in range(0, len(rows), size)]
            got = [tuple(r.values()) for b in substring_dedup.judged(iter(batches), spans) for r in b.to_pylist()]
            assert sorted(got) == sorted(want)
