import hashlib
import importlib.util
import math
import os

import numpy as np
import pyarrow as pa

import __spark_entry__
import corpus_pipeline
from tallyloom.llm import mixing, simhash, toxicity
from tallyloom.llm.common import documents, table, written

_spec = importlib.util.spec_from_file_location("decontamination_brute", os.path.join(os.path.dirname(__file__), "test_decontamination.py"))
_brute = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_brute)
bare, leaks = _brute.bare, _brute.leaks


def raked(rows):
    """Of each doc_id the probability, by raking cells in plain loops with the cap inside."""
    tokens = {}
    cell = lambda r: (r["__source"], r["__lang"], r["__topic"])
    for r in rows:
        tokens[cell(r)] = tokens.get(cell(r), 0) + r["__tokens"]
    total = sum(tokens.values())
    wanted = []
    for i in range(3):
        own = {}
        for c, n in tokens.items():
            own[c[i]] = own.get(c[i], 0) + n
        share = {v: (n / total) ** mixing.TEMPER for v, n in own.items()}
        target = {v: s / sum(share.values()) * total for v, s in share.items()}
        full, made = set(), dict(target)
        while over := {v for v in own if v not in full and made[v] * mixing.KEEP > own[v]}:  # a value of too few tokens is taken whole
            full |= over
            rest = total - sum(own[v] for v in full) / mixing.KEEP
            free = sum(target[v] for v in own if v not in full)
            made = {v: own[v] / mixing.KEEP if v in full else target[v] * rest / free for v in own}
        wanted.append(made)
    f = dict.fromkeys(tokens, 1.0)
    for _ in range(mixing.CAPPED_ROUNDS):
        off = 0.0
        for i in range(3):
            now = {}
            for c, n in tokens.items():
                now[c[i]] = now.get(c[i], 0) + n * min(f[c], 1 / mixing.KEEP)
            off = max(off, *(abs(wanted[i][v] / now[v] - 1) for v in now))
            f = {c: w * wanted[i][c[i]] / now[c[i]] for c, w in f.items()}
        if off < mixing.NEAR:
            break
    return {r.doc_id: min(f[cell(r)] * mixing.KEEP, 1.0) for r in rows}


def test_stages_one_by_one(spark, sf):
    """Each stage against its own brute force, on what its predecessor kept."""
    docs = documents(spark, sf)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), f"test-{name}")
        kept[name] = (before, docs)
        if name != names[-1]:
            assert docs.columns == columns
    before, after = kept["toxicity"]
    model = toxicity.train(before, table(spark, sf, "labels"))
    names = {f: w for f, w in zip(model.reader.names, model.weights, strict=False)}

    def score(text):
        z = model.bias + sum(names.get(f, 0.0) for f in toxicity.text_features(text)) + sum(w for w, p in zip(model.weights[len(names) :], toxicity.patterns(text), strict=True) if p)
        return 1 / (1 + math.exp(-z))

    want = [r.doc_id for r in before.collect() if score(r.text or "") < toxicity.THRESHOLD]
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)

    before, after = kept["simhash_near_dedup"]
    rows = before.collect()
    fps = np.array([simhash.majority(simhash.shingle_hashes((r.text or "").encode())) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    root = np.arange(len(rows))
    for _ in rows:
        root = np.array([root[near[i]].min() for i in range(len(rows))])
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(r.doc_id, least.get(root[i], r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(least.values())

    before, after = kept["benchmark_decontamination"]
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    grams = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in ([bare(x) for x in (t or "").split()] for t in items)]

    def may_leak(text):  # only to spare the trying of all diagonals of texts that have not even four words of an item in a row
        w = [bare(x) for x in (text or "").split()]
        own = {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
        return [t for t, g in zip(items, grams, strict=True) if own & g]

    leaked = {r.doc_id for r in before.collect() if any(leaks(t, r.text) for t in may_leak(r.text))}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - leaked

    before, after = kept["source_mixing"]
    rows = mixing.celled(before).collect()
    assert {r.doc_id for r in after.collect()} == {d for d, p in raked(rows).items() if int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) / (1 << 52) < p}

    before, after = kept["token_files"]
    rows = sorted(after.collect())
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in before.collect())
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()


def test_python_workers_get_small_batches(make, spark, sf):
    """Texts of 32 MB are dealt out in batches of about BATCH_BYTES by each stage; run leaves the session as it was."""
    docs = make([(i, f"{i} " + "word " * 1600) for i in range(4000)]).coalesce(1)

    def sizes(rows):
        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for _, stage in corpus_pipeline.STAGES:
        try:
            stage(spark, docs.limit(20), sf)
            got = [r.n for r in docs.select("doc_id", "text").mapInArrow(sizes, "n long").collect()]
        finally:
            spark.conf.set(name, before)
        assert max(got) < 2 * corpus_pipeline.BATCH_BYTES and sum(got) > 30 << 20
    corpus_pipeline.run(spark, sf)
    assert spark.conf.get(name) == before


def test_registered(spark):
    made = __spark_entry__.queries()
    assert "pipeline" in made and [len(n) > 0 for n, _ in corpus_pipeline.STAGES] == [True] * 5
    for n in range(1, 11):
        assert len([k for k in made if k.startswith(f"op{n}_")]) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(made)
