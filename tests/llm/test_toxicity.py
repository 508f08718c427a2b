import numpy as np
import pytest

from tallyloom.llm import toxicity as tx
from tallyloom.llm.common import documents, table


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.15
    good = [np.where(truth, rng.random(4000) < 0.7, rng.random(4000) < 0.03) for _ in range(5)]
    bad = rng.random(4000) < 0.2
    votes = np.stack([*good, bad, good[0], good[0]], axis=1)  # two that repeat the first
    p, rates, corr = tx.label_model(votes, np.full(4000, -1))
    assert ((p > 0.5) == truth).mean() > 0.95
    assert all(abs(rates[1, j] - 0.7) < 0.12 for j in range(5)) and abs(rates[1, 5] - rates[0, 5]) < 0.1
    assert corr[0, 6] > 0.9 and corr[1, 2] < 0.3


def test_labels_calibrate_voters_and_dont_overrule_them():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.2
    votes = np.stack([np.where(truth, rng.random(3000) < hit, rng.random(3000) < miss) for hit, miss in ((0.8, 0.05), (0.6, 0.1), (0.1, 0.5))], axis=1)
    known = np.where(np.arange(3000) < 300, truth, -1).astype(int)
    p, rates, _ = tx.label_model(votes, known)
    assert abs(rates[1, 0] - 0.8) < 0.1 and abs(rates[0, 2] - 0.5) < 0.1
    for way in np.unique(votes, axis=0):  # rows of equal votes have one posterior, whatever their labels
        assert np.ptp(p[(votes == way).all(axis=1)]) < 1e-9
    assert ((p > 0.5) == truth).mean() > 0.88
    shuffled = rng.permuted(votes, axis=0)
    assert np.abs(tx.label_model(shuffled, known)[0] - p).max() > 0.3
    assert len(set(tx.label_model(np.zeros((10, 2), bool), np.array([1] * 5 + [0] * 5))[0])) == 1


def test_scores_come_from_votes(make, spark, monkeypatch):
    """With the votes dealt to other rows the classifier learns something else."""
    rng = np.random.default_rng(3)
    rows = [(i, f"{i} plain words" + (" gloop" if i % 3 == 0 else "")) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    own = tx.train(make(rows), labels)
    votes = tx.votes
    monkeypatch.setattr(tx, "votes", lambda *args: rng.permutation(votes(*args)))
    other = tx.train(make(rows), labels)
    assert own.score("plain gloop") > 0.8 > other.score("plain gloop") + 0.2
    assert own.score("plain words") < 0.2


def test_held_out_rows(spark):
    rows = spark.range(2000).select("id", tx.held_out(tx.F.col("id")).alias("h")).collect()
    assert all(r.h == (tx.crc_mod(r.id) == 2) for r in rows)


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.1"  # 120 toxic rows are held out there; sf0.01 has 14, too few to measure a share on
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    return [(r.held_out, r.score, r.predicted, labels.get(r.doc_id)) for r in tx.op6_toxicity(spark, sf).collect()], documents(spark, sf).count()


def test_held_out_accuracy(scored):
    rows, n = scored
    assert len(rows) == n and all(0 <= s <= 1 and p == int(s >= 0.3) for _, s, p, _ in rows)
    own = [(s, p, t) for h, s, p, t in rows if h and t is not None]
    toxic, clean = [s for s, _, t in own if t], [s for s, _, t in own if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert auc > 0.9
    assert np.mean([p for _, p, t in own if t]) > 0.75 and np.mean([p for _, p, t in own if not t]) < 0.05


def test_odd_rows(odd, make, spark):
    docs, rows = odd
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, None), (9, 1), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = tx.train(docs, labels)
    got = tx.scored(docs, model, "doc_id").collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert tx.below(docs, model, 2.0).count() == len(rows) and tx.below(docs, model, 0.0).count() == 0
    assert tx.below(docs, model).columns == docs.columns
    assert tx.scored(make([]), model, "doc_id").count() == 0


def test_without_labels_the_seed_voters_teach(make, words, spark):
    rows = [(i, words(30, i) + (" you stupid worthless idiot" if i % 5 == 0 else "")) for i in range(200)]
    for labels in (None, spark.createDataFrame([], "doc_id long, toxic int")):
        model = tx.train(make(rows), labels)
        got = {r.doc_id: r.score for r in tx.scored(make(rows), model, "doc_id").collect()}
        assert min(s for i, s in got.items() if i % 5 == 0) > max(s for i, s in got.items() if i % 5)
    assert tx.train(make([]), None).score("you idiot") > tx.train(make([]), None).score("hello")


def test_a_label_cut_to_its_sample_keeps_its_share(make, spark, monkeypatch):
    rows = [(i, f"{i} plain words" + (" gloop" if i // 10 % (2 if i % 10 == 0 else 10) == 0 else "")) for i in range(2000)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i, _ in rows], "doc_id long, toxic int")

    def scores():
        model = tx.train(make(rows), labels)
        return model.score("plain words"), model.score("plain words gloop")

    whole = scores()
    monkeypatch.setattr(tx, "SAMPLE_ROWS", 200)  # all toxic rows, and about one in seven of the clean ones
    cut = scores()
    assert whole[0] < 0.1 < 0.3 < whole[1]
    assert cut[0] < 0.15 and abs(cut[1] - whole[1]) < 0.15


def test_of_near_copies_the_least_is_learned_from(make, spark):
    rows = [(i, " ".join(["same words here once more again", *["again"] * (i % 7)])) for i in range(200, 0, -1)]
    labels = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")
    docs = make(rows).repartition(7)
    got = [tx.sample(docs, labels).select("near", "doc_id").collect() for _ in range(2)]
    texts = {i: t for i, t in rows if tx.crc_mod(i) != 2}
    least = {}
    for i in sorted(texts):
        least.setdefault((tx._near_key(texts[i]) + 2**63) % 2**64 - 2**63, i)
    assert dict(map(tuple, got[0])) == dict(map(tuple, got[1])) == least
