"""Toxicity scores by weak supervision.

Many voters look at a text: lexicons (seed words by language, and words and word
beginnings that labelled texts show to tell most) and patterns (shouting, runs of
exclamation marks, insults in the second person). A generative label model estimates
how accurate each voter is by expectation maximisation over the votes on labelled
and unlabelled rows: a known label takes the place of its row's posterior where
voters' rates are counted, which calibrates them, and nowhere else. From what
remains between pairs of voters given the label it estimates their correlations, all
of them jointly: votes given the label are taken for normal with one covariance, so
what voters repeat of each other counts once. (With no label at all voters are taken
one by one, and each counts less the more others repeat it.) The label model's posterior, which is of
the votes alone, labelled row or not, is the target of a linear classifier, which
scores every whole text.

What is learned comes from at most ``SAMPLE_ROWS`` labelled rows of each label and
``UNLABELLED_ROWS`` others (those of least doc_id hash, so a fixed sample for fixed
rows) whose crc32 of doc_id, mod 4, isn't 2. A row weighs as many rows as it stands
for, so where a sample is cut and another isn't, shares stay those of all rows; in
the label model unlabelled rows together weigh ``UNLABELLED_SHARE`` of the labelled
ones at most.
Near copies in the sample count once: of those the row of least doc_id, then text.
Scores use the text alone.

Defined results: a null text is empty; empty texts get the score of a text without
any feature. Rows repeated give a row each, of equal scores. Of several labels of
one document the toxic one holds. With no labelled row the seed voters alone label
a sample of the documents. Null labels are no labels. Very long texts are read
whole. An empty table of documents gives a model of the seed words and no rows.
Documents may have any further columns.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table, text_blocks, written

#: Labelled rows that are looked at, at most, of each label.
SAMPLE_ROWS = 10_000
#: Rows without a label that are looked at, at most.
UNLABELLED_ROWS = 10_000
#: Mined features, at most.
FEATURES = 3_000
#: Texts of the sample that must have a feature.
LEAST_TEXTS = 4
#: Mined voters of the label model.
VOTERS = 400
#: Weight of all unlabelled rows in the label model, by that of the labelled ones, at most; and what its correlations shrink by.
UNLABELLED_SHARE, SHRINK = 0.3, 0.1
THRESHOLD = 0.3
#: Rows of the sample whose texts and features are Python objects at once.
SLICE_ROWS = 500

SEEDS = {
    "en": "idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb imbecile retard bastard bitch asshole jerk filth vermin hate kill die ugly fool",
    "de": "idiot dumm blöd arschloch scheiße abschaum versager widerlich wertlos trottel depp hurensohn schlampe dreck",
    "fr": "idiot stupide con connard salope merde imbécile crétin abruti dégueulasse ordure minable",
    "es": "idiota estúpido imbécil cabrón puta mierda basura asqueroso inútil gilipollas escoria payaso",
}
_WORD = re.compile(r"[^\W\d_]+")
_SECOND = re.compile(r"\b(?:you|du|ihr|tu|vous|tú|usted)\b\W+(?:\w+\W+){0,3}?(%s)\b" % "|".join(sorted({w for v in SEEDS.values() for w in v.split()})))
PATTERNS = ("caps", "exclaims", "second", "stretched")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def patterns(text: str) -> list[bool]:
    upper = len(re.findall(r"[A-Z]", text))
    lower = len(re.findall(r"[a-z]", text))
    low = text.lower()
    return [
        upper > 20 and upper > lower,
        text.count("!") * 40 > len(text) > 0 or "!!!" in text,
        bool(_SECOND.search(low)) if any(w in low for w in ("you", "du ", "ihr ", "tu ", "vous", "tú", "usted")) else False,
        bool(re.search(r"([a-zA-Z])\1{4,}", text)),
    ]


def word_features(word: str) -> list[str]:
    """A word and its beginnings of four to six letters, the latter marked."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)]


def text_features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def _near_key(text: str, width: int = 5) -> int:
    """The least hash of the text's shingles: near copies mostly share it."""
    words = text.lower().split()
    if len(words) <= width:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + width])) for i in range(len(words) - width + 1)) >> 1


def _least(ids: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the rows of ``ids`` (column of), those of least hash."""
    return ids.orderBy(F.hash("of"), "of").limit(most)


def sample(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, text, toxic (null: not known), weight, near of the rows to learn from, stored; near copies once."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = texts.select(F.col("doc_id").alias("of")).distinct()
    unknown = F.lit(None).cast("int").alias("toxic")
    if labels is None:
        all_ids = ids.select("of", unknown)
    else:
        known = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND of IS NOT NULL")
        all_ids = ids.join(known.groupBy("of").agg(F.max("toxic").alias("toxic")), "of", "left")
    all_ids = written(all_ids, "toxicity-ids")
    there = {r.toxic: r["count"] for r in all_ids.groupBy("toxic").count().collect()}
    parts = [
        _least(all_ids.filter(F.col("toxic").eqNullSafe(F.lit(label))), most).withColumn("weight", F.lit(max(there.get(label, 0) / most, 1.0)))
        for label, most in ((0, SAMPLE_ROWS), (1, SAMPLE_ROWS), (None, UNLABELLED_ROWS))
    ]
    picked = parts[0].unionByName(parts[1]).unionByName(parts[2])  # as many rows as the three bounds allow
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic", "weight")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_near_key(t) for at in range(0, batch.num_rows, SLICE_ROWS) for t in batch.column("text").slice(at, SLICE_ROWS).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "text", "toxic", "weight", "near"])

    # of near copies the one of least doc_id, then text, and stored: every read of the sample sees the same rows
    least = rows.mapInArrow(keyed, "doc_id long, text string, toxic int, weight double, near long").groupBy("near", "toxic").agg(F.min(F.struct("doc_id", "text", "weight")).alias("one"))
    return written(least.select("one.doc_id", "one.text", "toxic", "one.weight", "near"), "toxicity-sample")


def mined(rows: DataFrame) -> list[str]:
    """The features of labelled texts that tell most about the label, at most FEATURES."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                every, toxic = Counter(), Counter()
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    found = text_features(text)
                    every.update(found)
                    if label:
                        toxic.update(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(every)), pa.array(list(every.values()), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], names=["feature", "n", "toxic"]
                )

    labelled = rows.filter("toxic IS NOT NULL")
    total = {r.toxic: (r.n, r.w) for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("w")).collect()}
    (n0, w0), (n1, w1) = total.get(0, (0, 1.0)), total.get(1, (0, 1.0))  # all rows of a label weigh the same
    if not n1:
        return []
    share = n1 * w1 / (n0 * w0 + n1 * w1)
    found = labelled.select("text", "toxic").mapInArrow(counts, "feature string, n long, toxic long").groupBy("feature")
    found = found.agg(F.sum("n").alias("rows"), (F.sum("toxic") * w1 + (F.sum("n") - F.sum("toxic")) * w0).alias("n"), (F.sum("toxic") * w1).alias("toxic"))
    lift = (F.col("toxic") - share * F.col("n")) / F.sqrt(F.col("n") * share * (1 - share))
    best = found.filter((F.col("rows") >= LEAST_TEXTS) & (F.col("toxic") > 1.5 * share * F.col("n"))).withColumn("lift", lift).orderBy(F.desc("lift"), "feature").limit(FEATURES)
    return [r.feature for r in best.select("feature").collect()]


class Reader:
    """Rows of feature numbers of texts."""

    def __init__(self, features: list[str]):
        seeds = sorted({w for v in SEEDS.values() for w in v.split()})
        self.names = list(dict.fromkeys([*features, *seeds]))
        self.number = {f: i for i, f in enumerate(self.names)}
        self.cache: dict[str, tuple[int, ...]] = {}

    @property
    def width(self) -> int:
        return len(self.names) + len(PATTERNS)

    def read(self, text: str) -> list[int]:
        if len(self.cache) > 300_000:
            self.cache.clear()
        cache, number, found = self.cache, self.number, set()
        for word in set(_WORD.findall(text.lower())):
            own = cache.get(word)
            if own is None:
                own = cache[word] = tuple(number[f] for f in word_features(word) if f in number)
            if own:
                found.update(own)
        return sorted(found) + [len(self.names) + i for i, p in enumerate(patterns(text)) if p]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 50, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row by its votes; each voter's rates of voting given label 0 and 1; and their correlations.

    votes: rows by voters, 1 where a voter calls the text toxic. labels: 0, 1 or -1
    (unknown); a known label stands for the row's posterior where rates are counted.
    weights: the rows that each row stands for, one if not given.
    """
    n, m = votes.shape
    v = votes.astype(np.float32)
    c = np.ones(n) if weights is None else weights.astype(np.float64)
    known = labels >= 0
    if known.any() and not known.all():
        c = np.where(known, c, c * min(1.0, UNLABELLED_SHARE * c[known].sum() / c[~known].sum()))
    p = np.full(n, 0.5) if known.any() else np.clip(0.05 + 0.9 * (v.sum(axis=1) > 0), 0.05, 0.9)
    counted = c * known if known.any() else c  # the first rates are of the labelled rows
    rates, within = np.zeros((2, m)), np.eye(m)
    for step in range(rounds):
        q = np.where(known, labels == 1, p)
        size = np.array([(counted * (1 - q)).sum(), (counted * q).sum()]) + 1e-9
        rates = np.stack([(counted * (1 - q)) @ v, (counted * q) @ v]) / size[:, None]
        within = (v.T @ (v * counted[:, None].astype(np.float32)) - (rates.T * size) @ rates) / size.sum()
        spread = np.maximum(np.diag(within), 1e-9)
        pooled = (1 - SHRINK) * within + np.diag(SHRINK * spread + 1e-3)
        prior = np.clip(size[1] / size.sum(), 0.001, 0.999)
        if known.any():
            weight = np.linalg.solve(pooled, rates[1] - rates[0])
            bias = -0.5 * float((rates[0] + rates[1]) @ weight)
        else:  # nothing holds the labels' place: each voter by itself, and less the more others repeat it
            near = within / np.sqrt(np.outer(spread, spread))
            np.fill_diagonal(near, 1)
            alone = 1 / np.where(near > 0.1, near, 0).sum(axis=1) if step > 4 else np.ones(m)
            sure = (rates * size[:, None] + 0.5) / (size[:, None] + 1)
            no = alone * np.log((1 - sure[1]) / (1 - sure[0]))
            weight, bias = alone * np.log(sure[1] / sure[0]) - no, float(no.sum())
        new = 1 / (1 + np.exp(-np.clip(v @ weight + bias + math.log(prior / (1 - prior)), -30, 30)))
        counted = c
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-4 and step > 5:
            break
    sd = np.sqrt(np.maximum(np.diag(within), 1e-9))
    return p, rates, within / np.outer(sd, sd)


def linear(at: np.ndarray, row: np.ndarray, width: int, targets: np.ndarray, rounds: int = 400, decay: float = 2e-4, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on presence features and soft targets.

    at, row: a feature's number and its row, for each feature of each row; counts: the rows that each stands for.
    """
    n = len(targets)
    c = np.ones(n) if counts is None else counts
    share = float((c * targets).sum() / c.sum()) if n else 0.0
    w, b = np.zeros(width), math.log(max(share, 1e-4) / max(1 - share, 1e-4)) if n else -3.0
    mean, var = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[at], minlength=n) + b
        error = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets)
        grad = np.append(np.bincount(at, weights=error[row], minlength=width) / max(c.sum(), 1) + decay * w, error.sum() / c.sum() if n else 0)
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad * grad
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


class Model:
    """A trained scorer; it is small and goes to every task."""

    def __init__(self, features: list[str], weights: np.ndarray, bias: float):
        self.reader, self.weights, self.bias = Reader(features), weights, bias

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.reader.read(text)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame | None) -> Model:
    rows = sample(docs, labels)
    features = mined(rows)
    if labels is not None and not features and not rows.filter("toxic IS NOT NULL").head(1):
        return train(docs, None)
    reader = Reader(features)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                made = [reader.read(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.list_(pa.int32())), part.column("toxic"), part.column("weight")], names=["doc_id", "found", "toxic", "weight"])

    # the sample's rows are bounded by its size, not by the corpus; they come as flat arrays
    got = rows.select("doc_id", "text", "toxic", "weight").mapInArrow(read, "doc_id long, found array<int>, toxic int, weight double").toArrow().sort_by([("doc_id", "ascending"), ("weight", "ascending")])
    found = got.column("found").combine_chunks()
    n = len(found)
    if not n:
        return Model(features, np.where(np.arange(reader.width) < len(reader.names), 4.0, 0.0), -3.0)
    at = found.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n, dtype=np.int32), found.value_lengths().to_numpy(zero_copy_only=False))
    known = got.column("toxic").fill_null(-1).to_numpy().astype(np.int64)
    counts = got.column("weight").to_numpy()
    posterior, _, _ = label_model(votes(at, row, n, reader, features), known, weights=counts)
    weights, bias = linear(at, row, reader.width, posterior, counts=counts)
    return Model(features, weights, bias)


def votes(at: np.ndarray, row: np.ndarray, n: int, reader: Reader, features: list[str]) -> np.ndarray:
    """Rows by voters: whether a mined feature, a word of a language's seed lexicon, or a pattern is in the row."""
    voters = [[reader.number[f]] for f in features[:VOTERS]]
    voters += [[reader.number[w] for w in v.split()] for v in SEEDS.values()] + [[len(reader.names) + i] for i in range(len(PATTERNS))]
    made = np.zeros((n, len(voters)), bool)
    for j, own in enumerate(voters):
        made[row[np.isin(at, own)], j] = True
    return made


def scored(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` and score of every row."""
    kept = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__text"))
    state = model

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(rows, "__text", 16 << 20):
            scores = [state.score(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64())], names=[*keep, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, score double")


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all their columns, with a score under the threshold."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(rows, "text", 16 << 20):
            yield batch.filter(pa.array([model.score(t.decode("utf-8", "replace")) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = documents(spark, sf_dir)
    found = scored(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def crc_mod(doc_id: int) -> int:
    """The remainder that ``held_out`` looks at."""
    return zlib.crc32(str(doc_id).encode()) % 4
