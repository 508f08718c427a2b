"""Mixing of sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Cell weights start at one
and are raked to each marginal's target in turn, as many rounds as asked, so that
weighted tokens meet all targets. A document is then kept with its cell's
calibrated probability: its weight times the share of all tokens wanted, one at
most. What the cap takes from a cell is kept as the rows' ``weight``, by which
sums over the sample meet the targets in expectation.

A sample that is handed on without weights (:func:`sampled`) is fitted with the cap
inside the raking, so that what the cap takes from a cell goes to others and the
sample itself meets the targets. A value of fewer tokens than its target is wanted
whole, and the rest of the target goes to the dimension's other values.

Cells are aggregated by Spark. Up to ``CELLS`` of them the rounds run in numpy on
the driver; beyond, they run on the cell table in Spark, a written table a round.

Defined results: null source, language or topic is a value of its own. Blank texts
count one token; null texts are blank. A draw depends on doc_id alone, so repeated
rows are kept or dropped together; rows of null doc_id share one draw. A draw that
equals the probability drops the row. Very long texts are read whole. Empty tables
give no rows. The operator keeps all columns, whatever they are called.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

ROUNDS = 20
#: Rounds of raking under the cap, at most; they end where every value is within NEAR of its target.
CAPPED_ROUNDS, NEAR = 200, 1e-3
#: Share of all tokens that the sample is to have.
KEEP = 0.5
#: Exponent on a value's share of the tokens that makes its target share.
TEMPER = 0.5
CELLS = 200_000
DIMENSIONS = ("source", "lang", "topic")

#: A topic by form; a topic that the table may have is not read.
TOPIC_SQL = """CASE WHEN length(trim(text)) = 0 THEN 'blank'
     WHEN length(text) - length(replace(text, '|', '')) >= 5 THEN 'table'
     WHEN length(text) - length(replace(text, '!!', '')) >= 10 THEN 'loud'
     WHEN text LIKE '%License%' OR text LIKE '%license%' THEN 'licence'
     WHEN length(text) >= 6000 THEN 'long'
     ELSE 'prose' END"""


def celled(docs: DataFrame) -> DataFrame:
    """``docs`` with __source, __lang, __topic and __tokens."""
    topic = F.expr(TOPIC_SQL.replace("text", "coalesce(text, '')"))
    bare = F.coalesce("text", F.lit(""))
    tokens = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1
    named = {f"__{d}": F.coalesce(F.col(d).cast("string"), F.lit("\0")) for d in ("source", "lang")}
    return docs.withColumns({**named, "__topic": topic, "__tokens": tokens.cast("long")})


def rake(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights. cells: value numbers of each cell by dimension; targets: wanted tokens of each value."""
    weight = np.ones(len(tokens))
    for _ in range(rounds):
        for value, target in zip(cells, targets, strict=True):
            now = np.bincount(value, weights=tokens * weight, minlength=len(target))
            weight = weight * (target / now)[value]
    return weight


def attainable(targets: np.ndarray, tokens: np.ndarray, keep: float) -> np.ndarray:
    """Targets of which a share ``keep`` is at most the value's tokens; what is cut goes to the other values in proportion."""
    full = np.zeros(len(targets), bool)
    made = targets
    while len(targets) and (over := ~full & (made * keep > tokens)).any():
        full |= over
        rest = targets.sum() - tokens[full].sum() / keep
        made = np.where(full, tokens / keep, targets * (rest / max(targets[~full].sum(), 1e-300)))
    return made


def rake_capped(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], keep: float) -> np.ndarray:
    """Cell weights f of which min(f * keep, 1) meets the targets' share ``keep``; see :func:`rake`."""
    weight = np.ones(len(tokens))
    for _ in range(CAPPED_ROUNDS):
        off = 0.0
        for value, target in zip(cells, targets, strict=True):
            now = np.bincount(value, weights=tokens * np.minimum(weight, 1 / keep), minlength=len(target))
            off = max(off, float(np.abs(target / now - 1).max(initial=0)))
            weight = weight * (target / now)[value]
        if off < NEAR:
            break
    return weight


def _attainable_in_spark(own: DataFrame, total: float, keep: float) -> DataFrame:
    """:func:`attainable` of a table of values with ``of`` and ``target``."""
    own = written(own.withColumn("made", F.col("target")), "mixing-targets")
    while own.filter(F.col("made") * keep > F.col("of") * (1 + 1e-12)).head(1):
        full = F.col("made") * keep >= F.col("of") * (1 - 1e-12)
        whole, free = own.agg(F.sum(F.when(full, F.col("of"))), F.sum(F.when(~full, F.col("target")))).first()
        scale = (total - (whole or 0) / keep) / max(free or 0.0, 1e-300)
        own = written(own.withColumn("made", F.when(full, F.col("of") / keep).otherwise(F.col("target") * scale)), "mixing-targets")
    return own.select(*own.columns[:-3], F.col("made").alias("target"))


def _rake_in_spark(cells: DataFrame, columns: list[str], temper: float, rounds: int, keep: float | None = None) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0]
    for c in columns:
        own = cells.groupBy(c).agg(F.sum("tokens").alias("of"))
        scale = own.agg(F.sum(F.pow(F.col("of") / total, F.lit(temper)))).first()[0]
        own = own.select(c, "of", (F.pow(F.col("of") / total, F.lit(temper)) / scale * total).alias("target"))
        own = own.select(c, "target") if keep is None else _attainable_in_spark(own, total, keep)
        cells = cells.join(own.withColumnRenamed("target", f"target{c}"), c)
    cells = written(cells.withColumn("f", F.lit(1.0)), "mixing-cells")
    if keep is not None:
        for _ in range(CAPPED_ROUNDS):
            offs = []
            for n, c in enumerate(columns):
                now = cells.groupBy(c).agg(F.sum(F.col("tokens") * F.least("f", F.lit(1 / keep))).alias("now"))
                step = F.col(f"target{c}") / F.col("now")
                cells = cells.join(now, c).withColumns({"f": F.col("f") * step, f"off{n}": F.abs(step - 1)}).drop("now")
                offs.append(f"off{n}")
            cells = written(cells, "mixing-cells")
            off = cells.agg(F.max(F.greatest(*offs))).first()[0] or 0.0
            cells = cells.drop(*offs)
            if off < NEAR:
                break
        return cells.select(*columns, "tokens", "f")
    for _ in range(rounds):
        for c in columns:
            now = cells.groupBy(c).agg(F.sum(F.col("tokens") * F.col("f")).alias("now"))
            cells = cells.join(now, c).withColumn("f", F.col("f") * (F.col(f"target{c}") / F.col("now"))).drop("now")
        cells = written(cells, "mixing-cells")
    return cells.select(*columns, "tokens", "f")


def cell_weights(docs: DataFrame, temper: float = TEMPER, rounds: int = ROUNDS, most: int = CELLS, capped: float | None = None) -> tuple[DataFrame, bool]:
    """(__source, __lang, __topic, f for each cell; whether there are at most ``most``). ``docs`` comes from :func:`celled`.

    capped: the share of all tokens to keep, for which the fit is made under the cap.
    """
    columns = [f"__{d}" for d in DIMENSIONS]
    cells = written(docs.groupBy(*columns).agg(F.sum("__tokens").alias("tokens")), "mixing-cells")
    spark = docs.sparkSession
    n = cells.count()
    if n > most:
        return _rake_in_spark(cells, columns, temper, rounds, capped).select(*columns, "f"), False
    rows = sorted(cells.collect())
    tokens = np.array([r.tokens for r in rows], np.float64)
    numbered, targets = [], []
    for c in columns:
        names, value = np.unique([r[c] for r in rows], return_inverse=True) if rows else ([], np.zeros(0, np.int64))
        own = np.bincount(value, weights=tokens, minlength=len(names))
        share = np.power(own / max(tokens.sum(), 1), temper)
        numbered.append(value)
        target = share / share.sum() * tokens.sum() if len(names) else share
        targets.append(target if capped is None else attainable(target, own, capped))
    weight = rake(numbered, tokens, targets, rounds) if capped is None else rake_capped(numbered, tokens, targets, capped)
    made = [(*(r[c] for c in columns), float(w)) for r, w in zip(rows, weight, strict=True)]
    return spark.createDataFrame(made, "__source string, __lang string, __topic string, f double"), True


def _packed(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as one, ``row``, beside the operator's own, so that no two share a name."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return celled(docs.select(row, *[F.col(c).alias(c) for c in ("doc_id", "text", "source", "lang")])).drop("text", "source", "lang")


def mixed(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, most: int = CELLS, capped: bool = False) -> DataFrame:
    """row (the columns of ``docs``), __topic, __p (probability), __weight and __kept; ``capped``: fitted under the cap, with weights of one."""
    weights, few = cell_weights(celled(docs.select("text", "source", "lang")), temper, rounds, most, keep if capped else None)
    names = [f"__{d}" for d in DIMENSIONS]
    met = _packed(docs).join(F.broadcast(weights) if few else weights, names)
    wanted = F.col("f") * keep
    p = F.least(wanted, F.lit(1.0))
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return met.select("row", "__topic", p.alias("__p"), (F.lit(1.0) if capped else wanted / p).alias("__weight"), (draw < p).alias("__kept"))


def sampled(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS) -> DataFrame:
    """The rows that are kept, with the columns of ``docs``. They have no weights, so the fit is made under the cap."""
    return mixed(docs, keep, temper, rounds, capped=True).filter("__kept").select("row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, probability, weight and draw of every document."""
    found = mixed(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return found.select("row.doc_id", F.col("__topic").alias("topic"), F.round("__p", 6).alias("p"), F.round("__weight", 6).alias("weight"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    steps = []
    for d in DIMENSIONS:
        steps.append(f"t_{d} AS MATERIALIZED (SELECT {d}, s / sum(s) OVER () * (SELECT sum(tokens) FROM c) AS target FROM (SELECT {d}, pow(sum(tokens) / (SELECT sum(tokens) FROM c), {TEMPER}) AS s FROM c GROUP BY {d}))")
    last = "c"
    for n in range(ROUNDS):
        for d in DIMENSIONS:
            name = f"r{n}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, f * (target / sum(tokens * f) OVER (PARTITION BY x.{d})) AS f FROM {last} x JOIN t_{d} USING ({d}))")
            last = name
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, chr(1)) AS source, coalesce(lang, chr(1)) AS lang, {TOPIC_SQL} AS topic,
           length(text) - length(replace(text, ' ', '')) + 1 AS n
      FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)),
c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens, CAST(1 AS DOUBLE) AS f FROM d GROUP BY ALL),
{', '.join(steps)}
SELECT doc_id, topic, round(least(f * {KEEP}, 1), 6) AS p, round(f * {KEEP} / least(f * {KEEP}, 1), 6) AS weight,
       CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / {float(1 << 52)} < least(f * {KEEP}, 1) AS kept
FROM d JOIN {last} USING (source, lang, topic)
"""


ORACLE_SQL = {"op5_source_mixing": _oracle()}
