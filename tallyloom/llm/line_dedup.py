"""Removal of lines that spread over many sites, in DataFrame functions alone.

A line is what stands between line feeds, compared without blanks (space, tab,
return) at its ends; empty lines are never boilerplate. Its spread is the number
of distinct sites with a document that holds it. Each line hash gets a HyperLogLog
sketch of its sites; sketches merge in the aggregation, so a line that a third of
all documents hold is one small sketch for each task before the shuffle. Spreads
whose estimate is far from the threshold are decided by it; the lines near it get
an exact count of distinct sites. Lines at or over the threshold are removed from
every document.

Defined results: a null text has no lines and stays empty; a null site is no site.
A line repeated within a document counts once for its spread and is removed at
every place. Rows repeated give a row each. Null doc_ids work like any id. A line at
just the threshold is removed. Very long texts are read whole. Empty tables give no
rows. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

#: Distinct sites from which a line is boilerplate.
SITES = 5
#: Sketches of 2**12 registers err by less than this share in all but one case in millions; small sets are exact.
ERROR = 0.1
LG_K = 12
_ENDS = " \t\r"


def _line_keys(text: F.Column) -> F.Column:
    """The lines of a text as (hash, second hash), empty ones null."""
    line = F.split(text, "\n")
    return F.transform(line, lambda x: _key(F.trim(x, F.lit(_ENDS))))


def _key(line: F.Column) -> F.Column:
    return F.when(line != "", F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")))


def _text_key() -> F.Column:
    """With the doc_id, what a row is known by: rows of no id, or of one, don't meet in one group."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def widespread(docs: DataFrame, site: str, sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """(h1, h2 of the lines of at least ``sites`` sites; and doc_id, key, site, h1, h2 of all documents' distinct lines)."""
    keys = F.array_compact(F.array_distinct(_line_keys(F.coalesce("text", F.lit("")))))
    held = docs.select("doc_id", _text_key().alias("key"), F.col(site).cast("string").alias("site"), F.explode(keys).alias("k")).select("doc_id", "key", "site", "k.*")
    held = written(held, "line-hashes")
    spread = held.filter("site IS NOT NULL").groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("about"))
    slack = max(1.0, sites * ERROR)
    spread = written(spread.filter(F.col("about") >= sites - slack), "line-spread")
    near = spread.filter(F.col("about") <= sites + slack).select("h1", "h2")
    exact = held.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("n")).filter(F.col("n") >= sites)
    return spread.filter(F.col("about") > sites + slack).select("h1", "h2").unionByName(exact.select("h1", "h2")), held


def line_dedup(docs: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the text of the lines that stay) of every row."""
    lines, held = widespread(docs, site, sites)
    by_doc = held.select("doc_id", "key", "h1", "h2").join(lines, ["h1", "h2"]).groupBy(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).agg(F.collect_set(F.struct("h1", "h2")).alias("bad"))
    texts = docs.select("doc_id", _text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(by_doc.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    all_lines = F.split("text", "\n")
    stays = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col("bad"), _key(F.trim(x, F.lit(_ENDS)))), F.lit(False)))
    met = met.withColumn("stay", F.when(F.col("bad").isNull(), all_lines).otherwise(stays))
    return met.select(
        "doc_id",
        F.size(all_lines).cast("long").alias("n_lines"),
        (F.size(all_lines) - F.size("stay")).cast("long").alias("n_removed"),
        F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n")).alias("kept"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five or more sources share."""
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op7_line_dedup": f"""
WITH t AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
b AS (SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= {SITES})
SELECT doc_id, count(*) AS n_lines, count(b.bare) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE b.bare IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN b ON k.bare = b.bare GROUP BY doc_id
"""
}
