"""Logic, recodes, reshaping, merging, filters, weighting and multivariate measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logic as lg
from ..operators import merge, multivariate, recode, weighting
from ..operators.recode import format_set
from ..plans import tabulate
from ..plans.tabulate import quoted
from .data import GRID, LINES, ORDERS, USERS, grid, lines, orders, read, users
from .tables import SEG

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# -------------------------------------------------------------------------- logic


def _logic(name: str, made, sql: str, base=(users, USERS, "users", "user_id")) -> None:
    survey, cte, table, key = base
    query(f"lg_{name}", f"WITH {cte} SELECT {key} AS key FROM {table} WHERE {sql}")(lambda spark, sf: (s := survey(spark, sf)).filtered(made).select(F.col(key).alias("key")))


_L = (lines, LINES, "lines", "okey")
_logic("has_any", {"acts": lg.has_any([1, 3])}, "list_has_any(acts, [1, 3])")
_logic("has_any_exclusive", {"acts": lg.has_any([1, 3, 4], exclusive=True)}, "list_has_any(acts, [1, 3, 4]) AND len(list_filter(acts, lambda c: c NOT IN (1, 3, 4))) = 0")
_logic("not_any", {"acts": lg.not_any([1, 3])}, "NOT coalesce(list_has_any(acts, [1, 3]), false)")
_logic("not_any_exclusive", {"acts": lg.not_any([1, 3], exclusive=True)}, "acts IS NOT NULL AND NOT list_has_any(acts, [1, 3])")
_logic("has_all", {"acts": lg.has_all([1, 2])}, "list_has_all(acts, [1, 2])")
_logic("not_all", {"acts": lg.not_all([1, 2])}, "NOT coalesce(list_has_all(acts, [1, 2]), false)")
_logic("has_count", {"acts": lg.has_count([2, 3])}, "coalesce(len(acts), 0) BETWEEN 2 AND 3")
_logic("has_count_of", {"acts": lg.has_count([lg.is_ge(2), [1, 2, 3]])}, "len(list_filter(acts, lambda c: c IN (1, 2, 3))) >= 2")
_logic("not_count", {"acts": lg.not_count([4, 5])}, "acts IS NOT NULL AND NOT len(acts) BETWEEN 4 AND 5")
_logic("union", lg.union([{"acts": lg.has_any([1])}, {"n": lg.is_gt(70)}]), "coalesce(list_contains(acts, 1), false) OR n > 70")
_logic("intersection", lg.intersection([{"acts": lg.has_any([1])}, {"n": lg.is_lt(70)}]), "list_contains(acts, 1) AND n < 70")
_logic("difference", lg.difference([{"acts": lg.has_any([1, 2])}, {"acts": lg.has_all([1, 2])}, {"n": lg.is_le(60)}]), "list_has_any(acts, [1, 2]) AND NOT list_has_all(acts, [1, 2]) AND NOT n <= 60")
_logic("symdiff", lg.symmetric_difference([{"acts": lg.has_any([1])}, {"n": lg.is_ge(66)}]), "coalesce(list_contains(acts, 1), false) <> (n >= 66)")
_logic("nested", lg.union([lg.intersection([{"acts": [2]}, {"n": lg.is_gt(60)}]), ({"acts": [5]}, lg.intersection, {"n": lg.is_le(60)})]), "coalesce(list_contains(acts, 2), false) AND n > 60 OR coalesce(list_contains(acts, 5), false) AND n <= 60")
_logic("compare", lg.intersection([{"qty": lg.is_ge(10)}, {"qty": lg.is_lt(20)}, {"seg": lg.is_eq(2)}]), "qty >= 10 AND qty < 20 AND seg = 2", _L)
_logic("is_ne", {"seg": lg.is_ne(2)}, "seg IS DISTINCT FROM 2", _L)
_logic("single_any", {"seg": [1, 4]}, "seg IN (1, 4)", _L)
_logic("single_not_any", {"seg": lg.not_any([1, 4])}, "coalesce(seg NOT IN (1, 4), true)", _L)


@query("lg_array_any", f"WITH {GRID} SELECT pkey FROM grid WHERE g_1 = 1 OR g_2 = 1 OR g_3 = 1")
def lg_array_any(spark, sf):
    s = grid(spark, sf)
    return s.df.filter(s.any("g", 1)).select("pkey")


@query("lg_array_all", f"WITH {GRID} SELECT pkey FROM grid WHERE g_1 = 2 AND g_2 = 2 AND g_3 = 2")
def lg_array_all(spark, sf):
    s = grid(spark, sf)
    return s.df.filter(s.all("g", 2)).select("pkey")


@query("ad_code_count", f"WITH {USERS} SELECT user_id, coalesce(len(acts), 0) AS every, coalesce(len(list_filter(acts, lambda c: c IN (1, 2))), 0) AS some FROM users")
def ad_code_count(spark, sf):
    s = users(spark, sf)
    return s.df.select("user_id", s.code_count("acts").cast("long").alias("every"), s.code_count("acts", [1, 2]).cast("long").alias("some"))


@query("ad_code_count_array", f"WITH {GRID} SELECT pkey, CAST((g_1 IS NOT NULL)::INT + (g_2 IS NOT NULL)::INT + (g_3 IS NOT NULL)::INT AS BIGINT) AS n FROM grid")
def ad_code_count_array(spark, sf):
    s = grid(spark, sf)
    return s.df.select("pkey", s.code_count("g").cast("long").alias("n"))


# ------------------------------------------------------------------------ recodes


def _set(column: str) -> str:
    """A list as ``1;2;``, empty and null as null."""
    return f"nullif(list_aggregate({column}, 'string_agg', ';') || ';', ';')"


def _shown(s, *columns: str, key: str = "user_id"):
    return s.df.select(quoted(key).alias("key"), *[(format_set(quoted(c)) if s.meta[c].type == "delimited set" else quoted(c)).alias(c) for c in columns])


@query("rc_recode", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN qty >= 40 THEN 3 WHEN seg = 2 THEN 2 WHEN qty < 20 THEN 1 END AS new FROM lines")
def rc_recode(spark, sf):
    """Of codes that hold the last wins."""
    s = lines(spark, sf)
    s.add_meta("new", "single", "New", ["small", "two", "large"])
    s.recode("new", {1: {"qty": lg.is_lt(20)}, 2: {"seg": [2]}, 3: {"qty": lg.is_ge(40)}})
    return s.df.select(F.col("okey").alias("key"), "num", "new")


@query("rc_recode_default", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN seg IN (3, 4) THEN 2 WHEN seg IN (1, 2) THEN 1 END AS new FROM lines")
def rc_recode_default(spark, sf):
    s = lines(spark, sf)
    s.add_meta("new", "single", "New", ["low", "high"])
    s.recode("new", {1: [1, 2], 2: [3, 4]}, default="seg")
    return s.df.select(F.col("okey").alias("key"), "num", "new")


@query("rc_append", f"WITH {USERS} SELECT user_id AS key, {_set('list_sort(list_distinct(list_concat(coalesce(acts, []), CASE WHEN n > 65 THEN [9] ELSE [] END)))')} AS acts FROM users")
def rc_append(spark, sf):
    s = users(spark, sf)
    s.meta.extend_values("acts", [(9, "busy")])
    s.recode("acts", {9: {"n": lg.is_gt(65)}}, append=True)
    return _shown(s, "acts")


@query("rc_replace", f"WITH {USERS} SELECT user_id AS key, CASE WHEN n > 65 THEN '9;' ELSE {_set('acts')} END AS acts FROM users")
def rc_replace(spark, sf):
    s = users(spark, sf)
    s.meta.extend_values("acts", [(9, "busy")])
    s.recode("acts", {9: {"n": lg.is_gt(65)}})
    return _shown(s, "acts")


@query("rc_intersect", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN ls = 1 AND seg IN (3, 4) THEN 2 WHEN ls = 1 AND seg IN (1, 2) THEN 1 END AS new FROM lines")
def rc_intersect(spark, sf):
    s = lines(spark, sf)
    s.add_meta("new", "single", "New", ["low", "high"])
    s.recode("new", {1: {"seg": [1, 2]}, 2: {"seg": [3, 4]}}, intersect={"ls": [1]})
    return s.df.select(F.col("okey").alias("key"), "num", "new")


@query("rc_fillna", f"WITH {LINES} SELECT okey AS key, num, coalesce(CASE WHEN qty > 30 THEN 1 ELSE seg END, 4) AS seg FROM lines")
def rc_fillna(spark, sf):
    s = lines(spark, sf)
    s.recode("seg", {1: {"qty": lg.is_gt(30)}}, fillna=4)
    return s.df.select(F.col("okey").alias("key"), "num", "seg")


@query("rc_initialize", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN qty > 45 THEN 1 ELSE ls END AS seg FROM lines")
def rc_initialize(spark, sf):
    s = lines(spark, sf)
    s.recode("seg", {1: {"qty": lg.is_gt(45)}}, initialize="ls")
    return s.df.select(F.col("okey").alias("key"), "num", "seg")


@query("rc_uncode", f"WITH {USERS} SELECT user_id AS key, {_set('CASE WHEN n > 60 THEN list_filter(acts, lambda c: c <> 1) ELSE acts END')} AS acts FROM users")
def rc_uncode(spark, sf):
    s = users(spark, sf)
    s.uncode("acts", {1: {"n": lg.is_gt(60)}})
    return _shown(s, "acts")


@query("rc_derive", f"WITH {USERS} SELECT user_id AS key, {_set('list_concat(CASE WHEN list_has_any(acts, [1, 2]) THEN [1] ELSE [] END, CASE WHEN n >= 66 THEN [2] ELSE [] END)')} AS d FROM users")
def rc_derive(spark, sf):
    s = users(spark, sf)
    s.derive("d", "delimited set", "Derived", [(1, "clicks", {"acts": [1, 2]}), (2, "busy", {"n": lg.is_ge(66)})])
    return _shown(s, "d")


@query("rc_band", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN qty BETWEEN 1 AND 10 THEN 1 WHEN qty BETWEEN 11 AND 30 THEN 2 WHEN qty = 50 THEN 3 END AS b FROM lines")
def rc_band(spark, sf):
    s = lines(spark, sf)
    s.band("qty", [(1, 10), {"mid": (11, 30)}, 50], "b")
    return s.df.select(F.col("okey").alias("key"), "num", "b")


@query("rc_interlock", f"WITH {LINES} SELECT okey AS key, num, (rf - 1) * 8 + (ls - 1) * 4 + seg AS i FROM lines")
def rc_interlock(spark, sf):
    s = lines(spark, sf)
    s.interlock("i", "Product", ["rf", "ls", "seg"])
    return s.df.select(F.col("okey").alias("key"), "num", "i")


@query("rc_interlock_set", f"WITH {ORDERS} SELECT okey AS key, {_set('list_sort(list_transform(flags, lambda c: (c - 1) * 3 + st))')} AS i FROM ord")
def rc_interlock_set(spark, sf):
    s = orders(spark, sf)
    s.interlock("i", "Product", ["flags", "st"])
    return _shown(s, "i", key="okey")


@query("rc_unify", f"WITH {USERS} SELECT user_id AS key, {_set('list_sort(list_distinct(list_transform(acts, lambda c: CASE WHEN c IN (2, 3) THEN 1 ELSE c END)))')} AS acts FROM users")
def rc_unify(spark, sf):
    s = users(spark, sf)
    s.unify_values("acts", {2: 1, 3: 1})
    return _shown(s, "acts")


@query("rc_categorize", f"WITH {LINES}, v AS (SELECT disc, CAST(row_number() OVER (ORDER BY disc) AS INT) AS c FROM (SELECT DISTINCT disc FROM lines)) SELECT okey AS key, num, c FROM lines JOIN v USING (disc)")
def rc_categorize(spark, sf):
    s = lines(spark, sf)
    s.categorize("disc", "c")
    return s.df.select(F.col("okey").alias("key"), "num", "c")


@query("rc_remove_values", f"WITH {USERS} SELECT user_id AS key, {_set('list_filter(acts, lambda c: c NOT IN (2, 5))')} AS acts FROM users")
def rc_remove_values(spark, sf):
    s = users(spark, sf)
    s.remove_values("acts", [2, 5])
    return _shown(s, "acts")


@query("rc_copy_slice", f"WITH {USERS} SELECT user_id AS key, {_set('CASE WHEN n > 60 THEN list_filter(acts, lambda c: c IN (1, 4)) END')} AS acts_rec FROM users")
def rc_copy_slice(spark, sf):
    s = users(spark, sf)
    s.copy("acts", slicer={"n": lg.is_gt(60)}, copy_only=[1, 4])
    return _shown(s, "acts_rec")


@query("rs_dichotomize", f"WITH {USERS} SELECT user_id AS key, coalesce(list_contains(acts, 1), false)::INT AS acts_1, coalesce(list_contains(acts, 2), false)::INT AS acts_2, coalesce(list_contains(acts, 4), false)::INT AS acts_4 FROM users")
def rs_dichotomize(spark, sf):
    s = users(spark, sf)
    names = s.dichotomize("acts", ignore=[3, 5])
    return s.df.select(F.col("user_id").alias("key"), *names)


@query("rs_to_set", f"WITH {LINES} SELECT okey AS key, num, {_set('list_concat(CASE WHEN qty > 25 THEN [1] ELSE [] END, CASE WHEN disc > 0.05 THEN [2] ELSE [] END)')} AS s FROM lines")
def rs_to_set(spark, sf):
    s = lines(spark, sf)
    s.df = s.df.withColumns({"b_1": (F.col("qty") > 25).cast("int"), "b_2": (F.col("disc") > 0.05).cast("int")})
    for i in (1, 2):
        s.meta.add(f"b_{i}", "single", f"b {i}", [(1, "yes"), (0, "no")])
    s.to_delimited_set("s", "Both", ["b_1", "b_2"])
    return s.df.select(F.col("okey").alias("key"), "num", format_set(F.col("s")).alias("s"))


@query("rs_to_set_singles", f"WITH {GRID} SELECT pkey AS key, {_set('list_sort(list_distinct(list_filter([g_1, g_2, g_3], lambda c: c IS NOT NULL)))')} AS s FROM grid")
def rs_to_set_singles(spark, sf):
    s = grid(spark, sf)
    s.to_delimited_set("s", "All", ["g_1", "g_2", "g_3"], from_dichotomous=False)
    return _shown(s, "s", key="pkey")


@query("rs_first_responses", f"WITH {USERS} SELECT user_id AS key, acts[1] AS acts_1, acts[2] AS acts_2, {_set('acts[3:]')} AS acts_others FROM users")
def rs_first_responses(spark, sf):
    s = users(spark, sf)
    return _shown(s, *s.first_responses("acts", 2))


@query("rs_flatten", f"WITH {GRID} SELECT pkey AS key, {_set('list_concat(CASE WHEN g_1 IN (1, 2) THEN [1] ELSE [] END, CASE WHEN g_2 IN (1, 2) THEN [2] ELSE [] END, CASE WHEN g_3 IN (1, 2) THEN [3] ELSE [] END)')} AS g_flat FROM grid")
def rs_flatten(spark, sf):
    s = grid(spark, sf)
    return _shown(s, s.flatten("g", [1, 2]), key="pkey")


@query("rs_transpose", f"WITH {GRID} SELECT pkey AS key, " + ", ".join(f"{_set('list_concat(' + ', '.join(f'CASE WHEN g_{i} = {c} THEN [{i}] ELSE [] END' for i in (1, 2, 3)) + ')')} AS g_trans_{c}" for c in (1, 2, 3)) + " FROM grid")
def rs_transpose(spark, sf):
    s = grid(spark, sf)
    return _shown(s, *s.meta.sources(s.transpose("g")), key="pkey")


@query("rs_derotate", f"WITH {GRID} SELECT pkey, half, lev, v FROM (SELECT pkey, half, unnest([1, 2, 3]) AS lev, unnest([g_1, g_2, g_3]) AS v FROM grid) WHERE v IS NOT NULL")
def rs_derotate(spark, sf):
    s = grid(spark, sf)
    made = s.derotate({"lev": ["a", "b", "c"]}, [{"v": ["g_1", "g_2", "g_3"]}], ["half"], unique_key="pkey")
    return made.df.select("pkey", "half", "lev", "v")


@query("rs_convert", f"WITH {LINES} SELECT okey AS key, num, CASE WHEN seg IS NULL THEN NULL ELSE seg || ';' END AS seg, CAST(ls AS DOUBLE) AS ls FROM lines")
def rs_convert(spark, sf):
    s = lines(spark, sf)
    s.convert("seg", "delimited set")
    s.convert("ls", "float")
    return s.df.select(F.col("okey").alias("key"), "num", format_set(F.col("seg")).alias("seg"), "ls")


@query("rs_set_text", f"WITH {USERS} SELECT user_id AS key, {_set('acts')} AS t FROM users")
def rs_set_text(spark, sf):
    """Text of sets to arrays and back."""
    s = users(spark, sf)
    return s.df.select(F.col("user_id").alias("key"), format_set(recode.parse_set(format_set(F.col("acts")))).alias("t"))


@query("rs_dummies", f"WITH {LINES} SELECT okey AS key, num, coalesce((seg = 1)::INT, 0) AS c1, coalesce((seg = 2)::INT, 0) AS c2 FROM lines")
def rs_dummies(spark, sf):
    s = lines(spark, sf)
    made = recode.dummies(s, "seg")
    return s.df.select(F.col("okey").alias("key"), "num", made["1"].alias("c1"), made["2"].alias("c2"))


@query("rs_ones_and_twos", f"WITH {USERS} SELECT user_id AS key, CASE WHEN list_contains(acts, 1) THEN 1 ELSE 2 END AS c1 FROM users")
def rs_ones_and_twos(spark, sf):
    return users(spark, sf).df.select(F.col("user_id").alias("key"), recode.ones_and_twos(F.col("acts"), [1])[1].alias("c1"))


@query("rs_set_tokens", f"WITH {USERS}, t AS (SELECT DISTINCT CAST(unnest(acts) AS VARCHAR) AS token FROM users) SELECT token, CAST(row_number() OVER (ORDER BY CAST(token AS INT)) AS INT) AS place FROM t")
def rs_set_tokens(spark, sf):
    return recode.set_tokens(users(spark, sf).df.select(format_set(F.col("acts")).alias("t")), "t")


@query("dt_as_datetime", f"WITH {LINES} SELECT okey AS key, num, strftime(ship, '%Y-%m-%d') AS d FROM lines")
def dt_as_datetime(spark, sf):
    s = lines(spark, sf)
    made = recode.as_datetime(F.date_format("ship", "d/M/yyyy H:m"))
    return s.df.select(F.col("okey").alias("key"), "num", F.date_format(made, "yyyy-MM-dd").alias("d"))


@query("dt_summarize_time", "SELECT min(s) AS min, median(s) AS median, avg(s) AS mean, max(s) AS max FROM (SELECT CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS s FROM events)")
def dt_summarize_time(spark, sf):
    df = read(spark, sf, "events").select(recode.time_of_day(F.col("ts")).cast("double").alias("s"))
    return recode.summarized_time(df, "s").drop("mode")


# ------------------------------------------------------------------------- merges


@query("mg_hmerge", f"WITH {ORDERS}, r AS (SELECT c_custkey AS ckey, c_mktsegment AS segment, CASE WHEN c_acctbal > 5000 THEN 9.0 END AS w FROM customer) SELECT okey, ckey, coalesce(r.w, ord.w) AS w, segment FROM ord LEFT JOIN r USING (ckey)")
def mg_hmerge(spark, sf):
    """Shared columns take the right's values where there are any."""
    left = orders(spark, sf).df.select("okey", "ckey", "w")
    right = read(spark, sf, "customer").select(F.col("c_custkey").alias("ckey"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 5000, 9.0).alias("w"))
    return merge.hmerge(left, right, "ckey")


@query("mg_hmerge_sets", f"WITH {ORDERS} SELECT okey, {_set('list_sort(list_distinct(list_concat(coalesce(flags, []), CASE WHEN st = 1 THEN [3] ELSE [] END)))')} AS flags FROM ord")
def mg_hmerge_sets(spark, sf):
    s = orders(spark, sf)
    right = s.df.filter("st = 1").select("okey", F.array(F.lit(3)).alias("flags"))
    made = merge.hmerge(s.df.select("okey", "flags"), right, "okey", sets=("flags",), merge_existing=True)
    return made.select("okey", format_set(F.col("flags")).alias("flags"))


@query("mg_update", f"WITH {ORDERS} SELECT okey, CASE WHEN st = 2 THEN 0.0 ELSE total END AS total FROM ord")
def mg_update(spark, sf):
    s = orders(spark, sf)
    return merge.update(s.df.select("okey", "total"), s.df.filter("st = 2").select("okey", F.lit(0.0).alias("total")), "okey")


@query("mg_vmerge_key", "SELECT c_custkey AS key, 'old' AS wave, c_acctbal AS v FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'new', 1.0 FROM customer WHERE c_custkey % 3 = 0")
def mg_vmerge_key(spark, sf):
    """Of the right's rows those with new keys."""
    c = read(spark, sf, "customer")
    left = c.filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v"))
    right = c.select(F.col("c_custkey").alias("key"), F.lit(1.0).alias("v"))
    return merge.vmerge(left, right, "key", row_id_name="wave", left_id="old", right_id="new").select("key", "wave", "v")


@query("mg_vmerge_blind", f"WITH {LINES} SELECT seg || ';' AS s, NULL AS extra FROM lines WHERE ls = 1 AND num = 1 UNION ALL SELECT '1;2;', 7 FROM lines WHERE ls = 2 AND num = 1")
def mg_vmerge_blind(spark, sf):
    """A single meets a set and becomes one."""
    df = lines(spark, sf).df.filter("num = 1")
    left = df.filter("ls = 1").select(F.col("seg").alias("s"))
    right = df.filter("ls = 2").select(F.array(F.lit(1), F.lit(2)).alias("s"), F.lit(7).alias("extra"))
    return merge.vmerge(left, right).select(format_set(F.col("s")).alias("s"), "extra")


@query("mg_dupes", "SELECT l_orderkey AS okey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def mg_dupes(spark, sf):
    return merge.duplicates(lines(spark, sf).df, "okey")


@query("mg_drop_dupes", f"WITH {LINES} SELECT okey, price, qty FROM (SELECT *, row_number() OVER (PARTITION BY okey ORDER BY price DESC, qty DESC) AS r FROM lines) WHERE r = 1")
def mg_drop_dupes(spark, sf):
    return merge.drop_duplicates(lines(spark, sf).df.select("okey", "price", "qty"), "okey", "last", ["price", "qty"])


@query("mg_unique_key", "SELECT c_custkey + 200000000 AS key, c_custkey AS original_key FROM customer")
def mg_unique_key(spark, sf):
    return merge.unique_key(read(spark, sf, "customer").select(F.col("c_custkey").alias("key")), "key", 2)


# ------------------------------------------------------------------------ filters


@query("ft_filter_var", f"WITH {LINES} SELECT okey AS key, num, {_set('list_concat(CASE WHEN qty > 25 AND seg = 1 THEN [0] ELSE [] END, CASE WHEN qty > 25 THEN [1] ELSE [] END, CASE WHEN seg = 1 THEN [2] ELSE [] END)')} AS f FROM lines")
def ft_filter_var(spark, sf):
    s = lines(spark, sf)
    s.add_filter_var("f", [{"qty": lg.is_gt(25)}, {"seg": [1]}])
    return s.df.select(F.col("okey").alias("key"), "num", format_set(F.col("f")).alias("f"))


@query("ft_extend", f"WITH {LINES} SELECT okey AS key, num FROM lines WHERE qty > 25 AND seg = 1 AND rf = 2")
def ft_extend(spark, sf):
    s = lines(spark, sf)
    s.add_filter_var("f", [{"qty": lg.is_gt(25)}, {"seg": [1]}])
    s.extend_filter_var("f", [{"rf": [2]}])
    return s.filtered("f").select(F.col("okey").alias("key"), "num")


@query("ft_reduce", f"WITH {LINES} SELECT okey AS key, num FROM lines WHERE seg = 1")
def ft_reduce(spark, sf):
    s = lines(spark, sf)
    s.add_filter_var("f", [{"qty": lg.is_gt(25)}, {"seg": [1]}])
    s.reduce_filter_var("f", [1])
    return s.filtered("f").select(F.col("okey").alias("key"), "num")


@query("ft_merge", f"WITH {LINES} SELECT okey AS key, num FROM lines WHERE qty > 45 OR seg = 1")
def ft_merge(spark, sf):
    s = lines(spark, sf)
    s.add_filter_var("a", [{"qty": lg.is_gt(45)}])
    s.add_filter_var("b", [{"seg": [1]}])
    s.merge_filter("f", ["a", "b"])
    return s.filtered("f").select(F.col("okey").alias("key"), "num")


@query("ft_subset", f"WITH {LINES} SELECT rf, seg FROM lines WHERE qty = 7")
def ft_subset(spark, sf):
    return lines(spark, sf).filter("sevens", {"qty": lg.is_eq(7)}).subset(["rf", "seg"]).df.select("rf", "seg")


# ---------------------------------------------------------------------- weighting


def _scheme(name: str = "s", **more) -> weighting.Scheme:
    return weighting.Scheme(name, **more).targets([{"rf": {1: 50.0, 2: 30.0, 3: 20.0}}, {"ls": {1: 60.0, 2: 40.0}}])


@query("wt_rake", "SELECT v, code, CAST(pct AS DOUBLE) AS pct FROM (VALUES ('ls', 1, 60.0), ('ls', 2, 40.0), ('rf', 1, 50.0), ('rf', 2, 30.0), ('rf', 3, 20.0)) t(v, code, pct)")
def wt_rake(spark, sf):
    """The margins that the weights give are the targets."""
    s = lines(spark, sf)
    s.weight(_scheme(), "rim")
    ask = [s.df.groupBy(F.lit(v).alias("v"), F.col(v).alias("code")).agg(F.sum("rim").alias("s")) for v in ("rf", "ls")]
    total = s.df.agg(F.sum("rim").alias("t"))
    return ask[0].unionByName(ask[1]).join(F.broadcast(total)).select("v", "code", F.round(F.col("s") / F.col("t") * 100, 3).alias("pct"))


@query("wt_rake_weights")
def wt_rake_weights(spark, sf):
    s = lines(spark, sf)
    s.weight(_scheme(cap=1.6), "rim")
    return s.df.groupBy("rf", "ls").agg(F.round(F.avg("rim"), 6).alias("rim"), F.count(F.lit(1)).alias("n"))


@query("wt_rake_groups", "SELECT ls, CAST(pct AS DOUBLE) AS pct FROM (VALUES (1, 70.0), (2, 30.0)) t(ls, pct)")
def wt_rake_groups(spark, sf):
    s = lines(spark, sf)
    scheme = weighting.Scheme("g")
    for code in (1, 2):
        scheme.targets({"rf": {1: 50.0, 2: 30.0, 3: 20.0}}, f"group {code}", {"ls": [code]})
    s.weight(scheme.shares({"group 1": 70, "group 2": 30}), "rim")
    total = s.df.agg(F.sum("rim").alias("t"))
    return s.df.groupBy("ls").agg(F.sum("rim").alias("s")).join(F.broadcast(total)).select("ls", F.round(F.col("s") / F.col("t") * 100, 3).alias("pct"))


@query("wt_report", f"WITH {LINES} SELECT count(*) AS n, round(sum(w), 4) AS n_weighted, round(100 * sum(w) * sum(w) / (count(*) * sum(w * w)), 5) AS efficiency, round(avg(w), 6) AS mean, min(w) AS min, max(w) AS max, max(w) / min(w) AS ratio FROM lines")
def wt_report(spark, sf):
    made = weighting.report(lines(spark, sf).df, "w")
    return made.select("n", F.round("n_weighted", 4).alias("n_weighted"), F.round("efficiency", 5).alias("efficiency"), F.round("mean", 6).alias("mean"), "min", "max", "ratio")


# -------------------------------------------------------------------- multivariate

_COV = "(sum(w * qty * price) - sum(w * qty) * sum(w * price) / sum(w)) / (sum(w) - 1)"


@query("mv_cov", f"WITH {LINES} SELECT round({_COV}, 3) AS cov FROM lines")
def mv_cov(spark, sf):
    s = lines(spark, sf)
    return s.df.agg(F.round(multivariate.covariance_column("qty", "price", F.col("w")), 3).alias("cov"))


@query("mv_corr", f"WITH {LINES} SELECT 'qty' AS x, 'price' AS y, count(*) AS n, round(corr(qty, price), 6) AS corr FROM lines")
def mv_corr(spark, sf):
    made = multivariate.covariance(lines(spark, sf), ["qty"], ["price"])
    return made.select("x", "y", "n", F.round("corr", 6).alias("corr"))


@query("mv_expected", SEG + ", i AS (SELECT * FROM c WHERE x_code <> 'All' AND y_code <> '@') SELECT x_code, y_code, round(sum(w) OVER (PARTITION BY x_code) * sum(w) OVER (PARTITION BY y_code) / sum(w) OVER (), 4) AS value FROM i")
def mv_expected(spark, sf):
    made = multivariate.expected_counts(tabulate.cells(lines(spark, sf), "seg", "rf", "w"))
    return made.select("x_code", "y_code", F.round("value", 4).alias("value"))


@query("mv_chi2", SEG + """, i AS (SELECT x_code, y_code, w, sum(w) OVER (PARTITION BY x_code) * sum(w) OVER (PARTITION BY y_code) / sum(w) OVER () AS e FROM c WHERE x_code <> 'All' AND y_code <> '@')
SELECT round(sum((w - e) * (w - e) / e), 6) AS chi2, CAST(6 AS BIGINT) AS dof FROM i""")
def mv_chi2(spark, sf):
    _, _, table = multivariate.observed(lines(spark, sf), "seg", "rf", "w")
    found = multivariate.chi_square(table)
    return spark.createDataFrame([(round(found["chi2"], 6), found["dof"])], "chi2 double, dof long")


@query("mv_ols", f"WITH {LINES} SELECT round(regr_slope(price, qty), 6) AS slope, round(regr_intercept(price, qty), 3) AS intercept, round(regr_r2(price, qty), 8) AS r2 FROM lines")
def mv_ols(spark, sf):
    fit = multivariate.linear_model(lines(spark, sf), "price", ["qty"])
    return spark.createDataFrame([(round(float(fit.coefs[1]), 6), round(float(fit.coefs[0]), 3), round(fit.r2, 8))], "slope double, intercept double, r2 double")


@query("mv_ols_weighted")
def mv_ols_weighted(spark, sf):
    fit = multivariate.linear_model(lines(spark, sf), "price", ["qty", "disc", "tax"], "w")
    rows = [(n, *(float(v[i]) for v in (fit.coefs, fit.se, fit.t, fit.p))) for i, n in enumerate(fit.names)]
    return spark.createDataFrame(rows, "name string, coef double, se double, t double, p double")


@query("mv_lmg")
def mv_lmg(spark, sf):
    found = multivariate.shapley_r2(lines(spark, sf), "price", ["qty", "disc", "tax"], "w")
    return spark.createDataFrame(list(found.items()), "name string, share double")


@query("mv_correspondence")
def mv_correspondence(spark, sf):
    xs, _, table = multivariate.observed(orders(spark, sf), "prio", "flags", "w")
    found = multivariate.correspondence(table)
    rows = [(x, float(found["rows"][i, 0])) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "code string, first double")


@query("ad_validate")
def ad_validate(spark, sf):
    s = lines(spark, sf)
    s.meta.remove_values("seg", [4])
    return s.validate()


@query("ad_empty_items", "SELECT 'g_4' AS item")
def ad_empty_items(spark, sf):
    s = grid(spark, sf)
    s.extend_items("g", ["nothing"])
    return spark.createDataFrame([(i,) for i in s.empty_items("g")], "item string")


