"""Queries over orders, lineitem and customer: test statistics, information and resampling."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import info, resample, stats
from ..sources.tables import table

DRAWS, SEED = 50, 7


def _r(c, n=6):
    return F.round(c, n)


def _items(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


def _pairs(spark, d):
    """Two segments as two groups, and a number beside the balance."""
    return _customers(spark, d).withColumn("other", (F.col("c_custkey") * 7919 % 1000).cast("double") + F.col("c_acctbal") / 100.0)


def t_one(spark, d):
    return _items(spark, d).groupBy("l_returnflag").agg(_r(stats.one_sample_tstat("l_quantity", 25.0)).alias("t"))


def t_paired(spark, d):
    return _items(spark, d).groupBy("l_returnflag").agg(_r(stats.paired_tstat("l_discount", "l_tax", 0.01), 4).alias("t"))


def _t_two(equal):
    def query(spark, d):
        return stats.two_sample_tstat(_items(spark, d), "l_quantity", "l_linestatus", ("F", "O"), ["l_returnflag"], equal).select("l_returnflag", _r("t").alias("t"))

    return query


def _f_one(compat):
    def query(spark, d):
        return stats.one_way_fstat(_items(spark, d), "l_quantity", "l_returnflag", ["l_linestatus"], compat).select("l_linestatus", _r("f").alias("f"))

    return query


def f_two_way(spark, d):
    return stats.two_way_fstat(_items(spark, d), "l_quantity", "l_returnflag", "l_linestatus", []).select("term", _r("f").alias("f"))


def pearson(spark, d):
    return stats.correlation(_items(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", _r("r").alias("r"), _r(exprs.fisherz("r"), 4).alias("z"))


def spearman(spark, d):
    return stats.rank_correlation(_items(spark, d), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", _r("rho").alias("rho"))


def condition_mean(spark, d):
    return stats.condition_mean(_customers(spark, d), "c_acctbal", ["c_nationkey"], "c_mktsegment").select("c_nationkey", "c_mktsegment", _r("mean", 4).alias("mean"))


def _central(frame):
    x = frame.to_numpy(float).ravel()
    x = x[x == x]
    m = x.mean() if len(x) else 0.0
    return len(x), m, ((x - m) ** 2).sum(), ((x - m) ** 3).sum()


def _central_merged(a, b):
    """Count, mean and central sums of squares and cubes of two parts together."""
    (n, m, s, c), (n2, m2, s2, c2) = a, b
    k, d = n + n2, m2 - m
    if not n or not n2:
        return a if n else b
    return k, m + d * n2 / k, s + s2 + d * d * n * n2 / k, c + c2 + d**3 * n * n2 * (n - n2) / k**2 + 3 * d * (n * s2 - n2 * s) / k


SKEWNESS = stats.Mergeable(
    start=lambda: (0, 0.0, 0.0, 0.0), update=lambda state, frame: _central_merged(state, _central(frame)), merge=_central_merged,
    finish=lambda s: s[3] / s[0] / (s[2] / s[0]) ** 1.5 if s[2] > 0 else None,
)


def condition_skewness(spark, d):
    return stats.condition_apply(_items(spark, d), "l_extendedprice", ["l_returnflag"], "l_linestatus", SKEWNESS).select("l_returnflag", "l_linestatus", _r("stat", 5).alias("skewness"))


def condition_median(spark, d):
    return stats.condition_apply(_customers(spark, d), "c_acctbal", [], "c_mktsegment", F.median).select("c_mktsegment", _r("stat", 4).alias("median"))


def dprime(spark, d):
    return info.dprime(_items(spark, d), "l_quantity", "l_linestatus", ("F", "O"), ["l_returnflag"]).select("l_returnflag", _r("dprime").alias("dprime"))


def auroc(spark, d):
    return info.auroc(_items(spark, d), "l_extendedprice", "l_linestatus", ("F", "O"), ["l_returnflag"]).select("l_returnflag", _r("auroc").alias("auroc"))


def mutual_info(spark, d):
    return info.mutual_info(_items(spark, d), "l_quantity", "l_linestatus", ["l_returnflag"]).select("l_returnflag", _r("info").alias("bits"))


def mutual_info_binned(spark, d):
    return info.mutual_info(_items(spark, d), "l_extendedprice", "l_linestatus", ["l_returnflag"], (900.0, 2500.0, 42)).select("l_returnflag", _r("info").alias("bits"))


def _anova1(omega):
    def query(spark, d):
        return info.anova1(_items(spark, d), "l_quantity", "l_returnflag", ["l_linestatus"], omega).select("l_linestatus", _r("pev").alias("pev"), _r("f").alias("f"))

    return query


def _anova2(**options):
    def query(spark, d):
        return info.anova2(_items(spark, d), "l_quantity", "l_returnflag", "l_linestatus", [], **options).select("term", _r("pev").alias("pev"), _r("f").alias("f"))

    return query


def anova1_p(spark, d):
    return info.anova1(_items(spark, d), "l_quantity", "l_returnflag", ["l_linestatus"], with_p=True).select("l_linestatus", _r("f").alias("f"), _r("p").alias("p"))


def regress(spark, d):
    return info.regress(_items(spark, d), "l_extendedprice", {"quantity": ["l_quantity"]}, ["l_returnflag"]).select("l_returnflag", "term", _r("pev", 4).alias("pev"))


def regress_terms(spark, d):
    return info.regress(_items(spark, d), "l_extendedprice", {"quantity": ["l_quantity"], "rates": ["l_discount", "l_tax"]}, ["l_returnflag"], partial=True).select("l_returnflag", "term", _r("pev", 4).alias("pev"))


def rand_sign(spark, d):
    return resample.one_sample_test(_customers(spark, d), "c_acctbal", "c_custkey", ["c_mktsegment"], mu=4500.0, stat="mean", n_resamples=DRAWS, seed=SEED).select("c_mktsegment", _r("stat", 4).alias("stat"), _r("p").alias("p"))


def boot_one_sample(spark, d):
    return resample.one_sample_test(_customers(spark, d), "c_acctbal", "c_custkey", ["c_mktsegment"], method="bootstrap", mu=4500.0, stat="mean", n_resamples=DRAWS, seed=SEED).select("c_mktsegment", _r("stat", 4).alias("stat"), _r("p").alias("p"))


def perm_two_sample(spark, d):
    return resample.two_sample_test(_customers(spark, d), "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY"), "c_custkey", [], stat="meandiff", n_resamples=DRAWS, seed=SEED).select(_r("stat", 4).alias("stat"), _r("p").alias("p"))


def perm_one_way(spark, d):
    return resample.one_way_test(_customers(spark, d), "c_acctbal", "c_mktsegment", "c_custkey", [], n_resamples=DRAWS, seed=SEED).select(_r("stat").alias("stat"), _r("p").alias("p"))


def perm_two_way(spark, d):
    c = _customers(spark, d).withColumn("side", F.col("c_nationkey") % 2)
    return resample.two_way_test(c, "c_acctbal", "c_mktsegment", "side", "c_custkey", [], n_resamples=DRAWS, seed=SEED).select("term", _r("stat").alias("stat"), _r("p").alias("p"))


def perm_assoc(spark, d):
    return resample.paired_sample_association_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", ["c_mktsegment"], n_resamples=DRAWS, seed=SEED).select("c_mktsegment", _r("stat").alias("stat"), _r("p").alias("p"))


def boot_ci(spark, d):
    return resample.one_sample_confints(_customers(spark, d), "c_acctbal", "c_custkey", ["c_mktsegment"], confint=0.9, n_resamples=DRAWS, seed=SEED).select("c_mktsegment", *(_r(c, 4).alias(c) for c in ("stat", "low", "high")))


def boot_two_sample(spark, d):
    return resample.two_sample_test(_customers(spark, d), "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY"), "c_custkey", [], method="bootstrap", stat="meandiff", n_resamples=DRAWS, seed=SEED).select(_r("stat", 4).alias("stat"), _r("p").alias("p"))


def _numbered_items(spark, d):
    """Lines with a name of their own: order and line alone repeat in these tables."""
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("obs"))


def boot_items(spark, d):
    """Series of many blocks."""
    s = resample.one_sample_confints(_numbered_items(spark, d), "l_quantity", "obs", ["l_returnflag"], confint=0.8, n_resamples=15, seed=SEED, block=1024)
    return s.select("l_returnflag", *(_r(c, 4).alias(c) for c in ("stat", "low", "high")))


def boot_two_items(spark, d):
    s = resample.two_sample_bootstrap_test(_numbered_items(spark, d), "l_quantity", "l_returnflag", ("A", "R"), "obs", ["l_linestatus"], stat="meandiff", n_resamples=15, seed=SEED, block=1024)
    return s.select("l_linestatus", _r("stat", 6).alias("stat"), _r("p").alias("p"))


def perm_items(spark, d):
    """A place among more observations than are sorted at once."""
    s = resample.two_sample_permutation_test(_numbered_items(spark, d), "l_quantity", "l_returnflag", ("A", "R"), "obs", [], stat="meandiff", n_resamples=25, seed=SEED)
    return s.select(_r("stat", 6).alias("stat"), _r("p").alias("p"))


def perm_groups_items(spark, d):
    s = resample.one_way_permutation_test(_numbered_items(spark, d), "l_quantity", "l_returnflag", "obs", [], n_resamples=8, seed=SEED)
    return s.select(_r("stat").alias("stat"), _r("p").alias("p"))


def perm_assoc_items(spark, d):
    s = resample.paired_sample_association_permutation_test(_numbered_items(spark, d), "l_quantity", "l_extendedprice", "obs", ["l_returnflag"], n_resamples=8, seed=SEED)
    return s.select("l_returnflag", _r("stat").alias("stat"), _r("p").alias("p"))


def boot_ci_large(spark, d):
    return resample.mean_confints_large(_numbered_items(spark, d), "l_quantity", "obs", ["l_returnflag"], n_resamples=40, seed=SEED).select("l_returnflag", *(_r(c, 4).alias(c) for c in ("stat", "low", "high")))


def perm_two_sample_large(spark, d):
    return resample.two_sample_test_large(_customers(spark, d), "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY"), "c_custkey", [], n_resamples=DRAWS, seed=SEED).select(_r("stat", 4).alias("stat"), _r("p").alias("p"))


def jackknife(spark, d):
    return resample.jackknife_mean(_customers(spark, d), "c_acctbal", ["c_mktsegment"]).select("c_custkey", _r("left_out", 4).alias("left_out"))


def draws_subsets(spark, d):
    n = table(spark, d, "customer").count()
    return resample.subsets(spark, n, 10, 20, SEED).select("draw", F.col("i").cast("long").alias("obs"))


def nation_subsets(spark, d):
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("v"))
    s = n.select("n_regionkey", F.explode(exprs.all_subsets("v")).alias("s"))
    return s.select("n_regionkey", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("subset"))


QUERIES = {
    "t_one": t_one, "t_paired": t_paired, "t_two": _t_two(True), "t_welch": _t_two(False), "f_one_way": _f_one(False), "f_one_way_compat": _f_one(True), "f_two_way": f_two_way,
    "pearson": pearson, "spearman": spearman, "condition_mean": condition_mean, "condition_median": condition_median, "condition_skewness": condition_skewness, "dprime": dprime, "auroc": auroc, "mutual_info": mutual_info, "mutual_info_binned": mutual_info_binned,
    "pev_anova1": _anova1(True), "pev_anova1_eta": _anova1(False), "pev_anova1_p": anova1_p, "pev_anova2": _anova2(), "pev_anova2_additive": _anova2(interact=False), "pev_anova2_partial": _anova2(partial=True), "pev_regress": regress, "pev_regress_terms": regress_terms,
    "rand_sign": rand_sign, "boot_one_sample": boot_one_sample, "perm_two_sample": perm_two_sample, "perm_one_way": perm_one_way, "perm_two_way": perm_two_way, "perm_assoc": perm_assoc, "boot_ci": boot_ci, "boot_two_sample": boot_two_sample,
    "boot_items": boot_items, "boot_two_items": boot_two_items, "perm_items": perm_items, "perm_groups_items": perm_groups_items, "perm_assoc_items": perm_assoc_items,
    "boot_ci_large": boot_ci_large, "perm_two_sample_large": perm_two_sample_large, "jackknife_mean": jackknife, "draw_subsets": draws_subsets, "nation_subsets": nation_subsets,
}

_TWO = "s AS (SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS n1, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS n2, avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS m1, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS m2, var_samp(l_quantity) FILTER (WHERE l_linestatus = 'F') AS v1, var_samp(l_quantity) FILTER (WHERE l_linestatus = 'O') AS v2 FROM lineitem GROUP BY l_returnflag)"
_ONE = """c AS (SELECT l_linestatus, l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY ALL),
g AS (SELECT l_linestatus, sum(n * m) / sum(n) AS gm, sum(n) AS nn, count(*) AS k, max_by(n, l_returnflag) AS n_last FROM c GROUP BY l_linestatus),
f AS (SELECT l_linestatus, nn, k, n_last, sum(n * (m - gm) * (m - gm)) AS sg, sum(ss) AS se FROM c JOIN g USING (l_linestatus) GROUP BY ALL)"""
_ANOVA2 = """m AS (SELECT avg(l_quantity) AS gm, count(*)::DOUBLE AS nn, var_pop(l_quantity) * count(*) AS st FROM lineitem),
a AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss, count(*) - 1 AS df FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), m),
b AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss, count(*) - 1 AS df FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_linestatus), m),
x AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss, count(*) - 1 AS df FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus), m),
t AS (SELECT 'a' AS term, ss, df FROM a UNION ALL SELECT 'b', ss, df FROM b UNION ALL SELECT 'ab', x.ss - a.ss - b.ss, x.df - a.df - b.df FROM a, b, x)"""
_FULL = f"{_ANOVA2}, e AS (SELECT st - x.ss AS sse, nn - 1 - x.df AS dfe, st, nn FROM m, x)"
_ADD = f"{_ANOVA2}, e AS (SELECT st - a.ss - b.ss AS sse, nn - 1 - a.df - b.df AS dfe, st, nn FROM m, a, b)"
_C = "c AS (SELECT c_custkey AS obs, c_mktsegment AS seg, c_acctbal AS v, (c_custkey * 7919 % 1000)::DOUBLE + c_acctbal / 100 AS o, c_nationkey % 2 AS side FROM customer)"
_B = f"d AS (SELECT unnest(range(1, {DRAWS}))::BIGINT AS draw)"
_BALL = f"d AS (SELECT unnest(range(1, {DRAWS + 1}))::BIGINT AS draw)"


def _md5(*parts):
    return "md5(concat_ws('|', '" + str(SEED) + "', " + ", ".join(parts) + "))"


def _u(*parts):
    return f"(('0x' || substr({_md5(*parts)}, 1, 8))::BIGINT / 4294967296::DOUBLE)"


def _picked(source, *cols, key=False, block=4096):
    """k: the columns of source drawn with replacement in each seg, by way of blocks; key: a seg has draws of its own."""
    own = ["'' || seg"] if key else []
    return f"""n AS (SELECT seg, {', '.join(cols)}, row_number() OVER (PARTITION BY seg ORDER BY obs) - 1 AS i, count(*) OVER (PARTITION BY seg) AS n FROM {source}),
w AS (SELECT seg, draw, n, floor({_u('draw', *own, 'i')} * n)::BIGINT AS x FROM n, d), g AS (SELECT seg, draw, n, x // {block} AS b, unnest(range(count(*))) AS t FROM w WHERE n > {block} GROUP BY seg, draw, n, b),
j AS (SELECT seg, draw, x AS i FROM w WHERE n <= {block} UNION ALL SELECT seg, draw, b * {block} + floor({_u('draw', *own, "'b'", 'b', 't')} * least({block}, n - b * {block}))::BIGINT FROM g),
k AS (SELECT seg, draw, {', '.join('n.' + c for c in cols)} FROM j JOIN n USING (seg, i))"""


_PAIR = "c2 AS (SELECT obs, seg, v FROM c WHERE seg IN ('BUILDING', 'MACHINERY'))"
_DIFF = "avg(v) FILTER (WHERE g = 'BUILDING') - avg(v) FILTER (WHERE g = 'MACHINERY')"
_F = lambda keys, label, src: f"(SELECT {keys}{', ' if keys else ''}sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum(ss) / (sum(n) - count(*))) AS s FROM (SELECT {keys}{', ' if keys else ''}{label}, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) * count(*) AS ss, sum(sum(v)) OVER ({'PARTITION BY ' + keys if keys else ''}) / sum(count(*)) OVER ({'PARTITION BY ' + keys if keys else ''}) AS gm FROM {src} GROUP BY {keys}{', ' if keys else ''}{label}) {'GROUP BY ' + keys if keys else ''})"
_OBS = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, floor(l_extendedprice * 100 + 0.5::DOUBLE)::BIGINT) AS obs"
_X = "x AS (SELECT " + _OBS + ", {0} AS seg, {1} AS v, l_extendedprice AS o FROM lineitem)"
_ends = [round(15 * (1 - 0.8) / 2) - 1, round(15 - 15 * (1 - 0.8) / 2) - 1]
_ITEMS = "avg(v) FILTER (WHERE g = 'A') - avg(v) FILTER (WHERE g = 'R')"
_draws = lambda n: f"d AS (SELECT unnest(range(1, {n + 1}))::BIGINT AS draw)"
#: Poisson draws of mean 1: how many of the distribution's first sums a uniform number reaches.
_POISSON = "list_sum([(u >= c)::INTEGER FOR c IN [" + ", ".join(f"{sum(exp(-1) / factorial(i) for i in range(k + 1))!r}::DOUBLE" for k in range(13)) + "]])"
ORACLES = {
    "t_one": "SELECT l_returnflag, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem GROUP BY ALL",
    "t_paired": "SELECT l_returnflag, round((avg(l_discount - l_tax) - 0.01::DOUBLE) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 4) AS t FROM lineitem GROUP BY ALL",
    "t_two": f"WITH {_TWO} SELECT l_returnflag, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t FROM s",
    "t_welch": f"WITH {_TWO} SELECT l_returnflag, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t FROM s",
    "f_one_way": f"WITH {_ONE} SELECT l_linestatus, round(sg / (k - 1) / (se / (nn - k)), 6) AS f FROM f",
    "f_one_way_compat": f"WITH {_ONE} SELECT l_linestatus, round(sg / (k - 1) / (se / (n_last - k)), 6) AS f FROM f",
    "f_two_way": f"WITH {_FULL} SELECT term, round(ss / df / (sse / dfe), 6) AS f FROM t, e",
    "pearson": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(atanh(corr(l_quantity, l_extendedprice)), 4) AS z FROM lineitem GROUP BY ALL",
    "spearman": "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS rho FROM r GROUP BY ALL",
    "condition_mean": "SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL",
    "condition_skewness": """WITH m AS (SELECT l_returnflag, l_linestatus, l_extendedprice::DOUBLE AS x, avg(l_extendedprice::DOUBLE) OVER (PARTITION BY l_returnflag, l_linestatus) AS m FROM lineitem)
SELECT l_returnflag, l_linestatus, round(avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5::DOUBLE), 5) AS skewness FROM m GROUP BY ALL""",
    "condition_median": "SELECT c_mktsegment, round(median(c_acctbal), 4) AS median FROM customer GROUP BY ALL",
    "dprime": f"WITH {_TWO} SELECT l_returnflag, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS dprime FROM s",
    "auroc": "WITH r AS (SELECT l_returnflag, l_linestatus, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS r FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)), s AS (SELECT l_returnflag, sum(r) FILTER (WHERE l_linestatus = 'F') AS r, count(*) FILTER (WHERE l_linestatus = 'F')::DOUBLE AS n1, count(*) FILTER (WHERE l_linestatus = 'O')::DOUBLE AS n2 FROM r GROUP BY ALL) SELECT l_returnflag, round((r - n1 * (n1 + 1) / 2) / (n1 * n2), 6) AS auroc FROM s",
}


def _mi(value):
    return f"WITH c AS (SELECT l_returnflag AS k, l_linestatus AS s, {value} AS r, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), j AS (SELECT *, sum(n) OVER (PARTITION BY k) AS a, sum(n) OVER (PARTITION BY k, s) AS ns, sum(n) OVER (PARTITION BY k, r) AS nr FROM c) SELECT k AS l_returnflag, round(greatest(0, sum(n / a * log2(n * a / (ns * nr)))), 6) AS bits FROM j GROUP BY k"


ORACLES |= {
    "mutual_info": _mi("l_quantity"),
    "mutual_info_binned": _mi("greatest(0, least(43, floor((l_extendedprice - 900) / 2500) + 1))"),
    "pev_anova1": f"WITH {_ONE} SELECT l_linestatus, round(100 * (sg - (k - 1) * (se / (nn - k))) / (sg + se + se / (nn - k)), 6) AS pev, round(sg / (k - 1) / (se / (nn - k)), 6) AS f FROM f",
    "pev_anova1_eta": f"WITH {_ONE} SELECT l_linestatus, round(100 * sg / (sg + se), 6) AS pev, round(sg / (k - 1) / (se / (nn - k)), 6) AS f FROM f",
    "pev_anova2": f"WITH {_FULL} SELECT term, round(100 * (ss - df * (sse / dfe)) / (st + sse / dfe), 6) AS pev, round(ss / df / (sse / dfe), 6) AS f FROM t, e",
    "pev_anova2_additive": f"WITH {_ADD} SELECT term, round(100 * (ss - df * (sse / dfe)) / (st + sse / dfe), 6) AS pev, round(ss / df / (sse / dfe), 6) AS f FROM t, e WHERE term <> 'ab'",
    "pev_anova2_partial": f"WITH {_FULL} SELECT term, round(100 * (ss - df * (sse / dfe)) / (st + (nn - df) * (sse / dfe)), 6) AS pev, round(ss / df / (sse / dfe), 6) AS f FROM t, e",
    "pev_regress": "WITH s AS (SELECT l_returnflag, count(*)::DOUBLE AS n, var_pop(l_extendedprice) * count(*) AS st, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY ALL) SELECT l_returnflag, 'quantity' AS term, round(100 * (r2 * st - (1 - r2) * st / (n - 2)) / (st + (1 - r2) * st / (n - 2)), 4) AS pev FROM s",
    "rand_sign": f"WITH {_C}, {_B}, o AS (SELECT seg, avg(v - 4500) AS o FROM c GROUP BY seg), s AS (SELECT seg, draw, avg(CASE WHEN substr({_md5('draw', 'obs')}, 1, 1) >= '8' THEN 4500 - v ELSE v - 4500 END) AS s FROM c, d GROUP BY ALL) SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg",
    "boot_one_sample": f"""WITH {_C}, {_B}, {_picked('c', 'v')},
s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL), o AS (SELECT seg, avg(v) AS o FROM c GROUP BY seg) SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s - o) >= abs(o - 4500))) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg""",
    "perm_two_sample": f"""WITH {_C}, {_B}, {_PAIR}, o AS (SELECT {_DIFF.replace('g =', 'seg =')} AS o, count(*) FILTER (WHERE seg = 'BUILDING') AS n1 FROM c2),
p AS (SELECT draw, v, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) <= n1 THEN 'BUILDING' ELSE 'MACHINERY' END AS g FROM c2, d, o), s AS (SELECT draw, {_DIFF} AS s FROM p GROUP BY draw) SELECT round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s, o""",
    "perm_two_sample_large": f"""WITH {_C}, {_B}, {_PAIR}, o AS (SELECT {_DIFF.replace('g =', 'seg =')} AS o, avg((seg = 'BUILDING')::INTEGER) AS share FROM c2),
p AS (SELECT draw, v, CASE WHEN {_u('draw', 'obs')} < share THEN 'BUILDING' ELSE 'MACHINERY' END AS g FROM c2, d, o), s AS (SELECT draw, {_DIFF} AS s FROM p GROUP BY draw) SELECT round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s, o""",
    "perm_one_way": f"""WITH {_C}, {_B}, n AS (SELECT *, row_number() OVER (ORDER BY obs) - 1 AS i FROM c), m AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d), p AS (SELECT draw, m.v, seg FROM m JOIN n USING (i)),
s AS {_F('draw', 'seg', 'p')}, o AS {_F('', 'seg', 'c')} SELECT round(any_value(o.s), 6) AS stat, round((1 + count(*) FILTER (WHERE s.s >= o.s)) / {DRAWS}::DOUBLE, 6) AS p FROM s, o""",
    "perm_two_way": f"""WITH {_C}, {_B}, n AS (SELECT *, row_number() OVER (ORDER BY obs) - 1 AS i FROM c), m AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
p AS (SELECT draw, m.v, seg, side FROM m JOIN n USING (i) UNION ALL SELECT 0, v, seg, side FROM c), cells AS (SELECT draw, seg, side, count(*)::DOUBLE AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM p GROUP BY ALL),
t AS (SELECT draw, sum(n * m) / sum(n) AS gm, sum(n) AS nn, sum(ss) AS sse, count(*) AS kc FROM cells GROUP BY draw), x AS (SELECT draw, sum(n * (m - gm) * (m - gm)) AS ss FROM cells JOIN t USING (draw) GROUP BY draw),
a AS (SELECT draw, sum(n * (m - gm) * (m - gm)) AS ss, count(*) AS k FROM (SELECT draw, seg, sum(n) AS n, sum(n * m) / sum(n) AS m FROM cells GROUP BY draw, seg) JOIN t USING (draw) GROUP BY draw),
b AS (SELECT draw, sum(n * (m - gm) * (m - gm)) AS ss, count(*) AS k FROM (SELECT draw, side, sum(n) AS n, sum(n * m) / sum(n) AS m FROM cells GROUP BY draw, side) JOIN t USING (draw) GROUP BY draw),
f AS (SELECT draw, unnest(['a', 'b', 'ab']) AS term, unnest([a.ss / (a.k - 1), b.ss / (b.k - 1), (x.ss - a.ss - b.ss) / (kc - a.k - b.k + 1)]) / (sse / (nn - kc)) AS f FROM t JOIN x USING (draw) JOIN a USING (draw) JOIN b USING (draw))
SELECT s.term, round(any_value(o.f), 6) AS stat, round((1 + count(*) FILTER (WHERE s.f >= o.f)) / {DRAWS}::DOUBLE, 6) AS p FROM f AS s JOIN f AS o ON s.term = o.term WHERE s.draw > 0 AND o.draw = 0 GROUP BY s.term""",
    "perm_assoc": f"""WITH {_C}, {_B}, n AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY obs) - 1 AS i FROM c), m AS (SELECT seg, draw, v, row_number() OVER (PARTITION BY seg, draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
s AS (SELECT seg, draw, corr(m.v, n.o) AS s FROM m JOIN n USING (seg, i) GROUP BY ALL), o AS (SELECT seg, corr(v, o) AS o FROM c GROUP BY seg) SELECT seg AS c_mktsegment, round(any_value(o), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg""",
    "boot_ci": f"""WITH {_C}, {_BALL}, {_picked('c', 'v')},
s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL), q AS (SELECT seg, s, row_number() OVER (PARTITION BY seg ORDER BY s, draw) - 1 AS at_ FROM s), o AS (SELECT seg, avg(v) AS o FROM c GROUP BY seg)
SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, round(max(s) FILTER (WHERE at_ = {round(DRAWS * (1 - 0.9) / 2) - 1}), 4) AS low, round(max(s) FILTER (WHERE at_ = {round(DRAWS - DRAWS * (1 - 0.9) / 2) - 1}), 4) AS high FROM q JOIN o USING (seg) GROUP BY seg""",
    "boot_two_sample": f"""WITH {_C}, {_B}, {_PAIR}, {_picked('c2', 'v', key=True)},
p AS (SELECT seg AS g, draw, v FROM k), s AS (SELECT draw, {_DIFF} AS s FROM p GROUP BY draw), o AS (SELECT {_DIFF.replace('g =', 'seg =')} AS o FROM c2) SELECT round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s - o) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s, o""",
    "jackknife_mean": "SELECT c_custkey, round((sum(c_acctbal) OVER w - c_acctbal) / (count(*) OVER w - 1), 4) AS left_out FROM customer WINDOW w AS (PARTITION BY c_mktsegment)",
    "draw_subsets": f"WITH n AS (SELECT unnest(range((SELECT count(*) FROM customer)))::BIGINT AS i), d AS (SELECT unnest(range(1, 21))::BIGINT AS draw), p AS (SELECT draw, i, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'i')}, i) - 1 AS pos FROM n, d) SELECT draw::INTEGER AS draw, i AS obs FROM p WHERE pos < 10",
    "nation_subsets": "WITH v AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS v FROM nation GROUP BY ALL), s AS (SELECT n_regionkey, v, unnest(range(1, (1 << len(v))::BIGINT)) AS k FROM v) SELECT n_regionkey, array_to_string([x FOR x, i IN v IF (k >> (i - 1)::INTEGER) & 1 = 1], ',') AS subset FROM s",
    "boot_items": f"""WITH {_X.format("l_returnflag", "l_quantity")}, {_draws(15)}, {_picked('x', 'v', block=1024)}, s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL), q AS (SELECT seg, s, row_number() OVER (PARTITION BY seg ORDER BY s, draw) - 1 AS at_ FROM s), o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg)
SELECT seg AS l_returnflag, round(any_value(o), 4) AS stat, round(max(s) FILTER (WHERE at_ = {_ends[0]}), 4) AS low, round(max(s) FILTER (WHERE at_ = {_ends[1]}), 4) AS high FROM q JOIN o USING (seg) GROUP BY seg""",
    "boot_two_items": f"""WITH x AS (SELECT {_OBS}, l_linestatus || l_returnflag AS seg, l_returnflag AS g, l_quantity AS v FROM lineitem WHERE l_returnflag IN ('A', 'R')), {_draws(14)}, {_picked('x', 'v', key=True, block=1024).replace("'' || seg", "right(seg, 1)")},
y AS (SELECT left(seg, 1) AS l_linestatus, right(seg, 1) AS g, draw, v FROM k UNION ALL SELECT left(seg, 1), g, 0, v FROM x), s AS (SELECT l_linestatus, draw, {_ITEMS} AS s FROM y GROUP BY ALL)
SELECT l_linestatus, round(o.s, 6) AS stat, round((1 + count(*) FILTER (WHERE s.draw > 0 AND abs(s.s - o.s) >= abs(o.s))) / 15::DOUBLE, 6) AS p FROM s JOIN s AS o USING (l_linestatus) WHERE o.draw = 0 GROUP BY l_linestatus, o.s""",
    "perm_items": f"""WITH {_X.format("l_returnflag", "l_quantity")}, {_draws(24)}, y AS (SELECT * FROM x WHERE seg IN ('A', 'R')), o AS (SELECT {_ITEMS.replace('g =', 'seg =')} AS o, count(*) FILTER (WHERE seg = 'A') AS n1 FROM y),
p AS (SELECT draw, v, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) <= n1 THEN 'A' ELSE 'R' END AS g FROM y, d, o), s AS (SELECT draw, {_ITEMS} AS s FROM p GROUP BY draw) SELECT round(any_value(o), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / 25::DOUBLE, 6) AS p FROM s, o""",
    "perm_groups_items": f"""WITH {_X.format("l_returnflag", "l_quantity")}, {_draws(7)}, n AS (SELECT *, row_number() OVER (ORDER BY obs) - 1 AS i FROM x), m AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d), p AS (SELECT draw, m.v, seg FROM m JOIN n USING (i)),
s AS {_F('draw', 'seg', 'p')}, o AS {_F('', 'seg', 'x')} SELECT round(any_value(o.s), 6) AS stat, round((1 + count(*) FILTER (WHERE s.s >= o.s)) / 8::DOUBLE, 6) AS p FROM s, o""",
    "perm_assoc_items": f"""WITH {_X.format("l_returnflag", "l_quantity")}, {_draws(7)}, n AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY obs) - 1 AS i FROM x), m AS (SELECT seg, draw, v, row_number() OVER (PARTITION BY seg, draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
s AS (SELECT seg, draw, corr(m.v, n.o) AS s FROM m JOIN n USING (seg, i) GROUP BY ALL), o AS (SELECT seg, corr(v, o) AS o FROM x GROUP BY seg) SELECT seg AS l_returnflag, round(any_value(o), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / 8::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg""",
    "boot_ci_large": f"""WITH {_X.format("l_returnflag", "l_quantity")}, {_draws(40)}, u AS (SELECT seg, draw, v, {_u('draw', 'obs')} AS u FROM x, d), w AS (SELECT seg, draw, v, {_POISSON} AS w FROM u), s AS (SELECT seg, draw, sum(w * v) / sum(w) AS s FROM w GROUP BY ALL),
q AS (SELECT seg, s, row_number() OVER (PARTITION BY seg ORDER BY s, draw) - 1 AS at_ FROM s), o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg) SELECT seg AS l_returnflag, round(any_value(o), 4) AS stat, round(max(s) FILTER (WHERE at_ = 0), 4) AS low, round(max(s) FILTER (WHERE at_ = 38), 4) AS high FROM q JOIN o USING (seg) GROUP BY seg""",
}
