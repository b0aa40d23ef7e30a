"""Queries that cut, pool and reshape series, and those of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs, kernels
from ..operators import plotdata, points, resample, spectral, stats, windows
from ..sources.tables import columns_to_rows, described, table
from .event_queries import DAY, MONTH, E, _events
from .signal_queries import _L, FS, KS, _signals


def _r(c, n=6):
    return F.round(c, n)


def _samples(spark, d):
    return _signals(spark, d).select("vec_id", "label", F.posexplode("samples").alias("i", "x"))


def _exploded(df):
    return df.select("vec_id", F.posexplode("samples").alias("i", "x")).select("vec_id", "i", _r("x").alias("x"))


def cut_windows(spark, d):
    s = _signals(spark, d)
    onsets = s.select("vec_id", (F.col("vec_id") % 7 / 8.0).alias("onset"))
    w = spectral.cut_windows(s, ["vec_id"], onsets, FS, (-0.125, 0.25))
    return w.select("vec_id", "onset", F.posexplode("samples").alias("i", "x")).select("vec_id", "onset", "i", _r("x").alias("x"))


def realign_samples(spark, d):
    s = _samples(spark, d).select("vec_id", "i", "x")
    at = s.select("vec_id").distinct().withColumn("align", F.col("vec_id") % 5 / 16.0 + 0.25)
    return points.realign_samples(s, at, ["vec_id"], (-0.125, 0.25), FS).select("vec_id", F.col("i").cast("int").alias("i"), _r("x").alias("x"))


def cut_trial_samples(spark, d):
    trials = spark.range(3).select(F.col("id").cast("int").alias("trial"), (F.col("id") * 0.25).alias("start"), (F.col("id") * 0.25 + 0.375).alias("end"))
    cut = points.cut_trial_samples(_samples(spark, d), trials, FS)
    return cut.select("vec_id", "trial", F.col("i").cast("int").alias("i"), _r("x").alias("x"))


def trim_buffer(spark, d):
    return _exploded(_signals(spark, d).select("vec_id", exprs.remove_buffer("samples", 10).alias("samples")))


def fft_round_trip(spark, d):
    """The inverse of the transform gives the samples again."""
    return _exploded(spectral.ifft(spectral.fft(_signals(spark, d), ["vec_id"]), ["vec_id"]))


def remove_trend(spark, d):
    s = _samples(spark, d).withColumn("at", F.col("i").cast("double"))
    return spectral.remove_predicted(s, "x", ["vec_id"], ["at"]).select("vec_id", "i", _r("x").alias("x"))


def equal_signs(spark, d):
    """Places at which two neighbouring signals agree in sign."""
    s = _signals(spark, d).withColumn("trial", F.floor(F.col("vec_id") / 2).cast("long")).withColumn("up", F.transform("samples", lambda x: x > 0))
    a, b = s.where("vec_id % 2 = 0").select("trial", F.col("up").alias("a")), s.where("vec_id % 2 = 1").select("trial", F.col("up").alias("b"))
    same = F.size(F.filter(exprs.object_array_compare("a", "b"), lambda x: x))
    return a.join(b, "trial").select("trial", same.alias("n_same"), exprs.object_array_equal("a", "b").alias("all_same"))


def ribbon(spark, d):
    return plotdata.lines(_samples(spark, d), "i", "x", ["label"]).select("label", "i", *(_r(c).alias(c) for c in ("y", "low", "high")))


def heatmap(spark, d):
    return plotdata.heatmap(_samples(spark, d), "i", "label", "x").select("label", "i", _r("value").alias("value"))


def stacked_lines(spark, d):
    s = _samples(spark, d)
    return plotdata.stacked(s, "vec_id", "i", "x").select("vec_id", "i", _r("y").alias("y"))


def histogram_fixed(spark, d):
    return plotdata.waveform_histogram(_signals(spark, d), -0.3, 0.3, 12)


def raster(spark, d):
    return plotdata.raster(_events(spark, d), ["user_id"]).select("train", _r("t", 3).alias("second"))


def times_in_range(spark, d):
    """A train's times within a range, by its arrays, and how many that leaves out."""
    kept, flags = points.select_in_arrays("times", 5 * DAY, 20 * DAY)
    trains = points.train_arrays(_events(spark, d), ["user_id"])
    return trains.select("user_id", F.size(kept).alias("n_in"), F.size(F.filter(flags, lambda x: ~x)).alias("n_out"), _r(F.array_min(kept), 3).alias("first_in"))


def pool_events(spark, d):
    e = _events(spark, d)
    units = e.select("user_id").distinct().withColumn("electrode", (F.col("user_id") % 10).cast("int"))
    return points.pool_units(e, units, [], "user_id").groupBy("electrode").agg(F.count("*").alias("n"), _r(F.max("t"), 3).alias("last"))


def pool_grids(spark, d):
    e = _events(spark, d)
    units = e.select("user_id").distinct().withColumn("electrode", (F.col("user_id") % 10).cast("int"))
    grid = points.times_to_bool(e, ["user_id"], MONTH, 3600.0)
    return points.pool_grids(grid, units, ["i"], "spike", "user_id").groupBy("electrode").agg(F.count_if("spike").alias("n_true"), F.count("*").alias("n_cells"))


def first_seen_order(spark, d):
    """Event types in the order in which a user first shows them."""
    seen = _events(spark, d).groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "event_type"))), lambda x: x["event_type"]).alias("types"))
    return seen.select("user_id", F.posexplode(exprs.unsorted_unique("types")).alias("place", "event_type"))


def type_entropy(spark, d):
    n = _events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum("n").alias("total"))
    return n.join(total, "user_id").groupBy("user_id").agg(_r(F.sum(exprs.entropy(F.col("n") / F.col("total")))).alias("bits"))


def window_grid(spark, d):
    """Events in each window of a grid laid to a reference."""
    grid = windows.sliding_windows(spark, 2 * DAY, (0.0, MONTH[1]), DAY, reference=3.25 * DAY)
    n = windows.interval_join(_events(spark, d), "t", grid).groupBy("win").agg(F.count("*").alias("n"))
    return grid.join(n, "win", "left").select("win", _r("start").alias("from_s"), _r("end").alias("to_s"), F.coalesce("n", F.lit(0)).alias("n"))


def frequency_grid(spark, d):
    """Mean power over all vectors at the frequencies of a range."""
    f, at = kernels.frequencies(FS, 64, (2.0, 20.0))
    grid = spark.createDataFrame([(int(k), float(x)) for k, x in zip(at, f)], "k int, freq double")
    s = spectral.fft(_signals(spark, d), ["vec_id"]).join(F.broadcast(grid), "k")  # grid: 19 rows
    return s.groupBy("k", "freq").agg(_r(F.avg(exprs.power())).alias("power"))


def wavelet_widths(spark, d):
    f = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("freq")).agg(F.count("*").alias("n"))
    return f.select("freq", "n", _r(exprs.wavelet_frequency_width("freq")).alias("hz"), _r(exprs.wavelet_time_width("freq")).alias("seconds"), _r(exprs.wavelet_edge_extent("freq")).alias("edge"))


def whole_range(spark, d):
    """Lines whose quantity lies in a range of whole numbers."""
    x = table(spark, d, "lineitem").where(F.array_contains(exprs.iarange(3, 20, 4), F.col("l_quantity").cast("int")))
    return x.groupBy(F.col("l_quantity").cast("int").alias("x")).agg(F.count("*").alias("n"))


def wide_strings(spark, d):
    n = table(spark, d, "nation").withColumn("bytes", F.encode("n_name", "UTF-16LE"))
    return n.select("n_nationkey", exprs.convert_string("bytes").alias("name"))


def groups_labelled(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    one = stats.groups_to_labels(*stats.labels_to_groups(o, "o_orderstatus", ["O", "F"]))
    return one.groupBy("label").agg(F.count("*").alias("n"), _r(F.avg("o_totalprice"), 3).alias("mean"))


def condition_spread(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    return stats.condition_apply(c, "c_acctbal", [], "c_mktsegment", lambda v: F.stddev_samp(v)).select("c_mktsegment", _r("stat", 4).alias("sd"))


def pseudovalues(spark, d):
    """Of a mean, pseudo-values are the observations themselves."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = resample.jackknife_mean(c, "c_acctbal", ["c_mktsegment"])
    j = j.join(c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")), "c_mktsegment")
    return j.select("c_custkey", _r(resample.pseudovalue("mean", "left_out", "n"), 2).alias("value"))


def fisher_round_trip(spark, d):
    r = stats.correlation(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount", ["l_returnflag"])
    return r.select("l_returnflag", _r(exprs.inverse_fisherz(exprs.fisherz("r"))).alias("r"))


def wide_to_rows(spark, d):
    s = _signals(spark, d).select("vec_id", F.slice("samples", 1, 40).alias("a"), F.slice("samples", 41, 24).alias("b"))
    return columns_to_rows(s, ["a", "b"], ["vec_id"]).select("vec_id", _r("a").alias("a"), _r("b").alias("b"))


def table_names(spark, d):
    return described(spark, d)


QUERIES = {
    "cut_windows": cut_windows, "realign_samples": realign_samples, "cut_trial_samples": cut_trial_samples, "trim_buffer": trim_buffer, "fft_round_trip": fft_round_trip, "remove_trend": remove_trend,
    "equal_signs": equal_signs, "ribbon": ribbon, "heatmap": heatmap, "stacked_lines": stacked_lines, "waveform_histogram_fixed": histogram_fixed, "raster": raster, "times_in_range": times_in_range,
    "pool_events": pool_events, "pool_grids": pool_grids, "first_seen_order": first_seen_order, "type_entropy": type_entropy, "window_grid": window_grid, "frequency_grid": frequency_grid,
    "wavelet_widths": wavelet_widths, "whole_range": whole_range, "wide_strings": wide_strings, "groups_labelled": groups_labelled, "condition_spread": condition_spread, "pseudovalues": pseudovalues,
    "fisher_round_trip": fisher_round_trip, "wide_to_rows": wide_to_rows, "table_names": table_names,
}

_PI = "3.141592653589793::DOUBLE"
_TABLES = ["benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]
ORACLES = {
    "cut_windows": f"WITH {_L}, w AS (SELECT *, (vec_id % 7) / 8.0::DOUBLE AS onset, i - ((vec_id % 7) * 8 - 8) AS at_ FROM l) SELECT vec_id, onset, at_::INTEGER AS i, round(x, 6) AS x FROM w WHERE at_ BETWEEN 0 AND 24 AND (vec_id % 7) * 8 - 8 >= 0 AND (vec_id % 7) * 8 + 16 < n",
    "realign_samples": f"WITH {_L} SELECT vec_id, (i - (vec_id % 5) * 4 - 8)::INTEGER AS i, round(x, 6) AS x FROM l WHERE i - (vec_id % 5) * 4 - 8 BETWEEN 0 AND 24",
    "cut_trial_samples": f"WITH {_L}, t AS (SELECT unnest(range(3))::INTEGER AS trial) SELECT vec_id, trial, (i - trial * 16)::INTEGER AS i, round(x, 6) AS x FROM l JOIN t ON i BETWEEN trial * 16 AND trial * 16 + 24",
    "trim_buffer": f"WITH {_L} SELECT vec_id, (i - 10)::INTEGER AS i, round(x, 6) AS x FROM l WHERE i >= 10 AND i < n - 10",
    "fft_round_trip": f"WITH {_L} SELECT vec_id, i::INTEGER AS i, round(x, 6) AS x FROM l",
    "remove_trend": f"WITH {_L}, c AS (SELECT vec_id, regr_slope(x, i) AS b, regr_intercept(x, i) AS a FROM l GROUP BY vec_id) SELECT vec_id, i::INTEGER AS i, round(x - a - b * i, 6) AS x FROM l JOIN c USING (vec_id)",
    "equal_signs": f"WITH {_L}, p AS (SELECT a.vec_id // 2 AS trial, (a.x > 0) = (b.x > 0) AS same FROM l AS a JOIN l AS b ON b.vec_id = a.vec_id + 1 AND a.i = b.i WHERE a.vec_id % 2 = 0) SELECT trial, count(*) FILTER (WHERE same)::INTEGER AS n_same, bool_and(same) AS all_same FROM p GROUP BY trial",
    "ribbon": f"WITH {_L}, s AS (SELECT label, i, avg(x) AS y, stddev_samp(x) / sqrt(count(*)) AS half FROM l GROUP BY ALL) SELECT label, i::INTEGER AS i, round(y, 6) AS y, round(y - half, 6) AS low, round(y + half, 6) AS high FROM s",
    "heatmap": f"WITH {_L} SELECT label, i::INTEGER AS i, round(avg(x), 6) AS value FROM l GROUP BY ALL",
    "stacked_lines": f"WITH {_L}, s AS (SELECT vec_id, i, x, dense_rank() OVER (ORDER BY vec_id) - 1 AS r FROM l), m AS (SELECT max(abs(x)) AS top FROM l) SELECT vec_id, i::INTEGER AS i, round(r + 1.5::DOUBLE * x / top, 6) AS y FROM s, m",
    "waveform_histogram_fixed": f"WITH {_L} SELECT i::INTEGER AS i, least(floor((x + 0.3::DOUBLE) / ((0.3::DOUBLE + 0.3::DOUBLE) / 12)), 11)::INTEGER AS bin, count(*) AS n FROM l WHERE x BETWEEN -0.3::DOUBLE AND 0.3::DOUBLE GROUP BY ALL",
    "raster": f"WITH {E} SELECT (dense_rank() OVER (ORDER BY user_id) - 1)::INTEGER AS train, round(t, 3) AS second FROM e",
    "times_in_range": f"WITH {E}, f AS (SELECT *, t >= {5 * DAY}::DOUBLE AND t < {20 * DAY}::DOUBLE AS inside FROM e) SELECT user_id, count(*) FILTER (WHERE inside)::INTEGER AS n_in, count(*) FILTER (WHERE NOT inside)::INTEGER AS n_out, round(min(t) FILTER (WHERE inside), 3) AS first_in FROM f GROUP BY user_id",
    "pool_events": f"WITH {E} SELECT (user_id % 10)::INTEGER AS electrode, count(*) AS n, round(max(t), 3) AS last FROM e GROUP BY ALL",
    "pool_grids": f"WITH {E}, h AS (SELECT DISTINCT user_id % 10 AS el, round_even(t / 3600, 0) AS cell FROM e), u AS (SELECT DISTINCT user_id % 10 AS el FROM e) SELECT u.el::INTEGER AS electrode, count(h.cell) FILTER (WHERE h.cell BETWEEN 0 AND 720) AS n_true, 721::BIGINT AS n_cells FROM u LEFT JOIN h ON u.el = h.el GROUP BY u.el",
    "first_seen_order": f"WITH {E}, f AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY ALL) SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY t, event_type) - 1)::INTEGER AS place, event_type FROM f",
    "type_entropy": f"WITH {E}, n AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM e GROUP BY ALL), p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, round(-sum(p * log2(p)), 6) AS bits FROM p GROUP BY user_id",
    "window_grid": f"WITH {E}, g AS (SELECT i::INTEGER AS win, (0.25::DOUBLE + i) * {DAY}::DOUBLE AS a, (2.25::DOUBLE + i) * {DAY}::DOUBLE AS b FROM range({int(MONTH[1] / DAY - 2.25) + 1}) AS r(i)) SELECT win, round(a, 6) AS from_s, round(b, 6) AS to_s, count(t) AS n FROM g LEFT JOIN e ON t >= a AND t < b GROUP BY ALL",
    "frequency_grid": f"WITH {_L}, s AS (SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / n)) AS re, sum(x * sin(2 * pi() * k * i / n)) AS im FROM l, (SELECT unnest(range(2, 21))::INTEGER AS k) GROUP BY ALL) SELECT k, k::DOUBLE AS freq, round(avg(re * re + im * im), 6) AS power FROM s GROUP BY ALL",
    "wavelet_widths": f"SELECT l_quantity AS freq, count(*) AS n, round(2 * l_quantity / 6.0::DOUBLE, 6) AS hz, round(6 / ({_PI} * l_quantity), 6) AS seconds, round(sqrt(2::DOUBLE) * (6 + sqrt(38::DOUBLE)) / (4 * {_PI}) / l_quantity, 6) AS edge FROM lineitem GROUP BY ALL",
    "whole_range": "SELECT l_quantity::INTEGER AS x, count(*) AS n FROM lineitem WHERE l_quantity::INTEGER IN (3, 7, 11, 15, 19) GROUP BY ALL",
    "wide_strings": "SELECT n_nationkey, n_name AS name FROM nation",
    "groups_labelled": "SELECT CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS label, count(*) AS n, round(avg(o_totalprice), 3) AS mean FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL",
    "condition_spread": "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd FROM customer GROUP BY ALL",
    "pseudovalues": "SELECT c_custkey, round(c_acctbal, 2) AS value FROM customer",
    "wide_to_rows": f"WITH {_L} SELECT a.vec_id, round(a.x, 6) AS a, round(b.x, 6) AS b FROM l AS a LEFT JOIN l AS b ON a.vec_id = b.vec_id AND b.i = a.i + 40 AND a.i < 24 WHERE a.i < 40",
    "table_names": " UNION ALL ".join(f"SELECT '{t}' AS variable, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t}))::INTEGER AS n_columns" for t in _TABLES),
    "fisher_round_trip": "SELECT l_returnflag, round(corr(l_quantity, l_discount), 6) AS r FROM lineitem GROUP BY ALL",
}
