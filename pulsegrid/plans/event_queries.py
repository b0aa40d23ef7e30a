"""Queries over events: user_id is the unit, ts the time, event_type the condition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import points, stats, windows
from ..sources.tables import event_times, table

DAY = 86_400.0
MONTH = (0.0, 30 * DAY)
T = "(epoch_us(ts) / 1e6::DOUBLE - 1704067200::DOUBLE)"
E = f"e AS (SELECT event_id, user_id, event_type, value, {T} AS t FROM events)"
GAPS = f"{E}, g AS (SELECT user_id, event_type, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS isi FROM e), i AS (SELECT * FROM g WHERE isi IS NOT NULL)"


def _events(spark, d):
    return event_times(table(spark, d, "events")).select("event_id", "user_id", "event_type", "value", "t")


def _r(c, n=6):
    return F.round(c, n)


def _counts(spark, d, width):
    return points.bin_rate(_events(spark, d), ["user_id"], lims=MONTH, width=width, output="count")


def _hourly_sql(width):
    n = int(MONTH[1] / width)
    return f"""{E}, w AS (SELECT unnest(range({n}))::INTEGER AS win), u AS (SELECT DISTINCT user_id FROM e),
c AS (SELECT user_id, least(floor(t / {width}::DOUBLE + 1e-9::DOUBLE), {n - 1})::INTEGER AS win, count(*) AS n FROM e WHERE t >= 0 AND t <= {MONTH[1]}::DOUBLE GROUP BY ALL),
b AS (SELECT user_id, win, coalesce(n, 0) AS n FROM u CROSS JOIN w LEFT JOIN c USING (user_id, win))"""


def rate_fano(spark, d):
    return points.rate_stats(_counts(spark, d, 3600.0), "fano", ["user_id"], "count").select("user_id", _r("fano").alias("fano"))


def rate_cv(spark, d):
    return points.rate_stats(_counts(spark, d, 3600.0), "cv", ["user_id"], "count").select("user_id", _r("cv").alias("cv"))


def binned_rate(spark, d):
    r = points.rate(_events(spark, d), ["user_id"], "psth", lims=MONTH, width=DAY)
    return r.select("user_id", "win", _r(F.col("rate") * DAY).alias("per_day"))


def sliding_rate(spark, d):
    r = points.bin_rate(_events(spark, d), ["event_type"], lims=MONTH, width=2 * DAY, step=DAY, output="count")
    return r.select("event_type", "win", F.col("start").alias("from_s"), F.col("count").alias("n"))


def custom_bins(spark, d):
    bins = spark.createDataFrame([(0, 0.0, 1.5 * DAY), (1, 1.0 * DAY, 9.25 * DAY), (2, 20.0 * DAY, 21.0 * DAY)], "win int, start double, end double")
    return points.bin_rate(_events(spark, d), ["user_id"], bins=bins, output="count").select("user_id", "win", F.col("count").alias("n"))


def isi(spark, d):
    return points.isi(_events(spark, d), ["user_id"]).select("user_id", _r("t", 3).alias("at"), _r("isi", 3).alias("isi"))


def isi_bucketed(spark, d):
    return points.isi(_events(spark, d), ["event_type"], bucket=DAY).select("event_id", _r("isi", 3).alias("isi"))


def _isi_stat(stat, pool=()):
    def query(spark, d):
        i = points.isi(_events(spark, d), ["user_id"]).select("user_id", "t", "isi")
        if pool:
            return points.isi_stats(i, stat, ["user_id"], list(pool)).select(_r(stat).alias(stat))
        return points.isi_stats(i, stat, ["user_id"], crit=3600.0).select("user_id", _r(stat).alias(stat))

    return query


def select_range(spark, d):
    e = points.select_time_range(_events(spark, d), 5 * DAY, 10.5 * DAY)
    return e.select("event_id", "user_id", _r("t", 3).alias("at"))


def realign(spark, d):
    e = _events(spark, d).withColumn("day", F.floor(F.col("t") / DAY).cast("int"))
    trials = e.where("event_type = 'signup'").groupBy("day").agg(F.min("t").alias("signup"))
    return points.realign_on_event(e, trials, "signup", ["day"]).select("event_id", "day", _r("t", 3).alias("at"))


def cut_trials(spark, d):
    trials = spark.range(5).select(F.col("id").cast("int").alias("trial"), (F.col("id") * 5 * DAY).alias("start"), ((F.col("id") * 5 + 7) * DAY).alias("end"), (F.col("id") * 5 * DAY + 100.0).alias("ref"))
    return points.cut_trials(_events(spark, d), trials, ref="ref").select("event_id", "trial", _r("t", 3).alias("at"))


def pool_units(spark, d):
    c = points.bin_rate(_events(spark, d), ["user_id"], lims=MONTH, width=DAY, output="count")
    units = c.select("user_id").distinct().withColumn("electrode", (F.col("user_id") % 10).cast("int"))
    return points.pool_rates(c, units, ["win"], "count", "user_id").select("electrode", "win", F.col("count").alias("n"))


def bool_grid(spark, d):
    g = points.times_to_bool(_events(spark, d), ["user_id"], MONTH, 3600.0)
    return points.bool_to_times(g, ["user_id"]).select("user_id", _r("t", 3).alias("at"))


def zscore(spark, d):
    return stats.zscore(_events(spark, d), "value", ["event_type"]).select("event_id", _r("z").alias("z"))


def zscore_baseline(spark, d):
    e = _events(spark, d)
    z = stats.zscore(e, "value", ["event_type"], F.col("t") < 10 * DAY, trial="user_id", ddof=1)
    return z.select("event_id", _r("z").alias("z"))


def interpolate(spark, d):
    e = _events(spark, d)
    at = e.select("user_id").distinct().withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(29)))).withColumn("at", F.col("at") * DAY)
    return windows.interp1(e, "t", "value", at, ["user_id"], "at").select("user_id", "at", _r("value", 4).alias("value"))


def bursts(spark, d):
    c = _counts(spark, d, 3600.0)
    z = stats.zscore(c, "count", ["user_id"])
    return windows.runs(z, F.col("z") > 1.0, ["user_id"], "win").where("n >= 1").select("user_id", F.col("first").cast("int").alias("from_win"), F.col("last").cast("int").alias("to_win"), "n", "touches_end")


def epochs(spark, d):
    table_ = spark.createDataFrame([("early", 0.0, 7 * DAY), ("late", 20 * DAY, 30 * DAY)], "name string, low double, high double")
    return windows.pool_time_epochs(_events(spark, d), "value", "t", table_, ["event_type"]).select("event_type", "name", _r("value", 4).alias("mean"))


def events_in_spans(spark, d):
    """Spans of a second to three days, one a customer."""
    key = F.col("c_custkey").cast("long")
    spans = table(spark, d, "customer").select("c_custkey", (key * 7919 % 2592000).cast("double").alias("start"), F.pow(F.lit(4.0), key % 10).alias("length"))
    held = windows.interval_counts(_events(spark, d), "t", spans.withColumn("end", F.col("start") + F.col("length"))).where("n > 0")
    return held.groupBy("c_custkey").agg(F.sum("n").alias("n"))


def bells(spark, d):
    e = _events(spark, d)
    return e.select("event_id", _r(exprs.gaussian(F.col("value"), 100.0, 50.0, 2.0, 0.5)).alias("one"), _r(exprs.gaussian_2d(F.col("value") / 100.0, F.col("t") / DAY / 10.0, (1.0, 1.5), (0.5, 1.0), 1.0, 0.0, 0.3)).alias("two"))


def density(spark, d):
    r = points.density(_events(spark, d).select("user_id", "t"), ["user_id"], MONTH, width=DAY, step=DAY / 4, dt=3600.0)
    return r.select("user_id", F.col("time").alias("at"), _r(F.col("rate") * DAY).alias("per_day"))


QUERIES = {
    "rate_fano": rate_fano, "rate_cv": rate_cv, "binned_rate": binned_rate, "sliding_rate": sliding_rate, "custom_bins": custom_bins, "isi": isi, "isi_bucketed": isi_bucketed,
    "isi_fano": _isi_stat("fano"), "isi_fano_pooled": _isi_stat("fano", ["user_id"]), "isi_cv": _isi_stat("cv"), "isi_cv2": _isi_stat("cv2"), "isi_lv": _isi_stat("lv"), "isi_burst_fract": _isi_stat("burst_fract"),
    "select_time_range": select_range, "realign": realign, "cut_trials": cut_trials, "pool_units": pool_units, "bool_grid": bool_grid, "zscore": zscore, "zscore_baseline": zscore_baseline,
    "interpolate": interpolate, "bursts": bursts, "time_epochs": epochs, "events_in_spans": events_in_spans, "gaussians": bells, "density": density,
}

_ADJ = f"{GAPS}, a AS (SELECT user_id, (isi - before) / (isi + before) AS r FROM (SELECT user_id, isi, lag(isi) OVER (PARTITION BY user_id ORDER BY t) AS before FROM i) WHERE before IS NOT NULL)"
ORACLES = {
    "rate_fano": f"WITH {_hourly_sql(3600)} SELECT user_id, round(var_pop(n) / avg(n), 6) AS fano FROM b GROUP BY user_id",
    "rate_cv": f"WITH {_hourly_sql(3600)} SELECT user_id, round(stddev_pop(n) / avg(n), 6) AS cv FROM b GROUP BY user_id",
    "binned_rate": f"WITH {_hourly_sql(86400)} SELECT user_id, win, round(n::DOUBLE, 6) AS per_day FROM b",
    "sliding_rate": f"WITH {E}, w AS (SELECT unnest(range(29))::INTEGER AS win) SELECT event_type, win, (win * {DAY}::DOUBLE) AS from_s, count(t) AS n FROM (SELECT DISTINCT event_type FROM e) CROSS JOIN w LEFT JOIN (SELECT event_type, t FROM e) USING (event_type) WHERE t >= win * {DAY}::DOUBLE AND t < (win + 2) * {DAY}::DOUBLE GROUP BY ALL",
    "custom_bins": f"WITH {E}, w AS (SELECT * FROM (VALUES (0, 0.0, 1.5), (1, 1.0, 9.25), (2, 20.0, 21.0)) AS v(win, a, b)), c AS (SELECT user_id, win, count(*) AS n FROM e JOIN w ON t >= a * {DAY}::DOUBLE AND t < b * {DAY}::DOUBLE GROUP BY ALL) SELECT user_id, win, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM e) CROSS JOIN w LEFT JOIN c USING (user_id, win)",
    "isi": f"WITH {GAPS} SELECT user_id, round(t, 3) AS at, round(isi, 3) AS isi FROM i",
    "isi_bucketed": f"WITH {E}, g AS (SELECT event_id, t - lag(t) OVER (PARTITION BY event_type ORDER BY t) AS isi FROM e) SELECT event_id, round(isi, 3) AS isi FROM g WHERE isi IS NOT NULL",
    "isi_fano": f"WITH {GAPS} SELECT user_id, round(var_pop(isi) / avg(isi), 6) AS fano FROM i GROUP BY user_id",
    "isi_fano_pooled": f"WITH {GAPS} SELECT round(var_pop(isi) / avg(isi), 6) AS fano FROM i",
    "isi_cv": f"WITH {GAPS} SELECT user_id, round(stddev_pop(isi) / avg(isi), 6) AS cv FROM i GROUP BY user_id",
    "isi_cv2": f"WITH {_ADJ} SELECT user_id, round(avg(2 * abs(r)), 6) AS cv2 FROM a GROUP BY user_id",
    "isi_lv": f"WITH {_ADJ} SELECT user_id, round(3 * sum(r * r) / count(*), 6) AS lv FROM a GROUP BY user_id",
    "isi_burst_fract": f"WITH {GAPS} SELECT user_id, round(avg((isi < 3600)::INTEGER), 6) AS burst_fract FROM i GROUP BY user_id",
    "select_time_range": f"WITH {E} SELECT event_id, user_id, round(t, 3) AS at FROM e WHERE t >= {5 * DAY}::DOUBLE AND t < {10.5 * DAY}::DOUBLE",
    "realign": f"WITH {E}, d AS (SELECT *, floor(t / {DAY}::DOUBLE)::INTEGER AS day FROM e), a AS (SELECT day, min(t) AS a FROM d WHERE event_type = 'signup' GROUP BY day) SELECT event_id, day, round(t - a, 3) AS at FROM d JOIN a USING (day)",
    "cut_trials": f"WITH {E}, w AS (SELECT unnest(range(5))::INTEGER AS trial) SELECT event_id, trial, round(t - (trial * 5 * {DAY}::DOUBLE + 100), 3) AS at FROM e JOIN w ON t >= trial * 5 * {DAY}::DOUBLE AND t < (trial * 5 + 7) * {DAY}::DOUBLE",
    "pool_units": f"WITH {_hourly_sql(86400)} SELECT (user_id % 10)::INTEGER AS electrode, win, sum(n)::BIGINT AS n FROM b GROUP BY ALL",
    "bool_grid": f"WITH {E} SELECT DISTINCT user_id, round(round_even(t / 3600, 0) * 3600, 3) AS at FROM e WHERE round_even(t / 3600, 0) BETWEEN 0 AND 720",
    "zscore": f"WITH {E} SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM e WINDOW w AS (PARTITION BY event_type)",
    "zscore_baseline": f"WITH {E}, u AS (SELECT event_type, user_id, avg(value) AS v FROM e WHERE t < {10 * DAY}::DOUBLE GROUP BY ALL), s AS (SELECT event_type, avg(v) AS m, stddev_samp(v) AS sd FROM u GROUP BY event_type) SELECT event_id, round((value - m) / sd, 6) AS z FROM e JOIN s USING (event_type)",
    "interpolate": f"""WITH {E}, q AS (SELECT DISTINCT user_id, unnest(range(1, 30)) * {DAY}::DOUBLE AS at FROM e),
lo AS (SELECT q.user_id, q.at, e.t AS x0, e.value AS y0 FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.at >= e.t), hi AS (SELECT q.user_id, q.at, e.t AS x1, e.value AS y1 FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.at <= e.t)
SELECT user_id, at, round(CASE WHEN x1 > x0 THEN y0 + (y1 - y0) * (at - x0) / (x1 - x0) WHEN x1 = x0 THEN y0 END, 4) AS value FROM lo JOIN hi USING (user_id, at)""",
    "bursts": f"""WITH {_hourly_sql(3600)}, z AS (SELECT user_id, win, (n - avg(n) OVER w) / stddev_pop(n) OVER w AS z, max(win) OVER w AS top FROM b WINDOW w AS (PARTITION BY user_id)),
r AS (SELECT user_id, win, top, win - row_number() OVER (PARTITION BY user_id ORDER BY win) AS run FROM z WHERE z > 1) SELECT user_id, min(win)::INTEGER AS from_win, max(win)::INTEGER AS to_win, count(*) AS n, max(win) = max(top) AS touches_end FROM r GROUP BY user_id, run""",
    "time_epochs": f"WITH {E}, w AS (SELECT * FROM (VALUES ('early', 0, 7), ('late', 20, 30)) AS v(name, a, b)) SELECT event_type, name, round(avg(value), 4) AS mean FROM e JOIN w ON t BETWEEN a * {DAY}::DOUBLE AND b * {DAY}::DOUBLE GROUP BY ALL",
    "events_in_spans": f"WITH {E}, w AS (SELECT c_custkey, (c_custkey::BIGINT * 7919 % 2592000)::DOUBLE AS a, power(4::DOUBLE, c_custkey % 10) AS len FROM customer) SELECT c_custkey, count(*) AS n FROM e JOIN w ON t >= a AND t < a + len GROUP BY ALL",
    "gaussians": f"""WITH {E}, p AS (SELECT event_id, value, value / 100 - 1 AS dx, t / {DAY}::DOUBLE / 10 - 1.5::DOUBLE AS dy FROM e) SELECT event_id, round(2 * exp(-0.5::DOUBLE * power((value - 100) / 50, 2)) + 0.5::DOUBLE, 6) AS one,
round(exp(-0.5::DOUBLE * (power((dx * cos(0.3::DOUBLE) + dy * sin(0.3::DOUBLE)) / 0.5::DOUBLE, 2) + power(dy * cos(0.3::DOUBLE) - dx * sin(0.3::DOUBLE), 2))), 6) AS two FROM p""",
    "density": f"""WITH {E}, c AS (SELECT user_id, round_even(t / 3600, 0) AS cell, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT sum(exp(-0.5::DOUBLE * power(i / 24, 2))) AS w FROM (SELECT unnest(range(-72, 73)) AS i)), g AS (SELECT unnest(range(0, 721, 6)) AS g),
u AS (SELECT DISTINCT user_id FROM c WHERE cell BETWEEN -72 AND 792), k AS (SELECT user_id, g, sum(n * exp(-0.5::DOUBLE * power((g - cell) / 24, 2))) AS s FROM c JOIN g ON abs(g - cell) <= 72 GROUP BY ALL)
SELECT user_id, g * 3600::DOUBLE AS "at", round(coalesce(s, 0) / w * 24, 6) AS per_day FROM u CROSS JOIN g CROSS JOIN w LEFT JOIN k USING (user_id, g)""",
}
for _k, _sql in list(ORACLES.items()):
    ORACLES[_k] = _sql.replace(" AS at ", ' AS "at" ').replace(" AS at,", ' AS "at",').replace("q.at", 'q."at"').replace("(at - ", '("at" - ').replace(", at,", ', "at",').replace("(user_id, at)", '(user_id, "at")').replace("user_id, at ", 'user_id, "at" ')
