"""Queries over customer, lineitem, events and embeddings: tests of pairs, draws, intervals, information by name, and
the coupling of events to a signal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import info, plotdata, points, resample, spectral, stats, sync, windows
from ..sources.tables import table
from .event_queries import _events
from .event_queries import E as _E
from .signal_queries import _K, _L, _P, FS, KS, _dft, _signals
from .signal_queries import _channels as _pairs_of_channels
from .table_queries import _C, _PAIR, DRAWS, SEED, _customers, _items, _md5, _pairs, _picked, _r, _u

SEG = ["c_mktsegment"]
TWO = ("BUILDING", "MACHINERY")


# --- pairs ----------------------------------------------------------------------------------------


def _test(s, *keys, digits=4):
    return s.select(*keys, _r("stat", digits).alias("stat"), _r("p").alias("p"))


def paired_perm(spark, d):
    s = resample.paired_sample_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, d=4000.0, stat="mean", n_resamples=DRAWS, seed=SEED)
    return _test(s, *SEG)


def paired_perm_left(spark, d):
    s = resample.paired_sample_permutation_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, d=4000.0, stat="mean", tail="left", n_resamples=DRAWS, seed=SEED)
    return _test(s, *SEG)


def paired_perm_tail(spark, d):
    tail = lambda drawn, seen: drawn * 2 >= seen
    s = resample.paired_sample_permutation_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, d=4000.0, stat="mean", tail=tail, n_resamples=DRAWS, seed=SEED)
    return _test(s, *SEG)


def paired_boot(spark, d):
    s = resample.paired_sample_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, method="bootstrap", d=4000.0, stat="mean", n_resamples=DRAWS, seed=SEED)
    return _test(s, *SEG)


def paired_ci(spark, d):
    s = resample.paired_sample_confints(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, confint=0.9, n_resamples=DRAWS, seed=SEED)
    return s.select(*SEG, *(_r(c, 4).alias(c) for c in ("stat", "low", "high")))


def two_sample_ci(spark, d):
    s = resample.two_sample_confints(_customers(spark, d), "c_acctbal", "c_mktsegment", TWO, "c_custkey", [], confint=0.9, n_resamples=DRAWS, seed=SEED)
    return s.select(*(_r(c, 4).alias(c) for c in ("stat", "low", "high")))


def assoc_boot(spark, d):
    s = resample.paired_sample_association_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, method="bootstrap", n_resamples=DRAWS, seed=SEED)
    return _test(s, *SEG, digits=6)


def assoc_rank(spark, d):
    s = resample.paired_sample_association_permutation_test(_pairs(spark, d), "c_acctbal", "other", "c_custkey", SEG, stat="rho", n_resamples=10, seed=SEED)
    return _test(s, *SEG, digits=6)


def _labelled_pairs(spark, d):
    """Orders with a returned and an accepted line: the greatest quantity of each."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return resample.pairs_from_labels(items, "q", "l_returnflag", ("A", "R"), "l_orderkey", [])


def labels_paired(spark, d):
    return _test(resample.paired_sample_test(_labelled_pairs(spark, d), "x", "y", "l_orderkey", [], stat="mean", n_resamples=10, seed=SEED))


def labels_assoc(spark, d):
    return _test(resample.paired_sample_association_test(_labelled_pairs(spark, d), "x", "y", "l_orderkey", [], n_resamples=10, seed=SEED), digits=6)


# --- draws ----------------------------------------------------------------------------------------


def sign_stats(spark, d):
    s = resample.one_sample_randomization_test(_customers(spark, d), "c_acctbal", "c_custkey", SEG, mu=4500.0, stat="mean", n_resamples=DRAWS, seed=SEED, return_stats=True)
    return s.select(*SEG, F.col("draw").cast("long").alias("draw"), _r("s", 4).alias("s"), _r("stat", 4).alias("stat"), _r("p").alias("p"))


def perm_two_sample_stats(spark, d):
    s = resample.two_sample_permutation_test(_customers(spark, d), "c_acctbal", "c_mktsegment", TWO, "c_custkey", [], stat="meandiff", n_resamples=DRAWS, seed=SEED, return_stats=True)
    return s.select(F.col("draw").cast("long").alias("draw"), _r("s", 4).alias("s"), _r("stat", 4).alias("stat"), _r("p").alias("p"))


def boot_ci_stats(spark, d):
    s = resample.one_sample_confints(_customers(spark, d), "c_acctbal", "c_custkey", SEG, confint=0.9, n_resamples=DRAWS, seed=SEED, return_stats=True)
    return s.select(*SEG, F.col("draw").cast("long").alias("draw"), *(_r(c, 4).alias(c) for c in ("s", "stat", "low", "high")))


def perm_two_way_spread(spark, d):
    """A statistic of one's own: how far apart a factor's level means lie."""

    def spread(df, value, a, b, by):
        each = [df.groupBy(*by, F.col(x).cast("string").alias("level")).agg(F.avg(value).alias("m")).withColumn("term", F.lit(t)) for x, t in ((a, "a"), (b, "b"))]
        return each[0].unionByName(each[1]).groupBy(*by, "term").agg((F.max("m") - F.min("m")).alias("s"))

    c = _customers(spark, d).withColumn("side", F.col("c_nationkey") % 2)
    s = resample.two_way_permutation_test(c, "c_acctbal", "c_mktsegment", "side", "c_custkey", [], stat=spread, n_resamples=DRAWS, seed=SEED)
    return _test(s, "term")


def _n(spark, d):
    return table(spark, d, "nation").count()


def draws_bootstraps(spark, d):
    return resample.bootstraps(spark, _n(spark, d), 20, SEED).select(*(F.col(c).cast("long").alias(c) for c in ("draw", "pos", "i")))


def draws_signs(spark, d):
    return resample.signs(spark, _n(spark, d), 20, SEED).select(*(F.col(c).cast("long").alias(c) for c in ("draw", "i")), "flip")


def draws_jackknifes(spark, d):
    return resample.jackknifes(spark, _n(spark, d))


def draws_randperm(spark, d):
    return resample.randperm(spark, _n(spark, d), 7, SEED).select(F.col("pos").cast("long").alias("pos"), F.col("i").cast("long").alias("i"))


# --- information by name --------------------------------------------------------------------------


def info_dprime(spark, d):
    s = info.information(_items(spark, d), "dprime", value="l_quantity", label="l_linestatus", groups=("F", "O"), by=["l_returnflag"])
    return s.select("l_returnflag", _r("dprime").alias("dprime"))


def _grouped(spark, d, *flags):
    return [_items(spark, d).where(F.col("l_returnflag") == f) for f in flags]


def info_two_groups(spark, d):
    s = info.information_of_groups(*_grouped(spark, d, "A", "R"), method="auroc", value="l_extendedprice", by=["l_linestatus"])
    return s.select("l_linestatus", _r("auroc").alias("auroc"))


def info_groups(spark, d):
    s = info.information_of_groups(*_grouped(spark, d, "A", "N", "R"), method="pev", value="l_quantity", by=[])
    return s.select(_r("pev").alias("pev"), _r("f").alias("f"))


def r2_partial(spark, d):
    t = stats.two_way_terms(stats.two_way_sums(_items(spark, d), "l_quantity", "l_returnflag", "l_linestatus", []), [], True)
    return t.select("term", _r(exprs.r_squared_partial("ss", "ss_error"), 9).alias("r2"))


# --- signals --------------------------------------------------------------------------------------


def phases(spark, d):
    """As points of the unit circle: a phase of pi and one of -pi are the same."""
    p = exprs.phase()
    return _dft(spark, d).select("vec_id", F.col("k").cast("int").alias("k"), _r(F.cos(p), 5).alias("c"), _r(F.sin(p), 5).alias("s"))


def bell_nd(spark, d):
    bell = exprs.gaussian_nd("samples", (0.1, -0.1, 0.0), ((2.0, 0.5, 0.0), (0.5, 1.0, 0.0), (0.0, 0.0, 3.0)), amplitude=2.0, baseline=0.5)
    return _signals(spark, d).select("vec_id", _r(bell).alias("bell"))


def float_range(spark, d):
    r = table(spark, d, "region").select("r_regionkey", F.posexplode(exprs.iarange(0.1, 0.7, 0.2)).alias("i", "x"))
    return r.select("r_regionkey", "i", _r("x").alias("x"))


def mean_waveforms(spark, d):
    """Without a condition: over all rows."""
    return plotdata.mean_waveforms(_signals(spark, d), []).select("i", _r("mean").alias("mean"), _r("sd").alias("sd"))


def samples_in_range(spark, d):
    long = _signals(spark, d).select("vec_id", F.posexplode("samples").alias("i", "x")).withColumn("t", F.col("i") / FS)
    return points.select_time_range(long, 0.25, 0.5, closed=True).select("vec_id", "i", _r("x").alias("x"))


def realign_samples_on_event(spark, d):
    long = _signals(spark, d).select("vec_id", F.posexplode("samples").alias("i", "x"))
    trials = _signals(spark, d).select("vec_id", (F.col("vec_id") % 3 / 8.0 + 0.25).alias("cue"), F.lit(0.5).alias("reward"))
    cut = points.realign_samples_on_event(long, trials, "cue", ["vec_id"], (-0.125, 0.25), FS)
    return cut.select("vec_id", F.col("i").cast("int").alias("i"), _r("x").alias("x"))


def epoch_sums(spark, d):
    bands = spark.createDataFrame([("low", 1.0, 4.0), ("high", 8.0, 32.0)], "name string, low double, high double")
    s = _dft(spark, d).withColumn("freq", F.col("k").cast("double")).withColumn("power", exprs.power())
    return spectral.pool_intervals(s, "power", "freq", bands, ["vec_id"], func="sum").select("vec_id", "name", _r("power", 5).alias("power"))


def synchrony_named(spark, d):
    s = _dft(spark, d).withColumn("trial", F.floor(F.col("vec_id") / 2).cast("long")).withColumn("k", F.col("k").cast("int"))
    got = sync.synchrony(s.where("vec_id % 2 = 0"), s.where("vec_id % 2 = 1"), ["trial", "k"], ["k"], method="plv", return_phase=False)
    return got.select("k", _r("plv").alias("plv"), "n")


def _trials(stat, method):
    def query(spark, d):
        s = sync.single_trial(_pairs_of_channels(spark, d), ["k"], "trial", method, stat)
        return s.select("k", "trial", _r(stat, 4).alias("value"))

    return query


def _coupled(spark, d):
    """Events at one of 64 places of a signal of their user, and the signal as a spectrum with its neighbour as the
    imaginary part."""
    events = _events(spark, d).select(F.col("user_id").alias("vec_id"), (F.col("event_id") % 64 / FS).alias("t"))
    x = _signals(spark, d).select("vec_id", F.posexplode("samples").alias("i", "re"), "samples")
    field = x.select("vec_id", (F.col("i") / FS).alias("time"), "re", F.get("samples", (F.col("i") + 1) % 64).alias("im"), (F.col("i") % 2).cast("double").alias("freq"))
    return events, field, ["vec_id"], spark.createDataFrame([(0, 0.0, 0.5), (1, 0.25, 0.984)], "win int, start double, end double")


def field_plv(spark, d):
    return sync.spike_field_plv(*_coupled(spark, d)).select("freq", "win", _r("plv").alias("plv"), _r("phase", 4).alias("phase"), "n")


def field_ppc(spark, d):
    return sync.spike_field_ppc(*_coupled(spark, d), return_phase=False).select("freq", "win", _r("ppc").alias("ppc"), "n")


def _spectrogram_and_events(spark, d):
    """A short-time spectrum of each signal, in windows of 16 samples, and events at any time of it."""
    events = _events(spark, d).select(F.col("user_id").alias("vec_id"), (F.col("event_id") * 7 % 997 / 997.0).alias("t"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(49)), lambda i: F.slice("samples", i, 16))
    parts = _signals(spark, d).select("vec_id", F.posexplode(cut).alias("i", "x"))
    s = spectral.dft(parts, ["vec_id", "i"], "x", (1, 2, 4))
    field = s.select("vec_id", ((F.col("i") + 8) / FS).alias("time"), (F.col("k") * 4.0).alias("freq"), "re", "im")
    return events, field, ["vec_id"], spark.createDataFrame([(0, 0.0, 0.5), (1, 0.25, 0.984)], "win int, start double, end double")


def field_spectrogram_plv(spark, d):
    return sync.spike_field_plv(*_spectrogram_and_events(spark, d), fs=FS).select("freq", "win", _r("plv").alias("plv"), _r("phase", 4).alias("phase"), "n")


def field_spectrogram_ppc(spark, d):
    return sync.spike_field_ppc(*_spectrogram_and_events(spark, d), return_phase=False).select("freq", "win", _r("ppc").alias("ppc"), "n")


def nearest_samples(spark, d):
    """Each event with the sample of its user's signal that is nearest to it."""
    events = _events(spark, d).select("event_id", F.col("user_id").alias("vec_id"), (F.col("event_id") * 7 % 997 / 997.0).alias("t"))
    x = _signals(spark, d).select("vec_id", F.posexplode("samples").alias("i", "x")).withColumn("time", F.col("i") / FS)
    return windows.nearest_join(events, x, ["vec_id"], "t", "time", 0.5 / FS).select("event_id", "i", _r("x").alias("x"))


def field_coherence(spark, d):
    """Of a grid of events, where a signal is positive, and the signal after it."""
    s = _signals(spark, d)
    grid = s.withColumn("samples", F.transform("samples", lambda x: (x > 0).cast("double")))
    own = lambda f: spectral.dft(f, ["vec_id"], "samples", KS).withColumn("k", F.col("k").cast("int"))
    got = sync.spike_field_coherence(own(grid), own(s), ["vec_id", "k"], ["k"], return_phase=False)
    return got.select("k", _r("coherence").alias("coherence"), "n")


QUERIES = {
    "paired_perm": paired_perm, "paired_perm_left": paired_perm_left, "paired_perm_tail": paired_perm_tail, "paired_boot": paired_boot, "paired_ci": paired_ci,
    "two_sample_ci": two_sample_ci, "assoc_boot": assoc_boot, "assoc_rank": assoc_rank, "labels_paired": labels_paired, "labels_assoc": labels_assoc,
    "sign_stats": sign_stats, "perm_two_sample_stats": perm_two_sample_stats, "boot_ci_stats": boot_ci_stats, "perm_two_way_spread": perm_two_way_spread,
    "draw_bootstraps": draws_bootstraps, "draw_signs": draws_signs, "draw_jackknifes": draws_jackknifes, "draw_randperm": draws_randperm,
    "info_dprime": info_dprime, "info_two_groups": info_two_groups, "info_groups": info_groups, "r2_partial": r2_partial,
    "phases": phases, "bell_nd": bell_nd, "float_range": float_range, "mean_waveforms": mean_waveforms, "samples_in_range": samples_in_range,
    "realign_samples_on_event": realign_samples_on_event, "epoch_sums": epoch_sums, "synchrony_plv": synchrony_named,
    "plv_trials": _trials("plv", "pseudo"), "ppc_trials": _trials("ppc", "pseudo"), "plv_left_out": _trials("plv", "richter"),
    "field_plv": field_plv, "field_ppc": field_ppc, "field_coherence": field_coherence,
    "field_spectrogram_plv": field_spectrogram_plv, "field_spectrogram_ppc": field_spectrogram_ppc, "nearest_samples": nearest_samples,
}

_D = f"d AS (SELECT unnest(range(1, {DRAWS}))::BIGINT AS draw)"
_DALL = f"d AS (SELECT unnest(range(1, {DRAWS + 1}))::BIGINT AS draw)"
_TENTH = "d AS (SELECT unnest(range(1, 10))::BIGINT AS draw)"
_V = "x AS (SELECT obs, seg, v - o - 4000 AS v FROM c)"
_FLIP = f"avg(CASE WHEN substr({_md5('draw', 'obs')}, 1, 1) >= '8' THEN -v ELSE v END)"


def _signed(extreme, draws=_D, n=DRAWS):
    return f"""WITH {_C}, {draws}, {_V}, o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg), s AS (SELECT seg, draw, {_FLIP} AS s FROM x, d GROUP BY ALL)
SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE {extreme})) / {n}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg"""


_LOW, _HIGH = round(DRAWS * (1 - 0.9) / 2) - 1, round(DRAWS - DRAWS * (1 - 0.9) / 2) - 1
_ENDS = f"round(max(s) FILTER (WHERE at_ = {_LOW}), 4) AS low, round(max(s) FILTER (WHERE at_ = {_HIGH}), 4) AS high"
_MEANDIFF = "avg(v) FILTER (WHERE seg = 'BUILDING') - avg(v) FILTER (WHERE seg = 'MACHINERY')"
_LABELS = """x AS (SELECT l_orderkey AS obs, max(l_quantity) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS a, max(l_quantity) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS b FROM lineitem GROUP BY ALL
  HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0)"""
_RANKS = "rank() OVER (PARTITION BY seg{0} ORDER BY {1}) + (count(*) OVER (PARTITION BY seg{0}, {1}) - 1) / 2"
_PERM = f"""n AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY obs) - 1 AS i FROM c), m AS (SELECT seg, draw, v, row_number() OVER (PARTITION BY seg, draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
y AS (SELECT seg, draw, m.v, n.o FROM m JOIN n USING (seg, i) UNION ALL SELECT seg, 0, v, o FROM c)"""
_N25 = "n AS (SELECT unnest(range((SELECT count(*) FROM nation)))::BIGINT AS i)"
_D20 = "d AS (SELECT unnest(range(1, 21))::BIGINT AS draw)"
_SPREAD = "max(m) - min(m) AS s"
_FIELD = f"""{_E}, ev AS (SELECT user_id AS vec_id, event_id % 64 AS i FROM e), f AS (SELECT vec_id, j AS i, (j % 2)::DOUBLE AS freq, embedding[j + 1]::DOUBLE AS re, embedding[(j + 1) % 64 + 1]::DOUBLE AS im FROM (SELECT vec_id, embedding, unnest(range(64)) AS j FROM embeddings)),
h AS (SELECT freq, win, re, im, sqrt(re * re + im * im) AS z FROM ev JOIN f USING (vec_id, i) JOIN (VALUES (0, 0, 500), (1, 250, 984)) AS w(win, a, b) ON round_even(i / 64::DOUBLE * 1000, 0) BETWEEN a AND b),
g AS (SELECT freq, win, avg(re / z) AS re, avg(im / z) AS im, count(*) AS n FROM h GROUP BY ALL)"""
_STFT = f"""{_E}, ev AS (SELECT user_id AS vec_id, (event_id * 7 % 997)::DOUBLE / 997::DOUBLE AS t FROM e), j AS (SELECT unnest(range(16)) AS j), k AS (SELECT unnest([1, 2, 4]) AS k),
f AS (SELECT vec_id, i + 8 AS at_, k * 4::DOUBLE AS freq, sum(embedding[i + j + 1]::DOUBLE * cos(2 * pi() * k * j / 16)) AS re, -sum(embedding[i + j + 1]::DOUBLE * sin(2 * pi() * k * j / 16)) AS im FROM (SELECT vec_id, embedding, unnest(range(49)) AS i FROM embeddings), j, k GROUP BY ALL),
h AS (SELECT freq, win, re, im, sqrt(re * re + im * im) AS z FROM ev JOIN f ON ev.vec_id = f.vec_id AND round_even(t * 64, 0)::BIGINT = at_ JOIN (VALUES (0, 0, 500), (1, 250, 984)) AS w(win, a, b) ON round_even(t * 1000, 0) BETWEEN a AND b),
g AS (SELECT freq, win, avg(re / z) AS re, avg(im / z) AS im, count(*) AS n FROM h GROUP BY ALL)"""
_ONE_PLV = f"{_P}, u AS (SELECT k, trial, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM x), t AS (SELECT k, trial, count(*) OVER w AS n, sum(re) OVER w AS a, sum(im) OVER w AS b, re, im FROM u WINDOW w AS (PARTITION BY k))"
_LEFT = "((a - re) * (a - re) + (b - im) * (b - im))"

ORACLES = {
    "paired_perm": _signed("abs(s) >= abs(o)"),
    "paired_perm_left": _signed("s <= o"),
    "paired_perm_tail": _signed("s * 2 >= o"),
    "paired_boot": f"""WITH {_C}, {_D}, {_V}, {_picked('x', 'v')}, o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg), s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL)
SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s - o) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg""",
    "paired_ci": f"""WITH {_C}, {_DALL}, x AS (SELECT obs, seg, v - o AS v FROM c), {_picked('x', 'v')}, s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL), q AS (SELECT seg, s, row_number() OVER (PARTITION BY seg ORDER BY s, draw) - 1 AS at_ FROM s),
o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg) SELECT seg AS c_mktsegment, round(any_value(o), 4) AS stat, {_ENDS} FROM q JOIN o USING (seg) GROUP BY seg""",
    "two_sample_ci": f"""WITH {_C}, {_DALL}, {_PAIR}, {_picked('c2', 'v', key=True)}, s AS (SELECT draw, {_MEANDIFF} AS s FROM k GROUP BY draw), q AS (SELECT s, row_number() OVER (ORDER BY s, draw) - 1 AS at_ FROM s)
SELECT (SELECT round({_MEANDIFF}, 4) FROM c2) AS stat, {_ENDS} FROM q""",
    "assoc_boot": f"""WITH {_C}, {_D}, {_picked('c', 'v', 'o')}, s AS (SELECT seg, draw, corr(v, o) AS s FROM k GROUP BY ALL), o AS (SELECT seg, corr(v, o) AS o FROM c GROUP BY seg)
SELECT seg AS c_mktsegment, round(any_value(o), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s - o) >= abs(o))) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg) GROUP BY seg""",
    "assoc_rank": f"""WITH {_C}, {_TENTH}, {_PERM}, r AS (SELECT seg, draw, {_RANKS.format(', draw', 'v')} AS a, {_RANKS.format(', draw', 'o')} AS b FROM y), s AS (SELECT seg, draw, corr(a, b) AS s FROM r GROUP BY ALL)
SELECT s.seg AS c_mktsegment, round(any_value(o.s), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s.s) >= abs(o.s) - 1e-12::DOUBLE)) / 10::DOUBLE, 6) AS p FROM s JOIN s AS o ON s.seg = o.seg AND o.draw = 0 WHERE s.draw > 0 GROUP BY s.seg""",
    "labels_paired": f"""WITH {_TENTH}, {_LABELS}, s AS (SELECT draw, avg(CASE WHEN substr({_md5('draw', 'obs')}, 1, 1) >= '8' THEN b - a ELSE a - b END) AS s FROM x, d GROUP BY draw), o AS (SELECT avg(a - b) AS o FROM x)
SELECT round(any_value(o), 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / 10::DOUBLE, 6) AS p FROM s, o""",
    "labels_assoc": f"""WITH {_TENTH}, {_LABELS}, n AS (SELECT *, row_number() OVER (ORDER BY obs) - 1 AS i FROM x), m AS (SELECT draw, a, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
s AS (SELECT draw, corr(m.a, n.b) AS s FROM m JOIN n USING (i) GROUP BY draw), o AS (SELECT corr(a, b) AS o FROM x) SELECT round(any_value(o), 6) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o))) / 10::DOUBLE, 6) AS p FROM s, o""",
    "sign_stats": f"""WITH {_C}, {_D}, x AS (SELECT obs, seg, v - 4500 AS v FROM c), o AS (SELECT seg, avg(v) AS o FROM x GROUP BY seg), s AS (SELECT seg, draw, {_FLIP} AS s FROM x, d GROUP BY ALL)
SELECT seg AS c_mktsegment, draw, round(s, 4) AS s, round(o, 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o)) OVER (PARTITION BY seg)) / {DRAWS}::DOUBLE, 6) AS p FROM s JOIN o USING (seg)""",
    "perm_two_sample_stats": f"""WITH {_C}, {_D}, {_PAIR}, o AS (SELECT {_MEANDIFF} AS o, count(*) FILTER (WHERE seg = 'BUILDING') AS n1 FROM c2),
k AS (SELECT draw, v, CASE WHEN row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) <= n1 THEN 'BUILDING' ELSE 'MACHINERY' END AS seg FROM c2, d, o), s AS (SELECT draw, {_MEANDIFF} AS s FROM k GROUP BY draw)
SELECT draw, round(s, 4) AS s, round(o, 4) AS stat, round((1 + count(*) FILTER (WHERE abs(s) >= abs(o)) OVER ()) / {DRAWS}::DOUBLE, 6) AS p FROM s, o""",
    "boot_ci_stats": f"""WITH {_C}, {_DALL}, {_picked('c', 'v')}, s AS (SELECT seg, draw, avg(v) AS s FROM k GROUP BY ALL), q AS (SELECT seg, s, row_number() OVER (PARTITION BY seg ORDER BY s, draw) - 1 AS at_ FROM s),
o AS (SELECT seg, avg(v) AS o FROM c GROUP BY seg), b AS (SELECT seg, {_ENDS} FROM q GROUP BY seg) SELECT seg AS c_mktsegment, draw, round(s, 4) AS s, round(o, 4) AS stat, low, high FROM s JOIN o USING (seg) JOIN b USING (seg)""",
    "perm_two_way_spread": f"""WITH {_C}, {_D}, n AS (SELECT *, row_number() OVER (ORDER BY obs) - 1 AS i FROM c), m AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY {_md5('draw', 'obs')}, obs) - 1 AS i FROM n, d),
p AS (SELECT draw, m.v, seg, side FROM m JOIN n USING (i) UNION ALL SELECT 0, v, seg, side FROM c), f AS (SELECT draw, 'a' AS term, {_SPREAD} FROM (SELECT draw, seg, avg(v) AS m FROM p GROUP BY ALL) GROUP BY draw UNION ALL SELECT draw, 'b', {_SPREAD} FROM (SELECT draw, side, avg(v) AS m FROM p GROUP BY ALL) GROUP BY draw)
SELECT s.term, round(any_value(o.s), 4) AS stat, round((1 + count(*) FILTER (WHERE s.s >= o.s)) / {DRAWS}::DOUBLE, 6) AS p FROM f AS s JOIN f AS o ON s.term = o.term WHERE s.draw > 0 AND o.draw = 0 GROUP BY s.term""",
    "draw_bootstraps": f"WITH {_N25}, {_D20} SELECT draw, i AS pos, floor({_u('draw', 'i')} * (SELECT count(*) FROM n))::BIGINT AS i FROM n, d",
    "draw_signs": f"WITH {_N25}, {_D20} SELECT draw, i, substr({_md5('draw', 'i')}, 1, 1) >= '8' AS flip FROM n, d",
    "draw_jackknifes": f"WITH {_N25} SELECT a.i AS draw, b.i FROM n AS a, n AS b WHERE a.i <> b.i",
    "draw_randperm": f"WITH {_N25}, p AS (SELECT row_number() OVER (ORDER BY {_md5('1', 'i')}, i) - 1 AS pos, i FROM n) SELECT pos, i FROM p WHERE pos < 7",
    "info_dprime": """WITH s AS (SELECT l_returnflag, l_linestatus AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(coalesce((max(m) FILTER (WHERE g = 'F') - max(m) FILTER (WHERE g = 'O')) / nullif(sqrt(sum((n - 1) * v) / (sum(n) - 2)), 0), 0), 6) AS dprime FROM s GROUP BY ALL""",
    "info_two_groups": """WITH r AS (SELECT l_linestatus, l_returnflag AS g, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2 AS r FROM lineitem WHERE l_returnflag IN ('A', 'R')),
s AS (SELECT l_linestatus, sum(r) FILTER (WHERE g = 'A') AS r, count(*) FILTER (WHERE g = 'A')::DOUBLE AS a, count(*) FILTER (WHERE g = 'R')::DOUBLE AS b FROM r GROUP BY ALL) SELECT l_linestatus, round((r - a * (a + 1) / 2) / nullif(a * b, 0), 6) AS auroc FROM s""",
    "info_groups": """WITH c AS (SELECT l_returnflag, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss FROM lineitem GROUP BY ALL), g AS (SELECT avg(l_quantity) AS gm, count(*)::DOUBLE AS nn FROM lineitem),
f AS (SELECT sum(n * (m - gm) * (m - gm)) AS sg, sum(ss) AS se, count(*) - 1 AS k, any_value(nn) AS nn FROM c, g) SELECT round(100 * (sg - k * se / (nn - k - 1)) / (sg + se + se / (nn - k - 1)), 6) AS pev, round(sg / k / (se / (nn - k - 1)), 6) AS f FROM f""",
    "r2_partial": """WITH m AS (SELECT avg(l_quantity) AS gm, var_pop(l_quantity) * count(*) AS st FROM lineitem),
a AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), m), b AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_linestatus), m),
x AS (SELECT sum(n * (v - gm) * (v - gm)) AS ss FROM (SELECT count(*) AS n, avg(l_quantity) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus), m), t AS (SELECT 'a' AS term, ss FROM a UNION ALL SELECT 'b', ss FROM b UNION ALL SELECT 'ab', x.ss - a.ss - b.ss FROM a, b, x)
SELECT term, round(t.ss / (t.ss + st - x.ss), 9) AS r2 FROM t, m, x""",
    "phases": f"WITH {_P.split(', p AS')[0]} SELECT vec_id, k, round(re / sqrt(re * re + im * im), 5) AS c, round(im / sqrt(re * re + im * im), 5) AS s FROM s",
    "bell_nd": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE - 0.1::DOUBLE AS a, embedding[2]::DOUBLE + 0.1::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings) SELECT vec_id, round(2 * exp(-0.5::DOUBLE * (2 * a * a + a * b + b * b + 3 * c * c)) + 0.5::DOUBLE, 6) AS bell FROM p""",
    "float_range": "SELECT r_regionkey, i::INTEGER AS i, round(0.1::DOUBLE + i * 0.2::DOUBLE, 6) AS x FROM region, range(4) AS t(i)",
    "mean_waveforms": f"WITH {_L} SELECT i::INTEGER AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM l GROUP BY ALL",
    "samples_in_range": f"WITH {_L} SELECT vec_id, i::INTEGER AS i, round(x, 6) AS x FROM l WHERE i BETWEEN 16 AND 32",
    "realign_samples_on_event": f"WITH {_L} SELECT vec_id, (i - (vec_id % 3) * 8 - 8)::INTEGER AS i, round(x, 6) AS x FROM l WHERE i - (vec_id % 3) * 8 - 8 BETWEEN 0 AND 24",
    "epoch_sums": f"WITH {_P.split(', p AS')[0]}, b AS (SELECT * FROM (VALUES ('low', 1, 4), ('high', 8, 32)) AS v(name, a, z)) SELECT vec_id, name, round(sum(re * re + im * im), 5) AS power FROM s JOIN b ON k BETWEEN a AND z GROUP BY ALL",
    "synchrony_plv": f"WITH {_P}, c AS (SELECT k, avg(re / sqrt(re * re + im * im)) AS re, avg(im / sqrt(re * re + im * im)) AS im, count(*) AS n FROM x GROUP BY k) SELECT k, round(sqrt(re * re + im * im), 6) AS plv, n FROM c",
    "plv_trials": f"WITH {_ONE_PLV} SELECT k, trial, round(sqrt(a * a + b * b) - sqrt({_LEFT}), 4) AS value FROM t",
    "plv_left_out": f"WITH {_ONE_PLV} SELECT k, trial, round(sqrt({_LEFT}) / (n - 1), 4) AS value FROM t",
    "ppc_trials": f"WITH {_ONE_PLV} SELECT k, trial, round(n * ((a * a + b * b) / n - 1) / (n - 1) - (n - 1) * ({_LEFT} / (n - 1) - 1) / (n - 2), 4) AS value FROM t",
    "field_plv": f"WITH {_FIELD} SELECT freq, win, round(sqrt(re * re + im * im), 6) AS plv, round(atan2(im, re), 4) AS phase, n FROM g",
    "field_ppc": f"WITH {_FIELD} SELECT freq, win, round((n * (re * re + im * im) - 1) / (n - 1), 6) AS ppc, n FROM g",
    "field_spectrogram_plv": f"WITH {_STFT} SELECT freq, win, round(sqrt(re * re + im * im), 6) AS plv, round(atan2(im, re), 4) AS phase, n FROM g",
    "field_spectrogram_ppc": f"WITH {_STFT} SELECT freq, win, round((n * (re * re + im * im) - 1) / (n - 1), 6) AS ppc, n FROM g",
    "nearest_samples": f"WITH {_E} SELECT event_id, i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM (SELECT event_id, user_id AS vec_id, round_even((event_id * 7 % 997)::DOUBLE / 997::DOUBLE * 64, 0)::INTEGER AS i FROM e) JOIN embeddings USING (vec_id) WHERE i < 64",
    "field_coherence": f"""WITH {_L}, k AS (SELECT unnest([{_K}])::INTEGER AS k), s AS (SELECT vec_id, k, sum((x > 0)::INTEGER * cos(2 * pi() * k * i / n)) AS r1, -sum((x > 0)::INTEGER * sin(2 * pi() * k * i / n)) AS i1, sum(x * cos(2 * pi() * k * i / n)) AS r2, -sum(x * sin(2 * pi() * k * i / n)) AS i2 FROM l, k GROUP BY ALL),
c AS (SELECT k, avg(r1 * r2 + i1 * i2) AS re, avg(i1 * r2 - r1 * i2) AS im, avg(r1 * r1 + i1 * i1) AS p1, avg(r2 * r2 + i2 * i2) AS p2, count(*) AS n FROM s GROUP BY k) SELECT k, round(sqrt(re * re + im * im) / sqrt(p1 * p2), 6) AS coherence, n FROM c""",
}
