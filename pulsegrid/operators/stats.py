"""Descriptive and test statistics. `by` names the key columns of independent series; each operator is one or two
hash aggregates with partial sums before the shuffle, unless the order within a series matters."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.exprs import col, div

NEAR_ZERO = 1e-8


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(F.broadcast(right))  # without keys, right is one row


def zscore(df: DataFrame, value: str, by: list[str], baseline: Column | None = None, trial: str | None = None, ddof: int = 0, zerotol: float = NEAR_ZERO, out: str = "z", stats: bool = False) -> DataFrame:
    """(value - mean) / sd of the series; null where sd is at most zerotol.

    With baseline, mean and sd come from the rows where it holds; with trial too, from the means of those rows by
    trial. The statistics are aggregated and joined back, so a long series isn't gathered in one task."""
    base = df if baseline is None else df.where(baseline)
    if trial:
        base = base.groupBy(*by, trial).agg(F.avg(value).alias(value))
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    s = base.groupBy(*by).agg(F.avg(value).alias("mean"), sd(value).alias("sd"))
    z = F.when(F.col("sd") > zerotol, (F.col(value) - F.col("mean")) / F.col("sd"))
    got = _join(df, s, by).withColumn(out, z)
    return got if stats else got.drop("mean", "sd")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(F.abs(bottom) > NEAR_ZERO, top / bottom)


def fano(value, ddof: int = 0) -> Column:
    """Variance over mean, an aggregate column."""
    return _ratio((F.var_pop if ddof == 0 else F.var_samp)(col(value)), F.avg(col(value)))


fano_factor = fano


def cv(value, ddof: int = 0) -> Column:
    """Standard deviation over mean, an aggregate column."""
    return _ratio((F.stddev_pop if ddof == 0 else F.stddev_samp)(col(value)), F.avg(col(value)))


coefficient_of_variation = cv


def burst_fract(value, crit: float = 0.02) -> Column:
    """Share of intervals under crit, an aggregate column."""
    return F.avg((col(value) < crit).cast("double"))


def local_variation(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by..., cv2, lv): mean of 2|a - b| / (a + b), and 3 / (n - 1) times the sum of its square over four, over
    successive values of a series; null where a series has fewer than two, or a sum is zero."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    r = df.select(*by, div(F.col(value) - before, F.col(value) + before).alias("r"), before.alias("before")).where("before IS NOT NULL")
    return r.groupBy(*by).agg(F.avg(2.0 * F.abs(F.col("r"))).alias("cv2"), (3.0 * F.sum(F.col("r") * F.col("r")) / F.count("*")).alias("lv"))


def describe(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """Named aggregate columns by series."""
    return df.groupBy(*by).agg(*(c.alias(k) for k, c in stats.items()))


def condition_mean(df: DataFrame, value: str, by: list[str], label: str) -> DataFrame:
    return df.groupBy(*by, label).agg(F.avg(value).alias("mean"))


@dataclass(frozen=True)
class Mergeable:
    """A statistic of one's own as states that merge: update takes a state and a pandas frame of some rows, merge two
    states, finish makes the value. A state can be anything that pickles, of a size that doesn't grow with its rows."""

    start: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


#: States that a task holds before it hands them on, and parts in which a key's states are merged first.
MOST_STATES, PARTS = 4096, 64


def merge_apply(df: DataFrame, values: str | list[str], by: list[str], function: Mergeable, out: str = "stat", kind: str = "double") -> DataFrame:
    """(by..., out) with function over the rows of each key. Nulls in by are a key of their own; values come as they are.

    Tasks make a state for each key of the rows that they read, and only states are shuffled. A key's states, at most
    some a task, are merged in PARTS groups and those into one, so no key's rows and no key's states are one task."""
    names = [values] if isinstance(values, str) else list(values)
    keys = df.select(*by).schema
    arrow = [to_arrow_type(f.dataType) for f in keys]
    result = to_arrow_type(df.sparkSession.createDataFrame([], f"v {kind}").schema[0].dataType)

    def rows(held: dict, task: int) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], t) for i, t in enumerate(arrow)]
        return pa.RecordBatch.from_arrays([*cols, pa.array([task] * len(held), pa.int32()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], [*by, "__part", "__state"])

    def update(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        task = TaskContext.get().partitionId() % PARTS
        for batch in batches:
            each = zip(*(c.to_pylist() for c in batch.columns[: len(by)])) if by else [()] * batch.num_rows
            found: dict = {}
            for i, k in enumerate(each):
                found.setdefault(k, []).append(i)
            rest = pa.Table.from_batches([batch.select(names)])
            for k, at in found.items():
                held[k] = function.update(held[k] if k in held else function.start(), rest.take(pa.array(at)).to_pandas())
            if len(held) > MOST_STATES:
                yield rows(held, task)
                held = {}
        if held:
            yield rows(held, task)

    def merged(table: pa.Table) -> Any:
        return reduce(function.merge, (pickle.loads(s.as_py()) for s in table["__state"]))

    def some(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).select(by).append_column("__state", pa.array([pickle.dumps(merged(table))], pa.binary()))

    def last(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).select(by).append_column(out, pa.array([function.finish(merged(table))], result))

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    lead = named + ", " if by else ""
    states = df.select(*by, *(c for c in names if c not in by)).mapInArrow(update, lead + "`__part` int, `__state` binary")
    parts = states.groupBy(*by, "__part").applyInArrow(some, lead + "`__state` binary")
    return parts.groupBy(*by).applyInArrow(last, lead + f"`{out}` {kind}")


def condition_apply(df: DataFrame, value: str, by: list[str], label: str, function: Callable[[str], Column] | Mergeable | Callable, out: str = "stat", schema: str | None = None) -> DataFrame:
    """function by series and label: one that makes an aggregate column of a column name; a Mergeable, whose labels may
    hold any number of rows; or, with a schema for its result, a function of a pandas frame to a pandas frame (whose
    groups must fit in a task)."""
    if isinstance(function, Mergeable):
        return merge_apply(df, value, [*by, label], function, out)
    if schema is None:
        return df.groupBy(*by, label).agg(function(value).alias(out))
    return df.select(*by, label, value).groupBy(*by, label).applyInPandas(function, schema)


def _pearson(x: str, y: str) -> Column:
    """From sums, as the built-in corr raises on constants; within [-1, 1]."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.covar_pop(x, y) / (sx * sy))))


def correlation(df: DataFrame, x: str, y: str, by: list[str], out: str = "r") -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(_pearson(x, y).alias(out))


#: Distinct values of all series above which running sums are taken by ranges of the value.
MOST_IN_A_TASK = 1_000_000


def running_before(counted: DataFrame, value: str, by: list[str], n: str, out: str) -> DataFrame:
    """counted (by..., value, n), a row for each distinct value, with the sum of n over lesser values of its series.

    Beyond MOST_IN_A_TASK rows, values fall in ranges between approximate quantiles; a range is summed in a task of its
    own and begins at the sum of the ranges before it, so that one long series isn't one task."""
    total = lambda over: F.coalesce(F.sum(n).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = dict(counted.dtypes)[value] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(counted.dtypes)[value].startswith("decimal")
    rows = counted.limit(MOST_IN_A_TASK + 1).count() if number else 0
    if rows <= MOST_IN_A_TASK:
        return counted.withColumn(out, total(Window.partitionBy(*by).orderBy(value)))
    cuts = counted.agg(F.percentile_approx(F.col(value).cast("double"), [k / 200 for k in range(1, 200)], 10_000)).first()[0]
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts))))
    ranged = counted.withColumn("__range", F.size(F.filter(bounds, lambda c: c < F.col(value).cast("double"))))
    sums = ranged.groupBy(*by, "__range").agg(F.sum(n).alias(n))
    sums = sums.withColumn("__start", total(Window.partitionBy(*by).orderBy("__range"))).drop(n)
    inside = ranged.withColumn(out, total(Window.partitionBy(*by, "__range").orderBy(value)))
    return inside.join(sums, [*by, "__range"]).withColumn(out, F.col(out) + F.col("__start")).drop("__range", "__start")


def average_ranks(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """df with ranks from 1, ties sharing their mean rank.

    Equal values are counted before anything is sorted, so what is sorted has a row for each distinct value."""
    n = running_before(df.groupBy(*by, value).agg(F.count("*").alias("__n")), value, by, "__n", "__below")
    ranks = n.select(*by, value, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(out))
    return df.join(ranks, [*by, value])


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str], out: str = "rho") -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    return correlation(average_ranks(average_ranks(d, x, by, "__rx"), y, by, "__ry"), "__rx", "__ry", by, out)


def one_sample_tstat(value, mu: float = 0.0) -> Column:
    """An aggregate column."""
    v = col(value)
    return div(F.avg(v) - float(mu), F.stddev_samp(v) / F.sqrt(F.count(v)))


def paired_tstat(x, y, d: float = 0.0) -> Column:
    """An aggregate column over rows that hold both members of a pair."""
    return one_sample_tstat(col(x) - col(y), d)


def _groups(label: str, value: str, groups: tuple) -> dict[str, Column]:
    """Size, mean and sample variance of two groups, as aggregate columns."""
    out = {}
    for k, g in enumerate(groups, 1):
        v = F.when(F.col(label) == F.lit(g), F.col(value).cast("double"))
        out |= {f"n{k}": F.count(v).cast("double"), f"m{k}": F.avg(v), f"v{k}": F.var_samp(v)}
    return out


def two_sample_tstat(df: DataFrame, value: str, label: str, groups: tuple, by: list[str], equal_var: bool = True, d: float = 0.0, out: str = "t") -> DataFrame:
    """First group's mean less the second's less d, over its standard error: pooled, or Welch's."""
    s = df.groupBy(*by).agg(*(c.alias(k) for k, c in _groups(label, value, groups).items()))
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    se2 = div((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2) * (div(1.0 + n1 * 0, n1) + div(1.0 + n2 * 0, n2)) if equal_var else div(v1, n1) + div(v2, n2)
    return s.select(*by, div(F.col("m1") - F.col("m2") - float(d), F.sqrt(se2)).alias(out))


def _cells(df: DataFrame, value: str, by: list[str], labels: list[str]) -> DataFrame:
    """Size, mean and sum of squared deviations of each cell: all that analyses of variance need."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull()).groupBy(*by, *labels).agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("m"), (F.var_pop(v) * F.count(v)).alias("ss"))


def one_way_sums(df: DataFrame, value: str, label: str, by: list[str], grand: str = "mean_of_obs") -> DataFrame:
    """(by..., n_obs, k, ss_groups, ss_total, n_last): the sums behind one-way F and explained variance.

    Deviations are taken from the mean over observations, or over group means if grand is "mean_of_means"."""
    c = _cells(df, value, by, [label])  # windows below run over cells, not observations
    w = Window.partitionBy(*by)
    gm = div(F.sum(F.col("n") * F.col("m")).over(w), F.sum("n").over(w)) if grand == "mean_of_obs" else F.avg("m").over(w)
    d = c.withColumn("gm", gm)
    between = F.sum(F.col("n") * (F.col("m") - F.col("gm")) * (F.col("m") - F.col("gm")))
    return d.groupBy(*by).agg(F.sum("n").alias("n_obs"), F.count("*").cast("double").alias("k"), F.max_by("n", label).alias("n_last"), between.alias("ss_groups"), (between + F.sum("ss")).alias("ss_total"))


def one_way_fstat(df: DataFrame, value: str, label: str, by: list[str], compat: bool = False, out: str = "f") -> DataFrame:
    """compat: take the error's degrees of freedom from the last group's size alone, as some published values do."""
    s = one_way_sums(df, value, label, by)
    n = F.col("n_last" if compat else "n_obs")
    return s.select(*by, div(div("ss_groups", F.col("k") - 1), div(F.col("ss_total") - F.col("ss_groups"), n - F.col("k"))).alias(out))


def two_way_sums(df: DataFrame, value: str, a: str, b: str, by: list[str], grand: str = "mean_of_obs") -> DataFrame:
    """(by..., n_obs, ka, kb, kc, ss_a, ss_b, ss_cells, ss_total, n_last_cell, n_last_b): one pass over the
    observations; level means are windows over the cells, which are few."""
    c = _cells(df, value, by, [a, b])
    w, wa, wb = (Window.partitionBy(*by, *k) for k in ([], [a], [b]))
    mean = lambda over: div(F.sum(F.col("n") * F.col("m")).over(over), F.sum("n").over(over))
    d = c.withColumn("gm", mean(w) if grand == "mean_of_obs" else F.avg("m").over(w)).withColumn("ma", mean(wa)).withColumn("mb", mean(wb)).withColumn("nb", F.sum("n").over(wb))
    dev = lambda m: F.sum(F.col("n") * (F.col(m) - F.col("gm")) * (F.col(m) - F.col("gm")))
    levels = lambda k: F.size(F.collect_set(k)).cast("double")
    return d.groupBy(*by).agg(
        F.sum("n").alias("n_obs"), levels(a).alias("ka"), levels(b).alias("kb"), F.count("*").cast("double").alias("kc"), dev("ma").alias("ss_a"), dev("mb").alias("ss_b"), dev("m").alias("ss_cells"),
        (dev("m") + F.sum("ss")).alias("ss_total"), F.max_by("n", F.struct(a, b)).alias("n_last_cell"), F.max_by("nb", b).alias("n_last_b"),
    )


def two_way_terms(sums: DataFrame, by: list[str], interact: bool, compat: bool = False) -> DataFrame:
    """(by..., term, ss, df, ss_error, df_error, ss_total, n_obs): a row for each of a, b and, with interact, ab.

    compat takes the additive model's error degrees of freedom from factor b alone."""
    c = F.col
    ss_ab, df_ab = c("ss_cells") - c("ss_a") - c("ss_b"), c("kc") - 1 - (c("ka") - 1) - (c("kb") - 1)
    terms = [("a", c("ss_a"), c("ka") - 1), ("b", c("ss_b"), c("kb") - 1)] + ([("ab", ss_ab, df_ab)] if interact else [])
    error = c("ss_total") - (c("ss_cells") if interact else c("ss_a") + c("ss_b"))
    df_error = c("n_obs") - 1 - (c("kc") - 1 if interact else (c("kb") - 1 if compat else c("ka") + c("kb") - 2))
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), s.alias("ss"), d.alias("df")) for t, s, d in terms))).alias("x")
    extra = ["n_last_cell", "n_last_b", "kc", "kb"]
    return sums.select(*by, rows, error.alias("ss_error"), df_error.alias("df_error"), "ss_total", "n_obs", *extra).select(*by, "x.*", "ss_error", "df_error", "ss_total", "n_obs", *extra)


def two_way_fstat(df: DataFrame, value: str, a: str, b: str, by: list[str], interact: bool = True, compat: bool = False) -> DataFrame:
    """(by..., term, f). compat: the error's degrees of freedom come from the last group's size, as above."""
    t = two_way_terms(two_way_sums(df, value, a, b, by), by, interact)
    dfe = (F.col("n_last_cell") - F.col("kc") if interact else F.col("n_last_b") - F.col("kb")) if compat else F.col("df_error")
    return t.select(*by, "term", div(div("ss", "df"), div(F.col("ss_error"), dfe)).alias("f"))


def groups_to_labels(*groups: DataFrame, label: str = "label") -> DataFrame:
    """The groups' rows one below the other, labelled 0, 1, ..."""
    out = groups[0].withColumn(label, F.lit(0))
    for k, g in enumerate(groups[1:], 1):
        out = out.unionByName(g.withColumn(label, F.lit(k)))
    return out


def labels_to_groups(df: DataFrame, label: str, groups: list) -> list[DataFrame]:
    return [df.where(F.col(label) == F.lit(g)) for g in groups]
