"""Information that a value carries about a label: separation, ROC area, mutual information, explained variance,
decoding. `by` names the key columns of independent series."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.exprs import div, entropy, eta_squared, omega_squared, omega_squared_partial, r_squared_partial
from ..session import checkpointed, written
from . import stats


def dprime(df: DataFrame, value: str, label: str, groups: tuple, by: list[str], signed: bool = True, out: str = "dprime") -> DataFrame:
    """First group's mean less the second's over their pooled standard deviation; 0 where that is undefined."""
    s = df.groupBy(*by).agg(*(c.alias(k) for k, c in stats._groups(label, value, groups).items()))
    pooled = div((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2)
    d = F.coalesce(div(F.col("m1") - F.col("m2"), F.sqrt(pooled)), F.lit(0.0))
    return s.select(*by, (d if signed else F.abs(d)).alias(out))


def auroc(df: DataFrame, value: str, label: str, groups: tuple, by: list[str], signed: bool = True, out: str = "auroc") -> DataFrame:
    """Chance that a value of the first group exceeds one of the second, ties half.

    From counts of distinct values: what is sorted has a row for each distinct value, not for each observation."""
    g1, g2 = (F.count(F.when(F.col(label) == F.lit(g), 1)) for g in groups)
    n = df.where(F.col(value).isNotNull() & F.col(label).isin(*groups)).groupBy(*by, value).agg(g1.alias("a"), g2.alias("b"))
    n = stats.running_before(n, value, by, "b", "below")
    s = n.withColumn("w", F.col("a") * (F.col("below") + F.col("b") / 2.0)).groupBy(*by).agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    a = div("w", F.col("a") * F.col("b"))
    return s.select(*by, (a if signed else F.abs(a - 0.5) + 0.5).alias(out))


MOST_EXACT = 1_000_000


def fd_bins(df: DataFrame, value: str) -> tuple[float, float, int]:
    """(low, width, n) of equal bins by the rule of Freedman and Diaconis over all values. Quartiles are exact up to
    MOST_EXACT values, and from a quantile sketch of bounded size beyond, as exact ones hold all distinct values."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    quartile = lambda p: F.percentile(value, p) if n <= MOST_EXACT else F.percentile_approx(value, p, 1_000_000)
    q1, q3 = (None if x is None else float(x) for x in df.agg(quartile(0.25), quartile(0.75)).first())
    width = 2.0 * (q3 - q1) / n ** (1 / 3) if n else 0.0
    k = max(1, int(np.ceil((high - low) / width))) if width > 0 else 1
    return float(low), (high - low) / k if high > low else 1.0, k


def digitize(value: str, low: float, width: float, k: int) -> Column:
    """Bin number from 1; the last edge has a number of its own."""
    return F.greatest(F.lit(0), F.least(F.lit(k + 1), F.floor((F.col(value) - low) / width) + 1))


def mutual_info(df: DataFrame, value: str, label: str, by: list[str], bins: tuple[float, float, int] | str | None = None, out: str = "info") -> DataFrame:
    """Bits that the value, as a category, has about the label. bins: None takes values as they are, "fd" bins them
    by fd_bins over all series, or (low, width, n)."""
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    r = F.col(value) if bins is None else digitize(value, *(fd_bins(d, value) if bins == "fd" else bins))
    n = d.groupBy(*by, F.col(label).alias("__s"), r.alias("__r")).agg(F.count("*").alias("n"))
    over = lambda *keys: F.sum("n").over(Window.partitionBy(*by, *keys))
    j = n.select(*by, "n", over().alias("all"), over("__s").alias("s"), over("__r").alias("r"))
    bits = F.col("n") / F.col("all") * F.log2(F.col("n") * F.col("all") / (F.col("s") * F.col("r")))
    return j.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(bits)).alias(out))


mutual_information = mutual_info


def anova1(df: DataFrame, value: str, label: str, by: list[str], omega: bool = True, grand: str = "mean_of_obs", as_pct: bool = True, with_p: bool = False) -> DataFrame:
    """(by..., pev, f[, p]): explained variance of a one-way model, bias-corrected with omega; 0 without variance."""
    s = stats.one_way_sums(df, value, label, by, grand)
    dfg, dfe = F.col("k") - 1, F.col("n_obs") - F.col("k")
    mse = div(F.col("ss_total") - F.col("ss_groups"), dfe)
    pev = omega_squared("ss_groups", "ss_total", mse, dfg) if omega else eta_squared("ss_groups", "ss_total")
    zero = F.col("ss_total") <= 0
    got = s.select(*by, (F.when(zero, 0.0).otherwise(pev) * (100.0 if as_pct else 1.0)).alias("pev"), F.when(zero, 0.0).otherwise(div(div("ss_groups", dfg), mse)).alias("f"), dfg.alias("df1"), dfe.alias("df2"))
    return got.withColumn("p", kernels.f_survival("f", "df1", "df2")) if with_p else got.drop("df1", "df2")


def anova2(df: DataFrame, value: str, a: str, b: str, by: list[str], interact: bool = True, omega: bool = True, partial: bool = False, grand: str = "mean_of_obs", as_pct: bool = True, compat: bool = False, total: bool = False, with_p: bool = False) -> DataFrame:
    """(by..., term, pev, f[, p]) of a two-way model; total adds a row with the terms' sum."""
    t = stats.two_way_terms(stats.two_way_sums(df, value, a, b, by, grand), by, interact, compat)
    mse = div("ss_error", "df_error")
    if partial:
        pev = omega_squared_partial("ss", "ss_total", mse, "df", "n_obs") if omega else r_squared_partial("ss", "ss_error")
    else:
        pev = omega_squared("ss", "ss_total", mse, "df") if omega else eta_squared("ss", "ss_total")
    zero = F.col("ss_total") <= 0
    got = t.select(*by, "term", (F.when(zero, 0.0).otherwise(pev) * (100.0 if as_pct else 1.0)).alias("pev"), F.when(zero, 0.0).otherwise(div(div("ss", "df"), mse)).alias("f"), F.col("df").alias("df1"), F.col("df_error").alias("df2"))
    if with_p:
        got = got.withColumn("p", kernels.f_survival("f", "df1", "df2"))
    got = got.drop("df1", "df2")
    if total:
        rest = [F.lit(None).cast("double").alias(c) for c in got.columns if c not in (*by, "term", "pev")]
        got = got.unionByName(got.groupBy(*by).agg(F.sum("pev").alias("pev")).select(*by, F.lit("total").alias("term"), "pev", *rest))
    return got


def regress(df: DataFrame, value: str, terms: dict[str, list[str]], by: list[str], omega: bool = True, partial: bool = False, as_pct: bool = True) -> DataFrame:
    """(by..., term, pev, f, p): explained variance of each term of a linear model with a constant.

    One aggregate gathers the sums of products of all columns, whose number is the model's, and each series' small
    normal equations, full and without each term, are solved from them."""
    cols = [c for term in terms.values() for c in term]
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in cols), F.col(value).cast("double")]
    k = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]
    ok = F.col(value).isNotNull()
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    got = df.where(ok).groupBy(*by).agg(*sums)

    def solve(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                m = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        m[i, j] = m[j, i] = row[f"s{i}_{j}"]
                for name, pev, f, p in kernels.term_variance(m, [len(t) for t in terms.values()], list(terms), omega, partial):
                    out.append((*(row[c] for c in by), name, pev * (100.0 if as_pct else 1.0), f, p))
            yield pd.DataFrame(out, columns=[*by, "term", "pev", "f", "p"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "term string, pev double, f double, p double"])
    return got.mapInPandas(solve, schema)


def pev(df: DataFrame, value: str, labels: list[str], by: list[str], model: str | None = None, **options) -> DataFrame:
    """anova1 for one label column, anova2 for two, or the model named."""
    model = model or ("anova1" if len(labels) == 1 else "anova2")
    if model == "anova1":
        return anova1(df, value, labels[0], by, **options)
    if model == "anova2":
        return anova2(df, value, *labels[:2], by, interact=len(labels) > 2 or options.pop("interact", True), **options)
    if model == "regress":
        return regress(df, value, {c: [c] for c in labels}, by, **options)
    raise ValueError(f"unknown model {model!r}")


percent_explained_variance = pev


def folds(df: DataFrame, obs: str, label: str, by: list[str], k: int = 5, seed: str = "0", out: str = "fold") -> DataFrame:
    """df with a fold for each observation: within series and label, observations in order of a hash are dealt round."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(obs).cast("string")).cast("binary"))
    # Ranks in buckets of the hash, each behind the counts of those before it: a label isn't one task.
    keys = [*by, label, "__bucket"]
    d = df.withColumn("__order", order).withColumn("__bucket", F.substring("__order", 1, 3))
    before = F.sum("count").over(Window.partitionBy(*by, label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = d.groupBy(*keys).count().select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__order", obs)) + F.col("__before")
    return d.join(starts, _same(keys)).withColumn(out, F.pmod(rank, F.lit(k)).cast("int")).select(*df.columns, out)


def _same(keys: list[str]) -> Column:
    """Whether keys equal the columns __k0, __k1, ..., nulls too."""
    ok = F.lit(True)
    for i, c in enumerate(keys):
        ok = ok & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return ok


def _fans(df: DataFrame) -> tuple[int, ...]:
    """Into how many parts what tasks hand on is merged at first, and then; few tasks' parts are merged at once."""
    return (64, 1) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) > 64 else (1,)


def _lda_counts(f: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by..., right, n) for f (by..., __y, __x, fold). Counts, means and cross-products of each fold and label are
    merged, the discriminant of each fold is solved from them, and rows are scored where they lie."""
    kind, head = f.schema["__y"].dataType.simpleString(), "".join(f"`{c}` {f.schema[c].dataType.simpleString()}, " for c in by)
    keys, cols = [*by, "fold", "__y"], [*by, "fold", "__y", "part", "n", "mean", "cross"]
    sums = f"{head}fold int, __y {kind}, part int, n long, mean array<double>, cross array<double>"

    def gather(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for frame in frames:
            rows = []
            for key, g in frame.groupby(keys, dropna=False, sort=False):
                x = np.stack(g["__x"].to_numpy()).astype(float)
                rest = x - x.mean(0)
                rows.append((*key, part, len(x), x.mean(0), (rest.T @ rest).ravel()))
            yield pd.DataFrame(rows, columns=cols)

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, mean, cross = 0, 0.0, 0.0
        for m, x, c in frame.sort_values(["part", "n"])[["n", "mean", "cross"]].itertuples(index=False):
            off = np.asarray(x) - mean
            cross = cross + np.asarray(c) + np.outer(off, off).ravel() * (n * m / (n + m))
            mean, n = mean + off * (m / (n + m)), n + m
        return pd.DataFrame([(*key, n, mean, cross)], columns=cols)

    each = f.mapInPandas(gather, sums)
    for fan in _fans(f):
        each = each.groupBy(*keys, F.pmod("part", F.lit(fan)).alias("__fan")).applyInPandas(merge, sums)

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for fold in range(k):
            train = frame[frame["fold"] != fold]
            labels, means, cross = np.unique(train["__y"].to_numpy()), [], 0.0
            for g in labels:
                own = train[train["__y"] == g]
                n, x = own["n"].to_numpy(float), np.stack(own["mean"].to_numpy())
                mean = n @ x / n.sum()
                means.append(mean)
                cross = cross + np.sum(np.stack(own["cross"].to_numpy()), axis=0).reshape(len(mean), -1) + ((x - mean) * n[:, None]).T @ (x - mean)
            if len(labels):
                weights, offsets = kernels.lda_weights(np.stack(means), cross, int(train["n"].sum()))
                rows.append((*key, fold, labels.tolist(), weights.ravel(), offsets))
        return pd.DataFrame(rows, columns=[*models, "labels", "weights", "offsets"])

    models = [f"__k{i}" for i in range(len(by) + 1)]
    fits = "".join(f"{m} {f.schema[c].dataType.simpleString()}, " for m, c in zip(models, by)) + f"{models[-1]} int, labels array<{kind}>, weights array<double>, offsets array<double>"
    solved = each.groupBy(*by).applyInPandas(solve, fits)
    joined = f.join(solved if by else F.broadcast(solved), _same([*by, "fold"]), "left")  # without series: k rows

    def score(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, g in frame.groupby([*by, "fold"], dropna=False, sort=False):
                r, right = g.iloc[0], 0
                if r["labels"] is not None:
                    offsets = np.asarray(r["offsets"])
                    x = np.stack(g["__x"].to_numpy()).astype(float)
                    best = np.argmax(x @ np.asarray(r["weights"]).reshape(-1, len(offsets)) - offsets, axis=1)
                    right = int((np.asarray(r["labels"])[best] == g["__y"].to_numpy()).sum())
                rows.append((*key[:-1], right, len(g)))
            yield pd.DataFrame(rows, columns=[*by, "right", "n"])

    return joined.select(*f.columns, "labels", "weights", "offsets").mapInPandas(score, f"{head}right long, n long")


#: Losses of a margin m: (loss, first derivative, second derivative) in a stage, the weight of the squared weights, and
#: the number of stages. The hinge's corner is a parabola that gets narrower from stage to stage.
def _logistic_loss(m: np.ndarray, stage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
    return np.logaddexp(0.0, -m), -p, p * (1 - p)


def _hinge_loss(m: np.ndarray, stage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = _CORNERS[stage]
    near, under = np.abs(1 - m) < h, m <= 1 - h
    off = 1 + h - m
    return np.where(under, 1 - m, np.where(near, off * off / (4 * h), 0.0)), np.where(under, -1.0, np.where(near, -off / (2 * h), 0.0)), np.where(near, 1 / (2 * h), 0.0)


_CORNERS = (0.5, 0.15, 0.05, 0.02)
_LOSSES = {"logistic": (_logistic_loss, 1e-6, 1), "svm": (_hinge_loss, 1.0, len(_CORNERS))}


class _Newton:
    """Damped Newton steps to one minimum: of a weight times half the squared weights, plus the losses of all rows."""

    def __init__(self, dims: int, state: list[float] | None = None):
        self.d = dims
        zero = [0.0] * dims
        # The last point taken, the step tried from it, its objective, the stage, whether it is found, and steps tried.
        self.state = np.array([*zero, *zero, np.inf, 0.0, 0.0, 0.0] if state is None else state, float)

    @property
    def w(self) -> np.ndarray:
        return self.state[: self.d] + self.state[self.d : 2 * self.d]

    @property
    def stage(self) -> int:
        return int(self.state[-3])

    @property
    def found(self) -> bool:
        return bool(self.state[-2])

    def tell(self, sums: np.ndarray, ridge: float, stages: int, most: int = 200) -> None:
        """What the rows add up to at w: the loss, its gradient and its second derivatives."""
        d, w = self.d, self.w
        step = self.state[d : 2 * d].copy()
        value = sums[0] + 0.5 * ridge * w @ w
        least = 1e-7 if self.stage + 1 == stages else 1e-2
        self.state[-1] += 1
        if value <= self.state[2 * d] + 1e-12 * abs(value):
            gradient, second = sums[1 : 1 + d] + ridge * w, sums[1 + d :].reshape(d, d) + ridge * np.eye(d)
            new = -np.linalg.lstsq(second, gradient, rcond=None)[0]
            small = np.abs(new).max() < least * (1 + np.abs(w).max())
            self.state[:d], self.state[d : 2 * d], self.state[2 * d] = w, 0.0 if small else new, value
        else:
            self.state[d : 2 * d] = step / 2
            small = np.abs(step).max() < least * (1 + np.abs(w).max())
            if small:
                self.state[d : 2 * d] = 0.0
        if small or self.state[-1] >= most:
            if self.stage + 1 < stages and self.state[-1] < most:
                self.state[2 * d], self.state[-3] = np.inf, self.stage + 1
            else:
                self.state[-2] = 1.0


def _newton_sums(x: np.ndarray, sign: np.ndarray, w: np.ndarray, stage: int, kind: str) -> np.ndarray:
    loss, first, second = _LOSSES[kind][0](sign * (x @ w), stage)
    return np.concatenate([[loss.sum()], (first * sign) @ x, ((x * second[:, None]).T @ x).ravel()])


def _with_one(g: pd.DataFrame) -> np.ndarray:
    x = np.stack(g["__x"].to_numpy()).astype(float)
    return np.c_[np.ones(len(x)), x]


def trained(f: DataFrame, by: list[str], k: int, kind: str, rounds: int = 250) -> DataFrame:
    """(by..., labels, dims, used, states): the weights of each fold and label against the rest, for f (by..., __y, __x,
    fold), by rows outside the fold. used and states have an entry for each fold and label; of two labels only the
    greater has weights.

    A round is one Spark job: tasks add up losses, gradients and second derivatives of all folds where rows lie, partial
    sums are merged, and each series' minima take a step. Rows are read where they are and never gathered; what is
    joined to them is a row of weights for each series."""
    loss, ridge, stages = _LOSSES[kind]
    y, heads = f.schema["__y"].dataType.simpleString(), [(c, f.schema[c].dataType.simpleString()) for c in by]
    head = "".join(f"`{c}` {t}, " for c, t in heads)
    models = f"{head}labels array<{y}>, dims int, used array<int>, states array<array<double>>"
    names = [*by, "labels", "dims", "used", "states"]

    def begin(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                labels = sorted({c["label"] for c in r["counts"]})
                n = np.zeros((k, len(labels)), int)
                for c in r["counts"]:
                    n[c["fold"], labels.index(c["label"])] += c["n"]
                used = (n.sum(0) - n > 0).astype(int)  # seen outside the fold
                states = [_Newton(r["dims"]).state if u and (used[t].sum() > 2 or used[t].sum() == 2 and not used[t][g + 1 :].any()) else [] for t in range(k) for g, u in enumerate(used[t])]
                rows.append((*(r[c] for c in by), labels, r["dims"], used.ravel(), states))
            yield pd.DataFrame(rows, columns=names)

    each = f.groupBy(*by, "fold", "__y").agg(F.count("*").alias("n"), F.max(F.size("__x") + 1).alias("d"))
    state = written(each.groupBy(*by).agg(F.collect_list(F.struct("fold", F.col("__y").alias("label"), "n")).alias("counts"), F.max("d").alias("dims")).mapInPandas(begin, models))
    sums = f"{head}problem int, part int, v array<double>"

    def gather(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), {}

        def give() -> pd.DataFrame:
            rows = [(*key, problem, part, v) for (key, problem), v in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=[*by, "problem", "part", "v"])

        for frame in frames:
            for key, g in frame.groupby(by, dropna=False, sort=False) if by else (((), frame),):
                r, x = g.iloc[0], _with_one(g)
                labels, folds_of = np.asarray(r["labels"]), g["fold"].to_numpy()
                code, key = np.searchsorted(labels, g["__y"].to_numpy()), tuple(None if pd.isna(v) else v for v in key)
                for problem, s in enumerate(r["states"]):
                    if len(s) and not (m := _Newton(int(r["dims"]), s)).found:
                        train = folds_of != problem // len(labels)
                        v = _newton_sums(x[train], np.where(code[train] == problem % len(labels), 1.0, -1.0), m.w, m.stage, kind)
                        held[key, problem] = held.get((key, problem), 0.0) + v
            if len(held) > 1000:
                yield give()
        yield give()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.sort_values("part").iloc[:1].copy()
        out["v"] = [np.sum(np.stack(frame.sort_values("part")["v"].to_numpy()), axis=0)]
        return out

    def step(told: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        new, r = [list(s) for s in state["states"].iloc[0]], state.iloc[0]
        for problem, v in zip(told["problem"], told["v"]):
            m = _Newton(int(r["dims"]), new[problem])
            m.tell(np.asarray(v), ridge, stages)
            new[problem] = m.state.tolist()
        return state.assign(states=[new])[names]

    open_ = F.exists("states", lambda s: (F.size(s) > 0) & (F.element_at(s, -2) == 0))
    for _ in range(rounds):
        if state.where(open_).isEmpty():
            break
        told = _beside(f, state.where(open_), by, "inner").mapInPandas(gather, sums)
        for fan in _fans(f):
            told = told.groupBy(*by, "problem", F.pmod("part", F.lit(fan)).alias("__fan")).applyInPandas(merge, sums)
        # A row for each fold and label meets its series' row.
        a, b = (x.withColumn("__all", F.lit(0)).groupBy(*by, "__all") for x in (told, state))
        state = written(a.cogroup(b).applyInPandas(step, models))
    return state


def _beside(f: DataFrame, state: DataFrame, by: list[str], how: str) -> DataFrame:
    """f's rows with the labels and states of their series."""
    s = state.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "labels", "dims", "used", "states")
    joined = f.join(s if by else F.broadcast(s), _same(by), how)  # without series: one row
    return joined.drop(*(f"__k{i}" for i in range(len(by))))


def _trained_counts(f: DataFrame, by: list[str], k: int, kind: str) -> DataFrame:
    """(by..., right, n): rows scored where they lie."""
    f = checkpointed(f.withColumn("__x", F.col("__x").cast("array<double>")))
    head = "".join(f"`{c}` {f.schema[c].dataType.simpleString()}, " for c in by)

    def score(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, g in frame.groupby([*by, "fold"], dropna=False, sort=False):
                r, x = g.iloc[0], _with_one(g)
                labels, fold, dims = np.asarray(r["labels"]), int(r["fold"]), int(r["dims"])
                own = range(fold * len(labels), (fold + 1) * len(labels))
                known, scores = [p for p in own if r["used"][p]], {p: x @ _Newton(dims, r["states"][p]).w for p in own if len(r["states"][p])}
                if len(known) > 2:
                    best = np.array(known)[np.argmax([scores[p] for p in known], axis=0)]
                elif len(known) == 2:
                    best = np.where(scores[known[1]] > 0, known[1], known[0])
                else:
                    best = np.full(len(x), known[0] if known else -1)
                right = int((labels[best - own[0]] == g["__y"].to_numpy())[best >= own[0]].sum())
                rows.append((*key[:-1], right, len(g)))
            yield pd.DataFrame(rows, columns=[*by, "right", "n"])

    return _beside(f, trained(f, by, k, kind), by, "left").mapInPandas(score, f"{head}right long, n long")


def decode(df: DataFrame, features: str, label: str, obs: str, by: list[str], decoder: str | Callable = "lda", k: int = 5, seed: str = "0", as_pct: bool = False, fold: str | None = None) -> DataFrame:
    """(by..., accuracy, n): share of held-out observations whose label is predicted, over k stratified folds, or over
    those that a column `fold` gives, numbered from 0: a splitter of one's own, such as one that leaves a group out.

    features is an array column. decoder: lda, which is solved from sums of any number of observations; logistic or svm
    (a linear one, whose hinge has a corner of 0.02), trained by rounds of such sums; or a function of (train x, train
    y, test x) to predictions, for which fold and series are one task each, which gets all observations of the series."""
    known = df.where(F.col(label).isNotNull())
    if fold is None:
        f = folds(known, obs, label, by, k, seed)
    else:
        f, k = known.withColumn("fold", F.col(fold).cast("int")), (known.agg(F.max(fold)).first()[0] or 0) + 1
    f = f.select(*by, F.col(label).alias("__y"), F.col(features).alias("__x"), "fold")
    if decoder == "lda" or decoder in _LOSSES:
        s = (_lda_counts(f, by, k) if decoder == "lda" else _trained_counts(f, by, k, decoder)).groupBy(*by).agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
        return s.select(*by, (div("right", "n") * (100.0 if as_pct else 1.0)).alias("accuracy"), "n")
    if not callable(decoder):
        raise ValueError(f"unknown decoder {decoder!r}: lda, logistic, svm or a function")
    fit = decoder
    each = f.withColumn("__test", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(frame["__x"].to_numpy()).astype(float), frame["__y"].to_numpy()
        test = (frame["fold"] == frame["__test"]).to_numpy()
        right = int((fit(x[~test], y[~test], x[test]) == y[test]).sum()) if test.any() and (~test).any() else 0
        return pd.DataFrame([(*(frame[c].iloc[0] for c in by), right, int(test.sum()))], columns=[*by, "right", "n"])

    keys = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "right long, n long"])
    s = each.groupBy(*by, "__test").applyInPandas(run, keys).groupBy(*by).agg(F.sum("right").alias("right"), F.sum("n").alias("n"))
    return s.select(*by, (div("right", "n") * (100.0 if as_pct else 1.0)).alias("accuracy"), "n")


METHODS = {"pev": pev, "dprime": dprime, "d": dprime, "cohensd": dprime, "auroc": auroc, "roc": auroc, "aucroc": auroc, "auc": auroc, "mutual_information": mutual_info, "mutual_info": mutual_info, "decode": decode, "decoder": decode, "decoding": decode}


def information(df: DataFrame, method: str = "pev", **options) -> DataFrame:
    """One of METHODS by name."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: one of {sorted(METHODS)}")
    return METHODS[method](df, **options)


def information_of_groups(*groups: DataFrame, method: str = "pev", label: str = "label", **options) -> DataFrame:
    """information over the groups' rows, labelled 0, 1, ..."""
    return information(stats.groups_to_labels(*groups, label=label), method, **({"labels": [label]} if method == "pev" else {"label": label}), **({"groups": (0, 1)} if METHODS[method] in (dprime, auroc) else {}), **options)


__all__ = ["anova1", "anova2", "auroc", "decode", "digitize", "dprime", "entropy", "fd_bins", "folds", "information", "information_of_groups", "mutual_info", "pev", "regress"]
