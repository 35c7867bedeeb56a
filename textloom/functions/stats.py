"""Descriptive statistics, evaluation metrics and hypothesis tests.

Aggregates are column expressions; statistics that reduce a corpus to a few cells end in plain functions on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LOWER, UPPER = "lower", "upper"


def mean(c: str | Column) -> Column:
    """0 over no rows."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def harmonic_mean(c: str) -> Column:
    return F.count(c) / F.sum(1 / F.col(c))


def variance(c: str, sample: bool = False) -> Column:
    """0 for a single value."""
    return F.coalesce((F.var_samp if sample else F.var_pop)(c), F.lit(0.0))


def deviation(c: str, sample: bool = False) -> Column:
    return F.sqrt(variance(c, sample))


def skewness(c: str) -> Column:
    return F.coalesce(F.skewness(c), F.lit(0.0))


def kurtosis(c: str) -> Column:
    """Excess kurtosis."""
    return F.coalesce(F.kurtosis(c), F.lit(0.0))


def moment(df: DataFrame, c: str, n: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """n-th central moment, for each group; two aggregations, so that nothing is gathered."""
    means = df.groupBy(*by).agg(F.avg(c).alias("_mean"))
    joined = df.join(means, list(by)) if by else df.crossJoin(F.broadcast(means))  # without groups the means are one row
    return joined.groupBy(*by).agg(F.avg(F.pow(F.col(c) - F.col("_mean"), n)).alias("moment"))


def quantile(values: Column, p: float = 0.5, a: float = 1, b: float = -1, c: float = 0, d: float = 1) -> Column:
    """Quantile of a sorted array: index a + (n + b) p - 1 = i + f; the value is s[i] + (s[i + 1] - s[i]) (c + d f)."""
    n = F.size(values)
    x = F.lit(a) + (n + F.lit(b)) * p - 1
    i = F.floor(x).cast("int")
    clip = lambda k: F.greatest(F.lit(0), F.least(k, n - 1))
    low, high = F.get(values, clip(i)), F.get(values, clip(i + 1))
    return low + (high - low) * (F.lit(c) + F.lit(d) * (x - i))


def boxplot(c: str) -> list[Column]:
    """Five numbers with linear quartiles."""
    return [F.min(c).alias("least"), *(F.percentile(c, p).alias(name) for p, name in ((0.25, "q1"), (0.5, "middle"), (0.75, "q3"))), F.max(c).alias("most")]


def histogram(df: DataFrame, c: str, k: int = 10, interval: tuple[float, float] | None = None) -> DataFrame:
    """(bin, start, stop, n) over k equal bins of [least, most + 1e-6]; empty bins are left out."""
    if interval is None:
        interval = df.agg(F.min(c), F.max(c)).first()
        interval = (interval[0], interval[1])
    low, high = float(interval[0]), float(interval[1]) + 1e-6
    width = (high - low) / k
    b = F.floor((F.col(c) - low) / width)
    return df.select(b.alias("bin")).where(F.col("bin").between(0, k - 1)).groupBy("bin").agg(F.count("*").alias("n")).select("bin", (F.col("bin") * width + low).alias("start"), ((F.col("bin") + 1) * width + low).alias("stop"), "n")


def moving_average(c: str, order: str, k: int = 10, by: Sequence[str] = ()) -> Column:
    """Centred window of 2k + 1 rows, cut off at the ends."""
    return F.avg(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-k, k))


def cumulative(c: str, order: str, by: Sequence[str] = ()) -> Column:
    return F.sum(c).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def frequencies(df: DataFrame, c: str, relative: bool = False) -> DataFrame:
    """(value, n) or (value, share), by count."""
    counts = df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    if relative:
        total = df.agg(F.count("*").alias("total"))
        return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("share"))  # one row
    return counts


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """tp, tn, fp, fn of two booleans."""
    return [F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & ~predicted).alias("tn"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn")]


def rates(df: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds accuracy, precision, recall, f and specificity to tp, tn, fp, fn; a zero denominator counts as 1."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    guard = lambda x: F.when(x == 0, 1).otherwise(x)
    p, r = tp / guard(tp + fp), tp / guard(tp + fn)
    b = beta * beta
    return df.select("*", ((tp + tn) / guard(tp + tn + fp + fn)).alias("accuracy"), p.alias("precision"), r.alias("recall"), ((1 + b) * p * r / guard(b * p + r)).alias("f"), (tn / guard(tn + fp)).alias("specificity"))


def macro(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One-against-all accuracy, precision and recall averaged over the classes of ``truth``; F is that of the averages."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    total = pairs.agg(F.sum("count").alias("all"))
    by_t, by_p = pairs.groupBy("t").agg(F.sum("count").alias("nt")), pairs.groupBy(F.col("p").alias("t")).agg(F.sum("count").alias("np"))
    hit = pairs.where("t = p").select("t", F.col("count").alias("tp"))
    each = by_t.join(by_p, "t", "left").join(hit, "t", "left").fillna(0, ["np", "tp"]).crossJoin(F.broadcast(total))  # one row
    each = each.select((1 - (F.col("nt") + F.col("np") - 2 * F.col("tp")) / F.col("all")).alias("a"), (F.col("tp") / F.greatest("np", F.lit(1))).alias("p"), (F.col("tp") / F.greatest("nt", F.lit(1))).alias("r"))
    out = each.agg(F.avg("a").alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"))
    s = F.col("precision") + F.col("recall")
    return out.withColumn("f", 2 * F.col("precision") * F.col("recall") / F.when(s == 0, 1).otherwise(s))


def roc(df: DataFrame) -> DataFrame:
    """Points (x, y) of (tp, tn, fp, fn) rows, with both corners."""
    guard = lambda x: F.when(x == 0, 1).otherwise(x)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    points = df.select((fp / guard(fp + tn)).alias("x"), (tp / guard(tp + fn)).alias("y"))
    return points.unionAll(df.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double"))


def auc(points: DataFrame) -> DataFrame:
    """Trapezoidal area under sorted points."""
    w = Window.orderBy("x", "y")
    step = points.select("x", "y", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"))
    return step.agg(F.coalesce(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2), F.lit(0.0)).alias("auc"))


def scored_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve of scores, by ranks (ties halved): the sum of ranks needs one pass over distinct scores."""
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    w = Window.partitionBy(*by).orderBy("_s")
    below = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counts.select(*by, "p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("area"))
    return each.groupBy(*by).agg((F.sum("area") / F.greatest(F.sum("p") * F.sum("n"), F.lit(1))).alias("auc"))


def fleiss_kappa(votes: Sequence[Sequence[int]]) -> float:
    """Agreement of raters; a row a task, with the votes for each category."""
    n = sum(votes[0])
    if any(sum(r) != n for r in votes):
        raise ValueError("each task needs the same number of votes")
    if n == 1:
        return 1.0
    tasks = len(votes)
    share = [sum(r[j] for r in votes) / (tasks * n) for j in range(len(votes[0]))]
    agreed = sum((sum(v * v for v in r) - n) / (n * (n - 1)) for r in votes) / tasks
    chance = sum(p * p for p in share)
    return (agreed - chance) / ((1 - chance) or 1)


def fleiss_kappa_of(df: DataFrame, task: str, category: str) -> DataFrame:
    """kappa of a long table of votes (task, category), one row a vote."""
    cells = df.groupBy(F.col(task).alias("t"), F.col(category).alias("c")).count()
    per_task = cells.groupBy("t").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("s"))
    agreed = per_task.agg(F.avg((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("agreed"), F.sum("n").alias("votes"))
    chance = cells.groupBy("c").agg(F.sum("count").alias("n")).crossJoin(F.broadcast(agreed)).agg(F.first("agreed").alias("agreed"), F.sum(F.pow(F.col("n") / F.col("votes"), 2)).alias("chance"))  # one row
    return chance.select(((F.col("agreed") - F.col("chance")) / F.when(F.col("chance") == 1, 1).otherwise(1 - F.col("chance"))).alias("kappa"))


# special functions


def gammaln(x: float) -> float:
    return math.lgamma(x)


def gammai(a: float, x: float, tail: str = UPPER) -> float:
    """Regularised incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0 if tail == UPPER else 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        low = front * total
        return 1 - low if tail == UPPER else low
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    high = front * h
    return high if tail == UPPER else 1 - high


def chi2p(x2: float, df: int = 1, tail: str = UPPER) -> float:
    return gammai(df / 2, x2 / 2, tail)


def normal_cdf(x: float, mean: float = 0.0, stdev: float = 1.0) -> float:
    return 0.5 * math.erfc(-(x - mean) / (stdev * math.sqrt(2)))


def normal_pdf(x: float, mean: float = 0.0, stdev: float = 1.0) -> float:
    return math.exp(-((x - mean) ** 2) / (2 * stdev * stdev)) / (stdev * math.sqrt(2 * math.pi))


def kolmogorov(x: float) -> float:
    """P of the Kolmogorov distribution's upper tail."""
    if x <= 0:
        return 1.0
    if x < 1.18:  # the two series agree; this one is quick for small x
        return 1 - math.sqrt(2 * math.pi) / x * sum(math.exp(-((2 * j - 1) ** 2) * math.pi**2 / (8 * x * x)) for j in range(1, 20))
    return max(0.0, min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101))))


def expected(observed: Sequence[Sequence[float]]) -> list[list[float]]:
    """Expectations from margins; a single row is expected to be even."""
    if len(observed) == 1:
        row = observed[0]
        return [[sum(row) / len(row)] * len(row)]
    rows, total = [sum(r) for r in observed], sum(map(sum, observed)) or 1
    columns = [sum(r[j] for r in observed) for j in range(len(observed[0]))]
    return [[r * c / total for c in columns] for r in rows]


def _degrees(observed: Sequence[Sequence[float]]) -> int:
    return (len(observed) - 1) * (len(observed[0]) - 1) or len(observed[0]) - 1


def chi_squared(observed: Sequence[Sequence[float]], expect: Sequence[Sequence[float]] | None = None, df: int | None = None, tail: str = UPPER) -> tuple[float, float]:
    """(statistic, p). Cells with nothing observed or nothing expected are passed over."""
    expect = expect or expected(observed)
    x2 = sum((o - e) ** 2 / e for a, b in zip(observed, expect, strict=True) for o, e in zip(a, b, strict=True) if o and e)
    return x2, chi2p(x2, df or _degrees(observed), tail)


def log_likelihood_ratio(observed: Sequence[Sequence[float]], expect: Sequence[Sequence[float]] | None = None, df: int | None = None, tail: str = UPPER) -> tuple[float, float]:
    expect = expect or expected(observed)
    g = 2 * sum(o * math.log(o / e) for a, b in zip(observed, expect, strict=True) for o, e in zip(a, b, strict=True) if o and e)
    return g, chi2p(g, df or _degrees(observed), tail)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-tailed p of a 2 x 2 table: all tables with its margins that are no likelier."""
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = lambda x: choose(a + b, x) + choose(c + d, a + c - x) - choose(a + b + c + d, a + c)
    own = chance(a)
    return min(1.0, sum(math.exp(p) for x in range(max(0, a - d), min(a + b, a + c) + 1) if (p := chance(x)) <= own + 1e-9))


@F.pandas_udf(T.DoubleType())
def fisher_exact_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(*x) for x in zip(a, b, c, d, strict=True)])


def chi2p_column(x2: str, df: int | str) -> Column:
    """Upper-tail p for each row."""

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v != v else chi2p(v, int(n)) for v, n in zip(x, k, strict=True)], dtype="float64")

    return run(F.col(x2), F.lit(df) if isinstance(df, int) else F.col(df))


def kolmogorov_smirnov(df: DataFrame, value: str, sample: Column) -> DataFrame:
    """(d, n1, n2, p) of two samples, told apart by a boolean: distinct values are counted, then run over in order."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count_if(sample).alias("a"), F.count_if(~sample).alias("b"))
    total = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    d = counts.select(F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b")).crossJoin(F.broadcast(total)).agg(F.max(F.abs(F.col("a") / F.col("n1") - F.col("b") / F.col("n2"))).alias("d"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))  # one row

    @F.pandas_udf(T.DoubleType())
    def p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        e = (n1 * n2 / (n1 + n2)) ** 0.5
        return ((e + 0.12 + 0.11 / e) * d).map(kolmogorov)

    return d.withColumn("p", p("d", "n1", "n2"))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation, clamped to [a, b]."""
    return F.when(t < 0, a).when(t > 1, b).otherwise(a + (b - a) * t)


def smoothstep(a: Column, b: Column, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return t * t * (3 - 2 * t)


def ticks(low: float, high: float, n: int = 10) -> list[float]:
    """Axis ticks at a nice step (1, 2 or 5 times a power of ten), around [low, high]."""
    if high <= low:
        return [low]
    raw = (high - low) / max(1, n - 1)
    power = 10 ** math.floor(math.log10(raw))
    step = next(s * power for s in (1, 2, 5, 10) if s * power >= raw * 0.999999)
    first, last = math.floor(low / step), math.ceil(high / step)
    return [round(i * step, 12) for i in range(first, last + 1)]


def entropy(p: Sequence[float], base: float | None = None) -> float:
    """Shannon entropy of normalised weights; the base is their number, 2 at least."""
    total = sum(p)
    total = max(total, 1) if len(p) == 1 else total or 1
    base = base or max(len(p), 2)
    return -sum(x / total * math.log(x / total, base) for x in p if x)
