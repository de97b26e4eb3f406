"""Hypothesis tests and effect sizes: moments and ranks in Spark, tails of distributions on the driver."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d or 1e-300), 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def t_quantile(share: float, df: float) -> float:
    """The t that a two-sided share of 1 - ``share`` lies beyond."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - share else (low, mid)
    return low


def signed_rank_p(w: float, n: int, ties: float, zeros: int) -> float:
    """Wilcoxon's two-sided p of the smaller rank sum: exact up to 50 differences without ties or zeros, else normal."""
    if n == 0:
        return float("nan")
    if n <= 50 and not ties and not zeros:
        ways = [1]
        for r in range(1, n + 1):
            ways = [(ways[k] if k < len(ways) else 0) + (ways[k - r] if 0 <= k - r < len(ways) else 0) for k in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return normal_two_sided((w - n * (n + 1) / 4) / spread)


def rank_sum_p(u: float, a: int, b: int, ties: float) -> float:
    """Mann and Whitney's two-sided p: exact where a group has 8 values at most and none are tied, else normal, less a half."""
    if not a or not b:
        return float("nan")
    top = max(u, a * b - u)
    if min(a, b) <= 8 and not ties:
        ways = [[1] + [0] * (a * b) if not i else [0] * (a * b + 1) for i in range(a + 1)]
        for v in range(1, a + b + 1):  # rank v goes to the first group, or not
            for i in range(min(v, a), 0, -1):
                for k in range(a * b, v - i - 1, -1):
                    ways[i][k] += ways[i - 1][k - (v - i)]
        return min(1.0, 2 * sum(ways[a][math.ceil(top) :]) / math.comb(a + b, a))
    n = a + b
    spread = math.sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1))))
    return normal_two_sided(max(0.0, top - a * b / 2 - 0.5) / spread) if spread else 1.0


def tail(function, *columns: Column | str) -> Column:
    """A tail of a distribution for each row of a table of test statistics: one row a test, not a row a datum."""

    @F.pandas_udf("double")
    def each(*values: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if any(v is None or v != v for v in row) else function(*row) for row in zip(*values, strict=True)], dtype="float64")

    return F.nanvl(each(*columns), F.lit(None).cast("double"))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact binomial under 25 discordant pairs, else chi-squared with Yates' correction."""
    n = only_a + only_b
    if n == 0:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(only_a, only_b) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(only_a - only_b) - 1) ** 2 / n / 2))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(both, only_a, only_b, neither) for two columns of 'was right'."""
    x, y = F.col(a), F.col(b)
    return rows.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar_test(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The four counts with n, discordant, exact, statistic, p, odds_ratio (b over a) and both accuracies.

    Under 25 discordant pairs the statistic is the smaller count, else chi-squared with Yates' correction. The odds ratio is
    null where there are no discordant pairs, and infinite where only b is right.
    """
    out = mcnemar(rows, a, b)
    x, y = F.col("only_a"), F.col("only_b")
    n, k = F.col("both") + F.col("neither") + x + y, x + y
    out = out.withColumn("n", n).withColumn("discordant", k).withColumn("exact", k < 25)
    out = out.withColumn("statistic", F.when(k < 25, F.least(x, y).cast("double")).otherwise(F.pow(F.abs(x - y) - 1, 2) / k))
    out = out.withColumn("p", tail(lambda i, j: mcnemar_p(int(i), int(j)), "only_a", "only_b"))
    out = out.withColumn("odds_ratio", F.when(x > 0, y / x).when(y > 0, F.lit(float("inf"))))
    return out.withColumn("accuracy_a", (F.col("both") + x) / n).withColumn("accuracy_b", (F.col("both") + y) / n)


def _signed_ranks(d: DataFrame) -> DataFrame:
    """(w_plus, w_minus, differing, ties) over the differences d that aren't 0; ranks are running counts by ranges."""
    by = d.filter("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("up"))
    by = running(by, ["m"], {"below": F.col("c")}).withColumn("rank", F.col("below") + (F.col("c") + 1) / 2.0)
    ties = F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c"))
    return by.agg(F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("w_minus"), F.coalesce(F.sum("c"), F.lit(0)).alias("differing"), F.coalesce(ties, F.lit(0.0)).alias("ties"))


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, mean difference, d_z and t of paired columns; Wilcoxon's sums of positive and negative average ranks."""
    return paired_test(rows, a, b).select("n", "mean", "d_z", "t", "w_plus", "w_minus")


def paired_test(rows: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """n, mean, sd, d_z, t, df, p_t, low, high, w_plus, w_minus, differing, p_wilcoxon of the differences b - a.

    The interval is the mean's by the t distribution. Pairs with a null are left out.
    """
    d = rows.select((F.col(b) - F.col(a)).alias("d")).filter("d is not null")
    sd = F.stddev_samp("d")
    moments = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), sd.alias("sd"), F.coalesce(F.try_divide(F.avg("d"), sd), F.lit(0.0)).alias("d_z"), F.try_divide(F.avg("d") * F.sqrt(F.count("d")), sd).alias("t"))
    out = moments.crossJoin(F.broadcast(_signed_ranks(d))).withColumn("df", F.col("n") - 1)  # one row each
    half = tail(lambda n, sd: t_quantile(level, n - 1) * sd / math.sqrt(n) if n > 1 else float("nan"), "n", "sd")
    out = out.withColumn("p_t", tail(t_two_sided, "t", "df")).withColumn("_half", half).withColumn("low", F.col("mean") - F.col("_half")).withColumn("high", F.col("mean") + F.col("_half"))
    p = tail(lambda w, n, ties, zeros: signed_rank_p(w, int(n), ties, int(zeros)), F.least("w_plus", "w_minus"), "differing", "ties", F.col("n") - F.col("differing"))
    return out.withColumn("p_wilcoxon", p).drop("_half", "ties")


def independent(rows: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Welch's t and degrees of freedom, Hedges' g, Mann-Whitney's U and the rank-biserial correlation of two groups."""
    return independent_test(rows, group, value, first, second).select("n1", "n2", "t", "df", "hedges_g", "u", "rank_biserial")


def independent_test(rows: DataFrame, group: str, value: str, first, second, level: float = 0.95) -> DataFrame:
    """n1, n2, mean1, mean2, t, df, p_welch, low, high, hedges_g, u, p_mann_whitney, rank_biserial of two groups.

    The interval is that of mean1 - mean2 by Welch's degrees of freedom. Null values are left out.
    """
    r = rows.filter(F.col(group).isin(first, second) & F.col(value).isNotNull()).select((F.col(group) == first).alias("one"), F.col(value).alias("v"))
    by = r.groupBy("v").agg(F.count_if("one").alias("a"), F.count_if(~F.col("one")).alias("b"))
    by = running(by, ["v"], {"less": F.col("b")})
    c = (F.col("a") + F.col("b")).cast("double")
    u = by.agg(F.sum(F.col("a") * (F.col("less") + F.col("b") / 2.0)).alias("u"), F.coalesce(F.sum(c * c * c - c), F.lit(0.0)).alias("ties"))
    pick = lambda one, f: f(F.when(F.col("one") if one else ~F.col("one"), F.col("v")))
    m = r.agg(*[pick(o, f).alias(f"{n}{s}") for o, s in ((True, 1), (False, 2)) for n, f in (("n", F.count), ("mean", F.avg), ("v", F.var_samp))])
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    out = m.crossJoin(F.broadcast(u)).select(
        "n1", "n2", "mean1", "mean2", ((F.col("mean1") - F.col("mean2")) / F.sqrt(q1 + q2)).alias("t"), (F.pow(q1 + q2, 2) / (q1 * q1 / (F.col("n1") - 1) + q2 * q2 / (F.col("n2") - 1))).alias("df"), F.sqrt(q1 + q2).alias("se"),
        ((F.col("mean1") - F.col("mean2")) / pooled * (1 - 3.0 / (4 * (F.col("n1") + F.col("n2")) - 9))).alias("hedges_g"), "u", "ties", (2 * F.col("u") / (F.col("n1") * F.col("n2")) - 1).alias("rank_biserial"),
    )
    half = tail(lambda df, se: t_quantile(level, df) * se, "df", "se")
    out = out.withColumn("p_welch", tail(t_two_sided, "t", "df")).withColumn("_half", half).withColumn("low", F.col("mean1") - F.col("mean2") - F.col("_half")).withColumn("high", F.col("mean1") - F.col("mean2") + F.col("_half"))
    return out.withColumn("p_mann_whitney", tail(lambda u, a, b, ties: rank_sum_p(u, int(a), int(b), ties), "u", "n1", "n2", "ties")).drop("_half", "se", "ties")


def power_two_sample(d: float, n: int, alpha: float = 0.05, steps: int = 4000) -> float:
    """Power of a two-sided two-sample t test with ``n`` in each arm, by integrating the noncentral t's upper tail."""
    df, delta = 2 * n - 2, d * math.sqrt(n / 2)
    low, high = 0.0, 200.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    crit, total, width = low, 0.0, 0.0
    # T > crit where Z + delta > crit * sqrt(V / df): over the density of s = sqrt(V / df)
    log_c = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2)
    top = 1 + 10 / math.sqrt(df)
    width = top / steps
    for i in range(steps):
        s = (i + 0.5) * width
        total += math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * 0.5 * math.erfc((crit * s - delta) / math.sqrt(2)) * width
    return total


def minimum_detectable(n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if power_two_sample(mid, n, alpha) < power else (low, mid)
    return low
