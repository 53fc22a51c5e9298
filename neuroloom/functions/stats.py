"""Distribution functions by vectorised UDFs on aggregated rows, and tests as SQL statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.sql import operator


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 20_000):  # about the root of a + b until it converges
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + k * d), 1 + k / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_share(df / (df + t * t), df / 2, 0.5)
    return half if t >= 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_sf(mid, df) > 1 - p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return z.map(normal_sf, na_action="ignore")


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(n) else t_sf(x, n) for x, n in zip(t, df)], dtype="float64")


def stars(p):
    """Marks of significance."""
    return F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


_TWO = "count(*) FILTER (WHERE weight > 0) AS n1, count(*) FILTER (WHERE weight < 0) AS n2, avg(CASE WHEN weight > 0 THEN confidence END) AS m1, avg(CASE WHEN weight < 0 THEN confidence END) AS m2, var_samp(CASE WHEN weight > 0 THEN confidence END) AS v1, var_samp(CASE WHEN weight < 0 THEN confidence END) AS v2"
mean_error = operator("mean_error", "SELECT session, stimulus, count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_samp(weight) / sqrt(count(*)), 6) AS sem FROM {edges} GROUP BY session, stimulus")
t_test = operator("t_test", f"WITH s AS (SELECT session, {_TWO} FROM {{edges}} GROUP BY session) SELECT session, n1 + n2 - 2 AS df, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2.0) * (1.0 / n1 + 1.0 / n2)), 0), 5) AS t FROM s")
z_test = operator("z_test", f"WITH s AS (SELECT session, {_TWO} FROM {{edges}} GROUP BY session) SELECT session, round((m1 - m2) / nullif(sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2.0) * (1.0 / n1 + 1.0 / n2)), 0), 5) AS z, round(m1 - m2, 6) AS difference FROM s")
rank_sum = operator("rank_sum", """
WITH r AS (SELECT session, weight > 0 AS plus, rank() OVER (PARTITION BY session ORDER BY confidence) + (count(*) OVER (PARTITION BY session, confidence) - 1) / 2.0 AS rk FROM {edges}),
s AS (SELECT session, count(*) FILTER (WHERE plus) AS n1, count(*) FILTER (WHERE NOT plus) AS n2, sum(CASE WHEN plus THEN rk ELSE 0 END) AS w FROM r GROUP BY session)
SELECT session, n1, n2, round((w - n1 * (n1 + n2 + 1) / 2.0) / nullif(sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 0), 5) AS z FROM s""")


def with_p_values(tests: DataFrame) -> DataFrame:
    """Adds one-sided p (greater) and stars to a table with z, or t and df."""
    p = t_p("t", F.col("df").cast("double")) if "t" in tests.columns else normal_p("z")
    return tests.withColumn("p", p).withColumn("stars", stars(F.col("p")))


def confidence_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """Mean with a two-sided t interval."""

    @F.pandas_udf(DoubleType())
    def quantile(n: pd.Series) -> pd.Series:
        return n.map(lambda k: t_quantile((1 + level) / 2, k - 1) if k > 1 else None)

    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
    g = g.withColumn("half", F.col("sem") * quantile("n"))
    return g.select(*keys, "n", "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def bootstrap_median(df: DataFrame, keys: list[str], value: str, draws: int = 10_000, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Median with a percentile interval of medians of seeded redraws."""
    import numpy as np

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[value].dropna().to_numpy(float)
        rng = np.random.default_rng(seed)
        step = max(1, 2_000_000 // max(len(x), 1))
        medians = np.concatenate([np.median(x[rng.integers(0, len(x), (min(step, draws - s), len(x)))], axis=1) for s in range(0, draws, step)]) if len(x) else np.array([np.nan])
        low, high = np.quantile(medians, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[*rows[keys].iloc[0], np.median(x) if len(x) else np.nan, low, high]], columns=[*keys, "median", "low", "high"])

    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", median double, low double, high double"
    return df.select(*keys, value).groupBy(*keys).applyInPandas(run, schema)


def normal_score(i: float, n: int) -> float:
    """About the expected value of the i-th of n ordered normal values (from 1)."""
    return NormalDist().inv_cdf((i - 0.375) / (n + 0.25))


def shapiro_from_sums(n: int, norm: float, cross: float, ends: tuple[float, float, float, float], spread: float) -> tuple[float, float]:
    """(W, p) by Royston's approximation (1995) from the sums over ranks: of squared normal scores, of scores times values, the values of
    rank 1, 2, n - 1 and n, and of squared deviations.  NaN for fewer than 3 values or equal ones; p is meant for at most 5,000.
    """
    if n < 3 or not spread:
        return math.nan, math.nan
    u = 1 / math.sqrt(n)
    poly = lambda c, at: sum(k * at**i for i, k in enumerate(c))
    one, two, near, end = ends
    m1, m2 = normal_score(n, n), normal_score(n - 1, n)
    # Royston's polynomials.
    last = m1 / math.sqrt(norm) + poly((0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), u)
    if n == 3:
        total = math.sqrt(0.5) * (end - one)
    elif n <= 5:
        phi = (norm - 2 * m1**2) / (1 - 2 * last**2)
        total = last * (end - one) + (cross - m1 * (end - one)) / math.sqrt(phi)
    else:
        second = m2 / math.sqrt(norm) + poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), u)
        phi = (norm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2)
        total = last * (end - one) + second * (near - two) + (cross - m1 * (end - one) - m2 * (near - two)) / math.sqrt(phi)
    w = min(1.0, total**2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:
        y, at = poly((-2.273, 0.459), n), n
        if y <= math.log(1 - w):
            return w, 0.0
        y, mu, sd = -math.log(y - math.log(1 - w)), poly((0.544, -0.39978, 0.025054, -0.0006714), at), math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), at))
    else:
        at = math.log(n)
        y, mu, sd = math.log(1 - w), poly((-1.5861, -0.31082, -0.083751, 0.0038915), at), math.exp(poly((-0.4803, -0.082676, 0.0030302), at))
    return w, normal_sf((y - mu) / sd)


def shapiro_wilk(x) -> tuple[float, float]:
    """(W, p) of a list of values."""
    x, n = sorted(x), len(x)
    if n < 3:
        return math.nan, math.nan
    m, mean = [normal_score(i, n) for i in range(1, n + 1)], sum(x) / n
    return shapiro_from_sums(n, sum(v * v for v in m), sum(p * q for p, q in zip(m, x)), (x[0], x[1], x[-2], x[-1]), sum((v - mean) ** 2 for v in x))


@F.pandas_udf(DoubleType())
def normal_scores(place: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([normal_score(i + 1, m) for i, m in zip(place, n)], dtype="float64")


def shapiro(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By group: n, W, p of the Shapiro-Wilk test and ``in_range``: whether n is one of those the approximation of p was made for (3 to 5,000).

    Values are ranked over range partitions and summed, so a group may have any size.  Nulls and NaN are passed over; fewer than 3 values, or
    values that are all equal, have nulls.
    """
    from ..operators.ranks import placed

    x = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n = x.groupBy(*keys).agg(F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("spread"))
    ranked = placed(x, keys, ["x"]).join(n, keys).withColumn("m", normal_scores("place", "n"))
    at = lambda k: F.max(F.when(F.col("place") == k, F.col("x")))
    sums = ranked.groupBy(*keys, "n", "spread").agg(F.sum(F.col("m") * F.col("m")).alias("norm"), F.sum(F.col("m") * F.col("x")).alias("cross"), at(F.lit(0)).alias("a"), at(F.lit(1)).alias("b"), at(F.col("n") - 2).alias("c"), at(F.col("n") - 1).alias("d"))

    @F.pandas_udf("w double, p double")
    def test(n: pd.Series, norm: pd.Series, cross: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, spread: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shapiro_from_sums(int(r[0]), r[1], r[2], r[3:7], r[7]) for r in zip(n, norm, cross, a, b, c, d, spread)], columns=["w", "p"])

    out = sums.withColumn("t", test("n", "norm", "cross", "a", "b", "c", "d", "spread"))
    return out.select(*keys, "n", "t.w", "t.p", F.col("n").between(3, 5000).alias("in_range"))


@F.pandas_udf(DoubleType())
def binomial_tail(share: pd.Series, least: pd.Series, n: pd.Series) -> pd.Series:
    """The chance that at least ``least`` of n draws fall in a share."""
    return pd.Series([beta_share(p, k, m - k + 1) for p, k, m in zip(share, least, n)], dtype="float64")


def median_interval(df: DataFrame, keys: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(keys, n, median, low, high): the percentile interval of the bootstrap's medians without redraws.

    A redraw's k-th value is at most x when at least k of its n draws are, which is a binomial tail at x's share of the group: the law that
    redraws sample.  Of an even number the bounds are the means of those of the lower and the upper middle value.  Equal values are counted first and
    ranked over range partitions, so no task has a group.  Nulls and NaN are passed over; a group without values has no row.
    """
    from ..operators.ranks import mid_ranks

    x = df.select(*keys, F.col(value).cast("double").alias("x"), F.lit(True).alias("all")).where(~F.isnan("x"))
    n = x.where("x IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("size"))
    r = mid_ranks(x, keys, "x", "all").join(n, keys).withColumn("upto", F.col("before") + F.col("n"))
    lower, upper = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    # Beyond eight deviations from the middle a tail is 0 or 1: only the least value past each of those bounds is kept.
    share, far = F.col("upto") / F.col("size"), 4 / F.sqrt("size") + 2 / F.col("size")
    near = r.withColumn("share", share).withColumn("near", F.abs(F.col("share") - 0.5) <= far)
    tail = lambda k: F.when(F.col("near") & (F.col("share") < 1), binomial_tail(F.least("share", F.lit(1.0)), k.cast("double"), F.col("size").cast("double"))).otherwise((F.col("share") >= 0.5).cast("double"))
    each = near.withColumn("p", tail(lower)).withColumn("q", tail(upper))
    least = lambda c, a: F.min(F.when(F.col(c) >= a, F.col("x")))
    a, z = (1 - level) / 2, (1 + level) / 2
    out = each.groupBy(*keys, "size").agg(*[least(c, v).alias(f"{c}_{k}") for c in "pq" for k, v in (("low", a), ("high", z))], F.min(F.when(F.col("upto") >= lower, F.col("x"))).alias("m1"), F.min(F.when(F.col("upto") >= upper, F.col("x"))).alias("m2"))
    mean = lambda p, q: F.round((F.col(p) + F.col(q)) / 2, 6)
    return out.select(*keys, F.col("size").alias("n"), mean("m1", "m2").alias("median"), mean("p_low", "q_low").alias("low"), mean("p_high", "q_high").alias("high"))


def regression_p(fits: DataFrame) -> DataFrame:
    """Adds t and the two-sided p of the correlation to a table with n and r; null where r is 1 or n below 3."""
    df = F.when(F.col("n") > 2, (F.col("n") - 2).cast("double"))
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(df / (1 - F.col("r") * F.col("r"))))
    return fits.withColumn("t", t).withColumn("p", 2 * t_p(F.abs(F.col("t")), df))


# A Gaussian kernel's density on a grid from -1 to 1, by class of pair; its width is n ** (-1/5) deviations.  Correlations have six
# digits, so pairs are counted by value before they meet the grid: at most 2,000,001 values a class, however many pairs.
kde = operator("kde", """
WITH g AS (SELECT DISTINCT session, stimulus FROM {edges}),
d AS (SELECT g.session, g.stimulus, i, j, r FROM g CROSS JOIN {scorr} s WHERE r IS NOT NULL),
x AS (SELECT d.stimulus, CASE WHEN e.weight > 0 OR f.weight > 0 THEN 'excitatory' WHEN e.weight < 0 OR f.weight < 0 THEN 'inhibitory' ELSE 'disconnected' END AS class, r, count(*) AS n FROM d
  LEFT JOIN {edges} e ON e.session = d.session AND e.stimulus = d.stimulus AND e.src = i AND e.dst = j LEFT JOIN {edges} f ON f.session = d.session AND f.stimulus = d.stimulus AND f.src = j AND f.dst = i
  GROUP BY d.stimulus, CASE WHEN e.weight > 0 OR f.weight > 0 THEN 'excitatory' WHEN e.weight < 0 OR f.weight < 0 THEN 'inhibitory' ELSE 'disconnected' END, r),
m AS (SELECT stimulus, class, sum(n) AS n, sum(n * r) / sum(n) AS mean FROM x GROUP BY stimulus, class),
h AS (SELECT x.stimulus, x.class, max(m.n) AS total, power(CAST(max(m.n) AS DOUBLE), -0.2) * sqrt(sum(x.n * (r - mean) * (r - mean)) / nullif(max(m.n) - 1, 0)) AS h FROM x JOIN m ON m.stimulus = x.stimulus AND m.class = x.class GROUP BY x.stimulus, x.class),
grid AS (SELECT SERIES(0, 20) AS step)
SELECT x.stimulus, x.class, CAST(step AS BIGINT) AS step, round(sum(n * exp(-0.5 * power((step / 10.0 - 1 - r) / h, 2))) / max(total) / (max(h) * sqrt(2 * pi())), 6) AS density
FROM x JOIN h ON h.stimulus = x.stimulus AND h.class = x.class CROSS JOIN grid WHERE h > 0 GROUP BY x.stimulus, x.class, step""")
