"""Series reductions, summaries and statistical exploration.

Series operators work on ``(*by, period, y)`` frames; ``by`` identifies one
series (``[]`` = the daily total, bounded by the window length).  Statistics are
window and aggregate plans; the PACF recursion is a fold over an array, and the
ADF lag search solves small normal equations from sums of cross products.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Optional, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.functions.columns import epoch_seconds

from tripcast.operators import features as W
from tripcast.operators.kendall import tau_b
from tripcast.operators.quality import require_columns
from tripcast.params import DEMAND, PERIOD, REGION

TOTAL_LABEL = "All regions"


def _wall(by):
    return Window.partitionBy(*by)


# --------------------------------------------------------------------------- P10
def total_per_period(series: DataFrame, by: Sequence[str] = (), value_col: str = DEMAND) -> DataFrame:
    """Sum over regions per period as DOUBLE ``y``; NULL periods dropped."""
    require_columns(series, [PERIOD, value_col], "series")
    return (series.where(F.col(PERIOD).isNotNull())
                  .groupBy(*by, PERIOD).agg(F.sum(value_col).cast("double").alias("y")))


def region_series(series: DataFrame, value_col: str = DEMAND) -> DataFrame:
    """Per-region series in the ``(region, period, y)`` shape."""
    return total_per_period(series, by=[REGION], value_col=value_col)


MAX_REGION_COLUMNS = 1000


def region_list(df: DataFrame) -> list[str]:
    """The regions' names in order, for operators that need a column (or a model
    term) per region. More than MAX_REGION_COLUMNS raise ValueError: such a
    result would not be a table any more."""
    names = [r[0] for r in df.select(REGION).where(F.col(REGION).isNotNull()).distinct()
             .limit(MAX_REGION_COLUMNS + 1).collect()]
    if len(names) > MAX_REGION_COLUMNS:
        raise ValueError(f"more than {MAX_REGION_COLUMNS} regions: a column per region is not possible")
    return sorted(names)


# --------------------------------------------------------------------------- P11
def pivot_regions(series: DataFrame, regions: Optional[Sequence[str]] = None,
                  value_col: str = DEMAND) -> DataFrame:
    """Long -> wide (period x region), missing cells 0.  Passing the region
    list avoids the extra distinct job the pivot would otherwise run."""
    if regions is None:
        regions = region_list(series)
    return (series.groupBy(PERIOD).pivot(REGION, list(regions)).agg(F.sum(value_col))
                  .na.fill(0))


# --------------------------------------------------------------------------- P12
def forecast_wide(fc: DataFrame, regions: Optional[Sequence[str]] = None) -> DataFrame:
    """Forecast pivot, cells rounded half-to-even to whole trips, TOTAL first
    (the sum of the rounded cells)."""
    rounded = fc.select(PERIOD, REGION, F.bround("yhat", 0).cast("long").alias("yhat"))
    if regions is None:
        regions = region_list(fc)
    wide = rounded.groupBy(PERIOD).pivot(REGION, list(regions)).agg(F.sum("yhat")).na.fill(0)
    total = reduce(lambda a, b: a + b, [F.col(f"`{r}`") for r in regions])
    return wide.select(PERIOD, total.alias("TOTAL"), *[F.col(f"`{r}`") for r in regions])


# --------------------------------------------------------------------------- P14
def series_kpis(series: DataFrame, value_col: str = DEMAND) -> DataFrame:
    return series.agg(
        F.coalesce(F.sum(value_col), F.lit(0)).cast("long").alias("total_demand"),
        F.count(F.lit(1)).cast("long").alias("rows"),
        F.count_distinct(PERIOD).cast("long").alias("periods"),
        F.count_distinct(REGION).cast("long").alias("regions"),
    ).withColumn("grid_cells", F.col("periods") * F.col("regions"))


# --------------------------------------------------------------------------- P15
def region_totals(series: DataFrame, value_col: str = DEMAND) -> DataFrame:
    """Regions ranked busiest first (ties by name); busiest/quietest flags.
    One row per region, so the ranking window is small."""
    t = series.where(F.col(REGION).isNotNull()).groupBy(REGION).agg(
        F.sum(value_col).cast("double").alias("total"))
    w = Window.orderBy(F.desc("total"), REGION)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return t.select(REGION, "total", F.row_number().over(w).alias("rank")) \
            .withColumn("is_busiest", F.col("rank") == 1) \
            .withColumn("is_quietest", F.col("rank") == n)


# --------------------------------------------------------------------------- P16
def demand_lines(series: DataFrame, value_col: str = DEMAND, show_total: bool = True) -> DataFrame:
    """Chart data: one line per region plus an 'All regions' line (via ROLLUP)
    when there is more than one region.  Output ``(period, line, demand)``."""
    r = (series.where(F.col(PERIOD).isNotNull()).rollup(PERIOD, REGION)
               .agg(F.sum(value_col).cast("double").alias("demand"), F.grouping_id().alias("__g")))
    r = r.where(F.col("__g") < 3)  # drop the grand total
    n_regions = F.count_distinct(REGION)
    multi = series.agg(n_regions.alias("n")).first()["n"] > 1  # one scalar
    keep = (F.col("__g") == 0) | (F.lit(show_total and multi) & (F.col("__g") == 1))
    return r.where(keep).select(PERIOD, F.when(F.col("__g") == 1, F.lit(TOTAL_LABEL))
                                .otherwise(F.col(REGION)).alias("line"), "demand")


# --------------------------------------------------------------------------- P17
def series_summary(series: DataFrame, value_col: str = DEMAND) -> DataFrame:
    """Span, periods, regions, busiest/quietest, first-third vs last-third mean
    change and direction (< 5% = flat), peak period/value - one row."""
    tot = total_per_period(series, value_col=value_col)
    w = Window.orderBy(PERIOD)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    t = tot.select(PERIOD, "y", F.row_number().over(w).alias("rn"), n.alias("n"))
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    agg = t.agg(F.min(PERIOD).alias("span_start"), F.max(PERIOD).alias("span_end"),
                F.count(F.lit(1)).cast("long").alias("n_periods"),
                F.avg(F.when(F.col("rn") <= third, F.col("y"))).alias("early_mean"),
                F.avg(F.when(F.col("rn") > F.col("n") - third, F.col("y"))).alias("late_mean"),
                F.max_by(PERIOD, F.struct(F.col("y"), -epoch_seconds(F.col(PERIOD))))
                 .alias("peak_period"),
                F.max("y").alias("peak_value"))
    pct = F.when(F.col("n_periods") < 3, F.lit(None).cast("double")) \
           .when(F.col("early_mean") > 0,
                 (F.col("late_mean") - F.col("early_mean")) / F.col("early_mean") * 100.0) \
           .otherwise(F.lit(0.0))
    agg = agg.withColumn("pct_change", pct).withColumn(
        "direction", F.when(F.col("pct_change").isNull(), F.lit(None))
                      .when(F.abs("pct_change") < 5, F.lit("flat"))
                      .when(F.col("pct_change") > 0, F.lit("up")).otherwise(F.lit("down")))
    rt = region_totals(series, value_col).agg(
        F.count(F.lit(1)).cast("long").alias("n_regions"),
        F.max_by(REGION, F.struct(F.col("rank") == 1)).alias("busiest"),
        F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("busiest_total"),
        F.max_by(REGION, "rank").alias("quietest"),
        F.max_by("total", "rank").alias("quietest_total"))
    both = agg.unionByName(rt, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in agg.columns + rt.columns])  # two one-row frames
    text = F.concat_ws(" ", F.format_string(
        "Daily demand across %d region(s) over %d periods, %s to %s.", "n_regions", "n_periods",
        F.col("span_start").cast("date").cast("string"), F.col("span_end").cast("date").cast("string")),
        F.when(F.col("direction").isNotNull(), F.format_string(
            "Total demand is %s (%.0f%%) from the first third to the last third.", "direction",
            "pct_change")),
        F.format_string("Peak total demand of %.0f trips around %s.", "peak_value",
                        F.col("peak_period").cast("date").cast("string")))
    return both.withColumn("text", text)


# ---------------------------------------------------------------------- A1/A2
def seasonal_decompose(y: DataFrame, period: int = 7, model: str = "additive",
                       by: Sequence[str] = ()) -> DataFrame:
    """A1: classical decomposition; adds ``trend, seasonal, resid``.

    trend = centred MA (W13); the seasonal index of row r is (r-1) % period;
    period means of the detrended values are centred (subtract / divide by
    their mean); resid = y - trend - seasonal (or y / (trend * seasonal)). A
    series with fewer than two periods has NULL components; so has a quotient
    by zero.
    """
    if period < 2:
        raise ValueError(f"period must be >= 2; got {period}")
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    longest = y.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if longest < 2 * period:
        raise ValueError(f"need at least {2 * period} observations for period {period}; got {longest}")
    # a shorter series among longer ones keeps its rows, without components
    y = y.withColumn("__long", F.count(F.lit(1)).over(_wall(by)) >= 2 * period)
    short, y = y.where("not __long").drop("__long"), y.where("__long").drop("__long")
    add = model == "additive"
    t = W.centered_moving_average(y, period, "y", by)
    t = t.withColumn("__idx", (F.row_number().over(W._w(by)) - 1) % period)
    t = t.withColumn("__det", F.col("y") - F.col("trend") if add else F.try_divide("y", "trend"))
    means = t.groupBy(*by, "__idx").agg(F.avg("__det").alias("__pm"))
    centre = F.avg("__pm").over(_wall(by))
    means = means.withColumn("seasonal", F.col("__pm") - centre if add else F.try_divide(F.col("__pm"), centre))
    out = t.join(means.select(*by, "__idx", "seasonal"), [*by, "__idx"])
    resid = F.col("y") - F.col("trend") - F.col("seasonal") if add else \
        F.try_divide(F.col("y"), F.col("trend") * F.col("seasonal"))
    none = [F.lit(None).cast("double").alias(c) for c in ("trend", "seasonal", "resid")]
    return out.select(*by, PERIOD, "y", "trend", "seasonal", resid.alias("resid")).unionByName(
        short.select(*by, PERIOD, "y", *none))


def decomposition_strength(dec: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A2: trend change %, direction, seasonal swing, seasonal/trend strength
    (sample variances on the common support) and residual share of spread."""
    common = F.col("trend").isNotNull() & F.col("seasonal").isNotNull() & F.col("resid").isNotNull()
    r, s, tr = F.col("resid"), F.col("seasonal"), F.col("trend")
    agg = dec.groupBy(*by).agg(
        F.min_by("trend", F.when(tr.isNotNull(), F.col(PERIOD))).alias("trend_start"),
        F.max_by("trend", F.when(tr.isNotNull(), F.col(PERIOD))).alias("trend_end"),
        (F.max("seasonal") - F.min("seasonal")).alias("seasonal_swing"),
        F.var_samp(F.when(common, r)).alias("__vr"),
        F.var_samp(F.when(common, r + s)).alias("__vds"),
        F.var_samp(F.when(common, r + tr)).alias("__vdt"),
        F.stddev_samp("resid").alias("__sr"), F.stddev_samp("y").alias("__sy"))
    pct = F.when(F.col("trend_start") != 0,
                 (F.col("trend_end") - F.col("trend_start")) / F.abs("trend_start") * 100.0).otherwise(0.0)

    def strength(v):
        return F.when(F.col(v) > 0, F.greatest(F.lit(0.0), 1 - F.col("__vr") / F.col(v))).otherwise(0.0)
    return agg.select(*by, "trend_start", "trend_end", pct.alias("trend_pct"),
                      F.when(F.abs(pct) < 5, "flat").when(pct > 0, "rising").otherwise("falling")
                      .alias("trend_direction"), "seasonal_swing",
                      strength("__vds").alias("seasonal_strength"),
                      strength("__vdt").alias("trend_strength"),
                      (F.col("__sr") / F.when(F.coalesce(F.col("__sy"), F.lit(0.0)) == 0, 1.0)
                       .otherwise(F.col("__sy"))).alias("resid_share"))


# --------------------------------------------------------------------------- A3
# Fixed values that must equal the published MacKinnon (1994, 2010) response
# surfaces for the constant-only ADF regression with one series.
ADF_TAU_MAX = 2.74
ADF_TAU_MIN = -18.83
ADF_TAU_STAR = -1.61
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_CRIT = {"1%": (-3.43035, -6.5393, -16.786, -79.433),
            "5%": (-2.86154, -2.8903, -4.234, -40.04),
            "10%": (-2.56677, -1.5384, -2.809, 0.0)}


def _norm_cdf(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def adf_pvalue(stat: float) -> float:
    if stat > ADF_TAU_MAX:
        return 1.0
    if stat < ADF_TAU_MIN:
        return 0.0
    coef = ADF_SMALL_P if stat <= ADF_TAU_STAR else ADF_LARGE_P
    return _norm_cdf(sum(c * stat ** i for i, c in enumerate(coef)))


def adf_critical(nobs: int) -> dict:
    return {k: b[0] + b[1] / nobs + b[2] / nobs ** 2 + b[3] / nobs ** 3 for k, b in ADF_CRIT.items()}


def adf_from_gram(gram: np.ndarray, head: np.ndarray, n: int, maxlag: int):
    """The ADF regression (constant only, AIC lag choice) from cross products.

    Columns: constant, level, lagged differences 1..., difference. ``gram`` sums
    the rows that have ``maxlag`` lags, the common sample of the lag choice;
    ``head`` holds the rows before them, which lower orders use as well.
    Returns (statistic, lag, nobs, reason or None).
    """
    last = len(gram) - 1
    scale = max(gram[1, 1], 0.0)
    if scale <= 1e-18 * max(1.0, n) or gram[last, last] <= 0:
        return None, None, None, "constant series"

    def fitted(g, lag):
        idx = np.arange(2 + lag)
        xx, xy = g[np.ix_(idx, idx)], g[idx, last]
        beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
        return xx, beta, float(g[last, last] - beta @ xy)
    common, best, best_aic = n - 1 - maxlag, None, math.inf
    for lag in range(maxlag + 1):
        ssr = fitted(gram, lag)[2]
        if ssr <= 1e-12 * gram[last, last]:
            return None, None, None, "the differences are fitted exactly"
        aic = common * (math.log(2 * math.pi) + math.log(ssr / common) + 1) + 2 * (2 + lag)
        if aic < best_aic:
            best, best_aic = lag, aic
    rows = head[best:]  # row i of the head has i lags
    full = gram + rows.T @ rows
    xx, beta, ssr = fitted(full, best)
    nobs = n - 1 - best
    spread = ssr / (nobs - 2 - best) * np.linalg.inv(xx)[1, 1]
    return float(beta[1] / math.sqrt(spread)), best, nobs, None


def adf_maxlag(n):
    """The library's largest lag order, as a column."""
    return F.least(F.floor(n / 2) - 2, F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))).cast("int")


def adf_test(y: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """A3: ADF per series, a row each. Cross products of the lag design are
    summed in one aggregate; every lag order, its AIC and the statistic come
    from their sub-matrices. A series that is too short or constant gets a row
    with the reason in ``status`` (else 'ok') and no figures."""
    keys = list(by)
    w, wall = W._w(by), _wall(by)
    s = y.select(*by, PERIOD, (F.col("y") - F.avg("y").over(wall)).alias("x"), F.count(F.lit(1)).over(wall).alias("n"))
    s = s.withColumn("d", F.col("x") - F.lag("x").over(w))
    s = s.withColumns({"i": F.row_number().over(w) - 1, "maxlag": adf_maxlag(F.col("n"))})
    most = y.groupBy(*by).count().agg(F.max(adf_maxlag(F.col("count")))).first()[0]
    most = max(most if most is not None else 0, 0)
    lags = [F.coalesce(F.lag("d", k).over(w), F.lit(0.0)) for k in range(1, most + 1)]
    z = s.select(*by, "n", "maxlag", "i", F.array(F.lit(1.0), F.lag("x").over(w), *lags, F.col("d")).alias("z"))
    z = z.where("i >= 1 and n >= 4 and maxlag >= 0")
    products = (z.where("i > maxlag").select(*by, F.posexplode("z").alias("a", "za"), "z")
                .select(*by, "a", F.posexplode("z").alias("b", "zb"), "za")
                .groupBy(*by, "a", "b").agg(F.sum(F.col("za") * F.col("zb")).alias("v")))
    flat = products.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "v"))),
                                                 lambda r: r["v"]).alias("gram"))
    head = z.where("i <= maxlag").groupBy(*by).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "z"))), lambda r: r["z"])).alias("head"))  # maxlag rows
    size = most + 3

    @F.pandas_udf("adf_stat double, p_value double, used_lag int, nobs int, crit_1 double, crit_5 double, "
                  "crit_10 double, stationary boolean, status string")
    def solve(gram: pd.Series, head: pd.Series, n: pd.Series, maxlag: pd.Series) -> pd.DataFrame:
        rows = []
        for g, h, count, m in zip(gram, head, n, maxlag):
            if g is None:
                rows.append((None,) * 8 + ("too few observations",))
                continue
            first = np.asarray([] if h is None else h, float).reshape(-1, size)
            stat, lag, nobs, why = adf_from_gram(np.asarray(g, float).reshape(size, size), first, int(count), int(m))
            if why:
                rows.append((None,) * 8 + (why,))
                continue
            crit, p = adf_critical(nobs), adf_pvalue(stat)
            rows.append((stat, p, lag, nobs, crit["1%"], crit["5%"], crit["10%"], bool(p < alpha), "ok"))
        out = pd.DataFrame(rows, columns=["adf_stat", "p_value", "used_lag", "nobs", "crit_1", "crit_5", "crit_10",
                                          "stationary", "status"])
        return out.astype({"adf_stat": "float64", "p_value": "float64", "used_lag": "Int32", "nobs": "Int32",
                           "crit_1": "float64", "crit_5": "float64", "crit_10": "float64", "stationary": "boolean"})
    sizes = y.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    one = [] if keys else [F.lit(1).alias("__one")]
    on = keys or ["__one"]
    frame = sizes.select(*one, "*").join(flat.select(*one, "*"), on, "left").join(head.select(*one, "*"), on, "left")
    found = frame.select(*[F.col(k).cast("string").alias(k) for k in keys],
                         solve("gram", "head", "n", F.coalesce(adf_maxlag(F.col("n")), F.lit(-1))).alias("r"))
    return found.select(*keys, "r.*")


def adf_lag0(y: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3 at a fixed lag 0: regress diff(y) on y(t-1) + constant in SQL terms;
    the statistic is the slope's t value."""
    w = W._w(by)
    d = y.select(*by, F.lag("y").over(w).alias("x"), (F.col("y") - F.lag("y").over(w)).alias("dy")) \
         .where("x IS NOT NULL AND dy IS NOT NULL")
    a = d.groupBy(*by).agg(F.regr_slope("dy", "x").alias("slope"), F.regr_sxx("dy", "x").alias("sxx"),
                           F.regr_syy("dy", "x").alias("syy"), F.regr_sxy("dy", "x").alias("sxy"),
                           F.regr_count("dy", "x").alias("n"))
    ssr = F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx"))
    se = F.sqrt(F.try_divide(F.try_divide(ssr, F.col("n") - 2), F.col("sxx")))
    return a.select(*by, F.col("n").cast("long").alias("nobs"), "slope",
                    F.try_divide(F.col("slope"), se).alias("adf_stat"))  # NULL for a constant series


# ---------------------------------------------------------------------- A4/A5/A6
def default_nlags(n: int) -> int:
    return max(1, min(40, n // 2 - 1))


def acf(y: DataFrame, nlags: Optional[int] = None, by: Sequence[str] = ()) -> DataFrame:
    """A4: autocorrelation up to ``nlags`` (default min(40, n/2-1), n being
    each series' own length) plus the 95% band 1.96/sqrt(n).  One shared
    window computes every lagged column; series under 4 rows have none."""
    n = y.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if n < 4:
        raise ValueError("ACF needs at least 4 observations")
    L = default_nlags(n) if nlags is None else max(1, min(int(nlags), n // 2 - 1))
    w = W._w(by)
    d = y.withColumn("__x", F.col("y") - F.avg("y").over(_wall(by)))
    d = d.select(*by, "__x", *[F.lag("__x", k).over(w).alias(f"__l{k}") for k in range(1, L + 1)])
    sums = d.groupBy(*by).agg(F.sum(F.col("__x") * F.col("__x")).alias("__c0"),
                              F.count(F.lit(1)).alias("__n"),
                              *[F.sum(F.col("__x") * F.col(f"__l{k}")).alias(f"__c{k}") for k in range(1, L + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__c{k}").alias("__ck")) for k in range(0, L + 1)])
    own = F.greatest(F.lit(1), F.floor(F.col("__n") / 2) - 1)
    return sums.select(*by, "__c0", "__n", F.inline(rows)).where(
        (F.col("__n") >= 4) & (F.col("lag") <= own)).select(
        *by, "lag", F.coalesce(F.try_divide(F.col("__ck"), F.col("__c0")), F.lit(0.0)).alias("acf"),
        (F.lit(1.96) / F.sqrt("__n")).alias("band"))


def pacf_fold(r):
    """Durbin-Levinson recursion over an array column of acf values r[0..L]
    (Yule-Walker, no bias adjustment): the array pacf[0..L] with pacf[0] = 1,
    as a fold, a lag a step."""
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), r[0].alias("v"), F.array(F.lit(1.0)).alias("out"))

    def step(state, k):
        phi, v = state["phi"], state["v"]
        known = F.aggregate(F.zip_with(phi, F.reverse(F.slice(r, 2, F.size(phi))), lambda p, q: p * q),
                            F.lit(0.0), lambda s, x: s + x)
        a = F.coalesce(F.try_divide(r[k] - known, v), F.lit(0.0))
        # the new coefficient is computed once and read as the last element
        out = F.concat(state["out"], F.array(a))
        return F.transform(F.array(out), lambda o: F.struct(
            F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - F.element_at(o, -1) * q),
                     F.array(F.element_at(o, -1))).alias("phi"),
            (v * (1 - F.element_at(o, -1) * F.element_at(o, -1))).alias("v"), o.alias("out")))[0]
    lags = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: k >= 1)
    return F.aggregate(lags, start, step, lambda s: s["out"])


def pacf(acf_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: PACF per series from its ACF rows (<= 41 rows per series)."""
    series = acf_rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("lag", "acf", "band"))).alias("__s"))
    fold = pacf_fold(F.transform("__s", lambda s: s["acf"]))
    return series.select(*by, F.inline(F.zip_with("__s", fold, lambda s, p: F.struct(
        s["lag"].cast("int").alias("lag"), p.alias("pacf"), s["band"].alias("band")))))


def order_hints(acf_rows: DataFrame, pacf_rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All significant lags, AR hint (first significant PACF lag),
    weekly flag (|acf(7)| beyond the band)."""
    a = acf_rows.where((F.col("lag") >= 1) & (F.abs("acf") > F.col("band"))).groupBy(*by).agg(
        F.array_sort(F.collect_list("lag")).alias("sig_acf"),
        F.bool_or(F.col("lag") == 7).alias("weekly"),
        F.min("lag").alias("first_sig_acf"))
    p = pacf_rows.where((F.col("lag") >= 1) & (F.abs("pacf") > F.col("band"))).groupBy(*by).agg(
        F.array_sort(F.collect_list("lag")).alias("sig_pacf"),
        F.min("lag").alias("ar_order_hint"))
    keys = acf_rows.select(*by).distinct() if by else acf_rows.limit(1).select()
    if by:
        out = keys.join(a, list(by), "left").join(p, list(by), "left")
    else:
        out = a.unionByName(p, allowMissingColumns=True).agg(
            F.max("sig_acf").alias("sig_acf"), F.max("weekly").alias("weekly"),
            F.max("first_sig_acf").alias("first_sig_acf"), F.max("sig_pacf").alias("sig_pacf"),
            F.max("ar_order_hint").alias("ar_order_hint"))
    return out.select(*by, F.coalesce("sig_acf", F.array().cast("array<int>")).alias("sig_acf"),
                      F.coalesce("sig_pacf", F.array().cast("array<int>")).alias("sig_pacf"),
                      "ar_order_hint", F.coalesce("weekly", F.lit(False)).alias("weekly"))


# ---------------------------------------------------------------------- A7/A8/A9
def detect_anomalies(y: DataFrame, window: int = 7, threshold: float = 3.5,
                     by: Sequence[str] = (), all_rows: bool = False) -> DataFrame:
    """Robust score = (y - local median) / (1.4826 * local MAD), with the
    mean-abs-dev x 1.2533 fallback where the MAD is 0; |score| > threshold.

    Rows ``(*by, period, value, expected, score, direction, description)``.
    """
    if window < 2:
        raise ValueError(f"window must be >= 2; got {window}")
    if threshold <= 0:
        raise ValueError(f"threshold must be positive; got {threshold}")
    d = W.rolling_median(y, window, "y", by)
    d = W.rolling_mad(d, window, "y", by)
    scaled = F.col("local_mad") * 1.4826
    denom = F.when(scaled > 0, scaled).otherwise(F.col("local_mean_abs_dev") * 1.2533)
    raw = F.try_divide(F.col("y") - F.col("local_median"), denom)
    score = F.when(raw.isNull() | F.isnan(raw), F.lit(0.0)).otherwise(raw)
    d = d.select(*by, PERIOD, F.col("y").alias("value"), F.col("local_median").alias("expected"),
                 score.alias("score"))
    d = d.withColumn("direction", F.when(F.col("score") > 0, "spike").otherwise("drop"))
    d = d.withColumn("description", anomaly_description())
    return d if all_rows else d.where(F.abs("score") > threshold)


def anomaly_description():
    """A one-line reading - direction, day, value against the local
    median and how far off it is in percent (or 'local level near zero')."""
    pct = (F.col("value") - F.col("expected")) / F.col("expected") * 100.0
    away = F.when(F.col("expected") > 0, F.format_string("%+.0f%% vs local median", pct)) \
            .otherwise(F.lit("local level near zero"))
    return F.format_string("%s on %s: %.0f trips, local median %.0f (%s), robust score %+.1f",
                           F.col("direction"), F.col(PERIOD).cast("date").cast("string"),
                           "value", "expected", away, "score")


def anomaly_pct(col_value="value", col_expected="expected"):
    return F.when(F.col(col_expected) > 0,
                  (F.col(col_value) - F.col(col_expected)) / F.col(col_expected) * 100.0)


def anomaly_summary(anoms: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of spikes and drops and the most extreme one (|score| desc, period)."""
    ext = F.struct(F.abs("score"), -epoch_seconds(F.col(PERIOD)))
    return anoms.groupBy(*by).agg(
        F.count_if(F.col("direction") == "spike").cast("long").alias("spikes"),
        F.count_if(F.col("direction") == "drop").cast("long").alias("drops"),
        F.max_by(PERIOD, ext).alias("extreme_period"),
        F.max_by("score", ext).alias("extreme_score"))


# ------------------------------------------------------------------ A10-A14
def _pairwise_r(a, b):
    both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _avg_rank(col: str, by: Sequence[str]):
    """Average rank of ties (1-based) within a group."""
    w = Window.partitionBy(*by).orderBy(col)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, col))
    return F.rank().over(w) + (ties - 1) / 2.0


def _spearman(base: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rank correlations; ranks are taken over each pair's complete rows."""
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("__a"), F.col(b).alias("__b"))
                      for i, a in enumerate(cols) for b in cols[i:]])
    ok = F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.isnan("__a") & ~F.isnan("__b")
    group = [*by, "x", "y", "__ok"]
    ranked = base.select(*by, F.inline(pairs)).withColumn("__ok", ok).select(
        *by, "x", "y", *[F.when(F.col("__ok"), _avg_rank(c, group)).alias(c) for c in ("__a", "__b")])
    half = ranked.groupBy(*by, "x", "y").agg(_pairwise_r(F.col("__a"), F.col("__b")).alias("r")).withColumn(
        "r", F.when((F.col("x") == F.col("y")) & F.col("r").isNotNull(), F.lit(1.0)).otherwise(F.col("r")))
    mirrored = half.where("x <> y").select(*by, F.col("y").alias("x"), F.col("x").alias("y"), "r")
    return half.unionByName(mirrored)


def _kendall(base: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Tau-b of every pair of columns over the pair's complete rows; 1 on the diagonal."""
    pairs = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).alias("__a"), F.col(b).alias("__b"))
                      for i, a in enumerate(cols) for b in cols[i + 1:]])
    half = tau_b(base.select(*by, F.inline(pairs)), [*by, "x", "y"], "__a", "__b")
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a in cols for b in cols])
    groups = base.select(*by).distinct() if by else base.select(F.lit(1).alias("__one")).distinct()
    every = groups.select(*by, F.inline(names))
    both = half.unionByName(half.select(*by, F.col("y").alias("x"), F.col("x").alias("y"), "r"))
    return every.join(both, [*by, "x", "y"], "left").select(
        *by, "x", "y", F.when(F.col("x") == F.col("y"), F.lit(1.0)).otherwise(F.col("r")).alias("r"))


def demand_correlations(y: DataFrame, exog: Optional[DataFrame] = None, method: str = "pearson",
                        by: Sequence[str] = ()) -> DataFrame:
    """Correlation of demand with calendar features (default) or with
    the numeric columns of ``exog`` (left-joined on period, pairwise NULLs
    ignored).  Output long ``(*by, x, y, r)`` for every ordered pair, demand first."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    if exog is None:
        base = W.calendar_features(y.select(*by, PERIOD, F.col("y").alias("demand")))
        feats = ["day_of_week", "is_weekend", "month", "day_of_month"]
    else:
        from tripcast.functions.columns import is_numeric_type
        feats = [f.name for f in exog.schema.fields if f.name != PERIOD and is_numeric_type(f.dataType)]
        base = y.select(*by, PERIOD, F.col("y").alias("demand")).join(
            exog.select(PERIOD, *feats), PERIOD, "left")
    cols = ["demand"] + feats
    base = base.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    if method == "kendall":
        return _kendall(base, cols, by)
    if method == "spearman":
        return _spearman(base, cols, by)
    # the diagonal is 1 only where the column varies (pandas gives NaN otherwise)
    aggs = [_pairwise_r(F.col(a), F.col(b)).alias(f"__r_{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    wide = base.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                              F.when((F.lit(i == j)) & F.col(f"__r_{i}_{j}").isNotNull(), F.lit(1.0))
                              .otherwise(F.col(f"__r_{i}_{j}")).alias("r"))
                     for i, a in enumerate(cols) for j, b in enumerate(cols)])
    return wide.select(*by, F.inline(rows))


def correlation_ranking(corr: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """demand's correlations ranked by |r| (ties by name), with the
    strength class (.7 strong / .4 moderate / .2 weak / negligible)."""
    d = corr.where((F.col("x") == "demand") & (F.col("y") != "demand") & F.col("r").isNotNull())
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("r")), "y")
    a = F.abs("r")
    return d.select(*by, F.col("y").alias("variable"), "r", F.row_number().over(w).alias("rank"),
                    F.when(a >= 0.7, "strong").when(a >= 0.4, "moderate").when(a >= 0.2, "weak")
                    .otherwise("negligible").alias("strength"),
                    F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("sign"))
