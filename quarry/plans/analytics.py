"""Analyses of all securities at once, each one plan over catalog and sheets.

``sheets`` are typed sheets of mixed grain; "latest" is the greatest (fiscal, quarter) of a
security in its grain. A limit on symbols or rows is only taken where the analysis has one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numbers import change, ratio
from quarry.operators import catalog as C
from quarry.operators import panel as P

ID = "security_id"


def _of(df: DataFrame, ids: Sequence | None) -> DataFrame:
    return df if ids is None else df.where(F.col(ID).isin(*ids))


def latest_year(sheets: DataFrame, *columns: str) -> DataFrame:
    return P.latest(P.years(sheets), ID, columns or None)


def latest_quarter(sheets: DataFrame, *columns: str) -> DataFrame:
    return P.latest(P.quarters(sheets), ID, columns or None)


def revenue_growth(sheets: DataFrame, periods: int = 8, ids: Sequence | None = None) -> DataFrame:
    """The last quarters of revenue and its yearly growth."""
    return P.tail(P.quarters(_of(sheets, ids)), periods).select(ID, *P.TIME, "revenue", "revenue_yoy")


def profitability(catalog: DataFrame, sheets: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """The latest year's revenue, profit, margin and return, best return first."""
    last = latest_year(_of(sheets, ids), "revenue", "net_profit", "npm", "roe")
    return catalog.select(ID, "symbol", "name", "sector").join(last, ID).orderBy(F.desc("roe"), "symbol")


HEALTH = {
    "profitability": ("revenue", "net_profit", "npm", "roe", "roa"),
    "structure": ("debt_to_equity", "earning_per_share", "book_value_per_share"),
    "valuation": ("close", "mkt_cap", "price_earning_ratio", "ev_per_ebit_da"),
}


def health(sheets: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """The latest year as rows of section, metric and value; metrics that sheets lack are left out."""
    last = latest_year(_of(sheets, ids))
    have = [(s, m) for s, ms in HEALTH.items() for m in ms if m in sheets.columns]
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for s, m in have])
    return last.select(ID, F.explode(rows).alias("r")).select(ID, "r.*")


def sector_ranking(catalog: DataFrame, sheets: DataFrame, k: int = 10) -> DataFrame:
    """The mean latest return of each sector's first k securities, best first."""
    named = catalog.where("sector is not null and sector <> '-'")
    last = latest_year(sheets, "roe")
    rows = P.first_of(named, k).join(last, ID).groupBy("sector").agg(F.avg("roe").alias("average_roe"), F.count("roe").alias("analysed"))
    total = named.groupBy("sector").agg(F.count("*").alias("total"))
    return rows.where("analysed > 0").join(total, "sector").orderBy(F.desc("average_roe"), "sector")


def _roa(sheets: DataFrame) -> list[str]:
    return [c for c in sheets.columns if c == "roa"]


def sector_detail(catalog: DataFrame, sheets: DataFrame, sector: str) -> DataFrame:
    """A sector's members with the latest year and quarter, revenue in thousands of its unit; roa where sheets have it."""
    members = C.in_sector(catalog, sector).select(ID, "symbol", "name", "market")
    year, quarter = latest_year(sheets, "revenue", "net_profit", "roe", *_roa(sheets)), latest_quarter(sheets, "close", "price_earning_ratio")
    rows = members.join(year, ID).join(quarter, ID, "left")
    return rows.withColumns({"revenue": F.round(F.col("revenue") / 1000, 2), "net_profit": F.round(F.col("net_profit") / 1000, 2)}).orderBy(F.desc("revenue"), "symbol")


def sector_summary(catalog: DataFrame, sheets: DataFrame, sector: str) -> DataFrame:
    d = sector_detail(catalog, sheets, sector)
    return d.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"average_{c}") for c in ("roe", *_roa(d))], F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("total_revenue"))


def sector_revenue(catalog: DataFrame, sheets: DataFrame, sector: str, k: int = 5) -> DataFrame:
    """The latest yearly revenue of a sector's first k securities."""
    return C.head(C.in_sector(catalog, sector), k).select(ID, "symbol").join(latest_year(sheets, "fiscal", "revenue"), ID)


def sector_returns(catalog: DataFrame, sheets: DataFrame, sector: str, k: int | None = None) -> DataFrame:
    """The latest yearly return of a sector's (first k) members, best first."""
    members = C.in_sector(catalog, sector)
    members = members if k is None else C.head(members, k)
    return members.select(ID, "symbol").join(latest_year(sheets, "roe"), ID).orderBy(F.desc("roe"), "symbol")


def value_screen(catalog: DataFrame, sheets: DataFrame, min_roe: float = 15, max_pe: float = 15, strict: bool = False, sample_n: int | None = None) -> DataFrame:
    """Securities by the latest year's return and price-earnings ratio, best return first."""
    roe, pe = F.col("roe"), F.col("price_earning_ratio")
    test = (roe > min_roe) & (pe < max_pe) if strict else (roe >= min_roe) & (pe <= max_pe)
    last = latest_year(sheets, "roe", "price_earning_ratio").where(test & (pe > 0))
    catalog = catalog if sample_n is None else C.head(catalog, sample_n)
    return catalog.select(ID, "symbol", "sector").join(last, ID).orderBy(F.desc("roe"), "symbol")


def value_investing(catalog: DataFrame, sheets: DataFrame, min_roe: float = 15, max_pe: float = 15, min_revenue: float = 1000, sample_n: int | None = None) -> DataFrame:
    """Return and revenue of the latest year with the price-earnings ratio of the latest quarter."""
    year = latest_year(sheets, "roe", "revenue").where((F.col("roe") >= min_roe) & (F.col("revenue") >= min_revenue))
    quarter = latest_quarter(sheets, "price_earning_ratio").where((F.col("price_earning_ratio") <= max_pe) & (F.col("price_earning_ratio") > 0))
    catalog = catalog if sample_n is None else C.head(catalog, sample_n)
    rows = catalog.select(ID, "symbol", "name", "sector", "market").join(year, ID).join(quarter, ID)
    return rows.orderBy(F.desc("roe"), "price_earning_ratio", "symbol")


def dividends(catalog: DataFrame, sheets: DataFrame, min_yield: float = 3.0, sample_n: int | None = None) -> DataFrame:
    """Securities by the latest quarter's dividend yield, highest first."""
    last = latest_quarter(sheets, "dividend_yield", "close").where(F.col("dividend_yield") >= min_yield)
    catalog = catalog if sample_n is None else C.head(catalog, sample_n)
    return catalog.select(ID, "symbol", "name", "sector").join(last, ID).orderBy(F.desc("dividend_yield"), "symbol")


def growth_screen(catalog: DataFrame, sheets: DataFrame, min_revenue: float = 20, min_profit: float = 25, sample_n: int | None = None) -> DataFrame:
    """Securities of four quarters and more by the latest quarter's growth."""
    q = P.quarters(sheets)
    last = q.groupBy(ID).agg(F.max_by(F.struct("revenue_yoy", "net_profit_yoy"), F.struct(*P.TIME)).alias("r"), F.count("*").alias("n")).where("n >= 4").select(ID, "r.*")
    last = last.where((F.col("revenue_yoy") >= min_revenue) & (F.col("net_profit_yoy") >= min_profit))
    catalog = catalog if sample_n is None else C.head(catalog, sample_n)
    return catalog.select(ID, "symbol", "name", "sector", "market").join(last, ID).orderBy(F.desc("revenue_yoy"), F.desc("net_profit_yoy"), "symbol")


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient as an aggregate, null where a side does not vary."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(catalog: DataFrame, sheets: DataFrame, metric: str = "revenue_yoy", periods: int = 8, per_sector: int = 10, least: int = 3) -> DataFrame:
    """Coefficients between each sector's first securities over the same quarters.

    Pairs lie within a sector and each sector gives at most per_sector securities, so their
    number grows with the sectors.
    """
    known = P.tail(P.quarters(sheets).where(F.col(metric).isNotNull()), periods)
    full = known.groupBy(ID).agg(F.count("*").alias("n")).where(F.col("n") >= periods)
    members = P.first_of(catalog.where("sector is not null and sector <> '-'"), per_sector).select(ID, "symbol", "sector").join(full.select(ID), ID, "left_semi")
    members = members.withColumn("members", F.count("*").over(Window.partitionBy("sector"))).where(F.col("members") >= least)
    rows = members.join(known.select(ID, *P.TIME, metric), ID)
    a = rows.select("sector", *P.TIME, F.col("symbol").alias("a"), F.col(metric).alias("x"))
    b = rows.select("sector", *P.TIME, F.col("symbol").alias("b"), F.col(metric).alias("y"))
    pairs = a.join(b, ["sector", *P.TIME]).where("a < b")
    return pairs.groupBy("sector", "a", "b").agg(F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("correlation"))


def correlation_matrix(pairs: DataFrame) -> DataFrame:
    """Both orders of each pair, and ones on the diagonal."""
    both = pairs.unionByName(pairs.select("sector", F.col("b").alias("a"), F.col("a").alias("b"), "n", "correlation"))
    own = both.select("sector", "a").distinct().select("sector", "a", F.col("a").alias("b"), F.lit(1.0).alias("correlation"))
    return both.select("sector", "a", "b", "correlation").unionByName(own)


def quarterly_trend(sheets: DataFrame, periods: int = 20, show: int = 8, metrics: Sequence[str] = ("revenue", "net_profit", "roe")) -> DataFrame:
    """The last quarters with means over 4 and 8 of them; the range is cut before the means are taken."""
    rows = P.tail(P.quarters(sheets), periods).select(ID, *P.TIME, *metrics)
    means = {f"{m}_ma{n}": P.rolling(F.avg, m, n) for m in metrics for n in (4, 8)}
    return P.tail(rows.withColumns(means), show)


def custom_metrics(sheets: DataFrame) -> DataFrame:
    """Mean growth and spread of profit over four quarters, and revenue by asset."""
    return P.quarters(sheets).select(
        ID, *P.TIME, P.rolling(F.avg, "revenue_yoy", 4).alias("revenue_yoy_ma4"), P.rolling(F.stddev_samp, "net_profit", 4).alias("net_profit_std4"), ratio(F.col("revenue"), F.col("asset")).alias("asset_turnover")
    )


def price_changes(sheets: DataFrame) -> DataFrame:
    w = P.by_time(ID)
    return P.quarters(sheets).select(ID, *P.TIME, "close", change(F.col("close"), F.lag("close").over(w)).alias("change"))


def volatility(catalog: DataFrame, sheets: DataFrame, sample_n: int | None = None) -> DataFrame:
    """The spread of each security's changes in price."""
    spread = price_changes(sheets).groupBy(ID).agg(F.stddev_samp("change").alias("volatility"), F.count("change").alias("n"))
    catalog = catalog if sample_n is None else C.head(catalog, sample_n)
    return catalog.select(ID, "symbol").join(spread, ID).orderBy(F.desc("volatility"), "symbol")


def growth_trend(sheets: DataFrame, years: int = 5) -> DataFrame:
    """Compound and total growth of revenue, and the range of returns, over the last years."""
    rows = P.tail(P.years(sheets), years)
    known = F.struct("fiscal")
    has = F.col("revenue").isNotNull()
    g = rows.groupBy(ID).agg(
        F.count("revenue").alias("n"),
        F.min_by("revenue", F.when(has, known)).alias("first"),
        F.max_by("revenue", F.when(has, known)).alias("last"),
        F.avg("roe").alias("average_roe"),
        F.max("roe").alias("max_roe"),
        F.min("roe").alias("min_roe"),
    )
    sound = (F.col("first") > 0) & (F.col("last") >= 0) & (F.col("n") >= 2)
    cagr = F.when(sound, F.pow(F.col("last") / F.col("first"), 1 / (F.col("n") - 1)) - 1)
    return g.withColumn("cagr", cagr).withColumn("total_change", change(F.col("last"), F.col("first")))


def portfolio(sheets: DataFrame, weights: DataFrame, years: int = 5) -> DataFrame:
    """Mean and spread of the last years' returns of each holding, and its part of the whole."""
    rows = P.tail(P.years(sheets), years).join(weights, ID)
    return rows.groupBy(ID, "weight").agg(F.avg("roe").alias("average_roe"), F.stddev_samp("roe").alias("roe_std"), F.avg(F.col("roe") * F.col("weight")).alias("contribution"))


def portfolio_summary(holdings: DataFrame) -> DataFrame:
    """Expected return, risk and their ratio."""
    s = holdings.agg(F.coalesce(F.sum("contribution"), F.lit(0.0)).alias("expected_return"), F.coalesce(F.sum(F.col("roe_std") * F.col("weight")), F.lit(0.0)).alias("risk"))
    return s.withColumn("return_by_risk", F.when(F.col("risk") > 0, F.col("expected_return") / F.col("risk")))


def weights(spark, ids: Sequence, shares: Sequence[float] | None = None) -> DataFrame:
    """Holdings with their weights, equal ones if none are given."""
    shares = [1 / len(ids)] * len(ids) if shares is None else list(shares)
    if len(shares) != len(ids):
        raise ValueError("as many weights as holdings are asked for")
    return spark.createDataFrame(list(zip(ids, map(float, shares), strict=True)), f"{ID} long, weight double")


def holdings_profile(catalog: DataFrame, sheets: DataFrame, ids: Sequence | None = None) -> DataFrame:
    """The latest year of each holding with its sector's share of the holdings."""
    rows = _of(catalog, ids).select(ID, "symbol", "sector").join(latest_year(sheets, "revenue", "roe"), ID)
    return rows.withColumn("in_sector", F.count("*").over(Window.partitionBy("sector")))


def validated(sheets: DataFrame, columns: Sequence[str], least: int = 4) -> DataFrame:
    """For each security whether its quarters have the columns and are enough."""
    have = all(c in sheets.columns for c in columns)
    return P.quarters(sheets).groupBy(ID).agg(F.count("*").alias("n")).withColumn("valid", F.lit(have) & (F.col("n") >= least))


def ranges(sheets: DataFrame) -> DataFrame:
    """Number and first and last time of each security's quarters."""
    q = P.quarters(sheets).withColumn("time", F.concat(F.col("fiscal").cast("string"), F.lit("Q"), F.col("quarter").cast("string")))
    return q.groupBy(ID).agg(F.count("*").alias("n"), F.min_by("time", F.struct(*P.TIME)).alias("first"), F.max_by("time", F.struct(*P.TIME)).alias("last"))


def safely(symbols: DataFrame, catalog: DataFrame, sheets: DataFrame) -> DataFrame:
    """Each asked symbol with its latest year; nulls where symbol or sheet is missing."""
    return symbols.join(catalog.select("symbol", ID), "symbol", "left").join(latest_year(sheets, "fiscal", "revenue"), ID, "left").select("symbol", "fiscal", "revenue")


def described(sheets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, spread, extremes of typed metrics, a row for each metric."""
    q = P.quarters(sheets)
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("v")) for c in columns])
    return q.select(F.explode(rows).alias("r")).groupBy("r.metric").agg(F.count("r.v").alias("n"), F.avg("r.v").alias("mean"), F.stddev_samp("r.v").alias("std"), F.min("r.v").alias("min"), F.max("r.v").alias("max"))
