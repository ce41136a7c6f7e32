"""Securities, sheets and a search catalog made from the star-schema test tables.

One SQL text serves both engines: Spark gets tables for the names in braces, the oracle the
names themselves. Full years are the second grouping set, so sheets mix grains as the real ones
do. All metrics are stand-ins, not financial figures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECURITIES = """
select s.s_suppkey as ord, s.s_suppkey as security_id, upper(s.s_name) as symbol, s.s_name as name,
  case when s.s_suppkey % 7 = 0 then '-' else n.n_name end as sector,
  case when s.s_suppkey % 11 = 0 then cast(null as varchar(9)) else concat('IND ', r.r_name) end as industry,
  r.r_name as market, 'en' as language
from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""

SHEETS = """
with base as (
  select l_suppkey as security_id, cast(year(l_shipdate) as int) as fiscal, coalesce(cast(quarter(l_shipdate) as int), 9) as quarter,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue,
    cast(sum(cast(l_extendedprice as decimal(18,2)) * (cast(0.06 as decimal(4,2)) - cast(l_discount as decimal(4,2)))) as double) as net_profit,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) * 100 as asset,
    100 * cast(sum(cast(l_tax as decimal(4,2))) as double) / cast(count(*) as double) as dividend_yield,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close
  from {lineitem}
  group by grouping sets ((l_suppkey, year(l_shipdate), quarter(l_shipdate)), (l_suppkey, year(l_shipdate))))
select b.*, 100 * b.net_profit / b.asset as roe, 100 * b.net_profit / b.revenue as npm,
  b.revenue / nullif(b.net_profit, 0) as price_earning_ratio,
  100 * (b.revenue / p.revenue - 1) as revenue_yoy,
  100 * (b.net_profit / nullif(p.net_profit, 0) - 1) as net_profit_yoy
from base b left join base p on p.security_id = b.security_id and p.quarter = b.quarter and p.fiscal = b.fiscal - 1
"""

PARTS = """
select p_partkey as ord, p_brand as symbol, p_name as name, p_type as sector, concat('SIZE ', cast(p_size as varchar(9))) as industry, 'en' as language from {part}
"""

TABLES = ("supplier", "nation", "region", "lineitem", "part")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    named = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **named)


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, SECURITIES)


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, SHEETS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, PARTS)


def oracle(sql: str) -> str:
    """SQL over securities, sheets and parts as DuckDB takes it."""
    plain = {t: t for t in TABLES}
    named = {"securities": SECURITIES, "sheets": SHEETS, "parts": PARTS}
    used = [f"{k} as ({v.format(**plain)})" for k, v in named.items() if k in sql]
    sql = sql.strip()
    rest = sql[5:].lstrip() if sql.lower().startswith("with ") else None
    recursive = "recursive " if rest is not None and rest.lower().startswith("recursive ") else ""
    if rest is not None:
        return f"with {recursive}" + ", ".join([*used, rest[len(recursive) :]])
    return ("with " + ", ".join(used) + " " if used else "") + sql
