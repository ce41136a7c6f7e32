"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import language, numbers, similarity
from quarry.operators import catalog as C
from quarry.operators import panel as P
from quarry.operators.search import search
from quarry.plans import adapter as A
from quarry.plans import analytics as R
from quarry.sources import landed
from quarry.sources import schema as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = A.oracle(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6, **by_name: int) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.select(*[F.round(c, by_name.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LATEST = """(select * from (select s.*, row_number() over (partition by security_id order by fiscal desc, quarter desc) as place
  from sheets s where quarter {grain} 9) where place = 1)"""
YEAR, QUARTER = LATEST.format(grain="="), LATEST.format(grain="<>")
TAIL = "(select * from (select s.*, row_number() over (partition by security_id order by fiscal desc, quarter desc) as place from sheets s where quarter {grain} 9) where place <= {n})"
SECTOR = "NATION_1"
HOLDINGS = list(range(5))
WEIGHTS = [0.25, 0.25, 0.2, 0.15, 0.15]


# Catalog


@query("select symbol from securities")
def list_symbols(spark, d):
    return C.symbols(A.securities(spark, d))


@query("select symbol, name, industry, sector, market from securities")
def list_with_names(spark, d):
    return C.with_names(A.securities(spark, d))


@query(f"select symbol, sector from securities where contains(lower(sector), '{SECTOR.lower()}')")
def filter_by_sector(spark, d):
    return C.in_sector(A.securities(spark, d), f" {SECTOR} ").select("symbol", "sector")


@query("select symbol, market from securities where upper(market) = 'ASIA'")
def filter_by_market(spark, d):
    return C.in_market(A.securities(spark, d), "asia").select("symbol", "market")


@query("select symbol, name, sector from securities where symbol = upper('Supplier#000000003')")
def lookup_symbol(spark, d):
    return C.lookup(A.securities(spark, d), "Supplier#000000003".upper()).select("symbol", "name", "sector")


@query("select symbol, name as company_name, coalesce(nullif(industry, ''), '-') as industry, coalesce(nullif(sector, ''), '-') as sector, market from securities")
def company_profile(spark, d):
    return C.profile(A.securities(spark, d))


def _listings(spark, d):
    return A.securities(spark, d).select("ord", F.col("symbol").alias("name"), "security_id")


@query("select s.symbol, h.fiscal, h.quarter, h.revenue from securities s join sheets h using (security_id)")
def symbol_to_sheet(spark, d):
    return C.to_sheets(A.securities(spark, d).select("symbol"), _listings(spark, d), A.sheets(spark, d)).select("symbol", "fiscal", "quarter", "revenue")


@query("select symbol from securities where ord % 10 = 3")
def symbols_without_sheet(spark, d):
    # The tables have a listing for each security; a tenth of them is left out here to have gaps to find.
    return C.without_sheets(A.securities(spark, d), _listings(spark, d).where("ord % 10 <> 3"), A.sheets(spark, d)).select("symbol")


@query("select symbol, name as name_en, concat('ท ', name) as name_th from securities")
def bilingual_names(spark, d):
    en = A.securities(spark, d)
    th = en.withColumn("language", F.lit("th")).withColumn("name", F.concat(F.lit("ท "), "name"))
    return C.bilingual(en.unionByName(th))


@query("select sector, count(*) as n from securities where sector is not null group by sector")
def sector_counts(spark, d):
    return C.counts(A.securities(spark, d), "sector")


@query("select market, count(*) as n from securities where market is not null group by market")
def market_counts(spark, d):
    return C.counts(A.securities(spark, d), "market")


@query("select distinct sector from securities where sector <> '-'")
def distinct_sectors(spark, d):
    return C.sectors(A.securities(spark, d))


@query(
    """with found as (select sector as name, count(*) as n from securities group by sector)
    select 'sector' as kind, name, cast(n + 1 as int) as said, n from found where name = 'NATION_1'
    union all select 'market', market, cast(null as int), count(*) from securities group by market"""
)
def metadata_consistency(spark, d):
    cat = A.securities(spark, d)
    n = (F.col("n") + F.when(F.col("sector") == SECTOR, 1).otherwise(0)).cast("int")
    said = C.counts(cat, "sector").agg(F.map_from_entries(F.collect_list(F.struct("sector", n))).alias("sectors"))
    none = F.lit(None).cast("int")
    return C.agreement(cat, said.withColumn("markets", F.struct(none.alias("SET"), none.alias("mai"))))


# Panels


@query("select security_id, cast(fiscal as varchar) || 'Q' || cast(quarter as varchar) as time, make_date(fiscal, (quarter - 1) * 3 + 1, 1) as period_start, revenue, net_profit from sheets where quarter <> 9")
def quarter_frame(spark, d):
    return P.quarterly(A.sheets(spark, d)).select("security_id", "time", "period_start", "revenue", "net_profit")


@query("select security_id, fiscal, make_date(fiscal, 1, 1) as period_start, revenue, net_profit from sheets where quarter = 9")
def yearly_frame(spark, d):
    return P.yearly(A.sheets(spark, d)).select("security_id", "fiscal", "period_start", "revenue", "net_profit")


TH = S.THAI_LABELS


@query(f'select security_id, cast(fiscal as varchar) || \'Q\' || cast(quarter as varchar) as "ช่วงเวลา", revenue as "{TH["revenue"]}", net_profit as "{TH["net_profit"]}", round(roe, 6) as "{TH["roe"]}" from sheets where quarter <> 9')
def quarter_frame_th(spark, d):
    df = P.quarterly(A.sheets(spark, d), thai=True)
    return df.select("security_id", "`ช่วงเวลา`", f"`{TH['revenue']}`", f"`{TH['net_profit']}`", F.round(f"`{TH['roe']}`", 6).alias(TH["roe"]))


@query(f"select security_id, fiscal, revenue, round(roe, 6) as roe from {YEAR}")
def latest_year(spark, d):
    return rounded(R.latest_year(A.sheets(spark, d), "fiscal", "revenue", "roe"))


@query(f"select security_id, fiscal, quarter, revenue, round(close, 6) as close from {QUARTER}")
def latest_quarter(spark, d):
    return rounded(R.latest_quarter(A.sheets(spark, d), "fiscal", "quarter", "revenue", "close"))


@query(f"select security_id, fiscal, quarter, revenue from {TAIL.format(grain='<>', n=5)}")
def tail_n(spark, d):
    return P.tail(P.quarters(A.sheets(spark, d)), 5).select("security_id", "fiscal", "quarter", "revenue")


@query("select sector, symbol from (select *, row_number() over (partition by sector order by ord) as place from securities) where place <= 3")
def first_k_per_sector(spark, d):
    return P.first_of(A.securities(spark, d), 3).select("sector", "symbol")


@query(
    f"select security_id, fiscal, quarter, round(revenue, 2) as revenue, round(net_profit, 2) as net_profit, round(roe, 2) as roe from {TAIL.format(grain='<>', n=8)}"
)
def column_slices(spark, d):
    return rounded(P.tail(P.quarters(A.sheets(spark, d)), 8).select("security_id", *P.TIME, "revenue", "net_profit", "roe"), 2)


RAW = """(select security_id, fiscal, quarter, revenue, case when security_id % 13 = 0 and quarter = 2 then '-' when security_id % 13 = 1 and quarter = 3 then ''
  when security_id % 13 = 2 and quarter = 4 then null else format('{:,.2f}', revenue) end as revenue_raw from sheets)"""


@query("select security_id, fiscal, quarter, try_cast(replace(revenue_raw, ',', '') as double) as revenue from " + RAW)
def clean_numeric(spark, d):
    s = F.col("security_id") % 13
    q = F.col("quarter")
    raw = F.when((s == 0) & (q == 2), "-").when((s == 1) & (q == 3), "").when((s == 2) & (q == 4), None).otherwise(F.format_number("revenue", 2))
    df = A.sheets(spark, d).select("security_id", *P.TIME, raw.alias("revenue"))
    return numbers.typed(df)


@query(
    """select security_id, fiscal, quarter, round(case when count(revenue) over w = 4 then avg(revenue) over w end, 8) as ma4,
    round(case when count(revenue) over v = 8 then avg(revenue) over v end, 8) as ma8 from sheets where quarter <> 9
    window w as (partition by security_id order by fiscal, quarter rows between 3 preceding and current row),
    v as (partition by security_id order by fiscal, quarter rows between 7 preceding and current row)"""
)
def rolling_mean(spark, d):
    q = P.quarters(A.sheets(spark, d))
    return rounded(q.select("security_id", *P.TIME, P.rolling(F.avg, "revenue", 4).alias("ma4"), P.rolling(F.avg, "revenue", 8).alias("ma8")), 8)


@query(
    """select security_id, fiscal, quarter, round(case when count(net_profit) over w = 4 then stddev_samp(net_profit) over w end, 2) as std4 from sheets where quarter <> 9
    window w as (partition by security_id order by fiscal, quarter rows between 3 preceding and current row)"""
)
def rolling_std(spark, d):
    return rounded(P.quarters(A.sheets(spark, d)).select("security_id", *P.TIME, P.rolling(F.stddev_samp, "net_profit", 4).alias("std4")), 2)


@query("select security_id, fiscal, quarter, round(close / nullif(lag(close) over (partition by security_id order by fiscal, quarter), 0) - 1, 6) as change from sheets where quarter <> 9")
def pct_change(spark, d):
    return rounded(R.price_changes(A.sheets(spark, d)).drop("close"))


@query(
    """select security_id, fiscal, quarter, round(100 * (revenue / y - 1), 6) as yoy, round(100 * (revenue / q - 1), 6) as qoq from (
    select security_id, fiscal, quarter, revenue,
      case when lag(4 * fiscal + quarter, 4) over w = 4 * fiscal + quarter - 4 then lag(revenue, 4) over w end as y,
      case when lag(4 * fiscal + quarter, 1) over w = 4 * fiscal + quarter - 1 then lag(revenue, 1) over w end as q
    from sheets where quarter <> 9 window w as (partition by security_id order by fiscal, quarter))"""
)
def growth_yoy_qoq(spark, d):
    grown = lambda n, to: (100 * numbers.change(F.col("revenue"), P.lagged("revenue", n))).alias(to)
    return rounded(P.quarters(A.sheets(spark, d)).select("security_id", *P.TIME, grown(4, "yoy"), grown(1, "qoq")))


# Search


PART_SCORE = "case when lower(symbol) = '{q}' then 1000.0 when starts_with(lower(symbol), '{q}') then 900.0 when contains(lower(symbol), '{q}') then 800.0 end"


def _found(q: str, n: int) -> str:
    return f"select ord, symbol, name, cast(score as double) as score from (select *, {PART_SCORE.format(q=q)} as score from parts) where score is not null order by score desc, ord limit {n}"


def _hits(df: DataFrame) -> DataFrame:
    return rounded(df.select("ord", "symbol", "name", "score"))


@query(_found("brand#13", 5))
def search_exact(spark, d):
    return _hits(search(A.parts(spark, d), "Brand#13", 5))


@query(_found("brand#1", 50))
def search_prefix(spark, d):
    return _hits(search(A.parts(spark, d), "brand#1", 50))


@query(_found("rand#2", 20))
def search_contains(spark, d):
    return _hits(search(A.parts(spark, d), "rand#2", 20))


@query("select ord, symbol, name from parts order by ord limit 7")
def search_blank(spark, d):
    return search(A.parts(spark, d), "  ", 7).select("ord", "symbol", "name")


def _lcs(pairs: str) -> str:
    """SQL for lcs(a, b, n): the common subsequence of pairs of strings, a character of a at a time."""
    return f"""dp(a, b, i, r) as (select a, b, 0, list_transform(range(len(b) + 1), lambda x: cast(0 as bigint)) from ({pairs})
      union all select a, b, i + 1, [cast(0 as bigint)] || list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
        lambda k: greatest(r[k + 1], case when b[k] = substring(a, cast(i + 1 as int), 1) then r[k] + 1 else 0 end)))) from dp where i < len(a)),
    lcs as (select a, b, 2e2 * r[len(r)] / (len(a) + len(b)) as near from dp where i = len(a))"""


_Q = "brnd#13"


@query(
    f"""with recursive {_lcs(f"select distinct '{_Q}' as a, lower(symbol) as b from parts")}
    select ord, symbol, round(near, 6) as ratio from parts join lcs on b = lower(symbol) where near > 60"""
)
def search_fuzzy_symbol(spark, d):
    df = A.parts(spark, d)
    pairs = df.select("symbol").distinct().withColumn("ratio", similarity.ratio(F.lit(_Q), F.lower("symbol"))).where("ratio > 60")
    return rounded(df.select("ord", "symbol").join(pairs, "symbol").select("ord", "symbol", "ratio"))


_N = "cold widget"


def _windows(q: str) -> str:
    """SQL for wins(nm, a, b): the shorter of query and name with each window of the longer; both ways if they are of one length."""
    return f"""names as (select distinct lower(name) as nm from parts where coalesce(name, '') <> ''),
    sides as (select nm, '{q}' as a, nm as long from names where len(nm) >= {len(q)} union all select nm, nm, '{q}' from names where len(nm) <= {len(q)}),
    wins as (select nm, a, substring(long, cast(greatest(k, 1) as int), cast(least(k + len(a) - 1, len(long)) - greatest(k, 1) + 1 as int)) as b
      from sides, lateral (select unnest(range(2 - len(a), len(long) + 1)) as k))"""


_BEST = "best as (select nm, max(near) as near from wins join lcs using (a, b) group by nm)"


@query(
    f"""with recursive {_windows(_N)}, {_lcs("select distinct a, b from wins")}, {_BEST}
    select ord, name, round(near, 6) as ratio from parts join best on nm = lower(name) where near > 60"""
)
def search_fuzzy_name(spark, d):
    df = A.parts(spark, d)
    names = df.select("name").distinct().withColumn("ratio", similarity.partial_ratio(F.lit(_N), F.lower("name"))).where("ratio > 60")
    return rounded(df.select("ord", "name").join(names, "name").select("ord", "name", "ratio"))


def _ranked(q: str, n: int) -> str:
    """SQL for the whole search: literal scores, else those of similar symbols and names."""
    part = PART_SCORE.format(q=q)
    return f"""with recursive {_windows(q)}, {_lcs(f"select a, b from wins union select '{q}', lower(symbol) from parts")}, {_BEST},
    both_ as (select ord, symbol, name, {part} as literal, coalesce(l.near, 0) as sr, coalesce(best.near, 0) as nr from parts
      left join lcs l on l.a = '{q}' and l.b = lower(symbol) left join best on nm = lower(name)),
    found as (select ord, symbol, name, coalesce(literal, greatest(case when sr > 60 then 700 + sr else 0 end, case when nr > 60 then 500 + nr else 0 end)) as score from both_)
    select ord, symbol, name, round(cast(score as double), 6) as score from found where score > 0 order by found.score desc, ord limit {n}"""


@query(_ranked(_N, 25))
def search_ranked(spark, d):
    return _hits(search(A.parts(spark, d), _N, 25))


@query(_ranked("brand#1x", 40))
def search_ranked_symbols(spark, d):
    return _hits(search(A.parts(spark, d), "Brand#1x", 40))


# Payloads, made from the tables as they would be landed


def _answers(items: DataFrame) -> DataFrame:
    """(path, value): for each path its items, JSON texts in order of ord, as an answer."""
    data = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), ",")
    return items.groupBy("path").agg(F.concat(F.lit('{"status":true,"statusCode":200,"data":['), data, F.lit("]}")).alias("value"))


@query("select 'en' as language, symbol, name, market, industry, sector, cast(ord as varchar) as zip from securities")
def landed_catalog(spark, d):
    df = A.securities(spark, d)
    more = {"address": F.lit("x"), "zip": F.col("ord"), "tel": F.lit(""), "fax": F.lit(""), "web": F.lit(""), "unknown": F.lit(1)}
    item = F.to_json(F.struct("symbol", "name", "market", "industry", "sector", *[c.alias(n) for n, c in more.items()]), {"ignoreNullFields": "false"})
    array = F.concat(F.lit('[7,"x",'), F.array_join(F.collect_list(item), ","), F.lit("]"))
    return landed.securities(spark, df.groupBy(F.col("market").alias("path")).agg(array.alias("value")), "en").select("language", "symbol", "name", "market", "industry", "sector", "zip")


@query("select symbol as name, cast(security_id as varchar) as security_id, sector as board from securities")
def landed_listings(spark, d):
    df = A.securities(spark, d)
    item = F.to_json(F.struct(F.col("symbol").alias("name"), F.col("name").alias("th_name"), F.col("name").alias("en_name"), F.lit("TH").alias("exchange"), "security_id", F.col("sector").alias("board")))
    return landed.listings(spark, _answers(df.select(F.col("market").alias("path"), "ord", item.alias("item")))).select("name", "security_id", F.col("extra")["board"].alias("board"))


def _sheet_items(spark, d) -> DataFrame:
    df = A.sheets(spark, d)
    number = lambda c: F.format_number(c, 4)  # noqa: E731  text with thousands separators, as in real sheets
    fields = (F.col("security_id").cast("string").alias("security_id"), F.col("fiscal").cast("string").alias("fiscal"), "quarter", number("revenue").alias("revenue"), "close", F.coalesce(F.col("roe").cast("string"), F.lit("-")).alias("roe"))
    return df.select(F.concat(F.lit("sheet "), "security_id").alias("path"), (F.col("fiscal") * 10 + F.col("quarter")).alias("ord"), F.to_json(F.struct(*fields)).alias("item"))


@query("select cast(security_id as varchar) as security_id, fiscal, quarter, round(revenue, 2) as revenue, round(close, 6) as close, round(roe, 6) as roe from sheets")
def landed_sheets(spark, d):
    raw = numbers.typed(landed.sheets_raw(spark, _answers(_sheet_items(spark, d))))
    return rounded(raw.select("security_id", "fiscal", "quarter", "revenue", "close", "roe"), revenue=2)


@query(
    """select concat('sheet ', cast(security_id as varchar)) as path, case security_id % 6 when 0 then 'statusCode is 500' when 1 then 'no data' when 2 then 'missing or null: fiscal'
      when 3 then 'not an integer: quarter' else 'empty payload' end as fault from (select distinct security_id from sheets) where security_id % 6 <> 5"""
)
def landed_faults(spark, d):
    kind = F.regexp_extract("path", r"(\d+)", 1).cast("int") % 6
    broken = (
        F.when(kind == 0, F.regexp_replace("value", '"statusCode":200', '"statusCode":500')).when(kind == 1, F.lit('{"status":true,"statusCode":200,"data":[]}'))
        .when(kind == 2, F.regexp_replace("value", '"fiscal"', '"year"')).when(kind == 3, F.regexp_replace("value", r'"quarter":(\d)', '"quarter":$1.5')).when(kind == 4, F.lit(" ")).otherwise(F.col("value"))
    )
    return landed.faults(spark, _answers(_sheet_items(spark, d)).withColumn("value", broken), "sheets")


@query("select symbol, name, case when regexp_matches(name, '[\\x{0E00}-\\x{0E7F}]') then 'th' else 'en' end as found from (select symbol, case when ord % 2 = 0 then concat('ท ', name) else name end as name from securities)")
def detect_language(spark, d):
    df = A.securities(spark, d).select("symbol", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("ท "), "name")).otherwise(F.col("name")).alias("name"))
    return df.withColumn("found", language.detected(F.col("name")))


# Analyses


@query(f"select security_id, fiscal, quarter, revenue, round(revenue_yoy, 6) as revenue_yoy from {TAIL.format(grain='<>', n=8)}")
def revenue_growth(spark, d):
    return rounded(R.revenue_growth(A.sheets(spark, d)))


@query(f"select security_id, symbol, name, sector, revenue, net_profit, round(npm, 6) as npm, round(roe, 6) as roe from securities join {YEAR} using (security_id)")
def profitability(spark, d):
    return rounded(R.profitability(A.securities(spark, d), A.sheets(spark, d)))


@query(
    f"""with y as {YEAR} select security_id, 'profitability' as section, 'revenue' as metric, round(revenue, 6) as value from y
    union all select security_id, 'profitability', 'net_profit', round(net_profit, 6) from y union all select security_id, 'profitability', 'npm', round(npm, 6) from y
    union all select security_id, 'profitability', 'roe', round(roe, 6) from y union all select security_id, 'valuation', 'close', round(close, 6) from y
    union all select security_id, 'valuation', 'price_earning_ratio', round(price_earning_ratio, 6) from y"""
)
def health_report(spark, d):
    return rounded(R.health(A.sheets(spark, d)))


@query(
    f"""select sector, round(avg(roe), 6) as average_roe, count(roe) as analysed, any_value(total) as total from
    (select *, row_number() over (partition by sector order by ord) as p, count(*) over (partition by sector) as total from securities where sector <> '-')
    join {YEAR} using (security_id) where p <= 10 group by sector having count(roe) > 0"""
)
def sector_ranking(spark, d):
    return rounded(R.sector_ranking(A.securities(spark, d), A.sheets(spark, d)))


@query(
    f"""select security_id, symbol, name, market, round(y.revenue / 1000, 2) as revenue, round(y.net_profit / 1000, 2) as net_profit, round(y.roe, 6) as roe, round(q.close, 6) as close,
    round(q.price_earning_ratio, 6) as price_earning_ratio from securities join {YEAR} y using (security_id) left join {QUARTER} q using (security_id) where contains(lower(sector), '{SECTOR.lower()}')"""
)
def sector_deep_dive(spark, d):
    return rounded(R.sector_detail(A.securities(spark, d), A.sheets(spark, d), SECTOR))


@query(
    f"""select count(*) as n, round(avg(roe), 6) as average_roe, round(sum(round(revenue / 1000, 2)), 4) as total_revenue
    from securities join {YEAR} using (security_id) where contains(lower(sector), '{SECTOR.lower()}')"""
)
def sector_overview(spark, d):
    return rounded(R.sector_summary(A.securities(spark, d), A.sheets(spark, d), SECTOR), total_revenue=4)


@query(f"select security_id, symbol, fiscal, revenue from (select * from securities where contains(lower(sector), '{SECTOR.lower()}') order by ord limit 5) join {YEAR} using (security_id)")
def sector_compare(spark, d):
    return R.sector_revenue(A.securities(spark, d), A.sheets(spark, d), SECTOR)


@query(f"select security_id, symbol, round(roe, 6) as roe from (select * from securities where contains(lower(sector), '{SECTOR.lower()}') order by ord limit 5) join {YEAR} using (security_id)")
def sector_roe(spark, d):
    return rounded(R.sector_returns(A.securities(spark, d), A.sheets(spark, d), SECTOR, 5))


@query(f"select security_id, symbol, round(roe, 6) as roe from securities join {YEAR} using (security_id) where contains(lower(sector), '{SECTOR.lower()}')")
def sector_members_roe(spark, d):
    return rounded(R.sector_returns(A.securities(spark, d), A.sheets(spark, d), SECTOR))


_VALUE = f"select security_id, symbol, sector, round(roe, 6) as roe, round(price_earning_ratio, 6) as price_earning_ratio from securities join {YEAR} using (security_id) where price_earning_ratio > 0 and "


@query(_VALUE + "roe >= 10 and price_earning_ratio <= 150")
def value_screen(spark, d):
    return rounded(R.value_screen(A.securities(spark, d), A.sheets(spark, d), 10, 150))


@query(_VALUE + "roe > 10 and price_earning_ratio < 150")
def value_screen_strict(spark, d):
    return rounded(R.value_screen(A.securities(spark, d), A.sheets(spark, d), 10, 150, strict=True))


@query(
    f"""select security_id, symbol, name, sector, market, round(y.roe, 6) as roe, y.revenue as revenue, round(q.price_earning_ratio, 6) as price_earning_ratio
    from securities join {YEAR} y using (security_id) join {QUARTER} q using (security_id)
    where y.roe >= 10 and y.revenue >= 1000 and q.price_earning_ratio > 0 and q.price_earning_ratio <= 150"""
)
def value_screen_full(spark, d):
    return rounded(R.value_investing(A.securities(spark, d), A.sheets(spark, d), 10, 150, 1000))


@query(f"select security_id, symbol, name, sector, round(dividend_yield, 6) as dividend_yield, round(close, 6) as close from securities join {QUARTER} using (security_id) where dividend_yield >= 3")
def dividend_screen(spark, d):
    return rounded(R.dividends(A.securities(spark, d), A.sheets(spark, d)))


@query(f"select sector, count(*) as n from securities join {QUARTER} using (security_id) where dividend_yield >= 3 group by sector order by n desc, sector limit 5")
def dividend_sectors(spark, d):
    return C.counts(R.dividends(A.securities(spark, d), A.sheets(spark, d)), "sector").limit(5)


def _growth(revenue: int, profit: int) -> str:
    return f"""with cut as (select * from sheets where quarter <> 9),
    last as (select *, row_number() over (partition by security_id order by fiscal desc, quarter desc) as place, count(*) over (partition by security_id) as n from cut)
    select security_id, symbol, name, sector, market, round(revenue_yoy, 6) as revenue_yoy, round(net_profit_yoy, 6) as net_profit_yoy from securities join last using (security_id)
    where place = 1 and n >= 4 and revenue_yoy >= {revenue} and net_profit_yoy >= {profit}"""


@query(_growth(20, 25))
def growth_screen(spark, d):
    return rounded(R.growth_screen(A.securities(spark, d), A.sheets(spark, d)))


@query(_growth(-100, -1000))
def growth_screen_loose(spark, d):
    return rounded(R.growth_screen(A.securities(spark, d), A.sheets(spark, d), -100, -1000))


_PAIRS = """last8 as (select * from (select *, row_number() over (partition by security_id order by fiscal desc, quarter desc) as place from sheets where quarter <> 9 and revenue_yoy is not null) where place <= 8),
    enough as (select security_id from last8 group by security_id having count(*) >= 8),
    firsts as (select * from (select *, row_number() over (partition by sector order by ord) as p from securities where sector <> '-') where p <= 10),
    members as (select * from (select f.*, count(*) over (partition by sector) as m from firsts f join enough using (security_id)) where m >= 3),
    rws as (select sector, symbol, fiscal, quarter, revenue_yoy as v from members join last8 using (security_id)),
    pairs as (select a.sector as sector, a.symbol as a, b.symbol as b, count(*) as n,
      case when isnan(corr(a.v, b.v)) then null else corr(a.v, b.v) end as correlation
      from rws a join rws b on a.sector = b.sector and a.fiscal = b.fiscal and a.quarter = b.quarter and a.symbol < b.symbol group by 1, 2, 3)"""


@query(f"with {_PAIRS} select sector, a, b, n, round(correlation, 6) as correlation from pairs")
def correlation_pairs(spark, d):
    return rounded(R.correlations(A.securities(spark, d), A.sheets(spark, d)))


@query(
    f"""with {_PAIRS} select sector, a, b, round(correlation, 6) as correlation from pairs union all select sector, b, a, round(correlation, 6) from pairs
    union all select sector, a, a, 1.0::double from (select sector, a from pairs union select sector, b from pairs)"""
)
def correlation_matrix(spark, d):
    return rounded(R.correlation_matrix(R.correlations(A.securities(spark, d), A.sheets(spark, d))))


def _ma(m: str, n: int, digits: int) -> str:
    w = f"(partition by security_id order by fiscal, quarter rows between {n - 1} preceding and current row)"
    return f"round(case when count({m}) over {w} = {n} then avg({m}) over {w} end, {digits}) as {m}_ma{n}"


@query(
    f"""select * exclude (place) from (select security_id, fiscal, quarter, round(revenue, 2) as revenue, round(net_profit, 2) as net_profit, round(roe, 6) as roe,
    {_ma("revenue", 4, 8)}, {_ma("revenue", 8, 8)}, {_ma("net_profit", 4, 8)}, {_ma("net_profit", 8, 8)}, {_ma("roe", 4, 6)}, {_ma("roe", 8, 6)}, place from {TAIL.format(grain="<>", n=20)}) where place <= 8"""
)
def quarterly_trend(spark, d):
    df = R.quarterly_trend(A.sheets(spark, d))
    return rounded(df, 8, **{c: 6 for c in df.columns if c.startswith("roe")}, revenue=2, net_profit=2)


@query(
    """select security_id, fiscal, quarter, round(case when count(revenue_yoy) over w = 4 then avg(revenue_yoy) over w end, 6) as revenue_yoy_ma4,
    round(case when count(net_profit) over w = 4 then stddev_samp(net_profit) over w end, 2) as net_profit_std4, round(revenue / nullif(asset, 0), 6) as asset_turnover
    from sheets where quarter <> 9 window w as (partition by security_id order by fiscal, quarter rows between 3 preceding and current row)"""
)
def custom_metrics(spark, d):
    return rounded(R.custom_metrics(A.sheets(spark, d)), net_profit_std4=2)


@query(
    """select security_id, symbol, round(stddev_samp(change), 6) as volatility, count(change) as n from securities join (
    select security_id, close / nullif(lag(close) over (partition by security_id order by fiscal, quarter), 0) - 1 as change from sheets where quarter <> 9) using (security_id) group by 1, 2"""
)
def volatility(spark, d):
    return rounded(R.volatility(A.securities(spark, d), A.sheets(spark, d)))


@query(
    f"""with g as (select security_id, count(revenue) as n, arg_min(revenue, fiscal) as first, arg_max(revenue, fiscal) as last, avg(roe) as average_roe, max(roe) as max_roe, min(roe) as min_roe
    from {TAIL.format(grain="=", n=5)} group by security_id)
    select security_id, n, first, last, round(average_roe, 6) as average_roe, round(max_roe, 6) as max_roe, round(min_roe, 6) as min_roe,
    round(case when first > 0 and last >= 0 and n >= 2 then pow(last / first, 1.0 / (n - 1)) - 1 end, 6) as cagr, round(last / nullif(first, 0) - 1, 6) as total_change from g"""
)
def cagr_trend(spark, d):
    return rounded(R.growth_trend(A.sheets(spark, d)))


_HELD = "held(security_id, weight) as (values " + ", ".join(f"({i}, {w}::double)" for i, w in zip(HOLDINGS, WEIGHTS, strict=True)) + ")"
_HOLDINGS = f"""with {_HELD}, p as (select security_id, weight, avg(roe) as average_roe, stddev_samp(roe) as roe_std, avg(roe * weight) as contribution
    from {TAIL.format(grain="=", n=5)} join held using (security_id) group by 1, 2)"""


@query(f"{_HOLDINGS} select cast(security_id as bigint) as security_id, weight, round(average_roe, 6) as average_roe, round(roe_std, 6) as roe_std, round(contribution, 6) as contribution from p")
def portfolio_simulation(spark, d):
    return rounded(R.portfolio(A.sheets(spark, d), R.weights(spark, HOLDINGS, WEIGHTS)))


@query(f"{_HOLDINGS} select round(sum(contribution), 6) as expected_return, round(sum(roe_std * weight), 6) as risk, round(sum(contribution) / sum(roe_std * weight), 6) as return_by_risk from p")
def portfolio_totals(spark, d):
    return rounded(R.portfolio_summary(R.portfolio(A.sheets(spark, d), R.weights(spark, HOLDINGS, WEIGHTS))))


@query(f"select security_id, symbol, sector, revenue, round(roe, 6) as roe, count(*) over (partition by sector) as in_sector from (select * from securities where security_id < 5) join {YEAR} using (security_id)")
def portfolio_profile(spark, d):
    return rounded(R.holdings_profile(A.securities(spark, d), A.sheets(spark, d), HOLDINGS))


@query("select security_id, count(*) as n, count(*) >= 4 as valid from sheets where quarter <> 9 group by security_id")
def validate_panel(spark, d):
    return R.validated(A.sheets(spark, d), ("revenue", "net_profit"))


@query(
    """select security_id, count(*) as n, arg_min(t, 4 * fiscal + quarter) as first, arg_max(t, 4 * fiscal + quarter) as last from
    (select *, cast(fiscal as varchar) || 'Q' || cast(quarter as varchar) as t from sheets where quarter <> 9) group by security_id"""
)
def period_range(spark, d):
    return R.ranges(A.sheets(spark, d))


@query(f"with asked(symbol) as (values ('SUPPLIER#000000001'), ('NOBODY')) select symbol, fiscal, revenue from asked left join securities using (symbol) left join {YEAR} using (security_id)")
def safe_get(spark, d):
    asked = spark.createDataFrame([("SUPPLIER#000000001",), ("NOBODY",)], "symbol string")
    return R.safely(asked, A.securities(spark, d), A.sheets(spark, d))


@query(
    """with q as (select 'revenue' as metric, revenue as v from sheets where quarter <> 9 union all select 'roe', roe from sheets where quarter <> 9)
    select metric, count(v) as n, round(avg(v), 2) as mean, round(stddev_samp(v), 2) as std, round(min(v), 2) as min, round(max(v), 2) as max from q group by metric"""
)
def describe_panel(spark, d):
    return rounded(R.described(A.sheets(spark, d), ("revenue", "roe")), 2)


@query("select fiscal, case when quarter = 9 then 'year' else 'quarter' end as grain, count(*) as n, round(sum(revenue), 2) as revenue from sheets group by 1, 2")
def grain_totals(spark, d):
    grain = F.when(F.col("quarter") == S.YEAR, "year").otherwise("quarter").alias("grain")
    return rounded(A.sheets(spark, d).groupBy("fiscal", grain).agg(F.count("*").alias("n"), F.sum(F.col("revenue").cast("decimal(38,2)")).cast("double").alias("revenue")), 2)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_screen(spark, sf_dir)
