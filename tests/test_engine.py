"""Catalog, panels, search, analyses and facades on small tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.api import Market, Securities, Security
from quarry.operators import catalog as C
from quarry.operators import panel as P
from quarry.operators.search import scored, search
from quarry.plans import analytics as R

CATALOG = [
    ("en", 0, "CPALL", "CP All Public", "Commerce", "SET", None, ""),
    ("en", 1, "CPF", "Charoen Pokphand Foods", "Food", "SET", "Agro", "w"),
    ("en", 2, "ACP", "Acme Parts", "-", "mai", None, None),
    ("en", 3, "KBANK", "Kasikornbank", "Banking & 50%_a.b", "SET", "Fin", "k"),
    ("en", 4, "CPF", "Second", None, "MAI", "", "x"),
    ("en", 5, "SCB", "Siam Commercial Bank", "", "SET", "Fin", "s"),
    ("th", 0, "KBANK", "ธนาคารกสิกรไทย", "ธนาคาร", "SET", "Fin", "k"),
    ("th", 1, "CPALL", "ซีพี ออลล์", "พาณิชย์", "SET", None, ""),
]

U1, U2 = "3f2504e0-4f89-41d3-9a0c-0305e82c3301", "3f2504e0-4f89-41d3-9a0c-0305e82c3302"


@pytest.fixture(scope="module")
def market(spark):
    cat = spark.createDataFrame(CATALOG, "language string, ord long, symbol string, name string, sector string, market string, industry string, web string")
    listings = spark.createDataFrame([("KBANK", U1, 0), ("CPALL", U2, 1), ("KBANK", "u9", 2), ("SCB", "u4", 3)], "name string, security_id string, ord long")
    rows = [(U1, y, q, str(100 * (y - 2014) + q), "1,5" if q == 9 else "-", "7") for y in range(2020, 2014, -1) for q in (9, 4, 2, 3, 1)]
    sheets = spark.createDataFrame(rows, "security_id string, fiscal int, quarter int, revenue string, roe string, close string")
    return Market(cat, listings, sheets)


def test_lists_and_filters(market):
    s = Securities(market)
    assert s.list() == ["CPALL", "CPF", "ACP", "KBANK", "CPF", "SCB"]
    assert s.list_with_names().columns == ["symbol", "name", "industry", "sector", "market"]
    assert s.filter_by_sector(" 50%_A.B ") == ["KBANK"] and s.filter_by_sector("%") == ["KBANK"] and s.filter_by_sector("ธนาคาร", "th") == ["KBANK"]
    assert s.filter_by_market("mai") == ["ACP", "CPF"]
    for call in (lambda: s.filter_by_sector("  "), lambda: s.filter_by_market(""), lambda: s.list("de"), lambda: C.head(market.catalog, -1)):
        with pytest.raises(ValueError):
            call()


def test_security(market):
    k = Security(market, "cpall")
    assert (k.symbol, k.company_name, k.industry, k.website) == ("CPALL", "CP All Public", "-", "-")
    assert repr(k) == '<Security "CPALL" - updated just now>'
    assert Security(market, "CPF").company_name == "Charoen Pokphand Foods"
    with pytest.raises(ValueError):
        Security(market, "NONE")
    with pytest.raises(ValueError):
        _ = k.quarter_dataframe  # listed, but without a sheet
    with pytest.raises(ValueError, match="no UUID"):
        _ = Security(market, "SCB").quarter_dataframe
    with pytest.raises(AttributeError):
        _ = k.zip


def test_panels(market):
    q = Security(market, "KBANK").quarter_dataframe
    assert q.count() == 24 and set(q.columns) == {"revenue", "roe", "close", "time", "period_start"}
    first = q.orderBy("period_start").first()
    assert first.time == "2015Q1" and str(first.period_start) == "2015-01-01"
    y = Security(market, "KBANK", "th").yearly_dataframe
    assert y.count() == 6 and "รายได้รวม" in y.columns and "ปีการเงิน" in y.columns
    bad = market.sheets.limit(1).withColumn("quarter", F.lit(5))
    with pytest.raises(PySparkException):
        P.quarterly(bad).collect()


@pytest.mark.parametrize(
    "query,want",
    [
        ("cpf", [("CPF", 1000.0), ("CPF", 1000.0), ("ACP", 700 + 200 / 3)]),
        ("cp", [("CPALL", 900.0), ("CPF", 900.0), ("CPF", 900.0), ("ACP", 800.0)]),
        ("kbnk", [("KBANK", 700 + 800 / 9)]),
        ("kasikorn", [("KBANK", 600.0)]),
        ("zzzz", []),
    ],
)
def test_search(market, query, want):
    got = [(r.symbol, r.score) for r in search(market.catalog, query, 5).collect()]
    for (s, score), (gs, gscore) in zip(want, got, strict=False):
        assert s == gs and (score is None or gscore == pytest.approx(score))
    assert bool(got) == bool(want)


def test_search_rules(market, spark):
    assert [r.symbol for r in search(market.catalog, " ", 2).collect()] == ["CPALL", "CPF"]
    assert [s.symbol for s in Securities(market).search("ธนาคาร")][0] == "KBANK"
    assert Securities(market).search("ธนาคาร")[0].language == "th"
    with pytest.raises(ValueError):
        search(market.catalog, "a", -1)
    # 60 itself is no match: lcs 3 of 5 + 5
    df = spark.createDataFrame([("en", 0, "abcxy", None)], "language string, ord long, symbol string, name string")
    assert scored(df, "abcpq").count() == 0


def frame(spark, rows):
    return spark.createDataFrame(rows, "security_id long, fiscal int, quarter int, revenue double, net_profit double, roe double, close double, revenue_yoy double, asset double")


def test_windows_need_whole_frames(spark):
    rows = [(1, 2020 + k // 4, k % 4 + 1, float(k), None if k == 5 else 1.0, 1.0, 0.0 if k == 2 else 2.0, 1.0, 2.0) for k in (3, 1, 0, 2, 4, 5, 6)]
    df = frame(spark, rows)
    got = df.select("fiscal", "quarter", P.rolling(F.avg, "revenue", 4).alias("a"), P.rolling(F.avg, "net_profit", 2).alias("b"), P.lagged("revenue", 4).alias("y")).orderBy("fiscal", "quarter").collect()
    assert [r.a for r in got] == [None, None, None, 1.5, 2.5, 3.5, 4.5]
    assert [r.b for r in got] == [None, 1.0, 1.0, 1.0, 1.0, None, None]
    assert [r.y for r in got] == [None, None, None, None, 0.0, 1.0, 2.0]
    change = {(r.fiscal, r.quarter): r.change for r in R.price_changes(df).collect()}
    assert change[2020, 3] == -1.0 and change[2020, 4] is None
    gap = df.where("not (fiscal = 2020 and quarter = 2)")
    assert {r.y for r in gap.select(P.lagged("revenue", 1).alias("y"), "fiscal", "quarter").where("fiscal = 2020 and quarter = 3").collect()} == {None}


def test_latest_and_tail(spark):
    df = frame(spark, [(1, 2020, q, float(q), None, None, 1.0, 1.0, 1.0) for q in (2, 9, 1, 4, 3)] + [(1, 2019, 9, 8.0, 1.0, 2.0, 1.0, 1.0, 1.0)])
    r = R.latest_year(df, "fiscal", "roe").first()
    assert (r.fiscal, r.roe) == (2020, None)  # a null at the latest time stays
    assert sorted(x.quarter for x in P.tail(P.quarters(df), 2).collect()) == [3, 4]
    assert R.ranges(df).first()[1:] == (4, "2020Q1", "2020Q4")


def test_correlation_of_a_constant_is_null(spark):
    cat = spark.createDataFrame([(i, "S" + str(i), "X", i) for i in range(3)], "security_id long, symbol string, sector string, ord long")
    rows = [(i, 2018 + k // 4, k % 4 + 1, 1.0, 1.0, 1.0, 1.0, {0: float(k), 1: -2.0 * k, 2: 5.0}[i], 1.0) for i in range(3) for k in range(8)]
    got = {(r.a, r.b): r.correlation for r in R.correlations(cat, frame(spark, rows)).collect()}
    assert got[("S0", "S1")] == pytest.approx(-1.0) and got[("S0", "S2")] is None
    assert R.correlations(cat.limit(2), frame(spark, rows)).count() == 0
    assert R.correlation_matrix(R.correlations(cat, frame(spark, rows))).count() == 9


def test_growth_trend_and_portfolio(spark):
    df = frame(spark, [(1, 2016 + k, 9, 100.0 * 2**k, 1.0, float(k), 1.0, 1.0, 1.0) for k in range(5)] + [(2, 2020, 9, 5.0, 1.0, 3.0, 1.0, 1.0, 1.0), (3, 2019, 9, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0), (3, 2020, 9, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0)])
    got = {r.security_id: r for r in R.growth_trend(df).collect()}
    assert got[1].cagr == pytest.approx(1.0) and got[1].total_change == 15.0 and got[2].cagr is None and got[3].cagr is None and got[3].total_change is None
    hold = R.portfolio(df, R.weights(spark, [1, 2], [0.5, 0.5]))
    rows = {r.security_id: r for r in hold.collect()}
    assert rows[1].average_roe == 2.0 and rows[1].roe_std == pytest.approx(1.5811388) and rows[2].roe_std is None
    s = R.portfolio_summary(hold).first()
    assert s.expected_return == 2.5 and s.return_by_risk == pytest.approx(2.5 / (1.5811388 / 2))
    with pytest.raises(ValueError):
        R.weights(spark, [1, 2], [1.0])


def test_plans_push_down_and_prune(spark, tmp_path, market):
    market.sheets.write.parquet(str(tmp_path / "s"))
    plan = R.latest_year(spark.read.parquet(str(tmp_path / "s")), "revenue")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(quarter,9)" in plan and "close" not in plan.split("ReadSchema")[1]


def test_sector_return_on_assets(spark):
    cat = spark.createDataFrame([(1, "A", "a", "m", "Bank"), (2, "B", "b", "m", "Bank"), (3, "C", "c", "m", "Food")], "security_id int, symbol string, name string, market string, sector string")
    rows = [(k, year, 9, 1000.0, 100.0, 10.0, k + year - 2020.0, None, None) for k in (1, 2, 3) for year in (2019, 2020)]
    sheets = spark.createDataFrame(rows, "security_id int, fiscal int, quarter int, revenue double, net_profit double, roe double, roa double, close double, price_earning_ratio double")
    assert [(r.symbol, r.roa) for r in R.sector_detail(cat, sheets, "bank").collect()] == [("A", 1.0), ("B", 2.0)]
    assert R.sector_summary(cat, sheets, "bank").first().asDict() == {"n": 2, "average_roe": 10.0, "average_roa": 1.5, "total_revenue": 2.0}
    assert "average_roa" not in R.sector_summary(cat, sheets.drop("roa"), "bank").columns
