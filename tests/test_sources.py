"""Ingest of landed payloads."""

import json

import pytest
from pyspark.errors import PySparkException

from quarry.functions import numbers
from quarry.sources import landed, schema
from quarry.streaming import snapshots


def security(**k):
    return {"symbol": "ABC", "name": "Abc", "market": "SET", "industry": None, "sector": "-", "address": "x", "zip": "1", "tel": "2", "fax": "3", "web": ""} | k


def put(tmp_path, name, value):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(p)


def test_catalog_keeps_order_and_drops_what_is_no_object(spark, tmp_path):
    at = put(tmp_path, "all_th.json", [security(symbol="B", name="ธนาคาร"), 7, "x", security(symbol="A", zip=10110, more=1)])
    rows = landed.securities(spark, at, "th").orderBy("ord").collect()
    assert [(r.ord, r.symbol, r.language, r.name, r.zip) for r in rows] == [(0, "B", "th", "ธนาคาร", "1"), (1, "A", "th", "Abc", "10110")]
    assert rows[0].industry is None and "more" not in rows[0].asDict()
    with pytest.raises(ValueError):
        landed.securities(spark, at, "de")


@pytest.mark.parametrize("change", [{"name": None}, "drop", "drop_optional"])
def test_catalog_contract(spark, tmp_path, change):
    s = security()
    if isinstance(change, dict):
        s |= change
    else:
        del s["name" if change == "drop" else "web"]
    with pytest.raises(PySparkException, match="missing or null"):
        landed.securities(spark, put(tmp_path, "c.json", [s]), "en").collect()


def sheet(**k):
    return {"security_id": "u1", "fiscal": 2020, "quarter": 1, "revenue": "1,234.5"} | k


def test_sheets_take_integers_as_text_and_numbers_as_text(spark, tmp_path):
    put(tmp_path, "s/a.json", {"status": True, "statusCode": 200, "data": [sheet(fiscal="2020", cash=5), sheet(quarter=9, new=1)]})
    put(tmp_path, "s/b.json", {"status": True, "statusCode": 200, "data": [sheet(security_id="u2", revenue="-")]})
    raw = landed.sheets_raw(spark, str(tmp_path / "s"))
    assert set(raw.columns) == {*schema.KEYS, *schema.METRICS, "ord"} and len(schema.THAI_LABELS) == 39
    rows = {(r.security_id, r.quarter): r for r in numbers.typed(raw).collect()}
    assert rows["u1", 1].revenue == 1234.5 and rows["u1", 1].cash == 5.0 and rows["u1", 1].fiscal == 2020 and rows["u2", 1].revenue is None


@pytest.mark.parametrize(
    "payload", [{"status": True, "statusCode": 500, "data": [sheet()]}, {"status": True, "statusCode": 200, "data": []}, {"status": True, "statusCode": 200, "data": [sheet(fiscal=2020.5)]}, {"status": True, "statusCode": 200, "data": [{"fiscal": 2020}]}]
)
def test_sheet_contract(spark, tmp_path, payload):
    with pytest.raises(PySparkException):
        landed.sheets_raw(spark, put(tmp_path, "s.json", payload)).collect()


def test_one_bad_item_rejects_its_payload_whatever_is_read(spark, tmp_path):
    bad = security(symbol="B")
    del bad["market"]
    df = landed.securities(spark, put(tmp_path, "c.json", [security(symbol="A"), bad]), "en")
    for view in (df.select("symbol"), df.where("symbol = 'A'").select("ord"), df.groupBy().count(), df.limit(1)):
        with pytest.raises(PySparkException, match="missing or null: market"):
            view.collect()
    put(tmp_path, "s/a.json", {"status": True, "statusCode": 200, "data": [sheet(), sheet(quarter=2.5)]})
    with pytest.raises(PySparkException, match="not an integer: quarter"):
        landed.sheets_raw(spark, str(tmp_path / "s")).select("revenue").collect()


@pytest.mark.parametrize("read", [lambda s, p: landed.securities(s, p, "en"), landed.listings, landed.sheets_raw, landed.metadata])
def test_an_empty_payload_is_an_error(spark, tmp_path, read):
    (tmp_path / "e.json").write_text(" \n")
    with pytest.raises(PySparkException, match="empty payload in .*e.json"):
        read(spark, str(tmp_path / "e.json")).collect()


def test_faults_are_listed_by_path(spark, tmp_path):
    put(tmp_path, "s/a.json", {"status": True, "statusCode": 200, "data": [sheet()]})
    put(tmp_path, "s/b.json", {"status": True, "data": [sheet()]})
    put(tmp_path, "s/c.json", [1])
    (tmp_path / "s/d.json").write_text("")
    got = {r.path[-6:]: r.fault for r in landed.faults(spark, str(tmp_path / "s"), "sheets").collect()}
    assert got == {"b.json": "statusCode is missing", "c.json": "statusCode is missing", "d.json": "empty payload"}


def test_listings_keep_other_keys(spark, tmp_path):
    one = {"name": "PTT", "th_name": "ปตท", "en_name": "Ptt", "security_id": "u", "exchange": "TH", "rank": 3}
    r = landed.listings(spark, put(tmp_path, "l.json", {"status": True, "statusCode": 200, "data": [one]})).first()
    assert (r.name, r.security_id, r.extra) == ("PTT", "u", {"rank": "3"})


def test_metadata(spark, tmp_path):
    m = {"last_updated": "2024", "total_securities": 2, "markets": {"SET": 1, "mai": 1}, "sectors": {"Banking": 2}, "export_info": {"schema": {"a": "b"}, "files_exported": ["x"]}}
    r = landed.metadata(spark, put(tmp_path, "m.json", m)).first()
    assert r.markets.mai == 1 and r.sectors == {"Banking": 2} and r.export_info.files_exported == ["x"]


@pytest.mark.parametrize("text,want", [("1,234.5", 1234.5), ("-", None), ("", None), (None, None), ("NaN", None), ("5d", None), (" 7 ", 7.0), ("1e3", 1000.0), ("1_000", None), ("-.5", -0.5)])
def test_cleaned(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(numbers.cleaned(df.x)).first()[0] == want


def test_sinks_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2)], "k string, t string, v int").selectExpr("k", "cast(t as timestamp) t", "v")
    from pyspark.sql import functions as F

    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert [r.v for r in landed.fresh_snapshots(df, "k", "t", now).collect()] == [2]
    assert landed.fresh_snapshots(df, "k", "t", F.lit("2024-02-01").cast("timestamp")).count() == 0
    thai = df.select(F.col("v").alias(schema.THAI_LABELS["debt_to_equity"]))
    landed.write(thai, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == thai.columns
    with pytest.raises(ValueError):
        landed.write(df, "x", "xlsx")


def test_stream_of_landed_sheets(spark, tmp_path):
    rows = [sheet(landed_at="2024-01-01T00:00:00Z"), sheet(revenue="9", landed_at="2024-01-02T00:00:00Z")]
    (tmp_path / "in").mkdir()
    for k, r in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(r) + "\n")
    snapshots.keep_snapshot(snapshots.arriving(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"))
    got = snapshots.latest_versions(spark.read.schema(snapshots.ROW).parquet(str(tmp_path / "t")))
    assert [r.revenue for r in got.collect()] == ["9"]
