"""Fields of securities, listings and financial sheets, and their Thai labels."""

from __future__ import annotations

from pyspark.sql import types as T

# The 39 fields of a financial sheet with their Thai labels, in order.
THAI_LABELS = {
    "security_id": "รหัสหลักทรัพย์",
    "fiscal": "ปีการเงิน",
    "quarter": "ไตรมาส",
    "cash": "เงินสด",
    "da": "ค่าเสื่อมราคาและค่าตัดจำหน่าย",
    "debt_to_equity": "หนี้สิน/ทุน (เท่า)",
    "equity": "ส่วนของผู้ถือหุ้น",
    "earning_per_share": "กำไรต่อหุ้น (EPS)",
    "earning_per_share_yoy": "EPS การเติบโตเทียบปีก่อนหน้า (%)",
    "earning_per_share_qoq": "EPS การเติบโตต่อไตรมาส (%)",
    "gpm": "อัตรากำไรขั้นต้น (%)",
    "gross_profit": "กำไรขั้นต้น",
    "net_profit": "กำไรสุทธิ",
    "net_profit_yoy": "กำไรสุทธิ การเติบโตเทียบปีก่อนหน้า (%)",
    "net_profit_qoq": "กำไรสุทธิ การเติบโตต่อไตรมาส (%)",
    "npm": "อัตรากำไรสุทธิ (%)",
    "revenue": "รายได้รวม",
    "revenue_yoy": "รายได้รวม การเติบโตเทียบปีก่อนหน้า (%)",
    "revenue_qoq": "รายได้รวม การเติบโตต่อไตรมาส (%)",
    "roa": "ROA (%)",
    "roe": "ROE (%)",
    "sga": "ค่าใช้จ่ายในการขายและบริหาร",
    "sga_per_revenue": "อัตราส่วนการขายและบริหารต่อรายได้ (%)",
    "total_debt": "หนี้สินรวม",
    "dividend_yield": "อัตราส่วนเงินปันผลตอบแทน (%)",
    "book_value_per_share": "มูลค่าหุ้นทางบัญชีต่อหุ้น (บาท)",
    "close": "ราคาล่าสุด (บาท)",
    "mkt_cap": "มูลค่าหลักทรัพย์ตามราคาตลาด (ล้านบาท)",
    "price_earning_ratio": "P/E (เท่า)",
    "price_book_value": "P/BV (เท่า)",
    "ev_per_ebit_da": "EV / EBITDA",
    "ebit_dattm": "EBITDA",
    "paid_up_capital": "ทุนจดทะเบียน",
    "cash_cycle": "วงจรเงินสด (วัน)",
    "operating_activities": "กระแสเงินสด จากการดำเนินงาน",
    "investing_activities": "กระแสเงินสด จากการลงทุน",
    "financing_activities": "กระแสเงินสด จากกิจกรรมทางการเงิน",
    "asset": "สินทรัพย์รวม",
    "end_of_year_date": "วันสิ้นปี",
}
TIME_LABEL = {"time": "ช่วงเวลา"}

KEYS = ("security_id", "fiscal", "quarter")
METRICS = tuple(f for f in THAI_LABELS if f not in KEYS)
#: Kept as text: its format is not documented.
TEXT_METRICS = ("end_of_year_date",)
YEAR = 9  # the quarter of a full year's row

_S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


SECURITY_FIELDS = ("symbol", "name", "market", "industry", "sector", "address", "zip", "tel", "fax", "web")
SECURITY_OPTIONAL = ("industry", "address", "web")  # the key must be there, its value may be null
SECURITY = _struct(*SECURITY_FIELDS)
LISTING_FIELDS = ("name", "th_name", "en_name", "security_id", "exchange")

METADATA = T.StructType(
    [
        T.StructField("last_updated", _S),
        T.StructField("total_securities", T.IntegerType()),
        T.StructField("markets", T.StructType([T.StructField("SET", T.IntegerType()), T.StructField("mai", T.IntegerType())])),
        T.StructField("sectors", T.MapType(_S, T.IntegerType())),
        T.StructField("data_source", _S),
        T.StructField("api_endpoints", _struct("all_securities", "compact", "metadata", "by_sector", "market_set", "market_mai")),
        T.StructField("export_info", T.StructType([T.StructField("generated_by", _S), T.StructField("files_exported", T.ArrayType(_S)), T.StructField("schema", T.MapType(_S, _S))])),
    ]
)
