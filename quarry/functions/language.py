"""Which language a text is in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_THAI = re.compile("[฀-๿]")


def detect(text: str) -> str:
    return "th" if _THAI.search(text) else "en"


def detected(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{0E00}-\x{0E7F}]"), F.lit("th")).otherwise(F.lit("en"))
