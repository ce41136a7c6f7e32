"""Numbers from text, and arithmetic that gives null where there is no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.schema import METRICS, TEXT_METRICS

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def cleaned(text: Column) -> Column:
    """Text with thousands separators as a double; null for anything that is no number."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.when(plain.rlike(_NUMBER), F.trim(plain).try_cast("double"))


def typed(raw: DataFrame) -> DataFrame:
    """Sheets with metrics as doubles; texts that are no metrics stay."""
    kinds = dict(raw.dtypes)
    number = {m: cleaned(F.col(m)) for m in METRICS if m not in TEXT_METRICS and kinds.get(m) == "string"}
    return raw.withColumns(number)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return a / F.nullif(b, F.lit(0.0))


def change(now: Column, before: Column) -> Column:
    """The relative change from before to now."""
    return ratio(now, before) - 1
