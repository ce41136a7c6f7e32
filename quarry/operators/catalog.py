"""The catalog: listing, filters, lookup, profile, and joins with listings and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROFILE = {"symbol": "symbol", "company_name": "name", "industry": "industry", "sector": "sector", "market": "market", "address": "address", "website": "web"}


def of_language(catalog: DataFrame, language: str) -> DataFrame:
    from quarry.sources.landed import check_language

    return catalog.where(F.col("language") == check_language(language))


def symbols(catalog: DataFrame) -> DataFrame:
    """All symbols in the order of the source."""
    return catalog.orderBy("ord").select("symbol")


def with_names(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("ord").select("symbol", "name", "industry", "sector", "market")


def in_sector(catalog: DataFrame, sector: str) -> DataFrame:
    """Securities whose sector contains the text, in either case; securities without sector are out."""
    if not (sector := sector.strip()):
        raise ValueError("the sector is empty")
    return catalog.where(F.contains(F.lower("sector"), F.lit(sector.lower())) & (F.col("sector") != ""))


def in_market(catalog: DataFrame, market: str) -> DataFrame:
    """Securities of a market, in either case."""
    if not (market := market.strip()):
        raise ValueError("the market is empty")
    return catalog.where(F.upper("market") == market.upper())


def head(catalog: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("a limit can't be negative")
    return catalog.orderBy("ord").limit(n)


def lookup(catalog: DataFrame, symbol: str, column: str = "symbol") -> DataFrame:
    """The first security of exactly this symbol; no row if there is none."""
    return head(catalog.where(F.col(column) == symbol), 1)


def profile(catalog: DataFrame) -> DataFrame:
    """What a security shows of itself, a dash where there is nothing."""
    return catalog.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-")).alias(k) for k, c in PROFILE.items() if c in catalog.columns])


def to_sheets(catalog: DataFrame, listings: DataFrame, sheets: DataFrame) -> DataFrame:
    """Sheets of all securities of a catalog, by way of the listing of the same symbol."""
    first = listings.groupBy(F.col("name").alias("symbol")).agg(F.min_by("security_id", "ord").alias("security_id"))
    return catalog.join(first, "symbol").join(sheets, "security_id")


def without_sheets(catalog: DataFrame, listings: DataFrame, sheets: DataFrame) -> DataFrame:
    known = listings.select(F.col("name").alias("symbol"), "security_id").join(sheets.select("security_id"), "security_id", "left_semi")
    return catalog.join(known, "symbol", "left_anti")


def bilingual(catalog: DataFrame) -> DataFrame:
    """Names of each symbol in both languages."""
    pick = lambda language: catalog.where(F.col("language") == language).select("symbol", F.col("name").alias(f"name_{language}"))
    return pick("en").join(pick("th"), "symbol")


def counts(catalog: DataFrame, column: str) -> DataFrame:
    """Securities by a column, most first; nulls are left out."""
    return catalog.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def sectors(catalog: DataFrame) -> DataFrame:
    return catalog.where("sector is not null and sector <> '-'").select("sector").distinct()


def agreement(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sectors and markets whose counts in catalog and metadata differ."""
    said = metadata.select(F.explode("sectors").alias("name", "said")).select(F.lit("sector").alias("kind"), "name", "said")
    for m in ("SET", "mai"):
        said = said.unionByName(metadata.select(F.lit("market").alias("kind"), F.lit(m).alias("name"), F.col(f"markets.{m}").alias("said")))
    found = counts(catalog, "sector").select(F.lit("sector").alias("kind"), F.col("sector").alias("name"), "n")
    found = found.unionByName(counts(catalog, "market").select(F.lit("market").alias("kind"), F.col("market").alias("name"), "n"))
    both = said.join(found, ["kind", "name"], "full")
    return both.where(~F.col("said").cast("long").eqNullSafe(F.col("n"))).orderBy("kind", "name")
