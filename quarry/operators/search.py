"""Ranked search of the catalog by symbol and name, in English or Thai.

Scores: 1000 for the symbol itself, 900 for its start, 800 for a part of it; else 700 and the
similarity of the symbol if that is over 60, or 500 and that of the name's best part if that is
over 60, whichever is more. Each distinct symbol and each distinct name is compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.language import detect
from quarry.functions.similarity import partial_ratio, ratio
from quarry.operators.catalog import head, of_language

LEAST = 60.0


def literal(query: str, symbol: Column) -> Column:
    """The score of a symbol in lower case that has the query in it, else null."""
    q = F.lit(query.lower())
    return F.when(symbol == q, F.lit(1000.0)).when(F.startswith(symbol, q), F.lit(900.0)).when(F.contains(symbol, q), F.lit(800.0))


def by_symbol(query: str, symbol: Column) -> Column:
    """The score of a similar symbol in lower case, 0 for none."""
    near = ratio(F.lit(query.lower()), symbol)
    return F.when(near > LEAST, 700 + near).otherwise(F.lit(0.0))


def by_name(query: str, name: Column) -> Column:
    """The score of a name in lower case, 0 for none and for no name."""
    near = partial_ratio(F.lit(query.lower()), name)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(0.0)).when(near > LEAST, 500 + near).otherwise(F.lit(0.0))


def scored(catalog: DataFrame, query: str) -> DataFrame:
    """Rows of the catalog with a score over 0; only rows without the query in their symbol are compared."""
    df = catalog.withColumn("score", literal(query, F.lower("symbol")))
    rest = df.where("score is null").drop("score")
    symbols = rest.select(F.col("symbol").alias("_symbol")).distinct().withColumn("_by_symbol", by_symbol(query, F.lower("_symbol")))
    names = rest.select(F.col("name").alias("_name")).distinct().withColumn("_by_name", by_name(query, F.lower("_name")))
    rest = rest.join(symbols, F.col("symbol") == F.col("_symbol")).join(names, F.col("name").eqNullSafe(F.col("_name")))
    rest = rest.withColumn("score", F.greatest("_by_symbol", "_by_name")).where("score > 0").drop("_symbol", "_name", "_by_symbol", "_by_name")
    return df.where("score is not null").unionByName(rest)


def search(catalog: DataFrame, query: str, limit: int = 5, language: str = "auto") -> DataFrame:
    """The best matches, ties in the order of the source; a blank query gives the first ones."""
    if limit < 0:
        raise ValueError("a limit can't be negative")
    if "language" in catalog.columns:
        catalog = of_language(catalog, detect(query) if language == "auto" else language)
    if not query.strip():
        return head(catalog, limit).withColumn("score", F.lit(None).cast("double"))
    return scored(catalog, query).orderBy(F.desc("score"), "ord").limit(limit)
