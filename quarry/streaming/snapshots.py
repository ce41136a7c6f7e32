"""Landed sheets as a stream: new files are appended, the latest version of each row is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.schema import KEYS, METRICS

ROW = T.StructType(
    [T.StructField("security_id", T.StringType()), T.StructField("fiscal", T.IntegerType()), T.StructField("quarter", T.IntegerType())]
    + [T.StructField(m, T.StringType()) for m in METRICS]
    + [T.StructField("landed_at", T.TimestampType())]
)


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Rows of JSON-lines files as they land."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_a_batch).json(path)


def latest_versions(rows: DataFrame) -> DataFrame:
    """Of each (security, fiscal, quarter) the row that landed last."""
    names = [c for c in rows.columns if c not in KEYS]
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*names), "landed_at").alias("r")).select(*KEYS, "r.*")


def keep_snapshot(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what has landed so far to a parquet table, by year, and stop."""
    query = stream.writeStream.format("parquet").partitionBy("fiscal").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query
