"""Sources: JSON payloads landed as files, read in bulk and checked.

Payloads are fetched outside the engine (with whatever retries and cache that takes) and landed
below a folder; a snapshot is what a cache entry was. Every reader here reads all files of a kind
in one distributed scan and keeps the order of the source in ``ord``.

Checks follow the payload contracts: required keys must be there, integers may come as text of
an integer, numbers in text fields are taken as text, unknown keys are ignored (listings keep
them in ``extra``). Array items that are no objects are dropped. One item at fault rejects its whole
payload: the array is checked before its items become rows, so that no projection or filter on
the rows leaves a check out. Readers raise; ``faults`` lists payloads and what is wrong with them.

Readers also take payloads as a DataFrame (path, value), wherever these were landed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.sources import schema as S

LANGUAGES = ("en", "th")
#: Age in seconds up to which a snapshot counts as fresh.
TTL = 24 * 60 * 60


class SourceError(ValueError):
    """A payload that breaks its contract."""


def check_language(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {', '.join(LANGUAGES)}, not {language!r}")
    return language


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text; files of no bytes too, which Spark's scans leave out."""
    texts = spark.read.text(path, wholetext=True)
    files = spark.createDataFrame([(f.replace("file:///", "file:/"),) for f in texts.inputFiles()], "path string")  # as in _metadata
    at = F.col("_metadata.file_path").alias("path")
    empty = files.join(spark.read.format("binaryFile").load(path).select(at), "path", "left_anti")  # reads no contents
    rows = texts.select(at, F.btrim("value", F.lit(" \t\r\n")).alias("value"))
    return rows.unionByName(empty.select("path", F.lit("").alias("value")))


def _given(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    return payloads(spark, source) if isinstance(source, str) else source


def _objects(array_text: Column) -> Column:
    """The items of a JSON array as texts, but for items that are no objects."""
    items = F.from_json(array_text, T.ArrayType(T.StringType()))
    return F.filter(items, lambda x: F.substring(F.ltrim(x), 1, 1) == "{")


def _item_fault(item: Column, names: tuple[str, ...], optional: tuple[str, ...], integers: tuple[str, ...]) -> Column:
    """What is wrong with an item: a missing key, a null where a value is required, no integer."""
    keys, found = F.json_object_keys(item), []
    for name in names:
        bad = ~F.coalesce(F.array_contains(keys, name), F.lit(False))
        value = F.get_json_object(item, f"$.{name}")
        found.append(F.when(bad if name in optional else bad | value.isNull(), F.lit(f"missing or null: {name}")))
        if name in integers:
            whole = value.rlike(r"^\s*[+-]?\d+\s*$") & value.try_cast("int").isNotNull()
            found.append(F.when(~F.coalesce(whole, F.lit(False)), F.lit(f"not an integer: {name}")))
    return F.coalesce(*found)


def _first_fault(items: Column, names: tuple[str, ...], optional: tuple[str, ...] = (), integers: tuple[str, ...] = ()) -> Column:
    return F.get(F.filter(F.transform(items, lambda x: _item_fault(x, names, optional, integers)), lambda m: m.isNotNull()), 0)


#: Each kind of payload: whether it is an answer {status, statusCode, data}, its items' keys, those that may be null, integers.
KINDS = {
    "catalog": (False, S.SECURITY_FIELDS, S.SECURITY_OPTIONAL, ()),
    "listings": (True, S.LISTING_FIELDS, (), ()),
    "sheets": (True, S.KEYS, (), ("fiscal", "quarter")),
}


def _items(kind: str) -> Column:
    return _objects(F.get_json_object("value", "$.data") if KINDS[kind][0] else F.col("value"))


def _fault(kind: str) -> Column:
    """What is wrong with a payload, null if nothing is."""
    answer, names, optional, integers = KINDS[kind]
    items, code = _items(kind), F.coalesce(F.get_json_object("value", "$.statusCode"), F.lit("missing"))
    fault = F.when(~F.coalesce(F.col("value").rlike(r"\S"), F.lit(False)), F.lit("empty payload"))
    if answer:
        fault = fault.when(code != "200", F.concat(F.lit("statusCode is "), code)).when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("no data"))
    else:
        fault = fault.when(items.isNull(), F.lit("no array"))
    return fault.otherwise(_first_fault(items, names, optional, integers))


def faults(spark: SparkSession, source: str | DataFrame, kind: str) -> DataFrame:
    """(path, fault) of the payloads that break their contract."""
    return _given(spark, source).select("path", _fault(kind).alias("fault")).where("fault is not null")


def _rows(spark: SparkSession, source: str | DataFrame, kind: str) -> DataFrame:
    """(path, ord, item) of sound payloads; an error for any other."""
    df = _given(spark, source).withColumn("_fault", _fault(kind))
    checked = F.when(F.col("_fault").isNotNull(), F.raise_error(F.concat("_fault", F.lit(" in "), "path"))).otherwise(_items(kind))
    return df.select("path", F.posexplode(checked).alias("ord", "item"))


def _fields(item: Column, names: tuple[str, ...]) -> Column:
    return F.struct(*[F.get_json_object(item, f"$.{n}").alias(n) for n in names])


def securities(spark: SparkSession, source: str | DataFrame, language: str) -> DataFrame:
    """The catalog of one language: language, ord and the fields of a security.

    A payload is a JSON array; ord is the place of an object among its objects.
    """
    check_language(language)
    rows = _rows(spark, source, "catalog").select(F.lit(language).alias("language"), F.col("ord").cast("long").alias("ord"), _fields(F.col("item"), S.SECURITY_FIELDS).alias("s"))
    return rows.select("language", "ord", "s.*")


def metadata(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The metadata document as one row with nested columns."""
    value = F.when(~F.coalesce(F.col("value").rlike(r"\S"), F.lit(False)), F.raise_error(F.concat(F.lit("empty payload in "), "path"))).otherwise(F.col("value"))
    return _given(spark, source).select(F.from_json(value, S.METADATA, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def listings(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Symbols (name) with their security ids; other keys in the map extra."""
    extra = F.map_filter(F.from_json("item", T.MapType(T.StringType(), T.StringType())), lambda k, v: ~k.isin(*S.LISTING_FIELDS))
    rows = _rows(spark, source, "listings").select(F.col("ord").cast("long").alias("ord"), _fields(F.col("item"), S.LISTING_FIELDS).alias("s"), extra.alias("extra"))
    return rows.select("ord", "s.*", "extra")


def sheets_raw(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """All financial sheets, metrics as text; quarter 9 is the full year."""
    rows = _rows(spark, source, "sheets").select("ord", _fields(F.col("item"), (*S.KEYS, *S.METRICS)).alias("s"))
    whole = lambda n: F.trim(f"s.{n}").cast("int").alias(n)
    return rows.select("s.security_id", whole("fiscal"), whole("quarter"), *[f"s.{m}" for m in S.METRICS], F.col("ord").cast("long").alias("ord"))


def from_rows(spark: SparkSession, rows: list[dict], names: tuple[str, ...]) -> DataFrame:
    """A frame of text columns from dictionaries; missing keys are null."""
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def fresh_snapshots(snapshots: DataFrame, key: str, at: str, now: Column | None = None, ttl: int = TTL) -> DataFrame:
    """Of snapshots of a key the latest one, if it is not older than the time to live."""
    now = F.current_timestamp() if now is None else now
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(at))
    return snapshots.where(age <= ttl).withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A frame to parquet, csv, json or orc files, in partitions if asked for."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown kind of file: {kind}")
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    writer.format(kind).option("header", True).save(path)
