"""Durable tables and exchange files of the ledgers."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pyspark.sql.types import StructType

from threadspark import fixed_values as fv
from threadspark.operators.ordinals import first_per_key


def load_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def require_valid(rows: DataFrame, valid: Column, message: str) -> DataFrame:
    """The rows, failing the job when any of them is invalid."""
    checked = F.when(F.coalesce(valid, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return rows.filter(checked)


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Current rows with changes applied; the row with the largest order wins, ties go to the change."""
    both = current.withColumn("_source", F.lit(0)).unionByName(changes.withColumn("_source", F.lit(1)))
    return first_per_key(both, keys, F.struct(order, F.col("_source")), latest=True).drop("_source")


def without_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not listed; other ledgers, receipts above all, are left alone."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def write_export(rows: DataFrame, path: str, exported_at: str, version: str = fv.SCHEMA_VERSION) -> None:
    """One JSON line per row, each with the version and the export time; no row passes the driver."""
    body = F.struct(F.lit(version).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt"), F.struct(*rows.columns).alias("record"))
    rows.select(F.to_json(body).alias("value")).write.mode("overwrite").text(path)


def read_export(spark: SparkSession, path: str, record_schema: str, version: str = fv.SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines) of an export; unknown fields and other versions are rejected."""
    shape = f"schemaVersion string, exportedAt string, record struct<{record_schema}>"
    lines = spark.read.text(path)
    parsed = lines.withColumn("doc", F.from_json("value", shape))
    allowed = [field.name for field in StructType.fromDDL(record_schema)]
    keys = F.json_object_keys(F.get_json_object("value", "$.record"))
    ok = (
        (F.col("doc.schemaVersion") == version) & F.col("doc.record").isNotNull() & F.col("doc.exportedAt").try_cast("timestamp").isNotNull()
        & (F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) == 0)
    )
    good, bad = load_valid(parsed, ok)
    return good.select("doc.record.*"), bad.select("value")
