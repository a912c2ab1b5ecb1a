"""Typed JSON-lines records, summaries and staged hand-offs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ["jobs", "pairs", "valid", "invalid", "corrected", "labels", "judge"]
CORRUPT = "_corrupt_record"


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, missing_ok: bool = False,
                 required: list[str] | None = None) -> DataFrame:
    """One record per line under a declared schema; blank lines are skipped and a bad record fails the job.

    A field that is absent reads as NULL; columns named in ``required`` fail the job when NULL. A missing path is an
    empty table with ``missing_ok``, else an error.
    """
    try:
        df = spark.read.schema(_schema(schema)).option("mode", "FAILFAST").json(path)
    except AnalysisException as exc:
        if missing_ok and "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], _schema(schema))
        raise
    for field in required or []:
        check = F.when(F.col(field).isNull(), F.raise_error(F.lit(f"required field {field} is missing")).cast("boolean"))
        df = df.where(F.coalesce(check, F.lit(True)))
    return df


def read_with_quarantine(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, raw bad lines) instead of failing."""
    full = T.StructType([*_schema(schema).fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", full, options).alias("r")).select("r.*")
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> None:
    """One JSON record per line, NULL fields kept. Compressed files (gzip, bzip2, ..) are read back like others."""
    df.write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).json(path)


def summary_document(metrics: DataFrame) -> DataFrame:
    """One row with a nested JSON document {section: {name: value}} from a long metric table (metric rows only)."""
    per_section = metrics.groupBy("section").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))
    return per_section.agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("section", F.to_json("values")))))).alias("document"))


def write_summary(metrics: DataFrame, path: str) -> None:
    """The long metric table as Parquet, the document beside it as JSON."""
    metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    summary_document(metrics).write.mode("overwrite").text(f"{path}/document")


class Stages:
    """Parquet hand-off between stages, so that every stage can start again from what the one before it wrote."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, stage: str) -> str:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        return f"{self.root}/{stage}"

    def save(self, stage: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(stage))
        return self.load(stage)

    def load(self, stage: str, schema: str | None = None) -> DataFrame:
        """Stored rows; with a schema, a stage that was never written is empty."""
        try:
            return self.spark.read.parquet(self.path(stage))
        except AnalysisException as exc:
            if schema is not None and "PATH_NOT_FOUND" in str(exc):
                return self.spark.createDataFrame([], _schema(schema))
            raise


def append_results(results: DataFrame, path: str) -> None:
    """Add experiment results to earlier ones."""
    results.write.mode("append").parquet(path)


def load_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
