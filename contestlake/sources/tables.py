"""Stored tables: raw CSV sets, Parquet, JSON lines, reports, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# fixed values: columns of the raw files, all text
RAW_FILES = {
    "event_details": ["EVENT", "URL", "DATE", "LOCATION"],
    "fighter_details": ["FIRST", "LAST", "NICKNAME", "URL"],
    "fighter_tott": ["FIGHTER", "HEIGHT", "WEIGHT", "REACH", "STANCE", "DOB", "URL"],
    "fight_details": ["EVENT", "BOUT", "URL"],
    "fight_results": ["EVENT", "BOUT", "OUTCOME", "WEIGHTCLASS", "METHOD", "ROUND", "TIME", "TIME FORMAT", "REFEREE", "DETAILS", "URL"],
    "fight_stats": ["EVENT", "BOUT", "ROUND", "FIGHTER", "KD", "SIG.STR.", "SIG.STR. %", "TOTAL STR.", "TD", "TD %", "SUB.ATT", "REV.",
                    "CTRL", "HEAD", "BODY", "LEG", "DISTANCE", "CLINCH", "GROUND"]}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_raw(spark: SparkSession, folder: str, prefix: str = "") -> dict[str, DataFrame]:
    """The raw CSV files, every column as text; a missing file is an empty table."""
    out = {}
    for name, columns in RAW_FILES.items():
        path, schema = f"{folder}/{prefix}{name}.csv", text_schema(columns)
        out[name] = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
                     if exists(spark, path) else spark.createDataFrame([], schema))
    return out


def load_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A stored Parquet table, or no rows of its schema when it was never written."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def save_by_year(df: DataFrame, path: str, day: str = "dt") -> None:
    """Parquet partitioned by year, one shuffle, a few files per year."""
    rows = df.withColumn("year", F.year(day))
    rows.repartition("year", F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))).write.mode("overwrite").partitionBy("year").parquet(path)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_record(df: DataFrame, path: str) -> None:
    """One JSON line per run and row."""
    df.write.mode("append").json(path)


def save_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """Aggregates and bet details for people: JSON or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)


def save_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """The full prediction set under its time stamp; earlier snapshots stay."""
    df.withColumn("snapshot", F.lit(stamp)).write.mode("append").partitionBy("snapshot").parquet(path)


def save_model(model: PipelineModel, summary: DataFrame, path: str) -> None:
    """A fitted pipeline and a side table of its figures."""
    model.write().overwrite().save(f"{path}/model")
    summary.write.mode("overwrite").json(f"{path}/summary")


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    return PipelineModel.load(f"{path}/model") if exists(spark, f"{path}/model") else None
