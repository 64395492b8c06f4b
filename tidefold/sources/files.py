"""CSV and Parquet scans into (features, target) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.preprocess import finite


def read_csv(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """seq, features, target of a CSV with a header; the target is the named or else the last column.

    A column with any value that is not a number is encoded by first appearance: 0, 1, ... in the order of the file.
    """
    raw = spark.read.option("header", True).csv(path)
    names = raw.columns
    target = target or names[-1]
    raw = raw.withColumn("_seq", F.monotonically_increasing_id())
    odd = raw.agg(*[F.max((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).cast("int")).alias(c) for c in names]).first()
    for c in names:
        if odd[c]:
            codes = raw.groupBy(c).agg(F.min("_seq").alias("_first"))
            codes = codes.select(F.col(c).alias("_value"), (F.row_number().over(Window.orderBy("_first")) - 1).cast("double").alias("_code"))
            raw = raw.join(codes, F.col(c).eqNullSafe(F.col("_value"))).withColumn(c, F.col("_code")).drop("_value", "_code")
        else:
            raw = raw.withColumn(c, F.col(c).try_cast("double"))
    rows = finite(raw, names)
    return rows.select(F.col("_seq").alias("seq"), F.array(*[F.col(c) for c in names if c != target]).alias("features"), F.col(target).alias("target"))


def read_parquet(spark: SparkSession, path: str, target: str) -> DataFrame:
    """features, target of a Parquet table: its double columns but the target, in order; rows with a value that is not finite go."""
    df = spark.read.parquet(path)
    xs = [c for c, t in df.dtypes if t == "double" and c != target]
    rows = finite(df.select(*xs, F.col(target).cast("double").alias(target)), [*xs, target])
    return rows.select(F.array(*xs).alias("features"), F.col(target).alias("target"))


def write_predictions(df: DataFrame, path: str, column: str = "prediction") -> None:
    """A CSV of predictions with six decimals."""
    df.select(F.format_string("%.6f", F.col(column)).alias("prediction")).write.option("header", True).csv(path)
