"""Documents and quads in storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.quads import SCHEMA, deduplicated, parse_nquads, to_nquads  # noqa: F401


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """json, parquet, csv, orc or text; a schema spares the pass that would infer one."""
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def balanced(df: DataFrame, limit: int = 512 << 20) -> DataFrame:
    """A small table dealt to all cores. One that was written as a single row group is read by a single task, however much
    is to be done with each row. Larger tables come in many row groups and stay as they are, so what is moved is bounded."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= limit else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows with much to do for each, dealt to as many tasks as shuffles have; small shuffled tables are else brought together in a few."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_quads(quads: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder per predicate, so that a constant predicate prunes the rest."""
    quads.withColumn("predicate", quads["p"]).write.mode(mode).partitionBy("predicate").option("compression", "zstd").parquet(path)


def read_quads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("predicate")


def read_predicate(spark: SparkSession, path: str, predicate: str) -> DataFrame:
    """The quads of one predicate; only its folder is read."""
    from pyspark.sql import functions as F

    return spark.read.parquet(path).where(F.col("predicate") == predicate).drop("predicate")


def write_nquads(quads: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_nquads(quads).write.mode(mode).text(path)
