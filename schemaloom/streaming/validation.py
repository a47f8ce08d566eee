"""Validation of streams: the error column is stateless, so it runs unchanged; error rates are windowed with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import with_errors
from ..plans.compiler import Compiler


def read_stream(spark, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def validated(stream: DataFrame, compiler: Compiler, schema_id: str, value=None) -> DataFrame:
    """The stream with an errors column."""
    return with_errors(stream, compiler, schema_id, value)


def error_rates(checked: DataFrame, time: str, window: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Rows and invalid rows per tumbling window and key; rows later than the watermark are dropped from it."""
    bad = (F.size("errors") > 0).cast("long")
    out = checked.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(bad).alias("n_invalid"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n_rows", "n_invalid")


def once(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, by its keys: repeats within the watermark are dropped, and state older than it is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bursts(stream: DataFrame, time: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """Sessions by key: began, ended (gap included), n. A session ends where no event comes for ``gap``; it is told once the
    watermark has passed it (in append mode), and events later than that are dropped."""
    stream = stream.withWatermark(time, late) if late else stream
    out = stream.groupBy(F.session_window(time, gap).alias("_session"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("began"))
    return out.select(*by, "began", F.col("_session.end").alias("ended"), "n")


def to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", by: list[str] = ()) -> StreamingQuery:
    """Append to files, each row once whatever is restarted; only finished rows of windows and sessions are written."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start()


def split(stream: DataFrame, compiler: Compiler, schema_id: str, good: str, bad: str, checkpoint: str, value=None) -> StreamingQuery:
    """Write valid rows and quarantined ones apart; each batch is written under its number, so a batch done again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = with_errors(batch, compiler, schema_id, value).persist()
        batch.where(F.size("errors") == 0).drop("errors").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(F.size("errors") > 0).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, each: Callable | None = None) -> DataFrame:
    """Run a stream over what is there and return its result table; for small results and tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    if each:
        each(query)
    return stream.sparkSession.table(name)
