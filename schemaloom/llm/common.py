"""What the corpus operators share: table reading, lineage cuts in the shared folder, Arrow row loops."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which all executors share: ``spark.checkpoint.dir``.

    Only a session within one process may go without; it gets a temporary folder. On a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the folder that all executors share."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[list]]:
    """The columns of a batch as Python lists, a few rows at a time, so that only those are held as objects."""
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        yield [c.to_pylist() for c in part.columns]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def map_rows(df: DataFrame, each: Callable[[list[list]], list[list]], schema: str, prepare: Callable[[], object] | None = None, rows: int = 256) -> DataFrame:
    """mapInArrow over slices: ``each`` gets columns as lists (after ``prepare()``'s result, if given) and returns columns."""
    out = T.StructType.fromDDL(schema)
    target = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = prepare() if prepare else None
        for batch in batches:
            for columns in slices(batch, rows):
                made = each(state, columns) if prepare else each(columns)
                if made and len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, target, strict=True)], schema=target)

    return df.mapInArrow(run, out)


def held_out(doc_id: str, folds: int, fold: int):
    """True where crc32 of the id as text falls in the fold that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table beside the checkpoints: compressed and read by column, for wider rows than pinned() is meant for.

    The table belongs to the session and goes with it; ``discard`` removes it before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(table: DataFrame) -> None:
    """Remove a table of stored() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        files, at = _file_system(table.sparkSession, path)
        files.delete(at, True)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[object, list], list[bool]], prepare: Callable[[], object]) -> DataFrame:
    """The rows whose text passes, all columns as they are; one map without shuffle. ``keep`` gets prepare()'s result and some texts."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = prepare()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield part.filter(pa.array(keep(state, part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
