"""Tables that grow by segments: plain Parquet, partitioned by the segment that wrote a row.

Writing a segment again replaces its folder. What a later segment replaces stays where it is and is hidden by
`removed`, which names keys and the segment from which they are gone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever file system."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a Parquet table with rows is a single file."""
    row = spark.read.parquet(path).select("_metadata.file_path").first()
    return row is not None and row.file_path.rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])


#: How tables are written: ids in order share their beginnings, which the later encodings of Parquet use.
SMALL = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.writer.version": "PARQUET_2_0"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Meanwhile shuffle files go as soon as the action that made them ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def put(df: DataFrame, path: str, segment: int, *by: str) -> None:
    """Writes the rows as one segment of the table, partitioned further by the given columns."""
    df.write.mode("overwrite").options(**SMALL).partitionBy(*by).parquet(f"{path}/segment={segment}")


def put_more(df: DataFrame, path: str, segment: int, *by: str) -> None:
    """Writes further rows of a segment that `put` has begun."""
    df.write.mode("append").options(**SMALL).partitionBy(*by).parquet(f"{path}/segment={segment}")


def empty(spark: SparkSession, path: str) -> None:
    """Overwrites a table of a build that nothing reads any more by one without rows."""
    spark.createDataFrame([], "gone int").coalesce(1).write.mode("overwrite").parquet(path)


def get(spark: SparkSession, path: str, schema: T.StructType, segments: Sequence[int], *by: str) -> DataFrame:
    """Rows of these segments, which prune partitions; the schema is given, as a table may have no file yet."""
    full = T.StructType([*[f for f in schema.fields if f.name not in ("segment", *by)], T.StructField("segment", T.IntegerType()), *[T.StructField(c, T.IntegerType()) for c in by]])
    return spark.read.schema(full).parquet(path).filter(F.col("segment").isin([*segments]))


def alive(df: DataFrame, removed: DataFrame | None, key: str = "child_id") -> DataFrame:
    """Rows whose key no later segment has replaced."""
    if removed is None:
        return df
    gone = removed.groupBy(F.col(key).alias("__key")).agg(F.max("segment").alias("__gone"))
    return df.join(gone, (F.col(key) == F.col("__key")) & (F.col("segment") < F.col("__gone")), "left_anti")
