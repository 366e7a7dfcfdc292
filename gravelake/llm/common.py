"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
SHARED_DIR = "spark.checkpoint.dir"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Batches of texts for Python workers stay small, unless the session says otherwise."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and all run in one process."""
    where = spark.conf.get(SHARED_DIR, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SHARED_DIR} must name a folder that the driver and all executors share")
        where = _local.get(spark.sparkContext.applicationId)
        if where is None:
            where = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="gravelake-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
    return where.rstrip("/")


_local: dict[str, str] = {}


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstaged(*dfs: DataFrame | None) -> None:
    """Remove the tables of these staged frames, which nothing may read any more."""
    for df in dfs:
        path = getattr(df, "staged_at", None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def column(name: str) -> Column:
    """The column of exactly this name, whatever dots or quotes it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns in this order under plain names, for functions that take batches: PySpark doesn't quote names for them."""
    return df.select(*[column(c).alias(f"_{i}") for i, c in enumerate(names)])


def free_name(name: str, taken: Sequence[str]) -> str:
    """The name behind as many underscores as it takes to differ from all others, in any case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def literal_array(values: Sequence, kind: str) -> Column:
    """A constant array as one foldable literal."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{kind}>")


def words_of(text: str) -> str:
    """SQL for the array of words of a text column; null has none."""
    return rf"filter(split(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def merged_in_tasks(partials: DataFrame, merge: Callable[[Iterator[bytes]], bytes | None], tasks: int = 32) -> bytes | None:
    """One state from the states of all tasks (column `state`), or None: a bounded number of tasks merge them one
    by one, in the order of the tasks that they come from, and the driver merges what these leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = merge(x.as_py() for b in batches for x in b.column(0))
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary())], ["state"])

    told = partials.withColumn("part", F.spark_partition_id()).repartition(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")
    got = told.select("state", F.col("part")).mapInArrow(run, "state binary").collect()  # a row a task
    return merge(bytes(r.state) for r in got)
