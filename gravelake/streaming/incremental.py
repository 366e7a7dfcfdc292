"""Incremental indexing as a bounded stream: new script files are parsed, chunked, embedded and indexed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gravelake.operators import store
from gravelake.operators.chunk import chunk_parents
from gravelake.operators.embed import Embedder
from gravelake.operators.parse import script_parents
from gravelake.sources.files import named


def index_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, strategy: str = "ast", size: int = 256, embedder: Embedder | None = None) -> StreamingQuery:
    """Takes the files that came since the last run, adds them to the collection in `out` and ends.

    Each batch is a segment of all its tables, so a new file is found by words and by vectors, and has its parents. What the collection
    had of a file is replaced, so a batch that is repeated after a failure adds nothing twice. The stream reads a path once:
    a file that changes later is for `store.add_segment` or the next build.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,info,gui}").load(root)

    def add(batch: DataFrame, _: int) -> None:
        found = named(batch, root)
        parents = script_parents(found)
        store.add_segment(parents, chunk_parents(parents, strategy, size), found.select(F.col("rel_path").alias("file_path")), out, embedder)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
