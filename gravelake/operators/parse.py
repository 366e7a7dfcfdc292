"""Source files to parent documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from gravelake import schemas
from gravelake.functions import text as X
from gravelake.functions.script import blocks
from gravelake.sources.files import decode_script, decode_wiki


@udtf(returnType=T.StructType().add("ord", T.IntegerType()).add("name", T.StringType()).add("text", T.StringType()))
class ScriptBlocks:
    """`LATERAL script_blocks(text)`: the top-level blocks of a script."""

    def eval(self, text: str):
        for i, (name, body) in enumerate(blocks(text or "")):
            yield i, name, body


def register(spark) -> None:
    spark.udtf.register("script_blocks", ScriptBlocks)


def script_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each block: the other columns, ord, name, block. Runs on Arrow batches."""
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, n, t) for k, x in enumerate(b.column(len(kept)).to_pylist()) for i, (n, t) in enumerate(blocks(x or ""))]
            if rows:
                at, order, name, body = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(at)) for i in range(len(kept))], pa.array(order, pa.int32()), pa.array(name), pa.array(body)], [*kept, "ord", "name", "block"])

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept], "ord int, name string, block string"])
    return df.select(*kept, text).mapInArrow(run, schema)


def numbered_names(df: DataFrame, file: str, name: str, order: str) -> DataFrame:
    """Adds `seen`: how often the name came before in its file."""
    return df.withColumn("seen", F.row_number().over(W.partitionBy(file, name).orderBy(order)) - 1)


def script_parents(files: DataFrame, root: str | None = None) -> DataFrame:
    """Files (path, rel_path, content) to parents: one of a whole .info file, one of each block of the others."""
    inside = ~F.startswith("rel_path", F.lit("/"))
    parent = F.regexp_extract("path", "([^/]+)/[^/]*$", 1)
    d = files.select("path", "rel_path", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"), X.category_of("rel_path", inside, parent).alias("category"), decode_script("content").alias("text"))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    info = d.filter((F.col("suffix") == ".info") & ~X.is_blank("text")).select(
        F.concat("rel_path", F.lit("::__file__")).alias("parent_id"), stem.alias("block_name"), F.lit(None).cast("string").alias("section_title"),
        X.stripped("text").alias("content"), F.col("rel_path").alias("file_path"), F.col("category").alias("file_category"), F.lit("game_docs").alias("source_type"), F.lit(0).alias("ord"),
    )
    found = numbered_names(script_blocks(d.filter("suffix <> '.info'").select("rel_path", "category", "text")), "rel_path", "name", "ord")
    again = F.when(F.col("seen") > 0, F.concat(F.lit("#"), F.col("seen").cast("string"))).otherwise("")
    made = found.select(
        F.concat("rel_path", F.lit("::"), "name", again).alias("parent_id"), F.col("name").alias("block_name"), F.lit(None).cast("string").alias("section_title"),
        X.stripped("block").alias("content"), F.col("rel_path").alias("file_path"), F.col("category").alias("file_category"), F.lit("game_file").alias("source_type"), "ord",
    )
    return info.unionByName(made).select(*schemas.PARENT.fieldNames())


def split_sections(df: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """A row for each section of Markdown, cut before every line that starts with two # and more and white space; ord, section_title, section."""
    d = df.select("*", F.posexplode(F.split(X.text_or_empty(text), r"(?m)(?=^#{2,}\s)")).alias("ord", "section")).withColumn("section", X.stripped("section"))
    head = F.regexp_extract("section", r"^#{2,}\s+([^\n]*)", 1)
    title = F.when(F.regexp_like("section", F.lit(r"^#{2,}\s")), X.stripped(head)).otherwise(F.concat(X.stem_title(path), F.lit(" (intro)")))
    return d.filter("section <> ''").withColumn("section_title", title)


def wiki_parents(files: DataFrame) -> DataFrame:
    """Files to one parent a section; a repeated title gets _2, _3."""
    d = files.select(F.col("rel_path").alias("path"), decode_wiki("content").alias("text"))
    s = numbered_names(split_sections(d), "path", "section_title", "ord")
    again = F.when(F.col("seen") > 0, F.concat(F.lit("_"), (F.col("seen") + 1).cast("string"))).otherwise("")
    return s.select(
        F.concat("path", F.lit("::"), "section_title", again).alias("parent_id"), F.lit(None).cast("string").alias("block_name"), "section_title",
        F.col("section").alias("content"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("file_category"), F.lit("wiki").alias("source_type"), "ord",
    )
