"""Schemas of the relations that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _of(**fields: T.DataType | str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "as": T.ArrayType(T.StringType()), "af": T.ArrayType(T.FloatType())}
    return T.StructType([T.StructField(n, kinds[k] if isinstance(k, str) else k) for n, k in fields.items()])


SOURCE_FILE = _of(path="s", rel_path="s", content=T.BinaryType())
PARENT = _of(parent_id="s", block_name="s", section_title="s", content="s", file_path="s", file_category="s", source_type="s", ord="i")
CHUNK = _of(child_id="s", text="s", parent_id="s", source_type="s", file_path="s", file_category="s", block_name="s", section_title="s", parent_ord="l", chunk_ord="i", content_hash="s")
EMBEDDING = _of(child_id="s", embedding="af")
TERM_CHANGE = _of(term="s", df="l")
INDEX_STATS = _of(n_docs="l", n_words="l", avg_idf="d", n_removed="l", buckets="i", key_type="s")
HIT = _of(query_id="s", rank="i", child_id="s", score="d", text="s", parent_id="s", source_type="s", file_path="s", file_category="s", block_name="s", section_title="s")
EVAL_QUERY = _of(id="s", query="s", collection="s", category="s", expected="as")
GOLD_RULE = _of(id="s", file_path_contains="as", must_contain_all="as")
FEEDBACK_QUERY = _of(id="s", query="s", collection="s", category="s")
FEEDBACK_GOLD = _of(
    id="s", scorable="b", note="s", acceptable_path_substrings="as", top1_path_substrings="as", top1_text_must_contain_all="as",
    top1_text_must_contain_any="as", top3_text_must_contain_any="as", false_positive_guard="b", skip_noise="b",
)
REPORT = _of(severity="s", file="s", line="l", key="s", msg="s", message="s", text="s")
