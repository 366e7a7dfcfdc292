"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

The fraction, not the number of hashes, is fixed, so sketches of very unequal texts stay comparable: they
merge by union, and containment and resemblance are ratios of plain set sizes. A short text may keep no hash. Its
sketch is empty, and a tag, the hash of its words behind a dash, stands for it in the fingerprint; two texts without
kept hashes are alike (1.0) if their tags are equal, else not (0.0).

A shingle is five words, or the whole sequence of a shorter text. A null text counts as empty. Texts
without words have no tag and are alike; an empty and a filled sketch are not (0.0). Rows with equal ids are ordered by text;
null ids come first. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravelake.llm.common import let, staged, table, words_of

SHINGLE = 5
HEX = 12
#: One hash in eight is kept.
LIMIT = "2" + "0" * (HEX - 1)
#: Ids of a block are next to each other, so a block has at most this many distinct ids.
BLOCK = 1024
_RANGES = 64


def sketch(text: str) -> str:
    """SQL for the sorted array of kept hashes."""
    hashes = f"transform(sequence(1, greatest(size(w) - {SHINGLE - 1}, 1)), i -> left(md5(cast(array_join(slice(w, i, {SHINGLE}), ' ') AS binary)), {HEX}))"
    return let(words_of(text), "w", f"if(size(w) = 0, cast(array() AS array<string>), array_sort(array_distinct(filter({hashes}, x -> x < '{LIMIT}'))))")


def tag(text: str, hashes: str) -> str:
    """SQL for what tells texts without a kept hash apart; null for others and for texts without words."""
    return f"if(size({hashes}) > 0, null, " + let(words_of(text), "w", f"if(size(w) = 0, null, concat('-', left(md5(cast(array_join(w, ' ') AS binary)), {HEX})))") + ")"


def fingerprint(hashes: str, tag: str) -> str:
    """SQL for a sketch and its tag as one string."""
    return f"coalesce({tag}, array_join({hashes}, ''))"


def resemblance(a: str, b: str) -> str:
    """SQL for shared over all hashes of two sketches; two empty ones are alike."""
    shared = let(f"cast(size(array_intersect({a}, {b})) AS double)", "s", f"s / (size({a}) + size({b}) - s)")
    return f"if(size({a}) = 0 AND size({b}) = 0, 1D, {shared})"


def likeness(a: str, tag_a: str, b: str, tag_b: str) -> str:
    """SQL for the resemblance of two texts by their sketches and tags."""
    return f"if({tag_a} <=> {tag_b}, {resemblance(a, b)}, 0D)"


def containment(a: str, b: str) -> str:
    """SQL for the part of sketch a that sketch b holds too."""
    return f"if(size({a}) = 0, 1D, cast(size(array_intersect({a}, {b})) AS double) / size({a}))"


def merged(df: DataFrame, group: str, hashes: str) -> DataFrame:
    """Sketch of the union of each group's texts."""
    return df.select(group, F.explode(hashes).alias("__h")).groupBy(group).agg(F.sort_array(F.collect_set("__h")).alias(hashes))


def _block_order(df: DataFrame) -> DataFrame:
    """Each block and the one that follows it, the last followed by the first.

    Blocks are range-sorted; within a range the successor is the next row, and the ranges (a fixed number)
    are chained by their first blocks.
    """
    blocks = staged(df.select("__b").distinct().repartitionByRange(_RANGES, "__b").withColumn("__p", F.spark_partition_id()))
    firsts = blocks.groupBy("__p").agg(F.min("__b").alias("__first")).withColumn("__all", F.lit(0))
    by_range = W.partitionBy("__all").orderBy("__p")
    whole = W.partitionBy("__all")
    firsts = firsts.select("__p", F.coalesce(F.lead("__first").over(by_range), F.min("__first").over(whole)).alias("__after"))
    within = W.partitionBy("__p").orderBy("__b")
    out = blocks.withColumn("__n", F.lead("__b").over(within)).join(F.broadcast(firsts), "__p")
    return out.select(F.col("__b").alias("__from"), F.coalesce("__n", "__after").alias("__to"))


def with_next(df: DataFrame, key: str, carried: list[str], derived: dict[str, str] | None = None) -> DataFrame:
    """Adds `next_<c>` for each carried column: its value in the row that follows in order of key, then of
    the first carried column; the last row is followed by the first. The rows are shuffled once; derived columns
    (name and SQL, in order) are made behind the shuffle and are carried too."""
    lowest = -(1 << 62)

    def with_derived(d: DataFrame) -> DataFrame:
        for name, sql in (derived or {}).items():
            d = d.withColumn(name, F.expr(sql))
        return d

    every = [*carried, *(derived or {})]
    first = [F.col(key).asc_nulls_first(), F.col(carried[0]).asc_nulls_first()]
    order = W.partitionBy("__b").orderBy(*first)
    dealt = df.withColumn("__b", F.coalesce(F.floor(F.col(key) / F.lit(BLOCK)), F.lit(lowest)))
    d = with_derived(dealt.repartition("__b"))
    d = d.withColumn("__next", F.lead(F.struct(*every)).over(order))
    inner = d.filter("__next IS NOT NULL").drop("__b")
    heads = dealt.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1")
    heads = with_derived(heads.select(F.col("__b").alias("__to"), *carried)).select("__to", F.struct(*every).alias("__next"))
    tails = d.filter("__next IS NULL").drop("__next").join(_block_order(df.select(d_block(key, lowest))), F.col("__b") == F.col("__from")).join(heads, "__to")
    both = inner.unionByName(tails.select(*inner.columns))
    return both.select(*[c for c in both.columns if c != "__next"], *[F.col(f"__next.{c}").alias(f"next_{c}") for c in every])


def d_block(key: str, lowest: int):
    return F.coalesce(F.floor(F.col(key) / F.lit(BLOCK)), F.lit(lowest)).alias("__b")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(docs, "doc_id", ["text"], {"fp": sketch("text"), "tag": tag("text", "fp")})
    d = d.withColumn("n_chars", F.length("text").cast("long")).withColumn("__q", F.expr("cast(floor(n_chars / 4) AS int)"))
    d = d.withColumn("__edited", F.expr("concat(substring(text, 1, cast(n_chars AS int) - __q), substring(next_text, 1, __q))"))
    d = d.withColumn("efp", F.expr(sketch("__edited"))).withColumn("etag", F.expr(tag("__edited", "efp")))
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(fingerprint("fp", "tag")).alias("fingerprint"),
        F.expr(fingerprint("efp", "etag")).alias("edited_fingerprint"),
        F.expr(likeness("fp", "tag", "efp", "etag")).alias("near_edited"),
        F.expr(likeness("fp", "tag", "next_fp", "next_tag")).alias("near_next"),
    )


def oracle() -> str:
    words = "list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    hashes = f"list_transform(range(1, greatest(len({{w}}) - {SHINGLE - 1}, 1) + 1), lambda i: left(md5(array_to_string({{w}}[i:i+{SHINGLE - 1}], ' ')), {HEX}))"
    pick = f"CASE WHEN len({{w}}) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_distinct(list_filter({{h}}, lambda x: x < '{LIMIT}'))) END"
    tagged = f"CASE WHEN len({{f}}) = 0 AND len({{w}}) > 0 THEN '-' || left(md5(array_to_string({{w}}, ' ')), {HEX}) END"
    near = "CASE WHEN {s} IS DISTINCT FROM {t} THEN 0.0::DOUBLE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
    three = lambda of: ", ".join(of(i) for i in range(3))
    texts = ("text", "edited", "next_text")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id NULLS FIRST, text), first_value(text) OVER (ORDER BY doc_id NULLS FIRST, text)) AS next_text, length(text) AS n_chars FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 4) || left(next_text, n_chars // 4) AS edited FROM n),
w AS (SELECT *, {three(lambda i: words.format(t=texts[i]) + f" AS w{i}")} FROM e),
h AS (SELECT *, {three(lambda i: hashes.format(w=f"w{i}") + f" AS h{i}")} FROM w),
f AS (SELECT *, {three(lambda i: pick.format(w=f"w{i}", h=f"h{i}") + f" AS f{i}")} FROM h),
t AS (SELECT *, {three(lambda i: tagged.format(w=f"w{i}", f=f"f{i}") + f" AS t{i}")} FROM f)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, coalesce(t0, array_to_string(f0, '')) AS fingerprint, coalesce(t1, array_to_string(f1, '')) AS edited_fingerprint,
  {near.format(a="f0", b="f1", s="t0", t="t1")} AS near_edited, {near.format(a="f0", b="f2", s="t0", t="t2")} AS near_next FROM t"""
