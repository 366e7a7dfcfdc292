"""BM25 over an inverted index that is stored in buckets of terms and grows by segments.

`entries` has a row for each chunk and word, in the bucket of the word's hash, and one for each chunk in bucket -1. They carry
the chunk's length and place, so scoring a query reads the buckets of its words and joins no table of chunks. `changes` has how
the number of chunks with a word changed in each segment, `stats` a row a segment, which is written last: a
segment without it is not there. Numbers of chunks and words add up over segments; the mean idf, which does not, is
computed from the summed changes with each segment. So scores are those of an index built at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravelake import schemas
from gravelake.functions import text as X
from gravelake.operators.tables import alive, exists, get, put, put_more, tidy

#: The usual parameters of the scorer.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Buckets of terms in a stored index. A query of few words reads few of them; more buckets make smaller ones.
BUCKETS = 64
#: Bucket of the rows that stand for chunks.
CHUNKS = -1
#: Scores are summed in whole units of this size, so that they don't depend on the order of rows and equal texts tie.
UNIT = 1e-12
#: Words of queries that are broadcast at once, and pairs of a query and a chunk that a task adds up.
WORDS, PAIRS = 500_000, 1_000_000


def buckets_for(chunks: int) -> int:
    """A bucket for every few thousand chunks, within bounds that keep files few and buckets many."""
    return max(8, min(4096, chunks // 5_000))


def bucket_of(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def entries(chunks: DataFrame, key: str = "child_id", text: str = "text", order: str = "corpus_ord", buckets: int = BUCKETS) -> DataFrame:
    """term, child_id, tf, dl, corpus_ord, bucket. Each text is split into words once, and its words are counted within its row."""
    d = chunks.select(F.col(key).alias("child_id"), F.col(order).alias("corpus_ord"), F.sort_array(X.tokens(text)).alias("__t"))
    n = F.size("__t")
    d = d.select("child_id", "corpus_ord", n.cast("long").alias("dl"), "__t", F.filter(F.when(n > 0, F.sequence(F.lit(1), n)), lambda i: (i == 1) | (F.get("__t", i - 1) != F.get("__t", i - 2))).alias("__at"))
    runs = F.transform("__at", lambda i, j: F.struct(F.get("__t", i - 1).alias("term"), (F.coalesce(F.get("__at", j + 1), F.size("__t") + 1) - i).cast("long").alias("tf")))
    one = F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"))
    d = d.select("child_id", "corpus_ord", "dl", F.explode(F.array_append(F.coalesce(runs, F.array().cast("array<struct<term:string,tf:bigint>>")), one)).alias("w"))
    d = d.select("w.term", "child_id", "w.tf", "dl", "corpus_ord")
    return d.withColumn("bucket", F.when(F.col("term") == "", CHUNKS).otherwise(bucket_of("term", buckets)))


def counted(entries: DataFrame) -> DataFrame:
    """bucket, term and in how many chunks it is."""
    return entries.filter(F.col("bucket") > CHUNKS).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))


def sizes(entries: DataFrame) -> DataFrame:
    """The number of chunks and of their words: one row."""
    return entries.filter(F.col("bucket") == CHUNKS).agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_words"))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def mean_idf(changes: DataFrame, size: DataFrame) -> DataFrame:
    """The mean idf of all words, summed as decimals, so that no order of rows matters: one row. size: one row with n_docs."""
    df = changes.groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    return df.join(F.broadcast(size.select("n_docs"))).agg((F.sum(_idf(F.col("n_docs"), F.col("df")).cast("decimal(28,15)")).cast("double") / F.count(F.lit(1))).alias("avg_idf"))  # one row


@dataclass
class LexicalIndex:
    entries: DataFrame  # of chunks that are still there
    changes: DataFrame  # bucket, term, df
    stats: DataFrame  # n_docs, avgdl, avg_idf: one row
    buckets: int = BUCKETS
    stored: bool = False
    _numbers: Row | None = None

    @property
    def postings(self) -> DataFrame:
        return self.entries.filter(F.col("bucket") > CHUNKS).select("term", "child_id", "tf")

    @property
    def lengths(self) -> DataFrame:
        return self.entries.filter(F.col("bucket") == CHUNKS).select("child_id", "dl", "corpus_ord")

    @property
    def terms(self) -> DataFrame:
        """term, df, idf"""
        return self.terms_of(self.changes)

    def terms_of(self, changes: DataFrame) -> DataFrame:
        df = changes.groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0").join(F.broadcast(self.stats))  # one row
        raw = _idf(F.col("n_docs"), F.col("df"))
        return df.select("bucket", "term", "df", F.when(raw >= 0, raw).otherwise(EPSILON * F.col("avg_idf")).alias("idf"))

    def pruned(self, queries: DataFrame) -> LexicalIndex:
        """The same index with only the buckets of the words (column bucket) of these queries, as a filter on partitions."""
        if not self.stored:
            return self
        wanted = [r.bucket for r in queries.select("bucket").distinct().collect()]  # at most as many as there are buckets
        inside = F.col("bucket").isin(wanted)
        return replace(self, entries=self.entries.filter(inside), changes=self.changes.filter(inside))

    def save(self, path: str) -> None:
        """Written whole, as one segment."""
        with tidy(self.entries.sparkSession):
            write_entries(self.entries.select("term", "child_id", "tf", "dl", "corpus_ord", "bucket"), path, 0, buckets=self.buckets)

    @classmethod
    def load(cls, spark: SparkSession, path: str, segments: Sequence[int] | None = None) -> LexicalIndex:
        """All segments that are complete, or those of the given ones."""
        rows = spark.read.schema(T.StructType([*schemas.INDEX_STATS.fields, T.StructField("segment", T.IntegerType())])).parquet(f"{path}/stats").collect()  # a row a segment
        rows = sorted((r for r in rows if segments is None or r.segment in segments), key=lambda r: r.segment)
        own, n, words = [r.segment for r in rows], sum(r.n_docs for r in rows), sum(r.n_words for r in rows)
        stats = spark.createDataFrame([(n, words / n if n else None, rows[-1].avg_idf if rows else None)], "n_docs bigint, avgdl double, avg_idf double")
        key = T.StructType.fromDDL(f"child_id {rows[-1].key_type if rows else 'string'}")
        layout = T.StructType([T.StructField("term", T.StringType()), *key.fields, *T.StructType.fromDDL("tf bigint, dl bigint, corpus_ord bigint").fields])
        removed = get(spark, f"{path}/removed", key, own) if any(r.n_removed for r in rows) else None
        found = alive(get(spark, f"{path}/entries", layout, own, "bucket"), removed)
        return cls(found, get(spark, f"{path}/changes", schemas.TERM_CHANGE, own, "bucket"), stats, rows[-1].buckets if rows else BUCKETS, True)


def build_index(chunks: DataFrame, key: str = "child_id", text: str = "text", order: str = "corpus_ord", buckets: int = BUCKETS) -> LexicalIndex:
    """An index that is not stored."""
    found = entries(chunks, key, text, order, buckets)
    changes, size = counted(found), sizes(found)
    stats = size.select("n_docs", (F.col("n_words") / F.when(F.col("n_docs") > 0, F.col("n_docs"))).alias("avgdl")).join(F.broadcast(mean_idf(changes, size)))  # one row each
    return LexicalIndex(found, changes, stats, buckets)


def write_entries(found: DataFrame | Sequence[DataFrame], path: str, segment: int, replaced: DataFrame | None = None, buckets: int = BUCKETS) -> None:
    """Adds or rewrites a segment of the stored index. found: its entries, or shares of them, which are dealt and written one by one, so that what
    is shuffled at once is a share. replaced: ids of chunks of earlier segments that are gone or come again in this one."""
    shares = [found] if isinstance(found, DataFrame) else found
    found, spark = shares[0], shares[0].sparkSession
    there = exists(spark, f"{path}/stats")
    before = [r.segment for r in spark.read.parquet(f"{path}/stats").select("segment").collect() if r.segment < segment] if there else []
    earlier = LexicalIndex.load(spark, path, before) if before else None
    buckets = earlier.buckets if earlier else buckets
    key = T.StructType([T.StructField("child_id", found.schema["child_id"].dataType)])
    for i, share in enumerate(shares):
        share = share.withColumn("bucket", F.when(F.col("bucket") > CHUNKS, bucket_of("term", buckets)).otherwise(CHUNKS))
        (put_more if i else put)(share.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "corpus_ord"), f"{path}/entries", segment, "bucket")
    layout = T.StructType([f for f in found.schema.fields if f.name != "bucket"])
    own = get(spark, f"{path}/entries", layout, [segment], "bucket")
    changed, size, n_removed = counted(own), sizes(own), 0
    if earlier is not None and replaced is not None:
        ids = replaced.select("child_id").distinct()
        put(ids.hint("rebalance"), f"{path}/removed", segment)
        n_removed = get(spark, f"{path}/removed", key, [segment]).count()
    if n_removed:
        gone = earlier.entries.join(get(spark, f"{path}/removed", key, [segment]).select("child_id"), "child_id", "left_semi")
        changed = changed.unionByName(counted(gone).withColumn("df", -F.col("df"))).groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df <> 0")
        size = size.unionByName(sizes(gone).select((-F.col("n_docs")).alias("n_docs"), (-F.col("n_words")).alias("n_words"))).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))
    put(changed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), f"{path}/changes", segment, "bucket")
    grown = size.first()
    total = (earlier.stats.first().n_docs if earlier else 0) + grown.n_docs
    mean = mean_idf(get(spark, f"{path}/changes", schemas.TERM_CHANGE, [*before, segment], "bucket"), spark.createDataFrame([(total,)], "n_docs bigint")).first().avg_idf
    put(spark.createDataFrame([(grown.n_docs, grown.n_words, mean, n_removed, buckets, key["child_id"].dataType.simpleString())], schemas.INDEX_STATS), f"{path}/stats", segment)


def query_table(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """query_id, term, qtf: repeated words count as often as they stand."""
    d = queries.select(F.col(key).alias("query_id"), F.explode(X.tokens(text)).alias("term"))
    return d.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _shares(words: DataFrame, rows: int) -> list[DataFrame]:
    """Hashed shares of the queries with about so many words each as are broadcast at once."""
    n = -(-rows // WORDS)
    return [words.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [words]


def whole(x: Column) -> Column:
    """The nearest whole number, halves away from 0: as `round`, which makes a decimal of each number on its way."""
    size = F.abs(x)
    down = F.floor(size)
    near = down + F.when(size - down >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when(x < 0, -near).otherwise(near).cast("long")


def _scored(index: LexicalIndex, queries: DataFrame, k1: float, b: float, keep: DataFrame | None = None, first: int = 0) -> DataFrame:
    """query_id, child_id, corpus_ord, score of the chunks that share a word with the query. keep: child ids that count. first: so many
    chunks, the first in corpus order, get a score of 0 and what their words add, in every query.

    The postings of all words that are asked for go to the chunk's task once, and meet the queries there; so a pair's
    parts are in one task, and what is shuffled does not grow with the number of queries.
    """
    q = query_table(queries).withColumn("bucket", bucket_of("term", index.buckets))
    near = index.pruned(q)
    size = q.agg(F.count(F.lit(1)).alias("words"), F.countDistinct("query_id").alias("queries")).first()
    known = near.terms_of(near.changes.join(q.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")).select("bucket", "term", "idf")
    few = size.words <= WORDS
    hit = near.entries.filter(F.col("bucket") > CHUNKS).join(F.broadcast(known) if few else known, ["bucket", "term"]).select("child_id", "corpus_ord", "dl", "tf", "term", "idf")
    words = q.select("query_id", "term", "qtf")
    if first:
        pool = index.lengths
        if keep is not None:
            pool = pool.join(keep.select("child_id"), "child_id", "left_semi")
        zero = pool.orderBy("corpus_ord").limit(first).select("child_id", "corpus_ord", "dl", F.lit(0).cast("long").alias("tf"), F.lit("").alias("term"), F.lit(0.0).alias("idf"))
        hit = hit.unionByName(zero)  # as of an empty word that all queries have
        words = words.unionByName(queries.select("query_id").distinct().select("query_id", F.lit("").alias("term"), F.lit(0).cast("long").alias("qtf")))
    if index.stored:
        tasks = -(-index.stats.first().n_docs * min(size.queries, WORDS) // PAIRS)
        hit = hit.repartition(max(tasks, hit.sparkSession.sparkContext.defaultParallelism), "child_id")
    else:
        hit = hit.repartition("child_id")
    if keep is not None:
        hit = hit.join(keep.select("child_id"), "child_id", "left_semi")
    hit = hit.join(F.broadcast(near.stats.select("avgdl")))  # one row

    def units(qtf: Column) -> Column:
        part = qtf * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return F.when(F.col("tf") > 0, whole(part / UNIT)).otherwise(0)

    hit = hit.withColumn("once", units(F.lit(1)))  # of a posting, and not of each query that asks for it
    each = F.when(F.col("qtf") == 1, F.col("once")).otherwise(units(F.col("qtf")))
    scores = [hit.join(F.broadcast(w), "term").groupBy("query_id", "child_id", "corpus_ord").agg((F.sum(each) * UNIT).alias("score")) for w in _shares(words, size.words)]
    return reduce(DataFrame.unionByName, scores)


def bm25_scores(index: LexicalIndex, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, child_id, score of every chunk that shares a word with the query."""
    return _scored(index, queries, k1, b).select("query_id", "child_id", "score")


def bm25_topk(index: LexicalIndex, queries: DataFrame, k: int, keep: DataFrame | None = None, fill: bool = True) -> DataFrame:
    """query_id, child_id, score, rank of the best k of each query, equal scores in corpus order.

    keep: child ids that may be returned; the statistics stay those of the whole corpus. fill: a query with fewer
    than k matches gets chunks of score 0, as if every chunk had been scored; they come from the first chunks in
    corpus order, so their number does not grow with the corpus, and add 0 before scores are summed.
    """
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "corpus_ord")
    scored = _scored(index, queries, K1, B, keep, 2 * k if fill else 0)
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "child_id", "score", "rank")


def path_contains(path: Column, needle: str) -> Column:
    return F.contains(X.slashed(path), F.lit(needle.replace("\\", "/")))
