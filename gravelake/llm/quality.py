"""Quality rules: base counts of a text, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams of a text fall into a fixed number of hash buckets. Two multinomials over the
buckets are counted, one over every document of the corpus and one over all trusted documents (those labelled
good). A text's score is its mean log ratio of the two; it is kept if no base rule fails
and its score reaches a low quantile of the trusted documents' own scores, so equal texts always get equal
verdicts. Trusted ids meet the documents in a shuffled join; scores are stored once, and the threshold and the
verdicts are read from them. The quantile is exact, so the threshold does not depend on the order in which tasks end.
Everything runs as JVM expressions; the only thing that leaves the executors is one number a bucket, and counts and
bounds of a fixed number of bins.

Results at the edges: a null or empty text has no words and fails the base rules; with no trusted document
the ratio is 0 everywhere and only the base rules decide; repeated rows are scored alike; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelake.llm.common import let, literal_array, staged, table, unstaged, words_of

BUCKETS = 10_000
SMOOTHING = 1.0
QUANTILE = 0.005
MIN_WORDS = 10
#: Bins of a pass over the scores for their quantile.
BINS = 4_096

_BUCKETS_OF = "flatten(array(transform(w, x -> pmod(xxhash64(x), {b})), transform(w, (x, i) -> if(i = 0, -1L, pmod(xxhash64(get(w, i - 1), x), {b})))))"
_REPEATS = (
    "if(size(w) < 6, 0, "
    + let(
        "transform(sequence(1, greatest(size(w) - 4, 1)), i -> xxhash64(slice(w, i, 5)))",
        "h",
        "if(size(array_distinct(h)) = size(h), 0, "
        + let(
            "sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))",
            "s",
            "aggregate(sort_array(transform(filter(sequence(0, size(s) - 1), k -> coalesce(get(s, k - 1).h = get(s, k).h, false) OR coalesce(get(s, k + 1).h = get(s, k).h, false)), k -> get(s, k).i)), "
            "named_struct('last', -5, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)), a -> a.n)",
        )
        + ")",
    )
    + ")"
)


def base_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, the words as `__w`, and the six base columns."""
    t = "coalesce(__t, '')"
    d = df.select(F.col(key), F.col(text).alias("__t")).withColumn("__w", F.expr(words_of("__t")))
    d = d.select(
        key,
        "__w",
        F.expr("cast(size(__w) AS bigint)").alias("n_words"),
        F.expr("cast(length(array_join(__w, '')) AS bigint)").alias("word_chars"),
        F.expr(f"cast(length({t}) - length(regexp_replace({t}, '[#*$%&|<>]', '')) AS bigint)").alias("n_symbols"),
        F.expr("cast(" + let(rf"filter(split({t}, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')", "l", "size(l) - size(array_distinct(l))") + " AS bigint)").alias("n_dup_lines"),
        F.expr("cast(" + let("__w", "w", _REPEATS) + " AS bigint)").alias("n_repeat_words"),
    )
    return d.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 20 * n_words"))


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """All ids labelled good."""
    return labels.filter("quality = 1").select(F.col(key).alias("__good")).filter("__good IS NOT NULL").distinct()


def bucket_ratios(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Log of trusted over raw probability for each bucket, counted over all rows."""
    told = df.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(trusted.hint("shuffle_hash"), F.col("__k") == F.col("__good"), "left")
    grams = told.select((F.col("__good").isNotNull()).cast("long").alias("good"), F.explode(F.expr(let(words_of("__t"), "w", _BUCKETS_OF.format(b=buckets)))).alias("bucket")).filter("bucket >= 0")
    raw, good = [0] * buckets, [0] * buckets
    for r in grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g")).collect():  # one row a bucket
        raw[r.bucket], good[r.bucket] = r.n, r.g
    if not sum(good):
        return [0.0] * buckets
    all_raw, all_good = sum(raw) + SMOOTHING * buckets, sum(good) + SMOOTHING * buckets
    return [math.log((g + SMOOTHING) / all_good) - math.log((n + SMOOTHING) / all_raw) for n, g in zip(raw, good, strict=True)]


def with_score(counted: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds `score`, the mean log ratio over the n-grams of `__w`; 0 for a text without words."""
    b = len(ratios)
    total = f"aggregate({_BUCKETS_OF.format(b=b)}, 0D, (s, x) -> s + if(x < 0, 0D, get(r, cast(x AS int))))"
    score = let("__w", "w", let("__r", "r", f"if(size(w) = 0, 0D, {total} / (2 * size(w) - 1))"))
    return counted.withColumn("__r", literal_array(ratios, "double")).withColumn("score", F.expr(score)).drop("__r")


def exact_quantile(values: DataFrame, quantile: float, bins: int = BINS) -> float | None:
    """The smallest number of the column `v` that at least this share of all numbers doesn't exceed; None without numbers.

    A pass counts the numbers between two bounds in bins of one width, and goes on with the bin in which the rank
    lies, between the least and the largest number in it. These are in bins apart in the next pass, so it ends, with both equal.
    """
    whole = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not whole.n:
        return None
    rank, lo, hi = max(1, math.ceil(quantile * whole.n)), whole.lo, whole.hi
    while lo < hi:
        at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(hi - lo) * bins), F.lit(bins - 1))
        counts = values.filter(F.col("v").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: r.bin):  # at most `bins` rows
            if rank <= r.n:
                lo, hi = r.lo, r.hi
                break
            rank -= r.n
    return lo


def quality_filter(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, quantile: float = QUANTILE) -> DataFrame:
    """Id, base counts, `base_failed`, `score` and `kept` for every row."""
    trusted = trusted_ids(labels, key)
    ratios = bucket_ratios(df, trusted, key, text, buckets)
    scored = with_score(base_counts(df, key, text), ratios)
    scored = staged(scored.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"))
    own = scored.filter("n_words > 0").select(key, "score").join(trusted.hint("shuffle_hash"), F.col(key) == F.col("__good"), "left_semi")
    own = staged(own.select(F.col("score").alias("v")))
    low = exact_quantile(own, quantile)
    unstaged(own)
    low = -math.inf if low is None else low
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(low)))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
