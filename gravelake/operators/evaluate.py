"""Retrieval quality: hit tests, gold rules, feedback verdicts and their summaries, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelake.functions import text as X

KS = (1, 3, 5)


def _at(ok: Column, k: int) -> Column:
    return F.coalesce(F.bool_or(ok & (F.col("rank") <= k)), F.lit(False))


def _share(c: str) -> Column:
    return F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6)


def hit_rows(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (id, query, expected) -> hit1, hit3, hit5, top_result, top_score; a query without hits misses."""
    d = queries.select("id", "query", "expected").join(hits.withColumnRenamed("query_id", "id"), "id", "left")
    ok = X.any_of(F.col("expected"), X.haystack()) & F.col("rank").isNotNull()
    first = F.max(F.when(F.col("rank") == 1, F.struct(F.substring(X.text_or_empty("text"), 1, 200).alias("t"), F.col("score").alias("s"))))
    out = d.groupBy("id", "query").agg(*[_at(ok, k).alias(f"hit{k}") for k in KS], first.alias("f"))
    return out.select("id", "query", *[f"hit{k}" for k in KS], F.coalesce("f.t", F.lit("")).alias("top_result"), F.coalesce("f.s", F.lit(0.0)).alias("top_score"))


def hit_summary(rows: DataFrame, experiment: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total_queries"), *[_share(f"hit{k}").alias(f"hit{k}") for k in KS]).withColumn("experiment", F.lit(experiment))


def strict_hit() -> Column:
    """The path has one of the rule's needles, and the text all of its words; no needles or words ask for nothing."""
    needles = F.transform("file_path_contains", lambda n: F.replace(n, F.lit("\\"), F.lit("/")))
    path_ok = X.none_given(F.col("file_path_contains")) | X.any_of(needles, X.slashed("file_path", lower=True))
    return path_ok & X.all_of(F.col("must_contain_all"), X.haystack())


def soft_hit() -> Column:
    """The text has any of the rule's words; no words never hit."""
    return X.any_of(F.col("must_contain_all"), X.haystack())


def gold_rows(hits: DataFrame, queries: DataFrame, rules: DataFrame) -> DataFrame:
    """Strict and soft hits of the queries that have a rule."""
    d = queries.select("id", "query").join(rules, "id").join(hits.withColumnRenamed("query_id", "id"), "id", "left")
    there = F.col("rank").isNotNull()
    tests = [_at(there & t, k).alias(f"{n}{k}") for n, t in (("soft_hit", soft_hit()), ("strict_hit", strict_hit())) for k in KS]
    first = F.max(F.when(F.col("rank") == 1, F.struct(X.text_or_empty("file_path").alias("p"), F.col("score").alias("s"))))
    out = d.groupBy("id", "query").agg(*tests, first.alias("f"))
    names = [f"{n}{k}" for n in ("soft_hit", "strict_hit") for k in KS]
    return out.select("id", "query", *names, F.coalesce("f.s", F.lit(0.0)).alias("top_score"), F.coalesce("f.p", F.lit("")).alias("top_file"))


def gold_summary(rows: DataFrame, experiment: str) -> DataFrame:
    names = [f"{n}{k}" for n in ("soft_hit", "strict_hit") for k in KS]
    return rows.agg(F.count(F.lit(1)).alias("total_queries"), *[_share(n).alias(n) for n in names]).withColumn("experiment", F.lit(experiment))


def path_relevant(needles: Column, path: Column | str = "file_path") -> Column:
    return X.any_of(needles, X.slashed(path, lower=True))


def actionable() -> Column:
    """Wiki hits need a section title; others a block name, or an assignment and a brace in the text."""
    path = X.slashed("file_path", lower=True)
    wiki = F.contains(path, F.lit("wiki")) | F.endswith(path, F.lit(".md"))
    body = X.text_or_empty("text")
    script = (X.text_or_empty("block_name") != "") | (F.contains(body, F.lit("=")) & F.contains(body, F.lit("{")))
    return F.when(wiki, X.text_or_empty("section_title") != "").when(path == "", F.lit(False)).otherwise(script)


#: Fixed value: the symbol that a false-positive guard looks for.
GUARDED = "validate_mod"


def feedback_rows(hits: DataFrame, queries: DataFrame, gold: DataFrame, guarded: str = GUARDED) -> DataFrame:
    """Verdicts of every query; one without a rule is scorable by an empty rule. An absent list differs from an empty one
    only for top1_path_substrings, which then falls back to the acceptable paths."""
    d = queries.select("id", "query").join(gold.drop("note"), "id", "left").join(hits.withColumnRenamed("query_id", "id").drop("query"), "id", "left")
    hay, there, path = X.haystack(), F.col("rank").isNotNull(), X.slashed("file_path", lower=True)
    acceptable = F.coalesce("acceptable_path_substrings", F.array().cast("array<string>"))
    own_paths = F.coalesce("top1_path_substrings", acceptable)
    path_ok = X.none_given(own_paths) | path_relevant(own_paths)
    all_words, any_words = F.col("top1_text_must_contain_all"), F.col("top1_text_must_contain_any")
    top1 = F.when(~X.none_given(all_words), X.all_of(all_words, hay) & path_ok).when(~X.none_given(any_words), X.any_of(any_words, hay) & path_ok).otherwise(path_ok)
    relevant = path_relevant(acceptable) | X.any_of(any_words, hay)
    three = F.col("top3_text_must_contain_any")
    top3 = F.when(~X.none_given(three), X.any_of(three, hay)).otherwise(relevant)
    wrong = ~F.contains(path, F.lit("wiki")) & F.contains(hay, F.lit(guarded.lower())) & (F.contains(path, F.lit("game")) | F.contains(path, F.lit("common")))
    d = d.select("id", "query", "scorable", "false_positive_guard", "skip_noise", (F.size(acceptable) > 0).alias("has_paths"), "rank", "file_path",
                 (there & top1).alias("__1"), (there & top3).alias("__3"), (there & relevant).alias("__r"), (there & wrong).alias("__w"), (there & actionable()).alias("__a"))
    five = there & (F.col("rank") <= 5)
    g = d.groupBy("id", "query", "scorable", "false_positive_guard", "skip_noise", "has_paths").agg(
        _at(F.col("__1"), 1).alias("t1"), _at(F.col("__3"), 3).alias("t3"), _at(F.col("__w"), 5).alias("bad"), _at(F.col("__a"), 1).alias("actionability"),
        F.count_if(five).alias("n5"), F.count_if(five & F.col("__r")).alias("r5"), F.max(F.when(F.col("rank") == 1, F.substring(X.text_or_empty("file_path"), 1, 120))).alias("f"),
    )
    scorable, guard = F.coalesce("scorable", F.lit(True)), F.coalesce("false_positive_guard", F.lit(False))
    noise = F.when(F.col("has_paths"), 1 - F.col("r5") / F.greatest("n5", F.lit(1))).otherwise((F.col("n5") > 0).cast("double"))
    return g.select(
        "id", "query", scorable.alias("scorable"),
        F.when(guard, ~F.col("bad")).when(scorable, F.col("t1")).otherwise(False).alias("top1_correct"),
        F.when(guard, ~F.col("bad")).when(scorable, F.col("t3")).otherwise(False).alias("top3_recall"),
        F.when(~guard & scorable & ~F.coalesce("skip_noise", F.lit(False)), F.round(noise, 6)).alias("noise_top5"),
        "actionability", F.when(guard, ~F.col("bad")).alias("false_positive_pass"), F.coalesce("f", F.lit("")).alias("top1_file"),
    )


def feedback_summary(rows: DataFrame, experiment: str) -> DataFrame:
    """Means over scorable queries; noise over those that have one, null if none has."""
    d = rows.filter("scorable").agg(
        F.count(F.lit(1)).alias("scorable_queries"), _share("top1_correct").alias("top1"), _share("top3_recall").alias("top3"),
        F.round(F.avg("noise_top5"), 6).alias("noise_top5_mean"), _share("actionability").alias("actionability"),
    )
    return d.withColumn("experiment", F.lit(experiment))


def grade() -> Column:
    return F.when(F.col("hit1"), "HIT@1").when(F.col("hit3"), "HIT@3").when(F.col("hit5"), "HIT@5").otherwise("MISS")


def compared_queries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Grades of the queries of both runs, and which is better."""
    order = F.array(*map(F.lit, ("HIT@1", "HIT@3", "HIT@5", "MISS")))
    d = a.select("id", "query", grade().alias("grade_a")).join(b.select("id", grade().alias("grade_b")), "id")
    pa, pb = F.array_position(order, F.col("grade_a")), F.array_position(order, F.col("grade_b"))
    return d.withColumn("note", F.when(pb < pa, "B better").when(pb > pa, "A better").otherwise(""))


def better_lists(compared: DataFrame) -> DataFrame:
    """Ids on which either run is better, in order; a row each of a number of queries that people read."""
    ids = lambda n: F.array_join(F.sort_array(F.collect_list(F.when(F.col("note") == n, F.col("id").cast("string")))), ",")
    return compared.agg(ids("B better").alias("b_better"), ids("A better").alias("a_better"))


def metric_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, a, b, delta of two summaries."""
    long = lambda s, n: s.select(F.explode(F.array(*[F.struct(F.lit(f"hit@{k}").alias("metric"), F.col(f"hit{k}").alias(n)) for k in KS])).alias("x")).select("x.*")
    return long(a, "a").join(long(b, "b"), "metric").withColumn("delta", F.round(F.col("b") - F.col("a"), 6))
