"""Best-fit packing of documents into sequences of a fixed number of tokens.

1. Tokenise: each document becomes its ids and an end id. A longer one is cut into full pieces, of which the
   first may be shorter. Only a row of numbers for each piece leaves the task.
2. Bulk-synchronous best fit. Pieces are range-sorted by length together with gaps (what is left of open
   sequences) by size. Pieces of a length are alike and so are gaps of a size, so the rows that are sorted are
   runs of them, and a row says how many. A successor sweep walks each range upwards: a gap takes the longest
   piece below it that no gap before has taken. What is left of a range, short gaps and long pieces, meets that
   of all other ranges. Pieces that want the same gap are
   told apart by rank, the k-th piece of a run getting the k-th place. Then gaps are updated, and the sweep is
   repeated until nothing fits; new sequences are opened for what is left, and again. Lengths go in bands, each half
   as long as the one before, so that short pieces are still there to fill the last gaps.
3. Every piece finds its rank among those of its length, and with it the run that it was paired with. Ranks
   come from counts over salted parts of a length, so that a length that most pieces have is no hot group.

Results at the edges: null and empty texts are just the end id; repeated rows are packed each on its own; an
empty table gives an empty result; other columns are ignored. The string of a special token in a text gives the token's
id, as the tokenizer does.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravelake.llm.common import staged, table, unstaged

CAPACITY = 2048
_SALTED = 2_000
#: Ranges of a sweep's levels, sweeps of a job, and rows of a plan that is broadcast.
_RANGES = (8, 1)
_SWEEPS = 2
_PLAN_ROWS = 500_000
#: Fixed value: the byte-level pre-tokenizer's pattern.
_PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Anything but characters for which the tables of all regex libraries agree.
_ODD = re.compile("[^ \t\r\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")


class Ids:
    """A text's ids as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.quick = _same_ranks(path, self.tokenizer)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([_ODD.pattern, *added]))

    def of(self, text: str) -> bytes:
        """Plain texts go through a faster encoder of the same vocabulary, all others through the tokenizer itself; tests hold one against the other."""
        plain = self.quick and not self.odd.search(text)
        return array("I", self.quick(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def _same_ranks(path: str, tokenizer):
    """A faster encoder of plain texts, built from the tokenizer's own vocabulary; None if it has another kind of vocabulary."""
    import json

    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    if model["type"] != "BPE" or sys.byteorder != "little":
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items()}
    joins = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in joins]
    if any(x >= y for x, y in zip(order, order[1:], strict=False)):  # merges must come in the order of the ids
        return None
    return tiktoken.Encoding("plain", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


_loaded: dict[str, Ids] = {}


def tokenizer_ids(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; all but the first are full."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, total, capacity))]


def tokenised(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: key, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, stop = tokenizer_ids(path), end.to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            owner: list[int] = []
            for k, t in enumerate(b.column(1)):
                ids = memoryview(ids_of.of(t.as_py() or "") + stop)
                for p, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    owner.append(k)
                    rows.append((p, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *columns], [key, "piece", "start", "length", "ids_crc32"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


_STATE = "kind int, size bigint, first bigint, n bigint, used bigint, each bigint, rank bigint"
#: kind: a run of pieces (size: length, first: rank of the first), of gaps (first: sequence, used: tokens before the gap), of
#: gaps that took a piece in this sweep, and of pairs (size: length, each: pieces a sequence).
PIECE, GAP, UPDATED, PAIR = range(4)


def sweep(rows: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """One range's runs after a successor sweep: every gap takes pieces of one length at most."""
    out = [r for r in rows if r[0] > GAP]
    waiting: list[list[int]] = []  # runs of pieces, the longest last
    for kind, size, first, n, used, _, _ in sorted((r for r in rows if r[0] <= GAP), key=lambda r: (r[1], r[0], r[2])):
        if kind == PIECE:
            waiting.append([size, first, n])
            continue
        while n and waiting:
            length, rank, have = run = waiting[-1]
            each = min(size // length, have)
            gaps = min(n, have // each)
            out.append((PAIR, length, first, gaps * each, used, each, rank))
            if size > each * length:
                out.append((UPDATED, size - each * length, first, gaps, used + each * length, 0, 0))
            run[1:] = rank + gaps * each, have - gaps * each
            first, n = first + gaps, n - gaps
            if not run[2]:
                waiting.pop()
        if n:
            out.append((GAP, size, first, n, used, 0, 0))
    return out + [(PIECE, length, rank, n, 0, 0, 0) for length, rank, n in waiting]


def swept(state: DataFrame, capacity: int) -> DataFrame:
    """The state after a sweep over all ranges, with the gaps that it updated ready for the next."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sweep(list(zip(*(t[c].to_pylist() for c in t.column_names[1:]), strict=True)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(t.schema)[1:], strict=True)], pa.schema(list(t.schema)[1:]))

    for ranges in _RANGES:
        state = state.select(F.floor((F.col("size") - 1) * ranges / capacity).alias("range"), "*").groupBy("range").applyInArrow(run, _STATE)
    return state.withColumn("kind", F.when(F.col("kind") == UPDATED, GAP).otherwise(F.col("kind")))


def best_fit(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY) -> DataFrame:
    """Pairs of runs, from the number of pieces of each length: length, rank (first), n (pieces), first (sequence), each (pieces a sequence), used (first offset)."""
    if counts and not 0 < min(counts) <= max(counts) <= capacity:
        raise ValueError("a piece is empty or longer than a sequence")
    last = None
    state, opened, top, widest = spark.createDataFrame([], _STATE), 0, capacity, 0
    while top:
        low = top // 2 + 1
        new = [(PIECE, n, 0, counts[n], 0, 0, 0) for n in range(low, top + 1) if counts.get(n)]
        left, least, top = sum(r[1] * r[3] for r in new), min((r[1] for r in new), default=0), low - 1
        while left:
            if widest < least:  # nothing fits
                more = -(-left // capacity)
                new.append((GAP, capacity, opened, more, 0, 0, 0))
                opened += more
            if new:
                state, new = state.unionByName(spark.createDataFrame(new, _STATE)), []
            for _ in range(_SWEEPS):
                state = swept(state, capacity)
            before, last = last, staged(state)
            state = last
            unstaged(before)
            piece, gap = F.when(F.col("kind") == PIECE, F.col("size")), F.when(F.col("kind") == GAP, F.col("size"))
            left, least, widest = (x or 0 for x in state.agg(F.sum(piece * F.col("n")), F.min(piece), F.max(gap)).first())
    return state.filter(f"kind = {PAIR}").select(F.col("size").alias("length"), "rank", "n", "first", "each", "used")


def packed(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces (key, piece, start, length, ids_crc32), which must be a stored table."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    plan = best_fit(spark, counts, capacity)
    plan = plan.select(*[F.col(c).alias(f"p_{c}") for c in plan.columns])
    salts = max(16, -(-max(counts.values(), default=1) // _SALTED))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = W.partitionBy("length").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = salted.withColumn("__rn", F.row_number().over(W.partitionBy("length", "__salt").orderBy(key, "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__rn") + F.col("__before"))
    own = (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("p_rank")) & (F.col("__rank") < F.col("p_rank") + F.col("p_n"))
    if plan.count() <= _PLAN_ROWS:  # a few runs a length, whatever the number of documents
        plan = F.broadcast(plan)
    else:
        plan = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = own & (F.col("__salt") == F.col("p_salt"))
    d = ranked.join(plan, own)
    at = F.col("__rank") - F.col("p_rank")
    return d.select(*pieces.columns, (F.col("p_first") + F.floor(at / F.col("p_each"))).alias("sequence_id"), (F.col("p_used") + (at % F.col("p_each")) * F.col("length")).alias("offset"))


def pack(df: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return packed(staged(tokenised(df, path, capacity, key=key, text=text)), capacity, key)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places."""
    return pack(docs)
