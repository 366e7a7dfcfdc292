"""Language-model scores by a hierarchical Pitman-Yor process over words in the context of the word before.

Tokens are words and one end for each text; the first word's context is the end. Words are told by 64-bit hashes.
The `FREQUENT` most frequent words have a symbol each, and all others share one, so that every token is a
symbol behind a symbol. Each symbol has a context restaurant, in which the tokens behind it are seated; all context
restaurants share one parent, which seats a customer for each of their tables and falls back to all symbols alike. A
rare word is its symbol and then a customer of the restaurant of rare words, which falls back to all rare words and the
unknown word alike. So the probabilities of all words of the vocabulary and of the unknown word sum to one in any context.

Seating follows the Chinese restaurant process. Gibbs sweeps reseat every dish given the tables of the others as
of the sweep before, in the contexts and then in their parent; the first sweeps are dropped, and over the others the
tables of a dish and the parent's probabilities are averaged. The draws of a dish come from hashes of its name and
the number of the sweep, so they depend on nothing else, and every customer is seated, however many a dish has.

Every token, every pair of symbols and every word is counted. Pairs are dealt to parts by their first symbol and a block of the
second, rare words by hash, and neither is ever held in one place; a pair that is very frequent is summed before it is
sent. What is held at once has a fixed size: a number a symbol, and the most frequent pairs. Texts are scored in
windows: pairs and words that are not at hand travel, packed by part, to the task that holds the part, and their
logs back to the window.

Results at the edges: a null text counts as empty and has just its end; rows with a null id train the model;
with no training token nothing is known and all words are alike; repeated rows are scored each on their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from gravelake.llm.common import staged, table, unstaged

FREQUENT = 1 << 18
PAIRS = 1 << 19
SAMPLES = 3
BURN_IN = 2
STRENGTH = 1.0
_AT_ONCE = 200_000
_PART_TOKENS = 1_200_000
_PART_WORDS = 150_000
_COUNT_WINDOW = 1_500_000
_SCORE_WINDOW = 600_000
_STEP_WORDS = 100_000
_SLICES = 16
_BITS = 20
_BLOCK = 11
_PLAIN_BYTES = 4096
_LOW = np.uint64((1 << _BITS) - 1)
_END = np.uint64(xxh3_64_intdigest(b""))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_codec = pa.Codec("zstd", 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words, ASCII letters lowered, and of its end."""
    ws = text.encode().lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    return np.append(np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws)), _END)


def planes(a: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on, compressed: what the JVM holds of a part is a fraction of its numbers.
    The first eight bytes tell how many there are, or 0 if they were too few to compress."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    if len(raw) < _PLAIN_BYTES:
        return bytes(8) + raw
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unplaned(b, kind: str) -> np.ndarray:
    b = memoryview(b)
    n, rest = int.from_bytes(b[:8], "little"), b[8:]
    raw = np.frombuffer(_codec.decompress(rest, n) if n else rest, np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()


class Lookup:
    """Places of 64-bit numbers among distinct ones, -1 for others: an open-addressed table, probed for all at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(keys))
        at = self._start(keys)
        while len(todo):
            free = self.place[at] < 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.place[at[put]] = keys[todo[put]], todo[put]
            todo, at = todo[~put], (at[~put] + 1) & self.mask

    def _start(self, x: np.ndarray) -> np.ndarray:
        return ((x * _A) >> self.shift).astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int32)
        who, at = np.arange(len(x)), self._start(x)
        while len(who):
            place = self.place[at]
            hit = (self.slots[at] == x[who]) & (place >= 0)
            out[who[hit]] = place[hit]
            go = ~hit & (place >= 0)
            who, at = who[go], (at[go] + 1) & self.mask
        return out


def _opened(names: np.ndarray, first: np.ndarray, n: np.ndarray, tables: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables that the next n customers of each dish open, the first of them coming to `first` seated ones at `tables`.

    All customers are drawn at once: one opens a table if the dish has more tables by then than the draw allows. Starting from
    the least number that there can be, the tables before each customer are counted until no count changes,
    which is the result of seating them one by one.
    """
    out = np.zeros(len(n))
    dish = np.arange(len(n))
    owner = np.repeat(dish, n)
    starts = np.cumsum(n) - n
    seen = np.arange(len(owner)) - np.repeat(starts, n) + first[owner]
    drawn = mixed(mixed(names + np.uint64((int(_A) * (sweep + 1)) & 0xFFFFFFFFFFFFFFFF))[owner] + seen.astype(np.uint64) * _B)
    drawn = np.maximum(drawn.astype(float) / 2.0**64, 1e-18)
    w = new[owner]
    least = (drawn * (w + seen) - w) / (drawn * discount) if discount else np.where(drawn * (w + seen) < w, -1.0, np.inf)
    before = tables[owner]
    while len(dish):
        opens = least < before
        count = np.add.reduceat(opens, starts, dtype=np.int64)
        above = np.cumsum(opens) - opens
        now = above - np.repeat(above[starts], n[dish]) + tables[dish].repeat(n[dish])
        change = np.logical_or.reduceat(now != before, starts)
        out[dish[~change]] = count[~change]
        keep = np.repeat(change, n[dish])
        dish, least, before = dish[change], least[keep], now[keep]
        starts = np.cumsum(n[dish]) - n[dish]
    return out


def seated(names: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Number of tables of dishes with so many customers; new: the weight of a new table."""
    tables = (customers > 0).astype(float)
    left = np.maximum(customers.astype(np.int64) - 1, 0)
    more = np.flatnonzero(left)
    while len(more):  # dishes with more customers than fit come again
        some = np.minimum(left[more], _AT_ONCE)
        group = np.cumsum(some) // _AT_ONCE
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(more)], strict=True):
            at, n = more[a:z], some[a:z]
            tables[at] += _opened(names[at], customers[at].astype(np.int64) - left[at], n, tables[at], new[at], discount, sweep)
        left[more] -= some
        more = more[left[more] > 0]
    return tables


def discount_of(once: float, twice: float) -> float:
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.5


@dataclass
class Sweep:
    """What the next sweep of the contexts needs of this one."""

    tables: np.ndarray  # of each symbol's context restaurant
    parent: np.ndarray  # probability of each symbol


@dataclass
class Model:
    """What a task needs besides its parts: a number a symbol, and the most frequent pairs."""

    tokens: int
    words: int
    symbols: np.ndarray  # hashes of the frequent words; one more symbol stands for the rare ones
    counts: np.ndarray  # tokens of each symbol
    rare_words: int = 0
    discount: float = 0.5
    rare_discount: float = 0.5
    rare_tables: list[float] = field(default_factory=list)  # of the restaurant of rare words before each sweep that is averaged, and then their mean after it
    tables: np.ndarray | None = None
    parent: np.ndarray | None = None
    pair_keys: np.ndarray | None = None
    pair_logs: np.ndarray | None = None

    def logs(self, keys: np.ndarray, counts: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """By how much a pair that was seen is more probable (log10) than its symbols apart; tables: the mean ones."""
        u, w = (keys >> np.uint64(_BITS)).astype(np.int64), (keys & _LOW).astype(np.int64)
        own = np.maximum(counts - self.discount * tables, 0)
        return np.log10(1 + own / ((STRENGTH + self.discount * self.tables[u]) * self.parent[w]))

    def apart(self) -> np.ndarray:
        """Log10 of each symbol's probability in the parent, and of what its own context leaves to the parent."""
        return np.log10(self.parent) + np.log10((STRENGTH + self.discount * self.tables) / (STRENGTH + self.counts))

    def rare_logs(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 of the probabilities of rare words among the rare words; of an unknown one where the count is 0."""
        customers = self.counts[-1]
        mean = np.mean([rare_tables(hashes, counts, t, self, BURN_IN + i) for i, t in enumerate(self.rare_tables[:-1])], 0)
        own = np.maximum(counts - self.rare_discount * mean, 0)
        return np.log10((own + (STRENGTH + self.rare_discount * self.rare_tables[-1]) / (self.rare_words + 1)) / (STRENGTH + customers))

    def parts(self) -> tuple[int, int]:
        """Into how many parts pairs and rare words are dealt: rare words by their tokens too, as each part is asked for all of them."""
        return max(8, -(-self.tokens // _PART_TOKENS)), max(8, -(-self.rare_words // _PART_WORDS), -(-int(self.counts[-1]) // _PART_TOKENS))

    def add_one(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words + 1))


def pair_tables(keys: np.ndarray, counts: np.ndarray, before: Sweep, discount: float, sweep: int) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    for a in range(0, len(keys), _AT_ONCE):
        k = keys[a : a + _AT_ONCE]
        weight = (STRENGTH + discount * (before.tables[(k >> np.uint64(_BITS)).astype(np.int64)] - 1)) * before.parent[(k & _LOW).astype(np.int64)]
        out[a : a + _AT_ONCE] = seated(k, counts[a : a + _AT_ONCE], weight, discount, sweep)
    return out


def rare_tables(hashes: np.ndarray, counts: np.ndarray, before: float, model: Model, sweep: int) -> np.ndarray:
    weight = (STRENGTH + model.rare_discount * max(before - 1, 0)) / (model.rare_words + 1)
    return seated(hashes, counts, np.full(len(counts), weight), model.rare_discount, sweep)


def _steps(column) -> Iterator[list[np.ndarray]]:
    """Hashes of the texts of a batch, a bounded number of words (or one text) at a time."""
    held, n = [], 0
    for t in column:
        h = token_hashes(t.as_py())
        if held and n + len(h) > _STEP_WORDS:
            yield held
            held, n = [], 0
        held.append(h)
        n += len(h)
    if held:
        yield held


def word_counts(texts: DataFrame) -> DataFrame:
    """h and c of every word of a table with one text column, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for b in batches:
            for step in _steps(b.column(0)):
                held += step
                size += sum(map(len, step))
                if size > _COUNT_WINDOW:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    return texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


def paired(hashes: list[np.ndarray], lookup: Lookup, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts' tokens, laid end to end, and the keys of their pairs with the symbols before."""
    flat = np.concatenate(hashes)
    symbol = lookup(flat)
    symbol[symbol < 0] = rare
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    ends = np.cumsum([len(h) for h in hashes])
    before[ends - [len(h) for h in hashes]] = symbol[ends - 1]  # a text's last token is its end
    return symbol, (before.astype(np.uint64) << np.uint64(_BITS)) | symbol.astype(np.uint64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys >> np.uint64(_BLOCK)) % np.uint64(parts)).astype(np.int64)


def _dealt(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part and the rows that belong to it."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(part[order[a]]), order[a:z]


def added(pieces: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts. Pieces are added up whenever there is as much again as is distinct, and a window at least;
    so what is held follows the distinct keys, not the number of windows that a frequent pair comes from."""

    def told() -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[heads], np.add.reduceat(n, heads)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, most = 0, _COUNT_WINDOW
    for keys, n in pieces:
        held.append((keys, n.astype(np.int64)))
        size += len(keys)
        if size > most:
            held = [told()]
            size = len(held[0][0])
            most = max(_COUNT_WINDOW, 2 * size)
    return told()


def pair_counts(texts: DataFrame, symbols: np.ndarray, parts: int) -> DataFrame:
    """A stored table with a row for each part: keys (sorted) and counts of its pairs, packed."""
    shared = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, rare = Lookup(shared.value), len(shared.value)
        held: list[np.ndarray] = []
        size = 0

        def told() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            rows = [(p, planes(keys[at]), planes(n[at].astype(np.uint32))) for p, at in _dealt(_part_of(keys, parts))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["part", "keys", "counts"])

        for b in batches:
            for step in _steps(b.column(0)):
                held.append(paired(step, lookup, rare)[1])
                size += len(held[-1])
                if size > _COUNT_WINDOW:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        keys, n = added((unplaned(k.as_buffer(), "<u8"), unplaned(c.as_buffer(), "<u4")) for k, c in zip(t["keys"], t["counts"], strict=True))
        return pa.table({"part": pa.array([key[0].as_py()]), "keys": pa.array([planes(keys)]), "counts": pa.array([planes(n)])})

    schema = "part bigint, keys binary, counts binary"
    return staged(texts.mapInArrow(run, schema).groupBy("part").applyInArrow(summed, schema))


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for k, c in zip(b.column("keys"), b.column("counts"), strict=True):
            yield unplaned(k.as_buffer(), "<u8"), unplaned(c.as_buffer(), "<i8")


def vectors(df: DataFrame, rows: int, width: int, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None]) -> np.ndarray:
    """The sum over all tasks of the fixed number of numbers that each adds up."""
    cut = -(-width // _SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, cut * _SLICES))
        add(batches, total[:, :width])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES)), pa.array([planes(total[:, i * cut : (i + 1) * cut].ravel()) for i in range(_SLICES)])], ["slice", "v"])

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        out = np.zeros(rows * cut)
        for v in t["v"]:
            out += unplaned(v.as_buffer(), "<f8")
        return pa.table({"slice": pa.array([key[0].as_py()]), "v": pa.array([out.tobytes()])})

    out = np.zeros((rows, cut * _SLICES))
    for r in df.mapInArrow(run, "slice bigint, v binary").groupBy("slice").applyInArrow(summed, "slice bigint, v binary").collect():  # a fixed size
        out[:, r.slice * cut : (r.slice + 1) * cut] = np.frombuffer(r.v).reshape(rows, cut)
    return out[:, :width]


def parent_of(customers: np.ndarray, tables: float, sweep: int) -> tuple[np.ndarray, float]:
    """Probabilities of the symbols in the parent restaurant, and its tables, given how many it had."""
    k, discount = len(customers), discount_of((customers == 1).sum(), (customers == 2).sum())
    t = seated(np.arange(k).astype(np.uint64), customers, np.full(k, (STRENGTH + discount * max(tables - 1, 0)) / k), discount, sweep)
    own = (customers - discount * t + (STRENGTH + discount * t.sum()) / k) / (STRENGTH + customers.sum())
    return own, t.sum()


def train(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the stored table of pairs (a row a part), and that of the words (h, c)."""
    sc = texts.sparkSession.sparkContext
    words = staged(word_counts(texts))
    top = words.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # a fixed number of rows
    symbols, counts = top["h"].to_numpy().view(np.uint64), top["c"].to_numpy()
    got = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    model = Model(got.n, got.v, symbols, np.append(counts, got.n - counts.sum()).astype(float), got.v - len(symbols))
    model.rare_discount = discount_of(got.once - (counts == 1).sum(), got.twice - (counts == 2).sum())
    k = len(symbols) + 1
    pairs = pair_counts(texts, symbols, model.parts()[0])
    many = 1 << 16

    def types(batches: Iterator[pa.RecordBatch], total: np.ndarray) -> None:
        for keys, n in _parts_of(batches):
            total[0, :k] += np.bincount((keys >> np.uint64(_BITS)).astype(np.int64), minlength=k)
            total[1, :k] += np.bincount((keys & _LOW).astype(np.int64), minlength=k)
            total[2, :many] += np.bincount(np.minimum(n, many - 1), minlength=many)

    tables, customers, frequency = vectors(pairs, 3, max(k, many), types)
    tables, customers = tables[:k], customers[:k]
    model.discount = discount_of(frequency[1], frequency[2])
    fewest = int(np.argmax(np.cumsum(frequency[::-1])[::-1] <= PAIRS)) if frequency.sum() > PAIRS else 1
    own, above = parent_of(customers, float(k), 0)
    state = Sweep(tables, own)
    rare = float(model.rare_words)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    sampled: list[Sweep] = []
    rare_words = words.filter(F.col("c") <= (int(counts[-1]) if model.rare_words else 0))
    frequent = sc.broadcast(symbols)
    for sweep in range(BURN_IN + SAMPLES):
        if sweep >= BURN_IN:
            sampled.append(state)
            model.rare_tables.append(rare)
        shared = sc.broadcast((state, model.discount))

        def reseat(batches: Iterator[pa.RecordBatch], total: np.ndarray, shared=shared, sweep=sweep) -> None:
            before, discount = shared.value
            for keys, n in _parts_of(batches):
                t = pair_tables(keys, n, before, discount, sweep)
                total[0] += np.bincount((keys >> np.uint64(_BITS)).astype(np.int64), t, minlength=k)
                total[1] += np.bincount((keys & _LOW).astype(np.int64), t, minlength=k)

        def reseat_rare(batches: Iterator[pa.RecordBatch], total: np.ndarray, rare=rare, sweep=sweep, bare=Model(0, 0, symbols[:0], symbols[:0], model.rare_words, rare_discount=model.rare_discount)) -> None:
            lookup = Lookup(frequent.value)
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                own = lookup(h) < 0
                total[0, 0] += rare_tables(h[own], b.column(1).to_numpy()[own], rare, bare, sweep).sum()

        tables, customers = vectors(pairs, 2, k, reseat)
        rare = float(vectors(rare_words.select("h", "c"), 1, 1, reseat_rare)[0, 0]) if model.rare_words else 0.0
        own, above = parent_of(customers, above, sweep + 1)
        state = Sweep(tables, own)
        if sweep >= BURN_IN:
            kept.append((tables, own))
    model.tables, model.parent = np.mean([x[0] for x in kept], 0), np.mean([x[1] for x in kept], 0)
    model.rare_tables.append(float(np.mean([*model.rare_tables[1:], rare])))
    shared_sweeps, shared_model = sc.broadcast((sampled, model.discount)), sc.broadcast(model)

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps, discount = shared_sweeps.value
        for b in batches:
            for part, keys, n in zip(*b.columns, strict=True):
                k, c = unplaned(keys.as_buffer(), "<u8"), unplaned(n.as_buffer(), "<i8")
                t = sum(pair_tables(k, c, s, discount, BURN_IN + i) for i, s in enumerate(sweeps))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()]), pa.array([keys.as_py()]), pa.array([n.as_py()]), pa.array([planes(t)])], ["part", "keys", "counts", "tables"])

    counted, pairs = pairs, staged(pairs.mapInArrow(averaged, "part bigint, keys binary, counts binary, tables binary"))
    unstaged(counted)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in zip(*b.columns, strict=True):
                keys, n, t = (unplaned(x.as_buffer(), kind) for x, kind in zip(part[1:], ("<u8", "<i8", "<i8"), strict=True))
                some = n >= fewest
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(shared_model.value.logs(keys[some], n[some], t[some] / SAMPLES))], ["k", "b"])

    best = pairs.mapInArrow(often, "k bigint, b double").toArrow()  # at most PAIRS rows
    model.pair_keys, model.pair_logs = best["k"].to_numpy().view(np.uint64), best["b"].to_numpy()
    return model, pairs, words


def score(docs: DataFrame, model: Model, pairs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (key, held_out, text) -> key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    parts, word_parts = model.parts()
    kind = docs.schema[key].dataType
    told_kind = pa.struct([("key", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    told_sql = f"array<struct<key:{kind.simpleString()},held_out:boolean,n_tokens:bigint,n_known:bigint,base:double,score:double>>"
    names = ["part", "win", "own", "asked", "docs"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(told_kind)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lookup, often, rare = Lookup(m.symbols), Lookup(m.pair_keys), len(m.symbols)
        apart, ones = m.apart(), np.append(m.add_one(m.counts[:-1]), 0.0)
        logs = np.append(m.pair_logs, 0.0)
        window = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def told() -> pa.RecordBatch:
            keys, own, hashes, hash_own = (np.concatenate([a[i] for a in asked]) for i in range(4))
            out = []
            order = np.argsort(keys)
            keys, own = keys[order], own[order]
            for p, at in _dealt(_part_of(keys, parts)):
                out.append((p, window, planes(own[at]), planes(keys[at]), None))
            for p, at in _dealt((mixed(hashes) % np.uint64(word_parts)).astype(np.int64)):
                out.append((parts + p, window, planes(hash_own[at]), planes(hashes[at]), None))
            out.append((int(mixed(np.array([window], np.uint64))[0] % np.uint64(parts)), window, None, None, [dict(zip(("key", "held_out", "n_tokens", "n_known", "base", "score"), r, strict=True)) for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            ids, held, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for step in _steps(b.column(2)):
                symbol, keys = paired(step, lookup, rare)
                n = np.array([len(h) for h in step])
                owner = np.repeat(np.arange(len(rows), len(rows) + len(step)), n).astype(np.uint32)
                starts = np.cumsum(n) - n
                there = often(keys)
                known = symbol < rare
                sums = [np.add.reduceat(x, starts) for x in (known.astype(np.int64), ones[symbol], apart[symbol] + logs[there])]
                rows += zip(ids[at : at + len(step)], held[at : at + len(step)], n.tolist(), *(s.tolist() for s in sums), strict=True)
                odd, strange = there < 0, ~known
                asked.append((keys[odd], owner[odd], np.concatenate(step)[strange], owner[strange]))
                size, at = size + int(n.sum()), at + len(step)
                if size > _SCORE_WINDOW:
                    yield told()
                    rows, asked, size, window = [], [], 0, window + 1
        if rows:
            yield told()

    def answered(part: tuple, have: pa.Table, sent: pa.Table) -> pa.Table:
        m = shared.value
        if part[0].as_py() < parts:
            keys, n, t = (np.concatenate([np.zeros(0, kind), *(unplaned(x.as_buffer(), kind) for x in have[c])]) for c, kind in (("keys", "<u8"), ("counts", "<i8"), ("tables", "<i8")))
            logs = np.append(m.logs(keys, n, t / SAMPLES) if len(keys) else [], 0.0)
        else:
            keys, n = have["h"].to_numpy().view(np.uint64), have["c"].to_numpy()
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            logs = np.append(m.rare_logs(keys, n), m.rare_logs(np.zeros(1, np.uint64), np.zeros(1)))
            ones = m.add_one(np.append(n, 0))
        out: dict[str, list] = {"own": [], "known": [], "base": [], "score": []}
        for own, ask in zip(sent["own"], sent["asked"], strict=True):
            if not own.is_valid:
                for c in ("own", "known", "base", "score"):
                    out[c].append(None)
                continue
            own, ask = unplaned(own.as_buffer(), "<u4"), unplaned(ask.as_buffer(), "<u8")
            at = np.searchsorted(keys, ask)
            if len(keys):
                at[(keys[np.minimum(at, len(keys) - 1)] != ask)] = len(keys)
            value = logs[at]
            if part[0].as_py() < parts:
                own, value = own[at < len(keys)], value[at < len(keys)]
            who, back = np.unique(own, return_inverse=True)
            out["own"].append(planes(who))
            out["score"].append(planes(np.bincount(back, value, minlength=len(who)).astype(np.float32)))
            rare = part[0].as_py() >= parts
            out["known"].append(planes(np.bincount(back, at < len(keys), minlength=len(who)).astype(np.uint32)) if rare else None)
            out["base"].append(planes(np.bincount(back, ones[at], minlength=len(who))) if rare else None)
        return pa.table({"win": sent["win"], **{c: pa.array(out[c], pa.binary()) for c in out}, "docs": sent["docs"]})

    def summed(key: tuple, t: pa.Table) -> pa.Table:
        rows = pa.concat_arrays([d.values for d in t["docs"] if d.is_valid])
        known, base, score_ = (rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_known", "base", "score"))
        for own, k, b, s in zip(*(t[c] for c in ("own", "known", "base", "score")), strict=True):
            if own.is_valid:
                own = unplaned(own.as_buffer(), "<u4")
                score_[own] += unplaned(s.as_buffer(), "<f4")
                if k.is_valid:
                    known[own] += unplaned(k.as_buffer(), "<u4")
                    base[own] += unplaned(b.as_buffer(), "<f8")
        return pa.table([rows.field("key"), rows.field("held_out"), rows.field("n_tokens"), pa.array(known.astype(np.int64)), pa.array(np.full(len(rows), model_tokens)), pa.array(base), pa.array(score_)], [key_name, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    model_tokens, key_name = int(model.tokens), key
    sent = docs.select(F.col(key).alias("key"), "held_out", text).mapInArrow(spread, f"part bigint, win bigint, own binary, asked binary, docs {told_sql}")
    symbols = sc.broadcast(np.sort(model.symbols))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            s = symbols.value
            own = pa.array((s[np.minimum(np.searchsorted(s, h), len(s) - 1)] != h) if len(s) else np.ones(len(h), bool))
            got = b.filter(own)
            h = got.column(0).to_numpy().view(np.uint64)
            none = pa.nulls(len(h), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(parts + (mixed(h) % np.uint64(word_parts)).astype(np.int64)), none, none, none, got.column(0), got.column(1)], ["part", "keys", "counts", "tables", "h", "c"])

    own = words.select("h", "c").mapInArrow(dealt, "part bigint, keys binary, counts binary, tables binary, h bigint, c bigint")
    own = own.unionByName(pairs.select("part", "keys", "counts", "tables", F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("c")))
    answers = own.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(answered, f"win bigint, own binary, known binary, base binary, score binary, docs {told_sql}")
    return answers.groupBy("win").applyInArrow(summed, f"`{key}` {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    return score(docs, *train(docs.filter(~F.col("held_out")).select("text")))
