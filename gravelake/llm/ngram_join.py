"""Similarity self-join on word shingles by parity sketches, and the components of its links.

Two texts link when the Jaccard similarity of their sets of five-word shingles reaches 0.75. The join is
exact up to 64-bit shingle hashes.

Sketches. Every shingle of a set flips one bit of its sketch (an XOR), so the Hamming distance of two sketches is
at most the size of the sets' symmetric difference, which for linked sets of sizes n and m is at most (n + m) / 7.
For the join, a size band cuts the shingles' range into pieces, and a piece is told by the XOR of 64 bits for each
of its shingles. A band has more pieces than differences, so linked sets agree on many pieces. Sorted by one order
for all sets, the first d + 1 pieces of both (d: the largest difference that the set's size allows) have one in
common: only those are emitted, and sets that share a piece are candidates. A set of a size near the lower end of
its band is emitted for the band below as well, so that all partners meet in the band of the smaller.

Order. Pieces of more shingles come first: texts that share but a passage seldom share such a piece. Pieces whose
shingles are all frequent in the corpus come after all others, and empty pieces last. Frequent shingles are counted
over all documents (each task reports those that it meets often, and the most frequent, a fixed number, are
broadcast); the order only decides which pieces are emitted and never loses a link.

Work. Equal sets, told by a 64-bit number, are collapsed and enter once. A piece that up to 16 sets share gives
all their pairs; the Hamming distance of whole sketches, of one to two bits a shingle, rules most false candidates
out, and the shingles of the rest are read. The sets of larger pieces are connected to clusters, and each cluster is compared
within itself in blocks, where an index of shingles compares a set with all others at once: only the number of
links of each set leaves the task, and links that join components. So every link is counted, and large groups
of copies emit as many rows as they have members. Pieces travel as packed blocks.

Results at the edges: every row is a document, and gets a row: repeated rows are copies that link with each other,
rows of one id with different texts are different documents, and rows without an id count like others but
give their id to a component only if it has no other (null). A text with fewer than five words is one shingle, its whole
sequence; null and empty texts have no shingles and link with nothing; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gravelake.llm.common import column, free_name, staged, table, unstaged

SHINGLE = 5
_FREQUENT = 1 << 18
_OFTEN = 3
_BAND = 2
#: Sets of a piece up to which all its pairs are candidates; those of larger ones meet in blocks of so many sets or shingles.
_SMALL = 16
_BLOCK_SETS = 2_048
_BLOCK_SHINGLES = 500_000
_SALTS = 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP_WORDS = 250_000
#: Shingles of a window, keys that a task holds before it packs them, and shingles for a part of the keys.
_WINDOW = 2_000_000
_BLOCK_ROWS = 1_000_000
_PART_SHINGLES = 1_200_000
_VIRTUAL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    h = h ^ (h >> np.uint64(29))
    h = h * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, laid end to end in ascending order, and how many each has."""
    coded = []
    for t in texts:
        ws = t.encode().lower().split() if t else []  # bytes: ASCII letters and ASCII white space only
        coded.append(np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, len(ws)))
    n = np.array([len(c) for c in coded], np.int64)
    flat = np.concatenate([*coded, np.zeros(SHINGLE, np.uint64)]) if len(coded) else np.zeros(SHINGLE, np.uint64)
    total = len(flat) - SHINGLE
    mixed = np.zeros(total, np.uint64)
    for i in range(SHINGLE):
        mixed += _mixed(flat[i : i + total] + _ODD[i]) * _ODD[i]
    mixed = _mixed(mixed)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), n)
    there = np.arange(total) <= (ends - SHINGLE)[owner] if total else np.zeros(0, bool)
    hashes, size = mixed[there], np.maximum(n - SHINGLE + 1, 0)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):  # the whole sequence is one shingle
        own = np.zeros(len(short), np.uint64)
        for j, k in enumerate(short):
            h = n[k : k + 1].astype(np.uint64)
            for i in range(n[k]):
                h = _mixed(h * _ODD[2] + coded[k][i : i + 1])
            own[j] = h[0]
        hashes = np.insert(hashes, (np.cumsum(size) - size)[short], own)
        size[short] = 1
    at = 0
    for k in size.tolist():
        hashes[at : at + k].sort()
        at += k
    if len(hashes):
        owner = np.repeat(np.arange(len(n)), size)
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, size = hashes[new], np.bincount(owner[new], minlength=len(n))
    return hashes, size.astype(np.int64)


def _digests(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets; 0 for an empty one."""
    out, at = [], 0
    for n in sizes.tolist():
        out.append(xxh3_64_intdigest(hashes[at : at + n].tobytes(), 11) if n else 0)
        at += n
    return np.array(out, np.uint64).view(np.int64)


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches of one to two bits a shingle; a longer one folds to a shorter by XOR of its halves."""
    band = np.maximum(band_of(sizes), 2) + 1
    words = (np.int64(1) << band) // 8
    first = np.cumsum(words) - words
    who = np.repeat(np.arange(len(sizes)), sizes)
    bit = ((hashes >> np.uint64(20)) & ((np.uint64(1) << band.astype(np.uint64)) - np.uint64(1))[who]).astype(np.int64)
    odd = (np.bincount(first[who] * 8 + bit, minlength=int(words.sum()) * 8) & 1).astype(np.uint8)
    flat = np.packbits(odd, bitorder="little").tobytes()
    return [flat[a : a + n] for a, n in zip(first, words, strict=True)]


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches at the shorter one's length: at most the size of the symmetric difference."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ y).bit_count()


def _steps(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with a bounded number of characters, or one row."""
    for b in batches:
        at, chars, texts = 0, 0, []
        for i, t in enumerate(b.column(column)):
            t = t.as_py()
            if texts and chars + len(t or "") > 6 * _STEP_WORDS:
                yield b.slice(at, i - at), texts
                at, chars, texts = i, 0, []
            texts.append(t)
            chars += len(t or "")
        if texts:
            yield b.slice(at, b.num_rows - at), texts


def set_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, th: a hash of the text) -> did (the set's number), n_shingles, sketch and rows of the sets that
    a task met, equal ones collapsed in each window of it; empty sets have no did. Shingles that a window met often come as rows without `rows`."""
    names = ["did", "n_shingles", "sketch", "rows", "often", "times"]
    row = pa.struct([("no", pa.bool_()), ("id", pa.int64()), ("th", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(row), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def told() -> Iterator[pa.RecordBatch]:
            did, n = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            sketch = [x for h in held for x in h[3]]
            ids, th = (pa.concat_arrays([h[i] for h in held]) for i in (4, 5))
            unique, first, back, size = np.unique(did, return_index=True, return_inverse=True, return_counts=True)
            order = pa.array(np.argsort(back, kind="stable"))
            own = pa.StructArray.from_arrays([ids.is_null().take(order), ids.take(order), th.take(order)], fields=list(row))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), own)
            none = pa.nulls(len(unique), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(unique, mask=n[first] == 0), pa.array(n[first]), pa.array([sketch[i] for i in first], pa.binary()), lists.cast(kinds[3]), none, none], names)
            h, c = np.unique(np.concatenate([x[0] for x in held]), return_counts=True)
            h, c = h[c >= _OFTEN], c[c >= _OFTEN]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(h), k) for k in kinds[:4]], pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names)

        for b, texts in _steps(batches, 1):
            hashes, sizes = shingles(texts)
            held.append((hashes, _digests(hashes, sizes), sizes, sketches(hashes, sizes), b.column(0), b.column(2)))
            if sum(len(h[0]) + len(h[1]) for h in held) > _WINDOW:
                yield from told()
                held = []
        if held:
            yield from told()

    return docs.select("doc_id", "text", "th").mapInArrow(run, "did bigint, n_shingles bigint, sketch binary, rows array<struct<no:boolean,id:bigint,th:bigint>>, often bigint, times bigint")


def band_of(n: np.ndarray) -> np.ndarray:
    """Band b holds the sizes from 2**b to 2**(b+1) - 1."""
    return np.floor(np.log2(np.maximum(n, 1)) + 1e-9).astype(np.int64)


def pieces_of(band: np.ndarray) -> np.ndarray:
    """Enough that the largest set of a band fills more pieces than it has room for differences; far more for small
    sets. With no more than that, a piece holds two or three shingles, and sets that share but a passage share few."""
    top = _BAND ** (band + 1)
    return np.where(top <= 32, 4 * top, np.where(top <= 64, top, np.where(top <= 128, top // 2, (top / 2.3).astype(np.int64))))


def _difference(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (n + m) // 7


def sketch_keys(hashes: np.ndarray, sizes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the emitted pieces and the number of the set that each belongs to. frequent: sorted hashes."""
    number = np.arange(len(sizes))
    band = band_of(sizes)
    low = -(-3 * sizes // 4)  # the smallest partner
    own = sizes > 0
    below = own & (low < _BAND**band)
    entry = np.concatenate([number[own], number[below]])
    bands = np.concatenate([band[own], band[below] - 1])
    reach = np.concatenate([_difference(sizes, 4 * sizes // 3)[own], _difference(sizes, _BAND**band - 1)[below]])
    if not len(entry):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = sizes[entry]
    first = np.cumsum(n) - n
    at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(starts[entry], n)
    who = np.repeat(np.arange(len(entry)), n)
    h = hashes[at]
    common = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)
    p = pieces_of(bands)
    base = np.cumsum(p) - p
    slot = base[who] + ((h >> np.uint64(8)) % p.astype(np.uint64)[who]).astype(np.int64)
    parity = np.zeros(int(p.sum()), np.uint64)
    np.bitwise_xor.at(parity, slot, _mixed(h))
    held = np.bincount(slot, minlength=len(parity))
    frequent_only = np.bincount(slot[common], minlength=len(parity)) == held
    filled = np.flatnonzero(held)
    who = np.repeat(np.arange(len(entry)), p)[filled]
    parity, held, frequent_only, piece = parity[filled], held[filled], frequent_only[filled], filled - base[who]
    last = np.uint64(4) * frequent_only.astype(np.uint64) + np.uint64(3) - np.minimum(held, 3).astype(np.uint64)  # pieces of fewer shingles come later
    key = _mixed(_mixed(parity + bands[who].astype(np.uint64) * _ODD[3]) + piece.astype(np.uint64) * _ODD[0])
    key = (last << np.uint64(61)) | (key >> np.uint64(3))  # in this order
    have = np.bincount(who, minlength=len(entry))
    at = 0
    for k in have.tolist():
        key[at : at + k].sort()
        at += k
    rank = np.arange(len(key)) - np.repeat(np.cumsum(have) - have, have)
    keep = rank <= reach[who]
    short = np.flatnonzero(have <= reach)  # some of the first pieces are empty: such sets share a key
    keys = np.concatenate([key[keep], _mixed(bands[short].astype(np.uint64) * _ODD[2] + _VIRTUAL)])
    return keys, np.concatenate([entry[who[keep]], entry[short]])


_ENTRY = np.dtype([("key", "<u8"), ("set", "<u4")])
_SET = np.dtype([("did", "<i8"), ("n", "<i4"), ("x", "<i4")])
_PAIR = np.dtype([("a", "<u4"), ("b", "<u4")])


def _packed(rows: np.ndarray, dids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The sets that these numbers name, and the numbers' places among them."""
    own, back = np.unique(rows, return_inverse=True)
    sets = np.empty(len(own), _SET)
    sets["did"], sets["n"], sets["x"] = dids[own], sizes[own], 0
    return sets.tobytes(), back


def key_blocks(docs: DataFrame, ids: DataFrame, frequent: np.ndarray, parts: int) -> DataFrame:
    """Packed (key, set) rows by part of the key space, with the sets' numbers and sizes.

    ids: of documents that hold every set once (a stored table with column id). A key that many sets of a window
    share leaves the task as edges between them and one of them, which goes on alone and marked: so a key that
    a great part of all sets has is small where it is grouped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    wanted, position = _wanted(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []
        n_sets = n_keys = 0

        def blocks() -> pa.RecordBatch:
            k, o = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            dids, sizes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            part = (k & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
            order = np.lexsort((dids[o], k, part))
            k, o, part = k[order], o[order], part[order].astype(np.int64)
            heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            count = np.diff(np.append(heads, len(k)))
            many = np.repeat(count > _SMALL, count)
            lead = np.repeat(heads, count)
            gone = many & (lead != np.arange(len(k)))
            edge_part, edge = part[gone], np.stack([o[gone], o[lead[gone]]], 1)
            stay = np.flatnonzero(~gone)
            marked = many[stay]
            k, o, part = k[stay], o[stay], part[stay]
            rows = []
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, z in zip(cuts, [*cuts[1:], len(k)], strict=True):
                own = edge[slice(*np.searchsorted(edge_part, [part[a], part[a] + 1]))]
                sets, back = _packed(np.concatenate([o[a:z], own.ravel()]), dids, sizes)
                entry = np.empty(z - a, _ENTRY)
                entry["key"], entry["set"] = k[a:z], back[: z - a]
                pair = np.empty(len(own), _PAIR)
                pair["a"], pair["b"] = back[z - a :: 2], back[z - a + 1 :: 2]
                rows.append((int(part[a]), sets, entry.tobytes(), np.packbits(marked[a:z]).tobytes(), pair.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), *[pa.binary()] * 4))], ["part", "sets", "keys", "marks", "edges"])

        for b, texts in _steps(_kept(batches, wanted.value), 2):
            hashes, n = shingles(texts)
            did = _digests(hashes, n)
            new = np.zeros(len(n), bool)
            for i, d in enumerate(did.tolist()):
                if n[i] and d not in seen:
                    seen.add(d)
                    new[i] = True
            hashes = hashes[np.repeat(new, n)]
            k, o = sketch_keys(hashes, n[new], shared.value)
            held.append((k, o + n_sets, did[new], n[new]))
            n_sets, n_keys = n_sets + int(new.sum()), n_keys + len(k)
            if n_keys > _BLOCK_ROWS:
                yield blocks()
                held, n_sets, n_keys = [], 0, 0
                seen.clear()
        if n_keys:
            yield blocks()

    return docs.select("doc_id", position, "text").mapInArrow(run, "part bigint, sets binary, keys binary, marks binary, edges binary")


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def grouped(blocks: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the sets of small pieces; the sets of a large one as edges (star) with one of them."""

    def run(key: tuple, groups: pa.Table) -> pa.Table:
        dids, sizes, keys, marks, edges = [], [], [], [], []
        for s, k, m, e in zip(*(groups[c] for c in ("sets", "keys", "marks", "edges")), strict=True):
            own, entry, pair = np.frombuffer(s.as_buffer(), _SET), np.frombuffer(k.as_buffer(), _ENTRY), np.frombuffer(e.as_buffer(), _PAIR)
            keys.append(entry["key"])
            dids.append(own["did"][entry["set"]])
            sizes.append(own["n"][entry["set"]])
            marks.append(np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(entry)))
            edges.append((own["did"][pair["a"]], own["did"][pair["b"]]))
        star_a, star_b = (np.concatenate([e[i] for e in edges]) for i in (0, 1))
        k, d, n, m = np.concatenate(keys), np.concatenate(dids), np.concatenate(sizes), np.concatenate(marks)
        del keys, dids, sizes, marks, edges
        order = np.lexsort((d, k))
        k, d, n, m = k[order], d[order], n[order], m[order]
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        marked = np.maximum.reduceat(m, heads).astype(bool)
        new = np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
        count = np.add.reduceat(new.astype(np.int64), heads)
        large = np.repeat(marked | (count > _SMALL), count)
        k, d, n = k[new], d[new], n[new]
        heads = np.cumsum(count) - count
        star_a, star_b = np.concatenate([star_a, d[large]]), np.concatenate([star_b, np.repeat(d[heads], count)[large]])
        star_a, star_b = _distinct(*(x[star_a != star_b] for x in (star_a, star_b)))
        some = ~large & np.repeat(count > 1, count)
        k, d, n = k[some], d[some], n[some]
        found = []
        for ahead in range(1, _SMALL):
            at = np.flatnonzero(k[ahead:] == k[:-ahead]) if len(k) > ahead else []
            if not len(at):
                break
            at = at[4 * np.minimum(n[at], n[at + ahead]).astype(np.int64) >= 3 * np.maximum(n[at], n[at + ahead])]
            found.append(_distinct(d[at], d[at + ahead]))
        a, b = _distinct(*(np.concatenate([f[i] for f in found]) for i in (0, 1))) if found else (star_a[:0], star_b[:0])
        return pa.table({
            "a": pa.array(np.concatenate([a, star_a])),
            "b": pa.array(np.concatenate([b, star_b])),
            "star": pa.array(np.arange(len(a) + len(star_a)) >= len(a)),
        })

    return blocks.groupBy("part").applyInArrow(run, "a bigint, b bigint, star boolean")


def _bitmap(ids: DataFrame, column: str, bits: int) -> np.ndarray:
    """A fixed number of bits; those of the ids' hashes are set."""
    h = F.pmod(F.xxhash64(column), F.lit(bits))
    rows = ids.select(h.alias("h")).groupBy(F.expr("bitmap_bucket_number(h + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h + 1))").alias("m")).collect()
    out = np.zeros(max(bits, 1 << 15) // 8 + 4096, np.uint8)
    for r in rows:
        at = (r.b - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r.m, np.uint8)
    return out


def _wanted(docs: DataFrame, ids: DataFrame):
    """A broadcast bitmap of a fixed greatest size that holds these ids (column id), and the column with a document's place in it."""
    bits = 1 << min(27, max(15, (16 * ids.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, "id", bits))
    return shared, F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")


def _kept(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows whose place (the second column) is set: all the wanted ones, and a few more."""
    for b in batches:
        h = b.column(1).to_numpy().astype(np.int64)
        got = b.filter(pa.array((bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
        if got.num_rows:
            yield got


def shingle_table(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """did and h (shingles) of the sets (a stored table: did, and id of a document that holds it)."""
    wanted, position = _wanted(docs, sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _steps(_kept(batches, wanted.value), 2):
            hashes, sizes = shingles(texts)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_digests(hashes, sizes)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64)))], ["did", "h"])

    found = docs.select("doc_id", position, "text").mapInArrow(run, "did bigint, h array<bigint>")
    return staged(found.join(sets, "did", "left_semi").dropDuplicates(["did"]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their shingles (did, h)."""
    right = pairs.join(sets.withColumnsRenamed({"did": "b", "h": "hb"}), "b")
    both = right.join(sets.withColumnsRenamed({"did": "a", "h": "ha"}), "a")
    shared_n = F.size(F.array_intersect("ha", "hb"))
    return both.withColumn("s", shared_n).filter(100 * F.col("s") >= 75 * (F.size("ha") + F.size("hb") - F.col("s"))).select("a", "b")


def close_enough(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches (did, n_shingles, sketch) do not rule a link out."""
    own = lambda x: sets.select(F.col("did").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = ((b.column(2).to_numpy() + b.column(3).to_numpy()) // 7).tolist()
            near = [distance(x, y) <= d for x, y, d in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), most, strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every id in the edges (a, b): alternating large and small stars."""
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        unstaged(e)
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = staged(small.filter("u <> v").distinct())
        unstaged(large)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Sets of ascending shingles, numbered left before right: the summed weights of the sets that each links with (left
    with right, or all with each other where right is None), and a forest of links that joins what they join.

    An index of shingles compares a set with all others at once. A shingle that most sets hold is indexed by the
    sets that lack it, so that near copies cost as much as they differ.
    """
    sets = left if right is None else left + right
    base = 0 if right is None else len(left)
    n = np.array([len(h) for h in sets], np.int64)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(n) - n
    m = len(sets) - base
    right_code = code[at[base] :]
    owner = np.repeat(np.arange(m), n[base:])
    held = np.bincount(right_code, minlength=len(values))
    dense = held > m // 2
    number = np.cumsum(dense) - 1
    present = np.zeros((int(dense.sum()), m), bool)
    in_dense = dense[right_code]
    present[number[right_code[in_dense]], owner[in_dense]] = True
    dense_of = present.sum(0)
    lack_row, lacking = np.nonzero(~present)
    lack_at = np.searchsorted(lack_row, np.arange(len(present) + 1))
    del present, lack_row
    rest = np.flatnonzero(~in_dense)
    rest = rest[np.argsort(right_code[rest], kind="stable")]
    holders = owner[rest]
    hold_at = np.searchsorted(right_code[rest], np.arange(len(values) + 1))
    all_dense = np.ones(len(lack_at) - 1, bool)
    degree, parent, out = np.zeros(len(sets), np.int64), np.arange(len(sets)), []

    def taken(items: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        lo, size = starts[rows], starts[rows + 1] - starts[rows]
        return items[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    for u in range(len(left)):
        own = code[at[u] : at[u] + n[u]]
        mine = dense[own]
        missing = all_dense.copy()
        missing[number[own[mine]]] = False
        missing = np.flatnonzero(missing)
        s = np.bincount(taken(holders, hold_at, own[~mine]), minlength=m) + dense_of - len(missing) + np.bincount(taken(lacking, lack_at, missing), minlength=m)
        near = np.flatnonzero(100 * s >= 75 * (n[u] + n[base:] - s)) + base
        if right is None:
            near = near[near > u]
        degree[u] += weights[near].sum()
        degree[near] += weights[u]
        odd = near[parent[near] != parent[u]]
        while len(odd):
            v = int(odd[0])
            out.append((u, v))
            parent[parent == parent[v]] = parent[u]
            odd = odd[parent[odd] != parent[u]]
    return degree, out


def linked_in_blocks(cluster: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among all sets of each cluster (did, cluster): a, b of links that join them, and a, n: how many
    documents the links of a set lead to.

    A cluster's sets are dealt to blocks of a bounded number of sets and shingles, and every two blocks, or one that
    is alone, meet in a task of their own.
    """
    sized = cluster.join(reps.select("did", "copies", "n"), "did").withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(_SALTS)).cast("int"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK_SETS)), F.ceil(F.sum("n") / F.lit(_BLOCK_SHINGLES))).cast("int")
    several = sized.groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1")  # of at least so many sets or shingles each
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a large cluster is not one task's
    d = sized.join(several, ["cluster", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(sets, "did")
    d = d.withColumn("k", F.pmod(F.xxhash64("did"), "blocks").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("cluster", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), "k", "did", "copies", "h")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        t = t.combine_chunks()
        order = np.argsort(t["k"].to_numpy(), kind="stable")
        k, did, copies = (t[c].to_numpy()[order] for c in ("k", "did", "copies"))
        h = [t["h"][x].values.to_numpy() for x in order.tolist()]
        cut = int((k == i).sum())
        if i != j and not 0 < cut < len(h):
            return pa.table({"a": pa.nulls(0, pa.int64()), "b": pa.nulls(0, pa.int64()), "n": pa.nulls(0, pa.int64())})
        degree, links = block_links(h, None, copies) if i == j else block_links(h[:cut], h[cut:], copies)
        some = np.flatnonzero(degree)
        a, b = (did[np.array([x[c] for x in links], np.int64)] for c in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([did[some], a])),
            "b": pa.array(np.concatenate([did[some], b]), mask=np.arange(len(some) + len(a)) < len(some)),
            "n": pa.array(np.concatenate([degree[some], np.zeros(len(a), np.int64)])),
        })

    return d.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint, n bigint")


def similar_sets(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sets (did, n_shingles, rows of documents, each set once a window), and of every set that is not empty: did, head (the
    first row of its component: an id before none, then the smallest) and n_links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    found = staged(set_table(docs))
    frequent = found.filter("often IS NOT NULL").groupBy("often").agg(F.sum("times").alias("n")).orderBy(F.desc("n"), "often").limit(_FREQUENT).select("often").collect()
    frequent = np.sort(np.array([r.often for r in frequent], np.int64).view(np.uint64))
    sets = found.filter("rows IS NOT NULL").select("did", "n_shingles", "rows")
    reps = sets.filter("did IS NOT NULL").groupBy("did").agg(F.min(F.array_min("rows")).alias("rep"), F.sum(F.size("rows")).alias("copies"), F.max("n_shingles").alias("n"))
    reps = staged(reps.withColumn("id", F.col("rep.id")))
    total = reps.agg(F.sum("n").alias("n")).first().n or 0
    parts = parts or max(8, -(-total // _PART_SHINGLES))
    got = staged(grouped(key_blocks(docs, reps, frequent, parts)))
    pairs = staged(got.filter("NOT star").select("a", "b").distinct())
    star = got.filter("star").select("a", "b").distinct()
    cluster = components(star).withColumnsRenamed({"id": "did", "component": "cluster"})
    cluster = staged(cluster.unionByName(cluster.select(F.col("cluster").alias("did"), "cluster").distinct()))
    at = lambda x: cluster.select(F.col("did").alias(x), F.col("cluster").alias(f"c{x}"))
    unstaged(got)
    apart = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left").filter("NOT coalesce(ca = cb, false)").select("a", "b")
    close = staged(close_enough(apart, found.filter("did IS NOT NULL").select("did", "n_shingles", "sketch").dropDuplicates(["did"])))
    asked = close.select(F.explode(F.array("a", "b")).alias("did")).unionByName(cluster.select("did")).distinct()
    shingled = shingle_table(docs, staged(asked.join(reps.select("did", "id"), "did")))
    unstaged(pairs)
    links = staged(verified(close, shingled))
    inside = staged(linked_in_blocks(cluster, reps, shingled))
    unstaged(shingled, close)
    comp = components(links.unionByName(inside.filter("b IS NOT NULL").select("a", "b")))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(reps.select(F.col("did").alias("b"), F.col("copies").alias("n")), "b")
    degree = ends.select("a", "n").unionByName(inside.filter("b IS NULL").select("a", "n")).groupBy(F.col("a").alias("did")).agg(F.sum("n").alias("links"))
    own = reps.join(comp.withColumnsRenamed({"id": "did"}), "did", "left").join(degree, "did", "left")
    own = own.select("did", F.coalesce("component", "did").alias("c"), "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = staged(own.withColumn("salt", F.pmod(F.xxhash64("did"), F.lit(_SALTS)).cast("int")))
    heads = own.groupBy("c").agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    heads = heads.select("c", "head", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    own = own.join(heads, ["c", "salt"], "left").select("did", F.coalesce("head", "rep").alias("head"), "n_links")
    return sets, own


def similar_components(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (the rows that the row links with) of every row."""
    sets, own = similar_sets(docs, parts)
    filled = sets.join(own, "did").select(F.explode("rows.id").alias("doc_id"), "n_shingles", F.col("head.id").alias("component_id"), "n_links")
    empty = sets.filter("did IS NULL").select(F.explode("rows.id").alias("doc_id"), "n_shingles")
    return filled.unionByName(empty.withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))


def oracle() -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w),
n AS (SELECT w.doc_id, count(h) AS n_shingles FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n_shingles + ny.n_shingles - c)),
both_ AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS root FROM n UNION SELECT both_.y, r.root FROM r JOIN both_ ON both_.x = r.d)
SELECT n.doc_id, n_shingles, component_id, coalesce(k.n_links, 0) AS n_links FROM n JOIN (SELECT d, min(root) AS component_id FROM r GROUP BY d) c ON c.d = n.doc_id
LEFT JOIN (SELECT x, count(*) AS n_links FROM both_ GROUP BY x) k ON k.x = n.doc_id"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component, once; every text without a word stays."""
    own, head, text_hash = (free_name(c, docs.columns) for c in ("__of", "__id", "__th"))
    heads = similar_sets(docs)[1].select(F.col("head.id").alias(head), F.col("head.th").alias(text_hash)).distinct()
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    named = docs.filter(~wordless).withColumn(own, F.xxhash64("text"))
    kept = named.join(heads, F.col("doc_id").eqNullSafe(F.col(head)) & (F.col(own) == F.col(text_hash)), "left_semi").dropDuplicates(["doc_id", own])
    return kept.select(*map(column, docs.columns)).unionByName(docs.filter(wordless))
