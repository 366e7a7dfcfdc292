"""Merge-type subword encoding through a prefix table, and decoding.

A text becomes segments, each a run of word marks and the word behind it: no piece of the model holds a mark
behind another character, so no merge crosses from one segment into the next. For every prefix of a segment
its merge encoding ends in exactly one token. The table stores that token: an automaton reports all pieces
that end at a position, and a piece is the prefix's last token if it and the last token of the prefix before
it are a compatible pair, that is if merging the two strings gives back just the two. The ids are then read
backwards from the end. Time is linear in the text whatever its words.

Characters that are no piece stand alone as their bytes. Runs of marks merge last and all with the same
score, leftmost first, and so fill up from the left.

Results at the edges: null and empty texts give no ids and the empty text back; repeated rows give equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gravelake.llm.common import table

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
_CACHED = 500_000
_LONGEST_CACHED = 64


class Recent(dict):
    """A table that computes what it lacks and forgets what has long not been asked for."""

    def __init__(self, compute, most: int = _CACHED):
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= _LONGEST_CACHED:
            if len(self) >= self.most // 2:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def forget(self) -> None:
        """Workers outlive their tasks; what they remember should not."""
        self.clear()
        self.old = {}


class PrefixTableEncoder:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        if any(MARK in p.lstrip(MARK) or (p[:2] == MARK * 2 and p.strip(MARK)) for p in self.ids):
            raise ValueError("a piece holds a word mark behind another character, or several before one")
        self.longest_run = max(len(p) for p in self.ids if not p.strip(MARK))
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if p.strip(MARK) or p == MARK:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.alphabet = frozenset(p for p in self.ids if len(p) == 1)
        self.unknown = re.compile("[^" + "".join(map(re.escape, sorted(self.alphabet))) + "]")
        self.full_runs = self.merged(MARK * (3 * self.longest_run)) == [MARK * self.longest_run] * 3
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.inside = frozenset(p[k : k + 2] for p in self.ids for k in range(len(p) - 1))
        self.word = Recent(self.fresh_word)

    def merged(self, text: str) -> list[str]:
        """Plain merging, best score first, then leftmost; for the short strings of a compatibility test."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def reachable(self, piece: str) -> bool:
        got = self.whole.get(piece)
        if got is None:
            got = self.whole[piece] = self.merged(piece) == [piece]
        return got

    def compatible(self, left: str, right: str) -> bool:
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= _CACHED:
                self.pairs.clear()
            got = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return got

    def known(self, text: str) -> list[str]:
        """Tokens of a text of known characters with a mark at most in front."""
        pairs, whole, reachable, compatible = self.pairs, self.whole, self.reachable, self.compatible
        last: list = [None] * (len(text) + 1)
        for end, piece in self.automaton.iter(text):
            end += 1
            if last[end] is None and (whole[piece] if piece in whole else reachable(piece)):
                left = last[end - len(piece)]
                if left is None:
                    if end == len(piece):
                        last[end] = piece
                else:
                    both = (left, piece)
                    if pairs[both] if both in pairs else compatible(left, piece):
                        last[end] = piece
        out, at = [], len(text)
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def segment(self, segment: str) -> list[int]:
        """Ids of a run of marks and the word behind it."""
        word = segment.lstrip(MARK)
        run = len(segment) - len(word)
        out: list[int] = []
        if word:
            core = MARK + word
            if self.unknown.search(core):
                parts, at = [], 0
                for m in self.unknown.finditer(core):
                    parts += [*self.known(core[at : m.start()]), m.group()]
                    at = m.end()
                parts += self.known(core[at:])
            else:
                parts = self.known(core)
            if parts[0] == MARK:
                parts = parts[1:]
            else:
                run -= 1
            for p in parts:
                i = self.ids.get(p)
                out += [i] if i is not None else [self.bytes[b] for b in p.encode()]
        full, rest = divmod(run, self.longest_run) if self.full_runs else (0, run)
        return [self.ids[MARK * self.longest_run]] * full + [self.ids[p] for p in self.merged(MARK * rest)] + out

    def fresh_word(self, word: str) -> str:
        """The ids of a mark and a word, each after a comma. No token spans two characters that no piece holds next to each other."""
        ids, inside, n = self.ids, self.inside, len(word)
        tail: list[int] = []
        while n > 1 and word[n - 2 : n] not in inside and (last := ids.get(word[n - 1])) is not None:
            tail.append(last)
            n -= 1
        if tail:
            return self.word[word[:n]] + "".join([f",{i}" for i in reversed(tail)])
        return "," + ",".join(map(str, self.segment(MARK + word)))

    def joined(self, text: str) -> str:
        """The text's decimal ids joined by commas."""
        if not text:
            return ""
        marked = MARK + text.replace(" ", MARK)
        if MARK * 2 in marked or marked[-1] == MARK:
            ids = "".join(self.word[s[1:]] if s[1:2] not in ("", MARK) else "".join(f",{i}" for i in self.segment(s)) for s in _SEGMENT.findall(marked))
        else:
            ids = "".join(map(self.word.__getitem__, marked[1:].split(MARK)))
        return ids[1:]

    def encode(self, text: str) -> list[int]:
        ids = self.joined(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_loaded: dict[str, PrefixTableEncoder] = {}


def encoder(model: str) -> PrefixTableEncoder:
    """The encoder of a model file, one for each Python worker."""
    if model not in _loaded:
        _loaded[model] = PrefixTableEncoder(model)
    return _loaded[model]


def encode_texts(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `ids` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and `text` of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


def digests(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and digest of the ids, and digest of the text that they decode to; the ids stay in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for b in batches:
            n, coded, back = [], [], []
            for t in b.column(1):
                ids = enc.joined(t.as_py() or "")
                n.append(ids.count(",") + 1 if ids else 0)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(enc.decode(list(map(int, ids.split(",")))).encode() if ids else b"").hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded), pa.array(back)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        enc.word.forget()

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))
