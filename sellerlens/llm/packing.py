"""Best-fit packing of token pieces by exact complements.

Lengths are at most the capacity, so the table of how many pieces have each
length has a fixed size, however many pieces there are. The plan is made from
that table alone: for the longest length left, the gap is looked up among the
single lengths, the sums of two and the sums of three lengths; a combination
that fills it exactly is consumed as often as the counts allow. Where there is
none, the longest length that fits is added (best fit) and the look-up starts
again. Each such pattern at least halves the count of one of its lengths (or
uses it up), so there are at most capacity x log2(pieces) patterns, which
bounds what is broadcast.

Pieces find their place by their rank among the pieces of their length: a task
numbers its own pieces while it writes them, and the numbers of earlier tasks
are added from a small table of counts. No length is gathered in one task,
though it may hold a third of all pieces.

Tokens: white space separates tokens of the vocabulary used (the normaliser
drops it), so a text is cut at ASCII white space, every part is encoded apart
by the tokenizers library and remembered. Parts of plain Latin letters are
taken apart further into the words of the file's own pattern, whose ids come
from the library's model directly.

Defined cases: a null text is empty; an empty text is the end id alone; texts of any
length are encoded whole; a null doc_id and repeated rows are rows like
others; an empty table gives no rows; extra columns stay out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from sellerlens.llm.work import cut, ship, small_side

CAPACITY = 4096
END = 1
REMEMBERED = 300_000      # parts and words kept by one Python worker, each twice at most
LONGEST_KEPT = 48         # bytes of a part that is kept

# Characters whose normal form, lower case and class are plain: ASCII without
# control characters, and the Latin letters and signs up to U+017F (but for
# the one capital whose lower case is two characters).
_PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180)) if c != 0x130]
_KIND = {c: unicodedata.category(c)[0] for c in _PLAIN}


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if _KIND[c] == kind)


class _Kept(dict):
    """``make(key)`` of keys, remembered for the last ones met."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class TokenBytes:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = re.compile(f"[{''.join(re.escape(c) for c in _PLAIN)}]*")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added) or "(?!)")
        letters, digits = _class("L"), _class("N")
        # The pattern of the file, over the plain characters.
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+")
        # Byte-level alphabet: printable Latin-1 stands for itself, the rest
        # for the characters from U+0100 on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = (b for b in range(256) if b not in own)
        self.shown = {b: b for b in own} | {b: 0x100 + i for i, b in enumerate(others)}
        self.words = _Kept(self._word)     # of lower-case words
        self.parts = _Kept(self._part)     # of parts without white space

    def whole(self, text: str) -> bytes:
        """By the library's own pipeline."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        shown = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.model.tokenize(shown)]
        return pack_ids(f"<{len(ids)}I", *ids)

    def _part(self, part: bytes) -> bytes:
        words = self.words
        if part.isalpha():                                      # ASCII letters only
            return words[part.lower()]
        if part[:-1].isalpha() and part[-1:] in b".,;:!?":
            return words[part[:-1].lower()] + words[part[-1:]]
        text = part.decode()
        if self.plain.fullmatch(text) and not self.special.search(text):
            return b"".join([words[w.encode()] for w in self.word.findall(text.lower())])
        return self.whole(text)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.encode().split()))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """Rows of PIECES (and ``ids``, if wanted): every text's ids and the end
    id, cut only where longer than ``capacity``."""
    last = np.array([end], "<u4").tobytes()

    def f(batches):
        t = token_bytes(path)
        for b in batches:
            out = []
            for d, text in zip(b.column(0), b.column(1)):
                d, data = d.as_py(), t.encode(text.as_py() or "") + last
                for k in range(0, len(data) // 4, capacity):
                    part = data[4 * k:4 * (k + capacity)]
                    out.append((d, k // capacity, k, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*out)) or [[]] * 6
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()),
                      *[pa.array(columns[i], pa.int64()) for i in (2, 3, 4)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return (ship(documents).select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(f, PIECES + (", ids array<int>" if ids else "")))


@dataclass
class Plan:
    """Ranges of ranks of each length. Row i: pieces of ``length`` whose rank
    is from ``low`` on; ``times`` of them go into each sequence, one after the
    other from ``offset``; ``first`` is the first sequence."""
    length: np.ndarray
    low: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    first: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces."""
        key = (self.length << 48) + self.low
        i = np.searchsorted(key, (length << 48) + rank, "right") - 1
        sequence, turn = np.divmod(rank - self.low[i], self.times[i])
        return self.first[i] + sequence, self.offset[i] + turn * length


class _Lengths:
    """Counts of lengths, with an index of the sums of two of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        some = (self.left > 0).astype(float)
        # Ordered pairs of lengths that are there, by their sum.
        self.pairs = np.rint(np.convolve(some, some))[:len(some)].astype(np.int64)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            size = len(self.left)
            there = self.left[:size - length] > 0
            self.pairs[length:] -= 2 * there
            if 2 * length < size:
                self.pairs[2 * length] -= 1


def _pair(left: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two lengths with that sum, those of which most are left."""
    a = np.arange(1, gap // 2 + 1)
    if not len(a):
        return None
    both = np.minimum(left[a], left[gap - a])
    if gap % 2 == 0:
        both[-1] = left[gap // 2] // 2
    best = len(a) - 1 - int(both[::-1].argmax())
    return (int(a[best]), gap - int(a[best])) if both[best] > 0 else None


def _exact(lengths: _Lengths, left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three lengths whose sum is ``gap``, if there are any."""
    if left[gap] > 0:
        return (gap,)
    if lengths.pairs[gap] > 0:
        two = _pair(left, gap)
        if two:
            return two
    a = np.arange(gap - 2, 0, -1)
    a = a[(left[a] > 0) & (lengths.pairs[gap - a] > 0)]
    for x in a[np.argsort(-left[a], kind="stable")].tolist():
        left[x] -= 1
        two = _pair(left, gap - x)
        left[x] += 1
        if two:
            return (x, *two)
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Where pieces go, from the number of pieces of each length 0..capacity."""
    lengths = _Lengths(np.asarray(counts, np.int64))
    used = np.zeros(capacity + 1, np.int64)
    rows, sequences = [], 0
    for longest in range(capacity, 0, -1):
        while lengths.left[longest]:
            left = lengths.left.copy()
            left[longest] -= 1
            pattern, gap = {longest: 1}, capacity - longest
            while gap:
                fill = _exact(lengths, left, gap)
                if fill is None:
                    fits = np.flatnonzero(left[1:gap + 1])
                    if not len(fits):
                        break
                    x = int(fits[-1]) + 1
                    # Of short lengths several at once, with three spared for an exact end.
                    fill = (x,) * max(1, min(int(left[x]), gap // x) - 3)
                for x in fill:
                    pattern[x] = pattern.get(x, 0) + 1
                    left[x] -= 1
                    gap -= x
            times = min(int(lengths.left[x]) // n for x, n in pattern.items())
            at = 0
            for x, n in sorted(pattern.items(), reverse=True):
                rows.append((x, int(used[x]), n, at, sequences))
                used[x] += n * times
                lengths.take(x, n * times)
                at += n * x
            sequences += times
    rows.sort()
    t = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(*t.T, sequences)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with a column ``length`` from 1 to ``capacity``)
    with sequence_id and offset."""
    spark = pieces.sparkSession
    names = pieces.columns
    task, own = "__task", "__own"            # of this module's tables only
    clash = [c for c in names if c in (task, own, "sequence_id", "offset")]
    if clash:
        raise ValueError(f"columns in the way: {clash}")

    def number(batches):
        seen = np.zeros(capacity + 1, np.int64)
        here = TaskContext.get().partitionId()
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy().astype(np.int64)
            order = np.argsort(length, kind="stable")
            s = length[order]
            first = np.searchsorted(s, s, "left")
            rank = np.empty(len(s), np.int64)
            rank[order] = np.arange(len(s)) - first + seen[s]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(s), here, np.int32)), pa.array(rank)],
                                             [*names, task, own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    # Written first, so that a task has one Python worker at a time, and then
    # with its number, which a piece keeps whatever task is repeated.
    numbered = cut(ship(cut(pieces, "pieces")).mapInArrow(number, f"{kinds}, {task} int, {own} long"), "numbered")
    counts = cut(numbered.groupBy(task, "length").agg(F.count("*").alias("n")), "piece-counts")
    whole = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():       # ``capacity`` rows at most
        whole[r["length"]] = r["n"]
    told = spark.sparkContext.broadcast(plan(whole, capacity))
    earlier = Window.partitionBy("length").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    base = cut(counts.select(task, "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "piece-bases")

    def place(batches):
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", own))
            if len(length):
                sequence, offset = told.value.place(length, rank)
            else:
                sequence = offset = length
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names],
                                              pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = numbered.join(small_side(base), [task, "length"]).withColumn(own, F.col(own) + F.col("base"))
    return ranked.select(*[f"`{c}`" for c in names], own).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all pieces' ids, gapless) and starts (offset of each
    piece), of packed pieces that carry ``ids``; a group has at most
    ``capacity`` ids."""
    t = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return t.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts"))
