"""SentencePiece BPE encoding and decoding through a prefix table.

For merge-by-score BPE the encoding of every prefix of a string ends in one
unique token, and a token can follow another exactly when merging their joint
text gives the two back. So a left-to-right table holds the last token of each
prefix: the automaton lists the pieces that end at a position, and the one
that is compatible with the last token of the prefix before it is the answer.
Ids are then read backwards from the end of the table.

Independent parts of a text are encoded apart and remembered: no piece joins
a character to a following space mark, and a character outside the vocabulary
joins nothing (it becomes its UTF-8 bytes). Runs of space marks share one
score, so their merges happen last, leftmost first; they are replayed as such.

Defined cases: a null text is the empty text and has no ids; texts of any
length are encoded whole, in time linear in their length; repeated rows are
encoded each; extra columns stay out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from sellerlens.llm.work import ship

SPACE = "▁"
REMEMBERED = 300_000   # encoded parts kept by one Python worker
LONGEST_KEPT = 64      # characters of a part that is kept


class PieceTable:
    """Encoder and decoder for a BPE model with byte fallback, identity
    normalisation and a leading space mark."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids: dict[int, int] = {}
        self.special: set[int] = set()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.special.add(i)
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                self.ids[p] = i
                self.score[p] = sp.get_score(i)
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        marks = {p for p in self.ids if len(p) > 1 and p.strip(SPACE) == ""}
        rest = [s for p, s in self.score.items() if len(p) > 1 and p not in marks]
        if len(self.byte_ids) != 256 or any(SPACE in p[1:] for p in self.ids if p not in marks):
            raise ValueError("need byte fallback and pieces without inner space marks")
        if len(set(rest)) != len(rest) or (marks and max(self.score[p] for p in marks) >= min(rest)):
            raise ValueError("scores must differ, those of space runs must be the lowest")
        probe = "A  é ﬁ① é\t."
        if sp.decode(sp.encode(probe)) != probe or sp.encode(" ", out_type=str) != [SPACE * 2]:
            raise ValueError("need identity normalisation and a leading space mark")
        self.marks = marks
        self.chars = {c for p in self.ids for c in p}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if p not in marks:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.lengths = [len(p) for p in self.pieces]
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.text_of = [None if i in self.byte_of else "" if i in self.special else p.replace(SPACE, " ")
                        for i, p in enumerate(self.pieces)]
        self.digits = [str(i) for i in range(n)]

    # -- encoding -----------------------------------------------------------

    def merged(self, text: str, tie_free: bool = True) -> list[str]:
        """Merges of a short string, best score first, leftmost first."""
        sym, nxt, prv = list(text), [*range(1, len(text)), -1], [*range(-1, len(text) - 1)]
        heap = []

        def offer(i):
            j = nxt[i] if i >= 0 else -1
            if j >= 0:
                p = sym[i] + sym[j]
                if p in self.ids and not (tie_free and p in self.marks):
                    heapq.heappush(heap, (-self.score[p], i, p))

        for i in range(len(sym)):
            offer(i)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] is None or j < 0 or sym[i] + sym[j] != p:
                continue
            sym[i], sym[j], nxt[i] = p, None, nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            offer(prv[i])
            offer(i)
        return [s for s in sym if s is not None]

    def compatible(self, a: int, b: int) -> bool:
        """May token ``b`` directly follow token ``a``? (``a`` = -1: none.)"""
        if len(self.fits) >= 4 * REMEMBERED:
            self.fits.clear()
        pair = [self.pieces[x] for x in (a, b) if x >= 0]
        hit = self.fits[(a + 1) * len(self.pieces) + b] = self.merged("".join(pair)) == pair
        return hit

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a part whose characters are all in the vocabulary."""
        last = [-1] * (len(text) + 1)    # last[i]: last token of the prefix of length i
        fits, base, lengths = self.fits, len(self.pieces), self.lengths
        for end, i in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            start = end - lengths[i]
            before = last[start]
            if before < 0 and start:
                continue
            fit = fits.get((before + 1) * base + i)
            if fit or (fit is None and self.compatible(before, i)):
                last[end] = i
        out = []
        at = len(text)
        while at > 0:
            i = last[at]
            out.append(i)
            at -= lengths[i]
        out.reverse()
        return tuple(out)

    @lru_cache(maxsize=256)
    def run(self, n: int) -> tuple[int, ...]:
        """Ids of n space marks in a row."""
        return tuple(self.ids[p] for p in self.merged(SPACE * n, tie_free=False))

    def _plain(self, text: str) -> tuple[int, ...]:
        """Ids of a part starting with at most one space mark, split where a
        character is outside the vocabulary."""
        if self.chars.issuperset(text):
            return self.part(text)
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.chars:
                if k > start:
                    out += self.part(text[start:k])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = k + 1
        if start < len(text):
            out += self.part(text[start:])
        return tuple(out)

    def word(self, text: str) -> tuple[int, ...]:
        ids = self.known.get(text)
        if ids is None:
            ids = self.older.get(text) or self._plain(text)
            if len(text) <= LONGEST_KEPT:
                if len(self.known) >= REMEMBERED // 2:
                    self.older, self.known = self.known, {}
                self.known[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        mark = self.ids[SPACE]
        blank = 0
        known = self.known
        for w in text.replace(SPACE, " ").split(" "):
            blank += 1                   # the mark before this part
            if not w:
                continue
            key = SPACE + w
            ids = known.get(key) or self.word(key)
            if blank > 1:
                if ids[0] == mark:       # the mark stayed alone: it belongs to the run
                    out += self.run(blank)
                    out += ids[1:]
                else:
                    out += self.run(blank - 1)
                    out += ids
            else:
                out += ids
            blank = 0
        if blank:
            out += self.run(blank)
        return out

    def forget(self) -> None:
        self.known, self.older = {}, {}

    # -- decoding -----------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD each."""
        words = self.text_of
        try:
            text = "".join([words[i] for i in ids])
        except TypeError:                # byte pieces among them
            out, run = [], bytearray()
            for i in ids:
                b = self.byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_utf8(run))
                    run = bytearray()
                out.append(words[i])
            if run:
                out.append(_utf8(run))
            text = "".join(out)
        first = next((i for i in ids if i not in self.special), None)
        if first is not None and self.pieces[first].startswith(SPACE):
            text = text[1:]
        return text


def _utf8(raw: bytes) -> str:
    try:
        return bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        out = []
        k = 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[k:k + n]).decode("utf-8"))
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


@lru_cache(maxsize=2)
def piece_table(model: bytes) -> PieceTable:
    return PieceTable(model)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


ENCODED = "doc_id long, ids array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _texts(documents: DataFrame) -> DataFrame:
    return ship(documents).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of every text."""
    model = documents.sparkSession.sparkContext.broadcast(model_bytes(model_path))  # one vocabulary file

    def f(batches):
        t = piece_table(model.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [t.encode(x) for x in b["text"]]})

    return _texts(documents).mapInPandas(f, ENCODED)


SLICE = 256            # rows whose ids a task holds at a time


def encode_rows(documents: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document, n_tokens, ids and round_trip:
    does decoding give the text back (null: the empty text)?"""
    model = documents.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def f(batches):
        t = piece_table(model.value)
        for b in batches:
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                ids, same = [], []
                for text in part.column(part.num_columns - 1):
                    x = text.as_py() or ""
                    got = t.encode(x)
                    same.append(t.decode(got) == x)
                    ids.append(np.array(got, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([len(i) for i in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    [*keep, "n_tokens", "ids", "round_trip"])
        t.forget()             # the worker lives on

    t = ship(documents).select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("text"))
    kinds = ", ".join(f"`{c}` {t.schema[i].dataType.simpleString()}" for i, c in enumerate(keep))
    return t.mapInArrow(f, f"{kinds}, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the text of ``ids`` (null ids: the empty text)."""
    model = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def f(batches):
        t = piece_table(model.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"],
                                "text": [t.decode([] if x is None else list(x)) for x in b["ids"]]})

    return ship(encoded).select("doc_id", "ids").mapInPandas(f, "doc_id long, text string")


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text."""
    model = documents.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def f(batches):
        t = piece_table(model.value)
        sha, digits = hashlib.sha256, t.digits
        for b in batches:
            rows = []
            for d, x in zip(b["doc_id"], b["text"]):
                ids = t.encode(x)
                rows.append((d, len(ids), sha(",".join([digits[i] for i in ids]).encode()).hexdigest(),
                             sha(t.decode(ids).encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(documents).mapInPandas(f, DIGESTS)
