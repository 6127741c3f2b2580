"""SentencePiece encoding and decoding of a model file, without its library.

An Aho-Corasick automaton over the pieces is run once over a text; at each
position its output links give every piece that ends there, and each relaxes the
best path to that position.

* Unigram models: a path's score is the sum of its pieces' scores.
* BPE models: scores are merge ranks, and summing them isn't what the model means.
  There a piece may extend a path only if merging the last two pieces' characters
  by rank gives back those two pieces. Of the pieces that end at a position exactly
  one can, so that the same pass finds the segmentation that merging finds. Texts
  are cut at characters that are in no piece.

Characters that no path covers become the unknown piece, or byte pieces where the
model has byte fallback. Pieces that hold the space mark only at their start never
cross a mark, so that such models are run by runs of marks and the word after them;
what has been computed for a word is remembered up to a bound.

Defined cases: a null or empty text has no pieces and decodes to an empty text.
Decoding drops the dummy prefix again: models with the identity normaliser give
back the text exactly (but for a space mark in the text itself, which reads as a space). One row per input row, repeated rows alike; an empty table
gives an empty result. Other columns are kept where the column names are free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rdfloom.llm.common import free_name, small_batches

MARK = "▁"
#: Characters at a word's start whose states are remembered.
HEAD = 5
#: Piece kinds and model kinds of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; 4-byte values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, data[at : at + n]
            at += n


def _runs(text: str, known: set[str]) -> Iterator[str]:
    """Runs of known characters, and of others."""
    at = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or (text[i] in known) != (text[at] in known):
            yield text[at:i]
            at = i


class Remembered(dict):
    """word -> ids, in two generations of at most bound words: what is used outlives what isn't."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = tuple(self.make(word))
        if len(word) <= 64:
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes, bound: int = 250_000):
        self.kind, self.byte_fallback, self.unknown = UNIGRAM, False, 0
        self.dummy, self.squeeze, self.escape = True, True, True
        self.pieces: list[tuple[str, float, int]] = []
        charsmap = b""
        for n, v in _fields(model):
            if n == 1:
                f = dict(_fields(v))
                self.pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0]), f.get(3, NORMAL)))
            elif n == 2:
                f = dict(_fields(v))
                self.kind, self.byte_fallback, self.unknown = f.get(3, UNIGRAM), bool(f.get(35, 0)), f.get(40, 0)
            elif n == 3:
                f = dict(_fields(v))
                charsmap, self.dummy, self.squeeze, self.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self._normalizer = None
        if charsmap:  # a normaliser other than identity: its table is applied by the library
            import sentencepiece

            self._normalizer = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of: list[bytes] = []
        self.id_of_byte = [self.unknown] * 256
        self.id_of: dict[str, int] = {}
        for i, (p, _, k) in enumerate(self.pieces):
            if k == BYTE:
                self.id_of_byte[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif k in (CONTROL, UNKNOWN):
                self.bytes_of.append(b" \xe2\x81\x87 " if k == UNKNOWN else b"")
            else:
                self.bytes_of.append(p.replace(MARK, " ").encode())
                if k != UNUSED:
                    self.id_of[p] = i
        self.sizes = [len(p) for p, _, _ in self.pieces]
        self._lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        scores = [s for _, s, k in self.pieces if k == NORMAL]
        self.unknown_score = min(scores, default=0.0) - 10.0
        self._pairs = 0
        self._heads: dict[str, list[int]] = {}
        self.bound = bound
        self._words = Remembered(self._ids, bound)
        # a BPE piece that merging its own characters doesn't give is never part of a result
        reachable = {p: i for p, i in self.id_of.items() if self.kind != BPE or self.merge(p) == [p]}
        self.chars = {p for p in reachable if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in reachable.items():
            self.automaton.add_word(p, (i, len(p), {-1: True}))
        if reachable:
            self.automaton.make_automaton()
        #: Whether a character that is no piece is in no piece either: no piece crosses it.
        self.closed = all(c in self.chars for p in reachable for c in p)
        self.chunks = self._chunks()

    def _chunks(self) -> re.Pattern | None:
        """Cuts that no piece crosses: before a run of marks and, if the pieces allow it, around runs of word characters."""
        if not self.escape or any(MARK in p.lstrip(MARK) for p in self.id_of):
            return None
        if any(re.search(rf"\w[^\w{MARK}]|[^\w{MARK}]\w", p) for p in self.id_of):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        return re.compile(rf"{MARK}*(?:\w+|[^\w{MARK}]+)|{MARK}+")

    # -- encoding

    def normalize(self, text: str) -> str:
        if self._normalizer is not None:
            return self._normalizer.normalize(text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        text = (" " if self.dummy else "") + text
        return text.replace(" ", MARK) if self.escape else text

    def merge(self, chars: str) -> list[str]:
        """BPE by definition: join the best-scored adjacent pair, the leftmost of equals, until none is a piece."""
        parts = list(chars)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                k = self.id_of.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.pieces[k][1] > best[0]):
                    best = (self.pieces[k][1], i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _fits(self, left: int, right: int, known: dict[int, bool]) -> bool:
        """Whether merging the characters of two pieces gives back the two."""
        a, b = self.pieces[left][0], self.pieces[right][0]
        if self._pairs >= 4 * self.bound:
            self._forget()
        self._pairs += 1
        known[left] = out = self.merge(a + b) == [a, b]
        return out

    def _forget(self) -> None:
        for _, _, known in self.automaton.values():
            known.clear()
            known[-1] = True
        self._pairs = 0

    def _ranked(self, text: str) -> list[int]:
        """BPE, one pass over a text of known characters: the one piece that fits at each end (longest first)."""
        n = len(text)
        last = [-1] * (n + 1)  # the piece that ends there; the extra one, at -1, is the start
        if n > 2 * HEAD:  # what ends early depends on the first characters alone, which many words share
            head = text[:HEAD]
            known = self._heads.get(head)
            if known is None:
                if len(self._heads) >= self.bound // 4:
                    self._heads.clear()
                known = [-1] * (HEAD + 1)
                self._relax(head, known)
                known.pop()
                self._heads[head] = known
            last[:HEAD] = known
        self._relax(text, last)
        out, end, sizes = [], n - 1, self.sizes
        while end >= 0:
            i = last[end]
            out.append(i)
            end -= sizes[i]
        out.reverse()
        return out

    def _relax(self, text: str, last: list[int]) -> None:
        for end, found in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            i, length, known = found
            left = last[end - length]
            ok = known.get(left)
            if ok or ok is None and self._fits(left, i, known):
                last[end] = i

    def _scored(self, text: str) -> list[int]:
        """Unigram, one pass: each piece that ends at a position relaxes its best score; an uncovered character costs unknown_score."""
        n, low = len(text), -np.inf
        best, last, size = [0.0] + [low] * n, [-1] * (n + 1), [0] + [1] * n

        def settle(upto: int, done: int) -> int:
            for e in range(done + 1, upto + 1):  # no more pieces end there
                if best[e - 1] + self.unknown_score > best[e]:
                    best[e], last[e], size[e] = best[e - 1] + self.unknown_score, -1, 1
            return upto

        done = 0
        for end, (i, length, _) in self.automaton.iter(text) if self.id_of else ():
            done = settle(end, done)
            score = best[end + 1 - length] + (self.pieces[i][1] if self.pieces[i][2] != USER_DEFINED else 0.0)
            if score > best[end + 1]:
                best[end + 1], last[end + 1], size[end + 1] = score, i, length
        settle(n, done)
        out, end = [], n
        while end > 0:
            if last[end] < 0:
                out.append(-ord(text[end - 1]) - 1)
            else:
                out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        if self.kind == BPE:
            if self.chars.issuperset(text):
                return self._ranked(text)
            if self.closed:
                found = []
                for run in _runs(text, self.chars):
                    found += self._ranked(run) if run[0] in self.chars else run
            else:  # some piece holds a character that is none: merge by definition
                found = [self.id_of.get(p, p) for p in self.merge(text)]
        else:
            found = [i if i >= 0 else chr(-i - 1) for i in self._scored(text)]
        out: list[int] = []
        for p in found:
            if isinstance(p, int):
                out.append(p)
            elif self.byte_fallback:
                out.extend(self.id_of_byte[b] for c in p for b in c.encode("utf-8", "replace"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        text = self.normalize(text or "")
        if self.chunks is None:
            return np.array(self._ids(text), dtype=np.int32) if text else np.zeros(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self._words.__getitem__, self.chunks.findall(text))), dtype=np.int32)

    # -- decoding

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of arrays of ids that lie one after the other; ends: where each ends."""
        lengths = self._lengths[ids]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        blob = self._blob[np.repeat(self._starts[ids] - stops[:-1], lengths) + np.arange(stops[-1])].tobytes()
        out, at = [], 0
        for stop in stops[ends].tolist():
            text = blob[at:stop].decode("utf-8", "replace")
            out.append(text[1:] if self.dummy and text.startswith(" ") else text)
            at = stop
        return out

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _ship(spark: SparkSession, model: str):
    """The model's bytes, broadcast (a vocabulary file has a fixed size)."""
    data = Path(model).read_bytes()
    if len(data) > 64 << 20:
        raise ValueError("a model file of more than 64 MB is not broadcast")
    return spark.sparkContext.broadcast(data)


#: Words that a worker remembers, in each of two generations.
REMEMBERED = 250_000
_BY_DATA: dict[tuple[int, int], Codec] = {}


def _of(data: bytes, bound: int = REMEMBERED) -> Codec:
    key = hash(data), bound
    if key not in _BY_DATA:
        _BY_DATA[key] = Codec(data, bound)
    return _BY_DATA[key]


def _column(batch: pa.RecordBatch, name: str, value: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, value], [*batch.schema.names, name])


def encode(docs: DataFrame, text: str = "text", model: str | None = None, name: str = "piece_ids", remember: int = REMEMBERED) -> DataFrame:
    """docs with the array of piece ids of each text; remember: words that a worker keeps, which trades memory for time."""
    small_batches(docs.sparkSession)
    name, data = free_name(docs, name), _ship(docs.sparkSession, model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(data.value, remember)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(x) for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                yield _column(part, name, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "piece_ids", model: str | None = None, name: str = "decoded") -> DataFrame:
    """rows with the text of each array of piece ids (null: an empty text)."""
    small_batches(rows.sparkSession)
    name, data = free_name(rows, name), _ship(rows.sparkSession, model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _of(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(ids)
                sizes = np.array([len(x.values) if x.is_valid else 0 for x in lists], dtype=np.int64)
                yield _column(part, name, pa.array(codec.decode_all(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)), pa.string()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))
