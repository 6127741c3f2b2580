"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of word characters. A seed is a fixed mask over
consecutive tokens that ignores some positions, so that windows which differ only
there still get the same hash. Seed hashes of the benchmark and of the documents
are joined; a hit puts document and item on a diagonal (difference of positions),
and each diagonal is verified token by token: a stretch of MIN_OVERLAP or more
tokens (or the whole item, if that is shorter) of which at least IDENTITY agree.

The documents' hashes are first held against a bitmap of 2^24 bits (2 MB whatever
the benchmark's size) of those of the benchmark, inside the scan; only what passes
is joined, on the whole hash. A saturated bitmap costs time and no hit. Documents
with a candidate are read again to be verified; the others are not.

Defined cases: null or empty texts have no tokens and no hit. Items with fewer than
MIN_ITEM tokens are ignored; items below MIN_OVERLAP are seeded by runs so short
that one agrees in full wherever the fifth that may differ lies.
Items with equal tokens count as the one with the smallest id. Null item ids and
null doc ids take no part. Rows with one doc id share their candidates, are verified
one by one, and the id is contaminated if one of them is. An empty benchmark or
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.common import WordHashes, bitmap, cut, free_name, in_bitmap, small_batches

#: Positions that count; the ends always do. Lossless at MIN_OVERLAP and IDENTITY: whichever fifth of the tokens of 13 to 25 differs,
#: a mask fits where none does (tests try them all), and one half of a longer stretch is itself long and alike enough.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 6, 9, 10), (0, 2, 3, 9, 11, 12), (0, 1, 2, 3, 4, 5))
MIN_ITEM, MIN_OVERLAP, IDENTITY = 5, 13, 0.8

_TOKEN = re.compile(r"\w+")
_HASHES = WordHashes(9, 200_000)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's tokens."""
    words = _TOKEN.findall((text or "").lower())
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


_FACTORS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(max(map(len, MASKS)))], dtype=np.uint64)


def run_of(n: int) -> int:
    """Tokens that agree in a row, at least, in an item of n < MIN_OVERLAP tokens that is found."""
    return n // (n - int(np.ceil(IDENTITY * n - 1e-9)) + 1)


def seeds(t: np.ndarray, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each mask; short: lengths of the runs that seed items below MIN_OVERLAP tokens."""
    for k, places in [*enumerate(MASKS), *((100 + n, tuple(range(n))) for n in short)]:
        n = len(t) - places[-1]
        if n > 0:
            h = np.full(n, k + 1, dtype=np.uint64)
            for c, p in enumerate(places):  # a sum of products of token hashes, an odd factor for each place
                h += t[p : p + n] * _FACTORS[c]
            yield np.arange(n, dtype=np.int32), _mix(h)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int, min_overlap: int = MIN_OVERLAP, identity: float = IDENTITY) -> tuple[int, int]:
    """Longest stretch of the diagonal (document position less item position) that is long and alike enough: [start, end) in the document, or (0, 0)."""
    lo, hi = max(0, diagonal), min(len(doc), len(item) + diagonal)
    need = min(min_overlap, len(item))
    if hi - lo < need:
        return 0, 0
    same = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    # the sum of (agrees - identity) over a stretch is >= 0 if enough of it agree; longest stretch by prefix minima
    s = np.concatenate([[0.0], np.cumsum(same - identity)])
    low = np.minimum.accumulate(s)
    best = (0, 0)
    for end in np.nonzero(same)[0] + 1:
        start = int(np.searchsorted(-low, -(s[end] + 1e-9)))
        if end - start >= need and end - start > best[1] - best[0]:
            best = (start, int(end))
    return (best[0] + lo, best[1] + lo) if best[1] else (0, 0)


Batches = Iterator[pa.RecordBatch]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _items(batches: Batches) -> Batches:
    for rows in batches:
        found = [(i, t.view(np.int64)) for i, x in zip(rows.column(0).to_pylist(), rows.column(1)) if len(t := tokens(x.as_py())) >= MIN_ITEM]
        yield _batch("item_id toks", pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.int64())))


def _item_seeds(batches: Batches) -> Batches:
    for rows in batches:
        for item, toks in zip(rows.column(0).to_pylist(), rows.column(1)):
            t = toks.values.to_numpy().view(np.uint64)
            for at, h in seeds(t, (run_of(len(t)),) if len(t) < MIN_OVERLAP else ()):
                yield _batch("h item_id q", h.view(np.int64), np.full(len(h), item, np.int64), at)


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", min_overlap: int = MIN_OVERLAP, identity: float = IDENTITY) -> DataFrame:
    """(doc_id, item_id, start, end) in tokens of the document: the longest verified overlap of each document with each item."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null")
    items = bench.mapInArrow(_items, "item_id long, toks array<long>").groupBy("toks").agg(F.min("item_id").alias("item_id"))
    items = cut(items.select("item_id", "toks"))
    of_items = cut(items.mapInArrow(_item_seeds, "h long, item_id long, q int"))
    short = tuple(sorted({run_of(r.n) for r in items.select(F.size("toks").alias("n")).where(f"n < {MIN_OVERLAP}").distinct().collect()}))  # fewer than MIN_OVERLAP values
    bits = spark.sparkContext.broadcast(bitmap(of_items.select("h")))

    def hits(batches: Batches) -> Batches:
        known = bits.value
        for rows in batches:
            ids, ps, hs = [], [], []
            for i, x in zip(rows.column(0).to_pylist(), rows.column(1)):
                for at, h in seeds(tokens(x.as_py()), short):
                    on = np.nonzero(in_bitmap(known, h))[0]
                    if len(on):
                        ids.append(np.full(len(on), i, np.int64))
                        ps.append(at[on])
                        hs.append(h[on].view(np.int64))
            if ids:
                yield _batch("h doc_id p", np.concatenate(hs), np.concatenate(ids), np.concatenate(ps))

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).where("doc_id is not null")
    seen = own.mapInArrow(hits, "h long, doc_id long, p int")
    diagonals = seen.join(of_items, "h").select("doc_id", "item_id", (F.col("p") - F.col("q")).alias("d")).distinct()
    pairs = diagonals.groupBy("doc_id", "item_id").agg(F.collect_set("d").alias("ds")).join(items, "item_id")
    wanted = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "ds", "toks")).alias("wanted"))

    def verify(batches: Batches) -> Batches:
        for rows in batches:
            out = []
            for i, x, want in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                doc = tokens(x.as_py())
                for w in want:
                    item = w["toks"].values.to_numpy().view(np.uint64)
                    spans = [overlap(doc, item, d, min_overlap, identity) for d in w["ds"].as_py()]
                    start, end = max(spans, key=lambda s: (s[1] - s[0], -s[0]))
                    if end:
                        out.append((i, w["item_id"].as_py(), start, end))
            yield _batch("doc_id item_id start end", *(pa.array([o[k] for o in out], pa.int64() if k < 2 else pa.int32()) for k in range(4)))

    found = own.join(wanted, "doc_id").select("doc_id", "t", "wanted").mapInArrow(verify, "doc_id long, item_id long, start int, end int")
    longest = F.max(F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), "end"))
    return found.groupBy("doc_id", "item_id").agg(longest.alias("x")).select("doc_id", "item_id", (-F.col("x.s")).alias("start"), "x.end")


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **rest) -> DataFrame:
    """The documents without any verified overlap, with the columns of docs."""
    key = free_name(docs, "_bad_id")
    bad = cut(find(docs, benchmark, doc_id, text, **rest).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(bad, F.col(doc_id).cast("long") == F.col(key), "left_anti")
