"""Language-model scoring by cross-entropy difference.

Two bigram models with one vocabulary, one order and one smoothing: the target model
counts the documents of a given set of ids, the background model counts all
documents. A document's score is the mean, over its words and its end, of target
loss less background loss (low: like the target). The document itself is left out
of the counts of the models that hold it.

    P(w | h) = (c(h, w) + MU * P(w)) / (c(h) + MU),    P(w) = (c(w) + 1) / (N + 1)

The models are matched in size: counts of the background are multiplied by the
target's share of all tokens, so that both have N of them. These are the expected
counts of a random sample as large as the target: neither model is smoothed more than
the other, and yet every document counts. (The 1 of an unseen word isn't divided by
the size of the vocabulary: the same constant in both.)

The vocabulary is every word of the corpus, so it grows with the input. A word is
known by a 64-bit hash. A text is read as START, its words, END, so that a word's
count is its count as a context too.

Counts meet the documents in one shuffle. The words and bigrams that are most frequent
in a sample of documents (at most HEAD of each) are counted over the whole corpus and
broadcast; what they contribute is summed inside the scan. Every other bigram of a
document is a row, keyed by the bigram or, if its second word isn't in the head, by
that word. The rows of a key then hold all that its counts are made of. What is in the
heads changes no score: it keeps keys from being hot.

Target ids are broadcast as bitmaps of 4 KB for each range of 32,768 ids that occurs,
as long as there are at most RANGES of them; beyond that texts are joined with them.

Defined cases: words are runs of non-space bytes, A-Z lower-cased. A null or empty
text has no token, is in no model and scores 0. Rows whose id is null or isn't a whole
number are counted and get no row of their own; rows that share an id are left out one
by one, and their losses are pooled. Without target documents every score is 0. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.common import small_batches

#: Word keys of the places before and after a text; the end's is also the count of starts.
START, END = 1, 2
HEAD = 1 << 17
#: Documents of the sample that the frequent bigrams are taken from.
SAMPLE = 5000
#: Ranges of target ids that are broadcast (32 MB).
RANGES = 8192
MU = 50.0
#: Rows that a task holds at a time; words and bytes of text go by multiples of it.
HELD = 1 << 19
#: Different words that a worker remembers.
KNOWN = 400_000

Batches = Iterator[pa.RecordBatch]
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Counts of a table that one row carries.
PART = 1 << 13
#: Kinds of rows, in the lowest two bits of their key: a document's sum, a bigram of the tail (the place of its second word in the next 17 bits), a word of the tail.
TOTAL, PAIR, WORD = 0, 1, 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _mix(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One unsigned hash of two."""
    x = (h.view(np.uint64) ^ (h.view(np.uint64) >> np.uint64(29))) * _ODD + w.view(np.uint64)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)


class Table:
    """Sorted different hashes with the counts of background and target; most hashes that aren't in it are told by a bitmap."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.b, self.t = keys, np.zeros(len(keys)), np.zeros(len(keys))
        self.bits = np.zeros(1 << 22, dtype=bool)
        self.bits[self.keys >> np.uint64(42)] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each unsigned hash, -1 where it isn't here."""
        out = np.full(len(keys), -1, dtype=np.int64)
        some = np.nonzero(self.bits[keys >> np.uint64(42)])[0]
        if len(some) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
            out[some[hit]] = at[hit]
        return out


class Words(dict):
    """word -> number, with the hash and the place in a table of each number; START and END are 0 and 1."""

    def __init__(self, table: Table | None = None):
        super().__init__()
        self.table = table
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[int] = [START, END]
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.settle()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes) + len(self.new)
        self.new.append(xxhash.xxh64_intdigest(word, 10))
        return n

    def settle(self) -> None:
        found = np.array(self.new, dtype=np.uint64)
        self.hashes = np.concatenate([self.hashes, found])
        if self.table is not None:
            self.places = np.concatenate([self.places, self.table.places(found)])
        self.new = []

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of words and ends, of the word before each, words of each text) of the texts that have words."""
        if len(self) > KNOWN:
            self.reset()
        own = [words(t) for t in texts.to_pylist()]
        n = np.array([len(x) for x in own], dtype=np.int64)
        ends = np.cumsum(n[n > 0] + 1)
        w = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        inside = np.ones(len(w), dtype=bool)
        inside[ends - 1] = False
        w[inside] = np.fromiter((self[x] for t in own for x in t), dtype=np.int64, count=int(n.sum()))
        h = np.concatenate([[0], w[:-1]])[: len(w)]
        h[ends[:-1]] = 0
        if self.new:
            self.settle()
        return w, h, n


class Ids:
    """A set of whole numbers as bitmaps by range."""

    def __init__(self, ranges: list):
        self.low = np.array([r.low for r in ranges], dtype=np.int64)
        self.bits = np.array([np.frombuffer(r.bits, np.uint8) for r in ranges]).reshape(len(ranges), 4096)

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), dtype=bool)
        if len(self.low):
            at = np.minimum(np.searchsorted(self.low, ids >> 15), len(self.low) - 1)
            place = ids & 32767
            out = (self.low[at] == ids >> 15) & (self.bits[at, place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of some 4 * HELD bytes of text, a row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 4 * HELD)))
        yield batch.slice(at, stop - at)
        at = stop


def _sums(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different keys and the sum of each weight."""
    own, at = np.unique(keys, return_inverse=True)
    return own, *(np.bincount(at, x, minlength=len(own)) for x in weights)


def _added(sums: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return _sums(*(np.concatenate(x) for x in zip(*sums)))


def _packed(sums: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    """A row for each bucket of ids: differences of sorted ids, words and ends, compressed, and the sums."""
    ids, n, ends, v = sums
    bucket = (_mix(ids, ids) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((ids, bucket))
    cuts = np.concatenate([[0], np.nonzero(np.diff(bucket[order]))[0] + 1, [len(ids)]])
    found = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own = order[lo:hi]
        plain = np.concatenate([np.diff(ids[own], prepend=0), n[own].astype(np.int64), ends[own].astype(np.int64)])
        found.append(v[own].tobytes() + zlib.compress(plain.tobytes(), 1) + (hi - lo).to_bytes(8, "little"))
    return pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts[:-1]]), pa.array(found, pa.binary())], names=["bucket", "sums"])


def _unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(data[-8:], "little")
    ids, words_, ends = np.frombuffer(zlib.decompress(data[8 * n : -8]), np.int64).reshape(3, n)
    return np.cumsum(ids), words_, ends, np.frombuffer(data[: 8 * n])


def _heads_of(docs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and of the bigrams that are most frequent in a sample of documents."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("t", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)

    def run(batches: Batches) -> Batches:
        known = Words()
        for batch in batches:
            for part in _slices(batch):
                w, h, _ = known.read(part.column(0))
                for kind, own in ((0, known.hashes[w]), (1, _mix(known.hashes[h], known.hashes[w]))):
                    k, c = np.unique(own, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(c)], names=["kind", "k", "c"])

    found = sample.select("t").mapInArrow(run, "kind int, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c")).where("c > 1")
    words_, pairs = (found.where(f"kind = {kind}").orderBy(F.desc("c"), "k").limit(head).toArrow().column("k").to_numpy().view(np.uint64) for kind in (0, 1))
    return np.unique(np.append(words_, np.uint64(END))), np.unique(pairs)


def _summed(tables: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """Counts of all tasks, in arrays of the given sizes: parts of packed counts, added up by part."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows.column("counts").to_pylist())
        return pa.table({"part": rows.column("part")[:1], "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = [np.zeros(n, dtype=np.int64) for n in sizes]
    for r in tables.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        own = np.frombuffer(zlib.decompress(r.counts), np.int64)
        out[r.part & 3][(r.part >> 2) * PART :][: len(own)] = own
    return out


def score(docs: DataFrame, target_ids: DataFrame, doc_id: str = "doc_id", text: str = "text", head: int = HEAD - 1, mu: float = MU) -> DataFrame:
    """(doc_id, n_tokens, score) for each id; target_ids: one column of the ids of target documents."""
    if not 0 <= head < HEAD:
        raise ValueError(f"head is at most {HEAD - 1}")
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(text).alias("t"), F.col(doc_id).try_cast("long").alias("doc_id"))
    wanted = target_ids.select(F.col(target_ids.columns[0]).try_cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ranges = wanted.groupBy(F.shiftright("doc_id", 15).alias("low")).agg(F.bitmap_construct_agg(F.pmod("doc_id", F.lit(32768))).alias("bits")).orderBy("low").limit(RANGES + 1).collect()
    ids = None
    if len(ranges) <= RANGES:
        ids = spark.sparkContext.broadcast(Ids(ranges))
        marked = own
    else:
        marked = own.join(wanted.withColumn("target", F.lit(True)), "doc_id", "left").select("t", "doc_id", F.coalesce("target", F.lit(False)).alias("target"))
    tables = spark.sparkContext.broadcast(tuple(map(Table, _heads_of(own, head))))

    def about(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or 0, whether there is one, whether it is a target) of each row."""
        known = part.column(1).is_valid().to_numpy(zero_copy_only=False)
        own_ids = part.column(1).fill_null(0).to_numpy()
        return own_ids, known, known & ids.value.has(own_ids) if ids is not None else part.column(2).to_numpy(zero_copy_only=False)

    def count(batches: Batches) -> Batches:
        """Counts of the heads' words and bigrams and of all tokens, in parts: of all documents, then of the targets."""
        heads, pairs = tables.value
        known = Words(heads)
        total = [np.zeros((2, n), dtype=np.int64) for n in (len(heads.keys), len(pairs.keys), 1)]
        for batch in batches:
            for part in _slices(batch):
                w, h, n = known.read(part.column(0))
                target = np.repeat(about(part)[2][n > 0], n[n > 0] + 1)
                for places, out in zip((known.places[w], pairs.places(_mix(known.hashes[h], known.hashes[w])), np.zeros(len(w), np.int64)), total):
                    on = places >= 0
                    out[0] += np.bincount(places[on], minlength=out.shape[1])
                    out[1] += np.bincount(places[on & target], minlength=out.shape[1])
        for which, out in enumerate(x.reshape(-1) for x in total):
            if out.any():
                at = range(0, len(out), PART)
                yield pa.RecordBatch.from_arrays([pa.array([(i // PART) << 2 | which for i in at], pa.int32()), pa.array([zlib.compress(out[i : i + PART].tobytes(), 1) for i in at], pa.binary())], names=["part", "counts"])

    found = _summed(marked.mapInArrow(count, "part int, counts binary"), [2 * n for n in (*(len(t.keys) for t in tables.value), 1)])
    for t, x in zip(tables.value, found):
        t.b, t.t = x.reshape(2, -1).astype(float)
    shipped = spark.sparkContext.broadcast(tables.value)
    n_b, n_t = found[2].tolist()
    ratio = n_t / n_b if n_b else 0.0

    def gain(c, b, t, wb, wt, own_b, own_t, target):
        """c times the log of background over target, of the numerators of P(w | h); all without the own counts."""
        background = ratio * (b - c) + mu * (ratio * (wb - own_b) + 1) / (n_t + 1)
        return c * np.log(background / ((t - c * target) + mu * (wt - own_t + 1) / (n_t + 1)))

    def context(c, b, t, own_b, own_t):
        """The same of the denominators, for a context that occurs c times."""
        return -c * np.log((ratio * (b - own_b) + mu) / (t - own_t + mu))

    def scan(batches: Batches) -> Batches:
        """A row with the sum of the heads for each document, and a row for each bigram of the tails."""
        heads, pairs = shipped.value
        words_ = Words(heads)
        for batch in batches:
            for part in _slices(batch):
                w, h, n = words_.read(part.column(0))
                ids_, known, target = about(part)
                flag = target.astype(np.int64)
                doc = np.repeat(np.nonzero(n > 0)[0], n[n > 0] + 1)
                sums = np.zeros(len(n))
                if len(w):
                    base = len(words_.hashes)
                    by_word, own_count = np.unique(doc * base + w, return_counts=True)
                    d, x, c = by_word // base, by_word % base, own_count.astype(float)
                    p = words_.places[x]
                    on = p >= 0
                    p, c, g = p[on], c[on], flag[d[on]]
                    sums += np.bincount(d[on], context(c, heads.b[p], heads.t[p], c, c * g), minlength=len(n))
                    # bigrams of each document, in its order of words
                    order = np.argsort((doc * base + w) * base + h)
                    both = ((doc * base + w) * base + h)[order]
                    starts = np.nonzero(np.concatenate([[True], both[1:] != both[:-1]]))[0]
                    c, both = np.diff(np.append(starts, len(both))), both[starts]
                    own = own_count[np.searchsorted(by_word, both // base)]
                    hs, ws, d = words_.hashes[both % base], words_.hashes[both // base % base], both // base // base
                    key, place = _mix(hs, ws), words_.places[both // base % base]
                    pair = np.where(place >= 0, pairs.places(key), -1)
                    on = pair >= 0
                    p, q, o, g = place[on], pair[on], own[on], flag[d[on]]
                    sums += np.bincount(d[on], gain(c[on], pairs.b[q], pairs.t[q], heads.b[p], heads.t[p], o, o * g, g), minlength=len(n))
                    rest = np.nonzero(~on)[0]
                    place, d = place[rest], d[rest]
                    tail = place < 0
                    keys = np.where(tail, ws[rest] & ~np.uint64(3) | np.uint64(WORD), (key[rest] >> np.uint64(19) << np.uint64(19)) | (np.maximum(place, 0).astype(np.uint64) << np.uint64(2)) | np.uint64(PAIR))
                    packed = (c[rest] << 32) | (own[rest] << 2) | (flag[d] << 1) | known[d]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.where(tail, hs[rest].view(np.int64), 0)), pa.array(ids_[d]), pa.array(packed)], names=["key", "about", "doc_id", "packed"])
                at = np.nonzero(known)[0]
                keys = (_mix(ids_[at], ids_[at]) & ~np.uint64(3)) | np.uint64(TOTAL)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums[at].view(np.int64)), pa.array(ids_[at]), pa.array(n[at])], names=["key", "about", "doc_id", "packed"])

    def settle(key: np.ndarray, about: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, ...]:
        """(id, words, ends, sum) of each document in rows that hold whole keys."""
        heads, _ = shipped.value
        kind = key & 3
        total = kind == TOTAL
        c, own, target, known = (packed >> 32).astype(float), ((packed >> 2) & ((1 << 30) - 1)).astype(float), (packed >> 1 & 1).astype(float), (packed & 1).astype(bool)
        known[total] = True
        value = np.zeros(len(key))
        value[total] = about[total].view(np.float64)
        for of in (PAIR, WORD):
            on = np.nonzero(kind == of)[0]
            if not len(on):
                continue
            if of == WORD:
                on = on[np.lexsort((about[on], key[on]))]
            k, a, x, o, g = key[on], about[on], c[on], own[on], target[on]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            group = np.cumsum(new) - 1
            b, t = np.bincount(group, x)[group], np.bincount(group, x * g)[group]
            if of == PAIR:
                place = (k >> 2) & (HEAD - 1)
                wb, wt = heads.b[place], heads.t[place]
                value[on] = gain(x, b, t, wb, wt, o, o * g, g)
            else:
                sub = np.cumsum(new | np.concatenate([[True], a[1:] != a[:-1]])) - 1
                pb, pt = np.bincount(sub, x)[sub], np.bincount(sub, x * g)[sub]
                value[on] = gain(x, pb, pt, b, t, o, o * g, g) + context(x, b, t, o, o * g)
        n = np.where(total, packed, 0)
        return _sums(ids[known], n[known], (n > 0)[known], value[known])

    def meet(batches: Batches) -> Batches:
        """The sums of the documents that a task has seen, packed by bucket."""
        held, size = [], 0
        sums, count_ = [], 0

        def keep(x: tuple[np.ndarray, ...]) -> Batches:
            nonlocal sums, count_
            if not len(x[0]):  # rows without an id only
                return
            sums.append(x)
            count_ += len(x[0])
            if count_ > 4 * HELD:
                sums = [_added(sums)]
                count_ = len(sums[0][0])
                if count_ > 2 * HELD:
                    yield _packed(sums[0], buckets)
                    sums, count_ = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
            if size < HELD:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            stop = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            if stop:
                yield from keep(settle(*(x[:stop] for x in cols)))
            held = [[x[stop:] for x in cols]]
            size = len(held[0][0])
        if held:
            yield from keep(settle(*(np.concatenate(x) for x in zip(*held))))
        if count_:
            yield _packed(_added(sums), buckets)

    def total(batches: Batches) -> Batches:
        """(doc_id, n, ends, v) of each bucket; rows are sorted by bucket."""
        now, held, size = None, [], 0

        def out() -> pa.RecordBatch:
            ids_, n, ends, v = _added(held)
            return pa.RecordBatch.from_arrays([pa.array(ids_), pa.array(n.astype(np.int64)), pa.array(ends.astype(np.int64)), pa.array(v)], names=["doc_id", "n", "ends", "v"])

        for batch in batches:
            for bucket, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield out()
                    held, size = [], 0
                now = bucket
                held.append(_unpacked(sums.as_py()))
                size += len(held[-1][0])
                if size > 4 * HELD:
                    held = [_added(held)]
                    size = len(held[0][0])
        if held:
            yield out()

    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = marked.mapInArrow(scan, "key long, about long, doc_id long, packed long")
    met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "bucket int, sums binary")
    out = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "doc_id long, n long, ends long, v double")
    return out.select("doc_id", F.col("n").alias("n_tokens"), F.when(F.col("n") > 0, F.col("v") / (F.col("n") + F.col("ends"))).otherwise(F.lit(0.0)).alias("score"))
