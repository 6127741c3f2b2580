"""Near-duplicates by SimHash, with candidates from Golay-code fuzzy hashing.

Two definitions of what links share the fingerprints, the codes and the buckets.

By bits (cluster): a 64-bit fingerprint is cut into segments of 22, 21 and 21 bits,
each padded to a 23-bit word. At 4 or fewer differing bits, some two of the three
segments differ in 2 bits or fewer together (pigeonhole). Each segment is decoded,
with its one-bit neighbours, to the indices of nearby codewords; words within 2 bits
share an index. So fingerprints that link share a key (pair of segments, index,
index) of 24 bits. Key buckets are verified bit by bit, and each bucket emits a
spanning forest of its links, never all its pairs; components of the forests are
those of the links.

By similarity (similar): texts whose sets of word shingles have a Jaccard similarity
of 0.8 or more. Four segments of 23 bits of a 128-bit fingerprint are decoded to the
NEAR codewords that agree best, weighed by the margin of each bit, and the key is a
pair of segments again. A pair at 0.8 shares a key with a probability of 0.98, one
at 0.85 of 0.997, one at 0.9 of 0.9999 (measured in tests). Pairs of a bucket that
are near in all 128 bits are candidates, and each candidate is verified on the whole
sets, so that nothing below the bound is linked. First each text is compared with
the smallest one that it is near to, so that a group of copies costs its size. What
that leaves in different components is compared inside of tasks, by families of texts
that near bits connect, in pairs of blocks of bounded size; each emits a spanning forest.

Buckets are streamed in sorted order. One that is larger than BUCKET goes on to a
second pass, dealt as pairs of blocks of at most that size, so that no task holds
a whole hot bucket and no link is lost. Keys have 24 bits, so that buckets grow with
the input: at 10 billion different texts one holds some 10,000.

Defined cases: null texts and texts without words have fingerprint zero (no
shingle), linked like any other. Rows with equal fingerprints (equal sets) are one
node. A null id never becomes a component's id; a component of null ids only has a
null id. An empty table gives an empty result. Other columns are ignored here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.llm import golay
from rdfloom.llm.common import bitmap, cut, free_name, in_bitmap, small_batches
from rdfloom.llm.components import components

SEED = 42
MAX_BITS = 4
#: (lowest bit, bits) of each segment, and the pairs that are keyed.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of a key bucket that one task holds at a time.
BUCKET = 2048
#: By similarity: members of a key bucket, and sets of shingles of a family, that one task holds at a time.
WIDE_BUCKET, FAMILY = 512, 512
#: Rows that one task turns into keys.
NODES = 8192

#: By similarity: words in a shingle, the least similarity, keyed segments, codewords of each, all bits.
WIDTH, SIMILARITY = 5, 0.8
WIDE, NEAR, BITS = 4, 4, 128
WIDE_PAIRS = tuple((i, j) for i in range(WIDE) for j in range(i + 1, WIDE))

Batches = Iterator[pa.RecordBatch]


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def _shingles(text: str | None, width: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; splits at \\x20 and \\x09-\\x0D
    if not words:
        return []
    return words if width == 1 else list(map(b" ".join, zip(*(words[i:] for i in range(width))))) or [b" ".join(words)]


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the highest bit first."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return ones


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    s = _shingles(text, width)
    if not s:
        return 0
    ones = _ones(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), dtype=np.uint64, count=len(s)))
    return int.from_bytes(np.packbits(2 * ones > len(s)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) with the signed 64-bit fingerprint of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for rows in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in rows.column(1)], dtype=np.uint64).view(np.int64)
            yield _batch("doc_id fp", rows.column(0), fps)

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return own.mapInArrow(run, T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType())]))


# -- by bits


def _keys(batches: Batches) -> Batches:
    """(key, fp) for every distinct key of each fingerprint."""
    for rows in batches:
        fps = rows.column(0).to_numpy()
        for at in range(0, len(fps), 1024):
            part = fps[at : at + 1024]
            own = []
            for lo, n in SEGMENTS:  # distinct indices of a row, the rest -1
                s = np.sort(golay.nearby(part.view(np.uint64) >> np.uint64(lo) & np.uint64((1 << n) - 1), n), axis=1)
                s[:, 1:][s[:, 1:] == s[:, :-1]] = -1
                s = np.sort(s, axis=1)[:, ::-1]
                own.append(s[:, : max(1, int((s >= 0).sum(axis=1).max()))])
            for k, (i, j) in enumerate(PAIRS):
                a, b = own[i][:, :, None], own[j][:, None, :]
                key = np.where((a >= 0) & (b >= 0), (k << 24) | (a << 12) | b, -1).reshape(len(part), -1)
                row, col = np.nonzero(key >= 0)
                yield _batch("key fp", key[row, col].astype(np.int32), part[row])


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (member, smallest of its component) among distinct fingerprints."""
    u, n = fps.view(np.uint64), len(fps)
    label = np.arange(n)
    near = [np.bitwise_count(u[i : i + 256, None] ^ u[None, :]) <= max_bits for i in range(0, n, 256)]
    while True:
        new = np.concatenate([np.where(x, label[None, :], n).min(axis=1) for x in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.nonzero(label != np.arange(n))[0]
    return [(fps[own], fps[label[own]])] if len(own) else []


def _runs(batches: Batches, bucket: int) -> Iterator[tuple[object, list[np.ndarray], bool]]:
    """(key, columns, whole) of the runs of two rows and more of equal values in the first column, which is sorted.

    A run is whole unless it has more than bucket rows; then it comes in parts that aren't.
    """
    key0, held, size, over = None, [], 0, False
    join = lambda: [np.concatenate(x) for x in zip(*held)]
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy(zero_copy_only=False)
        rest = [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
        cuts = np.concatenate([[0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]])
        # the first run may go on from the batch before, the last into the next; of the others single rows are passed over
        inner = np.nonzero(np.diff(cuts)[1:-1] > 1)[0] + 1
        for k in [0, *inner.tolist(), *([len(cuts) - 2] if len(cuts) > 2 else [])]:
            lo, hi = cuts[k], cuts[k + 1]
            if key0 is None or keys[lo] != key0:
                if held and (over or size > 1):
                    yield key0, join(), not over
                key0, held, size, over = keys[lo], [], 0, False
            held.append([c[lo:hi] for c in rest])
            size += int(hi - lo)
            if size > bucket:
                yield key0, join(), False
                held, size, over = [], 0, True
    if held and (over or size > 1):
        yield key0, join(), not over


def _gathered(rows: Iterator[tuple], names: str, types: list[pa.DataType], most: int = 1 << 16) -> Batches:
    """Batches of tuples of equally long arrays; a None is a column of nulls, a scalar one of that value."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        cols = []
        for k, t in enumerate(types):
            parts = [pa.nulls(len(r[0]), t) if r[k] is None else pa.array(r[k] if isinstance(r[k], np.ndarray) else [r[k]] * len(r[0]), t) for r in held]
            cols.append(pa.concat_arrays(parts))
        return pa.RecordBatch.from_arrays(cols, names=names.split())

    for r in rows:
        held.append(r)
        size += len(r[0])
        if size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _link(rows: DataFrame, name: str, max_bits: int, bucket: int) -> DataFrame:
    """(name, a, b): spanning edges of each run of equal keys; rows of longer runs than bucket are passed on (b null)."""
    kind = rows.schema[name].dataType.simpleString()

    def found(batches: Batches) -> Iterator[tuple]:
        for key, (fps,), whole in _runs(batches, bucket):
            if not whole:
                yield fps, None, key
            elif len(fps) == 2:
                if fps[0] != fps[1] and (int(fps[0] ^ fps[1]) & (1 << 64) - 1).bit_count() <= max_bits:
                    yield fps[:1], fps[1:], key
            else:
                for a, b in _forest(np.unique(fps), max_bits):
                    yield a, b, key

    def run(batches: Batches) -> Batches:
        return _gathered(found(batches), f"a b {name}", [pa.int64(), pa.int64(), pa.int32() if kind == "int" else pa.string()])

    return rows.select(name, "fp").repartition(name).sortWithinPartitions(name).mapInArrow(run, f"a long, b long, {name} {kind}")


def _dealt(over: DataFrame, half: int, *columns: str) -> DataFrame:
    """Rows of hot keys as pairs of blocks of about half rows, by the first column, under the name of the pair: (pair, columns)."""
    blocks = over.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("n"))
    dealt = over.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64(columns[0]), F.col("n")).cast("int"))
    dealt = dealt.select("key", "i", *columns, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    return dealt.select(F.concat_ws("/", "key", F.least("i", "j"), F.greatest("i", "j")).alias("pair"), *columns)


def _spread(nodes: DataFrame, key: str) -> DataFrame:
    """nodes dealt by the size of what is made of them: some NODES rows a task."""
    n = nodes.count()
    return nodes.repartition(max(1, -(-n // NODES)), key)


def linked(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) edges that connect what links at max_bits or fewer; fps: distinct signed fingerprints in column fp."""
    small_batches(fps.sparkSession)
    keys = _spread(fps.select("fp"), "fp").mapInArrow(_keys, "key int, fp long")
    found = cut(_link(keys, "key", max_bits, bucket))
    over = found.where("b is null").select("key", F.col("a").alias("fp"))
    # two blocks are held whole: their size is about bucket, and not bounded by it
    more = _link(_dealt(over, bucket // 2, "fp"), "pair", max_bits, 1 << 30)
    return found.where("b is not null").select("a", "b").union(more.select("a", "b"))


def cluster(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs, linked by bits."""
    own = cut(fingerprints(docs, doc_id, text, width))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(nodes, max_bits)).toDF("fp", "root")
    labels = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(labels.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# -- by similarity


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different 64-bit hashes of a text's word shingles."""
    s = _shingles(text, width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in s), dtype=np.uint64, count=len(s)))


def _node(s: np.ndarray) -> int:
    """Signed hash of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def margins(s: np.ndarray) -> np.ndarray:
    """By how many standard errors each of 128 bits is set more often than not."""
    with np.errstate(over="ignore"):
        h = (s ^ (s >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        other = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (2 * np.concatenate([_ones(s), _ones(other)]) - len(s)) / math.sqrt(max(1, len(s)))


@cache
def _codewords() -> np.ndarray:
    """Every codeword as a column of -1 and 1."""
    index = np.arange(1 << golay.DIMENSION)
    code = (index << 11) | golay.tables()[0][index]
    return (2.0 * (code[None, :] >> np.arange(golay.LENGTH)[:, None] & 1) - 1).astype(np.float32)


def nearest(margin: np.ndarray) -> np.ndarray:
    """The NEAR best codeword indices of each of WIDE segments; margin: a row of 128 for each text."""
    out = np.empty((len(margin), WIDE * NEAR), np.int16)
    for at in range(0, len(margin), 64):  # 4,096 scores a row and segment
        for k in range(WIDE):
            score = margin[at : at + 64, k * golay.LENGTH : (k + 1) * golay.LENGTH].astype(np.float32) @ -_codewords()
            out[at : at + 64, k * NEAR : (k + 1) * NEAR] = np.argpartition(score, NEAR - 1, axis=1)[:, :NEAR]
    return out


def _wide_keys(batches: Batches) -> Batches:
    """(key, node, lo, hi) for every pair of segments and codewords of each node."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        index = b.column(3).flatten().to_numpy().astype(np.int32).reshape(n, WIDE, NEAR)
        keys = [((k << 24) | (index[:, i, :, None] << 12) | index[:, j, None, :]).reshape(n, -1) for k, (i, j) in enumerate(WIDE_PAIRS)]
        keys = np.concatenate(keys, axis=1)
        yield _batch("key node lo hi", keys.reshape(-1), *(np.repeat(b.column(c).to_numpy(), keys.shape[1]) for c in range(3)))


def _distances(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Differing bits of all pairs of a bucket of bounded size."""
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    out = np.empty((len(lo), len(lo)), np.uint8)
    for i in range(0, len(lo), 256):
        out[i : i + 256] = np.bitwise_count(lo[i : i + 256, None] ^ lo) + np.bitwise_count(hi[i : i + 256, None] ^ hi)
    return out


def max_distance(similarity: float) -> int:
    """Bits in which sets of that Jaccard similarity differ at most, but for one pair in some 5,000."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return round(BITS * p + 3.5 * math.sqrt(BITS * p * (1 - p)))


def _labels(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row reaches."""
    label = np.arange(len(near))
    reach = near | np.eye(len(near), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(near)).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(rows: DataFrame, name: str, most: int, bucket: int) -> DataFrame:
    """(a, b, lo, hi, name, kind) of each bucket: a node and the smallest one that it is near to (kind 0); a node and the smallest one that near pairs connect it to, if that is another (kind 2); rows of longer runs (kind 1, b null)."""
    kind = rows.schema[name].dataType.simpleString()

    def found(batches: Batches) -> Iterator[tuple]:
        for key, (node, lo, hi), whole in _runs(batches, bucket):
            if not whole:
                yield node, None, lo, hi, key, 1
                continue
            order = np.argsort(node)
            node = node[order]
            near = _distances(lo[order], hi[order]) <= most
            np.fill_diagonal(near, False)
            own = np.nonzero(near.any(axis=1))[0]  # most members of a bucket are near to none
            if not len(own):
                continue
            node, near = node[own], near[np.ix_(own, own)]
            least, label, at = near.argmax(axis=1), _labels(near), np.arange(len(node))
            first = least < at
            yield node[first], node[least[first]], None, None, None, 0
            other = (label < at) & (label != least)
            if other.any():
                yield node[other], node[label[other]], None, None, None, 2

    def run(batches: Batches) -> Batches:
        return _gathered(found(batches), f"a b lo hi {name} kind", [pa.int64()] * 4 + [pa.int32() if kind == "int" else pa.string(), pa.int32()])

    return rows.select(name, "node", "lo", "hi").repartition(name).sortWithinPartitions(name).mapInArrow(run, f"a long, b long, lo long, hi long, {name} {kind}, kind int")


def _joined(node: np.ndarray, root: np.ndarray, lo: np.ndarray, hi: np.ndarray, sets: list[np.ndarray], most: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect the roots of which some near members are alike: every near pair of different roots is looked at, as long as its roots aren't connected yet."""
    d = _distances(lo, hi) <= most
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    label, mark, out = np.unique(root, return_inverse=True)[1], np.zeros(ids.max() + 1, np.int32), []
    for i in range(len(node) - 1):
        fits = np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]) - 1e-9
        open_ = d[i, i + 1 :] & fits
        if not (open_ & (label[i + 1 :] != label[i])).any():
            continue
        own = ids[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        mark[own] = 0
        for j in np.nonzero(open_ & (both >= similarity * (size[i] + size[i + 1 :] - both) - 1e-9))[0] + i + 1:
            if label[j] != label[i]:
                out.append((node[i], node[j]))
                label[label == label[j]] = label[i]
    return out


def _across(rows: DataFrame, most: int, similarity: float) -> DataFrame:
    """(a, b): edges between the roots of each group that have members alike; rows: pair, node, root, lo, hi, s."""

    def found(batches: Batches) -> Iterator[tuple]:
        for _, (node, root, lo, hi, s), _ in _runs(batches, 1 << 30):
            if edges := _joined(node, root, lo, hi, list(s), most, similarity):
                yield tuple(np.array(edges, dtype=np.int64).T)

    def run(batches: Batches) -> Batches:
        return _gathered(found(batches), "a b", [pa.int64()] * 2)

    return rows.select("pair", "node", "root", "lo", "hi", "s").repartition("pair").sortWithinPartitions("pair").mapInArrow(run, "a long, b long")


def _chained(edges: DataFrame) -> DataFrame:
    """(a, b): fewer edges that connect the same. A node's ends in order make a chain, whose links the nodes of a group share; a has some end for each of its keys at most."""
    ends = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("b"))
    link = F.explode(F.transform("b", lambda x, i: F.struct(F.when(i == 0, F.col("a")).otherwise(F.get("b", i - 1)).alias("a"), x.alias("b"))))
    return ends.select(link.alias("x")).select("x.a", "x.b").distinct()


def _alike(a: Column, b: Column, similarity: float) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= similarity * (F.size(a) + F.size(b) - both) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets are alike; sizes are compared before sets move."""
    a, b = (sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"), F.size("s").alias(f"n{x}")) for x in "ab")
    fits = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    pairs = pairs.join(a.select("a", "na"), "a").join(b.select("b", "nb"), "b").where(fits).select("a", "b")
    return cut(pairs.join(a.select("a", "sa"), "a").join(b.select("b", "sb"), "b").where(_alike(F.col("sa"), F.col("sb"), similarity)).select("a", "b"))


def _sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, s): the set of each wanted node, made again from the text of one document; wanted: node, doc_id.

    A bitmap of fixed size over the ids keeps other texts out of the scan; texts aren't shuffled.
    """
    spark = source.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("doc_id").alias("h"))))

    def run(batches: Batches) -> Batches:
        for b in batches:
            on = np.nonzero(in_bitmap(bits.value, b.column(1).to_numpy().view(np.uint64)))[0]
            sets = [shingles(b.column(0)[i].as_py(), width) for i in on.tolist()]
            yield _batch("node s", pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))

    found = source.select("t", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "node long, s array<long>")
    return cut(found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, bucket: int = WIDE_BUCKET) -> DataFrame:
    """(doc_id, node, root) for every row of docs: the hash of its set of shingles, and its component, linked by Jaccard similarity."""
    small_batches(docs.sparkSession)
    most = max_distance(similarity)

    def prints(batches: Batches) -> Batches:
        for b in batches:
            sets = [shingles(t.as_py(), width) for t in b.column(1)]
            m = np.array([margins(s) for s in sets]).reshape(-1, BITS)
            words = np.packbits(m > 0, axis=1, bitorder="little").reshape(-1, BITS // 8).view(np.int64)
            index = nearest(m)
            yield _batch("doc_id node lo hi near", b.column(0), pa.array([_node(s) for s in sets], pa.int64()), np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (WIDE * NEAR)), pa.array(index.reshape(-1))))

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    own = cut(source.mapInArrow(prints, f"doc_id {kind}, node long, lo long, hi long, near array<short>"))
    nodes = cut(own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("near").alias("near")))
    keys = _spread(nodes.select("node", "lo", "hi", "near"), "node").mapInArrow(_wide_keys, "key int, node long, lo long, hi long")
    found = cut(_candidates(keys, "key", most, bucket))
    over = found.where("kind = 1").select("key", F.col("a").alias("node"), "lo", "hi")
    hot = cut(_candidates(_dealt(over, bucket // 2, "node", "lo", "hi"), "pair", most, 1 << 30))
    near = cut(found.where("kind != 1").select("a", "b", "kind").union(hot.where("kind != 1").select("a", "b", "kind")).distinct())
    # a pair for each node at most, so that a group of copies costs its size; what may be alike beyond these lies in one family
    tried = cut(near.where("kind = 0").groupBy("a").agg(F.min("b").alias("b")))
    family = cut(components(_chained(near.select("a", "b")))).toDF("node", "key")

    sets = _sets(source, cut(family.select("node").join(nodes.select("node", "doc_id"), "node")), width)
    links = _verified(tried, sets, similarity)
    roots = components(links).toDF("node", "root")
    labelled = cut(family.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most and n > 2").select("key")
    left = labelled.join(mixed, "key").join(nodes.select("node", "lo", "hi"), "node").join(sets.where(F.size("s") > 0), "node")
    left = _across(_dealt(left, FAMILY // 2, "node", "root", "lo", "hi", "s"), most, similarity)
    roots = components(links.union(cut(left))).toDF("node", "root")
    return own.select("doc_id", "node").join(roots, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component by similarity: that with the smallest id, with the columns of docs.

    Of repeated rows with that id one stays. Rows with a null id stay only where
    their whole component has null ids, one of each set of shingles.
    """
    found = similar(docs, doc_id, text, width, similarity)
    keep = cut(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node"))
    key, own, same = (free_name(docs, x) for x in ("_keep_id", "_keep_node", "_same_node"))
    named = docs.join(keep.where("doc_id is not null").select(F.col("doc_id").alias(key)), F.col(doc_id) == F.col(key), "left_semi")
    single = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty()
    if single and keep.where("doc_id is null").isEmpty():
        return named

    @F.arrow_udf("long")
    def node(t: pa.Array) -> pa.Array:
        return pa.array([_node(shingles(x.as_py(), width)) for x in t], pa.int64())

    # rows without an id or with one of several rows are told apart by their shingles
    marked = named.unionByName(docs.where(F.col(doc_id).isNull())).withColumn(own, node(F.col(text)))
    chosen = keep.select(F.col("doc_id").alias(key), F.col("node").alias(same))
    marked = marked.join(chosen, F.col(doc_id).eqNullSafe(F.col(key)) & (F.col(own) == F.col(same)), "left_semi")
    return marked.dropDuplicates([doc_id, own]).drop(own)
