"""WARC archives: write captures as request, response (or revisit) and metadata records, read them back, assemble transactions.

Writing: payloads are grouped by digest (a pre-aggregated maximum of the key), the
capture with the largest key of a group is the response, the others revisit it.
Records are packed into archives of about ARCHIVE bytes, one row each, which
Spark's text sink writes: a failed task's files are never seen, and any store that
Spark writes will do. A record is never split; a longer one has an archive of its own.

Reading: archives are read whole (their size is bounded by the writer; a foreign
archive of up to 2 GB is one task's work), cut by Content-Length and not by
content, gzip by record or by file alike.

Assembly: request, response and metadata records of one capture name each other in
WARC-Concurrent-To. They are joined on record ids, and one nested row is emitted
per capture. Ids are unique, so that no join key is hot.

Defined cases: a null payload is an empty one; payloads of fewer bytes than
min_bytes are always responses. Null urls are written as an empty target. Rows with
a null key can't be referred to and are left out. Rows that share a key are captures
of their own under that key; of rows that share payload and key too, the first (by
url) stands for the group and the others revisit it. An empty table writes no
archive and reads as no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rdfloom.llm.common import cut, fresh_path, small_batches

ARCHIVE = 16 << 20
VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target string, date string, digest string, content_type string, block binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{name}')}>"


def record(kind: str, own_id: str, block: bytes, content_type: str, target: str = "", **fields: str | None) -> bytes:
    """One record; fields name further headers, with _ for -."""
    head = {"WARC-Type": kind, "WARC-Record-ID": own_id, "WARC-Date": DATE}
    if target:
        head["WARC-Target-URI"] = target.replace("\r", "%0D").replace("\n", "%0A")
    head |= {k.replace("_", "-"): v for k, v in fields.items() if v is not None}
    head |= {"Content-Type": content_type, "Content-Length": str(len(block))}
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head.items()), b"\r\n", block])


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Archives (rows of bytes) of the captures of a partition."""
    held, size = [], 0
    for rows in batches:
        for key, copy, url, payload, sha, last in zip(*(rows[c] for c in ("key", "copy", "url", "payload", "sha", "last"))):
            payload, url, name = payload or b"", url or "", f"{key}/{sha}/{copy}"
            response, request = record_id("response", name), record_id("request", name)
            b32 = "sha1:" + base64.b32encode(bytes.fromhex(sha)).decode()
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            if pd.isna(last) or (key, copy) == (last, 0):
                held.append(record("response", response, http + payload, "application/http; msgtype=response", url, WARC_Payload_Digest=b32))
            else:
                profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                held.append(record("revisit", response, http, "application/http; msgtype=response", url, WARC_Payload_Digest=b32, WARC_Profile=profile, WARC_Refers_To=record_id("response", f"{int(last)}/{sha}/0")))
            host, _, path = url.partition("://")[2].partition("/")
            asked = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode("utf-8", "surrogatepass")
            held.append(record("request", request, asked, "application/http; msgtype=request", url, WARC_Concurrent_To=response))
            about = f"capture-key: {key}\r\npayload-length: {len(payload)}\r\n".encode()
            held.append(record("metadata", record_id("metadata", name), about, "application/warc-fields", url, WARC_Concurrent_To=response))
            size += sum(map(len, held[-3:]))
            if size >= ARCHIVE:
                yield pd.DataFrame({"archive": [END.join(held)]})
                held, size = [], 0
    if held:
        yield pd.DataFrame({"archive": [END.join(held)]})


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, compression: str = "gzip") -> None:
    """Write the captures of pages as archives under path; payload: text (as UTF-8) or bytes."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).where("key is not null")
    own = own.withColumn("sha", F.sha1("payload"))
    # captures are named by key, digest and copy: the same name every time that a lost task runs again
    counted = own.groupBy("sha", "key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.octet_length("payload")).alias("n"))
    counted = cut(counted)
    last = counted.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.max("key").alias("last"))
    about = cut(counted.join(last, "sha", "left").select("sha", "key", "copies", "last"))
    rows = own.join(about, ["sha", "key"])
    columns = ["key", "copy", "url", "payload", "sha", "last"]
    single = rows.where("copies = 1").withColumn("copy", F.lit(0)).select(*columns)
    if not about.where("copies > 1").isEmpty():
        # repeated rows are counted first, so that a payload moves once for each group of them
        some = rows.where("copies > 1").groupBy("sha", "key", "url", "last").agg(F.count(F.lit(1)).alias("m"), F.first("payload").alias("payload"))
        before = F.coalesce(F.sum("m").over(Window.partitionBy("sha", "key").orderBy("url").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = some.withColumn("before", before).withColumn("copy", F.explode(F.sequence(F.col("before").cast("int"), (F.col("before") + F.col("m") - 1).cast("int"))))
        single = single.unionByName(some.select(*columns))
    packed = single.mapInPandas(_pack, "archive binary")
    # a binary value read as a string is written as it is; the separator closes the last record
    packed.select(F.col("archive").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; header names in lower case."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(END, at)
        if stop < 0:
            return
        head: dict[str, str] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        start = stop + len(END)
        at = start + int(head.get("content-length", 0))
        yield head, data[start:at]


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for rows in batches:
            for content in rows["content"]:
                held, size = [], 0
                for h, block in parse(content):
                    held.append((h.get("warc-record-id"), h.get("warc-type"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri", ""), h.get("warc-date"), h.get("warc-payload-digest"), h.get("content-type"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("content").mapInPandas(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit) with its request and metadata, either null where there is none."""
    kept = F.struct("record_id", "target", "content_type", "block")
    asked = records.where("type = 'request'").select(F.col("concurrent_to").alias("record_id"), kept.alias("request"))
    about = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("record_id"), kept.alias("metadata"))
    got = records.where("type in ('response', 'revisit')").select("record_id", F.struct("type", "target", "date", "digest", "refers_to", "content_type", "block").alias("response"))
    return got.join(asked, "record_id", "left").join(about, "record_id", "left")


def fields(block, name: str):
    """A long from a block of warc-fields."""
    return F.regexp_extract(block.cast("string"), rf"(?:^|\n){name}: (\d+)", 1).cast("long")


def roundtrip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives written to the shared folder, read back and assembled: one row per capture."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, key, url, payload, min_bytes)
    return transactions(read(spark, path))
