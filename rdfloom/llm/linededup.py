"""Line deduplication by overlapping windows of three lines.

Lines with a word are hashed (outer white space is ignored; 128 bits, so that no
two different windows of a corpus are taken for one), every three consecutive ones
make a window. A long passage may have fewer lines: a line of 50 words or more is a
window of its own, and so are two lines that have as many only together. Of a window that occurs more than once, all but
the first occurrence (smallest id, then position) are removed: their covered
positions are merged and the lines dropped. Every line that goes is left standing
at an earlier place. Lines without a word are kept and don't break windows.

Everything is native: first occurrences are pre-aggregated minima, so that a
window which most documents share costs one row a task, and the join that finds
later occurrences may be split where it is skewed.

Defined cases: a null text has no lines and stays null. Texts with fewer than
three lines are kept whole, but for long lines. Rows with one id are read as one document's repeated
rows: a window is at its first place in each of them; lines are removed from all
alike. Rows with a null id come after all others and are left whole. An empty
table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.common import SPACES, WORD, free_name


#: Words from which on fewer lines than a window are one too.
LONG = 50


def _positions(text: Column) -> Column:
    """(place, two hashes, words) of each line with a word."""

    def line(x: Column, i: Column) -> Column:
        own = F.btrim(x, F.lit(SPACES))
        return F.struct(i.alias("p"), F.when(x.rlike(WORD), F.xxhash64(own)).alias("h"), F.xxhash64(F.lit("line"), own).alias("k"), F.regexp_count(x, F.lit(WORD)).alias("n"))

    return F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["h"].isNotNull())


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, long: int = LONG) -> DataFrame:
    """(id, at, places, w, v): 128 bits of hash of each window of lines with the places it covers.

    A window has width lines; one line, or two lines of which neither does so alone,
    that have long words or more are a window as well.
    """
    lines = docs.select(F.col(doc_id).alias("id"), _positions(F.col(text)).alias("l")).where(F.col("id").isNotNull() & (F.size("l") > 0))
    rows = lines.select("id", "l", F.explode(F.sequence(F.lit(0), F.size("l") - 1)).alias("at"))
    n = [F.get(F.col("l"), F.col("at") + i)["n"] for i in (0, 1)]
    short = F.when(n[0] >= long, 1).when((n[1] < long) & (n[0] + n[1] >= long), 2)
    size = F.array_compact(F.array(short, F.when(F.col("at") + width <= F.size("l"), width)))
    rows = rows.select("id", "at", "l", F.explode(F.array_distinct(size)).alias("size"))
    part = F.slice("l", F.col("at") + 1, F.col("size"))
    return rows.select("id", "at", F.transform(part, lambda x: x["p"]).alias("places"), F.xxhash64(F.transform(part, lambda x: x["h"])).alias("w"), F.xxhash64(F.transform(part, lambda x: x["k"])).alias("v"))


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, gone): for each id with later occurrences the sorted places of the lines that they cover."""
    all_ = windows(docs, doc_id, text, width)
    first = all_.groupBy("w", "v").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = all_.join(first, ["w", "v"]).where(F.struct("id", "at") > F.col("first"))
    return later.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("gone"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, removed: str = "removed_lines") -> DataFrame:
    """docs with repeated windows cut from the text, and the places of the removed lines (null: none) under a free name."""
    removed, key = free_name(docs, removed), free_name(docs, "_line_id")
    gone = repeated_places(docs, doc_id, text, width).toDF(key, removed)
    out = docs.join(gone, F.col(doc_id) == F.col(key), "left").drop(key)
    lines = F.split(F.col(text), "\n")
    left = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(removed)), lambda i: F.get(x, i)), "\n"))[0]
    # array_except of all places is empty and joins to an empty text
    return out.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(left))
