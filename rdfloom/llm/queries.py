"""One query for each operator of this subpackage, and their SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.llm.common import cut, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import sentencepiece_codec as sp

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sp.decode(sp.encode(docs))
    return out.select("doc_id", F.size("piece_ids").alias("n_pieces"), "piece_ids", (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sp.MARK, " ")).alias("round_trip"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import quality

    docs = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("measures")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    return docs.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed.alias("base_failed"), F.col("failed_rule").isNull().alias("kept"))


#: The rules that the query is asked to judge by.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import urls

    out = urls.judge(table(spark, sf_dir, "pages"), tuple(urls.Rule.of(*r) for r in URL_RULES))
    return out.select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import html_extract

    out = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html_extract.default_model())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import simhash

    out = simhash.cluster(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import linededup

    out = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.coalesce(F.size("removed_lines"), F.lit(0))
    return out.select("doc_id", F.when(F.col("removed_lines").isNull(), 0).otherwise(gone).cast("long").alias("n_removed"), F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import warc

    got = warc.roundtrip(table(spark, sf_dir, "pages"))
    about, key = F.col("metadata.block"), "capture-key"
    own = got.select("record_id", warc.fields(about, key).alias("page_id"), warc.fields(about, "payload-length").alias("payload_bytes"), F.regexp_replace("response.digest", "^sha1:", "").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"))
    own = cut(own)
    first = own.where("record_type = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"))
    return own.join(first, "to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = table(spark, sf_dir, "labels").where(~held_out)
    rows = toxicity.training_rows(docs, labels)
    model = toxicity.fit([r.t for r in rows], [r.y for r in rows])
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import decontam

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(decontam.find(docs, table(spark, sf_dir, "benchmark")))
    per = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"), F.max(F.col("end") - F.col("start")).cast("long").alias("longest"))
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("longest", F.lit(0).cast("long")).alias("longest"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rdfloom.llm import lmscore

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    out = lmscore.score(table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_tokens", F.round("score", 9).alias("score"))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict:
    from rdfloom.llm import sql

    return dict(sql.ORACLES)
