"""The registered queries and the pipeline over whole small tables, against brute force and SQL."""

import html
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from test_models_and_files import brute_url
from test_near_copies import brute as brute_copies
from test_text_operators import brute_components, brute_fingerprint, brute_lines, brute_scores

import __spark_entry__ as driver
import corpus_pipeline
from rdfloom.llm import decontam
from rdfloom.llm import sql as oracles

SF = "/root/testdata/sf0.001"


def read(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def run(spark):
    found, kept = driver.queries(), {}

    def get(name):
        if name not in kept:
            kept[name] = found[name](spark, SF).collect()
        return kept[name]

    return get


@pytest.fixture(scope="module")
def docs():
    return dict(read("documents", "doc_id, text"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))


def contaminated(texts):
    items = {i: decontam.tokens(t) for i, t in read("benchmark", "item_id, text")}
    out = {}
    for d, t in texts.items():
        x = decontam.tokens(t)
        for i, item in items.items():
            shared = set(item[k : k + 7].tobytes() for k in range(len(item) - 6)) & set(x[k : k + 7].tobytes() for k in range(len(x) - 6))
            if shared and any(decontam.overlap(x, item, g)[1] for g in range(-len(item), len(x))):
                out.setdefault(d, []).append(i)
    return out


def test_names():
    found = driver.queries()
    assert sorted(int(m[1]) for k in found if (m := re.match(r"op(\d+)_", k))) == list(range(1, 11)) and "pipeline" in found
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "encode"]


def test_op1(run, docs, library):
    rows = run("op1_sentencepiece")
    assert len(rows) == len(docs)
    for r in rows:
        assert list(r.piece_ids) == library.encode(docs[r.doc_id]) and r.n_pieces == len(r.piece_ids) and r.round_trip


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(run, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(oracles.ORACLES[name])
    rows = run(name)
    assert sorted(tuple(r[k] for k in want.columns) for r in rows) == sorted(tuple(r) for r in want.fetchall())


def test_op3(run):
    urls = dict(read("pages", "page_id, url"))
    rows = run("op3_url_filters")
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule.verdict


def test_op4(run):
    pages = {i: (u, h) for i, u, h in read("pages", "page_id, url, html")}
    right = 0
    for r in run("op4_html_extraction"):
        url, page = pages[r.page_id]
        a, e = page.index("<article>") + 9, page.find("</article>")
        body = page[a:e] if e >= 0 else re.sub(r"<[^>]*$", "", page[a:])
        want = "\n".join(y for x in re.split(r"</?(?:p|h1)>", body) if (y := re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", x))).strip()))
        right += r.text == want and r.url == url and r.n_chars == len(r.text)
    assert right >= 0.95 * len(pages)


def test_op5(run, docs):
    ids = sorted(docs)
    fps = [brute_fingerprint(docs[i]) for i in ids]
    want = brute_components(fps, ids)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run("op5_simhash_near_dedup")} == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps)}


def test_op8(run, docs):
    rows = run("op8_toxicity")
    labels = dict(read("labels", "doc_id, toxic"))
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    clean = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.2 * len(clean)  # some seven toxic texts to learn from


def test_op9(run, docs):
    want = contaminated(docs)
    got = {r.doc_id: [int(i) for i in r.item_ids.split(",") if i] for r in run("op9_decontamination")}
    assert set(got) == set(docs) and {d: i for d, i in got.items() if i} == want


def test_op10(run, docs):
    rows = run("op10_lm_scoring")
    ids, good = sorted(docs), {d for d, q in read("labels", "doc_id, quality") if q == 1}
    want = dict(zip(ids, brute_scores([docs[i] for i in ids], {k for k, i in enumerate(ids) if i in good})))
    assert len(rows) == len(ids) and all(r.n_tokens == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-9 for r in rows)


def test_pipeline(run, docs, library):
    """Each stage by brute force on what the one before kept."""
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in c.sql(f"SELECT doc_id FROM ({oracles.QUALITY}) WHERE kept").fetchall()}
    texts = brute_lines((i, docs[i]) for i in sorted(kept))
    ids = sorted(texts)
    label = brute_copies([texts[i] for i in ids])
    texts = {i: texts[i] for k, i in enumerate(ids) if label[k] == k}
    bad = contaminated(texts)
    assert {r.doc_id: list(r.piece_ids) for r in run("pipeline")} == {i: library.encode(t) for i, t in texts.items() if i not in bad}
    assert 0 < len(bad) < len(texts) < len(docs)


def test_stages_keep_columns_and_take_odd_rows(spark):
    """Nulls in any column, repeated rows, clashing names and an empty table through every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    odd = base.limit(30).union(base.limit(10)).withColumn("fingerprint", F.lit("x")).withColumn("measures", F.lit(1)).withColumn("removed_lines", F.lit(2)).withColumn("_bad_id", F.lit(3)).withColumn("_keep_id", F.lit(4)).withColumn("piece_ids", F.lit(5))
    null = odd.limit(1).select(*(F.lit(None).cast(t).alias(n) for n, t in odd.dtypes))
    for rows in (odd.union(null), odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert name == "encode" or out.columns == rows.columns
            assert out.count() <= rows.count()
