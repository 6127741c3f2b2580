"""The vocabulary of the LM scores follows the corpus."""

from test_text_operators import brute_scores

from rdfloom.llm import lmscore


def test_every_word_is_in_the_vocabulary(spark):
    """20,000 words, all of two occurrences: documents differ in rare words only, and a copy tells a document apart."""
    texts = [" ".join(f"w{i}x{k}" for i in range(100)) for k in range(200)] * 2 + [" ".join(f"u{i}x{k}" for i in range(100)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lmscore.score(docs, spark.createDataFrame([(3,), (410,)], "doc_id long")).collect()}
    want = brute_scores(texts, [3, 410])
    assert all(abs(got[i] - s) < 1e-9 for i, (_, s) in enumerate(want))
    once, twice = [got[i] for i in range(400, 420)], [got[i] for i in range(400) if i not in (3, 203)]
    assert max(once) < min(twice) and got[203] < min(once)


def test_rows_without_an_id_only(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, None)], "doc_id long, text string")
    assert lmscore.score(docs, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
