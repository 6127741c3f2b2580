import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rdfloom.llm import html_extract, toxicity, urls, warc
from rdfloom.llm import sentencepiece_codec as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    with open(MODEL, "rb") as f:
        return sp.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=str(MODEL))


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab etshin  \t\n01é😀.,ß東'()ÀThe", max_size=60))
def test_encoding_is_the_librarys(codec, library, text):
    ids = list(codec.encode(text))
    assert ids == library.encode(text) and codec.decode(ids) == text


def test_encoding_of_words_and_runs(codec, library):
    for t in ["", " ", " " * 50, "internationalization of tokenizers", "aaaaaaaaaaaaaaaa" * 5, "0123456789 3.14", "x" * 3000, "naïve café", "\x00\x7f", "\U0010ffff"]:
        assert list(codec.encode(t)) == library.encode(t) and codec.decode(codec.encode(t)) == t
    assert len(codec.encode(None)) == 0


def test_unknown_characters_leave_the_automaton_to_the_rest(codec, library, monkeypatch):
    """Chunks with characters that are no piece are cut there; merging by definition isn't used."""
    assert codec.closed
    codec._words.clear()
    codec._words.old = {}
    seen = []
    monkeypatch.setattr(codec, "_ranked", lambda t, f=codec._ranked: seen.append(t) or f(t))
    for t in ["caf\u4e16\u754ce world", "\u4e16", "the\U0001f600the \U0001f600\U0001f600", "a\u4e16" * 400]:
        assert list(codec.encode(t)) == library.encode(t)
    assert seen and all(codec.chars.issuperset(x) for x in seen)


def test_unigram_path():
    """The same automaton with summed scores, against all segmentations."""

    def message(*parts):
        return b"".join(parts)

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(n, data):
        return varint(n << 3 | 2) + varint(len(data)) + data

    import struct

    scores = {"<unk>": 0.0, "▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.1, "▁a": -3.3, "bab": -4.0, "ba": -4.6}
    pieces = [field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + varint(3 << 3) + varint(2 if p == "<unk>" else 1)) for p, s in scores.items()]
    c = sp.Codec(message(*pieces, field(2, varint(3 << 3) + varint(1)), field(3, varint(4 << 3) + varint(0))))

    def best(t):
        if not t:
            return 0.0, []
        return max(((s + scores[p], [*rest, p]) for p in scores if p != "<unk>" and t.endswith(p) for s, rest in [best(t[: -len(p)])]), key=lambda x: x[0])

    names = list(scores)
    rng = random.Random(0)
    for _ in range(50):
        t = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        got = [names[i] for i in c.encode(t)]
        assert "".join(got) == "▁" + t and abs(sum(scores[p] for p in got) - best("▁" + t)[0]) < 1e-5
    assert c.encode("aXb").tolist().count(0) == 1


def test_encoding_of_a_table(spark, library):
    rows = spark.createDataFrame([(1, "one two", "k"), (1, "one two", "k"), (2, None, None), (3, "", "x"), (4, "long " * 20_000, "y")], "doc_id long, text string, piece_ids string")
    out = sp.decode(sp.encode(rows), "_piece_ids").collect()
    assert sorted(r.doc_id for r in out) == [1, 1, 2, 3, 4]
    for r in out:
        assert list(r._piece_ids) == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert sp.encode(rows.limit(0)).count() == 0


RULES = tuple(urls.Rule.of(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")))


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u[u.index("://") + 3 :]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_url_rules(spark):
    rng = random.Random(2)
    own = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7x?q#f", "http://notexample.com/en/7", "https://a.net/de/8", "http://example.net/de/8?x", "http://x.org?/es/", "a://b://c/d", "http://ÄX.org/es/\nx#y", "http://com/en/", "x://com/en"]
    own += [f"http://{rng.choice(['www.', '', 'm.'])}{rng.choice(['site', 'casino', 'pills'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(900)}" for _ in range(200)]
    rows = spark.createDataFrame([(i, u, 1) for i, u in enumerate([*own, own[4]])], "page_id long, url string, host int")
    got = urls.judge(rows, RULES).collect()
    assert len(got) == len(own) + 1
    for r in got:
        host, path, rule = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule.text if rule else None)
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block") and (r.score is None) == (rule is not None)
    assert urls.judge(rows.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge(rows, ()).collect()} == {"allow"}


def test_verdicts_of_urls_without_a_rule(spark):
    """The query's scores and verdicts against models counted here, from the same sample."""
    rng = random.Random(6)
    hosts = ["a.com/en", "b.net/de", "c.org/es", "d.example.com/en/7", "e.info/x", "f.biz/win"]
    own = sorted({f"http://{rng.choice(hosts)}/{rng.choice(['news', 'casino', 'post'])}{rng.randrange(400)}" for _ in range(600)})
    rows = spark.createDataFrame([(i, u) for i, u in enumerate([*own, *own[:200]])], "page_id long, url string")
    named = {u: brute_url(u)[2] for u in own}
    from pyspark.sql import functions as F

    order = {r.url: r.k for r in rows.select("url", F.xxhash64("url", F.lit("sample")).alias("k")).collect()}
    sample = [sorted((u for u in own if named[u] and named[u].verdict == v), key=lambda u: (order[u], u)) for v in ("allow", "block")]

    def model(texts):
        count = {}
        for t in texts:
            t = "\x02" * urls.ORDER + t + "\x03"
            for i in range(urls.ORDER, len(t)):
                for k in range(urls.ORDER + 1):
                    at = count.setdefault(t[i - k : i], {})
                    at[t[i]] = at.get(t[i], 0) + 1

        def p(context, char):
            lower = p(context[1:], char) if context else 1 / 0x11000
            seen = count.get(context)
            return lower if seen is None else (seen.get(char, 0) + len(seen) * lower) / (sum(seen.values()) + len(seen))

        import math

        def loss(t):
            t = "\x02" * urls.ORDER + t + "\x03"
            return sum(math.log(p(t[i - urls.ORDER : i], t[i])) for i in range(urls.ORDER, len(t)))

        return loss

    good, bad = model([u for i, u in enumerate(sample[0]) if i % 5]), model(sample[1])
    score = lambda u: (bad(u) - good(u)) / (len(u) + 1)
    import numpy as np

    threshold = max(0.0, float(np.quantile([score(u) for u in sample[0][::5]], 0.99)))
    for r in urls.judge(rows, RULES).collect():
        if not named[r.url]:
            assert abs(r.score - score(r.url)) < 1e-9 and r.verdict == ("block" if r.score > threshold else "allow")


def test_models_count_every_url(spark, monkeypatch):
    """More different urls of each verdict than the 5,000 that models were once trained on, and scores by frequent and by rare grams."""
    monkeypatch.setattr(urls, "HEAD", 256)
    rng = random.Random(7)
    good = sorted({f"http://a.net/de/{rng.choice(['news', 'é東😀', 'post'])}{rng.randrange(10**7)}" for _ in range(6000)})
    bad = sorted({f"http://b.org/es/{rng.choice(['win', 'casino', 'post'])}{rng.randrange(10**7)}" for _ in range(6000)})
    rest = [f"http://c.info/{rng.choice(['casino', 'é東', 'post', 'ß'])}{rng.randrange(10**7)}" for _ in range(150)]
    rest += ["http://c.info/" + "".join(rng.choice("casino東4") for _ in range(n)) for n in (59, 60, 4095, 9000)]
    rows = spark.createDataFrame(list(enumerate([*good, *bad, *rest, *good[:50], rest[0], "", None])), "page_id long, url string")
    from pyspark.sql import functions as F

    order = {r.url: (r.k, r.url) for r in rows.select("url", F.xxhash64("url", F.lit("sample")).alias("k")).collect()}
    m = urls.Ratio(sorted(good, key=order.get), bad)
    got = urls.judge(rows, RULES).collect()
    assert sorted(r.key for r in got) == list(range(rows.count()))
    for r in got:
        if brute_url(r.url)[2] is None:
            assert abs(r.score - m.score(r.url)) < 1e-9 and r.verdict == m.verdict(m.score(r.url))


@settings(max_examples=8, deadline=None)
@given(own=st.lists(st.sampled_from([-2.5, 0.0, 1e-300, 1.0, 1.0000000000000002, 7e9]) | st.floats(-1, 1), min_size=1, max_size=40), q=st.sampled_from([0.0, 0.5, 0.99, 1.0]))
def test_quantile(spark, own, q):
    import numpy as np

    assert np.isclose(urls.quantile(spark.createDataFrame([(v,) for v in own], "v double"), q), np.quantile(own, q), rtol=1e-12, atol=1e-12)


def test_markov_ratio():
    good, bad = [f"blog.site{i}.org/post/{i}" for i in range(200)], [f"casino-win{i}.biz/bonus?ref={i}" for i in range(200)]
    m = urls.Ratio(good, bad)
    assert m.score("casino-win999.biz/bonus?ref=5") > m.threshold > m.score("blog.site777.org/post/3")
    k = urls.Markov(["ab", "abc"], 2)
    assert abs(sum(k._p("\x02a", chr(c)) for c in range(0x11000)) - 1) < 1e-6


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/x?y", "same"), (2, "http://b/", "same"), (3, "http://c/\r\nX: y", "WARC/1.1\r\n\r\n WARC-Type: response\r\n\r\n"), (4, None, None), (5, "u", ""), (6, "http://é/", "é" * 5000), (7, "http://big/", "z" * 3_000_000), (2, "http://b/", "same"), (None, "http://n/", "gone")]
    rows = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, name string")
    at = str(tmp_path / "w")
    warc.write(rows, at)
    records = warc.read(spark, at)
    assert records.groupBy("type").count().count() == 4 and records.count() == 3 * 8
    got = warc.transactions(records).collect()
    assert len(got) == 8 and all(r.request is not None and r.metadata is not None for r in got)
    own = {}
    for r in got:
        key = int(r.metadata.block.decode().split("capture-key: ")[1].split("\r")[0])
        own.setdefault(key, []).append(r)
    body = lambda r: bytes(r.response.block).partition(b"\r\n\r\n")[2]
    for key, _, html in pages[:7]:
        r = own[key][0]
        assert r.response.digest == "sha1:" + warc.digest((html or "").encode())
        if r.response.type == "response":
            assert body(r) == (html or "").encode()
    kinds = {k: sorted(r.response.type for r in v) for k, v in own.items()}
    assert kinds == {1: ["revisit"], 2: ["response", "revisit"], 3: ["response"], 4: ["revisit"], 5: ["response"], 6: ["response"], 7: ["response"]}
    named = {r.record_id for r in got if r.response.type == "response"}
    assert all(r.response.refers_to in named for r in got if r.response.type == "revisit")
    plain = warc.roundtrip(rows, min_bytes=5)
    assert plain.where("response.type = 'revisit'").count() == 0
    assert warc.roundtrip(rows.limit(0)).count() == 0


def test_warc_parse_gzip_members():
    import gzip

    one = warc.record("resource", "<a>", b"x\r\n\r\ny", "text/plain") + warc.END
    two = warc.record("resource", "<b>", b"", "text/plain") + warc.END
    got = list(warc.parse(gzip.compress(one) + gzip.compress(two)))
    assert [b for _, b in got] == [b"x\r\n\r\ny", b""] and list(warc.parse(b"")) == [] and [b for _, b in warc.parse(one + two)] == [b"x\r\n\r\ny", b""]


@pytest.fixture(scope="module")
def toxic():
    rng = random.Random(7)
    fine, foul = [f"word{i}" for i in range(400)], ["idiotic", "moronic", "trashy", "loweick", "loweiun", "loweient"]
    texts, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(fine) for _ in range(9)) for _ in range(rng.randrange(1, 30))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                k = rng.randrange(len(sentences))
                sentences[k] += " " + rng.choice(foul)
        texts.append(". ".join(sentences) + ".")
        labels.append(int(bad))
    return texts, labels


def test_training_rows_of_repeated_ids(spark):
    """The same rows every time, however the tables are dealt."""
    docs = spark.createDataFrame([(i % 40, f"text {i} of many") for i in range(400)], "doc_id long, text string")
    named = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    once, again = (toxicity.training_rows(docs.repartition(n), named.repartition(n), max_rows=10) for n in (1, 7))
    assert once == again and len(once) == 20 and sum(r.y for r in once) == 10


def test_toxicity_learns_and_locates(toxic):
    texts, labels = toxic
    m = toxicity.fit(texts[:450], labels[:450])
    scores = [m.score(t) for t in texts[450:]]
    right = sum((s >= 0.7) == bool(y) for s, y in zip(scores, labels[450:])) / 150
    assert right > 0.97
    found = m.offending("word1 word2 word3. You are idiotic and trashy! word4 word5.")
    assert len(found) == 1 and found[0][:2] == (18, 46)
    assert m.score(None) == m.score("") == pytest.approx(toxicity.LEAK) and 0 <= min(scores) and max(scores) <= 1
    assert toxicity.fit(texts[:5], [0] * 5).score("anything") == toxicity.LEAK and toxicity.fit([], []).score("x") == toxicity.LEAK


def test_toxicity_of_a_table(spark, toxic):
    texts, labels = toxic
    docs = spark.createDataFrame([*((i, t, "c") for i, t in enumerate(texts)), (900, None, None), (901, "", "x"), (0, texts[0], "c"), (None, "x y", "z")], "doc_id long, text string, score string")
    named = spark.createDataFrame([*((i, y) for i, y in enumerate(labels)), (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, named, max_rows=100)
    assert len(rows) in (199, 200) and sum(not r.y for r in rows) == 100  # a label without a text may be drawn
    m = toxicity.fit([r.t for r in rows], [r.y for r in rows])
    out = toxicity.score(docs, m).collect()
    assert len(out) == len(texts) + 4 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), m).count() == 0 and toxicity.training_rows(docs, named.limit(0)) == []


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:'</p>'}</style><script>var a="<p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav><div class="cookie-notice"><p>We use cookies to improve your visit. <button>Accept</button></p></div>
<article><h1>The  title &eacute;</h1><p>First paragraph of the article, with <b>bold</b> words and a line<br>break.<p>Second&nbsp;one &lt;here&gt; has more words, and it ends well.</p><div class="advert">Buy now, cheap offer for everyone today.</div><p>The third paragraph closes the story for the reader.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Something else entirely.</p></aside><section class="comments"><p>Great post, thanks.</p></section><form><label>Search</label></form><footer>&copy; 2020 Site &middot; all rights</footer></body></html>"""


def test_blocks():
    found = [b[0] for b in html_extract.blocks(PAGE)]
    assert "First paragraph of the article, with bold words and a line break." in found and "The title é" in found and "Home" in found
    assert not any("var a" in b or "x:" in b or "T &" in b for b in found)
    assert html_extract.blocks(None) == html_extract.blocks("") == [] and [b[0] for b in html_extract.blocks("plain text")] == ["plain text"]
    assert [b[0] for b in html_extract.blocks("<p>a &am")] == ["a &am"] and [b[0] for b in html_extract.blocks("<p>a<p>b</arti")] == ["a", "b"]
    assert [b[0] for b in html_extract.blocks("<div>a<!-- <p>no</p> --> b<script>x")] == ["a b"]


def test_gradient():
    """Backward pass against finite differences."""
    import numpy as np

    m = html_extract.Labeller(1)
    pages, labels = html_extract.Pages(3).labelled(3)

    def loss():
        p = m._forward(pages)[-1]
        return sum(-np.log(np.where(np.array(y) == 1, p[: len(y), c], 1 - p[: len(y), c])).sum() for c, y in enumerate(labels)) / sum(map(len, labels))

    seen = {}

    class Stop(Exception):
        pass

    n, x, xb, turn, cols, tf, tb, both, p = m._forward(pages)
    y, on = np.zeros_like(p), np.arange(len(x))[:, None] < n
    for c, k in enumerate(labels):
        y[: n[c], c] = k
    dz = np.where(on, p - y, 0) / on.sum()
    grad = {k: np.zeros_like(v) for k, v in m.w.items()}
    d = dz[:, :, None] * m.w["out"]
    H = html_extract.HIDDEN
    m._back(x, d[:, :, :H], tf, "f", grad)
    m._back(xb, d[:, :, H:][turn, cols], tb, "b", grad)
    rng = np.random.default_rng(0)
    for name in ("xf", "hf", "cf", "xb", "hb"):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in m.w[name].shape)
            m.w[name][at] += 1e-5
            up = loss()
            m.w[name][at] -= 2e-5
            down = loss()
            m.w[name][at] += 1e-5
            seen[name, at] = (up - down) / 2e-5
            assert abs(seen[name, at] - grad[name][at]) < 1e-6


def test_extraction(spark):
    m = html_extract.default_model()
    pages, labels = html_extract.Pages(123).labelled(120)
    right = sum((a >= 0.5) == b for p, y in zip(m.predict(pages), labels) for a, b in zip(p, y)) / sum(map(len, labels))
    assert right > 0.97
    rows = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", ""), (1, "u", PAGE), (4, "x", "<article>" + "<p>One paragraph of this very long article.</p>" * 3000 + "</article>")], "page_id long, text string, html string")
    out = {r.page_id: r._text for r in html_extract.extract(rows, m).collect()}
    assert {r.text for r in html_extract.extract(rows, m).collect()} == {"u", "v", "w", "x"}
    assert html_extract.extract(rows, m).count() == 5 and out[2] == out[3] == ""
    lines = out[1].split("\n")
    assert "The third paragraph closes the story for the reader." in lines and "Second one <here> has more words, and it ends well." in [x.replace("\u00a0", " ") for x in lines]
    assert not any(x in out[1] for x in ("Home", "cookies", "Great post", "©", "Search", "Something else"))
    assert len(out[4].split("\n")) > 2900 and html_extract.extract(rows.limit(0), m).count() == 0
