"""The labeller reads all of a block."""

from rdfloom.llm.html_extract import _hash, blocks, features


def test_all_words_of_attributes_and_text_count():
    page = '<div class="col-md-4 col-sm-12 mt-3 px-2 sidebar widget-area" id="secondary" role="complementary">' + "word " * 60 + "ending</div>"
    tags, words, _ = features(blocks(page)[0], 0.0)
    assert {_hash(f"c:{w}") for w in ("sidebar", "widget", "secondary", "12")} <= set(tags)
    assert len(words) == 61 and words[-1] == _hash("w:ending")


def test_punctuation_is_of_the_whole_text():
    start, rest = "a" * 400, "b, c. " * 100
    plain = [features((t, (), 0.0), 0.0)[2][2] for t in (start, start + rest)]
    assert plain[0] == 0 and plain[1] > 0.5


def test_a_page_of_100000_blocks_in_bounded_memory():
    import resource
    import subprocess
    import sys

    code = """
import resource
from rdfloom.llm import html_extract
m = html_extract.Labeller(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
page = "<article>" + "<p>One short paragraph of it.</p>" * 100_000 + "</article>"
assert len(m.predict([html_extract.page_features(html_extract.blocks(page))])[0]) == 100_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True)
    assert int(out.stdout) < 500 and resource


def test_white_space_and_fallbacks():
    from rdfloom.llm.html_extract import blocks

    found = [b[0] for b in blocks("<p>a\u2003\u2009b\u00a0 c<math><mi>x</mi></math> d</p><noscript>Turn it on</noscript><p>e</p>")]
    assert found == ["a b cx d", "Turn it on", "e"]
