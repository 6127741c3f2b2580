"""Small tables with the cases that every operator defines, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rdfloom.llm import decontam, golay, linededup, lmscore, quality, simhash
from rdfloom.llm.components import components

DOCS = "doc_id long, text string, lang string, kept string, n_words int, _line_id int, fp int"
VOCAB = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n, lines=1):
    words = [rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n)]
    step = max(1, n // lines)
    return "\n".join(" ".join(words[i : i + step]) for i in range(0, n, step))


def docs(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, "x", 1, 2, 3) for i, t in zip(ids, texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \n\t ", "one", "a b c", "a b c", prose(rng, 200, 8), prose(rng, 80), "xxxx yyyy zzzz " * 60, "### $$$ " * 40 + prose(rng, 60), "\n".join(["same line here"] * 9 + [prose(rng, 60)])]
    base = prose(rng, 300, 12)
    words = base.split(" ")
    for k in range(6):
        w = list(words)
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return [*out, base, prose(rng, 20_000, 300), prose(rng, 200).upper(), "é ñ ü\u00a0ß " * 30]


def test_quality_measures(spark, texts):
    def want(t):
        t = t or ""
        w = t.split() if t.isascii() else [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        g = list(zip(w, w[1:], w[2:]))
        n = Counter(g)
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len({p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)})

    own = docs(spark, texts)
    out = quality.judge(own)
    assert out.columns[:7] == own.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i].measures) == want(t)
    failed = {i: r.failed_rule for i, r in got.items()}
    assert failed[6] is None and failed[0] is not None and failed[8] == "repeated_windows" and failed[9] in ("symbols", "repeated_windows")
    kept = quality.keep(own)
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == {i for i, f in failed.items() if f is None}
    assert quality.keep(own.limit(0)).count() == 0 and quality.keep(own.union(own)).count() == 2 * kept.count()


def test_quality_clash_path(spark):
    """Windows sorted as pairs give the same positions as packed keys."""
    words = F.split(F.lit(" ".join(random.Random(1).choice("ab") for _ in range(60))), " ")
    a, b = spark.range(1).select(F.sort_array(quality._repeated(words)), F.sort_array(quality._repeated_pairs(words))).first()
    assert a == b and len(a) > 20


def test_cascade_measures_only_what_it_needs(spark, texts):
    """The plan of keep holds the sort of the windows once for each of its two uses; the order changes no verdict."""
    own = docs(spark, texts)
    kept = {r.doc_id for r in quality.keep(own).collect()}
    plan = quality.keep(own)._jdf.queryExecution().executedPlan().toString()
    one = own.select(quality.n_repeat_words(quality.words_of(F.col("text"))).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sort_array") == one.count("sort_array")
    for rules in (quality.RULES[::-1], quality.RULES):
        t = F.coalesce("text", F.lit(""))
        failed = quality._let(quality.words_of(t), lambda w: F.coalesce(quality.cascade(t, quality.Unmeasured(t, w), rules), F.lit("")))  # noqa: B023
        assert {r.doc_id for r in own.where(failed == "").collect()} == kept
    found = {e.name: e for e in quality.estimate(own)}
    assert set(found) == {r.name for r in quality.RULES} and all(0 <= e.rejected <= 1 for e in found.values())
    assert found["too_few_words"].rejected == sum(len(quality_words(t)) < 50 for t in texts if len(t or "") <= quality.SAMPLE_CHARS) / sum(len(t or "") <= quality.SAMPLE_CHARS for t in texts)


def quality_words(t):
    return [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if x]


def test_quality_order_is_by_rejection_per_cost():
    found = [quality.Estimate(r.name, s, g) for r, s, g in zip(quality.RULES, range(1, 20), (0, 9, 1, 0, 0, 0, 7, 0, 0))]
    assert [r.name for r in quality.ordered(quality.RULES, found)[:2]] == [quality.RULES[1].name, quality.RULES[6].name]


def test_golay():
    words = np.arange(1 << 23, dtype=np.int32)[:: 4099]
    upper, _, _ = golay.tables()
    code = lambda i: (i << 11) | upper[i]
    assert all(np.bitwise_count(np.uint32(w ^ code(i))) <= 3 for w, i in zip(words, golay.decode(words)))
    rng = np.random.default_rng(0)
    for w in rng.integers(0, 1 << 23, 300):
        a, b = rng.integers(0, 23, 2)
        assert set(golay.nearby(np.array([w]))[0]) & set(golay.nearby(np.array([w ^ (1 << a) ^ (1 << b)]))[0])
    assert {len(set(r)) for r in golay.nearby(words[:500])} <= {1, 6}


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, ids, bits=4):
    label = dict(zip(ids, ids))
    again = True
    while again:
        again = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if bin(a ^ b).count("1") <= bits and label[i] < label[j]:
                    label[j] = label[i]
                    again = True
    return label


def test_simhash(spark, texts):
    own = docs(spark, texts)
    got = {r.doc_id: r for r in simhash.cluster(own).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    want = brute_components(fps, range(len(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(texts) - 3
    assert simhash.cluster(own.limit(0)).count() == 0 and simhash.representatives(own.limit(0)).count() == 0
    odd = docs(spark, ["q w e r t y u i o p", "q w e r t y u i o p"], [None, 5])
    assert [(r.doc_id, r.component_id) for r in simhash.cluster(odd).orderBy("doc_id").collect()] == [(None, 5), (5, 5)]


@pytest.mark.parametrize("bucket", [8, 2048])
def test_links_of_dense_groups(spark, bucket):
    """Groups of many near fingerprints, through small buckets (second pass) and large ones."""
    rng = random.Random(5)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.linked(rows, bucket=bucket)
    assert all(bin((r.a ^ r.b) & (1 << 64) - 1).count("1") > 0 for r in edges.collect())
    roots = {r.node: r.root for r in components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for x in signed:
        got[roots.get(x, x)].add(x)
    for x, l in brute_components([x & (1 << 64) - 1 for x in sorted(signed)], sorted(signed)).items():
        want[l].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7, 7), (None, 3), (2000, 2001), (2000, 2002), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == got[1000] == 1000 and got[2002] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        at = [(p, x.strip(" \t\r\x0b\x0c")) for p, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        n = [len(x.encode().split()) for _, x in at]
        gone = set()
        for k in range(len(at)):
            sizes = {3} if k + 3 <= len(at) else set()
            if n[k] >= 50:
                sizes.add(1)
            elif k + 1 < len(at) and n[k + 1] < 50 <= n[k] + n[k + 1]:
                sizes.add(2)
            for size in sizes:
                w = tuple(x for _, x in at[k : k + size])
                if w in seen:
                    gone |= {p for p, _ in at[k : k + size]}
                seen.add(w)
        out[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_long_passages_of_few_lines(spark):
    """A line of 50 words, and two lines that have as many together, go wherever they repeat; shorter ones stay."""
    rng = random.Random(12)
    line, half, other, short = prose(rng, 52), prose(rng, 26), prose(rng, 27), prose(rng, 30)
    own = [f"a\n{line}\nb", f"c\n  {line}\nd", line, f"{half}\n{other}", f"e\n{half}\n\n{other}\nf", f"{half}\ng", f"{short}\nh", f"{short}\ni", f"{line}\n{line}"]
    got = {r.doc_id: r.text for r in linededup.dedup(docs(spark, own)).collect()}
    assert got == brute_lines(enumerate(own))
    assert got[1] == "c\nd" and got[2] == "" and got[4] == "e\n\nf" and got[5] == own[5] and got[7] == own[7] and got[8] == ""


def test_line_dedup(spark, texts):
    shared = "first line\nsecond line\n\n  third line\nfourth"
    more = [*texts, f"intro\n{shared}\nend", f"{shared}\nother", "second line\nthird line\nfourth", "a\na\na\na\na", shared]
    own = docs(spark, more)
    out = linededup.dedup(own)
    assert out.columns[: len(own.columns)] == own.columns
    got, want = {r.doc_id: r.text for r in out.collect()}, brute_lines(enumerate(more))
    assert {i: t for i, t in got.items() if t is not None} == want and got[0] is None
    assert got[len(more) - 5] == more[-5] and got[len(more) - 4] == "\nother" and got[len(more) - 3] == "" and got[len(more) - 1] == ""
    assert linededup.dedup(own.limit(0)).count() == 0
    assert {r.text for r in linededup.dedup(docs(spark, [shared, shared], [None, 1])).collect()} == {shared}


def test_decontamination(spark):
    rng = random.Random(9)
    items = [prose(rng, n) for n in (60, 40, 25, 14, 8, 6)] + ["x y", "", None]
    items.append(items[0])
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    clean = [prose(rng, 300) for _ in range(6)]
    planted, want = [], {}
    for i in range(6):
        w = items[i].split()
        if len(w) > 20:
            for k in range(7, len(w), 9):  # a substitution every nine tokens
                w[k] = "other"
        planted.append(f"{prose(rng, 50)} {' '.join(w).upper()}, {prose(rng, 50)}")
        want[100 + i] = i
    part = f"{prose(rng, 30)} {' '.join(items[1].split()[10:26])} {prose(rng, 30)}"
    own = docs(spark, [*clean, None, "", *planted, part, prose(rng, 20_000) + " " + items[2]], [*range(8), *range(100, 106), 200, 300])
    found = {(r.doc_id, r.item_id): (r.start, r.end) for r in decontam.find(own, bench).collect()}
    assert {k for k, _ in found} == {*range(100, 106), 200, 300}
    assert all((d, i) in found for d, i in want.items()) and (200, 1) in found and (300, 2) in found and not any(i == 9 for _, i in found)
    assert found[100, 0][1] - found[100, 0][0] >= 55 and found[200, 1][1] - found[200, 1][0] >= 16
    left = decontam.clean(own, bench)
    assert left.columns == own.columns and {r.doc_id for r in left.collect()} == set(range(8))
    assert decontam.find(own, bench.limit(0)).count() == 0 and decontam.clean(own.limit(0), bench).count() == 0


def test_overlap_is_the_longest_stretch():
    rng = np.random.default_rng(2)
    for _ in range(60):
        doc, item = (rng.integers(0, 2, n).astype(np.uint64) for n in (40, 30))
        for d in range(-10, 20):
            best = 0
            lo, hi = max(0, d), min(40, 30 + d)
            for s in range(lo, hi):
                for e in range(s + 13, hi + 1):
                    same = doc[s:e] == item[s - d : e - d]
                    if same[-1] and same.mean() >= 0.8 - 1e-12:
                        best = max(best, e - s)
            a, b = decontam.overlap(doc, item, d)
            assert b - a == best


def brute_scores(texts, target, mu=50.0):
    """(words, score) of each text: both models counted without the text itself, the background scaled to the target's size."""
    seen = [[1, *lmscore.words(t), 2] if lmscore.words(t) else [] for t in texts]
    pair, word = [Counter(), Counter()], [Counter(), Counter()]
    for i, s in enumerate(seen):
        for m in (0, 1) if i in target else (0,):
            pair[m].update(zip(s, s[1:]))
            word[m].update(s[1:])
    n = [sum(w.values()) for w in word]
    ratio = n[1] / n[0] if n[0] else 0.0
    out = []
    for i, s in enumerate(seen):
        own, own_w, total = Counter(zip(s, s[1:])), Counter(s[1:]), 0.0
        for h, w in zip(s, s[1:]):
            p = []
            for m, scale in ((0, ratio), (1, 1.0)):
                mine = m == 0 or i in target
                context = 2 if h == 1 else h  # as many starts as ends
                c = [scale * (x[k] - mine * o[k]) for x, o, k in ((pair[m], own, (h, w)), (word[m], own_w, w), (word[m], own_w, context))]
                p.append((c[0] + mu * (c[1] + 1) / (n[1] + 1)) / (c[2] + mu))
            total += np.log(p[0] / p[1])
        out.append((max(0, len(s) - 2), total / (len(s) - 1) if s else 0.0))
    return out


@pytest.mark.parametrize(("head", "ranges"), [(0, 8192), (20, 0), (1 << 16, 8192)])
def test_lm_scores(spark, texts, head, ranges, monkeypatch):
    """Heads of any size, and targets as bitmaps or joined, give the same scores."""
    monkeypatch.setattr(lmscore, "RANGES", ranges)
    rng = random.Random(4)
    own = [*texts, *(prose(rng, 120) for _ in range(8)), "alpha1 beta2 alpha1 beta2 " * 50]
    own += [own[-2]]  # a copy: each is known from the other
    target = [6, 7, 12, 13]
    given = spark.createDataFrame([(str(i),) for i in [*target, None, "x"]], "doc_id string")
    got = {r.doc_id: r for r in lmscore.score(docs(spark, own), given, head=head).collect()}
    want = brute_scores(own, target)
    assert len(got) == len(own)
    for i, (n, s) in enumerate(want):
        assert got[i].n_tokens == n and abs(got[i].score - s) < 1e-9


def test_lm_scores_of_odd_tables(spark, texts):
    own = docs(spark, texts)
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(own.limit(0), none).count() == 0
    assert {r.score for r in lmscore.score(own, none).collect()} == {0.0}
    rows = docs(spark, ["a b c", "a b d", "a b c", "x y"], [1, 1, None, 2])
    got = {r.doc_id: r for r in lmscore.score(rows, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    want = brute_scores(["a b c", "a b d", "a b c", "x y"], [3])
    assert set(got) == {1, 2} and got[1].n_tokens == 6 and abs(got[1].score - (want[0][1] + want[1][1]) / 2) < 1e-9 and abs(got[2].score - want[3][1]) < 1e-9
