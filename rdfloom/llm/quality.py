"""Quality rules as a short-circuit cascade of native column expressions.

A rule is a boolean column that is true where a text is rejected, over measures of
the text. Cost (seconds, its measures included) and selectivity (share rejected) of
each rule are estimated on a bounded sample; rules are then ordered by rejection per
cost and compiled into one nested CASE, so that a row stops at its first failure and
what only later rules need is never measured. Where all measures are asked for beside
the verdict (judge), the rules cost what is left. The verdict is the conjunction of
all rules, so that the order, which depends on measured times, never changes a result.

Defined cases: a null text is a text without words; it fails the length rule.
Repeated rows are judged alike, one output row per input row. Columns of the
input are kept as they are, whatever their names. An empty table gives an
empty result, with the rules in their declared order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rdfloom.llm.common import SPACES, WORD, free_name

SYMBOLS = "#*$%&|<>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once (an inlined column would be computed again inside each lambda)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    text = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, r"[\x20\x09-\x0D]+"))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{SYMBOLS}]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


#: Low bits of a packed window key that hold its position.
POSITION = (1 << 24) - 1


def _window(words: Column, i: Column) -> Column:
    return F.xxhash64(words[i], words[i + 1], words[i + 2])


def _repeated_pairs(words: Column) -> Column:
    """Positions of repeated windows: sort (hash, position), equal neighbours are repeated."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(_window(words, i).alias("h"), i.alias("i"))))
    same = lambda w: lambda x, j: (x["h"] == F.get(w, j - 1)["h"]) | (x["h"] == F.get(w, j + 1)["h"])
    return _let(pairs, lambda w: F.transform(F.filter(w, same(w)), lambda x: x["i"]))


def _repeated(words: Column) -> Column:
    """The same by sorting plain longs: 40 bits of the hash above 24 bits of position.

    Neighbours with equal upper bits are candidates. Where two of them differ in
    the whole hash, or the text is too long for the position bits, the pairs are
    sorted instead, so that the result is always that of the whole hashes.
    """
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: _window(words, i).bitwiseAND(F.lit(~POSITION)).bitwiseOR(i)))
    at = lambda x: x.bitwiseAND(F.lit(POSITION)).cast("int")

    def of(w: Column) -> Column:
        beside = F.filter(F.sequence(F.lit(0), F.size(w) - 2), lambda j: F.shiftrightunsigned(w[j].bitwiseXOR(w[j + 1]), 24) == 0)
        clash = lambda c: F.exists(c, lambda j: _window(words, at(w[j])) != _window(words, at(w[j + 1])))
        both = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda j: F.array(at(w[j]), at(w[j + 1])))))
        return _let(beside, lambda c: F.when(clash(c), _repeated_pairs(words)).otherwise(both(c)))

    return F.when(F.size(words) <= POSITION, _let(packed, of)).otherwise(_repeated_pairs(words))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, O(n log n) in the text."""

    def covered(at: Column) -> Column:
        step = lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))
        return F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda s, x: s + x)

    # fewer than two windows: nothing can repeat
    return F.when(F.size(words) >= 4, _let(F.sort_array(_repeated(words)), covered)).otherwise(F.lit(0).cast("long"))


#: Measures that the contract names, each of the text and its words.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: n_symbols(t),
    "n_dup_lines": lambda t, w: n_dup_lines(t),
    "n_repeat_words": lambda t, w: n_repeat_words(w),
}


def measures(text: Column) -> Column:
    """Struct of all measures (long)."""
    return _let(words_of(text), lambda w: F.struct(*(f(text, w).alias(n) for n, f in MEASURES.items())))


class Unmeasured:
    """Measures by name that are computed where a rule asks for them, and not before."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    def __getitem__(self, name: str) -> Column:
        return MEASURES[name](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """rejects(text, measures by name) is true where the text goes."""

    name: str
    rejects: Callable[[Column, Column | Unmeasured], Column]


#: Rules that the contract names.
BASE = (
    Rule("too_few_words", lambda t, m: m["n_words"] < 50),
    Rule("repeated_windows", lambda t, m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (
    *BASE,
    Rule("symbols", lambda t, m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", lambda t, m: (2 * m["word_chars"] < 5 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    Rule("duplicate_lines", lambda t, m: _let(m["n_dup_lines"], lambda n: (n > 3) & (10 * n > 3 * F.size(F.split(t, "\n"))))),
    Rule("shouting", lambda t, m: 2 * F.regexp_count(t, F.lit(r"\p{Lu}")) > m["word_chars"]),
    Rule("few_letters", lambda t, m: 10 * F.regexp_count(t, F.lit(r"[!-@\[-`{-~]")) > 4 * m["word_chars"]),
    Rule("ellipses", lambda t, m: 10 * F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(\.\.\.|…)\s*$"))) > 3 * F.size(F.split(t, "\n"))),
    Rule("bullets", lambda t, m: 10 * F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"^\s*[-•*‣]"))) > 9 * F.size(F.split(t, "\n"))),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


#: Rows of the sample are repeated so often, that a rule's time stands out from that of a job.
REPEATS = 8
#: Characters of the longest text that is taken into the sample.
SAMPLE_CHARS = 100_000


def estimate(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, measured: bool = False) -> list[Estimate]:
    """Cost and selectivity of each rule on at most sample_rows rows (they order the rules and decide nothing else).

    A rule's cost holds that of its measures, unless these are there already
    (measured); the time of a job that does nothing is taken off. The sample comes
    from as few partitions as have enough rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(t.alias("t")).where(F.length("t") <= SAMPLE_CHARS).take(sample_rows)
    if not rows:
        return [Estimate(r.name, 0.0, 0.0) for r in rules]
    sample = docs.sparkSession.createDataFrame(rows, "t string").coalesce(1).select("t", words_of(F.col("t")).alias("w"), measures(F.col("t")).alias("m"))
    sample = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("i")).persist()
    n = sample.count()
    known = F.col("m") if measured else Unmeasured(F.col("t"), F.col("w"))

    def took(condition: Column) -> tuple[float, int]:
        began = time.perf_counter()
        gone = sample.agg(F.count_if(condition & (F.col("i") > 0)).alias("n")).first().n
        return time.perf_counter() - began, gone

    try:
        idle = min(took(F.col("t").isNull())[0] for _ in range(3))
        out = []
        for r in rules:
            found = [took(r.rejects(F.col("t"), known)) for _ in range(2)]  # the first compiles
            out.append(Estimate(r.name, max(1e-6, min(x for x, _ in found) - idle), found[0][1] / n))
        return out
    finally:
        sample.unpersist()


def ordered(rules: tuple[Rule, ...], found: list[Estimate]) -> tuple[Rule, ...]:
    gain = {e.name: e.gain for e in found}
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def cascade(text: Column, m: Column | Unmeasured, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects, null where none does; later rules, and the measures that only they ask for, aren't evaluated."""
    out, text = F.lit(None).cast("string"), F.coalesce(text, F.lit(""))
    for r in reversed(rules):
        out = F.when(r.rejects(text, m), F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512, measured: str = "measures", verdict: str = "failed_rule") -> DataFrame:
    """docs with a struct of all measures and the failed rule (null: kept) under names that docs doesn't have."""
    measured, verdict = free_name(docs, measured), free_name(docs, verdict)
    rules = ordered(rules, estimate(docs, text, rules, sample_rows, measured=True))
    out = docs.withColumn(measured, measures(docs[text]))
    return out.withColumn(verdict, cascade(out[text], out[measured], rules))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 512) -> DataFrame:
    """The rows that no rule rejects, with the columns of docs. Nothing is measured before a rule asks for it."""
    rules = ordered(rules, estimate(docs, text, rules, sample_rows))
    t = F.coalesce(F.col(text), F.lit(""))
    failed = _let(words_of(t), lambda w: F.coalesce(cascade(t, Unmeasured(t, w), rules), F.lit("")))
    return docs.where(failed == "")
