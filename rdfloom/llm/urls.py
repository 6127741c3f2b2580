"""URL filters: rules on host and path, and character language models for the rest.

A rule names a host and a path; it fits that host and all subdomains where the
url's path starts with its own, and the longest fitting rule decides. Urls without
a rule are judged by two variable-order Markov models over characters, one of
accepted and one of rejected urls (orders 0 to ORDER, each mixed with the next
lower by Witten-Bell smoothing): the difference of log-likelihoods divided by the
length is held against a threshold, which is calibrated so that at most MAX_LOSS of
the accepted urls kept aside for it would be rejected.

The models count every different url that rules decide: each once, all rejected ones,
and of the accepted ones, in the order of a hash of the url, four of five; every fifth
is kept aside, and all of those calibrate the threshold. Nothing is sampled, and no
model is held in one process: texts are cut into grams of ORDER + 1 characters, which
are counted; the counts of shorter ones are their sums by suffix, from order to order,
and the probabilities of the grams that urls to be judged have go the other way. Scores
are sums over a url's grams: at most HEAD frequent grams are broadcast, others are joined.
Logarithms are summed as decimals of twelve places, which no order of rows changes.

Defined cases: a null url, or one without ://, has an empty host and path, fits no
rule and scores as an empty text (0: accepted). If no rule accepts or none rejects,
there is nothing to learn and the rest is accepted. Repeated rows are judged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rdfloom.llm.common import cut

ORDER = 5
MAX_LOSS = 0.01
#: A gram with more than one in HEAD of all occurrences is broadcast: there can't be more than HEAD of them.
HEAD = 1 << 16
#: Bits of a url's hash by which accepted urls are dealt to be numbered, and bins of a step of quantile.
BUCKETS, BINS = 12, 1024
#: Texts are cut by these steps, one after the other, as finding a character takes time in proportion to its position.
STEPS = (4096, 64, 1)
UNSEEN = 1 / 0x11000
MODELS = ("accepted", "rejected")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"\A[^/?#]*([^?#]*)", 1)


def decide(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict), null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


class Markov:
    """Variable-order Markov model of texts in one process; contexts are kept as they occur."""

    def __init__(self, texts: list[str], order: int = ORDER):
        self.order = order
        self.next: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for t in texts:
            t = "\x02" * order + t + "\x03"
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.next[t[i - k : i]][t[i]] += 1
        self.next = {c: dict(n) for c, n in self.next.items()}
        self.total = {c: sum(n.values()) for c, n in self.next.items()}
        self._logs: dict[str, float] = {}

    def _p(self, context: str, char: str) -> float:
        p = UNSEEN
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            seen = self.next.get(c)
            if seen is None:
                break
            kinds = len(seen)
            p = (seen.get(char, 0) + kinds * p) / (self.total[c] + kinds)
        return p

    def log(self, gram: str) -> float:
        """log P of the last character after the others."""
        out = self._logs.get(gram)
        if out is None:
            if len(self._logs) >= 1_000_000:
                self._logs.clear()
            out = self._logs[gram] = math.log(self._p(gram[:-1], gram[-1]))
        return out

    def log_likelihood(self, text: str) -> float:
        t, n = "\x02" * self.order + text + "\x03", self.order + 1
        return sum(self.log(t[i - n : i]) for i in range(n, len(t) + 1))


class Ratio:
    """Length-normalised log-likelihood ratio of rejected over accepted, and its threshold, for lists; judge does the same for tables."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER, max_loss: float = MAX_LOSS):
        self.trained = bool(accepted) and bool(rejected)
        self.threshold = math.inf
        if self.trained:
            aside = accepted[::5]  # every fifth is kept aside for calibration
            self.accepted = Markov([u for i, u in enumerate(accepted) if i % 5] or accepted, order)
            self.rejected = Markov(rejected, order)
            self.threshold = max(0.0, float(np.quantile([self.score(u) for u in aside], 1 - max_loss)))

    def score(self, url: str | None) -> float:
        if not self.trained or not url:
            return 0.0
        return (self.rejected.log_likelihood(url) - self.accepted.log_likelihood(url)) / (len(url) + 1)

    def verdict(self, score: float) -> str:
        return "block" if score > self.threshold else "allow"


def grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """A row for each character of url and its end, with gram: that character after the order ones before it."""
    out = texts.withColumn("gram", F.concat(F.lit("\x02" * order), "url", F.lit("\x03"))).drop("url")
    for step in STEPS:
        out = out.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("gram") - (order + 1), F.lit(step))))
        out = out.withColumn("gram", F.substring("gram", F.col("at") + 1, F.lit(step + order))).drop("at")
    return out


def parts(judged: DataFrame) -> DataFrame | None:
    """judged: url and verdict (by rule). (id, url, accepted, rejected, needed, aside) of each different url; None if one verdict has none.

    accepted and rejected: whether that model counts the url; needed: whether it must be scored; aside: whether that is for the threshold.
    """
    own = cut(judged.where("url is not null").distinct().withColumns({"id": F.monotonically_increasing_id(), "k": F.xxhash64("url", F.lit("sample"))}))
    own = own.withColumn("bucket", F.when(F.col("verdict") == "allow", F.shiftright("k", 64 - BUCKETS)))
    counts = {(r.verdict, r.bucket): r["count"] for r in own.where("verdict is not null").groupBy("verdict", "bucket").count().collect()}
    buckets = sorted(b for v, b in counts if v == "allow")
    before = list(accumulate((counts["allow", b] for b in buckets), initial=0))
    if not buckets or ("block", None) not in counts:
        return None
    first = own.sparkSession.createDataFrame(list(zip(buckets, before)), "bucket long, before long")
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("k", "url")) - 1 + F.col("before")
    aside = rank % 5 == 0  # every fifth is kept aside for calibration
    good = own.where("verdict = 'allow'").join(F.broadcast(first), "bucket")
    good = good.select("id", "url", (~aside | F.lit(before[-1] == 1)).alias("accepted"), F.lit(False).alias("rejected"), aside.alias("needed"), aside.alias("aside"))
    rest = own.where("verdict is null or verdict <> 'allow'")
    rest = rest.select("id", "url", F.lit(False).alias("accepted"), F.col("verdict").isNotNull().alias("rejected"), F.col("verdict").isNull().alias("needed"), F.lit(False).alias("aside"))
    return cut(good.union(rest))


def log_ratios(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, needed, log): log P(rejected) - log P(accepted) of each gram that needed urls have, and how often they have it."""
    sums = [F.sum(c).alias(c) for c in (*MODELS, "needed")]
    own = grams(texts.select("url", *(F.col(c).cast("long").alias(c) for c in (*MODELS, "needed"))), order)
    counts = [cut(own.groupBy("gram").agg(*sums))]
    for k in range(order - 1, -1, -1):
        counts.insert(0, cut(counts[0].groupBy(F.substring("gram", 2, k + 1).alias("gram")).agg(*sums)))
    out = None
    for k, rows in enumerate(counts):
        context = Window.partitionBy(F.substring("gram", 1, k))
        of = {f"{m}_total": F.sum(m).over(context) for m in MODELS} | {f"{m}_kinds": F.sum(F.sign(m)).over(context) for m in MODELS}
        rows = rows.withColumns(of).where("needed > 0")
        if out is None:
            rows = rows.withColumns({f"p_{m}": F.lit(UNSEEN) for m in MODELS})
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, k)).join(out.withColumnRenamed("gram", "shorter"), "shorter")
        new = {}
        for m in MODELS:
            kinds, total, lower = F.col(f"{m}_kinds"), F.col(f"{m}_total"), F.col(f"p_{m}")
            new[f"p_{m}"] = F.when(total == 0, lower).otherwise((F.col(m) + kinds * lower) / F.greatest(total + kinds, F.lit(1)))
        rows = rows.withColumns(new)
        out = rows.select("gram", "p_accepted", "p_rejected")
    return cut(rows.select("gram", "needed", (F.log("p_rejected") - F.log("p_accepted")).alias("log")))


def quantile(values: DataFrame, q: float) -> float:
    """Exact quantile of a column without nulls, linear between neighbours; at most BINS rows reach the driver at a time."""
    name = values.columns[0]
    own = cut(values.groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    every = own.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()

    def nth(i: int) -> float:
        lo, hi = every.lo, every.hi
        while lo < hi:  # least and greatest value are never in one bin
            bin_ = F.least(F.floor((F.col("v") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
            bins = own.where(F.col("v").between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            for r in sorted(bins.collect(), key=lambda r: r.bin):
                if i < r.n:
                    lo, hi = r.lo, r.hi
                    break
                i -= r.n
        return lo

    at = (every.n - 1) * q
    low = nth(int(at))
    return low if at == int(at) else low + (nth(int(at) + 1) - low) * (at - int(at))


def score(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, url, aside, score) of the texts of parts that are needed."""
    logs = log_ratios(texts, order)
    often = F.col("needed") * HEAD > F.lit(logs.agg(F.coalesce(F.sum("needed"), F.lit(0))).first()[0])
    head, rest = (logs.where(c).select("gram", F.col("log").cast("decimal(18,12)").alias("log")) for c in (often, ~often))
    own = grams(texts.where("needed").select("id", "url"), order)
    head = F.broadcast(head)
    found = own.join(head, "gram").select("id", "log").union(own.join(head, "gram", "left_anti").join(rest, "gram").select("id", "log"))
    sums = found.groupBy("id").agg(F.sum("log").cast("double").alias("log"))
    value = F.when(F.col("url") == "", 0.0).otherwise(F.col("log") / (F.length("url") + 1))
    return texts.where("needed").join(sums, "id").select("id", "url", "aside", value.alias("score"))


def judge(pages: DataFrame, rules: tuple[Rule, ...], key: str = "page_id", url: str = "url", order: int = ORDER, max_loss: float = MAX_LOSS) -> DataFrame:
    """(key, url, host, path, rule, verdict, score) for every row; score is null where a rule decides."""
    own = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = decide(rules, F.col("host"), F.col("path"))
    own = own.withColumns({"rule": rule, "verdict": verdict})
    texts = parts(own.select("url", "verdict"))
    to_score = F.col("verdict").isNull() & (F.coalesce("url", F.lit("")) != "")
    left = own if texts is None else own.where(~to_score)
    left = left.withColumns({"score": F.when(F.col("verdict").isNull(), 0.0), "verdict": F.coalesce("verdict", F.lit("allow"))})
    if texts is None:
        return left
    scores = cut(score(texts, order))
    threshold = max(0.0, quantile(scores.where("aside").select("score"), 1 - max_loss))
    judged = own.where(to_score).join(scores.where("not aside").select("url", "score"), "url", "left")
    return left.union(judged.withColumn("verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).select(left.columns))
