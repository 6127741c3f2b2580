"""Triples (and quads) in Parquet, in two orders: by predicate and subject, and by object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rdfloom.functions.terms import TERM, matches
from rdfloom.operators.solution import Solution, column, guard, join, name_of
from rdfloom.plans.algebra import Iri, Triple, Var
from rdfloom.sources.scope import Scope


@dataclass(frozen=True)
class PredicateStatistics:
    triples: int
    subjects: int
    objects: int


class TripleTable:
    """quads: columns s, p, o (terms) and g (null outside of named graphs), without repeated rows; by_object: the same rows in the order of objects.

    shared: predicates of triples that are in two graphs, so that a union of graphs may repeat them (None: any may be).
    """

    def __init__(self, spark: SparkSession, quads: DataFrame, statistics: dict[str, PredicateStatistics] | None = None, shared: frozenset[str] | None = None, by_object: DataFrame | None = None):
        self.spark, self.quads, self.statistics, self.shared = spark, quads.select("s", "p", "o", "g"), statistics, shared
        self.by_object = self.quads if by_object is None else by_object.select("s", "p", "o", "g")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TripleTable:
        quads = spark.read.parquet(f"{path}/quads")
        rows = spark.read.parquet(f"{path}/statistics").collect()  # a row for each predicate
        shared = frozenset(r.p for r in rows if not r.one_graph)
        return cls(spark, quads, {r.p: PredicateStatistics(r.triples, r.subjects, r.objects) for r in rows}, shared, spark.read.parquet(f"{path}/by_object"))

    @staticmethod
    def write(quads: DataFrame, path: str, partitions: int | None = None) -> None:
        """Dealt by ranges of (p, s) and, once more, of (o, p, s): a predicate or an object that most triples have takes many tasks, a rare one shares a file."""
        spark = quads.sparkSession
        TripleTable.once(quads, partitions).write.mode("overwrite").parquet(f"{path}/quads")
        own = spark.read.parquet(f"{path}/quads")
        dealt = own.repartitionByRange(partitions, *"ops") if partitions else own.repartitionByRange(*"ops")
        dealt.sortWithinPartitions(*"ops").write.mode("overwrite").parquet(f"{path}/by_object")
        TripleTable.describe(spark.read.parquet(f"{path}/quads")).write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def once(quads: DataFrame, partitions: int | None = None) -> DataFrame:
        """Different quads in the order of (p, s, o), dealt by ranges of (p, s). Repeats meet in a range as neighbours, and the first is kept: no task holds what it has read to find them."""
        own = quads.select("s", "p", "o", "g")
        dealt = own.repartitionByRange(partitions, *"ps") if partitions else own.repartitionByRange(*"ps")
        same = Window.partitionBy(*"psog").orderBy("p")
        return dealt.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n").sortWithinPartitions(*"pso")

    @staticmethod
    def describe(quads: DataFrame) -> DataFrame:
        """Rows, subjects and objects of each predicate (the last two approximate), and whether no triple is in two graphs."""
        per = quads.groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))
        mixed = quads.groupBy("p", "g").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count(F.lit(1)).alias("graphs")).where("graphs > 1").select("p")
        many = quads.join(mixed, "p", "left_semi").groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p").distinct().withColumn("many", F.lit(True))
        return per.join(many, "p", "left").select("p", "triples", "subjects", "objects", F.col("many").isNull().alias("one_graph"))

    def graphs(self) -> list[str]:
        return sorted(r.g for r in self.quads.select("g").where("g is not null").distinct().collect())

    def groups(self, triples: tuple[Triple, ...]) -> list[list[Triple]]:
        return [[t] for t in triples]

    def size(self, star: list[Triple], scope: Scope) -> float:
        t = star[0]
        if self.statistics is None:
            self.statistics = {r.p: PredicateStatistics(r.triples, r.subjects, r.objects) for r in self.describe(self.quads).collect()}
        if isinstance(t.p, Iri):
            own = self.statistics.get(t.p.value)
            if own is None:
                return 0.0
            n = own.triples
            n /= own.subjects if not isinstance(t.s, Var) else 1
            return n / (own.objects if not isinstance(t.o, Var) else 1)
        return sum(x.triples for x in self.statistics.values()) / 100 ** (not isinstance(t.s, Var)) / 100 ** (not isinstance(t.o, Var))

    def fanout(self, star: list[Triple], var: str, scope: Scope) -> float:
        """Triples expected for a value of var."""
        t, n = star[0], self.size(star, scope)
        own = self.statistics.get(t.p.value) if isinstance(t.p, Iri) else None
        if own is None:
            return n / max(1, len(self.statistics))
        return n / max(1, own.subjects if t.s == Var(var) else own.objects)

    def _repeats(self, t: Triple, scope: Scope) -> bool:
        """Whether the union of the scope's graphs may hold a triple of the pattern twice."""
        if scope.default is not None and len(set(scope.default)) < 2:
            return False
        return self.shared is None or (t.p.value in self.shared if isinstance(t.p, Iri) else bool(self.shared))

    def _rows(self, scope: Scope, t: Triple) -> DataFrame:
        # a known object without a subject is sought where objects are in order
        df = self.by_object if isinstance(t.s, Var) and not isinstance(t.o, Var) else self.quads
        if scope.graph is not None:
            return df.where(F.col("g") == scope.graph) if scope.allows(scope.graph) else df.where(F.lit(False))
        if scope.var is not None:
            df = df.where("g is not null")
            return df.where(F.col("g").isin(*scope.named)) if scope.named is not None else df
        return df.where(F.col("g").isin(*scope.default)) if scope.default is not None else df

    def star(self, triples: list[Triple], scope: Scope) -> Solution:
        (t,) = triples
        df, out = self._rows(scope, t), {}
        for x, c in ((t.s, "s"), (t.p, "p"), (t.o, "o")):
            if not isinstance(x, Var):
                df = df.where(matches(TERM, F.col(c), x))
            elif x.name in out:
                df = df.where(F.col(c) == F.col(out[x.name]))
            else:
                out[x.name] = c
        if scope.var:
            if scope.var in out:
                df = df.where(F.col("g") == F.col(out[scope.var]))
            else:
                out[scope.var] = "g"
        elif scope.graph is None and self._repeats(t, scope):
            df = df.select("s", "p", "o").distinct()  # the union of graphs is a set
        if not out:
            return guard(df)
        return Solution(df.select(*(F.col(c).alias(name_of(n)) for n, c in out.items())), {n: TERM for n in out}, set(out))

    def triples(self, scope: Scope, subjects: Solution | None = None) -> DataFrame:
        out = self.star([Triple(Var("s"), Var("p"), Var("o"))], Scope(scope.default, scope.named))
        if subjects is not None:
            out = join(out, subjects)
        return out.df.select(*(column(n).alias(n) for n in "spo"))
