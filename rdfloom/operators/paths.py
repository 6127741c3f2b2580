"""Property paths to tables of node pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.checkpoints import cut, fresh_folder
from rdfloom.errors import UnsupportedError
from rdfloom.functions.terms import TERM, Typ, convert, matches, term_string, unify
from rdfloom.operators.solution import Solution, column, name_of, union
from rdfloom.plans.algebra import Alt, Inverse, Iri, Repeat, Seq, Step, Triple, Var

S, O = "_ps", "_po"


class Paths:
    """scan: a triple to its solution (in the scope of the pattern)."""

    def __init__(self, scan):
        self.scan = scan

    def pairs(self, path, start=None, end=None, starts: Solution | None = None, ends: Solution | None = None) -> Solution:
        """Different (S, O) pairs of a path; start, end: constants, if the ends are; starts, ends: solutions of one variable whose values are all that is asked for."""
        out = self._bag(path, start, end, starts, None if starts is not None else ends)
        for n, x in ((S, start), (O, end)):
            if x is not None:
                hit = matches(out.types[n], column(n), x)
                out = Solution(out.df.where(hit if hit is not None else F.lit(False)), out.types, out.certain)
        return Solution(out.df.select(name_of(S), name_of(O)).distinct(), out.types, {S, O})

    @staticmethod
    def _within(x: Solution, n: str, values: Solution | None) -> Solution:
        """The pairs whose end n is among the values: a semi-join before anything else."""
        if values is None:
            return x
        (name,) = values.types
        t = unify(x.types[n], values.types[name])
        own = values.df.select(convert(values.types[name], column(name), t).alias("_in")).distinct()
        return Solution(x.df.join(own, convert(x.types[n], column(n), t) == F.col("_in"), "left_semi"), x.types, x.certain)

    def _bag(self, path, start=None, end=None, starts: Solution | None = None, ends: Solution | None = None) -> Solution:
        if isinstance(path, Step):
            # a constant end reaches the scan itself
            x = self.scan(Triple(start if start is not None else Var(S), Iri(path.iri), end if end is not None else Var(O)))
            for n, c in ((S, start), (O, end)):
                if c is not None:
                    x = Solution(x.df.withColumn(name_of(n), F.lit(term_string(c))), {**x.types, n: TERM}, x.certain | {n})
            return self._within(self._within(x, S, starts), O, ends)
        if isinstance(path, Inverse):
            x = self._bag(path.of, end, start, ends, starts)
            return Solution(x.df.select(column(O).alias(name_of(S)), column(S).alias(name_of(O))), {S: x.types[O], O: x.types[S]}, {S, O})
        if isinstance(path, Alt):
            return union([self._bag(p, start, end, starts, ends) for p in path.parts])
        if isinstance(path, Seq):
            n = len(path.parts)
            if ends is not None:  # from the end backwards, so that each hop meets few rows
                out = self._bag(path.parts[-1], None, end, None, ends)
                for i in range(n - 2, -1, -1):
                    out = self._chained(self._bag(path.parts[i], start if i == 0 else None, None, None, self._middle(out, S)), out)
                return out
            out = self._bag(path.parts[0], start, None, starts)
            for i, p in enumerate(path.parts[1:], 2):
                # hops after a restricted one are restricted in turn where they would else be computed whole
                near = self._middle(out, O) if starts is not None and isinstance(p, Repeat) else None
                out = self._chained(out, self._bag(p, None, end if i == n else None, near))
            return out
        if isinstance(path, Repeat):
            return self._repeated(path, start, end, starts, ends)
        raise UnsupportedError(f"unknown path {path!r}")

    @staticmethod
    def _middle(x: Solution, n: str) -> Solution:
        return Solution(x.df.select(column(n).alias(name_of("m"))), {"m": x.types[n]}, {"m"})

    @staticmethod
    def _chained(a: Solution, b: Solution) -> Solution:
        t = unify(a.types[O], b.types[S])
        left = a.df.select(column(S), convert(a.types[O], column(O), t).alias("_mid"))
        right = b.df.select(convert(b.types[S], column(S), t).alias("_mid2"), column(O))
        df = left.join(right, F.col("_mid") == F.col("_mid2")).select(name_of(S), name_of(O)).distinct()
        return Solution(df, {S: a.types[S], O: b.types[O]}, {S, O})

    def _repeated(self, path: Repeat, start, end, starts: Solution | None = None, ends: Solution | None = None) -> Solution:
        step = self._bag(path.of)
        t = unify(step.types[S], step.types[O])
        edges = step.df.select(convert(step.types[S], column(S), t).alias("a"), convert(step.types[O], column(O), t).alias("b")).distinct()
        seeds = None
        if start is None and end is None and (starts is not None or ends is not None):
            given = starts if starts is not None else ends
            (name,) = given.types
            u = unify(t, given.types[name])
            seeds = given.df.select(convert(given.types[name], column(name), u).alias("seed")).distinct()
            edges, t = edges.select(convert(t, F.col("a"), u).alias("a"), convert(t, F.col("b"), u).alias("b")), u
        near = "a" if starts is not None else "b"
        if path.mark == "?":
            out = edges if seeds is None else edges.join(seeds, F.col(near) == F.col("seed"), "left_semi")
        elif start is not None or end is not None:
            out = self._reached(edges, t, start, end)
        elif seeds is not None:
            out = self._reached_from(edges, seeds, near)
        else:
            out = self._closure(edges)
        if path.mark in "?*":
            # with both ends free: the nodes of the path's edges; a constant end always matches itself
            nodes = edges.select("a").union(edges.select("b")).distinct()
            if seeds is not None:
                nodes = nodes.join(seeds, F.col("a") == F.col("seed"), "left_semi")
            same = nodes.select("a", F.col("a").alias("b"))
            for x in (start, end):
                if x is not None:
                    one = edges.sparkSession.range(1).select(F.lit(term_string(x)).alias("a"), F.lit(term_string(x)).alias("b"))
                    if t != TERM:
                        out, t = self._as_terms(out, t), TERM
                    same = one
            out = out.union(same).distinct()
        return Solution(out.select(F.col("a").alias(name_of(S)), F.col("b").alias(name_of(O))), {S: t, O: t}, {S, O})

    @staticmethod
    def _as_terms(df: DataFrame, t: Typ) -> DataFrame:
        return df.select(convert(t, F.col("a"), TERM).alias("a"), convert(t, F.col("b"), TERM).alias("b"))

    @staticmethod
    def _reached(edges: DataFrame, t: Typ, start, end) -> DataFrame:
        """From one constant end: a frontier that grows by a hop a round, until it holds nothing new."""
        forward = start is not None
        x, near, far = (start, "a", "b") if forward else (end, "b", "a")
        hit = matches(t, F.col(near), x)
        edges = cut(edges)
        front = edges.where(hit if hit is not None else F.lit(False)).select(F.col(far).alias("n")).distinct()
        seed = edges.where(hit if hit is not None else F.lit(False)).select(F.col(near).alias("seed")).limit(1)
        rounds = Rounds(edges.sparkSession)
        front = rounds.add(front)
        while not front.isEmpty():
            step = front.join(edges, F.col("n") == F.col(near)).select(F.col(far).alias("m")).distinct()
            front = rounds.add(step.join(rounds.all(), F.col("m") == F.col("n"), "left_anti").select(F.col("m").alias("n")))
        out = rounds.all().crossJoin(seed)  # one row on the right
        return out.select(F.col("seed").alias(near), F.col("n").alias(far)).select("a", "b")

    @staticmethod
    def _reached_from(edges: DataFrame, seeds: DataFrame, near: str) -> DataFrame:
        """From many ends at once: pairs of a seed and what it reaches, a hop a round."""
        far = "b" if near == "a" else "a"
        edges = cut(edges)
        rounds = Rounds(edges.sparkSession)
        front = rounds.add(edges.join(seeds, F.col(near) == F.col("seed")).select("seed", F.col(far).alias("n")).distinct())
        while not front.isEmpty():
            step = front.join(edges, F.col("n") == F.col(near)).select(F.col("seed").alias("s"), F.col(far).alias("m")).distinct()
            known = rounds.all()
            front = rounds.add(step.join(known, (F.col("s") == F.col("seed")) & (F.col("m") == F.col("n")), "left_anti").select(F.col("s").alias("seed"), F.col("m").alias("n")))
        return rounds.all().select(F.col("seed").alias(near), F.col("n").alias(far)).select("a", "b")

    @staticmethod
    def _closure(edges: DataFrame) -> DataFrame:
        """All pairs, by doubling: each round joins what is new with all that is known, so that rounds grow with the logarithm of the longest path."""
        rounds = Rounds(edges.sparkSession)
        new = rounds.add(edges)
        while not new.isEmpty():
            known = rounds.all()
            k, n = known.toDF("c", "d"), new.toDF("e", "f")
            longer = n.join(k, F.col("f") == F.col("c")).select(F.col("e").alias("a"), F.col("d").alias("b"))
            longer = longer.union(k.join(n, F.col("d") == F.col("e")).select(F.col("c").alias("a"), F.col("f").alias("b"))).distinct()
            k2 = known.toDF("x", "y")
            new = rounds.add(longer.join(k2, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"))
        return rounds.all()


class Rounds:
    """Results of rounds in one folder: each round writes what is new, and nothing is written twice."""

    def __init__(self, spark):
        self.spark, self.at, self.n, self.kind = spark, fresh_folder(spark), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        self.kind = self.kind or df.schema
        df.write.parquet(f"{self.at}/round={self.n}")
        self.n += 1
        return self.spark.read.schema(self.kind).parquet(f"{self.at}/round={self.n - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(*(f"{self.at}/round={i}" for i in range(self.n)))
