"""The facade: a dataset to query."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.checkpoints import fresh_folder
from rdfloom.config import Settings
from rdfloom.errors import QueryError, QueryTimeout
from rdfloom.functions.terms import TERM, Typ, to_term
from rdfloom.governor import reservation
from rdfloom.operators.compiler import Compiler
from rdfloom.operators.paths import Paths
from rdfloom.operators.solution import column
from rdfloom.plans.algebra import RDF_TYPE, Iri, Query, Seq, Step, Triple, Var
from rdfloom.plans.parser import parse
from rdfloom.plans.hints import hints
from rdfloom.sources import ntriples
from rdfloom.sources.mapped import MappedTables, Table
from rdfloom.sources.scope import Scope
from rdfloom.sources.triples import PredicateStatistics, TripleTable


@dataclass
class Result:
    """form is SELECT, ASK, DESCRIBE or CONSTRUCT. df has a column for each variable, native where its type is known (IRIs of templates as strings)."""

    form: str
    df: DataFrame
    names: list[str]
    types: dict[str, Typ]
    terms: DataFrame  # the same rows as terms
    hints: list[str] = field(default_factory=list)
    kept: DataFrame | None = None  # what run() has computed

    def close(self) -> None:
        """Let go of the computed rows."""
        if self.kept is not None:
            self.kept.unpersist()

    @property
    def boolean(self) -> bool:
        if self.form != "ASK":
            raise QueryError("only ASK has a boolean result")
        return bool(self.df.first()[0])

    def rows(self) -> Iterator[tuple]:
        """Terms of each row, streamed to the driver a partition at a time."""
        for r in self.terms.toLocalIterator():
            yield tuple(r)


class Dataset:
    """Triples or mapped tables, with what has been materialised for them."""

    def __init__(self, spark: SparkSession, source: MappedTables | TripleTable, settings: Settings | None = None):
        self.spark, self.source, self.settings = spark, source, settings or Settings()
        self._paths: dict = {}
        self._cached: dict[str, DataFrame] = {}

    # -- making one

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: list[Table], folder: str | None = None, frames: dict[str, DataFrame] | None = None, settings: Settings | None = None) -> Dataset:
        """Mapped tables, Parquet files of a folder or given DataFrames."""
        get = lambda n: frames[n] if frames and n in frames else spark.read.parquet(f"{folder}/{n}.parquet")
        return cls(spark, MappedTables(spark, tables, get), settings)

    @classmethod
    def from_quads(cls, spark: SparkSession, quads: DataFrame, settings: Settings | None = None) -> Dataset:
        shared = None
        if "g" not in quads.columns:
            quads, shared = quads.withColumn("g", F.lit(None).cast("string")), frozenset()
        return cls(spark, TripleTable(spark, quads.select("s", "p", "o", "g").dropDuplicates(), shared=shared), settings)

    @classmethod
    def load(cls, spark: SparkSession, inputs: list, report: bool = False, settings: Settings | None = None) -> Dataset:
        """N-Triples and N-Quads files; gzip too. They are parsed once, into a store in the folder that all executors share, which patterns and statistics read."""
        return cls.build(spark, inputs, fresh_folder(spark), report, settings)

    @classmethod
    def build(cls, spark: SparkSession, inputs: list, path: str, report: bool = True, settings: Settings | None = None) -> Dataset:
        """Load files and keep them as a store under path."""
        TripleTable.write(ntriples.read(spark, inputs, report), path)
        return cls.open(spark, path, settings)

    @classmethod
    def open(cls, spark: SparkSession, path: str, settings: Settings | None = None) -> Dataset:
        return cls(spark, TripleTable.open(spark, path), settings)

    # -- queries

    def compiler(self) -> Compiler:
        return Compiler(self.spark, self.source, self.settings.max_cross_bytes, self._paths)

    def query(self, text: str, keep: bool = False) -> Result:
        """keep: mark the rows to be kept once they are computed."""
        q = parse(text)
        c = self.compiler()
        if q.form == "ASK":
            x = c.pattern(q.where, _scope(q))
            df = x.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("boolean"))
            df = df.persist() if keep else df
            return Result("ASK", df, ["boolean"], {}, df, kept=df if keep else None)
        if q.form in ("DESCRIBE", "CONSTRUCT"):
            df = c.described(q) if q.form == "DESCRIBE" else c.constructed(q)
            df = df.persist() if keep else df
            return Result(q.form, df, ["s", "p", "o"], dict.fromkeys("spo", TERM), df, kept=df if keep else None)
        x = c.select(q)
        if keep:
            x.df = x.df.persist()
        names = list(x.types)
        shown = [(to_term(t, column(n)) if t.kind in ("iri", "lang") else column(n)).alias(n) for n, t in x.types.items()]
        terms = [to_term(t, column(n)).alias(n) for n, t in x.types.items()]
        return Result("SELECT", x.df.select(*shown), names, dict(x.types), x.df.select(*terms), hints(q), x.df if keep else None)

    def sql_type(self, text: str) -> dict[str, Typ]:
        """Types of a query's variables, without running it."""
        return self.query(text).types

    def explain(self, text: str) -> str:
        """The physical plan of a query."""
        return self.query(text).df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def run(self, text: str, timeout: float | None = None) -> Result:
        """query, with its rows computed and kept (in memory, beyond that on disk) under the limits of time and rows; close() lets go of them.

        When the time is over, the running jobs and all later ones of the query are cancelled.
        """
        seconds = timeout if timeout is not None else self.settings.query_timeout
        sc, group, most = self.spark.sparkContext, f"query-{uuid.uuid4().hex}", self.settings.max_rows
        over = threading.Event()

        def stop() -> None:
            over.set()
            sc._jsc.sc().cancelJobGroupAndFutureJobs(group, "the query took too long")

        sc.setJobGroup(group, text[:200], interruptOnCancel=True)
        timer = threading.Timer(seconds, stop) if seconds else None
        out = None
        try:
            if timer:
                timer.start()
            out = self.query(text, keep=True)
            n = out.kept.limit(most + 1).count() if most else out.kept.count()
            if over.is_set():
                raise QueryTimeout(f"the query took more than {seconds} seconds")
            if most and n > most:
                raise QueryError(f"the result has more than {most} rows; add a LIMIT")
            return out
        except Exception as e:
            if out is not None:
                out.close()
            if over.is_set() and not isinstance(e, QueryTimeout):
                raise QueryTimeout(f"the query took more than {seconds} seconds") from e
            raise
        finally:
            if timer:
                timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def estimate(self, text: str) -> int:
        """Bytes that Catalyst expects of a query's result."""
        return int(str(self.query(text).df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def reservation(self, text: str) -> int:
        """MB that a query asks for."""
        width = max(1, len(parse(text).items))
        return reservation(self.estimate(text) // (8 * width), width, self.settings)

    # -- statistics and materialisation

    def graphs(self) -> list[str]:
        return self.source.graphs()

    def statistics(self) -> dict[str, PredicateStatistics]:
        """Rows, subjects and objects of each predicate."""
        if isinstance(self.source, TripleTable):
            if self.source.statistics is None:
                self.source.size([Triple(Var("s"), Var("p"), Var("o"))], Scope())
            return dict(self.source.statistics)
        df = self.source.triples(Scope()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("s").alias("s"), F.approx_count_distinct("o").alias("o"))
        return {r.p: PredicateStatistics(r.n, r.s, r.o) for r in df.collect()}

    def cache_predicate(self, iri: str) -> None:
        """Keep the pairs of a predicate in memory (and on disk beyond that)."""
        self.cache_path([iri])

    def cache_class(self, iri: str) -> DataFrame:
        """Keep the members of a class."""
        x = self.source.star([Triple(Var("s"), Iri(RDF_TYPE), Iri(iri))], Scope())
        self._cached[iri] = x.df.persist()
        return self._cached[iri]

    def cache_path(self, iris: list[str]) -> None:
        """Materialise a chain of predicates and its contiguous parts of two or more; queries with the path ?a p1/p2/... ?b then read it."""
        chains = [iris] if len(iris) == 1 else sorted((iris[i:j] for i in range(len(iris)) for j in range(i + 2, len(iris) + 1)), key=len)
        for chain in chains:
            path = Step(chain[0]) if len(chain) == 1 else Seq(tuple(Step(i) for i in chain))
            if (path, Scope()) not in self._paths:
                pairs = Paths(lambda tr: self.source.star([tr], Scope())).pairs(path)
                pairs.df.persist()
                self._paths[path, Scope()] = pairs

    def clear_cache(self) -> None:
        for p in self._paths.values():
            p.df.unpersist()
        for df in self._cached.values():
            df.unpersist()
        self._paths.clear()
        self._cached.clear()

    def quads(self) -> DataFrame:
        """All triples as terms (of mapped tables: with their graphs)."""
        if isinstance(self.source, TripleTable):
            return self.source.quads
        x = self.source.star([Triple(Var("s"), Var("p"), Var("o"))], Scope(var="g"))
        return x.df.select(*(to_term(x.types[n], column(n)).alias(n) for n in "spog"))

    def write(self, path: str) -> None:
        """Keep everything as a store of triples."""
        TripleTable.write(self.quads(), path)


def _scope(q: Query) -> Scope:
    return Scope(tuple(q.default_graphs) if q.default_graphs else None, tuple(q.named_graphs) if q.named_graphs else None)
