"""Tables as a virtual graph: a row is a subject, a column a predicate; nothing is materialised.

Patterns with one subject (a star) become one select of the subject's table: their
constants reach the scan as filters, and only named columns are read. Tables with
one template describe the same subjects and are joined on the native key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.functions.terms import LANG, TERM, Typ, datatype_of, lit_type, matches, to_term
from rdfloom.operators.solution import Solution, column, empty, guard, join, name_of, union
from rdfloom.plans.algebra import RDF_TYPE, Iri, Triple, Var
from rdfloom.sources.scope import Scope


@dataclass(frozen=True)
class Property:
    """expr: SQL over the table's columns; ref: template of the object if it is an IRI; lang: column of the tag."""

    expr: str
    ref: str | None = None
    lang: str | None = None


@dataclass
class Table:
    """key: SQL over the table's columns, unique for each row (a set of triples has no repeated rows)."""

    name: str
    template: str
    key: str
    props: dict[str, Property]
    cls: str | None = None
    graph: str | None = None
    size: int = 0
    schema: T.StructType = field(default_factory=T.StructType)


class MappedTables:
    """open_table: name -> DataFrame."""

    def __init__(self, spark: SparkSession, tables: list[Table], open_table: Callable[[str], DataFrame]):
        self.spark, self.tables, self._open = spark, tables, open_table
        self._frames: dict[str, DataFrame] = {}
        self._types: dict[tuple[str, str], Typ] = {}

    def frame(self, t: Table) -> DataFrame:
        if t.name not in self._frames:
            self._frames[t.name] = self._open(t.name)
        return self._frames[t.name]

    def graphs(self) -> list[str]:
        return sorted({t.graph for t in self.tables if t.graph})

    # -- planning

    def groups(self, triples: tuple[Triple, ...]) -> list[list[Triple]]:
        """Stars: triples by subject."""
        by: dict = {}
        for t in triples:
            by.setdefault(t.s, []).append(t)
        return list(by.values())

    def bytes_of(self, t: Table) -> int:
        """Bytes that Catalyst expects of a table, from its files."""
        if not t.size:
            t.size = max(1, int(str(self.frame(t)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return t.size

    def _having(self, star: list[Triple], scope: Scope) -> list[Table]:
        own = [t for t in self.tables if scope.allows(t.graph)]
        return [t for t in own if any(isinstance(x.p, Iri) and (x.p.value in t.props or x.p.value == RDF_TYPE and isinstance(x.o, Iri) and x.o.value == t.cls) for x in star)]

    @staticmethod
    def _kept(star: list[Triple]) -> float:
        """Share of the rows that a star's constants are expected to leave."""
        return 100.0 ** -(sum(not isinstance(x.o, Var) and x.p != Iri(RDF_TYPE) for x in star) + 3 * (not isinstance(star[0].s, Var)))

    def size(self, star: list[Triple], scope: Scope) -> float:
        """Expected size of a star, in bytes."""
        return (sum(map(self.bytes_of, self._having(star, scope))) or 1e12) * self._kept(star)

    def fanout(self, star: list[Triple], var: str, scope: Scope) -> float:
        """Rows of the star that are expected for a value of var: one for its subject; for a link as many as the tables' sizes say."""
        if star[0].s == Var(var):
            return self._kept(star)
        having = self._having(star, scope)
        refs = {t.props[x.p.value].ref for x in star if x.o == Var(var) and isinstance(x.p, Iri) for t in having if x.p.value in t.props}
        linked = sum(self.bytes_of(t) for t in self.tables if t.template in refs)
        return max(1.0, self.size(star, scope) / (linked or 1e5))

    # -- columns

    def subject(self, t: Table) -> tuple[Typ, Column]:
        kind = self._type_of(t, t.key)
        whole = isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType)
        return Typ("iri", t.template, "long" if whole else "string"), F.expr(t.key).cast("long") if whole and not isinstance(kind, T.LongType) else F.expr(t.key)

    def _type_of(self, t: Table, expr: str) -> T.DataType:
        at = (t.name, expr)
        if at not in self._types:
            schema = self.frame(t).schema
            self._types[at] = schema[expr].dataType if expr in schema.names else self.frame(t).select(F.expr(expr).alias("x")).schema["x"].dataType
        return self._types[at]

    def object(self, t: Table, p: Property) -> tuple[Typ, Column]:
        kind, c = self._type_of(t, p.expr), F.expr(p.expr)
        whole = isinstance(kind, T.LongType | T.IntegerType | T.ShortType | T.ByteType)
        if p.ref:
            return Typ("iri", p.ref, "long" if whole else "string"), c.cast("long") if whole and not isinstance(kind, T.LongType) else c
        if p.lang:
            return LANG, F.when(c.isNotNull(), F.struct(c.alias("lex"), F.col(p.lang).alias("tag")))
        if whole and not isinstance(kind, T.LongType):
            c = c.cast("long")
        return lit_type(datatype_of(kind)), c

    # -- scans

    def star(self, triples: list[Triple], scope: Scope) -> Solution:
        entities: dict[str, list[Table]] = {}
        for t in self.tables:
            if scope.allows(t.graph):
                entities.setdefault(t.template, []).append(t)
        found = [x for tables in entities.values() if (x := self._entity(tables, triples, scope)) is not None]
        if found:
            return union(found)
        names = {x.name for t in triples for x in (t.s, t.p, t.o) if isinstance(x, Var)} | ({scope.var} if scope.var else set())
        return empty(self.spark, names)

    def _entity(self, tables: list[Table], triples: list[Triple], scope: Scope) -> Solution | None:
        """The star over the tables of one template, None where some triple has no table."""
        own: dict[int, list[Triple]] = {}
        shared: list[tuple[Triple, list[Table]]] = []
        for tr in triples:
            if isinstance(tr.p, Var):
                shared.append((tr, tables))
                continue
            having = [i for i, t in enumerate(tables) if tr.p.value in t.props or tr.p.value == RDF_TYPE and t.cls and (isinstance(tr.o, Var) or tr.o == Iri(t.cls))]
            if not having:
                return None
            if len(having) == 1:
                own.setdefault(having[0], []).append(tr)
            else:
                shared.append((tr, [tables[i] for i in having]))
        parts = []
        for i, some in own.items():
            x = self._select(tables[i], some, scope)
            if x is None:
                return None
            parts.append(x)
        for tr, some in shared:
            each = [x for t in some if (x := (self._any_predicate(t, tr, scope) if isinstance(tr.p, Var) else self._select(t, [tr], scope))) is not None]
            if not each:
                return None
            parts.append(union(each))
        out = parts[0]
        for p in parts[1:]:
            out = join(out, p)
        return out

    def _select(self, t: Table, triples: list[Triple], scope: Scope) -> Solution | None:
        conditions: list[Column] = []
        out: dict[str, tuple[Typ, Column]] = {}

        def bind(x, typ: Typ, c: Column, null: bool) -> bool:
            if not isinstance(x, Var):
                hit = matches(typ, c, x)
                if hit is None:
                    return False
                conditions.append(hit)
            elif x.name in out:
                other, d = out[x.name]
                conditions.append(c == d if typ == other else to_term(typ, c) == to_term(other, d))
            else:
                out[x.name] = typ, c
                if null:
                    conditions.append(c.isNotNull())
            return True

        if not bind(triples[0].s, *self.subject(t), True):
            return None
        for tr in triples:
            if tr.p.value == RDF_TYPE and tr.p.value not in t.props:
                if not bind(tr.o, TERM, F.lit(t.cls), False):
                    return None
            elif not bind(tr.o, *self.object(t, t.props[tr.p.value]), True):
                return None
        return self._finish(self.frame(t), conditions, out, t, scope)

    def _finish(self, df: DataFrame, conditions: list[Column], out: dict, t: Table, scope: Scope) -> Solution:
        if scope.var:
            if scope.var in out:
                typ, c = out[scope.var]
                conditions.append(to_term(typ, c) == F.lit(t.graph))
            else:
                out[scope.var] = TERM, F.lit(t.graph)
        for c in conditions:
            df = df.where(c)
        if not out:
            return guard(df)
        return Solution(df.select(*(c.alias(name_of(n)) for n, (_, c) in out.items())), {n: typ for n, (typ, _) in out.items()}, set(out))

    def _any_predicate(self, t: Table, tr: Triple, scope: Scope, rows: DataFrame | None = None) -> Solution | None:
        """?p in a triple: one scan, with a row for each column that has a value; rows: those of the table that matter."""
        typ, key = self.subject(t)
        pairs = [F.struct(F.lit(p).alias("p"), to_term(*self.object(t, own)).alias("o")) for p, own in t.props.items()]
        if t.cls:
            pairs.append(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(t.cls).alias("o")))
        if not isinstance(tr.s, Var):
            hit = matches(typ, key, tr.s)
            if hit is None:
                return None
            df = self.frame(t).where(hit)
        else:
            df = self.frame(t) if rows is None else rows
        df = df.select(key.alias("s"), F.inline(F.array(*pairs))).where("o is not null")
        out: dict[str, tuple[Typ, Column]] = {}
        conditions: list[Column] = []
        for x, (kind, c) in ((tr.s, (typ, F.col("s"))), (tr.p, (TERM, F.col("p"))), (tr.o, (TERM, F.col("o")))):
            if isinstance(x, Var) and x.name in out:
                conditions.append(to_term(kind, c) == to_term(*out[x.name]))
            elif isinstance(x, Var):
                out[x.name] = kind, c
            elif x is tr.o:
                conditions.append(matches(TERM, c, x))
        return self._finish(df, conditions, out, t, scope)

    def triples(self, scope: Scope, subjects: Solution | None = None) -> DataFrame:
        """(s, p, o) terms; subjects: one variable, s, of those wanted."""
        tr, inner = Triple(Var("s"), Var("p"), Var("o")), Scope(scope.default, scope.named)
        if subjects is None:
            out = self.star([tr], inner)
        else:
            found = [(t, rows) for t in self.tables if inner.allows(t.graph) and (rows := self._wanted(t, subjects)) is not None]
            parts = [x for t, rows in found if (x := self._any_predicate(t, tr, inner, rows)) is not None]
            out = union(parts) if parts else empty(self.spark, "spo")
        return out.df.select(*(to_term(out.types[n], column(n)).alias(n) for n in "spo"))

    def _wanted(self, t: Table, subjects: Solution) -> DataFrame | None:
        """Rows of a table that are subjects, found by native keys before they become triples; None if no IRI of the template can be one."""
        (mine, key), theirs, c = self.subject(t), subjects.types["s"], column("s")
        if theirs != mine:
            if theirs.kind in ("lit", "lang") or theirs.kind == "iri" and _apart(mine.of, theirs.of):
                return None
            before, _, after = mine.of.partition("{}")
            term = to_term(theirs, c)
            text = F.substring(term, F.lit(len(before) + 1), F.length(term) - len(before) - len(after))
            c = text.try_cast("long") if mine.key == "long" else text
            c = F.when(F.startswith(term, F.lit(before)) & F.endswith(term, F.lit(after)) & (F.concat(F.lit(before), c.cast("string"), F.lit(after)) == term), c)
        wanted = subjects.df.select(c.alias("_wanted"))
        return self.frame(t).join(wanted, key == F.col("_wanted"), "left_semi")


def _apart(a: str, b: str) -> bool:
    """Whether no IRI is of both templates."""
    (x, _, u), (y, _, v) = a.partition("{}"), b.partition("{}")
    return not (x.startswith(y) or y.startswith(x)) or not (u.endswith(v) or v.endswith(u))
