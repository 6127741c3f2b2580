"""Algebra to DataFrames."""

from __future__ import annotations

from dataclasses import replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rdfloom.errors import QueryError, UnsupportedError
from rdfloom.functions.expressions import Expressions, Val, unified
from rdfloom.functions.terms import DOUBLE, INTEGER, STRING, TERM, constant, convert, lit_type, matches, to_term
from rdfloom.operators.paths import O, Paths, S
from rdfloom.operators.solution import Solution, column, empty, guard, join, left_join, name_of, null_of, semi_join, union, unit
from rdfloom.plans.algebra import UNIT, Agg, Bgp, Call, Exists, Extend, Filter, Graph, Iri, Join, LeftJoin, Minus, Query, Repeat, Seq, SubSelect, Triple, Union, Values, Var, aggregates, children, expr_vars, mentioned, replace, variables
from rdfloom.sources.scope import Scope


def conjuncts(e) -> list:
    return [x for a in e.args for x in conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


def _exists(e) -> bool:
    return isinstance(e, Exists) or any(_exists(c) for c in children(e))


def _calls(e) -> set[str]:
    return ({e.name} if isinstance(e, Call) else set()).union(*map(_calls, children(e)))


def conjunction(parts: list):
    out = None
    for p in parts:
        out = p if out is None else Call("&&", (out, p))
    return out


#: How many equal rows a row stands for, in out and in what is joined to it.
WEIGHT, OTHER = "_weight", "_weight_of_other"


class Compiler:
    """source: MappedTables or TripleTable. max_cross: bytes that Catalyst may expect of the smaller side of a product of unrelated patterns."""

    def __init__(self, spark: SparkSession, source, max_cross: int = 64 << 20, paths: dict | None = None):
        self.spark, self.source, self.max_cross, self.materialised, self.counter = spark, source, max_cross, paths or {}, 0

    # -- patterns

    def pattern(self, p, scope: Scope) -> Solution:
        if isinstance(p, Bgp):
            return self.bgp(p.triples, scope)
        if isinstance(p, Join):
            return self.product(self.pattern(p.left, scope), self.pattern(p.right, scope))
        if isinstance(p, LeftJoin):
            return self.optional(p, scope)
        if isinstance(p, Union):
            return union([self.pattern(x, scope) for x in p.parts])
        if isinstance(p, Minus):
            return semi_join(self.pattern(p.left, scope), self.pattern(p.right, scope), anti=True, minus=True)
        if isinstance(p, Filter):
            return self.filter(self.pattern(p.of, scope), p.condition, scope)
        if isinstance(p, Extend):
            x = self.pattern(p.of, scope)
            if p.var in x.types:
                raise QueryError(f"?{p.var} is bound already")
            names = list(x.types)
            x, exists = self.flags(x, [p.expr], scope)
            return self.extend(x, p.var, x.expressions(exists).value(p.expr)).only([*names, p.var])
        if isinstance(p, Graph):
            inner = changed(scope, graph=p.name.value, var=None) if isinstance(p.name, Iri) else changed(scope, graph=None, var=p.name.name)
            if p.of == UNIT:
                return self.graph_names(p.name, scope)
            return self.pattern(p.of, inner)
        if isinstance(p, Values):
            return self.values(p)
        if isinstance(p, SubSelect):
            return self.select(p.query, scope)
        raise UnsupportedError(type(p).__name__)

    def graph_names(self, name, scope: Scope) -> Solution:
        graphs = [g for g in self.source.graphs() if scope.named is None or g in scope.named]
        if isinstance(name, Iri):
            return unit(self.spark) if name.value in graphs else empty(self.spark, [])
        return self.values(Values((name.name,), tuple((Iri(g),) for g in graphs)))

    def product(self, a: Solution, b: Solution) -> Solution:
        """Join; two unrelated patterns of unbounded size are refused."""
        if a.types and b.types and not set(a.types) & set(b.types):
            sizes = [float(str(x.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in (a, b)]
            if min(sizes) > self.max_cross:
                raise QueryError("the patterns share no variable and their product is too large; join them, or raise max_cross")
        return join(a, b)

    def bgp(self, triples: tuple[Triple, ...], scope: Scope, needed: set[str] | None = None) -> Solution:
        """Stars joined in the order of least expected rows; a path where no star that is left is connected, or at the end.

        needed: the variables that the rest of the query names, if rows are only counted beyond them. Sides that would multiply are then grouped
        before their join by what is still to be named, and WEIGHT says how many rows each stands for.
        """
        plain = tuple(t for t in triples if isinstance(t.p, Iri | Var))
        stars = self.ordered(self.source.groups(plain), scope)
        paths = [t for t in triples if not isinstance(t.p, Iri | Var)]
        ends = lambda t: {x.name for x in (t.s, t.o) if isinstance(x, Var)}
        out = None
        bound: set[str] = set()
        rows_of: set[str] = set()  # a variable whose values occur once in out, as far as a subject has one row
        while stars or paths:
            g = next((g for g in stars if out is None or self.names(g) & bound), None)
            t = next((t for t in paths if ends(t) & bound), None) if g is None else None
            if g is None and t is None:  # unrelated to what there is
                g, t = (stars[0], None) if stars else (None, paths[0])
            if g is not None:
                stars.remove(g)
                x = self.source.star(g, scope)
            else:
                paths.remove(t)
                x = self.path(t, scope, out)
            if needed is not None and g is not None:
                s, own = {g[0].s.name} if isinstance(g[0].s, Var) else set(), self.names(g)
                if out is not None and s and not s & bound and not rows_of & own:  # many on both sides
                    later = needed.union(*map(self.names, stars), *map(ends, paths))
                    out, x = self.weighed(out, later | own, WEIGHT), self.weighed(x, later | bound, OTHER)
                    rows_of = set()
                elif out is None or not s & bound:
                    rows_of = s
            else:
                rows_of = set()
            out = x if out is None else self.product(out, x)
            if OTHER in out.types:
                both = column(WEIGHT) * column(OTHER) if WEIGHT in out.types else column(OTHER)
                types = {n: t for n, t in out.types.items() if n != OTHER} | {WEIGHT: out.types[OTHER]}
                out = Solution(out.df.withColumn(name_of(WEIGHT), both), types, out.certain | {WEIGHT}).only(types)
            bound |= self.names(g) if g is not None else set(x.types)
        return out if out is not None else unit(self.spark)

    @staticmethod
    def weighed(x: Solution, keep: set[str], weight: str) -> Solution:
        """x grouped by the variables to keep, with the number of its rows as weight; x itself if it has no others."""
        names = [n for n in x.types if n in keep]
        if all(n in keep or n == WEIGHT for n in x.types):
            return x
        n = F.sum(column(WEIGHT)) if WEIGHT in x.types else F.count(F.lit(1))
        df = x.df.groupBy(*(column(k) for k in names)).agg(n.alias(name_of(weight)))
        df = df if names else df.where(column(weight) > 0)  # no rows are no group
        return Solution(df, {k: x.types[k] for k in names} | {weight: lit_type(INTEGER)}, x.certain & set(names) | {weight})

    @staticmethod
    def names(g: list[Triple]) -> set[str]:
        return {x.name for t in g for x in (t.s, t.p, t.o) if isinstance(x, Var)}

    def ordered(self, groups: list[list[Triple]], scope: Scope) -> list[list[Triple]]:
        """A connected order for each first star, by the fewest expected rows at each step; the cheapest of them.

        A star whose subject is bound already adds no rows. Two stars that meet in a
        common object multiply: customers and suppliers of a nation are not joined
        before what relates them, however small both are.
        """
        if len(groups) < 2:
            return groups
        sizes = [self.source.size(g, scope) for g in groups]
        names = [self.names(g) for g in groups]
        fanouts = [{v: self.source.fanout(g, v, scope) for v in n} for g, n in zip(groups, names)]
        best: tuple[float, list[int]] | None = None
        for first in range(len(groups)):
            rows = total = sizes[first]
            order, bound = [first], set(names[first])
            while len(order) < len(groups):
                todo = [i for i in range(len(groups)) if i not in order]
                near = [i for i in todo if names[i] & bound]
                grown = {i: rows * min(fanouts[i][v] for v in names[i] & bound) for i in near} or {i: rows * max(sizes[i], 1) for i in todo}
                i = min(grown, key=lambda i: (grown[i], sizes[i]))
                rows = max(grown[i], 1e-9)
                total += rows + sizes[i] / 1e3
                order.append(i)
                bound |= names[i]
            if best is None or total < best[0]:
                best = total, order
        return [groups[i] for i in best[1]]

    def path(self, t: Triple, scope: Scope, given: Solution | None = None) -> Solution:
        """Pairs of a path; given: what has been matched already, whose values of an end restrict the path's first hops."""
        start, end = (None if isinstance(x, Var) else x for x in (t.s, t.o))
        if scope.var is not None:  # a path stays inside one graph
            each = []
            for g in self.source.graphs():
                if scope.named is None or g in scope.named:
                    x = self.path(t, changed(scope, graph=g, var=None))
                    each.append(join(x, self.values(Values((scope.var,), ((Iri(g),),)))) if scope.var in x.types else self.extend(x, scope.var, Val(TERM, F.lit(g))))
            return union(each) if each else empty(self.spark, variables(Bgp((t,))) | {scope.var})
        ready = self.materialised.get((t.p, scope))
        if ready is not None:
            pairs = _bound(ready, start, end)
        else:
            # a path of one hop meets what there is in the join that follows
            wide = isinstance(t.p, Seq | Repeat)
            ends = [given.only([x.name]) if wide and isinstance(x, Var) and given is not None and x.name in given.certain else None for x in (t.s, t.o)]
            pairs = Paths(lambda tr: self.source.star([tr], scope)).pairs(t.p, start, end, *ends)
        df, types = pairs.df, {}
        if isinstance(t.s, Var) and t.s == t.o:
            df = df.where(to_term(pairs.types[S], column(S)) == to_term(pairs.types[O], column(O)))
        cols = []
        for x, n in ((t.s, S), (t.o, O)):
            if isinstance(x, Var) and x.name not in types:
                types[x.name] = pairs.types[n]
                cols.append(column(n).alias(name_of(x.name)))
        return Solution(df.select(*cols), types, set(types)) if cols else guard(df)

    def values(self, p: Values) -> Solution:
        """Inline rows; columns are native where their terms have one type."""
        if not p.rows:
            return empty(self.spark, p.names)
        types, certain, cols = {}, set(), []
        for i, n in enumerate(p.names):
            column_ = [r[i] for r in p.rows]
            kinds = {constant(x)[0] for x in column_ if x is not None}
            types[n] = kinds.pop() if len(kinds) == 1 else TERM
            if None not in column_:
                certain.add(n)
            cols.append([null_of(types[n]) if x is None else (constant(x)[1] if types[n] != TERM else to_term(*constant(x))) for x in column_])
        rows = F.array(*(F.struct(*(c[k].alias(name_of(n)) for n, c in zip(p.names, cols))) for k in range(len(p.rows))))
        return Solution(self.spark.range(1).select(F.inline(rows)), types, certain)

    def extend(self, x: Solution, name: str, v: Val) -> Solution:
        return Solution(x.df.withColumn(name_of(name), v.col), {**x.types, name: v.typ}, set(x.certain))

    def optional(self, p: LeftJoin, scope: Scope) -> Solution:
        left, right = self.pattern(p.left, scope), self.pattern(p.right, scope)
        condition = p.condition
        if condition is not None:
            # what concerns the right side alone can be filtered there
            parts, known = conjuncts(condition), set(right.types)
            # an EXISTS may share with the left what the right side has too, and binds the rest itself
            own = [c for c in parts if (mentioned(c) & set(left.types) <= known if _exists(c) else expr_vars(c) <= known - set(left.types))]
            if own:
                right = self.filter(right, conjunction(own), scope)
            rest = [c for c in parts if c not in own]
            names, ahead = list(left.types), [c for c in rest if _exists(c) and not mentioned(c) & set(right.types) - left.certain]
            if ahead:
                left, flag = self.decided(left, conjunction(ahead), scope)
                # few rows may meet many: they are dealt out first, as the size of their files doesn't tell
                left = Solution(left.df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions"))), left.types, left.certain)
                rest = [Var(flag), *(c for c in rest if c not in ahead)]
            if any(_exists(c) for c in rest):
                out = self.optional_if(left, right, conjunction(rest), scope)
            else:
                out = left_join(left, right, conjunction(rest))
            return out.only([*names, *(n for n in right.types if n not in names)]) if ahead else out
        return left_join(left, right, condition)

    def decided(self, x: Solution, condition, scope: Scope) -> tuple[Solution, str]:
        """x with a flag for what the condition, an EXISTS that x alone decides, is for each row: before x meets an OPTIONAL, and not on pairs."""
        self.counter += 1
        flag, names = f"_holds{self.counter}", list(x.types)
        try:
            y, exists = self.flags(x, [condition], scope)
            holds = y.expressions(exists).truth(condition)
        except UnsupportedError:  # filters on the outer row, or unbound variables: sought for different rows, which then meet their rows
            mark, once = self.marked(x)
            found = self.filter(once, condition, scope)
            rows = found.df.select(*(column(m).alias(name_of(m)) for m in mark.values()), F.lit(True).alias(name_of(flag)))
            y, holds = Solution(x.df.join(rows, self.same(mark), "left"), x.types, x.certain), column(flag)
        df = y.df.withColumn(name_of(flag), F.coalesce(holds, F.lit(False)))
        return Solution(df, {**y.types, flag: lit_type("http://www.w3.org/2001/XMLSchema#boolean")}, y.certain | {flag}).only([*names, flag]), flag

    @staticmethod
    def marked(x: Solution) -> tuple[dict[str, str], Solution]:
        """Different rows of x with a copy of each variable, and the names of the copies."""
        mark = {n: f"_left_{n}" for n in x.types}
        return mark, Solution(x.df.distinct().select("*", *(column(n).alias(name_of(m)) for n, m in mark.items())), {**x.types, **{m: x.types[n] for n, m in mark.items()}}, x.certain | {mark[n] for n in x.certain})

    @staticmethod
    def same(mark: dict[str, str]) -> Column:
        on = F.lit(True)
        for i, (n, m) in enumerate(mark.items()):
            one = column(n).eqNullSafe(column(m))
            on = on & one if i else one
        return on

    def optional_if(self, left: Solution, right: Solution, condition, scope: Scope) -> Solution:
        """OPTIONAL whose condition holds an EXISTS that names the left side: it is decided on the joined rows of different left ones, which then meet their left rows."""
        mark, once = self.marked(left)
        found = self.filter(join(once, right), condition, scope)
        names = [n for n in found.types if n not in mark.values()]
        cols = [column(n).alias(name_of(n, "r")) for n in names] + [column(m).alias(name_of(m)) for m in mark.values()]
        df = left.df.join(found.df.select(*cols), self.same(mark), "left")
        out = [(F.coalesce(column(n, "r"), convert(left.types[n], column(n), found.types[n])) if n in left.types else column(n, "r")).alias(name_of(n)) for n in names]
        return Solution(df.select(*out), {n: found.types[n] for n in names}, set(left.certain))

    def filter(self, x: Solution, condition, scope: Scope) -> Solution:
        rest = []
        for c in conjuncts(condition):
            if isinstance(c, Call) and c.name == "!" and isinstance(c.args[0], Exists):
                c = Exists(c.args[0].of, not c.args[0].negated)
            if isinstance(c, Exists):
                inner, outer = self.correlated(c.of, x)
                x = semi_join(x, self.pattern(inner, scope), c.negated, outer)
            else:
                rest.append(c)
        if rest:
            names = list(x.types)
            x, exists = self.flags(x, rest, scope)
            df = x.df
            for c in rest:
                df = df.where(x.expressions(exists).truth(c))
            x = Solution(df, x.types, x.certain).only(names) if len(x.types) > len(names) else Solution(df, x.types, x.certain)
        return x

    def flags(self, x: Solution, exprs: list, scope: Scope):
        """x with a flag for each EXISTS inside the expressions, and what looks them up."""

        def found(e) -> list[Exists]:
            return [e] if isinstance(e, Exists) else [y for c in children(e) for y in found(c)]

        flags: dict = {}
        for e in [y for c in exprs for y in found(c)]:
            if e not in flags:
                x, flags[e] = self.flagged(x, e, scope)
        return x, lambda e: flags[e]

    def exists_in(self, x: Solution, scope: Scope):
        def no(_: Exists) -> Column:
            raise UnsupportedError("EXISTS is not supported in keys and aggregates")

        return no

    @staticmethod
    def correlated(p, x: Solution) -> tuple:
        """(pattern, condition): filters at the top of an EXISTS group that name variables of the outer row only go to the join."""
        conditions = []
        while isinstance(p, Filter):  # the whole chain, so that the order of filters doesn't matter
            conditions += conjuncts(p.condition)
            p = p.of
        inner = variables(p)
        own = [c for c in conditions if expr_vars(c) <= inner]
        outer = [c for c in conditions if not expr_vars(c) <= inner]
        return Filter(conjunction(own), p) if own else p, conjunction(outer)

    def flagged(self, x: Solution, e: Exists, scope: Scope) -> tuple[Solution, Column]:
        """x with a column that says whether the pattern has a match for the row."""
        inner, outer = self.correlated(e.of, x)
        y = self.pattern(inner, scope)
        shared = [n for n in y.types if n in x.types]
        if outer is not None or not all(n in x.certain and n in y.certain for n in shared):
            raise UnsupportedError("EXISTS inside a larger condition takes no outer filter and no unbound variable")
        self.counter += 1
        flag = f"_flag{self.counter}"
        own = y.only(shared)
        mark = Solution((own.df.distinct() if shared else own.df.limit(1)).withColumn(name_of(flag), F.lit(True)), {**own.types, flag: lit_type("http://www.w3.org/2001/XMLSchema#boolean")}, own.certain | {flag})
        out = left_join(x, mark)
        hit = column(flag).isNotNull()
        return out, ~hit if e.negated else hit

    # -- select

    def select(self, q: Query, scope: Scope | None = None) -> Solution:
        scope = scope or Scope(tuple(q.default_graphs) if q.default_graphs else (() if q.named_graphs else None), tuple(q.named_graphs) if q.named_graphs else (() if q.default_graphs else None))
        if (counted := self.counted_product(q, scope)) is not None:
            x = counted
            df = x.df.offset(q.offset) if q.offset else x.df
            return Solution(df.limit(q.limit) if q.limit is not None else df, x.types, x.certain)
        needed = self.named_beyond_counts(q)
        x = self.pattern(q.where, scope) if needed is None else self.counted(q.where, scope, needed | ({scope.var} if scope.var else set()))
        items, having, order = list(q.items), list(q.having), list(q.order)
        if q.group is not None or any(aggregates(e) for _, e in items if e is not None) or any(aggregates(e) for e in having) or any(aggregates(e) for e, _ in order):
            x, swap = self.grouped(x, q, scope)
            items = [(n, replace(e, swap) if e is not None else None) for n, e in items]
            aliases = {Var(n): e for n, e in items if e is not None and Var(n) not in swap}
            having = [replace(replace(e, swap), aliases) for e in having]
            order = [(replace(e, swap), up) for e, up in order]
            for h in having:
                x = self.filter(x, h, scope)
        names = [n for n in sorted(x.types) if not Var(n).hidden] if q.star else [n for n, _ in items]
        if q.star:
            ranked = self._order_of(q.where)
            names.sort(key=lambda n: ranked.index(n) if n in ranked else len(ranked))
        for n, e in items:
            if e is not None:
                x, exists = self.flags(x, [e], scope)
                v = x.expressions(exists).value(e)
                x = self.extend(Solution(x.df.drop(name_of(n)), {k: t for k, t in x.types.items() if k != n}, x.certain - {n}), n, v)
            elif n not in x.types:  # never bound
                x = self.extend(x, n, Val(TERM, F.lit(None).cast("string")))
        if q.distinct:
            x = x.only(names)
            x = Solution(x.df.distinct(), x.types, x.certain)
        if order:
            x = Solution(x.df.orderBy(*(k for e, up in order for k in self.sort_keys(x.expressions().value(e), up))), x.types, x.certain)
        df = x.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solution(df, x.types, x.certain).only(names)

    @staticmethod
    def _order_of(p) -> list[str]:
        """Variables in the order of the text."""
        out: list[str] = []

        def walk(y) -> None:
            if isinstance(y, Var):
                out.append(y.name)
            elif isinstance(y, Extend):
                walk(y.of)
                out.append(y.var)
            elif isinstance(y, Values):
                out.extend(y.names)
            elif isinstance(y, SubSelect):
                out.extend(n for n, _ in y.query.items)
                walk(y.query.where) if y.query.star else None
            elif isinstance(y, tuple):
                for z in y:
                    walk(z)
            elif hasattr(y, "__dataclass_fields__") and not isinstance(y, Iri | Exists | Call):
                for f in y.__dataclass_fields__:
                    walk(getattr(y, f))

        walk(p)
        return list(dict.fromkeys(out))

    @staticmethod
    def sort_keys(v: Val, up: bool) -> list[Column]:
        """Unbound first, numbers by value, else by bytes."""
        cols = [v.num, v.lex] if v.typ.kind == "term" else [v.lex if v.typ.kind in ("iri", "lang") else v.col]
        return [c.asc_nulls_first() if up else c.desc_nulls_last() for c in cols]

    def factors(self, p, scope: Scope) -> list[Solution]:
        """Patterns that share no variable, each on its own."""
        if isinstance(p, Join) and not variables(p.left) & variables(p.right):
            return self.factors(p.left, scope) + self.factors(p.right, scope)
        if isinstance(p, Bgp):
            parts: list[tuple[set[str], list[Triple]]] = []
            for t in p.triples:
                names, own = variables(Bgp((t,))), [t]
                for other in [x for x in parts if x[0] & names]:
                    parts.remove(other)
                    names, own = names | other[0], other[1] + own
                parts.append((names, own))
            return [self.pattern(Bgp(tuple(t for t in p.triples if t in own)), scope) for _, own in parts]
        return [self.pattern(p, scope)]

    def counted_product(self, q: Query, scope: Scope) -> Solution | None:
        """COUNT(*) over unrelated patterns as the product of their counts; None where that doesn't apply."""
        found = {a for _, e in q.items if e is not None for a in aggregates(e)}
        if q.group or q.having or q.order or len(found) != 1 or (a := next(iter(found))).arg is not None or a.distinct or any(e != a for _, e in q.items):
            return None
        if not isinstance(q.where, Join | Bgp) or scope.var is not None or len(parts := self.factors(q.where, scope)) < 2:
            return None
        each = [x.df.agg(F.count(F.lit(1)).alias("n")) for x in parts]
        rows = each[0]
        for x in each[1:]:
            rows = rows.union(x)
        product = F.aggregate(F.collect_list("n"), F.lit(1).cast("long"), lambda s, x: s * x)
        df = rows.agg(product.alias("n")).select(*(F.col("n").alias(name_of(n)) for n, _ in q.items))
        return Solution(df, {n: lit_type(INTEGER) for n, _ in q.items}, {n for n, _ in q.items})

    @staticmethod
    def named_beyond_counts(q: Query) -> set[str] | None:
        """Variables of keys, filters and such aggregates as don't see repeats, of a basic graph pattern whose rows are counted otherwise; None for other queries."""
        p, filters = q.where, []
        while isinstance(p, Filter):
            filters.append(p.condition)
            p = p.of
        keys = [e for _, e in q.group or []]
        found = [a for e in [e for _, e in q.items if e is not None] + q.having + [e for e, _ in q.order] for a in aggregates(e)]
        plain = [a for a in found if a.name == "COUNT" and not a.distinct and (a.arg is None or isinstance(a.arg, Var) and a.arg.name in variables(p))]
        rest = [a for a in found if a not in plain]
        if not isinstance(p, Bgp) or not plain or any(a.arg is None or not a.distinct and a.name not in ("MIN", "MAX", "SAMPLE") for a in rest):
            return None
        exprs = [*keys, *filters, *(a.arg for a in rest)]
        if any(_exists(e) or _calls(e) & {"RAND", "UUID", "STRUUID", "BNODE"} for e in exprs):  # one value for each row
            return None
        return set().union(*map(expr_vars, exprs))

    def counted(self, p, scope: Scope, needed: set[str]) -> Solution:
        if isinstance(p, Filter):
            return self.filter(self.counted(p.of, scope, needed), p.condition, scope)
        return self.bgp(p.triples, scope, needed)

    def grouped(self, x: Solution, q: Query, scope: Scope) -> tuple[Solution, dict]:
        """Groups with hidden columns for keys and aggregates; and what stands for each expression in the rest of the query."""
        swap: dict = {}
        keys: list[str] = []
        for i, (name, e) in enumerate(q.group or []):
            name = name or f"_k{i}"
            if not isinstance(e, Var) or e.name != name:
                x = self.extend(x, name, x.expressions(self.exists_in(x, scope)).value(e))
                swap[e] = Var(name)
            elif name not in x.types:
                x = self.extend(x, name, Val(TERM, F.lit(None).cast("string")))
            keys.append(name)
        found: dict[Agg, str] = {}
        for e in [e for _, e in q.items if e is not None] + q.having + [e for e, _ in q.order]:
            for a in aggregates(e):
                found.setdefault(a, f"_a{len(found)}")
        values = x.expressions(self.exists_in(x, scope))
        built = {name: self.aggregate(a, values, x) for a, name in found.items()}
        cols = [c.alias(name_of(n)) for n, (_, c) in built.items()] or [F.count(F.lit(1)).alias("_rows")]
        df = x.df.groupBy(*(column(k) for k in keys)).agg(*cols) if keys else x.df.agg(*cols)
        types = {k: x.types[k] for k in keys} | {n: t for n, (t, _) in built.items()}
        swap |= {a: Var(n) for a, n in found.items()}
        return Solution(df, types, x.certain & set(keys)), swap

    @staticmethod
    def aggregate(a: Agg, values: Expressions, x: Solution) -> tuple:
        if a.arg is None and not (WEIGHT in x.types and not a.distinct):
            if not a.distinct or not x.types:
                return lit_type(INTEGER), F.count(F.lit(1))
            return lit_type(INTEGER), F.count_distinct(F.struct(*(column(n) for n in sorted(x.types))))
        if a.name == "COUNT" and not a.distinct and WEIGHT in x.types:  # its variable is bound in every row
            return lit_type(INTEGER), F.coalesce(F.sum(column(WEIGHT)), F.lit(0).cast("long"))
        v = values.value(a.arg)
        if a.name == "COUNT":
            c = v.col
            return lit_type(INTEGER), F.count_distinct(c) if a.distinct else F.count(c)
        if a.name in ("SUM", "AVG"):
            n = v.num
            whole = v.typ == lit_type(INTEGER)
            if a.name == "AVG":
                n = n.cast("double")
                return lit_type(DOUBLE), F.try_divide(F.sum_distinct(n), F.count_distinct(n)) if a.distinct else F.avg(n)
            n = n if whole else n.cast("double")
            return v.typ if whole else lit_type(DOUBLE), F.coalesce(F.sum_distinct(n) if a.distinct else F.sum(n), F.lit(0) if whole else F.lit(0.0))
        if a.name in ("MIN", "MAX", "SAMPLE"):
            best = F.max if a.name == "MAX" else F.min
            if v.typ.kind != "term":
                return v.typ, best(v.col)
            # numbers by value before strings by bytes
            return TERM, best(F.when(v.col.isNotNull(), F.struct(v.num.isNull().alias("no"), v.num.alias("n"), v.lex.alias("l"), v.col.alias("t"))))["t"]
        text = F.collect_set(v.lex) if a.distinct else F.collect_list(v.lex)
        return lit_type(STRING), F.when(F.count(v.col) > 0, F.array_join(F.array_sort(text), a.separator))

    # -- other forms

    def described(self, q: Query) -> DataFrame:
        """Triples whose subject is one of the targets."""
        scope = Scope(tuple(q.default_graphs) if q.default_graphs else None, tuple(q.named_graphs) if q.named_graphs else None)
        parts = [self.values(Values(("s",), ((x,),))) for x in q.targets if isinstance(x, Iri)]
        names = [x.name for x in q.targets if isinstance(x, Var)]
        if names or q.star or q.where != UNIT:
            x = self.pattern(q.where, scope)
            names = [n for n in x.types if not Var(n).hidden] if q.star else names
            df = x.df.offset(q.offset) if q.offset else x.df
            df = df.limit(q.limit) if q.limit is not None else df
            for n in names:
                if n in x.types:
                    parts.append(Solution(df.select(column(n).alias(name_of("s"))).where(column("s").isNotNull()), {"s": x.types[n]}, {"s"}))
        if not parts:
            return self.source.triples(scope).limit(0)
        if len(parts) == 1 and len(q.targets) == 1 and isinstance(q.targets[0], Iri):
            # a constant subject reaches the scan
            own = self.source.star([Triple(q.targets[0], Var("p"), Var("o"))], Scope(scope.default, scope.named))
            return own.df.select(F.lit(q.targets[0].value).alias("s"), *(to_term(own.types[n], column(n)).alias(n) for n in "po"))
        wanted = union(parts)
        return self.source.triples(scope, Solution(wanted.df.distinct(), wanted.types, {"s"}))

    def constructed(self, q: Query) -> DataFrame:
        """Different triples of the template; blank nodes of the template are not supported."""
        x = self.select(Query("SELECT", where=q.where, star=True, order=q.order, limit=q.limit, offset=q.offset, default_graphs=q.default_graphs, named_graphs=q.named_graphs))
        parts = []
        for t in q.template:
            if any(isinstance(y, Var) and y.hidden for y in (t.s, t.p, t.o)):
                raise UnsupportedError("blank nodes in a CONSTRUCT template are not supported")
            cols = [x.expressions().value(y).term.alias(n) for n, y in zip("spo", (t.s, t.p, t.o))]
            parts.append(x.df.select(*cols).where("s is not null and p is not null and o is not null"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.where(~F.startswith("s", F.lit('"')) & ~F.startswith("p", F.lit('"'))).distinct()


def _bound(pairs: Solution, start, end) -> Solution:
    df = pairs.df
    for n, x in ((S, start), (O, end)):
        if x is not None:
            hit = matches(pairs.types[n], column(n), x)
            df = df.where(hit if hit is not None else F.lit(False))
    return Solution(df, pairs.types, pairs.certain)
