"""Solutions: a DataFrame with a column for each variable, and the joins of SPARQL on them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.functions.expressions import Expressions, Val
from rdfloom.functions.terms import LANG, TERM, Typ, convert, unify


def name_of(var: str, side: str = "v") -> str:
    """Column of a variable; sides keep the two columns of a shared variable apart inside a join."""
    return f"{side}_" + "".join(c if c.isalnum() or c == "_" else f"${ord(c):x}" for c in var)


def column(var: str, side: str = "v") -> Column:
    return F.col(name_of(var, side))


@dataclass
class Solution:
    """certain: variables that are never null."""

    df: DataFrame
    types: dict[str, Typ]
    certain: set[str]

    def val(self, var: str) -> Val | None:
        return Val(self.types[var], column(var)) if var in self.types else None

    def expressions(self, exists=None) -> Expressions:
        return Expressions(self.val, exists)

    def only(self, names: Iterable[str]) -> Solution:
        names = [n for n in names if n in self.types]
        return Solution(self.df.select(*(column(n) for n in names)) if names else self.df.select(F.lit(1).alias("_one")), {n: self.types[n] for n in names}, self.certain & set(names))

    def as_types(self, types: dict[str, Typ]) -> Solution:
        """With columns converted, and nulls for variables that are not here."""
        cols = [(convert(self.types[n], column(n), t) if n in self.types else null_of(t)).alias(name_of(n)) for n, t in types.items()]
        return Solution(self.df.select(*cols) if cols else self.df.select(F.lit(1).alias("_one")), dict(types), self.certain & set(types))


def null_of(t: Typ) -> Column:
    if t == LANG:
        return F.lit(None).cast("struct<lex:string,tag:string>")
    return F.lit(None) if t.kind in ("lit", "iri") else F.lit(None).cast("string")


def unit(spark: SparkSession) -> Solution:
    """One row without variables."""
    return Solution(spark.range(1).select(F.lit(1).alias("_one")), {}, set())


def empty(spark: SparkSession, names: Iterable[str]) -> Solution:
    names = sorted(names)
    schema = T.StructType([T.StructField(name_of(n), T.StringType()) for n in names] or [T.StructField("_one", T.IntegerType())])
    return Solution(spark.createDataFrame([], schema), {n: TERM for n in names}, set(names))


def guard(df: DataFrame) -> Solution:
    """No variables; a row if df has any."""
    return Solution(df.limit(1).select(F.lit(1).alias("_one")), {}, set())


def _sides(left: Solution, right: Solution) -> tuple[DataFrame, DataFrame, dict[str, Typ], list[str], list[Column]]:
    """Both sides with shared variables of equal types, those of the right renamed; all types; shared; conditions."""
    shared = [n for n in right.types if n in left.types]
    types = {n: unify(t, right.types[n]) if n in right.types else t for n, t in left.types.items()} | {n: t for n, t in right.types.items() if n not in left.types}
    l = left.as_types({n: types[n] for n in left.types}).df
    r = right.df.select(*(convert(right.types[n], column(n), types[n]).alias(name_of(n, "r" if n in shared else "v")) for n in right.types)) if right.types else right.df.select(F.lit(1).alias("_two"))
    on = []
    for n in shared:
        same = column(n) == column(n, "r")
        if n not in left.certain:
            same = same | column(n).isNull()
        if n not in right.certain:
            same = same | column(n, "r").isNull()
        on.append(same)
    return l, r, types, shared, on


#: Combinations of bound and unbound shared variables that a join is split into; beyond that, unbound is tested row by row.
MOST_PARTS = 4


def _parts(left: Solution, right: Solution, l: DataFrame, r: DataFrame, shared: list[str], rights: bool = True) -> list[tuple[DataFrame, DataFrame, list[Column]]] | None:
    """Both sides split by which shared variables are bound, with plain equalities for each pair of parts; None if there are too many, or if nothing is uncertain.

    rights: whether the right side may be split too (its parts then meet every row of the left again).
    """

    def split(df: DataFrame, uncertain: list[str], side: str) -> list[tuple[DataFrame, set[str]]]:
        out: list[tuple[DataFrame, set[str]]] = [(df, set())]
        for n in uncertain:
            c = column(n, side)
            out = [y for d, unbound in out for y in ((d.where(c.isNotNull()), unbound), (d.where(c.isNull()), unbound | {n}))]
        return out

    loose = [[n for n in shared if n not in x.certain] for x in (left, right)]
    if not (loose[0] or loose[1]) or 2 ** (len(loose[0]) + len(loose[1])) > MOST_PARTS or loose[1] and not rights:
        return None
    return [(a, b, [column(n) == column(n, "r") for n in shared if n not in x | y]) for a, x in split(l, loose[0], "v") for b, y in split(r, loose[1], "r")]


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _merged(df: DataFrame, types: dict[str, Typ], shared: list[str], left: Solution) -> DataFrame:
    cols = [(F.coalesce(column(n), column(n, "r")) if n in shared and n not in left.certain else column(n)).alias(name_of(n)) for n in types]
    return df.select(*cols) if cols else df.select(F.lit(1).alias("_one"))


def join(left: Solution, right: Solution) -> Solution:
    """Unbound is compatible with everything; plain equi-join where shared variables are certain."""
    if not left.types and not right.types:
        return Solution(left.df.crossJoin(right.df.select(F.lit(1).alias("_two"))).select("_one"), {}, set())
    l, r, types, shared, on = _sides(left, right)
    if parts := _parts(left, right, l, r, shared):
        both = _together([a.join(b, _all(c)) if c else a.crossJoin(b) for a, b, c in parts])
    else:
        both = l.join(r, _all(on)) if on else l.crossJoin(r)
    return Solution(_merged(both, types, shared, left), types, left.certain | right.certain)


def left_join(left: Solution, right: Solution, condition=None) -> Solution:
    """OPTIONAL; condition: an expression over the variables of both sides."""
    l, r, types, shared, on = _sides(left, right)
    extra: list[Column] = []
    if condition is not None:

        def val(n: str) -> Val | None:
            if n not in types:
                return None
            return Val(types[n], F.coalesce(column(n), column(n, "r")) if n in shared and n not in left.certain else column(n))

        extra = [Expressions(val).truth(condition)]
    on = [*on, *extra]
    if parts := _parts(left, right, l, r, shared, rights=False):
        both = _together([a.join(b, _all([*c, *extra]) if c or extra else F.lit(True), "left") for a, b, c in parts])
    else:
        both = l.join(r, _all(on), "left") if on else l.join(r, F.lit(True), "left")
    return Solution(_merged(both, types, shared, left), types, set(left.certain))


def semi_join(left: Solution, right: Solution, anti: bool = False, condition=None, minus: bool = False) -> Solution:
    """EXISTS, NOT EXISTS, and MINUS (whose sides need a variable bound on both)."""
    l, r, types, shared, on = _sides(left, right)
    extra: list[Column] = []
    if minus:
        if not shared:
            return left
        if not any(n in left.certain and n in right.certain for n in shared):
            bound = [column(n).isNotNull() & column(n, "r").isNotNull() for n in shared]
            some = bound[0]
            for b in bound[1:]:
                some = some | b
            extra.append(some)
    if condition is not None:
        extra.append(Expressions(lambda n: Val(types[n], column(n)) if n in types else None).truth(condition))
    kind, on = "left_anti" if anti else "left_semi", [*on, *extra]
    if parts := _parts(left, right, l, r, shared, rights=False):
        out = _together([a.join(b, _all([*c, *extra]) if c or extra else F.lit(True), kind) for a, b, c in parts])
    else:
        out = l.join(r, _all(on) if on else F.lit(True), kind)
    return Solution(out, {n: types[n] for n in left.types}, set(left.certain))


def union(parts: list[Solution]) -> Solution:
    """Bag union; columns that a part doesn't have are null there."""
    if len(parts) == 1:
        return parts[0]
    types: dict[str, Typ] = {}
    for p in parts:
        for n, t in p.types.items():
            types[n] = unify(types[n], t) if n in types else t
    out, *rest = (p.as_types(types) for p in parts)
    df = out.df
    for p in rest:
        df = df.union(p.df)
    return Solution(df, types, set.intersection(*(p.certain for p in parts)))
