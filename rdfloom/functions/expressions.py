"""Expressions to columns. An error or an unbound value is null, so that Spark's three-valued logic is SPARQL's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rdfloom.errors import UnsupportedError
from rdfloom.functions.terms import BOOLEAN, DATE, DATETIME, DECIMAL, DOUBLE, INTEGER, LANG, NUMERIC, STRING, TERM, Typ, constant, convert, lex, lit_type, number, to_term, unify
from rdfloom.plans.algebra import XSD, Agg, Call, Exists, Iri, Lit, Var

ASCII_UP, ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Val:
    typ: Typ
    col: Column

    @property
    def lex(self) -> Column:
        return lex(self.typ, self.col)

    @property
    def num(self) -> Column:
        return number(self.typ, self.col)

    @property
    def term(self) -> Column:
        return to_term(self.typ, self.col)

    @property
    def is_literal(self) -> Column:
        return F.startswith(self.col, F.lit('"')) if self.typ.kind == "term" else F.when(self.col.isNotNull(), F.lit(self.typ.kind != "iri"))

    @property
    def string(self) -> Column:
        """Lexical form of a literal, null for others."""
        if self.typ.kind == "iri":
            return F.lit(None).cast("string")
        return F.when(self.is_literal, self.lex) if self.typ.kind == "term" else self.lex

    @property
    def truth(self) -> Column:
        """Effective boolean value."""
        if self.typ == lit_type(BOOLEAN):
            return self.col
        if self.typ.numeric:
            return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.typ == lit_type(STRING):
            return self.col != ""
        if self.typ.kind == "term":
            dt = _datatype(self)
            return F.when(dt == BOOLEAN, self.lex.isin("true", "1")).when(dt == STRING, self.lex != "").when(dt.isin(*sorted(NUMERIC)), self.num != 0)
        return F.lit(None).cast("boolean")


def _bool(c: Column) -> Val:
    return Val(lit_type(BOOLEAN), c)


def _str(c: Column) -> Val:
    return Val(lit_type(STRING), c)


def _int(c: Column) -> Val:
    return Val(lit_type(INTEGER), c.cast("long"))


def nothing() -> Val:
    return Val(TERM, F.lit(None).cast("string"))


def _datatype(v: Val) -> Column:
    if v.typ.kind == "lit":
        return F.when(v.col.isNotNull(), F.lit(v.typ.of))
    if v.typ.kind == "lang":
        return F.when(v.col.isNotNull(), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"))
    if v.typ.kind == "iri":
        return F.lit(None).cast("string")
    dt = F.regexp_extract(v.col, r'"\^\^<([^>]*)>$', 1)
    tagged = v.col.rlike(r'"@[A-Za-z0-9-]+$')
    return F.when(v.is_literal, F.when(dt != "", dt).when(tagged, F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).otherwise(F.lit(STRING)))


def _tag(v: Val) -> Column:
    if v.typ.kind == "lang":
        return v.col["tag"]
    if v.typ.kind == "term":
        return F.when(v.is_literal, F.regexp_extract(v.col, r'"@([A-Za-z0-9-]+)$', 1))
    return F.when(v.is_literal, F.lit("")) if v.typ.kind == "lit" else F.lit(None).cast("string")


def _time(v: Val) -> Column:
    if v.typ.kind == "lit" and v.typ.of in (DATETIME, DATE):
        return v.col.cast("timestamp")
    return F.try_to_timestamp(v.string) if v.typ.kind != "iri" and not v.typ.numeric else F.lit(None).cast("timestamp")


def equal(a: Val, b: Val) -> Column:
    """Value equality of numbers, term equality of everything else."""
    if a.typ == b.typ and a.typ.kind != "term":
        return a.col == b.col
    if a.typ.numeric and b.typ.numeric:
        return a.col == b.col
    times = {lit_type(DATETIME), lit_type(DATE)}
    if a.typ in times and b.typ in times:
        return _time(a) == _time(b)
    if a.typ.kind != "term" and b.typ.kind != "term" and not (a.typ.kind == b.typ.kind == "iri"):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if a.typ.numeric or b.typ.numeric or a.typ == b.typ == TERM:
        a_num, b_num = (F.when(_datatype(v).isin(*sorted(NUMERIC)), v.num) if v.typ == TERM else v.num for v in (a, b))
        return F.when(a_num.isNotNull() & b_num.isNotNull(), a_num == b_num).otherwise(a.term == b.term)
    return a.term == b.term


def less(a: Val, b: Val, op: str) -> Column:
    """Numbers by value, else strings by bytes; times by time."""
    compare: Callable[[Column, Column], Column] = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    times = {lit_type(DATETIME), lit_type(DATE)}
    if a.typ in times or b.typ in times:
        return compare(_time(a), _time(b))
    if a.typ.numeric and b.typ.numeric or a.typ == b.typ and a.typ.kind == "lit":
        return compare(a.col, b.col)
    if a.typ.kind == "lit" and b.typ.kind == "lit" and not (a.typ.numeric or b.typ.numeric):
        return compare(a.lex, b.lex)
    return F.when(a.num.isNotNull() & b.num.isNotNull(), compare(a.num, b.num)).otherwise(compare(a.string, b.string))


def unified(values: list[Val]) -> tuple[Typ, list[Column]]:
    typ = values[0].typ
    for v in values[1:]:
        typ = typ if v.typ == typ else lit_type(DOUBLE) if typ.numeric and v.typ.numeric else unify(typ, v.typ)
    return typ, [v.col.cast("double") if typ == lit_type(DOUBLE) and v.typ.numeric else convert(v.typ, v.col, typ) for v in values]


#: Functions of one's own: IRI -> builder from values to a value.
REGISTRY: dict[str, Callable[..., Val]] = {}


def register(iri: str, build: Callable[..., Val]) -> None:
    """Make a function of columns callable by its IRI."""
    REGISTRY[iri] = build


class Expressions:
    """Compiles expressions over the variables of one solution."""

    def __init__(self, lookup: Callable[[str], Val | None], exists: Callable[[Exists], Column] | None = None):
        self.lookup, self.exists = lookup, exists

    def value(self, e) -> Val:
        if isinstance(e, Var):
            return self.lookup(e.name) or nothing()
        if isinstance(e, Iri | Lit):
            return Val(*constant(e))
        if isinstance(e, Exists):
            if self.exists is None:
                raise UnsupportedError("EXISTS is not supported here")
            return _bool(self.exists(e))
        if isinstance(e, Agg):
            raise UnsupportedError(f"{e.name} is an aggregate and isn't allowed here")
        if e.name.startswith("CAST:"):
            return self.cast(e.name[5:], [self.value(a) for a in e.args])
        if e.name in _RAW:
            return _RAW[e.name](self, *e.args)
        return _VALUES[e.name](*(self.value(a) for a in e.args))

    def truth(self, e) -> Column:
        return self.value(e).truth

    def cast(self, iri: str, args: list[Val]) -> Val:
        if iri in REGISTRY:
            return REGISTRY[iri](*args)
        if len(args) != 1:
            raise UnsupportedError(f"unknown function <{iri}>")
        v = args[0]
        if iri == STRING:
            return _str(v.lex)
        if iri == BOOLEAN:
            return _bool(v.col if v.typ == lit_type(BOOLEAN) else v.num != 0 if v.typ.numeric else F.when(v.string.isin("true", "1"), True).when(v.string.isin("false", "0"), False))
        source = F.when(v.col, 1.0).otherwise(0.0) if v.typ == lit_type(BOOLEAN) else v.num
        if iri == INTEGER:
            return _int(source.cast("double").try_cast("long") if v.typ.numeric and v.typ.of != INTEGER else v.col if v.typ.numeric else source.try_cast("long"))
        if iri in (DOUBLE, DECIMAL, XSD + "float"):
            return Val(lit_type(iri), source.cast("double"))
        if iri == DATETIME:
            return Val(lit_type(DATETIME), _time(v))
        if iri == DATE:
            return Val(lit_type(DATE), _time(v).cast("date"))
        raise UnsupportedError(f"unknown function <{iri}>")


def _if(x: Expressions, c, a, b) -> Val:
    typ, cols = unified([x.value(a), x.value(b)])
    return Val(typ, F.when(F.coalesce(x.truth(c), F.lit(False)), cols[0]).otherwise(cols[1]))


def _coalesce(x: Expressions, *args) -> Val:
    if not args:
        return nothing()
    typ, cols = unified([x.value(a) for a in args])
    return Val(typ, F.coalesce(*cols))


def _in(x: Expressions, e, *items) -> Val:
    if not items:
        return _bool(F.lit(False))
    v, found = x.value(e), [x.value(i) for i in items]
    if all(isinstance(i, Lit) and f.typ == v.typ for i, f in zip(items, found)):
        return _bool(v.col.isin(*(f.col for f in found)))
    out = equal(v, found[0])
    for f in found[1:]:
        out = out | equal(v, f)
    return _bool(out)


#: What takes its arguments as expressions.
_RAW = {
    "BOUND": lambda x, v: _bool(x.value(v).col.isNotNull()),
    "IF": _if,
    "COALESCE": _coalesce,
    "IN": _in,
    "&&": lambda x, a, b: _bool(x.truth(a) & x.truth(b)),
    "||": lambda x, a, b: _bool(x.truth(a) | x.truth(b)),
    "!": lambda x, a: _bool(~x.truth(a)),
}


def _arithmetic(op: Callable[[Column, Column], Column]):
    def build(a: Val, b: Val) -> Val:
        whole = a.typ == b.typ == lit_type(INTEGER)
        return Val(lit_type(INTEGER), op(a.col.cast("long"), b.col.cast("long"))) if whole else Val(lit_type(DECIMAL), op(a.num.cast("double"), b.num.cast("double")))

    return build


def _divide(a: Val, b: Val) -> Val:
    return Val(lit_type(DECIMAL), F.try_divide(a.num.cast("double"), b.num.cast("double")))


def _rounding(f: Callable[[Column], Column]):
    def build(v: Val) -> Val:
        return v if v.typ == lit_type(INTEGER) else Val(lit_type(DECIMAL), f(v.num.cast("double")).cast("double"))

    return build


def _replace(v: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    return _str(F.regexp_replace(v.string, _pattern(pattern, flags), by.string))


def _pattern(pattern: Val, flags: Val | None) -> Column:
    if flags is None:
        return pattern.string
    own = F.regexp_replace(flags.string, "[^imsx]", "")
    return F.when(own == "", pattern.string).otherwise(F.concat(F.lit("(?"), own, F.lit(")"), pattern.string))


def _substr(v: Val, start: Val, length: Val | None = None) -> Val:
    """1-based; a start below 1 counts as 1 before the length is applied."""
    at = F.greatest(start.num.cast("int"), F.lit(1))
    return _str(F.substring(v.string, at, F.length(v.string) if length is None else F.greatest(length.num.cast("int"), F.lit(0))))


def _before(v: Val, mark: Val) -> Val:
    at = F.position(mark.string, v.string)
    return _str(F.when((at > 0) & (mark.string != ""), F.substring(v.string, F.lit(1), at - 1)).when(at.isNotNull(), F.lit("")))


def _after(v: Val, mark: Val) -> Val:
    at = F.position(mark.string, v.string)
    return _str(F.when(mark.string == "", v.string).when(at > 0, F.substring(v.string, at + F.length(mark.string), F.length(v.string))).when(at.isNotNull(), F.lit("")))


def _encode(v: Val) -> Val:
    """Percent-encoding of all but unreserved characters; url_encode is form encoding."""
    out = F.url_encode(v.lex)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return _str(out)


def _same(a: Val, b: Val) -> Val:
    if a.typ == b.typ:
        return _bool(a.col == b.col)
    return _bool(a.term == b.term)


def _langmatches(tag: Val, wanted: Val) -> Val:
    a, b = F.lower(tag.string), F.lower(wanted.string)
    return _bool(F.when(b == "*", a != "").otherwise((a == b) | F.startswith(a, F.concat(b, F.lit("-")))))


def _iri(v: Val) -> Val:
    return v if v.typ.kind == "iri" else Val(TERM, v.lex)


def _strdt(v: Val, dt: Val) -> Val:
    return Val(TERM, F.concat(F.lit('"'), v.string, F.lit('"^^<'), dt.lex, F.lit(">")))


def _timezone(v: Val) -> Val:
    """The offset of a time as a duration; without one, an error."""
    part = lambda i: F.regexp_extract(v.lex, r"([+-])(\d\d):(\d\d)$", i)
    hours, minutes = (F.coalesce(part(i).try_cast("int"), F.lit(0)) for i in (2, 3))
    size = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    none = (hours == 0) & (minutes == 0)
    text = F.when(none, "PT0S").otherwise(F.concat(F.when(part(1) == "-", "-").otherwise(""), F.lit("PT"), size(hours, "H"), size(minutes, "M")))
    known = _time(v).isNotNull() & v.lex.rlike(r"(Z|[+-]\d\d:\d\d)$")
    return Val(TERM, F.when(known, F.concat(F.lit('"'), text, F.lit('"^^<http://www.w3.org/2001/XMLSchema#dayTimeDuration>'))))


def _kind(f: Callable[[Val], Column]):
    return lambda v: _bool(F.when(v.col.isNotNull(), f(v)))


def _is_numeric(v: Val) -> Column:
    return F.lit(v.typ.numeric) if v.typ.kind != "term" else F.coalesce(_datatype(v).isin(*sorted(NUMERIC)) & v.num.isNotNull(), F.lit(False))


_VALUES = {
    "=": lambda a, b: _bool(equal(a, b)),
    "!=": lambda a, b: _bool(~equal(a, b)),
    **{op: (lambda a, b, op=op: _bool(less(a, b, op))) for op in ("<", "<=", ">", ">=")},
    "+": _arithmetic(lambda x, y: x + y),
    "-": _arithmetic(lambda x, y: x - y),
    "*": _arithmetic(lambda x, y: x * y),
    "/": _divide,
    "NEG": lambda v: Val(v.typ, -v.col) if v.typ.numeric else Val(lit_type(DECIMAL), -v.num),
    "ABS": _rounding(F.abs),
    "CEIL": _rounding(F.ceil),
    "FLOOR": _rounding(F.floor),
    "ROUND": _rounding(lambda x: F.round(x, 0)),
    "STR": lambda v: _str(v.lex),
    "LANG": lambda v: _str(_tag(v)),
    "DATATYPE": lambda v: Val(TERM, _datatype(v)),
    "LANGMATCHES": _langmatches,
    "IRI": _iri,
    "URI": _iri,
    "STRLEN": lambda v: _int(F.length(v.string)),
    "SUBSTR": _substr,
    "UCASE": lambda v: _str(F.upper(v.string)),
    "LCASE": lambda v: _str(F.lower(v.string)),
    "CONCAT": lambda *v: _str(F.concat(*(x.string for x in v)) if v else F.lit("")),
    "CONTAINS": lambda a, b: _bool(F.contains(a.string, b.string)),
    "STRSTARTS": lambda a, b: _bool(F.startswith(a.string, b.string)),
    "STRENDS": lambda a, b: _bool(F.endswith(a.string, b.string)),
    "STRBEFORE": _before,
    "STRAFTER": _after,
    "REPLACE": _replace,
    "REGEX": lambda v, p, f=None: _bool(F.rlike(v.string, _pattern(p, f))),
    "ENCODE_FOR_URI": _encode,
    "YEAR": lambda v: _int(F.year(_time(v))),
    "MONTH": lambda v: _int(F.month(_time(v))),
    "DAY": lambda v: _int(F.dayofmonth(_time(v))),
    "HOURS": lambda v: _int(F.hour(_time(v))),
    "MINUTES": lambda v: _int(F.minute(_time(v))),
    "SECONDS": lambda v: Val(lit_type(DECIMAL), F.date_part(F.lit("SECOND"), _time(v)).cast("double")),
    "TZ": lambda v: _str(F.when(_time(v).isNotNull(), F.coalesce(F.regexp_extract(v.lex, r"(Z|[+-]\d\d:\d\d)$", 1), F.lit("")))),
    "TIMEZONE": _timezone,
    "BNODE": lambda: Val(TERM, F.concat(F.lit("_:b"), F.replace(F.uuid(), F.lit("-"), F.lit("")))),
    "NOW": lambda: Val(lit_type(DATETIME), F.current_timestamp()),
    "ISIRI": _kind(lambda v: ~F.startswith(v.col, F.lit('"')) & ~F.startswith(v.col, F.lit("_:")) if v.typ.kind == "term" else F.lit(v.typ.kind == "iri")),
    "ISLITERAL": _kind(lambda v: v.is_literal),
    "ISBLANK": _kind(lambda v: F.startswith(v.col, F.lit("_:")) if v.typ.kind == "term" else F.lit(False)),
    "ISNUMERIC": _kind(_is_numeric),
    "SAMETERM": _same,
    "STRDT": _strdt,
    "STRLANG": lambda v, t: Val(LANG, F.struct(v.string.alias("lex"), t.string.alias("tag"))),
    "MD5": lambda v: _str(F.md5(v.string)),
    "SHA1": lambda v: _str(F.sha1(v.string)),
    "SHA256": lambda v: _str(F.sha2(v.string, 256)),
    "SHA384": lambda v: _str(F.sha2(v.string, 384)),
    "SHA512": lambda v: _str(F.sha2(v.string, 512)),
    "RAND": lambda: Val(lit_type(DOUBLE), F.rand()),
    "UUID": lambda: Val(TERM, F.concat(F.lit("urn:uuid:"), F.uuid())),
    "STRUUID": lambda: _str(F.uuid()),
}
_VALUES["ISURI"] = _VALUES["ISIRI"]
