"""Types of variables, and columns of RDF terms.

A variable is one column whose type is known while the query is compiled:

* ``lit``: a native Spark value of one datatype (long, double, string, timestamp ...),
* ``lang``: struct of lex and tag,
* ``iri``: the native key of an IRI template such as ``http://.../customer/{}``,
* ``term``: any term as a string: a bare IRI, ``_:label``, ``"lex"``, ``"lex"@tag``
  or ``"lex"^^<datatype>`` (lex is not escaped; the last quote ends it).

Joins, filters and aggregates work on native columns wherever both sides are; a
native column turns into a term only where types meet that differ.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rdfloom.plans.algebra import XSD, Iri, Lit

INTEGER, DECIMAL, DOUBLE, BOOLEAN, STRING, DATETIME, DATE = (XSD + x for x in ("integer", "decimal", "double", "boolean", "string", "dateTime", "date"))
NUMERIC = {INTEGER, DECIMAL, DOUBLE, XSD + "float", XSD + "long", XSD + "int", XSD + "short", XSD + "byte", XSD + "nonNegativeInteger", XSD + "positiveInteger", XSD + "negativeInteger", XSD + "nonPositiveInteger", XSD + "unsignedInt", XSD + "unsignedLong"}


@dataclass(frozen=True)
class Typ:
    kind: str  # lit, lang, iri, term
    of: str = ""  # datatype of lit, template of iri
    key: str = "string"  # of iri: long or string

    @property
    def numeric(self) -> bool:
        return self.kind == "lit" and self.of in NUMERIC


TERM, LANG = Typ("term"), Typ("lang")


def lit_type(dt: str) -> Typ:
    return Typ("lit", dt)


def datatype_of(kind: T.DataType) -> str:
    """Datatype of a table's column."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return INTEGER
    if isinstance(kind, T.FloatType | T.DoubleType):
        return DOUBLE
    if isinstance(kind, T.DecimalType):
        return DECIMAL
    if isinstance(kind, T.BooleanType):
        return BOOLEAN
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return DATETIME
    return DATE if isinstance(kind, T.DateType) else STRING


#: Of a term's string: its lexical form, tag and datatype.
_LEX, _TAG, _DT = r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', r'"@([A-Za-z0-9-]+)$', r'"\^\^<([^>]*)>$'


def number_text(x: Column) -> Column:
    """Shortest form of a number: 6 and not 6.0."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.floor(x).cast("long").cast("string")).otherwise(x.cast("string"))


def lex(typ: Typ, c: Column) -> Column:
    """Lexical form (of an IRI the IRI itself)."""
    if typ.kind == "lang":
        return c["lex"]
    if typ.kind == "iri":
        before, _, after = typ.of.partition("{}")
        return F.concat(F.lit(before), c.cast("string"), F.lit(after))
    if typ.kind == "term":
        return F.when(F.startswith(c, F.lit('"')), F.regexp_extract(c, _LEX, 1)).otherwise(c)
    if typ.of in (DOUBLE, DECIMAL, XSD + "float"):
        return number_text(c)
    if typ.of == DATETIME:
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, F.rtrim(micros, F.lit("0"))))
    return c.cast("string")


def to_term(typ: Typ, c: Column) -> Column:
    if typ.kind == "term":
        return c
    if typ.kind == "iri":
        return lex(typ, c)
    if typ.kind == "lang":
        return F.concat(F.lit('"'), c["lex"], F.lit('"@'), c["tag"])
    end = '"' if typ.of == STRING else f'"^^<{typ.of}>'
    return F.concat(F.lit('"'), lex(typ, c), F.lit(end))


def number(typ: Typ, c: Column) -> Column:
    """Number of a value, null if it is none."""
    if typ.numeric:
        return c
    if typ.kind == "iri" or typ.kind == "lit" and typ.of in (BOOLEAN, DATETIME, DATE):
        return F.lit(None).cast("double")
    is_lit = F.startswith(c, F.lit('"')) if typ.kind == "term" else F.lit(True)
    return F.when(is_lit, lex(typ, c).try_cast("double"))


def term_string(x: Iri | Lit) -> str:
    if isinstance(x, Iri):
        return x.value
    return f'"{x.value}"' + (f"@{x.lang}" if x.lang else f"^^<{x.datatype}>" if x.datatype else "")


def constant(x: Iri | Lit) -> tuple[Typ, Column]:
    """A constant as a typed column."""
    if isinstance(x, Iri):
        return TERM, F.lit(x.value)
    if x.lang:
        return LANG, F.struct(F.lit(x.value).alias("lex"), F.lit(x.lang).alias("tag"))
    dt = x.datatype or STRING
    try:
        if dt == INTEGER and abs(int(x.value)) < 1 << 63:
            return lit_type(INTEGER), F.lit(int(x.value)).cast("long")
        if dt in NUMERIC:
            return lit_type(dt), F.lit(float(x.value))
    except ValueError:
        return TERM, F.lit(term_string(x))
    if dt == BOOLEAN and x.value in ("true", "false", "1", "0"):
        return lit_type(BOOLEAN), F.lit(x.value in ("true", "1"))
    if dt == STRING:
        return lit_type(STRING), F.lit(x.value)
    if dt == DATETIME:
        return lit_type(DATETIME), F.try_to_timestamp(F.lit(x.value))
    if dt == DATE:
        return lit_type(DATE), F.lit(x.value).try_cast("date")
    return TERM, F.lit(term_string(x))


def matches(typ: Typ, c: Column, x: Iri | Lit) -> Column | None:
    """Condition that c is the constant x; None: never. Numbers are matched by value."""
    if typ.kind == "term":
        return c == term_string(x)
    if typ.kind == "iri":
        before, _, after = typ.of.partition("{}")
        if not isinstance(x, Iri) or not x.value.startswith(before) or not x.value.endswith(after) or len(x.value) <= len(before) + len(after):
            return None
        key = x.value[len(before) : len(x.value) - len(after)]
        if typ.key == "long":  # the literal stays on its side, so that the scan can skip by it
            return c == F.lit(int(key)) if re.fullmatch(r"0|-?[1-9]\d{0,17}", key) else None
        return c == key
    if isinstance(x, Iri):
        return None
    if typ.kind == "lang":
        return (c["lex"] == x.value) & (F.lower(c["tag"]) == x.lang) if x.lang else None
    if x.lang:
        return None
    other, value = constant(x)
    if typ.numeric and other.numeric:
        return c == value
    return c == value if typ == other else None


def unify(a: Typ, b: Typ) -> Typ:
    return a if a == b else TERM


def convert(typ: Typ, c: Column, to: Typ) -> Column:
    return c if typ == to else to_term(typ, c)
