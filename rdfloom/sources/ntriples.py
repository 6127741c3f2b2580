"""N-Triples and N-Quads, read and written with column expressions only."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A subject or graph, a predicate, an object, of one line.
_NODE = r"(<[^>\s]*>|_:[^\s<>\"]+)"
_IRI = r"<([^>\s]*)>"
_OBJECT = r"(<[^>\s]*>|_:[^\s<>\"]+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^<[^>\s]*>)?)"
LINE = rf"^\s*{_NODE}\s*{_IRI}\s*{_OBJECT}\s*{_NODE}?\s*\.\s*(?:#.*)?$"
#: Labels that generators hand out in every file: short ones and plain numbers.
RISKY = r"^_:(?:[A-Za-z]{0,2}\d+|.{1,3})$"
FORMATS = {".nt": "triples", ".ntriples": "triples", ".nq": "quads", ".nquads": "quads"}


@dataclass(frozen=True)
class Input:
    """A file (or folder, or pattern) and the graph that its triples go to; N-Quads name their own."""

    path: str
    graph: str | None = None

    @classmethod
    def parse(cls, line: str) -> Input:
        path, _, graph = line.strip().partition(" ")
        return cls(path, graph.strip().removeprefix("<").removesuffix(">") or None)


def input_list(lines) -> list[Input]:
    """Inputs of a list: a path and perhaps a graph on each line, # for comments."""
    return [Input.parse(x) for x in lines if x.strip() and not x.lstrip().startswith("#")]


def format_of(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    kind = FORMATS.get("." + name.rpartition(".")[2]) if "." in Path(name).name else None
    if kind is None and not path.lower().endswith(".gz"):
        warnings.warn(f"{path}: unknown extension, read as N-Triples", stacklevel=2)
    return kind or "triples"


def _unescaped(c: Column) -> Column:
    """Backslash escapes, decoded; only values that have any pay for it."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))

    def code(hexes: Column) -> Column:
        """UTF-8 of a code point."""
        n = F.conv(hexes, 16, 10).cast("int")
        byte = lambda x: F.lpad(F.hex(x), 2, "0")
        tail = lambda shift: F.lit(0x80).bitwiseOR(F.shiftright(n, shift).bitwiseAND(F.lit(0x3F)))
        two = F.concat(byte(F.lit(0xC0).bitwiseOR(F.shiftright(n, 6))), byte(tail(0)))
        three = F.concat(byte(F.lit(0xE0).bitwiseOR(F.shiftright(n, 12))), byte(tail(6)), byte(tail(0)))
        four = F.concat(byte(F.lit(0xF0).bitwiseOR(F.shiftright(n, 18))), byte(tail(12)), byte(tail(6)), byte(tail(0)))
        return F.decode(F.unhex(F.when(n < 0x80, byte(n)).when(n < 0x800, two).when(n < 0x10000, three).otherwise(four)), "UTF-8")

    named = F.create_map(*(F.lit(x) for pair in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")) for x in pair))
    one = lambda x: F.when(~F.startswith(x, F.lit("\\")), x).when(x.rlike(r"^\\[uU][0-9A-Fa-f]{4}"), code(F.substring(x, 3, 8))).otherwise(F.coalesce(F.get(F.array(named[x]), 0), F.substring(x, 2, 1)))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(parts, one), "")).otherwise(c)


def _term(c: Column) -> Column:
    """A term of a line in canonical form."""
    quoted = F.regexp_extract(c, r'(?s)^"(.*)"((?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 1)
    end = F.regexp_extract(c, r'(?s)^"(.*)"((?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 2)
    end = F.when(end == "^^<http://www.w3.org/2001/XMLSchema#string>", "").when(F.startswith(end, F.lit("@")), F.lower(end)).otherwise(end)
    iri = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when(F.startswith(c, F.lit("<")), _unescaped(iri)).when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit('"'), _unescaped(quoted), F.lit('"'), end))


def parse(lines: DataFrame, graph: str | None = None, quads: bool = False) -> DataFrame:
    """(s, p, o, g, bad, line) of a column of lines; comments and blank lines are left out, bad ones flagged."""
    text = lines.toDF("line").where(~F.col("line").rlike(r"^\s*(?:#.*)?$"))
    text = text.select("line", *(F.regexp_extract("line", LINE, i).alias(f"part{i}") for i in range(1, 5)))  # once for all that is made of them
    part = lambda i: F.col(f"part{i}")
    ok = part(1) != ""
    own = F.when(part(4) != "", _term(part(4))) if quads else F.lit(None).cast("string")
    g = F.coalesce(own, F.lit(graph)) if graph and not quads else own
    if not quads:
        ok = ok & (part(4) == "")
    return text.select(*(F.when(ok, x).alias(n) for n, x in (("s", _term(part(1))), ("p", _unescaped(part(2))), ("o", _term(part(3))), ("g", g))), (~ok).alias("bad"), "line")


def read(spark: SparkSession, inputs: list[Input | str], report: bool = False) -> DataFrame:
    """Quads of all inputs, without repeats. Bad lines are left out; report: count them and risky blank labels, and warn."""
    parts = []
    for x in (Input(i) if isinstance(i, str) else i for i in inputs):
        parts.append(parse(spark.read.text(x.path), x.graph, format_of(x.path) == "quads"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    if report:
        seen = rows.agg(F.count_if("bad").alias("bad"), F.count_if(F.col("s").rlike(RISKY) | F.col("o").rlike(RISKY)).alias("risky")).first()
        if seen.bad:
            some = [r.line for r in rows.where("bad").select("line").limit(10).collect()]
            warnings.warn(f"{seen.bad} malformed lines left out, such as {some}", stacklevel=2)
        if seen.risky and len(parts) > 1:
            warnings.warn(f"{seen.risky} triples have blank node labels that other files may use too", stacklevel=2)
    return rows.where(~F.col("bad")).select("s", "p", "o", "g").dropDuplicates()


def _written(c: Column) -> Column:
    lexical = F.regexp_extract(c, r'(?s)^"(.*)"((?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 1)
    end = F.regexp_extract(c, r'(?s)^"(.*)"((?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 2)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        lexical = F.replace(lexical, F.lit(a), F.lit(b))
    return F.when(F.startswith(c, F.lit('"')), F.concat(F.lit('"'), lexical, F.lit('"'), end)).when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def lines(quads: DataFrame) -> DataFrame:
    """N-Triples, or N-Quads where g is not null, in a column value."""
    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), _written(F.col("g")))).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(_written(F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), _written(F.col("o")), g, F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, compression: str = "none") -> None:
    lines(quads).write.mode("overwrite").option("compression", compression).text(path)


def risky_label(label: str) -> bool:
    return bool(re.match(RISKY, label))
