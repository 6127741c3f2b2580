"""Results as SPARQL JSON, XML, CSV, TSV and N-Triples; written row by row, or by executors."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rdfloom.engine import Result
from rdfloom.sources import ntriples

_LITERAL = re.compile(r'"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?\Z', re.S)
FORMATS = {
    "json": "application/sparql-results+json",
    "xml": "application/sparql-results+xml",
    "csv": "text/csv; charset=utf-8",
    "tsv": "text/tab-separated-values; charset=utf-8",
    "nt": "application/n-triples",
}


def binding(term: str) -> dict[str, str]:
    """A term as JSON results have it."""
    if term.startswith('"') and (m := _LITERAL.match(term)):
        out = {"type": "literal", "value": m[1]}
        return out | ({"xml:lang": m[2]} if m[2] else {"datatype": m[3]} if m[3] else {})
    return {"type": "bnode", "value": term[2:]} if term.startswith("_:") else {"type": "uri", "value": term}


def ntriples_term(term: str) -> str:
    if term.startswith('"') and (m := _LITERAL.match(term)):
        text = m[1]
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = text.replace(a, b)
        return f'"{text}"' + (f"@{m[2]}" if m[2] else f"^^<{m[3]}>" if m[3] else "")
    return term if term.startswith("_:") else f"<{term}>"


def as_json(r: Result) -> Iterator[str]:
    if r.form == "ASK":
        yield json.dumps({"head": {}, "boolean": r.boolean})
        return
    head: dict = {"vars": r.names}
    yield f'{{"head": {json.dumps(head)}, "results": {{"bindings": ['
    for i, row in enumerate(r.rows()):
        yield ("," if i else "") + json.dumps({n: binding(t) for n, t in zip(r.names, row) if t is not None}, ensure_ascii=False)
    yield "]}" + (f', "hints": {json.dumps(r.hints)}' if r.hints else "") + "}"


def as_xml(r: Result) -> Iterator[str]:
    yield '<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#">\n<head>'
    yield "".join(f"<variable name={quoteattr(n)}/>" for n in r.names if r.form != "ASK") + "</head>\n"
    if r.form == "ASK":
        yield f"<boolean>{str(r.boolean).lower()}</boolean>\n</sparql>\n"
        return
    yield "<results>\n"
    for row in r.rows():
        cells = []
        for n, t in zip(r.names, row):
            if t is not None:
                b = binding(t)
                at = f" xml:lang={quoteattr(b['xml:lang'])}" if "xml:lang" in b else f" datatype={quoteattr(b['datatype'])}" if "datatype" in b else ""
                cells.append(f"<binding name={quoteattr(n)}><{b['type']}{at}>{escape(b['value'])}</{b['type']}></binding>")
        yield f"<result>{''.join(cells)}</result>\n"
    yield "</results>\n</sparql>\n"


def as_tsv(r: Result) -> Iterator[str]:
    if r.form == "ASK":
        yield f"{str(r.boolean).lower()}\n"
        return
    yield "\t".join("?" + n for n in r.names) + "\n"
    for row in r.rows():
        yield "\t".join("" if t is None else ntriples_term(t) for t in row) + "\n"


def as_csv(r: Result) -> Iterator[str]:
    if r.form == "ASK":
        yield f"{str(r.boolean).lower()}\r\n"
        return
    for row in (r.names, *([("" if t is None else binding(t)["value"]) for t in row] for row in r.rows())):
        out = io.StringIO()
        csv.writer(out).writerow(row)
        yield out.getvalue()


def as_ntriples(r: Result) -> Iterator[str]:
    for s, p, o in r.rows():
        yield f"{ntriples_term(s)} <{p}> {ntriples_term(o)} .\n"


def serialise(r: Result, form: str) -> Iterator[str]:
    if r.form in ("DESCRIBE", "CONSTRUCT") and form in ("nt", "xml"):
        return as_ntriples(r)
    try:
        return {"json": as_json, "xml": as_xml, "csv": as_csv, "tsv": as_tsv, "nt": as_ntriples}[form](r)
    except KeyError:
        raise ValueError(f"unknown format {form}") from None


def as_table(r: Result, width: int = 80) -> str:
    """For a terminal; cells are cut at width."""
    if r.form == "ASK":
        return f"{str(r.boolean).lower()}\n"
    rows = [r.names, *([("" if t is None else t)[:width] for t in row] for row in r.rows())]
    sizes = [max(len(x[i]) for x in rows) for i in range(len(r.names))]
    lines = [" | ".join(c.ljust(n) for c, n in zip(row, sizes)).rstrip() for row in rows]
    return "\n".join([lines[0], "-+-".join("-" * n for n in sizes), *lines[1:]]) + "\n"


def write(r: Result, path: str, form: str) -> None:
    """A large result, written by the executors: parquet (native columns), csv, tsv or nt."""
    if form == "parquet":
        r.df.write.parquet(path)
    elif form == "csv":
        lex = lambda n: F.when(F.startswith(n, F.lit('"')), F.regexp_extract(n, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)).otherwise(F.col(n))
        r.terms.select(*(lex(n).alias(n) for n in r.names)).write.option("header", True).option("escape", '"').csv(path)
    elif form == "tsv":
        _tsv(r.terms, r.names).write.text(path)
    elif form == "nt":
        ntriples.write(r.terms, path)
    else:
        raise ValueError(f"unknown format {form}")


def _tsv(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(F.concat_ws("\t", *(F.coalesce(ntriples._written(F.col(n)), F.lit("")) for n in names)).alias("value"))
