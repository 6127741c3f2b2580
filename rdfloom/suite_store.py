"""Named queries that write the example tables out first: as N-Triples, N-Quads, gzip, stores and result documents."""

from __future__ import annotations

import csv
import io
import json
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession

from rdfloom import model
from rdfloom.checkpoints import fresh_folder
from rdfloom.config import Settings
from rdfloom.engine import Dataset
from rdfloom.governor import reservation
from rdfloom.mapping import BASE, GRAPH, tables
from rdfloom.results import serialise
from rdfloom.sources import ntriples

PROLOGUE = f"PREFIX t: <{BASE}>\nPREFIX g: <{GRAPH}>\n"
XSD = "http://www.w3.org/2001/XMLSchema#"
STAR = "SELECT (STR(?cn) AS ?customer) (STR(?nn) AS ?nation) (xsd:double(?b) AS ?bal) WHERE { ?c a t:Customer ; t:c_name ?cn ; t:c_acctbal ?b ; t:c_nation ?n . ?n t:n_name ?nn FILTER(?b > 9000) }"
STAR_SQL = "SELECT c_name AS customer, n_name AS nation, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000"
COUNTS = "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s t:r_name|t:n_name|t:n_region ?o } } GROUP BY ?g"
COUNTS_SQL = f"SELECT '{GRAPH}region' AS g, count(*) AS n FROM region UNION ALL SELECT '{GRAPH}nation', 2 * count(*) FROM nation"


def _of(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    return Dataset.from_tables(spark, [t for t in tables() if t.name in names], sf_dir)


def _store(spark: SparkSession, sf_dir: str, *names: str) -> Dataset:
    at = fresh_folder(spark)
    _of(spark, sf_dir, *names).write(at)
    return Dataset.open(spark, at)


def store_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars of a store that was built, closed and opened again."""
    return _store(spark, sf_dir, "customer", "nation").query(PROLOGUE + STAR).df


def store_object_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What points at a node, by any predicate."""
    return _store(spark, sf_dir, "customer", "supplier", "nation").query(PROLOGUE + "SELECT ?p (COUNT(*) AS ?n) WHERE { ?s ?p <http://example.org/tpch/nation/3> } GROUP BY ?p").df


def store_subject_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, "customer", "nation").query(PROLOGUE + "SELECT ?p WHERE { <http://example.org/tpch/customer/7> ?p ?o }").df


def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of each predicate, from the store's catalog."""
    found = _store(spark, sf_dir, "region", "nation").statistics()
    return spark.createDataFrame([(p, s.triples) for p, s in found.items()], "p string, triples long")


def store_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT without ORDER BY takes as many rows as there are, at most."""
    return _store(spark, sf_dir, "customer").query(PROLOGUE + "SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?c WHERE { ?c t:c_name ?x } LIMIT 17 } }").df


def nquads_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-Quads files keep the graphs of their lines."""
    at = f"{fresh_folder(spark)}/all.nq"
    ntriples.write(_of(spark, sf_dir, "region", "nation").quads(), at)
    return Dataset.load(spark, [at]).query(PROLOGUE + COUNTS).df


def gzip_files_to_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of an input list, compressed, each with its own graph."""
    at = fresh_folder(spark)
    for name in ("region", "nation"):
        ntriples.write(_of(spark, sf_dir, name).quads().drop("g"), f"{at}/{name}.nt.gz", "gzip")
    listed = ["# path and graph", *(f"{at}/{name}.nt.gz <{GRAPH}{name}>" for name in ("region", "nation"))]
    return Dataset.load(spark, ntriples.input_list(listed)).query(PROLOGUE + COUNTS).df


def many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files without graphs, one of them twice: triples are a set."""
    at = fresh_folder(spark)
    for name in ("customer", "nation"):
        ntriples.write(_of(spark, sf_dir, name).quads().drop("g"), f"{at}/{name}.nt")
    return Dataset.load(spark, [f"{at}/{name}.nt" for name in ("customer", "nation", "customer")]).query(PROLOGUE + STAR).df


def blank_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of blank nodes that other files may use too."""
    labels = ["_:b1", "_:genid-4f2a77", "_:12", "_:node-of-file-7"]
    return spark.createDataFrame([(x, ntriples.risky_label(x)) for x in labels], "label string, risky boolean")


def _cached(spark: SparkSession, sf_dir: str, keep, text: str) -> DataFrame:
    data = _of(spark, sf_dir, "customer", "nation", "region")
    keep(data)
    return data.query(PROLOGUE + text).df


PATH = "SELECT (STR(?n) AS ?name) (STR(?rn) AS ?region) WHERE { ?c t:c_nation/t:n_region ?r . ?c t:c_name ?n . ?r t:r_name ?rn }"
PATH_SQL = "SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def cached_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, lambda d: d.cache_path([f"{BASE}c_nation", f"{BASE}n_region"]), PATH)


def cached_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, lambda d: d.cache_predicate(f"{BASE}c_nation"), PATH)


def cached_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir, lambda d: d.cache_class(f"{BASE}Nation"), "SELECT (STR(?x) AS ?name) WHERE { ?n a t:Nation ; t:n_name ?x }")


def model_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in YAML, its chains materialised, and a query that reads them."""
    chains = model.paths(model.load("- Customer <http://example.org/tpch/customer/1>:\n  - t:c_nation:\n    - []:\n      - t:n_region+:\n        - []:\n          - t:r_name: name\n"), {"t": f"<{BASE}>"})
    return _cached(spark, sf_dir, lambda d: [d.cache_path(c) for c in chains if len(c) == 2], PATH)


def timezones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of stored times; one without has none."""
    times = [f"2024-01-02T03:04:05{z}" for z in ("+05:30", "-08:00", "Z", "")]
    quads = spark.createDataFrame([("http://x/s", "http://x/at", f'"{x}"^^<{XSD}dateTime>') for x in times], "s string, p string, o string")
    return Dataset.from_quads(spark, quads).query("SELECT (STR(?d) AS ?day) (STR(TIMEZONE(?d)) AS ?zone) WHERE { ?s <http://x/at> ?d }").df


def _parsed(spark: SparkSession, sf_dir: str, form: str, read) -> DataFrame:
    r = _of(spark, sf_dir, "region", "nation").run(PROLOGUE + "SELECT ?nn ?rn WHERE { ?n t:n_name ?nn OPTIONAL { ?n t:n_region ?r . ?r t:r_name ?rn FILTER(?rn != 'ASIA') } }")
    try:
        return spark.createDataFrame(read("".join(serialise(r, form))), "nn string, rn string")
    finally:
        r.close()


def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "json", lambda x: [tuple(b[n]["value"] if n in b else None for n in ("nn", "rn")) for b in json.loads(x)["results"]["bindings"]])


def result_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "{http://www.w3.org/2005/sparql-results#}"

    def read(x: str) -> list:
        rows = [{b.get("name"): b[0].text for b in r} for r in ET.fromstring(x).iter(f"{at}result")]
        return [(r.get("nn"), r.get("rn")) for r in rows]

    return _parsed(spark, sf_dir, "xml", read)


def result_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "csv", lambda x: [(r["nn"], r["rn"] or None) for r in csv.DictReader(io.StringIO(x))])


def result_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "tsv", lambda x: [tuple(c.strip('"') or None for c in line.split("\t")) for line in x.splitlines()[1:]])


def result_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DESCRIBE as N-Triples, parsed back."""
    text = "".join(serialise(_of(spark, sf_dir, "region").query("DESCRIBE <http://example.org/tpch/region/1>"), "nt"))
    return ntriples.parse(spark.createDataFrame([(x,) for x in text.splitlines()], "value string")).where("not bad").select("s", "p", "o")


def result_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASK as JSON and XML."""
    r = _of(spark, sf_dir, "region").query(PROLOGUE + "ASK { ?r t:r_name 'ASIA' }")
    return spark.createDataFrame([(json.loads("".join(serialise(r, "json")))["boolean"], "<boolean>true</boolean>" in "".join(serialise(r, "xml")))], "json boolean, xml boolean")


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MB that results of given sizes reserve."""
    return spark.createDataFrame([(rows, width, reservation(rows, width, Settings())) for rows, width in ((1, 1), (10_000_000, 2), (2**62, 1))], "size long, width int, mb long").select("size", "width", "mb")


ORACLES = {
    "store_star": STAR_SQL,
    "store_object_scan": f"SELECT '{BASE}c_nation' AS p, count(*) AS n FROM customer WHERE c_nationkey = 3 HAVING count(*) > 0 UNION ALL SELECT '{BASE}s_nation', count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0",
    "store_subject_scan": "SELECT unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', " + ", ".join(f"'{BASE}{p}'" for p in ("c_name", "c_acctbal", "c_mktsegment", "c_nation")) + "]) AS p FROM customer WHERE c_custkey = 7",
    "store_statistics": f"SELECT '{BASE}r_name' AS p, count(*) AS triples FROM region UNION ALL SELECT '{BASE}n_name', count(*) FROM nation UNION ALL SELECT '{BASE}n_region', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)",
    "store_limit": "SELECT least(17, count(*)) AS n FROM customer",
    "nquads_graphs": COUNTS_SQL,
    "gzip_files_to_graphs": COUNTS_SQL,
    "many_files": STAR_SQL,
    "blank_label_report": "SELECT * FROM (VALUES ('_:b1', true), ('_:genid-4f2a77', false), ('_:12', true), ('_:node-of-file-7', false)) v(label, risky)",
    "cached_path": PATH_SQL,
    "cached_predicate": PATH_SQL,
    "cached_class": "SELECT n_name AS name FROM nation",
    "model_paths": PATH_SQL,
    "result_ntriples": f"SELECT '{BASE}region/1' AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{BASE}Region' AS o UNION ALL SELECT '{BASE}region/1', '{BASE}r_name', '\"' || r_name || '\"' FROM region WHERE r_regionkey = 1",
    "timezones": "SELECT '2024-01-02T03:04:05' || column0 AS day, column1 AS zone FROM (VALUES ('+05:30', 'PT5H30M'), ('-08:00', '-PT8H'), ('Z', 'PT0S'), ('', NULL)) v(column0, column1)",
    "result_ask": "SELECT true AS json, true AS xml",
    "reservations": "SELECT * FROM (VALUES (1::BIGINT, 1, 256::BIGINT), (10000000, 2, 687), (4611686018427387904, 1, 4096)) v(size, width, mb)",
}
ORACLES |= dict.fromkeys(("result_json", "result_xml", "result_csv", "result_tsv"), "SELECT n_name AS nn, CASE WHEN r_name <> 'ASIA' THEN r_name END AS rn FROM nation JOIN region ON n_regionkey = r_regionkey")


def queries() -> dict:
    return {name: globals()[name] for name in ORACLES}
