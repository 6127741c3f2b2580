import gzip
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request

import pytest

from rdfloom import Dataset, mapping, model, results, server
from rdfloom.config import Settings
from rdfloom.errors import QueryTimeout
from rdfloom.sources import ntriples
from rdfloom.streaming import feed

TEXT = r"""# a comment
<http://x/a> <http://x/p> "tab\there \"q\" é\U0001F600 \\ end"@EN .
<http://x/a> <http://x/p> "tab\there \"q\" é\U0001F600 \\ end"@EN .

_:b1 <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> . # trailing
<http://x/a> <http://x/p> "plain"^^<http://www.w3.org/2001/XMLSchema#string> .
<http://x/a> broken
<http://x/a> <http://x/p> <http://x/o> <http://x/g> .
"""


def test_reader(spark, tmp_path):
    at = tmp_path / "x.nt"
    at.write_text(TEXT)
    with pytest.warns(UserWarning, match="2 malformed"):
        rows = {(r.s, r.o, r.g) for r in ntriples.read(spark, [str(at)], report=True).collect()}
    assert rows == {("http://x/a", '"tab\there "q" é😀 \\ end"@en', None), ("_:b1", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>', None), ("http://x/a", '"plain"', None)}
    (tmp_path / "x.nq.gz").write_bytes(gzip.compress(TEXT.encode()))
    quads = ntriples.read(spark, [str(tmp_path / "x.nq.gz")]).collect()
    assert ("http://x/a", "http://x/p", "http://x/o", "http://x/g") in {tuple(r) for r in quads} and len(quads) == 4
    assert {r.g for r in ntriples.read(spark, [ntriples.Input(str(at), "http://g/")]).collect()} == {"http://g/"}


def test_writer_round_trip(spark, tmp_path):
    (tmp_path / "x.nq").write_text(TEXT)
    first = ntriples.read(spark, [str(tmp_path / "x.nq")])
    ntriples.write(first, str(tmp_path / "out.nq"))
    back = ntriples.parse(spark.read.text(str(tmp_path / "out.nq")), quads=True)
    assert {tuple(r) for r in back.select("s", "p", "o", "g").collect()} == {tuple(r) for r in first.collect()} and back.where("bad").count() == 0


def test_inputs_and_labels():
    assert ntriples.input_list(["# c", "a.nt", "b.nq <http://g/>", ""]) == [ntriples.Input("a.nt"), ntriples.Input("b.nq", "http://g/")]
    assert ntriples.format_of("a.nq.gz") == "quads" and ntriples.format_of("a.gz") == "triples"
    with pytest.warns(UserWarning):
        assert ntriples.format_of("a.ttl") == "triples"
    assert ntriples.risky_label("_:b12") and not ntriples.risky_label("_:genid-4f2a77")


def test_store(spark, tmp_path):
    (tmp_path / "x.nq").write_text(TEXT)
    data = Dataset.build(spark, [str(tmp_path / "x.nq")], str(tmp_path / "store"), report=False)
    again = Dataset.open(spark, str(tmp_path / "store"))
    assert again.query("ASK { <http://x/a> <http://x/p> 'plain' }").boolean and data.graphs() == ["http://x/g"]
    assert again.statistics()["http://x/p"].triples == 4 and again.estimate("SELECT * { ?s ?p ?o }") > 0


def test_store_orders(spark, tmp_path):
    """Objects are sought in their own order; only predicates of triples that two graphs share are made distinct."""
    lines = [f"<http://x/s{i}> <http://x/{p}> <http://x/o{i % 7}> ." for i in range(50) for p in "pq"]
    (tmp_path / "x.nt").write_text("\n".join(lines))
    (tmp_path / "y.nq").write_text("<http://x/s1> <http://x/q> <http://x/o1> <http://x/g> .\n")
    data = Dataset.build(spark, [str(tmp_path / "x.nt"), str(tmp_path / "y.nq")], str(tmp_path / "store"), report=False)
    texts = {p: f"SELECT ?s WHERE {{ ?s <http://x/{p}> <http://x/o1> }}" for p in "pq"}
    plans = {p: data.explain(t) for p, t in texts.items()}
    assert all("store/by_object" in x and "store/quads" not in x for x in plans.values()) and "store/quads" in data.explain("SELECT ?o { <http://x/s1> <http://x/p> ?o }")
    assert "Aggregate" not in plans["p"] and "Aggregate" in plans["q"]
    want = sorted(f"http://x/s{i}" for i in range(50) if i % 7 == 1)
    assert all(sorted(r[0] for r in data.query(t).rows()) == want for t in texts.values())


def test_pushdown_and_pruning(spark):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001")
    plan = data.explain("PREFIX t: <http://example.org/tpch/> SELECT ?n { ?p t:p_name ?n ; t:p_size 7 }")
    assert "EqualTo(p_size,7)" in plan and "Join" not in plan and "p_retailprice" not in plan


def test_results_formats(spark):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001")
    r = data.query('PREFIX t: <http://example.org/tpch/> SELECT ?r ?n ?l ?u { ?r t:r_name ?n FILTER(?n = "ASIA") BIND("a,b\\"c"@en AS ?l) }')
    got = json.loads("".join(results.serialise(r, "json")))
    assert got["head"]["vars"] == ["r", "n", "l", "u"] and got["results"]["bindings"][0]["l"] == {"type": "literal", "value": 'a,b"c', "xml:lang": "en"} and "u" not in got["results"]["bindings"][0]
    assert '"a,b""c"' in "".join(results.serialise(r, "csv")) and '"a,b\\"c"@en' in "".join(results.serialise(r, "tsv"))
    assert 'xml:lang="en"' in "".join(results.serialise(r, "xml")) and "ASIA" in results.as_table(r)
    d = data.query("DESCRIBE <http://example.org/tpch/region/0>")
    assert '<http://example.org/tpch/r_name> "AFRICA" .' in "".join(results.serialise(d, "nt"))
    assert "true" in "".join(results.serialise(data.query("ASK { ?s <http://example.org/tpch/r_name> ?o }"), "xml"))


def test_written_results(spark, tmp_path):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001")
    r = data.query("PREFIX t: <http://example.org/tpch/> SELECT ?r ?n { ?r t:r_name ?n }")
    for form in ("parquet", "csv", "tsv"):
        results.write(r, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 5 and spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5


def test_server(spark):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001", settings=Settings(max_rows=10))
    with server.make(data, port=0) as at:
        threading.Thread(target=at.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{at.server_address[1]}/sparql"
        q = "PREFIX t: <http://example.org/tpch/> SELECT ?n { ?r t:r_name ?n }"
        with urllib.request.urlopen(f"{url}?format=csv&query={urllib.parse.quote(q)}") as r:
            assert len(r.read().decode().split()) >= 6
        with urllib.request.urlopen(urllib.request.Request(url, data=q.encode(), headers={"Content-Type": "application/sparql-query", "Accept": "application/sparql-results+json"})) as r:
            assert len(json.loads(r.read())["results"]["bindings"]) == 5
        for bad in ("SELECT nothing", "PREFIX t: <http://example.org/tpch/> SELECT ?n { ?c t:c_name ?n }"):
            with pytest.raises(urllib.error.HTTPError) as e:
                urllib.request.urlopen(f"{url}?query={urllib.parse.quote(bad)}")
            assert e.value.code == 400
        at.shutdown()


def slow(spark, rows=3_000_000):
    """A graph whose self-join takes a while."""
    df = spark.range(rows).selectExpr("concat('http://x/', id) s", "'http://x/p' p", "concat('http://x/', id % 1000) o", "cast(null as string) g")
    return Dataset.from_quads(spark, df, Settings(query_timeout=1.0, max_concurrent=1, queue_timeout=0.2))


SLOW = "SELECT (COUNT(DISTINCT ?c) AS ?n) { ?a <http://x/p> ?b . ?c <http://x/p> ?b . ?d <http://x/p> ?a FILTER(REGEX(?a, '7.*3') || STRLEN(STR(?c)) > 3) }"


def test_timeout_covers_the_rows(spark):
    data = slow(spark)
    began = time.perf_counter()
    with pytest.raises(QueryTimeout):
        data.run(SLOW)
    assert time.perf_counter() - began < 10
    assert data.run("SELECT ?s { ?s <http://x/p> <http://x/none> }", timeout=60).df.count() == 0


def test_server_refuses_late_and_waiting_queries(spark):
    with server.make(slow(spark), port=0) as at:
        threading.Thread(target=at.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{at.server_address[1]}/sparql?query={urllib.parse.quote(SLOW)}"
        codes = []

        def get():
            try:
                urllib.request.urlopen(url, timeout=60)
            except urllib.error.HTTPError as e:
                codes.append(e.code)

        each = [threading.Thread(target=get) for _ in range(2)]
        for t in each:
            t.start()
        for t in each:
            t.join()
        assert sorted(codes) == [408, 503]
        at.shutdown()


def test_server_streams(spark):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001")
    with server.make(data, port=0) as at:
        threading.Thread(target=at.serve_forever, daemon=True).start()
        q = "PREFIX t: <http://example.org/tpch/> SELECT ?l ?q { ?l t:l_quantity ?q }"
        with urllib.request.urlopen(f"http://127.0.0.1:{at.server_address[1]}/sparql?format=tsv&query={urllib.parse.quote(q)}") as r:
            assert r.headers["Transfer-Encoding"] == "chunked" and r.headers["X-Wait-Micros"] and r.headers["X-Execute-Micros"]
            assert len(r.read().splitlines()) == 1 + spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        at.shutdown()


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("[server]\nport = 99\n[query]\nmax_rows = 5\n")
    assert Settings.read(str(tmp_path / "c.toml")).port == 99
    (tmp_path / "d.toml").write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        Settings.read(str(tmp_path / "d.toml"))


def test_model_paths():
    prefix = {"f": "<http://f/>"}
    tree = [{"Protein <http://x>": [{"f:range": [{"[]": [{"f:begin+": [{"[]": [{"f:position?": 1}]}]}]}]}, {"f:name": "n"}]}]
    found = model.paths(tree, prefix)
    assert found == [["http://f/range", "http://f/begin"], ["http://f/range", "http://f/begin", "http://f/position"]]
    assert model.paths({"P": {"f:range": {"[]": {"f:begin": 1}}}}, prefix) == [["http://f/range", "http://f/begin"]]
    assert len(model.sub_paths(list("ABCD"))) == 6 and [len(x) for x in model.sub_paths(list("ABCD"))] == [2, 2, 2, 3, 3, 4]


def test_model_from_text(tmp_path):
    """Blank nodes are keys that are lists."""
    (tmp_path / "prefix.yaml").write_text("f: <http://f/>\n")
    (tmp_path / "model.yaml").write_text("- Protein <http://x>:\n  - a: f:Protein\n  - f:range:\n    - []:\n      - f:begin+:\n        - []:\n          - f:position?: 1\n  - f:name: n\n")
    assert model.read(str(tmp_path)) == [["http://f/range", "http://f/begin"], ["http://f/range", "http://f/begin", "http://f/position"]]


@pytest.mark.parametrize("name", ["count_cross", "count_cross_three", "optional_then_join_unbound", "optional_unbound_key", "minus_unbound", "path_bound_start"])
def test_plans_without_nested_loops(spark, name):
    from rdfloom import suite

    plan = suite.dataset(spark, "/root/testdata/sf0.001").explain(suite.QUERIES[name])
    parts = plan.split("(1) ")[0]
    assert name.startswith(("optional", "minus")) or "NestedLoop" not in parts
    assert "OR isnull" not in plan and (name != "path_bound_start" or "LeftSemi" in plan)


def test_feed(spark, tmp_path):
    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.001")
    events = next(t for t in data.source.tables if t.name == "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.source.frame(events).schema).parquet(str(tmp_path / "in"))
    feed.follow(data.source, events, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = Dataset.from_quads(spark, spark.read.parquet(str(tmp_path / "out")))
    assert got.query("SELECT (COUNT(?e) AS ?n) { ?e a <http://example.org/tpch/Event> }").df.first().n == 50


def test_join_order_avoids_early_products(spark):
    """Customers and suppliers of a nation are joined through the lines that relate them."""
    from rdfloom import suite
    from rdfloom.plans.parser import parse
    from rdfloom.sources.scope import Scope

    data = Dataset.from_tables(spark, mapping.tables(), "/root/testdata/sf0.1")
    groups = data.source.groups(parse(suite.QUERIES["bgp_triangle_local_supplier"]).where.triples)
    order = [{t.p.value.rpartition("/")[2] for t in g} for g in data.compiler().ordered(groups, Scope())]
    place = lambda p: next(i for i, g in enumerate(order) if p in g)
    assert place("l_order") < max(place("s_nation"), place("c_nation"))


def test_store_is_written_in_bounded_tasks(spark, tmp_path):
    """No task collects what it reads before triples are dealt; repeats are left out, and triples of two graphs known."""
    from pyspark.sql import functions as F

    from rdfloom.sources.triples import TripleTable

    n = 300_000
    rows = spark.range(0, n, 1, 1).selectExpr("concat('http://example.org/subject/of/some/length/', id) AS s", "'http://example.org/p' AS p", "concat('\"object ', id, '\"') AS o", "'http://example.org/graph' AS g")
    few = spark.createDataFrame([("http://x/a", "http://x/q", "http://x/b", g) for g in (None, None, "http://x/g", "http://x/g")] + [("http://x/a", "http://x/r", f"http://x/{g}", f"http://x/{g}") for g in "gh"], "s string, p string, o string, g string")
    quads = rows.union(few)
    plan = TripleTable.once(quads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan.partition("rangepartitioning")[2] and plan.count("Sort ") == 1, plan
    TripleTable.write(quads, str(tmp_path / "store"))
    data = Dataset.open(spark, str(tmp_path / "store"))
    assert data.source.quads.count() == n + 4 and data.source.by_object.count() == n + 4
    assert data.source.shared == {"http://x/q"} and {p.removeprefix("http://"): x.triples for p, x in data.statistics().items()} == {"example.org/p": n, "x/q": 2, "x/r": 2}
    order = spark.read.parquet(str(tmp_path / "store" / "quads")).withColumn("f", F.input_file_name()).groupBy("f").agg(F.collect_list(F.concat("p", "s", "o")).alias("x"))
    assert order.where("x != array_sort(x)").count() == 0


def test_describe_reads_only_tables_of_the_subjects(spark):
    from rdfloom import suite

    data = suite.dataset(spark, "/root/testdata/sf0.001")
    plan = data.explain(suite.QUERIES["describe_var"])
    assert "nation.parquet" in plan and not any(f"{t}.parquet" in plan for t in ("lineitem", "orders", "customer", "pages"))
    text = "PREFIX t: <http://example.org/tpch/> DESCRIBE %s WHERE { ?l t:l_order <http://example.org/tpch/order/3> . ?l t:l_order ?o . ?o t:o_customer ?c }"
    all_, want = data.quads(), {}
    for vars_ in ("?o", "?l ?c", "?c <http://example.org/tpch/nation/3>"):
        subjects = {v for r in data.query(text.replace("DESCRIBE %s", "SELECT *") ).rows() for v in r} if not want else None
        want = want or subjects
        got = {tuple(r) for r in data.query(text % vars_).df.collect()}
        kinds = {"?o": ("/order/",), "?l ?c": ("/line/", "/customer/")}.get(vars_, ("/customer/",))
        own = [s for s in want if any(k in s for k in kinds)] + (["http://example.org/tpch/nation/3"] if "nation" in vars_ else [])
        assert got and got == {tuple(r) for r in all_.where(all_.s.isin(own)).select("s", "p", "o").collect()}


def test_loaded_files_are_parsed_once(spark, tmp_path):
    """Patterns and statistics of loaded files read a store, not the text again."""
    (tmp_path / "x.nq").write_text(TEXT)
    data = Dataset.load(spark, [str(tmp_path / "x.nq"), str(tmp_path / "x.nq")])
    text = "SELECT ?o ?q { ?s <http://x/p> ?o . ?s <http://x/p> ?q }"
    plan = data.explain(text)
    assert "Scan text" not in plan and plan.count("Scan parquet") >= 2
    (tmp_path / "x.nq").unlink()
    assert data.query(text).df.count() == 10 and data.statistics()["http://x/p"].triples == 4
    assert data.graphs() == ["http://x/g"]
