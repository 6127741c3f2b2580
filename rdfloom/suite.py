"""Named queries over the example tables, each with the SQL that says the same.

``run`` executes one; ``QUERIES`` and ``ORACLES`` feed the driver's comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rdfloom import suite_store
from rdfloom.engine import Dataset
from rdfloom.mapping import BASE, GRAPH, tables
from rdfloom.sources import ntriples

PROLOGUE = f"PREFIX t: <{BASE}>\nPREFIX g: <{GRAPH}>\n"
QUERIES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sparql: str, sql: str | None) -> None:
    QUERIES[name] = PROLOGUE + sparql
    if sql is not None:
        ORACLES[name] = sql


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.from_tables(spark, tables(), sf_dir)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dataset(spark, sf_dir).query(QUERIES[name]).df


# -- basic graph patterns

_add("bgp_chain_region_customers",
     "SELECT ?rname (COUNT(?c) AS ?customers) WHERE { ?c a t:Customer ; t:c_nation ?n . ?n t:n_region ?r . ?r t:r_name ?rname } GROUP BY ?rname ORDER BY ?rname",
     "SELECT r_name AS rname, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_add("bgp_star_part",
     "SELECT ?name ?size ?price WHERE { ?p a t:Part ; t:p_name ?name ; t:p_size ?size ; t:p_retailprice ?price ; t:p_brand ?brand FILTER(?size > 10 && ?price < 1500 && ?brand != 'Brand#11') }",
     "SELECT p_name AS name, p_size::BIGINT AS size, p_retailprice AS price FROM part WHERE p_size > 10 AND p_retailprice < 1500 AND p_brand <> 'Brand#11'")
_add("bgp_cycle_same_nation",
     "SELECT ?nn (COUNT(*) AS ?pairs) WHERE { ?c t:c_nation ?n . ?s t:s_nation ?n . ?n t:n_name ?nn } GROUP BY ?nn",
     "SELECT n_name AS nn, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
_add("bgp_triangle_local_supplier",
     "SELECT ?nn (COUNT(*) AS ?lines) (ROUND(SUM(?price)) AS ?total) WHERE { ?l t:l_order ?o ; t:l_supplier ?s ; t:l_extendedprice ?price . ?o t:o_customer ?c . ?c t:c_nation ?n . ?s t:s_nation ?n . ?n t:n_name ?nn } GROUP BY ?nn",
     "SELECT n_name AS nn, count(*) AS lines, round(sum(l_extendedprice)) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name")
_add("bgp_constant_subject", "SELECT ?name ?seg WHERE { <http://example.org/tpch/customer/7> t:c_name ?name ; t:c_mktsegment ?seg }",
     "SELECT c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey = 7")
_add("bgp_constant_object", "SELECT ?name WHERE { ?c t:c_nation <http://example.org/tpch/nation/3> ; t:c_name ?name }",
     "SELECT c_name AS name FROM customer WHERE c_nationkey = 3")
_add("bgp_unknown_constant", "SELECT ?name WHERE { ?c t:c_nation <http://example.org/other/3> ; t:c_name ?name }",
     "SELECT c_name AS name FROM customer WHERE false")
_add("bgp_repeated_variable", "SELECT ?x WHERE { ?x t:nextTurn ?x }", "SELECT text AS x FROM conversations WHERE false")
_add("bgp_two_tables_one_subject", "SELECT ?src (COUNT(?d) AS ?n) (SUM(?q) AS ?good) WHERE { ?d a t:Document ; t:source ?src ; t:quality ?q } GROUP BY ?src",
     "SELECT source AS src, count(*) AS n, sum(quality)::BIGINT AS good FROM documents JOIN labels USING (doc_id) GROUP BY source")
_add("blank_nodes", "SELECT ?c WHERE { ?x t:c_name ?c ; t:c_nation [ t:n_region [ t:r_name 'ASIA' ] ] }",
     "SELECT c_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("type_of_all", "SELECT ?t (COUNT(?x) AS ?n) WHERE { ?x a ?t FILTER(?t IN (t:Region, t:Nation, t:Supplier)) } GROUP BY ?t",
     f"SELECT '{BASE}Region' AS t, count(*) AS n FROM region UNION ALL SELECT '{BASE}Nation', count(*) FROM nation UNION ALL SELECT '{BASE}Supplier', count(*) FROM supplier")
_add("var_predicate", "SELECT ?p (COUNT(*) AS ?n) WHERE { ?x a ?c ; ?p ?o FILTER(?c = t:Region || ?c = t:Nation) } GROUP BY ?p",
     f"WITH x(p, n) AS (SELECT '{BASE}r_name', (SELECT count(*) FROM region) UNION ALL SELECT '{BASE}n_name', (SELECT count(*) FROM nation) UNION ALL SELECT '{BASE}n_region', (SELECT count(*) FROM nation) UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation)) SELECT * FROM x")
_add("select_star", "SELECT * WHERE { ?r a t:Region ; t:r_name ?name }",
     f"SELECT '{BASE}region/' || r_regionkey AS r, r_name AS name FROM region")

# -- filters

_add("filter_logic", "SELECT ?k WHERE { ?o t:o_orderstatus ?st ; t:o_totalprice ?k FILTER((?st = 'F' || ?k > 300000) && !(?st = 'P')) }",
     "SELECT o_totalprice AS k FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT (o_orderstatus = 'P')")
_add("filter_in", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_mktsegment ?m FILTER(?m IN ('BUILDING', 'MACHINERY')) }",
     "SELECT c_name AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("filter_notin", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_mktsegment ?m FILTER(?m NOT IN ('BUILDING', 'MACHINERY')) }",
     "SELECT c_name AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("filter_regex", "SELECT ?n ?ty WHERE { ?p t:p_name ?n ; t:p_type ?ty FILTER(REGEX(?ty, '^p.*s', 'i')) }",
     "SELECT p_name AS n, p_type AS ty FROM part WHERE regexp_matches(p_type, '^p.*s', 'i')")
_add("filter_compare_dates", "SELECT (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?d FILTER(?d >= '1995-01-01T00:00:00'^^<http://www.w3.org/2001/XMLSchema#dateTime> && ?d < '1996-01-01T00:00:00'^^<http://www.w3.org/2001/XMLSchema#dateTime>) }",
     "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
_add("filter_error_is_dropped", "SELECT ?n WHERE { ?c t:c_name ?n FILTER(?n > 5 || ?unbound) }", "SELECT c_name AS n FROM customer WHERE c_name > '5'")

# -- expressions

_add("bind_arith_revenue", "SELECT ?ln ?rev WHERE { ?l t:l_linenumber ?ln ; t:l_extendedprice ?e ; t:l_discount ?d ; t:l_tax ?x FILTER(?ln = 1) BIND(ROUND(?e * (1 - ?d) * (1 + ?x) * 100) AS ?rev) }",
     "SELECT l_linenumber::BIGINT AS ln, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS rev FROM lineitem WHERE l_linenumber = 1")
_add("str_length_case", "SELECT ?n (STRLEN(?n) AS ?len) (UCASE(?n) AS ?up) (LCASE(?n) AS ?low) WHERE { ?c t:c_name ?n }",
     "SELECT c_name AS n, length(c_name) AS len, upper(c_name) AS up, lower(c_name) AS low FROM customer")
_add("str_substr_concat", "SELECT (SUBSTR(?n, 3) AS ?a) (SUBSTR(?n, 2, 4) AS ?b) (CONCAT(?n, '-', ?m) AS ?c) WHERE { ?x t:c_name ?n ; t:c_mktsegment ?m }",
     "SELECT substr(c_name, 3) AS a, substr(c_name, 2, 4) AS b, c_name || '-' || c_mktsegment AS c FROM customer")
_add("str_tests", "SELECT ?n WHERE { ?p t:p_name ?n ; t:p_type ?y ; t:p_brand ?b FILTER(CONTAINS(?y, 'A') && STRSTARTS(?b, 'Brand') && !STRENDS(?b, '1')) }",
     "SELECT p_name AS n FROM part WHERE contains(p_type, 'A') AND starts_with(p_brand, 'Brand') AND NOT ends_with(p_brand, '1')")
_add("str_before_after_replace", "SELECT (STRBEFORE(?n, '#') AS ?a) (STRAFTER(?n, '#') AS ?b) (REPLACE(?n, '0+', 'z') AS ?c) (STRBEFORE(?n, 'none') AS ?d) WHERE { ?x t:c_name ?n }",
     "SELECT split_part(c_name, '#', 1) AS a, CASE WHEN contains(c_name, '#') THEN substr(c_name, position('#' IN c_name) + 1) ELSE '' END AS b, regexp_replace(c_name, '0+', 'z', 'g') AS c, '' AS d FROM customer")
_add("str_encode", "SELECT ?n (ENCODE_FOR_URI(?n) AS ?e) WHERE { ?x t:r_name ?n }", "SELECT r_name AS n, url_encode(r_name) AS e FROM region")
_add("num_functions", "SELECT (ABS(?b) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (-?b AS ?m) (?b / 2 AS ?h) WHERE { ?x t:c_acctbal ?b }",
     "SELECT abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, round(c_acctbal) AS r, -c_acctbal AS m, c_acctbal / 2 AS h FROM customer")
_add("num_divide_by_zero", "SELECT ?k (?k / (?k - ?k) AS ?z) WHERE { ?x t:p_size ?k }", "SELECT p_size::BIGINT AS k, NULL::DOUBLE AS z FROM part")
_add("date_parts", "SELECT (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (MINUTES(?d) AS ?mi) (SECONDS(?d) AS ?s) WHERE { ?x t:ts ?d }",
     "SELECT year(ts) AS y, month(ts) AS m, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi, (extract('microseconds' FROM ts) / 1000000)::DOUBLE AS s FROM events")
_add("if_coalesce", "SELECT ?d (IF(?n > 1000, 'long', 'short') AS ?size) (COALESCE(?q, -1) AS ?quality) WHERE { ?d a t:Document ; t:n_chars ?n OPTIONAL { ?d t:quality ?q } }",
     f"SELECT '{BASE}doc/' || d.doc_id AS d, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS size, coalesce(quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
_add("bound_unbound", "SELECT ?has (COUNT(*) AS ?n) WHERE { ?d a t:Document OPTIONAL { ?d t:toxic ?x } BIND(BOUND(?x) AS ?has) } GROUP BY ?has",
     "SELECT l.doc_id IS NOT NULL AS has, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
_add("term_kinds", "SELECT (isIRI(?x) AS ?a) (isLiteral(?n) AS ?b) (isNumeric(?s) AS ?c) (isBlank(?x) AS ?d) (STR(DATATYPE(?s)) AS ?e) (STR(?x) AS ?f) (sameTerm(?x, ?x) AS ?g) WHERE { ?x a t:Part ; t:p_name ?n ; t:p_size ?s }",
     f"SELECT true AS a, true AS b, true AS c, false AS d, 'http://www.w3.org/2001/XMLSchema#integer' AS e, '{BASE}part/' || p_partkey AS f, true AS g FROM part")
_add("lang_documents", "SELECT ?tag (COUNT(*) AS ?n) (SUM(STRLEN(?l)) AS ?chars) WHERE { ?d t:label_text ?l BIND(LANG(?l) AS ?tag) FILTER(LANGMATCHES(?tag, 'fr') || LANG(?l) = 'de') } GROUP BY ?tag",
     "SELECT lang AS tag, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE lang IN ('fr', 'de') GROUP BY lang")
_add("hashes", "SELECT ?n (MD5(?n) AS ?m) (SHA256(?n) AS ?s) WHERE { ?x t:n_name ?n }", "SELECT n_name AS n, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
_add("casts", "SELECT (<http://www.w3.org/2001/XMLSchema#integer>(?b) AS ?i) (<http://www.w3.org/2001/XMLSchema#string>(?k) AS ?s) (<http://www.w3.org/2001/XMLSchema#double>(?n) AS ?x) WHERE { ?p t:p_retailprice ?b ; t:p_size ?k ; t:p_name ?n }",
     "SELECT trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, try_cast(p_name AS DOUBLE) AS x FROM part")

# -- optional, union, exists, minus

_add("optional_labels", "SELECT ?n ?q ?x WHERE { ?d a t:Document ; t:n_chars ?n OPTIONAL { ?d t:quality ?q ; t:toxic ?x } }",
     "SELECT n_chars AS n, quality::BIGINT AS q, toxic::BIGINT AS x FROM documents LEFT JOIN labels USING (doc_id)")
_add("optional_filter_inside", "SELECT ?n ?q WHERE { ?d a t:Document ; t:n_chars ?n OPTIONAL { ?d t:quality ?q FILTER(?n > 2000 && ?q = 1) } }",
     "SELECT n_chars AS n, quality::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND n_chars > 2000 AND quality = 1")
_add("optional_then_join_unbound", "SELECT ?d ?q WHERE { { SELECT ?d ?q WHERE { ?d a t:Document OPTIONAL { ?d t:quality ?q } } } VALUES (?q ?w) { (1 'a') (7 'b') } }",
     f"SELECT '{BASE}doc/' || d.doc_id AS d, v.q::BIGINT AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id JOIN (VALUES (1), (7)) v(q) ON l.quality IS NULL OR l.quality = v.q")
_add("optional_nested", "SELECT ?cn ?k ?qty WHERE { ?c t:c_name ?cn ; t:c_mktsegment 'BUILDING' OPTIONAL { ?o t:o_customer ?c ; t:o_totalprice ?k FILTER(?k > 200000) OPTIONAL { ?l t:l_order ?o ; t:l_quantity ?qty FILTER(?qty > 45) } } }",
     "SELECT c_name AS cn, o_totalprice AS k, l_quantity AS qty FROM customer LEFT JOIN (SELECT o_custkey, o_totalprice, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 WHERE o_totalprice > 200000) o ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
_add("union_align", "SELECT ?a ?b WHERE { { ?x t:r_name ?a } UNION { ?y t:n_name ?b } }",
     "SELECT r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT NULL, n_name FROM nation")
_add("union_adjacent_only", "SELECT ?n ?k WHERE { ?r t:r_name ?n . { ?x t:n_region ?r ; t:n_name ?k } UNION { BIND('none' AS ?k) } }",
     "SELECT r_name AS n, n_name AS k FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'none' FROM region")
_add("exists_orders", "SELECT ?n WHERE { ?c t:c_name ?n FILTER EXISTS { ?o t:o_customer ?c ; t:o_totalprice ?p FILTER(?p > 400000) } }",
     "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_add("not_exists_orders", "SELECT ?n WHERE { ?c t:c_name ?n FILTER NOT EXISTS { ?o t:o_customer ?c ; t:o_orderstatus 'P' } }",
     "SELECT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_add("exists_outer_filter", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b FILTER EXISTS { ?o t:o_customer ?c ; t:o_totalprice ?p FILTER(?p > ?b * 50) } }",
     "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 50)")
_add("exists_in_disjunction", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b FILTER(?b < 0 || EXISTS { ?o t:o_customer ?c ; t:o_orderpriority '1-URGENT' }) }",
     "SELECT c_name AS n FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
_add("minus_orders", "SELECT ?n WHERE { ?c t:c_name ?n MINUS { ?o t:o_customer ?c ; t:o_orderstatus 'F' } }",
     "SELECT c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
_add("values_multi_undef", "SELECT ?n ?seg ?tag WHERE { VALUES (?seg ?tag) { ('BUILDING' 1) ('MACHINERY' UNDEF) (UNDEF 2) } ?c t:c_name ?n ; t:c_mktsegment ?seg }",
     "SELECT c_name AS n, c_mktsegment AS seg, v.tag::BIGINT AS tag FROM customer JOIN (VALUES ('BUILDING', 1), ('MACHINERY', NULL), (NULL, 2)) v(seg, tag) ON v.seg IS NULL OR v.seg = c_mktsegment")
_add("values_trailing", "SELECT ?n WHERE { ?r t:r_name ?n } VALUES ?n { 'ASIA' 'EUROPE' 'NOWHERE' }", "SELECT r_name AS n FROM region WHERE r_name IN ('ASIA', 'EUROPE')")

# -- groups

_add("agg_all", "SELECT ?seg (COUNT(*) AS ?n) (COUNT(DISTINCT ?nk) AS ?nd) (ROUND(SUM(?b)) AS ?s) (ROUND(AVG(?b) * 100) AS ?a) (MIN(?b) AS ?lo) (MAX(?b) AS ?hi) (MIN(?n1) AS ?first) WHERE { ?c t:c_mktsegment ?seg ; t:c_nation ?nk ; t:c_acctbal ?b ; t:c_name ?n1 } GROUP BY ?seg",
     "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS nd, round(sum(c_acctbal)) AS s, round(avg(c_acctbal) * 100) AS a, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY c_mktsegment")
_add("agg_group_concat", "SELECT ?rn (GROUP_CONCAT(?nn ; SEPARATOR = '|') AS ?names) (GROUP_CONCAT(DISTINCT ?rn) AS ?one) (SAMPLE(?rn) AS ?sample) WHERE { ?n t:n_region ?r ; t:n_name ?nn . ?r t:r_name ?rn } GROUP BY ?rn",
     "SELECT r_name AS rn, string_agg(n_name, '|' ORDER BY n_name) AS names, r_name AS one, r_name AS sample FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_add("agg_distinct_sum", "SELECT (SUM(DISTINCT ?s) AS ?sum) (AVG(DISTINCT ?s) AS ?avg) (COUNT(DISTINCT *) AS ?rows) WHERE { ?p t:p_brand ?b ; t:p_size ?s }",
     "SELECT sum(DISTINCT p_size)::BIGINT AS sum, avg(DISTINCT p_size) AS avg, (SELECT count(*) FROM (SELECT DISTINCT p_partkey, p_brand, p_size FROM part)) AS rows FROM part")
_add("agg_implicit_empty", "SELECT (COUNT(?x) AS ?n) (SUM(?x) AS ?s) (MAX(?x) AS ?m) WHERE { ?p t:p_size ?x FILTER(?x > 100000) }",
     "SELECT count(p_size) AS n, coalesce(sum(p_size), 0)::BIGINT AS s, max(p_size)::BIGINT AS m FROM part WHERE p_size > 100000")
_add("having_hidden_agg", "SELECT ?seg WHERE { ?c t:c_mktsegment ?seg ; t:c_acctbal ?b } GROUP BY ?seg HAVING(COUNT(*) > 10 && AVG(?b) > 4000)",
     "SELECT c_mktsegment AS seg FROM customer GROUP BY 1 HAVING count(*) > 10 AND avg(c_acctbal) > 4000")
_add("group_by_expr", "SELECT ?y (COUNT(*) AS ?n) WHERE { ?o t:o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y) ORDER BY ?y",
     "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1")
_add("nested_agg_ratio", "SELECT ?st (ROUND(1000 * SUM(?p) / COUNT(?p)) AS ?mean) WHERE { ?o t:o_orderstatus ?st ; t:o_totalprice ?p } GROUP BY ?st",
     "SELECT o_orderstatus AS st, round(1000 * sum(o_totalprice) / count(*)) AS mean FROM orders GROUP BY 1")
_add("count_cross", "SELECT (COUNT(*) AS ?n) WHERE { ?a a t:Region . ?b a t:Supplier }", "SELECT (SELECT count(*) FROM region) * (SELECT count(*) FROM supplier) AS n")
_add("pricing_summary", "SELECT ?rf ?ls (SUM(?q) AS ?sum_qty) (ROUND(SUM(?e * (1 - ?d))) AS ?disc) (ROUND(AVG(?q) * 1000) AS ?avg_qty) (COUNT(*) AS ?n) WHERE { ?l t:l_returnflag ?rf ; t:l_linestatus ?ls ; t:l_quantity ?q ; t:l_extendedprice ?e ; t:l_discount ?d ; t:l_shipdate ?s FILTER(?s <= '1998-09-02T00:00:00'^^<http://www.w3.org/2001/XMLSchema#dateTime>) } GROUP BY ?rf ?ls ORDER BY ?rf ?ls",
     "SELECT l_returnflag AS rf, l_linestatus AS ls, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount))) AS disc, round(avg(l_quantity) * 1000) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
_add("events_by_type", "SELECT ?ty (COUNT(*) AS ?n) (COUNT(DISTINCT ?u) AS ?users) (ROUND(SUM(?v)) AS ?total) WHERE { ?e a t:Event ; t:event_type ?ty ; t:user ?u ; t:value ?v } GROUP BY ?ty",
     "SELECT event_type AS ty, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value)) AS total FROM events GROUP BY 1")

# -- modifiers

_add("subselect_topk", "SELECT ?n ?p WHERE { { SELECT ?o ?p WHERE { ?o t:o_totalprice ?p } ORDER BY DESC(?p) ?o LIMIT 20 } ?o t:o_customer ?c . ?c t:c_name ?n }",
     "SELECT c_name AS n, o_totalprice AS p FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey::VARCHAR LIMIT 20) JOIN customer ON o_custkey = c_custkey")
_add("distinct_orderby", "SELECT DISTINCT ?st ?pr WHERE { ?o t:o_orderstatus ?st ; t:o_orderpriority ?pr } ORDER BY DESC(?pr) ?st", "SELECT DISTINCT o_orderstatus AS st, o_orderpriority AS pr FROM orders")
_add("limit_offset", "SELECT ?n WHERE { ?c t:c_name ?n } ORDER BY ?n OFFSET 10 LIMIT 15", "SELECT c_name AS n FROM customer ORDER BY c_name LIMIT 15 OFFSET 10")
_add("order_by_expression", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b } ORDER BY DESC(ABS(?b)) ?n LIMIT 10", "SELECT c_name AS n FROM customer ORDER BY abs(c_acctbal) DESC, c_name LIMIT 10")
_add("ask_true", "ASK { ?r t:r_name 'ASIA' }", "SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA') AS boolean")
_add("ask_false", "ASK { ?r t:r_name 'ATLANTIS' }", "SELECT EXISTS (SELECT 1 FROM region WHERE r_name = 'ATLANTIS') AS boolean")
_NATION = f"SELECT '{BASE}nation/' || n_nationkey AS s, '{BASE}n_name' AS p, '\"' || n_name || '\"' AS o FROM nation WHERE %s UNION ALL SELECT '{BASE}nation/' || n_nationkey, '{BASE}n_region', '{BASE}region/' || n_regionkey FROM nation WHERE %s UNION ALL SELECT '{BASE}nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{BASE}Nation' FROM nation WHERE %s"
_add("describe_nation", "DESCRIBE <http://example.org/tpch/nation/3>", _NATION.replace("%s", "n_nationkey = 3"))
_add("describe_var", "DESCRIBE ?n WHERE { ?n t:n_region <http://example.org/tpch/region/1> }", _NATION.replace("%s", "n_regionkey = 1"))
_add("construct_links", "CONSTRUCT { ?c t:inRegion ?r } WHERE { ?c t:c_nation ?n . ?n t:n_region ?r }",
     f"SELECT '{BASE}customer/' || c_custkey AS s, '{BASE}inRegion' AS p, '{BASE}region/' || n_regionkey AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")

# -- paths

_add("path_seq", "SELECT ?n ?rn WHERE { ?c t:c_nation/t:n_region ?r . ?c t:c_name ?n . ?r t:r_name ?rn }",
     "SELECT c_name AS n, r_name AS rn FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_add("path_alt", "SELECT ?nn (COUNT(*) AS ?n) WHERE { ?x (t:c_nation|t:s_nation) ?k . ?k t:n_name ?nn } GROUP BY ?nn",
     "SELECT n_name AS nn, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY 1")
_add("path_inverse", "SELECT DISTINCT ?a ?b WHERE { ?x ^t:c_nation/t:c_mktsegment ?b . ?x t:n_name ?a }", "SELECT DISTINCT n_name AS a, c_mktsegment AS b FROM customer JOIN nation ON c_nationkey = n_nationkey")
_add("path_zero_or_one", "SELECT ?a ?b WHERE { ?a t:n_region? ?b }",
     f"WITH e(a, b) AS (SELECT '{BASE}nation/' || n_nationkey, '{BASE}region/' || n_regionkey FROM nation) SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
_STEPS = f"WITH RECURSIVE e(a, b) AS (SELECT '{BASE}turn/' || conv_id || '-' || turn, '{BASE}turn/' || conv_id || '-' || (turn + 1) FROM conversations), c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) "
_add("path_plus_turns", "SELECT ?a ?b WHERE { ?a t:nextTurn+ ?b }", _STEPS + "SELECT a, b FROM c")
_add("path_star_turns", "SELECT ?a ?b WHERE { ?a t:nextTurn* ?b }", _STEPS + "SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e")
_add("path_plus_from", "SELECT ?b WHERE { <http://example.org/tpch/turn/1-0> t:nextTurn+ ?b }", _STEPS + f"SELECT b FROM c WHERE a = '{BASE}turn/1-0'")
_add("path_star_to", "SELECT ?a WHERE { ?a t:nextTurn* <http://example.org/tpch/turn/1-1> }", _STEPS + f"SELECT a FROM c WHERE b = '{BASE}turn/1-1' UNION SELECT '{BASE}turn/1-1'")

# -- named graphs

_add("graph_const", "SELECT ?n WHERE { GRAPH g:region { ?x ?p ?n FILTER(isLiteral(?n)) } }", "SELECT '\"' || r_name || '\"' AS n FROM region")
_add("graph_var", "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?x a ?c } FILTER(?g IN (g:region, g:nation, g:part)) } GROUP BY ?g",
     f"SELECT '{GRAPH}region' AS g, count(*) AS n FROM region UNION ALL SELECT '{GRAPH}nation', count(*) FROM nation UNION ALL SELECT '{GRAPH}part', count(*) FROM part")
_add("from_graph", "SELECT ?p (COUNT(*) AS ?n) FROM g:nation WHERE { ?x ?p ?o } GROUP BY ?p",
     f"SELECT '{BASE}n_name' AS p, count(*) AS n FROM nation UNION ALL SELECT '{BASE}n_region', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM nation")
_add("list_graphs", "SELECT ?g WHERE { GRAPH ?g { } }",
     "SELECT 'http://example.org/graph/' || x AS g FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'), ('documents'), ('labels'), ('conversations'), ('pages'), ('benchmark'), ('embeddings')) v(x)")

# -- what earlier rows don't reach

_BIG = "SELECT c_name AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 30 AND o_totalprice > 200000)"
_add("exists_two_filters", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b FILTER EXISTS { ?o t:o_customer ?c ; t:o_totalprice ?p FILTER(?p > ?b * 30) FILTER(?p > 200000) } }", _BIG)
_add("exists_two_filters_swapped", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b FILTER EXISTS { ?o t:o_customer ?c ; t:o_totalprice ?p FILTER(?p > 200000) FILTER(?p > ?b * 30) } }", _BIG)
_add("not_exists_two_filters", "SELECT ?n WHERE { ?c t:c_name ?n ; t:c_acctbal ?b FILTER NOT EXISTS { ?o t:o_customer ?c ; t:o_totalprice ?p FILTER(?p > ?b * 30) FILTER(?p > 200000) } }", _BIG.replace("WHERE EXISTS", "WHERE NOT EXISTS"))
for _not in ("", "NOT "):
    _add(f"optional_{_not.lower().strip()}{'_' if _not else ''}exists_outer", f"SELECT ?n ?sn WHERE {{ ?c t:c_nation ?na ; t:c_name ?n OPTIONAL {{ ?s t:s_nation ?na ; t:s_name ?sn FILTER {_not}EXISTS {{ ?c t:c_mktsegment 'BUILDING' }} }} }}",
         f"SELECT c_name AS n, s_name AS sn FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey AND c_mktsegment {'<>' if _not else '='} 'BUILDING'")
    _add(f"optional_{_not.lower().strip()}{'_' if _not else ''}exists_shared", f"SELECT ?n ?p WHERE {{ ?c t:c_name ?n OPTIONAL {{ ?o t:o_customer ?c ; t:o_totalprice ?p FILTER {_not}EXISTS {{ ?c t:c_acctbal ?b FILTER(?p > ?b * 30) }} }} }}",
         f"SELECT c_name AS n, o_totalprice AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {_not}(o_totalprice > c_acctbal * 30)")
_add("optional_unbound_key", "SELECT ?d ?q ?k WHERE { { SELECT ?d ?q WHERE { ?d a t:Document OPTIONAL { ?d t:quality ?q } } } OPTIONAL { VALUES (?q ?k) { (1 'good') (0 'bad') } } }",
     f"SELECT '{BASE}doc/' || d.doc_id AS d, coalesce(l.quality, v.q)::BIGINT AS q, v.k AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (VALUES (1, 'good'), (0, 'bad')) v(q, k) ON l.quality IS NULL OR l.quality = v.q")
_add("minus_unbound", "SELECT ?d WHERE { ?d a t:Document OPTIONAL { ?d t:quality ?q } MINUS { ?d t:toxic ?x . ?d t:quality ?q FILTER(?x = 1) } }",
     f"SELECT '{BASE}doc/' || doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
_add("count_cross_three", "SELECT (COUNT(*) AS ?n) WHERE { ?a t:r_name ?x . ?b a t:Supplier . ?c a t:Nation }", "SELECT (SELECT count(*) FROM region) * (SELECT count(*) FROM supplier) * (SELECT count(*) FROM nation) AS n")
_add("reduced", "SELECT REDUCED ?st WHERE { ?o t:o_orderstatus ?st }", "SELECT DISTINCT o_orderstatus AS st FROM orders")
_add("from_named", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED g:region FROM NAMED g:nation WHERE { GRAPH ?g { ?x a ?c } } GROUP BY ?g",
     f"SELECT '{GRAPH}region' AS g, count(*) AS n FROM region UNION ALL SELECT '{GRAPH}nation', count(*) FROM nation")
_add("iri_function", "SELECT (IRI(CONCAT('http://x/', ?n)) AS ?i) (URI('http://y/') AS ?u) WHERE { ?r t:r_name ?n }", "SELECT 'http://x/' || r_name AS i, 'http://y/' AS u FROM region")
_add("fresh_blank_nodes", "SELECT ?n (isBlank(?b) AS ?blank) WHERE { ?r t:r_name ?n BIND(BNODE() AS ?b) }", "SELECT r_name AS n, true AS blank FROM region")
_add("unary_plus_and_now", "SELECT (+?b AS ?p) (YEAR(NOW()) > 2000 AS ?later) WHERE { ?s t:s_acctbal ?b }", "SELECT s_acctbal AS p, true AS later FROM supplier")
_add("limit_without_order", "SELECT (COUNT(*) AS ?n) WHERE { { SELECT ?c WHERE { ?c a t:Customer } LIMIT 17 } }", "SELECT least(17, count(*)) AS n FROM customer")
_add("typed_literals", "SELECT (STR(STRDT(STR(?k), <http://www.w3.org/2001/XMLSchema#integer>)) AS ?a) (LANG(STRLANG(?n, 'en')) AS ?b) (STRLEN(STRUUID()) AS ?c) (RAND() < 1 AS ?d) (SHA1(?n) AS ?e) WHERE { ?p t:p_size ?k ; t:p_name ?n }",
     "SELECT p_size::VARCHAR AS a, 'en' AS b, 36::BIGINT AS c, true AS d, sha1(p_name) AS e FROM part")
_add("path_bound_start", "SELECT ?rn (COUNT(*) AS ?n) WHERE { ?c t:c_mktsegment 'BUILDING' ; t:c_nation/t:n_region ?r . ?r t:r_name ?rn } GROUP BY ?rn",
     "SELECT r_name AS rn, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
_add("path_bound_end", "SELECT ?n WHERE { ?r t:r_name 'ASIA' . ?c t:c_nation/t:n_region ?r . ?c t:c_name ?n }",
     "SELECT c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_add("path_plus_selective", "SELECT ?a ?b WHERE { ?a t:conversation <http://example.org/tpch/conversation/3> . ?a t:nextTurn+ ?b }",
     _STEPS + f"SELECT c.a, c.b FROM c JOIN conversations ON a = '{BASE}turn/' || conv_id || '-' || turn WHERE conv_id = 3")
_add("path_star_selective_end", "SELECT ?a ?b WHERE { ?b t:conversation <http://example.org/tpch/conversation/3> . ?a t:nextTurn* ?b }",
     _STEPS + f", f AS (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e) SELECT f.a, f.b FROM f JOIN conversations ON b = '{BASE}turn/' || conv_id || '-' || turn WHERE conv_id = 3")
_add("path_seq_then_plus", "SELECT ?a ?b WHERE { ?a t:conversation <http://example.org/tpch/conversation/3> ; t:turn 0 ; t:nextTurn/t:nextTurn+ ?b }",
     _STEPS + f"SELECT e.a, c.b FROM e JOIN c ON e.b = c.a JOIN conversations ON e.a = '{BASE}turn/' || conv_id || '-' || turn WHERE conv_id = 3 AND turn = 0")


def nt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as N-Triples text, parsed back and queried as triples."""
    own = [t for t in tables() if t.name in ("nation", "supplier")]
    text = ntriples.lines(Dataset.from_tables(spark, own, sf_dir).quads().drop("g"))
    back = ntriples.parse(text).where("not bad").select("s", "p", "o", "g")
    return Dataset.from_quads(spark, back).query(PROLOGUE + "SELECT (STR(?sn) AS ?supplier) (STR(?nn) AS ?nation) (xsd:double(?b) AS ?bal) WHERE { ?s t:s_name ?sn ; t:s_acctbal ?b ; t:s_nation ?n . ?n t:n_name ?nn }").df


ORACLES |= suite_store.ORACLES
ORACLES["nt_roundtrip"] = "SELECT s_name AS supplier, n_name AS nation, s_acctbal AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def queries() -> dict:
    out = {name: (lambda spark, sf_dir, name=name: run(spark, sf_dir, name)) for name in QUERIES}
    return out | {"nt_roundtrip": nt_roundtrip} | suite_store.queries()
