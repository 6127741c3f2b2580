"""The example tables as a graph."""

from __future__ import annotations

from rdfloom.sources.mapped import Property, Table

BASE = "http://example.org/tpch/"
GRAPH = "http://example.org/graph/"


def _table(name: str, cls: str | None, subject: str, key: str, literals: str, links: dict[str, tuple[str, str]] | None = None, lang: dict[str, str] | None = None) -> Table:
    """literals: columns, or predicate=column; links: predicate -> (column, subject of its template)."""
    props = {}
    for x in literals.split():
        p, _, col = x.partition("=")
        props[BASE + p] = Property(col or p, lang=(lang or {}).get(p))
    for p, (col, to) in (links or {}).items():
        props[BASE + p] = Property(col, ref=f"{BASE}{to}/{{}}")
    return Table(name, f"{BASE}{subject}/{{}}", key, props, BASE + cls if cls else None, GRAPH + name)


def tables() -> list[Table]:
    # a line item has no key: equal (order, number) pairs occur, so that the whole row names it
    line = "sha1(to_json(struct(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)))"
    return [
        _table("region", "Region", "region", "r_regionkey", "r_name"),
        _table("nation", "Nation", "nation", "n_nationkey", "n_name", {"n_region": ("n_regionkey", "region")}),
        _table("customer", "Customer", "customer", "c_custkey", "c_name c_acctbal c_mktsegment", {"c_nation": ("c_nationkey", "nation")}),
        _table("supplier", "Supplier", "supplier", "s_suppkey", "s_name s_acctbal", {"s_nation": ("s_nationkey", "nation")}),
        _table("part", "Part", "part", "p_partkey", "p_name p_brand p_type p_size p_retailprice"),
        _table("orders", "Order", "order", "o_orderkey", "o_orderstatus o_totalprice o_orderdate o_orderpriority", {"o_customer": ("o_custkey", "customer")}),
        _table("lineitem", "Line", "line", line, "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", {"l_order": ("l_orderkey", "order"), "l_part": ("l_partkey", "part"), "l_supplier": ("l_suppkey", "supplier")}),
        _table("events", "Event", "event", "event_id", "ts event_type value props", {"user": ("user_id", "user")}),
        _table("documents", "Document", "doc", "doc_id", "text source n_chars lang label_text=text", lang={"label_text": "lang"}),
        _table("labels", None, "doc", "doc_id", "quality toxic"),
        _table("conversations", "Turn", "turn", "concat(conv_id, '-', turn)", "role text turn", {"conversation": ("conv_id", "conversation"), "nextTurn": ("concat(conv_id, '-', turn + 1)", "turn")}),
        _table("pages", "Page", "page", "page_id", "url html"),
        _table("benchmark", "Item", "item", "item_id", "text"),
        _table("embeddings", "Vector", "vec", "vec_id", "label"),
    ]
