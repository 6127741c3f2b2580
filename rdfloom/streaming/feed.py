"""Tables that grow, as triples: an extension; the query engine itself is for data at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rdfloom.functions.terms import to_term
from rdfloom.plans.algebra import RDF_TYPE
from rdfloom.sources.mapped import MappedTables, Table


def triples(source: MappedTables, table: Table, rows: DataFrame) -> DataFrame:
    """(s, p, o, g) of the rows of a table; rows may be a stream."""
    typ, key = source.subject(table)
    pairs = [F.struct(F.lit(p).alias("p"), to_term(*source.object(table, x)).alias("o")) for p, x in table.props.items()]
    if table.cls:
        pairs.append(F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(table.cls).alias("o")))
    out = rows.select(to_term(typ, key).alias("s"), F.inline(F.array(*pairs)), F.lit(table.graph).alias("g"))
    return out.where("s is not null and o is not null").select("s", "p", "o", "g")


def follow(source: MappedTables, table: Table, rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the triples of a stream of rows to a folder of quads until what is there has been read."""
    out = triples(source, table, rows).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.outputMode("append").trigger(availableNow=True).start()
