"""A graph for drawing tools as one GraphML document, written in parallel.

The document is a folder of text fragments: head, nodes, edges, tail. Each kind is written by as many
tasks as its table has partitions; put together in the order of their paths the files are one valid
document (``ordered_files``). No task sees more than its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed text of the format.
_HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n'
         '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
         '<key id="label" for="node" attr.name="label" attr.type="string"/>\n'
         '<key id="class" for="node" attr.name="class" attr.type="string"/>\n'
         '<graph edgedefault="directed">')
_TAIL = "</graph>\n</graphml>"
FRAGMENTS = ("0-head", "1-nodes", "2-edges", "3-tail")


def _escaped(c: Column) -> Column:
    """Text for XML: markup characters as entities; control characters, which XML 1.0 has not, as
    U+FFFD; a null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "�")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                        ("\r", "&#13;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("value")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "error") -> None:
    """Write nodes (id, label, class) and edges (src, dst) under ``path``. Parallel edges and
    self-loops are all written; edges have no ids of their own."""
    spark = nodes.sparkSession
    node = _line('<node id="n', F.col("id").cast("string"), '"><data key="label">',
                 _escaped(F.col("label")), '</data><data key="class">', _escaped(F.col("class")),
                 "</data></node>")
    edge = _line('<edge source="n', F.col("src").cast("string"), '" target="n',
                 F.col("dst").cast("string"), '"/>')
    fixed = [spark.createDataFrame([(t,)], "value string").coalesce(1) for t in (_HEAD, _TAIL)]
    parts = (fixed[0], nodes.select(node), edges.select(edge), fixed[1])
    for name, part in zip(FRAGMENTS, parts):
        part.write.mode(mode).text(f"{path}/{name}")


def ordered_files(spark: SparkSession, path: str) -> list[str]:
    """The fragments' files in the order that makes the document."""
    found = []
    for name in FRAGMENTS:
        found += sorted(spark.read.text(f"{path}/{name}").inputFiles())
    return found


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a document written by ``write_graphml``: (id, label, class), (src, dst)."""
    def back(c: Column) -> Column:
        for entity, raw in (("&#10;", "\n"), ("&#13;", "\r"), ("&quot;", '"'), ("&gt;", ">"),
                            ("&lt;", "<"), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(raw))
        return c

    node = '<node id="n(-?[0-9]+)"><data key="label">(.*)</data><data key="class">(.*)</data></node>'
    edge = '<edge source="n(-?[0-9]+)" target="n(-?[0-9]+)"/>'
    nodes = spark.read.text(f"{path}/{FRAGMENTS[1]}").select(
        F.regexp_extract("value", node, 1).cast("long").alias("id"),
        back(F.regexp_extract("value", node, 2)).alias("label"),
        back(F.regexp_extract("value", node, 3)).alias("class"))
    edges = spark.read.text(f"{path}/{FRAGMENTS[2]}").select(
        F.regexp_extract("value", edge, 1).cast("long").alias("src"),
        F.regexp_extract("value", edge, 2).cast("long").alias("dst"))
    return nodes, edges
