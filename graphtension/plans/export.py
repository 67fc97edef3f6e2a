"""Graph exports: JSON, DOT, and the XML formats, one line per node or edge; files are written by executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphtension.errors import InvalidConfig


def _or_none(c: str) -> Column:
    return F.when(F.col(c) != "", F.col(c))


def json_nodes(nodes: DataFrame) -> DataFrame:
    """Empty types are left out; times are never exported."""
    more = [F.when(F.size("attributes") > 0, F.col("attributes")).alias("attributes")] if "attributes" in nodes.columns else []
    return nodes.select(F.to_json(F.struct("id", _or_none("type").alias("type"), "degree", "in_degree", "out_degree", *more)).alias("line"))


def json_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "weight", _or_none("type").alias("type"), F.col("cnt").alias("count"))).alias("line"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the header, nodes, edges and the end. Labels hold a backslash and n, quoted once more."""
    brk = F.lit("\\n")
    label = F.when(F.coalesce("type", F.lit("")) != "", F.concat("id", brk, F.lit("("), "type", F.lit(")"))).otherwise(F.col("id"))
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(" [label="), _quoted(label), F.lit("];")).alias("line"))
    amount = F.format_string("%.2f", F.col("weight"))
    text = F.when(F.coalesce("type", F.lit("")) != "", F.concat("type", brk, amount)).otherwise(amount)
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), F.lit(" [label="), _quoted(text), F.lit("];")).alias("line"))
    frame = nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string")
    return frame.unionByName(n).unionByName(e)


def _xml(c: str) -> Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('    <node id="'), _xml("id"), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('    <edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("line"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n  <key id="w" for="edge" attr.name="weight" attr.type="double"/>\n  <graph edgedefault="directed">'
    return nodes.sparkSession.createDataFrame([(0, head), (3, "  </graph>\n</graphml>")], "part int, line string").unionByName(n).unionByName(e)


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('      <node id="'), _xml("id"), F.lit('" label="'), _xml("id"), F.lit('"/>')).alias("line"))
    e = edges.select(F.lit(3).alias("part"), F.concat(F.lit('      <edge source="'), _xml("src"), F.lit('" target="'), _xml("dst"), F.lit('" weight="'), F.col("weight").cast("string"), F.lit('"/>')).alias("line"))
    frame = [(0, '<gexf version="1.3">\n  <graph defaultedgetype="directed">\n    <nodes>'), (2, "    </nodes>\n    <edges>"), (4, "    </edges>\n  </graph>\n</gexf>")]
    return nodes.sparkSession.createDataFrame(frame, "part int, line string").unionByName(n).unionByName(e)


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): one JSON document of nodes and edges in order of (part, line); an empty list is null."""
    frame, out = [], None
    for i, (name, rows) in enumerate((("nodes", json_nodes(nodes)), ("edges", json_edges(edges)))):
        first = rows.agg(F.min("line")).first()[0]
        lead, tail = ('{"nodes": ' if not i else ', "edges": '), ("}" if i else "")
        if first is None:
            frame.append((3 * i, f"{lead}null{tail}"))
            continue
        frame += [(3 * i, f"{lead}["), (3 * i + 2, f"]{tail}")]
        # repeated lines can't be: an id, or a pair, is there once
        body = rows.select(F.lit(3 * i + 1).alias("part"), "line", (F.col("line") == first).alias("first"))
        out = body if out is None else out.unionByName(body)
    ends = nodes.sparkSession.createDataFrame(frame, "part int, line string").withColumn("first", F.lit(True))
    return ends if out is None else ends.unionByName(out)


def export(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Write an export under ``path``: one folder of text, whose files in order are one document."""
    if fmt == "json":
        lines = json_lines(nodes, edges).orderBy("part", "line")
        lines.select(F.when(F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("value")).write.text(path)
        return
    kinds = {"dot": dot_lines, "graphml": graphml_lines, "gexf": gexf_lines}
    if fmt not in kinds:
        raise InvalidConfig(f"no export format {fmt!r}")
    kinds[fmt](nodes, edges).orderBy("part", "line").select("line").write.text(path)


def json_document(nodes: DataFrame, edges: DataFrame) -> str:
    """One indented document, for graphs small enough to show; an empty list is null."""
    import json

    rows = lambda df: [json.loads(r.line) for r in df.orderBy("line").collect()] or None
    return json.dumps({"nodes": rows(json_nodes(nodes)), "edges": rows(json_edges(edges))}, indent=2, ensure_ascii=False) + "\n"
