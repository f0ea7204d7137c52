"""Saving networks as tables, and exporting them to graph formats."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurograph.model import Network


def save(net: Network, path: str, file_format: str = "parquet") -> None:
    """Neurons, connections and groups as Parquet below ``path``, with a manifest of one JSON row."""
    if file_format != "parquet":
        raise NotImplementedError(file_format)
    net.neurons.write.mode("overwrite").parquet(f"{path}/neurons")
    net.connections.write.mode("overwrite").partitionBy("connection_type").parquet(f"{path}/connections")
    for k, members in net.groups.items():
        members.write.mode("overwrite").parquet(f"{path}/groups/{k}")
    manifest = [(net.name, sorted(net.groups))]
    net.neurons.sparkSession.createDataFrame(manifest, "name string, groups array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Network:
    """Data only; nothing that is read is executed."""
    m = spark.read.schema("name string, groups array<string>").json(f"{path}/manifest").first()
    groups = {k: spark.read.parquet(f"{path}/groups/{k}") for k in m.groups or []}
    return Network(m.name, spark.read.parquet(f"{path}/neurons"), spark.read.parquet(f"{path}/connections"), groups)


def edges_json(net: Network) -> DataFrame:
    """One JSON document a row: nodes as {id}, edges as {source, target, weight}, a missing weight 1."""
    nodes = net.neurons.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("name").alias("id"))).alias("value"))
    w = F.coalesce("weight", F.lit(1.0)).alias("weight")
    return nodes.union(net.connections.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.col("pre").alias("source"), F.col("post").alias("target"), w))))


def write_json(net: Network, path: str) -> None:
    edges_json(net).write.mode("overwrite").text(path)


def _rows(df: DataFrame) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield {k: v for k, v in r.asDict(recursive=True).items() if v is not None and isinstance(v, (str, int, float, bool))}


def _id(x: str) -> str:
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _dot(net: Network) -> Iterator[str]:
    yield f"digraph {_id(net.name)} {{\n"
    for n in _rows(net.neurons):
        yield f"  {_id(n['name'])};\n"
    for e in _rows(net.connections):
        yield f"  {_id(e['pre'])} -> {_id(e['post'])} [weight={e.get('weight', 1.0)}, label={_id(str(e.get('connection_type', '')))}];\n"
    yield "}\n"


def _gml(net: Network) -> Iterator[str]:
    yield "graph [\n  directed 1\n  multigraph 1\n"
    at = {}
    for k, n in enumerate(_rows(net.neurons)):
        at[n["name"]] = k
        yield f"  node [ id {k} label {_id(n['name'])} ]\n"
    for e in _rows(net.connections):
        yield f"  edge [ source {at[e['pre']]} target {at[e['post']]} weight {e.get('weight', 1.0)} connection_type {_id(str(e.get('connection_type', '')))} ]\n"
    yield "]\n"


def _graphml(net: Network) -> Iterator[str]:
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    yield '<key id="w" for="edge" attr.name="weight" attr.type="double"/><key id="t" for="edge" attr.name="connection_type" attr.type="string"/>\n<graph edgedefault="directed">\n'
    for n in _rows(net.neurons):
        yield f"<node id={quoteattr(n['name'])}/>\n"
    for e in _rows(net.connections):
        yield f"<edge source={quoteattr(e['pre'])} target={quoteattr(e['post'])}><data key=\"w\">{e.get('weight', 1.0)}</data><data key=\"t\">{escape(str(e.get('connection_type', '')))}</data></edge>\n"
    yield "</graph>\n</graphml>\n"


def _cytoscape(net: Network) -> Iterator[str]:
    yield '{"data": {"name": ' + json.dumps(net.name) + '}, "directed": true, "multigraph": true, "elements": {"nodes": ['
    for k, n in enumerate(_rows(net.neurons)):
        yield ", " * (k > 0) + json.dumps({"data": {"id": n["name"], **n}})
    yield '], "edges": ['
    for k, e in enumerate(_rows(net.connections)):
        yield ", " * (k > 0) + json.dumps({"data": {"source": e["pre"], "target": e["post"], **e}})
    yield "]}}\n"


FORMATS = {"dot": _dot, "graphviz": _dot, "graphml": _graphml, "nx": _graphml, "gml": _gml, "json": _cytoscape}


def export_graph(net: Network, path: str, fmt: str) -> None:
    """Writes a network in one file on the driver, row by row; for networks that a viewer can show."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    with Path(path).open("w", encoding="utf-8") as f:
        f.writelines(FORMATS[fmt](net))
