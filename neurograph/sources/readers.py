"""Readers of connectomes, expression tables and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neurograph.model import CHEMICAL, GAP, Network
from neurograph.operators.build import explode_adjacency

#: Names that aren't neurons in electron-microscopy edge lists, and stages that have them.
NO_NEURON = "^(BWM-|CEPsh|GLR)"
STAGES = {"L1": 4, "L2": 1, "L3": 1, "adult": 2}


def edge_list(rows: DataFrame, drop: str = NO_NEURON, name: str = "Neutral") -> Network:
    """From (pre, post, type or connection_type, synapses): nodes are all ends but those that ``drop`` matches, edges those between nodes."""
    kind = "connection_type" if "connection_type" in rows.columns else "type"
    labels = rows.select(F.explode(F.array("pre", "post")).alias("name")).distinct().where(~F.col("name").rlike(drop))
    edges = rows.where(~F.col("pre").rlike(drop) & ~F.col("post").rlike(drop)).select("pre", "post", F.col(kind).alias("connection_type"), F.col("synapses").cast("double").alias("weight"))
    return Network(name, labels, edges)


def check_dataset(stage: str, index: int) -> None:
    if stage not in STAGES or not 1 <= index <= STAGES[stage]:
        raise ValueError(f"no dataset {index} of stage {stage!r}")


def read_edge_list(spark: SparkSession, path: str, stage: str = "adult", index: int = 1, **options) -> Network:
    check_dataset(stage, index)
    return edge_list(spark.read.csv(path, header=True, inferSchema=False), **options)


def build_network(neurons: DataFrame, chemical: DataFrame | None, gap: DataFrame | None, positions: DataFrame | None = None, chem_only: bool = False, gapjn_only: bool = False, name: str = "Neutral") -> Network:
    """From tables: neurons (name, type, category, modality), adjacencies (pre, adjacency map<post, weight>), positions (name, position)."""
    if chem_only and gapjn_only:
        raise ValueError("chem_only and gapjn_only exclude each other")
    parts = []
    if chemical is not None and not gapjn_only:
        parts.append(explode_adjacency(chemical, "adjacency", CHEMICAL, True, color="orange", uid=0))
    if gap is not None and not chem_only:
        parts.append(explode_adjacency(gap, "adjacency", GAP, True, color="gray", uid=1))
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return Network(name, neurons.join(positions, "name", "left") if positions is not None else neurons, edges)


def wide_adjacency(wide: DataFrame, row: str, kind: str = CHEMICAL) -> DataFrame:
    """Edges of a matrix whose first column names the sources and whose other columns are targets; empty cells and zeros are none."""
    targets = [c for c in wide.columns if c != row]
    long = wide.unpivot(row, targets, "post", "weight").select(F.col(row).alias("pre"), "post", F.col("weight").cast("double").alias("weight"))
    names = wide.select(F.col(row).alias("post")).distinct()
    return long.where("weight is not null and weight <> 0").join(names, "post", "left_semi").withColumn("connection_type", F.lit(kind))


def fill_down(df: DataFrame, columns: list[str], order: str, group: str | None = None) -> DataFrame:
    """Empty cells take the last value above. With ``group`` (sheets of many) each group is filled by itself; without, the sheet is one task's."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def retype_sex_specific(neurons: DataFrame) -> DataFrame:
    """Of the neurons that are specific to a sex CEM* are sensory and MCM* interneurons."""
    specific = F.col("type") == "SEX SPECIFIC"
    return neurons.withColumn("type", F.when(specific & F.col("name").startswith("CEM"), "SENSORY NEURON").when(specific & F.col("name").startswith("MCM"), "INTERNEURON").otherwise(F.col("type")))


def male_network(chemical: DataFrame, gap: DataFrame, order: str = "ord", chem_only: bool = False, gapjn_only: bool = False, name: str = "Neutral") -> Network:
    """From two wide sheets: ``order`` (the row's number), class, category, label, and a column for each target.

    Class and category stand in the first row of each block only. Nodes are the labels of the chemical sheet; edges link two of them. A sex-specific neuron's type
    is its category, or for those of the head goes by its name; its category is then SEX SPECIFIC.
    """
    if chem_only and gapjn_only:
        raise ValueError("chem_only and gapjn_only exclude each other")
    # one sheet of a few hundred rows, in one task
    filled = fill_down(chemical.select(order, "class", "category", F.col("label").alias("name")), ["class", "category"], order).where("name is not null")
    own, head = F.col("class") == "SEX SPECIFIC", F.when(F.col("name").startswith("CEM"), "SENSORY NEURON").when(F.col("name").startswith("MCM"), "INTERNEURON")
    kind = F.when(own & (F.col("category") != "HEAD"), F.col("category")).when(own, head).otherwise(F.col("class"))
    neurons = filled.select("name", kind.alias("type"), F.when(own, "SEX SPECIFIC").otherwise(F.col("category")).alias("category"))
    parts = []
    for sheet, what, color, uid in ((chemical, CHEMICAL, "orange", 0), (gap, GAP, "gray", 1)):
        if what == CHEMICAL and not gapjn_only or what == GAP and not chem_only:
            edges = wide_adjacency(sheet.where("label is not null").drop(order, "class", "category"), "label", what)
            known = neurons.select("name")
            edges = edges.join(known.select(F.col("name").alias("pre")), "pre", "left_semi").join(known.select(F.col("name").alias("post")), "post", "left_semi")
            parts.append(edges.select("pre", "post", F.lit(uid).alias("uid"), "connection_type", "weight", F.lit(color).alias("color")))
    return Network(name, neurons, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def read_worm(spark: SparkSession, folder: str, style: str = "cook", sex: str = "hermaphrodite", stage: str = "adult", dataset: int = 1, chem_only: bool = False, gapjn_only: bool = False, name: str = "Neutral") -> Network:
    """A worm's network by style and sex, from tables saved in ``folder`` (spreadsheets saved as CSV, maps as JSON lines):

    cook, hermaphrodite: ``cells.csv``, ``chemical.json`` and ``gap.json`` (pre, adjacency), ``positions.json`` (name, position); cook, male: ``male_chemical.csv`` and
    ``male_gap.csv`` (ord, class, category, label, targets); witvliet: ``witvliet_<stage>_<dataset>.csv``. ValueError for others.
    """
    only = {"chem_only": chem_only, "gapjn_only": gapjn_only, "name": name}
    if style == "cook" and sex == "hermaphrodite":
        near = "pre string, adjacency map<string,double>"
        positions = spark.read.schema("name string, position struct<AP:double,LR:double,DV:double>").json(f"{folder}/positions.json")
        return build_network(spark.read.csv(f"{folder}/cells.csv", header=True), spark.read.schema(near).json(f"{folder}/chemical.json"), spark.read.schema(near).json(f"{folder}/gap.json"), positions, **only)
    if style == "cook" and sex == "male":
        sheets = [spark.read.csv(f"{folder}/male_{k}.csv", header=True) for k in ("chemical", "gap")]
        return male_network(*[s.withColumn("ord", F.col("ord").cast("int")) for s in sheets], **only)
    if style == "witvliet":
        return read_edge_list(spark, f"{folder}/witvliet_{stage}_{dataset}.csv", stage, dataset, name=f"witvliet_{stage}_{dataset}")
    raise ValueError(f"no worm of style {style!r} and sex {sex!r}")


def fly(names: DataFrame, coordinates: DataFrame, stats: DataFrame, connections: DataFrame, name: str = "fly") -> Network:
    """From (root_id, name, group), (root_id, position like ``[1 2 3]``), (root_id, length_nm, area_nm, size_nm), (pre_root_id, post_root_id, syn_count, nt_type)."""
    xyz = F.transform(F.split(F.trim(F.regexp_extract("position", r"\[(.*)\]", 1)), r"\s+"), lambda x: x.cast("int"))
    where = coordinates.groupBy("root_id").agg(F.min("position").alias("position")).select("root_id", xyz.alias("position"))
    nodes = names.join(where, "root_id", "left").join(stats, "root_id", "left")
    a, b = (names.select(F.col("root_id").alias(f"{s}_root_id"), F.col("name").alias(s)) for s in ("pre", "post"))
    edges = connections.join(a, "pre_root_id").join(b, "post_root_id").select("pre", "post", F.col("nt_type").alias("connection_type"), F.col("syn_count").cast("double").alias("weight"))
    return Network(name, nodes, edges)


def read_fly(spark: SparkSession, folder: str) -> Network:
    return fly(*[spark.read.csv(f"{folder}/{t}.csv", header=True) for t in ("names", "coordinates", "cell_stats", "connections_no_threshold")])


def join_lineage(neurons: DataFrame, lineage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neurons with their lineage, and those without; one-digit numbers at a name's end count padded with a zero."""
    padded = lineage.withColumn("name", F.regexp_replace("Neuron", r"^([A-Z]+)(\d)$", "$10$2").alias("name")).drop("Neuron")
    return neurons.join(padded, "name"), neurons.join(padded, "name", "left_anti")


def recordings(raw: DataFrame) -> DataFrame:
    """(recording, neuron, trial, t, value) from (recording, trace_array array<array<double>>, labeled map<string, struct<label>>), keys counting from 1.

    Labels with a question mark aren't sure and are left out.
    """
    traces = raw.select("recording", F.posexplode("trace_array").alias("i", "trace"), "labeled")
    label = F.get(F.array(F.col("labeled")[(F.col("i") + 1).cast("string")]["label"]), F.lit(0))
    known = traces.select("recording", label.alias("neuron"), "trace").where(F.col("neuron").isNotNull() & ~F.col("neuron").contains("?"))
    return known.select("recording", "neuron", F.lit(0).alias("trial"), F.posexplode("trace").alias("t", "value"))


def expression(wide: DataFrame, gene: str, classes: DataFrame) -> DataFrame:
    """(neuron, gene, expressed) of a wide table with a column for each class, for neurons (name, class)."""
    long = wide.unpivot(gene, [c for c in wide.columns if c != gene], "class", "value")
    return long.join(classes, "class").select(F.col("name").alias("neuron"), F.col(gene).alias("gene"), (F.col("value") > 0).alias("expressed"))
