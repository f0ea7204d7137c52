"""Multi-omic annotations: ligands, receptors, transcripts and innexins joined onto nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neurograph.model import CHEMICAL, GAP
from neurograph.operators.fold import SUFFIXES

#: Genes of gap junction subunits that aren't named inx*.
INNEXINS = ("che-7", "eat-5", "unc-7", "unc-9")
#: Neurons whose expression class isn't found by name. Prefix or whole name, then class.
CLASS_RULES = [
    ("^(VD|DD)", "VD_DD"), ("^RME[LR]$", "RME_LR"), ("^RME[DV]$", "RME_DV"), ("^RMD[LR]$", "RMD_LR"), ("^RMD[DV]", "RMD_DV"), ("^IL2[LR]$", "IL2_LR"), ("^IL2[DV]", "IL2_DV"),
]
FIXED_CLASSES = {"VC04": "VC_4_5", "VC05": "VC_4_5", "DA09": "DA9"}


def ligands(table: DataFrame, first: str = "Neurotransmitter 1", second: str = "Neurotransmitter 2") -> DataFrame:
    """(neuron, ligands array): the table's first row for a neuron; an empty second name is none."""
    two = F.array_compact(F.array(F.col(f"`{first}`"), F.nullif(F.col(f"`{second}`"), F.lit(""))))
    order = ["ord"] if "ord" in table.columns else [F.lit(0)]
    return table.select(F.col("Neuron").alias("neuron"), two.alias("ligands"), *([F.col("ord")] if "ord" in table.columns else [])).withColumn("_k", F.row_number().over(Window.partitionBy("neuron").orderBy(*order))).where("_k = 1").select("neuron", "ligands")


def receptors(wide: DataFrame, ligand_map: DataFrame, gene: str = "gene_name") -> DataFrame:
    """(neuron, receptor, ligand): expressed receptor genes of a wide table, with the first ligand that (gene, ligand[, ord]) has for each, or ''."""
    names = [c for c in wide.columns if c != gene]
    long = wide.unpivot(gene, names, "neuron", "expressed").where("expressed").select("neuron", F.col(gene).alias("receptor"))
    order = "ord" if "ord" in ligand_map.columns else "ligand"
    first = ligand_map.withColumn("_k", F.row_number().over(Window.partitionBy("gene").orderBy(order))).where("_k = 1").select(F.col("gene").alias("receptor"), "ligand")
    return long.join(first, "receptor", "left").select("neuron", "receptor", F.coalesce("ligand", F.lit("")).alias("ligand"))


def expand_classes(classes: DataFrame, column: str = "neuron") -> DataFrame:
    """Each row for its class name and for that with every ending."""
    ends = F.array(*[F.lit(s) for s in ("", *SUFFIXES)])
    return classes.withColumn("_e", F.explode(ends)).withColumn(column, F.concat(column, "_e")).drop("_e")


def putative_pairs(edges: DataFrame, ligand_rows: DataFrame, receptor_rows: DataFrame, kind: str = CHEMICAL) -> DataFrame:
    """(pre, post, ligand, receptor): of each edge of the type, the ligands of its source that a receptor of its target takes. Distinct.

    ``ligand_rows`` is (neuron, ligand), ``receptor_rows`` (neuron, receptor, ligand).
    """
    e = edges.where(F.col("connection_type") == kind).select("pre", "post").distinct()
    a = ligand_rows.select(F.col("neuron").alias("pre"), "ligand").distinct()
    b = receptor_rows.select(F.col("neuron").alias("post"), "ligand", "receptor").distinct()
    return e.join(a, "pre").join(b, ["post", "ligand"]).select("pre", "post", "ligand", "receptor")


def with_putative(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with ``pairs``, an array of structs; empty where there are none."""
    listed = pairs.groupBy("pre", "post").agg(F.array_sort(F.collect_set(F.struct("ligand", "receptor"))).alias("pairs"))
    return edges.join(listed, ["pre", "post"], "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<ligand:string,receptor:string>>")))


def peptide_networks(blocks: DataFrame, pairs: DataFrame, labels: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """(network, pre, post, weight) from a stack of n x n blocks, rows (idx, values array): block idx div n is the pair of that ``ord``."""
    if isinstance(wanted, str):
        raise TypeError("wanted must be a list of pairs")
    n = labels.count()
    cells = blocks.select(F.expr(f"idx div {n}").alias("block"), (F.col("idx") % n).alias("row"), F.posexplode("values").alias("col", "weight")).where("weight <> 0")
    a, b = labels.select(F.col("ord").alias("row"), F.col("name").alias("pre")), labels.select(F.col("ord").alias("col"), F.col("name").alias("post"))
    named = pairs.select(F.col("ord").alias("block"), F.col("pair").alias("network"))
    named = named if wanted is None else named.where(F.col("network").isin(wanted))
    return cells.join(named, "block").join(a, "row").join(b, "col").select("network", "pre", "post", F.col("weight").cast("double").alias("weight"))


def threshold_table(levels: dict[int, DataFrame], gene: str) -> DataFrame:
    """(threshold, gene, neuron, expressed) of several wide tables, one for each sensitivity."""
    out = None
    for level, wide in levels.items():
        long = wide.unpivot(gene, [c for c in wide.columns if c != gene], "neuron", "value").select(F.lit(level).alias("threshold"), F.col(gene).alias("gene"), "neuron", (F.col("value") > 0).alias("expressed"))
        out = long if out is None else out.unionByName(long)
    return out


def expression_class(neurons: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, class) of each neuron among expression classes (class, ord).

    In order: a stated class; its own name; its name without L or R if both sides exist; AWCL and AWCR; a stated rule; the last class in
    order that the name begins with; null.
    """
    c = classes.select("class", "ord")
    twin = neurons.select(F.translate(F.right("name", F.lit(1)), "LR", "RL").alias("_s"), "name").select(F.concat(F.expr("substring(name, 1, length(name) - 1)"), "_s").alias("_twin"), F.col("name").alias("_of")).where("_of rlike '[LR]$'")
    have = twin.join(neurons.select(F.col("name").alias("_twin")), "_twin", "left_semi").select(F.col("_of").alias("name"), F.lit(True).alias("two"))
    n = neurons.select("name").join(have, "name", "left").withColumn("stem", F.when(F.col("two"), F.expr("substring(name, 1, length(name) - 1)")).otherwise(F.col("name")))
    exact, stem = c.select(F.col("class").alias("own")), c.select(F.col("class").alias("stemmed"))
    n = n.join(exact, F.col("name") == F.col("own"), "left").join(stem, F.col("stem") == F.col("stemmed"), "left")
    prefixed = n.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substr("name", F.lit(1), k))).alias("class")).join(c, "class")
    last = prefixed.groupBy("name").agg(F.max_by("class", "ord").alias("prefix"))
    rule: Column = F.lit(None).cast("string")
    for pattern, target in CLASS_RULES:
        rule = F.when(F.col("name").rlike(pattern), target).otherwise(rule)
    fixed = F.create_map(*[F.lit(v) for kv in FIXED_CLASSES.items() for v in kv])
    awc = F.when(F.col("name") == "AWCL", "AWC_OFF").when(F.col("name") == "AWCR", "AWC_ON")
    return n.join(last, "name", "left").select("name", F.coalesce(fixed[F.col("name")], "own", "stemmed", awc, rule, "prefix").alias("class"))


def enriched(expression: DataFrame, targets: list[str], excluded: list[str]) -> DataFrame:
    """Neurons of (neuron, gene, expressed) that express a target gene and aren't excluded."""
    return expression.where(F.col("gene").isin(targets) & F.col("expressed") & ~F.col("neuron").isin(excluded)).select("neuron").distinct()


def innexin(gene: Column) -> Column:
    return gene.startswith("inx") | gene.isin(*INNEXINS)


def subunit_pairs(edges: DataFrame, expression: DataFrame, kind: str = GAP) -> DataFrame:
    """(pre, post, pre_gene, post_gene): every innexin of one side with every one of the other, for each gap junction. Distinct."""
    genes = expression.where(F.col("expressed") & innexin(F.col("gene"))).select("neuron", "gene").distinct()
    e = edges.where(F.col("connection_type") == kind).select("pre", "post").distinct()
    a, b = genes.select(F.col("neuron").alias("pre"), F.col("gene").alias("pre_gene")), genes.select(F.col("neuron").alias("post"), F.col("gene").alias("post_gene"))
    return e.join(a, "pre").join(b, "post").select("pre", "post", "pre_gene", "post_gene")


def with_pair(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Edges that have the pair (a, b)."""
    return pairs.where((F.col("pre_gene") == a) & (F.col("post_gene") == b)).select("pre", "post").distinct()


def pair_histogram(edges: DataFrame, pairs: str = "pairs") -> DataFrame:
    """(n_pairs, n, share): how many edges have that many putative pairs, and the share of edges with that many or fewer."""
    counted = edges.groupBy(F.size(F.coalesce(pairs, F.array())).alias("n_pairs")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("n_pairs").rowsBetween(Window.unboundedPreceding, 0)  # over one row a count
    return counted.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()))


def edges_by_pair(edges: DataFrame, ligand: str | None = None, kind: str | None = None, pairs: str = "pairs") -> DataFrame:
    """(ligand, receptor, pre, post) of edges, each once for every putative pair; of one ligand or one type of edge if given."""
    some = edges.where(F.col("connection_type") == kind) if kind else edges
    out = some.select("pre", "post", F.explode(pairs).alias("p")).select("p.ligand", "p.receptor", "pre", "post")
    return out.where(F.col("ligand") == ligand) if ligand else out
