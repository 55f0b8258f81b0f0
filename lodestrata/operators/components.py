"""Strongly connected components and layers of large directed graphs, in rounds of joins.

Every node carries the least name that reaches it and the least name that it reaches; both travel along the edges until
nothing changes. A node where the two are equal is in the component of that name. The nodes of a component agree in both
names, so an edge between nodes that don't is between components, and the rest is done again without those found and without
such edges; the least name left of each part finds its own component, so every turn ends some.

Layers are lengths of the longest paths in the graph of components, which has no cycles: rounds of maxima, as many as the
longest path has edges. A round joins edges with one small row a node; several rounds run in one job, and its result is
stored, so the lineage stays short. Names are unique within a repository; all repositories take part in the same rounds.

A repository of at most MOST_BITS nodes needs no rounds: its graph is one row, what a node reaches is a mask of bits, and
column functions close it over all nodes in turn. Masks are equal within a component, and one holds another's where there is
a way to it. Only the repositories with more nodes take part in the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import once
from ..plans.shared import stored

#: Rounds of a job.
ROUNDS = 4
#: Nodes of a repository whose graph is one row: the bits of a long.
MOST_BITS = 64


def until_still(table: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """step applied until no row of what it returns is `changed`."""
    while True:
        for _ in range(rounds):
            table = step(table)
        table = stored(table)
        if table.filter("changed").isEmpty():
            return table.drop("changed")


def ways(edges: DataFrame, nodes: DataFrame, *kinds: str) -> DataFrame:
    """What a node tells to whom: itself (own), and along its edges forth or back. One join a round then does for all."""
    rows = nodes.select("repo_id", "node", F.col("node").alias("to"), F.lit("own").alias("way"))
    for kind, a, b in (("forth", "src", "dst"), ("back", "dst", "src")):
        if kind in kinds:
            rows = rows.union(edges.select("repo_id", F.col(a).alias("node"), F.col(b).alias("to"), F.lit(kind).alias("way")))
    return stored(rows)


def by_size(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """edges and nodes of repositories with at most MOST_BITS nodes, then those of the others."""
    nodes = stored(nodes.select("repo_id", "node").filter("repo_id is not null and node is not null").distinct())
    edges = stored(edges.select("repo_id", "src", "dst").filter("src <> dst").distinct())
    counted = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    few, many = counted.filter(F.col("n") <= MOST_BITS).select("repo_id"), counted.filter(F.col("n") > MOST_BITS).select("repo_id")
    among = lambda frame, repos: frame.join(repos, "repo_id", "left_semi")
    return among(edges, few), among(nodes, few), among(edges, many), among(nodes, many)


def bit(place: Column) -> Column:
    """The mask of a place from 1; none for 0."""
    return F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def masks(names: Column, edges: Column) -> Column:
    """Of each of the sorted names what it reaches, itself included; edges are structs of src and dst."""
    direct = F.transform(names, lambda name, i: F.aggregate(F.filter(edges, lambda e: e["src"] == name), bit(i + 1), lambda mask, e: mask.bitwiseOR(bit(F.array_position(names, e["dst"])))))
    through = lambda all_, k: F.transform(all_, lambda mask: F.when(mask.bitwiseAND(bit(k)) != 0, mask.bitwiseOR(F.element_at(all_, k))).otherwise(mask))
    return F.aggregate(F.sequence(F.lit(1), F.size(names)), direct, through)


def depths(reach: Column) -> Column:
    """(mask, layer) of each distinct mask: a longest way to it passes masks that hold it, those of more bits first."""
    pairs = F.array_sort(F.transform(F.array_distinct(reach), lambda mask: F.struct((-F.bit_count(mask)).alias("few"), mask.alias("mask"))))
    none = F.array().cast("array<struct<mask: bigint, layer: int>>")

    def place(done: Column, pair: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: d["mask"].bitwiseAND(pair["mask"]) == pair["mask"]), lambda d: d["layer"])
        layer = F.coalesce(F.array_max(above) + 1, F.lit(0))
        return F.concat(done, F.array(F.struct(pair["mask"].alias("mask"), layer.alias("layer"))))

    return F.aggregate(pairs, none, place)


def small_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, node) of small repositories with component and layer, a row a repository until the end."""
    names = nodes.groupBy("repo_id").agg(F.array_sort(F.collect_list("node")).alias("names"))
    ways_ = edges.groupBy("repo_id").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    none = F.filter(F.transform("names", lambda name: F.struct(name.alias("src"), name.alias("dst"))), lambda _: F.lit(False))
    graphs = names.join(ways_, "repo_id", "left").withColumn("edges", F.coalesce("edges", none))

    def of_graph(reach: Column) -> Column:
        named = lambda layers_: F.transform(reach, lambda mask, i: F.struct(F.element_at("names", i + 1).alias("node"), F.element_at("names", F.array_position(reach, mask).cast("int")).alias("component"), F.filter(layers_, lambda d: d["mask"] == mask)[0]["layer"].alias("layer")))
        return once(depths(reach), named)

    return graphs.select("repo_id", F.explode(once(masks(F.col("names"), F.col("edges")), of_graph)).alias("x")).select("repo_id", "x.*")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, node) with component, the least name in it; edges(repo_id, src, dst) between others are left out."""
    few_edges, few_nodes, edges, nodes = by_size(edges, nodes)
    small = small_layers(few_edges, few_nodes).drop("layer")
    return stored(small) if nodes.isEmpty() else small.union(components_in_rounds(edges, nodes))


def components_in_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """strong_components() of repositories of any size."""
    left = stored(nodes.select("repo_id", "node").distinct())
    ends = lambda frame: frame.join(left.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_semi").join(left.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_semi")
    edges = stored(ends(edges.select("repo_id", "src", "dst").filter("src <> dst").distinct()))
    found = []
    while True:
        start = left.select("repo_id", "node", F.col("node").alias("reaches"), F.col("node").alias("reached"))
        told = ways(edges, left, "forth", "back")

        def spread(labels: DataFrame, told: DataFrame = told) -> DataFrame:
            heard = labels.join(told, ["repo_id", "node"]).groupBy("repo_id", F.col("to").alias("node"))
            of = lambda c, but: F.min(F.when(F.col("way") != but, F.col(c)))
            own = lambda c: F.min(F.when(F.col("way") == "own", F.col(c)))
            reaches, reached = of("reaches", "forth"), of("reached", "back")
            return heard.agg(reaches.alias("reaches"), reached.alias("reached"), ((reaches < own("reaches")) | (reached < own("reached"))).alias("changed"))

        labels = until_still(start, spread)
        found.append(labels.filter("reaches = reached").select("repo_id", "node", F.col("reaches").alias("component")))
        rest = labels.filter("reaches <> reached")
        if rest.isEmpty():
            break
        left = stored(rest.select("repo_id", "node"))
        named = lambda node: rest.select("repo_id", F.col("node").alias(node), "reaches", "reached")  # noqa: B023, E731
        edges = stored(edges.join(named("src"), ["repo_id", "src"]).join(named("dst"), ["repo_id", "dst", "reaches", "reached"]).select("repo_id", "src", "dst"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return stored(out)


def layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(repo_id, node) with component and layer: the most edges between components on a way to it."""
    few_edges, few_nodes, edges, nodes = by_size(edges, nodes)
    small = small_layers(few_edges, few_nodes)
    return stored(small) if nodes.isEmpty() else small.unionByName(layers_in_rounds(edges, nodes))


def layers_in_rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """layers() of repositories of any size."""
    placed = components_in_rounds(edges, nodes)
    name = lambda end: placed.select("repo_id", F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    between = edges.select("repo_id", "src", "dst").join(name("src"), ["repo_id", "src"]).join(name("dst"), ["repo_id", "dst"]).filter("src_of <> dst_of")
    between = stored(between.select("repo_id", F.col("src_of").alias("src"), F.col("dst_of").alias("dst")).distinct())

    start = placed.select("repo_id", F.col("component").alias("node"), F.lit(0).alias("layer")).distinct()
    told = ways(between, start, "forth")

    def deeper(table: DataFrame) -> DataFrame:
        layer, own = F.max(F.col("layer") + F.when(F.col("way") == "own", 0).otherwise(1)), F.max(F.when(F.col("way") == "own", F.col("layer")))
        return table.join(told, ["repo_id", "node"]).groupBy("repo_id", F.col("to").alias("node")).agg(layer.alias("layer"), (layer > own).alias("changed"))

    depth = until_still(start, deeper).withColumnRenamed("node", "component")
    return placed.join(depth, ["repo_id", "component"]).select("repo_id", "node", "component", "layer")
