"""A small property graph: nodes, edges, neighbours, context text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Joins below carry no hint: whether a graph is small enough to be sent to every executor is checked by its
# size in bytes, from statistics when a query is planned and from what was shuffled when it runs.


def single_edges(edges: DataFrame, order: str | None = None) -> DataFrame:
    """One edge per ordered pair (S8); of several the last by ``order`` (by relation and text where there is none)."""
    by = [F.desc(order)] if order else [F.desc_nulls_last("relation_type"), F.desc_nulls_last("description")]
    w = Window.partitionBy("source_id", "target_id").orderBy(*by)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    ids = nodes.select("node_id")
    return edges.join(ids, F.col("source_id") == ids["node_id"], "left_semi").join(ids, F.col("target_id") == ids["node_id"], "left_semi")


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outgoing neighbours and their names (J10); a node without name is called by its id."""
    names = nodes.select(F.col("node_id").alias("target_id"), "name_fa")
    return edges.join(names, "target_id", "left").select("source_id", "target_id", F.coalesce("name_fa", "target_id").alias("target_name"), "relation_type", "description")


def unknown_nodes(rows: DataFrame, nodes: DataFrame, node: str = "node_id") -> DataFrame:
    """Rows that name a node the graph does not have."""
    ids = nodes.select(F.col("node_id").alias("_id"))
    return rows.join(ids, F.col(node) == F.col("_id"), "left_anti")


def context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, block``: the text of each node with its levels, interventions and outgoing edges.

    Entries of a map stand in order of their keys, edges in order of their targets. Missing texts are empty.
    """
    e = F.lit("")
    text = lambda c: F.coalesce(c, e)
    entries = lambda c: F.array_sort(F.map_entries(c))
    levels = F.transform(
        F.filter(entries("status_levels"), lambda x: x["value"].isNotNull()),
        lambda x: F.concat(F.lit("  - ["), F.upper(x["key"]), F.lit("] ("), text(x["value"]["code"]), F.lit("): "), text(x["value"]["description"]), F.lit("\n")),
    )
    actions = F.transform(entries("interventions"), lambda x: F.concat(F.lit("  - "), x["key"], F.lit(": "), text(x["value"]), F.lit("\n")))
    line = F.concat(F.lit("  -> Affects '"), F.col("target_name"), F.lit("' ["), F.col("target_id"), F.lit("] | Relation: "), text(F.col("relation_type")), F.lit(" ("), text(F.col("description")), F.lit(")\n"))
    out = successors(edges, nodes).groupBy(F.col("source_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("target_id", line.alias("line"))))["line"].alias("lines"))
    joined = nodes.join(out, "node_id", "left")
    block = F.concat(
        F.lit("=== Node: "), F.col("node_id"), F.lit(" ("), text(F.col("name_fa")), F.lit(") ===\nDomain: "), text(F.col("domain")), F.lit("\nDescription: "), text(nodes["description"]),
        F.lit("\n\nStatus Level Definitions:\n"), text(F.array_join(levels, "")), F.lit("\nRecommended Interventions:\n"), text(F.array_join(actions, "")),
        F.when(F.size("lines") > 0, F.concat(F.lit("\nCross-Domain Impacts on Other Nodes:\n"), F.array_join("lines", ""))).otherwise(e),
    )
    return joined.select("node_id", block.alias("block"))


def turn_context(turns: DataFrame, key: str, active: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``key, context``: the blocks of a turn's known active nodes in order of node id, or a sentence for none."""
    blocks = context(nodes, edges)
    asked = turns.select(key, F.explode_outer(F.array_distinct(F.col(active))).alias("node_id")).distinct()
    found = asked.join(blocks, "node_id", "left")
    per = found.groupBy(key).agg(F.count("node_id").alias("n"), F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("node_id", "block"))))["block"].alias("blocks"))
    whole = F.concat(F.lit("\n" + "=" * 50), F.array_join("blocks", "\n"))
    return per.select(key, F.when(F.col("n") == 0, "No specific resilience domains were activated.").otherwise(whole).alias("context"))
