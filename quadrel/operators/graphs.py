"""Graph operators over edge tables and taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.fixpoint import closure, components, has_cycle, longest_depth, reach_with_depth, shortest_path, strong_components  # noqa: F401
from ..schema import OWL, RDF, SUB, TYPE


def subclass_edges(quads: DataFrame) -> DataFrame:
    """(src, dst) of asserted subclass triples between IRIs."""
    return quads.filter((F.col("p") == SUB) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def successors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")


def bounded_paths(edges: DataFrame, seeds: DataFrame, most: int = 8) -> DataFrame:
    """(src, dst) over paths of one to ``most`` edges."""
    return closure(edges, seeds, max_rounds=most)


def nearest_ancestors(paths: DataFrame, universe: DataFrame) -> DataFrame:
    """(src, dst): ancestors in the universe that have no other such ancestor of src below them.

    ``paths`` is a closure; a candidate is dropped if another candidate of src is under it.
    """
    inside = paths.join(universe.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    lower = inside.select("src", F.col("dst").alias("low"))
    under = paths.select(F.col("src").alias("low"), "dst").filter("low <> dst")
    beaten = lower.join(under, "low").select("src", "dst").distinct()
    return inside.join(beaten, ["src", "dst"], "left_anti")


def condensed(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups of mutually reachable nodes, edges between groups)."""
    groups = strong_components(edges)
    a = groups.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = groups.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    e = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).filter("src <> dst").distinct()
    return groups, e


def taxonomy_view(quads: DataFrame) -> DataFrame:
    """src, dst, etype: one type a pair; of several the one listed last wins, as later additions do."""
    order = [(SUB, "subClassOf"), (OWL.equivalentClass, "equivalentClass"), (RDF.type, "type")]
    kind = F.create_map(*(x for i, (p, _) in enumerate(order) for x in (F.lit(str(p)), F.lit(i))))[F.col("p")]
    e = quads.filter(F.col("p").isin([str(p) for p, _ in order]) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    name = F.array(*(F.lit(n) for _, n in order))
    return e.groupBy(F.col("s").alias("src"), F.col("o").alias("dst")).agg(F.max(kind).alias("k")).select("src", "dst", F.get(name, F.col("k")).alias("etype"))


def restriction_edges(quads: DataFrame) -> DataFrame:
    """src, property, dst: existential restrictions on named classes, read through their blank nodes."""
    sub = quads.filter((F.col("p") == SUB) & (F.col("o_kind") == "bnode") & (F.col("s_kind") == "iri")).select(F.col("s").alias("src"), F.col("o").alias("r"))
    part = lambda p, n: quads.filter((F.col("p") == p) & (F.col("s_kind") == "bnode")).select(F.col("s").alias("r"), F.col("o").alias(n))
    typed = quads.filter((F.col("p") == TYPE) & (F.col("o") == OWL.Restriction)).select(F.col("s").alias("r"))
    return sub.join(part(OWL.onProperty, "property"), "r").join(part(OWL.someValuesFrom, "dst"), "r").join(typed, "r", "left_semi").select("src", "property", "dst").distinct()


def with_inverse(edges: DataFrame, kind: str, inverse: str) -> DataFrame:
    """Typed edges and, for each of one type, the opposite of the inverse type."""
    back = edges.filter(F.col("type") == kind).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(inverse).alias("type"))
    return edges.select("src", "dst", "type").unionByName(back).distinct()
