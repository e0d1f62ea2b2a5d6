"""Structural queries over named graphs: inventory, hierarchy, cross-graph and property analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.terms import ontology_label
from ..plans.bgp import KIND, Solutions, default_graph
from ..plans.fixpoint import closure
from ..schema import DEFINITION, LABEL, OWL, RDFS, SKOS, SKOS_RELATIONS, SUB

CLASS = OWL.term("Class")


class Structure:
    """Queries over a quads table; ``ontology`` restricts by IRI prefix.

    Unqualified queries read the union of all graphs as a set; ``union`` gives it where it is had
    without comparing all quads. Optional parts multiply rows, as left joins do.
    """

    def __init__(self, quads: DataFrame, union: DataFrame | None = None):
        self.quads = quads
        self.union = default_graph(quads) if union is None else union

    def _all(self) -> Solutions:
        return Solutions(self.union)

    def list_ontologies(self) -> DataFrame:
        q = Solutions(self.quads).where(("?ontology", "a", OWL.Ontology), graph="?graph")
        return q.optional(("?ontology", LABEL, "?label"), graph="?graph").select("ontology", "label", "graph").orderBy("ontology")

    def classes(self, ontology: str | None = None) -> DataFrame:
        q = self._all().where(("?class", "a", CLASS)).iri("class").scope("class", ontology)
        q = q.optional(("?class", LABEL, "?label")).optional(("?class", DEFINITION, "?definition"))
        return q.select("class", "label", "definition", distinct=True).orderBy("label", "class")

    def _properties(self, kind: str, ontology: str | None, last: str, last_iri: bool) -> DataFrame:
        q = self._all().where(("?property", "a", kind)).iri("property").scope("property", ontology)
        q = q.optional(("?property", LABEL, "?label")).optional(("?property", RDFS.domain, "?domain"), iri=("domain",))
        q = q.optional(("?property", RDFS.range, f"?{last}"), iri=(last,) if last_iri else ())
        return q.select("property", "label", "domain", last, distinct=True).orderBy("label", "property")

    def object_properties(self, ontology: str | None = None) -> DataFrame:
        return self._properties(OWL.ObjectProperty, ontology, "range", True)

    def data_properties(self, ontology: str | None = None) -> DataFrame:
        return self._properties(OWL.DatatypeProperty, ontology, "datatype", False)

    def skos_relations(self, ontology: str | None = None) -> DataFrame:
        q = self._all().where(("?source", "?relation", "?target")).values("relation", [SKOS.term(r) for r in SKOS_RELATIONS])
        return q.scope("source", ontology).select("source", "relation", "target").orderBy("relation", "source")

    def skos_relation_summary(self) -> DataFrame:
        used = self.union.filter(F.col("p").startswith(str(SKOS)))
        return used.groupBy(F.col("p").alias("predicate")).agg(F.count("*").alias("count")).orderBy(F.desc("count"))

    def _hierarchy(self, start: str, end: str, cls: str, direct: bool, name: str) -> DataFrame:
        edges = self.union.filter((F.col("p") == SUB) & (F.col("o_kind") != "literal")).select(F.col(start).alias("src"), F.col(end).alias("dst"))
        if direct:
            found = edges.filter(F.col("src") == cls)
        else:
            found = closure(edges, edges.sparkSession.range(1).select(F.lit(cls).alias("src")))
        # bnode ids and IRIs never coincide; the path may run through bnodes, its end may not be one
        kind = f"{end}_kind"
        iris = self.union.filter((F.col("p") == SUB) & (F.col(kind) == "iri")).select(F.col(end).alias("dst")).distinct()
        found = found.filter(F.col("dst") != cls).join(iris, "dst", "left_semi").select(F.col("dst").alias(name))
        labels = self.union.filter(F.col("p") == LABEL).select(F.col("s").alias(name), F.col("o").alias("label"))
        return found.join(labels, name, "left").select(name, "label").distinct().orderBy("label")

    def superclasses(self, cls: str, direct: bool = True) -> DataFrame:
        return self._hierarchy("s", "o", cls, direct, "superclass")

    def subclasses(self, cls: str, direct: bool = True) -> DataFrame:
        return self._hierarchy("o", "s", cls, direct, "subclass")

    def roots_and_leaves(self, ontology: str) -> DataFrame:
        q = self._all().where(("?class", "a", CLASS)).iri("class").scope("class", ontology)
        classes = q.select("class", distinct=True)
        edges = self.union.filter((F.col("p") == SUB) & (F.col("s") != F.col("o")))
        up = edges.filter(F.col("o_kind") == "iri").select(F.col("s").alias("class")).distinct().withColumn("has_parent", F.lit(True))
        down = edges.filter(F.col("s_kind") == "iri").select(F.col("o").alias("class")).distinct().withColumn("has_child", F.lit(True))
        labels = self.union.filter(F.col("p") == LABEL).select(F.col("s").alias("class"), F.col("o").alias("label"))
        out = classes.join(up, "class", "left").join(down, "class", "left").join(labels, "class", "left")
        return out.select("class", "label", F.col("has_parent").isNull().alias("is_root"), F.col("has_child").isNull().alias("is_leaf")).orderBy(F.desc("is_root"), "label")

    def cross_ontology_subclass_edges(self, min_edges: int = 1) -> DataFrame:
        q = Solutions(self.quads)
        child = q.where(("?c", "a", CLASS), ("?c", SUB, "?p"), graph="?gc").iri("c", "p")
        child = child.where(("?child_ontology", "a", OWL.Ontology), graph="?gc")
        parent = q.where(("?p", "a", CLASS), graph="?gp").where(("?parent_ontology", "a", OWL.Ontology), graph="?gp")
        both = child.df.drop("p" + KIND).join(parent.df.drop("p" + KIND), "p").filter("gc <> gp")
        counted = both.groupBy("child_ontology", "parent_ontology").agg(F.count("*").alias("edges"))
        return counted.filter(F.col("edges") >= int(min_edges)).orderBy(F.desc("edges"))

    def property_domain_range(self, ontology: str | None = None) -> DataFrame:
        q = self._all().where(("?property", "a", OWL.ObjectProperty), ("?property", RDFS.domain, "?domain"), ("?property", RDFS.range, "?range"))
        q = q.iri("property", "domain", "range").scope("property", ontology).optional(("?property", LABEL, "?label"))
        return q.select("property", "label", "domain", "range", distinct=True).orderBy("label")

    def cross_ontology_object_properties(self) -> DataFrame:
        q = Solutions(self.quads)
        p = q.where(("?property", "a", OWL.ObjectProperty), ("?property", RDFS.domain, "?d"), ("?property", RDFS.range, "?r"), graph="?gp").iri("d", "r")
        homes = q.where(("?x", "a", CLASS), graph="?g").where(("?ontology", "a", OWL.Ontology), graph="?g")
        home = homes.select("x", "g", "ontology")
        d = home.select(F.col("x").alias("d"), F.col("g").alias("gd"), F.col("ontology").alias("domain_ontology"))
        r = home.select(F.col("x").alias("r"), F.col("g").alias("gr"), F.col("ontology").alias("range_ontology"))
        both = p.select("property", "d", "r").join(d, "d").join(r, "r").filter("gd <> gr")
        return both.groupBy("domain_ontology", "range_ontology").agg(F.countDistinct("property").alias("properties")).orderBy(F.desc("properties"))

    def dependency_edges(self) -> DataFrame:
        """child, parent, edges by short label: the matrix in long form."""
        e = self.cross_ontology_subclass_edges(1)
        return e.groupBy(ontology_label(F.col("child_ontology")).alias("child"), ontology_label(F.col("parent_ontology")).alias("parent")).agg(F.sum("edges").alias("edges"))

    def dependency_matrix(self) -> DataFrame:
        long = self.dependency_edges()
        return long.groupBy("child").pivot("parent").agg(F.sum("edges")).na.fill(0)

    def busiest(self, k: int = 8) -> DataFrame:
        """Sub-matrix, long form, of the k rows and k columns with most non-zero cells; ties by name."""
        long = self.dependency_edges()
        rows = long.groupBy("child").agg(F.countDistinct("parent").alias("n")).orderBy(F.desc("n"), "child").limit(k).select("child")
        columns = long.groupBy("parent").agg(F.countDistinct("child").alias("n")).orderBy(F.desc("n"), "parent").limit(k).select("parent")
        return long.join(rows, "child", "left_semi").join(columns, "parent", "left_semi")

    @staticmethod
    def for_agent(df: DataFrame, limit: int | None = None) -> list[dict]:
        """Rows as dictionaries of strings, unbound as empty; streamed, not collected at once."""
        shown = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))
        return [r.asDict() for r in (shown if limit is None else shown.limit(limit)).toLocalIterator()]
