"""Reasoning patterns P1-P8: what the ontology says that the vocabulary lacks.

Taxonomy closure, coverage and the missing classes are computed once. Choices that iteration
order would decide have a stated tie-break: the smallest IRI, unless noted.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.terms import last_name
from ..plans.fixpoint import closure, cut
from ..schema import LABEL, OWL, RDFS, SKOS, TYPE, XSD
from .enrich import CLASS, EQUIVALENT, Enricher, pairs, triples
from .graphs import nearest_ancestors, restriction_edges, subclass_edges

# Pattern catalog (id, what it does, policy).
CATALOG = [
    ("P1", "ancestry derivation", "MATERIALISE"), ("P2", "correct parent", "PROPOSE"), ("P3", "missing intermediate concepts", "PROPOSE"), ("P4", "missing narrower concepts", "PROPOSE"),
    ("P5", "missing object properties", "PROPOSE"), ("P6", "missing data properties", "PROPOSE"), ("P7", "parent assignment", "PROPOSE"), ("P8", "parent validation", "REPORT"),
]


class Patterns:
    def __init__(self, enricher: Enricher, default_parent: str | None = None):
        self.e = enricher
        self.root = default_parent or enricher.home + "BusinessAsset"

    @cached_property
    def edges(self) -> DataFrame:
        return cut(subclass_edges(self.e.ontology))

    @cached_property
    def paths(self) -> DataFrame:
        """(src, dst): strict ancestors in the ontology."""
        return cut(closure(self.edges).filter("src <> dst"))

    @cached_property
    def classes(self) -> DataFrame:
        o = self.e.ontology.filter((F.col("p") == TYPE) & (F.col("o") == CLASS) & (F.col("s_kind") == "iri"))
        return cut(o.select(F.col("s").alias("cls")).distinct())

    def _mapped(self, predicates: list[str]) -> DataFrame:
        m = self.e.mappings.filter(F.col("p").isin([str(p) for p in predicates])).select(F.col("s").alias("concept"), F.col("o").alias("cls"), F.when(F.col("p") == SKOS.closeMatch, 1).otherwise(0).alias("later"))
        return m

    @cached_property
    def covered(self) -> DataFrame:
        """cls, concept: classes at a concept's own level; of several, a close match, then the largest concept, stands last and wins."""
        m = self._mapped([SKOS.exactMatch, SKOS.closeMatch]).filter(self.e.in_ontology(F.col("cls")))
        return cut(m.groupBy("cls").agg(F.max(F.struct("later", "concept")).alias("b")).select("cls", "b.concept"))

    @cached_property
    def broadened(self) -> DataFrame:
        """concept, cls: classes that a concept is narrower than; of several, the largest."""
        m = self._mapped([SKOS.broadMatch]).filter(self.e.in_ontology(F.col("cls")))
        return cut(m.groupBy("concept").agg(F.max("cls").alias("cls")))

    @cached_property
    def anchors(self) -> DataFrame:
        m = self._mapped([SKOS.exactMatch, SKOS.closeMatch])
        return m.groupBy("concept").agg(F.max(F.struct("later", "cls")).alias("b")).select("concept", "b.cls")

    def p1(self) -> DataFrame:
        """concept, equivalent_to, derived_ancestors (sorted by IRI; an equivalent class is an ancestor too)."""
        c = self.e.concepts
        up = pairs(self.e.hierarchy, RDFS.subClassOf, "concept", "t").filter(self.e.in_ontology(F.col("t")) & (F.col("t") != F.col("concept"))).join(c, "concept", "left_semi")
        eq = pairs(self.e.hierarchy, EQUIVALENT, "concept", "t").filter(self.e.in_ontology(F.col("t"))).join(c, "concept", "left_semi")
        listed = lambda d, n: d.groupBy("concept").agg(F.array_sort(F.collect_set("t")).alias(n))
        none = F.array().cast("array<string>")
        both = listed(eq, "equivalent_to").join(listed(up, "derived_ancestors"), "concept", "full")
        return both.select("concept", F.coalesce("equivalent_to", none).alias("equivalent_to"), F.coalesce("derived_ancestors", none).alias("derived_ancestors"))

    @cached_property
    def declared(self) -> DataFrame:
        """cls, property, value_type, kind: by existential restriction, or by domain and range (smallest of several)."""
        o = self.e.ontology
        r = restriction_edges(o).select(F.col("src").alias("cls"), "property", F.col("dst").alias("value_type"))
        one = lambda p, n: o.filter(F.col("p") == p).groupBy(F.col("s").alias("property")).agg(F.min("o").alias(n))
        d = one(RDFS.domain, "cls").join(one(RDFS.range, "value_type"), "property").select("cls", "property", "value_type")
        data = o.filter((F.col("p") == TYPE) & (F.col("o") == OWL.DatatypeProperty)).select(F.col("s").alias("property")).distinct().withColumn("data", F.lit(True))
        both = r.unionByName(d).distinct().join(self.classes, "cls", "left_semi").join(data, "property", "left")
        kind = F.when(F.col("data") | F.col("value_type").startswith(str(XSD)), "data").otherwise("object")
        return cut(both.select("cls", "property", "value_type", kind.alias("kind")))

    @cached_property
    def missing(self) -> DataFrame:
        """cls, category: uncovered classes above, between or below covered ones, broad targets, value types."""
        covered = self.covered.select("cls")
        open_ = self.classes.join(covered, "cls", "left_anti")
        up = self.paths.join(covered.withColumnRenamed("cls", "src"), "src", "left_semi").select(F.col("dst").alias("cls")).distinct().withColumn("up", F.lit(True))
        down = self.paths.join(covered.withColumnRenamed("cls", "dst"), "dst", "left_semi").select(F.col("src").alias("cls")).distinct().withColumn("down", F.lit(True))
        broad = self.broadened.select("cls").distinct().withColumn("broad", F.lit(True))
        j = open_.join(up, "cls", "left").join(down, "cls", "left").join(broad, "cls", "left").filter("up or down or broad")
        found = j.select("cls", F.when(F.col("up") & F.col("down"), "intermediate").when(F.col("up"), "ancestor").otherwise("narrower").alias("category"))
        referenced = self.declared.filter("kind = 'object'").select(F.col("value_type").alias("cls")).distinct().join(open_, "cls", "left_semi").join(found, "cls", "left_anti")
        return cut(found.unionByName(referenced.select("cls", F.lit("referenced").alias("category"))))

    @cached_property
    def _near(self) -> DataFrame:
        """(src, dst): nearest ancestors that are or will be in the vocabulary."""
        universe = self.covered.select(F.col("cls").alias("node")).unionByName(self.missing.select(F.col("cls").alias("node")))
        return cut(nearest_ancestors(self.paths, universe))

    def _own_name(self, c):
        return F.concat(F.lit(self.e.home), last_name(c))

    @cached_property
    def placement(self) -> DataFrame:
        """cls, parent: the concept, present or proposed, under which a class would stand; smallest nearest class wins."""
        pick = self._near.groupBy(F.col("src").alias("cls")).agg(F.min("dst").alias("near"))
        j = self.missing.select("cls").join(pick, "cls", "left").join(self.covered.select(F.col("cls").alias("near"), "concept"), "near", "left")
        return j.select("cls", F.when(F.col("near").isNull(), self.root).otherwise(F.coalesce("concept", self._own_name(F.col("near")))).alias("parent"))

    def _concept_rows(self, categories: list[str]) -> DataFrame:
        labels = self.e.ontology.filter(F.col("p") == LABEL).groupBy(F.col("s").alias("cls")).agg(F.min("o").alias("l"))
        m = self.missing.filter(F.col("category").isin(categories)).join(labels, "cls", "left").join(self.placement, "cls")
        return m.select("cls", "category", F.coalesce("l", last_name(F.col("cls"))).alias("label"), self._own_name(F.col("cls")).alias("suggested_concept"), F.col("parent").alias("suggested_parent"))

    def p3(self) -> DataFrame:
        return self._concept_rows(["intermediate", "ancestor"])

    def p4(self) -> DataFrame:
        return self._concept_rows(["narrower", "referenced"])

    def p2(self) -> DataFrame:
        """concept, current_parent, correct_parent (arrays): where broader disagrees with the ontology."""
        anchor = self.e.concepts.join(self.anchors.withColumnRenamed("cls", "anchor"), "concept", "left").join(self.broadened.withColumnRenamed("cls", "broad"), "concept", "left").filter("anchor is not null or broad is not null")
        up = self.edges.select(F.col("src").alias("anchor"), F.col("dst").alias("direct"))
        direct = anchor.filter("broad is null").join(up, "anchor").select("concept", F.col("direct").alias("cls"))
        wanted = direct.unionByName(anchor.filter("broad is not null").select("concept", F.col("broad").alias("cls")))
        wanted = wanted.join(self.covered.withColumnRenamed("concept", "is"), "cls", "left")
        wanted = wanted.groupBy("concept").agg(F.array_sort(F.collect_set(F.coalesce("is", self._own_name(F.col("cls"))))).alias("wanted"), F.array_sort(F.collect_list(F.struct("cls", F.coalesce("is", F.concat(self._own_name(F.col("cls")), F.lit(" (propose)"))).alias("r")))).alias("rows"))
        now = pairs(self.e.vocabulary, SKOS.broader, "concept", "b").groupBy("concept").agg(F.array_sort(F.collect_set("b")).alias("now"))
        none = F.array().cast("array<string>")
        j = wanted.join(now, "concept", "left").withColumn("now", F.coalesce("now", none)).filter("wanted <> now")
        return j.select("concept", F.when(F.size("now") == 0, F.array(F.lit("(none)"))).otherwise(F.col("now")).alias("current_parent"), F.transform("rows", lambda x: x["r"]).alias("correct_parent"))

    def p7(self) -> DataFrame:
        """new_concept, assign_parent, reparent_children."""
        kids = self._near.join(self.covered.withColumnRenamed("cls", "src"), "src").groupBy(F.col("dst").alias("cls")).agg(F.array_sort(F.collect_set("concept")).alias("children"))
        j = self.missing.select("cls").join(self.placement, "cls").join(kids, "cls", "left")
        return j.select(self._own_name(F.col("cls")).alias("new_concept"), F.col("parent").alias("assign_parent"), F.coalesce("children", F.array().cast("array<string>")).alias("reparent_children"))

    def _property_rows(self, kind: str) -> DataFrame:
        """concept, property, value_type: each property once, at the most general class that declares it."""
        owner = self.missing.select("cls", self._own_name(F.col("cls")).alias("concept")).unionByName(self.covered.select("cls", "concept"))
        d = self.declared.filter(F.col("kind") == kind).join(owner, "cls")
        upper = d.select("property", F.col("cls").alias("dst")).distinct()
        above = d.select("property", F.col("cls").alias("src")).distinct().join(self.paths, "src").join(upper, ["property", "dst"], "left_semi").select("property", F.col("src").alias("cls")).distinct()
        top = d.join(above, ["property", "cls"], "left_anti")
        return top.groupBy("property").agg(F.min(F.struct("cls", "concept", "value_type")).alias("b")).select("b.concept", "property", "b.value_type")

    def p5(self) -> DataFrame:
        return self._property_rows("object")

    def p6(self) -> DataFrame:
        return self._property_rows("data")

    def p8(self, extra: DataFrame) -> DataFrame:
        return self.e.validate(extra)

    def derived(self) -> DataFrame:
        """Triples to materialise: ancestry."""
        up = self.e.subsumption().filter("relation = 'inferred_ancestor'")
        return triples(up, F.col("concept"), F.lit(str(RDFS.subClassOf)), F.col("target")).withColumn("policy", F.lit("MATERIALISE"))

    def candidates(self) -> DataFrame:
        """Triples to propose: missing concepts with their parents."""
        m = self.p7()
        c = triples(m, F.col("new_concept"), F.lit(str(TYPE)), F.lit(str(SKOS.Concept)))
        p = triples(m, F.col("new_concept"), F.lit(str(SKOS.broader)), F.col("assign_parent"))
        kids = m.select(F.explode("reparent_children").alias("child"), "new_concept")
        return c.unionByName(p).unionByName(triples(kids, F.col("child"), F.lit(str(SKOS.broader)), F.col("new_concept"))).withColumn("policy", F.lit("PROPOSE"))
