"""Alignment-driven enrichment of a business vocabulary by a reference ontology.

``Enricher`` holds three quad tables: the vocabulary (SKOS), the ontology (OWL) and the mappings
between them. Every step returns a DataFrame; the closure is computed once and shared.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.terms import in_namespaces
from ..plans.fixpoint import cut
from ..schema import DEFINITION, OWL, RDF, SKOS, SUB, TERM, TYPE
from .graphs import restriction_edges
from .reason import clashes, closure_rl, new_triples

EQUIVALENT, CONCEPT, CLASS = OWL.equivalentClass, SKOS.Concept, OWL.term("Class")
# How a mapping is bridged: predicate, and whether subject and object change places.
BRIDGE = {SKOS.exactMatch: (EQUIVALENT, False), SKOS.closeMatch: (SUB, False), SKOS.broadMatch: (SUB, False), SKOS.narrowMatch: (SUB, True)}


def triples(df: DataFrame, s, p, o) -> DataFrame:
    """Triples between IRIs from columns."""
    none = F.lit(None).cast("string")
    return df.select(s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang"))


def pairs(graph: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    return graph.filter((F.col("p") == predicate) & (F.col("o_kind") == "iri")).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()


class Enricher:
    def __init__(self, vocabulary: DataFrame, ontology: DataFrame, mappings: DataFrame, ontology_namespaces: list[str], vocabulary_namespace: str, tiers: tuple[int, ...] = (1,)):
        self.vocabulary, self.ontology, self.mappings = (d.select(*TERM).distinct() for d in (vocabulary, ontology, mappings))
        self.spaces, self.home, self.tiers = ontology_namespaces, vocabulary_namespace, tiers

    def in_ontology(self, c):
        return in_namespaces(c, self.spaces)

    @cached_property
    def concepts(self) -> DataFrame:
        """concept."""
        return self.vocabulary.filter((F.col("p") == TYPE) & (F.col("o") == CONCEPT)).select(F.col("s").alias("concept")).distinct()

    @cached_property
    def individuals(self) -> DataFrame:
        """individual: typed by a concept, itself none."""
        typed = pairs(self.vocabulary, TYPE, "individual", "concept").filter(F.col("concept").startswith(self.home))
        typed = typed.join(self.concepts, "concept", "left_semi").select("individual").distinct()
        return typed.join(self.concepts.select(F.col("concept").alias("individual")), "individual", "left_anti")

    def lift(self) -> DataFrame:
        """OWL reading of the vocabulary: concepts are classes, broader is subclass, instance types stay."""
        classes = triples(self.concepts, F.col("concept"), F.lit(str(TYPE)), F.lit(str(CLASS)))
        broader = pairs(self.vocabulary, SKOS.broader, "concept", "parent").join(self.concepts, "concept", "left_semi")
        types = pairs(self.vocabulary, TYPE, "individual", "type").join(self.individuals, "individual", "left_semi")
        out = classes.unionByName(triples(broader, F.col("concept"), F.lit(str(SUB)), F.col("parent")))
        return out.unionByName(triples(types, F.col("individual"), F.lit(str(TYPE)), F.col("type"))).distinct()

    def bridge_log(self) -> DataFrame:
        """mapping, concept, target, axiom, s, o: one row a mapping; related matches have no axiom."""
        m = self.mappings.filter(F.col("p").isin([str(k) for k in (*BRIDGE, SKOS.relatedMatch)]))
        axiom = F.create_map(*(F.lit(str(x)) for k, (p, _) in BRIDGE.items() for x in (k, p)))[F.col("p")]
        flip = F.col("p") == SKOS.narrowMatch
        return m.select(F.col("p").alias("mapping"), F.col("s").alias("concept"), F.col("o").alias("target"), axiom.alias("axiom"), F.when(flip, F.col("o")).otherwise(F.col("s")).alias("s"), F.when(flip, F.col("s")).otherwise(F.col("o")).alias("o"))

    def bridge(self) -> DataFrame:
        return triples(self.bridge_log().filter("axiom is not null"), F.col("s"), F.col("axiom"), F.col("o")).distinct()

    def _stated(self) -> DataFrame:
        out = self.ontology
        for part in (self.vocabulary, self.lift(), self.bridge(), self.mappings):
            out = out.unionByName(part)
        return out

    @cached_property
    def asserted(self) -> DataFrame:
        return cut(self._stated().distinct())

    @cached_property
    def inferred(self) -> DataFrame:
        return closure_rl(self.asserted, self.tiers)

    @cached_property
    def hierarchy(self) -> DataFrame:
        """Subclass and equivalence triples of ``inferred``; in tier 1 they follow from each other alone, so types of individuals are not derived."""
        own = F.col("p").isin(str(SUB), str(EQUIVALENT))
        if tuple(self.tiers) != (1,) or "inferred" in self.__dict__:
            return self.inferred.filter(own)
        return closure_rl(cut(self._stated().filter(own).distinct()), self.tiers)

    @cached_property
    def new(self) -> DataFrame:
        return cut(new_triples(self.inferred, self.asserted))

    def counts(self) -> dict[str, int]:
        return {"concepts": self.concepts.count(), "asserted": self.asserted.count(), "inferred": self.inferred.count(), "new_triples": self.new.count()}

    def subsumption(self) -> DataFrame:
        """concept, relation (equivalentTo, mapped_parent, inferred_ancestor), target."""
        eq = pairs(self.inferred, EQUIVALENT, "concept", "target").filter(self.in_ontology(F.col("target"))).join(self.concepts, "concept", "left_semi")
        up = pairs(self.inferred, SUB, "concept", "target").filter(self.in_ontology(F.col("target")) & (F.col("concept") != F.col("target"))).join(self.concepts, "concept", "left_semi")
        up = up.join(eq, ["concept", "target"], "left_anti")
        fresh = pairs(self.new, SUB, "concept", "target").withColumn("fresh", F.lit(True))
        up = up.join(fresh, ["concept", "target"], "left").select("concept", F.when(F.col("fresh"), "inferred_ancestor").otherwise("mapped_parent").alias("relation"), "target")
        return eq.select("concept", F.lit("equivalentTo").alias("relation"), "target").unionByName(up)

    def instances(self) -> DataFrame:
        """individual, type, is_new: ontology types of individuals."""
        t = pairs(self.inferred, TYPE, "individual", "type").filter(self.in_ontology(F.col("type"))).join(self.individuals, "individual", "left_semi")
        fresh = pairs(self.new, TYPE, "individual", "type").withColumn("is_new", F.lit(True))
        return t.join(fresh, ["individual", "type"], "left").select("individual", "type", F.coalesce("is_new", F.lit(False)).alias("is_new"))

    def relationships(self, concepts: DataFrame | None = None) -> DataFrame:
        """concept, property, value_type: restrictions of a concept and of all above it; a filler outside the vocabulary first, then the smallest."""
        own = (concepts or self.concepts).select("concept")
        above = pairs(self.inferred, SUB, "concept", "cls").join(own, "concept", "left_semi").unionByName(own.select("concept", F.col("concept").alias("cls"))).distinct()
        held = restriction_edges(self.inferred).select(F.col("src").alias("cls"), "property", F.col("dst").alias("value_type")).filter(self.in_ontology(F.col("value_type")))
        found = above.join(held, "cls")
        best = F.min(F.struct(F.col("value_type").startswith(self.home).alias("own"), "value_type"))
        return found.groupBy("concept", "property").agg(best.alias("b")).select("concept", "property", "b.value_type")

    def annotations(self) -> DataFrame:
        """concept, source, definition: of mapped classes, for concepts without; exact before close before broad."""
        have = self.vocabulary.filter(F.col("p") == DEFINITION).select(F.col("s").alias("concept"))
        order = F.create_map(*(x for i, k in enumerate((SKOS.exactMatch, SKOS.closeMatch, SKOS.broadMatch)) for x in (F.lit(str(k)), F.lit(i))))[F.col("p")]
        m = self.mappings.withColumn("rank", order).filter("rank is not null")
        target = m.groupBy(F.col("s").alias("concept")).agg(F.min(F.struct("rank", "o")).alias("b")).select("concept", F.col("b.o").alias("source"))
        text = self.ontology.filter(F.col("p") == DEFINITION).groupBy(F.col("s").alias("source")).agg(F.min("o").alias("definition"))
        return self.concepts.join(have, "concept", "left_anti").join(target, "concept").join(text, "source").select("concept", "source", "definition")

    def validate(self, extra: DataFrame) -> DataFrame:
        """Clashes of the asserted graph with further triples."""
        return clashes(closure_rl(self.asserted.unionByName(extra.select(*TERM)).distinct(), self.tiers))

    def enriched(self) -> DataFrame:
        """The vocabulary with its alignment, inferred ancestry and copied definitions."""
        anc = self.subsumption().filter("relation = 'inferred_ancestor'")
        out = self.vocabulary.unionByName(self.mappings)
        for p in (SUB, SKOS.broadMatch):
            out = out.unionByName(triples(anc, F.col("concept"), F.lit(str(p)), F.col("target")))
        notes = self.annotations()
        for p, text in ((DEFINITION, F.col("definition")), (SKOS.editorialNote, F.concat(F.lit("Definition enriched from "), F.col("source"), F.lit(".")))):
            t = triples(notes, F.col("concept"), F.lit(str(p)), text)
            out = out.unionByName(t.withColumn("o_kind", F.lit("literal")).withColumn("o_lang", F.lit("en")))
        return out.distinct()


# -- glossary ------------------------------------------------------------------------------------

ATTRIBUTES = "struct<Definition string, `Preferred Term` boolean, `Preferred Term Label` string, Acronym string, Synonym array<string>, `Data Steward` string, Example string, Note string>"
GLOSSARY = f"community struct<id string, name string>, domain struct<id string, name string, type string>, dataCategory struct<id string, name string, assetType string, scope string, definition string>, assets array<struct<id string, name string, assetType string, status string, attributes {ATTRIBUTES}>>, relations array<struct<source string, type string, target string>>"


def glossary_terms(doc: DataFrame, asset_type: str = "Business Term") -> DataFrame:
    """Terms of a glossary export, a row each."""
    a = doc.select(F.explode("assets").alias("a")).select("a.*").filter(F.col("assetType") == asset_type)
    at = F.col("attributes")
    return a.select("id", "name", "status", at["Definition"].alias("definition"), F.coalesce(at["Preferred Term"], F.lit(False)).alias("preferred"), at["Preferred Term Label"].alias("preferred_label"), at["Acronym"].alias("acronym"), F.coalesce(at["Synonym"], F.array().cast("array<string>")).alias("synonyms"))


def glossary_relations(doc: DataFrame) -> DataFrame:
    """source, type, target by name; an unknown id stands for itself."""
    names = doc.select(F.explode("assets").alias("a")).select("a.id", "a.name")
    r = doc.select(F.explode("relations").alias("r")).select("r.*")
    r = r.join(names.select(F.col("id").alias("source"), F.col("name").alias("s")), "source", "left").join(names.select(F.col("id").alias("target"), F.col("name").alias("t")), "target", "left")
    return r.select(F.coalesce("s", "source").alias("source"), "type", F.coalesce("t", "target").alias("target"))


def map_terms(terms: DataFrame, curated: DataFrame) -> DataFrame:
    """Terms with their curated target and mapping kind; unmapped terms have nulls."""
    return terms.join(curated.select(F.col("term").alias("name"), "target", "mapping"), "name", "left")


def preferred(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row a key, the first by order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def build_model(mapped: DataFrame, home: str) -> DataFrame:
    """OWL triples of mapped terms: class, label, synonyms, and the mapping's axiom."""
    from ..functions.terms import slug

    m = mapped.withColumn("iri", F.concat(F.lit(home), slug(F.col("name"))))
    none = F.lit(None).cast("string")
    literal = lambda df, p, o: df.select(F.col("iri").alias("s"), F.lit("iri").alias("s_kind"), F.lit(str(p)).alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_dtype"), F.lit("en").alias("o_lang"))
    out = triples(m, F.col("iri"), F.lit(str(TYPE)), F.lit(str(CLASS)))
    out = out.unionByName(literal(m, SKOS.prefLabel, F.col("name")))
    out = out.unionByName(literal(m.select("iri", F.explode("synonyms").alias("x")), SKOS.altLabel, F.col("x")))
    out = out.unionByName(literal(m.filter("definition is not null"), DEFINITION, F.col("definition")))
    exact = m.filter("mapping = 'exact' and target is not null")
    close = m.filter("mapping in ('close', 'broad') and target is not null")
    narrow = m.filter("mapping = 'narrow' and target is not null")
    out = out.unionByName(triples(exact, F.col("iri"), F.lit(str(EQUIVALENT)), F.col("target"))).unionByName(triples(close, F.col("iri"), F.lit(str(SUB)), F.col("target")))
    return out.unionByName(triples(narrow, F.col("target"), F.lit(str(SUB)), F.col("iri"))).distinct()


__all__ = ["Enricher", "RDF", "build_model", "glossary_relations", "glossary_terms", "map_terms", "preferred", "triples"]
