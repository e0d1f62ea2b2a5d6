"""Canonical schemas and vocabulary."""

from __future__ import annotations

QUADS = "g string, s string, s_kind string, p string, o string, o_kind string, o_dtype string, o_lang string"
TERM = ["s", "s_kind", "p", "o", "o_kind", "o_dtype", "o_lang"]
PREFIXES = "prefix string, namespace string"
LPG_NODES = "iri string, label string, short_name string, name string, definition string, alt_labels array<string>"
LPG_EDGES = "src string, dst string, key string, type string, iri string, name string, definition string"
META_NODES = "uri string, labels array<string>, qname string, props map<string,string>"
META_EDGES = "src string, dst string, type string"
TOKENS = "doc_id bigint, sent_id int, pos int, surface string, lemma string, tag string"


class Namespace(str):
    """A namespace whose attributes are its terms."""

    def __getattr__(self, name: str) -> str:
        if name.startswith("__"):
            raise AttributeError(name)
        return f"{self}{name}"

    def term(self, name: str) -> str:
        return f"{self}{name}"


RDF = Namespace("http://www.w3.org/1999/02/22-rdf-syntax-ns#")
RDFS = Namespace("http://www.w3.org/2000/01/rdf-schema#")
OWL = Namespace("http://www.w3.org/2002/07/owl#")
SKOS = Namespace("http://www.w3.org/2004/02/skos/core#")
XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
DEFAULT_PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "skos": SKOS}
TYPE, LABEL, SUB, DEFINITION = RDF.type, RDFS.label, RDFS.subClassOf, SKOS.definition
# SKOS relations that are reported, and those that map between vocabularies.
SKOS_RELATIONS = ["broader", "narrower", "broaderTransitive", "narrowerTransitive", "related", "broadMatch", "narrowMatch", "exactMatch", "closeMatch", "relatedMatch", "mappingRelation", "isNarrowerThan", "isBroaderThan"]
MAPPINGS = ["exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch"]
