"""Projections of RDF to labelled property graphs: the class graph and the schema meta-graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.terms import abbreviate, checked_rel_type, local_name, rel_type, safe_key, short_name
from ..plans.bgp import Solutions, default_graph
from ..schema import DEFINITION, LABEL, OWL, RDFS, SKOS, SUB, TYPE

NO_DEFINITION = "No definition available."
# RDF types and their node labels, topology predicates and their edge types.
NODE_LABELS = {OWL.term("Class"): "OWLClass", RDFS.term("Class"): "OWLClass", OWL.ObjectProperty: "ObjectProperty", OWL.DatatypeProperty: "DatatypeProperty", OWL.AnnotationProperty: "AnnotationProperty"}
EDGE_TYPES = {RDFS.subClassOf: "SUBCLASS_OF", RDFS.subPropertyOf: "SUBPROPERTY_OF", RDFS.domain: "HAS_DOMAIN", RDFS.range: "HAS_RANGE"}
SCHEMA_LABELS = ["OWLClass", "ObjectProperty", "DatatypeProperty", "AnnotationProperty"]


def extract_classes(quads: DataFrame) -> DataFrame:
    """iri, label, definition, alt_labels (sorted): one row a class, label and definition."""
    q = Solutions(default_graph(quads)).where(("?iri", "a", OWL.term("Class"))).iri("iri")
    q = q.optional(("?iri", LABEL, "?label")).optional(("?iri", DEFINITION, "?definition")).optional(("?iri", SKOS.altLabel, "?alt"))
    return q.df.groupBy("iri", "label", "definition").agg(F.array_sort(F.collect_set("alt")).alias("alt_labels"))


def extract_taxonomy(quads: DataFrame) -> DataFrame:
    q = Solutions(default_graph(quads)).where(("?child", SUB, "?parent")).iri("child", "parent").filter(F.col("parent") != OWL.Thing)
    return q.select("child", "parent", distinct=True)


def extract_properties(quads: DataFrame) -> DataFrame:
    q = Solutions(default_graph(quads)).where(("?property", "a", OWL.ObjectProperty), ("?property", RDFS.domain, "?domain"), ("?property", RDFS.range, "?range"))
    q = q.iri("domain", "range").optional(("?property", LABEL, "?label")).optional(("?property", RDFS.comment, "?definition"))
    return q.select("property", "domain", "range", "label", "definition", distinct=True)


def nodes(classes: DataFrame) -> DataFrame:
    """One row an IRI; of several labels or definitions the smallest (name, definition)."""
    short = short_name(F.col("iri"))
    c = classes.withColumn("name", F.coalesce("label", short)).withColumn("text", F.coalesce("definition", F.lit(NO_DEFINITION)))
    one = c.groupBy("iri").agg(F.min(F.struct("name", "text")).alias("b"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("alt_labels")))).alias("alt_labels"))
    return one.select("iri", F.lit("Class").alias("label"), short.alias("short_name"), F.col("b.name").alias("name"), F.col("b.text").alias("definition"), "alt_labels")


def _ends(edges: DataFrame, known: DataFrame) -> DataFrame:
    ids = known.select("iri")
    return edges.join(ids.select(F.col("iri").alias("src")), "src", "left_semi").join(ids.select(F.col("iri").alias("dst")), "dst", "left_semi")


def edges(taxonomy: DataFrame, properties: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes, one row a (src, dst, key)."""
    none = F.lit(None).cast("string")
    t = taxonomy.select(F.col("child").alias("src"), F.col("parent").alias("dst"), F.lit("SUBCLASS_OF").alias("key"), F.lit("SUBCLASS_OF").alias("type"), F.lit(str(SUB)).alias("iri"), none.alias("name"), none.alias("definition"))
    p = properties.select(F.col("domain").alias("src"), F.col("range").alias("dst"), F.col("property").alias("key"), rel_type(F.col("property")).alias("type"), F.col("property").alias("iri"), F.coalesce("label", local_name(F.col("property"))).alias("name"), "definition")
    p = p.groupBy("src", "dst", "key", "type", "iri").agg(F.min(F.struct("name", "definition")).alias("b")).select("src", "dst", "key", "type", "iri", "b.name", "b.definition")
    return _ends(t, known).unionByName(_ends(p, known)).select("src", "dst", "key", "type", "iri", "name", "definition")


def merged_edges(edges_: DataFrame) -> DataFrame:
    """As a store keyed by type keeps them: two properties of one type between the same ends become one edge."""
    e = edges_.withColumn("type", checked_rel_type(F.col("type")))
    return e.groupBy("src", "dst", "type").agg(F.max_by(F.struct("iri", "name", "definition"), "iri").alias("b")).select("src", "dst", "type", "b.iri", "b.name", "b.definition")


def stats(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    e = edges_.agg(F.count_if(F.col("type") == "SUBCLASS_OF").alias("taxonomy_edges"), F.count_if(F.col("type") != "SUBCLASS_OF").alias("property_edges"))
    return nodes_.agg(F.count("*").alias("nodes")).crossJoin(e)


def profiles(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """iri, profile: name, synonyms, definition and direct superclasses as one text."""
    names = nodes_.select(F.col("iri").alias("dst"), F.col("name").alias("parent"))
    up = edges_.filter("type = 'SUBCLASS_OF'").join(names, "dst").groupBy(F.col("src").alias("iri")).agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    n = nodes_.join(up, "iri", "left")
    definition = F.when(F.col("definition") != NO_DEFINITION, F.concat(F.lit("Definition: "), F.col("definition"), F.when(F.col("definition").endswith("."), "").otherwise(".")))
    text = F.concat_ws(
        " ", F.concat(F.lit("Class: "), F.col("name"), F.lit(".")), F.when(F.size("alt_labels") > 0, F.concat(F.lit("Synonyms: "), F.array_join("alt_labels", ", "), F.lit("."))), definition,
        F.when(F.size("parents") > 0, F.concat(F.lit("Superclasses: "), F.array_join("parents", ", "), F.lit("."))),
    )
    return n.select("iri", text.alias("profile"))


# -- schema meta-graph ---------------------------------------------------------------------------


def _typed(triples: DataFrame) -> DataFrame:
    t = triples.filter((F.col("p") == TYPE) & (F.col("s_kind") == "iri"))
    label = F.create_map(*(F.lit(str(x)) for kv in NODE_LABELS.items() for x in kv))[F.col("o")]
    return t.select(F.col("s").alias("uri"), label.alias("label")).filter("label is not null")


def meta_edges(quads: DataFrame) -> DataFrame:
    """src, dst, type: topology, definition and import edges between named nodes."""
    triples = default_graph(quads)
    kinds = {**EDGE_TYPES, RDFS.isDefinedBy: "DEFINED_IN", OWL.imports: "IMPORTS"}
    kind = F.create_map(*(F.lit(str(x)) for kv in kinds.items() for x in kv))[F.col("p")]
    named = triples.filter(F.col("p").isin([str(k) for k in kinds]) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return named.select(F.col("s").alias("src"), F.col("o").alias("dst"), kind.alias("type")).distinct()


def meta_nodes(quads: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """uri, labels, qname, props: typed nodes, ontologies and the stubs that edges bring.

    Literal properties, several values joined by `` | ``, stand on typed nodes and ontologies only.
    """
    triples = default_graph(quads)
    ontologies = triples.filter((F.col("p") == TYPE) & (F.col("o") == OWL.Ontology) & (F.col("s_kind") == "iri")).select(F.col("s").alias("uri"), F.lit("Ontology").alias("label"))
    own = _typed(triples).unionByName(ontologies).distinct()
    e = meta_edges(quads)
    defined = e.filter("type in ('DEFINED_IN', 'IMPORTS')").select(F.col("dst").alias("uri"), F.lit("Ontology").alias("label"))
    imports = e.filter("type = 'IMPORTS'").select(F.col("src").alias("uri"), F.lit("Ontology").alias("label"))
    stubs = e.select(F.explode(F.array("src", "dst")).alias("uri")).distinct().withColumn("label", F.lit(None).cast("string"))
    literals = triples.filter("o_kind = 'literal'").join(own.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")
    named = literals.withColumn("q", F.col("p")) if prefixes is None else abbreviate(literals, "p", prefixes, "q")
    props = named.groupBy(F.col("s").alias("uri"), safe_key(F.col("q")).alias("k")).agg(F.array_join(F.array_sort(F.collect_set("o")), " | ").alias("v"))
    props = props.groupBy("uri").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    every = own.unionByName(defined).unionByName(imports).unionByName(stubs)
    labelled = every.groupBy("uri").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    out = labelled.join(props, "uri", "left").withColumn("labels", F.when(F.size("labels") == 0, F.array(F.lit("Resource"))).otherwise(F.col("labels")))
    out = out.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    return out.withColumn("qname", F.col("uri")) if prefixes is None else abbreviate(out, "uri", prefixes, "qname")


def primary_label(labels: Column) -> Column:
    return F.coalesce(*(F.when(F.array_contains(labels, x), x) for x in SCHEMA_LABELS), F.array_min(labels), F.lit("Resource"))


def label_counts(meta: DataFrame) -> DataFrame:
    return meta.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def edge_counts(meta: DataFrame) -> DataFrame:
    return meta.groupBy("type").agg(F.count("*").alias("n"))


def node_table(meta: DataFrame) -> DataFrame:
    """uri, label, name, definition (cut to 70 characters)."""
    name = F.coalesce(F.col("props")["rdfs_label"], F.col("qname"))
    d = F.coalesce(F.col("props")["skos_definition"], F.col("props")["rdfs_comment"], F.lit(""))
    return meta.select("uri", primary_label(F.col("labels")).alias("label"), name.alias("name"), F.substring(d, 1, 70).alias("definition"))


def dry_run(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """statement: what a property-graph store would be told, as parameterised merges per label and type."""
    n = nodes_.groupBy("label").agg(F.count("*").alias("n")).select(F.format_string("UNWIND $rows AS r MERGE (x:%s {iri: r.iri}) SET x += r.props  // %d rows", "label", "n").alias("statement"))
    e = edges_.withColumn("type", checked_rel_type(F.col("type"))).groupBy("type").agg(F.count("*").alias("n"))
    e = e.select(F.format_string("UNWIND $rows AS r MATCH (a {iri: r.src}), (b {iri: r.dst}) MERGE (a)-[e:%s]->(b) SET e += r.props  // %d rows", "type", "n").alias("statement"))
    return n.unionByName(e)


# -- graph views ---------------------------------------------------------------------------------


def compose(graphs: dict[str, DataFrame]) -> DataFrame:
    """uri, labels, source: nodes of several graphs; in more than one: ``shared``."""
    parts = [g.select("uri", "labels", F.lit(name).alias("source")) for name, g in graphs.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    g = every.groupBy("uri").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.count_distinct("source").alias("n"), F.min("source").alias("source"))
    return g.select("uri", "labels", F.when(F.col("n") > 1, "shared").otherwise(F.col("source")).alias("source"))


def compare_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """label, n_a, n_b: two label counts side by side, zero where absent."""
    j = a.select("label", F.col("n").alias("n_a")).join(b.select("label", F.col("n").alias("n_b")), "label", "full")
    return j.na.fill(0, ["n_a", "n_b"])


def filter_graph(nodes_: DataFrame, edges_: DataFrame, labels: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with any of the labels, edges of the types whose both ends remain."""
    n = nodes_ if labels is None else nodes_.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels))))
    e = edges_ if types is None else edges_.filter(F.col("type").isin(types))
    ids = n.select("uri")
    return n, e.join(ids.select(F.col("uri").alias("src")), "src", "left_semi").join(ids.select(F.col("uri").alias("dst")), "dst", "left_semi")
