"""Registered queries: one or more an operator, over the whole tables, with their SQL beside them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import terms as tm
from .operators import diff, embed, graphs, lpg, models, reason, store, text
from .operators.structure import Structure
from .plans import fixpoint
from .plans.bgp import Solutions, default_graph
from .plans.sparql import sparql
from .schema import DEFAULT_PREFIXES, DEFINITION, LABEL, OWL, RDFS, SKOS, SKOS_RELATIONS, SUB, TYPE, XSD
from .sources.rdfize import EX, ansi, quads, repeats, subjects, triples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CLASS = OWL.term("Class")
Q = ansi()


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = where or f"file://{tempfile.gettempdir()}/quadrel-shared"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def of(p: str, alias: str = "dg") -> str:
    return f"(SELECT * FROM {alias} WHERE p = '{p}')"


# -- structure -----------------------------------------------------------------------------------


@query("ontologies_T1", f"{Q} SELECT a.s AS ontology, l.o AS label, a.g AS graph FROM {of(TYPE, 'quads')} a LEFT JOIN {of(LABEL, 'quads')} l ON l.g = a.g AND l.s = a.s WHERE a.o = '{OWL.Ontology}'")
def ontologies(spark, d):
    return Structure(quads(spark, d)).list_ontologies()


@query("classes_T2", f"{Q} SELECT DISTINCT a.s AS class, l.o AS label, d.o AS definition FROM {of(TYPE)} a LEFT JOIN {of(LABEL)} l ON l.s = a.s LEFT JOIN {of(DEFINITION)} d ON d.s = a.s WHERE a.o = '{CLASS}' AND a.s_kind = 'iri'")
def classes(spark, d):
    return Structure(quads(spark, d)).classes()


def _properties_sql(kind: str, last: str, last_iri: bool) -> str:
    test = " AND r.o_kind = 'iri'" if last_iri else ""
    return f"{Q} SELECT DISTINCT a.s AS property, l.o AS label, d.o AS domain, r.o AS {last} FROM {of(TYPE)} a LEFT JOIN {of(LABEL)} l ON l.s = a.s LEFT JOIN {of(RDFS.domain)} d ON d.s = a.s AND d.o_kind = 'iri' LEFT JOIN {of(RDFS.range)} r ON r.s = a.s{test} WHERE a.o = '{kind}' AND a.s_kind = 'iri'"


@query("object_properties_T3", _properties_sql(OWL.ObjectProperty, "range", True))
def object_properties(spark, d):
    return Structure(quads(spark, d)).object_properties()


@query("data_properties_T4", _properties_sql(OWL.DatatypeProperty, "datatype", False))
def data_properties(spark, d):
    return Structure(quads(spark, d)).data_properties()


_SKOS_LIST = ", ".join(f"'{SKOS.term(r)}'" for r in SKOS_RELATIONS)


@query("skos_relations_T5", f"{Q} SELECT s AS source, p AS relation, o AS target FROM dg WHERE p IN ({_SKOS_LIST})")
def skos_relations(spark, d):
    return Structure(quads(spark, d), triples(spark, d)).skos_relations()


@query("skos_summary_T6", f"{Q} SELECT p AS predicate, count(*) AS count FROM dg WHERE starts_with(p, '{SKOS}') GROUP BY p")
def skos_summary(spark, d):
    return Structure(quads(spark, d), triples(spark, d)).skos_relation_summary()


_SUB = of(SUB)


def _hierarchy_sql(cls: str, start: str, end: str, name: str, direct: bool) -> str:
    base = f"SELECT {end} AS x, {end}_kind AS k FROM {_SUB} WHERE {start} = '{cls}'"
    step = "" if direct else f" UNION SELECT e.{end}, e.{end}_kind FROM r JOIN {_SUB} e ON e.{start} = r.x"
    return f"{Q}, r(x, k) AS ({base}{step}) SELECT DISTINCT r.x AS {name}, l.o AS label FROM r LEFT JOIN {of(LABEL)} l ON l.s = r.x WHERE r.k = 'iri' AND r.x <> '{cls}'"


@query("superclasses_direct_T7", _hierarchy_sql(EX + "orders/1", "s", "o", "superclass", True))
def superclasses_direct(spark, d):
    return Structure(quads(spark, d)).superclasses(EX + "orders/1")


@query("superclasses_all_T7", _hierarchy_sql(EX + "orders/1", "s", "o", "superclass", False))
def superclasses_all(spark, d):
    return Structure(quads(spark, d)).superclasses(EX + "orders/1", direct=False)


@query("subclasses_direct_T8", _hierarchy_sql(EX + "region/1", "o", "s", "subclass", True))
def subclasses_direct(spark, d):
    return Structure(quads(spark, d)).subclasses(EX + "region/1")


@query("subclasses_all_T8", _hierarchy_sql(EX + "region/1", "o", "s", "subclass", False))
def subclasses_all(spark, d):
    return Structure(quads(spark, d)).subclasses(EX + "region/1", direct=False)


@query("roots_leaves_T9", f"""{Q} SELECT DISTINCT a.s AS class, l.o AS label,
  a.s NOT IN (SELECT s FROM {_SUB} WHERE o_kind = 'iri' AND s <> o) AS is_root, a.s NOT IN (SELECT o FROM {_SUB} WHERE s_kind = 'iri' AND s <> o) AS is_leaf
  FROM {of(TYPE)} a LEFT JOIN {of(LABEL)} l ON l.s = a.s WHERE a.o = '{CLASS}' AND a.s_kind = 'iri'""")
def roots_leaves(spark, d):
    return Structure(quads(spark, d)).roots_and_leaves(EX)


def _cross(having: int) -> str:
    qt, qs = of(TYPE, "quads"), of(SUB, "quads")
    return f"""SELECT co.s AS child_ontology, po.s AS parent_ontology, count(*) AS edges FROM {qt} c JOIN {qs} e ON e.g = c.g AND e.s = c.s AND e.o_kind = 'iri' JOIN {qt} co ON co.g = c.g
  JOIN {qt} p ON p.s = e.o JOIN {qt} po ON po.g = p.g WHERE c.o = '{CLASS}' AND c.s_kind = 'iri' AND co.o = '{OWL.Ontology}' AND p.o = '{CLASS}' AND po.o = '{OWL.Ontology}' AND c.g <> p.g
  GROUP BY co.s, po.s HAVING count(*) >= {having}"""


@query("cross_edges_T10", f"{Q} {_cross(1)}")
def cross_edges(spark, d):
    return Structure(quads(spark, d)).cross_ontology_subclass_edges()


@query("having_Q17", f"{Q} {_cross(50)}")
def having(spark, d):
    return Structure(quads(spark, d)).cross_ontology_subclass_edges(50)


@query("domain_range_T11", f"{Q} SELECT DISTINCT a.s AS property, l.o AS label, d.o AS domain, r.o AS range FROM {of(TYPE)} a JOIN {of(RDFS.domain)} d ON d.s = a.s AND d.o_kind = 'iri' JOIN {of(RDFS.range)} r ON r.s = a.s AND r.o_kind = 'iri' LEFT JOIN {of(LABEL)} l ON l.s = a.s WHERE a.o = '{OWL.ObjectProperty}' AND a.s_kind = 'iri'")
def domain_range(spark, d):
    return Structure(quads(spark, d)).property_domain_range()


@query("cross_properties_T12", f"""{Q}, home AS (SELECT c.s AS x, c.g, o.s AS ontology FROM {of(TYPE, 'quads')} c JOIN {of(TYPE, 'quads')} o ON o.g = c.g WHERE c.o = '{CLASS}' AND o.o = '{OWL.Ontology}')
  SELECT a.ontology AS domain_ontology, b.ontology AS range_ontology, count(DISTINCT p.s) AS properties FROM {of(TYPE, 'quads')} p JOIN {of(RDFS.domain, 'quads')} d ON d.g = p.g AND d.s = p.s AND d.o_kind = 'iri'
  JOIN {of(RDFS.range, 'quads')} r ON r.g = p.g AND r.s = p.s AND r.o_kind = 'iri' JOIN home a ON a.x = d.o JOIN home b ON b.x = r.o WHERE p.o = '{OWL.ObjectProperty}' AND a.g <> b.g GROUP BY 1, 2""")
def cross_properties(spark, d):
    return Structure(quads(spark, d)).cross_ontology_object_properties()


_LONG = f"SELECT replace(child_ontology, '{EX}', '') AS child, replace(parent_ontology, '{EX}', '') AS parent, sum(edges)::BIGINT AS edges FROM ({_cross(1)}) GROUP BY 1, 2"


@query("dependency_long_T13", f"{Q} {_LONG}")
def dependency_long(spark, d):
    return Structure(quads(spark, d)).dependency_edges()


@query("dependency_pivot_T13", f"{Q} SELECT child, " + ", ".join(f"coalesce(sum(edges) FILTER (WHERE parent = '{p}'), 0)::BIGINT AS {p}" for p in ("customer", "nation", "region")) + f" FROM ({_LONG}) GROUP BY child")
def dependency_pivot(spark, d):
    return Structure(quads(spark, d)).dependency_matrix()


@query("busiest_T14", f"""{Q}, long AS ({_LONG}), r AS (SELECT child FROM long GROUP BY child ORDER BY count(DISTINCT parent) DESC, child LIMIT 2), c AS (SELECT parent FROM long GROUP BY parent ORDER BY count(DISTINCT child) DESC, parent LIMIT 2)
  SELECT child, parent, edges FROM long WHERE child IN (SELECT child FROM r) AND parent IN (SELECT parent FROM c)""")
def busiest(spark, d):
    return Structure(quads(spark, d)).busiest(2)


@query("count_quads_S16", f"{Q} SELECT count(*) AS quads, (SELECT count(*) FROM dg) AS triples FROM quads")
def count_quads(spark, d):
    return quads(spark, d).agg(F.count("*").alias("quads")).crossJoin(triples(spark, d).agg(F.count("*").alias("triples")))


@query("optional_multiply_Q5", f"{Q} SELECT a.s AS x, l.o AS label, n.o AS alt, m.o AS mapped FROM {of(TYPE)} a LEFT JOIN {of(LABEL)} l ON l.s = a.s LEFT JOIN {of(SKOS.altLabel)} n ON n.s = a.s LEFT JOIN {of(SKOS.closeMatch)} m ON m.s = a.s WHERE a.o = '{CLASS}'")
def optional_multiply(spark, d):
    q = Solutions(triples(spark, d)).where(("?x", "a", CLASS)).optional(("?x", LABEL, "?label")).optional(("?x", SKOS.altLabel, "?alt"))
    return q.optional(("?x", SKOS.closeMatch, "?mapped")).select("x", "label", "alt", "mapped")


@query("group_concat_Q15", f"{Q} SELECT s AS x, string_agg(DISTINCT o, '||' ORDER BY o) AS names FROM dg WHERE p IN ('{LABEL}', '{SKOS.altLabel}') GROUP BY s")
def group_concat(spark, d):
    t = default_graph(quads(spark, d)).filter(F.col("p").isin(LABEL, SKOS.altLabel))
    return t.groupBy(F.col("s").alias("x")).agg(F.array_join(F.array_sort(F.collect_set("o")), "||").alias("names"))


@query("sample_bound_Q14", f"{Q} SELECT a.s AS x, count(l.o) > 0 AS has_alt, count(DISTINCT l.o) AS n FROM {of(TYPE)} a LEFT JOIN {of(SKOS.altLabel)} l ON l.s = a.s WHERE a.o = '{CLASS}' GROUP BY a.s")
def sample_bound(spark, d):
    q = Solutions(default_graph(quads(spark, d))).where(("?x", "a", CLASS)).optional(("?x", SKOS.altLabel, "?alt")).df
    return q.groupBy("x").agg((F.count("alt") > 0).alias("has_alt"), F.count_distinct("alt").alias("n"))


@query("ask_S15", f"{Q} SELECT (SELECT count(*) FROM dg WHERE p = '{OWL.disjointWith}') > 0 AS disjoint, (SELECT count(*) FROM dg WHERE p = '{OWL.sameAs}') > 0 AS same")
def ask(spark, d):
    t = default_graph(quads(spark, d))
    return t.agg(F.bool_or(F.col("p") == OWL.disjointWith).alias("disjoint"), F.bool_or(F.col("p") == OWL.sameAs).alias("same"))


@query("named_graph_Q8", f"{Q} SELECT s, count(*) AS n FROM quads WHERE g = 'urn:graph:supplier' GROUP BY s")
def named_graph(spark, d):
    return quads(spark, d).filter(F.col("g") == "urn:graph:supplier").groupBy("s").agg(F.count("*").alias("n"))


@query("sparql_classes_S15", f"{Q} SELECT o AS kind, count(*) AS members FROM {of(TYPE)} GROUP BY o")
def sparql_classes(spark, d):
    return sparql(quads(spark, d), "SELECT ?kind (COUNT(?x) AS ?members) WHERE { ?x a ?kind } GROUP BY ?kind ORDER BY DESC(?members) ?kind")


@query("sparql_cross_edges_S15", f"SELECT child_ontology AS lower, parent_ontology AS upper, edges AS n FROM ({SQL['cross_edges_T10']}) z")
def sparql_cross_edges(spark, d):
    return sparql(quads(spark, d), """SELECT ?lower ?upper (COUNT(*) AS ?n) WHERE {
      GRAPH ?here { ?narrow rdfs:subClassOf ?wide . ?narrow a owl:Class } GRAPH ?here { ?lower a owl:Ontology }
      GRAPH ?there { ?wide a owl:Class } GRAPH ?there { ?upper a owl:Ontology }
      FILTER(?here != ?there && isIRI(?narrow) && isIRI(?wide)) } GROUP BY ?lower ?upper""")


@query("sparql_superclasses_Q10", f"SELECT superclass AS above, label AS name FROM ({SQL['superclasses_all_T7']}) z")
def sparql_superclasses(spark, d):
    return sparql(quads(spark, d), f"""SELECT DISTINCT ?above ?name WHERE {{ <{EX}orders/1> rdfs:subClassOf+ ?above OPTIONAL {{ ?above rdfs:label ?name }} FILTER(?above != <{EX}orders/1> && isIRI(?above)) }}""")


@query("verbalise_Z2", f"{Q}, n AS (SELECT s, min(o) AS n FROM dg WHERE p = '{LABEL}' GROUP BY s) SELECT a.s, a.p, 'Every ' || coalesce(x.n, regexp_extract(a.s, '[^/]*$')) || ' is a ' || coalesce(y.n, regexp_extract(a.o, '[^/]*$')) || '.' AS sentence FROM dg a LEFT JOIN n x ON x.s = a.s LEFT JOIN n y ON y.s = a.o WHERE a.p = '{SUB}' AND a.o_kind = 'iri'")
def verbalise(spark, d):
    from .operators.ontology import verbalise as sentences_of

    return sentences_of(default_graph(quads(spark, d))).filter(F.col("p") == SUB)


@query("metrics_Z1", "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def metrics(spark, d):
    from .operators.ontology import metric_query

    return metric_query(read(spark, d, "orders"), {"orders": "count(*)", "revenue": "round(sum(o_totalprice), 2)"}, ["orders", "revenue"], {"o_orderstatus": "O"}, ["o_orderpriority"])


def _last(x: str) -> str:
    return f"regexp_extract(regexp_extract({x}, '[^/]*$'), '[^#]*$')"


@query("notation_R30", f"{Q} SELECT s AS cls, {_last('s')} || ' ⊑ ' || {_last('o')} AS axiom FROM {_SUB} WHERE o_kind = 'iri' UNION SELECT a.s, {_last('a.s')} || ' ⊑ ∃contains.' || {_last('f.o')} FROM {_SUB} a JOIN (SELECT s, min(o) AS o FROM {of(OWL.someValuesFrom)} GROUP BY s) f ON f.s = a.o UNION SELECT s, {_last('s')} || ' ⊑ ⊤' FROM dg WHERE p = '{TYPE}' AND o = '{CLASS}' AND s NOT IN (SELECT s FROM {_SUB})")
def notation(spark, d):
    from .operators.ontology import notation as dl

    return dl(default_graph(quads(spark, d)))


# -- terms ---------------------------------------------------------------------------------------

_IRIS = f"{Q}, i AS (SELECT DISTINCT p AS iri FROM dg UNION SELECT DISTINCT s FROM dg WHERE s_kind = 'iri')"


def _iris(spark, d):
    t = subjects(spark, d)
    return t.select(F.col("p").alias("iri")).union(t.filter("s_kind = 'iri'").select("s")).distinct()


_LOCAL = "CASE WHEN contains(iri, '#') AND regexp_extract(iri, '[^#]*$') <> '' THEN regexp_extract(iri, '[^#]*$') WHEN contains(iri, '/') AND regexp_extract(iri, '[^/]*$') <> '' THEN regexp_extract(iri, '[^/]*$') ELSE iri END"


@query("local_name_F1", f"{_IRIS} SELECT iri, {_LOCAL} AS local FROM i")
def local_name(spark, d):
    return _iris(spark, d).select("iri", tm.local_name(F.col("iri")).alias("local"))


@query("short_name_F2", f"{_IRIS}, l AS (SELECT iri, {_LOCAL} AS local FROM i) SELECT iri, regexp_extract(rtrim(left(iri, length(iri) - length(local)), '/#'), '[^/]*$') || ':' || local AS short FROM l")
def short_name(spark, d):
    return _iris(spark, d).select("iri", tm.short_name(F.col("iri")).alias("short"))


@query("rel_type_F3", f"{_IRIS}, l AS (SELECT iri, {_LOCAL} AS local FROM i), t AS (SELECT iri, trim(upper(regexp_replace(local, '[^\\p{{L}}\\p{{N}}]', '_', 'g')), '_') AS t FROM l) SELECT iri, CASE WHEN t = '' THEN 'REL' WHEN regexp_matches(t, '^[0-9]') THEN 'P_' || t ELSE t END AS type FROM t")
def rel_type(spark, d):
    return _iris(spark, d).select("iri", tm.rel_type(F.col("iri")).alias("type"))


@query("safe_key_F5", "SELECT p_partkey, CASE WHEN regexp_matches(k, '^[0-9]') OR k = '' THEN '_' || k ELSE k END AS key FROM (SELECT p_partkey, regexp_replace(p_partkey || ' ' || p_name || p_brand, '[^0-9A-Za-z_]', '_', 'g') AS k FROM part)")
def safe_key(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.safe_key(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", "p_brand")).alias("key"))


_CURIES = "CASE " + " ".join(f"WHEN starts_with(iri, '{n}') THEN '{p}:' || substr(iri, {len(n) + 1})" for p, n in [*DEFAULT_PREFIXES.items(), ("ex", EX)]) + " ELSE iri END"


@query("curie_F7", f"{_IRIS} SELECT iri, {_CURIES} AS curie FROM i")
def curie(spark, d):
    prefixes = spark.createDataFrame([(p, str(n)) for p, n in [*DEFAULT_PREFIXES.items(), ("ex", EX)]], "prefix string, namespace string")
    return tm.abbreviate(_iris(spark, d), "iri", prefixes, "curie")


@query("expand_F8", f"{_IRIS} SELECT iri, iri AS back FROM i")
def expand(spark, d):
    return curie(spark, d).select("iri", tm.expand(F.col("curie"), {**DEFAULT_PREFIXES, "ex": EX}).alias("back"))


@query("last_name_F9", f"{_IRIS} SELECT iri, regexp_extract(regexp_extract(iri, '[^/]*$'), '[^#]*$') AS name FROM i")
def last_name(spark, d):
    return _iris(spark, d).select("iri", tm.last_name(F.col("iri")).alias("name"))


@query("namespaces_F10", f"{_IRIS} SELECT iri, starts_with(iri, '{OWL}') OR starts_with(iri, '{SKOS}') AS known FROM i")
def namespaces(spark, d):
    return _iris(spark, d).select("iri", tm.in_namespaces(F.col("iri"), [OWL, SKOS]).alias("known"))


@query("graph_uri_S3", "SELECT p_partkey, 'urn:graph:' || replace(url_encode('a b/' || p_name || '/' || p_brand || '.ttl'), '%2F', '/') AS graph FROM part")
def graph_uri(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.graph_uri(F.concat(F.lit("a b/"), "p_name", F.lit("/"), "p_brand", F.lit(".ttl"))).alias("graph"))


_WORDS = "list_filter(regexp_split_to_array(replace(p_name, '-', ' '), '\\s+'), lambda w: w <> '')"


@query("idents_F12", f"SELECT p_partkey, list_aggregate(list_transform({_WORDS}, lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', '') AS class_id, lower({_WORDS}[1]) || coalesce(list_aggregate(list_transform({_WORDS}[2:], lambda w: upper(left(w, 1)) || substr(w, 2)), 'string_agg', ''), '') AS property_id FROM part")
def idents(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.class_ident(F.col("p_name")).alias("class_id"), tm.property_ident(F.col("p_name")).alias("property_id"))


@query("ntriples_F14", f"""{Q} SELECT CASE s_kind WHEN 'iri' THEN '<' || s || '>' ELSE '_:' || s END || ' <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' WHEN 'bnode' THEN '_:' || o
  ELSE '"' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '"' || coalesce('@' || o_lang, '') END || ' .' AS value FROM dg""")
def ntriples(spark, d):
    from .sources.rdf import ntriples as lines

    return lines(triples(spark, d), distinct=False)


# -- joins and views -----------------------------------------------------------------------------


@query("endpoint_semi_J4", f"{Q}, c AS (SELECT s FROM dg WHERE p = '{TYPE}' AND o = '{CLASS}') SELECT s AS src, o AS dst FROM {_SUB} WHERE s IN (SELECT s FROM c) AND o IN (SELECT s FROM c)")
def endpoint_semi(spark, d):
    t = default_graph(quads(spark, d))
    ids = t.filter((F.col("p") == TYPE) & (F.col("o") == CLASS)).select(F.col("s").alias("src"))
    e = t.filter(F.col("p") == SUB).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return e.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")


def _counts(spark, d, g):
    t = quads(spark, d).filter(F.col("g") == f"urn:graph:{g}")
    return t.groupBy(F.col("p").alias("label")).agg(F.count("*").alias("n"))


@query("full_merge_J7", f"{Q}, a AS (SELECT p AS label, count(*) AS n FROM quads WHERE g = 'urn:graph:part' GROUP BY p), b AS (SELECT p AS label, count(*) AS n FROM quads WHERE g = 'urn:graph:orders' GROUP BY p) SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM a FULL JOIN b ON a.label = b.label")
def full_merge(spark, d):
    return lpg.compare_counts(_counts(spark, d, "part"), _counts(spark, d, "orders"))


_GRAPH_NODES = "SELECT s AS uri, list_sort(list(DISTINCT o)) AS labels FROM quads WHERE p = '{t}' AND g = 'urn:graph:{g}' GROUP BY s UNION ALL SELECT DISTINCT o, ['Resource'] FROM quads WHERE p = '{sub}' AND o_kind = 'iri' AND g = 'urn:graph:{g}'"


def _graph_nodes(spark, d, g):
    q = quads(spark, d).filter(F.col("g") == f"urn:graph:{g}")
    typed = q.filter(F.col("p") == TYPE).groupBy(F.col("s").alias("uri")).agg(F.array_sort(F.collect_set("o")).alias("labels"))
    ends = q.filter((F.col("p") == SUB) & (F.col("o_kind") == "iri")).select(F.col("o").alias("uri")).distinct().withColumn("labels", F.array(F.lit("Resource")))
    return typed.unionByName(ends)


@query("compose_shared_V4", f"{Q}, a AS ({_GRAPH_NODES.format(t=TYPE, sub=SUB, g='customer')}), b AS ({_GRAPH_NODES.format(t=TYPE, sub=SUB, g='nation')}), u AS (SELECT *, 'a' AS src FROM a UNION ALL SELECT *, 'b' FROM b) SELECT uri, array_to_string(list_sort(list_distinct(flatten(list(labels)))), ',') AS labels, CASE WHEN count(DISTINCT src) > 1 THEN 'shared' ELSE min(src) END AS source FROM u GROUP BY uri")
def compose_shared(spark, d):
    out = lpg.compose({"a": _graph_nodes(spark, d, "customer"), "b": _graph_nodes(spark, d, "nation")})
    return out.withColumn("labels", F.array_join("labels", ","))


@query("set_difference_V2", f"{Q} SELECT s, p, o FROM quads WHERE g = 'urn:graph:part' EXCEPT SELECT s, p, o FROM quads WHERE p = '{SUB}'")
def set_difference(spark, d):
    q = quads(spark, d).select("g", "s", "p", "o")
    return q.filter("g = 'urn:graph:part'").drop("g").subtract(q.filter(F.col("p") == SUB).drop("g"))


@query("set_intersection_V3", f"{Q} SELECT o AS x FROM quads WHERE p = '{SUB}' AND g = 'urn:graph:customer' INTERSECT SELECT o FROM quads WHERE p = '{SUB}' AND g = 'urn:graph:supplier'")
def set_intersection(spark, d):
    q = quads(spark, d).filter(F.col("p") == SUB)
    return q.filter("g = 'urn:graph:customer'").select(F.col("o").alias("x")).intersect(q.filter("g = 'urn:graph:supplier'").select("o"))


# -- graphs --------------------------------------------------------------------------------------

_EDGES = f"e AS (SELECT DISTINCT s AS src, o AS dst FROM dg WHERE p = '{SUB}' AND s_kind = 'iri' AND o_kind = 'iri')"
_CLOSED = f"{Q}, {_EDGES}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)"


@query("closure_X1", f"{_CLOSED} SELECT src, dst FROM c")
def closure(spark, d):
    return fixpoint.closure(graphs.subclass_edges(quads(spark, d)))


@query("bounded_path_X4", f"{Q}, {_EDGES}, c(src, dst, n) AS (SELECT src, dst, 1 FROM e UNION SELECT c.src, e.dst, n + 1 FROM c JOIN e ON e.src = c.dst WHERE n < 2) SELECT DISTINCT src, dst FROM c")
def bounded_path(spark, d):
    e = graphs.subclass_edges(quads(spark, d))
    return graphs.bounded_paths(e, e.select("src").distinct(), 2)


@query("shortest_path_X5", f"""{Q}, o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 1) SELECT 0::BIGINT AS pos, '{EX}orders/1' AS node UNION ALL SELECT 1, '{EX}customer/' || o_custkey FROM o
  UNION ALL SELECT 2, '{EX}nation/' || c_nationkey FROM o JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 3, '{EX}region/' || n_regionkey FROM o JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def shortest(spark, d):
    t = quads(spark, d)
    e = fixpoint.cut(graphs.subclass_edges(t))
    top = e.join(e.select(F.col("src").alias("dst")), "dst", "left_anti")
    reached = fixpoint.reach_with_depth(e, spark.range(1).select(F.lit(EX + "orders/1").alias("src")))
    end = reached.join(top.select("dst").distinct(), "dst", "left_semi").agg(F.max("dst")).first()[0]
    return fixpoint.shortest_path(e, EX + "orders/1", end)


@query("nearest_ancestor_X3", f"""{_CLOSED}, u AS (SELECT s FROM dg WHERE p = '{TYPE}' AND o = '{CLASS}' AND (contains(s, '/nation/') OR contains(s, '/region/'))), i AS (SELECT src, dst FROM c WHERE dst IN (SELECT s FROM u))
  SELECT src, dst FROM i EXCEPT SELECT i.src, c.dst FROM i JOIN c ON c.src = i.dst AND c.src <> c.dst""")
def nearest_ancestor(spark, d):
    q = quads(spark, d)
    universe = default_graph(q).filter((F.col("p") == TYPE) & (F.col("o") == CLASS) & (F.col("s").contains("/nation/") | F.col("s").contains("/region/"))).select(F.col("s").alias("node"))
    return graphs.nearest_ancestors(fixpoint.closure(graphs.subclass_edges(q)), universe).distinct()


_RING = "e AS (SELECT s_suppkey::BIGINT AS src, ((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier))::BIGINT AS dst FROM supplier)"
_RINGS = f"WITH RECURSIVE {_RING}, c(src, dst) AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)"


def _ring(spark, d):
    s = read(spark, d, "supplier")
    n = s.count()
    return s.select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % n).alias("dst"))


@query("scc_X12", f"{_RINGS} SELECT a.src AS node, least(a.src, min(a.dst)) AS component FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src")
def scc(spark, d):
    return fixpoint.strong_components(_ring(spark, d))


@query("dag_check_X10", f"{_RINGS} SELECT (SELECT count(*) FROM c WHERE src = dst) > 0 AS ring, false AS taxonomy")
def dag_check(spark, d):
    ring, tree = fixpoint.has_cycle(_ring(spark, d)), fixpoint.has_cycle(graphs.subclass_edges(quads(spark, d)))
    return spark.range(1).select(F.lit(ring).alias("ring"), F.lit(tree).alias("taxonomy"))


@query("depth_X11", f"{Q}, {_EDGES}, c(node, n) AS (SELECT DISTINCT dst, 0 FROM e WHERE dst NOT IN (SELECT src FROM e) UNION SELECT e.src, n + 1 FROM c JOIN e ON e.dst = c.node) SELECT node, max(n)::BIGINT AS depth FROM c GROUP BY node")
def depth(spark, d):
    return fixpoint.longest_depth(graphs.subclass_edges(quads(spark, d)))


_LINKS = "e AS (SELECT s_suppkey::BIGINT AS src, ((s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier))::BIGINT AS dst FROM supplier WHERE s_suppkey % 3 <> 0)"


@query("components_X14", f"WITH RECURSIVE {_LINKS}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c(src, dst) AS (SELECT src, src FROM b UNION SELECT c.src, b.dst FROM c JOIN b ON b.src = c.dst) SELECT src AS node, min(dst) AS component FROM c GROUP BY src")
def components(spark, d):
    return fixpoint.components(_ring(spark, d).filter("src % 3 <> 0"))


@query("bnode_closure_X6", f"{Q} SELECT l.s AS anchor, x.s, x.p, x.o FROM dg l JOIN dg x ON x.s = l.o WHERE l.o_kind = 'bnode' AND l.s_kind = 'iri' UNION SELECT s, s, p, o FROM dg WHERE s_kind = 'iri' AND o_kind = 'bnode'")
def bnode_closure(spark, d):
    return diff.stars(default_graph(quads(spark, d))).select("anchor", "s", "p", "o")


@query("floating_X8", f"{Q} SELECT s AS node FROM dg WHERE s_kind = 'bnode' EXCEPT SELECT o FROM dg WHERE o_kind = 'bnode' AND p = '{SUB}'")
def floating(spark, d):
    return diff.floating(default_graph(quads(spark, d)))


@query("restriction_edges_X15", f"{Q} SELECT a.s AS src, p.o AS property, f.o AS dst FROM {_SUB} a JOIN {of(OWL.onProperty)} p ON p.s = a.o JOIN {of(OWL.someValuesFrom)} f ON f.s = a.o WHERE a.o_kind = 'bnode'")
def restriction_edges(spark, d):
    return graphs.restriction_edges(default_graph(quads(spark, d)))


# -- property graph ------------------------------------------------------------------------------

_E1 = f"SELECT a.s AS iri, l.o AS label, d.o AS definition, coalesce(string_agg(DISTINCT n.o, '||' ORDER BY n.o), '') AS alts FROM {of(TYPE)} a LEFT JOIN {of(LABEL)} l ON l.s = a.s LEFT JOIN {of(DEFINITION)} d ON d.s = a.s LEFT JOIN {of(SKOS.altLabel)} n ON n.s = a.s WHERE a.o = '{CLASS}' AND a.s_kind = 'iri' GROUP BY 1, 2, 3"


@query("lpg_nodes_E1", f"{Q} {_E1}")
def lpg_extract(spark, d):
    return lpg.extract_classes(quads(spark, d)).select("iri", "label", "definition", F.array_join("alt_labels", "||").alias("alts"))


@query("lpg_taxonomy_E2", f"{Q} SELECT DISTINCT s AS child, o AS parent FROM {_SUB} WHERE s_kind = 'iri' AND o_kind = 'iri' AND o <> '{OWL.Thing}'")
def lpg_taxonomy(spark, d):
    return lpg.extract_taxonomy(quads(spark, d))


_E3 = f"SELECT DISTINCT a.s AS property, d.o AS domain, r.o AS range, l.o AS label, c.o AS definition FROM {of(TYPE)} a JOIN {of(RDFS.domain)} d ON d.s = a.s AND d.o_kind = 'iri' JOIN {of(RDFS.range)} r ON r.s = a.s AND r.o_kind = 'iri' LEFT JOIN {of(LABEL)} l ON l.s = a.s LEFT JOIN {of(RDFS.comment)} c ON c.s = a.s WHERE a.o = '{OWL.ObjectProperty}'"


@query("lpg_properties_E3", f"{Q} {_E3}")
def lpg_properties(spark, d):
    return lpg.extract_properties(quads(spark, d))


def _lpg(spark, d):
    q = quads(spark, d)
    nodes = lpg.nodes(lpg.extract_classes(q))
    return nodes, lpg.edges(lpg.extract_taxonomy(q), lpg.extract_properties(q), nodes)


_NODES = f"n AS (SELECT iri, min(coalesce(label, iri)) AS name, coalesce(min(definition), '{lpg.NO_DEFINITION}') AS definition, min(alts) AS alts FROM ({_E1}) GROUP BY iri)"


@query("lpg_build_P1n", f"{Q}, {_NODES} SELECT iri, name, definition, alts FROM n")
def lpg_build(spark, d):
    return _lpg(spark, d)[0].select("iri", "name", "definition", F.array_join("alt_labels", "||").alias("alts"))


_LPG_EDGES = f"ed AS (SELECT DISTINCT s AS src, o AS dst, 'SUBCLASS_OF' AS key, 'SUBCLASS_OF' AS type FROM {_SUB} WHERE o_kind = 'iri' AND o IN (SELECT iri FROM n) AND s IN (SELECT iri FROM n) UNION ALL SELECT DISTINCT domain, range, property, upper(regexp_extract(property, '[^/]*$')) FROM ({_E3}) WHERE domain IN (SELECT iri FROM n) AND range IN (SELECT iri FROM n))"


@query("lpg_edges_P2n", f"{Q}, {_NODES}, {_LPG_EDGES} SELECT src, dst, key, type FROM ed")
def lpg_edges(spark, d):
    return _lpg(spark, d)[1].select("src", "dst", "key", "type")


@query("lpg_stats_P3n", f"{Q}, {_NODES}, {_LPG_EDGES} SELECT (SELECT count(*) FROM n) AS nodes, count(*) FILTER (WHERE type = 'SUBCLASS_OF') AS taxonomy_edges, count(*) FILTER (WHERE type <> 'SUBCLASS_OF') AS property_edges FROM ed")
def lpg_stats(spark, d):
    return lpg.stats(*_lpg(spark, d))


@query("profile_text_P4n", f"""{Q}, {_NODES}, u AS (SELECT e.s AS iri, string_agg(DISTINCT n.name, ', ' ORDER BY n.name) AS p FROM {_SUB} e JOIN n ON n.iri = e.o GROUP BY e.s)
  SELECT iri, concat_ws(' ', 'Class: ' || name || '.', CASE WHEN alts <> '' THEN 'Synonyms: ' || replace(alts, '||', ', ') || '.' END, CASE WHEN definition <> '{lpg.NO_DEFINITION}' THEN 'Definition: ' || definition || CASE WHEN ends_with(definition, '.') THEN '' ELSE '.' END END, 'Superclasses: ' || p || '.') AS profile FROM n LEFT JOIN u USING (iri)""")
def profile_text(spark, d):
    return lpg.profiles(*_lpg(spark, d))


_LABELS = "CASE o " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lpg.NODE_LABELS.items()) + " END"
_TYPES = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lpg.EDGE_TYPES.items()) + " END"
_META = f"""me AS (SELECT DISTINCT s AS src, o AS dst, {_TYPES} AS type FROM dg WHERE {_TYPES} IS NOT NULL AND s_kind = 'iri' AND o_kind = 'iri'),
  own AS (SELECT DISTINCT s AS uri, {_LABELS} AS label FROM dg WHERE p = '{TYPE}' AND s_kind = 'iri' AND {_LABELS} IS NOT NULL UNION SELECT s, 'Ontology' FROM dg WHERE p = '{TYPE}' AND o = '{OWL.Ontology}'),
  al AS (SELECT uri, label FROM own UNION ALL SELECT src, NULL FROM me UNION ALL SELECT dst, NULL FROM me),
  mn AS (SELECT uri, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), 'Resource') AS labels FROM al GROUP BY uri)"""
_META_PREFIXES = {"rdfs": str(RDFS), "skos": str(SKOS)}


def _meta(spark, d):
    prefixes = spark.createDataFrame(list(_META_PREFIXES.items()), "prefix string, namespace string")
    return lpg.meta_nodes(quads(spark, d), prefixes)


@query("meta_nodes_E9", f"{Q}, {_META} SELECT uri, labels FROM mn")
def meta_nodes(spark, d):
    return _meta(spark, d).select("uri", F.array_join("labels", ",").alias("labels"))


@query("meta_props_E10", f"{Q}, {_META} SELECT s AS uri, CASE p WHEN '{LABEL}' THEN 'rdfs_label' WHEN '{SKOS.altLabel}' THEN 'skos_altLabel' ELSE 'skos_definition' END AS key, string_agg(DISTINCT o, ' | ' ORDER BY o) AS value FROM dg WHERE o_kind = 'literal' AND s IN (SELECT uri FROM own) GROUP BY s, p")
def meta_props(spark, d):
    return _meta(spark, d).select("uri", F.explode("props").alias("key", "value"))


@query("meta_edges_E11", f"{Q}, {_META} SELECT src, dst, type FROM me")
def meta_edges(spark, d):
    return lpg.meta_edges(quads(spark, d))


@query("ir_summary_E15", f"{Q}, {_META} SELECT 'node' AS what, l AS name, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS l FROM mn) GROUP BY l UNION ALL SELECT 'edge', type, count(*) FROM me GROUP BY type")
def ir_summary(spark, d):
    a = lpg.label_counts(_meta(spark, d)).select(F.lit("node").alias("what"), F.col("label").alias("name"), "n")
    return a.unionByName(lpg.edge_counts(lpg.meta_edges(quads(spark, d))).select(F.lit("edge").alias("what"), F.col("type").alias("name"), "n"))


@query("filter_graph_V5", f"{Q}, {_META} SELECT src, dst, type FROM me WHERE type = 'SUBCLASS_OF' AND src IN (SELECT uri FROM mn WHERE contains(labels, 'OWLClass')) AND dst IN (SELECT uri FROM mn WHERE contains(labels, 'OWLClass'))")
def filter_graph(spark, d):
    return lpg.filter_graph(_meta(spark, d), lpg.meta_edges(quads(spark, d)), ["OWLClass"], ["SUBCLASS_OF"])[1].select("src", "dst", "type")


@query("knn_E4", """WITH s AS (SELECT a.vec_id AS query, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
  SELECT query, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""")
def knn(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return embed.knn(v, v.filter("vec_id % 20 = 0"), 5).withColumn("similarity", F.round("similarity", 6))


@query("hash_embed_E5")
def hash_embed(spark, d):
    return embed.embed(read(spark, d, "part").select("p_partkey", "p_name"), "p_name").select("p_partkey", "embedding")


# -- store, diff, streams ------------------------------------------------------------------------


@query("merge_U5", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def merge(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name")
    return store.merge(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


def _versions(spark, d):
    t = default_graph(quads(spark, d)).filter(F.col("s").startswith(EX + "orders/") | (F.col("s_kind") == "bnode"))
    key = F.regexp_extract("s", r"(\d+)$", 1).try_cast("bigint")
    old = t.filter(key % 10 != 0)
    edited = F.when((F.col("p") == LABEL) & (key % 7 == 0), F.concat("o", F.lit(" (edited)"))).otherwise(F.col("o"))
    return old, t.filter(key % 10 != 1).withColumn("o", edited)


_VERSIONS = f"""{Q}, t AS (SELECT s, s_kind, p, o, o_kind, regexp_extract(s, '(\\d+)$', 1)::BIGINT AS k FROM dg WHERE starts_with(s, '{EX}orders/') OR s_kind = 'bnode'),
  old AS (SELECT s, s_kind, p, o, o_kind FROM t WHERE k % 10 <> 0), new AS (SELECT s, s_kind, p, CASE WHEN p = '{LABEL}' AND k % 7 = 0 THEN o || ' (edited)' ELSE o END AS o, o_kind FROM t WHERE k % 10 <> 1)"""


@query("naive_diff_U1", f"{_VERSIONS} SELECT 'delete' AS op, s, p, o FROM (SELECT s, p, o FROM old EXCEPT SELECT s, p, o FROM new) UNION ALL SELECT 'add', s, p, o FROM (SELECT s, p, o FROM new EXCEPT SELECT s, p, o FROM old)")
def naive_diff(spark, d):
    gone, come = diff.naive(*_versions(spark, d))
    return gone.select(F.lit("delete").alias("op"), "s", "p", "o").unionByName(come.select(F.lit("add").alias("op"), "s", "p", "o"))


_PLAN = f"""go AS (SELECT s, p, o FROM old WHERE s_kind <> 'bnode' AND o_kind <> 'bnode'), gn AS (SELECT s, p, o FROM new WHERE s_kind <> 'bnode' AND o_kind <> 'bnode'),
  ao AS (SELECT s FROM old WHERE s_kind = 'iri' AND o_kind = 'bnode'), an AS (SELECT s FROM new WHERE s_kind = 'iri' AND o_kind = 'bnode'),
  so AS (SELECT s AS anchor, s, p, o FROM old WHERE s_kind = 'iri' AND o_kind = 'bnode' UNION ALL SELECT l.s, x.s, x.p, x.o FROM old l JOIN old x ON x.s = l.o WHERE l.o_kind = 'bnode'),
  sn AS (SELECT s AS anchor, s, p, o FROM new WHERE s_kind = 'iri' AND o_kind = 'bnode' UNION ALL SELECT l.s, x.s, x.p, x.o FROM new l JOIN new x ON x.s = l.o WHERE l.o_kind = 'bnode'),
  pl AS (SELECT 'ground_delete' AS op, * FROM (SELECT * FROM go EXCEPT SELECT * FROM gn) UNION ALL SELECT 'ground_add', * FROM (SELECT * FROM gn EXCEPT SELECT * FROM go)
    UNION ALL SELECT 'star_delete', s, p, o FROM so WHERE anchor NOT IN (SELECT s FROM an) UNION ALL SELECT 'star_add', s, p, o FROM sn WHERE anchor NOT IN (SELECT s FROM ao))"""


@query("plan_U2", f"{_VERSIONS}, {_PLAN} SELECT op, s, p, o FROM pl")
def plan(spark, d):
    p = diff.plan(*_versions(spark, d))
    parts = [getattr(p, n).select(F.lit(n).alias("op"), "s", "p", "o") for n in ("ground_delete", "ground_add", "star_delete", "star_add")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("plan_metrics_U3", f"{_VERSIONS}, {_PLAN} SELECT op, count(*) AS n FROM pl GROUP BY op")
def plan_metrics(spark, d):
    return plan(spark, d).groupBy("op").agg(F.count("*").alias("n"))


@query("patch_U6", f"{_VERSIONS} SELECT p, count(*) AS n FROM new GROUP BY p")
def patch(spark, d):
    old, new = _versions(spark, d)
    return diff.apply_plan(old, diff.plan(old, new)).groupBy("p").agg(F.count("*").alias("n"))


@query("store_roundtrip_S13", f"{Q} SELECT g, count(*) AS n FROM (SELECT DISTINCT * FROM quads) WHERE g <> 'urn:graph:nation' GROUP BY g")
def store_roundtrip(spark, d):
    s = store.QuadStore(spark, scratch(spark, "store"))
    s.write(quads(spark, d), repeats(spark, d))
    s.delete_graph("urn:graph:nation")
    return s.quads().groupBy("g").agg(F.count("*").alias("n"))


_OP = "CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' ELSE 'update' END"


@query("stream_sync_Y1", f"SELECT user_id AS key, id, op, value FROM (SELECT user_id, event_id AS id, {_OP} AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND op <> 'delete'")
def stream_sync(spark, d):
    from .streaming import sync

    events = read(spark, d, "events")
    feed = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = feed.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), op.alias("op"), "value")
    p = sync.Projection(spark, scratch(spark, "sync"), "key bigint, ts timestamp, id bigint, op string, value double")
    p.run(changes).awaitTermination()
    return sync.live(p.state()).select("key", "id", "op", "value")


# -- text ----------------------------------------------------------------------------------------

_SENT = r"s AS (SELECT doc_id, i - 1 AS sent_id, l[i] AS sentence FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM {t})))"
_TOK = r"w AS (SELECT doc_id, sent_id, i - 1 AS pos, l[i] AS surface FROM (SELECT doc_id, sent_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, sent_id, regexp_extract_all(sentence, '[A-Za-z][A-Za-z''-]*') AS l FROM s)))"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_LEMMA = "CASE WHEN length(l) > 4 AND ends_with(l, 'ies') THEN left(l, length(l) - 3) || 'y' WHEN length(l) > 4 AND ends_with(l, 'ses') THEN left(l, length(l) - 2) WHEN length(l) > 3 AND regexp_matches(l, '[sxz]es$') THEN left(l, length(l) - 2) WHEN length(l) > 3 AND ends_with(l, 's') AND NOT ends_with(l, 'ss') THEN left(l, length(l) - 1) ELSE l END"
_TAG = f"CASE WHEN l IN {_in(text.DETERMINERS)} THEN 'DET' WHEN l IN {_in(text.PREPOSITIONS)} THEN 'ADP' WHEN l IN {_in(text.SEED_VERBS)} OR ends_with(l, 'ing') THEN 'VERB' WHEN ends_with(l, 'ed') AND length(l) > 4 THEN 'VERB' WHEN regexp_matches(l, '(ous|ive|al|ic|able|ible)$') THEN 'ADJ' WHEN regexp_matches(surface, '^[A-Z]') AND pos > 0 THEN 'PROPN' WHEN l IN {_in(text.STOPWORDS)} THEN 'OTHER' ELSE 'NOUN' END"


def _tokens_sql(table: str, name: str = "k") -> str:
    """CTEs for tokens of a table, named ``name``."""
    src = table if table == "documents" else "(SELECT item_id AS doc_id, text FROM benchmark)"
    a, b = f"{name}s", f"{name}w"
    one = _SENT.replace("{t}", src).replace("s AS (", f"{a} AS (", 1)
    two = _TOK.replace("w AS (", f"{b} AS (", 1).replace("FROM s)", f"FROM {a})")
    return f"{one}, {two}, {name} AS (SELECT doc_id, sent_id, pos, surface, {_LEMMA} AS lemma, {_TAG} AS tag FROM (SELECT *, lower(surface) AS l FROM {b}))"


_K = "WITH " + _tokens_sql("documents")
_CONTENT = f"tag IN ('NOUN', 'PROPN') AND lemma NOT IN {_in(text.STOPWORDS)}"
_FREQ = f"f AS (SELECT lemma, count(*) AS frequency FROM k WHERE {_CONTENT} GROUP BY lemma)"
_REL = f"{_FREQ}, b AS (SELECT lemma, count(*) AS bg FROM kb WHERE {_CONTENT} GROUP BY lemma), r AS (SELECT lemma, pf * ln((pf + 1e-9) / (pb + 1e-9) + 1.0) AS relevance FROM (SELECT f.lemma, frequency / (SELECT sum(frequency) FROM f) AS pf, coalesce(bg, 0) / (SELECT sum(bg) FROM b) AS pb FROM f LEFT JOIN b ON b.lemma = f.lemma))"
_KB = f"{_K}, {_tokens_sql('benchmark', 'kb')}"


def _tokens(spark, d):
    return text.tokens(read(spark, d, "documents").select("doc_id", "text"))


def _background(spark, d):
    return text.tokens(read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))


@query("sentences_N1", "WITH " + _SENT.replace("{t}", "documents") + " SELECT doc_id, sent_id::INT AS sent_id, sentence FROM s")
def sentences(spark, d):
    return text.sentences(read(spark, d, "documents"))


@query("tokens_N2", f"{_K} SELECT doc_id, count(*) AS n, count(DISTINCT surface) AS kinds, sum(length(surface))::BIGINT AS letters FROM k GROUP BY doc_id")
def tokens(spark, d):
    return _tokens(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("surface").alias("kinds"), F.sum(F.length("surface")).alias("letters"))


@query("lemmas_N3", f"{_K} SELECT DISTINCT surface, lemma FROM k")
def lemmas(spark, d):
    return _tokens(spark, d).select("surface", "lemma").distinct()


@query("pos_N4", f"{_K} SELECT surface, tag, count(*) AS n FROM k GROUP BY surface, tag")
def pos(spark, d):
    return _tokens(spark, d).groupBy("surface", "tag").agg(F.count("*").alias("n"))


@query("term_freq_N6", f"{_K}, {_FREQ} SELECT lemma, frequency FROM f")
def term_freq(spark, d):
    return text.term_frequencies(_tokens(spark, d))


@query("relevance_N7", f"{_KB}, {_REL} SELECT lemma, round(relevance, 9) AS relevance FROM r")
def relevance(spark, d):
    return text.relevance(_tokens(spark, d), _background(spark, d)).withColumn("relevance", F.round("relevance", 9))


@query("cooccurrence_N8", f"{_K}, u AS (SELECT DISTINCT doc_id, sent_id, lemma FROM k WHERE {_CONTENT}) SELECT a.lemma AS term_a, b.lemma AS term_b, count(*) AS n FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.sent_id = b.sent_id AND a.lemma < b.lemma GROUP BY 1, 2")
def cooccurrence(spark, d):
    return text.cooccurrence(_tokens(spark, d))


_RUNS = "p AS (SELECT term, count(*) AS frequency FROM (SELECT string_agg(lemma, ' ' ORDER BY pos) AS term, bool_or(tag <> 'ADJ') AS noun FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY pos) AS island FROM k WHERE tag IN ('ADJ', 'NOUN', 'PROPN')) GROUP BY doc_id, sent_id, island) WHERE noun GROUP BY term)"


@query("candidates_N9", f"{_KB}, {_REL}, {_RUNS} SELECT term, frequency, round(frequency * (1.0 + ln(len(string_split(term, ' ')) + 1.0)) * (1.0 + coalesce(h.relevance, w.relevance, 0.0)), 4) AS score FROM p LEFT JOIN r h ON h.lemma = regexp_extract(term, '[^ ]*$') LEFT JOIN r w ON w.lemma = term")
def candidates(spark, d):
    t = _tokens(spark, d)
    return text.candidate_terms(t, text.relevance(t, _background(spark, d))).select("term", "frequency", "score")


@query("composition_N10", f"{_K}, {_RUNS} SELECT term AS sub, regexp_extract(term, '[^ ]*$') AS sup FROM p WHERE contains(term, ' ') AND regexp_extract(term, '[^ ]*$') IN (SELECT term FROM p)")
def composition(spark, d):
    return text.composition(text.phrases(_tokens(spark, d)))


@query("relations_N11", f"""{_K}, n AS (SELECT *, last_value(CASE WHEN tag IN ('NOUN', 'PROPN') THEN lemma END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS subject,
  first_value(CASE WHEN tag IN ('NOUN', 'PROPN') THEN lemma END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS object FROM k)
  SELECT subject, lemma AS predicate, object, count(*) AS support FROM n WHERE tag = 'VERB' AND lemma IN {_in(text.SEED_VERBS)} AND subject <> object GROUP BY 1, 2, 3""")
def relations(spark, d):
    return text.relations(_tokens(spark, d))


@query("hearst_N12")
def hearst(spark, d):
    return text.hearst(read(spark, d, "documents")).select("sub", "sup")


@query("prf_N14", f"{_KB}, {_FREQ}, g AS (SELECT DISTINCT lemma FROM kb WHERE {_CONTENT}), c AS (SELECT (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM g) AS support, (SELECT count(*) FROM f WHERE lemma IN (SELECT lemma FROM g)) AS tp) SELECT round(tp / n, 3) AS precision, round(tp / support, 3) AS recall, round(2.0 * (tp / n) * (tp / support) / (tp / n + tp / support), 3) AS f1, tp, support FROM c")
def prf(spark, d):
    return text.prf(text.term_frequencies(_tokens(spark, d)), text.term_frequencies(_background(spark, d)), "lemma")


@query("coverage_A10", f"{_KB}, {_FREQ}, g AS (SELECT DISTINCT lemma FROM kb WHERE {_CONTENT}) SELECT round((SELECT count(*) FROM f WHERE lemma IN (SELECT lemma FROM g)) / (SELECT count(*) FROM f), 6) AS coverage")
def coverage(spark, d):
    return text.coverage(text.term_frequencies(_tokens(spark, d)), text.term_frequencies(_background(spark, d))).withColumn("coverage", F.round("coverage", 6))


@query("decisions_N15", "SELECT n.n_name AS sub, r.r_name AS sup FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_regionkey <> 1 AND n.n_nationkey % 4 <> 0")
def decisions(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("sub"), F.col("r_name").alias("sup"))
    labels = n.select(F.col("n_name").alias("label")).union(r.select("r_name"))
    no = r.filter("r_regionkey = 1").select(F.lit("class").alias("kind"), F.col("r_name").alias("label"), F.lit(False).alias("keep")).union(n.filter("n_nationkey % 4 = 0").select(F.lit("class"), "n_name", F.lit(False)))
    none = spark.createDataFrame([], "subject string, predicate string, object string")
    return text.apply_decisions(labels, e, none, no)[1].select("sub", "sup")


# -- models --------------------------------------------------------------------------------------


def _models(spark, d):
    """Suppliers as components that realise nations (services), parts as data objects they write."""
    s, li = read(spark, d, "supplier"), read(spark, d, "lineitem")
    writes = li.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("writes"))
    comp = s.join(writes, s.s_suppkey == writes.l_suppkey, "left").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.col("s_nationkey").cast("bigint")).alias("realizes"), F.coalesce("writes", F.array().cast("array<bigint>")).alias("writes"), F.array(F.col("s_suppkey") + 1).alias("uses"))
    services = read(spark, d, "nation").filter("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return comp, services


@query("integrity_M1", """SELECT 'realised service' AS "check", s_suppkey || ': unknown ' || s_nationkey AS problem FROM supplier WHERE s_nationkey % 5 = 0 UNION ALL SELECT 'used component', s_suppkey || ': unknown ' || (s_suppkey + 1) FROM supplier WHERE s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'realised', n_nationkey || ': nothing refers to it' FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def integrity(spark, d):
    c, s = _models(spark, d)
    return models.dangling(c, "realizes", s, "realised service").unionByName(models.dangling(c, "uses", c, "used component")).unionByName(models.uncovered(s, c, "realizes", "realised"))


@query("traceability_M5", "SELECT s_suppkey AS id, coalesce(CASE WHEN s_nationkey % 5 <> 0 THEN n_name END, '') AS links FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def traceability(spark, d):
    c, s = _models(spark, d)
    return models.traceability(c, "realizes", s)


@query("data_owners_M6", "SELECT l_partkey AS object, min(l_suppkey) AS component, 'writer' AS role FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_partkey")
def data_owners(spark, d):
    c, _ = _models(spark, d)
    return models.data_owners(c.withColumn("reads", F.array().cast("array<bigint>")))


@query("roadmap_M11", "SELECT p_size AS maturity_level, count(*) AS n, string_agg(p_name, ', ' ORDER BY p_name) AS capabilities FROM part GROUP BY p_size")
def roadmap(spark, d):
    return models.roadmap(read(spark, d, "part").select(F.col("p_size").alias("maturity_level"), F.col("p_name").alias("name")))


@query("level_query_M10", "SELECT 'http://ex/part/' || p_partkey AS capability, p_size::BIGINT AS level FROM part WHERE p_size >= 4")
def level_query(spark, d):
    none = F.lit(None).cast("string")
    q = read(spark, d, "part").select(none.alias("g"), F.concat(F.lit("http://ex/part/"), "p_partkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit("http://ex/level").alias("p"), F.col("p_size").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(str(XSD.integer)).alias("o_dtype"), none.alias("o_lang"))
    return models.capability_query(q, "http://ex/level", 4)


@query("profile_counts_R29", f"{Q} SELECT count(*) FILTER (WHERE p = '{TYPE}' AND o = '{CLASS}') AS classes, count(*) FILTER (WHERE p = '{SUB}') AS subclass_axioms, count(*) FILTER (WHERE p = '{OWL.someValuesFrom}') AS existential, count(*) FILTER (WHERE p = '{OWL.disjointWith}') AS disjoint FROM dg")
def profile_counts(spark, d):
    t = triples(spark, d)
    return t.agg(F.count_if((F.col("p") == TYPE) & (F.col("o") == CLASS)).alias("classes"), F.count_if(F.col("p") == SUB).alias("subclass_axioms"), F.count_if(F.col("p") == OWL.someValuesFrom).alias("existential"), F.count_if(F.col("p") == OWL.disjointWith).alias("disjoint"))


# -- reasoning and enrichment --------------------------------------------------------------------

V, O = "http://ex/v/", "http://ex/o/"


def _alignment(spark, d):
    """Customers as a vocabulary, suppliers as an ontology (a binary tree), mapped by equal keys."""
    from .operators.enrich import Enricher, triples

    c, s, o = read(spark, d, "customer").select("c_custkey"), read(spark, d, "supplier").select("s_suppkey"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    v, x = (lambda k: F.concat(F.lit(V), k.cast("string"))), (lambda k: F.concat(F.lit(O), k.cast("string")))
    ck, sk = F.col("c_custkey"), F.col("s_suppkey")
    lit = lambda df, s_, p_, o_: triples(df, s_, F.lit(str(p_)), o_).withColumn("o_kind", F.lit("literal"))
    voc = triples(c, v(ck), F.lit(str(TYPE)), F.lit(str(SKOS.Concept))).unionByName(triples(c.filter("c_custkey % 10 <> 1"), v(ck), F.lit(str(SKOS.broader)), v(ck - (ck + 9) % 10)))
    voc = voc.unionByName(lit(c.filter("c_custkey % 2 = 0"), v(ck), DEFINITION, F.lit("a customer"))).unionByName(triples(o, F.concat(F.lit("http://ex/i/"), F.col("o_orderkey").cast("string")), F.lit(str(TYPE)), v(F.col("o_custkey"))))
    ont = triples(s, x(sk), F.lit(str(TYPE)), F.lit(str(CLASS))).unionByName(triples(s.filter("s_suppkey > 1"), x(sk), F.lit(str(SUB)), x(F.floor(sk / 2))))
    ont = ont.unionByName(lit(s, x(sk), DEFINITION, F.concat(F.lit("supplier "), sk.cast("string")))).unionByName(triples(s.filter("s_suppkey = 2"), x(sk), F.lit(str(OWL.disjointWith)), F.lit(O + "3")))
    r = s.filter("s_suppkey % 5 = 0")
    node = F.concat(F.lit("r"), sk.cast("string"))
    ont = ont.unionByName(triples(r, x(sk), F.lit(str(SUB)), node).withColumn("o_kind", F.lit("bnode")))
    for p, target in ((TYPE, F.lit(str(OWL.Restriction))), (OWL.onProperty, F.concat(F.lit(O + "p"), (sk % 3).cast("string"))), (OWL.someValuesFrom, x(sk + 1))):
        ont = ont.unionByName(triples(r, node, F.lit(str(p)), target).withColumn("s_kind", F.lit("bnode")))
    both = c.join(s, ck == sk)
    kind = F.element_at(F.array(*(F.lit(str(SKOS.term(m))) for m in ("exactMatch", "closeMatch", "broadMatch", "narrowMatch"))), (ck % 4 + 1).cast("int"))
    return Enricher(voc, ont, triples(both, v(ck), kind, x(sk)), [O], V)


_A = f"""WITH RECURSIVE m AS (SELECT c_custkey AS k, '{V}' || c_custkey AS v, '{O}' || s_suppkey AS o, c_custkey % 4 AS kind FROM customer JOIN supplier ON c_custkey = s_suppkey),
  tree AS (SELECT '{O}' || s_suppkey AS src, '{O}' || (s_suppkey // 2) AS dst FROM supplier WHERE s_suppkey > 1),
  broader AS (SELECT '{V}' || c_custkey AS src, '{V}' || (c_custkey - (c_custkey + 9) % 10) AS dst FROM customer WHERE c_custkey % 10 <> 1),
  eq AS (SELECT v, o FROM m WHERE kind = 0),
  asserted AS (SELECT * FROM tree UNION SELECT * FROM broader UNION SELECT v, o FROM m WHERE kind IN (1, 2) UNION SELECT o, v FROM m WHERE kind = 3 UNION SELECT '{O}' || s_suppkey, 'r' || s_suppkey FROM supplier WHERE s_suppkey % 5 = 0),
  base AS (SELECT * FROM asserted UNION SELECT v, o FROM eq UNION SELECT o, v FROM eq),
  c(src, dst) AS (SELECT src, dst FROM base UNION SELECT c.src, b.dst FROM c JOIN base b ON b.src = c.dst),
  ind AS (SELECT 'http://ex/i/' || o_orderkey AS i, '{V}' || o_custkey AS t FROM orders),
  fresh AS (SELECT * FROM c EXCEPT SELECT * FROM asserted)"""


@query("lift_R2", f"{_A} SELECT '{V}' || c_custkey AS s, '{TYPE}' AS p, '{CLASS}' AS o FROM customer UNION SELECT src, '{SUB}', dst FROM broader UNION SELECT i, '{TYPE}', t FROM ind")
def lift(spark, d):
    return _alignment(spark, d).lift().select("s", "p", "o")


@query("bridge_R3", f"{_A} SELECT v AS s, '{OWL.equivalentClass}' AS p, o FROM eq UNION SELECT v, '{SUB}', o FROM m WHERE kind IN (1, 2) UNION SELECT o, '{SUB}', v FROM m WHERE kind = 3")
def bridge(spark, d):
    return _alignment(spark, d).bridge().select("s", "p", "o")


@query("closure_rl_R5", f"{_A} SELECT src AS s, '{SUB}' AS p, dst AS o FROM c UNION SELECT a.src, '{OWL.equivalentClass}', a.dst FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src UNION SELECT v, '{OWL.equivalentClass}', o FROM eq")
def closure_rl(spark, d):
    return _alignment(spark, d).inferred.filter(F.col("p").isin(SUB, OWL.equivalentClass)).select("s", "p", "o")


@query("new_triples_R6", f"{_A} SELECT '{SUB}' AS p, count(*) AS n FROM fresh")
def new_triples(spark, d):
    return _alignment(spark, d).new.filter(F.col("p") == SUB).groupBy("p").agg(F.count("*").alias("n"))


_EQO = f"eqo AS (SELECT a.src AS concept, a.dst AS target FROM c a JOIN c b ON a.src = b.dst AND a.dst = b.src WHERE starts_with(a.src, '{V}') AND starts_with(a.dst, '{O}') UNION SELECT v, o FROM eq)"


@query("subsumption_R7", f"{_A}, {_EQO} SELECT concept, 'equivalentTo' AS relation, target FROM eqo UNION SELECT src, CASE WHEN (src, dst) IN (SELECT (src, dst) FROM fresh) THEN 'inferred_ancestor' ELSE 'mapped_parent' END, dst FROM c WHERE starts_with(src, '{V}') AND starts_with(dst, '{O}') AND (src, dst) NOT IN (SELECT (concept, target) FROM eqo)")
def subsumption(spark, d):
    return _alignment(spark, d).subsumption()


@query("instances_R8", f"{_A} SELECT DISTINCT i AS individual, dst AS type, true AS is_new FROM ind JOIN c ON c.src = t WHERE starts_with(dst, '{O}')")
def instances(spark, d):
    return _alignment(spark, d).instances()


_HELD = f"held AS (SELECT '{O}' || s_suppkey AS cls, '{O}p' || (s_suppkey % 3) AS property, '{O}' || (s_suppkey + 1) AS value_type FROM supplier WHERE s_suppkey % 5 = 0)"


@query("restrictions_R9", f"{_A}, {_HELD}, up AS (SELECT src AS concept, dst AS cls FROM c WHERE starts_with(src, '{V}')), h2 AS (SELECT c.src AS cls, property, value_type FROM c JOIN held ON c.dst = 'r' || regexp_extract(held.cls, '[0-9]+$')) SELECT concept, property, min(value_type) AS value_type FROM (SELECT concept, property, value_type FROM up JOIN h2 USING (cls) UNION SELECT cls, property, value_type FROM h2 WHERE starts_with(cls, '{V}')) GROUP BY 1, 2")
def restrictions(spark, d):
    return _alignment(spark, d).relationships()


@query("annotations_R10", f"{_A} SELECT v AS concept, o AS source, 'supplier ' || k AS definition FROM m WHERE kind < 3 AND k % 2 = 1")
def annotations(spark, d):
    return _alignment(spark, d).annotations()


@query("disjoint_R11", f"{_A}, ty AS (SELECT src AS x, dst AS t FROM c UNION SELECT i, t FROM ind UNION SELECT i, dst FROM ind JOIN c ON c.src = t) SELECT DISTINCT a.x AS offending, '{O}2' AS disjoint_a, '{O}3' AS disjoint_b FROM ty a JOIN ty b ON a.x = b.x WHERE a.t = '{O}2' AND b.t = '{O}3' AND a.x NOT IN ('{O}2', '{O}3') AND starts_with(a.x, 'http')")
def disjoint(spark, d):
    return reason.clashes(_alignment(spark, d).inferred)


_P = f"""tc(src, dst) AS (SELECT src, dst FROM tree UNION SELECT tc.src, t.dst FROM tc JOIN tree t ON t.src = tc.dst), cls AS (SELECT '{O}' || s_suppkey AS u FROM supplier), cov AS (SELECT o AS u, v FROM m WHERE kind IN (0, 1)),
  {_HELD}, mis AS (SELECT u, CASE WHEN up AND down THEN 'intermediate' WHEN up THEN 'ancestor' ELSE 'narrower' END AS category FROM (SELECT u, u IN (SELECT tc.dst FROM tc JOIN cov ON cov.u = tc.src) AS up, u IN (SELECT tc.src FROM tc JOIN cov ON cov.u = tc.dst) AS down, u IN (SELECT o FROM m WHERE kind = 2) AS broad FROM cls WHERE u NOT IN (SELECT u FROM cov)) WHERE up OR down OR broad),
  miss AS (SELECT * FROM mis UNION SELECT value_type, 'referenced' FROM held WHERE value_type IN (SELECT u FROM cls) AND value_type NOT IN (SELECT u FROM cov) AND value_type NOT IN (SELECT u FROM mis)),
  uni AS (SELECT u FROM cov UNION SELECT u FROM miss), ins AS (SELECT src, dst FROM tc WHERE dst IN (SELECT u FROM uni)), near AS (SELECT src, dst FROM ins EXCEPT SELECT ins.src, tc.dst FROM ins JOIN tc ON tc.src = ins.dst),
  pl AS (SELECT miss.u, coalesce(cov.v, '{V}' || regexp_extract(n.dst, '[^/]*$'), '{V}BusinessAsset') AS parent FROM miss LEFT JOIN (SELECT src, min(dst) AS dst FROM near GROUP BY src) n ON n.src = miss.u LEFT JOIN cov ON cov.u = n.dst)"""


def _patterns(spark, d):
    from .operators.patterns import Patterns

    return Patterns(_alignment(spark, d))


@query("missing_R16", f"{_A}, {_P} SELECT u AS cls, category FROM miss")
def missing(spark, d):
    return _patterns(spark, d).missing


@query("ancestry_R14", f"{_A}, {_EQO}, x AS (SELECT concept, string_agg(target, ',' ORDER BY target) AS e FROM eqo GROUP BY 1), y AS (SELECT src AS concept, string_agg(dst, ',' ORDER BY dst) AS a FROM c WHERE starts_with(src, '{V}') AND starts_with(dst, '{O}') GROUP BY 1) SELECT coalesce(x.concept, y.concept) AS concept, coalesce(e, '') AS equivalent_to, coalesce(a, '') AS derived_ancestors FROM x FULL JOIN y ON x.concept = y.concept")
def ancestry(spark, d):
    return _patterns(spark, d).p1().select("concept", F.array_join("equivalent_to", ",").alias("equivalent_to"), F.array_join("derived_ancestors", ",").alias("derived_ancestors"))


@query("parents_R15", f"""{_A}, {_P}, w AS (SELECT v AS concept, dst AS p FROM m JOIN tree ON tree.src = m.o WHERE kind IN (0, 1) UNION SELECT v, o FROM m WHERE kind = 2), ww AS (SELECT concept, string_agg(DISTINCT coalesce(cov.v, '{V}' || regexp_extract(p, '[^/]*$')), ',') AS wanted, string_agg(coalesce(cov.v, '{V}' || regexp_extract(p, '[^/]*$') || ' (propose)'), ',' ORDER BY p) AS shown FROM w LEFT JOIN cov ON cov.u = p GROUP BY 1)
  SELECT concept, coalesce(b.dst, '(none)') AS current_parent, shown AS correct_parent FROM ww LEFT JOIN broader b ON b.src = concept WHERE wanted <> coalesce(b.dst, '')""")
def parents(spark, d):
    return _patterns(spark, d).p2().select("concept", F.array_join("current_parent", ",").alias("current_parent"), F.array_join("correct_parent", ",").alias("correct_parent"))


@query("placement_R19", f"{_A}, {_P} SELECT u AS cls, parent FROM pl")
def placement(spark, d):
    return _patterns(spark, d).placement


@query("intermediate_R17", f"{_A}, {_P} SELECT u AS cls, category, regexp_extract(u, '[^/]*$') AS label, '{V}' || regexp_extract(u, '[^/]*$') AS suggested_concept, parent AS suggested_parent FROM miss JOIN pl USING (u) WHERE category IN ('intermediate', 'ancestor')")
def intermediate(spark, d):
    return _patterns(spark, d).p3()


@query("narrower_R18", f"{_A}, {_P} SELECT u AS cls, category, regexp_extract(u, '[^/]*$') AS label, '{V}' || regexp_extract(u, '[^/]*$') AS suggested_concept, parent AS suggested_parent FROM miss JOIN pl USING (u) WHERE category IN ('narrower', 'referenced')")
def narrower(spark, d):
    return _patterns(spark, d).p4()


@query("properties_R21", f"""{_A}, {_P}, own AS (SELECT u, v FROM cov UNION ALL SELECT u, '{V}' || regexp_extract(u, '[^/]*$') FROM miss), dec AS (SELECT held.cls, property, value_type, v FROM held JOIN own ON own.u = held.cls),
  top AS (SELECT * FROM dec WHERE (property, cls) NOT IN (SELECT (a.property, a.cls) FROM dec a JOIN tc ON tc.src = a.cls JOIN dec b ON b.cls = tc.dst AND b.property = a.property)) SELECT property, min_by(v, cls) AS concept, min_by(value_type, cls) AS value_type FROM top GROUP BY property""")
def properties(spark, d):
    return _patterns(spark, d).p5()


@query("reparent_R22", f"{_A}, {_P}, kids AS (SELECT near.dst AS u, string_agg(DISTINCT v, ',' ORDER BY v) AS k FROM near JOIN cov ON cov.u = near.src GROUP BY 1) SELECT '{V}' || regexp_extract(u, '[^/]*$') AS new_concept, parent AS assign_parent, coalesce(k, '') AS reparent_children FROM miss JOIN pl USING (u) LEFT JOIN kids USING (u)")
def reparent(spark, d):
    return _patterns(spark, d).p7().withColumn("reparent_children", F.array_join("reparent_children", ","))

