"""Further registered queries: term functions, small graph plans, model checks, exports, glossary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import terms as tm
from .operators import convert, diff, enrich, graphs, models, text
from .plans import fixpoint
from .plans.bgp import default_graph
from .plans.update import update
from .queries import _LPG_EDGES, _NODES, Q, of, query, read, scratch
from .schema import DEFINITION, LABEL, OWL, RDFS, SKOS, SUB, TERM, TYPE
from .sources import rdf, rdfize
from .sources.rdfize import EX, quads

# -- terms ---------------------------------------------------------------------------------------


@query("checked_rel_type_F4", "SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g')) AS t FROM part")
def checked_rel_type(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.checked_rel_type(tm.rel_type(F.concat(F.lit("http://ex/"), "p_type"))).alias("t"))


@query("checked_ident_F6", "SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9]', '_', 'g') AS t FROM part")
def checked_ident(spark, d):
    return read(spark, d, "part").select("p_partkey", tm.checked_ident(tm.safe_key(F.col("p_type"))).alias("t"))


@query("slug_F11", "SELECT DISTINCT c_mktsegment AS name, c_mktsegment || ' segment-x' AS x, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(replace(c_mktsegment || ' segment-x', '-', ' '), ' ')], '') AS slug FROM customer")
def slug(spark, d):
    x = F.concat("c_mktsegment", F.lit(" segment-x"))
    return read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), x.alias("x"), tm.slug(x).alias("slug")).distinct()


@query("mermaid_id_F15", "SELECT DISTINCT p_brand, regexp_replace(p_brand || ' ' || p_type, '[^0-9A-Za-z_]', '_', 'g') AS id FROM part")
def mermaid_id(spark, d):
    return read(spark, d, "part").select("p_brand", tm.mermaid_id(F.concat_ws(" ", "p_brand", "p_type")).alias("id")).distinct()


@query("first_line_F16", "SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 200) AS line FROM documents")
def first_line(spark, d):
    return read(spark, d, "documents").select("doc_id", tm.first_line(F.col("text")).alias("line"))


@query("media_type_S1", """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'text/turtle' WHEN 1 THEN 'application/rdf+xml' WHEN 2 THEN 'application/n-triples' WHEN 3 THEN 'application/ld+json' END AS media FROM nation""")
def media_type(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".ttl", ".RDF", ".nt", ".jsonld", ".csv"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return read(spark, d, "nation").select("n_nationkey", rdf.media_type(F.concat(F.lit("/data/x."), "n_name", ext)).alias("media"))


@query("relative_S4", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'sub/' || n_name || '.ttl' ELSE n_name || '.ttl' END AS path FROM nation")
def relative(spark, d):
    where = F.when(F.col("n_nationkey") % 2 == 0, F.lit("file:///data/root/sub/")).otherwise(F.lit("file:///else/"))
    return read(spark, d, "nation").select("n_nationkey", rdf.relative(F.concat(where, "n_name", F.lit(".ttl")), "/data/root/").alias("path"))


# -- files ---------------------------------------------------------------------------------------


def _nation_triples(spark: SparkSession, d: str) -> DataFrame:
    """Nations as classes below their regions, with labels."""
    n = read(spark, d, "nation")
    none, s, iri = F.lit(None).cast("string"), F.concat(F.lit("http://ex/n/c"), F.col("n_nationkey").cast("string")), F.lit("iri")
    rows = lambda p, o, kind, lang: n.select(s.alias("s"), iri.alias("s_kind"), F.lit(str(p)).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), none.alias("o_dtype"), lang.alias("o_lang"))
    return rows(TYPE, F.lit(str(OWL.Class)), "iri", none).unionByName(rows(SUB, F.concat(F.lit("http://ex/r/c"), F.col("n_regionkey").cast("string")), "iri", none)).unionByName(rows(LABEL, F.concat(F.col("n_name"), F.lit(' "q" \\ x')), "literal", F.lit("en")))


_NATIONS = f"""SELECT 'http://ex/n/c' || n_nationkey AS s, '{TYPE}' AS p, '{OWL.Class}' AS o, 'iri' AS o_kind, NULL AS o_lang FROM nation UNION ALL SELECT 'http://ex/n/c' || n_nationkey, '{SUB}', 'http://ex/r/c' || n_regionkey, 'iri', NULL FROM nation
  UNION ALL SELECT 'http://ex/n/c' || n_nationkey, '{LABEL}', n_name || ' "q" \\ x', 'literal', 'en' FROM nation"""


@query("turtle_S11", _NATIONS)
def turtle(spark, d):
    """Written as Turtle, found in the folder, parsed again."""
    prefixes = {"n": "http://ex/n/", "r": "http://ex/r/", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}
    t = rdf.turtle(_nation_triples(spark, d), prefixes)
    path = scratch(spark, "turtle")
    head = spark.range(1).select(F.lit("\n".join(rdf.prefix_lines(prefixes))).alias("value"), F.lit(0).alias("k"))
    head.unionByName(t.select("value", F.lit(1).alias("k"))).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    files = spark.read.format("binaryFile").load(path).filter("path like '%.txt'").select(F.concat("path", F.lit(".ttl")).alias("path"), "content")
    return rdf.parse_files(files).filter("error is null").select("s", "p", "o", "o_kind", "o_lang")


@query("rdf_xml_S11", _NATIONS)
def rdf_xml(spark, d):
    """Written as one RDF/XML document, parsed again."""
    path = scratch(spark, "xml")
    rdf.write_rdf_xml(_nation_triples(spark, d), path)
    files = spark.read.format("binaryFile").load(path).filter("path like '%.txt'").select(F.concat("path", F.lit(".rdf")).alias("path"), "content")
    return rdf.parse_files(files).filter("error is null").select("s", "p", "o", "o_kind", "o_lang")


@query("discover_S2", "SELECT n_name || '.nt' AS name FROM nation WHERE n_regionkey <> 2 ORDER BY 1")
def discover(spark, d):
    """Files of a folder tree: a tool folder is left out."""
    path = scratch(spark, "tree")
    n = read(spark, d, "nation").select("n_name", F.when(F.col("n_regionkey") == 2, ".git").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("folder"))
    n.select("folder", F.concat(F.col("n_name"), F.lit(".nt")).alias("file"), F.lit("<http://a> <http://b> <http://c> .").alias("value")).write.partitionBy("folder", "file").text(path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", "file=([^/]+)", 1).alias("name"), F.regexp_extract("path", "folder=([^/]+)", 1).alias("folder"))
    keep = rdf.media_type(F.col("name")).isNotNull() & ~F.col("folder").isin(sorted(rdf.SKIPPED_FOLDERS))
    return found.filter(keep).select("name").distinct()


@query("catalog_S7", "SELECT 'http://ex/o/' || n_regionkey AS ontology, '/r' || n_regionkey || '.ttl' AS path FROM nation GROUP BY n_regionkey")
def catalog(spark, d):
    files = read(spark, d, "nation").groupBy("n_regionkey").agg(F.encode(F.array_join(F.collect_list(F.concat(F.lit("<http://ex/c/"), F.col("n_nationkey").cast("string"), F.lit("> a <http://ex/C> ."))), "\n"), "utf-8").alias("c"))
    files = files.select(F.concat(F.lit("/r"), F.col("n_regionkey").cast("string"), F.lit(".ttl")).alias("path"), F.concat(F.col("c"), F.encode(F.concat(F.lit("\n<http://ex/o/"), F.col("n_regionkey").cast("string"), F.lit(f"> a <{OWL.Ontology}> .")), "utf-8")).alias("content"))
    return rdf.local_catalog(rdf.parse_files(files))


# -- graphs --------------------------------------------------------------------------------------


def _ring_edges(spark, d):
    """Suppliers in rings of four, each ring leading to the next."""
    s, key = read(spark, d, "supplier"), F.col("s_suppkey")
    name = lambda k: F.format_string("s%06d", k.cast("bigint"))
    ring = s.select(name(key).alias("src"), name(F.when(key % 4 == 0, key - 3).otherwise(key + 1)).alias("dst"))
    return ring.unionByName(s.select(name(key).alias("src"), name(key + 4).alias("dst"))).join(s.select(name(key).alias("dst")), "dst", "left_semi").select("src", "dst")


_RING = "k AS (SELECT s_suppkey AS k, format('s{:06d}', s_suppkey) AS n, floor((s_suppkey - 1) / 4.0) AS g, count(*) OVER (PARTITION BY floor((s_suppkey - 1) / 4.0)) AS size FROM supplier), c AS (SELECT n, g, CASE WHEN size = 4 THEN min(n) OVER (PARTITION BY g) ELSE n END AS comp FROM k)"


@query("condensed_nodes_X16", f"WITH {_RING} SELECT n AS node, comp AS component FROM c JOIN k USING (n) WHERE size = 4")
def condensed_nodes(spark, d):
    return graphs.condensed(_ring_edges(spark, d))[0]


@query("condensed_edges_X16", f"""WITH {_RING}, e AS (SELECT a.n AS src, b.n AS dst FROM k a JOIN k b ON b.k = CASE WHEN a.k % 4 = 0 THEN a.k - 3 ELSE a.k + 1 END UNION ALL SELECT a.n, b.n FROM k a JOIN k b ON b.k = a.k + 4)
  SELECT DISTINCT x.comp AS src, y.comp AS dst FROM e JOIN c x ON x.n = e.src JOIN c y ON y.n = e.dst WHERE x.comp <> y.comp""")
def condensed_edges(spark, d):
    return graphs.condensed(_ring_edges(spark, d))[1]


@query("guarded_depth_X13", """WITH RECURSIVE e AS (SELECT s_suppkey AS src, s_suppkey // 2 AS dst FROM supplier WHERE s_suppkey > 1), w(k, depth) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.k)
  SELECT k::VARCHAR AS node, depth FROM w UNION ALL SELECT 'ring' || n_nationkey, NULL FROM nation""")
def guarded_depth(spark, d):
    """A tree of suppliers beside a ring of nations, whose depth is undefined."""
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    tree = s.filter("s_suppkey > 1").select(F.col("s_suppkey").cast("string").alias("src"), F.floor(F.col("s_suppkey") / 2).cast("string").alias("dst"))
    ring = n.select(F.concat(F.lit("ring"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("ring"), ((F.col("n_nationkey") + 1) % n.count()).cast("string")).alias("dst"))
    return fixpoint.longest_depth(tree.unionByName(ring), guarded=True)


@query("successors_X2", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation WHERE n_regionkey < 3")
def successors(spark, d):
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), "n_regionkey")
    return graphs.successors(n.select("src", "dst"), n.filter("n_regionkey < 3").select(F.col("src").alias("node")))


@query("anchors_X7", f"{Q} SELECT DISTINCT s AS anchor FROM dg WHERE s_kind = 'iri' AND o_kind = 'bnode'")
def anchors(spark, d):
    return diff.anchors(default_graph(quads(spark, d)))


@query("isomorphic_X9", "SELECT true AS renamed, false AS changed")
def isomorphic(spark, d):
    """Nations with a blank node each: other node names change nothing, another label does."""
    n, none = read(spark, d, "nation"), F.lit(None).cast("string")

    def graph(prefix, label):
        b, key = F.concat(F.lit(prefix), F.col("n_nationkey").cast("string")), F.concat(F.lit("http://ex/"), F.col("n_nationkey").cast("string"))
        link = n.select(key.alias("s"), F.lit("iri").alias("s_kind"), F.lit(str(SUB)).alias("p"), b.alias("o"), F.lit("bnode").alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang"))
        return link.unionByName(n.select(b.alias("s"), F.lit("bnode").alias("s_kind"), F.lit(str(LABEL)).alias("p"), label.alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang"))).select(*TERM)

    a = graph("x", F.col("n_name"))
    return spark.range(1).select(F.lit(diff.isomorphic(a, graph("y", F.col("n_name")))).alias("renamed"), F.lit(diff.isomorphic(a, graph("x", F.lower("n_name")))).alias("changed"))


# -- text ----------------------------------------------------------------------------------------


@query("top_terms_L1", "SELECT p_name AS term, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def top_terms(spark, d):
    return text.top_terms(read(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_retailprice").alias("score"), F.col("p_partkey").alias("first")), 25).select("term", "score")


@query("known_terms_N17", "SELECT DISTINCT lower(p_type) AS lemma FROM part UNION SELECT DISTINCT regexp_extract(lower(p_type), '[^ ]*$') FROM part")
def known_terms(spark, d):
    return text.known_terms(read(spark, d, "part").select(F.lower("p_type").alias("term")).distinct())


@query("summary_N19", "SELECT (SELECT count(*) FROM part) AS classes, (SELECT count(*) FROM nation) AS subclass_axioms, (SELECT count(*) FROM supplier) AS object_properties, (SELECT count(*) FROM region) AS other_axioms")
def summary(spark, d):
    return text.summary(*(read(spark, d, t) for t in ("part", "nation", "supplier", "region")))


# -- models --------------------------------------------------------------------------------------


def _capabilities(spark, d):
    """Regions as categories; nations as capabilities that depend on the one before and support the one ten on."""
    n, key = read(spark, d, "nation"), F.col("n_nationkey").cast("bigint")
    none = F.array().cast("array<string>")
    text_ = lambda c: c.cast("string")
    cap = n.select(text_(key).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), text_(F.col("n_regionkey"))).alias("category"), F.array(text_(key - 1)).alias("depends_on"), F.array(text_(key + 10)).alias("supports"), none.alias("governed_by"), (key % 7).alias("maturity_level"))
    cat = read(spark, d, "region").filter("r_regionkey <> 4").select(F.concat(F.lit("R"), text_(F.col("r_regionkey"))).alias("id"), F.col("r_name").alias("name"), F.lit("D").alias("domain"))
    return cat, cap


@query("capabilities_M2", """SELECT 'category' AS "check", n_nationkey || ': unknown R4' AS problem FROM nation WHERE n_regionkey = 4 UNION ALL SELECT 'depends_on', n_nationkey || ': unknown ' || (n_nationkey - 1) FROM nation WHERE n_nationkey - 1 NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT 'supports', n_nationkey || ': unknown ' || (n_nationkey + 10) FROM nation WHERE n_nationkey + 10 NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'maturity level', n_nationkey || ': maturity_level is ' || (n_nationkey % 7) FROM nation WHERE n_nationkey % 7 NOT BETWEEN 1 AND 5""")
def capabilities(spark, d):
    return models.check_capabilities(*_capabilities(spark, d))


@query("applications_M3", """SELECT 'served capability' AS "check", s_suppkey || ': unknown ' || (s_nationkey + 20) AS problem FROM supplier WHERE s_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'realised service', c_custkey || ': unknown ' || (c_custkey * 2) FROM customer WHERE c_custkey * 2 NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'realised', s_suppkey || ': nothing refers to it' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey * 2 FROM customer) UNION ALL SELECT 'covered capability', n_nationkey || ': nothing refers to it' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey + 20 FROM supplier)""")
def applications(spark, d):
    text_ = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    services = read(spark, d, "supplier").select(text_(F.col("s_suppkey")).alias("id"), F.array(text_(F.col("s_nationkey") + 20)).alias("serves_capabilities"))
    components = read(spark, d, "customer").select(text_(F.col("c_custkey")).alias("id"), F.array(text_(F.col("c_custkey") * 2)).alias("realizes"), none.alias("reads"), none.alias("writes"), none.alias("uses"))
    return models.check_applications(services, components, services.select("id"), _capabilities(spark, d)[1])


@query("technology_M4", """SELECT 'platform' AS "check", p_partkey || ': platform is ' || p_type AS problem FROM part WHERE p_type = (SELECT min(p_type) FROM part) UNION ALL SELECT 'priority', p_partkey || ': priority is ' || p_brand FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)
  UNION ALL SELECT 'mapping', p_partkey || ': no mapping' FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT 'host', n_nationkey || ': unknown ' || (n_nationkey + 5) FROM nation WHERE n_nationkey + 5 NOT IN (SELECT n_nationkey FROM nation)""")
def technology(spark, d):
    p, text_ = read(spark, d, "part"), (lambda c: c.cast("string"))
    kinds = sorted(r[0] for r in p.select("p_type").distinct().collect())  # a handful
    platforms = kinds[1:]
    priorities = sorted(r[0] for r in p.select("p_brand").distinct().collect())[1:]
    reqs = p.select(text_(F.col("p_partkey")).alias("id"), F.col("p_type").alias("platform"), F.col("p_brand").alias("priority"))
    nodes = read(spark, d, "nation").select(text_(F.col("n_nationkey")).alias("id"), F.array(text_(F.col("n_nationkey") + 5)).alias("hosted_on"))
    return models.check_technology(reqs, read(spark, d, "lineitem").select(text_(F.col("l_partkey")).alias("req_id")).distinct(), nodes, platforms, priorities)


_EDGES = "SELECT n_nationkey::VARCHAR AS src, (n_nationkey - 1)::VARCHAR AS dst, 'dependsOn' AS type FROM nation UNION ALL SELECT (n_nationkey - 1)::VARCHAR, n_nationkey::VARCHAR, 'enables' FROM nation UNION ALL SELECT n_nationkey::VARCHAR, (n_nationkey + 10)::VARCHAR, 'supports' FROM nation"


@query("edges_M7", _EDGES)
def edges(spark, d):
    return models.edges(_capabilities(spark, d)[1])


@query("taxonomy_M8", "SELECT n_nationkey::VARCHAR AS src, 'R' || n_regionkey AS dst FROM nation UNION SELECT 'R' || r_regionkey, 'D' FROM region WHERE r_regionkey <> 4")
def taxonomy(spark, d):
    return models.taxonomy(*_capabilities(spark, d))


@query("members_M8", "SELECT n_nationkey::VARCHAR AS id FROM nation WHERE n_nationkey - 1 = 3 OR n_regionkey = 1")
def members(spark, d):
    c = _capabilities(spark, d)[1]
    return models.members(c, "depends_on", "3").unionByName(models.members(c, "category", "R1")).select("id").distinct()


@query("markdown_M9", "SELECT DISTINCT '## ' || p_type AS line FROM part UNION ALL SELECT '- **' || p_partkey || '** ' || p_name || ' (' || p_brand || '): ' || p_type FROM part")
def markdown(spark, d):
    p = read(spark, d, "part")
    return models.markdown(p.select(F.col("p_type").alias("platform"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("priority"), F.col("p_type").alias("statement"))).select("line")


@query("mermaid_M9", f"SELECT 'flowchart LR' AS line UNION ALL SELECT '  ' || regexp_replace(src, '[^0-9A-Za-z_]', '_', 'g') || ' -->|' || type || '| ' || regexp_replace(dst, '[^0-9A-Za-z_]', '_', 'g') FROM ({_EDGES}) e")
def mermaid(spark, d):
    return models.mermaid(models.edges(_capabilities(spark, d)[1])).select("line")


@query("capability_quads_M10", f"""WITH e AS ({_EDGES}) SELECT 'http://ex/' || src AS s, 'http://ex/' || type AS p, 'http://ex/' || dst AS o FROM e UNION ALL SELECT 'http://ex/' || n_nationkey, '{SKOS.broader}', 'http://ex/R' || n_regionkey FROM nation
  UNION ALL SELECT 'http://ex/' || n_nationkey, '{SKOS.prefLabel}', n_name FROM nation UNION ALL SELECT 'http://ex/R' || r_regionkey, '{SKOS.prefLabel}', r_name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 'http://ex/' || n_nationkey, '{TYPE}', '{SKOS.Concept}' FROM nation
  UNION ALL SELECT 'http://ex/R' || r_regionkey, '{TYPE}', '{SKOS.Concept}' FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 'http://ex/' || n_nationkey, 'http://ex/maturityLevel', (n_nationkey % 7)::VARCHAR FROM nation UNION ALL SELECT 'http://ex/dependsOn', '{TYPE}', '{OWL.TransitiveProperty}'
  UNION ALL SELECT 'http://ex/enables', '{OWL.inverseOf}', 'http://ex/dependsOn' UNION ALL SELECT 'http://ex/dependsOn', '{RDFS.label}', 'depends on'""")
def capability_quads(spark, d):
    return models.to_quads(*_capabilities(spark, d), "http://ex/").select("s", "p", "o")


# -- glossary ------------------------------------------------------------------------------------


@query("preferred_J6", "SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) x WHERE r = 1")
def preferred(spark, d):
    return enrich.preferred(read(spark, d, "supplier"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"]).select("s_nationkey", "s_suppkey")


def _terms(spark, d):
    n = read(spark, d, "nation")
    terms = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 > 0, F.concat(F.lit("about "), F.col("n_name"))).alias("definition"), F.array(F.lower("n_name")).alias("synonyms"))
    kind = F.element_at(F.array(*map(F.lit, ("exact", "close", "broad", "narrow"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    curated = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("term"), F.concat(F.lit("http://ex/t"), F.col("n_nationkey").cast("string")).alias("target"), kind.alias("mapping"))
    return enrich.map_terms(terms, curated)


_MAPPED = "m AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name, CASE WHEN n_nationkey % 3 > 0 THEN 'about ' || n_name END AS definition, lower(n_name) AS synonym, CASE WHEN n_nationkey % 5 <> 0 THEN 'http://ex/t' || n_nationkey END AS target, CASE WHEN n_nationkey % 5 <> 0 THEN (['exact', 'close', 'broad', 'narrow'])[n_nationkey % 4 + 1] END AS mapping FROM nation)"


@query("map_terms_R26", f"WITH {_MAPPED} SELECT name, definition, target, mapping FROM m")
def map_terms(spark, d):
    return _terms(spark, d).select("name", "definition", "target", "mapping")


@query("glossary_model_R27", f"""WITH {_MAPPED}, i AS (SELECT *, 'http://ex/g/' || array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(name, ' ')], '') AS iri FROM m)
  SELECT iri AS s, '{TYPE}' AS p, '{OWL.Class}' AS o FROM i UNION SELECT iri, '{SKOS.prefLabel}', name FROM i UNION SELECT iri, '{SKOS.altLabel}', synonym FROM i UNION SELECT iri, '{DEFINITION}', definition FROM i WHERE definition IS NOT NULL
  UNION SELECT iri, '{OWL.equivalentClass}', target FROM i WHERE mapping = 'exact' UNION SELECT iri, '{SUB}', target FROM i WHERE mapping IN ('close', 'broad') UNION SELECT target, '{SUB}', iri FROM i WHERE mapping = 'narrow'""")
def glossary_model(spark, d):
    return enrich.build_model(_terms(spark, d), "http://ex/g/").select("s", "p", "o")


@query("glossary_relations_R26", "SELECT n_name AS source, 'part of' AS type, CASE WHEN n_regionkey < 3 THEN r_name ELSE 'r' || n_regionkey END AS target FROM nation JOIN region ON r_regionkey = n_regionkey")
def glossary_relations(spark, d):
    n, r = read(spark, d, "nation"), read(spark, d, "region").filter("r_regionkey < 3")
    rid = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    things = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name")).unionByName(r.select(rid("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    doc = things.agg(F.collect_list(F.struct("id", "name")).alias("assets")).crossJoin(n.agg(F.collect_list(F.struct(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.lit("part of").alias("type"), rid("n_regionkey").alias("target"))).alias("relations")))
    return enrich.glossary_relations(doc)


# -- lists in rules ------------------------------------------------------------------------------


@query("list_rules_R34", """SELECT 'c' || c_custkey AS s, 'in' AS o FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND c_mktsegment = 'BUILDING' UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def list_rules(spark, d):
    """An intersection of two classes takes its members; a chain of two properties leads from customers to regions."""
    from .operators.reason import closure_rl

    c, n, none = read(spark, d, "customer"), read(spark, d, "nation"), F.lit(None).cast("string")
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    t = lambda df, s, p, o, sk="iri", ok="iri": df.select(s.alias("s"), F.lit(sk).alias("s_kind"), F.lit(str(p)).alias("p"), o.alias("o"), F.lit(ok).alias("o_kind"), none.alias("o_dtype"), none.alias("o_lang"))
    one = spark.range(1)
    cells = [("both", OWL.intersectionOf, "l1", "iri", "bnode"), ("inRegion", OWL.propertyChainAxiom, "k1", "iri", "bnode")]
    for cell, item, rest in (("l1", "inOne", "l2"), ("l2", "building", None), ("k1", "inNation", "k2"), ("k2", "ofRegion", None)):
        cells += [(cell, RDF_FIRST, item, "bnode", "iri"), (cell, RDF_REST, rest or RDF_NIL, "bnode", "bnode" if rest else "iri")]
    g = t(c, key("c", "c_custkey"), "inNation", key("n", "c_nationkey")).unionByName(t(n, key("n", "n_nationkey"), "ofRegion", key("r", "n_regionkey")))
    g = g.unionByName(t(c.filter("c_mktsegment = 'BUILDING'"), key("c", "c_custkey"), TYPE, F.lit("building")))
    g = g.unionByName(t(c.join(n.filter("n_regionkey = 1"), c.c_nationkey == n.n_nationkey, "left_semi"), key("c", "c_custkey"), TYPE, F.lit("inOne")))
    for s, p, o, sk, ok in cells:
        g = g.unionByName(t(one, F.lit(s), p, F.lit(str(o)), sk, ok))
    out = closure_rl(g)
    return out.filter((F.col("p") == TYPE) & (F.col("o") == "both")).select("s", F.lit("in").alias("o")).unionByName(out.filter("p = 'inRegion'").select("s", "o"))


RDF_FIRST, RDF_REST, RDF_NIL = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("first", "rest", "nil"))


# -- updates and the stored property graph ---------------------------------------------------------

_SUPPLIER, _REGION, _NEW = "urn:graph:supplier", "urn:graph:region", "urn:graph:new"
_MOVED = f"g = '{_SUPPLIER}' AND p = '{LABEL}' AND s IN (SELECT s FROM quads WHERE g = '{_SUPPLIER}' AND p = '{TYPE}' AND o = '{OWL.term('Class')}' AND o_kind = 'iri')"


@query("sparql_update_S15", f"""{Q} SELECT g, s, s_kind, CASE WHEN {_MOVED} THEN '{SKOS.altLabel}' ELSE p END AS p, o, o_kind, o_dtype, o_lang FROM quads WHERE g <> 'urn:graph:nation' AND NOT (g = '{_REGION}' AND s = '{EX}region/1' AND p = '{TYPE}' AND o = '{OWL.term('Class')}')
  UNION SELECT '{_NEW}', 'http://x/a', 'iri', '{LABEL}', 'a "b"', 'literal', NULL, 'en' UNION SELECT '{_NEW}', 'http://x/a', 'iri', 'http://x/level', '4', 'literal', 'http://www.w3.org/2001/XMLSchema#integer', NULL""")
def sparql_update(spark, d):
    return update(quads(spark, d), f"""WITH <{_SUPPLIER}> DELETE {{ ?x rdfs:label ?l }} INSERT {{ ?x skos:altLabel ?l }} WHERE {{ ?x a owl:Class ; rdfs:label ?l }} ;
      DELETE DATA {{ GRAPH <{_REGION}> {{ <{EX}region/1> a owl:Class }} }} ; CLEAR GRAPH <urn:graph:nation> ;
      INSERT DATA {{ GRAPH <{_NEW}> {{ <http://x/a> rdfs:label "a \\"b\\""@en ; <http://x/level> 4 }} }}""", repeats=rdfize.repeats(spark, d))


@query("lpg_load_E7", f"{Q}, {_NODES}, {_LPG_EDGES} SELECT src, dst, type, max(CASE WHEN key = 'SUBCLASS_OF' THEN '{SUB}' ELSE key END) AS iri FROM ed GROUP BY src, dst, type UNION ALL SELECT iri, NULL, 'node', NULL FROM n")
def lpg_load(spark, d):
    """What a store holds after the same projection was loaded twice."""
    made, stored = convert.extract_transform(quads(spark, d)), convert.GraphStore(spark, scratch(spark, "graph"))
    for clear in (True, False):
        stored.load(made.nodes, made.edges, clear=clear)
    none = F.lit(None).cast("string")
    return stored.table("edges").select("src", "dst", "type", "iri").unionByName(stored.table("nodes").select(F.col("iri").alias("src"), none.alias("dst"), F.lit("node").alias("type"), none.alias("iri")))
