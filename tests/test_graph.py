"""Operators on small graphs, checked against results worked out by hand or by plain Python."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from quadrel.functions import terms as tm
from quadrel.operators import convert, diff, embed, lpg, models, ontology, patterns, reason, store, text, workflow
from quadrel.operators.enrich import Enricher
from quadrel.plans import fixpoint
from quadrel.plans.sparql import sparql
from quadrel.plans.update import update
from quadrel.schema import OWL, QUADS, SKOS, SUB, TERM
from quadrel.sources import rdf

PREFIX = "@prefix : <http://x/> . @prefix f: <http://f/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n"


def graph(spark, body, g="urn:g"):
    rows = [(gg or g, s[0], s[1], p, o[0], o[1], o[2], o[3]) for gg, s, p, o in rdf.parse(PREFIX + body, "text/turtle", "http://x/doc", "b")]
    return spark.createDataFrame(rows, QUADS)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_terms(spark):
    lit = F.lit
    cases = [
        (tm.local_name, "http://a/b#c", "c"), (tm.local_name, "http://a/b#", "b#"), (tm.local_name, "http://a/b/", "http://a/b/"), (tm.local_name, "urn:x", "urn:x"), (tm.short_name, "http://a/Mod/Cls", "Mod:Cls"),
        (tm.rel_type, "http://a/is-held by", "IS_HELD_BY"), (tm.rel_type, "http://a/3x", "P_3X"), (tm.rel_type, "http://a/--", "REL"), (tm.rel_type, "http://a/größe", "GRÖSSE"),
        (tm.safe_key, "skos:definition", "skos_definition"), (tm.safe_key, "1a", "_1a"), (tm.safe_key, "", "_"), (tm.last_name, "http://a/b#c/d", "d"), (tm.slug, "current-account x", "CurrentAccountX"),
        (tm.class_ident, "live  stock-USA x", "LiveStockUSAX"), (tm.class_ident, "-", "Thing"), (tm.property_ident, "HAS part", "hasPart"), (tm.property_ident, " ", "relatedTo"),
        (tm.ontology_label, "http://a/ontology/FBC/", "FBC"), (tm.ontology_label, "http://a/ontology/" + "x" * 41, "x" * 37 + "..."), (tm.graph_uri, "a b/c%.ttl", "urn:graph:a%20b/c%25.ttl"), (tm.first_line, "a\nb", "a"),
    ]
    for f, given_, want in cases:
        assert one(spark, f(lit(given_))) == want, (f.__name__, given_)


def test_abbreviate_beyond_a_thousand_prefixes(spark):
    few = [("a", "http://a/"), ("ab", "http://a/b"), ("ab2", "http://a/b"), ("u", "urn:x:")]
    many = few + [(f"p{i}", f"http://other/{i}/") for i in range(1_000)]
    iris = spark.createDataFrame([("http://a/c/d",), ("http://a/b/c",), ("urn:x:y",), ("http://z/",), ("http://a/",), (None,), ("urn:x:y",)], "iri string")
    got = [sorted(map(str, tm.abbreviate(iris, "iri", spark.createDataFrame(p, "prefix string, namespace string"), "curie").collect())) for p in (few, many)]
    assert got[0] == got[1] and "Row(iri='http://a/c/d', curie='a:c/d')" in got[1]


def test_parsers_agree(spark):
    t = PREFIX + ':a a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :b ] ; rdfs:label "x \\"y\\""@en, """l\n2""" ; :n 3, 2.5, true ; :l (1 :b) .'
    x = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns="http://x/"><owl:Class rdf:about="http://x/a"><p rdf:resource="http://x/b"/><q rdf:parseType="Resource"><r xml:lang="de">v</r></q></owl:Class></rdf:RDF>'
    a = rdf.parse(t, "text/turtle", "http://x/", "b")
    assert len(a) == 15 and (None, ("http://x/a", "iri", None, None), "http://www.w3.org/2000/01/rdf-schema#label", ('x "y"', "literal", None, "en")) in a
    b = rdf.parse(x, "application/rdf+xml", "http://x/", "b")
    assert len(b) == 4 and any(o == ("v", "literal", None, "de") for _, _, _, o in b)
    assert rdf.parse(x, "text/turtle", "http://x/", "b") == b  # the next reader takes it
    files = spark.createDataFrame([("f/a.ttl", bytearray(t.encode())), ("f/bad.ttl", bytearray(b"@prefix x")), ("f/b.rdf", bytearray(x.encode()))], "path string, content binary")
    got = rdf.parse_files(files)
    assert {(r.path, r.error is None) for r in got.select("path", "error").distinct().collect()} == {("f/a.ttl", True), ("f/bad.ttl", False), ("f/b.rdf", True)}


def test_lines_round_trip(spark, tmp_path):
    q = graph(spark, ':a :p "q\\"\\\\ \\n x"@en, :b, [ :r "1"^^:t ] .')
    rdf.ntriples(q).write.text(str(tmp_path / "n"))
    back = rdf.read_lines(spark, str(tmp_path / "n"))
    assert sorted(r.o for r in back.collect()) == sorted(r.o for r in q.collect())
    assert diff.isomorphic(q, back.select(*TERM))


def test_imports(spark):
    docs = [("a", "http://o/a", "http://o/b"), ("b", "http://o/b", "http://o/a"), ("c", "http://o/c", "http://o/a")]
    rows = []
    for path, iri, imp in docs:
        rows += [(path, "g", iri, "iri", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", str(OWL.Ontology), "iri", None, None, None), (path, "g", iri, "iri", str(OWL.imports), imp, "iri", None, None, None)]
    p = spark.createDataFrame(rows, rdf.PARSED)
    assert {r.path for r in rdf.with_imports(p, "a").collect()} == {"a", "b"}
    assert {r.path for r in rdf.with_imports(p, "a", follow=False).collect()} == {"a"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=14))
def test_fixpoints_match_plain_python(spark, edges):
    df = spark.createDataFrame(edges, "src int, dst int")
    reach = set(edges)
    while True:
        more = {(a, d) for (a, b), (c, d) in itertools.product(reach, reach) if b == c} - reach
        if not more:
            break
        reach |= more
    assert set(values(fixpoint.closure(df))) == reach
    nodes = {x for e in edges for x in e}
    both = reach | {(b, a) for a, b in reach}
    comp = {n: n for n in nodes}
    for _ in nodes:
        for a, b in both:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert dict(values(fixpoint.components(df))) == comp


def test_depth_path_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert dict(values(fixpoint.longest_depth(e))) == {"a": 2, "b": 1, "c": 0}
    assert [r.node for r in fixpoint.shortest_path(e, "a", "c").orderBy("pos").collect()] == ["a", "c"]
    assert not fixpoint.has_cycle(e) and fixpoint.shortest_path(e, "c", "a").isEmpty()
    try:
        fixpoint.longest_depth(e.union(spark.createDataFrame([("c", "a")], "src string, dst string"))).count()
        raise AssertionError("a cycle went unnoticed")
    except ValueError:
        pass


def test_sparql(spark):
    q = graph(spark, ':a a owl:Class ; rdfs:subClassOf :b ; rdfs:label "A", "AA" . :b a owl:Class ; rdfs:subClassOf :a, :c . :c :level 4 . :b :level 10 .')
    got = sparql(q, "SELECT ?x (COUNT(DISTINCT ?l) AS ?n) WHERE { ?x a owl:Class OPTIONAL { ?x rdfs:label ?l } } GROUP BY ?x HAVING (COUNT(*) >= 2)")
    assert values(got) == [("http://x/a", 2)]
    assert values(sparql(q, "SELECT DISTINCT ?y WHERE { <http://x/a> rdfs:subClassOf+ ?y FILTER(isIRI(?y) && ?y != <http://x/a>) }")) == [("http://x/b",), ("http://x/c",)]
    assert values(sparql(q, "PREFIX x: <http://x/> SELECT ?s ?l WHERE { ?s x:level ?l FILTER(?l >= 5) }")) == [("http://x/b", "10")]
    assert sparql(q, "ASK { ?a rdfs:label \"AA\" }") and not sparql(q, "ASK { ?a rdfs:label \"B\" }")
    assert values(sparql(q, 'SELECT ?x (GROUP_CONCAT(DISTINCT ?l; separator="||") AS ?g) WHERE { VALUES ?x { <http://x/a> <http://x/z> } ?x rdfs:label ?l } GROUP BY ?x')) == [("http://x/a", "A||AA")]


def test_update(spark):
    q = graph(spark, ':a a owl:Class ; rdfs:label "A", "A"@en, "B" . :b a owl:Class ; rdfs:label "A" ; rdfs:subClassOf :a . :c rdfs:subClassOf :b .').union(graph(spark, ':z rdfs:label "A" .', "urn:h"))
    labels = lambda df: values(df.filter("p like '%label'").select("g", "s", "o", F.coalesce("o_lang", F.lit(""))))
    every = labels(q)
    a, b, z = "http://x/a", "http://x/b", "http://x/z"
    # only the term that was matched goes, in the graph that is named
    assert labels(update(q, 'DELETE { ?x rdfs:label ?l } WHERE { ?x rdfs:label ?l . ?x rdfs:label "A"@en }', graph="urn:g")) == [("urn:g", b, "A", ""), ("urn:h", z, "A", "")]
    assert labels(update(q, 'DELETE DATA { GRAPH <urn:g> { <http://x/a> rdfs:label "A" } }')) == [r for r in every if r != ("urn:g", a, "A", "")]
    assert labels(update(q, "DELETE WHERE { GRAPH ?g { ?x a owl:Class . ?x rdfs:label ?l } }")) == [("urn:h", z, "A", "")]
    # deletes come first, solutions are those before the operation; an unbound variable adds nothing
    moved = update(q, "WITH <urn:g> DELETE { ?x rdfs:label ?l } INSERT { ?x rdfs:label ?l . ?x skos:broader ?up . ?l rdfs:label ?x } WHERE { ?x rdfs:label ?l OPTIONAL { ?x rdfs:subClassOf ?up } }")
    assert labels(moved) == every and values(moved.filter("p like '%broader'").select("s", "o", "o_kind")) == [(b, a, "iri")]
    # paths, filters and values see plain values; a later operation sees the earlier one
    closed = update(q, 'INSERT { ?x rdfs:seeAlso ?y } WHERE { ?x rdfs:subClassOf+ ?y } ; DELETE { ?x rdfs:seeAlso ?y } WHERE { VALUES ?y { <http://x/b> } ?x rdfs:seeAlso ?y FILTER(isIRI(?x) && STRSTARTS(STR(?x), "http://x/")) }', graph="urn:g")
    assert values(closed.filter("p like '%seeAlso'").select("s", "o")) == [(b, a), ("http://x/c", a)]
    added = update(q.limit(0), 'PREFIX x: <http://x/> INSERT DATA { GRAPH <urn:n> { _:n x:p "t\\n\\u00e9"^^<http://www.w3.org/2001/XMLSchema#string>, 1.5, x:o . _:n a x:C } } ; INSERT DATA { GRAPH <urn:n> { _:n a x:C } }')
    assert values(added.filter("p = 'http://x/p'").select("o", "o_kind", "o_dtype")) == [("1.5", "literal", "http://www.w3.org/2001/XMLSchema#decimal"), ("http://x/o", "iri", None), ("t\n\u00e9", "literal", None)]
    assert added.filter("s_kind = 'bnode'").select("s").distinct().count() == 2 and added.count() == 5
    assert update(q, "CLEAR ALL").isEmpty() and values(update(q, "DROP GRAPH <urn:g> ;").select("g")) == [("urn:h",)]
    for bad in ("INSERT DATA { <a> <b> <c> }", "INSERT DATA { GRAPH <g> { ?x a <c> } }", "DELETE DATA { GRAPH <g> { _:b a <c> } }", "LOAD <x>", 'INSERT DATA { GRAPH <g> { "a" a <c> } }'):
        with pytest.raises(ValueError):
            update(q, bad)


def test_plan_statements_run(spark):
    old = graph(spark, BUILD)
    new = graph(spark, BUILD.replace("someValuesFrom", "allValuesFrom").replace('"wall"', '"Wall"') + ":Col a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :has ; owl:someValuesFrom :Mat ] .")
    script = " ;\n".join(r.statement for r in diff.plan(old.select(*TERM), new.select(*TERM)).statements().orderBy("seq").collect())
    assert diff.isomorphic(update(old, script, graph="urn:g").select(*TERM), new.select(*TERM))


def test_command_line(spark, tmp_path, capsys):
    from quadrel.__main__ import main
    from quadrel.settings import Settings

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ttl").write_text(PREFIX + ':A a owl:Class ; rdfs:label "a" ; rdfs:subClassOf :B . :B a owl:Class .')
    (tmp_path / "in" / "bad.ttl").write_text("this is no turtle")
    (tmp_path / "env").write_text(f"# where\nSTORE='file://{tmp_path}/q'\nGRAPH_STORE=file://{tmp_path}/g\nOTHER=1\n")
    run = lambda *a: main(["--settings", str(tmp_path / "env"), *a], spark)
    assert Settings.load(tmp_path / "none").store == "quadrel-store" and Settings.load(tmp_path / "env", store="x").store == "x"
    assert run("ping") == 0 and "quads up: empty" in capsys.readouterr().out
    folder = f"file://{tmp_path}/in"
    assert run("upload", "--root", f"{tmp_path}/in", "--dry-run", folder) == 0 and "urn:graph:a.ttl" in capsys.readouterr().out
    assert run("upload", "--root", f"{tmp_path}/in", folder) == 1
    seen = capsys.readouterr()
    assert "1 files loaded, 1 failed; the store holds 4 triples" in seen.out and "bad.ttl" in seen.err
    s = store.QuadStore(spark, f"file://{tmp_path}/q")
    s.update("DELETE DATA { <http://x/A> rdfs:label \"a\" } ; INSERT DATA { <http://x/A> rdfs:label \"b\" }", graph="urn:graph:a.ttl")
    assert values(s.get_graph("urn:graph:a.ttl").filter("o_kind = 'literal'").select("o")) == [("b",)]
    s.versions.prune()
    assert len(s.versions.committed()) == 1 and s.count_triples() == 4
    assert run("lpg", "--dry-run") == 0 and convert.GraphStore(spark, f"file://{tmp_path}/g").table("nodes") is None
    assert run("lpg", "--embed") == 0 and run("lpg") == 0
    g = convert.GraphStore(spark, f"file://{tmp_path}/g")
    assert g.table("nodes").count() == 2 and values(g.table("edges").select("src", "dst", "type")) == [("http://x/A", "http://x/B", "SUBCLASS_OF")] and g.table("embeddings").count() == 2
    with pytest.raises(ValueError):
        convert.embedder("unknown")


BUILD = ":Wall a owl:Class ; rdfs:label \"wall\" ; rdfs:subClassOf :El, [ a owl:Restriction ; owl:onProperty :has ; owl:someValuesFrom :Mat ] . :El a owl:Class . :Mat a owl:Class ."


def test_diff_patch_verify(spark):
    old = graph(spark, BUILD).select(*TERM)
    relabelled = old.withColumn("s", F.when(F.col("s_kind") == "bnode", F.concat(F.lit("zz"), "s")).otherwise(F.col("s"))).withColumn("o", F.when(F.col("o_kind") == "bnode", F.concat(F.lit("zz"), "o")).otherwise(F.col("o")))
    assert diff.plan(old, relabelled).is_empty() and sum(d.count() for d in diff.naive(old, relabelled)) == 8
    new = graph(spark, BUILD.replace("someValuesFrom", "allValuesFrom").replace('"wall"', '"Wall"') + ":Col a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :has ; owl:someValuesFrom :Mat ] .").select(*TERM)
    p = diff.plan(old, new)
    assert p.metrics() == {"ground_delete": 1, "ground_add": 2, "star_delete": 4, "star_add": 8} and not p.unsafe
    assert diff.isomorphic(diff.apply_plan(old, p), new) and not diff.isomorphic(old, new)
    assert {r.seq for r in p.statements().collect()} == {0, 1, 2, 3}
    _, result = diff.synchronise(old, new, threshold=10)
    assert result.method == "incremental" and diff.synchronise(old, new, threshold=0.1)[1].method == "replace" and diff.synchronise(old, old)[1].method == "none"
    loose = old.union(graph(spark, "[] a owl:AllDisjointClasses .").select(*TERM).withColumn("s", F.lit("free")))
    assert diff.plan(old, loose).unsafe


def test_store(spark, tmp_path):
    s = store.QuadStore(spark, f"file://{tmp_path}/q")
    assert s.count_triples() == 0
    q = graph(spark, BUILD)
    s.put_graph("urn:g", q)
    s.put_graph("urn:g", q)
    assert s.count_triples() == q.count()
    s.put_graph("urn:h", q)
    assert s.count_triples() == 2 * q.count() and s.ask(("?x", "a", OWL.term("Class")))
    s.delete_graph("urn:g")
    assert s.get_graph("urn:g").isEmpty() and s.count_triples() == q.count()
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, v string")
    once = store.merge(a, b, ["k"])
    assert values(once) == values(store.merge(once, b, ["k"])) == [(1, "x"), (2, "z"), (3, "w")]


VOC = "v:A a skos:Concept ; skos:broader v:B . v:B a skos:Concept ; skos:definition \"own\"@en . v:C a skos:Concept . v:i a v:A ."
ONT = "f:Acc a owl:Class ; rdfs:label \"account\" ; skos:definition \"an account\"@en ; rdfs:subClassOf f:Prod, [ a owl:Restriction ; owl:onProperty f:held ; owl:someValuesFrom f:Holder ] . f:Prod a owl:Class ; rdfs:subClassOf f:Top . f:Top a owl:Class . f:Holder a owl:Class . f:Sav a owl:Class ; rdfs:subClassOf f:Acc ; owl:disjointWith f:Cur . f:Cur a owl:Class ; rdfs:subClassOf f:Acc ."
MAP = "v:A skos:closeMatch f:Acc . v:B skos:exactMatch f:Top . v:C skos:broadMatch f:Acc ; skos:relatedMatch f:Prod ."


def enricher(spark):
    p = "@prefix v: <http://v/> .\n"
    return Enricher(graph(spark, p + VOC), graph(spark, p + ONT), graph(spark, p + MAP), ["http://f/"], "http://v/")


def test_enrichment(spark):
    e = enricher(spark)
    f, v = "http://f/", "http://v/"
    assert set(values(e.subsumption())) == {(v + "A", "mapped_parent", f + "Acc"), (v + "A", "inferred_ancestor", f + "Prod"), (v + "A", "inferred_ancestor", f + "Top"), (v + "B", "equivalentTo", f + "Top"), (v + "C", "mapped_parent", f + "Acc"), (v + "C", "inferred_ancestor", f + "Prod"), (v + "C", "inferred_ancestor", f + "Top")}
    assert {(r.type, r.is_new) for r in e.instances().collect()} == {(f + x, True) for x in ("Acc", "Prod", "Top")}
    assert values(e.relationships()) == [(v + "A", f + "held", f + "Holder"), (v + "C", f + "held", f + "Holder")]
    assert values(e.annotations()) == [(v + "A", f + "Acc", "an account"), (v + "C", f + "Acc", "an account")]
    assert e.bridge_log().count() == 4 and e.bridge().count() == 3
    assert reason.new_triples(reason.closure_rl(e.inferred, (1,)), e.inferred).isEmpty()
    extra = graph(spark, "@prefix v: <http://v/> .\nv:C rdfs:subClassOf f:Sav, f:Cur .")
    assert values(e.validate(extra)) == [(v + "C", f + "Cur", f + "Sav")]
    assert e.enriched().filter((F.col("p") == SKOS.broadMatch)).count() == 5


def test_patterns(spark):
    p = patterns.Patterns(enricher(spark))
    f, v = "http://f/", "http://v/"
    assert dict(values(p.missing)) == {f + "Prod": "intermediate", f + "Sav": "narrower", f + "Cur": "narrower", f + "Holder": "referenced"}
    assert dict(values(p.placement)) == {f + "Prod": v + "B", f + "Sav": v + "A", f + "Cur": v + "A", f + "Holder": v + "BusinessAsset"}
    assert values(p.p5()) == [(v + "A", f + "held", f + "Holder")] and p.p6().isEmpty()
    assert [(r.new_concept, r.reparent_children) for r in p.p7().orderBy("new_concept").collect()] == [(v + "Cur", []), (v + "Holder", []), (v + "Prod", [v + "A"]), (v + "Sav", [])]
    assert {(r.concept, tuple(r.correct_parent)) for r in p.p2().collect()} == {(v + "A", (v + "Prod (propose)",)), (v + "C", (v + "A",))}
    assert p.p1().count() == 3 and p.p3().count() == 1 and p.p4().count() == 3


def test_rules(spark):
    q = graph(spark, ":part a owl:TransitiveProperty . :c :part :b . :b :part :m . :inj owl:inverseOf :hurts ; rdfs:domain :Injury . :x :inj :h . :r owl:hasValue :m ; owl:onProperty :part .")
    got = {(r.s, r.p, r.o) for r in reason.closure_rl(q.select(*TERM)).collect()}
    x = "http://x/"
    assert {(x + "c", x + "part", x + "m"), (x + "h", x + "hurts", x + "x"), (x + "x", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", x + "Injury"), (x + "b", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", x + "r")} <= got


def test_notation(spark):
    q = graph(spark, ":L rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :eats ; owl:allValuesFrom [ owl:unionOf (:H :M) ] ] ; owl:equivalentClass [ owl:intersectionOf (:A [ owl:complementOf :P ]) ] . :T a owl:Class .")
    assert {r.axiom for r in ontology.notation(q).collect()} == {"L ⊑ ∀eats.(H ⊔ M)", "L ≡ (A ⊓ ¬P)", "T ⊑ ⊤"}
    assert "outside OWL 2 EL" in ontology.profile(q).first().verdict[0]


def test_lpg(spark):
    q = graph(spark, ':A a owl:Class ; rdfs:label "a", "b" ; skos:altLabel "z", "y" ; skos:definition "Text" ; rdfs:subClassOf :B, owl:Thing . :B a owl:Class . :p a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :B . :q a owl:ObjectProperty ; rdfs:domain :A ; rdfs:range :Gone .')
    n = lpg.nodes(lpg.extract_classes(q))
    e = lpg.edges(lpg.extract_taxonomy(q), lpg.extract_properties(q), n)
    assert lpg.stats(n, e).first().asDict() == {"nodes": 2, "taxonomy_edges": 1, "property_edges": 1}
    assert dict(values(lpg.profiles(n, e)))["http://x/A"] == "Class: a. Synonyms: y, z. Definition: Text. Superclasses: x:B."
    meta = {r.uri: r for r in lpg.meta_nodes(q, spark.createDataFrame([("rdfs", "http://www.w3.org/2000/01/rdf-schema#"), ("skos", "http://www.w3.org/2004/02/skos/core#")], "prefix string, namespace string")).collect()}
    assert meta["http://x/A"].props["rdfs_label"] == "a | b" and meta["http://x/Gone"].labels == ["Resource"] and meta["http://x/p"].labels == ["ObjectProperty"]


def test_embedding(spark):
    import hashlib

    v = embed.hash_vector("ab")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and embed.hash_vector("") == [0.0] * 384
    want = [0.0] * 384
    for g in ("  a", " ab", "ab ", "b  "):
        h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big")
        want[h % 384] += 1 if h >> 63 else -1
    assert [round(x * 2, 9) for x in v] == want
    got = embed.embed(spark.createDataFrame([("ab",), (None,)], "t string"), "t").collect()
    assert got[0].embedding == v and sum(map(abs, got[1].embedding)) == 0


DOCS = [(0, "The national team trains players. Rugby players, such as wings and props play rugby! The teams have coaches"), (1, "A coach is a person. Wings uses balls. Live-stock eat grass."), (2, None), (3, "")]


def test_text(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    t = text.tokens(docs)
    rows = {(r.surface, r.tag, r.lemma) for r in t.collect()}
    assert {("trains", "VERB", "train"), ("national", "ADJ", "national"), ("players", "NOUN", "player"), ("Rugby", "NOUN", "rugby"), ("uses", "VERB", "us"), ("is", "VERB", "is")} <= rows
    assert ("national team", 1) in {(r.term, r.frequency) for r in text.phrases(t).collect()}
    rel = {(r.subject, r.predicate, r.object) for r in text.relations(t).collect()}
    assert ("team", "train", "player") in rel and ("team", "have", "coache") in rel
    assert {("wing", "rugby player"), ("prop play", "rugby player"), ("coach", "person")} & {(r.sub, r.sup) for r in text.hearst(docs).collect()}
    assert values(text.prf(spark.createDataFrame([("a",), ("b",)], "label string"), spark.createDataFrame([("b",), ("c",)], "label string"))) == [(0.5, 0.5, 0.5, 1, 2)]


def test_workflow(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    w = workflow.Workflow.configure(params={"term_extraction": {"top_k": 20}})
    assert w.plan() == list(workflow.STEPS) and ("human_in_the_loop", "evaluation", "verifies") in w.edges()
    no = spark.createDataFrame([("class", "grass", False)], "kind string, label string, keep boolean")
    s = w.run(workflow.State(docs, gold_classes=spark.createDataFrame([("national team",)], "label string"), decisions=no))
    assert s.artifacts["class_prf"].first().tp == 1 and s.classes.filter("label = 'grass'").isEmpty()
    assert len(workflow.tool_specs()) == 7
    assert workflow.to_turtle(s.classes, s.artifacts["subclass_of"], s.artifacts["relations"], "http://o#").count() > 8


def test_models(spark):
    cats = spark.createDataFrame([("c", "C", "d", "")], "id string, name string, domain string, description string")
    caps = spark.createDataFrame([("a", "A", "c", 3, ["b"], [], []), ("b", "B", "x", 9, ["b", "zz"], [], [])], "id string, name string, category string, maturity_level int, depends_on array<string>, supports array<string>, governed_by array<string>")
    found = {r.check for r in models.check_capabilities(cats, caps).collect()}
    assert found == {"category", "depends_on", "maturity level", "self"}
    good = caps.filter("id = 'a'").withColumn("depends_on", F.array().cast("array<string>"))
    assert models.check_capabilities(cats, good).isEmpty()
    assert models.edges(caps).filter("type = 'enables'").count() == 3
    assert models.to_quads(cats, caps, "http://c/").filter(F.col("p") == "http://c/enables").count() == 3
    assert SUB
