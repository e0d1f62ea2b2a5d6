"""Ontology descriptions: construct counts and profiles, description-logic notation, verbalisation, metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.terms import last_name
from ..plans.fixpoint import cut
from ..schema import LABEL, OWL, RDF, SUB, TYPE

# Constructs that are counted, by name.
CONSTRUCTS = {
    "union": [OWL.unionOf], "complement": [OWL.complementOf], "allValuesFrom": [OWL.allValuesFrom],
    "cardinality": [OWL.minQualifiedCardinality, OWL.maxQualifiedCardinality, OWL.qualifiedCardinality, OWL.minCardinality, OWL.maxCardinality],
    "someValuesFrom": [OWL.someValuesFrom], "oneOf": [OWL.oneOf],
}


def construct_counts(triples: DataFrame) -> DataFrame:
    """One row: how often each construct occurs, in one pass."""
    return triples.agg(*(F.count_if(F.col("p").isin([str(p) for p in ps])).alias(name) for name, ps in CONSTRUCTS.items()))


def profile(triples: DataFrame) -> DataFrame:
    """construct counts and verdict (array): which lightweight profiles the constructs rule out."""
    c = construct_counts(triples)
    v = F.array_compact(F.array(
        F.when((F.col("union") > 0) | (F.col("complement") > 0) | (F.col("allValuesFrom") > 0), "outside OWL 2 EL: union, complement or universal restriction"),
        F.when(F.col("cardinality") > 0, "outside OWL 2 EL and QL: cardinality"),
        F.when((F.col("someValuesFrom") > 0) & (F.col("allValuesFrom") > 0), "existential and universal restrictions narrow the profile"),
    ))
    return c.withColumn("verdict", F.when(F.size(v) == 0, F.array(F.lit("compatible with the lightweight profiles"))).otherwise(v))


def expressions(triples: DataFrame) -> DataFrame:
    """node, text: class expressions of blank nodes in description-logic notation, inner ones first."""
    t = cut(triples.filter("s_kind = 'bnode'").select("s", "p", "o", "o_kind").distinct())
    known = None
    one = lambda p, n: t.filter(F.col("p") == p).groupBy(F.col("s").alias("node")).agg(F.min("o").alias(n), F.min("o_kind").alias(n + "_kind"))
    prop = one(OWL.onProperty, "prop").select("node", last_name(F.col("prop")).alias("prop"))
    items = _lists(t)
    done = cut(t.sparkSession.createDataFrame([], "node string, text string"))
    while True:
        name = lambda df, c: df.join(done.select(F.col("node").alias(c), F.col("text").alias("inner")), c, "left").withColumn("name", F.when(F.col(c + "_kind") == "bnode", F.col("inner")).otherwise(last_name(F.col(c))))
        parts = []
        for p, sign in ((OWL.someValuesFrom, "∃"), (OWL.allValuesFrom, "∀")):
            parts.append(name(one(p, "o"), "o").join(prop, "node").filter("name is not null").select("node", F.concat(F.lit(sign), "prop", F.lit("."), "name").alias("text")))
        for p, sign in ((OWL.minQualifiedCardinality, "≥"), (OWL.maxQualifiedCardinality, "≤"), (OWL.qualifiedCardinality, "="), (OWL.minCardinality, "≥"), (OWL.maxCardinality, "≤"), (OWL.cardinality, "=")):
            q = one(p, "n").join(one(OWL.onClass, "o"), "node", "left").join(prop, "node")
            q = name(q, "o").withColumn("name", F.when(F.col("o").isNull(), "⊤").otherwise(F.col("name"))).filter("name is not null")
            parts.append(q.select("node", F.concat(F.lit(sign), "n", F.lit(" "), "prop", F.lit("."), "name").alias("text")))
        parts.append(one(OWL.hasValue, "o").join(prop, "node").select("node", F.concat(F.lit("∃"), "prop", F.lit(".{"), last_name(F.col("o")), F.lit("}")).alias("text")))
        parts.append(name(one(OWL.complementOf, "o"), "o").filter("name is not null").select("node", F.concat(F.lit("¬"), "name").alias("text")))
        for p, sign in ((OWL.intersectionOf, " ⊓ "), (OWL.unionOf, " ⊔ ")):
            m = t.filter(F.col("p") == p).select(F.col("s").alias("node"), F.col("o").alias("list")).join(items, "list")
            m = name(m, "item").groupBy("node").agg(F.every(F.col("name").isNotNull()).alias("all"), F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("x")).filter("all")
            parts.append(m.select("node", F.concat(F.lit("("), F.array_join(F.transform("x", lambda y: y["name"]), sign), F.lit(")")).alias("text")))
        found = parts[0]
        for d in parts[1:]:
            found = found.unionByName(d)
        known = cut(found.groupBy("node").agg(F.min("text").alias("text")))
        if known.count() == done.count():
            return known
        done = known


def _lists(t: DataFrame) -> DataFrame:
    """list, pos, item, item_kind: members of RDF lists by their head."""
    first = t.filter(F.col("p") == RDF.first).select(F.col("s").alias("cell"), F.col("o").alias("item"), F.col("o_kind").alias("item_kind"))
    rest = t.filter((F.col("p") == RDF.rest) & (F.col("o_kind") == "bnode")).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    heads = first.select("cell").join(rest.select(F.col("next").alias("cell")), "cell", "left_anti")
    at = cut(heads.select(F.col("cell").alias("list"), "cell", F.lit(0).alias("pos")))
    every, pos = at, 0
    while not at.isEmpty():
        pos += 1
        at = cut(at.join(rest, "cell").select("list", F.col("next").alias("cell"), F.lit(pos).alias("pos")))
        every = every.unionByName(at)
    return every.join(first, "cell").select("list", "pos", "item", "item_kind")


def notation(triples: DataFrame) -> DataFrame:
    """cls, axiom: subclass and equivalence axioms of named classes; a class without is below everything."""
    x = expressions(triples)
    a = triples.filter(F.col("p").isin(str(SUB), str(OWL.equivalentClass)) & (F.col("s_kind") == "iri")).join(x.withColumnRenamed("node", "o"), "o", "left")
    sign = F.when(F.col("p") == SUB, " ⊑ ").otherwise(" ≡ ")
    right = F.when(F.col("o_kind") == "bnode", F.coalesce("text", F.lit("?"))).otherwise(last_name(F.col("o")))
    rows = a.select(F.col("s").alias("cls"), F.concat(last_name(F.col("s")), sign, right).alias("axiom")).distinct()
    classes = triples.filter((F.col("p") == TYPE) & (F.col("o") == OWL.term("Class")) & (F.col("s_kind") == "iri")).select(F.col("s").alias("cls")).distinct()
    bare = classes.join(rows.select("cls"), "cls", "left_anti").select("cls", F.concat(last_name(F.col("cls")), F.lit(" ⊑ ⊤")).alias("axiom"))
    return rows.unionByName(bare)


def verbalise(triples: DataFrame) -> DataFrame:
    """s, p, sentence: axioms in controlled language, by label or local name."""
    names = triples.filter(F.col("p") == LABEL).groupBy(F.col("s").alias("k")).agg(F.min("o").alias("n"))
    kinds = {str(SUB): "Every %s is a %s.", str(OWL.equivalentClass): "%s means the same as %s.", str(OWL.disjointWith): "No %s is a %s.", str(TYPE): "%s is a %s."}
    a = triples.filter(F.col("p").isin(list(kinds)) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select("s", "p", "o").distinct()
    a = a.join(names.select(F.col("k").alias("s"), F.col("n").alias("sn")), "s", "left").join(names.select(F.col("k").alias("o"), F.col("n").alias("on")), "o", "left")
    left, right = F.coalesce("sn", last_name(F.col("s"))), F.coalesce("on", last_name(F.col("o")))
    sentence = None
    for p, form in kinds.items():
        sentence = F.when(F.col("p") == p, F.format_string(form, left, right)) if sentence is None else sentence.when(F.col("p") == p, F.format_string(form, left, right))
    return a.select("s", "p", sentence.alias("sentence"))


def metric_query(df: DataFrame, registry: dict[str, str], metrics: list[str], filters: dict[str, object] | None = None, group_by: list[str] | None = None) -> DataFrame:
    """A semantic query: named metrics (SQL aggregates of the registry), equality filters, grouping."""
    unknown = [m for m in metrics if m not in registry]
    if unknown:
        raise KeyError(f"unknown metrics {unknown}; known: {sorted(registry)}")
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.groupBy(*(group_by or [])).agg(*(F.expr(registry[m]).alias(m) for m in metrics))


def competency(questions: dict[str, tuple[DataFrame, int]]) -> list[tuple[str, int, int, bool]]:
    """(question, found, expected, passed): how many rows each question's query gives."""
    return [(q, n := df.count(), expected, n == expected) for q, (df, expected) in questions.items()]


# -- ontologies in code --------------------------------------------------------------------------


def render(axioms: DataFrame, syntax: str) -> DataFrame:
    """sub, sup, text: a subclass axiom in a syntax (turtle, rdfxml, functional, owlxml, manchester)."""
    forms = {
        "turtle": ":%1$s rdfs:subClassOf :%2$s .", "functional": "SubClassOf(:%1$s :%2$s)", "manchester": "Class: %1$s SubClassOf: %2$s",
        "rdfxml": '<owl:Class rdf:about="#%1$s"><rdfs:subClassOf rdf:resource="#%2$s"/></owl:Class>', "owlxml": '<SubClassOf><Class IRI="#%1$s"/><Class IRI="#%2$s"/></SubClassOf>',
    }
    return axioms.select("sub", "sup", F.format_string(forms[syntax], "sub", "sup").alias("text"))
